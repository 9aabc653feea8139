"""One query per operator, over the whole derived tables."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill import contract as C
from recordmill import functions as R
from recordmill.operators import edges as E
from recordmill.operators import mapping as Map
from recordmill.operators import merge as M
from recordmill.operators import report as P
from recordmill.operators.batches import numbered_batches
from recordmill.operators.identity import find_parents, match_external, new_id, resolve, three_tiers
from recordmill.operators.validate import duplicates, is_blank
from recordmill.plans import sync as S
from recordmill.plans.migrate import migrate
from recordmill.plans.pins import fresh_path
from recordmill.session import tune
from recordmill.sources import modified_since, read_csv, read_csv_by_records, scan_pages
from recordmill.sources.tables import table_bytes
from recordmill.streaming import SyncLog, event_stream, sync_batch
from verification.inputs import RECORD_IDS, derived

SECRET = "YS10ZXN0LW1hYy1zZWNyZXQtdmFsdWU="  # base64 of a-test-mac-secret-value
SINCE = {"deals": "1999-06-01 00:00:00", "companies": "2024-01-01 06:00:00",
         "contacts": "2024-01-01 06:00:00", "lines": "2001-06-01 00:00:00"}
QUERIES = {}


def query(function):
    QUERIES[function.__name__] = lambda spark, sf: function(tune(spark), sf)
    return function


def splitting(function):
    """The query with so few rows to a task that its lookups split their hot keys."""
    def run(spark, sf):
        spark.conf.set("spark.recordmill.rowsPerTask", "500")
        try:
            return function(spark, sf)
        finally:
            spark.conf.unset("spark.recordmill.rowsPerTask")
    run.__name__ = function.__name__
    return query(run)


def expression(name: str, table: str, keys: list[str], column, alias: str = "parsed"):
    """``column`` is a function, as a column can be built only in a running session."""
    QUERIES[name] = lambda spark, sf: derived(tune(spark), sf, table).select(*keys, column().alias(alias))


def raw(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


col = F.col
expression("t1_parse_date", "csv_deals", ["deal_id", "close_date"], lambda: R.parse_date(col("close_date")))
expression("t2_parse_amount", "csv_deals", ["deal_id", "amount"], lambda: R.parse_amount(col("amount")))
expression("t3_parse_integer", "csv_companies", ["company_id"], lambda: R.parse_integer(col("number_of_employees")))
expression("t5_email", "csv_contacts", ["contact_id"], lambda: R.normalise_email(col("email")))
expression("t7_phone", "csv_contacts", ["contact_id"], lambda: R.clean_phone(col("phone")))
expression("t9_industry", "csv_companies", ["company_id"], lambda: R.clean_industry(col("industry")))
expression("t10_deal_stage", "csv_deals", ["deal_id"], lambda: R.clean_deal_stage(col("deal_stage")))
expression("t11_status_stage", "rec_deals", ["record_id"], lambda: R.stage_of_status(col("status")))
expression("t12_lifecycle", "csv_contacts", ["contact_id"], lambda: R.clean_lifecycle(col("lifecycle_stage")))
expression("t13_external_id", "csv_deals", ["deal_id"], lambda: R.external_id("csv", C.DEALS, col("deal_id")))
expression("t15_first_link", "rec_contacts", ["record_id"], lambda: R.first_link((col("Company"), "array")))
expression("t18_mac", "event_bodies", ["event_id"], lambda: R.hmac_sha256_header(col("body"), SECRET), "header")


@query
def t4_parse_boolean(spark, sf):
    flag = F.when(col("l_returnflag") == "A", F.lit(" Yes ")).when(col("l_returnflag") == "N", F.lit("n")).otherwise(
        col("l_returnflag"))
    return raw(spark, sf, "lineitem").groupBy(flag.alias("flag")).agg(F.count(F.lit(1)).alias("n")).select(
        "flag", "n", R.parse_boolean(col("flag")).alias("parsed"))


@query
def t6_domain(spark, sf):
    return derived(spark, sf, "csv_companies").select(
        F.concat(F.lit("c"), "company_id").alias("key"), R.normalise_domain(col("domain")).alias("parsed")
    ).unionByName(raw(spark, sf, "pages").select(
        F.concat(F.lit("p"), col("page_id").cast("string")).alias("key"), R.normalise_domain(col("url")).alias("parsed")))


@query
def t14_entity(spark, sf):
    return normalised_events(spark, sf).groupBy("table_name", "entity").agg(F.count(F.lit(1)).alias("n"))


@query
def t16_event_fields(spark, sf):
    return normalised_events(spark, sf).select(
        "event_id", "entity", "table_name", "record_id", "source_event_id", "error_code",
        F.get_json_object("fields", "$.product_name").alias("product_name"))


def normalised_events(spark, sf):
    return R.event_fields(derived(spark, sf, "event_bodies"))


def attempts(spark, sf) -> DataFrame:
    """An attempt log: every event with a status, a socket code or an error's own flag."""
    k = col("event_id")
    return raw(spark, sf, "events").select(
        "event_id", "event_type",
        F.when(k % 7 == 0, F.lit(429)).when(k % 7 == 1, F.lit(503)).when(k % 7 == 2, F.lit(404)).alias("status"),
        F.when(k % 5 == 0, F.lit("ECONNRESET")).when(k % 5 == 1, F.lit("VALIDATION_ERROR"))
        .when(k % 5 == 2, F.lit("MISSING_REFERENCE")).alias("code"),
        F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False)).alias("flag"), "value")


@query
def t19_retryable(spark, sf):
    return attempts(spark, sf).select(
        "event_id", R.is_retryable(col("flag"), col("status"), col("code")).alias("retryable"))


@query
def t20_outcome(spark, sf):
    answer, retry = R.outcome_class(col("code"), col("flag"), col("status"))
    return attempts(spark, sf).select("event_id", answer.alias("answer"), retry.alias("retryable"))


@query
def t21_num_string(spark, sf):
    return raw(spark, sf, "orders").groupBy(R.number_text(col("o_totalprice")).alias("text")).agg(
        F.count(F.lit(1)).alias("n"))


def mapped(name: str, table: str, key: str, mapper, props: list[str]):
    def run(spark, sf):
        return mapper(derived(spark, sf, table)).select(
            key, *[col(f"props.{p}").alias(f"p_{p}") for p in [*props, *C.STAMPS]], "error",
            F.concat_ws("|", "warnings").alias("warnings"))
    QUERIES[name] = lambda spark, sf: run(tune(spark), sf)


mapped("p1_company", "csv_companies", "company_id", Map.map_company_csv, C.PROPERTIES[C.COMPANIES])
mapped("p2_contact", "csv_contacts", "contact_id", Map.map_contact_csv, C.PROPERTIES[C.CONTACTS])
mapped("p3_deal", "csv_deals", "deal_id", Map.map_deal_csv, C.PROPERTIES[C.DEALS])
mapped("p4_company", "rec_companies", "record_id", Map.map_company_record, C.PROPERTIES[C.COMPANIES])
mapped("p5_contact", "rec_contacts", "record_id", Map.map_contact_record, C.PROPERTIES[C.CONTACTS])
mapped("p6_deal", "rec_deals", "record_id", Map.map_deal_record, C.PROPERTIES[C.DEALS])
mapped("p7_line_item", "rec_lines", "record_id", Map.map_line_item_record, C.PROPERTIES[C.LINE_ITEMS])


@query
def p9_properties_long(spark, sf):
    wide = Map.map_company_csv(derived(spark, sf, "csv_companies")).where(col("error").isNull()).select(
        "company_id", *[col(f"props.{p}").alias(p) for p in C.PROPERTIES[C.COMPANIES]])
    return wide.unpivot(["company_id"], C.PROPERTIES[C.COMPANIES], "property", "value").where(
        col("value").isNotNull())


def csv_sources(spark, sf):
    return {t: derived(spark, sf, f"csv_{t}") for t in (C.COMPANIES, C.CONTACTS, C.DEALS)}


def csv_targets(spark, sf):
    return {t: derived(spark, sf, f"target_{t}") for t in (C.COMPANIES, C.CONTACTS, C.DEALS)}


def refused():
    return {C.COMPANIES: [(F.length("props.name") > 20, "name too long"),
                          (col("props.industry") == "FURNITURE", "industry closed")],
            C.DEALS: [(col("props.closedate") < "1996-01-01", "close date too old")]}


_RUNS: dict = {}


def once(spark, sf, name, make):
    """One run per session and folder: its staged tables are written once and read by many queries."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _RUNS:
        _RUNS[key] = make()
    return _RUNS[key]


def dry(spark, sf):
    return once(spark, sf, "dry", lambda: migrate(csv_sources(spark, sf), dry_run=True, pinned=True))


def real(spark, sf):
    return once(spark, sf, "real", lambda: migrate(
        csv_sources(spark, sf), csv_targets(spark, sf), constraints=refused(), pinned=True))


@query
def f2_rejections(spark, sf):
    rows = dry(spark, sf).rejections()
    return rows.select("object_type", "failure_reason", "company_id", "contact_id", "deal_id")


@query
def f3_warnings(spark, sf):
    return dry(spark, sf).warnings()


@query
def f4_orphan_reject(spark, sf):
    rows = migrate(csv_sources(spark, sf), dry_run=True, import_orphans=False, pinned=True).rejections()
    return rows.select("object_type", "failure_reason", "company_id", "contact_id", "deal_id")


@query
def f5_blank(spark, sf):
    tables = []
    for name in ("rec_companies", "rec_contacts", "rec_deals", "rec_lines"):
        df = derived(spark, sf, name)
        tables.append(df.select(F.lit(name).alias("source_table"), "record_id").where(is_blank(df)))
    return reduce(DataFrame.unionByName, tables)


@query
def f6_routed_counts(spark, sf):
    return normalised_events(spark, sf).groupBy(
        F.coalesce("entity", F.lit("dead letter")).alias("route"), "error_code").agg(F.count(F.lit(1)).alias("n"))


@query
def f7_authentic(spark, sf):
    good = R.hmac_sha256_header(col("body"), SECRET)
    kind = col("event_id") % 4
    sent = derived(spark, sf, "event_bodies").withColumn(
        "header", F.when(kind == 0, good).when(kind == 1, F.concat(good, F.lit("0"))).when(kind == 2, F.lit("hmac-sha256=00")))
    return sent.where(R.is_authentic(col("body"), col("header"), SECRET)).select("event_id", "header")


@query
def f10_failed_rows(spark, sf):
    return real(spark, sf).failures().select("object_type", "failure_reason", "company_id", "deal_id")


@query
def f11_dry_run_summary(spark, sf):
    return P.summary(dry(spark, sf)).drop("run_id")


@query
def j1_orphans(spark, sf):
    run = dry(spark, sf)
    parts = [run.staged[t].where(col("source_id").isNotNull() & col("to_companies").isNull()).select(
        F.lit(t).alias("object_type"), "source_id", "company_id") for t in (C.CONTACTS, C.DEALS)]
    return parts[0].unionByName(parts[1])


@query
def j2_pairs(spark, sf):
    return dry(spark, sf).edges().select("label", "from_id", "to_id")


@query
def j2_missing(spark, sf):
    return dry(spark, sf).missing_associations()


@query
def j3_edge_counts(spark, sf):
    return P.association_counts(dry(spark, sf).references())


@splitting
def j4_create_update(spark, sf):
    rows = derived(spark, sf, "csv_deals").where(col("deal_id") != "")
    found = match_external(rows, derived(spark, sf, "target_deals"),
                           R.external_id("csv", C.DEALS, col("deal_id")), ["deal_id"])
    return found.select("deal_id", "existing_id",
                        F.when(col("existing_id").isNull(), F.lit("create")).otherwise(F.lit("update")).alias("branch"))


def identities(spark, sf, name: str, mapper, natural: str | None, object_type: str) -> DataFrame:
    rows = mapper(derived(spark, sf, name)).where(col("error").isNull())
    return rows.select(
        "record_id", F.unix_micros(col("last_modified").cast("timestamp")).alias("seq"),
        F.nullif(C.KNOWN_ID, F.lit("")).alias("known_id"), col(f"props.{C.EXTERNAL_ID}").alias("external_id"),
        (col(f"props.{natural}") if natural else F.lit(None).cast("string")).alias("natural_key"), "props")


@splitting
def j6_tiers(spark, sf):
    parts = []
    for name, mapper, natural, t in (("rec_companies", Map.map_company_record, "domain", C.COMPANIES),
                                     ("rec_contacts", Map.map_contact_record, "email", C.CONTACTS)):
        rows = S.pin(identities(spark, sf, name, mapper, natural, t))
        target = derived(spark, sf, f"target_{t}", RECORD_IDS)
        parts.append(three_tiers(rows, target, natural).select("record_id", "existing_id", "matched_by"))
    return parts[0].unionByName(parts[1])


def with_parent(spark, sf, child: str, parent: str, entity: str) -> DataFrame:
    spec = S.SPECS[entity]
    rows = derived(spark, sf, child).withColumn("work_key", col("record_id"))
    parents = S.records(derived(spark, sf, parent), S.SPECS[spec.parent])
    return find_parents(rows, parents, S.link_of(rows, spec), col(spec.business_key), spec.business_key)


@splitting
def j8_parent(spark, sf):
    return with_parent(spark, sf, "rec_contacts", "rec_companies", C.CONTACT).select(
        "record_id", "parent_record", "parent_known_id")


@query
def j9_reread(spark, sf):
    """What each company event stands for, by the sync's own re-read."""
    events = S.pin(normalised_events(spark, sf)).where(col("error").isNull() & (col("entity") == C.COMPANY))
    changes = S.pin(events.select(col("event_id").alias("seq"), "entity", "record_id", "fields"))
    rows = S.pin(S.work_rows(changes, derived(spark, sf, "rec_companies"), S.SPECS[C.COMPANY]))
    now = rows.where("in_source").select("record_id", F.lit("current").alias("origin"), "company_name")
    own = rows.where(~F.coalesce(col("in_source"), F.lit(False))).select("seq", "record_id", F.when(
        col("in_source").isNull(), F.lit("record_not_found")).otherwise(F.lit("payload")).alias("origin"), "company_name")
    shown = [col("seq").alias("event_id"), "record_id", "origin", "company_name"]
    return changes.select("seq", "record_id").join(now, "record_id").select(*shown).unionByName(own.select(*shown))


@splitting
def j10_required_parent(spark, sf):
    lines = with_parent(spark, sf, "rec_lines", "rec_deals", C.LINE_ITEM)
    return lines.select("record_id", "parent_record", F.when(
        col("parent_record").isNull(), F.lit(C.MISSING_REFERENCE)).alias("code"))


@query
def j12_closure(spark, sf):
    """Companies that changed deals pull in, by the sync's own closure, and how many deals need each."""
    deals, companies = derived(spark, sf, "rec_deals"), derived(spark, sf, "rec_companies")
    changes = S.pin(numbered_batches(deals.select("record_id"), "record_id").select(
        col("ordinal").cast("bigint").alias("seq"), F.lit(C.DEAL).alias("entity"), "record_id", F.lit(None).cast("string").alias("fields")))
    work = S.pin(S._with_parents(S.pin(S.work_rows(changes, deals, S.SPECS[C.DEAL])), companies, S.SPECS[C.DEAL]))
    none = S.work_rows(changes.where(col("entity") == C.COMPANY), companies, S.SPECS[C.COMPANY])
    pulled = S._pulled([work], S.pin(none), companies, S.SPECS[C.COMPANY]).where("not asked").select("record_id")
    needed = work.where("needs_parent").groupBy("parent_record").agg(F.count(F.lit(1)).alias("children"))
    return needed.join(pulled, needed["parent_record"] == pulled["record_id"]).drop("record_id")


def company_changes(spark, sf):
    def make():
        rows = S.pin(identities(spark, sf, "rec_companies", Map.map_company_record, "domain", C.COMPANIES))
        target = S.pin(derived(spark, sf, "target_companies", RECORD_IDS))
        return S.pin(resolve(rows, target, "domain", "0")), target
    return once(spark, sf, "company changes", make)


@query
def m1_merge(spark, sf):
    rows, target = company_changes(spark, sf)
    return M.merge(target, M.fold_changes(rows, C.COMPANIES), C.COMPANIES)


def merged_as(name: str, table: str, mapper, natural: str | None, object_type: str, target_name: str):
    def run(spark, sf):
        # read a few columns at a time, so computing them again costs less than writing them
        rows = identities(spark, sf, table, mapper, natural, object_type)
        target = derived(spark, sf, target_name, RECORD_IDS)
        resolved = resolve(rows, target, natural, "0")
        return M.merge(target, M.fold_changes(resolved, object_type), object_type)
    QUERIES[name] = lambda spark, sf: run(tune(spark), sf)


merged_as("m1_merge_contacts", "rec_contacts", Map.map_contact_record, "email", C.CONTACTS, "target_contacts")
merged_as("m1_merge_deals", "rec_deals", Map.map_deal_record, None, C.DEALS, "target_deals")
merged_as("m1_merge_lines", "rec_lines", Map.map_line_item_record, None, C.LINE_ITEMS, "target_lines")


@query
def k1_taken_ids(spark, sf):
    """Ids of new companies where other records hold the first, the first two, or the first three candidates."""
    rows = derived(spark, sf, "rec_companies").select(
        "record_id", F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("known_id"),
        R.external_id("airtable", C.COMPANIES, col("record_id")).alias("external_id"),
        F.lit(None).cast("string").alias("natural_key"))
    held = raw(spark, sf, "customer").select("c_custkey", R.external_id(
        "airtable", C.COMPANIES, F.concat(F.lit("recC"), col("c_custkey").cast("string"))).alias("external_id"))
    taken = reduce(DataFrame.unionByName, [
        held.where(col("c_custkey") % every == 0).select(new_id(col("external_id"), extra).alias("id"))
        for every, extra in ((4, ""), (8, "@b"), (16, "@b#2"))])
    target = S.pin(taken.select("id", F.concat(F.lit("manual:"), "id").alias(C.EXTERNAL_ID)))
    return resolve(S.pin(rows), target, None, "b").select("record_id", "target_id", "action")


@query
def m1_replay(spark, sf):
    """Merging the same changes into the merged target again: what differs (nothing) and how much there is."""
    rows, target = company_changes(spark, sf)
    changes = M.fold_changes(rows, C.COMPANIES)
    merged = S.pin(M.merge(target, changes, C.COMPANIES).drop("action"))
    again = S.pin(resolve(rows.drop("target_id", "action", "matched_by"), merged, "domain", "1"))
    twice = M.merge(merged, M.fold_changes(again, C.COMPANIES), C.COMPANIES)
    before = merged.select("id", F.xxhash64(*merged.columns).alias("was"))
    return twice.join(before, "id", "full").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(col("action") == C.CREATED).alias("created"),
        F.count_if(col("was").isNull() | (F.xxhash64(*[col(c) for c in merged.columns]) != col("was"))).alias("changed"))


@query
def k3_edges(spark, sf):
    edges = dry(spark, sf).edges()
    return E.add_edges(edges, edges).groupBy("from_type", "to_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("from_id").alias("sources"))


@query
def k4_writeback(spark, sf):
    rows, _ = company_changes(spark, sf)
    return M.write_backs(rows)


@query
def k6_problem_rows(spark, sf):
    return P.problem_rows(real(spark, sf))


@query
def a1_tallies(spark, sf):
    return P.tallies(real(spark, sf))


@query
def a3_summary(spark, sf):
    return P.summary(real(spark, sf)).drop("run_id")


@query
def a6_unique(spark, sf):
    keyed = derived(spark, sf, "csv_deals").select(
        F.lit(C.DEALS).alias("object_type"), R.external_id("csv", C.DEALS, col("deal_id")).alias(C.EXTERNAL_ID))
    lines = raw(spark, sf, "lineitem").select(F.lit(C.LINE_ITEMS).alias("object_type"), F.concat_ws(
        ":", F.lit("csv:line_items"), col("l_orderkey").cast("string"), col("l_linenumber").cast("string")).alias(C.EXTERNAL_ID))
    return duplicates(keyed.unionByName(lines), "object_type", C.EXTERNAL_ID)


@query
def a7_dup_names(spark, sf):
    return duplicates(derived(spark, sf, "csv_deals").where(col("deal_name") != ""), "deal_name")


@query
def s1_csv_round_trip(spark, sf):
    """Texts with line breaks, written as CSV with a BOM and blanks in the header, and read back."""
    path = fresh_path(spark)
    raw(spark, sf, "documents").select(
        col("doc_id").cast("string").alias("\ufeffdoc_id"), "text", F.concat(F.lit(" "), "lang").alias(" lang ")
    ).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return read_csv(spark, path)


@query
def s1_csv_split(spark, sf):
    """The same texts as one file (of a large table, one for each 64 MB of it), read by a task for each 256 KB."""
    path = fresh_path(spark)
    files = -(-table_bytes(spark, f"{sf}/documents.parquet") // (64 << 20))
    raw(spark, sf, "documents").select(col("doc_id").cast("string").alias("doc_id"), "text", "lang").coalesce(max(files, 1)).write.option(
        "header", True).option("escape", '"').csv(path)
    sizes = {"spark.sql.files.maxPartitionBytes": "262144", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in sizes}
    try:
        for name, value in sizes.items():
            spark.conf.set(name, value)
        return S.pin(read_csv_by_records(spark, path))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@query
def l1_pages(spark, sf):
    """A capped scan, gone on with until its end; very many deals share a modification time."""
    return scan_pages(derived(spark, sf, "rec_deals"), SINCE["deals"], 4000).rows.select("page", "record_id")


@query
def w1_batches(spark, sf):
    return numbered_batches(derived(spark, sf, "rec_deals").select("record_id"), "record_id").select(
        "record_id", col("ordinal").cast("bigint").alias("ordinal"), col("batch_no").cast("bigint").alias("batch_no"))


@query
def s2_modified_since(spark, sf):
    return modified_since(derived(spark, sf, "rec_deals"), SINCE["deals"]).select("record_id")


@query
def s2_modified_uncapped(spark, sf):
    return modified_since(derived(spark, sf, "rec_lines"), SINCE["lines"], limit=None).select("record_id", "quantity")


# --- change sync ---------------------------------------------------------------------


def record_tables(spark, sf):
    return {e: derived(spark, sf, n) for e, n in zip(
        C.ENTITIES, ("rec_companies", "rec_contacts", "rec_deals", "rec_lines"))}


def record_targets(spark, sf):
    return {t: derived(spark, sf, n, RECORD_IDS) for t, n in zip(
        C.OBJECT_TYPES, ("target_companies", "target_contacts", "target_deals", "target_lines"))}


def event_run(spark: SparkSession, sf: str) -> S.SyncResult:
    def make():
        result = S.sync_events(normalised_events(spark, sf), record_tables(spark, sf), record_targets(spark, sf), seq="event_id")
        result.outcomes = S.pin(result.outcomes)
        return result
    return once(spark, sf, "events", make)


@query
def e2_event_sync(spark, sf):
    return event_run(spark, sf).outcomes.select(
        col("seq").alias("event_id"), "entity", "record_id", "status", "code", "parent_id")


@query
def e2_event_matches(spark, sf):
    return event_run(spark, sf).outcomes.where(col("status") == C.SYNCED).select(
        col("seq").alias("event_id"), "target_id", "action", "matched_by")


@query
def e2_event_edges(spark, sf):
    return event_run(spark, sf).edges


@query
def e3_rescan(spark, sf):
    """A whole-table lookback: every record of all four tables, oldest first, no cap."""
    result = S.rescan(record_tables(spark, sf), record_targets(spark, sf), "1990-01-01 00:00:00", limit=None)
    return result.outcomes.groupBy("entity", "status", "code").agg(
        F.count(F.lit(1)).alias("n"), F.count("parent_id").alias("with_parent"))


@query
def a4_rescan_summary(spark, sf):
    return P.rescan_tally(event_run(spark, sf).outcomes)


@query
def a9_signals(spark, sf):
    return P.signals(event_run(spark, sf).outcomes)


@query
def a9_attempts(spark, sf):
    timed = attempts(spark, sf).withColumn("duration", F.floor(col("value") * 100))
    return P.attempt_signals(timed, ["event_type"]).withColumns({p: F.round(p, 4) for p in ("p50", "p95", "p99")})


@query
def a9_percentiles(spark, sf):
    """Durations as they are, a third of them under one key."""
    k = col("event_id")
    timed = attempts(spark, sf).select(F.when(k % 3 == 0, F.lit("hot")).otherwise(col("event_type")).alias("event_type"), "status",
                                       (col("value") * 100).alias("duration"))
    return P.attempt_signals(timed, ["event_type"]).withColumns({p: F.round(p, 6) for p in ("p50", "p95", "p99")})


# --- the stream's log ------------------------------------------------------------------


def delivered(spark, sf) -> list[DataFrame]:
    """Two deliveries of the events: a quarter comes in both, some twice in one; ids are numbers, texts or missing."""
    k = col("event_id")
    rows = derived(spark, sf, "event_bodies").select(
        F.when(k % 10 == 0, None).when(k % 10 < 3, F.concat(F.lit("ev-"), k.cast("string"))).otherwise(k.cast("string")).alias("key"),
        "body", k.alias("k"))
    parts = [rows.where(col("k") % 4 < 3), rows.where(col("k") % 4 > 1)]
    return [p.unionByName(p.where(col("k") % 8 == 1)).drop("k") for p in parts]


def streamed(spark, sf) -> SyncLog:
    """The deliveries as two micro-batches of a stream over the record tables and targets."""
    def make():
        folder = fresh_path(spark)
        for n, part in enumerate(delivered(spark, sf)):
            part.coalesce(1).write.json(f"{folder}/in/part={n}")
        log = SyncLog(spark, f"{folder}/log", buckets=16).start_from(record_targets(spark, sf))
        bodies = spark.readStream.schema("key string, body string").option("maxFilesPerTrigger", 1).json(f"{folder}/in/part=*")
        job = event_stream(bodies, lambda: record_tables(spark, sf), log, f"{folder}/checkpoint", seq="key").trigger(
            availableNow=True).start()
        job.awaitTermination()
        if job.exception() is not None:
            raise job.exception()
        return log
    return once(spark, sf, "stream", make)


@query
def e4_replay(spark, sf):
    """Outcomes of events that come again, within a micro-batch and in a later one."""
    return streamed(spark, sf).outcomes().groupBy(
        F.coalesce("seq", F.lit("")).alias("event_key"), "entity", "record_id", "status", "code").agg(F.count(F.lit(1)).alias("n"))


@query
def a4_observed(spark, sf):
    """Figures per micro-batch, taken while outcomes were written."""
    return streamed(spark, sf).summaries().select(col("batch_id").cast("int").alias("batch_id"), "scanned", "synced", "skipped", "failed")


@query
def a9_trace(spark, sf):
    """Outcomes of one run, and of one type and run, from the folders that hold them."""
    log = streamed(spark, sf)
    parts = {"run 1": log.trace(run=1), "deals": log.trace(entity=C.DEAL), "run 0, contacts": log.trace(run=0, entity=C.CONTACT)}
    return reduce(DataFrame.unionByName, [
        rows.groupBy(F.lit(name).alias("scope"), "record_id", "status").agg(F.count(F.lit(1)).alias("n")) for name, rows in parts.items()])


@query
def e6_backlog(spark, sf):
    """Companies that the target refuses are tried again with the next batch, which names none of them."""
    def make():
        log = SyncLog(spark, f"{fresh_path(spark)}/log", buckets=16).start_from(record_targets(spark, sf))
        events = derived(spark, sf, "rec_companies").select(
            col("record_id").alias("key"), F.concat(F.lit('{"table": "companies", "recordId": "'), "record_id", F.lit('"}')).alias("body"))
        sync_batch(events, record_tables(spark, sf), log, 0, "key", constraints=refused())
        sync_batch(events.limit(0), record_tables(spark, sf), log, 1, "key")
        return log
    return once(spark, sf, "backlog", make).outcomes().select(
        "record_id", col("batch_id").cast("int").alias("batch_id"), "status", "code", "attempts")


@query
def e6_permanent(spark, sf):
    return P.permanent_failures(event_run(spark, sf).outcomes)
