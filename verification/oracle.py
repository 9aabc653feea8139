"""DuckDB SQL for the queries, written from the rules and not from the Spark plans."""

import base64

from recordmill import contract as C
from recordmill.functions.text import BLANKS
from verification.inputs import CSV_IDS, RECORD_IDS, cte

SQL: dict[str, str] = {}
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279)"


def trim(x):
    return f"trim({x}, {BLANK})"


def given(x):
    return f"coalesce({x}, '') <> ''"


def listed(words):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def amount(x):
    kept = f"regexp_replace({x}, '[^0-9.\\-]', '', 'g')"
    return f"try_cast(regexp_extract({kept}, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)', 0) as double)"


def number_text(x):
    return f"regexp_replace(cast({x} as varchar), '\\.0$', '')"


def calendar(text, pattern, y, m, d):
    part = lambda g: f"regexp_extract({text}, '{pattern}', {g})" if isinstance(g, int) else f"'{g}'"
    return f"try_cast(lpad({part(y)}, 4, '0') || '-' || lpad({part(m)}, 2, '0') || '-' || lpad({part(d)}, 2, '0') as date)"


def date(x):
    t = trim(x)
    shapes = [
        (r"^(\d{4})-(\d{2})-(\d{2})$", [(1, 2, 3)]), (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", [(1, 2, 3)]),
        (r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", [(3, 1, 2), (3, 2, 1)]),
        (r"^(\d{1,2})[-/](\d{4})$", [(2, 1, "1")]), (r"^(\d{4})[-/](\d{1,2})$", [(1, 2, "1")]),
    ]
    cases = " ".join(
        f"when regexp_matches({t}, '{p}') then coalesce({', '.join(calendar(t, p, *g) for g in groups)}, null)"
        for p, groups in shapes)
    named = r"^([a-z]+)\.?\s+(\d{4})$"
    months = " ".join(
        f"when '{n}' then '{i:02d}'" for i, full in enumerate(C.MONTHS, 1)
        for n in sorted({full, full[:3]} | ({"sept"} if i == 9 else set())))
    cases += (f" when regexp_matches(lower({t}), '{named}') then try_cast(regexp_extract(lower({t}), '{named}', 2)"
              f" || '-' || case regexp_extract(lower({t}), '{named}', 1) {months} end || '-01' as date)")
    day = f"case {cases} end"
    return f"case when year({day}) >= 100 then ltrim(strftime({day}, '%Y-%m-%d'), '0') end"


def email(x):
    e = f"lower({trim(x)})"
    return f"case when regexp_matches({e}, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') then {e} end"


def domain(x):
    step = f"regexp_replace(regexp_replace(lower({trim(x)}), '^https?://', ''), '^www\\.', '')"
    return f"nullif(regexp_replace({step}, '/.*$', ''), '')"


def phone(x):
    return f"nullif(regexp_replace({x}, '[^0-9]', '', 'g'), '')"


def industry(x):
    name = f"regexp_replace(upper({trim(x)}), '[\\s-]+', '_', 'g')"
    alias = " ".join(f"when '{k}' then '{v}'" for k, v in C.INDUSTRY_ALIASES.items())
    return f"case when {name} in {listed(C.INDUSTRIES)} then {name} else case lower({trim(x)}) {alias} end end"


def deal_stage(x):
    s = f"lower({trim(x)})"
    return f"case when {s} in {listed(C.DEAL_STAGES)} then {s} else 'qualifiedtobuy' end"


def status_stage(x):
    s = f"regexp_replace(lower({trim(x)}), '[_-]+', ' ', 'g')"
    return (f"case when {s} in {listed(C.WON_STATUSES)} then 'closedwon' "
            f"when {s} in {listed(C.LOST_STATUSES)} then 'closedlost' else 'qualifiedtobuy' end")


def lifecycle(x):
    s = f"lower({trim(x)})"
    return f"case when {s} in {listed(C.LIFECYCLE_STAGES)} then {s} end"


def text(template, x):
    a, b = template.split("{value}")
    return f"'{a}' || coalesce({x}, '') || '{b}'"


def simple(name, table, keys, columns):
    out = ", ".join([*keys, *[f"{e} as {a}" for a, e in columns.items()]])
    SQL[name] = f"with {cte(table)} select {out} from {table}"


simple("t1_parse_date", "csv_deals", ["deal_id", "close_date"], {"parsed": date("close_date")})
simple("t2_parse_amount", "csv_deals", ["deal_id", "amount"], {"parsed": amount("amount")})
simple("t3_parse_integer", "csv_companies", ["company_id"],
       {"parsed": f"cast(trunc({amount('number_of_employees')}) as bigint)"})
simple("t5_email", "csv_contacts", ["contact_id"], {"parsed": email("email")})
simple("t7_phone", "csv_contacts", ["contact_id"], {"parsed": phone("phone")})
simple("t9_industry", "csv_companies", ["company_id"], {"parsed": industry("industry")})
simple("t10_deal_stage", "csv_deals", ["deal_id"], {"parsed": deal_stage("deal_stage")})
simple("t11_status_stage", "rec_deals", ["record_id"], {"parsed": status_stage("status")})
simple("t12_lifecycle", "csv_contacts", ["contact_id"], {"parsed": lifecycle("lifecycle_stage")})
simple("t13_external_id", "csv_deals", ["deal_id"], {"parsed": "'csv:deals:' || deal_id"})
simple("t15_first_link", "rec_contacts", ["record_id"], {"parsed": "Company[1]"})

KEY = base64.b64decode("YS10ZXN0LW1hYy1zZWNyZXQtdmFsdWU=").ljust(64, b"\0")
blob = lambda n: "'" + "".join(f"\\x{b ^ n:02X}" for b in KEY) + "'::blob"
MAC = f"'hmac-sha256=' || sha256({blob(0x5C)} || unhex(sha256({blob(0x36)} || encode(body))))"
SQL["t18_mac"] = f"with {cte('event_bodies')} select event_id, {MAC} as header from event_bodies"
SQL["t4_parse_boolean"] = """
select flag, count(*) as n, case when lower(trim(flag)) in ('true','1','yes','y','t') then true
  when lower(trim(flag)) in ('false','0','no','n','f') then false end as parsed
from (select case l_returnflag when 'A' then ' Yes ' when 'N' then 'n' else l_returnflag end as flag from lineitem)
group by flag"""
SQL["t6_domain"] = f"""with {cte('csv_companies')}
select 'c' || company_id as key, {domain('domain')} as parsed from csv_companies
union all select 'p' || cast(page_id as varchar), {domain('url')} from pages"""

# --- events ---------------------------------------------------------------------------
J = "case when json_valid(body) then json(body) end"


def truthy(*paths):
    at = lambda p: f"json_extract(j, '{p}')"
    return "coalesce(" + ", ".join(
        f"case when {at(p)} is not null and cast({at(p)} as varchar) not in ('null', '\"\"', 'false', '0') then {at(p)} end"
        for p in paths) + ")"


EVENTS = f"""{cte('event_bodies')},
ev0 as (select *, {J} as j from event_bodies),
ev1 as (select event_id, ts, j, {truthy('$.table', '$.table_name', '$.tableName', '$.record.table')} ->> '$' as table_name,
  {truthy('$.recordId', '$.record_id', '$.id', '$.record.id', '$.record.recordId')} as rid,
  {truthy('$.fields', '$.record.fields')} as flds,
  {truthy('$.eventId', '$.event_id')} ->> '$' as source_event_id from ev0),
ev2 as (select *, regexp_replace(lower(table_name), '[^a-z]', '', 'g') as letters from ev1),
ev3 as (select *, case when letters in ('company','companies') then 'company' when letters in ('contact','contacts') then 'contact'
  when letters in ('deal','deals') then 'deal' when letters in ('lineitem','lineitems') then 'line_item' end as ent,
  case when json_type(rid) = 'VARCHAR' then rid ->> '$' end as record_id from ev2),
ev as (select event_id, case when ent is not null and record_id is not null then ent end as entity, table_name, record_id,
  source_event_id, flds as fields,
  case when j is null or ent is null or record_id is null then 'VALIDATION_ERROR' end as error_code from ev3)"""
SQL["t14_entity"] = f"with {EVENTS} select table_name, entity, count(*) as n from ev group by 1, 2"
SQL["t16_event_fields"] = f"""with {EVENTS} select event_id, entity, table_name, record_id, source_event_id, error_code,
  fields ->> '$.product_name' as product_name from ev"""
SQL["f6_routed_counts"] = f"""with {EVENTS} select coalesce(entity, 'dead letter') as route, error_code, count(*) as n
from ev group by 1, 2"""
SQL["f7_authentic"] = f"""with {cte('event_bodies')} select event_id, {MAC} as header from event_bodies where event_id % 4 = 0"""

ATTEMPTS = """attempts as (select event_id,
  case event_id % 7 when 0 then 429 when 1 then 503 when 2 then 404 end as status,
  case event_id % 5 when 0 then 'ECONNRESET' when 1 then 'VALIDATION_ERROR' when 2 then 'MISSING_REFERENCE' end as code,
  case event_id % 3 when 0 then true when 1 then false end as flag from events)"""
SQL["t19_retryable"] = f"""with {ATTEMPTS} select event_id, case when flag is not null then flag
  when status = 429 or status >= 500 then true when code in {listed(C.TRANSIENT_CODES)} then true else false end as retryable
from attempts"""
SQL["t20_outcome"] = f"""with {ATTEMPTS}, r as (select *, case when code in ('VALIDATION_ERROR', 'MISSING_REFERENCE') then false
  when flag = true or coalesce(status, 500) >= 500 then true else false end as retryable from attempts)
select event_id, case when not retryable then 400 when status = 429 then 429 else 503 end as answer, retryable from r"""
SQL["t21_num_string"] = f"select {number_text('o_totalprice')} as text, count(*) as n from orders group by 1"


# --- mappers ----------------------------------------------------------------------------
def mapper(name, table, key, object_type, source, system, props, error, warnings, ids=CSV_IDS):
    """CTE ``m_<table>``: all source columns, p_<property>, error, w (list of warnings)."""
    p = ", ".join(f"nullif({e}, '') as p_{n}" for n, e in props.items())
    noted = ", ".join(f"case when {c} then {t} end" for c, t in warnings) or "null"
    return f"""m0_{table} as (select *, {p}, '{source}:{object_type}:' || {key} as p_external_source_id,
  '{system}' as p_external_source_system from {table}),
m1_{table} as (select *, {error} as error from m0_{table}),
m_{table} as (select *, case when error is null then [x for x in [{noted}] if x is not null] else [] end as w from m1_{table})"""


def lost(source, prop, template):
    return f"{given(source)} and p_{prop} is null", text(template, source)


CSV_PROPS = {
    "csv_companies": {"name": trim("company_name"), "domain": domain("domain"), "industry": industry("industry"),
                      "numberofemployees": number_text(f"trunc({amount('number_of_employees')})")},
    "csv_contacts": {"firstname": trim("first_name"), "lastname": trim("last_name"), "email": email("email"),
                     "phone": phone("phone"), "lifecyclestage": lifecycle("lifecycle_stage")},
    "csv_deals": {"dealname": trim("deal_name"), "amount": number_text(amount("amount")),
                  "dealstage": deal_stage("deal_stage"), "closedate": date("close_date"), "pipeline": "'default'"},
}
M = {
    "csv_companies": mapper("p1", "csv_companies", "company_id", C.COMPANIES, "csv", "csv_migration",
        CSV_PROPS["csv_companies"], f"case when p_name is null then '{C.NO_COMPANY_NAME}' end",
        [lost("domain", "domain", C.BAD_DOMAIN), lost("number_of_employees", "numberofemployees", C.BAD_EMPLOYEES),
         lost("industry", "industry", C.BAD_INDUSTRY)]),
    "csv_contacts": mapper("p2", "csv_contacts", "contact_id", C.CONTACTS, "csv", "csv_migration",
        CSV_PROPS["csv_contacts"], f"case when p_email is null then {text(C.BAD_EMAIL, 'email')} end",
        [(f"{trim('lifecycle_stage')} <> '' and p_lifecyclestage is null", text(C.BAD_LIFECYCLE, "lifecycle_stage"))]),
    "csv_deals": mapper("p3", "csv_deals", "deal_id", C.DEALS, "csv", "csv_migration",
        CSV_PROPS["csv_deals"], f"case when p_dealname is null then '{C.NO_DEAL_NAME}' end",
        [(f"lower({trim('deal_stage')}) not in {listed(C.DEAL_STAGES)}", text(C.BAD_STAGE, "deal_stage")),
         lost("amount", "amount", C.BAD_AMOUNT), lost("close_date", "closedate", C.BAD_CLOSE_DATE)]),
    "rec_companies": mapper("p4", "rec_companies", "record_id", C.COMPANIES, "airtable", "airtable",
        {**CSV_PROPS["csv_companies"], "name": "company_name"},
        f"case when not {given('company_name')} then '{C.RECORD_NO_COMPANY_NAME}' end", []),
    "rec_contacts": mapper("p5", "rec_contacts", "record_id", C.CONTACTS, "airtable", "airtable",
        {**CSV_PROPS["csv_contacts"], "firstname": "first_name", "lastname": "last_name", "lifecyclestage": "null::varchar"},
        f"case when p_email is null then {text(C.RECORD_BAD_EMAIL, 'email')} end", []),
    "rec_deals": mapper("p6", "rec_deals", "record_id", C.DEALS, "airtable", "airtable",
        {**CSV_PROPS["csv_deals"], "dealname": "deal_name", "dealstage": status_stage("status")},
        f"case when not {given('deal_name')} then '{C.RECORD_NO_DEAL_NAME}' end",
        [(f"{given('close_date')} and p_closedate is null", f"'{C.RECORD_BAD_CLOSE_DATE}'")]),
    "rec_lines": mapper("p7", "rec_lines", "record_id", C.LINE_ITEMS, "airtable", "airtable",
        {"name": "product_name", "quantity": number_text(amount("quantity")), "price": number_text(amount("unit_price"))},
        f"case when not {given('product_name')} then '{C.RECORD_NO_PRODUCT_NAME}' end", []),
}
for name, table, key, t in (
    ("p1_company", "csv_companies", "company_id", C.COMPANIES), ("p2_contact", "csv_contacts", "contact_id", C.CONTACTS),
    ("p3_deal", "csv_deals", "deal_id", C.DEALS), ("p4_company", "rec_companies", "record_id", C.COMPANIES),
    ("p5_contact", "rec_contacts", "record_id", C.CONTACTS), ("p6_deal", "rec_deals", "record_id", C.DEALS),
    ("p7_line_item", "rec_lines", "record_id", C.LINE_ITEMS),
):
    out = ", ".join(f"p_{p}" for p in [*C.PROPERTIES[t], *C.STAMPS])
    SQL[name] = f"""with {cte(table)}, {M[table]}
select {key}, {out}, error, array_to_string(w, '|') as warnings from m_{table}"""
SQL["p9_properties_long"] = f"with {cte('csv_companies')}, {M['csv_companies']} " + " union all ".join(
    f"select company_id, '{p}' as property, p_{p} as value from m_csv_companies where error is null and p_{p} is not null"
    for p in C.PROPERTIES[C.COMPANIES])


# --- migration -----------------------------------------------------------------------------
def migration(real: bool, orphans: bool = True) -> str:
    """CTEs s_companies, s_contacts, s_deals: staged rows."""
    refused = {
        "companies": "case when length(p_name) > 20 then 'name too long' when p_industry = 'FURNITURE' then 'industry closed' end",
        "contacts": "null::varchar",
        "deals": "case when p_closedate < '1996-01-01' then 'close date too old' end",
    }
    parts = [cte(f"csv_{t}") + ", " + M[f"csv_{t}"] for t in ("companies", "contacts", "deals")]
    if real:
        parts += [cte(f"target_{t}") for t in ("companies", "contacts", "deals")]
    for t, key in (("companies", "company_id"), ("contacts", "contact_id"), ("deals", "deal_id")):
        links = {"companies": [], "contacts": [("companies", "company_id")],
                 "deals": [("companies", "company_id"), ("contacts", "contact_id")]}[t]
        select = ", ".join([f"i_{p}.target_id as to_{p}" for p, _ in links])
        joins = " ".join(f"left join ids_{p} i_{p} on i_{p}.source_id = nullif(m.{fk}, '')" for p, fk in links)
        missing = f"case when nullif({key}, '') is null then 'Missing {key}' end"
        orphan = f"'Referenced company_id=\"' || coalesce(company_id, '') || '\" does not exist in companies.csv'"
        early, warn = missing, "[]::varchar[]"
        if links and orphans:
            warn = f"case when to_companies is null then [{orphan} || '{C.ORPHAN_KEPT}'] else []::varchar[] end"
        elif links:
            early = f"coalesce({missing}, case when to_companies is null then {orphan} end)"
        parts.append(f"""l_{t} as (select m.*, nullif(m.{key}, '') as source_id{', ' + select if select else ''} from m_csv_{t} m {joins})""")
        parts.append(f"""e_{t} as (select *, {early} as early from l_{t})""")
        parts.append(f"""r_{t} as (select *, coalesce(early, error) as reason0,
  case when early is not null then [] else list_concat({warn}, w) end as warnings from e_{t})""")
        if real:
            parts.append(f"""s_{t} as (select q.*, coalesce(reason0, refused) as reason,
  case when reason0 is not null then 'rejected' when refused is not null then 'failed' when hit is not null then 'updated' else 'created' end as status,
  case when reason0 is null then coalesce(hit, case when refused is null then substr(sha256('csv:{t}:' || source_id), 1, 32) end) end as target_id
  from (select r.*, case when reason0 is null then {refused[t]} end as refused, g.id as hit from r_{t} r
    left join target_{t} g on g.external_source_id = 'csv:{t}:' || r.source_id and r.reason0 is null) q)""")
        else:
            parts.append(f"""s_{t} as (select *, reason0 as reason, case when reason0 is null then 'planned' else 'rejected' end as status,
  case when reason0 is null then 'dry-run:csv:{t}:' || source_id end as target_id from r_{t})""")
        parts.append(f"ids_{t} as (select source_id, max(target_id) as target_id from s_{t} where target_id is not null group by 1)")
    return "with " + ",\n".join(parts)


DRY, REAL = migration(False), migration(True)
PROBLEMS = """
select 'companies' as object_type, reason as failure_reason, company_id, null as contact_id, null as deal_id from s_companies where status = '{0}'
union all select 'contacts', reason, company_id, contact_id, null from s_contacts where status = '{0}'
union all select 'deals', reason, company_id, contact_id, deal_id from s_deals where status = '{0}'"""
SQL["f2_rejections"] = DRY + PROBLEMS.format("rejected")
SQL["f4_orphan_reject"] = migration(False, orphans=False) + PROBLEMS.format("rejected")
SQL["f10_failed_rows"] = REAL + f"select object_type, failure_reason, company_id, deal_id from ({PROBLEMS.format('failed')})"
SQL["f3_warnings"] = DRY + " union all ".join(
    f"select '{t}' as object_type, source_id, unnest(warnings) as message, 'run' as run_id from s_{t}" for t in ("companies", "contacts", "deals"))
SQL["k6_problem_rows"] = REAL + " union all ".join(
    f"""select '{t}' as object_type, reason as failure_reason, {', '.join(
        (c if c in cols else f'null as {c}') for c in
        ['company_id', 'company_name', 'domain', 'industry', 'number_of_employees', 'contact_id', 'first_name', 'last_name',
         'email', 'phone', 'lifecycle_stage', 'deal_id', 'deal_name', 'amount', 'deal_stage', 'close_date'])}, 'run' as run_id
from s_{t} where status in ('rejected', 'failed')"""
    for t, cols in (("companies", {"company_id", "company_name", "domain", "industry", "number_of_employees"}),
                    ("contacts", {"contact_id", "first_name", "last_name", "email", "phone", "company_id", "lifecycle_stage"}),
                    ("deals", {"deal_id", "deal_name", "amount", "deal_stage", "close_date", "company_id", "contact_id"})))
REFERENCES = " union all ".join(
    f"""select '{a}->{b}' as label, '{a}' as from_type, '{b}' as to_type, target_id as from_id, to_{b} as to_id, {key} as from_key, {fk} as to_key,
  case when target_id is null then '{a} record was not migrated' when to_{b} is null then '{b} record ' || {fk} || ' was not migrated' end as reason
from s_{a} where {given(fk)}"""
    for a, b, key, fk in (("contacts", "companies", "contact_id", "company_id"), ("deals", "companies", "deal_id", "company_id"),
                          ("deals", "contacts", "deal_id", "contact_id")))
SQL["j1_orphans"] = DRY + " union all ".join(
    f"select '{t}' as object_type, source_id, company_id from s_{t} where source_id is not null and to_companies is null"
    for t in ("contacts", "deals"))
SQL["j2_pairs"] = DRY + f"select label, from_id, to_id from ({REFERENCES}) where reason is null"
SQL["j2_missing"] = DRY + f"select label, from_key, to_key, reason, 'run' as run_id from ({REFERENCES}) where reason is not null"
SQL["j3_edge_counts"] = DRY + f"""select case label when 'contacts->companies' then 'Contact → Company'
  when 'deals->companies' then 'Deal → Company' else 'Deal → Contact' end as label, count(*) as n
from ({REFERENCES}) where reason is null group by 1"""
SQL["k3_edges"] = DRY + f"""select from_type, to_type, count(*) as n, count(distinct from_id) as sources from
(select distinct from_type, from_id, to_type, to_id from ({REFERENCES}) where reason is null) group by 1, 2"""
STATUS = " union all ".join(f"select '{t}' as object_type, status from s_{t}" for t in ("companies", "contacts", "deals"))
SQL["a1_tallies"] = REAL + f"""select t.object_type, count(*) filter (status = 'created') as created, count(*) filter (status = 'updated') as updated,
 count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'failed') as failed
from (values ('companies'), ('contacts'), ('deals'), ('line_items')) t(object_type) left join ({STATUS}) s using (object_type) group by 1"""


def summary_sql(head):
    n = lambda t, s: f"(select count(*) from s_{t} where status = '{s}') as {t}_{s}"
    total = lambda s: f"(select count(*) from ({STATUS}) where status = '{s}')"
    refs = lambda lab: f"(select count(*) from ({REFERENCES}) where reason is null and label = '{lab}')"
    cols = [f"(select count(*) from s_{t}) as {t}_rows" for t in ("companies", "contacts", "deals")]
    cols += [n(t, s) for t in ("companies", "contacts", "deals") for s in ("created", "updated")]
    cols += ["cast(0 as bigint) as line_items_created", "cast(0 as bigint) as line_items_updated",
             refs("contacts->companies") + " as contact_to_company", refs("deals->companies") + " as deal_to_company",
             refs("deals->contacts") + " as deal_to_contact", total("rejected") + " as rejected", total("failed") + " as failed",
             "(select count(*) from (" + " union all ".join(f"select unnest(warnings) from s_{t}" for t in ("companies", "contacts", "deals")) + ")) as warnings",
             f"(select count(*) from ({REFERENCES}) where reason is not null) as missing_associations",
             f"{total('rejected')} + {total('failed')} > 0 as has_problems"]
    return head + "select " + ",\n".join(cols)


SQL["f11_dry_run_summary"] = summary_sql(DRY)
SQL["a3_summary"] = summary_sql(REAL)
SQL["j4_create_update"] = f"""with {cte('csv_deals')}, {cte('target_deals')}
select d.deal_id, g.id as existing_id, case when g.id is null then 'create' else 'update' end as branch
from csv_deals d left join target_deals g on g.external_source_id = 'csv:deals:' || d.deal_id where d.deal_id <> ''"""

# --- blank records, duplicates, order ------------------------------------------------------------
SQL["f5_blank"] = f"""with {cte('rec_companies')}, {cte('rec_contacts')}, {cte('rec_deals')}, {cte('rec_lines')}
select 'rec_companies' as source_table, record_id from rec_companies where concat(company_id, company_name, domain, industry, number_of_employees) = ''
union all select 'rec_contacts', record_id from rec_contacts where concat(contact_id, first_name, last_name, email, phone, company_id) = '' and len(Company) = 0
union all select 'rec_deals', record_id from rec_deals where concat(deal_id, deal_name, amount, status, close_date, company_id) = '' and len(Company) = 0
union all select 'rec_lines', record_id from rec_lines where concat(product_name, quantity, unit_price, deal_id) = '' and len(Deal) = 0"""
SQL["a6_unique"] = f"""with {cte('csv_deals')}, k as (select 'deals' as object_type, 'csv:deals:' || deal_id as external_source_id from csv_deals
union all select 'line_items', 'csv:line_items:' || l_orderkey || ':' || l_linenumber from lineitem)
select object_type, external_source_id, count(*) as n from k group by 1, 2 having count(*) > 1"""
SQL["a7_dup_names"] = f"""with {cte('csv_deals')} select deal_name, count(*) as n from csv_deals where deal_name <> '' group by 1 having count(*) > 1"""
SQL["w1_batches"] = f"""with {cte('rec_deals')}, o as (select record_id, row_number() over (order by record_id) as ordinal from rec_deals)
select record_id, ordinal, cast(floor((ordinal - 1) / 100) as bigint) as batch_no from o"""
SQL["s2_modified_since"] = f"""with {cte('rec_deals')} select record_id from rec_deals where last_modified > timestamp '1999-06-01'
order by last_modified, record_id"""
SQL["s1_csv_round_trip"] = f"""select cast(doc_id as varchar) as doc_id, nullif(trim(text, '{BLANKS}'), '') as text,
nullif(trim(lang, '{BLANKS}'), '') as lang from documents"""
SQL["s2_modified_uncapped"] = f"""with {cte('rec_lines')} select record_id, quantity from rec_lines where last_modified > timestamp '2001-06-01'"""


# --- identity -----------------------------------------------------------------------------------
def tiers(t, table, natural, suffix=""):
    """CTE t_<type>: live records with existing id, matched_by, natural key."""
    return f"""{M[table]},
byx_{t} as (select external_source_id as k, min(id) as id from target_{t} where external_source_id is not null group by 1),
byn_{t} as (select {natural} as k, min(id) as id from target_{t} where {natural} is not null group by 1),
t_{t} as (select m.*, a.id as t1, b.id as t2, c.id as t3, coalesce(a.id, b.id, c.id) as existing_id,
  case when a.id is not null then 'hubspot_record_id' when b.id is not null then 'external_source_id' when c.id is not null then 'natural_key' end as matched_by
from m_{table} m left join target_{t} a on a.id = nullif(m.hubspot_record_id, '') left join byx_{t} b on b.k = m.p_external_source_id
left join byn_{t} c on c.k = m.p_{natural} where m.error is null)"""


COMPANY_TIERS = f"with {cte('rec_companies')}, {cte('target_companies', RECORD_IDS)}, {tiers('companies', 'rec_companies', 'domain')}"
SQL["j6_tiers"] = COMPANY_TIERS + f""", {cte('rec_contacts')}, {cte('target_contacts', RECORD_IDS)}, {tiers('contacts', 'rec_contacts', 'email')}
select record_id, existing_id, matched_by from t_companies union all select record_id, existing_id, matched_by from t_contacts"""
CHANGED = COMPANY_TIERS + """, c0 as (select *, first_value(p_external_source_id) over (partition by existing_id is null, p_domain order by last_modified) as lead from t_companies),
c1 as (select *, coalesce(existing_id, substr(sha256(case when p_domain is null then p_external_source_id else lead end), 1, 32)) as target_id from c0),
folded as (select target_id as id, """ + ", ".join(
    f"arg_max(p_{p}, last_modified) filter (p_{p} is not null) as {p}" for p in [*C.PROPERTIES[C.COMPANIES], *C.STAMPS]) + """ from c1 group by 1)"""
SQL["m1_merge"] = CHANGED + " select coalesce(n.id, o.id) as id, " + ", ".join(
    f"coalesce(n.{p}, o.{p}) as {p}" for p in [*C.PROPERTIES[C.COMPANIES], *C.STAMPS]) + """,
case when n.id is null then null when o.id is null then 'created' else 'updated' end as action
from target_companies o full join folded n on o.id = n.id"""
SQL["m1_replay"] = CHANGED + """ select (select count(*) from target_companies o full join folded n on o.id = n.id) as records,
cast(0 as bigint) as created, cast(0 as bigint) as changed"""
SQL["k4_writeback"] = CHANGED + " select record_id, target_id from c1 where coalesce(hubspot_record_id, '') <> target_id"


def parent(child, parent_table, link, key, n="", declare=True):
    declared = f"{cte(child)}, {cte(parent_table)}," if declare else ""
    return f"""{declared}
pk{n} as (select {key} as k, arg_min(record_id, record_id) as record_id, arg_min(coalesce(nullif(hubspot_record_id, ''), '-'), record_id) as known
  from {parent_table} where {given(key)} group by 1),
par{n} as (select c.*, coalesce(a.record_id, b.record_id) as parent_record,
  case when a.record_id is not null then nullif(a.hubspot_record_id, '') else nullif(b.known, '-') end as parent_known_id
from {child} c left join {parent_table} a on a.record_id = c.{link}[1] left join pk{n} b on a.record_id is null and b.k = nullif(c.{key}, ''))"""


SQL["j8_parent"] = f"with {parent('rec_contacts', 'rec_companies', 'Company', 'company_id')} select record_id, parent_record, parent_known_id from par"
SQL["j10_required_parent"] = f"""with {parent('rec_lines', 'rec_deals', 'Deal', 'deal_id')}
select record_id, parent_record, case when parent_record is null then 'MISSING_REFERENCE' end as code from par"""
SQL["j12_closure"] = f"""with {parent('rec_deals', 'rec_companies', 'Company', 'company_id')}
select parent_record, count(*) as children from par where deal_name <> '' and parent_record is not null and parent_known_id is null group by 1"""
SQL["j9_reread"] = f"""with {EVENTS}, {cte('rec_companies')}
select e.event_id, e.record_id, case when r.record_id is not null then 'current' when e.fields is not null then 'payload' else 'record_not_found' end as origin,
case when r.record_id is not null then r.company_name else e.fields ->> '$.company_name' end as company_name
from ev e left join rec_companies r on r.record_id = e.record_id where e.entity = 'company'"""


# --- change sync: outcomes -----------------------------------------------------------------------
NEW = "substr(sha256(p_external_source_id), 1, 32)"
LINE_EVENTS = """xl as (select event_id, record_id, fields ->> '$.product_name' as product_name,
  'D-' || substr(record_id, 5) as deal_id, list_value()::varchar[] as Deal from ev where entity = 'line_item')"""
STATE = f"""{cte('rec_companies')}, {cte('rec_contacts')}, {cte('rec_deals')}, {cte('rec_lines')},
{cte('target_companies', RECORD_IDS)}, {cte('target_deals', RECORD_IDS)}, {tiers('companies', 'rec_companies', 'domain')},
run_c as (select record_id, coalesce(existing_id, {NEW}) as run_id from t_companies),
{M['rec_contacts']}, {M['rec_deals']}, {M['rec_lines']},
byx_deals as (select external_source_id as k, min(id) as id from target_deals group by 1),
run_d as (select m.record_id, coalesce(a.id, b.id, {NEW}) as run_id from m_rec_deals m
  left join target_deals a on a.id = nullif(m.hubspot_record_id, '') left join byx_deals b on b.k = m.p_external_source_id
  where m.error is null),
{parent('m_rec_contacts', 'rec_companies', 'Company', 'company_id', '_c', False)},
{parent('m_rec_deals', 'rec_companies', 'Company', 'company_id', '_d', False)},
{parent('m_rec_lines', 'rec_deals', 'Deal', 'deal_id', '_l', False)},
st as (
select 'company' as entity, record_id, case when concat(company_id, company_name, domain, industry, number_of_employees) = '' then 'skipped'
  when error is not null then 'failed' else 'synced' end as status, case when company_id <> '' and error is not null then 'VALIDATION_ERROR' end as code,
  null as parent_id from m_rec_companies
union all select 'contact', p.record_id, case when error is null then 'synced' else 'failed' end, case when error is not null then 'VALIDATION_ERROR' end,
  case when error is null then coalesce(parent_known_id, r.run_id) end from par_c p left join run_c r on r.record_id = p.parent_record
union all select 'deal', p.record_id, case when error is null then 'synced' else 'failed' end, case when error is not null then 'VALIDATION_ERROR' end,
  case when error is null then coalesce(parent_known_id, r.run_id) end from par_d p left join run_c r on r.record_id = p.parent_record
union all select 'line_item', p.record_id, case when error is null and coalesce(parent_known_id, r.run_id) is not null then 'synced' else 'failed' end,
  case when error is not null then 'VALIDATION_ERROR' when coalesce(parent_known_id, r.run_id) is null then 'MISSING_REFERENCE' end,
  case when error is null then coalesce(parent_known_id, r.run_id) end from par_l p left join run_d r on r.record_id = p.parent_record)"""
OUTCOMES = f"""with {EVENTS}, {STATE}, {LINE_EVENTS}, {parent('xl', 'rec_deals', 'Deal', 'deal_id', '_x', False)},
xo as (select event_id, coalesce(parent_known_id, r.run_id) as parent_id from par_x p left join run_d r on r.record_id = p.parent_record),
outc as (select e.event_id, e.entity, e.record_id,
  case when e.error_code is not null then 'failed' when s.status is not null then s.status
    when e.entity = 'line_item' then case when x.parent_id is not null then 'synced' else 'failed' end
    when e.fields is null then 'skipped' end as status,
  coalesce(e.error_code, s.code, case when e.entity = 'line_item' and x.parent_id is null then 'MISSING_REFERENCE' end) as code,
  coalesce(s.parent_id, x.parent_id) as parent_id
from ev e left join st s on s.entity = e.entity and s.record_id = e.record_id left join xo x on x.event_id = e.event_id)"""
SQL["e2_event_sync"] = OUTCOMES + " select * from outc"
SQL["a4_rescan_summary"] = OUTCOMES + """ select count(*) as scanned, count(*) filter (status = 'synced') as synced,
count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'failed') as failed from outc"""
SQL["a9_signals"] = OUTCOMES + """ select entity, count(*) as events, count(*) filter (code <> 'VALIDATION_ERROR') as faults,
count(*) filter (code = 'VALIDATION_ERROR') as bad_data,
count(*) filter (status = 'synced' and entity <> 'company' and parent_id is null) as unresolved_parents from outc group by 1"""
SQL["e3_rescan"] = f"with {STATE} select entity, status, code, count(*) as n, count(parent_id) as with_parent from st group by 1, 2, 3"
SQL["e6_permanent"] = OUTCOMES + """ select entity, code, count(*) as n from outc
where status = 'failed' and code in ('VALIDATION_ERROR', 'MISSING_REFERENCE') group by 1, 2"""
SQL["a9_attempts"] = "select event_type, count(*) as attempts, count(*) filter (event_id % 7 = 0) as throttled, " + ", ".join(
    f"round(quantile_cont(cast(floor(value * 100) as bigint), {p / 100}), 4) as p{p}" for p in (50, 95, 99)) + " from events group by 1"


# --- change sync: what each event was matched with, and which edges a run writes --------------------
CONTACT_TIERS = tiers("contacts", "rec_contacts", "email")
CONTACT_TIERS = CONTACT_TIERS[CONTACT_TIERS.index("byx_contacts as"):]  # the mapped records are there already


def resolved(entity, t, table, natural):
    """CTE res_<type>: target id, action and match of each record of a run; the first new one of a natural key creates it."""
    return f"""o_{t} as (select t.*, b.seq, first_value(p_external_source_id) over (
    partition by existing_id is null, p_{natural} order by b.seq, t.record_id) as lead from t_{t} t join run_{entity} b using (record_id)),
res_{t} as (select '{entity}' as entity, record_id,
  coalesce(existing_id, substr(sha256(case when p_{natural} is null then p_external_source_id else lead end), 1, 32)) as target_id,
  case when existing_id is null and (p_{natural} is null or lead = p_external_source_id) then 'created' else 'updated' end as action,
  case when existing_id is null and p_{natural} is not null and lead <> p_external_source_id then 'natural_key' else matched_by end as matched_by
from o_{t})"""


MATCHES = OUTCOMES + f""", {cte('target_contacts', RECORD_IDS)}, {CONTACT_TIERS},
asked as (select entity, record_id, min(event_id) as seq from ev where error_code is null group by 1, 2),
pull_d as (select distinct parent_record as record_id from par_x where parent_record is not null and parent_known_id is null),
run_deal as (select record_id, seq from asked where entity = 'deal' union all
  select record_id, -1 from pull_d where record_id not in (select record_id from asked where entity = 'deal')),
live_d as (select p.* from par_d p join run_deal using (record_id) where error is null),
run_contact as (select record_id, seq from asked where entity = 'contact'),
live_c as (select p.* from par_c p join run_contact using (record_id) where error is null),
pull_c as (select parent_record as record_id from live_c where parent_known_id is null and parent_record is not null
  union select parent_record from live_d where parent_known_id is null and parent_record is not null),
run_company as (select record_id, seq from asked where entity = 'company' union all
  select record_id, -1 from pull_c where record_id not in (select record_id from asked where entity = 'company')),
{resolved('company', 'companies', 'rec_companies', 'domain')}, {resolved('contact', 'contacts', 'rec_contacts', 'email')},
res_deals as (select 'deal' as entity, d.record_id, coalesce(a.id, b.id, {NEW}) as target_id,
  case when coalesce(a.id, b.id) is null then 'created' else 'updated' end as action,
  case when a.id is not null then 'hubspot_record_id' when b.id is not null then 'external_source_id' end as matched_by
  from live_d d left join target_deals a on a.id = nullif(d.hubspot_record_id, '') left join byx_deals b on b.k = d.p_external_source_id),
res_lines as (select distinct 'line_item' as entity, record_id, substr(sha256('airtable:line_items:' || record_id), 1, 32) as target_id,
  'created' as action, cast(null as varchar) as matched_by from outc where entity = 'line_item' and status = 'synced'),
res as (select * from res_companies union all select * from res_contacts union all select * from res_deals union all select * from res_lines)"""
SQL["e2_event_matches"] = MATCHES + """ select o.event_id, r.target_id, r.action, r.matched_by
from outc o join res r on r.entity = o.entity and r.record_id = o.record_id where o.status = 'synced'"""
SQL["e2_event_edges"] = MATCHES + """, company_ids as (select record_id, target_id from res_companies)
select distinct 'contacts' as from_type, r.target_id as from_id, 'companies' as to_type, coalesce(parent_known_id, i.target_id) as to_id
from live_c join res_contacts r using (record_id) left join company_ids i on i.record_id = parent_record
where coalesce(parent_known_id, i.target_id) is not null
union select 'deals', r.target_id, 'companies', coalesce(parent_known_id, i.target_id)
from live_d join res_deals r using (record_id) left join company_ids i on i.record_id = parent_record
where coalesce(parent_known_id, i.target_id) is not null
union select 'line_items', r.target_id, 'deals', coalesce(parent_known_id, d.target_id)
from par_x x join res_lines r using (record_id) left join res_deals d on d.record_id = x.parent_record
where coalesce(parent_known_id, d.target_id) is not null"""


# --- merges of the other types, ids until one is free ------------------------------------------------
def merge_sql(t, table, natural):
    key = f"p_{natural}" if natural else "cast(null as varchar)"
    by_natural = (f", byn as (select {natural} as k, min(id) as id from target_{t} where {natural} is not null group by 1)"
                  if natural else ", byn as (select cast(null as varchar) as k, cast(null as varchar) as id)")
    names = [*C.PROPERTIES[C.OBJECT_TYPES[["companies", "contacts", "deals", "lines"].index(t)]], *C.STAMPS]
    return f"""with {cte(table)}, {cte('target_' + t, RECORD_IDS)}, {M[table]},
byx as (select external_source_id as k, min(id) as id from target_{t} where external_source_id is not null group by 1){by_natural},
found as (select m.*, {key} as nk, coalesce(a.id, b.id, c.id) as existing_id from m_{table} m
  left join target_{t} a on a.id = nullif(m.hubspot_record_id, '') left join byx b on b.k = m.p_external_source_id
  left join byn c on c.k = {key} where m.error is null),
led as (select *, first_value(p_external_source_id) over (partition by existing_id is null, nk order by last_modified, record_id) as lead from found),
named as (select *, coalesce(existing_id, substr(sha256(case when nk is null then p_external_source_id else lead end), 1, 32)) as target_id from led),
folded as (select target_id as id, {", ".join(f"arg_max(p_{p}, (last_modified, record_id)) filter (p_{p} is not null) as {p}" for p in names)}
  from named group by 1)
select coalesce(n.id, o.id) as id, {", ".join(f"coalesce(n.{p}, o.{p}) as {p}" for p in names)},
  case when n.id is null then null when o.id is null then 'created' else 'updated' end as action
from target_{t} o full join folded n on o.id = n.id"""


SQL["m1_merge_contacts"] = merge_sql("contacts", "rec_contacts", "email")
SQL["m1_merge_deals"] = merge_sql("deals", "rec_deals", None)
SQL["m1_merge_lines"] = merge_sql("lines", "rec_lines", None)
SQL["k1_taken_ids"] = """select 'recC' || c_custkey as record_id, substr(sha256('airtable:companies:recC' || c_custkey ||
  case when c_custkey % 16 = 0 then '@b#3' when c_custkey % 8 = 0 then '@b#2' when c_custkey % 4 = 0 then '@b' else '' end), 1, 32) as target_id,
  'created' as action from customer"""
SQL["s1_csv_split"] = SQL["s1_csv_round_trip"]
SQL["l1_pages"] = f"""with {cte('rec_deals')} select cast(floor((row_number() over (order by last_modified, record_id) - 1) / 4000) as int) as page,
record_id from rec_deals where last_modified > timestamp '1999-06-01'"""
SQL["a9_percentiles"] = "select case when event_id % 3 = 0 then 'hot' else event_type end as event_type, count(*) as attempts, " \
    "count(*) filter (event_id % 7 = 0) as throttled, " + ", ".join(
        f"round(quantile_cont(value * 100, {p / 100}), 6) as p{p}" for p in (50, 95, 99)) + " from events group by 1"

# --- two deliveries: what each micro-batch has to do --------------------------------------------------
DELIVERED = OUTCOMES + """, keyed as (select *, case when event_id % 10 = 0 then null when event_id % 10 < 3 then 'ev-' || event_id
  else cast(event_id as varchar) end as event_key from outc),
came as (select 0 as batch_id, * from keyed where event_id % 4 < 3 union all select 1, * from keyed where event_id % 4 > 1),
copies as (select * from came union all select * from came where event_id % 8 = 1),
done as (select * from copies where event_key is null
  union all select distinct * from copies where event_key is not null and (batch_id = 0 or event_id % 4 = 3))"""
SQL["e4_replay"] = DELIVERED + """ select coalesce(event_key, '') as event_key, entity, record_id, status, code, count(*) as n
from done group by 1, 2, 3, 4, 5"""
SQL["a4_observed"] = DELIVERED + """ select batch_id, count(*) as scanned, count(*) filter (status = 'synced') as synced,
count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'failed') as failed from done group by 1"""
SQL["a9_trace"] = DELIVERED + """ select 'run 1' as scope, record_id, status, count(*) as n from done where batch_id = 1 group by 2, 3
union all select 'deals', record_id, status, count(*) from done where entity = 'deal' group by 2, 3
union all select 'run 0, contacts', record_id, status, count(*) from done where entity = 'contact' and batch_id = 0 group by 2, 3"""
SQL["e6_backlog"] = f"""with {cte('rec_companies')}, {M['rec_companies']},
s as (select record_id, concat(company_id, company_name, domain, industry, number_of_employees) = '' as blank, error is not null as bad,
  coalesce(length(p_name) > 20, false) or coalesce(p_industry = 'FURNITURE', false) as refused from m_rec_companies)
select record_id, 0 as batch_id, case when blank then 'skipped' when bad or refused then 'failed' else 'synced' end as status,
  case when blank then null when bad then 'VALIDATION_ERROR' when refused then 'TARGET_REFUSED' end as code, 1 as attempts from s
union all select record_id, 1, 'synced', null, 2 from s where not blank and not bad and refused"""
