"""What a streaming sync has written so far, in files by key: a batch reads only the buckets of its keys.

Each table is a folder of segments, one per micro-batch, dealt into a fixed number of buckets by the hash
of its key. Target records lie by id; two small indexes lead there from external ids and natural keys.
``compact`` writes the latest row of each key as one segment, which later batches read in place of all
segments before it.

A micro-batch reads only what earlier batches wrote and overwrites its own segments, so running it again, as
``foreachBatch`` may, gives the same state. Touched records are appended as they are after the batch.
"""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill import contract as C
from recordmill.operators.edges import EDGE
from recordmill.operators.lookup import relevant
from recordmill.operators.merge import apply_write_backs, target_columns
from recordmill.operators.report import observed_tally
from recordmill.plans.pins import pin
from recordmill.plans.sync import SyncResult

BASE = -1  # batch number of the state a stream starts from
OUTCOME_BUCKETS = 8
OPEN = "seq string, entity string, record_id string, fields string, attempts int"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def key_columns() -> dict[str, tuple[str, list[str]]]:
    """Of each keyed table its key, and its columns; a row replaces older ones of the same key (edges and seen: itself)."""
    tables: dict[str, tuple[str, list[str]]] = {"edges": ("from_id", EDGE), "seen": ("event_id", ["event_id"])}
    for entity, object_type in C.OBJECT_TYPE_OF.items():
        tables[f"targets/{object_type}"] = ("id", target_columns(object_type))
        tables[f"by_external/{object_type}"] = (C.EXTERNAL_ID, [C.EXTERNAL_ID, "id"])
        if natural := C.NATURAL_KEY[object_type]:
            tables[f"by_natural/{object_type}"] = (natural, [natural, "id"])
        tables[f"write_backs/{entity}"] = ("record_id", ["record_id", "target_id"])
    return tables


def latest_by(name: str, key: str) -> list[str] | None:
    """Columns of which the table keeps the latest row; None where all different rows stay."""
    return [key] if name.split("/")[0] in ("targets", "write_backs") else None


def together(jobs: list[Callable[[], None]]) -> None:
    """Runs independent writes side by side: most of them are far too small to fill a cluster."""
    with ThreadPoolExecutor(8) as pool:
        for done in [pool.submit(copy_context().run, job) for job in jobs]:
            done.result()


@dataclass
class SyncLog:
    """``buckets`` is fixed when a log is started."""

    spark: SparkSession
    folder: str
    buckets: int = 64

    # --- files -----------------------------------------------------------------------

    def _file_system(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        """Paths that exist, below the folder; ``pattern`` may hold wildcards."""
        path, files = self._file_system()
        return [str(f.getPath()) for f in files.globStatus(path(f"{self.folder}/{pattern}")) or []]

    def _numbers(self, pattern: str) -> list[int]:
        return sorted(int(name.rsplit("=", 1)[1]) for name in self._names(pattern))

    def compacted(self, before: int | None = None) -> int | None:
        """The last batch that a finished compaction holds, of those under ``before``."""
        done = [n for n in self._numbers("compacted/upto=*") if before is None or n < before]
        return done[-1] if done else None

    def _segments(self, name: str, before: int | None) -> list[str]:
        base = self.compacted(before)
        batches = [b for b in self._numbers(f"{name}/batch_id=*")
                   if (before is None or b < before) and (base is None or b > base)]
        return ([f"{name}/base={base}"] if base is not None else []) + [f"{name}/batch_id={b}" for b in batches]

    def _write(self, name: str, segment: str, rows: DataFrame) -> None:
        key = key_columns()[name][0]
        rows.withColumn("bucket", bucket_of(F.col(key), self.buckets)).hint("rebalance", F.col("bucket")).write.mode(
            "overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/{segment}")

    def _append(self, name: str, batch: int, rows: DataFrame) -> None:
        columns = key_columns()[name][1]
        self._write(name, f"batch_id={batch}", rows.select(
            *[F.col(c).cast("string").alias(c) for c in columns], F.lit(batch).cast("bigint").alias("written")))

    def read(self, name: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Rows of a keyed table by batches under ``before``, with the batch as ``written``; all versions of a key.

        With ``keys`` (one column) only the files of their buckets, of which there are ``buckets`` at most.
        """
        columns = key_columns()[name][1]
        schema = ", ".join(f"{c} string" for c in columns) + ", written bigint"
        choice = "*"
        if keys is not None:
            asked = keys.toDF("k").where("k is not null").select(bucket_of(F.col("k"), self.buckets).alias("b")).distinct()
            choice = "{" + ",".join(str(r.b) for r in asked.collect()) + "}"
        paths = [] if choice == "{}" else [
            p for segment in self._segments(name, before) for p in self._names(f"{segment}/bucket={choice}")]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def find(self, name: str, before: int | None, keys: DataFrame) -> DataFrame:
        """The rows of some keys."""
        return relevant(self.read(name, before, keys), key_columns()[name][0], keys)

    def latest(self, name: str, rows: DataFrame) -> DataFrame:
        """The newest of each key's rows, or all different ones, by the table's rule."""
        key, columns = key_columns()[name]
        if latest_by(name, key) is None:
            return rows.groupBy(*columns).agg(F.max("written").alias("written"))
        rest = [c for c in columns if c != key]
        return rows.groupBy(key).agg(
            F.max_by(F.struct(*rest), "written").alias("_row"), F.max("written").alias("written")
        ).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest], "written").select(*columns, "written")

    # --- state -----------------------------------------------------------------------

    def start_from(self, targets: dict[str, DataFrame]) -> "SyncLog":
        """Writes the initial snapshots; call once for a new folder."""
        path, files = self._file_system()
        files.mkdirs(path(f"{self.folder}/buckets={self.buckets}"))
        together([job for t in C.OBJECT_TYPES for job in self._target_writes(t, BASE, targets[t])])
        return self

    def _check(self) -> None:
        if (made := self._numbers("buckets=*")) != [self.buckets]:
            raise ValueError(f"the log has {made} buckets, not {self.buckets}")

    def _target_writes(self, object_type: str, batch: int, rows: DataFrame) -> list[Callable[[], None]]:
        parts = {f"targets/{object_type}": rows}
        for name, column in (("by_external", C.EXTERNAL_ID), ("by_natural", C.NATURAL_KEY[object_type])):
            if column:
                parts[f"{name}/{object_type}"] = rows.where(F.col(column).isNotNull())
        return [lambda name=name, part=part: self._append(name, batch, part) for name, part in parts.items()]

    def target(self, object_type: str, before: int | None = None) -> DataFrame:
        """The target as it stands."""
        name = f"targets/{object_type}"
        return self.latest(name, self.read(name, before)).drop("written")

    def near(self, object_type: str, rows: DataFrame, before: int | None = None) -> DataFrame:
        """The part of the target that some row could match, found through the indexes."""
        ids = rows.select(F.col("known_id").alias("id"))
        for name, column in (("by_external", "external_id"), ("by_natural", "natural_key")):
            if name == "by_external" or C.NATURAL_KEY[object_type]:
                ids = ids.union(self.find(f"{name}/{object_type}", before, rows.select(column)).select("id"))
        ids = pin(ids.where(F.col("id").isNotNull()).distinct())
        name = f"targets/{object_type}"
        return self.latest(name, self.find(name, before, ids)).drop("written")

    def taken(self, object_type: str, ids: DataFrame, before: int | None = None) -> DataFrame:
        """Those of the ids that some record of the target has."""
        return self.find(f"targets/{object_type}", before, ids).select("id").distinct()

    def source(self, entity: str, table: DataFrame, before: int | None = None) -> DataFrame:
        """A record table with all ids written back so far."""
        name = f"write_backs/{entity}"
        return apply_write_backs(table, self.latest(name, self.read(name, before)).drop("written"))

    def edges(self) -> DataFrame:
        return self.read("edges").select(*EDGE).distinct()

    # --- outcomes ----------------------------------------------------------------------

    def outcomes(self) -> DataFrame:
        """All outcomes; ``batch_id``, ``entity`` and ``bucket`` are folders."""
        return self.spark.read.option("basePath", f"{self.folder}/outcomes").parquet(f"{self.folder}/outcomes")

    def trace(self, record_id: str | None = None, run: int | None = None, entity: str | None = None,
              action: str | None = None) -> DataFrame:
        """Outcomes of a record, of a run, or of an action and type; each of them opens only the folders it needs."""
        rows = self.outcomes()
        if record_id is not None:
            rows = rows.where((F.col("bucket") == bucket_of(F.lit(record_id), OUTCOME_BUCKETS)) & (F.col("record_id") == record_id))
        for column, value in (("batch_id", run), ("entity", entity), ("action", action)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        return rows

    def summaries(self) -> DataFrame:
        """Scanned, synced, skipped and failed per batch, as observed while its outcomes were written."""
        return self.spark.read.parquet(f"{self.folder}/summaries")

    # --- events: seen ones, and failures to try again --------------------------------------

    def unseen(self, events: DataFrame, seq: str, before: int) -> DataFrame:
        """Events whose id no earlier batch has brought to an end; those without an id are all there."""
        keys = events.select(F.col(seq).cast("string").alias("event_id"))
        seen = pin(self.find("seen", before, keys).select("event_id").distinct())
        return events.join(seen, events[seq].cast("string") == seen["event_id"], "left_anti")

    def backlog(self, before: int) -> DataFrame:
        """Failures open after the last batch under ``before``: ``(seq, entity, record_id, fields, attempts)``."""
        batches = [b for b in self._numbers("backlog/batch_id=*") if b < before]
        schema = self.spark.read.schema(OPEN)
        return schema.parquet(f"{self.folder}/backlog/batch_id={batches[-1]}") if batches else self.spark.createDataFrame([], OPEN)

    # --- writing ---------------------------------------------------------------------------

    def append(self, batch: int, result: SyncResult, most_attempts: int | None = None) -> None:
        """Adds what a batch did. Failures that a retry may mend go to the backlog until ``most_attempts``."""
        jobs: list[Callable[[], None]] = [lambda: self._append("edges", batch, result.edges)]
        touched = {t: result.merged(t, how="right").drop("action") for t in result.changes}
        together([lambda t=t: touched.update({t: pin(touched[t])}) for t in touched])
        for entity, object_type in C.OBJECT_TYPE_OF.items():
            if object_type in touched:
                jobs += self._target_writes(object_type, batch, touched[object_type])
                jobs.append(lambda e=entity, t=object_type: self._append(f"write_backs/{e}", batch, result.write_backs(t)))
        together(jobs)
        outcomes = pin(result.outcomes)
        shown = outcomes.withColumn("seq", F.col("seq").cast("string"))  # ids of events are of any type
        if result.events is None:
            shown = shown.withColumns({"event_no": F.lit(None).cast("bigint"), "attempts": F.lit(None).cast("int")})
        kept, observation = observed_tally(shown.withColumn("bucket", bucket_of(F.col("record_id"), OUTCOME_BUCKETS)))
        kept.hint("rebalance", F.col("entity"), F.col("bucket")).write.mode("overwrite").partitionBy("entity", "bucket").parquet(
            f"{self.folder}/outcomes/batch_id={batch}")
        self.spark.createDataFrame([tuple(observation.get.values())], ", ".join(f"{k} bigint" for k in observation.get)).coalesce(
            1).write.mode("overwrite").parquet(f"{self.folder}/summaries/batch_id={batch}")
        again = (F.col("status") == C.FAILED) & ~F.col("permanent")
        if result.events is None:  # a rescan: its records are read again, whatever it was that failed
            before = self.backlog(batch).groupBy("entity", "record_id").agg(F.max("attempts").alias("before"))
            left = outcomes.where(again).select("entity", "record_id").distinct().join(before, ["entity", "record_id"], "left").select(
                F.lit(None).cast("string").alias("seq"), "entity", "record_id", F.lit(None).cast("string").alias("fields"),
                (F.coalesce("before", F.lit(0)) + 1).alias("attempts"))
        else:
            left = outcomes.where(again).join(result.events.select("event_no", "fields"), "event_no").select(
                F.col("seq").cast("string").alias("seq"), "entity", "record_id", "fields", F.col("attempts").cast("int").alias("attempts"))
        if most_attempts is not None:
            left = left.where(F.col("attempts") < most_attempts)
        left = pin(left)
        left.write.mode("overwrite").parquet(f"{self.folder}/backlog/batch_id={batch}")
        if result.events is not None:  # what is to be tried again is not done with
            ended = outcomes.where(F.col("seq").isNotNull()).select(F.col("seq").cast("string").alias("event_id"))
            self._append("seen", batch, ended.join(left.select(F.col("seq").alias("event_id")), "event_id", "left_anti"))

    def compact(self, before: int) -> None:
        """One segment for all batches under ``before``, which must be finished for good; a new batch may start after it.

        Files that the last compaction had replaced already go now, so readers that began before this one still find theirs.
        """
        upto, last = before - 1, self.compacted()
        if last is not None and last >= upto:
            return
        together([lambda name=name: self._write(name, f"base={upto}", self.latest(name, self.read(name, before)))
                  for name in key_columns()])
        path, files = self._file_system()
        files.mkdirs(path(f"{self.folder}/compacted/upto={upto}"))
        if last is None:
            return
        old = [f"compacted/upto={n}" for n in self._numbers("compacted/upto=*") if n < last]
        for name in key_columns():
            old += [f"{name}/batch_id={b}" for b in self._numbers(f"{name}/batch_id=*") if b <= last]
            old += [f"{name}/base={b}" for b in self._numbers(f"{name}/base=*") if b < last]
        old += [f"backlog/batch_id={b}" for b in self._numbers("backlog/batch_id=*") if b < last]
        for name in old:
            files.delete(path(f"{self.folder}/{name}"), True)

    def state(self, tables: dict[str, DataFrame], before: int) -> "tuple[dict[str, StoredRecords], StoredTarget]":
        """Record tables and target as a batch finds them."""
        self._check()
        return {e: StoredRecords(self, e, t, before) for e, t in tables.items()}, StoredTarget(self, before)


@dataclass
class StoredTarget:
    """The target of a log, read by buckets."""

    log: SyncLog
    before: int

    def near(self, object_type: str, rows: DataFrame) -> DataFrame:
        return self.log.near(object_type, rows, self.before)

    def taken(self, object_type: str, ids: DataFrame) -> DataFrame:
        return self.log.taken(object_type, ids, self.before)


@dataclass
class StoredRecords:
    """A record table with the ids written back, of which only the rows at hand are completed."""

    log: SyncLog
    entity: str
    table: DataFrame
    before: int

    def pick(self, column: str, keys: DataFrame) -> DataFrame:
        asked = keys.toDF("k").select(F.col("k").cast("string").alias("k"))
        rows = relevant(self.table.where(F.col(column).isNotNull()), column, asked)
        if column == "record_id":
            ids = asked
        else:  # the records are known once they are found
            rows = pin(rows)
            ids = rows.select("record_id")
        name = f"write_backs/{self.entity}"
        return apply_write_backs(rows, self.log.latest(name, self.log.find(name, self.before, ids)).drop("written"))
