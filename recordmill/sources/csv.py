"""CSV exports: header row, quotes, every value text and trimmed."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.functions.text import BLANKS, filled, trim_blanks
from recordmill.plans.pins import pin


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def _whole(value: Column) -> Column:
    """The value; an error where an open quote shows that a line break tore its row."""
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    return F.when(quotes % 2 == 1, F.raise_error(F.lit(
        "CSV row with an open quote: read the file with split=False"))).otherwise(value)


def read_csv(spark: SparkSession, path: str, split: bool = False, ordinal: str | None = None) -> DataFrame:
    """All columns as trimmed text, an empty one as null; header names without BOM and blanks.

    Quoted values may hold line breaks. Such a file is one task's work here; ``read_csv_by_records`` deals
    large ones out. ``split=True`` splits files, for exports without line breaks in
    values: it fails on a row with another number of columns or an open quote. ``ordinal`` names a
    column to add that orders rows as they stand in the files, by path.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"CSV file not found: {path}")
    raw = (
        spark.read.option("header", True).option("escape", '"').option("inferSchema", False)
        .option("multiLine", not split).option("columnPruning", False)
        .option("mode", "FAILFAST" if split else "PERMISSIVE").csv(path)
    )
    values = [F.col(f"`{name}`") for name in raw.columns]
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return raw.select(*[
        filled(trim_blanks(_whole(value) if split else value)).alias(name.strip(BLANKS))
        for name, value in zip(raw.columns, values, strict=True)
    ], *([place.alias(ordinal)] if ordinal else []))


def read_csv_by_records(spark: SparkSession, path: str, ordinal: str | None = None) -> DataFrame:
    """As ``read_csv``, with line breaks in values, of files that are split among tasks.

    Files are read as lines in byte ranges. A line begins a record if the number of quotes before it is even: counted
    within its range, plus the parity at which the range begins, a sum over the ranges before it. Lines between two
    beginnings are one record, wherever ranges end. Expects quotes only around values and doubled inside them;
    a file that ends within a quote is an error, named. Line breaks are LF or CR LF.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"CSV file not found: {path}")
    options = {"escape": '"', "multiLine": "true"}
    names = spark.read.options(header=True, inferSchema=False, **options).csv(path).columns  # reads one record
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("row"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    here = W.partitionBy("file", "range").orderBy("row")
    so_far = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = lines.withColumn("before", (F.sum("quotes").over(so_far) - F.col("quotes")) % 2)
    marked = pin(counted.select(
        "file", "range", "row", "value", "before", (F.col("quotes") % 2).alias("odd"),
        F.lead("before").over(here).alias("next"),  # two counts: whether a range begins in a quote is not known yet
        *[F.count_if(F.col("before") == k).over(so_far).alias(f"record{k}") for k in (0, 1)]))

    past = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    ranges = marked.groupBy("file", "range").agg(
        (F.sum("odd") % 2).alias("odd"), *[F.max(f"record{k}").alias(f"records{k}") for k in (0, 1)])
    ranges = ranges.withColumn("enters", F.coalesce(F.sum("odd").over(past), F.lit(0)) % 2)
    begun = F.when(F.col("enters") == 0, F.col("records0")).otherwise(F.col("records1"))
    ranges = pin(ranges.select(
        F.col("file").alias("_file"), F.col("range").alias("_range"), "enters", ((F.col("enters") + F.col("odd")) % 2).alias("leaves"),
        F.last(F.when(begun > 0, F.struct("range", begun.alias("record"))), ignorenulls=True).over(past).alias("open")))
    torn = ranges.groupBy("_file").agg(F.max_by("leaves", "_range").alias("leaves")).where("leaves = 1").limit(3).collect()
    if torn:
        raise ValueError(f"CSV file ends within a quote: {[r['_file'] for r in torn]}")

    placed = marked.join(ranges, (F.col("file") == F.col("_file")) & (F.col("range") == F.col("_range")))
    record = F.when(F.col("enters") == 0, F.col("record0")).otherwise(F.col("record1"))
    own = F.struct("range", record.alias("record"))
    placed = placed.select(
        "file", F.when(record > 0, own).otherwise(F.col("open")).alias("at"), "range", "row", "value",
        ((F.col("before") == F.col("enters"))
         & F.coalesce(F.col("next") == F.col("enters"), F.col("leaves") == 0)).alias("whole"))
    several = placed.where("not whole").groupBy("file", "at").agg(
        F.sort_array(F.collect_list(F.struct("range", "row", "value"))).alias("parts")).select(
        "file", "at", F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("value"))
    records = placed.where("whole").select("file", "at", "value").unionByName(several).where(
        ~((F.col("at.range") == 0) & (F.col("at.record") == 1))).withColumn("value", F.regexp_replace("value", "\r$", ""))
    schema = ", ".join(f"_{k} string" for k in range(len(names)))
    parsed = records.where("value <> ''").select("file", "at", F.from_csv("value", schema, options).alias("v"))
    return parsed.select(*[
        filled(trim_blanks(F.col(f"v._{k}"))).alias(name.strip(BLANKS)) for k, name in enumerate(names)
    ], *([F.struct("file", "at").alias(ordinal)] if ordinal else []))
