"""Exact duplicates by content-defined chunks, in DataFrame functions only.

A text (A-Z lower-cased) is cut where its content says so: after ``CHUNK_MIN`` characters, behind
the first word of a form that about one word in a hundred has. Each chunk is hashed; the distinct
chunks of all texts are compared as text, once, so an identifier that two different
chunks share is known. A document is then its ordered list of verified identifiers, and
documents are grouped by equal lists; their texts do not move again.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.text import ascii_lower
from recordmill.plans.pins import pin

CHUNK_MIN, CHUNK_MAX = 256, 8192
LAST_WORD = r"\s[a-c]\S[aeiou]\S*[n-s]\s"


def chunks(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """The text in pieces whose ends depend on nothing but the characters since the last end."""
    pattern = rf"(?s).{{{least},{most}}}?{LAST_WORD}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 identifier: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one.
    Of equal texts the row with the largest id stays (``kept``); among rows that also share
    the id, or have none, one stays. A null id is below all others. Other columns are
    ignored. ``identifier`` hashes a chunk to a long; whatever it is, the groups are exact.
    """
    text = ascii_lower(F.col(text_column))
    recipes = pin(
        docs.select(F.col(id_column).alias("doc_id"), text.alias("t"))
        .select(F.monotonically_increasing_id().alias("row"), "doc_id",
                F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), chunks(F.col("t")).alias("chunks"))
        .withColumn("ids", F.transform("chunks", lambda chunk: identifier(chunk)))
    )
    pieces = recipes.select("row", F.posexplode("chunks").alias("pos", "chunk")).withColumn(
        "id", identifier(F.col("chunk")))
    distinct = pieces.select("id", "chunk").distinct()
    shared = pin(distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    recipes = recipes.select("row", "doc_id", "text_sha256", "ids")
    if shared.isEmpty():
        recipes = recipes.withColumn("recipe", F.col("ids"))
    else:  # identifiers of different chunks: the chunk's rank among them becomes part of the recipe
        order = Window.partitionBy("id").orderBy("chunk")
        ranks = distinct.join(shared, "id", "left_semi").withColumn("rank", F.row_number().over(order))
        fixes = pieces.join(ranks, ["id", "chunk"]).groupBy("row").agg(
            F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"),
                                                 F.col("rank").cast("long").alias("rank")))).alias("fixes"))
        recipes = recipes.join(fixes, "row", "left").withColumn(
            "recipe", F.concat("ids", F.flatten(F.transform(
                F.coalesce("fixes", F.array().cast("array<struct<pos:bigint,rank:bigint>>")),
                lambda x: F.array(x["pos"], x["rank"])))))
        recipes = pin(recipes)
    # written first, so that the join below deals both sides anew and splits the rows of a large group
    best = pin(recipes.groupBy("recipe").agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")))
    return recipes.join(best.withColumnRenamed("recipe", "group"), F.col("recipe") == F.col("group")).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
