"""Record tables: what changed since, oldest first."""

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from recordmill import contract as C
from recordmill.operators.batches import numbered_batches
from recordmill.plans.pins import pin


def changed_after(table: DataFrame, since: str, after: Row | None = None) -> DataFrame:
    """Records modified strictly after ``since``, and behind the record ``after``, in any order."""
    kind = dict(table.dtypes)[C.MODIFIED]
    changed = F.col(C.MODIFIED)
    found = table.where(changed > F.lit(since).cast(kind))
    if after is not None:
        last = F.lit(after[C.MODIFIED]).cast(kind)
        found = found.where((changed >= last) & ((changed > last) | (F.col("record_id") > after["record_id"])))
    return found


def modified_since(table: DataFrame, since: str, limit: int | None = None, after: Row | None = None) -> DataFrame:
    """Records modified strictly after ``since`` (a timestamp text, UTC), oldest first.

    All of them, unless a caller sets a limit. ``after`` goes on behind the record where the last call ended:
    its modification time and record id (see ``cursor``). The filter reaches the files.
    """
    found = changed_after(table, since, after).orderBy(C.MODIFIED, "record_id")
    return found if limit is None else found.limit(limit)


def cursor(page: DataFrame) -> Row | None:
    """Where a page ends: the largest modification time and, of equal ones, record id. None if it has no row."""
    last = page.agg(F.max(F.struct(C.MODIFIED, "record_id")).alias("last")).first()
    return last["last"]


@dataclass
class Pages(Iterator[DataFrame]):
    """A scan in pages: ``rows`` are all its records with their ``page`` (from 0); iterating gives one page after another."""

    rows: DataFrame
    turn: int = 0
    pages: int | None = None

    def __next__(self) -> DataFrame:
        if self.pages is None:
            last = self.rows.agg(F.max("page").alias("page")).first()["page"]
            self.pages = 0 if last is None else last + 1
        if self.turn == self.pages:
            raise StopIteration
        page = self.rows.where(F.col("page") == self.turn).drop("page").orderBy(C.MODIFIED, "record_id")
        self.turn += 1
        return page


def scan_pages(table: DataFrame, since: str, size: int, after: Row | None = None) -> Pages:
    """The records after ``since`` in pages of ``size``; records of one time may lie on two pages.

    The table is read and sorted once, whatever the number of pages, and written in that order with the page of each
    record, so that reading one page skips most of the others. A scan that broke off goes on with ``after`` from its last page's ``cursor``.
    """
    if size <= 0:
        raise ValueError("a page holds at least one record")
    order = F.struct(C.MODIFIED, "record_id")
    found = changed_after(table, since, after).withColumn("_order", order)
    numbered = numbered_batches(found, "_order", size).withColumn("page", F.col("batch_no").cast("int"))
    return Pages(pin(numbered.drop("_order", "ordinal", "batch_no")))
