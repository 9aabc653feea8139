"""Streams of change events, and of doorbell messages that only say "look again"."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from recordmill import contract as C
from recordmill.functions import event_fields, is_authentic
from recordmill.plans.pins import passing_pins, pin
from recordmill.plans.sync import rescan, sync_events
from recordmill.streaming.log import SyncLog

Tables = Callable[[], dict[str, DataFrame]]
Constraints = dict[str, list[tuple[Column, str]]] | None


def sync_batch(events: DataFrame, tables: dict[str, DataFrame], log: SyncLog, batch: int, seq: str = "event_id",
               most_attempts: int | None = C.MOST_ATTEMPTS, constraints: Constraints = None) -> None:
    """One micro-batch of JSON ``body`` rows: events not seen yet, and the failures that earlier ones left open."""
    sources, target = log.state(tables, batch)
    kind = dict(events.dtypes)[seq]
    # a stream's own session plans without what it learns at run time; the log's session does
    fresh = log.unseen(pin(event_fields(events), log.spark), seq, batch).select(
        F.col(seq).alias("seq"), "entity", "record_id", "fields", "error", "error_code", F.lit(0).alias("attempts"))
    waiting = log.backlog(batch).select(
        F.col("seq").cast(kind).alias("seq"), "entity", "record_id", "fields",
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("error_code"), "attempts")
    result = sync_events(fresh.unionByName(waiting), sources, target, batch=str(batch), constraints=constraints)
    log.append(batch, result, most_attempts)


def event_stream(bodies: DataFrame, tables: Tables, log: SyncLog, checkpoint: str, seq: str = "event_id",
                 compact_every: int = 50, most_attempts: int | None = C.MOST_ATTEMPTS,
                 constraints: Constraints = None) -> DataStreamWriter:
    """Sync of a stream of JSON ``body`` rows; ``tables`` gives the record tables as they are now.

    The record is always read again, so late, repeated and reordered events end
    in its current state; no watermark is needed. An event that an earlier batch brought to an end is left out when it
    comes again. Failures that a retry may mend are tried again with each batch, up to ``most_attempts`` times.
    """
    def apply(events: DataFrame, batch: int) -> None:
        with passing_pins(log.spark):
            if batch and batch % compact_every == 0:
                log.compact(batch)
            sync_batch(events, tables(), log, batch, seq, most_attempts, constraints)

    return bodies.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def doorbell_stream(
    messages: DataFrame, secret_base64: str, tables: Tables, log: SyncLog, checkpoint: str,
    lookback_minutes: int = C.LOOKBACK_MINUTES, limit: int | None = None, compact_every: int = 50,
    most_attempts: int | None = C.MOST_ATTEMPTS, constraints: Constraints = None,
) -> DataStreamWriter:
    """Rescans when an authentic message arrives: ``(body, header, received)``.

    A message names no records. Everything modified within the lookback before
    the last message of the micro-batch is synced; a window longer than the
    trigger interval covers a missed message. Failed records that a retry may mend are tried again, in the window or not.
    """
    def apply(batch_messages: DataFrame, batch: int) -> None:
        genuine = batch_messages.where(is_authentic(F.col("body"), F.col("header"), secret_base64))
        since = genuine.agg(
            F.date_format(F.max("received") - F.make_dt_interval(mins=F.lit(lookback_minutes)),
                          "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("since")
        ).first()["since"]
        if since is None:
            return
        with passing_pins(log.spark):
            if batch and batch % compact_every == 0:
                log.compact(batch)
            sources, target = log.state(tables(), batch)
            result = rescan(sources, target, since, limit, log.backlog(batch), batch=str(batch), constraints=constraints)
            log.append(batch, result, most_attempts)

    return messages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
