"""A topic's subscriber: time-outs, acknowledgement and redelivery.

Messages reach a handler micro-batch by micro-batch (``foreachBatch``). The
checkpoint's commit of a batch is its acknowledgement: a batch whose handler
fails is not committed and is delivered again, with the same id and the same
messages, up to ``redeliver`` times; then the subscription fails, and a later
one on the same checkpoint begins with that batch. Handlers write by batch id
(:func:`linkflow.sources.sinks.write_batch`), so a second delivery replaces what
the first one may have written.

A subscription ends when no message has come for ``idle`` seconds, after
``listen`` seconds in all, or (``available_now``) at the end of what is there.
A batch under way is finished and acknowledged first.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkflow.sources.sinks import write_batch

TOPIC_SCHEMA = "request_id BIGINT, value BINARY"
POLL = 0.2


@dataclass
class Delivery:
    """What a subscription did: deliveries and acknowledgements by batch id."""
    delivered: list[int] = field(default_factory=list)
    acknowledged: list[int] = field(default_factory=list)
    ended: str = ""            # "idle", "listen" or "end"

    @property
    def redelivered(self) -> list[int]:
        return sorted({b for b in self.delivered if self.delivered.count(b) > 1})


def receive(spark: SparkSession, topic_path: str, handler: Callable[[DataFrame, int], None], checkpoint: str, *,
            idle: float | None = None, listen: float | None = None, available_now: bool = False,
            redeliver: int = 1, interval: str = "1 second") -> Delivery:
    """Hands the topic's messages ``(request_id, value)`` to ``handler`` until
    a time-out or the end; raises the handler's error when redelivery failed too."""
    if not available_now and idle is None and listen is None:
        raise ValueError("a subscription needs a time-out: idle, listen or available_now")
    out, began, heard = Delivery(), time.monotonic(), time.monotonic()

    def handle(batch: DataFrame, batch_id: int) -> None:
        nonlocal heard
        out.delivered.append(batch_id)
        heard = time.monotonic()
        handler(batch, batch_id)
        heard = time.monotonic()
        out.acknowledged.append(batch_id)

    def start():
        messages = spark.readStream.schema(TOPIC_SCHEMA).parquet(topic_path)
        writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
        return writer.start()

    failures: dict[int, int] = {}
    query = start()
    while not out.ended:
        try:
            if query.awaitTermination(POLL):
                out.ended = "end"
            elif not query.status["isTriggerActive"]:  # no batch is under way
                now = time.monotonic()
                if idle is not None and now - heard >= idle:
                    out.ended = "idle"
                elif listen is not None and now - began >= listen:
                    out.ended = "listen"
        except StreamingQueryException:
            failed = out.delivered[-1] if len(out.delivered) > len(out.acknowledged) + sum(failures.values()) else None
            if failed is None:
                raise  # not the handler's
            failures[failed] = failures.get(failed, 0) + 1
            if failures[failed] > redeliver:
                raise
            query = start()
    query.stop()
    return out


def decoded_writer(out_path: str, dead_path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes ``(request_id, country)`` and, apart from them, the
    messages that are no UTF-8 text ``(request_id, value)``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        text = batch.select("request_id", "value", F.col("value").cast("string").alias("country"))
        good = F.col("value").isNotNull() & F.is_valid_utf8("country")
        text = text.persist()
        try:
            write_batch(text.where(good).select("request_id", "country"), out_path, batch_id)
            write_batch(text.where(~good).select("request_id", "value"), dead_path, batch_id)
        finally:
            text.unpersist()

    return write
