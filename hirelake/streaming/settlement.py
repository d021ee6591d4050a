"""Payments as keyed state: each reference keeps its receipt, and notifications are answered by what it is at that time.

The state is Spark's own, so it survives restarts with the checkpoint, and notifications may come in any number of batches.
Those without a good signature are answered apart and never reach it. A receipt that nobody pays within its lifetime is
closed by a timer in event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from hirelake.functions.money import minor_units
from hirelake.plans.payments import ACCEPTED, ALREADY_PAID, BAD_AMOUNT, BAD_SIGNATURE, FAILED, NOT_FOUND, PAID

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What is kept of a reference: how many receipts have it, and of the first its amount in hundredths and its state.
STATE = "n int, id long, minor long, status string, job_id long, pack_id long"
_FIELDS = ("n", "id", "minor", "status", "job_id", "pack_id")
#: An answer. number is null where a timer has closed a receipt.
ANSWER = "reference string, number long, at timestamp, code string, reply string, receipt_id long, status string, job_id long, pack_id long"
#: What the state's operator is given: notifications, and new receipts (those with a receipt).
EVENT = "reference string, number long, at timestamp, code string, sent decimal(20,0), receipt struct<id: long, minor: long, status: string, job_id: long, pack_id: long>"


class Settlement(StatefulProcessor):
    """Receipts of one reference, and answers to its notifications in the order of at and number."""

    def __init__(self, lifetime_ms: int | None = None, grows: bool = True, fixed: bool = False):
        self.lifetime_ms, self.grows, self.fixed = lifetime_ms, grows, fixed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("receipt", STATE)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        row = initialState
        self.kept.update((row["n"], row["id"], row["minor"], row["status"], row["job_id"], row["pack_id"]))
        self.watch(row["status"], row["created_ms"])

    def found(self) -> tuple | None:
        """The state, in one call to the store: there is no need to ask first whether there is one."""
        value = self.kept.get()
        return None if value is None else tuple(value)

    def watch(self, status: str, created_ms: int | None) -> None:
        if self.lifetime_ms is not None and status == "PENDING" and created_ms is not None:
            self.handle.registerTimer(created_ms + self.lifetime_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Notifications that the receipt could accept are held, since which comes first decides between them. Where receipts
        arrive too, all of a batch wait for them."""
        kept = self.found()
        if self.fixed and kept is None:
            row = next(rows)
            kept, rows = row["start"] and tuple(row["start"][f] for f in _FIELDS), chain([row], rows)
        acceptable = []
        for row in self.receipts_first(rows) if self.grows else rows:
            if row["receipt"] is not None:
                new = row["receipt"]
                kept = (1, new["id"], new["minor"], new["status"], new["job_id"], new["pack_id"]) if kept is None else (kept[0] + 1, *kept[1:])
                self.kept.update(kept)
                self.watch(new["status"], int(row["at"].timestamp() * 1000))
            elif (reply := self.reply(kept, row)) == ACCEPTED:
                acceptable.append(row)
            else:
                yield self.answer(row, reply, kept)
        for row in sorted(acceptable, key=lambda r: (r["at"] is None, r["at"], r["number"])):
            if (reply := self.reply(kept, row)) == ACCEPTED:
                kept = (*kept[:3], "SUCCESS" if row["code"] == PAID else "FAILED", *kept[4:])
                self.kept.update(kept)
            yield self.answer(row, reply, kept)

    @staticmethod
    def receipts_first(rows: Iterator[Row]) -> Iterator[Row]:
        """A receipt and notifications of it may come in one batch."""
        later = []
        for row in rows:
            if row["receipt"] is not None:
                yield row
            else:
                later.append(row)
        yield from later

    @staticmethod
    def reply(kept: tuple | None, row: Row) -> str:
        if kept is None:
            return NOT_FOUND
        n, _, minor, status, _, _ = kept
        if n > 1 or minor is None or row["sent"] is None or status == "CANCELLED":
            return FAILED
        if int(row["sent"]) != minor:
            return BAD_AMOUNT
        return ALREADY_PAID if status == "SUCCESS" else ACCEPTED

    @staticmethod
    def answer(row: Row, reply: str, kept: tuple | None) -> Row:
        _, receipt, _, status, job, pack = kept or (None,) * 6
        return Row(reference=row["reference"], number=row["number"], at=row["at"], code=row["code"], reply=reply, receipt_id=receipt, status=status, job_id=job, pack_id=pack)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.found()
        if kept and kept[3] in ("PENDING", "FAILED"):
            kept = (*kept[:3], "CANCELLED", *kept[4:])
            self.kept.update(kept)
            yield Row(reference=key[0], number=None, at=None, code=None, reply=None, receipt_id=kept[1], status="CANCELLED", job_id=kept[4], pack_id=kept[5])

    def close(self) -> None:
        pass


def _receipt_columns(receipts: DataFrame) -> list:
    status = F.when(F.col("is_paid"), "SUCCESS").otherwise(F.col("status"))
    return [F.col("id"), minor_units(F.col("amount")).cast("long").alias("minor"), status.alias("status"), F.col("related_job_id").alias("job_id"), F.col("service_pack_id").alias("pack_id")]


def answers(notifications: DataFrame, receipts: DataFrame, new_receipts: DataFrame | None = None, lifetime_s: int | None = None, delay: str = "1 hour", fixed: bool = False) -> DataFrame:
    """The stream of answers (ANSWER) to a stream of notifications: reference, number (their own, which settles the order of
    those of one moment), at (timestamp), amount, code, and valid, whether the signature is good.

    receipts is the table to begin with: its rows make the first state, and later runs from the same checkpoint don't read
    it again. new_receipts is a stream of the same columns. An accepted payment makes its receipt paid, and a failed one
    FAILED until it is paid; a reference that several receipts have fails. With lifetime_s, a receipt that isn't paid so
    long after its created_date, by the watermark that lags by delay, is cancelled: that makes an answer without a number,
    and what comes later fails. Order counts within a batch, so batches must not overtake each other by more than callers
    allow for.

    With fixed, receipts is the same table in all runs from a checkpoint. Then each notification is joined with its receipt,
    and the state only holds receipts that a notification has changed, so those that none names cost no call to the store.
    It goes with neither new_receipts nor lifetime_s.
    """
    if fixed and (new_receipts is not None or lifetime_s is not None):
        raise ValueError("fixed receipts neither grow nor expire")
    sent = F.col("amount").try_cast("decimal(20,0)").alias("sent")
    valid = F.coalesce("valid", F.lit(False))
    none = F.lit(None).cast(StructType.fromDDL(EVENT)["receipt"].dataType).alias("receipt")
    events = notifications.where(valid).select("reference", "number", F.col("at").cast("timestamp").alias("at"), "code", sent, none)
    if new_receipts is not None:
        made = new_receipts.where("transaction_id IS NOT NULL").select(F.col("transaction_id").alias("reference"), F.lit(None).cast("long").alias("number"), F.col("created_date").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("decimal(20,0)").alias("sent"), F.struct(*_receipt_columns(new_receipts)).alias("receipt"))
        events = events.unionByName(made)
    mode = "None"
    if lifetime_s is not None:
        events, mode = events.withWatermark("at", delay), "EventTime"
    own = receipts.where("transaction_id IS NOT NULL").select(F.col("transaction_id").alias("reference"), *_receipt_columns(receipts), (F.unix_micros(F.col("created_date").cast("timestamp")) / 1000).cast("long").alias("created_ms"))
    first = own.groupBy("reference").agg(F.count("*").cast("int").alias("n"), *(F.first(c).alias(c) for c in own.columns[1:]))
    if fixed:
        events = events.join(first.select("reference", F.struct(*_FIELDS).alias("start")), "reference", "left")
    answered = events.groupBy("reference").transformWithState(
        statefulProcessor=Settlement(None if lifetime_s is None else 1000 * lifetime_s, new_receipts is not None, fixed), outputStructType=StructType.fromDDL(ANSWER), outputMode="Append", timeMode=mode,
        initialState=None if fixed else first.groupBy("reference"),
    )
    forged = notifications.where(~valid).select("reference", "number", F.col("at").cast("timestamp").alias("at"), "code", F.lit(BAD_SIGNATURE).alias("reply"), *(F.lit(None).cast(t).alias(c) for c, t in (("receipt_id", "long"), ("status", "string"), ("job_id", "long"), ("pack_id", "long"))))
    return answered.unionByName(forged)


def settle(answered: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes answers to Parquet, each once. Spark keeps such state in RocksDB only, which the session is set to."""
    answered.sparkSession.conf.set(PROVIDER, ROCKSDB)
    writer = answered.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
