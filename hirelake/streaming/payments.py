"""Payment notifications as a stream: signatures are checked first, and what is sent again word for word goes once.

Different notifications of one reference all pass: a failed attempt may be followed by a payment. Which of them changes
anything is for the receipt's state, so apply() should reply with plans.payments.replies() and an order, and settle the
receipts before the next batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hirelake.plans.payments import checked


def genuine_notifications(stream: DataFrame, key: str, delay: str = "1 day", at: str = "at") -> DataFrame:
    """Notifications (parameters, a map, and at) with a good signature, with the columns of checked(). One that is repeated
    with all its parameters within the delay goes once; later it may pass again, which the receipt's state then catches.
    at must be a timestamp with a zone: watermarks don't take any other."""
    good = checked(stream, key).where("valid").withColumn("sent", F.to_json(F.array_sort(F.map_entries("parameters"))))
    return good.withWatermark(at, delay).dropDuplicatesWithinWatermark(["sent"]).drop("sent")


def settle(stream: DataFrame, key: str, apply, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Gives each batch of genuine notifications to apply(batch, number), which is to be idempotent by number."""
    writer = genuine_notifications(stream, key).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
