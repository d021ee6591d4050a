"""Payments: new receipts, and what notifications of the payment service do to receipts and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.functions.money import minor_units, signature_valid, transaction_reference
from hirelake.operators.mutations import overlaid
from hirelake.sources.tables import inserted

# Replies to the payment service, in the order in which they are tried.
BAD_SIGNATURE, NOT_FOUND, BAD_AMOUNT, ALREADY_PAID, ACCEPTED, FAILED = "97", "01", "04", "02", "00", "99"
MESSAGES = {BAD_SIGNATURE: "Invalid Signature", NOT_FOUND: "Order Not Found", BAD_AMOUNT: "Invalid Amount", ALREADY_PAID: "Order Already Confirmed", ACCEPTED: "Confirm Success", FAILED: "Unknown Error"}
PAID = "00"


def receipts_created(receipts: DataFrame, requests: DataFrame, packs: DataFrame, prefix: str, now: Column) -> DataFrame:
    """Receipts with new ones for requests (id, user_id, pack_id, job_id, method): pending, at the pack's price; those
    paid online get a reference. Requests for packs that don't exist are left out."""
    pack = packs.select(F.col("id").alias("service_pack_id"), F.col("price").alias("amount"))
    new = requests.join(pack, F.col("pack_id") == F.col("service_pack_id")).select(
        "id", "user_id", "service_pack_id", F.col("job_id").alias("related_job_id"), "amount", F.col("method").alias("payment_method"),
        F.lit("PENDING").alias("status"), F.lit(False).alias("is_paid"), F.lit(True).alias("active"), now.alias("created_date"), now.alias("updated_date"),
        F.when(F.col("method") == "VNPAY", transaction_reference(prefix, F.col("id"), now)).alias("transaction_id"),
    )
    return inserted(receipts, new)


def checked(notifications: DataFrame, key: str) -> DataFrame:
    """Notifications (parameters: a map with reference, amount, code and secure_hash) with these fields as columns and valid."""
    fields = {f: F.try_element_at("parameters", F.lit(f)) for f in ("reference", "amount", "code")}
    return notifications.withColumns(fields).withColumn("valid", signature_valid(F.col("parameters"), key))


def replies(notifications: DataFrame, receipts: DataFrame, key: str | None, order: Column | None = None) -> DataFrame:
    """Notifications (parameters, as in checked(); or the columns that it makes, if key is None and signatures are settled
    elsewhere) with the receipt they name, reply and message.

    A reference that several receipts have, or an amount that is no number, gives the reply for other failures. order says
    in which order notifications of one receipt arrive: what comes after a payment that is accepted finds it paid. Those
    that tie in it may be taken either way, and without an order each is judged by the receipts alone.
    """
    if key is not None:
        notifications = checked(notifications, key)
    own = receipts.groupBy("transaction_id").agg(F.count("*").alias("n"), *(F.first(c).alias(f"receipt_{c}") for c in ("id", "amount", "is_paid", "related_job_id", "service_pack_id")))
    out = notifications.join(own, F.col("reference") == F.col("transaction_id"), "left")
    sent = F.col("amount").try_cast("decimal(20,0)")
    reply = (
        F.when(~F.coalesce("valid", F.lit(False)), BAD_SIGNATURE)
        .when(F.col("n").isNull(), NOT_FOUND)
        .when((F.col("n") > 1) | sent.isNull() | F.col("receipt_amount").isNull(), FAILED)
        .when(sent != minor_units(F.col("receipt_amount")), BAD_AMOUNT)
        .when(F.col("receipt_is_paid"), ALREADY_PAID)
        .otherwise(ACCEPTED)
    )
    out = out.withColumn("reply", reply)
    if order is not None:
        pays = (F.col("reply") == ACCEPTED) & F.coalesce(F.col("code") == PAID, F.lit(False))
        before = Window.partitionBy("reference").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        paid = F.coalesce(F.max(pays).over(before), F.lit(False))
        out = out.withColumn("reply", F.when((F.col("reply") == ACCEPTED) & paid, ALREADY_PAID).otherwise(F.col("reply")))
    message = F.element_at(F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv)), F.col("reply"))
    return out.withColumn("message", message).drop("n", "transaction_id")


def receipts_settled(receipts: DataFrame, replied: DataFrame) -> DataFrame:
    """Receipts after accepted replies, one for a receipt: paid if the code says so, else failed."""
    done = replied.where(F.col("reply") == ACCEPTED).groupBy(F.col("receipt_id").alias("settled")).agg(F.max(F.coalesce(F.col("code") == PAID, F.lit(False))).alias("paid"))
    out = receipts.join(done, F.col("id") == F.col("settled"), "left")
    return overlaid(out, F.col("settled").isNotNull(), status=F.when(F.col("paid"), "SUCCESS").otherwise("FAILED"), is_paid=F.col("paid")).drop("settled", "paid")


def jobs_featured(jobs: DataFrame, replied: DataFrame) -> DataFrame:
    """Jobs after accepted replies: a payment features its job if it has both a job and a pack."""
    paid = replied.where((F.col("reply") == ACCEPTED) & (F.col("code") == PAID) & F.col("receipt_service_pack_id").isNotNull())
    paid = paid.select(F.col("receipt_related_job_id").alias("featured")).where(F.col("featured").isNotNull()).distinct()
    return overlaid(jobs.join(paid, F.col("id") == F.col("featured"), "left"), F.col("featured").isNotNull(), is_featured=F.lit(True)).drop("featured")


def receipts_returned(receipts: DataFrame, returns: DataFrame, trusted: bool = False) -> DataFrame:
    """Receipts after what browsers bring back (reference, code). This path checks neither signature nor amount, and lets a
    failure undo a payment, so it does nothing unless the caller says that its input can be trusted."""
    if not trusted:
        return receipts
    last = returns.groupBy(F.col("reference").alias("returned")).agg(F.max(F.coalesce(F.col("code") == PAID, F.lit(False))).alias("paid"))
    out = receipts.join(last, F.col("transaction_id") == F.col("returned"), "left")
    return overlaid(out, F.col("returned").isNotNull(), status=F.when(F.col("paid"), "SUCCESS").otherwise("FAILED"), is_paid=F.col("paid")).drop("returned", "paid")
