"""Work queues as functional state: enqueueing, claims, transitions, retries, dead letters, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def enqueue(actas: DataFrame, queue: DataFrame) -> DataFrame:
    """Pending rows that are not queued yet."""
    return actas.join(queue.where("acta_id is not null").select(F.col("acta_id").alias("id")), "id", "left_anti")


def claims(queue: DataFrame, workers: int, per_worker: int) -> DataFrame:
    """The oldest pending slots of each layer, dealt to workers in turn."""
    rank = F.row_number().over(W.partitionBy("capa").orderBy("creado_en", "id")) - 1
    return queue.where("estado = 'pendiente'").withColumn("_r", rank).where(F.col("_r") < workers * per_worker).select("id", "capa", (F.col("_r") % workers).alias("worker"))


def transition(ok: Column, attempts: Column, most: int = 3) -> Column:
    return F.when(ok, "completado").when(attempts + 1 >= most, "error").otherwise("pendiente")


def after_attempt(queue: DataFrame, outcomes: DataFrame, longest: int = 500) -> DataFrame:
    """The queue (id, estado, worker_id, tomado_en, intentos, max_intentos, ultimo_error) after outcomes(id, ok, error): a
    success is done; a failure counts an attempt and is an error at the slot's own number of attempts (3 without one), else
    it waits again without a worker. Errors are cut. Slots without an outcome stay."""
    rows = queue.join(outcomes.select("id", F.col("ok").alias("_ok"), F.col("error").alias("_e")), "id", "left")
    failed = F.coalesce(~F.col("_ok"), F.lit(False))
    most = F.coalesce("max_intentos", F.lit(3))
    tried = F.coalesce("intentos", F.lit(0)) + failed.cast("int")
    again = failed & (tried < most)
    state = F.when(F.col("_ok").isNull(), F.col("estado")).when(F.col("_ok"), "completado").when(again, "pendiente").otherwise("error")
    out = {"estado": state, "intentos": tried, "ultimo_error": F.when(failed, F.substring("_e", 1, longest)).otherwise(F.col("ultimo_error"))}
    out |= {c: F.when(~again, F.col(c)) for c in ("worker_id", "tomado_en")}
    return rows.withColumns(out).drop("_ok", "_e")


def dead_letter_rows(queue: DataFrame, failed_at: Column) -> DataFrame:
    """Payloads of the slots that failed for good: all their columns as JSON, with the error and the time."""
    rows = queue.where("estado = 'error'")
    payload = F.struct(*[c for c in queue.columns if c != "ultimo_error"], F.col("ultimo_error").alias("error_message"), failed_at.cast("string").alias("failed_at"))
    return rows.select("id", F.to_json(payload).alias("payload"))


def backoff(attempt: Column, base: int = 60, cap: int = 600) -> Column:
    """Doubling delay up to a cap."""
    return F.least(F.lit(cap), base * F.pow(F.lit(2), F.least(attempt, F.lit(20))).cast("int"))


def sliding_load(requests: DataFrame, seconds: int) -> DataFrame:
    """Requests of each key in the last `seconds` up to each request."""
    window = W.partitionBy("key").orderBy("t").rangeBetween(-seconds, 0)
    return requests.withColumn("load", F.count("*").over(window))


def spaced(requests: DataFrame, gap: int) -> DataFrame:
    """Start times when starts of a key are at least `gap` apart: gap * i + running maximum of (t - gap * i)."""
    order = W.partitionBy("key").orderBy("t", "id")
    i = F.row_number().over(order) - 1
    rows = requests.withColumn("i", i)
    return rows.withColumn("start", gap * F.col("i") + F.max(F.col("t") - gap * F.col("i")).over(order.rowsBetween(W.unboundedPreceding, 0))).drop("i")


def token_bucket(requests: DataFrame, rate: float, burst: float, deduct_wait: bool = True) -> DataFrame:
    """Waits of a token bucket per key: refill by rate up to burst, one token each; a fold, so grouped in pandas.

    With deduct_wait the waiter's token is taken after its wait; without, the refill of the wait stays."""

    def fold(pdf):
        pdf = pdf.sort_values(["t", "id"])
        tokens, last, waits = burst, None, []
        for t in pdf["t"]:
            now = t if last is None else max(t, last)
            tokens = min(burst, tokens + (0 if last is None else (now - last) * rate))
            wait = 0.0 if tokens >= 1 else (1 - tokens) / rate
            tokens, last = (tokens - 1 if tokens >= 1 else 0.0 if deduct_wait else tokens), now + (wait if deduct_wait else 0.0)
            waits.append(wait + now - t)
        return pdf.assign(wait=waits)[["key", "id", "t", "wait"]]

    return requests.select("key", "id", F.col("t").cast("double").alias("t")).groupBy("key").applyInPandas(fold, "key long, id long, t double, wait double")


def batches(ids: DataFrame, key: str, size: int = 50) -> DataFrame:
    """Batch number of each id within its department, `size` to a batch."""
    return ids.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(key).orderBy("id")) - 1) / size).cast("long"))
