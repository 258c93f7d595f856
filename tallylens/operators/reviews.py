"""Reviews of sheets as an append-only log: what counts now, what counted at a time, and who overrode what.

The log (review_id, acta_id, decision, reason, reviewer, at) is never changed: a state is the latest review by time, of
equal times the one with the greatest id, so repeated or late deliveries of the same reviews give the same state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("review_id", "decision", "reason", "reviewer", "at")


def submitted(log: DataFrame, reviews: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with new reviews, and apart those of sheets that don't exist. A review that the log has (by id) isn't added
    again; of new ones with the same id one is."""
    known = sheets.select(F.col("id").alias("acta_id")).distinct()
    new = reviews.dropDuplicates(["review_id"])
    fresh = new.join(known, "acta_id", "left_semi").join(log.select("review_id"), "review_id", "left_anti")
    return log.unionByName(fresh.select(log.columns)), new.join(known, "acta_id", "left_anti").select(reviews.columns)


def latest(log: DataFrame, until: Column | None = None) -> DataFrame:
    """The review of each sheet that counts (up to a time, if one is given), and how many there were: one group-by, whose
    state is a single review, so the log of a sheet may have any length."""
    rows = log if until is None else log.where(F.col("at") <= until)
    return rows.groupBy("acta_id").agg(F.max(F.struct("at", *[c for c in FIELDS if c != "at"])).alias("_r"), F.count("*").alias("reviews")).select("acta_id", *[F.col(f"_r.{c}").alias(c) for c in FIELDS], "reviews")


def reviewed(sheets: DataFrame, log: DataFrame, column: str, until: Column | None = None) -> DataFrame:
    """Sheets with the decision that counts over the computed value of `column`, and with computed, reviewer, at and reviews."""
    now = latest(log, until).select(F.col("acta_id").alias("id"), F.col("decision").alias("_d"), "reason", "reviewer", "at", "reviews")
    out = sheets.join(now, "id", "left").withColumns({"computed": F.col(column), column: F.coalesce("_d", column)}).drop("_d")
    return out.withColumn("reviews", F.coalesce("reviews", F.lit(0)))


def overrides(log: DataFrame) -> DataFrame:
    """Each review with the decision that it replaced (null for a sheet's first) and until when it counted."""
    order = Window.partitionBy("acta_id").orderBy("at", "review_id")
    return log.withColumns({"replaced": F.lag("decision").over(order), "until": F.lead("at").over(order)})


def compacted(log: DataFrame, before: Column) -> DataFrame:
    """The log without reviews that were replaced before a time: every state from that time on stays as it was."""
    return overrides(log).where(F.col("until").isNull() | (F.col("until") > before)).select(log.columns)
