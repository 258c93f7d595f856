"""Citizen votes: order-dependent consensus with freezing, snapshots, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def judged(votes: DataFrame, least: int = 5, percent: int = 80) -> DataFrame:
    """Every vote in order of arrival with its fate: accepted, duplicate (of the voter) or frozen.

    A finding freezes at the first accepted vote at which it has `least` votes and one side has `percent` of them;
    what comes later is rejected. votes: disc, voter, legit, ts, vote_id and, if there is one, anulado: an annulled vote
    bars its voter from another but isn't counted (annulled). Runs per finding without a driver loop."""
    order = ["ts", "vote_id"]
    void = F.coalesce("anulado", F.lit(False)) if "anulado" in votes.columns else F.lit(False)
    first = votes.withColumn("again", F.row_number().over(W.partitionBy("disc", "voter").orderBy(*order)) > 1)
    first = first.withColumn("dup", F.col("again") | void)
    upto = W.partitionBy("disc").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    counted = first.withColumns({"n": F.count_if(~F.col("dup")).over(upto), "yes": F.count_if(~F.col("dup") & F.col("legit")).over(upto), "seq": F.count("*").over(upto)})
    agreed = ~F.col("dup") & (F.col("n") >= least) & (100 * F.greatest("yes", F.col("n") - F.col("yes")) >= percent * F.col("n"))
    counted = counted.withColumn("stop", F.min(F.when(agreed, F.col("seq"))).over(W.partitionBy("disc")))
    fate = F.when(F.col("seq") > F.col("stop"), "frozen").when(F.col("again"), "duplicate").when(F.col("dup"), "annulled").otherwise("accepted")
    return counted.withColumn("fate", fate)


def frozen(votes: DataFrame, least: int = 5, percent: int = 80) -> DataFrame:
    """Outcome of each finding: its accepted votes and, if it froze, the winning side (legitimate tested first)."""
    rows = judged(votes, least, percent).where("fate = 'accepted'")
    out = rows.groupBy("disc").agg(F.count("*").alias("n"), F.count_if("legit").alias("legitimos"), F.max(F.col("stop").isNotNull()).alias("congelada"))
    side = F.when(100 * F.col("legitimos") >= percent * F.col("n"), "legitima").otherwise("anomala")
    return out.withColumn("resultado", F.when(F.col("congelada"), side).otherwise("por_verificar"))


def snapshot(votes: DataFrame, least: int = 5, percent: int = 80) -> DataFrame:
    """Counts of all votes as they stand, and the decision on them."""
    out = votes.groupBy("disc").agg(F.count("*").alias("n"), F.count_if("legit").alias("legitimos"), F.countDistinct("voter").alias("votantes"))
    enough = F.col("n") >= least
    state = F.when(enough & (100 * F.col("legitimos") >= percent * F.col("n")), "legitima").when(enough & (100 * (F.col("n") - F.col("legitimos")) >= percent * F.col("n")), "anomala").otherwise("por_verificar")
    return out.withColumn("estado", state)


def thresholds(config: DataFrame) -> DataFrame:
    """One row (least, share) of config(clave, valor); 5 and 0.80 where a value is absent, empty or no number."""
    value = lambda key: F.max(F.when(F.col("clave") == key, F.trim("valor")))
    least, share = value("umbral_min_votos").try_cast("int"), value("umbral_consenso_pct").try_cast("double")
    return config.agg(F.coalesce(least, F.lit(5)).alias("least"), F.coalesce(share, F.lit(0.80)).alias("share"))


def weighed(votes: DataFrame, config: DataFrame) -> DataFrame:
    """Counts and summed weights of the votes that aren't annulled, and the decision by the thresholds of config, with its
    reason. votes: disc, legit, peso, anulado; a finding of annulled votes only has zeros."""
    live = ~F.coalesce("anulado", F.lit(False))
    total = lambda side: F.round(F.coalesce(F.sum(F.when(live & side, F.col("peso"))), F.lit(0.0)), 2)
    yes, no = F.col("legit"), ~F.col("legit")
    out = votes.groupBy("disc").agg(F.count_if(live & yes).alias("confirma"), F.count_if(live & no).alias("rechaza"), total(yes).alias("peso_confirma"), total(no).alias("peso_rechaza"))
    out = out.join(F.broadcast(thresholds(config)), F.lit(True)).withColumn("n", F.col("confirma") + F.col("rechaza"))
    enough = (F.col("n") >= F.col("least")) & (F.col("n") > 0)
    state = F.when(enough & (F.try_divide("confirma", "n") >= F.col("share")), "verificado_legitimo").when(enough & (F.try_divide("rechaza", "n") >= F.col("share")), "verificado_anomalo")
    word, count = F.when(F.col("estado") == "verificado_legitimo", "legítimo").otherwise("anómalo"), F.when(F.col("estado") == "verificado_legitimo", F.col("confirma")).otherwise(F.col("rechaza"))
    reason = F.concat(F.lit("Consenso "), word, F.lit(": "), count, F.lit("/"), F.col("n"), F.lit(" ≥ "), F.round(F.col("share") * 100).cast("int"), F.lit("%"))
    return out.withColumn("estado", state).withColumn("razon", F.when(F.col("estado").isNotNull(), reason).otherwise("")).drop("least", "share")


def pending(found: DataFrame, limit: int, offset: int = 0, mesa_key: str | None = None) -> DataFrame:
    """Open findings: high priority first, then oldest, then id."""
    rows = found.where("estado = 'por_verificar' and not congelada")
    rows = rows.where(F.col("mesa_key") == mesa_key) if mesa_key else rows
    rank = F.when(F.col("prioridad") == "alta", 1).when(F.col("prioridad") == "media", 2).otherwise(3)
    return rows.orderBy(rank, "creado_en", "id").offset(offset).limit(limit)
