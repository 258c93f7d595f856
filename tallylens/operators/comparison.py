"""Official rows against citizen evidence: latest row, best evidence, field differences, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What the compared fields are called in reasons.
LABELS = {"e11": "Total votantes E-11", "urna": "Total votos urna", "incinerados": "Votos incinerados", "c1": "Votos candidato 1", "c2": "Votos candidato 2", "blanco": "Votos en blanco", "nulos": "Votos nulos", "no_marcados": "Votos no marcados"}
FIELDS = tuple(LABELS)


def top_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest(actas: DataFrame) -> DataFrame:
    return top_one(actas, ["mesa_key"], F.col("creado_en").desc(), F.col("id").desc())


def best_evidence(evidence: DataFrame) -> DataFrame:
    """Highest confidence, earliest on a tie; rejected rows and those without confidence don't count."""
    usable = evidence.where((F.col("estado") != "rechazada_calidad") & F.col("confianza").isNotNull())
    return top_one(usable, ["mesa_key"], F.col("confianza").desc(), "creado_en", "id")


def compared(official: DataFrame, evidence: DataFrame, tolerance: int = 0) -> DataFrame:
    """One row per mesa and field that either side has: oficial, ciudadano, diferencia, discrepa, prioridad."""
    wide = lambda df, name: df.select("mesa_key", F.struct(*[F.col(f).cast("long").alias(f) for f in FIELDS]).alias(name))
    both = wide(latest(official), "o").join(wide(best_evidence(evidence), "e"), "mesa_key")  # a row for each mesa; fields come apart after
    each = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f"o.{f}").alias("oficial"), F.col(f"e.{f}").alias("ciudadano")) for f in FIELDS])
    both = both.select("mesa_key", F.inline(each)).where("oficial is not null or ciudadano is not null").withColumn("diferencia", F.col("ciudadano") - F.col("oficial"))
    far = F.coalesce(F.abs("diferencia") > tolerance, F.lit(False))
    return both.withColumns({"discrepa": far, "prioridad": F.when(F.abs("diferencia") > 20, "alta").when(F.abs("diferencia") > 5, "media").otherwise("baja"), "puntos": F.least(F.abs("diferencia") * 2, F.lit(100))})


def discrepancy_rows(fields: DataFrame) -> DataFrame:
    """Findings of fields that differ, with values as texts and the reason."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    reason = F.concat(F.lit("Diferencia de "), F.coalesce(F.abs("diferencia"), F.lit(0)).cast("string"), F.lit(" voto(s) en "), labels[F.col("campo")], F.lit(". Oficial="), text("oficial"), F.lit(", Ciudadano="), text("ciudadano"))
    rows = fields.where("discrepa")
    return rows.select("mesa_key", F.col("campo").alias("campo_afectado"), F.col("oficial").cast("string").alias("valor_oficial"), F.col("ciudadano").cast("string").alias("valor_ciudadano"), F.lit("discrepancia_oficial_vs_ciudadano").alias("tipo_anomalia"), F.col("puntos").alias("score_capa0"), reason.alias("razon_flag"), "prioridad", F.lit("por_verificar").alias("estado"))


def summaries(fields: DataFrame) -> DataFrame:
    return fields.groupBy("mesa_key").agg(F.count("*").alias("comparados"), F.count_if("discrepa").alias("discrepancias"), F.coalesce(F.max(F.when(F.col("discrepa"), F.col("puntos"))), F.lit(0)).alias("peor"))


def batch_totals(keys: DataFrame, fields: DataFrame) -> DataFrame:
    """Mesas of keys(mesa_key), those with discrepancies, and discrepancies in all; a mesa that can't be compared has none."""
    bad = fields.where("discrepa").groupBy("mesa_key").agg(F.count("*").alias("_n"))
    rows = keys.select("mesa_key").distinct().join(bad, "mesa_key", "left")
    return rows.agg(F.count("*").alias("total_mesas"), F.count("_n").alias("mesas_con_discrepancia"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total_discrepancias"))


def statuses(keys: DataFrame, official: DataFrame, evidence: DataFrame) -> DataFrame:
    """Why a mesa can or can't be compared."""
    have = official.select("mesa_key", F.lit(1).alias("o")).distinct()
    some = evidence.where("estado <> 'rechazada_calidad'").groupBy("mesa_key").agg(F.max(F.col("confianza").isNotNull()).alias("usable"))
    rows = keys.join(have, "mesa_key", "left").join(some, "mesa_key", "left")
    status = F.when(F.col("o").isNull(), "sin_acta").when(F.col("usable").isNull(), "sin_evidencia").when(~F.col("usable"), "sin_datos").otherwise("comparable")
    return rows.select("mesa_key", status.alias("status"))
