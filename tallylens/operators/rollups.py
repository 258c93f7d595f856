"""Dashboards, summaries and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(df: DataFrame, column: str, values: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """total and one count for each named value, in one pass."""
    found = [F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(n) for n, v in values.items()]]
    return df.groupBy(*(keys or [])).agg(*found)


STATES = {"por_verificar": "por_verificar", "verificadas_legitimas": "verificado_legitimo", "verificadas_anomalas": "verificado_anomalo"}


def _by_department(mesas: DataFrame, geo: DataFrame) -> DataFrame:
    """mesas(dep, con, total, the states' counts), one row each, summed by department."""
    rows = mesas.groupBy("dep").agg(F.count("*").alias("total_mesas"), F.count_if("con").alias("mesas_con_evidencia"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", *STATES)])
    per_cent = lambda part: F.expr(f"(20000 * ({part}) + greatest(total, 1)) div (2 * greatest(total, 1))") / 100
    rows = rows.join(geo.select("dep", "dep_name"), "dep", "left")
    return rows.select("dep", "dep_name", "total_mesas", "mesas_con_evidencia", F.col("total").alias("total_discrepancias"), *STATES, per_cent("total - por_verificar").alias("porcentaje_verificado"), per_cent("por_verificar").alias("porcentaje_por_verificar"))


def department_summary(actas: DataFrame, geo: DataFrame, found: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per department of the actas: mesas, those with evidence, discrepancies by state, and the shares verified and to
    verify in per cent with two decimals. Findings and evidence join by mesa and are counted for each mesa first, so
    nothing fans out."""
    mesas = actas.select("dep", "mesa_key").distinct()
    of = found.groupBy("mesa_key").agg(F.count("*").alias("total"), *[F.count_if(F.col("estado") == v).alias(n) for n, v in STATES.items()])
    seen = evidence.groupBy("mesa_key").agg(F.lit(True).alias("con"))
    return _by_department(mesas.join(of, "mesa_key", "left").join(seen, "mesa_key", "left"), geo)


def department_summary_of(sheets: DataFrame, geo: DataFrame) -> DataFrame:
    """The same from sheets that carry the states of their findings (array estados) and whether they have evidence (con):
    one pass and one shuffle by mesa, without a row for each finding."""
    count = lambda v: F.sum(F.size(F.filter("estados", lambda x: x == v)))
    mesas = sheets.groupBy("dep", "mesa_key").agg(F.max("con").alias("con"), F.sum(F.size("estados")).alias("total"), *[count(v).alias(n) for n, v in STATES.items()])
    return _by_department(mesas, geo)


def clean_sheets(sheets: DataFrame) -> DataFrame:
    """Flagged sheets with the states of their findings (array estados) that have no arithmetic or QR flag and whose mesa has
    no finding that is to verify or anomalous. A window by mesa, which holds some sheets."""
    ok = (F.col("excede") == False) & (F.col("no_coincide") == False) & (F.col("qr_malo") == False)  # noqa: E712
    bad = F.exists("estados", lambda x: x.isin("por_verificar", "verificado_anomalo"))
    return sheets.withColumn("_bad", F.max(bad).over(Window.partitionBy("mesa_key"))).where(ok & ~F.col("_bad")).drop("_bad")


def clean_mesas(flagged: DataFrame, found: DataFrame) -> DataFrame:
    """Rows without arithmetic or QR flags whose mesa has no finding that is to verify or anomalous; a null flag is not
    false."""
    ok = (F.col("excede") == False) & (F.col("no_coincide") == False) & (F.col("qr_malo") == False)  # noqa: E712
    bad = found.where(F.col("estado").isin("por_verificar", "verificado_anomalo")).select("mesa_key")
    return flagged.where(ok).join(bad, "mesa_key", "left_anti")


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Conjunction of the filters that are given."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in equal.items() if v is not None), df)


def searched(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring in any column; % and _ are plain characters."""
    return df.where(reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(text.lower())) for c in columns)))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: list, offset: int, limit: int, whole: DataFrame | None = None) -> DataFrame:
    """Rows of a page in order, with the number of all rows (of `whole` if the page is of a part of it) and their place."""
    total = (whole if whole is not None else df).agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def histogram(df: DataFrame, column: str, edges: list[int]) -> DataFrame:
    """Cumulative counts: rows up to each edge."""
    return df.agg(*[F.count_if(F.col(column) <= e).alias(f"le_{e}") for e in edges])


def cell_summary(cells: DataFrame) -> DataFrame:
    """Per acta: cells, maximum, sum and suspicious cells (over 50), of integer scores 0-100."""
    return cells.groupBy("acta_id").agg(F.count("*").alias("cells"), F.max("score").alias("top"), F.sum("score").alias("sum_score"), F.count_if(F.col("score") > 50).alias("suspicious"))


def visual_summaries(sheets: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Of each sheet its number of cells, maximum, mean and suspicious ones (over 0.5) of scores 0-1; zeros without cells."""
    of = cells.groupBy(key).agg(F.count("*").alias("cells"), F.max("score").alias("top"), F.avg("score").alias("mean"), F.count_if(F.col("score") > 0.5).alias("suspicious"))
    return sheets.select(key).join(of, key, "left").na.fill(0)


def queue_counts(queue: DataFrame, layer: int) -> DataFrame:
    """Slots of a layer that wait, are worked on, done or failed, and the sum of these (claimed ones are in none); zeros for
    an empty queue."""
    mine = F.col("capa") == layer
    states = {"pendientes": "pendiente", "procesando": "procesando", "completados": "completado", "errores": "error"}
    counts = queue.agg(*[F.count_if(mine & (F.col("estado") == v)).alias(n) for n, v in states.items()])
    return counts.withColumn("total", sum((F.col(n) for n in list(states)[1:]), F.col("pendientes")))


def consensus_totals(findings: DataFrame, votes: DataFrame) -> DataFrame:
    """Findings in all, by state and frozen, and votes and voters that aren't annulled."""
    states = {"por_verificar": "por_verificar", "verificadas_legitimas": "verificado_legitimo", "verificadas_anomalas": "verificado_anomalo"}
    one = findings.agg(F.count("*").alias("total_discrepancias"), *[F.count_if(F.col("estado") == v).alias(n) for n, v in states.items()], F.count_if("congelada").alias("congeladas"))
    two = votes.where(~F.coalesce("anulado", F.lit(False))).agg(F.count("*").alias("total_votos"), F.countDistinct("voter").alias("votantes_unicos"))
    return one.crossJoin(F.broadcast(two))  # one row each


def best_thresholds(grid: DataFrame, most: int) -> DataFrame:
    """The thresholds of greatest f1, the lower one first on a tie, with their rank."""
    rows = grid.orderBy(F.desc("f1"), "t").limit(most)  # a bounded number of rows from here on
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f1"), "t")))


def confusion(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Confusion counts of each threshold t (score >= t means suspicious). Scores are counted once per distinct value
    and running sums give every threshold, so rows are not multiplied by thresholds."""
    by = rows.groupBy("score").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
    grid = by.join(F.broadcast(thresholds), F.lit(True))  # thresholds: a fixed grid of 100 at most, scores 0-100
    hit = F.col("score") >= F.col("t")
    sums = grid.groupBy("t").agg(*[F.sum(F.when(c, F.col(v)).otherwise(0)).alias(n) for n, c, v in (("tp", hit, "p"), ("fp", hit, "n"), ("fn", ~hit, "p"), ("tn", ~hit, "n"))])
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, F.floor(20000 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))).otherwise(0)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return sums.withColumns({"f1": f1.cast("long"), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "accuracy": share(tp + tn, tp + fp + fn + tn)})


def best_threshold(grid: DataFrame) -> DataFrame:
    """The first threshold of the greatest f1 over 0; none if no threshold has any."""
    return grid.where("f1 > 0").agg(F.max_by(F.struct("t", "f1", "precision", "recall", "accuracy"), F.struct("f1", -F.col("t"))).alias("x")).where("x IS NOT NULL").select("x.*")


def labelled_scores(scores: DataFrame, labels: DataFrame, file: str = "filename") -> DataFrame:
    """Scores with the label of their file, whose name is taken without '.pdf'; files without a label are left out."""
    return scores.withColumn("_f", F.replace(file, F.lit(".pdf"), F.lit(""))).join(labels.select(F.col(file).alias("_f"), "label"), "_f").drop("_f")


def grains(df: DataFrame, keys: list[str], measures: list[Column]) -> DataFrame:
    """The measures by every subset of the keys in one pass; grain tells the subset (a bit for each key that is summed over,
    the first key's the highest), so a null key isn't taken for a sum."""
    return df.cube(*keys).agg(F.grouping_id().alias("grain"), *measures)


def sheet_report(cells: DataFrame, key: str, firsts: int, gravest: int) -> DataFrame:
    """Of each sheet its number of cells, mean and greatest score, the first `firsts` cells by idx and the `gravest` by score,
    in one group-by (a sheet holds at most some hundred cells)."""
    listed = lambda row: F.array_sort(F.collect_list(row))
    rows = cells.groupBy(key).agg(F.count("*").alias("cells"), F.avg("score").alias("mean"), F.max("score").alias("top"), listed(F.struct("idx", "score")).alias("a"), listed(F.struct((-F.col("score")).alias("s"), "idx")).alias("b"))
    joined = lambda c, n: F.array_join(F.slice(F.col(f"{c}.idx"), 1, n).cast("array<string>"), ",")
    return rows.select(key, "cells", "mean", "top", joined("a", firsts).alias("firsts"), joined("b", gravest).alias("gravest"))
