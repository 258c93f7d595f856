"""Row-wise audit rules, scores and bands, as Column expressions over tally rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylens.functions.text import clamp

VOTES = ("c1", "c2", "blanco", "nulos", "no_marcados")
# Weights of the mathematical rules in the risk score; other rules weigh 5.
WEIGHTS = {"SUM_MISMATCH": 40, "NEGATIVE_VOTES": 40, "EXCEEDS_3_DIGITS": 15, "OVERVOTE": 35, "UNDERVOTE": 20, "LOW_OCR_CONFIDENCE": 15}


def suma() -> Column:
    return sum((F.coalesce(F.col(v), F.lit(0)) for v in VOTES[1:]), F.coalesce(F.col(VOTES[0]), F.lit(0))).cast("long")


def with_flags(actas: DataFrame) -> DataFrame:
    """Adds suma and the flags of the arithmetic and completeness rules; nulls count as 0, a null flag input as false."""
    gap = F.abs(F.coalesce("e11", F.lit(0)) - F.coalesce("urna", F.lit(0)))
    return actas.withColumn("suma", suma()).withColumns(
        {
            "excede": F.col("suma") > F.coalesce("urna", F.lit(0)),
            "no_coincide": F.col("suma") != F.coalesce("urna", F.lit(0)),
            "nivelacion": gap > F.coalesce("incinerados", F.lit(0)),
            "incompleta": F.col("paginas_total") < F.col("paginas_esperadas"),
            "firmas_bajas": F.col("firmas") < 6,
            "qr_malo": ~F.coalesce("qr_ok", F.lit(False)),
        }
    )


def expected_qr(mesa_key: Column, suffix: str = "-PRE-2026") -> Column:
    """What the QR code of a mesa's sheet should hold."""
    return F.concat(mesa_key, F.lit(suffix))


def with_findings(actas: DataFrame) -> DataFrame:
    """Adds the flags and `findings`, an array of the violated rules: k, rule, score2 (twice the score), oficial and
    ciudadano (as text). Sums over sheets or mesas need no row for each finding."""
    rows = with_flags(actas)

    def one(k: int, name: str, flag: Column, score2: Column, official: Column, other: Column) -> Column:
        return F.when(flag, F.struct(F.lit(k).alias("k"), F.lit(name).alias("rule"), score2.cast("int").alias("score2"), official.cast("string").alias("oficial"), other.cast("string").alias("ciudadano")))

    two = F.lit(2)
    rules = F.array_compact(
        F.array(
            one(0, "aritmetica_excede_total", F.col("excede"), two, F.col("urna"), F.col("suma")),
            one(1, "aritmetica_no_coincide", F.col("no_coincide"), two, F.col("urna"), F.col("suma")),
            one(2, "nivelacion_inconsistente", F.col("nivelacion"), two, F.col("e11"), F.col("urna")),
            one(3, "paginas_incompletas", F.col("incompleta"), two, F.col("paginas_esperadas"), F.col("paginas_total")),
            one(4, "firmas_insuficientes", F.col("firmas_bajas"), F.when(F.col("firmas") >= 4, 1).otherwise(2), F.lit(6), F.col("firmas")),
            one(5, "qr_metadata_mismatch", F.col("qr_malo"), two, expected_qr(F.col("mesa_key")), F.col("qr_raw")),
        )
    )
    return rows.withColumn("findings", rules)


def findings(actas: DataFrame, priority_policy: str = "score") -> DataFrame:
    """One row per violated rule: id, acta_id, mesa_key, rule, score2 (twice the score), oficial and ciudadano (as text), prioridad.

    priority_policy 'score' gives alta from score 1.0 on; 'excede' gives it to the excess rule alone."""
    out = with_findings(actas).select("id", "mesa_key", "dep", "creado_en", F.explode("findings").alias("f"))
    high = F.col("f.score2") >= 2 if priority_policy == "score" else F.col("f.rule") == "aritmetica_excede_total"
    return out.select((F.col("id") * 10 + F.col("f.k")).alias("id"), F.col("id").alias("acta_id"), "mesa_key", "dep", "creado_en", "f.rule", "f.score2", "f.oficial", "f.ciudadano", F.when(high, "alta").otherwise("media").alias("prioridad"))


def structure_score(cells: Column, pages: Column) -> Column:
    """Hundredths: under 4 cells 30, over 12 cells 20, under 2 pages 50; 100 at most."""
    return F.least(F.when(cells < 4, 30).when(cells > 12, 20).otherwise(0) + F.when(pages < 2, 50).otherwise(0), F.lit(100))


def verdict_points(arith: Column, average: Column, top: Column, suspicious: Column, total: Column) -> Column:
    """0.30 arithmetic + 0.25 mean + 0.20 maximum + 0.25 share of suspicious cells."""
    return 0.30 * arith + 0.25 * average + 0.20 * top + 0.25 * suspicious / F.greatest(total, F.lit(1))


def verdict(points: Column, low: float = 0.29, high: float = 0.60) -> Column:
    return F.when(points < low, "LEGITIMA").when(points < high, "SOSPECHOSA").otherwise("ILEGITIMA")


def score_band(score: Column) -> Column:
    return F.when(score < 0.30, "low").when(score < 0.60, "medium").otherwise("high")


def risk_level(risk: Column) -> Column:
    return F.when(risk >= 80, "CRITICAL").when(risk >= 50, "HIGH").when(risk >= 20, "MEDIUM").otherwise("LOW")


def math_anomalies(total: Column, candidates: Column, blank: Column, null: Column, unmarked: Column, ocr: Column, registered: Column | None = None, low_ocr: float = 0.6, first_page: int = 7, names: bool = False) -> Column:
    """Violated mathematical rules, in order, of an array of the candidates' votes (candidate 1 first): (rule, severity,
    message, confidence, page, details). A sum that is null counts as 0, as does a missing summary; a candidate's rules
    come once for each candidate that violates them, on the page where it stands. With `names` the rules' names alone."""
    zero = F.lit(0).cast("long")
    total, blank, null, unmarked = (F.coalesce(c.cast("long"), zero) for c in (total, blank, null, unmarked))
    votes = F.transform(candidates, lambda v: F.coalesce(v.cast("long"), zero))
    parts = F.aggregate(votes, zero, lambda acc, v: acc + v)
    computed = parts + blank + null + unmarked

    def row(rule: str, severity: str, message: Column, confidence: float, page: Column, **details: Column) -> Column:
        if names:
            return F.lit(rule)
        given = F.create_map(*[x for name, c in details.items() for x in (F.lit(name), c.cast("long"))]) if details else F.create_map().cast("map<string,bigint>")
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"), F.lit(confidence).alias("confidence"), page.cast("int").alias("page"), given.alias("details"))

    def one(bad: Column, found: Column) -> Column:
        return F.when(bad, F.array(found)).otherwise(F.array().cast("array<string>" if names else MATH_ANOMALIES))

    def each(bad, found) -> Column:
        numbered = F.transform(votes, lambda v, i: F.struct((i + 1).alias("n"), v.alias("v")))
        return F.transform(F.filter(numbered, lambda c: bad(c["v"])), lambda c: found(c["n"], c["v"]))

    page_of = lambda n: F.when(n <= first_page, 1).otherwise(2)
    two = F.lit(2)
    rules = [
        one(total != computed, row("SUM_MISMATCH", "CRITICAL", F.format_string("Total declared (%d) != computed (%d), diff=%d", total, computed, F.abs(total - computed)), 0.95, two, declared_total=total, computed_total=computed)),
        each(lambda v: v < 0, lambda n, v: row("NEGATIVE_VOTES", "CRITICAL", F.format_string("Candidate %d has negative votes: %d", n, v), 1.0, page_of(n), candidate=n, votes=v)),
        one(F.least(blank, null, unmarked) < 0, row("NEGATIVE_SUMMARY", "CRITICAL", F.format_string("Negative summary: blank=%d, null=%d, unmarked=%d", blank, null, unmarked), 1.0, two)),
        each(lambda v: v > 999, lambda n, v: row("EXCEEDS_3_DIGITS", "HIGH", F.format_string("Candidate %d has %d votes (exceeds 999)", n, v), 0.9, page_of(n), candidate=n, votes=v)),
    ]
    if registered is not None:
        limit = registered.cast("long")
        rules.append(one(F.coalesce((limit != 0) & (total > limit), F.lit(False)), row("OVERVOTE", "CRITICAL", F.format_string("Total votes (%d) exceeds registered voters (%d)", total, F.coalesce(limit, zero)), 0.95, two, total=total, registered=limit)))
    rules.append(one((total > 0) & (parts > total), row("UNDERVOTE", "MEDIUM", F.format_string("Candidate sum (%d) > total (%d)", parts, total), 0.8, two, candidate_sum=parts, total=total)))
    rules.append(one(F.coalesce(ocr < low_ocr, F.lit(False)), row("LOW_OCR_CONFIDENCE", "MEDIUM", F.format_string("Low OCR confidence: %.1f%%", F.coalesce(ocr.cast("double"), F.lit(0.0)) * 100), 1.0, F.lit(1))))
    return F.concat(*rules)


MATH_ANOMALIES = "array<struct<rule:string,severity:string,message:string,confidence:double,page:int,details:map<string,bigint>>>"


def math_rules(*sums: Column, **options) -> Column:
    """Names of the violated mathematical rules, in order."""
    return math_anomalies(*sums, **options, names=True)


def risk_score(rules: Column, signature: Column, ocr: Column, weights: dict[str, int] | None = None, default: int = 5) -> Column:
    """Weights of the rules up to 40, the signature part, and up to 15 for what the OCR confidence lacks; 100 at most,
    with two decimals."""
    table = F.create_map(*[F.lit(x) for kv in (weights or WEIGHTS).items() for x in kv])
    whole = F.least(F.aggregate(rules, F.lit(0), lambda acc, r: acc + F.coalesce(table[r], F.lit(default))), F.lit(40))
    return F.round(F.least(whole + signature + F.greatest(F.lit(0.0), (1 - ocr) * 15), F.lit(100.0)), 2)


def risk_breakdown(rules: Column, status: Column, signature: Column, ocr: Column) -> Column:
    """(score, level, signatures, mathematical, ocr_confidence, anomaly_count, anomaly_types) of a sheet: the parts of the
    risk score to two places, and its anomalies as a sorted set, after the state of the signatures if not complete."""
    table = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    whole = F.least(F.aggregate(rules, F.lit(0), lambda acc, r: acc + F.coalesce(table[r], F.lit(5))), F.lit(40))
    unsure = F.greatest(F.lit(0.0), (1 - ocr) * 15)
    score, complete = risk_score(rules, signature, ocr), status == "COMPLETE"
    first = F.when(complete, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("signature_"), F.lower(status))))
    return F.struct(
        score.alias("score"), risk_level(score).alias("level"), signature.cast("double").alias("signatures"), whole.cast("double").alias("mathematical"), F.round(unsure, 2).alias("ocr_confidence"),
        (F.size(rules) + F.when(complete, 0).otherwise(1)).alias("anomaly_count"), F.concat(first, F.array_sort(F.array_distinct(rules))).alias("anomaly_types"),
    )


def visual_anomalies(lines: Column, ink: Column, state: Column) -> Column:
    """Scores of a sheet's anomalies: over 15 long strokes (their number / 25, 1 at most), under 2 % ink in the signature
    zone (0.9), and by its state of consistency few data (0.8) or an inconsistent sum (0.95)."""
    return F.array_compact(F.array(F.when(lines > 15, F.least(lines / 25, F.lit(1.0))), F.when(ink < 0.02, 0.9), F.when(state == "few_data", 0.8).when(state == "inconsistent", 0.95)))


def sheet_score(scores: Column) -> Column:
    """(score, verdict) of a sheet: its gravest anomaly and 0.1 for each, 1 at most; the verdict is of the score before
    rounding to two decimals."""
    score = F.least(F.coalesce(F.array_max(scores), F.lit(0.0)) + 0.1 * F.size(scores), F.lit(1.0))
    return F.struct(F.round(score, 2).alias("score"), F.when(score > 0.7, "FRAUDE").when(score > 0.3, "SOSPECHOSO").otherwise("LIMPIO").alias("verdict"))


def score_findings(scores: DataFrame, actas: DataFrame, least: float = 0.6, high: float = 0.85) -> DataFrame:
    """Findings of scored cells(mesa_key, campo, grosor, separador, tinta) whose blend reaches least and whose mesa has a
    sheet in actas(mesa_key, id); of several sheets the last by id counts."""
    last = actas.groupBy("mesa_key").agg(F.max("id").alias("acta_id"))
    rows = scores.withColumn("score", 0.3 * F.col("grosor") + 0.4 * F.col("separador") + 0.3 * F.col("tinta")).where(F.col("score") >= least)
    reason = F.format_string("Capa1: grosor=%.2f, separador=%.2f, tinta=%.2f", "grosor", "separador", "tinta")
    return rows.join(last, "mesa_key").select("acta_id", "mesa_key", "campo", "score", reason.alias("razon"), F.when(F.col("score") >= high, "alta").otherwise("media").alias("prioridad"))


# Upper densities of ink, the digit read below each, and its confidence; above the last, 8 at 0.60.
DIGITS = [(0.065, 1, 0.75), (0.105, 7, 0.78), (0.148, 4, 0.80), (0.195, 0, 0.82), (0.235, 6, 0.80), (0.285, 9, 0.78), (0.315, 5, 0.75), (0.350, 2, 0.72), (0.390, 3, 0.68)]


def slot_digit(density: Column) -> Column:
    """(digit, confidence) of a digit slot; under a density of 0.02 there is no digit, and under 0.10 less confidence."""
    row = lambda digit, sure: F.struct(F.lit(digit).cast("int").alias("digit"), F.round(sure * F.least(density / 0.10, F.lit(1.0)), 4).alias("confidence"))
    out = F.when(F.coalesce(density, F.lit(0.0)) < 0.02, row(None, 0.0))
    for below, digit, sure in DIGITS:
        out = out.when(density < below, row(digit, sure))
    return out.otherwise(row(8, 0.60))


def slots_confidence(slots: Column) -> Column:
    """Mean confidence of a row's slots; one without a digit counts as 0, no slots give 0."""
    whole = F.aggregate(slots, F.lit(0.0), lambda acc, s: acc + F.when(s["digit"].isNotNull(), s["confidence"]).otherwise(0.0))
    return F.coalesce(F.try_divide(whole, F.size(slots)), F.lit(0.0))


def ink_state(density: Column) -> Column:
    return F.when(density >= 0.15, "PRESENT").when(density >= 0.05, "INDETERMINATE").otherwise("EMPTY")


# The risk of a box's state, in ascending order.
BOX_RISKS = {"PRESENT": "LOW", "INDETERMINATE": "MEDIUM", "EMPTY": "CRITICAL"}


def signature_result(densities: Column) -> Column:
    """(states, found, status, max_risk, confidence) of the shares of ink of a sheet's boxes: the state of each, the number
    of those present, and by it the whole; the gravest risk of a box, and found / 3."""
    states = F.transform(densities, ink_state)
    count = lambda v: F.size(F.filter(states, lambda x: x == v))
    found = count("PRESENT")
    status = F.when(found == 3, "COMPLETE").when(found >= 1, "INCOMPLETE").otherwise("EMPTY")
    risk = F.when(count("EMPTY") > 0, BOX_RISKS["EMPTY"]).when(count("INDETERMINATE") > 0, BOX_RISKS["INDETERMINATE"]).otherwise(BOX_RISKS["PRESENT"])
    return F.struct(states.alias("states"), found.alias("found"), status.alias("status"), risk.alias("max_risk"), F.round(found / 3, 4).alias("confidence"))


def percent(score: Column) -> Column:
    """Whole per cent of a score of 0 to 1, halves up."""
    return F.floor(score * 100 + 0.5).cast("int")


def out_of_range(**checks: Column) -> Column:
    """Names of the checks that fail, in order; a null value passes."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))


def vote_ranges(score: Column, weight: Column, comment: Column, tolerance: Column, workers: Column, slots: Column) -> Column:
    """Requests beyond the allowed ranges: scores 0-1, weights 0-5, comments of 500 characters, tolerance 0-100, workers 1-10,
    slots 1-100."""
    return out_of_range(score=score.between(0, 1), peso=weight.between(0, 5), comentario=F.length(comment) <= 500, tolerancia=tolerance.between(0, 100), workers=workers.between(1, 10), slots=slots.between(1, 100))


def signature_summary(states: Column) -> Column:
    """(found, status, risk) of an array of box states."""
    count = lambda s: F.size(F.filter(states, lambda x: x == s))
    found, empty, unsure = count("PRESENT"), count("EMPTY"), count("INDETERMINATE")
    status = F.when(found == F.size(states), "COMPLETE").when(found == 0, "EMPTY").otherwise("INCOMPLETE")
    risk = F.when(found == F.size(states), 0).when(found == 0, 50).otherwise(15 * empty + 5 * unsure)
    return F.struct(found.alias("found"), status.alias("status"), risk.alias("risk"))


def consistency(votes: Column) -> Column:
    """Nulls are no numbers. Under three numbers: few_data; else the largest is the total, and the sum of those under
    90 % of it, if there are any, must be within 10 % of it. Integers throughout."""
    numbers = F.filter(votes, lambda n: n.isNotNull())
    total = F.array_max(numbers)
    parts = F.filter(numbers, lambda n: 10 * n < 9 * total)
    gap = F.abs(F.aggregate(parts, F.lit(0).cast("long"), lambda acc, n: acc + n) - total)
    return F.when(F.size(numbers) < 3, "few_data").when((F.size(parts) > 0) & (10 * gap > total), "inconsistent").otherwise("ok")


def thickness_band(ink: Column) -> Column:
    return F.when(ink < 0.02, 0.0).when(ink < 0.08, 0.2).when(ink < 0.20, 0.5).otherwise(1.0)


def blend(thick: Column, shape: Column, ink: Column) -> Column:
    """Upload blend 0.3 / 0.4 / 0.3 within 0 and 1, to four places."""
    return F.round(clamp(0.3 * thick + 0.4 * shape + 0.3 * ink), 4)


def digit_votes(slots: Column) -> Column:
    """Number of three digit slots; a null slot is 0."""
    return F.array_join(F.transform(slots, lambda s: F.coalesce(s.cast("string"), F.lit("0"))), "").cast("long")
