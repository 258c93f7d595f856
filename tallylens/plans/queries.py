"""Registered queries of the audit operators: each a DataFrame over the domain views, with its SQL for other engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallylens.functions import text as X
from tallylens.operators import comparison, consensus, layout, mutate, records, rollups, rules, vision, workqueue
from tallylens.sources import sinks

from . import views as V
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401 (read by the entry)

long = lambda c: F.col(c).cast("long").alias(c)


# --- arithmetic and completeness rules


@query("SELECT id, suma, excede, no_coincide, nivelacion, incompleta, firmas_bajas, qr_malo FROM flagged")
def capa0_flags(s, d):
    return rules.with_flags(V.actas(s, d)).select("id", "suma", "excede", "no_coincide", "nivelacion", "incompleta", "firmas_bajas", "qr_malo")


@query("SELECT id, acta_id, mesa_key, rule, score2, oficial, ciudadano, prioridad FROM found")
def capa0_findings(s, d):
    return rules.findings(V.actas(s, d)).select("id", "acta_id", "mesa_key", "rule", "score2", "oficial", "ciudadano", "prioridad")


@query("SELECT rule, count(*) n, count(CASE WHEN prioridad='alta' THEN 1 END) altas FROM found GROUP BY rule")
def capa0_findings_by_type(s, d):
    return rules.findings(V.actas(s, d)).groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("prioridad") == "alta").alias("altas"))


@query("SELECT id, CASE WHEN rule='aritmetica_excede_total' THEN 'alta' ELSE 'media' END prioridad FROM found")
def capa0_priority_alt(s, d):
    return rules.findings(V.actas(s, d), "excede").select("id", "prioridad")


_SUMMARY = """SELECT dep, dep_name, total_mesas, mesas_con_evidencia, total_discrepancias, por_verificar, verificadas_legitimas, verificadas_anomalas,
    (20000*(total_discrepancias-por_verificar)+greatest(total_discrepancias,1))//(2*greatest(total_discrepancias,1))/100.0 porcentaje_verificado,
    (20000*por_verificar+greatest(total_discrepancias,1))//(2*greatest(total_discrepancias,1))/100.0 porcentaje_por_verificar
    FROM (SELECT a.dep, any_value(g.dep_name) dep_name, count(DISTINCT a.mesa_key) total_mesas, count(DISTINCT e.mesa_key) mesas_con_evidencia, count(DISTINCT f.id) total_discrepancias,
        count(DISTINCT f.id) FILTER (WHERE f.estado='por_verificar') por_verificar, count(DISTINCT f.id) FILTER (WHERE f.estado='verificado_legitimo') verificadas_legitimas, count(DISTINCT f.id) FILTER (WHERE f.estado='verificado_anomalo') verificadas_anomalas
        FROM actas a LEFT JOIN geo g ON g.dep=a.dep LEFT JOIN evidence e ON e.mesa_key=a.mesa_key LEFT JOIN found f ON f.mesa_key=a.mesa_key GROUP BY a.dep)"""


@query(_SUMMARY)
def resumen_departamento(s, d):
    return rollups.department_summary_of(V.sheets(s, d), V.geo(s, d))


@query("SELECT id, mesa_key, dep FROM flagged f WHERE NOT excede AND NOT no_coincide AND NOT qr_malo AND NOT EXISTS (SELECT 1 FROM found x WHERE x.mesa_key=f.mesa_key AND x.estado IN ('por_verificar','verificado_anomalo'))")
def mesas_legitimas(s, d):
    return rollups.clean_sheets(V.sheets(s, d)).select("id", "mesa_key", "dep")


@query("SELECT dep, dep_name, zone FROM geo")
def divipola_join(s, d):
    return V.geo(s, d)


@query("SELECT mesa_key, id, excede, no_coincide, nivelacion FROM flagged")
def flags_listing(s, d):
    return rules.with_flags(V.actas(s, d)).select("mesa_key", "id", "excede", "no_coincide", "nivelacion").orderBy("mesa_key", "id")


# --- verdicts and risk, on integer cell scores (0-100)

_CELLS = "SELECT acta_id, count(*) cells, max(score) top, CAST(sum(score) AS BIGINT) sum_score, count(CASE WHEN score>50 THEN 1 END) suspicious FROM cells GROUP BY acta_id"
_STRUCTURE = "least(CASE WHEN cells<4 THEN 30 WHEN cells>12 THEN 20 ELSE 0 END + CASE WHEN acta_id%3<2 THEN 50 ELSE 0 END, 100)"
_POINTS = f"SELECT acta_id, (2*(30*{_STRUCTURE}*cells+25*sum_score+20*top*cells+2500*suspicious)+cells)//(2*cells) points FROM ({_CELLS})"
_VERDICT = f"SELECT acta_id, CAST(points AS BIGINT) points, CASE WHEN points<2900 THEN 'LEGITIMA' WHEN points<6000 THEN 'SOSPECHOSA' ELSE 'ILEGITIMA' END veredicto FROM ({_POINTS})"


def _verdicts(s, d):
    rows = rollups.cell_summary(V.cells(s, d))
    arith = rules.structure_score(F.col("cells"), F.col("acta_id") % 3)
    # in hundredths, so four decimals of a score of 0 to 1 are whole numbers
    points = rules.verdict_points(100 * arith, 100 * F.col("sum_score") / F.col("cells"), 100 * F.col("top"), 10000 * F.col("suspicious"), F.col("cells"))
    points = F.floor(F.round(points, 6) + 0.5).cast("long")
    return rows.select("acta_id", points.alias("points"), rules.verdict(points, 2900, 6000).alias("veredicto"))


@query(_CELLS)
def cell_summary(s, d):
    return rollups.cell_summary(V.cells(s, d))


@query(_VERDICT)
def verdict_classify(s, d):
    return _verdicts(s, d)


@query(f"SELECT count(*) total, count(CASE WHEN veredicto='LEGITIMA' THEN 1 END) legitimas, count(CASE WHEN veredicto='SOSPECHOSA' THEN 1 END) sospechosas, count(CASE WHEN veredicto='ILEGITIMA' THEN 1 END) ilegitimas FROM ({_VERDICT})")
def verdict_stats(s, d):
    return rollups.counts_by(_verdicts(s, d), "veredicto", {"legitimas": "LEGITIMA", "sospechosas": "SOSPECHOSA", "ilegitimas": "ILEGITIMA"})


@query(f"SELECT acta_id, veredicto FROM ({_VERDICT}) WHERE veredicto='SOSPECHOSA' ORDER BY acta_id LIMIT 20 OFFSET 20")
def verdict_filter_page(s, d):
    return rollups.page(rollups.filtered(_verdicts(s, d), veredicto="SOSPECHOSA"), ["acta_id"], 2, 20).select("acta_id", "veredicto")


@query(f"SELECT acta_id, coalesce(CASE WHEN acta_id%10=0 THEN 'REVISADA' END, veredicto) veredicto FROM ({_VERDICT})")
def verdict_override(s, d):
    rows = _verdicts(s, d).select("acta_id", "veredicto")
    return mutate.override(rows, rows.where("acta_id % 10 = 0").select("acta_id", F.lit("REVISADA").alias("veredicto")), "acta_id", "veredicto")


@query("SELECT CAST(id AS VARCHAR) id, mesa_key, estado, substr(strftime(creado_en,'%Y-%m-%d %H:%M:%S'),1,19) creado_en FROM actas")
def export_actas(s, d):
    rows = V.actas(s, d).withColumn("creado_en", F.date_format("creado_en", "yyyy-MM-dd HH:mm:ss"))
    return sinks.export_rows(rows, ["id", "mesa_key", "estado", "creado_en"], "creado_en")


@query("SELECT a.id, coalesce(n,0) cells, least(CASE WHEN coalesce(n,0)<4 THEN 30 WHEN n>12 THEN 20 ELSE 0 END + CASE WHEN paginas_total<2 THEN 50 ELSE 0 END, 100) score FROM actas a LEFT JOIN (SELECT acta_id, count(*)*(1+acta_id%3) n FROM cells GROUP BY acta_id) c ON c.acta_id=a.id")
def arith_structure_check(s, d):
    """Structure of sheets by their number of cells, some counted several times, and of pages."""
    n = V.cells(s, d).groupBy("acta_id").agg(F.count("*").alias("n")).select(F.col("acta_id").alias("id"), (F.col("n") * (1 + F.col("acta_id") % 3)).alias("cells"))
    rows = V.actas(s, d).select("id", "paginas_total").join(n, "id", "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
    return rows.select("id", "cells", rules.structure_score(F.col("cells"), F.col("paginas_total")).alias("score"))


_MATH = "SELECT id, concat_ws(',', CASE WHEN suma<>urna THEN 'SUM_MISMATCH' END, CASE WHEN c1-12<0 THEN 'NEGATIVE_VOTES' END, CASE WHEN c2*20>999 THEN 'EXCEEDS_3_DIGITS' END, CASE WHEN e11<>2 AND urna>e11-2 THEN 'OVERVOTE' END, CASE WHEN urna>0 AND c1-12+c2*20>urna THEN 'UNDERVOTE' END, CASE WHEN id%100<60 THEN 'LOW_OCR_CONFIDENCE' END) rules, suma<>urna a, c1-12<0 n, c2*20>999 x, e11<>2 AND urna>e11-2 v, urna>0 AND c1-12+c2*20>urna u, id%100<60 c, id%100 ocr, firmas FROM (SELECT *, suma-c1-c2+c1-12+c2*20 mate FROM flagged)"
_MATH = _MATH.replace("suma<>urna", "mate<>urna")  # sheets without a summary have sums of 0
_MATH = _MATH.replace("FROM (SELECT *, suma-c1-c2+c1-12+c2*20 mate FROM flagged)", "FROM (SELECT id, e11, firmas, c1, c2, CASE WHEN id%17=0 THEN 0 ELSE urna END urna, c1-12+c2*20+CASE WHEN id%17=0 THEN 0 ELSE blanco+nulos+no_marcados END mate FROM flagged)")


def _math(s, d):
    rows = rules.with_flags(V.actas(s, d))
    rows = rows.withColumns({c: F.when(F.col("id") % 17 != 0, F.col(c)) for c in ("urna", "blanco", "nulos", "no_marcados")})  # no summary
    votes = F.array(F.col("c1") - 12, F.col("c2") * 20)  # so that single candidates are negative or beyond three digits
    return rows.withColumn("rules", rules.math_rules(F.col("urna"), votes, F.col("blanco"), F.col("nulos"), F.col("no_marcados"), F.col("id") % 100, F.col("e11") - 2, low_ocr=60))


@query(f"SELECT id, rules FROM ({_MATH})")
def math_rules(s, d):
    return _math(s, d).select("id", F.array_join("rules", ",").alias("rules"))


@query(f"SELECT rule, count(*) n FROM (SELECT unnest(string_split(rules,',')) rule FROM ({_MATH}) WHERE rules<>'') GROUP BY rule")
def math_findings(s, d):
    return _math(s, d).select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


_RISK = f"SELECT id, least(100*(least(CASE WHEN a THEN 40 ELSE 0 END+CASE WHEN n THEN 40 ELSE 0 END+CASE WHEN x THEN 15 ELSE 0 END+CASE WHEN v THEN 35 ELSE 0 END+CASE WHEN u THEN 20 ELSE 0 END+CASE WHEN c THEN 15 ELSE 0 END,40)+(firmas-3)*10)+15*(100-ocr),10000)/100.0 risk FROM ({_MATH})"
_LEVEL = "CASE WHEN risk>=80 THEN 'CRITICAL' WHEN risk>=50 THEN 'HIGH' WHEN risk>=20 THEN 'MEDIUM' ELSE 'LOW' END"


def _risk(s, d):
    rows = _math(s, d)
    risk = rules.risk_score(F.col("rules"), (F.col("firmas") - 3) * 10, F.col("id") % 100 / 100)
    return rows.select("id", "creado_en", "estado", risk.alias("risk")).withColumn("level", rules.risk_level(F.col("risk")))


@query(f"SELECT id, CAST(round(risk*100) AS BIGINT) risk, {_LEVEL} level FROM ({_RISK})")
def risk_score(s, d):
    return _risk(s, d).select("id", F.round(F.col("risk") * 100).cast("long").alias("risk"), "level")


_BOX = "CASE WHEN {0}%4=0 THEN 'PRESENT' WHEN {0}%4=1 THEN 'PRESENT' WHEN {0}%4=2 THEN 'INDETERMINATE' ELSE 'EMPTY' END"
_BOXES = "SELECT id, " + ", ".join(f"{_BOX.format(c)} b{k}" for k, c in enumerate(("id", "(id/4-(id%4)*0)", "firmas"))) + " FROM actas"
_BOXES = _BOXES.replace("(id/4-(id%4)*0)", "((id-id%4)/4)").replace("((id-id%4)/4)", "(id+firmas)")


@query(f"SELECT id, found, CASE WHEN found=3 THEN 'COMPLETE' WHEN found=0 THEN 'EMPTY' ELSE 'INCOMPLETE' END status, CASE WHEN found=3 THEN 0 WHEN found=0 THEN 50 ELSE 15*e+5*i END risk FROM (SELECT id, {'+'.join(f'(CASE WHEN b{k}=' + chr(39) + 'PRESENT' + chr(39) + ' THEN 1 ELSE 0 END)' for k in range(3))} found, {'+'.join(f'(CASE WHEN b{k}=' + chr(39) + 'EMPTY' + chr(39) + ' THEN 1 ELSE 0 END)' for k in range(3))} e, {'+'.join(f'(CASE WHEN b{k}=' + chr(39) + 'INDETERMINATE' + chr(39) + ' THEN 1 ELSE 0 END)' for k in range(3))} i FROM ({_BOXES}))")
def signature_status(s, d):
    density = lambda c: F.when(c % 4 < 2, 0.2).when(c % 4 == 2, 0.1).otherwise(0.01)
    states = F.array(*[rules.ink_state(density(c)) for c in (F.col("id"), F.col("id") + F.col("firmas"), F.col("firmas"))])
    return V.actas(s, d).select("id", rules.signature_summary(states).alias("x")).select("id", "x.*")


@query("SELECT id, CASE WHEN len(v)<3 THEN 'few_data' WHEN len(p)>0 AND 10*abs(list_sum(p)-t)>t THEN 'inconsistent' ELSE 'ok' END state FROM (SELECT id, v, list_max(v) t, list_filter(v, lambda n: 10*n<9*list_max(v)) p FROM (SELECT id, list_filter([c1, c2, CASE WHEN id%3>0 THEN blanco END, CASE WHEN id%5>0 THEN urna END], lambda n: n IS NOT NULL) v FROM actas))")
def consistency_check(s, d):
    k = F.col("id")
    return V.actas(s, d).select("id", rules.consistency(F.array("c1", "c2", F.when(k % 3 > 0, F.col("blanco")), F.when(k % 5 > 0, F.col("urna")))).alias("state"))


# --- official rows against evidence

_BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mesa_key ORDER BY confianza DESC, creado_en, id) rn FROM evidence WHERE estado<>'rechazada_calidad' AND confianza IS NOT NULL) WHERE rn=1"
_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mesa_key ORDER BY creado_en DESC, id DESC) rn FROM actas) WHERE rn=1"
_FIELDS = "SELECT *, CAST(ciudadano-oficial AS BIGINT) diferencia, coalesce(abs(ciudadano-oficial)>2,false) discrepa, CASE WHEN abs(ciudadano-oficial)>20 THEN 'alta' WHEN abs(ciudadano-oficial)>5 THEN 'media' ELSE 'baja' END prioridad, least(abs(ciudadano-oficial)*2,100) puntos FROM (" + " UNION ALL ".join(f"SELECT o.mesa_key, '{f}' campo, CAST(o.{f} AS BIGINT) oficial, CAST(e.{f} AS BIGINT) ciudadano FROM lasts o JOIN bests e ON o.mesa_key=e.mesa_key" for f in comparison.FIELDS) + ") WHERE oficial IS NOT NULL OR ciudadano IS NOT NULL"
_CMP = f"SELECT * FROM (WITH bests AS ({_BEST}), lasts AS ({_LAST}) {_FIELDS})"


def _compared(s, d):
    return comparison.compared(V.actas(s, d), V.evidence(s, d), 2)


@query(f"SELECT mesa_key, id, confianza FROM ({_BEST})")
def comparison_best_evidence(s, d):
    return comparison.best_evidence(V.evidence(s, d)).select("mesa_key", "id", "confianza")


@query(f"SELECT mesa_key, id FROM ({_LAST})")
def latest_official(s, d):
    return comparison.latest(V.actas(s, d)).select("mesa_key", "id")


@query(f"SELECT mesa_key, campo, oficial, ciudadano, diferencia, discrepa FROM ({_CMP})")
def comparison_fields(s, d):
    return _compared(s, d).select("mesa_key", "campo", "oficial", "ciudadano", "diferencia", "discrepa")


_REASONS = "'Diferencia de '||coalesce(abs(diferencia),0)||' voto(s) en '||CASE campo " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in comparison.LABELS.items()) + " END||'. Oficial='||coalesce(CAST(oficial AS VARCHAR),'None')||', Ciudadano='||coalesce(CAST(ciudadano AS VARCHAR),'None')"


@query(f"SELECT mesa_key, campo campo_afectado, CAST(oficial AS VARCHAR) valor_oficial, CAST(ciudadano AS VARCHAR) valor_ciudadano, puntos score_capa0, {_REASONS} razon_flag, prioridad FROM ({_CMP}) WHERE discrepa")
def comparison_findings(s, d):
    """Findings of compared fields with their reasons."""
    return comparison.discrepancy_rows(_compared(s, d)).drop("tipo_anomalia", "estado")


@query(f"SELECT mesa_key, campo, diferencia, prioridad, puntos FROM ({_CMP}) WHERE discrepa")
def comparison_discrepancies(s, d):
    return _compared(s, d).where("discrepa").select("mesa_key", "campo", "diferencia", "prioridad", "puntos")


@query(f"SELECT mesa_key, count(*) comparados, count(CASE WHEN discrepa THEN 1 END) discrepancias, coalesce(max(CASE WHEN discrepa THEN puntos END),0) peor FROM ({_CMP}) GROUP BY mesa_key")
def comparison_summary(s, d):
    return comparison.summaries(_compared(s, d))


@query("SELECT k.mesa_key, CASE WHEN u IS NULL THEN 'sin_evidencia' WHEN u=0 THEN 'sin_datos' ELSE 'comparable' END status FROM (SELECT DISTINCT mesa_key FROM actas) k LEFT JOIN (SELECT mesa_key, max(CASE WHEN confianza IS NOT NULL THEN 1 ELSE 0 END) u FROM evidence WHERE estado<>'rechazada_calidad' GROUP BY mesa_key) e ON e.mesa_key=k.mesa_key")
def comparison_miss_status(s, d):
    a = V.actas(s, d)
    return comparison.statuses(a.select("mesa_key").distinct(), a, V.evidence(s, d))


@query(f"SELECT mesa_key, campo, diferencia FROM ({_CMP}) WHERE discrepa ORDER BY abs(diferencia) DESC, mesa_key, campo LIMIT 50")
def comparison_listing(s, d):
    return rollups.page(_compared(s, d).where("discrepa"), [F.abs("diferencia").desc(), "mesa_key", "campo"], 1, 50).select("mesa_key", "campo", "diferencia")


# --- consensus

_DUP = "SELECT *, row_number() OVER (PARTITION BY disc, voter ORDER BY ts, vote_id)>1 dup FROM votes"
_RUN = f"SELECT *, count(CASE WHEN NOT dup THEN 1 END) OVER w n, count(CASE WHEN NOT dup AND legit THEN 1 END) OVER w yes, count(*) OVER w seq FROM ({_DUP}) WINDOW w AS (PARTITION BY disc ORDER BY ts, vote_id ROWS UNBOUNDED PRECEDING)"
_STOP = f"SELECT *, min(CASE WHEN NOT dup AND n>=5 AND 100*greatest(yes,n-yes)>=80*n THEN seq END) OVER (PARTITION BY disc) stop FROM ({_RUN})"
_FATE = f"SELECT *, CASE WHEN stop IS NOT NULL AND seq>stop THEN 'frozen' WHEN dup THEN 'duplicate' ELSE 'accepted' END fate FROM ({_STOP})"


@query("SELECT disc, n, legitimos, votantes, CASE WHEN n>=5 AND 100*legitimos>=80*n THEN 'legitima' WHEN n>=5 AND 100*(n-legitimos)>=80*n THEN 'anomala' ELSE 'por_verificar' END estado FROM (SELECT disc, count(*) n, count(CASE WHEN legit THEN 1 END) legitimos, count(DISTINCT voter) votantes FROM votes GROUP BY disc)")
def consensus_snapshot(s, d):
    return consensus.snapshot(V.votes(s, d))


@query(f"SELECT disc, n, legitimos, c congelada, CASE WHEN NOT c THEN 'por_verificar' WHEN 100*legitimos>=80*n THEN 'legitima' ELSE 'anomala' END resultado FROM (SELECT disc, count(*) n, count(CASE WHEN legit THEN 1 END) legitimos, bool_or(stop IS NOT NULL) c FROM ({_FATE}) WHERE fate='accepted' GROUP BY disc)")
def consensus_freeze(s, d):
    return consensus.frozen(V.votes(s, d)).select("disc", "n", "legitimos", "congelada", "resultado")


@query(f"SELECT vote_id, disc, fate FROM ({_FATE}) WHERE fate<>'accepted'")
def consensus_rejected_votes(s, d):
    return consensus.judged(V.votes(s, d)).where("fate <> 'accepted'").select("vote_id", "disc", "fate")


@query("SELECT (SELECT count(*) FROM found) hallazgos, (SELECT count(*) FROM found WHERE congelada) congelados, (SELECT count(*) FROM votes) votos, (SELECT count(DISTINCT voter) FROM votes) votantes")
def consensus_summary(s, d):
    one = V.found(s, d).agg(F.count("*").alias("hallazgos"), F.count_if("congelada").alias("congelados"))
    return one.join(V.votes(s, d).agg(F.count("*").alias("votos"), F.countDistinct("voter").alias("votantes")), F.lit(True))


_WEIGHED = "SELECT disc, count(*) FILTER (WHERE live AND legit) confirma, count(*) FILTER (WHERE live AND NOT legit) rechaza, round(coalesce(sum(w) FILTER (WHERE live AND legit),0),2) peso_confirma, round(coalesce(sum(w) FILTER (WHERE live AND NOT legit),0),2) peso_rechaza FROM (SELECT disc, legit, vote_id%7<>0 live, (50+vote_id%150)/100.0::DOUBLE w FROM votes) GROUP BY disc"
_DECIDED = f"SELECT *, confirma+rechaza n, CASE WHEN confirma+rechaza>=6 AND confirma::DOUBLE/(confirma+rechaza)>=0.8::DOUBLE THEN 'verificado_legitimo' WHEN confirma+rechaza>=6 AND rechaza::DOUBLE/(confirma+rechaza)>=0.8::DOUBLE THEN 'verificado_anomalo' END estado FROM ({_WEIGHED})"


@query(f"SELECT disc, confirma, rechaza, peso_confirma, peso_rechaza, n, estado, CASE estado WHEN 'verificado_legitimo' THEN 'Consenso legítimo: '||confirma||'/'||n||' ≥ 80%' WHEN 'verificado_anomalo' THEN 'Consenso anómalo: '||rechaza||'/'||n||' ≥ 80%' ELSE '' END razon FROM ({_DECIDED})")
def consensus_weighed(s, d):
    """Annulled votes left out, weights summed, thresholds from a configuration without the second."""
    config = s.createDataFrame([("umbral_min_votos", "6"), ("umbral_consenso_pct", "")], "clave string, valor string")
    k = F.col("vote_id")
    return consensus.weighed(V.votes(s, d).withColumns({"anulado": k % 7 == 0, "peso": (50 + k % 150) / 100}), config)


@query("SELECT vote_id, legit FROM votes WHERE disc=3")
def discrepancy_status(s, d):
    return V.votes(s, d).where("disc = 3").orderBy(F.desc("ts"), F.desc("vote_id")).select("vote_id", "legit")


@query("SELECT id, mesa_key, prioridad FROM found WHERE estado='por_verificar' AND NOT congelada ORDER BY CASE WHEN prioridad='alta' THEN 1 WHEN prioridad='media' THEN 2 ELSE 3 END, creado_en, id LIMIT 50 OFFSET 10")
def pending_queue(s, d):
    return consensus.pending(V.found(s, d), 50, 10).select("id", "mesa_key", "prioridad")


# --- queues

_QUEUE = "SELECT id, id acta_id, id%3 capa, CASE id%4 WHEN 0 THEN 'pendiente' WHEN 1 THEN 'procesando' WHEN 2 THEN 'completado' ELSE 'error' END estado, id%3 intentos, creado_en FROM actas WHERE id%2=0 OR id%5=0"


def _queue(s, d):
    k = F.col("id") % 4
    state = F.when(k == 0, "pendiente").when(k == 1, "procesando").when(k == 2, "completado").otherwise("error")
    return V.actas(s, d).where("id % 2 = 0 or id % 5 = 0").select("id", F.col("id").alias("acta_id"), (F.col("id") % 3).alias("capa"), state.alias("estado"), (F.col("id") % 3).alias("intentos"), "creado_en")


@query(f"SELECT id FROM actas WHERE id NOT IN (SELECT acta_id FROM ({_QUEUE}))")
def queue_enqueue(s, d):
    return workqueue.enqueue(V.actas(s, d), _queue(s, d)).select("id")


@query(f"SELECT id, capa, CAST((r-1)%4 AS BIGINT) worker FROM (SELECT *, row_number() OVER (PARTITION BY capa ORDER BY creado_en, id) r FROM ({_QUEUE}) WHERE estado='pendiente') WHERE r<=40")
def queue_claim(s, d):
    return workqueue.claims(_queue(s, d), 4, 10).withColumn("worker", F.col("worker").cast("long"))


@query(f"SELECT id, CASE WHEN id%7<>0 THEN 'completado' WHEN intentos+1>=3 THEN 'error' ELSE 'pendiente' END estado FROM ({_QUEUE})")
def queue_transition(s, d):
    return _queue(s, d).select("id", workqueue.transition(F.col("id") % 7 != 0, F.col("intentos")).alias("estado"))


@query(f"SELECT capa, count(*) total, count(CASE WHEN estado='pendiente' THEN 1 END) pendientes, count(CASE WHEN estado='procesando' THEN 1 END) procesando, count(CASE WHEN estado='error' THEN 1 END) errores FROM ({_QUEUE}) GROUP BY capa")
def queue_status(s, d):
    return rollups.counts_by(_queue(s, d), "estado", {"pendientes": "pendiente", "procesando": "procesando", "errores": "error"}, ["capa"])


@query("SELECT id, CASE id%6 WHEN 0 THEN 60 WHEN 1 THEN 120 WHEN 2 THEN 240 WHEN 3 THEN 480 ELSE 600 END delay FROM actas")
def retry_backoff(s, d):
    return V.actas(s, d).select("id", workqueue.backoff(F.col("id") % 6).alias("delay"))


@query(f"SELECT id, substr('failed slot '||CAST(id AS VARCHAR), 1, 14) problem FROM ({_QUEUE}) WHERE estado='error' AND intentos>=2")
def dead_letters(s, d):
    return _queue(s, d).where("estado = 'error' and intentos >= 2").select("id", X.cut(F.concat(F.lit("failed slot "), F.col("id").cast("string")), 14).alias("problem"))


# --- tables, downloads, universe


@query("SELECT id, dep, muni, status FROM tables WHERE muni='003' AND status='pending' ORDER BY id LIMIT 25")
def tables_filter(s, d):
    return rollups.page(rollups.filtered(V.tables(s, d), dep=None, muni="003", status="pending"), ["id"], 1, 25).select("id", "dep", "muni", "status")


@query("SELECT id FROM tables WHERE contains(lower(p_name),'#1') OR contains(lower(p_brand),'#1') OR contains(lower(p_type),'#1')")
def tables_search(s, d):
    return rollups.searched(V.tables(s, d), "#1", ["p_name", "p_brand", "p_type"]).select("id")


@query("SELECT count(*) total, count(CASE WHEN status='cached' THEN 1 END) cached, count(CASE WHEN status='error' THEN 1 END) errors, CAST(coalesce(sum(CASE WHEN status='cached' THEN size_bytes END),0) AS BIGINT) bytes FROM tables")
def tables_stats(s, d):
    return V.tables(s, d).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "cached").alias("cached"), F.count_if(F.col("status") == "error").alias("errors"), F.coalesce(F.sum(F.when(F.col("status") == "cached", F.col("size_bytes"))), F.lit(0)).alias("bytes"))


@query("SELECT dep, muni, count(*) n FROM tables WHERE status IN ('pending','error') GROUP BY dep, muni ORDER BY n DESC, dep, muni LIMIT 100")
def municipality_dispatch(s, d):
    return V.tables(s, d).where(F.col("status").isin("pending", "error")).groupBy("dep", "muni").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dep", "muni").limit(100)


@query("SELECT dep, muni, count(*) n FROM tables WHERE status='error' AND hours_ago<=24 GROUP BY dep, muni")
def retry_failed(s, d):
    return V.tables(s, d).where("status = 'error' and hours_ago <= 24").groupBy("dep", "muni").agg(F.count("*").alias("n"))


@query("SELECT dep, count(DISTINCT muni) munis, count(CASE WHEN status='cached' THEN 1 END) downloaded, count(CASE WHEN status='error' THEN 1 END) failed FROM tables GROUP BY dep")
def department_rollup(s, d):
    return V.tables(s, d).groupBy("dep").agg(F.countDistinct("muni").alias("munis"), F.count_if(F.col("status") == "cached").alias("downloaded"), F.count_if(F.col("status") == "error").alias("failed"))


@query("SELECT id, CASE WHEN expires_in<0 AND status='cached' THEN NULL ELSE expires_in END expires_in, expires_in<0 AND status='cached' evicted FROM tables")
def evict_expired(s, d):
    out = (F.col("expires_in") < 0) & (F.col("status") == "cached")
    return V.tables(s, d).select("id", F.when(~out, F.col("expires_in")).alias("expires_in"), out.alias("evicted"))


@query("SELECT id, CASE WHEN status='cached' AND expires_in>0 THEN 'HIT' ELSE 'MISS' END cache FROM tables")
def cache_hit_miss(s, d):
    return V.tables(s, d).select("id", F.when((F.col("status") == "cached") & (F.col("expires_in") > 0), "HIT").otherwise("MISS").alias("cache"))


@query("SELECT id, lpad(CAST(id%7 AS VARCHAR),3,'0') code, CASE WHEN length(CAST(id AS VARCHAR))<3 THEN lpad(CAST(id AS VARCHAR),3,'0') ELSE CAST(id AS VARCHAR) END whole FROM tables")
def zfill_codes(s, d):
    return V.tables(s, d).select("id", X.zfill(F.col("id") % 7, 3).alias("code"), X.zfill(F.col("id"), 3).alias("whole"))


@query("SELECT id, 'https://example.org/e14/'||dep||'/'||muni||'/001/01/'||lpad(CAST(id%90 AS VARCHAR),3,'0')||'/'||CAST(id AS VARCHAR)||'.pdf' url FROM tables")
def url_build(s, d):
    return V.tables(s, d).select("id", X.pdf_url("https://example.org/e14/", F.col("dep"), F.col("muni"), F.lit("1"), F.lit("1"), F.col("id") % 90, F.col("id").cast("string")).alias("url"))


@query("SELECT coalesce(o.id,n.id) id, CASE WHEN n.id IS NOT NULL THEN n.v ELSE o.v END v, CASE WHEN n.id IS NOT NULL THEN coalesce(n.t,o.t) ELSE o.t END t, CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'inserted' ELSE 'updated' END op FROM (SELECT id, size_bytes v, status t FROM tables WHERE id%3<>0) o FULL JOIN (SELECT id, size_bytes+1 v, CASE WHEN id%4=0 THEN NULL ELSE 'new' END t FROM tables WHERE id%2=0) n ON o.id=n.id")
def upsert_merge(s, d):
    t = V.tables(s, d)
    old = t.where("id % 3 <> 0").select("id", F.col("size_bytes").alias("v"), F.col("status").alias("t"))
    new = t.where("id % 2 = 0").select("id", (F.col("size_bytes") + 1).alias("v"), F.when(F.col("id") % 4 != 0, "new").alias("t"))
    return mutate.upsert(old, new, ["id"], ("t",))


@query("SELECT * FROM (VALUES ('umbral_consenso_pct','0.80','inserted'),('umbral_min_votos','7','updated'),('capa1_score','0.6','kept')) t(clave,valor,op)")
def config_upsert(s, d):
    old = s.createDataFrame([("umbral_min_votos", "5"), ("capa1_score", "0.6")], "clave string, valor string")
    return mutate.upsert(old, s.createDataFrame([("umbral_min_votos", "7"), ("umbral_consenso_pct", "0.80")], old.schema), ["clave"])


@query("SELECT id, dep, CAST(floor((r-1)/50) AS BIGINT) batch FROM (SELECT id, dep, row_number() OVER (PARTITION BY dep ORDER BY id) r FROM actas WHERE id%4<>0)")
def unanalyzed_batches(s, d):
    a = V.actas(s, d).select("id", "dep")
    return workqueue.batches(a.join(a.where("id % 4 = 0").select("id"), "id", "left_anti"), "dep")


@query(f"SELECT id, CAST(risk AS DOUBLE) risk FROM ({_RISK}) ORDER BY risk DESC, id LIMIT 100")
def risk_review_queue(s, d):
    return rollups.page(_risk(s, d), [F.desc("risk"), "id"], 1, 100).select("id", "risk")


@query("SELECT CAST(creado_en AS DATE) dia, count(*) total, count(CASE WHEN prioridad='alta' THEN 1 END) altas FROM found GROUP BY 1")
def anomalies_over_time(s, d):
    return V.found(s, d).groupBy(F.to_date("creado_en").alias("dia")).agg(F.count("*").alias("total"), F.count_if(F.col("prioridad") == "alta").alias("altas"))


@query(f"SELECT count(*) total, count(CASE WHEN level='CRITICAL' THEN 1 END) critical, count(CASE WHEN level='HIGH' THEN 1 END) high, count(CASE WHEN level='MEDIUM' THEN 1 END) medium, count(CASE WHEN level='LOW' THEN 1 END) low FROM (SELECT {_LEVEL} level FROM ({_RISK}))")
def dashboard_levels(s, d):
    return rollups.counts_by(_risk(s, d), "level", {"critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "low": "LOW"})


@query(f"SELECT count(CASE WHEN risk<=20 THEN 1 END) le_20, count(CASE WHEN risk<=50 THEN 1 END) le_50, count(CASE WHEN risk<=80 THEN 1 END) le_80 FROM ({_RISK})")
def analysis_stats(s, d):
    return rollups.histogram(_risk(s, d), "risk", [20, 50, 80])


# --- calibration and reports

_GRID = "SELECT t, tp, fp, fn, tn, CAST(CASE WHEN 2*tp+fp+fn>0 THEN floor(20000*tp/(2*tp+fp+fn)) ELSE 0 END AS BIGINT) f1, CASE WHEN tp+fp>0 THEN tp::DOUBLE/(tp+fp) ELSE 0 END AS \"precision\", CASE WHEN tp+fn>0 THEN tp::DOUBLE/(tp+fn) ELSE 0 END AS recall, CASE WHEN tp+fp+fn+tn>0 THEN (tp+tn)::DOUBLE/(tp+fp+fn+tn) ELSE 0 END AS accuracy FROM (SELECT t, CAST(sum(CASE WHEN score>=t AND bad THEN 1 ELSE 0 END) AS BIGINT) tp, CAST(sum(CASE WHEN score>=t AND NOT bad THEN 1 ELSE 0 END) AS BIGINT) fp, CAST(sum(CASE WHEN score<t AND bad THEN 1 ELSE 0 END) AS BIGINT) fn, CAST(sum(CASE WHEN score<t AND NOT bad THEN 1 ELSE 0 END) AS BIGINT) tn FROM (SELECT CAST(n_chars%97 AS BIGINT) score, quality=0 bad FROM labels l JOIN documents d ON d.doc_id=l.doc_id), (SELECT unnest(range(5,70)) t) GROUP BY t)"


def _grid(s, d):
    rows = V.load(s, d, "labels").join(V.load(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("n_chars") % 97).alias("score"), (F.col("quality") == 0).alias("bad"))
    return rollups.confusion(rows, s.range(5, 70).withColumnRenamed("id", "t"))


@query(_GRID)
def calibration_grid(s, d):
    return _grid(s, d)


@query(f"SELECT t, f1 FROM ({_GRID}) ORDER BY f1 DESC, t LIMIT 5")
def calibration_best(s, d):
    return _grid(s, d).orderBy(F.desc("f1"), "t").limit(5).select("t", "f1")


@query("SELECT count(*) actas, CAST(floor(count(CASE WHEN excede THEN 1 END)*100/greatest(count(*),1)) AS BIGINT) excede_pct, min(suma) menor, max(suma) mayor FROM flagged")
def report_corpus(s, d):
    return rules.with_flags(V.actas(s, d)).agg(F.count("*").alias("actas"), F.floor(F.count_if("excede") * 100 / F.greatest(F.count("*"), F.lit(1))).cast("long").alias("excede_pct"), F.min("suma").alias("menor"), F.max("suma").alias("mayor"))


@query(f"SELECT acta_id, top, sum_score FROM ({_CELLS}) ORDER BY top DESC, sum_score DESC, acta_id LIMIT 10")
def report_top10(s, d):
    return rollups.cell_summary(V.cells(s, d)).orderBy(F.desc("top"), F.desc("sum_score"), "acta_id").limit(10).select("acta_id", "top", "sum_score")


@query("SELECT event_id FROM events WHERE json_extract_string(CASE WHEN event_id%3=0 THEN props ELSE '{}' END,'$.k') IS NULL")
def vlm_pending(s, d):
    answers = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise("{}")
    return V.load(s, d, "events").where(F.get_json_object(answers, "$.k").isNull()).select("event_id")



_ANSWER = "SELECT event_id, event_id%100/100.0::DOUBLE c, CASE event_id%4 WHEN 0 THEN 'Tachón, borrón' WHEN 1 THEN 'mancha' END names FROM events WHERE event_id%3<>0"


@query(f"SELECT event_id, 'm'||event_id mesa_key, 'celda_'||event_id%10 campo, CASE WHEN event_id%4=0 THEN 'tachon_sobreescritura' ELSE 'trazo_anomalo' END tipo, c score, coalesce(names, 'VLM confidence: '||printf('%.2f',c)) razon, CASE WHEN c>0.85::DOUBLE THEN 'alta' ELSE 'media' END prioridad FROM ({_ANSWER}) WHERE names IS NOT NULL OR c>=0.5::DOUBLE")
def vlm_findings(s, d):
    """Answers of one cell each, every third no JSON."""
    k = F.col("event_id")
    names = F.when(k % 4 == 0, F.array(F.lit("Tachón"), F.lit("borrón"))).when(k % 4 == 1, F.array(F.lit("mancha"))).otherwise(F.array().cast("array<string>"))
    cell = F.struct((k % 10).alias("cell_index"), names.alias("anomalies"), (k % 100 / 100).alias("confidence"))
    raw = F.when(k % 3 == 0, "no json").otherwise(F.to_json(F.struct(F.concat(F.lit("m"), k).alias("mesa_key"), F.array(cell).alias("resultados"))))
    return records.answer_findings(V.load(s, d, "events"), raw, "event_id")


@query("SELECT acta_id, idx, score, x FROM (SELECT *, row_number() OVER (PARTITION BY acta_id ORDER BY score DESC, idx, x) r FROM (SELECT DISTINCT * FROM cells)) WHERE r<=5")
def vlm_top_cells(s, d):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("acta_id").orderBy(F.desc("score"), "idx", "x"))
    return V.cells(s, d).distinct().withColumn("r", rank).where("r <= 5").drop("r")


# --- layout

_NEAR = "SELECT page, lid, rid, dist FROM (SELECT l.page, l.id lid, r.id rid, abs(l.y-r.y) dist, row_number() OVER (PARTITION BY l.page, l.id ORDER BY abs(l.y-r.y), r.y, r.id) rn FROM det l JOIN det r ON l.page=r.page AND l.text='VOTACION' AND r.text LIKE 'VOTOS%' AND abs(l.y-r.y)<300) WHERE rn=1"


@query(f"SELECT l.page, l.id lid, n.rid, CAST(n.dist AS BIGINT) dist FROM det l LEFT JOIN ({_NEAR}) n ON n.page=l.page AND n.lid=l.id WHERE l.text='VOTACION'")
def nearest_vote_row(s, d):
    det = V.det(s, d)
    left = det.where("text = 'VOTACION'").select("page", F.col("id").alias("lid"), "y")
    right = det.where("text like 'VOTOS%'").select("page", F.col("id").alias("rid"), F.col("y").alias("ry"))
    return layout.nearest(left, right, "page", 300).select("page", "lid", "rid", long("dist"))


def _first(where):
    return f"SELECT page, id FROM (SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY id) rn FROM det WHERE {where}) WHERE rn=1"


@query(_first("text LIKE '%VOT%' AND abs(y-400)<=200"))
def band_header(s, d):
    return layout.first_in_band(V.det(s, d), "page", F.contains("text", F.lit("VOT")), 400, 200).select("page", "id")


@query(_first("upper(text) LIKE '%TOTAL%'"))
def keyword_anchor(s, d):
    return layout.first_in_band(V.det(s, d), "page", F.contains(F.upper("text"), F.lit("TOTAL")), 0, 10**6).select("page", "id")


@query(f"SELECT page, id, CAST(prio AS INTEGER) prio FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY prio, id) rn FROM (SELECT *, 0 prio FROM ({_first(chr(116) + 'ext=' + chr(39) + 'VOTACION' + chr(39) + ' AND abs(y-500)<=80')}) UNION ALL SELECT *, 1 prio FROM ({_first('text LIKE ' + chr(39) + 'VOTOS%' + chr(39) + ' AND abs(y-500)<=80')}) UNION ALL SELECT *, 2 prio FROM ({_first('x>540 AND abs(y-500)<=100')}))) WHERE rn=1")
def header_ladder(s, d):
    det = V.det(s, d)
    pick = lambda hit, tolerance: layout.first_in_band(det, "page", hit, 500, tolerance).select("page", "id")
    steps = [pick(F.col("text") == "VOTACION", 80), pick(F.col("text").startswith("VOTOS"), 80), pick(F.col("x") > 540, 100)]
    return layout.ladder(steps, "page").select("page", "id", "prio")


@query("SELECT page, id, greatest(x-15,0) x0, greatest(y-15,0) y0, least(x+w+15,900) x1, least(y+40+15,2000) y1 FROM det")
def cell_derivation(s, d):
    box = layout.padded_box(F.col("x"), F.col("y"), F.col("w"), F.lit(40), 15, F.lit(900), F.lit(2000))
    return V.det(s, d).select("page", "id", box.alias("b")).select("page", "id", "b.*")


@query("SELECT page, min(i) first, max(i) last FROM (SELECT *, sum(nw) OVER (PARTITION BY page ORDER BY i) seg FROM (SELECT *, CASE WHEN i-lag(i) OVER (PARTITION BY page ORDER BY i)<=2 THEN 0 ELSE 1 END nw FROM (SELECT user_id page, event_id i FROM events WHERE event_id%7<>0 AND event_id%3<>0))) GROUP BY page, seg HAVING max(i)-min(i)>=1")
def row_segments(s, d):
    rows = V.load(s, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("i"))
    return layout.segments(rows, "page", (F.col("i") % 7 != 0) & (F.col("i") % 3 != 0), 2, 1).select("page", "first", "last")


@query("SELECT page, count(CASE WHEN 10*(least(x+w,x2+w2)-x2)>3*least(w,w2) THEN 1 END) n_overlaps FROM (SELECT *, lead(x) OVER p x2, lead(w) OVER p w2 FROM det WINDOW p AS (PARTITION BY page ORDER BY x, id)) GROUP BY page")
def contour_overlap(s, d):
    return layout.neighbour_overlaps(V.det(s, d), "page")


_TOP = "SELECT page, id, y, x, w, text, conf, row_number() OVER (PARTITION BY page ORDER BY y, id) rn FROM det"
_FOLD = f"SELECT * FROM (WITH RECURSIVE top AS ({_TOP}), fold AS (SELECT page, id, rn, y y0, 0 AS \"cluster\" FROM top WHERE rn=1 UNION ALL SELECT t.page, t.id, t.rn, CASE WHEN t.y-f.y0<=60 THEN f.y0 ELSE t.y END, CASE WHEN t.y-f.y0<=60 THEN f.\"cluster\" ELSE f.\"cluster\"+1 END FROM fold f JOIN top t ON t.page=f.page AND t.rn=f.rn+1) SELECT t.*, f.\"cluster\" FROM top t JOIN fold f ON f.page=t.page AND f.rn=t.rn)"


@query(f"SELECT page, CAST(\"cluster\" AS INTEGER) AS \"cluster\", b.id, b.y, b.x, b.w, b.text, b.conf::DOUBLE conf, texts all_texts FROM (SELECT page, \"cluster\", list({{'id':id,'y':y,'x':x,'w':w,'text':text,'conf':conf}} ORDER BY conf DESC, rn)[1] b, string_agg(text, '|' ORDER BY rn) texts FROM ({_FOLD}) GROUP BY page, \"cluster\")")
def cluster_rows(s, d):
    """Rows of detections with the best one and all texts of each."""
    return layout.cluster_rows(V.det(s, d), "page", 60).withColumn("all_texts", F.array_join("all_texts", "|"))


@query(f"SELECT page, id, CAST(\"cluster\" AS INTEGER) AS \"cluster\" FROM ({_FOLD})")
def anchored_clusters(s, d):
    return layout.anchored_clusters(V.det(s, d), "page", 60)


# --- rates

_REQ = "SELECT user_id k, event_id id, CAST(floor(epoch(ts)) AS BIGINT) t FROM events"


def _requests(s, d):
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return V.load(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), seconds.alias("t"))


@query(f"SELECT id, count(*) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) load FROM ({_REQ})")
def sliding_load(s, d):
    return workqueue.sliding_load(_requests(s, d), 86400).select("id", "load")


@query(f"SELECT id, CAST(20000*i+max(t-20000*i) OVER (PARTITION BY k ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) start FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, id)-1 i FROM ({_REQ}))")
def min_interval_schedule(s, d):
    return workqueue.spaced(_requests(s, d), 20000).select("id", F.col("start").cast("long").alias("start"))


@query()
def token_bucket(s, d):
    return workqueue.token_bucket(_requests(s, d), 1 / 3600, 3.0)


# --- records


@query("SELECT event_id, CASE WHEN event_id%5=0 THEN 'missing' WHEN event_id%5=1 THEN 'mismatch' ELSE 'match' END state FROM events")
def qr_match(s, d):
    key = F.concat(F.lit("M-"), F.col("user_id").cast("string"), F.lit("-"))
    payload = F.when(F.col("event_id") % 5 == 1, F.lit("other")).when(F.col("event_id") % 5 > 1, F.concat(F.lit("QR:"), key, F.lit("PRE")))
    return V.load(s, d, "events").select("event_id", records.qr_state(payload, key).alias("state"))


@query("SELECT doc_id, TRY_CAST(nullif(regexp_extract(text,'[0-9]+',0),'') AS BIGINT) number FROM documents")
def ocr_digits(s, d):
    return V.load(s, d, "documents").select("doc_id", records.first_integer(F.col("text")).alias("number"))


@query("SELECT page, coalesce(string_agg(CASE WHEN conf>30 THEN text END, ' ' ORDER BY id),'') text, coalesce(round(avg(CASE WHEN conf>30 THEN conf END),2),0) confidence, CAST(count(CASE WHEN conf>30 THEN 1 END) AS INTEGER) words FROM det GROUP BY page")
def ocr_words(s, d):
    """Words that share an id stand as in the table's files, as SQL sorts them in one thread."""
    return records.recognised(V.det(s, d, placed=True), "page", "id", "file_name", "row_index")


@query("SELECT doc_id, CAST(len(list_filter(string_split(text,chr(10)), lambda x: trim(x)<>'')) AS INTEGER) lines FROM documents")
def ocr_lines(s, d):
    return V.load(s, d, "documents").select("doc_id", records.non_empty_lines(F.col("text")).alias("lines"))


@query("SELECT id, 'a '||dep departamento, CASE WHEN id%3=0 THEN 'municipio '||muni ELSE '' END municipio, CASE WHEN id%2=0 THEN 'z'||id%9 ELSE '' END zona, CASE WHEN id%2=0 THEN '' ELSE 'p'||id%9 END puesto, mesa_key mesa FROM actas")
def ocr_header(s, d):
    """Header lines with a repeated keyword, one without a colon, and two keywords in a line."""
    k = F.col("id")
    lines = F.array(F.lit("Departamento: x"), F.concat(F.lit("DEPARTAMENTO zona: a "), "dep"), F.when(k % 3 == 0, F.concat(F.lit("municipio "), "muni")).otherwise(""), F.when(k % 2 == 0, F.concat(F.lit("Zona : z"), k % 9)).otherwise(F.concat(F.lit("PUESTO: p"), k % 9)), F.lit("mesa sin dato"), F.concat(F.lit("Mesa: n: "), "mesa_key"))
    return V.actas(s, d).select("id", records.header_fields(lines).alias("x")).select("id", "x.*")


_DIGIT = "CASE WHEN {x}<0.02::DOUBLE THEN NULL " + " ".join(f"WHEN {{x}}<{a}::DOUBLE THEN {{{k}}}" for k, (a, _, _) in enumerate(rules.DIGITS)) + " ELSE {9} END"
_SLOT = _DIGIT.format(*[n for _, n, _ in rules.DIGITS], 8, x="x"), _DIGIT.format(*[f"round({c}::DOUBLE*least(x/0.10::DOUBLE,1),4)" for *_, c in rules.DIGITS], "round(0.6::DOUBLE*least(x/0.10::DOUBLE,1),4)", x="x")


@query(f"SELECT acta_id, idx, place, {_SLOT[0]} digit, coalesce({_SLOT[1]},0) confidence FROM (SELECT acta_id, idx, x place, score/200.0::DOUBLE x FROM cells)")
def digit_bands(s, d):
    slot = rules.slot_digit(F.col("score") / 200)
    return V.cells(s, d).select("acta_id", "idx", F.col("x").alias("place"), slot.alias("slot")).select("acta_id", "idx", "place", "slot.digit", "slot.confidence")


@query(f"SELECT id, CAST(sum(coalesce(({_SLOT[0]}),0)*w) AS BIGINT) votos, CAST(round(sum(coalesce(({_SLOT[1]}),0))*10000/3) AS BIGINT) confianza FROM (SELECT id, 100 w, (c1%45)/100.0::DOUBLE x FROM actas UNION ALL SELECT id, 10, (c2%45)/100.0::DOUBLE FROM actas UNION ALL SELECT id, 1, (blanco%45)/100.0::DOUBLE FROM actas) GROUP BY id")
def digit_slots(s, d):
    """Three slots to a number of votes, and the mean confidence in ten-thousandths."""
    slots = F.array(*[rules.slot_digit(F.col(c) % 45 / 100) for c in ("c1", "c2", "blanco")])
    rows = V.actas(s, d).select("id", slots.alias("slots"))
    return rows.select("id", rules.digit_votes(F.col("slots.digit")).alias("votos"), F.round(rules.slots_confidence(F.col("slots")) * 10000).cast("long").alias("confianza"))


_SHEET = "SELECT id, CASE WHEN len(a)=0 THEN 0::DOUBLE ELSE least(list_max(a)+0.1::DOUBLE*len(a),1) END p FROM (SELECT id, list_filter([CASE WHEN id%40>15 THEN least(id%40/25::DOUBLE,1) END, CASE WHEN id%50/1000::DOUBLE<0.02::DOUBLE THEN 0.9::DOUBLE END, CASE WHEN id%4=1 THEN 0.8::DOUBLE WHEN id%4=2 THEN 0.95::DOUBLE END], lambda v: v IS NOT NULL) a FROM actas)"


@query(f"SELECT id, round(p,2) score, CASE WHEN p>0.7::DOUBLE THEN 'FRAUDE' WHEN p>0.3::DOUBLE THEN 'SOSPECHOSO' ELSE 'LIMPIO' END verdict FROM ({_SHEET})")
def sheet_verdict(s, d):
    k = F.col("id")
    state = F.when(k % 4 == 1, "few_data").when(k % 4 == 2, "inconsistent").otherwise("ok")
    return V.actas(s, d).select("id", rules.sheet_score(rules.visual_anomalies(k % 40, k % 50 / 1000, state)).alias("x")).select("id", "x.*")


_BLEND = "SELECT mesa_key, campo, g, p, q, 0.3::DOUBLE*g+0.4::DOUBLE*p+0.3::DOUBLE*q score FROM (SELECT mesa_key, 'c'||id campo, c1%101/100.0::DOUBLE g, (c2*7)%101/100.0::DOUBLE p, (id*31)%101/100.0::DOUBLE q FROM actas)"


@query(f"SELECT acta_id, b.mesa_key, campo, score, 'Capa1: grosor='||printf('%.2f',g)||', separador='||printf('%.2f',p)||', tinta='||printf('%.2f',q) razon, CASE WHEN score>=0.85::DOUBLE THEN 'alta' ELSE 'media' END prioridad FROM ({_BLEND}) b JOIN (SELECT mesa_key, max(id) acta_id FROM actas WHERE id%6<>0 GROUP BY mesa_key) a ON a.mesa_key=b.mesa_key WHERE score>=0.6::DOUBLE")
def capa1_findings(s, d):
    """Scored cells to findings; some mesas have no sheet."""
    a, k = V.actas(s, d), F.col("id")
    scores = a.select("mesa_key", F.concat(F.lit("c"), k).alias("campo"), (F.col("c1") % 101 / 100).alias("grosor"), (F.col("c2") * 7 % 101 / 100).alias("separador"), (k * 31 % 101 / 100).alias("tinta"))
    return rules.score_findings(scores, a.where("id % 6 <> 0"))


@query("SELECT a.id, coalesce(n,0) n, coalesce(scores,'') scores FROM actas a LEFT JOIN (SELECT acta_id, count(*) n, string_agg(CAST(idx AS VARCHAR)||':'||CAST(score AS VARCHAR), ',' ORDER BY idx, score) scores FROM cells GROUP BY acta_id) c ON c.acta_id=a.id")
def acta_cells(s, d):
    """Every sheet with its cells and their number, none where it has none."""
    cells = V.cells(s, d).groupBy("acta_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "score"))).alias("c"))
    text = F.array_join(F.transform("c", lambda c: F.concat(c["idx"], F.lit(":"), c["score"])), ",")
    return V.actas(s, d).select("id").join(cells.withColumnRenamed("acta_id", "id"), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(text, F.lit("")).alias("scores"))


@query("SELECT p_partkey id, concat_ws(',', CASE WHEN least(w,h)<800 THEN 'small' END, CASE WHEN 100*w<55*h OR 100*w>85*h THEN 'aspect' END, CASE WHEN m>230 THEN 'bright' END, CASE WHEN m<40 THEN 'dark' END) issues FROM (SELECT p_partkey, 600+p_partkey%700 w, 900+p_size*10 h, p_partkey%256 m FROM part)")
def image_quality(s, d):
    k = F.col("p_partkey")
    return V.load(s, d, "part").select(k.alias("id"), F.array_join(records.image_issues(600 + k % 700, 900 + F.col("p_size") * 10, k % 256), ",").alias("issues"))


@query("SELECT id, CASE WHEN id%11=0 THEN 'no_name' WHEN id%7=0 THEN 'extension' WHEN size_bytes=0 THEN 'empty' WHEN id%13=0 THEN 'content_type' WHEN id%5=0 THEN CASE WHEN id%2=0 THEN 'pdf' ELSE 'content' END END problem FROM tables")
def upload_validation(s, d):
    k = F.col("id")
    name = F.when(k % 11 == 0, "").when(k % 7 == 0, "a.gif").when(k % 2 == 0, "a.png").otherwise("b.JPG")
    kind = F.when(k % 13 == 0, "application/pdf").otherwise("image/JPEG")
    head = F.when(k % 10 == 0, "255044462D312E37").when(k % 5 == 0, "89504E4700000000").when(k % 2 == 0, "89504E470D0A1A0A").otherwise("FFD8FFE000104A46")
    return V.tables(s, d).select("id", records.upload_problem(name, F.col("size_bytes"), kind, head).alias("problem"))


@query("SELECT id, size_bytes>=100 AND id%9<>0 valid, sha256('%PDF-'||CAST(id AS VARCHAR)) sha FROM tables")
def pdf_validation(s, d):
    head = F.when(F.col("id") % 9 != 0, "%PDF-").otherwise("<html")
    return V.tables(s, d).select("id", ((F.col("size_bytes") >= 100) & (head == "%PDF-")).alias("valid"), F.sha2(F.concat(F.lit("%PDF-"), F.col("id").cast("string")), 256).alias("sha"))


@query("SELECT 'duplicate' kind, count(*) n FROM (SELECT mesa_key FROM actas GROUP BY mesa_key HAVING count(*)>1) UNION ALL SELECT 'domain', count(*) FROM actas WHERE estado NOT IN ('O','F') UNION ALL SELECT 'orphan', count(*) FROM (SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey%10<>0))")
def constraint_violations(s, d):
    a = V.actas(s, d)
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    parent = V.load(s, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return n(mutate.duplicates(a, ["mesa_key"]), "duplicate").union(n(mutate.outside(a, "estado", ["O", "F"]), "domain")).union(n(mutate.orphans(V.load(s, d, "orders").select("o_custkey"), parent, "o_custkey"), "orphan"))


# --- pixels (NumPy features of 24 x 24 cells made from vectors; no SQL form)


def _pixel_cells(s, d, side=24):
    """Cells of 8 x 8 values, each as several pixels where side is over 8."""
    gray = F.transform("embedding", lambda x: F.least(F.greatest((x * 400 + 128).cast("int"), F.lit(0)), F.lit(255)))
    return V.load(s, d, "embeddings").select("vec_id", (gray if side == 8 else vision.resize(side)(gray)).alias("pixels"))


@query()
def img_ink_features(s, d):
    return _pixel_cells(s, d).select("vec_id", vision.ink_features("pixels").alias("f")).select("vec_id", "f.*")


@query()
def img_capa1_scores(s, d):
    return vision.scored_cells(_pixel_cells(s, d), F.col("pixels")).select("vec_id", "score_ink", "score_separator", "score_density", "score")


@query()
def img_upload_scores(s, d):
    """Stroke, separator and dark share of a cell, blended 0.3 / 0.4 / 0.3."""
    rows = _pixel_cells(s, d).select("vec_id", vision.upload_scores("pixels").alias("f")).select("vec_id", "f.*")
    return rows.withColumn("score", rules.blend(F.col("stroke"), F.col("separator"), F.col("dark")))


@query()
def img_double_stroke(s, d):
    """Features of overwriting; flagged from a score of 0.5 on."""
    rows = _pixel_cells(s, d).select("vec_id", vision.double_strokes("pixels").alias("f")).select("vec_id", "f.*")
    return rows.withColumn("flag", F.col("score") >= 0.5).withColumn("score", F.least("score", F.lit(1.0)))


@query()
def img_otsu(s, d):
    return _pixel_cells(s, d).select("vec_id", vision.ink_features("pixels").alias("f")).select("vec_id", "f.otsu", "f.otsu_ink")


# --- universe, pages, batches, rates: further operators


@query("SELECT lpad(CAST(s_nationkey AS VARCHAR),2,'0') dep, lpad(CAST(s_suppkey%400 AS VARCHAR),3,'0') muni, s_name expected_name FROM supplier WHERE s_suppkey%5<>0")
def universe_flatten(s, d):
    from tallylens.sources.universe import flatten_universe

    node = F.struct(F.col("s_nationkey").cast("string").alias("idDepartmentCode"), (F.col("s_suppkey") % 400).cast("string").alias("municipalityCode"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).otherwise("").alias("expectedName"))
    block = F.struct(F.array(node).alias("nodes"))
    raw = V.load(s, d, "supplier").select(F.to_json(F.struct(F.struct(block.alias("b")).alias("data"))).alias("value"))
    return flatten_universe(raw).select("dep", "muni", "expected_name")


_SYMBOL = "SELECT l_orderkey sheet, l_linenumber%2 page, CAST(l_linenumber AS BIGINT)*1000000000+l_partkey*1000+l_suppkey%1000 place, CASE l_linenumber%3 WHEN 0 THEN 'EAN13' WHEN 1 THEN 'QRCODE' ELSE 'qr_code' END kind, CASE WHEN l_partkey%4=0 THEN 'Z'||l_partkey ELSE 'E'||l_orderkey||'-PRE' END AS data, CASE l_orderkey%5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'E'||l_orderkey END AS key FROM lineitem"
_PAGE = f"SELECT sheet, page, max(key) AS key, count(*) n, arg_min(data, place) FILTER (WHERE kind<>'EAN13') raw FROM ({_SYMBOL}) GROUP BY sheet, page"
_MATCH = f"SELECT *, CASE WHEN key IS NULL OR (key='' AND raw IS NOT NULL) THEN NULL WHEN raw IS NULL THEN false ELSE contains(raw,key) END m FROM ({_PAGE})"
_REASON = f"SELECT *, CASE WHEN NOT m THEN CASE WHEN raw IS NULL THEN 'sin QR, se esperaba '||key ELSE 'QR '||raw||' no coincide con '||key END END r FROM ({_MATCH})"


def _symbols(s, d):
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    kind = F.when(n % 3 == 0, "EAN13").when(n % 3 == 1, "QRCODE").otherwise("qr_code")
    data = F.when(p % 4 == 0, F.concat(F.lit("Z"), p)).otherwise(F.concat(F.lit("E"), k, F.lit("-PRE")))
    key = F.when(k % 5 == 1, "").when(k % 5 > 1, F.concat(F.lit("E"), k))
    place = n.cast("long") * 1000000000 + p * 1000 + F.col("l_suppkey") % 1000
    return V.load(s, d, "lineitem").select(k.alias("sheet"), (n % 2).alias("page"), place.alias("place"), kind.alias("kind"), data.alias("data"), key.alias("key"))


@query(f"SELECT sheet, CAST(sum(n) AS BIGINT) symbols, (list(raw ORDER BY page) FILTER (WHERE raw IS NOT NULL))[1] raw, (list(m ORDER BY page))[1] AS match, count(CASE WHEN NOT m THEN 1 END) mismatches, (list(r ORDER BY page) FILTER (WHERE r IS NOT NULL))[1] reason FROM ({_REASON}) GROUP BY sheet")
def qr_pages(s, d):
    return records.qr_readings(_symbols(s, d))


@query("SELECT page, id, CASE WHEN r<=5 AND conf>20 THEN true ELSE false END sent FROM (SELECT page, id, conf, row_number() OVER (PARTITION BY page ORDER BY conf DESC, id) r FROM det)")
def vlm_top_then_filter(s, d):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("page").orderBy(F.desc("conf"), "id"))
    return V.det(s, d).withColumn("r", rank).select("page", "id", ((F.col("r") <= 5) & (F.col("conf") > 20)).alias("sent"))


_BOXES = " UNION ALL ".join(f"SELECT id, '{n}' region, " + ", ".join(f"CAST(floor({v}::DOUBLE*{side}) AS INTEGER) {c}" for c, v, side in zip("xywh", box, ("w0", "h0") * 2, strict=True)) + " FROM (SELECT p_partkey id, 800+p_partkey%3000 w0, 1000+p_size*37 h0 FROM part)" for n, box in (layout.REGIONS | layout.COLUMNS).items())


@query(_BOXES)
def layout_regions(s, d):
    """Regions and columns of pages of many sizes."""
    page = V.load(s, d, "part").select(F.col("p_partkey").alias("id"), F.inline(layout.boxes(layout.REGIONS | layout.COLUMNS, 800 + F.col("p_partkey") % 3000, 1000 + F.col("p_size") * 37)))
    return page.withColumnRenamed("name", "region")


@query("SELECT dep, list_aggregate(list_sort(list(DISTINCT estado)),'string_agg',',') estados FROM actas GROUP BY dep")
def distinct_states(s, d):
    return V.actas(s, d).groupBy("dep").agg(F.array_join(F.array_sort(F.collect_set("estado")), ",").alias("estados"))


@query("SELECT id, votos FROM (SELECT id, CAST(c1 AS VARCHAR)||','||CAST(c2 AS VARCHAR) votos FROM actas) WHERE votos IS NOT NULL")
def merged_page_votes(s, d):
    """Maps of two pages merged, the later page winning on a shared key."""
    one = F.create_map(F.lit("a"), F.col("c1"), F.lit("b"), F.lit(0).cast("long"))
    two = F.create_map(F.lit("b"), F.col("c2"))
    merged = F.map_from_entries(F.concat(F.filter(F.map_entries(one), lambda e: ~F.map_contains_key(two, e["key"])), F.map_entries(two)))
    return V.actas(s, d).select("id", F.concat_ws(",", merged["a"].cast("string"), merged["b"].cast("string")).alias("votos"))


@query("SELECT id, CASE WHEN id%7=3 THEN 409 WHEN id%7=4 THEN 404 WHEN id%7=5 THEN 500 ELSE 200 END code FROM actas")
def vote_error_codes(s, d):
    k = F.col("id") % 7
    text = F.when(k == 3, "Esta discrepancia ya fue votada").when(k == 4, "Discrepancia no encontrada").when(k == 5, "fallo interno")
    code = F.when(text.isNull(), 200).when(F.contains(F.lower(text), F.lit("ya")) | F.contains(F.lower(text), F.lit("congelada")), 409).when(F.contains(F.lower(text), F.lit("no encontrada")), 404).otherwise(500)
    return V.actas(s, d).select("id", code.alias("code"))


@query("SELECT id, CASE WHEN id%3=0 THEN NULL ELSE '{\"estado\":\"'||estado||'\"}' END doc, CASE WHEN id%3=0 THEN NULL ELSE estado END parsed FROM actas")
def acta_detail_json(s, d):
    doc = F.when(F.col("id") % 3 != 0, F.to_json(F.struct("estado")))
    return V.actas(s, d).select("id", doc.alias("doc"), F.from_json(doc, "estado string")["estado"].alias("parsed"))


@query("SELECT a.id, coalesce(len(f.rules),0) n, coalesce(array_to_string(list_sort(f.rules),','),'') rules FROM actas a LEFT JOIN (SELECT acta_id, list(rule) rules FROM found GROUP BY acta_id) f ON f.acta_id=a.id")
def acta_children(s, d):
    kids = V.found(s, d).groupBy("acta_id").agg(F.collect_list("rule").alias("rules"))
    rows = V.actas(s, d).select("id").join(kids.withColumnRenamed("acta_id", "id"), "id", "left")
    return rows.select("id", F.coalesce(F.size("rules").cast("long"), F.lit(0)).alias("n"), F.coalesce(F.array_join(F.array_sort("rules"), ","), F.lit("")).alias("rules"))


@query("SELECT coalesce(h.id,c.id) id, CASE WHEN h.id IS NOT NULL THEN 'hot' ELSE 'cold' END place FROM (SELECT id FROM tables WHERE id%3=0) h FULL JOIN (SELECT id FROM tables WHERE id%2=0) c ON c.id=h.id")
def object_lookup(s, d):
    t = V.tables(s, d)
    hot, cold = t.where("id % 3 = 0").select("id", F.lit("hot").alias("h")), t.where("id % 2 = 0").select("id", F.lit("cold").alias("c"))
    return hot.join(cold, "id", "full").select("id", F.coalesce("h", "c").alias("place"))


@query("SELECT count(*) n, count(CASE WHEN status<>'error' THEN 1 END) done, count(CASE WHEN status='error' THEN 1 END) errors, least(count(*),3) workers FROM tables")
def batch_outcome(s, d):
    return V.tables(s, d).agg(F.count("*").alias("n"), F.count_if(F.col("status") != "error").alias("done"), F.count_if(F.col("status") == "error").alias("errors"), F.least(F.count("*"), F.lit(3)).alias("workers"))


@query("SELECT id, e11<>urna AND abs(e11-urna)>10 AS invalid, CASE WHEN firmas BETWEEN 0 AND 6 THEN 'ok' ELSE 'range' END checked FROM actas")
def range_checks(s, d):
    gap = F.abs(F.col("e11") - F.col("urna"))
    return V.actas(s, d).select("id", ((F.col("e11") != F.col("urna")) & (gap > 10)).alias("invalid"), F.when(F.col("firmas").between(0, 6), "ok").otherwise("range").alias("checked"))


# --- compositions and page geometry


@query(f"SELECT r.id, CAST(round(risk*100) AS BIGINT) risk, {_LEVEL} level, coalesce(n,0) findings FROM ({_RISK}) r LEFT JOIN (SELECT acta_id, count(*) n FROM found GROUP BY acta_id) f ON f.acta_id=r.id")
def document_analysis(s, d):
    """The whole analysis of a sheet: rules, mathematics, signatures, risk and its findings, in one row."""
    n = rules.findings(V.actas(s, d)).groupBy(F.col("acta_id").alias("id")).agg(F.count("*").alias("findings"))
    return _risk(s, d).select("id", F.round(F.col("risk") * 100).cast("long").alias("risk"), "level").join(n, "id", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


_LEVEL_LINES = "SELECT page, CASE WHEN dx>50 AND 2*abs(dy)<dx AND abs(a)<3 THEN a END a FROM (SELECT *, degrees(atan2(dy::DOUBLE,dx::DOUBLE)) a FROM (SELECT page, CASE WHEN id%4=0 THEN w ELSE w*20 END dx, y%41-20 dy FROM det))"


@query(f"SELECT page, CASE WHEN count(*)<5 OR count(a)=0 THEN 0 ELSE round(median(a),2) END angle, count(a) lines FROM ({_LEVEL_LINES}) GROUP BY page")
def page_rotation(s, d):
    """Rotation of pages by lines of which some are short or steep."""
    lines = V.det(s, d).select("page", F.when(F.col("id") % 4 == 0, F.col("w")).otherwise(F.col("w") * 20).alias("dx"), (F.col("y") % 41 - 20).alias("dy"))
    return layout.rotation(lines, "page")


@query()
def img_resized(s, d):
    return _pixel_cells(s, d, 8).select("vec_id", F.array_join(vision.resize(4)("pixels").cast("array<string>"), " ").alias("pixels"))


@query("SELECT vec_id, CAST(embedding[10]>0 AS INTEGER) a, CAST(embedding[20]>0 AS INTEGER) b FROM embeddings")
def img_region(s, d):
    """Rows 1-2 and columns 1-3 of the 8 x 8 cell; its first and last pixel."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform(F.slice("embedding", y * 8 + 1, F.lit(8)), lambda x: (x > 0).cast("int")))
    part = layout.crop(grid, F.lit(1), F.lit(3), F.lit(1), F.lit(4))
    return V.load(s, d, "embeddings").select("vec_id", part.alias("p")).select("vec_id", F.col("p")[0][0].alias("a"), F.col("p")[1][2].alias("b"))


from . import intake_queries, listing_queries, page_queries, state_queries  # noqa: E402,F401 (they register their queries)
