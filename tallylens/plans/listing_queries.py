"""Listings, dashboards and lookups in full: pages with totals, counts by state, summaries with zeros, ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallylens.operators import comparison, mutate, records, results, rollups, rules, uploads, workqueue
from tallylens.sources import universe

from . import views as V
from .queries import _CMP, _SYMBOL, _symbols
from .registry import query


@query("SELECT id, estado, creado_en, (SELECT count(*) FROM actas WHERE estado='F') total FROM actas WHERE estado='F' ORDER BY creado_en DESC, id LIMIT 20 OFFSET 40")
def sheets_page(s, d):
    """A page of the sheets of one state, with the number of all of them."""
    return rollups.page_with_total(V.actas(s, d).where("estado = 'F'").select("id", "estado", "creado_en"), [F.desc("creado_en"), "id"], 40, 20)


@query("SELECT id, mesa_key, rule, (SELECT count(*) FROM found WHERE rule='firmas_insuficientes') total FROM found WHERE rule='firmas_insuficientes' AND dep='03' ORDER BY creado_en DESC, id LIMIT 50")
def findings_page(s, d):
    """Findings of a kind and a department, newest first; the total is of the kind."""
    kind = V.found(s, d).where("rule = 'firmas_insuficientes'")
    return rollups.page_with_total(kind.where("dep = '03'"), [F.desc("creado_en"), "id"], 0, 50, kind).select("id", "mesa_key", "rule", "total")


@query("SELECT a.id acta_id, coalesce(count(x),0) cells, coalesce(max(x),0) top, round(coalesce(avg(x),0),9) mean, count(CASE WHEN x>0.5::DOUBLE THEN 1 END) suspicious FROM actas a LEFT JOIN (SELECT acta_id, score/100.0::DOUBLE x FROM cells WHERE acta_id%6<>0) c ON c.acta_id=a.id GROUP BY a.id")
def visual_summary(s, d):
    """Cells of each sheet: number, maximum, mean and suspicious ones; zeros without cells."""
    cells = V.cells(s, d).where("acta_id % 6 <> 0").select("acta_id", (F.col("score") / 100).alias("score"))
    return rollups.visual_summaries(V.actas(s, d).select(F.col("id").alias("acta_id")), cells, "acta_id").withColumn("mean", F.round("mean", 9))


_STATE = "CASE id%5 WHEN 0 THEN 'pendiente' WHEN 1 THEN 'procesando' WHEN 2 THEN 'completado' WHEN 3 THEN 'error' ELSE 'tomado' END"


def _slots(s, d):
    k = F.col("id") % 5
    state = F.when(k == 0, "pendiente").when(k == 1, "procesando").when(k == 2, "completado").when(k == 3, "error").otherwise("tomado")
    return V.actas(s, d).select("id", (F.col("id") % 3).alias("capa"), state.alias("estado"))


@query("SELECT pendientes, procesando, completados, errores, pendientes+procesando+completados+errores total FROM (SELECT " + ", ".join(f"count(CASE WHEN e='{v}' THEN 1 END) {n}" for n, v in (("pendientes", "pendiente"), ("procesando", "procesando"), ("completados", "completado"), ("errores", "error"))) + f" FROM (SELECT {_STATE} e FROM actas WHERE id%3=2))")
def layer_queue(s, d):
    """Slots of the second layer by state; claimed ones are in no count."""
    return rollups.queue_counts(_slots(s, d), 2)


@query("SELECT 0::BIGINT pendientes, 0::BIGINT procesando, 0::BIGINT completados, 0::BIGINT errores, 0::BIGINT total FROM (SELECT count(*) FROM actas)")
def empty_queue(s, d):
    """A queue without any slot of the layer still gives zeros."""
    return rollups.queue_counts(_slots(s, d), 9)


@query("SELECT a.*, v.* FROM (SELECT count(*) total_discrepancias, count(CASE WHEN estado='por_verificar' THEN 1 END) por_verificar, count(CASE WHEN estado='verificado_legitimo' THEN 1 END) verificadas_legitimas, count(CASE WHEN estado='verificado_anomalo' THEN 1 END) verificadas_anomalas, count(CASE WHEN congelada THEN 1 END) congeladas FROM found) a, (SELECT count(*) total_votos, count(DISTINCT voter) votantes_unicos FROM votes WHERE vote_id%9<>0) v")
def consensus_totals(s, d):
    """All counts of the consensus; annulled votes count in none."""
    return rollups.consensus_totals(V.found(s, d), V.votes(s, d).withColumn("anulado", F.col("vote_id") % 9 == 0))


@query("SELECT count(*) total, count(CASE WHEN id%4<>0 THEN 1 END) processed, count(CASE WHEN id%4=0 THEN 1 END) pending, count(CASE WHEN id%4<>0 AND qr_ok THEN 1 END) math_valid, (SELECT count(*) FROM found WHERE acta_id%4<>0) anomalies FROM actas")
def analysis_totals(s, d):
    """Sheets in all, processed and pending, valid ones, and the number of their anomalies."""
    one = V.actas(s, d).agg(F.count("*").alias("total"), F.count_if(F.col("id") % 4 != 0).alias("processed"), F.count_if((F.col("id") % 4 != 0) & F.col("qr_ok")).alias("math_valid"))
    kids = V.found(s, d).where("acta_id % 4 <> 0").agg(F.count("*").alias("anomalies"))
    return one.withColumn("pending", F.col("total") - F.col("processed")).crossJoin(F.broadcast(kids))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def latest_jobs(s, d):
    return V.load(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select("event_id", "event_type")


@query("SELECT dep, count(DISTINCT muni) munis, count(CASE WHEN status='cached' THEN 1 END) downloaded, count(CASE WHEN status='error' THEN 1 END) failed, CAST(coalesce(sum(CASE WHEN status='cached' THEN size_bytes END),0) AS BIGINT) bytes FROM tables GROUP BY dep")
def department_bytes(s, d):
    """Downloads of each department, with the bytes of those that succeeded."""
    won = F.col("status") == "cached"
    return V.tables(s, d).groupBy("dep").agg(F.countDistinct("muni").alias("munis"), F.count_if(won).alias("downloaded"), F.count_if(F.col("status") == "error").alias("failed"), F.coalesce(F.sum(F.when(won, F.col("size_bytes"))), F.lit(0)).alias("bytes"))


@query("SELECT id, dep FROM actas WHERE id%4<>0 ORDER BY id LIMIT 5000")
def next_unanalysed(s, d):
    """The next 5,000 sheets without an analysis, by id."""
    a = V.actas(s, d).select("id", "dep")
    return a.join(a.where("id % 4 = 0").select("id"), "id", "left_anti").orderBy("id").limit(5000)


@query("SELECT p_partkey id FROM part WHERE p_partkey%3<>0 ORDER BY p_name, p_partkey LIMIT 10")
def next_files(s, d):
    """The first ten files that aren't stored yet, by name."""
    p = V.load(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return p.join(p.where("id % 3 = 0").select("id"), "id", "left_anti").orderBy("p_name", "id").limit(10).select("id")


@query("SELECT id, mesa_key, c1, c2, blanco, nulos, no_marcados, estado, creado_en FROM actas ORDER BY creado_en DESC, id")
def all_sheets(s, d):
    """All sheets with nine columns, newest first."""
    return V.actas(s, d).select("id", "mesa_key", "c1", "c2", "blanco", "nulos", "no_marcados", "estado", "creado_en").orderBy(F.desc("creado_en"), "id")


_RANGE = "SELECT event_id, (event_id%131)/100.0::DOUBLE score, (event_id%57)/10.0::DOUBLE peso, event_id%611 n, event_id%113-6 tol, event_id%13 w, event_id%107 sl FROM events"


@query(f"SELECT event_id, array_to_string(list_filter([CASE WHEN score>1 THEN 'score' END, CASE WHEN peso>5 THEN 'peso' END, CASE WHEN n>500 THEN 'comentario' END, CASE WHEN tol<0 OR tol>100 THEN 'tolerancia' END, CASE WHEN w<1 OR w>10 THEN 'workers' END, CASE WHEN sl<1 OR sl>100 THEN 'slots' END], lambda x: x IS NOT NULL),',') wrong FROM ({_RANGE})")
def request_ranges(s, d):
    """Fields of requests that are beyond their range."""
    k = F.col("event_id")
    wrong = rules.vote_ranges(k % 131 / 100, k % 57 / 10, F.repeat(F.lit("x"), (k % 611).cast("int")), k % 113 - 6, k % 13, k % 107)
    return V.load(s, d, "events").select("event_id", F.array_join(wrong, ",").alias("wrong"))


@query("SELECT count(*) total, count(CASE WHEN id%3=0 THEN 1 END) inserted, count(CASE WHEN id%3<>0 AND id%2=0 THEN 1 END) updated FROM tables WHERE id%3<>0 OR id%2=0 AND id%3=0")
def refresh_totals(s, d):
    """The audit row of a refresh."""
    t = V.tables(s, d).select("id", "status")
    return mutate.upsert_totals(mutate.upsert(t.where("id % 3 <> 0"), t.where("id % 2 = 0"), ["id"]))


@query("SELECT id, c1+c2+blanco+nulos+no_marcados suma, excede, no_coincide, CASE WHEN id%2=0 THEN greatest(CASE WHEN id%3>0 THEN id%3 ELSE 0 END,0) WHEN id%3>0 THEN id%3 END capa_maxima FROM flagged")
def sheets_after_layer(s, d):
    """Totals and flags on each second sheet's row, with the highest layer."""
    rows = rules.with_flags(V.actas(s, d))
    sheets = rows.select("id", "suma", "excede", "no_coincide", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("capa_maxima"))
    return results.parents_updated(sheets, rows.where("id % 2 = 0").select("id", "suma", "excede", "no_coincide")).select("id", "suma", "excede", "no_coincide", "capa_maxima")


_FILES = "SELECT 'h'||p_partkey%300 sha, min('/f/'||p_partkey) path FROM part WHERE p_partkey%300<200 GROUP BY 1"


@query(f"SELECT id, path, CASE WHEN id%7=0 THEN 'No PDF available for table '||id WHEN path IS NULL THEN 'PDF not in acquisition storage: sha256=h'||id%300 END error FROM tables LEFT JOIN ({_FILES}) ON id%7<>0 AND sha='h'||id%300")
def stored_files(s, d):
    """Stored files of tables by hash, or why there is none."""
    k = F.col("p_partkey")
    files = V.load(s, d, "part").where("p_partkey % 300 < 200").select(F.concat(F.lit("h"), k % 300).alias("sha256"), F.concat(F.lit("/f/"), k).alias("path"))
    tables = V.tables(s, d).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("h"), F.col("id") % 300)).alias("sha256"))
    return results.stored_files(tables, files).select("id", "path", "error")


@query("SELECT l_orderkey id, CASE WHEN l_orderkey%8=0 THEN 0 ELSE count(*) END entries FROM lineitem GROUP BY l_orderkey")
def list_sizes(s, d):
    """Entries under a key of each document; some lack it."""
    rows = V.load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("codes"))
    raw = rows.select("id", F.when(F.col("id") % 8 == 0, F.to_json(F.struct("id"))).otherwise(F.to_json(F.struct(F.col("codes").alias("transmissioncodes")))).alias("value"))
    return universe.list_size(raw).select("id", F.col("entries").cast("long").alias("entries"))


@query("SELECT page, CASE WHEN n=0 THEN NULL ELSE CAST(d AS INTEGER) END digit, CASE WHEN n=0 THEN 0 ELSE c END confidence FROM (SELECT page, count(*) FILTER (WHERE regexp_matches(text,'[0-9]')) n, arg_max(regexp_extract(text,'[0-9]',0), id) FILTER (WHERE regexp_matches(text,'[0-9]')) d, max(conf/50.0::DOUBLE) FILTER (WHERE regexp_matches(text,'[0-9]')) c FROM det GROUP BY page)")
def slot_readings(s, d):
    """The digit of each slot's lines, the last line with one, and the greatest confidence."""
    lines = F.array_sort(F.collect_list(F.struct("id", "text", (F.col("conf") / 50).alias("conf"))))
    rows = V.det(s, d).groupBy("page").agg(lines.alias("lines"))
    return rows.select("page", records.slot_reading(F.col("lines")).alias("x")).select("page", "x.digit", "x.confidence")


@query("SELECT acta_id, idx, max(CAST(floor(score/100.0::DOUBLE*100+0.5::DOUBLE) AS INTEGER)) pct FROM cells GROUP BY acta_id, idx")
def score_percent(s, d):
    return V.cells(s, d).groupBy("acta_id", "idx").agg(F.max(rules.percent(F.col("score") / 100)).alias("pct"))


@query(f"SELECT count(*) total_mesas, count(n) mesas_con_discrepancia, CAST(coalesce(sum(n),0) AS BIGINT) total_discrepancias FROM (SELECT DISTINCT mesa_key FROM evidence WHERE estado<>'rechazada_calidad') k LEFT JOIN (SELECT mesa_key, count(*) n FROM ({_CMP}) WHERE discrepa GROUP BY mesa_key) c ON c.mesa_key=k.mesa_key")
def comparison_totals(s, d):
    """Mesas with evidence, those with discrepancies, and all discrepancies."""
    evidence = V.evidence(s, d)
    return comparison.batch_totals(evidence.where("estado <> 'rechazada_calidad'"), comparison.compared(V.actas(s, d), evidence, 2))


_TRIED = "SELECT id, CASE id%4 WHEN 0 THEN 'completado' WHEN 1 THEN CASE WHEN id%3+1<coalesce(m,3) THEN 'pendiente' ELSE 'error' END ELSE 'tomado' END estado, CASE WHEN id%4=1 AND id%3+1<coalesce(m,3) THEN NULL ELSE 'w'||id%5 END worker_id, CAST(id%3+CASE WHEN id%4=1 THEN 1 ELSE 0 END AS BIGINT) intentos, CASE WHEN id%4=1 THEN substr(repeat('fallo '||id||' ',60),1,500) END ultimo_error FROM (SELECT id, CASE WHEN id%7>0 THEN id%5+1 END m FROM actas)"


def _tried(s, d):
    k = F.col("id")
    queue = V.actas(s, d).select("id", F.lit("tomado").alias("estado"), F.concat(F.lit("w"), k % 5).alias("worker_id"), F.col("creado_en").alias("tomado_en"), (k % 3).alias("intentos"), F.when(k % 7 > 0, k % 5 + 1).alias("max_intentos"), F.lit(None).cast("string").alias("ultimo_error"))
    outcomes = V.actas(s, d).where("id % 4 < 2").select("id", (k % 4 == 0).alias("ok"), F.repeat(F.concat(F.lit("fallo "), k, F.lit(" ")), F.lit(60)).alias("error"))
    return workqueue.after_attempt(queue, outcomes)


@query(_TRIED)
def queue_attempts(s, d):
    """Slots after an attempt, by each one's own number of attempts."""
    return _tried(s, d).select("id", "estado", "worker_id", "intentos", "ultimo_error")


@query(f"SELECT id, substr(ultimo_error,1,20) error, '2024-02-01' failed_at FROM ({_TRIED}) WHERE estado='error'")
def dead_letter_payloads(s, d):
    rows = workqueue.dead_letter_rows(_tried(s, d), F.lit("2024-02-01"))
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return rows.select(field("id").cast("long").alias("id"), F.substring(field("error_message"), 1, 20).alias("error"), field("failed_at").alias("failed_at"))


@query(f"SELECT sheet, CAST(page AS INTEGER) page, key valor_oficial, raw valor_ciudadano, CASE WHEN raw IS NULL THEN 'sin QR, se esperaba '||key ELSE 'QR '||raw||' no coincide con '||key END razon_flag FROM (SELECT sheet, page, max(key) AS key, arg_min(data, place) FILTER (WHERE kind<>'EAN13') raw FROM ({_SYMBOL}) GROUP BY sheet, page) WHERE key IS NOT NULL AND (raw IS NULL OR (key<>'' AND NOT contains(raw,key)))")
def qr_mismatches(s, d):
    """A finding for each page whose code doesn't hold the key."""
    return records.qr_findings(_symbols(s, d)).select("sheet", F.col("page").cast("int").alias("page"), "valor_oficial", "valor_ciudadano", "razon_flag")


@query("SELECT 'region_'||r_regionkey clave, r_name valor FROM region UNION ALL SELECT 'umbral_min_votos', CAST(count(*) AS VARCHAR) FROM nation UNION ALL SELECT * FROM (VALUES ('umbral_consenso_pct','0.80'),('capa1_score_revision','0.60'),('capa1_score_prioridad_alta','0.85')) t(clave,valor)")
def settings_with_defaults(s, d):
    """Defaults for the keys that aren't set."""
    mine = V.load(s, d, "region").select(F.concat(F.lit("region_"), "r_regionkey").alias("clave"), F.col("r_name").alias("valor"))
    least = V.load(s, d, "nation").agg(F.count("*").cast("string").alias("valor")).select(F.lit("umbral_min_votos").alias("clave"), "valor")
    return uploads.with_defaults(mine.unionByName(least))
