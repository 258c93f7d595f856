"""Queries on uploads, gates, settings, lookups, calibration and risk parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallylens.operators import layout, records, rollups, rules, uploads

from . import views as V
from .registry import query


def _uuid(text: str) -> str:
    h = f"md5({text})"
    return "||'-'||".join(f"substr({h},{a},{n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def _uploads(s, d):
    """Uploads of scored images: the documents' texts stand for their bytes."""
    k = F.col("doc_id")
    part = lambda n: (k * n % 101) / 100
    rows = V.load(s, d, "documents").select(k.alias("upload_id"), F.when(k % 13 > 0, F.concat(F.lit("M-"), k % 50)).alias("mesa_key"), F.encode("text", "utf-8").alias("content"), part(7).alias("grosor"), part(11).alias("separador"), part(17).alias("tinta"))
    return rows.withColumn("score", F.round((F.col("upload_id") % 101) / 100, 2))


_UP = "SELECT doc_id upload_id, CASE WHEN doc_id%13>0 THEN 'M-'||doc_id%50 END mesa_key, text, (doc_id%101)/100.0::DOUBLE score FROM documents"


@query(f"SELECT {_uuid('CAST(upload_id AS VARCHAR)')} id, upload_id, 'data:image/png;base64,'||substr(base64(encode(text)),1,100)||'...' imagen_url, score confianza_extraccion, CASE WHEN mesa_key IS NULL THEN 'error' ELSE 'saved' END status, CASE WHEN mesa_key IS NULL THEN 'mesa_key missing' END message FROM ({_UP})")
def upload_evidence(s, d):
    return uploads.evidence_rows(_uploads(s, d)).select("id", "upload_id", "imagen_url", "confianza_extraccion", "status", "message")


@query(f"SELECT upload_id, score>0.6::DOUBLE enqueued, CASE WHEN score>0.6::DOUBLE THEN 'Encolado en cola_procesamiento slot='||substr(md5('slot'||chr(31)||upload_id),1,8)||'... para Capa 2 (VLM)' ELSE 'score_global='||printf('%.2f',score)||' ≤ umbral 0.6' END reason FROM ({_UP})")
def upload_gate(s, d):
    return uploads.gated(_uploads(s, d)).select("upload_id", "enqueued", "reason")


@query(f"SELECT {_uuid(chr(39) + 'slot' + chr(39) + '||chr(31)||upload_id')} id, mesa_key, CAST(2 AS INTEGER) capa_actual, 'pendiente' estado_slot, {_uuid('CAST(upload_id AS VARCHAR)')} evidence_id FROM ({_UP}) WHERE score>0.6::DOUBLE")
def upload_queue(s, d):
    return uploads.second_layer(_uploads(s, d))


# --- settings: keys and values from the events


def _changes(s, d):
    k = F.col("user_id") % 6
    name = F.element_at(F.array(*[F.lit(x) for x in [*uploads.KEYS, "other", "umbral"]]), (k + 1).cast("int"))
    return V.load(s, d, "events").select(name.alias("clave"), (F.col("event_id") % 97).cast("string").alias("valor"), F.struct("ts", "event_id").alias("at"), "event_id")


_NAMES = "[" + ", ".join(f"'{x}'" for x in [*uploads.KEYS, "other", "umbral"]) + "]"
_SET = f"SELECT {_NAMES}[CAST(user_id%6 AS INTEGER)+1] clave, CAST(event_id%97 AS VARCHAR) valor, ts, event_id FROM events"
_NOW = f"SELECT clave, valor FROM (SELECT *, row_number() OVER (PARTITION BY clave ORDER BY ts DESC, event_id DESC) r FROM ({_SET})) WHERE r=1 AND clave NOT IN ('other','umbral')"


def _settings(s, d):
    old = V.load(s, d, "region").select(F.concat(F.lit("region_"), "r_regionkey").alias("clave"), F.col("r_name").alias("valor"))
    return uploads.settings(old, _changes(s, d))


@query(f"SELECT clave, valor FROM ({_NOW}) UNION ALL SELECT 'region_'||r_regionkey, r_name FROM region")
def settings_after(s, d):
    return _settings(s, d)[0]


@query(f"SELECT event_id, 'Clave no permitida' reason FROM ({_SET}) WHERE clave IN ('other','umbral')")
def settings_refused(s, d):
    return _settings(s, d)[1].select("event_id", "reason")


@query(f"SELECT k.clave, coalesce(valor,'') valor FROM (SELECT 'region_'||n_nationkey clave FROM nation) k LEFT JOIN (SELECT 'region_'||r_regionkey clave, r_name valor FROM region) c ON c.clave=k.clave")
def setting_values(s, d):
    wanted = V.load(s, d, "nation").select(F.concat(F.lit("region_"), "n_nationkey").alias("clave"))
    return uploads.setting_values(_settings(s, d)[0], wanted)


@query("SELECT id, x.mesa_key, x.number, x.number IS NOT NULL success, CASE WHEN x.number IS NULL THEN 'No fixture for '||a.mesa_key END error FROM actas a LEFT JOIN (SELECT mesa_key, min(id) AS number FROM actas WHERE id%3=0 GROUP BY mesa_key) x ON x.mesa_key=a.mesa_key")
def fixture_lookup(s, d):
    """Slots with their fixture, or an error row."""
    a = V.actas(s, d)
    out = uploads.looked_up(a.select("id", "mesa_key"), a.where("id % 3 = 0").select("mesa_key", F.col("id").alias("number")))
    return out.select("id", F.when(F.col("success"), F.col("mesa_key")).alias("mesa_key"), "fixture.number", "success", "error")


def _jobs(s, d):
    k = F.col("id")
    status = F.when(k % 5 == 0, "skipped").when(k % 5 == 1, "error").otherwise("success")
    return V.tables(s, d).select("dep", status.alias("status"), F.col("size_bytes").alias("size"), F.concat(F.lit("HTTP "), 400 + k % 7).alias("error"))


@query("SELECT dep, count(CASE WHEN id%5>1 THEN 1 END) downloaded, count(CASE WHEN id%5=1 THEN 1 END) failed, count(CASE WHEN id%5=0 THEN 1 END) skipped, CAST(coalesce(sum(CASE WHEN id%5>1 THEN size_bytes END),0) AS BIGINT) bytes FROM tables GROUP BY dep")
def batch_counts(s, d):
    return uploads.batch_report(_jobs(s, d), ["dep"], "status", "size", "error")[0]


@query("SELECT dep, 'HTTP '||(400+id%7) error, count(*) n FROM tables WHERE id%5=1 GROUP BY ALL")
def batch_errors(s, d):
    return uploads.batch_report(_jobs(s, d), ["dep"], "status", "size", "error")[1]


_ICON = "CASE estado " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in uploads.ICONS.items()) + " ELSE '❓' END"


@query(f"SELECT id, CAST(id%3 AS BIGINT) capa, estado, {_ICON} icon, substr(e,1,120) ultimo_error FROM (SELECT id, creado_en, CASE id%6 WHEN 0 THEN 'pendiente' WHEN 1 THEN 'tomado' WHEN 2 THEN 'procesando' WHEN 3 THEN 'completado' WHEN 4 THEN 'error' ELSE 'x' END estado, CASE WHEN id%6=4 THEN repeat('error '||id||'; ',20) END e FROM actas)")
def queue_listing(s, d):
    k = F.col("id")
    state = F.element_at(F.array(*[F.lit(x) for x in [*uploads.ICONS, "x"]]), (k % 6 + 1).cast("int"))
    rows = V.actas(s, d).select("id", (k % 3).alias("capa"), state.alias("estado"), "creado_en", F.when(k % 6 == 4, F.repeat(F.concat(F.lit("error "), k, F.lit("; ")), F.lit(20))).alias("ultimo_error"))
    return uploads.queue_listing(rows).select("id", "capa", "estado", "icon", "ultimo_error")


# --- detections


@query("SELECT page, min(id) id FROM det WHERE upper(text) LIKE '%TOTAL%' OR upper(text) LIKE '%VOTOS 3%' GROUP BY page")
def any_keyword(s, d):
    """The first detection that holds any keyword of a list."""
    return layout.first_keyword(V.det(s, d), "page", ["total", "votos 3"]).select("page", "id")


@query("SELECT page, id, x+270 x, y+100 y, text FROM det WHERE conf>=15 AND regexp_matches(text,'[0-9]')")
def digit_regions(s, d):
    """Detections with digits in the column of votes, in page coordinates."""
    return layout.digit_regions(V.det(s, d), F.lit(300), F.lit(200), F.lit(100), F.lit(1900), F.lit(900), F.lit(2000), least=15).select("page", "id", "x", "y", "text")


@query("SELECT page, x, y, w, 40 h, text, round(conf/50.0::DOUBLE,2) conf FROM det WHERE conf/50.0::DOUBLE>0.25::DOUBLE")
def reader_boxes(s, d):
    """Corner points of a reader's answers as boxes."""
    x, y, w = (F.col(c).cast("double") for c in "xyw")
    point = lambda a, b: F.array(a, b)
    corners = F.array(point(x + 0.4, y + 0.9), point(x + w, y), point(x + w + 0.9, y + 41.0), point(x, y + 40.0))
    read = V.det(s, d).select("page", corners.alias("corners"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"), (F.col("conf") / 50).alias("conf"))
    return records.detections(read, 0.25, ("page",))


@query("SELECT page, id, x+450 x, y+400 y, TRY_CAST(nullif(regexp_extract(text,'[0-9]+',0),'') AS BIGINT) number, row_number() OVER (PARTITION BY page ORDER BY y, x, text) place FROM (SELECT min(id) id, page, x, y, w, text FROM det GROUP BY page, x, y, w, text)")
def zone_votes(s, d):
    """First whole numbers of a zone's texts, from the top."""
    det = V.det(s, d).groupBy("page", "x", "y", "w", "text").agg(F.min("id").alias("id"), F.max("conf").alias("conf")).withColumn("h", F.lit(40))
    found = records.zone_votes(det, "page", F.lit(900), F.lit(2000))
    return found.join(det.select("page", (F.col("x") + 450).alias("x"), (F.col("y") + 400).alias("y"), "w", "text", "id"), ["page", "x", "y", "w", "text"]).select("page", "id", "x", "y", "number", "place")


@query("SELECT page, coalesce(arg_max(text, id) FILTER (WHERE contains(upper(text),'TOTAL')),'') total, count(*) n FROM det GROUP BY page")
def token_fields(s, d):
    """Header fields by words: the last one that holds the keyword."""
    word = F.when(F.contains("text", F.lit("TOTAL")), F.concat(F.lit("Municipio:"), "text")).otherwise(F.col("text"))
    pages = V.det(s, d).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", word.alias("w")))).alias("w"), F.count("*").alias("n"))
    field = records.token_fields(F.col("w.w"))["municipio"]
    return pages.select("page", F.replace(field, F.lit("Municipio:"), F.lit("")).alias("total"), "n")


@query("SELECT l_orderkey page, l_linenumber n, CASE WHEN l_orderkey%4=0 THEN 0 ELSE round(x/w0::DOUBLE,6) END x, CASE WHEN l_orderkey%5=0 THEN 0 ELSE round(y/h0::DOUBLE,6) END y FROM (SELECT l_orderkey, l_linenumber, max(l_partkey%900) x, max(l_suppkey*37%2000) y, 1000+l_orderkey%77 w0, 2100+l_orderkey%55 h0 FROM lineitem GROUP BY ALL)")
def symbol_boxes(s, d):
    """Boxes in shares of their page; 0 on a page without size."""
    k = F.col("l_orderkey")
    li = V.load(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_partkey") % 900).alias("x"), F.max(F.col("l_suppkey") * 37 % 2000).alias("y"))
    box = records.normalised_box(F.col("x"), F.col("y"), F.lit(1), F.lit(1), F.when(k % 4 > 0, 1000 + k % 77).otherwise(0), F.when(k % 5 > 0, 2100 + k % 55).otherwise(0))
    return li.select(k.alias("page"), F.col("l_linenumber").alias("n"), box[0].alias("x"), box[1].alias("y"))


# --- calibration and risk


@query("SELECT d.doc_id, n_chars%97 score, CASE WHEN quality=0 THEN 'sospechosa' ELSE 'legitima' END label FROM documents d JOIN labels l ON l.doc_id=d.doc_id")
def labelled_scores(s, d):
    """Labels by file name without its ending."""
    scores = V.load(s, d, "documents").select("doc_id", F.concat(F.lit("acta"), "doc_id", F.lit(".pdf")).alias("filename"), (F.col("n_chars") % 97).alias("score"))
    labels = V.load(s, d, "labels").select(F.concat(F.lit("acta"), "doc_id").alias("filename"), F.when(F.col("quality") == 0, "sospechosa").otherwise("legitima").alias("label"))
    return rollups.labelled_scores(scores, labels).select("doc_id", "score", "label")


@query("SELECT t, f1 FROM (SELECT t, CAST(CASE WHEN 2*tp+fp+fn>0 THEN floor(20000*tp/(2*tp+fp+fn)) ELSE 0 END AS BIGINT) f1 FROM (SELECT t, count(CASE WHEN score>=t AND bad THEN 1 END) tp, count(CASE WHEN score>=t AND NOT bad THEN 1 END) fp, count(CASE WHEN score<t AND bad THEN 1 END) fn FROM (SELECT CAST(n_chars%97 AS BIGINT) score, quality=0 bad FROM labels l JOIN documents d ON d.doc_id=l.doc_id), (SELECT unnest(range(5,70)) t) GROUP BY t)) WHERE f1>0 ORDER BY f1 DESC, t LIMIT 1")
def calibration_first_best(s, d):
    """The first threshold of the greatest f1."""
    rows = V.load(s, d, "labels").join(V.load(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("n_chars") % 97).alias("score"), (F.col("quality") == 0).alias("bad"))
    return rollups.best_threshold(rollups.confusion(rows, s.range(5, 70).withColumnRenamed("id", "t"))).select("t", "f1")


_PARTS = "SELECT id, id%3 s, list_sort(list_filter([CASE WHEN excede THEN 'OVERVOTE' END, CASE WHEN no_coincide THEN 'SUM_MISMATCH' END, CASE WHEN firmas_bajas THEN 'OTHER' END], lambda x: x IS NOT NULL)) r, id%100 ocr FROM flagged"


@query(f"SELECT id, least(list_sum(list_concat([0], list_transform(r, lambda x: CASE x WHEN 'OVERVOTE' THEN 35 WHEN 'SUM_MISMATCH' THEN 40 ELSE 5 END))),40)::DOUBLE mathematical, (CASE s WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE 50 END)::DOUBLE signatures, CAST(15*(100-ocr) AS BIGINT) ocr_part, CAST(len(r)+(CASE WHEN s=0 THEN 0 ELSE 1 END) AS INTEGER) anomaly_count, array_to_string(list_concat(CASE s WHEN 0 THEN [] WHEN 1 THEN ['signature_incomplete'] ELSE ['signature_empty'] END, r),',') anomaly_types FROM ({_PARTS})")
def risk_breakdown(s, d):
    """Parts of the risk score, number and kinds of anomalies."""
    k = F.col("id")
    rows = rules.with_flags(V.actas(s, d))
    names = F.array_compact(F.array(F.when(F.col("excede"), "OVERVOTE"), F.when(F.col("no_coincide"), "SUM_MISMATCH"), F.when(F.col("firmas_bajas"), "OTHER")))
    x = rules.risk_breakdown(names, F.when(k % 3 == 0, "COMPLETE").when(k % 3 == 1, "INCOMPLETE").otherwise("EMPTY"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 20).otherwise(50), k % 100 / 100)
    rows = rows.select("id", x.alias("x"))
    return rows.select("id", "x.mathematical", "x.signatures", F.round(F.col("x.ocr_confidence") * 100).cast("long").alias("ocr_part"), "x.anomaly_count", F.array_join("x.anomaly_types", ",").alias("anomaly_types"))


@query("SELECT CAST(creado_en AS DATE) \"date\", count(CASE WHEN id%100>=80 THEN 1 END) critical, count(CASE WHEN id%100>=50 AND id%100<80 THEN 1 END) high, count(CASE WHEN id%100>=20 AND id%100<50 THEN 1 END) medium, count(CASE WHEN id%100<20 THEN 1 END) low FROM actas GROUP BY 1")
def levels_over_time(s, d):
    """Sheets of each level by day."""
    rows = V.actas(s, d).select(F.to_date("creado_en").alias("date"), rules.risk_level(F.col("id") % 100).alias("level"))
    return rollups.counts_by(rows, "level", {"critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "low": "LOW"}, ["date"]).drop("total")


@query("SELECT event_id, CASE WHEN user_id%3=0 THEN substr('anon-'||" + _uuid("'v'||chr(31)||event_id") + ",1,36) ELSE 'anon-'||sha256('10.0.0.'||user_id) END voter, printf('%.1f%%', (event_id%1000)/10.0::DOUBLE) share FROM events")
def anonymous_voters(s, d):
    k = F.col("event_id")
    ip = F.when(F.col("user_id") % 3 > 0, F.sha2(F.concat(F.lit("10.0.0."), "user_id"), 256))
    return V.load(s, d, "events").select("event_id", uploads.anonymous_voter(ip, F.lit("v"), k).alias("voter"), uploads.per_cent(k % 1000 / 1000).alias("share"))
