"""Domain views over the driver's tables, by integer formulas that any SQL engine repeats (see VIEWS_SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylens.functions.text import zfill
from tallylens.operators.rules import findings, with_findings

#: The same views in SQL; each is a WITH entry, in order.
VIEWS_SQL = {
    "geo": "SELECT lpad(CAST(n_nationkey AS VARCHAR),2,'0') dep, n_name dep_name, r_name zone FROM nation JOIN region ON r_regionkey=n_regionkey",
    "lines": "SELECT l_orderkey, " + ", ".join(f"CAST(sum(CASE WHEN l_linenumber IN ({k}) THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) {n}" for n, k in (("c1", "1,6"), ("c2", "2,7"), ("blanco", "3"), ("nulos", "4"), ("no_marcados", "5"))) + " FROM lineitem GROUP BY l_orderkey",
    "base": "SELECT o_orderkey id, lpad(CAST(c_nationkey AS VARCHAR),2,'0') dep, lpad(CAST(o_custkey%100 AS VARCHAR),3,'0') muni, coalesce(c1,0) c1, coalesce(c2,0) c2, coalesce(blanco,0) blanco, coalesce(nulos,0) nulos, coalesce(no_marcados,0) no_marcados, o_orderstatus estado, o_orderpriority prio, o_orderdate creado_en FROM orders JOIN customer ON c_custkey=o_custkey LEFT JOIN lines ON l_orderkey=o_orderkey",
    "actas": "SELECT id, dep, muni, dep||'-'||muni||'-'||CAST(id/4 AS BIGINT) mesa_key, c1,c2,blanco,nulos,no_marcados, c1+c2+blanco+nulos+no_marcados-(CASE WHEN id%11=0 THEN 5 WHEN id%11=1 THEN -3 ELSE 0 END) urna, c1+c2+blanco+nulos+no_marcados-(CASE WHEN id%11=0 THEN 5 WHEN id%11=1 THEN -3 ELSE 0 END)+id%4 e11, id%3 incinerados, 3+id%5 firmas, 1+least(id%7,1) paginas_total, 2 paginas_esperadas, id%13<>0 qr_ok, CASE WHEN id%13<>0 THEN '' ELSE 'X' END||dep||'-'||muni||'-'||CAST(id/4 AS BIGINT)||'-PRE-2026' qr_raw, estado, prio, creado_en FROM base",
}
VIEWS_SQL["actas"] = VIEWS_SQL["actas"].replace("CAST(id/4 AS BIGINT)", "CAST((id-id%4) AS VARCHAR)")
VIEWS_SQL["flagged"] = "SELECT *, suma>urna excede, suma<>urna no_coincide, abs(e11-urna)>incinerados nivelacion, paginas_total<paginas_esperadas incompleta, firmas<6 firmas_bajas, NOT qr_ok qr_malo FROM (SELECT *, c1+c2+blanco+nulos+no_marcados suma FROM actas)"
VIEWS_SQL["found"] = "SELECT acta_id*10+k id, acta_id, mesa_key, dep, creado_en, rule, score2, oficial, ciudadano, CASE WHEN score2>=2 THEN 'alta' ELSE 'media' END prioridad, CASE (acta_id*10+k)%4 WHEN 0 THEN 'por_verificar' WHEN 1 THEN 'en_revision' WHEN 2 THEN 'verificado_anomalo' ELSE 'verificado_legitimo' END estado, acta_id%5=0 congelada FROM (" + " UNION ALL ".join(
    f"SELECT id acta_id, mesa_key, dep, creado_en, {k} k, '{n}' rule, {s} score2, CAST({a} AS VARCHAR) oficial, CAST({b} AS VARCHAR) ciudadano FROM flagged WHERE {f}"
    for k, (n, s, a, b, f) in enumerate((("aritmetica_excede_total", "2", "urna", "suma", "excede"), ("aritmetica_no_coincide", "2", "urna", "suma", "no_coincide"), ("nivelacion_inconsistente", "2", "e11", "urna", "nivelacion"), ("paginas_incompletas", "2", "paginas_esperadas", "paginas_total", "incompleta"), ("firmas_insuficientes", "CASE WHEN firmas>=4 THEN 1 ELSE 2 END", "6", "firmas", "firmas_bajas"), ("qr_metadata_mismatch", "2", "mesa_key||'-PRE-2026'", "qr_raw", "qr_malo")))
) + ")"
VIEWS_SQL["evidence"] = "SELECT id*2+r id, mesa_key, CASE WHEN (id+r)%10=0 THEN NULL ELSE (id*7+r)%100 END confianza, CASE WHEN id%17=0 THEN 'rechazada_calidad' ELSE 'aceptada' END estado, creado_en, e11, urna, incinerados, c1+(id%9-4)*(r+1) c1, c2, CASE WHEN id%6=0 THEN NULL ELSE blanco END blanco, nulos+CASE WHEN id%8=0 THEN 30 ELSE 0 END nulos, no_marcados FROM actas, (SELECT 0 r UNION ALL SELECT 1) WHERE id%3=0"
VIEWS_SQL["votes"] = "SELECT event_id vote_id, user_id%40 disc, user_id*7+event_id%5 voter, event_id%6<>(user_id%3) legit, ts, value FROM events"
VIEWS_SQL["cells"] = "SELECT l_orderkey acta_id, l_linenumber idx, CAST(l_quantity AS BIGINT)*2 score, CAST(l_partkey AS BIGINT) x FROM lineitem"
VIEWS_SQL["tables"] = "SELECT p_partkey id, lpad(CAST(p_size%33 AS VARCHAR),2,'0') dep, lpad(CAST(p_partkey%20 AS VARCHAR),3,'0') muni, CASE p_partkey%5 WHEN 0 THEN 'cached' WHEN 1 THEN 'error' WHEN 2 THEN 'downloading' ELSE 'pending' END status, p_name, p_brand, p_type, p_partkey%1000 size_bytes, p_partkey%72 hours_ago, p_partkey%50-25 expires_in FROM part"
VIEWS_SQL["det"] = "SELECT l_orderkey page, l_partkey*8+l_linenumber id, CASE WHEN l_returnflag='A' THEN 'VOTACION' WHEN l_returnflag='N' THEN 'VOTOS '||CAST(l_linenumber AS VARCHAR) ELSE 'TOTAL' END text, l_partkey%900 x, (l_suppkey*37+l_linenumber*61)%2000 y, 20+l_partkey%60 w, CAST(l_quantity AS BIGINT) conf FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_suppkey, l_quantity FROM lineitem)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo(spark, d):
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(zfill(F.col("n_nationkey"), 2).alias("dep"), F.col("n_name").alias("dep_name"), F.col("r_name").alias("zone"))


def actas(spark, d):
    q, k = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    part = lambda name, *ns: F.sum(F.when(k.isin(*ns), q).otherwise(0)).alias(name)
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(part("c1", 1, 6), part("c2", 2, 7), part("blanco", 3), part("nulos", 4), part("no_marcados", 5))
    rows = load(spark, d, "orders").join(load(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    votes = ("c1", "c2", "blanco", "nulos", "no_marcados")
    key, muni, dep = F.col("id"), zfill(F.col("o_custkey") % 100, 3), zfill(F.col("c_nationkey"), 2)
    rows = rows.select(F.col("o_orderkey").alias("id"), dep.alias("dep"), muni.alias("muni"), *[F.coalesce(v, F.lit(0)).alias(v) for v in votes], F.col("o_orderstatus").alias("estado"), F.col("o_orderpriority").alias("prio"), F.col("o_orderdate").alias("creado_en"))
    urna = sum((F.col(v) for v in votes[1:]), F.col("c1")) - F.when(key % 11 == 0, 5).when(key % 11 == 1, -3).otherwise(0)
    return rows.withColumn("urna", urna).withColumns({"mesa_key": F.concat_ws("-", "dep", "muni", (key - key % 4).cast("string")), "e11": F.col("urna") + key % 4, "incinerados": key % 3, "firmas": 3 + key % 5, "paginas_total": 1 + F.least(key % 7, F.lit(1)), "paginas_esperadas": F.lit(2), "qr_ok": key % 13 != 0}).withColumn("qr_raw", F.concat(F.when(F.col("qr_ok"), "").otherwise("X"), "mesa_key", F.lit("-PRE-2026")))


def _state(finding):
    k = finding % 4
    return F.when(k == 0, "por_verificar").when(k == 1, "en_revision").when(k == 2, "verificado_anomalo").otherwise("verificado_legitimo")


def found(spark, d):
    rows = findings(actas(spark, d))
    return rows.withColumns({"estado": _state(F.col("id")), "congelada": F.col("acta_id") % 5 == 0})


def sheets(spark, d):
    """Sheets with flags, the states of their findings (found) and whether they have evidence, from one pass."""
    rows = with_findings(actas(spark, d))
    return rows.withColumns({"estados": F.transform("findings", lambda f: _state(F.col("id") * 10 + f["k"])), "con": F.col("id") % 3 == 0})


def evidence(spark, d):
    rows = actas(spark, d).where("id % 3 = 0").withColumn("r", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("a", F.col("id"))
    i, r = F.col("a"), F.col("r")
    return rows.select((i * 2 + r).alias("id"), "mesa_key", F.when((i + r) % 10 != 0, (i * 7 + r) % 100).alias("confianza"), F.when(i % 17 == 0, "rechazada_calidad").otherwise("aceptada").alias("estado"), "creado_en", "e11", "urna", "incinerados", (F.col("c1") + (i % 9 - 4) * (r + 1)).alias("c1"), "c2", F.when(i % 6 != 0, F.col("blanco")).alias("blanco"), (F.col("nulos") + F.when(i % 8 == 0, 30).otherwise(0)).alias("nulos"), "no_marcados")


def votes(spark, d):
    return load(spark, d, "events").select(F.col("event_id").alias("vote_id"), (F.col("user_id") % 40).alias("disc"), (F.col("user_id") * 7 + F.col("event_id") % 5).alias("voter"), (F.col("event_id") % 6 != F.col("user_id") % 3).alias("legit"), "ts", "value")


def cells(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("acta_id"), F.col("l_linenumber").alias("idx"), (F.col("l_quantity").cast("long") * 2).alias("score"), F.col("l_partkey").alias("x"))


def tables(spark, d):
    p = F.col("p_partkey")
    status = F.when(p % 5 == 0, "cached").when(p % 5 == 1, "error").when(p % 5 == 2, "downloading").otherwise("pending")
    return load(spark, d, "part").select(p.alias("id"), zfill(F.col("p_size") % 33, 2).alias("dep"), zfill(p % 20, 3).alias("muni"), status.alias("status"), "p_name", "p_brand", "p_type", (p % 1000).alias("size_bytes"), (p % 72).alias("hours_ago"), (p % 50 - 25).alias("expires_in"))


def det(spark, d, placed=False):
    """Detections; with `placed` also where each stands in the table's files (`file_name`, `row_index`), the first of equal rows."""
    keys = ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_quantity"]
    li = load(spark, d, "lineitem")
    if placed:
        li = li.groupBy(*keys).agg(F.min(F.struct("_metadata.file_name", "_metadata.row_index")).alias("at"))
    else:
        li = li.select(*keys).distinct()
    text = F.when(F.col("l_returnflag") == "A", F.lit("VOTACION")).when(F.col("l_returnflag") == "N", F.concat(F.lit("VOTOS "), F.col("l_linenumber").cast("string"))).otherwise("TOTAL")
    return li.select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("id"), text.alias("text"), (F.col("l_partkey") % 900).alias("x"), ((F.col("l_suppkey") * 37 + F.col("l_linenumber") * 61) % 2000).alias("y"), (20 + F.col("l_partkey") % 60).alias("w"), F.col("l_quantity").cast("long").alias("conf"), *(["at.*"] if placed else []))
