"""Uploads and settings: evidence rows, the gate to the second layer, configuration keys, fixture lookups, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mutate import insert_missing

# Configuration keys that may be set; the gate of uploads to the second layer (over it, not from it on).
KEYS = ["umbral_min_votos", "umbral_consenso_pct", "capa1_score_revision", "capa1_score_prioridad_alta"]
GATE = 0.6
# What the configuration begins with.
DEFAULTS = {"umbral_min_votos": "5", "umbral_consenso_pct": "0.80", "capa1_score_revision": "0.60", "capa1_score_prioridad_alta": "0.85"}


def stable_uuid(*parts: Column) -> Column:
    """An id in the form of a UUID that is the same in each run, from the MD5 of its parts."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def anonymous_voter(ip_hash: Column, *parts: Column) -> Column:
    """anon- and the hash of the address, or where there is none a stable id of other parts; 36 characters of it."""
    return F.coalesce(F.concat(F.lit("anon-"), F.nullif(ip_hash, F.lit(""))), F.substring(F.concat(F.lit("anon-"), stable_uuid(*parts)), 1, 36))


def per_cent(share: Column, places: int = 1) -> Column:
    return F.when(share.isNotNull(), F.format_string(f"%.{places}f%%", share.cast("double") * 100))


def image_url(content: Column, most: int = 100) -> Column:
    """A data URL with the first characters of the image's base64 text; only the bytes behind them are encoded."""
    head = F.regexp_replace(F.base64(F.substring(content, 1, 3 * (most + 3) // 4)), "[\r\n]", "")
    return F.concat(F.lit("data:image/png;base64,"), F.substring(head, 1, most), F.lit("..."))


def evidence_rows(uploads: DataFrame, stored: bool = True) -> DataFrame:
    """Evidence of uploads(upload_id, mesa_key, content, grosor, separador, tinta, score): scores as JSON, the score as
    confidence, state pendiente; without a store nothing is saved, which the status tells."""
    scores = F.to_json(F.struct(F.col("grosor").alias("score_grosor"), F.col("separador").alias("score_separador"), F.col("tinta").alias("score_tinta"), F.col("score").alias("score_global")))
    rows = uploads.select(
        stable_uuid(F.col("upload_id")).alias("id"), "upload_id", "mesa_key", image_url(F.col("content")).alias("imagen_url"), scores.alias("votos_extraidos"),
        F.lit("vlm").alias("metodo_extraccion"), F.col("score").alias("confianza_extraccion"), F.lit("pendiente").alias("estado_revision"),
    )
    error = F.when(F.col("mesa_key").isNull(), "mesa_key missing")
    status = F.when(error.isNotNull(), "error").otherwise("saved") if stored else F.lit("skipped")
    return rows.withColumns({"status": status, "message": error if stored else F.lit("no store configured")})


def gated(uploads: DataFrame, gate: float = GATE) -> DataFrame:
    """Whether an upload's score is over the gate (a score just at it is not), and why."""
    over = F.coalesce(F.col("score") > gate, F.lit(False))
    low = F.concat(F.lit("score_global="), F.when(F.col("score").isNull(), "none").otherwise(F.format_string("%.2f", F.col("score").cast("double"))), F.lit(f" ≤ umbral {gate}"))
    slot = stable_uuid(F.lit("slot"), F.col("upload_id"))
    queued = F.concat(F.lit("Encolado en cola_procesamiento slot="), F.substring(slot, 1, 8), F.lit("... para Capa 2 (VLM)"))
    return uploads.withColumns({"enqueued": over, "slot_id": F.when(over, slot), "reason": F.when(over, queued).otherwise(low)})


def second_layer(uploads: DataFrame, gate: float = GATE) -> DataFrame:
    """Queue rows of the uploads that pass the gate."""
    rows = gated(uploads, gate).where("enqueued")
    return rows.select(F.col("slot_id").alias("id"), "mesa_key", F.lit(2).alias("capa_actual"), F.lit("pendiente").alias("estado_slot"), stable_uuid(F.col("upload_id")).alias("evidence_id"))


def settings(old: DataFrame, changes: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The configuration (clave, valor) after changes(clave, valor, at), of each key the latest; and apart, with the reason,
    changes of keys that may not be set."""
    known = F.coalesce(F.col("clave").isin(keys or KEYS), F.lit(False))
    new = changes.where(known).groupBy("clave").agg(F.max_by("valor", "at").alias("_v"))
    after = old.join(new, "clave", "full").select("clave", F.coalesce("_v", "valor").alias("valor"))
    return after, changes.where(~known).withColumn("reason", F.lit("Clave no permitida"))


def with_defaults(config: DataFrame) -> DataFrame:
    """The configuration with the default of each key that isn't there; what is set stays."""
    first = config.sparkSession.createDataFrame(list(DEFAULTS.items()), "clave string, valor string")
    return insert_missing(config.select("clave", "valor"), first, ["clave"])


def setting_values(config: DataFrame, wanted: DataFrame) -> DataFrame:
    """The value of each wanted key (clave), empty where it isn't set."""
    return wanted.join(config.select("clave", "valor"), "clave", "left").withColumn("valor", F.coalesce("valor", F.lit("")))


def looked_up(slots: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Slots with their fixture by mesa_key and success; without one there is an error row. A mesa's fixture is the one of
    least `number`."""
    first = fixtures.groupBy("mesa_key").agg(F.min_by(F.struct(*[c for c in fixtures.columns if c != "mesa_key"]), "number").alias("fixture"))
    rows = slots.join(first, "mesa_key", "left")
    found = F.col("fixture").isNotNull()
    return rows.withColumns({"success": found, "error": F.when(~found, F.concat(F.lit("No fixture for "), F.coalesce("mesa_key", F.lit("none"))))})


def batch_report(rows: DataFrame, keys: list[str], status: str, size: str, error: str) -> tuple[DataFrame, DataFrame]:
    """Of each batch: downloaded, failed, skipped and bytes; and its errors with their number, one row for each text."""
    count = lambda v: F.count_if(F.col(status) == v)
    sums = rows.groupBy(*keys).agg(count("success").alias("downloaded"), count("error").alias("failed"), count("skipped").alias("skipped"), F.coalesce(F.sum(F.when(F.col(status) == "success", F.col(size))), F.lit(0)).alias("bytes"))
    errors = rows.where(F.col(status) == "error").groupBy(*keys, error).agg(F.count("*").alias("n"))
    return sums, errors


# Signs of a queue's states.
ICONS = {"pendiente": "⬜", "tomado": "🔄", "procesando": "⚙️", "completado": "✅", "error": "❌"}


def queue_listing(queue: DataFrame) -> DataFrame:
    """The queue by layer, state and age (ties by id), with a sign for the state and errors cut to 120 characters."""
    signs = F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv])
    rows = queue.withColumns({"icon": F.coalesce(signs[F.col("estado")], F.lit("❓")), "ultimo_error": F.substring("ultimo_error", 1, 120)})
    return rows.orderBy("capa", "estado", "creado_en", "id")
