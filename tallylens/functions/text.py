"""Text and number expressions: codes, lenient integers, URLs, file names, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zfill(c: Column, width: int) -> Column:
    """Zero-padded on the left; a longer text is kept whole. Null stays null."""
    text = c.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def lenient_int(c: Column) -> Column:
    """The integer of a trimmed text, or null where it isn't one ('12.5', '', 'x')."""
    text = F.trim(c)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


def mesa_key(dep: Column, muni: Column, zona: Column, puesto: Column, mesa: Column) -> Column:
    return F.concat_ws("-", zfill(dep, 2), zfill(muni, 3), zfill(zona, 2), zfill(puesto, 3), zfill(mesa, 3))


def cache_key(dep: Column, muni: Column, zona: Column, puesto: Column, mesa: Column) -> Column:
    return F.concat(F.lit("acta:"), F.concat_ws("/", zfill(dep, 2), zfill(muni, 3), zfill(zona, 3), zfill(puesto, 2), zfill(mesa, 3)))


def pdf_url(base: str, dep: Column, muni: Column, zona: Column, puesto: Column, mesa: Column, name: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.concat_ws("/", zfill(dep, 2), zfill(muni, 3), zfill(zona, 3), zfill(puesto, 2), zfill(mesa, 3), name), F.lit(".pdf"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def first_address(forwarded: Column, peer: Column) -> Column:
    """First forwarded address, trimmed, else the peer's."""
    return F.coalesce(F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit("")), peer)


def ip_hash(ip: Column) -> Column:
    return F.sha2(ip, 256)


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
