"""Stored JSON results as VARIANT: key presence, cells of a sheet, merging a key into a document, malformed rows aside.

Documents are parsed once, keep keys that nobody knows, and never fail: what isn't JSON is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAP = "map<string,variant>"


def parsed(raw: Column) -> Column:
    return F.try_parse_json(raw)


def members(document: Column) -> Column:
    """A JSON object as a map of its members; null for anything else."""
    return F.when(F.startswith(F.schema_of_variant(document), F.lit("OBJECT")), F.try_variant_get(document, "$", _MAP))


def has_key(document: Column, key: str) -> Column:
    """Whether a JSON object has the key, also with the value null; false for anything else."""
    return F.coalesce(F.map_contains_key(members(document), key), F.lit(False))


def pending(rows: DataFrame, raw: str, key: str) -> DataFrame:
    """Rows whose document lacks the key: without a document, malformed, not an object, or an object without it. The
    reason is kept in `pending`."""
    why = (
        F.when(F.coalesce(F.col(raw), F.lit("")) == "", "empty")
        .when(F.col("_v").isNull(), "malformed")
        .when(members(F.col("_v")).isNull(), "no object")
        .when(~has_key(F.col("_v"), key), "no key")
    )
    return rows.withColumn("_v", parsed(F.col(raw))).withColumn("pending", why).where("pending IS NOT NULL").drop("_v")


def split_malformed(rows: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their document as VARIANT in `document`, and apart those whose text is no JSON. A null text is no document
    and no fault: it stays with the first."""
    both = rows.withColumn("document", parsed(F.col(raw)))
    bad = F.col(raw).isNotNull() & F.col("document").isNull()
    return both.where(~bad), both.where(bad).drop("document")


def items(document: Column, path: str) -> Column:
    """The list at a path, as an array of VARIANT; empty where there is none."""
    return F.coalesce(F.try_variant_get(document, path, "array<variant>"), F.array().cast("array<variant>"))


def sheet_cells(rows: DataFrame, raw: str, fields: dict[str, str], *keep: str) -> DataFrame:
    """Cells of each sheet's stored result, one row each with its place and the chosen fields (name: type); a field that is
    absent or of another type is null. Sheets without cells, or without a readable result, give none."""
    cells = rows.select(*keep, F.posexplode(items(parsed(F.col(raw)), "$.cells")).alias("place", "_c"))
    return cells.select(*keep, "place", *[F.try_variant_get("_c", f"$.{name}", kind).alias(name) for name, kind in fields.items()])


def cell_counts(rows: DataFrame, raw: str, *keep: str) -> DataFrame:
    """The number of cells of every sheet, 0 where there is no readable result."""
    return rows.select(*keep, F.size(items(parsed(F.col(raw)), "$.cells")).alias("total"))


def with_key(raw: Column, key: str, value: Column) -> Column:
    """The document with the key set to a JSON value, all other members as they were; null if either isn't readable."""
    old = members(parsed(raw))
    kept = F.map_filter(old, lambda k, _: k != key)
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(key), parsed(value))))


def top_cells(rows: DataFrame, raw: str, key: str, score: str, most: int = 5) -> DataFrame:
    """Adds `picked`: places of the `most` cells of greatest score (a stable order: ties by place, no score as 0)."""
    cells = F.transform(items(parsed(F.col(raw)), "$.cells"), lambda c, i: F.struct((-F.coalesce(F.try_variant_get(c, f"$.{score}", "double"), F.lit(0.0))).alias("s"), i.alias("i")))
    return rows.withColumn(key, F.transform(F.slice(F.array_sort(cells), 1, most), lambda c: c["i"]))
