"""Mutations as functions of old state and changes: upserts, overrides, constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the greatest by `order` and then by its other columns: a group-by that keeps a single row."""
    rest = [c for c in df.columns if c not in keys]
    kept = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(kept.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_if_null: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of new replace those of old with the same keys; named columns keep the old value where the new is null.
    op tells inserted, updated and kept rows apart. Of several new rows of a key the latest by `order` counts (without an
    order the greatest), so none is doubled; columns that only serve the order are left out."""
    new = latest_by(new, keys, list(order))
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in values], F.lit(1).alias("_o"))
    b = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in values], F.lit(1).alias("_n"))
    both = a.join(b, keys, "full")
    has = F.col("_n").isNotNull()
    pick = lambda c: F.when(has, F.coalesce(f"n_{c}", f"o_{c}") if c in keep_old_if_null else F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    op = F.when(~has, "kept").when(F.col("_o").isNull(), "inserted").otherwise("updated")
    return both.select(*keys, *[pick(c).alias(c) for c in values], op.alias("op"))


def upsert_totals(after: DataFrame) -> DataFrame:
    """Rows in all, inserted and updated, of what upsert() gave: the audit row of a refresh."""
    return after.agg(F.count("*").alias("total"), F.count_if(F.col("op") == "inserted").alias("inserted"), F.count_if(F.col("op") == "updated").alias("updated"))


def insert_missing(old: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(defaults.join(old, keys, "left_anti"))


def override(rows: DataFrame, changes: DataFrame, key: str, column: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Latest human value over the computed one; the latest by `order` where there are several."""
    one = latest_by(changes.select(key, column, *order), [key], list(order))
    return rows.join(one.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def outside(df: DataFrame, column: str, domain: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(domain))


def orphans(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
