"""Results of an analysis as parents and children, failure rows, download records, and copies of tables with new ids.

All are functions from the state and what came in to the new state: repeating one changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one block of dense_ids(); a block is one window partition.
BLOCK_BITS = 16


def analysis_id(table_id: Column, batch: str) -> Column:
    """The same for each run of a batch, so children find their parent without a sequence."""
    return F.xxhash64(F.lit(batch), table_id)


def parents(rows: DataFrame, batch: str) -> DataFrame:
    """One analysis row for each sheet of rows(table_id, pdf_sha256, signature_status, densities, signature_risk, page1, page2,
    candidates, summary, anomalies, risk_score, risk_level): maps as JSON texts, confidence as the mean of both pages, valid
    if no mathematical rule was violated."""
    votes = lambda field: F.to_json(F.map_from_entries(F.transform("candidates", lambda c: F.struct(c["number"].cast("string"), c[field]))))
    total = lambda name: F.col(f"summary.{name}").alias(name)
    return rows.select(
        analysis_id(F.col("table_id"), batch).alias("analysis_id"), "table_id", "pdf_sha256", "signature_status",
        F.size(F.filter("densities", lambda d: d >= 0.15)).alias("signatures_found"), F.size("densities").alias("signatures_expected"),
        F.to_json("densities").alias("signature_ink_densities"), "signature_risk", F.round((F.col("page1") + F.col("page2")) / 2, 4).alias("ocr_confidence"),
        total("total_votes"), total("blank_votes"), total("null_votes"), total("unmarked_votes"), votes("votes").alias("candidate_votes"), votes("confidence").alias("candidate_confidences"),
        "risk_score", "risk_level", F.size("anomalies").alias("anomaly_count"), (F.size("anomalies") == 0).alias("math_valid"),
    )


def children(rows: DataFrame, batch: str) -> DataFrame:
    """One row for each anomaly of each sheet, with its parent's id and its place."""
    return rows.select(analysis_id(F.col("table_id"), batch).alias("analysis_id"), "table_id", F.posexplode("anomalies").alias("place", "a")).select("analysis_id", "table_id", "place", "a.*")


def failures(expected: DataFrame, done: DataFrame, batch: str) -> DataFrame:
    """Failure rows, as of parents(), for the expected sheets (table_id) that have no analysis of any kind."""
    # One aggregation by id, so that no task sorts both sides of a join; a null id is never done.
    both = expected.select("table_id", F.lit(False).alias("_done")).unionAll(done.select("table_id", F.col("table_id").isNotNull().alias("_done")).where("_done"))
    missing = both.groupBy("table_id").agg(F.bool_or("_done").alias("_done"), F.bool_or(~F.col("_done")).alias("_due")).where("_due AND NOT _done")
    fixed = {"pdf_sha256": F.lit("ERROR"), "risk_score": F.lit(100.0), "risk_level": F.lit("CRITICAL"), "anomaly_count": F.lit(1), "math_valid": F.lit(False)}
    return missing.select(*[fixed.get(f.name, analysis_id(F.col("table_id"), batch) if f.name == "analysis_id" else F.col("table_id") if f.name == "table_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in done.schema if f.name != "batch"])


def persist(rows: DataFrame, folder: str, batch: str, expected: DataFrame | None = None) -> None:
    """Write a batch's parents, children and failure rows under `folder`, from rows that are computed once. A batch is one
    partition that is replaced as a whole, so a repeated or broken run leaves no double rows.

    The rows go to folder/rows first, with their children inside; both tables are written from there, so a lost executor
    never computes one of them from other values than the other."""
    spark = rows.sparkSession
    put = lambda df, kind: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/{kind}")
    put(rows, "rows")
    kept = spark.read.parquet(f"{folder}/rows").where(F.col("batch") == batch).drop("batch")
    put(children(kept, batch), "children")
    mine = parents(kept, batch)
    put(mine.unionByName(failures(expected, mine, batch)) if expected is not None else mine, "parents")


def with_risk(tables: DataFrame, done: DataFrame) -> DataFrame:
    """Tables with the level and score of their analysis; those without one keep what they have."""
    new = done.groupBy(F.col("table_id").alias("id")).agg(F.max_by("risk_level", "risk_score").alias("_l"), F.max("risk_score").alias("_s"))
    return tables.join(new, "id", "left").withColumns({"risk_level": F.coalesce("_l", "risk_level"), "risk_score": F.coalesce("_s", "risk_score")}).drop("_l", "_s")


def downloaded(tables: DataFrame, files: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New states of tables(id, status, sha256, size, download_count, last_error) and files(table_id, sha256, size) after
    log(table_id, at, ok, sha256, size, error).

    Each success counts one download; the latest success gives the state, the hash and the size and clears the error; a
    table with failures only is marked with the latest one's error. Of a (table, hash) one file row is kept."""
    won = F.when(F.col("ok"), F.col("at"))
    each = log.groupBy(F.col("table_id").alias("id")).agg(
        F.count_if("ok").alias("_n"),
        F.max_by(F.struct("sha256", "size"), won).alias("_f"),
        F.max_by("error", F.when(~F.col("ok"), F.col("at"))).alias("_e"),
    )
    good, any_ = F.coalesce("_n", F.lit(0)) > 0, F.col("_n").isNotNull()
    new = tables.join(each, "id", "left").withColumns(
        {
            "status": F.when(good, "cached").when(any_, "error").otherwise(F.col("status")),
            "sha256": F.when(good, F.col("_f.sha256")).otherwise(F.col("sha256")),
            "size": F.when(good, F.col("_f.size")).otherwise(F.col("size")),
            "download_count": F.coalesce("download_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
            "last_error": F.when(good, F.lit(None)).when(any_, F.col("_e")).otherwise(F.col("last_error")),
        }
    )
    came = log.where("ok").groupBy("table_id", "sha256").agg(F.max_by("size", "at").alias("size"))
    return new.drop("_n", "_f", "_e"), files.unionByName(came.join(files, ["table_id", "sha256"], "left_anti"))


def first_success(attempts: DataFrame, key: str, least: int = 10_000, **lowest: Column) -> DataFrame:
    """Of each key's attempts(place, url, status, size) the first that came with status 200 and more than `least` bytes;
    nulls, and the number of attempts, where none did. Further columns are the lowest of an expression over all such
    attempts."""
    good = (F.col("status") == 200) & (F.col("size") > least)
    more = [F.min(F.when(good, c)).alias(n) for n, c in lowest.items()]
    return attempts.groupBy(key).agg(F.min_by(F.struct("place", "url", "size"), F.when(good, F.col("place"))).alias("_f"), F.count("*").alias("attempts"), *more).select(key, "_f.*", "attempts", *lowest)


def stored_files(tables: DataFrame, files: DataFrame) -> DataFrame:
    """Tables(id, sha256) with a stored file of their hash (the first path of several) and the error of those without one."""
    one = files.groupBy("sha256").agg(F.min("path").alias("path"))
    rows = tables.join(one, "sha256", "left")
    lack = F.when(F.col("sha256").isNull(), F.concat(F.lit("No PDF available for table "), F.col("id"))).when(F.col("path").isNull(), F.concat(F.lit("PDF not in acquisition storage: sha256="), "sha256"))
    return rows.withColumn("error", lack)


def parents_updated(sheets: DataFrame, flagged: DataFrame, layer: int = 0) -> DataFrame:
    """Sheets with the totals and flags of flagged(id, ...), and the highest layer that they went through."""
    new = [c for c in flagged.columns if c != "id"]
    both = sheets.join(flagged.select("id", *[F.col(c).alias(f"_{c}") for c in new]), "id", "left")
    hit = F.col(f"_{new[0]}").isNotNull()
    out = both.withColumns({c: F.coalesce(f"_{c}", *([c] if c in sheets.columns else [])) for c in new})
    return out.withColumn("capa_maxima", F.when(hit, F.greatest(F.coalesce("capa_maxima", F.lit(layer)), F.lit(layer))).otherwise(F.col("capa_maxima"))).drop(*[f"_{c}" for c in new])


# --- copies with new ids


def dense_ids(rows: DataFrame, key: str, name: str = "new_id") -> DataFrame:
    """Numbers from 1 in order of an integer key, without one task that sees all rows: a row's place in its block of 2^16
    key values, plus the rows of the blocks before. Only the blocks' counts are summed in one task."""
    rows = rows.withColumn("_block", F.shiftright(F.col(key).cast("long"), BLOCK_BITS))
    before = F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("_block").agg(F.count("*").alias("_n")).select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(key))
    return rows.withColumn("_place", place).join(offsets, "_block").withColumn(name, F.col("_before") + F.col("_place")).drop("_block", "_place", "_before")


def booleans(rows: DataFrame, nullable: Sequence[str] = (), filled: Sequence[str] = ()) -> DataFrame:
    """0/1 columns as booleans: null stays null in the first ones and becomes false in the others."""
    return rows.withColumns({c: F.col(c) != 0 for c in nullable} | {c: F.coalesce(F.col(c) != 0, F.lit(False)) for c in filled})


def rekeyed(children: DataFrame, parents: DataFrame, key: str, old: str = "id", new: str = "new_id") -> tuple[DataFrame, DataFrame]:
    """Children with their parent's new id in place of the old one, and apart those whose parent isn't there."""
    ids = parents.select(F.col(old).alias(key), F.col(new).alias("_new"))
    both = children.join(ids, key, "left")
    return both.where("_new IS NOT NULL").withColumn(key, F.col("_new")).drop("_new"), both.where("_new IS NULL").drop("_new")


def reset(tables: dict[str, DataFrame], sheets: str, cleared: Sequence[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The state in which all sheets wait for their first layer and the cleared tables are empty; and the number of rows
    that each table loses or gets back."""
    fresh = {"estado_procesamiento": F.lit("pendiente"), "capa_maxima_procesada": F.lit(0)}
    after = {n: df.limit(0) if n in cleared else df.withColumns(fresh) if n == sheets else df for n, df in tables.items()}
    counts = None
    for n in (sheets, *cleared):
        one = tables[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return after, counts


def cooled(hot: DataFrame, cold: DataFrame, key: str, old: Column) -> tuple[DataFrame, DataFrame]:
    """Hot and cold rows after rows that are `old` were copied: what is cold already isn't copied again, and only rows
    that are cold leave the hot place."""
    goes = hot.where(F.coalesce(old, F.lit(False)))
    colder = cold.unionByName(goes.join(cold.select(key), key, "left_anti"))
    return hot.where(~F.coalesce(old, F.lit(False))), colder
