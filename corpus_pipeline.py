"""The corpus pipeline: five stages that each apply one corpus operator to what the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the
last returns the packed pieces. Between stages the rows are written as Parquet to the shared folder and read again.
No stage has a SQL form (ORACLE_SQL is None); the tests hold the stages against brute-force versions.

Every decision is about a row: rows that share a doc_id with other texts, and rows without one, are judged by their own
text. Defined results: null and empty texts have no language and go in the first stage; where no document has a label,
nothing can be rejected and all rows stay; an item of the benchmark without text matches nothing; personal data leaves
a null text null; packing takes a null doc_id as it is; repeated rows count once from the second stage on; empty tables
give empty results; extra columns of the input are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tallylens.llm.common import settle, table
from tallylens.llm.decontaminate import contaminated
from tallylens.llm.jaccard_join import jaccard_classes
from tallylens.llm.language import UNKNOWN, fit, predict, training_counts
from tallylens.llm.packing import pack
from tallylens.llm.pii import redact

#: Chunks whose ids a worker keeps while packing, as executors still hold what the stages before left.
ENCODED = 400_000
#: Keys of removed rows that may be broadcast (about 16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but the rows of gone(doc_id, mark), mark being the hash of the text."""
    gone = settle(gone.distinct().toDF("_gone_id", "_gone_mark"), "removed")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_mark"))
    return docs.join(gone, same, "left_anti")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found (text without a letter has none); the model learns from the documents' own
    labels, and where there is none all documents stay."""
    model = fit(training_counts(docs))
    if not model[0]:
        return docs
    names = [f"c{k}" for k in range(len(docs.columns))]
    found = predict(docs.toDF(*names), *model, keep=tuple(names), text=names[docs.columns.index("text")])
    return found.where(F.col("lang_pred") != UNKNOWN).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (shingles of 5 words, Jaccard 0.8): that of the smallest id, or of
    the smallest hash among texts of that id. Rows that share doc_id and text count once."""
    rows = settle(jaccard_classes(docs, width=5, percent=80).where("cid is not null").select("doc_id", "mark", "component"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    first = rows.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("size")).where("size > 1")
    gone = rows.join(first, "component").where(~(F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))))
    kept = _without(docs, gone.select("doc_id", "mark"))
    repeated = rows.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, as it stands or with other values."""
    key = F.xxhash64("doc_id", "text")  # names a row, not an id
    found = settle(contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_gone")).distinct(), "removed")
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_KEYS else found, key == F.col("_gone"), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew; null texts stay null."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows; a null text has its end id alone."""
    return pack(docs, memo=ENCODED)


STAGES = [("language", languages), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("pii", personal_data), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; returns what the last stage makes."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = settle(stage(spark, rows, sf_dir), f"stage-{name}")
    return rows
