"""The universe document (JSON of blocks of nodes) and folders of documents as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylens.functions.text import zfill

NODE = "struct<idDepartmentCode:string,municipalityCode:string,idZoneCode:string,standCode:string,numberStand:string,idCorporationCode:string,expectedName:string,idTransmissionCode:long,idTransmissionCodeStatus:int,idStand:string>"
BLOCKS = f"map<string,struct<nodes:array<{NODE}>>>"


def flatten_universe(raw: DataFrame, column: str = "value") -> DataFrame:
    """One row per node with a name, from texts of {data: blocks} or of blocks alone; codes are zero-padded."""
    wrapped = F.from_json(column, f"data {BLOCKS}")["data"]
    blocks = F.coalesce(wrapped, F.from_json(column, BLOCKS))
    node = F.explode(F.flatten(F.transform(F.map_values(blocks), lambda b: F.coalesce(b["nodes"], F.array().cast(f"array<{NODE}>")))))
    rows = raw.select(node.alias("n")).where(F.length("n.expectedName") > 0)
    code = lambda c, w: F.coalesce(zfill(F.col(f"n.{c}"), w), F.lit(""))
    return rows.select(code("idDepartmentCode", 2).alias("dep"), code("municipalityCode", 3).alias("muni"), code("idZoneCode", 3).alias("zona"), code("standCode", 2).alias("puesto"), code("numberStand", 3).alias("mesa"), F.col("n.expectedName").alias("expected_name"), F.col("n.idTransmissionCode").alias("code"), F.col("n.idTransmissionCodeStatus").alias("status"))


def list_size(raw: DataFrame, key: str = "transmissioncodes", column: str = "value") -> DataFrame:
    """Adds the number of entries of the list under a key of each document; 0 where it isn't there."""
    listed = F.try_variant_get(F.try_parse_json(column), f"$.{key}", "array<variant>")
    return raw.withColumn("entries", F.coalesce(F.size(listed), F.lit(0)))


def read_universe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Texts (value) of universe documents, one a line, and apart those that are no JSON object."""
    lines = spark.read.text(path)
    parsed = F.try_parse_json("value")
    good = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    return lines.where(good), lines.where(~good)


def documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder with size, sha256, a check of their head, and the error of those that can't be used (null if
    none); content stays in the executors. File sources skip files without any byte, so these have no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    head = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    error = F.when(~head, "no PDF head").when(F.col("length") < 100, "under 100 bytes")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), error.isNull().alias("valid"), error.alias("error"))


def document_counts(docs: DataFrame) -> DataFrame:
    """Numbers of good and bad files, and bytes of all."""
    return docs.agg(F.count_if("valid").alias("good"), F.count_if(~F.col("valid")).alias("bad"), F.sum("size").alias("bytes"))
