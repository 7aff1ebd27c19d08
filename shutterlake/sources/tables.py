"""Readers: Parquet tables with pruned columns, image listings, album documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File extensions of photos.
PHOTO_EXTENSIONS = "jpg jpeg jpe jfif png arw srf sr2 cr2 cr3 crw nef nrw dng raf raw rw2 orf ori pef ptx srw rwl 3fr fff iiq erf kdc dcr mef mos x3f tif tiff webp".split()

ITEM = T.StructType([T.StructField("status", T.StringType()), T.StructField("note", T.StringType()), T.StructField("updated_at", T.StringType())])
SELECTION = T.StructType([T.StructField("gallery_uuid", T.StringType()), T.StructField("status", T.StringType()), T.StructField("client_notes", T.StringType()), T.StructField("items", T.MapType(T.StringType(), ITEM))])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, of which only the named columns are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def photo_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime, filename of photos below a folder; names that start with . or ~$ are skipped. The contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    return found.withColumn("filename", name).where(~F.col("filename").startswith(".") & ~F.col("filename").startswith("~$") & F.lower(F.element_at(F.split("filename", r"\."), -1)).isin(PHOTO_EXTENSIONS))


def selections(spark: SparkSession, path: str) -> DataFrame:
    """Album selection documents, one row each, items as a map from photo id to status, note and time."""
    return spark.read.schema(SELECTION).json(path, multiLine=True)


#: The photo catalog over the orders table, in expressions that Spark and DuckDB read alike.
PHOTOS = {
    "photo_id": "o_orderkey",
    "project_id": "o_custkey % 25",
    "group_id": "concat('G', cast(o_custkey as string))",
    "user_selection": "case o_orderstatus when 'O' then 'UNRATED' when 'F' then 'BEST' else 'REJECT' end",
    "ai_recommendation": "case substring(o_orderpriority, 1, 1) when '1' then 'BEST' when '2' then 'SELECTED' when '3' then 'REVIEW' when '4' then 'SIMILAR' else 'REJECT' end",
    "ai_score": "o_totalprice",
    "star_rating": "cast(o_orderkey % 6 as int)",
    "scene": "case o_orderkey % 4 when 0 then 'Mandap' when 1 then 'Stage' when 2 then 'Outdoor' else 'Reception' end",
    "client_selection": "case o_orderkey % 7 when 0 then 'SELECTED' when 1 then '' else 'UNRATED' end",
    "filename": "concat('IMG_', lpad(cast(o_orderkey as string), 8, '0'), case when o_orderkey % 11 = 0 then '_edited' when o_orderkey % 13 = 0 then ' (2)' else '' end, '.JPG')",
    "is_edited": "o_orderkey % 3 = 0",
    "taken": "o_orderdate",
}


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} as {k}" for k, e in PHOTOS.items()])


#: Album entries over the lineitem table.
BRIDGE = {
    "gallery_id": "l_suppkey",
    "photo_id": "l_orderkey",
    "choice": "case l_returnflag when 'A' then 'SELECTED' when 'R' then 'REJECTED' else 'UNRATED' end",
    "note": "l_linestatus",
}


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {k}" for k, e in BRIDGE.items()])
