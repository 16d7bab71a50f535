"""Sources: labelled file trees, images, CSV splits and JSON settings, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import paths
from ..operators.audit import require_columns

# The suffixes of the profile, and those of the splitter, which has no tif.
PROFILE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")
SPLITTER_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
CLASS_LABELS = {"Fraud": 1, "Non-Fraud": 0}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def binary_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = PROFILE_SUFFIXES) -> DataFrame:
    """Files below a folder by lower-cased suffix; a missing folder has none.  Columns not used are not read."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(paths.suffix(F.col("path")).isin(*suffixes))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """The profile's sorted file list."""
    return binary_files(spark, folder).select("path").orderBy("path")


def labelled_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SPLITTER_SUFFIXES) -> DataFrame:
    """path, label and class_name of the files in a folder per class; a missing class folder is an error."""
    for name in CLASS_LABELS:
        if not exists(spark, f"{root}/{name}"):
            raise FileNotFoundError(f"no folder {root}/{name}")
    out = None
    for name, label in CLASS_LABELS.items():
        one = binary_files(spark, f"{root}/{name}", suffixes).select("path", F.lit(label).alias("label"), F.lit(name).alias("class_name"))
        out = one if out is None else out.unionByName(one)
    return out


def split_class_records(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """The profile's records of a split/class/file tree: path, split, class, valid, width, height."""
    out = None
    for split in splits:
        for name in CLASS_LABELS:
            if exists(spark, f"{root}/{split}/{name}"):
                one = images(spark, f"{root}/{split}/{name}").select("path", F.lit(split).alias("split"), F.lit(name).alias("class"), "valid", "width", "height")
                out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schemas.EDA_RECORD)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images with validity and size; undecodable files stay, as invalid, with null sizes."""
    df = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).where(paths.suffix(F.col("image.origin")).isin(*PROFILE_SUFFIXES))
    size = lambda c: F.when(F.col("image.width") >= 0, F.col(f"image.{c}"))
    return df.select(F.col("image.origin").alias("path"), (F.col("image.width") >= 0).alias("valid"), size("width").alias("width"), size("height").alias("height"), "image")


def hashed_files(files: DataFrame) -> DataFrame:
    """MD5 and SHA-256 of whole files, in the JVM."""
    return files.select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def csv_split(spark: SparkSession, path: str, schema=schemas.SAMPLES) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A split file with its required columns checked and cast; missing files and bad labels are errors."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    df = require_columns(spark.read.option("header", "true").csv(path))
    return df.withColumns({"path": F.col("path").cast("string"), "label": F.col("label").cast("int"), "split": F.lit(split)})


def tagged_union(parts: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """All parts with their names, rows repeated as they are."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def json_settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as one row; nested fields by their dotted names."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)
