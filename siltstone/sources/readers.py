"""Readers of CSV, Parquet, JSON lines, ontologies and file trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.nulls import without_nan
from .schemas import of_columns


def csv(spark: SparkSession, path: str, schema: StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with a header by a declared schema; NaN is NULL. Splits of the file take the place of chunks."""
    df = spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path)
    return without_nan(df.select(*columns) if columns else df)


def feature_csv(spark: SparkSession, path: str, labelled_only: bool = False) -> DataFrame:
    """A feature CSV whose types follow from its header; empty results keep the schema."""
    header = spark.read.option("header", True).csv(path).columns
    df = csv(spark, path, of_columns(header))
    return df.where("target_x2 is not null") if labelled_only else df


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return without_nan(spark.read.parquet(path))


def class_columns(df: DataFrame, known: Sequence[str] = ("mol_id", "SMILES")) -> list[str]:
    """All columns that aren't known ones: the classes of a wide label table."""
    return [c for c in df.columns if c not in known]


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines by a strict schema: a malformed line or an unknown key is an error when the row is read; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    known = F.array(*(F.lit(f.name) for f in schema.fields))
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    unknown = F.array_except(F.json_object_keys("value"), known)
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(unknown, ", ")))).otherwise(row)
    return lines.select(checked.alias("r")).select("r.*")


def json_line_count(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank: where a stopped run goes on."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of text files, each file's lines numbered from 1."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("_n", "line")).select("file", (F.col("_n") + 1).alias("n"), "line")


def corpus(spark: SparkSession, root: str, pattern: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """(path, size, text) of all files below a folder; bytes that aren't UTF-8 become replacement characters."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    df = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)
    path = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    inside = F.substr(path, F.char_length(F.lit(root.split(":", 1)[-1].rstrip("/").replace("//", "/"))) + 2)
    if most_bytes is not None:
        df = df.where(F.col("length") <= most_bytes)
    return df.select(inside.alias("path"), F.col("length").alias("size"), F.try_validate_utf8(F.col("content").cast("string")).alias("valid"), "content").select("path", "size", F.coalesce("valid", F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def images(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """(path, size, content) of pictures in order of path; decoding is left to a caller."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg}").load(root).select("path", F.col("length").alias("size"), "content").orderBy("path")
    return df if limit is None else df.limit(limit)


def lead_map(pairs: DataFrame, known: Sequence[str]) -> DataFrame:
    """(source, lead) in upper case, known leads alone."""
    return pairs.select(F.upper("source").alias("source"), F.upper("lead").alias("lead")).where(F.col("lead").isin(*known))


def locate(spark: SparkSession, candidates: Sequence[str], name: str) -> str:
    """The first of the candidate folders that holds ``name``, on whatever store they are."""
    for folder in candidates:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return folder
    raise FileNotFoundError(f"{name} in none of {list(candidates)}")
