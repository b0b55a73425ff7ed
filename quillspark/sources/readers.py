"""Readers: JSON arrays by split, multi-format datasets, text-only CSV, append logs, image folders, embedding caches."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import SPLIT_LABELS, mapped
from quillspark.functions.vectors import l2_normalize

from . import members

ENCOUNTER = (
    "encounter_id string, author_id string, image_ids array<string>, query_title_es string, query_content_es string, query_title_en string, "
    "query_content_en string, responses array<struct<content_es:string,content_en:string,author_id:string>>"
)
#: Score columns in order of preference.
SCORE_COLUMNS = ("similarity_score", "score", "similarity")
IMAGE_GLOB = "*.{jpg,jpeg,png,webp,JPG,JPEG,PNG,WEBP}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_bytes(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> None:
    """A file on any file system that Spark reaches."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        for c in chunks:
            out.write(bytearray(c))
    finally:
        out.close()


def discover(spark: SparkSession, pattern: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, parent, name of the files of a glob pattern, in order; excluded names left out. A listing: the driver holds it."""
    fs, p = _fs(spark, pattern)
    found = [f.getPath() for f in (fs.globStatus(p) or []) if not f.isDirectory()]
    rows = sorted((f.toString(), f.getParent().getName(), f.getName()) for f in found if f.getName() not in exclude)
    return spark.createDataFrame(rows, "path string, parent string, name string")


def split_of(path: Column) -> Column:
    """File stem as split name, aliases resolved; of a folder of parts the folder's."""
    whole = F.regexp_replace(path, r"/part-[^/]*$", "")
    return mapped(F.regexp_extract(whole, r"([^/]+?)(?:\.[^./]*)?$", 1), SPLIT_LABELS)


def load_splits(spark: SparkSession, folder: str, names: list[str], schema: str = ENCOUNTER, strict: bool = False) -> DataFrame:
    """Encounters of several JSON arrays with their split; missing files are left out, or raise if strict."""
    paths = [f"{folder.rstrip('/')}/{n}.json" for n in names]
    found = [p for p in paths if path_exists(spark, p)]
    if strict and len(found) < len(paths):
        raise FileNotFoundError(f"missing: {sorted(set(paths) - set(found))}")
    if not found:
        return spark.createDataFrame([], T.StructType([*T._parse_datatype_string(schema), T.StructField("split", T.StringType())]))
    return spark.read.schema(schema).json(found, multiLine=True).withColumn("split", split_of(F.input_file_name()))


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def read_csv_text(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """CSV with a header, every column text, quoted newlines kept; the byte-order mark of a first header is dropped."""
    if missing_ok and not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType([]))
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_records(spark: SparkSession, paths: str | list[str], schema: str | None = None, first: bool = False) -> DataFrame:
    """Records of JSON, JSON-lines and CSV files, of folders of them and of the members of zip archives, a partition each (see members).
    Without a schema it is told from all records."""
    members.register(spark)
    found = spark.read.format("quill_members").option("first", str(first)).load("\n".join([paths] if isinstance(paths, str) else paths))
    if schema is None:
        schema = found.agg(F.schema_of_variant_agg(F.try_parse_json("record"))).first()[0]
        if not schema.startswith("OBJECT<"):
            return spark.createDataFrame([], T.StructType([]))
        schema = schema.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    return found.select(F.from_json("record", schema).alias("r")).select("r.*")


def read_dataset(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """The first path that exists, by its suffix: .jsonl, .json, .csv, or a .zip that holds one of them."""
    for path in paths:
        if not path_exists(spark, path):
            continue
        suffix = PurePosixPath(path).suffix
        if suffix == ".zip":
            return read_records(spark, path, schema, first=True)
        if suffix == ".jsonl":
            return spark.read.schema(schema).json(path) if schema else spark.read.json(path)
        if suffix == ".json":
            return read_json_array(spark, path, schema)
        if suffix == ".csv":
            return read_csv_text(spark, path)
        raise ValueError(f"no reader for {path}")
    raise FileNotFoundError(", ".join(paths))


def with_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as numbers, empty and malformed ones null."""
    return df.withColumns({c: F.expr(f"try_cast(nullif(trim(`{c}`), '') AS double)") for c in columns if c in df.columns})


def score_records(df: DataFrame, columns: tuple[str, ...] = SCORE_COLUMNS) -> DataFrame:
    """Records of a score file: its rows, or the elements of the first list of records that an object holds."""
    if any(c in df.columns for c in columns):
        return df
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    return df.select(F.inline(lists[0])) if lists else df


def read_scores(df: DataFrame, columns: tuple[str, ...] = SCORE_COLUMNS, keep: tuple[str, ...] = ()) -> DataFrame:
    """`score`: the first score column that a row has, with the columns to keep; a row without one is left out."""
    there = [c for c in columns if c in df.columns]
    if not there:
        raise ValueError(f"none of {columns} in {df.columns}")
    return df.select(F.coalesce(*[F.col(c).try_cast("double") for c in there]).alias("score"), *keep).filter("score is not null")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON lines; blank and malformed lines are left out."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.filter(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r")).filter("r is not null").select("r.*")


def read_flat_json(spark: SparkSession, path: str) -> DataFrame:
    """Scalar fields of a JSON object as text; nested ones are left out."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType([]))
    df = spark.read.json(path, multiLine=True)
    return df.select(*[F.col(f.name).cast("string") for f in df.schema if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))])


def image_index(spark: SparkSession, folders: list[str], last_wins: bool = False) -> DataFrame:
    """name, path of the images below the folders: for equal names the first folder's, or the last one's."""
    parts = [spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).option("recursiveFileLookup", "true").load(f).select("path", F.lit(k).alias("folder")) for k, f in enumerate(folders)]
    every = reduce(DataFrame.unionByName, parts).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    order = [F.desc("folder"), F.desc("path")] if last_wins else ["folder", "path"]
    return every.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(*order))).filter("r = 1").select("name", "path")


def find_images(rows: DataFrame, index: DataFrame, name: str = "image_id", extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp")) -> DataFrame:
    """rows with image_path: by name, else by name and extension where it has no dot."""
    tried = F.when(F.instr(name, ".") > 0, F.array(F.col(name))).otherwise(F.array(F.col(name), *[F.concat(F.col(name), F.lit(e)) for e in extensions]))
    wanted = rows.select(F.col(name).alias("_id"), tried.alias("_tried")).distinct()
    hits = wanted.select("_id", F.posexplode("_tried").alias("_try", "name")).join(index, "name").groupBy("_id").agg(F.min(F.struct("_try", "path")).alias("h"))
    return rows.join(hits, rows[name] == hits["_id"], "left").select(*rows.columns, F.col("h.path").alias("image_path"))


def load_corpus(cases: DataFrame, splits: str = "all") -> DataFrame:
    """Cases of "all" or of a comma list of splits."""
    return cases if splits.strip() == "all" else cases.filter(F.col("split").isin([s.strip() for s in splits.split(",")]))


def with_embeddings(cases: DataFrame, cache: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """cases with unit vectors of the cache; a case without one gets a zero vector and has_vector false."""
    joined = cases.join(cache.select(key, F.col(column).alias("_v")), key, "left")
    zero = F.array_repeat(F.lit(0.0), size)
    return joined.withColumn("has_vector", F.col("_v").isNotNull()).withColumn(column, F.when(F.col("_v").isNull(), zero).otherwise(l2_normalize("_v"))).drop("_v")
