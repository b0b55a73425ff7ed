"""Sinks: JSON, JSON lines, CSV, projected CSV, manifests, guarded overwrite, upserts, append logs, zip bundles, Markdown."""

from __future__ import annotations

import json
import shutil
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import three_decimals
from quillspark.shipping import ship_code

from .members import open_store
from .readers import write_bytes


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])


def write_dataset(df: DataFrame, path: str, kind: str, overwrite: bool = False, single_file: bool = False) -> None:
    """kind: parquet, jsonl or csv. An existing path raises unless overwrite. single_file is for exports of bounded size."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite" if overwrite else "errorifexists")
    if kind == "csv":
        flattened(out).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, escape='"')
    else:
        {"parquet": writer.parquet, "jsonl": writer.json}[kind](path)


def write_json_array(df: DataFrame, path: str, overwrite: bool = False, single_file: bool = False) -> None:
    """JSON arrays that executors write: a folder of files, one array a partition, committed as any table is; a table without
    rows may have files without an array. single_file is for exports of bounded size."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of an array: a row waits until it is known whether another follows."""
        last, opened = None, "["
        for b in batches:
            lines = ([] if last is None else [last]) + b.column(0).to_pylist()
            if lines:
                last = lines.pop()
                yield pa.RecordBatch.from_arrays([pa.array([*([opened] if opened else []), *(x + "," for x in lines)], pa.string())], names=["value"])
                opened = ""
        yield pa.RecordBatch.from_arrays([pa.array([x for x in (opened, last, "]") if x], pa.string())], names=["value"])

    ship_code(df.sparkSession)
    (rows.coalesce(1) if single_file else rows).mapInArrow(bracketed, "value string").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> int:
    """A file for each row, written by the tasks that hold the rows; how many there are. Names are below the folder."""
    ship_code(df.sparkSession)
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = open_store(f"{root}/{at}")
                fs.create_dir(str(PurePosixPath(path).parent), recursive=True)
                with fs.open_output_stream(path) as out:  # the same bytes if a task is run again
                    out.write(raw or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.select(name, content).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def projected(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in fixed order as text, missing ones and nulls empty, others left out."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])


def formatted(df: DataFrame, numbers: list[str]) -> DataFrame:
    """Numbers with three decimals, empty where missing."""
    return df.withColumns({c: three_decimals(F.col(c)) for c in numbers})


def manifest(df: DataFrame, split: str = "split") -> DataFrame:
    """One row: row_count, split_counts (name and count, sorted), columns."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.array_sort(F.collect_list(F.struct(F.col(split).alias("split"), "n"))).alias("split_counts")).withColumn("columns", F.array(*[F.lit(c) for c in df.columns]))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, then new; keys are compared as text; a column that one side lacks is null there."""
    probe = new.select(*[F.col(k).cast("string").alias(f"_{k}") for k in keys]).distinct()
    kept = old.join(probe, [F.col(k).cast("string").eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def zip_bundle(spark: SparkSession, files: list[str], out: str) -> None:
    """Files, or folders of parts, in one deflated archive that a task of an executor writes; parts go in under their folder's name and
    number. The archive has another name until it is whole."""
    ship_code(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        fs, target = open_store(out)
        fs.create_dir(str(PurePosixPath(target).parent), recursive=True)
        with fs.open_output_stream(f"{target}.open") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                store, at = open_store(f)
                if store.get_file_info(at).type == pafs.FileType.File:
                    named = [(PurePosixPath(f).name, at)]
                else:
                    parts = sorted(x.path for x in store.get_file_info(pafs.FileSelector(at)) if x.base_name.startswith("part-"))
                    stem, suffix = PurePosixPath(f).stem, PurePosixPath(f).suffix
                    named = [(f"{stem}{suffix}" if len(parts) == 1 else f"{stem}-{k:05d}{suffix}", p) for k, p in enumerate(parts)]
                for name, p in named:
                    with store.open_input_stream(p) as source, z.open(name, "w", force_zip64=True) as inside:
                        shutil.copyfileobj(source, inside, 1 << 20)
        fs.move(f"{target}.open", target)
        yield pa.RecordBatch.from_arrays([pa.array([len(files)], pa.int64())], names=["n"])

    spark.range(1, numPartitions=1).mapInArrow(run, "n long").collect()  # a count


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A report table of at most `limit` rows, in the order of df."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)])


def write_manifest(df: DataFrame, path: str) -> None:
    row = manifest(df).first()
    text = json.dumps({"row_count": row.row_count, "split_counts": {s.split: s.n for s in row.split_counts}, "columns": list(row.columns)}, indent=2)
    write_bytes(df.sparkSession, path, [text.encode()])
