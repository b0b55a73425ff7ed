"""A data source over files of records: a partition for each JSON array, JSON-lines, CSV or log file, and for each such member of a
zip archive. Executors open, unpack and parse; the driver lists names alone."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Suffixes that hold records, in order of preference within an archive.
RECORDS = (".jsonl", ".json", ".csv", ".log")
#: Text read at once from an array of records.
CHUNK = 1 << 20


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path, and the path in it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def array_records(text: io.TextIOBase) -> Iterator[str]:
    """The elements of a JSON array one after the other, each as JSON text; an object alone is one record. Of the text only CHUNK and the
    element at hand are held. Text that isn't JSON ends the file."""
    decoder, held, begun, done = json.JSONDecoder(), "", False, False
    while True:
        held = held.lstrip(" \t\r\n,") if begun else held.lstrip("﻿ \t\r\n")
        if held and not begun:
            begun = True
            if held[0] == "[":
                held = held[1:]
                continue
        if held and held[0] == "]":
            return
        try:
            record, end = decoder.raw_decode(held) if held else (None, 0)
            if held and (done or end < len(held) or isinstance(record, (dict, list))):  # a bare number may go on
                yield json.dumps(record, ensure_ascii=False)
                held = held[end:]
                continue
        except ValueError:
            if done:
                return
        if done:
            return
        more = text.read(max(CHUNK, len(held)))
        done = not more
        held += more


def records(stream: io.BufferedIOBase, suffix: str) -> Iterator[tuple[int, str]]:
    """(number, JSON text) of a file's records. Blank and malformed lines are left out; CSV rows are objects of texts by the header."""
    text = io.TextIOWrapper(stream, "utf-8-sig", errors="replace", newline="")
    if suffix == ".json":
        yield from enumerate(array_records(text))
    elif suffix == ".csv":
        for k, row in enumerate(csv.DictReader(text)):
            yield k, json.dumps({a: b for a, b in row.items() if a is not None}, ensure_ascii=False)
    else:
        for k, line in enumerate(text):
            try:
                found = json.loads(line)
            except ValueError:
                continue
            if isinstance(found, dict):
                yield k, json.dumps(found, ensure_ascii=False)


def kind_of(path: str) -> str:
    """The suffix that tells how a file is read; a part file's is its folder's, if that has one."""
    p = PurePosixPath(path)
    return p.parent.suffix if p.name.startswith("part-") and p.parent.suffix in RECORDS else p.suffix


class Member(InputPartition):
    def __init__(self, path: str, member: str | None) -> None:
        super().__init__((path, member))
        self.path, self.member = path, member


class MembersReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split("\n") if p]
        self.first = options.get("first", "false").lower() == "true"

    def _files(self, path: str) -> list[str]:
        """A file, or the visible files below a folder that hold records."""
        fs, at = open_store(path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == pafs.FileType.File:
            return [path]
        at = at.rstrip("/")
        prefix = path.rstrip("/").removesuffix(at)
        hidden = lambda f: any(p[0] in "._" for p in f.path.removeprefix(at).strip("/").split("/"))
        inside = fs.get_file_info(pafs.FileSelector(at, recursive=True))
        return sorted(prefix + f.path for f in inside if f.type == pafs.FileType.File and not hidden(f) and PurePosixPath(f.path).suffix in (*RECORDS, ".zip", ".txt"))

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in self.paths:
            for f in self._files(path):
                if PurePosixPath(f).suffix != ".zip":
                    out.append(Member(f, None))
                    continue
                fs, at = open_store(f)
                with fs.open_input_file(at) as file, zipfile.ZipFile(file) as z:  # the directory at the archive's end
                    names = sorted((n for n in z.namelist() if PurePosixPath(n).suffix in RECORDS), key=lambda n: (RECORDS.index(PurePosixPath(n).suffix), n))
                out += [Member(f, n) for n in (names[:1] if self.first else names)]
        return out or [Member("", None)]

    def read(self, partition: Member) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, at = open_store(partition.path)
        with fs.open_input_file(at) as file:
            if partition.member is None:
                for k, r in records(file, kind_of(partition.path)):
                    yield partition.path, None, k, r
                return
            with zipfile.ZipFile(file) as z, z.open(partition.member) as inside:
                for k, r in records(inside, PurePosixPath(partition.member).suffix):
                    yield partition.path, partition.member, k, r


class Members(DataSource):
    """path, member (of an archive), number and JSON text of every record. Options: path (several by line feeds; folders are searched),
    first (of an archive only the first member, in the order of RECORDS)."""

    @classmethod
    def name(cls) -> str:
        return "quill_members"

    def schema(self) -> str:
        return "path string, member string, number long, record string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return MembersReader(self.options)


def register(spark: SparkSession) -> None:
    from quillspark.shipping import ship_code

    ship_code(spark)
    spark.dataSource.register(Members)
