"""Tables with several writers: a folder of numbered commits beside the data. A commit is a file that is put only if its number is
free, so of two writers one wins; the other looks at what the winner added and tries the next number."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import _fs, write_bytes

#: Every so many commits one tells all folders, so that a reader takes few files.
WHOLE_EVERY = 20
#: Attempts of one commit before it raises.
MOST_ATTEMPTS = 100


@dataclass
class Snapshot:
    """A version of a table: the folders of each bucket that hold its rows. Version 0 has none."""

    version: int = 0
    folders: dict[str, set[str]] = field(default_factory=dict)

    def after(self, commit: dict) -> Snapshot:
        folders = {b: set(x) for b, x in self.folders.items()} if "whole" not in commit else {b: set(x) for b, x in commit["whole"].items()}
        for b, x in commit.get("remove", {}).items() if "whole" not in commit else ():
            folders[b] = folders.get(b, set()) - set(x)
        for b, x in commit.get("add", {}).items() if "whole" not in commit else ():
            folders.setdefault(b, set()).update(x)
        return Snapshot(commit["version"], folders)

    def paths(self, buckets: Iterable[int] | None = None) -> list[str]:
        names = self.folders if buckets is None else [str(b) for b in buckets]
        return sorted(f for b in names for f in self.folders.get(b, ()))


def put_if_absent(spark: SparkSession, path: str, content: bytes) -> bool:
    """Put a whole file under a name that nobody has; False if somebody has it. The file is written aside first: a hard link of a local
    file and a rename elsewhere fail where the name is taken."""
    aside = f"{path}.{uuid.uuid4().hex}.aside"
    write_bytes(spark, aside, [content])
    fs, target = _fs(spark, path)
    source = _fs(spark, aside)[1]
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(source.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
        return not fs.exists(target) and fs.rename(source, target)
    finally:
        fs.delete(source, False)


class Table:
    """Rows of one schema in buckets by the hash of the key columns, as text. A reader sees one version whole."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16) -> None:
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    # ----------------------------------------------------------------------- versions
    def _commit_path(self, version: int) -> str:
        return f"{self.root}/_commits/{version:020d}.json"

    def _versions(self) -> list[int]:
        fs, p = _fs(self.spark, f"{self.root}/_commits/*.json")
        return sorted(int(f.getPath().getName()[:20]) for f in fs.globStatus(p) or [])

    def _read_commit(self, version: int) -> dict:
        fs, p = _fs(self.spark, self._commit_path(version))
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def snapshot(self, since: Snapshot | None = None) -> Snapshot:
        """The newest version; from `since` on, only later commits are read."""
        now = since or Snapshot()
        later = [v for v in self._versions() if v > now.version]
        whole = [v for v in later if v % WHOLE_EVERY == 0]
        for v in later if not whole else [x for x in later if x >= whole[-1]]:
            now = now.after(self._read_commit(v))
        return now

    def read(self, at: Snapshot | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        paths = (at or self.snapshot()).paths(buckets)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # ----------------------------------------------------------------------- writing
    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows in a folder of their own; the folders of the buckets that got some."""
        out = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(out)
        fs, p = _fs(self.spark, f"{out}/_bucket=*")
        names = [f.getPath().getName() for f in fs.globStatus(p) or []]
        return {n.split("=")[1]: [f"{out}/{n}"] for n in names}

    def _commit(self, base: Snapshot, add: dict[str, list[str]], remove: dict[str, list[str]]) -> Snapshot | None:
        """The version after `base`, or None if somebody else made it."""
        new = base.after({"version": base.version + 1, "add": add, "remove": remove})
        told = {"version": new.version, "add": add, "remove": remove}
        if new.version % WHOLE_EVERY == 0:
            told["whole"] = {b: sorted(x) for b, x in new.folders.items() if x}
        return new if put_if_absent(self.spark, self._commit_path(new.version), json.dumps(told).encode()) else None

    def _attempts(self, attempt: Callable[[Snapshot, Snapshot | None], tuple[dict, dict]], before_commit: Callable[[int], None] | None) -> Snapshot:
        """attempt(version, the version of the last attempt) gives folders to add and remove; tried until its version is the next."""
        last = None
        for n in range(MOST_ATTEMPTS):
            now = self.snapshot(last)
            add, remove = attempt(now, last)
            if not add and not remove:
                return now
            if before_commit:
                before_commit(n)
            done = self._commit(now, add, remove)
            if done:
                return done
            last = now
        raise RuntimeError(f"{self.root}: others were first {MOST_ATTEMPTS} times")

    def append_first(self, rows: DataFrame, order: list[str], before_commit: Callable[[int], None] | None = None) -> Snapshot:
        """Append the first row of each key that the table doesn't have. A writer that comes second leaves out the keys that others added
        meanwhile, which it reads from their folders alone. Null keys are a key."""
        first = Window.partitionBy(*self.keys).orderBy(*order)
        mine = {"rows": rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n"), "add": None}

        def attempt(now: Snapshot, last: Snapshot | None) -> tuple[dict, dict]:
            added = {b: x - (last.folders.get(b, set()) if last else set()) for b, x in now.folders.items()}
            paths = sorted(f for x in added.values() for f in x)
            if mine["add"] is not None and not paths:
                return mine["add"], {}
            held = self.read(Snapshot(0, added)).select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct() if paths else None
            old = self.read(Snapshot(0, {b: set(x) for b, x in mine["add"].items()})) if mine["add"] else mine["rows"]
            fresh = old if held is None else old.join(held, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys], "left_anti")
            mine["add"] = self._write(fresh)
            return mine["add"], {}

        return self._attempts(attempt, before_commit)

    def upsert(self, rows: DataFrame, before_commit: Callable[[int], None] | None = None) -> Snapshot:
        """Put rows in place of those of equal keys (as text). Only the buckets that have such keys are written anew; a writer that comes
        second does its part again for those that others changed meanwhile. Of rows of one key in `rows` all stay."""
        new = rows.withColumn("_b", self._bucket()).persist()
        touched = sorted(r._b for r in new.select("_b").distinct().collect())  # numbers of buckets
        text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(""))
        probe = new.select(*[text(k).alias(f"_{k}") for k in self.keys]).distinct()
        mine: dict = {"add": {}}

        def attempt(now: Snapshot, last: Snapshot | None) -> tuple[dict, dict]:
            stale = [b for b in touched if last is None or now.folders.get(str(b)) != last.folders.get(str(b))]
            if stale:
                old = self.read(now, stale).join(probe, [text(k) == F.col(f"_{k}") for k in self.keys], "left_anti")
                fresh = self._write(old.unionByName(new.filter(F.col("_b").isin(stale)).drop("_b")))
                mine["add"] = {b: x for b, x in mine["add"].items() if int(b) not in stale} | fresh
            return mine["add"], {str(b): sorted(now.folders.get(str(b), ())) for b in touched if now.folders.get(str(b))}

        try:
            return self._attempts(attempt, before_commit)
        finally:
            new.unpersist()
