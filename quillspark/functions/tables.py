"""Table functions for SQL: polymorphic functions over TABLE arguments, registered by name, with a choice of backend."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Backend(Protocol):
    """Index rows in, then scores of all of them for a query."""

    def add(self, text: str | None, vector: list[float] | None) -> None: ...

    def scores(self, text: str | None, vector: list[float] | None) -> np.ndarray: ...


class DenseBackend:
    """Inner product of vectors; rows without one score 0."""

    def __init__(self) -> None:
        self.rows: list = []
        self.matrix: np.ndarray | None = None

    def add(self, text: str | None, vector: list[float] | None) -> None:
        self.rows.append(vector)

    def scores(self, text: str | None, vector: list[float] | None) -> np.ndarray:
        if vector is None:
            return np.zeros(len(self.rows))
        if self.matrix is None:
            none = [0.0] * len(vector)
            self.matrix = np.array([none if v is None else v for v in self.rows], np.float64).reshape(len(self.rows), len(vector))
        return self.matrix @ np.asarray(vector, np.float64)


class TokenBackend:
    """Shared distinct words, by the words that the query has."""

    def __init__(self) -> None:
        self.at: dict[str, list[int]] = {}
        self.n = 0

    def add(self, text: str | None, vector: list[float] | None) -> None:
        for w in set((text or "").lower().split()):
            self.at.setdefault(w, []).append(self.n)
        self.n += 1

    def scores(self, text: str | None, vector: list[float] | None) -> np.ndarray:
        asked, out = set((text or "").lower().split()), np.zeros(self.n)
        for w in asked:
            out[self.at.get(w, [])] += 1
        return out / max(1, len(asked))


#: Backends by name; register() takes more.
BACKENDS: dict[str, Callable[[], Backend]] = {"dense": DenseBackend, "tokens": TokenBackend}


def backend_of(name: str, backends: dict[str, Callable[[], Backend]] = BACKENDS) -> Callable[[], Backend]:
    if name not in backends:
        raise ValueError(f"no backend {name!r}; there are {', '.join(sorted(backends))}")
    return backends[name]


def _constant(arg: AnalyzeArgument | None, name: str, default: Any) -> Any:
    if arg is None:
        return default
    if not arg.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return arg.value


def _columns(table: AnalyzeArgument) -> T.StructType:
    if not table.isTable:
        raise ValueError("the first argument must be a TABLE")
    return table.dataType


def search_function(backends: dict[str, Callable[[], Backend]]) -> type:
    class Search:
        """quill_search(TABLE(rows) PARTITION BY block ORDER BY side, k, backend): rows(side, id, text, vector), index rows ("index")
        before queries. For each query the k best of the block: query, doc, score, rank; equal scores by the lesser doc."""

        def __init__(self) -> None:
            self.index, self.ids = None, []

        @staticmethod
        def analyze(rows: AnalyzeArgument, k: AnalyzeArgument | None = None, backend: AnalyzeArgument | None = None) -> AnalyzeResult:
            columns = _columns(rows)
            lacks = {"side", "id", "text", "vector"} - set(columns.names)
            if lacks:
                raise ValueError(f"rows lack {', '.join(sorted(lacks))}")
            if _constant(k, "k", 5) < 1:
                raise ValueError("k must be 1 or more")
            backend_of(_constant(backend, "backend", "dense"), backends)
            kind = columns["id"].dataType
            return AnalyzeResult(T.StructType([T.StructField("query", kind), T.StructField("doc", kind), T.StructField("score", T.DoubleType()), T.StructField("rank", T.LongType())]))

        def eval(self, rows: Row, k: int = 5, backend: str = "dense") -> Iterator[tuple]:
            if self.index is None:
                self.index = backend_of(backend, backends)()
            if rows["side"] == "index":
                self.index.add(rows["text"], rows["vector"])
                self.ids.append(rows["id"])
                return
            scores = self.index.scores(rows["text"], rows["vector"])
            if not len(scores):
                return
            least = np.partition(scores, len(scores) - k)[len(scores) - k] if k < len(scores) else -np.inf
            best = sorted((-float(scores[i]), self.ids[i]) for i in np.flatnonzero(scores >= least).tolist())[:k]
            for n, (s, doc) in enumerate(best, 1):
                yield rows["id"], doc, -s, n

    return Search


class Expand:
    """quill_expand(TABLE(rows), column, element): a row for each element of an array column, with its place (`place`, from 0); the other
    columns stay as they are, and a row whose array is null or empty has one row with nulls."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, element: AnalyzeArgument | None = None) -> AnalyzeResult:
        columns, name = _columns(rows), _constant(column, "column", None)
        if name not in columns.names or not isinstance(columns[name].dataType, T.ArrayType):
            raise ValueError(f"{name!r} is no array column")
        kept = [f for f in columns if f.name != name]
        return AnalyzeResult(T.StructType([*kept, T.StructField("place", T.LongType()), T.StructField(_constant(element, "element", name), columns[name].dataType.elementType)]))

    def eval(self, rows: Row, column: str, element: str | None = None) -> Iterator[tuple]:
        kept = [rows[c] for c in rows.__fields__ if c != column]
        for k, x in enumerate(rows[column] or []):
            yield (*kept, k, x)
        if not rows[column]:
            yield (*kept, None, None)


def register(spark: SparkSession, backends: dict[str, Callable[[], Backend]] | None = None) -> None:
    """Name the functions in the session; own backends come beside or in place of the given ones."""
    from pyspark.sql.functions import udtf

    from quillspark.shipping import ship_code

    ship_code(spark)
    spark.udtf.register("quill_search", udtf(search_function(BACKENDS | (backends or {}))))
    spark.udtf.register("quill_expand", udtf(Expand))
