"""BPE encoding and decoding through a distinct-word table and an id-to-piece table.

White space never lies inside a token of the word-ended vocabulary, so a text's ids are those of its white-space
separated words in order; the mark that ends a word is a word of its own. Each worker splits its blocks of texts, encodes every distinct
word once with the tokenizers library (its table lives from task to task, up to a bound), and joins the ids back by
position; decoding joins ids to pieces. Nothing is shuffled: the words of open-ended prose grow with the input (half of
them occur once), and moving texts and words between tasks costs more than encoding a word once in each worker.

Nulls and empty texts have no tokens; repeated rows are encoded like any other; extra columns are carried through, and an
own column named like the result gives way; a very long text is looked up in parts, so that the table keeps its bound; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import Block, TokenTable, bounds, documents, map_arrow, marks_apart, text_blocks, worker_object


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters whose lower case and composed form are plain: ASCII and Latin-1.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Entries of a table that holds the ids and pieces of its words written out (about 250 bytes each).
MAX_TOLD = 150_000


class Codec:
    """Encoder and decoder of one worker. `told`: also ids and pieces of each text, written out."""

    def __init__(self, path: str, told: bool = False) -> None:
        tok = load_tokenizer(path)
        model, table, plain = tok.model, str.maketrans({chr(b): c for b, c in byte_characters().items()}), re.compile(f"[{LETTERS}]+").fullmatch
        size = max(tok.get_vocab(with_added_tokens=True).values()) + 1
        self.pieces = [tok.id_to_token(i) or "" for i in range(size)]

        def encode(words: list[bytes]) -> list[list[int]]:
            """Words of letters alone are one pre-token, so the library's BPE model takes them as they are, in lower case; all others go
            through its whole pipeline."""
            texts = [w.decode() for w in words]
            out: list = [None] * len(texts)
            for i, x in enumerate(texts):
                if plain(x):
                    low = x.lower()
                    out[i] = [t.id for t in model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(table))]
            rest = [i for i, ids in enumerate(out) if ids is None]
            for i, e in zip(rest, tok.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
                out[i] = e.ids
            return out

        def notes(lists: list[list[int]]) -> list[tuple[str, str]]:
            """Ids and pieces of each word, written out."""
            get = self.pieces.__getitem__
            return [(" ".join(map(str, ids)), " ".join(map(get, ids))) for ids in lists]

        self.told = told
        self.table = TokenTable(encode, MAX_TOLD, notes) if told else TokenTable(encode)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list]:
        """(all ids, bounds of each text's ids, (ids, pieces) of each text if told)."""
        words = Block(texts)
        begin, end, at = marks_apart(words.raw, words.begin, words.end)
        ids, n, notes = self.table(words.raw, begin, end)
        first = at[words.first]
        out = []
        if self.told:
            for p, q in zip(first[:-1].tolist(), first[1:].tolist()):
                found = [x for x in notes[p:q] if x[0]]  # a word may have no ids: white space beyond ASCII
                out.append((" ".join([x[0] for x in found]), " ".join([x[1] for x in found])))
        return ids, bounds(n)[first], out

    def decode(self, ids: list[int]) -> str:
        """This vocabulary names no decoder, so pieces are joined by one space."""
        return " ".join(map(self.pieces.__getitem__, ids))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array of token ids for each text."""
    path, schema = path or default_path(), T.StructType([*[f for f in docs.schema if f.name != ids], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    keep = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_object(("bpe", path), lambda: Codec(path))
        for b in batches:
            for part, texts in text_blocks(b, text):
                flat, at, _ = codec.encode(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))], names=[*keep, ids])

    return map_arrow(docs, run, schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the decoded text of its ids (null: empty)."""
    path, keep = path or default_path(), [c for c in df.columns if c != out]
    schema = T.StructType([*[f for f in df.schema if f.name != out], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_object(("bpe", path), lambda: Codec(path))
        for b in batches:
            texts = [codec.decode(x or []) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, out])

    return map_arrow(df, run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; both directions in one pass over the texts."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_object(("bpe", path, True), lambda: Codec(path, told=True))
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            for part, texts in text_blocks(b):
                _, at, told = codec.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array([digest(x) for x, _ in told], pa.string()), pa.array([digest(x) for _, x in told], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
