"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback encodes the words of each text. Three measures say how well the text is made of
words the vocabulary has seen: characters per token, the share of byte-fallback tokens, and the entropy of the tokens.
Bands per script decide; the script of a text is counted over all its letters. Each distinct word is encoded once (see
common.TokenTable), so the pass is narrow and needs no shuffle.

Null texts have no words and fail the base rule, as empty ones do; repeated rows get equal verdicts; extra columns are
carried through, own columns of the measures' names give way in measures() and are kept by keep(); a very long text is
measured whole, looked up in parts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Block, TokenTable, bounds, documents, map_arrow, mix64, set_aside, text_blocks, worker_object

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Band:
    """Accepted ranges of a script's texts."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy_bits: float


#: Production bands. "latin_plain" and "latin_marked" are Latin text of few and of some accented letters: 99,105 documents of the
#: tables that pass the base rules have 1.65 to 2.56 characters a token, byte share 0 and 4.77 bits or more; paragraphs
#: of Polish, Czech, Finnish and Turkish have 1.64 to 2.10, random letters of their alphabets 1.24 to 1.56, base64 and
#: punctuation about 1.25. Vietnamese has 1.23 ("latin"), random letters of it 0.97. Cyrillic prose has 2.0 to 2.2, random
#: letters 1.1. In the other scripts the vocabulary tells prose and random letters apart by no measure (Greek 0.83 and
#: 0.81, Arabic 0.85 to 0.94 and 0.84, Chinese, Japanese and Korean 0.61 to 0.74 and 0.69 to 0.76), so their bands are wide.
BANDS: dict[str, Band] = {
    "latin_plain": Band(1.6, 6.0, 0.1, 4.5),
    "latin_marked": Band(1.5, 6.0, 0.1, 4.5),
    "latin": Band(1.1, 9.0, 0.25, 4.0),
    "cyrillic": Band(1.5, 8.0, 0.25, 4.0),
    "greek": Band(0.7, 6.0, 0.35, 3.5),
    "arabic": Band(0.7, 6.0, 0.35, 3.5),
    "cjk": Band(0.3, 4.0, 0.8, 3.5),
    "other": Band(0.2, 9.0, 0.95, 3.0),
    "none": Band(1.6, 6.0, 0.1, 4.5),
}
#: Scripts by code point ranges; letters of none of them are of script "other", texts without letters of script "none".
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)],
    "cyrillic": [(0x400, 0x52F)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "cjk": [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0x20000, 0x3FFFF)],
}
_NAMES = [*SCRIPTS, "other"]
#: Accented Latin letters and combining marks; a text has few, or some, if they are at most so many percent of its characters.
ACCENTED = [(0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF), (0x300, 0x36F)]
PLAIN_PERCENT, MARKED_PERCENT = 10, 25


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Number of the script (from 1; 0: no letter), and whether accented, of every code point."""
    script, accented = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            script[c] = len(_NAMES)
    for k, name in enumerate(SCRIPTS, 1):
        for p, q in SCRIPTS[name]:
            script[p : q + 1][script[p : q + 1] > 0] = k
    for p, q in ACCENTED:
        accented[p : q + 1] = True
    return script, accented


def letters(text: str) -> tuple[str, int]:
    """(the script with the most letters, the first of SCRIPTS on a tie; number of accented letters)."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    script, accented = _classes()
    n = np.bincount(script[points], minlength=len(_NAMES) + 1)[1:]
    return (_NAMES[int(n.argmax())] if n.any() else "none"), int(accented[points].sum())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Meter:
    """Measures of one worker."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = TokenTable(lambda words: sp.encode([w.decode() for w in words], num_threads=1))
        self.is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])

    def measure(self, texts: list[bytes]) -> list[tuple]:
        words = Block(texts)
        hashes = words.hashes
        ids, n, _ = self.table(words.raw, words.begin, words.end)
        token_at = bounds(n)[words.first]
        n_bytes = bounds(self.is_byte[ids])
        out = []
        for k, raw in enumerate(texts):
            text = raw.decode()
            (p, q), (a, b) = words.first[k : k + 2].tolist(), token_at[k : k + 2].tolist()
            chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
            symbols = len(raw) - len(raw.translate(None, SYMBOLS))
            tokens = b - a
            entropy = 0.0
            if tokens:
                c = np.bincount(ids[a:b]) if tokens > 5000 else np.unique(ids[a:b], return_counts=True)[1]
                c = c[c > 0]
                entropy = math.log2(tokens) - float((c * np.log2(c)).sum()) / tokens
            share = int(n_bytes[b] - n_bytes[a]) / tokens if tokens else 0.0
            script, accented = letters(text)
            out.append((q - p, chars, symbols, duplicate_lines(raw), repeated_words(hashes[p:q]), tokens, chars / tokens if tokens else 0.0, share, entropy, script, accented))
        return out


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def repeated_words(words: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more, of a text's word hashes."""
    if len(words) < 4:
        return 0
    key = mix64(mix64(words[:-2] * U64(3) + words[1:-1]) + words[2:])
    order = np.argsort(key, kind="stable")
    run = key[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key) + 2, bool)
    again = np.zeros(len(key), bool)
    again[1:] |= same
    again[:-1] |= same
    twice[order[again]] = True
    hit = twice.copy()
    hit[1:] |= twice[:-1]
    hit[2:] |= twice[:-2]
    return int(hit.sum())


MEASURES = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("n_tokens", "long"), ("chars_per_token", "double"), ("byte_share", "double"), ("token_entropy", "double"), ("script", "string"), ("n_accented", "long")]
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
_SPARK = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}


def measures(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with the columns of MEASURES; own columns of these names give way."""
    path = path or default_path()
    mine = [k for k, _ in MEASURES]
    keep = [f for f in docs.schema if f.name not in mine]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = worker_object(("meter", path), lambda: Meter(path))
        for b in batches:
            for part, texts in text_blocks(b):
                found = list(zip(*meter.measure(texts)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(x, _ARROW[t]) for x, (_, t) in zip(found, MEASURES))], names=[*names, *mine])

    return map_arrow(docs, run, T.StructType([*keep, *[T.StructField(k, _SPARK[t]) for k, t in MEASURES]]))


def judged(measured: DataFrame, bands: dict[str, Band] = BANDS) -> DataFrame:
    """With base_failed and kept."""
    low = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    inside = F.lit(False)
    name = F.col("script")
    for band, most in (("latin_marked", MARKED_PERCENT), ("latin_plain", PLAIN_PERCENT)):
        if band in bands:
            name = F.when((F.col("script") == "latin") & (100 * F.col("n_accented") <= most * F.col("word_chars")), band).otherwise(name)
    for script, band in bands.items():
        inside = inside | ((name == script) & F.col("chars_per_token").between(band.min_chars_per_token, band.max_chars_per_token) & (F.col("byte_share") <= band.max_byte_share) & (F.col("token_entropy") >= band.min_entropy_bits))
    return measured.withColumn("base_failed", low).withColumn("kept", ~F.col("base_failed") & inside)


def keep(docs: DataFrame, bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows of docs that pass, with their own columns."""
    docs, named_back = set_aside(docs, [*[k for k, _ in MEASURES], "base_failed", "kept"])
    return named_back(judged(measures(docs), bands).filter("kept").select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(measures(documents(spark, sf_dir).select("doc_id", "text")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "script")


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns alone, which SQL can tell."""
    return query(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
m AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g),
n AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM m WHERE c > 1) GROUP BY r),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (r) LEFT JOIN n USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
"""
