"""A corpus of awkward rows: nulls, empty and very long texts, ties, repeated rows, copies, extra columns of clashing names."""

from __future__ import annotations

import random

import pytest

EXTRA = "nid long, spans string, tkey string, n_words string, items string, script string, kept string, score string, group string, size string, shard string, ids string, n_tokens string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
N_EXTRA = EXTRA.count(",") + 1


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = prose(160), prose(70)
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "  \t\n "), (4, "one two"), (5, "ONE  two"), (6, "word " * 3000), (7, prose(20000)), (8, "x" * 200_000)]
    for k in range(10, 30):
        rows.append((k, prose(rng.randint(40, 150))))
    for k in range(30, 60):  # near copies, some too far from one another but near the base
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((k, " ".join(w)))
    for k in range(60, 70):
        rows.append((k, f"{prose(30)}\n{passage}\n{prose(rng.randint(5, 40))}."))
    rows += [(70, base.upper()), (71, passage), (71, prose(55)), (12, rows[10][1]), (None, passage), (None, base), (-5, passage + " tail")]
    rows += [(200 + k, base) for k in range(12)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="session")
def docs(spark):
    full = [(k, t, "en", "s", len(t or ""), 1, *["x"] * (N_EXTRA - 1)) for k, t in ROWS]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


ITEMS = [(1, " ".join(ROWS[10][1].split()[5:30])), (2, "one TWO"), (3, None), (4, "!!"), (10, "one two"), (5, " ".join(ROWS[11][1].split()[:10]))]


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")
