"""Plain versions of the operators, for small corpora."""

from __future__ import annotations

import re

WHITE = re.compile(r"[\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return [w for w in WHITE.split(text or "") if w]


def shingles(text: str | None) -> frozenset:
    w = words((text or "").translate(AZ))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows: list[tuple]) -> list[tuple]:
    """(doc_id, number of shingles, component id, kept) by row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(sets[i]), (least.get(find(i)) if sets[i] else k), k == (least.get(find(i)) if sets[i] else k)) for i, (k, _) in enumerate(rows)]


def repeated(rows: list[tuple], window: int = 50) -> list[list[bool]]:
    """Words to remove, by row."""
    first: dict[tuple, int] = {}
    split = [words(t) for _, t in rows]
    for (k, _), w in zip(rows, split):
        if k is not None:
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                first[g] = min(k, first.get(g, k))
    out = []
    for (k, _), w in zip(rows, split):
        gone = [False] * len(w)
        if k is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < k:
                    gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def item_words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ)) if w]


def hits(rows: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """(doc_id, words, hit words, item ids) by row."""
    grams: dict[tuple, set] = {}
    for key, t in items:
        w = item_words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(key))
    sizes = {len(g) for g in grams}
    out = []
    for k, t in rows:
        w, hit, found = item_words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if keys := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= keys
        out.append((k, len(w), len(hit), sorted(found)))
    return out


def base_counts(text: str | None) -> tuple:
    t = text or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    at: dict[tuple, list[int]] = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(rep)
