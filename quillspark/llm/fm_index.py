"""FM-index over word sequences: suffix array by prefix doubling, BWT in a wavelet matrix of packed bits, and matching
statistics of streamed sequences by backward search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

U64 = np.uint64
#: Windows of a query that are streamed as one piece.
PIECE_WINDOWS = 100
#: Value of a window that no indexed sequence holds.
NOWHERE = np.iinfo(np.int64).max


class Bits:
    """Packed bits with rank in constant time."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        raw = np.zeros((n // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[: len(packed)] = packed
        self.words = raw.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        at = i >> 6
        low = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low).astype(np.int64)


class WaveletMatrix:
    """Wavelet tree in matrix form, one bit vector a level."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        now = symbols.astype(np.int64)
        for b in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (now >> b) & 1 == 1
            self.levels.append((b, Bits(bit), int(len(now) - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])
        # where each symbol's run begins in the last order
        change = np.concatenate([[0], 1 + np.flatnonzero(now[1:] != now[:-1])]) if len(now) else np.zeros(0, np.int64)
        self.first = np.zeros(top + 2, np.int64)
        self.first[now[change]] = change

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Number of `symbol` before position i."""
        at = i.astype(np.int64)
        for b, bits, zeros in self.levels:
            rank = bits.rank(at)
            at = np.where((symbol >> b) & 1 == 1, zeros + rank, at - rank)
        return at - self.first[symbol]


class FMIndex:
    """Index of sequences of 64-bit words with a value each; `window` is the length from which matches are reported."""

    def __init__(self, sequences: list[np.ndarray], values: np.ndarray, window: int) -> None:
        self.window = window
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.alphabet, ids = np.unique(np.concatenate(sequences), return_inverse=True)
        # each sequence is followed by separator 0
        ends = np.cumsum(sizes + 1) - 1
        self.n = n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = ids + 1
        sa, self.lcp = self._suffixes(text, window)
        self.top = len(self.alphabet)
        self.wavelet = WaveletMatrix(text[sa - 1], self.top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))]).astype(np.int64)
        # intervals of rows that share `window` words with the least value in each, and of rows that share one word less
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        opens = self.lcp < window
        self.opens, self.least = Bits(opens), np.minimum.reduceat(values[owner[sa]], np.flatnonzero(opens))
        wider = self.lcp < window - 1
        self.wider, self.wider_at = Bits(wider), np.append(np.flatnonzero(wider), n)
        # what each row shares with the one before, none at the ends, and the nearest rows on either side that share less
        self.depth = np.append(self.lcp, 0).astype(np.int64)
        self.depth[0] = 0
        self.left, self.right = np.zeros(n + 1, np.int64), np.full(n + 1, n)
        for d in np.unique(self.depth)[1:].tolist():
            own, less = np.flatnonzero(self.depth == d), self.depth < d
            near = np.flatnonzero(less)
            k = np.searchsorted(near, own)
            self.left[own], self.right[own] = near[k - 1], near[np.minimum(k, len(near) - 1)]

    @staticmethod
    def _suffixes(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffix array, length of the common prefix of each suffix with the one before, up to window). The text's end sorts first."""
        n = len(text)
        rank, size, kept = np.unique(text, return_inverse=True)[1].astype(np.int64), 1, []
        while True:
            if size <= window:
                kept.append((size, rank.astype(np.int32)))
            if int(rank.max()) == n - 1 and size >= window:
                break
            shifted = np.zeros(n, np.int64)
            if size < n:
                shifted[: n - size] = rank[size:] + 1
            key = (rank + 1) * (n + 1) + shifted
            order = np.argsort(key)
            k = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))
            size *= 2
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        lcp = np.zeros(n, np.int64)
        for size, r in reversed(kept):  # lengths in binary
            r = np.append(r, np.int32(-1))
            x, y = np.minimum(sa[1:] + lcp[1:], n), np.minimum(sa[:-1] + lcp[1:], n)
            lcp[1:] += np.where((r[x] == r[y]) & (x < n), size, 0)
        return sa, np.minimum(lcp, window).astype(np.uint8 if window < 256 else np.int32)

    # ----------------------------------------------------------------------- search
    def _ids(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, -1)

    def backward(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches extended to the left by `symbol` (empty for symbols that aren't there)."""
        known = symbol > 0
        s = np.where(known, symbol, 0)
        both = self.wavelet.rank(np.concatenate([s, s]), np.concatenate([lo, hi]))
        a, b = self.before[s] + both[: len(s)], self.before[s] + both[len(s) :]
        return np.where(known, a, 0), np.where(known, b, 0)

    def _parents(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lo, hi, length) of the intervals of the longest shorter matches that hold more rows: up to the nearest row on either side that
        shares less than the nearer of the two neighbours does."""
        at = np.where(self.depth[lo] >= self.depth[hi], lo, hi)
        return self.left[at], self.right[at], self.depth[at]

    def _extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest matches, `window` words at most, that begin one word further left. A match that the word doesn't extend
        gives up words at its right end, as few as it can."""
        full = np.flatnonzero(size >= self.window)
        if len(full):
            k = self.wider.rank(lo[full] + 1) - 1
            lo[full], hi[full], size[full] = self.wider_at[k], self.wider_at[k + 1], self.window - 1
        a, b = self.backward(symbol, lo, hi)
        bad = np.flatnonzero(a >= b)
        while len(bad):
            none = size[bad] == 0
            some = bad[~none]
            a[bad[none]], b[bad[none]], size[bad[none]] = 0, self.n, -1  # the word isn't there
            if not len(some):
                break
            lo[some], hi[some], size[some] = self._parents(lo[some], hi[some])
            a[some], b[some] = self.backward(symbol[some], lo[some], hi[some])
            bad = some[a[some] >= b[some]]
        return a, b, size + 1

    def _stream(self, queries: list[np.ndarray], told: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> list[int]:
        """Stream all queries side by side from their ends; told(places in the queries laid end to end, row, match length). Returns
        where each query begins."""
        sizes = np.array([len(q) for q in queries], np.int64)
        base = np.cumsum(sizes) - sizes
        ids = self._ids(np.concatenate(queries)) if len(queries) else np.zeros(0, np.int64)
        order = np.argsort(-sizes, kind="stable")
        long_first, begin = sizes[order], base[order]
        lo, hi, size = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64), np.zeros(len(order), np.int64)
        for t in range(1, int(sizes.max(initial=0)) + 1):
            m = int(np.searchsorted(-long_first, -t, side="right"))
            at = begin[:m] + long_first[:m] - t
            lo, hi, size = self._extend(ids[at], lo[:m], hi[:m], size[:m])
            told(at, lo, size)
        return base.tolist()

    def match_lengths(self, queries: list[np.ndarray]) -> list[np.ndarray]:
        """Matching statistics: for each place of each query the length of the longest match that begins there, `window` at most."""
        out = np.zeros(sum(map(len, queries)), np.int64)

        def told(at: np.ndarray, row: np.ndarray, size: np.ndarray) -> None:
            out[at] = size

        return [out[b : b + len(q)] for b, q in zip(self._stream(queries, told), queries)]

    def least_values(self, queries: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each query the least value among the indexed sequences that hold it; NOWHERE if none does. Long queries are
        streamed in pieces that share what a window needs, so that all end at about the same time."""
        cuts = [range(0, max(1, len(q) - self.window + 1), PIECE_WINDOWS) for q in queries]
        found = self._least([q[k : k + PIECE_WINDOWS + self.window - 1] for q, c in zip(queries, cuts) for k in c])
        at = np.cumsum([0, *map(len, cuts)]).tolist()
        return [np.concatenate(found[i:j]) if j - i > 1 else found[i] for i, j in zip(at[:-1], at[1:])]

    def _least(self, queries: list[np.ndarray]) -> list[np.ndarray]:
        out = np.full(sum(map(len, queries)), NOWHERE, np.int64)

        def told(at: np.ndarray, row: np.ndarray, size: np.ndarray) -> None:
            whole = size >= self.window
            out[at[whole]] = self.least[self.opens.rank(row[whole] + 1) - 1]

        return [out[b : b + max(0, len(q) - self.window + 1)] for b, q in zip(self._stream(queries, told), queries)]
