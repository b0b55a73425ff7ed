"""MinHash near-duplicates with an LSH forest.

Every text gets its set of distinct word shingles, 128 minimum hashes, and the number of its set; texts of equal sets are one
class from then on. The forest is ORDERS sorted orders of the classes: order t sorts by the signature rotated by 4*t values.
Neighbours in an order are candidates, and so are all members of a region, a range of rows with a common prefix. The depth
of a region adapts to how crowded its part of the order is: SPARSE_DEPTH values where that gives few members, DEPTH where it
gives a bearable number, more where it doesn't. A pair of similarity 0.75 shares DEPTH values in at least one of 32 orders
but for 5 in a million.

Links come from the forest in two steps, both exact on full shingle sets. First each class meets the neighbour with which
its common prefixes over all orders are longest, which joins most copies. Then the members of a region that are not yet
in one component are brought together with their sets, once for equal regions, and compared by a product of their
shingle incidence; only the links that join components leave the task. So a group of m near copies costs m rows an
order, not m * m pairs.

Pairs with a common prefix of DEPTH values that a deeper region, a cut by count or a border of range partitions parts are
settled exactly: such a prefix of few classes is one region more; the classes of the others that still are of several
components meet through their rarest shingles, without a limit on how many they are (see settled).

Empty and null texts have empty sets and are linked with nothing; texts of fewer words than a shingle are one shingle;
equal texts and repeated rows are one class; equal doc_ids of different texts are separate members; rows with a null doc_id
take part, but never name a component that has another member. Extra columns aren't read. A very long text is one set; a
region of a few such sets is cut by its number of shingles. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Block, bounds, documents, drop_tables, fanout, join_hot, map_arrow, mix64, release, text_blocks, text_key, write_table
from .components import components

SHINGLE = 5
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 75
HASHES, DEPTH = 128, 4
ORDERS = HASHES // DEPTH
#: Depth of regions of SPARSE_MEMBERS at most, and the greatest depth.
SPARSE_DEPTH, SPARSE_MEMBERS, MOST_DEPTH = 3, 64, 7
#: Members and shingles of a region at most; larger ones are cut at greater depth.
REGION_MEMBERS, REGION_SHINGLES = 4096, 1 << 21
#: Sets that a shingle may head to bring them together one by one.
HOT_OWNERS = 512
#: Rows of one run of equal keys that a task holds before it cuts them into regions.
RUN_ROWS = 1 << 16
#: Classes of a component from which on they are dealt to several tasks, and the share of all classes that says the same.
HOT_CLASSES, HOT_SHARE = 2_000, 5_000
#: Ids that may be broadcast, 16 bytes each; beyond that a shuffled join is used.
BROADCAST_ROWS = 250_000

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_POS = _rng.integers(1, 2**64, SHINGLE, dtype=U64) | U64(1)


# --------------------------------------------------------------------------- sets
def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = Block(texts, lower=True)
    flat, n = words.hashes, len(words.begin)
    rolled = np.zeros(n, U64)
    if n >= SHINGLE:
        rolled[: n - SHINGLE + 1] = sum(flat[k : n - SHINGLE + 1 + k] * _POS[k] for k in range(SHINGLE))
    rolled = mix64(rolled)
    out = []
    for at, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        size = end - at
        if size >= SHINGLE:
            out.append(np.unique(rolled[at : end - SHINGLE + 1]))
        elif size:
            short = np.append(flat[at:end] * _POS[:size], np.array([size], U64) * _POS[:1]).sum(dtype=U64)
            out.append(mix64(np.array([short], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_number(s: np.ndarray) -> int | None:
    """64-bit number of a set, as a signed long; None for the empty set."""
    if not len(s):
        return None
    total = mix64(s + U64(0x51ED270B7A14C0DF)).sum(dtype=U64) + U64(len(s))
    return int(mix64(np.array([total], U64)).view(np.int64)[0])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, HASHES) minimum hashes; rows of empty sets are of no use."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = (np.concatenate([sets[i] for i in full]) >> U64(32)).astype(np.uint32)
        starts = bounds(sizes[full])[:-1]
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(flat * _MUL[k] + _ADD[k], starts)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, n_shingles, nid (number of the set, null if empty), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_blocks(b):
                sets = shingle_sets(texts)
                sig = signatures(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([text_key(t) for t in texts], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_number(s) for s in sets], pa.int64()), pa.array([r.tobytes() if len(s) else None for r, s in zip(sig, sets)], pa.binary())], names=["doc_id", "tkey", "n_shingles", "nid", "sig"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, tkey long, n_shingles long, nid long, sig binary")


def sets_of(docs: DataFrame) -> DataFrame:
    """nid and shingle set of docs, one row a document with a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in text_blocks(b):
                sets = [s for s in shingle_sets(texts) if len(s)]
                at = pa.array(bounds([len(s) for s in sets]), pa.int32())
                flat = np.concatenate(sets) if sets else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays([pa.array([set_number(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat.view(np.int64), pa.int64()))], names=["nid", "shingles"])

    return map_arrow(docs.select("text"), run, "nid long, shingles array<long>")


# --------------------------------------------------------------------------- forest
def orders(classes: DataFrame) -> DataFrame:
    """A row for each class and order: the first SPARSE_DEPTH values as `key`, the next four as two sort columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(n, HASHES).astype(U64)
            nid, size = b.column("nid").to_numpy(), b.column("n_shingles").to_numpy()
            for t in range(ORDERS):
                v = np.roll(sig, -DEPTH * t, axis=1)[:, :MOST_DEPTH]
                pair = lambda k: (v[:, k] << U64(32)) | v[:, k + 1]  # noqa: E731,B023
                key = mix64(pair(0) * U64(0x9E3779B97F4A7C15) + mix64(v[:, 2] + U64(t << 32)))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == U64 else x, pa.int64()) for x in (key, pair(3), pair(5), nid, size)], names=["key", "s1", "s2", "nid", "n_shingles"])

    return map_arrow(classes.select("nid", "n_shingles", "sig"), run, "key long, s1 long, s2 long, nid long, n_shingles long")


def prefix_lengths(key: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the row before it: 0, or SPARSE_DEPTH to MOST_DEPTH."""
    high = lambda s: s.view(U64) >> U64(32)
    out, same = np.zeros(len(key), np.int64), np.ones(len(key), bool)
    same[:1] = False
    for depth, v in enumerate((key, high(s1), s1, high(s2), s2), SPARSE_DEPTH):
        same[1:] &= v[1:] == v[:-1]
        out[same] = depth
    return out


def cut_regions(prefix: np.ndarray, size: np.ndarray, sparse: int = SPARSE_MEMBERS, members: int = REGION_MEMBERS, shingles: int = REGION_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """(whether each row begins a region, whether its prefix of DEPTH values is in several regions) for sorted rows. Groups of
    equal prefixes that are too large are parted at the next value, and by count where prefixes end."""
    n = len(prefix)
    begins, parted = np.zeros(n, bool), np.zeros(n, bool)
    left = np.arange(n)  # rows whose region isn't settled; whole groups, in order
    for depth in range(SPARSE_DEPTH, MOST_DEPTH + 1):
        opens = (prefix[left] < depth) | np.append(True, np.diff(left) > 1)[: len(left)]
        begins[left[opens]] = True
        group = np.cumsum(opens) - 1
        count = np.bincount(group)
        total = np.bincount(group, size[left])
        fits = (count <= (sparse if depth < DEPTH else members)) & ((total <= shingles) | (count <= 2))
        left = left[~fits[group]] if len(left) else left
        if depth >= DEPTH:
            parted[left] = True
        if not len(left):
            return begins, parted
    starts = np.flatnonzero(begins[left])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(left)]):
        rows = left[a:b]
        total, at = bounds(size[rows]), 0
        while True:
            at = max(at + 2, min(at + members, int(np.searchsorted(total, total[at] + shingles, side="right")) - 1))
            if at >= len(rows):
                break
            begins[rows[at]] = True
    return begins, parted


def regions(sorted_rows: DataFrame) -> DataFrame:
    """region, nid, prev (the neighbour before it), shared (values of their common prefix), run, n_shingles: the members of all regions of
    two or more, and all whose prefix of DEPTH values may be in several regions: it was parted, or is the first or last
    here. Those have that prefix as `run`."""
    limits = SPARSE_MEMBERS, REGION_MEMBERS, REGION_SHINGLES  # workers take them from the driver
    run_rows = RUN_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), 0
        rest: list[np.ndarray] | None = None
        first = True  # the next prefix may have begun in another partition or before the last cut

        def close(cols: list[np.ndarray], last: bool) -> pa.RecordBatch:
            """Rows of whole keys, but for the first and, if it is the `last` of a task or cut, the last."""
            nonlocal names, first
            key, s1, s2, nid, size = cols
            prefix = prefix_lengths(key, s1, s2)
            begins, parted = cut_regions(prefix, size, *limits)
            deep = np.flatnonzero(prefix < DEPTH)  # where prefixes of DEPTH values begin
            if first:
                parted[: deep[1] if len(deep) > 1 else None] = True
            if last:
                parted[deep[-1] :] = True
            first = last
            region = np.cumsum(begins) - 1
            wanted = (np.bincount(region)[region] > 1) | parted
            has = np.flatnonzero((prefix >= DEPTH) | ~begins)
            prev, known = np.zeros(len(nid), np.int64), np.zeros(len(nid), bool)
            prev[has], known[has] = nid[has - 1], True
            run = mix64(key.view(U64) + mix64(s1.view(U64) >> U64(32))).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array((part << 40) + names + region), pa.array(nid), pa.array(prev, mask=~known), pa.array(prefix), pa.array(run, mask=~parted), pa.array(size)], names=["region", "nid", "prev", "shared", "run", "n_shingles"])
            names += int(region[-1]) + 1
            return out.filter(pa.array(wanted))

        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("key", "s1", "s2", "nid", "n_shingles")]
            if not len(cols[0]):
                continue
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            key = cols[0]
            end = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if end:
                yield close([c[:end] for c in cols], False)
            rest = [c[end:] for c in cols]
            if len(rest[0]) > run_rows:
                yield close(rest, True)
                rest = None
        if rest is not None:
            yield close(rest, True)

    return map_arrow(sorted_rows, run, "region long, nid long, prev long, shared long, run long, n_shingles long")


# --------------------------------------------------------------------------- links
def linked(inter: F.Column, a: F.Column, b: F.Column) -> F.Column:
    return 100 * inter >= PERCENT * (a + b - inter)


def links_in(nid: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the components of a region's members, compared exactly."""
    n = len(nid)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    value, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # a shingle of one member adds to no intersection
    number = np.cumsum(count > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    inter = np.zeros((n, n))
    wide = int((count > 1).sum())
    step = max(256, (8 << 20) // max(n, 1))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for c in range(0, wide, step):
        i, j = np.searchsorted(column, [c, c + step])
        m = np.zeros((n, min(step, wide - c)), np.float32)
        m[owner[i:j], column[i:j] - c] = 1
        inter += m @ m.T
    root = {int(c): int(c) for c in comp}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for at in range(0, n, 256):
        both = inter[at : at + 256].astype(np.int64)
        good = np.triu(100 * both >= PERCENT * (size[at : at + 256, None] + size - both), at + 1) & (comp[at : at + 256, None] != comp)
        for i, j in zip(*(x.tolist() for x in np.nonzero(good))):
            a, b = find(int(comp[at + i])), find(int(comp[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(comp[at + i]), int(comp[j])))
    return out


def region_links(members: DataFrame) -> DataFrame:
    """members(region, nid, comp, shingles), sorted by region in each partition -> (a, b): components to join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            nid, comp, sets = zip(*held)
            return links_in(np.array(nid), np.array(comp), list(sets))

        for b in batches:
            found = []
            lists = b.column("shingles")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k, (region, nid, comp) in enumerate(zip(*(b.column(c).to_pylist() for c in ("region", "nid", "comp")))):
                if region != now:
                    found += close()
                    now, held = region, []
                held.append((nid, comp, flat[at[k] : at[k + 1]].copy()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
        if found := close():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return map_arrow(members, run, "a long, b long")


def settled(parted: DataFrame, sets: DataFrame) -> DataFrame:
    """parted(nid, comp), sets(nid, shingles) -> (a, b): components to join, so that no pair of parted is left out.

    Shingles are put into one order: those of a single component first, then the rarer ones. Two linked sets have their first
    common shingle among the first (100 - PERCENT) / (100 + PERCENT) of the smaller set and (100 - PERCENT) / 100 of the
    larger one, with enough behind it in both; so what all members of a template share brings only those together whose
    own part is small enough. Pairs that meet are compared on full sets, by blocks of two buckets of members.
    """
    spark = sets.sparkSession
    own = write_table(spark, parted.join(sets, "nid"), "parted-sets")
    tokens = own.select("nid", "comp", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s"))
    often = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("s", "c")
    turn = Window.partitionBy("nid").orderBy("c", "s")
    ranked = tokens.join(often, "s", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("at", F.row_number().over(turn) - 1)
    heads = write_table(spark, ranked.filter((F.col("c") > 0) & (100 * F.col("at") <= (100 - PERCENT) * F.col("n"))).select("s", "nid", "comp", "n", "at"), "heads")
    n_own, n_shingles = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("shingles").cast("long")), F.lit(0))).first()
    buckets = max(1, -(-4 * n_own // REGION_MEMBERS), -(-4 * n_shingles // REGION_SHINGLES))

    def side(k: str) -> DataFrame:
        # a long set is a bucket of its own
        bucket = F.when(32 * F.col("n") > REGION_SHINGLES, F.xxhash64("nid")).otherwise(F.pmod(F.xxhash64("nid"), F.lit(buckets)))
        return heads.select("s", F.struct("n", "nid").alias(f"o{k}"), F.col("nid").alias(k), F.col("comp").alias(f"c{k}"), F.col("n").alias(f"n{k}"), (F.col("n") - F.col("at")).alias(f"left{k}"), bucket.alias(f"b{k}"))

    small = side("x").filter((100 + PERCENT) * (F.col("nx") - F.col("leftx")) <= (100 - PERCENT) * F.col("nx"))
    enough = (100 + PERCENT) * F.least("leftx", "lefty") >= PERCENT * (F.col("nx") + F.col("ny"))
    # a shingle that heads many sets brings together buckets of them rather than the sets one by one
    hot = heads.groupBy("s").agg(F.count(F.lit(1)).alias("owners")).filter(F.col("owners") > HOT_OWNERS).select("s")
    hot = write_table(spark, hot, "hot-heads")
    few = lambda df: df.join(hot, "s", "left_anti")
    met = few(small).join(few(side("y")), "s").filter((F.col("cx") != F.col("cy")) & (F.col("ox") < F.col("oy")) & (100 * F.col("nx") >= PERCENT * F.col("ny")) & enough)
    block = F.xxhash64(F.least("bx", "by"), F.greatest("bx", "by"))
    pairs = met.select(block.alias("region"), F.explode(F.array(F.col("x"), F.col("y"))).alias("nid"))
    many = lambda df: df.join(hot, "s", "left_semi")
    held = lambda k, df: many(df).groupBy("s", f"b{k}").agg(F.min(f"n{k}").alias(f"lo{k}"), F.max(f"n{k}").alias(f"hi{k}"), F.min(f"c{k}").alias(f"c0{k}"), F.max(f"c{k}").alias(f"c1{k}"))
    apart = (F.col("c0x") != F.col("c1x")) | (F.col("c0y") != F.col("c1y")) | (F.col("c0x") != F.col("c0y"))
    meet = held("x", small).join(held("y", side("y")), "s").filter(apart & (100 * F.col("hix") >= PERCENT * F.col("loy")) & (F.col("lox") <= F.col("hiy"))).select("s", "bx", "by")
    sides = [many(df).join(meet, ["s", f"b{k}"]).select(block.alias("region"), F.col(k).alias("nid")) for k, df in (("x", small), ("y", side("y")))]
    members = pairs.unionByName(sides[0]).unionByName(sides[1]).distinct().join(own, "nid").select("region", "nid", "comp", "shingles")
    out = write_table(spark, region_links(members.repartition(fanout(spark, own), "region").sortWithinPartitions("region")).distinct(), "joins")
    drop_tables(spark, own, heads, hot)
    release(spark)
    return out


def joined_up(first: DataFrame, second: DataFrame) -> DataFrame:
    """(node, root) of `first` after `second` has joined its roots, with those nodes that only `second` has."""
    up = second.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return first.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(second.join(first.select("node"), "node", "left_anti"))


def class_roots(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root) of the classes that are linked with another."""
    spark = docs.sparkSession
    # ties in another order for each key, so that cuts by count don't fall between the same classes every time
    order = ["key", "s1", "s2", F.xxhash64("key", "nid")]
    dealt = orders(classes).repartitionByRange(fanout(spark, classes), *order).sortWithinPartitions(*order)
    member = write_table(spark, regions(dealt), "regions")
    release(spark)
    # sets of the members alone
    wanted = member.select("nid").distinct().join(classes.select("nid", "doc_id"), "nid").select("doc_id").distinct()
    wanted = write_table(spark, wanted, "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    text = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, docs.doc_id.eqNullSafe(wanted.doc_id), "left_semi")
    sets = write_table(spark, sets_of(text).dropDuplicates(["nid"]), "sets")
    # each class and the neighbour with the longest common prefixes
    seen = member.filter("prev is not null").groupBy(F.col("nid").alias("x"), F.col("prev").alias("y")).agg(F.sum("shared").alias("c"))
    either = seen.unionByName(seen.select(F.col("y").alias("x"), F.col("x").alias("y"), "c"))
    best = either.groupBy("x").agg(F.max(F.struct("c", "y")).alias("m")).select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).filter("a <> b").distinct()
    pairs = best.join(sets.select(F.col("nid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("nid").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    first = components(pairs.filter(linked(both, F.size("sa"), F.size("sb"))).select("a", "b"))
    release(spark)
    # regions that still hold several components, once for equal members
    # prefixes in several regions that are small enough are regions of their own
    totals = member.filter("run is not null").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"), F.min("region").alias("r1"), F.max("region").alias("r2")).filter("r1 <> r2")
    fits = (F.col("n") <= REGION_MEMBERS) & (F.col("s") <= REGION_SHINGLES)
    totals = write_table(spark, totals.select("run", fits.alias("fits")), "parted-runs")
    again = member.filter("run is not null").join(totals.filter("fits").select("run"), "run").select(F.col("run").alias("region"), "nid")
    named = write_table(spark, member.select("region", "nid").unionByName(again).join(first.withColumnRenamed("node", "nid"), "nid", "left").select("region", "nid", F.coalesce("root", "nid").alias("comp")), "named")
    per = named.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("nid")).alias("h1"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "nid"), 16)).alias("h2"), F.count(F.lit(1)).alias("n"))
    open_regions = per.filter("lo <> hi").groupBy("h1", "h2", "n").agg(F.min("region").alias("region")).select("region")
    members = named.join(open_regions, "region").join(sets, "nid").select("region", "nid", "comp", "shingles")
    parts = fanout(spark, named)
    joins = write_table(spark, region_links(members.repartition(parts, "region").sortWithinPartitions("region")).distinct(), "joins")
    release(spark)
    second = components(joins)
    # classes of the first components, with those that only the second step joined
    out = write_table(spark, joined_up(first, second), "class-roots")
    # large prefixes of several regions that still hold several components
    runs = member.filter("run is not null").join(totals.filter("not fits").select("run"), "run").select("run", "region", "nid").join(out.withColumnRenamed("node", "nid"), "nid", "left").select("run", "region", "nid", F.coalesce("root", "nid").alias("comp"))
    split = runs.groupBy("run").agg(F.min("region").alias("r1"), F.max("region").alias("r2"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("r1 <> r2 and c1 <> c2").select("run")
    parted = write_table(spark, runs.join(split, "run", "left_semi").select("nid", "comp").distinct(), "parted")
    if not parted.isEmpty():
        across = settled(parted, sets)
        before, out = out, write_table(spark, joined_up(out, components(across)), "class-roots")
        drop_tables(spark, before, across)
    drop_tables(spark, member, wanted, sets, named, joins, parted, totals)
    release(spark)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, tkey (xxhash64 of the text, which tells rows of one doc_id apart)."""
    spark = docs.sparkSession
    every = write_table(spark, signed(docs), "signed")
    classes = write_table(spark, every.filter("nid is not null").groupBy("nid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    release(spark)
    roots = class_roots(docs, classes)
    named = classes.select("nid", "doc_id").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    named = write_table(spark, named, "named-classes")
    drop_tables(spark, classes)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # classes of large components are dealt to several tasks; at most HOT_SHARE components are
    per = max(HOT_CLASSES, named.count() // HOT_SHARE)
    hot = least.filter(F.col("n") > per).select("root", F.ceil(F.col("n") / per).cast("int").alias("parts"))
    of_class = join_hot(named, least.select("root", "component_id"), ["root"], hot, ["nid"]).select("nid", "component_id")
    out = every.select("doc_id", "tkey", "n_shingles", "nid").join(of_class, "nid", "left")
    component = F.when(F.col("nid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "tkey")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("tkey")


ORACLE_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.y FROM r JOIN e ON e.x = r.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(u) AS component_id FROM r GROUP BY v) c ON c.v = d.doc_id
"""
