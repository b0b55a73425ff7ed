"""Balanced label propagation: put documents into equal shards and keep linked documents together. Native DataFrame code only.

Links join documents with equal keys (here: equal texts). All members of a group stand for each other, so the graph is held
as cells, (group, slice of doc_id hashes, size), and never as pairs: a group of a third of all rows is thousands of cells, not
one row and not a square, and as many more as the input has rows, so that a cell stays far smaller than a lane's room. Labels start from a hash; each round sums the cells of a group by shard, which is what a cell
sees of its neighbours, and a group's cells move to the shard that holds most of it among those with room, until no cell
moves any more or a round brings no more pairs together (pairs in one shard grow each round, so rounds end). The room of a shard, its quota less what it holds when the round begins, is dealt to LANES lanes by hash, so
that the running sums which decide who still fits are over one lane each, and no shard passes its quota by moves. After
the last round rows are counted out exactly: shards over their quota hand on their last rows, unlinked rows first, and
shards under it take them, so counts differ by one at most (law "rows").

Ranks within a shard come from counts by (shard, lane) and a window over one lane; lanes grow with the input.

A null text is a text of its own kind with size 1, as is an empty one; repeated rows (equal doc_id and text) are separate
rows with slots of their own; null doc_ids are dealt like others; an empty table gives an empty result; a very long text
is read for its digest alone. Only doc_id and text are read, so extra columns don't matter.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop_tables, release, write_table

SHARDS = 16
#: Slices of a group: so many at least, and so many more that a cell of a group of all rows has CELL_ROWS.
SLICES, CELL_ROWS = 4096, 2_500
ROWS_PER_LANE = 20_000


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, group (digest of the text), and a hash that spreads rows."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2("text", 256), F.lit("null")).alias("group"),
        F.xxhash64("doc_id").alias("spread"),
    )


def _slot_of(cells: DataFrame, lanes: int) -> DataFrame:
    return cells.withColumn("lane", F.pmod(F.xxhash64("group", "slice"), F.lit(lanes)))


def slices_of(total: int) -> int:
    return max(SLICES, -(-total // CELL_ROWS))


def propagate(cells: DataFrame, shards: int, total: int, rounds: int | None = None) -> DataFrame:
    """cells(group, slice, n) with their shard once nothing moves or no more pairs come together, or after the given rounds; no shard
    passes its quota by moves."""
    spark = cells.sparkSession
    quota = total // shards
    lanes = max(1, total // (ROWS_PER_LANE * shards))
    names = ["group", "slice", "n", "lane", "shard"]
    state = write_table(spark, _slot_of(cells, lanes).withColumn("shard", F.pmod(F.xxhash64(F.lit(17), "group", "slice"), F.lit(shards)).cast("int")).select(*names), "labels")
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    together = lambda df: df.groupBy("group", "shard").agg(F.sum("n").cast("double").alias("w")).agg(F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0))).first()[0]
    score = together(state)
    for r in count() if rounds is None else range(rounds):
        held = state.groupBy("shard").agg(F.sum("n").alias("held"))
        room = F.broadcast(every.join(held, "shard", "left").select("shard", (F.lit(quota) - F.coalesce("held", F.lit(0))).alias("free")))  # one row a shard
        # what each group holds in each shard, at most `shards` rows a group, as a cell sees its neighbours: ties by a hash that turns
        # from round to round, so that a group whose first choice is full finds another
        pull = F.struct(F.col("w"), F.xxhash64(F.lit(r), "group", "shard").alias("tie"), F.col("shard"))
        seen = state.groupBy("group", "shard").agg(F.sum("n").alias("w")).join(room, "shard").withColumn("pull", pull)
        best = seen.groupBy("group").agg(F.max(F.when(F.col("free") > 0, F.col("pull"))).alias("b"), F.count(F.lit(1)).alias("parts")).filter("parts > 1 and b is not null").select("group", F.col("b.shard").alias("to"), F.col("b.w").alias("pull"))
        # cells of smaller shares follow the larger one; the join's right side has one row a group
        asked = state.join(best, "group").filter(F.col("to") != F.col("shard")).join(seen.select("group", "shard", "w"), ["group", "shard"]).filter(F.col("pull") >= F.col("w"))
        # movers of a lane fill the lane's share of the target's room, large groups first
        turn = Window.partitionBy("to", "lane").orderBy(F.desc("pull"), "group", "slice").rowsBetween(Window.unboundedPreceding, 0)
        share = room.select(F.col("shard").alias("to"), (F.col("free") / lanes).alias("share"))
        moves = asked.withColumn("upto", F.sum("n").over(turn)).join(share, "to").filter("upto <= share").select("group", "slice", "to")
        moves = write_table(spark, moves, "moves")
        if moves.isEmpty():
            drop_tables(spark, moves)
            break
        new = write_table(spark, state.join(moves, ["group", "slice"], "left").withColumn("shard", F.coalesce("to", "shard")).select(*names), "labels")
        now = together(new)
        if now <= score:
            drop_tables(spark, new, moves)
            break
        drop_tables(spark, state, moves)
        state, score = new, now
    return state


def cut_edges(placed: DataFrame, group: str, shard: str = "shard", n: str | None = None) -> DataFrame:
    """One row (links, cut): pairs of equal `group`, and those of them in different shards. n: rows that a row stands for."""
    w = placed.groupBy(group, shard).agg(F.sum(F.col(n) if n else F.lit(1)).cast("double").alias("w"))
    by = w.groupBy(group).agg(F.sum("w").alias("m"), F.sum(F.col("w") * F.col("w")).alias("q"), F.sum("w").alias("s"))
    return by.agg(F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("s")) / 2), F.lit(0.0)).alias("links"), F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2), F.lit(0.0)).alias("cut"))


def _numbered(rows: DataFrame, lanes: int, order: list, by: str = "shard") -> DataFrame:
    """rows with `rank`, gapless from 0 within `by`, in the order of (band, lane, order)."""
    spread = rows.withColumn("lane", F.pmod("spread", F.lit(lanes)))
    counts = spread.groupBy(by, "band", "lane").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy(by).orderBy("band", "lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    inside = spread.withColumn("r", F.row_number().over(Window.partitionBy(by, "band", "lane").orderBy(*order)))
    return inside.join(before, [by, "band", "lane"]).withColumn("rank", F.col("before") + F.col("r") - 1).drop("before", "r", "lane")


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: law "rows")."""
    spark = docs.sparkSession
    rows = write_table(spark, measured(docs), "rows")
    total = rows.count()
    rows = rows.withColumn("slice", F.pmod("spread", F.lit(slices_of(total))))
    cells = rows.groupBy("group", "slice").agg(F.count(F.lit(1)).alias("n"))
    if total == 0:
        return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    # unlinked rows have no neighbours to move to and give way at the end, so only linked ones count against the quotas
    linked = cells.join(cells.groupBy("group").agg(F.sum("n").alias("members")).filter("members > 1").select("group"), "group")
    state = propagate(linked, shards, total, rounds)
    labelled = rows.join(state.select("group", "slice", F.col("shard").alias("label")), ["group", "slice"], "left")
    # band: rows of groups first, so that the rows a full shard hands on are unlinked ones
    labelled = labelled.withColumn("band", F.when(F.col("label").isNotNull(), 0).otherwise(1)).withColumn("shard", F.coalesce("label", F.pmod("spread", F.lit(shards)).cast("int"))).drop("label", "slice")
    lanes = max(1, total // (ROWS_PER_LANE * shards)) * 4
    # a large group's rows go to many lanes
    order = ["group", "doc_id", "size"]
    spread_out = labelled.withColumn("spread", F.when(F.col("band") == 0, F.xxhash64("group", F.pmod(F.xxhash64("doc_id"), F.lit(lanes)))).otherwise(F.col("spread")))
    first = write_table(spark, _numbered(spread_out, lanes, order), "ranked")
    drop_tables(spark, state)
    # exact quotas: shard s keeps its first `quota` rows; the others fill the gaps in order
    held = first.groupBy("shard").agg(F.count(F.lit(1)).alias("held"))
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    quota = F.lit(total // shards) + (F.col("shard") < total % shards).cast("long")
    plan = every.join(held, "shard", "left").select("shard", F.coalesce("held", F.lit(0)).alias("held"), quota.alias("quota"))
    running = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("over", F.greatest(F.col("held") - F.col("quota"), F.lit(0))).withColumn("gap", F.greatest(F.col("quota") - F.col("held"), F.lit(0)))
    plan = plan.withColumn("over_before", F.coalesce(F.sum("over").over(running), F.lit(0))).withColumn("gap_before", F.coalesce(F.sum("gap").over(running), F.lit(0)))
    plan = write_table(spark, plan.coalesce(1), "quotas")  # one row a shard
    gaps = F.broadcast(plan.filter("gap > 0").select(F.col("shard").alias("to"), F.col("held").alias("to_held"), "gap", "gap_before"))
    placed = first.join(F.broadcast(plan.select("shard", "quota", "over_before")), "shard")
    stay = placed.filter("rank < quota").select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))
    go = placed.filter("rank >= quota").withColumn("place", F.col("over_before") + F.col("rank") - F.col("quota"))
    filled = go.join(gaps, (F.col("place") >= F.col("gap_before")) & (F.col("place") < F.col("gap_before") + F.col("gap"))).select("doc_id", "size", "text_crc32", F.col("to").alias("shard"), (F.col("to_held") + F.col("place") - F.col("gap_before")).alias("slot"))
    out = stay.unionByName(filled)
    release(spark)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir))
