"""Sharding by vector bin packing.

Documents with equal texts form a group.  Every group is placed in the shard where the dot product of its vector (bytes,
tokens, rows) with the residual capacity is highest, in two levels:

1. groups above 1/LARGE of a shard's fair share, of which there are at most 3 * shards * LARGE, are placed by the driver, largest
   first; one that exceeds a share is cut into as many pieces as it needs;
2. the other groups are dealt to cells by hash, about CELL groups to a cell.  A cell has its part of every shard's residual
   capacity, in proportion to what it holds, and places its groups, largest first, in a task of its own.

So the driver sees a bounded table, and cells grow in number, not in size, with the corpus.

Null texts count no bytes and are of the group of empty texts; null doc_ids, ties and repeated rows get slots like
any other row; an empty table gives an empty result.  More columns of docs, of any names, are not carried.  A very long
text is measured where it lies; only its size and hash go on.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

CELL, LARGE = 20_000, 64
#: How much bytes, tokens and rows count.
WEIGHTS = np.sqrt([4.0, 1.0, 1.0])


def place(vectors: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard for each row of vectors (bytes, tokens, rows), largest first, and the capacity (shard, dimension) that is left.

    The shard of the highest dot product of vector and residual capacity, both relative to the whole capacity, among those
    whose bytes still fit, or among all where they fit nowhere.
    """
    whole = np.maximum(capacity.clip(min=0).sum(axis=0), 1e-9) / len(capacity)
    left = capacity / whole * WEIGHTS
    v = vectors / whole * WEIGHTS
    out = np.zeros(len(v), np.int32)
    for i in np.argsort(-v.max(axis=1), kind="stable"):
        fit = left @ v[i]
        room = left[:, 0] >= v[i, 0]
        if room.any():
            fit = np.where(room, fit, -np.inf)
        out[i] = k = int(np.argmax(fit))
        left[k] -= v[i]
    return out, left / WEIGHTS * whole


def shard(docs: DataFrame, shards: int, overhead: int = 16, rows_per_window: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard and slot (gapless from 0 in each shard) of every row."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = checkpointed(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("group"),
        )
    )
    sums = lambda: (F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = [x or 0 for x in rows.agg(*sums()).first()]
    share = [max(1.0, x / shards) for x in total]
    of_share = F.greatest(*[F.col(c) / F.lit(s) for c, s in zip(("size", "tokens", "rows"), share)])
    groups = rows.groupBy("group").agg(*sums()).withColumn("part", of_share)
    pieces = F.when(F.col("part") > 1, F.ceil(F.col("part") * 1.25)).otherwise(1).cast("int")
    groups = checkpointed(groups.withColumn("pieces", F.when(F.col("part") > 1 / LARGE, pieces)))
    hot = F.broadcast(groups.where("pieces is not null").select("group", "pieces"))  # at most 3 * shards * LARGE
    marked = rows.join(hot, "group", "left").withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("pieces"))).otherwise(0).cast("int"))
    large = marked.where("pieces is not null").groupBy("group", "piece").agg(*sums()).orderBy("group", "piece").toArrow()
    vectors = lambda t: np.stack([t[c].to_numpy().astype(float) for c in ("size", "tokens", "rows")], axis=1)
    capacity = np.tile(np.array(total, float) / shards, (shards, 1))
    of_large, capacity = place(vectors(large), capacity)
    table = spark.createDataFrame(pa.table({"group": large["group"], "piece": large["piece"], "shard": pa.array(of_large, pa.int32())}), "group long, piece int, shard int")
    small = groups.where("pieces is null").select("group", "size", "tokens", "rows")
    number = small.count()
    cells = max(1, -(-number // CELL))
    still = np.maximum(capacity, 0)
    still = still / np.maximum(still.sum(axis=0), 1e-9)  # each shard's part of what the small groups hold

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by("group")
        v = vectors(t)
        return pa.table({"group": t["group"], "shard": pa.array(place(v, still * v.sum(axis=0))[0], pa.int32())})

    placed_small = small.withColumn("cell", F.pmod(F.xxhash64(F.lit(1), "group"), F.lit(cells)).cast("int")).groupBy("cell").applyInArrow(fill, "group long, shard int")
    columns = ["doc_id", "size", "text_crc32", "tokens", "shard"]
    first = marked.where("pieces is not null").join(F.broadcast(table), ["group", "piece"]).select(*columns)
    rest = marked.where("pieces is null").select("group", *columns[:-1]).join(placed_small, "group").select(*columns)  # of each group less than 1/LARGE of a shard
    windows = max(8, total[2] // (shards * rows_per_window))
    placed = checkpointed(first.unionByName(rest).withColumn("window", F.pmod(F.xxhash64(F.lit(2), "doc_id", "text_crc32"), F.lit(windows)).cast("int")))
    return with_slots(placed).select(*columns, "slot")


def with_slots(placed: DataFrame) -> DataFrame:
    """slot: numbers each shard's rows from 0, by window and doc_id.  No task holds a whole shard: windows are numbered apart and offset by what stands before."""
    counts = placed.groupBy("shard", "window").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("window").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "window", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "window").orderBy("doc_id", "text_crc32", "size"))
    return placed.join(offsets, ["shard", "window"]).withColumn("slot", (F.col("before") + number - 1).cast("long"))
