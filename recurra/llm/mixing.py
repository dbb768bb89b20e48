"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Each source's documents are cut into blocks.  A source of weight w gets the share w / W of all slots, W the sum of the weights,
which are whole numbers.  Block k (from 1) of a source may run from slot floor((k - 1) * W / w) and must run before slot
ceil(k * W / w); in each slot the released block with the earliest deadline runs, ties by source.  At any slot each source has
then had less than one block more or less than its weight asks for, however many slots there are.  Slots of sources that have
run out are closed up, so the rest go on in proportion; every row is kept.  Sources of weight 0 follow after all others.

Null sources count as one source, and null doc_ids as empty ones; rows that repeat are separate rows of their blocks; an empty
table gives an empty result; other columns pass through, whatever their names, but for one called _mix, which is replaced.  A very long
text is carried whole: a block is a number of rows.
"""

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the ratios of the weights: exact for simple fractions such as 1/3, else to a billionth."""
    parts = {k: Fraction(v).limit_denominator(1_000_000) for k, v in weights.items()}
    common = math.lcm(*(p.denominator for p in parts.values()))
    if common > 1_000_000_000 or any(abs(float(p) - weights[k]) > 1e-12 for k, p in parts.items()):
        return {k: round(v * 1_000_000_000) for k, v in weights.items()}
    return {k: int(p * common) for k, p in parts.items()}


def shares(sizes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: an array `s` of structs (source, b blocks, r rows, w weight), by source, nulls first, and the weights' sum `total`.

    sizes: source, rows, b.  Without weights a source counts by the square root of its rows (to a thousandth), so that small
    sources are seen more often than they are large.
    """
    weight = F.floor(F.sqrt(F.col("rows") * 1_000_000))
    if weights is not None:
        pairs = [x for k, v in whole(weights).items() for x in (F.lit(k), F.lit(v).cast("long"))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(F.col("source"), F.lit(""))), F.lit(0)) if pairs else F.lit(0)
    arr = sizes.select(F.struct("source", "b", F.col("rows").alias("r"), weight.cast("long").alias("w")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("s"))
    return arr.where(F.size("s") > 0).withColumn("total", F.expr("aggregate(s, 0L, (t, e) -> t + e.w)"))


def schedule(block_rows: int, step: int) -> Column:
    """EDF from slot 0 until at most one source with a weight has blocks left: a struct of done (by source), turn, first and out.

    State: blocks done by each source (those of sources that have run out go on as empty slots), and blocks and rows that ran.
    A source's next block k = done + 1 is released at slot t if done * total < (t + 1) * w; its deadline is ceil(k * total / w).
    Of the released the least (deadline, index) runs.  out: arrays of what ran in `step` slots each, so that none grows long
    while it is added to.  `till`: how many slots.
    """
    pick = (
        "array_min(transform(filter(sequence(0, size(s) - 1), i -> state.done[i] * total < (t + 1L) * s[i].w), "
        "i -> named_struct('d', ((state.done[i] + 1L) * total + s[i].w - 1L) div s[i].w, 'i', i))).i"
    )
    ran = "state.done[k] < s[k].b"
    rows = f"least({block_rows}L, s[k].r - state.done[k] * {block_rows}L)"
    new = (
        "named_struct('done', transform(state.done, (n, j) -> if(j = k, n + 1L, n)), "
        f"'turn', state.turn + if({ran}, 1L, 0L), 'first', state.first + if({ran}, {rows}, 0L), "
        f"'out', if({ran}, concat(state.out, array(named_struct('i', k, 'block', state.done[k], 'slot', t, 'turn', state.turn, 'first', state.first))), state.out))"
    )
    out = "array<struct<i: int, block: bigint, slot: bigint, turn: bigint, first: bigint>>"
    begun = lambda done, turn, first: f"named_struct('done', {done}, 'turn', {turn}, 'first', {first}, 'out', cast(array() as {out}))"
    inner = f"aggregate(sequence(c * {step}L, least((c + 1L) * {step}L, till) - 1L), {begun('all.done', 'all.turn', 'all.first')}, (state, t) -> transform(array({pick}), k -> {new})[0])"
    joined = f"transform(array({inner}), e -> named_struct('done', e.done, 'turn', e.turn, 'first', e.first, 'out', concat(all.out, array(e.out))))[0]"
    whole_begun = f"named_struct('done', array_repeat(0L, size(s)), 'turn', 0L, 'first', 0L, 'out', cast(array() as array<{out}>))"
    return F.expr(f"aggregate(if(till > 0, sequence(0L, (till - 1L) div {step}L), cast(array() as array<bigint>)), {whole_begun}, (all, c) -> {joined})")


def planned(sizes: DataFrame, block_rows: int, step: int, weights: dict[str, float] | None) -> DataFrame:
    """source, block, w, total, slot, turn and first (the rows that run before it) of every block; no slot where w is 0."""
    plan = checkpointed(shares(sizes, weights))
    ends = "array_sort(transform(filter(s, e -> e.w > 0), e -> (e.b * total + e.w - 1L) div e.w), (x, y) -> if(x > y, -1, if(x < y, 1, 0)))"
    plan = plan.withColumn("till", F.expr(f"coalesce(try_element_at({ends}, 2), 0L)"))
    plan = checkpointed(plan.withColumn("e", schedule(block_rows, step)))  # one row, used many times
    early = plan.select("s", "total", F.explode(F.flatten("e.out")).alias("x")).select("s", "total", F.col("x.*"))
    # What is left: one source with a weight, then those without, source by source.
    left = "transform(s, (e, i) -> named_struct('i', i, 'w', e.w, 'from', least(e.done, e.b), 'b', e.b, 'r', e.r))".replace("e.done", "done[i]")
    left = plan.select("s", "total", F.col("e.done").alias("done"), F.col("e.turn").alias("n"), F.col("e.first").alias("m")).withColumn("l", F.expr(f"array_sort(filter({left}, e -> e.from < e.b), (x, y) -> if(x.w > 0, -1, if(y.w > 0, 1, x.i - y.i)))"))
    left = left.select("s", "total", "n", "m", "l", F.posexplode("l").alias("p", "x"))
    before = lambda part: f"aggregate(slice(l, 1, p), 0L, (t, e) -> t + {part})"
    left = left.select("s", "total", F.col("x.i").alias("i"), F.col("x.from").alias("from"), F.expr(f"n + {before('e.b - e.from')}").alias("n"), F.expr(f"m + {before(f'e.r - e.from * {block_rows}L')}").alias("m"), F.expr("explode(sequence(x.from, x.b - 1L))").alias("block"))
    slot = "if(s[i].w > 0, ((block + 1L) * total + s[i].w - 1L) div nullif(s[i].w, 0L) - 1L, null)"
    left = left.select("s", "total", "i", "block", F.expr(slot).alias("slot"), F.expr("n + block - from").alias("turn"), F.expr(f"m + (block - from) * {block_rows}L").alias("first"))
    both = early.unionByName(left)
    return both.select(F.expr("s[i].source").alias("_s"), F.col("block").alias("_b"), F.expr("nullif(s[i].w, 0L)").alias("w"), "total", "slot", "turn", "first")


def mix_sources(docs: DataFrame, block_rows: int = 64, slots: int = 1000, weights: dict[str, float] | None = None) -> DataFrame:
    """docs with `_mix`: a struct of block (from 0), release, deadline, slot, turn (blocks that run before it) and position (its row in the mix, gapless from 0).

    Blocks take a source's rows in the order of md5(doc_id), a fixed shuffle.  slots: how many are scheduled at a stretch; no
    matter to the result.
    """
    # Rows are carried in one column, so that theirs and ours cannot clash.
    names = [c for c in docs.columns if c != "_mix"]
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    ours = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").alias("of"), "doc_id", key.alias("k")).withColumn("c", F.substring("k", 1, 3))
    counts = docs.select(F.col("source").alias("of"), F.substring(key, 1, 3).alias("c")).groupBy("of", "c").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("of").orderBy("c").rowsBetween(Window.unboundedPreceding, -1))  # at most 4096 rows a source
    offsets = counts.select("of", "c", F.coalesce(before, F.lit(0)).alias("before"))
    sizes = counts.groupBy("of").agg(F.sum("n").alias("rows")).withColumn("b", F.ceil(F.col("rows") / block_rows).cast("long")).withColumnRenamed("of", "source")
    number = F.row_number().over(Window.partitionBy("of", "c").orderBy("k", "doc_id")) - 1
    numbered = ours.withColumn("n", number).join(offsets.select(F.col("of").alias("s"), F.col("c").alias("oc"), "before"), F.expr("of <=> s and c = oc"), "left")
    numbered = numbered.select("row", "of", (F.col("n") + F.col("before")).cast("long").alias("n")).withColumn("b", F.expr(f"n div {block_rows}"))
    blocks = planned(sizes, block_rows, slots, weights).select(
        "_s",
        "_b",
        F.struct(
            F.col("_b").alias("block"),
            F.expr("(_b * total) div w").alias("release"),
            F.expr("((_b + 1L) * total + w - 1L) div w").alias("deadline"),
            "slot",
            "turn",
            "first",
        ).alias("_m"),
    )
    joined = numbered.join(blocks, F.expr("of <=> _s and b = _b"))
    fields = [F.col("_m." + c).alias(c) for c in ("block", "release", "deadline", "slot", "turn")]
    return joined.select(*[F.col(f"row.`{c}`") for c in names], F.struct(*fields, F.expr(f"_m.first + n % {block_rows}").alias("position")).alias("_mix"))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs in the order of the mix: sorted files, read in the order of their names."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source")
    mixed = mix_sources(whole, **options).select("row", F.col("_mix.position").alias("position"))
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")
