"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

Each source's rows are cut into blocks. Block k of a source with weight w is released at slot
floor(k / w) and due by slot ceil((k + 1) / w); taking in every slot the released block with the
earliest deadline gives an order in which every source is less than one block away from its share
at every moment (Baruah et al., 1996). Weights are rounded to m of Q slots, so the schedule repeats
after Q slots, and only that one period of Q slots is made, by a fold in a SQL expression: its size
depends on the weights' resolution, not on the rows. With many sources the period is made by heaps on the driver,
and places are counted over a table of blocks instead of over the sources.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Slots of a period: at least so many, and so many for each source. As each source has a slot to begin with, the
#: rounded weights are within 1 / PER_SOURCE of the schedule of the targets.
QUANTUM, PER_SOURCE = 1000, 50


def target_slots(counts: DataFrame, alpha: float, quantum: int) -> DataFrame:
    """(source, n, m): m of ``quantum`` slots for each source, weights being ``w`` where the table has it, else n ** ``alpha``; at
    least one slot each, the rest by largest remainder. ``counts`` has (source, n)."""
    w = counts if "w" in counts.columns else counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    total = w.agg(F.count("*").alias("sources"), F.sum("w").alias("total"))
    w = w.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one")
    w = w.withColumn("share", F.col("w") / F.col("total") * (F.lit(quantum) - F.col("sources"))).withColumn("low", F.floor("share"))
    left = "cast({0} - sources - sum(low) over (partition by one) as int)".format(quantum)
    rank = "row_number() over (partition by one order by share - low desc, source)"
    return w.select("source", "n", (1 + F.col("low") + F.expr(f"case when {rank} <= {left} then 1 else 0 end")).cast("int").alias("m"))


def period(slots: DataFrame, quantum: int) -> DataFrame:
    """One period of the schedule: (slot, source, k, ahead): block k of the source in that slot, and
    how many blocks of each source, in order of the sources, come before it.

    ``slots`` (source, m) is the table of sources. In each slot the fold takes, of the sources whose
    next block is released, the one with the earliest deadline, then the first by name."""
    pick = f"""array_min(filter(transform(st.k, (k, i) -> if(k < s[i].m and k * {quantum} div s[i].m <= t,
        struct(((k + 1) * {quantum} + s[i].m - 1) div s[i].m as due, i as i), null)), x -> x is not null)).i"""
    fold = f"""
      aggregate(sequence(0, {quantum - 1}),
        named_struct('k', transform(s, x -> 0), 'picks', cast(array() as array<struct<i:int,ahead:array<int>>>)),
        (st, t) -> transform(array({pick}), p -> named_struct(
          'k', transform(st.k, (k, i) -> k + if(i = p, 1, 0)),
          'picks', concat(st.picks, array(named_struct('i', p, 'ahead', st.k)))))[0],
        st -> st.picks)"""
    table = slots.agg(F.expr("sort_array(collect_list(struct(source, m)))").alias("s"))
    picks = table.select("s", F.expr(fold).alias("picks")).selectExpr("s", "posexplode(picks) as (slot, p)").where("p.i is not null")
    return picks.selectExpr("slot", "s[p.i].source as source", "p.ahead[p.i] as k", "p.ahead as ahead")


def long_period(slots: DataFrame, quantum: int) -> DataFrame:
    """(source, k, slot) as in :func:`period`, by heaps on the driver: a few numbers for each slot."""
    table = sorted((r.source, r.m) for r in slots.select("source", "m").collect())
    m, k = [x for _, x in table], [0] * len(table)
    waiting, ready, picks = [(0, i) for i in range(len(m))], [], np.zeros((3, quantum), dtype=np.int32)
    n = 0
    for t in range(quantum):
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(k[i] + 1) * quantum // m[i]), i))
        if ready:
            i = heapq.heappop(ready)[1]
            picks[:, n] = i, k[i], t
            n += 1
            k[i] += 1
            if k[i] < m[i]:
                heapq.heappush(waiting, (k[i] * quantum // m[i], i))
    names = pa.array([s for s, _ in table], pa.string()).take(pa.array(picks[0, :n]))
    out = pa.table({"source": names, "k": pa.array(picks[1, :n]), "slot": pa.array(picks[2, :n])})
    return stage(slots.sparkSession.createDataFrame(out))


def block_places(slots: DataFrame, plan: DataFrame, quantum: int, block_rows: int, span: int = 4096) -> DataFrame:
    """(source, mix_block, mix_slot, start): the slot of each block and the rows before it. ``slots`` (source, n, m)
    has the sources, ``plan`` (source, k, slot) the period. Rows are summed up to each ``span`` of slots, then inside."""
    far = slots.withColumn("blocks", F.expr(f"(n + {block_rows - 1}) div {block_rows}")).selectExpr("*", f"explode(sequence(0L, (blocks - 1) div {span})) as far")
    blocks = far.repartition("source", "far").selectExpr("*", f"explode(sequence(far * {span}, least(blocks, (far + 1) * {span}) - 1)) as mix_block").withColumn("k", F.expr("cast(mix_block % m as int)"))
    blocks = blocks.join(plan, ["source", "k"]).selectExpr("source", "mix_block", f"(mix_block div m) * {quantum} + slot as mix_slot", f"least({block_rows}L, n - mix_block * {block_rows}) as c")
    blocks = stage(blocks.withColumn("part", F.expr(f"mix_slot div {span}")))
    below = "rows between unbounded preceding and 1 preceding), 0)"
    before = blocks.groupBy("part").agg(F.sum("c").alias("c")).select("part", F.expr(f"coalesce(sum(c) over (order by part {below}").alias("before"))
    start = F.expr(f"coalesce(sum(c) over (partition by part order by mix_slot {below}")
    return blocks.withColumn("inside", start).join(before, "part").select("source", "mix_block", "mix_slot", (F.col("before") + F.col("inside")).alias("start"))


def _name(source: Column) -> Column:
    """A null source sorts before all others, apart from one that is empty."""
    return F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source.cast("string")))


def mix_sources(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", alpha: float = 0.5, block_rows: int = 16, quantum: int | None = None, group_rows: int = 3000, max_broadcast: int = 1_000_000, weights: DataFrame | None = None) -> DataFrame:
    """Add ``mix_block`` (block of its source), ``mix_slot`` (place of the block in the schedule) and
    ``mix_position`` (gapless place of the row in the whole mix). Target weights are those of ``weights`` (source,
    weight), or proportional to (rows of the source) ** ``alpha``.

    All rows are kept. While every source has blocks left, each is less than one block from its target
    share; when one runs out its slots are passed over and the others go on in the same proportions.
    Within a source rows are ordered by the MD5 of the id. They are numbered in steps, so that a
    source with a third of all rows is never in one task: rows are counted by (source, first digits
    of the MD5), at most about ``group_rows`` rows a group, and a row's number is the count of the groups
    before its own plus its rank there. The schedule (``quantum`` x sources numbers) is broadcast up to
    ``max_broadcast`` numbers; beyond that rows are joined with their blocks by a shuffle.

    ``quantum`` is the number of slots of the schedule's period; by default 1000, or 50 a source where that is more.
    Each source has one slot at least, which bends the targets by up to sources / quantum of the schedule (a
    fiftieth by default); one that is given smaller than the number of sources counts as that number.

    Defined edge cases: a null source is a source of its own; a source without a weight, or with one that is not above
    0, has the least weight of all; a null id counts as an empty one; rows with equal ids are ordered arbitrarily between
    themselves; texts are not read; an empty table gives an empty result; all columns are returned, but one named like
    a new column is replaced by it."""
    new = ["mix_block", "mix_slot", "mix_position"]
    # the user's columns travel under private names, so that none can be taken for one of the schedule's
    kept = {f"__c{i}": c for i, c in enumerate(c for c in df.columns if c not in new)}
    back = [F.col(k).alias(c) for k, c in kept.items()]
    rows = df.select(*(F.col(f"`{c}`").alias(k) for k, c in kept.items()), _name(F.col(f"`{source_col}`")).alias("__source"), F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("__md5"))
    counts = rows.groupBy(F.col("__source").alias("source")).agg(F.count("*").alias("n"))
    n, n_sources = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if weights is not None:
        given = weights.groupBy(_name(F.col("source")).alias("source")).agg(F.sum(F.when(F.col("weight") > 0, F.col("weight").cast("double"))).alias("w"))
        least = given.agg(F.coalesce(F.min("w"), F.lit(1.0))).first()[0]
        counts = counts.join(given, "source", "left").withColumn("w", F.coalesce("w", F.lit(float(least))))
    quantum = max(QUANTUM if quantum is None else quantum, PER_SOURCE * n_sources if quantum is None else n_sources)
    digits = max(2, math.ceil(math.log(max(1, n / group_rows), 16)))
    rows = rows.withColumn("__group", F.substring("__md5", 1, digits))
    slots = target_slots(counts, alpha, quantum)
    # rows before each group: before its half of the digits, then before it in there
    sizes = rows.groupBy("__source", "__group").agg(F.count("*").alias("c")).withColumn("__half", F.substring("__group", 1, digits // 2))
    below = "rows between unbounded preceding and 1 preceding), 0)"
    halves = sizes.groupBy("__source", "__half").agg(F.sum("c").alias("c"))
    halves = halves.select("__source", "__half", F.expr(f"coalesce(sum(c) over (partition by __source order by __half {below}").alias("h"))
    inside = F.expr(f"coalesce(sum(c) over (partition by __source, __half order by __group {below}")
    groups = sizes.withColumn("g", inside).join(halves, ["__source", "__half"]).join(slots.select(F.col("source").alias("__source"), F.col("m").alias("__own")), "__source")
    groups = groups.select("__source", "__group", (F.col("g") + F.col("h")).alias("__before"), "__own")
    rank = F.expr("row_number() over (partition by __source, __group order by __md5) - 1")
    rows = rows.withColumn("__rank", rank).join(groups, ["__source", "__group"])
    rows = rows.withColumn("__at", F.col("__before") + F.col("__rank"))
    rows = rows.withColumn("mix_block", F.expr(f"cast(__at div {block_rows} as long)")).withColumn("__k", F.expr("cast(mix_block % __own as int)"))
    if quantum * n_sources > max_broadcast:
        slots = stage(slots)  # its windows are not made again for each use
        places = block_places(slots, long_period(slots, quantum), quantum, block_rows).withColumnRenamed("source", "__source")
        return rows.join(places, ["__source", "mix_block"]).withColumn("mix_position", F.expr(f"start + __at % {block_rows}")).select(*back, *new)
    table = slots.agg(F.expr("sort_array(collect_list(struct(source, m, n)))").alias("s"), F.lit(1).alias("one"))
    plan = period(slots.select("source", "m"), quantum).withColumn("one", F.lit(1)).join(table, "one")
    plan = plan.selectExpr("source as __source", "k as __k", "slot as __slot", "ahead as __ahead", "transform(s, x -> x.m) as __m", "transform(s, x -> x.n) as __n")
    rows = rows.join(F.broadcast(plan), ["__source", "__k"])
    position = F.expr(f"aggregate(sequence(0, size(__m) - 1), 0L, (a, i) -> a + least(__n[i], {block_rows} * ((mix_block div __own) * __m[i] + __ahead[i]))) + __at % {block_rows}")
    return rows.withColumn("mix_slot", F.expr(f"(mix_block div __own) * {quantum} + __slot")).withColumn("mix_position", position).select(*back, *new)


def in_mix_order(mixed: DataFrame) -> DataFrame:
    """The rows in the order of the mix: ranges of positions over the partitions, sorted inside."""
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position")
