"""Nearest vectors by cosine: an exact metric index.

Unit vectors have a metric: distance^2 = 2 - 2 cosine. Some vectors are pivots. Every gallery vector belongs to the cell of its nearest pivot; inside a
cell vectors are sorted by their distance to it and cut into blocks, of each of which the least and the greatest distance to
every pivot are known. By the triangle inequality that bounds how near and how far a probe's neighbours in a block can be. A probe is
compared with the most promising block first; then with those blocks that can still hold something nearer, and no other."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stages import stage

#: Pivots of each length of vectors, chosen from a sample of so many rows. They decide what is skipped, never what is found.
PIVOTS, PIVOT_SAMPLE = 64, 4096
BLOCK_ROWS, CHUNK_BLOCKS, PART_ROWS = 2048, 4096, 512
SLACK = 1e-7  # a distance is a root, and has half the digits of a cosine


def _units(batches):
    """(id, d, u): unit vectors of those that have a direction, packed."""
    for batch in batches:
        ids, d, u = [], [], []
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v"), strict=True):
            x = np.array(v.values.to_numpy(zero_copy_only=False), dtype=np.float64) if v.is_valid else np.zeros(0)
            top = np.abs(x).max(initial=0.0)
            if i is not None and len(x) and np.isfinite(x).all() and top > 0:
                x = x / top
                ids.append(i), d.append(len(x)), u.append((x / np.linalg.norm(x)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(d, pa.int32()), pa.array(u, pa.binary())], ["id", "d", "u"])


def _matrix(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, d)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of ``x`` far from each other: the first, then each time the one farthest from all before."""
    at, far = [0], distances(x, x[:1])[:, 0]
    while len(at) < min(n, len(x)) and far.max() > SLACK:
        at.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[at[-1:]])[:, 0])
    return x[at]


def _sample_pivots(units: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    rows: dict[int, list[bytes]] = {}
    for r in units.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect():
        rows.setdefault(r.d, []).append(bytes(r.u))
    return {d: choose_pivots(np.frombuffer(b"".join(u), dtype=np.float64).reshape(-1, d), pivots) for d, u in rows.items()}


def _by_length(batch):
    of = batch.column("d").to_numpy()
    for d in np.unique(of).tolist():
        yield d, batch.filter(pa.array(of == d))


def build_index(units: DataFrame, pivots: dict[int, np.ndarray], block_rows: int) -> DataFrame:
    """Blocks (block, d, n, ids, x, lo, hi) of the gallery."""
    held = units.sparkSession.sparkContext.broadcast(pivots)

    def place(batches):
        for batch in batches:
            for d, rows in _by_length(batch):
                of = held.value.get(d)
                far = distances(_matrix(rows.column("u"), d), of) if of is not None else np.zeros((rows.num_rows, 1))
                cell = far.argmin(axis=1)
                yield rows.append_column("cell", pa.array(cell.astype(np.int32))).append_column("r", pa.array(far[np.arange(len(cell)), cell]))

    def emit(group, parts, task, n):
        t = pa.Table.from_batches(parts)
        x, of = _matrix(t.column("u"), group[0]), held.value.get(group[0])
        far = distances(x, of) if of is not None else np.zeros((len(x), 1))
        return pa.RecordBatch.from_pylist(
            [{"block": (task << 32) + n, "d": group[0], "n": len(x), "ids": t.column("id").to_numpy().tobytes(), "x": x.tobytes(), "lo": far.min(axis=0).tobytes(), "hi": far.max(axis=0).tobytes()}],
            schema=pa.schema([("block", pa.int64()), ("d", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())]),
        )

    def cut(batches):
        from pyspark import TaskContext

        task, made, held_rows, size, group = TaskContext.get().partitionId(), 0, [], 0, None
        for batch in batches:
            keys = list(zip(batch.column("d").to_pylist(), batch.column("cell").to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                if held_rows and (keys[at] != group or size >= block_rows):
                    yield emit(group, held_rows, task, made)
                    made, held_rows, size = made + 1, [], 0
                group, to = keys[at], at
                while to < len(keys) and keys[to] == group and size < block_rows:
                    to, size = to + 1, size + 1
                held_rows.append(batch.slice(at, to - at))
                at = to
        if held_rows:
            yield emit(group, held_rows, task, made)

    order = ["d", "cell", "r", "id"]
    placed = units.mapInArrow(place, "id long, d int, u binary, cell int, r double").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = stage(placed.mapInArrow(cut, "block long, d int, n int, ids binary, x binary, lo binary, hi binary"))
    return blocks


def _bounds(table: pa.Table, heads: pa.Table, pivots: dict[int, np.ndarray]):
    """Least and greatest distance of each probe to the members of each block."""
    d = heads.column("d")[0].as_py()
    x, of = _matrix(table.column("u"), d), pivots.get(d)
    far = distances(x, of) if of is not None else np.zeros((len(x), 1))
    lo, hi = (np.frombuffer(b"".join(heads.column(c).to_pylist()), dtype=np.float64).reshape(heads.num_rows, -1) for c in ("lo", "hi"))
    low, high = np.zeros((len(x), len(lo))), np.full((len(x), len(lo)), 2.0)
    for j in range(far.shape[1]) if of is not None else ():
        q = far[:, j, None]
        np.maximum(low, np.maximum(q - hi[None, :, j], lo[None, :, j] - q), out=low)
        np.minimum(high, q + hi[None, :, j], out=high)
    return low, high


def match_embeddings(probes: DataFrame, gallery: DataFrame, k: int = 1, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, told: Callable | None = None) -> DataFrame:
    """The ``k`` gallery vectors of greatest cosine for each probe, itself left out: (vec_id, match_id, cosine), exact; of equal ones those
    with the least id.

    Vectors that are null, empty, zero or not finite, and null ids, match nothing; vectors of different lengths neither. ``told``
    is called with how many pairs of a probe and a gallery vector are compared. What one task holds is a block of the gallery with some
    probes, or a few thousand blocks' bounds with some probes. Where nothing can be skipped, as with vectors in no clusters at all,
    all pairs are compared."""
    units = lambda df: df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(_units, "id long, d int, u binary")
    p, g = stage(units(probes)), stage(units(gallery))
    chosen = _sample_pivots(g, pivots)
    held = p.sparkSession.sparkContext.broadcast(chosen)
    blocks = build_index(g, chosen, block_rows)
    # bounds are dealt in chunks, each with blocks of one length
    chunks = max(1, -(-blocks.count() // CHUNK_BLOCKS))
    heads = blocks.select("block", "d", "n", "lo", "hi", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk"))
    parts = max(1, -(-p.count() // PART_ROWS))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    key = ["d", "chunk", "part"]
    dealt_heads = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = lambda rows: rows.withColumns({"part": part, "chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))})

    def promising(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "low": pa.array([], pa.float64()), "most": pa.array([], pa.float64())})
        low, high = _bounds(a, b, held.value)
        best = np.lexsort((high, low), axis=1)[:, 0] if len(b) > 1 else np.zeros(len(a), dtype=np.int64)
        # so far away is the k-th neighbour at most: of blocks by their greatest distance, as many as hold k others
        by = np.argsort(high, axis=1, kind="stable")
        enough = np.cumsum(b.column("n").to_numpy()[by], axis=1) >= k + 1
        most = np.where(enough.any(axis=1), np.take_along_axis(high, by, axis=1)[np.arange(len(a)), enough.argmax(axis=1)], 2.0)
        return pa.table({"id": a.column("id"), "block": pa.array(b.column("block").to_numpy()[best]), "low": pa.array(low[np.arange(len(a)), best]), "most": pa.array(most)})

    first = dealt(p).groupBy(*key).cogroup(dealt_heads.groupBy(*key)).applyInArrow(promising, "id long, block long, low double, most double")
    first = stage(first.groupBy("id").agg(F.min_by("block", F.struct("low", "block")).alias("block"), F.min("most").alias("most")))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"vec_id": [], "match_id": [], "cosine": []}
        for r in b.to_pylist() if a.num_rows else ():
            ids, x, own = np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["x"], dtype=np.float64).reshape(-1, r["d"]), a.column("id").to_numpy()
            s = _matrix(a.column("u"), r["d"]) @ x.T
            s[own[:, None] == ids[None, :]] = -np.inf
            top = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
            cosine = np.take_along_axis(s, top, axis=1)
            hit = np.isfinite(cosine)
            out["vec_id"].append(np.repeat(own, hit.sum(axis=1))), out["match_id"].append(ids[top][hit]), out["cosine"].append(cosine[hit])
        kinds = {"vec_id": np.int64, "match_id": np.int64, "cosine": np.float64}
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, dtype=kinds[c])) for c, v in out.items()})

    def compared(pairs: DataFrame) -> DataFrame:
        """The best ``k`` of each pair of a probe and a block. A block's probes are dealt in parts, each with a copy of the block."""
        many = pairs.groupBy("block").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts"))
        a = pairs.join(many, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).join(p, "id").select("block", "part", "id", "u")
        b = blocks.join(many, "block").withColumn("part", F.explode(F.expr("sequence(0, _parts - 1)"))).select("block", "part", "d", "ids", "x")
        return a.groupBy("block", "part").cogroup(b.groupBy("block", "part")).applyInArrow(best, "vec_id long, match_id long, cosine double")

    near = stage(compared(first.select("id", "block")))
    line = W.partitionBy("vec_id").orderBy(F.desc("cosine"), "match_id")
    kth = near.withColumn("_r", F.row_number().over(line)).where(F.col("_r") == k).select(F.col("vec_id").alias("id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine"))).alias("kth"))
    limits = first.join(kth, "id", "left").select("id", F.col("block").alias("seed"), F.least("most", F.coalesce("kth", F.lit(2.0))).alias("most"))

    def left_over(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "block": pa.array([], pa.int64())})
        low, _ = _bounds(a, b, held.value)
        names = b.column("block").to_numpy()
        i, j = np.nonzero((low <= a.column("most").to_numpy()[:, None] + SLACK) & (names[None, :] != a.column("seed").to_numpy()[:, None]))
        return pa.table({"id": pa.array(a.column("id").to_numpy()[i]), "block": pa.array(names[j])})

    rest = stage(dealt(p.join(limits, "id")).groupBy(*key).cogroup(dealt_heads.groupBy(*key)).applyInArrow(left_over, "id long, block long"))
    if told:
        sizes = blocks.select("block", "n")
        told(rest.unionAll(first.select("id", "block")).join(sizes, "block").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    found = near.unionAll(compared(rest)).withColumn("_r", F.row_number().over(line))
    return found.where(F.col("_r") <= k).drop("_r")
