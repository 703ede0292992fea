"""Embedding near-dedup by PCA-ordered tiled comparison.

Distinct vectors are rotated onto the principal axes of all vectors, sorted by the first one
within their label and cut into tiles. Tile pairs whose boxes on the leading axes are too far
apart for the threshold are never made. Inside a tile pair the leading dimensions are multiplied
first; what is left of each product is bounded by the norms of the two suffixes, and a pair is
given up as soon as its bound falls under the threshold. Survivors are confirmed on the original
vectors in double precision, so the rotation changes speed only, never a result.

Copies of a vector are one tile row with a count, so a hot vector costs one comparison. A tile
pair returns at most one row for each of its vectors (links found, and the least vector of its
component inside the pair), not one row a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lean, stage

LEAD = 8  # axes in a tile's box
STEP = 16  # dimensions accumulated at a time
SLACK = 1e-9  # rounding allowance of a bound; confirmation is exact


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch):
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


def _gram(directions: dict[int, np.ndarray]):
    """(dim, pos, v): of each length the sum of u u^T, or of u u^T times its ``directions``, over unit vectors u."""

    def run(batches):
        sums = {}
        for batch in batches:
            for d, part in _by_dim(batch):
                u = unit(_matrix(part.column("emb")))
                sums[d] = sums.get(d, 0) + u.T @ (u @ directions[d] if d in directions else u)
        for d, g in sums.items():
            flat = g.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d, dtype=np.int32)), pa.array(np.arange(len(flat), dtype=np.int64)), pa.array(flat)], ["dim", "pos", "v"])

    return lean(run)


def pca_bases(vectors: DataFrame, axes: int = 256, budget: int = 64 << 20) -> dict[int, np.ndarray]:
    """The first principal axes of every vector length, largest first, over all its vectors: at most ``axes``, and so few that
    those of all lengths together take ``budget`` bytes, whatever the rows. For lengths up to ``axes`` they
    come from the sum of outer products, for longer ones from two rounds of subspace iteration, whose sums have a few
    columns only."""
    kinds = [r.dim for r in vectors.select("dim").distinct().collect()]
    if not kinds:
        return {}
    axes = max(1, min(axes, budget // (8 * sum(kinds))))
    long = [d for d in kinds if d > axes]

    def sums(directions: dict[int, np.ndarray], some: list[int]) -> dict[int, np.ndarray]:
        rows = vectors.where(F.col("dim").isin(some)).select("dim", "emb").mapInArrow(_gram(directions), "dim int, pos long, v double").groupBy("dim", "pos").agg(F.sum("v").alias("v")).toArrow()
        dim, pos, v = (rows.column(c).to_numpy() for c in ("dim", "pos", "v"))
        out = {}
        for d in some:
            out[d] = np.zeros(d * (directions[d].shape[1] if d in directions else d))
            out[d][pos[dim == d]] = v[dim == d]
            out[d] = out[d].reshape(d, -1)
        return out

    out = {}
    short = [d for d in kinds if d <= axes]
    for d, g in sums({}, short).items() if short else ():
        out[d] = np.ascontiguousarray(np.linalg.eigh(g)[1][:, ::-1])
    if long:
        width = {d: min(d, axes + 8) for d in long}
        q = {d: np.linalg.qr(np.random.default_rng(d).normal(size=(d, width[d])))[0] for d in long}
        for last in (False, True):
            y = sums(q, long)
            if not last:
                q = {d: np.linalg.qr(y[d])[0] for d in long}
        for d in long:
            small = q[d].T @ y[d]
            turn = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]
            out[d] = np.ascontiguousarray((q[d] @ turn)[:, :axes])
    return out


def _tiles(bases: dict[int, np.ndarray], rows: int):
    def order(batches):
        for batch in batches:
            for d, part in _by_dim(batch):
                yield part.append_column("z", pa.array(unit(_matrix(part.column("emb"))) @ bases[d][:, 0]))

    def cut(batches):
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, []

        def emit(parts):
            nonlocal made
            t = pa.Table.from_batches(parts)
            label, d = t.column("label")[0].as_py(), t.column("dim")[0].as_py()
            x = np.concatenate([_matrix(c) for c in t.column("emb").chunks])
            z = unit(x) @ bases[d][:, :LEAD]
            made += 1
            return pa.RecordBatch.from_pylist(
                [{
                    "tile": (task << 32) + made, "label": label, "dim": d, "n": len(x),
                    "ids": t.column("id").to_numpy().tobytes(), "counts": t.column("c").to_numpy().tobytes(),
                    "x": x.astype(np.float32).tobytes() if x.dtype == np.float32 else x.astype(np.float64).tobytes(),
                    "lo": z.min(axis=0).tolist(), "hi": z.max(axis=0).tolist(),
                }],
                schema=pa.schema([("tile", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("x", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]),
            )

        count = 0
        for batch in batches:
            at = 0
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            while at < batch.num_rows:
                if held and (held[-1].column("label")[0].as_py(), held[-1].column("dim")[0].as_py()) != keys[at]:
                    yield emit(held)
                    held, count = [], 0
                to = at
                while to < batch.num_rows and keys[to] == keys[at] and count < rows:
                    to, count = to + 1, count + 1
                if to > at:
                    held.append(batch.slice(at, to - at))
                    at = to
                if count >= rows:
                    yield emit(held)
                    held, count = [], 0
        if held:
            yield emit(held)

    return order, cut


def near_pairs(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, same: bool):
    """(i, j) with cosine of a[i] and b[j] at the threshold or above; i < j if ``same``.

    ``basis`` has the leading axes; what a unit vector has outside of the first k is the rest of its length 1."""
    za, zb = unit(a) @ basis, unit(b) @ basis
    d = za.shape[1]
    rest = lambda z, k: np.sqrt(np.maximum(1 - (z[:, :k] ** 2).sum(axis=1), 0) + 1e-14)  # noqa: E731  never less than it is
    k = min(STEP, d)
    part = za[:, :k] @ zb[:, :k].T
    i, j = np.nonzero(part + rest(za, k)[:, None] * rest(zb, k)[None, :] >= threshold - SLACK)
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    part = part[i, j]
    while k < d and len(i):
        to = min(k + STEP, d)
        part = part + (za[i, k:to] * zb[j, k:to]).sum(axis=1)
        keep = part + rest(za, to)[i] * rest(zb, to)[j] >= threshold - SLACK
        i, j, part, k = i[keep], j[keep], part[keep], to
    if len(i):
        x, y = a[i].astype(np.float64), b[j].astype(np.float64)
        x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
        cosine = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        i, j = i[cosine >= threshold], j[cosine >= threshold]
    return i, j


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least node of each node's component, nodes 0..n-1 in the order that counts."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            return low


def _compare(bases: dict[int, np.ndarray], threshold: float):
    def read(r, side):
        x = np.frombuffer(r[f"x_{side}"], dtype=np.float32 if len(r[f"x_{side}"]) == 4 * r[f"n_{side}"] * r["dim"] else np.float64)
        return np.frombuffer(r[f"ids_{side}"], dtype=np.int64), np.frombuffer(r[f"counts_{side}"], dtype=np.int64), x.reshape(-1, r["dim"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                same = r["tile_a"] == r["tile_b"]
                (ia, ca, xa), (ib, cb, xb) = read(r, "a"), read(r, "b")
                i, j = near_pairs(xa, xb, bases[r["dim"]], threshold, same)
                if not len(i):
                    continue
                ids, counts = (ia, ca) if same else (np.concatenate([ia, ib]), np.concatenate([ca, cb]))
                j = j if same else j + len(ia)
                links = np.bincount(i, counts[j], len(ids)) + np.bincount(j, counts[i], len(ids))
                order = np.argsort(ids, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(ids))
                low = ids[order][_least(len(ids), place[i], place[j])][place]
                hit = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(low[hit])], ["id", "links", "low"])

    return run


def embedding_near_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile_rows: int = 1024) -> DataFrame:
    """Links between vectors of one label with cosine >= ``threshold`` and their components.

    Returns one row per input row: the id, ``n_links`` (other vectors linked directly),
    ``component_id`` (least id reachable), ``kept`` (id = component_id) and the label.

    Defined edge cases: a null id, label or vector, an empty or zero vector, and a vector with null
    or non-finite components link with nothing and are kept (component_id = id, null for a null
    id); vectors of different lengths never link; repeated rows are vectors of their own that link
    with each other; rows of one id with different vectors have links and components of their own; there are no ties (a link is one at the
    threshold too); an empty table gives an empty result; other columns are ignored."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("emb"), F.col(label_col).cast("string").alias("label"))
    bad = F.exists("emb", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("emb").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("emb", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(valid, F.lit(False)))
    good = rows.where("ok").select("id", "label", "emb")
    reps = stage(good.groupBy("label", "emb").agg(F.min("id").alias("id"), F.count("*").alias("c")).withColumn("dim", F.size("emb")))
    names = None
    if not reps.groupBy("id").count().where("count > 1").isEmpty():
        # vectors that share an id are told apart by numbers that go up with the ids
        ranged = reps.withColumn("h", F.xxhash64("label", "emb")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").drop("h")
        reps = stage(ranged.withColumn("real", F.col("id")).withColumn("id", F.monotonically_increasing_id()))
        names = reps.select(F.col("id").alias("component"), F.col("real").alias("named"))
    bases = pca_bases(reps)
    order, cut = _tiles(bases, tile_rows)
    emb_type = reps.schema["emb"].dataType.simpleString()
    lined = reps.select("id", "c", "label", "dim", "emb").mapInArrow(lean(order), f"id long, c long, label string, dim int, emb {emb_type}, z double")
    tiles = stage(
        lined.repartitionByRange("label", "dim", "z").sortWithinPartitions("label", "dim", "z", "id").drop("z")
        .mapInArrow(lean(cut), "tile long, label string, dim int, n int, ids binary, counts binary, x binary, lo array<double>, hi array<double>")
    )
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    cell = lambda v: F.floor(v / reach).cast("int")
    heads = tiles.select("tile", "label", "dim", "lo", "hi")
    a = heads.select("label", "dim", *(F.col(c).alias(f"{c}_a") for c in ("tile", "lo", "hi")), F.explode(F.sequence(cell(F.col("lo")[0] - reach), cell(F.col("hi")[0] + reach))).alias("cell"))
    b = heads.select("label", "dim", *(F.col(c).alias(f"{c}_b") for c in ("tile", "lo", "hi")), F.explode(F.sequence(cell(F.col("lo")[0]), cell(F.col("hi")[0]))).alias("cell"))
    gap = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= reach * reach
    pairs = a.join(b, ["label", "dim", "cell"]).where((F.col("tile_a") <= F.col("tile_b")) & near).select("tile_a", "tile_b").distinct()
    side = lambda s: tiles.select("tile", *(["dim"] if s == "a" else []), "n", "ids", "counts", "x").withColumnsRenamed({c: f"{c}_{s}" for c in ("tile", "n", "ids", "counts", "x")})
    found = stage(pairs.join(side("a"), "tile_a").join(side("b"), "tile_b").mapInArrow(lean(_compare(bases, threshold)), "id long, links long, low long"))
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    known = reps.join(degree, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    if names is not None:
        known = known.join(names, "component").withColumn("component", F.col("named"))
    known = known.select("label", "emb", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.col("component").alias("component_id"))
    linked = good.join(known, ["label", "emb"]).select("id", "n_links", "component_id", "label")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), "label")
    out = linked.unionAll(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), "label")
