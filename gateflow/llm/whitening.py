"""Whitening of embeddings by their weighted multiplicity covariance.

Entries become integers x = floor(scale * c), so that equal vectors are equal exactly. Identical x vectors are grouped; the fit
runs over the distinct ones, each with weight one or with its number of copies. Sums and covariance are added up from
partial sums of the tasks; the matrix product takes centred vectors. Each distinct vector is whitened once, and the
rows take theirs by a join."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stage

#: Bytes of models (means and components, a row a vector length) up to which every task holds them all.
HELD_BYTES = 32 << 20
#: Lengths up to which the table with a row a length is broadcast.
HELD_LENGTHS = 10_000
#: A distinct vector with more than this share of the rows is joined back by a broadcast; there are fewer than 1000 of them.
HOT_SHARE = 0.001
#: An eigenvalue below this part of the trace counts as none.
LEAST_EIGENVALUE = 1e-12


def _pack(x: np.ndarray) -> bytes:
    """Little-endian integers of the least width that holds all of them: equal vectors have equal bytes."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    for width in ("<i2", "<i4"):
        if np.iinfo(width).min <= low and high <= np.iinfo(width).max:
            return x.astype(width).tobytes()
    return x.astype("<i8").tobytes()


def _unpack(x: list[bytes], d: int) -> np.ndarray:
    """Vectors of length ``d``, a row each."""
    if d == 0:
        return np.zeros((len(x), 0), dtype=np.int64)
    out = np.empty((len(x), d), dtype=np.int64)
    for i, b in enumerate(x):
        out[i] = np.frombuffer(b, dtype=f"<i{len(b) // d}")
    return out


def _quantise(scale: float):
    """(id, d, key, x) of the vectors whose entries are all finite (and fit a long once scaled)."""

    def run(batches):
        for batch in batches:
            lists = batch.column("vec")
            flat = lists.flatten()  # null vectors have no entries in it
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.float64), nan=-1).astype(np.int64)
            ends = np.cumsum(np.maximum(sizes, 0))
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(values * scale)
                good = np.isfinite(x) & (np.abs(x) < 2.0**63)
            x = np.where(good, x, 0).astype(np.int64)
            at, d, keys, packed = [], [], [], []
            for i, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
                if n < 1 or not good[end - n : end].all():
                    continue
                b = _pack(x[end - n : end])
                at.append(i), d.append(n), keys.append(hashlib.sha256(b).digest()), packed.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64())), pa.array(d, pa.int32()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["id", "d", "key", "x"]
            )

    return run


def _by_length(table: DataFrame, models: DataFrame, f, schema: str) -> DataFrame:
    """``f(d, rows, model)`` -> batch, for the rows of each length ``d`` in every batch of ``table``. ``models`` (d, model): held by every
    task up to ``HELD_BYTES``, else joined to the rows. ``f`` may return None, and is called with rows None at the task's end."""
    size = models.agg(F.coalesce(F.sum(F.octet_length("model") + 64), F.lit(0))).first()[0]
    names = table.columns
    held = None
    if size <= HELD_BYTES:
        held = table.sparkSession.sparkContext.broadcast({r.d: bytes(r.model) for r in models.collect()})
    else:
        table = table.join(models, "d")

    def run(batches):
        state, seen = {}, {}
        for batch in batches:
            of = batch.column("d").to_numpy()
            for d in np.unique(of).tolist():
                rows = batch.filter(pa.array(of == d))
                if d not in seen:
                    if held is None:
                        seen.clear()  # one model at a time
                    seen[d] = held.value[d] if held is not None else rows.column("model")[0].as_py()
                out = f(d, rows.select(names), seen[d], state)
                if out is not None:
                    yield out
            if held is None:  # many lengths: no sums are carried on
                for d in list(state):
                    yield f(d, None, None, state)
        for d in list(state):
            yield f(d, None, None, state)

    return table.mapInArrow(lean(run), schema)


def _sums(batches):
    """(d, j, n, w, hi, lo): for each entry of the vectors the sums of its upper and lower 32 bits, weighted."""
    state = {}
    for batch in batches:
        of = batch.column("d").to_numpy()
        for d in np.unique(of).tolist():
            rows = batch.filter(pa.array(of == d))
            x, w = _unpack(rows.column("x").to_pylist(), d), rows.column("w").to_numpy()[:, None]
            hi, lo = state.get(d, (0, 0))[:2]
            n, total = state.get(d, (0, 0, 0, 0))[2:]
            state[d] = (hi + ((x >> 32) * w).sum(axis=0), lo + ((x & 0xFFFFFFFF) * w).sum(axis=0), n + len(x), total + int(w.sum()))
    for d, (hi, lo, n, total) in state.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(d, d, dtype=np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(np.full(d, total)), pa.array(hi), pa.array(lo)], ["d", "j", "n", "w", "hi", "lo"]
        )


def _parse_sums(model: bytes, d: int) -> tuple[int, int, list[int]]:
    n, total, *rest = np.frombuffer(model[: 8 * (2 + 2 * d)], dtype="<i8").tolist()
    return n, total, [(h << 32) + low for h, low in zip(rest[:d], rest[d:], strict=True)]


def _covariance(d, rows, model, state):
    """Adds up the centred products of the task's vectors of length ``d``; at the end (d, i, values): a row of the matrix each."""
    if rows is None:
        at = state.pop(d)
        return pa.RecordBatch.from_arrays([pa.array(np.full(d, d, dtype=np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(list(at["sum"]), pa.list_(pa.float64()))], ["d", "i", "values"])
    if d not in state:
        _, total, s = _parse_sums(model, d)
        state[d] = {"mean": np.array([v / total for v in s]), "sum": np.zeros((d, d))}
    y = _unpack(rows.column("x").to_pylist(), d) - state[d]["mean"]
    state[d]["sum"] += (y * rows.column("w").to_numpy()[:, None]).T @ y
    return None


def _eigen(components: int):
    """(d, model): the sums, then mean, trace, eigenvalues and unit eigenvectors of the first components."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                d = row["d"]
                _, total, s = _parse_sums(row["model"], d)
                v = np.zeros((d, d))
                for c in row["cells"]:
                    v[c["i"], c["j"]] = c["v"]
                v = (v + v.T) / (2 * total)
                values, vectors = np.linalg.eigh(v)
                k = min(components, d)
                values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k].T
                vectors = vectors * np.where(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)] < 0, -1, 1)[:, None]
                model = np.concatenate([[v_ / total for v_ in s], [np.trace(v)], values, vectors.ravel()]).astype("<f8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([row["model"] + model], pa.binary())], ["d", "model"])

    return run


def _parse_model(model: bytes, d: int, components: int):
    k = min(components, d)
    f = np.frombuffer(model[8 * (2 + 2 * d) :], dtype="<f8")
    return f[:d], float(f[d]), f[d + 1 : d + 1 + k], f[d + 1 + k :].reshape(k, d)


def _deviation(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 over the entries of each vector, exact; None where it does not fit a long."""
    most = n * int(np.abs(x.astype(object)).max(initial=0)) + max((abs(v) for v in s), default=0)
    if most * most * max(1, len(s)) < 1 << 63:
        y = n * x - np.array(s, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    y = x.astype(object) * n - np.array(s, dtype=object)
    return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]


def _whiten(components: int):
    def run(d, rows, model, state):
        n, total, s = _parse_sums(model, d)
        mean, trace, values, vectors = _parse_model(model, d, components)
        x = _unpack(rows.column("x").to_pylist(), d)
        live = values > LEAST_EIGENVALUE * max(trace, 0)
        z = (x - mean) @ vectors.T / np.sqrt(np.where(live, values, 1))
        z = [[v if ok else None for v, ok in zip(r, live.tolist(), strict=True)] for r in z.tolist()]
        share = [float(e / trace) if trace > 0 else None for e in values]
        return pa.RecordBatch.from_arrays(
            [
                rows.column("d"), rows.column("key"), rows.column("copies"), rows.column("w"), pa.array(np.full(len(x), n)), pa.array(_deviation(x, total, s), pa.int64()),
                pa.array(z, pa.list_(pa.float64())), pa.array([share] * len(x), pa.list_(pa.float64())),
            ],
            ["d", "key", "copies", "w", "n", "deviation", "z", "explained"],
        )

    return run


def whiten_embeddings(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: float = 256.0, weights: str = "one") -> DataFrame:
    """One row per vector and component: the id, ``component`` (from 1, by falling eigenvalue), ``n`` (distinct vectors of the fit),
    ``deviation`` (sum of (n x - S)^2 over the entries, exact, with S the sums of the fit), ``whitened``, ``explained`` (eigenvalue
    over trace), ``identity_error`` (largest absolute entry of the whitened fit's covariance minus the identity), ``copies`` (rows
    with the same x vector).

    ``weights``: ``"one"`` fits over each distinct x vector once, ``"count"`` over all rows (a vector weighs its copies; S is weighted, and
    ``deviation`` takes the sum of weights for n). Vectors of each length have a fit of their own.

    A distinct vector with more than a thousandth of the rows (fewer than 1000 can have) is joined back by a broadcast; the
    others by a shuffle of ids and SHA-256 keys. Partial sums leave a task as a row an entry, or a row of the matrix. Models are held by
    every task up to 32 MB, else joined to the rows.

    Defined edge cases: a vector that is null, empty, or holds a null or non-finite entry (or one beyond 2^63 once scaled) has no rows; a null id
    and repeated ids are rows of their own; a component without variance (an eigenvalue under 1e-12 of the trace, as with one distinct vector)
    has a null ``whitened`` and stands outside of ``identity_error``, and ``explained`` is null where the trace is 0; ``deviation``
    is null beyond a long; eigenvectors of equal eigenvalues are any orthonormal pair, the same for all rows; an empty table gives an empty
    result; other columns are not read."""
    if weights not in ("one", "count"):
        raise ValueError("weights is 'one' or 'count'")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInArrow(lean(_quantise(scale)), f"id {kind}, d int, key binary, x binary")
    distinct = rows.groupBy("d", "key").agg(F.any_value("x").alias("x"), F.count("*").alias("copies"))
    distinct = stage(distinct.withColumn("w", F.col("copies") if weights == "count" else F.lit(1).cast("long")))

    sums = distinct.select("d", "x", "w").mapInArrow(lean(_sums), "d int, j int, n long, w long, hi long, lo long")
    sums = sums.groupBy("d", "j").agg(*(F.sum(c).alias(c) for c in ("n", "w", "hi", "lo")))
    sums = sums.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("j", "n", "w", "hi", "lo"))).alias("s"))
    sums = stage(sums.mapInArrow(lean(_packed_sums), "d int, model binary"))

    cells = _by_length(distinct.select("d", "x", "w"), sums, _covariance, "d int, i int, values array<double>")
    cells = cells.select("d", "i", F.posexplode("values").alias("j", "v")).groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    cells = cells.groupBy("d").agg(F.collect_list(F.struct("i", "j", "v")).alias("cells"))
    models = stage(cells.join(sums, "d").mapInArrow(lean(_eigen(components)), "d int, model binary"))

    white = stage(_by_length(distinct, models, _whiten(components), "d int, key binary, copies long, w long, n long, deviation long, z array<double>, explained array<double>"))
    z = lambda i: F.get("z", F.lit(i))
    total = F.sum("w")
    off = [
        F.abs(F.sum(F.col("w") * z(i) * z(j)) / total - F.sum(F.col("w") * z(i)) / total * (F.sum(F.col("w") * z(j)) / total) - float(i == j))
        for i in range(components) for j in range(i, components)
    ]
    facts = white.groupBy("d").agg(total.alias("total"), *(o.alias(f"o{k}") for k, o in enumerate(off)))
    facts = stage(facts.select("d", "total", F.array_max(F.array(*(f"o{k}" for k in range(len(off))))).alias("identity_error")))
    n_lengths, n_rows = facts.count(), white.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    white = white.join(F.broadcast(facts) if n_lengths <= HELD_LENGTHS else facts, "d").drop("d", "w", "total")
    mine = rows.select("id", "key")
    hot = white.where(F.col("copies") > HOT_SHARE * n_rows)
    hit = mine.join(F.broadcast(hot), "key", "left")
    cold = white.where(F.col("copies") <= HOT_SHARE * n_rows)
    columns = ["id", "n", "deviation", "z", "explained", "identity_error", "copies"]
    done = hit.where("n is not null").select(*columns).unionAll(hit.where("n is null").select("id", "key").join(cold, "key").select(*columns))
    out = done.select("*", F.posexplode("z").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error", "copies"
    )


def _packed_sums(batches):
    """(d, model): n, sum of weights, upper and lower parts of the sums, as 64-bit integers."""
    for batch in batches:
        for row in batch.to_pylist():
            s = row["s"]
            if len(s) == row["d"]:
                model = np.array([s[0]["n"], s[0]["w"], *(r["hi"] for r in s), *(r["lo"] for r in s)], dtype="<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([row["d"]], pa.int32()), pa.array([model], pa.binary())], ["d", "model"])
