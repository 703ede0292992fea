"""The metric index against brute force."""

import numpy as np
import pytest

from gateflow.operators.nearest import choose_pivots, match_embeddings
from gateflow.plans import registry


def brute(probes, gallery, k):
    out = {}
    good = {i: np.array(v, dtype=float) / np.linalg.norm(v) for i, v in gallery if v and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v))}
    for i, v in probes:
        if i in good or (v and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v))):
            u = np.array(v, dtype=float) / np.linalg.norm(v)
            found = sorted((-round(float(u @ g), 12), j) for j, g in good.items() if j != i and len(g) == len(u))[:k]
            if found:
                out[i] = [-c for c, _ in found]
    return out


def got_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, []).append(round(r.cosine, 12))
    return {i: sorted(c, reverse=True) for i, c in out.items()}


@pytest.mark.parametrize("k", [1, 4])
def test_clustered_vectors(spark, k):
    """Equal to brute force, with under a fifth of the pairs compared."""
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 6000)] + 0.05 * rng.normal(size=(6000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    g = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    p, pairs = g.where("vec_id % 50 = 0"), []
    got = got_of(match_embeddings(p, g, k, block_rows=50, told=pairs.append))
    want = brute([r for r in rows if r[0] % 50 == 0], rows, k)
    assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-11) for i in want)
    assert pairs[0] < 120 * 6000 / 5


def test_odd_vectors(spark):
    """Copies, ties, several lengths, vectors without direction, and fewer others than asked for."""
    nan = float("nan")
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(50, [0.0, 2.0]), (51, [0.0, -1.0]), (60, None), (61, []), (62, [0.0, 0.0]), (63, [nan, 1.0]), (64, [1e300, 1e300]), (70, [1.0]), (80, [1.0, 0.0, 0.0]), (81, [0.9, 0.1, 0.0])]
    g = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = match_embeddings(g, g, 3, block_rows=4).collect()
    got = {}
    for r in found:
        got.setdefault(r.vec_id, []).append((round(r.cosine, 9), r.match_id))
    assert sorted(got[5]) == [(1.0, 0), (1.0, 1), (1.0, 2)] and sorted(got[0]) == [(1.0, 1), (1.0, 2), (1.0, 3)]
    assert [j for _, j in got[80]] == [81] and not set(got) & {60, 61, 62, 63, 70} and (round(0.5**0.5, 9), 0) in got[64]
    assert match_embeddings(g.limit(0), g).count() == 0 and match_embeddings(g, g.limit(0)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (50, [0.1, 0.9])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.match_id for r in match_embeddings(one.where("vec_id % 50 = 0"), one).collect()} == {0: 1, 50: 2}


def test_pivots_lie_apart():
    x = np.eye(5)[[0, 0, 1, 2, 2]]
    assert len(choose_pivots(x, 10)) == 3 and len(choose_pivots(x, 2)) == 2


def test_the_whole_table_is_searched(spark):
    found = registry.queries()["jn16_match_embeddings_all"](spark, "/root/testdata/sf0.001").collect()
    assert any(r.match_id % 10 for r in found) and all(r.match_id != r.vec_id for r in found)
