"""Periodic runs of words: maximal repetitions found by seeds on diagonals.

A run of smallest period q matches itself q words on over at least max(6 - q, 3 q) words. The lags are cut into
levels; on a level with windows of k words lie the lags q of a third of k to k (from 1 on the first level, k = 5), so every run of
the level overlaps itself by k words at least, and k >= q. Windows of k words are indexed by hash, and each is paired
with its next occurrence in the same document. That next occurrence is all that is needed: inside a run of
smallest period q a nearer one, d < q words on, would give the run a smaller period (Fine and Wilf, as k >= q). So a
document of n words has at most n pairs a level, and about log3(n) levels.

A pair of lag q is extended to both sides while words q apart are equal. Per lag a table tells how far the extensions
have come; pairs inside are skipped, so that a run is walked once. No seed has a multiple of the smallest period as its lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, windows_hash, word_chunks

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
FIRST_WINDOW = 5


def levels(n: int) -> Iterator[tuple[int, int, int]]:
    """(window, least lag, greatest lag) of each level that a document of ``n`` words needs."""
    low, k = 1, FIRST_WINDOW
    while low * LEAST_EXPONENT <= n and n >= LEAST_LENGTH:
        yield k, low, k
        low, k = k + 1, (LEAST_EXPONENT - 1) * (k + 1)


def seed_pairs(words: np.ndarray, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(lags, starts), sorted: windows of ``k`` words whose next occurrence is ``low`` to ``high`` words on."""
    h = windows_hash(words, k)
    order = np.argsort(h, kind="stable")
    lag = order[1:] - order[:-1]
    hit = (h[order[1:]] == h[order[:-1]]) & (lag >= low) & (lag <= high)
    lag, at = lag[hit], order[:-1][hit]
    by = np.lexsort((at, lag))
    return lag[by], at[by]


def _matched(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays, looked at in growing pieces."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        to = min(n, at + step)
        off = np.flatnonzero(a[at:to] != b[at:to])
        if len(off):
            return at + int(off[0])
        at, step = to, 2 * step
    return n


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of a document, by start, then period. ``words``: a hash a word."""
    found, n = [], len(words)
    for k, low, high in levels(n):
        lags, starts = seed_pairs(words, k, low, high)
        at = 0
        while at < len(lags):
            q = int(lags[at])
            end = int(np.searchsorted(lags, q, side="right"))
            while at < end:  # pairs of one lag from left to right; those before ``right`` are covered
                i = int(starts[at])
                right = i + _matched(words[i : n - q], words[i + q :])
                left = i - _matched(words[:i][::-1], words[q : i + q][::-1])
                length = right - left + q
                if length >= max(LEAST_LENGTH, LEAST_EXPONENT * q):
                    found.append((left, length, q))
                at += int(np.searchsorted(starts[at:end], max(right, i + 1)))
            at = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words at ``start`` to ``end`` of ``data``, joined by one space."""
    if not len(start):
        return b""
    sizes = end - start
    ends = np.cumsum(sizes + 1)
    out = np.full(int(ends[-1]) - 1, 0x20, dtype=np.uint8)
    to = np.repeat(ends - 1 - end, sizes)  # where a word's bytes go, less where they are
    at = np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
    out[at + to] = data[at]
    return out.tobytes()


RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))


def periodic_runs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words``, ``runs`` (array of start, length, period; by start, then period), ``n_dropped`` and ``collapsed`` (the
    words that no run contains after its first period, joined by one space).

    Words are runs other than white space, as they are; a run is a stretch of consecutive words with smallest period q
    and at least max(6, 4 q) words that cannot be made longer. Words are compared by 64-bit hashes. Documents are judged one
    by one, each whole in the task that reads it; none is shuffled.

    Defined edge cases: a null or empty text, or one without words, has no runs and collapses to an empty text; a text of any
    length is read whole (about 100 bytes a word of one document are held); runs may overlap (each drops its own words), and there are
    no ties: two runs of one start have different periods; repeated rows and null ids are judged each; an empty table gives an
    empty result; all columns are returned, but one named like a new one is replaced by it."""
    new = ["n_words", "runs", "n_dropped", "collapsed"]
    kept = {f"__c{i}": c for i, c in enumerate(c for c in df.columns if c not in new)}
    rows = df.select(*(F.col(f"`{c}`").alias(k) for k, c in kept.items()), F.col(f"`{text_col}`").cast("string").alias("__text"))
    out = T.StructType([
        *rows.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("n_dropped", T.LongType()), T.StructField("collapsed", T.StringType()),
    ])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for first, words in word_chunks(batch.column("__text"), lower=False):
                size, runs, dropped, texts = [], [], [], []
                for i in range(len(words)):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    mine = runs_of(words.hashes[a:b])
                    gone = np.zeros(b - a + 1, dtype=np.int64)
                    for start, length, period in mine:
                        gone[start + period] += 1
                        gone[start + length] -= 1
                    keep = np.cumsum(gone[:-1]) == 0
                    size.append(b - a)
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in mine])
                    dropped.append(b - a - int(keep.sum()))
                    texts.append(joined(words.data, words.start[a:b][keep], words.end[a:b][keep]))
                part = batch.slice(first, len(words))
                made = [pa.array(size, pa.int64()), pa.array(runs, kind), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *made], [*kept, *new])

    done = rows.mapInArrow(lean(run), out)
    return done.select(*(F.col(k).alias(c) for k, c in kept.items()), *new)
