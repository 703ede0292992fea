"""Substring dedup with difference-cover anchors.

A passage counts as repeated if ``window`` consecutive words of a document also start anywhere
else. Hashing every window of the corpus is avoided: positions modulo 21 in {0, 1, 4, 14, 16} are
a difference cover, every difference modulo 21 is one of two members. So for any two equal
windows there is a shift below 21 that brings both onto cover positions, and with anchors of
``window`` - 20 words hashed at cover positions alone (24 % of them) equal windows share an anchor.

1. Documents are dealt to blocks. A block hashes its anchors and sends each distinct one
   once, with whether it is there twice.
2. Anchors that occur twice or more go back to their blocks.
3. There each is extended to the windows around it, and those windows alone are hashed in 128 bits, sent
   and counted in the same way: exact, by the whole window.
4. Blocks drop the words that windows found twice cover.

A hot passage is one row for each block, however many documents hold it. The texts are dealt to
blocks once; the three passes read that one exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, keep_batches_small, lean, text_chunks, windows_hash

PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Bytes of text in a block, about.
BLOCK_BYTES = 8 << 20


def _cover() -> np.ndarray:
    out = np.zeros(PERIOD, dtype=bool)
    out[list(COVER)] = True
    return out


def _places(words: Words):
    """For each word: its position in its document, and the words from it to the document's end."""
    n = len(words.hashes)
    first, count = words.first[:-1], np.diff(words.first)
    pos = np.arange(n) - np.repeat(first, count)
    return pos, np.repeat(count, count) - pos


def _anchors(words: Words, length: int):
    """(starts, hashes) of the anchors at cover positions."""
    pos, left = _places(words)
    h = windows_hash(words.hashes, length, 3)
    at = np.flatnonzero(_cover()[pos % PERIOD] & (left >= length)) if len(h) else np.zeros(0, dtype=np.int64)
    return at, h[at].view(np.int64)


def _once(keys: np.ndarray):
    """Distinct keys and whether each is there twice or more."""
    keys, n = np.unique(keys, return_counts=True)
    return keys, np.minimum(n, 2).astype(np.int64)


def _send_anchors(length: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        found = [_anchors(Words(d, o, False), length)[1] for _, d, o in text_chunks(table.column("text"))]
        keys, n = _once(np.concatenate(found))
        return pa.table({"h": keys, "block": np.full(len(keys), block, dtype=np.int64), "n": n})

    return lean(run)


def _windows_around(words: Words, known: np.ndarray, length: int, window: int):
    """Starts of the windows that hold a known anchor within their first 21 positions."""
    pos, left = _places(words)
    at, h = _anchors(words, length)
    at = at[np.isin(h, known)]
    near = np.zeros(len(pos) + 1, dtype=np.int32)
    np.add.at(near, np.maximum(at - np.minimum(pos[at], PERIOD - 1), 0), 1)
    np.add.at(near, at + 1, -1)
    return np.flatnonzero((np.cumsum(near[:-1]) > 0) & (left >= window)), pos


_PAIR = np.dtype([("x", np.int64), ("y", np.int64)])


def _pair_hash(words: Words, starts: np.ndarray, window: int) -> np.ndarray:
    out = np.zeros(len(starts), dtype=_PAIR)
    if len(starts):
        for c, k in (("x", 4), ("y", 5)):
            out[c] = windows_hash(words.hashes, window, k)[starts].view(np.int64)
    return out


def _send_windows(length: int, window: int):
    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        found = []
        if texts.num_rows and known.num_rows:
            block, h = texts.column("block")[0].as_py(), np.sort(known.column("h").to_numpy())
            for _, d, o in text_chunks(texts.column("text")):
                words = Words(d, o, False)
                found.append(_pair_hash(words, _windows_around(words, h, length, window)[0], window))
        if not found:
            return pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        keys, n = _once(np.concatenate(found))
        return pa.table({"x": np.ascontiguousarray(keys["x"]), "y": np.ascontiguousarray(keys["y"]), "block": np.full(len(keys), block, dtype=np.int64), "n": n})

    return lean(run)


def _remove(length: int, window: int, untouched: bool, others: list[str]):
    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        known = np.sort(known.column("x").to_numpy())
        n_words, n_removed, kept = [], [], []
        for _, d, o in text_chunks(texts.column("text")):
            words = Words(d, o, False)
            gone = np.zeros(len(words.hashes) + 1, dtype=np.int32)
            if len(known) and len(words.hashes) >= window:
                h = windows_hash(words.hashes, window, 4).view(np.int64)
                starts = np.flatnonzero(np.isin(h, known) & (_places(words)[1][: len(h)] >= window))
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + window, -1)
            gone = np.cumsum(gone[:-1]) > 0
            raw, said = words.data.tobytes(), []
            for i in range(len(words)):
                a, b = words.first[i], words.first[i + 1]
                stay = np.flatnonzero(~gone[a:b]) + a
                n_words.append(int(b - a))
                n_removed.append(int(b - a - len(stay)))
                if untouched and len(stay) == b - a:
                    said.append(raw[words.rows[i] : words.rows[i + 1]])
                else:
                    said.append(b" ".join([raw[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]))
            kept.append(pa.array(said, pa.binary()).cast(pa.string()))
        out = texts.select(others).append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64()))
        return out.append_column("kept_text", pa.chunked_array(kept, pa.string()))

    return lean(run)


def _repeated(sent: DataFrame, keys: list[str]) -> DataFrame:
    """The (keys, block) rows whose keys occur twice or more over all blocks.

    A key's rows are neighbours once sorted, so each is told by itself and the two beside it: no count over all of them, and
    a key that every block has is read past like any other."""

    def run(batches):
        held = None  # the last row, whose successor is not known yet
        names = [*keys, "block"]
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held.select(rows.column_names), rows])
                rows, before = rows.combine_chunks(), held.column("same")[0].as_py()
            else:
                before = False
            n = rows.num_rows
            columns = [rows.column(k).to_numpy() for k in keys]
            same = np.ones(max(n - 1, 0), dtype=bool)  # row i + 1 has the keys of row i
            for c in columns:
                same &= c[1:] == c[:-1]
            back = np.concatenate([[before], same])[:n]
            found = (rows.column("n").to_numpy() > 1) | back
            found[: n - 1] |= same
            if n:
                yield from rows.select(names).slice(0, n - 1).filter(pa.array(found[: n - 1])).combine_chunks().to_batches()
                held = rows.slice(n - 1, 1).append_column("same", pa.array([bool(back[-1])]))
        if held is not None and (held.column("same")[0].as_py() or held.column("n")[0].as_py() > 1):
            yield from held.select(names).combine_chunks().to_batches()

    fields = ", ".join(f"{k} long" for k in [*keys, "block"])
    return sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), fields)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, block_bytes: int = BLOCK_BYTES, untouched: bool = False) -> DataFrame:
    """Remove every word that lies in a run of ``window`` words that also starts anywhere else.

    Words are runs other than white space, unchanged. All copies go, the first too. Returns the
    columns of ``df`` without the text, and ``n_words``, ``n_removed`` and ``kept_text`` (kept words
    joined by one space; with ``untouched`` a text that loses no word stays as it is).

    Rows are dealt to blocks by their place in ``df``, so that a row repeated any number of times is
    spread over all blocks; ``df`` should be a table, which gives its rows in the same order when it is read again.

    Defined edge cases: a null text is empty; texts shorter than the window stay; a window may overlap
    its own copy; a text longer than a block is a block of its own; rows with one id, and repeated rows, are
    texts of their own and remove each other; a null id is an id; an empty table gives an empty result; other columns pass
    through, but one named like a new column is replaced by it."""
    length = window - PERIOD + 1
    if length < 2:
        raise ValueError(f"window must be at least {PERIOD + 1}")
    keep_batches_small(df.sparkSession)
    total = df.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))), F.lit(0))).first()[0]
    blocks = max(1, int(total // block_bytes) + 1)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    new = ["n_words", "n_removed", "kept_text"]
    others = {f"c{i}": c for i, c in enumerate(c for c in df.columns if c not in (text_col, *new))}
    place = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.monotonically_increasing_id())
    dealt = df.select(*(F.col(f"`{c}`").alias(k) for k, c in others.items()), text.alias("text"), F.pmod(place, F.lit(blocks)).cast("long").alias("block"))
    texts = dealt.repartition("block")  # all passes take all columns, so that they read one exchange
    anchors = texts.groupBy("block").applyInArrow(_send_anchors(length), "h long, block long, n long")
    seen = _repeated(anchors, ["h"])
    windows = texts.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(_send_windows(length, window), "x long, y long, block long, n long")
    twice = _repeated(windows, ["x", "y"]).select("x", "block")  # half of the hash is enough inside a block
    out = T.StructType([*dealt.schema.fields[:-2], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    done = texts.groupBy("block").cogroup(twice.groupBy("block")).applyInArrow(_remove(length, window, untouched, list(others)), out)
    return done.select(*(F.col(k).alias(c) for k, c in others.items()), *new)
