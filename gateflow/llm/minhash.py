"""MinHash near-dedup by min-max hashing.

Every permutation gives two signature values, the least and the greatest image of the shingle
set, so 108 evaluations make a signature of 216 values (Ji et al., "Min-Max Hash", 2013: unbiased, and
of lower variance than 216 minima). Bands of 6 values (both ends of 3 permutations) find a pair of
similarity 0.80 in at least one of 36 bands but for 2 pairs in 100,000, one of 0.85 but for 4 in 10^8.

What follows does without pairs inside a group:

1. Documents with equal shingle sets are one class; only its least document goes on.
2. Star pass: in each band bucket every member is paired with the bucket's least member only.
3. Confirmed links make components. A bucket whose members are all in one component is settled.
   The members of the others are matched by the rarest shingles of their sets: a pair over the threshold shares one among the first
   (1 - t) n + 1 of either, and the smaller set of the two has it among its first (1 - 2 t / (1 + t)) n (prefix and
   position filters, as in set-similarity joins). Rarity comes from a table of counts of fixed size; any order is right, a good one
   leaves few pairs. A group of documents that are alike but not linked has its common shingles behind all prefixes, so it gives
   no pairs, however large it is.

Every link is confirmed on the full shingle sets of both texts. A link between documents already
in one component cannot change the result and is not looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keep_batches_small, lean, mix64, seeds, stage, windows_hash, word_chunks

PERMUTATIONS, BANDS, BAND_PERMS = 108, 36, 3
SIGMA = 6.0
#: Members of a shingle's bucket that one task pairs with its members of short prefixes.
RIGHT_BLOCK = 2048
#: Ids (16 bytes each) up to which a table of them is broadcast.
HELD_IDS = 500_000
#: Counters of the table of rarities (a byte each where it is used), dealt to tasks in so many parts.
COUNTERS, COUNTER_PARTS = 1 << 20, 256


def shingle_sets(texts: pa.Array, width: int):
    """Sorted distinct shingle hashes (uint64) of each text, in order. A text of fewer words than
    ``width`` has its whole sequence as its one shingle; one without words has none."""
    for _, words in word_chunks(texts, lower=True):
        h = windows_hash(words.hashes, width)
        for i in range(len(words)):
            a, b = words.first[i], words.first[i + 1]
            if b - a >= width:
                yield np.unique(h[a : b - width + 1])
            elif b > a:
                yield windows_hash(words.hashes[a:b], int(b - a), 2)
            else:
                yield np.zeros(0, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest image (rows) under each permutation (columns) of 32-bit shingle hashes."""
    mul = (seeds(PERMUTATIONS, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (seeds(PERMUTATIONS, 22) >> np.uint64(32)).astype(np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32), np.zeros(PERMUTATIONS, dtype=np.uint32)
    for at in range(0, len(x), 4096):
        y = mul[:, None] * x[None, at : at + 4096] + add[:, None]
        low, high = np.minimum(low, y.min(axis=1)), np.maximum(high, y.max(axis=1))
    return np.stack([low, high])


def _band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(2, BANDS, BAND_PERMS).transpose(1, 0, 2).reshape(BANDS, -1).astype(np.uint64)
    key = seeds(BANDS, 23)
    for k in range(parts.shape[1]):
        key = mix64(key ^ (parts[:, k] + np.uint64(0x9E3779B97F4A7C15)))
    return key.view(np.int64)


def _short(sig: np.ndarray) -> np.ndarray:
    """16 mixed bits of each signature value: enough to estimate, a quarter of the bytes."""
    return ((sig.ravel() * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _profile(width: int):
    def run(batches):
        for batch in batches:
            n, f1, f2, bands, sigs = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), width):
                n.append(len(s))
                if len(s):
                    sig = signature(s)
                    f1.append(int(np.bitwise_xor.reduce(mix64(s)).view(np.int64)))
                    f2.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    bands.append(_band_keys(sig))
                    sigs.append(_short(sig).tobytes())
                else:
                    f1.append(None), f2.append(None), bands.append(None), sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["doc_id", "n", "f1", "f2", "bands", "sig"],
            )

    return run


def _estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _slack(percent: int) -> float:
    t = percent / 100
    return t - SIGMA * (t * (1 - t) / (2 * PERMUTATIONS)) ** 0.5


def _near_by_signature(percent: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            keep = _estimated(a, b) >= _slack(percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _confirm(width: int, percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                hit = [
                    100 * (k := len(np.intersect1d(x, y, assume_unique=True))) >= percent * (len(x) + len(y) - k)
                    for x, y in zip(shingle_sets(part.column("text_a"), width), shingle_sets(part.column("text_b"), width), strict=True)
                ]
                yield part.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return run


def _full_sets(width: int):
    """(doc_id, comp, n, set): the shingle hashes of each text."""

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("comp"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "comp", "n", "set"]
            )

    return run


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)


def _count_shingles(batches):
    """(part, counts): in how many sets of the task each counter's shingles are."""
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for s in batch.column("set").to_pylist():
            np.add.at(counts, _slot(np.frombuffer(s, dtype=np.uint64)), 1)
    if counts.any():
        parts = counts.reshape(COUNTER_PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNTER_PARTS, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])


def _sum_counts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of a part over all tasks, in steps of a quarter of their binary logarithm."""
    total = 0
    for batch in batches:
        for c in batch.column("counts").to_pylist():
            total = total + np.frombuffer(c, dtype=np.int64)
    rarity = np.minimum(255, np.ceil(4 * np.log2(total + 1.0))).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([rarity.tobytes()], pa.binary())], ["part", "rarity"])


def _prefixes(held, percent: int):
    """(doc_id, comp, n, token, pos): the rarest shingles of each set, enough that a linked one shares one of them."""

    def run(batches):
        rarity = np.frombuffer(held.value, dtype=np.uint8)
        for batch in batches:
            at, tokens, places = [], [], []
            for i, s in enumerate(batch.column("set").to_pylist()):
                s = np.frombuffer(s, dtype=np.uint64)
                n = len(s) + (-percent * len(s)) // 100 + 1  # n less the least overlap, and one
                first = np.lexsort((s, rarity[_slot(s)]))[:n]
                at.append(np.full(n, i)), tokens.append(s[first].view(np.int64)), places.append(np.arange(n))
            if at:
                rows = batch.select(["doc_id", "comp", "n"]).take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(tokens)), pa.array(np.concatenate(places))], ["doc_id", "comp", "n", "token", "pos"])

    return run


def pairs_by_prefix(needed: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of documents ``needed`` (doc_id, text, comp) of different components that can be links: all that are, and few more."""
    spark = needed.sparkSession
    sets = stage(needed.mapInArrow(lean(_full_sets(width)), "doc_id long, comp long, n long, set binary"))
    counts = sets.select("set").mapInArrow(lean(_count_shingles), "part int, counts binary").groupBy("part").applyInArrow(_sum_counts, "part int, rarity binary")
    table = bytearray(COUNTERS)  # of fixed size: a byte a counter
    for r in counts.toLocalIterator():
        size = COUNTERS // COUNTER_PARTS
        table[r.part * size : (r.part + 1) * size] = r.rarity
    held = spark.sparkContext.broadcast(bytes(table))
    rows = sets.mapInArrow(lean(_prefixes(held, percent)), "doc_id long, comp long, n long, token long, pos long")
    rows = stage(rows.withColumn("short", F.expr(f"{100 + percent} * (n - pos) >= {2 * percent} * n")))
    open_ = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.count_if("short").alias("shorts")).where("lo < hi and shorts > 0")
    open_ = open_.select("token", F.ceil(F.col("size") / RIGHT_BLOCK).cast("int").alias("parts"))
    rows = rows.join(open_, "token")
    left = rows.where("short").select("token", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("doc_id").alias("x"), F.col("comp").alias("x_comp"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"))
    right = rows.select("token", F.expr("cast(pmod(xxhash64(doc_id), parts) as int)").alias("part"), F.col("doc_id").alias("y"), F.col("comp").alias("y_comp"), F.col("n").alias("y_n"), F.col("pos").alias("y_pos"))
    # the smaller set is on the left; what is left of both behind the common shingle must be able to make a link
    fits = f"x_comp <> y_comp and (x_n < y_n or x_n = y_n and x < y) and 100 * x_n >= {percent} * y_n and {100 + percent} * least(x_n - x_pos, y_n - y_pos) >= {percent} * (x_n + y_n)"
    return left.join(right, ["token", "part"]).where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def minhash_near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by 100 * |A & B| >= ``percent`` * |A | B| on sets of ``width``-word shingles.

    Words are runs other than white space, A-Z lower-cased. Returns one row per document: ``doc_id``,
    ``n_shingles``, ``component_id`` (least id reachable) and ``kept`` (id = component_id).

    Defined edge cases: a null text or one without words has no shingles, links with nothing and is
    kept; fewer words than ``width`` are one shingle; a null id links with nothing and is kept; ids
    should be unique, rows that repeat an id have one set each but share their component; an empty
    table gives an empty result; other columns are ignored."""
    keep_batches_small(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prof = stage(docs.mapInArrow(lean(_profile(width)), "doc_id long, n long, f1 long, f2 long, bands array<long>, sig binary"))
    full = prof.where("n > 0 and doc_id is not null")
    key = ["n", "f1", "f2"]
    classes = stage(full.groupBy(*key).agg(F.min(F.struct("doc_id", "bands", "sig")).alias("r")).select(*key, "r.*"))
    member = classes.select("doc_id", "n", F.posexplode("bands").alias("band", "bucket"))
    heads = member.groupBy("bucket").agg(F.min(F.struct("doc_id", "n")).alias("head"), F.count("*").alias("size")).where("size > 1").select("bucket", F.col("head.doc_id").alias("a"), F.col("head.n").alias("n_a"))
    star = member.join(heads, "bucket").where(f"doc_id <> a and 100 * least(n, n_a) >= {percent} * greatest(n, n_a)").select("a", F.col("doc_id").alias("b")).distinct()
    sigs = classes.select("doc_id", "sig")
    near = lambda c: sigs.select(F.col("doc_id").alias(c), F.col("sig").alias(f"sig_{c}"))
    alike = lambda pairs: pairs.join(near("a"), "a").join(near("b"), "b").mapInArrow(lean(_near_by_signature(percent)), "a long, b long")
    star = stage(alike(star))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def few(ids: DataFrame) -> DataFrame:
        """Up to ``HELD_IDS`` ids go to all tasks, so that the texts of the others are not shuffled; beyond that they are joined by a shuffle."""
        ids = stage(ids)
        return F.broadcast(ids) if ids.count() <= HELD_IDS else ids

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs that are links by their full sets. The texts of their documents alone are dealt out, once, for both sides."""
        ids = few(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct())
        held = stage(docs.join(ids, "doc_id", "left_semi").repartition(buckets, "doc_id"), by="doc_id")
        texts = lambda c: held.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
        return stage(pairs.join(texts("a"), "a").join(texts("b"), "b").mapInArrow(lean(_confirm(width, percent)), "a long, b long"))

    comp = components(confirm(star))

    # the members of buckets that span components
    held = member.select("doc_id", "bucket").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    spans = held.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    ids = stage(held.join(spans, "bucket", "left_semi").select("doc_id", "comp").distinct())
    needed = docs.join(few(ids), "doc_id")
    more = confirm(stage(alike(pairs_by_prefix(needed, width, percent))))
    # their links join whole components
    of = lambda c: ids.select(F.col("doc_id").alias(c), F.col("comp").alias(f"comp_{c}"))
    over = components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    over = over.select(F.col("node").alias("first"), F.col("component").alias("last"))
    comp = classes.select(F.col("doc_id").alias("rep")).join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("first"))
    comp = comp.join(over, "first", "left").select("rep", F.coalesce("last", "first").alias("component"))
    roots = classes.select(*key, F.col("doc_id").alias("rep")).join(comp, "rep").select(*key, F.col("component").alias("component_id"))
    out = prof.select("doc_id", *key).join(roots, key, "left")
    comp_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp_id.alias("component_id"), F.coalesce(comp_id == F.col("doc_id"), F.lit(True)).alias("kept"))
