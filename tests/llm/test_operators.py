"""The training-data operators against brute force, on small fixtures with their edge cases."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gateflow.llm import bpe, chat, common, embeddings, langid, minhash, mixing, quality, queries, sharding, substrings, urls

from ..oracle import same

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - {"op7_substring_dedup"}))
def test_same_as_sql(spark, name):
    same(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def words(text, lower=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def classes(nodes, links):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        low[b] = a
    return {n: find(n) for n in nodes}


# --- components --------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes({x for e in edges for x in e}, edges)
    assert all(got[n] == c for n, c in want.items() if n in got)
    assert set(want) - set(got) <= {7} or all(want[n] == n for n in set(want) - set(got))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 embeddings ------------------------------------------------------------------------------


def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24)).astype(np.float32)
    near = base[rng.integers(0, 40, 200)] + rng.normal(scale=0.25, size=(200, 24)).astype(np.float32)
    x = np.concatenate([base, near, near[:30], near[:5] * 3]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 3) if i % 17 else None, "x") for i, v in enumerate(x)]
    rows += [(900, None, 1, ""), (901, [0.0] * 24, 1, ""), (902, [float("nan")] * 24, 1, ""), (903, [float("inf")] + [1.0] * 23, 1, ""), (904, [None] + [1.0] * 23, 1, ""), (905, [1.0] * 12, 1, ""), (906, [2.0] * 12, 1, ""), (907, [], 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, tile string")
    ok = [(i, np.array(v, dtype=np.float64), lab) for i, v, lab, _ in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(i, j) for i, a, p in ok for j, b, q in ok if i < j and p == q and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93]
    n = Counter(k for pair in links for k in pair)
    comp = classes([r[0] for r in rows], links)
    for tile in (16, 1024):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.embedding_near_dedup(df, tile_rows=tile).collect()}
        assert got == {i: (n[i], comp[i], comp[i] == i) for i in comp}
    assert embeddings.embedding_near_dedup(df.limit(0)).count() == 0


def test_embedding_axes(spark):
    """Long vectors get their axes by subspace iteration, short ones from all outer products; few axes change no result."""
    rng = np.random.default_rng(5)
    low = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 40)) + 0.01 * rng.normal(size=(300, 40))
    rows = [(i, v.tolist(), 40) for i, v in enumerate(low)] + [(900 + i, v.tolist(), 3) for i, v in enumerate(rng.normal(size=(50, 3)))]
    df = spark.createDataFrame(rows, "id long, emb array<double>, dim int")
    exact, few = embeddings.pca_bases(df), embeddings.pca_bases(df, axes=6)
    assert exact[40].shape == (40, 40) and few[40].shape == (40, 6) and few[3].shape == (3, 3)
    assert np.allclose(np.abs(np.diag(exact[40][:, :4].T @ few[40][:, :4])), 1, atol=1e-6)
    assert np.allclose(few[40].T @ few[40], np.eye(6), atol=1e-9)
    want = {(i, j) for i in range(300) for j in range(i) if low[i] @ low[j] / np.linalg.norm(low[i]) / np.linalg.norm(low[j]) >= 0.93}
    for basis in (exact[40], few[40], few[40][:, :1]):
        i, j = embeddings.near_pairs(low, low, basis, 0.93, True)
        assert {(b, a) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [1.0, 0.02], 0), (4, [1.0, 0.02], 0), (5, [-1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embeddings.embedding_near_dedup(df, threshold=0.93).collect())
    assert got == Counter([(1, 3, 1), (1, 1, 1), (2, 3, 1), (3, 1, 1), (4, 3, 1), (4, 3, 1), (5, 0, 5)])
    one = [(9, [1.0, 0.0], 0), (9, [0.0, 1.0], 0), (2, [0.01, 1.0], 0)]
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embeddings.embedding_near_dedup(spark.createDataFrame(one, df.schema), threshold=0.93).collect())
    assert got == Counter([(9, 0, 9), (9, 1, 2), (2, 1, 2)])


# --- 2 urls ------------------------------------------------------------------------------------

URLS = ["http://a.Example.org/es/x", "http://example.org/en/12", "http://example.org/en/2", "http://example.orgx/es/", "x", None, "", "http://org/", "http://org", "https://u.com/fr/a?b#c", "https://u.com/de/", "https://u.com/frx", "a://b.net/x://c.org/", "http://h.org?u=://z.com/fr/", "http://EXAMPLE.org/es/", "http://badexample.org/es/q", "://", "http:///es/"]


def plain_url(url, rules):
    m = re.search(r"://([^/?#]*)(/[^?#]*)?", url or "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = (m[2] or "") if m else ""
    fit = [r for r in rules if host and ("." + host).endswith("." + r[0]) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (r[0].count("."), len(r[1]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_urls(spark):
    rules = [*queries.URL_RULES, ("example.org", "/es/", "allow"), ("net", "", "block")]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, host string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("x.org", None, "block")], "host string, path string, action string")
    for most in (urls.MAX_TRIE_RULES, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(df, table, max_trie_rules=most).collect()}
        assert got == {i: plain_url(u, rules) for i, u in enumerate(URLS + URLS[:2])}
    assert urls.url_filter(df.limit(0), table).count() == 0


# --- 3 BPE -------------------------------------------------------------------------------------

TEXTS = [None, "", " \n", "Hello WORLD's <|endoftext|> Éaux 12 résumé!!", "J̌İΣς ﬁ ẞ", "<|startoftext|><|endoftext|>x<|endof", "a\0b", "'s's'll 12²٣", "日本語 текст", "w " * 5000]


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(5)
    alphabet = list("aAéÉİΣς'sS tT\n   12٣<|x") + ["<|endoftext|>", "'ll", "ǰ", "J̌"]
    texts = TEXTS + TEXTS[3:5] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    rows = bpe.bpe_encode_decode(df, queries.tokenizer_path()).withColumn("list", bpe.unpack_ids("ids")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids)}I", r.ids)) == ids == r.list and r.n_tokens == len(ids)
        assert r.decoded == lib.decode(ids, skip_special_tokens=False) and r.word == "b"
    table = spark.createDataFrame([(r.doc_id, r.list) for r in rows], "doc_id long, ids array<int>")
    back = {r.doc_id: r.decoded for r in bpe.bpe_decode(table, bpe.pieces_table(spark, queries.tokenizer_path()), "doc_id").collect()}
    assert back == {r.doc_id: r.decoded for r in rows}
    assert bpe.bpe_encode_decode(df.limit(0), queries.tokenizer_path()).count() == 0


def test_bpe_blocks_and_joins(spark, monkeypatch):
    """A vocabulary joined by a shuffle gives the same, and columns of any name come through."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(6)
    texts = [" ".join(chr(97 + rng.randrange(26)) * rng.randrange(9) for _ in range(rng.randrange(30))) for _ in range(400)] + TEXTS
    df = spark.createDataFrame([(i, t, "b", 1, None) for i, t in enumerate(texts)], "doc_id long, text string, `a.word` string, ids int, n long").repartition(3)
    for most in (1 << 20, 0):
        monkeypatch.setattr(bpe, "MAX_BROADCAST_PIECES", most)
        rows = bpe.bpe_encode_decode(df, queries.tokenizer_path()).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert list(struct.unpack(f"<{len(ids)}I", r.ids)) == ids and r.decoded == lib.decode(ids, skip_special_tokens=False) and r["a.word"] == "b"


def test_bpe_task_steps(monkeypatch):
    """The steps inside the tasks on their own, with blocks, groups, batches and sendings of a few rows."""
    import pyarrow as pa
    import pyspark
    from tokenizers import Tokenizer

    monkeypatch.setattr(pyspark, "TaskContext", type("T", (), {"get": classmethod(lambda cls: cls()), "partitionId": lambda self: 2}))
    for k, v in {"MAX_BLOCK_WORDS": 40, "GROUP": 5, "GROUP_ITEMS": 60, "SENT": 30}.items():
        monkeypatch.setattr(bpe, k, v)
    path, rng = queries.tokenizer_path(), random.Random(7)
    texts = [" ".join(chr(97 + rng.randrange(26)) + chr(97 + rng.randrange(9)) for _ in range(rng.randrange(25))) for _ in range(200)] + [None, "", "Hello, WORLD"]
    schema = pa.schema([("k", pa.int64()), ("__block", pa.int64()), ("__num", pa.int32()), ("__word", pa.string()), ("__group", pa.int32()), ("__place", pa.int32()), ("__n", pa.int32()), ("__nums", pa.binary()), ("__items", pa.int64())])
    table = pa.table({"k": range(len(texts)), "__text": texts})
    split = pa.Table.from_batches(list(bpe._split(path, ["k"], schema)(table.to_batches(max_chunksize=33))), schema)
    assert len(set(split.column("__block").to_pylist())) > 5
    words = split.filter(pa.compute.is_valid(split.column("__num"))).select(["__block", "__num", "__word"]).sort_by("__word").combine_chunks()
    runs = pa.Table.from_batches(list(bpe._encode_runs(path)(words.to_batches(max_chunksize=11))))
    pieces = {v: k for k, v in Tokenizer.from_file(path).get_vocab().items()}
    rows = [(r["__run"], i, pieces[i], r["__blocks"] if p == 0 else None, r["__nums"] if p == 0 else None) for r in runs.to_pylist() for p, i in enumerate(r["__ids"])]
    long = pa.table({"__run": [r[0] for r in rows], "id": pa.array([r[1] for r in rows], pa.int32()), "piece": [r[2] for r in rows], "__blocks": pa.array([r[3] for r in rows], pa.list_(pa.int64())), "__nums": pa.array([r[4] for r in rows], pa.list_(pa.int32()))})
    brought = defaultdict(list)
    for r in pa.Table.from_batches(list(bpe._send(iter(long.to_batches(max_chunksize=13))))).to_pylist():
        brought[r["__of"]].append(r["__words"])
    held = split.filter(pa.compute.is_valid(split.column("__group"))).sort_by([("__block", "ascending"), ("__group", "ascending"), ("__place", "ascending")])
    heads = [g == 0 and p == 0 for g, p in zip(held.column("__group").to_pylist(), held.column("__place").to_pylist(), strict=True)]
    own = [brought[b] if h else None for h, b in zip(heads, held.column("__block").to_pylist(), strict=True)]
    held = held.append_column("__words", pa.array(own, pa.list_(bpe._WORDS))).append_column("__size", pa.array([sum(w["n"] for w in x) if x is not None else None for x in own], pa.int64()))
    out = pa.Table.from_batches(list(bpe._assemble(["k"])(held.combine_chunks().to_batches(max_chunksize=3)))).to_pylist()
    lib = Tokenizer.from_file(path)
    assert sorted(r["k"] for r in out) == list(range(len(texts)))
    for r in out:
        ids = lib.encode(texts[r["k"]] or "", add_special_tokens=False).ids
        assert r["ids"] == struct.pack(f"<{len(ids)}I", *ids) and r["decoded"] == lib.decode(ids) and r["n_tokens"] == len(ids)


def test_splitter_on_every_character():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    lib, split, encode = Tokenizer.from_file(path), bpe.Splitter(path), bpe.word_encoder(path)
    texts = [f"a{chr(c)}b{chr(c)}1" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    parts = [split.words(t) for t in texts]
    known = sorted({w for p in parts for w in p})
    ids = dict(zip(known, encode(known), strict=True))
    for p, e in zip(parts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [i for w in p for i in ids[w]] == e.ids


# --- 4 chat ------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<|", "|>", "<|im_end|>\n", "<|im_start|>assistant\n", "<|im_next|>", "\\", "<\\|", "<\\\\|im_end|>", "\n", "x", "é", " ", "$1", "\\1"]
    rows, want = [], defaultdict(list)
    for conv in range(40):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "assistant", "a\\n\nb<|im_end|>", ""])
            text = "".join(rng.choice(bits) for _ in range(rng.randrange(6)))
            rows.append((conv, turn, role, text, 1))
            want[conv].append((role, text))
    rows += [(99, 0, None, None, 1), (99, 0, None, None, 1)]
    want[99] = [("", "")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int").repartition(5)
    formatted = chat.format_chats(df)
    for r in chat.parse_chats(formatted).collect():
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        runs = sum(1 for k, t in enumerate(want[r.conv_id]) if k == 0 or want[r.conv_id][k - 1][0] != t[0])
        assert r.formatted.count(chat.START) == runs
    for r in chat.chat_digest(formatted).collect():
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversations(spark):
    """Spans of a long conversation are read right, with texts of many bytes a letter; null ids and turns; a very long text."""
    rng = random.Random(4)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["", "añ€😀", "<|im_end|>", "x" * rng.randrange(40)])) for k in range(3000)]
    rows += [(None, None, "assistant", "no id"), (None, 2, None, None), (2, None, "user", "a"), (2, None, "assistant", "b"), (3, 0, "assistant", "<|" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digest(chat.format_chats(df)).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# --- 5 MinHash ---------------------------------------------------------------------------------


def shingles(text, width):
    w = words(text, True)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_docs(seed=4):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 120))] for _ in range(12)]
    texts = []
    for k in range(160):
        w = list(base[k % 12])
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts + texts[:10] + [texts[3].upper(), "a b", "A  b", "a", "", None, " \t", "b a", None]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_minhash_components(spark, width, percent):
    texts = near_docs()
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(None, "a b", "n")], "doc_id long, text string, bucket string").repartition(6)
    sets = [shingles(t, width) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * (k := len(sets[i] & sets[j])) >= percent * (len(sets[i]) + len(sets[j]) - k)]
    comp = classes(range(len(texts)), links)
    rows = minhash.minhash_near_dedup(df, width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None} == {i: (len(sets[i]), c, c == i) for i, c in comp.items()}
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert len(rows) == len(texts) + 1
    assert minhash.minhash_near_dedup(df.limit(0)).count() == 0


def test_min_max_signature_is_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(30):
        x = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = np.unique(x[:350]), np.unique(x[50:])
        errors.append((minhash.signature(a) == minhash.signature(b)).mean() - 300 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_pairs_by_prefix_miss_nothing(spark):
    """All links between components are among the pairs, and alike documents that are not linked give next to none."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for k in range(60):  # near copies of each other at every similarity
        w = list(base)
        for _ in range(rng.randrange(0, 30)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w[rng.randrange(0, 8) : len(w) - rng.randrange(0, 8)]))
    rows = [(i, t, i % 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp long")
    for width, percent in ((5, 80), (3, 85), (1, 50)):
        got = {(r.a, r.b) for r in minhash.pairs_by_prefix(df, width, percent).collect()}
        sets = [shingles(t, width) for t in texts]
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 7 != j % 7 and 100 * (k := len(sets[i] & sets[j])) >= percent * (len(sets[i]) + len(sets[j]) - k)}
        assert want <= got and all(i % 7 != j % 7 for i, j in got)
    group = [(i, " ".join(base + [f"u{i}x{k}" for k in range(36)]), i) for i in range(400)]  # similarity about 0.6
    df = spark.createDataFrame(group, "doc_id long, text string, comp long")
    assert minhash.pairs_by_prefix(df, 5, 80).count() < 400



# --- 6 sharding --------------------------------------------------------------------------------


def test_shards(spark):
    df = spark.range(3000).selectExpr("if(id % 10 = 0, 5, id) AS doc_id", "id AS size").repartition(5)
    rows = sharding.jump_shards(df, 24).collect()
    assert len(rows) == 3000
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 1 / 25 * 0.5 < sum(r.grown_shard == 24 for r in rows if r.doc_id != 5) / 2700 < 1 / 25 * 1.7
    by_key = defaultdict(set)
    for r in rows:
        by_key[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(v) == 1 for v in by_key.values())
    assert sharding.jump_shards(df.limit(0), 24).count() == 0
    assert sharding.jump_shards(spark.createDataFrame([(None,)], "doc_id long"), 24).first().slot == 0
    named = spark.createDataFrame([("a1", 7, 8), ("b", 7, 8), (None, 7, 8), ("a1", 7, 8)], "doc_id string, slot int, `x.y` int")
    rows = sharding.jump_shards(named, 3).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.doc_id == "a1"}) == 1 and {r["x.y"] for r in rows} == {8}


def test_jump_hash_by_the_book():
    def book(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = [0, 1, 2, 10, 2**63 - 1, -1 % 2**64] + list(range(100, 400))
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(np.array(keys, dtype=np.uint64), n).tolist() == [book(k, n) for k in keys]


def test_op6_query(spark):
    rows = queries.op6_sharding(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key") and 0 <= r.shard < 24
    assert len(rows) == len(docs)


# --- 7 substrings ------------------------------------------------------------------------------


def plain_removal(texts, window):
    all_words = [words(t) for t in texts]
    n = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window", [22, 35, 50])
def test_substrings(spark, window):
    rng = random.Random(window)
    new = lambda n: [f"W{rng.randrange(10**6)}" for _ in range(n)]
    passage, edge, loop = new(80), new(window), new(7)
    docs = [new(rng.randrange(5)) + passage[rng.randrange(10) :] + new(rng.randrange(40)) for _ in range(12)]
    docs += [new(3) + edge, edge + new(9), edge[:-1] + new(30), new(30) + edge[1:], loop * 30, new(200), new(10), new(60)]
    texts = [(" \n" if k % 2 else "\t").join(d) for k, d in enumerate(docs)] + [None, "", " "]
    texts += [texts[-4], texts[5]]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(4)
    for size in (substrings.BLOCK_BYTES, 2000):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.substring_dedup(df, window=window, block_bytes=size).collect()}
        assert got == dict(enumerate(plain_removal(texts, window)))
    assert substrings.substring_dedup(df.limit(0)).count() == 0


def test_cover_meets_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


# --- 8 quality ---------------------------------------------------------------------------------


def test_quality_edges(spark):
    good = " ".join(f"word{k} the{k % 7} of other{k * k}" for k in range(30))
    texts = [None, "", "a b a b a b", good, good + " ###***" * 30, "x " * 60, "\n".join([good] * 3), "é" * 30 + " the" * 3]
    rows = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + d for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert rows[3].kept and not rows[4].kept and not rows[5].kept and not rows[6].kept
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 9 language --------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out and r.lang is not None]
    assert len(out) > 100 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_kneser_ney_by_hand(spark):
    """Every probability of a toy corpus against the formula, written out over dictionaries."""
    texts = ["abracadabra abra", "cadab racab dab", "abba baab"] * 4
    model = langid.train(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, lang string"))
    sample = langid.fit_sample(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, lang string"), 1000, 16_000_000).where("part <> 0").collect()
    count = {n: Counter() for n in range(1, langid.ORDER + 1)}
    for r in sample:
        t = f" {r.text} "
        for n in count:
            for end in range(max(n - 1, 1), len(t)):
                count[n][t[end - n + 1 : end + 1]] += 1
    a = {langid.ORDER: count[langid.ORDER]}
    for n in range(1, langid.ORDER):
        different = Counter(g[1:] for g in count[n + 1])
        a[n] = {g: different.get(g, 1) for g in count[n]}
    d = {}
    for n in a:
        n1, n2 = (sum(v == k for v in a[n].values()) for k in (1, 2))
        d[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    none = 1 / (len(count[1]) + 1000)

    def p(c, context):
        n = len(context) + 1
        below = p(c, context[1:]) if context else none
        around = {g: v for g, v in a[n].items() if g[:-1] == context}
        if not around:
            return below
        total = sum(around.values())
        return max(around.get(context + c, 0) - d[n], 0) / total + d[n] * len(around) / total * below

    for t in (" abracadabra ", " dabba cab ", " zab "):
        points = np.array(list(t), dtype="U1").view(np.uint32)
        got = np.exp(model.log_probs(points, np.arange(len(points)))[:, 0])
        for k in range(1, len(t)):
            want = p(t[k], t[max(0, k - langid.ORDER + 1) : k])
            assert abs(got[k] - want) < 1e-4 * want, (t, k)


def test_every_language_is_learned(spark):
    """Many languages share the sample, none is left out, and a small one keeps its model."""
    rng = random.Random(8)
    alphabets = [[chr(0x4E00 + 12 * k + j) for j in range(12)] for k in range(20)]
    text = lambda k: "".join(rng.choice(alphabets[k]) for _ in range(60))
    rows = [(i, text(k), f"l{k:02}") for i, k in enumerate([0] * 300 + [k for k in range(20) for _ in range(12)])]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ask = spark.createDataFrame([(k, text(k), "x") for k in range(20)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.identify_language(ask, known, fit_chars=20_000, keep=("score", "text")).collect()}
    assert all(got[k].lang_pred == f"l{k:02}" and 0 <= got[k].score <= 1 and got[k].text for k in range(20))


def test_language_edges(spark):
    teach = [(i, ("the quick brown fox and the dog " if i % 2 else "der schnelle braune fuchs und das ") * 5, "en" if i % 2 else "de") for i in range(80)]
    teach += [(500, None, "en"), (501, "x", None), (None, "x", "zz")]
    df = spark.createDataFrame([(1, "the dog and the fox", 1), (2, "das und der", 1), (3, None, 1), (4, "", 1), (5, "123 !!", 1), (6, "日本", 1), (2, "das und der", 1)], "doc_id long, text string, score int")
    known = spark.createDataFrame(teach, "doc_id long, text string, lang string")
    rows = langid.identify_language(df, known).collect()
    pred = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == 7 and pred[1] == "en" and pred[2] == "de" and {pred[3], pred[4], pred[5]} == {"und"} and pred[6] in ("de", "en")
    assert all(r.score == 0 and r.rejected for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in langid.identify_language(df, known.limit(0)).collect()} == {"und"}
    assert langid.identify_language(df.limit(0), known).count() == 0


def test_kneser_ney_sums_to_one(spark):
    """Over all characters after a context the probabilities of a language and its rest for unknown ones make 1."""
    text = "abracadabra abra cadab racab " * 3
    model = langid.train(spark.createDataFrame([(i, text, "x") for i in range(40)], "id long, text string, lang string"))
    chars = np.array(sorted(set(text)), dtype="U1").view(np.uint32)
    for context in ("abra", "zzzz", "ca"):
        ctx = np.array(list(" " + context), dtype="U1").view(np.uint32)
        p = []
        for c in chars:
            points = np.append(ctx, c)
            p.append(float(np.exp(model.log_probs(points, np.arange(len(points)))[-1, 0])))
        unknown = np.append(ctx, np.array(["日"], dtype="U1").view(np.uint32))
        p.append(1000 * float(np.exp(model.log_probs(unknown, np.arange(len(unknown)))[-1, 0])))
        assert abs(sum(p) - 1) < 1e-3


# --- 10 mixing ---------------------------------------------------------------------------------


def plain_schedule(m, quantum):
    k, out = [0] * len(m), []
    for t in range(quantum):
        ready = [(-(-(k[i] + 1) * quantum // m[i]), i) for i in range(len(m)) if k[i] < m[i] and k[i] * quantum // m[i] <= t]
        i = min(ready)[1] if ready else None
        out.append(i)
        if i is not None:
            k[i] += 1
    return out


def test_mixing(spark):
    sizes = {"a": 700, "b": 200, "c": 60, None: 33, "": 5}
    rows = [(k * 7 + j, s, "t") for j, (s, n) in enumerate(sizes.items()) for k in range(n)] + [(None, "c", "t")] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, k string").repartition(4)
    q, b = 50, 4
    got = mixing.mix_sources(df, quantum=q, block_rows=b, group_rows=10).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(len(rows)))
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert [r.mix_slot for r in got] == sorted(r.mix_slot for r in got)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert [r.mix_block for r in mine] == [k // b for k in range(len(mine))]
        keys = [hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest() for r in mine]
        assert keys == sorted(keys)
    # every prefix of the schedule is within a block of the targets while no source has run out
    names = {r.source: r.m for r in mixing.target_slots(df.groupBy(F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")).alias("source")).agg(F.count("*").alias("n")), 0.5, q).collect()}
    assert sum(names.values()) == q
    slots = {r.mix_slot: r.source for r in got}
    name = lambda s: "0" if s is None else "1" + s
    ends = min(max(r.mix_slot for r in got if r.source == s) for s in sizes)
    taken = Counter()
    for t in range(ends + 1):
        taken[name(slots[t])] += 1
        assert all(abs(taken[n] - (t + 1) * m / q) < 1 for n, m in names.items())
    order = sorted(names)
    want = plain_schedule([names[n] for n in order], q)
    upto = min(q, ends + 1)
    assert [order[i] for i in want[:upto]] == [name(slots[t]) for t in range(upto)]
    assert mixing.mix_sources(df.limit(0)).count() == 0
    ordered = mixing.in_mix_order(mixing.mix_sources(df, quantum=q)).select("mix_position").collect()
    assert [r.mix_position for r in ordered] == list(range(len(rows)))


def test_mixing_many_sources(spark):
    """2000 sources, and no fewer slots than keep a large one at its share."""
    sizes = {f"s{j}": 3 for j in range(1999)} | {"big": 40_000}
    df = spark.range(sum(sizes.values())).selectExpr("id AS doc_id", "if(id < 40000, 'big', concat('s', (id - 40000) % 1999)) AS source")
    got = mixing.mix_sources(df, block_rows=1).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(sum(sizes.values()))) and Counter(r.source for r in got) == sizes
    assert [r.mix_slot for r in got] == sorted({r.mix_slot for r in got})
    share = 200 / (200 + 1999 * 3**0.5)
    taken = 0
    for r in got:
        if r.mix_slot >= 3000:
            break
        taken += r.source == "big"
        assert abs(taken - (r.mix_slot + 1) * share) < 1 + (r.mix_slot + 1) / mixing.PER_SOURCE
    assert taken > 100


def test_mixing_by_blocks_is_the_same(spark):
    df = spark.range(900).selectExpr("id AS doc_id", "if(id < 700, 'a', if(id < 870, 'b', if(id < 895, null, ''))) AS source").repartition(3)
    one, two = (mixing.mix_sources(df, quantum=50, block_rows=4, group_rows=10, max_broadcast=b).orderBy("doc_id").collect() for b in (10**6, 0))
    assert one == two and len(one) == 900
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 1.0)], "source string, weight double")
    got = mixing.mix_sources(df.withColumn("mix_slot", F.lit("x")), quantum=50, block_rows=4, group_rows=10, weights=weights).orderBy("mix_position").collect()
    first = Counter(r.source for r in got[:80])
    assert len(got) == 900 and first["b"] > 2 * first["a"] > 0


# --- the pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() > 0.9 * docs.count()
    kept.write.parquet(str(tmp_path / "1"))
    kept = spark.read.parquet(str(tmp_path / "1"))
    texts = {r.doc_id: r.text for r in kept.collect()}
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * (k := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - k)]
    comp = classes(sets, links)
    single = corpus_pipeline.near_copies(spark, kept, SF)
    assert {r.doc_id for r in single.collect()} == {i for i, c in comp.items() if c == i}
    single.write.parquet(str(tmp_path / "2"))
    single = spark.read.parquet(str(tmp_path / "2"))
    ids = [r.doc_id for r in single.select("doc_id").collect()]
    want = dict(zip(ids, plain_removal([texts[i] for i in ids], 50), strict=True))
    clean = corpus_pipeline.passages(spark, single, SF)
    rows = clean.collect()
    assert clean.columns == docs.columns and len(rows) == len(ids)
    for r in rows:
        assert r.text == (want[r.doc_id][2] if want[r.doc_id][1] else texts[r.doc_id])
    mixed = corpus_pipeline.mix(spark, clean, SF)
    assert mixed.columns == docs.columns + corpus_pipeline.MIX and Counter(r.doc_id for r in mixed.collect()) == Counter(ids)
    out = corpus_pipeline.tokens(spark, mixed, SF)
    from tokenizers import Tokenizer

    lib, text = Tokenizer.from_file(queries.tokenizer_path()), {r.doc_id: r.text for r in rows}
    for r in out.collect():
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids
    assert corpus_pipeline.run(spark, SF).count() == len(ids)


def test_pipeline_keeps_the_mix(spark, tmp_path):
    """The places of the mix reach the result: its prefixes hold the target shares."""
    import corpus_pipeline

    sizes = {"a": 400, "b": 100, "c": 25}
    docs = spark.createDataFrame([(k * 3 + j, f"text {k} of {s}", s) for j, (s, n) in enumerate(sizes.items()) for k in range(n)], "doc_id long, text string, source string")
    got = corpus_pipeline.tokens(spark, corpus_pipeline.mix(spark, docs, SF), SF).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(525))
    assert [r.mix_slot for r in got] == sorted(r.mix_slot for r in got)
    total, taken = sum(n**0.5 for n in sizes.values()), Counter()
    ends = min(max(r.mix_position for r in got if r.source == s) for s in sizes)
    for k, r in enumerate(got[: ends + 1]):
        taken[r.source] += 1
        assert all(abs(taken[s] - (k + 1) * n**0.5 / total) < 2 * 16 for s, n in sizes.items())
    want = {(r.doc_id, r.mix_position) for r in mixing.mix_sources(docs.select("doc_id", "source")).collect()}
    assert {(r.doc_id, r.mix_position) for r in got} == want


ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one two three four five six", "en", None, 27), (3, "one two three four five six", "en", None, 27),
    (None, "seven eight nine ten eleven twelve", None, "b", 34), (4, " \n\t", "en", "b", 3), (5, "word " * 30_000, "en", "b", 150_000), (6, "12 34 !!", "de", "c", 8),
]
NAMES = ("score", "rejected", "entropy", "lang_pred", "block", "n", "n_words", "h", "old_text", "mix_slot", "mix_position", "kept_text", "ids", "component_id", "kept", "a.b", "key")


@pytest.mark.parametrize("stage", ["language", "near_copies", "passages", "mix", "tokens"])
def test_pipeline_stage_edges(spark, stage):
    """Nulls, empty and long texts, repeated rows, columns with the operators' names, and an empty table, in every stage."""
    import corpus_pipeline

    f = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(c) for c in NAMES}).repartition(3)
    if stage == "tokens":
        docs = corpus_pipeline.mix(spark, docs, SF)
    rows = f(spark, docs, SF).collect()
    texts = [(r[0], r[1]) for r in ODD]
    if stage == "tokens":
        assert len(rows) == len(ODD) and sorted(r.mix_position for r in rows) == list(range(len(ODD)))
        assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 4)} == {0} and next(r.n_tokens for r in rows if r.doc_id == 5) == 30_000
    else:
        new = corpus_pipeline.MIX if stage == "mix" else []
        own = [c for c in docs.columns if c not in new]
        assert all(r[c] == c for r in rows for c in NAMES if c not in new) and f(spark, docs.limit(0), SF).columns == own + new
        got = Counter((r.doc_id, r.text) for r in rows)
        if stage == "language":
            assert not {i for i, _ in got} & {1, 2, 4, 6} and set(got) <= set(texts)
        elif stage == "near_copies":
            assert got == Counter(set(texts))
        elif stage == "passages":  # the long text repeats itself, short ones have no passage
            assert got == Counter((i, "" if i == 5 else t) for i, t in texts)
        else:
            assert got == Counter(texts) and sorted(r.mix_position for r in rows) == list(range(len(ODD)))
    assert f(spark, docs.limit(0), SF).count() == 0


def test_pipeline_null_and_repeated_ids(spark, tmp_path):
    """A repeated row stays once and whole, rows of one id with different texts stay both, rows without id stay."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in corpus_pipeline.language(spark, docs, SF).where("lang = 'en'").collect()}
    every = {r.doc_id: shingles(r.text, 5) for r in docs.collect()}
    alone = [i for i, t in sorted(texts.items()) if 60 <= len(words(t)) <= 2000 and not plain_removal([t], 50)[0][1] and not any(every[i] & s for j, s in every.items() if j != i)]
    once, twice, other, nameless = alone[:4]
    more = docs.where(F.col("doc_id") == once).unionAll(docs.where(F.col("doc_id") == once))
    renamed = docs.withColumn("doc_id", F.when(F.col("doc_id") == other, twice).when(F.col("doc_id") != nameless, F.col("doc_id")))
    renamed.unionAll(more).write.parquet(str(tmp_path / "documents.parquet"))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].append(r)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path())
    for i, want in ((once, [once]), (twice, [twice, other]), (None, [nameless])):
        ids = [list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in got[i]]
        assert sorted(ids) == sorted(lib.encode(texts[k], add_special_tokens=False).ids for k in want)
    places = sorted(r.mix_position for rows in got.values() for r in rows)
    assert places == list(range(len(places)))


@pytest.mark.parametrize("operator", [
    lambda docs: langid.judge(docs, langid.Model([])), lambda docs: minhash.minhash_near_dedup(docs.limit(2)),
    lambda docs: substrings.substring_dedup(docs.limit(2)), lambda docs: bpe.bpe_encode_decode(docs.limit(2), queries.tokenizer_path()),
])
def test_results_are_written_in_small_batches(spark, operator):
    """What an operator returns runs when the caller writes it: by then, too, tasks get a few megabytes of text at a time."""
    keys = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {k: spark.conf.get(k) for k in keys}
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('some words ', 500)").alias("text"))
    rows = lambda: max(r.n for r in docs.mapInArrow(sizes, "n long").collect())

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    try:
        for k in keys:
            spark.conf.unset(k)
        assert rows() == 4000  # 22 MB
        operator(docs)
        assert rows() < 1600 and int(spark.conf.get(keys[1])) <= 512
        for k in keys:
            spark.conf.set(k, "100")
        operator(docs)  # less stays
        assert [spark.conf.get(k) for k in keys] == ["100", "100"]
        with common.small_batches(spark):
            pass
        assert [spark.conf.get(k) for k in keys] == ["100", "100"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bpe_worker_loads_one_encoder(monkeypatch, tmp_path):
    """Tasks of one worker share an encoder, whose memory the library keeps; another file is loaded."""
    import pyarrow as pa
    import pyspark

    class Task:
        get = classmethod(lambda c: c)
        partitionId = classmethod(lambda c: 0)  # noqa: N815

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    loaded, load = [], bpe.word_encoder
    monkeypatch.setattr(bpe, "word_encoder", lambda path: loaded.append(path) or load(path))
    path = tmp_path / "tokenizer.json"
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        path.write_text(f.read(), encoding="utf-8")
    rows = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array(["word"])], ["__block", "__num", "__word"])
    ids = [next(iter(bpe._encode_runs(str(path))(iter([rows])))).column("__ids").to_pylist() for _ in range(3)]
    assert len(loaded) == 1 and ids[0] == ids[1] == ids[2] == [load(str(path))(["word"])[0]]
    path.write_text(path.read_text(encoding="utf-8") + " ", encoding="utf-8")
    list(bpe._encode_runs(str(path))(iter([rows])))
    assert len(loaded) == 2
