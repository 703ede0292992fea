"""BPE encoding and decoding through a table of distinct words.

1. Texts are split into words by the tokenizer's own rules. A block (the rows of one task, up to a
   number of distinct words) keeps each text as numbers into the block's word list.
2. The blocks' word lists are shuffled by word; each distinct word is encoded once, over all blocks, and its
   ids are joined to the table of pieces, which tells what the word decodes to.
3. Ids and pieces go back to the blocks, packed. The first text of a block brings them, and the others are
   read past in order, their ids and pieces put together by position.

Shuffled are the word lists and their ids, never a row for each word of a text. A task holds one block's
words and a few texts at a time.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_batches_small, lean, stage

MAX_BLOCK_WORDS = 300_000  # distinct words of a block, about
MAX_BLOCK_ITEMS = 3_000_000  # words of a block, about
GROUP, GROUP_ITEMS = 64, 1 << 19  # texts whose numbers are packed together, and their words, about
SENT = 1 << 19  # rows of the word lists that are packed together
MAX_BROADCAST_PIECES = 1 << 20  # a vocabulary of more pieces is joined by a shuffle


class Splitter:
    """Splits a text into the words that the tokenizer would merge on their own.

    Normalisation, splitting and added tokens are the library's. For texts of Latin characters (below
    U+0250, and common punctuation) a regular expression takes the same words faster; any other
    character sends its text through the library's own normalizer and splitter."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be taken literally")
        self.tokenizer = Tokenizer.from_file(path)
        self.splitter = pre_tokenizers.Split(self._pattern(spec), "removed", invert=True)
        self.word = regex.compile(self._pattern_text(spec))
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.plain = regex.compile(r"[\x09-\x0d\x20-\x7e\xa1-\u024f\u2010-\u2027]*")

    @staticmethod
    def _pattern_text(spec: dict) -> str:
        kinds = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["use_regex"] or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("this tokenizer is put together in another way")
        return split["pattern"]["Regex"]

    def _pattern(self, spec: dict):
        from tokenizers import Regex

        return Regex(self._pattern_text(spec))

    def words(self, text: str) -> list[str]:
        """Words and added tokens, in order; an added token is marked by a leading NUL, which no word has."""
        if self.cut is None or "<" not in text:
            return self._segment(text)
        out = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append("\0" + part)
            elif part:
                out += self._segment(part)
        return out

    def _segment(self, text: str) -> list[str]:
        if "İ" not in text and self.plain.fullmatch(text):
            return self.word.findall(unicodedata.normalize("NFC", text).lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [w.replace("\0", "\0\0") for w, _ in self.splitter.pre_tokenize_str(normal)]


def word_encoder(path: str):
    """Function from words of :class:`Splitter` to their ids, each word encoded on its own."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    spec["normalizer"], spec["added_tokens"] = None, []
    spec["pre_tokenizer"] = spec["pre_tokenizer"]["pretokenizers"][1]
    own = Tokenizer.from_str(json.dumps(spec))

    def encode(words: list[str]) -> list[list[int]]:
        plain = [None if w[:1] == "\0" and w[:2] != "\0\0" else w.replace("\0\0", "\0") for w in words]
        ids = iter(own.encode_batch([w for w in plain if w is not None], add_special_tokens=False))
        return [[added[w[1:]]] if p is None else next(ids).ids for w, p in zip(words, plain, strict=True)]

    return encode


@lru_cache(maxsize=1)
def _held_encoder(path: str, changed: int, size: int):
    return word_encoder(path)


def held_encoder(path: str):
    """:func:`word_encoder`, loaded once in a worker: the library does not give back all that an encoder took, so one
    a task would let a worker grow with the number of its tasks. A file that has changed is loaded anew."""
    now = os.stat(path)
    return _held_encoder(path, now.st_mtime_ns, now.st_size)


def pieces_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the whole vocabulary: as many rows as the tokenizer's file has pieces."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rows = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return spark.createDataFrame(pa.table({"id": pa.array(list(rows), pa.int32()), "piece": list(rows.values())}))


def _join_pieces(ids: DataFrame, pieces: DataFrame, *order: str) -> DataFrame:
    """(..., id, piece), the rows of ``order[0]`` together and in this order, as ``ids`` has them. The table of pieces is
    counted: a small one is broadcast, which leaves the rows where they are; a larger one is joined by a shuffle."""
    if pieces.limit(MAX_BROADCAST_PIECES + 1).count() <= MAX_BROADCAST_PIECES:
        return ids.join(F.broadcast(pieces), "id", "left")
    joined = ids.join(pieces, "id", "left")
    return joined.repartition(order[0]).sortWithinPartitions(*order) if order else joined


class _Numbers(dict):
    """Number of each word, in order of appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as their four byte planes, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _split(path: str, keys: list[str], schema: pa.Schema):
    """Rows of two kinds: (block, num, word) of a block's word list, and (keys, block, group, place, n_words, nums)
    of a text. The words of a block are numbered by how often they are found, in powers of two, then by spelling, so
    that numbers and lists are small when packed; the numbers of ``GROUP`` texts are packed together and
    stand in the group's first row."""

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def own(part: pa.RecordBatch) -> pa.RecordBatch:
        """The key columns, copied: a slice would hold the whole batch, texts and all."""
        return part.select(keys).take(pa.array(np.arange(part.num_rows)))

    def run(batches):
        from pyspark import TaskContext

        splitter, task = Splitter(path), TaskContext.get().partitionId()
        made, numbers, held, seen = 0, _Numbers(), [], []

        def close():
            block = lambda n: pa.array(np.full(n, (task << 24) + made, dtype=np.int64))
            words = pa.array(list(numbers), pa.string())
            times = np.bincount(np.concatenate([np.zeros(0, dtype=np.uint32), *seen]), minlength=len(words))
            spelling = np.empty(len(words), dtype=np.int64)
            spelling[pa.compute.array_sort_indices(words).to_numpy()] = np.arange(len(words))
            order = np.lexsort((spelling, -np.frexp(times)[1]))
            rank = np.empty(len(words), dtype=np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            at = 0
            for g, (n, part) in enumerate(held):
                nums = seen[at : at + n]
                at += n
                packed = [_pack(rank[np.concatenate(nums)])] + [None] * (n - 1)
                yield rows(n, __block=block(n), __group=pa.array(np.full(n, g, dtype=np.int32)), __place=pa.array(np.arange(n, dtype=np.int32)), __n=pa.array([len(x) for x in nums], pa.int32()), __nums=pa.array(packed, pa.binary()), __items=pa.array([sum(map(len, nums))] + [None] * (n - 1), pa.int64()), **{k: part.column(k) for k in keys})
            for at in range(0, len(words), 20_000):
                part = words.take(pa.array(order[at : at + 20_000]))
                yield rows(len(part), __block=block(len(part)), __num=pa.array(np.arange(at, at + len(part), dtype=np.int32)), __word=part)

        items = 0
        for batch in batches:
            texts, at, in_group = batch.column("__text"), 0, 0
            for i in range(batch.num_rows):
                words = splitter.words(texts[i].as_py() or "")
                seen.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words)))
                items, in_group = items + len(words), in_group + len(words)
                if i + 1 - at >= GROUP or in_group >= GROUP_ITEMS or i + 1 == batch.num_rows:
                    held.append((i + 1 - at, own(batch.slice(at, i + 1 - at)) if keys else None))
                    at, in_group = i + 1, 0
                    if len(numbers) >= MAX_BLOCK_WORDS or items >= MAX_BLOCK_ITEMS:
                        yield from close()
                        made, numbers, held, seen, items = made + 1, _Numbers(), [], [], 0
        if held:
            yield from close()

    return lean(run)


#: A block's words: how many, their ids and letters, and packed: numbers, ids a word, ids, letters a word, letters.
_WORDS = pa.struct([("n", pa.int32()), ("n_ids", pa.int32()), ("n_letters", pa.int32()), ("nums", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("lengths", pa.binary()), ("letters", pa.binary())])


def _sent(block: np.ndarray, num: np.ndarray, size: np.ndarray, length: np.ndarray, ids: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
    """A row for each block with its words."""
    order = np.lexsort((num, block))
    ids = _ragged(ids, np.concatenate([[0], np.cumsum(size)]), order)
    letters = _ragged(letters, np.concatenate([[0], np.cumsum(length)]), order)
    block, num, size, length = block[order], num[order], size[order], length[order]
    cut = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
    ends, at = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(length)])
    rows = []
    for a, b in zip(cut, [*cut[1:], len(block)], strict=True):
        mine, said = ids[ends[a] : ends[b]], letters[at[a] : at[b]]
        rows.append({"n": b - a, "n_ids": len(mine), "n_letters": len(said), "nums": _pack(np.diff(num[a:b], prepend=0)), "sizes": _pack(size[a:b]), "ids": _pack(mine), "lengths": _pack(length[a:b]), "letters": pa.compress(said.tobytes(), codec="zstd", asbytes=True)})
    return pa.RecordBatch.from_arrays([pa.array(block[cut]), pa.array(rows, _WORDS)], ["__of", "__words"])


def _encode_runs(path: str):
    """(run, ids, blocks, nums) from rows sorted by word: every distinct word is encoded once. The places of a word that
    a batch has are one row."""

    def run(batches):
        from pyspark import TaskContext

        encode, last, ids, made = held_encoder(path), None, [], TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("__word").dictionary_encode()
            known, which = words.dictionary.to_pylist(), words.indices.to_numpy()
            found = [*([ids] if known[0] == last else []), *encode([w for w in known if w != last])]  # the last run may go on
            first = pa.array(np.append(np.flatnonzero(np.diff(which, prepend=-1)), len(which)).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32)), pa.array([i for x in found for i in x], pa.int32()))
            places = [pa.ListArray.from_arrays(first, batch.column(c)) for c in ("__block", "__num")]
            yield pa.RecordBatch.from_arrays([pa.array(made + np.arange(len(known))), lists, *places], ["__run", "__ids", "__blocks", "__nums"])
            last, ids, made = known[-1], found[-1], made + len(known)

    return lean(run)


def _send(batches):
    """(of, words) from rows of (run, pos, id, piece, blocks, nums), in order of run and pos; of a run the first row has the places."""
    rest, held, n = None, [], 0
    for batch in itertools.chain(batches, [None]):
        rows = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
        if rows is None or not rows.num_rows:
            continue
        first = np.flatnonzero(np.diff(rows.column("__run").to_numpy(), prepend=-1))
        if batch is None:
            done, rest = rows, None
        else:  # the last run may go on
            done, rest, first = rows.slice(0, first[-1]), rows.slice(first[-1]), first[:-1]
        if not done.num_rows:
            continue
        has = done.column("id").is_valid().to_numpy().astype(np.int64)
        ids = done.column("id").drop_null().to_numpy()
        spaced = pa.compute.fill_null(pa.compute.binary_join_element_wise(done.column("piece"), "", " "), "")
        at, letters = _buffers(spaced)
        size, length = np.add.reduceat(has, first), np.add.reduceat(np.diff(at), first)
        blocks, nums = (done.column(c).take(pa.array(first)).combine_chunks() for c in ("__blocks", "__nums"))
        of = np.repeat(np.arange(len(first)), pa.compute.list_value_length(blocks).to_numpy())
        held.append((blocks.flatten().to_numpy(), nums.flatten().to_numpy(), size[of], length[of], _ragged(ids, np.concatenate([[0], np.cumsum(size)]), of), _ragged(letters, np.concatenate([[0], np.cumsum(length)]), of)))
        n += len(of)
        if n >= SENT:
            yield _sent(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield _sent(*map(np.concatenate, zip(*held, strict=True)))


def _buffers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts."""
    wide = column.cast(pa.large_string()).combine_chunks()
    wide = wide if isinstance(wide, pa.Array) else pa.concat_arrays(wide.chunks)
    at = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return at - at[0], np.frombuffer(wide.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]


def _ragged(flat: np.ndarray, first: np.ndarray, picks: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The runs flat[first[p] : first[p + 1]] of all picks, one after the other."""
    lengths = first[picks + 1] - first[picks]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(ends[-1], dtype=flat.dtype)
    for at in range(0, len(picks), step):  # some at a time: the places take more room than the values
        to = min(at + step, len(picks))
        out[ends[at] : ends[to]] = flat[np.arange(ends[at], ends[to]) + np.repeat(first[picks[at:to]] - ends[at:to], lengths[at:to])]
    return out


def _cut(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Bytes as values of these lengths."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    wide = pa.Array.from_buffers(pa.large_binary() if kind == pa.binary() else pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
    return wide.cast(kind)


class _Block:
    """What the first text of a block brings: ids and letters of its words, by their number."""

    def __init__(self, words: list[dict], size: int | None):
        part = lambda c, n: np.concatenate([np.zeros(0, dtype=np.uint32), *(_unpack(w[c], w[n]) for w in words)]).astype(np.int64)
        num = np.concatenate([np.zeros(0, dtype=np.int64), *(np.cumsum(_unpack(w["nums"], w["n"]), dtype=np.int64) for w in words)])
        if len(num) != (size or 0):
            raise RuntimeError("words of a block are missing")
        order, runs = np.argsort(num), lambda x: np.concatenate([[0], np.cumsum(x)])
        sizes, lengths = part("sizes", "n"), part("lengths", "n")
        letters = np.frombuffer(b"".join(pa.decompress(w["letters"], w["n_letters"], codec="zstd", asbytes=True) for w in words), dtype=np.uint8)
        self.ids, self.first = _ragged(part("ids", "n_ids").astype("<u4"), runs(sizes), order), runs(sizes[order])
        self.letters, self.said = _ragged(letters, runs(lengths), order), runs(lengths[order])

    def texts(self, words: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
        """n_tokens, ids and decoded of texts of ``sizes`` words."""
        ends = np.concatenate([[0], np.cumsum(sizes)])
        total = lambda of: np.diff(np.concatenate([[0], np.cumsum(np.diff(of)[words])])[ends])
        n, lengths = total(self.first), total(self.said)
        ids = _cut(_ragged(self.ids, self.first, words).view(np.uint8), 4 * n, pa.binary())
        text = np.delete(_ragged(self.letters, self.said, words), np.cumsum(lengths)[lengths > 0] - 1)  # the space behind the last piece
        return [pa.array(n), ids, _cut(text, lengths - (lengths > 0), pa.string())]


def _assemble(keys: list[str]):
    """Texts sorted by block, group and place; a group at a time, straight into Arrow."""

    def run(batches):
        block = words = None
        for batch in batches:
            place, sizes = batch.column("__place").to_numpy(), batch.column("__n").to_numpy().astype(np.int64)
            begins = np.flatnonzero(place == 0).tolist()
            begins = begins if begins[:1] == [0] else [0, *begins]  # a group may go on from the batch before
            for at, to in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                if at == to:
                    continue
                if place[at] == 0:
                    if batch.column("__group")[at].as_py() == 0:
                        block = _Block(batch.column("__words")[at].as_py() or [], batch.column("__size")[at].as_py())
                    nums = batch.column("__nums")[at].as_py()
                    words = _unpack(nums, batch.column("__items")[at].as_py()).astype(np.int64)
                own = int(sizes[at:to].sum())
                done, words = block.texts(words[:own], sizes[at:to]), words[own:]
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *done], [*keys, "n_tokens", "ids", "decoded"])

    return lean(run)


def bpe_encode_decode(df: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers, packed) and ``decoded`` (the ids'
    pieces, as the tokenizer without a decoder joins them); the text goes.

    Ids equal those of the tokenizer on the whole text without special tokens added; strings of
    added tokens inside a text become their ids.

    Defined edge cases: a null or empty text has no ids and decodes to an empty text; repeated rows are encoded each;
    a text of any length is one row of its block; an empty table gives an empty result; all other columns are
    returned as they are, but one named like a new column is replaced by it."""
    new = ["n_tokens", "ids", "decoded"]
    spark = df.sparkSession
    keep_batches_small(spark)
    named = {f"__k{i}": c for i, c in enumerate(c for c in df.columns if c != text_col and c not in new)}
    keys = list(named)
    kept = df.select(*(F.col(f"`{c}`").alias(k) for k, c in named.items()), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([
        *(T.StructField(f.name, f.dataType, True) for f in kept.schema.fields[:-1]),
        T.StructField("__block", T.LongType()), T.StructField("__num", T.IntegerType()), T.StructField("__word", T.StringType()),
        T.StructField("__group", T.IntegerType()), T.StructField("__place", T.IntegerType()), T.StructField("__n", T.IntegerType()), T.StructField("__nums", T.BinaryType()),
        T.StructField("__items", T.LongType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    # dealt by block as it is written: a block's texts are joined with its words without another shuffle
    split = stage(kept.mapInArrow(_split(tokenizer_path, keys, to_arrow_schema(schema)), schema), by="__block")

    # one shuffle by word; the rows of a word are then neighbours, and it is encoded once for all of them
    lists = split.where("__num is not null").select("__block", "__num", "__word")
    places = "__blocks array<long>, __nums array<int>"
    runs = lists.repartition("__word").sortWithinPartitions("__word").mapInArrow(_encode_runs(tokenizer_path), f"__run long, __ids array<int>, {places}")
    runs = stage(runs)  # else its Python workers and those of the sending below stand in each task together
    # of a word's ids the first keeps its places with it through the join
    first = F.coalesce("pos", F.lit(0)) == 0
    ids = runs.select("__run", "__blocks", "__nums", F.posexplode_outer("__ids").alias("pos", "id"))
    ids = ids.select("__run", "pos", "id", *(F.when(first, F.col(c)).alias(c) for c in ("__blocks", "__nums")))
    said = _join_pieces(ids, pieces_table(spark, tokenizer_path), "__run", "pos").select("__run", "id", "piece", "__blocks", "__nums")
    sent = said.mapInArrow(lean(_send), "__of long, __words struct<n: int, n_ids: int, n_letters: int, nums: binary, sizes: binary, ids: binary, lengths: binary, letters: binary>")
    # one shuffle by block
    brought = sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "__of").groupBy(F.col("__of").alias("__for")).agg(F.collect_list("__words").alias("__words"), F.sum("__words.n").alias("__size"))
    texts = split.where("__group is not null").drop("__num", "__word")
    head = (F.col("__block") == F.col("__for")) & (F.col("__group") == 0) & (F.col("__place") == 0)
    texts = texts.join(brought, head, "left").sortWithinPartitions("__block", "__group", "__place")
    out = T.StructType([*schema.fields[: len(keys)], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    done = texts.mapInArrow(_assemble(keys), out)
    return done.select(*(F.col(k).alias(c) for k, c in named.items()), *new)


def unpack_ids(ids) -> F.Column:
    """Packed ids as an array of int."""
    h = F.hex(ids)
    at = F.sequence(F.lit(0), (F.length(h) / 8).cast("int") - 1)
    byte = lambda i, k: F.substring(h, i * 8 + 2 * k + 1, F.lit(2))
    ints = F.transform(at, lambda i: F.conv(F.concat(*(byte(i, k) for k in (3, 2, 1, 0))), 16, 10).cast("int"))
    return F.when(F.length(h) > 0, ints).otherwise(F.array().cast("array<int>"))


def bpe_decode(df: DataFrame, pieces: DataFrame, key_col: str, ids_col: str = "ids") -> DataFrame:
    """(key, decoded) of any table with unique keys and arrays of ids, by a join of ids to pieces.

    Unknown ids raise no error and decode to nothing; null or empty ids decode to an empty text."""
    long = df.select(F.col(key_col).alias("key"), F.posexplode_outer(ids_col).alias("pos", "id"))
    found = F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))
    return _join_pieces(long, pieces).groupBy("key").agg(F.array_join(F.transform(F.array_sort(found), lambda x: x.piece), " ").alias("decoded")).withColumnRenamed("key", key_col)
