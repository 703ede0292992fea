"""A corpus pipeline of five stages, each a training-data operator applied to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.llm import bpe, langid, minhash, mixing, substrings
from gateflow.llm.common import stage
from gateflow.llm.queries import tokenizer_path


def _columns(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


def _renamed(df: DataFrame, **own: str) -> tuple[DataFrame, list]:
    """``df`` with columns that no operator uses (but for those in ``own``, which get these names), and the way back."""
    names = {c: next((new for new, old in own.items() if old == c), f"__{i}") for i, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that the models reject go.

    The models learn from the labelled documents that may teach (see ``langid.held_out``). A null text, or one without a
    letter, is rejected; so is every text if nothing could be learned. Rows are judged one by one: null ids,
    repeated rows and texts of any length are kept or go like others, ties between languages do not matter here, an empty
    table stays empty, and columns of any name (but for a leading ``__``) come through."""
    teach = docs.where(~langid.held_out()).select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = langid.train(teach.where("id is not null and lang is not null and text is not null"))
    return langid.judge(docs, model).where("not __rejected").select(*_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id.

    Rows without an id link with nothing and all stay, as in the operator. Rows that repeat an id are documents
    of their own: numbered in the order of id and text, and of a group the least number stays, so that of equal rows one
    stays. Null and empty texts link with nothing and stay, texts are compared whole, an empty table stays empty,
    and columns of any name (but for a leading ``__``) come through."""
    rows, with_id = docs.agg(F.count("*"), F.count("doc_id")).first()
    named = docs.where("doc_id is not null") if with_id < rows else docs
    key = "doc_id"
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        # ranges of (id, text, place), and numbers that go up with them: a much repeated row is spread by its place
        key, order = "__row", ("doc_id", "__text", "__in")
        placed = named.withColumns({"__text": F.xxhash64("text"), "__in": F.monotonically_increasing_id()})
        ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__text", "__in")
        named = stage(ranged.withColumn(key, F.monotonically_increasing_id()))
    kept = minhash.minhash_near_dedup(named, id_col=key).where("kept").select(F.col("doc_id").alias("__kept"))
    out = named.join(kept, F.col(key) == F.col("__kept"), "left_semi").select(*_columns(docs))
    return out.unionByName(docs.where("doc_id is null")) if with_id < rows else out


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that repeat; a text without one stays as it is, character by character.

    All rows stay. A null text stays null and an empty one empty; rows with one id, and equal rows, are texts of their own (so
    equal rows would empty each other; the stage before leaves one of them); texts of any length are read whole; an
    empty table stays empty; columns of any name (but for a leading ``__``) come through."""
    named, back = _renamed(docs, __text="text", __id="doc_id", __size="n_chars")
    out = substrings.substring_dedup(named.withColumn("__null", F.col("__text").isNull()), "__id", "__text", untouched=True)
    out = out.withColumn("__text", F.when(~F.col("__null"), F.col("kept_text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("__size", F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__size")))
    return out.select(*back)


MIX = ["mix_block", "mix_slot", "mix_position"]


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mix (``mix_block``, ``mix_slot``, ``mix_position``) beside the columns of documents:
    every prefix by ``mix_position`` has the sources in target shares. The last stage passes the places on.

    Rows without an id or source are mixed like others (a null source is a source), equal rows take places beside each
    other in any order, texts do not matter, an empty table stays empty, and columns of any name come through (but one
    named like a place is replaced by it)."""
    named, back = _renamed(docs, __id="doc_id", __source="source")
    own = [c for c in docs.columns if c not in MIX]
    return mixing.mix_sources(named, "__id", "__source").select(*(b for b, c in zip(back, docs.columns, strict=True) if c in own), *MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian unsigned 32-bit) of every text, with a digest of what they decode to, and
    its place in the mix as the stage before gave it (null where it gave none).

    A null or empty text has no ids and decodes to an empty text; null ids and equal rows are encoded each; texts are
    encoded whole; an empty table gives an empty result; columns other than id, source, text and places are not read."""
    places = [F.col(c) if c in docs.columns else F.lit(None).cast("long").alias(c) for c in MIX]
    out = bpe.bpe_encode_decode(docs.select("doc_id", "source", "text", *places), tokenizer_path())
    return out.select("doc_id", "source", *MIX, "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("mix", mix), ("tokens", tokens)]

#: SQL cannot express language models, nor BPE; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs
