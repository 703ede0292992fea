"""URL filter: a trie over reversed host labels, then path segments, with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule table of at most this many rows is made into a trie that every task holds.
MAX_TRIE_RULES = 200_000


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; both empty if it is null or has no ``://``."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, "://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Trie of (host, path, action). A node: ``labels`` by next host label, ``segments`` by next whole
    path segment, ``ends`` with the path's last, perhaps partial segment, longest first. Of equal
    rules a block wins."""
    new = lambda: {"labels": {}, "paths": None}
    root = new()
    for host, path, action in sorted(rules, key=lambda r: r[2] != "allow"):
        node = root
        for label in reversed(host.split(".")):
            node = node["labels"].setdefault(label, new())
        if node["paths"] is None:
            node["paths"] = {"segments": {}, "ends": {}}
        at = node["paths"]
        *whole, last = path.split("/")
        for segment in whole:
            at = at["segments"].setdefault(segment, {"segments": {}, "ends": {}})
        at["ends"][last] = (host + path, action)
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, action) of the rule with most host labels, then the longest path, that fits."""
    node, found = trie, None
    if not host:
        return None
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node["labels"].get(label)
        if node is None:
            break
        at, k, best = node["paths"], 0, None
        while at is not None:
            part = segments[k] if k < len(segments) else None
            if part is not None and at["ends"]:
                fits = [e for e in (at["ends"] if len(at["ends"]) <= len(part) else (part[:n] for n in range(len(part) + 1) if part[:n] in at["ends"])) if part.startswith(e)]
                if fits:
                    best = at["ends"][max(fits, key=len)]
            if part is None or k + 1 >= len(segments):
                break
            at, k = at["segments"].get(part), k + 1
        found = best or found
    return found


def url_filter(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """Judge every url by (host, path, action) ``rules``: id, host, path, rule, verdict, is_default.

    A rule fits its host and all subdomains if the url's path starts with the rule's. Precedence: most
    host labels, then the longest path; a block wins over an equal allow; no rule: ``default``. The
    rule table is counted first: up to ``max_trie_rules`` rows become a trie held by every task;
    beyond that the same match runs as a shuffle join on (host suffix, whole path segments) over distinct urls; a suffix that
    many of them have makes a skewed partition, which Spark splits at run time.

    Defined edge cases: a null url, or one without ``://``, has an empty host and path and gets the
    default; rules with a null part are ignored, a null path is empty; repeated rows are judged each;
    an empty table gives an empty result; other columns are ignored."""
    rules = rules.where("host is not null and host <> '' and action is not null").select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    host, path = url_host_path(F.col(url_col).cast("string"))
    urls = df.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    held = rules.limit(max_trie_rules + 1).collect()
    if len(held) <= max_trie_rules:
        judged = _by_trie(urls, [tuple(r) for r in held])
    else:
        judged = _by_join(urls, rules)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"), F.col("rule").isNull().alias("is_default"))


def _by_trie(urls: DataFrame, rules: list[tuple]) -> DataFrame:
    held = urls.sparkSession.sparkContext.broadcast(rules)

    def run(batches):
        trie = build_trie(held.value)
        for batch in batches:
            found = [longest_match(trie, h, p) or (None, None) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield batch.append_column("rule", pa.array([f[0] for f in found], pa.string())).append_column("action", pa.array([f[1] for f in found], pa.string()))

    kind = urls.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, action string")


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    keyed = rules.select(
        F.struct("host", F.regexp_replace("path", "[^/]*$", "").alias("whole")).alias("key"),
        F.struct(F.size(F.split("host", "\\.")).alias("n"), F.length("path").alias("m"), (F.col("action") != "allow").alias("last"), F.concat("host", "path").alias("rule"), "path", "action").alias("r"),
    )
    # distinct urls only: a hot page is matched once
    seen = urls.select("host", "path").distinct()
    labels, parts = F.split("host", "\\."), F.split("path", "/")
    keys = seen.where("host <> ''").withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))).withColumn(
        "whole", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.when(k > 0, "/").otherwise(""))))
    )
    best = keys.withColumn("key", F.struct(F.col("suffix").alias("host"), "whole")).join(keyed, "key").where(F.expr("startswith(path, r.path)")).groupBy("host", "path").agg(F.max("r").alias("r"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.action").alias("action"))
