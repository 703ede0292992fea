"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embeddings, html_text, langid, minhash, mixing, periodic, quality, sharding, substrings, urls, whitening

TOKENIZER = "word_bpe_49k.json"
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
N_SHARDS = 24


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_near_dedup(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, action string")
    return urls.url_filter(table(spark, sf_dir, "pages"), rules)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trial = "<|im_end|><|im_start|>assistant ok"
    own = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{trial}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.chat_digest(chat.format_chats(rows))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_near_dedup(table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return sharding.jump_shards(rows, N_SHARDS)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify_language(docs, docs.where(~langid.held_out()))
    return out.withColumn("held_out", langid.held_out())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_text(table(spark, sf_dir, "pages"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by h = crc32(doc_id), goes on from word a = g % n by repeating its next
    p = 1 + floor((n - a) / (3 + g % 8)) words, with g = floor(h / 10); the others are as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("planted"))
    words = rows.withColumn("w", F.when(F.col("planted"), F.expr("filter(split(text, '[ \\t-\\r]+'), x -> x <> '')")))
    places = words.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    places = places.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = "slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))"
    text = F.when(F.col("planted") & (F.col("n") > 0), F.expr(f"array_join(concat(slice(w, 1, int(a)), {again}), ' ')")).otherwise(F.col("text"))
    return places.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words", "n_dropped",
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_embedding_near_dedup, op2_url_filter, op3_bpe, op4_chat_format, op5_minhash, op6_sharding, op7_substring_dedup, op8_quality_rules, op9_language_id, op10_mixing,
            op11_html_text, op12_periodic_runs, op13_embedding_whitening,
        )
    }


_COMPONENTS = """
reach(a, b) AS (
  SELECT a, b FROM link
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
),
least AS (SELECT a AS id, min(b) AS m FROM reach GROUP BY a)
"""

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))




def _periodic_sql(greatest: int = 16) -> str:
    """Windows of 2 ** j words get a hash each by doubling; a lag of half a window to a whole one is read from next occurrences,
    and islands of neighbouring ones are runs. Lags up to 2 ** ``greatest``: of texts up to 4 times as many words."""
    level = "h{j} AS MATERIALIZED (SELECT doc_id, i, hash(h, r) AS h FROM (SELECT doc_id, i, h, lead(h, {half}) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM h{before}) WHERE r IS NOT NULL)"
    seed = "SELECT doc_id, i, {k} AS k, lead(i) OVER (PARTITION BY doc_id, h ORDER BY i) - i AS q FROM h{j} QUALIFY q BETWEEN {low} AND {k}"
    doubled = ",\n".join(level.format(j=j, before=j - 1, half=2 ** (j - 1)) for j in range(1, greatest + 1))
    seeds = "\nUNION ALL ".join(seed.format(j=j, k=2**j, low=1 if j == 2 else 2 ** (j - 1) + 1) for j in range(2, greatest + 1))
    return f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) AS c FROM range(256) r(i))
),
d AS (
  SELECT doc_id, {_WORDS} AS w, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a // 256), 4294967295), 4294967295) AS h FROM documents, crc
),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
docs AS MATERIALIZED (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
x AS MATERIALIZED (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM docs),
h0 AS (SELECT doc_id, i, hash(w) AS h FROM x),
{doubled},
seeds AS ({seeds}),
runs AS MATERIALIZED (
  SELECT doc_id, min(i) AS s, max(i) - min(i) + k + q AS l, q FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM seeds)
  GROUP BY doc_id, k, q, island HAVING l >= greatest(6, 4 * q)
),
per AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS listed, arg_max([s, l, q], l * 1000000000000000000::HUGEINT - s * 1000000000 - q) AS best FROM runs GROUP BY doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT x.doc_id, string_agg(w, ' ' ORDER BY x.i) AS t, count(*) AS c FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT docs.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length, best[3]::BIGINT AS period, (1000 * best[2] // best[3])::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256, n::BIGINT AS n_words, (n - coalesce(c, 0))::BIGINT AS n_dropped
FROM docs LEFT JOIN per ON per.doc_id = docs.doc_id LEFT JOIN kept ON kept.doc_id = docs.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), {_COMPONENTS}
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept, label::VARCHAR AS label
FROM embeddings v LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) d ON d.a = v.vec_id LEFT JOIN least ON least.id = v.vec_id
""",
        "op2_url_filter": f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*(/[^?#]*)?', 1) AS path FROM pages
),
rules(rhost, rpath, action) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
best AS (
  SELECT host, path, max_by(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule, max_by(action, length(rhost) * 1000 + length(rpath)) AS action
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules ON ('.' || host) LIKE ('%.' || rhost) AND starts_with(path, rpath) GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule, coalesce(action, 'allow') AS verdict, rule IS NULL AS is_default
FROM parts p LEFT JOIN best b ON b.host = p.host AND b.path = p.path
""",
        "op4_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
),
marked AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS same,
    regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS safe,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS safe_role
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + CASE WHEN same THEN length('<|im_next|>') ELSE length('<|im_start|>') + length(safe_role) + 1 + length('<|im_end|>') + 1 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
""",
        "op5_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 85 * (u.n + v.n - k)
), {_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.id = d.doc_id
""",
        "op6_sharding": f"""
WITH RECURSIVE jump AS (
  SELECT doc_id, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS key, 0::BIGINT AS b FROM documents
  UNION ALL
  SELECT doc_id, k, j FROM (
    SELECT doc_id, k, floor((b + 1) * (2147483648.0::DOUBLE / ((k // 8589934592::HUGEINT)::DOUBLE + 1)))::BIGINT AS j
    FROM (SELECT doc_id, b, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k FROM jump))
  WHERE j <= {N_SHARDS}
),
placed AS (SELECT doc_id, max(b) FILTER (b < {N_SHARDS}) AS shard, max(b) AS grown FROM jump GROUP BY doc_id),
crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) AS c FROM range(256) r(i))
),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: 16 * (instr('0123456789ABCDEF', h[1]) - 1) + instr('0123456789ABCDEF', h[2]) - 1) AS b FROM documents),
sums AS (SELECT doc_id, len(b) AS size, xor(CASE WHEN len(b) = 0 THEN 4294967295 ELSE list_reduce(b, lambda a, x: xor(t[(xor(a, x) & 255) + 1], a // 256), 4294967295) END, 4294967295) AS crc FROM bytes, crc)
SELECT s.doc_id, (size + 8)::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY coalesce(s.doc_id, 0)) - 1 AS slot, grown::INT AS grown_shard
FROM sums s JOIN placed p ON p.doc_id = s.doc_id
""",
        "op7_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM w WHERE len(w) >= 35),
twice AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM twice, range(35) r(k)),
words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
kept AS (SELECT x.doc_id, string_agg(w, ' ' ORDER BY x.i) AS t FROM words x ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id
""",
        "op8_quality_rules": f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM documents
),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) >= 3),
twice AS (SELECT x.doc_id, i FROM win x SEMI JOIN (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1) t ON t.doc_id = x.doc_id AND t.g = x.g),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
),
f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, list_filter([
    CASE WHEN n_words = 0 OR word_chars / n_words < 2.0 OR word_chars / n_words > 14.0 THEN 'word_length' END,
    CASE WHEN word_chars > 0 AND n_symbols / word_chars > 0.08 THEN 'symbols' END,
    CASE WHEN n_words = 0 OR n_stop_words / n_words < 0.02 THEN 'stop_words' END,
    CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'repeated_lines' END], lambda x: x IS NOT NULL) AS failed FROM m
)
SELECT *, NOT base_failed AND len(failed) = 0 AS kept FROM f
""",
        "op10_mixing": """
WITH RECURSIVE c AS (SELECT coalesce('1' || source, '0') AS s, count(*) AS n FROM documents GROUP BY ALL),
sh AS (SELECT s, n, sqrt(n) / sum(sqrt(n)) OVER () * (1000 - count(*) OVER ()) AS share, count(*) OVER () AS k FROM c),
w AS (SELECT s, n, (1 + floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, s) <= 1000 - k - sum(floor(share)) OVER () THEN 1 ELSE 0 END)::BIGINT AS m FROM sh),
l AS (SELECT list(s ORDER BY s) AS s, list(m ORDER BY s) AS m FROM w),
step(t, k, pick) AS (
  SELECT -1, list_transform(m, lambda x: 0::BIGINT), 0 FROM l
  UNION ALL
  SELECT t, list_transform(k, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT t + 1 AS t, k, (list_min(list_filter(list_transform(k, lambda x, i: CASE WHEN x < m[i] AND x * 1000 // m[i] <= t + 1 THEN ((x + 1) * 1000 + m[i] - 1) // m[i] * 10000 + i END), lambda y: y IS NOT NULL)) % 10000)::INT AS p
    FROM step, l WHERE t < 999)
),
plan AS (SELECT t AS slot, l.s[pick] AS s, step.k[pick] - 1 AS k FROM step, l WHERE t >= 0),
d AS (SELECT doc_id, source, coalesce('1' || source, '0') AS s, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, ''))) - 1 AS i FROM documents),
x AS (SELECT doc_id, source, i, i // 16 AS mix_block, i // 16 // m * 1000 + slot AS mix_slot FROM d JOIN w ON w.s = d.s JOIN plan p ON p.s = d.s AND p.k = i // 16 % m)
SELECT doc_id, source, mix_block, mix_slot, row_number() OVER (ORDER BY mix_slot, i) - 1 AS mix_position FROM x
""",
        "op11_html_text": r"""
WITH article AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS a FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM article),
decoded AS (SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM plain),
done AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM done
""",
        "op12_periodic_runs": _periodic_sql(),
    }
