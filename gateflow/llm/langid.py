"""Language identification by interpolated Kneser-Ney character models.

One model a language, of order 5, over texts in lower case with runs of anything but letters
written as one space. Counts, continuation counts, discounts and backoff weights are Spark aggregates over
n-gram tables; what a task gets is, for every few languages, one sorted array of n-gram hashes for each
order, with the probabilities of these languages beside it, and one of contexts with their backoff weights.
A text goes to the language of lowest cross-entropy per character; it is rejected if even that is above what
texts of the language of its length have, but for a stated share of them; that bound is set on training
texts that the models did not see.

The models' size is bounded by their sample alone: ``fit_rows`` texts of a language and ``fit_chars``
characters, in equal parts for all languages; no n-gram of the sample and no language is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_batches_small, lean, mix64, seeds, stage

ORDER = 5
SPACE = 32


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each with a space before and after and single spaces for other runs;
    the texts' offsets; and which have a letter."""
    out, sizes, has = [], [], []
    for t in texts.to_pylist():
        raw = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ok = is_letter(raw)
        x = np.full(len(raw) + 2, SPACE, dtype=np.uint32)
        x[1:-1] = np.where(ok, raw, SPACE)
        keep = np.ones(len(x), dtype=bool)
        keep[1:] = (x[1:] != SPACE) | (x[:-1] != SPACE)
        x = x[keep]
        out.append(x)
        sizes.append(len(x))
        has.append(bool(ok.any()))
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array(has, dtype=bool)


_LETTER: list = []


def is_letter(points: np.ndarray) -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0][points]


_UP = seeds(1, 31)[0] | np.uint64(1)


def grams_at(points: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` points that end at each of ``ends``."""
    h = np.full(len(ends), n + 1, dtype=np.uint64)
    for k in range(n - 1, -1, -1):
        h = (h + points[ends - k]) * _UP
    return mix64(h)


def ages(first: np.ndarray) -> np.ndarray:
    """Place of each point in its text."""
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


def _count_grams(batches):
    """(lang, n, gram, context, rest, c): counts of each n-gram with the hashes of it without its last and
    without its first character."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=str)
        for lang in np.unique(langs):
            rows = np.flatnonzero(langs == lang)
            for at in range(0, len(rows), 256):
                points, first, _ = letters(batch.column("text").take(pa.array(rows[at : at + 256])))
                age = ages(first)
                for n in range(1, ORDER + 1):
                    ends = np.flatnonzero(age >= max(n - 1, 1))
                    key, where, c = np.unique(grams_at(points, ends, n), return_index=True, return_counts=True)
                    context, rest = grams_at(points, ends[where] - 1, n - 1), grams_at(points, ends[where], n - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(lang)] * len(key), pa.string()), pa.array(np.full(len(key), n, dtype=np.int32)), *(pa.array(x.view(np.int64)) for x in (key, context, rest)), pa.array(c.astype(np.int64))],
                        ["lang", "n", "gram", "context", "rest", "c"],
                    )


class Part:
    """Models of a few languages: for each order the sorted ``keys`` and log ``probs`` (keys x languages), and the sorted
    ``contexts`` with log backoff weights ``lams``; ``none``: log probability of an unknown character."""

    def __init__(self, languages, keys, probs, contexts, lams, none):
        self.languages, self.keys, self.probs, self.contexts, self.lams, self.none = languages, keys, probs, contexts, lams, none

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray):
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def log_probs(self, points: np.ndarray, age: np.ndarray) -> np.ndarray:
        """Log probability of each point (rows) in each language after the points before it in its
        text; ``age`` says how many there are. Points of age 0 get 0."""
        out = np.zeros((len(points), len(self.languages)), dtype=np.float32)
        live = np.flatnonzero(age > 0)
        extra = np.zeros((len(live), len(self.languages)), dtype=np.float32)
        for n in range(ORDER, 0, -1):
            can = np.flatnonzero(age[live] >= n - 1)
            at, hit = self._find(self.keys[n], grams_at(points, live[can], n))
            out[live[can[hit]]] = self.probs[n][at[hit]] + extra[can[hit]]
            stay = np.ones(len(live), dtype=bool)
            stay[can[hit]] = False
            can = can[~hit]
            at, known = self._find(self.contexts[n], grams_at(points, live[can] - 1, n - 1))
            extra[can[known]] += self.lams[n][at[known]]
            live, extra = live[stay], extra[stay]
        out[live] = self.none + extra
        return out


class Model:
    """``parts``, one after the other, and the bound of rejection: ``center`` (of each language the median cross-entropy of
    texts not counted), ``spread`` (a, b) of a text of n characters: sqrt(a^2 + b^2 / n), and ``most`` spreads over the center."""

    def __init__(self, parts: list[Part]):
        self.parts, self.languages = parts, [x for p in parts for x in p.languages]
        self.center, self.spread, self.most = np.full(len(self.languages), np.inf), (1.0, 0.0), np.inf

    def log_probs(self, points: np.ndarray, age: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((len(points), 0), dtype=np.float32), *(p.log_probs(points, age) for p in self.parts)], axis=1)

    def entropies(self, texts: pa.Array):
        """Cross-entropy in nats a character of each text (rows) in each language; characters; which have a letter."""
        rows, sizes, has = [], [], []
        for at in range(0, len(texts), 64):
            points, first, ok = letters(texts.slice(at, 64))
            age, total, step = ages(first), np.zeros((len(ok), len(self.languages))), 1 << 16
            text = np.repeat(np.arange(len(ok)), np.diff(first))
            for s in range(0, len(points), step):
                back = max(0, s - ORDER + 1)
                lp = self.log_probs(points[back : s + step], age[back : s + step])[s - back :]
                of = text[s : s + step]
                cut = np.flatnonzero(np.diff(of, prepend=-1))
                total[of[cut]] += np.add.reduceat(lp, cut, axis=0, dtype=np.float64)
            n = np.maximum(np.diff(first) - 1, 1)
            rows.append(-total / n[:, None])
            sizes.append(n)
            has.append(ok)
        if not rows:
            return np.zeros((0, len(self.languages))), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        return np.concatenate(rows), np.concatenate(sizes), np.concatenate(has)

    def calibrate(self, of: np.ndarray, entropy: np.ndarray, size: np.ndarray, false_rejections: float) -> None:
        """Set the bound on texts of known language, so that ``false_rejections`` of such texts are beyond it.

        The spread is fitted to the middle nine tenths. The bound lies further out than most texts reach, so it is
        carried on from the uppermost tenth, whose excess over its beginning is taken as exponential."""
        if not len(of):
            return
        for k in range(len(self.languages)):
            self.center[k] = np.median(entropy[of == k] if (of == k).any() else entropy)
        off = entropy - self.center[of]
        middle = np.abs(off) <= np.quantile(np.abs(off), 0.9)
        a = b = float(np.std(off[middle])) + 1e-9
        for _ in range(20):  # weighted least squares of off^2 on 1 and 1 / n
            w = 1 / (a * a + b * b / size[middle]) ** 2
            x, y = 1 / size[middle], off[middle] ** 2
            mx, my = np.average(x, weights=w), np.average(y, weights=w)
            b2 = max(np.average((x - mx) * (y - my), weights=w) / max(np.average((x - mx) ** 2, weights=w), 1e-30), 0.0)
            a, b = max(my - b2 * mx, 1e-6) ** 0.5, b2**0.5
        self.spread = a, b
        z = np.sort(off / np.sqrt(a * a + b * b / size))
        upper = z[int(0.9 * len(z)) :]
        self.most = float(upper[0] + (upper - upper[0]).mean() * np.log(max(1.0, 0.1 / false_rejections)))

    def rejects(self, entropy: np.ndarray, size: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether a text's cross-entropy is out of the calibrated range of its language."""
        a, b = self.spread
        return entropy - self.center[best] > self.most * np.sqrt(a * a + b * b / size)


def fit_sample(labelled: DataFrame, fit_rows: int, fit_chars: int) -> DataFrame:
    """(id, text, lang, part) of at most about ``fit_rows`` rows a language, chosen by the hash of the id, and of no
    more rows than give a language its equal part of ``fit_chars`` characters; part 0 (a tenth) is for calibration."""
    sizes = stage(labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")))
    each = fit_chars / max(1, sizes.count())
    rate = sizes.select("lang", F.least(F.lit(1.0), fit_rows / F.col("rows"), each / F.greatest("chars", F.lit(1))).alias("rate"))
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(10)).cast("int")
    drawn = labelled.join(rate, "lang").withColumn("at", at).where("at < rate").select("id", "text", "lang", part.alias("part"), "at")
    before = F.expr("coalesce(sum(length(text)) over (partition by lang order by at, id rows between unbounded preceding and 1 preceding), 0)")
    return drawn.withColumn("before", before).where(F.col("before") < each).select("id", "text", "lang", "part")


def train(labelled: DataFrame, fit_rows: int = 1000, fit_chars: int = 16_000_000, false_rejections: float = 1e-5, together: int = 8) -> Model:
    """Fit on (id, text, lang), see :func:`fit_sample`; the n-grams of ``together`` languages share an array."""
    sample = stage(fit_sample(labelled, fit_rows, fit_chars))
    g = sample.where("part <> 0").select("text", "lang").mapInArrow(lean(_count_grams), "lang string, n int, gram long, context long, rest long, c long")
    key = ["lang", "n", "gram", "context", "rest"]
    g = stage(g.groupBy(*key).agg(F.sum("c").alias("c")))
    # below the highest order an n-gram counts by the different characters before it
    before = g.where("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("rest").alias("gram")).agg(F.count("*").alias("different"))
    g = g.join(before, ["lang", "n", "gram"], "left").withColumn("a", F.when(F.col("n") == ORDER, F.col("c")).otherwise(F.coalesce("different", F.lit(1))))
    g = stage(g.drop("different", "c"))
    once = stage(g.groupBy("lang", "n").agg(F.count_if(F.col("a") == 1).alias("n1"), F.count_if(F.col("a") == 2).alias("n2")))
    discount = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    around = g.groupBy("lang", "n", "context").agg(F.sum("a").alias("all"), F.count("*").alias("kinds"))
    around = stage(around.join(once.select("lang", "n", discount.alias("d")), ["lang", "n"]).withColumn("lam", F.col("d") * F.col("kinds") / F.col("all")))
    g = g.join(around.select("lang", "n", "context", "all", "d"), ["lang", "n", "context"])
    g = stage(g.select("lang", "n", "gram", "context", "rest", (F.greatest(F.col("a") - F.col("d"), F.lit(0.0)) / F.col("all")).alias("own")))
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    letters_ = g.where("n = 1").select("gram").distinct().count()
    parts = []
    for at in range(0, len(languages), together):  # a few languages at a time come to the driver
        some = languages[at : at + together]
        mine = F.col("lang").isin(some)
        parts.append(_assemble(some, letters_, g.where(mine).toArrow(), around.where(mine).select("lang", "n", "context", "lam").toArrow()))
    model = Model(parts)
    if not languages:
        return model
    held = sample.where("part = 0").select("text", "lang")
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        m = shared.value
        place = {x: k for k, x in enumerate(m.languages)}
        for batch in batches:
            h, n, ok = m.entropies(batch.column("text"))
            of = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()], dtype=np.int64)
            ok &= of >= 0
            yield pa.RecordBatch.from_arrays([pa.array(of[ok].astype(np.int32)), pa.array(h[np.arange(len(of)), of][ok]), pa.array(n[ok])], ["of", "h", "size"])

    seen = held.mapInArrow(lean(judge), "of int, h double, size long").toArrow()
    model.calibrate(*(seen.column(c).to_numpy() for c in ("of", "h", "size")), false_rejections)
    shared.unpersist()
    return model


def _assemble(languages: list[str], letters_: int, grams: pa.Table, around: pa.Table) -> Part:
    """Interpolate the orders from below; every n-gram known to a language gets its probability in all."""
    place = {x: k for k, x in enumerate(languages)}
    column = lambda t, c: t.column(c).to_numpy()
    lang = np.array([place[x] for x in grams.column("lang").to_pylist()], dtype=np.int64)
    ctx_lang = np.array([place[x] for x in around.column("lang").to_pylist()], dtype=np.int64)
    n_langs, keys, probs, contexts, lams = len(languages), {}, {}, {}, {}
    none = np.full(n_langs, -np.log(letters_ + 1000.0), dtype=np.float32)  # 1000 characters more than were seen
    for n in range(1, ORDER + 1):
        rows, ctx = column(grams, "n") == n, column(around, "n") == n
        contexts[n], at = np.unique(column(around, "context")[ctx].view(np.uint64), return_inverse=True)
        lam = np.ones((len(contexts[n]), n_langs))
        lam[at, ctx_lang[ctx]] = np.clip(column(around, "lam")[ctx], 1e-6, 1.0)
        lams[n] = np.log(lam).astype(np.float32)
        keys[n], where, at = np.unique(column(grams, "gram")[rows].view(np.uint64), return_index=True, return_inverse=True)
        p = np.zeros((len(keys[n]), n_langs))
        p[at, lang[rows]] = column(grams, "own")[rows]
        c, known = Part._find(contexts[n], column(grams, "context")[rows].view(np.uint64)[where])
        weight = np.where(known[:, None], lam[c] if len(lam) else 1.0, 1.0)
        if n == 1:
            below = np.exp(none)[None, :].repeat(len(p), 0)
        else:
            r, has = Part._find(keys[n - 1], column(grams, "rest")[rows].view(np.uint64)[where])
            below = np.where(has[:, None], np.exp(probs[n - 1][r]) if len(keys[n - 1]) else 0.0, np.exp(none)[None, :])
        probs[n] = np.log(np.maximum(p + weight * below, 1e-12)).astype(np.float32)
    return Part(languages, keys, probs, contexts, lams, none)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify_language(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 1000, fit_chars: int = 16_000_000, false_rejections: float = 1e-5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text by models fitted on ``labelled``.

    Returns ``doc_id``, ``lang_pred`` (a learned language, or ``und``), ``score`` (posterior, with the evidence counted as that of 100 characters at most, of the
    language, 0 to 1), ``entropy`` (nats a character) and ``rejected``, and the columns in ``keep``. Of texts
    like the labelled ones a share of ``false_rejections`` is rejected.

    Defined edge cases: a null text or one without letters is ``und`` with score 0, and rejected; the
    same for all if nothing could be learned; ties go to the first language by name; labelled rows
    without id, language or text teach nothing; repeated rows are judged each; a long text is read in pieces
    and counts whole; an empty table gives an empty result; other columns are ignored, and a column in
    ``keep`` that is named like a new one is replaced by it."""
    teach = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null and text is not null")
    model = train(teach, fit_rows, fit_chars, false_rejections)
    judged = judge(df, model, text_col)
    new = ["lang_pred", "score", "entropy", "rejected"]
    kept = [F.col(f"`{c}`") for c in keep if c not in (*new, "doc_id")]
    return judged.select(F.col(id_col).alias("doc_id"), *kept, *(F.col(f"__{c}").alias(c) for c in new))


def judge(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and ``__lang_pred``, ``__score``, ``__entropy`` and ``__rejected``, under names that no table has."""
    keep_batches_small(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            h, n, ok = m.entropies(batch.column(batch.num_columns - 1))
            ok &= len(m.languages) > 0
            if len(m.languages):
                best = h.argmin(axis=1)
                low = h[np.arange(len(best)), best]
                score = 1 / np.exp(-(h - low[:, None]) * np.minimum(n, 100)[:, None]).sum(axis=1)
                out = m.rejects(low, n, best)
            else:
                best, low, score, out = np.zeros(len(ok), int), np.zeros(len(ok)), np.zeros(len(ok)), np.ones(len(ok), bool)
            pred = names[np.where(ok, best, len(names) - 1)]
            found = [pa.array(pred.tolist(), pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(np.where(ok, low, np.nan), from_pandas=True), pa.array(~ok | out)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], schema=pa.schema([*list(batch.schema)[:-1], *(pa.field(c, f.type) for c, f in zip(("__lang_pred", "__score", "__entropy", "__rejected"), found, strict=True))]))

    kept = {f"__c{i}": c for i, c in enumerate(df.columns)}
    new = {"__lang_pred": T.StringType(), "__score": T.DoubleType(), "__entropy": T.DoubleType(), "__rejected": T.BooleanType()}
    rows = df.select(*(F.col(f"`{c}`").alias(k) for k, c in kept.items()), F.col(f"`{text_col}`").cast("string").alias("__text"))
    kind = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, t) for c, t in new.items())])
    return rows.mapInArrow(lean(run), kind).select(*(F.col(k).alias(c) for k, c in kept.items()), *new)
