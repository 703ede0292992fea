"""Chat formatting with Spark expressions only: one string a conversation, its loss mask, and the way back.

Template: a block ``<|im_start|>role\\n`` ... ``<|im_end|>\\n`` for each run of adjacent turns with
one role; inside a block the turns are set apart by ``<|im_next|>``. Within roles and texts every
``<``, zero or more backslashes, ``|`` gets one backslash more, so that no text can hold a control
string and taking one away gives the text back. A role also has its backslashes doubled and its
newlines written ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", train_role: str = "assistant") -> DataFrame:
    """(conversation, ``formatted``, ``loss_spans``): spans (start, length) in code points of the
    texts of ``train_role`` inside the formatted string, without marks.

    Turns are collected as structs and sorted by (turn, role, text); adjacent turns of one role are
    merged into a block, by the places where the role changes; the blocks are concatenated. A conversation is one
    output row, so its turns meet in one place and nowhere else.

    Defined edge cases: a null text or role is empty; a null turn sorts first; equal turn numbers are sorted by role, then text;
    repeated rows are turns of their own; a null conversation id is a conversation; a text, and a conversation, of any length is formatted
    whole (it is one row, so it must fit a task; the work is linear in it); an
    empty table gives an empty result; other columns are ignored."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    turns = df.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # where blocks begin; a block is then a slice of the turns, and nothing is grown turn by turn
    role = lambda i: F.get("turns", i).role
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    turns = turns.select("conv_id", "turns", starts.alias("starts"))
    mark = lambda c: F.struct(c.alias("s"), F.lit(False).alias("loss"))

    def block(start: Column, j: Column) -> Column:
        n = F.coalesce(F.get("starts", j + 1), F.size("turns")) - start
        texts = F.transform(F.slice("turns", start + 1, n), lambda t: F.array(mark(F.lit(NEXT)), F.struct(escape(t.text).alias("s"), (t.role == train_role).alias("loss"))))
        opened = mark(F.concat(F.lit(START), _role_out(role(start)), F.lit("\n")))
        return F.concat(F.array(opened), F.slice(F.flatten(texts), F.lit(2), 2 * n), F.array(mark(F.lit(END))))

    # pieces in order: marks and texts, each with whether the loss counts it, and where each begins
    pieces = turns.select("conv_id", F.flatten(F.transform("starts", block)).alias("pieces"))
    pieces = pieces.select("conv_id", "pieces", _running(F.transform("pieces", lambda p: F.length(p.s))).alias("at"))
    spans = F.zip_with("pieces", "at", lambda p, at: F.when(p.loss, F.struct((at + 1).alias("start"), F.length(p.s).alias("length"))))
    formatted = F.array_join(F.transform("pieces", lambda p: p.s), "")
    return pieces.select("conv_id", formatted.alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def _running(lengths: Column) -> Column:
    """The sum of the lengths before each: inside slices as long as there are slices, then over these, as an array that
    grows is copied at each step."""
    let = lambda value, f: F.transform(F.array(value), f)[0]

    def sums(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, start, lambda s, x: F.struct((s.at + x).alias("at"), F.concat(s.out, F.array(s.at)).alias("out")), lambda s: s.out)

    def sliced(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        parts = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.size(a) - 1, w), lambda i: F.slice(a, i + 1, w)))
        return let(parts, lambda ps: F.flatten(F.zip_with(sums(F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda x, y: x + y))), ps, lambda before, p: F.transform(sums(p), lambda x: x + before))))

    return let(lengths, sliced)


def parse_chats(formatted: DataFrame, col: str = "formatted") -> DataFrame:
    """Add ``turns`` (role, text), read back from the formatted string alone."""
    blocks = F.filter(F.split(F.col(col), r"<\|im_end\|>\n", -1), lambda b: F.startswith(b, F.lit(START)))

    def block(b: Column) -> Column:
        body = F.substring(b, len(START) + 1, 2_000_000_000)
        cut = F.instr(body, "\n")
        texts = F.split(F.substring(body, cut + 1, F.length(body)), r"<\|im_next\|>", -1)
        return F.transform(texts, lambda t: F.struct(_role_back(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(t).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, block)))


#: Parts that a string is cut into before its spans are read, and how often: of 16^4 spans each is then alone in its part.
WAYS, CUTS = 16, 4


def read_spans(text: Column, spans: Column) -> Column:
    """The parts of ``text`` at ``spans`` (start, length; in code points, in order), as an array.

    A place in a string is found by walking there, so spans are not read from the whole string one by one: the string is cut at every
    sixteenth part of its spans, the parts again, and so on, each with its own spans. Each time a string is walked
    a fixed number of times."""
    part = lambda t, before, s: F.struct(t.alias("text"), before.alias("before"), s.alias("spans"))

    def cut(p: Column) -> Column:
        n = F.size(p.spans)
        w = F.ceil(n / WAYS).cast("int")
        start = lambda i: F.when(i == 0, 1).otherwise(F.get(p.spans, i * w).start - p.before)  # noqa: E731  from 1, in the part
        end = lambda i: F.coalesce(F.get(p.spans, (i + 1) * w).start - p.before, F.lit(2_000_000_000))
        own = lambda i: part(F.substring(p.text, start(i), end(i) - start(i)), p.before + start(i) - 1, F.slice(p.spans, i * w + 1, w))
        return F.when(n < 2, F.array(p)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / w).cast("int")), own))

    parts = F.array(part(text, F.lit(0), spans))
    for _ in range(CUTS):
        parts = F.flatten(F.transform(parts, cut))
    return F.flatten(F.transform(parts, lambda p: F.transform(p.spans, lambda s: F.substring(p.text, s.start - p.before, s.length))))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings hold: the turns, and the text under the loss mask."""
    read = parse_chats(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform(read_spans(F.col("formatted"), F.col("loss_spans")), unescape), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
