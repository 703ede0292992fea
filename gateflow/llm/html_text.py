"""Main text of web pages by equivalence-class template deduction.

Same-host pages come from templates. Every tag of a page, told apart by the blocks around it and a container's number among alike ones, is a token, and so is a text
block whose place does not say what it is. The occurrence vector of a token is how often each page of the host has it; tokens
with equal vectors are an equivalence class (Arasu and Garcia-Molina, 2003). Classes of two tokens and more that a good
part of the pages have, and that lie inside a gap of one another or apart, nest into the host's template; what stands in their
gaps are slots. Text that is itself a token of the template is constant and falls; the slots with the prose are extracted.

Vectors are never built: a task adds up two 31-bit hashes of (page, times) for each token, sums of sums are made by Spark, and
equal sums are equal vectors. So a host with a third of all pages is a few hundred rows a task."""

from __future__ import annotations

import html
import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, stage
from .urls import url_host_path

# --- what markup says by itself (fixed values) ---------------------------------------------------------------------

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that can hold the text of a page; a paragraph, a heading or a cell belongs to the nearest of them.
CONTAINERS = frozenset("html body div section article main center details fieldset td".split())
#: Elements that are never main text, and those in which not even an article is.
NOT_TEXT = frozenset("head nav header footer aside menu form button select textarea script style noscript iframe template svg object audio video canvas dialog title label".split())
NEVER = frozenset("head footer aside script style noscript iframe template svg dialog title".split())
#: Words in class, id or role that tell the same, and those that make a name harmless ("with-sidebar", "article-header").
NOT_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promoted sponsor sponsored sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus replies respond pagination pager "
    "widget complementary contentinfo search".split()
)
NEVER_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsored cookie cookies consent related recommended comment comments disqus replies footer contentinfo".split())
HARMLESS_WORDS = frozenset("has with without no is main content article body wrapper page container post entry".split())

TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

OPEN, MAIN, DROP, NEVER_TEXT = range(4)  # what the place of a text says: nothing, main text, no text, no text whatever is inside
#: A template token is on this part of the host's pages at least, a constant text on this part, where there are so many pages.
TOKEN_SHARE, CONSTANT_SHARE, CONSTANT_PAGES = 0.1, 0.9, 3
#: A container is extracted with this part of the prose of the best one.
PROSE_SHARE = 0.25
#: Template bytes of all hosts up to which every task holds them; beyond, pages are joined with them by host.
HELD_BYTES = 32 << 20
#: Tokens that a task counts before it hands them on.
TASK_TOKENS = 100_000
PAGE, ROOT = 0, 1  # the token that counts the pages of a host, and that of what stands outside of all elements


def _hash(*parts) -> int:
    return int.from_bytes(blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Markup:
    """What tags say, remembered by (path of the parent, tag, attributes)."""

    def __init__(self):
        self.seen: dict = {}

    def element(self, parent: int, tag: str, attributes: str) -> tuple[int, int | None, bool]:
        """(path, what it says of its text if anything, whether it says so by tag or names of its own)."""
        named = attributes and NAMES.findall(attributes)
        key = (parent, tag, tuple(named) if named else ())
        found = self.seen.get(key)
        if found is None:
            if len(self.seen) > TASK_TOKENS:
                self.seen.clear()
            found = self.seen[key] = self._judge(parent, tag, [(n.lower(), a or b or c) for n, a, b, c in named or ()])
        return found

    def nth(self, path: int, n: int) -> int:
        if n == 1:
            return path
        found = self.seen.get((path, n))
        if found is None:
            found = self.seen[path, n] = _hash(path, n)
        return found

    @staticmethod
    def _judge(parent: int, tag: str, named: list[tuple[str, str]]):
        says = None
        tokens = [t for _, v in named for t in v.split()]
        if tag not in ("html", "body"):
            bad = set()
            for token in tokens:
                words = {w.lower() for w in WORDS.findall(token)}
                if not words & HARMLESS_WORDS:
                    bad |= words & NOT_TEXT_WORDS
            if tag in NEVER or bad & NEVER_WORDS:
                says = NEVER_TEXT
            elif tag in NOT_TEXT or bad:
                says = DROP
            elif tag in ("article", "main") or ("role", "main") in named or ("itemprop", "articleBody") in named:
                says = MAIN
        return _hash(parent, tag, *sorted(re.sub(r"\d+", "", t) for n, v in named if n in ("class", "id") for t in v.split())), says


def walk(page: str, markup: Markup):
    """Events of a page: ``("tag", token, path, container)``, ``("text", path, container, place, in a link, text)`` and ``("block",)``
    where a block ends. Character references are decoded. Unclosed paragraphs and items end where the next begins."""
    stack = [("", ROOT, OPEN, ROOT)]  # tag, path, what its text is, container
    times: dict = {}  # containers are told apart by their number among alike ones of their parent
    yield "tag", ROOT, PAGE, ROOT
    at, link = 0, False
    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            _, path, place, container = stack[-1]
            yield "text", path, container, place, link, html.unescape(page[at:lt])
        if lt >= n:
            return
        m = TAG.match(page, lt)
        if m is None:  # a bare <
            _, path, place, container = stack[-1]
            yield "text", path, container, place, link, "<"
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        top = stack[-1]
        if m[1]:
            if tag == "a":
                link = False
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if tag in BLOCKS:
                yield ("block",)
            yield "tag", _hash(stack[k][1] if k else top[1], "/", tag), top[1], top[3]
            if k:
                del stack[k:]
            continue
        if tag in BLOCKS:
            yield ("block",)
            if stack[-1][0] == "p":
                stack.pop()
            ends, stop = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",))}.get(tag, ((), ()))
            for k in range(len(stack) - 1, 0, -1) if ends else ():
                if stack[k][0] in stop:
                    break
                if stack[k][0] in ends:
                    del stack[k:]
                    break
        _, parent, place, container = stack[-1]
        path, says = markup.element(parent, tag, m[3])
        if says is not None and place != NEVER_TEXT and (place != DROP or says != DROP):
            # an article is main text wherever no stronger word stands around it; its heading is, even in its header
            place = says if not (place == MAIN and tag == "header") else MAIN
        if tag in CONTAINERS:
            times[path] = times.get(path, 0) + 1
            path = markup.nth(path, times[path])
        own = path if tag in CONTAINERS else container
        yield "tag", path, parent, own
        if tag == "a":
            link = True
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            stack.append((tag, path, NEVER_TEXT, container))
        elif tag not in VOID and (tag in BLOCKS or says is not None):
            stack.append((tag, path, place, own))


def _clean(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


def blocks(page: str, markup: Markup):
    """Text blocks in page order: (path, container, place, characters in links, text), and ``(token, parent, container)`` for tags."""
    held: dict = {}  # place of the pieces of the block being read
    for event in walk(page, markup):
        if event[0] == "text":
            _, path, container, place, link, text = event
            if place != NEVER_TEXT:
                pieces = held.setdefault((path, container, place), [[], 0])
                pieces[0].append(text)
                pieces[1] += len(text.strip()) if link else 0
        elif event[0] == "tag":
            yield event[1:]
        elif held:
            yield from _flush(held)
    yield from _flush(held)


def _flush(held: dict):
    for (path, container, place), (pieces, links) in held.items():
        text = _clean(pieces)
        if text:
            yield path, container, place, links, text
    held.clear()


def _text_token(container: int, text: str) -> int:
    return _hash(container, "text", text)


# --- counting tokens --------------------------------------------------------------------------------------------------

COUNTS = ["pages", "sum_1", "sum_2", "first", "chars", "link_chars"]
TOKENS = "host string, token long, kind int, parent long, pages long, sum_1 long, sum_2 long, first long, chars long, link_chars long"
IS_PAGE, IS_TAG, IS_TEXT = range(3)


def _count(batches):
    """For every host and token of the task: pages, two sums of hashes of (page, times), sum of first places, and of a
    container the characters of its text whose place says nothing, in all and in links."""
    from pyspark import TaskContext

    markup, row, held = Markup(), TaskContext.get().partitionId() << 40, {}
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            row += 1
            seen: dict = {(host, PAGE): [IS_PAGE, 0, 1, 0, 0, 0]}
            for n, block in enumerate(blocks(page, markup)):
                if len(block) == 3:
                    token, parent, _ = block
                    seen.setdefault((host, token), [IS_TAG, parent, 0, n, 0, 0])[2] += 1
                elif block[2] == OPEN:
                    _, container, _, links, text = block
                    seen.setdefault((host, _text_token(container, text)), [IS_TEXT, container, 0, n, len(text), links])[2] += 1
            numbers = np.array([t[2] for t in seen.values()], dtype=np.uint64)
            with np.errstate(over="ignore"):
                h = mix64(np.uint64(row) * np.uint64(0x9E3779B97F4A7C15) + mix64(numbers))
            for (key, (kind, parent, _, first, chars, links)), one, two in zip(seen.items(), (h & np.uint64(0x7FFFFFFF)).tolist(), (h >> np.uint64(33)).tolist(), strict=True):
                sums = held.get(key)
                if sums is None:
                    held[key] = [kind, parent, 1, one, two, first, chars, links]
                else:
                    for k, v in enumerate((1, one, two, first, chars, links)):
                        sums[2 + k] += v
            if len(held) >= TASK_TOKENS:
                yield _counted(held)
                held = {}
    if held:
        yield _counted(held)


def _counted(held: dict):
    columns = [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64())]
    for k in range(8):
        columns.append(pa.array([v[k] for v in held.values()], pa.int32() if k == 0 else pa.int64()))
    return pa.RecordBatch.from_arrays(columns, ["host", "token", "kind", "parent", *COUNTS])


# --- the template of a host -------------------------------------------------------------------------------------------


def valid_classes(tokens: list[dict]) -> list[list[dict]]:
    """The equivalence classes of two tokens and more, in the order of their places, that nest: each lies in one gap of every
    class that is on more pages or larger, or outside of it. ``tokens`` with pages, sum_1, sum_2 and first (sum of places)."""
    groups: dict = {}
    for t in tokens:
        groups.setdefault((t["pages"], t["sum_1"], t["sum_2"]), []).append(t)
    place = lambda t: t["first"] / t["pages"]
    good: list[tuple[np.ndarray, list[dict]]] = []
    for members in sorted((g for g in groups.values() if len(g) > 1), key=lambda g: (-g[0]["pages"], -len(g), min(t["token"] for t in g))):
        members = sorted(members, key=lambda t: (place(t), t["token"]))
        places = np.array([place(t) for t in members])
        if all(np.searchsorted(of, places[0]) == np.searchsorted(of, places[-1]) or np.searchsorted(places, of[0]) == np.searchsorted(places, of[-1]) for of, _ in good):
            good.append((places, members))
    return [members for _, members in good]


def deduce(tokens: list[dict], n_pages: int) -> tuple[list[int], list[int], list[int]]:
    """(containers whose slots are extracted, other containers of the template, constant texts) of a host. ``tokens``: those on
    enough of its pages, with kind, token, parent, chars and link_chars beside the counts."""
    template = {t["token"]: t for members in valid_classes(tokens) for t in members}
    parent = {t["token"]: t["parent"] for t in tokens if t["kind"] == IS_TAG}
    constant = {k for k, t in template.items() if t["kind"] == IS_TEXT and n_pages >= CONSTANT_PAGES and t["pages"] >= CONSTANT_SHARE * n_pages}
    prose: dict[int, int] = {}
    for t in tokens:
        if t["kind"] == IS_TAG and t["chars"] or t["token"] in constant:
            at, steps = t["parent"] if t["token"] in constant else t["token"], 0
            own = at
            while at and at not in template and steps < 1000:  # what the template does not have goes with what is around it
                at, steps = parent.get(at, 0), steps + 1
            part = t["chars"] - 2 * t["link_chars"]
            prose[at or own] = prose.get(at or own, 0) + (-part if t["token"] in constant else part)
    best = max(prose.values(), default=0)
    takes = [c for c, p in prose.items() if p > 0 and p >= PROSE_SHARE * best]
    return sorted(takes), sorted(set(prose) - set(takes)), sorted(constant)


def _deduce(batches):
    for batch in batches:
        models = []
        for tokens, n in zip(batch.column("tokens").to_pylist(), batch.column("n").to_pylist(), strict=True):
            takes, skips, constant = deduce(tokens, n)
            models.append(np.array([len(takes), len(skips), *takes, *skips, *constant], dtype="<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(models, pa.binary())], ["host", "model"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, model) of the hosts of ``pages`` (host, html)."""
    counted = pages.mapInArrow(lean(_count), TOKENS).groupBy("host", "token").agg(F.min("kind").alias("kind"), F.min("parent").alias("parent"), *(F.sum(c).alias(c) for c in COUNTS))
    counted = stage(counted)
    hosts = counted.where(f"kind = {IS_PAGE}").select("host", F.col("pages").alias("n"))
    # what text a container has in all of the host, also where the single text is on too few pages to count
    own = counted.where(f"kind = {IS_TEXT}").groupBy("host", F.col("parent").alias("token")).agg(F.sum("chars").alias("own_chars"), F.sum("link_chars").alias("own_links"))
    tokens = counted.where(f"kind <> {IS_PAGE}").join(hosts, "host").where(f"pages >= {TOKEN_SHARE} * n and (pages > 1 or n = 1)").join(own, ["host", "token"], "left")
    of_tag = lambda c, o: F.when(F.col("kind") == IS_TAG, F.coalesce(o, F.lit(0))).otherwise(F.col(c)).alias(c)
    tokens = tokens.select("host", "n", F.struct("token", "kind", "parent", "pages", "sum_1", "sum_2", "first", of_tag("chars", "own_chars"), of_tag("link_chars", "own_links")).alias("t"))
    return stage(tokens.groupBy("host", "n").agg(F.collect_list("t").alias("tokens")).mapInArrow(lean(_deduce), "host string, model binary"))


# --- extraction ---------------------------------------------------------------------------------------------------------


def _model(model: bytes | None):
    if not model:
        return frozenset(), frozenset(), frozenset()
    x = np.frombuffer(model, dtype="<i8").tolist()
    n, m = x[:2]
    return frozenset(x[2 : 2 + n]), frozenset(x[2 + n : 2 + n + m]), frozenset(x[2 + n + m :])


def extract(page: str, markup: Markup, takes: frozenset, skips: frozenset, constant: frozenset) -> str:
    """The text of the main slots. Blocks whose place says main text are taken; a page without any gives the blocks of the
    template's main containers (a container outside of the template goes with the one around it), without constant texts."""
    main, slots, around = [], [], {0: 0}
    for block in blocks(page, markup):
        if len(block) == 3:
            token, parent, own = block
            if own == token:
                around.setdefault(own, parent)
            else:
                around.setdefault(token, parent)
            continue
        _, container, place, _, text = block
        if place == MAIN:
            main.append(text)
        elif place == OPEN and takes and not main:
            at, steps = container, 0
            while at and at not in takes and at not in skips and steps < 1000:
                at, steps = around.get(at, 0), steps + 1
            if at in takes and _text_token(container, text) not in constant:
                slots.append(text)
    return " ".join(main or slots)


def html_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", held_bytes: int = HELD_BYTES) -> DataFrame:
    """Main text of every page: the id, ``url``, ``text`` and ``n_chars`` (its code points).

    Where the markup says what a block is (article, main, nav, footer, aside, form, script, names like ``ad`` or ``comments``)
    it is believed, also on a host with one page. All else is decided by the template of the page's host: containers with a quarter of the prose
    of the best one, characters in links counted against, are its main slots; texts on nine tenths of three pages or more are constant. A
    page that has main text by its markup gives that alone, and a text repeated over pages stays there, since copies
    of an article are not a template. Templates are held by every task up to ``held_bytes``, beyond that pages are joined with theirs by host
    (a host with many pages is split by Spark at run time: one row a host stands on the other side).

    Text is decoded from character references; white space (Unicode, so also no-break spaces) inside a block is one space, blocks are
    joined in page order by one space, and nothing is cut.

    Defined edge cases: a null or empty html gives an empty text; a null url, or one without a host, belongs to the host with the
    empty name; broken markup is read as far as it goes (unclosed comments, scripts and tags end with the page); a page of any length
    is read whole in one task; repeated rows and null ids are read each; there are no ties; an empty table gives an empty result; other
    columns are not read."""
    host, _ = url_host_path(F.col(f"`{url_col}`").cast("string"))
    pages = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), host.alias("host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    models = templates(pages.select("host", "html"))
    size = models.agg(F.coalesce(F.sum(F.octet_length("model") + F.octet_length("host") + 64), F.lit(0))).first()[0]
    held = None
    if size <= held_bytes:
        held = df.sparkSession.sparkContext.broadcast({r.host: bytes(r.model) for r in models.collect()})
    else:
        pages = pages.join(models, "host", "left")

    def run(batches):
        markup, parsed = Markup(), {}
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            texts = []
            for i, (of, page) in enumerate(zip(hosts, batch.column("html").to_pylist(), strict=True)):
                if of not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[of] = _model(held.value.get(of) if held is not None else batch.column("model")[i].as_py())
                texts.append(extract(page, markup, *parsed[of]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    out = pages.mapInArrow(lean(run), f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
