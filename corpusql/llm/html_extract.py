"""Main text of web pages by template deduction.

Pages of one host share a template. Its tokens are elements (by their path of tags, classes
and ids) and blocks of text under such a path. How often a token occurs on each page is its occurrence
vector, and tokens with equal vectors form an equivalence class. Classes of at least two
tokens that occur on most of a host's pages are candidates. A candidate is cut down to the tokens
that stand in one order on every page, and it is valid if it crosses no other class and stands in one
place of the class around it. The valid classes are the host's template; what lies between their tokens
is slots. The main text is the slots inside the article (or main part) that no menu, header, footer,
sidebar, notice, advert, form, script, style or comment section encloses; template blocks in them are
left out, except where a page does not follow their class.

Vectors are never gathered: a token's vector is the sum modulo 2^64 of a hash for each page it
is on, so that repeated rows tell tokens apart too; tasks and Spark fold it, also for the host that has a third of all pages. The
template of a host is as long as what its pages have in common. Orders and places are folded by class
in the same way: the tokens of each page, in order, are written once and read again for each step.
"""

from __future__ import annotations

import html as markup
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import written

#: A class is valid on at least so many pages and this share of the host's pages.
MIN_PAGES = 10
SHARE = 0.9
FLUSH = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: Elements that a new one of the same group ends.
ENDS = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
OUTSIDE = frozenset(
    "head nav footer aside form script style noscript template iframe svg button select textarea menu "
    "dialog object canvas audio video math".split()
)
MAIN = frozenset(("article", "main"))
OUTSIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|menu|nav|navbar|navigation|breadcrumbs?|sidebar|"
    r"widget|footer|comments?|disqus|replies|cookies?|consent|notice|alert|popup|modal|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|pagination|pager|toolbar)(?:$|[\s_-])",
    re.I,
)
#: Names of page layouts that may hold the article beside the part they are named after.
LAYOUT_NAMES = re.compile(
    r"^(?:(?:with|has|no|without)[_-][\w-]+|sidebars?[_-](?:layout|page)|(?:content|main|page)[_-]sidebars?[_-]"
    r"(?:layout|wrap|wrapper|container)|(?:both|two|one|double|single)[_-]sidebars?)$",
    re.I,
)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z)", re.S)
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\s(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HOST = re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def digest(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


class Element:
    """``barred``: no article in it is main text; ``outside``: that, or a layout's name says so."""

    __slots__ = ("tag", "path", "barred", "outside", "main")

    def __init__(self, tag: str, path: str, barred: bool, outside: bool, main: bool):
        self.tag, self.path, self.barred, self.outside, self.main = tag, path, barred, outside, main


def events(page: str) -> Iterator[tuple[str, Element | None, str]]:
    """("open" | "text" | "cut", innermost element, text) in page order.

    ``cut`` marks the border of a block. Tags may be left open, closed twice or cut off;
    scripts and other raw elements reach to their own end tag or to the end of the page.
    """
    stack: list[Element] = [Element("", "", False, False, False)]
    at = 0
    while at <= len(page):
        found = TOKEN.search(page, at)
        end = found.start() if found else len(page)
        if end > at:
            yield "text", stack[-1], page[at:end]
        if not found:
            return
        at = found.end()
        token = found[0]
        name = TAG.match(token)
        if not name:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            if tag in BLOCKS:
                yield "cut", stack[-1], ""
            continue
        if tag in BLOCKS and stack[-1].tag != "":
            # A block ends an open paragraph and the formatting left open in it.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in ENDS:
            closes, scope = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in scope:
                    break
                if stack[i].tag in closes.split():
                    del stack[i:]
                    break
        names = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(token[len(name[0]):])}
        sign = ".".join([tag, *sorted(names.get("class", "").split()), *names.get("id", "").split()])
        top = stack[-1]
        named = f"{names.get('class', '')} {names.get('id', '')} {names.get('role', '')}"
        main = top.main or tag in MAIN or names.get("role") == "main"
        barred = top.barred or tag in OUTSIDE or "hidden" in names or (tag == "header" and not top.main)
        outside = barred or top.outside and tag not in MAIN
        if tag not in ("html", "body", *MAIN):
            for name in named.split():
                if OUTSIDE_NAMES.search(name) or not top.main and HEADER_NAMES.search(name):
                    outside = True
                    # Only a layout around the article is forgiven what its name says.
                    barred = barred or not LAYOUT_NAMES.match(name)
        element = Element(tag, f"{top.path}/{sign}", barred, outside, main)
        if tag in BLOCKS:
            yield "cut", element, ""
        yield ("break" if tag == "br" else "open"), element, ""
        if tag in VOID or token.endswith("/>") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        stack.append(element)


def blocks(page: str) -> Iterator[tuple[str, Element | None, str]]:
    """("open", element, "") and, where no outside element encloses it, ("block", element, text).

    A block's element is the one its text begins in; its text has its character references
    decoded and its white space folded.
    """
    parts: list[str] = []
    home: Element | None = None
    for kind, element, text in events(page):
        if kind == "cut" or (home is not None and element.main != home.main):
            if block := " ".join("".join(parts).split()):
                yield "block", home, block
            parts.clear()
            home = None
        if kind == "cut":
            continue
        if kind in ("open", "break"):
            yield "open", element, ""
        if element.outside:
            continue
        if kind == "break":
            parts.append(" ")
        elif kind == "text":
            if home is None and not text.isspace():
                home = element
            parts.append(markup.unescape(text))
    if block := " ".join("".join(parts).split()):
        yield "block", home, block


def page_sequence(page: str) -> list[int]:
    """Template tokens of a page in page order."""
    return [
        digest(element.path) if kind == "open" else digest(element.path, text)
        for kind, element, text in blocks(page)
    ]


def page_tokens(page: str) -> Counter:
    """Template tokens of a page and how often they occur."""
    return Counter(page_sequence(page))


Classes = Sequence[Sequence[int]]


def class_sequences(tokens: Iterable[int], classes: Classes) -> dict[int, list[int]]:
    """Number of each class that occurs, and its tokens in page order."""
    home = {token: c for c, own in enumerate(classes) for token in own}
    found: dict[int, list[int]] = {}
    for token in tokens:
        if (c := home.get(token)) is not None:
            found.setdefault(c, []).append(token)
    return found


def displaced(sequence: list[int], order: Sequence[int]) -> set[int]:
    """Tokens to leave out, as few as can be, so that the rest repeats ``order`` again and again.

    All of them if a turn lacks a token or has one twice.
    """
    n, out = len(order), set()
    place = {token: i for i, token in enumerate(order)}
    for at in range(0, len(sequence), n):
        turn = sequence[at : at + n]
        if turn == list(order):
            continue
        if set(turn) != place.keys():
            return set(order)
        # Longest rising run of places; ends[i] is the least end of runs of i + 1 places.
        ends: list[int] = []
        before: dict[int, int | None] = {}
        for k in [place[token] for token in turn]:
            i = bisect_left(ends, k)
            before[k] = ends[i - 1] if i else None
            ends[i : i + 1] = [k]
        k, kept = ends[-1], set()
        while k is not None:
            kept.add(order[k])
            k = before[k]
        out |= place.keys() - kept
    return out


class Places:
    """Open classes while the tokens of a page are read in order; the last one opened is innermost."""

    def __init__(self, classes: Classes):
        self.classes = classes
        self.open: list[int] = []
        self.passed: dict[int, int] = {}

    def inner(self) -> tuple[int, int] | None:
        """The innermost open class and how many of its tokens have been passed."""
        return (self.open[-1], self.passed[self.open[-1]]) if self.open else None

    def read(self, c: int) -> tuple[tuple[int, int] | None, list[int]]:
        """Goes past a token of class ``c``: the place it opens in, if it is the first, and the classes it crosses."""
        n, at = len(self.classes[c]), self.passed.get(c, 0)
        around, crossed = None, []
        if at == 0:
            around = self.inner()
            self.open.append(c)
        else:
            crossed = self.open[self.open.index(c) + 1 :]
        self.passed[c] = (at + 1) % n
        if at + 1 == n:
            self.open.remove(c)
        return around, crossed


def slots(page: str, template: Classes) -> list[tuple[tuple[int, int] | None, bool, list[str]]]:
    """What lies between the tokens of the template, in page order: place, whether in the main part, blocks.

    A place is the innermost open class and how many of its tokens stand before the slot. Classes
    whose order the page does not follow are no template here.
    """
    found = list(blocks(page))
    home: dict[int, int] = {}
    tokens: list[int | None] = [None] * len(found)
    if template:
        tokens = [digest(e.path) if kind == "open" else digest(e.path, text) for kind, e, text in found]
        for c, sequence in class_sequences(tokens, template).items():
            own = list(template[c])
            if sequence == own * (len(sequence) // len(own)):
                home |= dict.fromkeys(own, c)
    places = Places(template if template else ())
    out: list[tuple[tuple[int, int] | None, bool, list[str]]] = []
    fresh = True
    for token, (kind, element, text) in zip(tokens, found):
        if (c := home.get(token)) is not None:
            places.read(c)
            fresh = True
        elif kind == "block":
            if fresh or out[-1][1] != element.main:
                out.append((places.inner(), element.main, []))
                fresh = False
            out[-1][2].append(text)
    return out


def main_text(page: str, template: Classes) -> str:
    """Blocks of the article's slots, joined by line feeds; blocks of the template are in none.

    Pages without an article or a main part, or with no text in it, count as a whole.
    Articles in menus, sidebars, comments and the like are none.
    """
    found = slots(page, template)
    parts = [texts for _, main, texts in found if main] or [texts for _, _, texts in found]
    return "\n".join(text for texts in parts for text in texts)


def _sequence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, owns, tokens = [], [], []
        for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns)):
            page = page or ""
            hosts.append(digest(host_of(url)))
            owns.append(digest(page_id, url, page))
            tokens.append(page_sequence(page))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.int64()), pa.array(owns, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))],
            ["host", "own", "tokens"],
        )


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, vector, pages), folded as far as a task has seen; token 0 counts pages."""
    folded: dict[tuple[int, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(*k, (vector + (1 << 63)) % (1 << 64) - (1 << 63), n) for k, (vector, n) in folded.items()]
        columns = zip(*rows) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["host", "token", "vector", "pages"]
        )

    for batch in batches:
        for host, own, sequence in zip(*(c.to_pylist() for c in batch.columns)):
            tokens = Counter(sequence)
            tokens[0] = 1
            for token, count in tokens.items():
                cell = folded.setdefault((host, token), [0, 0])
                cell[0] += digest(own, count)
                cell[1] += 1
        if len(folded) > FLUSH:
            yield out()
            folded.clear()
    yield out()


def _by_page(fold: Callable, names: list[str], types: list[pa.DataType]) -> Callable:
    """A job over (host, own, tokens, classes): ``fold(state, host, own, tokens, classes)`` for each page.

    ``state`` is a dict of key to value tuples; rows are both, given out whenever it is large.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, tuple] = {}

        def out() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in state.items()]
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for host, own, tokens, classes in zip(*(c.to_pylist() for c in batch.columns)):
                fold(state, host, own, tokens, classes)
            if len(state) > FLUSH:
                yield out()
                state.clear()
        yield out()

    return job


def _first_orders(state: dict, host: int, own: int, tokens: list[int], classes: Classes) -> None:
    """By host and class: the order on the page of smallest hash."""
    for c, sequence in class_sequences(tokens, classes).items():
        if (host, c) not in state or own < state[host, c][0]:
            state[host, c] = own, sequence[: len(classes[c])]


def _displaced(state: dict, host: int, own: int, tokens: list[int], classes: Classes) -> None:
    """By host and token: those that a page has in another order."""
    for c, sequence in class_sequences(tokens, classes).items():
        for token in displaced(sequence, classes[c]):
            state[host, token] = ()


def _nestings(state: dict, host: int, own: int, tokens: list[int], classes: Classes) -> None:
    """By host, class and the class around it: least and greatest place in it; -1 and 0 if they cross.

    Of two that cross, the one of fewer tokens is named first.
    """
    home = {token: c for c, own_tokens in enumerate(classes) for token in own_tokens}
    places = Places(classes)

    def note(inner: int, outer: int, low: int, high: int) -> None:
        before = state.get((host, inner, outer), (low, high))
        state[host, inner, outer] = min(low, before[0]), max(high, before[1])

    for token in tokens:
        if (c := home.get(token)) is None:
            continue
        around, crossed = places.read(c)
        if around:
            note(c, around[0], around[1], around[1])
        for d in crossed:
            less, more = sorted((c, d), key=lambda x: (len(classes[x]), x))
            note(less, more, -1, 0)


def _sum_64(name: str) -> Column:
    """Sum modulo 2^64, from the sums of both halves."""
    low = F.sum(F.col(name).bitwiseAND(0xFFFFFFFF))
    high = F.sum(F.shiftrightunsigned(name, 32))
    carried = F.shiftleft(high + F.shiftrightunsigned(low, 32), 32)
    return carried.bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


def _valid(sequences: DataFrame, candidates: DataFrame) -> DataFrame:
    """host and classes: the candidates less tokens out of order, each in order; crossing and moving ones are gone."""
    long, longs = pa.int64(), pa.list_(pa.int64())

    def over_pages(classes: DataFrame, fold: Callable, names: list[str], types: list[pa.DataType], ddl: str) -> DataFrame:
        return sequences.join(classes, "host").select("host", "own", "tokens", "classes").mapInArrow(
            _by_page(fold, names, types), ddl
        )

    def listed(classes: DataFrame, name: str) -> DataFrame:
        """One row for each host; classes come in the order of their tokens' numbers."""
        return written(classes.groupBy("host").agg(F.sort_array(F.collect_list("class")).alias("classes")), name)

    first = (
        over_pages(candidates, _first_orders, ["host", "c", "own", "class"], [long, long, long, longs],
                   "host long, c long, own long, class array<long>")
        .groupBy("host", "c").agg(F.min(F.struct("own", "class")).getField("class").alias("class"))
    )
    first = listed(first, "orders")
    moved = (
        over_pages(first, _displaced, ["host", "token"], [long, long], "host long, token long")
        .groupBy("host").agg(F.collect_set("token").alias("moved"))
    )
    kept = F.filter("class", lambda token: ~F.array_contains(F.coalesce("moved", F.array().cast("array<long>")), token))
    ordered = (
        first.select("host", F.explode("classes").alias("class")).join(moved, "host", "left")
        .select("host", kept.alias("class")).where(F.size("class") >= 2)
    )
    ordered = listed(ordered, "ordered")
    wrong = (
        over_pages(ordered, _nestings, ["host", "c", "outer", "low", "high"], [long] * 5,
                   "host long, c long, outer long, low long, high long")
        .groupBy("host", "c", "outer").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where("low <> high").select("host", "c").distinct()
    )
    return (
        ordered.select("host", F.posexplode("classes").alias("c", "class"))
        .withColumn("c", F.col("c").cast("long")).join(wrong, ["host", "c"], "left_anti")
        .groupBy("host").agg(F.sort_array(F.collect_list("class")).alias("classes"))
    )


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """host (hashed), classes: its valid equivalence classes, tokens in order, and template: all their tokens."""
    sequences = written(
        pages.select("page_id", "url", "html").mapInArrow(_sequence_rows, "host long, own long, tokens array<long>"),
        "sequences",
    )
    folded = (
        sequences.mapInArrow(_vector_rows, "host long, token long, vector long, pages long")
        .groupBy("host", "token").agg(_sum_64("vector").alias("vector"), F.sum("pages").alias("pages"))
        # What is on fewer pages can be on most pages of no host that counts.
        .where(F.col("pages") >= min_pages * share)
    )
    folded = written(folded, "vectors")
    hosts = folded.where("token = 0").select("host", F.col("pages").alias("all_pages")).where(F.col("all_pages") >= min_pages)
    frequent = folded.where("token <> 0").join(hosts, "host").where(F.col("pages") >= share * F.col("all_pages"))
    candidates = (
        frequent.groupBy("host", "vector").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
        .where(F.size("tokens") >= 2)
        .groupBy("host").agg(F.sort_array(F.collect_list("tokens")).alias("classes"))
    )
    valid = _valid(sequences, written(candidates, "classes"))
    return valid.withColumn("template", F.flatten("classes"))


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """Per page: page_id, url and text, the main text.

    Null pages have an empty text. Pages without a url share one nameless host. Hosts with
    fewer than ``min_pages`` pages have no template; the rest of the rules holds for them.
    Repeated rows give a row each. Only page_id, url and html are read.
    """
    # Written first, so that its real size decides how it is joined.
    known = written(templates(pages, min_pages, share).select("host", "classes"), "templates")

    def host_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = [digest(host_of(u)) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.int64())], [*batch.schema.names, "host"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(page.as_py() or "", classes.as_py() or [])
                for page, classes in zip(batch.column("html"), batch.column("classes"))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    own = pages.select(F.col("page_id").cast("long"), "url", "html")
    return (
        own.mapInArrow(host_rows, "page_id long, url string, html string, host long")
        .join(known, "host", "left").select("page_id", "url", "html", "classes")
        .mapInArrow(extract, "page_id long, url string, text string")
    )


def page_digests(pages: DataFrame) -> DataFrame:
    return extracted(pages).withColumn("n_chars", F.length("text").cast("long"))
