"""Main text of web pages: templates deduced from token equivalence classes of same-host pages, then slots extracted."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm._common import table

#: A class of tokens belongs to a template if it is on at least this share of the host's pages, two at least, and has so many tokens.
LEAST_SHARE, LEAST_PAGES, LEAST_TOKENS = 0.2, 2, 2
#: (host, token) sums that a task holds before it hands them on.
HELD = 200_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
RAW = {x: re.compile(rf"</{x}\s*[^>]*>|\Z", re.I) for x in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "object", "canvas")}
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "math", "mi", "mn", "mo", "mrow", "msup", "msub", "mfrac", "msqrt", "mtext"}
#: An opening tag of these ends an open one of the same set, as in HTML's rules for omitted end tags.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = {"article", "aside", "div", "section", "nav", "header", "footer", "form", "main", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure"}
APART = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "datalist", "fieldset"}
APART_NAME = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|footer|sidebar|side|aside|ads?|adverts?|advertisement|banner|promo|sponsor(?:ed)?|cookies?|consent|notices?|popup|modal|newsletter|subscribe|share|sharing|social|related|comments?|disqus|breadcrumbs?|pagination|widgets?|copyright|login|signup|search|toolbar|skip|contentinfo|complementary)(?:$|[\s_-])", re.I)
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story)(?:$|[\s_-])", re.I)
#: Names of a layout that only says what else the page has.
HAS = re.compile(r"(?:^|[_-])(?:has|have|with|without|no)(?:[_-]|$)", re.I)
#: Elements whose names may set them apart within an article: containers. A paragraph or heading there is text, whatever its name.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "tbody", "figure", "details", "center", "header", "custom"}


def set_apart(names: str) -> bool:
    """Whether a class, id or role names a menu, notice, advert or the like; ``has-sidebar`` and ``page-with-menu`` don't."""
    return any(APART_NAME.search(x) and not HAS.search(x) for x in names.split())


@dataclass(slots=True)
class Event:
    """An opening tag (``text`` is None) or a run of text, under its path of enclosing elements."""

    path: tuple[str, ...]
    apart: bool
    main: bool
    text: str | None = None
    block: int = 0

    def token(self) -> int:
        key = "/".join(self.path) + ("" if self.text is None else "\0" + self.text.strip())
        token = int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        # The last bit tells structure from text.
        return token | 1 if self.text is None else token & ~1


def events(page: str) -> Iterator[Event]:
    """Tags and texts in page order; comments, scripts, styles and the like are left out, unclosed tags closed as browsers do."""
    stack: list[tuple[str, str, bool, bool]] = []
    block, at = 0, 0
    path: tuple[str, ...] = ()
    while at < len(page):
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            yield Event(path, bool(stack) and stack[-1][2], bool(stack) and stack[-1][3], html.unescape(text), block)
        if not m:
            return
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in INLINE:
            continue
        if name == "br":
            yield Event(path, bool(stack) and stack[-1][2], bool(stack) and stack[-1][3], " ", block)
            continue
        block += 1
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            path = tuple(x[1] for x in stack)
            continue
        if name in RAW:
            at = RAW[name].search(page, at).end()
            continue
        if name in VOID:
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ENDS.get(name, ()) or (name in CLOSES_P and stack[k][0] == "p"):
                del stack[k:]
            elif stack[k][0] not in ("p", "li", "dt", "dd", "td", "th", "tr", "option") or name not in ENDS:
                break
        named = {a.lower(): (b or c or d) for a, b, c, d in ATTRIBUTE.findall(m[3] or "")}
        names = " ".join(named.values())
        inside = bool(stack) and stack[-1][3]
        # An article or main element is not set apart by the names of what encloses it, only by its tags.
        outer = bool(stack) and stack[-1][2] and not (name in ("article", "main") and not any(x[0] in APART for x in stack))
        named_apart = name not in ("html", "body") and (not inside or name in CONTAINERS or "-" in name) and set_apart(names)
        apart = outer or name in APART or (name == "header" and not inside) or named_apart
        main = inside or name in ("article", "main") or named.get("role", "").lower() == "main" or (name in ("div", "section") and bool(names and MAIN_NAME.search(names)))
        stack.append((name, name + "".join(f".{x}" for x in sorted(names.split())), apart, main))
        path = tuple(x[1] for x in stack)
        yield Event(path, apart, main)


def host(url: F.Column) -> F.Column:
    """Lower-case host of a URL; null or odd URLs share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def occurrences(pages: DataFrame) -> DataFrame:
    """``host, token, vector, pages, low, high``: of each token its occurrence vector over the host's pages.

    The vector is kept as the sum, modulo 2**64, of each page's hash times the token's count there: equal vectors have equal
    sums, and sums of parts add up, so that a hot host is summed in its tasks first and never meets in one.
    ``low`` and ``high`` are the token's least and greatest place among a page's tokens.
    """
    schema = "host string, token bigint, vector bigint, pages bigint, low bigint, high bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, t, v - (1 << 64) if v >= 1 << 63 else v, n, a, b) for (h, t), (v, n, a, b) in held.items()]
            held.clear()
            kinds = (pa.string(), *[pa.int64()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for h, u, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mark = int.from_bytes(hashlib.blake2b(f"{u}\0{page}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1
                seen: dict[int, list[int]] = {}
                place = 0
                for e in events(page or ""):
                    if e.text is None or e.text.strip():
                        x = seen.setdefault(e.token(), [0, place])
                        x[0] += 1
                        place += 1
                for t, (n, first) in seen.items():
                    x = held.setdefault((h, t), [0, 0, first, first])
                    x[0] = (x[0] + n * mark) & 0xFFFFFFFFFFFFFFFF
                    x[1] += 1
                    x[2], x[3] = min(x[2], first), max(x[3], first)
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    # bigint sums wrap around when ANSI checks are off; halves keep them exact either way.
    some = pages.select(host(F.col("url")).alias("host"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)
    low32 = F.sum(F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF)))
    high32 = F.sum(F.shiftrightunsigned("vector", 32))
    both = some.groupBy("host", "token").agg(low32.alias("l"), high32.alias("h"), F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"))
    mask = F.lit(0xFFFFFFFF)
    carry = (F.col("h") + F.shiftright("l", 32)).bitwiseAND(mask)
    return both.select("host", "token", F.shiftleft(carry, 32).bitwiseOR(F.col("l").bitwiseAND(mask)).alias("vector"), "pages", "low", "high")


def templates(pages: DataFrame) -> DataFrame:
    """``host, template``: the tokens of the host's valid classes, from the outermost class inwards.

    Tokens with one occurrence vector form a class. It is valid if it has enough tokens on enough pages, a tag among them,
    and its tokens' order by first and by last place agrees: texts alone that pages share are passages they quote. Classes nest by support: one on fewer pages stands in slots of those on more.
    """
    counts = pages.select(host(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("host_pages"))
    tokens = occurrences(pages).where(F.col("pages") >= LEAST_PAGES).join(counts, "host").where(F.col("pages") >= LEAST_SHARE * F.col("host_pages"))
    member = F.struct("low", "high", "token")
    classes = tokens.groupBy("host", "vector", "pages").agg(F.sort_array(F.collect_list(member)).alias("members")).where(F.size("members") >= LEAST_TOKENS).where("exists(members, m -> m.token % 2 <> 0)")
    ordered = F.expr("forall(sequence(1, size(members) - 1), i -> members[i].high >= members[i - 1].high)")
    return classes.where(ordered).groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("support"), F.col("members.token").alias("tokens")))).alias("classes")).select("host", F.flatten("classes.tokens").alias("template"))


def slots(page: str, template: set[int]) -> str:
    """The main slots' text: blocks joined by one space.

    A page's tokens that are not the template's fill its slots. Slots under an article or main element are main ones; where
    those hold little but template, and on a page without any, all outside menus, notices and the like are. A page most of
    whose text is the template's is a copy of its host's others, for the template is what differing pages share: it keeps all.
    """
    found = [e for e in events(page) if e.text is not None]
    size = lambda some: sum(len(e.text.strip()) for e in some)
    levels = [[e for e in found if e.main and not e.apart], [e for e in found if not e.apart and e.path]]
    levels = [x for x in levels if size(x)] or [[e for e in found if not e.path]]
    main = levels[0]
    for level in levels:
        own = [e for e in level if not e.text.strip() or e.token() not in template]
        if 2 * size(own) >= size(level):
            main = own
            break
    blocks: dict[int, list[str]] = {}
    for e in main:
        blocks.setdefault(e.block, []).append(e.text)
    return " ".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row.

    A null html counts as empty and gives an empty text; null ids and URLs stay null, a null URL's host is empty; repeated
    rows give repeated results; hosts of one page have no template and rest on the page alone. An empty table gives none.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    # A template is bounded by its host's pages' tokens over LEAST_SHARE; whether the hosts' templates are broadcast is left to their size.
    rows = rows.join(templates(pages), "host", "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [slots(h or "", set(t or ())) for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
SQL: dict[str, str] = {}
