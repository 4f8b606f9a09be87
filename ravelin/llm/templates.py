"""Main text of web pages: template deduction by equivalence classes of tokens, then extraction of the slots left.

A token is the path of an element (names and classes of what it is in), or of a text with a hash of it. Tokens of a
host that occur equally often on each of its pages are of one class; classes that are large and frequent are its
template, nested by their paths. Texts that nearly all pages with their element have are fixed. What is left between
the template's elements are slots; the element that holds most of their text over the host's pages is where its articles
are, and its slots are the main text of a page. Where a host has too few pages for a template, or a page has none of it,
the page's own article or main element takes that place, if it has one.

Marks of a page (elements like nav or form, words in classes) are weights: marked text counts a part of what other text
does when the element is chosen. Below the chosen element a marked one is left out, unless it holds so much text that it
outweighs all that is not marked; marks on it or above it say nothing. Only what is never text (scripts, styles, buttons,
what is hidden) is left out whatever the weights.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm._scratch import Scratch

#: HTML's void elements, its inline elements, and elements whose content is no running text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
DROPPED = frozenset("head script style noscript template iframe object svg canvas math audio video button select option textarea input".split())
#: Elements that are rarely what holds an article, and words in classes of such.
SELDOM = frozenset("nav footer aside menu dialog".split())
SELDOM_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|cookies?|consent|gdpr|menu|nav|navbar|navigation|footer|sidebar)(?:$|[\s_-])", re.I)
#: Elements that an opening tag of the same kind ends.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words in classes, ids and roles of what surrounds an article.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|advertising|adsense|banner|breadcrumbs?|comments?|cookies?|consent|copyright|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|overlay|pager|pagination|popup|promo|promotion|related|recommended|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|subscription|toolbar|widget|complementary|contentinfo|alert|search)(?:$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|textarea|title|noscript|template|iframe|xmp)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(?:(?!</\1[\s/>]).)*(?:</\1[^>]*>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")

#: Elements that hold running text; any other block below an article is a part of it that stands by itself.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd table thead tbody tr td th".split())

LEAST_PAGES, LEAST_CLASS = 5, 3  # distinct pages that a class is on, tokens that it has
LEAST_SHARE = 0.05  # of a host's pages, for a class: no host has more than 20 pages' worth of template
FIXED_SHARE = 0.9  # of the pages that have a text's element, for a fixed text
DOMINANT = 0.6  # share of an element's text that the element below it must hold to take its place
MARKED = 3.0  # weight of text in an element that the page marks as its article
DOWN, SELDOM_DOWN = 8, 50  # marked text counts one part in so many


class Slot:
    """A run of text between block boundaries, with the path of open elements above it, the path of the page's article
    above it, the paths of marked elements above it, outermost first, and how little text in them counts, the characters
    of it in links, and the number of the element that it stands in (running text counts to what it runs in)."""

    __slots__ = ("path", "text", "dropped", "article", "header", "box", "links", "marks", "down")

    def __init__(self, path: str, text: str, dropped: bool, article: str, header: bool, box: int = 0, links: int = 0, marks: tuple[str, ...] = (), down: int = 1):
        self.path, self.text, self.dropped, self.article, self.header, self.box, self.links, self.marks, self.down = path, text, dropped, article, header, box, links, marks, down

    @property
    def token(self) -> str:
        return f"{self.path}#{xxhash.xxh64_hexdigest(self.text)}"

    @property
    def own(self) -> int:
        """Characters outside links."""
        return max(0, len(self.text) - self.links)

    @property
    def chars(self) -> int:
        """What speaks for an article: characters outside links, fewer where the page marks it as something else."""
        return 0 if self.dropped or (self.header and not self.article) else self.own // self.down

    def mark_below(self, root: str) -> str | None:
        """The outermost marked element above it that is below ``root``."""
        return next((m for m in self.marks if len(m) > len(root) and m.startswith(f"{root}/")), None)


def parse(source: str | None) -> tuple[list[tuple[str, str, str, int]], list[Slot]]:
    """(tokens, slots) of a page. A token is (kind, path, token, characters), of an opening tag or a slot; slots come in
    page order, their text decoded, white space turned into single spaces and trimmed; empty ones are left out."""
    out: list[tuple[str, str, str, int]] = []
    slots: list[Slot] = []
    stack: list[tuple] = [("", "", False, "", False, 0, False, (), 1)]  # name, path, dropped, article, header, box, link, marks, down
    parts: list[str] = []
    links = boxes = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                at = next(x for x in reversed(stack) if x[0] not in INLINE)
                slots.append(Slot(at[1], text, stack[-1][2], at[3], at[4], at[5], links, *stack[-1][7:]))
                out.append(("text", at[1], slots[-1].token, slots[-1].chars))
            links = 0

    def close(depth: int) -> None:
        last, before = stack[-1], stack[depth - 1]
        if last[2] != before[2] or last[7] != before[7] or any(x[0] not in INLINE for x in stack[depth:]):
            flush()
        del stack[depth:]

    end = 0
    source = source or ""
    for m in _TOKEN.finditer(source):
        if m.start() > end:
            parts.append(source[end : m.start()])
            links += stack[-1][6] * (m.start() - end)
        end = m.end()
        name = (m[4] or "").lower()
        if not name:
            if m[1]:
                flush() if m[1].lower() not in INLINE else None
            continue
        if m[3]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
            continue
        if name not in INLINE:
            flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in SELF_CLOSING.get(name, ()) or (stack[depth][0] == "p" and name in ENDS_P):
                    close(depth)
                    break
                if stack[depth][0] not in INLINE and stack[depth][0] not in ("p", "td", "th"):
                    break
        attributes = {a.lower(): (b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(m[5])} if m[5] and m[5] != "/" else {}
        label = " ".join(attributes.get(k, "") for k in ("class", "id", "role") if attributes.get(k))
        parent = stack[-1]
        path = parent[1] if name in INLINE else f"{parent[1]}/{name}" + (f".{_DIGITS.sub('0', label)}".replace("/", "|") if label else "")
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        body = parent[3] or (path if name in ("article", "main") else "")
        dropped = parent[2] or name in DROPPED or hidden
        header = parent[4] or name == "header"
        marks, down = parent[7], parent[8]
        if name in SELDOM or name == "form" or (label and name not in ("html", "body", "article", "main") and BOILERPLATE.search(label)):
            marks += (path if name not in INLINE else f"{path}/{name}",)
            down = max(down, SELDOM_DOWN if name in SELDOM or (label and SELDOM_WORDS.search(label)) else DOWN)
        if dropped != parent[2] or marks != parent[7]:
            flush()
        if name not in INLINE:
            out.append(("tag", path, path, 0))
        if name not in VOID and not m[5].endswith("/"):
            box = parent[5]
            if name not in INLINE and name not in RUNNING:
                boxes = box = boxes + 1
            stack.append((name, path, dropped, body, header, box, parent[6] or name == "a", marks, down))
    if end < len(source):
        parts.append(source[end:])
    flush()
    return out, slots


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, kind, path, token, chars, page, n) for each distinct token of each page of (page, host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = [(h, *t, p, n) for p, h, s in zip(*(batch.column(i).slice(lo, 500).to_pylist() for i in range(3))) for t, n in Counter(parse(s)[0]).items()]
                if rows:
                    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["host", "kind", "path", "token", "chars", "page", "n"])

    return pages.mapInArrow(run, "host string, kind string, path string, token string, chars long, page long, n long")


def vectors(pages: DataFrame) -> DataFrame:
    """(host, kind, path, token, support, total, vector, weight): the occurrence vectors of tokens, from (host, html).

    Two tokens have the same vector if they occur equally often on each page; vectors are compared by their support,
    their sum and a 64-bit sum of page hashes times counts, so none is ever gathered and a host with most of the pages
    costs its tasks no more than their own pages. ``weight``: characters of a text, over all pages. Copies of a page
    count once.
    """
    pages = pages.select("host", "html").distinct().withColumn("page", F.monotonically_increasing_id()).select("page", "host", "html")
    part = (F.xxhash64("page").bitwiseAND(F.lit((1 << 40) - 1)) * F.col("n")).cast("decimal(38,0)")
    return occurrences(pages).groupBy("host", "kind", "path", "token").agg(F.count("*").alias("support"), F.sum("n").alias("total"), F.sum(part).alias("vector"), F.sum(F.col("chars") * F.col("n")).alias("weight"))


def classes(found: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, least_class: int = LEAST_CLASS) -> DataFrame:
    """(host, class, parent, support, tokens): the valid classes of each host from its vectors, as a nested template.

    A class is valid if it is on ``least_pages`` pages and a share of ``least_share`` of its host's, and has
    ``least_class`` tokens. Its place is its shortest path; it nests in the class (``parent``) whose place is the
    longest path above that. The share bounds what a host's classes can hold, so they fit in a row.
    """
    pages = found.where("kind = 'tag'").groupBy("host").agg(F.max("support").alias("pages"))
    common = found.where(F.col("support") >= least_pages).join(pages, "host").where(F.col("support") >= least_share * F.col("pages"))
    grouped = common.groupBy("host", F.xxhash64("support", "total", "vector").alias("class")).agg(F.first("support").alias("support"), F.array_sort(F.collect_list(F.struct("kind", "token"))).alias("tokens"), F.min(F.struct(F.length("path"), F.col("path").alias("at"))).alias("place"))
    grouped = grouped.where(F.size("tokens") >= least_class).select("host", F.struct("class", F.col("place.at").alias("at"), "support", "tokens").alias("c"))
    hosts = grouped.groupBy("host").agg(F.collect_list("c").alias("cs"))
    above = lambda c: F.array_max(F.transform(F.filter("cs", lambda x: F.startswith(c["at"], F.concat(x["at"], F.lit("/")))), lambda x: F.struct(F.length(x["at"]).alias("n"), x["class"].alias("class"))))
    nested = F.transform("cs", lambda c: F.struct(c["class"].alias("class"), above(c)["class"].alias("parent"), c["support"].alias("support"), c["tokens"].alias("tokens")))
    return hosts.select("host", F.explode(nested).alias("c")).select("host", "c.*")


def deduce(found: DataFrame, fixed_share: float = FIXED_SHARE, **limits) -> DataFrame:
    """(host, elements array<struct<path, weight>>, fixed array<string>): a row for each host with a template.

    Elements are those of the template, with the characters of unfixed text below them over the host's pages; fixed
    are the texts that a share of ``fixed_share`` of the pages with their element have.
    """
    template = classes(found, **limits).select("host", F.explode("tokens").alias("t")).where("t.kind = 'tag'").select("host", F.col("t.token").alias("path"))
    tags = found.where("kind = 'tag'").select("host", "path", F.col("support").alias("pages"))
    texts = found.where("kind = 'text'")
    often = texts.where(F.col("support") >= limits.get("least_pages", LEAST_PAGES)).join(tags, ["host", "path"])
    fixed = often.where(F.col("support") >= fixed_share * F.col("pages")).select("host", "path", "token", "weight")
    unfixed = texts.groupBy("host", "path").agg(F.sum("weight").alias("weight")).unionByName(fixed.select("host", "path", (-F.col("weight")).alias("weight")))
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    weights = unfixed.groupBy("host", "path").agg(F.sum("weight").alias("weight")).select("host", F.explode(above).alias("path"), "weight").groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    elements = template.join(weights, ["host", "path"]).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", F.col("weight").cast("long").alias("weight")))).alias("elements"))
    return elements.join(fixed.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("fixed")), "host", "left").select("host", "elements", F.coalesce("fixed", F.array()).alias("fixed"))


def article_of(elements: dict[str, float]) -> str | None:
    """The path of the template's element that holds the articles: from the outermost, down to the element below it as
    long as that holds most of the text (as the page marks articles, an article or main weighs more). Elements of running
    text end the way."""
    above: dict[str | None, list[str]] = {}
    for path in sorted(elements):
        step = path
        while step and (step := step.rpartition("/")[0]) not in elements:
            pass
        above.setdefault(step or None, []).append(path)
    at = None
    name = lambda path: path.rpartition("/")[2].partition(".")[0]
    heavy = lambda path: elements[path] * (MARKED if name(path) in ("article", "main") else 1.0)
    while below := [x for x in above.get(at, ()) if name(x) not in RUNNING and elements[x] > 0]:
        best = max(below, key=lambda x: (heavy(x), x))
        if at is not None and heavy(best) < DOMINANT * (elements[at] - elements[best] + heavy(best)):
            break
        at = best
    return at


def _without_marked(slots: list[Slot], root: str, fixed: frozenset[str] | set[str]) -> list[Slot]:
    """The slots below ``root`` that are in no marked element below it; or, where one such element outweighs them all,
    those below that in the same way."""
    while True:
        marked: dict[str, float] = {}
        weight = 0
        for s in slots:
            m = s.mark_below(root)
            if s.token in fixed:
                continue
            if m is None:
                weight += s.own
            else:
                marked[m] = marked.get(m, 0) + s.own / s.down
        best = max(marked, key=lambda m: (marked[m], m), default=None)
        if best is None or marked[best] <= weight:
            return [s for s in slots if s.mark_below(root) is None]
        slots, root = [s for s in slots if s.mark_below(root) == best], best


def extract(source: str | None, article: str | None = None, fixed: frozenset[str] | set[str] = frozenset()) -> str:
    """The main text: the slots below the template's article, or, where there is none, those of the page's own.

    An element all of whose texts are fixed goes; fixed text among other running text stays, as does all of an article
    that has no other. A header inside the page's article is part of it; one outside is not.
    """
    _, slots = parse(source)
    kept = [s for s in slots if not s.dropped and (s.article or not s.header)]
    inside = [s for s in kept if s.path == article or s.path.startswith(f"{article}/")] if article else []
    if inside:
        inside = _without_marked(inside, article, fixed)
    elif any(s.article for s in kept):
        inside = [s for s in kept if s.article]
        inside = [s for root in dict.fromkeys(s.article for s in inside) for s in _without_marked([s for s in inside if s.article == root], root, fixed)]
    else:
        inside = _without_marked(kept, "", fixed)
    own = {s.box for s in inside if s.token not in fixed}
    return " ".join(s.text for s in inside if s.box in own or not own)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **limits) -> DataFrame:
    """(id, url, text) of every row.

    Pages of one host share its template; a page without a host has the template of those without one. The table of
    templates is written, so its true size decides how it is joined.

    Nulls: a null html gives an empty text, a null URL the empty host; null ids keep their rows. Repeated rows are
    pages of their own. An empty table gives an empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "templates")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    found = scratch.write(vectors(rows.select("host", "html")), "vectors")
    joined = rows.join(scratch.write(deduce(found, **limits), "templates"), "host", "left")
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for host, source, elements, fixed in zip(*(batch.column(i) for i in range(2, 6))):
                if (h := host.as_py()) not in known:
                    if len(known) > 100:
                        known.clear()
                    known[h] = article_of({e["path"]: e["weight"] for e in elements.as_py() or ()}), frozenset(fixed.as_py() or ())
                out.append(extract(source.as_py(), *known[h]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])

    return joined.select("id", "url", "host", "html", "elements", "fixed").mapInArrow(run, schema)
