"""Main text of web pages by equivalence classes of template tokens, per host.

A page is a sequence of tokens: opening tags with the path of elements above them, and whole text blocks with
theirs. Tokens of a host that occur equally often in each of its pages (the same occurrence vector) form an
equivalence class. Occurrence vectors are compared by a sum of hashes over (page, count), so classes are found by
partial aggregates and no host's pages meet in one task. Classes that occur on at least ``LEAST_SHARE`` of a host's
pages are valid; nested by their element paths they are the host's template, and its text blocks are
furniture (notices, captions, repeated lines of the layout). What stands between the template's tokens is content.

A token that occurs equally often on at least ``LEAST_SHARE`` of a host's pages is an anchor there, each occurrence
with a role of its own (the first ``div``, the second ``div``). The text blocks that follow an anchor up to the next
one, under one element path, fill one slot. Slots are judged over all distinct pages of their host by the share of
their characters inside links: a slot above ``MOST_LINKED`` is a menu or a list of related pages. Inside ``article`` and
``main`` only links within the host count, so a list of references to other sites stays text of the article.

Extraction reads each page once more, walking its host's template, whatever elements the page has. Slots inside menus,
headers, footers, sidebars, forms, scripts, styles, adverts, notices and reader comments are left out, by element name or
by the words of class, id and role, and so are linked slots. Of the rest, those inside an ``article`` (else ``main``, else
the page's body) are kept; a page with nothing else keeps its linked slots. Character references are decoded, white space inside a block becomes one space, and
blocks are joined by line ends. Comments of readers with neither such words nor links look like text and are kept.

Broken markup is read as it comes: unclosed elements end with their parent, unclosed comments and scripts with the
page. Null html gives an empty text, a null url the empty host. Repeated rows are extracted alike; templates count
each distinct page of a host once. Text inside an ``article`` is never furniture, however often it occurs. An empty
table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import written

LEAST_PAGES = 5
LEAST_SHARE = 0.5
MOST_LINKED = 0.5
LONGEST_PATH = 256

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template iframe textarea title svg math select option object"
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
            "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
            "tfoot th thead tr ul".split())
ASIDE = set("nav header footer aside form menu dialog button head".split())
ASIDE_WORDS = set("ad ads advert adverts advertisement banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb "
                  "breadcrumbs footer header masthead cookie cookies consent notice notices alert popup modal newsletter "
                  "subscribe signup login share sharing social related recommended comment comments respond disqus toolbar "
                  "pagination pager widget".split())
# Elements whose class, id and role say how the page is laid out, not what they hold.
WHOLE = set("html body main article".split())
# Words that make a class name a statement on the layout (has-sidebar), or a header one of the text itself (entry-header).
MODIFIERS = set("has have with without no not is show hide layout".split())
OF_TEXT = set("entry post article story content section title chapter".split())
# Elements that close an open paragraph or item of the same kind.
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}
_STOP = set("article section main div body table ul ol dl nav aside header footer form blockquote html".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW.replace(' ', '|')})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# The site that a link leads to; without one it stays on its page's own.
_SITE = re.compile(r"\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s\"'>]*)", re.I)


@dataclass
class Block:
    path: str      # names of the elements around it
    text: str
    aside: bool    # inside an element that never holds main text
    inside: str    # "article", "main" or ""
    linked: int    # its characters inside links, but for white space
    own: int       # those of them inside links within the page's host


def _aside(name: str, attributes: str, path: list[tuple]) -> bool:
    if name in ASIDE:
        # An article's own header holds its headline.
        return not (name == "header" and any(p[0] == "article" for p in path))
    if not attributes or name in WHOLE:
        return False
    marks = " ".join(x for m in _MARK.findall(attributes) for x in m).lower()
    return any(map(_aside_name, marks.split()))


def _aside_name(mark: str) -> bool:
    """Whether one name of a class, id or role stands for a part beside the main text."""
    words = set(re.split(r"[^a-z]+", mark))
    return (words & ASIDE_WORDS) > (words & {"header"} if words & OF_TEXT else set()) and words.isdisjoint(MODIFIERS)


def parse(page: str, host: str = "") -> Iterator[tuple[str, Block | str]]:
    """("tag", path) for each opening tag and ("block", Block) for each text block, in page order."""
    stack: list[tuple[str, bool, str, str, str, bool]] = []  # name, aside, inside, path, path of block elements, link within the host
    text: list[str] = []
    links: list[tuple[str, bool]] = []
    at = depth = 0  # depth: open links

    def block():
        words = " ".join(html.unescape("".join(text)).split())
        linked = own = 0
        if links:
            linked = len("".join(html.unescape("".join([x for x, _ in links])).split()))
            own = len("".join(html.unescape("".join([x for x, within in links if within])).split()))
        text.clear()
        links.clear()
        if words:
            _, aside, inside, _, path, _ = stack[-1] if stack else _PAGE
            return Block(path, words, aside, inside, linked, own)
        return None

    def open_links():
        return sum(s[0] == "a" for s in stack) if depth else 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at:m.start()])
            if depth:
                links.append((text[-1], next(s[5] for s in reversed(stack) if s[0] == "a")))
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK and text:
            if b := block():
                yield "block", b
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    depth = open_links()
                    break
            continue
        if name in _CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _CLOSES[name]:
                    del stack[k:]
                    depth = open_links()
                    break
                if stack[k][0] in _STOP:
                    break
        _, aside, inside, path, blocks, _ = stack[-1] if stack else _PAGE
        inside = "article" if name == "article" or inside == "article" else "main" if name == "main" or inside == "main" else ""
        yield "tag", f"{path}/{name}"
        if name not in VOID and not m[4].endswith("/"):
            within = False
            if name == "a":
                site = _SITE.search(m[4])
                within = site is None or site[1].lower() == host
                depth += 1
            path = f"{path}/{name}" if path else name
            if name in BLOCK:
                blocks = f"{blocks}/{name}" if blocks else name
            stack.append((name, aside or _aside(name, m[4], stack), inside, path, blocks, within))
    if at < len(page):
        text.append(re.sub(r"<[a-z/!?][^>]*\Z", "", page[at:], flags=re.I))
    if b := block():
        yield "block", b


_PAGE = ("", False, "", "", "", False)  # around all elements


@lru_cache(maxsize=1 << 16)
def _tag_token(path: str) -> int:
    return xxhash.xxh64_intdigest(f"t {path}".encode())


def _token(kind: str, value: Block | str) -> int:
    if kind == "tag":
        # Few paths on many pages; a deep one of broken markup is not remembered.
        return _tag_token(value) if len(value) <= LONGEST_PATH else _tag_token.__wrapped__(value)
    return xxhash.xxh64_intdigest(f"b {value.path} {value.text}".encode())


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distinct_pages(pages: DataFrame) -> DataFrame:
    """host, html, once for all copies of a page: they say nothing about its host's layout."""
    return pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).distinct()


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """host, n_host, n (pages with the class), v1, v2, depth, tokens, texts and anchors: classes of equal occurrence vectors.

    ``anchors`` are the tokens with the number of times that they occur on most of their pages, if those are enough.
    """
    def count(batches):
        for batch in batches:
            found: dict[tuple[str, int, int], list[int]] = {}
            n_pages: Counter = Counter()
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                n_pages[host] += 1
                key = xxhash.xxh64_intdigest((page or "").encode())
                seen: dict[int, list[int]] = {}
                for kind, value in parse(page or ""):
                    path = value if kind == "tag" else value.path
                    seen.setdefault(_token(kind, value), [0, path.count("/"), int(kind == "block")])[0] += 1
                for token, (n, depth, is_block) in seen.items():
                    h = xxhash.xxh64_intdigest(f"{key} {n}".encode())
                    row = found.setdefault((host, token, n), [0, 0, 0, depth, is_block])
                    row[0] += 1
                    row[1] += h & 0xFFFFFFFF
                    row[2] += h >> 32
            rows = [(h, np.uint64(t).astype(np.int64), k, *v) for (h, t, k), v in found.items()]
            rows += [(h, 0, 0, n, 0, 0, -1, 0) for h, n in n_pages.items()]  # depth -1: the host's pages
            cols = list(zip(*rows))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string())] + [pa.array(c, pa.int64()) for c in cols[1:]],
                                                 ["host", "token", "k", "n", "v1", "v2", "depth", "is_block"])

    counts = distinct_pages(pages).mapInArrow(
        count, "host string, token long, k long, n long, v1 long, v2 long, depth long, is_block long")
    by_count = counts.groupBy("host", "token", "depth", "is_block", "k").agg(
        F.sum("n").alias("n"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"))
    counts = written(by_count.groupBy("host", "token", "depth", "is_block").agg(
        F.sum("n").alias("n"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"),
        F.max(F.struct("n", "k")).alias("usual")), "tokens")
    hosts = counts.where("depth = -1").select("host", F.col("n").alias("n_host"))
    held = (counts.where("depth >= 0").join(hosts, "host")
            .where(_valid("n")))
    return held.groupBy("host", "n_host", "n", "v1", "v2").agg(
        F.min("depth").alias("depth"), F.sort_array(F.collect_list("token")).alias("tokens"),
        F.sort_array(F.collect_list(F.when(F.col("is_block") == 1, F.col("token")))).alias("texts"),
        F.collect_list(F.when(_valid("usual.n"), F.struct("token", F.col("usual.k").alias("k")))).alias("anchors"))


def _valid(n: str) -> Column:
    return (F.col(n) >= LEAST_PAGES) & (F.col(n) >= LEAST_SHARE * F.col("n_host"))


def host_templates(classes: DataFrame) -> DataFrame:
    """Per host: its valid classes, outermost first, the text blocks among their tokens (furniture) and its anchors.

    A class holds tokens of at least half of a host's pages, so a template is no longer than two pages.
    """
    return classes.groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("depth", "n", "tokens"))).alias("classes"),
        F.flatten(F.collect_list("texts")).alias("furniture"), F.flatten(F.collect_list("anchors")).alias("anchors"),
        F.first("n_host").alias("n_host"))


@dataclass
class Template:
    furniture: frozenset[int] = frozenset()
    anchors: dict[int, int] = field(default_factory=dict)  # token: its occurrences on a page of the template
    linked: frozenset[int] = frozenset()                   # slots of menus and lists of links


def content(page: str, template: Template, host: str = "") -> list[tuple[int, Block]]:
    """(slot, block) of the page in its host's template, without asides and (but in articles) furniture."""
    found = list(parse(page, host))
    tokens = [_token(kind, v) for kind, v in found]
    times = Counter(tokens)
    seen: Counter = Counter()
    role, out = (0, 0), []
    for token, (kind, v) in zip(tokens, found):
        if template.anchors.get(token) == times[token]:
            seen[token] += 1
            role = (token, seen[token])
        if kind == "block" and not v.aside and (v.inside == "article" or token not in template.furniture):
            out.append((xxhash.xxh64_intdigest(f"{role[0]} {role[1]} {v.path}".encode()), v))
    return out


def linked_slots(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """host, linked: the slots whose text is mostly links (in articles and mains, links within the host), on enough of a host's distinct pages."""
    def count(batches):
        for batch in batches:
            found: dict[tuple[str, int], list[int]] = {}
            for host, page, template in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), _templates(batch)):
                n: dict[int, list[int]] = {}
                for slot, b in content(page, template, host):
                    at = n.setdefault(slot, [1, 0, 0])
                    at[1] += len(b.text) - b.text.count(" ")
                    at[2] += b.own if b.inside else b.linked
                for slot, v in n.items():
                    row = found.setdefault((host, slot), [0, 0, 0])
                    for i in range(3):
                        row[i] += v[i]
            if found:
                cols = list(zip(*((h, np.uint64(t).astype(np.int64), *v) for (h, t), v in found.items())))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string())] + [pa.array(c, pa.int64()) for c in cols[1:]],
                                                 ["host", "slot", "n", "chars", "links"])

    slots = _with_template(distinct_pages(pages), templates).mapInArrow(
        count, "host string, slot long, n long, chars long, links long")
    return (slots.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "links")])
            .join(templates.select("host", "n_host"), "host")
            .where(_valid("n") & (F.col("links") > MOST_LINKED * F.col("chars")))
            .groupBy("host").agg(F.collect_list("slot").alias("linked")))


def _with_template(pages: DataFrame, templates: DataFrame) -> DataFrame:
    t = templates.withColumnRenamed("host", "_host")
    return pages.join(t, pages["host"] == t["_host"], "left").drop("_host")


def _templates(batch: pa.RecordBatch) -> Iterator[Template]:
    """The template of each row; rows of one host mostly share one."""
    known: dict[str, Template] = {}
    names = set(batch.schema.names)

    def whole(row: int, column: str) -> list:
        return batch.column(column)[row].as_py() or [] if column in names else []

    for row, host in enumerate(batch.column("host").to_pylist()):
        if host not in known:
            unsigned = lambda xs: frozenset(x & (1 << 64) - 1 for x in xs)
            known[host] = Template(unsigned(whole(row, "furniture")),
                                   {x["token"] & (1 << 64) - 1: x["k"] for x in whole(row, "anchors")},
                                   unsigned(whole(row, "linked")))
        yield known[host]


def main_text(page: str, template: Template, host: str = "") -> str:
    """The innermost kind of container with slots that are kept, of them; the slots of links only if the page has no others."""
    slots = content(page, template, host)
    for some in ([b for slot, b in slots if slot not in template.linked], [b for _, b in slots]):
        for want in ("article", "main", ""):
            if kept := [b.text for b in some if not want or b.inside == want]:
                return "\n".join(kept)
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, host, text, n_chars, n_classes per row of ``pages`` (page_id, url, html)."""
    templates = written(host_templates(written(equivalence_classes(pages), "classes")).select(
        "host", "n_host", "furniture", "anchors", F.size("classes").alias("n_classes")), "templates")
    linked = written(linked_slots(pages, templates.select("host", "n_host", "furniture", "anchors")), "slots")
    templates = written(templates.join(linked, "host", "left").drop("n_host"), "judged-templates")
    joined = _with_template(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html"), templates)

    def run(batches):
        for batch in batches:
            texts = [main_text(page or "", template, host) for page, host, template in zip(
                batch.column("html").to_pylist(), batch.column("host").to_pylist(), _templates(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("page_id", "url", "host")]
                + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                   batch.column("n_classes").fill_null(0)], ["page_id", "url", "host", "text", "n_chars", "n_classes"])

    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, host string, "
                                  "text string, n_chars long, n_classes int")
