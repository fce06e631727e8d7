"""Operator 10: main text of web pages by nearest-URL page differencing.

A page is cut into text lines (blocks).  Hashes of its lines, without the text,
are range-partitioned by host and URL path, so that the pages with the nearest
paths of a host stand next to each other and a host with a third of all pages is
many partitions.  The lines are aligned by longest common subsequence with those
of the nearest sibling, and lines that both have are template, not text: they are
deleted.  A sibling is no copy: pages that share most of the text of this page
are passed over, however many, and the nearest page behind them is taken, on
the side with the nearer path.  Lines that nine tenths of the distinct line lists
of a host have (three at least) are its template and do not count when copies
are judged.  The sorted partitions are files that every task can read
on from its own into the next, so the result does not depend on where they are
cut.  The text is joined to the lines to keep by a hash of the row.

Two things are known without a neighbour.  Scripts, styles, menus, page headers,
footers, sidebars, notices, adverts, forms and reader comments are marked by
their elements or class names and never text.  And what the page itself marks as
its article (``article``, ``main``) is kept even where the neighbour's article
says the same; differencing decides on the lines outside of it: those that the
sibling does not have are text, too.  Where there is no sibling, a page with an
article is that article, one without is all lines outside furniture.

Cases: null and empty html give the empty text; broken markup (unclosed or cut
off tags, comments and references) is read as browsers do, as far as it goes; a
page alone on its host, or with copies only, loses no line by differencing;
equal URLs are neighbours like others; a null URL is a host of its own; repeated
rows are extracted one by one; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from hashlib import blake2b
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, SharedFiles

#: Elements whose content is not text.
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
HIDDEN = frozenset("head nav footer aside form button select option datalist template noscript svg math canvas "
                   "object embed audio video dialog menu label fieldset legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                  "option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of one of these ends an open element of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names in class, id and role that mark furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|breadcrumbs?|"
    r"sidebar\w*|side|footer|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alert\w*|newsletter|subscri\w*|"
    r"signup|login|comments?|commentlist|repl(?:y|ies)|respond|disqus|social|shar(?:e|ing)|related|recommend\w*|popup|"
    r"modal|overlay|search|widget\w*|pagination|pager|skip|contentinfo|complementary|form|dialog|hidden)(?=$|[\s_-])",
    re.I)
#: A page's header, unless it is that of its article.
HEADER = re.compile(r"(?:^|[\s_-])(?:header|hdr)(?=$|[\s_-])", re.I)
#: Names that say what an element has, not what it is (``has-comments``).
_HAS = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|is|allow)[-_][\w-]+", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|noembed|noframes|xmp)\b[^>]*>.*?(?:</\1\s*[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|<(?=[a-zA-Z/])[^>]*(?:>|\Z)",
    re.S | re.I)
#: One attribute: its whole name, and its value, which is never searched for names.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"\s+")


def _attributes(source: str) -> list[tuple[str, str]]:
    return [(name.lower(), value.strip("\"'")) for name, value in _ATTRIBUTE.findall(source)]


def _article(attributes: list[tuple[str, str]]) -> bool:
    """Marks of the article other than its element."""
    return any(name == "role" and re.match(r"main\b", value, re.I)
               or name == "itemprop" and re.match(r"articleBody\b", value, re.I) for name, value in attributes)


def _furniture(tag: str, attributes: list[tuple[str, str]], in_article: bool) -> bool:
    if tag in HIDDEN or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main") or _article(attributes):
        return False
    for name, value in attributes:
        value = _HAS.sub("", value)
        if (name == "hidden" or (name == "aria-hidden" and value.lower() == "true")
                or (name == "style" and re.search(r"display\s*:\s*none", value, re.I))
                or (name in ("class", "id", "role") and (
                    FURNITURE.search(value) or not in_article and HEADER.search(value)))):
            return True
    return False


def lines_of(html: str) -> list[tuple[str, bool]]:
    """(text, in the article) of every block with text outside furniture."""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, furniture, article, both including what is around
    buffer: list[str] = []

    def flush():
        if buffer:
            text = _SPACE.sub(" ", unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append((text, bool(stack) and stack[-1][2]))

    def text(part):
        if part and not (stack and stack[-1][1]):
            buffer.append(part)

    at = 0
    for m in _TOKEN.finditer(html):
        text(html[at:m.start()])
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            continue
        if m.group(2):
            if any(t[0] == tag for t in stack):
                if tag in BLOCK:
                    flush()
                while stack.pop()[0] != tag:
                    pass
            elif tag in ("p", "br"):
                flush() if tag == "p" else text(" ")
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            flush()
            close = CLOSES.get(tag, {"p"} if tag not in ("html", "body") else set())
            inner = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in close:
                    inner = i
                    if tag != "tr":
                        break
                elif stack[i][0] in BLOCK and stack[i][0] not in ("p",):
                    break
            if inner is not None:
                del stack[inner:]
        if tag in VOID or m.group(4).endswith("/") and tag not in BLOCK:
            continue
        outer = stack[-1] if stack else ("", False, False)
        attributes = _attributes(m.group(4)) if m.group(4) and not outer[1] else []
        article = outer[2] or not outer[1] and (tag in ("article", "main") or _article(attributes))
        stack.append((tag, outer[1] or _furniture(tag, attributes, outer[2]), article))
    tail = html[at:]
    text(tail)
    flush()
    return out


def common_lines(a: list, b: list) -> list[bool]:
    """Which items of ``a`` are in a longest common subsequence with ``b``: a
    bit-parallel table (one big number per item of ``a``), read backwards."""
    keep, lo, ea, eb = [False] * len(a), 0, len(a), len(b)
    while lo < min(ea, eb) and a[lo] == b[lo]:
        keep[lo] = True
        lo += 1
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
        keep[ea] = True
    n = eb - lo
    where: dict = {}
    for j in range(n):
        where[b[lo + j]] = where.get(b[lo + j], 0) | 1 << j
    full, rows = (1 << n) - 1, []
    v = full
    for i in range(lo, ea):
        rows.append(v)
        u = v & where.get(a[i], 0)
        v = ((v + u) | (v - u)) & full
    rows.append(v)
    # bit j of row i is 0 where column j adds one to the length of the prefix of i items
    i, j = ea - lo, n
    while i and j:
        new, old = rows[i] >> (j - 1) & 1, rows[i - 1] >> (j - 1) & 1
        if new:
            j -= 1  # the column adds nothing here
        elif not old:
            i -= 1  # it did without item i, too
        else:
            keep[lo + i - 1] = True
            i, j = i - 1, j - 1
    return keep


def copies(a: list, b: list, sizes: list[int], template: frozenset = frozenset(), most: float = 0.8) -> bool:
    """Whether most characters of ``a`` (``sizes``: of its lines) stand in lines
    that ``b`` has, too.  Template lines do not count; a page of nothing else is
    no copy."""
    have, same, total = Counter(b), 0, 0
    for line, size in zip(a, sizes, strict=True):
        if line not in template:
            total += size
            if have[line]:
                have[line] -= 1
                same += size
    return total > 0 and same >= most * total


def plain_keep(inside: list[bool]) -> list[bool]:
    """Which lines are text where no sibling is there to align with: those of
    the article of the page, if it marks one."""
    marked = any(inside)
    return [i or not marked for i in inside]


def main_text(page: list[tuple[str, bool]], keep) -> str:
    """Text of a page; ``keep`` tells its lines, or is empty: no sibling."""
    return "\n".join(t for (t, _), k in zip(page, keep or plain_keep([i for _, i in page]), strict=True) if k)


def nearness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


# ------------------------------------------------------------- line lists in URL order
def line_lists(rows: DataFrame) -> DataFrame:
    """Hashes and sizes of the lines of every page that has any, without their text."""
    def run(batches):
        for batch in batches:
            at, hashes, sizes, inside = [], [], [], []
            for i, html in enumerate(batch.column(0)):
                page = lines_of(html.as_py())
                if page:
                    at.append(i)
                    hashes.append([int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                                                  "little", signed=True) for t, _ in page])
                    sizes.append([len(t) for t, _ in page])
                    inside.append(bytes(i for _, i in page))
            rest = batch.take(pa.array(at, pa.int64())).columns[1:]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())),
                 pa.array(inside, pa.binary())], names=[*batch.schema.names[1:], "hashes", "sizes", "inside"])

    return rows.select("html", "host", "path", "page_id", "url", "k1", "k2").mapInArrow(
        run, "host string, path string, page_id long, url string, k1 long, k2 long, hashes array<long>, "
             "sizes array<int>, inside binary")


def templates(lists: DataFrame) -> DataFrame:
    """``host, lines``: hashes of the lines that nine tenths of the distinct
    line lists of a host have, three at least.  A lower share would take the
    text of a page with many near copies for template."""
    distinct = lists.select("host", "hashes").distinct()
    n = distinct.groupBy("host").agg(F.count("*").alias("n"))
    often = (distinct.select("host", F.explode(F.array_distinct("hashes")).alias("line"))
             .groupBy("host", "line").agg(F.count("*").alias("c")).where("c >= 3"))
    return often.join(n, "host").where("10 * c >= 9 * n").groupBy("host").agg(F.collect_list("line").alias("lines"))


def in_files(df: DataFrame, files: SharedFiles, name: str) -> list[tuple]:
    """(file, rows, first host, last host) of the sorted partitions of ``df``,
    each stored as one file; a row with the keys of the row before is left out."""
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        if "k1" in table.column_names:
            k1, k2 = (table.column(c).to_numpy() for c in ("k1", "k2"))
            table = table.filter(pa.array(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
        part = TaskContext.get().partitionId()
        out = pa.BufferOutputStream()
        with pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table.combine_chunks())
        files.put(f"{name}-{part}", [out.getvalue()])
        hosts = table.column("host")
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "n": pa.array([table.num_rows], pa.int64()),
            "first": pa.array([hosts[0].as_py()], pa.string()), "last": pa.array([hosts[-1].as_py()], pa.string())})

    found = df.mapInArrow(run, "part int, n long, first string, last string").collect()
    return [(f"{name}-{r.part}", r.n, r.first, r.last) for r in sorted(found, key=lambda r: r.part)]


class Pages:
    """Line lists of all pages in URL order, read from the files of any
    partition as they are asked for, and the siblings of a page."""

    def __init__(self, files: SharedFiles, parts: list[tuple], marks: list[tuple]):
        self.files, self.parts, self.marks = files, parts, marks
        self.starts = [0, *accumulate(p[1] for p in parts)]
        self.memo: dict[int, dict[int, int | None]] = {-1: {}, 1: {}}
        self.open = lru_cache(4)(self._open)
        self.page = lru_cache(256)(self._page)
        self.template = lru_cache(16)(self._template)
        self.marked = lru_cache(2)(self._marked)

    def _open(self, name: str) -> dict:
        table = pa.ipc.open_file(pa.py_buffer(self.files.array(name, np.uint8))).read_all().combine_chunks()
        return {c: table.column(c).chunk(0) for c in table.column_names}

    def _page(self, i: int) -> dict:
        part = bisect_right(self.starts, i) - 1
        table = self.open(self.parts[part][0])
        return {c: v[i - self.starts[part]].as_py() for c, v in table.items()}

    def _marked(self, name: str) -> dict[str, int]:
        return {h: i for i, h in enumerate(self.open(name)["host"].to_pylist())}

    def _template(self, host: str) -> frozenset:
        for name, _, first, last in self.marks:
            if first <= host <= last and (i := self.marked(name).get(host)) is not None:
                return frozenset(self.open(name)["lines"][i].as_py())
        return frozenset()

    def copy(self, i: int, j: int) -> bool:
        a, b = self.page(i), self.page(j)
        return copies(a["hashes"], b["hashes"], a["sizes"], self.template(a["host"]))

    def sibling(self, i: int, step: int) -> int | None:
        """Nearest page on one side (``step`` -1 or 1) of the host that is no
        copy of page ``i``.  What a copy passes over is passed over with it."""
        memo, at, stack = self.memo[step], {}, [i]
        while stack:
            j = stack[-1]
            q = at.get(j, j + step)
            if j in memo:
                stack.pop()
            elif q is None or not 0 <= q < self.starts[-1] or self.page(q)["host"] != self.page(j)["host"]:
                memo[j] = None
            elif not self.copy(j, q):
                memo[j] = q
            elif q in memo:
                at[j] = memo[q]
            else:
                stack.append(q)
        return memo[i]

    def keep(self, i: int) -> bytes | None:
        """Which lines of page ``i`` are text, if differencing changes that."""
        page = self.page(i)
        inside = [bool(x) for x in page["inside"]]
        if all(inside):
            return None
        sides = [self.page(q) for q in (self.sibling(i, -1), self.sibling(i, 1)) if q is not None]
        if not sides:
            return None
        other = max(sides, key=lambda s: nearness(s["path"], page["path"]))
        keep = [x or not g for x, g in zip(inside, common_lines(page["hashes"], other["hashes"]), strict=True)]
        return bytes(keep) if keep != plain_keep(inside) else None


def differenced(spark: SparkSession, files: SharedFiles, parts: list[tuple], marks: list[tuple]) -> DataFrame:
    """``k1, k2, keep`` of the pages whose text differencing changes."""
    def run(batches):
        pages = Pages(files, parts, marks)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                out = []
                for i in range(pages.starts[part], pages.starts[part + 1]):
                    if (keep := pages.keep(i)) is not None:
                        out.append((pages.page(i)["k1"], pages.page(i)["k2"], keep))
                    if len(out) == 2000 or out and i + 1 == pages.starts[part + 1]:
                        k1, k2, keeps = zip(*out)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keeps, pa.binary())],
                            names=["k1", "k2", "keep"])
                        out = []

    tasks = spark.range(0, len(parts), 1, max(1, len(parts)))
    return tasks.mapInArrow(run, "k1 long, k2 long, keep binary")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``, one row per row of
    ``pages (page_id, url, html)``."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "main-text")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"(?:/|\.html?)$", "").alias("path"))
    # equal rows have one key and one text
    for k in (1, 2):
        rows = rows.withColumn(f"k{k}", F.xxhash64(F.lit(k), F.col("page_id").isNull(), "page_id", F.col("url").isNull(),
                                                   "url", "html"))
    lists = scratch.store(line_lists(rows), "lists")
    files = scratch.files("sorted")
    order = ["host", "path", "page_id", "url", "k1", "k2"]
    parts = in_files(lists.repartitionByRange(*order).sortWithinPartitions(*order), files, "pages")
    marks = in_files(templates(lists).repartitionByRange("host").sortWithinPartitions("host"), files, "hosts")
    kept = scratch.store(differenced(spark, files, parts, marks), "kept")
    scratch.drop("lists", "sorted")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(lines_of(h.as_py()), k.as_py()) for h, k in zip(part.column(2), part.column(3))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(kept, ["k1", "k2"], "left").select("page_id", "url", "html", "keep").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
