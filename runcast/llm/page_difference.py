"""HTML extraction by differencing each page with its nearest pages by URL.

Every page becomes its text lines (blocks), each with the path of elements it stands under. Copies of a page
are one. Pages are put in order of host and path, and each is compared with the NEIGHBOURS different pages
before it: lines are aligned by longest common subsequence, and a line that some neighbour has too counts as
shared. Neighbours that have most of a page's text are other versions of it; they say nothing about the
frame. Lines vote for the element path they stand under: where a path's lines are shared FRAME_SHARE of the
time or more, the path is the site's frame on that host and its lines go, also those this page alone has. A
host's votes are joined by those of all hosts, as if these were PRIOR_LINES more lines. What pages do not
share stays, also where two pages quote one text.

Markup corrects what differencing cannot tell: lines of paths that are not shared but that stand in an advert,
a comment, a footer or the like go; lines in an article go only if their path is shared SURE_SHARE of the time
on THIN_PAGES pages or more; a page without any other page of its host is told by its markup alone.

The order is cut into blocks by position, each with the last pages of the block before it, so the result does
not depend on how rows lie in partitions, and a host with a third of all pages is spread over many tasks.
Only numbers of lines and paths move for that; the pages themselves are read again at the end.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runcast.llm.url_verdicts import url_host, url_path
from runcast.operators.keyed import attach
from runcast.session import materialize

NEIGHBOURS = 32  # pages before it that a page is compared with
BLOCK_PAGES = 512
FRAME_SHARE, SURE_SHARE, PRIOR_LINES = 0.2, 0.6, 100
COPY_SHARE = 0.7  # a neighbour with so much of the smaller page's text is a version of it
THIN_PAGES = 3

# fixed values of HTML: elements that end a line, hold no text, or hold no main text
_BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section
summary table tbody td tfoot th thead title tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "select", "title", "object", "math")
_FRAME = frozenset("nav footer aside form menu dialog button head".split())
_FRAME_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar".split())
_FRAME_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner
sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent notice notices popup modal
newsletter subscribe comment comments disqus reply replies share sharing social related widget widgets toolbar
pagination pager login signup search skip masthead topbar""".split())
_CONTENT = ("article", "main")
# what an article of its own may be called that is not the page's text
_ASIDE_NAMES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related teaser".split())
# frames that may stay open by mistake, or wrap a whole page
_WRAPPERS = frozenset("head nav header menu form dialog".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(_RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^\"'>])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>"
    r"|<[!?/a-zA-Z][^>]*>|<[a-zA-Z/!?][^<>]*\Z|(?P<text>[^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


@dataclass
class Page:
    """The lines of one page, in order, with where they stand."""

    lines: list[str] = field(default_factory=list)
    in_article: list[int] = field(default_factory=list)  # 2 inside an article, 1 inside the main part only
    in_frame: list[bool] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)

    def main_text(self, frame: dict[str, bool] | None = None) -> str:
        """The lines outside the site's ``frame``: element paths, and whether they surely are."""
        return " ".join(self.lines[i] for i in self.kept(frame))

    def kept(self, frame: dict[str, bool] | None) -> list[int]:
        if frame is None:  # nothing to compare with: the innermost part that has text
            keep = [i for i in range(len(self.lines)) if not self.in_frame[i]]
            level = max((self.in_article[i] for i in keep), default=0)
            return [i for i in keep if self.in_article[i] == level]
        goes = lambda i: frame.get(self.paths[i], False) or self.paths[i] in frame and not self.in_article[i]
        return [i for i in range(len(self.lines)) if not self.in_frame[i] and not goes(i)]


def _is_frame(name: str, attrs: str, in_article: bool) -> bool:
    if name in _FRAME or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body"):
        return False
    names = _ASIDE_NAMES if name in _CONTENT else _FRAME_NAMES
    for key, *values in _NAMES.findall(attrs):
        words = re.split(r"[\s_-]+", "".join(values).lower())
        if (_FRAME_ROLES if key.lower() == "role" else names).intersection(words):
            return True
    return False


def parse_page(markup: str | None) -> Page:
    """Lines of decoded text; white space inside a line is one space. Tags may be unclosed or cut off."""
    page, stack, parts = Page(), [], []
    frames, depth = 0, {"article": 0, "main": 0}

    def end_line() -> None:
        if parts:
            line = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if line:
                page.lines.append(line)
                page.in_article.append(2 if depth["article"] else 1 if depth["main"] else 0)
                page.in_frame.append(frames > 0)
                page.paths.append(">".join(dict.fromkeys(name for name, _ in stack if name in _BLOCKS)))

    for token in _TOKEN.finditer(markup or ""):
        text, name = token["text"], token["name"]
        if text is not None:
            parts.append(text)
            continue
        if name is None:
            if token["raw"]:
                end_line()
            continue
        name = name.lower()
        if name in _BLOCKS:
            end_line()
        if name in _VOID:
            continue
        if token["close"]:
            if any(open_name == name for open_name, _ in stack):
                while stack:
                    open_name, frame = stack.pop()
                    frames -= frame
                    if open_name in depth:
                        depth[open_name] -= 1
                    if open_name == name:
                        break
            continue
        if token["attrs"].rstrip().endswith("/"):
            continue
        frame = _is_frame(name, token["attrs"], any(depth.values()))
        if name in depth and not frame and not any(depth.values()) and frames and all(
                open_name in _WRAPPERS for open_name, is_frame in stack if is_frame):
            # a frame that was never closed, or holds the whole page, ends where the article begins
            stack, frames = [(open_name, False) for open_name, _ in stack], 0
        stack.append((name, frame))
        frames += frame
        if name in depth:
            depth[name] += 1
    end_line()
    return page


def common_lines(left: list[str], right: list[str]) -> tuple[set[int], set[int]]:
    """Which lines of each side a longest common subsequence aligns (bit-parallel rows, then a walk back)."""
    both = set(left) & set(right)
    rows = [i for i, line in enumerate(left) if line in both]
    columns = [j for j, line in enumerate(right) if line in both]
    masks: dict[str, int] = {}
    for bit, j in enumerate(columns):
        masks[right[j]] = masks.get(right[j], 0) | 1 << bit
    full = (1 << len(columns)) - 1
    state, states = full, []
    for i in rows:
        matched = state & masks[left[i]]
        state = ((state + matched) | (state - matched)) & full
        states.append(state)
    used_left, used_right, row, column = set(), set(), len(rows), len(columns)
    while row and column:
        if states[row - 1] >> (column - 1) & 1:
            column -= 1
            continue
        row -= 1
        if row and not states[row - 1] >> (column - 1) & 1:
            continue
        column -= 1
        used_left.add(rows[row])
        used_right.add(columns[column])
    return used_left, used_right


def _line_number(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


_LINES = ["lines", "sizes", "places"]
_SIGNED = "host string, path string, url string, content long, lines array<long>, sizes array<long>, places array<string>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the lines of every page of a host, their sizes and their element paths."""
    longs = pa.list_(pa.int64())
    for batch in batches:
        pages = [parse_page(markup) for markup in batch.column("html").to_pylist()]
        lines = [[_line_number(line) for line in page.lines] for page in pages]
        content = [xxhash.xxh64_intdigest(repr((own, page.paths)).encode("utf-8", "surrogatepass")) - (1 << 63)
                   for own, page in zip(lines, pages, strict=True)]
        yield pa.record_batch([*[batch.column(c) for c in ("host", "path", "url")], pa.array(content, pa.int64()),
                               pa.array(lines, longs), pa.array([[len(line) for line in page.lines] for page in pages], longs),
                               pa.array([page.paths for page in pages], pa.list_(pa.string()))],
                              ["host", "path", "url", "content", *_LINES])


@dataclass
class Lines:
    """One page as numbers."""

    lines: list[int]
    sizes: list[int]
    places: list[str]

    def __post_init__(self) -> None:
        self.own, self.whole = set(self.lines), sum(self.sizes)


def shared_lines(page: Lines, before: list[Lines]) -> set[int] | None:
    """Lines of the page that an alignment with one of the pages before it has; None if none could be compared."""
    shared: set[int] = set()
    compared = False
    for other in before:
        if page.own.isdisjoint(other.own):
            compared = True
            continue
        old, new = common_lines(other.lines, page.lines)
        if sum(page.sizes[i] for i in new) > COPY_SHARE * min(page.whole, other.whole):
            continue
        compared = True
        shared |= new
    return shared if compared else None


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines, shared lines and pages by host and element path; rows come by block and in order, context first."""
    names = ["host", "place", "n", "shared", "pages"]
    block, before, host = None, [], None
    counts: dict[str, list[int]] = {}

    def told() -> pa.RecordBatch:
        columns = [[host] * len(counts), list(counts), *map(list, zip(*counts.values(), strict=True))]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), *[pa.int64()] * 3],
                                                               strict=True)], names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("block", "context", "host", *_LINES)]
        for own_block, context, own_host, *own in zip(*columns, strict=True):
            if own_host != host or own_block != block:
                if counts:
                    yield told()
                block, host, before, counts = own_block, own_host, [], {}
            page = Lines(*own)
            shared = None if context else shared_lines(page, before)
            if shared is not None:
                for path, n in Counter(page.places).items():
                    count = counts.setdefault(path, [0, 0, 0])
                    count[0] += n
                    count[2] += 1
                for line in shared:
                    counts[page.places[line]][1] += 1
            before = [*before, page][-NEIGHBOURS:]
    if counts:
        yield told()


def path_votes(pages: DataFrame) -> DataFrame:
    """(host, place, n, shared, pages, share) of every element path of hosts with at least two different pages.

    ``share`` has the votes of all hosts in it.
    """
    signed = pages.where("host <> ''").mapInArrow(_signatures, _SIGNED)
    first = F.min_by(F.struct("path", "url", *_LINES), F.struct("path", "url")).alias("first")
    distinct = signed.groupBy("host", "content").agg(first)
    order = ["host", "path", "url", "content"]
    ranged = materialize(distinct.select("host", "content", "first.*").repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "page-lines")
    counts = ranged.groupBy("part").agg(F.count("*").alias("held"), F.min("at").alias("first_at"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.withColumn("offset", F.coalesce(F.sum("held").over(earlier), F.lit(0))).select("part", "first_at", "offset")
    placed = attach(ranged, offsets, ["part"]).withColumn("number", F.col("at") - F.col("first_at") + F.col("offset"))
    block = F.floor(F.col("number") / BLOCK_PAGES)
    late = F.col("number") % BLOCK_PAGES >= BLOCK_PAGES - NEIGHBOURS  # these open the next block as well
    use = lambda number, context: F.struct(number.alias("block"), F.lit(context).alias("context"))
    uses = F.when(late, F.array(use(block, False), use(block + 1, True))).otherwise(F.array(use(block, False)))
    blocks = placed.select("number", "host", *_LINES, F.inline(uses))
    dealt = blocks.repartition("block").sortWithinPartitions("block", "number")
    votes = materialize(dealt.mapInArrow(_votes, "host string, place string, n long, shared long, pages long").groupBy(
        "host", "place").agg(*[F.sum(c).alias(c) for c in ("n", "shared", "pages")]), "votes")
    overall = votes.groupBy("place").agg((F.sum("shared") / F.sum("n")).alias("overall"))
    share = (F.col("shared") + PRIOR_LINES * F.col("overall")) / (F.col("n") + PRIOR_LINES)
    return attach(votes, overall, ["place"]).withColumn("share", share).drop("overall")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for frame, markup in zip(batch.column("frame").to_pylist(), batch.column("html").to_pylist(), strict=True):
            texts.append(parse_page(markup).main_text(None if frame is None else {f["place"]: f["sure"] for f in frame}))
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                               pa.array([len(text) for text in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page has an empty text. A page without a host, or whose host has no other page, is told by
    its markup only. Repeated pages stay repeated; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"),
                        F.coalesce(url_path(F.col("url")), F.lit("")).alias("path"), F.col("html").cast("string").alias("html"))
    sure = (F.col("share") >= SURE_SHARE) & (F.col("pages") >= THIN_PAGES)
    frames = path_votes(rows).groupBy("host").agg(F.collect_list(F.when(
        F.col("share") >= FRAME_SHARE, F.struct("place", sure.alias("sure")))).alias("frame"))
    known = attach(rows.drop("path"), frames, ["host"])
    kind = rows.schema["page_id"].dataType.simpleString()
    return known.mapInArrow(_told, f"page_id {kind}, url string, text string, n_chars long")
