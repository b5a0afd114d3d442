"""Main texts of web pages, by differencing each page with the page of the nearest URL.

Pages are sorted by host and URL path. A page is paired with the neighbour whose path shares the
longer prefix and whose lines are not nearly all equal, their lines are aligned by longest common subsequence, and lines
that both have are deleted as part of the site's frame. Lines of an ``article`` or ``main`` element are exempt (sites
repeat articles too), and a check on the markup then drops what a frame holds without sharing it: menus,
headers, footers, sidebars, notices, adverts, forms and comments, by element, role and class. Lines that neither the main
element nor a frame holds, such as a headline before the article, are decided by the differencing: on a page without main element always, on
others if the pair has most of the page's frame in common, as else a line beside the main element tells nothing by not being shared.
"""

from __future__ import annotations

import html as htmllib
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

from tracemill.llm.common import Scratch, check_columns

MAIN, FRAME, PLAIN = 0, 1, 2
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tags pages leave out.
LOOSE = frozenset("p li dt dd tr td th option thead tbody tfoot html body head".split())
SKIPPED = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "button", "object", "math", "canvas", "audio", "video")
FRAME_ELEMENTS = frozenset("nav footer aside form head menu dialog search".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments "
    "disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager skip".split()
)
#: What the name of a frame may hold besides, as in ad-slot or comment-list.
PLACE_WORDS = frozenset("area bar block box container content inner item items link links list outer section slot unit wrap wrapper".split())
#: Lines two pages share, of the longer page's, from which on they count as copies and are not differenced.
COPIES = 0.9
#: Lines of a page's frame that the pair has in common, from which on the differencing is believed beside a main element.
FRAME_SEEN = 0.5
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<[/a-zA-Z][^<>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+")
_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")


def _is_frame(name: str, attributes: str, inside_main: bool) -> bool:
    if name in FRAME_ELEMENTS or name == "header" and not inside_main:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, names = key.lower(), value.strip("\"'").lower().split()
        if key == "hidden" or key == "aria-hidden" and "true" in names or key == "role" and not FRAME_ROLES.isdisjoint(names):
            return True
        if key in ("class", "id") and any(_names_frame(name, inside_main) for name in names):
            return True
    return False


def _names_frame(name: str, inside_main: bool) -> bool:
    """Whether a class or id as a whole names a frame: ``ad``, ``cookie-banner`` or ``comment-list``, not ``share-price``.

    In a main element ``header`` is the article's own, as the element of that name is.
    """
    words = _WORD.findall(name)
    telling = FRAME_WORDS.intersection(words) - ({"header"} if inside_main else set())
    return bool(telling) and FRAME_WORDS.union(PLACE_WORDS).issuperset(words)


def lines(page: str | None) -> list[tuple[int, str]]:
    """Zone and text of every block that has text, in page order. Open elements at the end count as closed."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    text: list[str] = []
    zone, at, page = PLAIN, 0, page or ""
    ends: dict[str, re.Pattern] = {}

    def flush() -> None:
        found = " ".join(htmllib.unescape("".join(text)).split())
        text.clear()
        if found:
            out.append((zone, found))

    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            text.append(page[at:])
            break
        text.append(page[at : token.start()])
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if name in SKIPPED:
            if not token[1] and not token[0].endswith("/>"):
                end = ends.setdefault(name, re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I)).search(page, at)
                at = end.end() if end else len(page)
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            text.append(" ")
        if token[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                if name not in BLOCKS and any(zone_ != stack[depth][1] for _, zone_ in stack[depth:]):
                    flush()
                before = stack[depth - 1][1] if depth else PLAIN
                if before != zone:
                    flush()
                del stack[depth:]
                zone = before
        elif name not in VOID and not token[0].endswith("/>"):
            while stack and stack[-1][0] in LOOSE and stack[-1][0] == name:
                stack.pop()
                zone = stack[-1][1] if stack else PLAIN
            inner = zone
            if zone != FRAME and _is_frame(name, token[3], zone == MAIN):
                inner = FRAME
            elif name in ("article", "main") and (zone == PLAIN or all(z != FRAME or n in LOOSE for n, z in stack)):
                inner = MAIN
            if inner != zone or name not in LOOSE:
                if inner != zone:
                    flush()
                stack.append((name, inner))
                zone = inner
    flush()
    return out


def address(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; without a host the whole counts as path."""
    found = _URL.match(url or "")
    return (found[1].lower(), found[2].rstrip("/")) if found else ("", url or "")


def shared(mine: list[str], other: list[str]) -> set[int]:
    """Positions in ``mine`` that a longest common subsequence aligns with ``other`` (Hunt and Szymanski)."""
    places: dict[str, list[int]] = {}
    for j, text in enumerate(other):
        places.setdefault(text, []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, text in enumerate(mine):
        for j in reversed(places.get(text, ())):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            elif j < ends[k]:
                ends[k], chains[k] = j, link
    out, link = set(), chains[-1] if chains else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def common_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def main_text(page: list[tuple[int, str]], other: list[str]) -> str:
    """The page's blocks without those shared with ``other``, the paired page's lines outside its main element.

    What the markup calls a frame goes as well. If there is a main element, own blocks outside it stay only
    if the pair has shown the frame: it shares ``FRAME_SEEN`` of what the markup calls so, and a line at all.
    """
    outside = [i for i, (zone, _) in enumerate(page) if zone != MAIN]
    aligned = shared([page[i][1] for i in outside], other)
    gone = {outside[k] for k in aligned}
    frame = [i for i in outside if page[i][0] == FRAME]
    seen = bool(gone) and len(gone.intersection(frame)) >= FRAME_SEEN * len(frame)
    wanted = (MAIN, PLAIN) if seen or len(outside) == len(page) else (MAIN,)
    return "\n\n".join(t for i, (zone, t) in enumerate(page) if i not in gone and zone in wanted)


def frame_lines(page: list[tuple[int, str]]) -> list[str]:
    return [t for zone, t in page if zone != MAIN]


def copies(page: list[tuple[int, str]], other: list[tuple[int, str]]) -> bool:
    """Whether nearly all lines of either page are the other's too, so that what they share is no frame.

    A page with a main element is compared whole, as all outside it may be the site's frame.
    """
    mine, theirs = frame_lines(page), frame_lines(other)
    whole = len(mine) < len(page)
    if whole:
        mine, theirs = [t for _, t in page], [t for _, t in other]
    least = COPIES * max(len(mine), len(theirs))
    if min(len(mine), len(theirs)) < least:
        return False
    return ((Counter(mine) & Counter(theirs)).total() if whole else len(shared(mine, theirs))) >= least


Neighbour = tuple[str, list[tuple[int, str]]]


def nearest(path: str, page: list[tuple[int, str]], before: Neighbour | None, after: Neighbour | None) -> list[str]:
    """The outside lines of the neighbour with the longer common path prefix, the former one of equals; copies of the page do not count."""
    before, after = (n if n and not copies(page, n[1]) else None for n in (before, after))
    if before and (not after or common_prefix(path, before[0]) >= common_prefix(path, after[0])):
        return frame_lines(before[1])
    return frame_lines(after[1]) if after else []


def packed(page: list[tuple[int, str]]) -> bytes:
    """Lines as they are shuffled and stored: compressed, as page texts are most of the bytes moved."""
    return zstandard.compress(json.dumps(page, ensure_ascii=False).encode("utf-8", "replace"))


def unpacked(raw: bytes) -> list[tuple[int, str]]:
    return [(zone, line) for zone, line in json.loads(zstandard.decompress(raw))]


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row; text is empty if there is none, also for null html.

    Pages are range-partitioned by (host, path, page_id), so a host of any size spreads over tasks, and each
    task walks its sorted pages. The first and the last page of a task have a neighbour in another task; these pages,
    two a task, are stored and joined with their neighbours, so results do not depend on the cuts. Rows
    of equal URL are ordered by page_id and then by content; null URLs are a host of their own; a page without neighbours
    on its host, or between copies of itself, is left to the markup check: of a page with a main element its lines
    then, of another all that is no frame.
    """
    check_columns(pages, "page_id", "url", "html")
    id_type = pages.schema["page_id"].dataType
    spark = pages.sparkSession
    key = [StructField("page_id", id_type), StructField("url", StringType()), StructField("host", StringType()), StructField("path", StringType())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lines(h.as_py()), address(u.as_py())) for u, h in zip(batch.column(1), batch.column(2), strict=True)]
            found = pa.array([packed(page) for page, _ in rows], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([a[0] for _, a in rows], pa.string()), pa.array([a[1] for _, a in rows], pa.string()), found], ["page_id", "url", "host", "path", "page"])

    parsed = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(parse, StructType([*key, StructField("page", BinaryType())]))
    parsed = parsed.withColumn("tie", F.xxhash64("page"))
    order = ["host", "path", "page_id", "tie"]
    stored = Scratch(spark).save(parsed.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").mapInArrow(_walk, StructType([*key, *_RESULT])))
    done = stored.where("part is null").select("page_id", "url", "text")
    edges = stored.where("part is not null").select("page_id", "url", "host", "path", "page", "part", "first", "last", "other_path", "other_page")
    parts = sorted(r["part"] for r in edges.where("first").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:], strict=False)), "left int, right int")
    side = lambda which, name: edges.where(which).select(F.col("part").alias(name), F.struct("host", "path", "page").alias(f"{name}_row"))
    pairs = follows.join(side("last", "left"), "left").join(side("first", "right"), "right")
    pairs = pairs.where("left_row.host = right_row.host")
    beyond = edges.join(pairs.select(F.col("right").alias("part"), F.lit(True).alias("first"), F.col("left_row").alias("before")), ["part", "first"], "left")
    beyond = beyond.join(pairs.select(F.col("left").alias("part"), F.lit(True).alias("last"), F.col("right_row").alias("after")), ["part", "last"], "left")
    settled = beyond.select("page_id", "url", "path", "page", "first", "last", "other_path", "other_page", "before", "after").mapInArrow(
        _settle, StructType([*key[:2], StructField("text", StringType())])
    )
    return done.unionByName(settled).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


#: ``text`` of settled pages; what the first and last page of a task (``part``) need to be settled later.
_RESULT = [
    StructField("text", StringType()),
    StructField("part", IntegerType()),
    StructField("first", BooleanType()),
    StructField("last", BooleanType()),
    StructField("page", BinaryType()),
    StructField("other_path", StringType()),
    StructField("other_page", BinaryType()),
]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    names = ["page_id", "url", "host", "path", *[f.name for f in _RESULT]]
    before, current, count = None, None, 0

    def near(row: dict, neighbour: dict | None) -> Neighbour | None:
        same = neighbour is not None and neighbour["host"] == row["host"]
        return (neighbour["path"], neighbour["page"]) if same else None

    def settled(row: dict, after: dict | None) -> dict:
        first, last = count == 1, after is None
        out = {k: row[k] for k in names[:4]} | dict.fromkeys(names[4:])
        left, right = near(row, before), near(row, after)
        if first or last:
            other = right if first else left
            out |= {"part": part, "first": first, "last": last, "page": packed(row["page"])}
            return out | ({"other_path": other[0], "other_page": packed(other[1])} if other else {})
        return out | {"text": main_text(row["page"], nearest(row["path"], row["page"], left, right))}

    def record(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    schema = None
    for batch in batches:
        if schema is None:
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.string(), pa.binary()]
            schema = pa.schema(list(zip(names, types, strict=True)))
        rows = []
        for row in batch.to_pylist():
            row["page"] = unpacked(row["page"])
            if current is not None:
                count += 1
                rows.append(settled(current, row))
            before, current = current, row
        yield record(rows, schema)
    if current is not None:
        count += 1
        yield record([settled(current, None)], schema)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def near(row: dict | None) -> Neighbour | None:
        return (row["path"], unpacked(row["page"])) if row else None

    for batch in batches:
        texts = []
        for row in batch.to_pylist():
            inside = (row["other_path"], unpacked(row["other_page"])) if row["other_path"] is not None else None
            left = near(row["before"]) if row["first"] else inside
            right = near(row["after"]) if row["last"] else inside
            page = unpacked(row["page"])
            texts.append(main_text(page, nearest(row["path"], page, left, right)))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])
