"""HTML extraction by differencing pages with nearby URLs.

Pages are sorted by host and URL path, so that each page stands next to the
pages of its host whose paths are most like its own.  A page's text is cut into
lines (blocks).  The lines of a page and of its nearest neighbour are aligned
by a longest common subsequence, and lines that both pages have are template:
they are deleted, and with them the rest of any box that consists mostly of
deleted lines.  All lines outside the declared article are asked, those of
menus and footers too.

Markup says more where it is there: what stands in a menu, header, footer,
sidebar, form, notice, advert or comment box goes even if the neighbour has
other words there, and what stands in the declared article stays even if the
neighbour is a copy or quotes the same passage.

Only 64-bit marks of lines are sorted.  The range sort has the page id as last
key, so a host with a third of all pages is spread over many tasks.  The first
and last pages of each task meet those of the tasks beside it in joins on the
task's number.  Texts are shuffled once, to meet the verdicts on their lines.
A page whose host has no other page is read by its markup.
"""

from __future__ import annotations

import html
import itertools
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.batches import sliced, small_batches
from assayframe.llm.url_rules import host_of, path_of
from assayframe.sources.storage import write_shared

# Elements by their part in a page.
PLAIN = ("script", "style", "textarea")  # hold no markup and run to the end of the page if nothing closes them
RAW = ("noscript", "template", "svg", "iframe", "object", "canvas", "select", "button", "math", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
BOXES = frozenset("article aside body blockquote details dialog div dl figure footer form header main menu nav ol section table td th ul html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEMPLATE_TAGS = frozenset("nav footer aside form dialog menu head title".split())
TEMPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo recommended related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
TEMPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CONTENT_NAMES = frozenset("article articlebody body content entry main post story text".split())
SKIPPED = r"<!--.*?(?:-->|\Z)|<(" + "|".join(PLAIN) + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
RAW_TAG = re.compile(SKIPPED + "|<(/?)(" + "|".join(RAW) + r")(?=[\s/>])(?:[^>]*[\s\"'])?(?:(/)>|[^>]*>)", re.S | re.I)
TOKEN = re.compile(
    SKIPPED + r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-label)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
MOSTLY = 0.6
LINE = "\n"


@dataclass
class Line:
    """A block of text: whether it is in the declared article, in a template box, and the box it stands in."""

    text: str
    article: bool
    template: bool
    box: int


def part_of(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element opens the article, and whether it opens a template box."""
    if tag in TEMPLATE_TAGS or (tag == "header" and not in_article):
        return False, True
    article, template = tag in ("article", "main"), False
    for name, *values in NAMED.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values).strip().lower()
        if name == "role":
            template, article = template or value in TEMPLATE_ROLES, article or value == "main"
        elif name == "itemprop":
            article = article or value == "articlebody"
        elif name in ("class", "id") and tag not in ("body", "html", "main"):
            for word in value.split():
                pieces = re.split(r"[-_]+", word)
                if in_article and tag not in BOXES and (name == "id" or len(pieces) > 1 or tag in HEADINGS):
                    continue  # a heading or paragraph of the article: at most a whole class says that it is none
                own_title = pieces[-1] == "header" and pieces[0] in CONTENT_NAMES
                template = template or bool({pieces[0], pieces[-1]} & TEMPLATE_NAMES) and not own_title
    return article and not template, template


def raw_ends(page: str) -> dict[int, int]:
    """Where each closed raw element starts and ends; one that is closed in its own tag, or never, is not in it."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for match in RAW_TAG.finditer(page):
        if not match[3]:
            continue
        starts = opened.setdefault(match[3].lower(), [])
        if match[2]:
            if starts:
                ends[starts.pop()] = match.end()
        elif not match[4]:
            starts.append(match.start())
    return ends


def lines_of(page: str) -> list[Line]:
    """The blocks of a page in page order, without scripts, styles and markup."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, in the article, in a template box, box
    held: list[str] = []
    article, template, box, boxes, at = False, False, 0, 0, 0

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                lines.append(Line(text, article, template, box))

    ends = raw_ends(page)
    while match := TOKEN.search(page, at):
        if match.start() > at:
            held.append(page[at : match.start()])
        at = ends.get(match.start(), match.end())
        tag = match[3].lower() if match[3] else ""
        if not tag or tag in RAW:
            if match[1] or tag:
                held.append(" ")
            continue
        if tag in ("br", "td", "th"):
            held.append(" ")
        if tag in BREAKS:
            flush()
        if match[2]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    _, article, template, box = stack[-1] if stack else ("", False, False, 0)
                    break
                if stack[depth][0] in BOXES and tag not in BOXES:
                    break  # an end tag without a start does not leave its box
        elif tag not in VOID:
            opens_article, opens_template = part_of(tag, match[4], article)
            article, template = article or opens_article, template or opens_template
            if tag in BOXES:
                boxes += 1
                box = boxes
            stack.append((tag, article, template, box))
    if at < len(page):
        held.append(page[at:])
    flush()
    return lines


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence, by bit-parallel rows."""
    start, stop_a, stop_b = 0, len(a), len(b)
    while start < min(stop_a, stop_b) and a[start] == b[start]:
        start += 1
    while stop_a > start and stop_b > start and a[stop_a - 1] == b[stop_b - 1]:
        stop_a, stop_b = stop_a - 1, stop_b - 1
    found = set(range(start)) | set(range(stop_a, len(a)))
    in_a = set(a[start:stop_a])
    columns = [line for line in b[start:stop_b] if line in in_a]
    in_b = set(columns)
    rows = [i for i in range(start, stop_a) if a[i] in in_b]
    where: dict[str, int] = {}
    for j, line in enumerate(columns):
        where[line] = where.get(line, 0) | 1 << j
    whole = (1 << len(columns)) - 1
    state, states = whole, []
    for i in rows:
        hit = state & where[a[i]]
        state = ((state + hit) | (state - hit)) & whole
        states.append(state)
    i, j = len(rows), len(columns)
    while i and j:
        if states[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or states[i - 1] >> (j - 1) & 1:
                j -= 1
                found.add(rows[i])
    return found


def shared_lines(lines: list[tuple], other: list[tuple] | None) -> set[int]:
    """Lines outside the declared article that the neighbour has too, and the rest of boxes that mostly consist of such lines.

    A line is (mark, article, template, box); lines with equal marks are equal.
    Template boxes are compared like all else outside the article.  A neighbour
    that has every line outside template boxes is a copy and says nothing.
    """
    if not other or not lines:
        return set()
    common = common_lines([line[0] for line in lines], [line[0] for line in other])
    body = [i for i, (_, _, template, _) in enumerate(lines) if not template]
    if all(i in common for i in body):
        return set()
    plain = [i for i in body if not lines[i][1]]
    held: dict[int, list[int]] = {}
    for i in plain:
        held.setdefault(lines[i][3], []).append(i)
    common.difference_update([i for i in body if lines[i][1]])
    for members in held.values():
        if len(members) > 2 and len(members) < len(plain) and sum(i in common for i in members) >= MOSTLY * len(members):
            common.update(members)
    return common


def main_lines(lines: list[Line]) -> list[int]:
    """Where a page's text may stand: in its declared article if it has one, else outside all template boxes."""
    article = [i for i, line in enumerate(lines) if line.article and not line.template]
    return article or [i for i, line in enumerate(lines) if not line.template]


def main_text(lines: list[Line], shared: set[int]) -> str:
    """What is left of a page."""
    return LINE.join(lines[i].text for i in main_lines(lines) if i not in shared)


def alike(a: str, b: str) -> int:
    """Length of the common beginning of two paths."""
    for i, (x, y) in enumerate(zip(a, b)):  # noqa: B905 - to the end of the shorter one
        if x != y:
            return i
    return min(len(a), len(b))


# A page without its text: what neighbours are compared by.
PRINT = [
    ("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("digest", pa.int64()), ("marks", pa.list_(pa.int64())),
    ("kinds", pa.binary()), ("boxes", pa.list_(pa.int32())),
]
PRINT_SPEC = "host string, path string, page_id long, digest long, marks array<long>, kinds binary, boxes array<int>"
VERDICT = [("page_id", pa.int64()), ("digest", pa.int64()), ("shared", pa.list_(pa.bool_())), ("n_shared", pa.int64())]
VERDICT_SPEC = "page_id long, digest long, shared array<boolean>, n_shared long"


def batch_of(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))


def parsed(batches):
    """(row, lines) of every page; ``html`` is the last column."""
    for batch in sliced(batches, "html"):
        for *row, page in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            yield row, lines_of(page) if page else []


def in_batches(rows, kinds, most: int = 512):
    """Rows as Arrow batches of at most ``most`` rows."""
    rows = iter(rows)
    while some := list(itertools.islice(rows, most)):
        yield batch_of(some, kinds)


def prints_of(batches):
    """The line marks of pages that have neighbours."""
    def rows():
        for (host, path, page_id, digest), lines in parsed(batches):
            marks = [int.from_bytes(xxhash.xxh3_64_digest(line.text), "big", signed=True) for line in lines]
            yield host, path, page_id, digest, marks, bytes(line.article + 2 * line.template for line in lines), [line.box for line in lines]

    yield from in_batches(rows(), PRINT)


def texts_of_pages(batches):
    """The lines that may be a page's text, and where in the page they stand."""
    kinds = [("page_id", pa.int64()), ("digest", pa.int64()), ("url", pa.string()), ("lines", pa.list_(pa.string())), ("places", pa.list_(pa.int32())), ("n_lines", pa.int64())]

    def rows():
        for (page_id, digest, url), lines in parsed(batches):
            places = main_lines(lines)
            yield page_id, digest, url, [lines[i].text for i in places], places, len(lines)

    yield from in_batches(rows(), kinds, 128)


def judged(before: dict | None, this: dict, after: dict | None):
    """The verdict on a page: which of its lines its nearest neighbour, or else the one on the other side, shares; None if none."""
    near = [x for x in (before, after) if x is not None and x["host"] == this["host"]]
    near.sort(key=lambda x: -alike(this["path"], x["path"]))
    lines = compared(this)
    for other in near:
        if shared := shared_lines(lines, compared(other)):
            return this["page_id"], this["digest"], [i in shared for i in range(len(lines))], len(shared)
    return None


def compared(page: dict) -> list[tuple]:
    return [(mark, bool(kind & 1), bool(kind & 2), box) for mark, kind, box in zip(page["marks"], page["kinds"], page["boxes"], strict=True)]


def run_along(batches):
    """Verdicts on the pages inside a task, and one row with the two first and the two last pages of the task."""
    ends = pa.list_(pa.struct(PRINT))
    kinds = [*VERDICT, ("task", pa.int32()), ("head", ends), ("tail", ends)]
    context = TaskContext.get()
    head, tail = [], []

    def rows():
        for page in (page for batch in batches for page in batch.to_pylist()):
            if len(tail) == 2:
                if found := judged(tail[0], tail[1], page):
                    yield *found, None, None, None
                del tail[0]
            tail.append(page)
            if len(head) < 2:
                head.append(page)
        if head:
            yield None, None, None, None, context.partitionId() if context else 0, head, tail

    yield from in_batches(rows(), kinds)


def at_cuts(batches):
    """Verdicts on the first and the last page of each task, among the pages on both sides of the cuts."""
    def rows():
        for task in (row for batch in batches for row in batch.to_pylist()):
            head, tail = task["head"], task["tail"]
            yield judged(task["before"], head[0], head[1] if len(head) > 1 else task["after"])
            if len(head) > 1:
                yield judged(tail[0], tail[1], task["after"])

    yield from in_batches(filter(None, rows()), VERDICT)


def verdicts(pages: DataFrame) -> DataFrame:
    """(page_id, digest, shared, n_shared) of the pages that share a line with a neighbour; ``pages`` has a host in every row."""
    order = ("host", "path", "page_id", "digest")
    prints = write_shared(small_batches(pages.select(*order, "html")).mapInArrow(prints_of, PRINT_SPEC), "prints")
    prints = prints.dropDuplicates(list(order)).repartitionByRange(*order).sortWithinPartitions(*order)
    ends = f"array<struct<{PRINT_SPEC.replace(' ', ':').replace(',:', ',')}>>"
    found = write_shared(prints.mapInArrow(run_along, f"{VERDICT_SPEC}, task int, head {ends}, tail {ends}"), "verdicts")
    cuts = found.where("task IS NOT NULL").select("task", "head", "tail")
    numbers = Window.orderBy("task")  # over the numbers of tasks, not over pages
    beside = cuts.select("task", F.lag("task").over(numbers).alias("_left"), F.lead("task").over(numbers).alias("_right"))
    left = cuts.select(F.col("task").alias("_left"), F.element_at("tail", -1).alias("before"))
    right = cuts.select(F.col("task").alias("_right"), F.element_at("head", 1).alias("after"))
    cuts = cuts.join(beside, "task").join(left, "_left", "left").join(right, "_right", "left").select("head", "tail", "before", "after")
    inside = found.where("task IS NULL").select("page_id", "digest", "shared", "n_shared")
    return inside.union(cuts.mapInArrow(at_cuts, VERDICT_SPEC))


def extract(pages: DataFrame, page_id="page_id", url="url", page="html") -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared): the main text of every page.

    A missing page has an empty text.  Pages without a host, or alone on theirs,
    are read by their markup.  Repeated rows are one page to their neighbours
    and are all returned; a copy under another URL is passed over for the
    neighbour on the other side.  Missing ids are ids of their own.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    rows = rows.withColumn("digest", F.xxhash64("page_id", "url", "html"))
    hosted = rows.where("html <> ''").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).where("host <> ''")
    known = verdicts(hosted).withColumnsRenamed({"page_id": "_page_id", "digest": "_digest"})
    spec = "page_id long, digest long, url string, lines array<string>, places array<int>, n_lines long"
    texts = small_batches(rows.select("page_id", "digest", "url", "html")).mapInArrow(texts_of_pages, spec)
    texts = texts.join(known, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page_id")), "left")
    left = F.when(F.col("shared").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda line, i: ~F.col("shared")[F.col("places")[i]]))
    texts = texts.withColumn("text", F.array_join(left, LINE))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
