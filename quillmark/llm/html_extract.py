"""HTML extraction by a maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags.  Words score positive and tags negative, each by the log odds
of standing inside the content, learned from labelled pages (a tag's first class name is part of the feature);
one linear scan finds the contiguous region with the largest sum.  A feature that no labelled page has counts as its
tag without the class name, and a tag that none has costs little.  Where a page names its content element, that element
is the least that the region holds: the scan may only add to it.  What the region holds of parts that are
never content (menus, forms, scripts, adverts and the like) is left out, and its blocks are written in page order.

Such parts are known by their element or role, or by a class or id name of a container all of whose parts say so: `sidebar`,
`cookie-banner`, `related-posts`, `site-footer`, but not `side-effects`, `social-science`, `has-sidebar`, `share-price`,
`study-cookies` or `dish-menu`, nor any name of a heading, a paragraph, a table or a figure.
Neither covers an element that an `article` or `main` stands in, and on pages without these names don't cover
most of a page's words.

Labels: pages whose markup names one content element (`article`, else `main`) label themselves.  At
most SAMPLE of them, by a hash of the page, are used; their share of the corpus falls as it grows.
Without such pages the priors decide.

Null and empty pages give empty text, as do pages without words.  Broken markup is taken as it comes:
unclosed elements end with their parent or the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk

#: Pages from which weights are learned.
SAMPLE = 2000
#: Scores of tags of parts that are never content, and of tags that no labelled page has.
UNWANTED_TAG, UNKNOWN_TAG = -0.05, -0.05

# Elements by their part in a page.
_NEVER = frozenset("script style noscript template head title svg math iframe object embed canvas audio video select option textarea button form input label nav footer aside menu dialog fieldset datalist".split())
_HEADER = frozenset(["header"])
#: Elements that label content.
_LABELS = ("article", "main")
_RAW = frozenset(["script", "style", "textarea", "title"])
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = _BLOCK - {"body", "html"}
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Names of parts that are no content, as a whole name or at the end of one; and what may follow them.
_UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners sponsor sponsored promo promos promotion sidebar sidebars comment comments commentlist disqus replies respond cookie cookies consent gdpr notice notices alert alerts newsletter newsletters subscribe signup "
    "popup popups modal modals overlay sharing social menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead related recommended widget widgets toolbar paywall login pagination pager".split()
)
_FOLLOWING = frozenset("area articles bar block box buttons container content feed form icons inner item items link links list panel posts row section slot stories thread unit wrap wrapper".split())
#: What may stand before such a name and leaves it what it is, and the elements that are containers.
_PLACES = frozenset("site page global main primary secondary left right top bottom side header sticky fixed floating inline mobile desktop user users reader readers visitor post posts article entry blog email mail social share external google wp js the".split())
_CONTAINERS = frozenset("div section ul ol li span center details table td tr aside header".split())
_STATES = frozenset("has have with without no not is are open show shows hide hides".split())
_UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _says_unwanted(names: str) -> bool:
    """Whether a class or id name as a whole names a part that is no content: each of its parts does, or says where or how."""
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_\d]+", name) if x]
        while len(parts) > 1 and parts[-1] in _FOLLOWING:
            parts.pop()
        if parts and parts[-1] in _UNWANTED and parts[0] not in _STATES and all(x in _UNWANTED or x in _PLACES or x in _FOLLOWING for x in parts):
            return True
    return False


class Node:
    """An element: its tag, its name for the weights, the block it is in, and whether it is never content."""

    __slots__ = ("block", "by_name", "holds", "key", "outer", "own", "started", "tag", "unwanted", "within", "words")

    def __init__(self, tag: str, attributes: str, outer: Node | None) -> None:
        self.tag, self.outer = tag, outer
        said = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        names = f"{said.get('class', '')} {said.get('id', '')}".strip()
        first = names.split()[0].lower() if names else ""
        self.key = f"{tag}.{first}" if first else tag
        around = outer.within if outer else frozenset()
        self.within = around | {tag} if tag in _LABELS and tag not in around else around
        self.block = self if tag in _BLOCK or outer is None else outer.block
        self.own = tag in _NEVER or (tag in _HEADER and "article" not in around) or said.get("role", "").lower() in _UNWANTED_ROLES or "hidden" in said or said.get("aria-hidden") == "true"
        self.by_name = tag in _CONTAINERS and bool(names) and _says_unwanted(names)
        self.holds, self.words, self.started, self.unwanted = False, 0, 0, False


Token = tuple[str, str, "Node | None"]


def tokens(page: str) -> list[Token]:
    """(kind, value, element): kinds are text, open and close; the element is the one around it.

    Every tag is looked at once and every element closed once, so the time is in proportion to the page.
    """
    out: list[Token] = []
    nodes: list[Node] = []
    open_: Counter = Counter()
    node: Node | None = None
    words = 0
    at, n = 0, len(page)

    def close(until: Node) -> None:
        nonlocal node
        while True:
            last = node
            last.words = words - last.started
            out.append(("close", last.key, last))
            open_[last.tag] -= 1
            node = last.outer
            if last is until:
                return

    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:
            out.append(("text", page[at], node))
            at += 1
            continue
        at = m.end()
        if m[4] is not None:
            out.append(("text", m[4], node))
            words += _words(m[4])
        elif m[2] is not None:
            tag = m[2].lower()
            if m[1]:
                if open_[tag] > 0:
                    up = node
                    while up.tag != tag:
                        up = up.outer
                    close(up)
                elif tag in ("p", "br"):
                    out.append(("break", tag, node))
            else:
                if tag in _CLOSES_P and node and (up := node.block).tag in _BLOCK:
                    if up.tag == "p" or (tag == "li" and up.tag == "li") or (tag in ("dt", "dd") and up.tag in ("dt", "dd")) or (tag in _HEADINGS and up.tag in _HEADINGS):
                        close(up)
                if tag in _VOID or m[3].endswith("/"):
                    out.append(("break" if tag == "hr" else "gap", tag, node))
                    continue
                node = Node(tag, m[3], node)
                node.started = words
                nodes.append(node)
                open_[tag] += 1
                out.append(("open", node.key, node))
                if tag in _LABELS:
                    up = node.outer
                    while up and not up.holds:
                        up.holds = True
                        up = up.outer
                if tag in _RAW:
                    end = re.compile(rf"</{tag}\b", re.I).search(page, at)
                    if end is None or end.start() > at:
                        out.append(("text", page[at : end.start() if end else n], node))
                    at = end.start() if end else n
    while node:
        close(node)
    labelled = any(x.tag in _LABELS for x in nodes)
    for x in nodes:
        own = (x.own and (not x.holds or x.tag in _RAW)) or (x.by_name and not x.holds and (labelled or 2 * x.words <= words))
        x.unwanted = own or bool(x.outer and x.outer.unwanted)
    return out


def _feature(kind: str, value: str, node: Node | None) -> str:
    if kind == "text":
        return f"text {node.block.key if node and node.block.tag in _BLOCK else ''}"
    return f"{kind} {value}"


def _words(text: str) -> int:
    return len(text.split())


def count_features(page: str) -> tuple[Counter, Counter] | None:
    """How often each feature stands inside and outside the labelled content; None if the page has no label."""
    inside, outside = Counter(), Counter()
    found = tokens(page)
    label = next((x for x in _LABELS if sum(k == "open" and n.tag == x for k, _, n in found) == 1), None)
    if label is None:
        return None
    for kind, value, node in found:
        border = kind in ("open", "close") and node is not None and node.tag == label
        if node is not None and node.unwanted:
            continue
        into = inside if node and label in node.within and not border else outside
        into[_feature(kind, value, node)] += _words(value) if kind == "text" else 1
    return inside, outside


class Weights:
    """The log odds of a feature's being content, a word at most 1 and a tag at most -0.02."""

    def __init__(self, inside: Counter, outside: Counter) -> None:
        self.known = {}
        for some in (inside, outside):  # a tag without its class name stands for classes that no page has
            for x, n in list(some.items()):
                if "." in x:
                    some[x.partition(".")[0]] += n
        for x in {*inside, *outside}:
            odds = math.log((inside[x] + 0.5) / (outside[x] + 0.5))
            self.known[x] = max(-6.0, min(1.0, odds / 2)) if x.startswith("text") else max(-40.0, min(-0.02, 4 * odds))

    def score(self, kind: str, value: str, node: Node | None, words: int) -> float:
        if node is not None and node.unwanted:
            # left out of the text in any case, so a region may span it
            return -0.01 * words if kind == "text" else UNWANTED_TAG
        feature = _feature(kind, value, node)
        known = self.known.get(feature)
        if known is None and "." in feature:
            known = self.known.get(feature.partition(".")[0])
        if kind == "text":
            return words * (known if known is not None else 0.5)
        return known if known is not None else UNKNOWN_TAG


def train(pages: DataFrame, html_column: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from at most `sample` labelled pages, the same ones in every run."""
    hashed = pages.filter(F.col(html_column).rlike(r"(?i)<(article|main)[\s>]")).select(F.xxhash64(html_column).alias("h"), html_column)
    # the hashes alone are ordered, so no page travels to be left out
    bound = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    some = hashed.filter(F.col("h") <= (bound if bound is not None else 0)).select(html_column)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found = count_features(page)
                if found:
                    inside += found[0]
                    outside += found[1]
        names = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())], names=["feature", "inside", "outside"])

    rows = some.mapInArrow(count, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    return Weights(Counter({r["feature"]: r["i"] for r in rows}), Counter({r["feature"]: r["o"] for r in rows}))


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous part with the largest sum, the first and shortest of such; empty if none is above 0."""
    best = total = 0.0
    start = best_start = best_end = 0
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_start, best_end = total, start, i + 1
    return best_start, best_end


def named_region(found: list[Token]) -> tuple[int, int] | None:
    """Where the page's one content element is, with its tags; None if the page has none, or more than one of a kind."""
    for tag in _LABELS:
        opened = [i for i, (kind, _, node) in enumerate(found) if kind == "open" and node.tag == tag]
        if len(opened) == 1 and not found[opened[0]][2].unwanted:
            end = next(i for i, (kind, _, node) in enumerate(found) if kind == "close" and node is found[opened[0]][2])
            return opened[0], end + 1
    return None


def extended(scores: list[float], start: int, end: int) -> tuple[int, int]:
    """The region with the largest sum of those that hold start to end, the shortest of such."""
    best = total = 0.0
    first, last = start, end
    for i in range(start - 1, -1, -1):
        total += scores[i]
        if total > best:
            best, first = total, i
    best = total = 0.0
    for i in range(end, len(scores)):
        total += scores[i]
        if total > best:
            best, last = total, i + 1
    return first, last


def extract(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    found = tokens(page)
    counts = [_words(value) if kind == "text" else 0 for kind, value, _ in found]
    scores = [0.0 if kind == "text" and not n else weights.score(kind, value, node, n) for (kind, value, node), n in zip(found, counts, strict=True)]
    named = named_region(found)
    best_start, best_end = extended(scores, *named) if named else best_region(scores)
    blocks: list[list[str]] = [[]]
    for kind, value, node in found[best_start:best_end]:
        if kind == "text":
            if node is None or not node.unwanted:
                blocks[-1].append(value)
        elif kind == "gap":
            blocks[-1].append(" " if value == "br" else "")
        elif kind == "break" or node.tag in _BLOCK:
            blocks.append([])
    texts = (" ".join(html.unescape("".join(x)).split()) for x in blocks)
    return "\n\n".join(x for x in texts if x)


def extract_text(pages: DataFrame, weights: Weights, html_column: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each as column `out`."""
    shared = pages.sparkSession.sparkContext.broadcast(weights.known)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        own = Weights(Counter(), Counter())
        own.known = shared.value
        return pa.array([extract(x, own) for x in column.to_pylist()], pa.string())

    return pages.withColumn(out, run.asNondeterministic()(F.col(html_column)))


def op3_html(spark, sf_dir: str) -> DataFrame:
    tk.small_batches(spark)
    pages = tk.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = extract_text(pages, train(pages))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
