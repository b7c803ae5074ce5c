"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is read into a tree of block elements. Each node gets features: its tag group, tokens of class, id and
role, text and link density of its subtree, depth, sibling statistics. A boosted-tree model scores every node as
content or not. Decoding is hierarchical: along every path from the root the labels are "open" (a container of
mixed parts), then "content", then "dropped", so nothing is content below something dropped, and the labelling
with the highest total log-likelihood is found bottom-up.

The model is fitted by Spark on the nodes of at most ``TRAIN_PAGES`` pages with semantic mark-up, which gives
the labels; half of these pages are shown with their semantic tags and names hidden, so that the trees also learn
from density and position. Pages are then scored where they are read, with no shuffle.
"""

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weblode.llm.common import batches
from weblode.operators.blocks import scratch_path, written

TRAIN_PAGES = 400
"""Pages the model is fitted on, those with the smallest hashes of their ids."""
TREES, DEPTH = 12, 4
HASHED = 8
"""Buckets for attribute tokens without a known meaning."""

# HTML element names by role.
BLOCKS = frozenset(
    "html body address article aside blockquote caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea title select option button svg math iframe object canvas video audio head"
SKIPPED = frozenset(RAW.split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary", "figcaption"}
GROUPS = {g: i for i, names in enumerate((
    "p", "h1 h2 h3 h4 h5 h6", "li dd dt", "ul ol dl menu", "div section center", "article main", "nav", "header", "footer", "aside",
    "form fieldset dialog", "table tbody thead tfoot tr td th", "pre blockquote figure", "body html")) for g in names.split()}
# Words that name parts of a page in class, id and role.
GOOD = frozenset("article main content post entry story body text".split())
BAD = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login masthead "
    "menu modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related replies reply search share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
BAD_TAGS = frozenset("nav header footer aside form dialog".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|$)", re.S | re.I)
"""Mark-up. Possessive and open to the end of the page, so no start is tried twice: a tag ends at its ``>``, values in
quotes apart; one that never ends takes the rest of the page, as in browsers."""
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "tokens", "depth", "children", "chars", "links", "own", "index")

    def __init__(self, tag, parent, tokens):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.chars = self.links = self.own = 0
        self.index = len(parent.children) if parent else 0
        if parent:
            parent.children.append(self)


def parse(source: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block nodes in page order and the text runs as (node, text); a new run starts at every block border.

    Unclosed elements end with their parent, a block ends an open paragraph, stray end tags do nothing.
    Scripts, styles, titles, form fields and comments hold no text.
    """
    root = Node("html", None, ())
    nodes, runs = [root], []
    node, skip, in_link, position = root, [], 0, 0
    pending: list[str] = []

    def flush():
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if text:
                runs.append((node, text))

    def said(text):
        if text and not skip:
            pending.append(text)
            size = len(text.strip())
            node.chars += size
            node.own += size
            if in_link:
                node.links += size

    for match in _TOKEN.finditer(source):
        said(source[position:match.start()])
        position = match.end()
        name = match.group(3)
        if not name:
            continue
        name, closing = name.lower(), match.group(2) == "/"
        if name in SKIPPED:
            if closing:
                if name in skip:
                    del skip[skip.index(name):]
            elif not match.group(0).endswith("/>"):
                skip.append(name)
            continue
        if skip and name == "body":
            skip.clear()
        if skip:
            continue
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            said(" ")
        elif name in BLOCKS:
            flush()
            in_link = 0
            if closing:
                up = node
                while up and up.tag != name:
                    up = up.parent
                if up and up is not root:
                    node = up.parent
            elif name == "html":
                pass
            elif name == "hr":
                pass
            else:
                if name in CLOSES_P:
                    up = node
                    while up and up.tag not in ("p", "div", "article", "section", "body", "li", "td"):
                        up = up.parent
                    if up and up.tag == "p":
                        node = up.parent
                if name in ("li", "td", "tr", "dd", "dt") and node.tag == name:
                    node = node.parent
                tokens = ()
                attributes = match.group(4)
                if attributes:
                    found = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes)).lower()
                    tokens = tuple(t for t in _SPLIT.split(found) if t)
                node = Node(name, node, tokens)
                nodes.append(node)
    said(source[position:])
    flush()
    for own in reversed(nodes):
        if own.parent:
            own.parent.chars += own.chars
            own.parent.links += own.links
    return nodes, runs


def _bucket(token: str) -> int:
    value = 0
    for c in token:
        value = (value * 31 + ord(c)) % 1_000_003
    return value % HASHED


N_FEATURES = len(set(GROUPS.values())) + 3 + HASHED + 15


def features(nodes: list[Node], hidden: bool = False) -> np.ndarray:
    """One row per node. ``hidden`` shows semantic tags as div and known names not at all."""
    groups = len(set(GROUPS.values()))
    out = np.zeros((len(nodes), N_FEATURES))
    total = max(nodes[0].chars, 1)
    inherited: dict[int, tuple[int, int]] = {}
    place = {id(n): i for i, n in enumerate(nodes)}
    for i, node in enumerate(nodes):
        row = out[i]
        tag, tokens = node.tag, node.tokens
        if hidden:
            tag = "div" if tag in BAD_TAGS or tag in ("article", "main") else tag
            tokens = ()
        good = sum(t in GOOD for t in tokens) + (tag in ("article", "main"))
        bad = sum(t in BAD for t in tokens) + (tag in BAD_TAGS)
        above = inherited[place[id(node.parent)]] if node.parent else (0, 0)
        inherited[i] = (above[0] + good, above[1] + bad)
        row[GROUPS.get(tag, groups)] = 1
        row[groups + 1], row[groups + 2] = inherited[i]
        for token in tokens:
            if token not in GOOD and token not in BAD:
                row[groups + 3 + _bucket(token)] = 1
        at = groups + 3 + HASHED
        chars, siblings = node.chars, node.parent.children if node.parent else [node]
        around = max(1, len(siblings))
        row[at:at + 15] = (
            math.log1p(chars), math.log1p(node.own), node.links / max(chars, 1), chars / total, node.depth, len(node.children),
            node.index, len(siblings) - node.index - 1, len(siblings), chars / max(1, node.parent.chars if node.parent else chars),
            sum(s.chars for s in siblings[max(0, node.index - 4):node.index + 5]) / max(1, len(siblings[max(0, node.index - 4):node.index + 5])),
            sum(s.tag == node.tag for s in siblings[max(0, node.index - 4):node.index + 5]) / min(around, 9),
            siblings[node.index - 1].links / max(1, siblings[node.index - 1].chars) if node.index else -1,
            i / len(nodes), node.parent.links / max(1, node.parent.chars) if node.parent else 0)
    return out


def labels(nodes: list[Node]) -> list[int | None]:
    """What semantic mark-up says: 1 inside article or main and no boilerplate part, 0 in any other place of a page
    that has an article or main, None on pages without."""
    if not any(n.tag in ("article", "main") for n in nodes):
        return [None] * len(nodes)
    state: dict[int, tuple[bool, bool]] = {}
    out = []
    for node in nodes:
        inside, bad = state[id(node.parent)] if node.parent else (False, False)
        inside = inside or node.tag in ("article", "main") or "main" in node.tokens
        bad = bad or node.tag in BAD_TAGS or not BAD.isdisjoint(node.tokens)
        state[id(node)] = inside, bad
        out.append(int(inside and not bad))
    return out


class Trees:
    """Boosted trees as arrays, for scoring in bulk."""

    def __init__(self, feature, threshold, left, right, value, roots, weights):
        self.feature, self.threshold, self.left, self.right = feature, threshold, left, right
        self.value, self.roots, self.weights = value, roots, weights

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        if not self.roots:  # nothing to learn from: long text with few links is content
            at = N_FEATURES - 15
            return np.where((rows[:, at] > math.log1p(80)) & (rows[:, at + 2] < 0.3) & (rows[:, at + 5] == 0), 2.0, -2.0)
        every = np.arange(len(rows))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(rows), root)
            for _ in range(DEPTH + 1):
                inner = self.left[at] >= 0
                go_left = rows[every, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
            out += weight * self.value[at]
        return 2 * out


def _train_rows(reader):
    for batch in batches(reader):
        rows, wanted = [], []
        for number, source in enumerate(batch.column("html").to_pylist()):
            nodes, _ = parse(source or "")
            marks = labels(nodes)
            if marks[0] is None:
                continue
            for hidden in (False, True):
                rows += features(nodes, hidden).tolist()
                wanted += [float(m) for m in marks]
        yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), pa.array(wanted, pa.float64())], names=["values", "label"])


def fit(pages: DataFrame, most: int = TRAIN_PAGES) -> Trees:
    """Boosted trees from the pages whose ids have the smallest hashes, at most ``most`` of them."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    spark = pages.sparkSession
    chosen = pages.select("page_id").where("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    rows = pages.join(F.broadcast(chosen), "page_id", "left_semi").select("html").mapInArrow(_train_rows, "values array<double>, label double")
    rows = written(rows, "dom-nodes")
    if rows.select("label").distinct().count() < 2:
        return Trees(None, None, None, None, None, [], [])
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, labelCol="label", featuresCol="features").fit(
        rows.select(array_to_vector("values").alias("features"), "label").coalesce(4))
    path = scratch_path(spark, "trees")
    model.write().save(path)
    found = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # TREES * 2^(DEPTH+1) at most
    start, roots = {}, []
    for i, row in enumerate(found):
        start.setdefault(row["treeID"], i)
    for tree in sorted(start):
        roots.append(start[tree])
    down = lambda row, side: start[row["treeID"]] + row[side] if row[side] >= 0 else -1
    split = [row["split"] for row in found]
    return Trees(
        np.array([s["featureIndex"] if s else -1 for s in split]),
        np.array([s["leftCategoriesOrThreshold"][0] if s and s["leftCategoriesOrThreshold"] else 0.0 for s in split]),
        np.array([down(r, "leftChild") for r in found]), np.array([down(r, "rightChild") for r in found]),
        np.array([r["prediction"] for r in found]), roots, [float(w) for w in model.treeWeights])


def decode(nodes: list[Node], odds: np.ndarray) -> set[int]:
    """ids of the nodes that are content, under the order open, content, dropped along every path."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    place = {id(n): i for i, n in enumerate(nodes)}
    best = np.zeros((len(nodes), 3))  # open, content, dropped
    for i in range(len(nodes) - 1, -1, -1):
        best[i, 0] += no[i]
        best[i, 1] += yes[i]
        best[i, 2] += no[i]
        if nodes[i].parent:
            up = best[place[id(nodes[i].parent)]]
            up[0] += best[i].max()
            up[1] += best[i, 1:].max()
            up[2] += best[i, 2]
    state = np.zeros(len(nodes), int)
    out = set()
    for i, node in enumerate(nodes):
        above = state[place[id(node.parent)]] if node.parent else 0
        options = best[i, above:]
        # Among equals the later state wins: what could stay open or go is dropped.
        state[i] = above + len(options) - 1 - int(np.argmax(options[::-1]))
        if state[i] == 1:
            out.add(id(node))
    return out


def _extract(shared):
    def run(reader):
        trees = shared.value
        for batch in batches(reader, 2 << 20):
            parsed = [parse(source or "") for source in batch.column("html").to_pylist()]
            odds = trees.log_odds(np.concatenate([features(nodes) for nodes, _ in parsed]))
            texts, at = [], 0
            for nodes, runs in parsed:
                kept = decode(nodes, odds[at:at + len(nodes)])
                at += len(nodes)
                texts.append("\n".join(text for node, text in runs if id(node) in kept))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page. Null or empty html gives an empty text; ids and urls may be null;
    repeated rows are pages of their own. Other columns are ignored."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or fit(pages))  # a few hundred tree nodes
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extract(shared), f"page_id {kind}, url string, text string, n_chars bigint")
