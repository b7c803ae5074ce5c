"""Near-duplicate detection by chosen-path set similarity join.

Each document becomes its set of word shingles and a vector of minwise hashes of it. Trees branch the
documents by these hashes: a node picks one or two coordinates by a hash of its own path, and a document goes
down to one child per picked coordinate, named by its minwise value there. Two sets with similarity J agree
on a coordinate with probability J, so near copies meet in small nodes while others part. Nodes of at most
``NODE`` documents are compared exhaustively; larger ones branch on. ``TREES`` independent trees bring the
chance to miss a link at J = 0.75 to 4e-8 where nodes are small at once, 1e-5 after two levels and 1e-4 after three.

Copies with equal sets are one class from the start. Links are confirmed on full shingle sets, in two steps
that keep the number of confirmations linear:

1. every document against the first document (in a fixed random order) of those it shares a node with and
   resembles by its minwise vector; the links found make first components;
2. in each node, the pairs whose components still differ and whose vectors allow a similarity of 0.75, most
   alike first; a link merges two components there and then, so that a group of n near copies needs few more
   than n confirmations, and only merging links leave the node.

A node that stays larger than ``NODE`` to the last level holds texts alike enough that step 1 has nearly
always joined them; what still differs there is compared block against block, so nothing is dropped.
"""

import re
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from weblode.llm.common import WORD, batches
from weblode.operators.blocks import written

SHINGLE = 5
NUM, DEN = 75, 100
COORDINATES = 64
"""Minwise hashes of 32 bits, by which nodes branch."""
CHECKS = 128
"""More of them, 8 bits each, for estimates only."""
TREES = 10
HEAD_TREES = 4
"""Trees whose nodes give step 1 its pairs."""
LEVELS = 6
NODE = 2048
"""Documents in a node that is compared exhaustively."""
LOOSE = 117
"""Hashes of all 192 that must agree before a pair is confirmed on full sets. At J = 0.75 fewer agree with
probability 1e-5 (see ``miss``)."""

_words = re.compile(WORD.encode()).findall
_rng = np.random.default_rng(20240229)
HASHES = COORDINATES + CHECKS
_MULT = (_rng.integers(1, 2 ** 63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2 ** 63, HASHES, dtype=np.uint64)
WIDTH = 4 * COORDINATES + CHECKS


def miss(similarity: float = NUM / DEN, loose: int = LOOSE) -> float:
    """Chance that fewer than ``loose`` of the coordinates agree for two sets of this similarity."""
    return sum(comb(HASHES, i) * similarity ** i * (1 - similarity) ** (HASHES - i) for i in range(loose))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lowered_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8; lower() of bytes changes A-Z alone."""
    return _words(text.encode().lower()) if text else []


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` word hashes."""
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - width + 1 + i])
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    return _mix(np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = _lowered_words(text)
    return np.unique(_windows(_hashes(words), min(width, len(words)))) if words else np.empty(0, np.uint64)


def shingles_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of many texts at once: all hashes in a row, and where each text's begin (one entry more)."""
    words = [_lowered_words(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    h = _hashes([w for own in words for w in own])
    owner = np.repeat(np.arange(len(texts)), lengths)
    if len(h) >= SHINGLE:
        values, whole = _windows(h, SHINGLE), owner[:len(h) - SHINGLE + 1] == owner[SHINGLE - 1:]
        values, of = values[whole], owner[:len(h) - SHINGLE + 1][whole]
    else:
        values, of = np.empty(0, np.uint64), np.empty(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    if len(short):
        values = np.concatenate([values, *[_windows(h[starts[i]:starts[i + 1]], int(lengths[i])) for i in short]])
        of = np.concatenate([of, short])
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[new], of[new]
    return values, np.searchsorted(of, np.arange(len(texts) + 1))


def minwise(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minwise hashes of the sets that begin at ``starts`` (none empty): ``COORDINATES`` of 32 bits, then ``CHECKS``
    of 8 bits, as rows of bytes."""
    best = np.stack([np.minimum.reduceat(values * m + a, starts) for m, a in zip(_MULT, _ADD)], axis=1)
    best = _mix(best) >> np.uint64(32)
    return np.concatenate([best[:, :COORDINATES].astype("<u4").view(np.uint8).reshape(len(best), -1),
                           (best[:, COORDINATES:] & np.uint64(255)).astype(np.uint8)], axis=1)


def _describe(reader):
    for batch in batches(reader, 1 << 20):
        values, bounds = shingles_of(batch.column("text").to_pylist())
        counts = np.diff(bounds)
        full = np.flatnonzero(counts)
        digests: list = [None] * len(counts)
        vectors: list = [None] * len(counts)
        if len(full):
            starts = bounds[:-1][full]
            low = np.bitwise_xor.reduceat(_mix(values), starts)
            high = np.add.reduceat(_mix(values ^ np.uint64(0xD6E8FEB86659FD93)), starts)
            for i, x, y, v in zip(full, low, high, minwise(values, starts)):
                digests[i] = x.tobytes() + y.tobytes()
                vectors[i] = v.tobytes()
        yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                               pa.array(vectors, pa.binary())], names=["doc_id", "n_shingles", "digest", "vector"])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, number of shingles, 128-bit digest of the set, minwise vector (both null for an empty set)."""
    return docs.select("doc_id", "text").mapInArrow(
        _describe, "doc_id bigint, n_shingles bigint, digest binary, vector binary")


def _coordinate(index: Column) -> Column:
    """Four bytes of the vector at a coordinate."""
    return F.substring(F.col("vector"), index * 4 + 1, F.lit(4))


def _children(rows: DataFrame) -> DataFrame:
    """Rows (rep, vector, tree, node) to one row (rep, tree, node) per child node.

    A node of hash h takes coordinate h mod 64 and, with a chance of one in three, a second: 4/3 = 1/0.75
    children on average, so a pair at the threshold meets in about one child of each node it shares.
    """
    draw = F.xxhash64(F.col("node"), F.lit(17))
    first = F.pmod(draw, F.lit(COORDINATES))
    second = F.pmod(first + 1 + F.pmod(F.shiftrightunsigned(draw, 8), F.lit(COORDINATES - 1)), F.lit(COORDINATES))
    picked = F.when(F.pmod(F.shiftrightunsigned(draw, 24), F.lit(3)) == 0, F.array(first, second)).otherwise(F.array(first))
    return (
        rows.select("rep", "vector", "tree", "node", F.explode(picked).alias("_at"))
        .select("rep", "tree", F.xxhash64("node", "_at", _coordinate(F.col("_at").cast("int"))).alias("node"))
    )


def memberships(classes: DataFrame) -> DataFrame:
    """(node, large, last, tree, rep): documents of every node that is compared, nodes of one document left out.

    ``large`` marks nodes still over ``NODE`` documents: inner nodes that also branch on (level below the
    last), or leaves of the last level.
    """
    rows = classes.select("rep", "vector", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("rep", "vector", "tree", F.xxhash64(F.lit("tree"), "tree").alias("node"))
    found = []
    for level in range(1, LEVELS + 1):
        # Inner levels are written narrow: the vectors of the few large nodes come back by a join.
        children = written(_children(rows), "paths")
        sizes = children.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > 1)
        kept = children.join(sizes, "node")
        found.append(kept.select("node", (F.col("size") > NODE).alias("large"), F.lit(level == LEVELS).alias("last"), "tree", "rep"))
        if level == LEVELS:
            break
        large = written(kept.where(F.col("size") > NODE).select("node", "tree", "rep"), "large")
        if large.isEmpty():
            break
        rows = large.join(classes.select("rep", "vector"), "rep")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return written(out, "nodes")


def _agreeing(a: tuple, b: tuple) -> np.ndarray:
    """Hashes on which rows of two (32-bit, 8-bit) pairs of matrices agree."""
    return (a[0] == b[0]).sum(axis=1) + (a[1] == b[1]).sum(axis=1)


def _fits(n_a, n_b) -> np.ndarray:
    """Sizes that allow the similarity: the smaller over the larger set."""
    return DEN * np.minimum(n_a, n_b) >= NUM * np.maximum(n_a, n_b)


def _matrices(vectors: list) -> tuple:
    every = np.frombuffer(b"".join(vectors), np.uint8).reshape(-1, WIDTH)
    return np.ascontiguousarray(every[:, :4 * COORDINATES]).view(np.uint32), every[:, 4 * COORDINATES:]


def _alike(reader):
    """Keeps rows whose two vectors and sizes allow a link: (a, b)."""
    for batch in reader:
        if batch.num_rows:
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            ok = _fits(n_a, n_b) & (_agreeing(*(_matrices(batch.column(c).to_pylist()) for c in ("v_a", "v_b"))) >= LOOSE)
            yield pa.record_batch([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])


def filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be links, by sizes and minwise vectors."""
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("vector").alias(f"v_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_alike, "a bigint, b bigint")


def _confirm(reader):
    """Rows of a group follow each other, its head (head = true) first; emits confirmed links (a, b)."""
    group, head_set, head = None, None, None
    for batch in batches(reader):
        out_a, out_b = [], []
        for key, doc, is_head, text in zip(*(batch.column(c).to_pylist() for c in ("_group", "doc", "head", "text"))):
            found = shingles(text)
            if is_head:
                group, head_set, head = key, found, doc
            elif key == group:
                common = len(np.intersect1d(head_set, found, assume_unique=True))
                if DEN * common >= NUM * (len(head_set) + len(found) - common):
                    out_a.append(head)
                    out_b.append(doc)
        yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame, chunk: int = 256) -> DataFrame:
    """The pairs (a, b) that are links on full sets.

    Pairs with the same ``a`` travel in groups of about ``chunk``; ``a`` itself goes once to each group, so a
    hub with very many partners is spread over many tasks and no pair carries two texts.
    """
    count = pairs.groupBy("a").agg(F.count("*").alias("_n"))
    parts = F.floor(F.col("_n") / chunk).cast("bigint") + 1
    tails = pairs.join(count, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), parts)).alias("_group"),
                                          F.col("b").alias("doc"), F.lit(False).alias("head"))
    heads = count.select(F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("_part"), "a").select(
        F.xxhash64("a", "_part").alias("_group"), F.col("a").alias("doc"), F.lit(True).alias("head"))
    rows = heads.unionByName(tails).join(texts, "doc")
    return (
        rows.select("_group", "doc", "head", "text").repartition("_group")
        .sortWithinPartitions("_group", F.desc("head")).mapInArrow(_confirm, "a bigint, b bigint")
    )


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(doc, component): smallest doc reachable over edges (a, b), for every doc on an edge.

    Alternates large-star and small-star steps, which need about log(length of a chain) rounds and never
    gather a component in a task; each round is written to the shared folder.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def lowest(e):
        return both(e).groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))

    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        large = (both(current).join(lowest(current), "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct())
        large = written(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
                 .unionByName(low.select("a", F.col("_m").alias("b"))).where("a <> b").distinct())
        current = written(small, "small-star")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("doc"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("doc"), F.col("b").alias("component")).distinct())


def _order(column: str) -> Column:
    """A fixed random order of documents."""
    return F.struct(F.xxhash64(column, F.lit(7)), F.col(column))


def first_links(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Step 1: for each document one pair with the first document among those it may be linked with as
    head of one of its nodes."""
    nodes = nodes.where(F.col("tree") < HEAD_TREES)
    heads = nodes.groupBy("node").agg(F.min(_order("rep")).getField("rep").alias("a"))
    pairs = nodes.select("node", "rep").join(heads, "node").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    return filtered(pairs, classes).groupBy("b").agg(F.min(_order("a")).getField("a").alias("a")).select("a", "b")


def _groups(reader, columns):
    """Rows that follow each other with the same node, as (node, list of the other columns)."""
    node, held = None, []
    for batch in reader:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if row[0] != node:
                if held:
                    yield node, held
                node, held = row[0], []
            held.append(row[1:])
    if held:
        yield node, held


def _candidates(comps, sizes, vectors) -> tuple:
    """(i, j, agreement) of pairs of different components that may be links."""
    one, two, alike = [], [], []
    for i in range(len(comps) - 1):
        at = np.flatnonzero((comps[i + 1:] != comps[i]) & _fits(sizes[i + 1:], sizes[i])) + i + 1
        if len(at):
            agree = _agreeing((vectors[0][at], vectors[1][at]), (vectors[0][i], vectors[1][i]))
            ok = agree >= LOOSE
            one.append(np.full(ok.sum(), i))
            two.append(at[ok])
            alike.append(agree[ok])
    return tuple(np.concatenate(x) if x else np.empty(0, int) for x in (one, two, alike))


_MEMBER = ["node", "rep", "component", "n_shingles", "vector"]


def _flag(reader):
    """The rows of a node that may have a link to another component."""
    for node, rows in _groups(reader, _MEMBER):
        reps, comps, sizes = (np.array([r[i] for r in rows]) for i in range(3))
        if len(rows) < 2 or (comps == comps[0]).all():
            continue
        one, two, _ = _candidates(comps, sizes, _matrices([r[3] for r in rows]))
        at = np.union1d(one, two).astype(int)
        if len(at):
            yield pa.record_batch([pa.array([node] * len(at), pa.int64()), pa.array(reps[at]), pa.array(comps[at]), pa.array(sizes[at]),
                                   pa.array([rows[i][3] for i in at], pa.binary())], names=_MEMBER)


def _link(reader):
    """Links that merge components inside a node, confirmed on full sets, most alike first."""
    for _, rows in _groups(reader, [*_MEMBER, "found"]):
        reps, comps, sizes = (np.array([r[i] for r in rows]) for i in range(3))
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        one, two, alike = _candidates(comps, sizes, _matrices([r[3] for r in rows]))
        comps, out = comps.copy(), []
        for k in np.argsort(-alike, kind="stable"):
            i, j = one[k], two[k]
            if comps[i] != comps[j]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if DEN * common >= NUM * (sizes[i] + sizes[j] - common):
                    out.append((reps[i], reps[j]))
                    comps[comps == comps[j]] = comps[i]
        if out:
            yield pa.record_batch([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])


def _sets(reader):
    for batch in batches(reader):
        yield pa.record_batch([batch.column("doc"), pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())],
                              names=["rep", "found"])


def _by_node(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node")


def open_links(nodes: DataFrame, classes: DataFrame, joined: DataFrame, texts: DataFrame) -> DataFrame:
    """Step 2: links (a, b) between components that meet in a node."""
    placed = nodes.join(joined.withColumnRenamed("doc", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("node").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi")
    known = classes.select("rep", "n_shingles", "vector")
    left = written(placed.join(mixed.select("node"), "node", "left_semi").join(known, "rep"), "mixed")
    # Leaves of the last level that are still large: every two blocks of about NODE / 2 documents meet.
    stuck = left.where("large AND last")
    size = stuck.groupBy("node").agg(F.ceil(F.count("*") / (NODE / 2)).cast("bigint").alias("_blocks"))
    cut = stuck.join(size, "node").withColumn("_own", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("_blocks")))
    meets = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_other")
    blocks = cut.select("*", meets).withColumn("node", F.xxhash64("node", F.least("_own", "_other"), F.greatest("_own", "_other")))
    rows = left.where("NOT large").select(_MEMBER).unionByName(blocks.select(_MEMBER))
    kind = "node bigint, rep bigint, component bigint, n_shingles bigint, vector binary"
    flagged = written(_by_node(rows).mapInArrow(_flag, kind), "flagged")
    wanted = flagged.select(F.col("rep").alias("doc")).distinct()
    found = written(texts.join(wanted, "doc", "left_semi").dropDuplicates(["doc"]).mapInArrow(_sets, "rep bigint, found binary"), "found")
    return _by_node(flagged.join(found, "rep")).mapInArrow(_link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies (documents with the same set), kept.

    Words are runs without ASCII white space, A-Z lower-cased, of the whole text. Links need
    100 * intersection >= 75 * union of the shingle sets; components follow links. Texts without words are
    linked with nothing and kept. Documents are told apart by ``doc_id``; rows that repeat an id share one
    component and one verdict. Rows with a null id take no part: no component, kept. Other columns are ignored.
    """
    known = written(describe(docs), "sets")
    full = known.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(full.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("vector").alias("vector"),
        F.count("*").alias("copies")), "classes")
    nodes = memberships(classes)
    first = written(first_links(nodes, classes), "first")
    firsts = first.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    links = written(confirmed(first, texts.join(firsts, "doc", "left_semi").dropDuplicates(["doc"])), "links")
    joined = components(links)
    more = written(open_links(nodes, classes, joined, texts), "more-links")
    final = components(links.unionByName(more))
    by_class = classes.join(final.withColumnRenamed("doc", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id"), "copies")
    return (
        known.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        .join(by_class, "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                F.coalesce(F.col("copies"), F.lit(1)).alias("n_copies"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are first of their component, with their columns as they are."""
    dropped = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_id")).distinct()
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"))
    return packed.join(dropped, "_id", "left_anti").select("_row.*")
