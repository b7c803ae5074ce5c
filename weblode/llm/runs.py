"""Periodic runs of words: scale-tiled search, fragments stitched per document and period.

A run is a stretch of words with smallest period q, at least max(6, 4q) long, that no neighbouring word extends with
period q. Periods are searched by octave, q in [m, 2m) with m = 2^k. In every octave a document is cut into overlapping
tiles; tiles are solved on their own:

* boundaries lie m words apart. A run of length 4q holds a boundary from which at least 2q words agree with those q
  further on. Hashes of 2m words, doubled from octave to octave, find those (boundary, q): q reaches one step of
  boundaries at most, so each place is compared with one boundary only;
* two such periods at one boundary are both multiples of a smaller one (Fine and Wilf), so neither is smallest; of a single
  one its divisors tell;
* for what is left, forward and backward Z values at the boundary (how far words agree with those q further on) give
  the fragment of the run inside the tile, on the words themselves.

Fragments are shuffled by (document, period) and stitched where they overlap by a period. Only documents that hold a fragment send their words along.
"""

import functools
import hashlib
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from weblode.llm.common import batches
from weblode.operators.blocks import written

TILE = 8192
"""Least words of a tile, without its overlap; a tile has at least 16 steps of boundaries."""
LEAST = 6
TIMES = 4
BATCH_BYTES = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = hashlib.sha256(b"").hexdigest()

FOUND = ("doc bigint, doc_id bigint, n bigint, all_sha256 string, words binary, "
         "fragments array<struct<start:bigint,stop:bigint,period:bigint>>")
RESULT = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string")


def repeated(doc_id, words: list) -> list:
    """The words with the planted repeat of the contract: by h = crc32(doc_id), a tenth of the documents repeat a stretch."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def as_they_are(doc_id, words: list) -> list:
    return words


def _doubled(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of 2m words from hashes of m words; the last ones, which would reach past the end, are left out."""
    x = h[:-m] * _MIX + (h[m:] ^ (h[m:] >> np.uint64(31)))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _boundaries(h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundary, period) of stretches of 3q words with period q in [m, 2m); ``h`` hashes the 2m words from each place."""
    steps = len(h) // m
    if steps < 2:
        return (np.empty(0, np.int64),) * 2
    rows = h[:steps * m].reshape(steps, m)
    place = np.flatnonzero(rows[1:] == rows[:-1, :1]) + m
    if rest := len(h) - steps * m:
        place = np.concatenate([place, steps * m + np.flatnonzero(h[steps * m:] == h[(steps - 1) * m])]) if rest else place
    b = (place // m - 1) * m
    q = place - b
    second = b + 2 * q - 2 * m
    ok = second + q < len(h)
    b, q, second = b[ok], q[ok], second[ok]
    ok = h[second] == h[second + q]
    b, q = b[ok], q[ok]
    single = np.ones(len(b), bool)
    same = b[1:] == b[:-1]  # places ascend, so periods of one boundary are neighbours
    single[1:] &= ~same
    single[:-1] &= ~same
    return b[single], q[single]


def _primes(q: int) -> list:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + [q] * (q > 1)


def _smallest(w: np.ndarray, start: int, q: int) -> bool:
    """Whether a stretch of at least 2q words with period q from ``start`` has no smaller one, which would divide q."""
    return not any(np.array_equal(w[start:start + q - q // r], w[start + q // r:start + q]) for r in _primes(q))


def _tile_fragments(w: np.ndarray, b: np.ndarray, q: int, low: int, high: int) -> set:
    """Fragments with smallest period q inside a tile: around each boundary as far as words agree with those q further on."""
    differ = np.flatnonzero(w[low:high - q] != w[low + q:high]) + low
    at = np.searchsorted(differ, b)  # first difference at or after the boundary: forward Z value; the one before: backward
    stop = np.where(at < len(differ), np.append(differ, 0)[at], high - q)
    start = np.where(at > 0, np.append(differ, 0)[at - 1] + 1, low)
    good = stop > b
    return {(s, e) for s, e in set(zip(start[good].tolist(), (stop[good] + q).tolist())) if _smallest(w, s, q)}


def fragments(w: np.ndarray, longest: int) -> dict:
    """{(start, stop, period)} in an array of word numbers; numbers of borders are all different, so no run crosses one."""
    out = set()
    h = (w.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(32)
    m = 1
    while TIMES * m <= longest and len(h) > m:
        h = _doubled(h, m)
        b, q = _boundaries(h, m)
        if len(b):
            tile = max(TILE, 16 * m)
            number = b // tile
            order = np.lexsort((b, q, number))
            b, q, number = b[order], q[order], number[order]
            cut = np.flatnonzero((np.diff(number) != 0) | (np.diff(q) != 0)) + 1
            for first, last in zip([0, *cut.tolist()], [*cut.tolist(), len(b)]):
                t, period = int(number[first]), int(q[first])
                low, high = max(0, t * tile - 8 * m), min(len(w), (t + 1) * tile + 8 * m)
                out.update((s, e, period) for s, e in _tile_fragments(w, b[first:last], period, low, high))
        m *= 2
    return out


def _search(plant):
    """Map over (doc_id, text): words, and the fragments of their runs tile by tile."""
    def run(reader):
        task = TaskContext.get()
        rows = count((task.partitionId() if task else 0) << 33)
        for batch in batches(reader, BATCH_BYTES):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            number = defaultdict(count().__next__)
            docs, parts, starts, at, border = [], [], [], 0, -1
            for doc_id, text in zip(ids, texts):
                words = plant(doc_id, text.encode().split()) if text else []  # bytes split at the six ASCII blanks
                docs.append(words)
                starts.append(at)
                parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                parts.append(np.array([border]))
                at, border = at + len(words) + 1, border - 1
            found = [[] for _ in docs]
            numbers = np.concatenate(parts)
            for s, e, q in fragments(numbers, max(map(len, docs))):
                i = int(np.searchsorted(starts, s, "right")) - 1
                found[i].append({"start": s - starts[i], "stop": e - starts[i], "period": q})
            joined = [b" ".join(words) for words in docs]
            yield pa.RecordBatch.from_arrays([
                pa.array([next(rows) for _ in docs], pa.int64()), pa.array(ids, pa.int64()), pa.array(map(len, docs), pa.int64()),
                pa.array([None if f else hashlib.sha256(j).hexdigest() for j, f in zip(joined, found)], pa.string()),
                pa.array([j if f else None for j, f in zip(joined, found)], pa.binary()),
                pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("period", pa.int64())])))],
                ["doc", "doc_id", "n", "all_sha256", "words", "fragments"])

    return run


def stitched(found: DataFrame) -> DataFrame:
    """(doc, start, stop, period): maximal runs from fragments (doc, start, stop, period).

    Fragments of one run in neighbouring tiles overlap by more than a period, while two runs of one period overlap
    by less; so fragments of a (document, period) join where they overlap by a period.
    """
    by = Window.partitionBy("doc", "period").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.distinct().withColumn("_new", F.when(F.col("start") + F.col("period") <= reach, 0).otherwise(1)).withColumn(
        "_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("doc", "period", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start")
    return whole.where((length >= LEAST) & (length >= TIMES * F.col("period"))).select("doc", "start", "stop", "period")


def _order(one, other) -> int:
    """Greatest length / period first, compared without rounding, then smallest start, then period."""
    left, right = (one[1] - one[0]) * other[2], (other[1] - other[0]) * one[2]
    return (left < right) - (left > right) or (one[0] > other[0]) - (one[0] < other[0]) or one[2] - other[2]


def _digests(reader):
    """Map over (doc_id, n, words, runs): the figures and digests of a document with fragments."""
    for batch in batches(reader, BATCH_BYTES):
        out = []
        for row in batch.to_pylist():
            runs = sorted((r["start"], r["stop"], r["period"]) for r in row["runs"] or ())
            keep = np.ones(row["n"], bool)
            for s, e, q in runs:
                keep[s + q:e] = False
            words = row["words"].split(b" ")
            kept = hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])).hexdigest()
            lines = hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()).hexdigest()
            s, e, q = min(runs, key=functools.cmp_to_key(_order)) if runs else (None,) * 3
            figures = (s, e - s, q, 1000 * (e - s) // q) if runs else (None,) * 4
            out.append((row["doc_id"], len(runs), *figures, lines, kept))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if i < 6 else pa.string()) for i, c in enumerate(zip(*out))],
            ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def search(docs: DataFrame, plant=as_they_are) -> DataFrame:
    """One row per row of ``docs``: its words, their digest or (where there are any) fragments of runs; written once."""
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(given.mapInArrow(_search(plant), FOUND), "fragments")


def runs(found: DataFrame) -> DataFrame:
    """(doc, start, stop, period) of all runs of what ``search`` returned; words number from 0, ``stop`` is exclusive."""
    return stitched(found.select("doc", F.inline("fragments")))


def collapse(docs: DataFrame, plant=as_they_are) -> DataFrame:
    """Per row of ``docs``: how many runs it holds, the one of greatest exponent, and digests of the runs and of the words
    left when each run keeps its first period only.

    ``plant`` (doc_id, words) -> words may change the words first. A null or empty text has no words; a document without runs
    has four nulls and its words whole. Repeated rows are judged each by itself; null ids stay; other columns are ignored.
    A text is held whole in one task (about 60 bytes a word); its tiles are solved one after the other.
    """
    found = search(docs, plant)
    per_doc = runs(found).groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "period")).alias("runs"))
    held = found.where(F.col("words").isNotNull()).select("doc", "doc_id", "n", "words")
    some = held.join(per_doc, "doc", "left").select("doc_id", "n", "words", "runs").mapInArrow(_digests, RESULT)
    null = F.lit(None).cast("bigint")
    none = found.where(F.col("words").isNull()).select(
        "doc_id", F.lit(0).cast("bigint").alias("n_runs"), null.alias("start"), null.alias("length"), null.alias("period"),
        null.alias("exponent_milli"), F.lit(_EMPTY).alias("runs_sha256"), F.col("all_sha256").alias("collapsed_sha256"))
    return some.unionByName(none)
