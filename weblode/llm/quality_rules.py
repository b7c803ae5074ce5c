"""Quality rules and n-gram perplexity.

The texts are taken apart once, in lots: some megabytes of one language that a task holds at a time, kept as a table of the lot's
words and a number for every running word. Every word of a language is told apart, however rare (by 56 bits of its hash), and so is
every bigram of words. Lots send their distinct bigrams, by hash, to parts of bounded size; a part counts them over all lots and
answers each lot. The words' own numbers are summed and answered in the same way. With the answers a lot scores its documents by a
modified Kneser-Ney model, of which no task and no broadcast ever holds more than a part or a lot. Documents whose mean log
probability leaves the band of their language are rejected: too high is out-of-language noise, too low is tables, repetition,
decorated words.

The count of a bigram is the number of different words that come before it, as in the lower orders of a Kneser-Ney model, over all
documents: so copies and near copies of a text do not make its bigrams likely. Bands are over all distinct texts, and every language
has a model and a band of its own.
"""

import ctypes
import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from weblode.llm.common import WORD, batches, row_key
from weblode.operators.blocks import salt_of, written

ROUND = 64
"""Languages judged at once; more are judged in several rounds, each over its own documents."""
BAND = 7.0
"""Half width of a language's band in median absolute deviations."""
NORMAL_MAD = 0.6745
"""Median absolute deviation of a normal distribution in standard deviations."""
MIN_WORDS = 50
MAX_REPEATED = 50
BIN = 1000
"""Histogram bins per unit of log perplexity."""

_words = re.compile(WORD).findall
_SPACE = "\x20\t\n\v\f\r"
_START, _BEFORE = 1, 0
"""Ids in place of the word before the first one of a text, and of the one before that; ids of words are larger."""
_ID = (1 << 56) - 1
_SHORT = 1 << 16
"""Frequent words that have short ids instead of hashes, in all languages; others are told apart as well, at more bytes."""
_SHIFT = 32
_FLUSH = 200_000
"""Distinct words a task holds while it counts."""
_BATCH = 1 << 20
"""Bytes of a batch that a task takes apart at once."""
_LOT = 8 << 20
"""Bytes of text, of all languages, that a task makes lots of at once."""
_PART = 10 << 20
"""Bytes of text whose bigrams, and whose words, make one part."""
_WAVES = 6
"""Parts of bigrams, parts of words and lots are dealt with in so many turns, and the files of a shuffle go after each: less disk at once."""
_JOB = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
"""Settings of the jobs on lots: shuffle files go with the end of their job, and Arrow batches are small, as rows are large."""


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if window in often:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return len(lines) - len(set(lines))


def _count_words(reader):
    """Arrow function: words and their counts per language, with memory bounded by the flush. Lots count by ids instead."""
    counts: dict = defaultdict(Counter)
    for batch in batches(reader, _BATCH):
        for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                counts[lang].update(_words(text))
        if sum(map(len, counts.values())) > _FLUSH:
            yield from _flush(counts)
            counts = defaultdict(Counter)
    yield from _flush(counts)


def _flush(counts):
    for lang, own in counts.items():
        if own:
            yield pa.record_batch([pa.array([lang] * len(own)), pa.array(list(own)), pa.array(list(own.values()), pa.int64())],
                                  names=["lang", "item", "n"])


def _written(df: DataFrame, name: str) -> DataFrame:
    """``written``, by a job with the settings of ``_JOB``; nothing else reads its shuffle files."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _JOB}
    for k, v in _JOB.items():
        conf.set(k, v)
    try:
        return written(df, name)
    finally:
        for k, v in before.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)


class Plan:
    """How many parts a language has, and the short ids of frequent words: by it what travels is smaller, not less."""

    def __init__(self, parts: dict, frequent: list[int] = ()):
        self.parts = parts
        self.waves = min(_WAVES, max(parts.values(), default=1))
        found = np.array(frequent, np.int64)
        self.codes = np.argsort(found, kind="stable")
        self.ids = found[self.codes]

    def coded(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return ids
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.codes[at] + _START + 1, ids)


def _pack(*arrays) -> bytes:
    """Arrays of numbers from 0 on, as bytes: the planes of as many bytes as the largest number has, compressed."""
    out = [np.array([len(arrays)], "<i8").tobytes()]
    codec = pa.Codec("zstd", compression_level=1)
    for a in arrays:
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        a = np.ascontiguousarray(a, "<u4" if width <= 4 else "<u8")
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize)[:, :width].T)
        squeezed = codec.compress(planes, asbytes=True) if planes.size else b""
        out += [np.array([len(a), width, len(squeezed)], "<i8").tobytes(), squeezed]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    codec, at, out = pa.Codec("zstd"), 8, []
    for _ in range(int(np.frombuffer(blob, "<i8", 1)[0])):
        n, width, size = np.frombuffer(blob, "<i8", 3, at).tolist()
        at += 24
        a = np.zeros((n, 8), np.uint8)
        if n * width:
            a[:, :width] = np.frombuffer(codec.decompress(blob[at:at + size], n * width), np.uint8).reshape(width, n).T
        out.append(a.view("<i8").reshape(n))
        at += size
    return out


def _distinct(a: np.ndarray) -> np.ndarray:
    """The distinct values in order, of an array that is sorted for it; that is faster here than the hash table of ``np.unique``."""
    a.sort()
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def _ids_of(words: pa.Array) -> np.ndarray:
    """Ids of words: 56 bits of a hash, none of them as small as the short ids."""
    found = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) >> np.uint64(8)
    return np.maximum(found.astype(np.int64), 2 * _SHORT)


def _ids_in(row: dict) -> np.ndarray:
    return np.cumsum(_unpack(row["ids"])[0]) & _ID


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in a row, and how many each text has."""
    found = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words, lengths = found.flatten(), pc.list_value_length(found).to_numpy(zero_copy_only=False)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if real.all():
        return words, lengths.astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(lengths)])]
    return words.filter(pa.array(real)), np.diff(ends)


def _measured(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.Array, np.ndarray]:
    """Documents with their base measures, the distinct words, and the place among those of every running word."""
    texts = pc.fill_null(batch.column("text"), "")
    words, lengths = _split(texts)
    known = words.dictionary_encode()
    places = known.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    chars = np.concatenate([[0], np.cumsum(pc.utf8_length(known.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[places])])
    own = [places[e - n:e].tolist() for e, n in zip(ends, lengths)]
    repeat = np.array([repeated_words(w) for w in own], np.int64)
    docs = pa.record_batch(
        [batch.column("doc_id"), batch.column("_key"), batch.column("_text"), pa.array(lengths), pa.array(chars[ends] - chars[ends - lengths]),
         pa.array(pc.count_substring_regex(texts, r"[#*$%&|<>]").cast(pa.int64())),
         pa.array([duplicate_lines(t) for t in texts.to_pylist()], pa.int64()), pa.array(repeat),
         pa.array((lengths < MIN_WORDS) | (100 * repeat > MAX_REPEATED * lengths))],
        names=["doc_id", "_key", "_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    return docs, known.dictionary, places


def _let_go() -> None:
    """Gives freed memory back: workers live on and serve other jobs, beside others of their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def _take_apart(reader):
    """Arrow function: documents as lots, each of one language.

    ``ids`` are those of the lot's words, the most frequent first, each less the one before it; ``places`` those of all running words among them;
    ``docs`` the documents with their base measures, as an Arrow table.
    """
    held, size, seq = defaultdict(list), 0, 0
    first = TaskContext.get().partitionId() << 32

    def lots():
        for lang, parts in held.items():
            words = pa.chunked_array([w for _, w, _ in parts]).combine_chunks().dictionary_encode()
            merged = words.indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum([len(w) for _, w, _ in parts])])
            places = np.concatenate([merged[s + p] for s, (_, _, p) in zip(starts, parts)])
            ids = _ids_of(words.dictionary)
            order = np.lexsort((ids, -np.bincount(places, minlength=len(ids))))
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            table = pa.Table.from_batches([d for d, _, _ in parts]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            yield lang, _pack(np.diff(ids[order], prepend=0) & _ID), _pack(rank[places]), sink.getvalue().to_pybytes()

    def sent():
        nonlocal seq
        for lang, ids, places, docs in lots():
            yield pa.record_batch([pa.array([first + seq]), pa.array([lang]), pa.array([ids], pa.binary()), pa.array([places], pa.binary()),
                                   pa.array([docs], pa.binary())], names=["lot", "lang", "ids", "places", "docs"])
            seq += 1

    for batch in batches(reader, _BATCH):
        for lang in pc.unique(batch.column("_lang")).to_pylist():
            own = batch.filter(pc.equal(batch.column("_lang"), lang))
            held[lang].append(_measured(own))
        size += batch.nbytes
        if size > _LOT:
            yield from sent()
            held, size = defaultdict(list), 0
            _let_go()
    yield from sent()
    held = None
    _let_go()


class Lot:
    """The bigrams of a lot: its words by rising id, START, what comes before START, and the numbers of words in a row."""

    def __init__(self, row: dict, plan: Plan):
        self.docs = pa.ipc.open_stream(row["docs"]).read_all()
        self.lengths = lengths = self.docs["n_words"].to_numpy()
        parts = plan.parts[row["lang"]]
        own, (at,) = plan.coded(_ids_in(row)), _unpack(row["places"])
        order = np.argsort(np.concatenate([own, [_START, _BEFORE]]), kind="stable")
        self.ids = np.concatenate([own, [_START, _BEFORE]])[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        w = rank[at]
        u, self.v = np.empty_like(w), np.empty(len(w), np.int32)
        u[1:], self.v[2:] = w[:-1], w[:-2]
        seconds = (self.starts + 1)[lengths[lengths > 0] > 1]
        u[self.starts], self.v[self.starts], self.v[seconds] = rank[-2], rank[-1], rank[-2]
        at = None
        u <<= 32
        u |= w
        pairs, self.back = np.unique(u, return_inverse=True)
        u = w = None
        self.u, self.w = pairs >> 32, pairs & 0xFFFFFFFF
        # A bigram goes by its rare word, if it has one, so that a part knows few rare words; else by both its words, as either may be hot.
        a, b, rare = self.ids[self.u].astype(np.uint64), self.ids[self.w].astype(np.uint64), np.uint64(2 * _SHORT)
        a[(a < rare) & (b >= rare)] = 0
        b[a >= rare] = 0
        mixed = a * np.uint64(0x9E3779B97F4A7C15) + b
        a = b = None
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.order, self.bounds = _dealt((mixed >> np.uint64(33)).astype(np.int64) % parts, parts)


def _dealt(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings parts together, and where each part ends and the next begins."""
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


def _rows(names: list, rows: list) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "part": pa.int32(), "lot": pa.int64(), "blob": pa.binary(), "kind": pa.string()}
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns)], names=names)


def _frequent(reader):
    """Arrow function: the most frequent words of lots, those with enough to gain by a short id."""
    for batch in reader:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            ids, (places,) = _ids_in(row), _unpack(row["places"])
            n = np.bincount(places, minlength=len(ids))[:_SHORT // 8]
            yield pa.record_batch([pa.array(ids[:len(n)]), pa.array(n)], names=["id", "n"])


def planned(lots: DataFrame, parts: dict) -> Plan:
    """The plan of a job; the words that get short ids are at most ``_SHORT``, cut where a sixteenth of a power of two in count ends."""
    known = _written(lots.select("ids", "places").mapInArrow(_frequent, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
                     .withColumn("grade", F.floor(16 * F.log2("n")).cast("int")), "frequent")
    cut, held = 1 << 30, 0
    for row in known.groupBy("grade").count().orderBy(F.desc("grade")).collect():  # at most 16 * 63
        held += row["count"]
        if held > _SHORT:
            break
        cut = row["grade"]
    frequent = known.where(F.col("grade") >= cut).collect()
    return Plan(parts, [r["id"] for r in sorted(frequent, key=lambda r: (-r["n"], r["id"]))])


def _pairs_of(shared, wave: int, waves: int):
    """Arrow function: the distinct bigrams of lots by part, with the different words that come before each. Parts of one wave.

    A blob has the ids of the words of its bigrams, how many of its bigrams begin with each, the places of the second words, how many
    words come before each bigram, and 32 bits of the ids of those.
    """
    def run(reader):
        for batch in reader:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                lot = Lot(row, shared.value)
                three = lot.back << 32
                three |= lot.v
                three = _distinct(three)
                n = np.bincount(three >> 32, minlength=len(lot.u))
                begins = np.cumsum(n) - n
                v = lot.ids[three & 0xFFFFFFFF] & 0xFFFFFFFF
                out = []
                for part in range(wave, len(lot.bounds) - 1, waves):
                    own = lot.order[lot.bounds[part]:lot.bounds[part + 1]]
                    if len(own):
                        u, w, many = lot.u[own], lot.w[own], n[own]
                        used = np.zeros(len(lot.ids), bool)
                        used[u] = used[w] = True
                        place = np.cumsum(used) - 1
                        every = np.repeat(begins[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                        out.append((row["lang"], part, row["lot"], _pack(
                            np.diff(lot.ids[used], prepend=0), np.bincount(place[u], minlength=place[-1] + 1), place[w], many, v[every])))
                yield _rows(["lang", "part", "lot", "blob"], out)
        lot = three = n = begins = v = own = u = w = many = every = out = None
        _let_go()
    return run


_ANSWERS = "kind string, lang string, part int, lot bigint, blob binary, n1 bigint, n2 bigint, n3 bigint, n4 bigint, total bigint, words bigint"
_NAMES = [c.split()[0] for c in _ANSWERS.split(", ")]


def _counts_of(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)] + [int(c.sum()), int((c > 0).sum())]


def _count_pairs(shared):
    """Arrow function of a part of the bigrams of a language: how many different words come before each, over all lots.

    Answers every lot with the counts of its bigrams, in its order; sends on what is summed by word: the total of the bigrams
    that begin with it, how many of them count 1, 2 and more, and how many different words come before it.
    """
    def run(table):
        lang, part, parts = table["lang"][0].as_py(), table["part"][0].as_py(), shared.value.parts
        table = table.select(["lot", "blob"]).sort_by("lot")
        lots, ids, heads, seconds, many, before = table["lot"].to_pylist(), [], [], [], [], []
        for blob in table["blob"]:
            own, u, w, n, v = _unpack(blob.as_py())
            ids.append(np.cumsum(own))
            heads.append(u)
            seconds.append(w.astype(np.int32))
            many.append(n.astype(np.int32))
            before.append(v.astype(np.uint32))
        table = None
        words = _distinct(np.concatenate(ids))
        sizes, keys = [len(w) for w in seconds], []
        while ids:  # from the first on, each let go
            rank = np.searchsorted(words, ids.pop(0))
            keys.append(np.repeat(rank, heads.pop(0)) << 32 | rank[seconds.pop(0)])
        keys = np.concatenate(keys)
        pairs, back = np.unique(keys, return_inverse=True)
        keys = None
        three = np.repeat(back, np.concatenate(many))
        three <<= 32
        three |= np.concatenate(before)
        many = before = None
        three = _distinct(three)
        three >>= 32
        c = np.bincount(three, minlength=len(pairs))
        three = None
        u, w = pairs >> 32, pairs & 0xFFFFFFFF
        out, at = [], 0
        none = [0] * 6
        for lot, size in zip(lots, sizes):
            out.append(("pairs", lang, part, lot, _pack(c[back[at:at + size]]), *none))
            at += size

        def by(ids, some=None):
            return np.bincount(ids if some is None else ids[some], minlength=len(words))

        sums = [np.bincount(u, c, len(words)).astype(np.int64), by(u, c == 1), by(u, c == 2), by(u, c > 2), by(w)]
        order, bounds = _dealt(words % parts[lang], parts[lang])
        for part, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if a < b:
                own = order[a:b]
                out.append(("words", lang, part, None, _pack(np.diff(words[own], prepend=0), *[x[own] for x in sums]), *none))
        out.append(("counts", lang, None, None, None, *_counts_of(c)))
        pairs = back = u = w = c = sums = None
        _let_go()
        return pa.Table.from_batches([_rows(_NAMES, out)])
    return run


def _words_of(shared, wave: int, waves: int):
    """Arrow function: the words of lots, and START, by part. Parts of one wave."""
    def run(reader):
        for batch in reader:
            for row in batch.to_pylist():
                parts = shared.value.parts[row["lang"]]
                ids = np.sort(np.concatenate([shared.value.coded(_ids_in(row)), [_START]]))
                order, bounds = _dealt(ids % parts, parts)
                yield _rows(["kind", "lang", "part", "lot", "blob"], [
                    ("asked", row["lang"], part, row["lot"], _pack(np.diff(ids[order[a:b]], prepend=0)))
                    for part, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if a < b and part % waves == wave])
    return run


def _count_parts(table: pa.Table) -> pa.Table:
    """Arrow function of a part of the words of a language: their numbers over all parts of the bigrams, for every lot that has them."""
    rows = [(r["kind"], r["lot"], _unpack(r["blob"])) for r in table.select(["kind", "lot", "blob"]).to_pylist()]
    lang, part = table["lang"][0].as_py(), table["part"][0].as_py()
    ids = [np.cumsum(blob[0]) for _, _, blob in rows]
    words = _distinct(np.concatenate(ids))
    sums = np.zeros((5, len(words)), np.int64)
    for own, (kind, _, blob) in zip(ids, rows):
        if kind == "words":
            sums[:, np.searchsorted(words, own)] += np.array(blob[1:])
    out = [("words", lang, part, lot, _pack(*sums[:, np.searchsorted(words, own)]), *[0] * 6)
           for own, (kind, lot, _) in zip(ids, rows) if kind == "asked"]
    out.append(("counts", lang, None, None, None, *_counts_of(sums[4])))
    return pa.Table.from_batches([_rows(_NAMES, out)])


def vocabularies(lots: DataFrame, counted: DataFrame, shared) -> DataFrame:
    """The numbers of all words of each language, as answers to the lots that have them."""
    waves, out = shared.value.waves, []
    for i in range(waves):
        asked = lots.select("lot", "lang", "ids").mapInArrow(_words_of(shared, i, waves), "kind string, lang string, part int, lot bigint, blob binary")
        known = counted.where((F.col("kind") == "words") & (F.col("part") % waves == i)).select("kind", "lang", "part", "lot", "blob")
        out.append(_written(asked.unionByName(known).groupBy("lang", "part").applyInArrow(_count_parts, _ANSWERS), "vocabularies"))
    return reduce(DataFrame.unionByName, out)


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts per language from how many counts are 1, 2, 3 and 4, columns ``n1`` to ``n4``."""
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))

    def cut(i):
        raw = F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0))
        return F.least(F.greatest(raw, F.lit(0.05)), F.lit(float(i) - 0.05)).alias(f"d{i}")

    own = [F.sum(f"n{i}").cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    return counts.groupBy("lang").agg(*own, F.sum("total").alias("all"), F.sum("words").alias("words")).select(
        "lang", cut(1), cut(2), cut(3), "all", "words", "n1", "n2")


def _tally(counted: DataFrame) -> DataFrame:
    """Per language how many counts of column ``c`` are 1, 2, 3 and 4, their sum and number."""
    n = [F.sum((F.col("c") == i).cast("int")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    return counted.groupBy("lang").agg(*n, F.sum("c").alias("total"), F.count("*").alias("words"))


def _mass(d1, d2, d3, n1, n2, n3, total):
    """Share of a total that discounts take: of n1 counts of 1, n2 of 2, n3 of more. Columns or arrays."""
    return (n1 * d1 + n2 * d2 + n3 * d3) / total


def _single(c, d, total, left, size):
    """Probability of a word before which ``c`` different words come. Columns or arrays."""
    return (c - d) / total + left / size


def _joint(c, d, total, gamma, p):
    """Probability of a word after another. Columns or arrays."""
    return (c - d) / total + gamma * p


def _discount() -> F.Column:
    return F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))


def kneser_ney(bigrams: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From bigram counts (lang, u, w, c): log p(w | u) of the bigrams, p(w), and the back-off mass of u.

    ``size`` words share what the discounts leave; those that follow any other by default. The model as tables of numbered
    words: lots are scored by the same formulas.
    """
    high = bigrams.join(_discounts(_tally(bigrams)), "lang").withColumn("_d", _discount())
    many = [F.sum(x.cast("int")) for x in (F.col("c") == 1, F.col("c") == 2, F.col("c") > 2)]
    context = high.groupBy("lang", "u").agg(F.sum("c").alias("total"), _mass(
        F.first("d1"), F.first("d2"), F.first("d3"), *many, F.sum("c")).alias("gamma"))
    adjusted = bigrams.groupBy("lang", "w").agg(F.count("*").alias("c"))
    low = adjusted.join(_discounts(_tally(adjusted)), "lang").withColumn("_d", _discount())
    left = _mass(F.col("d1"), F.col("d2"), F.col("d3"), F.col("n1"), F.col("n2"), F.col("words") - F.col("n1") - F.col("n2"), F.col("all"))
    single = low.select("lang", "w", _single(F.col("c"), F.col("_d"), F.col("all"), left, F.col("words") if size is None else F.lit(size)).alias("p"))
    pair = (
        high.join(context, ["lang", "u"]).join(single, ["lang", "w"])
        .select("lang", (F.col("u").cast("bigint") * (1 << _SHIFT) + F.col("w")).alias("key"),
                F.log(_joint(F.col("c"), F.col("_d"), F.col("total"), F.col("gamma"), F.col("p"))).alias("logp"))
    )
    return pair, single, context.drop("total")


class Model:
    """One language: discounts of bigrams and of words, and what all words share. The counts come with the lots."""

    def __init__(self, high, low):
        self.high = np.array([0.0, high["d1"], high["d2"], high["d3"]])
        self.low = np.array([0.0, low["d1"], low["d2"], low["d3"]])
        self.all, self.words = low["all"], low["words"]
        self.left = _mass(*self.low[1:], low["n1"], low["n2"], self.words - low["n1"] - low["n2"], self.all)

    def log_perplexity(self, lot: Lot, c, total, n1, n2, n3, before) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability per word and the standard error of that mean; NaN for a text without words.

        ``c`` has the counts of the lot's bigrams; the other arrays are by the lot's words.
        """
        lengths, starts = lot.lengths, lot.starts
        out, error = np.full(len(lengths), np.nan), np.full(len(lengths), np.nan)
        if not len(starts):
            return out, error
        p = _single(before, self.low[np.minimum(before, 3)], self.all, self.left, self.words)
        gamma = _mass(*self.high[1:], n1, n2, n3, np.maximum(total, 1))
        logp = np.log(_joint(c, self.high[np.minimum(c, 3)], total[lot.u], gamma[lot.u], p[lot.w]))[lot.back]
        n = lengths[lengths > 0]
        mean = np.add.reduceat(logp, starts) / n
        out[lengths > 0] = -mean
        logp -= np.repeat(mean, n)
        error[lengths > 0] = np.sqrt(np.add.reduceat(logp ** 2, starts)) / n
        return out, error


def train(lots: DataFrame, shared) -> tuple[dict[str, Model], DataFrame, DataFrame]:
    """Models by language, from all words and bigrams of all lots, and the counts of each lot's bigrams and words."""
    waves = shared.value.waves
    counted = reduce(DataFrame.unionByName, [
        _written(lots.mapInArrow(_pairs_of(shared, i, waves), "lang string, part int, lot bigint, blob binary")
                 .groupBy("lang", "part").applyInArrow(_count_pairs(shared), _ANSWERS), "bigrams") for i in range(waves)])
    known = vocabularies(lots, counted, shared)
    high, low = [{r["lang"]: r for r in _discounts(x.where("kind = 'counts'")).collect()} for x in (counted, known)]
    return {lang: Model(high[lang], low[lang]) for lang in high}, counted.where("kind = 'pairs'"), known.where("kind = 'words'")


def _score(models: dict, shared):
    """Arrow function of a lot and the answers to it: its documents with their base measures and scores."""
    def run(table):
        rows = table.to_pylist()
        row = next(r for r in rows if r["kind"] == "lot")
        lang, parts = row["lang"], shared.value.parts
        lot = Lot(row, shared.value)
        docs = lot.docs
        answers = {k: [_unpack(r["blob"]) for r in sorted((r for r in rows if r["kind"] == k), key=lambda r: r["part"])] for k in ("pairs", "words")}
        score, error = np.full(len(docs), np.nan), np.full(len(docs), np.nan)
        if len(lot.u):
            c = np.empty(len(lot.u), np.int64)
            c[lot.order] = np.concatenate([a[0] for a in answers["pairs"]])
            asked = lot.ids[1:]  # all but what comes before START
            known = np.zeros((5, len(lot.ids)), np.int64)
            known[:, 1 + _dealt(asked % parts[lang], parts[lang])[0]] = np.concatenate(answers["words"], axis=1)
            score, error = models[lang].log_perplexity(lot, c, *known)
        lot = answers = c = known = None
        _let_go()
        return (docs.append_column("_lang", pa.array([lang] * len(docs), pa.string()))
                .append_column("log_perplexity", pa.array(score, from_pandas=True)).append_column("_error", pa.array(error, from_pandas=True))
                .select(_SCORED))
    return run


_SCORED = ["doc_id", "_key", "_lang", "_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "log_perplexity", "_error"]


def bands(scored: DataFrame, width: float = BAND) -> list[tuple[str, float, float]]:
    """Per language the lowest and highest accepted log perplexity: the median of its texts that pass the base
    rules, less and plus ``width`` median absolute deviations.

    A text counts once, however many rows hold it. The deviation is at least what the median standard error of a
    score gives by itself: texts that are nearly alike, or very few, do not narrow the band below it. All come
    from histograms of all texts.
    """
    texts = (
        scored.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
        .groupBy("_lang", "_text").agg(F.min("log_perplexity").alias("score"), F.min("_error").alias("error"))
    )
    hist = (
        texts.select("_lang", F.explode(F.create_map(F.lit("score"), "score", F.lit("error"), "error")).alias("kind", "x"))
        .groupBy("_lang", "kind", F.round(F.col("x") * BIN).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    )

    def middle(values, weights):
        order = np.argsort(values, kind="stable")
        values, total = values[order], np.cumsum(weights[order])
        half = total[-1] / 2
        return (values[np.searchsorted(total, half)] + values[np.searchsorted(total, half, side="right")]) / 2

    out = []
    bins = defaultdict(lambda: {"score": [], "error": []})
    for row in hist.collect():
        bins[row["_lang"]][row["kind"]].append((row["bin"], row["n"]))
    for lang, own in bins.items():
        (at, n), (errors, m) = [(np.array([b / BIN for b, _ in own[k]]), np.array([c for _, c in own[k]])) for k in ("score", "error")]
        centre = middle(at, n)
        spread = max(middle(np.abs(at - centre), n), NORMAL_MAD * middle(errors, m), 1 / BIN)
        out.append((lang, float(centre - width * spread), float(centre + width * spread)))
    return out


def languages(docs: DataFrame) -> dict[str, int]:
    """All languages and the bytes of their texts, those with the most documents first, ties by name; a null language counts as the empty one."""
    counted = docs.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    return {r["lang"]: r["size"] or 0 for r in counted.orderBy(F.desc("n"), "lang").collect()}


def judge(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, log_perplexity, lower, upper.

    Null and empty texts have no words, so they fail the base rules. A null language is a language of its
    own. Repeated rows are judged alike. A language of which no document passes the base rules has no band.
    Other columns are ignored.
    """
    own = languages(docs)
    known = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("_lang"), row_key().alias("_key"), F.xxhash64("text").alias("_text"))
    parts = {lang: 1 + size // _PART for lang, size in own.items()}
    if len(own) <= ROUND:
        return _judged(known, parts)
    rounds = [list(own)[i:i + ROUND] for i in range(0, len(own), ROUND)]
    return reduce(DataFrame.unionByName, [_judged(known.where(F.col("_lang").isin(some)), {x: parts[x] for x in some}) for some in rounds])


def _judged(known: DataFrame, parts: dict) -> DataFrame:
    """Verdicts on the documents of at most ``ROUND`` languages."""
    kind = known.schema["doc_id"].dataType.simpleString()
    lots = _written(known.mapInArrow(_take_apart, "lot bigint, lang string, ids binary, places binary, docs binary"), "lots")
    shared = known.sparkSession.sparkContext.broadcast(planned(lots, parts))
    models, pairs, words = train(lots, shared)
    answered = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        lots.withColumn("kind", F.lit("lot")), *[x.select("kind", "lot", "part", "blob") for x in (pairs, words)]])
    waves = shared.value.waves
    scored = reduce(DataFrame.unionByName, [_written(answered.where(salt_of("lot", salts=waves) == i).groupBy("lot").applyInArrow(
        _score(models, shared), f"doc_id {kind}, _key bigint, _lang string, _text bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
        "n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, log_perplexity double, _error double"), "scored") for i in range(waves)])
    shared.unpersist()
    limits = F.lit(None).cast("struct<lower:double,upper:double>")
    for name, low, high in bands(scored):  # at most ROUND
        limits = F.when(F.col("_lang") == name, F.struct(F.lit(low).alias("lower"), F.lit(high).alias("upper"))).otherwise(limits)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("_band.lower"), F.col("_band.upper")), F.lit(False))
    return (
        scored.withColumn("_band", limits).withColumn("kept", ~F.col("base_failed") & inside)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                "log_perplexity", "_band.lower", "_band.upper", "_key")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they are."""
    verdict = judge(docs).where("kept").select("_key").distinct()
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"),
                         row_key().alias("_key"))
    return packed.join(verdict, "_key", "left_semi").select("_row.*")
