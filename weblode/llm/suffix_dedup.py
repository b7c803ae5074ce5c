"""Removal of repeated 200-byte strings by blockwise suffix sorting with a difference cover.

Sorting every suffix of a corpus is not needed to find strings of 200 bytes that occur twice. Each text is cut
into runs of neighbouring 200-byte windows that share their smallest 50-gram (by hash, the rightmost of equals):
equal windows have the same smallest gram at the same place, so the gram is the suffix bucket of all windows
of its runs, and only windows of one bucket can be equal.

1. Grams are counted; runs whose gram occurs once hold nothing repeated. Runs that are equal as a whole are
   settled by their hash, copies of texts among them.
2. What is left of a bucket, one run of each kind, is sorted block by block: suffixes by their first 32 bytes, ties
   by the ranks of a difference-cover sample. For positions i, j there is a shift d < 13 that takes both into the
   sample, so rank(i + d) against rank(j + d) settles any tie; the ranks cover 214 bytes, which is all that is
   needed, and are computed once per block. Neighbours in suffix order that share 200 bytes are repeats. A block
   holds ``BLOCK`` bytes whatever the size of the corpus.
3. A bucket of more than ``HOT`` kinds of runs would not fit a block: its windows are counted by two 64-bit
   hashes instead, which combines before the shuffle.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weblode.llm.common import batches, row_key
from weblode.operators.blocks import written

LENGTH = 200
GRAM = 50
SPAN = LENGTH - GRAM + 1
HOT = 2000
BLOCK = 2 << 20
CHUNK = 2 << 20
"""Bytes of a text that are looked at together; neighbouring chunks overlap by 199 bytes."""
_BITS = np.uint64(23)
_MASK = np.uint64((1 << 23) - 1)

# A perfect difference cover, every difference mod 13 occurs in it.
PERIOD, COVER = 13, (0, 1, 3, 9)
SHIFT = np.array([[next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER)
                   for s in range(PERIOD)] for r in range(PERIOD)])

_rng = np.random.default_rng(977)
_TABLE = _rng.integers(0, 2 ** 64, 256, dtype=np.uint64)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_powers: dict = {}


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        size = max(n, 1 << 20)
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = tuple(both)
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substring of a byte array in constant time."""

    def __init__(self, data: np.ndarray, base: np.uint64 = _BASES[0]):
        up, self.down = _power(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:len(data)], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def strings(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start])


def runs_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple:
    """Runs of the texts data[start:stop]: arrays (text number, first window, windows, lead to the gram, gram hash, hash
    of all bytes of the run). Positions count from the start of ``data``."""
    empty = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < LENGTH:
        return empty
    roll = Rolling(data)
    grams = roll.windows(GRAM)
    keys = (grams & ~_MASK) | (_MASK - np.arange(len(grams), dtype=np.uint64))
    low, reach = keys, 1
    while 2 * reach <= SPAN:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < SPAN:
        low = np.minimum(low[:len(low) - (SPAN - reach)], low[SPAN - reach:])
    owner = (_MASK - (low & _MASK)).astype(np.int64)  # of every window of LENGTH bytes, text borders not yet seen
    text = np.repeat(np.arange(len(starts)), stops - starts)
    inside = text[:len(owner)] == text[LENGTH - 1:LENGTH - 1 + len(owner)]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty
    own, of = owner[at], text[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    begin, gram, of = at[first], own[first], of[first]
    lead = gram - begin
    whole = roll.strings(begin, begin + count + LENGTH - 1) + _mix((lead * 1024 + count).astype(np.uint64))
    return of, begin, count, lead, grams[gram], whole


def _pieces(texts: list) -> list[tuple[int, int, bytes]]:
    """(text number, offset, bytes): texts in chunks."""
    out = []
    for n, text in enumerate(texts):
        data = text.encode() if text else b""
        out += [(n, at, data[at:at + CHUNK + LENGTH - 1]) for at in range(0, max(1, len(data) - LENGTH + 1), CHUNK)]
    return out


def _find_runs(reader):
    for batch in batches(reader, CHUNK):
        keys = batch.column("_key").to_numpy()
        held, size = [], 0
        for piece in [*_pieces(batch.column("text").to_pylist()), None]:
            if held and (piece is None or size + len(piece[2]) > 2 * CHUNK):
                data = np.frombuffer(b"".join(p[2] for p in held), np.uint8)
                stops = np.cumsum([len(p[2]) for p in held])
                starts = np.concatenate([[0], stops[:-1]])
                of, begin, count, lead, gram, whole = runs_of(data, starts, stops)
                number, offset = np.array([p[0] for p in held]), np.array([p[1] for p in held])
                yield pa.record_batch([pa.array(keys[number[of]]), pa.array(begin - starts[of] + offset[of]), pa.array(count.astype(np.int16)),
                                       pa.array(lead.astype(np.int16)), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64))],
                                      names=["_key", "at", "count", "lead", "gram", "whole"])
                held, size = [], 0
            if piece:
                held.append(piece)
                size += len(piece[2])


RUN = "_key bigint, at bigint, count smallint, lead smallint, gram bigint, whole bigint"


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as a number that sorts like them; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i:i + len(data)]
    return out


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows compared column by column."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), np.int64)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(words: np.ndarray, reach: int) -> np.ndarray:
    """Ranks of the sample suffixes by at least their first ``reach`` bytes, 0 at other positions; one entry more per
    position beyond the end. ``words`` as from ``_words_at``."""
    n = len(words)
    sample = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    late = lambda shift: np.where(sample + shift < n, words[np.minimum(sample + shift, n - 1)], 0)
    rank = np.zeros(n + 8 * LENGTH, np.int64)
    rank[sample] = _ranks(*(late(8 * i) for i in range(4))) + 1
    covered, step = 32, 2 * PERIOD
    while covered < reach:
        rank[sample] = _ranks(rank[sample], rank[sample + step]) + 1
        covered, step = covered + step, 2 * step
    return rank


def suffix_order(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The suffixes that begin at ``at`` in the order of their first ``LENGTH`` bytes."""
    words = _words_at(data)
    late = lambda shift: np.where(at + shift < len(words), words[np.minimum(at + shift, len(words) - 1)], 0)
    group = _ranks(*(late(8 * i) for i in range(4)))
    place = np.zeros(len(at), np.int64)
    sizes = np.bincount(group)
    tied = np.flatnonzero(sizes[group] > 1)
    if len(tied):
        rank = cover_ranks(words, LENGTH + PERIOD)
        scale = np.int64(len(rank) + 2)
        residue = at[tied] % PERIOD
        members = [tied[residue == r] for r in range(PERIOD)]
        for r in range(PERIOD):
            if not len(members[r]):
                continue
            mine, floor = members[r], group[members[r]] * scale
            for s in range(PERIOD):
                if len(members[s]):
                    other = np.sort(group[members[s]] * scale + rank[at[members[s]] + SHIFT[r, s]])
                    place[mine] += np.searchsorted(other, floor + rank[at[mine] + SHIFT[r, s]]) - np.searchsorted(other, floor)
    return np.lexsort((place, group))


def repeated(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the positions start a string of ``LENGTH`` bytes that starts at another of them too. Each position
    has that many bytes before the end."""
    out = np.zeros(len(at), bool)
    if len(at) < 2:
        return out
    order = suffix_order(data, at)
    words, a, b = _words_at(data), at[order[:-1]], at[order[1:]]
    same = np.ones(len(a), bool)
    for i in range(0, LENGTH, 8):  # LENGTH is a multiple of 8
        same &= words[a + i] == words[b + i]
    out[order[:-1][same]] = True
    out[order[1:][same]] = True
    return out


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges (first, stop) of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _sort_block(rows: list) -> list:
    """(key, first window, stop) of the repeated windows in runs (key, at, count, bytes)."""
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])[:-1]])
    counts = np.array([r[2] for r in rows])
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    flags = repeated(data, np.repeat(starts, counts) + inside)
    out, begin = [], 0
    for key, at, count, _ in rows:
        out += [(key, at + a, at + b) for a, b in _stretches(flags[begin:begin + count])]
        begin += count
    return out


def _intervals(out: list):
    return pa.record_batch([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["_key", "start", "stop"])


def _sort_buckets(reader):
    """Rows come bucket by bucket; a block is as many whole buckets as fit."""
    held, size, bucket, pending = [], 0, None, []
    for batch in reader:
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "_key", "at", "count", "bytes"))):
            if row[0] != bucket:
                if size + sum(len(p[3]) for p in pending) > BLOCK and held:
                    yield _intervals(_sort_block(held))
                    held, size = [], 0
                held += pending
                size += sum(len(p[3]) for p in pending)
                bucket, pending = row[0], []
            pending.append(row[1:])
    held += pending
    if held:
        yield _intervals(_sort_block(held))


def _cut(reader):
    """The bytes of each wanted run."""
    for batch in batches(reader):
        out = []
        for key, text, runs in zip(*(batch.column(c).to_pylist() for c in ("_key", "text", "runs"))):
            data = text.encode()
            out += [(r["gram"], key, r["at"], r["count"], r["hot"], data[r["at"]:r["at"] + r["count"] + LENGTH - 1], r["lead"]) for r in runs]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.bool_(), pa.binary(), pa.int16())
        yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                              names=["gram", "_key", "at", "count", "hot", "bytes", "lead"])


def _hash_windows(reader):
    """Of runs of hot buckets: two hashes of every window, with its place relative to the gram."""
    for batch in batches(reader):
        columns = [[], [], [], []]
        for key, at, count, data in zip(*(batch.column(c).to_pylist() for c in ("_key", "at", "count", "bytes"))):
            array = np.frombuffer(data, np.uint8)
            for c, values in zip(columns, (np.full(count, key), np.arange(at, at + count), *(
                    Rolling(array, base).windows(LENGTH).view(np.int64) for base in _BASES))):
                c.append(values)
        yield pa.record_batch([pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in columns], names=["_key", "at", "h", "g"])


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_key, start, stop): ranges of window starts whose 200 bytes occur elsewhere, and the texts (_key, text) they
    are in. ``docs``: _key, text."""
    runs = docs.mapInArrow(_find_runs, RUN)
    # Written, so that the join below has an exchange on either side and a hot gram can be split.
    often = written(runs.select("gram").groupBy("gram").agg(F.count("*").alias("_n")).where("_n > 1").select("gram"), "grams")
    shared = written(runs.join(often, "gram", "left_semi"), "runs")
    kinds = written(shared.groupBy("gram", "whole").agg(F.count("*").alias("copies"), F.min(F.struct(
        "_key", "at", "count", "lead")).alias("one")), "run-kinds")
    equal = shared.join(kinds.where("copies > 1").select("gram", "whole"), ["gram", "whole"], "left_semi").select(
        "_key", F.col("at").alias("start"), (F.col("at") + F.col("count")).alias("stop"))
    # Buckets with runs not yet settled that have another kind of run to be like.
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("_kinds"), F.min("copies").alias("_least")).where("_kinds > 1 AND _least = 1")
    wanted = kinds.join(mixed, "gram").select("gram", "one.*", (F.col("_kinds") > HOT).alias("hot"))
    by_text = wanted.groupBy("_key").agg(F.collect_list(F.struct("gram", "at", "count", "lead", "hot")).alias("runs"))
    texts = written(docs.join(shared.select("_key").distinct(), "_key", "left_semi").dropDuplicates(["_key"]), "shared-texts")
    pieces = texts.join(by_text, "_key").mapInArrow(
        _cut, "gram bigint, _key bigint, at bigint, count smallint, hot boolean, bytes binary, lead smallint")
    pieces = written(pieces, "run-bytes")
    sorted_ = (pieces.where("NOT hot").select("gram", "_key", "at", "count", "bytes").repartition("gram")
               .sortWithinPartitions("gram").mapInArrow(_sort_buckets, "_key bigint, start bigint, stop bigint"))
    # Dealt out first: the runs of a hot bucket often come from neighbouring texts.
    windows = written(pieces.where("hot").select("_key", "at", "count", "bytes").repartition("_key", "at").mapInArrow(
        _hash_windows, "_key bigint, at bigint, h bigint, g bigint"), "hot-windows")
    twice = windows.groupBy("h", "g").agg(F.count("*").alias("_n")).where("_n > 1").select("h", "g")
    hot = windows.join(twice, ["h", "g"], "left_semi").select("_key", F.col("at").alias("start"), (F.col("at") + 1).alias("stop"))
    return equal.unionByName(sorted_).unionByName(hot), texts


def _remove(reader):
    for batch in batches(reader):
        keys, removed, spans, digests, rest = [], [], [], [], []
        for key, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("_key", "text", "ranges"))):
            data = text.encode()
            change = np.zeros(len(data) + 1, np.int64)
            start = np.array([r["start"] for r in ranges])
            stop = np.array([r["stop"] for r in ranges]) + LENGTH - 1
            np.add.at(change, start, 1)
            np.add.at(change, stop, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            keys.append(key)
            removed.append(int(gone.sum()))
            spans.append(len(_stretches(gone)))
            digests.append(hashlib.sha256(kept).hexdigest())
            rest.append(kept)
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                               pa.array(digests, pa.string()), pa.array(rest, pa.binary())],
                              names=["_key", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, with_rest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document and, on demand, ``kept``: the remaining bytes
    (a cut may fall inside a character).

    Null texts are empty; texts under 200 bytes lose nothing; rows equal in id and text are copies of each other.
    Null ids are kept. Other columns are ignored.
    """
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_key", row_key())
    ranges, texts = repeats(known.select("_key", "text"))
    by_text = ranges.distinct().groupBy("_key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    cut = texts.join(by_text, "_key").mapInArrow(
        _remove, "_key bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    if not with_rest:
        cut = cut.drop("kept")
    whole = known.select("doc_id", "_key", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("_sha"),
                         *([F.col("text").cast("binary").alias("_all")] if with_rest else []))
    out = whole.join(cut, "_key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
        *([F.coalesce("kept", "_all").alias("kept")] if with_rest else []))
    return out
