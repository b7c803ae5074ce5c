"""Quality and toxicity scores by co-training.

Two classifiers look at different views of a document: its words, and its metadata (language, source, size,
layout). Both start from the labelled documents. In each round either one scores all unlabelled documents and labels
those it is most sure of, of each class as many as the labels have it, for the other one to learn from. The views are
calibrated on labelled documents kept aside (Platt scaling), which also tells how sure they are, and in the end combined
there by a logistic model of their two log-odds. All documents are scored where they are read.

Both classifiers are ridge least squares on features that are there or not, so what they learn are sums over lessons:
how many of each class hold a word, and the products of the features kept. Every task adds these up for its own rows and
Spark sums them; histograms of all scores tell which lessons are the surest. A lesson is a document with its metadata;
copies of it teach once. Words are hashed to ``BUCKETS`` features. The one sample is that of ``LABELLED`` documents kept
aside for the calibration, a parameter.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from weblode.llm.common import batches
from weblode.operators.blocks import written

LABELLED = 6000
"""Labelled lessons the views are calibrated on, those with the smallest hashes among the quarter kept aside."""
BUCKETS = 1 << 20
"""Word features."""
MIN_DOCS = 3
"""Lessons a word must occur in to count."""
SELECTED = 256
"""Words a classifier keeps: those whose share differs most between the classes."""
CLEAR = 4.0
"""Least difference in standard errors."""
ROUNDS = 2
SHARE = 0.1
"""Part of all unlabelled lessons either view labels in a round."""
TAUGHT = 0.5
"""Weight of a lesson labelled by the other view."""
SURE = 0.95
"""Least calibrated probability of a label that a view teaches."""
RIDGE = 10.0
BIN, SPAN = 1000, 4
"""Histogram bins per unit of score; scores beyond the span are in the last bin."""
PART = 4096
"""Sums of products that travel as one row; word features of a range, whose counts do."""
TARGETS = ("quality", "toxic")
TEXT, META = 0, 1

_LANGS, _SOURCES, _STEPS = 16, 64, 24
_SIZES = 8
_META_FEATURES = _LANGS + _SOURCES + _SIZES * _STEPS + 2
_MARKS = ".,;:!?\"'()[]#*$%&|<>"
_UPPERS = BUCKETS >> 16


def tail(word: str) -> str:
    """Characters at the end of a word that are neither letters nor digits nor underscores."""
    end = len(word)
    while end and not (word[end - 1].isalnum() or word[end - 1] == "_"):
        end -= 1
    return word[end:]


def _strings(column: pa.Array) -> list[str]:
    """As ``to_pylist``, without a scalar of each value on the way."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _hashed(tokens: list[str]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)) % BUCKETS).astype(np.int64)


def buckets(tokens: pa.Array) -> np.ndarray:
    """Feature of each token; every distinct token is hashed once."""
    coded = tokens.dictionary_encode()
    return _hashed(_strings(coded.dictionary))[coded.indices.to_numpy()]


def _are(chars: pa.Array, kind) -> np.ndarray:
    """Whether the characters are of a kind."""
    coded = chars.dictionary_encode()
    return np.array([kind(c) for c in _strings(coded.dictionary)], bool)[coded.indices.to_numpy()]


def _each_once(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order."""
    pairs = np.sort(row.astype(np.int64) << 32 | code)
    pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
    return (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)


def _of_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each word: itself in lower case without marks around it, stems of 5 and 7 letters, the marks at its end,
    -1 for those it has not; whether it is in upper case, and whether it ends in several marks."""
    n = len(words)
    trimmed = pc.utf8_trim(words, characters=_MARKS).dictionary_encode()
    lower = [w.lower() for w in _strings(trimmed.dictionary)]
    plain = pa.array(lower, pa.string())
    size = pc.utf8_length(plain).to_numpy()
    of_plain = [_hashed(lower)]
    for k in (5, 7):
        at = np.flatnonzero(size > k)
        of_plain.append(np.full(len(size), -1))
        of_plain[-1][at] = buckets(pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(plain.take(pa.array(at)), 0, k), ""))

    at = np.flatnonzero(~_are(pc.utf8_slice_codeunits(words, -1, 1 << 30), str.isalnum))  # the others have nothing at their end
    ends = [tail(w) for w in _strings(words.take(pa.array(at)))]
    marked = np.zeros(n, bool)
    marked[at] = [len(end) > 1 for end in ends]
    of_end = np.full(n, -1)
    of_end[at] = np.where([end != "" for end in ends], buckets(pa.array(["~end " + end for end in ends], pa.string())), -1)

    at = np.flatnonzero(~_are(pc.utf8_slice_codeunits(words, 0, 1), str.islower))  # the others are not in upper case
    upper = np.zeros(n, bool)
    upper[at] = [w.isupper() and len(w) > 1 for w in _strings(words.take(pa.array(at)))]
    return np.stack([*[x[trimmed.indices.to_numpy()] for x in of_plain], of_end], axis=1), upper, marked


def word_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the word view of texts: what their words have, and bucketed shares of shapes; each once, in order.

    A word of several texts is taken apart once."""
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)  # at the white space that WORD leaves out
    row, flat = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy())), split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # at the ends of a text there may be empty ones
    row, coded = row[full.to_numpy(zero_copy_only=False)], flat.filter(full).dictionary_encode()
    words = np.bincount(row, minlength=n)
    row, code = _each_once(row, coded.indices.to_numpy())
    distinct = np.bincount(row, minlength=n)
    features, *flags = _of_words(coded.dictionary)
    shares = [10 * distinct // np.maximum(1, words)]
    shares += [10 * np.bincount(row[flag[code]], minlength=n) // np.maximum(1, distinct) for flag in flags]
    of_shares = [buckets(pa.array([f"~{name} {k}" for k in range(11)]))[share] for name, share in zip(("distinct", "upper", "marked"), shares)]
    own = features[code].ravel()
    at = np.flatnonzero(own >= 0)
    return _each_once(np.concatenate([row[at // features.shape[1]], *[np.arange(n)] * 3]), np.concatenate([own[at], *of_shares]))


def word_features(text: str) -> list[int]:
    """Buckets of the word view of a text, each once, in order."""
    return word_view(pa.array([text], pa.string()))[1].tolist()


def _slot(name: str | None, size: int) -> int:
    value = 7
    for c in (name or "").encode():
        value = (value * 131 + c) % 1_000_003
    return value % size


def meta_features(lang, source, n_chars, text: str) -> list[int]:
    """Metadata view: language, source, then one step of each of eight measures of size and layout, then two flags."""
    size = len(text)
    lines = text.count("\n") + 1
    stated = size if n_chars is None else max(n_chars, 0)
    measures = (
        2 * np.log1p(stated), 2 * np.log1p(lines), 2 * np.log1p(size / lines), 2 * np.log1p(text.count(" ") / lines),
        400 * text.count("|") / max(1, size), 200 * sum(text.count(c) for c in "#*$%&<>") / max(1, size),
        4 * np.log1p(abs(stated - size)), 100 * text.count(" ") / max(1, size))
    start = _LANGS + _SOURCES
    out = [_slot(lang, _LANGS), _LANGS + _slot(source, _SOURCES)]
    out += [start + k * _STEPS + min(_STEPS - 1, int(x)) for k, x in enumerate(measures)]
    flags = start + _SIZES * _STEPS
    return out + [flags] * (lang is None) + [flags + 1] * (source is None)


class Logistic:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> Logistic:
    """Ridge logistic regression by damped Newton steps. ``weight`` counts rows; the bias is not penalised."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum()

    now = loss(w)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        size = 1.0
        while (after := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        if now - after < 1e-6 * max(1.0, abs(now)):
            break
        w, now = w - size * step, after
    return Logistic(w[:-1], float(w[-1]))


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that a * score + b is calibrated log-odds, with Platt's smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    fitted = newton(scores[:, None], goal, np.ones(len(y)), 1e-2)
    return float(fitted.weights[0]), fitted.bias


class View:
    """Ridge least squares of +1 and -1 on features that are there or not: score = bias + weights of the features there."""

    def __init__(self, features: np.ndarray, products: np.ndarray):
        # products: of the features, a constant 1 and the goal, in this order, summed over weighted lessons
        n = len(features)
        penalty = np.diag([RIDGE] * n + [1e-3])
        solved = np.linalg.solve(products[:n + 1, :n + 1] + penalty, products[:n + 1, n + 1])
        self.features, self.weights, self.bias = features, solved[:n], float(solved[n])

    def table(self, size: int) -> np.ndarray:
        out = np.zeros(size)
        out[self.features] = self.weights
        return out


class Scorer:
    """The views of every target as look-up tables of the features that any of them weighs; lives in a task."""

    def __init__(self, views: dict[str, tuple[View, View]]):
        self.views, self.places = views, []
        for view, size in ((TEXT, BUCKETS), (META, _META_FEATURES)):
            used = np.unique(np.concatenate([np.zeros(0, np.int64), *[pair[view].features for pair in views.values()]]))
            place = np.zeros(size, np.min_scalar_type(len(used)))  # from 1; 0: no weight
            place[used] = np.arange(1, len(used) + 1)
            self.places.append((place, {t: np.append(0, pair[view].table(size)[used]) for t, pair in views.items()}))

    def __call__(self, pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> dict[str, list[np.ndarray]]:
        """Scores of ``n`` rows with these (row, feature) pairs of both views, by target and view."""
        out = {t: [] for t in self.views}
        for view, (row, feature) in enumerate(pairs if out else []):
            place, weights = self.places[view]
            found = place[feature]
            at = np.flatnonzero(found)
            found, row = found[at], row[at]
            for target, scores in out.items():
                scores.append(np.bincount(row, weights[target][found], minlength=n) + self.views[target][view].bias)
        return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of a column of lists or of packed features."""
    if pa.types.is_list(column.type):
        lengths = np.diff(column.offsets.to_numpy())
        return np.repeat(np.arange(len(column), dtype=np.int32), lengths), column.flatten().to_numpy().astype(np.int32)
    return unpack_rows(column)


def lessons(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_lesson, words, meta, quality, toxic) of each distinct (text, lang, source, n_chars); marks are 0, 1 or null.

    Of several labels of a lesson the lowest quality and the highest toxicity count; labels meet ids only, and
    features are shuffled once, two bytes each, after copies were merged where they were read. Null ids have no labels.
    """
    return packed_lessons(docs, labels).mapInArrow(_unpacked, "_lesson binary, words array<int>, meta array<int>, quality int, toxic int")


def packed_lessons(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The lessons with their word features packed, as training and scores read them: a lesson is one value then,
    not some hundreds, on its way from and to Python."""
    known = _with_lesson(docs)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    marked = (
        known.where("doc_id IS NOT NULL").select("doc_id", "_lesson").join(marks, "doc_id").groupBy("_lesson")
        .agg((F.min("q") > 0).cast("int").alias("quality"), (F.max("t") > 0).cast("int").alias("toxic"))
    )
    held = known.select("_lesson", "text", "lang", "source", "n_chars").mapInArrow(
        _lesson_rows, "_lesson binary, words binary, meta array<int>")
    once = held.groupBy("_lesson").agg(F.first("words").alias("words"), F.first("meta").alias("meta"))
    return once.join(marked, "_lesson", "left")


def _with_lesson(docs: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.concat(F.length(c.cast("string")), F.lit("="), c.cast("string")), F.lit("-")) for c in
             (F.col(name) for name in ("lang", "source", "n_chars", "text"))]
    return docs.select("doc_id", "text", *_meta(docs)).withColumn("_lesson", F.unhex(F.md5(F.concat(*parts))))


def _meta(docs: DataFrame) -> list:
    kinds = {"lang": "string", "source": "string", "n_chars": "bigint"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]


def _features(batch: pa.RecordBatch) -> tuple[tuple[np.ndarray, np.ndarray], pa.Array]:
    """(row, feature) of the word view, and a column of the metadata view."""
    texts = batch.column("text").fill_null("")
    own = zip(*[batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")], texts.to_pylist())
    return word_view(texts), pa.array([meta_features(*x) for x in own], pa.list_(pa.int32()))


def _lesson_rows(reader):
    for batch in batches(reader, 4 << 20):
        seen, keep = set(), []
        for i, key in enumerate(batch.column("_lesson").to_pylist()):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        batch = batch.take(pa.array(keep))
        words, meta = _features(batch)
        yield pa.record_batch([batch.column("_lesson").cast(pa.binary()), pack_rows(*words, batch.num_rows), meta], names=["_lesson", "words", "meta"])


def _heads(starts: np.ndarray) -> np.ndarray:
    """Places of the 16-bit halves that begin packed rows."""
    return starts[:, None] + np.arange(2 * _UPPERS)


def pack_rows(row: np.ndarray, feature: np.ndarray, n: int) -> pa.Array:
    """Ascending word features of rows in little space: how many have each upper half, then their lower halves of 16 bits."""
    upper = np.bincount(row.astype(np.int64) * _UPPERS + (feature >> 16), minlength=n * _UPPERS).reshape(n, _UPPERS)
    ends = np.cumsum([0, *upper.sum(axis=1) + 2 * _UPPERS])
    halves, lower = np.zeros(ends[-1], "<u2"), np.ones(ends[-1], bool)
    lower[_heads(ends[:-1])] = False
    halves[lower] = feature & 0xFFFF
    halves[_heads(ends[:-1])] = upper.astype("<i4").view("<u2")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(halves)])


def unpack_rows(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of packed rows."""
    n = len(packed)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + n + 1]
    halves = np.frombuffer(packed.buffers()[2], "<u2", (offsets[-1] - offsets[0]) // 2, offsets[0])
    heads, lower = _heads((offsets[:-1] - offsets[0]) // 2), np.ones(len(halves), bool)
    lower[heads] = False
    upper = halves[heads].view("<i4")
    high = np.repeat(np.tile(np.arange(_UPPERS, dtype=np.int32) << 16, n), upper.ravel())
    return np.repeat(np.arange(n, dtype=np.int32), upper.sum(axis=1)), high | halves[lower]


def pack(features: np.ndarray) -> bytes:
    """One packed row."""
    return pack_rows(np.zeros(len(features), np.int32), features, 1)[0].as_py()


def unpack(packed: bytes) -> np.ndarray:
    return unpack_rows(pa.array([packed], pa.binary()))[1]


def _unpacked(reader):
    for batch in batches(reader, 2 << 20):
        row, feature = unpack_rows(batch.column("words"))
        ends = np.cumsum([0, *np.bincount(row, minlength=batch.num_rows)])
        yield pa.record_batch([batch.column("_lesson"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32())),
                               *map(batch.column, ("meta", "quality", "toxic"))], names=["_lesson", "words", "meta", "quality", "toxic"])


def _kept_aside(batch: pa.RecordBatch) -> np.ndarray:
    """A quarter of the lessons, by their hash."""
    return np.array([key[0] % 4 == 0 for key in batch.column("_lesson").to_pylist()], bool)


def _marks(batch: pa.RecordBatch, target: str) -> np.ndarray:
    """1, 0 or -1 where there is none."""
    return batch.column(target).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _scores(reader, views, only=None):
    """Batches, of ``only`` these rows, with the (row, feature) pairs of both views and their scores of every target there
    are views of."""
    scorer = Scorer(views)
    for batch in batches(reader, 4 << 20):
        batch = batch.filter(pa.array(only(batch))) if only else batch
        pairs = [_flat(batch.column("words")), _flat(batch.column("meta"))]
        yield batch, pairs, scorer(pairs, batch.num_rows)


def _histogram(shared):
    """Arrow function: unlabelled lessons of a task by target, view and bin of the score."""
    def run(reader):
        counts = {}
        for batch, _, scores in _scores(reader, shared.value):
            for target, own in scores.items():
                free = _marks(batch, target) < 0
                for view in (TEXT, META):
                    bins = np.clip(np.floor(own[view][free] * BIN), -SPAN * BIN, SPAN * BIN).astype(np.int64) + SPAN * BIN
                    at = (target, view)
                    counts[at] = counts.get(at, 0) + np.bincount(bins, minlength=2 * SPAN * BIN + 1)
        for (target, view), n in counts.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([target] * len(at)), pa.array([view] * len(at), pa.int32()), pa.array(at - SPAN * BIN), pa.array(n[at])],
                                  names=["target", "view", "bin", "n"])
    return run


def sure(histogram: list[tuple[int, int]], share: float, calibration: tuple[float, float], part: float = SHARE) -> tuple[float, float]:
    """(low, high): a view labels lessons that score at or above high as 1 and those below low as 0.

    These are ``part`` of the lessons, ``share`` of it from the top, in whole bins, as far as the calibration gives their
    label a probability of ``SURE``. A view whose calibration does not rise with the score is never sure."""
    slope, shift = calibration
    if slope <= 0:
        return -np.inf, np.inf
    total = sum(n for _, n in histogram)
    ends = []
    for bins, want in ((sorted(histogram), part * (1 - share) * total), (sorted(histogram, reverse=True), part * share * total)):
        found, end = 0, None
        for b, n in bins:
            if found >= want:
                break
            found, end = found + n, b
        ends.append(end)
    odds = np.log(SURE / (1 - SURE))
    low = -np.inf if ends[0] is None else min((-odds - shift) / slope, (ends[0] + 1) / BIN)
    high = np.inf if ends[1] is None else max((odds - shift) / slope, ends[1] / BIN)
    return low, high


def _lessons_for(batch: pa.RecordBatch, aside: np.ndarray, scores: dict, limits: dict, target: str, view: int):
    """(label, weight) of the batch's rows as ``view`` learns them: from the labels, and from what the other view is sure of."""
    mark = _marks(batch, target)
    label, weight = mark.copy(), ((mark >= 0) & ~aside).astype(float)
    if target in scores:
        other, (low, high) = scores[target][1 - view], limits[target, 1 - view]
        for which, value in (((mark < 0) & (other >= high), 1), ((mark < 0) & (other < low), 0)):
            label[which], weight[which] = value, TAUGHT
    return label, weight


def _count(shared):
    """Arrow function: lessons of either class that hold a feature, by target, view and range of ``PART`` features; feature
    -1 counts the lessons."""
    def run(reader):
        views, limits = shared.value
        sums = {}
        for batch, pairs, scores in _scores(reader, views):
            aside = _kept_aside(batch)
            for target in TARGETS:
                for view, size in ((TEXT, BUCKETS), (META, _META_FEATURES)):
                    label, weight = _lessons_for(batch, aside, scores, limits, target, view)
                    if not weight.any():
                        continue
                    own = sums.setdefault((target, view), np.zeros((2, size + 1)))  # the lessons come first
                    own[:, 0] += [weight[label == value].sum() for value in (0, 1)]
                    row, feature = pairs[view]
                    at = np.flatnonzero((weight > 0)[row])
                    row = row[at]
                    np.add.at(own, (label[row], feature[at] + 1), weight[row])
        for (target, view), own in sums.items():
            feature = np.flatnonzero(own.any(axis=0)) - 1
            part, start = np.unique(feature // PART, return_index=True)
            ends = pa.array([*start, len(feature)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (feature, own[0, feature + 1], own[1, feature + 1])]
            yield pa.record_batch([pa.array([target] * len(part)), pa.array([view] * len(part), pa.int32()), pa.array(part), *lists],
                                  names=["target", "view", "part", "feature", "n0", "n1"])
    return run


def _add_counts(reader):
    """Arrow function: counts of the features of each range, one row a feature."""
    totals = {}
    for batch in reader:
        for target, view, part, *lists in zip(*[batch.column(i).to_pylist() for i in range(3)], *[batch.column(i) for i in (3, 4, 5)]):
            feature, n0, n1 = (own.values.to_numpy() for own in lists)
            own = totals.setdefault((target, view, part), np.zeros((2, PART)))
            own[:, feature - part * PART] += [n0, n1]
    for (target, view, part), own in totals.items():
        at = np.flatnonzero(own.any(axis=0))
        yield pa.record_batch([pa.array([target] * len(at)), pa.array([view] * len(at), pa.int32()), pa.array(at + part * PART),
                               pa.array(own[0, at]), pa.array(own[1, at])], names=["target", "view", "feature", "n0", "n1"])


def _multiply(shared):
    """Arrow function: sums of products of the chosen features, a constant and the goal, the upper triangle in parts."""
    def run(reader):
        views, limits, chosen = shared.value
        sizes = (BUCKETS, _META_FEATURES)
        place = {}
        for (target, view), features in chosen.items():
            place[target, view] = np.full(sizes[view], -1, np.int32)
            place[target, view][features] = np.arange(len(features))
        sums = {at: np.zeros((len(f) + 2, len(f) + 2)) for at, f in chosen.items()}
        for batch, pairs, scores in _scores(reader, views):
            aside = _kept_aside(batch)
            for (target, view), features in chosen.items():
                label, weight = _lessons_for(batch, aside, scores, limits, target, view)
                use = np.flatnonzero(weight)
                if not len(use):
                    continue
                at = np.zeros(batch.num_rows, np.int32)
                at[use] = np.arange(len(use))
                row, feature = pairs[view]
                own = np.flatnonzero((weight > 0)[row])
                row, column = at[row[own]], place[target, view][feature[own]]
                inside = column >= 0
                x = np.zeros((len(use), len(features) + 2))
                x[row[inside], column[inside]] = 1
                x[:, -2], x[:, -1] = 1, 2 * label[use] - 1
                sums[target, view] += (x * weight[use, None]).T @ x
        for (target, view), own in sums.items():
            flat = own[np.triu_indices(len(own))]
            parts = [flat[i:i + PART] for i in range(0, len(flat), PART)]
            yield pa.record_batch(
                [pa.array([target] * len(parts)), pa.array([view] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()),
                 pa.array([part.tolist() for part in parts], pa.list_(pa.float64()))], names=["target", "view", "part", "sums"])
    return run


def _add(reader):
    """Arrow function: sums of the parts that are of one kind; there are few kinds."""
    totals = {}
    for batch in reader:
        for target, view, part, sums in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
            own = sums.values.to_numpy()
            at = (target, view, part)
            totals[at] = totals[at] + own if at in totals else own.copy()
    for (target, view, part), own in totals.items():
        yield pa.record_batch([pa.array([target]), pa.array([view], pa.int32()), pa.array([part], pa.int32()),
                               pa.array([own.tolist()], pa.list_(pa.float64()))], names=["target", "view", "part", "sums"])


def counts(known: DataFrame, views: dict, limits: dict) -> DataFrame:
    """What the views may learn from all lessons: (target, view, feature, n0, n1)."""
    shared = known.sparkSession.sparkContext.broadcast((views, limits))  # SELECTED words and the metadata features
    found = _teaching(known, views).mapInArrow(
        _count(shared), "target string, view int, part bigint, feature array<bigint>, n0 array<double>, n1 array<double>")
    return found.repartition("target", "view", "part").mapInArrow(_add_counts, "target string, view int, feature bigint, n0 double, n1 double")


def _teaching(known: DataFrame, views: dict) -> DataFrame:
    """Lessons that can teach: without ``views`` to label the others, those with labels."""
    return known if views else known.where(F.coalesce(*TARGETS).isNotNull())


def choose(learnt: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Features of both views of every target with lessons of both classes: words that differ clearly between the classes,
    all of the metadata."""
    totals = {(r["target"], r["view"]): (r["n0"], r["n1"]) for r in learnt.where("feature = -1").collect()}
    out = {}
    for target in TARGETS:
        if any(0 in totals.get((target, view), (0, 0)) for view in (TEXT, META)):
            continue
        n0, n1 = totals[target, TEXT]
        own = learnt.where((F.col("target") == target) & (F.col("feature") >= 0))
        both = (F.col("n0") + F.col("n1") + 1) / (n0 + n1 + 2)
        apart = F.abs((F.col("n1") + 0.5) / (n1 + 1) - (F.col("n0") + 0.5) / (n0 + 1))
        z = apart / F.sqrt(both * (1 - both) * (1 / max(n0, 1) + 1 / max(n1, 1)) + 1e-12)
        words = (own.where((F.col("view") == TEXT) & (F.col("n0") + F.col("n1") >= MIN_DOCS)).withColumn("z", z)
                 .where(F.col("z") >= CLEAR).orderBy(F.desc("z"), "feature").limit(SELECTED).collect())
        meta = own.where(F.col("view") == META).collect()  # _META_FEATURES at most
        for view, rows in ((TEXT, words), (META, meta)):
            out[target, view] = np.array(sorted(r["feature"] for r in rows), np.int64)
    return out


def fit(known: DataFrame, views: dict, limits: dict) -> dict[str, tuple[View, View]]:
    """Both views of every target, from the labels and what ``views`` are sure of by ``limits``."""
    chosen = choose(written(counts(known, views, limits), "learnt"))
    shared = known.sparkSession.sparkContext.broadcast((views, limits, chosen))
    shape = "target string, view int, part int, sums array<double>"
    found = _teaching(known, views).mapInArrow(_multiply(shared), shape).repartition("target", "view", "part").mapInArrow(_add, shape).collect()
    products = {}
    for at, features in chosen.items():
        n = len(features) + 2
        parts = sorted((r["part"], r["sums"]) for r in found if (r["target"], r["view"]) == at)
        own = np.zeros((n, n))
        own[np.triu_indices(n)] = np.concatenate([np.array(sums) for _, sums in parts])
        products[at] = own + np.triu(own, 1).T
    return {t: tuple(View(chosen[t, v], products[t, v]) for v in (TEXT, META)) for t in TARGETS if (t, TEXT) in chosen}


def _held_scores(shared, target: str):
    """Arrow function: both views' scores of the lessons kept aside; all have labels."""
    def run(reader):
        for batch, _, scores in _scores(reader, shared.value, _kept_aside):
            text, meta = scores[target]
            yield pa.record_batch([batch.column("_lesson").cast(pa.binary()), pa.array(_marks(batch, target)), pa.array(text), pa.array(meta)],
                                  names=["_lesson", "mark", "by_text", "by_meta"])
    return run


class Model:
    """Per target: both views, their calibrations, how they combine, prior log-odds. A target without both classes
    among its labels, or among those kept aside, scores its prior."""

    def __init__(self, views: dict, parts: dict, priors: dict):
        self.views, self.parts, self.priors = {t: v for t, v in views.items() if t in parts}, parts, priors

    def log_odds(self, target: str, scores: list[np.ndarray] | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds of the word view, the metadata view and both."""
        if target not in self.parts:
            flat = np.full(n, self.priors[target])
            return flat, flat, flat
        cal_text, cal_meta, both = self.parts[target]
        t, m = cal_text[0] * scores[TEXT] + cal_text[1], cal_meta[0] * scores[META] + cal_meta[1]
        return t, m, both.weights[0] * t + both.weights[1] * m + both.bias


def calibrate(known: DataFrame, views: dict, labelled: int) -> dict:
    """Per target with both classes among the lessons kept aside: calibrations of both views and how they combine."""
    parts = {}
    for target, pair in views.items():
        shared = known.sparkSession.sparkContext.broadcast({target: pair})
        held = known.where(F.col(target).isNotNull()).mapInArrow(
            _held_scores(shared, target), "_lesson binary, mark bigint, by_text double, by_meta double")
        rows = held.orderBy("_lesson").limit(labelled).collect()
        y = np.array([r["mark"] for r in rows], float)
        if len(set(y)) < 2:
            continue
        t, m = np.array([r["by_text"] for r in rows]), np.array([r["by_meta"] for r in rows])
        cal_t, cal_m = platt(t, y), platt(m, y)
        calibrated = np.stack([cal_t[0] * t + cal_t[1], cal_m[0] * m + cal_m[1]], axis=1)
        parts[target] = (cal_t, cal_m, newton(calibrated, y, np.ones(len(y)), 0.1))
    return parts


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Fit on all lessons; the driver gets sums over the features kept, histograms and ``labelled`` scores of each target."""
    return _fitted(written(packed_lessons(docs, labels), "lessons"), labelled, rounds)


def _fitted(known: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    context = known.sparkSession.sparkContext
    tally = known.agg(*[F.count(F.when(F.col(t) == v, 1)).alias(f"{t}{v}") for t in TARGETS for v in (0, 1)]).first()
    priors = {t: float(np.log((tally[f"{t}1"] + 1) / (tally[f"{t}0"] + 1))) for t in TARGETS}
    share = {t: tally[f"{t}1"] / max(1, tally[f"{t}0"] + tally[f"{t}1"]) for t in TARGETS}
    views = fit(known, {}, {})
    parts = calibrate(known, views, labelled) if views else {}
    for _ in range(rounds):
        views = {t: v for t, v in views.items() if t in parts}
        if not views:
            break
        histogram = known.mapInArrow(_histogram(context.broadcast(views)), "target string, view int, bin bigint, n bigint").groupBy(
            "target", "view", "bin").agg(F.sum("n").alias("n")).collect()  # 2 * SPAN * BIN + 1 bins of each at most
        limits = {(t, v): sure([(r["bin"], r["n"]) for r in histogram if (r["target"], r["view"]) == (t, v)], share[t], parts[t][v])
                  for t in views for v in (TEXT, META)}
        views = fit(known, views, limits)
        parts = calibrate(known, views, labelled)
    return Model(views, parts, priors)


_SCORES = ", ".join(f"{t}_by_text double, {t}_by_metadata double, {t} double" for t in TARGETS) + ", kept boolean"


def _apply(shared, key: str):
    """Arrow function: column ``key`` and the scores of documents, or of lessons, which have their features."""
    def run(reader):
        model = shared.value
        scorer = Scorer(model.views)
        for batch in batches(reader, 2 << 20):
            words, meta = (_flat(batch.column("words")), batch.column("meta")) if key == "_lesson" else _features(batch)
            pairs = [words, _flat(meta)]
            columns, names = [batch.column(key)], [key]
            scores = scorer(pairs, batch.num_rows)
            for target in TARGETS:
                for name, odds in zip((f"{target}_by_text", f"{target}_by_metadata", target), model.log_odds(target, scores.get(target), batch.num_rows)):
                    columns.append(pa.array(1 / (1 + np.exp(-np.clip(odds, -50, 50)))))
                    names.append(name)
            columns.append(pa.array((np.asarray(columns[3]) >= 0.5) & (np.asarray(columns[6]) < 0.5)))
            yield pa.record_batch(columns, names=[*names, "kept"])
    return run


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, quality, toxic (probabilities, also by each view) and kept (quality >= 0.5 and toxic < 0.5) of every
    document.

    A null text counts as empty, null metadata as a value of its own; null ids are scored and, as unlabelled ones,
    learned from; repeated rows get the same scores. Without labels of both classes a target scores its prior, 0.5
    without any. Without a ``model`` one is trained, and documents take the scores of their lessons.
    """
    context = docs.sparkSession.sparkContext
    if model is not None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", "text", *_meta(docs)).mapInArrow(_apply(context.broadcast(model), "doc_id"), f"doc_id {kind}, {_SCORES}")
    known = written(packed_lessons(docs, labels), "lessons")
    shared = context.broadcast(_fitted(known))  # SELECTED words a target
    scored = known.select("_lesson", "words", "meta").mapInArrow(_apply(shared, "_lesson"), f"_lesson binary, {_SCORES}")
    return _with_lesson(docs).select("doc_id", "_lesson").join(scored, "_lesson", "left").drop("_lesson")
