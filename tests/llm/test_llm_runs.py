"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from samples import awkward, frame, rows

from weblode.llm import runs as R


def plain(words):
    """All runs by their definition."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w, out = np.array([number[x] for x in words], np.int64), {}
    for q in range(1, len(w) // 4 + 1):
        differ = np.concatenate([[-1], np.flatnonzero(w[:-q] != w[q:]), [len(w) - q]])
        for k in np.flatnonzero(np.diff(differ) - 1 + q >= max(6, 4 * q)).tolist():
            out.setdefault((int(differ[k]) + 1, int(differ[k + 1]) + q), q)
    return sorted((s, e, q) for (s, e), q in out.items())


def digest(data):
    return hashlib.sha256(data).hexdigest()


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2])) if found else None
    figures = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *figures, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()),
            digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic(rng, n):
    """Words with nested and neighbouring repeats."""
    words = []
    while len(words) < n:
        base = [rng.choice("abc") for _ in range(rng.choice((1, 2, 3, 5, 8, 13, 40)))]
        base = base * rng.choice((1, 1, 3)) + [rng.choice("abcd")]
        words += base * rng.randrange(1, 8)
    return words[:n]


@pytest.fixture(scope="module")
def small_tiles():
    before, R.TILE = R.TILE, 16
    yield
    R.TILE = before


def joined(found):
    """What ``stitched`` does, on sets."""
    out, by = {}, {}
    for s, e, q in found:
        by.setdefault(q, []).append((s, e))
    for q, some in by.items():
        some.sort()
        merged = []
        for s, e in some:
            if merged and s + q <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            if e - s >= max(6, 4 * q):
                assert (s, e) not in out
                out[s, e] = q
    return sorted((s, e, q) for (s, e), q in out.items())


def test_tiles_of_any_size_give_all_runs(small_tiles):
    rng = random.Random(8)
    for _ in range(400):
        words = periodic(rng, rng.randrange(0, 400))
        numbers = np.array([ord(w) for w in words], np.int64)
        assert joined(R.fragments(numbers, len(words))) == plain(words)


def test_given_and_awkward_documents_equal_brute_force(spark):
    rng = random.Random(9)
    data = rows()[:120] + awkward() + [(910_000 + i, " ".join(periodic(rng, 300)), "en", "s", 1) for i in range(40)]
    data += [(920_000, "a " * 5000, "en", "s", 1), (920_001, "\x1c\x85 x y " * 9, "en", "s", 1), (920_002, "a b c a b c\n" * 40 + "a b", None, None, None)]
    got = R.collapse(frame(spark, data), R.repeated).collect()
    want = [expected(d, t) for d, t, *_ in data]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(1 for w in want if w[1]) > 60


def test_stitching_by_document_and_period(spark):
    found = [(1, 0, 20, 2), (1, 14, 40, 2), (1, 39, 60, 2), (2, 5, 10, 1), (2, 9, 15, 1), (3, 0, 7, 2), (3, 0, 20, 2), (3, 0, 20, 2)]
    df = spark.createDataFrame(found, "doc bigint, start bigint, stop bigint, period bigint")
    assert sorted(map(tuple, R.stitched(df).collect())) == [(1, 0, 40, 2), (1, 39, 60, 2), (2, 5, 15, 1), (3, 0, 20, 2)]


def test_without_planted_repeats_and_empty(spark):
    df = frame(spark, [(1, "x y " * 10, "en", "s", 1), (1, "x y " * 10, "en", "s", 1)])
    assert [(r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in R.collapse(df).collect()] == [(1, 0, 20, 2, 10_000)] * 2
    assert R.collapse(df.limit(0)).isEmpty()
