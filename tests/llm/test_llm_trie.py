"""Prefix trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

from weblode.llm import prefix_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, parent string"


def plain(data):
    """The rows by their definition."""
    convs = defaultdict(list)
    for c, turn, role, text, *_ in data:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in convs.items()}
    members = defaultdict(set)
    ends = defaultdict(set)
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20
        whole = tuple(convs.get(base, [])[:h] + turns[h:])
        ends[whole].add(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, inside in members.items():
        own = (len(inside) - 1) * len(node[-1][1].encode().split()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += own
    return sorted((min(inside), len(node), min(members[node[:-1]]) if node else -1, len(inside), children[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, inside in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in T.trie(df).collect())


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA)


def conversations(rng, n):
    out = []
    for c in range(n):
        for turn in range(rng.randrange(1, 9)):
            out.append((c, turn, rng.choice("ua"), " ".join(rng.choice("xy") for _ in range(rng.randrange(0, 3)))))
    return out


def test_trie_equals_a_plain_one(spark):
    rng = random.Random(11)
    data = conversations(rng, 300)
    data += [(c, t, "u", "first words of many") for c in range(400, 500) for t in range(2)]  # copies
    data += [(c, 0, "u", "first words of many") for c in range(500, 560)]  # some of them end before their own turns begin
    assert got(frame(spark, data)) == plain(data)


def test_awkward_rows(spark):
    data = [(None, 0, "u", "no id"), (None, 1, "u", "no id"), (7, None, None, None), (7, 0, None, "b c"), (7, 0, "a", None), (7, 0, "a", None),
            (9, 3, "u", "same"), (9, 3, "u", "same"), (9, 3, "u", "other"), (21, 5, "u", "w " * 100_000), (22, 0, "", ""), (20, 1, None, None),
            (20, 0, "u", ""), (39, 0, "u", "x"), (-3, 0, "u", "x"), (10**15, 1, "u", "\x1c\x85 y")]
    data = [r for r in data if r[0] is None or r[0] >= 0] + [(40, i, "u", f"t{i % 3}") for i in range(40)]
    assert got(frame(spark, data)) == plain(data)
    assert T.trie(frame(spark, [])).isEmpty() and T.trie(frame(spark, data[:2])).isEmpty()


def test_long_conversations_and_hot_turns(spark, monkeypatch):
    """A conversation of many turns (a long unary chain), one with a third of all rows, and long lists of ends in chunks."""
    monkeypatch.setattr(T, "CHUNK", 8)
    data = [(1000, i, "u", f"turn {i % 7}") for i in range(600)] + [(1001, i, "u", f"turn {i % 7}") for i in range(300)]
    data += [(c, 0, "u", "hello") for c in range(1020, 1320)] + [(c, 1, "a", f"own {c}") for c in range(1020, 1320, 2)]
    data += [(2000, None, "u", "same") for _ in range(200)]
    assert got(frame(spark, data)) == plain(data)


def test_contraction_of_chains_and_stars(spark):
    """Totals of any forest: a chain, a star, and a chain with a leaf at each node."""
    rows = []
    for i in range(1, 200):
        rows.append((1, i, 1 if i > 1 else None, i - 1, i))
        rows.append((1000 + i, i + 1, 1, i, 3))
    rows += [(c, 1, None, 0, 5) for c in range(5000, 5100)] + [(c, 2, 5000, 1, 1) for c in range(6000, 6100)]
    below = defaultdict(list)
    for c, d, p, u, _ in rows:
        below[p, u].append((c, d))
    own = {(c, d): s for c, d, _, _, s in rows}
    total = {}
    for c, d in sorted(own, key=lambda n: -n[1]):
        kids = below[c, d]
        total[c, d] = (sum(total[k][0] for k in kids) or 1, own[c, d] + sum(total[k][1] for k in kids))
    df = spark.createDataFrame([(*r, len(below[r[0], r[1]])) for r in rows], "conv_id bigint, depth bigint, parent bigint, up bigint, saved bigint, kids bigint")
    assert {(r.conv_id, r.depth): (r.leaves, r.tokens) for r in T.contracted(df).collect()} == total
