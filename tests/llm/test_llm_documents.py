"""Document operators against brute force, on the smallest table and every awkward row."""

import collections
import hashlib
import math
import re
import zlib

import pytest
import xxhash
from compare import compare, duck
from samples import SMALL, awkward, frame, rows

from weblode.llm import cotrain, decontaminate, line_dedup, near_dedup, packing, quality_rules, sharding, suffix_dedup
from weblode.llm.queries import ORACLES, QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


@pytest.fixture(scope="module")
def data():
    return [r for r in rows()] + awkward()


@pytest.fixture(scope="module")
def docs(spark, data):
    return frame(spark, data).repartition(3).cache()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_twin(spark, name):
    assert compare(spark, duck(SMALL), name, QUERIES[name], ORACLES[name], SMALL) == ""


def test_every_operator_has_a_query():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES if q.startswith("op")} and "pipeline" in QUERIES


def test_row_keys_tell_nulls_apart(spark):
    from weblode.llm.common import row_key
    some = spark.createDataFrame([(7, None), (None, "7"), (None, None), (7, ""), (None, ""), (7, "7")], "doc_id bigint, text string")
    assert some.select(row_key().alias("k")).distinct().count() == 6


# --- sharding ---------------------------------------------------------------------------------------------------

def _winner(key, shards):
    import math

    def cost(s):
        # A hash of several values feeds the hash of one in as the seed of the next; 42 is the first seed.
        h = 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), seed=42)
        h = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), seed=h)
        return -math.log(((h >> 12) + 0.5) * 2.0 ** -52), s
    return min(map(cost, range(shards)))[1]


def test_sharding(docs, data):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(data)
    want = collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", _winner(d, 40), _winner(d, 41)) for d, t, *_ in data)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_shift_shares(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "k")
    n = dict(sharding.assign(ids, "k", 3, [1.0, 2.0, 1.0]).groupBy("shard").count().collect())
    assert abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
    with pytest.raises(ValueError):
        sharding.assign(ids, "k", 2, [1.0, 0.0])


# --- quality rules ----------------------------------------------------------------------------------------------

def test_quality_measures(docs, data):
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(data)

    def measure(text):
        words = WORDS(text or "")
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORDS(x)]
        return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked),
                len(words) < 50 or 100 * len(marked) > 50 * len(words))

    want = collections.Counter((d, *measure(t)) for d, t, *_ in data)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert all(r.kept == (not r.base_failed and r.lower <= r.log_perplexity <= r.upper) for r in got if r.lower is not None and r.log_perplexity is not None)


def test_copies_and_small_languages_keep_their_band(spark):
    """A text that most rows of a language hold, and a language of two documents."""
    import random
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]

    def text(n=150):
        return " ".join(words[min(199, int(rng.expovariate(0.03)))] for _ in range(n))

    one = text()
    data = [(i, text(), "en") for i in range(60)] + [(100 + i, one, "en") for i in range(80)]
    data += [(500, text(), "zz"), (501, text(), "zz")]
    got = quality_rules.judge(spark.createDataFrame(data, "doc_id bigint, text string, lang string")).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept & set(range(60))) >= 58 and {500, 501} <= kept


def test_every_language_has_its_own_band(spark, monkeypatch):
    """Languages beyond those of one round are judged by models and bands of their own, as they are by themselves."""
    import random
    rng = random.Random(9)
    data, schema = [], "doc_id bigint, text string, lang string"
    for n in range(67):
        words = [f"{chr(97 + n % 26)}{n}x{i}" for i in range(4 + n)]
        data += [(100 * n + i, " ".join(rng.choices(words, k=60)), f"l{n}" if n else None) for i in range(2)]
    got = quality_rules.judge(spark.createDataFrame(data, schema)).collect()
    assert len(got) == len(data) and all(r.lower is not None for r in got if not r.base_failed)
    assert len({(r.lower, r.upper) for r in got if not r.base_failed}) == len({r.doc_id // 100 for r in got if not r.base_failed}) > 60
    monkeypatch.setattr(quality_rules, "ROUND", 3)
    few = [r for r in data if r[0] < 700]
    assert sorted(quality_rules.judge(spark.createDataFrame(few, schema)).collect()) == sorted(r for r in got if r.doc_id < 700)


def test_counting_words_holds_few(monkeypatch):
    """What a task holds of words is bounded; what it gives back is not cut."""
    import pyarrow as pa
    monkeypatch.setattr(quality_rules, "_FLUSH", 50)
    batch = pa.record_batch([pa.array(["en"] * 40), pa.array([" ".join(f"w{i}x{j % 20}" for j in range(30)) for i in range(40)])], names=["_lang", "text"])
    monkeypatch.setattr(quality_rules, "_BATCH", 100)
    out = list(quality_rules._count_words(iter([batch])))
    assert max(b.num_rows for b in out) < 200 and sum(sum(b.column("n").to_pylist()) for b in out) == 1200


def test_kneser_ney_sums_to_one(spark):
    """Over the whole vocabulary, words seen and unseen after a context share all of the probability."""
    import math
    import random
    rng = random.Random(1)
    counts = collections.Counter((u, min(15, int(rng.expovariate(0.3)))) for u in range(6) for _ in range(200))
    pair, single, context = quality_rules.kneser_ney(
        spark.createDataFrame([("en", u, w, n) for (u, w), n in counts.items()], "lang string, u int, w int, c bigint"), size=14)
    p1 = {r.w: r.p for r in single.collect()}
    gamma = {r.u: r.gamma for r in context.collect()}
    p2 = {divmod(r.key, 1 << quality_rules._SHIFT): math.exp(r.logp) for r in pair.collect()}
    unseen = (1 - sum(p1.values()))  # spread over words no count has
    for u in range(6):
        total = sum(p2.get((u, w), gamma[u] * p1[w]) for w in p1) + gamma[u] * unseen
        assert abs(total - 1) < 1e-6


def test_no_bigram_is_cut(spark):
    """A model keeps its rare bigrams, however many there are."""
    counted = spark.range(400 * 400).selectExpr("'en' AS lang", "CAST(id DIV 400 AS INT) AS u", "CAST(id % 400 AS INT) AS w", "1 + id % 7 AS c")
    assert quality_rules.kneser_ney(counted)[0].count() == 400 * 400


def _scores(texts):
    """Log perplexities of the texts of one language under the model of all words and bigrams, in plain Python."""
    three = {(a, b, c) for t in texts for a, b, c in zip(["<<", "<", *WORDS(t)], ["<", *WORDS(t)], WORDS(t))}
    count = collections.Counter((b, c) for _, b, c in three)
    before = collections.Counter(c for _, c in count)

    def cuts(counts):
        n = [0, *(sum(x == i for x in counts) for i in (1, 2, 3, 4))]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        return [min(max(i - (i + 1) * y * n[i + 1] / max(n[i], 1), 0.05), i - 0.05) for i in (1, 2, 3)]

    high, low = cuts(count.values()), cuts(before.values())
    left = sum(low[min(n, 3) - 1] for n in before.values()) / len(count) / len(before)
    total, taken = collections.Counter(), collections.Counter()
    for (u, _), n in count.items():
        total[u] += n
        taken[u] += high[min(n, 3) - 1]

    def logp(u, w):
        p = (before[w] - low[min(before[w], 3) - 1]) / len(count) + left
        return math.log((count[u, w] - high[min(count[u, w], 3) - 1]) / total[u] + taken[u] / total[u] * p)

    return [-sum(logp(u, w) for u, w in zip(["<", *WORDS(t)], WORDS(t))) / max(len(WORDS(t)), 1) for t in texts]


def test_perplexity_is_that_of_all_words_and_bigrams(spark, monkeypatch):
    """Two languages that share words, of over 1,023 words each, in many parts and several lots, equal plain Python."""
    import random
    rng = random.Random(3)
    texts = {lang: [" ".join(f"w{int(rng.paretovariate(0.2)) % 5000}é" for _ in range(rng.choice([1, 2, 100, 300]))) for _ in range(60)] for lang in ("en", "fr")}
    texts["en"] += [" \n" + texts["en"][3] + "\v", texts["fr"][5]]
    assert all(len(set(WORDS(" ".join(t)))) > 1023 for t in texts.values())
    monkeypatch.setattr(quality_rules, "_PART", 4000, raising=False)
    data = [(100 * n + i, t, lang) for n, (lang, own) in enumerate(texts.items()) for i, t in enumerate(own)]
    got = quality_rules.judge(spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(5)).collect()
    found = {r.doc_id: r.log_perplexity for r in got}
    for n, own in enumerate(texts.values()):
        for i, x in enumerate(_scores(own)):
            assert abs(found[100 * n + i] - x) < 1e-9


def test_pairs_of_rare_words_count_in_the_pipeline(spark):
    """Texts that differ in the order of words beyond the 1,023 most frequent alone, in the pipeline's first stage."""
    import random

    import corpus_pipeline
    rng = random.Random(8)
    often, rare = [f"o{i}" for i in range(1023)] * 6, [[f"r{i}{x}" for x in "abc"] for i in range(1500)]
    data = []
    rng.shuffle(often)
    for i in range(60):
        own = [rare[(100 * i + j) % 1500] for j in range(100)]  # each of the 1,500 runs of three words is in four texts
        rng.shuffle(own)
        data.append((i, " ".join(" ".join([o, *three]) for o, three in zip(often[100 * i:100 * i + 100], own)), "en"))
    for i in range(3):  # the texts 0, 1 and 2, the rare words in places of other rare words
        words = data[i][1].split(" ")
        mixed = [w for w in words if w[0] == "r"]
        rng.shuffle(mixed)
        left = iter(mixed)
        data.append((100 + i, " ".join(next(left) if w[0] == "r" else w for w in words), "en"))
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert not any(r.base_failed for r in found.values())
    assert all(found[100 + i].log_perplexity > found[i].log_perplexity + 0.5 for i in range(3))
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, "").collect()} == set(range(60))


# --- near duplicates --------------------------------------------------------------------------------------------

def _components(data):
    sets = {}
    for d, t, *_ in data:
        if d is not None:
            w = WORDS(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
            sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates(docs, data):
    want = _components(data)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(data)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("levels", [2, 6])
def test_near_duplicates_through_deep_nodes(docs, data, monkeypatch, levels):
    """Nodes that hold eight documents at most branch on, and those still large at the last level meet block by block."""
    monkeypatch.setattr(near_dedup, "NODE", 8)
    monkeypatch.setattr(near_dedup, "LEVELS", levels)
    want = _components(data)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got == {i: component for i, (_, component) in want.items()}


def test_chains_and_crowds_are_joined(spark):
    """A long chain of links, and more near copies than a node compares, become one component each."""
    import random
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    chain = [rng.choice(words) for _ in range(200)]
    data = []
    for i in range(12):
        data.append((i, " ".join(chain)))
        for _ in range(2):
            chain[rng.randrange(200)] = rng.choice(words)
    crowd = [rng.choice(words) for _ in range(150)]
    for i in range(300):
        own = list(crowd)
        for _ in range(1 + i % 2):
            own[rng.randrange(150)] = rng.choice(words)
        data.append((1000 + i, " ".join(own)))
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    want = _components(data)
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in want.items()}
    assert near_dedup.miss() < 1e-4


# --- suffixes ---------------------------------------------------------------------------------------------------

def _cut(data):
    texts = [(d, (t or "").encode()) for d, t, *_ in data]
    seen = collections.Counter(b[i:i + 200] for _, b in texts for i in range(len(b) - 199))
    out = collections.Counter()
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_repeated_strings(docs, data, monkeypatch, hot):
    """With ``hot`` 2 most buckets are counted by hashes; the result is the same."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = suffix_dedup.remove_repeats(docs)
    assert collections.Counter(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == _cut(data)


def test_suffix_order():
    import numpy as np
    rng = np.random.default_rng(3)
    for _ in range(10):
        data = np.concatenate([rng.integers(97, 99, 30), *[rng.integers(97, 100, 260)] * 3, rng.integers(97, 98, 400)]).astype(np.uint8)
        at = np.arange(len(data) - 199)
        strings = [data[i:i + 200].tobytes() for i in at[suffix_dedup.suffix_order(data, at)]]
        assert strings == sorted(strings)
        count = collections.Counter(strings)
        assert suffix_dedup.repeated(data, at).tolist() == [count[data[i:i + 200].tobytes()] > 1 for i in at]


def test_rest_is_the_kept_bytes(docs):
    for r in suffix_dedup.remove_repeats(docs, with_rest=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


# --- lines ------------------------------------------------------------------------------------------------------

def test_lines(docs, data):
    got = {r.doc_id: r for r in line_dedup.deduplicate(docs).collect() if r.doc_id is not None}
    assert got[900_011].n_removed == 0 and got[900_012].n_removed == 8 and got[900_012].text == "own start of text"
    assert got[900_001].text is None and got[900_001].n_lines == 0 and got[900_003].text == " \n\t "
    first = {}
    for d, t, *_ in sorted((r for r in data if r[0] is not None and r[1]), key=lambda r: r[0]):
        lines = t.split("\n")
        left = [x for x in lines if WORDS(x)]
        # Every line that goes has an equal one before it; every run of four lines seen before loses its inner lines.
        gone = collections.Counter(left) - collections.Counter(x for x in got[d].text.split("\n") if WORDS(x))
        earlier = set(first)
        for x, n in gone.items():
            assert x in earlier or left.count(x) > n
        for x in left:
            first.setdefault(x, d)


def test_guaranteed_runs_lose_all_but_their_ends(spark):
    block = "\n".join(f"shared line {i}" for i in range(10))
    data = [(i, f"head {i}\n{block}\ntail {i}") for i in range(20)]
    got = {r.doc_id: r for r in line_dedup.deduplicate(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 10 and got[i].text == f"head {i}\ntail {i}" for i in range(1, 20))


def test_short_runs_of_many_words_go(spark):
    """Two or three lines of over 50 words together, whatever their place, and short documents; shorter runs stay."""
    def line(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    two, three, few = [line("a", 30), line("b", 25)], [line("c", 20), line("d", 20), line("e", 20)], [line("f", 10), line("g", 10)]
    long = [line(f"x{i}-", 5) for i in range(9)]
    data = [(1, [*long[:4], *two, *long[4:]]), (2, [*two]), (3, [line("y", 7), *two]), (4, [*three, line("z", 3)]), (5, [line("u", 3), *three]),
            (6, few), (7, few), (8, [line("v", 9), *few, line("w", 9), *two, line("q", 9), *three, line("p", 9)])]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in data], "doc_id bigint, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.drop_repeated_lines(df).collect()}
    keep = dict(data)
    assert got == {1: keep[1], 3: [line("y", 7)], 4: keep[4], 5: [line("u", 3)], 6: few,
                   8: [line("v", 9), *few, line("w", 9), line("q", 9), line("p", 9)]}


# --- decontamination --------------------------------------------------------------------------------------------

def test_forms_are_computed_once(spark):
    """Tokens are cut and lower-cased once for all forms; functions with a lambda would do it again for each mention."""
    one = spark.createDataFrame([(1, "Ask Ann Lee for 5 Km, 7 8 or 9 M now"), (2, None)], "k int, text string")
    got = decontaminate.with_forms(one, "text", decontaminate.FORMS)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("lower(") == 1
    row, empty = got.orderBy("k").collect()
    assert row["_k_typed"] == ["ask", "<name>", "<name>", "for", "<number>", "<name>", "<number>", "<number>", "or", "<number>", "<name>", "now"]
    assert row["_k_lower"] == ["ask", "ann", "lee", "for", "<number>", "<unit>", "<number>", "<number>", "or", "<number>", "<unit>", "now"]
    assert row["_k_runs"] == ["ask", "<name>", "for", "<number>", "<name>", "<number>", "or", "<number>", "<name>", "now"]
    assert row["_k_exact"] == ["ask", "ann", "lee", "for", "5", "km", "7", "8", "or", "9", "m", "now"]
    assert [empty[f"_k_{f}"] for f in decontaminate.FORMS] == [[]] * 4


def test_templates_catch_other_numbers_and_names(spark):
    items = spark.createDataFrame([
        (1, "If Alice has 12 apples and gives 5 kg of them to her friend how many apples are left when 12 were counted"),
        (2, None), (3, ""), (4, "short one"), (1, "If Alice has 12 apples and gives 5 kg of them to her friend how many apples are left when 12 were counted")],
        "item_id bigint, text string")
    same = "Intro. {} has {} apples and gives {} g of them to her friend how many apples are left when {} were counted. End"
    docs = spark.createDataFrame([
        (10, same.format("If Bob", 30, 7, 30)), (11, same.format("If Bob", 30, 7, 31)), (12, "nothing of that kind here at all, only other words"),
        (13, None), (14, ""), (15, "here is a short one and more")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_items, r.first_item, r.contaminated) for r in decontaminate.scan(docs, items).collect()}
    assert got == {10: (1, 1, True), 11: (0, None, False), 12: (0, None, False), 13: (0, None, False), 14: (0, None, False), 15: (1, 4, True)}
    assert decontaminate.scan(docs, items.limit(0)).where("contaminated").isEmpty()


def test_forms_catch_other_cases(spark):
    """Copies in capitals, in title case and without any capital."""
    text = "On some days the farmer near Alice Brown sold his 12 cows and bought Lee a new barn for 40 hens and geese"
    items = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "So: " + text.upper()), (2, text.title()), (3, text.lower()), (4, "The farmer sold his cows")], "doc_id bigint, text string")
    assert {r.doc_id for r in decontaminate.keep_clean(docs, items).collect()} == {4}


def test_forms_catch_other_lengths_and_numbers(spark):
    """Slots of another length, and an item of numbers and names only."""
    text = "On some days the farmer near Alice Brown sold his 12 cows and bought Lee a new barn for 40 hens and geese"
    numbers = "11 Ann 12 Bob 13 Cid 14 Dan 15 Eve 16"
    items = spark.createDataFrame([(1, text), (2, numbers)], "item_id bigint, text string")
    longer = text.replace("Lee", "Ann Mary Fox").replace("Alice Brown", "Bob")
    docs = spark.createDataFrame([
        (4, longer), (5, "So " + numbers + " it is"), (6, numbers.replace("13", "99")),
        (7, "The farmer sold his cows and nothing else was told of that day by Ann"), (8, None)], "doc_id bigint, text string")
    assert {r.doc_id for r in decontaminate.keep_clean(docs, items).collect()} == {6, 7, 8}


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    name = "op4_template_decontamination"
    assert compare(spark, duck(SMALL), name, QUERIES[name], ORACLES[name], SMALL) == ""


# --- packing ----------------------------------------------------------------------------------------------------

def test_packing(docs, data):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for d, t, *_ in data:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            want[d, piece, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    got = packing.pack(docs, with_ids=True).cache()
    all_rows = got.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in all_rows) == want
    total, places = sum(r.length for r in all_rows), collections.defaultdict(list)
    for r in all_rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) <= -(-total // 4096) + 1
    for s in packing.sequences(got).collect():
        assert len(s.ids) == 4 * sum(x.length for x in s.spans)


def test_packing_in_many_blocks(spark):
    import random
    rng = random.Random(8)
    data = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(60, 100)])) for i in range(600)]
    pieces = spark.createDataFrame(data, "row bigint, length bigint")
    got = packing.assign(pieces, capacity=100, block=100).join(pieces, "row").groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in got) == sum(n for _, n in data) and max(r[1] for r in got) <= 100
    lone = sum(n > 50 for _, n in data)
    assert len(got) <= 1.03 * max(lone, sum(n for _, n in data) / 100) + 2


def test_crossover_keeps_every_piece_once():
    import random
    rng = random.Random(5)
    lengths = [rng.randrange(1, 50) for _ in range(200)]
    packs = []
    for _ in range(2):
        own = packing.Bins(lengths, 100)
        order = list(range(200))
        rng.shuffle(order)
        own.best_fit(order)
        packs.append(own)
    child = packing.crossover(*packs, rng)
    assert sorted(i for m in child.members.values() for i in m) == list(range(200))
    assert all(child.room[b] == 100 - sum(lengths[i] for i in m) >= 0 for b, m in child.members.items())


# --- co-training ------------------------------------------------------------------------------------------------

def test_cotrained_scores_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = cotrain.train(docs, labels.where("doc_id % 3 <> 0"))
    got = cotrain.score(docs, labels, model).join(labels.where("doc_id % 3 = 0").selectExpr("doc_id", "quality AS q", "toxic AS t"), "doc_id").collect()
    assert sum((r.quality >= 0.5) == (r.q == 1) for r in got) / len(got) > 0.93
    assert sum((r.toxic >= 0.5) == (r.t == 1) for r in got) / len(got) > 0.9
    assert cotrain.score(docs, labels, model).count() == docs.count()


def test_cotraining_awkward_rows(docs, data, spark):
    labels = spark.createDataFrame([(900_001, 1, None), (900_002, 0, 0), (None, 1, 1), (5, 1, 0), (5, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = cotrain.score(docs, labels).collect()
    assert len(got) == len(data) and all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 for r in got)
    assert cotrain.score(docs, labels.limit(0)).where("quality <> 0.5 OR toxic <> 0.5").isEmpty()


def _plain_lessons(data, marks):
    """lesson: (words, metadata features, {target: mark}) read from rows in plain Python."""
    out = {}
    for doc_id, text, lang, source, n_chars in data:
        own = out.setdefault((text, lang, source, n_chars), (
            set(cotrain.word_features(text or "")), set(cotrain.meta_features(lang, source, n_chars, text or "")), {}))
        for target, mark in marks.get(doc_id, {}).items():
            own[2][target] = mark if target not in own[2] else (min if target == "quality" else max)(own[2][target], mark)
    return out


def test_cotraining_learns_from_every_unlabelled_lesson(spark, docs, data):
    marks = {r[0]: {"quality": r[0] % 2, "toxic": int(r[0] % 5 == 0)} for r in data if r[0] is not None and r[0] % 3 == 0}
    labels = spark.createDataFrame([(i, m["quality"], m["toxic"]) for i, m in marks.items()], "doc_id bigint, quality int, toxic int")
    known = cotrain.lessons(docs, labels).cache()
    plain = _plain_lessons(data, marks)
    assert known.count() == len(plain) and known.where("quality IS NOT NULL").count() == sum(bool(m) for _, _, m in plain.values())

    first = cotrain.fit(known, {}, {})
    aside = {(frozenset(r.words), frozenset(r.meta)): r["_lesson"][0] % 4 == 0 for r in known.collect()}
    limits = {(t, v): (-0.2, 0.1) for t in first for v in (cotrain.TEXT, cotrain.META)}

    def learnt(target, view):
        for words, meta, mark in plain.values():
            own, other = ((words, meta) if view == cotrain.TEXT else (meta, words))
            if target in mark:
                if not aside[frozenset(words), frozenset(meta)]:
                    yield own, mark[target], 1.0
            else:
                teacher = first[target][1 - view]
                score = teacher.bias + sum(w for f, w in zip(teacher.features.tolist(), teacher.weights) if f in other)
                if score >= 0.1 or score < -0.2:
                    yield own, int(score >= 0.1), cotrain.TAUGHT

    got = {(r.target, r.view, r.feature): (r.n0, r.n1) for r in cotrain.counts(known, first, limits).collect()}
    want = {}
    for target in first:
        for view in (cotrain.TEXT, cotrain.META):
            for own, label, weight in learnt(target, view):
                for feature in [*own, -1]:
                    want.setdefault((target, view, feature), [0.0, 0.0])[label] += weight
    assert {k: tuple(v) for k, v in want.items()} == got
    assert any(v != int(v) for pair in got.values() for v in pair)  # lessons without labels taught

    import numpy as np
    again = cotrain.fit(known, first, limits)
    for target, views in again.items():
        for view, fitted in enumerate(views):
            rows = list(learnt(target, view))
            x = np.array([[f in own for f in fitted.features.tolist()] + [1] for own, _, _ in rows], float)
            y, w = np.array([2 * label - 1 for _, label, _ in rows]), np.array([weight for _, _, weight in rows])
            penalty = np.diag([cotrain.RIDGE] * len(fitted.features) + [1e-3])
            solved = np.linalg.solve((x * w[:, None]).T @ x + penalty, (x * w[:, None]).T @ y)
            assert np.allclose(solved, [*fitted.weights, fitted.bias])
    known.unpersist()


def test_sure_lessons():
    even = [(b, 10) for b in range(-1000, 1000)]
    low, high = cotrain.sure(even, 0.5, (100.0, 0.0))
    assert (low, high) == (-0.9, 0.9)
    low, high = cotrain.sure(even, 0.5, (1.0, 0.0))  # a calibration that is never that sure
    assert low < -1 and high > 1
    assert cotrain.sure(even, 0.5, (-1.0, 0.0)) == (-math.inf, math.inf) and cotrain.sure([], 0.5, (1.0, 0.0)) == (-math.inf, math.inf)


def test_word_features_travel_at_two_bytes(data):
    import numpy as np
    for own in [*[cotrain.word_features(t or "") for _, t, *_ in data], [0, 65_535, 65_536, cotrain.BUCKETS - 1], []]:
        packed = cotrain.pack(np.array(own, np.int64))
        assert cotrain.unpack(packed).tolist() == own and len(packed) == 2 * len(own) + 4 * (cotrain.BUCKETS >> 16)


def test_word_view_of_many_texts(data):
    """Texts taken apart together have the features of each read by itself in plain Python."""
    import random
    import re

    import numpy as np
    import pyarrow as pa
    import xxhash

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        distinct = set(words)
        out = {w.strip(".,;:!?\"'()[]#*$%&|<>").lower() for w in distinct}
        out.update(["^" + w[:5] for w in out if len(w) > 5] + ["^" + w[:7] for w in out if len(w) > 7])
        odd = [m.group() for w in distinct if (m := re.search(r"\W+$", w))]
        n, kinds = max(1, len(words)), max(1, len(distinct))
        out.update(["~end " + t for t in odd] + [
            f"~distinct {10 * len(distinct) // n}", f"~upper {10 * sum(w.isupper() and len(w) > 1 for w in distinct) // kinds}",
            f"~marked {10 * len([t for t in odd if len(t) > 1]) // kinds}"])
        return sorted({xxhash.xxh3_64_intdigest(t) % cotrain.BUCKETS for t in out})

    rng, marks = random.Random(5), "aBcdefG \t\n\x0b\x1c\x85\xa0É\u0130\u03a3\u01c5ß\u0301_9.,-!\u300c\u4e2d\U0001f600\U0001d400\x00"
    texts = [t or "" for _, t, *_ in data] + ["".join(rng.choice(marks) for _ in range(rng.randrange(80))) for _ in range(2000)]
    row, feature = cotrain.word_view(pa.array(texts, pa.string()))
    assert [own.tolist() for own in np.split(feature, np.searchsorted(row, np.arange(1, len(texts))))] == [plain(t) for t in texts]
    packed = cotrain.pack_rows(row, feature, len(texts))
    assert packed.to_pylist() == [cotrain.pack(np.array(plain(t))) for t in texts]
    again = cotrain.unpack_rows(packed.slice(5, 900))
    assert (again[0] + 5).tolist() == row[(row >= 5) & (row < 905)].tolist() and again[1].tolist() == feature[(row >= 5) & (row < 905)].tolist()


def test_cotraining_sums_travel_by_range(spark):
    """Lessons reach Python packed, and a task gives a row for each range of features, not for each feature."""
    from types import SimpleNamespace
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(100)) + " good" * (i % 2), "en", None, None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 200, 2)] + [(i, i % 2, None) for i in range(1, 200, 4)],
                                   "doc_id bigint, quality int, toxic int")
    known = cotrain.packed_lessons(docs, labels).cache()
    assert known.schema["words"].dataType.simpleString() == "binary"
    sent = list(cotrain._count(SimpleNamespace(value=({}, {})))(iter(known.toArrow().to_batches())))
    features = sum(len(own) for batch in sent for own in batch.column("feature").to_pylist())
    assert sum(batch.num_rows for batch in sent) <= 2 * (cotrain.BUCKETS // cotrain.PART + 3) < features / 10
    table = lambda df: sorted((r.target, r.view, r.feature, r.n0, r.n1) for r in df.collect())
    apart = cotrain.lessons(docs, labels)
    assert table(cotrain.counts(known, {}, {})) == table(cotrain.counts(apart, {}, {}))
    views = cotrain.fit(known, {}, {})
    limits = {(t, v): (-0.1, 0.1) for t in views for v in (cotrain.TEXT, cotrain.META)}
    taught = table(cotrain.counts(known, views, limits))
    assert views and taught == table(cotrain.counts(apart, views, limits)) and len(taught) > len(table(cotrain.counts(known, {}, {})))
    labelled = known.where("quality IS NOT NULL OR toxic IS NOT NULL")
    parts = lambda df: {t: (*own[:2], own[2].bias) for t, own in cotrain.calibrate(df, views, 1000).items()}
    assert parts(known) == parts(labelled) != {}
    known.unpersist()


def test_documents_take_the_scores_of_their_lessons(spark, docs):
    """Texts are taken apart once, and the scores are those the model gives the documents by itself."""
    labels = spark.createDataFrame([(r.doc_id, r.doc_id % 2, int(r.doc_id % 5 == 0)) for r in docs.select("doc_id").where("doc_id % 3 = 0").collect()],
                                   "doc_id bigint, quality int, toxic int")
    got = cotrain.score(docs, labels)
    want = cotrain.score(docs, labels, cotrain.train(docs, labels))
    rows = lambda df: sorted(repr((r.doc_id, r.kept, *[round(x, 9) for x in r if isinstance(x, float)])) for r in df.collect())
    assert got.schema == want.schema and rows(got) == rows(want)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert any("words#" in line for line in plan(got).splitlines() if "MapInArrow" in line)


# --- empty tables -----------------------------------------------------------------------------------------------

def test_empty_documents(spark):
    none = frame(spark, awkward()).limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id bigint, text string")
    for out in (sharding.shard_documents(none), quality_rules.judge(none), near_dedup.near_duplicates(none), suffix_dedup.remove_repeats(none),
                line_dedup.deduplicate(none), decontaminate.scan(none, items), packing.pack(none), cotrain.score(none, labels)):
        assert out.isEmpty()
