"""Token ids against the tokenizer on hostile strings; packings that only crossover finds."""

import random

import pyarrow as pa
import pytest

from weblode.llm import packing

BITS = ["a", "B", "word", "é", "É", "ß", "Ñ", "Àÿ", "×", "÷", "í", "­", "ª", "µ", "\x7f", "1", "23", " ", "\n", "\x0b", "\x1c", "\x85", " ",
        "'s", "'", "'Re", "I'M", "don't", "<|", "<|endoftext|>", "|>", "</w>", "漢", "😀", "́", "İ", "K", "‍", "-", ".", "_", "<", "\x00"]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.tokenizer_path())


def split(ids, borders):
    return [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])]


def test_ids_are_those_of_the_tokenizer(encoder, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)  # so that generations turn over
    rng = random.Random(1)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(12_000)]
    texts += [None, "", "  \t ", "x" * 70_000, "Ab9é" * 20_000, "漢" * 500, None]
    for start in range(0, len(texts), 3_000):
        own = texts[start:start + 3_000]
        got = split(*encoder.encode(pa.array(own, pa.string())))
        assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END] for t in own]
        for cache in (encoder.words, encoder.known_parts):
            assert max(map(len, [*cache.young, *cache.old])) <= packing.LONG_WORD


def test_slices_and_no_rows(encoder):
    texts = pa.array(["one two", "three", None, "four five"])
    assert split(*encoder.encode(texts.slice(1, 3))) == split(*encoder.encode(texts))[1:]
    assert split(*encoder.encode(texts.slice(0, 0))) == []


def test_crossover_packs_better_than_best_fit():
    """Best-fit in no order of the first population reaches what the generations of an island do."""
    rng = random.Random(4)
    lengths = [rng.randint(20, 50) for _ in range(400)]
    first = packing.Bins(lengths, 100)
    first.best_fit(sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True))
    starts = packing.evolve(lengths, 100, [], 0, seed=1)
    best = packing.evolve(lengths, 100, [], packing.GENERATIONS, seed=1)
    assert len(best.members) < len(starts.members) <= len(first.members)
    assert sorted(i for m in best.members.values() for i in m) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in m) <= 100 for m in best.members.values())
