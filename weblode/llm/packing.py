"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenized, closed by an end token and cut into pieces of at most ``CAPACITY`` tokens. Full pieces
are sequences by themselves. The others are dealt into blocks of about ``BLOCK`` pieces, and ``ISLANDS`` islands
search for the packing of a block that needs the fewest sequences. An island holds a few packings; crossover
injects whole well-filled bins of one packing into another, empties the bins that hold the same pieces, and
puts the displaced ones back best-fit, largest first. Between epochs each island gets the elite of its
neighbour. An island stops as soon as it reaches the lower bound, total tokens / capacity.

What a block cannot fill well (bins under ``WELL_FILLED``) is packed again together with that of other blocks,
until one block is left, so the waste does not grow with the number of blocks.
"""

import os
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from weblode.llm.common import batches
from weblode.operators.blocks import written

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 12
WELL_FILLED = 0.985
CACHE_BYTES = 80 << 20
"""Bytes that a generation of remembered words may take in a worker; there are two of words and two of their parts."""
ENTRY = 150
"""About what an entry takes besides its characters and ids."""
LONG_WORD = 64
"""Longer words are not remembered."""


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


class Words:
    """Ids of recent words, as little-endian bytes: two generations, bounded by their bytes."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def ids(self, words: list[str], learn) -> list[bytes]:
        """Ids of distinct words; ``learn`` gives those of the ones that are not remembered."""
        out = list(map(self.young.get, words))
        lost = [n for n, code in enumerate(out) if code is None]
        unknown = []
        for n in lost:
            out[n] = self.old.get(words[n])
            if out[n] is None:
                unknown.append(n)
        for n, code in zip(unknown, learn([words[n] for n in unknown])):
            out[n] = code
        if self.size > CACHE_BYTES:
            self.young, self.old, self.size = {}, self.young, 0
        for n in lost:
            word = words[n]
            if len(word) <= LONG_WORD:
                self.young[word] = out[n]
                self.size += ENTRY + len(word) + len(out[n])
        return out


class Encoder:
    """Token ids of whole texts.

    The tokenizer treats white space as a border and drops it, so a text's ids are those of its words in a
    row. Texts are split and their words numbered by Arrow, only distinct words of a batch are looked up, and the ids
    are gathered by number. The tokenizer lowers words and cuts them at borders between letters, digits and marks; for
    words of printable ASCII and Latin-1 letters that is done here, so that "Word", "word," and "word." share their
    parts, and parts go straight to the tokenizer's merges. Ids of recent words and parts are remembered.
    """

    # What the tokenizer takes for letters among ASCII and Latin-1, where it cuts a lower-case word,
    # its characters for bytes that do not print, and a special token to set other words apart.
    PLAIN = r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+"
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+"
    HIDDEN = {**{128 + k: 290 + k for k in range(33)}, 173: 323}
    BORDER = "<|endoftext|>"

    def __init__(self, path: str):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain, self.parts = re.compile(self.PLAIN).fullmatch, re.compile(self.PARTS).findall
        self.border = self.tokenizer.token_to_id(self.BORDER)
        self.words, self.known_parts = Words(), Words()

    def _merge(self, parts: list[str]) -> list[bytes]:
        out = []
        for part in parts:
            seen = part if part.isascii() else part.encode().decode("latin-1").translate(self.HIDDEN)
            out.append(b"".join([token.id.to_bytes(4, "little") for token in self.model.tokenize(seen)]))
        return out

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(code.ids, "<i4").tobytes() for code in codes]

    def _in_rows(self, words: list[str]) -> list[bytes]:
        """Ids of words, a thousand in a text, told apart by a special token between them."""
        out = []
        for start in range(0, len(words), 1000):
            own = words[start:start + 1000]
            row = f" {self.BORDER} ".join([*own, ""])
            ids = np.array(self.tokenizer.encode(row, add_special_tokens=False).ids, "<i4")
            ends = (4 * np.flatnonzero(ids == self.border)).tolist()
            code = ids.tobytes()
            out += [code[b:e] for b, e in zip([0, *[e + 4 for e in ends]], ends)]
        return out

    def _learn(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        cut, rows, marked = {}, [], []
        for n, word in enumerate(words):
            if "<|" in word:  # may hold a special token
                marked.append(n)
            elif self.plain(word):
                cut[n] = self.parts(word.lower())
            else:
                rows.append(n)
        distinct = list({p for own in cut.values() for p in own})
        part_ids = dict(zip(distinct, self.known_parts.ids(distinct, self._merge)))
        for n, own in cut.items():
            out[n] = b"".join([part_ids[p] for p in own])
        for places, ids in ((rows, self._in_rows), (marked, self._one_by_one)):
            for n, code in zip(places, ids([words[n] for n in places])):
                out[n] = code
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text closed by ``END``, and where each text begins, plus the end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [*self.words.ids(words, self._learn), END.to_bytes(4, "little")]
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, begin = np.frombuffer(b"".join(ids), "<i4"), np.cumsum(length) - length
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        at = np.insert(coded.indices.to_numpy(), borders[1:], len(words))  # the last number is the end token
        where = np.concatenate([[0], np.cumsum(length[at])])
        out = np.empty(where[-1], "<i4")
        for start in range(0, len(at), 1 << 18):
            own = at[start:start + (1 << 18)]
            base = where[start]
            many = np.repeat(begin[own] - (where[start:start + len(own)] - base), length[own])
            many += np.arange(len(many))
            out[base:base + len(many)] = pool[many]
        return out, where[borders + np.arange(len(borders))]


_encoders: dict[str, Encoder] = {}


def _tokenize(path: str, capacity: int, with_ids: bool):
    def run(reader):
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for batch in batches(reader):
            ids, borders = encoder.encode(batch.column("text"))
            code = memoryview(ids).cast("B")
            total = np.diff(borders)
            pieces = -(-total // capacity)
            at = np.repeat(np.arange(len(total)), pieces)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(total[at] - start, capacity)
            begin = 4 * (borders[at] + start)
            parts = [code[b:e] for b, e in zip(begin.tolist(), (begin + 4 * length).tolist())]
            out = [batch.column("doc_id").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array([bytes(p) for p in parts], pa.binary()))
                names.append("ids")
            yield pa.record_batch(out, names=names)
    return run


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, on demand, ids (little-endian
    unsigned 32-bit). A null or empty text is one piece that holds the end token."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _tokenize(path or tokenizer_path(), capacity, with_ids),
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))


class Bins:
    """A packing of pieces 0 .. n-1: members and free room of each bin."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.members: dict[int, list[int]] = {}
        self.room: dict[int, int] = {}
        self.next = 0

    def copy(self) -> "Bins":
        other = Bins(self.lengths, self.capacity)
        other.members = {b: list(m) for b, m in self.members.items()}
        other.room, other.next = dict(self.room), self.next
        return other

    def add_bin(self, members: list[int]) -> None:
        self.members[self.next] = members
        self.room[self.next] = self.capacity - sum(self.lengths[i] for i in members)
        self.next += 1

    def best_fit(self, pieces: list[int]) -> None:
        """Each piece into the bin it fills best, or a new one."""
        rooms = sorted((r, b) for b, r in self.room.items())
        for i in pieces:
            at = bisect_left(rooms, (self.lengths[i], -1))
            if at < len(rooms):
                room, b = rooms.pop(at)
                self.members[b].append(i)
                self.room[b] = room - self.lengths[i]
            else:
                b = self.next
                self.add_bin([i])
            insort(rooms, (self.room[b], b))

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first; among equals, room gathered in few bins."""
        return len(self.members), -sum(r * r for r in self.room.values())

    @classmethod
    def from_labels(cls, lengths, capacity, labels) -> "Bins":
        groups: dict[int, list[int]] = {}
        for i, label in enumerate(labels):
            groups.setdefault(label, []).append(i)
        out = cls(lengths, capacity)
        for members in groups.values():
            out.add_bin(members)
        return out

    def labels(self) -> list[int]:
        out = [0] * len(self.lengths)
        for n, members in enumerate(self.members.values()):
            for i in members:
                out[i] = n
        return out


def crossover(target: Bins, source: Bins, rng: random.Random) -> Bins:
    """Well-filled bins of ``source`` enter a copy of ``target`` whole; pieces that get displaced are best-fitted."""
    child = target.copy()
    full = [b for b, room in source.room.items() if room <= (1 - WELL_FILLED) * source.capacity]
    rng.shuffle(full)
    injected = [source.members[b] for b in full[:max(1, len(full) // 4)]]
    taken = {i for members in injected for i in members}
    displaced = []
    weakest = sorted(child.room, key=child.room.get, reverse=True)[:2]  # emptied too, or nothing could improve
    for b in list(child.members):
        members = child.members[b]
        if b in weakest or not taken.isdisjoint(members):
            displaced += [i for i in members if i not in taken]
            del child.members[b], child.room[b]
    for members in injected:
        child.add_bin(list(members))
    child.best_fit(sorted(displaced, key=child.lengths.__getitem__, reverse=True))
    return child


def evolve(lengths: list[int], capacity: int, starts: list[Bins], generations: int, seed: int) -> Bins:
    """The best packing an island finds. ``starts`` are packings to begin with; the rest of the population is
    best-fit in orders that stray from largest-first."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    population = list(starts)
    while len(population) < POPULATION:
        stray = 0.0 if not population else 0.2 * len(population)
        order = sorted(range(len(lengths)), key=lambda i: lengths[i] * (1 + stray * (rng.random() - 0.5)), reverse=True)
        own = Bins(lengths, capacity)
        own.best_fit(order)
        population.append(own)
        if len(own.members) == least:
            return own
    for _ in range(generations):
        population.sort(key=Bins.fitness)
        if len(population[0].members) == least:
            break
        a, b = population[0], population[rng.randrange(1, len(population))]
        target, source = (a, b) if rng.random() < 0.5 else (b, a)
        child = crossover(target, source, rng)
        if child.fitness() < population[-1].fitness():
            population[-1] = child
    return min(population, key=Bins.fitness)


_STATE = "block bigint, island int, row bigint, length bigint, bin int, bins int, least int"


def _island(capacity: int, generations: int, epoch: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        frame = frame.sort_values(["origin", "row"], kind="stable")
        parts = [own for _, own in frame.groupby("origin", sort=True)]
        lengths = parts[0]["length"].tolist()
        starts = [Bins.from_labels(lengths, capacity, own["bin"].tolist()) for own in parts if own["bin"].iloc[0] >= 0]
        best = evolve(lengths, capacity, starts, generations, hash((block, island, epoch)) & 0x7FFFFFFF)
        return pd.DataFrame({"block": block, "island": island, "row": parts[0]["row"].to_numpy(), "length": lengths,
                             "bin": best.labels(), "bins": len(best.members), "least": -(-sum(lengths) // capacity)})
    return run


def _search(rows: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """rows (block, row, length) to (block, row, length, bin): the best packing over all islands."""
    one = rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "row", "length",
                      F.lit(-1).alias("bin"), F.lit(0).alias("origin"))
    done = None
    for epoch in range(epochs):
        state = written(one.groupBy("block", "island").applyInPandas(_island(capacity, GENERATIONS, epoch), _STATE), "islands")
        open_blocks = state.groupBy("block").agg(F.min(F.col("bins") - F.col("least")).alias("_gap")).where("_gap > 0").select("block")
        if epoch == epochs - 1 or open_blocks.isEmpty():
            done = state if done is None else done.unionByName(state)
            break
        rest = state.join(open_blocks, "block", "left_semi").drop("bins", "least")
        closed = state.join(open_blocks, "block", "left_anti")
        done = closed if done is None else done.unionByName(closed)
        moved = rest.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands))).withColumn("origin", F.lit(1))
        one = rest.withColumn("origin", F.lit(0)).unionByName(moved) if islands > 1 else rest.withColumn("origin", F.lit(0))
    best = done.groupBy("block").agg(F.min(F.struct("bins", "island")).getField("island").alias("island"))
    return done.join(best, ["block", "island"]).select("block", "row", "length", "bin")


def assign(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(row, sequence_id) for pieces (row, length), lengths 1 .. capacity."""
    full = pieces.where(F.col("length") >= capacity).select("row", (-F.col("row") - 1).alias("sequence_id"))
    rows = pieces.where(F.col("length") < capacity)
    out, level = full, 0
    while True:
        count = rows.count()
        if not count:
            return out
        blocks = -(-count // block)
        placed = written(_search(rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks))),
                                 capacity, islands, epochs), "packed")
        number = (F.lit(level << 56).cast("bigint") + F.col("block") * (1 << 16) + F.col("bin")).alias("sequence_id")
        if blocks == 1:
            return out.unionByName(placed.select("row", number))
        fill = placed.groupBy("block", "bin").agg(F.sum("length").alias("_sum"))
        joined = placed.join(fill, ["block", "bin"])
        loose = F.col("_sum") < WELL_FILLED * capacity
        out = out.unionByName(joined.where(~loose).select("row", number))
        rows = written(joined.where(loose).select("row", "length"), "loose")
        if level and rows.count() > 0.9 * count:  # packing them once more would not help
            blocks = -(-count // block)
            return out.unionByName(joined.where(loose).select("row", number))
        level += 1


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    Null and empty texts are pieces of one token, the end token; null ids are kept; repeated rows are pieces
    of their own. Other columns are ignored. No documents, no pieces.
    """
    known = written(tokenize(docs, path, capacity, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = known.join(assign(known.select("row", "length"), capacity), "row")
    before = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, spans): the token ids of each sequence in place, from ``pack(..., with_ids=True)``."""
    span = F.struct("offset", "length", "doc_id", "piece", "start", "ids")
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(span)).alias("_s")).select(
        "sequence_id", F.aggregate("_s", F.lit(b"").cast("binary"), lambda a, s: F.concat(a, s["ids"])).alias("ids"),
        F.transform("_s", lambda s: F.struct(s["offset"], s["length"], s["doc_id"], s["piece"], s["start"])).alias("spans"))
