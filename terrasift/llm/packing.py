"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Tokenising: each document's ids and a closing id are cut into pieces of `capacity`; a full piece is a sequence of its
own. The rest are dealt into blocks of about `block` pieces by a hash, and every block is packed by several islands.

A chromosome is a packing. Crossover takes whole well-filled bins of one parent into the other, removes the bins that hold
the same pieces, and best-fits the pieces these displaced. Islands of a block start from random orders; between epochs the
elite of each goes to the next island by a shuffle. A block whose elite has as few bins as its tokens need is done. Pieces in
bins that are left half empty meet those of other blocks on a next level.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import Memory, in_bytes, partitions_for, remove, store, texts, tidy

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words, and pieces of words, whose ids a worker remembers.
REMEMBERED = 250_000
#: Bytes of text that a task takes from Arrow at a time.
SLICE = 4_000_000


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of texts as the tokenizer gives them, 4 bytes each, piece by piece with a memory.

    Right only for a tokenizer that drops white space, lets nothing cross it, and lower-cases. Text of printable ASCII,
    ASCII white space and Latin letters falls into the tokenizer's own pieces here; only a piece not met before goes through
    its model. Of other texts, the words between ASCII white space are normalised and cut by the tokenizer. Texts with the
    string of a special token are encoded whole.
    """

    LATIN = "à-öø-ÿß"
    #: What no step of the tokenizer changes but for the case.
    PLAIN = re.compile("[\x09-\x0d\x20-~À-ÖØ-öø-ÿ]*")
    PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z0-9{LATIN}]+")

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.pieces = Memory(self.word, REMEMBERED), Memory(self.piece, REMEMBERED)

    def whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, np.uint32).tobytes()

    def model(self, piece: str) -> bytes:
        """Ids of what the tokenizer has cut."""
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(piece)])

    def cut(self, text: str) -> bytes:
        return b"".join([self.model(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)])

    def piece(self, piece: str) -> bytes:
        """Bytes beyond ASCII have letters of their own in the model, which the tokenizer's cut gives them."""
        return self.model(piece) if piece.isascii() else self.cut(piece)

    def word(self, word: str) -> bytes:
        return self.cut(self.tokenizer.normalizer.normalize_str(word))

    def encode(self, text: bytes) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        known = text.decode("utf-8", "replace")
        if self.PLAIN.fullmatch(known):
            return b"".join(map(self.pieces.__getitem__, self.PIECES.findall(known.lower())))
        return b"".join([self.words[w.decode("utf-8", "replace")] for w in text.split()])


@cache
def _encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker."""
    return WordEncoder(path)


def _cut(path: str, capacity: int, closing: int):
    end = np.array([closing], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        names = [x.split()[0] for x in PIECES.split(", ")]
        for b in (part for whole in batches for part in in_bytes(whole, "text", SLICE)):
            rows: list[tuple] = []
            for uid, doc_id, text in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True):
                ids = encoder.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((uid, doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names)

    return run


# A chromosome is a packing: the bin of each piece of a block, and how full each bin is.

Packing = tuple[np.ndarray, np.ndarray]


def best_fit(lengths: np.ndarray, order, capacity: int, of: np.ndarray, fill: list[int]) -> Packing:
    """Each piece of order goes to the fullest bin that has room for it, else to a new one; of and fill are what is packed
    already, and are changed."""
    room = sorted((capacity - f, k) for k, f in enumerate(fill) if f < capacity)
    for i, n in zip(order, lengths[order].tolist(), strict=True):
        at = bisect_left(room, (n, -1))
        if at == len(room):
            of[i] = len(fill)
            fill.append(n)
            insort(room, (capacity - n, len(fill) - 1))
        else:
            left, k = room.pop(at)
            of[i] = k
            fill[k] += n
            if left > n:
                insort(room, (left - n, k))
    return of, np.array(fill, np.int64)


def founded(lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """A first chromosome: the pieces in a random order, each to the bin it fits best."""
    return best_fit(lengths, rng.permutation(len(lengths)).tolist(), capacity, np.zeros(len(lengths), np.int32), [])


def fitness(packing: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those that are filled unevenly (so that one can be emptied)."""
    return -len(packing[1]), float(((packing[1] / capacity) ** 2).sum())


def crossover(lengths: np.ndarray, mine: Packing, other: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """Inject whole well-filled bins of other into mine, take out the bins that hold any of their pieces, and best-fit
    the pieces that lost their bin. A few of the emptiest bins and some others that aren't full are opened too, so that the
    child can have one less."""
    (of, fill), (other_of, other_fill) = mine, other
    good = np.flatnonzero(other_fill >= 0.99 * capacity)
    if not len(good):
        good = np.argsort(-other_fill, kind="stable")[: max(1, len(other_fill) // 4)]
    chosen = rng.choice(good, int(rng.integers(1, len(good) + 1)), replace=False)
    place = np.full(len(other_fill), -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    injected = place[other_of] >= 0
    gone = np.zeros(len(fill), bool)
    gone[of[injected]] = True
    kept = np.flatnonzero(~gone)
    gone[kept[np.argsort(fill[kept], kind="stable")[: int(rng.integers(1, 9))]]] = True
    loose = np.flatnonzero(~gone & (fill < capacity))
    gone[rng.choice(loose, min(len(loose), int(rng.integers(1, 65))), replace=False)] = True
    number = np.cumsum(~gone) - 1
    child = np.where(injected, place[other_of] + number[-1] + 1, number[of]).astype(np.int32)
    displaced = np.flatnonzero(gone[of] & ~injected)
    order = displaced[np.argsort(-lengths[displaced], kind="stable")]
    return best_fit(lengths, order.tolist(), capacity, child, [*fill[~gone].tolist(), *other_fill[chosen].tolist()])


def evolve(lengths: np.ndarray, population: list[Packing], capacity: int, generations: int, rng: np.random.Generator, size: int) -> tuple[list[Packing], int]:
    """The best `size` chromosomes, best first, and the generations that were run. It ends early at the fewest bins that
    the pieces' tokens allow."""
    least, run = -(-int(lengths.sum()) // capacity), 0
    scored = sorted(((fitness(p, capacity), -k, p) for k, p in enumerate(population)), key=lambda x: x[:2], reverse=True)
    for run in range(1, generations + 1):
        if len(scored[0][2][1]) <= least:
            return [p for *_, p in scored[:size]], run - 1
        a, b = rng.choice(len(scored), 2, replace=len(scored) < 2)
        child = crossover(lengths, scored[min(a, b)][2], scored[max(a, b)][2], capacity, rng)
        scored = sorted([*scored, (fitness(child, capacity), -len(population) - run, child)], key=lambda x: x[:2], reverse=True)[: max(size, 2)]
    return [p for *_, p in scored[:size]], run


STATE = "block long, island int, lengths binary, packings array<binary>, elite binary, bins int, founded int, least int, generations int, done boolean"


def _packed(of: np.ndarray) -> bytes:
    return of.astype(np.int32).tobytes()


def _unpacked(raw: bytes, lengths: np.ndarray) -> Packing:
    of = np.frombuffer(raw, np.int32)
    return of, np.bincount(of, weights=lengths).astype(np.int64)


def _state(block: int, island: int, lengths: np.ndarray, population: list[Packing], capacity: int, first: int, generations: int) -> dict:
    best, least = population[0], -(-int(lengths.sum()) // capacity)
    return {
        "block": block, "island": island, "lengths": lengths.astype(np.int64).tobytes(), "packings": [_packed(of) for of, _ in population],
        "elite": _packed(best[0]), "bins": len(best[1]), "founded": first, "least": least, "generations": generations, "done": len(best[1]) <= least,
    }


def _found(capacity: int, population: int, island_count: int):
    """The first population of every island of a block, from random orders."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["uid", "piece"], kind="stable")
        block, lengths, rows = int(pdf["block"].iloc[0]), pdf["length"].to_numpy(), []
        for island in range(island_count):
            rng = np.random.default_rng([block, island])
            first = sorted((founded(lengths, capacity, rng) for _ in range(population)), key=lambda p: fitness(p, capacity), reverse=True)
            rows.append(_state(block, island, lengths, first, capacity, len(first[0][1]), 0))
        return pd.DataFrame(rows)

    return run


def _epoch(capacity: int, generations: int, epoch: int):
    """One island's epoch: its own state and the elite that came from its neighbour."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf[pdf["packings"].notna()].iloc[0]
        block, island, lengths = int(home["block"]), int(home["island"]), np.frombuffer(home["lengths"], np.int64)
        population = [_unpacked(p, lengths) for p in [*home["packings"], *pdf[pdf["packings"].isna()]["elite"]]]
        best, more = evolve(lengths, population, capacity, generations, np.random.default_rng([block, island, epoch]), len(home["packings"]))
        return pd.DataFrame([_state(block, island, lengths, best, capacity, int(home["founded"]), int(home["generations"]) + more)])

    return run


PLACED = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, block long, bin int, fill long, offset long"


def _place(pdf: pd.DataFrame) -> pd.DataFrame:
    pieces = pdf[pdf["elite"].isna()].sort_values(["uid", "piece"], kind="stable").copy()
    of, fill = _unpacked(pdf[pdf["elite"].notna()]["elite"].iloc[0], pieces["length"].to_numpy())
    order = np.argsort(of, kind="stable")
    lengths = pieces["length"].to_numpy()[order]
    before, first = np.cumsum(lengths) - lengths, np.r_[True, np.diff(of[order]) > 0]
    offset = np.empty(len(of), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    pieces["bin"], pieces["fill"], pieces["offset"] = of, fill[of], offset
    return pieces[[c.split()[0] for c in PLACED.split(", ")]].astype({"doc_id": "Int64"})


class Packer:
    def __init__(self, capacity: int, block: int, islands: int, population: int, epochs: int, generations: int):
        self.capacity, self.block, self.islands, self.population, self.epochs, self.generations = capacity, block, islands, population, epochs, generations

    def evolved(self, rest: DataFrame, blocks: int) -> tuple[DataFrame, str]:
        """The islands' last state: founded, then evolved for some epochs with elites that migrate by a shuffle."""
        lengths = rest.select("block", "uid", "piece", "length")
        state, path = store(lengths.groupBy("block").applyInPandas(_found(self.capacity, self.population, self.islands), STATE), "islands")
        parts = partitions_for(rest.sparkSession, blocks * self.islands, 16)
        none = {"lengths": "binary", "packings": "array<binary>"}
        for epoch in range(self.epochs):
            if state.where("not done").isEmpty():
                break
            # What is done gives its elite on and stays as it is.
            migrants = state.withColumns({"island": F.pmod(F.col("island") + 1, F.lit(self.islands)), **{c: F.lit(None).cast(t) for c, t in none.items()}})
            moved = state.unionByName(migrants).repartition(parts, "block", "island")
            new, new_path = store(moved.groupBy("block", "island").applyInPandas(_epoch(self.capacity, self.generations, epoch), STATE), "islands")
            remove(rest.sparkSession, path)
            state, path = new, new_path
        return state, path

    def placed(self, rest: DataFrame, n: int, level: int) -> tuple[DataFrame, DataFrame]:
        """rest's pieces with block, bin, fill and offset; and a row per block on how its packing came about."""
        blocks = max(1, round(n / self.block))
        rest = rest.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "uid", "piece"), F.lit(blocks)))
        state, path = self.evolved(rest, blocks)
        best = state.groupBy("block").agg(F.min_by("elite", F.struct("bins", "island")).alias("elite"))
        empty = {c: F.lit(None).cast(t) for c, t in rest.dtypes if c != "block"}
        both = rest.withColumn("elite", F.lit(None).cast("binary")).unionByName(best.select("block", "elite", *(v.alias(c) for c, v in empty.items())))
        out, _ = store(both.groupBy("block").applyInPandas(_place, PLACED), "placed")
        story = state.groupBy("block").agg(F.min("founded").alias("founded"), F.min("bins").alias("packed"), F.first("least").alias("least"), F.sum("generations").alias("generations"))
        story, _ = store(story.select(F.lit(level).alias("level"), "*"), "story")
        remove(rest.sparkSession, path)
        return out, story


def pack_with_story(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text",
    block: int = 8192, islands: int = 3, population: int = 4, epochs: int = 4, generations: int = 25, well_filled: float = 0.98,
) -> tuple[DataFrame, DataFrame]:
    """What pack() gives, and a row per block: level, block, founded (the fewest sequences of its first chromosomes), packed
    (of its last), least (that its tokens allow), generations (of all its islands).

    Blocks hold about `block` pieces whatever the table's size. When all blocks of a level are packed, the sequences that
    are less than `well_filled` give up their pieces, which are dealt into the blocks of the next level, until a level has
    one block, or most of its pieces would go on: then what it packed stays.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    pieces, _ = store(rows.mapInArrow(tidy(_cut(tokenizer, capacity, closing)), PIECES), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, story, level = pieces.where(F.col("length") < capacity), None, 0
    n, packer = rest.count(), Packer(capacity, block, islands, population, epochs, generations)
    while n:
        placed, told = packer.placed(rest, n, level)
        story = told if story is None else story.unionByName(told)
        loose = F.col("fill") < well_filled * capacity
        left = 0 if round(n / block) <= 1 else placed.where(loose).count()
        if left > n // 2:
            left = 0
        stays = placed.where(~loose) if left else placed
        # A level's sequences have numbers of their own: the level in the highest bits, then the block, then the bin.
        name = F.lit(level).cast("long") * F.lit(1 << 58) + F.col("block") * F.lit(1 << 26) + F.col("bin")
        out = out.unionByName(stays.select(*columns, name.alias("sequence_id"), "offset"))
        rest, n, level = placed.where(loose).select([c.split()[0] for c in PIECES.split(", ")]), left, level + 1
    return out, docs.sparkSession.createDataFrame([], "level int, block long, founded int, packed int, least int, generations long") if story is None else story


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text", **genetic) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty and is the closing id alone. Rows with the same id, or with none, are packed each for
    itself, repeated rows too. Pieces of equal length are told apart by their rows. An empty table gives no rows. Other
    columns, whatever their names, are not read. Sequence ids: full pieces have ids below 0, others their level's, their
    block's and their bin's.
    """
    return pack_with_story(docs, tokenizer, capacity, closing, id_col, text_col, **genetic)[0]
