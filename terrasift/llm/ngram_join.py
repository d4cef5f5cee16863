"""All pairs of documents whose sets of word n-grams are similar, as a blocked sparse matrix product.

The matrix has a row per distinct set and a column per n-gram; the product of it with its transpose holds each pair's
overlap. A row's columns are ordered by how rare they are. What two rows share in all but their last ceil(t * n) - 1 columns
is accumulated first: rows that share none there cannot reach their bound, and a pair goes as soon as what it shares and what
is left of the smaller of its rows cannot reach it either. That part of the product is formed in column blocks, each of which
gives partial overlaps of the rows that meet in it; the partial overlaps are summed over the blocks. The pairs that remain are
dealt into tiles of rows by rows. A tile's product is accumulated from column block to column block, and a pair is given up
between two blocks once the columns left cannot lift it to its bound.

Rarity is a number per column: how often any of the columns with the same leading bits of their hash occur. It's a
table of fixed size, counted over all documents, and any order of columns gives the same result. However many columns there
are, those that stand out against the mean of the table come last; among the rest, which are rare all the same, order says little.

Groups: equal sets are one row, so copies cost nothing. A column that more than `MEET` rows share is not multiplied out: its
rows are first held only against one of them; rows that this links needn't be held against each other, and only pairs between
what is not yet linked follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import give_back, in_bytes, remove, store, texts, tidy, unused
from terrasift.llm.graph import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Leading bits of a column's hash that its rarity is counted by, and the parts that the table is summed in.
RARITY_BITS, SLICES = 20, 64
STEP = np.uint64(0x9E3779B97F4A7C15 | 5)
#: Rows that share a column are all held against each other up to so many.
MEET = 64
#: Column blocks of a tile's product (a power of two), and pairs and bytes of rows that a tile is given on average.
BLOCKS, TILE_PAIRS, TILE_BYTES = 8, 20_000, 24_000_000


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: equal input, equal output; otherwise as good as random."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse modulo 2**64."""
    inverse = pow(int(STEP), -1, 2**64)
    up, down = np.full(n, STEP), np.full(n, np.uint64(inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64), 99)


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lowered, split at ASCII white space; and where each text's words begin
    (one more bound than texts)."""
    low = [t.translate(LOWER) for t in docs]
    raw = np.frombuffer(b" ".join([b"", *low, b""]), np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in low]) if low else np.zeros(0, np.int64)
    size = 1 << max(16, int(len(raw)).bit_length())
    up, down = _powers(size)
    space = SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, stops = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_byte_values()[raw] * up[: len(raw)], out=total[1:])
    value = (total[stops] - total[starts]) * down[starts]
    bounds = np.searchsorted(starts, np.r_[0, ends_at])
    return mix(value + (stops - starts).astype(np.uint64)), bounds


def sets(docs: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets of n-gram hashes, each sorted, one after the other, and where each begins. A text of fewer words
    has all of them as its only one; a text without words has an empty set."""
    value, bounds = word_hashes(docs)
    factor = mix(np.arange(n, dtype=np.uint64), 5) | np.uint64(1)
    gram = np.zeros(max(len(value) - n + 1, 0), np.uint64)
    for k in range(n):
        gram += value[k : k + len(gram)] * factor[k]
    gram = mix(gram, 1)
    parts, at = [], 0
    begin = np.zeros(len(docs) + 1, np.int64)
    for i in range(len(docs)):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= n:
            s = np.sort(gram[a : b - n + 1])
            s = s[np.r_[True, s[1:] != s[:-1]]]
        elif b > a:
            s = mix((value[a:b] * factor[: b - a]).sum(keepdims=True, dtype=np.uint64), 1 + b - a)
        else:
            s = value[:0]
        parts.append(s)
        at += len(s)
        begin[i + 1] = at
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), begin


def _keys(column: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    out = []
    for seed in (11, 12):
        total = np.r_[np.uint64(0), np.cumsum(mix(column, seed), dtype=np.uint64)]
        out.append(mix(total[begin[1:]] - total[begin[:-1]], seed).view(np.int64))
    return out[0], out[1]


def _slices(batches, n: int, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for batch in in_bytes(whole, "text", limit):
            yield batch, *sets(texts(batch.column("text")), n)


def _rarity(docs: DataFrame, n: int, limit: int) -> np.ndarray:
    """How often columns occur, by the leading bits of their hash, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << RARITY_BITS, np.int64)
        for _, column, _ in _slices(batches, n, limit):
            table += np.bincount((column >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(table))
        if table.any():
            salt = int(np.random.default_rng().integers(0, 256))
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([salt] * SLICES, pa.int32()), pa.array([x.tobytes() for x in np.split(table, SLICES)], pa.binary())], ["slice", "salt", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        total = np.zeros((1 << RARITY_BITS) // SLICES, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, np.int64)
        out["counts"] = [total.tobytes()]
        return out

    schema = "slice int, salt int, counts binary"
    parts = docs.mapInArrow(tidy(count), schema).groupBy("slice", "salt").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
    table = np.zeros(1 << RARITY_BITS, np.int64)
    for r in parts.collect():  # SLICES rows of 128 kB
        width = len(table) // SLICES
        table[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(table, 2**31 - 1).astype(np.int32)


SKETCH = "uid long, doc_id long, n long, k1 long, k2 long, first array<long>"


def _sketch(rarity, n: int, percent: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rarity.value
        for batch, column, begin in _slices(batches, n, limit):
            size = np.diff(begin)
            k1, k2 = _keys(column, begin)
            often = table[(column >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
            need = size - -(-percent * size // 100) + 1
            need[size == 0] = 0
            first = [column[a:b][np.argsort(often[a:b], kind="stable")[:p]] for a, b, p in zip(begin[:-1].tolist(), begin[1:].tolist(), need.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(need)].astype(np.int32)), pa.array(np.concatenate(first).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(size), pa.array(k1), pa.array(k2), lists], [x.split()[0] for x in SKETCH.split(", ")])

    return run


def _whole_sets(n: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, column, begin in _slices(batches, n, limit):
            k1, k2 = _keys(column, begin)
            some = np.flatnonzero(np.diff(begin) > 0)
            raw = [column[begin[i] : begin[i + 1]].tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(k1[some]), pa.array(k2[some]), pa.array(raw, pa.binary())], ["k1", "k2", "members"])

    return run


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The overlap from which two sets of these sizes are similar."""
    return -(-percent * (na + nb) // (100 + percent))


def block_product(column: np.ndarray, row: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The product of a column block with its transpose, above the diagonal: a, b, their sizes, and their overlap in it.
    Entries are sorted by column; pairs whose sizes rule the similarity out are not formed."""
    parts = []
    begin = np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) if len(column) else np.zeros(0, np.int64)
    longest = int(np.diff(np.r_[begin, len(column)]).max(initial=0))
    for d in range(1, longest):
        i = np.flatnonzero(column[d:] == column[:-d])
        if not len(i):
            break
        i = i[100 * np.minimum(size[i], size[i + d]) >= percent * np.maximum(size[i], size[i + d])]
        parts.append((i, i + d))
    i, j = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    swap = row[i] > row[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    order = np.lexsort((row[j], row[i]))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.r_[True, (row[i][1:] != row[i][:-1]) | (row[j][1:] != row[j][:-1])]) if len(i) else np.zeros(0, np.int64)
    return row[i[first]], row[j[first]], size[i[first]], size[j[first]], np.diff(np.r_[first, len(i)])


def _block_products(percent: int):
    """Partial overlaps of rows sorted by column; a batch's last column waits for the rest of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        names = ["a", "b", "na", "nb", "shared"]

        def out(entries: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in block_product(*entries, percent)], names)

        for b in batches:
            held = [np.concatenate((h, b.column(c).to_numpy())) for h, c in zip(held, ("column", "rep", "n"), strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole:
                yield out([h[:whole] for h in held])
                held = [h[whole:] for h in held]
        yield out(held)

    return run


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each start to its stop, and which of them each belongs to."""
    n = stop - start
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which], which


def tile_product(i: np.ndarray, j: np.ndarray, column: np.ndarray, begin: np.ndarray, percent: int, most: int = 2_000_000) -> np.ndarray:
    """Which pairs (i, j) of rows are similar. Row r has the sorted columns column[begin[r]:begin[r + 1]]. Overlaps are
    accumulated over BLOCKS column blocks, and pairs that can't reach their bound any more are dropped between two."""
    n = np.diff(begin)
    need, found, live = needed(n[i], n[j], percent), np.zeros(len(i), np.int64), np.arange(len(i))
    row = np.repeat(np.arange(len(n)), n)
    block = (column >> np.uint64(64 - BLOCKS.bit_length() + 1)).astype(np.int64)
    per = np.bincount(row * BLOCKS + block, minlength=len(n) * BLOCKS).reshape(len(n), BLOCKS)
    cut = begin[:-1, None] + np.c_[np.zeros(len(n), np.int64), np.cumsum(per, axis=1)]
    name = np.unique(column, return_inverse=True)[1].astype(np.int64)  # below 2 ** 31 in a tile
    for k in range(BLOCKS):
        left = np.minimum(begin[i[live] + 1] - cut[i[live], k], begin[j[live] + 1] - cut[j[live], k])
        live = live[found[live] + left >= need[live]]
        work = per[i[live], k] + per[j[live], k]
        parts = np.searchsorted(np.cumsum(work), np.arange(most, int(work.sum()) + most, most), side="left") + 1
        for p in np.split(live, parts[:-1]):
            both = []
            for side in (i[p], j[p]):
                place, which = _ranges(cut[side, k], cut[side, k + 1])
                both.append((which << 32) | name[place])
            key = np.sort(np.concatenate(both))
            found[p] += np.bincount((key[1:][key[1:] == key[:-1]]) >> 32, minlength=len(p))
    out = np.zeros(len(i), bool)
    out[live] = found[live] >= need[live]
    return out


def _tile(percent: int):
    def run(pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rep").sort_values("rep")
        members = [np.frombuffer(x, np.uint64) for x in rows["members"]]
        begin = np.r_[0, np.cumsum([len(m) for m in members])].astype(np.int64)
        at = [np.searchsorted(rows["rep"].to_numpy(), pairs[c].to_numpy()) for c in ("a", "b")]
        good = tile_product(*at, np.concatenate(members) if members else np.zeros(0, np.uint64), begin, percent)
        give_back()
        return pairs.loc[good, ["a", "b"]]

    return run


class Join:
    """The steps of one join; they share the sketch of the documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, slice_bytes: int = 1_000_000, broadcast_rows: int = 400_000, meet: int = MEET):
        self.n, self.percent, self.limit, self.broadcast_rows, self.meet, self.spark = n, percent, slice_bytes, broadcast_rows, meet, docs.sparkSession
        self.scratch: list[str] = []
        self.docs = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
        table = docs.sparkSession.sparkContext.broadcast(_rarity(self.docs.select("text"), n, slice_bytes))  # 4 MB
        self.sketch = self.keep(self.docs.mapInArrow(tidy(_sketch(table, n, percent, slice_bytes)), SKETCH), "sketch")
        self.classes = self.keep(
            self.sketch.where("n > 0").groupBy("k1", "k2").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("lowest"), F.count("*").alias("copies")), "classes"
        )

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        df, path = store(df, what)
        self.scratch.append(path)
        return df

    def close(self) -> None:
        """Delete the tables; what was made of them must have been written."""
        remove(self.spark, *self.scratch)
        self.scratch = []

    def bounded(self, ni, pi, nj, pj):
        """The pair's sizes allow the similarity, and so do the columns from the shared one on."""
        t = self.percent
        least = F.ceil(F.lit(t) * (ni + nj) / F.lit(100 + t))
        return (100 * F.least(ni, nj) >= t * F.greatest(ni, nj)) & (F.least(ni - pi, nj - pj) >= least)

    def shared_columns(self) -> DataFrame:
        """column, rep, n, pos, rows, head: the rare columns of the distinct sets that more than one has among its own, with
        how many have it and the first of these. Counts are reduced before the shuffle, so that a column of very many rows
        is a join's skewed key, which Spark splits, and no task's group."""
        reps = self.sketch.join(self.classes.select(F.col("rep").alias("uid")), "uid", "left_semi")
        entries = reps.select(F.col("uid").alias("rep"), "n", F.posexplode("first").alias("pos", "column"))
        heads = entries.groupBy("column").agg(F.count("*").alias("rows"), F.min("rep").alias("head")).where("rows > 1")
        return entries.join(heads, "column")

    def accumulated(self, shared: DataFrame) -> DataFrame:
        """a, b: pairs that meet in columns of few rows and can still reach their bound after all of these."""
        t = self.percent
        few, many = shared.where(F.col("rows") <= self.meet), shared.where(F.col("rows") > self.meet)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        partial = few.select("column", "rep", "n").repartition(parts, "column").sortWithinPartitions("column").mapInArrow(tidy(_block_products(t)), "a long, b long, na long, nb long, shared long")
        pairs = partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
        # Columns of many rows weren't multiplied: at most as many more as either row has.
        unseen = many.groupBy("rep").agg(F.count("*").alias("h"))
        pairs = pairs.join(unseen.select(F.col("rep").alias("a"), F.col("h").alias("ha")), "a", "left").join(unseen.select(F.col("rep").alias("b"), F.col("h").alias("hb")), "b", "left")
        more = F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
        rest = F.ceil(F.lit(t) * F.greatest("na", "nb") / 100) - 1
        return pairs.where(F.col("shared") + more + rest >= F.ceil(F.lit(t) * (F.col("na") + F.col("nb")) / F.lit(100 + t))).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those pairs of reps whose sets are similar enough, by tiles."""
        sizes = self.sketch.select(F.col("uid").alias("rep"), "n", "k1", "k2")
        sides = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("times"))
        wanted = self.keep(sizes.join(sides, "rep"), "wanted")
        work = wanted.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.sum(8 * F.col("n") * F.col("times")), F.lit(0))).first()
        tiles = max(1, -(-work[1] // (2 * TILE_PAIRS)), -(-work[2] // TILE_BYTES))
        # By the row of the larger number, of which one of many pairs goes to several tiles.
        tile = F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.lit(16))), F.lit(tiles))
        dealt = self.keep(pairs.select("a", "b", tile.alias("tile")), "dealt")
        keys = wanted.select("k1", "k2", "rep")
        keys = F.broadcast(keys) if work[0] <= self.broadcast_rows else keys
        found = self.docs.select("text").mapInArrow(tidy(_whole_sets(self.n, self.limit)), "k1 long, k2 long, members binary").join(keys, ["k1", "k2"])
        members = self.keep(found.groupBy("rep").agg(F.first("members").alias("members")), "members")
        place = dealt.select("tile", F.col("a").alias("rep")).unionByName(dealt.select("tile", F.col("b").alias("rep"))).distinct()
        rows = members.join(place, "rep").select(F.col("tile").alias("of_tile"), "rep", "members")
        return dealt.groupBy("tile").cogroup(rows.groupBy("of_tile")).applyInPandas(_tile(self.percent), "a long, b long")

    def links(self, every: bool = False) -> tuple[DataFrame, DataFrame]:
        """Edges between reps that connect all that similar pairs connect (with every: all similar pairs), and their
        components."""
        shared = self.keep(self.shared_columns(), "shared")
        many = shared.where(F.col("rows") > self.meet)
        heads = many.where("rep = head").select("column", F.col("n").alias("n0"), F.col("pos").alias("p0"))
        star = many.where("rep != head").join(heads, "column").where(self.bounded(F.col("n0"), F.col("p0"), F.col("n"), F.col("pos")))
        star = self.keep(star.select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
        edges = self.keep(self.verified(star), "links")
        roots = components(edges, self.scratch)

        # Pairs between what is not linked yet.
        def labelled(df: DataFrame, rep: str, label: str) -> DataFrame:
            of = roots.select(F.col("node").alias(rep), F.col("root").alias("__root"))
            return df.join(of, rep, "left").withColumn(label, F.lit(None).cast("long") if every else F.coalesce("__root", rep)).drop("__root")

        apart = (F.col("i.rep") < F.col("j.rep")) if every else (F.col("i.label") < F.col("j.label"))
        mixed = labelled(many.select("column", "rep", "n", "pos"), "rep", "label")
        if not every:
            spread = mixed.groupBy("column").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("column")
            mixed = mixed.join(spread, "column", "left_semi")
        mixed = self.keep(mixed, "mixed")
        meet = (F.col("i.column") == F.col("j.column")) & apart & self.bounded(F.col("i.n"), F.col("i.pos"), F.col("j.n"), F.col("j.pos"))
        rest = mixed.alias("i").join(mixed.alias("j"), meet).select(F.least("i.rep", "j.rep").alias("a"), F.greatest("i.rep", "j.rep").alias("b"))
        cold = self.accumulated(shared)
        if not every:
            cold = labelled(labelled(cold, "a", "la"), "b", "lb").where("la != lb").select("a", "b")
        pairs = self.keep(rest.unionByName(cold).distinct().join(star, ["a", "b"], "left_anti").select("a", "b"), "pairs")
        more = self.keep(self.verified(pairs), "links")
        edges = edges.unionByName(more)
        return edges, roots if more.isEmpty() else components(edges, self.scratch)


def similar_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """Per row: uid, doc_id, n_shingles, component_id, first (whether it is the row of its component that stays).

    Two texts are linked when 100 * |A & B| >= percent * |A | B| for their sets of n-word shingles; component_id is the
    smallest id that links lead to. Null text and text without words have an empty set and are linked with nothing.
    Rows with equal texts are linked; rows that repeat an id, or have none, are rows of their own, and null is the
    component of rows of which none has an id. Of each component the row with the smallest id, the earliest of
    several, stays. An empty table gives no rows. Other columns are not read.
    """
    join = Join(docs, id_col, text_col, n, percent, **bounds)
    _, roots = join.links()
    whole = join.classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    linked = whole.where("copies > 1").unionByName(whole.where("copies = 1").join(roots.select(F.col("node").alias("rep")), "rep", "left_semi"))
    linked = join.keep(linked.select("k1", "k2", "root", "lowest"), "linked")
    lowest = linked.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = linked.join(lowest, "root").select("k1", "k2", "root", "component_id")
    sketch = join.sketch.select("uid", "doc_id", "n", "k1", "k2")
    out = sketch.join(named, ["k1", "k2"], "left").withColumn("root", F.when(F.col("n") > 0, F.col("root")))
    out, _ = store(out.select(
        "uid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root"
    ), "components")
    join.close()
    return out


def similar_pairs(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **bounds) -> tuple[DataFrame, DataFrame]:
    """Every similar pair of different sets (a, b: their classes), and of each row of docs its class and its links:
    doc_id, class (null for texts without words, which have no links), n_links (rows it is similar to, copies included)."""
    join = Join(docs, id_col, text_col, n, percent, **bounds)
    edges, _ = join.links(every=True)
    pairs, _ = store(edges.distinct(), "similar")
    copies = join.classes.select("rep", "copies")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(copies.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    classes = join.classes.join(others, "rep", "left").select("k1", "k2", F.col("rep").alias("class"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = join.sketch.select("doc_id", "k1", "k2", "n").join(classes, ["k1", "k2"], "left")
    rows, _ = store(rows.select("doc_id", F.when(F.col("n") > 0, F.col("class")).alias("class"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).alias("n_links")), "members")
    join.close()
    return pairs, rows


def one_of_each(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """The documents, with all their columns, without those that are linked with one of a smaller id (null counts as
    largest; of equal ids the earliest row stays). Cases as in similar_components; documents without words stay."""
    uid = unused(docs.columns, "row")
    rows, _ = store(docs.withColumn(uid, F.monotonically_increasing_id()), "documents")
    named = rows.select(F.col(uid).alias("uid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = similar_components(named.select(F.col("uid").alias("doc_id"), "text"), n, percent, **bounds).where("root is not null").select(F.col("doc_id").alias("uid"), "root")
    grouped = named.select("uid", F.col("id").cast("long").alias("id")).join(found, "uid")
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("f")).select("root", F.col("f.uid").alias("first"))
    drop = grouped.join(first, "root").where("uid != first").select(F.col("uid").alias(uid))
    return rows.join(drop, uid, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
