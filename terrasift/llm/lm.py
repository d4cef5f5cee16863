"""Scores texts with a causal self-attention model trained in numpy on subword ids.

Words, split at ASCII white space, are encoded with a public byte-level vocabulary. The model reads ids and gives the class of
the next one from what its window has before it: the most frequent ids are classes of their own, the others share classes by
the pairs they are counted in. Which id of its class follows is told by the id before it in its word, from counts of all pairs of ids in
training words, smoothed by the ids' shares of the class. A text's windows overlap, and each id is scored once.

All training documents add to the counts of words, ids and pairs, and all their ids are trained on, each once a round, in
windows end to end. Texts are dealt into shards by a hash and read in its order; a shard's windows train a copy of the
parameters, and the shards' parameters are averaged by their numbers of windows: how the table is stored makes no difference.
"""

from __future__ import annotations

import base64
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import replace
from functools import cache
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm import attention
from terrasift.llm.attention import Shape, start
from terrasift.llm.common import Memory, free, hold_heap, in_bytes, remove, store, texts, tidy

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Classes that ids share by the pairs they are in, and those of ids that are in none counted; words that a worker remembers.
CLUSTERS, OTHERS, REMEMBERED = 64, 4, 300_000
#: Ids that pairs are counted of, by frequency; the context of a word's first id; how much the class's shares weigh in pairs.
PAIRED, FIRST, SMOOTH = 2047, 65_535, 2.0
RAW = "kind string, key binary, n long"


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


class Subwords:
    """Ids of words as two bytes each, with a memory."""

    def __init__(self, path: str, pattern: str):
        self.encoding, ranks = _encoding(path, pattern)
        self.end, self.known = len(ranks), Memory(self.word, REMEMBERED)
        self.spaced = np.zeros(self.end + 1, bool)
        self.wide = np.zeros(self.end + 1, bool)
        for token, i in ranks.items():
            self.spaced[i], self.wide[i] = token[:1] == b" ", max(token) > 127

    def word(self, word: bytes) -> bytes:
        return array("H", self.encoding.encode_ordinary(" " + word.decode("utf-8", "replace"))).tobytes()

    def encode(self, ws: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, ws)), np.uint16)


@cache
def _subwords(path: str, pattern: str) -> Subwords:
    return Subwords(path, pattern)


def split(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _gather(memory: int = 400_000):
    """Counts of words and of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: str, keys: list[bytes], n: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array(n, pa.int64())], ["kind", "key", "n"])

        count: Counter = Counter()
        for b in batches:
            for text in texts(b.column("text")):
                count.update(split(text))
            yield out("end", [b""], [b.num_rows])
            if len(count) > memory:
                yield out("word", list(count), list(count.values()))
                count = Counter()
        if count:
            yield out("word", list(count), list(count.values()))

    return run


def _count_pairs(path: str, pattern: str):
    """Counts of pairs of ids that follow each other in a word, from counts of words; FIRST stands before a word's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = _subwords(path, pattern)
        for b in batches:
            ids = [np.frombuffer(sub.word(w), np.uint16) for w in b.column("key").to_pylist()]
            pairs = np.concatenate([np.r_[np.uint16(FIRST), x[:-1]].astype(np.int64) << 16 | x for x in ids]) if ids else np.zeros(0, np.int64)
            pair, which = np.unique(pairs, return_inverse=True)
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, which, np.repeat(b.column("n").to_numpy(), [len(x) for x in ids]))
            yield pa.RecordBatch.from_arrays([pa.array(pair >> 16), pa.array(pair & 65_535), pa.array(n)], ["before", "id", "n"])

    return run


def grouped(counts: np.ndarray, k: int, dims: int = 24, rounds: int = 25, seed: int = 5) -> np.ndarray:
    """Rows in k groups by what they are counted with: k-means over the leading dimensions of how much more often than by
    chance (in logarithms) that is."""
    rng, total = np.random.default_rng(seed), max(counts.sum(), 1)
    expected = counts.sum(axis=1, keepdims=True) * counts.sum(axis=0, keepdims=True) / total
    x = np.log1p(np.maximum(counts / np.maximum(expected, 1e-9) - 1, 0)) * (counts > 0)
    q = np.linalg.qr(x.T @ rng.normal(size=(len(x), dims)))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    x = x @ q
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    weight = np.sqrt(counts.sum(axis=1) + 1)
    middle = x[[0]]
    for _ in range(1, k):  # far from the ones before
        middle = np.r_[middle, x[[int(np.argmax(weight * (1 - (x @ middle.T).max(axis=1))))]]]
    for _ in range(rounds):
        of = (x @ middle.T).argmax(axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, of, x * weight[:, None])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        middle = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), middle)
    return of


class Classes:
    """Ids' classes, their inputs to the model, and the natural log of an id's probability in its class after another id."""

    def __init__(self, counts: np.ndarray, pairs: list[tuple[int, int, int]], sub: Subwords, shape: Shape):
        weight, classes = counts + 0.5, shape.classes
        own = classes - CLUSTERS - OTHERS
        order = np.argsort(-weight, kind="stable")
        if (at := int(np.flatnonzero(order == sub.end)[0])) >= own:  # the end is a class of its own
            order = np.r_[sub.end, np.delete(order, at)]
        # The table: a row per id before (the last is FIRST), a column per id; rarer ones have their share alone.
        self.rank = np.full(65_536, PAIRED, np.int64)
        self.rank[order[:PAIRED]] = np.arange(min(PAIRED, len(order)))
        first = PAIRED + 1
        self.rank[FIRST] = first
        table = np.zeros((first + 1, PAIRED + 1))
        for a, b, n in pairs:
            table[self.rank[a], self.rank[b]] += n
        table[PAIRED] = table[:, PAIRED] = 0
        self.of = (own + CLUSTERS + sub.spaced * 2 + sub.wide).astype(np.uint16)
        shared = order[own:PAIRED]
        self.of[shared] = own + grouped(np.c_[table[:, :PAIRED].T, table[:PAIRED, :PAIRED]][own:PAIRED], CLUSTERS)[: len(shared)]
        self.of[order[:own]] = np.arange(own)
        total = np.bincount(self.of, weights=weight, minlength=classes)
        self.prior = total / total.sum()
        share = weight / total[self.of]
        self.within = np.log(share)
        ids = start(shape) - classes  # inputs: the most frequent ids, then classes
        self.input = (ids + self.of).astype(np.int64)
        self.input[order[:ids]] = np.arange(ids)
        column = np.r_[order[:PAIRED], np.zeros(max(0, PAIRED - len(order)), np.int64)]
        table, of = table[:, : len(order[:PAIRED])], self.of[order[:PAIRED]]
        in_class = np.zeros((first + 1, classes))
        np.add.at(in_class.T, of, table.T)
        # What pairs with rarer ids would add to a class is left to the smoothing.
        self.table = np.full((first + 1, PAIRED + 1), np.nan, np.float32)
        self.table[:, : len(of)] = np.log((table + SMOOTH * share[column[: len(of)]]) / (in_class[:, of] + SMOOTH))
        self.lost = np.log(SMOOTH / (in_class + SMOOTH)).astype(np.float32)  # for the ids of a class that have no column

    def follows(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of each id's probability in its class, after the id before it in its word."""
        row, col = self.rank[before], self.rank[ids]
        return np.where(col < PAIRED, self.table[row, np.minimum(col, PAIRED - 1)], self.lost[row, self.of[ids]] + self.within[ids])


class Worth:
    """The sums of follows() over words' ids, with a memory."""

    def __init__(self, classes: Classes, sub: Subwords):
        self.classes, self.sub, self.known = classes, sub, {}

    def __call__(self, ws: list[bytes]) -> float:
        known = self.known
        new = [w for w in dict.fromkeys(ws) if w not in known]
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = list(dict.fromkeys(ws))
            raw = list(map(self.sub.known.__getitem__, new))
            size, row = np.array(list(map(len, raw))) // 2, np.frombuffer(b"".join(raw), np.uint16)
            first = np.cumsum(size) - size
            before = np.r_[np.uint16(0), row[:-1]]
            before[first] = FIRST
            known.update(zip(new, np.add.reduceat(self.classes.follows(before, row), first).tolist(), strict=True))
        return sum(map(known.__getitem__, ws))


def _windows(docs: list[bytes], sub: Subwords, of: np.ndarray, inputs: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and which of them are real, of whole texts: windows end to end, so that each id is a target once."""
    ids, bounds = [np.zeros(0, np.uint16)], [0]
    for text in docs:
        ids += [sub.encode(split(text)), np.array([sub.end], np.uint16)]
        bounds.append(bounds[-1] + len(ids[-2]) + 1)
    row, bounds = np.concatenate(ids), np.array(bounds)
    classes, none = of[row].astype(np.int64), start(shape)
    begin, _ = attention.windows(bounds, replace(shape, stride=shape.window))
    at = begin[:, None] + np.arange(shape.window)
    real = at < bounds[np.searchsorted(bounds, begin, side="right")][:, None]
    before = np.r_[none, inputs[row]]
    before[bounds[:-1]] = none  # a text's first position follows the start
    at = np.where(real, at, 0)
    return np.where(real, before[at], none), np.where(real, classes[at], 0), real


def _fit_shards(state, path: str, pattern: str, shape: Shape, steps: int, batch: int, rate: float, slice_bytes: int, most: int = 50_000):
    """Rows come sorted by shard; each shard begins with the parameters that were handed out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_heap()
        initial, of, inputs, epoch = state.value
        sub, shard, params, held, waiting, n = _subwords(path, pattern), None, initial, [], 0, 0

        def trained(p):
            return attention.train(p, *map(np.concatenate, zip(*held, strict=True)), batch=batch, rate=rate, seed=epoch, steps=steps)

        def out() -> pa.RecordBatch:
            flat = np.concatenate([params[k].ravel() for k in sorted(params)]).astype(np.float64) * n
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["shard", "n", "params"])

        for whole in batches:
            for b in in_bytes(whole, "text", slice_bytes):
                shards = b.column("shard").to_numpy()
                cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    if shard != int(shards[a]):
                        if shard is not None:
                            params, n = (trained(params), n + waiting) if waiting else (params, n)
                            yield out()
                        shard, params, held, waiting, n = int(shards[a]), initial, [], 0, 0
                    # Text by text, so that where a slice ends makes no difference.
                    for text in texts(b.column("text").slice(a, z - a)):
                        held.append(_windows([text], sub, of, inputs, shape))
                        waiting += len(held[-1][0])
                        if waiting >= most:
                            params, n = trained(params), n + waiting
                            held, waiting = [], 0
        if shard is not None:
            params, n = (trained(params), n + waiting) if waiting else (params, n)
            yield out()

    return run


def deal(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows by shard, sorted. A shard has a task of its own: by a hash of its number several would meet in one."""
    return rows.repartitionById(tasks, F.col("shard").cast("int")).sortWithinPartitions("shard", "h", "text")


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("shard")
    out = pdf.iloc[:1].copy()
    out["n"] = pdf["n"].sum()
    out["params"] = [sum(np.frombuffer(x) for x in pdf["params"]).tobytes()]
    return out


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<binary>"


def _score(state, path: str, pattern: str, shape: Shape, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_heap()
        params, classes, top, end_count, total, kinds = state.value
        sub, names = _subwords(path, pattern), [x.split()[0] for x in SCORED.split(", ")]
        worth, end_worth = Worth(classes, sub), float(classes.within[sub.end])
        unit = np.log10(total + kinds + 1.0)
        for whole in batches:
            for b in in_bytes(whole, "text", slice_bytes):
                ids, bounds, n_tokens, known, base, rare, said = [], [0], [], [], [], [], []
                for text in texts(b.column("text")):
                    ws = split(text)
                    ids += [sub.encode(ws), np.array([sub.end], np.uint16)]
                    bounds.append(bounds[-1] + len(ids[-2]) + 1)
                    said.append(worth(ws) + end_worth)
                    c = np.fromiter(map(top.get, ws, repeat(0)), np.int64, len(ws))
                    n_tokens.append(len(ws) + 1)
                    known.append(int((c > 0).sum()) + (end_count > 0))
                    base.append(float(np.log10(c[c > 0] + 1).sum() + np.log10(end_count + 1) - (len(ws) + 1) * unit))
                    rare.append([ws[i] for i in np.flatnonzero(c == 0).tolist()])
                row, bounds = np.concatenate(ids) if ids else np.zeros(0, np.uint16), np.array(bounds)
                natural = attention.score(params, classes.input[row], classes.of[row].astype(np.int64), bounds, shape)
                score = (np.add.reduceat(natural, bounds[:-1]) + said) / np.log(10) if len(bounds) > 1 else natural
                arrays = [b.column("uid"), b.column("doc_id"), b.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(rare, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def score_texts(
    docs: DataFrame, train: Column, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape(classes=96, inputs=1024 + 96, dims=24),
    top_words: int = 65_536, rounds: int = 1, steps: int = 300, batch: int = 64, rate: float = 0.01, shard_words: int = 2_000_000, slice_bytes: int = 1_000_000,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train is a condition on docs: its rows are learned from. A text's tokens are its words, A-Z lowered, and one end.
    base_score is the sum of log10((c + 1) / (N + V + 1)) over them, with c the token's count among all N training
    tokens, V of them different; n_known counts tokens with c > 0. score is the model's log10 probability of the words'
    ids and the end. Null text counts as empty and is the end alone. Rows that repeat ids or texts are rows of their own. If no row
    may be learned from, counts are 0 and the model is the untrained one. An empty table gives no rows. Other columns
    are not read. The same rows have the same scores, however the table is stored.
    A shard has about shard_words training words. The counts of the top_words most frequent words (of 64 bytes at most) are broadcast; the others' are joined.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    text = F.col(f"`{text_col}`").cast("binary").alias("text")
    learn = F.coalesce(train, F.lit(False))
    learned = docs.where(learn).select(text)
    raw, gathered = store(learned.mapInArrow(tidy(_gather()), RAW), "gathered")
    words = raw.where("kind = 'word'").groupBy("key").agg(F.sum("n").alias("n"))
    words, counted = store(words, "words")
    free(spark)
    ends = raw.where("kind = 'end'").agg(F.sum("n")).first()[0] or 0
    kinds, spoken = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, kinds = spoken + ends, kinds + (ends > 0)
    # The most frequent words by levels of their counts: only whole levels, together top_words at most, come to the driver.
    level = F.floor(16 * F.log2("n"))
    levels = sorted(((r["l"], r["c"]) for r in words.where(F.octet_length("key") <= 64).groupBy(level.alias("l")).agg(F.count("*").alias("c")).collect()), reverse=True)
    fits = [k for k, (_, so_far) in zip((x for x, _ in levels), accumulate(levels, lambda a, b: (b[0], a[1] + b[1])), strict=True) if so_far <= top_words]
    top = {bytes(r["key"]): r["n"] for r in words.where((F.octet_length("key") <= 64) & (level >= min(fits))).collect()} if fits else {}

    sub = _subwords(path, pattern)
    counts, paths = np.zeros(sub.end + 1, np.int64), [gathered, counted]
    pairs, path2 = store(words.mapInArrow(_count_pairs(path, pattern), "before long, id long, n long").groupBy("before", "id").agg(F.sum("n").alias("n")), "pairs")
    paths.append(path2)
    for r in pairs.groupBy("id").agg(F.sum("n").alias("n")).collect():  # as many rows as the vocabulary has at most
        counts[r["id"]] = r["n"]
    counts[sub.end] = ends
    # Pairs of the PAIRED most frequent ids alone make the table: a row per id before, of PAIRED pairs at most.
    common = F.broadcast(spark.createDataFrame([(int(i),) for i in np.argsort(-counts, kind="stable")[:PAIRED]], "id long"))
    few = pairs.join(common, "id").join(common.withColumnRenamed("id", "before").unionByName(spark.createDataFrame([(FIRST,)], "before long")), "before")
    listed = few.groupBy("before").agg(F.collect_list(F.struct("id", "n")).alias("after")).collect()
    classes = Classes(counts, [(r["before"], x["id"], x["n"]) for r in listed for x in r["after"]], sub, shape)
    params = attention.fresh(shape, classes.prior)

    shards = max(1, round(total / shard_words))
    hashed = F.xxhash64(F.col(f"`{id_col}`").cast("long"), text)
    dealt = docs.where(learn).select(F.pmod(hashed, F.lit(shards)).alias("shard"), hashed.alias("h"), text)
    dealt = deal(dealt, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards))
    for epoch in range(rounds):
        state = sc.broadcast((params, classes.of, classes.input, epoch))
        fitted = dealt.select("shard", "text").mapInArrow(tidy(_fit_shards(state, path, pattern, shape, steps, batch, rate / (1 + epoch), slice_bytes)), "shard long, n long, params binary")
        fitted, path2 = store(fitted, "fitted")
        sums = fitted.groupBy(F.pmod("shard", F.lit(max(1, int(shards**0.5)))).alias("salt")).applyInPandas(_add, "shard long, n long, params binary").collect()  # the root of the shards
        remove(spark, path2)
        if not sums:
            break
        sums = sorted(sums, key=lambda r: r["shard"])
        flat, at = sum(np.frombuffer(r["params"]) for r in sums) / sum(r["n"] for r in sums), 0
        for k in sorted(params):
            params[k] = flat[at : at + params[k].size].reshape(params[k].shape).astype(np.float32)
            at += params[k].size

    state = sc.broadcast((params, classes, top, ends, total, kinds))  # top_words words, and numbers per id and parameter
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), (~learn).alias("held_out"), text)
    scored, path3 = store(rows.mapInArrow(tidy(_score(state, path, pattern, shape, slice_bytes)), SCORED), "scored")
    rare = scored.select("uid", F.explode("rare").alias("key")).groupBy("uid", "key").agg(F.count("*").alias("times"))
    found = rare.join(words, "key").groupBy("uid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("sum"))
    out = scored.drop("rare").join(found, "uid", "left")
    out, _ = store(out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("sum", F.lit(0.0))).alias("base_score"),
        "score",
    ), "result")
    remove(spark, path3, *paths)
    return out
