"""Benchmark decontamination with suffix arrays over the training text.

A shard is a stretch of training words as ids of the benchmark's vocabulary; any other word, and the end of a
document, is id 0 and matches nothing. A shard's suffix array is sorted by prefix doubling as far as the longest
window asks for. Every suffix of every benchmark item that a window fits into (of an item shorter than one, the whole item) is
looked up in it by its window, by binary search; its range holds all verbatim places. Places that go on in step with the item are
one match: from each place where a match begins it is followed, in document and item at once, to its end, so each document's
longest verbatim match is known with where it is on both sides. Shards are independent: nothing is shuffled.

The benchmark is broadcast in blocks of a fixed number of words; with more than one block, a pass over the
documents is made per block and the hit places are united per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import in_bytes, lean, map_rows, remove, store, texts, tidy

#: Lower-cases A-Z; ASCII that is no digit or letter separates words; other bytes belong to words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "uid long, doc_id long, n_words long, n_hit long, hits binary, items array<string>, longest long, longest_at long, longest_item string, longest_item_at long"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Block:
    """A block of benchmark items: its vocabulary, its words as ids, and its distinct windows with their items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.names = [name for name, _ in items]
        self.rank = np.unique([name or "" for name in self.names], return_inverse=True)[1] if items else np.zeros(0, np.int64)
        number, token, item, start, left = self.vocabulary, [], [], [], []
        for k, (_, ws) in enumerate(items):
            token += [number.setdefault(w, len(number) + 1) for w in ws]
            n = len(ws) - window + 1 if len(ws) >= window else 1
            start += range(len(token) - len(ws), len(token) - len(ws) + n)
            left += repeat(min(window, len(ws)), n)
            item += repeat(k, n)
        self.shortest = min(left, default=window)
        token = np.array([*token, *[0] * window], np.int64)
        grid = token[np.array(start, np.int64)[:, None] + np.arange(window)] if start else np.zeros((0, window), np.int64)
        left = np.array(left, np.int64)
        grid[np.arange(window) >= left[:, None]] = 0
        self.windows, inverse = np.unique(grid, axis=0, return_inverse=True)
        self.lengths = (self.windows > 0).sum(axis=1)
        pairs = np.unique(np.stack([inverse.ravel(), np.array(item, np.int64)], 1), axis=0) if start else np.zeros((0, 2), np.int64)
        self.owner = pairs[:, 1]
        self.bounds = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        # Where whole windows stand in the row of all items' words, by window and by the window one word before (-1: none).
        self.at = np.full(len(token) + 1, -1, np.int64)
        whole = left == window
        places = np.array(start, np.int64)[whole]
        self.at[places] = inverse.ravel()[whole]
        self.item_of, self.item_begin = np.array(item, np.int64)[whole], np.cumsum([0, *(len(ws) for _, ws in items)])
        before = np.where(places > self.item_begin[self.item_of], self.at[places - 1], -1)
        order = np.lexsort((before, self.at[places]))
        self.places, self.item_of = places[order], self.item_of[order]
        self.order_window, self.order_before = self.at[self.places], before[order]


def suffix_array(token: np.ndarray, depth: int, least: int, top: int) -> np.ndarray:
    """Starts of suffixes in the order of their first depth ids; 0 ends a suffix. Ids are at most top.
    Suffixes that lack `least` ids before a 0 are left out of the result: no window fits there. Doubling ranks them all
    the same, as longer suffixes go on with them."""
    bits = max(1, int(top).bit_length())
    n, width = len(token), max(1, min(depth, 62 // bits))
    padded = np.r_[token, np.zeros(max(width, least), np.int64)]
    key, alive, some = np.zeros(n, np.int64), np.ones(n, bool), np.ones(n, bool)
    for j in range(max(width, least)):
        alive &= padded[j : j + n] > 0  # beyond a 0 nothing counts
        if j < width:
            key = (key << bits) | np.where(alive, padded[j : j + n], 0)
        if j < least:
            some &= alive
    place = np.flatnonzero(some if width >= depth else token > 0)
    order = place[np.argsort(key[place], kind="stable")]
    if width >= depth or not len(order):
        return order
    rank = np.zeros(n + 1, np.int64)  # 0: no such suffix
    sorted_key = key[order]
    while width < depth:
        rank[:] = 0
        rank[order] = np.cumsum(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
        # The suffix `width` further on goes on only if the first `width` ids have no 0 among them.
        onward = rank[np.minimum(place + width, n)] * _full(token, place, width)
        key2 = rank[place] * (len(order) + 1) + onward
        o = np.argsort(key2, kind="stable")
        order, sorted_key, width = place[o], key2[o], 2 * width
    return order[some[order]]


def _full(token: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    zeros = np.r_[0, np.cumsum(token == 0)]
    return zeros[np.minimum(place + width, len(token))] == zeros[place]


def _search(token: np.ndarray, order: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range of the suffix array whose suffixes begin with it."""
    padded = np.r_[token, np.zeros(windows.shape[1], np.int64)]

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(order), np.int64)
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            mid = (low[k] + high[k]) // 2
            differs, sign = np.ones(len(k), bool), np.zeros(len(k), np.int64)
            start = order[mid]
            for j in range(windows.shape[1]):
                live = differs & (j < lengths[k])
                d = np.where(live, np.sign(padded[start + j] - windows[k, j]), 0)
                sign = np.where(d != 0, d, sign)
                differs &= d == 0
            right = sign < 0 if not after else sign <= 0
            low[k[right]] = mid[right] + 1
            high[k[~right]] = mid[~right]
        return low

    return bound(False), bound(True)


def _match(shard: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places in the shard and the windows that occur there."""
    order = suffix_array(shard, block.windows.shape[1], block.shortest, len(block.vocabulary))
    low, high = _search(shard, order, block.windows, block.lengths)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return order[np.repeat(low, n) + inside], which


def _places(docs: list[bytes], block: Block, shard_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each document ends in the row of all their words, and the places and windows that match."""
    known, ids, ends, n = block.vocabulary.get, [np.zeros(0, np.int64)], [], 0
    for t in docs:
        ws = words(t)
        ids += [np.fromiter(map(known, ws, repeat(0)), np.int64, len(ws)), np.zeros(1, np.int64)]
        n += len(ws) + 1
        ends.append(n)
    token, places, which = np.concatenate(ids), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(token), shard_words):  # a long text is cut, with the windows across the cut in the first part
        p, w = _match(token[a : a + shard_words + block.windows.shape[1] - 1], block)
        places.append(p[p < shard_words] + a)
        which.append(w[p < shard_words])
    return np.array(ends, np.int64), np.concatenate(places), np.concatenate(which)


def _scan(block, shard_words: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_bytes(whole, "text", shard_bytes):
                yield _per_document(batch, block.value, *_places(texts(batch.column("text")), block.value, shard_words))

    return run


def _clean(block, column: int, shard_words: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_bytes(whole, column, shard_bytes):
                ends, place, _ = _places(texts(batch.column(column)), block.value, shard_words)
                clean = np.ones(batch.num_rows, bool)
                clean[np.searchsorted(ends, place, side="right")] = False
                yield batch.filter(pa.array(clean))

    return run


def _longest(place: np.ndarray, which: np.ndarray, block: Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches that can't be extended: where they begin in the shard, their words, the item, and where they begin there."""
    whole = block.lengths[which] == block.window
    at, start = np.full(n + 1, -1, np.int64), place[whole]
    at[start] = which[whole]
    before = np.where(start > 0, at[start - 1], -1)
    # Of the places of the same window in items, those that the word before tells apart: there a match begins.
    low, high = (np.searchsorted(block.order_window, at[start], side=s) for s in ("left", "right"))
    step = len(block.windows) + 2
    key, mine = block.order_window * step + block.order_before + 1, at[start] * step + before + 1
    same_low, same_high = (np.where(before >= 0, np.searchsorted(key, mine, side=s), low) for s in ("left", "right"))
    parts = []
    for a, b in ((low, same_low), (same_high, high)):
        count = b - a
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        parts.append((np.repeat(start, count), np.repeat(a, count) + inside))
    p, q = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    here, there = p.copy(), block.places[q]
    size, live = np.full(len(p), block.window, np.int64), np.arange(len(p))
    while len(live):
        here[live] += 1
        there[live] += 1
        goes = (at[here[live]] >= 0) & (at[here[live]] == block.at[there[live]])
        live = live[goes]
        size[live] += 1
    item = block.item_of[q]
    short = np.flatnonzero(~whole)  # whole items of fewer words than a window
    owners = np.repeat(short, block.bounds[which[short] + 1] - block.bounds[which[short]])
    count = block.bounds[which[short] + 1] - block.bounds[which[short]]
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owner = block.owner[np.repeat(block.bounds[which[short]], count) + inside]
    return np.r_[p, place[owners]], np.r_[size, block.lengths[which[owners]]], np.r_[item, owner], np.r_[block.places[q] - block.item_begin[item], np.zeros(len(owners), np.int64)]


def _per_document(batch: pa.RecordBatch, block: Block, ends: np.ndarray, place: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
    begins = np.r_[0, ends[:-1]]
    doc = np.searchsorted(ends, place, side="right")
    steps = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    np.add.at(steps, place, 1)
    np.add.at(steps, place + block.lengths[which], -1)
    hit = np.cumsum(steps)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    span_doc = np.searchsorted(ends, starts, side="right")
    seen = np.unique(np.stack([doc, which], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
    n = block.bounds[seen[:, 1] + 1] - block.bounds[seen[:, 1]]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    of = np.unique(np.stack([np.repeat(seen[:, 0], n), block.owner[np.repeat(block.bounds[seen[:, 1]], n) + inside]], 1), axis=0)
    item_cut, span_cut = np.searchsorted(of[:, 0], np.arange(len(ends) + 1)), np.searchsorted(span_doc, np.arange(len(ends) + 1))
    at, length, of_item, item_at = _longest(place, which, block, int(ends[-1]) if len(ends) else 0)
    order = np.lexsort((item_at, block.rank[of_item], at, -length))
    order = order[np.argsort(np.searchsorted(ends, at[order], side="right"), kind="stable")]
    of_doc = np.searchsorted(ends, at[order], side="right")
    best = {int(d): int(k) for d, k in zip(of_doc[::-1], order[::-1], strict=True)}
    hits, items, longest, n_hit = [], [], [], []
    for k in range(len(ends)):
        spans = np.stack([starts[span_cut[k] : span_cut[k + 1]], stops[span_cut[k] : span_cut[k + 1]]], 1) - begins[k]
        hits.append(spans.tobytes())
        n_hit.append(int((spans[:, 1] - spans[:, 0]).sum()))
        items.append([block.names[i] for i in of[item_cut[k] : item_cut[k + 1], 1] if block.names[i] is not None])
        top = best.get(k)
        longest.append((0, None, None, None) if top is None else (int(length[top]), int(at[top] - begins[k]), block.names[of_item[top]], int(item_at[top])))
    arrays = [batch.column("uid"), batch.column("doc_id"), pa.array(ends - 1 - begins, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
    arrays += [pa.array([x[c] for x in longest], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])


def _unite(pdf: pd.DataFrame) -> pd.DataFrame:
    """Hit spans of one document from several blocks, made one."""
    spans = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in pdf["hits"]])
    spans, merged = spans[np.argsort(spans[:, 0], kind="stable")], []
    for a, b in spans.tolist():
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out = pdf.iloc[:1].copy()
    out["hits"] = [np.array(merged, np.int64).tobytes()]
    out["n_hit"] = sum(b - a for a, b in merged)
    out["items"] = [sorted({i for x in pdf["items"] for i in x})]
    best = pdf.sort_values(["longest", "longest_at", "longest_item", "longest_item_at"], ascending=[False, True, True, True], kind="stable", na_position="first").iloc[0]
    for c in ("longest", "longest_at", "longest_item", "longest_item_at"):
        out[c] = pd.array([best[c]], dtype="Int64") if c != "longest_item" else [best[c]]
    return out


def blocks_of(benchmark: DataFrame, window: int, item_col: str, item_text: str, block_words: int) -> Iterator[Block]:
    """The benchmark, streamed in blocks of about block_words words; at least one."""
    items, held, some = [], 0, False
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{item_text}`").cast("binary"))
    for name, text in rows.toLocalIterator():
        if ws := words(bytes(text or b"")):
            items.append((name, ws))
            held += len(ws)
        if held >= block_words:
            yield Block(items, window)
            items, held, some = [], 0, True
    if items or not some:
        yield Block(items, window)


def find_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", block_words: int = 4_000_000, shard_words: int = 1_000_000, shard_bytes: int = 2_000_000,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, hits (word spans as int64 pairs, end exclusive), items, and the longest
    verbatim match with an item: longest (words; 0 if none has a window), longest_at (its first word here), longest_item and
    longest_item_at (its first word there); of several the first here, then by the item's name.

    A window is `window` consecutive words of an item, or all words of a shorter item; an item without words has
    none. Null text has no words. An item without an id still makes words hit, but isn't named. Repeated items and
    documents are each kept. Empty tables are fine. Other columns are not read.
    block_words bounds what is broadcast of the benchmark, shard_words and shard_bytes what a task sorts at once.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    blocks, share = blocks_of(benchmark, window, item_col, item_text, block_words), docs.sparkSession.sparkContext.broadcast
    first, second = next(blocks), next(blocks, None)
    lean(docs.sparkSession)
    if second is None:
        return rows.mapInArrow(tidy(_scan(share(first), shard_words, shard_bytes)), SCHEMA)
    rows, path = store(rows, "documents")  # uid must be the same in every pass
    paths, passes = [path], []
    for block in chain((first, second), blocks):  # one block is out at a time
        shared = share(block)
        done, path = store(rows.mapInArrow(tidy(_scan(shared, shard_words, shard_bytes)), SCHEMA), "matches")
        shared.unpersist()
        passes.append(done)
        paths.append(path)
    united, _ = store(reduce(DataFrame.unionByName, passes).groupBy("uid").applyInPandas(_unite, SCHEMA), "united")
    remove(docs.sparkSession, *paths)
    return united


def report(matches: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted names, joined by commas), contaminated."""
    names = F.array_sort(F.array_distinct("items"))
    return matches.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    block_words: int = 4_000_000, shard_words: int = 1_000_000, shard_bytes: int = 2_000_000,
) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs. Cases as in find_matches; a
    document without words stays. With several benchmark blocks each filters what the one before left."""
    out, column = docs, docs.columns.index(text_col)
    share, before = docs.sparkSession.sparkContext.broadcast, None
    blocks = blocks_of(benchmark, window, item_col, item_text, block_words)
    block = next(blocks)
    while True:
        shared = share(block)
        out = map_rows(out, _clean(shared, column, shard_words, shard_bytes))
        if (block := next(blocks, None)) is None:
            return out
        out, path = store(out, "cleaned")
        shared.unpersist()
        if before:
            remove(docs.sparkSession, before)
        before = path
