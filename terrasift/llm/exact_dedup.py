"""Exact duplicates by a log-structured merge index over text digests.

Digests are dealt out by range. In a range's task they fill memtables; a full one is flushed as a sorted run with a Bloom
filter, and the runs are compacted by tiers: entries that no other run's filter knows pass through, the rest are merged and
keep the preferred identifier. Digests found more than once are hits; the texts behind them are compared byte by byte.

Hot texts: before anything is shuffled, each task reduces its digests, some at a time, to one entry each, so a text that a third
of all rows share adds one entry per task's memtable. Ranges are as many as the number of entries asks for, and an entry is a
row of fixed size: what is shuffled grows with the data and no faster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.common import partitions_for, remove, store

ENTRY_SCHEMA = "range long, digest binary, id long, uid long, n long"
HIT_SCHEMA = "digest binary, keep_id long, keep_uid long, group_size long"
BITS_PER_ENTRY, PROBES = 10, 4


def _positions(digests: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES filter positions of each digest, from its own bytes (they are uniform)."""
    width = digests.dtype.itemsize
    raw = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), width)
    if width < 16:
        raw = np.pad(raw, ((0, 0), (0, 16 - width)))
    a, b = raw[:, :8].copy().view(np.uint64).ravel(), raw[:, 8:16].copy().view(np.uint64).ravel() | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(bits) for k in range(PROBES)])


def make_filter(digests: np.ndarray) -> bytes:
    bits = max(64, BITS_PER_ENTRY * len(digests))
    found = np.zeros(bits, bool)
    found[_positions(digests, bits).ravel()] = True
    return bits.to_bytes(8, "little") + np.packbits(found).tobytes()


def may_contain(stored: bytes, digests: np.ndarray) -> np.ndarray:
    bits = int.from_bytes(stored[:8], "little")
    found = np.unpackbits(np.frombuffer(stored[8:], np.uint8))
    return found[_positions(digests, bits)].all(axis=0)


def _reduce(digest: np.ndarray, ids: np.ndarray, has: np.ndarray, uid: np.ndarray, count: np.ndarray, largest: bool):
    """One entry per digest, sorted: the preferred id (null last, then the earliest row), and the sum of counts."""
    order = np.lexsort((uid, ~ids if largest else ids, ~has, digest))
    digest, ids, has, uid, count = (x[order] for x in (digest, ids, has, uid, count))
    first = np.flatnonzero(np.r_[True, digest[1:] != digest[:-1]]) if len(digest) else np.zeros(0, np.int64)
    return digest[first], ids[first], has[first], uid[first], np.add.reduceat(count, first) if len(first) else count


def _reduced(width: int, ranges: int, memtable: int, largest: bool):
    """One entry per digest of each memtable's worth of rows, with the range it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def entries() -> pa.RecordBatch:
            digest, ids, has, uid, count = _reduce(*(np.concatenate(x) for x in zip(*held, strict=True)), largest)
            lead = np.zeros((len(digest), 4), np.uint8)
            raw = np.frombuffer(digest.tobytes(), np.uint8).reshape(len(digest), width)
            lead[:, : min(4, width)] = raw[:, :4]
            ranged = (lead.view(">u4").ravel().astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32)
            whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(digest), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(ranged.astype(np.int64)), whole, pa.array(ids, mask=~has), pa.array(uid), pa.array(count)], [x.split()[0] for x in ENTRY_SCHEMA.split(", ")])

        waiting = 0
        for batch in batches:
            ids = batch.column("id")
            has = ids.is_valid().to_numpy(zero_copy_only=False)
            held.append((_digests(batch.column("digest").to_pylist(), width), ids.fill_null(0).to_numpy(), has, batch.column("uid").to_numpy(), np.ones(batch.num_rows, np.int64)))
            waiting += batch.num_rows
            if waiting >= memtable:
                yield entries()
                held, waiting = [], 0
        if waiting:
            yield entries()

    return run


def _digests(values: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), f"S{width}")


def _merge(runs: list[tuple], largest: bool) -> tuple:
    """One sorted run out of a few: only entries that another run's filter knows are compared."""
    alone, meet = [], []
    for k, run in enumerate(runs):
        known = np.zeros(len(run[0]), bool)
        for other in runs[:k] + runs[k + 1 :]:
            rest = np.flatnonzero(~known)
            known[rest[may_contain(other[5], run[0][rest])]] = True
        alone.append(tuple(x[~known] for x in run[:5]))
        meet.append(tuple(x[known] for x in run[:5]))
    parts = [*alone, _reduce(*(np.concatenate(x) for x in zip(*meet, strict=True)), largest)]
    digest, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(digest, kind="stable")
    return digest[order], *(x[order] for x in rest), make_filter(digest)


def _compact(width: int, largest: bool, memtable: int, fan_in: int = 8):
    """A range's index: memtables flushed as sorted runs, compacted to one; its hits."""

    def flushed(part: pd.DataFrame) -> tuple:
        has = part["id"].notna().to_numpy()
        run = _reduce(_digests(part["digest"].tolist(), width), part["id"].fillna(0).astype(np.int64).to_numpy(), has, part["uid"].to_numpy(), part["n"].to_numpy(), largest)
        return *run, make_filter(run[0])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [flushed(pdf.iloc[a : a + memtable]) for a in range(0, len(pdf), memtable)]
        while len(runs) > 1:  # size-tiered: the smallest runs first
            runs.sort(key=lambda r: len(r[0]))
            runs = [*runs[fan_in:], _merge(runs[:fan_in], largest)]
        digest, ids, has, uid, count, _ = runs[0]
        hit = np.flatnonzero(count > 1)
        raw = digest.tobytes()
        kept = pd.array([int(i) if h else None for i, h in zip(ids[hit], has[hit], strict=True)], dtype="Int64")
        return pd.DataFrame({"digest": [raw[i * width : (i + 1) * width] for i in hit], "keep_id": kept, "keep_uid": uid[hit], "group_size": count[hit]})

    return merge


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=None,
    keep: str = "smallest",
    memtable: int = 50_000,
    digest_bytes: int = 32,
    broadcast_hits: int = 500_000,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    normalise maps the text Column to the one compared; None compares texts as they are. Null text counts as
    empty, so it equals an empty one. keep is "smallest" or "largest"; a null id is kept only if its whole group
    has none, and of rows with the same text and id the earliest stays, so exactly one row per group is kept. An
    empty table gives no rows. Other columns, whatever their names, are not read.
    broadcast_hits: up to so many repeated digests (36 bytes each) are broadcast to find the texts to compare;
    beyond it the same join is shuffled. digest_bytes below 32 only makes collisions testable.
    """
    spark, largest = docs.sparkSession, keep == "largest"
    plain: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(plain) if normalise else plain
    cut = lambda c: F.substring(F.unhex(c), 1, digest_bytes) if digest_bytes < 32 else F.unhex(c)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(text.cast("binary"), 256).alias("sha"))
    keyed, _ = store(keyed.select("id", "sha", F.monotonically_increasing_id().alias("uid")), "digests")
    keyed = keyed.withColumn("digest", cut(F.col("sha")))
    ranges = partitions_for(spark, keyed.count(), 4 * memtable)
    entries = keyed.select("id", "uid", "digest").mapInArrow(_reduced(digest_bytes, ranges, memtable, largest), ENTRY_SCHEMA)
    hits, _ = store(entries.groupBy("range").applyInPandas(_compact(digest_bytes, largest, memtable), HIT_SCHEMA), "hits")

    found = hits.select("digest")
    if hits.count() <= broadcast_hits:
        found = F.broadcast(found)
    behind = docs.select(text.alias("text"), cut(F.sha2(text.cast("binary"), 256)).alias("digest")).join(found, "digest", "left_semi")
    sides = behind.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    collided, path = store(sides.where("a != b").select("digest"), "collided")

    joined = keyed.join(hits, "digest", "left")
    out = joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "digest",
    )
    if collided.isEmpty():
        remove(spark, path)
        return out.drop("digest")
    # Different texts behind one digest: the texts themselves are the keys there.
    whole = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha"))
    again = whole.withColumn("digest", cut(F.col("sha"))).join(collided, "digest", "left_semi")
    same = Window.partitionBy("text")
    first = same.orderBy(F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last())
    fixed = again.select(
        F.col("id").alias(id_col),
        F.first("id").over(first).alias("keep_id"),
        F.count("*").over(same).alias("group_size"),
        (F.row_number().over(first) == 1).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return out.join(collided, "digest", "left_anti").drop("digest").unionByName(fixed)
