"""Quality classifier by compression.

Two zstandard dictionaries are built, one from text labelled good and one from text labelled bad. A text is
compressed with each; the difference of the two sizes, normalised by their sum and by the text's length, says which
dictionary knows the text better. A logistic fit on the labelled sample turns these (with the size under no
dictionary and the length, which they depend on) into a score from 0 to 1.

Only the fit is held to a sample: the first rows of each label by a hash of their id, whole, at most `sample_rows`, and
fewer if their texts together reach `sample_bytes` (about a hundred times a dictionary, which is what its training makes use
of). Every second row of a label goes into the dictionaries and the others into the logistic fit, so that scores are
calibrated on texts that no dictionary has seen. Every text is read whole, in the fit as in scoring; dictionaries and features
are made on executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrasift.llm.common import give_back, remove, store, texts, tidy


@dataclass
class Model:
    good: bytes
    bad: bytes
    level: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        dicts = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if d and d[:4] != b"7\xa40\xec" else zstandard.ZstdCompressionDict(d) if d else None for d in (self.good, self.bad)]
        return [zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_dict_id=False) if d else zstandard.ZstdCompressor(level=self.level, write_content_size=False) for d in (*dicts, None)]

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.c_[(features - self.mean) / self.scale, np.ones(len(features))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def features(docs: list[bytes], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Per text: the size difference by the sum and by the length, the log of the plain ratio and of the length."""
    out = np.empty((len(docs), 4))
    for k, text in enumerate(docs):
        n = len(text) + 1
        good, bad, plain = (len(c.compress(text)) for c in compressors)
        out[k] = (bad - good) / (bad + good), (bad - good) / n, np.log(n / plain), np.log(n)
    return out


def _dictionary(samples: list[bytes], size: int, piece: int = 2000) -> bytes:
    pieces = [t[i : i + piece] for t in samples for i in range(0, len(t), piece)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples: their own bytes are the dictionary
        return b"".join(pieces)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method with a ridge and halved steps: it can't run off when the classes are separable."""
    a, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)

    def loss(v: np.ndarray) -> float:
        s = a @ v
        return float(np.logaddexp(0, s).sum() - y @ s + ridge / 2 * (v @ v))

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4000, sample_bytes: int = 12_000_000, dictionary_bytes: int = 112_640, level: int = 3) -> Model:
    """Model from labelled rows; train is a condition on the labels' id column. Rows with a null id or label, and
    labels other than 0 and 1, aren't used; of an id with both labels the larger counts, and of the texts of a repeated id
    each counts once. With one class or none the scores are the share of good rows (0.5 with no rows). Null and empty
    texts are rows like others. A label's only row serves both parts."""
    rows = labels.where(train) if train is not None else labels
    rows = rows.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    picked = [rows.where(F.col("__label") == k).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows) for k in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample_rows ids
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    found = docs.select(F.col(id_col).alias("__id"), text.alias("__text")).join(ids, "__id").withColumn("__th", F.xxhash64("__text"))
    # A repeated id brings several texts; the rows that are taken stay bounded. Texts come in once these are known.
    order = Window.partitionBy("__label").orderBy(F.xxhash64("__id"), "__id", "__th")
    sizes = found.groupBy("__id", "__label", "__th").agg(F.max(F.octet_length("__text")).alias("__n"))
    sizes = sizes.withColumn("__k", F.row_number().over(order)).withColumn("__before", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    taken = F.broadcast(sizes.where((F.col("__k") <= sample_rows) & (F.col("__before") < sample_bytes)).select("__id", "__th", "__k"))
    sample, path = store(found.join(taken, ["__id", "__th"]).groupBy("__label", "__k").agg(F.first("__text").alias("__text")), "sample")

    def dictionary(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = [bytes(t) for t in pdf.sort_values("__k")["__text"] if t is not None and len(t)]
        out = pd.DataFrame({"label": [int(pdf["__label"].iloc[0])], "bytes": [_dictionary(docs, dictionary_bytes) if docs else b""]})
        del docs
        give_back()
        return out

    made = {r["label"]: bytes(r["bytes"]) for r in sample.where("__k % 2 = 1").groupBy("__label").applyInPandas(dictionary, "label int, bytes binary").collect()}
    model = Model(made.get(1, b""), made.get(0, b""), level, np.zeros(4), np.ones(4), np.zeros(5))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for b in batches:
            x = features(texts(b.column("__text")), compressors)
            yield pa.RecordBatch.from_arrays([b.column("y"), *(pa.array(c) for c in x.T)], ["y", "a", "b", "c", "d"])

    several = sample.groupBy("__label").agg(F.max("__k").alias("__last"))
    apart = sample.join(F.broadcast(several), "__label").where("__k % 2 = 0 or __last = 1")
    rows = apart.select(F.col("__label").cast("double").alias("y"), "__text").mapInArrow(measured, "y double, a double, b double, c double, d double")
    table = np.array([tuple(r) for r in rows.collect()], float).reshape(-1, 5)  # 2 * sample_rows rows of numbers
    remove(docs.sparkSession, path)
    y, x = table[:, 0], table[:, 1:]
    if len(set(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        model.weights[-1] = np.log(share / (1 - share))
        return model
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = _logistic((x - model.mean) / model.scale, y)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, keep: list[str | Column] | None = None) -> DataFrame:
    """keep's columns (all, if None) with score and predicted (1 from threshold on). Null text counts as empty; an empty
    table gives no rows. A kept column named score or predicted is refused."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of dictionary_bytes and 13 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = shared.value.compressors()
        for b in batches:
            s = shared.value.score(features(texts(b.column(b.num_columns - 1)), compressors))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names[:-1], "score", "predicted"])

    kept = docs.select(*(keep if keep is not None else [F.col(f"`{c}`") for c in docs.columns]), F.col(text_col).cast("binary").alias("__scored"))
    if taken := {c.lower() for c in kept.columns} & {"score", "predicted"}:
        raise ValueError(f"a kept column is named {', '.join(sorted(taken))}")
    schema = StructType(kept.schema.fields[:-1]).add("score", "double").add("predicted", "integer")
    return kept.mapInArrow(tidy(run), schema)


def calibration(scored: DataFrame, labels: DataFrame, bins: int = 10, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """bin, n, score (mean), good (share of label 1) over scored rows that have a label: how far scores are shares."""
    known = scored.join(labels.where(F.col(label_col).isin(0, 1)).select(id_col, label_col), id_col)
    width = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")
    return known.groupBy(width).agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg(F.col(label_col).cast("double")).alias("good")).orderBy("bin")
