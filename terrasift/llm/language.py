"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point alone. An n-gram is the product of its letters'
vectors, each rotated by its place; a document is the sum of its n-grams' vectors, weighted by the roots of their counts, at
unit length, and a language the sum of its training documents'. What all languages have in common is taken off both sides,
and the language whose prototype has the largest cosine with the document is predicted.

The vectors of some documents are formed together, as the product of their weights and the n-grams' vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import in_bytes, map_rows, texts, tidy

UNKNOWN = "und"
#: Bits of a letter's number, which is its code point; 0 is a gap between words.
BITS = 21
CHUNK = 1_000_000
#: Kinds of n-grams whose vectors a task keeps; documents and n-grams whose vectors are formed together.
KINDS, TOGETHER, GRAMS = 8192, 64, 300_000
#: Bytes of text that a task takes from Arrow at a time.
SLICE = 4_000_000


@cache
def letters() -> np.ndarray:
    """Every code point's number if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def _scattered(x: np.ndarray) -> np.ndarray:
    """64 bits that look random, from a number."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def letter_vectors(letter: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """The letters' vectors of +1 and -1."""
    words = (letter.astype(np.uint64)[:, None] << np.uint64(32)) + np.arange(seed << 16, (seed << 16) + dims // 64, dtype=np.uint64)
    return (np.unpackbits(_scattered(words).view(np.uint8).reshape(len(letter), dims // 8), axis=1).astype(np.int8) << 1) - 1


def grams(text: bytes, n: int) -> np.ndarray:
    """Numbers of the n-grams of letters and single gaps, in whole text; n-grams inside which a gap lies are left out."""
    found, table, rest = [], letters(), np.zeros(1, np.uint32)
    low = text.decode("utf-8", "replace").lower()
    for i in range(0, len(low), CHUNK):
        code = np.r_[rest, table[np.frombuffer(low[i : i + CHUNK].encode("utf-32-le", "replace"), np.uint32)]]
        if i + CHUNK >= len(low):
            code = np.r_[code, np.zeros(1, np.uint32)]
        code = code[np.r_[True, (code[1:] > 0) | (code[:-1] > 0)]]
        rest = code[1 - n :]
        if len(code) < n:
            rest = code
            continue
        number, fits = np.zeros(len(code) - n + 1, np.uint64), np.ones(len(code) - n + 1, bool)
        for k in range(n):
            at = code[k : k + len(number)]
            number = (number << np.uint64(BITS)) | at
            if 0 < k < n - 1:
                fits &= at > 0
        found.append(number[fits])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def gram_vectors(number: np.ndarray, dims: int, n: int, seed: int) -> np.ndarray:
    """The n-grams' vectors: their letters' rotated vectors, bound by multiplication."""
    out = np.ones((len(number), dims), np.int8)
    for k in range(n):
        letter, which = np.unique((number >> np.uint64(BITS * (n - 1 - k))) & np.uint64((1 << BITS) - 1), return_inverse=True)
        out *= np.roll(letter_vectors(letter, dims, seed), n - 1 - k, axis=1)[which]
    return out.astype(np.float32)


class Space:
    """Forms documents' vectors; keeps the vectors of at most KINDS kinds of n-grams."""

    def __init__(self, dims: int, n: int, seed: int):
        if n * BITS > 64 or dims % 64:
            raise ValueError("n-grams have 3 letters at most, and vectors a multiple of 64 dimensions")
        self.dims, self.n, self.seed = dims, n, seed
        self.forget()

    def forget(self) -> None:
        self.known, self.place, self.vectors = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.empty((KINDS, self.dims), np.float32)

    def of(self, number: np.ndarray) -> np.ndarray:
        """Vectors of at most KINDS different n-grams, sorted."""
        new = number[~np.isin(number, self.known, assume_unique=True)]
        if len(self.known) + len(new) > KINDS:
            self.forget()
            new = number
        if len(new):
            at = np.arange(len(self.known), len(self.known) + len(new))
            self.vectors[at] = gram_vectors(new, self.dims, self.n, self.seed)
            known, place = np.r_[self.known, new], np.r_[self.place, at]
            order = np.argsort(known)
            self.known, self.place = known[order], place[order]
        return self.vectors[self.place[np.searchsorted(self.known, number)]]

    def together(self, docs: list[bytes]) -> np.ndarray:
        """The documents' vectors at unit length; zeros for one without letters."""
        counted = [np.unique(grams(t, self.n), return_counts=True) for t in docs]
        number = np.unique(np.concatenate([v for v, _ in counted])) if counted else np.zeros(0, np.uint64)
        out = np.zeros((len(docs), self.dims), np.float32)
        for a in range(0, len(number), KINDS):
            some = number[a : a + KINDS]
            weight = np.zeros((len(docs), len(some)), np.float32)
            for k, (value, count) in enumerate(counted):
                low, high = np.searchsorted(value, some[0]), np.searchsorted(value, some[-1], side="right")
                weight[k, np.searchsorted(some, value[low:high])] = np.sqrt(count[low:high])
            out += weight @ self.of(some)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(size, 1e-30)

    def documents(self, docs: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """From which document on, and vectors, for some documents at a time: TOGETHER, fewer if they are long."""
        start = size = 0
        for i, t in enumerate(docs):
            if i > start and (i - start == TOGETHER or size + len(t) > GRAMS):
                yield start, self.together(docs[start:i])
                start, size = i, 0
            size += len(t)
        if docs:
            yield start, self.together(docs[start:])


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray
    common: np.ndarray
    dims: int
    n: int
    seed: int

    def best(self, vectors: np.ndarray) -> list[tuple[str, float]]:
        """The language and the score of each document's vector."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(vectors)
        apart = vectors - self.common
        cosine = (apart @ self.prototypes.T) / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)
        top = cosine.argmax(axis=1)
        score = np.clip((1 + cosine[np.arange(len(top)), top].astype(np.float64)) / 2, 0, 1)
        return [(self.languages[k], float(s)) if v.any() else (UNKNOWN, 0.0) for k, s, v in zip(top.tolist(), score.tolist(), vectors, strict=True)]


def fit(docs: DataFrame, train: Column | None = None, text_col: str = "text", lang_col: str = "lang", dims: int = 1024, n: int = 3, seed: int = 7) -> Profiles:
    """Prototypes from all rows that meet train and have a language. Rows without text or letters add nothing; repeated
    rows count each. Sums are made per task and then in two steps, so neither a common language nor many tasks meet in one
    place. A prototype of 4 * dims bytes per language comes to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total, count = Space(dims, n, seed), {}, {}
        for whole in batches:
            for b in in_bytes(whole, "text", SLICE):
                lang = b.column("lang").to_pylist()
                for start, vectors in space.documents(texts(b.column("text"))):
                    for k, v in enumerate(vectors, start):
                        if v.any():
                            total[lang[k]] = total.get(lang[k], 0) + v.astype(np.float64)
                            count[lang[k]] = count.get(lang[k], 0) + 1
        if total:
            salt = int(np.random.default_rng().integers(0, 64))  # only how the sum is split
            names = list(total)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([salt] * len(names), pa.int32()), pa.array([count[k] for k in names], pa.int64()), pa.array([total[k].tobytes() for k in names], pa.binary())], ["lang", "salt", "n", "vector"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[:1].copy()
        first["n"] = pdf["n"].sum()
        first["vector"] = [sum(np.frombuffer(v) for v in pdf["vector"]).tobytes()]
        return first

    schema = "lang string, salt int, n long, vector binary"
    rows = docs.where(train) if train is not None else docs
    rows = rows.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    parts = rows.mapInArrow(tidy(sums), schema).groupBy("lang", "salt").applyInPandas(add, schema).groupBy("lang").applyInPandas(add, schema)
    found = sorted(parts.collect(), key=lambda r: r["lang"])
    if not found:
        return Profiles([], np.zeros((0, dims), np.float32), np.zeros(dims, np.float32), dims, n, seed)
    mean = np.array([np.frombuffer(r["vector"]) / r["n"] for r in found])
    common = mean.mean(axis=0) if len(found) > 1 else np.zeros(dims)
    proto = mean - common
    proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)
    return Profiles([r["lang"] for r in found], proto.astype(np.float32), common.astype(np.float32), dims, n, seed)


def _predicted(shared, column: int, only: bool):
    """Predictions for the texts in a column: appended to the other columns, or only the rows that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Profiles = shared.value
        space = Space(p.dims, p.n, p.seed)
        for b in (part for whole in batches for part in in_bytes(whole, column, SLICE)):
            best = [x for _, vectors in space.documents(texts(b.column(column))) for x in p.best(vectors)]
            if only:
                yield b.filter(pa.array([name != UNKNOWN for name, _ in best], pa.bool_()))
            else:
                new = [pa.array([x for x, _ in best], pa.string()), pa.array([x for _, x in best], pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.nulls(b.num_rows, b.columns[-1].type), *new], [str(i) for i in range(len(b.columns) + 2)])  # the text stays here

    return run


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """keep's columns (all, if None) with lang_pred and score: half of 1 plus the best cosine, from 0 to 1. Text that
    is null or has no letter, and any text if there are no profiles, is `und` with score 0. Equal cosines go to the
    first language by name. Repeated rows are rows of their own; an empty table gives no rows. A kept column named
    lang_pred or score is refused."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # 4 * dims bytes a language
    kept = docs.select(*(keep if keep is not None else [F.col(f"`{c}`") for c in docs.columns]), F.col(f"`{text_col}`").cast("binary").alias("read"))
    if taken := {c.lower() for c in kept.columns[:-1]} & {"lang_pred", "score"}:
        raise ValueError(f"a kept column is named {', '.join(sorted(taken))}")
    names = [str(i) for i in range(len(kept.columns) + 2)]
    out = map_rows(kept, _predicted(shared, len(kept.columns) - 1, False), lang_pred="string", score="double").toDF(*names).drop(names[-3])
    return out.toDF(*kept.columns[:-1], "lang_pred", "score")


def identified(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The documents, with their own columns only, whatever their names, that have a language: those without any letter
    are rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return map_rows(docs, _predicted(shared, docs.columns.index(text_col), True))
