"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations alone.

A line's set is its distinct words. Its words are ordered by rarity; two sets that are similar enough share a word
among the first n - ceil(t * n) + 1 of each, and the place of a shared word and the sizes bound what else they can share.
The sets' words also set bits by parity in a 64-bit sketch: sets that differ in d words differ in d bits at most. Pairs
that pass these are verified on their words, and the later line of a similar pair is removed. Words stand as 64-bit
hashes, and a set as two hashes of those.

Rarity is counted over all lines, per hash bucket of words, in as many buckets as the corpus's bytes ask for; any order
of words gives the same pairs. Lines with the same set are one row before words are exploded, however many there are.

A word that at most COMMON occurrences share is held line against line: no list of lines is longer. The lines that share a
more common word are first held against the earliest of them; only lines this doesn't remove are held against the rest,
in a join whose skewed keys Spark splits.
"""

from __future__ import annotations

from functools import reduce
from math import floor, log2
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import free, let, remove, store, unused

#: The fewest and most bits of the table of rarities (a byte each).
LEAST_BITS, MOST_BITS = 12, 24
#: Bytes of the corpus for each entry of that table.
BYTES_PER_BUCKET = 400
#: Parts in which the rarer words are joined, one after the other.
PARTS = 2
#: For each number below 128 a byte whose crc32 has it in bits 24 to 30: Spark reads numbers from bytes fastest as their crc32.
BY_CRC = bytes({crc32(bytes([b])) >> 24 & 127: b for b in range(256)}[n % 128] for n in range(256))
#: Occurrences in the corpus beyond which a word is common.
COMMON = 1024


def level(count: int) -> int:
    return min(floor(3 * log2(count + 1)), 126)


def plain(text: Column) -> Column:
    """A text in lower case, with spaces for ASCII white space within its lines: once for the whole text, not for every line."""
    odd = text.contains("\t") | text.contains("\x0b") | text.contains("\f") | text.contains("\r")
    return F.lower(F.when(odd, F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text))


def lines_of(text: Column) -> Column:
    return F.split(plain(text), "\n", -1)


def words_of(line: Column) -> Column:
    """Words of a plain text's line; empty ones are among them."""
    return F.split(line, " ", -1)


def hashes_of(line: Column) -> Column:
    """Hashes of a plain line's different words."""
    return F.array_except(F.transform(words_of(line), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


class LineJoin:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int, broadcast_rows: int):
        self.spark, self.percent, self.broadcast_rows = docs.sparkSession, percent, broadcast_rows
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        # A row is known by its id and its text's hash; rows that repeat both are alike and are treated alike.
        self.rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text, F.length(text)).alias("th"), text.alias("text"))
        self.scratch: list[str] = []

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        """Written once; the shuffle files behind it can go."""
        # Hashes and ranks hardly repeat: a dictionary of them costs time and saves no room.
        df, path = store(df, what, **{"parquet.enable.dictionary": "false"})
        self.scratch.append(path)
        free(self.spark)
        return df

    def sets(self) -> DataFrame:
        """doc, th, line, size (its bytes, with the end of the line), hashes (of its different words), for every line."""
        raw = self.rows.select("doc", "th", F.posexplode(lines_of(F.col("text"))).alias("line", "raw"))
        return raw.select("doc", "th", "line", (F.octet_length("raw") + 1).alias("size"), hashes_of(F.col("raw")).alias("hashes"))

    def rarity(self, sets: DataFrame | None = None) -> tuple[bytes, int]:
        """How often words of each bucket occur: a byte per bucket, below 127, on a scale of logarithms; and the table's bits.
        With sets, in how many lines; these aren't cut into words again."""
        if sets is None:
            size = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            words = self.rows.select(F.explode(lines_of(F.col("text"))).alias("line")).select(F.explode(words_of(F.col("line"))).alias("word")).select(F.xxhash64("word").alias("hash"))
        else:
            size, words = sets.agg(F.sum("size")).first()[0] or 0, sets.select(F.explode("hashes").alias("hash"))
        # The texts' bytes tell how many words there are about, so that these are counted once, by their bucket.
        bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_PER_BUCKET).bit_length()))
        few = words.groupBy(F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)).alias("bucket")).agg(F.count("*").alias("c"))
        seen = few.select(F.col("bucket").cast("int"), F.least(F.floor(3 * F.log2(F.col("c") + 1)), F.lit(126)).cast("tinyint").alias("c")).toArrow()
        # Of a bucket that occurs 5 bytes are sent: 84 MB at most, for a table of 16 MB.
        table = np.zeros(1 << bits, np.uint8)
        table[seen["bucket"].to_numpy()] = seen["c"].to_numpy()
        return table.tobytes(), bits

    def needed(self, n: Column) -> Column:
        """How many of a set's first words must be looked at; none, if no different set can be similar."""
        return F.when(100 * n >= self.percent * (n + 1), n - F.ceil(F.lit(self.percent) * n / 100) + 1).otherwise(0).cast("int")

    def bounded(self, i: str, j: str) -> Column:
        """Whether the sizes, the words from the shared one on, and the sketches allow the similarity."""
        ni, pi, bi, nj, pj, bj = (F.col(f"{s}.{c}") for s in (i, j) for c in ("n", "pos", "bits"))
        least = F.ceil(F.lit(self.percent) * (ni + nj) / F.lit(100 + self.percent))
        sizes = 100 * F.least(ni, nj) >= self.percent * F.greatest(ni, nj)
        return sizes & (F.least(ni - pi, nj - pj) >= least) & (F.bit_count(bi.bitwiseXOR(bj)) <= ni + nj - 2 * least)

    def lines(self) -> DataFrame:
        """doc, th, line, n, k1, k2 (together the name of the set), bits, first (its rarest words), for lines with words."""
        # Texts are cut into words and these hashed once; what counts and what codes them read the hashes.
        sets = self.keep(self.sets(), "hashes")
        held, bits = self.rarity(sets)
        # A place in the table is told from its end, by a number below 0 with the hash's last bits.
        table, place = F.lit(held.translate(BY_CRC)), F.lit(-1 << bits)

        def code(h: Column) -> Column:
            often = F.crc32(F.substring(table, h.bitwiseOR(place).cast("int"), F.lit(1))).bitwiseAND(F.lit(127 << 24))
            # Never null, which what is read again might be for all that Spark knows: it sorts numbers faster than objects.
            return F.coalesce(F.shiftleft(often, 32).bitwiseOR(h.bitwiseAND(F.lit(2**56 - 1))), F.lit(0).cast("long"))

        # Six bits of the hash pick the bit; the shift itself looks at no more.
        sketch = F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(c, 40).cast("int"))))
        coded = sets.select("doc", "th", "line", F.size("hashes").alias("n"), F.sort_array(F.transform("hashes", code)).alias("codes"))
        n = F.col("n")
        out = self.keep(coded.select("doc", "th", "line", "n", F.xxhash64("codes").alias("k1"), F.xxhash64(F.lit(1), "codes").alias("k2"), sketch.alias("bits"), F.slice("codes", F.lit(1), self.needed(n)).alias("first")), "lines")
        remove(self.spark, self.scratch.pop(0))
        return out.where("n > 0")

    def classes(self, lines: DataFrame) -> DataFrame:
        """One row per set: rank (by first occurrence), where that is, n, bits, and its rarest words."""
        first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "th", "line", "n", "bits", "first"))
        named = lines.groupBy("k1", "k2").agg(first.alias("f")).select("k1", "k2", "f.*")
        # In the order of first occurrence, so that a number that grows with the partition and the row is a rank.
        return self.keep(named.orderBy("none", "doc", "th", "line").withColumn("rank", F.monotonically_increasing_id()).drop("none"), "classes")

    def postings(self, classes: DataFrame, common: bool) -> DataFrame:
        """code, rank, n, pos, bits: each set's rarest words, without those that occur once."""
        often = F.shiftright("code", 56)
        rows = classes.where(F.size("first") > 0).select("rank", "n", "bits", F.posexplode("first").alias("pos", "code"))
        return rows.where(often > level(COMMON) if common else often.between(level(1) + 1, level(COMMON)))

    def verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Ranks (b) of lines that are similar to their earlier partner (a)."""
        wanted = pairs.select(F.col("a").alias("rank")).unionByName(pairs.select(F.col("b").alias("rank"))).distinct()
        wanted = self.keep(classes.select("rank", "doc", "th", "line").join(wanted, "rank"), "wanted")
        at = wanted.groupBy(F.col("doc").alias("doc2"), F.col("th").alias("th2")).agg(F.collect_set(F.struct("line", "rank")).alias("at"))
        n = wanted.count()
        rows = self.rows
        if n <= self.broadcast_rows:
            at = F.broadcast(at)
            # Texts of other ids aren't hashed for the join.
            rows = rows.join(F.broadcast(wanted.select(F.col("doc").alias("doc1")).distinct()), F.col("doc").eqNullSafe(F.col("doc1")), "left_semi")
        found = rows.join(at, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("th") == F.col("th2")))
        # Only the wanted lines are made plain: a line by itself is what it is in its text made plain.
        raw = found.select(F.split("text", "\n", -1).alias("all"), "at").select("all", F.explode("at").alias("w")).select(F.col("w.rank").alias("rank"), F.get("all", F.col("w.line")).alias("raw"))
        sets = self.keep(raw.select("rank", hashes_of(plain(F.col("raw"))).alias("words")), "sets")
        if sets.count() > n:  # rows that repeat id and text bring a line several times
            sets = self.keep(sets.dropDuplicates(["rank"]), "sets")
        x, y = (sets.select(F.col("rank").alias(r), F.col("words").alias(w)) for r, w in (("a", "x"), ("b", "y")))
        similar = (100 + self.percent) * F.size(F.array_intersect("x", "y")) >= self.percent * (F.size("x") + F.size("y"))
        return self.keep(pairs.join(x, "a").join(y, "b").where(similar).select("b").distinct(), "verified")

    def removed(self, classes: DataFrame, places: DataFrame) -> DataFrame:
        """rank of every set that has an earlier similar one. classes and other tables go before the last pairs are verified."""
        mine = len(self.scratch) - 1
        own, at = F.struct("rank", "n", "pos", "bits"), [F.col("a"), F.col("b")]
        common = self.keep(self.postings(classes, True), "common")
        heads = common.groupBy("code").agg(F.min(own).alias("i"))
        stars = common.select("code", own.alias("j")).join(heads, "code").where(F.col("i.rank") < F.col("j.rank")).where(self.bounded("i", "j"))
        stars = self.keep(stars.select(F.col("i.rank").alias("a"), F.col("j.rank").alias("b")).distinct(), "pairs")
        done = self.verified(stars, places)

        ahead = (F.col("i.rank") < F.col("j.rank")) & self.bounded("i", "j")
        later = common.join(done.withColumnRenamed("b", "rank"), "rank", "left_anti").alias("j")
        rest = common.alias("i").join(later, (F.col("i.code") == F.col("j.code")) & ahead).select(F.col("i.rank").alias("a"), F.col("j.rank").alias("b"))
        parts = []
        for k in range(PARTS):
            rare = self.postings(classes, False).where(F.pmod("code", F.lit(PARTS)) == k)
            met = rare.alias("i").join(rare.alias("j"), (F.col("i.code") == F.col("j.code")) & ahead)
            parts.append(self.keep(met.select(F.col("i.rank").alias("a"), F.col("j.rank").alias("b")).distinct(), "pairs"))
        pairs = reduce(DataFrame.unionByName, parts, rest).select(*at).distinct().join(done, "b", "left_anti")
        pairs = self.keep(pairs.join(stars, ["a", "b"], "left_anti").select("a", "b"), "pairs")
        done = self.keep(done, "verified")
        kept = self.scratch[-2:]
        remove(self.spark, *self.scratch[mine:-2])
        self.scratch[mine:] = kept
        return done.unionByName(self.verified(pairs, places)).select(F.col("b").alias("rank"))

    def removed_lines(self) -> DataFrame:
        """doc, th, gone: the numbers (from 0) of the lines that go, for rows that lose any."""
        lines = self.lines()
        classes = self.classes(lines)
        whole = self.scratch.pop(0)
        lines = self.keep(lines.select("doc", "th", "line", "k1", "k2"), "lines")
        remove(self.spark, whole)
        places = self.keep(classes.select("rank", "k1", "k2", "doc", "th", "line"), "places")
        # What the sets are joined by is the last of the tables, and goes when that is done.
        path = self.scratch.pop(0)
        self.scratch.append(path)
        gone = self.removed(classes, places).withColumn("gone", F.lit(True))
        first = places.select("rank", "k1", "k2", F.col("doc").alias("doc0"), F.col("th").alias("th0"), F.col("line").alias("line0")).join(gone, "rank", "left")
        own = F.col("doc").eqNullSafe(F.col("doc0")) & (F.col("th") == F.col("th0")) & (F.col("line") == F.col("line0"))
        goes = lines.join(first, ["k1", "k2"]).where(F.col("gone").isNotNull() | ~own)
        out, path = store(goes.groupBy("doc", "th").agg(F.collect_set("line").alias("gone")), "gone")
        remove(self.spark, *self.scratch)
        self.scratch = [path]
        return out


def dedup_lines(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed", broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """The documents with the text's later similar lines removed, and n_lines and n_removed (longs) after their columns.

    A line goes if an earlier line of any document, whether that stays or not, has 100 * |A & B| >= percent * |A | B| for
    their sets of lower-case words. Lines come in the order of their document's id (null last), the hash of its text, and their
    number. Lines without words stay. Null text has one empty line and stays null. Rows that repeat id and text lose the
    same lines. An empty table gives no rows. The result's other columns are as they were, whatever their names; n_lines
    and n_removed name the two new ones, which must not be among the table's: that is refused.
    broadcast_rows: up to so many rows the lists of lines are broadcast; beyond it the same joins are shuffled.
    """
    if taken := {c.lower() for c in docs.columns} & {n_lines.lower(), n_removed.lower()}:
        raise ValueError(f"the table has a column {', '.join(sorted(taken))}; name the new ones otherwise")
    join = LineJoin(docs, id_col, text_col, percent, broadcast_rows)
    doc, th, at = (unused(docs.columns, c) for c in ("doc", "th", "gone"))
    gone = join.removed_lines().withColumnsRenamed({"doc": doc, "th": th, "gone": at})
    few = gone.agg(F.count("*"), F.sum(F.size(at))).first()
    if few[0] <= broadcast_rows and (few[1] or 0) <= 8 * broadcast_rows:
        gone = F.broadcast(gone)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text, F.length(text)) == F.col(th))
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains(at, i))
    changed = F.when(F.col(at).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    out = docs.join(gone, same, "left")
    return out.select(
        *(changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns),
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias(n_removed),
    )
