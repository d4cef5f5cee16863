"""Personal data by patterns and by bootstrapped contextual extraction, in DataFrame operations alone.

Fixed patterns find e-mail and IP addresses, card and phone numbers, and digests in lower-case hexadecimal (secrets). These
are the seeds. A text is a row of tokens, each seed one of them. The two tokens before a place, the two after it, and the
one on either side are lexical patterns. Those around seeds are scored by the share of all their occurrences in the corpus
that hold a known identifier; around any other token in an accepted pattern the search goes on: it becomes an identifier
itself if one of its patterns is likely enough to be right and it stands in such a pattern often enough, whatever it looks
like, and its own contexts are patterns of the next round. The graph of patterns and identifiers grows until nothing new is
accepted.

Only counts of patterns, and the occurrences of known identifiers and accepted patterns, are kept; the corpus itself is one
table of token hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import let, remove, store

# The four kinds' patterns, in the order in which they are listed. They match what the plain forms
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card [0-9]([\x20-]?[0-9])+                                   phone \+[0-9][\x20().0-9-]+[0-9]
# match, leftmost and without overlap, but in linear time and without recursion on long texts: repeated groups are
# written as a reluctant run up to the first place where the group can't go on.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?<=[A-Za-z0-9-])(?![A-Za-z0-9-]|\.[A-Za-z0-9-])",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[0-9]|[\x20-][0-9])[0-9\x20-]*?(?<=[0-9])(?![0-9]|[\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+", "secret": ""}
#: The seeds beside the four kinds: 32 or more hexadecimal digits, both letters and decimals among them.
SECRET = r"(?=[0-9a-f]{8})(?<![0-9A-Za-z])(?=[0-9a-f]{0,127}[0-9])(?=[0-9]{0,127}[a-f])[0-9a-f]{32,128}(?![0-9A-Za-z])"
SEEDS = {**KINDS, "secret": SECRET}
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
LETTER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TRIMMED = "-._@/"
#: What a token is: a seed, a word with marks inside, or a mark that often stands before a value. Texts without an @, or
#: without digits, need not be searched for all seeds.
PLAIN = rf"[^{LETTER}][[^{LETTER}]._@/-]*+|[=:#]"
DIGITS = "|".join(rf"(?:{SEEDS[k]})(?![^{LETTER}])" for k in ("secret", "phone", "ip", "card")) + f"|{PLAIN}"
TOKEN = f"(?:{KINDS['email']})|{DIGITS}"
BLOCK = 256
#: Contexts are screened in one of so many documents, step by step, before they are counted in all.
SCREENS = (256, 16)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    turned = F.reverse(digits)

    def term(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    terms = F.transform(F.sequence(F.lit(1), F.length(digits)), term)
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _sum(numbers: Column, start: Column, count: Column) -> Column:
    return F.aggregate(F.slice(numbers, start, count), F.lit(0).cast("long"), lambda a, x: a + x)


def matches(text: Column, pattern: str, build) -> Column:
    """build(match, i, start, matches, gaps) of every match of pattern in text, in order; gaps are what lies around the
    matches. The starts are sums over blocks, so that a text with very many matches takes no square time."""

    def with_gaps(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long"))

        def with_blocks(step: Column, before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                k = F.floor(i / BLOCK).cast("int")
                start = F.get(before, k) + _sum(step, k * BLOCK + 1, i % BLOCK) + F.length(F.get(gaps, i))
                return let(start, lambda s: build(m, i, s, found, gaps))

            return F.transform(found, one)

        def with_steps(step: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(step) - 1) / BLOCK).cast("int")), lambda k: _sum(step, k * BLOCK + 1, F.lit(BLOCK)))
            before = let(blocks, lambda b: F.transform(b, lambda _, k: _sum(b, F.lit(1), k)))
            return let(before, lambda p: with_blocks(step, p))

        return let(steps, with_steps)

    def some(found: Column) -> Column:
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: with_gaps(found, gaps)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def _span(start: Column, end: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), value.alias("value"))


SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def base_spans(text: Column, kind: str) -> Column:
    """start, end and value of the valid matches of a kind, in order."""
    found = matches(text, SEEDS[kind], lambda m, i, start, found, gaps: _span(start, start + F.length(m), m))
    some = text.contains(NEEDED[kind]) if NEEDED[kind] else text.rlike("[0-9]")
    return F.coalesce(F.when(some, F.filter(found, lambda x: valid(kind, x["value"]))), F.array().cast(SPANS))


def _kind(token: Column) -> Column:
    """Which seed a token is, if any."""
    whole = lambda k: token.rlike(rf"^(?:{SEEDS[k]})\z") & valid(k, token)
    return (
        F.when(token.contains("@"), F.when(whole("email"), "email"))
        .when(token.startswith("+"), F.when(whole("phone"), "phone"))
        .when(token.rlike("^[0-9.]+\\z") & token.contains("."), F.when(whole("ip"), "ip"))
        .when(F.length(token) >= 16, F.when(whole("card"), "card").when(whole("secret"), "secret"))
    )


def _tokens(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, h (the hashes of all tokens; a seed has its kind's) and seeds (i, kind, value hash) of every text."""
    text, trim = F.col("text"), F.lit(TRIMMED)
    every = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    tokens = F.when(text.contains("@"), every(text, TOKEN)).when(text.rlike("[0-9]"), every(text, DIGITS))
    cut = rows.select(*keep, "text", tokens.alias("tokens")).select(*keep, "text", "tokens", F.transform("tokens", _kind).alias("kinds"))
    plain = F.transform(every(F.lower(text), PLAIN), lambda t: F.xxhash64(F.rtrim(t, trim)))
    h = F.when(F.col("tokens").isNull(), plain).otherwise(F.zip_with("tokens", "kinds", lambda t, k: F.when(k.isNull(), F.xxhash64(F.lower(F.rtrim(t, trim)))).otherwise(F.xxhash64(F.lit("\x01"), k))))
    seeds = F.filter(F.transform("kinds", lambda k, i: F.struct(i.alias("i"), k.alias("kind"), F.xxhash64(F.get("tokens", i)).alias("value"))), lambda x: x["kind"].isNotNull())
    return cut.select(*keep, h.alias("h"), F.when(F.size(seeds) > 0, seeds).alias("seeds"))


def _around(h: str, i: Column) -> Column:
    """The three patterns that the place i stands in."""
    at = lambda k: F.get(h, i + k)
    return F.array(F.xxhash64(F.lit(1), at(-2), at(-1)), F.xxhash64(F.lit(2), at(1), at(2)), F.xxhash64(F.lit(3), at(-1), at(1)))


class Bootstrap:
    def __init__(self, corpus: DataFrame, support: int, precision: float, share: float, broadcast_rows: int):
        self.corpus, self.support, self.precision, self.share, self.broadcast_rows = corpus, support, precision, share, broadcast_rows
        self.scratch: list[str] = []

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        df, path = store(df, what)
        self.scratch.append(path)
        return df

    def meet(self, rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
        return rows.join(F.broadcast(few) if few.count() <= self.broadcast_rows else few, key)

    def places(self, corpus: DataFrame | None = None) -> DataFrame:
        """k1, k2, i, w, patterns (as _around has them) of every token."""
        none, n = F.array(F.lit(None).cast("long")), F.size("h")
        row = F.arrays_zip(F.col("h").alias("w"), F.slice(F.concat(none, "h"), F.lit(1), n).alias("l1"), F.slice(F.concat(none, none, "h"), F.lit(1), n).alias("l2"), F.slice("h", F.lit(2), n).alias("r1"), F.slice("h", F.lit(3), n).alias("r2"))
        # Texts without tokens have none; what is shorter is filled with NULL.
        at = (self.corpus if corpus is None else corpus).where(n > 0).select("k1", "k2", F.posexplode(row).alias("i", "at")).select("k1", "k2", "i", "at.*")
        patterns = F.array(F.xxhash64(F.lit(1), "l2", "l1"), F.xxhash64(F.lit(2), "r1", "r2"), F.xxhash64(F.lit(3), "l1", "r1"))
        return at.select("k1", "k2", "i", "w", patterns.alias("patterns"))

    def run(self) -> DataFrame:
        """k1, k2, i, kind: tokens that are identifiers and no seeds."""
        none = lambda **columns: self.corpus.limit(0).select(*(F.lit(None).cast(t).alias(c) for c, t in columns.items()))
        seeds = self.corpus.where(F.col("seeds").isNotNull()).select(F.explode(F.transform("seeds", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), _around("h", s["i"]).alias("patterns")))).alias("s")).select("s.*")
        contexts = self.keep(seeds.select("kind", "value", F.explode("patterns").alias("pattern")).groupBy("pattern", "kind", "value").agg(F.count("*").alias("n")), "contexts")
        seen, found, known = none(pattern="long", seen="long"), none(k1="long", k2="long", i="int", w="long", pattern="long"), none(w="long", kind="string")
        marks = F.array(*(F.xxhash64(F.lit("\x01"), F.lit(k)) for k in SEEDS))
        held = none(pattern="long")
        while True:
            enough = contexts.groupBy("pattern").agg(F.count_distinct("value").alias("v")).where(F.col("v") >= self.support).select("pattern")
            hits = contexts.groupBy("pattern").agg(F.sum("n").alias("hits")).join(enough, "pattern").join(seen, "pattern", "left_anti")
            fresh = self.keep(hits, "patterns")
            # A pattern that occurs too often in a part of the corpus already can't be precise enough in all of it.
            for share in SCREENS:
                part = self.corpus.where(F.pmod("k1", F.lit(share)) == 0)
                often = self.meet(self.places(part).select(F.explode("patterns").alias("pattern")), fresh.select("pattern"), "pattern").groupBy("pattern").agg(F.count("*").alias("c"))
                fresh = self.keep(fresh.join(often, "pattern", "left").where(F.col("c").isNull() | (F.col("hits") >= self.precision * F.col("c"))).select("pattern", "hits"), "patterns")
            fresh = fresh.select("pattern")
            counted = self.meet(self.places().select(F.explode("patterns").alias("pattern")), fresh, "pattern").groupBy("pattern").agg(F.count("*").alias("seen"))
            seen = self.keep(seen.unionByName(counted), "seen")
            scored = contexts.groupBy("pattern", "kind").agg(F.sum("n").alias("hits"), F.count("*").alias("v")).where(F.col("v") >= self.support).join(seen, "pattern")
            accepted = scored.where(F.col("hits") >= self.precision * F.col("seen")).select("pattern", "kind", F.least(F.col("hits") / F.col("seen"), F.lit(0.99)).alias("right"))
            accepted = self.keep(accepted, "accepted")
            unread = self.keep(accepted.select("pattern").distinct().join(held, "pattern", "left_anti"), "patterns")
            if unread.isEmpty():
                break
            places = self.places().where(~F.array_contains(marks, F.col("w")))
            found = self.keep(found.unionByName(self.meet(places.select("k1", "k2", "i", "w", F.explode("patterns").alias("pattern")), unread, "pattern").select(found.columns)), "found")
            held = held.unionByName(unread)
            new = self.identifiers(found, accepted, known, places)
            if new is None:
                break
            fresh_known, more = new
            known = self.keep(known.unionByName(fresh_known), "known")
            contexts = self.keep(contexts.unionByName(more), "contexts")
        out, path = store(found.join(known, "w").join(accepted.select("pattern", "kind"), ["pattern", "kind"]).select("k1", "k2", "i", "kind").distinct(), "learned")
        remove(self.corpus.sparkSession, *self.scratch)
        return out

    def identifiers(self, found: DataFrame, accepted: DataFrame, known: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """The new identifiers with their kind, and their contexts; None if there are none."""
        edges = found.select("w", "pattern").distinct().join(accepted, "pattern").join(known.select("w"), "w", "left_anti")
        chance = edges.groupBy("w", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("right"))))).alias("p")).where(F.col("p") >= self.precision)
        likely = self.keep(chance.groupBy("w").agg(F.max_by("kind", F.struct("p", "kind")).alias("kind")), "likely")
        if likely.isEmpty():
            return None
        at = self.keep(self.meet(places.select("w", "patterns"), likely, "w").groupBy("w", "kind", "patterns").agg(F.count("*").alias("n")), "at")
        total = at.groupBy("w", "kind").agg(F.sum("n").alias("total"))
        inside = at.select("w", "kind", "n", F.explode("patterns").alias("pattern")).join(accepted.select("pattern", "kind"), ["pattern", "kind"]).groupBy("w", "pattern").agg(F.sum("n").alias("n"))
        often = total.join(inside.groupBy("w").agg(F.max("n").alias("n")), "w").where(F.col("n") >= self.share * F.col("total"))
        new = self.keep(often.select("w", "kind"), "identifiers")
        if new.isEmpty():
            return None
        more = at.join(new.select("w"), "w", "left_semi").select("kind", F.col("w").alias("value"), "n", F.explode("patterns").alias("pattern"))
        return new, more.groupBy("pattern", "kind", "value").agg(F.sum("n").alias("n")).select("pattern", "kind", "value", "n")


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, precision: float = 0.7, share: float = 0.1, broadcast_rows: int = 500_000,
) -> DataFrame:
    """Per row: doc_id, email, ip, card, phone, secret (arrays of start, end, value) and more (kind, start, end found by
    context).

    Places count code points, ends are exclusive. Null text counts as empty and has none. Rows that repeat, in id or
    text or both, are rows of their own. An empty table gives no rows. Other columns are not read. What context finds
    never overlaps what a fixed pattern has found.
    support: different known identifiers that a pattern must hold. precision: the least share of a pattern's occurrences
    that hold a known identifier, and the least chance of a new identifier. share: the least share of a new identifier's
    occurrences that stand in an accepted pattern, so that common words aren't taken for identifiers. Up to broadcast_rows
    patterns or identifiers (16 bytes each) are broadcast; beyond it the same joins are shuffled.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    # Rows with the same id and text are alike; they are known by a hash of both.
    rows = rows.select("doc_id", "text", *(F.xxhash64(F.lit(s), F.col("doc_id").isNull(), "doc_id", "text").alias(k) for s, k in ((1, "k1"), (2, "k2"))))
    scanned, _ = store(rows.select("doc_id", "k1", "k2", *(base_spans(F.col("text"), k).alias(k) for k in SEEDS)), "scanned")
    corpus, path = store(_tokens(rows, "k1", "k2"), "tokens", "zstd")
    learned = Bootstrap(corpus, support, precision, share, broadcast_rows).run()
    remove(spark, path)

    wanted = learned.groupBy("k1", "k2").agg(F.collect_list(F.struct("i", "kind")).alias("at"))
    few = F.broadcast(wanted) if learned.count() <= broadcast_rows else wanted
    span = lambda t, i, s, found, gaps: F.struct(s.alias("start"), (s + F.length(F.rtrim(t, F.lit(TRIMMED)))).alias("end"))
    placed = rows.join(few, ["k1", "k2"]).select("k1", "k2", "at", matches(F.col("text"), TOKEN, span).alias("all"))
    more = F.array_sort(F.transform("at", lambda a: F.struct(a["kind"].alias("kind"), F.get("all", a["i"])["start"].alias("start"), F.get("all", a["i"])["end"].alias("end"))))
    more, _ = store(placed.select("k1", "k2", more.alias("more")).dropDuplicates(["k1", "k2"]), "more")
    apart = F.filter("more", lambda m: reduce(Column.__and__, (~F.exists(k, lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"])) for k in SEEDS)))
    return scanned.join(more, ["k1", "k2"], "left").withColumn("more", F.when(F.col("more").isNotNull(), apart)).drop("k1", "k2")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end of all spans, by kind and start,
    comma-joined; secrets come last), and how many of them are secrets by form, by context, and in all."""
    text = lambda k, s: F.concat(F.lit(k + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))

    def listed(kind: str) -> Column:
        return F.transform(kind, lambda s: text(kind, s))

    base = F.array_join(F.concat(*map(listed, KINDS)), ",")
    more = F.coalesce("more", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))

    def merged(kind: str) -> Column:
        extra = F.filter(more, lambda m: m["kind"] == kind)
        both = F.sort_array(F.concat(F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), F.transform(extra, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))))
        return F.transform(both, lambda s: text(kind, s))

    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*(merged(k) for k in SEEDS)), ",").alias("spans"),
        F.size("secret").cast("long").alias("n_secret"),
        F.size(more).cast("long").alias("n_by_context"),
        reduce(Column.__add__, (F.size(k) for k in SEEDS), F.size(more)).cast("long").alias("n_spans"),
    )
