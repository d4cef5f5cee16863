"""The corpus operators on small and odd tables, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.llm import attention, common, decontaminate, exact_dedup, graph, language, line_dedup, lm, ngram_join, packing, pii, quality, sharding

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long"
VOCABULARY = [a + b for a in "the and over lazy quick brown fox jumps dog river stone".split() for b in ("", "s", "ing", "ed")]


def corpus(n=60, seed=1):
    """Prose with copies, near copies, shared lines, nulls, empties, repeated rows and one long text; a column named uid."""
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice(VOCABULARY) for _ in range(k))
    shared = [line(14) for _ in range(4)]
    texts = ["\n".join([line(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 5))] + [rng.choice(shared)] * (rng.random() < 0.4)) for _ in range(n)]
    for i in range(0, n, 6):
        ws = texts[i].split(" ")
        ws[len(ws) // 2] = "changed"
        texts += [texts[i], " ".join(ws), texts[i].upper()]
    texts += [None, None, "", "   ", "a", "a", "Word", "\n\n", line(6000)]
    rows = [(i, t, "en", "s", 1, 7) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (3, "other text here", None, None, None, None), (None, texts[0], "en", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(4).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


class _Cluster:
    """A session of a cluster without a shared folder."""

    sparkContext = type("Context", (), {"master": "yarn", "getCheckpointDir": lambda self: None})()
    conf = type("Conf", (), {"get": lambda self, key, default=None: default})()


def test_no_machine_local_scratch_on_a_cluster(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(_Cluster())
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_scratch_tables_are_removed(spark, docs):
    """What is left of an operator is what its result reads."""
    import os

    folder = common.shared_dir(spark).removeprefix("file://") + "/terrasift"
    for run, left in ((lambda: ngram_join.similar_components(docs), {"components"}), (lambda: pii.find_pii(docs), {"scanned", "more", "learned"}), (lambda: line_dedup.dedup_lines(docs), {"gone"})):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        run().count()
        assert {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before} == left


def test_any_column_names_pass_through_arrow(spark):
    df = spark.createDataFrame([(1, "a", None)], "`a.b` int, c0 string, c1 double")
    out = common.map_rows(df, lambda batches: batches)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "a", None)]
    assert common.unused(["X", "x_"], "x") == "x__"


def test_tasks_are_handed_rows_in_small_batches(spark):
    df = spark.range(0, 600, 1, 1).select("id", F.repeat(F.lit("x"), 20_000).alias("text"))

    def sized(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([b.nbytes] * b.num_rows)], ["id", "text", "n"])

    rows = common.map_rows(df, sized, n="long").agg(F.count("*"), F.max("n")).first()
    assert rows[0] == 600 and rows[1] <= common.BATCH_BYTES + 21_000  # 12 MB came at once before


# 1


def test_sharding(spark, docs, none, tmp_path):
    table = sharding.ShardedTable(spark, f"file://{tmp_path}/t")
    docs = docs.withColumns({"run": F.lit(4), "shard": F.lit(None).cast("string"), "__name": F.lit("n")})
    three = spark.createDataFrame(docs.limit(3).collect(), docs.schema)
    table.append(docs, 5)
    table.append(three, 5)
    before = table.manifest()[1]
    assert all(r.rows <= 5 * r.shards for r in before) and len(before) <= 8
    table.compact(target_bytes=1 << 20, least_runs=3)
    after = table.manifest()[1]
    assert sum(r.shards for r in after) < sum(r.shards for r in before) / 3 and sum(r.rows for r in after) == sum(r.rows for r in before) == docs.count() + 3
    assert rows_of(table.read(2)) == rows_of(table.read()) == rows_of(docs.unionByName(three)) != rows_of(table.read(1))
    with pytest.raises(RuntimeError, match="another writer"):
        table.commit(1, after, docs.schema)
    assert table.vacuum() > 0 and len(table.versions()) == 1
    assert table.read().columns == docs.columns and table.read().count() == docs.count() + 3
    empty = sharding.shard(none, f"file://{tmp_path}/e")
    assert empty.read().count() == 0
    with pytest.raises(ValueError, match="columns"):
        empty.append(docs.select("doc_id"))


def test_shards_come_near_the_target(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).repartition(8)
    table = sharding.shard(rows, f"file://{tmp_path}/t", rows_per_shard=100, target_bytes=200_000)
    runs = table.manifest()[1]
    assert 50_000 < sum(r.bytes for r in runs) / sum(r.shards for r in runs) < 400_000 and len(runs) <= 4
    assert table.read().exceptAll(rows).isEmpty() and table.read().count() == 20_000


# 2


def brute_leaks(text, items, window):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    ws, hit, names = word(text), set(), set()
    for name, item in items:
        iw = word(item)
        n = min(window, len(iw))
        for w in {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else ():
            for p in range(len(ws) - n + 1):
                if tuple(ws[p : p + n]) == w:
                    hit |= set(range(p, p + n))
                    names.add(str(name))
    return len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def brute_longest(text, items, window):
    """Longest match that holds a window (or a whole shorter item); the first here, then by item and place there."""
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    ws, best = word(text), []
    for name, item in items:
        iw = word(item)
        for p in range(len(ws)):
            for q in range(len(iw)):
                n = 0
                while p + n < len(ws) and q + n < len(iw) and ws[p + n] == iw[q + n]:
                    n += 1
                if n and n >= min(window, len(iw)):
                    best.append((-n, p, str(name), q))
    if not best:
        return 0, None, None, None
    n, p, name, q = min(best)
    return -n, p, name, q


def test_longest_match_in_repetitive_text():
    items = [("a", "x " * 3000), ("b", "y " * 11 + "x " * 12), ("c", "z z")]
    block = decontaminate.Block([(n, decontaminate.words(t.encode())) for n, t in items], 10)
    docs = ["x " * 5000, "y " * 30 + "x " * 11 + "z z", "z z x z z", "x " * 9]
    ends, place, which = decontaminate._places([d.encode() for d in docs], block, 1 << 20)
    at, length, _, _ = decontaminate._longest(place, which, block, int(ends[-1]))
    begins = np.r_[0, ends[:-1]]
    doc = np.searchsorted(ends, at, side="right")
    assert [int(length[doc == k].max(initial=0)) for k in range(4)] == [3000, 22, 2, 0] and len(at) < 50_000 and (at >= begins[doc]).all()


@pytest.mark.parametrize("bounds", [{}, {"block_words": 5, "shard_words": 40, "shard_bytes": 300}])
def test_decontaminate(spark, docs, none, bounds):
    texts = [r[1] for r in corpus()]
    items = [(1, " ".join(texts[0].split()[:13])), (10, "é ß " + texts[-6 - 5][:0]), (2, "over, THE river"), (3, None), (4, ""), (5, texts[1].upper()), (5, texts[2]), (6, "Word")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(decontaminate.find_matches(docs, benchmark, **bounds))
    want = [(r[0], *brute_leaks(r[1], items, 10)) for r in corpus()]
    assert rows_of(got) == sorted(want, key=str)
    for r in decontaminate.find_matches(docs, benchmark, **bounds).collect():
        assert any(brute_longest(x[1], items, 10) == (r.longest, r.longest_at, *((r.longest_item, r.longest_item_at) if r.longest else (None, None))) for x in corpus() if x[0] == r.doc_id)
    clean = decontaminate.decontaminate(docs, benchmark, **bounds)
    assert rows_of(clean) == sorted((r for r in corpus() if not brute_leaks(r[1], items, 10)[-1]), key=str) and clean.columns == docs.columns
    assert decontaminate.find_matches(none, benchmark).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == docs.count()


@pytest.mark.parametrize("top", [3, 900, 4100, 33000, 3_000_000])
@pytest.mark.parametrize("least", [1, 4, 7, 10])
def test_suffix_array_is_sorted(top, least):
    rng = np.random.default_rng(top)
    for n in (0, 1, 9, 400):
        token = rng.integers(0, 3, n) + (rng.random(n) < 0.8)
        cut = lambda i: tuple(token[i : i + 10].tolist()[: next((j for j, x in enumerate(token[i : i + 10]) if x == 0), 10)])
        order = decontaminate.suffix_array(token, 10, least, top)
        assert sorted(order.tolist()) == [i for i in range(n) if len(cut(i)) >= least]
        assert [cut(i) for i in order] == sorted(cut(i) for i in order)


@pytest.mark.parametrize("vocabulary", [4200, 33000])
def test_decontaminate_with_a_large_vocabulary(vocabulary):
    items = [(str(k), " ".join(f"w{i}" for i in range(k, k + 10))) for k in range(0, vocabulary, 10)] + [("short", "w11 w12 w13 w14 w15 w16 w17")]
    block = decontaminate.Block([(name, decontaminate.words(t.encode())) for name, t in items], 10)
    run = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    docs = [f"{run(20, 30)} unknown", f"{run(20, 29)} w40 unknown", f"{run(20, 30)}", f"{run(20, 29)} w3", f"{run(11, 18)} other {run(11, 17)} w9 other", f"{run(20, 30)} w9"] * 3
    ends, place, which = decontaminate._places([d.encode() for d in docs], block, 1_000_000)
    begins, got = np.r_[0, ends[:-1]], [set() for _ in docs]
    for p, w in zip(place, which, strict=True):
        k = int(np.searchsorted(ends, p, side="right"))
        got[k].add((int(p - begins[k]), int(block.lengths[w])))
    want = [{(i, n) for _, t in items[:4] + items[-1:] for n in [len(t.split())] for i in range(len(d.split())) if d.split()[i : i + n] == t.split()} for d in docs]
    assert got == want


# 3


def test_line_dedup(spark, docs, none):
    lines, rows = [], corpus()
    for r in sorted({(r[0] is None, r[0], r[1]) for r in rows}, key=str):
        for k, raw in enumerate((r[2] or "").split("\n")):
            lines.append((r[1], r[2], k, raw, frozenset(raw.lower().split())))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    out = {(r.doc_id, r.source, r.n_chars): r for r in got.collect()}
    assert got.count() == len(rows) and all(r.n_lines == len((r.text or "").split("\n")) + r.n_removed - (r.text == "" and r.n_removed == r.n_lines) for r in out.values() if r.text is not None)
    # Of lines similar to each other just one that is earliest has none before it; every line kept has none before it.
    kept = [(r.doc_id, ln) for r in {(r.doc_id, r.text): r for r in got.collect()}.values() for ln in (r.text or "").split("\n") if ln.split()]
    similar = lambda a, b: 180 * len(a & b) >= 80 * (len(a) + len(b))
    sets = [frozenset(ln.lower().split()) for _, ln in kept]
    assert not [1 for i, a in enumerate(sets) for b in sets[:i] if similar(a, b) and kept[i][0] is not None and kept[i][0] != 3]
    assert {s for *_, s in lines if s and not any(similar(s, t) for t in sets)} == set()
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_are_cut_from_a_text_made_plain_once(spark):
    """White space, lower case and its context (the last sigma of a word) are those of each line by itself."""
    texts = ["one\ttwo\x0bthree\fFOUR\r\nΟΔΟΣ\nΣ", "ΟΔΟΣ\nA\r\n\nÉÉ  İx", None, "", " \t\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    text, alone = F.coalesce("text", F.lit("")), lambda x: F.split(F.translate(F.lower(x), "\t\x0b\f\r", "    "), " ", -1)
    got = df.select(F.transform(line_dedup.lines_of(text), line_dedup.words_of).alias("a"), F.transform(F.split(text, "\n", -1), alone).alias("b"))
    assert all(r.a == r.b for r in got.collect())
    hashes = df.select(F.explode(line_dedup.lines_of(text)).alias("x")).select(line_dedup.hashes_of(F.col("x")).alias("h")).collect()
    assert [len(r.h) for r in hashes] == [4, 1, 1, 1, 1, 0, 2, 0, 0, 0, 0]
    plan = df.select(F.explode(line_dedup.lines_of(text)).alias("x")).select(F.explode(line_dedup.words_of(F.col("x"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_words_are_counted_once(spark, monkeypatch):
    written, keep = [], line_dedup.LineJoin.keep
    monkeypatch.setattr(line_dedup.LineJoin, "keep", lambda self, df, what: written.append(what) or keep(self, df, what))
    docs = spark.createDataFrame([(1, "a b\nB c"), (2, None), (3, "a  a\td")], "doc_id long, text string")
    held, bits = line_dedup.LineJoin(docs, "doc_id", "text", 80, 1000).rarity()
    words = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1), ("d", 1), ("", 2)], "w string, n int")
    often = dict.fromkeys(range(1 << bits), 0)
    for h, n in words.select(F.xxhash64("w"), "n").collect():
        often[h % (1 << bits)] += n
    assert not written and bytes(min(line_dedup.level(n), 126) for n in often.values()) == held


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    """What counts words and what codes them read the hashes that are written once (they cut the texts twice before)."""
    from zlib import crc32

    cut, words_of = [], line_dedup.words_of
    monkeypatch.setattr(line_dedup, "words_of", lambda line: cut.append(line) or words_of(line))
    rows = [(1, "a b c d e f g h i j\n"), (2, "a b c d e f g h X y"), (None, None), (3, "b  a\n\nA b\tb")]
    join = line_dedup.LineJoin(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 80, 1000)
    lines = join.lines().orderBy("doc", "line").collect()
    assert len(cut) == 1 and len(join.scratch) == 1
    assert [(r.doc, r.line, r.n) for r in lines] == [(1, 0, 10), (2, 0, 10), (3, 0, 2), (3, 2, 2)]
    assert [[c >> 56 for c in r["first"]] for r in lines] == [[line_dedup.level(n) for n in (1, 1, 2)]] * 2 + [[], []]
    name = [(r.k1, r.k2) for r in lines]
    assert name[2] == name[3] and len(set(name)) == 3
    assert [crc32(bytes([b])) >> 24 & 127 for b in line_dedup.BY_CRC[:128]] == list(range(128))


def test_short_lines_are_deduplicated(spark):
    import corpus_pipeline

    texts = ["All rights reserved.\nsome words of its own here", "other words that are quite new\nall rights RESERVED. all", "one two three four\n\nx", "one two three four five\n\nrights reserved.", "X", "one two three\n  "]
    rows = [(i, t, "en", "s", 1, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {0: texts[0], 1: "other words that are quite new", 2: texts[2], 3: "\nrights reserved.", 4: "", 5: texts[5]}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.near_duplicate_lines(spark, df, "").collect()} == {k: t for k, t in want.items() if k != 4}


# 4


def test_packing(spark, docs, none):
    got = packing.pack(docs, WORD_BPE, capacity=64, block=50, islands=2).toPandas()
    tokenizer = packing._tokenizer(WORD_BPE)
    want = []
    for r in corpus():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want += [(r[0], k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    key = lambda rows: sorted(str(tuple(None if v != v else int(v) for v in r)) for r in rows)
    assert key(got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(lambda d: d.notna(), float("nan")).itertuples(index=False)) == key([tuple(float("nan") if v is None else v for v in r) for r in want])
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 64 and (g.offset == g.length.cumsum() - g.length).all()
    assert got.sequence_id.nunique() <= 1.05 * got.length.sum() / 64 + 8
    assert packing.pack(none, WORD_BPE).count() == 0


def test_crossover_keeps_all_pieces():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 200)
    a, b = (packing.founded(lengths, 64, rng) for _ in range(2))
    for _ in range(50):
        of, fill = packing.crossover(lengths, a, b, 64, rng)
        assert (np.bincount(of, weights=lengths, minlength=len(fill)) == fill).all() and fill.max() <= 64 and fill.min() > 0 and len(of) == 200


def test_evolution_makes_the_packing(spark):
    """From random orders, well above what the tokens allow, to within a sequence of it; blocks meet on a second level."""
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 14)))) for i in range(1500)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    packed, story = packing.pack_with_story(df, WORD_BPE, capacity=64, block=500)
    rows, told = packed.toPandas(), story.toPandas()
    assert (told.founded > told.least * 1.01).any() and (told.packed <= told.founded).all() and told.generations.sum() > 0 and told.level.max() == 1
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 64) + 2
    again = packing.pack_with_story(df, WORD_BPE, capacity=64, block=500)[0].toPandas()
    assert sorted(map(tuple, rows.to_numpy().tolist())) == sorted(map(tuple, again.to_numpy().tolist()))


def test_word_encoder_is_the_tokenizer():
    rng, e = random.Random(2), packing.WordEncoder(WORD_BPE)
    parts = ["'s", "DON'T", "É", "ß", "ΣΑΣ", "İ", "²", "汉", " ", "\x1c", "\x85", "😀", "<|endoftext|>", "<|", "Bc", "12", "!?", "‍", "́", "\t", "\n", "\x00"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert e.encode(t.encode()) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes()


# 5


def test_language(spark, none):
    words = {"en": "the quick brown fox with this that and", "de": "der schnelle braune fuchs mit und nicht", "fr": "le rapide renard brun avec est dans une"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(20)), lang, None, None, None) for i in range(90) for lang in words]
    odd = [(1000, None, "en", None, None, None), (1001, "", "en", None, None, None), (1002, "123 !?", None, None, None, None), (1003, "Der FUCHS und " * 2000, None, None, None, None)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(4)
    profiles = language.fit(df, F.col("doc_id") % 3 != 1)
    out = {(r.doc_id, r.lang): r for r in language.predict(df, profiles).collect()}
    assert profiles.languages == ["de", "en", "fr"] and all(out[i, lang].lang_pred == lang for i, _, lang, *_ in rows)
    assert [out[i, lang].lang_pred for i, _, lang, *_ in odd] == ["und", "und", "und", "de"] and all(0 <= r.score <= 1 for r in out.values())
    assert language.identified(df, profiles).columns == df.columns and language.identified(df, profiles).count() == len(rows) + 1
    nothing = language.fit(none)
    assert {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"} and language.predict(none, profiles).count() == 0


def brute_language(train, text, dims=1024, seed=7):
    """Plain hyperdimensional computing, letter by letter: the language and score of a text."""

    def vector(t):
        row, total = [0, *[ord(c) if c.isalpha() else 0 for c in (t or "").lower()], 0], np.zeros(dims)
        row = [x for i, x in enumerate(row) if not (i and x == row[i - 1] == 0)]
        found = {}
        for g in zip(row, row[1:], row[2:], strict=False):
            if g[1]:
                found[g] = found.get(g, 0) + 1
        for g, n in found.items():
            v = np.ones(dims)
            for k, letter in enumerate(g):
                v = v * np.roll(language.letter_vectors(np.array([letter]), dims, seed)[0], 2 - k)
            total += n**0.5 * v
        return total / np.linalg.norm(total) if found else None

    means = {}
    for t, lang in train:
        if lang and (v := vector(t)) is not None:
            means.setdefault(lang, []).append(v)
    means = {k: np.mean(v, axis=0) for k, v in sorted(means.items())}
    common, d = np.mean(list(means.values()), axis=0), vector(text)
    if d is None:
        return "und", 0.0
    cos = {k: float((d - common) @ (m - common) / np.linalg.norm(d - common) / np.linalg.norm(m - common)) for k, m in means.items()}
    best = max(cos, key=cos.get)
    return best, (1 + cos[best]) / 2


def test_language_is_plain_hyperdimensional_computing(spark):
    rng = random.Random(9)
    words = {"en": "the quick brown fox", "ru": "быстрая лиса прыгает", "zh": "敏捷的 棕色 狐狸", "de": "der schnelle fuchs über"}
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(rng.randrange(1, 9))), k) for i, k in enumerate(list(words) * 6)]
    rows += [(100, None, "en"), (101, "..", "de"), (102, "the 狐狸 über x", None), (103, "q", None), (103, "q", None), (104, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 4)) for r in language.predict(df.withColumn("read", F.lit(1)), language.fit(df), keep=["doc_id", "read"]).collect())
    assert got == sorted((i, *((b := brute_language([r[1:] for r in rows], t))[0], round(b[1], 4))) for i, t, _ in rows)
    assert len({letter.tobytes() for letter in language.letter_vectors(np.arange(97, 2000), 1024, 7)}) == 1903
    with pytest.raises(ValueError, match="lang_pred"):
        language.predict(df.withColumn("Lang_Pred", F.lit(1)), language.fit(df))


def test_grams_do_not_depend_on_chunks(monkeypatch):
    text = "The quick, brown fox. É à " * 9
    whole = language.grams(text.encode(), 3)
    monkeypatch.setattr(language, "CHUNK", 7)
    assert sorted(whole.tolist()) == sorted(language.grams(text.encode(), 3).tolist())


# 6


def brute_components(rows, n, percent):
    def shingles(t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()

    sets, root = [shingles(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    lowest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            lowest[find(i)] = min(r[0], lowest.get(find(i), r[0]))
    return [(r[0], len(sets[i]), lowest.get(find(i)), find(i)) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent", "bounds"), [(4, 85, {}), (2, 60, {"slice_bytes": 500, "broadcast_rows": 0}), (2, 50, {"meet": 2})])
def test_ngram_join(docs, none, n, percent, bounds):
    got = ngram_join.similar_components(docs, n, percent, **bounds).select("doc_id", "n_shingles", "component_id")
    want = brute_components(corpus(), n, percent)
    assert rows_of(got) == sorted((w[:3] for w in want), key=str)
    if not bounds:
        left = ngram_join.one_of_each(docs, n, percent)
        parts = [root for _, k, _, root in want if k]
        assert left.columns == docs.columns and left.where("text rlike '[^ \\n]'").count() == len(set(parts))
        assert ngram_join.similar_components(none).count() == 0


def test_products_are_the_overlaps():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 80).astype(np.uint64) * np.uint64(2)
    rows = [np.unique(rng.choice(base, int(rng.integers(1, 60)))) for _ in range(60)]
    column, row = np.concatenate(rows), np.repeat(np.arange(60), [len(r) for r in rows])
    order = np.argsort(column, kind="stable")
    size = np.array([len(r) for r in rows])[row]
    a, b, na, nb, shared = ngram_join.block_product(column[order].view(np.int64), row[order], size[order], 30)
    want = {(i, j): len(np.intersect1d(rows[i], rows[j])) for j in range(60) for i in range(j) if 100 * min(len(rows[i]), len(rows[j])) >= 30 * max(len(rows[i]), len(rows[j]))}
    assert {(i, j): c for i, j, c in zip(a.tolist(), b.tolist(), shared.tolist(), strict=True)} == {k: c for k, c in want.items() if c}
    i, j = np.array(list(want)).T
    begin = np.r_[0, np.cumsum([len(r) for r in rows])]
    for most in (50, 10**6):
        good = ngram_join.tile_product(i, j, column, begin, 40, most)
        assert good.any() and good.tolist() == [140 * c >= 40 * (len(rows[x]) + len(rows[y])) for (x, y), c in want.items()]


def test_similar_pairs_and_links(docs):
    rows = corpus()
    for bounds in ({}, {"meet": 2}):
        pairs, members = ngram_join.similar_pairs(docs, 2, 60, **bounds)
        sets = [{tuple(ws[i : i + 2]) for i in range(len(ws) - 1)} if len(ws) > 1 else {tuple(ws)} if ws else set() for ws in ((r[1] or "").lower().split() for r in rows)]
        links = [sum(160 * len(s & t) >= 60 * (len(s) + len(t)) for j, t in enumerate(sets) if j != i) if s else 0 for i, s in enumerate(sets)]
        assert sorted((str(r.doc_id), r.n_links) for r in members.collect()) == sorted((str(r[0]), k) for r, k in zip(rows, links, strict=True))
        different = {frozenset(s) for s in sets if s}
        assert pairs.count() == sum(160 * len(s & t) >= 60 * (len(s) + len(t)) for s in different for t in different if s != t) // 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 3), (7, 7)] + [(259, i) for i in range(200, 259)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, **{i: 200 for i in range(200, 260)}}


# 7


def test_quality(spark, docs, none):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(60)) if i % 3 else "$$$ ### " * rng.randrange(5, 40), None, None, None, None) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (5, None), (1, 0)], "doc_id long, quality int")
    model = quality.fit(df, labels, F.col("doc_id") % 5 != 0)
    out = {r.doc_id: r for r in quality.score(df, model, keep=["doc_id"]).collect()}
    held = [i for i in range(300) if i % 5 == 0]
    assert sum(out[i].predicted == (i % 3 > 0) for i in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in out.values()) and 900 in out
    assert quality.score(none, model).count() == 0
    one_class = quality.fit(df, labels.where("quality = 1"))
    assert {round(r.score, 6) for r in quality.score(df, one_class, keep=["doc_id"]).collect()} == {round(float(one_class.score(np.zeros((1, 4)))[0]), 6)}
    assert quality.score(docs, quality.fit(docs, labels.limit(0)), keep=["doc_id"]).where("score != 0.5").count() == 0


def test_quality_learns_from_whole_texts(spark):
    rng = random.Random(6)
    line = lambda words, k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(i, line(VOCABULARY, 3500) + (line(VOCABULARY, 4000) if i % 2 else "$$$ ### " * 3000)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert min(len(t[: t.find("$")]) for _, t in rows[::2]) > 16_000
    model = quality.fit(df, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"), F.col("doc_id") < 30)
    out = {r.doc_id: r.score for r in quality.score(df, model, keep=["doc_id"]).collect()}
    assert all((out[i] > 0.5) == (i % 2 == 1) for i in range(30, 40))


def test_quality_is_compressed_sizes(spark):
    """Scores worked out plainly: each text compressed alone with either dictionary, and the logistic curve."""
    import zstandard

    rng = random.Random(7)
    good = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, "buy $$$ now!! " * rng.randrange(1, 30)) for i in range(60)]
    odd = [(900, None), (901, ""), (902, good[0] * 900), (903, good[1]), (903, good[1]), (None, good[2])]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows] + [(901, 1), (901, 0), (903, 1), (None, 1), (5, 7)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    assert all(d for d in (model.good, model.bad))
    out = sorted(((str(r.doc_id), r.score, r.predicted) for r in quality.score(df, model, keep=["doc_id"]).collect()))
    want = []
    for i, t in rows + odd:
        raw = (t or "").encode()
        sizes = []
        for d in (model.good, model.bad, None):
            how = {} if d is None else {"dict_data": zstandard.ZstdCompressionDict(d)}
            sizes.append(len(zstandard.ZstdCompressor(level=model.level, write_content_size=False, **({"write_dict_id": False} if how else {}), **how).compress(raw)))
        g, b, plain = sizes
        n = len(raw) + 1
        x = (np.array([(b - g) / (b + g), (b - g) / n, np.log(n / plain), np.log(n)]) - model.mean) / model.scale
        p = float(1 / (1 + np.exp(-(x @ model.weights[:4] + model.weights[4]))))
        want.append((str(i), p, int(p >= 0.3)))
    assert [(i, k) for i, _, k in out] == [(i, k) for i, _, k in sorted(want)] and max(abs(a[1] - b[1]) for a, b in zip(out, sorted(want), strict=True)) < 1e-9
    again = quality.fit(df.repartition(5), labels)
    assert np.allclose(again.weights, model.weights) and (again.good, again.bad) == (model.good, model.bad)
    bins = quality.calibration(quality.score(df, model, keep=["doc_id"]).where("doc_id < 200"), labels).collect()
    assert sum(r.n for r in bins) == 120 and sum(r.n * abs(r.score - r.good) for r in bins) / 120 < 0.15
    with pytest.raises(ValueError, match="score"):
        quality.score(df.withColumn("SCORE", F.lit(1)), model)


# 8

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    def good(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return {"ip": lambda: all(int(x) <= 255 for x in v.split(".")), "phone": lambda: 8 <= len(d) <= 15}.get(kind, lambda: True)()

    spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if good(k, m.group())] for k, p in PII.items()}
    return *map(len, spans.values()), hashlib.sha256(",".join(sum(spans.values(), [])).encode()).hexdigest()


def test_pii(spark, none):
    rng = random.Random(5)
    parts = ["a", "b1", "@", ".", "..", "-", " ", "+", "12", "255", "300", "4", "_", "é", "(", ")", "\n", "😀", "4111111111111111", "0000"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "a@b" + ".c" * 900), (503, "1 " * 900), (504, "1.2.3.4 " * 700), (505, "9" * 900), (506, "x" * 2000)]
    out = pii.report(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"uid": F.lit(1), "email": F.lit("x")}).repartition(4)))
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out.collect()}
    assert got == {i: brute_pii(t) for i, t in rows}
    assert pii.find_pii(none).count() == 0


def test_pii_learns_contexts(spark):
    rows = [(i, f"some words before reach me at person{i}@mail.org and more") for i in range(9)] + [(50, "some words before reach me at id-7734-90211 and more"), (51, "we counted 7734-90299 of them at noon at dusk at dawn at night at home at id-7734-55555 there")]
    out = {r.doc_id: r.spans for r in pii.report(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert out[50] == "email:30:43" and out[51] == "" and out[0] == "email:30:46"


def test_pii_learns_on_both_sides_and_nothing_common(spark):
    """Contexts before, after and around; identifiers without any pattern; odd rows; common words are left alone."""
    rng, words = random.Random(12), [a + b for a in "lo mi ra tu ve".split() for b in "ban dor fen gul nor".split()]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    digest = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = [f"{prose(5)} token = \"{digest(i)}\" {prose(4)}" for i in range(8)]
    texts += [f"{prose(5)} token = \"{digest(50 + i).upper()}\" {prose(4)}" for i in range(3)]
    texts += [f"{prose(4)} 10.0.0.{i} is my host, {prose(2)}" for i in range(8)] + [f"{prose(4)} build-box_{c} is my host, {prose(2)}" for c in "xyz"]
    texts += [f"card 4111 1111 1111 1{d}11 expires {prose(3)}" for d in "1"] + [f"{prose(3)} mail to u{i}@h.org quickly {prose(2)}" for i in range(6)]
    texts += [f"{prose(3)} mail to {rng.choice(words)} quickly {prose(2)}" for _ in range(2)] + [prose(400) for _ in range(9)] + [None, "", texts[0], "token = "]
    df = spark.createDataFrame([(None if i == 3 else i % 30, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"k1": F.lit(1), "h": F.lit("x"), "email": F.lit(2)}).repartition(3)
    found = pii.find_pii(df)
    got = {}
    for r in found.collect():
        for m in r.more or []:
            got.setdefault(m.kind, []).append((r.doc_id, m.start, m.end))
    at = lambda t, w: (t.index(w), t.index(w) + len(w))
    want = [(i % 30, *at(t, w)) for i, t in enumerate(texts) if t for w in [x for x in (*(digest(50 + k).upper() for k in range(3)), *(f"build-box_{c}" for c in "xyz")) if x in t]]
    assert sorted(x for v in got.values() for x in v) == sorted(want) and set(got) == {"secret", "ip"}
    rows = pii.report(found).collect()
    assert len(rows) == len(texts) and sum(r.n_by_context for r in rows) == len(want) and sum(r.n_secret for r in rows) == 9
    assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == sorted((str(None if i == 3 else i % 30), brute_pii(t)[-1]) for i, t in enumerate(texts))


def test_pii_learns_from_what_it_learned(spark):
    texts, hops = [f"reach me at person{i}@mail.org" for i in range(9)], 6
    name = lambda h, k: f"id-{h}734-9021{k}"
    texts += [f"reach me at {name(0, k)}" for k in range(3)]
    for h in range(1, hops):  # three identifiers of the hop before, three times each, and three new ones
        texts += [f"acct{h} ref{h} {name(h - 1, k)}" for k in range(3)] * 3 + [f"acct{h} ref{h} {name(h, k)}" for k in range(3)]
    out = pii.report(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)))
    assert {r.doc_id: r.spans for r in out.collect()} == {i: f"email:{t.rindex(' ') + 1}:{len(t)}" for i, t in enumerate(texts)}


# 9


@pytest.mark.parametrize("options", [{"keep": "largest"}, {"keep": "smallest", "memtable": 7, "broadcast_hits": 0}, {"keep": "largest", "digest_bytes": 1, "memtable": 9}])
def test_exact_dedup(docs, none, options):
    out = [tuple(r) for r in exact_dedup.exact_dedup(docs, **options).collect()]
    groups = {}
    for r in corpus():
        groups.setdefault(r[1] or "", []).append(r[0])
    pick = max if options["keep"] == "largest" else min
    want = {t: pick(i for i in ids if i is not None) for t, ids in groups.items()}
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert sorted((i, sha[s]) for i, *_, s in out if i is not None) == sorted((r[0], r[1] or "") for r in corpus() if r[0] is not None)
    assert all(k == want[sha[s]] and n == len(groups[sha[s]]) for _, k, n, _, s in out)
    assert sorted(s for *_, kept, s in out if kept) == sorted(sha) and all(i == k for i, k, _, kept, _ in out if kept)
    assert exact_dedup.exact_dedup(none).count() == 0


# 10


def test_attention_gradients():
    shape = attention.Shape(classes=5, dims=4, hidden=6, window=7, stride=4)
    p = attention.fresh(shape, np.full(5, 0.2))
    p = {k: v.astype(np.float64) for k, v in p.items()}
    rng = np.random.default_rng(2)
    x, y, real = rng.integers(0, 6, (3, 7)), rng.integers(0, 5, (3, 7)), rng.random((3, 7)) < 0.8
    _, g = attention.gradients(p, x, y, real)
    for name in p:
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        step = 1e-5
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][at] += step
        down[name][at] -= step
        slope = (attention.gradients(up, x, y, real)[0] - attention.gradients(down, x, y, real)[0]) / (2 * step)
        assert abs(slope - g[name][at]) < 1e-4 + 1e-3 * abs(slope), name


def test_scoring_works_positions_out_once(monkeypatch):
    """Positions that the window before has scored are looked at, and have no states of their own."""
    shape, rng, states = attention.Shape(classes=5, dims=4, hidden=6, window=8, stride=4), np.random.default_rng(2), []
    p = attention.fresh(shape, np.full(5, 0.2))
    forward = attention.forward
    monkeypatch.setattr(attention, "forward", lambda *a, **more: states.append(forward(*a, **more)) or states[-1])
    classes, bounds = rng.integers(0, 5, 41), np.array([0, 8, 40, 41])
    attention.score(p, classes, classes, bounds, shape, batch=1)
    assert sum(h.size // 4 for h in states) == 8 + (8 + 6 * 4) + 8  # the last text's only window has more than its one position


def test_scores_are_the_same_beside_other_texts():
    shape, rng = attention.Shape(classes=96, inputs=200, dims=24), np.random.default_rng(2)
    p = attention.fresh(shape, np.full(96, 1 / 96))
    p["bias"] += rng.normal(0, 1, 96).astype(np.float32)
    inputs, classes = rng.integers(0, 200, 9000), rng.integers(0, 96, 9000)
    bounds = np.r_[0, np.sort(rng.choice(9000, 80, replace=False)), 9000]
    whole = attention.score(p, inputs, classes, bounds, shape)
    for a, z in zip(bounds, bounds[1:], strict=False):
        assert (attention.score(p, inputs[a:z], classes[a:z], np.array([0, z - a]), shape) == whole[a:z]).all()


def test_embedding_gradients_are_sums():
    x, rows, like = np.array([3, 0, 3, 3]), np.arange(8, dtype=np.float32).reshape(4, 2), np.zeros((5, 2), np.float32)
    assert attention.summed(x, rows, like).tolist() == [[2, 3], [0, 0], [0, 0], [10, 13], [0, 0]]
    assert attention.summed(x[:0], rows[:0], like).tolist() == like.tolist()


def test_attention_scores_each_position_once():
    shape = attention.Shape(classes=5, dims=4, hidden=6, window=8, stride=5)
    p = attention.fresh(shape, np.full(5, 0.2))
    p["out"] *= 50
    rng = np.random.default_rng(3)
    sizes = [1, 8, 9, 0, 13, 40]
    bounds = np.r_[0, np.cumsum(sizes)]
    classes = rng.integers(0, 5, bounds[-1])
    got = attention.score(p, classes, classes, bounds, shape, batch=3)
    for a, b in zip(bounds, bounds[1:], strict=False):
        text = classes[a:b]
        for i in range(len(text)):
            w = 0 if i < shape.window else 1 + (i - shape.window) // shape.stride
            begin = w * shape.stride
            seen = np.r_[shape.classes if begin == 0 else text[begin - 1], text[begin:i]][None]
            h = attention.forward(p, seen)[-1:]
            assert abs(attention.log_probs(p, h, text[i : i + 1])[0] - got[a + i]) < 1e-4
    z = attention.forward(p, np.array([[5, 1, 2]]))
    assert abs(sum(np.exp(attention.log_probs(p, z[-1:], np.array([c]))[0]) for c in range(5)) - 1) < 1e-5


def test_training_windows_cover_whole_texts():
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    sub, shape = lm._subwords(path, pattern), attention.Shape(classes=5)
    of = (np.arange(sub.end + 1) % 5).astype(np.uint16)
    docs = [(r[1] or "").encode() for r in corpus()]
    x, y, real = lm._windows(docs, sub, of, of.astype(np.int64), shape)
    want = [of[np.r_[sub.encode(lm.split(t)), sub.end].astype(np.int64)].tolist() for t in docs]
    assert y[real].tolist() == sum(want, []) and x[real].tolist() == sum(([5, *c[:-1]] for c in want), [])
    assert shape.window - attention.Shape().stride >= shape.window // 2


def test_pairs_and_classes_are_a_distribution():
    sub = lm._subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng, shape = np.random.default_rng(4), attention.Shape(classes=96, inputs=100 + 96)
    counts = np.zeros(sub.end + 1, np.int64)
    some = rng.choice(sub.end, 3000, replace=False)
    counts[some] = rng.integers(1, 1000, 3000)
    frequent = np.argsort(-counts, kind="stable")[: lm.PAIRED].tolist()
    pairs = [(int(a), int(b), int(n)) for a, b, n in zip(rng.choice([lm.FIRST, *frequent], 4000), rng.choice(frequent, 4000), rng.integers(1, 50, 4000), strict=True)]
    classes, every = lm.Classes(counts, pairs, sub, shape), np.arange(sub.end + 1)
    assert classes.input.max() < attention.start(shape) and abs(classes.prior.sum() - 1) < 1e-9
    for before in (lm.FIRST, frequent[0], frequent[-1], int(np.flatnonzero(counts == 0)[5])):
        p = np.exp(classes.follows(np.full(len(every), before), every).astype(float))
        total = np.bincount(classes.of, weights=p, minlength=96)[np.unique(classes.of)]
        assert np.abs(total - 1).max() < 1e-3
    worth = lm.Worth(classes, sub)
    ids = sub.encode([b"brown"])
    want = float(classes.follows(np.r_[lm.FIRST, ids[:-1]], ids).sum())
    assert abs(worth([b"brown", b"fox", b"brown"]) - 2 * want - worth([b"fox"])) < 1e-9


def test_scores_do_not_depend_on_how_the_table_is_stored(spark, docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    key = lambda df: sorted((str(r.doc_id), r.n_tokens, round(r.score, 3)) for r in lm.score_texts(df, F.col("doc_id") % 3 != 1, path, pattern, shard_words=500).collect())
    assert key(docs) == key(docs.orderBy(F.desc("text")).repartition(7))


def test_a_shard_has_a_task_of_its_own(spark):
    rows = spark.range(900).select(F.pmod("id", F.lit(30)).alias("shard"), F.xxhash64("id").alias("h"), F.col("id").cast("string").cast("binary").alias("text"))
    got = lm.deal(rows, 30).select("shard", F.spark_partition_id().alias("task")).groupBy("task").agg(F.count_distinct("shard").alias("shards"), F.count("*").alias("n")).collect()
    assert len(got) == 30 and {(r.shards, r.n) for r in got} == {(1, 30)}


def test_model_learns(spark):
    """Words that only context tells apart: the model beats the share of each word in the held-out texts."""
    rng, path, pattern = random.Random(11), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tongues = [[a + b for a in "ka lo mi ru te".split() for b in "ban dor fen gul".split()], [a + b for a in "she vo wi xa yu".split() for b in "nor pel qua ris".split()]]
    rows = [(i, " ".join(rng.choice(tongues[i % 2]) + rng.choice(["", rng.choice(tongues[i % 2])]) for _ in range(120))) for i in range(400)]
    out = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") % 5 != 0, path, pattern).where("held_out")
    mean = out.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert mean[0] > mean[1]


def test_lm(spark, docs, none):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = lm.score_texts(docs, F.col("doc_id") % 3 != 1, path, pattern, top_words=5).collect()
    split = lambda t: lm.split((t or "").encode())
    train = [r for r in corpus() if r[0] is not None and r[0] % 3 != 1]
    count = {}
    for r in train:
        for w in [*split(r[1]), None]:
            count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    want = sorted((str(r[0]), len(split(r[1])) + 1, sum(w in count for w in [*split(r[1]), None]), round(sum(np.log10((count.get(w, 0) + 1) / (total + len(count) + 1)) for w in [*split(r[1]), None]), 5)) for r in corpus())
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in out) == want
    assert {r.train_tokens for r in out} == {total} and all(r.score < 0 for r in out) and all(r.held_out == (r.doc_id is None or r.doc_id % 3 == 1) for r in out)
    assert lm.score_texts(none, F.lit(True), path, pattern).count() == 0
    assert lm.score_texts(docs, F.lit(False), path, pattern).where("n_known = 0 and train_tokens = 0").count() == docs.count()
