"""The pipeline's stages on odd tables, and the whole of it against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from terrasift.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in "al be ca du en fo gi ha".split() for b in "na rst lo mi vu pex".split() for c in "di or ep us mat lin".split()]


def extra():
    values = {"n_lines": "own", "n_removed": 1, "uid": 2, "Lang_Pred": "x", "score": 0.5, "doc": "d", "th": 3, "gone": 4, "row": 5, "read": 6, "a.b": 7, "run": 8}
    return {k: F.lit(v) for k, v in values.items()}


def prose(rng, k):
    return " ".join(rng.choice(WORDS) for _ in range(k))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rng = random.Random(1)
    passage, line = prose(rng, 14), prose(rng, 9)
    rows = [[i, prose(rng, rng.randrange(30, 90)), "en"] for i in range(40)]
    rows[3][1] = rows[2][1]  # a copy
    rows[5][1] = rows[4][1] + " one more"  # a near copy
    rows[7][1] += "\n" + line
    rows[8][1] += "\n" + line.upper()  # a line that goes
    rows[9][1] = line  # a document that goes with its line
    rows[11][1] += " " + passage  # a passage of the benchmark
    rows += [[100, None, "en"], [101, "", None], [102, "12 34 ..", "en"], [103, "  \n ", "en"], [104, "1\n2 z", None], [None, prose(rng, 40), "en"], [105, prose(rng, 9000), "en"], [20, rows[20][1], "en"], [20, prose(rng, 30), None]]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("b", "x " + passage), (None, None), ("c", "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none.parquet")
    return str(path)


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_stage_on_odd_tables(spark, sf_dir, name):
    stage, docs = dict(pipeline.STAGES)[name], spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns(extra())
    out = stage(spark, docs, sf_dir)
    empty = stage(spark, docs.limit(0), sf_dir)
    assert empty.columns == out.columns and empty.count() == 0
    if name == "best_fit_packing":
        assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        return
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    rows = out.collect()
    kept, ids = {r.doc_id for r in rows}, [r.doc_id for r in rows]
    assert all((r.n_lines, r.n_removed, r.uid, r.Lang_Pred, r.score, r.gone, r["a.b"]) == ("own", 1, 2, "x", 0.5, 4, 7) for r in rows)
    every = {r.doc_id for r in docs.select("doc_id").collect()}
    gone = {"language_id": {100, 101, 102, 103}, "near_duplicate_lines": {3, 5, 9}, "similar_documents": {3, 5}, "benchmark_decontamination": {11}}[name]
    assert kept == every - gone and ids.count(20) == (2 if name == "similar_documents" else 3 if name != "near_duplicate_lines" else ids.count(20))
    if name == "near_duplicate_lines":
        texts = {r.doc_id: r.text for r in rows if r.doc_id != 20}
        before = {r.doc_id: r.text for r in docs.collect() if r.doc_id != 20}
        assert texts[8] == before[8].split("\n")[0] and texts[7] == before[7] and texts[100] is None and texts[104] == before[104]
        assert all(r.n_chars == len(r.text or "") for r in rows)


def test_run_is_the_stages_and_packs_what_is_left(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
    tokenizer, want = packing._tokenizer(public_tokenizers.path("word_bpe_49k.json")), []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        want += [(str(r.doc_id), k, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    got = pipeline.run(spark, sf_dir).collect()
    assert sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 2048) + 1
