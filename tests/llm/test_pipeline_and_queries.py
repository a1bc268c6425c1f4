"""The registered queries and the pipeline on the smallest tables."""

import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm.corpus import SCHEMA
from tidegrid.llm import queries as llm
from tidegrid.llm.secrets import MARK, find_secrets, redact

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't there")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = llm.queries()[name](spark, DATA)
    want = con.sql(llm.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_contract_columns(spark):
    types = {n: dict(f(spark, DATA).dtypes) for n, f in llm.queries().items()}
    assert types["op1_vantage_point_search"] == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert types["op2_best_fit_packing"] == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    assert {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}.items() <= types["op4_secret_scan"].items()
    assert types["op7_substring_dedup"] == {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}
    assert {"held_out": "boolean", "lang_pred": "string", "score": "double"}.items() <= types["op10_language_id"].items()
    assert len(types) == 13


def test_language_of_held_out_documents(spark):
    lang = dict(zip(*(pq.read_table(f"{DATA}/documents.parquet")[c].to_pylist() for c in ("doc_id", "lang"))))
    rows = llm.queries()["op10_language_id"](spark, DATA).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held if lang[r["doc_id"]]]) > 0.95


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    known = {r["doc_id"]: r for r in docs.collect()}
    kept = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA)
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == columns
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.8 * sizes[0] and sizes[2] < sizes[1]
    for r in kept.collect():
        assert r["text"] == known[r["doc_id"]]["text"] or "[secret]" in r["text"]
        assert r["n_chars"] == len(r["text"]) or "[secret]" not in r["text"]
        assert not re.search(r"(?<![0-9a-f])[0-9a-f]{16}", r["text"])
    out = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert out.select("doc_id").distinct().count() == sizes[-1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]


def test_pipeline_on_hard_rows(spark):
    hard = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (None, "the words of a text without an id", "en", "s", 5), (4, "12 34", None, "s", 5), (5, "some words of english text here", "en", "s", 1), (5, "some words of english text here", "en", "s", 1)]
    docs = spark.createDataFrame(hard, DOCS)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() == (5 if name == "near_duplicates" else 6)
        assert stage(spark, spark.createDataFrame([], DOCS), DATA).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, DATA).count() == 3
    assert "doc_id" in SCHEMA


def test_rows_without_id_and_with_shared_ids_are_judged(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first()["text"]
    gen = np.random.default_rng(2)
    a, b, c, d = (" ".join(f"w{i}" for i in gen.integers(0, 900, 80)) for _ in range(4))
    rows = [(1, a), (None, a), (None, a + " x"), (2, b), (2, c), (3, c), (None, d), (4, f"{b} {item}"), (None, f"{d} {item}"), (2, f"{c} {c} {item}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    stages = dict(corpus_pipeline.STAGES)
    kept = sorted((r["text"] for r in stages["near_duplicates"](spark, docs, DATA).collect()), key=str)
    left = [t for _, t in rows if t in kept]
    assert len(kept) == 7 and set(kept) == {a, b, c, d, f"{b} {item}", f"{d} {item}", f"{c} {c} {item}"} and len(left) >= 7
    clean = stages["decontamination"](spark, docs, DATA)
    assert sorted(r["text"] for r in clean.collect()) == sorted(t for _, t in rows if item not in t) and clean.columns == docs.columns


def test_secrets_are_covered_by_the_worker_that_finds_them(spark):
    key = "password = 'hJ7kQ2mZx9LpT4vR'"
    rows = [(1, f"a {key} b {key}", "en", "s", 9), (2, "clean text", "en", "s", 10), (3, None, "en", "s", None), (4, "", "en", "s", 0), (5, f"\u00e9\U0001f600 {key} {'0f' * 12}", None, None, 1), (5, key, None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    want = redact(find_secrets(docs, most=64))
    got = find_secrets(docs, most=64, mark=MARK)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    out = dict(corpus_pipeline.STAGES)["secrets"](spark, docs, DATA)
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, want.select("doc_id", "text").collect()))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1  # else each task of the stage holds two Python workers


def test_a_missing_library_leaves_the_other_queries(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.split(".")[:2] == ["tidegrid", "llm"]]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    with pytest.warns(UserWarning, match="left out"):
        found = entry.queries()
    assert "depth_average" in found and "pipeline" not in found and not [n for n in found if re.match(r"op\d", n)]
