import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.corpus import SCHEMA, frame, near_corpus
from tidegrid.llm.neighbours import FACTOR, Router, Shard, lift, nearest
from tidegrid.llm.packing import Chunked, fullest, pack, plan, suits, tokenizer_path

VECTORS = "vec_id long, embedding array<float>, label int, score double, key int"


def brute(vectors, k, every):
    known = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        known[i] = min(known.get(i, v), v)
    out = {}
    for q in known:
        if q % every == 0:
            scored = sorted(((-float((np.float32(known[q]).astype(float) * np.float32(v).astype(float)).sum()), i) for i, v in known.items() if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_factor_one_is_exact(spark):
    gen = np.random.default_rng(0)
    centres = gen.normal(size=(8, 6)) * 3
    v = [(i, [float(x) for x in np.float32(centres[i % 8] + gen.normal(size=6) * gen.uniform(0.1, 2))]) for i in range(900)]
    v += [(1000 + i, v[3][1]) for i in range(60)]  # one vector held by many
    v += [(2000 + i, [float(x) for x in gen.integers(-1, 2, 6)]) for i in range(200)]  # many ties
    v += [(3000, None), (3020, [0.0] * 6), (3040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3060, [float("nan")] * 6), (3080, [float("inf")] * 6), (None, [1.0] * 6), (3100, [1.0, 2.0]), (20, v[20][1])]
    df = spark.createDataFrame([(i, x, 1, 0.0, 2) for i, x in v], VECTORS)
    expected = brute([(i, x) for i, x in v if x is None or len(x) == 6], 5, 20)
    for rows in (4096, 100):  # one shard, and several cells and shards
        got = found(nearest(df, k=5, every=20, factor=1.0, shard_rows=rows, sample_rows=300, max_cells=6, block=16))
        assert got.keys() == expected.keys()
        for q in got:
            assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]
            assert np.allclose([s for _, s in got[q]], [s for _, s in expected[q]], rtol=0, atol=1e-12)


def test_recall_of_the_default_factor(spark):
    gen = np.random.default_rng(1)
    x = gen.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(a) for a in v], 1, 0.0, 2) for i, v in enumerate(np.float32(x))], VECTORS)
    got = found(nearest(df, shard_rows=700))
    x = np.float32(x).astype(float)
    hits = 0
    for q, near in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & {i for i, _ in near})
    assert len(got) == 150 and hits / (20 * len(got)) >= 0.9


def test_recall_of_the_default_with_mixed_norms_and_a_very_long_vector(spark):
    gen = np.random.default_rng(3)
    x = gen.normal(size=(40, 16))[gen.integers(0, 40, 3000)] + 0.2 * gen.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1::3] *= gen.uniform(0.3, 2, (1000, 1))
    for longest in (1, 10, 1000):
        x[2999] *= longest / np.linalg.norm(x[2999])
        v = np.float32(x)
        df = spark.createDataFrame([(i, [float(a) for a in y], 1, 0.0, 2) for i, y in enumerate(v)], VECTORS)
        v = v.astype(float)
        for rows in (4096, 700):
            got = found(nearest(df, shard_rows=rows))
            assert len(got) == 150
            for q, near in got.items():
                s = v @ v[q]
                s[q] = -np.inf
                assert {i for i, _ in near} == set(np.argsort(-s)[:20])


@pytest.mark.parametrize("longest", [1, 1000])
def test_recall_of_the_querys_factor(spark, longest):
    """Directions at random, norms of all sizes, one vector far longer than the others; some pairs are passed over."""
    gen = np.random.default_rng(9)
    x = gen.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[::3] *= gen.uniform(0.05, 2, (len(x[::3]), 1))
    x[3999] *= longest
    v = np.float32(x)
    df = spark.createDataFrame([(i, [float(a) for a in y], 1, 0.0, 2) for i, y in enumerate(v)], VECTORS)
    v = v.astype(float)
    for rows in (8192, 700):
        got, hits = found(nearest(df, factor=FACTOR, shard_rows=rows, crowd=1, block=64)), 0
        for q, near in got.items():
            s = v @ v[q]
            s[q] = -np.inf
            hits += len(set(np.argsort(-s)[:20]) & {i for i, _ in near})
        assert len(got) == 200 and hits / (20 * len(got)) >= 0.9
    shard = Shard(np.arange(4000), v)
    shard.search(v[:200], np.full(200, -np.inf), 21, FACTOR)
    assert shard.compared < 200 * 4000


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, 0.0, 2), (1, [0.5, 0.5], 1, 0.0, 2)], VECTORS)
    assert found(nearest(df)) == {0: [(1, 0.5)]}
    assert nearest(spark.createDataFrame([], VECTORS)).count() == 0
    assert nearest(df.where("vec_id = 1")).count() == 0


def test_pruning_bounds_hold():
    gen = np.random.default_rng(2)
    x = gen.normal(size=(2000, 4))
    most = float(np.sqrt((x * x).sum(axis=1).max()))
    router = Router(lift(x[:400], most), 9)
    q = np.column_stack([gen.normal(size=(50, 4)), np.zeros(50)])
    home, least = router.home(lift(x, most)), router.least(q)
    d = np.sqrt(((lift(x, most)[None] - q[:, None]) ** 2).sum(axis=2))
    for c in range(least.shape[1]):
        if (home == c).any():
            assert (d[:, home == c].min(axis=1) >= least[:, c] - 1e-9).all()
    best, place = Shard(np.arange(2000), x, 32).search(q[:, :4], np.full(50, -np.inf), 7, 1.0)
    assert np.allclose(np.sort(best, axis=1), np.sort(np.sort(q[:, :4] @ x.T, axis=1)[:, -7:], axis=1)) and (place >= 0).all()


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=12))
def test_plan_uses_every_piece_and_fills_best(counts):
    used = {}
    left = dict(counts)
    for combo, times in plan(counts, 40):
        assert sum(k * n for k, n in combo.items()) <= 40 and times >= 1
        lengths = sorted(left, reverse=True)
        assert lengths[0] in combo
        # no combination with the longest length is fuller
        sums = {lengths[0]}
        for k in lengths:
            for _ in range(left[k] - (k == lengths[0])):
                sums |= {s + k for s in sums if s + k <= 40}
        assert sum(k * n for k, n in combo.items()) == max(sums)
        for k, n in combo.items():
            used[k] = used.get(k, 0) + n * times
            left[k] -= n * times
            if not left[k]:
                del left[k]
    assert used == counts
    assert fullest(40, [40], {40: 1}, 40) == {40: 1}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = near_corpus(2) + ["It's 3.5, U.S. foo., bar' Don't. <|endoftext|> x", "é É, ΣΑΣ. \x1c İ½"]
    coder = Tokenizer.from_file(tokenizer_path())
    out = pack(frame(spark, texts), 256, with_ids=True).collect()
    by_doc, places = {}, {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["start"] == len(by_doc.setdefault(r["doc_id"], [])) and r["piece"] * 256 == r["start"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc[r["doc_id"]] += list(ids)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        assert by_doc[i] == coder.encode(t or "", add_special_tokens=False).ids + [0]
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(map(len, by_doc.values()))
    assert len(places) <= -(-total // 256) + 1
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunked_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    coder, chunked = Tokenizer.from_file(tokenizer_path()), Chunked(tokenizer_path())
    texts = ["", " ", "Hello, world. Hello... 'tis 42% of U.S.A., a.b. ..", "ÄÖÜ ß éÉ, straße.", "x" * 300 + ". y", "<|startoftext|> a", "a\x1fb c", "日本語 テキスト。", "naïve café, ́x", "tab\tnew\nline\x0bv\x85n\xa0b"]
    assert [list(x) for x in chunked.encode(texts)] == [coder.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ["a,b", "A. B", "don't, won't.", "3.14, 2"])
def test_chunks_do_not_change_short_texts(text):
    from tokenizers import Tokenizer

    assert list(Chunked(tokenizer_path()).encode([text])[0]) == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    made = json.load(open(tokenizer_path()))
    for i, change in enumerate([{"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(made | change))
    texts = ["Hello, World. It's 3.5", "", None, "ÄÖ x"]
    for path in (str(tmp_path / "0.json"), str(tmp_path / "1.json")):
        assert not suits(path)
        coder = Tokenizer.from_file(path)
        got = {r["doc_id"]: list(np.frombuffer(r["ids"], "<u4")) for r in pack(frame(spark, texts), path=path, with_ids=True).collect()}
        assert got == {i: coder.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert suits(tokenizer_path())
