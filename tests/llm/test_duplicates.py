import collections
import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.corpus import SCHEMA, frame, near_corpus
from tidegrid.llm.common import connected, free_name, keyed
from tidegrid.llm.neardup import _crossing, _pack, bitmaps, near_copies, signatures
from tidegrid.llm.substring import drop_repeats, lengths
from tidegrid.llm.words import mix


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_classes(texts):
    bags = {}
    for i, t in enumerate(texts):
        w = words(t)
        if w:
            bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    label = {i: i for i in range(len(texts))}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in bags:
        for j in bags:
            if i < j and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in label}


def test_near_copies_match_all_pairs(spark):
    texts = near_corpus()
    got = {r["doc_id"]: r["class_id"] for r in near_copies(frame(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_near_copies_of_repeated_rows_and_empty_tables(spark):
    docs = frame(spark, ["a b c", "a b c", None])
    out = near_copies(docs.union(docs))
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0, 0), (1, 0, 0), (2, 2, 2)]
    assert near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_with_ids(rows, similarity=0.8):
    """Class of each id, where an id is linked by any of its texts."""
    bags = []
    for i, t in rows:
        w = words(t)
        if i is not None:
            bags.append((i, collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None))
    label = {i: i for i, _ in bags}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, x) in enumerate(bags):
        for j, y in bags[:a]:
            if x and y and sum((x & y).values()) >= similarity * sum((x | y).values()):
                p, q = sorted((root(i), root(j)))
                label[q] = p
    return {i: root(i) for i in label}


def test_ids_with_several_texts_lose_no_link(spark):
    gen = np.random.default_rng(12)
    texts = near_corpus(3)
    rows = [(int(gen.integers(0, 45)), t) for t in texts] + [(None, texts[0]), (None, None)] + [(2000 + i, t) for i, t in enumerate(texts[:20])]
    rows += [(3000, texts[0]), (3000, texts[1]), (3001, texts[1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (docs, docs.orderBy(F.rand(5))):
        out = near_copies(df).collect()
        got = {r["doc_id"]: r["class_id"] for r in out}
        assert len(out) == len(got) and got.pop(None) is None
        assert got == brute_with_ids(rows)


def test_members_of_a_bucket_meet_once(spark):
    """Texts that share a band but no original: chains in which only neighbours are links."""
    gen = np.random.default_rng(13)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for g in range(4):
        w = list(base) if g < 2 else [f"{x}_{g}" for x in base]
        for _ in range(30):
            for at in gen.integers(0, len(w), 2):
                w[at] = f"v{gen.integers(1e6)}"
            texts.append(" ".join(w))
    got = {r["doc_id"]: r["class_id"] for r in near_copies(frame(spark, texts)).collect()}
    assert got == brute_classes(texts)
    packed = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, id long").select("id", "text").mapInArrow(_pack(5), "id long, z binary, n long, bits array<long>")
    everyone = packed.select(F.explode(F.array(F.lit(7).cast("long"), F.lit(9).cast("long"))).alias("key"), "id", F.col("id").alias("class"), "n", "bits")
    bags = [collections.Counter(tuple(t.split()[k : k + 5]) for k in range(196)) for t in texts]
    links = {(i, j) for j, y in enumerate(bags) for i, x in enumerate(bags[:j]) if sum((x & y).values()) >= 0.8 * sum((x | y).values())}
    for share in (256, 8):
        met = [(r["a"], r["b"]) for r in _crossing(everyone, 0.8, share).collect()]
        assert links <= set(met) and len(met) == len(set(met)) < len(texts) * (len(texts) - 1) / 2


def test_keys_tell_rows_apart(spark):
    rows = [(None, "a"), (None, "a"), (5, "b"), (5, "b"), (5, "c"), (7, "d"), (-3, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit(1))
    out = keyed(df, free_name(df, "_key")).collect()
    assert len(out) == 7 and len({r["_key_"] for r in out}) == 7
    assert {r["_key_"] for r in out if r["doc_id"] in (7, -3)} == {7, -3} and all(r["_key_"] > 7 for r in out if r["doc_id"] in (5, None))
    plain = df.where("doc_id in (7, -3)")
    assert {r["k"] for r in keyed(plain, "k").collect()} == {7, -3} and keyed(plain.where("false"), "k").count() == 0


def test_signatures_estimate_the_weighted_similarity():
    gen = np.random.default_rng(2)
    items = gen.integers(1, 2**62, 120).astype(np.uint64)
    a, b = gen.integers(0, 9, 120), gen.integers(0, 9, 120)
    doc = np.concatenate([np.zeros((a > 0).sum(), np.int64), np.ones((b > 0).sum(), np.int64)])
    sig, has = signatures(doc, np.concatenate([items[a > 0], items[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    assert has.all()
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def test_bitmaps_never_overstate_the_difference():
    gen = np.random.default_rng(3)
    for _ in range(20):
        items = mix(np.arange(200, dtype=np.uint64))
        a, b = gen.integers(0, 4, 200), gen.integers(0, 4, 200)
        doc = np.concatenate([np.zeros((a > 0).sum(), np.int64), np.ones((b > 0).sum(), np.int64)])
        bits = bitmaps(doc, np.concatenate([items[a > 0], items[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        differ = sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
        assert differ <= np.abs(a - b).sum() and differ % 2 == np.abs(a - b).sum() % 2


def test_connected_components(spark):
    gen = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in gen.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["id"]: r["class_id"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k in linked}


def brute_removal(texts, n):
    w = {i: words(t) for i, t in enumerate(texts)}
    first = {}
    for i in sorted(w):
        for k in range(len(w[i]) - n + 1):
            first.setdefault(tuple(w[i][k : k + n]), i)
    out = {}
    for i, x in w.items():
        gone = [False] * len(x)
        for k in range(len(x) - n + 1):
            if first[tuple(x[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = " ".join(a for a, g in zip(x, gone) if not g)
        out[i] = (len(x), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeats_match_all_windows(spark):
    texts = near_corpus(1)
    for n in (50, 24, 7):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in drop_repeats(frame(spark, texts), n).collect()}
        assert got == brute_removal(texts, n)
    assert lengths(50) == [25, 50] and lengths(96) == [12, 24, 48, 96]
    assert drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeats_of_ids_with_several_texts(spark):
    gen = np.random.default_rng(4)
    passage = " ".join(f"p{i}" for i in gen.integers(0, 5000, 60))
    long = lambda n, k: " ".join(f"q{k}x{i}" for i in gen.integers(0, 5000, n))
    rows = [(1, f"{long(300, 1)} {passage}"), (2, f"{long(300, 2)} {passage} {long(9, 2)}"), (2, f"{passage} {long(11, 3)}"), (2, f"{passage} {long(11, 3)}"), (None, passage), (3, passage), (3, None), (3, "")]
    rows += [rows[2], (4, rows[1][1]), (4, long(70, 5))]
    out = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in out)
    assert got == collections.Counter([(1, 360, 0), (2, 369, 60), (2, 71, 60), (2, 71, 60), (2, 71, 60), (None, 60, 0), (3, 60, 60), (3, 0, 0), (3, 0, 0), (4, 369, 369), (4, 70, 0)])
