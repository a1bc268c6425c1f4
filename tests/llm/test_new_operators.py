"""Licence templates, vector codes and spelling variants against plain versions of themselves, and on hard rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import frame, near_corpus
from tidegrid.llm import licenses, sql
from tidegrid.llm.codes import Tree, compress, encode, fit
from tidegrid.llm.variants import Runs, count_words, near_words, variants

# licences


def _sample(gen, parts):
    out = []
    for p in parts:
        if p.word:
            out.append(p.word)
        elif p.ways:
            out += _sample(gen, p.ways[gen.integers(len(p.ways))])
        else:
            out += [f"x{gen.integers(50)}" for _ in range(gen.integers(p.least, p.most + 1))]
    return out


def test_automaton_accepts_what_expressions_accept():
    gen = np.random.default_rng(1)
    automaton = licenses.Automaton.of()
    known = [(label, licenses.parse(t)) for label, t in licenses.TEMPLATES]
    expressions = [(label, re.compile(" " + sql._template_expression(p))) for label, p in known]
    hits = 0
    for _ in range(400):
        words = [f"y{i}" for i in gen.integers(0, 20, gen.integers(0, 6))]
        for _ in range(gen.integers(1, 3)):
            own = _sample(gen, known[gen.integers(len(known))][1])
            if gen.random() < 0.4:  # a word that is wrong, missing or too many
                at = int(gen.integers(len(own)))
                own[at : at + int(gen.integers(0, 2))] = ["zz"] * int(gen.integers(0, 2))
            words += own + [f"y{i}" for i in gen.integers(0, 20, gen.integers(0, 4))]
        text = " " + " ".join(words) + " "
        want = {label for label, e in expressions if e.search(text)}
        got = {automaton.labels[k] for _, _, k in automaton.accepted(words) if not automaton.base[k]}
        assert got == want
        hits += bool(want)
    assert 250 < hits < 400


def test_template_markup():
    one = licenses.Automaton.of([("t", "Keep [the {old|very new}] name of {1-2}, please")], [])
    ok = ["keep name of a please", "KEEP (the old) name of a b; please", "keep the very new name of it please"]
    no = ["keep the name of a please", "keep name of please", "keep name of a b c please", "keep old name of a please"]
    assert all(one.accepted(licenses.words_of(t)) for t in ok) and not any(one.accepted(licenses.words_of(t)) for t in no)
    assert one.accepted("keep name of a please keep name of b please".split()) == [(0, 5, 0), (5, 10, 0)]
    for bad in ("a [b", "a ] b", "a | b", "a {1-", "{0-3} a", "[a]", "{b|c]", "a {3-1}"):
        with pytest.raises(ValueError):
            licenses.Automaton.of([("t", bad)], [])


def test_licenses_in_hard_texts(spark):
    long = "mit license " + "word " * 300_000 + "Licensed under the\n\tApache License; version 2.0"
    texts = [None, "", "MIT", "mit-license MIT  License", "mit licenses", "xmit license", "émit license", "GNU General Public License, General\nPublic License", long, "released under the MIT license", "released under the MIT license", "KMIT license"]
    docs = frame(spark, texts).withColumn("places", F.lit(1))
    rows = {r["doc_id"]: r for r in licenses.find_licenses(docs).collect()}
    assert len(rows) == len(texts) and rows[0]["source"] == "s"
    for i, t in enumerate(texts):
        assert rows[i]["n_words"] == len(licenses.words_of(t or ""))
    base = {i: [(p["label"], p["start"]) for p in r["places"] if p["base"]] for i, r in rows.items()}
    assert base[3] == [("mit", 0), ("mit", 2)] and not any(base[i] for i in (0, 1, 2, 4, 5, 6, 11)) and base[7] == [("gpl", 1), ("gpl", 4)]
    assert base[8] == [("mit", 0), ("apache", 300_005)] and [p["label"] for p in rows[8]["places"] if not p["base"]] == ["Apache-2.0"]
    assert rows[9]["places"] == rows[10]["places"] and {p["label"] for p in rows[9]["places"]} == {"mit", "MIT"}
    assert licenses.find_licenses(docs.where("false")).count() == 0


# codes


def _plain(vectors, ids, rounds=4, k=256, parts=4):
    z = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64)
    z = z.reshape(len(z), parts, -1)
    books = z[np.argsort(ids, kind="stable")[:k]].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((z.transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(-1)
        near = d.argmin(-1)
        if r < rounds:
            for p in range(parts):
                for e in np.unique(near[p]):
                    own = z[near[p] == e, p]
                    books[p, e] = own.sum(axis=0) // len(own)
    return near.T, d.min(-1).sum(axis=0), books


@pytest.mark.parametrize("kind", ["normal", "ties", "few"])
def test_codes_match_plain_rounds(spark, kind):
    gen = np.random.default_rng(3)
    n = 40 if kind == "few" else 700
    x = gen.normal(size=(n, 16)).astype(np.float32) if kind != "ties" else gen.integers(-2, 3, (n, 16)).astype(np.float32)
    ids = gen.permutation(5 * n)[:n]
    rows = [(int(i), v.tolist(), int(i) % 3 if i % 4 else None, "x") for i, v in zip(ids, x)]
    bad = [(-1, None, 0, "x"), (-2, [None] * 16, 0, "x"), (-3, [float("nan")] * 16, 0, "x"), (-4, [float("inf")] * 16, 1, "x"), (-5, [], 1, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, code string").repartition(5)
    got = {r["vec_id"]: r for r in compress(df).collect()}
    index, error, books = _plain(x, ids)
    assert len(got) == n
    sha = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    by_label = Counter()
    for (_, _, label, _), e in zip(rows, error):
        by_label[label] += int(e)
    for (i, _, label, _), c, e in zip(rows, index, error):
        r = got[i]
        assert (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) == ("".join(f"{v:02x}" for v in c), e, by_label[label], sha)


def test_tree_finds_the_lowest_of_the_nearest():
    gen = np.random.default_rng(4)
    for n, dims, top in ((256, 16, 1000), (256, 2, 6), (1, 3, 5), (9, 1, 3), (200, 4, 1 << 27)):
        e, x = gen.integers(-top, top, (n, dims)), gen.integers(-top, top, (500, dims))
        x[: min(n, 100)] = e[: min(n, 100)]
        index, best = Tree(e).nearest(x)
        d = ((x[:, None] - e[None]) ** 2).sum(-1)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_codes_of_hard_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert compress(spark.createDataFrame([], schema)).count() == 0
    assert compress(spark.createDataFrame([(1, None, 1), (2, [], 1)], schema)).count() == 0
    same = compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], None), (1, [1.0, 2.0, 3.0, 4.0], None), (None, [1.0, 2.0, 3.0, 5.0], 2)], schema)).collect()
    assert [(r["vec_id"], r["code"], r["error"]) for r in same if r["vec_id"]] == [(1, "00000000", 0)] * 2 and len(same) == 3
    for odd in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(ValueError):
            fit(spark.createDataFrame(odd, schema))
    books = fit(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 1)], schema))
    assert encode(spark.createDataFrame([(7, [1.0, 2.0, 3.0, 4.5], 1), (8, None, 1)], schema), books).select("vec_id", "error").collect() == [(7, 512 * 512)]


# spelling variants


def _words(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_variants_match_all_pairs(spark):
    gen = np.random.default_rng(5)
    letters, texts = list("abcéÉÿ÷Ab"), []
    base = ["".join(gen.choice(letters, gen.integers(4, 9))) for _ in range(150)]
    for _ in range(250):
        own = []
        for w in gen.choice(base, 30):
            w = list(w)
            if gen.random() < 0.5:
                at = int(gen.integers(len(w)))
                w[at : at + int(gen.integers(0, 2))] = gen.choice(letters, gen.integers(0, 2)).tolist()
            own.append("".join(w))
        texts.append(" ".join(own))
    texts += [None, "", "1 2", "aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa aaaaaaa aaaaaaa aaaaaaa aaaaaaa aaaaaaa aaaaaaa", "b" * 700 + " " + "b" * 700 + "\n" + "b" * 700, "x", "ÀÀÀÀÀ|ÀÀÀÀÀ"]
    docs = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    words = _words(docs)
    got = {r["word"]: r for r in variants(df).collect()}
    assert {w: r["n"] for w, r in got.items()} == words and len(words) > 100
    form = {}
    for w, n in words.items():
        near = [v for v in words if _near(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        assert (got[w]["n_near"], got[w]["form"], got[w]["form_n"]) == (len(near), form[w], words[form[w]] if form[w] else None)
    for w in words:
        at = w
        while form[at]:
            at = form[at]
        assert got[w]["root"] == at
    assert sum(f is not None for f in form.values()) > 20


def test_near_words_of_every_edit(spark):
    gen = np.random.default_rng(6)
    words = {"".join(gen.choice(list("ab"), gen.integers(5, 9))) for _ in range(150)} | {"".join(gen.choice(list("etaoinzqx"), 12)) for _ in range(20)}
    for w in list(words)[:40]:
        for at in range(len(w)):
            words |= {w[:at] + w[at + 1 :], w[:at] + "z" + w[at + 1 :], w[:at] + "a" + w[at:]}
    words = sorted(w for w in words if len(w) >= 5)
    got = [tuple(sorted((r["a"], r["b"]))) for r in near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()]
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if _near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_words_of_hard_texts(spark):
    from tidegrid.llm.words import byte_powers

    texts = ["abc", "Déf", "×÷", "ĀaŸb", "", "ÿ" * 300]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    r = Runs(np.frombuffer(b"".join(raw), np.uint8), bounds, byte_powers())
    assert [(int(d), r.word(i).decode()) for i, d in enumerate(r.doc)] == [(0, "abc"), (1, "déf"), (2, "×÷"), (3, "a"), (3, "b"), (5, "ÿ" * 300)]
    docs = frame(spark, near_corpus() + [None, "", "é" * 5])
    want = _words([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert dict(map(tuple, count_words(docs).collect())) == want
    assert variants(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        variants(docs, shortest=3)
