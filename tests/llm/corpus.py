"""Small corpora with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, z binary, print string, key int"


def prose(gen, n, words=400):
    return " ".join(f"w{int(i)}" for i in gen.zipf(1.3, n) % words)


def rows(texts):
    """Documents of these texts; ids from 0; extra columns are called like inner ones."""
    return [(i, t, "en", "s", None if t is None else len(t), b"x", "p", 1) for i, t in enumerate(texts)]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def near_corpus(seed=0):
    """Texts with exact copies, near copies at different distances, shared passages, and the hard cases."""
    gen = np.random.default_rng(seed)
    base = [prose(gen, 200, 5000) for _ in range(12)]
    out = list(base)
    for b in base[:6]:
        words = b.split()
        for k in (1, 2, 4, 8):
            w = list(words)
            for at in gen.integers(0, len(w), k):
                w[at] = f"x{gen.integers(1e6)}"
            out.append(" ".join(w))
    out += [base[0], base[0], base[1] + "\n", "  " + base[2].replace(" ", "\t")]
    passage = prose(gen, 70, 9000)
    out += [f"{prose(gen, 30, 9000)} {passage} {prose(gen, 20, 9000)}" for _ in range(4)]
    out += [f"{passage} {passage}", None, "", "   ", "one", "one", "a b c d", "a b c d", "a b c d e", prose(gen, 5000, 9000)]
    # a group around one original: each differs from it in a few words of its own
    words = base[11].split()
    for _ in range(25):
        w = list(words)
        for at in gen.integers(0, len(w), int(gen.integers(0, 7))):
            w[at] = f"y{gen.integers(1e6)}"
        out.append(" ".join(w))
    return out
