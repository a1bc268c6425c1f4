"""Operator 4: secrets in whole texts, by fixed patterns and by dictionary-primed zstandard novelty.

The patterns (``BASE``) give the certain spans. The method adds others: each long token in a sensitive context
is compressed together with its surroundings by a compressor primed with a dictionary of identifiers, of which most are
harvested from the corpus; the bytes that it adds to the compressed surroundings are its novelty. A token made of known
identifiers or of what stands around it adds few bytes, a random key at least the entropy of its alphabet.
"""

from __future__ import annotations

import bisect
import math
import re

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, lean, table
from .words import spare

# The patterns and least lengths of the base kinds, in the order in which kinds are listed.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs [0-9a-f]+ of 16 characters or more
)
KINDS = ("assign", "access", "hex", "novel")

#: A text without any of these has no span of any kind. RE2; it may let through more than the patterns find.
_MAY = r"(?i:passw|passp|secret|token|api[ _-]?key|credential|authori|bearer|private.?key|access.?key|signing|client.?id)|AKIA|[0-9a-f]{16}"
#: What makes a context sensitive.
_SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[ _-]?key|credential|authori[sz]ation|bearer|private[ _-]?key|access[ _-]?key|signing|client[ _-]?id", re.A | re.I)
#: A token may hold single dots within, and ends in padding at most.
_TOKEN = re.compile(r"(?:[A-Za-z0-9+/_-]+\.)*[A-Za-z0-9+/_-]+={0,2}")
SHORTEST = 16
#: One word in letters of one case, with or without a capital: never a key by its own.
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: The characters that a random key is drawn from: the first set that holds all of a token's letters and digits.
_ALPHABETS = [(re.compile(p), n) for p, n in (("[0-9]+", 10), ("[0-9a-f]+|[0-9A-F]+", 16), ("[0-9a-z]+|[0-9A-Z]+", 36), ("[A-Za-z]+", 52), ("[0-9A-Za-z]+", 62))]

#: Identifiers and words of code that a compressor should know whatever the corpus.
IDENTIFIERS = """
abstract access account action address admin allow append application argument array async attribute authentication authorization
available await base64 batch binary boolean buffer builder bytes cache callback category certificate channel character checksum
class client cluster collection column command commit component config configuration connection constant container content context
controller cookie count create credential current cursor data database date debug decode default delete dependency description
device directory document domain download element email enable encode encrypt endpoint engine environment error event example
exception execute export expression extension false feature field file filename filter final float folder format function generate
group handler hash header health history host identifier image import index init input insert instance integer interface internal
item key language layer length library limit listener local location logger login manager mapping memory message metadata method
middleware model module monitor name namespace network node null number object offset operation option order output package page
parameter parent parser partition path pattern payload permission pipeline plugin pointer policy port private process product
profile project property protocol provider public query queue random record reference register release remote request
resource response result return role route schema script search service session setting signature source state status
storage stream string table target template thread time token type update upload user value variable vector version view worker
""".split()

#: Parts of words that count as identifiers: letters only, so that no key of mixed characters can enter the dictionary.
_PARTS = "[A-Z]?[a-z]{3,15}"


def harvest(docs: DataFrame, most: int = 4096) -> list[str]:
    """The ``most`` parts of words that occur in the most documents, in two at least, the rarest first.

    Counted over all rows, repeated ones too: only this bounded list reaches the driver. Nulls and empty tables give none."""
    parts = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_PARTS), F.lit(0)), F.lower))
    counts = docs.select(F.explode(parts).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return [r["part"] for r in counts.orderBy(F.desc("n"), "part").limit(most).collect()][::-1]


def dictionary(harvested: list[str] | tuple[str, ...] = (), words: tuple[str, ...] = tuple(IDENTIFIERS)) -> bytes:
    """Raw dictionary content: harvested and fixed identifiers in their usual spellings, the likeliest last."""
    spelled = [" ".join(harvested), "".join(w.title() for w in harvested), " ".join(words), "_".join(words).upper(), "".join(w.title() for w in words), "_".join(words)]
    return "\n".join(spelled).encode()


def novelty(token: str, before: str, after: str, press: zstandard.ZstdCompressor) -> float:
    """Bytes that ``token`` adds to its compressed surroundings, for each of its characters."""
    around = len(press.compress(f"{before}\n{after}".encode()))
    return (len(press.compress(f"{before}\n{after}\n{token}".encode())) - around) / len(token)


def random_bytes(token: str) -> float:
    """Bytes for each character that a random token of its alphabet holds; one of 64 signs if none is known."""
    own = re.sub("[^0-9A-Za-z]", "", token)
    return math.log2(next((n for p, n in _ALPHABETS if p.fullmatch(own)), 64)) / 8


def _base(text: str, patterns: list[tuple[str, re.Pattern, int, int]]) -> list[tuple[int, int, str, int]]:
    found = []
    for order, (kind, pattern, group, least) in enumerate(patterns):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return found


_SPELLED = re.compile("[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])")


def _known(token: str, words: frozenset[str]) -> bool:
    """Whether known identifiers make up half of the token's letters and digits or more: the many short matches of such a token cost
    the compressor nearly as many bytes as they save."""
    own = sum(c.isalnum() for c in token)
    return 2 * sum(len(m.group()) for m in _SPELLED.finditer(token) if m.group().lower() in words) >= own


def _pieces(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the sorted spans ``taken`` leave of a token."""
    out = []
    for x, y in taken:
        if x > a:
            out.append((a, min(x, b)))
        a = max(a, y)
        if a >= b:
            break
    return out + [(a, b)] if a < b else out


def _novel(text: str, taken: list[tuple[int, int]], press: zstandard.ZstdCompressor, words: frozenset[str], reach: int, least: float) -> list[tuple[int, int, str, int]]:
    """Tokens within ``reach`` of a sensitive word on either side whose novelty is ``least`` of a random token's or more, and which
    aren't made of the dictionary's ``words``; of one that base spans cover in part, the rest."""
    marks = [(m.start(), m.end()) for m in _SENSITIVE.finditer(text)]
    if not marks:
        return []
    starts, ends = [a for a, _ in marks], [b for _, b in marks]
    out, t = [], 0
    taken = sorted(taken)
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if b - a < SHORTEST:
            continue
        i, j = bisect.bisect_right(ends, a) - 1, bisect.bisect_left(starts, b)
        if not (i >= 0 and a - ends[i] <= reach or j < len(starts) and starts[j] - b <= reach):
            continue
        token = m.group()
        if _WORD.fullmatch(token) or _known(token, words):
            continue
        while t < len(taken) and taken[t][1] <= a:
            t += 1
        near, k = [], t
        while k < len(taken) and taken[k][0] < b:
            near.append(taken[k])
            k += 1
        left = [(x, y) for x, y in _pieces(a, b, near) if y - x >= (4 if near else 1)]
        if left and novelty(token, text[max(0, a - 256) : a], text[b : b + 256], press) >= least * random_bytes(token):
            out += [(x, len(KINDS) - 1, "novel", y) for x, y in left]
    return out


MARK = "[secret]"
_SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def _covered(text: str, spans: list[dict], mark: str) -> str:
    """``text`` with each stretch of joined spans replaced by ``mark``."""
    parts, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            parts += [text[at : s["start"]], mark]
        at = s["end"]
    return "".join([*parts, text[at:]])


def scanner(harvested: list[str] | tuple[str, ...] = (), reach: int = 40, least: float = 0.85, mark: str | None = None):
    """An Arrow function of a text column: its spans (kind, start, end), by start and then kind as listed; with a ``mark`` a struct
    of them and of the text in which they are replaced by it, which is null where there are none.

    ``reach``: characters from a sensitive word, on either side, within which a token stands; ``least``: novelty as a share of the
    entropy of the token's alphabet."""
    words, known = dictionary(harvested), frozenset([*harvested, *IDENTIFIERS])

    @F.arrow_udf(_SPANS if mark is None else f"struct<spans: {_SPANS}, text: string>")
    def scan(texts: pa.Array) -> pa.Array:
        patterns = [(kind, re.compile(p, re.A | (re.I if kind == "assign" else 0)), g, n) for kind, p, g, n in BASE]
        primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=3)
        press = zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
        may = pc.match_substring_regex(texts, _MAY).to_pylist()
        out, covered = [], []
        for i, hit in enumerate(may):
            if not hit:
                out.append([]), covered.append(None)
                continue
            text = texts[i].as_py()
            found = _base(text, patterns)
            found += _novel(text, [(a, b) for a, _, _, b in found], press, known, reach, least)
            out.append([{"kind": kind, "start": a, "end": b} for a, _, kind, b in sorted(found)])
            covered.append(_covered(text, out[-1], mark) if mark is not None and found else None)
        spare()
        spans = pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
        return spans if mark is None else pa.StructArray.from_arrays([spans, pa.array(covered, pa.string())], ["spans", "text"])

    return scan


def find_secrets(docs: DataFrame, corpus: DataFrame | None = None, most: int = 4096, mark: str | None = None, **limits) -> DataFrame:
    """``docs`` with spans: array of (kind, start, end) in code points, end exclusive.

    The dictionary is harvested from all texts of ``corpus`` (``docs``, if None) and holds ``most`` parts of words at most.
    A null or empty text has none. Each row is judged alone, repeated rows too; a column named spans is replaced.
    An empty table gives no rows. With a ``mark`` the texts are also redacted, as by :func:`redact`, but by the worker that finds the
    spans: a task then needs one Python worker and not two, which an executor keeps for the stages to come.
    """
    lean(docs.sparkSession)
    known = harvest(docs if corpus is None else corpus, most)
    if mark is not None:
        said = free_name(docs, "_said")
        out = docs.withColumn(said, scanner(known, mark=mark, **limits)(F.coalesce("text", F.lit(""))))
        return out.withColumns({"spans": F.col(f"{said}.spans"), "text": F.coalesce(F.col(f"{said}.text"), "text")}).drop(said)
    return docs.withColumn("spans", scanner(known, **limits)(F.coalesce("text", F.lit(""))))


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """``docs`` (with spans) whose text has each stretch of joined spans replaced by ``mark``; texts without spans stay."""

    @F.arrow_udf("string")
    def cover(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), spans.to_pylist())
        return pa.array([_covered(text, found, mark) if text is not None and found else text for text, found in pairs], pa.string())

    return docs.withColumn("text", F.when(F.size("spans") > 0, cover("text", "spans")).otherwise(F.col("text")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    counts = [F.size(_of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
