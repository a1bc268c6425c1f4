"""Operator 9: benchmark items in documents, also with other numbers, names or units, by canonical templates.

Words become a template: numbers, units after numbers, and runs of name words get typed placeholders, the rest lower case
without punctuation around it. Windows of the template of ``window`` words are hashed; those of the benchmark are joined with
those of the documents. A stretch of consecutive windows on one diagonal (position in the document less position
in the item) is a leak if its slots are consistent: equal values in the item stand for equal values in the document. All
of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, table

#: Units that make a slot after a number.
UNITS = "km|m|cm|mm|mi|miles?|ft|feet|inch(?:es)?|yards?|kg|g|mg|lbs?|pounds?|ounces?|oz|tons?|l|ml|lit(?:er|re)s?|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|%|percent|degrees?|dollars?|euros?|cents?|kmh|mph|kw|kwh|w|watts?|v|volts?|hz|khz|mhz|ghz|kb|mb|gb|tb|k|c|f|pa|kpa|bar|mol|j|kj|cal|kcal"
#: Words that are no names even with a capital: function words of English, German, French and Spanish, and what questions begin with.
COMMON = """
a an the this that these those it its he she they we you i his her their our your my who whose which what when where why how if then
and or but so not no as at by for from in into of off on out over to up with without under after before between during about each every
all any both few many more most much other some such there here can could must should would do does did is are was were be have
has had let find given suppose one two three
der die das ein eine und ist den von zu mit sich des auf nicht dem wie wenn
le la les un une du de et en est que qui dans par pour sur avec il elle
el los las una y es se con del al lo su como si
""".split()
#: Cardinals and ordinals that are written out, also several joined by hyphens; no words that are articles or units too.
NUMBERS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
first third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth twentieth thirtieth hundredth
null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn
zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen
deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize vingt vingts trente quarante cinquante soixante cent cents mille
dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve
veinte veintiuno veintidós veintitrés treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil
""".split()
#: German numbers from 21 to 99 name the smaller part first.
_UND = "(?:ein|zwei|drei|vier|fünf|sechs|sieben|acht|neun)und(?:zwanzig|dreißig|vierzig|fünfzig|sechzig|siebzig|achtzig|neunzig)"


def _by_letter(words: list[str]) -> str:
    """An expression for any of these words, which looks at a word's first letter once."""
    letters = sorted({w[0] for w in words})
    return "|".join(f"{a}(?:{'|'.join(dict.fromkeys(w[1:] for w in words if w[0] == a))})" for a in letters)


#: A number in words, in lower case.
SPELLED = rf"(?:{_by_letter(NUMBERS)}|{_UND})"
WINDOW, STRETCH, LITERALS = 8, 6, 2
_MARK, _GLUE = "\x02", "\x03"  # before a name word, and between two of one run
_ENDS = r"""[.,;:!?"')]"""


def spaced(text: Column) -> Column:
    """Words with single spaces between them; a null is empty. A unit written onto its number is a word of its own."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    return F.regexp_replace(words, rf"([0-9])(?=(?i:{UNITS}){_ENDS}*(?: |$))", "$1 ")


def with_template(df: DataFrame) -> DataFrame:
    """``df`` (words: a :func:`spaced` text) with ``words`` joined where they are one name, and template: as many words.

    A number is a word that begins with a digit, after at most three of "'(+-$€£, or one of ``SPELLED`` or several joined by hyphens, after at most three of "'(; a unit is one of ``UNITS`` right
    after a number; a name word begins with a capital, after at most three of "'(, and is none of ``COMMON``, wherever it
    stands in its sentence. Name words that follow one another without punctuation are one name. The steps are columns of
    their own, so that each pattern runs once over a text."""
    unit_there = rf"(?<=[0-9] )(?i:{UNITS})(?={_ENDS}*(?: |$))"
    name = rf"""(?=\p{{Lu}})(?<=(?:^| )["'(]{{0,3}})(?!(?i:{"|".join(COMMON)})(?![\p{{L}}\p{{N}}]))(?!(?iu:{SPELLED})(?![\p{{L}}\p{{N}}]))(?!{unit_there})"""
    marked = F.regexp_replace("words", name, _MARK)
    glued = F.regexp_replace("_m", rf"""({_MARK}[^ ]*[^ .,;:!?"')]) (?=["'(]{{0,3}}{_MARK})""", f"$1{_GLUE}")
    number = F.regexp_replace("_l", rf"""(?<![^ ])(["'(]{{0,3}})(?:{SPELLED}(?:-{SPELLED})*)(?={_ENDS}*(?: |$))|[0-9](?<=(?:^| )["'(+$€£-]{{0,3}}[0-9])(?:[^ ]*[^ .,;:!?"')])?""", "$1<num>")
    unit = F.regexp_replace("_t", rf"(?<=<num> )(?i:{UNITS})(?={_ENDS}*(?: |$))", "<unit>")
    df = df.withColumn("_m", marked).withColumn("_g", F.when(F.col("_m").contains(_MARK), glued).otherwise(F.col("_m")))
    df = df.withColumn("_l", F.lower("_g")).withColumn("_t", number).withColumn("_u", F.when(F.col("_t").contains("<num> "), unit).otherwise(F.col("_t")))
    t = F.regexp_replace("_u", f"{_MARK}[^ ]*", "<name>")
    t = F.regexp_replace(F.regexp_replace(t, rf"{_ENDS}+(?= |$)", ""), r"""["'(+$€£-](?<![^ ].)["'(+$€£-]*""", "")
    return df.withColumn("template", t).withColumn("words", F.translate("_g", _MARK, "")).drop("_m", "_g", "_l", "_t", "_u")


def _windows(words: Column, window: int | Column, stride: int) -> Column:
    """Positions and hashes of every ``stride``-th window of an array of words."""
    at = F.when(F.size(words) >= window, F.sequence(F.lit(0), F.size(words) - window, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(words, i + 1, window)).alias("h")))


def _value(word: Column) -> Column:
    """A slot's value: its word or words in lower case, without punctuation at the ends."""
    return F.lower(F.translate(F.regexp_replace(word, r"""^["'(]+|[.,;:!?"')]+$""", ""), _GLUE, " "))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id and words of the items that have an id."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), spaced(F.col("text")).alias("words")).where("item_id is not null")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced(F.col("text")).alias("words")).where("doc_id is not null")


def indexed(benchmark: DataFrame, window: int = WINDOW, stretch: int = STRETCH, literals: int = LITERALS) -> DataFrame:
    """Every window of the items: item_id, variant, pos, h, slots (offset, value), counted (it has ``literals`` words that are not
    slots), need (consecutive counted windows that make a leak: ``stretch``, or all where an item has fewer).

    Items of equal template are one, under the smallest id, but each way in which their slots equal one another is a ``variant``
    (the smallest id of those that share it), as consistency depends on it. Items of fewer than ``window`` words or without id have none.
    """
    t = with_template(_items(benchmark))
    kinds = F.array(*[F.lit(f"<{k}>") for k in ("num", "unit", "name")])
    t = t.select("item_id", "template", F.split("words", " ").alias("raw"), F.split("template", " ").alias("canon"))
    filled = F.transform("canon", lambda c, i: F.when(F.array_contains(kinds, c), F.concat(c, _value(F.element_at("raw", i + 1)))))
    t = t.withColumn("filled", filled).withColumn("alike", F.transform("filled", lambda x: F.array_position("filled", x)))
    t = t.groupBy("template", "alike").agg(F.min(F.struct("item_id", "raw", "canon")).alias("i")).select(F.min("i.item_id").over(Window.partitionBy("template")).alias("item_id"), F.col("i.item_id").alias("variant"), "i.raw", "i.canon")
    w = t.select("item_id", "variant", "raw", "canon", F.explode(_windows(F.col("canon"), window, 1)).alias("w")).select("item_id", "variant", "w.pos", "w.h", F.slice("raw", F.col("w.pos") + 1, window).alias("raw"), F.slice("canon", F.col("w.pos") + 1, window).alias("canon"))
    slots = F.filter(F.transform("canon", lambda c, i: F.struct(i.alias("at"), c.alias("kind"), _value(F.element_at("raw", i + 1)).alias("value"))), lambda s: F.array_contains(kinds, s["kind"]))
    w = w.select("item_id", "variant", "pos", "h", slots.alias("slots")).withColumn("counted", F.size("slots") <= window - literals)
    runs = w.where("counted").groupBy("variant").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    run = F.aggregate("at", F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most")), _longer, lambda s: s["most"])
    return w.join(runs.select("variant", F.least(F.lit(stretch), run).alias("need")), "variant", "left").select("item_id", "variant", "pos", "h", "slots", "counted", "need")


def _longer(s: Column, at: Column) -> Column:
    now = F.when(at == s["last"] + 1, s["now"] + 1).otherwise(1)
    return F.struct(at.alias("last"), now.alias("now"), F.greatest(s["most"], now).alias("most"))


def _longest(at: Column, bars: Column, window: int) -> Column:
    """The most consecutive windows of the positions ``at`` of which no two words are at odds: a word at ``p`` of ``bars`` allows none that start before ``start``."""

    def step(s: Column, a: Column) -> Column:
        bar = F.array_max(F.transform(F.filter(bars, lambda b: (b["p"] >= a) & (b["p"] < a + window)), lambda b: b["start"]))
        first = F.greatest(F.when(a == s["last"] + 1, s["first"]).otherwise(a), bar)
        return F.struct(a.alias("last"), first.alias("first"), F.greatest(s["most"], a - first + 1).alias("most"))

    return F.aggregate(at, F.struct(F.lit(-2).alias("last"), F.lit(0).alias("first"), F.lit(0).alias("most")), step, lambda s: s["most"])


def _judged(rows: DataFrame, items: DataFrame, window: int, parts: bool) -> DataFrame:
    """Leaks of the indexed items in candidate rows (doc_id, words), as :func:`leaks` describes them."""
    near = with_template(rows.withColumn("copy", F.xxhash64("words"))).select("doc_id", "copy", F.split("words", " ").alias("raw"), F.split("template", " ").alias("canon"))
    full = F.transform(_windows(F.col("canon"), window, 1), lambda w: F.struct(w["pos"].alias("pos"), w["h"].alias("h"), F.array_join(F.slice("raw", w["pos"] + 1, window), " ").alias("raw")))
    full = near.select("doc_id", "copy", F.explode(full).alias("w")).select("doc_id", "copy", F.col("w.pos").alias("at"), F.col("w.h").alias("h"), F.col("w.raw").alias("raw"))
    both = full.join(items if parts else items.where("counted"), "h")
    pair = F.transform("slots", lambda s: F.struct((F.col("pos") + s["at"]).alias("p"), F.concat(s["kind"], s["value"]).alias("of"), _value(F.element_at(F.split("raw", " "), s["at"] + 1)).alias("is"), s["value"].alias("was")))
    group = both.select("doc_id", "copy", "item_id", "variant", "need", "counted", "pos", (F.col("at") - F.col("pos")).alias("diagonal"), pair.alias("pairs"))
    if parts:
        group = group.where(F.col("counted") | F.forall("pairs", lambda p: p["is"] == p["was"]))
    group = group.groupBy("doc_id", "copy", "item_id", "variant", "need", "diagonal").agg(F.sort_array(F.collect_set("pos")).alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("placed"))
    group = group.withColumn("pairs", F.array_distinct(F.transform("placed", lambda p: F.struct(p["of"].alias("of"), p["is"].alias("is"), p["was"].alias("was")))))
    run = F.aggregate("at", F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most")), _longer, lambda s: s["most"])
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["of"]))) == F.size("pairs")
    changed = F.exists("pairs", lambda p: p["is"] != p["was"])
    group = group.withColumn("run", run).where(F.col("run") >= F.col("need")).withColumn("changed", changed).withColumn("consistent", consistent)
    if parts:
        odd = F.transform("placed", lambda w: F.struct(w["p"].alias("p"), (F.array_max(F.transform(F.filter("placed", lambda v: (v["p"] < w["p"]) & (v["of"] == w["of"]) & (v["is"] != w["is"])), lambda v: v["p"])) + 1).alias("start")))
        other = F.transform(F.filter("placed", lambda w: w["is"] != w["was"]), lambda w: F.struct(w["p"].alias("p"), (w["p"] + 1).alias("start")))
        group = group.withColumn("run", F.when(F.col("consistent"), F.col("run")).otherwise(_longest(F.col("at"), odd, window)))
        group = group.withColumn("changed", F.when(F.col("consistent"), F.col("changed")).otherwise(_longest(F.col("at"), other, window) < F.col("need")))
        leak = group.where(F.col("run") >= F.col("need"))
    else:
        leak = group.where("consistent")
    return leak.groupBy("doc_id", "item_id").agg(F.max(F.col("run") + window - 1).cast("int").alias("words"), F.min("changed").alias("changed"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, stretch: int = STRETCH, parts: bool = False) -> DataFrame:
    """Leaks of items in documents by their templates: doc_id, item_id, words (template words in the longest stretch), changed (some slot differs).

    Of items of equal template the smallest id is reported, if any variant of them is consistent; changed is against that variant.
    A leak is ``window + need - 1`` (13, if the item has as many) consecutive words of equal template and consistent
    slots; need as in :func:`indexed`. With ``parts``, as the query has it, any such stretch of a diagonal is one (also over
    windows that aren't counted, where their slots are the item's), and where
    the diagonal as a whole is inconsistent, ``changed`` is false if a stretch that long has all slots of the item; without,
    one inconsistent pair anywhere on the diagonal rejects all of it. A stretch that long holds a window at every position modulo the least need,
    so only each so many-th window of a document is hashed to find the candidates; these are then judged on all their
    windows. Null and empty texts hold nothing; a document without id is never reported; different texts of one doc_id are judged apart
    and reported once; other columns are ignored. Whether the benchmark's windows are broadcast is left to Spark, which knows their size.
    """
    items = cut(indexed(benchmark, window, stretch), "leaks-items")
    least = items.agg(F.min("need")).first()[0]
    if not least:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, words int, changed boolean")
    marks = cut(items.select("h").distinct(), "leaks-marks")
    rows = _rows(docs)
    probe = with_template(rows).withColumn("canon", F.split("template", " ")).select("doc_id", F.explode(_windows(F.col("canon"), window, least)).alias("w")).select("doc_id", F.col("w.h").alias("h"))
    found = cut(probe.join(marks, "h", "left_semi").select("doc_id").distinct(), "leaks-candidates")
    return _judged(rows.join(found, "doc_id", "left_semi"), items, window, parts)


def _literal(words: Column) -> Column:
    """Words in lower case, without punctuation at their ends."""
    return F.split(F.regexp_replace(F.regexp_replace(F.lower(words), rf"{_ENDS}+(?= |$)", ""), r"""["'(](?<![^ ].)["'(]*""", ""), " ")


def _literal_items(benchmark: DataFrame, window: int, stretch: int) -> DataFrame:
    """Windows of the items' own words: item_id, variant, size (``window``, or that of a shorter item), need, pos, h."""
    t = _items(benchmark)
    t = with_template(t.where(F.col("words").rlike(r"[\p{L}\p{N}]")).withColumn("lit", _literal(F.col("words")))).withColumn("item_id", F.min("item_id").over(Window.partitionBy("template")))
    t = t.groupBy("lit").agg(F.min("item_id").alias("item_id")).withColumn("size", F.least(F.size("lit"), F.lit(window)))
    # items that differ only in what isn't compared are one; need counts consecutive windows
    t = t.withColumn("need", F.least(F.lit(stretch), F.size("lit") - F.col("size") + 1)).withColumn("variant", F.xxhash64("lit"))
    return t.select("item_id", "variant", "size", "need", F.explode(_windows(F.col("lit"), F.col("size"), 1)).alias("w")).select("item_id", "variant", "size", "need", "w.pos", "w.h")


def _literal_windows(sizes: list[tuple[int, int]], sparse: bool) -> Column:
    """size, at, h of the windows of ``lit`` of all sizes; ``sparse``: only as many as find every candidate."""
    return F.concat(*[F.transform(_windows(F.col("lit"), n, need if sparse else 1), lambda w: F.struct(F.lit(n).alias("size"), w["pos"].alias("at"), w["h"].alias("h"))) for n, need in sizes])


def _copied(rows: DataFrame, items: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """Word for word copies in candidate rows (doc_id, words): doc_id, item_id, words."""
    near = rows.withColumn("lit", _literal(F.col("words"))).select("doc_id", F.xxhash64("words").alias("copy"), F.explode(_literal_windows(sizes, False)).alias("w"))
    both = near.select("doc_id", "copy", "w.size", "w.at", "w.h").join(items, ["size", "h"])
    group = both.groupBy("doc_id", "copy", "item_id", "variant", "size", "need", (F.col("at") - F.col("pos")).alias("diagonal")).agg(F.sort_array(F.collect_set("pos")).alias("at"))
    run = F.aggregate("at", F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most")), _longer, lambda s: s["most"])
    return group.withColumn("run", run).where("run >= need").groupBy("doc_id", "item_id").agg(F.max(F.col("run") + F.col("size") - 1).cast("int").alias("words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, stretch: int = STRETCH) -> DataFrame:
    """All that :func:`leaks` finds in parts of diagonals, and word for word copies that it can't find, with changed false: doc_id, item_id, words, changed.

    A copy is ``window + stretch - 1`` (13) consecutive words of an item, or all of an item of fewer, but for case and
    punctuation at the ends of words, whatever would be slots in it. Items without a letter or digit have none; items shorter than a
    window are one window of their own size. Nulls, ids, repeated rows, and items of equal template as in :func:`leaks`; an
    empty table of either kind gives no rows. One pass over the documents finds the candidates of both; only these are judged.
    """
    items = cut(indexed(benchmark, window, stretch), "leaks-items")
    literal = cut(_literal_items(benchmark, window, stretch), "verbatim-items")
    least = items.agg(F.min("need")).first()[0]
    sizes = sorted((r["size"], r["need"]) for r in literal.groupBy("size").agg(F.min("need").alias("need")).collect())  # at most ``window``
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, words int, changed boolean")
    marks = cut(items.select(F.lit(0).alias("size"), "h").union(literal.select("size", "h")).distinct(), "leaks-marks")
    rows = _rows(docs)
    probes = _literal_windows(sizes, True)
    if least:
        templates = F.transform(_windows(F.col("canon"), window, least), lambda w: F.struct(F.lit(0).alias("size"), w["pos"].alias("at"), w["h"].alias("h")))
        probes = F.concat(templates, probes)
    seen = with_template(rows.withColumn("lit", _literal(F.col("words")))).withColumn("canon", F.split("template", " "))  # columns: a window's expression must not split the text anew
    probe = seen.select("doc_id", F.explode(probes).alias("w")).select("doc_id", "w.size", "w.h")
    found = cut(probe.join(marks, ["size", "h"], "left_semi").select("doc_id").distinct(), "leaks-candidates")
    near = cut(rows.join(found, "doc_id", "left_semi").distinct(), "leaks-texts")  # the candidates' texts, which both ways of judging read
    by = F.lit(1).alias("by")
    known = _copied(near, literal, sizes).select("doc_id", "item_id", "words", F.lit(False).alias("changed"), by)
    if least:
        known = known.union(_judged(near, items, window, True).select("doc_id", "item_id", "words", "changed", F.lit(0).alias("by")))
    first = F.min_by(F.struct("words", "changed"), "by").alias("first")
    return known.groupBy("doc_id", "item_id").agg(first).select("doc_id", "item_id", "first.words", "first.changed")


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
