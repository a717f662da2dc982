"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become templates: punctuation goes, a capitalised word after a word that ends in a
small letter, a digit, a comma or a semicolon is a name (a run of such words is one name), a
word of digits a number, and a unit after a number a unit; names, numbers and units become
typed placeholders, the rest lower case. A window is ``WIDTH`` consecutive template words with
at least ``LITERALS`` words that aren't placeholders. What is a name depends on punctuation and
case, so the same words as they stand, lower-cased, make plain windows beside the template
windows; they need no literals, and names in them are words like any other. A shorter item
is one window of either kind (a template of ``LEAST_TEMPLATE`` words at least); one of under
``LEAST`` words is only looked for in texts that hold nothing else. Windows of documents and
benchmark items are hash-joined.

Windows of a document and an item on one diagonal (the same offset) are one occurrence. Its
slots are consistent if each value in the item always stands for one value in the document;
of an inconsistent occurrence only the windows without slots count, so re-parameterised
questions are caught and accidental ones aren't. A document is contaminated by an item if
``SHARE`` of the item's template windows or of its plain windows are met, or if one occurrence
covers ``RUN`` consecutive words of the item.

The benchmark is broadcast after a check of its size: up to ``BROADCAST_ROWS`` windows;
beyond, the join shuffles. Null texts, and texts without words, have no windows; very long
texts are read whole. In ``contaminated`` rows that share a doc_id are judged together (null
ids too), and so are repeated items; ``clean`` judges every row by its own text. Empty tables
of either kind give no leak. Extra columns are ignored, and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

WIDTH = 8
LEAST, LEAST_TEMPLATE = 3, 5
LITERALS = 4
SHARE = 0.5
RUN = 13
BROADCAST_ROWS = 200_000

NAME, NUMBER, UNIT, JOIN = "\ue000", "\ue001", "\ue002", "\ue003"  # private-use characters
#: Units of measure, money and time.
UNITS = "mm cm m km in ft mi mile miles metre metres meter meters inch inches foot feet yard yards mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent degree degrees mph kmh kph hz khz mhz kb mb gb tb w kw v a j kj cal kcal"


def _joined(text: Column) -> Column:
    """With the white space inside a run of names replaced, so that a run stays one word."""
    # Patterns begin with what is rare, and look behind from there.
    return F.regexp_replace(text, r"\s(?=\p{Lu})(?<=[\p{Ll}\p{N}]\s)(?<=[\p{Ll}\p{N},;]\s\p{Lu}[\p{L}\p{M}]{0,30}\s)", JOIN)


def _plain(text: Column) -> Column:
    """Without punctuation; the words stay where they were."""
    # Most characters are settled by the first class, which is cheap.
    return F.regexp_replace(text, rf"[[^a-z ]&&[^\p{{L}}\p{{M}}\p{{N}}\s{NAME}{JOIN}]]+", "")


def _split(plain: Column, more: str = "") -> Column:
    """The words of a text that ``_plain`` went over: it has no white space but that of ``\\s``."""
    return F.array_remove(F.split(plain, rf"[\s{more}]+" if more else r"\s+"), "")


def template(joined: Column) -> Column:
    """The template words of a text whose runs of names are joined."""
    named = F.regexp_replace(joined, rf"\p{{Lu}}(?<=[\p{{Ll}}\p{{N}},;]\s\p{{Lu}})[\p{{L}}\p{{M}}]*(?:{JOIN}\p{{Lu}}[\p{{L}}\p{{M}}]*)*", NAME)
    counted = F.regexp_replace(_plain(named), r"\p{N}(?<!\S\p{N})\p{N}*(?!\S)", NUMBER)
    units = "|".join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))
    return _split(F.regexp_replace(F.lower(counted), rf"{NUMBER}\s(?:{units})(?!\S)", f"{NUMBER} {UNIT}"))


def _is_slot(word: Column) -> Column:
    return word.isin(NAME, NUMBER, UNIT)


def worded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, v and plains of rows(keys, text): template words, the same as they stand, and plain words.

    t[i] was v[i], a run of names being one. v and plains are null for texts without
    placeholders, where t is all there is.
    """
    t = rows.select(*keys, _joined(F.col("text")).alias("joined"))
    t = t.select(*keys, "joined", template(F.col("joined")).alias("t"))
    slotted = F.array_contains("t", NAME) | F.array_contains("t", NUMBER)  # a unit only follows a number
    # No filter on the words' number: it would be pushed below and make the template twice.
    t = t.select(*keys, "t", F.when(slotted, F.lower(_plain(F.col("joined")))).alias("low"))
    t = t.select(*keys, "t", "low", _split(F.col("low")).alias("v"))
    plains = F.when(F.contains("low", F.lit(JOIN)), _split(F.col("low"), JOIN)).otherwise(F.col("v"))
    return t.select(*keys, "t", "v", plains.alias("plains"))


def windows(rows: DataFrame, keys: list[str], width: int, whole: bool = False) -> DataFrame:
    """keys, h, at (from 0), plain and slots of each window of rows(keys, text).

    Template windows of every text, and plain ones of texts with placeholders; elsewhere
    they are the same. slots: for each template word, the value of its placeholder, or null;
    null if the text has none. It stays the text's own array, to be cut (``slot_values``)
    once a window is known to matter. whole: only of texts with just so many words.
    """
    slots = F.zip_with("t", "v", lambda w, v: F.when(_is_slot(w), v))
    hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    none = F.array().cast("array<int>")
    t = worded(rows, keys).select(*keys, slots.alias("slots"), F.coalesce(F.size("t"), F.lit(0)).alias("n"), F.concat(hashes("t"), F.coalesce(hashes("plains"), none.cast("array<bigint>"))).alias("words"))

    def starts(first: Column, n: Column) -> Column:
        return F.when(n == width if whole else n >= width, F.sequence(first, first + n - width)).otherwise(none)

    # Starts are exploded and hashed without lambdas, so that these steps and the join are compiled into one loop.
    n, start = F.col("n"), F.col("start")
    found = t.select(*keys, "slots", "n", "words", F.explode(F.concat(starts(F.lit(0), n), starts(n, F.size("words") - n))).alias("start"))
    plain = start >= n
    h = F.xxhash64(*[F.get("words", start + k) for k in range(width)])
    return found.select(*keys, "slots", (start - F.when(plain, n).otherwise(0)).alias("at"), plain.alias("plain"), h.alias("h"))


def slot_values(slots: Column, at: Column, width: int) -> Column:
    """The values of a window's placeholders, in order, joined by blanks."""
    return F.coalesce(F.array_join(F.slice(slots, at + 1, width), " "), F.lit(""))


def benchmark_windows(items: DataFrame, width: int = WIDTH, literals: int = LITERALS) -> list[tuple[int, DataFrame]]:
    """For each window width in use: h, item_id, item_at, item_slots, item_plain and item_windows, the item's number of windows of that kind."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    sizes = worded(items, []).select(F.explode(F.array(F.size("t"), F.size(F.coalesce("plains", "t")))).alias("n"))
    short = sorted(r[0] for r in sizes.where((F.col("n") > 0) & (F.col("n") < width)).distinct().collect())  # a few small numbers
    out = []
    for size in [*short, width]:
        found = windows(items, ["item_id"], size, whole=size < width).withColumn("slots", F.when(F.col("plain"), "").otherwise(slot_values(F.col("slots"), F.col("at"), size)))
        slots = F.size(F.filter(F.split("slots", " "), lambda s: s != ""))
        fits = slots <= (size - min(literals, size) if size >= LEAST_TEMPLATE else 0)
        found = found.where(fits).select("h", "item_id", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("plain").alias("item_plain"))
        total = found.groupBy("item_id", "item_plain").agg(F.countDistinct("item_at").alias("item_windows"))
        out.append((size, found.join(total, ["item_id", "item_plain"]).distinct()))
    return out


def leaks(docs: DataFrame, keys: list[str], items: DataFrame, width: int = WIDTH, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS, run: int = RUN) -> DataFrame:
    """keys, item_id, n_windows (met), item_windows, share and exact of docs(keys, text) for each item that the rows of some keys leak."""
    docs = docs.where("text is not null")
    met = None
    for size, found in benchmark_windows(items, width):
        if found.count() <= broadcast_rows:
            found = F.broadcast(found)
        hits = windows(docs, keys, size, whole=size < LEAST).join(found, "h").withColumn("slots", slot_values(F.col("slots"), F.col("at"), size)).withColumn("width", F.lit(size))
        met = hits if met is None else met.unionByName(hits)
    pairs = F.transform(
        F.filter(F.arrays_zip(F.split("item_slots", " ").alias("a"), F.split("slots", " ").alias("b")), lambda p: p["a"] != ""),
        lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")),
    )
    literal, place = F.col("item_slots") == "", F.struct("item_at", "width")
    kind = [*keys, "item_id", "item_plain", "item_windows"]
    places = met.select(*kind, "plain", literal.alias("literal"), place.alias("place"), (F.col("at") - F.col("item_at")).alias("offset"), F.when(~literal, pairs).alias("pairs"))
    occurrences = places.groupBy(*kind, "plain", "offset").agg(
        F.collect_set("place").alias("every"), F.collect_set(F.when(F.col("literal"), F.col("place"))).alias("literals"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    consistent = F.size("pairs") == F.size(F.array_distinct(F.col("pairs.a")))
    exact = ~consistent | F.forall("pairs", lambda p: p["a"] == p["b"])
    judged = occurrences.select(*kind, F.when(consistent, F.col("every")).otherwise(F.col("literals")).alias("met"), exact.alias("exact")).where(F.size("met") > 0)
    judged = judged.select(*kind, F.transform("met", lambda p: p["item_at"]).alias("ats"), _longest(F.col("met")).alias("run"), "exact")
    judged = judged.groupBy(*kind).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).cast("long").alias("n_windows"), F.max("run").alias("run"), F.bool_and("exact").alias("exact")
    )
    part = F.col("n_windows") / F.col("item_windows")
    judged = judged.where((part >= share) | (F.col("run") >= run))
    best = F.max(F.struct(part.alias("share"), ~F.col("item_plain"), "n_windows", "item_windows"))
    judged = judged.groupBy(*keys, "item_id").agg(best.alias("best"), F.bool_or("exact").alias("exact"))
    return judged.select(*keys, "item_id", "best.n_windows", "best.item_windows", "best.share", "exact")


def contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, n_windows (met), item_windows, share and exact for each document and item that it leaks."""
    return leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], items, **how)


def _longest(met: Column) -> Column:
    """The most consecutive words that an occurrence's windows cover."""
    start = F.struct(F.lit(0).alias("first"), F.lit(-1).alias("end"), F.lit(0).alias("best"))

    def step(so, p):
        first, end = F.when(p["item_at"] <= so["end"], so["first"]).otherwise(p["item_at"]), p["item_at"] + p["width"]
        return F.struct(first.alias("first"), end.alias("end"), F.greatest(so["best"], end - first).alias("best"))

    return F.aggregate(F.array_sort(met), start, step, lambda so: so["best"])


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, all columns as they were; each row is judged by its own text."""
    names = [fresh(n, docs.columns) for n in ("leak", "leak_hash")]
    rows = docs.select(F.col("doc_id").cast("long").alias(names[0]), F.xxhash64("text").alias(names[1]), "text")
    found = leaks(rows, names, items).select(*names).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64("text") == F.col(names[1]))
    return docs.join(found, same, "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
