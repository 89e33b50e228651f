"""Benchmark decontamination by template windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.llm.staging import semi_by_key, stage

#: Words in a template window, and the share (in percent) of an item's windows that a document must hold.
WINDOW, PERCENT = 5, 75
#: Windows of the benchmark up to which they are broadcast (16 bytes each); beyond, a shuffled join is used.
BROADCAST_WINDOWS = 1_000_000

# Units that follow a number, in lower case.
UNITS = ("mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "oz", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "mph", "kmh", "c", "f", "degree", "degrees")

_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
_NAME = r"([\p{Ll},;] )(\p{Lu}\p{Ll}+)" + r"(?: (\p{Lu}\p{Ll}+))?" * 3
#: What separates words; the marks keep a slot's value in its word.
_BETWEEN = r"[^\p{L}0-9.,\x01\x02\x03]+|[.,]+(?![0-9])|(?<![0-9])[.,]+"


def slot_words(text: Column) -> Column:
    """Words in lower case with their slots marked: \\x01 before a number (or number and unit), \\x02 before a name.

    A number is a run of digits, possibly with points or commas inside; a name is a run of
    up to four capitalised words that begins no sentence, and counts as one word.
    """
    marked = F.regexp_replace(text, r"[\x01\x02\x03]", " ")
    marked = F.when(marked.rlike("[0-9]"), F.regexp_replace(marked, _NUMBER, " \x01$0 ")).otherwise(marked)
    marked = F.regexp_replace(marked, _NAME, "$1\x02$2\x03$3\x03$4\x03$5")
    return F.filter(F.split(F.lower(marked), _BETWEEN), lambda w: w != "")


def template_word(word: Column) -> Column:
    return F.when(word.startswith("\x01"), "<number>").when(word.startswith("\x02"), "<name>").when(word.isin(*UNITS), "<unit>").otherwise(word)


def windows_of(words: Column, size: int) -> Column:
    """64-bit hashes of all runs of `size` words of an array."""
    last = F.size(words) - size + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(size)))))


def benchmark_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """Documents (doc_id, text) that hold at least percent of an item's (item_id, text) template windows, slots consistent.

    Returns a row per such pair: doc_id, item_id, n_windows (distinct windows of the item),
    n_matched (of them in the document), reworded (some slot's value differs).

    Numbers, names and units become typed placeholders; windows of `window` template words
    are joined by hash. Then, in the documents found, matched windows are laid out by the
    distance of their places in document and item. Distances that follow one another by at
    most half the item's words are one occurrence. In it each value of the item must stand
    for one value of the document, and each name of the document for one name of the item
    (numbers may fall together, as new parameters can be equal). Windows of a distance where
    that doesn't hold, or that contradicts a distance of more windows (or as many, and
    smaller), are not counted. Items of fewer words than a window are one window of their
    own length.

    Null and empty texts and items match nothing; rows without an id are left out. Rows that
    repeat a doc_id or item_id count as one document or item that has the windows of each.
    Other columns are ignored; an empty table gives an empty result.
    """
    canon = items.where("item_id is not null and text is not null").select("item_id", slot_words(F.col("text")).alias("words"))
    canon = canon.where(F.size("words") > 0).withColumn("template", F.transform("words", template_word))
    short = sorted(r[0] for r in canon.where(F.size("words") < window).select(F.size("words")).distinct().collect())
    sizes = [window, *short]  # below the window's length, so few

    def sized(df: DataFrame, name: str, n: int, *keep: str) -> DataFrame:
        return df.select(*keep, F.posexplode(windows_of(F.col(name), n)).alias("place", "window"))

    item_windows = None
    for n in sizes:
        part = canon.where((F.size("words") >= window) if n == window else (F.size("words") == n))
        part = sized(part, "template", n, "item_id", "words").select("item_id", "window", "place", F.slice("words", F.col("place") + 1, n).alias("item_words"))
        item_windows = part if item_windows is None else item_windows.unionByName(part)
    item_windows, _ = stage(item_windows, "leak-windows")
    known = item_windows.select("item_id", "window").distinct()
    sizes_of = item_windows.groupBy("item_id").agg(F.count_distinct("window").alias("n_windows"), F.max(F.col("place") + F.size("item_words")).alias("n_words"))
    few = item_windows.count() <= BROADCAST_WINDOWS

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    templates = texts.select("doc_id", F.transform(slot_words(F.col("text")), template_word).alias("template"))
    hashes = F.flatten(F.array_compact(F.array(*(windows_of(F.col("template"), n) for n in sizes)))) if len(sizes) > 1 else windows_of(F.col("template"), window)
    hits = templates.select("doc_id", F.explode(hashes).alias("window")).join(side(known), "window")
    enough = F.col("n_matched") * 100 >= F.col("n_windows") * percent
    counted = hits.select("doc_id", "item_id", "window").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_matched"))
    candidates, _ = stage(counted.join(side(sizes_of), "item_id").where(enough).select("doc_id", "item_id"), "leak-candidates")

    ids, _ = stage(candidates.select(F.col("doc_id").alias("id")).distinct(), "leak-ids")
    found = semi_by_key(texts, ids, F.col("doc_id") == F.col("id")).withColumn("words", slot_words(F.col("text"))).select("doc_id", "words", F.transform("words", template_word).alias("template"))
    placed = None
    for n in sizes:
        part = sized(found, "template", n, "doc_id", "words").select("doc_id", "window", F.col("place").alias("doc_place"), F.slice("words", F.col("place") + 1, n).alias("doc_words"))
        part = part.join(side(item_windows.where(F.size("item_words") == n)), "window")
        placed = part if placed is None else placed.unionByName(part)
    placed = placed.join(candidates, ["doc_id", "item_id"], "left_semi")
    placed = placed.select("doc_id", "item_id", "window", (F.col("doc_place") - F.col("place")).alias("shift"), "item_words", "doc_words")
    placed, _ = stage(placed, "leak-placed")
    pair = ["doc_id", "item_id"]
    shifts = placed.groupBy(*pair, "shift").agg(F.count_distinct("window").alias("n")).join(side(sizes_of), "item_id")
    following = Window.partitionBy(*pair).orderBy("shift")
    apart = F.col("shift") - F.lag("shift").over(following) > F.col("n_words") / 2
    shifts = shifts.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("occurrence", F.sum("apart").over(following))
    slots = placed.select(*pair, "shift", F.explode(F.filter(F.arrays_zip("item_words", "doc_words"), lambda z: z["item_words"].rlike(r"^[\x01\x02]"))).alias("slot"))
    values = slots.groupBy(*pair, "shift", F.col("slot.item_words").alias("value")).agg(F.min("slot.doc_words").alias("least"), F.max("slot.doc_words").alias("most"))
    values = values.join(shifts.select(*pair, "shift", "n", "occurrence"), [*pair, "shift"])
    # the mapping of a value, and of a name back, is that of the distance with most windows
    strength = F.struct("n", -F.col("shift"))
    stands_for = F.max_by("least", strength).over(Window.partitionBy(*pair, "occurrence", "value"))
    stood_for = F.max_by("value", F.struct("n", -F.col("shift"), "value")).over(Window.partitionBy(*pair, "occurrence", "least"))
    renamed = F.col("value").startswith("\x02") & (F.col("value") != stood_for)
    values = values.withColumn("clash", (F.col("least") != F.col("most")) | (F.col("least") != stands_for) | renamed)
    verdicts = values.groupBy(*pair, "shift").agg(F.max(F.col("clash").cast("int")).alias("mixed"), F.max((F.col("least") != F.col("value")).cast("int")).alias("reworded"))
    held = placed.select(*pair, "shift", "window").distinct().join(verdicts, [*pair, "shift"], "left").where(F.coalesce("mixed", F.lit(0)) == 0)
    matched = held.groupBy("doc_id", "item_id", "window").agg(F.min(F.coalesce("reworded", F.lit(0))).alias("reworded")).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_matched"), (F.max("reworded") == 1).alias("reworded"))
    return matched.join(side(sizes_of), "item_id").where(enough).select("doc_id", "item_id", "n_windows", "n_matched", "reworded")


def without_benchmark(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that benchmark_matches finds; rows without an id or text stay."""
    ids, _ = stage(benchmark_matches(docs, items, window, percent).select(F.col("doc_id").alias("leaked_id")).distinct(), "leak-rejects")
    few = ids.count() <= BROADCAST_WINDOWS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["leaked_id"], "left_anti")
