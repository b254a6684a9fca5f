"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage
return. Null and empty texts have no words and fail the base rule. Repeated rows are judged one by
one, tables without rows give no rows, and other columns are ignored (or kept, with `filtered`). A very long
text is judged whole, in the memory of its row: one long for each window. Bounds include their ends.

The 5-word windows of a text are found by hash and position packed into one long, sorted; the windows
whose hashes meet are compared word for word, so hash collisions never count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
WINDOW = 5
POSITION_BITS = 31

#: Frequent function words of English, German, French and Spanish, fixed values.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this have from or at an not were had but he his which they "
    "der die das und ist von zu mit den dem des ein eine einer einem einen nicht auf für sich als auch im an aus er sie es "
    "le la les de des du un une et est que qui dans pour sur par au aux en avec ne pas il elle ce se "
    "el los las del y que una por con para su al lo como más pero sus"
).split()

#: (name, metric, least, most, from): a text of `from` words or more is kept only if the metric lies within its bounds.
THRESHOLDS = (
    ("words", "n_words", 10, None, 0),
    ("repeated_windows", "repeat_ratio", None, 0.20, 0),
    ("word_length", "mean_word_length", 1.5, 25.0, 0),
    ("symbols", "symbol_ratio", None, 0.35, 0),
    ("stop_words", "stop_ratio", 0.04, None, 50),
    ("duplicate_lines", "dup_line_ratio", None, 0.50, 0),
)


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def flagged(keys: Column) -> Column:
    """Of sorted (key << POSITION_BITS | position), the positions whose key a neighbour shares."""
    key = lambda x: F.shiftright(x, POSITION_BITS)
    near = F.filter(keys, lambda x, i: (key(x) == key(F.get(keys, i - 1))) | (key(x) == key(F.get(keys, i + 1))))
    return F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1).cast("long")))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 5-word window that is found twice or more."""

    def windows(h: Column) -> Column:
        starts = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.shiftleft(F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))), POSITION_BITS).bitwiseOR(i.cast("long")))

    def confirmed(at: Column) -> Column:
        whole = F.array_sort(F.transform(at, lambda p: F.struct(F.array_join(F.slice(words, (p + 1).cast("int"), WINDOW), " ").alias("w"), p.alias("p"))))
        same = lambda s: F.filter(s, lambda x, i: F.coalesce(x["w"] == F.get(s, i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False)))
        return F.sort_array(F.transform(let(whole, same), lambda x: x["p"]))

    def covered(at: Column) -> Column:
        own = F.transform(at, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(at, i - 1))).cast("long"))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    candidates = let(F.sort_array(let(hashes, windows)), flagged)
    return let(candidates, lambda at: F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(let(confirmed(at), covered)))


def metrics(text: Column) -> Column:
    """A struct of the counts of a text."""
    body = F.coalesce(text, F.lit(""))
    symbols = F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))

    def of_lines(own: Column) -> Column:
        return F.struct(F.size(own).cast("long").alias("n_lines"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeated_words(w).alias("n_repeat_words"),
        )

    return F.struct(let(words_of(body), of_words).alias("of_words"), let(lines, of_lines).alias("of_lines"), symbols.alias("n_symbols"))


def with_verdict(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS, name: str = "quality") -> DataFrame:
    """docs and a struct column: the counts, base_failed, kept, and the names of the rules that failed."""
    m = F.col(f"`{name}`")
    out = docs.withColumn(name, metrics(F.col(f"`{text}`")))
    count = {k: m["of_words"][k] for k in ("n_words", "word_chars", "n_stop_words", "n_repeat_words")} | {k: m["of_lines"][k] for k in ("n_lines", "n_dup_lines")} | {"n_symbols": m["n_symbols"]}
    ratio = lambda a, b: F.when(count[b] > 0, count[a] / count[b]).otherwise(F.lit(0.0))
    known = count | {
        "repeat_ratio": ratio("n_repeat_words", "n_words"), "mean_word_length": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_ratio": ratio("n_stop_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
    }
    base_failed = (count["n_words"] < 10) | (F.lit(100) * count["n_repeat_words"] > F.lit(20) * count["n_words"])
    outside = lambda k, least, most: reduce(lambda a, b: a | b, [*([known[k] < least] if least is not None else []), *([known[k] > most] if most is not None else [])])
    broken = [(rule, outside(k, least, most) & (count["n_words"] >= first)) for rule, k, least, most, first in thresholds]
    failed = F.filter(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in broken)), lambda x: x.isNotNull())
    kept = ~reduce(lambda a, b: a | b, (bad for _, bad in broken), base_failed)
    return out.withColumn(name, F.struct(*(v.alias(k) for k, v in count.items()), base_failed.alias("base_failed"), kept.alias("kept"), failed.alias("failed_rules")))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """A row for each document: doc_id, the counts, base_failed, kept, failed_rules."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return with_verdict(own, thresholds=thresholds).select("doc_id", "quality.*")


def filtered(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The documents that the rules keep, with the columns of docs."""
    name = "quality"
    while name in docs.columns:
        name += "_"
    return with_verdict(docs, text, thresholds, name).where(F.col(f"`{name}`")["kept"]).select(*(F.col(f"`{c}`") for c in docs.columns))
