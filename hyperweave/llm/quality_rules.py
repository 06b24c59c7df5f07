"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Words are what ASCII white space separates, lines what a line feed does. A rule compares a ratio of counts with a lower and an
upper bound; products are compared, so no row divides. Nothing is exploded or shuffled: repeated windows of words are found
inside the row, by sorting the hashes of a text that has any.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperweave.llm.common import SPACE_CLASS, SPACES

#: The most frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as at by this be from or are was an have not a "
    "le la les de des du un une et est que qui dans pour en ne pas au aux "
    "der die das und ist den von zu mit sich auf für ein eine im dem nicht auch "
    "el los las del y es que por con una su para se lo como más o"
).split()
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """low * of <= count <= high * of, in hundredths; a bound of None doesn't bind."""

    name: str
    count: str
    of: str
    low: int | None
    high: int | None


#: The production table.
RULES = (
    Rule("length", "word_chars", "n_words", 200, 2500),
    Rule("symbols", "n_symbols", "n_words", None, 25),
    Rule("marks", "n_marks", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
)


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs again: sorted hashes have equals side by side, and the union of windows is summed up."""

    def count(pairs: Column) -> Column:
        n = F.size(pairs)
        again = lambda x, i: ((i > 0) & (F.element_at(pairs, F.greatest(i, F.lit(1)))["h"] == x["h"])) | ((i < n - 1) & (F.element_at(pairs, F.least(i + 2, n))["h"] == x["h"]))
        found = F.sort_array(F.transform(F.filter(pairs, again), lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
        add = lambda a, p: F.struct((p + WINDOW).cast("long").alias("end"), (a["total"] + p + WINDOW - F.greatest(p.cast("long"), a["end"])).alias("total"))
        return F.aggregate(found, start, add, lambda a: a["total"])

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.element_at(F.transform(F.array(pairs), count), 1)  # bound once, however often it is used


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules can name, for docs (doc_id, text); null is a text without words."""
    t = F.col("text")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = base.select(
        "doc_id",
        F.array_remove(F.split(t, SPACE_CLASS), "").alias("words"),
        F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("lines"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        _without(t, SYMBOLS).cast("long").alias("n_symbols"),
        _without(t, "!?").cast("long").alias("n_marks"),
    )
    words = F.col("words")
    windows = F.when(F.size(words) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select("*", windows.alias("windows"), F.filter(words, lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS)))).alias("stops"))
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"))).otherwise(F.lit(0))
    return hashed.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        "n_marks",
        F.size("stops").cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def compiled(rules: tuple[Rule, ...]) -> list[tuple[str, Column]]:
    """One boolean column for each rule: whether it holds."""
    out = []
    for r in rules:
        bounds = [100 * F.col(r.count) >= r.low * F.col(r.of)] * (r.low is not None) + [100 * F.col(r.count) <= r.high * F.col(r.of)] * (r.high is not None)
        out.append((r.name, reduce(Column.__and__, bounds, F.lit(True))))
    return out


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures, base_failed, kept and the names of broken rules, for every row of docs (doc_id, text).

    base_failed: under 20 words, or more than 30 in 100 words in windows of eight words that occur again in the text.
    kept: neither that nor a broken rule. Repeated rows are judged alike; other columns are ignored.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in compiled(rules)]))
    rows = measures(docs).select("*", failed.alias("base_failed"), broken.alias("broken"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "n_marks", "n_stop_words", "n_lines", F.array_join("broken", ",").alias("broken"))
