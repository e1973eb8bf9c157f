"""Line-first quality rules, with SQL expressions only.

Every line is judged by punctuation, navigation, boilerplate, shouting and repetition rules; lines that fail are
removed, and a document that loses too much of its text this way is rejected. A few counts of the whole text reject
documents that are too short or repeat themselves.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenframe.llm.common import SPACES, WORD_GAP, bind, once

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 40
SYMBOLS = "#*$%&|<>"
#: A line with so many words or more is text that names a phrase, not boilerplate.
BOILERPLATE_WORDS = 40
#: Fixed phrases of notices that are not part of a text, in lower case.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "apache license", "cookie policy", "creative commons", "enable javascript",
    "general public license", "licensed under", "mit license", "privacy policy", "released under the", "sign up for our newsletter",
    "subscribe to our newsletter", "terms of service", "terms of use",
)
#: Fixed marks between the entries of menus and bread crumbs.
SEPARATORS = "|»›•·→"
#: Fixed marks that may end a sentence, with closing quotes and brackets.
TERMINAL = ".!?…:;,\"'”’»)]"
#: Up to so many repeated windows are looked up one by one; more are matched by sorting, with the same result.
FEW = 24
RULES = ("punctuation", "navigation", "boilerplate", "shouting", "repetition")


def count_of(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit("[" + chars.replace("|", r"\|") + "]")).cast("long")


def _is_boilerplate(low: Column) -> Column:
    return reduce(or_, [F.contains(low, F.lit(phrase)) for phrase in BOILERPLATE])


def line_verdicts(text: Column) -> Column:
    """For each line with a word: ``line``, ``chars`` (in words), ``symbols``, ``words`` (their hashes) and ``failed``,
    the name of the first rule that it breaks."""

    def judged(line: Column, words: Column, hashes: Column, symbols: Column) -> Column:
        n = F.size(hashes)
        upper, lower = (F.char_length(F.regexp_replace(line, f"[^\\p{{{kind}}}]+", "")) for kind in ("Lu", "Ll"))
        ends = F.instr(F.lit(TERMINAL), F.right(F.get(words, n - 1), F.lit(1))) > 0
        failed = (
            F.when(count_of(line, SEPARATORS) * 3 >= n, "navigation")
            .when((symbols * 4 > n) | (count_of(line, "!?") > n) | ((n < 3) & ~ends), "punctuation")
            .when((n < BOILERPLATE_WORDS) & bind(F.lower(line), _is_boilerplate), "boilerplate")
            .when(bind(upper, lambda u: (u >= 10) & (u > lower)), "shouting")
            .when((n >= 8) & (F.size(F.array_distinct(hashes)) * 4 < n), "repetition")
        )
        chars = F.char_length(F.array_join(words, "")).cast("long")
        return F.struct(line.alias("line"), chars.alias("chars"), symbols.alias("symbols"), hashes.alias("words"), failed.alias("failed"))

    def of_line(line: Column) -> Column:
        return bind(F.split(F.btrim(line, F.lit(SPACES)), WORD_GAP), lambda w: bind(F.transform(w, lambda x: F.xxhash64(x)), lambda h: bind(
            count_of(line, SYMBOLS), lambda c: judged(line, w, h, c))))

    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != ""), of_line)


def _broke(rule: str):
    return lambda x: x["failed"] == rule


def _repeated_words(h: Column) -> Column:
    """Number of words in three-word windows that occur more than once, from the windows' hashes in text order."""

    def pairs(s: Column, same) -> Column:
        n = F.size(s) - 1
        return F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), same)

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    def of(twice: Column) -> Column:
        few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        many = bind(ordered, lambda s: F.flatten(pairs(s, lambda a, b: F.when(
            a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))))
        return F.when(F.size(twice) == 0, 0).when(F.size(twice) <= FEW, bind(few, covered)).otherwise(bind(many, covered))

    repeated = bind(F.sort_array(h), lambda s: F.array_distinct(F.array_compact(pairs(s, lambda a, b: F.when(a == b, a)))))
    return F.when(F.size(h) < 2, 0).otherwise(bind(repeated, of)).cast("long")


def assess(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
           max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """All columns of ``docs`` under ``doc``, with a struct ``quality`` beside it.

    ``quality`` has n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines,
    n_lines_removed, lost_chars, removed (map of rule to lines) and clean_text, the lines that pass. A line fails for a phrase of ``BOILERPLATE`` only
    if it has fewer than ``BOILERPLATE_WORDS`` words.
    Null and blank texts have no words and no lines and fail for shortness. Rows are judged one by one: repeated rows
    get equal verdicts, and extra columns of any name stay inside ``doc``. An empty table gives an empty table.
    """
    t = F.coalesce(F.col(f"doc.`{text}`"), F.lit(""))
    steps = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    total = lambda rows, field: F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x[field])
    steps = steps.select("doc", once(line_verdicts(t)).alias("lines"))
    steps = steps.select("doc", "lines", F.flatten(F.col("lines.words")).alias("w"))
    windows = F.when(F.size("w") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    )).otherwise(F.array().cast("array<bigint>"))
    steps = steps.select("doc", "lines", F.size("w").cast("long").alias("n_words"), once(windows).alias("h"))
    steps = steps.select(
        "doc", "n_words", total("lines", "chars").alias("word_chars"), total("lines", "symbols").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines.line"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("h")).alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
        F.filter("lines", lambda x: x["failed"].isNotNull()).alias("bad"),
        F.array_join(F.transform(F.filter("lines", lambda x: x["failed"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    steps = steps.withColumns({
        "base_failed": (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent),
        "lost_chars": total(F.col("bad"), "chars"), "n_lines_removed": F.size("bad").cast("long"),
        "removed": F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(
            *[F.size(F.filter("bad", _broke(r))) for r in RULES])),
    })
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * max_lost_percent)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rest = ("n_lines", "n_lines_removed", "lost_chars", "removed", "clean_text")
    return steps.select("doc", once(F.struct(*fields, kept.alias("kept"), *rest)).alias("quality"))
