"""Quality rules whose limits follow the data of each language and source.

Every document is measured in place with array expressions. Each measure is then
sketched per language and source: a histogram over logarithmic bins, whose counts merge by
addition and give every quantile to a fixed relative error, whatever the order of
merging. Only documents that pass the base rule are sketched, so that junk which is refused
anyway does not set a bar. An upper limit is a fence around the group's own middle and upper
tail::

    median + reach * (median - low quantile) + margin + min(slope * (upper quantile - median), rise)

It moves with the group; ``rise`` bounds how far a group whose tail is junk can lift its own bar.
Groups of few documents take the merged sketch of their language, or of all.

Cases: a null or empty text has no words; it fails the base rule and keeps its row. So do all rows of
a group in which none passes the base rule. Very long texts are measured whole. An empty table gives no rows. Null
languages and sources form a group of their own. Rows that repeat are counted as often as
they come. Ids may be null and are not used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, attach, save, text_of

#: fixed: the symbols counted
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: relative width of a bin
GAMMA = 1.02


@dataclass(frozen=True)
class Rule:
    """``over / under`` must not pass the group's upper fence (and, if asked, its lower one).

    ``upper`` is the quantile whose distance from the median lifts the fence, ``slope`` times and
    by no more than ``rise``.
    """

    name: str
    over: str
    under: str
    margin: float
    upper: float
    slope: float
    rise: float
    lower: bool = False


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 0.03, 0.95, 0.25, 0.03),
    Rule("repeats", "n_repeat_words", "n_words", 0.15, 0.98, 2.0, 0.15),
    Rule("lines", "n_dup_lines", "n_lines", 0.2, 0.98, 2.0, 0.3),
    Rule("word_length", "word_chars", "n_words", 2.0, 0.95, 2.0, 1.0, lower=True),
)
REACH, LOW, MIN_GROUP = 4.0, 0.05, 200


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, not once for each element that needs it."""
    return F.get(F.transform(F.array(value), use), 0)


def _count_of(text: Column, characters: str) -> Column:
    """How many of these ASCII characters a text has."""
    return reduce(
        lambda a, b: a + b,
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters),
    )


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that the text has twice or more."""

    def hashes(h):
        starts = F.sequence(F.lit(0), F.size(h) - F.lit(window))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + F.lit(k)) for k in range(window))))

    def covered(positions):
        steps = F.transform(
            positions,
            lambda p, i: F.least(F.lit(window), F.coalesce(F.get(positions, i + 1), p + F.lit(window)) - p),
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeats(ordered):
        same = F.filter(
            ordered,
            lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]),
        )
        return _bound(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def count(w):
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_bound(pairs, repeats))

    whole = _bound(_bound(F.transform(words, lambda x: F.xxhash64(x)), hashes), count)
    return F.when(F.size(words) > window, whole).otherwise(0)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``_row``, ``_lang``, ``_source`` and the counts of every document."""
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.trim(x, F.lit(ASCII_SPACE)) != "")
    word_list = F.array_remove(F.split("_text", "[\\x20\\x09-\\x0D]+", -1), "")
    base = docs.select(
        F.struct(*(c for c in docs.columns if c != text_col)).alias("_row"),
        F.coalesce("lang", F.lit("")).alias("_lang"),
        F.coalesce("source", F.lit("")).alias("_source"),
        text_of(text_col).alias("_text"),
    )
    counts = base.select(
        "_row", "_lang", "_source", "_text",
        _bound(
            word_list,
            lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")),
        ).alias("_words"),
        _bound(
            lines,
            lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
        ).alias("_lines"),
    )
    return counts.select(
        "_row", "_lang", "_source",
        F.col("_words.n_words").cast("long").alias("n_words"),
        (F.char_length("_text") - _count_of(F.col("_text"), ASCII_SPACE)).cast("long").alias("word_chars"),
        _count_of(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.col("_lines.dup").cast("long").alias("n_dup_lines"),
        F.col("_lines.n").cast("long").alias("n_lines"),
        F.col("_words.n_repeat_words").cast("long").alias("n_repeat_words"),
    )


def _value(rule: Rule) -> Column:
    return F.try_divide(F.col(rule.over).cast("double"), F.col(rule.under))


def sketches(features: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``_lang, _source, rule, bin, n``: the counts of each group's logarithmic bins (null: zero).

    ``features`` has ``base_failed``; such rows are left out.
    """
    values = F.explode(
        F.array(*(F.struct(F.lit(r.name).alias("rule"), _value(r).alias("v")) for r in rules))
    )
    bins = F.when(F.col("e.v") > 0, F.ceil(F.log("e.v") / F.log(F.lit(GAMMA))).cast("int"))
    return (
        features.where("n_words > 0 and not base_failed").select("_lang", "_source", values.alias("e"))
        .select("_lang", "_source", "e.rule", bins.alias("bin"))
        .groupBy("_lang", "_source", "rule", "bin").agg(F.count("*").alias("n"))
    )


def quantiles(merged: DataFrame, group: list[str], points: dict[str, float]) -> DataFrame:
    """The quantiles of merged sketches, one row for each group and rule."""
    over = Window.partitionBy(*group, "rule")
    running = over.orderBy(F.col("bin").asc_nulls_first())
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bin")) / (GAMMA + 1))
    ranked = merged.select(
        *group, "rule", value.alias("v"), F.sum("n").over(running).alias("upto"), F.sum("n").over(over).alias("all")
    )
    return ranked.groupBy(*group, "rule").agg(
        F.max("all").alias("n"),
        *(F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("v"))).alias(k) for k, p in points.items()),
    )


def limits(
    sketch: DataFrame, rules: tuple[Rule, ...] = RULES,
    reach: float = REACH, low: float = LOW, min_group: int = MIN_GROUP,
) -> DataFrame:
    """``_lang, _source`` and ``<rule>_high``, ``<rule>_low`` of every group."""
    names = {p: f"upper{k}" for k, p in enumerate(sorted({r.upper for r in rules}))}
    points = {"low": low, "mid": 0.5, "high": 1 - low} | {name: p for p, name in names.items()}
    levels = []
    for group in (["_lang", "_source"], ["_lang"], []):
        merged = sketch.groupBy(*group, "rule", "bin").agg(F.sum("n").alias("n"))
        levels.append(quantiles(merged, group, points).select(*group, "rule", F.struct("n", *points).alias(f"s{len(group)}")))
    own, by_lang, whole = levels
    chosen = (
        own.join(by_lang, ["_lang", "rule"]).join(whole, "rule")
        .withColumn("s", F.when(F.col("s2.n") >= min_group, F.col("s2")).when(F.col("s1.n") >= min_group, F.col("s1")).otherwise(F.col("s0")))
    )
    columns = []
    for r in rules:
        here = F.when(F.col("rule") == r.name, F.col("s"))
        lift = F.least(r.slope * (here[names[r.upper]] - here["mid"]), F.lit(r.rise))
        columns.append(F.max(here["mid"] + reach * (here["mid"] - here["low"]) + r.margin + lift).alias(f"{r.name}_high"))
        if r.lower:
            columns.append(F.min(here["mid"] - reach * (here["high"] - here["mid"]) - r.margin).alias(f"{r.name}_low"))
    return chosen.groupBy("_lang", "_source").agg(*columns)


def judge(
    docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
    min_words: int = 20, repeat_percent: int = 30,
    reach: float = REACH, low: float = LOW, min_group: int = MIN_GROUP,
) -> DataFrame:
    """``_row`` (the input row without its text), the counts, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    features = save(measured(docs, text_col).withColumn("base_failed", failed), "quality-counts")
    fences = save(limits(save(sketches(features, rules), "sketches"), rules, reach, low, min_group), "limits")
    joined = attach(features, fences, ["_lang", "_source"], width=F.lit(64) + 16 * len(rules) + F.octet_length("_lang") + F.octet_length("_source"))
    within = F.lit(True)
    for r in rules:
        within &= _value(r) <= F.col(f"{r.name}_high")
        if r.lower:
            within &= _value(r) >= F.col(f"{r.name}_low")
    return joined.select(
        "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"),
    )
