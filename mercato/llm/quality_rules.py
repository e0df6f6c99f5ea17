"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The base measures are defined for every document. On top of them stand rules
that reject; a document is kept if no rule does. The cascade evaluates the
rules one after another and stops at the first that rejects (a CASE expression
evaluates no further branch). Its order comes from a sample: each rule's time
for a row and the patterns of rejections are measured there, and the next rule
is always the one with the most rejections for its cost among the rows that
the rules before it leave. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.operators.durable import OwnedTables

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8
#: Rows of the sample that the order is measured on.
SAMPLE_ROWS = 2_000
#: How often a timed job evaluates a rule on each row of the sample, so that the rule outweighs the job.
REPEATS = 4

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule rejects where ``rejects`` holds; it may use text, words, lines and the measures."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Limits:
    """Bounds of the rules, as whole numbers so that no rounding decides."""

    min_words: int = 20
    repeat_percent: int = 30
    words_per_symbol: int = 10
    dup_line_percent: int = 30
    min_word_length: int = 2
    max_word_length: int = 15
    upper_percent: int = 50
    letter_percent: int = 60


def base_failed(limits: Limits = Limits()) -> Column:
    n = F.col("n_words")
    return (n < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * n)


def default_rules(limits: Limits = Limits()) -> list[Rule]:
    """Rules beyond the base: noise, repeated lines, odd words, shouting, too few letters."""
    n, text = F.col("n_words"), F.col("_text")
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    upper = F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    return [
        Rule("symbols", limits.words_per_symbol * F.col("n_symbols") > n),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > limits.dup_line_percent * F.size("_lines")),
        Rule(
            "word_length",
            (F.col("word_chars") < limits.min_word_length * n) | (F.col("word_chars") > limits.max_word_length * n),
        ),
        Rule("shouting", 100 * upper > limits.upper_percent * letters),
        Rule("few_letters", 100 * letters < limits.letter_percent * F.col("word_chars")),
    ]


def _repeat_words(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order."""
    marked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def places(rows: Column) -> Column:
        twice = F.filter(
            rows,
            lambda row, i: (row["h"] == F.get(rows, i + 1)["h"]) | (row["h"] == F.get(rows, i - 1)["h"]),
        )
        return F.array_sort(F.transform(twice, lambda row: row["at"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)

    # A lambda over a one-element array names an intermediate value, so that it is built once.
    sums = F.transform(F.transform(F.transform(F.array(F.lit(0)), lambda _: marked), places), covered)
    return F.get(sums, F.lit(0))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base measures and ``_text``, ``_words``, ``_lines``.

    A null text has no words, symbols or lines. Windows are told apart by
    64-bit hashes of their words' 64-bit hashes. Columns named like a measure are replaced.
    """
    first = docs.withColumn("_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    split = first.withColumns(
        {
            "_words": F.array_remove(F.split("_text", SPACES), ""),
            "_lines": F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    hashed = split.withColumn("_hashes", F.transform("_words", lambda word: F.xxhash64(word)))
    last = F.size("_hashes") - WINDOW
    spread = hashed.withColumn(
        "_windows",
        F.when(
            last >= 0,
            F.transform(
                F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW))),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return spread.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": F.char_length(F.regexp_replace("_text", SYMBOLS, "")).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": F.when(
                F.size(F.array_distinct("_windows")) < F.size("_windows"), _repeat_words(F.col("_windows"))
            ).otherwise(F.lit(0).cast("bigint")),
        }
    ).drop("_hashes", "_windows")


def cascade_order(docs: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, most rejections for their cost first.

    The sample is a share of the rows that suits ``rows``; it is written, so
    that each rule is timed by itself, and removed again. An empty sample
    leaves the rules as given.
    """
    total = docs.count()
    if not total or not rules:
        return [rule.name for rule in rules]
    share = min(1.0, rows / total)
    with OwnedTables(docs.sparkSession, "cascade") as tables:
        picked = docs.select(F.col(f"`{text}`").alias("text"))
        if share < 1:
            picked = picked.sample(share, seed=17)
        table = tables.write(measured(picked).drop("text"), "sample")
        # What the job takes by itself, reading and repeating the rows, is no rule's cost.
        empty = _job_seconds(table, F.lit(False))
        cost = {rule.name: _seconds(table, rule.rejects, empty) for rule in rules}
        patterns = (
            table.select(*(F.coalesce(rule.rejects, F.lit(False)).alias(rule.name) for rule in rules))
            .groupBy(*(rule.name for rule in rules))
            .count()
            .collect()
        )
    left = [row.asDict() for row in patterns]
    order: list[str] = []
    waiting = [rule.name for rule in rules]
    while waiting:
        gain = {name: sum(row["count"] for row in left if row[name]) / cost[name] for name in waiting}
        best = max(waiting, key=lambda name: gain[name])
        order.append(best)
        waiting.remove(best)
        left = [row for row in left if not row[best]]
    return order


def _seconds(table: DataFrame, rejects: Column, empty: float) -> float:
    """Time of one rule over the sample without that of the job around it.

    A rule that is lost in the job's own variation costs a fiftieth of the job.
    """
    return max(_job_seconds(table, rejects) - empty, empty / 50, 1e-6)


def _job_seconds(table: DataFrame, rejects: Column) -> float:
    """Time of a job that evaluates a rule ``REPEATS`` times a row, the best of three runs."""
    names = [name for name in table.columns if name != "_again"]
    again = table.select(*names, F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("_again"))
    times = []
    for _ in range(3):
        began = time.perf_counter()
        again.select(F.count_if(rejects & (F.col("_again") > 0))).collect()
        times.append(time.perf_counter() - began)
    return min(times)


def judge(
    docs: DataFrame,
    text: str = "text",
    rules: list[Rule] | None = None,
    limits: Limits = Limits(),
    name_rule: bool = False,
) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``.

    ``name_rule`` adds ``rejected_by``, the first rule of the measured order
    that rejects (which may differ between runs where several do). A null or
    empty text fails the base. Rows are independent: repeated rows get equal
    results, an empty table an empty one. Columns named like a result are replaced.
    """
    rules = default_rules(limits) if rules is None else rules
    by_name = {rule.name: rule for rule in rules}
    order = cascade_order(docs, rules, text)
    rejected = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        rejected = rejected.when(by_name[name].rejects, F.lit(name))
    out = measured(docs, text).withColumn("base_failed", base_failed(limits)).withColumn("rejected_by", rejected)
    out = out.withColumn("kept", F.col("rejected_by").isNull()).drop("_text", "_words", "_lines")
    return out if name_rule else out.drop("rejected_by")
