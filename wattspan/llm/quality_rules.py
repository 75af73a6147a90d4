"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Base measures of a whole text give the base verdict. Documents that pass go through the rules: each rule's
cost and selectivity are estimated on a bounded sample (of ``SAMPLE_DOCS`` to twice as many documents), rules are
ordered by rejection per cost, each given the ones before it, and one
``CASE`` runs them in that order, so that a document pays for no rule after the first that rejects it.
The verdict is the conjunction of all rules and does not depend on the order.

A text with no word has measures of zero and fails the base rules; null texts are the same. Rows with null
or repeated ids are judged each alone; other columns pass through, except that the operator's own
(``n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept`` and names that begin with
``_q``) replace input columns of those names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import bounded_sample, drop_path, materialise

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
SAMPLE_DOCS = 1000
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(NOT_SPACE))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _repeated(pairs: Column) -> Column:
    """Positions ``p`` of the ``(h, p)`` whose ``h`` occurs more than once; sorting, not counting, finds them."""

    def beside(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.get(s, i + 1)["h"] == x["h"], F.get(s, i - 1)["h"] == x["h"], F.lit(False))), lambda x: x["p"])

    return _let(F.sort_array(pairs), beside)


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW_WORDS`` words which the text holds more than once.

    Windows are hashed first. Without equal hashes there is no repeat; else the windows of equal hashes are
    compared as strings, so a collision changes nothing.
    """
    k = WINDOW_WORDS
    starts = F.sequence(F.lit(1), F.size(words) - (k - 1))
    window = lambda p: F.slice(words, p, F.lit(k))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(k), F.coalesce(F.get(at, i + 1) - p, F.lit(k))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def exact(hashes: Column) -> Column:
        near = _repeated(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p"))))
        at = _repeated(F.transform(near, lambda p: F.struct(F.array_join(window(p), " ").alias("h"), p.alias("p"))))
        return _let(F.sort_array(at), covered)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(exact(hashes))

    return F.when(F.size(words) <= k, F.lit(0)).otherwise(_let(F.transform(starts, lambda p: F.xxhash64(window(p))), count))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base measures and ``base_failed``; ``_q_words`` holds the words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.drop(*(c for c in (*OWN, "_q_words") if c != text_col))
    out = out.withColumn("_q_words", words_of(F.col(text_col).cast("string")))
    words = F.col("_q_words")
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": duplicate_lines(text).cast("long"),
            "n_repeat_words": _let(words, repeated_words).cast("long"),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a document that the rule rejects."""

    name: str
    rejects: Column


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules after those of published web-corpus filters; cheap ones use the base measures, others the text."""
    words, n = F.col("_q_words"), F.col("n_words")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    letters = lambda w: w.rlike(r"\p{L}")
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    lower = F.length(F.regexp_replace(text, r"[^\p{Ll}]+", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return [
        Rule("mean_word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("symbols_per_word", 10 * F.col("n_symbols") > 3 * n),
        Rule("duplicate_lines", _let(lines, lambda x: (F.size(x) >= 4) & (100 * F.col("n_dup_lines") > 30 * F.size(x)))),
        Rule("words_with_letters", 100 * F.size(F.filter(words, letters)) < 60 * n),
        Rule("upper_case", upper > lower),
        Rule("distinct_words", (n >= 50) & (100 * F.size(F.array_distinct(words)) < 10 * F.least(n, F.lit(1000)))),
        Rule("marked_words", 100 * F.size(F.filter(words, lambda w: w.rlike(r"(!!|\?\?)$"))) > 50 * n),
    ]


def rule_costs(sample: DataFrame, rules: list[Rule], runs: int = 3) -> list[float]:
    """Seconds of each rule over a stored sample: the least of some runs after one that compiles it, without
    what a scan alone takes."""

    def least(column: Column) -> float:
        seconds = []
        for _ in range(1 + runs):
            began = time.perf_counter()
            sample.agg(F.sum(column.cast("int"))).collect()
            seconds.append(time.perf_counter() - began)
        return min(seconds[1:])

    alone = least(F.col("base_failed"))
    return [max(least(F.coalesce(r.rejects, F.lit(False))) - alone, 1e-4) for r in rules]


def greedy_order(verdicts: np.ndarray, costs: list[float]) -> list[int]:
    """Places of rules, each next one with the greatest rejection per cost among documents that the ones before keep.

    ``verdicts`` has a row a document and a column a rule. Shares are smoothed, (r + 0.5) / (n + 1), so that rules that
    reject nothing in the sample still go by their cost.
    """
    left, order = list(range(verdicts.shape[1])), []
    alive = np.ones(len(verdicts), bool)
    while left:
        gain = [(verdicts[alive, k].sum() + 0.5) / (alive.sum() + 1) / costs[k] for k in left]
        k = left.pop(int(np.argmax(gain)))
        order.append(k)
        alive &= ~verdicts[:, k]
    return order


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """Rules in the order of the cascade, with seconds and the share rejected that a stored sample gave."""
    if not rules:
        return []
    costs = rule_costs(sample, rules)
    columns = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]
    verdicts = np.array([list(r) for r in sample.select(*columns).collect()], bool).reshape(-1, len(rules))
    return [(rules[k], costs[k], float(verdicts[:, k].mean()) if len(verdicts) else 0.0) for k in greedy_order(verdicts, costs)]


def cascade(ordered: list[Rule]) -> Column:
    """Name of the first rule in this order that rejects, or null."""
    out = F.when(F.col("base_failed"), F.lit("base"))
    for rule in ordered:
        out = out.when(rule.rejects, F.lit(rule.name))
    return out


def judge(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with base measures, ``base_failed`` and ``kept``."""
    rules = default_rules(text_col) if rules is None else rules
    sample, path = materialise(measured(bounded_sample(docs.select(id_col, text_col), [id_col, text_col], SAMPLE_DOCS), text_col), "rule-sample")
    ordered = [r for r, _, _ in order_rules(sample.where("NOT base_failed"), rules)]
    drop_path(docs.sparkSession, path)
    return measured(docs, text_col).withColumn("kept", cascade(ordered).isNull()).drop("_q_words")
