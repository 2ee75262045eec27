"""Quality rules with risk-controlled cutoffs.

A rule rejects a document whose statistic lies beyond a cutoff. For every rule, stratum (language) and candidate cutoff the
good documents of the labelled hold-out that it would reject are counted; a cutoff is certified if the exact (Clopper-Pearson)
upper bound of its false rejection rate, at a confidence that is corrected for all tests made, stays within the rule's share
of the allowed risk. Of the certified cutoffs of a rule and stratum, the one with the largest surplus of bad over good documents
rejected holds, the most lenient among equals; without a surplus the rule is not used there. So, with probability ``1 - DELTA`` over the
draw of the hold-out, no stratum loses more than ``RISK`` of its good documents to all rules together.

Candidate cutoffs are parameters and never depend on labels, hence no part of the labelled rows has to be set aside for them.
A stratum with too few labelled documents to certify anything has no cutoff and loses nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.statistics import count_documents
from tessella.llm.tables import written


@dataclass(frozen=True)
class Rule:
    """Rejects above (``sign`` 1) or below (``sign`` -1) a cutoff; cutoffs stand from strict to lenient."""

    name: str
    value: str
    sign: int
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", 1, (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3)),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", 1, (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", 1, (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", 1, (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0)),
    Rule("short_words", "word_chars / greatest(n_words, 1)", -1, (4.0, 3.5, 3.0, 2.5, 2.0, 1.5)),
    Rule("capitals", "n_upper / greatest(word_chars, 1)", 1, (0.1, 0.15, 0.2, 0.3, 0.5, 0.7)),
)
RISK, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT = 10, 20


def certified(rejected: int, total: int, risk: float, level: float) -> bool:
    """Whether the exact upper confidence bound of a rate, ``rejected`` of ``total`` seen, is at most ``risk``.

    The bound is at most ``risk`` exactly if a binomial of that rate gives so few rejections with probability ``level`` or less.
    """
    if rejected > risk * total:
        return False
    top = (
        math.lgamma(total + 1) - math.lgamma(rejected + 1) - math.lgamma(total - rejected + 1)
        + rejected * math.log(risk) + (total - rejected) * math.log1p(-risk)
    )
    tail, term, k = 0.0, 1.0, rejected
    while term > 1e-17 * tail:
        tail += term
        if k == 0:
            break
        term *= k * (1 - risk) / ((total - k + 1) * risk)
        k -= 1
    return top + math.log(tail) <= math.log(level)


def base_failed() -> Column:
    """The rules that need no label: too few words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _beyond(rule: Rule, cutoff: Column | float) -> Column:
    value = F.expr(rule.value)
    return value > cutoff if rule.sign > 0 else value < cutoff


def choose_cutoffs(stats: DataFrame, holdout: DataFrame, rules=RULES, risk: float = RISK, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Certified cutoffs, by rule and stratum.

    stats: ``COUNTS`` with ``doc_id`` and ``stratum``; holdout: ``doc_id`` and ``good`` (1 or 0). One aggregation counts all
    tests; what reaches the driver is one row per stratum, a name each: as small as the number of strata.
    """
    known = holdout.where("good IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("good").alias("good"))
    tested = [(r, c) for r in rules for c in r.cutoffs]
    counts = [F.count_if((F.col("good") == g) & _beyond(r, c)).alias(f"t{i}_{g}") for i, (r, c) in enumerate(tested) for g in (0, 1)]
    judged = stats.where(~base_failed()).join(known, "doc_id")
    rows = judged.groupBy("stratum").agg(F.count_if(F.col("good") == 1).alias("total"), *counts).collect()
    level = delta / max(1, len(rows) * len(tested))
    out: dict[str, dict[str, float]] = {r.name: {} for r in rules}
    for row in rows:
        most = dict.fromkeys(out, 0)
        for i, (rule, cutoff) in enumerate(tested):
            bad, good = row[f"t{i}_0"], row[f"t{i}_1"]
            if bad - good > 0 and bad - good >= most[rule.name] and certified(good, row.total, risk / len(rules), level):
                most[rule.name], out[rule.name][row.stratum] = bad - good, cutoff
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: Column | None = None, rules=RULES, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Statistics and verdict of every document.

    docs: ``doc_id``, ``text`` and what ``stratum`` needs (``lang`` if not given; null is a stratum of its own, ``""``).
    labels: ``doc_id`` and ``quality``; null labels take no part. A null text counts as empty and fails the base rules, as any
    text of fewer than ten words does. Rows with the same ``doc_id`` are judged one by one. Only the columns named here are read,
    so further columns may have any name.
    """
    key = F.coalesce((F.col("lang") if stratum is None else stratum).cast("string"), F.lit(""))
    stats = written(count_documents(docs, stratum=key), "rule-stats")
    cutoffs = choose_cutoffs(stats, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("good")), rules, risk, delta)
    broken = F.lit(False)
    for rule in rules:
        for name, cutoff in cutoffs[rule.name].items():
            broken = broken | ((F.col("stratum") == name) & _beyond(rule, cutoff))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(broken, F.lit(False)))
