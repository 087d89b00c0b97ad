"""Operator 1, quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on the statistics of a whole text. Votes of all rows are counted by
pattern, expectation-maximisation estimates what each rule's vote is worth, and the posterior probability of quality
decides, rather than every rule having to pass.

Defined results: a null text counts as empty (no words: base_failed); a row in gives a row out, also for repeated rows
and null ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, store
from .docstats import FEATURES, with_stats
from .label_model import LabelModel, fit, patterns

MIN_WORDS = 50
POSTERIOR = 0.5


def _share(a: str, b: str = "n_words") -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """The rules: each is a vote over FEATURES."""
    mean = _share("word_chars")
    return {
        "r_length": _vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 100),
        "r_symbols": _vote(_share("n_symbol_words") > 0.1, _share("n_symbol_words") < 0.02),
        "r_lines": _vote(_share("n_dup_lines", "n_text_lines") > 0.3, (F.col("n_dup_lines") == 0) & (F.col("n_text_lines") >= 2)),
        "r_repeats": _vote(_share("n_repeat_words") > 0.3, _share("n_repeat_words") < 0.05),
        "r_mean_word": _vote((mean < 2.5) | (mean > 12), mean.between(3, 9)),
        "r_stop_words": _vote(_share("n_stop") < 0.06, _share("n_stop") > 0.12),
        "r_capitals": _vote(_share("n_upper_words") > 0.3, _share("n_upper_words") < 0.05),
        "r_exclaim": _vote(_share("n_exclaim") > 0.1, _share("n_exclaim") < 0.02),
        "r_letters": _vote(_share("n_alpha_words") < 0.6, _share("n_alpha_words") > 0.75),
        "r_variety": _vote(_share("n_unique") < 0.2, _share("n_unique") > 0.35),
    }


def estimate(voted: DataFrame) -> LabelModel:
    """What the votes of all rows say about the rules. A row with a bad vote starts as more likely bad than good."""
    votes, counts = patterns(voted, names := list(rules()))
    bad = (votes < 0).sum(1) if len(votes) else None
    return fit(votes, counts, names, start=None if bad is None else 1 / (1 + 0.25 * 6.0**bad))


def quality_rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = POSTERIOR) -> DataFrame:
    """``keep`` columns, FEATURES, votes, base_failed, posterior and kept. Statistics are stored once, then voted on."""
    held = store(with_stats(docs, list(keep)).withColumns(rules()), "quality-rules")
    model = estimate(held)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = held.withColumns({"base_failed": failed, "posterior": model.posterior({n: F.col(n) for n in model.names})})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", *FEATURES[:5], "base_failed", "kept", "posterior")
