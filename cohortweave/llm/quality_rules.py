"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger keeps the measurements and one
integer whose bit k says that rule k failed. A policy is a named mask of rules, so applying a
new version, or asking what one rule costs, is bitwise arithmetic on the ledger: no text is read again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cohortweave.llm.rows import map_texts
from cohortweave.llm.words import _WS, windows, word_hashes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_bangs", "n_stutter")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition on the measurements holds; integer arithmetic only."""

    name: str
    failed: Callable[[], Column]


RULES: tuple[Rule, ...] = (
    Rule("too_few_words", lambda: F.col("n_words") < 10),
    Rule("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule("symbols", lambda: 100 * F.col("n_symbols") > 10 * F.col("n_words")),
    Rule("upper_case", lambda: 100 * F.col("n_upper") > 40 * (F.col("n_upper") + F.col("n_lower"))),
    Rule("shouting", lambda: 100 * F.col("n_bangs") > 30 * F.col("n_words")),
    Rule("duplicate_lines", lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    Rule("stutter", lambda: 100 * F.col("n_stutter") > 30 * F.col("n_words")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 25 * F.col("n_words"))),
)
BASE = 0b11
#: Policy versions: the rules that each one enforces.
POLICIES: dict[str, int] = {"base": BASE, "v1": 0b0000111, "v2": (1 << len(RULES)) - 1}


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one whole text; a null text counts as an empty one."""
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode("utf-8", "surrogatepass")
    arr = np.frombuffer(data, np.uint8)
    h = word_hashes(data)
    counts = np.bincount(arr, minlength=256)
    repeated = 0
    if len(h) > 5:
        w = windows(h)
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        if same.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(len(h) + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            repeated = int((np.cumsum(cover) > 0).sum())
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return (
        len(h),
        len(text) - int(counts[_WS].sum()),
        int(counts[_SYMBOL].sum()),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        int(counts[65:91].sum()),
        int(counts[97:123].sum()),
        int(counts[33]),
        int((h[1:] == h[:-1]).sum()),
    )


def _measures():
    return lambda texts: tuple(np.array([measure(t) for t in texts], np.int64).reshape(len(texts), len(MEASURES)).T)


def rule_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, every measurement and fail_bits, for each row of docs; no shuffle.

    Only doc_id and text are read, so other columns may have any names. Null and empty texts
    have zero measurements (and fail the word count); a null doc_id is measured like any other; repeated rows give
    repeated rows; an empty table gives an empty one. The size of a text has no limit.
    """
    measured = map_texts(docs, _measures, ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits + F.when(rule.failed(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return measured.withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, mask: int, name: str = "kept") -> DataFrame:
    """Add a boolean: no rule of the mask failed."""
    return ledger.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0)


def ablation(ledger: DataFrame, policies: dict[str, int] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: documents, kept by the policy, failed by the rule, and kept if the rule were dropped.

    Documents are first counted by their bits, at most 2**rules rows, so the shuffle does not grow with the table.
    """
    spark = ledger.sparkSession
    counted = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    plan = [(p, mask, r.name, 1 << k) for p, mask in (policies or POLICIES).items() for k, r in enumerate(rules) if mask >> k & 1]
    grid = spark.createDataFrame(plan, "policy string, mask long, rule string, bit long")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return (
        counted.join(F.broadcast(grid))
        .groupBy("policy", "rule")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"),
            some(failed == 0)("n_kept"),
            some(failed.bitwiseAND(F.col("bit")) != 0)("n_failed"),
            some(failed == F.col("bit"))("n_only_this"),
        )
        .withColumn("n_kept_without", F.col("n_kept") + F.col("n_only_this"))
    )


def quality_rules(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with base_failed and the verdict kept of one policy version."""
    ledger = rule_ledger(docs).withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0)
    return apply_policy(ledger, POLICIES[policy] | BASE)
