"""Rule-based rewards as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length_reward(length: Column, low: int = 5000, high: int = 10240, size: float = 0.3) -> Column:
    """-size up to ``low``, size from ``high`` on, linear between."""
    return F.when(length <= low, -size).when(length >= high, size).otherwise(-size + 2 * size * (length - low) / (high - low))


def final_reward(accuracy: Column, length: Column) -> Column:
    return F.when(accuracy == 1, accuracy + length).otherwise(0.0)


def overlong_penalty(length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to ``most - buffer``, then falling by ``factor`` over the buffer."""
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def error_reward(rate: Column) -> Column:
    """exp(-12 rate^1.5) within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-12 * F.pow(rate, F.lit(1.5)))))


def composed(format_ok: Column, rule_ok: Column, judge_ok: Column) -> Column:
    """-1 for a wrong format; 1 where the rule holds; else what the judge says (null: 0)."""
    return F.when(~format_ok, -1.0).when(rule_ok, 1.0).otherwise(F.coalesce(judge_ok.cast("double"), F.lit(0.0)))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k), without bias; null where n < k."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * F.greatest(n - c - i, F.lit(0)) / (n - i))
    return F.when(n >= k, 1 - miss)


def outcome(extracted: Column, predicted_ok: Column, gold_ok: Column, equal: Column) -> Column:
    """correct, incorrect, parse_error or error; both queries failing counts as correct."""
    return (
        F.when(~extracted, "parse_error").when(~predicted_ok & ~gold_ok, "correct").when(~predicted_ok | ~gold_ok, "error")
        .when(equal, "correct").otherwise("incorrect")
    )


def grade(errors: Column) -> Column:
    return F.when(errors > 10, "D").when(errors > 5, "C").when(errors > 2, "B").otherwise("A")
