"""Losses over arrays of logits, as column expressions; reductions are the caller's aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.binding import bind


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def scale(logits: Column, temperature: float) -> Column:
    return F.transform(logits, lambda v: v / temperature)


def log_sum_exp(logits: Column) -> Column:
    return bind(logits, lambda x: bind(F.array_max(x), lambda m: m + F.log(_sum(F.transform(x, lambda v: F.exp(v - m))))))


def log_softmax(logits: Column) -> Column:
    return bind(logits, lambda x: bind(log_sum_exp(x), lambda lse: F.transform(x, lambda v: v - lse)))


def softmax(logits: Column) -> Column:
    return F.transform(log_softmax(logits), F.exp)


def cross_entropy(logits: Column, target: Column) -> Column:
    """Of one position; ``target`` counts from 0."""
    return log_sum_exp(logits) - F.element_at(logits, target.cast("int") + 1)


def masked_mean(value: Column, mask: Column) -> Column:
    """Aggregate: the mean of ``value`` where mask is 1; 0 where it never is."""
    m = mask.cast("double")
    return F.coalesce(F.sum(value * m), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(m), F.lit(0.0)), F.lit(1.0))


def kd_divergence(student: Column, teacher: Column, temperature: float) -> Column:
    """``T**2 * KL(teacher || student)`` of one position, both softened by the temperature."""
    log_p, log_q = log_softmax(scale(teacher, temperature)), log_softmax(scale(student, temperature))
    return _sum(F.zip_with(log_p, log_q, lambda p, q: F.exp(p) * (p - q))) * float(temperature) ** 2


def kd_blend(ce: Column, kd: Column, alpha: float) -> Column:
    return ce * (1.0 - alpha) + kd * alpha


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def dpo(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float) -> Column:
    """Of one pair of sequence log-probabilities under the policy and the reference."""
    return softplus(-(((policy_chosen - policy_rejected) - (ref_chosen - ref_rejected)) * beta))
