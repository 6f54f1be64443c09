"""Token probabilities, chi-square survival and the combined score, as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from siftline.params import EPS, Params


def token_probability(good: Column, bad: Column, msgs_good: Column, msgs_bad: Column, p: Params) -> Column:
    """Robinson's f(w): the share of the token in bad messages, drawn to robx with strength robs; robx for an unknown token."""
    g, b = good.cast("double"), bad.cast("double")
    n = g + b
    weighted = b * msgs_good
    share = F.when(weighted + g * msgs_bad > 0, weighted / (weighted + g * msgs_bad)).otherwise(F.lit(p.robx))
    return F.when(n > 0, (F.lit(p.robs * p.robx) + n * share) / (F.lit(p.robs) + n)).otherwise(F.lit(p.robx))


def deviates(fw: Column, p: Params) -> Column:
    return F.abs(fw - 0.5) > F.lit(p.min_dev)


def poisson_tail(y: Column, n: Column) -> Column:
    """Survival of chi-square at 2y with 2n degrees of freedom: e**-y * sum over k < n of y**k / k!, summed in log space."""
    log_y = F.ln(y)
    start = F.struct((-y).alias("t"), (-y).alias("m"), F.lit(1.0).alias("s"))

    def step(acc: Column, k: Column) -> Column:
        t = acc["t"] + log_y - F.ln(k.cast("double"))
        m = F.greatest(acc["m"], t)
        return F.struct(t.alias("t"), m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(t - m)).alias("s"))

    # sequence() counts down when its end lies below its start, so n = 1 has its own branch
    total = F.aggregate(F.sequence(F.lit(1), (n - 1).cast("int")), start, step, lambda a: a["s"] * F.exp(a["m"]))
    q = F.when((n < 1) | (y <= 0), F.lit(1.0)).when(n == 1, F.exp(-y)).otherwise(F.least(total, F.lit(1.0)))
    return F.when(q < EPS, F.lit(0.0)).otherwise(q)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x) for arrays: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    work = (x > 0) & (a > 0)
    with np.errstate(all="ignore"):
        log_front = np.where(work, a * np.log(np.where(work, x, 1)) - x - np.vectorize(math.lgamma, otypes=[float])(np.where(work, a, 1)), 0)
        low = work & (x < a + 1)
        term, total, k = 1 / np.where(low, a, 1), 1 / np.where(low, a, 1), np.where(low, a, 1)
        for _ in range(10_000):
            k = k + 1
            term = term * np.where(low, x, 0) / k
            total = total + term
            if not (term > total * 1e-16).any():
                break
        out = np.where(low, 1 - np.exp(log_front) * total, out)
        high = work & ~low
        xb, ab = np.where(high, x, 1), np.where(high, a, 0.5)
        b = xb + 1 - ab
        c, d = np.full(a.shape, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - ab)
            b = b + 2
            d = 1 / np.where((t := an * d + b) == 0, 1e-300, t)
            c = np.where((t := b + an / c) == 0, 1e-300, t)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out = np.where(high, np.exp(log_front) * h, out)
    return np.clip(out, 0, 1)


@F.pandas_udf(T.DoubleType())
def gamma_tail(a: pd.Series, x: pd.Series) -> pd.Series:
    """Chi-square survival for any degrees of freedom: Q(a, x) with a half of them and x half the statistic."""
    q = upper_gamma(a.to_numpy(), x.to_numpy())
    return pd.Series(np.where(q < EPS, 0.0, q))


def combine(ln_inv: Column, ln_fw: Column, n: Column, p: Params) -> dict[str, Column]:
    """p_value, q_value and spamicity from sum ln(1 - fw), sum ln(fw) and the number of used tokens."""
    if p.sp_esf == p.ns_esf == 1.0:
        pv, qv = poisson_tail(-ln_inv, n), poisson_tail(-ln_fw, n)
        score = (1 + qv - pv) / 2
    else:
        pv = gamma_tail(n * p.sp_esf, -ln_inv * p.sp_esf)
        qv = gamma_tail(n * p.ns_esf, -ln_fw * p.ns_esf)
        score = F.when((qv < EPS) & (pv < EPS), F.lit(0.5)).otherwise(qv / (qv + pv))
    none = n == 0
    return {"p_value": F.when(none, F.lit(1.0)).otherwise(pv), "q_value": F.when(none, F.lit(1.0)).otherwise(qv), "spamicity": F.when(none, F.lit(p.robx)).otherwise(score)}


def status(spamicity: Column, p: Params) -> Column:
    """The label: three states, or two where ham_cutoff is zero."""
    spam, ham, unsure = p.tags
    is_ham = F.lit(True) if p.ham_cutoff < EPS else spamicity <= p.ham_cutoff
    return F.when(spamicity >= p.spam_cutoff, spam).when(is_ham, ham).otherwise(unsure)
