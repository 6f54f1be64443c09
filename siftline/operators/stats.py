"""Statistics of count tables and of classification results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline.operators.wordlist import is_meta


def robx(table: DataFrame, msgs_spam: int, msgs_good: int, least: int = 10) -> DataFrame:
    """One row (robx, n): mean scaled spam share of the tokens seen at least `least` times."""
    scale = msgs_spam / msgs_good if msgs_good else 1.0
    seen = table.where(~is_meta(F.col("token")) & (F.col("good") + F.col("spam") >= least))
    share = F.col("spam") / (F.col("good") * F.lit(scale) + F.col("spam"))
    return seen.agg(F.avg(share).alias("robx"), F.count("*").alias("n"))


def score_bins(fw: Column, bins: int = 20) -> Column:
    return F.least(F.floor(fw * bins), F.lit(bins - 1)).cast("int")


def wordlist_histogram(table: DataFrame, fw: Column, bins: int = 20, without: str = "") -> DataFrame:
    """score, count, pct of the tokens by fw; empty bins too. without: 'hapaxes' takes tokens seen once, 'pure' those seen in one class only out of the end bins."""
    least = {"": None, "hapaxes": 1, "pure": 0}[without]
    n, single = F.col("good") + F.col("spam"), (F.col("good") == 0) | (F.col("spam") == 0)
    left_out = F.lit(False) if least is None else single & ((n == 1) if least else (n > 0))
    counted = table.where(~is_meta(F.col("token")) & ~left_out).groupBy(score_bins(fw, bins).alias("bin")).agg(F.count("*").alias("n"))
    every = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    whole = counted.agg(F.sum("n").alias("total")).first()["total"] or 0
    n = F.coalesce("n", F.lit(0))
    pct = n * 100.0 / F.lit(whole) if whole else F.lit(0.0)
    return every.join(F.broadcast(counted), "bin", "left").select((F.col("bin") / bins).alias("score"), n.alias("count"), pct.alias("pct"))


def hapaxes(table: DataFrame) -> DataFrame:
    """One row: tokens seen in one class only, and of those the ones seen once."""
    spam, good = F.col("spam"), F.col("good")
    rows = table.where(~is_meta(F.col("token")))
    return rows.agg(
        F.count_if((good > 0) & (spam == 0)).alias("ham_only"), F.count_if((good == 1) & (spam == 0)).alias("ham_hapax"),
        F.count_if((spam > 0) & (good == 0)).alias("spam_only"), F.count_if((spam == 1) & (good == 0)).alias("spam_hapax"),
    )


def confusion(scored: DataFrame, by: str, tags: tuple[str, ...]) -> DataFrame:
    """Messages per group and label, labels as columns."""
    return scored.groupBy(by).agg(*[F.count_if(F.col("status") == t).alias(t.lower()) for t in tags], F.count("*").alias("total"))


def errors_at(scored: DataFrame, cutoffs: list[float]) -> DataFrame:
    """cutoff, fp, fn: good messages at or above, spam below each cutoff; one pass over the scores."""
    cells = [F.struct(F.lit(c).alias("cutoff"), F.count_if(~F.col("is_spam") & (F.col("spamicity") >= c)).alias("fp"), F.count_if(F.col("is_spam") & (F.col("spamicity") < c)).alias("fn")) for c in cutoffs]
    return scored.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def prior_checks(n_good: int, n_spam: int, n_test_good: int, n_test_spam: int, least: int = 2000, least_test: int = 500) -> list[str]:
    """What speaks against tuning with so many messages; empty if nothing."""
    said = []
    if n_good < least or n_spam < least:
        said.append(f"at least {least} registered messages of each class are needed")
    if not n_good or not 0.1 <= n_spam / n_good <= 10:
        said.append("the classes differ more than tenfold in size")
    if n_test_good < least_test or n_test_spam < least_test:
        said.append(f"at least {least_test} test messages of each class are needed")
    return said
