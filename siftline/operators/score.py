"""Scoring: token probabilities, the tokens that count, the combined score and its explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from siftline.common import BROADCAST_BYTES, checkpoint, plan_bytes
from siftline.functions.prob import combine, deviates, status, token_probability
from siftline.params import EPS, Params


#: Tokens of the largest counts that are looked up by broadcast where the whole list is too large for that.
HEAD = 20_000


def with_counts(tokens: DataFrame, wordlist: DataFrame, msgs_good: int, msgs_bad: int, size: int | None = None, limit: int = BROADCAST_BYTES, head: int = HEAD) -> DataFrame:
    """Distinct (id, token) with the counts of one list; unknown tokens have none.

    The list is broadcast only while it is small: by its counted bytes, if given. Beyond that its head, the tokens
    of the largest counts, is broadcast, and only the others are met by a shuffle; rows that have their counts
    already are spread over it by their ids, so no task gets all rows of a frequent token.
    """
    table = wordlist.select("token", "good", F.col("spam").alias("bad"))
    if (plan_bytes(table) if size is None else size) <= limit:
        found = tokens.join(F.broadcast(table), "token", "left")
    else:
        table = checkpoint(table)
        top = table.orderBy(F.desc(F.col("good") + F.col("bad")), "token").limit(head).select("token", F.col("good").alias("_good"), F.col("bad").alias("_bad"))
        known = tokens.join(F.broadcast(top), "token", "left")
        key = F.when(F.col("_good").isNull(), F.col("token")).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64("id"), F.lit(1 << 16)).cast("string")))
        found = known.withColumn("_key", key).join(table.withColumnRenamed("token", "_key"), "_key", "left")
        found = found.select(*tokens.columns, F.coalesce("good", "_good").alias("good"), F.coalesce("bad", "_bad").alias("bad"))
    found = found.na.fill(0, ["good", "bad"])
    return found.withColumns({"msgs_good": F.lit(msgs_good).cast("bigint"), "msgs_bad": F.lit(msgs_bad).cast("bigint")})


def rated(counted: DataFrame, p: Params) -> DataFrame:
    """Adds fw and used; with token count limits, the tokens farthest from 1/2 are used instead (ties kept)."""
    fw = token_probability(F.col("good"), F.col("bad"), F.col("msgs_good"), F.col("msgs_bad"), p)
    rows = counted.withColumn("fw", fw).withColumn("used", deviates(F.col("fw"), p))
    fix, least, most = p.token_count_fix, p.token_count_min, p.token_count_max
    if not (fix or least or most):
        return rows
    by_id = W.partitionBy("id")
    n = F.count_if("used").over(by_id)
    place = F.rank().over(by_id.orderBy(F.abs(F.col("fw") - 0.5).desc()))
    out_of_limits = F.lit(bool(fix)) | (n < least) | ((n > most) if most else F.lit(False))
    return rows.withColumn("used", F.when(out_of_limits, place <= max(fix, least, most)).otherwise(F.col("used")))


def scores(rated_tokens: DataFrame, p: Params) -> DataFrame:
    """id, n_used, p_value, q_value, spamicity, status."""
    logs = lambda c: F.coalesce(F.sum(F.when(F.col("used"), F.ln(F.least(F.greatest(c, F.lit(1e-300)), F.lit(1.0))))), F.lit(0.0))
    sums = rated_tokens.groupBy("id").agg(logs(1 - F.col("fw")).alias("ln_inv"), logs(F.col("fw")).alias("ln_fw"), F.count_if("used").alias("n_used"))
    out = sums.select("id", "n_used", *[c.alias(name) for name, c in combine(F.col("ln_inv"), F.col("ln_fw"), F.col("n_used"), p).items()])
    return out.withColumn("status", status(F.col("spamicity"), p))


def explain(rated_tokens: DataFrame) -> DataFrame:
    """One row per token: n, its share of good and bad messages, fw, and '+' used, '-' not used, 'i' ignored."""
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(F.lit(0.0))
    flag = F.when(F.col("used"), "+").otherwise("-")
    if "ignored" in rated_tokens.columns:
        flag = F.when(F.col("ignored"), "i").otherwise(flag)
    return rated_tokens.select("id", "token", (F.col("good") + F.col("bad")).alias("n"), share("good", "msgs_good").alias("pgood"), share("bad", "msgs_bad").alias("pbad"), "fw", flag.alias("flag"))


def in_order(explained: DataFrame) -> DataFrame:
    """explain() with the place of each token in its message: by probability and token, and by token alone; a message's own tokens only."""
    by_id = W.partitionBy("id")
    return explained.withColumns({"place": F.row_number().over(by_id.orderBy("fw", "token")), "place_by_token": F.row_number().over(by_id.orderBy("token"))})


def data_frame(rated_tokens: DataFrame, p: Params) -> DataFrame:
    """explain() with the logarithms of 1 - fw and fw, and one summary row per message (token null): n the used tokens, pgood P, pbad Q, fw the score, the logs those of robs and robx."""
    logs = explain(rated_tokens).withColumns({"invfwlog": F.ln(F.greatest(1 - F.col("fw"), F.lit(1e-300))), "fwlog": F.ln(F.greatest("fw", F.lit(1e-300)))})
    last = scores(rated_tokens, p).select("id", F.lit(None).cast("string").alias("token"), F.col("n_used").alias("n"), F.col("p_value").alias("pgood"), F.col("q_value").alias("pbad"), F.col("spamicity").alias("fw"), F.lit("=").alias("flag"), F.lit(p.robs).alias("invfwlog"), F.lit(p.robx).alias("fwlog"))
    return logs.unionByName(last)


def message_histogram(rated_tokens: DataFrame, p: Params, bins: int = 10) -> DataFrame:
    """id, bin, cnt, prob, spamicity for every bin [i/bins, (i+1)/bins): used tokens (fw = 1 in none), their mean, and the
    score from the geometric means over all used tokens of what lies below the bin's end. One aggregate per message."""
    used, fw = F.col("used"), F.col("fw")
    sums = []
    for i in range(bins):
        inside = used & (fw >= i / bins) & (fw < (i + 1) / bins)
        below = used & (fw < (i + 1) / bins)
        total = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0.0))
        sums.append(F.struct(F.lit(i).alias("bin"), F.count_if(inside).alias("cnt"), total(inside, fw).alias("prob"), total(below, F.ln(fw)).alias("f"), total(below, F.ln(1 - fw)).alias("i")))
    rows = rated_tokens.groupBy("id").agg(F.count_if("used").alias("n"), F.array(*sums).alias("bins")).select("id", "n", F.explode("bins").alias("b"))
    pi, pf = 1 - F.exp(F.col("b.i") / F.col("n")), 1 - F.exp(F.col("b.f") / F.col("n"))
    score = F.when(F.col("n") == 0, F.lit(p.robx)).when(pi + pf < EPS, F.lit(0.0)).otherwise((1 + (pi - pf) / (pi + pf)) / 2)
    return rows.select("id", "b.bin", "b.cnt", F.when(F.col("b.cnt") > 0, F.col("b.prob") / F.col("b.cnt")).otherwise(F.lit(0.0)).alias("prob"), score.alias("spamicity"))
