"""Training loops around registration: train on error, and a reproducible shuffle of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline.common import checkpoint, running_before
from siftline.operators import score, wordlist
from siftline.params import Params


def scrambled(df: DataFrame, id_col: str = "id", seed: int = 0) -> DataFrame:
    """Rows in a random order that the seed fixes: a range sort by the digest of seed and id."""
    return df.orderBy(draw(id_col, seed), id_col)


def draw(id_col: str, seed: int = 0) -> Column:
    """A random-looking string that seed and id fix."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def in_batches(labels: DataFrame, parts: int, order: str = "random", seed: int = 0) -> DataFrame:
    """labels(id, is_spam) with part, 0 to parts - 1.

    random: by the digest of the id, as a random order would cut them. balanced: each class is put in that order and
    cut evenly, so that spam and good messages alternate in the ratio of the whole.
    """
    drawn = labels.withColumn("_draw", draw("id", seed))
    if order == "random":
        number = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long")
        return drawn.withColumn("part", F.floor(number * parts / F.lit(1 << 32)).cast("int")).drop("_draw")
    n = {r["is_spam"]: r["n"] for r in labels.groupBy("is_spam").agg(F.count("*").alias("n")).collect()}
    size = F.when(F.col("is_spam"), F.lit(max(n.get(True, 1), 1))).otherwise(F.lit(max(n.get(False, 1), 1)))
    placed = running_before(drawn, "is_spam", ["_draw", "id"], {"_place": F.lit(1)})
    return placed.withColumn("part", F.floor(F.col("_place") * parts / size).cast("int")).drop("_draw", "_place")


def train_on_error(tokens: DataFrame, labels: DataFrame, p: Params, rounds: int = 3, parts: int = 4, order: str = "random", seed: int = 0) -> DataFrame:
    """token, spam, good after the last round: only wrongly or unsurely scored messages are registered.

    Messages arrive in `parts` batches (see in_batches; every round draws anew); each batch is scored with the counts
    so far and its errors are added. Rounds repeat until one has no error or `rounds` are done.
    """
    spark = tokens.sparkSession
    table = spark.createDataFrame([], "token string, spam long, good long")
    n_spam = n_good = 0
    for turn in range(rounds):
        errors = 0
        placed = checkpoint(in_batches(labels, parts, order, seed + turn))
        for k in range(parts):
            known = placed.where(F.col("part") == k).drop("part")
            found = tokens.join(known.select("id"), "id", "left_semi")
            scored = score.scores(score.rated(score.with_counts(found, table, n_good, n_spam), p), p)
            right = F.when(F.col("is_spam"), p.tags[0]).otherwise(p.tags[1])
            wrong = checkpoint(known.join(scored, "id").where(F.col("status") != right).select("id", "is_spam"))
            n = wrong.agg(F.count_if("is_spam").alias("s"), F.count("*").alias("n")).first()
            if n["n"]:
                table = checkpoint(wordlist.apply_counts(table, wordlist.register(found, wrong)))
                n_spam, n_good, errors = n_spam + n["s"], n_good + n["n"] - n["s"], errors + n["n"]
        if not errors:
            break
    return table
