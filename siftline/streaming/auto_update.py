"""Streaming: classify arriving messages against the current counts and register the clear ones.

Within a micro-batch every message is scored against the same snapshot; then the counts of the clear
ones are added. That differs from strictly one-by-one updating only within a batch, and gives the
same result for the same batches however often they are retried, because a batch's counts are stored
under its number and replaced, not added, on a retry. After every `compact_every` batches the counts so far
are written as a new base, so a batch reads the base and a bounded number of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.functions.prob import status
from siftline.operators import score, tokenize
from siftline.operators.wordlist import clamp
from siftline.params import Params

DELTA = "token string, spam long, good long"


class AutoUpdate:
    """foreachBatch sink: the changes of batch n lie in <path>/deltas/batch=n, message totals in <path>/totals/batch=n, whole tables in <path>/base/upto=n."""

    def __init__(self, spark: SparkSession, path: str, p: Params = Params(), text: bool = True, compact_every: int = 16):
        self.spark, self.path, self.p, self.text, self.compact_every = spark, path.rstrip("/"), p, text, compact_every

    def start(self, base: DataFrame, msgs_spam: int, msgs_good: int) -> AutoUpdate:
        base.select("token", "spam", "good").write.mode("overwrite").parquet(f"{self.path}/base/upto=-1")
        self._totals(msgs_spam, msgs_good, -1)
        return self

    def _totals(self, msgs_spam: int, msgs_good: int, batch: int) -> None:
        self.spark.createDataFrame([(msgs_spam, msgs_good)], "spam long, good long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")

    def _bases(self) -> list[int]:
        """The batches up to which whole tables are finished."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/base")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def counts(self, before: int | None = None) -> tuple[DataFrame, int, int]:
        """Counts and message totals of all batches below a number."""
        end = F.lit(True) if before is None else F.col("batch") < before
        upto = max(b for b in self._bases() if before is None or b < before)
        rows = self.spark.read.schema(DELTA).parquet(f"{self.path}/base/upto={upto}")
        if _exists(self.spark, f"{self.path}/deltas"):
            later = self.spark.read.schema(DELTA + ", batch long").parquet(f"{self.path}/deltas").where(end & (F.col("batch") > upto)).drop("batch")
            rows = rows.unionByName(later).groupBy("token").agg(clamp(F.sum("spam")).alias("spam"), clamp(F.sum("good")).alias("good"))
        total = self.spark.read.schema("spam long, good long, batch long").parquet(f"{self.path}/totals").where(end).agg(F.sum("spam").alias("spam"), F.sum("good").alias("good")).first()  # one small row a batch
        return rows, total["spam"] or 0, total["good"] or 0

    def classify(self, messages: DataFrame, before: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(scores, tokens) of messages(id, text)."""
        table, n_spam, n_good = self.counts(before)
        found = tokenize.tokens(messages, "id", "text", self.p) if self.text else tokenize.message_tokens(messages, "id", "text", self.p)
        counted = score.with_counts(found, table, n_good, n_spam)
        return score.scores(score.rated(counted, self.p), self.p), found

    def __call__(self, messages: DataFrame, batch: int) -> None:
        scored, found = self.classify(messages.select("id", "text"), batch)
        scored = scored.persist()
        try:
            t = self.p.thresh_update
            sure_spam = (F.col("status") == self.p.tags[0]) & (F.col("spamicity") <= 1 - t if t else F.lit(True))
            sure_ham = (F.col("status") == self.p.tags[1]) & (F.col("spamicity") >= t)
            clear = scored.where(sure_spam | sure_ham).select("id", (F.col("status") == self.p.tags[0]).alias("is_spam"))
            n = lambda spam: F.coalesce(F.sum(F.when(F.col("is_spam") == spam, 1).otherwise(0)), F.lit(0)).cast("long")
            delta = found.join(clear, "id").groupBy("token").agg(n(True).alias("spam"), n(False).alias("good"))
            delta.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
            sums = clear.agg(n(True).alias("spam"), n(False).alias("good")).first()
            self._totals(sums["spam"], sums["good"], batch)
            scored.write.mode("overwrite").parquet(f"{self.path}/scores/batch={batch}")
        finally:
            scored.unpersist()
        if batch - max(self._bases()) >= self.compact_every:
            self.counts(batch + 1)[0].write.mode("overwrite").parquet(f"{self.path}/base/upto={batch}")

    def run(self, stream: DataFrame, first: int = 0) -> None:
        """Process everything a stream of (id, text) has, then stop; first: the number of its first batch, for streams that follow one another."""
        sink = lambda df, n: self(df, first + n)
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{self.path}/checkpoint/{first}").trigger(availableNow=True).start()
        q.awaitTermination()

    def scores(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/scores")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def token_ages(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """token, first_seen, last_seen, n of a stream of (ts, token), later than which counts are final."""
    return stream.withWatermark("ts", late).groupBy("token").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))
