"""Frequency of every distinct term, kept up to date by signed deltas (problem 1).

A record is a message; its terms are (record, term, freq) with the registered counts the record came
with. Only records that were added, changed or deleted are aggregated: +1 for their new rows, -1 for
their old ones. The signed sums per term and registered counts go into a partitioned store on the
shared folder as one more generation; reading adds the generations up, and compact() merges them into
one base. As the store keeps the registered counts apart, those of a deleted record leave it with the
last record that had them. A first load is the same path with nothing before.

Plan shape: rows are reduced to (record, term), then per term by partial aggregates of plain numbers, so
a hot term costs one row per map task. The cost of a delta follows the touched records: their ids, if the
caller knows them, are all that is read of the two states; else records are compared by a hash sum.
A store has as many buckets as its first load asks for by its size.

Defined cases: rows stored twice count once (per record and term the largest freq and the largest of each
count); freq null or negative counts as 0 occurrences but the record still holds the term; term null or
empty is no term, though its record counts among all records; record null is no record. Registered counts
of a term are those at the largest message total (ties: larger bad, then larger good) among the records
that hold it. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.common import broadcast_if_small, fresh_dir, plan_bytes

#: Input bytes for which a first load makes one more bucket (a file per generation).
BUCKET_BYTES = 64 << 20
REGISTERED = ["total", "bad", "good"]
COUNTS = "bucket int, term string, total long, bad long, good long, occurrences long, records long"


@dataclass(frozen=True)
class Columns:
    record: str = "msg_id"
    term: str = "key"
    freq: str = "freq"
    bad: str = "bad"
    good: str = "good"
    msgs_bad: str = "msgs_bad"
    msgs_good: str = "msgs_good"


def record_terms(df: DataFrame, c: Columns = Columns()) -> DataFrame:
    """record, term, freq, total, bad, good: one row per record and term, and one with term null per record without any."""
    clean = lambda name: F.greatest(F.coalesce(F.col(name), F.lit(0)).cast("long"), F.lit(0))
    return (
        df.where(F.col(c.record).isNotNull())
        .select(
            F.col(c.record).cast("string").alias("record"),
            F.when(F.col(c.term) != "", F.col(c.term)).alias("term"),
            clean(c.freq).alias("freq"),
            (clean(c.msgs_bad) + clean(c.msgs_good)).alias("total"),
            clean(c.bad).alias("bad"),
            clean(c.good).alias("good"),
        )
        .groupBy("record", "term")
        .agg(*[F.max(n).alias(n) for n in ("freq", *REGISTERED)])
    )


def signed_changes(before: DataFrame | None, after: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """record, term, freq, total, bad, good, sign of the records that differ between two states (each as of record_terms).

    touched(record): the records that may differ, where a change feed names them; without it all are compared.
    """
    if before is None:
        return after.withColumn("sign", F.lit(1))

    def prints(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("record").agg(F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("term", "freq", *REGISTERED).cast("decimal(38,0)")).alias("h")).alias(name))

    if touched is not None:
        changed = broadcast_if_small(touched.select("record").distinct())
    else:
        changed = prints(before, "b").join(prints(after, "a"), "record", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("record")
    take = lambda df, sign: df.join(changed, "record", "left_semi").withColumn("sign", F.lit(sign))
    return take(before, -1).unionByName(take(after, 1))


def signed_counts(changes: DataFrame, buckets: int) -> DataFrame:
    """Changes summed per term and registered counts, with map-side combine; the row with term null holds the number of records."""
    terms = (
        changes.where("term is not null")
        .groupBy("term", *REGISTERED)
        .agg(F.sum(F.col("sign") * F.col("freq")).alias("occurrences"), F.sum("sign").cast("long").alias("records"))
        .where("occurrences <> 0 or records <> 0")
        .select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "term", *REGISTERED, "occurrences", "records")
    )
    total = (
        changes.groupBy("record", "sign").agg(F.sum(F.col("sign") * F.col("freq")).alias("occurrences"))
        .agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("records"))
        .select(F.lit(buckets).alias("bucket"), F.lit(None).cast("string").alias("term"), *[F.lit(None).cast("long").alias(n) for n in REGISTERED], "occurrences", "records")
    )
    return terms.unionByName(total)


class TermStore:
    """Counts per term in parquet generations below one folder, partitioned by term bucket.

    A generation counts only once its writer has committed it (_SUCCESS), so a lost executor or a
    repeated task leaves nothing half done. Generations are named by kind (b base, d delta), number
    and buckets; a store keeps the buckets of its first one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        live = self._generations()
        self.buckets = int(live[0][1].partition("-")[2]) if live else max(1, buckets)

    def _generations(self) -> list[tuple[int, str]]:
        """Live generations: the newest base and the deltas after it."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [(int(n[1:7]), n) for n in names if n[0] in "bd" and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        base = max((g for g, n in done if n[0] == "b"), default=0)
        return sorted((g, n) for g, n in done if g > base or g == base and n[0] == "b")

    def _write(self, df: DataFrame, kind: str, number: int) -> None:
        df.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{kind}{number:06d}-{self.buckets}", mode="overwrite")

    def apply(self, changes: DataFrame) -> TermStore:
        """One more generation from signed changes; cost follows the changes, not the store."""
        last = max((g for g, _ in self._generations()), default=0)
        self._write(signed_counts(changes, self.buckets), "d", last + 1)
        return self

    def _merged(self) -> DataFrame:
        """The generations added up per term and registered counts."""
        live = self._generations()
        if not live:
            return self.spark.createDataFrame([], COUNTS)
        union = None
        for _, name in live:
            part = self.spark.read.schema(COUNTS).parquet(f"{self.path}/{name}")
            union = part if union is None else union.unionByName(part)
        if len(live) == 1:
            return union
        return union.groupBy("bucket", "term", *REGISTERED).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))

    def compact(self) -> TermStore:
        """Merge the live generations into a base; what no record holds any more leaves the store."""
        live = self._generations()
        if len(live) > 1:
            self._write(self._merged().where("records <> 0 or occurrences <> 0 or term is null"), "b", live[-1][0])
        return self

    def counts(self) -> DataFrame:
        """term, occurrences, records, bad, good of every term held by some record."""
        held = self._merged().where("term is not null and records > 0")
        top = F.max(F.struct(*REGISTERED))
        per_term = held.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), top.alias("r"))
        return per_term.select("term", "occurrences", "records", F.col("r.bad").alias("bad"), F.col("r.good").alias("good"))

    def totals(self) -> DataFrame:
        """One row: occurrences, records of the whole collection."""
        return self._merged().where("term is null").groupBy().agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))


def marked(store: TermStore, rare_below: int = 3, common_share: float = 0.4) -> DataFrame:
    """counts() with mark: 'rare' in fewer than rare_below records, 'common' in more than common_share of all, else null."""
    common: Column = F.col("records") > F.lit(store.totals().first()["records"] * common_share)
    return store.counts().withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(common, "common"))


def count_terms(df: DataFrame, c: Columns = Columns(), buckets: int | None = None) -> TermStore:
    """First load: all records are added ones."""
    size = plan_bytes(df)  # 2**62 and more: not known
    buckets = buckets or 16 + (size // BUCKET_BYTES if size < 1 << 62 else 0)
    return TermStore(df.sparkSession, fresh_dir(df.sparkSession, "terms"), buckets).apply(signed_changes(None, record_terms(df, c)))


def load_and_update(df: DataFrame, parts: Column, c: Columns = Columns()) -> TermStore:
    """Records arriving in two parts: those where `parts` holds are loaded, the others added as a delta."""
    store = count_terms(df.where(F.coalesce(parts, F.lit(False))), c)
    return store.apply(signed_changes(None, record_terms(df.where(~F.coalesce(parts, F.lit(False))), c)))
