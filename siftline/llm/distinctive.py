"""How distinctive a term is per record: parsimonious language models (problem 7).

The terms of a record are drawn from a mixture of the record's own model and the background, with
weight `own_weight` for the former. Expectation-maximisation finds the own model; its converged
probabilities rank the terms: words found everywhere are explained by the background and get next to
nothing. The background probability of a term is the share of registered messages holding it,
(bad + good + 1/2) / (msgs_bad + msgs_good + 1), over the sum of these shares over the vocabulary.

Plan shape: records of more than `stream_terms` rows are told by a partial count first. All others take one
shuffle by record and one sort and stay so at a checkpoint; the vocabulary is aggregated from there, and the sorted
rows stream through Arrow batches in which all records are iterated together with vector operations. A
longer record is not held by one task: its rows stay spread and every iteration is a partial
aggregate of one number per record.

Defined cases: term null or empty, record null: no row. Rows stored twice count once (largest
counts). freq null or below 1 counts as 1. Counts null or negative count as 0. Totals null: those of
the record's other rows, else the largest of the collection. Ties keep the same score and rank. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.common import broadcast_sized, checkpoint

OWN_WEIGHT = 0.1
ITERATIONS = 60
STREAM_TERMS = 1 << 18
OUT = "record string, term string, freq long, background double, score double"


def _rows(df: DataFrame, record: str, term: str, *by: str) -> DataFrame:
    count = lambda name: F.greatest(F.coalesce(F.col(name), F.lit(0)).cast("long"), F.lit(0))
    return (
        df.where(F.col(record).isNotNull() & (F.col(term) != ""))
        .select(
            F.col(record).cast("string").alias("record"),
            F.col(term).alias("term"),
            F.greatest(F.coalesce(F.col("freq"), F.lit(1)).cast("long"), F.lit(1)).alias("freq"),
            (count("bad") + count("good")).alias("held"),
            F.when(F.col("msgs_bad").isNotNull() & F.col("msgs_good").isNotNull(), count("msgs_bad") + count("msgs_good")).alias("total"),
        )
        .repartition(*by)
        .groupBy("record", "term")
        .agg(F.max("freq").alias("freq"), F.max("held").alias("held"), F.max("total").alias("total"))
    )


def _share(held: Column, total: Column) -> Column:
    return (held + 0.5) / (total + 1)


def mixture_em(freq: np.ndarray, background: np.ndarray, starts: np.ndarray, own_weight: float = OWN_WEIGHT, iterations: int = ITERATIONS) -> np.ndarray:
    """Own-model probabilities of many records at once; starts: first row of each record."""
    sizes = np.diff(np.append(starts, len(freq)))
    p = freq / np.repeat(np.add.reduceat(freq, starts), sizes)
    for _ in range(iterations):
        own = own_weight * p
        e = freq * own / (own + (1 - own_weight) * background)
        p = e / np.repeat(np.add.reduceat(e, starts), sizes)
    return p


def _streamed(own_weight: float, iterations: int, top: int, mass: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            code = t.column("record").combine_chunks().dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            freq, held = t.column("freq").to_numpy().astype(float), t.column("held").to_numpy()
            total = t.column("total").fill_null(-1).to_numpy()
            own = np.repeat(np.maximum.reduceat(total, starts), np.diff(np.append(starts, len(total))))  # of the record's other rows
            total = np.where(total >= 0, total, np.where(own >= 0, own, top))
            b = (held + 0.5) / (total + 1) / mass
            p = mixture_em(freq, b, starts, own_weight, iterations)
            return pa.RecordBatch.from_arrays([*(t.column(n).combine_chunks() for n in ("record", "term", "freq")), pa.array(b), pa.array(p)], ["record", "term", "freq", "background", "score"])

        open_rows: pa.Table | None = None  # the last record of a batch may go on in the next one
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            t = pa.concat_tables([open_rows, t]) if open_rows is not None else t
            code = t.column("record").combine_chunks().dictionary_encode().indices.to_numpy()
            cut = int(np.searchsorted(code, code[-1]))  # rows are sorted, so codes only grow
            if cut:
                yield scored(t.slice(0, cut))
            open_rows = t.slice(cut)
        if open_rows is not None:
            yield scored(open_rows)

    return run


def _spread_em(rows: DataFrame, own_weight: float, iterations: int, size: int) -> DataFrame:
    """The same iteration for records too long for a task: a term's probability follows from its own numbers and the sums so far."""
    rows = checkpoint(rows.withColumn("_salt", F.xxhash64("term")).repartition("_salt").drop("_salt"))
    sums = rows.groupBy("record").agg(F.array(F.sum("freq").cast("double")).alias("sums"))

    def step(p: Column, s: Column) -> Column:
        return F.col("freq") * (own_weight * p) / (own_weight * p + (1 - own_weight) * F.col("background")) / s

    def now(sums_col: Column) -> Column:
        first = F.col("freq") / sums_col[0]
        return F.aggregate(F.slice(sums_col, F.lit(2), F.greatest(F.size(sums_col) - 1, F.lit(0))), first, step)

    for _ in range(iterations):
        at = rows.join(broadcast_sized(sums, size * 3), "record")  # one row per record longer than stream_terms rows
        e = at.withColumn("_e", step(now(F.col("sums")), F.lit(1.0))).groupBy("record", "sums").agg(F.sum("_e").alias("_s"))
        sums = checkpoint(e.select("record", F.concat("sums", F.array("_s")).alias("sums")))
    return rows.join(broadcast_sized(sums, size * 3), "record").withColumn("score", now(F.col("sums"))).select("record", "term", "freq", "background", "score")


def distinctiveness(df: DataFrame, record: str = "msg_id", term: str = "key", own_weight: float = OWN_WEIGHT, iterations: int = ITERATIONS, stream_terms: int = STREAM_TERMS) -> DataFrame:
    """record, term, freq, background, score (converged probability under the record's own model)."""
    long = df.where(F.col(record).isNotNull()).groupBy(F.col(record).cast("string").alias(record)).agg(F.count("*").alias("_n")).where(F.col("_n") > stream_terms).select(record)
    long = checkpoint(long)  # at most rows / stream_terms records
    n_long, size = long.count(), 0
    giants = None
    if n_long:
        size = n_long * 256
        giants = checkpoint(_rows(df.join(broadcast_sized(long, size), record, "left_semi"), record, term, "record", "term"))
        df = df.join(broadcast_sized(long, size), record, "left_anti")
    rows = checkpoint(_rows(df, record, term, "record").sortWithinPartitions("record", "term"))

    # sum of the shares over the vocabulary and the largest total: a few numbers for the whole collection
    every = rows.select("term", "total", "held") if giants is None else rows.select("term", "total", "held").unionByName(giants.select("term", "total", "held"))
    shares = every.groupBy("term", "total").agg(F.max("held").alias("held")).groupBy("term").agg(F.max(F.struct("total", "held")).alias("k"))
    whole = shares.agg(F.max("k.total").alias("top"), F.sum(_share(F.col("k.held"), F.col("k.total"))).alias("mass"), F.count(F.when(F.col("k.total").isNull(), 1)).alias("open")).first()
    top = whole["top"] or 0
    mass = (whole["mass"] or 0.0) + whole["open"] * 0.5 / (top + 1) or 1.0

    scored = rows.mapInArrow(_streamed(own_weight, iterations, top, mass), OUT)
    if giants is None:
        return scored
    own = giants.groupBy("record").agg(F.max("total").alias("_own"))
    share = _share(F.col("held"), F.coalesce("total", "_own", F.lit(top))) / mass
    at = giants.join(broadcast_sized(own, size), "record").withColumn("background", share).select("record", "term", "freq", "background")
    return scored.unionByName(_spread_em(at, own_weight, iterations, size))
