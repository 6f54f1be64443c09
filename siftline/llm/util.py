"""Shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.common import spread as spread  # for costly work on inputs of a few large files


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn over every Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield fn(b)

    return df.mapInArrow(run, schema)


def pair_blocks(df: DataFrame, group: str, row: str, block: int = 1024) -> DataFrame:
    """All rows of a group against each other, without any task holding a whole group.

    Adds _i, _j: the group's rows are hashed into ceil(size / block) parts and each row is copied to
    the part pairs it belongs to, so that joining on (group, _i, _j) meets every pair of rows in
    exactly one place and no place gets more than about two parts. A group of up to `block` rows is one place.
    Returns the columns of df with _i, _j and _part.
    """
    sizes = df.groupBy(group).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_parts"))
    parts = df.join(sizes, group).withColumn("_part", F.pmod(F.xxhash64(F.col(row)), F.col("_parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    return (
        parts.withColumn("_other", other)
        .withColumn("_i", F.least("_part", "_other"))
        .withColumn("_j", F.greatest("_part", "_other"))
        .drop("_other", "_parts")
    )


def pairs_within(df: DataFrame, group: str, row: str, differ: str | None = None, block: int = 1024) -> DataFrame:
    """(a, b) with a < b for all rows of the same group; with `differ`, only where that column differs."""
    p = pair_blocks(df.select(group, row, *([differ] if differ else [])), group, row, block)
    a = p.select(F.col(group).alias("_g"), "_i", "_j", F.col(row).alias("a"), F.col("_part").alias("_pa"), *([F.col(differ).alias("_da")] if differ else []))
    b = p.select(F.col(group).alias("_g"), "_i", "_j", F.col(row).alias("b"), F.col("_part").alias("_pb"), *([F.col(differ).alias("_db")] if differ else []))
    # rows of one part meet in every place of that part: only the place (part, part) may count them
    right_place = (F.col("_pa") != F.col("_pb")) | (F.col("_i") == F.col("_j"))
    same: Column = F.col("a") < F.col("b")
    if differ:
        same = same & (F.col("_da") != F.col("_db"))
    return a.join(b, ["_g", "_i", "_j"]).where(right_place & same).select("a", "b")


def running_before(df: DataFrame, group: str, index: str, value: str, name: str, fan: int = 4096) -> DataFrame:
    """df with the sum of value over the group's rows of smaller index, in two levels: no window holds more than about `fan` rows, or rows / fan.

    index: distinct within the group, integers from 0 without large gaps.
    """
    rows = df.withColumn("_super", F.floor(F.col(index) / fan))
    before = lambda part: F.coalesce(F.sum(part).over(W.partitionBy(group, *(["_super"] if part == value else [])).orderBy(index if part == value else "_super").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    supers = rows.groupBy(group, "_super").agg(F.sum(value).alias("_sum")).withColumn("_base", before("_sum")).drop("_sum")
    return rows.withColumn("_in", before(value)).join(supers, [group, "_super"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_super", "_base", "_in")
