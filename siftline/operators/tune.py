"""Parameter search: grids, false-positive targets, order statistics and the choice of a smooth minimum.

Token counts of the messages are joined and brought together by message once; a grid cell only redoes the
arithmetic. One Arrow pass scores every message for all cells: the sums over its tokens are shared by
the cells that differ in exponents only, the chi-square tails by those that differ in the other exponent. What
leaves a task is a few numbers per cell: first the highest good scores, from which each cell's cutoff
follows, then the spam below it. The size of a message does not matter, as sums go on over batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from siftline.common import broadcast_if_small, checkpoint
from siftline.functions.prob import upper_gamma
from siftline.params import EPS, Params

SPAM_CUTOFF, MIN_CUTOFF, HAM_CUTOFF, CERTAIN = 0.975, 0.55, 0.10, 0.999999

# Fixed values of the search, per dimension: the range allowed, the coarse values as (first, last, step) or as
# (steps to either side, step) of a centre, the fine ones as (reach, step) around the best; robs in powers of ten.
SEARCH = {
    "robs": {"range": (-2.0, 0.0), "coarse": (-2.0, 0.0, 1.0), "fine": (0.5, 0.25), "power": True},
    "min_dev": {"range": (0.01, 0.499), "coarse": (0.05, 0.45, 0.1), "fine": (0.042, 0.014)},
    "robx": {"range": (0.4, 0.6), "coarse": (2, 0.05), "fine": (0.026, 0.013), "centred": True},
    "sp_exp": {"range": (0.0, 20.0), "coarse": (2.0, 20.0, 3.0), "fine": (1.5, 0.5)},
    "ns_exp": {"range": (0.0, 20.0), "coarse": (2.0, 20.0, 3.0), "fine": (1.5, 0.5)},
}


def values(name: str, around: float | None = None, fine: bool = False) -> tuple[float, ...]:
    """The values of a dimension; those with a centre by their distance from it, powers from the highest down."""
    d = SEARCH[name]
    low, high = d["range"]
    if d.get("centred"):
        step = d["fine"][1] if fine else d["coarse"][1]
        centre = float(np.clip(around, low, high))
        grid = centre + step * np.array([0, -1, 1, -2, 2])
        grid = grid[(grid >= low - 1e-9) & (grid <= high + 1e-9)]
    else:
        if fine:
            at, (reach, step) = math.log10(around) if d.get("power") else around, d["fine"]
            first, last = max(at - reach, low), min(at + reach, high)
        else:
            first, last, step = d["coarse"]
        grid = np.arange(first, last + step * 1e-6, step)
    return tuple((10.0 ** grid[::-1] if d.get("power") else grid).round(12).tolist())


@dataclass(frozen=True)
class Grid:
    """Values per dimension; cells are numbered in the order robs, min_dev, robx, spam exponent, ham exponent."""

    robs: tuple[float, ...]
    min_dev: tuple[float, ...]
    robx: tuple[float, ...]
    sp_exp: tuple[float, ...] = (0.0,)
    ns_exp: tuple[float, ...] = (0.0,)

    def shape(self) -> tuple[int, ...]:
        return tuple(map(len, (self.robs, self.min_dev, self.robx, self.sp_exp, self.ns_exp)))

    def cells(self) -> list[tuple[int, tuple[int, ...], Params]]:
        out = []
        for idx, at in enumerate(product(*map(range, self.shape()))):
            rs, md, rx, sp, ns = at
            out.append((idx, at, replace(Params(), robs=self.robs[rs], min_dev=self.min_dev[md], robx=self.robx[rx], sp_esf=0.75 ** self.sp_exp[sp], ns_esf=0.75 ** self.ns_exp[ns])))
        return out


def coarse_grid(robx: float, esf: bool = True) -> Grid:
    return Grid(*(values(n, robx) for n in ("robs", "min_dev", "robx")), *([values("sp_exp"), values("ns_exp")] if esf else []))


def fine_grid(best: Params, sp_exp: float = 0.0, ns_exp: float = 0.0, esf: bool = True) -> Grid:
    """Narrower steps around a cell of the coarse grid."""
    at = {"robs": best.robs, "min_dev": best.min_dev, "robx": best.robx, "sp_exp": sp_exp, "ns_exp": ns_exp}
    return Grid(*(values(n, x, fine=True) for n, x in at.items() if esf or not n.endswith("exp")))


LIST_COUNT, TEST_COUNT = 2000, 500


def train_share(n: int) -> float:
    """The share of so many messages of a class that is for training: 4 of 5 while they are few, then less, down to half."""
    few, many = LIST_COUNT + TEST_COUNT, 2 * LIST_COUNT
    place = min(max((n - few) / (many - few), 0.0), 1.0)
    ratio = LIST_COUNT / TEST_COUNT + (1 - LIST_COUNT / TEST_COUNT) * place
    return ratio / (1 + ratio)


def split_for_tuning(messages: DataFrame, n_good: int, n_spam: int) -> DataFrame:
    """Adds role ('train', or 'score' with bin 0..2) to messages(id, is_spam) by digits of the id's MD5: the share of each class follows its size, without a sort."""
    digest = F.md5(F.col("id").cast("string"))
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("long")
    share = F.when(F.col("is_spam"), F.lit(train_share(n_spam))).otherwise(F.lit(train_share(n_good)))
    return messages.withColumn("role", F.when(number(1, 8) < share * (1 << 32), "train").otherwise("score")).withColumn("bin", F.pmod(number(9, 4), F.lit(3)).cast("int"))


_INPUT = ["id", "is_spam", "good", "bad", "msgs_good", "msgs_bad"]


def by_message(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """Counted tokens with their message's class, brought together by message, ready for any number of scans."""
    rows = counted.join(broadcast_if_small(labels.select("id", "is_spam")), "id").select(*_INPUT)
    return checkpoint(rows.repartition("id").sortWithinPartitions("id"))


def token_sums(batch: pa.RecordBatch, starts: np.ndarray, grid: Grid) -> np.ndarray:
    """(sum of ln(1 - fw), sum of ln(fw), number) of used tokens: 3 x robs x min_dev x robx x messages."""
    good, bad, mg, ms = (batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in _INPUT[2:])
    n, weighted = good + bad, bad * mg
    known = weighted + good * ms
    out = np.empty((3, len(grid.robs), len(grid.min_dev), len(grid.robx), len(starts)))
    for (i, s), (k, x) in product(enumerate(grid.robs), enumerate(grid.robx)):
        share = np.where(known > 0, weighted / np.where(known > 0, known, 1), x)
        fw = np.where(n > 0, (s * x + n * share) / (s + n), x)
        logs = np.log(np.clip(np.stack([1 - fw, fw]), 1e-300, 1.0))
        for j, d in enumerate(grid.min_dev):
            used = np.abs(fw - 0.5) > d
            out[:2, i, j, k] = np.add.reduceat(np.where(used, logs, 0.0), starts, axis=1)
            out[2, i, j, k] = np.add.reduceat(used.astype(float), starts)
    return out


def cell_scores(sums: np.ndarray, grid: Grid) -> np.ndarray:
    """Spamicity of each cell, in its order, for each message: cells x messages."""
    def tails(logs: np.ndarray, exponents: tuple[float, ...]) -> np.ndarray:
        factor = 0.75 ** np.array(exponents).reshape(-1, 1)
        flat, n = logs.reshape(1, -1), sums[2].reshape(1, -1)
        q = upper_gamma(n * factor, -flat * factor).reshape(len(exponents), *logs.shape)
        return np.where(q < EPS, 0.0, q)

    p, q = tails(sums[0], grid.sp_exp)[:, None], tails(sums[1], grid.ns_exp)[None]  # spam exponent x ham exponent x the rest
    with np.errstate(invalid="ignore"):
        s = np.where((p == 0) & (q == 0), 0.5, q / (p + q))
    robx = np.array(grid.robx).reshape(1, 1, 1, 1, -1, 1)
    s = np.where(sums[2][None, None] == 0, robx, s)
    return np.moveaxis(s, (0, 1), (3, 4)).reshape(-1, sums.shape[-1]).round(9)


def scored_messages(batches: Iterator[pa.RecordBatch], grid: Grid) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, is_spam, scores: cells x messages) of a stream of by_message rows; a message may go on over batches."""
    held: tuple | None = None  # id, class and sums of the message that may go on
    for b in batches:
        if not b.num_rows:
            continue
        code = b.column("id").dictionary_encode()
        starts = np.flatnonzero(np.diff(code.indices.to_numpy(), prepend=-1))
        ids, spam = b.column("id").take(pa.array(starts)).to_pylist(), b.column("is_spam").to_numpy(zero_copy_only=False)[starts].astype(bool)
        sums = token_sums(b, starts, grid)
        if held is not None:
            if held[0] == ids[0]:
                sums[..., 0] += held[2]
            else:
                yield [held[0]], np.array([held[1]]), cell_scores(held[2][..., None], grid)
        held = (ids[-1], spam[-1], sums[..., -1].copy())
        for at in range(0, len(ids) - 1, 512):
            end = min(at + 512, len(ids) - 1)
            yield ids[at:end], spam[at:end], cell_scores(sums[..., at:end], grid)
    if held is not None:
        yield [held[0]], np.array([held[1]]), cell_scores(held[2][..., None], grid)


def grid_scores(rows: DataFrame, grid: Grid) -> DataFrame:
    """idx, id, is_spam, spamicity of every cell and message, for small grids and for looking at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, spam, s in scored_messages(batches, grid):
            cells, n = s.shape
            at = np.tile(np.arange(n), cells)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(cells, dtype=np.int32), n)), pa.array(ids).take(pa.array(at)), pa.array(spam[at]), pa.array(s.reshape(-1))], ["idx", "id", "is_spam", "spamicity"])

    return rows.mapInArrow(run, f"idx int, id {rows.schema['id'].dataType.simpleString()}, is_spam boolean, spamicity double")


def grid_results(rows: DataFrame, grid: Grid, target: int) -> DataFrame:
    """One row per cell: its place and parameters, cutoff, fp and fn, of by_message rows.

    The cutoff is the target-th highest good score, or, where that is all but 1, the highest one that is not: fp is its
    place among the good scores, fn the number of spam below it.
    """
    n_cells = math.prod(grid.shape())
    spark = rows.sparkSession

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, below = np.full((n_cells, target), -1.0), np.full(n_cells, -1.0)
        certain, least, n = np.zeros(n_cells, np.int64), np.full(n_cells, 2.0), 0
        for _, spam, s in scored_messages(batches, grid):
            s = s[:, ~spam]
            n += s.shape[1]
            if s.shape[1]:
                top = -np.sort(-np.hstack([top, s]), axis=1)[:, :target]
                sure = s >= CERTAIN
                certain += sure.sum(1)
                below = np.maximum(below, np.where(sure, -1.0, s).max(1))
                least = np.minimum(least, s.min(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_cells, dtype=np.int32)), pa.array(list(top), pa.list_(pa.float64())), pa.array(below), pa.array(least), pa.array(certain), pa.array([n] * n_cells, pa.int64())], ["idx", "top", "below", "least", "certain", "n"])

    per_task = rows.mapInArrow(highest, "idx int, top array<double>, below double, least double, certain long, n long")
    merged = per_task.groupBy("idx").agg(F.flatten(F.collect_list("top")).alias("top"), F.max("below").alias("below"), F.min("least").alias("least"), F.sum("certain").alias("certain"), F.sum("n").alias("n"))  # `target` numbers per task
    kth = F.element_at(F.sort_array("top", asc=False), target)
    cut = F.when(F.col("n") < target, F.col("least")).when(F.col("certain") < target, kth).when(F.col("certain") < F.col("n"), F.col("below")).otherwise(F.col("least"))
    place = F.when(F.col("n") < target, F.col("n")).when(F.col("certain") < target, F.lit(target)).otherwise(F.least(F.col("certain") + 1, F.col("n")))
    found = {r["idx"]: r for r in merged.select("idx", cut.alias("cutoff"), place.cast("int").alias("fp")).collect()}  # one row per cell
    cutoffs = np.array([found[k]["cutoff"] if k in found else 2.0 for k in range(n_cells)])

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = np.zeros(n_cells, np.int64)
        for _, spam, s in scored_messages(batches, grid):
            fn += (s[:, spam] < cutoffs[:, None]).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_cells, dtype=np.int32)), pa.array(fn)], ["idx", "fn"])

    names = "idx int, rsi int, mdi int, rxi int, spi int, nsi int, robs double, min_dev double, robx double, sp_esf double, ns_esf double, cutoff double, fp int"
    cells = spark.createDataFrame([(idx, *where, p.robs, p.min_dev, p.robx, p.sp_esf, p.ns_esf, found[idx]["cutoff"], found[idx]["fp"]) for idx, where, p in grid.cells() if idx in found], names)
    return rows.mapInArrow(missed, "idx int, fn long").groupBy("idx").agg(F.sum("fn").alias("fn")).join(F.broadcast(cells), "idx")  # one row per cell


def target_of(n_good: int) -> int:
    """False positives to aim at for so many good messages; never more than 25."""
    x = math.log(max(n_good, 1))
    return max(int((-0.4831 * x + 12.8976) * x - 61.5264 + 0.5), 1)


def threshold(scores: DataFrame) -> tuple[int, float]:
    """(target, cutoff) from spamicity of good messages: the target lowered until its cutoff is high enough, and the cutoff capped.

    Only as many of the highest scores as the target are collected, and a count of those above the cap.
    """
    n = scores.agg(F.count("*").alias("n"), F.count_if(F.col("spamicity") > SPAM_CUTOFF).alias("above")).first()
    if not n["n"]:
        return 1, SPAM_CUTOFF
    top = [r[0] for r in scores.select("spamicity").orderBy(F.desc("spamicity")).limit(min(target_of(n["n"]), n["n"])).collect()]
    target = next((k for k in range(len(top), 0, -1) if top[k - 1] >= MIN_CUTOFF), 1)
    if top[target - 1] > SPAM_CUTOFF:
        return n["above"], SPAM_CUTOFF
    return target, top[target - 1]


def quality_checks(scored: DataFrame, share: float = 0.01) -> DataFrame:
    """class, at, score, suspicious: the score at the place of `share` among the highest good and the lowest spam scores of (is_spam, spamicity); suspicious where messages look wrongly filed."""
    scored = checkpoint(scored.select("is_spam", "spamicity"))
    n = scored.agg(F.count_if(~F.col("is_spam")).alias("g"), F.count_if("is_spam").alias("s")).first()
    spark, out = scored.sparkSession, []
    for name, count, rows in (("good", n["g"], scored.where("not is_spam")), ("spam", n["s"], scored.where("is_spam").withColumn("spamicity", 1 - F.col("spamicity")))):
        if count:
            at = math.ceil(count * share)
            s = order_statistics(rows, [at])[0]
            out.append((name, at, s if name == "good" else 1 - s, s >= SPAM_CUTOFF if name == "good" else 1 - s <= HAM_CUTOFF + EPS))
    return spark.createDataFrame(out, "class string, at long, score double, suspicious boolean")


def best_cells(results: DataFrame, target: int, n: int = 10) -> DataFrame:
    """The n cells of fewest false negatives (then lowest cutoff, then number) among those at the target; all cells where none is."""
    on_target = F.max((F.col("fp") == target).cast("int")).over(W.partitionBy(F.lit(1)))  # one row per cell
    return results.withColumn("_any", on_target).where((F.col("_any") == 0) | (F.col("fp") == target)).drop("_any").orderBy("fn", "cutoff", "idx").limit(n)


def quantile_fn(results: DataFrame, share: float) -> int:
    """fn at the place floor(n * share) of the cells in order, without interpolation."""
    n = results.count()
    row = results.orderBy("fn", "cutoff", "idx").offset(int(n * share)).limit(1).first()
    return row["fn"] if row else 0


def smooth_minimum(results: DataFrame, grid: Grid, target: int) -> DataFrame:
    """The first cell at the target whose neighbours in all dimensions lie below the median and on average below the 33 % quantile; else the best cell."""
    median, third = quantile_fn(results, 0.50), quantile_fn(results, 0.33)
    dims = ["rsi", "mdi", "rxi", "spi", "nsi"]
    steps = results.select("idx", *dims).withColumn("_step", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d in range(5) for s in (-1, 1)])))
    for d, name in enumerate(dims):
        steps = steps.withColumn(name, F.col(name) + F.when(F.col("_step.d") == d, F.col("_step.s")).otherwise(0))
    inside = F.lit(True)
    for name, size in zip(dims, grid.shape(), strict=True):
        inside = inside & F.col(name).between(0, size - 1)
    other = results.select(*dims, F.when(F.col("fp") == target, F.col("fn")).alias("near"))
    near = steps.where(inside).join(F.broadcast(other), dims, "left").groupBy("idx").agg(F.min((F.coalesce("near", F.lit((1 << 31) - 1)) < median).cast("int")).alias("low"), F.avg("near").alias("mean"), F.count("near").alias("n"))
    judged = results.where(F.col("fp") == target).join(F.broadcast(near), "idx", "left")
    smooth = (F.coalesce("low", F.lit(0)) == 1) & (F.col("n") > 0) & (F.floor("mean") < third)
    return judged.withColumn("smooth", smooth).orderBy(F.desc("smooth"), "fn", "cutoff", "idx").limit(1).drop("low", "mean", "n")


def order_statistics(scores: DataFrame, ks: list[int], column: str = "spamicity", bins: int = 1024, passes: int = 4) -> list[float]:
    """The k-th highest of a column in [0, 1] for each k, without sorting or collecting rows.

    Each pass counts the rows by bins of the interval that still holds the wanted place and narrows it
    to one bin, so `passes` small aggregates reach 1 / bins ** passes; the value is the largest in the last bin.
    """
    out = []
    for k in ks:
        lo, width, above = 0.0, 1.0, 0
        for _ in range(passes):
            inside = scores.where((F.col(column) >= lo) & (F.col(column) <= lo + width))
            at = F.least(F.floor((F.col(column) - lo) / width * bins), F.lit(bins - 1)).cast("int")
            counts = dict(inside.groupBy(at.alias("b")).agg(F.count("*").alias("n")).collect())  # at most `bins` rows
            for b in sorted(counts, reverse=True):
                if above + counts[b] >= k:
                    break
                above += counts[b]
            lo, width = lo + width * b / bins, width / bins
        out.append(scores.where((F.col(column) >= lo) & (F.col(column) <= lo + width)).agg(F.max(column)).first()[0])
    return out


def recommended_cutoffs(scored: DataFrame) -> DataFrame:
    """per, cutoff, fp, fn: cutoffs at one false positive per 10000, 2000, 1000 and 500 good messages, where there are that many."""
    scored = checkpoint(scored.select("spamicity", "is_spam"))
    good = scored.where(~F.col("is_spam"))
    n_good = good.count()
    ks = {per: -(-n_good // per) for per in (10_000, 2_000, 1_000, 500) if n_good >= per}
    if not ks:
        return scored.sparkSession.createDataFrame([], "per int, cutoff double, fp bigint, fn bigint")
    cuts = dict(zip(ks, order_statistics(good, list(ks.values())), strict=True))
    cells = [F.struct(F.lit(per).alias("per"), F.lit(c).alias("cutoff"), F.lit(n_good // per).cast("bigint").alias("fp"), F.count_if(F.col("is_spam") & (F.col("spamicity") < c)).alias("fn")) for per, c in cuts.items()]
    return scored.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
