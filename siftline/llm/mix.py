"""Mixing sources to target weights (problem 9).

Temperature mixing: with natural token shares p the weights are w(a) ~ p**a, so a = 1 keeps the natural
mixture and a = 0 makes all sources equal; a is bisected to a target entropy or to the repetition limit. Where target shares t
are given, the same exponent leads from them to the natural shares: w(a) ~ t * (p / t)**a, and a is
the least exponent at which no source must be repeated more often than it may for the wanted total.
Without a wanted total, it is the largest one that a = 0 allows, so the targets are met exactly.

The weights are realised as budgeted block permutations: a source's records are permuted by a seeded
hash, cut into blocks of the permutation, and taken as whole passes over the source plus a prefix of
one more pass that ends where the token budget does. The block in which it ends is swept in order for
records that still fit, again and again while one does and may be used once more; if taking the largest
first comes closer to the budget, it is filled that way. So a source ends within its smallest record that
may be used again of its budget.

Plan shape: one pass sizes the texts (no text goes on), block sums by partial aggregate, running sums over
blocks in two levels (no task holds a source's blocks), and one task per source over its single boundary
block (bounded by the block size).

Defined cases: text null or empty: 0 tokens, used as often as its source's whole passes plus its place in the prefix says. Source
null or not among the targets: weight 0. A target without documents or with a share null or <= 0:
gets nothing; the other shares are scaled up to 1 and the report keeps the source with 0. max_repeats null
or < 1 counts as 1. A source named more than once: shares add up, the least max_repeats holds. Repeated rows are separate records.
Ties in the permutation go by id. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.common import checkpoint
from siftline.llm.tokens import RANKS, encode
from siftline.llm.util import arrow_map, running_before, spread

BLOCK_RECORDS = 4096


@dataclass(frozen=True)
class Source:
    name: str
    tokens: int
    records: int
    target: float
    repeats: int


def bisect(holds: Callable[[float], bool], lo: float, hi: float, steps: int = 80) -> float:
    """The least value in [lo, hi] at which a condition holds that stays true from there on; hi if none."""
    if holds(lo):
        return lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if holds(mid) else (mid, hi)
    return hi


def _normal(logs: list[float]) -> list[float]:
    top = max(logs)
    x = [math.exp(v - top) for v in logs]
    return [v / sum(x) for v in x]


def powered(shares: list[float], exponent: float) -> list[float]:
    return _normal([exponent * math.log(s) for s in shares])


def tilted(targets: list[float], shares: list[float], exponent: float) -> list[float]:
    return _normal([math.log(t) + exponent * (math.log(p) - math.log(t)) for t, p in zip(targets, shares, strict=True)])


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def exponent_for_entropy(shares: list[float], target: float) -> float:
    """The exponent in [0, 1] whose weights have the target entropy (between the natural one and that of equal shares)."""
    return bisect(lambda a: entropy(powered(shares, a)) <= target, 0.0, 1.0)


def exponent_for_repeats(weights: Callable[[float], list[float]], sources: list[Source], total: float) -> float:
    """The least exponent in [0, 1] at which no source is needed more often than it may be repeated."""
    return bisect(lambda a: all(total * w <= s.repeats * s.tokens * (1 + 1e-12) for w, s in zip(weights(a), sources, strict=True)), 0.0, 1.0)


@dataclass(frozen=True)
class Plan:
    exponent: float
    total: float
    budgets: dict[str, float]


def plan(sources: list[Source], total: float | None = None, target_entropy: float | None = None, stretch: float = 1.0) -> Plan:
    """Token budgets per source; without a total, `stretch` times the largest one that the targets allow. With target_entropy the targets are ignored and natural shares are tempered."""
    usable = [s for s in sources if s.tokens > 0 and (s.target > 0 or target_entropy is not None)]
    if not usable:
        return Plan(0.0, 0.0, {})
    n = sum(s.tokens for s in usable)
    shares = [s.tokens / n for s in usable]
    if target_entropy is not None:
        total = total or n
        a = max(exponent_for_entropy(shares, target_entropy), exponent_for_repeats(lambda x: powered(shares, x), usable, total))
        w = powered(shares, a)
    else:
        t = sum(s.target for s in usable)
        targets = [s.target / t for s in usable]
        most = min(s.repeats * s.tokens / x for s, x in zip(usable, targets, strict=True))
        total = total or most * stretch
        a = exponent_for_repeats(lambda x: tilted(targets, shares, x), usable, total)
        w = tilted(targets, shares, a)
    return Plan(a, total, {s.name: min(total * x + 1e-6, s.repeats * s.tokens) for s, x in zip(usable, w, strict=True)})


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, ranks: str) -> DataFrame:
    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array([len(encode(t, ranks)) for t in batch.column(2).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["id", "source", "n_tokens"])

    rows = df.where(F.col(source_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return arrow_map(spread(rows), measure, "id long, source string, n_tokens long")


_USED = ["source", "id", "n_tokens", "passes", "extra"]
_EDGE = "source string, id long, n_tokens long, passes int, extra int"


def fill(sizes: list[int], room: float, spare: int) -> list[int]:
    """How often each of the records, in order, is used so that their tokens come close to room, none more than `spare` times."""

    def swept(order: list[int]) -> tuple[float, list[int]]:
        uses, left = [0] * len(sizes), room
        for again in range(spare):
            before = left
            for k in order:
                if sizes[k] <= left and (sizes[k] or not again):
                    uses[k] += 1
                    left -= sizes[k]
            if left == before:
                break
        return left, uses

    ways = [swept(list(range(len(sizes))))]
    if ways[0][0] >= 1 or max(ways[0][1], default=0) > 1:
        ways.append(swept(sorted(range(len(sizes)), key=lambda k: -sizes[k])))
    # what stays free in steps of half a percent of the room, then how often a record is repeated, then the permuted order
    return min(ways, key=lambda w: (round(w[0] / room * 200) if room else 0, max(w[1], default=0)))[1]


def _fill_edge(block: pd.DataFrame) -> pd.DataFrame:
    """The block in which a source's budget ends (about BLOCK_RECORDS rows)."""
    block = block.sort_values(["place", "id"])
    extra = fill(block["n_tokens"].tolist(), float(block["room"].iloc[0]), int(block["spare"].iloc[0]))
    return block.assign(extra=np.array(extra, np.int32))[_USED]


@dataclass
class Mixture:
    """used(source, id, n_tokens, n_uses) of every record that is used; report(source, target_share, reached_share, deviation, n_records, tokens, most_uses), deviation from the plan's share; the plan."""

    used: DataFrame
    report: DataFrame
    plan: Plan


def mix(df: DataFrame, targets: DataFrame, total: float | None = None, target_entropy: float | None = None, stretch: float = 1.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ranks: str = RANKS, block_records: int = BLOCK_RECORDS) -> Mixture:
    """Draw the mixture. targets: source, target_share, max_repeats (one row per source, a table of settings)."""
    spark = df.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.greatest("target_share", F.lit(0.0))).alias("t"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("m")).collect():
        wanted[r["source"]] = (r["t"] if r["t"] and math.isfinite(r["t"]) else 0.0, r["m"])
    items = checkpoint(sized(df.where(F.col(source_col).isin(list(wanted))), id_col, text_col, source_col, ranks))
    held = {r["source"]: (r["t"], r["n"]) for r in items.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}  # one row per named source
    sources = [Source(name, *held.get(name, (0, 0)), t, m) for name, (t, m) in sorted(wanted.items())]
    p = plan(sources, total, target_entropy, stretch)
    rows = [(s.name, s.tokens, int(p.budgets[s.name] // s.tokens), float(p.budgets[s.name] % s.tokens), max(1, -(-s.records // block_records)), s.repeats) for s in sources if s.name in p.budgets]
    settings = spark.createDataFrame(rows, "source string, held long, passes int, budget double, blocks long, repeats int")

    place = F.xxhash64(F.lit(seed), "id", "n_tokens")
    permuted = items.join(F.broadcast(settings), "source").withColumn("place", place).withColumn("block", F.pmod(F.shiftrightunsigned("place", 1), F.col("blocks")))
    blocks = permuted.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    blocks = running_before(blocks, "source", "block", "size", "before").join(F.broadcast(settings.select("source", "budget")), "source")
    blocks = blocks.withColumn("whole", F.col("before") + F.col("size") <= F.col("budget")).where(F.col("whole") | (F.col("before") < F.col("budget"))).select("source", "block", "before", "whole")
    at = permuted.join(blocks, ["source", "block"], "left")
    full = at.where(F.coalesce("whole", F.lit(True))).withColumn("extra", F.when(F.col("whole"), 1).otherwise(0)).select(*_USED)
    edge = at.where(~F.col("whole")).select("source", "id", "n_tokens", "passes", "place", (F.col("budget") - F.col("before")).alias("room"), (F.col("repeats") - F.col("passes")).alias("spare")).groupBy("source").applyInPandas(_fill_edge, _EDGE)
    used = full.unionByName(edge).withColumn("n_uses", F.col("passes") + F.col("extra")).where("n_uses > 0").select("source", "id", "n_tokens", "n_uses")

    planned = {name: x / p.total for name, x in p.budgets.items()} if p.total else {}
    whole = spark.createDataFrame([(s.name, s.target, planned.get(s.name, 0.0)) for s in sources], "source string, target_share double, planned double")
    sums = used.groupBy("source").agg(F.count("*").alias("n_records"), F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens"), F.max("n_uses").alias("most_uses"))
    report = whole.join(sums, "source", "left").na.fill(0, ["n_records", "tokens", "most_uses"])
    everything = report.agg(F.sum("tokens").alias("everything"))  # one row
    report = report.crossJoin(F.broadcast(everything)).withColumn("reached_share", F.when(F.col("everything") > 0, F.col("tokens") / F.col("everything")).otherwise(0.0))
    return Mixture(used, report.select("source", "target_share", "reached_share", (F.col("reached_share") - F.col("planned")).alias("deviation"), "n_records", "tokens", "most_uses"), p)
