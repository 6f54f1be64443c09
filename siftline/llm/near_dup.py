"""Near-duplicate texts: LSH forest with longest-common-prefix neighbours (problem 6).

A text is its set of distinct words; texts with equal sets are one class with the smallest id as
representative, and only representatives go on. Each of TREES trees orders them by a signature of
minhash values; texts that share a prefix of DEPTH values in some tree are neighbours there, the region
of that prefix. Every region is compared completely, however many texts it holds, those of more than
BLOCK in blocks spread over tasks: no region is capped or divided further, as that would lose pairs of
large families that small ones keep.

Neighbours are first compared by SKETCH one-bit minhashes carried along (a bound many standard
errors below the threshold), then exactly on their word sets.

A pair of similarity s is neighbours in a tree with probability s**DEPTH, and found unless it misses in
all trees. With 40 trees of depth 4 the chance to miss is 4e-3 for s = 0.6, 2e-5 for s = 0.7 and below
1e-8 for s = 0.8, whatever the size of its region.

Plan shape: signatures are computed once and kept at a checkpoint. Regions over a block are counted by
partial aggregates of one number a row; they are few, so they are broadcast once their number is known to be small,
and each row then knows its blocks without a shuffle. One shuffle brings the rows of a block
together. The work grows with the square of a crowded region, as do the pairs of a family.

Defined cases: text null, empty or with fewer than min_words distinct words: in no class, no pair. Id null:
ignored. Repeated ids: the row with the most words counts. Ties: equal sets are one class, smallest id first. Very long texts are taken
whole. Extra columns are ignored. An empty table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.common import BROADCAST_BYTES, checkpoint
from siftline.llm.util import arrow_map, pairs_within, spread

TREES, DEPTH = 40, 4
BLOCK = 1024
SKETCH = 256
WORD = r"[\p{L}\p{N}]{3,}"


@dataclass
class NearDuplicates:
    """members(id, rep): the class of every text of enough words; pairs(a, b, similarity) between representatives, a < b."""

    members: DataFrame
    pairs: DataFrame


def word_hashes(text: Column, word: str = WORD) -> Column:
    """Distinct words of the lower-cased text as 64-bit hashes."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0)))
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(text: Column, length: int = 5, word: str = r"[\p{L}\p{N}]+") -> Column:
    """Distinct runs of `length` words as 64-bit hashes; a shorter text is one run."""
    words = F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - length + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, length))))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def signatures(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(regions: texts x trees, sketch: texts x SKETCH/64) of word hashes laid end to end; every text has a word."""
    n = len(starts)
    a, b = _functions(max(SKETCH, TREES * DEPTH))
    mins = np.empty((len(a), n), np.uint32)
    for f in range(len(a)):
        mins[f] = np.minimum.reduceat(((flat * a[f] + b[f]) >> np.uint64(32)).astype(np.uint32), starts)
    bits = np.packbits((mins[:SKETCH] & 1).astype(np.uint8).T, axis=1).copy().view(np.int64)
    values = mins[: TREES * DEPTH].reshape(TREES, DEPTH, n).astype(np.uint64)
    key = np.repeat(np.arange(1, TREES + 1, dtype=np.uint64)[:, None], n, axis=1)
    for d in range(DEPTH):
        key = _mix(key * np.uint64(0x100000001B3) + values[:, d])
    return np.ascontiguousarray(key.T).view(np.int64), bits


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = batch.column(1)
    flat = words.flatten().to_numpy().view(np.uint64)
    starts = words.offsets.to_numpy()[:-1].astype(np.int64) - words.offsets[0].as_py()
    regions, bits = signatures(flat, starts) if batch.num_rows else (np.empty((0, TREES), np.int64), np.empty((0, SKETCH // 64), np.int64))
    n, trees = regions.shape
    trees_of = pa.ListArray.from_arrays(np.arange(0, n + 1, dtype=np.int32) * trees, regions.reshape(-1))
    cols = [batch.column(0), trees_of] + [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(SKETCH // 64)]
    return pa.RecordBatch.from_arrays(cols, ["id", "trees", *_BITS])


_BITS = [f"s{k}" for k in range(SKETCH // 64)]
_SIGNED = "id long, trees array<long>, " + ", ".join(f"{b} long" for b in _BITS)


def _marked(rows: DataFrame, keys: DataFrame, key: Column, name: str, value: str) -> DataFrame:
    """rows with the value of their key in keys(key, value), null where it has none; broadcast if few keys, else joined by shuffle."""
    keys = checkpoint(keys)
    few = keys.count() * 24 <= BROADCAST_BYTES
    keys = keys.select(F.col("key").alias("_key"), F.col(value).alias(name))
    return rows.join(F.broadcast(keys) if few else keys, key == F.col("_key"), "left").drop("_key")


def neighbours(sets: DataFrame, threshold: float, region: int = BLOCK) -> DataFrame:
    """Distinct candidate pairs (a, b), a < b, of sets(id, words); regions of more than `region` texts are compared in blocks of about so many."""
    signed = checkpoint(arrow_map(sets.select("id", "words"), _sign, _SIGNED))
    rows = signed.select("id", *_BITS, F.explode("trees").alias("region"))
    # places: a region is one, unless it is larger than a block; then it is every pair of its blocks
    huge = rows.groupBy(F.col("region").alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > region)
    rows = _marked(rows, huge.withColumn("parts", F.ceil(F.col("n") / region).cast("int")), F.col("region"), "parts", "parts")
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("region", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", *_BITS)
    left = rows.select("region", "i", "j", F.col("part").alias("pa"), F.col("id").alias("a"), *[F.col(x).alias(f"a{x}") for x in _BITS])
    right = rows.select("region", "i", "j", F.col("part").alias("pb"), F.col("id").alias("b"), *[F.col(x).alias(f"b{x}") for x in _BITS])
    differing = sum((F.bit_count(F.col(f"a{x}").bitwiseXOR(F.col(f"b{x}"))) for x in _BITS), F.lit(0))
    # a bit differs with probability (1 - s) / 2; five standard errors of room
    p = (1 - threshold) / 2
    most = SKETCH * p + 5 * (SKETCH * p * (1 - p)) ** 0.5
    placed = (F.col("pa") != F.col("pb")) | (F.col("i") == F.col("j"))
    return left.join(right, ["region", "i", "j"]).where((F.col("a") < F.col("b")) & placed & (differing <= F.lit(int(most)))).select("a", "b").distinct()


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_words: int = 1, features=shingle_hashes, region: int = BLOCK) -> NearDuplicates:
    """Classes of equal sets and all pairs of representatives whose sets have a Jaccard similarity of at least threshold."""
    rows = spread(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    rows = rows.select("id", F.coalesce(features(F.col("text")), F.array().cast("array<long>")).alias("words")).where(F.size("words") >= max(1, min_words))
    rows = rows.withColumn("words", F.array_sort("words"))
    sets = checkpoint(rows.groupBy("id").agg(F.max(F.struct(F.size("words").alias("n"), "words")).getField("words").alias("words")))
    print_of = F.struct(F.xxhash64("words").alias("h1"), F.hash("words").alias("h2"), F.size("words").alias("n"))
    prints = sets.select("id", print_of.alias("p"))
    reps = prints.groupBy("p").agg(F.min("id").alias("rep"))
    members = prints.join(reps, "p").select("id", "rep")
    chosen = sets.join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    near = checkpoint(neighbours(chosen, threshold, region))  # two ids a candidate
    wa, wb = chosen.select(F.col("id").alias("a"), F.col("words").alias("wa")), chosen.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    found = near.join(wa, "a").join(wb, "b").select("a", "b", F.size("wa").alias("na"), F.size("wb").alias("nb"), shared.alias("n"))
    similar = found.withColumn("similarity", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).where(F.col("similarity") >= threshold)
    return NearDuplicates(members, similar.select("a", "b", "similarity"))


def expanded(found: NearDuplicates) -> DataFrame:
    """(a, b), a < b, for all texts: between the members of similar classes and within classes."""
    m = found.members
    left, right = m.select(F.col("rep").alias("a"), F.col("id").alias("x")), m.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    between = found.pairs.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    several = m.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    return between.unionByName(pairs_within(m.join(several, "rep", "left_semi"), "rep", "id"))


def groups(found: NearDuplicates) -> DataFrame:
    """id, group_id, n_links: connected components over the classes (group_id: its smallest id), and the similar classes of each text's class.

    Large-star / small-star rounds: every round points each node and its larger or smaller neighbours at
    the least neighbour, which halves the depth of the trees; each round ends at a checkpoint.
    """
    edges = checkpoint(found.pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    links = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(F.col("u").alias("rep")).agg(F.count("*").alias("n_links"))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        at = both.join(least, "u")
        moved = at.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else at.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = mark(edges)
    while now[0]:
        after = checkpoint(star(star(edges, True), False))
        before, now = now, mark(after)
        edges = after
        if before == now:  # number of edges and sum of their hashes
            break
    top = edges.select(F.col("u").alias("rep"), F.col("v").alias("group_id"))
    return found.members.join(top, "rep", "left").join(links, "rep", "left").select("id", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
