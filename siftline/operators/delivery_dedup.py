"""Messages delivered more than once: keep exactly one copy of each identifier.

An identifier names a host and, in most spellings, a running number; the producer is the host with the
number's base, without whatever random or constant parts stand beside the number. What was seen of a
producer is a set of disjoint number ranges. A number outside all ranges can't have been seen, so its
identifier is accepted at once and the ranges grow and merge. Only where a number is covered, and for
identifiers without a number, the whole identifier is looked up exactly among those accepted: a number
may stand in identifiers that differ elsewhere.

Batches are folded in order, each against the state that the ones before left (fold); the rows do not
depend on where the batches are cut.

Plan shape: copies are reduced to one candidate per identifier by a partial aggregate before any
sort, so a mail that makes up a third of the table costs one row per map task. Ranges live in
(producer, block of 2**BLOCK_BITS numbers): a window partition holds at most that many distinct
numbers, however busy the producer is. The exact lookup is a join of the few covered candidates.

Defined cases: identifier null, empty or only brackets/blanks: shared by nobody, always kept, never
in the state. Rows with the same delivery id and identifier are one delivery. A null delivery id
sorts before every other. Ties do not exist beyond that: the smallest delivery id is the copy kept.
Numbers of more than 18 decimal or 15 hexadecimal digits count as no number. Extra columns of the
input are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.common import checkpoint, let

BLOCK_BITS = 16
RANGE_SCHEMA = "producer string, block long, lo long, hi long"
EXACT_SCHEMA = "ident string"


@dataclass
class Seen:
    """What earlier batches accepted: number ranges per producer, and the identifiers themselves."""

    ranges: DataFrame
    exact: DataFrame


@dataclass
class Outcome:
    """accepted(delivery_id, ident), duplicates(delivery_id, ident), and the state after the batch."""

    accepted: DataFrame
    duplicates: DataFrame
    seen: Seen


def empty_seen(spark) -> Seen:
    return Seen(spark.createDataFrame([], RANGE_SCHEMA), spark.createDataFrame([], EXACT_SCHEMA))


def identifier(raw: Column) -> Column:
    """The bare identifier: no angle brackets, blanks, folds or trailing remarks; host in lower case; null if nothing is left."""
    first = F.regexp_replace(raw, r"(?s)^[\s ]*([^<\s ]+)[\s ][^<]*$", "$1")  # without brackets, up to the first blank
    inside = F.regexp_replace(first, r"(?s)^[^<]*<([^>]*).*$", "$1")
    core = F.regexp_replace(F.regexp_replace(inside, r"[\s <>]+", ""), r"(@[^(]*)\(.*$", "$1")
    return let(core, lambda s: F.when(s != "", F.concat(F.regexp_replace(s, "@[^@]*$", ""), F.lower(F.regexp_extract(s, "(@[^@]*)$", 1)))))


def split_sequence(ident: Column) -> Column:
    """struct(producer, seq) of an identifier; null where it holds no running number.

    The number is the longest field of the local part (the last of equally long ones) that is written in
    decimal digits, or in hexadecimal ones of one letter case with a digit among them.
    """
    local = F.regexp_replace(ident, "@[^@]*$", "")
    host = F.regexp_extract(ident, "(@[^@]*)$", 1)
    fields = F.transform(F.split(local, r"[.\-=_+]"), lambda x, k: F.struct(F.length(x).alias("size"), k.alias("at"), x.alias("digits")))
    kind = lambda x: F.when(x.rlike("^[0-9]{1,18}$"), "d").when(x.rlike("^(?=[a-f]*[0-9])[0-9a-f]{1,15}$"), "x").when(x.rlike("^(?=[A-F]*[0-9])[0-9A-F]{1,15}$"), "X")

    def named(n: Column) -> Column:
        digits = n["digits"]
        number = F.when(kind(digits) == "d", digits.try_cast("long")).otherwise(F.conv(digits, 16, 10).try_cast("long"))
        return F.when(n.isNotNull(), F.struct(F.concat(kind(digits), host).alias("producer"), number.alias("seq")))

    return let(F.array_max(F.filter(fields, lambda f: kind(f["digits"]).isNotNull())), named)


def parsed(deliveries: DataFrame, id_col: str, ident_col: str) -> DataFrame:
    """delivery_id, ident, producer, seq of every row."""
    both = let(identifier(F.col(ident_col)), lambda i: F.struct(i.alias("ident"), split_sequence(i).alias("number")))
    return deliveries.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("delivery_id"), both.alias("p")).select("delivery_id", "p.ident", "p.number.producer", "p.number.seq")


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Disjoint, maximal ranges per (producer, block) from overlapping or touching ones."""
    w = W.partitionBy("producer", "block").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    start = (reach.isNull() | (F.col("lo") > reach + 1)).cast("int")
    return (
        ranges.withColumn("_new", start)
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("producer", "block", "_run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .select("producer", "block", "lo", "hi")
    )


def coverage(numbers: DataFrame, ranges: DataFrame) -> DataFrame:
    """numbers(producer, block, seq, ident, delivery_id) with covered, whether a range holds seq: one sort, no join of pairs."""
    none = F.lit(None).cast("string")
    both = numbers.select("producer", "block", F.col("seq").alias("at"), F.lit(1).alias("is_number"), F.lit(None).cast("long").alias("hi"), "ident", "delivery_id").unionByName(
        ranges.select("producer", "block", F.col("lo").alias("at"), F.lit(0).alias("is_number"), "hi", none.alias("ident"), none.alias("delivery_id"))
    )
    w = W.partitionBy("producer", "block").orderBy("at", "is_number").rowsBetween(W.unboundedPreceding, 0)
    covered = F.coalesce(F.max("hi").over(w) >= F.col("at"), F.lit(False))
    return both.withColumn("covered", covered).where("is_number = 1").select("producer", "block", F.col("at").alias("seq"), "ident", "delivery_id", "covered")


def accept(deliveries: DataFrame, seen: Seen | None = None, id_col: str = "msg_id", ident_col: str = "message_id") -> Outcome:
    """One batch: which deliveries are first copies, which repeat something, and the new state."""
    return accept_parsed(parsed(deliveries, id_col, ident_col), seen)


def accept_parsed(rows: DataFrame, seen: Seen | None = None) -> Outcome:
    """accept() of rows as parsed() gives them."""
    seen = seen or empty_seen(rows.sparkSession)
    # one candidate per identifier, with map-side combine: hot identifiers collapse before the shuffle
    first = rows.where("ident is not null").groupBy("ident", "producer", "seq").agg(F.min("delivery_id").alias("delivery_id"))
    numbers = first.where("seq is not null").select("producer", F.shiftright("seq", BLOCK_BITS).alias("block"), "seq", "ident", "delivery_id")
    judged = coverage(numbers, seen.ranges)
    fresh = judged.where("not covered")
    looked_up = judged.where("covered").select("ident", "delivery_id").unionByName(first.where("seq is null").select("ident", "delivery_id"))
    unknown = looked_up.join(seen.exact.select("ident"), "ident", "left_anti")
    kept = fresh.select("ident", "delivery_id").unionByName(unknown)
    known = rows.where("ident is not null").select("delivery_id", "ident").distinct()
    at = known.join(kept.select("ident", F.col("delivery_id").alias("_first")), "ident", "left").withColumn("_kept", F.col("delivery_id").eqNullSafe(F.col("_first")))
    accepted = at.where("_kept").select("delivery_id", "ident").unionByName(rows.where("ident is null").select("delivery_id", "ident"))
    ranges = merge_ranges(seen.ranges.unionByName(fresh.select("producer", "block", F.col("seq").alias("lo"), F.col("seq").alias("hi"))))
    return Outcome(accepted, at.where("not _kept").select("delivery_id", "ident"), Seen(ranges, seen.exact.unionByName(kept.select("ident"))))


#: Ids from which the borders of batches are taken; they decide only how large each batch is.
BORDER_SAMPLE = 2000


def fold(deliveries: DataFrame, batches: int = 2, id_col: str = "msg_id", ident_col: str = "message_id") -> Outcome:
    """All deliveries in the order of their ids, cut into batches, each accepted against the state of those before it."""
    rows = checkpoint(parsed(deliveries, id_col, ident_col))
    hashed = rows.select("delivery_id", F.xxhash64("delivery_id").alias("h")).orderBy("h").limit(BORDER_SAMPLE)
    ids = sorted(r["delivery_id"] for r in hashed.collect())
    borders = sorted({ids[len(ids) * k // batches] for k in range(1, batches)}) if ids else []
    seen, accepted, duplicates = None, None, None
    for k in range(len(borders) + 1):
        part = rows.where((F.col("delivery_id") >= borders[k - 1]) if k else F.lit(True)).where((F.col("delivery_id") < borders[k]) if k < len(borders) else F.lit(True))
        o = accept_parsed(part, seen)
        last = k == len(borders)
        seen = o.seen if last else Seen(checkpoint(o.seen.ranges), checkpoint(o.seen.exact))
        accepted = o.accepted if accepted is None else accepted.unionByName(o.accepted)
        duplicates = o.duplicates if duplicates is None else duplicates.unionByName(o.duplicates)
    return Outcome(accepted, duplicates, seen)
