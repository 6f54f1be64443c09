"""Count tables token -> (spam, good, date): register, merge, look up, maintain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline.common import broadcast_if_small
from siftline.functions.decode import recoder


def clamp(c: Column) -> Column:
    """Counts are never null or negative."""
    return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long")


def is_meta(token: Column) -> Column:
    """Rows about the table itself begin with a dot."""
    return token.startswith(".")


def register(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """token, spam, good of distinct (id, token) rows by class; labels(id, is_spam) of the registered messages."""
    n = lambda spam: F.sum(F.when(F.col("is_spam") == spam, 1).otherwise(0)).cast("long")
    return tokens.join(broadcast_if_small(labels), "id").groupBy("token").agg(n(True).alias("spam"), n(False).alias("good"))


def message_totals(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (msgs_spam, msgs_good): registered messages that hold a token at all."""
    held = labels.join(tokens.select("id").distinct(), "id", "left_semi")
    n = lambda spam: F.coalesce(F.sum(F.when(F.col("is_spam") == spam, 1).otherwise(0)), F.lit(0)).cast("long")
    return held.agg(n(True).alias("msgs_spam"), n(False).alias("msgs_good"))


def apply_counts(table: DataFrame, change: DataFrame, sign_spam: int = 1, sign_good: int = 1) -> DataFrame:
    """Add (or with -1 take away) counts; nothing falls below zero, tokens left without counts go."""
    signed = change.select("token", (F.col("spam") * sign_spam).alias("spam"), (F.col("good") * sign_good).alias("good"))
    return (
        table.select("token", "spam", "good")
        .unionByName(signed)
        .groupBy("token")
        .agg(clamp(F.sum("spam")).alias("spam"), clamp(F.sum("good")).alias("good"))
        .where("spam > 0 or good > 0")
    )


def move(table: DataFrame, change: DataFrame, to_spam: bool = True) -> DataFrame:
    """Messages registered in one class move to the other: their counts leave it and enter this one."""
    n = F.col("spam") + F.col("good")
    swapped = change.select("token", (n if to_spam else -n).alias("spam"), (-n if to_spam else n).alias("good"))
    return apply_counts(table, swapped)


def is_count(token: Column) -> Column:
    """Rows of a dump that hold counts: all but the meta rows other than the message totals and the encoding."""
    return ~is_meta(token) | token.isin(".MSG_COUNT", ".ENCODING")


def load(entries: DataFrame, token: str, spam: str, good: str, date: str, order: str, max_token_len: int = 255, today: int = 0) -> DataFrame:
    """token, spam, good, date of dump rows that are counts: those of a recurring token add up, the last row's date stays (today's where it has none); overlong and empty tokens go, negative counts are 0."""
    day = F.coalesce(F.nullif(F.col(date), F.lit(0)), F.lit(today))
    return (
        entries.where(F.col(token).isNotNull() & F.octet_length(F.col(token)).between(1, max_token_len) & is_count(F.col(token)))
        .groupBy(F.col(token).alias("token"))
        .agg(F.sum(clamp(F.col(spam))).alias("spam"), F.sum(clamp(F.col(good))).alias("good"), F.max_by(day, F.col(order)).alias("date"))
    )


def full_merge(spamlist: DataFrame, goodlist: DataFrame) -> DataFrame:
    """One table of a spam list(token, n) and a good list(token, n)."""
    return spamlist.select("token", F.col("n").alias("spam")).join(goodlist.select("token", F.col("n").alias("good")), "token", "full_outer").select("token", clamp(F.col("spam")).alias("spam"), clamp(F.col("good")).alias("good"))


def lookup(probes: DataFrame, table: DataFrame) -> DataFrame:
    """Counts of probe tokens; only those found."""
    return table.join(broadcast_if_small(probes.select("token").distinct()), "token")


def expire(table: DataFrame, count: int | None = None, age: int | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Drop tokens that every given limit gives up: both counts at most `count`, date at most `age` (YYYYMMDD), bytes outside `size`; meta rows stay."""
    given = []
    if count is not None:
        given.append((F.col("spam") <= count) & (F.col("good") <= count))
    if age is not None:
        given.append(F.col("date") <= age)
    if size is not None:
        given.append(~F.octet_length("token").between(*size))
    if not given:
        return table
    drop = given[0]
    for g in given[1:]:
        drop = drop & g
    return table.where(is_meta(F.col("token")) | ~drop)


def rekey(table: DataFrame, new: Column) -> DataFrame:
    """Rewrite keys; rows that meet add up, the later date stays."""
    return table.groupBy(new.alias("token")).agg(F.sum("spam").alias("spam"), F.sum("good").alias("good"), F.max("date").alias("date"))


def fold_nonascii(token: Column) -> Column:
    """One '?' per byte beyond ASCII."""
    pieces = F.regexp_extract_all(token, F.lit(r"[^\x00-\x7f]|[\x00-\x7f]+"), F.lit(0))
    return F.when(token.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(pieces, lambda c: F.when(c.rlike(r"^[\x00-\x7f]"), c).otherwise(F.repeat(F.lit("?"), F.octet_length(c)))), "")).otherwise(token)


def recoded(token: Column, charset: str = "UTF-8") -> Column:
    """A token whose characters are the bytes of another charset, as text; what cannot be such bytes stays."""
    raw = F.when(token.rlike(r"[\x80-\xff]") & ~token.rlike(r"[^\x00-\xff]"), F.encode(token, "ISO-8859-1"))
    if charset.upper() in ("UTF-8", "UTF8"):
        return F.coalesce(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")), token)
    return F.when(raw.isNull(), token).otherwise(recoder(charset)(token))


def convert_encoding(table: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """A table of raw tokens with its keys as text; keys that meet add up, the later date stays, and the table says so (.ENCODING 2)."""
    done = rekey(table.where("token <> '.ENCODING'"), recoded(F.col("token"), charset))
    mark = table.agg(F.max("date").alias("date")).select(F.lit(".ENCODING").alias("token"), F.lit(2).cast("long").alias("spam"), F.lit(0).cast("long").alias("good"), F.coalesce("date", F.lit(0)).cast("int").alias("date"))
    return done.unionByName(mark)


def distinct_lists(registry: DataFrame) -> DataFrame:
    """Lists of the same type, priority, name and file are met once."""
    return registry.dropDuplicates([c for c in ("list_type", "priority", "list_name", "file_name") if c in registry.columns])


def upgrade_prefix(table: DataFrame, octets_only: bool = False) -> DataFrame:
    """Addresses tagged url: in old tables are tagged ip: (replaced, not merged); other rows stay."""
    is_url = F.col("token").startswith("url:")
    if octets_only:
        is_url = is_url & F.col("token").rlike(r"^url:[0-9]{1,3}(\.[0-9]{1,3}){0,3}$")
    return table.withColumn("token", F.when(is_url, F.concat(F.lit("ip:"), F.substring("token", 5, 1 << 20))).otherwise(F.col("token")))


def combined_lists(tokens: DataFrame, wordlist: DataFrame, registry: DataFrame, totals: DataFrame) -> DataFrame:
    """id, token, good, bad, msgs_good, msgs_bad, ignored of tokens looked up in several lists.

    Lists are met by ascending priority (ties by name). Counts and message totals of regular lists add
    up until an ignore list holds the token: then its counts are zero, its totals those met so far,
    and it is marked. totals: list_name, msgs_spam, msgs_good. The registry is a handful of rows.
    """
    lists = distinct_lists(registry).join(broadcast_if_small(totals), "list_name", "left").select(
        "list_name", (F.col("list_type") == "i").alias("ignore"), F.struct("priority", "list_name").alias("rank"), clamp(F.col("msgs_spam")).alias("ms"), clamp(F.col("msgs_good")).alias("mg")
    )
    lists = lists.where("ignore is not null")
    entries = wordlist.join(broadcast_if_small(lists), "list_name").groupBy("token", "rank", "ignore").agg(F.sum(clamp(F.col("spam"))).alias("spam"), F.sum(clamp(F.col("good"))).alias("good"))
    stop = F.min(F.when(F.col("ignore"), F.col("rank")))
    hits = entries.groupBy("token").agg(
        stop.alias("stop"),
        F.collect_list(F.struct("rank", "ignore", "spam", "good")).alias("hits"),  # at most one per list
    )
    before = lambda x: F.col("stop").isNull() | (x["rank"] < F.col("stop"))

    def added(items: str, field: str) -> Column:
        counts = F.transform(F.filter(items, lambda x: before(x)), lambda x: x[field])
        return F.aggregate(F.coalesce(counts, F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, v: a + v)

    regular = lambda items: F.filter(items, lambda x: ~x["ignore"])
    known = [F.struct(F.struct(F.lit(r["rank"]["priority"]).cast("int").alias("priority"), F.lit(r["rank"]["list_name"]).alias("list_name")).alias("rank"), F.lit(r["ms"]).alias("ms"), F.lit(r["mg"]).alias("mg")) for r in lists.collect()]
    every = F.array(*known) if known else F.array().cast("array<struct<rank: struct<priority: int, list_name: string>, ms: bigint, mg: bigint>>")
    found = tokens.join(broadcast_if_small(hits), "token", "left").withColumns({"hits": regular("hits"), "lists": every})
    ignored = F.col("stop").isNotNull()
    return found.select(
        "id",
        "token",
        F.when(ignored, F.lit(0)).otherwise(added("hits", "good")).cast("bigint").alias("good"),
        F.when(ignored, F.lit(0)).otherwise(added("hits", "spam")).cast("bigint").alias("bad"),
        added("lists", "mg").alias("msgs_good"),
        added("lists", "ms").alias("msgs_bad"),
        ignored.alias("ignored"),
    )
