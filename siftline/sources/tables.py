"""Dumps, message-count files and versioned count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.common import checkpoint, running_before
from siftline.operators.wordlist import clamp, fold_nonascii


def dump_lines(table: DataFrame, replace_nonascii: bool = False) -> DataFrame:
    """Text lines 'token spam good [date]'; a date of 0 is left out."""
    token = fold_nonascii(F.col("token")) if replace_nonascii else F.col("token")
    date = F.when(F.coalesce("date", F.lit(0)) > 0, F.col("date").cast("string"))
    return table.select(F.concat_ws(" ", token, clamp(F.col("spam")).cast("string"), clamp(F.col("good")).cast("string"), date).alias("value"))


def parse_dump(lines: DataFrame, value: str = "value", order: str | None = None, today: int = 0) -> DataFrame:
    """token, spam, good, date, line_no of dump lines; lines shorter than four bytes are skipped, negative counts are 0, a missing date is today's.

    A token may itself hold blanks; the numbers are read from the end of the line.
    """
    m = lambda g: F.regexp_extract(F.col(value), r"^(.*?)[ \t]+(-?[0-9]+)(?:[ \t]+(-?[0-9]+))?(?:[ \t]+([0-9]{1,8}))?[ \t]*$", g)
    number = lambda g: clamp(m(g).try_cast("long"))
    date = m(4).try_cast("int")
    line_no = F.col(order) if order else F.monotonically_increasing_id()
    rows = lines.where(F.octet_length(value) >= 4).select(m(1).alias("token"), number(2).alias("spam"), number(3).alias("good"), F.when(F.coalesce(date, F.lit(0)) > 0, date).otherwise(F.lit(today)).alias("date"), line_no.alias("line_no"))
    return rows.where(F.col("token") != "")


def count_lines(counts: DataFrame) -> DataFrame:
    """Message-count file lines of (id, token, bad, good, msgs_bad, msgs_good): a '.MSG_COUNT' line heads each message.

    seq orders the lines of a message; write them partitioned and sorted by (id, seq).
    """
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('" '))
    body = counts.select("id", F.lit(1).alias("seq"), "token", F.concat(quoted(F.col("token")), F.col("bad").cast("string"), F.lit(" "), F.col("good").cast("string")).alias("value"))
    head = counts.groupBy("id").agg(F.concat(F.lit('".MSG_COUNT" '), F.max("msgs_bad").cast("string"), F.lit(" "), F.max("msgs_good").cast("string")).alias("value"))
    return body.unionByName(head.select("id", F.lit(0).alias("seq"), F.lit("").alias("token"), "value"))


def parse_count_lines(lines: DataFrame, by: str, order: Column, value: str = "value") -> DataFrame:
    """msg_no, token, bad, good, msgs_bad, msgs_good from lines in order within each file `by`."""
    m = lambda g: F.regexp_extract(F.col(value), r'^"(.*)" ([0-9]+) ([0-9]+)$', g)
    rows = lines.select(F.col(by).alias("file"), order.alias("at"), m(1).alias("token"), m(2).try_cast("long").alias("bad"), m(3).try_cast("long").alias("good")).where("bad is not null")
    is_head = F.col("token") == ".MSG_COUNT"
    rows = running_before(rows, "file", ["at", "token"], {"heads": is_head.cast("int")}).withColumn("msg_no", F.col("heads") + is_head.cast("int"))
    rows = checkpoint(rows)
    heads = rows.where(is_head).select("file", "msg_no", F.col("bad").alias("msgs_bad"), F.col("good").alias("msgs_good"))
    return rows.where(~is_head).join(heads, ["file", "msg_no"], "left").select("file", "msg_no", "token", "bad", "good", "msgs_bad", "msgs_good")


def starting_with(lines: DataFrame, by: str, order: str, prefix: str, value: str = "value") -> DataFrame:
    """offset, value of the lines that begin with a prefix; the offset in bytes from the start of the file."""
    at = running_before(lines.select(by, order, value), by, [order], {"offset": F.octet_length(value) + 1})
    return at.where(F.col(value).startswith(prefix)).select("offset", value)


class CountStore:
    """Count tables below one folder: a base and the changes since, merged on reading and now and then into a new base.

    A change costs what it holds, not the table. Readers see only finished writes; a table that was replaced stays until
    purge().
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 16):
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _finished(self) -> list[tuple[int, str]]:
        """(version, name) of all finished writes in order: v<n> are whole tables, c<n> changes."""
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted((int(n[1:]), n) for n in done if n[0] in "vc")

    def _live(self) -> list[str]:
        done = self._finished()
        base = max((v for v, n in done if n[0] == "v"), default=0)
        return [n for v, n in done if v > base or n == f"v{base}"]

    def read(self) -> DataFrame:
        live = self._live()
        schema = "token string, spam long, good long, date int"
        if not live:
            return self.spark.createDataFrame([], schema)
        if len(live) == 1 and live[0][0] == "v":
            return self.spark.read.schema(schema).parquet(f"{self.path}/{live[0]}")
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{n}").withColumn("_at", F.lit(k)) for k, n in enumerate(live)]
        rows = parts[0]
        for x in parts[1:]:
            rows = rows.unionByName(x)
        # counts stop at zero after every change, so the sums since the lowest point count: at most compact_every rows a token
        steps = F.array_sort(F.collect_list(F.struct("_at", "spam", "good")))
        total = lambda n: F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: F.greatest(a + x[n], F.lit(0).cast("long")))
        merged = rows.groupBy("token").agg(total("spam").alias("spam"), total("good").alias("good"), F.max("date").alias("date"))
        return merged.where("spam > 0 or good > 0")

    def _write(self, table: DataFrame, kind: str) -> None:
        version = max((v for v, _ in self._finished()), default=0) + 1
        table.select("token", "spam", "good", "date").write.mode("overwrite").parquet(f"{self.path}/{kind}{version}")

    def replace(self, table: DataFrame) -> DataFrame:
        self._write(table, "v")
        return self.read()

    def change(self, delta: DataFrame, date: int, sign: int = 1) -> DataFrame:
        """Add or take away counts(token, spam, good); touched tokens get the date; counts stop at zero."""
        one = delta.groupBy("token").agg((F.sum("spam") * sign).alias("spam"), (F.sum("good") * sign).alias("good"))
        self._write(one.withColumn("date", F.lit(date)), "c")
        if len(self._live()) > self.compact_every:
            return self.replace(self.read())
        return self.read()

    def purge(self) -> None:
        """Delete what the newest whole table has replaced; for when nobody reads it any more."""
        fs, _ = self._fs()
        live = set(self._live())
        for _, n in self._finished():
            if n not in live:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"), True)
