"""Mail stores as DataFrames (source, position, raw): files, mbox, Maildir, MH, rmail and dotted batches.

mbox and dotted batches are read with the text source's own line separator set to the message
separator, so one huge file is split among tasks at message borders. Only formats that need a
running state within the file (length-prefixed batches) are parsed file by file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.common import head_of, is_folder, running_before


def single_messages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Each file is one message."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.lit(0).cast("long").alias("position"), F.col("value").alias("raw"))


def mbox(spark: SparkSession, paths: str | list[str], crlf: bool = False) -> DataFrame:
    """A message begins with 'From ' at the start of a file or after an empty line; '>From ' stays as it is. crlf: the line ends of the files, which become plain ones."""
    rows = spark.read.text(paths, lineSep="\r\n\r\nFrom " if crlf else "\n\nFrom ").select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("position"), (F.regexp_replace("value", "\r\n", "\n") if crlf else F.col("value")).alias("v"))
    first = F.col("v").startswith("From ")
    raw = F.when(first, F.col("v")).otherwise(F.concat(F.lit("From "), F.col("v")))
    return rows.where(F.length(F.trim("v")) > 0).select("source", "position", F.concat(F.regexp_replace(raw, r"\n+\z", ""), F.lit("\n")).alias("raw"))


def _directory(spark: SparkSession, path: str, glob: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return rows.select(F.col("path").alias("source"), F.lit(0).cast("long").alias("position"), F.decode("content", "UTF-8").alias("raw"))


def maildir(spark: SparkSession, path: str) -> DataFrame:
    """new/ before cur/, hidden files left out; folder tells which."""
    both = [_directory(spark, f"{path}/{sub}", "[!.]*").withColumn("folder", F.lit(sub)) for sub in ("new", "cur")]
    return both[0].unionByName(both[1])


def mh(spark: SparkSession, path: str) -> DataFrame:
    """Files whose names begin with a digit."""
    return _directory(spark, path, "[0-9]*")


def dotted_batch(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """'MAIL FROM:' ... messages, each ended by a line with a single dot; doubled dots at line starts are one."""
    rows = spark.read.text(paths, lineSep="\n.\n").select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("position"), F.col("value").alias("v"))
    body = F.regexp_replace(F.regexp_replace("v", r"(?i)\A(?:(?:MAIL FROM|RCPT TO):[^\n]*\n)*(?:DATA\n)?", ""), r"(?m)^\.\.", ".")
    return rows.where(F.length(F.trim("v")) > 0).select("source", "position", body.alias("raw"))


_RMAIL = re.compile(rb"#! rmail (\d+)\r?\n")


def rmail_batch(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """'#! rmail <bytes>' and so many bytes of message, again and again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                while m := _RMAIL.search(data, at):
                    at = m.end() + int(m.group(1))
                    rows.append((path, m.start(), data[m.end() : at].decode("utf-8", "replace")))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["source", "position", "raw"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "source string, position long, raw string")


def store_format(first_line: Column) -> Column:
    """Which reader a store's first line asks for."""
    return F.when(first_line.startswith("From "), "mbox").when(first_line.startswith("#! rmail "), "rmail").when(F.upper(first_line).startswith("MAIL FROM:"), "dotted").when(first_line.startswith('".MSG_COUNT"'), "msg-count").otherwise("single")


def numbered(messages: DataFrame) -> DataFrame:
    """messages with number, their place within their source from 1."""
    at = running_before(messages, "source", ["position"], {"number": F.lit(1)})
    return at.withColumn("number", F.col("number") + 1)


def store_kind(spark: SparkSession, path: str) -> str:
    """Which reader a store asks for: folders by what lies in them, files by how they begin."""
    if is_folder(spark, path):
        return "maildir" if is_folder(spark, f"{path}/cur") or is_folder(spark, f"{path}/new") else "mh"
    line = head_of(spark, path).decode("utf-8", "replace").partition("\n")[0]
    for start, kind in (("From ", "mbox"), ("#! rmail ", "rmail"), ("MAIL FROM:", "dotted")):
        if line.startswith(start) or kind == "dotted" and line.upper().startswith(start):
            return "mbox-crlf" if kind == "mbox" and line.endswith("\r") else kind
    return "single"


def open_stores(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source, position, raw of stores of any kind, each read as it asks for; those of one kind together."""
    kinds: dict[str, list[str]] = {}
    for path in paths:
        kinds.setdefault(store_kind(spark, path), []).append(path)
    out = None
    for kind, some in sorted(kinds.items()):
        readers = {"maildir": maildir, "mh": mh}
        parts = [readers[kind](spark, p) for p in some] if kind in readers else [mbox(spark, some, crlf=True) if kind == "mbox-crlf" else listed(spark, some, kind)]
        for part in parts:
            part = part.select("source", "position", "raw")
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "source string, position long, raw string")


def listed(spark: SparkSession, paths: list[str], kind: str = "single") -> DataFrame:
    """Stores named in a list of paths."""
    return {"single": single_messages, "mbox": mbox, "rmail": rmail_batch, "dotted": dotted_batch}[kind](spark, paths)
