"""Message structure: the tree of MIME parts as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.decode import decode_text, encoded_words

#: Kinds of parts whose content is text; messages are entered, everything else is skipped before decoding.
_TEXT, _NESTED = ("text/",), ("message/", "multipart/")
PART = "id string, part_no int, depth int, parent_type string, mime_type string, mime_encoding string, charset string, disposition string, msg string"
_FIELD = re.compile(r"^([^\s:]+):((?:[^\n]*)(?:\n[ \t][^\n]*)*)", re.M)


def _fields(head: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _FIELD.finditer(head):
        out.setdefault(m.group(1).lower(), re.sub(r"\s*\n\s*", " ", m.group(2)).strip())
    return out


def _parameter(value: str, name: str) -> str | None:
    m = re.search(rf'(?i)\b{name}\s*=\s*(?:"([^"]*)"|([^\s;]+))', value)
    return (m.group(1) if m.group(1) is not None else m.group(2)) if m else None


def parts(raw: str | None) -> list[tuple[int, str, str, str | None, str | None, str | None, str | None]]:
    """(depth, parent_type, type, encoding, charset, disposition, decoded text or None) in order of appearance.

    A boundary of any open level closes the levels below it; a final boundary closes its own.
    """
    out: list = []

    def walk(lines: list[str], depth: int, parent: str) -> None:
        cut = next((k for k, x in enumerate(lines) if not x.strip()), len(lines))
        f = _fields("\n".join(lines[:cut]))
        body = lines[cut + 1 :]
        declared = f.get("content-type", "text/plain")
        kind = declared.partition(";")[0].strip().lower() or "text/plain"
        encoding, charset = f.get("content-transfer-encoding"), _parameter(declared, "charset")
        disposition = f.get("content-disposition", "").partition(";")[0].strip().lower() or None
        boundary = _parameter(declared, "boundary")
        if kind.startswith("multipart/") and boundary:
            out.append((depth, parent, kind, encoding, charset, disposition, None))
            piece: list[str] | None = None
            for line in body:
                if line.rstrip() in (f"--{boundary}", f"--{boundary}--"):
                    if piece is not None:
                        walk(piece, depth + 1, kind)
                    piece = None if line.rstrip().endswith("--") and line.rstrip() != f"--{boundary}" else []
                elif piece is not None:
                    piece.append(line)
            if piece:
                walk(piece, depth + 1, kind)
        elif kind.startswith("message/"):
            out.append((depth, parent, kind, encoding, charset, disposition, None))
            walk(body, depth + 1, kind)
        else:
            text = decode_text("\n".join(body), encoding, charset) if kind.startswith(_TEXT) or kind == "text" else None
            out.append((depth, parent, kind, encoding, charset, disposition, text))

    if raw is not None:
        walk(raw.replace("\r\n", "\n").split("\n"), 0, "")
    return out


# Header -> tag; headers of which only the name is kept; what is skipped within header values.
TAGS = {"to": "to:", "cc": "to:", "from": "from:", "return-path": "rtrn:", "subject": "subj:", "received": "rcvd:"}
NAME_ONLY = ("date", "delivery-date", "message-id", "resent-message-id", "in-reply-to", "references")
SKIPPED = r"(?i)boundary=[ ]*\"?[^\s\";]*\"?|(?:file)?name=\"?|[ \t]id\s+<?[A-Za-z0-9.\-]+>?"
_SKIPPED = re.compile(SKIPPED)
_LINE = re.compile(r"^[^\s][^\n]*(?:\n[ \t][^\n]*)*", re.M)
SEGMENTS = "array<struct<tag: string, kind: string, text: string>>"


def segments(raw: str | None, tagged: bool = True) -> list[tuple[str | None, str, str]]:
    """(tag, kind, text) of everything in a message whose words count, in order of appearance.

    kind is header, text or html. Headers are the values with their names where a name counts, encoded words
    resolved; neighbouring ones of one tag are one segment. The headers of the message itself that have no tag
    of their own are head:, those of its parts mime:, and within a message that is a part nothing is tagged.
    Parts of other kinds than text are left out before decoding; text around the parts of a multipart counts.
    """
    out: list[tuple[str | None, str, str]] = []

    def header(lines: list[str], parent: str) -> dict[str, str]:
        block = "\n".join(lines)
        before: str | None = "-"  # no tag of this block yet
        for m in _LINE.finditer(block):
            name, sep, value = m.group().partition(":")
            if not sep or re.search(r"\s", name):  # no field, as the separator line of a mailbox
                name, value = m.group(), ""
            low = name.lower()
            if low == "x-bogosity":
                continue
            tag = TAGS.get(low) or ("mime:" if parent else "head:")
            tag = tag if tagged and not parent.startswith("message/") else None
            text = "" if low in NAME_ONLY else _SKIPPED.sub(" ", encoded_words(value) if "=?" in value else value)
            text = text if low in TAGS else f"{name} {text}"
            if tag == before:
                out[-1] = (tag, "header", f"{out[-1][2]}\n{text}")
            else:
                out.append((tag, "header", text))
            before = tag
        return _fields(block)

    def walk(lines: list[str], parent: str) -> None:
        cut = next((k for k, x in enumerate(lines) if not x.strip(" \t")), len(lines))
        f = header(lines[:cut], parent)
        body = lines[cut + 1 :]
        declared = f.get("content-type", "")
        kind = declared.partition(";")[0].strip().lower()
        boundary = _parameter(declared, "boundary")
        if kind.startswith("multipart/") and boundary:
            ends = {f"--{boundary}": False, f"--{boundary}--": True}
            piece, inside = [], False
            for line in [*body, f"--{boundary}--"]:
                final = ends.get(line.rstrip())
                if final is None:
                    piece.append(line)
                    continue
                if inside:
                    walk(piece, kind)
                elif piece:
                    out.append((None, "text", "\n".join(piece)))
                piece, inside = [], not final
        elif kind.startswith("message/"):
            walk(body, kind)
        elif kind == "" or kind.startswith(("text", "multipart/")):
            out.append((None, "html" if kind.startswith("text/html") else "text", decode_text("\n".join(body), f.get("content-transfer-encoding"), _parameter(declared, "charset"))))

    if raw is not None:
        walk(raw.replace("\r\n", "\n").split("\n"), "")
    return out


def with_segments(df: DataFrame, id_col: str, raw_col: str, tagged: bool = True) -> DataFrame:
    """id, segments of every message: one narrow Arrow pass."""
    item = pa.struct([("tag", pa.string()), ("kind", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"tag": t, "kind": k, "text": x} for t, k, x in segments(raw, tagged)] for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(item))], ["id", "segments"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(raw_col).alias("raw")).mapInArrow(run, f"id {kind}, segments {SEGMENTS}")


def explode_parts(df: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    """One row per part; text only for text parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k + 1, p[0], *p[1:]) for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, p in enumerate(parts(raw))]
            cols = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(raw_col).alias("raw")).mapInArrow(run, PART)


_NAMES = [c.split()[0] for c in PART.split(", ")]
_TYPES = [{"int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in PART.split(", ")]


def normal_type(declared: Column) -> Column:
    """Kind of a declared MIME type by its beginning; 'text' where nothing or something unknown is declared."""
    t = F.lower(F.trim(F.regexp_replace(declared, ";.*$", "")))
    out = F.lit("other")
    for start in ("multipart/", "message/", "application/", "image/", "audio/", "video/"):
        out = F.when(t.startswith(start), start.rstrip("/")).otherwise(out)
    return F.when(t.isNull() | (t == "") | t.startswith("text"), F.when(t.startswith("text/html"), "html").otherwise("text")).otherwise(out)


def normal_encoding(declared: Column) -> Column:
    """A declared transfer encoding, or 'identity' for everything that changes nothing or is unknown."""
    e = F.lower(F.trim(declared))
    return F.when(e.isin("quoted-printable", "base64", "x-uuencode"), e).otherwise("identity")


def readable(parts_df: DataFrame, type_col: str = "mime_type") -> DataFrame:
    """Only parts whose tokens count."""
    return parts_df.where(normal_type(F.col(type_col)).isin("text", "html"))
