"""Transfer encodings, encoded words, charsets, entities and escapes.

What is expressible with JVM functions is a column expression; decoders that walk bytes are Arrow
batch functions over whole columns, never per-row calls across the JVM border.
"""

from __future__ import annotations

import binascii
import codecs
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_HEX = re.compile(rb"=([0-9A-Fa-f]{2})|=\r?\n|(_)")


def quoted_printable(raw: bytes, in_header: bool = False) -> bytes:
    """=XX to its byte, soft line ends gone, in headers '_' to a blank; broken escapes stay."""

    def one(m: re.Match) -> bytes:
        if m.group(1):
            return bytes([int(m.group(1), 16)])
        if m.group(2):
            return b" " if in_header else b"_"
        return m.group() if in_header else b""

    return _HEX.sub(one, raw)


def base64_lines(raw: bytes) -> bytes:
    """Decoded line by line; a line with a foreign character stays as it is, an incomplete last group is dropped, '=' ends a line."""
    out = []
    for line in raw.splitlines(keepends=True):
        body = line.strip(b"\r\n")
        core = body.rstrip(b"=")
        if not body:
            continue
        if not re.fullmatch(rb"[A-Za-z0-9+/]+", core) or len(body) <= 4 and len(body) % 4:
            out.append(line)
            continue
        core = core[: len(core) - (1 if len(core) % 4 == 1 else 0)]
        out.append(binascii.a2b_base64(core + b"=" * (-len(core) % 4)))
    return b"".join(out)


def uuencoded(raw: bytes) -> bytes:
    """Lines between begin and end; a line whose length byte is no such stays out."""
    out = []
    for line in raw.splitlines():
        if line.startswith((b"begin ", b"end")) or not line or not 0x20 <= line[0] <= 0x60:
            continue
        n = (line[0] - 32) & 0x3F
        try:
            out.append(binascii.a2b_uu(line))
        except binascii.Error:
            out.append(binascii.a2b_uu(line[: 1 + (n + 2) // 3 * 4]))
    return b"".join(out)


def charset_name(name: str | None) -> str:
    """The name Python knows a declared charset by; utf-8 for what it does not know."""
    plain = (name or "").strip().strip("\"'").lower().replace("_", "-")
    if plain in ("", "us-ascii", "ascii", "default", "unknown-8bit", "x-unknown", "8bit"):
        return "utf-8"
    if plain == "ansi":
        return "cp1252"
    try:
        codecs.lookup(plain)
    except LookupError:
        return "utf-8"
    return plain


def to_text(raw: bytes, charset: str | None) -> str:
    """Bytes as text; bytes the charset has no character for become the replacement character."""
    return raw.decode(charset_name(charset), "replace")


_ENCODED = re.compile(r"=\?([A-Za-z0-9-]+)\?([bBqQ])\?([^?\n]*)\?=")


def encoded_words(text: str) -> str:
    """RFC 2047 words decoded; white space between adjacent ones gone; broken words stay."""
    text = re.sub(r"(\?=)\s+(?==\?[A-Za-z0-9-]+\?[bBqQ]\?)", r"\1", text)

    def one(m: re.Match) -> str:
        raw = m.group(3).encode("utf-8", "replace")
        if m.group(2) in "bB":
            core = raw.rstrip(b"=")
            if not re.fullmatch(rb"[A-Za-z0-9+/]*", core) or len(core) % 4 == 1:
                return m.group()
            data = binascii.a2b_base64(core + b"=" * (-len(core) % 4))
        else:
            data = quoted_printable(raw, in_header=True)
        return to_text(data, m.group(1))

    return _ENCODED.sub(one, text)


def decode_body(raw: bytes, encoding: str | None, charset: str | None) -> str:
    """A part's bytes by its declared transfer encoding and charset; unknown encodings are the identity."""
    e = (encoding or "").strip().lower()
    if e == "quoted-printable":
        raw = quoted_printable(raw)
    elif e == "base64":
        raw = base64_lines(raw)
    elif e in ("x-uuencode", "uuencode"):
        raw = uuencoded(raw)
    return to_text(raw, charset)


def decode_text(text: str, encoding: str | None, charset: str | None) -> str:
    """decode_body for a body that is text already: its charset matters only where the transfer encoding hid it."""
    e = (encoding or "").strip().lower()
    if e not in ("quoted-printable", "base64", "x-uuencode", "uuencode"):
        return text
    return decode_body(text.encode("utf-8", "replace"), e, charset)


@F.pandas_udf(T.StringType())
def decoded_body(raw: pd.Series, encoding: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else decode_body(bytes(r), e, c) for r, e, c in zip(raw, encoding, charset, strict=True)])


@F.pandas_udf(T.StringType())
def decoded_words(text: pd.Series) -> pd.Series:
    return text.map(encoded_words, na_action="ignore")


def recoder(charset: str):
    """A column function: characters that are bytes of a charset as its text; what it cannot read stays."""
    def one(text: str) -> str:
        try:
            return text.encode("latin-1").decode(charset)
        except UnicodeError:
            return text

    return F.pandas_udf(lambda s: s.map(one, na_action="ignore"), T.StringType())


def qp_valid(text: Column, in_header: bool = False) -> Column:
    """Only printable ASCII; in bodies tabs and line ends too, in headers neither those nor blanks and question marks."""
    return text.rlike(r"^[\x21-\x3e\x40-\x7e]*$" if in_header else r"^[\x20-\x7e\t\r\n]*$")


def crlf_to_lf(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n", "\n")


def numeric_entities(text: Column) -> Column:
    """&#ddd; and &#xhh; of printable characters below 256; others and named ones stay."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?is)&#(?:[0-9]{1,5}|x[0-9a-f]{1,4});|[^&]+|&"), F.lit(0))

    def one(p: Column) -> Column:
        number = F.when(p.rlike(r"(?i)^&#x[0-9a-f]{1,4};$"), F.conv(F.regexp_extract(p, r"(?i)^&#x([0-9a-f]+);$", 1), 16, 10).cast("int")).when(p.rlike(r"^&#[0-9]{1,5};$"), F.regexp_extract(p, r"^&#([0-9]+);$", 1).try_cast("int"))
        shown = number.between(32, 126) | number.between(160, 255)
        return F.when(shown, F.char(number)).otherwise(p)

    return F.when(text.contains("&#"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def percent_escapes(url: Column) -> Column:
    """%xx after the first '/' of a URL; what is no valid escape stays."""
    tail = F.regexp_extract(url, r"^[^/]*(/.*)$", 1)
    return F.when(tail.rlike("%[0-9A-Fa-f]{2}"), F.concat(F.regexp_replace(url, r"/.*$", ""), F.coalesce(F.try_url_decode(F.regexp_replace(F.replace(tail, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")), tail))).otherwise(url)


# The character classes of a token's first, inner and last character.
# Written as ASCII ranges, which the JVM matches three times faster than its named classes.
BAD = r"\x00-\x20\x7f:$*<>;=()&%#@+|/\\{}^\"?,\[\]"
FRONT = r"[^\x00-@\[-`{-\x7f]"
WORD = rf"{FRONT}(?:[^{BAD}]*[^{BAD}._~'`\-])?"

# Tags that part words; all others leave the words around them joined.
BREAK_TAGS = r"p|br|li|h[1-6]|hr|title|table|center|dd|dt|iframe|img|input|select|td|textarea|th|/?(?:div|blockquote|pre|dir|dl|fieldset|legend|form|menu|ol|ul)"


def escapes_in_tags(html: Column) -> Column:
    """%xx in the attributes of a, img and font resolved from the first slash of a value on; bytes that are no text stay."""
    def tag(p: Column) -> Column:
        parts = F.regexp_extract_all(p, F.lit(r"(?:%[0-9A-Fa-f]{2})+|[^%]+|%"), F.lit(0))
        shown = F.transform(parts, lambda x, k: F.when(x.rlike("^%[0-9A-Fa-f]{2}") & F.exists(F.slice(parts, F.lit(1), k), lambda y: y.contains("/")), F.coalesce(F.try_url_decode(x), x)).otherwise(x))
        return F.array_join(shown, "")

    pieces = F.regexp_extract_all(html, F.lit(r"(?is)<(?:a|img|font)\s[^>]*>|[^<]+|<"), F.lit(0))
    has = html.rlike(r"(?is)<(?:a|img|font)\s[^>]*/[^>]*%[0-9a-f]{2}")
    return F.when(has, F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("<") & p.contains("%"), tag(p)).otherwise(p)), "")).otherwise(html)


def html_text(html: Column) -> Column:
    """Words of HTML: comments vanish, breaking tags part words, other tags join them; attributes of a, img and font stay as words, their escapes resolved."""
    out = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    out = F.regexp_replace(out, r"(?s)<![^>]*>", "")
    out = F.regexp_replace(out, rf"(?is)({WORD})((?:<(?:a|font)\s[^>]*>)+)([^\s<])", "$2$1$3")  # the words around such a tag are one
    out = escapes_in_tags(out)
    out = F.regexp_replace(out, r"(?is)<(?:a|img|font)\s([^>]*)>", " $1 ")
    out = F.regexp_replace(out, rf"(?is)<(?:{BREAK_TAGS})(?:\s[^>]*)?/?>", " ")
    return numeric_entities(F.regexp_replace(out, r"(?s)<[^>]*>", ""))
