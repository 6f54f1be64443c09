"""Score headers, log lines and messages passed through, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftline.operators.tokenize import unfolded
from siftline.params import Params

HEADER = "X-Bogosity"


def render(template: str, fields: dict[str, Column]) -> Column:
    """A template with %x directives, x a key of fields; %.3f-like precisions for e, f and g, %N.M or %.M cuts strings; %% is a percent sign.

    Flags 0, - and # and widths are read; a width pads on the left, with - on the right. An unknown directive is an error.
    """
    out: list[Column] = []
    k, plain = 0, ""
    while k < len(template):
        if template[k] != "%":
            plain += template[k]
            k += 1
            continue
        k += 1
        start = k
        while k < len(template) and template[k] in "0123456789-#.":
            k += 1
        spec, letter = template[start:k], template[k : k + 1]
        k += 1
        if letter == "%":
            plain += "%"
            continue
        if letter not in fields:
            raise ValueError(f"unknown directive %{letter}")
        out.append(F.lit(plain))
        plain = ""
        value = fields[letter]
        width, _, prec = spec.replace("#", "").partition(".")
        if letter in "efo":
            out.append(F.format_string(f"%{width}.{prec or 6}{'f' if letter == 'o' else letter}", value))
        elif letter == "g":
            out.append(_padded(_shortest(value, int(prec or 6)), width))
        else:
            text = value.cast("string")
            out.append(_padded(F.substring(text, 1, int(prec)) if prec.isdigit() else text, width))
    return F.concat(*out, F.lit(plain))


def _padded(text: Column, width: str) -> Column:
    """Text of at least so many characters; longer ones stay whole."""
    n = width.strip("-").lstrip("0")
    if not n.isdigit():
        return text
    pad = F.rpad if width.startswith("-") else F.lpad
    return F.when(F.length(text) < int(n), pad(text, int(n), " ")).otherwise(text)


def _shortest(value: Column, digits: int) -> Column:
    """So many significant digits without zeros at the end, as an exponent below 1e-4 or where the digits do not reach the units."""
    power = F.floor(F.log10(F.abs(value)))
    rounded = F.format_string(f"%.{digits - 1}e", value)
    places = F.greatest(F.lit(digits - 1) - power, F.lit(0))
    fixed = F.regexp_replace(F.regexp_replace(F.element_at(F.array(*[F.format_string(f"%.{k}f", value) for k in range(digits + 4)]), (places + 1).cast("int")), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    wide = F.regexp_replace(F.regexp_replace(rounded, r"(\.[0-9]*?)0+e", "$1e"), r"\.e", "e")
    return F.when(value == 0, F.lit("0")).when((power < -4) | (power >= digits), wide).otherwise(fixed)


def fields(p: Params, header: str = HEADER, version: str = "1", log_tag: str = "", run_type: str = "", user: str = "", date: Column | None = None) -> dict[str, Column]:
    """Directive -> column for scored messages(status, spamicity, n_tokens, message_addr, message_id, queue_id); %m the messages of the run, from n_messages where there is such a column."""
    s = F.col("spamicity")
    spam = F.col("status") == p.tags[0]
    unknown = lambda c: F.coalesce(F.col(c), F.lit("UNKNOWN"))
    number = lambda c: F.format_string("%.6f", c)
    return {
        "h": F.lit(header), "c": F.col("status"), "p": number(s), "d": number(F.when(spam, 1 - s).otherwise(s)), "e": s, "f": s, "g": s, "o": F.lit(p.spam_cutoff),
        "A": unknown("message_addr"), "I": unknown("message_id"), "Q": unknown("queue_id"), "w": F.col("n_tokens"), "v": F.lit(version),
        "l": F.lit(log_tag), "r": F.lit(run_type), "u": F.lit(user), "m": F.col("n_messages"), "D": F.date_format(F.current_timestamp() if date is None else date, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }


def pass_through(raw: Column, score_line: Column, tag: Column, place: str | None = None) -> Column:
    """The message with old score headers dropped and the new one put before the `place` header, or at the end of the header; a tag, if not null, opens the Subject."""
    text = F.regexp_replace(unfolded(raw), rf"(?m)^{HEADER}[^\n]*\n(?:[ \t][^\n]*\n)*", "")
    head = F.regexp_extract(text, r"(?s)\A((?:[^\n]+\n?)*)", 1)
    body = F.substring(text, F.length(head) + 1, F.length(text))
    tagged = F.when(tag.isNull(), head).otherwise(F.regexp_replace(head, r"(?im)\A((?:(?!subject:)[^\n]*\n)*)(subject:)[ ]?", F.concat(F.lit("$1$2 "), tag, F.lit(" "))))
    line = F.concat(F.when((head == "") | head.endswith("\n"), "").otherwise("\n"), score_line, F.lit("\n"))
    placed = F.concat(tagged, line)
    if place:
        there = rf"(?m)\A((?:(?!{place})[^\n]*\n)*)(?={place})"
        placed = F.when(tagged.rlike(rf"(?m)^{place}"), F.regexp_replace(tagged, there, F.concat(F.lit("$1"), line))).otherwise(placed)
    return F.concat(placed, F.when(body == "", F.lit("\n")).otherwise(body))
