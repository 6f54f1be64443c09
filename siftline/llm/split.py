"""Splitting oversized texts at natural boundaries (problem 10).

Balanced targets: the least number of pieces that can hold the text is computed, their ends are
placed at equal distances, and each end is moved to the strongest boundary near its target, or where
only strength 1 is near, in all of its range. If that has no other either, but a shorter piece would,
there is one more piece, and all targets are spread anew: an end has strength 1 only where the size
limit leaves no other. If any piece, encoded on its own, exceeds the limit, all are tried with a
token less of room. Consecutive pieces share `overlap` tokens of the text's own encoding.

Boundary strengths: 6 blank line, 5 line end, 4 sentence end, 3 other punctuation, 2 blank, 1 between
characters. An end inside a character, or whose overlap would begin inside one, is not considered;
if no such place is in reach (script of many bytes a character), the overlap grows to the character
before.

Defined cases: text null or empty: one piece with 0 tokens and empty text. Text within the limit: one piece, the
text itself. Texts without any boundary are cut between characters. Id null stays null; repeated rows are
split as often as they occur. Extra columns are ignored. Joining the pieces without their overlaps gives
back the text character by character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.tokens import RANKS, tokenizer
from siftline.llm.util import spread

OUT = "id long, piece int, pieces int, char_start long, char_end long, n_tokens int, overlap_tokens int, strength int, text string"

#: Strength -> what ends at the boundary, with the blanks after it; the piece before keeps them.
BOUNDARIES = [
    (3, re.compile(r"[,;:)\]}、，；：]\s*")),
    (4, re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？]\s*")),
    (5, re.compile(r"\r?\n[ \t]*")),
    (6, re.compile(r"\r?\n[ \t]*\r?\n\s*")),
]
_BLANK = re.compile(r"\s+")

#: Times the targets are spread, where boundaries needed more pieces.
REBALANCE = 3


class Splitter:
    def __init__(self, limit: int, overlap: int, ranks: str = RANKS):
        if not 0 <= overlap < limit:
            raise ValueError("overlap must be at least 0 and below the limit")
        self.limit, self.overlap, self.encoding = limit, overlap, tokenizer(ranks)

    def _places(self, text: str, tokens: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Per token position 0..n: the character that begins there (-1 inside a character), and the boundary strength."""
        widths = np.fromiter(map(len, self.encoding.decode_tokens_bytes(tokens)), np.int64, len(tokens))
        byte_at = np.concatenate(([0], np.cumsum(widths)))
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        begins = np.concatenate(((raw & 0xC0) != 0x80, [True]))
        number = np.cumsum(begins) - 1
        char_at = np.where(begins[byte_at], number[byte_at], -1)
        strength = np.ones(len(text) + 1, np.int8)
        for m in _BLANK.finditer(text):
            strength[m.start()] = strength[m.end()] = 2  # a token may begin with the blank or after it
        for level, pattern in BOUNDARIES:
            for m in pattern.finditer(text):
                strength[m.end()] = level
                if level < 5 and m.group()[-1:].isspace():  # the same boundary before its blanks
                    strength[m.end() - len(m.group()) + len(m.group().rstrip())] = level
        return char_at, strength[char_at] * (char_at >= 0)

    def cuts(self, n: int, pieces: int, room: int, char_at: np.ndarray, strength: np.ndarray) -> list[tuple[int, int, int]] | None:
        """(start, end, strength of the end) in token positions of pieces of at most room tokens, or None if a character doesn't fit.

        There are as many as asked for, unless a size or a boundary needs more, or the rest fits before.
        """
        out, start, k = [], 0, pieces - 1  # k: pieces after this one
        whole = char_at >= 0
        clean = whole & np.concatenate((np.zeros(self.overlap, bool), whole[: n + 1 - self.overlap]))
        natural = clean & (strength > 1)
        back = np.maximum.accumulate(np.where(whole, np.arange(n + 1), 0))  # the character before
        reach = max(8, self.limit // 8)
        while True:
            if k == 0:
                if n - start <= room:
                    out.append((start, n, 0))
                    return out
                k = 1
            # an end e leaves n - e + overlap for k pieces that share overlaps among themselves
            target = start + round((n - start + k * self.overlap) / (k + 1))
            lowest, most = start + self.overlap + 1, min(start + room, n - 1)
            least = max(lowest, n - k * (room - self.overlap))

            span = slice(least, max(least, most + 1))

            def nearest(ok: np.ndarray) -> int | None:
                every = np.flatnonzero(ok) + least  # noqa: B023
                near = every[np.abs(every - target) <= reach]  # noqa: B023
                at = near if len(near) else every
                return int(at[np.argmax(strength[at] - np.abs(at - target) / (4.0 * self.limit))]) if len(at) else None  # noqa: B023

            found = nearest(natural[span])
            if found is None:
                if n - start <= room:  # no boundary, and none needed
                    k = 0
                    continue
                if least > lowest and (least > most or natural[lowest:least].any()):
                    k += 1
                    continue
                found = nearest(clean[span])
            if found is None and least <= most:
                found = nearest(whole[span] & (back[least - self.overlap : most + 1 - self.overlap] > start))
            if found is None:
                if least == lowest:
                    return None
                k += 1
                continue
            out.append((start, found, int(strength[found])))
            start, k = int(back[found - self.overlap]), k - 1

    def balanced(self, n: int, pieces: int, room: int, char_at: np.ndarray, strength: np.ndarray) -> list[tuple[int, int, int]] | None:
        """cuts; where they became more than asked for, spread anew over their number, and the fewest taken."""
        best = None
        for _ in range(REBALANCE):
            cuts = self.cuts(n, pieces, room, char_at, strength)
            if cuts is None:
                return None
            if best is None or len(cuts) <= len(best):
                best = cuts
            if len(cuts) <= pieces:
                break
            pieces = len(cuts)
        return best

    def split(self, text: str | None) -> list[tuple[int, int, int, int, int, str]]:
        """(char_start, char_end, n_tokens, overlap_tokens, strength, text) of each piece."""
        text = text or ""
        tokens = self.encoding.encode_ordinary(text)
        n = len(tokens)
        if n <= self.limit:
            return [(0, len(text), n, 0, 0, text)]
        char_at, strength = self._places(text, tokens)
        room, sizes = self.limit, {}  # tokens of the pieces tried before: most stay as they are
        while room > self.overlap:
            cuts = self.balanced(n, -(-(n - self.overlap) // (room - self.overlap)), room, char_at, strength)
            if cuts is None:
                break
            out, before = [], 0
            for start, end, s in cuts:
                a, b = int(char_at[start]), int(char_at[end]) if end < n else len(text)
                piece = text[a:b]
                if (size := sizes.get((a, b))) is None:
                    size = sizes[a, b] = len(self.encoding.encode_ordinary(piece))
                out.append((a, b, size, before - start if out else 0, s, piece))
                before = end
            if all(x[2] <= self.limit for x in out):
                return out
            room -= 1
        raise ValueError("the limit can't hold a single character with its overlap")


def split_texts(df: DataFrame, limit: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """Pieces of every text, in one narrow pass: id, piece, pieces, char_start, char_end, n_tokens, overlap_tokens, strength, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(limit, overlap, ranks)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                rows = [(ids[at + k], i, len(p), *x) for k, t in enumerate(texts) for p in [splitter.split(t)] for i, x in enumerate(p)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)

    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, OUT)


_NAMES = [c.split()[0] for c in OUT.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in OUT.split(", ")]
