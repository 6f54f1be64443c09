"""Text decoded with the wrong character encoding: find it, name the chain, restore the original (problem 2).

A chain (written in, read as) turns bytes of one encoding into characters of another, once or twice.
A multinomial classifier tells chains from clean text: its features are hashed byte bigrams of the
UTF-8 form, of which only those with a non-ASCII byte count; it is fitted on the non-ASCII words of all
records, each as often as it occurs, garbled synthetically by every chain. The collection holds some garbled
records itself; they are taken out with the first fit and the second fit uses the rest. Records with a replacement
character are no clean text and are left out of both. Words are counted by one aggregation and garbled once each;
the counts are whole numbers, so their sums, and with them the model, don't depend on how rows are spread.

A text is scored word by word: the log odds of every chain against clean text, minus infinity where
the word can't be inverted strictly through the chain, or where the restored word is no likelier in clean text
than the word itself. The best contiguous run of words decides: its odds, less a prior's penalty for chains
that are not from UTF-8, must exceed THRESHOLD (in one-byte chains, where strict decodability says little, a
word counts for no more than its restored form is likelier), so a single garbled character counts as well
as a whole text. Restoring inverts the words of the run and repeats until nothing is found. The replacement character is damage
that no chain undoes: such texts are found, and reported as not restorable.

Defined cases: text null, empty or ASCII only: clean. Id null: the row keeps its null id. Repeated rows are judged one by one. Ties between chains go to
the first in CHAINS. Very long texts are scored whole. An empty table, or one without non-ASCII text, fits an empty model and
only replacement characters are found. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.util import spread

THRESHOLD = 7.0
#: Added to every bigram count.
FLOOR = 0.3
_BINS = 1 << 16

ONE_BYTE = ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp437", "cp850", "mac-roman", "cp866", "cp852"]
MANY_BYTES = ["utf-8", "gbk", "shift_jis", "euc-jp"]
# Steps whose characters differ enough to leave a trace; the two Western pairs differ only in 0x80-0x9F.
STEPS = [(o, r) for o in MANY_BYTES + ONE_BYTE for r in ONE_BYTE + ["gbk"] if o != r]
CHAINS: list[tuple[tuple[str, str], ...]] = [(s,) for s in STEPS] + [
    (("utf-8", r), ("utf-8", r)) for r in ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "cp437", "mac-roman")
]
#: What the prior takes off a chain's log odds: UTF-8 is the usual case; through other multi-byte encodings many a short word is decodable.
PENALTY = np.array([0.0 if c[0][0] == "utf-8" else THRESHOLD if c[0][0] in MANY_BYTES else 2.0 for c in CHAINS])
#: Chains of which a part of a run of non-ASCII characters can be told: one step from UTF-8 to one-byte characters.
PARTLY = [k for k, c in enumerate(CHAINS) if len(c) == 1 and c[0][0] == "utf-8" and c[0][1] in ONE_BYTE]
_PARTLY = frozenset(PARTLY)
_SEQUENCES = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_CONTROL = re.compile(r"[\x80-\x9f]")
_RUN = re.compile(r"[^\x00-\x7f]+")
_NON_ASCII = r"[^\x00-\x7f]"
_WORD = re.compile(r"[^ \t\r\n\f\v]+")


@lru_cache(None)
def _byte_of(charset: str) -> dict[str, int]:
    """Character -> byte of a one-byte charset; bytes without a character stand for the control of the same number."""
    table: dict[str, int] = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            ch = chr(b)
        table.setdefault(ch, b)
    return table


def _to_bytes(text: str, charset: str) -> bytes:
    if charset not in ONE_BYTE:
        return text.encode(charset)
    table = _byte_of(charset)
    try:
        return bytes([table[c] for c in text])
    except KeyError as e:
        raise UnicodeError(str(e)) from None


@lru_cache(None)
def _char_of(charset: str) -> list[str]:
    out = [chr(b) for b in range(256)]
    for ch, b in _byte_of(charset).items():
        out[b] = ch
    return out


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text as the chain would show it; None where it can't be written or read strictly."""
    try:
        for written, read in chain:
            raw = text.encode(written)
            text = "".join(map(_char_of(read).__getitem__, raw)) if read in ONE_BYTE else raw.decode(read)
    except UnicodeError:
        return None
    return text


def garble_all(words: list[str], chain: tuple[tuple[str, str], ...]) -> list[str | None]:
    """garble() of many words without line ends; the common steps run over all words at once."""
    now: list[str | None] = list(words)
    for written, read in chain:
        at = [k for k, w in enumerate(now) if w is not None]
        if not at:
            break
        if read in ONE_BYTE and written in (*ONE_BYTE, "utf-8"):
            joined = "\n".join(now[k] for k in at)
            chars = _char_of(read)
            if written == "utf-8":
                out = joined.encode("utf-8", "replace").decode("latin-1").translate({b: ch for b, ch in enumerate(chars) if b >= 128}).split("\n")
            else:
                strict = {ch: b for ch, b in _byte_of(written).items() if b < 128 or not "\x80" <= ch < "\xa0"}
                out = joined.translate({ord(ch): chars[strict[ch]] if ch in strict else "\0" for ch in set(joined) - {"\n"}}).split("\n")
            made = [None if "\0" in w else w for w in out]
        else:
            made = [garble(now[k], ((written, read),)) for k in at]
        for k, w in zip(at, made, strict=True):
            now[k] = w
    return now


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """What the chain was applied to; None unless every step is strictly decodable and the way back gives the text again."""
    was = text
    try:
        for written, read in reversed(chain):
            was = _to_bytes(was, read).decode(written)
    except UnicodeError:
        return None
    return was if was != text and not any("\x80" <= c < "\xa0" for c in was) and garble(was, chain) == text else None


def _pair_bins(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams of bytes a and b; whether they have a non-ASCII byte."""
    a, b = a.astype(np.uint32), b.astype(np.uint32)
    return ((a * np.uint32(0x9E3B) + b * np.uint32(0x85EBCA6B)) >> np.uint32(3)) % np.uint32(_BINS), (a | b) > 127


def _bins(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigram of each position but the last; whether it has a non-ASCII byte."""
    return _pair_bins(raw[:-1], raw[1:])


#: So many that in a large collection few triples share a bin with a frequent one.
_CHAR_BINS = 1 << 22


def _char_bins(padded: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character from the third on: bins of the triple ending there, of the two before it, and of the one before it."""
    c = np.frombuffer(padded.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    first, second, third = c * np.uint64(0x9E3779B1), c * np.uint64(0x85EBCA77), c * np.uint64(0xC2B2AE3D)
    mixed = np.empty((4, len(c) - 2), np.uint64)  # triple, pair before, pair there, single one
    np.add(first[:-2], second[1:-1], out=mixed[1])
    np.add(mixed[1], third[2:] + np.uint64(3 * 7919), out=mixed[0])
    mixed[1] += np.uint64(2 * 7919)
    np.add(first[1:-1], second[2:] + np.uint64(2 * 7919), out=mixed[2])
    np.add(first[1:-1], np.uint64(7919), out=mixed[3])
    bins = ((mixed * np.uint64(0x27D4EB2F165667C5) >> np.uint64(40)) % np.uint64(_CHAR_BINS)).astype(np.int64)
    return bins[0], bins[1:3], bins[3]


def _count_chars(words: dict[str, int], triples: np.ndarray, pairs: np.ndarray, steps: np.ndarray) -> None:
    """Add counts by bin: triples; pairs and single characters together; and those of byte steps, 256 x 256 in a row."""
    listed, n = list(words), np.fromiter(words.values(), float, len(words))
    weight = np.repeat(n, [len(w) + 3 for w in listed])  # a word's own, up to the two spaces before the next
    three, two, one = _char_bins("".join(f"  {w} " for w in listed) + "  ")
    np.add.at(triples, three, weight)
    np.add.at(pairs, two[0], weight)
    np.add.at(pairs, one, weight)
    raw = np.frombuffer(("".join(f" {w} " for w in listed) + " ").encode("utf-8", "replace"), np.uint8).astype(np.int64)
    np.add.at(steps, raw[:-1] * 256 + raw[1:], np.repeat(n, [len(w.encode("utf-8", "replace")) + 2 for w in listed]))


class _Word:
    """One word: odds of its runs by chain, the row of their sums, and its inversions as far as asked for."""

    __slots__ = ("runs", "row", "inverted", "holds")

    def __init__(self, runs: np.ndarray, row: int):
        self.runs, self.row = runs, row
        self.inverted: dict[int, tuple[str | None, float, float]] = {}
        self.holds: dict[str, bool] = {}


#: Stands for a word that a chain cannot have made: no run goes over it.
_BLOCKED = -100.0
#: Words kept by a worker before it forgets them all (about a kilobyte each), and words scored at a time.
_KEPT, _AT_ONCE = 1 << 16, 2048


@dataclass
class Model:
    """odds: bins x chains, log p(bin | chain) - log p(bin | clean)."""

    odds: np.ndarray
    #: Log counts of clean text: hashed character triples and their first two characters.
    triples: np.ndarray
    pairs: np.ndarray
    #: 256 x 256, log p(next byte | byte) in clean text.
    steps: np.ndarray
    known: dict[str, float] = field(default_factory=dict)
    #: What is known of words met before, so that each is scored and inverted once a worker: non-ASCII word -> _Word.
    words: dict[str, _Word] = field(default_factory=dict)
    #: Rows of the words: what each may count at most by chain; the same, but what it does count where that is known.
    sums: np.ndarray | None = None
    caps: np.ndarray | None = None

    def __getstate__(self) -> dict:
        """Compressed for broadcasting: most bins are empty."""
        packed = {k: (v.dtype.str, v.shape, zlib.compress(v.tobytes(), 1)) for k, v in (("odds", self.odds.astype(np.float16)), ("triples", self.triples), ("pairs", self.pairs), ("steps", self.steps))}
        return packed | {"known": {}, "words": {}, "sums": None, "caps": None}

    def __setstate__(self, state: dict) -> None:
        for k, v in state.items():
            setattr(self, k, v if k in ("known", "words", "sums", "caps") else np.frombuffer(zlib.decompress(v[2]), v[0]).reshape(v[1]))
        self.odds = self.odds.astype(np.float32)

    def byte_plausible(self, word: str) -> float:
        raw = np.frombuffer(f" {word} ".encode("utf-8", "replace"), np.uint8)
        return float(self.steps[raw[:-1], raw[1:]].sum())

    def plausible(self, word: str) -> float:
        """Log likelihood of a word under the characters of clean text, backing off to pairs and to nothing."""
        if (known := self.known.get(word)) is not None:
            return known
        if len(self.known) > 1 << 16:
            self.known.clear()
        three, two, one = _char_bins(f"  {word} ")
        p = 0.9 * self.triples[three] / (self.pairs[two[0]] + 1.0) + 0.09 * self.pairs[two[1]] / (self.pairs[one] + 1.0) + 1e-5
        self.known[word] = value = float(np.log(p).sum())
        return value

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of each non-ASCII run (runs x chains), the word each run lies in, and what a part of the run may reach in the chains of PARTLY."""
        joined = " " + " ".join(words) + " "
        runs = [m.span() for m in _RUN.finditer(joined)]
        raw = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
        bins, counts = _bins(raw)
        high = (raw > 127).astype(np.int8)
        first = np.cumsum(np.diff(high, prepend=0) == 1)  # number of the run that began last
        owner = first[1:] - 1  # a bigram that leads into a run belongs to it, one that leads out to the run it leaves
        starts = np.flatnonzero(np.diff(owner[counts], prepend=-1))
        blanks = np.cumsum(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32) == 32)
        each = self.odds[bins[counts]]
        part = each[:, PARTLY].astype(float)
        after = np.cumsum(part, axis=0) - 1e6 * owner[counts][:, None]  # so far apart that no minimum outlives its run
        most = np.maximum.reduceat(after - np.minimum.accumulate(after - part, axis=0), starts, axis=0)
        return np.add.reduceat(each, starts, axis=0), blanks[[a for a, _ in runs]] - 1, most

    def _part_of_run(self, run: str, chain, c: int, now: float, tried) -> tuple[str | None, float, float]:
        """A run with the UTF-8 sequences inside it inverted that make the word likelier: (run, likelihood, odds)."""
        table = _byte_of(chain[0][1])
        raw = bytes([table.get(ch, 0) for ch in run])
        best, total, shift = None, 0.0, 0
        for m in _SEQUENCES.finditer(raw):
            was = None
            try:
                was = m.group().decode("utf-8")
                while True:  # the same step may have been taken more than once
                    was = _to_bytes(was, chain[0][1]).decode("utf-8")
            except UnicodeError:
                pass
            if was is None or any("\x80" <= ch < "\xa0" for ch in was):
                continue
            base = best or run
            made = base[: m.start() + shift] + was + base[m.end() + shift :]
            if (value := tried(made)) > now:
                bins, _ = _bins(np.frombuffer(run[m.start() : m.end()].encode("utf-8", "replace"), np.uint8))
                best, now, total = made, value, total + float(self.odds[bins, c].sum())
                shift += len(was) - len(m.group())
        return best, now, total

    def _inverted(self, word: str, c: int, odds: np.ndarray) -> tuple[str | None, float, float]:
        """The word before the chain, how much likelier that is, and the odds of the runs that changed.

        Of a partly garbled word only the runs, or the UTF-8 sequences within them, whose inversion makes the word likelier change.
        """
        chain = CHAINS[c]
        many = chain[0][0] in MANY_BYTES

        def gain(text: str) -> float:
            by_character = self.plausible(text) - self.plausible(word)
            return max(by_character, self.byte_plausible(text) - self.byte_plausible(word)) if many else by_character

        was = invert(word, chain)
        if was is not None and (g := gain(was)) > 0:
            return was, g, float(odds.sum())
        now, best, total = None, 0.0, 0.0
        parts, k = _RUN.split(word), 0
        found = _RUN.findall(word)
        for k, run in enumerate(found):
            def tried(r: str, k: int = k) -> float:
                return gain("".join(p + x for p, x in zip(parts, [*found[:k], r, *found[k + 1 :], ""], strict=True)))

            was, reached, value = invert(run, chain) if odds[k] > 0 else None, best, float(odds[k])
            if was is not None:
                reached = tried(was)
            if reached <= best and c in _PARTLY:
                was, reached, value = self._part_of_run(run, chain, c, best, tried)
            if was is not None and reached > best:
                best, total = reached, total + value
                found[k] = was
                now = "".join(p + x for p, x in zip(parts, [*found, ""], strict=True))
        return now, best, total

    def learn(self, texts: list[str | None]) -> None:
        """Score the words of texts that are not known yet, many at a time."""
        if not self.odds.shape[1]:
            return
        every = dict.fromkeys(w for t in texts if t and not t.isascii() for w in _WORD.findall(t) if not w.isascii())
        new = [w for w in every if w not in self.words]
        if len(self.words) + len(new) > _KEPT:
            self.words.clear()
            new = list(every)
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and end - at < _AT_ONCE and (size < 1 << 15 or end == at):  # bigrams x chains at once
                size += 2 * len(new[end])
                end += 1
            part = new[at:end]
            runs, word_of, most = self.scores(part)
            starts = np.flatnonzero(np.diff(word_of, prepend=-1))
            s = np.maximum(np.add.reduceat(runs, starts, axis=0), np.maximum.reduceat(runs, starts, axis=0))
            s[:, PARTLY] = np.maximum(s[:, PARTLY], np.add.reduceat(most, starts, axis=0))
            ends = np.append(starts[1:], len(word_of))
            held = len(self.words)
            if self.sums is None or held + len(part) > len(self.sums):
                grown = np.empty((max(2 * held, held + len(part), 4096), s.shape[1]), np.float32)
                grown[:held] = self.sums[:held] if self.sums is not None else 0
                caps = np.empty_like(grown)
                caps[:held] = self.caps[:held] if self.caps is not None else 0
                self.sums, self.caps = grown, caps
            self.sums[held : held + len(part)] = self.caps[held : held + len(part)] = s
            for k, w in enumerate(part):
                self.words[w] = _Word(runs[starts[k] : ends[k]].copy(), held + k)
            at = end

    def best(self, text: str, any_will_do: bool = False) -> tuple[float, int, list[tuple[int, int, str]]]:
        """(log odds, chain, restored words as (start, end, text)) of the best run of words; of any run found, with no word restored, if any will do."""
        spans = [m.span() for m in _WORD.finditer(text) if not m.group().isascii()]
        if not spans or not self.odds.shape[1]:
            return 0.0, -1, []
        words = [text[a:b] for a, b in spans]
        if any(w not in self.words for w in words):
            self.learn([text])
        known = [self.words[w] for w in words]
        at_rows = [w.row for w in known]
        s, caps = self.sums[at_rows], self.caps[at_rows]
        total = np.vstack([np.zeros(s.shape[1], np.float32), np.cumsum(caps, axis=0)])
        bound = (total - np.minimum.accumulate(total, axis=0)).max(0) - PENALTY  # best run of each chain, were every word invertible
        top = (0.0, -1, 0, 0)

        def at(k: int, c: int) -> tuple[str | None, float, float]:
            held = known[k].inverted
            if c not in held:
                was, gain, odds = held[c] = self._inverted(words[k], c, known[k].runs[:, c])
                if s[k, c] > 0:  # a word that speaks against the chain only does so
                    self.caps[known[k].row, c] = _BLOCKED if was is None else odds if CHAINS[c][0][0] in MANY_BYTES else min(odds, gain)
            return held[c]

        def possible(c: int) -> bool:
            """Whether the words hold a UTF-8 sequence at all, as a last step from UTF-8 would have left it."""
            written, read = CHAINS[c][-1]
            if written != "utf-8" or read not in ONE_BYTE:
                return True
            for w, held in zip(words, known, strict=True):
                if read not in held.holds:
                    table = _byte_of(read)
                    held.holds[read] = any(_SEQUENCES.search(bytes([table.get(ch, 0) for ch in run])) for run in _RUN.findall(w))
                if held.holds[read]:
                    return True
            return False

        for c in map(int, np.argsort(-bound, kind="stable")):
            if bound[c] <= THRESHOLD or bound[c] < top[0] - 0.01:  # ties are looked at, so the order of bounds decides nothing
                break
            if not possible(c):
                continue
            many, run, start = CHAINS[c][0][0] in MANY_BYTES, 0.0, 0
            for k in range(len(words)):
                v = float(caps[k, c])
                if v == _BLOCKED:
                    run, start = 0.0, k + 1
                    continue
                if v > 0:
                    was, gain, odds = at(k, c)
                    if was is None:
                        run, start = 0.0, k + 1
                        continue
                    v = odds if many else min(odds, gain)
                run += v
                if run <= 0:
                    run, start = 0.0, k + 1
                elif (value := float(run - PENALTY[c])) > THRESHOLD and (value > top[0] + 1e-6 or c < top[1] and value > top[0] - 1e-6):
                    top = (value, c, start, k)
                    if any_will_do:
                        return value, c, []
        odds, c, a, b = top
        if c < 0:
            return odds, -1, []
        changed = []
        for k in range(len(words)):
            if a <= k <= b or s[k, c] > THRESHOLD:
                was, gain, _ = at(k, c)
                if was is not None:
                    changed.append((*spans[k], was))
        return odds, c, changed

    def is_garbled(self, text: str) -> bool:
        """Whether best() finds a chain."""
        return self.best(text, True)[1] >= 0

    def repair(self, text: str | None) -> tuple[bool, str | None, list[int], float]:
        """(garbled, the restored text or None, chains found, log odds of the first)."""
        if not text or text.isascii():
            return False, None, [], 0.0
        now, chains, first, known = text, [], 0.0, set()
        while True:
            odds, c, changed = self.best(now)
            first = first or odds
            if c < 0 or now in known:  # nothing found, or an inversion led back
                break
            known.add(now)
            chains.append(c)
            for a, b, was in reversed(changed):
                now = now[:a] + was + now[b:]
        lost = "�" in text
        clean = bool(chains) and not lost and c < 0
        return bool(chains) or lost, now if clean else None, chains, first


def _counted(words: Counter[str]) -> np.ndarray:
    """Weighted bigram counts of words."""
    total = np.zeros(_BINS)
    if words:
        raw = np.frombuffer((" " + " ".join(words) + " ").encode("utf-8", "replace"), np.uint8)
        bins, counts = _bins(raw)
        weight = np.fromiter(words.values(), float, len(words))
        owner = np.minimum(np.cumsum(raw == 32)[:-1] - 1, len(words) - 1)
        total = np.bincount(bins[counts], weight[owner[counts]], _BINS)
    return total


def _words(texts: list[str]) -> Counter[str]:
    """Non-ASCII words."""
    return Counter(w for t in texts for w in _WORD.findall(t) if not w.isascii())


def _count_chain(words: dict[str, int], chain: tuple[tuple[str, str], ...] | None) -> np.ndarray:
    """Bigram counts of the words as a chain shows them; of the words themselves without a chain."""
    if chain is None:
        return _counted(Counter(words))
    listed, made = list(words), Counter()
    for w, g in zip(listed, garble_all(listed, chain), strict=True):
        if g is not None and g != w and " " not in g and "\n" not in g:
            made[g] += words[w]
    return _counted(made)


#: What is counted, as a row of tables: bigrams of the words themselves, of their garbled forms by chain, character triples, pairs, byte steps.
_SIZES = [_BINS] * (1 + len(CHAINS)) + [_CHAR_BINS, _CHAR_BINS, 256 * 256]
#: Characters of words counted at once.
_COUNTED_AT_ONCE = 1 << 17


def _count(words: dict[str, int], into: list[np.ndarray]) -> list[np.ndarray]:
    """Add what the words count to the tables of _SIZES."""
    part, size = {}, 0
    for w, n in words.items():
        part[w] = n
        size += len(w)
        if size >= _COUNTED_AT_ONCE:
            _count_part(part, into)
            part, size = {}, 0
    if part:
        _count_part(part, into)
    return into


@lru_cache(None)
def _shown(chain: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a chain that reads one-byte charsets shows each byte, in UTF-8: first bytes, last bytes, and rows (byte shown, a, b) of the bigrams within."""
    shown = [garble(ch, chain[1:]).encode() for ch in _char_of(chain[0][1])]
    within = [(byte, *ab) for byte, s in enumerate(shown) for ab in zip(s, s[1:], strict=False)]
    return np.array([s[0] for s in shown]), np.array([s[-1] for s in shown]), np.array(within)


def _count_shown(pairs: np.ndarray, chain: tuple[tuple[str, str], ...]) -> np.ndarray:
    """Bigram counts of what a chain that reads one-byte charsets shows, from the counts of pairs of the bytes first written."""
    first, last, within = _shown(chain)
    at = np.flatnonzero(pairs)
    each = np.bincount(at >> 8, pairs[at], 256)
    bins, counts = _pair_bins(np.append(last[at >> 8], within[:, 1]), np.append(first[at & 255], within[:, 2]))
    return np.bincount(bins[counts], np.append(pairs[at], each[within[:, 0]])[counts], _BINS)


def _count_part(words: dict[str, int], into: list[np.ndarray]) -> None:
    """As _count_chain() of every chain, but words are written once a charset, and what one-byte charsets make of the bytes follows from their pairs."""
    into[0] += _count_chain(words, None)
    for written in dict.fromkeys(c[0][0] for c in CHAINS):
        one_byte, raws, n = written not in MANY_BYTES, [], []
        for w, times in words.items():
            if one_byte and _CONTROL.search(w):  # as in garble_all()
                continue
            try:
                raws.append(w.encode(written))
            except UnicodeEncodeError:
                continue
            n.append(times)
        raw = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
        pair = raw[:-1].astype(np.int64) * 256 + raw[1:]
        owner, weight = np.minimum(np.cumsum(raw == 32)[:-1] - 1, len(n) - 1), np.array(n, float)
        for k, chain in enumerate(CHAINS, 1):
            read = chain[0][1]
            if chain[0][0] != written or not raws:
                continue
            if read not in ONE_BYTE:
                into[k] += _count_chain(words, chain)
                continue
            times = weight
            if one_byte:  # a word shown as it is counts nothing; more bytes a character always show
                moved = np.array([a != b for a, b in zip(_char_of(written), _char_of(read), strict=True)])
                times = weight * (np.bincount(owner, moved[raw[:-1]], len(n)) > 0)
            into[k] += _count_shown(np.bincount(pair, times[owner], 1 << 16), chain)
    _count_chars(words, *into[-3:])


def _zeros() -> list[np.ndarray]:
    return [np.zeros(n) for n in _SIZES]


def _model(counts: list[np.ndarray] | None) -> Model:
    """The model of the tables of _SIZES; None: nothing to learn from."""
    *chains, triples, pairs, steps = counts or _zeros()
    # every chain starts from the same words, so all share one total: what a chain can't take counts against it
    base, odds = np.log(chains[0] + FLOOR), np.empty((_BINS, len(CHAINS) if counts else 0), np.float32)
    for c in range(odds.shape[1]):
        odds[:, c] = (np.log(chains[c + 1] + FLOOR) - base).astype(np.float16)  # as it is broadcast
    follow = steps.reshape(256, 256) + 0.05
    return Model(odds, triples.astype(np.float32), pairs.astype(np.float32), np.log(follow / follow.sum(1, keepdims=True)))


def fit(texts: list[str]) -> Model:
    """The model of texts, fitted again without what it finds garbled itself."""
    texts = [t for t in texts if t and not t.isascii() and "\ufffd" not in t]
    if not texts:
        return _model(None)
    counts = _count(_words(texts), _zeros())
    first = _model(counts)
    garbled = _count(_words([t for t in texts if first.is_garbled(t)]), _zeros())
    return _model([a - b for a, b in zip(counts, garbled, strict=True)])


def _packed(tables: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One row a table: its bins that aren't empty and their counts, compressed."""
    for k, n in tables:
        at = np.flatnonzero(n)
        cols = [pa.array([k], pa.int32()), *(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (at.astype(np.int32), n[at]))]
        yield pa.RecordBatch.from_arrays(cols, ["k", "bins", "n"])


def _add_packed(table: np.ndarray, bins: bytes, n: bytes) -> None:
    table[np.frombuffer(zlib.decompress(bins), np.int32)] += np.frombuffer(zlib.decompress(n))


_PACKED = "k int, bins binary, n binary"


def _count_on(texts: DataFrame) -> list[np.ndarray] | None:
    """The tables of _SIZES of the words of all texts (column t), None without a word.

    Each distinct word goes to one task; tasks send their tables, of fixed size, to those that add them up by table.
    """
    tasks = 2 * texts.sparkSession.sparkContext.defaultParallelism
    non_ascii = F.filter(F.split("t", r"[ \t\r\n\f\x0B]+"), lambda w: w.rlike(_NON_ASCII))
    words = texts.select(F.explode(non_ascii).alias("w")).groupBy("w").agg(F.count("*").alias("n")).repartition(tasks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for b in batches:
            tables = _count(dict(zip(*(c.to_pylist() for c in b.columns), strict=True)), tables or _zeros())
        yield from _packed(enumerate(tables or []))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            for k, bins, n in zip(*b.columns, strict=True):
                _add_packed(tables.setdefault(k.as_py(), np.zeros(_SIZES[k.as_py()])), bins.as_py(), n.as_py())
        yield from _packed(tables.items())

    rows = words.mapInArrow(count, _PACKED).repartition(tasks, "k").mapInArrow(add, _PACKED).collect()  # one row a table
    tables = _zeros()
    for r in rows:
        _add_packed(tables[r["k"]], r["bins"], r["n"])
    return tables if rows else None


def fit_on(df: DataFrame, text_col: str) -> Model:
    """fit() of all texts of a table."""
    spark = df.sparkSession
    texts = df.select(F.col(text_col).alias("t")).where(F.col("t").rlike(_NON_ASCII) & ~F.contains("t", F.lit("\ufffd")))
    counts = _count_on(texts)
    if counts is None:
        return _model(None)
    first = spark.sparkContext.broadcast(_model(counts))  # fixed size: bins x chains

    def garbled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, found = b.column(0).to_pylist(), []
            for at in range(0, len(held), 256):
                first.value.learn(held[at : at + 256])
                found += map(first.value.is_garbled, held[at : at + 256])
            yield b.filter(pa.array(found, pa.bool_()))

    for table, n in zip(counts, _count_on(spread(texts).mapInArrow(garbled, "t string")) or [], strict=False):
        table -= n
    first.destroy()
    return _model(counts)


OUT = "id long, garbled boolean, written_in string, read_as string, odds double, restored string"


def find_garbled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, garbled, written_in, read_as (the steps of the chain, joined by >), odds, restored, of every row."""
    model = df.sparkSession.sparkContext.broadcast(fit_on(df, text_col))  # fixed size: bins x chains

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts, found = b.column(1).to_pylist(), []
            for at in range(0, len(texts), 256):
                m.learn(texts[at : at + 256])
                found += map(m.repair, texts[at : at + 256])
            steps = [[s for c in f[2] for s in CHAINS[c]] for f in found]
            cols = [
                b.column(0),
                pa.array([f[0] for f in found], pa.bool_()),
                pa.array([">".join(w for w, _ in s) or None for s in steps], pa.string()),
                pa.array([">".join(r for _, r in s) or None for s in steps], pa.string()),
                pa.array([float(f[3]) for f in found], pa.float64()),
                pa.array([f[1] for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "garbled", "written_in", "read_as", "odds", "restored"])

    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, OUT)
