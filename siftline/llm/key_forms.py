"""Visually identical keys brought to one form (problem 5).

Base form: invisible characters dropped, full- and half-width forms at their usual width, every
blank a plain space and none at the ends, letters composed with their marks. Letter case and accents
stay. Then script-aware repair: per token (run of letters) the dominant script is found, letters of
other scripts are replaced by the look-alikes of the dominant one, but only in mixed-script tokens
and only if the repaired key is in the corpus vocabulary (base forms without mixed tokens).

Keys that look the same may still differ after that: the repaired key may not be in the vocabulary,
or a whole token may be written in look-alikes of another script. Only what repair leaves apart goes on: keys
with the same shape (every look-alike letter as its Latin twin) form a class, and the class takes
one form: the most frequent repaired or clean vocabulary form, else the dominant-script repair of its most
frequent key; ties by string order. step tells how a key came to its form: base, repair or shape.

Plan shape: keys are made distinct with a partial aggregate, analysed in one Arrow pass and kept at a
checkpoint. Pairs are made of the distinct keys of a form, in blocks, and only then joined with their rows, so
a key of very many rows costs its own pairs and no more.

Defined cases: key null: no form, no row in forms; key empty, or of blanks and invisible characters only: form ''.
Repeated keys weigh by their number of rows. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.common import checkpoint
from siftline.llm.util import arrow_map, pairs_within

# Letters of the same shape, Cyrillic and Greek beside Latin.
CYRILLIC = dict(zip("АВЕКМНОРСТХЅІЈҮԌԚԜӀаеорсухѕіјһԁԛԝүӏ", "ABEKMHOPCTXSIJYGQWIaeopcyxsijhdqwyl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρυχ", "ABEZHIKMNOPTYXaovpux", strict=True))
LATIN_TWIN = CYRILLIC | GREEK
#: Latin letter -> its twin in the other script.
TO_SCRIPT = {
    "CYRILLIC": {v: k for k, v in reversed(CYRILLIC.items())},
    "GREEK": {v: k for k, v in reversed(GREEK.items())},
    "LATIN": {},
}
# Characters without ink that are not of category Cf.
INVISIBLE = set("͏ᅟᅠㅤﾠ឴឵᠋᠌᠍") | {chr(c) for c in range(0xFE00, 0xFE10)}


@lru_cache(1 << 16)
def _script(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return next((s for s in TO_SCRIPT if name.startswith(s)), "") if ch.isalpha() else ""


@lru_cache(1 << 16)
def _plain(ch: str) -> str:
    cat = unicodedata.category(ch)
    if cat[0] == "Z" or ch in "\t\n\r\v\f\x85":
        return " "
    if cat in ("Cf", "Cc") or ch in INVISIBLE:
        return ""
    wide = unicodedata.decomposition(ch).partition(" ")[0] in ("<wide>", "<narrow>")
    return unicodedata.normalize("NFKC", ch) if wide else ch


def base_form(key: str) -> str:
    """Invisible, width, blank and composition differences removed."""
    if key.isascii() and key.isprintable():
        return key.strip()
    return unicodedata.normalize("NFC", "".join(map(_plain, key))).strip()


def shape(base: str) -> str:
    """The base form with every look-alike letter as its Latin twin; equal for keys that look the same."""
    if base.isascii():
        return base
    return unicodedata.normalize("NFC", "".join(LATIN_TWIN.get(ch, ch) for ch in unicodedata.normalize("NFD", base)))


def repair(base: str) -> tuple[str, bool]:
    """The key with each mixed-script token in its dominant script as far as look-alikes allow; whether any token was mixed.

    Dominant: the script with most letters that have no look-alike, then most letters, then Latin
    before Cyrillic before Greek. A token is changed only if all letters of other scripts have a
    twin in the dominant one.
    """
    if base.isascii():
        return base, False
    out, mixed, token = [], False, []

    def flush() -> None:
        nonlocal mixed
        scripts = Counter(s for ch in token if (s := _script(ch)))
        if len(scripts) > 1:
            mixed = True
            own = Counter(s for ch in token if (s := _script(ch)) and ch not in LATIN_TWIN and not (s == "LATIN" and any(ch in TO_SCRIPT[x] for x in scripts)))
            order = ["LATIN", "CYRILLIC", "GREEK"]
            best = max(scripts, key=lambda s: (own[s], scripts[s], -order.index(s)))
            twins = []
            for ch in token:
                s = _script(ch)
                latin = LATIN_TWIN.get(ch, ch)
                twins.append(ch if s in ("", best) else latin if best == "LATIN" and ch in LATIN_TWIN else TO_SCRIPT[best].get(latin))
            out.append("".join(token) if None in twins else "".join(twins))
        else:
            out.append("".join(token))
        token.clear()

    for ch in unicodedata.normalize("NFD", base):
        if ch.isalpha() or unicodedata.combining(ch):
            token.append(ch)
        else:
            flush()
            out.append(ch)
    flush()
    return unicodedata.normalize("NFC", "".join(out)), mixed


def _forms(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys = batch.column(0).to_pylist()
    bases = [base_form(k) for k in keys]
    fixed = [repair(b) for b in bases]
    cols = [keys, bases, [f for f, _ in fixed], [m for _, m in fixed], [shape(b) for b in bases]]
    types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    arrays = [pa.array(x, t) for x, t in zip(cols, types, strict=True)] + [batch.column(1)]
    return pa.RecordBatch.from_arrays(arrays, ["key", "base", "repaired", "mixed", "shape", "n"])


def key_forms(df: DataFrame, key_col: str = "key") -> DataFrame:
    """key, form, own, shape, repaired, step of each distinct key: own is its form before classes are formed, repaired whether the token repair was taken from the vocabulary."""
    distinct = df.where(F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("key")).agg(F.count("*").alias("n"))
    keys = checkpoint(arrow_map(distinct, _forms, "key string, base string, repaired string, mixed boolean, shape string, n long"))
    vocabulary = keys.where("not mixed").groupBy(F.col("base").alias("repaired")).agg(F.sum("n").alias("n_vocabulary"))
    looked = keys.join(vocabulary, "repaired", "left")  # clean keys find themselves, mixed ones their repair
    taken = F.col("n_vocabulary").isNotNull()
    looked = looked.withColumn("own", F.when(taken, F.col("repaired")).otherwise(F.col("base")))
    rank = F.struct(taken.cast("int").alias("known"), F.coalesce("n_vocabulary", "n").alias("weight"), F.col("repaired").alias("form"))
    best = looked.groupBy("shape").agg(F.max(rank).getField("form").alias("form"))
    step = F.when(F.col("form") != F.col("own"), "shape").when(F.col("mixed") & taken, "repair").otherwise("base")
    return looked.join(best, "shape").select("key", "form", "own", "base", "shape", (F.col("mixed") & taken).alias("repaired"), step.alias("step"))


def unify(df: DataFrame, key_col: str = "key", out_col: str = "key_form") -> DataFrame:
    """df with out_col, the one form of its key (null for a null key)."""
    forms = key_forms(df, key_col).select(F.col("key").alias("_key_in"), F.col("form").alias(out_col))
    return df.join(forms, df[key_col] == forms["_key_in"], "left").drop("_key_in")


def key_pairs(df: DataFrame, key_col: str = "key") -> DataFrame:
    """(a, b, step), a < b, of distinct keys that have one form; step: what made them one, base forms, repair or shape."""
    forms = checkpoint(key_forms(df, key_col).select("key", "form", "own", "base"))
    several = forms.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    hot = checkpoint(forms.join(several, "form", "left_semi"))
    pairs = pairs_within(hot, "form", "key")
    side = lambda x: hot.select(F.col("key").alias(x), F.col("own").alias(f"own_{x}"), F.col("base").alias(f"base_{x}"))
    step = F.when(F.col("base_a") == F.col("base_b"), "base").when(F.col("own_a") == F.col("own_b"), "repair").otherwise("shape")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", step.alias("step"))


def look_alike_pairs(df: DataFrame, id_col: str = "entry_id", key_col: str = "key") -> DataFrame:
    """(a, b, step) of rows whose keys differ in characters but have one form; a < b."""
    pairs = checkpoint(key_pairs(df, key_col))
    side = lambda key, row: df.select(F.col(key_col).alias(key), F.col(id_col).alias(row))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "step")
