import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siftline.llm import distinctive, key_forms, term_counts as tc

MSG = "msg_id string, key string, freq int, bad bigint, good bigint, msgs_bad bigint, msgs_good bigint, term string, record string, sign int"


def counts(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 0) for r in rows], MSG)


ROWS = [
    ("a", "k", 2, 1, 1, 10, 10), ("a", "k", 2, 1, 1, 10, 10), ("b", "k", None, 2, 1, 20, 10), ("c", "k", -3, None, None, None, None), ("a", None, 1, 0, 0, 1, 1), ("d", "", 1, 0, 0, 1, 1), ("a", "z", 1, 0, -5, 1, 1), (None, "z", 9, 0, 0, 1, 1),
]


def test_counts_and_marks(spark):
    store = tc.count_terms(counts(spark, ROWS))
    got = {r["term"]: (r["occurrences"], r["records"], r["bad"], r["good"], r["mark"]) for r in tc.marked(store).collect()}
    assert got == {"k": (2, 3, 2, 1, "common"), "z": (1, 1, 0, 0, "rare")}
    assert store.totals().first()["records"] == 4
    assert tc.marked(tc.count_terms(counts(spark, []))).count() == 0


def test_loading_in_parts_equals_loading_at_once(spark):
    rows = lambda s: sorted(map(tuple, s.counts().collect()))
    df = counts(spark, ROWS)
    store = tc.load_and_update(df, F.col("msg_id") < "b")
    assert rows(store) == rows(tc.count_terms(df)) and len(store._generations()) == 2 and store.totals().first()["records"] == 4


def test_exact_share_is_not_common(spark):
    rows = [(f"m{k}", "k" if k < 4 else "other", 1, 0, 0, 1, 1) for k in range(10)]
    assert {r["term"]: r["mark"] for r in tc.marked(tc.count_terms(counts(spark, rows)), rare_below=1).collect()} == {"k": None, "other": "common"}


@settings(max_examples=4, deadline=None)
@given(*[st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["k", "l", "m"]), st.integers(0, 3), st.integers(1, 4)), max_size=10)] * 2)
def test_deltas_equal_counting_anew(spark, before, after):
    full = lambda rows: tc.record_terms(counts(spark, [(m, k, n, t, 2 * t, 5 * t, 5) for m, k, n, t in rows]))
    old, new = full(before), full(after)
    store = tc.TermStore(spark, tc.fresh_dir(spark, "t"), 2).apply(tc.signed_changes(None, old))
    store.apply(tc.signed_changes(old, new))
    want = tc.TermStore(spark, tc.fresh_dir(spark, "t"), 2).apply(tc.signed_changes(None, new))
    rows = lambda s: sorted((r["term"], r["occurrences"], r["records"], r["bad"], r["good"]) for r in s.counts().collect())
    expected = rows(want)
    assert rows(store) == expected
    assert store.totals().first()["records"] == want.totals().first()["records"]
    assert rows(store.compact()) == expected and len(store._generations()) == 1


def test_counts_of_a_deleted_record_leave_with_it(spark):
    old = tc.record_terms(counts(spark, [("a", "k", 1, 9, 9, 90, 90), ("b", "k", 1, 1, 1, 5, 5)]))
    new = tc.record_terms(counts(spark, [("b", "k", 1, 1, 1, 5, 5)]))
    store = tc.TermStore(spark, tc.fresh_dir(spark, "t"), 2).apply(tc.signed_changes(None, old))
    assert tuple(store.counts().first()) == ("k", 2, 2, 9, 9)
    store.apply(tc.signed_changes(old, new, spark.createDataFrame([("a",)], "record string")))
    assert tuple(store.counts().first()) == ("k", 1, 1, 1, 1)
    assert tc.TermStore(spark, store.path).buckets == 2 and tc.signed_changes(new, new).count() == 0


WORDS = "entry_id bigint, key string, form string, shape string"


def pairs(spark, keys):
    df = spark.createDataFrame([(k + 1, w, "x", "y") for k, w in enumerate(keys)], WORDS)
    return sorted((r["a"], r["b"]) for r in key_forms.look_alike_pairs(df).collect())


def test_what_looks_the_same(spark):
    assert pairs(spark, ["free", "fr\u0435e", "\uff46\uff52\uff45\uff45", "fr\u200bee", " free\u00a0", "Free", "fr\u00e9e", "fre\u0301e", "free"]) == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (2, 9), (3, 4), (3, 5), (3, 9), (4, 5), (4, 9), (5, 9), (7, 8)]
    assert pairs(spark, ["a b", "a\u00a0b", "a\u2007b", "ab"]) == [(1, 2), (1, 3), (2, 3)]
    assert pairs(spark, ["\u0441\u043e\u0440", "cop", "\u0421\u041e\u0420"]) == [(1, 2)]  # whole words in another script
    assert pairs(spark, ["na\u0457ve", "na\u00efve", "h\u03bfst", "host", "hst"]) == [(1, 2), (3, 4)]
    assert pairs(spark, ["\u0449\u0443\u0442\u0430\u0431o\u0434o", "\u0449\u0443\u0442\u0430\u0431\u043e\u0434\u043e"]) == [(1, 2)]


def test_what_made_keys_one(spark):
    df = spark.createDataFrame([(k, w, "x", "y") for k, w in enumerate(["host", "h\u043est", "\uff48ost", "\u0441\u043e\u0440", "cop", "cop"])], WORDS)
    assert {(r["a"], r["b"]): r["step"] for r in key_forms.key_pairs(df).collect()} == {("host", "h\u043est"): "repair", ("host", "\uff48ost"): "base", ("h\u043est", "\uff48ost"): "repair", ("cop", "\u0441\u043e\u0440"): "shape"}


def test_key_edge_cases(spark):
    assert pairs(spark, []) == [] and pairs(spark, [None, None, "a", "a"]) == []
    assert pairs(spark, ["", " ", "\u200b"]) == [(1, 2), (1, 3), (2, 3)]
    long = "x" * 60_000
    assert pairs(spark, [long, long + "\u200d"]) == [(1, 2)]


def test_mixed_tokens_take_the_vocabulary_form(spark):
    df = spark.createDataFrame([(k, w, "", "") for k, w in enumerate(["host", "host", "h\u043est", "subj:h\u043est", "x\u043e"])], WORDS)
    f = {r["key"]: (r["form"], r["repaired"]) for r in key_forms.key_forms(df).collect()}
    assert f["h\u043est"] == ("host", True) and f["subj:h\u043est"] == ("subj:host", False) and f["x\u043e"][0] == "xo"
    assert {r["entry_id"]: r["key_form"] for r in key_forms.unify(df.select("entry_id", "key")).collect()}[2] == "host"


def test_blocks_meet_every_pair_once(spark):
    from siftline.llm.util import pairs_within

    df = spark.range(60).select(F.lit(1).alias("g"), F.col("id").alias("r"))
    got = [tuple(r) for r in pairs_within(df, "g", "r", block=7).collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2


def exact_own_model(freq, background, own):
    """The fixed point by its closed form: terms kept are those with the largest freq / background."""
    order = sorted(range(len(freq)), key=lambda i: -freq[i] / background[i])
    ratio, best = (1 - own) / own, None
    for k in range(1, len(order) + 1):
        kept = order[:k]
        mass = (1 + ratio * sum(background[i] for i in kept)) / sum(freq[i] for i in kept)
        p = {i: freq[i] * mass - ratio * background[i] for i in kept}
        if min(p.values()) > 0:
            best = p
    return [best.get(i, 0.0) for i in range(len(freq))]


def test_em_converges_to_the_closed_form():
    rng = np.random.default_rng(3)
    freq, background = rng.integers(1, 6, 40).astype(float), rng.random(40) / 200
    p = distinctive.mixture_em(freq, background, np.array([0]), 0.1, 3000)
    assert p == pytest.approx(exact_own_model(freq, background, 0.1), abs=1e-4)


def test_common_terms_count_little_and_edge_cases(spark):
    rows = [("a", "the", 3, 900, 900, 1000, 1000), ("a", "rare", 1, 3, 2, 1000, 1000), ("a", "rare", 1, 3, 2, 1000, 1000), ("a", "new", None, 0, 0, None, None), ("b", "the", 1, -1, None, 1000, 1000), (None, "x", 1, 1, 1, 1, 1), ("b", None, 1, 1, 1, 1, 1), ("b", "", 1, 1, 1, 1, 1)]
    got = {(r["record"], r["term"]): r["score"] for r in distinctive.distinctiveness(counts(spark, rows)).collect()}
    assert set(got) == {("a", "the"), ("a", "rare"), ("a", "new"), ("b", "the")}
    assert got["a", "the"] < 0.01 < got["a", "rare"] and got["b", "the"] == pytest.approx(1.0)
    assert math.fsum(v for (r, _), v in got.items() if r == "a") == pytest.approx(1.0)
    assert distinctive.distinctiveness(counts(spark, [])).count() == 0


def test_long_records_take_the_spread_way(spark):
    rows = [("a", f"t{k}", 1 + k % 3, k, k, 100, 100) for k in range(30)] + [("b", "t1", 1, 1, 1, 100, 100)]
    key = lambda df: {(r["record"], r["term"]): r["score"] for r in df.collect()}
    one = key(distinctive.distinctiveness(counts(spark, rows), iterations=5))
    two = key(distinctive.distinctiveness(counts(spark, rows), iterations=5, stream_terms=10))
    assert one.keys() == two.keys() and all(two[k] == pytest.approx(v, rel=1e-9, abs=1e-15) for k, v in one.items())
