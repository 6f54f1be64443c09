import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siftline.operators import delivery_dedup as d

SCHEMA = "msg_id string, message_id string, producer string, seq string"  # extra columns with clashing names


def run(spark, rows, seen=None):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)
    return d.accept(df, seen)


def ids(df):
    return sorted(r["delivery_id"] for r in df.collect())


def test_spellings_are_one_identifier(spark):
    same = ["<20080108.30030950565158.qm@mail.a.example>", "< 20080108.30030950565158.qm@MAIL.a.Example >", "\n\t20080108.30030950565158.qm@mail.A.example ", "<20080108.30030950565158.qm@mail.a.example> (added by x.y)", "20080108.30030950565158.qm@mail.a.example (added by x)"]
    o = run(spark, [(f"m{k}", s) for k, s in enumerate(same)])
    assert ids(o.accepted) == ["m0"] and ids(o.duplicates) == ["m1", "m2", "m3", "m4"]


def test_local_part_keeps_its_case(spark):
    o = run(spark, [("a", "<Roken97.167962E2194F@h.test>"), ("b", "<rOKEN97.167962e2194f@h.test>"), ("c", "<Roken97.167962E2194F@H.TEST>")])
    assert ids(o.duplicates) == ["c"]


def test_absent_and_empty_identifiers_are_shared_by_nobody(spark):
    o = run(spark, [("a", None), ("b", ""), ("c", "<>"), ("d", "< >"), ("e", " "), ("f", None)])
    assert ids(o.duplicates) == [] and len(ids(o.accepted)) == 6


def test_malformed_identifiers_by_exact_lookup(spark):
    o = run(spark, [("b", "<odd>"), ("a", "odd"), ("c", "<x{d9}.123456789@h>"), ("d", "<x{d9}.123456789@H>")])
    assert ids(o.duplicates) == ["b", "d"]


def test_nulls_repeats_and_empty_table(spark):
    o = run(spark, [(None, "<1234567890@h>"), ("a", "<1234567890@h>"), ("b", "<zz@h>"), ("b", "<zz@h>")])
    assert ids(o.accepted) == ["", "b"] and ids(o.duplicates) == ["a"]
    o = run(spark, [])
    assert ids(o.accepted) == [] and o.seen.ranges.count() == 0


def test_ranges_merge_and_later_batches_are_covered(spark):
    ident = lambda n: f"<10.{100000000 + n}.q@h>"
    first = run(spark, [(f"a{n}", ident(n)) for n in (1, 2, 3, 5, 6, 65536 * 3)])
    ranges = sorted((r["lo"] - 100000000, r["hi"] - 100000000) for r in first.seen.ranges.collect())
    assert ranges == [(1, 3), (5, 6), (65536 * 3, 65536 * 3)]
    second = run(spark, [("b3", ident(3)), ("b4", ident(4)), ("b7", ident(7)), ("c4", ident(4))], first.seen)
    assert ids(second.accepted) == ["b4", "b7"] and ids(second.duplicates) == ["b3", "c4"]
    assert sorted((r["lo"] - 100000000, r["hi"] - 100000000) for r in second.seen.ranges.collect())[0] == (1, 7)


def test_leading_zeros_and_width_matter(spark):
    o = run(spark, [("a", "<1.000123456789@h>"), ("b", "<1.0123456789@h>"), ("c", "<1.0123456789@h>")])
    assert ids(o.duplicates) == ["c"]


def test_very_long_identifier(spark):
    long = "<" + "x" * 50_000 + "@h>"
    assert ids(run(spark, [("a", long), ("b", long)]).duplicates) == ["b"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "q"]), st.integers(0, 12)), min_size=1, max_size=25), st.integers(1, 3))
def test_batches_in_any_cut_accept_each_number_once(spark, items, cuts):
    rows = [(f"m{k:03d}", f"<{p}.{900000000 + n}@h>") for k, (p, n) in enumerate(items)]
    seen, kept = None, []
    for c in range(cuts):
        o = run(spark, rows[c::cuts], seen)
        seen = d.Seen(spark.createDataFrame(o.seen.ranges.collect(), d.RANGE_SCHEMA), spark.createDataFrame(o.seen.exact.collect(), d.EXACT_SCHEMA))
        kept += ids(o.accepted)
    assert len(kept) == len(set(items))
    # a producer is the host: p and q share its numbers, and their identifiers are told apart by the exact lookup
    assert seen.ranges.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] == len({n for _, n in items})


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_folded_batches_keep_the_smallest_id_wherever_they_are_cut(spark, batches):
    rows = [(f"m{k:03d}", f"<{'pq'[k % 2]}.{500 + k % 7}@h>" if k % 5 else None) for k in range(60)]
    o = d.fold(spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA), batches)
    first = {}
    for m, i in rows:
        first.setdefault(i, m)
    assert ids(o.duplicates) == sorted(m for m, i in rows if i and first[i] != m)
    assert ids(o.accepted) == sorted(m for m, i in rows if not i or first[i] == m)
    assert [(r["lo"], r["hi"]) for r in o.seen.ranges.collect()] == [(500, 506)]


def test_the_number_is_the_longest_field(spark):
    got = lambda s: spark.createDataFrame([(s,)], "i string").select(d.split_sequence(F.col("i")).alias("p")).first()["p"]
    assert tuple(got("20190509.27005162095118.qm@h")) == ("d@h", 27005162095118)
    assert tuple(got("Name87.0C509EEF5AB0@h")) == ("X@h", 0x0C509EEF5AB0) and tuple(got("7.beef@h")) == ("d@h", 7)
    assert got("plain@h") is None and got("9999999999999999999@h") is None
