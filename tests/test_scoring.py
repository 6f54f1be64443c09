import dataclasses
import random
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.functions.prob import gamma_tail, poisson_tail, upper_gamma
from siftline.operators import score, stats, tokenize, tune, wordlist
from siftline.params import Params, parse

WORDS = ["ignore", "common", "user_low", "system_hi", "word_low", "word_hi", "user_hi", "system_low", "message"]
LISTS = (
    [("ignore", w, 0, 0) for w in ("ignore", "user_low", "system_hi")]
    + [("word", "ignore", 2, 7), ("word", "common", 2, 7), ("word", "word_low", 2, 7), ("word", "word_hi", 7, 2)]
    + [("usr", "ignore", 2, 8), ("usr", "common", 2, 8), ("usr", "user_low", 2, 8), ("usr", "user_hi", 8, 2)]
    + [("sys", "ignore", 2, 9), ("sys", "common", 2, 9), ("sys", "system_low", 2, 9), ("sys", "system_hi", 9, 2)]
)
# Scores of the reference tests (used tokens, P, Q, S).
GOLDEN = [
    ([("r", "word", 1)], (4, 0.807830, 0.300917, 0.246543)),
    ([("i", "ignore", 1), ("r", "word", 2)], (3, 0.675071, 0.368576, 0.346753)),
    ([("i", "ignore", 4), ("r", "usr", 5), ("r", "sys", 6)], (3, 0.671278, 0.305897, 0.317310)),
    ([("r", "usr", 7), ("r", "sys", 7)], (6, 0.760046, 0.294759, 0.267356)),
]


@pytest.mark.parametrize("registry,want", GOLDEN)
def test_golden_multiple_lists(spark, registry, want):
    tokens = spark.createDataFrame([("m", w) for w in WORDS], "id string, token string")
    lists = spark.createDataFrame(LISTS, "list_name string, token string, spam int, good int")
    totals = spark.createDataFrame([("word", 1, 1), ("usr", 1, 1), ("sys", 10, 10)], "list_name string, msgs_spam int, msgs_good int")
    reg = spark.createDataFrame(registry, "list_type string, list_name string, priority int")
    p = Params(min_dev=0.1)
    r = score.scores(score.rated(wordlist.combined_lists(tokens, lists, reg, totals), p), p).first()
    assert (r["n_used"], round(r["p_value"], 6), round(r["q_value"], 6), round(r["spamicity"], 6)) == want


# Tokens of the reference's token-count test as (token, good of 48, bad of 21).
COUNTS = """there 14 0,zip 1 0,all 19 2,web 9 1,too 8 1,been 7 1,file 5 1,also 9 2,about 13 3,little 4 1,any 15 5,would 11 4,visit 2 1,does 6 3,for 32 17,how 9 5,
name 5 3,new 7 5,this 26 19,home 5 4,over 5 5,way 5 6,visiting 0 1,dealer 0 2,agree 0 3"""


@pytest.mark.parametrize("p,want", [(Params(min_dev=0.496), (2, 0.019431, 0.005482, 0.493025)), (Params(min_dev=0.496, token_count_min=4), (4, 0.000085, 0.065746, 0.532831)), (Params(min_dev=0.496, token_count_max=8), (2, 0.019431, 0.005482, 0.493025))])
def test_golden_token_counts(spark, p, want):
    rows = [("m", w.split()[0], int(w.split()[1]), int(w.split()[2]), 48, 21) for w in COUNTS.replace("\n", "").split(",")]
    df = spark.createDataFrame(rows, "id string, token string, good bigint, bad bigint, msgs_good bigint, msgs_bad bigint")
    r = score.scores(score.rated(df, p), p).first()
    assert (r["n_used"], round(r["p_value"], 6), round(r["q_value"], 6), round(r["spamicity"], 6)) == want


def test_ties_are_kept_by_token_limits(spark):
    rows = [("m", t, 0, b, 10, 10) for t, b in (("a", 5), ("b", 5), ("c", 5), ("d", 1))]
    df = spark.createDataFrame(rows, "id string, token string, good bigint, bad bigint, msgs_good bigint, msgs_bad bigint")
    used = score.rated(df, Params(token_count_fix=2)).where("used")
    assert sorted(r["token"] for r in used.collect()) == ["a", "b", "c"]


def test_unknown_tokens_only(spark):
    df = spark.createDataFrame([("m", "x", 0, 0, 0, 0)], "id string, token string, good bigint, bad bigint, msgs_good bigint, msgs_bad bigint")
    r = score.scores(score.rated(df, Params()), Params()).first()
    assert r["spamicity"] == 0.52 and r["status"] == "Unsure" and r["n_used"] == 0


def test_chi_square_tail(spark):
    cases = [(0.0, 3), (1.5, 1), (2.258, 4), (700.0, 300), (2000.0, 50), (5.0, 900)]
    got = [r[0] for r in spark.createDataFrame(cases, "y double, n bigint").select(poisson_tail(F.col("y"), F.col("n"))).collect()]
    for (y, n), g in zip(cases, got, strict=True):
        want = math.fsum(math.exp(-y + k * math.log(y) - math.lgamma(k + 1)) for k in range(n)) if y else 1.0
        assert g == pytest.approx(min(want, 1.0) if want > 2.3e-16 else 0.0, rel=1e-9, abs=1e-15)
        assert upper_gamma(np.array([float(n)]), np.array([y]))[0] == pytest.approx(min(want, 1.0), rel=1e-9, abs=1e-14)
    half = spark.createDataFrame([(0.5, 1.0)], "a double, x double").select(gamma_tail("a", "x")).first()[0]
    assert half == pytest.approx(math.erfc(1.0), rel=1e-12)


def test_register_unregister_identity_and_clamp(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "id int, token string")
    labels = spark.createDataFrame([(1, True), (2, False), (3, False)], "id int, is_spam boolean")
    table = wordlist.register(tokens, labels)
    assert sorted(map(tuple, table.collect())) == [("a", 1, 1), ("b", 1, 0), ("c", 0, 1)]
    assert wordlist.apply_counts(table, table, -1, -1).count() == 0
    twice = wordlist.apply_counts(wordlist.apply_counts(table, table, -1, -1), table, -1, -1)
    assert twice.count() == 0
    assert wordlist.register(tokens.limit(0), labels).count() == 0


def test_expire_needs_every_limit(spark):
    t = spark.createDataFrame([("a", 1, 1, 20200101), ("bbbb", 1, 0, 20250101), ("cccc", 9, 0, 20200101), (".META", 0, 0, 0)], "token string, spam int, good int, date int")
    keep = lambda **k: sorted(r["token"] for r in wordlist.expire(t, **k).collect())
    assert keep(count=2) == [".META", "cccc"]
    assert keep(count=2, age=20240101) == [".META", "bbbb", "cccc"]
    assert keep(size=(2, 10)) == [".META", "bbbb", "cccc"]
    assert keep() == [".META", "a", "bbbb", "cccc"]


def test_fold_and_upgrade(spark):
    t = spark.createDataFrame([("für", 1, 0, 1), ("f??r", 2, 1, 5), ("url:1.2.3.4", 1, 1, 1)], "token string, spam int, good int, date int")
    folded = {r["token"]: (r["spam"], r["good"], r["date"]) for r in wordlist.rekey(t, wordlist.fold_nonascii(F.col("token"))).collect()}
    assert folded == {"f??r": (3, 1, 5), "url:1.2.3.4": (1, 1, 1)}
    assert "ip:1.2.3.4" in [r["token"] for r in wordlist.upgrade_prefix(t).collect()]


def test_two_state_and_params():
    p = parse(["# x", "Spam-Cutoff = 0.6 # y", "ham_cutoff=0", "robx=0", "unknown=3"])
    assert p.spam_cutoff == 0.6 and p.ham_cutoff == 0 and p.robx == 0.52
    with pytest.raises(ValueError):
        Params(token_count_fix=3, token_count_min=2)


def test_histogram_and_robx(spark):
    t = spark.createDataFrame([("a", 10, 0), ("b", 0, 10), ("c", 5, 5), ("d", 1, 0), (".M", 50, 50)], "token string, spam bigint, good bigint")
    r = stats.robx(t, 10, 10).first()
    assert r["n"] == 3 and r["robx"] == pytest.approx(0.5)
    h = stats.wordlist_histogram(t, F.col("spam") / (F.col("spam") + F.col("good")))
    assert h.count() == 20 and h.agg(F.sum("count")).first()[0] == 4
    assert stats.wordlist_histogram(t.limit(0), F.lit(0.5)).agg(F.sum("count")).first()[0] == 0
    assert stats.hapaxes(t).first()["spam_hapax"] == 1


def test_tuning_pieces(spark):
    assert len(tune.coarse_grid(0.52).cells()) == 2940
    assert tune.values("robs") == (1.0, 0.1, 0.01) and tune.values("robx", 0.7) == pytest.approx((0.6, 0.55, 0.5))
    fine = tune.fine_grid(Params(robs=0.01, min_dev=0.45, robx=0.41), 2.0, 20.0)
    assert fine.robs == pytest.approx((10**-1.5, 10**-1.75, 0.01)) and max(fine.min_dev) < 0.499 and fine.ns_exp == (18.5, 19.0, 19.5, 20.0)
    assert [tune.target_of(n) for n in (550, 2118, 12645, 70814)] == [1, 9, 17, 22]
    assert [round(tune.train_share(n), 3) for n in (0, 2500, 3250, 4000, 10**9)] == [0.8, 0.8, round(2.5 / 3.5, 3), 0.5, 0.5]
    scores = lambda top, n: spark.createDataFrame([(float(x),) for x in top + [0.0] * (n - len(top))], "spamicity double")
    assert tune.threshold(scores([0.99, 0.9, 0.6, 0.5], 1000)) == (3, 0.6)
    assert tune.threshold(scores([0.99] * 12, 1000)) == (12, 0.975) and tune.threshold(scores([], 0))[0] == 1
    assert stats.prior_checks(10, 10, 1, 1) and not stats.prior_checks(3000, 3000, 600, 600)


def test_grid_scan_equals_scoring_cell_by_cell(spark):
    rng = random.Random(4)
    rows = [(f"m{k}", rng.randrange(40), rng.randrange(40), 100, 80) for k in range(60) for _ in range(rng.randrange(1, 30))]
    counted = spark.createDataFrame(rows, "id string, good bigint, bad bigint, msgs_good bigint, msgs_bad bigint")
    labels = spark.createDataFrame([(f"m{k}", k % 3 == 0) for k in range(60)], "id string, is_spam boolean")
    grid = tune.Grid((1.0, 0.01), (0.05, 0.3), (0.5,), (0.0, 2.0), (5.0,))
    together = tune.by_message(counted, labels)
    got = {(r["idx"], r["id"]): r["spamicity"] for r in tune.grid_scores(together, grid).collect()}
    for idx, _, p in grid.cells():
        q = dataclasses.replace(p, sp_esf=p.sp_esf if p.sp_esf < 1 else 1 - 1e-15)  # the tuner always divides
        for r in score.scores(score.rated(counted.withColumn("token", F.monotonically_increasing_id()), q), q).collect():
            assert got[idx, r["id"]] == pytest.approx(r["spamicity"], abs=1e-8)
    for r in tune.grid_results(together, grid, 3).collect():
        good = sorted((s for (i, m), s in got.items() if i == r["idx"] and int(m[1:]) % 3), reverse=True)
        k = next(k for k in range(3, len(good)) if good[k - 1] < 0.999999)
        assert (r["fp"], r["cutoff"]) == (k, good[k - 1])
        assert r["fn"] == sum(s < r["cutoff"] for (i, m), s in got.items() if i == r["idx"] and int(m[1:]) % 3 == 0)


def test_messages_go_on_over_batches():
    import pyarrow as pa

    t = pa.table({"id": [1] * 5 + [2] * 4 + [3], "is_spam": [True] * 5 + [False] * 5, "good": [1, 5, 9, 0, 2, 7, 7, 3, 1, 0], "bad": [9, 1, 0, 4, 2, 1, 0, 3, 8, 0], "msgs_good": [10] * 10, "msgs_bad": [10] * 10})
    grid = tune.Grid((0.1,), (0.1, 0.2), (0.5,), (0.0,), (3.0,))
    whole = [(i, s[:, k].tolist()) for ids, _, s in tune.scored_messages(t.to_batches(), grid) for k, i in enumerate(ids)]
    for size in (1, 2, 3):
        cut = [(i, s[:, k].tolist()) for ids, _, s in tune.scored_messages(t.to_batches(size), grid) for k, i in enumerate(ids)]
        assert [i for i, _ in cut] == [1, 2, 3] and all(a == pytest.approx(b) for (_, a), (_, b) in zip(cut, whole))


def test_message_histogram_has_every_bin(spark):
    rows = [("m", "a", 0.05, True), ("m", "b", 0.95, True), ("m", "c", 1.0, True), ("n", "a", 0.5, False)]
    df = spark.createDataFrame(rows, "id string, token string, fw double, used boolean")
    out = score.message_histogram(df, Params()).collect()
    assert len(out) == 20 and sum(r["cnt"] for r in out if r["id"] == "m") == 2
    assert all(r["spamicity"] == 0.52 for r in out if r["id"] == "n")


def test_tokens_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ab abc $5 $12.50 1.2.3.4 255.1.2.300 x" + "y" * 40), (4, "don't foo-bar. a.b.c_d_ für")], "id int, text string")
    got: dict = {}
    for r in tokenize.tokens(df, "id", "text", distinct=False).collect():
        got.setdefault(r["id"], []).append(r["token"])
    assert got[3] == ["abc", "$5", "$12.50", "1.2.3.4", "255.1.2.30"]
    assert got[4] == ["don't", "foo-bar", "a.b.c_d", "für"] and set(got) == {3, 4}


# N-gram sequences of the reference's test text.
def test_golden_ngrams(spark):
    df = spark.createDataFrame([(1, "aaa\nbbb ccc\nddd eee fff")], "id int, text string")
    rows = tokenize.line_ngrams(df, "id", "text", 3).orderBy("line", "pos", "size").collect()
    assert [r["gram"] for r in rows] == ["aaa", "bbb", "ccc", "bbb*ccc", "ddd", "eee", "ddd*eee", "fff", "eee*fff", "ddd*eee*fff"]


def test_golden_subnets(spark):
    df = spark.createDataFrame([("192.168.1.2",), ("word",)], "t string")
    assert [r[0] for r in df.select(tokenize.subnets(F.col("t"))).collect()] == [["192.168.1.2", "192.168.1", "192.168", "192"], ["word"]]


def test_header_tokens(spark):
    raw = "From: Joe <joe@a.example>\nTo: list@b.example\nCC: me\nMessage-ID: <abc@d>\nX-Mailer: Fancy Mailer\nReceived: from h.test ([10.0.0.1]) by x.test\n\tid ABC123; now\nSubject: Hello\n  folded World\nX-Bogosity: Spam, tests=x\n  more\n\nbody here\n"
    df = spark.createDataFrame([("m", raw), ("n", None), ("o", "")], "id string, raw string")
    got = sorted({r["token"] for r in tokenize.header_tokens(df, "id", "raw").collect()})
    assert got == sorted(["from:Joe", "from:joe", "from:a.example", "to:list", "to:b.example", "head:Message-ID", "head:X-Mailer", "head:Fancy", "head:Mailer", "rcvd:from", "rcvd:h.test", "ip:10.0.0.1", "rcvd:x.test", "rcvd:now", "subj:Hello", "subj:folded", "subj:World"])
    a = {r["id"]: r for r in tokenize.attributes(df, "id", "raw").collect()}
    assert (a["m"]["message_addr"], a["m"]["message_id"], a["m"]["queue_id"]) == ("10.0.0.1", "<abc@d>", "ABC123")
    assert a["n"]["queue_id"] is None


def test_verp(spark):
    df = spark.createDataFrame([("list-return-12345-joe=a.org@b.org",), ("joe@a.org",)], "t string")
    assert [r[0] for r in df.select(tokenize.normalise_verp(F.col("t"))).collect()] == ["list-#-joe=a.org@b.org", "joe@a.org"]


def test_order_statistics(spark):
    values = [0.0, 1.0, 0.5, 0.5, 0.25, 0.999999999, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "spamicity double")
    assert tune.order_statistics(df, [1, 2, 3, 4, 5, 7]) == [1.0, 1.0, 0.999999999, 0.5, 0.5, 0.0]


def test_header_that_ends_in_blanks(spark):
    df = spark.createDataFrame([("a", "To: x\n \t\nbody text\n"), ("b", "To: x\n\nbody\n \n"), ("c", None)], "id string, raw string")
    got = {(r["id"], r["token"]) for r in tokenize.message_tokens(df, "id", "raw").collect()}
    assert {i for i, t in got if t == tokenize.BAD_HEADER_END} == {"a"}


def test_split_for_tuning_is_stable_and_proportional(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2 == 0).alias("is_spam"))
    one, two = tune.split_for_tuning(df, 2000, 2000), tune.split_for_tuning(df.repartition(7), 2000, 2000)
    assert one.exceptAll(two).isEmpty()
    n = {(r["role"], r["bin"]): r["count"] for r in one.groupBy("role", "bin").count().collect()}
    assert len(n) == 6 and 0.76 < sum(v for (role, _), v in n.items() if role == "train") / 4000 < 0.84
    assert tune.split_for_tuning(df.limit(0), 0, 0).count() == 0


def test_train_on_error_registers_only_what_it_gets_wrong(spark):
    from siftline.operators.train import train_on_error

    tokens = spark.createDataFrame([(k, t) for k in range(40) for t in (("pills", f"w{k}") if k % 2 else ("meeting", f"w{k}"))], "id bigint, token string")
    labels = spark.createDataFrame([(k, bool(k % 2)) for k in range(40)], "id bigint, is_spam boolean")
    p = Params(spam_cutoff=0.9, ham_cutoff=0.1)
    table = {r["token"]: (r["spam"], r["good"]) for r in train_on_error(tokens, labels, p, rounds=3, parts=4).collect()}
    assert 0 < table["pills"][0] < 20 and table["pills"][1] == 0 and 0 < table["meeting"][1] < 20
    assert train_on_error(tokens.limit(0), labels.limit(0), p, rounds=1, parts=2).count() == 0


def test_long_lists_are_met_by_head_and_shuffle(spark):
    tokens = spark.createDataFrame([(k, t) for k in range(20) for t in ("the", f"w{k % 7}", "unknown")], "id bigint, token string")
    table = spark.createDataFrame([("the", 90, 80), *[(f"w{k}", k, 1) for k in range(7)]], "token string, good bigint, spam bigint")
    rows = lambda df: sorted((r["id"], r["token"], r["good"], r["bad"]) for r in df.collect())
    assert rows(score.with_counts(tokens, table, 9, 9, size=1)) == rows(score.with_counts(tokens, table, 9, 9, size=1 << 40, head=2))


def test_raw_keys_become_text(spark):
    rows = [("caf\u00c3\u00a9", 1, 2, 20200101), ("caf\u00e9", 3, 4, 20210101), ("\u00e9\u0448", 1, 0, 1), (".ENCODING", 1, 0, 5), ("plain", 1, 1, 1)]
    t = spark.createDataFrame(rows, "token string, spam bigint, good bigint, date int")
    got = {r["token"]: (r["spam"], r["good"], r["date"]) for r in wordlist.convert_encoding(t).collect()}
    assert got == {"caf\u00e9": (4, 6, 20210101), "\u00e9\u0448": (1, 0, 1), "plain": (1, 1, 1), ".ENCODING": (2, 0, 20210101)}
    assert spark.createDataFrame([("\u00ef\u00f0",)], "t string").select(wordlist.recoded(F.col("t"), "windows-1251")).first()[0] == "\u043f\u0440"


def test_running_sums_over_partitions(spark):
    from siftline.common import running_before

    rows = [("hot", k, k % 5) for k in range(300)] + [("b", 7, 1), ("b", 9, None), (None, 1, 4), (None, 2, 4)]
    df = spark.createDataFrame(rows, "g string, at int, v int").repartition(7)
    got = {(r["g"], r["at"]): (r["before"], r["n"]) for r in running_before(df, "g", ["at"], {"before": F.col("v"), "n": F.lit(1)}).collect()}
    assert got["hot", 0] == (0, 0) and all(got["hot", k] == (sum(x % 5 for x in range(k)), k) for k in range(300))
    assert got["b", 9] == (1, 1) and got[None, 2] == (4, 1) and len(got) == len(rows)
    assert running_before(df.limit(0), "g", ["at"], {"before": F.col("v")}).count() == 0


def test_quality_checks(spark):
    scored = spark.createDataFrame([(False, 0.99)] * 3 + [(False, 0.1)] * 97 + [(True, 0.05)] + [(True, 0.9)] * 199, "is_spam boolean, spamicity double")
    got = {r["class"]: (r["at"], round(r["score"], 6), r["suspicious"]) for r in tune.quality_checks(scored).collect()}
    assert got == {"good": (1, 0.99, True), "spam": (2, 0.9, False)}
    assert tune.quality_checks(scored.limit(0)).count() == 0


def test_identical_lists_are_met_once(spark):
    rows = [("r", "a", "a.db", 1), ("r", "a", "a.db", 1), ("r", "a", "a.db", 2), ("i", "a", "a.db", 1)]
    assert wordlist.distinct_lists(spark.createDataFrame(rows, "list_type string, list_name string, file_name string, priority int")).count() == 3
