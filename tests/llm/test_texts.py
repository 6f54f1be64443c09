import pickle
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from siftline.llm import garbled, markup, mix, near_dup, pack, split
from siftline.llm.tokens import encode

DOC = "doc_id bigint, text string, source string, id bigint, n_tokens int, part string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, 0, "p") for i, t, s in rows], DOC)


WORDS = {
    "de": "Mühlenhaus löst Türhaus für große Küchenkasten prüften während schöne Gärten über Brückengebühr Paketgröße zählt höfer Straße",
    "fr": "été première fenêtre près théâtre où réservé garçon châteaux même déjà bibliothèque élevée forêt âgé",
    "pl": "że świętość książnik zamykał który małą łódź dziś zaczała źródłek tę długki otwierała żeby jaźń",
    "ru": "через лишного шляпарь послал чайник чтобы письмо измерил под между бумажного наш быстрого юбилей покрасили",
    "en": "the café’s — meeting … costs £5 or “more” at 20 °C and ½ naïve tailor",
}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [" ".join(rng.choice(w.split()) for _ in range(30)) for w in WORDS.values() for _ in range(60)]


@pytest.fixture(scope="module")
def model(corpus):
    return garbled.fit(corpus)


CHAINS = [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp1251"),), (("utf-8", "koi8-r"),), (("utf-8", "cp437"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("koi8-r", "cp1251"),), (("cp1251", "latin-1"),), (("cp866", "cp1251"),), (("cp1252", "cp437"),), (("iso8859-2", "cp1252"),)]


def test_clean_texts_stay_clean(model):
    rng = random.Random(6)
    fresh = [" ".join(rng.choice(w.split()) for _ in range(12)) for w in WORDS.values() for _ in range(20)]
    assert sum(model.repair(t)[0] for t in fresh) == 0


@pytest.mark.parametrize("chain", CHAINS, ids=str)
def test_garbled_texts_come_back(model, chain):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(w.split()) for _ in range(12)) for name, w in WORDS.items() if name != "en" for _ in range(10)]
    made = [(t, g) for t in texts if (g := garbled.garble(t, chain)) and g != t]
    found = [model.repair(g) for _, g in made]
    assert made and np.mean([f[0] for f in found]) >= 0.95
    assert np.mean([f[1] == t for (t, _), f in zip(made, found, strict=True)]) >= 0.8


def test_portions_of_six_chains_come_back(model):
    chains = [("ru", ("utf-8", "cp1251")), ("de", ("utf-8", "cp1252")), ("pl", ("utf-8", "cp437")), ("fr", ("utf-8", "koi8-r")), ("ru", ("koi8-r", "cp1251")), ("pl", ("utf-8", "mac-roman"))]
    parts = [" ".join(WORDS[name].split()[:10]) for name, _ in chains]
    text = " and so on in plain words ".join(parts)
    bad = " and so on in plain words ".join(garbled.garble(t, (step,)) for t, (_, step) in zip(parts, chains, strict=True))
    found, restored, steps, _ = model.repair(bad)
    assert found and len(steps) > 4 and restored == text


def test_one_word_and_one_character(model):
    text = "ein langer Satz über schöne Gärten und große Häuser prüften"
    assert model.repair(text.replace("Gärten", "GÃ¤rten"))[1] == text
    assert model.repair("plain words and cafÃ©’s end")[0]
    assert model.repair("price Â½ of it")[0]


def test_what_a_worker_has_met_before_changes_nothing(model, corpus):
    texts = [garbled.garble(t, garbled.CHAINS[3 * k % len(garbled.CHAINS)]) or t for k, t in enumerate(corpus[:40])] + corpus[:10]
    model.learn(texts)
    once = [model.repair(t) for t in texts]
    fresh = pickle.loads(pickle.dumps(model))
    assert [fresh.repair(t) for t in reversed(texts)] == once[::-1] == [model.repair(t) for t in reversed(texts)]


def test_garble_many_equals_one_by_one(corpus):
    words = sorted({w for t in corpus for w in t.split()})
    for chain in garbled.CHAINS:
        assert garbled.garble_all(words, chain) == [garbled.garble(w, chain) for w in words]


def test_what_was_read_as_cp852_comes_back(model):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(WORDS["pl"].split()) for _ in range(12)) for _ in range(20)]
    found = [model.repair(garbled.garble(t, (("cp1250", "cp852"),))) for t in texts]
    assert all(f[0] for f in found) and np.mean([f[1] == t for t, f in zip(texts, found, strict=True)]) >= 0.8


def test_pairs_of_bytes_count_what_each_chain_shows(corpus):
    words = Counter(w for t in corpus for w in t.split() if not w.isascii()) + Counter({"¥ｱﾄ‾é": 3, "漢字": 2, "é": 5, "\x85x": 2, "x\xa0y": 3, "😀": 4})
    counts = garbled._count(words, garbled._zeros())
    assert [c for n, c in zip(counts, (None, *garbled.CHAINS), strict=False) if not np.array_equal(n, garbled._count_chain(words, c))] == []


def test_the_model_rests_on_every_text(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(w.split()) for _ in range(3)) for w in WORDS.values() for _ in range(860)]
    texts += ["für " * 9, "ü" * 2500] + [garbled.garble(t, garbled.CHAINS[k]) or t for k, t in enumerate(texts[:40])]
    whole = garbled.fit(texts)
    want = {k: found[3] for k, t in enumerate(texts) if (found := whole.repair(t))[0]}
    rows = docs(spark, [(k, t, None) for k, t in enumerate(texts)])
    for tasks in (3, 7):
        assert {r["id"]: r["odds"] for r in garbled.find_garbled(rows.repartition(tasks), "doc_id", "text").where("garbled").collect()} == want != {}
    assert garbled._words(["für " * 9, "ü" * 2500]) == {"für": 9, "ü" * 2500: 1}


def test_garbled_edge_cases(spark, corpus):
    rows = [(k, t, None) for k, t in enumerate(corpus)] + [(900, None, None), (901, "", None), (902, "ascii only", None), (903, "lost \ufffd bytes", None), (None, "löst Türhaus fÃ¼r", None), (905, "für " * 20_000, None), (905, "für " * 20_000, None)]
    got = {r["id"]: r for r in garbled.find_garbled(docs(spark, rows), "doc_id", "text").where("garbled or id >= 900 or id is null").collect()}
    assert [got[k]["garbled"] for k in (900, 901, 902, 903, None, 905)] == [False, False, False, True, True, False]
    assert got[None]["restored"] == "löst Türhaus für" and got[903]["restored"] is None and set(got) == {900, 901, 902, 903, None, 905}
    assert garbled.find_garbled(docs(spark, []), "doc_id", "text").count() == 0


HONEST = ["> quoted\n>> twice", "* a star\n- a dash\n1. a number", "*word* is what I meant", "-----------\n_____\n", "Write to <joe@a.example> if 2 < 5 and 7 > 3.", "<grin> <http://a.example/x>", "50% & more :-)", "ticket #12 & R&D, C# and F#", "between $38 and $66, see [5].", r"The file C:\temp\new_score\x.txt is 7 * 6 * 4 KB.", "my_printer_name -> x", "+1", "a = b", "title\n\n-----"]
MARKED = {
    "html": ["<p>x</p>", "a<br>b", "x &amp; y", "&#8217;", "<!-- c -->", "&lt;b&gt;", "end <a href=\"http", "<BR", "</p>"],
    "markdown": ["# Title", "Title\n=====", "```\nx\n```", "a **b** c", "a __b__ c", "`code`", "[a](http://b)", "![i](x.png)", "~~no~~", "| a | b |\n|---|---|\n| 1 | 2 |", "Title\n-----\n\ntext"],
    "wiki": ["== T ==", "''i''", "[[Page|x]]", "{{t|x}}", "{| class=x\n|-\n| a || b\n|}", "h2. T", "[http://a.b text]"],
    "latex": [r"\section{T}", r"\textbf{x}", "$x^2$", r"\(n \le 3\)", r"12\% of", r"caf\'e", r"{\it x}", r"\begin{equation}x\end{equation}", r"x~\cite{r}"],
}


def test_markup_found_and_conventions_left():
    for t in HONEST:
        assert not markup.clean(t)[2], t
        assert markup.clean(t)[0] == t.strip("\n")
    for family, texts in MARKED.items():
        for t in texts:
            assert markup.clean(t)[2][family], (family, t)


def test_structure_is_kept():
    text = "<h1>Head &amp; more</h1>\n<p>The <b>wor</b>ds of the text are here.</p><ul><li>one</li><li>two</li></ul><pre>x = 1\n  y</pre>\n<script>no()</script><table><tr><td>a</td><td>b</td></tr></table>"
    out, blocks, _ = markup.clean(text)
    assert out == "Head & more\n\nThe words of the text are here.\n\n- one\n- two\n\n    x = 1\n      y\n\na\tb"
    assert [b.kind for b in blocks] == ["heading", "paragraph", "item", "item", "code", "row"]
    assert markup.clean("\\section{T}\nA $x^2$ b\n\\begin{equation}\n E=mc^2\n\\end{equation}")[0] == "T\n\nA x^2 b\n\nE=mc^2"


def test_boilerplate_and_neighbours():
    prose = "<p>" + "This is the text of the page and it is for the reader that is in the room with us. " * 3 + "</p>"
    menu = "<p><a href='/a'>Home page</a> <a href='/b'>All the news</a> <a href='/c'>Contact us</a></p>"
    blocks = markup.clean(menu + "<p>Short one</p>" + menu + prose + "<p>Short two</p>" + prose)[1]
    assert [b.label for b in blocks] == ["boilerplate", "boilerplate", "boilerplate", "content", "content", "content"]


LONG_SPAN = "word and more " * 720 + "end"  # about 10,000 characters


@pytest.mark.parametrize("wrapped", ["a **{}** b", "a __{}__ b", "a ~~{}~~ b", "a [{}](http://h/x) b", "a ''{}'' b", "a [[Page|{}]] b", "a [http://h/x {}] b", "a {{{{t|{}}}}} b", r"a \textbf{{{}}} b", r"a {{\it {}}} b", "a <b>{}</b> b", "a **x\n\n{}** b"])
def test_spans_of_any_length(wrapped):
    _, blocks, found = markup.clean(wrapped.format(LONG_SPAN))  # of the blocks, as one of nothing but links is boilerplate
    assert found and "\n".join(b.text for b in blocks).replace("x\n", "") == f"a {LONG_SPAN} b"


def test_nesting_of_any_depth():
    for opens, closes in (("{{t|", "}}"), (r"\emph{", "}"), (r"{\bf ", "}"), ("<b>", "</b>")):
        out, _, found = markup.clean("see " + opens * 10 + "core" + closes * 10)
        assert out == "see core" and found.total() >= 10
    assert markup.clean("a &" + "amp;" * 10 + "lt;b&" + "amp;" * 10 + "gt;c")[0] == "a c"
    assert markup.clean(r"\section{a} $x$ {{")[0] and markup.clean("{{" * 5000 + "&amp;" * 5000 + "}" * 5000)[2]["html"] == 5000


def test_headings_and_lists_stay_whatever_their_links():
    assert markup.clean("# T\n\n- [one](http://a/1)\n- [two](http://a/2)\n- [three](http://a/3)")[0] == "T\n\n- one\n- two\n- three"


def test_markup_edge_cases(spark):
    rows = [(1, None, None), (2, "", None), (None, "<b>x</b>", None), (4, "# h\r\ntext\r\n", None), (5, "<p>" * 5_000 + "x" * 100_000 + "&amp;" * 5_000, None), (6, "[" * 3_000 + "{" * 3_000 + "<" * 3_000 + "*" * 3_000, None)]
    got = {r["id"]: r for r in markup.clean_markup(docs(spark, rows), "doc_id", "text").collect()}
    assert got[1]["clean"] is None and got[2]["clean"] == "" and got[None]["clean"] == "x" and got[4]["clean"] == "h\n\ntext"
    assert got[5]["html"] == 10_000 and len(got) == 6
    assert markup.clean_markup(docs(spark, []), "doc_id", "text").count() == 0


def brute(texts, threshold, least):
    import re

    sets = {k: frozenset(re.findall(r"[^\W_]{3,}", t.lower())) for k, t in texts if t}
    sets = {k: s for k, s in sets.items() if len(s) >= least}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("region", [32, 3])
def test_near_duplicates_equal_brute_force(spark, region):
    rng = random.Random(9)
    vocabulary = [f"word{k}" for k in range(400)]
    texts, n = [], 0
    for _ in range(25):
        base = rng.sample(vocabulary, 40)
        for _ in range(rng.choice([1, 1, 2, 12])):
            words = base[:]
            for _ in range(rng.randrange(5)):
                words[rng.randrange(40)] = rng.choice(vocabulary)
            rng.shuffle(words)
            texts.append((n, " ".join(words)))
            n += 1
    texts += [(n, texts[0][1].upper()), (n + 1, texts[0][1]), (n + 2, None), (n + 3, ""), (n + 4, "too few words"), (n + 5, "too few words")]
    want = {p for p in brute(texts, 0.69, 20)}
    found = near_dup.near_duplicates(docs(spark, [(i, t, None) for i, t in texts]), "doc_id", "text", 0.69, 20, near_dup.word_hashes, region)
    got = [tuple(r) for r in near_dup.expanded(found).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.995 * len(want)
    group = {r["id"]: r["group_id"] for r in near_dup.groups(found).collect()}
    assert all(group[a] == group[b] for a, b in got) and n + 4 not in group
    parent = {k: k for k in group}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in got:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert group == {k: root(k) for k in group}


def test_a_large_family_keeps_the_miss_rate(spark):
    common = " ".join(f"base{k}x" for k in range(98))
    texts = [(i, common + " " + " ".join(f"own{i}v{j}" for j in range(21)), None) for i in range(500)]  # every pair at s = 0.7
    found = near_dup.near_duplicates(docs(spark, texts), "doc_id", "text", 0.69, 20, near_dup.word_hashes)
    every = 500 * 499 // 2
    assert every * (1 - 2e-4) <= found.pairs.count() <= every


def test_near_duplicates_edge_cases(spark):
    empty = near_dup.near_duplicates(docs(spark, []), "doc_id", "text")
    assert empty.members.count() == 0 and near_dup.expanded(empty).count() == 0 and near_dup.groups(empty).count() == 0
    same = "one two three four five six seven"
    found = near_dup.near_duplicates(docs(spark, [(1, same, None), (2, same, None), (2, same, None), (3, same.title(), None), (None, same, None), (4, "x" * 100_000, None)]), "doc_id", "text")
    assert sorted(map(tuple, near_dup.expanded(found).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_hilbert_neighbours_touch():
    n = 4
    points = np.array([[a, b, c] for a in range(n) for b in range(n) for c in range(n)])
    keys = pack.hilbert_keys(points, 2)
    assert sorted(keys) == list(range(n**3))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packing(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "word"]) for _ in range(rng.randrange(1, 60))), None) for k in range(400)]
    rows += [(1000, None, None), (1001, "", None), (1002, "long " * 3_000, None), (None, "no id", None), (5, rows[5][1], None)]
    out = pack.pack(docs(spark, rows), [128, 32]).collect()
    for capacity in (128, 32):
        mine = [r for r in out if r["capacity"] == capacity]
        assert Counter(r["id"] for r in mine if r["piece"] == 0) == Counter(i for i, _, _ in rows)
        sizes, items = Counter(), Counter()
        for r in mine:
            sizes[r["container"]] += r["n_tokens"]
            items[r["container"]] += 1
        assert max(sizes.values()) <= capacity
        assert sum(sizes.values()) == sum(len(encode(t)) for _, t, _ in rows)
        assert sum(sizes.values()) / (len(sizes) * capacity) > 0.97
        whole = {i: len(encode(t)) for i, t, _ in rows}
        assert all(r["n_tokens"] == whole[r["id"]] for r in mine if whole[r["id"]] <= capacity)
    assert pack.pack(docs(spark, []), [10]).count() == 0
    with pytest.raises(ValueError):
        pack.pack(docs(spark, []), [0])


def test_the_curve_keeps_likes_together(spark):
    rng = random.Random(5)
    kinds = [[f"w{k}x{j}" for j in range(30)] for k in range(4)]
    rows = [(k, " ".join(rng.choices(kinds[k % 4], k=25)), None) for k in range(400)] + [(None, "x", None), (900, None, None)]
    got = {}
    for shuffled in (False, True):
        packed = pack.pack(docs(spark, rows), [512], window=16, most_open=4, shuffled=shuffled)
        got[shuffled] = pack.locality(packed, docs(spark, rows)).first()
    assert got[False]["similarity"] > got[True]["similarity"] + 0.05 and got[False]["fill"] > 0.8
    assert pack.locality(pack.pack(docs(spark, []), [10]), docs(spark, [])).count() == 0


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["tok"] * rng.randrange(1, 40)), rng.choice(["a", "a", "a", "a", "b", "c", None])) for k in range(900)] + [(2000, None, "a"), (2001, "", "b"), (2002, "t", "b"), (2002, "t", "b")]
    m = mix.mix(docs(spark, rows), targets(spark, [("a", 0.4, 1), ("b", 0.3, 3), ("c", 0.3, 2), ("none", 0.2, 5), ("zero", 0.0, 1), ("bad", None, None)]), block_records=50)
    report = {r["source"]: r for r in m.report.collect()}
    for s, share in (("a", 0.4), ("b", 0.3), ("c", 0.3)):
        assert report[s]["reached_share"] == pytest.approx(share, abs=0.003)
    assert report["none"]["tokens"] == report["zero"]["tokens"] == report["bad"]["tokens"] == 0
    uses = m.used.collect()
    assert max(r["n_uses"] for r in uses if r["source"] == "b") <= 3 and all(r["n_uses"] == 1 for r in uses if r["source"] == "a")
    assert any(report[s]["tokens"] == sum(len(encode(t)) for _, t, x in rows if x == s) * k for s, k in (("a", 1), ("b", 3), ("c", 2)))


def test_mixing_more_than_targets_allow_tilts_to_natural_shares(spark):
    rows = [(k, "tok tok tok", "big") for k in range(300)] + [(k, "tok tok tok", "small") for k in range(300, 310)]
    t = targets(spark, [("big", 0.5, 2), ("small", 0.5, 2)])
    one = mix.mix(docs(spark, rows), t)
    more = mix.mix(docs(spark, rows), t, total=4 * one.plan.total)
    assert one.plan.exponent == 0 and 0 < more.plan.exponent < 1
    assert max(r["n_uses"] for r in more.used.collect()) <= 2
    assert mix.mix(docs(spark, []), t).used.count() == 0
    assert mix.mix(docs(spark, rows), t.limit(0)).report.count() == 0


def test_budgets_are_filled_record_by_record():
    sizes = [240] * 10 + [9_111, 20_000]
    uses = mix.fill(sizes, 10_700, 5)
    assert sum(n * u for n, u in zip(sizes, uses)) > 10_700 - 240 and max(uses) <= 5
    assert mix.fill([5, 5], 12, 1) == [1, 1] and mix.fill([0, 7], 6, 3) == [1, 0] and mix.fill([], 0.0, 1) == []
    assert sum(mix.fill([3], 100, 4)) == 4


def test_temperature_meets_entropy():
    shares = [0.7, 0.2, 0.1]
    target = 1.0
    a = mix.exponent_for_entropy(shares, target)
    assert mix.entropy(mix.powered(shares, a)) == pytest.approx(target, abs=1e-9) and 0 < a < 1
    p = mix.plan([mix.Source("a", 700, 7, 0, 9), mix.Source("b", 200, 2, 0, 9), mix.Source("c", 100, 1, 0, 9)], target_entropy=target)
    assert sum(p.budgets.values()) == pytest.approx(1000)


TEXTS = ["word " * 900, "Sentence one is here. And two! " * 60, "para one\n\npara two is longer, with commas\r\n" * 50, "x" * 5_000, "今天我们检查了床伞和新的茶马。" * 120, "\U0001f600\U0001f680" * 400, "a\n" * 500, "é" * 2000, "mixed é 今 \U0001f600 " * 150]


@pytest.mark.parametrize("text", TEXTS, ids=[str(k) for k in range(len(TEXTS))])
@pytest.mark.parametrize("limit,overlap", [(400, 40), (64, 0), (50, 20)])
def test_pieces_fit_and_give_back_the_text(text, limit, overlap):
    s = split.Splitter(limit, overlap)
    pieces = s.split(text)
    total = len(encode(text))
    assert all(p[2] <= limit and p[2] == len(encode(p[5])) for p in pieces)
    back = ""
    for a, b, _, shared, _, t in pieces:
        assert t == text[a:b] and a <= len(back)
        back += t[len(back) - a :]
    assert back == text
    if total > limit:
        assert all(p[3] >= overlap for p in pieces[1:])
        assert len(pieces) <= -(-(total - overlap) // (limit - overlap)) * 1.3 + 1


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_any_text_comes_back(text):
    text = text.encode("utf-8", "ignore").decode()
    back = ""
    for a, _, n, _, _, t in split.Splitter(40, 8).split(text):
        assert n <= 40
        back += t[len(back) - a :]
    assert back == text


def test_natural_boundaries_are_taken():
    text = "\n\n".join("Some words that make up a paragraph of a certain size, no more." for _ in range(30))
    strengths = [p[4] for p in split.Splitter(80, 0).split(text)[:-1]]
    assert strengths.count(6) >= 0.6 * len(strengths) and min(strengths) >= 2


def test_no_end_is_forced_while_a_boundary_is_in_reach():
    rng = random.Random(3)
    runs = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(150, 500))) for _ in range(60)]
    texts = [" ".join(runs), "".join(r + rng.choice([". ", "\n\n", ", ", " "]) for r in runs * 4)]
    s = split.Splitter(400, 40)
    for text in texts:
        tokens = s.encoding.encode_ordinary(text)
        char_at, strength = s._places(text, tokens)
        at = {int(c): k for k, c in enumerate(char_at) if c >= 0}
        pieces = s.split(text)
        assert len(pieces) > 20 and len(pieces) <= 1.5 * len(tokens) / 360
        for p in pieces[:-1]:
            reach = np.arange(at[p[0]] + 41, min(at[p[0]] + 400, len(tokens) - 1) + 1)
            assert p[4] > 1 or not ((strength[reach] > 1) & (char_at[reach - 40] >= 0)).any()


def test_split_edge_cases(spark):
    rows = [(1, None, None), (2, "", None), (None, "short", None), (4, "w " * 500, None), (4, "w " * 500, None)]
    got = Counter((r["id"], r["piece"]) for r in split.split_texts(docs(spark, rows), 400, 40).collect())
    assert got[1, 0] == got[2, 0] == got[None, 0] == 1 and got[4, 0] == 2 and got[4, 1] == 2
    assert split.split_texts(docs(spark, []), 400, 40).count() == 0
    with pytest.raises(ValueError):
        split.Splitter(10, 10)
