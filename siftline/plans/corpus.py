"""Queries over documents and labels: tokens, training, scoring, explanation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.common import broadcast_if_small, checkpoint, read, running_before, spread
from siftline.functions.prob import token_probability
from siftline.operators import score, stats, tokenize, train, wordlist
from siftline.params import Params

P = Params()
TOTALS = ".MSG_COUNT"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, is_spam of labelled documents; one spam label makes a document spam."""
    return read(spark, sf_dir, "labels").where("toxic is not null").groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") == 1).alias("is_spam"))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.tokens(read(spark, sf_dir, "documents"), "doc_id", "text", P)


@dataclass
class Trained:
    table: DataFrame
    msgs_good: int
    msgs_spam: int
    size: int  # bytes, counted


def trained(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> Trained:
    """The count table of the labelled documents, or of those in known(id, is_spam). Every message also holds the totals' token, so one aggregate gives both."""
    known = labels(spark, sf_dir) if known is None else known
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = spread(docs.join(broadcast_if_small(known.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi"))  # only what is registered is tokenised
    found = F.array_distinct(tokenize.token_array(F.col("text"), P))
    held = docs.select(F.col("doc_id").alias("id"), found.alias("t")).where(F.size("t") > 0).select("id", F.explode(F.concat("t", F.array(F.lit(TOTALS)))).alias("token"))
    table = checkpoint(wordlist.register(held, known))
    of_totals = lambda c: F.max(F.when(F.col("token") == TOTALS, F.col(c)))
    one = table.agg(of_totals("good").alias("good"), of_totals("spam").alias("spam"), F.sum(F.octet_length("token") + 48).alias("size")).first()
    return Trained(table.where(F.col("token") != TOTALS), one["good"] or 0, one["spam"] or 0, one["size"] or 0)


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trained(spark, sf_dir)
    return score.with_counts(doc_tokens(spark, sf_dir), t.table, t.msgs_good, t.msgs_spam, t.size)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def tokens_doc_counts(spark, sf_dir):
    found = tokenize.tokens(read(spark, sf_dir, "documents"), "doc_id", "text", P, distinct=False)
    return found.groupBy(F.col("id").alias("doc_id"), "token").agg(F.count("*").alias("n"))


def doc_distinct_tokens(spark, sf_dir):
    return doc_tokens(spark, sf_dir).select(F.col("id").alias("doc_id"), "token", tokenize.token_class(F.col("token")).alias("cls"))


def document_frequency(spark, sf_dir):
    return doc_tokens(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n_docs"))


def wordlist_register(spark, sf_dir):
    return wordlist.register(doc_tokens(spark, sf_dir), labels(spark, sf_dir))


def msg_counts(spark, sf_dir):
    return wordlist.message_totals(doc_tokens(spark, sf_dir), labels(spark, sf_dir))


def _poor(spark, sf_dir):
    """Labelled documents of quality 1: the ones taken back or moved."""
    poor = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return labels(spark, sf_dir).join(poor, "id", "left_semi")


def wordlist_unregister(spark, sf_dir):
    found = doc_tokens(spark, sf_dir)
    return wordlist.apply_counts(wordlist.register(found, labels(spark, sf_dir)), wordlist.register(found, _poor(spark, sf_dir)), -1, -1)


def wordlist_move_class(spark, sf_dir):
    found = doc_tokens(spark, sf_dir)
    ham = _poor(spark, sf_dir).where("not is_spam")
    return wordlist.move(wordlist.register(found, labels(spark, sf_dir)), wordlist.register(found, ham))


def token_fw(spark, sf_dir):
    t = trained(spark, sf_dir)
    fw = token_probability(F.col("good"), F.col("spam"), F.lit(t.msgs_good), F.lit(t.msgs_spam), P)
    return t.table.select("token", "spam", "good", F.round(fw, 6).alias("fw"))


def token_lookup_probe(spark, sf_dir):
    """Counts and probability of the words of the part names, where the table knows them."""
    probes = read(spark, sf_dir, "msgcounts").where("key is not null").select(F.col("key").alias("token"))
    return wordlist.lookup(probes, token_fw(spark, sf_dir))


def robx(spark, sf_dir):
    t = trained(spark, sf_dir)
    return _rounded(stats.robx(t.table, t.msgs_spam, t.msgs_good), "robx")


def wordlist_hist20(spark, sf_dir):
    """The plain histogram: probabilities without robs and robx."""
    t = trained(spark, sf_dir)
    fw = token_probability(F.col("good"), F.col("spam"), F.lit(t.msgs_good), F.lit(t.msgs_spam), Params(robs=0.0, robx=0.0))
    return _rounded(stats.wordlist_histogram(t.table, fw), "score", "pct")


def hapax_pure(spark, sf_dir):
    return stats.hapaxes(trained(spark, sf_dir).table)


def _classified(spark, sf_dir, p: Params):
    out = score.scores(score.rated(counted(spark, sf_dir), p), p).withColumnRenamed("id", "doc_id")
    return _rounded(out, "p_value", "q_value", "spamicity")


def classify_docs(spark, sf_dir):
    """Train on the labelled documents, score all."""
    return _classified(spark, sf_dir, P)


TWO = Params(ham_cutoff=0.0, spam_cutoff=0.5)
ESF = Params(sp_esf=0.5, ns_esf=0.5)
TOPK = {"topk_fix": Params(token_count_fix=12), "topk_min": Params(min_dev=0.45, token_count_min=6), "topk_max": Params(min_dev=0.1, token_count_max=20)}


def classify_two_state(spark, sf_dir):
    return _classified(spark, sf_dir, TWO)


def classify_esf(spark, sf_dir):
    """Effective-size factors: fractional degrees of freedom."""
    return _classified(spark, sf_dir, ESF)


def _topk(name):
    def query(spark, sf_dir):
        return _classified(spark, sf_dir, TOPK[name])

    query.__name__ = name
    return query


def explain_tokens(spark, sf_dir):
    rows = score.explain(score.rated(counted(spark, sf_dir), P)).withColumnRenamed("id", "doc_id")
    return _rounded(rows, "pgood", "pbad", "fw")


def doc_hist10(spark, sf_dir):
    rows = score.message_histogram(score.rated(counted(spark, sf_dir), P), P).withColumnRenamed("id", "doc_id")
    return _rounded(rows, "prob", "spamicity")


def _with_source(spark, sf_dir, p=P):
    scored = score.scores(score.rated(counted(spark, sf_dir), p), p)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("source"))
    return scored.join(docs, "id")


def confusion_by_source(spark, sf_dir):
    return stats.confusion(_with_source(spark, sf_dir), "source", P.tags)


def labelled_scores(spark, sf_dir):
    return score.scores(score.rated(counted(spark, sf_dir), P), P).join(labels(spark, sf_dir), "id")


CUTOFFS = [0.05 * k for k in range(1, 20)]


def fp_fn_curve(spark, sf_dir):
    scored = labelled_scores(spark, sf_dir).withColumn("spamicity", F.round("spamicity", 6))
    return _rounded(stats.errors_at(scored, CUTOFFS), "cutoff")


def ngrams3(spark, sf_dir):
    rows = tokenize.line_ngrams(read(spark, sf_dir, "documents"), "doc_id", "text", 3, P)
    return rows.where("size > 1").groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_docs"))


def money_tokens(spark, sf_dir):
    found = tokenize.tokens(read(spark, sf_dir, "documents"), "doc_id", "text", P, distinct=False)
    return found.where(F.col("token").startswith("$")).groupBy("token").agg(F.count("*").alias("n"))


def train_on_error(spark, sf_dir):
    """Counts after at most two rounds in which only wrongly or unsurely scored documents were registered."""
    found = checkpoint(doc_tokens(spark, sf_dir).join(labels(spark, sf_dir), "id", "left_semi"))
    return train.train_on_error(found, labels(spark, sf_dir), P, rounds=2, parts=3)


def train_balanced(spark, sf_dir):
    """The batches of a training in which spam and good documents alternate in their ratio."""
    return train.in_batches(labels(spark, sf_dir), 4, "balanced", seed=3).groupBy("part", "is_spam").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def train_random(spark, sf_dir):
    """The batches of a training in random order."""
    return train.in_batches(labels(spark, sf_dir), 4, "random", seed=3).groupBy("part", "is_spam").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def scrambled_order(spark, sf_dir):
    """Each document's place in a random order."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source")
    placed = train.scrambled(rows, "doc_id", seed=7).withColumns({"draw": train.draw("doc_id", 7), "all": F.lit(0)})
    return running_before(placed, "all", ["draw", "doc_id"], {"place": F.lit(1)}).select("doc_id", "source", "place")


def hist_hapaxes(spark, sf_dir):
    """The histograms without tokens seen once, and without those of one class only."""
    t = trained(spark, sf_dir)
    fw = token_probability(F.col("good"), F.col("spam"), F.lit(t.msgs_good), F.lit(t.msgs_spam), Params(robs=0.0, robx=0.0))
    both = [stats.wordlist_histogram(t.table, fw, without=w).withColumn("without", F.lit(w)) for w in ("hapaxes", "pure")]
    return _rounded(both[0].unionByName(both[1]), "score", "pct")


def r_table(spark, sf_dir):
    """The explanation as a table for statistics, with logarithms and a summary per document."""
    rows = score.data_frame(score.rated(counted(spark, sf_dir), P), P).withColumnRenamed("id", "doc_id")
    return _rounded(rows, "pgood", "pbad", "fw", "invfwlog", "fwlog")


def explain_order(spark, sf_dir):
    """The places of a document's tokens by probability and by text."""
    rows = score.explain(score.rated(counted(spark, sf_dir), P)).withColumn("fw", F.round("fw", 9))
    return score.in_order(rows).select(F.col("id").alias("doc_id"), "token", "place", "place_by_token")


QUERIES = {
    f.__name__: f
    for f in (
        tokens_doc_counts, doc_distinct_tokens, document_frequency, wordlist_register, msg_counts, wordlist_unregister, wordlist_move_class, token_fw, token_lookup_probe, robx,
        wordlist_hist20, hapax_pure, classify_docs, classify_two_state, classify_esf, *map(_topk, TOPK), explain_tokens, doc_hist10, confusion_by_source, fp_fn_curve, ngrams3,
        money_tokens, train_on_error, train_balanced, train_random, scrambled_order, hist_hapaxes, r_table, explain_order,
    )
}

# --- the same in SQL, written apart ---------------------------------------------------------------
# The character classes of tokens, addresses and amounts.
_OCT = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
RE_IP = rf"{_OCT}(?:\.{_OCT}){{3}}"
_NOT = r""":$*<>;=()&%#@+|/\\{}^"?,\[\]"""
RE_WORD = rf"[^[:blank:][:cntrl:][:digit:][:punct:]](?:[^[:blank:][:cntrl:]{_NOT}]*[^[:blank:][:cntrl:]{_NOT}._~''`\-])?"
RE_TOKEN = rf"{RE_IP}|\$[0-9]+(?:\.[0-9]+)?|{RE_WORD}"
KEEP = f"(regexp_full_match(token, '{RE_IP}') OR (strlen(token) <= 30 AND (strlen(token) >= 3 OR starts_with(token, '$'))))"

RAW = f"raw_tok AS (SELECT id, token FROM (SELECT doc_id AS id, unnest(regexp_extract_all(text, '{RE_TOKEN}')) AS token FROM documents) WHERE {KEEP})"
TOK = f"{RAW}, tok AS MATERIALIZED (SELECT DISTINCT id, token FROM raw_tok)"
LAB = "lab AS (SELECT doc_id AS id, max(toxic) = 1 AS is_spam FROM labels WHERE toxic IS NOT NULL GROUP BY 1)"
WL = f"{TOK}, {LAB}, wl AS MATERIALIZED (SELECT token, count(*) FILTER (is_spam) AS spam, count(*) FILTER (NOT is_spam) AS good FROM tok JOIN lab USING (id) GROUP BY token)"
TRAINED = f"{WL}, tot AS (SELECT count(*) FILTER (is_spam) AS ms, count(*) FILTER (NOT is_spam) AS mg FROM lab WHERE id IN (SELECT id FROM tok))"


def sql_fw(good: str, bad: str, mg: str, mb: str, p: Params) -> str:
    g, b = f"({good})::DOUBLE", f"({bad})::DOUBLE"
    share = f"(CASE WHEN {b} * {mg} + {g} * {mb} > 0 THEN {b} * {mg} / ({b} * {mg} + {g} * {mb}) ELSE {p.robx!r} END)"
    return f"(CASE WHEN {good} + {bad} > 0 THEN ({p.robs * p.robx!r} + ({good} + {bad}) * {share}) / ({p.robs!r} + ({good} + {bad})) ELSE {p.robx!r} END)"


def sql_tail(y: str, n: str) -> str:
    s = f"list_sum(list_transform(range({n}), lambda k: exp(-({y}) + k * ln({y}) - lgamma(k + 1))))"
    return f"(CASE WHEN {n} = 0 OR {y} <= 0 THEN 1.0 WHEN {s} < 2.220446049250313e-16 THEN 0.0 ELSE least({s}, 1.0) END)"


def sql_scores(rated: str, p: Params) -> str:
    """CTEs sums and scored over rated(id, fw, used)."""
    sums = f"sums AS (SELECT id, coalesce(sum(CASE WHEN used THEN -ln(1 - fw) END), 0) AS yi, coalesce(sum(CASE WHEN used THEN -ln(fw) END), 0) AS yf, count(*) FILTER (used) AS n FROM {rated} GROUP BY id)"
    pq = f"pq AS (SELECT id, n, {sql_tail('yi', 'n')} AS p, {sql_tail('yf', 'n')} AS q FROM sums)"
    ham = "TRUE" if p.ham_cutoff == 0 else f"s <= {p.ham_cutoff!r}"
    scored = f"""scored AS (SELECT *, CASE WHEN s >= {p.spam_cutoff!r} THEN 'Spam' WHEN {ham} THEN 'Ham' ELSE 'Unsure' END AS status
      FROM (SELECT id, n, CASE WHEN n = 0 THEN 1.0 ELSE p END AS p, CASE WHEN n = 0 THEN 1.0 ELSE q END AS q, CASE WHEN n = 0 THEN {p.robx!r} ELSE (1 + q - p) / 2 END AS s FROM pq))"""
    return f"{sums}, {pq}, {scored}"


def sql_rated(p: Params) -> str:
    base = f"""counted AS (SELECT tok.id, tok.token, coalesce(wl.good, 0) AS good, coalesce(wl.spam, 0) AS bad, mg, ms FROM tok LEFT JOIN wl USING (token), tot),
    fws AS (SELECT *, {sql_fw("good", "bad", "mg", "ms", p)} AS fw FROM counted)"""
    used = f"abs(fw - 0.5) > {p.min_dev!r}"
    k = max(p.token_count_fix, p.token_count_min, p.token_count_max)
    if not k:
        return f"{base}, rated AS (SELECT *, {used} AS used FROM fws)"
    gate = "TRUE" if p.token_count_fix else f"nu < {p.token_count_min}" + (f" OR nu > {p.token_count_max}" if p.token_count_max else "")
    return f"""{base}, ranked AS (SELECT *, {used} AS u, count(*) FILTER ({used}) OVER (PARTITION BY id) AS nu, rank() OVER (PARTITION BY id ORDER BY abs(fw - 0.5) DESC) AS r FROM fws),
    rated AS (SELECT *, CASE WHEN {gate} THEN r <= {k} ELSE u END AS used FROM ranked)"""


def sql_classify(p: Params) -> str:
    return f"WITH {TRAINED}, {sql_rated(p)}, {sql_scores('rated', p)} SELECT id AS doc_id, n AS n_used, round(p, 6) AS p_value, round(q, 6) AS q_value, round(s, 6) AS spamicity, status FROM scored"


_SCORED = f"WITH {TRAINED}, {sql_rated(P)}, {sql_scores('rated', P)} "
_POOR = "poor AS (SELECT * FROM lab WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1))"
_BELOW = lambda i, f: f"sum(CASE WHEN used AND fw < {(i + 1) / 10!r} THEN {f} END)"
_LINES = f"lines AS (SELECT id, line, regexp_extract_all(txt, '{RE_TOKEN}') AS w FROM (SELECT doc_id AS id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS txt, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS line FROM documents))"

ORACLE = {
    "tokens_doc_counts": f"WITH {RAW} SELECT id AS doc_id, token, count(*) AS n FROM raw_tok GROUP BY ALL",
    "doc_distinct_tokens": f"WITH {TOK} SELECT id AS doc_id, token, CASE WHEN regexp_full_match(token, '{RE_IP}') THEN 'IPADDR' WHEN starts_with(token, '$') THEN 'MONEY' ELSE 'TOKEN' END AS cls FROM tok",
    "document_frequency": f"WITH {TOK} SELECT token, count(*) AS n_docs FROM tok GROUP BY token",
    "wordlist_register": f"WITH {WL} SELECT * FROM wl",
    "msg_counts": f"WITH {TRAINED} SELECT ms AS msgs_spam, mg AS msgs_good FROM tot",
    "wordlist_unregister": f"WITH {WL}, {_POOR}, un AS (SELECT token, count(*) FILTER (is_spam) AS s, count(*) FILTER (NOT is_spam) AS g FROM tok JOIN poor USING (id) GROUP BY token) SELECT token, greatest(spam - coalesce(s, 0), 0) AS spam, greatest(good - coalesce(g, 0), 0) AS good FROM wl LEFT JOIN un USING (token) WHERE greatest(spam - coalesce(s, 0), 0) + greatest(good - coalesce(g, 0), 0) > 0",
    "wordlist_move_class": f"WITH {WL}, {_POOR}, un AS (SELECT token, count(*) AS g FROM tok JOIN poor USING (id) WHERE NOT is_spam GROUP BY token) SELECT token, spam + coalesce(g, 0) AS spam, greatest(good - coalesce(g, 0), 0) AS good FROM wl LEFT JOIN un USING (token)",
    "token_fw": f"WITH {TRAINED} SELECT token, spam, good, round({sql_fw('good', 'spam', 'mg', 'ms', P)}, 6) AS fw FROM wl, tot",
    "token_lookup_probe": f"WITH {TRAINED} SELECT token, spam, good, round({sql_fw('good', 'spam', 'mg', 'ms', P)}, 6) AS fw FROM wl, tot WHERE token IN (SELECT key FROM msgcounts)",
    "robx": f"WITH {TRAINED} SELECT round(avg(spam / (good * (ms::DOUBLE / mg) + spam)), 6) AS robx, count(*) AS n FROM wl, tot WHERE good + spam >= 10 AND NOT starts_with(token, '.')",
    "wordlist_hist20": f"WITH {TRAINED}, b AS (SELECT least(floor({sql_fw('good', 'spam', 'mg', 'ms', Params(robs=0.0, robx=0.0))} * 20), 19)::INT AS bin FROM wl, tot WHERE NOT starts_with(token, '.')) SELECT round(i / 20.0, 6)::DOUBLE AS score, count(bin) AS count, round(count(bin) * 100.0 / (SELECT count(*) FROM b), 6)::DOUBLE AS pct FROM range(20) r(i) LEFT JOIN b ON b.bin = r.i GROUP BY i",
    "hapax_pure": f"WITH {WL} SELECT count(*) FILTER (good > 0 AND spam = 0) AS ham_only, count(*) FILTER (good = 1 AND spam = 0) AS ham_hapax, count(*) FILTER (spam > 0 AND good = 0) AS spam_only, count(*) FILTER (spam = 1 AND good = 0) AS spam_hapax FROM wl WHERE NOT starts_with(token, '.')",
    "classify_docs": sql_classify(P),
    "classify_two_state": sql_classify(TWO),
    **{name: sql_classify(p) for name, p in TOPK.items()},
    "explain_tokens": f"WITH {TRAINED}, {sql_rated(P)} SELECT id AS doc_id, token, good + bad AS n, round(good / mg::DOUBLE, 6) AS pgood, round(bad / ms::DOUBLE, 6) AS pbad, round(fw, 6) AS fw, CASE WHEN used THEN '+' ELSE '-' END AS flag FROM rated",
    "doc_hist10": f"WITH {TRAINED}, {sql_rated(P)}, h AS ("
    + " UNION ALL ".join(
        f"SELECT id, {i} AS bin, count(*) FILTER (used) AS n, count(*) FILTER (used AND fw >= {i / 10!r} AND fw < {(i + 1) / 10!r}) AS cnt, avg(fw) FILTER (used AND fw >= {i / 10!r} AND fw < {(i + 1) / 10!r}) AS prob, 1 - exp(coalesce({_BELOW(i, 'ln(1 - fw)')}, 0) / count(*) FILTER (used)) AS pi, 1 - exp(coalesce({_BELOW(i, 'ln(fw)')}, 0) / count(*) FILTER (used)) AS pf FROM rated GROUP BY id"
        for i in range(10)
    )
    + f") SELECT id AS doc_id, bin, cnt, round(coalesce(prob, 0), 6) AS prob, round(CASE WHEN n = 0 THEN {P.robx!r} WHEN pi + pf < 2.220446049250313e-16 THEN 0 ELSE (1 + (pi - pf) / (pi + pf)) / 2 END, 6) AS spamicity FROM h",
    "confusion_by_source": _SCORED + "SELECT coalesce(source, '') AS source, count(*) FILTER (status = 'Spam') AS spam, count(*) FILTER (status = 'Ham') AS ham, count(*) FILTER (status = 'Unsure') AS unsure, count(*) AS total FROM scored JOIN documents ON doc_id = id GROUP BY 1",
    "fp_fn_curve": _SCORED + "SELECT round(c, 6) AS cutoff, count(*) FILTER (NOT is_spam AND round(s, 6) >= c) AS fp, count(*) FILTER (is_spam AND round(s, 6) < c) AS fn FROM (SELECT unnest(" + repr(CUTOFFS) + "::DOUBLE[]) AS c), scored JOIN lab USING (id) GROUP BY c",
    "ngrams3": f"WITH {_LINES}, kept AS (SELECT id, line, list_filter(w, lambda token: {KEEP}) AS w FROM lines), g AS (SELECT id, unnest(list_transform(range(2, len(w) + 1), lambda i: w[i - 1] || '*' || w[i])) AS gram FROM kept UNION ALL SELECT id, unnest(list_transform(range(3, len(w) + 1), lambda i: w[i - 2] || '*' || w[i - 1] || '*' || w[i])) FROM kept) SELECT gram, count(*) AS n, count(DISTINCT id) AS n_docs FROM g GROUP BY gram",
    "money_tokens": f"WITH {RAW} SELECT token, count(*) AS n FROM raw_tok WHERE starts_with(token, '$') GROUP BY token",
    "scrambled_order": "SELECT doc_id, source, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS place FROM documents",
    "train_balanced": f"WITH {LAB}, o AS (SELECT *, row_number() OVER (PARTITION BY is_spam ORDER BY md5('3:' || id), id) - 1 AS place, count(*) OVER (PARTITION BY is_spam) AS size FROM lab) SELECT floor(place * 4 / size)::INT AS part, is_spam, count(*) AS n, min(id) AS first FROM o GROUP BY ALL",
    "train_random": f"WITH {LAB} SELECT floor(('0x' || substr(md5('3:' || id), 1, 8))::UBIGINT * 4 / 4294967296.0)::INT AS part, is_spam, count(*) AS n, min(id) AS first FROM lab GROUP BY ALL",
}

_RAW_FW = sql_fw("good", "spam", "mg", "ms", Params(robs=0.0, robx=0.0))
_WITHOUT = {"hapaxes": "(good = 0 OR spam = 0) AND good + spam = 1", "pure": "(good = 0 OR spam = 0) AND good + spam > 0"}


def sql_half_tail(y: str, n: str) -> str:
    """Survival of chi-square at 2 * y with n degrees of freedom, any whole n: the finite sum, from the error function where n is odd."""
    z = f"sqrt({y})"
    small = f"1 - 2 / sqrt(pi()) * list_sum(list_transform(range(60), lambda k: pow(-1, k) * pow({z}, 2 * k + 1) / (exp(lgamma(k + 1)) * (2 * k + 1))))"
    large = f"{z} * exp(-({y})) / pi() * 0.15 * list_sum(list_transform(range(-300, 301), lambda k: exp(-pow(0.15 * k, 2)) / ({y} + pow(0.15 * k, 2))))"
    odd = f"(CASE WHEN {y} < 1 THEN {small} ELSE {large} END) + coalesce(list_sum(list_transform(range(({n} - 1) // 2), lambda k: exp((k + 0.5) * ln({y}) - ({y}) - lgamma(k + 1.5)))), 0)"
    even = f"list_sum(list_transform(range({n} // 2), lambda k: exp(k * ln({y}) - ({y}) - lgamma(k + 1))))"
    return f"(CASE WHEN {n} = 0 OR {y} <= 0 THEN 1.0 ELSE (CASE WHEN {n} % 2 = 1 THEN {odd} ELSE {even} END) END)"


_FLUSH = lambda c: f"CASE WHEN {c} < 2.220446049250313e-16 THEN 0.0 ELSE least({c}, 1.0) END"
ORACLE |= {
    "hist_hapaxes": f"WITH {TRAINED}, b AS (SELECT least(floor({_RAW_FW} * 20), 19)::INT AS bin, good, spam FROM wl, tot WHERE NOT starts_with(token, '.')) "
    + " UNION ALL ".join(f"SELECT round(i / 20.0, 6)::DOUBLE AS score, count(bin) AS count, round(count(bin) * 100.0 / (SELECT count(*) FROM b WHERE NOT ({w})), 6)::DOUBLE AS pct, '{name}' AS without FROM range(20) r(i) LEFT JOIN (SELECT * FROM b WHERE NOT ({w})) x ON x.bin = r.i GROUP BY i" for name, w in _WITHOUT.items()),
    "r_table": f"WITH {TRAINED}, {sql_rated(P)}, {sql_scores('rated', P)} SELECT id AS doc_id, token, good + bad AS n, round(good / mg::DOUBLE, 6) AS pgood, round(bad / ms::DOUBLE, 6) AS pbad, round(fw, 6) AS fw, CASE WHEN used THEN '+' ELSE '-' END AS flag, round(ln(greatest(1 - fw, 1e-300)), 6) AS invfwlog, round(ln(greatest(fw, 1e-300)), 6) AS fwlog FROM rated UNION ALL SELECT id, NULL, n, round(p, 6), round(q, 6), round(s, 6), '=', {P.robs!r}, {P.robx!r} FROM scored",
    "explain_order": f"WITH {TRAINED}, {sql_rated(P)} SELECT id AS doc_id, token, row_number() OVER (PARTITION BY id ORDER BY round(fw, 9), token) AS place, row_number() OVER (PARTITION BY id ORDER BY token) AS place_by_token FROM rated",
    # exponents of one half: n degrees of freedom of half the sums, so 2 * y is the statistic with y halved
    "classify_esf": f"WITH {TRAINED}, {sql_rated(ESF)}, sums AS (SELECT id, coalesce(sum(CASE WHEN used THEN -ln(1 - fw) END), 0) / 2 AS yi, coalesce(sum(CASE WHEN used THEN -ln(fw) END), 0) / 2 AS yf, count(*) FILTER (used) AS n FROM rated GROUP BY id), t AS (SELECT id, n, {sql_half_tail('yi', 'n')} AS p0, {sql_half_tail('yf', 'n')} AS q0 FROM sums), pq AS (SELECT id, n, {_FLUSH('p0')} AS p, {_FLUSH('q0')} AS q FROM t), v AS (SELECT *, CASE WHEN n = 0 THEN {ESF.robx!r} WHEN p = 0 AND q = 0 THEN 0.5 ELSE q / (q + p) END AS s FROM pq) SELECT id AS doc_id, n AS n_used, round(p, 6) AS p_value, round(q, 6) AS q_value, round(s, 6) AS spamicity, CASE WHEN s >= 0.99 THEN 'Spam' WHEN s <= 0.45 THEN 'Ham' ELSE 'Unsure' END AS status FROM v",
}


def _sql_trained_on_error(rounds: int, parts: int) -> str:
    """Step by step: a batch is scored with the counts so far, and what is wrong or unsure is added."""
    steps = ["wl_0(token, spam, good) AS (SELECT '', 0, 0 WHERE FALSE)", "tot_0(ms, mg) AS (SELECT 0, 0)"]
    for k in range(rounds * parts):
        turn, part = divmod(k, parts)
        here = f"floor(('0x' || substr(md5('{turn}:' || id), 1, 8))::UBIGINT * {parts} / 4294967296.0) = {part}"
        rated = sql_rated(P).replace("FROM tok LEFT JOIN wl USING (token), tot)", f"FROM (SELECT tok.* FROM tok JOIN lab USING (id) WHERE {here}) tok LEFT JOIN wl_{k} wl USING (token), tot_{k})")
        steps += [
            f"s_{k} AS (WITH {rated}, {sql_scores('rated', P)} SELECT id, status FROM scored)",
            f"e_{k} AS MATERIALIZED (SELECT id, is_spam FROM lab JOIN s_{k} USING (id) WHERE status <> CASE WHEN is_spam THEN 'Spam' ELSE 'Ham' END)",
            f"wl_{k + 1} AS MATERIALIZED (SELECT token, sum(spam)::BIGINT AS spam, sum(good)::BIGINT AS good FROM (SELECT * FROM wl_{k} UNION ALL SELECT token, CASE WHEN is_spam THEN 1 ELSE 0 END, CASE WHEN is_spam THEN 0 ELSE 1 END FROM tok JOIN e_{k} USING (id)) GROUP BY token)",
            f"tot_{k + 1} AS MATERIALIZED (SELECT ms + (SELECT count(*) FILTER (is_spam) FROM e_{k}) AS ms, mg + (SELECT count(*) FILTER (NOT is_spam) FROM e_{k}) AS mg FROM tot_{k})",
        ]
    return f"WITH {TOK}, {LAB}, {', '.join(steps)} SELECT * FROM wl_{rounds * parts}"


ORACLE["train_on_error"] = _sql_trained_on_error(2, 3)
