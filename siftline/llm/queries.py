"""The pN_ queries of this package and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from siftline.common import checkpoint, fresh_dir, read
from siftline.llm import distinctive, garbled, key_forms, markup, mix, near_dup, pack, split, term_counts


def _p1_store(spark: SparkSession, sf_dir: str) -> term_counts.TermStore:
    """The whole table in two loads: one half of the messages, then the other as a delta, merged."""
    return term_counts.load_and_update(read(spark, sf_dir, "msgcounts"), F.xxhash64("msg_id") >= 0)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys held by fewer than 3 messages, or by more than 40 % of them."""
    return term_counts.marked(_p1_store(spark, sf_dir)).where("mark is not null").select(F.col("term").alias("key"), "mark")


def _p1_columns(marked: DataFrame) -> DataFrame:
    return marked.select(F.col("term").alias("key"), "good", "bad", "occurrences", F.col("records").alias("messages"), "mark")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key with its registered good and bad, occurrences, messages and mark."""
    return _p1_columns(term_counts.marked(_p1_store(spark, sf_dir)))


def p1_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a history: of an earlier state a third of the messages was missing, a third held other counts, and some messages were there that are gone now."""
    now = read(spark, sf_dir, "msgcounts").select("msg_id", "key", "freq", "bad", "good", "msgs_bad", "msgs_good")
    kind = F.pmod(F.xxhash64("msg_id"), F.lit(3))
    other = now.where(kind == 1).withColumns({"freq": F.col("freq") + 2, "bad": F.col("bad") + 5, "msgs_bad": F.col("msgs_bad") + 100_000, "key": F.when(F.col("freq") == 1, F.concat("key", F.lit("~"))).otherwise(F.col("key"))})
    gone = now.where(kind == 2).withColumns({"msg_id": F.concat("msg_id", F.lit("-gone")), "msgs_good": F.col("msgs_good") + 200_000})
    before = term_counts.record_terms(now.where(kind == 2).unionByName(other).unionByName(gone))
    after = term_counts.record_terms(now)
    store = term_counts.TermStore(spark, fresh_dir(spark, "terms")).apply(term_counts.signed_changes(None, before))
    store.apply(term_counts.signed_changes(before, after)).compact()
    return _p1_columns(term_counts.marked(store))


def _p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.find_garbled(read(spark, sf_dir, "mime_parts"), "part_id", "msg").where("garbled").withColumnRenamed("id", "part_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose text, or some portion of it, was decoded with the wrong charset."""
    return _p2(spark, sf_dir).select("part_id")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those parts with the chain found and, where it can be had, the original text."""
    return _p2(spark, sf_dir).select("part_id", "written_in", "read_as", "restored")


def _p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_markup(read(spark, sf_dir, "mime_parts"), "part_id", "msg").withColumnRenamed("id", "part_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose text holds a piece of HTML, Markdown, wiki or LaTeX markup."""
    return _p4(spark, sf_dir).where("html + markdown + wiki + latex > 0").select("part_id")


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of every part, with its numbers of blocks by what they hold."""
    n = lambda kind: F.size(F.filter("blocks", lambda b: b["kind"] == kind)).alias(f"n_{kind}")
    return _p4(spark, sf_dir).select("part_id", "clean", n("heading"), n("item"), n("code"), n("formula"), n("row"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of wordlist entries whose keys look the same and differ in characters."""
    pairs = key_forms.look_alike_pairs(read(spark, sf_dir, "wordlist"))
    return pairs.select(F.col("a").alias("entry_id_a"), F.col("b").alias("entry_id_b"))


def p5_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct key of msgcounts with its one form."""
    return key_forms.key_forms(read(spark, sf_dir, "msgcounts")).select("key", "form", "repaired")


def p5_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different keys of the wordlist by what made them one: base forms, the script-aware repair, or the shape class for the rest."""
    return key_forms.key_pairs(read(spark, sf_dir, "wordlist")).groupBy("step").agg(F.count("*").alias("n_pairs"))


def _p6(spark: SparkSession, sf_dir: str) -> near_dup.NearDuplicates:
    return near_dup.near_duplicates(read(spark, sf_dir, "mime_parts"), "part_id", "msg", threshold=0.6, min_words=20, features=near_dup.word_hashes)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts whose sets of words have a similarity of at least 0.6."""
    return near_dup.expanded(_p6(spark, sf_dir)).select(F.col("a").alias("part_id_a"), F.col("b").alias("part_id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near duplicates of every part of at least 20 words, and its number of similar classes."""
    return near_dup.groups(_p6(spark, sf_dir)).withColumnRenamed("id", "part_id")


def p7_distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each key of each message under the message's parsimonious model."""
    scored = distinctive.distinctiveness(read(spark, sf_dir, "msgcounts"))
    return scored.select(F.col("record").alias("msg_id"), F.col("term").alias("key"), "freq", F.round("score", 9).alias("score"))


def _setting(spark: SparkSession, sf_dir: str, *names: str) -> list[int]:
    rows = read(spark, sf_dir, "params").where(F.col("param_name").isin(*names)).collect()
    values = {r["param_name"]: int(r["param_value"]) for r in rows}
    return [values[n] for n in names]


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document, or piece of an oversized one, lies, for both capacities."""
    sizes = _setting(spark, sf_dir, "pack_capacity", "pack_capacity_small")
    return pack.pack(read(spark, sf_dir, "documents"), sizes).withColumnRenamed("id", "doc_id")


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity the documents placed, containers above the capacity, documents whose pieces do not follow one another, and documents split though they fit."""
    packed = p8_pack(spark, sf_dir)
    over = packed.groupBy("capacity", "container").agg(F.sum("n_tokens").alias("held")).groupBy("capacity").agg(F.count_if(F.col("held") > F.col("capacity")).alias("overfull"))
    docs = packed.groupBy("capacity", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.count("*").alias("pieces"), F.countDistinct("token_start").alias("starts"))
    loose = (F.col("n") != F.col("end")) | (F.col("pieces") != F.col("starts"))
    split_ = (F.col("pieces") > 1) & (F.col("n") <= F.col("capacity"))
    sums = docs.groupBy("capacity").agg(F.count("*").alias("n_docs"), F.count_if(loose).alias("loose"), F.count_if(split_).alias("needless"))
    return sums.join(F.broadcast(over), "capacity").select("capacity", "n_docs", "overfull", "loose", "needless")


def p8_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill and similarity of texts within containers, along the curve and in a random order."""
    sizes, docs = _setting(spark, sf_dir, "pack_capacity", "pack_capacity_small"), read(spark, sf_dir, "documents")
    curve, shuffled = (pack.locality(checkpoint(pack.pack(docs, sizes, shuffled=x)), docs).withColumn("order", F.lit(name)) for x, name in ((False, "curve"), (True, "random")))
    return curve.unionByName(shuffled)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the mixture and how often each is used: the largest one that has the target shares, so the exponent is 0."""
    m = mix.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))
    return m.used.withColumnRenamed("id", "doc_id")


def _shares(m: mix.Mixture) -> DataFrame:
    return m.report.withColumns({"exponent": F.lit(m.plan.exponent), "total": F.lit(int(m.plan.total)).cast("long")})


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each named source, and the exponent."""
    return _shares(mix.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets")))


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a mixture of half as many tokens again, for which repetition limits bind: the exponent is bisected."""
    docs, targets = read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets")
    return _shares(mix.mix(docs, targets, stretch=1.5))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source of the mixture whether it keeps its repetition limit and has the target share among the sources that have documents, to half a percent."""
    docs, targets = read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets")
    m = mix.mix(docs, targets)
    held = docs.where("source is not null and text <> ''").select("source").distinct()
    named = targets.join(F.broadcast(held), "source", "left_semi")  # a table of settings
    whole = named.agg(F.sum("target_share").alias("whole"))
    used = m.used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens"), F.max("n_uses").alias("most"))
    every = used.agg(F.sum("tokens").alias("every"))
    rows = named.join(used, "source", "left").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(every))  # one row each
    met = F.abs(F.col("tokens") / F.col("every") - F.col("target_share") / F.col("whole")) < 0.005
    return rows.select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("limit_kept"), F.coalesce(met, F.lit(False)).alias("share_met"))


def p10_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document put together again from its pieces without their overlaps, and whether all pieces keep the limit."""
    limit = _setting(spark, sf_dir, "split_limit")[0]
    pieces = p10_split(spark, sf_dir)
    before = F.lag("char_end", 1, 0).over(W.partitionBy("doc_id").orderBy("piece"))
    own = pieces.withColumn("_before", before).withColumn("own", F.substring("text", F.greatest(F.col("_before") - F.col("char_start"), F.lit(0)) + 1, F.length("text")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece", "own"))), lambda x: x["own"])  # the pieces of one document
    return own.groupBy("doc_id").agg(F.array_join(parts, "").alias("text"), (F.max("n_tokens") <= limit).alias("within_limit"))


def p10_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document."""
    limit, overlap = _setting(spark, sf_dir, "split_limit", "split_overlap")
    return split.split_texts(read(spark, sf_dir, "documents"), limit, overlap).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_updated, p2_found, p2_restored, p4_found, p4_clean, p5_found, p5_keys, p5_reach, p6_found, p6_groups, p7_distinctive, p8_pack, p8_kept, p8_locality, p9_mix, p9_shares, p9_tempered, p9_kept, p10_split, p10_rebuilt)}

_P1 = """
WITH t AS (
  SELECT msg_id, nullif(key, '') AS key, max(greatest(coalesce(freq, 0), 0)) AS freq,
    max({'total': greatest(coalesce(msgs_bad, 0), 0) + greatest(coalesce(msgs_good, 0), 0), 'bad': greatest(coalesce(bad, 0), 0), 'good': greatest(coalesce(good, 0), 0)}) AS r
  FROM msgcounts WHERE msg_id IS NOT NULL GROUP BY 1, 2),
n AS (SELECT count(DISTINCT msg_id) AS n FROM msgcounts),
c AS (SELECT key, max(r) AS r, sum(freq)::BIGINT AS occurrences, count(*) AS messages FROM t WHERE key IS NOT NULL GROUP BY key),
m AS (SELECT key, r.good AS good, r.bad AS bad, occurrences, messages,
  CASE WHEN messages < 3 THEN 'rare' WHEN messages > 0.4 * (SELECT n FROM n) THEN 'common' END AS mark FROM c)
"""

ORACLE = {
    "p1_found": _P1 + "SELECT key, mark FROM m WHERE mark IS NOT NULL",
    "p1_counts": _P1 + "SELECT * FROM m",
    "p1_updated": _P1 + "SELECT * FROM m",
}

# the same letters as in key_forms, composed ones with marks added; full-width forms lie at a fixed distance
_FROM = "".join(key_forms.LATIN_TWIN) + "\u0451\u0401\u0457\u0407" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_TO = "".join(key_forms.LATIN_TWIN.values()) + "\u00eb\u00cb\u00ef\u00cf" + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_TO = _TO.replace("'", "''")
_SHAPE = f"trim(regexp_replace(regexp_replace(translate(nfc_normalize(key), '{_FROM}', '{_TO}'), '[\\x{{00AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'), '[\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\s]', ' ', 'g'))"

ORACLE |= {
    "p5_found": f"WITH s AS (SELECT entry_id, key, nfc_normalize({_SHAPE}) AS shape FROM wordlist WHERE key IS NOT NULL) SELECT a.entry_id AS entry_id_a, b.entry_id AS entry_id_b FROM s a JOIN s b ON a.shape = b.shape AND a.entry_id < b.entry_id AND a.key <> b.key",
    "p6_found": """WITH w AS (SELECT DISTINCT part_id, unnest(regexp_extract_all(lower(msg), '[\\p{L}\\p{N}]{3,}')) AS word FROM mime_parts),
      n AS (SELECT part_id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 20),
      s AS (SELECT a.part_id AS x, b.part_id AS y, count(*) AS shared FROM w a JOIN w b ON a.word = b.word AND a.part_id < b.part_id GROUP BY 1, 2)
      SELECT x AS part_id_a, y AS part_id_b FROM s JOIN n nx ON nx.part_id = x JOIN n ny ON ny.part_id = y WHERE shared >= 0.6 * (nx.n + ny.n - shared)""",
    "p7_distinctive": f"""WITH RECURSIVE t AS (
        SELECT msg_id, key, max(greatest(coalesce(freq, 1), 1)) AS freq, max(greatest(coalesce(bad, 0), 0) + greatest(coalesce(good, 0), 0)) AS held,
          max(CASE WHEN msgs_bad IS NOT NULL AND msgs_good IS NOT NULL THEN greatest(msgs_bad, 0) + greatest(msgs_good, 0) END) AS total
        FROM msgcounts WHERE msg_id IS NOT NULL AND key <> '' GROUP BY 1, 2),
      top AS (SELECT max(total) AS top FROM t),
      k AS (SELECT key, max({{'total': coalesce(total, -1), 'held': held}}) AS m FROM t GROUP BY 1),
      z AS (SELECT sum(CASE WHEN m.total < 0 THEN 0.5 / (top + 1) ELSE (m.held + 0.5) / (m.total + 1) END) AS mass FROM k, top),
      b AS (SELECT msg_id, key, freq, (held + 0.5) / (coalesce(total, max(total) OVER (PARTITION BY msg_id), top) + 1) / mass AS b FROM t, top, z),
      em AS (SELECT 0 AS i, msg_id, key, freq, b, freq / sum(freq) OVER (PARTITION BY msg_id) AS p FROM b
        UNION ALL SELECT i + 1, msg_id, key, freq, b, e / sum(e) OVER (PARTITION BY msg_id) FROM (SELECT *, freq * {distinctive.OWN_WEIGHT} * p / ({distinctive.OWN_WEIGHT} * p + {1 - distinctive.OWN_WEIGHT} * b) AS e FROM em WHERE i < {distinctive.ITERATIONS}))
      SELECT msg_id, key, freq::BIGINT AS freq, round(p, 9) AS score FROM em WHERE i = {distinctive.ITERATIONS}""",
}

ORACLE |= {
    "p9_kept": "SELECT source, TRUE AS limit_kept, TRUE AS share_met FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE text <> '')",
    "p8_kept": "SELECT c AS capacity, (SELECT count(*) FROM documents) AS n_docs, 0 AS overfull, 0 AS loose, 0 AS needless FROM (SELECT param_value::INT AS c FROM params WHERE param_name IN ('pack_capacity', 'pack_capacity_small'))",
    "p10_rebuilt": "SELECT doc_id, coalesce(text, '') AS text, TRUE AS within_limit FROM documents",
}

ORACLE["p6_groups"] = """WITH RECURSIVE w AS MATERIALIZED (SELECT DISTINCT part_id, unnest(regexp_extract_all(lower(msg), '[\\p{L}\\p{N}]{3,}')) AS word FROM mime_parts),
      n AS (SELECT part_id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 20),
      s AS (SELECT a.part_id AS x, b.part_id AS y, count(*) AS shared FROM w a JOIN w b ON a.word = b.word AND a.part_id < b.part_id GROUP BY 1, 2),
      p AS MATERIALIZED (SELECT x, y, shared = nx.n + ny.n - shared AS equal FROM s JOIN n nx ON nx.part_id = x JOIN n ny ON ny.part_id = y WHERE shared >= 0.6 * (nx.n + ny.n - shared)),
      e AS MATERIALIZED (SELECT x AS u, y AS v FROM p UNION ALL SELECT y, x FROM p),
      rep AS MATERIALIZED (SELECT part_id, least(part_id, coalesce((SELECT min(x) FROM p WHERE equal AND y = part_id), part_id)) AS rep FROM n),
      reach AS (SELECT part_id AS a, part_id AS b FROM n UNION SELECT a, v FROM reach JOIN e ON u = b),
      g AS (SELECT a, min(b) AS group_id FROM reach GROUP BY 1),
      pairs_ AS (SELECT ru.rep AS r, rv.rep AS o FROM e JOIN rep ru ON ru.part_id = u JOIN rep rv ON rv.part_id = v WHERE ru.rep <> rv.rep),
      k AS (SELECT r, count(DISTINCT o) AS n_links FROM pairs_ GROUP BY 1)
      SELECT rep.part_id, group_id, coalesce(n_links, 0) AS n_links FROM rep JOIN g ON g.a = rep.part_id LEFT JOIN k ON k.r = rep.rep"""
