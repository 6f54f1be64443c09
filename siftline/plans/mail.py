"""Queries over messages, parts, count files and wordlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from siftline.common import checkpoint, fresh_dir, read
from siftline.functions import decode, mime
from siftline.functions.prob import token_probability
from siftline.operators import render, score, stats, tokenize, tune, wordlist
from siftline.params import Params, from_table
from siftline.plans import corpus
from siftline.plans.corpus import KEEP, RE_IP, RE_TOKEN, RE_WORD, sql_classify, sql_fw, sql_scores, sql_tail
from siftline.sources import mailstores, tables
from siftline.streaming.auto_update import AutoUpdate, token_ages

P = Params()


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- tokens of mail ---------------------------------------------------------------------------------


def header_tokens(spark, sf_dir):
    """Tagged header tokens and how many headers of a message hold them."""
    rows = tokenize.header_tokens(read(spark, sf_dir, "messages"), "msg_id", "raw", P)
    return rows.groupBy(F.col("id").alias("msg_id"), "token").agg(F.count("*").alias("n"))


def message_tokens(spark, sf_dir):
    return tokenize.message_tokens(read(spark, sf_dir, "messages"), "msg_id", "raw", P).withColumnRenamed("id", "msg_id")


def message_attributes(spark, sf_dir):
    return tokenize.attributes(read(spark, sf_dir, "messages"), "msg_id", "raw").withColumnRenamed("id", "msg_id")


def ip_subnets(spark, sf_dir):
    """Messages per address of the texts, and per its subnets."""
    found = tokenize.tokens(read(spark, sf_dir, "documents"), "doc_id", "text", P)
    nets = found.where(tokenize.is_ip(F.col("token"))).select("id", F.explode(tokenize.subnets(F.col("token"))).alias("net")).distinct()
    return nets.groupBy("net").agg(F.count("*").alias("n_docs"))


def html_tokens(spark, sf_dir):
    """Tokens of parts declared as HTML, tags resolved."""
    parts = read(spark, sf_dir, "mime_parts").where(mime.normal_type(F.col("mime_type")) == "html")
    found = parts.select("part_id", F.explode(tokenize.token_array(decode.html_text(F.col("msg")), P)).alias("token"))
    return found.groupBy("part_id", "token").agg(F.count("*").alias("n"))


def html_entities(spark, sf_dir):
    rows = read(spark, sf_dir, "mime_parts").where(F.col("msg").contains("&#"))
    return rows.select("part_id", decode.numeric_entities(F.col("msg")).alias("msg"))


def url_escapes(spark, sf_dir):
    """The URLs of all parts with their escapes resolved."""
    urls = F.explode(F.regexp_extract_all("msg", F.lit(r"https?:(//[^\s<>\"]+)"), F.lit(1))).alias("url")
    return read(spark, sf_dir, "mime_parts").select("part_id", urls).select("part_id", decode.percent_escapes(F.col("url")).alias("url")).distinct()


def part_kinds(spark, sf_dir):
    kind, enc = mime.normal_type(F.col("mime_type")), mime.normal_encoding(F.col("mime_encoding"))
    return read(spark, sf_dir, "mime_parts").groupBy(kind.alias("kind"), enc.alias("encoding")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("msg"), F.lit(0))).alias("chars"))


def _mime_messages(spark, sf_dir) -> DataFrame:
    """msg_id, raw: the decoded parts of each mail written as a MIME message again: base64 of UTF-8 and of UTF-16, quoted-printable, some within a message of their own, beside a part that is no text."""
    parts = read(spark, sf_dir, "mime_parts").where("msg is not null and msg_id is not null")
    way = F.pmod("part_id", F.lit(3))
    wide = F.encode("msg", "UTF-16BE")
    quoted = F.regexp_replace(F.regexp_replace(F.hex(F.encode("msg", "UTF-8")), "(..)", "=$1"), "((?:=..){24})", "$1=\n")
    body = F.when(way == 0, F.base64(F.encode("msg", "UTF-8"))).when(way == 1, F.base64(wide)).otherwise(quoted)
    kind = F.when(mime.normal_type(F.col("mime_type")) == "html", "text/html").otherwise("text/plain")
    head = F.concat(F.lit("Content-Type: "), kind, F.lit("; charset="), F.when(way == 1, "utf-16be").otherwise("utf-8"), F.lit("\nContent-Transfer-Encoding: "), F.when(way == 2, "quoted-printable").otherwise("base64"), F.lit("\n\n"))
    nested = F.when(F.pmod("part_id", F.lit(5)) == 0, F.lit("Content-Type: message/rfc822\n\nTo: inner\n")).otherwise(F.lit(""))
    one = parts.select("msg_id", F.struct("part_no", "part_id", F.concat(F.lit("--=_part\n"), nested, head, F.regexp_replace(body, "\r\n", "\n"), F.lit("\n")).alias("text")).alias("part"))
    texts = F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"])  # the parts of one mail
    subject = F.concat(F.lit("Subject: =?utf-8?B?"), F.base64(F.encode(F.concat(F.lit("Grüße "), F.lit("wegen Teilen")), "UTF-8")), F.lit("?=\nContent-Type: multipart/mixed; boundary=\"=_part\"\n\npreamble here\n"))
    picture = F.lit("--=_part\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\naW1hZ2Ugd29yZHM=\n--=_part--\nepilogue\n")
    return one.groupBy("msg_id").agg(F.concat(subject, F.array_join(texts, ""), picture).alias("raw"))


def mime_roundtrip(spark, sf_dir):
    """The text parts of the generated MIME messages, decoded: type, encoding, depth and text as they were written."""
    rows = mime.readable(mime.explode_parts(_mime_messages(spark, sf_dir), "msg_id", "raw"))
    return rows.select(F.col("id").alias("msg_id"), "depth", "parent_type", "mime_type", "mime_encoding", "msg")


def mime_tokens(spark, sf_dir):
    """Tokens of the generated MIME messages."""
    return tokenize.message_tokens(_mime_messages(spark, sf_dir), "msg_id", "raw", P).withColumnRenamed("id", "msg_id")


def classify_messages(spark, sf_dir):
    """Whole messages scored with the counts registered for their tokens (those at the largest totals)."""
    c = wordlist.clamp
    rows = read(spark, sf_dir, "msgcounts").where("key <> ''").select(F.col("key").alias("token"), *[c(F.col(n)).alias(n) for n in ("good", "bad", "msgs_good", "msgs_bad")])
    known = rows.groupBy("token").agg(F.max(F.struct(F.col("msgs_good") + F.col("msgs_bad"), "bad", "good")).alias("m")).select("token", F.col("m.good").alias("good"), F.col("m.bad").alias("spam"))
    top = rows.agg(F.max(F.struct(F.col("msgs_good") + F.col("msgs_bad"), "msgs_bad", "msgs_good")).alias("m")).first()["m"]
    found = tokenize.message_tokens(read(spark, sf_dir, "messages"), "msg_id", "raw", P)
    counted = score.with_counts(found, known, top["msgs_good"] if top else 0, top["msgs_bad"] if top else 0)
    return _rounded(score.scores(score.rated(counted, MULTI), MULTI).withColumnRenamed("id", "msg_id"), "p_value", "q_value", "spamicity")


def message_parts(spark, sf_dir):
    """The part tree of every message, decoded."""
    rows = mime.explode_parts(read(spark, sf_dir, "messages"), "msg_id", "raw")
    return rows.select(F.col("id").alias("msg_id"), "part_no", "depth", "mime_type", F.length("msg").alias("chars"))


def decoded_headers(spark, sf_dir):
    """Subjects written as encoded words, base64 or quoted, two words a subject, and read again."""
    rows = read(spark, sf_dir, "documents").where("subject is not null and subject not like '%\\n%'").select("doc_id", "subject")
    half = F.greatest(F.floor(F.length("subject") / 2), F.lit(1)).cast("int")

    def word(part):
        raw = F.encode(part, "UTF-8")
        return F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("=?utf-8?B?"), F.regexp_replace(F.base64(raw), "\r\n", ""), F.lit("?="))).otherwise(F.concat(F.lit("=?UTF-8?q?"), F.regexp_replace(F.hex(raw), "(..)", "=$1"), F.lit("?=")))

    both = F.concat(word(F.substring("subject", F.lit(1), half)), F.lit("\n\t"), word(F.substring("subject", half + 1, F.length("subject"))))
    return rows.select("doc_id", decode.decoded_words(both).alias("subject"))


def without_nonascii(spark, sf_dir):
    return read(spark, sf_dir, "msgcounts").where("key is not null").select(wordlist.fold_nonascii(F.col("key")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# --- pre-joined counts ------------------------------------------------------------------------------


def _counted(spark, sf_dir) -> DataFrame:
    """id, token, good, bad, msgs_good, msgs_bad of the count file; rows without key go, totals as the message has them."""
    c = wordlist.clamp
    rows = read(spark, sf_dir, "msgcounts").where("key <> '' and msg_id is not null")
    rows = rows.select(F.col("msg_id").alias("id"), F.col("key").alias("token"), c(F.col("good")).alias("good"), c(F.col("bad")).alias("bad"), c(F.col("msgs_good")).alias("msgs_good"), c(F.col("msgs_bad")).alias("msgs_bad"))
    return rows.groupBy("id", "token").agg(*[F.max(n).alias(n) for n in ("good", "bad", "msgs_good", "msgs_bad")])


def classify_msgcounts(spark, sf_dir):
    """Scores from the pre-joined counts, with the parameters of the table."""
    p = from_table(read(spark, sf_dir, "params"))
    return _rounded(score.scores(score.rated(_counted(spark, sf_dir), p), p).withColumnRenamed("id", "msg_id"), "p_value", "q_value", "spamicity")


def msgcount_roundtrip(spark, sf_dir):
    """Written as count-file lines and read back."""
    lines = tables.count_lines(_counted(spark, sf_dir))
    order = F.struct("seq", "token")
    back = tables.parse_count_lines(lines, "id", order)
    return back.select(F.col("file").alias("msg_id"), "token", "bad", "good", "msgs_bad", "msgs_good")


# --- wordlists --------------------------------------------------------------------------------------


#: The day on which rows without a date are loaded.
TODAY = 20260101


def _loaded(spark, sf_dir) -> DataFrame:
    return wordlist.load(read(spark, sf_dir, "wordlist"), "key", "spam", "good", "date_ymd", "entry_id", today=TODAY)


def wordlist_load(spark, sf_dir):
    """All dumps loaded into one table."""
    return _loaded(spark, sf_dir)


def wordlist_merge(spark, sf_dir):
    """Regular lists only, summed."""
    regular = read(spark, sf_dir, "registry").where("list_type = 'r'").select("list_name")
    return wordlist.load(read(spark, sf_dir, "wordlist").join(F.broadcast(regular), "list_name", "left_semi"), "key", "spam", "good", "date_ymd", "entry_id", today=TODAY)


def legacy_merge(spark, sf_dir):
    """A spam list and a good list of old, joined."""
    rows = read(spark, sf_dir, "wordlist").where("key is not null and list_name in ('base', 'legacy')")
    one = lambda name, n: rows.where(F.col("list_name") == name).groupBy(F.col("key").alias("token")).agg(F.sum(wordlist.clamp(F.col(n))).alias("n"))
    return wordlist.full_merge(one("legacy", "spam"), one("base", "good"))


def maint_count(spark, sf_dir):
    return wordlist.expire(_loaded(spark, sf_dir), count=2)


def maint_age(spark, sf_dir):
    return wordlist.expire(_loaded(spark, sf_dir), age=20250101)


def maint_size(spark, sf_dir):
    return wordlist.expire(_loaded(spark, sf_dir), size=(4, 12))


def maint_all(spark, sf_dir):
    return wordlist.expire(_loaded(spark, sf_dir), count=2, age=20250101, size=(4, 12))


def nonascii_fold(spark, sf_dir):
    return wordlist.rekey(_loaded(spark, sf_dir), wordlist.fold_nonascii(F.col("token")))


def convert_encoding(spark, sf_dir):
    """The lists with those of the site written as raw bytes, loaded together and converted to text: keys that meet add up."""
    raw = F.decode(F.encode("key", "UTF-8"), "ISO-8859-1")
    rows = read(spark, sf_dir, "wordlist").withColumn("key", F.when(F.col("list_name") == "site", raw).otherwise(F.col("key")))
    return wordlist.convert_encoding(wordlist.load(rows, "key", "spam", "good", "date_ymd", "entry_id", max_token_len=4096, today=TODAY))


def registry_lists(spark, sf_dir):
    """The registry with each list named twice and one once more at another priority: lists that are the same are met once."""
    rows = read(spark, sf_dir, "registry")
    return wordlist.distinct_lists(rows.unionByName(rows).unionByName(rows.where("list_name = 'base'").withColumn("priority", F.lit(9))))


def store_changes(spark, sf_dir):
    """A stored table after a change, its undoing and a new whole one in between: loading the lists one after another equals loading them together."""
    rows = read(spark, sf_dir, "wordlist").where(wordlist.is_count(F.col("key")))
    store = tables.CountStore(spark, fresh_dir(spark, "counts"), compact_every=2)
    parts = [rows.where(F.pmod("entry_id", F.lit(3)) == k).groupBy(F.col("key").alias("token")).agg(F.sum(wordlist.clamp(F.col("spam"))).alias("spam"), F.sum(wordlist.clamp(F.col("good"))).alias("good")) for k in range(3)]
    for k, part in enumerate(parts):
        store.change(part, TODAY + k)
        store.change(parts[0], TODAY)
        store.change(parts[0], TODAY, sign=-1)
    store.purge()
    return store.read().where("token <> ''").select("token", "spam", "good")


def upgrade_prefix(spark, sf_dir):
    return wordlist.upgrade_prefix(_loaded(spark, sf_dir))


def wordlist_dump(spark, sf_dir):
    return tables.dump_lines(_loaded(spark, sf_dir))


def dump_roundtrip(spark, sf_dir):
    """Dumped and loaded again; tokens without blanks at their ends come back as they were."""
    kept = _loaded(spark, sf_dir).where(F.col("token").rlike(r"^\S(.*\S)?$") & (F.octet_length("token") >= 3))
    return tables.parse_dump(tables.dump_lines(kept)).select("token", "spam", "good", "date")


def bytes_before(spark, sf_dir):
    """Offsets of the dump's meta rows, dumps of the lists one after another by entry."""
    rows = read(spark, sf_dir, "wordlist").where("key is not null").select("list_name", "entry_id", F.col("key").alias("value"))
    return tables.starting_with(rows.withColumn("file", F.col("list_name")), "file", "entry_id", ".")


def _totals(spark, sf_dir) -> DataFrame:
    """Message totals of each list: its .MSG_COUNT rows added up."""
    rows = read(spark, sf_dir, "wordlist").where("key = '.MSG_COUNT'")
    return rows.groupBy("list_name").agg(F.sum(wordlist.clamp(F.col("spam"))).alias("msgs_spam"), F.sum(wordlist.clamp(F.col("good"))).alias("msgs_good"))


def _multi(spark, sf_dir, p: Params) -> DataFrame:
    tokens = read(spark, sf_dir, "msgcounts").where("key <> '' and msg_id is not null").select(F.col("msg_id").alias("id"), F.col("key").alias("token")).distinct()
    lists = read(spark, sf_dir, "wordlist").where("key is not null").select("list_name", F.col("key").alias("token"), "spam", "good")
    return score.rated(wordlist.combined_lists(tokens, lists, read(spark, sf_dir, "registry"), _totals(spark, sf_dir)), p)


MULTI = Params(min_dev=0.1)


def multi_list_tokens(spark, sf_dir):
    """Counts of every message's tokens over all lists, ignore lists respected."""
    rows = score.explain(_multi(spark, sf_dir, MULTI)).withColumnRenamed("id", "msg_id")
    return _rounded(rows, "pgood", "pbad", "fw")


def multi_list_score(spark, sf_dir):
    return _rounded(score.scores(_multi(spark, sf_dir, MULTI), MULTI).withColumnRenamed("id", "msg_id"), "p_value", "q_value", "spamicity")


# --- rendering --------------------------------------------------------------------------------------


def _scored_messages(spark, sf_dir):
    p = from_table(read(spark, sf_dir, "params"))
    counted = _counted(spark, sf_dir)
    scored = score.scores(score.rated(counted, p), p).withColumn("spamicity", F.round("spamicity", 6))
    sizes = counted.groupBy("id").agg(F.count("*").alias("n_tokens"))
    attributes = tokenize.attributes(read(spark, sf_dir, "messages"), "msg_id", "raw")
    return scored.join(sizes, "id").join(attributes, "id"), p


def format_headers(spark, sf_dir):
    rows, p = _scored_messages(spark, sf_dir)
    f = render.fields(p)
    line = lambda t: render.render(t, f)
    return rows.select(F.col("id").alias("msg_id"), line("%h: %c, tests=bayes, spamicity=%p").alias("header"), line("%.1c %d %f").alias("terse"), line("id=%I queue=%Q from=%A tokens=%w %e %%").alias("log"))


def format_directives(spark, sf_dir):
    """The other directives, with widths and precisions."""
    rows, p = _scored_messages(spark, sf_dir)
    dates = read(spark, sf_dir, "messages").select(F.col("msg_id").alias("id"), F.coalesce("ingested_at", "received_at").alias("at"))
    rows = rows.join(dates, "id").withColumn("n_messages", F.lit(3))
    f = render.fields(p, log_tag="night", run_type="s", user="mail", date=F.col("at"))
    return rows.select(F.col("id").alias("msg_id"), render.render("%D %l %r %u %m %v", f).alias("line"), render.render("%g|%.8g|%-8c|%8c|%.3c|%9.3f|%.2o", f).alias("numbers"))


def pass_through(spark, sf_dir):
    """Messages with their new score header; spam and unsure ones tagged in the subject."""
    rows, p = _scored_messages(spark, sf_dir)
    f = render.fields(p)
    tag = F.when(F.col("status") == p.tags[0], "[spam]").when(F.col("status") == p.tags[2], "[unsure]")
    both = rows.join(read(spark, sf_dir, "messages").select(F.col("msg_id").alias("id"), "raw"), "id")
    out = render.pass_through(F.col("raw"), render.render("%h: %c, tests=bayes, spamicity=%p", f), tag)
    return both.select(F.col("id").alias("msg_id"), out.alias("raw"))


# --- tuning -----------------------------------------------------------------------------------------

def _tuning(spark, sf_dir):
    """(tokens of the scored documents with the counts of the training ones, robx, target): the labelled documents, split."""
    lab = corpus.labels(spark, sf_dir)
    n = lab.agg(F.count_if(~F.col("is_spam")).alias("g"), F.count_if("is_spam").alias("s")).first()
    roles = checkpoint(tune.split_for_tuning(lab, n["g"], n["s"]))
    found = corpus.doc_tokens(spark, sf_dir)
    t = corpus.trained(spark, sf_dir, roles.where("role = 'train'").select("id", "is_spam"))
    mean = stats.robx(t.table, t.msgs_spam, t.msgs_good).first()["robx"]
    robx = round(min(max(P.robx if mean is None else mean, 0.4), 0.6), 12)
    truth = roles.where("role = 'score'").select("id", "is_spam")
    rows = tune.by_message(score.with_counts(found.join(truth.select("id"), "id", "left_semi"), t.table, t.msgs_good, t.msgs_spam, t.size), truth)
    first = tune.grid_scores(rows, tune.Grid((P.robs,), (0.02,), (robx,)))
    return rows, robx, tune.threshold(first.where("not is_spam"))[0]


def _coarse(spark, sf_dir):
    rows, robx, target = _tuning(spark, sf_dir)
    grid = tune.coarse_grid(robx)
    return rows, grid, checkpoint(tune.grid_results(rows, grid, target)), target


def tune_grid(spark, sf_dir):
    """The coarse scan: every cell of all five dimensions."""
    return _rounded(_coarse(spark, sf_dir)[2], "cutoff", "robs", "robx", "sp_esf", "ns_esf")


def tune_topten(spark, sf_dir):
    """The ten best cells."""
    _, _, results, target = _coarse(spark, sf_dir)
    return tune.best_cells(results, target).select("idx", "fp", "fn", F.round("cutoff", 6).alias("cutoff"))


def tune_smooth_min(spark, sf_dir):
    """The cell chosen for its neighbourhood."""
    _, grid, results, target = _coarse(spark, sf_dir)
    return tune.smooth_minimum(results, grid, target).select("idx", "smooth", "fp", "fn", F.round("cutoff", 6).alias("cutoff"))


def tune_fine(spark, sf_dir):
    """The recommended parameters: the best cell of the fine grid around the coarse scan's choice."""
    rows, grid, results, target = _coarse(spark, sf_dir)
    best = tune.smooth_minimum(results, grid, target).first()
    if best is None:
        return results.limit(0)
    at = dict(zip(("sp_exp", "ns_exp"), (grid.sp_exp[best["spi"]], grid.ns_exp[best["nsi"]])))
    fine = tune.fine_grid(Params(robs=best["robs"], min_dev=best["min_dev"], robx=best["robx"]), **at)
    return tune.smooth_minimum(tune.grid_results(rows, fine, target), fine, target)


def tune_split(spark, sf_dir):
    """How many labelled documents train and how many score, in three bins."""
    lab = corpus.labels(spark, sf_dir)
    n = lab.agg(F.count_if(~F.col("is_spam")).alias("g"), F.count_if("is_spam").alias("s")).first()
    return tune.split_for_tuning(lab, n["g"], n["s"]).groupBy("is_spam", "role", "bin").agg(F.count("*").alias("n"))


def tune_quality(spark, sf_dir):
    """Whether many good documents score high or many spam ones low."""
    return _rounded(tune.quality_checks(corpus.labelled_scores(spark, sf_dir).withColumn("spamicity", F.round("spamicity", 9))), "score")


def prior_checks(spark, sf_dir):
    """What speaks against tuning with the labelled documents."""
    roles = tune_split(spark, sf_dir)
    n = {(r["is_spam"], r["role"]): r["n"] for r in roles.groupBy("is_spam", "role").agg(F.sum("n").alias("n")).collect()}
    said = stats.prior_checks(*(n.get(k, 0) for k in ((False, "train"), (True, "train"), (False, "score"), (True, "score"))))
    return spark.createDataFrame([(x,) for x in said], "warning string")


def cutoff_for_fp_target(spark, sf_dir):
    """Cutoffs at one false positive per so many good documents."""
    return _rounded(tune.recommended_cutoffs(corpus.labelled_scores(spark, sf_dir).withColumn("spamicity", F.round("spamicity", 9))), "cutoff")


# --- streams and tables of other shape --------------------------------------------------------------


def stream_auto_update(spark, sf_dir):
    """Documents as a stream of two batches, even ids before odd ones: each scored against the counts so far, clear ones registered. Scores of all."""
    t = corpus.trained(spark, sf_dir)
    path = fresh_dir(spark, "auto-update")
    update = AutoUpdate(spark, path, P, compact_every=1).start(t.table, t.msgs_spam, t.msgs_good)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    for batch in (0, 1):
        docs.where(F.pmod("id", F.lit(2)) == batch).withColumn("batch", F.lit(batch)).write.parquet(f"{path}/arrived/{batch}")
        update.run(spark.readStream.schema("id long, text string").parquet(f"{path}/arrived/{batch}"), batch)
    return _rounded(update.scores().select(F.col("id").alias("doc_id"), "n_used", "spamicity", "status"), "spamicity")


def token_age(spark, sf_dir):
    """First and last delivery of each sender, and how often it wrote, from the messages as a stream."""
    path = fresh_dir(spark, "ages")
    rows = read(spark, sf_dir, "messages").where("sender is not null and received_at is not null")
    rows.select(F.col("sender").alias("token"), F.col("received_at").cast("timestamp").alias("ts")).write.parquet(f"{path}/in")
    ages = token_ages(spark.readStream.schema("token string, ts timestamp").parquet(f"{path}/in"), late="100000 days")
    ages.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("token", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")], "n")


def mbox_split(spark, sf_dir):
    """All messages written as mailboxes and read again, with their numbers counted per mailbox."""
    head = F.concat(F.lit("From sender "), F.col("msg_id"), F.lit("\n"))
    body = F.regexp_replace(F.regexp_replace("raw", "\r\n", "\n"), "(?m)^From ", ">From ")
    path = fresh_dir(spark, "mailboxes")
    read(spark, sf_dir, "messages").where("raw is not null").select(F.concat(head, F.regexp_replace(body, r"\n+\z", ""), F.lit("\n"))).write.text(path)  # a text row ends its line: an empty one between messages
    found = mailstores.numbered(mailstores.mbox(spark, path))
    last = found.groupBy("source").agg(F.max("number").alias("last"), F.countDistinct("number").alias("n"))
    whole = last.agg(F.min((F.col("last") == F.col("n")).cast("int")).alias("counted"))
    return found.crossJoin(F.broadcast(whole)).select(F.regexp_extract("raw", r"^From sender (\S+)", 1).alias("msg_id"), "raw", (F.col("counted") == 1).alias("counted"))  # one row


QUERIES = {
    f.__name__: f
    for f in (
        header_tokens, message_tokens, message_attributes, ip_subnets, html_tokens, html_entities, url_escapes, part_kinds, message_parts, mime_roundtrip, mime_tokens, classify_messages, decoded_headers, without_nonascii,
        classify_msgcounts, msgcount_roundtrip, wordlist_load, wordlist_merge, legacy_merge, maint_count, maint_age, maint_size, maint_all, nonascii_fold, upgrade_prefix, wordlist_dump,
        dump_roundtrip, bytes_before, multi_list_tokens, multi_list_score, format_headers, format_directives, pass_through, tune_grid, tune_topten, tune_smooth_min, tune_fine, tune_split, tune_quality, prior_checks, cutoff_for_fp_target,
        stream_auto_update, token_age, mbox_split, convert_encoding, registry_lists, store_changes,
    )
}

# --- the same in SQL --------------------------------------------------------------------------------
_LOAD = "wl AS (SELECT key AS token, sum(greatest(coalesce(spam, 0), 0))::BIGINT AS spam, sum(greatest(coalesce(good, 0), 0))::BIGINT AS good, arg_max(CASE WHEN coalesce(date_ymd, 0) = 0 THEN 20260101 ELSE date_ymd END, entry_id) AS date FROM wordlist WHERE strlen(key) BETWEEN 1 AND 255 AND (key NOT LIKE '.%' OR key IN ('.MSG_COUNT', '.ENCODING')) {} GROUP BY key)"
LOAD = _LOAD.format("")
_FOLD = "list_aggregate(list_transform(string_split(token, ''), lambda c: CASE WHEN strlen(c) > 1 THEN repeat('?', strlen(c)) ELSE c END), 'string_agg', '')"
_COUNTED = "counted AS (SELECT msg_id AS id, key AS token, max(greatest(coalesce(good, 0), 0)) AS good, max(greatest(coalesce(bad, 0), 0)) AS bad, max(greatest(coalesce(msgs_good, 0), 0)) AS mg, max(greatest(coalesce(msgs_bad, 0), 0)) AS ms FROM msgcounts WHERE key <> '' AND msg_id IS NOT NULL GROUP BY 1, 2)"


def _sql_rated(p: Params) -> str:
    return f"rated AS (SELECT *, abs(fw - 0.5) > {p.min_dev!r} AS used FROM (SELECT *, {sql_fw('good', 'bad', 'mg', 'ms', p)} AS fw FROM counted))"


_HEAD = r"""m AS (SELECT msg_id, regexp_split_to_array(replace(raw, chr(13) || chr(10), chr(10)) || chr(10), '\n[ \t]*\n')[1] AS head FROM messages),
h AS (SELECT msg_id, unnest(regexp_extract_all(head, '(?m)^[^\s:]+:[^\n]*(?:\n[ \t][^\n]*)*')) AS line FROM m),
hh AS (SELECT msg_id, regexp_extract(line, '^([^\s:]+):', 1) AS written, regexp_extract(line, '(?s)^[^\s:]+:(.*)$', 1) AS value FROM h WHERE lower(regexp_extract(line, '^([^\s:]+):', 1)) <> 'x-bogosity'),"""
# The tags of headers, the headers of which only the name counts, what is skipped in header values.
_HEADER_TOKENS = f"""{_HEAD}
t AS (SELECT *, CASE lower(written) WHEN 'to' THEN 'to:' WHEN 'cc' THEN 'to:' WHEN 'from' THEN 'from:' WHEN 'return-path' THEN 'rtrn:' WHEN 'subject' THEN 'subj:' WHEN 'received' THEN 'rcvd:' END AS tag FROM hh),
u AS (SELECT msg_id, coalesce(tag, 'head:') AS tag, unnest(regexp_extract_all(written, '{RE_WORD}')) AS token FROM t WHERE tag IS NULL
  UNION ALL SELECT msg_id, coalesce(tag, 'head:'), unnest(regexp_extract_all(regexp_replace(value, '(?i)boundary=[ ]*"?[^\\s";]*"?|(?:file)?name="?|[ \\t]id\\s+<?[A-Za-z0-9.\\-]+>?', ' ', 'g'), '{RE_TOKEN}')) FROM t
    WHERE lower(written) NOT IN ('date', 'delivery-date', 'message-id', 'resent-message-id', 'in-reply-to', 'references')),
ht AS (SELECT msg_id, token FROM (SELECT msg_id, CASE WHEN regexp_full_match(token, '{RE_IP}') THEN 'ip:' ELSE tag END || token AS token FROM u WHERE {KEEP}) WHERE strlen(token) <= 30)"""

_MULTI = f"""totals AS (SELECT list_name, sum(greatest(coalesce(spam, 0), 0)) AS ms, sum(greatest(coalesce(good, 0), 0)) AS mg FROM wordlist WHERE key = '.MSG_COUNT' GROUP BY 1),
lists AS (SELECT list_name, list_type = 'i' AS ign, row_number() OVER (ORDER BY priority, list_name) AS r, coalesce(ms, 0) AS ms, coalesce(mg, 0) AS mg FROM registry LEFT JOIN totals USING (list_name)),
tok AS (SELECT DISTINCT msg_id AS id, key AS token FROM msgcounts WHERE key <> '' AND msg_id IS NOT NULL),
ent AS (SELECT key AS token, r, ign, sum(greatest(coalesce(spam, 0), 0)) AS spam, sum(greatest(coalesce(good, 0), 0)) AS good FROM wordlist JOIN lists USING (list_name) GROUP BY ALL),
stop AS (SELECT token, min(r) FILTER (ign) AS stop FROM ent GROUP BY 1),
hit AS (SELECT token, stop, CASE WHEN stop IS NULL THEN sum(spam) FILTER (NOT ign) ELSE 0 END AS bad, CASE WHEN stop IS NULL THEN sum(good) FILTER (NOT ign) ELSE 0 END AS good FROM ent JOIN stop USING (token) GROUP BY 1, 2),
counted AS (SELECT id, token, coalesce(good, 0)::BIGINT AS good, coalesce(bad, 0)::BIGINT AS bad, coalesce((SELECT sum(l.mg) FROM lists l WHERE hit.stop IS NULL OR l.r < hit.stop), 0)::BIGINT AS mg, coalesce((SELECT sum(l.ms) FROM lists l WHERE hit.stop IS NULL OR l.r < hit.stop), 0)::BIGINT AS ms, stop IS NOT NULL AS ignored FROM tok LEFT JOIN hit USING (token))"""

ORACLE = {
    "header_tokens": f"WITH {_HEADER_TOKENS} SELECT msg_id, token, count(*) AS n FROM ht GROUP BY ALL",
    "ip_subnets": f"WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{RE_TOKEN}')) AS token FROM documents), o AS (SELECT doc_id, list_transform(string_split(token, '.'), lambda x: (x::INT % 256)::VARCHAR) AS o FROM t WHERE regexp_full_match(token, '{RE_IP}')), n AS (SELECT DISTINCT doc_id, array_to_string(o[1:k], '.') AS net FROM o, range(1, 5) r(k)) SELECT net, count(*) AS n_docs FROM n GROUP BY net",
    "part_kinds": "SELECT CASE WHEN t IS NULL OR t = '' OR starts_with(t, 'text') THEN CASE WHEN starts_with(t, 'text/html') THEN 'html' ELSE 'text' END WHEN regexp_matches(t, '^(multipart|message|application|image|audio|video)/') THEN split_part(t, '/', 1) ELSE 'other' END AS kind, CASE WHEN e IN ('quoted-printable', 'base64', 'x-uuencode') THEN e ELSE 'identity' END AS encoding, count(*) AS n, sum(coalesce(length(msg), 0))::BIGINT AS chars FROM (SELECT msg, lower(trim(regexp_replace(mime_type, ';.*$', ''))) AS t, lower(trim(mime_encoding)) AS e FROM mime_parts) GROUP BY ALL",
    "without_nonascii": f"SELECT {_FOLD.replace('token', 'key')} AS token, count(*) AS n FROM msgcounts WHERE key IS NOT NULL GROUP BY 1",
    "msgcount_roundtrip": f"WITH {_COUNTED} SELECT id AS msg_id, token, bad, good, max(ms) OVER (PARTITION BY id) AS msgs_bad, max(mg) OVER (PARTITION BY id) AS msgs_good FROM counted",
    "wordlist_load": f"WITH {LOAD} SELECT * FROM wl",
    "wordlist_merge": f"WITH {_LOAD.format('AND list_name IN (SELECT list_name FROM registry WHERE list_type = ' + chr(39) + 'r' + chr(39) + ')')} SELECT * FROM wl",
    "legacy_merge": "WITH s AS (SELECT key AS token, sum(greatest(coalesce(spam, 0), 0)) AS spam FROM wordlist WHERE list_name = 'legacy' AND key IS NOT NULL GROUP BY 1), g AS (SELECT key AS token, sum(greatest(coalesce(good, 0), 0)) AS good FROM wordlist WHERE list_name = 'base' AND key IS NOT NULL GROUP BY 1) SELECT token, coalesce(spam, 0)::BIGINT AS spam, coalesce(good, 0)::BIGINT AS good FROM s FULL JOIN g USING (token)",
    "maint_count": f"WITH {LOAD} SELECT * FROM wl WHERE starts_with(token, '.') OR spam > 2 OR good > 2",
    "maint_age": f"WITH {LOAD} SELECT * FROM wl WHERE starts_with(token, '.') OR date > 20250101",
    "maint_size": f"WITH {LOAD} SELECT * FROM wl WHERE starts_with(token, '.') OR strlen(token) BETWEEN 4 AND 12",
    "maint_all": f"WITH {LOAD} SELECT * FROM wl WHERE starts_with(token, '.') OR spam > 2 OR good > 2 OR date > 20250101 OR strlen(token) BETWEEN 4 AND 12",
    "nonascii_fold": f"WITH {LOAD} SELECT {_FOLD} AS token, sum(spam)::BIGINT AS spam, sum(good)::BIGINT AS good, max(date) AS date FROM wl GROUP BY 1",
    "upgrade_prefix": f"WITH {LOAD} SELECT CASE WHEN starts_with(token, 'url:') THEN 'ip:' || token[5:] ELSE token END AS token, spam, good, date FROM wl",
    "wordlist_dump": f"WITH {LOAD} SELECT token || ' ' || spam || ' ' || good || CASE WHEN date > 0 THEN ' ' || date ELSE '' END AS value FROM wl",
    "dump_roundtrip": rf"WITH {LOAD} SELECT * FROM wl WHERE regexp_matches(token, '^\S(.*\S)?$') AND strlen(token) >= 3",
    "bytes_before": "SELECT o AS \"offset\", key AS value FROM (SELECT key, coalesce(sum(strlen(key) + 1) OVER (PARTITION BY list_name ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM wordlist WHERE key IS NOT NULL) WHERE starts_with(key, '.')",
    "multi_list_tokens": f"WITH {_MULTI}, {_sql_rated(MULTI)} SELECT id AS msg_id, token, good + bad AS n, round(CASE WHEN mg > 0 THEN good / mg::DOUBLE ELSE 0 END, 6) AS pgood, round(CASE WHEN ms > 0 THEN bad / ms::DOUBLE ELSE 0 END, 6) AS pbad, round(fw, 6) AS fw, CASE WHEN ignored THEN 'i' WHEN used THEN '+' ELSE '-' END AS flag FROM rated",
    "multi_list_score": f"WITH {_MULTI}, {_sql_rated(MULTI)}, {sql_scores('rated', MULTI)} SELECT id AS msg_id, n AS n_used, round(p, 6) AS p_value, round(q, 6) AS q_value, round(s, 6) AS spamicity, status FROM scored",
    "classify_msgcounts": f"WITH {_COUNTED}, {_sql_rated(P)}, {sql_scores('rated', P)} SELECT id AS msg_id, n AS n_used, round(p, 6) AS p_value, round(q, 6) AS q_value, round(s, 6) AS spamicity, status FROM scored",
    "token_age": "SELECT sender AS token, min(received_at) AS first_seen, max(received_at) AS last_seen, count(*) AS n FROM messages WHERE sender IS NOT NULL AND received_at IS NOT NULL GROUP BY 1",
    "mbox_split": r"SELECT msg_id, 'From sender ' || msg_id || chr(10) || regexp_replace(regexp_replace(replace(raw, chr(13) || chr(10), chr(10)), '(?m)^From ', '>From ', 'g'), '\n+$', '') || chr(10) AS raw, TRUE AS counted FROM messages WHERE raw IS NOT NULL",
}

# --- more statements, for decoding, rendering and tuning ----------------------------------------------
_LF = "replace(raw, chr(13) || chr(10), chr(10)) || chr(10)"
_BODY_TOKENS = rf"""b AS (SELECT msg_id, regexp_replace(regexp_extract({_LF}, '(?s)^.*?\n[ \t]*\n(.*)$', 1), '(?s)(-----BEGIN PGP SIGNATURE-----\n).*?(-----END PGP SIGNATURE-----|\z)', '\1\2', 'g') AS body FROM messages),
bt AS (SELECT msg_id, token FROM (SELECT msg_id, unnest(regexp_extract_all(body, '{RE_TOKEN}')) AS token FROM b) WHERE {KEEP})"""
_ATTRIBUTES = rf"""l AS (SELECT msg_id, regexp_extract_all(regexp_split_to_array({_LF}, '\n[ \t]*\n')[1], '(?m)^[^\s:]+:[^\n]*(?:\n[ \t][^\n]*)*') AS lines FROM messages),
v AS (SELECT msg_id, array_to_string(list_transform(list_filter(lines, lambda x: regexp_matches(x, '(?i)^received:')), lambda x: regexp_extract(x, '(?s)^[^:]+:(.*)$', 1)), chr(10)) AS received,
  regexp_extract(list_filter(lines, lambda x: regexp_matches(x, '(?i)^message-id:'))[1], '(?s)^[^:]+:(.*)$', 1) AS mid FROM l),
attributes AS (SELECT msg_id, list_filter(regexp_extract_all(received, '\[({RE_IP})\]', 1), lambda a: a <> '127.0.0.1')[1] AS message_addr, trim(regexp_replace(mid, '\s+', ' ', 'g')) AS message_id, nullif(regexp_extract(received, '[ \t]id\s+<?([A-Za-z0-9.\-]+)>?', 1), '') AS queue_id FROM v)"""


def _sql_entities(x: str) -> str:
    number = r"(CASE WHEN regexp_full_match(p, '(?i)&#x[0-9a-f]{1,4};') THEN ('0x' || regexp_extract(p, '(?i)^&#x([0-9a-f]+);$', 1))::INT WHEN regexp_full_match(p, '&#[0-9]{1,5};') THEN regexp_extract(p, '^&#([0-9]+);$', 1)::INT END)"
    return f"(CASE WHEN contains({x}, '&#') THEN array_to_string(list_transform(regexp_extract_all({x}, '(?is)&#(?:[0-9]{{1,5}}|x[0-9a-f]{{1,4}});|[^&]+|&'), lambda p: CASE WHEN {number} BETWEEN 32 AND 126 OR {number} BETWEEN 160 AND 255 THEN chr({number}) ELSE p END), '') ELSE {x} END)"


_BREAK = decode.BREAK_TAGS
_HTML = "msg"
for _pattern, _by in (("(?s)<!--.*?(?:-->|\\z)", ""), ("(?s)<![^>]*>", ""), (f"(?is)({RE_WORD})((?:<(?:a|font)\\s[^>]*>)+)([^\\s<])", "\\2\\1\\3"), ("(?is)<(?:a|img|font)\\s([^>]*)>", " \\1 "), (f"(?is)<(?:{_BREAK})(?:\\s[^>]*)?/?>", " "), ("(?s)<[^>]*>", "")):
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', '{_by}', 'g')"

ORACLE |= {
    "message_tokens": f"WITH {_HEADER_TOKENS}, {_BODY_TOKENS} SELECT msg_id, token FROM ht UNION SELECT msg_id, token FROM bt UNION SELECT msg_id, 'spc:invalid_end_of_header' FROM messages WHERE regexp_extract(replace(raw, chr(13) || chr(10), chr(10)), '(?s)^.*?\\n([ \\t]*)\\n', 1) <> ''",
    "message_attributes": f"WITH {_ATTRIBUTES} SELECT * FROM attributes",
    "html_tokens": f"WITH t AS (SELECT part_id, {_HTML} AS x FROM mime_parts WHERE starts_with(lower(trim(regexp_replace(mime_type, ';.*$', ''))), 'text/html')), e AS (SELECT part_id, {_sql_entities('x')} AS x FROM t), w AS (SELECT part_id, unnest(regexp_extract_all(x, '{RE_TOKEN}')) AS token FROM e) SELECT part_id, token, count(*) AS n FROM w WHERE {KEEP} GROUP BY ALL",
    "html_entities": f"SELECT part_id, {_sql_entities('msg')} AS msg FROM mime_parts WHERE contains(msg, '&#')",
    "format_headers": f"WITH {_COUNTED}, {_sql_rated(P)}, {sql_scores('rated', P)}, {_ATTRIBUTES}, z AS (SELECT id, round(s, 6) AS s, status, (SELECT count(*) FROM counted c WHERE c.id = scored.id) AS w FROM scored) SELECT id AS msg_id, 'X-Bogosity: ' || status || ', tests=bayes, spamicity=' || printf('%.6f', s) AS header, status[1] || ' ' || printf('%.6f', CASE WHEN status = 'Spam' THEN 1 - s ELSE s END) || ' ' || printf('%.6f', s) AS terse, 'id=' || coalesce(message_id, 'UNKNOWN') || ' queue=' || coalesce(queue_id, 'UNKNOWN') || ' from=' || coalesce(message_addr, 'UNKNOWN') || ' tokens=' || w || ' ' || printf('%e', s) || ' %' AS log FROM z JOIN attributes ON id = msg_id",
}

# two batches: the odd documents are scored with the counts of the clear even ones added
_CLEAR = "SELECT id, status = 'Spam' AS is_spam FROM first WHERE id % 2 = 0 AND status <> 'Unsure'"
ORACLE["stream_auto_update"] = f"""WITH {corpus.TRAINED}, {corpus.sql_rated(P)}, {sql_scores('rated', P)}, first AS MATERIALIZED (SELECT * FROM scored), clear AS ({_CLEAR}),
  added AS (SELECT token, count(*) FILTER (is_spam) AS spam, count(*) FILTER (NOT is_spam) AS good FROM tok JOIN clear USING (id) GROUP BY token),
  wl2 AS MATERIALIZED (SELECT token, sum(spam)::BIGINT AS spam, sum(good)::BIGINT AS good FROM (SELECT * FROM wl UNION ALL SELECT * FROM added) GROUP BY token),
  tot2 AS (SELECT ms + (SELECT count(*) FILTER (is_spam) FROM clear) AS ms, mg + (SELECT count(*) FILTER (NOT is_spam) FROM clear) AS mg FROM tot),
  second AS (WITH {corpus.sql_rated(P).replace('LEFT JOIN wl USING (token), tot)', 'LEFT JOIN wl2 wl USING (token), tot2)')}, {sql_scores('rated', P)} SELECT * FROM scored)
  SELECT id AS doc_id, n AS n_used, round(s, 6) AS spamicity, status FROM first WHERE id % 2 = 0 UNION ALL SELECT id, n, round(s, 6), status FROM second WHERE id % 2 = 1"""
ORACLE |= {
    "convert_encoding": "WITH w AS (SELECT key AS token, sum(greatest(coalesce(spam, 0), 0))::BIGINT AS spam, sum(greatest(coalesce(good, 0), 0))::BIGINT AS good, arg_max(CASE WHEN coalesce(date_ymd, 0) = 0 THEN 20260101 ELSE date_ymd END, entry_id) AS date, list_name = 'site' AND regexp_matches(key, '[^\\x00-\\x7f]') AS raw FROM wordlist WHERE strlen(key) >= 1 AND (key NOT LIKE '.%' OR key = '.MSG_COUNT') GROUP BY key, raw) SELECT token, sum(spam)::BIGINT AS spam, sum(good)::BIGINT AS good, max(date) AS date FROM w GROUP BY token UNION ALL SELECT '.ENCODING', 2, 0, max(date) FROM w",
    "registry_lists": "SELECT * FROM registry UNION ALL SELECT list_type, list_name, file_name, 9 FROM registry WHERE list_name = 'base'",
    "store_changes": "SELECT * FROM (SELECT key AS token, sum(greatest(coalesce(spam, 0), 0))::BIGINT AS spam, sum(greatest(coalesce(good, 0), 0))::BIGINT AS good FROM wordlist WHERE key <> '' AND (key NOT LIKE '.%' OR key IN ('.MSG_COUNT', '.ENCODING')) GROUP BY key) WHERE spam > 0 OR good > 0",
}

_READABLE = "CASE WHEN starts_with(lower(trim(regexp_replace(mime_type, ';.*$', ''))), 'text/html') THEN 'text/html' ELSE 'text/plain' END"
_DEEP = "part_id % 5 = 0"
_NEW_TOKENS = ["subj:Grüße", "subj:wegen", "subj:Teilen", "head:Content-Type", "head:multipart", "head:mixed", "mime:Content-Type", "mime:image", "mime:png", "mime:Content-Transfer-Encoding", "mime:base64", "preamble", "here", "epilogue"]
_PLAIN = r"regexp_replace(msg, '(?s)(-----BEGIN PGP SIGNATURE-----\n).*?(-----END PGP SIGNATURE-----|\z)', '\1\2', 'g')"
ORACLE |= {
    "mime_roundtrip": f"SELECT msg_id, CASE WHEN {_DEEP} THEN 2 ELSE 1 END AS depth, CASE WHEN {_DEEP} THEN 'message/rfc822' ELSE 'multipart/mixed' END AS parent_type, {_READABLE} AS mime_type, CASE WHEN part_id % 3 = 2 THEN 'quoted-printable' ELSE 'base64' END AS mime_encoding, msg FROM mime_parts WHERE msg IS NOT NULL AND msg_id IS NOT NULL",
    "mime_tokens": f"""WITH p AS (SELECT part_id, msg_id, msg, {_READABLE} AS kind FROM mime_parts WHERE msg IS NOT NULL AND msg_id IS NOT NULL),
      t AS (SELECT msg_id, {_HTML} AS x FROM p WHERE kind = 'text/html'), e AS (SELECT msg_id, {_sql_entities('x')} AS x FROM t UNION ALL SELECT msg_id, {_PLAIN} FROM p WHERE kind <> 'text/html'),
      w AS (SELECT msg_id, unnest(regexp_extract_all(x, '{RE_TOKEN}')) AS token FROM e),
      f AS (SELECT msg_id, unnest({_NEW_TOKENS!r}) AS token FROM p),
      g AS (SELECT msg_id, CASE WHEN {_DEEP} THEN '' ELSE 'mime:' END AS tag, unnest(['Content-Type', 'text', kind[6:], 'charset', CASE WHEN part_id % 3 = 1 THEN 'utf-16be' ELSE 'utf-8' END, 'Content-Transfer-Encoding', CASE WHEN part_id % 3 = 2 THEN 'quoted-printable' ELSE 'base64' END]) AS token FROM p),
      h AS (SELECT msg_id, unnest(['inner', 'mime:message', 'mime:rfc822']) AS token FROM p WHERE {_DEEP})
      SELECT msg_id, token FROM w WHERE {KEEP} UNION SELECT * FROM f UNION SELECT msg_id, tag || token FROM g UNION SELECT * FROM h""",
    "classify_messages": f"""WITH {_HEADER_TOKENS}, {_BODY_TOKENS}, tok AS (SELECT msg_id, token FROM ht UNION SELECT msg_id, token FROM bt UNION SELECT msg_id, 'spc:invalid_end_of_header' FROM messages WHERE regexp_extract(replace(raw, chr(13) || chr(10), chr(10)), '(?s)^.*?\\n([ \\t]*)\\n', 1) <> ''),
      r AS (SELECT key, greatest(coalesce(good, 0), 0) AS good, greatest(coalesce(bad, 0), 0) AS bad, greatest(coalesce(msgs_good, 0), 0) AS mg, greatest(coalesce(msgs_bad, 0), 0) AS ms FROM msgcounts WHERE key <> ''),
      k AS (SELECT key AS token, max({{'t': mg + ms, 'b': bad, 'g': good}}) AS m FROM r GROUP BY 1), top AS (SELECT max({{'t': mg + ms, 'ms': ms, 'mg': mg}}) AS m FROM r),
      counted AS (SELECT tok.msg_id AS id, tok.token, coalesce(k.m.g, 0) AS good, coalesce(k.m.b, 0) AS bad, top.m.mg AS mg, top.m.ms AS ms FROM tok LEFT JOIN k USING (token), top), {_sql_rated(MULTI)}, {sql_scores('rated', MULTI)}
      SELECT id AS msg_id, n AS n_used, round(p, 6) AS p_value, round(q, 6) AS q_value, round(s, 6) AS spamicity, status FROM scored""",
}

# tuning: the split by digits of MD5, the coarse grid around the mean spam share, chi-square tails of any degrees of freedom
_SHARE = "(SELECT 1 - 1 / (1 + 4 - 3 * least(greatest((n - 2500) / 1500.0, 0), 1)) FROM (SELECT count(*) AS n FROM lab l WHERE l.is_spam = lab.is_spam))"
_SPLIT = f"{corpus.TOK}, {corpus.LAB}, split AS (SELECT id, is_spam, CASE WHEN ('0x' || substr(md5(id::VARCHAR), 1, 8))::UBIGINT < {_SHARE} * 4294967296 THEN 'train' ELSE 'score' END AS role, ('0x' || substr(md5(id::VARCHAR), 9, 4))::INT % 3 AS bin FROM lab)"


def sql_gamma_tail(a: str, x: str) -> str:
    """Q(a, x) for a > 0: Q of the fractional part by quadrature, then the finite sum; every term is positive."""
    m, f = f"(ceil({a}) - 1)", f"({a} - ceil({a}) + 1)"
    first = f"(exp(-({x}) - lgamma({f})) * 0.25 * list_sum(list_transform(range(-240, 21), lambda k: exp(-exp(k * 0.25)) * pow({x} + exp(k * 0.25), {f} - 1) * exp(k * 0.25))))"
    rest = f"coalesce(list_sum(list_transform(range({m}::BIGINT), lambda k: exp(({f} + k) * ln({x}) - ({x}) - lgamma({f} + k + 1)))), 0)"
    return f"(CASE WHEN {x} <= 0 THEN 1.0 WHEN {first} + {rest} < 2.220446049250313e-16 THEN 0.0 ELSE least({first} + {rest}, 1.0) END)"


_CELL_FW = "(CASE WHEN good + bad > 0 THEN (robs * robx + (good + bad) * (CASE WHEN bad::DOUBLE * mg + good::DOUBLE * ms > 0 THEN bad::DOUBLE * mg / (bad::DOUBLE * mg + good::DOUBLE * ms) ELSE robx END)) / (robs + (good + bad)) ELSE robx END)"
_COARSE = f"""{_SPLIT},
wl AS (SELECT token, count(*) FILTER (is_spam) AS spam, count(*) FILTER (NOT is_spam) AS good FROM tok JOIN split USING (id) WHERE role = 'train' GROUP BY token),
tot AS (SELECT count(*) FILTER (is_spam) AS ms, count(*) FILTER (NOT is_spam) AS mg FROM split WHERE role = 'train' AND id IN (SELECT id FROM tok)),
counted AS MATERIALIZED (SELECT id, is_spam, token, coalesce(good, 0) AS good, coalesce(spam, 0) AS bad, mg, ms FROM tok JOIN split USING (id) LEFT JOIN wl USING (token), tot WHERE role = 'score'),
mean AS (SELECT round(least(greatest(coalesce(avg(spam / (good * (ms::DOUBLE / mg) + spam)), 0.52), 0.4), 0.6), 12) AS x FROM wl, tot WHERE good + spam >= 10 AND NOT starts_with(token, '.')),
rs(rsi, robs) AS (VALUES (0, 1.0::DOUBLE), (1, 0.1), (2, 0.01)), md(mdi, min_dev) AS (VALUES (0, 0.05::DOUBLE), (1, 0.15), (2, 0.25), (3, 0.35), (4, 0.45)),
rx AS (SELECT (row_number() OVER (ORDER BY o) - 1)::INT AS rxi, round(x + d, 12) AS robx FROM mean, (VALUES (0, 0.0::DOUBLE), (1, -0.05), (2, 0.05), (3, -0.1), (4, 0.1)) v(o, d) WHERE x + d BETWEEN 0.4 - 1e-9 AND 0.6 + 1e-9),
combo AS (SELECT rsi, mdi, rxi, robs, min_dev, robx FROM rs, md, rx UNION ALL SELECT -1, -1, -1, {P.robs!r}, 0.02, x FROM mean),
ex AS (SELECT k::INT AS e, pow(0.75, 2 + 3 * k) AS factor FROM range(7) r(k)), ex1 AS (SELECT * FROM ex UNION ALL SELECT -1, 1.0),
cw AS (SELECT rsi, mdi, rxi, id, is_spam, robx, {_CELL_FW} AS fw, min_dev FROM counted, combo),
cs AS MATERIALIZED (SELECT rsi, mdi, rxi, id, is_spam, robx, coalesce(sum(-ln(1 - fw)) FILTER (abs(fw - 0.5) > min_dev), 0) AS yi, coalesce(sum(-ln(fw)) FILTER (abs(fw - 0.5) > min_dev), 0) AS yf, count(*) FILTER (abs(fw - 0.5) > min_dev) AS n FROM cw GROUP BY ALL),
ct AS MATERIALIZED (SELECT rsi, mdi, rxi, id, is_spam, robx, n, e, CASE WHEN n = 0 THEN 1.0 ELSE {sql_gamma_tail('(n * factor)', '(yi * factor)')} END AS p, CASE WHEN n = 0 THEN 1.0 ELSE {sql_gamma_tail('(n * factor)', '(yf * factor)')} END AS q FROM cs, ex1 WHERE (rsi < 0) = (e < 0)),
cell AS MATERIALIZED (SELECT a.rsi, a.mdi, a.rxi, a.e AS spi, b.e AS nsi, a.id, a.is_spam, round(CASE WHEN a.n = 0 THEN a.robx WHEN a.p = 0 AND b.q = 0 THEN 0.5 ELSE b.q / (a.p + b.q) END, 9) AS s FROM ct a JOIN ct b USING (rsi, mdi, rxi, id)),
good0 AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS r, count(*) OVER () AS n FROM cell WHERE rsi < 0 AND NOT is_spam),
aim AS (SELECT greatest(1, trunc((-0.4831 * ln(n) + 12.8976) * ln(n) - 61.5264 + 0.5)::BIGINT) AS t FROM good0 LIMIT 1),
low AS (SELECT coalesce(max(r) FILTER (s >= 0.55), 1) AS t FROM good0, aim WHERE r <= aim.t),
target AS (SELECT CASE WHEN s > 0.975 THEN (SELECT count(*) FROM good0 WHERE s > 0.975) ELSE r END AS target FROM good0, low WHERE r = low.t),
ranked AS (SELECT rsi, mdi, rxi, spi, nsi, s, row_number() OVER w AS r, count(*) OVER (PARTITION BY rsi, mdi, rxi, spi, nsi) AS n FROM cell WHERE rsi >= 0 AND NOT is_spam WINDOW w AS (PARTITION BY rsi, mdi, rxi, spi, nsi ORDER BY s DESC)),
cut AS (SELECT rsi, mdi, rxi, spi, nsi, coalesce(max(s) FILTER (r >= target AND s < 0.999999), min(s)) AS cutoff, coalesce(min(r) FILTER (r >= target AND s < 0.999999), max(n))::INT AS fp FROM ranked, target GROUP BY ALL),
fns AS (SELECT rsi, mdi, rxi, spi, nsi, cutoff, fp, count(*) FILTER (is_spam AND s < cutoff) AS fn FROM cell JOIN cut USING (rsi, mdi, rxi, spi, nsi) GROUP BY ALL),
res AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY rsi, mdi, rxi, spi, nsi) - 1)::INT AS idx, * FROM fns)"""
_LABELLED = f"WITH {corpus.TRAINED}, {corpus.sql_rated(P)}, {sql_scores('rated', P)}, b AS MATERIALIZED (SELECT round(s, 9) AS s, is_spam FROM scored JOIN lab USING (id))"
ORACLE |= {
    "tune_split": f"WITH {_SPLIT} SELECT is_spam, role, bin, count(*) AS n FROM split GROUP BY ALL",
    "tune_quality": f"{_LABELLED}, o AS (SELECT is_spam, s, row_number() OVER (PARTITION BY is_spam ORDER BY CASE WHEN is_spam THEN s ELSE -s END) AS r, count(*) OVER (PARTITION BY is_spam) AS n FROM b) SELECT CASE WHEN is_spam THEN 'spam' ELSE 'good' END AS class, r AS at, round(s, 6) AS score, CASE WHEN is_spam THEN s <= 0.10 + 2.220446049250313e-16 ELSE s >= 0.975 END AS suspicious FROM o WHERE r = ceil(n * 0.01)",
    "prior_checks": f"""WITH {_SPLIT}, n AS (SELECT count(*) FILTER (NOT is_spam AND role = 'train') AS g, count(*) FILTER (is_spam AND role = 'train') AS s, count(*) FILTER (NOT is_spam AND role = 'score') AS tg, count(*) FILTER (is_spam AND role = 'score') AS ts FROM split)
      SELECT 'at least 2000 registered messages of each class are needed' AS warning FROM n WHERE g < 2000 OR s < 2000 UNION ALL SELECT 'the classes differ more than tenfold in size' FROM n WHERE g = 0 OR s / g NOT BETWEEN 0.1 AND 10 UNION ALL SELECT 'at least 500 test messages of each class are needed' FROM n WHERE tg < 500 OR ts < 500""",
    "cutoff_for_fp_target": f"{_LABELLED}, g AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS r, count(*) OVER () AS n FROM b WHERE NOT is_spam), c AS (SELECT per, n // per AS fp, s AS cutoff FROM g, (VALUES (10000), (2000), (1000), (500)) v(per) WHERE n >= per AND r = (n + per - 1) // per) SELECT per, round(cutoff, 6) AS cutoff, fp, (SELECT count(*) FROM b WHERE is_spam AND s < c.cutoff) AS fn FROM c",
    "tune_grid": f"WITH {_COARSE} SELECT idx, rsi, mdi, rxi, spi, nsi, round(cutoff, 6) AS cutoff, fp, fn, round(robs, 6) AS robs, min_dev, round(robx, 6) AS robx, round(pow(0.75, 2 + 3 * spi), 6) AS sp_esf, round(pow(0.75, 2 + 3 * nsi), 6) AS ns_esf FROM res JOIN rs USING (rsi) JOIN md USING (mdi) JOIN rx USING (rxi)",
    "tune_topten": f"WITH {_COARSE} SELECT idx, fp, fn, round(cutoff, 6) AS cutoff FROM res, target WHERE fp = target OR NOT EXISTS (SELECT 1 FROM res r WHERE r.fp = target) ORDER BY fn, res.cutoff, idx LIMIT 10",
    "tune_smooth_min": f"""WITH {_COARSE}, ord AS (SELECT fn, row_number() OVER (ORDER BY fn, cutoff, idx) - 1 AS pos, count(*) OVER () AS n FROM res),
      q AS (SELECT max(fn) FILTER (pos = floor(n * 0.50)) AS med, max(fn) FILTER (pos = floor(n * 0.33)) AS third FROM ord),
      nb AS (SELECT a.idx, CASE WHEN b.fp = target THEN b.fn END AS near FROM res a JOIN (VALUES (1, 0, 0, 0, 0), (0, 1, 0, 0, 0), (0, 0, 1, 0, 0), (0, 0, 0, 1, 0), (0, 0, 0, 0, 1)) v(d1, d2, d3, d4, d5) ON TRUE JOIN (VALUES (1), (-1)) s(s) ON TRUE JOIN res b ON b.rsi = a.rsi + s * d1 AND b.mdi = a.mdi + s * d2 AND b.rxi = a.rxi + s * d3 AND b.spi = a.spi + s * d4 AND b.nsi = a.nsi + s * d5 CROSS JOIN target),
      j AS (SELECT idx, bool_and(coalesce(near, 2147483647) < med) AS low, avg(near) AS mean, count(near) AS n, max(third) AS third FROM nb CROSS JOIN q GROUP BY idx)
      SELECT res.idx, (coalesce(low, FALSE) AND n > 0 AND floor(mean) < third) AS smooth, fp, fn, round(cutoff, 6) AS cutoff FROM res JOIN j USING (idx) CROSS JOIN target WHERE fp = target ORDER BY smooth DESC, fn, res.cutoff, res.idx LIMIT 1""",
}

_Z = f"{_COUNTED}, {_sql_rated(P)}, {sql_scores('rated', P)}, z AS (SELECT id, round(s, 6) AS s, status FROM scored)"
ORACLE |= {
    "decoded_headers": "SELECT doc_id, subject FROM documents WHERE subject IS NOT NULL AND subject NOT LIKE '%' || chr(10) || '%'",
    "url_escapes": r"""SELECT DISTINCT part_id, url_decode(url) AS url FROM (SELECT part_id, unnest(regexp_extract_all(msg, 'https?:(//[^\s<>"]+)', 1)) AS url FROM mime_parts)""",
    "message_parts": rf"""WITH t AS (SELECT msg_id, replace(raw, chr(13) || chr(10), chr(10)) AS t FROM messages) SELECT msg_id, 1 AS part_no, 0 AS depth, coalesce(nullif(lower(trim(regexp_extract(regexp_split_to_array(t || chr(10), '\n[ \t]*\n')[1], '(?im)^content-type:([^;\n]*)', 1))), ''), 'text/plain') AS mime_type, length(regexp_extract(t, '(?s)^.*?\n[ \t]*\n(.*)$', 1)) AS chars FROM t""",
    "format_directives": f"""WITH {_Z} SELECT id AS msg_id, strftime(coalesce(ingested_at, received_at), '%Y-%m-%dT%H:%M:%SZ') || ' night s mail 3 1' AS line,
      printf('%g', s) || '|' || printf('%.8g', s) || '|' || rpad(status, greatest(8, length(status))::INT, ' ') || '|' || lpad(status, greatest(8, length(status))::INT, ' ') || '|' || status[1:3] || '|' || printf('%9.3f', s) || '|' || '{P.spam_cutoff:.2f}' AS numbers FROM z JOIN messages ON id = msg_id""",
    "pass_through": rf"""WITH {_Z}, t AS (SELECT msg_id, regexp_replace(replace(raw, chr(13) || chr(10), chr(10)), '(?m)^X-Bogosity[^\n]*\n(?:[ \t][^\n]*\n)*', '', 'g') AS t FROM messages), h AS (SELECT msg_id, t, regexp_extract(t, '^((?:[^\n]+\n?)*)', 1) AS head FROM t)
      SELECT msg_id, CASE WHEN status = 'Ham' THEN head ELSE regexp_replace(head, '(?im)^(subject:)[ ]?', '\1 [' || lower(status) || '] ') END || CASE WHEN head = '' OR head LIKE '%' || chr(10) THEN '' ELSE chr(10) END || 'X-Bogosity: ' || status || ', tests=bayes, spamicity=' || printf('%.6f', s) || chr(10) || CASE WHEN length(t) = length(head) THEN chr(10) ELSE substr(t, length(head) + 1) END AS raw FROM h JOIN z ON id = msg_id""",
}
