"""Tokens of texts and of mail: one regular expression pass in the JVM, lengths in bytes, tags from headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftline.common import let, spread
from siftline.functions.decode import BAD, FRONT, WORD, html_text
from siftline.functions.mime import NAME_ONLY, SKIPPED, TAGS, with_segments
from siftline.operators.wordlist import fold_nonascii
from siftline.params import Params

# IP addresses and amounts.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IP = rf"{OCTET}(?:\.{OCTET}){{3}}"
MONEY = r"\$[0-9]+(?:\.[0-9]+)?"
TOKEN = rf"{IP}|{MONEY}|{WORD}"



def is_ip(token: Column) -> Column:
    """Whether a token is an address: no other token begins with a digit."""
    return (token >= "0") & (token < ":")


def _kept(tokens: Column, p: Params) -> Column:
    """Words within the length limits, amounts within the upper one, every address."""
    size = lambda t: F.octet_length(t)
    return F.filter(tokens, lambda t: is_ip(t) | ((size(t) <= p.max_token_len) & ((size(t) >= p.min_token_len) | t.startswith("$"))))


def token_array(text: Column, p: Params = Params()) -> Column:
    """All tokens of a text in order."""
    return _kept(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), p)


def tokens(df: DataFrame, id_col: str, text_col: str, p: Params = Params(), distinct: bool = True) -> DataFrame:
    """id, token of every text; distinct within the text before exploding, so no shuffle is needed for it."""
    found = token_array(F.col("text"), p)
    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", F.explode(F.array_distinct(found) if distinct else found).alias("token"))


def token_class(token: Column) -> Column:
    return F.when(is_ip(token), "IPADDR").when(token.startswith("$"), "MONEY").otherwise("TOKEN")


def subnets(token: Column) -> Column:
    """An address with its octets below 256, then its prefixes of three, two and one octets; other tokens as they are."""
    octets = F.transform(F.split(token, r"\."), lambda o: F.pmod(o.cast("int"), F.lit(256)).cast("string"))
    return F.when(is_ip(token), F.transform(F.array(*[F.lit(n) for n in (4, 3, 2, 1)]), lambda n: F.array_join(F.slice(octets, F.lit(1), n), "."))).otherwise(F.array(token))


def ngrams(words: Column, n: int) -> Column:
    """Sliding n-grams of an array joined by '*', each token followed by the longer ones that end with it, as struct(pos, size, gram)."""
    def grams(w: Column) -> Column:
        at = lambda i, k: F.struct(i.alias("pos"), k.alias("size"), F.array_join(F.slice(w, i - k + 1, k), "*").alias("gram"))
        ends = F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.least(i, F.lit(n))), lambda k: at(i, k)))
        return F.when(F.size(w) > 0, F.flatten(ends))

    return let(words, grams)


def line_ngrams(df: DataFrame, id_col: str, text_col: str, n: int, p: Params = Params()) -> DataFrame:
    """id, line, pos, size, gram: n-grams within body lines; a line end empties the window."""
    texts = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")))
    lines = texts.select("id", F.posexplode(F.split(F.regexp_replace("t", "\r\n", "\n"), "\n")).alias("line", "text"))
    grams = ngrams(token_array(F.col("text"), p), n)
    return lines.select("id", "line", F.explode(grams).alias("g")).select("id", "line", "g.pos", "g.size", "g.gram")


def normalise_verp(address: Column) -> Column:
    """Bounce addresses with a changing number: everything between the first and the last '-' becomes '#'."""
    return F.regexp_replace(address, r"^([^-@=]*)-.{3,}-([^-=@]*=[^=@]*@.*)$", "$1-#-$2")


def unfolded(raw: Column) -> Column:
    return F.regexp_replace(raw, "\r\n", "\n")


def head_and_body(raw: Column) -> Column:
    """struct(head, body): the first empty line ends the header; no empty line means no body."""
    return let(
        F.split(F.concat(unfolded(raw), F.lit("\n")), r"\n[ \t]*\n|^\n", 2),
        lambda p: F.struct(p[0].alias("head"), F.when(F.size(p) > 1, p[1]).otherwise("").alias("body")),
    )


def headers(head: Column) -> Column:
    """array<struct(name, value)> of a header block, continuation lines joined, earlier score headers left out."""
    lines = F.regexp_extract_all(head, F.lit(r"(?m)^([^\s:]+:[^\n]*(?:\n[ \t][^\n]*)*)"), F.lit(1))
    both = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^\s:]+):", 1).alias("name"), F.regexp_extract(x, r"(?s)^[^\s:]+:(.*)$", 1).alias("value")))
    return F.filter(both, lambda h: F.lower(h["name"]) != "x-bogosity")


def header_tokens(df: DataFrame, id_col: str, raw_col: str, p: Params = Params()) -> DataFrame:
    """id, header_no, name, token: tagged tokens of the headers.

    Names without a tag of their own are tokens too (head:); of some headers only the name counts;
    boundaries, file names and queue ids are skipped; addresses take ip: instead of the tag.
    """
    mails = spread(df.select(F.col(id_col).alias("id"), F.col(raw_col).alias("raw")))
    one = mails.select("id", F.posexplode(headers(head_and_body(F.col("raw"))["head"])).alias("header_no", "h")).select("id", "header_no", F.lower("h.name").alias("name"), F.col("h.name").alias("written"), F.col("h.value").alias("value"))
    tag = F.lit(None).cast("string")
    for name, prefix in TAGS.items():
        tag = F.when(F.col("name") == name, prefix).otherwise(tag)
    value = F.regexp_replace("value", SKIPPED, " ")
    inner = F.when(F.col("name").isin(*NAME_ONLY), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(value, F.lit(TOKEN), F.lit(0)))
    names = F.when(F.col("tag").isNull(), F.regexp_extract_all("written", F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kept = _kept(F.concat(names, inner), p)
    prefixed = F.transform(kept, lambda t: F.when(is_ip(t), F.concat(F.lit("ip:"), t)).otherwise(F.concat(F.coalesce("tag", F.lit("head:")), t)))
    out = one.withColumn("tag", tag).select("id", "header_no", "name", F.explode(prefixed).alias("token"))
    return out.where(F.octet_length("token") <= p.max_token_len)


def body_tokens(df: DataFrame, id_col: str, raw_col: str, p: Params = Params()) -> DataFrame:
    """id, token of the plain body, signatures left out."""
    mails = spread(df.select(F.col(id_col).alias("id"), F.col(raw_col).alias("raw")))
    return mails.select("id", F.explode(token_array(without_signature(head_and_body(F.col("raw"))["body"]), p)).alias("token"))


BAD_HEADER_END = "spc:invalid_end_of_header"


def header_end_tokens(df: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    """id, token: a marker for messages whose header ends with a line that holds blanks."""
    blanks = F.regexp_extract(unfolded(F.col(raw_col)), r"(?s)\A.*?\n([ \t]*)\n", 1)
    return df.where(blanks != "").select(F.col(id_col).alias("id"), F.lit(BAD_HEADER_END).alias("token"))


#: Stands for '#' in bounce addresses until the tokens are cut; no text has it.
_HASH = "\ue000"
_VERP = rf"({FRONT}[^{BAD}\-]*)-[A-Za-z0-9#\-]*[0-9][A-Za-z0-9#\-]*-([^{BAD}\-]*={WORD}@{FRONT})"


def segment_tokens(segment: Column, p: Params = Params()) -> Column:
    """The tokens of one segment of a message in order: addresses with their subnets, n-grams after the token that ends them, tags once before each.

    In headers a bounce address is normalised and n-grams go on over neighbouring headers of one tag; in bodies they end with the line.
    """
    tag, kind, text = segment["tag"], segment["kind"], segment["text"]
    bounce = F.when(text.contains("="), F.regexp_replace(text, _VERP, f"$1-{_HASH}-$2")).otherwise(text)
    plain = F.when(kind == "header", bounce).when(kind == "html", html_text(text)).otherwise(without_signature(text))

    def words(t: Column) -> Column:
        found = F.transform(token_array(t, p), lambda x: F.translate(x, _HASH, "#"))
        if p.replace_nonascii:
            found = F.transform(found, fold_nonascii)
        return F.flatten(F.transform(found, subnets)) if p.block_on_subnets else found

    def prefixed(x: Column) -> Column:
        address = F.lit("ip:" if p.wordlist_version >= 20040500 else "url:")
        return F.when(tag.isNull(), x).when(is_ip(x), F.concat(address, x)).otherwise(F.concat(tag, x))

    if p.multi_token_count < 2:
        return F.filter(F.transform(words(plain), prefixed), lambda x: F.octet_length(x) <= p.max_token_len)
    lines = F.when(kind == "header", F.array(plain)).otherwise(F.split(plain, "\n"))
    grams = F.flatten(F.transform(lines, lambda t: F.coalesce(ngrams(words(t), p.multi_token_count), F.array().cast("array<struct<pos: int, size: int, gram: string>>"))))
    kept = F.filter(F.transform(grams, lambda g: F.struct(g["size"].alias("size"), prefixed(g["gram"]).alias("x"))), lambda g: (g["size"] > 1) | (F.octet_length(g["x"]) <= p.max_token_len))
    return F.transform(kept, lambda g: g["x"])


def token_stream(df: DataFrame, id_col: str, raw_col: str, p: Params = Params()) -> DataFrame:
    """id, tokens: all tokens of every message in order, from its parts decoded (see mime.segments)."""
    rows = with_segments(spread(df.select(id_col, raw_col)), id_col, raw_col, p.header_line_markup)
    return rows.select("id", F.flatten(F.transform("segments", lambda s: segment_tokens(s, p))).alias("tokens"))


def message_tokens(df: DataFrame, id_col: str, raw_col: str, p: Params = Params()) -> DataFrame:
    """Distinct (id, token) of whole messages; distinct within the message before exploding, so without a shuffle."""
    rows = token_stream(df, id_col, raw_col, p).select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    return rows.unionByName(header_end_tokens(df, id_col, raw_col))


def without_signature(text: Column) -> Column:
    """The inside of a PGP signature block is no text."""
    return F.regexp_replace(text, r"(?s)(-----BEGIN PGP SIGNATURE-----\n).*?(-----END PGP SIGNATURE-----|\z)", "$1$2")


def attributes(df: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    """id, message_addr, message_id, queue_id: the first public sender address, the Message-ID value, the first queue id of the Received headers."""
    h = headers(head_and_body(F.col(raw_col))["head"])
    received = F.array_join(F.transform(F.filter(h, lambda x: F.lower(x["name"]) == "received"), lambda x: x["value"]), "\n")
    rows = df.select(F.col(id_col).alias("id"), received.alias("received"), F.get(F.filter(h, lambda x: F.lower(x["name"]) == "message-id"), F.lit(0))["value"].alias("mid"))
    address = F.get(F.filter(F.regexp_extract_all("received", F.lit(rf"\[({IP})\]"), F.lit(1)), lambda a: a != "127.0.0.1"), F.lit(0))
    queue = F.regexp_extract("received", r"[ \t]id\s+<?([A-Za-z0-9.\-]+)>?", 1)
    return rows.select("id", address.alias("message_addr"), F.trim(F.regexp_replace("mid", r"\s+", " ")).alias("message_id"), F.when(queue != "", queue).alias("queue_id"))
