import base64
import binascii
import quopri

import pytest
from pyspark.sql import functions as F

from siftline.functions import decode, mime
from siftline.operators import render, tokenize
from siftline.params import Params
from siftline.sources import mailstores, tables
from siftline.streaming.auto_update import AutoUpdate


def test_decoders():
    text = "Grüße, ein langer Text mit = Zeichen und mehr als sechsundsiebzig Zeichen in einer Zeile.\n".encode()
    assert decode.quoted_printable(quopri.encodestring(text)) == text
    assert decode.quoted_printable(b"a=3Db=zz=\r\nc_d") == b"a=b=zzc_d"
    assert decode.quoted_printable(b"a_b=20", in_header=True) == b"a b "
    assert decode.base64_lines(base64.encodebytes(text)) == text
    assert decode.base64_lines(b"not base64!\n") == b"not base64!\n"
    uu = b"begin 644 x\n" + b"".join(binascii.b2a_uu(text[k : k + 45]) for k in range(0, len(text), 45)) + b"`\nend\n"
    assert decode.uuencoded(uu) == text
    assert decode.encoded_words("=?utf-8?Q?Gr=C3=BC=C3=9Fe?= =?iso-8859-1?B?ZvxyIQ==?= x =?bad") == "Grüßefür! x =?bad"
    assert decode.decode_body(b"\xfc", "8bit", "ISO_8859-1") == "ü"
    assert decode.to_text(b"abc", "no-such-set") == "abc"


def test_column_decoders(spark):
    df = spark.createDataFrame([("&#101;&#x41;b &#7; &#9999; &amp;",), (None,), ("plain",)], "t string")
    assert [r[0] for r in df.select(decode.numeric_entities(F.col("t"))).collect()] == ["eAb &#7; &#9999; &amp;", None, "plain"]
    urls = spark.createDataFrame([("h.test/%61b%zz",), ("h%61/x",), (None,)], "u string")
    assert [r[0] for r in urls.select(decode.percent_escapes(F.col("u"))).collect()] == ["h.test/ab%zz", "h%61/x", None]
    html = spark.createDataFrame([("wor<b>d</b> one<br>two<!-- x --> <a href=\"http://h/\">l</a>",)], "h string")
    assert html.select(decode.html_text(F.col("h"))).first()[0].split() == ["word", "one", "two", "href=\"http://h/\"", "l"]


def test_mime_tree(spark):
    raw = "\n".join(["Subject: x", 'Content-Type: multipart/mixed; boundary="B"', "", "pre", "--B", "Content-Type: text/plain; charset=utf-8", "Content-Transfer-Encoding: base64", "", base64.b64encode("hallö".encode()).decode(), "--B", "Content-Type: image/png", "", "xx", "--B", "Content-Type: message/rfc822", "", "Subject: inner", "", "inner body", "--B--", "post"])
    df = spark.createDataFrame([("m", raw), ("n", None), ("o", "plain only")], "id string, raw string")
    rows = [tuple(r) for r in mime.explode_parts(df, "id", "raw").select("id", "part_no", "depth", "mime_type", "msg").collect()]
    assert rows[:5] == [("m", 1, 0, "multipart/mixed", None), ("m", 2, 1, "text/plain", "hallö"), ("m", 3, 1, "image/png", None), ("m", 4, 1, "message/rfc822", None), ("m", 5, 2, "text/plain", "inner body")]
    assert [r[0] for r in rows[5:]] == ["o"]
    kinds = spark.createDataFrame([("TEXT/HTML; x",), (None,), ("image/png",), ("odd",)], "mime_type string")
    assert [r[0] for r in kinds.select(mime.normal_type(F.col("mime_type"))).collect()] == ["html", "text", "image", "other"]
    assert mime.readable(kinds).count() == 2


def test_mail_stores(spark, tmp_path):
    box = "From a\nSubject: 1\n\nbody\n>From x\n\nFrom b\nSubject: 2\n\nFrom the start? no: after an empty line it is\n"
    (tmp_path / "box").write_text(box)
    got = [r["raw"] for r in mailstores.mbox(spark, str(tmp_path / "box")).orderBy("position").collect()]
    assert got == ["From a\nSubject: 1\n\nbody\n>From x\n", "From b\nSubject: 2\n", "From the start? no: after an empty line it is\n"]
    for sub, name in (("new", "1"), ("new", ".hid"), ("cur", "2")):
        (tmp_path / "md" / sub).mkdir(parents=True, exist_ok=True)
        (tmp_path / "md" / sub / name).write_text("x")
    assert sorted(r["folder"] for r in mailstores.maildir(spark, str(tmp_path / "md")).collect()) == ["cur", "new"]
    (tmp_path / "mh").mkdir()
    for name in ("12", "x3"):
        (tmp_path / "mh" / name).write_text("x")
    assert mailstores.mh(spark, str(tmp_path / "mh")).count() == 1
    (tmp_path / "rm").write_bytes(b"#! rmail 4\nabc\n#! rmail 6\ndefgh\n")
    assert [r["raw"] for r in mailstores.listed(spark, [str(tmp_path / "rm")], "rmail").orderBy("position").collect()] == ["abc\n", "defgh\n"]
    (tmp_path / "ant").write_text("MAIL FROM:<a>\nRCPT TO:<b>\nDATA\nSubject: x\n\n..dot\n.\nMAIL FROM:<c>\nDATA\ny\n.\n")
    assert [r["raw"] for r in mailstores.dotted_batch(spark, str(tmp_path / "ant")).orderBy("position").collect()] == ["Subject: x\n\n.dot", "y"]
    assert mailstores.single_messages(spark, str(tmp_path / "box")).count() == 1
    first = spark.createDataFrame([("From x",), ("#! rmail 3",), ("mail from:<a>",), ('".MSG_COUNT" 1 1',), ("Subject: x",)], "l string")
    assert [r[0] for r in first.select(mailstores.store_format(F.col("l"))).collect()] == ["mbox", "rmail", "dotted", "msg-count", "single"]


def test_dump_and_count_files(spark):
    lines = spark.createDataFrame([(1, "abc 1 2 20240101"), (2, "x"), (3, "abc -3 4"), (4, "a b 5"), (5, ""), (6, "noise")], "n int, value string")
    got = sorted(map(tuple, tables.parse_dump(lines, order="n", today=7).collect()))
    assert got == [("a b", 5, 0, 7, 4), ("abc", 0, 4, 7, 3), ("abc", 1, 2, 20240101, 1)]
    t = spark.createDataFrame([("ü", 1, 2, 0)], "token string, spam bigint, good bigint, date int")
    assert tables.dump_lines(t, replace_nonascii=True).first()[0] == "?? 1 2"
    cl = spark.createDataFrame([("f", 1, '".MSG_COUNT" 10 20'), ("f", 2, '"tok" 1 2'), ("f", 3, "junk"), ("f", 4, '".MSG_COUNT" 11 21'), ("f", 5, '"a"b" 3 4')], "file string, n int, value string")
    assert sorted(map(tuple, tables.parse_count_lines(cl, "file", F.col("n")).collect())) == [("f", 1, "tok", 1, 2, 10, 20), ("f", 2, 'a"b', 3, 4, 11, 21)]


def test_count_store(spark, tmp_path):
    s = tables.CountStore(spark, str(tmp_path / "store"))
    assert s.read().count() == 0
    d = spark.createDataFrame([("a", 2, 1), ("b", 0, 1)], "token string, spam bigint, good bigint")
    s.change(d, 20240101)
    out = s.change(d.where("token = 'a'"), 20240202, -1)
    assert sorted(map(tuple, out.collect())) == [("b", 0, 1, 20240101)]


def test_render_and_pass_through(spark):
    p = Params()
    df = spark.createDataFrame([("Spam", 0.9987654, 12, None, "<i@d>", None, "Subject: hi\nX-Bogosity: old\n  more\nTo: x\n\nbody\n"), ("Ham", 0.1, 1, "1.2.3.4", None, "Q1", "To: y\n")], "status string, spamicity double, n_tokens int, message_addr string, message_id string, queue_id string, raw string")
    f = render.fields(p)
    got = [r[0] for r in df.select(render.render("%h: %.1c, d=%d p=%p f=%.2f %I %Q %A %w 5%%", f)).collect()]
    assert got == ["X-Bogosity: S, d=0.001235 p=0.998765 f=1.00 <i@d> UNKNOWN UNKNOWN 12 5%", "X-Bogosity: H, d=0.100000 p=0.100000 f=0.10 UNKNOWN Q1 1.2.3.4 1 5%"]
    with pytest.raises(ValueError):
        render.render("%z", f)
    tag = F.when(F.col("status") == "Spam", "[spam]")
    out = [r[0] for r in df.select(render.pass_through(F.col("raw"), F.lit("X-Bogosity: new"), tag)).collect()]
    assert out == ["Subject: [spam] hi\nTo: x\nX-Bogosity: new\n\nbody\n", "To: y\nX-Bogosity: new\n\n"]
    placed = df.select(render.pass_through(F.col("raw"), F.lit("X-Bogosity: new"), tag, "To:")).first()[0]
    assert placed == "Subject: [spam] hi\nX-Bogosity: new\nTo: x\n\nbody\n"


def test_stream_auto_update(spark, tmp_path):
    base = spark.createDataFrame([("viagra", 9, 0), ("meeting", 0, 9), ("lunch", 0, 9), ("pills", 9, 0)], "token string, spam bigint, good bigint")
    src = tmp_path / "in"
    schema = "id string, text string"
    spark.createDataFrame([("a", "viagra pills cheapest"), ("b", "meeting lunch agenda")], schema).coalesce(1).write.parquet(str(src))
    u = AutoUpdate(spark, str(tmp_path / "state"), Params(spam_cutoff=0.9)).start(base, 10, 10)
    u.run(spark.readStream.schema(schema).parquet(str(src)))
    assert {r["id"]: r["status"] for r in u.scores().collect()} == {"a": "Spam", "b": "Ham"}
    table, n_spam, n_good = u.counts()
    assert (n_spam, n_good) == (11, 11)
    assert {r["token"]: (r["spam"], r["good"]) for r in table.collect()}["cheapest"] == (1, 0)
    u(spark.createDataFrame([("a", "viagra pills cheapest"), ("b", "meeting lunch agenda")], schema), 0)  # a retried batch changes nothing
    assert u.counts()[1:] == (11, 11)


def stream(spark, raw, **settings):
    df = spark.createDataFrame([(1, raw)], "id int, raw string")
    return tokenize.token_stream(df, "id", "raw", Params(**settings)).first()["tokens"]


HEAD_AND_BODY = "From somebody@mail.example\nTo:  somebody-else@mail.example\n\nThis is a test\n"


@pytest.mark.parametrize("n, want", [
    (1, "From:somebody mail.example | somebody-else mail.example | This is test"),
    (2, "From somebody From*somebody mail.example somebody*mail.example | somebody-else mail.example somebody-else*mail.example | This is This*is test is*test"),
    (3, "From somebody From*somebody mail.example somebody*mail.example From*somebody*mail.example | somebody-else mail.example somebody-else*mail.example | This is This*is test is*test This*is*test"),
])
def test_golden_ngrams_of_headers(spark, n, want):
    parts = want.replace(":", " ").split(" | ")
    want = [t + w for t, part in zip(("head:", "to:", ""), parts) for w in part.split()]
    assert stream(spark, HEAD_AND_BODY, multi_token_count=n, min_token_len=2) == want


def test_golden_subnets_of_messages(spark):
    want = "head:test url:192.168.1.2 url:192.168.1 url:192.168 url:192 body 172.12.13.14 172.12.13 172.12 172".split()
    assert stream(spark, "test: 192.168.1.2\n\nbody 172.12.13.14\n", block_on_subnets=True, wordlist_version=0) == want


def test_golden_html_states(spark):
    raw = "From bounce\nTo: junk\nContent-Type: text/html\n\nDONE\nDone\ndone\n\ncom<!innards>ment\ntwo<br>words\nword<a www.com/>list\nword<tag junk>list\n<junk href=href.a/>\n<a href=url.example.com/>\n<img href=file.img>\n<img picture.gif/>\n<font verdana,arial color=red>\n<fontx font>\n"
    want = "head:From head:bounce to:junk head:Content-Type head:text head:html DONE Done done comment two words www.com wordlist wordlist href url.example.com href file.img picture.gif verdana arial color red"
    assert sorted(stream(spark, raw)) == sorted(want.split())


def test_golden_entities_and_escapes(spark):
    raw = 'Content-Type: text/html\n\n&#x41;BC;\n&#68;EF&#71;\n&#x48;IJK&#x4c;\n&#x41;BC;&#151;&#68;EF&#71;\n\nGet<!--vE--> &#x41;n<!--4-->y&#x6F;&#x6E;&#x65;&#151;&#x45;&#x6c;&#x73;&#x65; R&#88;<!--cs-->&#x59;\n<IMG SRC="http://www.prerequisite.com@w%77w.o%6E%6C%69neme%64%73%74%6F%72%65%2E%62i%7A/%65%76/sv%2E%70%68p?e=dvsr@sonic-pik.com">\n'
    assert [t for t in stream(spark, raw) if ":" not in t] == "ABC DEFG HIJKL ABC DEFG Get Anyone Else RXY SRC http www.prerequisite.com www.onlinemedstore.biz sv.php dvsr sonic-pik.com".split()
    link = 'Content-Type: text/html; charset="iso-8859-1"\n\n<a href="http://%32%31.2%332.%316%30.1%305/%7a/s%69l%76e%72/f%61r%6d/i%6ed%65x.%68t%6dl">\n'
    assert [t for t in stream(spark, link) if ":" not in t] == "href http 21.232.160.105 silver farm index.html".split()


def test_parts_are_decoded_tagged_and_filtered(spark):
    import base64

    b64 = base64.encodebytes("secret grüße".encode()).decode()
    raw = (
        "Subject: =?utf-8?Q?gr=C3=BC=C3=9Fe?= you\nReturn-Path: <bounce-123-user=host.example@list.example>\nReceived: from [10.1.2.3] id ABC\nContent-Type: multipart/mixed; boundary=\"zz\"\n\npreamble\n"
        f"--zz\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n{b64}--zz\nContent-Type: image/png\n\nnothing\n--zz\nContent-Type: message/rfc822\n\nTo: inner\nX-Own: yes\n\nnested text\n"
        "--zz\nContent-Type: text/html\nContent-Transfer-Encoding: quoted-printable\n\nbo<b>l=\nd</b>\n--zz--\nepilogue\n"
    )
    got = stream(spark, raw)
    for t in ("subj:grüße", "subj:you", "rtrn:bounce-#-user", "rtrn:host.example", "ip:10.1.2.3", "preamble", "secret", "grüße", "mime:plain", "mime:image", "inner", "X-Own", "yes", "nested", "bold", "epilogue", "head:multipart", "head:mixed"):
        assert t in got, t
    assert not {"nothing", "rcvd:ABC", "to:inner", "zz", "head:zz"} & set(got)
    assert stream(spark, "X: naïve\n\nnaïve\n", replace_nonascii=True, header_line_markup=False)[-1] == "na??ve"
    assert stream(spark, "") == [] and stream(spark, None) in ([], None)


def test_stores_open_by_what_they_are(spark, tmp_path):
    (tmp_path / "box").write_text("From a\nS: 1\n\none\n\nFrom b\nS: 2\n\ntwo\n")
    (tmp_path / "dos").write_bytes(b"From a\r\nS: 3\r\n\r\nthree\r\n\r\nFrom b\r\nS: 4\r\n\r\nfour\r\n")
    (tmp_path / "one").write_text("S: 5\n\nfive\n")
    (tmp_path / "batch").write_bytes(b"#! rmail 11\nS: 6\n\nsix\n\n")
    (tmp_path / "md" / "cur").mkdir(parents=True)
    (tmp_path / "md" / "new").mkdir()
    (tmp_path / "md" / "new" / "7").write_text("S: 7\n\nseven\n")
    (tmp_path / "mh").mkdir()
    (tmp_path / "mh" / "1").write_text("S: 8\n\neight\n")
    names = ["box", "dos", "one", "batch", "md", "mh"]
    assert [mailstores.store_kind(spark, str(tmp_path / n)) for n in names] == ["mbox", "mbox-crlf", "single", "rmail", "maildir", "mh"]
    rows = mailstores.open_stores(spark, [str(tmp_path / n) for n in names])
    got = mailstores.numbered(rows).collect()
    assert sorted(r["raw"].partition("S: ")[2][0] for r in got) == list("12345678")
    assert sorted(r["number"] for r in got) == [1] * 6 + [2] * 2 and not any("\r" in r["raw"] for r in got)
    assert mailstores.open_stores(spark, []).count() == 0


def test_quoted_printable_validity(spark):
    rows = ["plain text\t=41\r\n", "a_b=41", "a b", "a?b", "na\u00efve", ""]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(decode.qp_valid(F.col("t")), decode.qp_valid(F.col("t"), in_header=True)).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, True), (True, False), (True, False), (False, False), (True, True)]


def test_general_format(spark):
    from siftline.operators.render import render

    values = [0.0, 1.0, 0.5, 0.00001, 1234567.0, 0.1234567, 99.9999999, 1e-10, 0.52]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(render("%g", {"g": F.col("v")})).collect()]
    assert got == ["%g" % v for v in values]
    assert df.limit(1).select(render("%-6c|%6c|%.1c", {"c": F.lit("Ham")})).first()[0] == "Ham   |   Ham|H"
