"""Language ID, secrets, personal data, piece codec and HTML text."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F

from burdenframe.llm import html_text, language, pii, piece_codec, secret_scan

WORDS = {"en": "the of and with house tree water", "de": "der die und mit haus baum wasser", "fr": "le la et avec maison arbre eau"}


def talk(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_language_on_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, talk(rng, lang, rng.randint(5, 30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?", "fr"), (1003, talk(rng, "de", 50_000), None), (1, rows[1][1], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.train(docs.filter("NOT held_out"))
    found = docs.withColumn("p", language.predictor(spark, model)("text")).collect()
    assert {r.p.lang for r in found if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert all(r.p.lang == (r.lang or "de") for r in found if not 1000 <= r.doc_id <= 1002)
    assert all(0 <= r.p.score <= 1 for r in found)
    assert len({(r.p.lang, r.p.score) for r in found if r.doc_id == 1}) == 1


def test_language_scores_do_not_depend_on_the_batch(spark):
    rng = random.Random(2)
    texts = [talk(rng, lang, 20) for lang in ("en", "de", "fr")]
    docs = spark.createDataFrame([(t, lang) for t, lang in zip(texts, WORDS)], "text string, lang string")
    model = language.train(docs)
    together, alone = model.score(texts)[1], [model.score([t])[1][0] for t in texts]
    assert abs(together - alone).max() < 1e-12
    assert language.train(docs.limit(0)).score(texts)[0] == ["und"] * 3


KEY = "AKIA" + "ABCD" * 5
SECRETS = [
    "password = hunter22 and PassWd:'abc'", KEY + " " + KEY[:10], "0123456789abcdef01234567 0123", None, "", "nothing here", "nothing here",
    'api_key="abcdefg" token: short', "x" * 50_000 + " secret=" + "a1" * 500, "ſecret=abcdefgh", "https://me:pass99@host/x", "é" * 5 + "apikey:zzzzzz",
]


def plain_base(text):
    out = []
    for order, (kind, pattern, group, least) in enumerate((
        ("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    )):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [x for _, _, x in sorted(out)]


def spans(found, base=secret_scan.BASE_RULES):
    return [f"{s.kind}:{s.start}:{s.end}" for s in found if s.kind in base]


def test_secret_findings_and_ledger(spark, documents, tmp_path):
    ledger = str(tmp_path / "ledger")
    docs = documents(*SECRETS).union(documents((0, SECRETS[0]), (None, SECRETS[1]))).withColumns({"blob": F.lit(1), "findings": F.lit("x")})
    rows = secret_scan.findings(docs, ledger, doc_id="doc_id").collect()
    assert len(rows) == len(SECRETS) + 2
    for r in rows:
        text = SECRETS[1] if r.doc_id is None else SECRETS[r.doc_id]
        assert spans(r.findings) == plain_base(text)
    assert [s.kind for r in rows if r.doc_id == 10 for s in r.findings] == ["url_password"]
    first = secret_scan.ledger_at(spark, ledger).collect()
    assert len(first) == len({r.blob for r in first})
    secret_scan.update(docs, ledger)
    assert secret_scan.ledger_at(spark, ledger).count() == len(first)
    secret_scan.update(docs.union(documents("new secret=abcdefgh").withColumns({"blob": F.lit(1), "findings": F.lit("x")})), ledger)
    assert secret_scan.ledger_at(spark, ledger).count() == len(first) + 1
    secret_scan.update(docs, ledger, rule_version="3")
    assert secret_scan.ledger_at(spark, ledger).filter("rule_version = '3'").count() == len(first)
    assert secret_scan.findings(docs.limit(0), ledger, doc_id="doc_id").collect() == []


def test_masked_secrets(documents, tmp_path):
    found = secret_scan.attach(documents(*SECRETS), str(tmp_path / "ledger"))
    rows = {r.doc_id: r.m for r in found.select("doc.doc_id", secret_scan.masked(F.col("doc.text"), F.col("findings")).alias("m")).collect()}
    assert rows[0] == "[secret] and PassWd:'abc'" and rows[1] == "[secret] " + KEY[:10] and rows[3] is None and rows[5] == SECRETS[5]
    assert rows[11] == "é" * 5 + "[secret]"


PERSONAL = [
    "a@b.com_x@y.org x@y.com.z@w.org a@b@c.d", "1.2.3.4.5 999.1.1.1 12.34.56.78.90.11.22.33 1.2.3.a.5.6.7", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (499) 555-6503 +49 +1-2-3", None, "", "é" * 5 + "a@b.co IBAN GB82 WEST 1234 5698 7654 32 my ssn 123-45-6789 call 555-123-4567", "GB82WEST12345698765433 123-45-6789",
    "1" * 3000 + "@" + "a.b" * 2000, "9 " * 5000, "0" * 20_000,
]


def plain_personal(text):
    def luhn(s):
        d = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(re.sub("[^0-9]", "", s)))]
        return sum(x - 9 if x > 9 else x for x in d) % 10 == 0

    def holds(kind, s):
        n = len(re.sub("[^0-9]", "", s))
        return {"email": True, "card": 14 <= n <= 19 and luhn(s), "phone": 10 <= n <= 15,
                "ip": kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in s.split("."))}[kind]

    out = []
    for order, (kind, pattern) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if holds(kind, m[0])]
    return [x for _, _, x in sorted(out)]


def test_personal_data(documents):
    docs = documents(*PERSONAL).union(documents((0, PERSONAL[0]))).withColumn("spans", F.lit("clash"))
    rows = pii.find(docs).select("doc.doc_id", "spans", pii.masked(F.coalesce("doc.text", F.lit("")), F.col("spans")).alias("m")).collect()
    assert len(rows) == len(PERSONAL) + 1
    for r in rows:
        assert spans(r.spans, pii.BASE) == plain_personal(PERSONAL[r.doc_id]), r.doc_id
        extra = [s.kind for s in r.spans if s.kind not in pii.BASE]
        assert extra == (["iban", "ssn", "local_phone"] if r.doc_id == 6 else [])
        assert all(s.score >= pii.MIN_SCORE for s in r.spans)
    assert rows[3].m == "[phone] +49 +1-2-3"
    assert pii.find(docs.limit(0)).collect() == []


def brute_force(codec, text):
    text = "".join(piece_codec.SPACE if c == " " else "\udc81" if c == piece_codec.SPACE else c for c in " " + text)
    best, back = [0] + [None] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - codec.longest), end):
            ways = [(s, [i]) for s, i in [codec.scores[text[begin:end]]]] if text[begin:end] in codec.scores else []
            if end - begin == 1 and not ways:
                data = {"\udc81": piece_codec.SPACE, piece_codec.SPACE: " "}.get(text[begin], text[begin]).encode()
                ways = [(codec.byte_score * len(data), [codec.bytes[b] for b in data])]
            for s, ids in ways:
                if best[end] is None or best[begin] + s > best[end]:
                    best[end], back[end] = best[begin] + s, (begin, ids)
    out, at = [], len(text)
    while at:
        out, at = back[at][1] + out, back[at][0]
    return out


def test_piece_codec(documents):
    codec, rng = piece_codec.Codec.at(None), random.Random(5)
    texts = ["Hello world", "  two  spaces \n\n\nx ", "a" * 300, "日本語テキスト" * 30, "é́💩 ok\r\n\t", "abcabcabd" * 40, "1234567890" * 30]
    texts += ["a▁b", "▁", "▁▁ ▁x", "²., x.y,z", "\ue000 a", "();\r\n {\r"]
    texts += ["".join(rng.choice("abcdeéß,. \n▁") for _ in range(rng.randint(1, 200))) for _ in range(40)]
    together = codec.encode(pa.array(texts)).to_pylist()
    for text, ids in zip(texts, together, strict=True):
        expected = brute_force(codec, text)
        assert ids == expected
        whole = (" " + text).replace(piece_codec.SPACE, piece_codec.HELD).replace(" ", piece_codec.SPACE)
        assert [i for part in codec.stream(whole) for i in part] == expected
        assert codec.decode(pa.array([expected, None, []], pa.list_(pa.int32()))).to_pylist() == [text, None, ""]
    broken = [0, codec.bytes[0xE2], *codec.encode(pa.array(["x"]))[0].as_py(), 1, codec.bytes[0xFF]]
    assert codec.decode(pa.array([broken], pa.list_(pa.int32()))).to_pylist() == ["\ufffd x\ufffd"]
    assert len(list(codec.stream("abcabcabd" * 400))) > 1
    docs = documents(*texts, None, "", "word " * 30_000, texts[0]).withColumn("ids", F.lit(1))
    rows = piece_codec.encode(docs).withColumn("back", piece_codec.decoder()("ids")).collect()
    assert len(rows) == len(texts) + 4 and all(r.back == (r.text or "") for r in rows)
    assert piece_codec.encode(docs.limit(0)).collect() == []


def test_fractional_scores(documents):
    codec = piece_codec.Codec.at(None)
    own = codec.scores
    try:
        codec.scores = {p: (-2.4 if len(p) == 1 else -4.6, i) for p, (_, i) in own.items()}
        codec.begun = {p[:n]: () for p in codec.scores for n in range(1, len(p))} | codec.scores
        text = "xx abcd"
        assert [i for part in codec.stream(piece_codec.SPACE + text.replace(" ", piece_codec.SPACE)) for i in part] == brute_force(codec, text)
    finally:
        codec.scores = own
        codec.begun = {p[:n]: () for p in own for n in range(1, len(p))} | own


def test_many_closing_tags_take_linear_time():
    started = time.process_time()
    assert html_text.blocks("<div>" * 20_000 + "x" + "</b>" * 20_000 + "<i>" * 20_000 + "</p>" * 20_000)[0].text == "x"
    assert time.process_time() - started < 5


class PlainBlocks(HTMLParser):
    """Texts between block elements by the standard library's parser, for pages without stray signs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.held, self.raw = [], "", None

    def handle_starttag(self, tag, attrs):
        if tag in html_text.RAW:
            self.raw = tag
        if tag == "br":
            self.held += " "
        if tag in html_text.BLOCKS:
            self.close_block()

    def handle_endtag(self, tag):
        if tag == self.raw:
            self.raw = None
        if tag in html_text.BLOCKS:
            self.close_block()

    def handle_data(self, data):
        self.held += "" if self.raw else data

    def close_block(self):
        if text := " ".join(self.held.split()):
            self.found.append(text)
        self.held = ""


def plain_blocks(html):
    parser = PlainBlocks()
    parser.feed(html)
    parser.close()
    parser.close_block()
    return parser.found


def test_blocks_are_those_of_another_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    rng = random.Random(8)
    tags = ["p", "div", "b", "span", "li", "ul", "a", "h2", "td", "table", "section", "em"]
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 60)):
            tag = rng.choice(tags)
            parts.append(rng.choice([f"<{tag}>", f"</{tag}>", f'<{tag} class="x">', "word ", "two words", "&amp; ", "&eacute;", "<br>", "<!-- a <p> -->",
                                     "<script>if (a < b) x</script>", "\n"]))
        pages.append("".join(parts))
    assert len(pages) > 600
    for html in pages:
        assert [b.text for b in html_text.blocks(html)] == plain_blocks(html)


def plain_grams(text):
    """Buckets of all sequences of one to three characters that hold a letter, as whole-number arithmetic."""
    c = "  " + "".join(x if x.isalpha() else " " for x in (text or "").lower()) + "  "
    for at in range(len(c) - 2):
        h = 0
        for k, factor in enumerate((2654435761, 2246822519, 3266489917)):
            h = (h ^ ord(c[at + k])) * factor % 2**32
            if c[at : at + k + 1].strip():
                yield (h ^ h >> 15) * (3266489917, 2246822519, 2654435761)[k] % 2**32 >> 16


def test_naive_bayes_against_plain_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(60)
    rows = docs.collect()
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts, shares = {}, Counter(r.lang for r in rows if r.lang is not None and r.text is not None)
    for r in rows:
        if r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    assert sorted(counts) == model.languages
    totals = {lang: sum(c.values()) + 0.1 * 65536 for lang, c in counts.items()}
    texts = [r.text for r in rows] + ["", None, "123", "Ünter dem Baum"]
    for text, name, score in zip(texts, *model.score(texts)):
        buckets = list(plain_grams(text))
        sums = {lang: math.log(shares[lang] / sum(shares.values())) + sum(math.log((counts[lang][b] + 0.1) / totals[lang]) for b in buckets) for lang in counts}
        best = max(sorted(sums), key=sums.get)
        if not any(x.isalpha() for x in text or ""):
            assert (name, score) == ("und", 0)
        else:
            assert name == best and abs(score - 1 / sum(math.exp(s - sums[best]) for s in sums.values())) < 1e-6


PARAGRAPH = "The house of the river is on the hill and it was built by the people of the town in the year of the flood."


def test_main_text():
    page = (
        f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><a href=/a>The</a></nav><!-- x --><div class='ad'>{PARAGRAPH}</div>"
        f"<article><h1>Fish &amp; chips</h1><p>{PARAGRAPH}<br>\n  more<p>Short.<div id=comments><p>{PARAGRAPH}</div><ul class=share><li>x</ul><b>last</b> one</article>"
        f"<form>{PARAGRAPH}</form><aside>{PARAGRAPH}</aside><footer>&copy; {PARAGRAPH}</footer>"
    )
    assert html_text.main_text(page) == f"Fish & chips\n{PARAGRAPH} more\nShort.\nlast one"
    for empty in (None, "", "<", "<p", "<!-- ", "<script>x", "<nav>menu</nav>"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text(f"<div>Menu</div><div><a>{PARAGRAPH}</a></div><p>{PARAGRAPH}</p><p>And so on.</p><p>{PARAGRAPH}") == f"{PARAGRAPH}\nAnd so on.\n{PARAGRAPH}"
    assert html_text.main_text("<article><p>1 < 2 a&nbsp;b <i>it<i>alic</article>") == "1 < 2 a b italic"
    assert html_text.main_text(f"<article><p hidden>{PARAGRAPH}</p><p title='a>b'>{PARAGRAPH}</article>") == PARAGRAPH
    for around in ("<div class='layout with-sidebar'>", "<div id='content-share'><div>", "<div class='single has-comments'>"):
        page = f"{around}<div class=menu>{PARAGRAPH}</div><article><h1>T</h1><div class=share>{PARAGRAPH}</div><p>{PARAGRAPH}</p></article></div>"
        assert html_text.main_text(page) == f"T\n{PARAGRAPH}"
    assert html_text.main_text(f"<div class=has-comments><main><p>{PARAGRAPH}</p></main></div>") == PARAGRAPH
    assert html_text.main_text(f"<article><p>{PARAGRAPH}</p></article><div id=comments><article class=comment-body><p>{PARAGRAPH}</p></article></div>") == PARAGRAPH
    assert html_text.main_text(f"<div class=with-sidebar><article><p>{PARAGRAPH}</p></article><div id=comments><article>{PARAGRAPH}</article></div></div>") == PARAGRAPH
    assert html_text.main_text(f"<article><p>{PARAGRAPH}</p><div class=promo><article>{PARAGRAPH}</article></div></article>") == PARAGRAPH
    assert html_text.main_text(f"<nav><article><p>{PARAGRAPH}</p></article></nav><div hidden><article>{PARAGRAPH}</article></div>") == ""
    assert len(html_text.main_text("<article>" + f"<p>{PARAGRAPH}" * 3000)) > 300_000
    assert html_text.main_text("<div>" * 5000 + "x" + "<" * 5000 + "'" * 100) is not None


def test_pages(spark):
    rows = [(1, "u", f"<article><p>{PARAGRAPH}</article>"), (1, "u", f"<article><p>{PARAGRAPH}</article>"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted(r.text for r in html_text.extract(pages).collect()) == ["", PARAGRAPH, PARAGRAPH]
    assert html_text.extract(pages.limit(0)).collect() == []
