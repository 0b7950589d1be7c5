"""Packing, extraction, language identification, media columns and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilspark.llm import html_extract, langid, media, packing

public_tokenizers = pytest.importorskip("public_tokenizers")


def token_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for t in texts]


def check_packing(rows, pieces, capacity=4096):
    """Each id in one piece, gapless sequences of at most the capacity; returns the padding's share."""
    ids = dict(zip([d for d, _ in rows], token_ids([t for _, t in rows]), strict=True))
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for d, got in by_doc.items():
        at = 0
        for p in sorted(got, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[d])
            assert p["ids_crc32"] == zlib.crc32(ids[d][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[d])
    padded = total = 0
    for got in by_seq.values():
        at = 0
        for p in sorted(got, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        total += at
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded / total


def test_packing_holds_each_id_once(spark):
    rng = random.Random(4)
    words = ["Straße", "naïve", "hello", "WORLD", "<|endoftext|>", "don't", "x=1;", "日本語", " nbsp", "tab\there", "émigré", "1234567"]
    rows = [(1, None), (2, ""), (3, "   \n")] + [(10 + i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 80, 900, 6000])))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("sequence_id", F.lit("x"))
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert check_packing(rows, pieces) == 0


def test_packing_of_repeats_and_empty_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string"), path).collect()
    assert len(twice) >= 2 and sum(p["length"] for p in twice) == 6


def test_closest_multiset_equals_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        lengths = {rng.randrange(1, 40): rng.randrange(1, 5) for _ in range(rng.randrange(1, 6))}
        capacity = rng.randrange(1, 90)
        sums = {0}
        for n, k in lengths.items():
            sums = {s + n * j for s in sums for j in range(k + 1)}
        best, taken = packing.closest_multiset(lengths, capacity)
        assert best == max(s for s in sums if s <= capacity)
        assert sum(n * k for n, k in taken.items()) == best and all(k <= lengths[n] for n, k in taken.items())


def test_tokenizer_table_starts_anew_when_full():
    path = public_tokenizers.path("word_bpe_49k.json")
    small = packing.WordTokenizer(path, capacity=50)
    rng = random.Random(6)
    texts = [" ".join(f"word{rng.randrange(400)}" for _ in range(rng.randrange(60))) for _ in range(40)]
    for i in range(0, 40, 8):
        part = [t.encode() for t in texts[i : i + 8]]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in part])])
        got = small.encode_rows(np.frombuffer(b"".join(part), np.uint8), offs)
        for g, want in zip(got, token_ids(texts[i : i + 8]), strict=True):
            assert g.tolist() == want[:-1].tolist()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>
<div class="cookie-notice">We use cookies</div>
<article><h2>Title &amp; more</h2><p>First   paragraph with <b>bold</b>
text and a <a href="#">link</a>.</p><ul><li>one<li>two</ul><!-- gone --><div class="ad">Buy now</div>
<p>Last&nbsp;line &#8211; end.</p><section id="comments"><p>Nice post</p></section></article>
<aside>Related</aside><form><input value=x><button>Send</button></form><footer>(c)</footer></body></html>"""


def test_main_text_of_a_marked_article():
    assert html_extract.main_text(PAGE) == "Title & more\nFirst paragraph with bold text and a link.\none\ntwo\nLast line – end."


def test_main_text_without_marks():
    body = "".join(f"<p>Paragraph {i} has a good many words, so that it weighs as much as body text does on real pages.</p>" for i in range(5))
    page = f"<html><body><div><a href=/>Home</a> <a href=/b>About</a></div><div class='nav'>a</div><div><h1>Head</h1>{body}</div><div class=footer>Imprint</div></body></html>"
    lines = html_extract.main_text(page).split("\n")
    assert lines[0] == "Head" and len(lines) == 6 and lines[-1].startswith("Paragraph 4")


LONG = "A paragraph of the article with a good many words, so that it weighs as much as body text does on real pages."


@pytest.mark.parametrize("around", ["div class='content has-sidebar'", "div class=layout-with-sidebar", "div class='site-content no-sidebar'", "div class=page-with-comments", "div class='search-results'", "form id=aspnetForm action=x", "div class='page sidebar'"])
@pytest.mark.parametrize("mark", ["article", "main", "div"])
def test_layout_wrappers_are_no_furniture(around, mark):
    tag = around.split()[0]
    page = f"<body><nav>Home</nav><{around}><div class=sidebar>Buy now, this is an advert</div><{mark}><p>{LONG} 1</p><p>{LONG} 2</p><div class=comments><p>Nice post</p></div></{mark}></{tag}><footer>(c)</footer></body>"
    assert html_extract.main_text(page) == f"{LONG} 1\n{LONG} 2"


def test_comments_and_teasers_stay_furniture():
    talk = "".join(f"<article class=comment><p>{LONG}</p></article>" for _ in range(5))
    page = f"<body><article><p>Short text of the page.</p></article><div class=comments>{talk}</div><div class=related><article><p>{LONG}</p></article></div><form>{LONG}</form></body>"
    assert html_extract.main_text(page) == "Short text of the page."


@pytest.mark.parametrize("gap", ["<div class=ad><p>Buy</p><p>this</p><p>now</p></div>", "<p>* * *</p>" * 3, "<ul><li><a href=a>one</a><li><a href=b>two</a><li><a href=c>three</a></ul>"])
def test_every_region_of_an_unmarked_page_is_kept(gap):
    page = f"<body><div><p>{LONG} 1</p><p>{LONG} 2</p>{gap}<p>{LONG} 3</p></div></body>"
    lines = html_extract.main_text(page).split("\n")
    assert [x for x in lines if x.startswith(LONG)] == [f"{LONG} {k}" for k in (1, 2, 3)]


def test_links_before_the_text_of_an_article_are_a_menu_and_later_ones_stay():
    links = "".join(f"<li><a href={k}>Teaser {k}</a> |" for k in range(4))
    text = f"<h1><a href=x>Linked title</a></h1><p>Short.</p>{{}}<p><a href=y>One link</a></p><p>{LONG}</p><p><a href=z>End</a></p>"
    teasers = [f"Teaser {k} |" for k in range(4)]
    assert html_extract.main_text(f"<main>{text.format(f'<ul>{links}</ul>')}</main>").split("\n") == ["Linked title", "Short.", *teasers, "One link", LONG, "End"]
    assert html_extract.main_text(f"<main><ul>{links}</ul>{text.format('')}</main>").split("\n")[-5:] == ["Short.", "One link", LONG, "End"][-5:]
    assert "Teaser" not in html_extract.main_text(f"<main><ul>{links}</ul>{text.format('')}</main>")
    assert html_extract.main_text(f"<main><ul>{links}</ul></main>").count("Teaser") == 4


@pytest.mark.parametrize("own", ["<h2 id=related-work>Related work</h2>", "<section id=search><p>How to search.</p></section>", "<p class=notice-period>A month.</p>", "<blockquote class=share>To share is to care.</blockquote>", "<table><tr><td class=header>Name</td></tr></table>", "<h3 class=notice>Mind the gap</h3>", "<div class=related-work>Others did so.</div>"])
def test_an_article_keeps_what_is_named_like_furniture(own):
    text = re.sub("<[^>]*>", "", own)
    assert html_extract.main_text(f"<body><article><p>{LONG}</p>{own}<p>{LONG} 2</p></article></body>") == f"{LONG}\n{text}\n{LONG} 2"


@pytest.mark.parametrize("gone", ["<div class=share-buttons>Share</div>", "<div class='post-box ad'>Buy</div>", "<section class=related>More</section>", "<section id=comments><p>Nice</p></section>", "<aside>Aside</aside>", "<div class=newsletter-signup>Join</div>", "<div id=cookie-notice>Cookies</div>", "<form>Ask</form>"])
def test_an_article_loses_its_furniture(gone):
    assert html_extract.main_text(f"<body><article><p>{LONG}</p>{gone}<p>{LONG} 2</p></article></body>") == f"{LONG}\n{LONG} 2"


def test_a_reference_list_of_links_stays():
    refs = "".join(f"<li><a href={k}>Reference {k}</a></li>" for k in range(3))
    assert html_extract.main_text(f"<article><p>{LONG}</p><ol>{refs}</ol></article>").split("\n") == [LONG, "Reference 0", "Reference 1", "Reference 2"]


def test_much_text_before_a_marked_article_stays():
    before = "".join(f"<p>{LONG} {k}</p>" for k in range(10))
    lines = html_extract.main_text(f"<body><nav>Home</nav><div>{before}</div><article><h1>T</h1><p>Short.</p></article><div>Follow us, we have cookies.</div></body>").split("\n")
    assert lines == [*[f"{LONG} {k}" for k in range(10)], "T", "Short."]


def brute_lines(lines, marked):
    """Line by line, from the definition: what windows a line stands in, and where it stands to the marks."""
    n, w = len(lines), [0 if x.furniture else x.weight for x in lines]
    window = [sum(w[i : i + html_extract.LINES]) for i in range(n)]
    least = html_extract.SURGE if any(x > html_extract.SURGE for x in window) else 0

    def region(k):
        """The region of a line: runs of windows that carry something, from their first surge on, with what weighs right before it."""
        for i in range(n):
            if window[i] <= least or any(window[j] > least and all(window[j : i + 1]) for j in range(i)):
                continue
            stop = next((j for j in range(i, n) if not window[j]), n)
            start = i
            while start and w[start - 1]:
                start -= 1
            if start <= k < stop:
                return start, stop
        return None

    out = []
    for k, x in enumerate(lines):
        if x.furniture:
            continue
        found = region(k)
        if not marked:
            if found:
                out.append(x.text)
            continue
        if x.article:
            own = [j for j in range(n) if lines[j].article and not lines[j].furniture]
            surges = any(w[j] for j in own)
            ahead = surges and not any(w[j] for j in own if j <= k)
            at, lo, hi = own.index(k), own.index(k), own.index(k)
            while lo > 0 and lines[own[lo - 1]].links:
                lo -= 1
            while hi + 1 < len(own) and lines[own[hi + 1]].links and not w[own[hi + 1]]:
                hi += 1
            if not (ahead and x.links and hi - lo + 1 >= html_extract.LINES and at >= lo):
                out.append(x.text)
        elif found:
            lo = hi = k
            while lo > found[0] and not lines[lo - 1].article:
                lo -= 1
            while hi + 1 < found[1] and not lines[hi + 1].article:
                hi += 1
            if sum(w[lo : hi + 1]) >= html_extract.OUTSIDE:
                out.append(x.text)
    return out


def test_regions_equal_brute_force(spark, small):
    rng = random.Random(4)
    for trial in range(1500):
        marked = trial % 2 == 0
        lines, article = [], False
        for k in range(rng.randrange(1, 25)):
            article = marked and (article if rng.random() < 0.7 else not article)
            links = rng.random() < 0.35
            lines.append(html_extract.Line(f"{k}", 0 if links or rng.random() < 0.3 else rng.choice([1, 20, 90, 300]), rng.random() < 0.15, article, links))
        assert html_extract.main_lines(lines, marked) == brute_lines(lines, marked), lines
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        lines, marked = html_extract.blocks(r["html"]) if r["html"] else ([], False)
        assert html_extract.main_lines(lines, marked) == brute_lines(lines, marked)


def test_formulas_and_fallbacks_are_text():
    page = f"<article><p>So <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=tex>x=1</annotation></semantics></math> holds.</p><object data=a>The picture shows a cat.</object></article>"
    assert html_extract.main_text(page) == "So x=1 holds.\nThe picture shows a cat."


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<!--", "<a href='", "&#xffffffff;", "<script>", "</div></p>", "<p>\x00</p>", "<" * 3000, "<div>" * 3000, "a" * 200_000])
def test_odd_pages_do_not_crash(html):
    assert isinstance(html_extract.main_text(html), str)


def test_extract_keeps_every_page(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_extract.extract(pages).collect()
    assert sorted(r["text"] for r in got) == ["", "", html_extract.main_text(PAGE), html_extract.main_text(PAGE)]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_held_out_languages(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert got["n"] > 150 and got["a"] >= 0.97


def test_language_mixtures_and_letterless_texts():
    rng = random.Random(1)
    words = {"de": ["straße", "und", "nicht", "haus", "schnell"], "en": ["street", "and", "not", "house", "quickly"], "fr": ["rue", "et", "pas", "maison", "vite"]}
    counts = np.zeros((langid.BUCKETS, 3))
    for k, lang in enumerate(sorted(words)):
        data, _ = langid._prepared([" ".join(rng.choice(words[lang]) for _ in range(4000))])
        counts[:, k] = np.bincount(langid._trigrams(data), minlength=langid.BUCKETS)
    model = langid.Model(sorted(words), np.log((counts + 0.1) / (counts.sum(axis=0) + 100)).astype(np.float32))
    mixed = " ".join(words["de"] * 30 + words["fr"] * 10)
    langs, scores = langid.predict([mixed, None, "", "1234 !?", "HOUSE and street", "rue " * 5000], model)
    assert langs == ["de", "und", "und", "und", "en", "fr"]
    assert 0.7 <= scores[0] <= 0.8 and scores[1:4] == [0.0] * 3 and scores[5] == pytest.approx(1.0)
    assert langid.predict(["text"], langid.Model([], np.zeros((langid.BUCKETS, 0)))) == (["und"], [0.0])


def small_model(seed: int = 1):
    rng = random.Random(seed)
    words = {"de": ["straße", "und", "nicht", "haus", "schnell"], "en": ["street", "and", "not", "house", "quickly"], "fr": ["rue", "et", "pas", "maison", "vite"]}
    counts = np.zeros((langid.BUCKETS, 3))
    for k, lang in enumerate(sorted(words)):
        data, _ = langid._prepared([" ".join(rng.choice(words[lang]) for _ in range(4000))])
        counts[:, k] = np.bincount(langid._trigrams(data), minlength=langid.BUCKETS)
    return words, langid.Model(sorted(words), np.log((counts + 0.1) / (counts.sum(axis=0) + 100)).astype(np.float32))


def plain_prediction(text, model):
    """Mixture proportions by the definition: word by word, language by language."""
    low = re.sub(r"[\x00-\x60\x7b-\x7f]", " ", text.lower())
    logs = []
    for word in low.split(" "):
        if word:
            grams = langid._trigrams(np.frombuffer(f" {word} ".encode(), np.uint8))
            logs.append([sum(float(model.log_p[g, k]) for g in grams) for k in range(len(model.languages))])
    if not logs or not any(c.isalpha() for c in text):
        return "und", 0.0
    like = [[math.exp(max(x - max(row), -50.0)) for x in row] for row in logs]

    def fit(share):
        for _ in range(langid.PASSES):
            total = [0.0] * len(share)
            for row in like:
                z = sum(s * x for s, x in zip(share, row, strict=True))
                for k, (s, x) in enumerate(zip(share, row, strict=True)):
                    total[k] += s * x / z
            share = [t / len(like) for t in total]
        return share, sum(math.log(max(1e-300, sum(s * x for s, x in zip(share, row, strict=True)))) for row in like)

    n = len(model.languages)
    share, _ = fit([1.0 / n] * n)
    order = sorted(range(n), key=lambda k: -share[k])
    best = [float(k == order[0]) for k in range(n)]
    value = sum(math.log(max(1e-300, row[order[0]])) for row in like)
    for m in range(2, n + 1):
        if share[order[m - 1]] < langid.LEAST_SHARE:
            break
        start = [max(share[k], 1e-3) if k in order[:m] else 0.0 for k in range(n)]
        got, log_like = fit([x / sum(start) for x in start])
        log_like -= langid.PENALTY * 0.5 * math.log(len(like) + 1.0)
        if log_like <= value:
            break
        best, value = got, log_like
    k = max(range(n), key=lambda k: best[k])
    return model.languages[k], min(1.0, best[k])


def test_predictions_equal_plain_expectation_maximisation():
    words, model = small_model()
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words[rng.choice(list(words)[: 1 + i % 3])]) + rng.choice(["", ",", " 12", ". X"]) for _ in range(rng.randrange(1, 80))) for i in range(60)] + ["日本語 und", "ÀÉ", "12 34", "x"]
    langs, scores = langid.predict(texts, model)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        want = plain_prediction(text, model)
        assert (lang, score) == (want[0], pytest.approx(want[1], abs=1e-9))
        for each in (40, 1 << 18):
            got = langid.predict_long(text, model, each)
            assert got == (want[0], pytest.approx(want[1], abs=1e-6))


def test_a_very_long_text_is_taken_in_stretches(spark):
    words, model = small_model()
    text = " ".join(f"{w} {i % 5000}" for i, w in enumerate((words["de"] * 2 + words["fr"]) * 60_000))
    tracemalloc.start()
    got = langid.predict_long(text + "ß" * 3_000_000, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == "de" and 0.6 < got[1] < 0.75 and peak < 300 << 20  # 1.3 GB in one pass
    rows = spark.createDataFrame([(1, text), (2, "rue et pas"), (3, "x" * 600_000)], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(rows, model).collect()}
    assert found[1] == "de" and found[2] == "fr" and found[3] in model.languages


def test_identify_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (2, None, "en"), (None, "x", "en")], "doc_id long, text string, lang string").withColumn("found", F.lit(0)).withColumn("score", F.lit("s"))
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", [b"", b"x", b"a" * 64, "ünï".encode() * 50, bytes(range(256)) * 300])
def test_transport_streams_round_trip(text):
    payload = media.padded(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(text)
    raw = media.mux(payload)
    stream = next(iter(media.demux(raw).values()))
    assert stream.payload == payload and stream.random_access[0] and stream.pts == [media.TICKS * i for i in range(len(stream.units))]


def test_damaged_streams_are_told():
    raw = media.mux(bytes(20_000))
    for broken in (raw[:-1], b"\x00" + raw[1:], raw[: 188 * 5] + raw[188 * 6 :], raw[:20] + b"\x55" + raw[21:]):
        with pytest.raises(ValueError):
            media.demux(broken)


def plain_crc(data):
    """Bit by bit over the whole message."""
    crc = [1] * 32
    for byte in data:
        for k in range(7, -1, -1):
            top = crc[0] ^ (byte >> k & 1)
            crc = crc[1:] + [0]
            if top:
                crc = [a ^ (0x04C11DB7 >> (31 - i) & 1) for i, a in enumerate(crc)]
    return int("".join(map(str, crc)), 2).to_bytes(4, "big")


def plain_stream(payload):
    """Packet by packet, as bits of text: tables before each eighth unit, units of 4096 bytes 3600 ticks apart."""
    def packed(*fields):
        bits = "".join(f"{v:0{n}b}" for v, n in fields)
        return int(bits, 2).to_bytes(len(bits) // 8, "big")

    def table(pid, counter, ident, body):
        section = packed((ident, 8), (0b1011, 4), (len(body) + 9, 12), (1, 16), (0b11, 2), (0, 5), (1, 1), (0, 8), (0, 8)) + body
        packet = packed((0x47, 8), (0, 1), (1, 1), (0, 1), (pid, 13), (0, 2), (1, 2), (counter % 16, 4)) + b"\0" + section + plain_crc(section)
        return packet + b"\xff" * (188 - len(packet))

    out, counter, tables = b"", 0, 0
    for n in range(0, len(payload), 4096):
        number, unit = n // 4096, payload[n : n + 4096]
        ticks = 3600 * number
        if number % 8 == 0:
            out += table(0, tables, 0, packed((1, 16), (7, 3), (256, 13)))
            out += table(256, tables, 2, packed((7, 3), (257, 13), (15, 4), (0, 12), (6, 8), (7, 3), (257, 13), (15, 4), (0, 12)))
            tables += 1
        stamp = packed((2, 4), (ticks >> 30, 3), (1, 1), (ticks >> 15 & 0x7FFF, 15), (1, 1), (ticks & 0x7FFF, 15), (1, 1))
        left = packed((1, 24), (0xBD, 8), (len(unit) + 8, 16), (0b10, 2), (0, 3), (1, 1), (0, 2), (0b10, 2), (0, 6), (5, 8)) + stamp + unit
        first = True
        while left:
            clock = b"\x50" + packed((ticks, 33), (63, 6), (0, 9)) if first and number % 8 == 0 else b""
            room = 184 - (len(clock) + 1 if clock else 0)
            part, left = left[:room], left[room:]
            stuffing = 184 - len(part)
            adapted = stuffing > 0
            head = packed((0x47, 8), (0, 1), (int(first), 1), (0, 1), (257, 13), (0, 2), (int(adapted), 1), (1, 1), (counter % 16, 4))
            if adapted:
                size = stuffing - 1
                head += bytes([size]) + (((clock or b"\0") + b"\xff" * size)[:size])
            out += head + part
            counter, first = counter + 1, False
    return out


@pytest.mark.parametrize("size", [64, 128, 4032, 4096, 4160, 40_000, 70_016])
def test_streams_equal_plain_ones(size):
    payload = random.Random(size).randbytes(size)
    assert media.mux(payload) == plain_stream(payload)


def test_what_the_format_allows_and_what_it_does_not():
    payload = media.padded(b"word " * 3000)
    raw = media.mux(payload)
    cut = [raw[i : i + 188] for i in range(0, len(raw), 188)]
    at = next(i for i, p in enumerate(cut) if p[1] & 0x1F == 1 and p[2] == 1 and not p[1] & 0x40 and not p[3] & 0x20)
    joined = lambda *parts: b"".join(x for p in parts for x in p)
    whole = lambda media_: next(iter(media.demux(media_).values())).payload
    assert whole(joined(cut[: at + 1], [cut[at]], cut[at + 1 :])) == payload  # a packet twice in a row
    jumped = []
    for p in cut:
        if p[1] & 0x1F == 1 and p[2] == 1:
            p = p[:3] + bytes([p[3] & 0xF0 | (p[3] + 5 & 15 if jumped and any(j[2] == 1 and j[1] & 0x1F == 1 for j in jumped) else p[3] & 15)]) + p[4:]
        jumped.append(p)
    second = [i for i, p in enumerate(jumped) if p[1] & 0x1F == 1 and p[2] == 1][1]
    with pytest.raises(ValueError, match=f"packet {second}: continuity"):
        media.demux(joined(jumped))
    starts = [i for i, p in enumerate(cut) if p[1] & 0x5F == 0x41 and p[2] == 1]
    flagged = [p[:5] + bytes([p[5] | 0x80]) + p[6:] if i == starts[0] else p for i, p in enumerate(cut)]
    assert whole(joined(flagged)) == payload
    for broken, message in (
        (joined(cut[at + 1 :]), "continuity|missing|no stream"),
        (joined([p for i, p in enumerate(cut) if i != starts[0]]), "missing|continuity"),
        (joined(cut[:2]), "no stream"),
        (b"", "whole number"),
        (joined(cut[: at + 1], [cut[at]] * 2, cut[at + 1 :]), "continuity"),
        (joined(cut[:1], [cut[1][:3] + b"\x30" + b"\xff" + cut[1][5:]], cut[2:]), "adaptation"),
        (joined([cut[0][:4] + b"\xff" + cut[0][5:]], cut[1:]), "damaged program table"),
    ):
        with pytest.raises(ValueError, match=message):
            media.demux(broken)
    rng = random.Random(2)
    for _ in range(400):
        noise = bytearray(raw)
        for _ in range(rng.randrange(1, 4)):
            noise[rng.randrange(len(noise))] = rng.randrange(256)
        try:
            media.demux(bytes(noise[: rng.randrange(0, len(noise) + 1)]))
        except ValueError as e:
            assert str(e).startswith("packet ")


def test_stream_digests_of_stored_streams(spark):
    texts = ["abc", "ä" * 40_000, None, "x" * 3_000_000]
    got = {r["doc_id"]: r for r in media.stream_digests(media.stored_streams(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for k, t in enumerate(texts):
        payload = media.padded((t or "").encode())
        raw, units = plain_stream(payload), -(-len(payload) // 4096)
        assert (got[k]["media_bytes"], got[k]["media_sha256"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert got[k]["pts"] == [3600 * i for i in range(units)] and got[k]["random_access"] == [3600 * i for i in range(0, units, 8)]
        assert got[k]["feature"] == f"units={units};access={-(-units // 8)};pts=0-{3600 * (units - 1)};sum={sum(payload)};high={sum(b > 127 for b in payload)}"


def test_stream_digests(spark):
    texts = [None, "", "abc", "ä" * 5000, "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = {r["doc_id"]: r for r in media.stream_digests(media.transport_streams(docs)).collect()}
    for k, t in enumerate(texts):
        payload = media.padded((t or "").encode())
        assert (got[k]["n_bytes"], got[k]["payload_bytes"], got[k]["payload_sha256"], got[k]["tail_crc32"]) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[2].asDict() | {"doc_id": 4} == got[4].asDict() and got[0]["media_sha256"] == got[1]["media_sha256"]
    parsed = media.parse_streams(media.transport_streams(docs)).filter("doc_id = 3").first()
    assert bytes(parsed["payload"]) == media.padded(("ä" * 5000).encode()) and parsed["random_access"][0]
    assert media.stream_digests(media.transport_streams(docs.limit(0))).count() == 0


def test_pipeline_stages_follow_each_other(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, small).cache()
        assert held.columns == columns, name
        now = {r["doc_id"] for r in held.select("doc_id").collect()}
        assert now <= ids and now, name
        ids = now
    rows = [(r["doc_id"], r["text"]) for r in held.select("doc_id", "text").collect()]
    check_packing(rows, corpus_pipeline.STAGES[-1][1](spark, held, small).collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "PII", "mixing", "packing"]


def test_pipeline_stages_take_nulls_and_empty_tables(spark, small):
    import corpus_pipeline

    rows = [(1, "Eine Straße und ein Haus stehen hier am Weg", "de", "a", 1), (2, None, None, None, None), (None, "The house is not far from the street", "en", "b", 3), (3, "The house is not far from the street", "en", "b", 3), (3, "The house is not far from the street", "en", "b", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small)
        docs.collect()
