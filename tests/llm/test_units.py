"""Parts of the training-data operators without Spark."""

import hashlib
import random
import time

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from umbra.llm import merge_dropout as md
from umbra.llm import warc
from umbra.llm.exact_dedup import CuckooIndex
from umbra.llm.html_extract import content
from umbra.llm.near_dedup import _Words, banding, shingle_hashes, sketch
from umbra.llm.packing import CAPACITIES, best_fit, default_cost


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40)), max_size=200))
@settings(max_examples=60, deadline=None)
def test_cuckoo_index_is_a_multiset(steps):
    index, live = CuckooIndex(1), {}
    for insert, k in steps:
        d = hashlib.sha256(bytes([k])).digest()
        if insert:
            index.put(d, 1, (True, k, 0), 1)
            live[d] = live.get(d, 0) + 1
        else:
            assert index.drop(d, 1) == (d in live)
            if d in live:
                live[d] -= 1
                if not live[d]:
                    del live[d]
    assert {x[0]: x[3] for x in index.entries()} == live and index.live == len(live)


def test_cuckoo_index_resizes_and_verifies_content():
    index = CuckooIndex(1)
    for k in range(5000):
        index.put(hashlib.sha256(str(k).encode()).digest(), 1, (True, k, 0), 1)
    assert index.live == 5000 and index.resizes > 5
    same_print = bytearray(hashlib.sha256(b"7").digest())
    same_print[-1] ^= 1
    assert index.find(bytes(same_print), 1) == -1 and index.find(hashlib.sha256(b"7").digest(), 2) == -1


def brute_best_fit(lengths, sizes, most, cost):
    bins, of = [], []
    for n in lengths:
        fits = [(b[0] - b[1], i) for i, b in enumerate(bins) if b[0] - b[1] >= n]
        if fits:
            room = min(fits)[0]
            i = next(j for r, j in fits if r == room)
        else:
            ok = [s for s in sizes if s >= n]
            bins.append([min([s for s in ok if s <= most] or ok[:1], key=lambda s: (cost(s) / s, s)), 0])
            i = len(bins) - 1
        bins[i][1] += n
        of.append(i)
    return sum(min(cost(s) for s in sizes if s >= used) for _, used in bins), bins


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=80, deadline=None)
def test_packing_is_as_good_as_brute_force(lengths):
    sizes, lengths = (16, 32, 64), sorted(lengths, reverse=True)
    of, opened, total = best_fit(lengths, sizes, default_cost)
    used = [0] * len(opened)
    for n, b in zip(lengths, of, strict=True):
        used[b] += n
    assert all(u <= c for u, c in zip(used, opened, strict=True))
    assert all(c == min(s for s in sizes if s >= u) for u, c in zip(used, opened, strict=True))
    assert total == pytest.approx(min(brute_best_fit(lengths, sizes, m, default_cost)[0] for m in sizes))


def test_packing_opens_larger_bins_where_they_cost_less():
    assert best_fit([1500, 1500, 1000], CAPACITIES, default_cost) == ([0, 0, 0], [4096], default_cost(4096))
    # Both kinds side by side: full small bins stay small.
    of, opened, total = best_fit([2047, 2047, 1500, 1500, 1000], CAPACITIES, default_cost)
    assert sorted(opened) == [2048, 2048, 4096] and total == 2 * default_cost(2048) + default_cost(4096)
    assert of[2] == of[3] == of[4] and len(set(of)) == 3


@given(st.lists(st.integers(1, 16384), max_size=60))
@settings(max_examples=60, deadline=None)
def test_packing_with_production_capacities(lengths):
    lengths = sorted(lengths, reverse=True)
    of, opened, total = best_fit(lengths, CAPACITIES, default_cost)
    used = [0] * len(opened)
    for n, b in zip(lengths, of, strict=True):
        used[b] += n
    assert all(0 < u <= c and c == min(s for s in CAPACITIES if s >= u) for u, c in zip(used, opened, strict=True))
    assert total == pytest.approx(sum(map(default_cost, opened))) and total <= brute_best_fit(lengths, CAPACITIES, 2048, default_cost)[0] + 1e-6


MODEL = open(md.MODEL, "rb").read()
TEXTS = ["", " ", "Hello  world", " lead and trail ", "日本語 🎉\n\ttab", "a▁b ▁", "x" * 200, "\x00nul", "naïve café, 12345!"]


def test_without_dropout_it_is_the_model_itself():
    sp, enc = sentencepiece.SentencePieceProcessor(model_proto=MODEL), md.Encoder(md.load(MODEL), 0.0, 0, 1)
    for t in TEXTS:
        if "▁" not in t:
            assert enc.encode(t, 1).tolist() == sp.encode(t), t


@given(st.text(max_size=80), st.integers(0, 5), st.floats(0, 1))
@settings(max_examples=150, deadline=None)
def test_dropout_decodes_losslessly(text, seed, rate):
    codec = md.load(MODEL)
    ids = md.Encoder(codec, rate, seed, 2).encode(text, 7).tolist()
    assert codec.decode(ids) == text
    assert md.Encoder(codec, rate, seed, 2).encode(text, 7).tolist() == ids


def test_dropout_varies_and_short_and_long_agendas_agree():
    codec, rng = md.load(MODEL), random.Random(1)
    assert len({md.Encoder(codec, 0.3, s, 1).encode("understanding segmentation", 1).tobytes() for s in range(8)}) > 3
    for _ in range(200):
        w = "▁" + "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 30)))
        bar, base = int(0.2 * (1 << 32)), rng.getrandbits(64)
        assert codec._short(w, bar, base) == codec._long(w, bar, base)


def test_dropout_varies_by_place_for_words_of_every_length():
    codec = md.load(MODEL)
    enc, plain = md.Encoder(codec, 0.1, 3, 4), md.Encoder(codec, 0.0, 3, 4)
    for word in ("and", "understanding", "internationalisation"):
        one = {enc.encode(word, k).tobytes() for k in range(300)}
        assert len(one) > (4 if len(word) > 6 else 1), word
        assert plain.encode(word, 1).tobytes() in one
    places = enc.encode("understanding " * 300, 1).tolist()
    again = codec.decode(places)
    assert again == "understanding " * 300 and len(places) > 300 * len(plain.encode("understanding", 1))
    # What is kept of agendas gives what each occurrence draws on its own.
    for rate in (0.1, 0.5, 1.0):
        some = md.Encoder(codec, rate, 3, 4)
        words = ["▁" + w for w in "the understanding of segmentation and internationalisation varies".split()] * 20
        bases = md._bases(len(words), 5, 0)
        assert some._drawn(words, bases) == [codec.word(w, some.bar, int(b)).tobytes() for w, b in zip(words, bases, strict=True)]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        s = sketch(x, 205)
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (sketch(x, 205) == s).all()
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    other = np.concatenate([base[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    same = (sketch(np.unique(base), 300) == sketch(np.unique(other), 300)).mean()
    assert abs(same - 900 / 1100) < 0.12
    bands, rows = banding(0.85)
    assert (1 - 0.85**rows) ** bands <= 1e-7


def test_shingles():
    words = _Words()
    assert len(shingle_hashes("a b c d A B C", 3, words)) == 4
    assert len(shingle_hashes("a b", 3, words)) == 1 and len(shingle_hashes(" \n", 3, words)) == 0 and len(shingle_hashes(None, 3, words)) == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a>Home</a><li>About</ul></nav>
<div class="cookie-notice">We use cookies, all of them, on every page of this site.</div><aside>Related: this, that, and the other thing.</aside>
<article><h2>Title</h2><p>First <b>bold</b> paragraph &amp; more,
   with text. It goes on.</p><p>Short.</p><ul><li>one<li>two</ul><!-- no --><script>var p = "</p>";</script><p>Last one, it ends here; done.</article>
<section id="comments"><p>I liked it, really, very much so, thank you all!</p></section><form>Name <input></form><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert content(PAGE) == "Title\n\nFirst bold paragraph & more, with text. It goes on.\n\nShort.\n\none\n\ntwo\n\nLast one, it ends here; done."
    assert content(None) == "" and content("") == "" and content("<nav>x</nav>") == "" and content("<p>plain, text.") == "plain, text."
    assert content("<!-- open " + "x" * 100) == "" and content("no markup at all, just text.") == "no markup at all, just text."


def test_main_text_keeps_what_stands_beside_the_longest_child():
    long = "A sentence of some length, with marks in it, that goes on and on. " * 6
    body = f"<div class='entry-content'><p>{long}</p><p>{long}</p></div>"
    want = f"Title\n\nlead\n\n{long.strip()}\n\n{long.strip()}"
    assert content(f"<article><h1>Title</h1><p>lead</p>{body}</article>") == want
    assert content(f"<body><div id=page><h1>Title</h1><p>lead</p>{body}</div></body>") == want
    for whole in (f"<ul><li>{long}<li>{long}</ul>", f"<table><tr><td>{long}<td>{long}</table>", f"<blockquote><p>{long}</p><p>{long}</p></blockquote>"):
        assert content(f"<article><h1>Title</h1><p>lead</p>{whole}</article>") == want
        assert content(f"<div><h1>Title</h1><p>lead</p>{whole}</div>") == want


def test_main_text_is_dropped_by_no_loose_match():
    long = "A sentence of some length, with marks in it, that goes on and on. " * 6
    for wrapper in ("style='overflow:hidden'", "data-role='hidden'", "class='content has-sidebar'", "class='elementor-widget-container'", "class='post no-comments'", "class='widget'"):
        assert content(f"<body><div {wrapper}><h1>Title</h1><p>{long}</p><p>{long}</p></div></body>") == f"Title\n\n{long.strip()}\n\n{long.strip()}", wrapper
    for teaser in ("<article><p>Teaser, short.</p></article>", "<div class='post-meta'><p>By me, today.</p></div>"):
        assert long.strip() in content(f"<body>{teaser}<div><p>{long}</p><p>{long}</p></div></body>"), teaser
    assert content(f"<body><div hidden><p>{long}</p></div><div aria-hidden=true>{long}</div><div class='x share'>Share it!</div><div><p>{long}</p><p>{long}</p></div></body>") == f"{long.strip()}\n\n{long.strip()}"


LONG = "A sentence of some length, with marks in it, that goes on and on. " * 5
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Sport</a></li></ul>"
ADVERT = "<div class=ad>Buy one, get one, today only.</div>"
BODY, WANT = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>", ["Title", LONG.strip(), "Short.", LONG.strip()]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body>{MENU}<div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>Copyright</div></body>", WANT),
        (f"<body><div class='site no-sidebar'>{MENU}<div id=x>{BODY}</div></div></body>", WANT),
        (f"<div><div class='story-teaser'><p>Teaser, short.</p></div><div id=body>{BODY}</div></div>", ["Teaser, short.", *WANT]),
        (f"<table><tr><td>{MENU}<td>{BODY}<td>{ADVERT}</table>", WANT),
        (f"<article>{BODY}{MENU}</article>", WANT),
        (f"<article>{ADVERT}{BODY}<div class=share>Share it!</div></article>", WANT),
        (f"<article><h1>Title</h1><p>{LONG}<span class='ad'>Buy <span>now</span>!</span></p><p>Short.</p><p>{LONG}</article>", WANT),
        (f"<article><h1>Title</h1><p><a title=\"5\" wide\">{LONG}</a></p><p>Short.</p><p>{LONG}</article>", WANT),
        (f"<article>{BODY}</article><section class=comments><p>{LONG[:70]}</p><p>I liked it.</p></section>", WANT),
        (f"<main><nav>{MENU}</nav>{BODY}</main><aside><p>{LONG}</p></aside>", WANT),
        (f"<body><header><p>{LONG}</p></header><article><header>By me</header>{BODY}</article><footer>{LONG}</footer>", ["By me", *WANT]),
        (f"<body><div role=navigation>{MENU}</div><div>{BODY}</div><div class='cookie'>We use cookies.</div>", WANT),
        (f"<article><h2>Links</h2><p>{LONG}</p><ul><li><a href=/a>One</a>, a note on it, long enough</li><li>two</li></ul></article>", ["Links", LONG.strip(), "One, a note on it, long enough", "two"]),
        ("<article><h1>T</h1><p>One.</p></article><div class=ad>Buy it, or that, or both; now!</div>", ["T", "One."]),
        (f"<body><form><p>{LONG}</p></form><p hidden>{LONG}</p><div>{BODY}</div>", WANT),
        ("<p>1 < 2 and 3 > 2, he said.", ["1 < 2 and 3 > 2, he said."]),
        (f"<article><dl><dt>Term<dd>{LONG}<dt>Other<dd>{LONG}</dl></article>", ["Term", LONG.strip(), "Other", LONG.strip()]),
        ("<article><p>a&nbsp;b &lt;c&gt; &#233;&euro;</p><pre>x\n  y</pre></article>", ["a b <c> é€", "x y"]),
    ],
)
def test_main_text_of_labelled_pages(page, want):
    assert content(page).split("\n\n") == want


def test_path_ratios_decide(monkeypatch):
    from umbra.llm import html_extract

    pages = [f"<body>{MENU}<div id=a>{BODY}</div><section id=b>Copyright, me.</section></body>", f"<div>{MENU}<div>{ADVERT}</div><div>{BODY}</div></div>", f"<table><tr><td>{MENU}<td>{BODY}<td>{ADVERT}</table>"]
    real = [content(x) for x in pages]
    assert real == ["\n\n".join(WANT)] * 3
    monkeypatch.setattr(html_extract, "_scores", lambda page, found: {b.path: 1.0 for b in found})
    assert all(content(x) != y for x, y in zip(pages, real, strict=True))


@pytest.mark.parametrize("part", ["<a ", "<div>t", "<div>", "</x><div>", '<a x="', "<a x='>' ", "<script>", "<!--", "<x-a><p>t", "<ul><li><a>b", "< ", "<p><td><x-a><h1>q</h1>", "<div class='ad x'>t", "<a b=   ", "<textarea></textarea "])
def test_main_text_and_plain_text_take_linear_time(part):
    head, tail = "<body><p>Some text, first.</p>", "<p>Last, at the end."
    for read in (content, warc.plain_text):
        took = []
        for n in (5_000, 40_000):
            began = time.process_time()
            read(head + part * n + tail)
            took.append(time.process_time() - began)
        assert took[1] < 30 * max(took[0], 0.02), (read, took)


def test_warc_round_trip():
    payload = "<html><head><title>A &amp; B</title></head><body><p>Text</p><script>no</script><a href='/x'>l</a></body></html>".encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    source = warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a/"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", "sha1:KEEP")], block)
    request = warc.serialise([("WARC-Type", "request")], b"GET")
    out = warc.derive(request + source)
    assert [d["warc_type"] for d in out] == ["metadata", "conversion"]
    for d in out:
        ((headers, body),) = warc.parse(d["record"])
        named = dict(headers)
        assert named["WARC-Refers-To"] == "<urn:uuid:1>" and named["WARC-Target-URI"] == "http://a/" and named["WARC-Source-Payload-Digest"] == "sha1:KEEP"
        assert named["WARC-Source-Block-Digest"] == warc.digest(block) and named["WARC-Block-Digest"] == warc.digest(body)
    assert warc.parse(out[1]["record"])[0][1].decode() == "Text\nl"
    assert b"outlink: /x" in out[0]["record"] and b"title: A & B" in out[0]["record"]
    assert warc.derive(b"") == [] and len(warc.derive(warc.serialise([("WARC-Type", "response")], b""))) == 2


def test_text_of_a_page_whose_head_has_no_end_tag():
    assert warc.plain_text("<html><head><title>T</title><body><p>Hello world.</p></body></html>") == "Hello world."
    assert warc.plain_text("<html><head lang=en><meta charset=utf-8><!-- c --><style>p{}</style><title>T<b></title><link href=x>\n<p>Hello.<p>World.") == "Hello.\nWorld."
    assert warc.plain_text("<head><title>T</title><script>x</script></head>\n<body>a<header>b</header></body>") == "a\nb"
    assert warc.plain_text("<head><title>T</title>Hello, no body tag.") == "Hello, no body tag."
