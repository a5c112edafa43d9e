"""Single cases: what each operator must not lose, and hostile texts that must take linear time."""

import gzip
import os
import random
import re
import struct
import time

import pytest
from textloom.llm import common, decontaminate, html, media, pii, toxicity

LONG = "A long sentence, with commas, that says something about the matter at hand, and goes on. " * 4


def quick(f, *args, seconds=6):
    t = time.time()
    out = f(*args)
    assert time.time() - t < seconds
    return out


def test_sample_is_never_empty():
    for rows in (10, 8_000, 10**6, 10**10, 10**12, 10**15):
        cut = common.sample_cut(rows, 8_000)
        assert abs(rows * cut / 2**62 - min(rows, 8_000)) < 1, rows
    assert common.calls([1] * 2500) == [(0, 1024), (1024, 2048), (2048, 2500)] and common.calls([]) == []
    assert common.calls([1 << 30, 5, 5, 9 << 20]) == [(0, 1), (1, 3), (3, 4)]


@pytest.mark.parametrize(
    "page",
    [
        '<div style="overflow: hidden"><p>{}</p></div>', '<p title="a hidden gem">{}</p>', '<p class="market share">{}</p>', '<p class="search">{}</p>', '<div class="row hidden-xs"><p>{}</p></div>',
        '<div class="no-sidebar"><article><p>{}</p></article></div>', '<div class="sidebar-layout"><main><p>{}</p></main></div>', '<div class="has-sidebar"><p>{}</p></div>', '<div id="header"><div class="comments"><article><p>{}</p></article></div></div>',
        '<p>{}</p><p hidden>not seen</p>', '<p>{}</p><div aria-hidden="true">not seen</div>', '<div style="color:red; display : none">not seen</div><p>{}</p>', '<article><p>{}</p><div class="ad">not seen</div></article>',
        '<article><p>{}</p><div class="user-comments">not seen</div><section id="related-posts">not seen</section></article>', '<script>var a = "<p>";</script><!-- x --><p>{}', '<p data-x=\'a > b\' class=x>{}</p>',
    ],
)
def test_html_keeps_and_cuts(page):
    assert html.extract(page.format(LONG)) == LONG.strip()


def test_html_headings_quotes_and_angles():
    assert html.extract(f"<body><h1>T</h1><div><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><h2>S</h2></div></body>") == f"T\n\n{LONG.strip()}\n\n{LONG.strip()}"
    assert html.extract(f'<p>x <a href="foo>link</a> tail {LONG}</p>') == f"x link tail {LONG.strip()}"
    assert html.extract("a < b and <c no close") == "a < b and <c no close"


@pytest.mark.parametrize("part,times", [('<a "', 250_000), ("<!x", 300_000), ("<i>", 330_000), ("<p><div><i>", 90_000), ('<a x="', 160_000), ("<", 1_000_000), ("<p>word ", 120_000), ("<script>", 120_000), ("<a x='\">", 120_000), ("</b><i>", 140_000)])
def test_html_is_linear(part, times):
    quick(html.extract, part * times)
    quick(html.extract, part * times + ">")


def test_media_validators_confirm():
    aho = media.automaton()
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 0) + b"IEND" + struct.pack(">I", __import__("zlib").crc32(b"IEND"))
    assert media.sniff(b"fLaC\x80\0\0\x22" + b"\xff" * 60 + png, aho) == [(68, 20, "image/png")]
    assert media.sniff(b"%PDF-1.4 nothing startxref %%EOF" + png, aho) == [(32, 20, "image/png")]
    flac = _flac(3)
    for whole in (flac, _mp4(), gzip.compress(os.urandom(70_000) + b"x" * 2_000_000)):
        (a, n, _), (b, m, _) = media.sniff(b"pad" + whole + b"more" + whole, aho)
        assert (a, n, b, m) == (3, len(whole), 7 + len(whole), len(whole))
        assert media.sniff(whole[:-1], aho) == [] or whole[4:8] == b"ftyp"
    assert media.sniff(flac[:60] + b"\1" + flac[61:], aho) == []  # a wrong checksum


def _flac(n):
    head = b"fLaC\x80\0\0\x22" + struct.pack(">HH", 192, 192) + bytes(6) + (44100 << 44 | 15 << 36 | 192 * n).to_bytes(8, "big") + bytes(16)
    for k in range(n):
        frame = bytes([0xFF, 0xF8, 0x19, 0x08, k])
        frame += bytes([_crc(frame, 8, 0x07), 0]) + struct.pack(">h", 7 * k)
        head += frame + struct.pack(">H", _crc(frame, 16, 0x8005))
    return head


def _crc(data, bits, poly):
    crc = 0
    for byte in data:
        crc ^= byte << bits - 8
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc >> bits - 1 else crc << 1) & (1 << bits) - 1
    return crc


def _mp4():
    box = lambda k, d: struct.pack(">I", 8 + len(d)) + k + d
    return box(b"ftyp", b"isom\0\0\0\0isom") + box(b"moov", b"x" * 30) + box(b"mdat", b"y" * 9)


@pytest.mark.parametrize("part", [b"PK\x03\x04PK\x05\x06", b"%PDF-", b"%PDF-startxref 5 %%EOF ", b"fLaC\x80\0\0\x22", b"\0\0\0\x08ftyp", b"II*\0\x08\0\0\0", b"ID3\x03\0\0\0\0\0\0", b"GIF89a", b"GIF89a\0\0\0\0\0\0\0\x21\0", b"\x1f\x8b\x08", b"\xff\xd8\xff", b"OggS\0\x02", b"RIFF", b"BM", b"\x89PNG\r\n\x1a\n"])
def test_media_is_linear(part):
    quick(media.sniff, part * (1_000_000 // len(part)), media.automaton())


def test_ip_pattern_is_linear_and_the_same():
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(4)
    for _ in range(20_000):
        t = "".join(rng.choices("0123.....25 a", k=rng.randint(0, 40)))
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in plain.finditer(t)], t
    for t in ("..." + "1" * 1_000_000, "1." * 500_000, "a@" * 500_000, "+1(" * 330_000, "at " * 330_000, "one " * 250_000):
        quick(pii.base_spans, t)


def test_items_of_every_length_within_their_edits():
    """Items of 12 to 60 characters, each with as many edits as its budget, at every place for one edit."""
    rng = random.Random(2)
    letters = "abcdefghijklmno"
    for m in range(12, 61):
        item = "".join(rng.choices(letters, k=m))
        index = decontaminate._split([(1, item)])
        k = int(m * decontaminate.ERRORS)
        for at in range(m if k else 1):
            t = list(item)
            for place in [at, *rng.sample(range(m), k - 1)] if k else []:
                t[place] = rng.choice(["z", t[place] + "z", ""]) if 0 < place < m - 1 and k == 1 else "z"
            text = "lead in of some length " + "".join(t) + " and what comes after it"
            assert any(x.matches([text]) for x in index), (item, text)


def test_repetitive_items_and_texts():
    base = "the quick brown fox jumps over a lazy dog near the river bank and runs"
    for text in ((base + " ") * 12_000, "a " * 500_000, "abcabc" * 160_000):
        for item, there in ((base, base in text), ("a " * 400, text.startswith("a a")), ("abc" * 300, text.startswith("abc"))):
            got = [quick(x.matches, [text], seconds=5) for x in decontaminate._split([(1, item)])]
            assert any(got) == there
    item, text = "la " * 60, "once " + "la " * 30 + "lo " + "la " * 29 + "end"
    assert any(x.matches([text]) for x in decontaminate._split([(1, item)]))


@pytest.mark.parametrize(
    "text,weight",
    [
        ("You are an idiot", 1.0), ('"' + "word " * 30 + 'an idiot goes here" it read', 0.25), ('"Stop. An idiot." she wrote', 0.25), ("He said that she called him an idiot", 0.25), ("they yelled 'an idiot' there", 0.25),
        ("don't be an idiot, it's bad", 1.0), ("„so ein idiot“ hieß es", 0.25), ("« un idiot »", 0.25), ('5" idiot', 1.0), ('"one\nidiot"', 1.0), ("“an idiot”", 0.25), ("‘an idiot’ it ran", 0.25), ('"you idiot" she said', 1.0),
    ],
)
def test_quotation_and_report(text, weight):
    assert [h[4] for h in toxicity.Lexicon({"idiot": 1.0}, {}).hits(text)[1]] == [weight]


def test_quotations_are_linear():
    for t in ("“" * 1_000_000, '"idiot ' * 150_000, "' idiot" * 150_000):
        quick(toxicity.Lexicon({"idiot": 1.0}, {}).hits, t, seconds=12)


def test_testable_features():
    assert toxicity.testable({1: 900, 2: 90, 9: 10}, 0.1) == 10 and toxicity.testable({5: 3}, 0.9) == 1 and toxicity.testable({50: 3}, 0.1) == 3 and toxicity.testable({}, 0.1) == 1


def test_only_own_tables_are_deleted(spark, tmp_path):
    mine = tmp_path / "textloom-input" / "documents.parquet"
    spark.range(3).write.parquet(str(mine))
    common.drop_tables(spark.read.parquet(str(mine)))
    assert mine.exists()
    own = common.materialize(spark.range(3).toDF("id"))
    common.drop_tables(own)
    with pytest.raises(Exception, match="textloom-|exist"):
        own.count()
