"""Single rules: chunks, decoding, converters, and columns against their plain twins."""

import sys
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from textloom.functions import converters, rules
from textloom.settings import Settings


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=6000), st.integers(500, 4000), st.integers(0, 50))
def test_chunk_invariants(text, target, share):
    got = rules.chunks(text, target, target * share // 100)
    assert all(t.strip() and len(t) <= target for _, t in got)
    assert got == rules.chunks(text, target, target * share // 100)
    if share == 0:
        assert "".join("".join(t for _, t in got).split()) == "".join(text.split())


@given(st.binary(max_size=3000))
def test_decode_never_fails(data):
    text, name = rules.decode(data)
    assert isinstance(text, str) and name


@pytest.mark.parametrize("blank", ["", "\n", "   ", "\n\n \t"])
def test_blank_gives_none(blank):
    assert rules.chunks(blank) == []


def test_section_paths_and_merge():
    md = "pre\n# A\ntext\n### C\nx\n## B\ny\n# A\nz\n# A\nw"
    assert [p for p, _ in rules.sections(md)] == [(), ("A",), ("A", "C"), ("A", "B"), ("A",), ("A",)]
    assert rules.chunks(md)[-1] == (("A",), "# A\nz\n\n# A\nw")


def test_long_text_is_quick():
    assert len(rules.chunks("word " * 200_000, 1000, 500)) < 3000


@pytest.mark.parametrize(("data", "want"), [(b"a\xc3\xa9", "utf-8"), (b"a\xe9", "cp1252"), (b"\x81\x80", "latin-1"), (b"\xef\xbb\xbfx", "utf-8-sig"), ("é".encode("utf-16"), "utf-16"), ("é".encode("utf-32"), "utf-32"), (b"\xff\xfea", "cp1252")])
def test_decode(data, want):
    assert rules.decode(data)[1] == want


def test_clean_and_fence():
    assert rules.clean("\na \t\r\nb\x00\x85c\u2028d\r") == "a\nb\nc\nd\n" and rules.fence("x ``` y\n", "z") == "````z\nx ``` y\n````\n"


def test_safe_members():
    assert [rules.safe_member(x) for x in ("ok/a", "./a//b", "..x/y", "d/a:b", "../x", "a/../x", "/x", "C:\\x", "..\\x", "a:b/c", "", "./")] == ["ok/a", "a/b", "..x/y", "d/a:b", *[None] * 8]


def test_walker_on_odd_markup():
    read = lambda t: converters.html_markdown(t, "d")
    assert read("<table><tr><td>A</td><td>B</td></tr></table>") == ("d", "A | B\n") and read("<h2>x <b>y</b></h2><p>t<script>no") == ("d", "## x y\nt\n")
    assert read("<a class=x href='u'>l <i>m</i></a> tail<br>n") == ("d", "[l m](u) tail\nn\n") and read("<head><title>T &amp; u</title><meta></head>b") == ("T & u", "b\n")
    assert read("<h1>open <p>text") == ("d", "open text\n") and read("a < b") == ("d", "a < b\n") and read("") == ("d", "\n")
    for part in ("<head>", "<title>", "<!--", "<", "<script>", "<a href='x'>", "<h1>"):
        t = time.time()
        read(part * 100_000)
        assert time.time() - t < 5, part


def test_optional_libraries(tmp_path, monkeypatch):
    """With a library of that name, the converter reads; without, it says so."""
    (tmp_path / "docling").mkdir()
    (tmp_path / "docling/__init__.py").write_text("")
    (tmp_path / "docling/document_converter.py").write_text("class DocumentConverter:\n    def convert(self, f):\n        data = open(f, 'rb').read()\n        class R:\n            class document:\n                export_to_markdown = staticmethod(lambda: 'seen ' + data.decode())\n        return R\n")
    (tmp_path / "markitdown.py").write_text("class MarkItDown:\n    def convert(self, f):\n        class R:\n            text_content, title = 'epub text', 'Book'\n        return R\n")
    (tmp_path / "extract_msg.py").write_text("import contextlib\n@contextlib.contextmanager\ndef openMsg(f):\n    class A:\n        longFilename, shortFilename = 'a.doc', None\n    class M:\n        subject, sender, to, cc, date, body, attachments = 'Sub', 'a@b', 'c@d', None, None, 'text', [A]\n    yield M\n")
    by = {c.name: c for c in converters.REGISTRY}
    assert not by["docling"].available()
    with pytest.raises(RuntimeError, match="docling is not installed.*markitdown is not installed"):
        converters.convert(b"%PDF", "a.pdf")
    monkeypatch.syspath_prepend(str(tmp_path))
    for name in ("docling", "docling.document_converter", "markitdown", "extract_msg"):  # forgotten again after the test
        monkeypatch.setitem(sys.modules, name, None)
        del sys.modules[name]
    assert by["docling"].available() and by["markitdown"].available() and by["outlook-msg"].available()
    got = [converters.convert(b"%PDF", "a.pdf"), converters.convert(b"x", "m.msg"), by["markitdown"].run(b"x", converters.PurePosixPath("b.epub"))]
    assert [(r.parser, r.title) for r in got] == [("docling", "a"), ("outlook-msg", "Sub"), ("markitdown", "Book")]
    assert got[0].markdown == "seen %PDF\n" and "**From:** a@b" in got[1].markdown and "- `a.doc`" in got[1].markdown and got[2].markdown == "epub text\n"


def test_settings_digest():
    assert len({Settings().digest(), Settings(chunk_chars=600).digest(), Settings(strict=True).digest()}) == 3 and Settings().digest() == Settings().digest()


@pytest.mark.parametrize(("name", "data", "has"), [
    ("a.html", b"<p>x</p><script>bad", "x"), ("a.html", b"<table><tr><td>A</td><td>B</td></tr></table>", "A | B"), ("t.csv", b'a,b\n"x\r\ny",2\n', "| x y | 2 |"), ("e.csv", b"", "_Empty table._"), ("t.tsv", b"a\tb|c\n", r"b\|c"),
    ("x.xml", b'<!DOCTYPE a [<!ENTITY e "v">]><a>&e;</a>', "```text"), ("b.json", b"{bad", "```text"), ("v.vtt", b"WEBVTT\n\n00:01 --> 00:02\nhi", "- **00:01 --> 00:02** hi"), ("Dockerfile", b"FROM x", "```dockerfile"), ("CMakeLists.txt", b"x", "x\n"), ("f.yaml", b"a: ```", "````\na"),
])
def test_converters(name, data, has):
    assert has in converters.convert(data, name).markdown


def test_refusals():
    for bad in ("<!DOCTYPE a [<!ENTITY e 'v'>]><a/>", "<a>&undefined;</a>"):
        with pytest.raises(ValueError, match="Unsafe"):
            converters.check_xml(bad)
    with pytest.raises(RuntimeError, match="docling"):
        converters.convert(b"%PDF", "a.pdf")
    with pytest.raises(converters.Unsupported):
        converters.convert(b"a" * 70_000 + b"\0", "a.unknown")
