"""Whole runs over mixed trees: artifacts, incremental state, archives, isolation, publication."""

import gzip
import io
import json
import os
import sqlite3
import tarfile
import zipfile
from pathlib import Path

import pytest
from textloom import cli
from textloom.plans import corpus
from textloom.settings import Settings


def rows(root, name):
    return [json.loads(x) for x in Path(root, f"{name}.jsonl").read_text(encoding="utf-8").splitlines()]


@pytest.fixture()
def tree(tmp_path):
    src = tmp_path / "src"
    (src / "nested").mkdir(parents=True)
    (src / "node_modules").mkdir()
    w = lambda name, data: (src / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    w("plain.txt", "first line\nsecond line\n")
    w("unicode.txt", "é 中".encode("utf-16"))
    w("notes.md", "# Top\n\nsee [note](nested/note.txt) and https://example.org/x\n\n## Sub\n\ntext\n")
    w("nested/note.txt", "a note")
    w("code.py", "def f():\n    return 1\n")
    w("data.json", '{"b": 1, "a": true}')
    w("rows.jsonl", '{"i": 1}\n{"i": 2}\n')
    w("config.yaml", "a: 1\nb: 2\n")
    w("table.csv", "name,value\nx,1\ny,2\n")
    w("page.html", "<html><head><title>Ti &amp; tle</title></head><body><h1>H</h1><p>para</p><script>bad()</script></body></html>")
    w("notebook.ipynb", json.dumps({"cells": [{"cell_type": "markdown", "source": "md"}, {"cell_type": "code", "source": "1", "outputs": []}]}))
    w("mail.eml", "From: a@example.org\nTo: b@example.org\nSubject: Sub\n\nbody text\n")
    w("captions.srt", "1\n00:00:01,000 --> 00:00:02,000\nhello\nthere\n")
    db = sqlite3.connect(src / "sample.sqlite")
    db.execute("create table facts (id integer primary key, value text)")
    db.execute("insert into facts values (1, 'v')")
    db.commit()
    db.close()
    with zipfile.ZipFile(src / "bundle.zip", "w") as z:
        z.writestr("inside/archive-note.txt", "from the archive")
        inner = io.BytesIO()
        with tarfile.open(fileobj=inner, mode="w") as t:
            i = tarfile.TarInfo("deep.txt")
            i.size = 4
            t.addfile(i, io.BytesIO(b"deep"))
            link = tarfile.TarInfo("link.txt")
            link.type, link.linkname = tarfile.SYMTYPE, "deep.txt"
            t.addfile(link)
        z.writestr("inner.tar", inner.getvalue())
    w("bad.bin", b"\0\1\2")
    w("broken.pdf", b"%PDF-1.4 x")
    w(".hidden.txt", "no")
    w("node_modules/x.js", "no")
    os.symlink(src / "plain.txt", src / "link.txt")
    return src


FILE_CHECKS = ["documents_missing", "front_matter", "documents_unknown", "index_lines", "chunk_in_body"]


def files_checked(spark, out):
    from textloom.operators.validate import validate_files
    from textloom.sources.corpus import read

    return {r.check: r.violations for r in validate_files(spark, str(out), read(spark, str(out), "manifest"), read(spark, str(out), "chunks")).collect()}


def test_file_checks_find_their_faults(spark, tmp_path):
    src, out = tmp_path / "s", tmp_path / "o"
    (src / "sp ace").mkdir(parents=True)
    for k in range(6):
        (src / f"sp ace/f+{k}%.txt").write_text(f"text number {k}\n\nwith two parts")
    corpus.run(spark, str(src), str(out))
    assert files_checked(spark, out) == dict.fromkeys(FILE_CHECKS, 0)
    folder = out / "documents/sp ace"
    (folder / "f+0%.txt.md").unlink()
    (folder / "stray.md").write_text("x")
    p = folder / "f+1%.txt.md"
    p.write_text(p.read_text().replace('parser: "text"', 'parser: "code"'))
    p = folder / "f+2%.txt.md"
    p.write_text(p.read_text().replace("with two parts", "with other parts"))
    index = (out / "INDEX.md").read_text().splitlines()
    (out / "INDEX.md").write_text("\n".join(index[:-1]) + "\n")
    assert files_checked(spark, out) == {"documents_missing": 1, "front_matter": 1, "documents_unknown": 1, "index_lines": 1, "chunk_in_body": 1}


def test_tampered_unreadable_and_changing_files(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "s", tmp_path / "o"
    (src / "in").mkdir(parents=True)
    for n in ("a", "b", "c"):
        (src / f"in/{n}.txt").write_text(f"text {n}")
    assert corpus.run(spark, str(src), str(out))["converted"] == 3
    p = out / "documents/in/a.txt.md"
    good = p.read_text()
    p.write_text(good + "tampered")
    (out / "documents/in/b.txt.md").unlink()
    again = corpus.run(spark, str(src), str(out))
    assert (again["converted"], again["skipped"]) == (2, 1) and p.read_text() == good and (out / "documents/in/b.txt.md").exists()

    # a file that goes and one that grows between listing and reading
    from textloom.sources import walk

    files = spark.createDataFrame(walk.listing(spark, src).collect(), walk.FILES)
    (src / "in/a.txt").unlink()
    (src / "in/b.txt").write_text("text b and more")
    got = {r.source_path: r.error_type for r in walk.read(files).collect()}
    assert got == {"in/a.txt": "FileNotFoundError", "in/b.txt": "SourceChangedDuringRead", "in/c.txt": None}
    monkeypatch.setattr(walk, "listing", lambda *_: files)
    stats = corpus.run(spark, str(src), str(out))
    assert stats["failed"] == 2 and {(r["source_path"], r["stage"]) for r in rows(out, "errors")} == {("in/a.txt", "read"), ("in/b.txt", "read")}


def test_a_dead_publication_is_undone(spark, tmp_path):
    src, out = tmp_path / "s", tmp_path / "o"
    src.mkdir()
    (src / "a.txt").write_text("one")
    corpus.run(spark, str(src), str(out))
    before = (out / "manifest.jsonl").read_bytes()
    old = out / "_state/previous"
    old.mkdir()
    for name in ("documents", "manifest.jsonl"):  # as a killed run leaves them
        os.replace(out / name, old / name)
    (out / "documents").mkdir()
    corpus.recover(out)
    assert (out / "manifest.jsonl").read_bytes() == before and (out / "documents/a.txt.md").exists() and not old.exists()
    assert corpus.run(spark, str(src), str(out))["skipped"] == 1


def test_an_output_that_cannot_be_written_is_an_error_row(spark, tmp_path):
    src, out = tmp_path / "s", tmp_path / "o"
    src.mkdir()
    (src / ("n" * 253)).write_text("the name grows too long with .md")
    (src / "a.txt").write_text("fine")
    stats = corpus.run(spark, str(src), str(out))
    assert (stats["converted"], stats["failed"]) == (1, 1) and [r["stage"] for r in rows(out, "errors")] == ["write"] and len(rows(out, "manifest")) == 1


def test_links_decode_what_they_can(spark):
    from pyspark.sql import functions as F
    from textloom.functions.columns import unquote

    links = ["a%20b", "%zz%20a", "a+b%", "%C3%A9%", "plain"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in links], "u string").select(unquote(F.col("u"))).collect()] == ["a b", "%zz a", "a+b%", "é%", "plain"]


def test_run_twice_changes_nothing_and_validates(spark, tree, tmp_path):
    out = tmp_path / "out"
    stats = corpus.run(spark, str(tree), str(out))
    paths = {r["source_path"] for r in rows(out, "manifest")}
    assert {"bundle.zip!/inside/archive-note.txt", "bundle.zip!/inner.tar!/deep.txt", "plain.txt", "sample.sqlite"} <= paths and not {p for p in paths if "node_modules" in p or "hidden" in p or "link" in p}
    assert stats["discovered"] == 17 and stats["converted"] == 16 and stats["unsupported"] == 1 and stats["failed"] == 1 and stats["chunks"] == len(rows(out, "chunks"))
    assert {r["source_path"]: r["error_type"] for r in rows(out, "errors")} == {"bad.bin": "UnsupportedFormat", "broken.pdf": "RuntimeError"}
    assert {r["type"] for r in rows(out, "edges")} == {"contains", "next", "references_url", "links_to"}
    text = (out / "documents/notes.md").read_text()
    assert text.startswith("---\nengine:") and text.endswith("## Sub\n\ntext\n")
    assert "bad()" not in (out / "documents/page.html.md").read_text() and "Ti & tle" in (out / "documents/page.html.md").read_text()
    assert "documents/bundle.zip__archive__/inside/archive-note.txt.md" in (out / "INDEX.md").read_text()
    before = {p.relative_to(out): p.read_bytes() for p in out.rglob("*") if p.is_file() and "_state" not in p.parts and p.name != "REPORT.md"}
    again = corpus.run(spark, str(tree), str(out))
    assert again["skipped"] == 16 and again["converted"] == 0
    assert before == {p.relative_to(out): p.read_bytes() for p in out.rglob("*") if p.is_file() and "_state" not in p.parts and p.name != "REPORT.md"}

    from textloom.operators.validate import validate
    from textloom.sources.corpus import read

    checks = validate(*(read(spark, str(out), n) for n in ("manifest", "chunks", "nodes", "edges"))).collect()
    assert len(checks) == 18 and all(r.violations == 0 for r in checks), checks
    assert files_checked(spark, out) == dict.fromkeys(FILE_CHECKS, 0)
    (tree / "plain.txt").write_text("changed")
    (tree / "code.py").unlink()
    third = corpus.run(spark, str(tree), str(out))
    assert third["converted"] == 1 and third["skipped"] == 14 and not (out / "documents/code.py.md").exists()
    with pytest.raises(ValueError, match="other sources"):
        corpus.run(spark, str(tree / "plain.txt"), str(out))


def test_guards_locks_and_rollback(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "s", tmp_path / "o"
    src.mkdir()
    (src / "README").write_text("one")
    (src / "README.md").write_text("two")
    for bad in (src, tmp_path):
        with pytest.raises(ValueError, match="contain"):
            corpus.run(spark, str(src), str(bad))
    corpus.run(spark, str(src), str(out))
    assert len({r["output_path"] for r in rows(out, "manifest")}) == 2
    kept = (out / "manifest.jsonl").read_bytes()
    (out / "_state/lock").write_text("x")
    with pytest.raises(RuntimeError, match="another run"):
        corpus.run(spark, str(src), str(out))
    (out / "_state/lock").unlink()
    (src / "README").write_text("three")
    real, n = os.replace, [0]

    def failing(a, b):
        n[0] += 1
        if n[0] == 5:
            raise OSError("disk")
        real(a, b)

    monkeypatch.setattr(corpus.os, "replace", failing)
    with pytest.raises(OSError, match="disk"):
        corpus.run(spark, str(src), str(out))
    monkeypatch.setattr(corpus.os, "replace", real)
    assert (out / "manifest.jsonl").read_bytes() == kept and "one" in (out / "documents/README.md").read_text()


def test_limits_strict_and_settings(spark, tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    (src / "big.txt").write_bytes(b"x" * (2 << 20))
    with zipfile.ZipFile(src / "up.zip", "w") as z:
        z.writestr("../x.txt", "x")
    stats = corpus.run(spark, str(src), str(tmp_path / "o"), Settings(max_file_mb=1))
    assert stats["failed"] == 2 and {r["stage"] for r in rows(tmp_path / "o", "errors")} == {"limits", "archive"}
    with pytest.raises(RuntimeError, match="FileTooLarge"):
        corpus.run(spark, str(src), str(tmp_path / "p"), Settings(max_file_mb=1, strict=True))
    for bad, name in ((dict(chunk_chars=100), "chunk_chars"), (dict(overlap_chars=-1), "overlap"), (dict(chunk_chars=500, overlap_chars=499), "overlap")):
        with pytest.raises(ValueError, match=name):
            Settings(**bad).validate()


def test_cli(spark, tree, tmp_path, capsys):
    assert cli.main(["version"]) == 0 and cli.main(["formats"]) == 0 and cli.main(["doctor"]) == 0
    assert "generic-text" in capsys.readouterr().out
    assert cli.main(["convert", str(tmp_path / "none"), "-o", str(tmp_path / "x")]) == 2
    assert cli.main(["convert", str(tree), "-o", str(tree)]) == 1
    assert cli.main(["convert", str(tree), "-o", str(tmp_path / "y"), "--fail-on-error"]) == 3
    assert cli.main(["validate", str(tmp_path / "none")]) == 2 and cli.main(["validate", str(tmp_path / "y")]) == 0
    (tmp_path / "y/documents/code.py.md").unlink()
    assert cli.main(["validate", str(tmp_path / "y")]) == 1 and "documents_missing    1" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    from textloom.streaming.ingest import ingest

    (tmp_path / "in/a b").mkdir(parents=True)
    (tmp_path / "in/c").mkdir()
    (tmp_path / "in/a b/x.txt").write_text("one")
    (tmp_path / "in/c/x.txt").write_text("one")
    (tmp_path / "in/bad.bin").write_bytes(b"\0\1")
    (tmp_path / "in/big.txt").write_bytes(b"x" * (2 << 20))
    for n in (2, 3):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), Settings(max_file_mb=1)).awaitTermination(60)
        got = spark.read.parquet(str(tmp_path / "out/chunks")).collect()
        assert len({r.chunk_id for r in got}) == len({r.source_id for r in got}) == n
        (tmp_path / "in/b.txt").write_text("two")
    assert {r.source_path for r in got} == {"a b/x.txt", "c/x.txt", "b.txt"}
    assert {(r.source_path, r.stage, r.error_type) for r in spark.read.parquet(str(tmp_path / "out/errors")).collect()} == {("bad.bin", "convert", "UnsupportedFormat"), ("big.txt", "limits", "FileTooLarge")}


def test_gzip_alone_is_no_text(spark):
    from textloom.functions.converters import Unsupported, convert

    with pytest.raises(Unsupported):
        convert(gzip.compress(b"x"), "a.gz")
