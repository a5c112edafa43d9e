"""What Python workers get and give: a few rows of an Arrow batch at a time, and none twice."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from textloom.operators import chunking, tables, validate
from textloom.plans import catalogue

from tests.conftest import TINY


@pytest.fixture
def caught(spark, monkeypatch):
    """The functions that queries hand to mapInArrow."""
    held, frame = [], type(spark.range(0))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: held.append(f) or plain(self, f, *a, **b))
    return held


def test_pages(spark, tmp_path, caught):
    """html_docs rewrites 1,024 pages or 8 MB of them at a time, whatever the size of the batch that Spark sends."""
    pages = pa.table({"page_id": pa.array([1]), "url": ["u"], "html": ["<p>x</p>"]})
    pq.write_table(pages, tmp_path / "pages.parquet")
    catalogue.html_docs(spark, str(tmp_path))
    n, big = 2500, 6
    html = ["<p>x</p>"] * n + ["<p>" + "y" * (3 << 20) + "</p>"] * big
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array(range(n + big)), "url": ["u"] * (n + big), "html": html})
    (run,) = caught
    out = list(run(iter([batch])))
    assert max(b.num_rows for b in out) <= 1024 and max(b.nbytes for b in out) < 9 << 20
    got = pa.Table.from_batches(out)
    assert got["page_id"].to_pylist() == list(range(n + big)) and got["markdown"].to_pylist()[0] == "# 0\n\nx\n"


def test_chunks(spark, caught):
    """Chunks and sections of 8 MB of texts at a time: the bytes bound what a worker holds, not only the rows."""
    docs = spark.createDataFrame([("s", "p", "t")], "source_id string, source_path string, markdown string")
    chunking.split(docs)
    chunking.section_table(docs)
    n, text = 40, "word " * 200_000
    batch = pa.RecordBatch.from_pydict({"source_id": [*map(str, range(n))], "source_path": ["p"] * n, "markdown": [text] * n})
    chunks, sections = caught
    for run, columns in ((chunks, batch), (sections, batch.select(["source_id", "markdown"]))):
        out = list(run(iter([columns])))
        assert max(b.nbytes for b in out) < 12 << 20
        assert dict.fromkeys(pa.Table.from_batches(out)["source_id"].to_pylist()) == dict.fromkeys(map(str, range(n)))


@pytest.mark.parametrize("name", ["validate_damaged", "validate_corpus"])
def test_validation_converts_once(spark, monkeypatch, name):
    """The checks read written tables, and these are gone afterwards."""
    seen, plain = [], validate.validate
    monkeypatch.setattr(validate, "validate", lambda *frames: seen.extend(frames) or plain(*frames))
    before = set(tables._made)
    got = catalogue.QUERIES[name](spark, TINY)
    assert len(seen) == 4 and not any("MapInArrow" in df._jdf.queryExecution().toString() for df in seen)
    folder = Path(tables.shared_folder(spark).removeprefix("file:"))
    assert got.count() == len(catalogue.CHECKS)
    left = {p.name for p in folder.iterdir()} & tables._made
    assert left <= before | {f.rsplit("/", 2)[-2] for f in got.inputFiles()}
    tables.drop_tables(got)
