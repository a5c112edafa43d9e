"""Members of ZIP and TAR archives as rows. An archive that breaks a rule gives one error row, and none of its members stay."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import rules
from ..functions.mime import ARCHIVES
from ..settings import Settings

OUT = "archive string, place string, member string, member_no long, size long, content binary, error_type string, message string"


def is_archive(path: Column) -> Column:
    out = F.lit(False)
    for suffix in ARCHIVES:
        out = out | F.lower(path).endswith(suffix)
    return out


def members(name: str, data: bytes, max_files: int, max_bytes: int):
    """(member, bytes) in portable order, each read when its turn comes. Names and declared sizes are all checked before."""
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            found = [(i.filename, i.file_size, i) for i in z.infolist() if not i.is_dir()]
            for member, _, i in _claimed(found, max_files, max_bytes):
                yield member, z.read(i)
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            found, total = [], 0
            for i in t:
                if i.isfile():  # links are never made
                    found.append((i.name, i.size, i))
                    total += i.size
                    if len(found) > max_files or total > max_bytes:
                        break  # no need to unpack the rest to refuse it
            for member, size, i in _claimed(found, max_files, max_bytes):
                got = t.extractfile(i).read()
                if len(got) != size:
                    raise ValueError(f"Archive member is cut short: {member}")
                yield member, got


def _claimed(found: list[tuple], max_files: int, max_bytes: int) -> list[tuple]:
    """The members under their safe names, sorted; raises where a rule is broken."""
    if len(found) > max_files:
        raise ValueError(f"Archive holds more than {max_files} files")
    if sum(f[1] for f in found) > max_bytes:
        raise ValueError(f"Archive expands beyond {max_bytes} bytes")
    out: dict[str, tuple] = {}
    for name, size, i in found:
        if (member := rules.safe_member(name)) is None:
            raise ValueError(f"Unsafe archive path: {name}")
        if (k := rules.portable_key(member)) in out:
            raise ValueError(f"Archive members collide: {member}")
        out[k] = member, size, i
    return [out[k] for k in sorted(out)]


def expand(archives: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """OUT for archives (source_path, place, content). A damaged member shows when its turn comes: whole() leaves such archives out."""
    schema = T._parse_datatype_string(OUT)
    arrow = to_arrow_schema(schema)
    files, size = settings.archive_max_files, settings.archive_max_expanded_mb << 20

    def one(path, place, data):
        try:
            n = 0
            for n, (member, got) in enumerate(members(path, data, files, size), 1):
                yield path, place, member, n - 1, len(got), got, None, None
        except Exception as e:  # noqa: BLE001  failures are data; expanded() drops what came before
            yield path, place, None, 0, 0, None, type(e).__name__, str(e)

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):  # an archive at a time, and of it a member at a time
                path, place, data = (c.slice(at, 1).to_pylist()[0] for c in b.columns)
                for row in one(path, place, data or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, arrow)], schema=arrow)

    return archives.select("source_path", "place", "content").mapInArrow(run, schema)


def whole(expanded: DataFrame) -> DataFrame:
    """Members of archives that no error row belongs to."""
    return expanded.where("error_type is null").join(expanded.where("error_type is not null").select("archive").distinct(), "archive", "left_anti")
