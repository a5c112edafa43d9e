"""textloom convert SOURCE -o OUT | validate OUT | formats | doctor | version"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .settings import VERSION, Settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("source")
    c.add_argument("-o", "--output", required=True)
    for name, value in (("chunk-chars", 5000), ("overlap-chars", 500), ("max-file-mb", 512)):
        c.add_argument(f"--{name}", type=int, default=value)
    for name in ("no-incremental", "strict", "fail-on-error", "include-hidden"):
        c.add_argument(f"--{name}", action="store_true")
    sub.add_parser("validate").add_argument("output")
    for name in ("formats", "doctor", "version"):
        sub.add_parser(name)
    return p


def main(argv: list[str] | None = None) -> int:
    """0 done, 1 the run failed or a corpus is not sound, 2 no such source, 3 --fail-on-error and failures."""
    a = parser().parse_args(argv)
    from .functions.converters import REGISTRY

    if a.command == "version":
        print(VERSION)
        return 0
    if a.command in ("formats", "doctor"):
        for c in REGISTRY:
            said = "available" if c.available() else f"needs {c.needs}"
            print(f"{c.name:14} {said:20} {' '.join(sorted(c.extensions)) if a.command == 'formats' else ''}".rstrip())
        return 0
    if a.command == "validate":
        return _validate(a.output)
    if not Path(a.source).exists():
        print(f"no such source: {a.source}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .plans.corpus import run

    settings = Settings(a.chunk_chars, a.overlap_chars, max_file_mb=a.max_file_mb, incremental=not a.no_incremental, strict=a.strict, include_hidden=a.include_hidden)
    try:
        stats = run(SparkSession.builder.appName("textloom").getOrCreate(), a.source, a.output, settings)
    except Exception as e:  # noqa: BLE001  the exit code tells
        print(f"failed: {e}", file=sys.stderr)
        return 1
    print(" ".join(f"{k}={v}" for k, v in stats.items()))
    return 3 if a.fail_on_error and stats["failed"] else 0


def _validate(root: str) -> int:
    if not Path(root, "manifest.jsonl").exists():
        print(f"no corpus: {root}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .operators.validate import validate, validate_files
    from .sources.corpus import read

    spark = SparkSession.builder.appName("textloom").getOrCreate()
    manifest, chunks, nodes, edges = (read(spark, root, n) for n in ("manifest", "chunks", "nodes", "edges"))
    rows = validate(manifest, chunks, nodes, edges).union(validate_files(spark, root, manifest, chunks)).collect()
    print("\n".join(f"{r.check:20} {r.violations}" for r in sorted(rows)))
    return int(any(r.violations for r in rows))


if __name__ == "__main__":
    sys.exit(main())
