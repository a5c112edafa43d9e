"""Rules on single texts that need a loop: decoding, sections, windows, chunks. Used in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

BOMS = [(b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")]
HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*$")
CONTROL = re.compile("[\0-\x08\x0b\x0c\x0e-\x1f\x7f]")


def bom_of(data: bytes) -> str | None:
    return next((name for mark, name in BOMS if data.startswith(mark)), None)


def decode(data: bytes) -> tuple[str, str]:
    for name in filter(None, (bom_of(data), "utf-8", "cp1252")):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1"), "latin-1"


def clean(text: str) -> str:
    text = CONTROL.sub("", re.sub("\r\n?", "\n", text))
    return "\n".join(map(str.rstrip, text.splitlines())).strip() + "\n"


def fence(text: str, language: str = "") -> str:
    ticks = "`" * max(3, 1 + max(map(len, re.findall("`+", text)), default=0))
    return f"{ticks}{language}\n{text.rstrip()}\n{ticks}\n"


def portable_key(path: str) -> str:
    """Equal for paths that some file system can't tell apart."""
    return "/".join(unicodedata.normalize("NFC", p).casefold().rstrip(" .") for p in path.replace("\\", "/").split("/"))


#: Folders that a tree walk leaves out.
IGNORED = frozenset(".git .hg .svn .venv venv node_modules __pycache__ dist build target .tox .nox .mypy_cache .pytest_cache .ruff_cache .idea .vscode".split())


def enters(folder: str, include_hidden: bool = False) -> bool:
    return folder not in IGNORED and (include_hidden or not folder.startswith("."))


def discovered(path: str, include_hidden: bool = False) -> bool:
    """Whether a walk finds the file of this relative path: under no ignored folder, and hidden in no part."""
    *folders, name = path.split("/")
    return all(enters(f, include_hidden) for f in folders) and (include_hidden or not name.startswith("."))


def safe_member(name: str) -> str | None:
    """An archive member's path in plain form; None unless relative, without .. parts and without a drive or scheme in the first."""
    name = name.replace("\\", "/")
    parts = name.split("/")
    if not name or name.startswith("/") or ".." in parts or ":" in parts[0]:
        return None
    return "/".join(p for p in parts if p not in ("", ".")) or None


def order_key(path: str) -> str:
    """Sorts paths as a portable file system would list them, then by their exact form."""
    return "\0".join((portable_key(path), unicodedata.normalize("NFC", path), path))


def sections(markdown: str) -> list[tuple[tuple[str, ...], str]]:
    """(heading path, text) of each part that a heading opens; its line stays in the text. Headings in code count too."""
    levels: dict[int, str] = {}
    done, lines = [], []

    def end() -> None:
        if text := "\n".join(lines).strip():
            done.append((tuple(levels[k] for k in sorted(levels) if levels[k]), text))
        lines.clear()

    for line in markdown.splitlines():
        if m := HEADING.match(line):
            end()
            depth = len(m[1])
            for k in [k for k in levels if k >= depth]:
                del levels[k]
            levels[depth] = m[2].strip()
        lines.append(line)
    end()
    return done or [((), markdown.strip())]


def cut(text: str, start: int, target: int) -> int:
    """Where the window that begins at start ends: after the last blank line, line end or blank of its second half."""
    stop = start + target
    if stop >= len(text):
        return len(text)
    for mark in ("\n\n", "\n", " "):
        at = text.rfind(mark, start + target // 2, stop)
        if at > start:
            return at + len(mark)
    return stop


def windows(text: str, target: int, overlap: int) -> list[str]:
    if len(text) <= target:
        return [text]
    out, start = [], 0
    while True:
        end = cut(text, start, target)
        out.append(text[start:end].strip())
        if end >= len(text):
            return [p for p in out if p]
        start = max(end - overlap, start + 1)


def chunks(markdown: str, target: int = 5000, overlap: int = 500, least: int = 200) -> list[tuple[tuple[str, ...], str]]:
    """(heading path, text): windows of all sections; a short one joins its predecessor of equal path where both fit."""
    out: list[tuple[tuple[str, ...], str]] = []
    for path, body in sections(markdown):
        for piece in windows(body, target, overlap):
            if not piece.strip():
                continue
            if out and len(piece) < least and out[-1][0] == path and len(out[-1][1]) + len(piece) + 2 <= target:
                out[-1] = path, out[-1][1] + "\n\n" + piece
            else:
                out.append((path, piece))
    return out
