"""Column expressions: identities, normal forms, names and renderings. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\x1f"
def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def stable_id(prefix: str, *parts) -> Column:
    """prefix_ and 24 hex digits of the SHA-256 of the parts joined by U+001F."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws(SEP, *(p.cast("string") for p in map(_c, parts))), 256), 1, 24))


def approx_tokens(text) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(_c(text)) + 3) / 4)).cast("long")


def base_name(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def folder(path) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def extension(path) -> Column:
    """The last suffix in lower case; names that begin with their only dot have none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.*[^.].*?(\.[^.]+)$|^$", 1))


def output_name(path, marker: bool = False) -> Column:
    """Markdown files keep their name, others get .md; marker adds eight digits of the path's digest."""
    name = base_name(path)
    named = F.when(extension(path).isin(".md", ".markdown"), name).otherwise(F.concat(name, F.lit(".md")))
    if not marker:
        return named
    bare = F.when(F.lower(F.right(named, F.lit(3))) == ".md", F.left(named, F.length(named) - 3)).otherwise(named)
    return F.concat(bare, F.lit("-"), F.substring(F.sha2(_c(path), 256), 1, 8), F.lit(".md"))


def output_path(path, marker: bool = False) -> Column:
    """documents/ and the path with its Markdown name; every ! becomes __archive__."""
    logical = F.replace(_c(path), F.lit("!"), F.lit("__archive__"))
    up = folder(logical)
    return F.concat(F.lit("documents/"), F.when(up != "", F.concat(up, F.lit("/"))).otherwise(""), output_name(logical, marker))


def unquote(url) -> Column:
    """Percent-decoding that keeps + and broken escapes and decodes all others."""
    whole = F.regexp_replace(F.replace(_c(url), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(whole), _c(url))


def index_line(source_path, output, parser, n) -> Column:
    """A line of the index: escaped label, quoted target."""
    label = F.regexp_replace(_c(source_path), r"([\\\[\]])", r"\\$1")
    target = F.replace(F.replace(F.replace(F.url_encode(_c(output)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A"))
    target = F.replace(target, F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit("- ["), label, F.lit("]("), target, F.lit(") — `"), _c(parser), F.lit("` — "), _c(n).cast("string"), F.lit(" chunks"))


def sorted_json(nulls: bool = True, /, **fields) -> Column:
    """Compact JSON with sorted keys; nulls are written or left out."""
    return F.to_json(F.struct(*(_c(v).alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": str(not nulls).lower()})


def front_matter(fields: list[tuple[str, Column, bool]]) -> Column:
    """(name, value, text or not) as YAML between --- lines; text is JSON-quoted with YAML's forbidden characters escaped."""

    def said(value: Column, is_text: bool) -> Column:
        if not is_text:
            return F.coalesce(value.cast("string"), F.lit("null"))
        quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        for code in (0x7F, 0x2028, 0x2029, 0xFEFF, *range(0x80, 0xA0)):
            quoted = F.replace(quoted, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
        return F.when(value.isNull(), F.lit("null")).otherwise(quoted)

    lines = [F.concat(F.lit(f"{name}: "), said(value, is_text)) for name, value, is_text in fields]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---\n\n"))
