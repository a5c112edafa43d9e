"""Media types and languages by file extension, pinned so that results don't depend on the host."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

_BY_TYPE = {
    "text/plain": "log txt ini cfg conf properties env editorconfig gitignore gitattributes npmrc dockerignore", "text/markdown": "md markdown", "text/asciidoc": "adoc asciidoc", "text/x-rst": "rst",
    "text/html": "html htm", "application/xhtml+xml": "xhtml", "application/xml": "xml xsd", "image/svg+xml": "svg", "text/csv": "csv", "text/tab-separated-values": "tsv",
    "application/json": "json", "application/jsonl": "jsonl", "application/x-ndjson": "ndjson", "application/x-ipynb+json": "ipynb", "application/yaml": "yaml yml", "application/toml": "toml",
    "application/vnd.sqlite3": "db sqlite sqlite3", "application/vnd.apache.parquet": "parquet pq", "message/rfc822": "eml", "application/vnd.ms-outlook": "msg", "text/vtt": "vtt", "application/x-subrip": "srt",
    "application/zip": "zip", "application/x-tar": "tar", "application/gzip": "gz tgz", "application/x-bzip2": "bz2", "application/x-xz": "xz",
    "application/pdf": "pdf", "application/epub+zip": "epub", "application/x-mobipocket-ebook": "mobi", "application/msword": "doc", "application/vnd.ms-excel": "xls", "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp",
    "image/jpeg": "jpg jpeg", "image/png": "png", "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tif tiff", "image/webp": "webp",
    "audio/mpeg": "mp3", "audio/wav": "wav", "audio/ogg": "ogg", "audio/mp4": "m4a", "audio/flac": "flac", "audio/aac": "aac",
    "video/mp4": "mp4", "video/webm": "webm", "video/quicktime": "mov", "video/x-matroska": "mkv", "video/x-msvideo": "avi",
    "text/x-shellscript": "sh bash zsh fish", "text/x-batch": "bat cmd", "text/x-powershell": "ps1", "text/javascript": "js mjs cjs", "text/x-typescript": "ts", "text/tsx": "tsx", "text/jsx": "jsx", "text/css": "css",
    "text/x-scss": "scss", "text/x-less": "less", "text/x-vue": "vue", "text/x-svelte": "svelte", "text/x-python": "py pyw", "text/x-r": "r", "text/x-ruby": "rb", "text/x-php": "php", "text/x-perl": "pl", "text/x-lua": "lua",
    "text/x-c": "c h", "text/x-c++": "cpp cc cxx hpp", "text/x-csharp": "cs", "text/x-fsharp": "fs fsx", "text/x-java": "java", "text/x-kotlin": "kt kts", "text/x-scala": "scala", "text/x-groovy": "groovy", "text/x-go": "go", "text/x-rust": "rs",
    "text/x-swift": "swift", "text/x-dart": "dart", "text/x-elixir": "ex exs", "text/x-erlang": "erl", "text/x-solidity": "sol", "text/x-protobuf": "proto", "text/x-hcl": "tf hcl", "text/x-dockerfile": "dockerfile",
    "application/sql": "sql", "application/graphql": "gql graphql", "application/x-tex": "tex", "application/x-latex": "latex",
}
MIME = {f".{e}": kind for kind, names in _BY_TYPE.items() for e in names.split()}
UNKNOWN = "application/octet-stream"

_BY_LANGUAGE = {
    "python": "py pyw", "javascript": "js mjs cjs", "typescript": "ts", "c": "c h", "cpp": "cpp cc cxx hpp", "csharp": "cs", "rust": "rs", "ruby": "rb", "kotlin": "kt kts", "bash": "sh bash", "powershell": "ps1", "batch": "bat cmd",
    "perl": "pl", "elixir": "ex exs", "erlang": "erl", "fsharp": "fs fsx", "solidity": "sol", "latex": "tex", "graphql": "graphql gql", "protobuf": "proto", "hcl": "tf hcl",
}
LANGUAGE = {f".{e}": lang for lang, names in _BY_LANGUAGE.items() for e in names.split()}
LANGUAGE |= {f".{e}": e for e in "tsx jsx java go php swift zsh fish sql r lua scala dart groovy vue svelte css scss less dockerfile".split()}
CONFIG = frozenset(f".{e}" for e in "toml yaml yml cfg ini conf env properties npmrc editorconfig dockerignore gitattributes gitignore".split())
TEXT = frozenset(f".{e}" for e in "md markdown txt rst adoc asciidoc log".split())
RICH = frozenset(f".{e}" for e in "pdf epub mobi doc docx xls xlsx ppt pptx odt ods odp png jpg jpeg gif bmp tif tiff webp mp3 wav ogg m4a flac aac mp4 webm mov mkv avi latex msg".split())
ARCHIVES = (".tar.gz", ".tar.bz2", ".tar.xz", ".tgz", ".tar", ".zip")
BINARY = RICH | frozenset(f".{e}" for e in "db sqlite sqlite3 pq parquet gz bz2 xz tgz tar zip".split())


#: Extensions beyond the pinned ones, from the library's own table, which no file of the host changes.
OTHERS = {k: v for k, v in mimetypes.MimeTypes(filenames=()).types_map[True].items() if k not in MIME}


def mime_type(extension: Column) -> Column:
    """The media type of an extension in lower case, with its dot."""
    kinds = F.create_map(*(F.lit(x) for kv in {**OTHERS, **MIME}.items() for x in kv))
    return F.coalesce(F.try_element_at(kinds, extension), F.lit(UNKNOWN))
