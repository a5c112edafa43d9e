"""Settings of a corpus run, their checks and their digest."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields

VERSION = "0.1.0"
#: Raised when the same settings give other output.
REVISION = "1"


@dataclass(frozen=True)
class Settings:
    chunk_chars: int = 5000
    overlap_chars: int = 500
    min_chunk_chars: int = 200
    max_file_mb: int = 512
    incremental: bool = True
    strict: bool = False
    include_hidden: bool = False
    archive_depth: int = 3
    archive_max_files: int = 5000
    archive_max_expanded_mb: int = 2048

    def validate(self) -> Settings:
        if self.chunk_chars < 500:
            raise ValueError("chunk_chars must be at least 500")
        if self.overlap_chars < 0:
            raise ValueError("overlap_chars must not be negative")
        if self.overlap_chars > self.chunk_chars // 2:
            raise ValueError("overlap_chars must be at most half of chunk_chars")
        return self

    def digest(self) -> str:
        """Changes with every setting and with the engine's version: state under another digest is made anew."""
        h = hashlib.blake2b(f"{VERSION}/{REVISION}".encode(), digest_size=16)
        for f in fields(self):
            h.update(f"\n{f.name}={getattr(self, f.name)!r}".encode())
        return h.hexdigest()
