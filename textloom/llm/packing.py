"""Packing by best-fit decreasing.

Documents are tokenised, closed with END, and cut into full windows and one rest. Best-fit decreasing depends on the lengths
alone, and there are at most WINDOW different ones: the driver packs the histogram of lengths, whatever the number of pieces.
A segment tree indexed by remaining capacity finds the tightest open windows; windows with the same content are one entry with
a count, and a step places as many equal pieces at once as fit. The result says, for each length, which ranks go where; pieces
get their rank within their length from per-partition counts, and look their place up. No task sees more than its share.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_batches, materialize, texts

WINDOW = 2048
END = 1
VOCABULARY = "byte_bpe_50k.json"
LONG_SPACE = 100_000


@lru_cache(4)
def encoder(path: str):
    """text -> ids by the vocabulary and merges of a byte-level tokenizers file.

    The ids come from tiktoken over the same ranks, four times as fast as the tokenizers library and equal to it (tested over
    whole tables); texts that hold one of the file's added tokens go to that library itself, and so do those with a run of LONG_SPACE
    white-space characters or more, which overflow the stack of tiktoken's pattern engine, or on which it panics otherwise.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    added = {x["content"] for x in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    long_space = re.compile(r"\s{%d}" % LONG_SPACE)
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if any(a in text for a in added) or len(text) >= LONG_SPACE and long_space.search(text):
            return whole.encode(text, add_special_tokens=False).ids
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:  # a panic is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return whole.encode(text, add_special_tokens=False).ids

    return encode


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, part, local: full windows and the rest of every document.

    Null texts are empty: END alone. part and local: the task that cut the piece, and how many of that length it cut before.
    """
    schema = T._parse_datatype_string("doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, local long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        encode, part, seen = encoder(_vocabulary(vocabulary)), TaskContext.get().partitionId(), Counter()
        for b in batches:
            ids, values = (c.to_pylist() for c in b.columns)
            out = []
            for i, t in zip(ids, values):
                got = np.array(encode(t) + [END], "<u4")
                for at in range(0, len(got), window):
                    cut = got[at : at + window]
                    out.append((i, at, len(cut), zlib.crc32(cut.tobytes()), len(got), part, seen[len(cut)]))
                    seen[len(cut)] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

    return texts(docs).mapInArrow(run, schema)


class Tree:
    """Segment tree over remaining capacities 0..window: which of them has open windows."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.any = np.zeros(2 * self.size, bool)

    def set(self, k: int, value: bool) -> None:
        k += self.size
        self.any[k] = value
        while k > 1:
            k >>= 1
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def at_least(self, k: int) -> int:
        """The smallest capacity of k or more with an open window, or -1."""
        k += self.size
        if self.any[k]:
            return k - self.size
        while k > 1:
            if not k & 1 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return -1


def best_fit(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(length, first rank, number, first sequence, offset)], number of sequences).

    Pieces of one length and consecutive ranks go to consecutive sequences at the same offset. That is the packing that
    best-fit decreasing makes piece by piece, up to the names of equal windows: a piece goes to an open window of the least
    capacity that holds it (so equal pieces fill one window before the next), and opens one where none does.
    """
    tree, open_at, plan, sequences = Tree(window), {}, [], 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.at_least(length)
            if room < 0:
                room, first = window, sequences
                n = -(-left // (window // length))
                sequences += n
            else:
                first, n = open_at[room].pop()
                if not open_at[room]:
                    tree.set(room, False)
            fit = room // length
            full = min(n, left // fit)
            if full:
                for k in range(fit):
                    plan.append((length, rank + k * full, full, first, window - room + k * length))
                _open(open_at, tree, room - fit * length, first, full)
                rank, left, first, n = rank + full * fit, left - full * fit, first + full, n - full
            if n and 0 < left < fit:
                for k in range(left):
                    plan.append((length, rank + k, 1, first, window - room + k * length))
                _open(open_at, tree, room - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            if n:
                _open(open_at, tree, room, first, n)
    return plan, sequences


def _open(open_at, tree: Tree, room: int, first: int, n: int) -> None:
    if room > 0:
        if not open_at.get(room):
            tree.set(room, True)
        open_at.setdefault(room, []).append((first, n))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: every piece and its place. No documents, no pieces.

    Repeated rows and equal or null ids are documents of their own.
    """
    rows = materialize(pieces(docs, vocabulary, window))
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialize(counts.withColumn("before", F.coalesce(before, F.lit(0))))  # a row for each task and length
    plan, _ = best_fit({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, window)  # `window` rows at most
    places: dict[int, list] = {}
    for length, *run in plan:
        places.setdefault(length, []).append(run)
    table = {k: np.array(sorted(v), np.int64) for k, v in places.items()}  # bounded by the window, not by the corpus
    # As many rows as tasks times lengths, which no bound holds: never broadcast, however small its compressed files look.
    ranked = rows.join(counts.select("part", "length", "before").hint("merge"), ["part", "length"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("local") + F.col("before")).alias("rank"))

    def place(ids, start, length, crc, tokens, rank):
        seq, off = [], []
        for n, r in zip(length, rank):
            t = table[n]
            lo, _, first, offset = t[np.searchsorted(t[:, 0], r, "right") - 1]
            seq.append(int(first + r - lo))
            off.append(int(offset))
        return ids, start, length, crc, tokens, seq, off

    return map_batches(ranked, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
