"""SimHash near-dedup with pivot distance tables.

Distinct fingerprints (64 bits) meet in buckets: any two that differ in 3 bits or fewer agree on two of five blocks, so each
goes to the ten buckets of its block pairs. In a bucket, a table of Hamming distances to reference fingerprints (pivots)
discards pairs whose largest coordinate difference exceeds the radius (triangle inequality, so nothing is lost), and survivors
are verified by XOR and popcount. Buckets above LARGE are cut again on the bits that their key leaves free, by the same
pigeonhole argument, so that a group of near copies costs no quadratic work. A bucket gives a tree of links of degree 3 at most,
which joins the same fingerprints as all its links do. Components come from minimum labels passed along the trees, with pointer
jumps; every round is written to the shared folder.

Tasks read their buckets one after the other. A bucket above HOT fingerprints is dealt out anew, before any task sees it, to four
buckets on its free bits, and so on down, so no task holds more of one. The pipeline's stage, with the rule of 5 words and 0.8,
is near_copies.keep_first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, map_batches, materialize, scratch, texts

RADIUS = 3
#: Five blocks of bits; a bucket key is two of them.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
PAIRS = [(a, b) for a in range(5) for b in range(a)]
LARGE = 1024
_MASKS = [((1 << BLOCKS[a][1]) - 1) << BLOCKS[a][0] | ((1 << BLOCKS[b][1]) - 1) << BLOCKS[b][0] for a, b in PAIRS]
_FULL = (1 << 64) - 1
#: Reference fingerprints: fixed, spread over the cube.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot%d" % k, 7) for k in range(16)], np.uint64)
#: Fingerprints of a bucket that one task holds at most (about 60 bytes each while it works), and rows that a task is dealt.
HOT, DEALT = 1_000_000, 4_000_000


def fingerprint(text: str) -> int:
    """Majority bits of the XXH64 (seed 42) of 3-word shingles, repeats included; zero without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    hashes = [h(s, 42) for s in map(b" ".join, zip(w, w[1:], w[2:]))] if len(w) >= 3 else [h(b" ".join(w), 42)]
    n, ones = len(hashes), np.zeros(64, np.int64)
    bits = np.array(hashes, np.dtype("<u8"))
    for at in range(0, n, 8192):
        ones += np.unpackbits(bits[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(ids, values):
        got = np.array([fingerprint(t) for t in values], np.uint64).view(np.int64)
        return ids, got

    return map_batches(texts(docs), run, "doc_id long, fp long")


def _verified(fp: np.ndarray, at: np.ndarray, to: np.ndarray, table: np.ndarray) -> np.ndarray:
    keep = np.ones(len(at), bool)
    for column in table:  # pivots in turn: most pairs fall at the first few
        k = np.flatnonzero(keep)
        if not len(k):
            return keep
        keep[k[np.abs(column[at[k]] - column[to[k]]) > RADIUS]] = False
    k = np.flatnonzero(keep)
    keep[k[np.bitwise_count(fp[at[k]] ^ fp[to[k]]) > RADIUS]] = False
    return keep


class _Sets:
    """Union-find over 0..n-1 with whole-array root lookups."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if np.array_equal(nxt, self.up):
                return nxt
            self.up = nxt

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        r = self.roots()
        a, b = r[a], r[b]
        while True:
            m = a != b
            if not m.any():
                return
            a, b = a[m], b[m]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            r = self.roots()
            a, b = r[a], r[b]


def _link(fp: np.ndarray, group: np.ndarray, free: int, sets: _Sets, rows: np.ndarray) -> None:
    """Unites all pairs within RADIUS among fp that share a group number. free: bits on which members of a group may differ."""
    table = np.bitwise_count(fp[None, :] ^ PIVOTS[:, None]).astype(np.int8)
    order = np.lexsort((table[0], group))
    fp, group, table, rows = fp[order], group[order], table[:, order], rows[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(fp)])
    big = sizes > LARGE
    places = [k for k in range(64) if free >> k & 1]
    if big.any() and len(places) > RADIUS + 1:
        hot = np.repeat(big, sizes)
        parts = np.array_split(places, RADIUS + 1)
        for part in parts:  # a pair differs in 3 bits at most, so one of the four parts agrees
            mask = sum(1 << int(k) for k in part)
            f, r = fp[hot], rows[hot]
            _, sub = np.unique(np.stack([group[hot].astype(np.uint64), f & np.uint64(mask)]), axis=1, return_inverse=True)
            sub = sub.reshape(-1)
            multi = np.bincount(sub)[sub] > 1
            if multi.any():
                _link(f[multi], sub[multi], free & ~mask, sets, r[multi])
        keep = ~hot
        fp, group, table, rows = fp[keep], group[keep], table[:, keep], rows[keep]
    at = np.arange(len(fp))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(fp)]
        at = at[(group[at] == group[at + step]) & (table[0][at + step] - table[0][at] <= RADIUS)]  # sorted by the first pivot
        k = at[_verified(fp, at, at + step, table[1:])]
        if len(k):
            sets.unite(rows[k], rows[k + step])


def bucket_links(fps: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Tree links (parent, child) that join what pairs within RADIUS join among the distinct fps, which differ in free bits only."""
    sets = _Sets(len(fps))
    _link(fps, np.zeros(len(fps), int), free, sets, np.arange(len(fps)))
    root = sets.roots()
    order = np.lexsort((fps, root))  # members of a set stand together, smallest fingerprint first
    r = root[order]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    place = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    child = np.flatnonzero(place > 0)
    parent = child - place[child] + (place[child] - 1) // 2
    return fps[order[parent]], fps[order[child]]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _parts(free: int) -> list[int]:
    """What stays free in each of the four buckets that take over from one: a pair differs in 3 bits at most, so one of four parts agrees."""
    places = [k for k in range(64) if free >> k & 1]
    return [free & ~sum(1 << int(k) for k in part) for part in np.array_split(places, RADIUS + 1)]


def _dealt(classes: DataFrame, hot: int) -> DataFrame:
    """fp, free, at: every fingerprint in its buckets, none of which holds more than `hot`."""

    def keyed(df: DataFrame, frees: list[int], *under) -> DataFrame:
        of = [F.struct(F.lit(_signed(f)).alias("free"), F.xxhash64(*under, F.lit(f"{f:x}"), F.col("fp").bitwiseAND(F.lit(_signed(_FULL & ~f)))).alias("at")) for f in frees]
        return df.select("fp", F.explode(F.array(*of)).alias("k")).select("fp", "k.free", "k.at")

    now, out, level = keyed(classes.select("fp"), [_FULL & ~m for m in _MASKS]), [], [_FULL & ~m for m in _MASKS]
    while True:
        sizes = now.groupBy("at").count()
        level = [f for f in dict.fromkeys(level) if f.bit_count() > RADIUS + 1]
        large = sizes.where(F.col("count") > hot).select("at")
        if not level or not large.limit(1).count():
            out.append(now)
            break
        large = materialize(large)
        out.append(now.join(large, "at", "left_anti"))
        again = now.join(large, "at").where(F.col("free").isin([_signed(f) for f in level]))
        out.append(now.join(large, "at").where(~F.col("free").isin([_signed(f) for f in level])))  # as small as they get: 2**4 fingerprints at most
        now = materialize(_union([keyed(again.where(F.col("free") == _signed(f)), _parts(f), F.col("at")) for f in level]))
        level = [g for f in level for g in _parts(f)]
    return _union(out)


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df)
    return first


def _links(classes: DataFrame, hot: int) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp)."""
    spark = classes.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), classes.count() * len(PAIRS) // DEALT + 1)
    dealt = _dealt(classes, hot).repartition(n, "at").sortWithinPartitions("at")

    def run(batches):
        held: list = []  # of the bucket that the last batch ended in

        def links(parts):
            f = np.unique(np.concatenate([p[0] for p in parts]))
            return bucket_links(f, int(parts[0][1])) if len(f) > 1 else (f[:0], f[:0])

        for b in batches:
            f, free, at = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            f, free = f.view(np.uint64), free.view(np.uint64)
            edges = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]
            got = []
            for x, y in zip(edges, edges[1:]):
                if held and held[0][2] != at[x]:
                    got.append(links(held))
                    held = []
                held.append((f[x:y], free[x], at[x]))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*got)], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in links(held)], names=["a", "b"])

    return dealt.select("fp", "free", "at").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for the nodes of edges (a, b): minimum labels with pointer jumps, O(log n) rounds."""
    both = materialize(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a")))
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        told = both.join(labels, both.src == labels.node).select(F.col("dst").alias("node"), "label")
        near = materialize(told.union(labels).groupBy("node").agg(F.min("label").alias("label")))
        # A label's own label: looked up once for each distinct label, then dealt out in salted copies, as many nodes share one.
        asked = near.select("label").distinct()
        jump = asked.join(near.select(F.col("node").alias("label"), F.col("label").alias("to")), "label").where("to < label")
        salted = jump.select("label", "to", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
        nodes = near.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(16)).cast("int"))
        new = materialize(nodes.join(salted, ["label", "salt"], "left").select("node", F.coalesce("to", "label").alias("label")))
        drop_tables(near)
        changed = new.join(labels.select("node", F.col("label").alias("old")), "node").where("label <> old").limit(1).count()
        drop_tables(labels)
        labels = new
        if not changed:
            drop_tables(both)
            return labels


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links of 3 bits or fewer).

    Null texts are empty; documents without words have fingerprint zero and are linked like any other. Every row gives a row: rows
    that repeat an id or a text fall where their texts do. Null doc_ids are kept and never smallest; extra columns, whatever
    their names, are not read; a text of any length is one fingerprint; an empty table gives none.
    """
    with scratch(docs.sparkSession) as keep:
        fps = materialize(fingerprints(docs))
        classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
        edges = materialize(_links(classes.select("fp"), hot))
        labels = components(edges)
        linked = classes.join(labels, classes.fp == labels.node, "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("label"))
        low = linked.groupBy("label").agg(F.min("first").alias("component_id"))
        # Only linked classes need another's smallest doc_id; their labels are salted, as one may hold very many classes.
        multi = low.join(labels.select("label").distinct(), "label")
        salted = multi.select("label", "component_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
        of = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(16)).cast("int")).join(salted, ["label", "salt"], "left")
        of = materialize(of.select("fp", "n", F.coalesce("component_id", "first").alias("component_id")))
        # Fingerprints of over a 500th of all rows, fewer than 500, are dealt out to many tasks.
        often = F.broadcast(of.where(F.col("n") > fps.count() // 500).select("fp", F.lit(True).alias("often")))
        salt = F.when(F.col("often"), F.pmod(F.xxhash64("doc_id"), F.lit(64))).otherwise(0).cast("int")
        left = fps.join(often, "fp", "left").select("doc_id", "fp", salt.alias("salt"))
        right = of.join(often, "fp", "left").select("fp", "component_id", F.explode(F.when(F.col("often"), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))).alias("salt"))
        return keep(materialize(left.join(right, ["fp", "salt"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")))
