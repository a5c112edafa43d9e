"""The pipeline's near-dedup: SimHash with pivot distance tables, for a Jaccard similarity of 0.8 or more between sets of 5-word shingles.

A fingerprint of 64 bits is too short for such pairs (they differ in over 20 at times, unrelated ones in 32), so it has 256. Pairs
of similarity 0.8 differ in RADIUS bits or fewer, but for a chance of 7e-13; of unrelated pairs one in 26,000 does. Bit blocks of
such a fingerprint would select too little (one of 16 bits agrees in 7 % of these pairs), so that nodes meet by bands of minimum
hashes; all else is decided on the fingerprints, and then on the sets. Steps, on distinct shingle sets (nodes):

1. Nodes with an equal band share a bucket, whose smallest node is a pivot. A table of Hamming distances holds every node and its
   pivots. A node within RADIUS of one is measured exactly against the nearest, and joined within a Jaccard distance of 0.2.
2. Buckets that are of one component then hold no other link that matters, and go. Of the others, up to LARGE nodes in a task,
   pairs of two components are discarded by a table of distances to pivots (triangle inequality, so nothing is lost), then by XOR;
   texts are read only of nodes that are left, and their pairs counted out. Larger buckets, and nodes in many, are dealt out anew
   by their rarest shingles, which leaves only nodes that can reach 0.8 with one of another component; those that still meet in
   large numbers are cut into blocks, and each pair of blocks is a task's group, judged likewise.

No task holds more than one such group, and no pair is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, scratch
from .simhash import components

WORDS = 5
#: All bands miss a pair of similarity 0.8 with a chance of (1 - 0.8**5)**52 = 1e-9.
BANDS, ROWS = 52, 5
#: Bits of the 256 that may differ, and pivots of a group's table. A bit differs with a chance of 0.1875 at most (4 of 5 shingles in common;
#: of long texts acos(8 / 9) / pi = 0.15).
RADIUS, PIVOTS = 96, 8
#: Nodes of a bucket that are compared in one task at once, and buckets of a node before it is looked up by rare shingles instead.
LARGE, BUSY = 256, 8
#: Shingles of a cluster's nodes that one task holds at most, whatever their number.
MOST = 4_000_000
_FULL = (1 << 64) - 1
_SEEDS = np.array([k * 0x9E3779B97F4A7C15 & _FULL for k in range(4)], np.uint64)
_FACTORS = np.array([xxhash.xxh64_intdigest(b"row%d" % k, 7) | 1 for k in range(BANDS * ROWS)], np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """The distinct XXH64 of 5-word shingles, ascending; a shorter text is one shingle, a text without words holds none."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    hashes = [h(s, 42) for s in map(b" ".join, zip(w, w[1:], w[2:], w[3:], w[4:]))] if len(w) >= WORDS else [h(b" ".join(w), 42)] if w else []
    return np.unique(np.array(hashes, np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each of BANDS groups of ROWS minimum hashes."""
    low = np.full(BANDS * ROWS, _FULL, np.uint64)
    for at in range(0, len(shingles), 1024):
        low = np.minimum(low, (_FACTORS[:, None] * shingles[None, at : at + 1024]).min(1))
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).view(np.int64)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash in four longs: a bit is set where it is in over half the shingles' hashes, each stretched to 256 bits. Zero without shingles."""
    x = _SEEDS[:, None] + shingles
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    ones = np.zeros((8, 32), np.int64)
    for at in range(0, len(shingles), 255):  # sums in lanes of a byte
        ones += (x[:, at : at + 255] >> np.arange(8, dtype=np.uint64)[:, None, None] & np.uint64(0x0101010101010101)).sum(2).view(np.uint8)
    return np.packbits(2 * ones.T > len(shingles)).view(np.int64)


def near_pairs(fps: np.ndarray, labels: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a < b) of the fingerprints (rows of four unsigned longs) that have two labels and differ in `radius` bits or fewer.

    A table of distances to pivots, each the farthest from those before it, discards what differs by more in one of them.
    """
    at, to = np.triu_indices(len(fps), 1)
    k = labels[at] != labels[to]
    at, to = at[k], to[k]
    far, least = 0, np.full(len(fps), 257)
    for _ in range(PIVOTS if len(fps) > 2 else 0):
        column = np.bitwise_count(fps ^ fps[far]).sum(1).astype(np.int64)
        k = np.abs(column[at] - column[to]) <= radius
        at, to = at[k], to[k]
        least = np.minimum(least, column)
        far = int(least.argmax())
        if not len(at) or not least[far]:
            break
    k = np.bitwise_count(fps[at] ^ fps[to]).sum(1).astype(np.int64) <= radius
    return at[k], to[k]


def _identity(shingles: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(shingles.tobytes(), 7), np.uint64).view(np.int64))


def similar_sets(sets: list[np.ndarray], known: list | None = None, near: np.ndarray | None = None) -> np.ndarray:
    """For each set the smallest number of a set that it is joined with over pairs of Jaccard similarity 0.8 or more; no pair is left out.

    Two such sets share one of the rarest fifth of their shingles (prefix filter), and each pair that does is counted out, unless
    it is joined already. known: sets with an equal entry are joined from the start. near: a square of pairs that the fingerprints leave.
    """
    up = [*range(len(sets))]

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    at: dict = {}
    for k, x in enumerate(known or ()):
        up[k] = at.setdefault(x, k)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    parts = np.split(token, np.cumsum([len(x) for x in sets])[:-1])
    index: dict[int, list[int]] = {}
    for i in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        n, mine = len(sets[i]), parts[i]
        prefix = mine[np.lexsort((mine, often[mine]))][: n - (4 * n + 4) // 5 + 1]
        prefix = prefix[often[prefix] > 1].tolist()
        for j in {j for t in prefix for j in index.get(t, ())}:
            m = len(sets[j])
            if near is not None and not near[i, j]:
                continue
            if 5 * m >= 4 * n and (a := root(i)) != (b := root(j)) and _close(both := len(np.intersect1d(mine, parts[j], assume_unique=True)), n, m):
                up[max(a, b)] = min(a, b)
        for t in prefix:
            index.setdefault(t, []).append(i)
    return np.array([root(k) for k in range(len(sets))])


def _close(both: int, n: int, m: int) -> bool:
    return 9 * both >= 4 * (n + m)  # both / (n + m - both) >= 4 / 5


def _measured(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pivot, node, distance, close for distinct pairs (pivot, node). A pivot's nodes are dealt out in lots of about LARGE, its text with each."""
    lots = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(LARGE)).alias("lots"))
    nodes = pairs.join(lots, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("lots")).alias("lot"), "node").join(reps, "node")
    pivots = lots.select("pivot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.col("pivot").alias("node")).join(reps, "node")
    cols = ["pivot", F.col("lot").cast("long").alias("lot"), "node", "text"]
    rows = pivots.select(*cols, F.lit(0).alias("role")).union(nodes.select(*cols, F.lit(1).alias("role")))
    rows = rows.repartition("pivot", "lot").sortWithinPartitions("pivot", "lot", "role").select("pivot", "node", "text", "role")

    def run(batches):
        own = np.zeros(0, np.uint64)
        for b in batches:
            out = []
            for pivot, node, text, role in zip(*(c.to_pylist() for c in b.columns)):
                s = shingle_set(text)
                if _identity(s) != node:
                    continue  # another text under the same key
                if not role:
                    own = s
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True))
                out.append((pivot, node, 1 - both / max(1, len(own) + len(s) - both), _close(both, len(own), len(s))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=["pivot", "node", "distance", "close"])

    return rows.mapInArrow(run, "pivot long, node long, distance double, close boolean").distinct()


def _near(groups: DataFrame, fps: DataFrame) -> DataFrame:
    """gid, node, label, fp: of the groups (gid, node, label; LARGE nodes or about that) what is within RADIUS of a node with another label."""
    rows = groups.join(fps, "node").select("gid", "node", "label", "fp").repartition("gid").sortWithinPartitions("gid")
    radius, names = RADIUS, ["gid", "node", "label", "fp"]

    def left(parts):
        gid, node, label, fp = (np.concatenate(x) for x in zip(*parts))
        k = np.unique(np.concatenate(near_pairs(fp, label, radius)))
        return gid[k], node[k], label[k], fp[k]

    def run(batches):
        held: list = []  # of the group that the last batch ended in
        for b in batches:
            gid, node, label = (c.to_numpy(zero_copy_only=False) for c in b.columns[:3])
            fp = b.columns[3].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 4)
            edges = np.r_[0, np.flatnonzero(gid[1:] != gid[:-1]) + 1, len(gid)]
            got = []
            for x, y in zip(edges, edges[1:]):
                if held and held[0][0][0] != gid[x]:
                    got.append(left(held))
                    held = []
                held.append((gid[x:y], node[x:y], label[x:y], fp[x:y]))
            if got:
                yield _batch(got, names)
        if held:
            yield _batch([left(held)], names)

    return rows.mapInArrow(run, "gid long, node long, label long, fp array<long>")


def _batch(parts: list, names: list[str]) -> pa.RecordBatch:
    *columns, fp = (np.concatenate(x) for x in zip(*parts))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * 4), pa.array(np.ascontiguousarray(fp).reshape(-1).view(np.int64)))
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], names=names)


def _settled(groups: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b: links that join, within each group (gid; as _near leaves it), what pairs of similarity 0.8 join beyond the labels."""
    rows = groups.join(reps, "node").select("gid", "node", "label", "fp", "text").repartition("gid").sortWithinPartitions("gid")
    radius = RADIUS

    def joined(members: dict):
        if len(members) < 2:
            return []
        nodes = sorted(members)
        labels, fps, sets = zip(*(members[n] for n in nodes))
        near = np.zeros((len(nodes), len(nodes)), bool)
        a, b = near_pairs(np.array(fps, np.int64).view(np.uint64), np.array(labels, np.int64), radius)
        near[a, b] = near[b, a] = True
        root = similar_sets(list(sets), list(labels), near)
        return [(nodes[r], n) for r, n in zip(root, nodes) if nodes[r] != n and members[n][0] != members[nodes[r]][0]]

    def run(batches):
        gid, members = None, {}
        for b in batches:
            out = []
            for at, node, label, fp, text in zip(*(c.to_pylist() for c in b.columns)):
                if at != gid:
                    out += joined(members)
                    gid, members = at, {}
                s = shingle_set(text)
                if _identity(s) == node:
                    members[node] = label, fp, s
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in joined(members)], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (at, node) of the buckets that hold several labels, with label (a node without one is its own) and size of the bucket."""
    own = members.join(labels, "node", "left").select("at", "node", F.coalesce("label", "node").alias("label"))
    mixed = own.groupBy("at").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high")
    return own.join(mixed.select("at", "size"), "at")


def _rare_first(rows: DataFrame) -> DataFrame:
    """node, label, gid for rows (node, label, text): groups in which every pair of similarity 0.8 with two labels meets.

    Two such sets have one of their rarest fifths' shingles in common, and the first they have stands so early in both that enough
    follow (prefix and positional filter). Nodes that so meet make a cluster; a cluster that is too large for one task is cut into
    blocks, and every two blocks are a group.
    """

    def run(batches):
        for b in batches:
            for node, label, text in zip(*(c.to_pylist() for c in b.columns)):
                s = shingle_set(text)
                if _identity(s) == node:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), x, np.int64)) for x in (node, label, len(s))] + [pa.array(s.view(np.int64))], names=["node", "label", "n", "token"])

    tokens = materialize(rows.select("node", "label", "text").mapInArrow(run, "node long, label long, n long, token long"))
    often = materialize(tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"))
    ranked = tokens.join(often, "token", "left").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("often", F.lit(1)), "token")) - 1)
    prefix = materialize(ranked.where("often > 1 and 5 * place <= n").select("node", "label", "n", "token", "place"))
    seen = prefix.groupBy("token").agg(F.min("n").alias("least"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    early = F.col("place") <= F.col("n") - F.lit(4 / 9) * (F.col("n") + F.greatest(F.lit(0.8) * F.col("n"), F.col("least"))) + 1e-6
    near = materialize(prefix.join(materialize(seen.select("token", "least")), "token").where(early).select("token", "node", "label", "n"))
    stars = materialize(near.groupBy("token").agg(F.min("node").alias("a"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token", "a"))
    clusters = components(near.join(stars, "token").select("a", F.col("node").alias("b")).where("a <> b").distinct())
    own = clusters.withColumnRenamed("label", "cluster").join(near.select("node", F.col("label"), "n").distinct(), "node")
    bound = F.greatest(F.count("*") / F.lit(LARGE), F.sum("n") / F.lit(MOST))
    cuts = own.groupBy("cluster").agg(F.when(bound <= 1, F.lit(1)).otherwise(F.ceil(2 * bound)).cast("long").alias("k"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    cut = own.join(materialize(cuts.select("cluster", "k")), "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    pair = F.struct(F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"))
    return cut.select("node", "label", F.xxhash64("cluster", pair).alias("gid"))


def _residue(members: DataFrame, stars: DataFrame, labels: DataFrame, reps: DataFrame, fps: DataFrame) -> DataFrame:
    """a, b: the links that stars (pivot, node, ...) leave out, from every bucket that is not of one label."""
    left = materialize(_labelled(members, labels))
    # Equal groups are settled once, and pairs that a star has measured not at all.
    lists = left.where(F.col("size") <= LARGE).groupBy("at").agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("m"))
    lists = lists.select(F.xxhash64("m").alias("gid"), "m").dropDuplicates(["gid"])
    pair = lists.withColumn("pivot", F.when(F.size("m") == 2, F.col("m")[0]["node"])).withColumn("other", F.when(F.size("m") == 2, F.col("m")[1]["node"]))
    lists = pair.join(stars.select("pivot", F.col("node").alias("other")), ["pivot", "other"], "left_anti")
    small = materialize(_near(lists.select("gid", F.explode("m").alias("m")).select("gid", "m.node", "m.label"), fps))
    # Groups with a node that stands in many, and the large ones, are dealt out anew by rare shingles.
    busy = small.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > BUSY).select("node")
    crowded = materialize(small.join(busy, "node", "left_semi").select("gid").distinct())
    rest = materialize(small.join(crowded, "gid", "left_semi").select("node", "label").union(left.where(F.col("size") > LARGE).select("node", "label")).distinct())
    groups = small.join(crowded, "gid", "left_anti").select("gid", "node", "label", "fp")
    if rest.limit(1).count():
        groups = groups.union(_near(_rare_first(rest.join(reps, "node")), fps))
    return stars.where("close").select(F.col("pivot").alias("a"), F.col("node").alias("b")).union(_settled(groups, reps)).distinct()


def _distances(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """pairs (node, pivot, ...) with d, the Hamming distance of their fingerprints."""
    own = fps.select("node", F.col("fp").alias("x"))
    both = pairs.join(own, "node").join(fps.select(F.col("node").alias("pivot"), F.col("fp").alias("y")), "pivot")
    apart = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(4)), F.lit(0))
    return both.withColumn("d", apart).drop("x", "y")


def _row_keys(of_id, text):
    """Two longs that, beside whether the id is null, rows share only if they share id and text."""
    return F.coalesce(of_id.cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one for each group of near copies: that with the smallest id.

    Near copies: a Jaccard similarity of 0.8 or more between the sets of 5-word shingles, and what such pairs join. Texts without
    words, null ones among them, are copies of each other; a text of fewer than 5 words is one shingle. Rows without an id take
    part and stay only where no row of their group has one; of rows with equal ids in a group one stays, by a hash of their
    texts; of equal rows one. All columns of docs come back, whatever their names. An empty table gives an empty one.
    """
    with scratch(docs.sparkSession) as keep:

        def sketch(keys, values):
            sets = [shingle_set(t) for t in values]
            return keys, [_identity(s) for s in sets], [fingerprint(s) for s in sets], [band_keys(s) if len(s) else [] for s in sets]

        keyed = docs.select(F.struct(docs[id_col].isNull().alias("none"), *_row_keys(docs[id_col], docs[text_col])).alias("key"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.struct("*").alias("row"))
        plain = keyed.select("key", "text")
        sketches = map_batches(plain, sketch, "key struct<none:boolean,id:long,text:long>, node long, fp array<long>, bands array<long>")
        # Equal sets have equal fingerprints and bands: those of the row with the smallest key stand for all.
        classes = sketches.groupBy("node").agg(F.min(F.struct("key", "fp", "bands")).alias("m"))
        classes = materialize(classes.select("node", F.col("m.key").alias("first"), F.col("m.fp").alias("fp"), F.col("m.bands").alias("bands")))
        dealt = classes.select(F.explode("bands").alias("at"), "node")
        shared = dealt.groupBy("at").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
        members = materialize(dealt.join(shared.select("at", "pivot"), "at"))
        nodes = materialize(members.select("node").distinct().join(classes.select("node", "first", "fp"), "node"))
        fps = nodes.select("node", "fp")
        # One plan at all sizes, as nodes grow with the texts.
        reps = materialize(nodes.hint("merge").join(plain, nodes["first"] == plain.key).select("node", "text"))
        votes = members.where("pivot <> node").groupBy("node", "pivot").agg(F.count("*").alias("n"))
        table = _distances(votes, fps).where(F.col("d") <= RADIUS)
        best = table.groupBy("node").agg(F.min(F.struct("d", -F.col("n"), "pivot")).alias("b")).select("b.pivot", "node")
        stars = materialize(_measured(best, reps))
        labels = components(stars.where("close").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        labels = components(materialize(_residue(members.select("at", "node"), stars, labels, reps, fps)))
        of = classes.select("node", "first").join(labels, "node", "left").select("first", F.coalesce("label", "node").alias("label"))
        first = keep(materialize(of.groupBy("label").agg(F.min("first").alias("key")).select(F.col("key").alias("kept"))))  # stays, as the result reads it
    found = keyed.select("key", "row").join(first, keyed.key == first.kept, "left_semi").withColumn("place", F.monotonically_increasing_id())
    return found.withColumn("least", F.min("place").over(Window.partitionBy("key"))).where("place = least").select("row.*")
