"""SimHash near-duplicates found with sharded BK-trees.

Fingerprints are 64-bit SimHashes. Fingerprints within the radius agree exactly in some choice of blocks
(pigeonhole), so each distinct fingerprint goes to one shard for every such choice and all links inside the radius are
met in a shard. A shard is a BK-tree: children hang below their parent under their integer Hamming distance to it, and
a search at distance d follows only the edges d-radius..d+radius. Large shards are cut into pieces of bounded size;
each piece's tree is built once and the built trees meet the other pieces as queries (broadcast when their checked size
allows, shuffled otherwise). A shard task returns a spanning forest of its links, never all pairs, and connected components of the
forest are found with star contractions on DataFrames.

``keep_one``, the pipeline's stage, joins texts of a similarity of 0.8, whose SimHashes differ in about 10 bits. No choice of
agreeing blocks covers that radius, so a fingerprint's shards are the MinHash bands of its text; in each, BK-trees over the
SimHashes find the fingerprints within NEAR_RADIUS, and a link is confirmed on the exact shingle sets.

Defined cases: null text counts as empty; an empty text has fingerprint 0 and is linked like any other; null ids are
kept and take their component's id; repeated rows are kept; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, drop_held, lookup, numbered, pick, release, slices, tasks_for

RADIUS = 3
SHARD_ROWS = 256  # fingerprints a shard is meant to have
PIECE_ROWS = 2048  # most that one tree is meant to have
BROADCAST_BYTES = 32 << 20
SHINGLE, SIMILAR = 5, (4, 5)  # near copies share 4 of 5 shingles of SHINGLE words
BANDS, BAND_ROWS = 24, 5  # a pair of similarity 0.8 shares no band with probability 7e-5, whatever its length or edit
NEAR_RADIUS = 24  # of 64 bits: fingerprints of a pair of similarity 0.8 differ in more with probability 3e-6, of 4 and 5 shingles 1e-4
TREE_ROWS = 128  # of a bucket that one tree holds at first
LOCAL_LINKS = 1 << 20  # of which one task finds the components
SET_BITS = 40  # of a shingle's hash, as sets are kept
PIECE_UNITS, UNIT_BYTES = 1024, 5120  # of sets of a bucket in one piece, and in a unit; a set has one unit at least
_STEP = 1 << 15  # shingles voted on at once


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def vote(hashes: np.ndarray) -> int:
    """The bits set in over half of the unsigned 64-bit hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _STEP):
        part = np.ascontiguousarray(hashes[at : at + _STEP])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def simhash(text: str | None, size: int = 3, seed: int = 42) -> int:
    h = xxhash.xxh64_intdigest
    return vote(np.fromiter((h(s, seed) for s in shingles(words_of(text), size)), dtype=np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A second, independent 64-bit hash of hashes."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FLIPS, _FACTORS = _mix(np.arange(BANDS * BAND_ROWS, dtype=np.uint64)), _mix(np.arange(1000, 1000 + BANDS * BAND_ROWS, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(s, 42) for s in shingles(words_of(text), size)), dtype=np.uint64))


def pack_set(hashes: np.ndarray) -> bytes:
    """The distinct high SET_BITS bits of sorted hashes. Two different shingles of a pair of sets a and b are taken for one
    with probability |a| |b| / 2**SET_BITS."""
    high = np.unique(hashes >> np.uint64(64 - SET_BITS))
    return high.astype("<u4").tobytes() + (high >> np.uint64(32)).astype(np.uint8).tobytes()


def unpack_set(data) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: two sets share one with probability 1 - (1 - J**BAND_ROWS)**BANDS, J being their Jaccard."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    low = np.full(len(_FLIPS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(low, ((hashes[at : at + 1024] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, BAND_ROWS).T:
        key = _mix(key ^ row)
    return key


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard of two sorted sets is at least SIMILAR."""
    least, most = sorted((len(a), len(b)))
    if least * SIMILAR[1] < most * SIMILAR[0]:
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = np.count_nonzero(both[1:] == both[:-1])
    return shared * SIMILAR[1] >= (len(both) - shared) * SIMILAR[0]


def fingerprints(docs: DataFrame, make=simhash, n: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key0..): signed longs with the bits that make(text) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for b in slices(batches, 1):
            rows = [make(t) for t in b.column(1).to_pylist()]
            rows = [r if isinstance(r, tuple) else (r,) for r in rows]
            keys = [pa.array(np.array([r[k] for r in rows], dtype=np.uint64).view(np.int64)) for k in range(n)]
            yield pa.RecordBatch.from_arrays([b.column(0), *keys], names=["doc_id", *[f"key{k}" for k in range(n)]])

    cols = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, "doc_id long, " + ", ".join(f"key{k} long" for k in range(n)))


class BKTree:
    """Built level by level, with the shape that inserting the points in their order gives.

    With ``roots``, the place of each point's root, the trees of many shards are built at once in one array.
    """

    def __init__(self, points: np.ndarray, roots: np.ndarray | None = None):
        self.points = np.asarray(points, dtype=np.uint64)
        n = len(self.points)
        self.child = np.full((n, 65), -1, dtype=np.int32)
        roots = np.zeros(n, dtype=np.int64) if roots is None else roots
        rest = np.flatnonzero(roots != np.arange(n))
        at = roots[rest]
        while len(rest):
            d = np.bitwise_count(self.points[rest] ^ self.points[at]).astype(np.int64)
            slot = at * 65 + d
            _, first = np.unique(slot, return_index=True)
            self.child.reshape(-1)[slot[first]] = rest[first]
            stay = np.ones(len(rest), dtype=bool)
            stay[first] = False
            at, rest = self.child.reshape(-1)[slot[stay]].astype(np.int64), rest[stay]

    def edges(self) -> tuple[bytes, bytes]:
        """The tree without its points: where children hang (parent * 65 + distance), and the children."""
        flat = self.child.reshape(-1)
        slots = np.flatnonzero(flat >= 0).astype(np.int32)
        return slots.tobytes(), flat[slots].tobytes()

    @classmethod
    def built(cls, points: np.ndarray, slots: bytes, children: bytes) -> BKTree:
        """The tree of these edges; no distance is worked out anew."""
        out = cls.__new__(cls)
        out.points = np.asarray(points, dtype=np.uint64)
        out.child = np.full((len(out.points), 65), -1, dtype=np.int32)
        out.child.reshape(-1)[np.frombuffer(slots, np.int32)] = np.frombuffer(children, np.int32)
        return out

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, point index) of all pairs within the radius."""
        if not len(self.points) or not len(queries):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        hits = []
        flat = self.child.reshape(-1)
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
            near = d <= radius
            hits.append((q[near], node[near]))
            next_q, next_node = [], []
            for step in range(-radius, radius + 1):
                edge = d + step
                ok = (edge >= 0) & (edge <= 64)
                kids = flat[node[ok] * 65 + edge[ok]]
                has = kids >= 0
                next_q.append(q[ok][has])
                next_node.append(kids[has].astype(np.int64))
            q, node = np.concatenate(next_q), np.concatenate(next_node)
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


    def near(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, point index, distance) of all pairs within a radius that spans many edges, each below the query's root."""
        q, node = np.arange(len(queries)), roots
        flat = self.child.reshape(-1)
        slots = np.flatnonzero(flat >= 0)
        kids, hits = flat[slots].astype(np.int64), []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
            close = d <= radius
            hits.append((q[close], node[close], d[close]))
            low = np.searchsorted(slots, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(slots, node * 65 + np.minimum(d + radius, 64), side="right") - low
            q, node = np.repeat(q, n), kids[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return tuple(np.concatenate([h[k] for h in hits]) if hits else np.empty(0, np.int64) for k in range(3))


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after joining a[i] with b[i]: each points at its group's smallest index."""
    while len(a):
        la, lb = labels[a], labels[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        keep = low < high
        if not keep.any():
            break
        a, b = a[keep], b[keep]
        np.minimum.at(labels, high[keep], low[keep])
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def _links(tree: BKTree, t_node, t_check, q_points, q_node, q_check, radius: int, check_radius: int | None):
    """A spanning forest, as (node, node), of the links between a tree's points and the queries."""
    nodes, inverse = np.unique(np.concatenate([t_node, q_node]), return_inverse=True)
    ti, qi = inverse[: len(t_node)], inverse[len(t_node) :]
    labels = np.arange(len(nodes))
    for at in range(0, len(q_points), 128):
        q, p = tree.within(q_points[at : at + 128], radius)
        q = q + at
        if check_radius is not None:
            ok = np.bitwise_count(q_check[q] ^ t_check[p]) <= check_radius
            q, p = q[ok], p[ok]
        labels = _forest(labels, qi[q], ti[p])
    far = labels != np.arange(len(nodes))
    return nodes[far], nodes[labels[far]]


def _blocks(n: int) -> int:
    """Blocks to cut 64 bits into so that keys of the agreeing ones split n fingerprints finely enough."""
    for b in (4, 5, 6):
        if n <= SHARD_ROWS << (64 * (b - RADIUS) // b):
            return b
    return 7


def _shard_keys(key: Column, n: int, radius: int) -> Column:
    """array<long>: the shards of a fingerprint. Two within the radius share one at least."""
    b = _blocks(n) - RADIUS + radius
    edges = [64 * i // b for i in range(b + 1)]
    parts = [F.shiftrightunsigned(key, lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in itertools.pairwise(edges)]
    each = max(1, math.ceil(n / SHARD_ROWS))
    return F.array(*[F.pmod(F.xxhash64(*[parts[i] for i in keep]), F.lit(each)) + F.lit(t * each) for t, keep in enumerate(itertools.combinations(range(b), b - radius))])


def find_links(nodes: DataFrame, keys: list[str], check: str | None = None, radius: int = RADIUS, check_radius: int | None = None) -> DataFrame:
    """(a, b) with b < a: a forest over ``node`` that joins all nodes with a link.

    nodes: node long (unique), the key columns, and check. Two nodes link if some key differs in at most ``radius``
    bits and, where check_radius is given, check differs in at most check_radius bits.
    """
    spark, out = nodes.sparkSession, None
    n = nodes.count()
    for key in keys:
        judge = F.col(check or key)
        rows = nodes.select("node", F.col(key).alias("fp"), judge.alias("ck"), F.explode(_shard_keys(F.col(key), n, radius)).alias("shard"))
        rows_all = n * math.comb(_blocks(n), 3)
        large = rows.groupBy("shard").agg(F.count("*").alias("rows")).where(F.col("rows") > PIECE_ROWS)
        rows = lookup(rows, large, "shard", ["rows"], "rows", rows_all)
        rows = rows.withColumn("piece", F.when(F.col("rows").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / PIECE_ROWS))).cast("int"))
        many = tasks_for(spark, n * 4, 100_000)
        pieces = cut(rows.repartition(many, "shard", "piece").groupBy("shard", "piece").agg(F.sort_array(F.collect_list(F.struct("fp", "node", "ck"))).alias("items"), F.max("rows").alias("rows")).where((F.size("items") > 1) | F.col("rows").isNotNull()), "bk-pieces")
        none = F.lit(None).cast("binary")
        found = pieces.select("items", F.col("items").alias("queries"), none.alias("slots"), none.alias("children")).mapInArrow(_probe(radius, check_radius), "a long, b long")
        big = pieces.where(F.col("rows").isNotNull())
        volume = big.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("n")).first()["n"] * 24
        if volume:
            items = "items array<struct<fp:long,node:long,ck:long>>"
            trees = big.select("shard", F.col("piece").alias("tree"), "items").mapInArrow(_plant, f"shard long, tree int, {items}, slots binary, children binary")
            trees = F.broadcast(trees) if volume <= BROADCAST_BYTES else trees
            met = big.select("shard", "piece", F.col("items").alias("queries")).join(trees, "shard").where(F.col("tree") < F.col("piece"))
            found = found.unionByName(met.select("items", "queries", "slots", "children").repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(_probe(radius, check_radius), "a long, b long"))
        out = found if out is None else out.unionByName(found)
    return cut(out.distinct(), "bk-links")


def _column(x, name: str) -> np.ndarray:
    return x.field(name).to_numpy(zero_copy_only=False)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of shards with the edges of their trees."""
    for b in batches:
        edges = [BKTree(_column(items.values, "fp").view(np.uint64)).edges() for items in b.column(2)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], names=["shard", "tree", "items", "slots", "children"])


def _probe(radius: int, check_radius: int | None):
    """Links between a tree, built where it comes without edges, and queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for b in batches:
            for items, queries, slots, children in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                t, q = items.values, queries.values
                points = _column(t, "fp").view(np.uint64)
                tree = BKTree.built(points, slots.as_py(), children.as_py()) if slots.is_valid else BKTree(points)
                far, near = _links(tree, _column(t, "node"), _column(t, "ck").view(np.uint64), _column(q, "fp").view(np.uint64), _column(q, "node"), _column(q, "ck").view(np.uint64), radius, check_radius)
                yield pa.RecordBatch.from_arrays([pa.array(far, pa.int64()), pa.array(near, pa.int64())], names=["a", "b"])
        release()

    return run


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all links."""
    drop_held()
    links = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if links:
        a, b = (np.concatenate(x) for x in zip(*links))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        labels = nodes[_forest(np.arange(len(nodes)), at[: len(a)], at[len(a) :])]
        for k in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(labels[k : k + (1 << 16)])], names=["node", "label"])
    release()


def components(links: DataFrame, local: int = 0) -> DataFrame:
    """(node, label): for every node with a link the smallest node that it reaches.

    Alternates large-star and small-star steps until nothing changes; each step is an aggregation with map-side
    combining and a lookup that broadcasts the few hot nodes. Up to ``local`` links are joined in one task instead.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "cc")
    if local and edges.count() <= local:
        return cut(edges.coalesce(1).mapInArrow(_labels, "node long, label long"), "cc")
    state = None
    while True:
        n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not n or (n, mark) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        state = (n, mark)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")).withColumn("m", F.least("m", "a"))
        large = lookup(both, low, "a", ["m"], "c", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = cut(large, "cc")
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        small = lookup(large, down, "a", ["m"], "c", large.count()).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(down.select("a", F.col("m").alias("b"))).where("a > b").distinct(), "cc")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): every row with its SimHash and its group's smallest id."""
    prints = cut(fingerprints(docs, lambda t: simhash(t, size), 1, id_col, text_col), "simhash")
    total = prints.count()
    distinct = cut(prints.groupBy(F.col("key0").alias("node")).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "simhash-distinct")
    labels = components(find_links(distinct.select("node", F.col("node").alias("fp")), ["fp"], radius=radius))
    named = _named(distinct, labels)
    out = lookup(prints.withColumnRenamed("key0", "node"), named, "node", ["component_id"], "rows", total)
    return out.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def _named(distinct: DataFrame, labels: DataFrame) -> DataFrame:
    """distinct (node, first, rows) with component_id: the smallest ``first`` among a node's component."""
    marked = cut(distinct.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "simhash-labels")
    heads = marked.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("nodes"))
    return lookup(marked, heads, "label", ["component_id"], "nodes", marked.count())


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b) the pairs whose sets are similar. sets: (node, set), one row a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for b in batches:
            ok = [similar(unpack_set(x.as_buffer()), unpack_set(y.as_buffer())) for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release()

    pairs = cut(pairs, "near-pairs")
    total = pairs.count()
    for side in ("b", "a"):
        own = sets.withColumnsRenamed({"node": side, "set": f"set_{side}"}).join(pairs.groupBy(side).agg(F.count("*").alias("n")), side)
        lead = pairs if side == "b" else found
        found = lookup(lead, own, side, [f"set_{side}"], "n", total)
    return cut(found.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), "near-links")


def near_links(prints: DataFrame, classes: DataFrame, radius: int = NEAR_RADIUS) -> DataFrame:
    """(a, b): links that join all nodes whose sets are similar, each confirmed on the sets themselves.

    prints: (row, node, fp, bands, set); classes: (node, row), one row a node. Nodes that share a band meet in its BK-trees, and
    those whose SimHashes are within the radius are candidates. First a node is held against the nearest of those before it
    in its tree; then all of a bucket that this has not joined search the whole bucket, piece by piece inside tasks, so that
    no unconfirmed pair hides a true one and no pairs are written.
    """
    heads, spark = classes.select("row"), prints.sparkSession
    flat = prints.select("row", "node", "fp", "bands").join(heads, "row", "left_semi").select("node", "fp", F.explode("bands").alias("band"))
    buckets = flat.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(lookup(flat, buckets, "band", ["n"], "n", classes.count() * BANDS).where("n is not null"), "near-buckets")
    total = members.count()
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("row")
    sets = cut(prints.select("row", "node", "fp", "set").join(wanted, "row", "left_semi").select("node", "fp", "set"), "near-sets")
    piece = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("n") / TREE_ROWS)).cast("int")
    pieces = members.withColumn("piece", piece).repartition(tasks_for(spark, total, 50_000), "band", "piece").groupBy("band", "piece").agg(F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("items"))
    first = _confirmed(pieces.where(F.size("items") > 1).select("items").mapInArrow(_nearest(radius), "a long, b long").distinct(), sets.select("node", "set"))
    crowd = members.where("n > 2").select("node", "band")
    labels = components(first, LOCAL_LINKS).join(crowd.groupBy("node").agg(F.count("*").alias("rows")), "node")
    named = lookup(crowd, labels, "node", ["label"], "rows", total)
    named = cut(named.withColumn("label", F.coalesce("label", "node")), "near-labels")
    weight = sets.select("node", F.greatest(F.lit(1), F.ceil(F.octet_length("set") / UNIT_BYTES)).alias("w"))
    sizes = named.join(weight, "node").groupBy("band", "label").agg(F.count("*").alias("c"), F.sum("w").alias("w"))
    mixed = sizes.groupBy("band").agg(F.count("*").alias("labels"), F.sum("c").alias("n"), F.ceil(F.sum("w") / PIECE_UNITS).cast("int").alias("pieces"), F.max(F.struct("c", "label"))["label"].alias("main")).where("labels > 1")
    left = cut(lookup(named.select("band", "node", "label"), mixed, "band", ["main", "pieces"], "n", total).where("main is not null"), "near-mixed")
    # each piece of a bucket meets each other piece, and itself, in one cell
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    cells = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cells = cells.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "label", "main")
    met = cells.join(sets, "node").groupBy("band", "low", "high").applyInArrow(_met(radius), "a long, b long")
    return first.unionByName(cut(met.distinct(), "near-met"))


def _nearest(radius: int):
    """For each point of a tree the nearest within the radius of those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            rows = np.diff(batch.column(0).offsets.to_numpy())
            ends = np.cumsum(rows)
            at = 0
            while at < len(rows):  # the trees of about as many points as one slice of queries or more
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + _STEP)))
                points = batch.column(0).slice(at, upto - at).flatten()
                node, fp = _column(points, "node"), _column(points, "fp").view(np.uint64)
                size = rows[at:upto]
                roots = np.repeat(np.cumsum(size) - size, size).astype(np.int64)
                tree = BKTree(fp, roots)
                for k in range(0, len(fp), 4096):
                    q, p, d = tree.near(fp[k : k + 4096], roots[k : k + 4096], radius)
                    q = q + k
                    before = p < q
                    q, p, d = q[before], p[before], d[before]
                    order = np.lexsort((p, d, q))
                    q, p = q[order], p[order]
                    lead = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
                    a, b = node[q[lead]], node[p[lead]]
                    yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(a)], names=["a", "b"])
                at = upto
        release()

    return run


def _met(radius: int):
    """A forest of the links between nodes of a cell that have different labels.

    Every node outside the bucket's largest label searches the cell's BK-tree; those found are judged exactly: one pass over
    their shingles counts what it shares with each. No pairs are written, only links.
    """

    def run(cell: pa.Table) -> pa.Table:
        t = cell.combine_chunks()
        node, label, own = (t[c].to_numpy() for c in ("node", "label", "own"))
        fp = t["fp"].to_numpy().view(np.uint64)
        main, cross = t["main"][0].as_py(), t["low"][0].as_py() != t["high"][0].as_py()
        sets = [unpack_set(x.as_buffer()) for x in t["set"]]
        size = np.array([len(x) for x in sets])
        starts = np.cumsum(size) - size
        known, number = np.unique(np.concatenate(sets), return_inverse=True)
        names, group = np.unique(label, return_inverse=True)
        root = np.arange(len(names))
        out: list[tuple[int, int]] = []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        has = np.zeros(len(known), dtype=bool)
        tree, asked = BKTree(fp), np.flatnonzero(label != main)
        for at in range(0, len(asked), 128):
            part = asked[at : at + 128]
            q, p, _ = tree.near(fp[part], np.zeros(len(part), dtype=np.int64), radius)
            apart = label[part[q]] != label[p]
            if cross:
                apart &= own[part[q]] != own[p]
            q, p = q[apart], p[apart]
            order = np.argsort(q, kind="stable")
            found = np.split(p[order], np.cumsum(np.bincount(q, minlength=len(part)))[:-1])
            for k, others in zip(part.tolist(), found):
                if not len(others):
                    continue
                mine, length = number[starts[k] : starts[k] + size[k]], size[others]
                begin = np.cumsum(length) - length
                has[mine] = True
                shared = np.add.reduceat(has[number[np.repeat(starts[others] - begin, length) + np.arange(length.sum())]], begin, dtype=np.int64)
                has[mine] = False
                for j in others[shared * SIMILAR[1] >= (length + size[k] - shared) * SIMILAR[0]].tolist():
                    x, y = top(group[k]), top(group[j])
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((max(node[k], node[j]), min(node[k], node[j])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def keep_one(docs: DataFrame, radius: int = NEAR_RADIUS) -> DataFrame:
    """docs without near-copies: of each group the row with the smallest doc_id stays, with its columns.

    Texts link if the SimHashes of their sets of five-word shingles are within the radius and the Jaccard of the sets is at
    least 0.8; BK-trees in shards by MinHash bands find them. Of rows with the same id and text one stays; rows with the same id and other texts are judged apart. Rows
    without doc_id are told apart by their texts and come last: one stays only where its group has no row with an id.
    """
    flat, (i, text) = numbered(docs, "doc_id", "text")  # c0, c1, ..; names of this function's own can't clash
    name = {"d0": F.col(i).isNull(), "d": F.coalesce(F.col(i).cast("long"), F.lit(0)), "t": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}
    marked = flat.withColumns(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches, 3, 1 << 19):
            sets = [shingle_set(t) for t in b.column(3).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], dtype=np.uint64).view(np.int64)
            prints = np.array([vote(s) for s in sets], dtype=np.uint64).view(np.int64)
            bands = pa.array([bands_of(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            rows = pa.array(np.arange(row, row + b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], rows, pa.array(node), pa.array(prints), bands, pa.array([pack_set(s) for s in sets], pa.binary())], names=["d0", "d", "t", "row", "node", "fp", "bands", "set"])
            row += b.num_rows

    keyed = marked.select("d0", "d", "t", F.col(text).alias("text"))
    prints = cut(keyed.mapInArrow(run, "d0 boolean, d long, t long, row long, node long, fp long, bands array<long>, set binary"), "near")
    classes = cut(prints.groupBy("node").agg(F.min(F.struct("d0", "d", "t")).alias("first"), F.min("row").alias("row"), F.count("*").alias("rows")), "near-distinct")
    links = near_links(prints, classes.select("node", "row"), radius)
    kept = _named(classes.select("node", "first", "rows"), components(links, LOCAL_LINKS)).groupBy("component_id").agg(F.count("*").alias("n")).select("component_id.*")
    one = marked.join(kept, ["d0", "d", "t"], "left_semi").dropDuplicates(["d0", "d", "t"])
    return one.select(*flat.columns).toDF(*docs.columns)
