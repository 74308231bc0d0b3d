"""Near duplicates by b-bit MinHash.

A document is the set of its distinct word shingles. Equal sets form one class at once. Per class a task computes
``bands * rows`` minima; the minima of a band hash to a bucket key, and a few bits of all minima, each mixed first, are
packed into a few longs. Classes that meet in a bucket are candidates; bit counts of the packed signatures, corrected for chance
collisions, estimate the similarity; what lies more than five standard errors under the threshold goes, and the
rest is confirmed exactly on the full sets.

Groups are never expanded into all pairs. First every class is compared with the leaders of its buckets; then, in
buckets that still hold several components, the classes outside the largest one with a few of its members; and what
is still outside then with all others there, decided exactly inside the join, which writes links only.
A pair at exactly the threshold meets in no band with probability ``(1 - t ** rows) ** bands`` (1.2e-5 by default,
less for more similar pairs).

Defined results: null text, empty text or text without words gives the empty set, linked with nothing; texts of
fewer words than a shingle are one shingle; repeated rows are copies; a null doc_id takes part in linking but never
names a component that has other ids; very long texts are shingled whole; an empty table gives an empty result; other columns are left out by
``components`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import Latest, broadcast_if_small, materialize, text_batches


@dataclass(frozen=True)
class Near:
    """shingle: words of a shingle; percent: least similarity; bits: bits kept of each minimum."""

    shingle: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 7
    bits: int = 2

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def longs(self) -> int:
        """Longs of a bit plane of the signature."""
        return -(-self.minima // 64)

    @property
    def least_estimate(self) -> float:
        """Five standard errors of the estimate under the threshold."""
        s, c = self.percent / 100, 0.5**self.bits
        match = c + (1 - c) * s
        return s - 5 * sqrt(match * (1 - match) / self.minima) / (1 - c)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. bytes.lower and bytes.split treat A-Z and the six ASCII spaces only."""
    found = (text or b"").lower().split()
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if len(h) == 0:
        return h
    width = min(width, len(h))
    x = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        x = _mix(x ^ h[i : len(h) - width + 1 + i])
    return np.unique(x)


def _minima(x: np.ndarray, near: Near) -> np.ndarray:
    rng = np.random.default_rng(20)
    a = rng.integers(0, 2**63, near.minima, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, near.minima, np.uint64)[:, None]
    return reduce(np.minimum, ((x[i : i + 2048] * a + b).min(axis=1) for i in range(0, len(x), 2048)))


def sketch(x: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of the bands, and the packed bits plane by plane."""
    low = _minima(x, near)
    key = np.arange(near.bands, dtype=np.uint64)
    for column in low.reshape(near.bands, near.rows).T:
        key = _mix(key ^ column)
    # the low bits of x * a + b depend on those of x alone, so equal ones would be the same for all minima
    high = _mix(_mix(low ^ (low >> np.uint64(32)))) >> np.uint64(64 - near.bits)
    planes = np.zeros((near.bits, near.longs * 64), np.uint8)
    for p in range(near.bits):
        planes[p, : near.minima] = (high >> np.uint64(p)) & np.uint64(1)
    return key.view(np.int64), np.packbits(planes, axis=1).reshape(-1).view(np.int64)


def _texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes | None]:
    return (t.as_py() for t in batch.column(column).cast(pa.large_binary()))


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, keys, signature) of each row; node is the hash of its set, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, node, keys, signature = [], [], [], []
                for text in _texts(batch):
                    x = shingles(text, near.shingle, hashes)
                    n.append(len(x))
                    node.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                    k, s = sketch(x, near) if len(x) else (None, None)
                    keys.append(k)
                    signature.append(s)
                columns = [pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signature, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], names=["doc_id", "text_hash", "n_shingles", "node", "keys", "signature"])

    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, node binary, keys array<long>, signature array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, near: Near) -> DataFrame:
    """(node, members) of the wanted (doc_id, text_hash) rows; texts are filtered before their shingles are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                sets = [shingles(t, near.shingle, hashes) for t in _texts(whole.slice(at, 500))]
                nodes = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([nodes, pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "members"])

    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    same = source.doc_id.eqNullSafe(wanted.doc_id) & (source.text_hash == wanted.text_hash)
    found = source.join(broadcast_if_small(wanted), same, "left_semi").select("text").mapInArrow(run, "node binary, members array<long>")
    return found.groupBy("node").agg(F.first("members").alias("members"))


def similarity(a: Column, b: Column, near: Near) -> Column:
    """The collision-corrected estimate from the bits in which two signatures differ."""
    differ = F.lit(0)
    for j in range(near.longs):
        planes = [a.getItem(p * near.longs + j).bitwiseXOR(b.getItem(p * near.longs + j)) for p in range(near.bits)]
        differ = differ + F.bit_count(reduce(Column.bitwiseOR, planes))
    chance = 0.5**near.bits
    return (1 - differ / near.minima - chance) / (1 - chance)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b), by alternating large-star and small-star steps."""
    rounds = Latest("edges")
    edges = rounds.put(edges.select("a", "b").where("a != b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        # a round has at most twice the edges of the one before, whose number tells how many files are needed
        edges = rounds.put(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct(), before and before[0])
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, near: Near) -> DataFrame:
    one = classes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    two = classes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    scored = pairs.join(one, "a").join(two, "b").select("a", "b", similarity(F.col("sa"), F.col("sb"), near).alias("estimate"))
    return scored.where(F.col("estimate") >= near.least_estimate)


def _confirmed(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("members").alias("ma"))
    two = sets.select(F.col("node").alias("b"), F.col("members").alias("mb"))
    counted = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("ma", "mb")).alias("i"), (F.size("ma") + F.size("mb")).alias("n"))
    return counted.where(100 * F.col("i") >= near.percent * (F.col("n") - F.col("i"))).select("a", "b")


#: Representatives of a bucket's largest component that each class outside it is compared with, and how many of the best are confirmed.
DEPUTIES = 4
TRIES = 3


def _mixed(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root, main, deputies) of the buckets that hold several components: main is the largest one there."""
    seen = large.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    chosen = F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(DEPUTIES))))
    shares = seen.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), chosen.alias("deputies"))
    main = shares.groupBy("key").agg(F.max_by(F.struct("root", "deputies"), F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    main = materialize(main.select("key", F.col("main.root").alias("main"), F.col("main.deputies").alias("deputies")), "near-main")
    return materialize(seen.join(broadcast_if_small(main), "key"), "near-mixed")


def _likely(mixed: DataFrame, classes: DataFrame, near: Near) -> DataFrame:
    """For each class outside the main component of a bucket the most similar deputies of those components."""
    pairs = mixed.where("root != main").select(F.col("node").alias("a"), F.explode("deputies").alias("b")).distinct()
    met = _estimated(pairs, classes, near).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("estimate", "b")), asc=False).alias("bs"))  # at most bands * DEPUTIES
    return met.select("a", F.explode(F.slice("bs", 1, TRIES)).alias("s")).select("a", "s.b")


def _differences(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """(main, node, size, n_ref, plus, miss): the full sets around a component, written against a set of that component.

    Of a set x and the reference r, plus is x - r and miss is r - x, so that of two sets |x & y| is
    |r| - |miss x| - |miss y| + |miss x & miss y| + |plus x & plus y|, exactly. The reference is the smallest deputy.
    """
    chosen = mixed.select("main", "deputies").distinct().select("main", F.explode("deputies").alias("node")).distinct().join(sets, "node")
    ref = chosen.groupBy("main").agg(F.min_by("members", F.struct(F.size("members"), "node")).alias("ref"))
    ref = materialize(ref, "near-references")
    each = mixed.select("main", "node").distinct().join(sets, "node").join(broadcast_if_small(ref), "main")
    return each.select("main", "node", F.size("members").alias("size"), F.size("ref").alias("n_ref"), F.array_except("members", "ref").alias("plus"), F.array_except("ref", "members").alias("miss"))


def _left_over(mixed: DataFrame, sets: DataFrame, classes: DataFrame, near: Near) -> DataFrame:
    """The links between classes of different components that share a bucket: what lies outside the main one, against all there.

    Every pair is decided inside the join, at last exactly on the full sets, so what it writes are links and nothing else.
    """
    rows = mixed.drop("deputies").join(_differences(mixed, sets), ["main", "node"]).join(classes.select("node", "signature"), "node")
    rows = materialize(rows, "near-mixed")
    few = rows.where("root != main").select(*(F.col(c).alias(f"x_{c}") for c in rows.columns))
    both, n = F.col("x_size") + F.col("size"), F.col("n_ref")
    lost = lambda c: F.size(F.col(c))
    enough = lambda shared: 100 * shared >= near.percent * (both - shared)
    at_most = n - F.greatest(lost("x_miss"), lost("miss")) + F.least(lost("x_plus"), lost("plus"))
    shared = n - lost("x_miss") - lost("miss") + F.size(F.array_intersect("x_miss", "miss")) + F.size(F.array_intersect("x_plus", "plus"))
    alike = similarity(F.col("x_signature"), F.col("signature"), near) >= near.least_estimate
    linked = (F.col("x_key") == F.col("key")) & (F.col("x_root") != F.col("root")) & enough(F.least("x_size", "size")) & enough(at_most) & alike & enough(shared)
    return few.join(rows, linked).select(F.col("x_node").alias("a"), F.col("node").alias("b"))


def link(rows: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """(node, root) of the classes that are linked with another one; rows are the materialized sketches of docs."""
    classes = rows.where("node is not null").groupBy("node").agg(F.first("keys").alias("keys"), F.first("signature").alias("signature"), F.min_by(F.struct("doc_id", "text_hash"), F.struct("doc_id", "text_hash")).alias("at"))
    classes = materialize(classes, "near-classes")
    member = classes.select("node", F.explode("keys").alias("key"))
    buckets = materialize(member.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1"), "near-buckets")
    large = materialize(member.join(broadcast_if_small(buckets.where("n > 2").select("key")), "key"), "near-members")

    leader = large.groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key")).alias("leader"))
    star = large.join(leader, "key").where("node != leader").select("node", "leader").distinct()
    star = materialize(_estimated(star.select(F.col("node").alias("a"), F.col("leader").alias("b")), classes, near), "near-star")
    chosen = star.groupBy("a").agg(F.array_distinct(F.array(F.max_by("b", "estimate"), F.max_by("b", F.xxhash64("a", "b")))).alias("bs")).select("a", F.explode("bs").alias("b"))
    twos = _estimated(buckets.where("n = 2").select("a", "b").distinct(), classes, near)
    first = materialize(chosen.unionByName(twos.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")

    in_play = large.select("node").unionByName(first.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = materialize(classes.join(in_play, "node", "left_semi").select("at.*"), "near-wanted")
    with text_batches(docs.sparkSession):
        sets = materialize(full_sets(docs, wanted, near), "near-sets")
    roots = materialize(connected(_confirmed(first, sets, near)), "near-roots")

    def merged(links: DataFrame, roots: DataFrame) -> DataFrame:
        more = materialize(links, "near-more")
        if more.isEmpty():
            return roots
        return materialize(connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "near-roots")

    likely = materialize(_likely(_mixed(large, roots), classes, near), "near-pairs")
    roots = merged(_confirmed(likely, sets, near), roots)
    return merged(_left_over(_mixed(large, roots), sets, classes, near), roots)


def components(docs: DataFrame, near: Near | None = None) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id): component is a hash, component_id its smallest doc_id."""
    near = near or Near()
    with text_batches(docs.sparkSession):
        rows = materialize(sketches(docs, near), "near-rows")
    roots = link(rows, docs, near)
    labelled = rows.select("doc_id", "text_hash", "n_shingles", "node").join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
    labelled = materialize(labelled.select("doc_id", "text_hash", "n_shingles", "component"), "near-labelled")
    least = labelled.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least_id"))
    named = labelled.join(least, "component", "left")
    return named.select("doc_id", "text_hash", "n_shingles", "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, near: Near | None = None) -> DataFrame:
    """The rows without their near copies: of each group the row with the smallest doc_id stays, with all its columns."""
    named = materialize(components(docs, near), "near-named")
    kept = named.where("component is null").select("doc_id", "text_hash").unionByName(
        named.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("at")).select("at.doc_id", "at.text_hash")
    )
    # a kept row may itself be repeated; only such rows are shuffled to be made one
    copies = named.groupBy("doc_id", "text_hash").count()
    kept = kept.distinct().alias("k").join(copies.alias("c"), F.expr("k.doc_id <=> c.doc_id and k.text_hash = c.text_hash")).select("k.doc_id", "k.text_hash", "count")
    kept = materialize(kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("count").alias("_n")), "near-kept")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: plain[names[docs.columns.index(c)]] for c in ("doc_id", "text")}
    held = plain.join(broadcast_if_small(kept), at["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(at["text"]) == kept["_hash"]))
    again = held.where("_n > 1").select(*names, F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_n")).alias("_nth")).where("_nth = 1")
    return held.where("_n = 1").select(names).unionByName(again.select(names)).toDF(*docs.columns)
