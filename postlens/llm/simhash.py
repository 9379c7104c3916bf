"""SimHash near-duplicates over BK-trees (operator 4).

Equal fingerprints are one node.  Two fingerprints that differ in at most
``radius`` bits agree in at least one of ``radius + 1`` blocks of bits, so a
shard is all fingerprints with one value of one block, and every link lies
inside a shard.  A shard's tree is built where its fingerprints meet: sending
every tree to every executor would be a broadcast that grows with the corpus.

In a tree a child hangs at its distance to the parent, and a search follows only
edges within the radius of its own distance.  Linking needs one path between
any two members, not all pairs, so a search skips a branch whose nodes are all
in the searcher's own component already.  A branch remembers that by one
member; crowded shards of near copies stay close to linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, map_rows, materialize

BITS = 64
SHINGLE = 3
RADIUS = 3
SEED = 42


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The hashes of all word shingles in order; fewer words than ``size`` are one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    shingles = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 without hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The majority bits of the hashes of all word shingles; 0 without words."""
    return majority(shingle_hashes(text, size))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), a row per row of ``df``."""

    def work():
        def signed(t):
            x = fingerprint(t, size)
            return (x - (1 << 64) if x >> 63 else x,)

        return lambda texts: [signed(t) for t in texts]

    return map_rows(df, [doc_id], text, [("fp", pa.int64())], work)


class Tree:
    """A BK-tree of integers that links what lies within ``radius`` as it grows."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.owner: list[int] = []  # union-find over the nodes
        self.uniform: list[int] = []  # a member of the one component below a node, or -1

    def root(self, i: int) -> int:
        owner = self.owner
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    def add(self, value: int) -> None:
        values, children, owner, uniform, radius = self.values, self.children, self.owner, self.uniform, self.radius
        new = len(values)
        owner.append(new)
        if new:
            stack = [0]
            while stack:
                at = stack.pop()
                one = uniform[at]
                if one >= 0 and self.root(one) == self.root(new):
                    continue
                distance = (values[at] ^ value).bit_count()
                if distance <= radius:
                    a, b = self.root(at), self.root(new)
                    if a != b:
                        owner[max(a, b)] = min(a, b)
                for edge, child in children[at].items():
                    if distance - radius <= edge <= distance + radius:
                        stack.append(child)
            at = 0
            mine = self.root(new)
            while True:
                if uniform[at] >= 0 and self.root(uniform[at]) != mine:
                    uniform[at] = -1
                distance = (values[at] ^ value).bit_count()
                child = children[at].get(distance)
                if child is None:
                    children[at][distance] = new
                    break
                at = child
        values.append(value)
        children.append({})
        uniform.append(new)

    def links(self) -> Iterator[tuple[int, int]]:
        """One link from each member to the first of its component."""
        for i in range(len(self.values)):
            r = self.root(i)
            if r != i:
                yield self.values[i], self.values[r]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``radius`` bits; ``distinct`` has one column fp."""
    blocks = radius + 1
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keyed = distinct.select(
        "fp",
        F.posexplode(
            F.array(
                *[
                    F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1))
                    for lo, hi in zip(edges, edges[1:])
                ]
            )
        ).alias("block", "value"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(tree):
            pairs = list(tree.links())
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_signed(p[k]) for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"]
                )

        key, tree = None, None
        for batch in batches:
            for block, value, fp in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (block, value) != key:
                    if tree is not None:
                        yield from out(tree)
                    key, tree = (block, value), Tree(radius)
                tree.add(fp & 0xFFFFFFFFFFFFFFFF)
        if tree is not None:
            yield from out(tree)

    shards = keyed.select("block", "value", "fp").repartition("block", "value")
    found = shards.sortWithinPartitions("block", "value", F.xxhash64("fp")).mapInArrow(run, "a long, b long")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) reaches.

    Every round replaces the links by links to the smallest neighbour, seen from
    both ends, and writes them to the shared folder; a link count that does not
    move any more ends it.  Each grouping sums partially before its shuffle.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    while True:
        # the smallest neighbour of every node, itself included
        both = now.select(F.col("a").alias("n"), F.col("b").alias("m")).unionAll(now.select("b", "a"))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
        # every link (n, m) becomes (m, least of n); the node itself is linked too
        hooked = (
            both.join(least, "n")
            .select(F.col("m").alias("a"), F.col("least").alias("b"))
            .unionAll(least.select("n", "least"))
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        now = materialize(hooked, "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        last = state


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and copies (rows of the component), a row per row.

    ``component_id`` is the smallest doc_id that is reached over links of at most
    ``radius`` bits, itself included; null only where no row of the component has
    an id.  Null and empty texts have the fingerprint 0 and are linked like any
    other; rows with the same id keep a row each.
    """
    rows = materialize(fingerprints(df, doc_id, text, size).toDF("doc_id", "fp"), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    member = components(links(nodes.select("fp"), radius))
    placed = materialize(
        nodes.join(member, nodes.fp == member.node, "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), "least", "n"
        ),
        "members",
    )
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("copies"))
    classes = placed.join(heads, "root").select("fp", "component_id", "copies")
    return rows.join(classes, "fp").select(
        F.col("doc_id").alias(doc_id),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        "copies",
    )


def keep_one(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """``df`` with one row of each component: that with the smallest id, the first of them if it is repeated.

    Rows without an id come last in their component.  Null and empty texts have
    the fingerprint 0 and are a component like any other.  The columns come back
    as they are, whatever their names.
    """
    df = bounded_batches(df)
    rows = materialize(df.select(F.monotonically_increasing_id().alias("r"), F.struct(*df.columns).alias("doc")), "keep-rows")
    narrow = rows.select("r", F.col(f"doc.`{doc_id}`").alias("id"), F.col(f"doc.`{text}`").alias("t"))
    found = near_duplicates(narrow, "r", "t", size, radius).where("copies > 1").select("r", "component_id")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "r").alias("o")
    placed = materialize(found.join(narrow.select("r", order), "r"), "keep-components")
    heads = placed.groupBy("component_id").agg(F.min("o").alias("head"))
    gone = placed.join(heads, "component_id").where("o <> head").select("r")
    return rows.join(gone, "r", "left_anti").select("doc.*")
