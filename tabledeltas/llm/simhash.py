"""SimHash near-duplicates by a self-join of a binary trie.

Distinct fingerprints are the leaves of a binary trie. Its nodes are traversed in pairs from
the root: taking different branches adds one differing bit, and a pair is dropped once it has
more than the radius allows. The top of the trie is traversed on the driver, over nodes that
hold at most a ``1/NODES`` part of the fingerprints each (or ``LEAF`` of them); a heavy node is
split further, however deep. Each surviving pair of nodes becomes one task-sized group in which
the traversal goes on over sorted arrays. A group returns a spanning forest of the links it
found, which connects the same fingerprints with at most one row per fingerprint; components of
all forests are then found with joins.

* Words are runs of anything but ASCII white space, A-Z lower-cased; shingles of ``words``
  words are taken with their repeats, fewer words make one shingle, none the fingerprint 0.
* A null text counts as an empty one; all without words share the fingerprint 0 and are one
  group, like any other equal fingerprints.
* The id of a group is the smallest id in it; null ids never are, unless all are null. Repeated
  rows stay rows of their group. Exactly one row is its keeper: smallest id, then first row.
* An empty table gives no rows. Texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledeltas.llm.common import saved, working_folder
from tabledeltas.llm.components import components

WORDS, RADIUS, SEED = 3, 2, 42
#: Fingerprints of a trie node that one group holds, at least; and the nodes at most, about.
LEAF, NODES = 8192, 4096
TOP = 16
#: Node pairs stepped at once, and the leaf pairs below which a node pair is compared directly.
STEP, DIRECT = 1 << 16, 64


def _fingerprint(text: str | None, words: int) -> int:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())),
        np.uint64,
        len(starts),
    )
    set_bits = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), STEP):
        part = hashes[lo : lo + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str | Column, words: int = WORDS) -> Column:
    """The 64-bit SimHash of a text, as a signed long."""

    @F.pandas_udf("long")
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([_fingerprint(t, words) for t in batch], dtype="int64")

    return hashed(text)


def trie_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in the sorted distinct arrays (``b`` None: within ``a``) whose values
    differ in at most ``radius`` bits, in batches: the pairwise traversal of two tries."""
    alone = b is None
    b = a if alone else b
    if not len(a) or not len(b):
        return
    zero = np.zeros(1, dtype=np.int64)
    stack = [(63, zero, zero + len(a), zero, zero + len(b), zero)]
    while stack:
        bit, a0, a1, b0, b1, d = stack.pop()
        if len(a0) > STEP:
            half = len(a0) // 2
            stack.append((bit, *(x[half:] for x in (a0, a1, b0, b1, d))))
            a0, a1, b0, b1, d = (x[:half] for x in (a0, a1, b0, b1, d))
            stack.append((bit, a0, a1, b0, b1, d))
            continue
        n_b = b1 - b0
        size = (a1 - a0) * n_b
        few = size <= DIRECT
        if few.any():
            of = np.repeat(np.flatnonzero(few), size[few])
            nth = np.arange(len(of)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
            i, j = a0[of] + nth // n_b[of], b0[of] + nth % n_b[of]
            near = np.bitwise_count(a[i] ^ b[j]) <= radius
            if alone:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        more = ~few
        if not more.any():
            continue
        a0, a1, b0, b1, d = (x[more] for x in (a0, a1, b0, b1, d))
        low = np.uint64(bit)
        above = np.uint64(((1 << 64) - 1) ^ ((1 << (bit + 1)) - 1))
        branch = np.uint64(1) << low
        ma = np.searchsorted(a, (a[a0] & above) | branch)
        mb = np.searchsorted(b, (b[b0] & above) | branch)
        once = np.ones(len(a0), dtype=bool)
        twice = (a0 != b0) if alone else once
        children = [
            (a0, ma, b0, mb, d, once),
            (ma, a1, mb, b1, d, once),
            (a0, ma, mb, b1, d + 1, once),
            (ma, a1, b0, mb, d + 1, twice),
        ]
        kept = []
        for c0, c1, e0, e1, diff, wanted in children:
            ok = wanted & (c1 > c0) & (e1 > e0) & (diff <= radius)
            kept.append(tuple(x[ok] for x in (c0, c1, e0, e1, diff)))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*kept))))


class Forest:
    """Labels that join what is linked; each chunk of links is worked off and forgotten."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                return
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def _top(fps: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Depth and prefix of the trie nodes at which the driver stops: the shallowest that hold
    at most ``limit`` fingerprints. Only counts of heavy nodes' children reach the driver."""

    def prefix(depth: int) -> Column:
        return F.shiftrightunsigned("fp", 64 - depth) if depth < 64 else F.col("fp")

    histogram = np.zeros(1 << TOP, dtype=np.int64)
    for place, n in fps.groupBy(prefix(TOP).alias("p")).count().collect():
        histogram[place] = n
    nodes, heavy = [], [(0, 0)]
    while heavy:
        depth, p = heavy.pop()
        n = histogram[p << (TOP - depth) : (p + 1) << (TOP - depth)].sum()
        if n <= limit or depth == TOP:
            if n:
                nodes.append((depth, p, int(n)))
        else:
            heavy += [(depth + 1, 2 * p), (depth + 1, 2 * p + 1)]
    done = [(d, p) for d, p, n in nodes if n <= limit]
    deep, depth = [p for _, p, n in nodes if n > limit], TOP
    while deep:
        within = fps.where(prefix(depth).isin(deep))
        depth += 4
        counts = within.groupBy(prefix(depth).alias("p")).count().collect()
        done += [(depth, p & ((1 << depth) - 1)) for p, n in counts if n <= limit or depth == 64]
        deep = [p for p, n in counts if n > limit and depth < 64]
    return done


def _node_pairs(nodes: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Places of the nodes whose prefixes differ in at most ``radius`` bits, each pair once."""
    place = {node: i for i, node in enumerate(nodes)}
    inner = {(d, p >> (depth - d)) for depth, p in nodes for d in range(depth)}

    def children(node: tuple[int, int]) -> list[tuple[int, int]]:
        d, p = node
        return [c for c in ((d + 1, 2 * p), (d + 1, 2 * p + 1)) if c in inner or c in place]

    pairs, stack = [], [((0, 0), (0, 0), 0)]
    while stack:
        x, y, d = stack.pop()
        if x in place and y in place:
            pairs.append((place[x], place[y]))
        elif x == y:
            below = children(x)
            stack += [(c, c, d) for c in below]
            if len(below) == 2 and d < radius:
                stack.append((*below, d + 1))
        elif x in place:
            stack += [(x, c, d) for c in children(y)]
        elif y in place:
            stack += [(c, y, d) for c in children(x)]
        else:
            for c in children(x):
                for e in children(y):
                    apart = d + (c[1] & 1 != e[1] & 1)
                    if apart <= radius:
                        stack.append((c, e, apart))
    return pairs


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that connect the distinct fingerprints ``fp`` exactly as all pairs within
    ``radius`` bits do."""
    limit = max(LEAF, -(-fps.count() // NODES))
    nodes = sorted(_top(fps, limit), key=lambda n: n[1] << (64 - n[0]))
    pairs = _node_pairs(nodes, radius) if nodes else []
    starts = np.array([p << (64 - d) for d, p in nodes], dtype=np.uint64)
    groups: list[list[tuple[int, int]]] = [[] for _ in nodes]
    for g, (x, y) in enumerate(pairs):
        groups[x].append((g, 0))
        if x != y:
            groups[y].append((g, 1))
    first = np.cumsum([0] + [len(x) for x in groups])
    flat = np.array([x for each in groups for x in each], dtype=np.int64).reshape(-1, 2)
    single = np.array([x == y for x, y in pairs], dtype=bool)
    # bounded: the nodes are about NODES at most, each with the few near it
    shared = fps.sparkSession.sparkContext.broadcast((starts, first, flat, single))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, first, flat, _ = shared.value
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            node = np.searchsorted(starts, fp.view(np.uint64), side="right") - 1
            n = first[node + 1] - first[node]
            of = np.repeat(np.arange(len(fp)), n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            to = flat[first[node][of] + nth]
            yield pd.DataFrame({"g": to[:, 0], "side": to[:, 1].astype(np.int8), "fp": fp[of]})

    def traverse(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fp, side = group["fp"].to_numpy(np.int64).view(np.uint64), group["side"].to_numpy()
        a, b = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        forest, both = Forest(len(a) + len(b)), np.concatenate([a, b])
        if shared.value[3][key[0]]:
            for i, j in trie_links(a, None, radius):
                forest.link(i, j)
        else:
            for i, j in trie_links(a, b, radius):
                forest.link(i, j + len(a))
        linked = np.flatnonzero(forest.label != np.arange(len(both)))
        return pd.DataFrame({"a": both[linked].view(np.int64), "b": both[forest.label[linked]].view(np.int64)})

    dealt = fps.select("fp").mapInPandas(deal, "g long, side byte, fp long")
    return dealt.groupBy("g").applyInPandas(traverse, "a long, b long")


def group_rows(rows: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``row, doc_id, fp, component_id, keeper`` for a table of ``row, doc_id, text`` whose
    ``row`` is unique; ``keeper`` is the row of the group's representative."""
    folder = working_folder(rows.sparkSession)
    hashed = saved(
        rows.select("row", "doc_id", fingerprint("text", words).alias("fp")), f"{folder}/hashed"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    fps = saved(hashed.groupBy("fp").agg(first), f"{folder}/fingerprints")
    links = near_links(fps, radius)
    roots = saved(components(links, folder), f"{folder}/roots")
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    rooted = saved(rooted, f"{folder}/rooted")
    groups = saved(rooted.groupBy("root").agg(F.min("first").alias("first")), f"{folder}/groups")
    of_print = saved(
        rooted.select("fp", "root")
        .join(groups, "root")
        .select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keeper")),
        f"{folder}/of-print",
    )
    return hashed.join(of_print, "fp").select("row", "doc_id", "fp", "component_id", "keeper")


def with_row(docs: DataFrame) -> DataFrame:
    """The rows with a unique ``row``; save them before anything depends on it."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each group of near-duplicates, with the columns ``docs`` has."""
    path = f"{working_folder(docs.sparkSession)}/documents"
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id"), F.col("text"))
    rows = saved(with_row(packed.select("doc")), path)
    grouped = group_rows(rows.select("row", "doc.doc_id", "doc.text"), words, radius)
    keepers = grouped.where(F.col("row") == F.col("keeper")).select("row")
    return rows.join(keepers, "row", "left_semi").select("doc.*")
