"""Merkle manifest of a table by bitmap-rank indexing, with DataFrame functions only.

Every row is a leaf, leaves stand in the order of their ids, one tree per group, and the
groups' roots are the leaves of a last tree. The coordinate of a leaf is the rank of its id:

* The ids of a group are a bitmap of 64-bit words, kept only where a bit is set. Words are
  merged by ``bit_or`` in every task before the shuffle.
* A popcount directory says how many ids lie before a word. It is a radix tree over the words'
  numbers with 2**16 children at most below a node, so that every running sum is over a bounded
  window, whatever the number of words; only as many levels are built as the ids' range needs.
* Rank is the directory's entry plus the set bits below the id within its word. No table of
  rows is sorted.

A tier brings the nodes of 256 consecutive coordinates together, in an array by slot, and
reduces them by eight levels at once; then the next tier does so with what is left. A leaf's
path is what its block says of it and the path of the block, joined once per block.

* A bitmap holds an id once. Where a word holds repeated ids, and for rows without an id, which
  come first, the place within the word is taken from a numbering of those rows alone, by id
  and leaf. Rows equal in both are interchangeable: digests do not depend on their order.
* Ids are 64-bit integers, negative ones before others. Groups are texts, a null one is a
  group of its own and comes first. A group with one row has that leaf as its root.
* Texts of any length, empty and null ones are hashed whole, in the task that reads them. An
  empty table has no leaves and gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabledeltas.llm.common import numbered, saved, working_folder

#: Slots of a block are 2**TIER, children of a directory node 2**FAN at most.
TIER, FAN = 8, 16
#: The word of rows without an id: before all others, at every level of the directory.
NO_ID = -1


def encoded(value: Column) -> Column:
    """A value with its length, so that neighbours cannot be confused; ``-`` for null."""
    text = value.cast("string")
    length = F.octet_length(text).cast("string")
    return F.coalesce(F.concat(length, F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Leaf of a row."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""

    def up(below: Column, sibling: Column) -> Column:
        on_left = F.concat(sibling["hash"], below)
        on_right = F.concat(below, F.coalesce(sibling["hash"], F.lit("")))
        return F.sha2(F.when(sibling["left"], on_left).otherwise(on_right), 256)

    return F.aggregate(proof, leaf, up)


def siblings_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["hash"]), ""), 256)


# --- coordinates --------------------------------------------------------------------------


def _low(id_: Column) -> Column:
    return id_.bitwiseAND(F.lit(63)).cast("int")


def _one_bit(low: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), low)


def _bits_below(low: Column) -> Column:
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), low))


def _word(id_: Column) -> Column:
    flipped = id_.bitwiseXOR(F.lit(-(1 << 63)))  # now unsigned order is the order of the ids
    return F.coalesce(F.shiftrightunsigned(flipped, 6), F.lit(NO_ID)).cast("long")


def _join(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Join on columns of equal names, null groups meeting each other."""
    theirs = right.select(
        *[F.col(n).alias(f"_{n}") for n in names], *[c for c in right.columns if c not in names]
    )
    alike = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    on = alike[0]
    for more in alike[1:]:
        on &= more
    return left.join(theirs, on, how).drop(*[f"_{n}" for n in names])


def _directory(words: DataFrame, folder: str) -> DataFrame:
    """``g, word, before``: how many rows of the group lie before each word."""
    ends = words.where(F.col("word") >= 0).agg(F.min("word"), F.max("word")).first()
    span = 0 if ends[0] is None else (ends[0] ^ ends[1]).bit_length()
    levels = max(1, -(-span // FAN))
    counts, tables = words.select("g", "word", "n"), []
    for level in range(levels):
        top = level == levels - 1
        held = counts.withColumn("parent", F.shiftright("word", FAN))
        siblings = Window.partitionBy("g", *([] if top else ["parent"])).orderBy("word")
        running = siblings.rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before")
        tables.append(saved(held.select("g", "word", "parent", before), f"{folder}/level-{level}"))
        if not top:
            above = held.groupBy("g", F.col("parent").alias("word")).agg(F.sum("n").alias("n"))
            counts = saved(above, f"{folder}/counts-{level}")
    found = tables.pop().select("g", "word", "before")
    while tables:
        above = found.select("g", F.col("word").alias("parent"), F.col("before").alias("earlier"))
        found = _join(tables.pop(), above, "g", "parent").select(
            "g", "word", (F.col("before") + F.col("earlier")).alias("before")
        )
    return found


def coordinates(rows: DataFrame, folder: str) -> DataFrame:
    """A saved table of ``g, id, leaf, row`` and more with ``place``, from 0 in every group;
    ``row`` tells repeated rows apart."""
    rows = rows.withColumn("word", _word(F.col("id")))
    words = saved(
        rows.groupBy("g", "word").agg(
            F.coalesce(F.bit_or(_one_bit(_low(F.col("id")))), F.lit(0).cast("long")).alias("bits"),
            F.count(F.lit(1)).alias("n"),
        ),
        f"{folder}/words",
    )
    clean = F.bit_count("bits") == F.col("n")
    index = _join(words, _directory(words, folder), "g", "word")
    index = saved(index.select("g", "word", "bits", "before", clean.alias("clean")), f"{folder}/index")
    found = _join(rows, index, "g", "word")
    rank = F.col("before") + F.bit_count(F.col("bits").bitwiseAND(_bits_below(_low(F.col("id")))))
    dropped = ["word", "bits", "before", "clean"]
    placed = found.where("clean").withColumn("place", rank.cast("long")).drop(*dropped)
    if not index.where("NOT clean").isEmpty():
        order = [F.col("g").asc_nulls_first(), F.col("word"), F.col("id"), F.col("leaf"), F.col("row")]
        again = numbered(found.where("NOT clean"), order, f"{folder}/again", "number")
        first = again.groupBy("g", "word").agg(F.min("number").alias("first"))
        within = F.col("before") + F.col("number") - F.col("first")
        again = _join(again, saved(first, f"{folder}/first"), "g", "word")
        placed = placed.unionByName(again.withColumn("place", within).drop(*dropped, "number", "first"))
    return placed


# --- tiers --------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Tree:
    tiers: list[DataFrame]  # g, block, steps, slots, levels; the leaves' blocks first
    roots: DataFrame  # g, hash


def _levels(hashes: Column, steps: Column) -> Column:
    """All levels of a block, from its nodes to its top, as arrays by slot."""

    def up(level: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1)
        return F.transform(
            pairs,
            lambda i: F.sha2(
                F.concat(F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.lit(""))), 256
            ),
        )

    turns = F.slice(F.array(*[F.lit(k) for k in range(TIER)]), F.lit(1), steps)
    start = F.array(hashes).cast("array<array<string>>")
    return F.aggregate(turns, start, lambda done, _: F.concat(done, F.array(up(F.element_at(done, -1)))))


def _reduce(nodes: DataFrame, folder: str) -> _Tree:
    """The tree of every group over ``g, place, hash, kept`` nodes."""
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    height = F.when(F.col("n") < 2, F.lit(0)).otherwise(F.length(F.bin(F.col("n") - 1)))
    heights = saved(sizes.select("g", height.alias("height")), f"{folder}/heights")
    highest = heights.agg(F.max("height")).first()[0] or 0
    tiers: list[DataFrame] = []
    for tier in range(max(1, -(-highest // TIER))):
        slot = F.col("place").bitwiseAND(F.lit((1 << TIER) - 1)).cast("int").alias("slot")
        kept = [c for c in nodes.columns if c == "kept"]
        slots = F.sort_array(F.collect_list(F.struct(slot, "hash", *kept))).alias("slots")
        blocks = nodes.groupBy("g", F.shiftright("place", TIER).alias("block")).agg(slots)
        left = F.greatest(F.col("height") - TIER * tier, F.lit(0))
        blocks = _join(blocks, heights, "g").withColumn("steps", F.least(left, F.lit(TIER)))
        hashes = F.transform("slots", lambda s: s["hash"])
        blocks = blocks.withColumn("levels", _levels(hashes, F.col("steps"))).drop("height")
        tiers.append(saved(blocks, f"{folder}/tier-{tier}"))
        top = F.get(F.element_at("levels", -1), F.lit(0))
        nodes = tiers[-1].select("g", F.col("block").alias("place"), top.alias("hash"))
    return _Tree(tiers, nodes.select("g", "hash"))


def _within(slot: Column) -> Column:
    """Siblings on the path of a slot to the top of its block."""
    path = [
        F.struct(
            F.get(
                F.get("levels", F.lit(k)), F.shiftright(slot, k).bitwiseXOR(F.lit(1)).cast("int")
            ).alias("hash"),
            (F.shiftright(slot, k).bitwiseAND(F.lit(1)) == 1).alias("left"),
        )
        for k in range(TIER)
    ]
    return F.slice(F.array(*path), F.lit(1), F.col("steps"))


def _proofs(tree: _Tree, outer: DataFrame, folder: str) -> DataFrame:
    """``g, place, hash, kept, proof`` of every leaf, with the columns of ``outer`` but for
    its ``path``, which leads on from the root of a group."""
    blocks = _join(tree.tiers[-1], outer, "g")
    carried = [c for c in outer.columns if c not in ("g", "path")]
    for tier in range(len(tree.tiers) - 1, -1, -1):
        slots = blocks.withColumn("slot", F.explode("slots"))
        place = F.shiftleft("block", TIER).bitwiseOR(F.col("slot.slot").cast("long"))
        proof = F.concat(_within(F.col("slot.slot")), F.col("path"))
        found = slots.select("g", place.alias("place"), "slot.*", proof.alias("proof"), *carried)
        if tier:
            paths = found.select(
                "g", F.col("place").alias("block"), F.col("proof").alias("path"), *carried
            )
            paths = saved(paths, f"{folder}/paths-{tier}")
            blocks = _join(tree.tiers[tier - 1], paths, "g", "block")
    return found.drop("slot")


def manifest(
    docs: DataFrame, leaf: Column, id_: Column, group: Column, kept: Mapping[str, Column]
) -> DataFrame:
    """One row per row of ``docs``: the columns ``kept``, ``group``, ``place`` in it, ``leaf``,
    ``proof`` (per level, from the leaf to the root, the sibling's ``hash``, null where there is
    none, and whether it lies ``left``), ``subroot`` (of the group) and ``root``."""
    folder = working_folder(docs.sparkSession)
    rows = saved(
        docs.select(
            group.cast("string").alias("g"),
            id_.cast("long").alias("id"),
            leaf.alias("leaf"),
            F.struct(*[c.alias(n) for n, c in kept.items()]).alias("kept"),
            F.monotonically_increasing_id().alias("row"),
        ),
        f"{folder}/rows",
    )
    placed = coordinates(rows, folder)
    nodes = saved(placed.select("g", "place", F.col("leaf").alias("hash"), "kept"), f"{folder}/nodes")
    tree = _reduce(nodes, f"{folder}/groups")
    groups = numbered(tree.roots, [F.col("g").asc_nulls_first()], f"{folder}/in-order", "place")
    groups = groups.select(
        F.lit(None).cast("string").alias("g"), "place", "hash", F.col("g").alias("kept")
    )
    top = _reduce(groups, f"{folder}/top")
    start = top.roots.select("g", F.array().cast("array<struct<hash:string,left:boolean>>").alias("path"),
                             F.col("hash").alias("root"))
    outer = saved(
        _proofs(top, start, f"{folder}/top").select(
            F.col("kept").alias("g"), F.col("proof").alias("path"), F.col("hash").alias("subroot"), "root"
        ),
        f"{folder}/outer",
    )
    found = _proofs(tree, outer, f"{folder}/groups")
    return found.select(
        "kept.*", F.col("g").alias("group"), "place", F.col("hash").alias("leaf"), "proof", "subroot", "root"
    )
