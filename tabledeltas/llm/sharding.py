"""Sharding by balanced label propagation.

Documents with a key in common are linked. Every document starts in a shard of its own hash's
choice; in each round joins count every key's members per shard, and a document moves to the
shard that holds most of its neighbours, itself included, of those that still have room, as far
as the quota of that shard admits: whole groups at a time, chosen by hash. A group that is
refused finds its next best shard in a later round. The quota leaves ``SLACK`` over an even
share, so that there is always room somewhere, and the rounds go on until nobody moves. Groups
larger than a shard are split into parts that fit, and the few parts that are large beside a
shard are placed first, largest to the emptiest shard. Documents without neighbours fill what is
left.

Last the shares are made exact: documents are numbered along the shards' labels and cut into
runs whose counts are at most one apart. Unlinked documents lie around each cut, so that a cut
rarely divides a group; where all are linked, each of the cuts divides one group at most.

* The law is ``rows``: counts of any two shards differ by at most one, sizes are not regarded.
* A null text is an empty one: it has size 1, CRC 0, and is linked to the empty texts. Texts of
  any length are hashed in the task that reads them.
* Repeated rows are documents of their own, linked by their text. Ties go by hash.
* All choices follow from id and text, or what else a row is known by, and from the order of
  those hashes: reruns give the same shards however Spark splits the table. Only rows equal in
  both may change places. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledeltas.llm.common import fresh, numbered, saved, working_folder

SHARDS = 8
#: How far a shard may be over an even share before the shares are made exact.
SLACK = 0.05
#: Rounds after which what still moves is let in without a quota. Not seen: groups settle in ten.
ROUNDS = 64
#: A part of a group is large from this fraction of a shard on: so at most SHARDS * LARGE are.
LARGE = 16


def _fraction(*of: Column | str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _lookup(values: list[float], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), place + 1)


def _counts(df: DataFrame, shard: Column | str, shards: int) -> list[int]:
    """Rows per shard: as many numbers as there are shards reach the driver."""
    found = dict(df.groupBy(F.col(shard) if isinstance(shard, str) else shard).count().collect())
    return [found.get(s, 0) for s in range(shards)]


def propagate(links: DataFrame, room: list[float], folder: str, shards: int = SHARDS) -> DataFrame:
    """``row, shard`` for the rows of ``row, key`` links, about ``room`` rows a shard at most, of
    which together there must be more than rows."""
    labels = saved(
        links.select("row").distinct().withColumn(
            "shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
        ),
        f"{folder}/labels",
    )
    every = range(shards)
    for turn in range(ROUNDS + 1):
        now = _counts(labels, "shard", shards)
        open_to = [s for s in every if now[s] < room[s]] or list(every)
        at = saved(links.join(labels, "row"), f"{folder}/at-{turn}")
        held = saved(
            at.groupBy("key").agg(
                *[F.count_if(F.col("shard") == s).alias(f"n{s}") for s in every]
            ),
            f"{folder}/held-{turn}",
        )
        votes = (
            at.join(held, "key")
            .groupBy("row", "shard")
            .agg(F.min("key").alias("key"), *[F.sum(f"n{s}").alias(f"n{s}") for s in every])
        )
        # most neighbours first; of equals the one the group's hash prefers, for all its members
        preferred = F.array_max(
            F.array(*[
                F.struct(
                    F.col(f"n{s}").alias("n"),
                    F.xxhash64("key", F.lit(turn), F.lit(s)).alias("h"),
                    F.lit(s).alias("to"),
                )
                for s in open_to
            ])
        )
        # a group that is together stays so, but where its shard is over its room
        split = F.greatest(*[F.col(f"n{s}") for s in every]) < sum(F.col(f"n{s}") for s in every)
        over = F.col("shard").isin([s for s in every if now[s] > room[s]])
        wish = F.when(split | over, preferred["to"]).otherwise(F.col("shard")).alias("to")
        chosen = saved(votes.select("row", "shard", "key", wish), f"{folder}/chosen-{turn}")
        moving = chosen.where(F.col("to") != F.col("shard"))
        wanted, leaving = _counts(moving, "to", shards), _counts(moving, "shard", shards)
        if not any(wanted):
            break
        quota = [
            min(1.0, max(0.0, room[s] - now[s] + leaving[s]) / wanted[s])
            if wanted[s] and turn < ROUNDS
            else 1.0
            for s in every
        ]
        admitted = _fraction("key", F.lit(f"admit {turn}")) < _lookup(quota, F.col("to"))
        labels = saved(
            chosen.select("row", F.when(admitted, F.col("to")).otherwise(F.col("shard")).alias("shard")),
            f"{folder}/labels-{turn}",
        )
    return labels


def _place_large(sizes: list[tuple], shards: int) -> dict[tuple, int]:
    """Largest part first, each to the emptiest shard."""
    heap = [(0, s) for s in range(shards)]
    places = {}
    for key, part, n in sorted(sizes, key=lambda x: (-x[2], x[0], x[1])):
        load, s = heapq.heappop(heap)
        places[key, part] = s
        heapq.heappush(heap, (load + n, s))
    return places


def ranked(rows: DataFrame, known_by: Sequence[Column], path: str) -> DataFrame:
    """``rows`` with ``row``, their place in the order of a hash of ``known_by``: a number that
    does not depend on how Spark splits the table."""
    first, second, tie = fresh(rows, "_first", "_second", "_tie")
    hashed = rows.withColumns(
        {
            first: F.xxhash64(*known_by),
            second: F.xxhash64(*known_by, F.lit("again")),
            tie: F.monotonically_increasing_id(),
        }
    )
    order = [F.col(c) for c in (first, second, tie)]
    return numbered(hashed, order, path, "row").drop(first, second, tie)


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``row, shard, slot`` for a saved table of ``row, key``, as ``ranked`` numbers it; ``slot``
    counts from 0 in each shard. Rows of equal key are linked."""
    folder = working_folder(rows.sparkSession)
    n_rows = rows.count()
    share = max(1.0, n_rows / shards)
    groups = saved(
        rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), f"{folder}/groups"
    )
    parts = F.ceil(F.col("n") / F.lit(share))
    linked = saved(
        rows.join(groups, "key").select(
            "row",
            "key",
            F.pmod(F.xxhash64("row", F.lit("part")), parts).cast("int").alias("part"),
            (F.col("n") / parts >= F.lit(max(2.0, share / LARGE))).alias("large"),
        ),
        f"{folder}/linked",
    )
    # bounded: each of these parts has about a 1/LARGE part of a shard's rows, or more
    large = linked.where("large").groupBy("key", "part").count().collect()
    places = _place_large([tuple(r) for r in large], shards)
    pinned = linked.where("large")
    if places:
        pairs = [F.lit(x) for (k, p), s in places.items() for x in (f"{k}/{p}", s)]
        pinned = pinned.withColumn(
            "shard", F.element_at(F.create_map(*pairs), F.concat_ws("/", "key", "part"))
        )
    else:
        pinned = pinned.withColumn("shard", F.lit(0))
    pinned = saved(pinned.select("row", "key", "part", "shard"), f"{folder}/pinned")
    load = _counts(pinned, "shard", shards)
    small = linked.where("NOT large").select("row", "key")
    room = [max(0.0, share * (1 + SLACK) - n) for n in load]
    moved = propagate(small, room, folder, shards)
    labelled = pinned.union(
        small.join(moved, "row").select("row", "key", F.lit(0).alias("part"), "shard")
    )
    labelled = saved(labelled, f"{folder}/labelled")
    left = [max(0.0, share - n) for n in _counts(labelled, "shard", shards)]
    ends = [sum(left[: s + 1]) / (sum(left) or 1.0) for s in range(shards)]
    u = _fraction("row", F.lit("fill"))
    fill = F.coalesce(
        *[F.when(u < F.lit(e), F.lit(s)) for s, e in enumerate(ends)], F.lit(shards - 1)
    )
    single = rows.join(labelled.select("row"), "row", "left_anti").select(
        "row", "key", F.lit(0).alias("part"), fill.alias("shard")
    )
    side = F.when(_fraction("row", F.lit("side")) < 0.5, F.lit(-1)).otherwise(F.lit(1))
    in_turn = labelled.withColumn("side", F.lit(0)).unionByName(single.withColumn("side", side))
    order = [F.col(c) for c in ("shard", "side", "key", "part", "row")]
    placed = numbered(in_turn, order, f"{folder}/in-turn", "number")
    starts = [s * n_rows // shards for s in range(shards)]
    number = F.col("number")
    shard = sum(((number >= F.lit(b)).cast("int") for b in starts[1:]), F.lit(0))
    return placed.select("row", shard.cast("int").alias("shard"), "number").select(
        "row",
        "shard",
        (number - _lookup(starts, F.col("shard")).cast("long")).alias("slot"),
    )


def facts(docs: DataFrame, text: str = "text") -> list[Column]:
    """Size, CRC and link key of a document."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [
        (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.xxhash64(whole).alias("key"),
    ]
