"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per source and every source gets a target share of all words. A document is
emitted ``floor(rate)`` times, where the rate is the target over the words its source has, and
once more with a probability equal to the fraction of the rate.

* Sources are ranked by code point, null last, and take the weights in turn. A target never
  exceeds ``cap`` times the words of its source; what is over is shared again by weight.
* The extra copy is drawn from an MD5 of seed, id, source and text: reruns agree. Rows equal in
  all of them are counted, and where there are such, numbered: each draws for itself, from the
  same MD5 and its number. Which of them gets which number follows the other columns; rows equal
  in these as well are interchangeable. The numbering deals out a hot row like any other rows.
* A null or blank text has no words; it is emitted at its source's rate like any other. A
  source without words gets the target 0 and emits nothing.
* An empty table gives an empty mix. Further columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledeltas.llm.common import WORD, fresh, hex_fraction, numbered, saved, working_folder

WEIGHTS = (1, 2, 3)
CAP = 3


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, folder: str | None = None
) -> DataFrame:
    """``source, source_size, target`` for a table of ``source, size`` rows.

    Water-filling: the level is what capped sources leave, divided by the weights of the rest.
    Each round caps the sources now above their limit; no source is ever released again, so it
    ends. Only the totals of a round, one row, reach the driver.
    """
    folder = folder or working_folder(sizes.sparkSession)
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(
        per_source, [F.col("source").asc_nulls_last()], f"{folder}/sources", "place"
    )
    turn = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]),
        (F.col("place") % len(weights) + 1).cast("int"),
    )
    state = saved(
        ranked.select(
            "source",
            "source_size",
            turn.cast("decimal(38,0)").alias("weight"),
            (F.col("source_size") * cap).cast("decimal(38,0)").alias("most"),
        ),
        f"{folder}/weighted",
    )
    total = state.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped = F.lit(False)
    left = free = n_capped = None
    while True:
        row = state.agg(
            F.sum(F.when(capped, F.col("most"))).alias("used"),
            F.sum(F.when(~capped, F.col("weight"))).alias("free"),
            F.sum(capped.cast("long")).alias("n"),
        ).first()
        if row["n"] == n_capped or not row["free"]:
            break
        n_capped, free = row["n"], int(row["free"])
        left = int(total) - int(row["used"] or 0)
        level = F.lit(left).cast("decimal(38,0)") * F.col("weight")
        capped = F.col("most") * F.lit(free).cast("decimal(38,0)") < level
    shared = (
        F.col("weight").cast("double") * F.lit(float(left or 0)) / F.lit(float(free or 1))
    )
    target = F.when(capped, F.col("most").cast("double")).otherwise(shared)
    return saved(
        state.select("source", "source_size", target.alias("target")), f"{folder}/targets"
    )


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> tuple[DataFrame, dict[str, str]]:
    """The documents with four more columns, and their names by role: ``size``,
    ``source_size``, ``target`` (both of the document's source) and ``copies``."""
    names = dict(zip(("size", "source_size", "target", "copies"), fresh(
        docs, "size", "source_size", "target", "copies")))
    sizes = docs.select(
        F.col(source_column).cast("string").alias("source"), word_count(text_column).alias("size")
    )
    targets = source_targets(sizes, weights, cap)
    of_source, rate = fresh(docs, "_source", "_rate")
    targets = targets.select(
        F.col("source").alias(of_source),
        F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]),
    )
    key = F.concat_ws(
        "|",
        F.lit(str(seed)),
        *[
            F.coalesce(F.col(c).cast("string"), F.lit(""))
            for c in (id_column, source_column, text_column)
        ],
    )
    every = F.when(
        F.col(names["source_size"]) > 0,
        F.col(names["target"]) / F.col(names["source_size"]),
    ).otherwise(F.lit(0.0))
    sized = docs.withColumns({names["size"]: word_count(text_column), rate: F.md5(key)})
    sized = _draw_apart(sized, rate, docs.columns).withColumn(rate, hex_fraction(F.col(rate)))
    joined = sized.join(
        targets, F.col(source_column).cast("string").eqNullSafe(F.col(of_source)), "left"
    )
    copies = F.floor(every) + (F.col(rate) < every - F.floor(every)).cast("long")
    return joined.withColumn(names["copies"], copies).drop(of_source, rate), names


def _draw_apart(rows: DataFrame, drawn: str, columns: Sequence[str]) -> DataFrame:
    """Give repeated values of the column ``drawn`` new ones, each its own: all but the first of
    them the MD5 of value and number."""
    folder = working_folder(rows.sparkSession)
    own = [F.col(f"`{c}`") for c in rows.columns]
    twin, row, number, first = fresh(rows, "_twin", "_row", "_number", "_first")
    repeated = rows.groupBy(drawn).agg(F.count(F.lit(1)).alias(twin)).where(F.col(twin) > 1)
    repeated = saved(repeated, f"{folder}/repeated")
    if repeated.isEmpty():
        return rows
    marked = rows.join(repeated, drawn, "left").select(*own, twin)
    alike = marked.where(F.col(twin).isNotNull()).withColumn(row, F.monotonically_increasing_id())
    others = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))
    placed = numbered(alike, [F.col(drawn), others, F.col(row)], f"{folder}/alike", number)
    least = placed.groupBy(drawn).agg(F.min(number).alias(first))
    place = F.col(number) - F.col(first)
    again = F.md5(F.concat_ws("|", drawn, place.cast("string")))
    placed = placed.join(least, drawn).withColumn(drawn, F.when(place == 0, F.col(drawn)).otherwise(again))
    alone = marked.where(F.col(twin).isNull())
    return alone.select(*own).unionByName(placed.select(*own))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as planned, with the columns it came with."""
    planned, names = plan_mix(docs, **options)
    (turn,) = fresh(planned, "_turn")
    kept = planned.where(F.col(names["copies"]) > 0)
    repeated = kept.withColumn(
        turn, F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int")))
    )
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
