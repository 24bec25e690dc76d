"""Benchmark decontamination with DataFrame functions only.

1. Benchmark items become words, five-word shingles and a 64-bit SimHash of their shingles,
   repeats included. Equal word sequences are one item with several ids.
2. Windows as long as an item are laid over the documents, at every start from which enough
   places of a window hold a shingle of the item: as many as the similarity asks for, were no
   repeat in vain. No other window can be similar enough, in whatever order the passage has
   the item's parts. The starts come as ranges from the sorted places a document shares with
   an item.
3. Fingerprints of windows meet those of items of the same length in a multi-index of
   ``BLOCKS`` blocks: two fingerprints within ``radius`` bits agree in at least one block up to
   ``radius // BLOCKS`` bits, and the index holds every block value that near. All fingerprints
   within the radius are found; the exact distance is checked.
4. Candidates are verified by the exact similarity of the two weighted shingle sets (a
   shingle's weight is its number of occurrences): shared weight over joint weight.

At a similarity of 0.8 two fingerprints differ in 10 of 64 bits on average; the radius of 23
lies more than four standard deviations above.

* Words are runs of letters and digits, lower-cased. A null or wordless text or item matches
  nothing. Texts are read whole; equal texts are compared once and all reported.
* A sequence of fewer than five words is one shingle, so an item that short is found only where
  it is the whole document; it is not searched for in longer ones. A document shorter than an item is compared as a whole.
* Repeated item rows count once; a null item id is reported as null. Empty tables give no rows.
* The benchmark's shingles are broadcast only if they are at most ``BROADCAST_ROWS``; beyond
  that Spark joins them as it sees fit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledeltas.llm.common import fresh, saved, working_folder

WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 23, 8
#: Rows of two longs each, at most: some ten MB.
BROADCAST_ROWS = 400_000


def _plain(text: str) -> Column:
    """The words of a text, a blank between them."""
    return F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "))


def _shingled(df: DataFrame, text: str) -> DataFrame:
    """``n`` words and the hashes of the shingles of each text, and no text. A text without
    words has one blank word, which no item has; a null text has no shingles.

    A shingle's hash is made of two pairs and a word; what lies beyond the end is null, and
    left out of the hash. Each step is a column of its own, so that it is evaluated once; for
    the same reason nothing filters on them, and rows are spread with an outer explode, below
    which Spark infers no filter."""

    def joined(left: str, right: str, ahead: int) -> Column:
        later = F.slice(right, F.lit(ahead + 1), F.col("n"))
        return F.zip_with(left, later, lambda x, y: F.xxhash64(x, y))

    return (
        df.withColumn("_one", F.transform(F.split(_plain(text), " "), lambda w: F.xxhash64(w)))
        .withColumn("n", F.size("_one"))
        .withColumn("_two", joined("_one", "_one", 1))
        .withColumn("_four", joined("_two", "_two", 2))
        .withColumn("shingles", F.slice(joined("_four", "_one", 4), 1, _shingle_count(F.col("n"))))
        .drop("_one", "_two", "_four", text)
    )


def _shingle_count(n: Column) -> Column:
    return F.greatest(n - F.lit(WORDS - 1), F.lit(1))


def _fingerprints(df: DataFrame, *by: str) -> DataFrame:
    """SimHash of the ``h`` of each group, and how many there are. Two counters share a sum."""
    lanes = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(lanes)).alias(f"_{k}") for k in range(32)]
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("weight"), *sums)

    def bit(k: int) -> Column:
        lane = F.col(f"_{k % 32}")
        n = F.shiftrightunsigned(lane, 32) if k >= 32 else lane.bitwiseAND(F.lit((1 << 32) - 1))
        one = F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k).cast("long")
        return F.when(2 * n > F.col("weight"), one).otherwise(F.lit(0).cast("long"))

    fp = reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in range(64)])
    return counted.select(*by, "weight", fp.alias("fp"))


def _near_values(radius: int) -> list[int]:
    """The differences of two block values that agree but for ``radius // BLOCKS`` bits."""
    return [v for v in range(1 << (64 // BLOCKS)) if v.bit_count() <= radius // BLOCKS]


def _with_blocks(df: DataFrame, *masks: int) -> DataFrame:
    """A row for each block of the fingerprint and each difference allowed in it."""
    width = 64 // BLOCKS
    blocks = df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    differing = blocks.withColumn("differs", F.explode(F.array(*[F.lit(m) for m in masks])))
    value = f"cast(shiftrightunsigned(fp, block * {width}) & {(1 << width) - 1} as int) ^ differs"
    return differing.withColumn("value", F.expr(value)).drop("differs")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _starts(places: DataFrame, similarity: float) -> DataFrame:
    """A row per ``start`` of a window whose shared ``places`` can make it similar enough.

    With ``need`` places in a window of ``long`` shingles, the first of them being the ``i``-th
    of all, the start lies behind the one before, not behind the ``i``-th itself, and reaches
    the one ``need - 1`` later; the last window ends with the document."""
    long = _shingle_count(F.least("m", "n"))
    need = F.ceil((long + _shingle_count(F.col("m"))) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))
    known = places.select(
        "text_key", "m", "places", long.alias("long"),
        F.greatest(need.cast("int"), F.lit(1)).alias("need"),
        F.greatest(F.col("n") - F.col("m"), F.lit(0)).alias("last"),
    ).where(F.size("places") >= F.col("need"))

    def limits(i: Column) -> Column:
        before = F.coalesce(F.get("places", i - 1) + 1, F.lit(0))
        reach = F.get("places", i + F.col("need") - 1) - F.col("long") + 1
        return F.struct(
            F.greatest(before, reach).alias("low"), F.least(F.get("places", i), "last").alias("high")
        )

    firsts = F.sequence(F.lit(0), F.size("places") - F.col("need"))
    ranges = F.filter(F.transform(firsts, limits), lambda x: x["low"] <= x["high"])
    return known.select("text_key", "m", F.explode(ranges).alias("range")).select(
        "text_key", "m", F.explode(F.sequence("range.low", "range.high")).alias("start")
    )


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    text_column: str = "text",
) -> DataFrame:
    """``text_key, item_id, similarity, word_start, n_words``: the best window of every text
    for every item it holds; the key is the text's MD5."""
    folder = working_folder(docs.sparkSession)
    texts = docs.select(
        F.md5(text_column).alias("text_key"), F.col(text_column).alias("text")
    ).where(F.col("text").isNotNull())
    worded = items.select("item_id", "text").where(F.length(_plain("text")) > 0)
    shingled_items = _shingled(worded, "text").withColumn(
        "item", F.xxhash64(F.concat_ws(" ", F.transform("shingles", lambda h: h.cast("string"))))
    )
    names = saved(shingled_items.select("item", "item_id").distinct(), f"{folder}/names")
    placed = saved(
        shingled_items.dropDuplicates(["item"]).select(
            "item", F.col("n").alias("m"), F.posexplode_outer("shingles").alias("offset", "h")
        ),
        f"{folder}/placed",
    )
    n_placed = placed.count()
    wanted = _small(placed.select("h").distinct(), n_placed)
    spread = _shingled(texts, "text").select(
        "text_key", "n", F.posexplode_outer("shingles").alias("place", "h")
    )
    parts = placed.select("item", "m", "h").distinct()
    hits = spread.join(wanted, "h", "left_semi").join(_small(parts, n_placed), "h")
    places = hits.groupBy("text_key", "item", "m", "n").agg(
        F.sort_array(F.collect_set("place")).alias("places")
    )
    windows = saved(
        _starts(places, similarity).select("text_key", "start", "m").distinct(), f"{folder}/windows"
    )

    holding = saved(windows.select("text_key").distinct(), f"{folder}/holding")
    held = _shingled(
        texts.join(holding, "text_key", "left_semi").groupBy("text_key").agg(F.any_value("text").alias("text")),
        "text",
    )
    long = _shingle_count(F.least("m", "n"))
    in_window = saved(
        held.join(windows, "text_key").select(
            "text_key",
            "start",
            "m",
            F.explode_outer(F.slice("shingles", F.col("start") + 1, long)).alias("h"),
        ),
        f"{folder}/in-window",
    )
    item_prints = _fingerprints(placed, "item", "m")
    index = _with_blocks(item_prints, *_near_values(radius)).select(
        "item", "m", "block", "value", F.col("fp").alias("item_fp"), F.col("weight").alias("item_weight")
    )
    index = saved(index, f"{folder}/index")
    prints = _with_blocks(_fingerprints(in_window, "text_key", "start", "m"), 0)
    near = (
        prints.join(index, ["m", "block", "value"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select("text_key", "start", "m", "weight", "item", "item_weight")
        .distinct()
    )
    near = saved(near, f"{folder}/near")

    def bag(df: DataFrame, name: str, *by: str) -> DataFrame:
        return df.groupBy(*by, "h").agg(F.count(F.lit(1)).alias(name))

    shared = (
        bag(in_window, "n_window", "text_key", "start", "m")
        .join(near, ["text_key", "start", "m"])
        .join(bag(placed, "n_item", "item"), ["item", "h"])
        .groupBy("text_key", "start", "m", "item", "weight", "item_weight")
        .agg(F.sum(F.least("n_window", "n_item")).alias("both"))
    )
    alike = F.col("both") / (F.col("weight") + F.col("item_weight") - F.col("both"))
    best = (
        shared.withColumn("similarity", alike)
        .where(F.col("similarity") >= similarity)
        .groupBy("text_key", "item")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "m")).alias("best"))
    )
    return saved(
        best.join(names, "item").select(
            "text_key",
            "item_id",
            F.col("best.similarity").alias("similarity"),
            (-F.col("best.s")).alias("word_start"),
            F.col("best.m").alias("n_words"),
        ),
        f"{folder}/found",
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with."""
    found = find_passages(docs, items, **options)
    keys = saved(found.select("text_key").distinct(), f"{working_folder(docs.sparkSession)}/keys")
    (key,) = fresh(docs, "_text_key")
    text = options.get("text_column", "text")
    marked = docs.withColumn(key, F.md5(text))
    return marked.join(keys.select(F.col("text_key").alias(key)), key, "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
