"""Spelling variants: words one edit apart, found by pivotal grams, and the forms they lead to.

Bigrams are ordered by how many words hold them, rare ones first. Of two words one edit apart,
the one whose third rarest gram comes first in that order has two disjoint grams up to there,
its pivots; the edit leaves one of them whole, and the other word holds that one up to its own
third gram, its prefix. Which two disjoint grams are the rarest, a dynamic program over their
positions decides. So the pivots of every word are looked up in an index of all prefixes:

* Position limits make the lookups narrow: an edit that touches the first pivot or lies before
  it leaves all from the second one on as it is, and any other edit all up to the end of the
  first. Of what lies beyond the pivot, the edit leaves one half as it is. So what is looked up
  is the gram with the whole of its side and that half, for the three lengths the other word
  can have. It is an equi-join, never a pairing of all words of a gram.
* What meets is verified by its edit distance over code points; copies of a pair are dropped
  after that. All is exact: no pair is lost, none is added, no list is capped.

* Occurrences are counted within each task before the shuffle, so a frequent word costs a row
  per task. The gram table is broadcast: the alphabet has 90 letters, hence at most 8,100 grams.
* Null and empty texts hold no words; a null id counts as an empty one. Repeated rows count as
  often as they occur. Texts of any length are read whole; a text's runs are held by one task.
* Ties: of equal counts the word that is smaller by code points wins. Empty tables give no rows.
  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledeltas.llm.common import saved

#: Runs of letters of the first two Latin blocks.
RUN = "[A-Za-zÀ-ÿ]+"
#: Grams of a prefix: one edit destroys two grams at most, so one of three survives it.
GRAM, PREFIX = 2, 3


def runs(text: Column) -> Column:
    """Runs of letters, with A-Z in lower case."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))


def misspelt(doc_id: Column, run: Column, every: int) -> Column:
    """One in ``every`` runs loses a code point, both chosen by a CRC of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    place = (h % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), place), F.substr(run, place + 2))
    return F.when(h % every == 0, shorter).otherwise(run)


def count_words(words: DataFrame, shortest: int, least: int) -> DataFrame:
    """``word, n`` for the words of at least ``shortest`` code points and ``least`` rows."""
    long_enough = words.where(F.char_length("word") >= shortest)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# --- near words ---------------------------------------------------------------------------


def _two_rarest(grams: Column) -> Column:
    """The two disjoint grams of least total weight, of ``pos, weight`` in order of position.

    ``best`` is the rarest gram that ends before the next but one can begin, ``last`` the one
    just passed, which only a gram two places on is disjoint with.
    """
    gram = "struct<pos:int,weight:bigint>"
    state = f"struct<best:{gram},last:{gram},total:bigint,first:int,second:int>"
    none = F.lit(None).cast(state)

    def rarer(a: Column, b: Column) -> Column:
        return F.when(b.isNull() | (a["weight"] <= b["weight"]), a).otherwise(F.coalesce(b, a))

    def step(s: Column, x: Column) -> Column:
        before = F.when(s["last"]["pos"] + GRAM <= x["pos"], rarer(s["last"], s["best"])).otherwise(s["best"])
        total = before["weight"] + x["weight"]
        better = before.isNotNull() & (s["total"].isNull() | (total < s["total"]))
        return F.struct(
            F.when(s["last"].isNotNull(), rarer(s["last"], s["best"])).alias("best"),
            x.alias("last"),
            F.when(better, total).otherwise(s["total"]).alias("total"),
            F.when(better, before["pos"]).otherwise(s["first"]).alias("first"),
            F.when(better, x["pos"]).otherwise(s["second"]).alias("second"),
        ).cast(state)

    chosen = F.aggregate(grams, none, step)
    return F.struct(chosen["first"].alias("first"), chosen["second"].alias("second"))


def gram_prefixes(words: DataFrame) -> DataFrame:
    """``word, prefix, pivots`` for a saved table of words of four letters or more: positions
    (from 0) of the grams no more frequent than the third rarest, and of the two pivots."""
    starts = F.sequence(F.lit(0), F.char_length("word") - GRAM)
    grams = words.select("word", F.explode(starts).alias("pos")).withColumn(
        "gram", F.substr("word", F.col("pos") + 1, F.lit(GRAM))
    )
    weights = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("weight"))
    weighted = grams.join(F.broadcast(weights), "gram")  # as many rows as the alphabet has pairs
    ordered = weighted.groupBy("word").agg(
        F.sort_array(F.collect_list(F.struct("weight", "gram", "pos"))).alias("grams")
    )
    third = F.get("grams", F.lit(PREFIX - 1))
    limit = F.struct(third["weight"].alias("weight"), third["gram"].alias("gram"))
    # all places of the third gram: which of them comes third says nothing about the other word
    prefix = F.filter(
        "grams",
        lambda g: F.struct(g["weight"].alias("weight"), g["gram"].alias("gram")) <= limit,
    )
    by_place = F.sort_array(
        F.transform(prefix, lambda g: F.struct(g["pos"].alias("pos"), g["weight"].alias("weight")))
    )
    cut = ordered.select("word", by_place.alias("prefix"))
    return cut.select(
        "word", F.transform("prefix", lambda g: g["pos"]).alias("prefix"), _two_rarest(F.col("prefix")).alias("pivots")
    )


def _half(of: Column) -> Column:
    return (F.greatest(of, F.lit(0)) / 2).cast("int")


def _kept_before(place: Column, length: Column) -> tuple[Column, Column]:
    """What ``word`` shares with one of ``length`` that an edit behind the gram at ``place``
    leads to: all up to the gram's end and, of the other word's rest, the first or second half."""
    end, own = place + GRAM, F.char_length("word")
    half = _half(length - end)
    tail = length - end - half
    return (
        F.concat(F.lit("<1"), F.substr("word", F.lit(1), end + half)),
        F.concat(F.lit("<2"), F.substr("word", F.lit(1), end), F.lit("|"), F.substr("word", own - tail + 1)),
    )


def _kept_behind(place: Column, length: Column) -> tuple[Column, Column]:
    """The same for an edit before the gram: all from the gram on, and the second or first half
    of what the other word has before it."""
    own = F.char_length("word")
    half = _half(place + length - own)
    return (
        F.concat(F.lit(">1"), F.substr("word", own - (length - half) + 1)),
        F.concat(F.lit(">2"), F.substr("word", F.lit(1), half), F.lit("|"), F.substr("word", place + 1)),
    )


def _first_or_second(kept: Callable, length: Column, which: int) -> Callable[[Column], Column]:
    return lambda place: kept(place, length)[which]


def near_pairs(words: DataFrame, folder: str) -> DataFrame:
    """``a, b`` with a < b for all pairs of different words that are one inserted, deleted or
    replaced code point apart; words have four letters or more, each is there once."""
    found = saved(gram_prefixes(words.select("word")), f"{folder}/prefixes")
    own = F.char_length("word")
    before = F.concat(*[F.transform("prefix", _first_or_second(_kept_before, own, i)) for i in (0, 1)])
    behind = F.concat(*[F.transform("prefix", _first_or_second(_kept_behind, own, i)) for i in (0, 1)])
    index = found.select(
        F.col("word").alias("b"), F.explode(F.concat(before, behind)).alias("side"), own.alias("length")
    )
    lookups = found.select("word", "pivots", F.explode(F.sequence(own - 1, own + 1)).alias("length"))
    asked = F.array(
        *_kept_before(F.col("pivots.first"), F.col("length")),
        *_kept_behind(F.col("pivots.second"), F.col("length")),
    )
    lookups = lookups.select(F.col("word").alias("a"), F.explode(asked).alias("side"), "length")
    met = lookups.join(index, ["side", "length"]).where(F.levenshtein("a", "b", 1) == 1)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --- forms --------------------------------------------------------------------------------


def _roots(forms: DataFrame, folder: str) -> DataFrame:
    """``word, root``: forms are followed, twice as far in each round, until none leads on.
    Counts multiply along a path, so its length grows with the logarithm of the corpus only."""
    at = saved(forms.select("word", F.coalesce("form", "word").alias("root")), f"{folder}/roots")
    turn = 0
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = saved(at.join(onward, "root"), f"{folder}/ahead-{turn}")
        if ahead.where(F.col("next") != F.col("root")).isEmpty():
            return at
        at, turn = ahead.select("word", F.col("next").alias("root")), turn + 1


def variants(words: DataFrame, ratio: int, folder: str) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a saved table ``word, n``. The form is the
    most frequent near word, if it occurs at least ``ratio`` times as often, two or more."""
    pairs = saved(near_pairs(words, folder), f"{folder}/pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"))
    )
    theirs = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    near = both.join(theirs, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left")
    wins = -F.col("best.minus") >= F.col("n") * ratio
    forms = saved(
        joined.select(
            "word",
            F.when(wins, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(wins, -F.col("best.minus")).alias("form_n"),
        ),
        f"{folder}/forms",
    )
    return forms.join(_roots(forms, folder), "word").select(
        "word", "form", "root", "n", "n_near", "form_n"
    )
