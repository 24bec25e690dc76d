"""Removal of long repeated strings, found by suffix sorting of document pieces.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts anywhere else.

1. Every window of ``LENGTH`` bytes has a least hash among its ``GRAM``-byte grams. Consecutive
   windows with the same least hash make a segment, so equal windows lie in segments of one
   hash. What is written per segment is its hash, a digest and its place, a few dozen bytes.
2. Hashes that one segment alone has are dropped: its windows are unique, unless its least gram
   occurs twice in it. Segments that occur twice as a whole are repeated as a whole.
3. Of the rest, the different segments of a hash, windows with a gram that no other segment has
   are cut off, and equal pieces that are left are repeated. The other pieces are sorted as a
   collection, column by column from the right: each round inserts one symbol of every piece
   into the collection's Burrows-Wheeler transform and the new suffixes' common prefixes between
   the old ones, in one sequential pass over both. A window is repeated if its suffix shares
   ``LENGTH`` bytes with a neighbour. The passes go over arrays in memory, bounded by ``BATCH``
   and ``CROWD`` segments: a task has no place for files of its own on a cluster.
4. A hash with more than ``CROWD`` different segments would not fit: its windows are compared
   one by one, by a shuffle of their 128-bit digests.

* Strings are judged on the input and never cross documents; overlaps count. Repeats within a
  document count like those between documents. Spans are maximal runs of removed bytes.
* A null text is empty. Equal texts are worked on once and get equal results, each row its own;
  a text that occurs twice and has ``LENGTH`` bytes or more is removed whole.
* An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabledeltas.llm.common import saved, working_folder

LENGTH, GRAM = 200, 64
#: Windows of a segment, at most; longer ones are cut, which changes nothing.
MOST = 256
#: Segments worked on at once, about; and those of one hash at most.
BATCH, CROWD = 4096, 1 << 14
#: Bytes of a text whose windows are hashed at once.
PIECE = 1 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOW = np.uint64(511)  # places of grams modulo 512, which no window spans


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = (x * _B) ^ (y * _C)
    z ^= z >> np.uint64(31)
    z *= _A
    return z ^ (z >> np.uint64(29))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every place on."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    h = np.ascontiguousarray(eight).view("<u8").ravel()
    size = 8
    while size < GRAM:
        h = _mix(h[:-size], h[size:])
        size *= 2
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    behind = np.minimum.accumulate(rows, axis=1).ravel()[width - 1 : width - 1 + n]
    return np.minimum(ahead, behind)


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first window, number of windows, and whether the least gram occurs more than once,
    of each segment of a text."""
    parts = []
    for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
        data = np.frombuffer(text[at : at + PIECE + LENGTH - 1], np.uint8)
        if len(data) < LENGTH:
            break
        grams, width = _gram_hashes(data), LENGTH - GRAM + 1
        place = np.arange(len(grams), dtype=np.uint64) & _LOW
        high = grams & ~_LOW
        least = _sliding_min(high | place, width)
        # the same with ties in reverse: another place means that the least gram is there twice
        other = _sliding_min(high | (_LOW - place), width)
        value, here = least >> np.uint64(9), least & _LOW
        twice = here != _LOW - (other & _LOW)
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        size = np.diff(first, append=len(value))
        repeats = np.logical_or.reduceat(twice, first) | (here[first] != here[first + size - 1])
        if size.max() > MOST:
            cuts = -(-size // MOST)
            of = np.repeat(np.arange(len(first)), cuts)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            begin = first[of] + nth * MOST
            size = np.minimum(MOST, first[of] + size[of] - begin)
            first, repeats = begin, repeats[of]
        parts.append((value[first].astype(np.int64), first + at, size, repeats))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _signed(digests: list[int]) -> np.ndarray:
    return np.array(digests, dtype=np.uint64).view(np.int64)


SEGMENTS = "h1 long, h2 long, hash long, digest long, first long, n int, repeats boolean"


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for h1, h2, text in zip(batch["h1"], batch["h2"], batch["text"]):
            data = text.encode("utf-8", "surrogatepass")
            value, first, size, repeats = segments(data)
            if len(value):
                ends = (first + size + LENGTH - 1).tolist()
                digest = _signed(
                    [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), ends)]
                )
                same = np.ones(len(value), np.int64)
                out.append((same * h1, same * h2, value, digest, first, size, repeats))
        names = ("h1", "h2", "hash", "digest", "first", "n", "repeats")
        if out:
            yield pd.DataFrame(dict(zip(names, (np.concatenate(x) for x in zip(*out)))))


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, at which places a string of ``length`` bytes starts that also starts
    elsewhere in the collection."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order])
    m, longest = len(order), int(sizes.max(initial=0))
    # symbols from 1 on; bytes of UTF-8 are never 255
    data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8) + np.uint8(1)
    ends = np.cumsum(sizes)
    # all suffixes so far, sorted, the empty ones first: the symbol before each of them, and
    # what it shares with the one above (255 at most)
    bwt, lcp = np.zeros(m, np.uint8), np.zeros(m, np.uint8)
    place = np.arange(m)  # of every text's longest suffix so far
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    for t in range(1, longest + 1):
        k = active[t - 1]
        at = place[:k]
        bwt[at] = data[ends[:k] - t]
        new = np.zeros(len(bwt), bool)
        new[at] = True
        # suffixes with a symbol before them, sorted by it, are the longer suffixes in order
        above = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0) :]
        flag = new.take(above)
        fresh = np.flatnonzero(flag)
        owner = np.argsort(at)
        place[owner[np.searchsorted(at[owner], above[fresh])]] = m + fresh
        lcp_next = np.zeros(m + len(above), np.uint8)
        bwt_next = np.zeros(m + len(above), np.uint8)
        old = ~flag
        bwt_next[:m], bwt_next[m:][old], lcp_next[m:][old] = bwt[:m], bwt[m:], lcp[m:]
        flag[1:] |= flag[:-1]
        changed = np.flatnonzero(flag[1:]) + 1
        lcp_next[m + changed] = 0
        low, high = above[changed - 1], above[changed]
        same = bwt[low] == bwt[high]
        changed, low, high = changed[same], low[same] + 1, high[same] + 1
        if len(changed):
            by = np.argsort(low, kind="stable")
            bounds = np.empty(2 * len(by), np.int64)
            bounds[::2], bounds[1::2] = low[by], high[by]
            shared = np.minimum.reduceat(np.append(lcp, np.uint8(255)), bounds)[::2]
            lcp_next[m + changed[by]] = np.minimum(shared, 254) + np.uint8(1)
        bwt, lcp = bwt_next, lcp_next
    last = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0) :]
    longer = np.zeros(len(bwt), np.int64)
    longer[last] = m + np.arange(len(last))
    close = lcp >= length
    close[:-1] |= close[1:]
    found = [np.zeros(max(0, s - length + 1), bool) for s in sizes]
    marks = np.zeros((m, max(0, longest - length + 1)), bool)
    walk = np.arange(m)
    for t in range(1, longest + 1):
        k = active[t - 1]
        walk[:k] = longer[walk[:k]]
        if t >= length:
            marks[:k, t - length] = close[walk[:k]]
    for i, f in enumerate(found):
        f[:] = marks[i, : len(f)][::-1]
    out = list(found)
    for i, f in zip(order, found):
        out[i] = f
    return out


RUNS = "h1 long, h2 long, first long, n int"


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def _possible(texts: list[bytes], times: np.ndarray) -> list[np.ndarray]:
    """For each text, which of its windows hold no gram that is there once only: a window with
    such a gram cannot be repeated. Four grams of a window are looked at, its ends included."""
    sizes = np.array([len(t) for t in texts])
    hashes = _gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
    ends = np.cumsum(sizes)
    own = np.arange(len(hashes))
    of = np.searchsorted(ends, own, side="right")
    hashes[own + GRAM > ends[of]] = 0  # grams across two texts
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    held = np.add.reduceat(np.minimum(times, 2)[of[order]], first)
    several = np.zeros(len(hashes), bool)
    several[order] = np.repeat(held > 1, np.diff(first, append=len(hashes)))
    last = LENGTH - GRAM
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist()):
        grams = several[end - size : end - GRAM + 1]
        n = size - LENGTH + 1
        ok = grams[:n] & grams[last : last + n]
        for step in (last // 3, 2 * last // 3):
            ok &= grams[step : step + n]
        out.append(ok)
    return out


def _repeats_within(hashes: np.ndarray, texts: list[bytes], times: np.ndarray) -> list[np.ndarray]:
    """For each segment, which of its windows are repeated among the segments of its hash; those
    of a segment that occurs several times are not told.

    What a gram shows to be unique is cut off first. Equal pieces that are left are repeated;
    only the pieces that then stand alone, and the others of their hash, are sorted."""
    marks = [np.zeros(len(t) - LENGTH + 1, bool) for t in texts]
    members: dict[tuple, list[tuple[int, int]]] = {}
    for i, ok in enumerate(_possible(texts, times)):
        for a, n in zip(*_runs(ok)):
            piece = texts[i][a : a + n + LENGTH - 1]
            members.setdefault((hashes[i], piece), []).append((i, int(a)))
    alone = {}
    for key, held in members.items():
        alone[key] = sum(times[i] for i, _ in held) == 1
        if not alone[key]:
            for i, a in held:
                marks[i][a : a + len(key[1]) - LENGTH + 1] = True
    doubtful = {h for (h, _), single in alone.items() if single}
    keys = [k for k in members if k[0] in doubtful]
    for key, found in zip(keys, repeated_windows([piece for _, piece in keys])):
        if alone[key]:
            ((i, a),) = members[key]
            marks[i][a : a + len(found)] |= found
    return marks


def _sort_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by hash; whole hashes are worked on together, about ``BATCH`` rows at
    once and never more than ``CROWD`` of one hash."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        times = rows["times"].to_numpy(np.int64)
        marked = _repeats_within(rows["hash"].to_numpy(), rows["bytes"].tolist(), times)
        for h1, h2, first, n, marks in zip(rows["h1"], rows["h2"], rows["first"], times, marked):
            if n == 1:  # the others are repeated as a whole
                out += [(h1, h2, first + int(a), int(size)) for a, size in zip(*_runs(marks))]
        return pd.DataFrame(out, columns=["h1", "h2", "first", "n"])

    waiting = None
    for batch in batches:
        waiting = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        while len(waiting) > 2 * BATCH:
            last = waiting["hash"].to_numpy()
            cut = int(np.searchsorted(last, last[BATCH], side="right"))
            if cut == len(waiting):
                break
            yield work(waiting.iloc[:cut])
            waiting = waiting.iloc[cut:]
    if waiting is not None and len(waiting):
        yield work(waiting)


def _with_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for h1, h2, text, wanted in zip(batch["h1"], batch["h2"], batch["text"], batch["wanted"]):
            data = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                part = data[w["first"] : w["first"] + w["n"] + LENGTH - 1]
                out.append((w["hash"], h1, h2, w["first"], w["times"], w["crowded"], part))
        yield pd.DataFrame(out, columns=["hash", "h1", "h2", "first", "times", "crowded", "bytes"])


def _each_window(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for h1, h2, first, times, data in zip(*(batch[c] for c in ("h1", "h2", "first", "times", "bytes"))):
            n = len(data) - LENGTH + 1
            d = b"".join(xxhash.xxh3_128_digest(data[i : i + LENGTH]) for i in range(n))
            w = np.frombuffer(d, "<i8").reshape(-1, 2)
            yield pd.DataFrame(
                {"w1": w[:, 0], "w2": w[:, 1], "h1": h1, "h2": h2, "first": first + np.arange(n), "times": times}
            )


def _cut(text: str, runs: list | None) -> tuple[int, int, int, str]:
    data = text.encode("utf-8", "surrogatepass")
    spans: list[list[int]] = []
    for first, n in sorted((r["first"], r["n"]) for r in ([] if runs is None else runs)):
        end = first + n + LENGTH - 1
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([first, end])
    digest, at = hashlib.sha256(), 0
    for first, end in spans:
        digest.update(data[at:first])
        at = end
    digest.update(data[at:])
    return len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest()


CUTS = "h1 long, h2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(a, b, *_cut(t, r)) for a, b, t, r in zip(*(batch[c] for c in ("h1", "h2", "text", "runs")))]
        yield pd.DataFrame(rows, columns=["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_runs(texts: DataFrame, folder: str) -> DataFrame:
    """``h1, h2, first, n``: runs of places at which repeated strings start, for a table of
    ``h1, h2, text`` with a 128-bit key of the text."""
    spark = texts.sparkSession
    keys = ["hash", "digest"]
    found = saved(texts.mapInPandas(_spread, SEGMENTS), f"{folder}/segments")
    several = found.groupBy("hash").agg(F.count(F.lit(1)).alias("c"), F.bool_or("repeats").alias("r"))
    several = saved(several.where("c > 1 OR r").select("hash"), f"{folder}/several")
    kept = saved(found.join(several, "hash", "left_semi"), f"{folder}/kept")
    distinct = saved(
        kept.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("times"),
            F.bool_or("repeats").alias("repeats"),
            F.min(F.struct("h1", "h2", "first", "n")).alias("one"),
        ),
        f"{folder}/distinct",
    )
    twice = distinct.where("times > 1").select(*keys)
    whole = kept.join(twice, keys, "left_semi").select("h1", "h2", "first", "n").distinct()

    kinds = distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least"), F.bool_or("repeats").alias("again"))
    open_kinds = saved(
        kinds.where("least = 1 AND (kinds > 1 OR again)").select("hash", (F.col("kinds") > CROWD).alias("crowded")),
        f"{folder}/open",
    )
    wanted = (
        distinct.join(open_kinds, "hash")
        .groupBy(F.col("one.h1").alias("h1"), F.col("one.h2").alias("h2"))
        .agg(
            F.collect_list(
                F.struct("hash", "one.first", "one.n", F.least("times", F.lit(2)).cast("int").alias("times"), "crowded")
            ).alias("wanted")
        )
    )
    wanted = saved(wanted, f"{folder}/wanted")
    once = texts.groupBy("h1", "h2").agg(F.any_value("text").alias("text"))
    parts = saved(
        once.join(wanted, ["h1", "h2"]).mapInPandas(
            _with_bytes, "hash long, h1 long, h2 long, first long, times int, crowded boolean, bytes binary"
        ),
        f"{folder}/parts",
    )
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.where("NOT crowded")
    dealt = dealt.repartition(max(least, -(-dealt.count() // (2 * BATCH))), "hash")
    sorted_runs = dealt.sortWithinPartitions("hash").mapInPandas(_sort_batches, RUNS)

    windows = parts.where("crowded").mapInPandas(
        _each_window, "w1 long, w2 long, h1 long, h2 long, first long, times int"
    )
    windows = saved(windows, f"{folder}/windows")
    equal = windows.groupBy("w1", "w2").agg(F.sum("times").alias("c")).where("c > 1").select("w1", "w2")
    crowded_runs = windows.where("times = 1").join(equal, ["w1", "w2"], "left_semi").select(
        "h1", "h2", "first", F.lit(1).alias("n")
    )
    return whole.union(sorted_runs).union(crowded_runs)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every document."""
    folder = working_folder(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    keyed = docs.select(
        F.col(id_column),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(LENGTH), text).alias("h2"),
        text.alias("text"),
    )
    texts = keyed.select("h1", "h2", "text")
    runs = repeated_runs(texts, folder)
    of_text = saved(
        runs.groupBy("h1", "h2").agg(F.collect_list(F.struct("first", "n")).alias("runs")), f"{folder}/runs"
    )
    once = texts.groupBy("h1", "h2").agg(F.any_value("text").alias("text"))
    cuts = saved(
        once.join(of_text, ["h1", "h2"], "left").mapInPandas(_cuts, CUTS), f"{folder}/cuts"
    )
    return keyed.drop("text").join(cuts, ["h1", "h2"]).drop("h1", "h2")
