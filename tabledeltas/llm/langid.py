"""Language labels for spans of mixed-language text.

Each letter is scored by the trigram around it (word ends count as a blank), under one smoothed
trigram distribution per language. The script a word starts in narrows its candidates to the
languages that write a noticeable share of their letters in it. A Viterbi pass over the scores
of the words, with a penalty for every switch, labels spans; the language with most letters
labels the text.

Neighbouring words that rank the languages alike are merged before the pass. That loses
nothing: of a switch between them, one a word earlier or later scores no less. The pass is left
out where no other language gains half a penalty anywhere over the best one: no path could pay
for its switches then.

* The model is learned from at most ``per_language`` distinct texts of each language (in
  expectation; chosen by a hash of the text). Counting is done by Spark. The driver gets, and
  sends out, what the trigrams met take; a column of labels so varied that this is more than
  ``MODEL_BYTES`` is refused with an error before anything is collected.
* A text that is null or has no letter is labelled ``und`` with score 0 and no span, as is
  every text if nothing was learned. A text in a script no language uses gets the first
  learned language, with score 0.
* Equal texts get equal labels. Texts of any length are labelled whole. Ties go to the
  language that sorts first. Further columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledeltas.llm.common import saved, working_folder

PER_LANGUAGE = 3000
UNKNOWN = "und"
SLOTS = 1 << 18
#: Log units that a switch of language costs.
SWITCH = 12.0
#: What a language outside a word's candidates loses on it.
OUTSIDE = 40.0
#: Share of a language's letters in a script from which it is a candidate there.
SHARE = 0.01
#: What the counts, and the model made of them, may take.
MODEL_BYTES = 256 * 1024 * 1024
#: Code points scored at once.
PIECE = 1 << 19

# First code points of Unicode blocks, and the script of the letters from there on.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"),
    (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF61, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, and which script it belongs to."""
    is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, dtype=np.uint8)
    for start, name in SCRIPT_STARTS:
        script[start:] = SCRIPTS.index(name)
    return is_letter, script


@dataclass
class Model:
    """Trigram scores ``[place, language]``, centred over the languages, the languages that are
    candidates in a script ``[script, language]``, and the place of each slot's scores: 0, a row
    of zeros, for those not met in training."""

    languages: list[str] = field(default_factory=list)
    scores: np.ndarray | None = None
    candidates: np.ndarray | None = None
    place: np.ndarray | None = None

    @property
    def learned(self) -> bool:
        """Whether there is anything to judge a text by."""
        return self.place is not None and bool(self.place.any())


def _lower(text: str) -> str:
    """Lower case, code point by code point where the plain one would change the length."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the letters, their code points and the slots of their trigrams."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[0][points]
    points = np.where(letter, points, np.uint32(32))
    at = np.flatnonzero(letter)
    own = points[at]
    slot = points[at - 1] * np.uint32(0x9E3779B1)
    slot ^= own * np.uint32(0x85EBCA6B)
    slot ^= points[at + 1] * np.uint32(0xC2B2AE35)
    slot ^= slot >> np.uint32(15)
    slot *= np.uint32(0x2C1B3C6D)
    return at - 1, own, slot >> np.uint32(32 - 18)


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """The text in pieces of bounded length, cut at a blank where there is one."""
    start = 0
    while len(text) - start > PIECE:
        cut = text.rfind(" ", start + PIECE // 2, start + PIECE)
        cut = start + PIECE if cut < 0 else cut
        yield start, text[start:cut]
        start = cut
    yield start, text[start:]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from the ``text`` and ``lang`` of labelled rows."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    rows = dict(known.groupBy("lang").count().collect())  # one row per language
    languages = sorted(rows)
    if not languages:
        return Model()
    folder = working_folder(docs.sparkSession)
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(
        F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, per_language / rows[l]))]),
        F.col("lang"),
    )
    sample = (
        known.where(place < share)
        .groupBy("lang", F.sha1("text").alias("same"))
        .agg(F.any_value("text").alias("text"))
        .select("lang", "text")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, script = _letters()
        sums = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                if lang not in sums:
                    sums[lang] = np.zeros(SLOTS + len(SCRIPTS), dtype=np.int64)
                for _, piece in _pieces(_lower(text)):
                    _, own, slots = _grams(piece)
                    sums[lang][:SLOTS] += np.bincount(slots, minlength=SLOTS)
                    sums[lang][SLOTS:] += np.bincount(script[own], minlength=len(SCRIPTS))
        for lang, n in sums.items():
            slot = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "slot": slot, "n": n[slot]})

    counted = (
        sample.mapInPandas(count, "lang string, slot long, n long")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
    )
    counted = saved(counted, f"{folder}/counted")
    of_counts, met = counted.agg(F.count(F.lit(1)), F.count_distinct("slot")).first()
    needed = max(of_counts * 24, met * len(languages) * 8)
    if needed > MODEL_BYTES:
        raise ValueError(
            f"{len(languages)} languages need a model of {needed} bytes, more than {MODEL_BYTES}: "
            "is the language column one?"
        )
    counted = counted.toPandas()
    column = counted["lang"].map({l: i for i, l in enumerate(languages)}).to_numpy(np.int64)
    slot = counted["slot"].to_numpy(np.int64)
    of_script = slot >= SLOTS
    in_script = np.zeros((len(SCRIPTS), len(languages)))
    in_script[slot[of_script] - SLOTS, column[of_script]] = counted["n"][of_script]
    seen, at = np.unique(slot[~of_script], return_inverse=True)
    grams = np.zeros((len(seen), len(languages)))
    grams[at, column[~of_script]] = counted["n"][~of_script]
    scores = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * max(1, len(seen))))
    scores -= scores.mean(axis=1, keepdims=True)
    scores = np.vstack([np.zeros((1, len(languages))), scores]).astype(np.float32)
    of_slot = np.zeros(SLOTS, dtype=np.int32)
    of_slot[seen] = np.arange(1, len(seen) + 1)
    shares = in_script / np.maximum(1, in_script.sum(axis=0))
    return Model(languages, scores, shares >= SHARE, of_slot)


def _words(text: str, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First letter, letters and score per language of each word of a piece, and whether it is
    evidence: of a script that a language uses, and with a trigram met in training or in a
    script that not all languages use. Scores do not tell: those of a single language are 0."""
    at, own, slots = _grams(text)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    places = model.place[slots]
    score = np.add.reduceat(model.scores[places], first, axis=0) if len(first) else np.zeros((0, len(model.languages)), np.float32)
    of_word = model.candidates[_letters()[1][own[first]]]
    score -= OUTSIDE * (~of_word)
    score[~of_word.any(axis=1)] = 0
    met = np.logical_or.reduceat(places > 0, first) if len(first) else np.zeros(0, bool)
    evident = of_word.any(axis=1) & (met | ~of_word.all(axis=1))
    return at[first], np.diff(first, append=len(at)), score, evident


def _viterbi(scores: list[list[float]], penalty: float) -> list[int]:
    """The best path through the runs; staying and lower numbers win ties."""
    value, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(value)
        lead = value.index(top)
        come = [j if v >= top - penalty else lead for j, v in enumerate(value)]
        value = [max(v, top - penalty) + s for v, s in zip(value, row)]
        back.append(come)
    path = [value.index(max(value))]
    for come in reversed(back):
        path.append(come[path[-1]])
    return path[::-1]


def _path(score: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """First words of the runs of a text, and the number of the language of each run."""
    top = int(score.sum(axis=0).argmax())
    ahead = np.cumsum(score - score[:, top : top + 1], axis=0, dtype=np.float64)
    lowest = np.minimum.accumulate(np.vstack([np.zeros((1, score.shape[1])), ahead]), axis=0)
    if (ahead - lowest[:-1]).max() <= penalty / 2:
        return np.zeros(1, dtype=np.int64), np.array([top])
    rank = np.argsort(-score, axis=1, kind="stable")
    first = np.append(0, np.flatnonzero((rank[1:] != rank[:-1]).any(axis=1)) + 1)
    path = np.array(_viterbi(np.add.reduceat(score, first, axis=0).tolist(), penalty))
    changes = np.append(True, path[1:] != path[:-1])
    return first[changes], path[changes]


def _labelled(parts: list[tuple], model: Model, penalty: float) -> tuple:
    at, size, score, evidence = (np.concatenate(x) for x in zip(*parts))
    first, path = _path(score, penalty)
    letters = np.bincount(path, np.add.reduceat(size, first), len(model.languages))
    evident = np.add.reduceat(size * evidence, first)
    top = int(letters.argmax())
    return (
        model.languages[top],
        float(evident[path == top].sum() / size.sum()),
        at[first].tolist(),
        (at + size)[np.append(first[1:], len(at)) - 1].tolist(),
        [model.languages[l] for l in path],
        float(evident.sum() / size.sum()),
    )


def _label_all(texts: list[str | None], model: Model, penalty: float) -> list[tuple]:
    """``(language, score, starts, ends, languages of spans)`` of each text."""
    return [found[:-1] for found in _judge_all(texts, model, penalty)]


def _judge_all(texts: list[str | None], model: Model, penalty: float) -> list[tuple]:
    """The label of each text and, last, the share of its letters that give evidence."""
    nothing = (UNKNOWN, 0.0, [], [], [], 0.0)
    out: list[tuple] = [nothing] * len(texts)
    if not model.languages:
        return out
    parts: dict[int, list[tuple]] = {}

    def flush(pieces: list[tuple[int, int, str, bool]]) -> None:
        lengths = np.array([len(p) + 1 for _, _, p, _ in pieces])
        starts = np.cumsum(lengths) - lengths
        at, size, score, evidence = _words("\n".join(p for _, _, p, _ in pieces), model)
        bounds = np.searchsorted(at, np.append(starts, lengths.sum()))
        for (i, begin, _, ends), start, lo, hi in zip(pieces, starts, bounds, bounds[1:]):
            if lo < hi:
                part = (at[lo:hi] - start + begin, size[lo:hi], score[lo:hi], evidence[lo:hi])
                parts.setdefault(i, []).append(part)
            if ends and i in parts:
                out[i] = _labelled(parts.pop(i), model, penalty)

    waiting, length = [], 0
    for i, text in enumerate(texts):
        low = _lower(text or "")
        for start, piece in _pieces(low):
            waiting.append((i, start, piece, start + len(piece) == len(low)))
            length += len(piece)
            if length >= PIECE:
                flush(waiting)
                waiting, length = [], 0
    if waiting:
        flush(waiting)
    return out


LABEL = (
    "lang_pred string, score double, starts array<int>, ends array<int>, langs array<string>,"
    " evident double"
)


def label(model: Model, spark, text_column: str = "text", penalty: float = SWITCH) -> Column:
    """A struct per text: ``lang_pred``, ``score`` (the share of its letters that lie in its
    spans and give evidence), the spans (``starts``, ``ends`` in code points, ``langs``) and
    ``evident`` (the share of its letters that give evidence in spans of any language)."""
    shared = spark.sparkContext.broadcast(model)  # at most MODEL_BYTES, whatever the input

    @F.pandas_udf(LABEL)
    def labelled(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = _judge_all(batch.tolist(), shared.value, penalty)
            yield pd.DataFrame(found, columns=["lang_pred", "score", "starts", "ends", "langs", "evident"])

    return labelled(F.col(text_column))


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row is kept from training: a quarter of the ids; a null id is not held out."""
    remainder = F.crc32(F.col(id_column).cast("string")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


def train_apart(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows with an id that are not held out."""
    return train(docs.where(F.col("doc_id").isNotNull() & ~held_out()), per_language)
