"""The Merkle manifest against one built row by row."""

import hashlib
import random

from pyspark.sql import functions as F

from tabledeltas.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, place):
    found = []
    for level in levels[:-1]:
        at = place ^ 1
        found.append((level[at] if at < len(level) else None, bool(place & 1)))
        place >>= 1
    return found


def brute(rows):
    """Per row: id, group, place, leaf, proof, subroot, root."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g])]) for g in names}
    top = levels_of([trees[g][-1][0] for g in names])
    out = []
    for i, g in enumerate(names):
        for place, (_, _, leaf, doc_id) in enumerate(sorted(groups[g])):
            proof = path(trees[g], place) + path(top, i)
            out.append((doc_id, g, place, leaf, tuple(proof), trees[g][-1][0], top[-1][0]))
    return out


def build(spark, rows, extra=()):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs = docs.withColumns({c: F.lit(c) for c in extra})
    leaf = merkle.digest(*[F.col(c) for c in FIELDS])
    return merkle.manifest(docs, leaf, F.col("doc_id"), F.col("lang"), {"doc_id": F.col("doc_id")})


def plain(found):
    return [
        (r["doc_id"], r["group"], r["place"], r["leaf"], tuple((s["hash"], s["left"]) for s in r["proof"]),
         r["subroot"], r["root"])
        for r in found.collect()
    ]


def order(rows):
    return sorted(rows, key=repr)


def check(spark, rows, **options):
    found = build(spark, rows, **options)
    assert order(plain(found)) == order(brute(rows))
    folded = found.select((merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"))
    assert all(r["ok"] for r in folded.collect())


def row(doc_id, lang, text="x"):
    return (doc_id, "s", lang, len(text or ""), text)


def test_two_tiers_and_a_lone_leaf(spark):
    """More leaves than a block has slots, an odd number of them, and groups of one and two."""
    ids = random.Random(1).sample(range(-5000, 5000), 777)
    rows = [row(i, "en", f"text {i}") for i in ids] + [row(1, "de"), row(5, "fr"), row(3, "fr")]
    check(spark, rows)


def test_ids_over_the_whole_range(spark):
    """Three levels of the directory and more: sparse ids, the least and the greatest one."""
    rng = random.Random(2)
    ids = {-(1 << 63), (1 << 63) - 1, 0, -1, 63, 64} | {rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)}
    check(spark, [row(i, "en" if i % 3 else "de") for i in ids])


def test_repeated_and_missing_ids(spark):
    """Ids on several rows, with equal and with different texts; rows without id, group or text."""
    rows = [row(i % 7, "en", f"{i % 5}") for i in range(300)]
    rows += [row(i, "en") for i in range(100, 140)]
    rows += [row(None, "en", str(i)) for i in range(9)] + [row(None, None, None)] * 3
    rows += [row(2, None, ""), row(2, "", None), (2, None, "ü", None, "long " * 50_000)]
    check(spark, rows)


def test_clashing_columns(spark):
    names = ["g", "id", "leaf", "kept", "row", "word", "place", "slot", "hash", "levels", "proof", "root", "group"]
    check(spark, [row(i, "en") for i in range(5)], extra=names)


def test_one_row_and_none(spark):
    check(spark, [row(1, "en")])
    assert build(spark, []).count() == 0


def test_tampering_is_seen(spark):
    found = build(spark, [row(i, "en", str(i)) for i in range(20)]).collect()
    altered = spark.createDataFrame(
        [(r["root"], leaf_of((r["doc_id"], "s", "en", 99, "?")), r["proof"]) for r in found],
        "root string, leaf string, proof array<struct<hash:string,left:boolean>>",
    )
    assert altered.where(merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).isEmpty()
