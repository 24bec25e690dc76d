"""Registered queries against their twins, and what must hold of the others."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import oracle_check
from tabledeltas.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_twin(spark, small, name):
    rows, difference = oracle_check.compare(
        spark, oracle_check.connect(small), QUERIES[name], ORACLE[name], small
    )
    assert difference is None
    assert rows > 0


@pytest.fixture(scope="module")
def documents(small):
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{small}/documents.parquet'").fetchall()


def by_id(df):
    rows = {r["doc_id"]: r for r in df.collect()}
    assert len(rows) == df.count()
    return rows


def test_op1_takes_the_article(spark, small):
    """Whole pages of one template: the article is what lies between its tags."""
    import html as h

    pages = duckdb.sql(f"SELECT page_id, html FROM '{small}/pages.parquet'").fetchall()
    found = {r["page_id"]: r for r in QUERIES["op1_main_text"](spark, small).collect()}
    assert len(found) == len(pages)
    for page_id, page in pages:
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = re.split(r"</?(?:h1|p)>", re.sub("<br>|</?b>", " ", inner))
        wanted = "\n".join(x for x in (" ".join(h.unescape(b).split()) for b in blocks) if x)
        assert found[page_id]["text"] == wanted
        assert found[page_id]["n_chars"] == len(wanted)


def test_op2_labels_held_out_documents(spark, small, documents):
    found = by_id(QUERIES["op2_language"](spark, small))
    held = [(i, lang) for i, _, lang in documents if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in found.items() if r["held_out"]} == {i for i, _ in held}
    right = sum(found[i]["lang_pred"] == lang for i, lang in held)
    assert right >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_op2_scores_a_table_of_one_language(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("lang = 'en'")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op2_language"](spark, str(tmp_path)).where("n_spans > 0").collect()
    assert {r["lang_pred"] for r in found} == {"en"}
    assert sum(r["score"] >= 0.9 for r in found) >= 0.97 * len(found) > 0


def test_op4_counts_slots_and_groups(spark, small, documents):
    found = by_id(QUERIES["op4_shards"](spark, small))
    shards, groups = collections.defaultdict(list), collections.defaultdict(set)
    for i, text, _ in documents:
        row, data = found[i], (text or "").encode()
        assert (row["size"], row["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert (row["law"], row["grown_shard"]) == ("rows", None)
        shards[row["shard"]].append(row["slot"])
        groups[text].add(row["shard"])
    assert sorted(shards) == list(range(8))
    sizes = [len(s) for s in shards.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert sum(len(g) > 1 for g in groups.values()) <= 1


def test_op5_equals_brute_force(spark, small, documents):
    found = by_id(QUERIES["op5_repeats"](spark, small))
    texts = [(text or "").encode() for _, text, _ in documents]
    seen = collections.Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    for (i, *_), t in zip(documents, texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        row = found[i]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(t), gone.sum(), spans)
        assert row["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op6_equals_brute_force(spark, tiny):
    documents = duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall()
    found = by_id(QUERIES["op6_simhash"](spark, tiny))
    prints = {i: brute_print(t) for i, t in documents}
    root = {i: i for i in prints}
    for _ in prints:
        before = dict(root)
        for a in prints:
            root[a] = min(root[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2)
        if root == before:
            break
    for i in prints:
        assert found[i]["fingerprint"] == f"{prints[i]:016x}"
        assert found[i]["component_id"] == root[i]


def test_op8_finds_every_verbatim_item(spark, small, documents):
    items = duckdb.sql(f"SELECT item_id, text FROM '{small}/benchmark.parquet'").fetchall()
    found = {(r["doc_id"], r["item_id"]): r for r in QUERIES["op8_decontaminate"](spark, small).collect()}

    def words(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    for d, text, _ in documents:
        have = words(text)
        places = collections.defaultdict(list)
        for p in range(len(have)):
            places[tuple(have[p : p + 5])].append(p)
        for i, item in items:
            wanted = words(item)
            at = [p for p in places[tuple(wanted[:5])] if have[p : p + len(wanted)] == wanted]
            if at:
                assert found.pop((d, i))["word_start"] in at
    assert all(r["similarity"] >= 0.8 for r in found.values())
    assert len(found) <= 2


def test_op9_learns_the_labels(spark, small):
    rows = QUERIES["op9_quality"](spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    found = rows.join(labels, "doc_id").collect()
    assert rows.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(0 <= r["p_quality"] <= 1 and 0 <= r["p_toxic"] <= 1 for r in found)
    assert sum((r["p_quality"] >= 0.5) == bool(r["quality"]) for r in found) >= 0.95 * len(found)
    assert sum((r["p_toxic"] >= 0.5) == bool(r["toxic"]) for r in found) >= 0.9 * len(found)
