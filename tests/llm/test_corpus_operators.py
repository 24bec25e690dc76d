"""Odd tables through every operator, and the parts that need a closer look."""

import collections
import glob
import hashlib
import http.client
import io
import itertools
import random
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabledeltas.llm import (
    components,
    decontaminate,
    html,
    langid,
    mixing,
    quality,
    sharding,
    simhash,
    suffixes,
    topk,
    warc,
)
from tabledeltas.llm.common import saved, working_folder
from tabledeltas.llm.queries import ORACLE, QUERIES


def plain(df):
    return collections.Counter(tuple(r) for r in df.collect())


# 1. main text

STORY = "A long paragraph of the story, with so many words that it clearly is the text itself. " * 2
ONE = STORY.strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<!-- open", ""),
        ("<script>var a = '<p>'; </p>", ""),
        ("a < b &amp; c", "a < b & c"),
        ("<p>Hi <b>you</b>!<br>there</p>\n<p> </p>", "Hi you! there"),
        (f"<nav><p>{STORY}{STORY}</nav><article><h1>T</h1><p><b>{STORY}<p>x</article>", f"T\n{ONE}\nx"),
        (
            f"<body><div id=header>Site</div><ul class=menu><li><a>A</a></ul><div class=content>"
            f"<h1>T</h1><p>{STORY}<div class='share'>Share</div><p>s&nbsp;&lt;<p>{STORY}</div>"
            f"<div class=sidebar><p>{STORY}</div><ol id=comments><li>{STORY}{STORY}</ol>",
            f"T\n{ONE}\ns <\n{ONE}",
        ),
        (
            f"<main><article><p>{STORY}<form>f</form><article><p>{STORY}a comment</article>"
            f"<footer>by</footer></article></main><div class='cookie-notice'>{STORY}</div>",
            ONE,
        ),
        (
            f"<ul><li><a>Home</a></ul><div><h2>T</h2><p>{STORY}<p>short<p>{STORY}</div>"
            "<ul><li><a>Imprint</a></ul><p>&copy; 2020",
            f"T\n{ONE}\nshort\n{ONE}",
        ),
        (f"<aside>{STORY}</aside><article>Brief.</article>", "Brief."),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("holder", ["article", "main", "div class=content"])
@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ('<h2 id="related-work">Related</h2>', "Related"),
        ('<h2 id="search-algorithms">Search</h2><h3 class="menu" id="social-history">S</h3>', "Search\nS"),
        ('<h2><span class="mw-headline" id="Navigation">Navigation</span></h2>', "Navigation"),
        (f'<section id="notice-period"><h2>N</h2><p>{STORY}<p>x</section>', f"N\n{ONE}\nx"),
        (f'<div id="social-history"><p>{STORY}</div><p id="search">s</p>', f"{ONE}\ns"),
        ('<pre><code>a <span class="hljs-comment"># b</span> <span class="token comment"># c</span></code></pre>', "a # b # c"),
        ("<header><h1>Head</h1></header>", "Head"),
        ('<div class="related"><p>See also</div>', ""),
        (f'<div class="related-posts"><a href=x>{STORY}</a></div>', ""),
        (f'<div class="comment-list"><p>{STORY}</div><div id="comments"><p>{STORY}</div>', ""),
        (f'<div class="advert"><p>{STORY}</div>', ""),
    ],
)
def test_names_of_article_parts_do_not_drop_them(holder, inner, text):
    page = f"<nav>Menu</nav><{holder}><p>{STORY}</p>{inner}<p>{STORY}</p></{holder.split()[0]}>"
    assert html.main_text(page) == "\n".join(x for x in (ONE, text, ONE) if x)


def test_heading_ids_without_a_content_element():
    page = f'<div><h2 id="related-work">R</h2><p>{STORY}<section id="notice-period"><p>{STORY}</section></div>'
    assert html.main_text(page) == f"R\n{ONE}\n{ONE}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (
            f"<body><div class=content><p>{STORY}</div><div class=ad>Buy</div>"
            f"<div class=content><p>{STORY}<p>end</div><div class=footer>{STORY}</div>",
            f"{ONE}\n{ONE}\nend",
        ),
        (f"<article><h1>T</h1><p>{STORY}</article><nav>N</nav><article><p>{STORY}</article>", f"T\n{ONE}\n{ONE}"),
        (f"<div><p>{STORY}</div><div class=ad>Buy</div><div><p>{STORY}</div>", f"{ONE}\n{ONE}"),
        (f"<div><p>{STORY}<p>{STORY}<div class=ad>Buy</div><p>The end.</div>", f"{ONE}\n{ONE}\nThe end."),
        (f"<div class=content><p>{STORY}</div><div class=ad>Buy</div><div><p>{STORY}</div>", f"{ONE}\n{ONE}"),
    ],
)
def test_text_in_several_containers(page, text):
    assert html.main_text(page) == text


HALF = "Another part of the same text, which is a good deal shorter than the other one, but belongs to it all the same."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><p>{STORY * 4}</div><div class=ad>Buy</div><div><p>{HALF}</div>", f"{(STORY * 4).strip()}\n{HALF}"),
        (
            f'<div class="elementor-widget elementor-widget-text-editor"><p>{STORY}</div>'
            f'<div class="elementor-widget"><p>{HALF}</div>',
            f"{ONE}\n{HALF}",
        ),
        (f'<div class="with-notice-bar page"><div class="share-layout"><p>{STORY}</div></div>', ONE),
        (f'<div class="reply-content"><p>{STORY}</div>', ONE),
        (
            f'<form id="aspnetForm"><input><div class="content"><p>{STORY}</div><label>Name</label>'
            "<select><option>x</select><button>Go</button></form>",
            ONE,
        ),
        (f'<div class="page-header-layout"><h1>T</h1><p>{STORY}</div>', f"T\n{ONE}"),
        (f"<form><p>Search {HALF}</form><div class=content><p>{STORY}</div>", ONE),
        (f'<div class="widget"><p>{STORY}{STORY}</div><article><p>{STORY}</article>', ONE),
        (f'<p>Brief.</p><div class="comments"><p>{STORY}</div>', "Brief."),
    ],
)
def test_words_that_say_nothing_on_a_page(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<main><ul class="top"><li><a>Home</a><li><a>News</a><li><a>Sport</a></ul><p>{STORY}</main>', ONE),
        (f"<main><ul><li><a>Home</a><li><a>News</a></ul><p>{STORY}<p>end</main>", f"{ONE}\nend"),
        (
            f'<div id="content"><div class=post><h1>T</h1><p>{STORY}</div><div class="archive"><h3>Archives</h3>'
            "<ul><li><a>January</a><li><a>February</a><li><a>March</a></ul></div></div>",
            f"T\n{ONE}",
        ),
        (f"<article><p>{STORY}<p><a>A link</a><p>{STORY}<ul><li>one<li>two</ul></article>", f"{ONE}\nA link\n{ONE}\none\ntwo"),
        ("<article><p><a>Read on</a></article>", "Read on"),
        (
            f"<main><ul><li>See <a>b</a><li>{HALF}<li><a>c</a></ul><p>{STORY}</main>",
            f"See b\n{HALF}\nc\n{ONE}",
        ),
    ],
)
def test_menus_in_content_elements(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<p it's>{STORY}", ONE),
        (f"<p><a title=Don't>l</a> {STORY}it's", f"l {ONE} it's"),
        (f'<p><img alt="x""> {STORY}', ONE),
        (f"<p class=a\"b' id='c'd>{STORY}<br/>x", f"{ONE} x"),
        (f'<p title = "a > b">{STORY}</p >', ONE),
        (f"<p>{STORY}<a <b>c</b>", f"{ONE} c"),
        (f'<p>{STORY}<a href="x', ONE),
        ("<p>1 < 2 <3 </ x", "1 < 2 <3 </ x"),
    ],
)
def test_broken_tags(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        '<a x="' * 160_000,
        '<a x="' * 160_000 + ">",
        '<a b=">" ' * 100_000,
        "<a x='\">" * 100_000,
        "<div>" * 150_000 + STORY,
        "<div>" * 80_000 + "</span>" * 60_000,
        "<b><p>" * 120_000,
        "<article>" + "<div class=related>x " * 45_000,
        '<div class="advert">x' * 45_000,
        "<div><a>" * 60_000 + "</a>" * 60_000,
        "<" * 1_000_000,
        "<a " + " " * 1_000_000,
    ],
)
def test_time_grows_with_the_length_only(page):
    """Twice the page takes about twice the time: quadratic work would be seconds to minutes."""
    times = []
    for part in (page[: len(page) // 2], page):
        start = time.process_time()
        html.main_text(part)
        times.append(time.process_time() - start)
    assert times[1] < 3 * times[0] + 1


def blog(title, paragraphs, comments):
    """A second template: boxes with words of their own, no content element by name."""
    menu = "".join(f"<li class=nav-item><a href=/{i}>Topic {i}</a>" for i in range(9))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    said = "".join(f"<li class=comment><p>{c}</p>" for c in comments)
    return (
        f"<html><head><title>{title}</title><style>p{{}}</style></head><body><div id=masthead><a>Site</a></div>"
        f"<div class=site-nav><ul>{menu}</ul></div><div id=wrap><div class=text><h1>{title}</h1>{body}</div>"
        f"<div class=share-buttons><a>Tweet</a></div></div><div class=sidebar><h3>About</h3><p>{HALF}</p></div>"
        f"<ol class=comment-list>{said}</ol><form><input><p>Leave a reply</p></form>"
        "<div class=site-footer><p>&copy; 2020 Site</div>"
    )


def shop(title, paragraphs, comments):
    """A third one: old table markup in one form, upper case, nothing closed."""
    body = "<P>".join(paragraphs)
    said = "<P>".join(comments)
    return (
        f"<FORM ID=f><TABLE><TR><TD CLASS=menu><A HREF=a>Home</A><BR><A HREF=b>Buy</A><TD CLASS=content>"
        f"<H2>{title}</H2><P>{body}<DIV CLASS=advert>{HALF}</DIV><P>Last.<TD CLASS=sidebar><P>{HALF}</TABLE>"
        f"<DIV ID=comments><P>{said}</DIV></FORM>"
    )


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("template", [blog, shop])
def test_other_templates(template, seed):
    rng = random.Random(seed)
    words = STORY.split()

    def sentence(n):
        return " ".join(rng.choice(words) for _ in range(n))

    paragraphs = [sentence(rng.choice([4, 12, 60])) for _ in range(rng.randint(2, 30))] + [sentence(40)]
    comments = [sentence(rng.choice([3, 30])) for _ in range(rng.randint(0, 40))]
    found = html.main_text(template("The title", paragraphs, comments)).split("\n")
    assert found == ["The title", *paragraphs, *(["Last."] if template is shop else [])]


def test_odd_pages_through_spark(spark):
    """Nulls, repeated rows, a very long page, clashing columns; and an empty table."""
    long = f"<article>{f'<p>{STORY}' * 20_000}"
    rows = [(1, None), (1, None), (2, f"<article><p>{STORY}"), (2, f"<article><p>{STORY}"), (None, ""), (3, long)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns(
        {"text": F.lit(1), "lines": F.lit(2), "extracted": F.lit(3)}
    )
    found = pages.select("page_id", F.md5(html.extract()).alias("t"))
    assert plain(found) == plain(
        spark.createDataFrame(
            [(i, hashlib.md5(t.encode()).hexdigest()) for i, t in
             [(1, ""), (1, ""), (2, ONE), (2, ONE), (None, ""), (3, "\n".join([ONE] * 20_000))]],
            "page_id long, t string",
        )
    )
    assert pages.where("false").select(html.extract()).count() == 0


def test_stretches_begin_at_a_surge_and_end_at_a_dive():
    assert html.stretches([5, 0, 0, 0, 100, 10, 0, 0, 0, 3]) == [(4, 5)]
    assert html.stretches([]) == []


# 2. language


@pytest.fixture(scope="module")
def model(spark, small):
    return langid.train(spark.read.parquet(f"{small}/documents.parquet"))


def test_spans_of_mixed_text(spark, model, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = {r["lang"]: r["text"][:400] for r in docs.where("doc_id IN (1, 3, 20)").collect()}
    mixed = " ".join(one[l] for l in ("en", "fr", "de"))
    found = langid._label_all([mixed, None, "", "12 !?", "булок"], model, langid.SWITCH)
    assert found[0][4] == ["en", "fr", "de"]
    for start, end, lang in zip(*found[0][2:]):
        assert abs(mixed.index(one[lang]) - start) < 40 and end <= len(mixed)
    assert [f[:2] for f in found[1:4]] == [("und", 0.0)] * 3
    assert found[4][0] in model.languages and found[4][1] == 0


def test_merged_runs_and_shortcut_lose_nothing():
    rng = np.random.default_rng(7)
    shortcuts = 0
    for n in range(1, 120):
        score = (rng.normal(size=(n, 3)) + rng.normal(size=3)) * rng.choice([0.5, 4])

        def value(path):
            return sum(r[p] for r, p in zip(score, path)) - 6 * sum(a != b for a, b in zip(path, path[1:]))

        first, langs = langid._path(score, 6.0)
        shortcuts += len(langs) == 1
        path = np.repeat(langs, np.diff(first, append=n)).tolist()
        assert np.isclose(value(path), value(langid._viterbi(score.tolist(), 6.0)))
    assert 0 < shortcuts < 119


def test_language_of_odd_tables(spark, model, odd_docs, no_docs):
    out = odd_docs.select("doc_id", langid.label(model, spark).alias("l")).select("doc_id", "l.*").collect()
    assert len(out) == 12
    assert {r["lang_pred"] for r in out} <= {*model.languages, "und"}
    assert no_docs.select(langid.label(model, spark)).count() == 0
    nothing = langid.train_apart(no_docs)
    assert odd_docs.select(langid.label(nothing, spark)["lang_pred"]).distinct().collect() == [("und",)]


def test_one_language_gives_evidence(spark):
    text = "The quick brown fox jumps over the lazy dog again"
    docs = spark.createDataFrame(
        [(i, f"{text} {i}", "en") for i in range(40)] + [(50, "булок ещё этих", None)],
        "doc_id long, text string, lang string",
    )
    model = langid.train_apart(docs)
    assert model.languages == ["en"]
    found = docs.select("doc_id", langid.label(model, spark).alias("l")).select("doc_id", "l.*").collect()
    assert {r["score"] for r in found if r["doc_id"] < 40} == {1.0}
    assert {r["lang_pred"] for r in found} == {"en"}
    assert [r["score"] for r in found if r["doc_id"] == 50] == [0.0]


def test_pieces_of_a_long_text(model, monkeypatch):
    text = "the fox and the dog of this story " * 300
    whole = langid._label_all([text], model, langid.SWITCH)
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert langid._label_all([text], model, langid.SWITCH)[0][:2] == whole[0][:2]


def test_a_column_of_too_many_languages_is_refused(spark, monkeypatch):
    docs = spark.range(400).select(F.concat(F.lit("some words of text "), "id").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    monkeypatch.setattr(langid, "MODEL_BYTES", 50_000)
    with pytest.raises(ValueError, match="400 languages need a model of"):
        langid.train(docs)


def best_by_all_paths(scores, penalty):
    """The greatest score of any path, by trying all."""
    n, k = len(scores), len(scores[0])
    return max(
        sum(scores[i][path[i]] for i in range(n)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        for path in itertools.product(range(k), repeat=n)
    )


@pytest.mark.parametrize("seed", range(40))
def test_viterbi_equals_all_paths(seed):
    """Also where neighbouring words are merged and where the pass is left out."""
    rng = random.Random(seed)
    n, k, penalty = rng.randint(1, 7), rng.randint(1, 3), rng.choice([0.5, 2.0, 12.0])
    scores = [[round(rng.gauss(0, rng.choice([0.1, 3, 10])), 2) for _ in range(k)] for _ in range(n)]
    first, path = langid._path(np.array(scores), penalty)
    labels = np.repeat(path, np.diff(np.append(first, n)))
    got = sum(s[l] for s, l in zip(scores, labels)) - penalty * (len(path) - 1)
    assert all(a != b for a, b in zip(path, path[1:]))
    assert got == pytest.approx(best_by_all_paths(scores, penalty), abs=1e-9)


# 3. top k


def test_top_k_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART", 8)
    monkeypatch.setattr(topk, "CHUNK", 4)
    monkeypatch.setattr(topk, "QUERY_BYTES", 200)
    monkeypatch.setattr(topk, "MERGE", 2)
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(40)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")]), (103, [float("inf")]), (None, [1.0]), (50, [])]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    found = collections.defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    valid = [(i, v) for i, v in rows if i is not None and i < 100]
    for q, v in valid:
        if q % 10 == 0:
            scores = [(i, int(sum(256 * a * 256 * b for a, b in zip(v, w)))) for i, w in valid if i != q]
            assert found[q] == sorted(scores, key=lambda x: (-x[1], x[0]))[:5]
    assert topk.search(df.where("false"), F.lit(True), k=5).count() == 0


def test_scores_beyond_64_bits_fail(spark):
    rows = [(0, [1e9, 1e9]), (1, [2e9, 1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.search(df, F.col("vec_id") == 0, k=1).collect()
    found = topk.search(df, F.col("vec_id") == 0, k=1, scale=1).collect()
    assert [r["score"] for r in found] == [3 * 10**18]


# 4. shards


def shards_of(df):
    rows = saved(df.withColumn("row", F.monotonically_increasing_id()), f"{working_folder(df.sparkSession)}/rows")
    return rows.join(sharding.assign(rows.select("row", "key")), "row").collect()


@pytest.mark.parametrize("n", [0, 1, 7, 50, 1000])
def test_shards_are_even_and_groups_whole(spark, n):
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.col("id") % 30).otherwise(F.col("id")).alias("key"))
    out = shards_of(df)
    sizes = collections.Counter(r["shard"] for r in out)
    assert sum(sizes.values()) == n
    assert max((sizes[s] for s in range(8)), default=0) - min(sizes[s] for s in range(8)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))


def test_a_group_of_a_third_is_split_no_more_than_needed(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, -1).when(F.col("id") < 1600, F.col("id") % 200 + 5000).otherwise(F.col("id")).alias("key")
    )
    shards = collections.defaultdict(set)
    for r in shards_of(df):
        shards[r["key"]].add(r["shard"])
    assert len(shards[-1]) <= 6
    assert sum(len(s) > 1 for k, s in shards.items() if k >= 0) <= 7


def test_fully_linked_groups_are_cut_once_a_shard_at_most(spark):
    """No row is without neighbours, so there is nothing to fill the shards up with."""
    df = spark.range(8000).select((F.col("id") % 1300).alias("key"))
    out = shards_of(df)
    groups = collections.defaultdict(set)
    for r in out:
        groups[r["key"]].add(r["shard"])
    assert sum(len(s) > 1 for s in groups.values()) <= 7
    assert set(collections.Counter(r["shard"] for r in out).values()) == {1000}


def test_propagation_leaves_no_group_split(spark):
    """Whole groups, within the slack, before the shares are made exact."""
    df = spark.range(8000).select(F.col("id").alias("row"), (F.col("id") % 1300).alias("key"))
    folder = working_folder(spark)
    moved = sharding.propagate(saved(df, f"{folder}/links"), [1050.0] * 8, folder)
    split = df.join(moved, "row").groupBy("key").agg(F.count_distinct("shard").alias("n")).where("n > 1")
    assert split.isEmpty()
    sizes = dict(moved.groupBy("shard").count().collect())
    assert sum(sizes.values()) == 8000 and max(sizes.values()) <= 1.1 * 1050


def test_shards_do_not_depend_on_the_splits_of_the_table(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.union(docs.where("doc_id % 9 = 0"))  # repeated rows, too
    found = []
    for n in (1, 7):
        docs.repartition(n).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        found.append(plain(QUERIES["op4_shards"](spark, f"{tmp_path}/{n}")))
    assert found[0] == found[1]


def test_shards_of_odd_tables(odd_docs, no_docs):
    rows = odd_docs.select(*sharding.facts(odd_docs))
    assert [r["size"] for r in rows.where("size = 1").collect()] == [1, 1, 1]
    assert len(shards_of(rows)) == 12
    assert shards_of(no_docs.select(*sharding.facts(no_docs))) == []


# 5. repeated strings


def test_column_wise_sorting_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        letters = rng.choice([b"a", b"ab", b"abc"])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 7))]
        length = rng.randint(1, 6)
        seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for t, marks in zip(texts, suffixes.repeated_windows(texts, length)):
            assert marks.tolist() == [seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)]


@pytest.mark.parametrize("batch", [1, 4096])
def test_repeats_of_odd_texts(spark, monkeypatch, batch):
    monkeypatch.setattr(suffixes, "BATCH", batch)
    monkeypatch.setattr(suffixes, "CROWD", batch)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, period = noise(260), noise(90)
    texts = [noise(300) + shared + noise(50), shared[:230] + noise(400), noise(10) + shared, "x" * 900]
    texts += [period * 7, noise(100) + period * 3, noise(199), "y" * 200, "y" * 199, "", None, noise(500)]
    texts += [texts[-1], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("hash", F.lit(1))
    found = {r["doc_id"]: r for r in suffixes.remove_repeats(df).collect()}
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    for i, t in enumerate(data):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        assert (found[i]["n_bytes"], found[i]["n_removed"]) == (len(t), gone.sum()), i
    assert len(found) == len(texts)


def test_repeats_of_odd_tables(odd_docs, no_docs):
    out = suffixes.remove_repeats(odd_docs).collect()
    assert len(out) == 12
    assert {r["doc_id"] for r in out if r["n_removed"] > 0} == {6, 7}
    assert suffixes.remove_repeats(no_docs).count() == 0


# 6. SimHash


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(2)
    for n, radius in ((1, 2), (50, 0), (400, 2), (400, 3)):
        centres = rng.integers(0, 1 << 63, n // 8 + 1, dtype=np.uint64)
        flips = np.uint64(1) << rng.integers(0, 64, (2, n)).astype(np.uint64)
        a = np.unique(rng.choice(centres, n) ^ flips[0] ^ flips[1])
        pairs = {(int(x), int(y)) for i, j in simhash.trie_links(a, None, radius) for x, y in zip(i, j)}
        wanted = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if (int(a[i]) ^ int(a[j])).bit_count() <= radius}
        assert pairs == wanted


def test_components_over_many_groups(spark, monkeypatch):
    """Small nodes: the upper trie, several groups and joins between them."""
    monkeypatch.setattr(simhash, "LEAF", 16)
    monkeypatch.setattr(simhash, "NODES", 1 << 20)
    rng = np.random.default_rng(4)
    base = np.append(rng.integers(0, 1 << 63, 60, dtype=np.uint64), np.uint64(5) << np.uint64(60))
    values = {int(b) for b in base}
    for b in base[-3:]:  # chains and a dense place below one prefix of 16 bits
        for _ in range(60):
            b = int(b) ^ (1 << int(rng.integers(0, 40)))
            values.add(b)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    fps = saved(fps, f"{working_folder(spark)}/fps")
    folder = working_folder(spark)
    roots = dict(map(tuple, components.components(simhash.near_links(fps), folder).collect()))
    forest = simhash.Forest(len(values))
    for i, a in enumerate(values):
        for j in range(i):
            if ((a ^ values[j]) & ((1 << 64) - 1)).bit_count() <= 2:
                forest.link(np.array([i]), np.array([j]))
    ours, theirs = collections.defaultdict(set), collections.defaultdict(set)
    for i, v in enumerate(values):
        ours[roots.get(v, v)].add(v)
        theirs[forest.label[i]].add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_near_duplicates_of_odd_tables(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    # 1 twice and 2 are alike, so are the five texts without words, and the two long ones
    assert ids == [(False, i) for i in (1, 3, 6, 8, 9)] + [(True, 0)]
    assert simhash.keep_one(no_docs).count() == 0


# 7. WARC


def through_http(response):
    """The body of a response as Python's own reader takes it."""

    class Socket:
        def makefile(self, *_):
            return io.BytesIO(response)

    found = http.client.HTTPResponse(Socket())
    found.begin()
    return found.read()


def test_filter_of_repeated_payloads(spark, monkeypatch):
    """No repeated digest is missed, few others pass, and the revisits are those of a plain join."""
    digests = spark.range(60_000).select("id", F.sha1(F.col("id").cast("string")).alias("digest"))
    repeated = digests.where("id % 3 = 0")
    monkeypatch.setattr(warc, "FILTER_WORDS", 1 << 9)
    passed = digests.where(warc._may_be_repeated(repeated, 20_000))
    assert passed.where("id % 3 = 0").count() == 20_000
    assert passed.where("id % 3 > 0").count() < 2_000
    monkeypatch.setattr(warc, "FILTER_BITS", 64)  # full: all payloads go through the join
    assert digests.where(warc._may_be_repeated(repeated, 20_000)).count() == 60_000

    html = F.repeat(F.lpad((F.col("id") % 700 * (F.col("id") % 3)).cast("string"), 4, "0"), 300)
    pages = spark.range(2_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    columns = ["page_id", "digest", "original.page_id"]
    plain = warc.resolve_revisits(pages).select(*columns).collect()
    monkeypatch.setattr(warc, "FILTER_BITS", 1 << 30)
    monkeypatch.setattr(warc, "BROADCAST_BYTES", -1)
    assert sorted(warc.resolve_revisits(pages).select(*columns).collect(), key=str) == sorted(plain, key=str)
    assert sum(r[2] is not None for r in plain) > 600


def test_chunks_of_payloads_that_look_like_chunks(spark):
    """Payloads with several marks, with what a chunk's head looks like, and marks at their ends."""
    mark = "WARC/1.1\r\n"
    payloads = [mark, mark * 3, f"a\r\n\r\n{mark}5\r\nWARC\r\n1a\r\n/1.1{mark}", f"é{mark}0\r\n\r\n{mark}", f"WARC/1.1{mark}/1.1"]
    pages = spark.createDataFrame(list(enumerate(payloads)), "page_id long, html string").withColumn("url", F.lit("u"))
    path = f"{working_folder(spark)}/archives"
    warc.write_archives(pages, path)
    found = {int(r["record_id"]): r for r in warc.read_archives(spark, path).collect()}
    assert [bytes(found[i]["payload"]).decode() for i in range(len(payloads))] == payloads
    assert all(r["intact"] for r in found.values())


@pytest.mark.parametrize("broadcast_bytes", [warc.BROADCAST_BYTES, -1])
def test_archives_of_odd_pages(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", broadcast_bytes)
    body = "é" * 600
    forged = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "z" * 1000
    rows = [
        (1, "http://a/ b\r\nWARC-Type: revisit", body),
        (7, "http://a/2", body),
        (7, "http://a/2", body),
        (None, None, body),
        (2, "u", None),
        (3, "u", ""),
        (4, "u", forged),
        (5, "u", forged),
        (6, "u", "\r\n\r\n"),
        (8, "u", "short"),
        (9, "u", "short"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    path = f"{working_folder(spark)}/archives"
    warc.write_archives(pages.repartition(2), path)
    records = warc.read_archives(spark, path).collect()
    assert len(records) == len(rows)
    got = collections.Counter(
        (r["record_id"], r["record_type"], r["refers_to"], r["n_bytes"], None if r["payload"] is None else bytes(r["payload"]).decode())
        for r in records
    )
    n = len(forged.encode())
    assert got == collections.Counter(
        [
            ("1", "revisit", "7", 1200, None),
            ("7", "response", None, 1200, body),
            ("7", "response", None, 1200, body),
            (None, "revisit", "7", 1200, None),
            ("2", "response", None, 0, ""),
            ("3", "response", None, 0, ""),
            ("4", "revisit", "5", n, None),
            ("5", "response", None, n, forged),
            ("6", "response", None, 4, "\r\n\r\n"),
            ("8", "response", None, 5, "short"),
            ("9", "response", None, 5, "short"),
        ]
    )
    assert all(r["intact"] for r in records if r["payload"] is not None)
    bodies = b"".join(Path(f).read_bytes() for f in glob.glob(f"{path}/part-*"))
    at = bodies.index(b"Transfer-Encoding: chunked\r\n\r\n")
    assert through_http(b"HTTP/1.1 200 OK\r\n" + bodies[at:]) == forged.encode()
    empty = f"{working_folder(spark)}/archives"
    warc.write_archives(pages.where("false"), empty)
    assert warc.read_archives(spark, empty).count() == 0


# 8. decontamination


def test_passages_with_changes(spark):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(400)]
    item, other = words[:60], words[60:90]
    noise = lambda n: [f"n{rng.randint(0, 9999)}" for _ in range(n)]
    texts = {
        1: noise(50) + item + noise(30),
        2: [w.upper() + ",!" for w in noise(3) + item],
        3: noise(20) + item[:30] + noise(1) + item[30:] + noise(20),  # one word put in
        4: noise(20) + item[:30] + noise(9),  # half of it
        5: noise(100),
        6: item[5:] + noise(4),
        7: item + noise(5) + other + item,
    }
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(8, None), (9, ""), (10, "a b")], "doc_id long, text string")
    items = spark.createDataFrame(
        [(1, " ".join(item)), (1, " ".join(item)), (2, " ".join(item)), (3, " ".join(other)), (4, None), (5, " ?"), (6, "a b"), (None, "A, b!")],
        "item_id long, text string",
    )
    found = decontaminate.find_passages(docs, items)
    pairs = docs.select("doc_id", F.md5("text").alias("text_key")).join(found, "text_key")
    ids = {(r["doc_id"], r["item_id"]) for r in pairs.collect()}
    assert ids == {(d, i) for d in (1, 2, 3, 6, 7) for i in (1, 2)} | {(7, 3), (10, 6), (10, None)}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()) == [4, 5, 8, 9]


def test_reordered_passages(spark):
    """Parts in another order, within a longer document and at its end; half of them is too little."""
    item = [f"w{i}" for i in range(60)]
    swapped = item[30:] + item[:30]
    noise = lambda a, n: [f"n{a}x{i}" for i in range(n)]
    texts = {
        1: noise(1, 100) + swapped + noise(2, 100),
        2: noise(3, 100) + swapped,
        3: swapped + noise(4, 100),
        4: noise(5, 100) + item[30:] + noise(6, 30) + item[:30] + noise(7, 100),
        5: noise(8, 40) + ["x"] + item[1:] + noise(9, 40),
    }
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = decontaminate.find_passages(docs, items)
    rows = docs.select("doc_id", F.md5("text").alias("text_key")).join(found, "text_key").collect()
    starts = {r["doc_id"]: r["word_start"] for r in rows}
    assert starts == {1: 100, 2: 100, 3: 0, 5: 40}
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == [4]


def similarity(a, b):
    """Of two word lists, by their weighted shingles."""

    def shingles(words):
        return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    x, y = shingles(a), shingles(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_passages_equal_all_windows(spark):
    """Passages with words changed, put in, left out or moved, against every window of every text."""
    rng = random.Random(21)
    items = {i: [f"v{rng.randint(0, 400)}" for _ in range(rng.randint(5, 60))] for i in range(8)}

    def altered(words):
        words, changes = list(words), rng.randint(0, 3)
        for _ in range(changes):
            at, kind = rng.randrange(len(words)), rng.randrange(4)
            if kind == 0:
                words[at] = "changed"
            elif kind == 1:
                words.insert(at, "added")
            elif kind == 2 and len(words) > 5:
                del words[at]
            else:
                words = words[at:] + words[:at]
        return words

    texts = {}
    for d in range(120):
        noise = [f"v{rng.randint(0, 400)}" for _ in range(rng.choice([0, 3, 80]))]
        cut = rng.randint(0, len(noise))
        texts[d] = noise[:cut] + altered(rng.choice(list(items.values()))) + noise[cut:]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    found = decontaminate.find_passages(docs, bench)
    pairs = docs.select("doc_id", F.md5("text").alias("text_key")).join(found, "text_key").collect()
    wanted = {}
    for d, words in texts.items():
        for i, item in items.items():
            starts = range(max(0, len(words) - len(item)) + 1)
            best = max(similarity(words[p : p + len(item)], item) for p in starts)
            if best >= 0.8:
                wanted[d, i] = best
    assert {(r["doc_id"], r["item_id"]) for r in pairs} == set(wanted) and 40 < len(wanted) < 110
    for r in pairs:
        assert r["similarity"] == pytest.approx(wanted[r["doc_id"], r["item_id"]])


def test_starts_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        n, m = rng.randint(1, 40), rng.randint(1, 20)
        shingles = max(1, n - 4)
        places = sorted(rng.sample(range(shingles), rng.randint(shingles // 2, shingles)) or [0])
        rows.append((str(i), n, m, places))
    df = spark.createDataFrame(rows, "text_key string, n int, m int, places array<int>")
    found = plain(decontaminate._starts(df, 0.8).select("text_key", "start"))
    wanted = collections.Counter()
    for key, n, m, places in rows:
        long, own = max(1, min(n, m) - 4), max(1, m - 4)
        for start in range(max(0, n - m) + 1):
            both = sum(start <= p < start + long for p in places)
            wanted[key, start] += both > 0 and 18 * both >= 8 * (long + own)
    assert found == +wanted


def test_decontamination_of_odd_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again"), (None, None)], "item_id long, text string")
    left = decontaminate.decontaminate(odd_docs, items)
    assert left.columns == odd_docs.columns
    assert left.count() == 9
    assert decontaminate.decontaminate(odd_docs, items.where("false")).count() == 12
    assert decontaminate.decontaminate(no_docs, items).count() == 0


def test_main_path_is_native(spark, odd_docs):
    plan = decontaminate.decontaminate(odd_docs, odd_docs.select(F.col("doc_id").alias("item_id"), "text"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


# 9. quality


def test_posteriors_shrink_sparse_sites(spark):
    rows = [(i, f"h{i % 4}", "p", 3.0 if i % 4 == 0 else -3.0) for i in range(400)] + [(400, "new", "q", 0.0)]
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, quality double")
    out = {r["doc_id"]: r for r in quality.posteriors(scored, "quality", 0.3, working_folder(spark)).collect()}
    assert out[0]["p_quality"] > out[400]["p_quality"] > out[1]["p_quality"]
    assert len(out) == 401


def test_labels_of_rows_not_fitted(spark, small):
    """Half of the labels are learned from; the other half is foretold."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    learned = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = quality.classify(docs, labels.where(learned), F.col("source"), F.col("lang"))
    rows = out.select("doc_id", "p_quality", "p_toxic").join(labels.where(~learned), "doc_id").collect()
    assert len(rows) > 50
    assert sum((r["p_quality"] >= 0.5) == bool(r["quality"]) for r in rows) >= 0.9 * len(rows)
    toxic = [r["p_toxic"] >= 0.5 for r in rows if r["toxic"]]
    assert sum(toxic) >= 0.6 * len(toxic) > 10
    assert not any(r["p_toxic"] >= 0.5 for r in rows if not r["toxic"])


def test_quality_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, None), (4, 0, 0), (None, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int"
    )
    for held in (labels, labels.where("false")):
        out = quality.classify(odd_docs, held, F.col("source"), F.col("lang")).collect()
        assert len(out) == 12
        assert all(0 < r["p_quality"] < 1 and 0 < r["p_toxic"] < 1 for r in out)
    assert quality.classify(no_docs, labels, F.col("source"), F.col("lang")).count() == 0


# 10. mixing


def test_targets_are_capped_and_shared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 985), ("d", 0)], "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # weights a 1, b 2, c 3, d 1, null 2; a, c and d are capped, the rest shares by weight
    assert (found["a"], found["c"], found["d"]) == (30.0, 15.0, 0.0)
    assert found["b"] == found[None] == (2000 - 45) / 2


def test_equal_rows_draw_for_themselves(spark):
    """A thousand equal rows at a rate of 2.83: most of them once more, not all or none."""
    row = (7, "one two", "en", "a", 1)
    other = [(i + 100, "word " * 5, "en", "b", 1) for i in range(3000)]
    docs = spark.createDataFrame([row] * 1000 + other, "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.withColumns({"_number": F.lit(1), "_twin": F.col("lang")})
    taken = []
    for parts in (1, 7):
        planned, names = mixing.plan_mix(docs.repartition(parts))
        rows = planned.select("doc_id", F.col(names["copies"]).alias("n"), F.col(names["target"]).alias("t")).collect()
        assert len(rows) == 4000
        taken.append(sorted((r["doc_id"], r["n"]) for r in rows))
        wanted = next(r["t"] for r in rows if r["doc_id"] == 7)
        assert abs(2 * sum(r["n"] for r in rows if r["doc_id"] == 7) - wanted) < 0.05 * wanted
    assert taken[0] == taken[1]


def test_mix_of_repeated_rows_equals_its_twin(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    more = docs.where("doc_id < 20").crossJoin(spark.range(40)).drop("id")
    docs.union(more).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1).write.parquet(f"{tmp_path}/one")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/one/*.parquet'")
    wanted = con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLE['op10_mix_to_weights']}) q")
    assert plain(QUERIES["op10_mix_to_weights"](spark, str(tmp_path))) == collections.Counter(wanted.fetchall())


def test_mix_of_odd_tables(odd_docs, no_docs):
    first, again = mixing.mix(odd_docs), mixing.mix(odd_docs)
    assert first.columns == odd_docs.columns
    assert plain(first) == plain(again)
    times = collections.Counter(r["doc_id"] for r in first.collect())
    assert all(n <= 3 for i, n in times.items() if i not in (1, None))
    assert mixing.mix(no_docs).count() == 0
