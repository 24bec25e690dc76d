"""The registered queries of the operators, and their twins in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledeltas.llm import (
    decontaminate,
    forest,
    html,
    langid,
    merkle,
    mixing,
    quality,
    sharding,
    simhash,
    spelling,
    suffixes,
    topk,
    warc,
)
from tabledeltas.llm.common import saved, table, working_folder

Query = Callable[[SparkSession, str], DataFrame]


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", html.extract().alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train_apart(docs)
    found = docs.select("doc_id", langid.held_out().alias("held_out"), langid.label(model, spark).alias("l"))
    return found.select(
        "doc_id",
        "held_out",
        F.col("l.lang_pred").alias("lang_pred"),
        F.col("l.score").alias("score"),
        F.size("l.langs").alias("n_spans"),
    )


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, F.col("vec_id") % 50 == 0, k=5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = working_folder(spark)
    facts = docs.select("doc_id", *sharding.facts(docs))
    known_by = [F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.col("key")]
    rows = saved(sharding.ranked(facts, known_by, f"{folder}/ranked"), f"{folder}/rows")
    placed = sharding.assign(rows.select("row", "key"))
    return rows.join(placed, "row").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grouped = simhash.group_rows(simhash.with_row(docs))
    return grouped.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = f"{working_folder(spark)}/archives"
    warc.write_archives(table(spark, sf_dir, "pages"), archives)
    records = warc.read_archives(spark, archives)
    return records.select(
        F.col("record_id").cast("long").alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000
                 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN coalesce(last, page_id) IS NOT DISTINCT FROM page_id
            THEN 'response' ELSE 'revisit' END AS record_type,
       nullif(last, page_id) AS refers_to
FROM m
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.md5("text").alias("text_key")).join(found, "text_key").drop("text_key")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no address: the source stands for the host, its languages for paths."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.classify(docs, labels, F.col("source"), F.col("lang"))
    keep = (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)
    return found.select("doc_id", "p_quality", "p_toxic", keep.alias("keep"))


def op10_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    planned, names = mixing.plan_mix(docs)
    return planned.select(
        "doc_id",
        F.col(names["size"]).alias("size"),
        F.col(names["source_size"]).alias("source_size"),
        F.col(names["target"]).alias("target"),
        (F.col(names["size"]) * F.col(names["copies"])).alias("taken"),
    )


OP10_SQL = r"""
WITH e AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '')
           || '|' || coalesce(text, '')) AS drawn
  FROM documents
), n AS (
  SELECT *, row_number() OVER (PARTITION BY drawn ORDER BY source, size) - 1 AS number FROM e
), d AS (
  SELECT doc_id, source, size,
         ('0x' || substr(CASE WHEN number = 0 THEN drawn ELSE md5(drawn || '|' || number) END, 1, 12)
         )::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM n
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM s
), c AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER o, 0) AS used, coalesce(sum(weight) OVER o, 0) AS gone
  FROM w
  WINDOW o AS (ORDER BY 3.0 * source_size / weight, source
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), k AS (
  SELECT *, 3 * source_size * (weights - gone) < (total - used) * weight AS capped FROM c
), l AS (
  SELECT max(total) - coalesce(sum(3 * source_size) FILTER (WHERE capped), 0) AS rest,
         sum(weight) FILTER (WHERE NOT capped) AS free
  FROM k
), t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (3 * source_size)::DOUBLE
              ELSE weight::DOUBLE * rest::DOUBLE / free::DOUBLE END AS target
  FROM k, l
), r AS (
  SELECT d.doc_id, d.size, d.u, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken
FROM r
"""


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return forest.search(vectors, F.col("vec_id") % 20 == 0, k=20)


#: The table of CRC-32, made from its polynomial.
CRC32_TABLE = """
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
"""


def _crc32_sql(bytes_: str) -> str:
    return f"""xor(list_reduce(list_concat([4294967295], {bytes_}),
      lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295)"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = working_folder(spark)
    found = docs.select("doc_id", F.explode(spelling.runs(F.col("text"))).alias("run"))
    seen = found.select(spelling.misspelt(F.col("doc_id"), F.col("run"), every=199).alias("word"))
    words = saved(spelling.count_words(seen, shortest=6, least=5), f"{folder}/words")
    return spelling.variants(words, ratio=5, folder=folder)


OP12_SQL = f"""
WITH RECURSIVE t AS ({CRC32_TABLE}),
o AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc_id,
         unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents
), c AS (SELECT doc_id, run, count(*) AS k FROM o GROUP BY ALL),
h AS (
  SELECT run, k, {_crc32_sql("""flatten(list_transform(string_split(doc_id || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
                     ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END))""")} AS h
  FROM c, t
), w AS (
  SELECT CASE WHEN h % 199 = 0
              THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
              ELSE run END AS word, sum(k)::BIGINT AS n
  FROM h GROUP BY word HAVING length(word) >= 6 AND sum(k) >= 5
), x AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w) e
), p AS (
  SELECT x.word, y.word AS near, y.n FROM x JOIN x y ON x.i = y.i AND x.less = y.less AND x.word <> y.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.less
  UNION SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.less
), f AS (
  SELECT w.word, w.n, count(p.near) AS n_near, max(p.n) AS most,
         first(p.near ORDER BY p.n DESC, p.near) AS best
  FROM w LEFT JOIN p ON p.word = w.word GROUP BY w.word, w.n
), g AS (
  SELECT word, CASE WHEN most >= 5 * n THEN best END AS form, n, n_near,
         CASE WHEN most >= 5 * n THEN most END AS form_n
  FROM f
), r AS (
  SELECT word, word AS root, form AS next FROM g
  UNION ALL
  SELECT r.word, r.next, g.form FROM r JOIN g ON g.word = r.next
)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN r ON r.word = g.word AND r.next IS NULL
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the CRC asks for it, a document's count of characters is tampered with."""
    docs = table(spark, sf_dir, "documents")
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = [*plain[:3], F.col("n_chars").cast("decimal(20,0)") + 1, plain[4]]
    asked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    kept = {"doc_id": F.col("doc_id"), "altered": F.when(asked, merkle.digest(*tampered))}
    found = merkle.manifest(docs, merkle.digest(*plain), F.col("doc_id"), F.col("lang"), kept)
    folded = merkle.fold(F.coalesce("altered", "leaf"), F.col("proof"))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.siblings_digest(F.col("proof")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(n_chars: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
    encoded = [f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values]
    return f"sha256({' || '.join(encoded)})"


OP13_SQL = f"""
WITH RECURSIVE t AS ({CRC32_TABLE}),
d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("n_chars")} AS leaf,
         {_leaf_sql("n_chars::HUGEINT + 1")} AS altered,
         coalesce({_crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")}
           % 7 = 0, false) AS asked,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {_leaf_sql("n_chars")}) - 1 AS place
  FROM documents, t
), tree AS (
  SELECT g, 0 AS level, place, leaf AS hash, count(*) OVER (PARTITION BY g) AS n FROM d
  UNION ALL
  SELECT g, level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (any_value(n) + 1) // 2
  FROM tree WHERE n > 1 GROUP BY g, level, place // 2
), subroots AS (
  SELECT g, hash AS subroot, level AS height, row_number() OVER (ORDER BY g) - 1 AS place
  FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, place, subroot AS hash, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (any_value(n) + 1) // 2
  FROM top WHERE n > 1 GROUP BY level, place // 2
), low AS (
  SELECT d.doc_id, d.leaf, d.altered, d.asked, d.g, d.place, s.subroot,
         list(struct_pack(own := (d.place >> l.level) % 2, hash := b.hash) ORDER BY l.level)
           FILTER (WHERE l.level IS NOT NULL) AS path
  FROM d JOIN subroots s ON s.g = d.g
  LEFT JOIN (SELECT DISTINCT g, level FROM tree) l ON l.g = d.g AND l.level < s.height
  LEFT JOIN tree b ON b.g = d.g AND b.level = l.level AND b.place = xor(d.place >> l.level, 1)
  GROUP BY ALL
), high AS (
  SELECT s.g, (SELECT hash FROM top WHERE n = 1) AS root,
         list(struct_pack(own := (s.place >> l.level) % 2, hash := b.hash) ORDER BY l.level)
           FILTER (WHERE l.level IS NOT NULL) AS path
  FROM subroots s
  LEFT JOIN (SELECT DISTINCT level FROM top WHERE n > 1) l ON true
  LEFT JOIN top b ON b.level = l.level AND b.place = xor(s.place >> l.level, 1)
  GROUP BY ALL
), proofs AS (
  SELECT low.*, root, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS proof
  FROM low JOIN high ON low.g = high.g
), folded AS (
  SELECT *, list_reduce(
      list_concat([CASE WHEN asked THEN altered ELSE leaf END],
        list_transform(proof, lambda s: CASE WHEN s.own = 1 THEN '<' ELSE '>' END || coalesce(s.hash, ''))),
      lambda below, s: sha256(CASE WHEN s[1] = '<' THEN s[2:] || below ELSE below || s[2:] END)
    ) AS folded_root
  FROM proofs
)
SELECT doc_id, leaf, subroot, root,
       sha256(coalesce(list_aggregate(list_transform(proof, lambda s: coalesce(s.hash, '')), 'string_agg', ''), ''))
         AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""

QUERIES: dict[str, Query] = {
    "op1_main_text": op1_main_text,
    "op2_language": op2_language,
    "op3_top_k": op3_top_k,
    "op4_shards": op4_shards,
    "op5_repeats": op5_repeats,
    "op6_simhash": op6_simhash,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_mix_to_weights": op10_mix_to_weights,
    "op11_neighbours": op11_neighbours,
    "op12_spelling": op12_spelling,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE: dict[str, str] = {
    "op3_top_k": OP3_SQL,
    "op7_warc_revisits": OP7_SQL,
    "op10_mix_to_weights": OP10_SQL,
    "op12_spelling": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
