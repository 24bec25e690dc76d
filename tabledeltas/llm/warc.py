"""WARC archives in which repeated payloads are revisits of one response.

Headers alone (id, address, digest, length) are grouped by payload digest; the record with the
largest id of a repeated payload becomes the response, the others are joined to it and written
as revisits without a body. All headers are made anew. Records are written by Spark's text
sink, one record per "line" with the record end as line separator, so an archive can lie in any
store and is read back in splits.

* A null page counts as an empty one. Payloads shorter than ``least_bytes`` are never revisits.
* Rows that repeat the response's id as well as its payload stay responses; a null id loses to
  any other.
* White space, control characters and line separators in an address become ``%20``.
* A payload that holds a record's first line would split the archive wrongly; it is stored in
  chunks, which its HTTP head says, each ending within such a line. Any reader of HTTP puts them
  together again. Digest and length are those of the payload itself.
* Very long payloads are bounded by what a Spark text may hold, 2 GB, head included. Of equal
  ids the greater address is the response's. Repeated rows are records of their own.
* An empty table gives an empty archive. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledeltas.llm.common import saved, working_folder

CRLF = "\r\n"
END = CRLF + CRLF
VERSION = "WARC/1.1"
FIRST_LINE = VERSION + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
LEAST_BYTES = 1000
#: Bytes of the repeated headers that are broadcast as they are. Beyond that a filter of this
#: many bits at most, ten a digest, tells which payloads have to be shuffled.
BROADCAST_BYTES, FILTER_BITS, HASHES = 64 << 20, 1 << 30, 4
#: Words of 64 bits that one row of the filter holds.
FILTER_WORDS = 1 << 16


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">"))


def _address(url: Column) -> Column:
    return F.regexp_replace(url, r"[\x00-\x20\x7f\x{85}\x{2028}\x{2029}]", "%20")


def _chunked(payload: Column) -> Column:
    """HTTP chunks that end within every version mark."""
    chunk = F.split(payload, r"(?<=WARC)(?=/1\.1)")
    sized = F.transform(
        chunk, lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(CRLF), c, F.lit(CRLF))
    )
    return F.concat(F.array_join(sized, ""), F.lit(f"0{END}"))


def _content(body: bytes | None) -> bytes | None:
    """What HTTP chunks hold; null for what is not sent in them."""
    if body is None:
        return None
    at, parts = 0, []
    while size := int(body[at : (head := body.index(b"\r\n", at))].split(b";")[0], 16):
        parts.append(body[head + 2 : head + 2 + size])
        at = head + 4 + size
    return b"".join(parts)


def _joined(stored: Column) -> Column:
    @F.pandas_udf("binary")
    def joined(bodies: pd.Series) -> pd.Series:
        return bodies.map(_content)

    return joined(stored)


def _slots(bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _filter_words(digests: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the digests, its bits set by aggregation."""
    slots = digests.select(F.explode(F.array(*_slots(bits))).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")
    )

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packed = np.zeros(FILTER_WORDS, np.int64)
        packed[rows["word"].to_numpy(np.int64) - key[0] * FILTER_WORDS] = rows["bits"]
        return pd.DataFrame({"part": [key[0]], "packed": [packed.tobytes()]})

    part = F.floor(F.col("word") / FILTER_WORDS).alias("part")
    out = np.zeros((-(-bits // (64 * FILTER_WORDS)), FILTER_WORDS), np.int64)
    for row in words.groupBy(part).applyInPandas(pack, "part long, packed binary").collect():
        out[row["part"]] = np.frombuffer(row["packed"], np.int64)  # FILTER_BITS in all, at most
    return out.ravel().view(np.uint64)


def _may_be_repeated(repeated: DataFrame, n: int) -> Column:
    """False only for digests that are not among the ``n`` repeated ones."""
    bits = min(FILTER_BITS, 1 << max(6, (10 * n).bit_length()))
    words = repeated.sparkSession.sparkContext.broadcast(_filter_words(repeated, bits))

    @F.pandas_udf("boolean")
    def held(*slots: pd.Series) -> pd.Series:
        found = np.ones(len(slots[0]), bool)
        for slot in slots:
            at = slot.to_numpy(np.int64)
            found &= (words.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(found)

    return held(*_slots(bits))


def resolve_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, payload, n_bytes, digest`` of every page, and in ``original`` the id and
    address of the response it revisits, or null. Payloads are not shuffled where the repeated
    headers are small enough to be broadcast; else only those whose digest may be a repeated
    one."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    bodies = pages.select(
        "page_id",
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
        F.sha1(payload).alias("digest"),
    )
    headers = bodies.where(F.col("n_bytes") >= least_bytes).select("page_id", "url", "digest")
    repeated = (
        headers.groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("original"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    repeated = saved(repeated, f"{working_folder(pages.sparkSession)}/repeated")
    held_bytes = F.coalesce(F.octet_length("original.url"), F.lit(0)).cast("long") + 200
    n, size = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum(held_bytes), F.lit(0))).first()
    if size <= BROADCAST_BYTES:
        joined = bodies.join(F.broadcast(repeated), "digest", "left")
    else:
        maybe = _may_be_repeated(repeated, n)
        unique = bodies.where(~maybe).withColumn("original", F.lit(None).cast(repeated.schema["original"].dataType))
        joined = bodies.where(maybe).join(repeated, "digest", "left").unionByName(unique)
    is_response = F.col("page_id").eqNullSafe(F.col("original.page_id"))
    return joined.withColumn("original", F.when(~is_response, F.col("original")))


def write_archives(
    pages: DataFrame,
    path: str,
    least_bytes: int = LEAST_BYTES,
    date: str = "2000-01-01T00:00:00Z",
    compression: str = "none",
) -> None:
    """One record per page below ``path``. ``date`` goes to every header."""
    records = resolve_revisits(pages, least_bytes)
    revisit = F.col("original").isNotNull()
    torn = F.col("payload").contains(FIRST_LINE)
    body = F.when(revisit, F.lit("")).when(torn, _chunked(F.col("payload"))).otherwise(F.col("payload"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        F.when(torn & ~revisit, F.lit(f"Transfer-Encoding: chunked{CRLF}")).otherwise(
            _line("Content-Length", F.col("n_bytes").cast("string"))
        ),
        F.lit(CRLF),
    )
    block = F.concat(http, body)
    head = F.concat(
        F.lit(FIRST_LINE),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.lit(CRLF),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _address(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("original.page_id")))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, _address(F.col("original.url")))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(F.col("block")).cast("string")),
        F.lit(CRLF),
    )
    text = records.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))
    text.write.option("lineSep", END).option("compression", compression).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, url, record_type, refers_to, digest, n_bytes, payload, intact`` per record.

    ``payload`` is binary, null for a revisit; its digest and length are then those its head
    states. ``intact`` tells whether a payload has the digest its head states.
    """
    raw = spark.read.option("lineSep", END + FIRST_LINE).text(path)
    head = F.substring_index("value", END, 1)
    binary = F.col("value").cast("binary")

    def field(of: str, name: str) -> Column:
        found = F.regexp_extract(of, rf"(?:^|\n){name}: ([^\r]*)\r", 1)
        return F.when(found != "", found)

    def urn(name: str) -> Column:
        found = F.regexp_extract("head", rf"(?:^|\n){name}: <{URN}([^>]*)>\r", 1)
        return F.when(found != "", found)

    parts = (
        raw.withColumn("head", F.concat(head, F.lit(CRLF)))
        .withColumn("length", field("head", "Content-Length").cast("int"))
        .withColumn(
            "block", F.substring(binary, F.octet_length("head") + 3, F.col("length"))
        )
        .withColumn("http", F.concat(F.substring_index(F.decode("block", "utf-8"), END, 1), F.lit(CRLF)))
        .withColumn("stored", F.substring("block", F.octet_length("http") + 3, F.col("length")))
    )
    kind = field("head", "WARC-Type")
    stated = F.regexp_replace(field("head", "WARC-Payload-Digest"), "^sha1:", "")
    chunked = field("http", "Transfer-Encoding").eqNullSafe("chunked")
    payload = F.when(chunked, _joined(F.when(chunked, F.col("stored")))).otherwise(F.col("stored"))
    records = parts.select(
        urn("WARC-Record-ID").alias("record_id"),
        field("head", "WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        urn("WARC-Refers-To").alias("refers_to"),
        stated.alias("stated"),
        field("http", "Content-Length").cast("long").alias("stated_bytes"),
        F.when(kind == "response", payload).alias("payload"),
    )
    own = F.col("payload").isNotNull()
    return records.select(
        "record_id",
        "url",
        "record_type",
        "refers_to",
        F.when(own, F.sha1("payload")).otherwise(F.col("stated")).alias("digest"),
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("stated_bytes")).alias("n_bytes"),
        "payload",
        F.when(own, F.sha1("payload") == F.col("stated")).alias("intact"),
    )
