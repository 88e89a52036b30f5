"""Operator 9 — web archives as a table of chunks.

Writing turns every page into rows of (record, chunk number): a payload beyond ``chunk_bytes``
becomes a first record and WARC continuation segments, so no file row holds a whole oversized
payload. Records with equal payloads refer to the one with the smallest id. Reading gives the
chunk table back; records of one segment are digested where they are read, longer ones are
brought together by record, ordered by chunk number, and their SHA-1 is carried from chunk to
chunk, so a task holds one chunk of a record at a time.

Files are written and read by Spark's text source, in any store it reaches. The rows of a file
are split where a version string follows a blank line. A payload that holds the version string is cut inside it wherever it
stands, so no chunk contains it, nor can one begin with it after the blank line of its own header. What is read is
held against the declared lengths and digests; a record that differs is an error.

Null payloads are empty. A page with a null id is a record of its own that nothing refers to;
repeated rows of the smallest id are all responses. Ties do not arise. Extra columns are not
read. An empty table gives an archive without records.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_table

_END = "\r\n\r\n"
_VERSION = "WARC/1.1"
_SPLIT = _END + _VERSION
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex40: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1, in groups of 40 bits."""
    groups = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def with_originals(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None,
                   revisit_bytes: int) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``payload_bytes``, ``digest``, ``refers_to``."""
    src = pages.select(
        F.col(id_col).alias("page_id"),
        (F.col(url_col).cast("string") if url_col else F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    src = src.withColumns({"payload_bytes": F.octet_length("payload").cast("long"),
                           "digest": base32(F.sha1(F.col("payload").cast("binary")))})
    # Only payloads found more than once are joined back: usually few, then Spark broadcasts
    # them by their size; else adaptive execution splits a digest that many pages share.
    copies = shared_table(
        src.where(F.col("payload_bytes") >= revisit_bytes).groupBy("digest", "payload_bytes")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1").drop("n"), "warc-copies")
    return (src.join(copies, ["digest", "payload_bytes"], "left")
            .withColumn("refers_to", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")))
            .drop("first_id"))


def chunk_rows(records: DataFrame, chunk_bytes: int) -> DataFrame:
    """One row per record and chunk; a revisit has one chunk without payload."""
    raw = F.col("payload")
    # cut inside every version string that the payload itself holds
    parts = F.when(F.col("refers_to").isNotNull(), F.array(F.lit(""))).when(
        F.instr(raw, _VERSION) > 0, F.split(raw, r"(?<=WARC/1)(?=\.1)")).otherwise(F.array(raw))
    sizes = f"""flatten(transform(parts, (p, i) -> transform(
        sequence(0, greatest(0, cast(ceil(octet_length(p) / {chunk_bytes}) as int) - 1)),
        k -> struct(i as part, k * {chunk_bytes} as at))))"""
    return (records.withColumn("record", F.monotonically_increasing_id())
            .withColumn("parts", parts).drop("payload")
            .withColumn("cuts", F.expr(sizes))
            .withColumn("n_chunks", F.size("cuts"))
            .select("*", F.posexplode("cuts").alias("chunk_no", "cut")).drop("cuts")
            .withColumn("chunk", F.expr(
                f"substring(cast(parts[cut.part] as binary), cut.at + 1, {chunk_bytes})"))
            .drop("parts", "cut"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html",
          url_col: str | None = "url", chunk_bytes: int = 65_536, revisit_bytes: int = 0,
          date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per page to the archive files in folder ``path``."""
    chunks = chunk_rows(with_originals(pages, id_col, payload_col, url_col, revisit_bytes),
                        chunk_bytes)
    record = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                      F.lit(":"), F.col("record").cast("string"))
    first, last = F.col("chunk_no") == 0, F.col("chunk_no") == F.col("n_chunks") - 1
    revisit, many = F.col("refers_to").isNotNull(), F.col("n_chunks") > 1
    http = F.when(first, F.concat(F.lit(_HTTP + "\r\nContent-Length: "),
                                  F.col("payload_bytes").cast("string"), F.lit(_END))).otherwise("")
    length = F.octet_length(http) + F.octet_length("chunk")

    def field(name: str, value, when=None) -> Column:
        f = F.concat(F.lit(f"\r\n{name}: "), value)
        return f if when is None else F.when(when, f).otherwise("")

    head = F.concat(
        F.lit(_VERSION),
        field("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        field("WARC-Record-ID", F.concat(F.lit("<"), record, F.when(first, "").otherwise(
            F.concat(F.lit("#"), F.col("chunk_no").cast("string"))), F.lit(">"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.translate(F.coalesce("url", F.lit("")), "\r\n", "")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        field("WARC-Payload-Length", F.col("payload_bytes").cast("string"), first),
        field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
              revisit),
        field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"),
                                         F.lit(">")), revisit),
        field("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"), many),
        field("WARC-Segment-Origin-ID", F.concat(F.lit("<"), record, F.lit(">")), many & ~first),
        field("WARC-Segment-Total-Length", F.col("payload_bytes").cast("string"), many & last),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", length.cast("string")))
    value = F.concat(head.cast("binary"), F.lit(_END).cast("binary"), http.cast("binary"), F.col("chunk"))
    (chunks.select(value.cast("string").alias("value"))
     .write.option("lineSep", _END).option("compression", "none").text(path))


def read_chunks(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The chunk table of the archives in ``path``: ``page_id``, ``record`` (one number per
    record), ``chunk_no``, ``segmented`` (the record has more chunks), ``record_type``, ``refers_to``, ``declared_digest``,
    ``declared_bytes``, ``chunk`` (payload bytes)."""
    rows = spark.read.option("lineSep", _SPLIT).text(path)
    head = F.concat(F.substring_index("value", _END, 1), F.lit("\r\n"))

    def get(name: str, pattern: str) -> Column:
        got = F.regexp_extract("head", rf"\r\n{name}: {pattern}\r\n", 1)
        return F.when(got != "", got)

    rows = (rows.withColumn("head", head).where("head like '%WARC-Type:%'")
            .withColumns({
                "block": F.expr("substring(cast(value as binary), octet_length(head) + 3, "
                                r"cast(regexp_extract(head, '\r\nContent-Length: ([0-9]+)\r\n', 1) as int))"),
                "kind": get("WARC-Type", "([a-z]+)")})
            .withColumn("skip", F.when(F.col("kind") == "continuation", 0).otherwise(
                F.octet_length(F.substring_index(F.col("block").cast("string"), _END, 1)) + len(_END))))
    return rows.select(
        get("WARC-Record-ID", "<urn:page:(.*):[0-9]+(?:#[0-9]+)?>").cast(id_type).alias("page_id"),
        get("WARC-Record-ID", "<urn:page:.*:([0-9]+)(?:#[0-9]+)?>").cast("long").alias("record"),
        (F.coalesce(get("WARC-Segment-Number", "([0-9]+)").cast("int"), F.lit(1)) - 1).alias("chunk_no"),
        get("WARC-Segment-Number", "([0-9]+)").isNotNull().alias("segmented"),
        F.col("kind").alias("record_type"),
        get("WARC-Refers-To", "<urn:page:([^>]*)>").cast(id_type).alias("refers_to"),
        get("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("declared_digest"),
        get("WARC-Payload-Length", "([0-9]+)").cast("long").alias("declared_bytes"),
        F.expr("substring(block, skip + 1, octet_length(block))").alias("chunk"))


def read(spark: SparkSession, path: str, id_type: str = "long", verify: bool = True) -> DataFrame:
    """One row per record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``, ``digest_ok`` (what was read has the declared digest and length; null for revisits). With ``verify``
    a record that is not ok is an error."""
    chunks = read_chunks(spark, path, id_type)
    whole = (chunks.where(~F.col("segmented"))
             .withColumn("seen", F.when(F.col("record_type") == "response", base32(F.sha1("chunk"))))
             .select("page_id",
                     F.when(F.col("record_type") == "revisit", F.col("declared_bytes"))
                     .otherwise(F.octet_length("chunk").cast("long")).alias("payload_bytes"),
                     F.coalesce("seen", "declared_digest").alias("payload_digest"),
                     "record_type", "refers_to",
                     F.when(F.col("record_type") == "response", F.coalesce(
                         (F.col("seen") == F.col("declared_digest")) & (F.octet_length("chunk") == F.col("declared_bytes")),
                         F.lit(False))).alias("digest_ok")))
    parts = (chunks.where("segmented").repartition("record")
             .sortWithinPartitions("record", "chunk_no")
             .select("page_id", "chunk_no", "declared_digest", "declared_bytes", "chunk"))

    def digest(batches):
        key, sha, size, declared = None, None, 0, None

        def row():
            got = b32encode(sha.digest()).decode()
            return (key, size, got, "response", None, (got, size) == declared)

        for pdf in batches:
            out = []
            for page, no, want, length, chunk in pdf.itertuples(index=False):
                if no == 0:
                    if sha is not None:
                        out.append(row())
                    key, sha, size, declared = page, hashlib.sha1(), 0, (want, length)
                sha.update(chunk)
                size += len(chunk)
            yield frame(out)
        if sha is not None:
            yield frame([row()])

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"]

    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names).astype({"page_id": object, "refers_to": object})

    out = whole.unionByName(parts.mapInPandas(digest, whole.schema))
    if not verify:
        return out
    wrong = F.raise_error(F.concat(F.lit("archive record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("(no id)")),
                                   F.lit(" does not have its declared digest or length")))
    return out.withColumn("payload_digest", F.when(F.coalesce("digest_ok", F.lit(True)), F.col("payload_digest")).otherwise(wrong))
