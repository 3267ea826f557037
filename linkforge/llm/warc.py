"""WARC records, files and their Merkle fixity audit.

Pages become WARC response records, laid out in files at known offsets. A tree is built over each file:
leaves are SHA-256 digests of records, inner nodes cover aligned ranges of offsets and hash the ordered
(offset, digest) list of their children. Two replicas are compared at the roots, and only ranges whose
digests differ are descended, down to the records that are damaged, missing or extra. Records stay where they are
read: a manifest (place, length, digest) is all that is shuffled.

A record lost in place (its bytes are a hole) leaves all other nodes as they are. A replica that was written anew
without it has other offsets from there on; its ranges differ, and records are then compared by id, so those
that only moved are not reported.

A null url or html counts as empty; null page ids are laid out in files of their own, by hash, copies of one
record in runs of PAGES_PER_FILE, so that no file grows with their number. Repeated rows are records of their
own; those of one id lie in one file. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages

PAGES_PER_FILE = 512
NULL_FILES = 1 << 20
LEAF_BITS, FAN_BITS = 16, 4
"""The lowest ranges cover 64 KB of a file, each level above 16 times as much."""
SEPARATOR = "\r\n\r\n"


def records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", per_file: int = PAGES_PER_FILE) -> DataFrame:
    """``file, page_id, key, length, record``: a response record for each page, in files of consecutive ids.
    ``key`` orders the records of one id."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("_u"), F.coalesce(F.col(html), F.lit("")).alias("_h"))
    numbered = rows.where(F.col("page_id").isNotNull()).withColumn("file", F.floor(F.col("page_id") / per_file))
    copies = rows.where(F.col("page_id").isNull()).groupBy("page_id", "_u", "_h").agg(F.count(F.lit(1)).alias("_n"))
    copies = copies.select("page_id", "_u", "_h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_i"))
    copies = copies.withColumn("file", -1 - F.pmod(F.xxhash64("_u", "_h", F.floor(F.col("_i") / per_file)), F.lit(NULL_FILES)))
    rows = numbered.unionByName(copies.drop("_i"))
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "), F.col("_u"), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("_h").cast("string"), F.lit(SEPARATOR), F.col("_h"), F.lit(SEPARATOR))
    rows = rows.select("file", "page_id", record.alias("record"))
    return rows.select("file", "page_id", F.xxhash64("record").alias("key"), F.octet_length("record").cast("long").alias("length"), "record")


def manifest(recs: DataFrame) -> DataFrame:
    """Leaves: ``file, offset, length, page_id, digest``; the digest is of the record's bytes as they are. A null
    record is a hole: it takes its length and has no leaf."""
    rows = recs.select("file", "page_id", "key", "length", F.unhex(F.sha2("record", 256)).alias("digest"))
    order = Window.partitionBy("file").orderBy("page_id", "key")
    rows = rows.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length"))
    return rows.where("digest is not null").select("file", "offset", "length", "page_id", "digest")


def node_hash(children):
    """Digest of an array of (place, digest)."""
    ordered = F.transform(F.array_sort(children), lambda c: F.concat(c["place"].cast("string"), F.lit(":"), F.hex(c["digest"])))
    return F.unhex(F.sha2(F.concat_ws(",", ordered), 256))


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of inner nodes, lowest first: ``file, node, digest``; a node is offset >> bits of its level.

    A node has at most 16 children, and a lowest one the records that start in its 64 KB.
    """
    out = [leaves.withColumn("node", F.shiftright("offset", LEAF_BITS)).groupBy("file", "node").agg(
        node_hash(F.collect_list(F.struct(F.col("offset").alias("place"), "digest"))).alias("digest"))]
    for _ in range(levels - 1):
        out.append(out[-1].withColumn("up", F.shiftright("node", FAN_BITS)).groupBy("file", F.col("up").alias("node")).agg(
            node_hash(F.collect_list(F.struct(F.col("node").alias("place"), "digest"))).alias("digest")))
    return out


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Differences of two manifests: ``file, offset, length, page_id, status, digest_first, digest_second``; place and
    length are the first replica's, or the second's for extra records."""
    stages = Stages(first.sparkSession)
    first, second = stages.put(first), stages.put(second)
    last = first.select("offset").union(second.select("offset")).agg(F.max("offset")).first()[0]
    levels = 1 + -(-max(0, int(last or 0).bit_length() - LEAF_BITS) // FAN_BITS)
    a, b = ([stages.put(t) for t in tree(x, levels)] for x in (first, second))

    def differ(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.withColumnRenamed("digest", "other")
        return x.join(y, ["file", "node"], "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select("file", "node")

    def below(x: DataFrame, bad: DataFrame, bits: int, place: str) -> DataFrame:
        return x.withColumn("_up", F.shiftright(place, bits)).join(
            bad.select("file", F.col("node").alias("_up")), ["file", "_up"], "left_semi").drop("_up")

    bad = differ(a[-1], b[-1])
    for x, y in zip(a[-2::-1], b[-2::-1], strict=True):
        bad = stages.put(bad)
        bad = differ(below(x, bad, FAN_BITS, "node"), below(y, bad, FAN_BITS, "node"))
    bad = stages.put(bad)
    # records by id, and by their order among records of one id: what only moved has the same digest
    order = Window.partitionBy("file", "page_id").orderBy("digest", "offset")
    x, y = (below(t, bad, LEAF_BITS, "offset") for t in (first, second))
    same = ["file", "page_id", "digest"]
    turn = F.row_number().over(Window.partitionBy(*same).orderBy("offset"))
    x, y = x.withColumn("_n", turn), y.withColumn("_n", turn)

    def without(t: DataFrame, other: DataFrame) -> DataFrame:
        """Records of ``t`` that ``other`` has not, anywhere in the differing ranges, numbered within their id."""
        o = other.select(*[F.col(c).alias(f"o_{c}") for c in [*same, "_n"]])
        left = t.join(o, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in [*same, "_n"]], "left_anti")
        return left.withColumn("_k", F.row_number().over(order))

    x, y = without(x, y), without(y, x)
    y = y.select(F.col("file").alias("f2"), F.col("offset").alias("o2"), F.col("length").alias("l2"), F.col("page_id").alias("p2"), F.col("digest").alias("d2"), F.col("_k").alias("k2"))
    both = x.join(y, (F.col("file") == F.col("f2")) & F.col("page_id").eqNullSafe(F.col("p2")) & (F.col("_k") == F.col("k2")), "full")
    status = F.when(F.col("d2").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("damaged")
    return both.select(
        F.coalesce("file", "f2").alias("file"), F.coalesce("offset", "o2").alias("offset"), F.coalesce("length", "l2").alias("length"), F.coalesce("page_id", "p2").alias("page_id"), status.alias("status"),
        F.lower(F.hex("digest")).alias("digest_first"), F.lower(F.hex("d2")).alias("digest_second"))


def write(recs: DataFrame, path: str) -> None:
    """Writes WARC files, one in each folder ``file=N``, to any store Spark can write to; holes are left out. A
    record's own end is the line separator, so the bytes of a file are those of its records."""
    rows = recs.where("record is not null").select("file", "page_id", "key", F.expr(f"left(record, length(record) - {len(SEPARATOR)})").alias("record"))
    rows.repartition("file").sortWithinPartitions("file", "page_id", "key").select("file", "record").write.partitionBy("file").option(
        "lineSep", SEPARATOR).text(path)


HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)
FIELD = re.compile(rb"(?m)^([\w-]+): ?([^\r]*)\r?$")


def parse(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, whole record) of each record of a WARC file, by the lengths that the records tell."""
    at = 0
    while at < len(raw):
        m = HEAD.match(raw, at)
        if not m:
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.decode().lower(): v.decode() for k, v in FIELD.findall(m[1])}
        end = m.end() + int(head["content-length"]) + len(SEPARATOR)
        if raw[end - len(SEPARATOR):end] != SEPARATOR.encode():
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, head, raw[at:end]
        at = end


def read(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, length, page_id, url, html, digest`` of each record of the files that ``write`` wrote; a file is
    held whole by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, out = int(re.search(r"file=(-?\d+)", name)[1]), []
                for at, head, record in parse(raw):
                    number = head["warc-record-id"].strip("<>").rpartition(":")[2]
                    body = record[len(record) - len(SEPARATOR) - int(head["content-length"]):-len(SEPARATOR)].decode()
                    out.append((file, at, len(record), None if number == "null" else int(number), head["warc-target-uri"], body, hashlib.sha256(record).digest()))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=READ)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInArrow(run, "file long, offset long, length long, page_id long, url string, html string, digest binary")


READ = ["file", "offset", "length", "page_id", "url", "html", "digest"]


def rot(recs: DataFrame, every: int = 37) -> DataFrame:
    """A replica with known damage, for drills: of every ``every`` page ids one record has its last markup
    changed and another one is lost in place."""
    slot = F.pmod(F.coalesce(F.col("page_id"), F.lit(1)), F.lit(every))
    spoilt = F.concat(F.expr("left(record, length(record) - 5)"), F.lit("\x00"), F.expr("right(record, 4)"))
    return recs.withColumn("record", F.when(slot == 5, spoilt).when(slot != 11, F.col("record")))


ORACLE = r"""
WITH r AS (SELECT page_id, page_id // 512 AS file, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
  'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')),
  chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record FROM pages),
o AS (SELECT *, sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id) - strlen(record) AS "offset" FROM r)
SELECT file::BIGINT AS file, "offset"::BIGINT AS "offset", strlen(record)::BIGINT AS length, page_id, CASE WHEN page_id % 37 = 11 THEN 'missing' ELSE 'damaged' END AS status,
  sha256(record) AS digest_first, CASE WHEN page_id % 37 = 5 THEN sha256(concat(left(record, length(record) - 5), chr(0), right(record, 4))) END AS digest_second
FROM o WHERE page_id % 37 IN (5, 11)
"""
