"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Sizes are tokens of the public vocabulary of ``tokens``, counted in the pass that reads the texts. A document
longer than a bin is cut into pieces of bin size and a rest; every token is packed. Pieces are dealt by a hash
of id, text and piece into shards of about SHARD pieces, so shards are packed side by side, stay bounded and
don't depend on how the input is partitioned; best fit is the best within a shard. In a shard, pieces go from large to small. Open bins are ordered by residual space and carry two bitmaps: the
sources and the duplicate clusters that they hold. The search starts at the tightest bin that fits and goes
on to the next larger residual until bin and piece have no source and no cluster in common; if none is
left, a bin is opened.

Null ids, sources and clusters are values of their own. Documents without tokens (null or empty texts) take
no room and get no row. Repeated rows are packed one by one. Ties in length go by id, then piece. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Stages
from .groups import by_group
from .tokens import counter, vocabulary

CAPACITY = 2048
SHARD = 4096


def best_fit(pieces: list[tuple[int, int, int]], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, start) for each piece (size, source, cluster), which must come in decreasing size.

    Sources and clusters are small numbers; a bin's bitmap has their bits.
    """
    space: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    used: list[int] = []
    out = []
    for size, source, cluster in pieces:
        s, c = 1 << source, 1 << cluster
        at = bisect_left(space, (size, -1))
        while at < len(space) and (sources[b := space[at][1]] & s or clusters[b] & c):
            at += 1
        if at < len(space):
            left, b = space.pop(at)
        else:
            left, b = capacity, len(used)
            sources.append(0)
            clusters.append(0)
            used.append(0)
        sources[b] |= s
        clusters[b] |= c
        out.append((b, used[b]))
        used[b] += size
        if left > size:
            insort(space, (left - size, b))
    return out


def pack_group(rows: list[dict], capacity: int) -> list[tuple]:
    """Packs one shard: rows of (shard, id, piece, first, size, source, cluster)."""
    rows = sorted(rows, key=lambda r: (-r["size"], r["_id"] is None, r["_id"] or 0, r["piece"], r["_source"] or "", r["_cluster"] or ""))
    s: dict = {}
    c: dict = {}
    placed = best_fit([(r["size"], s.setdefault(r["_source"], len(s)), c.setdefault(r["_cluster"], len(c))) for r in rows], capacity)
    return [(r["shard"] << 32 | b, start, r["_id"], r["piece"], r["first"], r["size"], r["_source"], r["_cluster"])
            for r, (b, start) in zip(rows, placed, strict=True)]


def sized(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``_id, _source, _size, _cluster`` for rows of id, source, size, cluster and text. A null size is counted
    as tokens; a null cluster becomes the hash of the text without white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = WHITE.encode()
        for batch in batches:
            given, clusters = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts = [t or "" for t in batch.column(4).to_pylist()]
            size = [counter(path or vocabulary()).count(t) if n is None else n for n, t in zip(given, texts, strict=True)]
            clusters = [hashlib.md5(t.encode().translate(None, white)).hexdigest() if c is None else c for c, t in zip(clusters, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(size, pa.int64()), pa.array(clusters, pa.string())], names=["_id", "_source", "_size", "_cluster"])

    return rows.mapInArrow(run, "_id long, _source string, _size long, _cluster string")


def pack(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", size=None, cluster=None,
         capacity: int = CAPACITY, shard: int = SHARD, path: str | None = None) -> DataFrame:
    """A row for each piece: ``bin_id, bin_start, <id>, piece, first_token, n_tokens, source, cluster``.

    ``size`` is a column of lengths (by default tokens, counted here), ``cluster`` that of duplicate clusters (by
    default the hash of the text without white space, so exact copies never share a bin).
    """
    stages = Stages(docs.sparkSession)
    none = F.lit(None)
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(source).cast("string").alias("_source"), (none if size is None else size).cast("long").alias("_size"),
        (none if cluster is None else cluster).cast("string").alias("_cluster"), F.col(text).alias("_text"))
    rows = stages.put(sized(rows, path).where("_size > 0"))
    total = rows.agg(F.sum(F.ceil(F.col("_size") / capacity))).first()[0] or 0
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_size") / capacity).cast("int") - 1)))
    first = F.col("piece") * F.lit(capacity).cast("long")
    pieces = pieces.select(
        F.pmod(F.xxhash64("_id", "_cluster", "piece"), F.lit(max(1, -(-int(total) // shard)))).alias("shard"), "_id", "piece", first.alias("first"),
        F.least(F.lit(capacity).cast("long"), F.col("_size") - first).alias("size"), "_source", "_cluster")
    return by_group(
        pieces, ["shard"], [], lambda rows: pack_group(rows, capacity),
        f"bin_id long, bin_start long, `{id_col}` long, piece int, first_token long, n_tokens long, source string, cluster string")
