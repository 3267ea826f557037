"""Suffix-array dedup: removes every byte covered by a 200-byte string that also starts anywhere else.

The index over many texts is built column by column: in each round every text that still has one inserts
one symbol, and the order of all suffixes (the collection's Burrows-Wheeler order) and the common prefix of
neighbours are updated from the round before. Neighbours that share 200 bytes are repeats; whole bytes are
compared. Columns lie one after the other in the order of the rounds, and each round reads the next one. The
external files of the method are the tables between the steps, in the shared folder; what a task holds at once
is bounded, so it keeps its columns in memory and leaves nothing on its machine.

Whole corpora would need as many rounds as the longest text has bytes, each over all data. So the rounds run
over short stretches: every 200-byte window names as its anchor the 50 bytes in it with the least hash.
Equal windows have equal anchors at equal offsets, so only stretches around equal anchors can hold a
repeat; they are aligned at the anchor, 350 columns wide, and built by one task. Equal stretches enter once;
they are recognised within one anchor by a 64-bit BLAKE2 digest of their bytes. An anchor with more than HOT
different stretches (a common line) is split by ranges of window starts, each keyed by the bytes that all its
windows share; where more than HUGE stretches share even those, their windows are counted one by one, by 128-bit
digests, so no key's stretches are ever held by one task.

Matches never cross documents. A null text is empty. Repeated rows are copies of each other. Null ids take
part. Texts under 200 bytes stay whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, sweep

SPAN, ANCHOR = 200, 50
STARTS = SPAN - ANCHOR + 1
WIDTH = SPAN + STARTS - 1
HOT, PART, HUGE = 1000, 19, 50_000
"""An anchor with more than HOT different stretches is split into ranges of PART window starts, one of these with
more than HUGE into single windows."""
BUFFER = 1 << 20
BLOCK = 30_000
"""Stretches built together; a block ends with a key, so it can grow only by what one key holds."""


def _odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Sums of byte values times powers modulo 2**64; any substring's hash is a difference of two."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(2**62, 2**63)) | 1
        self.grow(BUFFER * 2)

    def grow(self, n: int) -> None:
        self.up = _odd_powers(self.base, n)
        self.down = _odd_powers(pow(self.base, -1, 2**64), n)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.grow(2 * len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_hashers: list[Hasher] = []


def short_digest(data: bytes, at: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=at.to_bytes(2, "big")).digest(), "big", signed=True)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Stretches of a list of texts: (text, anchor hash, stretch hash, first window, windows, anchor offset)."""
    if not _hashers:
        _hashers.append(Hasher(11))
    one = _hashers[0]
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < SPAN:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    s = one.sums(data)
    n = len(data) - ANCHOR + 1
    h = mix((s[ANCHOR:] - s[:-ANCHOR]) * one.down[:n])
    least, at = h, np.arange(n, dtype=np.int32)
    size = 1
    while size < STARTS:  # the leftmost least anchor of every window, by doubling
        step = min(size, STARTS - size)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        size += step
    valid = np.repeat(ends, np.diff(ends, prepend=0))[: len(at)] >= np.arange(SPAN, SPAN + len(at))
    start = np.flatnonzero(valid)
    if not len(start):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    of = at[start]
    cut = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1])
    windows = np.diff(np.append(cut, len(start)))
    lo, anchor = start[cut], of[cut].astype(np.int64)
    # the digest also tells where the anchor lies in the stretch
    x = np.array([short_digest(joined[a: b], c) for a, b, c in zip(lo.tolist(), (lo + windows + SPAN - 1).tolist(), (anchor - lo).tolist(), strict=True)], np.int64)
    text = np.searchsorted(ends, lo, side="right")
    return text, h[anchor].view(np.int64), x, lo - np.concatenate([[0], ends])[text], windows, anchor - lo


def find_anchors(rows: DataFrame) -> DataFrame:
    """``k1, k2, a, x, lo, w, d`` for each stretch of ``rows`` (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(k1, k2, texts):
            text, a, x, lo, w, d = anchors(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(k1, np.int64)[text]), pa.array(np.array(k2, np.int32)[text]), pa.array(a), pa.array(x),
                 pa.array(lo.astype(np.int64)), pa.array(w.astype(np.int32)), pa.array(d.astype(np.int32))],
                names=["k1", "k2", "a", "x", "lo", "w", "d"])

        k1, k2, texts, size = [], [], [], 0
        for batch in batches:
            for p, q, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (t or "").encode()
                if len(raw) < SPAN:
                    continue
                k1.append(p)
                k2.append(q)
                texts.append(raw)
                size += len(raw)
                if size >= BUFFER:
                    yield pack(k1, k2, texts)
                    k1, k2, texts, size = [], [], [], 0
        if texts:
            yield pack(k1, k2, texts)

    return rows.mapInArrow(run, "k1 long, k2 int, a long, x long, lo long, w int, d int")


def cut_stretches(rows: DataFrame) -> DataFrame:
    """Bytes of stretches: ``rows`` (text, list of a, x, lo, w, d, hot) to ``key, a, x, column, part, bytes``.

    ``column`` is the aligned column of the first byte: the anchor starts at column STARTS - 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                for r in found:
                    first = STARTS - 1 - r["d"]
                    whole = raw[r["lo"]: r["lo"] + r["w"] + SPAN - 1]
                    if not r["hot"]:
                        out.append((r["a"], r["a"], r["x"], first, whole))
                        continue
                    for c0 in range(0, STARTS, PART):
                        c1 = min(c0 + PART, STARTS) - 1
                        u, v = max(first, c0), min(first + r["w"] - 1, c1)
                        if u <= v:
                            core = whole[c1 - first: c0 + SPAN - first] if c1 >= first else raw[r["lo"] + c1 - first: r["lo"] + c0 + SPAN - first]
                            key = xxhash.xxh3_64_intdigest(core, c0) - 2**63
                            out.append((key, r["a"], r["x"], u, whole[u - first: v - first + SPAN]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                 pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.binary())], names=["key", "a", "x", "c", "raw"])

    return rows.mapInArrow(run, "key long, a long, x long, c int, raw binary")


def build_columns(starts: np.ndarray, raws: list[bytes]) -> np.ndarray:
    """Window starts that repeat: a boolean row of STARTS for each aligned stretch.

    Rounds go from the last column to the first. ``order`` lists the texts that have begun by rank of their
    suffix at this column, ``lcp`` the bytes that each shares with the one before it.
    """
    m = len(raws)
    hit = np.zeros((m, STARTS), bool)
    sizes = np.array([len(r) for r in raws])
    lasts = starts + sizes - 1
    columns = np.zeros((WIDTH, m), np.uint8)  # one column after the other in the order of the rounds
    step = max(1, (8 << 20) // WIDTH)
    for at in range(0, m, step):
        block = np.zeros((min(step, m - at), WIDTH), np.uint8)
        for i in range(len(block)):
            block[i, starts[at + i]: starts[at + i] + sizes[at + i]] = np.frombuffer(raws[at + i], np.uint8)
        columns[:, at: at + len(block)] = block[:, ::-1].T
    order, lcp = np.empty(0, np.int32), np.empty(0, np.int16)
    enter = np.argsort(-lasts, kind="stable")
    entered = 0
    for c in range(WIDTH - 1, -1, -1):
        upto = entered
        while upto < m and lasts[enter[upto]] >= c:
            upto += 1
        if upto > entered:  # an empty suffix comes before all others and shares nothing with them
            order = np.concatenate([enter[entered:upto].astype(np.int32), order])
            lcp = np.concatenate([np.zeros(upto - entered, np.int16), lcp])
            entered = upto
        if not len(order):
            continue
        stay = starts[order] <= c
        if not stay.all():
            place = np.flatnonzero(stay)
            if not len(place):
                order, lcp = order[:0], lcp[:0]
                continue
            ahead = np.minimum.reduceat(lcp[: place[-1] + 1], np.concatenate([[0], place[:-1] + 1]))
            order, lcp = order[place], ahead
            lcp[0] = 0
        symbol = columns[WIDTH - 1 - c][order]
        rank = np.argsort(symbol, kind="stable")
        lcp = _next_lcp(lcp, rank, symbol[rank])
        order = order[rank]
        if c < STARTS:
            long = lcp >= SPAN
            long[:-1] |= long[1:]
            hit[order[long], c] = True
    return hit


def _next_lcp(lcp: np.ndarray, rank: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Common prefixes after a symbol is set in front: one more than the least between the old places."""
    m = len(rank)
    out = np.zeros(m, np.int16)
    if m < 2:
        return out
    same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
    if not len(same):
        return out
    left, right = rank[same - 1] + 1, rank[same]  # least of lcp[left..right]
    length = right - left + 1
    level = np.frexp(length.astype(np.float64))[1] - 1
    table, value = lcp, np.empty(len(same), np.int16)
    for k in range(int(level.max()) + 1):
        pick = level == k
        if pick.any():
            value[pick] = np.minimum(table[left[pick]], table[right[pick] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k:])
    out[same] = value + 1
    return out


def repeated(stretches: DataFrame) -> DataFrame:
    """``a, x, c0, c1``: ranges of aligned window starts that repeat among different stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            hit = build_columns(np.array([r["c"] for r in rows]), [r["raw"] for r in rows])
            edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, c0 = np.nonzero(edge == 1)
            c1 = np.nonzero(edge == -1)[1] - 1
            a, x = np.array([r["a"] for r in rows], np.int64), np.array([r["x"] for r in rows], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(a[row]), pa.array(x[row]), pa.array(c0.astype(np.int32)), pa.array(c1.astype(np.int32))], names=["a", "x", "c0", "c1"])

        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(held) >= BLOCK and r["key"] != held[-1]["key"]:
                    yield flush(held)
                    held = []
                held.append(r)
        if held:
            yield flush(held)

    return stretches.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, x long, c0 int, c1 int")


def single_windows(stretches: DataFrame) -> DataFrame:
    """``window, a, x, c``: a 128-bit digest of each single window (with its key and start) of very many stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, a, x, c, raw in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                for i in range(len(raw) - SPAN + 1):
                    place = key.to_bytes(8, "big", signed=True) + (c + i).to_bytes(2, "big")
                    out.append((hashlib.blake2b(raw[i:i + SPAN], digest_size=16, salt=place).digest(), a, x, c + i))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()), *(pa.array(columns[i], pa.int64()) for i in (1, 2)), pa.array(columns[3], pa.int32())], names=["window", "a", "x", "c"])

    return stretches.select("key", "a", "x", "c", "raw").mapInArrow(run, "window binary, a long, x long, c int")


def remove(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside of ``spans``, and the maximal removed runs."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    at, kept = 0, []
    for lo, hi in runs:
        kept.append(raw[at:lo])
        at = hi
    return b"".join([*kept, raw[at:]]), [(lo, hi) for lo, hi in runs]


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), body.alias("text"), F.xxhash64(F.col(id_col), body).alias("k1"), F.hash(body, F.col(id_col)).alias("k2"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", stages: Stages | None = None) -> DataFrame:
    """``k1, k2, spans``: for each text that has some, the spans [lo, hi) of repeated 200-byte strings."""
    spark = docs.sparkSession
    stages = stages or Stages(spark)
    rows = _keyed(docs, id_col, text)
    found = stages.put(find_anchors(rows.select("k1", "k2", "text")))
    # a place is one number, as these rows are the most; one occurrence stands for all equal ones
    place = (F.col("lo") * 65536 + F.col("w") * 256 + F.col("d")).alias("p")
    lo, w, d = F.shiftright("p", 16).alias("lo"), F.shiftright("p", 8).bitwiseAND(F.lit(255)).alias("w"), F.col("p").bitwiseAND(F.lit(255)).alias("d")
    first = found.select("a", "x", "k1", "k2", place).groupBy("a", "x").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("k1", "k2", "p")])
    per = first.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("m")).where("k > 1 or m > 1").select("a", "k")
    first = stages.put(first.join(per, "a").where("k > 1 or n > 1"))
    sweep(spark)

    wanted = first.where("k > 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "x", lo, w, d, (F.col("k") > HOT).alias("hot"))).alias("found"))
    stretches = stages.put(cut_stretches(rows.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("text", "found")))
    sweep(spark)
    huge = stages.put(stretches.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HUGE).select("key"))
    if huge.isEmpty():
        part = stages.put(repeated(stretches))
    else:
        alone = stages.put(single_windows(stretches.join(huge, "key", "left_semi")))
        twice = stages.put(alone.groupBy("window").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("window"))
        one_by_one = alone.join(twice, "window").select("a", "x", F.col("c").alias("c0"), F.col("c").alias("c1"))
        part = stages.put(repeated(stretches.join(huge, "key", "left_anti")).unionByName(one_by_one))
        stages.free(alone, twice)
    stages.free(huge)
    whole = first.where("n > 1").select("a", "x", F.lit(0).alias("c0"), F.lit(STARTS - 1).alias("c1"))
    flagged = whole.unionByName(part.join(whole.select("a", "x"), ["a", "x"], "left_anti"))
    flagged = stages.put(flagged.groupBy("a", "x").agg(F.collect_list(F.struct("c0", "c1")).alias("ranges")))
    stages.free(first, stretches, part)
    sweep(spark)

    # back to every occurrence
    lists = found.select("a", "x", "k1", "k2", place).join(flagged, ["a", "x"]).select("k1", "k2", lo, w, d, F.explode("ranges").alias("r"))
    c = F.lit(STARTS - 1) - F.col("d")
    u, v = F.greatest(F.col("r.c0"), c), F.least(F.col("r.c1"), c + F.col("w") - 1)
    lists = lists.where(u <= v).select("k1", "k2", (F.col("lo") + u - c).alias("lo"), (F.col("lo") + v - c + SPAN).alias("hi"))
    spans = stages.put(lists.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    stages.free(found, flagged)
    sweep(spark)
    return spans


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: ``<id>, n_bytes, n_removed, spans, kept_bytes``, the last being what is left
    (bytes: a cut may fall inside a character)."""
    spans = repeats(docs, id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, runs, kept = [], [], []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = t.encode()
                rest, cut = remove(raw, [(s["lo"], s["hi"]) for s in found or []])
                size.append(len(raw))
                runs.append([{"lo": a, "hi": b} for a, b in cut])
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array([n - len(k) for n, k in zip(size, kept, strict=True)], pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())],
                names=[id_col, "n_bytes", "n_removed", "spans", "kept_bytes"])

    joined = _keyed(docs, id_col, text).join(spans, ["k1", "k2"], "left").select("_id", "text", "spans")
    kind = joined.schema["_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, kept_bytes binary")


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return deduplicate(docs, id_col, text).select(
        id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


ORACLE = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM b WHERE n >= 200)),
d AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
f AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM w SEMI JOIN d USING (m)),
g AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM f),
r AS (SELECT doc_id, run, min(p) AS lo, max(p) + 200 AS hi FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM r),
s AS (SELECT k.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
             string_agg(substr(b.h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS front FROM k JOIN b ON b.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT b.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN s ON s.doc_id = b.doc_id
"""
