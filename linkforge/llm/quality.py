"""Quality rules, line first: failing lines go, then documents that lost too much text.

Each line with a word is judged on its own:

- punctuation: too many symbols, shouting, or no sentence end, neither at the line's end nor inside, in a text
  that has sentence ends (scripts and texts that never use any are not held to it);
- navigation: the shape of a list of links, many separators (words without a letter or digit) between words;
- boilerplate: the line stands in many unrelated documents. Such lines are mined from the whole table: a line's
  context in a document is the least hash of the document's other lines, and a line is boilerplate if it has at
  least SAME_LINES different contexts and one for every second document that holds it. Near copies share their
  contexts, so a family of copies makes no boilerplate of its own text. A line that is one word repeated fails too.

A document is kept if it passes the base rules and at most MAX_LOST percent of its words stood in failing lines.

Lines are told apart by a 64-bit hash of their words. Mined lines go to every task while there are at most
BROADCAST_LINES of them; beyond, each text's lines are joined with them, with the same result.

A null text counts as empty: no words, base_failed. Texts are read whole. Repeated rows are judged alike,
extra columns pass through (those named like a result are replaced), an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Stages

MIN_WORDS, MAX_REPEAT, MAX_LOST = 50, 50, 50
SYMBOL_PERCENT, SHOUT_PERCENT, SEPARATOR_PERCENT, SAME_WORD_PERCENT = 8, 30, 25, 50
MIN_LINE_WORDS = 4
"""Shorter lines pass: a heading has too few words to judge."""
SAME_LINES, CONTEXT_PERCENT = 10, 50
BROADCAST_LINES = 2_000_000
SALT = 16
CHUNK = 200_000

SYMBOLS = b"#*$%&|<>"
SEPARATOR = re.compile(r"(?<!\S)[^\w\s]{1,3}(?!\S)")
SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u0964\u06d4\u061f](?:[\"')\]\u201d\u2019\u00bb]*)(?:\s|$)")


def ends_well(line: str) -> bool:
    """Whether a line ends in punctuation that can end a sentence, a quote or a list's head."""
    last = line[-1]
    return last in ".!?:;\"')" or last not in ",#*$%&|<>/\\@-" and unicodedata.category(last) in ("Po", "Pe", "Pf")


def line_key(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def line_fails(line: bytes, words: list[bytes], boilerplate=frozenset(), ended: bool = True) -> bool:
    """Whether a line (UTF-8, with at least one word) breaks a line rule; ``boilerplate`` holds keys of lines,
    ``ended`` tells whether its text has sentence ends."""
    n = len(words)
    if n < MIN_LINE_WORDS:
        return False
    if boilerplate and line_key(words) in boilerplate:
        return True
    if 100 * (len(line) - len(line.translate(None, SYMBOLS))) > SYMBOL_PERCENT * len(line):
        return True
    if b"!!" in line and 100 * line.count(b"!!") > SHOUT_PERCENT * n:
        return True
    text = line.decode().strip()
    if ended and not ends_well(text) and not SENTENCE_END.search(text):
        return True
    if 100 * len(SEPARATOR.findall(text)) > SEPARATOR_PERCENT * n:
        return True
    # a word can only fill more than its share if so many others are repeats
    kinds = len(set(words))
    return n >= 8 and 100 * (n - kinds + 1) > SAME_WORD_PERCENT * n and 100 * max(Counter(words).values()) > SAME_WORD_PERCENT * n


def repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    if v < 2_000_000:
        window = (code[:-2] * v + code[1:-1]) * v + code[2:]
        _, back, count = np.unique(window, return_inverse=True, return_counts=True)
    else:
        _, back, count = np.unique(np.stack([code[:-2], code[1:-1], code[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    hit = count[back.ravel()] > 1
    cover = np.zeros(n, bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


def measure(text: str | None, boilerplate=frozenset()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words, kept lines)."""
    raw = (text or "").encode()
    words: list[bytes] = []
    seen: set[bytes] = set()
    dup = lost = 0
    good = []
    ended = bool(text and SENTENCE_END.search(text))
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            good.append(line)
            continue
        words += own
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_fails(line, own, boilerplate, ended):
            lost += len(own)
        else:
            good.append(line)
    chars = len(text or "") - len(raw) + sum(map(len, words)) if text else 0
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat_words(words), lost, good


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words"]


def keys_of(text: str | None) -> list[int]:
    """Keys of a text's different lines of MIN_LINE_WORDS words or more."""
    return list({line_key(w): None for line in (text or "").encode().split(b"\n") if len(w := line.split()) >= MIN_LINE_WORDS})


def mine_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``line``: keys of lines that stand in many unrelated documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            flat = np.array(list(held), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(list(held.values()), pa.int64())], names=["line", "context", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                keys = keys_of(t)
                if len(keys) > 1:  # a line that is the whole document has no context
                    first, second = sorted(keys)[:2]
                    held.update((k, second if k == first else first) for k in keys)
                    if len(held) >= CHUNK:
                        yield flush()
                        held.clear()
        if held:
            yield flush()

    pairs = docs.select(text).mapInArrow(run, "line long, context long, n long").groupBy("line", "context").agg(F.sum("n").alias("n"))
    lines = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n"))
    return lines.where((F.col("contexts") >= SAME_LINES) & (100 * F.col("contexts") >= CONTEXT_PERCENT * F.col("n"))).select("line")


def held_lines(docs: DataFrame, lines: DataFrame, text: str) -> DataFrame:
    """``_k1, _k2, _lines``: the mined lines that each text holds, texts known by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.array(keys_of(t), np.uint64).view(np.int64) for t in batch.column(2).to_pylist()]
            at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate([*keys, np.empty(0, np.int64)]))], names=["_k1", "_k2", "line"])

    every = docs.select(*text_keys(text), F.col(text)).mapInArrow(run, "_k1 long, _k2 int, line long")
    every = every.withColumn("salt", F.pmod("_k1", F.lit(SALT)).cast("int"))
    side = lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return every.join(side.hint("merge"), ["line", "salt"]).groupBy("_k1", "_k2").agg(F.collect_set("line").alias("_lines"))


def text_keys(text: str) -> list:
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(body).alias("_k1"), F.hash(body).alias("_k2")]


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``clean_text`` (failing lines removed), the counts of FIELDS, ``base_failed`` and ``kept``.

    Lines are mined first; then each row is judged in the task that reads it.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    names = [*FIELDS, "clean_text", "base_failed", "kept"]
    docs = docs.drop(*[n for n in names if n != text])
    position, width = docs.columns.index(text), len(docs.columns)
    lines = stages.put(mine_lines(docs, text))
    few = lines.count() <= BROADCAST_LINES
    shared = spark.sparkContext.broadcast(frozenset(k % 2**64 for k in lines.toArrow().column(0).to_pylist()) if few else frozenset())
    rows = docs
    if not few:
        found = stages.put(held_lines(docs, lines, text))
        k1, k2 = text_keys(text)
        rows = docs.select("*", k1.alias("_t1"), k2.alias("_t2")).join(found, (F.col("_t1") == F.col("_k1")) & (F.col("_t2") == F.col("_k2")), "left")
        rows = rows.select(*[docs[c] for c in docs.columns], "_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(position).to_pylist()
            if few:
                rows = [measure(t, shared.value) for t in texts]
            else:
                rows = [measure(t, {k % 2**64 for k in own or ()}) for t, own in zip(texts, batch.column(width).to_pylist(), strict=True)]
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)]
            cleaned = pa.array([b"\n".join(r[6]).decode() for r in rows], pa.string())
            failed = [r[0] < MIN_WORDS or 100 * r[4] > MAX_REPEAT * r[0] for r in rows]
            kept = [not f and 100 * r[5] <= MAX_LOST * r[0] for f, r in zip(failed, rows)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], *counts, cleaned, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                names=[*batch.schema.names[:width], *names])

    kinds = ", ".join(f"{f} long" for f in FIELDS) + ", clean_text string, base_failed boolean, kept boolean"
    return rows.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(kinds).fields]))


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and verdict for each row, without the texts."""
    out = clean(docs.select(id_col, text), text)
    return out.select(id_col, *FIELDS[:5], "base_failed", "kept")
