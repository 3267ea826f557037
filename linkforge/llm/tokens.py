"""Token counts: pieces are counted once for each distinct pre-token and joined to per-document frequencies.

A text is split into pre-tokens as the tokenizer does it. A first pass gathers the distinct pre-tokens of the
whole table with their frequencies, and the tokenizer is asked for the pieces of each of them once. A second
pass makes each document's frequencies of pre-tokens and joins them to that table: the COMMON most frequent
pre-tokens (COMMON_BYTES at most) go to every task and are joined there, so no row of a frequent word is ever
shuffled; what is left, rare words only, is joined by shuffle. A document's count is the sum of frequency times
pieces. Ids are never made. Special tokens that stand in a text count as one token, as in the library's default.

A null text counts as empty (0 tokens). Repeated rows are counted alike, extra columns are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages

LIMIT = 2048
MEMO = 400_000
LONG = 200
"""A worker's memory of pieces: entries, and the longest pre-token it keeps. It only saves asking again."""
CHUNK_BYTES = 32 << 20
"""A task hands its distinct pre-tokens on when they take so much."""
COMMON, COMMON_BYTES = 200_000, 16 << 20
ODD = re.compile("[^\\t-\\r -~\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u012f\\u0131-\\u024f]")
"""Characters for which the standard library's character classes or case could differ from the
tokenizer's; a text without them is split by ``re``, any other by the tokenizer's own normalizer and
Unicode classes."""
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
"""The Split pattern that PLAIN stands for; with another one, every text takes the general way."""


class PieceCounter:
    """Counts tokens by way of pre-token frequencies, for a ``tokenizers`` JSON file whose pre-tokenizer is a
    Split (matches kept) before ByteLevel, and whose normalizer folds white space and case."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [re.escape(a["content"]) for a in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        kinds = spec["pre_tokenizer"]["pretokenizers"]
        pattern = kinds[0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.plain = pattern == PATTERN
        self.normalize = t.normalizer.normalize_str
        self.memo: dict[str, int] = {}
        # ByteLevel shows printable Latin-1 bytes as themselves and all others as code points from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(hidden)}

    def pieces(self, word: str, mapped: str | None = None) -> int:
        """Pieces of one pre-token, asked of the merge table alone; ``mapped`` is its ByteLevel form."""
        if mapped is None:
            mapped = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.alphabet)
        n = len(self.tokenizer.model.tokenize(mapped))
        if len(word) <= LONG:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = n
        return n

    def split_beyond(self, part: str) -> list[str]:
        """Pre-tokens of a text with characters beyond the basic plane, where the library's Unicode tables may
        differ from ours, split by the library; marked by a line feed, which no other pre-token has."""
        return ["\n" + w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.normalize(part))]

    def split(self, text: str) -> tuple[int, list[str]]:
        """(special tokens, pre-tokens) of a text."""
        special, parts, out = 0, [text], []
        if self.special and "<|" in text:
            special = len(self.special.findall(text))
            parts = self.special.split(text)
        for part in parts:
            if not part:
                continue
            if self.plain and not ODD.search(part):
                out += PLAIN.findall(part.lower())
            elif max(part) > "\uffff":
                out += self.split_beyond(part)
            else:
                out += self.words.findall(self.normalize(part))
        return special, out

    def of(self, word: str) -> int:
        """Pieces of a pre-token as ``split`` gives it."""
        n = self.memo.get(word)
        return self.pieces(word, word[1:] if word[0] == "\n" else None) if n is None else n

    def count(self, text: str) -> int:
        """Tokens of one text, by way of the worker's memory alone."""
        total, words = self.split(text)
        known = self.memo.get
        for word, times in Counter(words).items():
            n = known(word)
            total += times * (self.of(word) if n is None else n)
        return total


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One counter for each worker process, shared by its tasks."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def pre_tokens(texts: DataFrame, path: str | None = None) -> DataFrame:
    """``word, n, pieces``: the distinct pre-tokens of a column of texts, how often they stand there, and their
    pieces, each asked for once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path or vocabulary())
        held: Counter = Counter()
        size = seen = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = c.split(text or "")[1]
                held.update(words)
                size += len(text or "")
                if size - seen > CHUNK_BYTES // 8:  # distinct words are measured only now and then
                    seen = size
                    if sum(map(len, held)) + 60 * len(held) > CHUNK_BYTES:
                        yield flush()
                        held.clear()
        if held:
            yield flush()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path or vocabulary())
        for batch in batches:
            n = [c.of(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["word", "n", "pieces"])

    words = texts.mapInArrow(gather, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(ask, "word string, n long, pieces long")


def most_common(table: DataFrame) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens, COMMON of them and COMMON_BYTES at most."""
    out, room = {}, COMMON_BYTES
    for r in table.orderBy(F.desc("n"), "word").limit(COMMON).select("word", "pieces").toLocalIterator():
        room -= len(r.word.encode()) + 16
        if room < 0:
            break
        out[r.word] = r.pieces
    return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """A row for each document: ``<id>, n_bytes, n_tokens, over_limit``."""
    spark = docs.sparkSession
    stages = Stages(spark)
    table = stages.put(pre_tokens(docs.select(text), path))
    shared = spark.sparkContext.broadcast(most_common(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, pieces = counter(path or vocabulary()), shared.value.get
        rest = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))
        for batch in batches:
            size, count, rare = [], [], []
            for t in batch.column(2).to_pylist():
                t = t or ""
                total, words = c.split(t)
                left = []
                for word, times in Counter(words).items():
                    n = pieces(word)
                    if n is None:
                        left.append({"word": word, "times": times})
                    else:
                        total += times * n
                size.append(len(t) if t.isascii() else len(t.encode()))
                count.append(total)
                rare.append(left)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(rare, rest)],
                names=["_row", "_id", "n_bytes", "known", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    rows = stages.put(rows.mapInArrow(run, f"_row long, _id {kind}, n_bytes long, known long, rare array<struct<word:string,times:long>>"))
    rare = rows.select("_row", F.explode("rare").alias("x")).select("_row", "x.word", "x.times").join(table.select("word", "pieces"), "word")
    more = rare.groupBy("_row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return rows.drop("rare").join(more, "_row", "left").select(
        F.col("_id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
