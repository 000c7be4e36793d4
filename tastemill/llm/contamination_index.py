"""Benchmark decontamination with an FM-index over each shard of the training text.

A shard is a run of documents of about ``SHARD_BYTES``.  Its words become
symbols; a word that no benchmark phrase has can be part of no occurrence, so it
only separates, and so does a stretch shorter than the shortest phrase.  What is
left is indexed whole: suffix order by prefix doubling, its Burrows-Wheeler
transform in a wavelet matrix with rank counts, and every ``SAMPLE``-th suffix
position.  All phrases are searched backward at once; rows of the resulting
ranges step to the next sampled suffix to give their positions.  Positions become
word spans, spans of a document are merged, and those are to be removed.

Phrases are the runs of ``WINDOW`` words of each benchmark text, or all its words
where it has fewer.  The benchmark goes to the executors in blocks of about
``BLOCK_CHARS`` characters, one pass over a shard for each, so a large one needs
more passes and not more memory.  A document is never cut, so a shard is as large
as the longest document at least.

Defined results: null texts, of documents or items, have no words; an item
without words finds nothing; items that share an id count as one; an id that is
null counts as the string "null".  Repeated rows give repeated results; an empty
benchmark leaves every document clean.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import ALNUM
from .storage import table, unused

WINDOW = 10
SHARD_BYTES = 8 << 20
SAMPLE = 8
BLOCK_CHARS = 8_000_000
FOUND = ("found_words", "found_spans", "found_items")
_END, _GAP, _FIRST = 0, 1, 2
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


class Phrases(NamedTuple):
    """A block of the benchmark: symbols by word, phrases as rows of symbols (the last one in column 0), their items."""

    symbols: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    item: np.ndarray
    names: list[str]


def phrases(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> Phrases:
    symbols: dict[bytes, int] = {}
    names: dict[str, int] = {}
    found: dict[tuple[int, tuple[int, ...]], None] = {}
    for name, text in items:
        w = [symbols.setdefault(x, len(symbols) + _FIRST) for x in words_of(text)]
        if w:
            k = names.setdefault(name, len(names))
            for i in range(max(1, len(w) - window + 1)):
                found[k, tuple(w[i : i + window])] = None
    lengths = np.array([len(p) for _, p in found], np.int64)
    rows = np.zeros((len(found), window), np.int64)
    for i, (_, p) in enumerate(found):
        rows[i, : len(p)] = p[::-1]
    return Phrases(symbols, rows, lengths, np.array([k for k, _ in found], np.int64), list(names))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order; the text ends in a symbol that is smaller than all others and only there."""
    n = len(text)
    rank = text.astype(np.int64)
    bits = max(1, int(rank.max()).bit_length())
    k = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)  # the first k symbols in one number
    for j in range(k):
        key <<= bits
        key[: n - j] |= rank[j:]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        k *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        order = suffix_order(text)
        n = len(text)
        last = text[order - 1]
        self.n = n
        self.depth = max(1, int(text.max()).bit_length())
        count = np.bincount(text, minlength=(1 << self.depth) + 1)
        self.before = np.concatenate([[0], np.cumsum(count)])  # symbols smaller than each
        self.levels: list[tuple[np.ndarray, int]] = []  # ones before each place, zeros of the level
        now = last
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            self.levels.append((ones, n - int(ones[-1])))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.origin = self._descend(np.arange(1 << self.depth), np.zeros(1 << self.depth, np.int64))
        self.marked = order % sample == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.sampled = order[self.marked]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - k)) & 1
            up = ones[at]
            at = np.where(one == 1, zeros + up, at - up)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        return self._descend(symbol, at) - self.origin[symbol]

    def search(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which phrases occur, and the range of suffixes that begin with each."""
        alive = np.arange(len(rows))
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        for j in range(rows.shape[1]):
            live = lengths[alive] > j
            step = alive[live]
            c = rows[step, j]
            known = c < len(self.origin)
            c = np.where(known, c, 0)
            low[step] = np.where(known, self.before[c] + self.rank(c, low[step]), 0)
            high[step] = np.where(known, self.before[c] + self.rank(c, high[step]), 0)
            alive = alive[low[alive] < high[alive]]
        return alive, low[alive], high[alive]

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by their places in the order."""
        out, steps = np.empty(len(at), np.int64), 0
        todo, at = np.arange(len(at)), at.copy()
        while len(todo):
            done = self.marked[at]
            out[todo[done]] = self.sampled[self.mark_rank[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            symbol = np.zeros(len(at), np.int64)
            place = at
            for ones, zeros in self.levels:
                up = ones[place]
                one = ones[place + 1] - up
                symbol = symbol << 1 | one
                place = np.where(one == 1, zeros + up, place - up)
            at = self.before[symbol] + place - self.origin[symbol]
            steps += 1
        return out


class Found(NamedTuple):
    n_words: int
    spans: np.ndarray  # merged word spans, one row each: start, end
    items: list[str]


def _stretches(symbol: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The indexed text, a gap after each stretch and the end after all, and each symbol's word number."""
    edge = np.flatnonzero(np.diff(symbol > 0, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    start, size = start[long], (end - start)[long] + 1
    at = np.arange(size.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)
    text = np.append(symbol, 0)[at]
    text[text == 0] = _GAP
    return np.append(text, _END), at


def scan_shard(texts: list[bytes | None], book: Phrases, sample: int = SAMPLE) -> list[Found]:
    """What each of a shard's texts has of the phrases."""
    get = book.symbols.get
    parts, sizes = [], []
    for t in texts:
        own = [get(w, 0) for w in words_of(t)]
        sizes.append(len(own))
        own.append(0)
        parts.append(np.array(own, np.int64))
    first = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
    symbol = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    empty = np.zeros((0, 2), np.int64)
    results = [Found(n, empty, []) for n in sizes]
    if not len(book.lengths):
        return results
    text, number = _stretches(symbol, int(book.lengths.min()))
    if not len(number):
        return results
    index = FMIndex(text, sample)
    phrase, low, high = index.search(book.rows, book.lengths)
    if not len(phrase):
        return results
    # Phrases of several items have one range: it is located once.
    ranges, which = np.unique(np.stack([low, high, book.lengths[phrase]], 1), axis=0, return_inverse=True)
    many = ranges[:, 1] - ranges[:, 0]
    at = np.repeat(ranges[:, 0] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    begin = number[index.locate(at)]
    of_range = np.repeat(np.arange(len(ranges)), many)
    change = np.zeros(len(symbol) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + ranges[of_range, 2], -1)
    hit = np.cumsum(change) > 0
    edge = np.flatnonzero(np.diff(hit, prepend=False, append=False))
    spans = np.stack([edge[::2], edge[1::2]], 1)
    owner = np.searchsorted(first, spans[:, 0], side="right") - 1
    # Distinct (document, range), then the items of each range.
    pairs = np.unique(np.stack([np.searchsorted(first, begin, side="right") - 1, of_range], 1), axis=0)
    items_of: list[list[int]] = [[] for _ in ranges]
    for p, r in zip(phrase, which.ravel(), strict=True):
        items_of[r].append(int(book.item[p]))
    named: dict[int, set[str]] = {}
    for doc, r in pairs.tolist():
        named.setdefault(doc, set()).update(book.names[k] for k in items_of[r])
    for doc in np.unique(owner).tolist():
        results[doc] = Found(sizes[doc], spans[owner == doc] - first[doc], sorted(named[doc]))
    return results


def _blocks(benchmark: DataFrame, chars: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The benchmark in blocks of about so many characters."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // chars))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k) if n > 1 else items
        yield sorted((r.i, r.text.encode()) for r in block.collect())


def _union(a: list[tuple[int, int]], b: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted([*a, *map(tuple, b.tolist())]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with n_words, spans (merged, in words, as starts and ends in turn) and items as last columns.

    They are named found_words, found_spans and found_items, or otherwise where ``docs`` has such columns.
    """
    names = unused(docs.columns, *FOUND)
    kinds = F.lit(0).cast("long"), F.array().cast("array<long>"), F.array().cast("array<string>")
    out = docs.select("*", *(kind.alias(name) for name, kind in zip(names, kinds, strict=True)))
    at = out.columns.index("text")
    shape = out.schema
    for block in _blocks(benchmark, block_chars):  # one block of the benchmark at a time is here
        book = docs.sparkSession.sparkContext.broadcast(phrases(block, window))

        def run(batches, book=book):
            for batch in batches:
                done, rows = [], batch.num_rows
                shard: list[bytes | None] = []
                size = 0
                for i, scalar in enumerate(batch.column(at).cast(pa.binary())):
                    shard.append(scalar.as_py())
                    size += len(shard[-1] or b"")
                    if size >= shard_bytes or i == rows - 1:
                        done += scan_shard(shard, book.value)
                        shard, size = [], 0
                spans, items = [], []
                for f, s, x in zip(done, batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    spans.append([v for pair in _union(list(zip(s[::2], s[1::2], strict=True)), f.spans) for v in pair] if len(f.spans) else s)
                    items.append(sorted({*x, *f.items}) if f.items else x)
                cols = [*batch.columns[:-3], pa.array([f.n_words for f in done], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

        out = out.mapInArrow(run, shape)
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = occurrences(docs.select("doc_id", "text"), benchmark, window, block_chars)
    hit = F.aggregate(
        F.sequence(F.lit(0), F.size("found_spans") - 1, F.lit(1)),
        F.lit(0).cast("long"),
        lambda total, i: total + F.when(i % 2 == 0, -F.get("found_spans", i)).otherwise(F.get("found_spans", i)),
    )
    return found.select(
        "doc_id",
        F.col("found_words").alias("n_words"),
        F.when(F.size("found_spans") > 0, hit).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.size("found_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("found_spans") > 0).alias("contaminated"),
    )


def removal_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, end: merged spans in code points, from the first character of a span's words to the last."""
    found = occurrences(docs.select("doc_id", "text"), benchmark, window).where(F.size("found_spans") > 0)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, start, end = [], [], []
            for i, (text, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                lower = text.translate({k: k + 32 for k in range(65, 91)})
                places = [m.span() for m in _WORD.finditer(lower)]
                for s, e in zip(spans[::2], spans[1::2], strict=True):
                    rows.append(i)
                    start.append(places[s][0])
                    end.append(places[e - 1][1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "start", "end"])

    return found.select("doc_id", "text", "found_spans").mapInArrow(run, f"doc_id {kind}, start long, end long")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which any phrase occurs, all columns unchanged."""
    found = occurrences(docs, benchmark, window)
    return found.where(F.size(found.columns[-2]) == 0).select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw))
), hits AS (
  SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size
), marked AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES = {"op6_decontaminate": ORACLE}
