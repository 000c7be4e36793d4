"""A byte-pair tokenizer of path texts: trained on weighted segments, applied segment by segment.

Merges never touch the special tokens, space and slash among them, so a text
falls into segments between those, and training needs each distinct segment once
with its number of occurrences.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The first ids.
SPECIAL = ("<UNK>", "<EOL>", "<ROOT>", " ", "/")
UNK, EOL, ROOT = 0, 1, 2
MOST_SEGMENTS = 2_000_000


class Tokenizer(NamedTuple):
    vocabulary: tuple[str, ...]
    merges: tuple[tuple[int, int, int], ...]


def segments(texts: DataFrame, column: str = "text") -> DataFrame:
    """segment, weight of the texts' segments."""
    parts = texts.select(F.explode(F.split(F.col(column), "[ /]")).alias("segment")).where("segment <> ''")
    return parts.groupBy("segment").agg(F.count("*").alias("weight"))


def pair_counts(weighted: DataFrame) -> DataFrame:
    """a, b, count of adjacent characters over all segments; overlapping pairs each count."""
    chars = weighted.select("weight", F.filter(F.split("segment", ""), lambda c: c != "").alias("t")).where(F.size("t") > 1)
    n = F.size("t")
    pairs = chars.select("weight", F.explode(F.arrays_zip(F.slice("t", F.lit(1), n - 1).alias("a"), F.slice("t", F.lit(2), n - 1).alias("b"))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("weight").alias("count"))


def top_pair(counts: DataFrame) -> DataFrame:
    """The most frequent pair; of equal ones the greatest."""
    return counts.agg(F.max(F.struct("count", "a", "b")).alias("m")).select("m.a", "m.b", "m.count")


def replaced(tokens: list[int], a: int, b: int, new: int) -> list[int]:
    """Every pair a, b from left to right, without overlap, as one token."""
    out, k = [], 0
    while k < len(tokens):
        if k + 1 < len(tokens) and tokens[k] == a and tokens[k + 1] == b:
            out.append(new)
            k += 2
        else:
            out.append(tokens[k])
            k += 1
    return out


def train(texts: DataFrame, column: str = "text", most_segments: int = MOST_SEGMENTS) -> Tokenizer:
    """Vocabulary and merges of a corpus.

    Characters get ids in order of their first appearance in the sorted corpus.
    The merge loop runs on the driver over distinct segments, up to
    ``most_segments`` of them; a corpus with more is an error, to be answered by a
    larger bound or a smaller corpus of paths.
    """
    stats = texts.agg(F.count("*").alias("n")).first()
    weighted = segments(texts, column)
    rows = weighted.orderBy("segment").limit(most_segments + 1).collect()
    if len(rows) > most_segments:
        raise ValueError(f"more than {most_segments} distinct segments")
    letters: dict[str, None] = {}
    first = texts.select(F.col(column).alias("t")).distinct()
    chars = first.select("t", F.posexplode(F.filter(F.split("t", ""), lambda c: ~c.isin("", " ", "/")))).groupBy("col").agg(F.min(F.struct("t", "pos")).alias("m"))
    for r in chars.orderBy("m").select("col").collect():  # a row for each character of the alphabet
        letters[r.col] = None
    return merge_loop([(r.segment, r.weight) for r in rows], list(letters), stats.n)


def merge_loop(weighted: list[tuple[str, int]], letters: list[str], n_texts: int) -> Tokenizer:
    vocabulary = [*SPECIAL, *letters]
    ids = {t: i for i, t in enumerate(vocabulary)}
    least = max(2, (n_texts + 1).bit_length() - 1)
    words = [[ids[c] for c in s] for s, _ in weighted]
    weight = [w for _, w in weighted]
    counts: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k, w in enumerate(words):
        for pair in zip(w, w[1:], strict=False):
            counts[pair] += weight[k]
            where[pair].add(k)
    heap = [(-c, -a, -b) for (a, b), c in counts.items()]
    heapq.heapify(heap)
    merges = []
    while heap:
        c, a, b = (-x for x in heapq.heappop(heap))
        if counts.get((a, b), 0) != c:
            continue  # an older count
        if c < least:
            break
        text = vocabulary[a] + vocabulary[b]
        new = ids.setdefault(text, len(vocabulary))
        if new == len(vocabulary):
            vocabulary.append(text)
        merges.append((a, b, new))
        changed = set()
        for k in sorted(where.pop((a, b))):
            before = words[k]
            words[k] = after = replaced(before, a, b, new)
            if len(after) == len(before):
                continue
            for seq, sign in ((before, -1), (after, 1)):
                for pair in zip(seq, seq[1:], strict=False):
                    counts[pair] += sign * weight[k]
                    changed.add(pair)
                    if sign > 0:
                        where[pair].add(k)
        for pair in changed:
            if counts[pair] <= 0:
                counts.pop(pair, None)
            else:
                heapq.heappush(heap, (-counts[pair], -pair[0], -pair[1]))
        counts.pop((a, b), None)
    return Tokenizer(tuple(vocabulary), tuple(merges))


class Applied:
    def __init__(self, tokenizer: Tokenizer):
        self.ids = {t: i for i, t in enumerate(tokenizer.vocabulary)}
        self.merges = {(a, b): (rank, new) for rank, (a, b, new) in reversed(list(enumerate(tokenizer.merges)))}
        self.segment = lru_cache(maxsize=100_000)(self._segment)

    def _segment(self, text: str) -> tuple[int, ...]:
        """Merges in rank order, each over the whole segment, as applying all of them one after another does."""
        tokens, done = [self.ids.get(c, UNK) for c in text], -1
        while len(tokens) > 1:
            due = [(r, a, b, new) for a, b in zip(tokens, tokens[1:], strict=False) for r, new in (self.merges.get((a, b), (-1, 0)),) if r > done]
            if not due:
                break
            done, a, b, new = min(due)
            tokens = replaced(tokens, a, b, new)
        return tuple(tokens)

    def text(self, text: str) -> list[int]:
        out, part = [ROOT], []
        for c in text:
            if c in " /":
                if part:
                    out += self.segment("".join(part))
                    part = []
                out.append(self.ids[c])
            else:
                part.append(c)
        return [*out, *(self.segment("".join(part)) if part else ()), EOL]


def tokenize(rows: DataFrame, tokenizer: Tokenizer, column: str = "text", out: str = "tokens") -> DataFrame:
    """``rows`` and the token ids of a text column; unknown characters are <UNK>."""
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer)  # bounded: minted from at most MOST_SEGMENTS segments
    at = rows.columns.index(column)

    def run(batches):
        applied = Applied(shared.value)
        for batch in batches:
            ids = pa.array([applied.text(t or "") for t in batch.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, out])

    return rows.mapInArrow(run, _with(rows, out))


def _with(rows: DataFrame, out: str):
    from pyspark.sql import types as T

    return T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])


def vocabulary_table(spark, tokenizer: Tokenizer) -> DataFrame:
    return spark.createDataFrame([(t, i, i < len(SPECIAL)) for i, t in enumerate(tokenizer.vocabulary)], "token string, id int, special boolean")


def merges_table(spark, tokenizer: Tokenizer) -> DataFrame:
    return spark.createDataFrame([(r, *m) for r, m in enumerate(tokenizer.merges)], "rank int, a int, b int, merged int")
