"""Byte-level BPE encoding and decoding by tree concatenation.

A text up to ``leaf`` characters is encoded in one piece.  A longer one is cut
into halves until the pieces are that short, the pieces are encoded in parallel
threads, and neighbours are joined up the tree:

* All matches of the splitting pattern in the left side, except its last, stay
  what they are in the joined text, because the pattern never looks back and at
  most one character ahead (an apostrophe and a letter at the very end count as
  one match here).  From the start of that last match on, the text is matched
  again until a boundary falls on one of the right side's.
* Where that leaves one match across the join, made of the left side's last and
  the right side's first, its tokens come from a window around the join: the last
  and first ``w`` tokens are encoded again as one run of bytes, ``w`` doubling
  until the outermost tokens on both sides come out as they were.  A sequence of
  byte-pair tokens is an encoding exactly if each adjacent pair is one, so then
  the whole sequence is.

Ids are those of the tokenizers library for the vocabulary file, without special
tokens added and without truncation or padding.  A special token's string inside
a text gets its id, as there.

Defined results: a null text is encoded as the empty one, which has no tokens.
Repeated rows give repeated results, an empty table an empty result; columns
besides doc_id and text are not read.  A row's work needs memory in proportion
to its own text.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .storage import small_batches, table

LEAF = 16_384
THREADS = 2
WINDOW = 8
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Part(NamedTuple):
    """Tokens of text[start:end]; end of the first match and start of the last one, in characters and tokens."""

    start: int
    end: int
    ids: list[int]
    head_end: int
    head_ids: int
    tail_start: int
    tail_ids: int


class Codec:
    def __init__(self, path: str, leaf: int = LEAF, threads: int = THREADS):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in stored["model"]["vocab"].items() if all(c in letters for c in token)}
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        for text in self.special:
            ranks.pop(text.encode(), None)
        merged = [ranks[bytes(letters[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in stored["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError("ids must follow the order of merges")
        self.engine = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.threads = leaf, threads
        self.pattern = regex.compile(PATTERN)
        self.safe = regex.compile(r"(?<=\S)\s")
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.pieces[i] = token
        self.numerals = [str(i).encode() for i in range(size)]

    # -- encoding ---------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not self.cut.search(text):
            return self._ordinary(text)
        ids, at = [], 0
        for m in self.cut.finditer(text):
            ids += self._ordinary(text[at : m.start()])
            ids.append(self.special[m.group()])
            at = m.end()
        return ids + self._ordinary(text[at:])

    def _ordinary(self, text: str) -> list[int]:
        return self.engine.encode_ordinary(text) if len(text) <= self.leaf else self._tree(text)

    def _tree(self, text: str) -> list[int]:
        n = -(-len(text) // self.leaf)
        n = 1 << (n - 1).bit_length()  # halves of halves
        edges = sorted({len(text) * k // n for k in range(n + 1)})
        spans = list(zip(edges, edges[1:], strict=False))
        coded = self.engine.encode_ordinary_batch([text[a:b] for a, b in spans], num_threads=self.threads)
        parts = [self._leaf(text, a, b, ids) for (a, b), ids in zip(spans, coded, strict=True)]
        while len(parts) > 1:
            parts = [self._join(text, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0].ids

    def _leaf(self, text: str, a: int, b: int, ids: list[int]) -> Part:
        head_end = self.pattern.match(text, a, b).end()
        start, back = a, 256
        while b - back > a:
            cuts = [m.start() for m in self.safe.finditer(text, b - back, b)]
            if cuts:
                start = cuts[-1]
                break
            back *= 4
        tail_start = before = start
        for m in self.pattern.finditer(text, start, b):
            before, tail_start = tail_start, m.start()
        if self._open(text, before, tail_start, b):
            tail_start = before
        size = lambda x, y: len(ids) if (x, y) == (a, b) else len(self.engine.encode_ordinary(text[x:y]))
        return Part(a, b, ids, head_end, size(a, head_end), tail_start, len(ids) - size(tail_start, b))

    @staticmethod
    def _open(text: str, before: int, last: int, end: int) -> bool:
        """Whether an apostrophe and one letter end the text: the next letter can make them one match."""
        return last - before == 1 and end - last == 1 and text[before] == "'"

    def _join(self, text: str, left: Part, right: Part) -> Part:
        """Both sides as one part, with the tokens their joined text has."""
        at, other, skipped = left.tail_start, right.start, 0
        fresh: list[tuple[int, int, list[int]]] = []  # matches that are new, with their tokens
        while at != other:
            if at < other:
                end = self.pattern.match(text, at, right.end).end()
                if at == left.tail_start and end == right.head_end:
                    ids = self._across(left.ids[left.tail_ids :], right.ids[: right.head_ids])
                elif at == left.tail_start and end == left.end:
                    ids = left.ids[left.tail_ids :]
                else:
                    ids = self._match(text[at:end])
                fresh.append((at, end, ids))
                at = end
            elif other == right.start:
                other, skipped = right.head_end, right.head_ids
            else:
                end = self.pattern.match(text, other, right.end).end()
                skipped += len(self._match(text[other:end]))
                other = end
        middle = [i for _, _, ids in fresh for i in ids]
        before = left.ids[: left.tail_ids]
        ids = before + middle + right.ids[skipped:]
        if left.tail_start > left.start:
            head_end, head_ids = left.head_end, left.head_ids
        else:
            head_end, head_ids = fresh[0][1], len(fresh[0][2])
        if right.tail_start >= at and at < right.end:
            tail_start, tail_ids = right.tail_start, len(before) + len(middle) + right.tail_ids - skipped
        else:
            tail_start, tail_ids = fresh[-1][0], len(ids) - len(fresh[-1][2])
            fresh.pop()
        if fresh and fresh[-1][1] == tail_start and self._open(text, fresh[-1][0], tail_start, right.end):
            tail_start, tail_ids = fresh[-1][0], tail_ids - len(fresh[-1][2])
        return Part(left.start, right.end, ids, head_end, head_ids, tail_start, tail_ids)

    def _match(self, text: str) -> list[int]:
        """Tokens of one match of the pattern, long ones by halves too."""
        if len(text) <= self.leaf:
            return self.engine._encode_single_piece(text)
        half = len(text) // 2
        return self._across(self._match(text[:half]), self._match(text[half:]))

    def _across(self, a: list[int], b: list[int]) -> list[int]:
        """Tokens of two encoded runs of bytes as one run."""
        w = WINDOW
        while True:
            left, right = a[-w:], b[:w]
            ids = self.engine._encode_single_piece(b"".join(self.pieces[i] for i in left + right))
            if (w >= len(a) or ids[0] == left[0]) and (w >= len(b) or ids[-1] == right[-1]):
                return a[: max(0, len(a) - w)] + ids + b[w:]
            w *= 2

    # -- decoding ---------------------------------------------------------

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str, leaf: int = LEAF) -> Codec:
    """One codec per Python worker and vocabulary."""
    return Codec(path, leaf)


def encode_column(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids array<int>."""
    path = path or vocabulary_path()

    def run(batches):
        c = codec(path, leaf)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_column(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of a table with doc_id, ids; null ids give the empty text."""
    path = path or vocabulary_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded again in one pass, without a shuffle."""
    small_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        c = codec(path, leaf)
        for batch in batches:
            size, coded, back = [], [], []
            for scalar in batch.column(1):
                ids = c.encode(scalar.as_py() or "")
                size.append(len(ids))
                coded.append(hashlib.sha256(b",".join(map(c.numerals.__getitem__, ids))).hexdigest())
                plain = c.decode_bytes(ids)
                try:
                    plain.decode()
                except UnicodeDecodeError:
                    plain = plain.decode("utf-8", errors="replace").encode()
                back.append(hashlib.sha256(plain).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_bpe_codec": op7_bpe_codec}
ORACLES: dict[str, str] = {}
