"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on hashed byte 5-grams (of the lower-cased text, with runs
of other characters as spaces) learns from confirmed toxic texts and from
unlabelled ones.  With the class prior p, the risk of a classifier f is

    p R+(f on toxic)  +  max(0, R-(f on unlabelled) - p R-(f on toxic))

that is, the toxic share hidden in the unlabelled texts is taken out of the risk
of calling them clean, and that part never counts below zero.  The loss is
logistic; an accelerated proximal gradient method in numpy minimises the risk
plus an L1 penalty.  Only grams that are clearly more frequent among the toxic
texts take part.  The prior is the toxic share of the labelled rows that
training may see, times ``MARGIN``, since toxic texts may lack labels.

Bounds of training, all parameters: ``POSITIVES`` toxic and ``UNLABELLED`` other
texts, those with the smallest hash of their id; a text that several of them
share counts once.  Their distinct grams are written to the shared folder and
counted there; the driver gets the columns that take part and, of each example,
which of those it has.  Everything else, scoring above all, reads every row and
whole texts, piece by piece where they are long.

Labels are used only from rows whose crc32 of the id modulo ``FOLDS`` is not 0;
texts of the other rows take no part in training.  Null texts count as empty and
get the score of a text without words; null ids belong to no fold and are held
out.  Repeated rows give repeated results, and an empty table an empty one.
Without any toxic label every score is 0.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import ALNUM, CHUNK
from .storage import settled, table

BITS = 18
FOLDS = 5
POSITIVES = 1500
UNLABELLED = 4500
MARGIN = 1.1
STEPS = 300
RATE = 1.0
PENALTY = 1e-3
GRAM = 5
#: Toxic examples that must have a column.
LEAST = 3


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _grams(data: bytes) -> np.ndarray:
    """The column of the gram at each offset."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(raw) - GRAM + 1
    packed = raw[GRAM - 1 :].copy()
    for k in range(GRAM - 1):
        packed |= raw[k : k + n] << np.uint64(8 * (GRAM - 1 - k))
    return ((packed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def _blocks(texts):
    """Texts joined to blocks of about CHUNK bytes: (bytes, start offset of each text in it, its number).

    A longer text is spread over several blocks that overlap by less than a gram.
    """
    group, starts, numbers, size = [], [], [], 0
    for i, text in enumerate(texts):
        text = b"     " + (text or b"").translate(ALNUM) + b"     "
        for at in range(0, len(text), CHUNK):
            piece = text[max(0, at - GRAM + 1) : at + CHUNK]
            group.append(piece)
            starts.append(size)
            numbers.append(i)
            size += len(piece)
            if size >= CHUNK:
                yield b"".join(group), starts, numbers
                group, starts, numbers, size = [], [], [], 0
    if group:
        yield b"".join(group), starts, numbers


def gram_columns(texts, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and column of every distinct gram of each text; only columns that are ``wanted``."""
    found = []
    for data, starts, numbers in _blocks(texts):
        col = _grams(data)
        at = np.arange(len(col)) if wanted is None else np.flatnonzero(wanted[col])
        row = np.asarray(numbers)[np.searchsorted(starts, at, side="right") - 1]
        found.append(np.unique(row << BITS | col[at]))
    key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


def _features(docs: DataFrame) -> DataFrame:
    """cols binary (int32 values), their digest and y: the distinct grams of each text."""

    def run(batches):
        for batch in batches:
            cols = []
            for scalar in batch.column(0).cast(pa.binary()):
                cols.append(gram_columns([scalar.as_py()])[1].astype("<i4").tobytes())
            digest = [hashlib.blake2b(c, digest_size=16).digest() for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(cols, pa.binary()), pa.array(digest, pa.binary()), batch.column(1)], ["cols", "digest", "y"])

    return docs.select("text", "y").mapInArrow(run, "cols binary, digest binary, y int")


def _counted(rows: DataFrame) -> DataFrame:
    """col, c_p, c_u: how many toxic and other examples have a column; -1 stands for all examples."""

    def run(batches):
        total = np.zeros((2, 1 << BITS), np.int64)
        n = np.zeros(2, np.int64)
        for batch in batches:
            for scalar, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total[y][np.frombuffer(scalar.as_py(), "<i4")] += 1  # columns of a text are distinct
                n[y] += 1
        at = np.flatnonzero(total.any(0))
        cols = [np.append(-1, at), np.append(n[1], total[1][at]), np.append(n[0], total[0][at])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["col", "c_p", "c_u"])

    parts = rows.select("cols", "y").mapInArrow(run, "col long, c_p long, c_u long")
    return parts.groupBy("col").agg(F.sum("c_p").alias("c_p"), F.sum("c_u").alias("c_u"))


def _kept(rows: DataFrame, names: np.ndarray) -> DataFrame:
    """Of each example the places in ``names`` of the columns it has."""
    names = names.astype("<i4")

    def run(batches):
        for batch in batches:
            out = []
            for scalar in batch.column(0):
                own = np.frombuffer(scalar.as_py(), "<i4")
                out.append(np.flatnonzero(np.isin(names, own)).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1), batch.column(2)], ["cols", "digest", "y"])

    return rows.select("cols", "digest", "y").mapInArrow(run, "cols binary, digest binary, y int")


def _sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int):
    """The columns that take part, each example's share of them, y (1: toxic, 0: unlabelled) and the prior."""
    seen = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    seen = seen.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    prior = seen.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    toxic = seen.where("toxic").select("doc_id").orderBy(F.xxhash64(F.lit(11), "doc_id")).limit(positives)
    # Any row that training may see; whether it has a label, and which, is not looked at.
    others = docs.where(~held_out(F.col("doc_id"))).select("doc_id").orderBy(F.xxhash64(F.lit(13), "doc_id")).limit(unlabelled)
    picked = [(r[0], 1) for r in toxic.collect()] + [(r[0], 0) for r in others.collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = docs.sparkSession.createDataFrame(picked, f"doc_id {kind}, y int")
    found = _features(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id"))
    rows = settled(found.dropDuplicates(["y", "digest"]), "sample").coalesce(8)  # bounded, so a few tasks are enough
    counts = _counted(rows)
    least = counts.where((F.col("c_p") >= LEAST) | (F.col("col") < 0)).orderBy("col").toArrow()
    col, c_p, c_u = (least.column(k).to_numpy() for k in range(3))
    if not len(col) or not c_p[0] or not c_u[0] or prior <= 0:
        return np.zeros(0, np.int64), [], np.zeros(0, int), 0.0
    names = col[1:][clear_columns(c_p[1:], c_u[1:], int(c_p[0]), int(c_u[0]))]
    table = _kept(rows, names).toArrow().sort_by([("y", "ascending"), ("digest", "ascending")])
    kept = [np.frombuffer(x.as_py(), "<i4") for x in table.column("cols")]
    return names, kept, table.column("y").to_numpy().astype(int), float(prior)


def clear_columns(c_p: np.ndarray, c_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Which columns are clearly more frequent among n_p toxic texts than among n_u others."""
    s_p, s_u = c_p / n_p, c_u / n_u
    clear = (s_p - s_u) / np.sqrt((s_u * (1 - s_u) + 1e-3) / n_p)
    return np.flatnonzero((c_p >= LEAST) & (clear >= 5) & (s_p >= 3 * s_u))


def risk(v: np.ndarray, bias: float, cols: np.ndarray, where: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, np.ndarray, float]:
    """The corrected risk without the penalty, and its gradient by weights and bias; held at zero, the clean part has none."""
    toxic, other = y == 1, y == 0
    z = np.bincount(where, v[cols], len(y)) + bias
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    clean = np.logaddexp(0, z[other]).mean() - prior * np.logaddexp(0, z[toxic]).mean()
    # Derivatives of the logistic losses: s - 1 where a text is called toxic, s where clean.
    g = np.where(toxic, prior * (s - 1) / toxic.sum(), 0.0)
    if clean >= 0:
        g += np.where(toxic, -prior * s / toxic.sum(), s / other.sum())
    return prior * np.logaddexp(0, -z[toxic]).mean() + max(0.0, clean), np.bincount(cols, g[where], len(v)), g.sum()


def descend(names: np.ndarray, kept: list[np.ndarray], y: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """The classifier of least corrected risk; examples are given by places in ``names``; nothing is toxic without toxic examples."""
    weights = np.zeros(1 << BITS, np.float32)
    toxic = y == 1
    n_p, n_u = int(toxic.sum()), int((~toxic).sum())
    if not n_p or not n_u or prior <= 0:
        return Model(weights, -np.inf)
    prior = min(0.99, prior * MARGIN)
    cols = np.concatenate(kept).astype(np.int64)
    where = np.repeat(np.arange(len(kept)), [len(r) for r in kept])
    # The step stays below the inverse curvature, which a few power iterations estimate.
    share = np.where(toxic, 2 * prior / n_p, 1 / n_u)
    probe, bend = np.ones(len(names) + 1), 1.0
    for _ in range(12):
        probe /= np.sqrt((probe**2).sum())
        along = share * (np.bincount(where, probe[cols], len(kept)) + probe[-1])
        probe = np.append(np.bincount(cols, along[where], len(names)), along.sum())
        bend = max(1e-9, 0.25 * np.sqrt((probe**2).sum()))
    rate = min(rate, 1 / bend)
    w = v = np.zeros(len(names))
    # A text without any of the grams is not likelier toxic than the prior has it.
    b = vb = ceiling = float(np.log(prior / (1 - prior)))
    t = 1.0
    for _ in range(steps):
        _, slope, lift = risk(v, vb, cols, where, y, prior)
        step = v - rate * slope
        step = np.sign(step) * np.maximum(0, np.abs(step) - rate * penalty)
        bias = min(ceiling, vb - rate * lift)
        longer = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = 0.9 * (t - 1) / longer
        v, vb = step + pull * (step - w), bias + pull * (bias - b)
        w, b, t = step, bias, longer
    weights[names] = w
    return Model(weights, float(b))


def fit(rows: list[np.ndarray], y: np.ndarray, prior: float) -> Model:
    """The same from the columns of every example, for samples that are at hand."""
    n_p, n_u = int((y == 1).sum()), int((y == 0).sum())
    if not n_p or not n_u:
        return descend(np.zeros(0, np.int64), [], y, 0.0)
    count = lambda own: np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(own)]), minlength=1 << BITS)
    names = clear_columns(count(y == 1), count(y == 0), n_p, n_u)
    place = np.full(1 << BITS, -1, np.int64)
    place[names] = np.arange(len(names))
    return descend(names, [place[r][place[r] >= 0] for r in rows], y, prior)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    return descend(*_sample(docs, labels, positives, unlabelled))


def logits(texts: list[bytes | None], model: Model) -> np.ndarray:
    row, col = gram_columns(texts, model.weights != 0)
    return np.bincount(row, model.weights[col], len(texts)) + model.bias


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: each whole text's, from the words alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            z = logits(batch.column(1).cast(pa.binary()).to_pylist(), shared.value)
            p = np.exp(-np.logaddexp(0, -z))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            z = logits(batch.column(at).cast(pa.binary()).to_pylist(), shared.value)
            p = np.exp(-np.logaddexp(0, -z))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity_pu": op1_toxicity_pu}
ORACLES: dict[str, str] = {}
