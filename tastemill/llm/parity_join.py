"""Near-duplicate join: parity sketches, matched by pigeonhole within size bands, then verified.

A text is the set of its distinct word shingles (hashed to 64 bits).  Each
shingle flips one bit of a sketch, so two sketches differ in at most as many bits
as the sets have elements that are not shared.  Two sets of sizes a and b with
Jaccard similarity t or more differ in at most d = (1-t)/(1+t) (a+b) elements; a
band of sizes has one d, its sketch has d+r blocks, and two linked sets must
agree in at least r blocks.  A set is entered in its own band and, where a
smaller partner can be in the band below, in that one too.  A block is 2**32 bits
wide, so few bits are set and it is kept as what a join compares: the XOR of a
64-bit hash of each odd bit's place, in which two flips of a bit cancel out.

Blocks without a bit are empty in many unrelated sets.  A set with fewer than r
of them is entered by its other blocks only, for one of those is among the r.  A
set with r or more is also entered by its empty blocks: if linked sets agree in
empty blocks only, these are at least r of either's, so the first ones of both,
all but r - k, share at least k, and each choice of k of them is a key.

Keys that agree, as often as they must, gather sets into coarse clusters, which
can't cut a link.  In
a cluster, links are decided exactly: relative to a pivot set, each set is what
it lacks and what it adds, and |A ^ B| = |dA| + |dB| - 2 |dA & dB|.  Sets linked
to the pivot need no comparison among themselves, since only connectedness is
asked for.

A cluster above ``TASK_DOCS`` sets or ``TASK_SHINGLES`` shingles, bounds of a
task's memory, is dealt to chunks.  First each chunk is decided by itself together
with one set of the cluster that all its chunks get, which connects a group of
near copies over all chunks with each text shipped once.  Then only sets that are
not connected with the cluster's largest group so far, the rest, are compared
with the sets of every chunk, a chunk of the rest at a time.  So a group's work
is spread and its results stay whole, and texts are shipped again only in the
measure in which a cluster was too coarse.

Equal sets are one class from the start; a class is represented by its smallest
id, and a task enters a set's keys once, so thousands of copies cost little.  A
text fetched by its id is held against the class's digest, so ids that repeat
with other texts do no harm.  No step gathers a key's rows: counts and minima are
pre-aggregated, and rows return to their class by a salted join.

Keys take more room than all else, so many of them are matched in parts, by their
hash, one part after another.  A key is in one part only, and pairs are counted
over all parts, so parts change no result; only one part is shuffled at a time.

Defined results: a text without words, or null, has no shingles, is linked to
nothing and is its own component; with fewer words than a shingle takes, the
whole sequence is the one shingle.  Repeated rows are linked like other copies;
an id that repeats with different texts keeps the links of each.  Ids may be of
any type with an order.  Rows whose id is null are never linked; their component
is null.  Very long texts are hashed piece by piece.  Columns besides doc_id and
text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .hashing import WHITE, hashed, mixed, sliced
from .storage import discard, matching, settled, small_batches, table, text_mark, written_bytes

WORDS = 5
SIMILARITY = (80, 100)
BAND = 1.25
TOGETHER = 4
TASK_DOCS = 4096
TASK_SHINGLES = 4_000_000
SALTS = 32
KEY_SETS = 64
#: Keys up to which a sieve is made, of SIEVE_BITS bits for each.
SIEVED, SIEVE_BITS = 1 << 24, 16
#: Bytes of written profiles that a part of the keys should have, and the most parts.
PART_BYTES, MOST_PARTS = 1 << 28, 8
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashed runs of k words, sorted; the whole sequence where it is shorter."""
    n = len(words)
    if n == 0:
        return words
    w = min(n, k)
    total = np.zeros(n - w + 1, np.uint64)
    for j in range(w):
        total += mixed(words[j : n - w + 1 + j] + _ODD[j % 8]) * (_ODD[(j + w) % 8] + np.uint64(2 * (j // 8)))
    return np.unique(mixed(total + np.uint64(w)))


def shingle_sets(texts, k: int):
    """The shingle set of each text, one after another."""
    for n, words, ends in hashed(texts, WHITE):
        at = 0
        for i in range(n):
            yield _shingles(words[at : ends[i]], k)
            at = ends[i]


class Bands:
    """Size bands for a similarity of num/den: which geometries a set of n shingles is entered in."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        first = 1
        while self.differing(first, self.partner(first)) < 1:
            first += 1
        self.edges = [first]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND), self.partner(self.edges[-1]) + 1))

    def partner(self, a: int) -> int:
        """The largest size that a set of size a can be linked to."""
        return a * self.den // self.num

    def differing(self, a: int, b: int) -> int:
        """The most elements in which linked sets of these sizes differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def shape(self, band: int) -> tuple[int, int]:
        """Blocks of the band's sketch, and in how many of them linked sets agree at least."""
        top = self.edges[band + 1] - 1
        d = self.differing(top, self.partner(top))
        r = -(-d // 10) + 2
        return d + r, r

    def of(self, n: int) -> list[int]:
        """Sets below the first edge are linked to equal sets only."""
        band = int(np.searchsorted(self.edges, n, side="right")) - 1
        if band < 0:
            return []
        return [band, band - 1] if band and n <= self.partner(self.edges[band] - 1) else [band]


@lru_cache(maxsize=4)
def bands(num: int, den: int) -> Bands:
    return Bands(num, den)


def sketch(shingles: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The parity sketch of a sorted set: for each block the XOR of its bits' hashes, and whether it has none."""
    block = ((shingles >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # rises with the shingles
    bit = mixed((block << np.uint64(32) | shingles & np.uint64(0xFFFFFFFF)) ^ _ODD[4])
    edge = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
    empty = edge[1:] == edge[:-1]
    folded = np.zeros(blocks, np.uint64)
    folded[~empty] = np.bitwise_xor.reduceat(bit, edge[:-1][~empty])
    return folded, empty | (folded == 0)


def block_keys(shingles: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The keys a set is entered by, and for each how many blocks with bits a linked set must share at least.

    One key for each block with a bit, and one for choices of empty blocks where
    they are many.  A key's lowest seven bits are its band, the next one says that
    it is of empty blocks, the others are a hash.
    """
    keys, least_shared = [np.zeros(0, np.uint64)], [np.zeros(0, np.int16)]
    for band in bands.of(len(shingles)):
        blocks, least = bands.shape(band)
        folded, empty = sketch(shingles, blocks)
        place = np.full(blocks, band, np.uint64) << np.uint64(32) | np.arange(blocks, dtype=np.uint64)
        own = mixed(folded ^ mixed(place + _ODD[0]))[~empty]
        keys.append(own << np.uint64(8) | np.uint64(band))
        none = np.flatnonzero(empty)
        if len(none) >= least:
            k = min(TOGETHER, least)
            chosen = np.array(list(combinations(none[: len(none) - least + k].tolist(), k)), np.int64)
            keys.append(hashes_of(place[chosen]) << np.uint64(8) | np.uint64(128 + band))
        # Of the blocks that linked sets share, no more are empty than either has.
        rest = min(max(1, least - len(none)), 32_000)
        least_shared.append(np.full(sum(map(len, keys)) - sum(map(len, least_shared)), rest, np.int16))
    return np.concatenate(keys), np.concatenate(least_shared)


def hashes_of(places: np.ndarray) -> np.ndarray:
    """One hash of each row of places of empty blocks."""
    total = np.full(len(places), places.shape[1], np.uint64)
    for column in places.T:
        total = mixed((total ^ column) + _ODD[6])
    return total


def digests(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set; zeros for the empty one."""
    if not len(shingles):
        return 0, 0
    return int(np.bitwise_xor.reduce(mixed(shingles + _ODD[2])).astype(np.int64)), int(mixed(shingles ^ _ODD[3]).sum(dtype=np.uint64).astype(np.int64))


def _profiles(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, mark of the text, n_shingles, two digests of the set, block keys."""

    def run(batches):
        shape = bands(num, den)
        seen: set[tuple[int, int]] = set()  # a set's keys are needed once in a task
        none = np.zeros(0, np.uint64), np.zeros(0, np.int16)
        for batch in sliced(batches):
            size, first, second, keys, least = [], [], [], [], []
            for s in shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), words):
                size.append(len(s))
                d1, d2 = digests(s)
                first.append(d1)
                second.append(d2)
                new = (d1, d2) not in seen
                seen.add((d1, d2))
                own, shared = block_keys(s, shape) if new else none
                keys.append(own.astype(np.int64))
                least.append(shared)
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            listed = [
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([zero, *own]), kind))
                for zero, own, kind in ((none[0].astype(np.int64), keys, pa.int64()), (none[1], least, pa.int16()))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), *listed],
                ["doc_id", "mark", "n_shingles", "d1", "d2", "keys", "least"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", text_mark(docs).alias("mark"))
    return rows.mapInArrow(run, f"doc_id {kind}, mark long, n_shingles long, d1 long, d2 long, keys array<long>, least array<short>")


def local_links(sets: list[np.ndarray], num: int, den: int, rest: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all that is connected among the sets, each an exact one.

    With ``rest``, places of sets, it is enough to compare these with all others.
    """
    m = len(sets)
    if m < 2:
        return []
    size = np.array([len(s) for s in sets], np.int64)
    element, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), size)
    f = np.bincount(place, minlength=len(element))
    # The pivot has the least sum of differences to all others.
    pivot = int(np.argmax(np.bincount(row, 2.0 * f[place] - m, m)))
    index = np.full(len(element), -1, np.int64)
    own = place[row == pivot]
    index[own] = np.arange(len(own))
    at = index[place]
    inside = at >= 0
    width = -(-len(own) // 64) * 64
    lacks = np.ones((m, width), bool)
    lacks[:, len(own) :] = False
    lacks[row[inside], at[inside]] = False
    delta = lacks.sum(1) + np.bincount(row[~inside], minlength=m)
    packed = np.packbits(lacks, axis=1).view(np.uint64)
    # Added elements that several sets have, with the sets of each.
    added = np.flatnonzero(~inside & (f[place] > 1))
    by_element = added[np.argsort(place[added], kind="stable")]
    e_sorted, sets_of = place[by_element], row[by_element]
    e_of, first = place[added], np.searchsorted(row[added], np.arange(m + 1))

    linked = lambda a, diff: (den * (size[a] + size - diff) >= num * (size[a] + size + diff)) & (size + size[a] > diff)
    group = np.arange(m)
    links: list[tuple[int, int]] = []

    def join(a: int, with_: np.ndarray) -> None:
        for g in np.unique(group[with_]):
            if g != group[a]:
                links.append((a, int(with_[np.argmax(group[with_] == g)])))
                group[group == g] = group[a]

    direct = linked(pivot, delta)
    join(pivot, np.flatnonzero(direct))
    for a in np.flatnonzero(~direct) if rest is None else rest:
        both = np.bitwise_count(packed & packed[a]).sum(1).astype(np.int64)
        mine = e_of[first[a] : first[a + 1]]
        if len(mine):
            lo, hi = np.searchsorted(e_sorted, mine), np.searchsorted(e_sorted, mine, side="right")
            spots = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            both += np.bincount(sets_of[spots], minlength=m)
        found = linked(a, delta[a] + delta - 2 * both)
        found[a] = False
        join(a, np.flatnonzero(found))
    return links


def _sieve(values: DataFrame) -> tuple[int, np.ndarray] | None:
    """Size and bitmap of the hashes h of a written table; None where they are too many to broadcast one."""
    n = values.count()
    if n > SIEVED:
        return None
    bits = 1 << max(15, (n * SIEVE_BITS).bit_length())
    at = values.select((F.col("h").bitwiseAND(F.lit(bits - 1)) + 1).alias("h"))  # bucket numbers and positions count from value 1
    parts = at.groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    whole = np.zeros(bits // 8, np.uint8)
    found = parts.toArrow()  # at most bits / 32768 rows of 4 KiB
    for k, own in zip(found.column("k").to_pylist(), found.column("bits"), strict=True):
        whole[(k - 1) * 4096 : k * 4096] = np.frombuffer(own.as_py(), np.uint8)
    return bits, whole


def _sieved(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``docs`` that can be members, by a bitmap of hashed ids: few texts are left to shuffle."""
    place = lambda c: F.xxhash64(F.lit(23), c)
    sieve = _sieve(members.select(place("doc_id").alias("h")))
    if sieve is None:
        return docs
    bits, shared = sieve[0], docs.sparkSession.sparkContext.broadcast(sieve[1])

    def run(batches):
        for batch in batches:
            h = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) & (bits - 1)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["doc_id", "text"]).filter(pa.array((shared.value[h >> 3] >> (h & 7)) & 1 == 1))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.withColumn("h", place("doc_id")).mapInArrow(run, f"doc_id {kind}, text string")


def _shared_keys(profiles: DataFrame, hubs: DataFrame, part: int, parts: int) -> tuple[DataFrame, Broadcast | None]:
    """d1, key, least of the part's keys that can be among those of ``hubs``, by a bitmap of their bits; what to destroy after use."""
    sieve = _sieve(hubs.select(F.shiftright("key", 8).alias("h")))
    if sieve is None:
        listed = profiles.select("d1", F.explode(F.arrays_zip("keys", "least")).alias("k")).select("d1", F.col("k.keys").alias("key"), F.col("k.least").alias("least"))
        return listed.where(_part_of("key", parts) == part), None
    bits, shared = sieve[0], profiles.sparkSession.sparkContext.broadcast(sieve[1])

    def run(batches):
        for batch in sliced(batches):
            listed = batch.column(1)
            keys = listed.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(listed.value_lengths().fill_null(0)))
            own = np.flatnonzero((keys >> 40) % parts == part)
            h = (keys[own] >> 8) & (bits - 1)
            at = own[((shared.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1) == 1]
            least = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            cols = [batch.column(0).take(pa.array(row[at])), pa.array(keys[at], pa.int64()), pa.array(least[at], pa.int16())]
            yield pa.RecordBatch.from_arrays(cols, ["d1", "key", "least"])

    return profiles.select("d1", "keys", "least").mapInArrow(run, "d1 long, key long, least short"), shared


def _part_of(key: str, parts: int):
    """The part of a key, by bits that a sieve does not use."""
    return F.pmod(F.shiftright(key, 40), F.lit(parts))


def _verified(docs: DataFrame, members: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """a, b, classes (rep, d1, d2): links that connect what is connected in each task.

    ``members`` is a written table of (doc_id, d1, d2, task, rest): where any set of
    a task is of the rest, only those are compared with all.
    """
    likely = _sieved(docs.select("doc_id", "text"), members)
    rows = likely.join(members, "doc_id").select("task", "doc_id", "text", "d1", "d2", "rest")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def decide(own: dict) -> list[tuple]:
        classes = list(own)
        rest = np.flatnonzero([r for _, r in own.values()])
        links = local_links([s for s, _ in own.values()], num, den, rest if len(rest) else None)
        return [classes[a] + classes[b] for a, b in links]

    def run(batches):
        task, own, kind = None, {}, None

        def pack(found):
            cols = [pa.array([x[k] for x in found], kind if k in (0, 3) else pa.int64()) for k in range(6)]
            return pa.RecordBatch.from_arrays(cols, ["ra", "a1", "a2", "rb", "b1", "b2"])

        for batch in sliced(batches):
            kind = batch.schema.field(1).type
            tasks, ids, d1, d2, rest = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            out = []
            for k, s in enumerate(shingle_sets(batch.column(2).cast(pa.binary()).to_pylist(), words)):
                if tasks[k] != task:
                    out += decide(own)
                    task, own = tasks[k], {}
                if digests(s) == (d1[k], d2[k]):  # an id may have other texts too
                    own[ids[k], d1[k], d2[k]] = s, rest[k]
            yield pack(out)
        if kind is not None:
            yield pack(decide(own))

    dealt = rows.repartition("task").sortWithinPartitions("task")
    found = dealt.mapInArrow(run, f"ra {kind}, a1 long, a2 long, rb {kind}, b1 long, b2 long")
    return found.select(_class("ra", "a1", "a2").alias("a"), _class("rb", "b1", "b2").alias("b"))


def _class(rep: str, d1: str, d2: str):
    """A class as a vertex; the order is that of representatives."""
    return F.struct(F.col(rep).alias("rep"), F.col(d1).alias("d1"), F.col(d2).alias("d2"))


def _shared(profiles: DataFrame, part: int, parts: int, made: list[str]) -> DataFrame:
    """key, d1, least, hub, star: the sets of each key of the part that several sets have, as a written table."""
    # Most keys are of one set only; a bitmap of the others spares those the second shuffle.
    spark, passing = profiles.sparkSession, []
    keyed = profiles.select("d1", F.explode("keys").alias("key")).where(_part_of("key", parts) == part)
    hubs = keyed.groupBy("key").agg(F.min("d1").alias("hub"), F.max("d1").alias("top"), F.count("*").alias("n")).where("hub <> top")
    hubs = settled(hubs.select("key", "hub", ((F.col("n") > KEY_SETS) | (F.col("key").bitwiseAND(F.lit(128)) != 0)).alias("star")), "hubs", passing)
    found, sieve = _shared_keys(profiles, hubs, part, parts)
    rows = found.join(hubs, "key").groupBy("key", "d1").agg(F.max("least").alias("least"), F.first("hub").alias("hub"), F.first("star").alias("star"))
    rows = settled(rows, "shared", made)
    if sieve is not None:
        sieve.destroy()
    discard(spark, passing[0])
    return rows


def _edges(profiles: DataFrame, made: list[str]) -> DataFrame:
    """a, b of digests: sets that are linked are connected by these edges.

    A key that few sets have gives its pairs, and a pair stays if it shares as many
    keys of a band as linked sets must.  A key that more than ``KEY_SETS`` sets
    have, or one of empty blocks, gives a star around its smallest digest instead,
    which connects all it has.  So a linked pair is either in some star or has all
    its shared keys counted.
    """
    spark, paths = profiles.sparkSession, []
    parts = min(MOST_PARTS, max(1, -(-written_bytes(profiles) // PART_BYTES)))
    for part in range(parts):
        rows = _shared(profiles, part, parts, paths)
    made += paths
    rows = spark.read.schema(rows.schema).parquet(*paths)
    stars = rows.where("star and d1 <> hub").select(F.col("d1").alias("a"), F.col("hub").alias("b"))
    few = rows.where("not star").select("key", "d1", "least")
    other = few.select("key", F.col("d1").alias("b"), F.col("least").alias("least_b"))
    pairs = few.withColumnRenamed("d1", "a").join(other, "key").where("a < b")
    band = F.col("key").bitwiseAND(F.lit(127))
    counted = pairs.groupBy("a", "b", band.alias("band")).agg(F.count("*").alias("shared"), F.max(F.greatest("least", "least_b")).alias("needed"))
    return stars.unionByName(counted.where("shared >= needed").select("a", "b")).distinct()


def _resolved(docs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, first (whether the row is of its component's first class and id): a row for each row of ``docs``."""
    num, den = similarity
    spark, made = docs.sparkSession, []
    small_batches(spark)
    keyed = settled(_profiles(docs, words, num, den), "profiles", made)
    profiles = settled(keyed.drop("keys", "least"), "sizes")
    filled = profiles.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = settled(classes, "classes")

    # Vertices are digests: where two sets share one, both are in its cluster.
    clusters = settled(components(_edges(keyed, made), "clusters"), "clustered")
    for path in made:
        discard(spark, path)

    filled_docs = docs.where("doc_id is not null")
    placed = settled(_placed(classes, clusters), "placed")
    first = placed.select(F.col("rep").alias("doc_id"), "d1", "d2", F.xxhash64("component", "chunk").alias("task"), F.lit(False).alias("rest"))
    links = settled(_verified(filled_docs, settled(first, "members"), words, num, den), "links")
    found = components(links, "linked")
    if not placed.where("chunks > 1").isEmpty():
        found = settled(found, "linked")
        second = settled(_rest(placed, found), "members")
        if not second.isEmpty():
            more = settled(_verified(filled_docs, second, words, num, den), "links")
            found = components(links.unionByName(more), "linked")

    own = _class("rep", "d1", "d2")
    named = classes.join(found.withColumnRenamed("v", "own"), own == F.col("own"), "left")
    named = named.withColumn("root", F.coalesce("component", own)).where((F.col("copies") > 1) | (F.col("root") != own))
    named = named.select("d1", "d2", "n_shingles", "copies", F.col("root.rep").alias("component"), F.when(F.col("root") == own, F.col("rep")).alias("stays"))
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("copies")
    salted = profiles.select("doc_id", "mark", "n_shingles", "d1", "d2", F.pmod(F.xxhash64(F.lit(3), "doc_id", "mark"), F.lit(SALTS)).cast("int").alias("salt"))
    back = salted.join(spread.withColumn("linked", F.lit(True)), ["d1", "d2", "n_shingles", "salt"], "left")
    return back.select(
        "doc_id",
        "mark",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | F.col("linked").isNull() | F.col("doc_id").eqNullSafe(F.col("stays"))).alias("first"),
    )


def _by_cluster(classes: DataFrame, facts: DataFrame) -> DataFrame:
    """``classes`` with the facts of their cluster, a row for each cluster; a large cluster is dealt to ``SALTS`` keys."""
    spread = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = classes.withColumn("salt", F.pmod(F.xxhash64(F.lit(11), "d1", "d2"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["component", "salt"]).drop("salt")


def _placed(classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """rep, d1, d2, component, chunks, chunk of the classes that are in a cluster; the first of a cluster is in each of its chunks."""
    own = classes.select("rep", "d1", "d2", "n_shingles").join(clusters.withColumnRenamed("v", "d1"), "d1")
    totals = own.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"), F.min(_class("rep", "d1", "d2")).alias("first"))
    chunks = F.ceil(F.greatest(F.col("docs") / TASK_DOCS, F.col("shingles") / TASK_SHINGLES)).cast("int")
    placed = _by_cluster(own, totals.select("component", "first", chunks.alias("chunks")))
    chunk = F.pmod(F.xxhash64(F.lit(5), "d1", "d2"), F.col("chunks")).cast("int")
    whole = F.sequence(F.lit(0), F.col("chunks") - 1)
    placed = placed.withColumn("chunk", F.explode(F.when(_class("rep", "d1", "d2") == F.col("first"), whole).otherwise(F.array(chunk))))
    return placed.select("rep", "d1", "d2", "n_shingles", "component", "chunks", "chunk")


def _rest(placed: DataFrame, found: DataFrame) -> DataFrame:
    """Tasks that hold the rest of each cluster of several chunks against all of it."""
    own = placed.where("chunks > 1").dropDuplicates(["rep", "d1", "d2"]).withColumn("v", _class("rep", "d1", "d2"))
    own = own.join(found.withColumnRenamed("component", "of"), "v", "left").withColumn("of", F.coalesce("of", "v"))
    groups = own.groupBy("component", "of").agg(F.count("*").alias("n"))
    most = groups.groupBy("component").agg(F.max(F.struct("n", "of")).alias("m")).select("component", F.col("m.of").alias("main"))
    own = _by_cluster(own, most).withColumn("rest", F.col("of") != F.col("main"))
    left = own.where("rest").groupBy("component").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    parts = F.ceil(F.greatest(F.col("docs") / TASK_DOCS, F.col("shingles") / TASK_SHINGLES)).cast("int")
    own = _by_cluster(own, left.select("component", parts.alias("parts")))
    part = F.pmod(F.xxhash64(F.lit(9), "d1", "d2"), F.col("parts")).cast("int")
    # A set is one of all in its chunk's tasks, and one of the rest in the tasks of its part.
    all_ = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = own.where("rest").withColumn("part", part).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cols = ["rep", "d1", "d2", "component", "chunk", "part"]
    both = all_.select(*cols, F.lit(False).alias("rest")).unionByName(rest.select(*cols, F.lit(True).alias("rest")))
    both = both.groupBy(*cols).agg(F.max("rest").alias("rest"))
    return both.select(F.col("rep").alias("doc_id"), "d1", "d2", F.xxhash64("component", "chunk", "part").alias("task"), "rest")


def linked_components(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of ``docs``."""
    return _resolved(docs, words, similarity).select("doc_id", "n_shingles", "component_id")


def keep_representatives(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` with the row of the smallest id of each component, all columns unchanged.

    Rows without an id stay, and so do rows that repeat that id with an equal set.
    """
    found = _resolved(docs, words, similarity)
    dropped = settled(found.where(~F.col("first")).select(F.col("doc_id").alias("id"), "mark").distinct(), "dropped")
    return matching(docs, dropped, "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"), words=3, similarity=(90, 100))


#: Sets whose similarity is 0.9 share one of the rarest tenth of either's shingles; what does is compared exactly.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), f AS (SELECT sh, count(*) AS df FROM s GROUP BY sh HAVING count(*) > 1
), ranked AS (
  SELECT doc_id, sh, n, coalesce(df, 1) AS df, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(df, 1), sh) AS k
  FROM s JOIN n USING (doc_id) LEFT JOIN f USING (sh)
), p AS (SELECT doc_id, sh FROM ranked WHERE df > 1 AND k <= n - (90 * n + 99) // 100 + 1
), c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b USING (sh) WHERE a.doc_id < b.doc_id
), meet AS (
  SELECT a, b, count(*) AS shared FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.sh = x.sh GROUP BY a, b
), e AS (
  SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), u AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT u.y, reach.c FROM reach JOIN u ON u.x = reach.v
), least AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least.c, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.v = doc_id
"""

QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLES = {"op9_jaccard_join": ORACLE}
