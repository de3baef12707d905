"""Problem 4: near-duplicate records by anchor-point covering.

A record's set of word shingles is reduced to min-hashes.  A record has ``TABLES`` fingerprints: 23
bits, one of each of 23 min-hashes, beside a coarse key of ``COARSE`` further min-hashes joined.
The anchors of a fingerprint are the code words of the [23,12] Golay code, whose covering radius is
3: each fingerprint lies within 3 of exactly one code word, and two fingerprints at a distance of up
to 2t have a point between them within t of both, so they share a code word within 3 + t.  So each
fingerprint is replicated to every code word within covering radius plus ``HALF_DISTANCE``, under its
coarse key, and compared only with the fingerprints that meet it there.  Records alone under a
coarse key have nobody to meet and aren't replicated; all others are, on tables of any size.

Records with equal shingle sets are one class, compared once.  Candidates are verified by the
exact Jaccard similarity of their sets.  Nothing is capped: where nearly equal records crowd at one
anchor, it is compared in square blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import checked_broadcast, materialise, spread

SHINGLE = 3
MIN_WORDS = 20
THRESHOLD = 0.6
#: Fingerprints a record, and joined min-hashes of a coarse key.  A pair at the threshold has equal
#: coarse keys with probability 0.36 and then, as each fingerprint bit differs with probability 0.2,
#: a common anchor with about 0.6.  The tables share their min-hashes and so aren't independent:
#: simulated, 0.992 of the pairs at 0.6 meet, 0.998 at 0.65 and 0.9999 at 0.7.
TABLES, COARSE = 48, 2
FINGERPRINT = 23
#: Min-hashes; a bit of each makes a sketch of 128 bits, of which a pair at the threshold differs
#: in 25.6 on average (sd 4.5, so one in two thousand beyond the distance) and a pair without anything
#: in common in 64.
HASHES = 128
SKETCH_DISTANCE = 40
#: t of the covering (see above).
HALF_DISTANCE = 1
#: Records of one anchor that one comparison block holds, and of one coarse key that a task meets.
BLOCK = 2048

#: Words whose hashes a worker keeps, and the longest that is kept; a full memo is emptied.
MEMO_WORDS, MEMO_LONGEST = 500_000, 64
#: Code points of text whose shingles are hashed together.
BATCH_CHARS = 2_000_000

WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_GOLAY = 0b101011100011  # fixed value: generator polynomial of the binary Golay code, degree 11


def _parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@cache
def _drawn() -> np.ndarray:
    """For each table the min-hashes drawn for it: those of the coarse key, then the fingerprint's."""
    rng = np.random.default_rng(20240301)
    return np.array([rng.permutation(HASHES)[: COARSE + FINGERPRINT] for _ in range(TABLES)])


class Hasher:
    """Shingle sets and min-hashes of texts."""

    def __init__(self, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> None:
        self.shingle, self.min_words = shingle, min_words
        self.multiply, self.add = _parameters(HASHES)
        self.words: dict[str, int] = {}

    def shingles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted sets of shingle hashes of the texts with words enough.

        Returns the numbers of those texts, all sets one after the other, and where each begins.
        """
        cut = []
        for text in texts:
            low = (text or "").lower()
            cut.append((_ASCII_WORD if low.isascii() else WORD).findall(low))
        known = self.words
        if len(known) > MEMO_WORDS:
            known.clear()
        new = set().union(*cut).difference(known)
        known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        kept = [k for k, x in enumerate(cut) if len(x) >= max(self.min_words, self.shingle)]
        sizes = np.array([len(cut[k]) for k in kept], np.int64)
        h = np.fromiter(map(known.__getitem__, chain.from_iterable(cut[k] for k in kept)), np.uint64, int(sizes.sum()))
        for w in new:
            if len(w) > MEMO_LONGEST:
                del known[w]
        if not kept:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n = len(h) - self.shingle + 1
        s = h[:n].copy()
        for k in range(1, self.shingle):
            s = _mix(s) + h[k : k + n]
        s = _mix(s)
        # Shingles that reach into the next text are left out; each text's are sorted in place.
        ends = np.cumsum(sizes)
        inside = np.ones(len(h), bool)
        for k in range(1, self.shingle):
            inside[ends - k] = False
        s = s[inside[:n]]
        counts = sizes - self.shingle + 1
        starts = np.cumsum(counts) - counts
        for at, end in zip(starts.tolist(), (starts + counts).tolist()):
            s[at:end].sort()
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        first[starts] = True
        before = np.concatenate(([0], np.cumsum(first)))
        return np.array(kept, np.int64), s[first], before[starts]

    def minhashes(self, sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """HASHES min-hashes of each set, a row a set."""
        out = np.empty((len(starts), HASHES), np.uint64)
        low = sets >> np.uint64(32)
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat((sets * self.multiply[k] + self.add[k]) ^ low, starts)
        return _mix(out)


def _runs(keys: list, texts: list[str | None]) -> Iterator[tuple[list, list[str | None]]]:
    """Keys and texts in runs of about BATCH_CHARS code points (one text may be longer)."""
    first = held = 0
    for at, text in enumerate(texts):
        held += len(text or "")
        if held >= BATCH_CHARS or at + 1 == len(texts):
            yield keys[first : at + 1], texts[first : at + 1]
            first, held = at + 1, 0


def coarse_keys(minhashes: np.ndarray) -> np.ndarray:
    """The coarse key of each table, a row a record; keys of different tables differ."""
    key = np.broadcast_to(np.arange(1, TABLES + 1, dtype=np.uint64), (len(minhashes), TABLES)).copy()
    for k in range(COARSE):
        key = _mix(key + minhashes[:, _drawn()[:, k]])
    return key.view(np.int64)


SIGNATURE = "id bigint, n_shingles int, set_key binary, coarse array<bigint>, sketch bigint, sketch2 bigint"


def signatures(chunks: DataFrame, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """``SIGNATURE`` of each chunk with words enough, one row a delivered row; contents aren't shuffled."""
    rows = chunks.where(F.col("content").isNotNull()).select(F.col("id").cast("bigint"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle, min_words)
        powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
        names = [x.split()[0] for x in SIGNATURE.split(", ")]
        for batch in batches:
            for keys, texts in _runs(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept, sets, starts = hasher.shingles(texts)
                if not len(kept):
                    continue
                m = hasher.minhashes(sets, starts)
                ends = np.append(starts[1:], len(sets))
                coarse = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * TABLES, pa.int32()), pa.array(coarse_keys(m).ravel()))
                sketches = [((half & np.uint64(1)) * powers).sum(axis=1, dtype=np.uint64).view(np.int64) for half in (m[:, :64], m[:, 64:])]
                columns = [pa.array([keys[k] for k in kept.tolist()], pa.int64()), pa.array((ends - starts).astype(np.int32)), pa.array([xxhash.xxh128_digest(sets[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()), coarse]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sketches)], names=names)

    return spread(rows, "id").mapInArrow(run, SIGNATURE)


@cache
def golay_patterns(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All 23-bit error patterns of at most that weight, grouped by syndrome, and the 2,049 bounds
    of the groups.  A word's code words within the radius are it XOR the patterns of its syndrome."""
    words = np.arange(1 << 23, dtype=np.int64)
    few = words[np.bitwise_count(words) <= radius]
    order = np.argsort(syndromes(few), kind="stable")
    return few[order], np.searchsorted(syndromes(few)[order], np.arange(2049))


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, _GOLAY << (bit - 11), 0)
    return rest


def fingerprints(sketch: np.ndarray, second: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The fingerprint of each sketch for that table: the bits of the min-hashes drawn for it."""
    halves = (sketch.view(np.uint64), second.view(np.uint64))
    out = np.zeros(len(sketch), np.int64)
    for k in range(FINGERPRINT):
        drawn = _drawn()[table, COARSE + k]
        out |= (np.where(drawn < 64, *halves) >> (drawn % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64) << k
    return out


def anchors_of(coarse: np.ndarray, fingerprint: np.ndarray, half_distance: int = HALF_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: each fingerprint at every code word within covering radius plus
    ``half_distance``; an anchor is a hash of the coarse key and the code word."""
    patterns, bounds = golay_patterns(3 + half_distance)
    s = syndromes(fingerprint)
    counts = bounds[s + 1] - bounds[s]
    row = np.repeat(np.arange(len(s)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    word = fingerprint[row] ^ patterns[bounds[s][row] + offset]
    return row, _mix(coarse.view(np.uint64)[row] + _mix(word.astype(np.uint64) + np.uint64(1))).view(np.int64)


def replicate(rows: DataFrame, half_distance: int = HALF_DISTANCE, bare: bool = False) -> DataFrame:
    """Copies of ``(band, coarse, id, n_shingles, sketch, sketch2)`` rows, one an anchor, with a
    column ``anchor``; ``bare``: that column alone."""
    columns = ["id", "n_shingles", "sketch", "sketch2"]
    schema = "anchor bigint" if bare else "anchor bigint, id bigint, n_shingles int, sketch bigint, sketch2 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                band, coarse, _, _, sketch, second = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
                row, anchor = anchors_of(coarse.astype(np.int64), fingerprints(sketch.astype(np.int64), second.astype(np.int64), band), half_distance)
                held = [] if bare else [batch.column(i).take(pa.array(row)) for i in range(2, 6)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), *held], names=["anchor", *([] if bare else columns)])

    return rows.select("band", "coarse", *columns).mapInArrow(run, schema)


def close_pairs(columns: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids of rows ``(anchor, block, own, id, n_shingles, sketch, sketch2)``, sorted by
    anchor and block, that share both, whose sketches are close and whose sizes allow the threshold.
    In a block of two slices (``own``) only rows of different ones are compared."""
    anchor, block, own, key, size, first, second = columns
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])) + 1
    ends = np.repeat(np.append(cut, len(anchor)), np.diff(np.concatenate(([0], cut, [len(anchor)]))))
    left = ends - np.arange(len(anchor)) - 1
    single = (block >> 32) == (block & 0xFFFFFFFF)
    first, second = first.view(np.uint64), second.view(np.uint64)
    out_a, out_b = [], []
    i, step = np.flatnonzero(left >= 1), 1
    while len(i):
        j = i + step
        near = (single[i] | (own[i] != own[j])) & (np.bitwise_count(first[i] ^ first[j]) + np.bitwise_count(second[i] ^ second[j]) <= SKETCH_DISTANCE)
        near &= np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
        out_a.append(key[i[near]])
        out_b.append(key[j[near]])
        step += 1
        i = i[left[i] >= step]
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.minimum(a, b), np.maximum(a, b)


def _meet(rows: DataFrame, threshold: float) -> DataFrame:
    """``(rep_a, rep_b)``: :func:`close_pairs` of all anchors, by one shuffle; a task holds the rows
    of one batch and of one block."""
    names = ["anchor", "block", "own", "id", "n_shingles", "sketch", "sketch2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in chain(batches, [None]):
            if batch is None:
                if held is None:
                    return
                ready = held
            elif not batch.num_rows:
                continue
            else:
                ready = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)]
                if held is not None:
                    ready = [np.concatenate(x) for x in zip(held, ready)]
                # The last block may go on in the next batch.
                last = np.flatnonzero((ready[0] != ready[0][-1]) | (ready[1] != ready[1][-1]))
                at = last[-1] + 1 if len(last) else 0
                held = [x[at:] for x in ready]
                ready = [x[:at] for x in ready]
            a, b = close_pairs(ready, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["rep_a", "rep_b"])

    return rows.select(names).repartition("anchor", "block").sortWithinPartitions("anchor", "block").mapInArrow(run, "rep_a bigint, rep_b bigint").where("rep_a < rep_b")


def _local_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """``(rep_a, rep_b)``: :func:`close_pairs` of ``(band, coarse, id, n_shingles, sketch, sketch2)``
    rows whose coarse keys have at most BLOCK each.  All anchors of a key lie in one task, so the
    replicas are made, met and dropped there, without a shuffle of their own."""
    names = ["coarse", "band", "id", "n_shingles", "sketch", "sketch2"]

    def met(columns: list[np.ndarray]) -> pa.RecordBatch:
        coarse, band, key, size, first, second = columns
        row, anchor = anchors_of(coarse, fingerprints(first, second, band))
        order = np.argsort(anchor, kind="stable")
        row, anchor = row[order], anchor[order]
        # Anchors with one fingerprint are dropped before anything is copied to them.
        same = anchor[1:] == anchor[:-1]
        several = np.append(same, False) | np.append(False, same)
        row, anchor = row[several], anchor[several]
        zero = np.zeros(len(row), np.int64)
        a, b = close_pairs([anchor, zero, zero, key[row], size[row], first[row], second[row]], threshold)
        pairs = np.unique(np.stack((a, b), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["rep_a", "rep_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ready = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)]
            if held is not None:
                ready = [np.concatenate(x) for x in zip(held, ready)]
            # The last key may go on in the next batch.
            at = int(np.searchsorted(ready[0], ready[0][-1], side="left"))
            held = [x[at:] for x in ready]
            yield met([x[:at] for x in ready])
        if held is not None:
            yield met(held)

    return rows.select(names).repartition("coarse").sortWithinPartitions("coarse").mapInArrow(run, "rep_a bigint, rep_b bigint").where("rep_a < rep_b")


def candidates(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(rep_a, rep_b)``: pairs that meet at an anchor and whose sketches are close enough.

    ``reps``: materialised rows of ``SIGNATURE`` (used several times).  Records meet alike whatever the
    size of their coarse key; a key of more than BLOCK is only evaluated anchor by anchor, in the
    cluster, and not in one task.
    """
    tables = reps.select(F.posexplode("coarse").alias("band", "coarse"), "id", "n_shingles", "sketch", "sketch2")
    count = F.count(F.lit(1))
    # Who is alone under a coarse key meets nobody; only the keys are shuffled to find that out.
    joint = materialise(tables.select("coarse").groupBy("coarse").agg(count.alias("n")).where("n > 1"), "coarse")
    live = tables.join(checked_broadcast(joint), "coarse")
    pairs = _local_pairs(live.where(F.col("n") <= BLOCK), threshold)
    crowded = joint.where(F.col("n") > BLOCK)
    if not crowded.isEmpty():
        large = tables.join(checked_broadcast(crowded), "coarse")
        # Nor does who is alone at an anchor.
        met = materialise(replicate(large, bare=True).groupBy("anchor").agg(count.alias("n")).where("n > 1").select("anchor", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("slices")), "anchors")
        sliced = replicate(large).join(checked_broadcast(met), "anchor").withColumn("own", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
        # A row of slice s joins the blocks (s, x) and (x, s); with one slice that is one block.
        other = sliced.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        block = F.least("own", "other").cast("bigint") * F.lit(1 << 32) + F.greatest("own", "other")
        pairs = pairs.unionByName(_meet(other.withColumn("block", block), threshold))
    return pairs.distinct()


def shingle_sets(contents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(id, s)``: the exact sets of shingle hashes of contents ``(id, content)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle, 0)
        for batch in batches:
            for keys, texts in _runs(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept, sets, starts = hasher.shingles(texts)
                held = pa.ListArray.from_arrays(pa.array(np.append(starts, len(sets)), pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in kept.tolist()], pa.int64()), held], names=["id", "s"])

    return contents.mapInArrow(run, "id bigint, s array<bigint>")


def near_duplicates(chunks: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets, and the links between classes.

    Returns ``members (id, rep)``, one row per distinct chunk with at least ``min_words`` words,
    and ``links (rep_a, rep_b, similarity)``, ``rep_a < rep_b``, with a Jaccard similarity of at
    least ``threshold``.  ``rep`` is the smallest id of the class.  Null, empty and short contents
    are out of scope; rows delivered twice count once (an id delivered with different contents counts
    with each of them); columns other than ``id`` and ``content``
    are ignored; an empty table gives empty results.
    """
    signed = materialise(signatures(chunks, shingle, min_words), "signatures")
    # Sets of several rows (classes, and rows delivered twice) are few; all other records represent
    # themselves.  Only the keys are shuffled to tell them apart.
    classes = signed.groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    named = signed.join(checked_broadcast(materialise(classes, "classes")), "set_key", "left")
    alone, several = named.where("rep is null"), named.where("rep is not null")
    members = alone.select("id", F.col("id").alias("rep")).unionByName(several.select("id", "rep").distinct())
    columns = ["id", "n_shingles", "coarse", "sketch", "sketch2"]
    reps = alone.select(columns).unionByName(several.where("id = rep").select(columns).dropDuplicates(["id"]))
    pairs = materialise(candidates(reps, threshold), "candidates")
    wanted = checked_broadcast(materialise(pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct(), "wanted"))
    contents = chunks.where(F.col("content").isNotNull()).select(F.col("id").cast("bigint"), "content")
    sets = materialise(shingle_sets(contents.join(wanted, "id", "left_semi").dropDuplicates(["id"]), shingle), "sets")
    both = F.size(F.array_intersect("sa", "sb"))
    links = (
        pairs.join(sets.select(F.col("id").alias("rep_a"), F.col("s").alias("sa")), "rep_a")
        .join(sets.select(F.col("id").alias("rep_b"), F.col("s").alias("sb")), "rep_b")
        .select("rep_a", "rep_b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    return members, materialise(links, "links")


def expand_pairs(members: DataFrame, links: DataFrame, copies: int | None = None) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: all pairs of linked chunks.

    Members of linked classes are paired with each other, and those of a class too, so the result
    grows with the square of a class.  A class of more than ``BLOCK`` members is met in slices, so
    no task makes all its pairs.  With ``copies``, a summary: in classes of more members each is
    paired with the class's representative only, which stands for it in links to other classes.
    """
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    sized = members.join(sizes, "rep")
    whole = F.lit(True) if copies is None else F.col("n") <= copies
    speak = sized.where(whole | (F.col("id") == F.col("rep")))
    own = sizes.where((F.col("n") > 1) & whole).select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"))
    slices = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    meet = links.select("rep_a", "rep_b").unionByName(own).distinct().join(sizes.select(F.col("rep").alias("rep_b"), slices.alias("slices")), "rep_b")
    meet = meet.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    left = speak.select(F.col("id").alias("x"), F.col("rep").alias("rep_a"))
    right = speak.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"), F.pmod(F.xxhash64("id"), slices).cast("int").alias("slot"))
    pairs = meet.join(left, "rep_a").join(right, ["rep_b", "slot"]).where("x <> y and (rep_a <> rep_b or x < y)").select("x", "y")
    if copies is not None:
        pairs = pairs.unionByName(sized.where(~whole & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("id").alias("y")))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(members: DataFrame, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(chunk_id, group_id, n_links)`` of the chunks that have a copy or a link.

    ``group_id`` is the smallest id that can be reached over links; ``n_links`` counts the linked
    classes.  Min-label propagation with a hop over the label's own label each round, cut by a
    written table; labels are never collected.
    """
    edges = materialise(links.select(F.col("rep_a").alias("x"), F.col("rep_b").alias("y")).unionByName(links.select(F.col("rep_b").alias("x"), F.col("rep_a").alias("y"))), "edges")
    labels = materialise(edges.select(F.col("x").alias("v"), F.col("x").alias("label")).distinct(), "labels")
    for _ in range(most_rounds):
        near = edges.join(labels, edges.y == labels.v).groupBy("x").agg(F.min("label").alias("near"))
        new = labels.join(near, labels.v == near.x).select("v", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        new = materialise(new, "round")
        hop = new.select(F.col("v").alias("l"), F.col("label").alias("far"))
        jumped = materialise(new.join(hop, F.col("label") == F.col("l"), "left").select("v", F.least("label", "far").alias("label"), "old"), "labels")
        labels = jumped.select("v", "label")
        if jumped.where("label <> old").isEmpty():
            break
    else:
        raise RuntimeError("components not settled")
    degree = edges.groupBy("x").agg(F.count(F.lit(1)).alias("n_links"))
    sized = members.join(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")), "rep")
    return (
        sized.join(labels, sized.rep == labels.v, "left")
        .join(degree, sized.rep == degree.x, "left")
        .where("n > 1 or v is not null")
        .select(F.col("id").alias("chunk_id"), F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
