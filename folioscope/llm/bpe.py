"""Problem 6: byte-level BPE encoding of a corpus with a public vocabulary.

Merging uses a hierarchical-bitmap rank queue.  Each merge rank owns a bucket of linked-list
positions; a three-level bitmap over the ranks marks the buckets that are not empty, so
find-first-set on three words yields the lowest rank.  A position whose pair has changed since it
was queued is stale and skipped.  The queue runs over all unknown pre-tokens of a batch at once,
as one long linked list with barriers between the pre-tokens, and a bucket, with all pairs of the
lowest rank, is merged as one vector.  A merge makes only pairs of higher ranks, so each rank is taken
once: no Python step is spent per merge, and a very long pre-token costs no more than many short
ones of the same length (rescanning all pairs would be quadratic in it).

Pre-tokens repeat, so a worker keeps their ids in a bounded memo; the queue runs on misses only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import spread

#: Where the public vocabulary lies unless the caller names another file.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Pre-tokens kept by a worker, and the longest that is kept; a full memo is emptied.
MEMO_ENTRIES = 400_000
MEMO_LONGEST = 64
#: Code points of text that are encoded together.
BATCH_CHARS = 6_000_000

# The public pre-token pattern of the vocabulary, over Unicode and over ASCII alone.
UNICODE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
ASCII_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""


class RankQueue:
    """Buckets of position vectors by merge rank under a three-level bitmap (64 children a word)."""

    __slots__ = ("buckets", "leaves", "middle", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.leaves: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Add each position to the bucket of its rank."""
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            if len(cuts):
                firsts = ranks[np.concatenate(([0], cuts))].tolist()
                bounds = [0, *cuts.tolist(), len(ranks)]
                for k, rank in enumerate(firsts):
                    self._add(rank, positions[bounds[k] : bounds[k + 1]])
                return
        if len(ranks):
            self._add(int(ranks[0]), positions)

    def _add(self, rank: int, positions: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(positions)
            return
        self.buckets[rank] = [positions]
        leaf, mid = rank >> 6, rank >> 12
        self.leaves[leaf] = self.leaves.get(leaf, 0) | 1 << (rank & 63)
        self.middle[mid] = self.middle.get(mid, 0) | 1 << (leaf & 63)
        self.top |= 1 << mid

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank whose bucket is not empty, and the positions in it."""
        if not self.top:
            return None
        mid = (self.top & -self.top).bit_length() - 1
        word = self.middle[mid]
        leaf = mid << 6 | (word & -word).bit_length() - 1
        bits = self.leaves[leaf]
        rank = leaf << 6 | (bits & -bits).bit_length() - 1
        if bits := bits & bits - 1:
            self.leaves[leaf] = bits
        else:
            del self.leaves[leaf]
            if word := word & word - 1:
                self.middle[mid] = word
            else:
                del self.middle[mid]
                self.top &= self.top - 1
        taken = self.buckets.pop(rank)
        return rank, taken[0] if len(taken) == 1 else np.concatenate(taken)


class Merges:
    """The merges of a rank file as sorted pair keys: (left id, right id) -> id of the two joined."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, joined = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    joined.append(rank)
        order = np.argsort(keys) if keys else []
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.joined = np.append(np.array(joined, np.int64)[order], np.int64(-1))
        self.of_byte = np.array([ranks[bytes([x])] for x in range(256)], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the two don't merge."""
        wanted = left << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.joined[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the offset at which each piece's begin."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total = int(sizes.sum())
        starts = np.cumsum(sizes) - sizes
        symbol = np.append(self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)], 0)
        # The last cell stands for "none": links across a barrier point there.
        after = np.arange(1, total + 2)
        before = np.arange(-1, total)
        after[starts + sizes - 1] = total
        before[starts] = total
        before[total] = after[total] = total
        alive = np.ones(total + 1, bool)
        alive[total] = False
        wanted = np.full(total + 1, -1)
        at = np.flatnonzero(after[:total] < total)
        wanted[at] = self.ranks(symbol[at], symbol[after[at]])
        at = at[wanted[at] >= 0]
        queue = RankQueue()
        queue.push(wanted[at], at)
        while (got := queue.pop()) is not None:
            rank, at = got
            at = at[alive[at] & (wanted[at] == rank)]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at, kind="stable")
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                chained = after[at[:-1]] == at[1:]
                if chained.any():  # of overlapping pairs, the leftmost merges first
                    index = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(np.concatenate(([True], ~chained)), index, 0))
                    at = at[(index - head) % 2 == 0]
            gone = after[at]
            tail = after[gone]
            alive[gone] = False
            symbol[at] = rank
            after[at] = tail
            before[tail] = at
            before[total] = total
            touched = np.concatenate((at, before[at]))
            touched = touched[touched < total]
            follow = after[touched]
            new = self.ranks(symbol[touched], symbol[follow])
            new[follow == total] = -1
            wanted[touched] = new
            some = new >= 0
            if some.any():
                queue.push(new[some], touched[some])
        kept = np.flatnonzero(alive)
        return symbol[kept], np.searchsorted(kept, starts)


class Encoder:
    """A vocabulary with its memo.  Special tokens' strings are ordinary text."""

    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.merges = Merges(self.ranks)
        self.memo: dict[str, tuple[int, ...]] = {}
        self._numbers = list(range(max(self.ranks.values()) + 1))  # shared, so that the memo holds no integers of its own
        self._ascii = re.compile(ASCII_PATTERN).findall
        self._unicode = regex.compile(UNICODE_PATTERN).findall

    def pretokens(self, text: str) -> list[str]:
        return self._ascii(text) if text.isascii() else self._unicode(text)

    def _known(self, cut: list[list[str]]) -> dict[str, tuple[int, ...]]:
        """A table with the ids of every pre-token in ``cut``."""
        memo = self.memo
        new = list(set().union(*cut).difference(memo))
        if not new:
            return memo
        ids, starts = self.merges.encode([x.encode("utf-8") for x in new])
        flat = list(map(self._numbers.__getitem__, ids.tolist()))
        bounds = [*starts.tolist(), len(flat)]
        found = {x: tuple(flat[bounds[k] : bounds[k + 1]]) for k, x in enumerate(new)}
        if len(memo) + len(found) > MEMO_ENTRIES:
            keep = {x: memo[x] for x in set().union(*cut).intersection(memo)}
            memo.clear()
            memo.update(keep)
        if any(len(x) > MEMO_LONGEST for x in found):
            table = memo | found
            memo.update((x, y) for x, y in found.items() if len(x) <= MEMO_LONGEST)
            return table
        memo.update(found)
        return memo

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for null and empty texts."""
        cut = [self.pretokens(x) if x else [] for x in texts]
        get = self._known(cut).__getitem__
        return [list(chain.from_iterable(map(get, x))) for x in cut]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        cut = [self.pretokens(x) if x else [] for x in texts]
        get = self._known(cut).__getitem__
        return [sum(map(len, map(get, x))) for x in cut]

    def subwords(self, word: str) -> int:
        """The number of subwords of one short string, without the queue's fixed cost."""
        total = 0
        for token in self.pretokens(word):
            parts = [token.encode("utf-8")[i : i + 1] for i in range(len(token.encode("utf-8")))]
            while len(parts) > 1:
                ranked = [self.ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
                if (low := min(ranked)) == 1 << 30:
                    break
                at = ranked.index(low)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            total += len(parts)
        return total


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocabulary: bytes) -> Encoder:
    """The encoder of a vocabulary's bytes, built once per worker process."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def vocabulary_bytes(path: str) -> bytes:
    """Contents of a rank file (one base64 token and its rank a line), read on the driver.

    A vocabulary has a fixed size (about 1 MB), so it is broadcast and need not lie on executors.
    """
    with open(path, "rb") as f:
        return f.read()


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(doc_id, ids)``: every row's token ids under a byte-level BPE vocabulary.

    No special tokens are added and their strings are ordinary text.  Null text and empty text
    give an empty list; blank text is encoded like any other.  Rows are kept one for one: repeated
    rows stay repeated, an empty table gives an empty result, further columns of any name are
    ignored.  Texts of any length are encoded whole.  No shuffle, unless the scan has fewer splits
    than the cluster has cores.
    """
    held = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(held.value).encode_batch
        for keys, texts in batched(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(encode(texts), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spread(rows, "doc_id").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)``: the length of :func:`encode_documents`' list; 0 for null and empty."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder_of(held.value).count_batch
        for keys, texts in batched(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(count(texts), pa.int64())], names=["doc_id", "n_tokens"])

    return spread(rows, "doc_id").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Keys and texts in runs of about BATCH_CHARS code points (one text may be longer)."""
    for batch in batches:
        texts, first, held = batch.column(1).to_pylist(), 0, 0
        for at, text in enumerate(texts):
            held += len(text or "")
            if held >= BATCH_CHARS:
                yield batch.column(0)[first : at + 1], texts[first : at + 1]
                first, held = at + 1, 0
        if first < len(texts):
            yield batch.column(0)[first:], texts[first:]
