"""Problem 7: containers of fixed capacity filled with texts, sizes in tokens.

Variable-capacity best-fit, run on the histogram of sizes instead of on the items: sizes are
integers of at most the capacity, so however many items there are, the histogram has at most that
many rows, and items of one size are interchangeable.  Sizes are taken from the largest down; all
items of a size go at once to the open bins with the least sufficient room (best fit), the rest
open new bins of the permitted length that costs least per token it can hold.  In the end each bin
is downsized to the shortest permitted length that holds its contents.  The outcome is a list of
runs ("items a to b of size s go to bins x to y"), which every item looks up by its number among
the items of its size.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.cluster import checked_broadcast, materialise
from folioscope.llm.bpe import DEFAULT_VOCABULARY, count_tokens

CAPACITY = 2048
#: Lengths that a finished container may be downsized to; the largest is the capacity.
LENGTHS = (256, 512, 1024, 2048)
#: What opening a container costs besides its length, in tokens: makes long ones the cheaper ones.
OPENING_COST = 16
#: Items of a slice, by which the items of one size are numbered, about; and the fewest slices.
SLICE_ITEMS = 500_000
LEAST_SLICES = 32


def plan_bins(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, opening_cost: float = OPENING_COST) -> tuple[list[tuple[int, int, int, int, int]], dict[int, list[tuple[int, int]]]]:
    """Best-fit over a histogram ``size -> number of items``.

    Returns runs ``(size, first item, number of items, first bin, offset in the bin)``, each with
    one item a bin, and the final length of bins as ``length -> [(first bin, number of bins)]``.
    """
    lengths = tuple(sorted(lengths))
    # Open bins as runs by the room left: room -> [(first bin, number, tokens used)].
    rooms: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    runs, n_bins = [], 0

    for size in sorted((s for s, n in histogram.items() if n > 0), reverse=True):
        if size < 1 or size > lengths[-1]:
            raise ValueError(f"size {size} is outside 1 to {lengths[-1]}")
        left, item = histogram[size], 0
        # Best fit: rooms from the least sufficient up.
        queue = [r for r, x in rooms.items() if x and r >= size]
        heapq.heapify(queue)
        while left and queue:
            room = heapq.heappop(queue)
            while left and rooms[room]:
                first, number, used = rooms[room].pop()
                taken = min(number, left)
                runs.append((size, item, taken, first, used))
                if taken < number:
                    rooms[room].append((first + taken, number - taken, used))
                rest = room - size
                if rest >= size and not rooms[rest]:
                    heapq.heappush(queue, rest)
                rooms[rest].append((first, taken, used + size))
                item += taken
                left -= taken
        if left:
            fits = [x for x in lengths if x >= size]
            length = min(fits, key=lambda x: ((x + opening_cost) / (x - x % size), -x))
            per_bin = length // size
            full, some = divmod(left, per_bin)
            for number, each in ((full, per_bin), (1 if some else 0, some)):
                if number:
                    for k in range(each):
                        runs.append((size, item, number, n_bins, k * size))
                        item += number
                    rooms[length - each * size].append((n_bins, number, each * size))
                    n_bins += number
    final: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for bins in rooms.values():
        for first, number, used in bins:
            final[next(x for x in lengths if x >= used)].append((first, number))
    return runs, dict(final)


def pieces_of(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece_no, token_from, n_tokens)``: texts above the capacity are cut into full
    pieces and a rest, all others are one piece; sizes of 0 give none."""
    last = F.floor((F.col("n_tokens") - 1) / F.lit(capacity)).cast("int")
    at = sizes.where("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    start = F.col("piece_no").cast("bigint") * capacity
    return at.select("doc_id", "piece_no", start.alias("token_from"), F.least(F.lit(capacity).cast("bigint"), F.col("_n") - start).alias("n_tokens"))


def pack(sizes: DataFrame, lengths: tuple[int, ...] = LENGTHS, opening_cost: float = OPENING_COST) -> DataFrame:
    """Containers for items ``(doc_id, n_tokens)``, one row a piece.

    Columns: ``doc_id, piece_no, token_from, n_tokens, bin_id, bin_offset, bin_length``.  A piece
    occupies ``[bin_offset, bin_offset + n_tokens)`` of its bin and no two overlap.  An item is
    cut only if it alone exceeds the largest length.  Items of size 0 or null aren't assigned.
    Repeated ids are items of their own.  An empty table gives an empty result.

    The driver sees one count for each size, however many items there are; no size, however common,
    is gathered in one task: items are numbered by slice, a hash of the item, and the number of
    slices follows from that of the items.
    """
    spark = sizes.sparkSession
    capacity = max(lengths)
    items = materialise(pieces_of(sizes, capacity), "pieces")
    # Items of a size are numbered by slice (a hash of the item) and by their order within it, so
    # a task that runs again numbers them alike.
    n_slices = max(LEAST_SLICES, -(-items.count() // SLICE_ITEMS))
    slices = items.select("*", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(n_slices)).cast("int").alias("slice"))
    counts = materialise(slices.groupBy("n_tokens", "slice").agg(F.count(F.lit(1)).alias("n")), "sizes")
    histogram = {int(r["n_tokens"]): int(r["n"]) for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most the capacity rows
    runs, final = plan_bins(histogram, lengths, opening_cost)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    bins = np.array(sorted((a, n, x) for x, many in final.items() for a, n in many), np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((table, bins))
    # The number at which a slice's items of a size begin; a size has at most n_slices rows here.
    before = Window.partitionBy("n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.select("n_tokens", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("start")), "starts")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bins = shared.value
        # Runs are sorted by size and first item, so one number finds an item's run.
        keys = table[:, 0] << 40 | table[:, 1]
        numbers: dict[tuple[int, int], int] = {}
        for batch in batches:
            size, part, start = (batch.column(k).to_numpy() for k in (3, 4, 5))
            number = np.empty(len(size), np.int64)
            for k, (s, p) in enumerate(zip(size.tolist(), part.tolist())):
                n = numbers.get((s, p), 0)
                numbers[s, p] = n + 1
                number[k] = n
            number += start
            run = table[np.searchsorted(keys, size.astype(np.int64) << 40 | number, side="right") - 1]
            bin_id = run[:, 3] + number - run[:, 1]
            length = bins[np.searchsorted(bins[:, 0], bin_id, side="right") - 1, 2]
            columns = [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(bin_id), pa.array(run[:, 4]), pa.array(length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece_no", "token_from", "n_tokens", "bin_id", "bin_offset", "bin_length"])

    # All rows of a slice lie in one partition, in an order that is the same in every run.
    placed = slices.join(checked_broadcast(starts), ["n_tokens", "slice"])
    ready = placed.select("doc_id", "piece_no", "token_from", "n_tokens", "slice", "start").repartition(n_slices, "slice").sortWithinPartitions("slice", "n_tokens", "doc_id", "piece_no")
    return ready.mapInArrow(assign, "doc_id bigint, piece_no int, token_from bigint, n_tokens bigint, bin_id bigint, bin_offset bigint, bin_length bigint")


def pack_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """:func:`pack` of the texts of documents, sized in tokens of a public vocabulary."""
    return pack(count_tokens(documents, id_col, text_col, vocabulary), lengths)
