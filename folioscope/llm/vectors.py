"""Problem 1: the most similar vectors of every vector.

Vectors are normalised, so cosine order is Euclidean order, and reduced to a few coordinates by a
Gaussian (2-stable) projection: the squared projected distance of two vectors, divided by their
squared distance, follows a chi-square distribution with as many degrees of freedom as there are
coordinates.  A kd-tree over the projected points is searched from the nearest leaf outwards; in a
leaf a row's projected neighbours are verified on the whole vectors in their order
(:func:`verify_in_order`), until the chi-square test says that one as far out in the projection as
the next could be nearer than the k-th best found so far only with a probability below
1 - confidence.

Two plans share that search.

- With a stated query set, blocks of queries meet blocks of the other rows, so every row can be
  reached; each query's best of all blocks are merged.
- With a least similarity the k-th best is never farther than that, so a row's neighbours lie close
  in the projection: kd-trees over several independent projections cut the rows into leaves, each row
  searches its leaf of every tree, and a pair is missed only if all trees separate it.  The number
  of trees follows from the number of rows (:func:`trees_for`).

Vectors with equal directions form one class that is searched once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import materialise, spread

DIMENSION = 64
K = 10
#: Coordinates of a projection and confidence of the stopping test, with a query set and with a
#: least similarity (where hardly any row is near enough to be verified, so it may be stricter).
COORDINATES, CONFIDENCE = 32, 0.95
COORDINATES_LEAST, CONFIDENCE_LEAST = 24, 0.999
#: Coordinates by which trees send rows to cells.
TREE_COORDINATES = 12
#: Share of the pairs at exactly the least similarity that all trees together may separate, and the
#: fewest trees where there is more than one leaf.
LOSS, LEAST_TREES = 0.01, 8
#: Rows of a leaf and of a distributed cell of the plan with a least similarity.
LEAF_ROWS = 8192
CELL_ROWS = 32_768
CELLS_A_TASK = 2
#: Trees whose copies of the rows lie on disk at once.
TREES_AT_ONCE = 12
#: The top of each tree is fitted on at most so many projected rows.
SAMPLE_ROWS = 100_000
#: Queries and other rows of one block of the plan with a query set, at most; blocks of fewer rows
#: than the last aren't made for the sake of more tasks.
QUERY_BLOCK = 262_144
ROW_BLOCK = 262_144
SMALL_BLOCK = 8_192
SEED = 64_012
#: Steps of a component from 0 to 1 in the 16 bits that go to the cells.
PACK_SCALE = 2**15 - 1
#: Rounding of squared projected distances and of distances in single and double precision.
NEAR_SLACK, ROOT_SLACK = 1e-3, 1e-7


def chi_square_quantile(p: float, df: int) -> float:
    """Inverse of the chi-square distribution function, by bisection over its series."""

    def cdf(x: float) -> float:
        a, half = df / 2, x / 2
        term = total = 1 / a
        n = a
        while abs(term) > 1e-14 * total:
            n += 1
            term *= half / n
            total += term
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a)) if half > 0 else 0.0

    low, high = 0.0, df + 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def projection(dimension: int, coordinates: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, coordinates)).astype(np.float32)


def kd_cells(points: np.ndarray, leaf_rows: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree; the widest coordinate is halved at its median."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf_rows:
            out.append(rows)
            continue
        part = points[rows]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order = np.argpartition(part[:, axis], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


class Tree:
    """The top of a kd-tree: splits fitted on a sample, so that any point can be sent to its cell."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.axis, self.value = [], []
        depth = max(0, math.ceil(math.log2(max(cells, 1))))
        level = [np.arange(len(sample))]
        self.depth = depth
        for _ in range(depth):
            below = []
            for rows in level:
                part = sample[rows]
                axis = int(np.argmax(part.std(axis=0))) if len(rows) > 1 else 0
                value = float(np.median(part[:, axis])) if len(rows) else 0.0
                self.axis.append(axis)
                self.value.append(value)
                right = part[:, axis] >= value if len(rows) else np.zeros(0, bool)
                below += [rows[~right], rows[right]]
            level = below

    def cell(self, points: np.ndarray) -> np.ndarray:
        axis, value = np.array(self.axis, np.int64), np.array(self.value, np.float32)
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), axis[node]] >= value[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)


def usable(vector: Column, dimension: int = DIMENSION) -> Column:
    """Whether an embedding has the dimension, finite components and not only zeros."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dimension) & finite & F.exists(v, lambda x: x != 0)


UNIT = "id bigint, unit binary, class_key string"


def unit_vectors(rows: DataFrame, id_col: str = "id", vector_col: str = "embedding", dimension: int = DIMENSION) -> DataFrame:
    """``(id, unit, class_key)`` of the distinct ids with a usable vector: the normalised vector
    as 32-bit floats, and a key that equal directions share (components rounded to 5 digits)."""
    kept = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), dimension))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            units = [r.tobytes() for r in x.astype(np.float32)]
            keys = [xxhash.xxh128_hexdigest(r.tobytes()) for r in np.round(x * 1e5).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary()), pa.array(keys, pa.string())], names=["id", "unit", "class_key"])

    return kept.mapInArrow(run, UNIT).dropDuplicates(["id"])


def _matrix(units, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float32).reshape(-1, dimension)


def _best(keys_q: np.ndarray, keys_r: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k best pairs of each query: by cosine, then by smaller id."""
    order = np.lexsort((keys_r, -cosine, keys_q))
    q = keys_q[order]
    first = np.concatenate(([0], np.flatnonzero(q[1:] != q[:-1]) + 1)) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


# --- the search -------------------------------------------------------------------------------


def projected_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``y``, by one product."""
    one = lambda z: np.ones((len(z), 1), np.float32)
    norm = lambda z: np.square(z).sum(axis=1, dtype=np.float32)[:, None]
    return np.hstack((-2 * x, norm(x), one(x))) @ np.hstack((y, one(y), norm(y))).T


def verify_in_order(near: np.ndarray, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], best: np.ndarray, stop: float, error: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Verify each query's projected neighbours from the nearest outwards until the test holds.

    ``near``: squared projected distances, a row a query, infinite for pairs that don't count.
    ``distance``: whole distances of pairs (query numbers, row numbers), known up to ``error``.
    ``best``: each query's k smallest distances so far, the bound where fewer are known.  A query
    is done as soon as its next neighbour's squared projected distance exceeds ``stop`` times the
    square of its k-th smallest distance, widened by twice ``error``.

    Returns the verified pairs, their distances, and ``best`` as it is then.
    """
    k = best.shape[1]
    best = best.copy()
    worst = best.max(axis=1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def visit(a: np.ndarray, b: np.ndarray, slot: np.ndarray, width: int) -> None:
        d = distance(a, b)
        out.append((a, b, d))
        touched, at = np.unique(a, return_inverse=True)
        new = np.full((len(touched), k + width), np.inf)
        new[:, :k] = best[touched]
        new[at, k + slot] = d
        best[touched] = np.partition(new, k - 1, axis=1)[:, :k]
        worst[touched] = best[touched].max(axis=1)

    first = min(2 * k, near.shape[1])
    if np.isinf(worst).any():  # no bound yet: the nearest few give one
        unknown = np.flatnonzero(np.isinf(worst))
        b = np.argpartition(near[unknown], first - 1, axis=1)[:, :first]
        a = np.repeat(unknown, first)
        b = b.ravel()
        slot = np.tile(np.arange(first), len(unknown))
        real = np.isfinite(near[a, b])
        visit(a[real], b[real], slot[real], first)
        near = near.copy()
        near[a, b] = np.inf
    reach = lambda w: stop * np.square(w + 2 * error) + NEAR_SLACK
    a, b = np.nonzero(near <= reach(worst)[:, None].astype(np.float32))
    held = near[a, b]
    real = np.isfinite(held)
    a, b, held = a[real], b[real], held[real]
    order = np.lexsort((held, a))
    a, b, held = a[order], b[order], held[order]
    start = np.searchsorted(a, a, side="left")
    rank = np.arange(len(a)) - start
    low, width = 0, 2 * k
    while len(a):
        now = rank < low + width
        visit(a[now], b[now], rank[now] - low, width)
        left = ~now
        a, b, held, rank = a[left], b[left], held[left], rank[left]
        # A query's rest is sorted, so its next one tells whether the test holds for all of it.
        still = held <= reach(worst[a])
        a, b, held, rank = a[still], b[still], held[still], rank[still]
        low, width = low + width, 2 * width
    join = lambda i, t: np.concatenate([x[i] for x in out]) if out else np.zeros(0, t)
    return join(0, np.int64), join(1, np.int64), join(2, np.float64), best


def pair_distances(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows ``a`` of ``x`` to the rows ``b`` of ``y``; for crowds, where one
    product is cheaper than its pairs, from the cosines of normalised rows."""
    if len(a) * 16 > len(x) * len(y):
        return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T)[a, b], 0.0))
    d = np.empty(len(a))
    for cut in range(0, len(a), 20_000):
        apart = x[a[cut : cut + 20_000]] - y[b[cut : cut + 20_000]]
        d[cut : cut + 20_000] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
    return d


# --- the plan with a query set ---------------------------------------------------------------


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, coordinates: int = COORDINATES, confidence: float = CONFIDENCE, leaf_rows: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k most similar of ``rows`` for each query, itself excluded, and the pairs verified.

    Leaves of a kd-tree over the projected rows are visited from the nearest outwards, for the
    queries of one leaf of a tree of their own together, until the test holds for each of them.
    """
    p = projection(rows.shape[1], coordinates, SEED)
    projected, projected_q = rows @ p, queries @ p
    leaves = kd_cells(projected, leaf_rows)
    low, high = np.array([projected[x].min(axis=0) for x in leaves]), np.array([projected[x].max(axis=0) for x in leaves])
    stop = chi_square_quantile(confidence, coordinates)
    out_q, out_r, out_c, verified = [], [], [], 0
    for group in kd_cells(projected_q, 256):
        q, qp, qid = queries[group], projected_q[group], query_ids[group]
        gap = np.zeros((len(group), len(leaves)), np.float32)
        for d in range(coordinates):
            away = np.maximum(low[None, :, d] - qp[:, None, d], qp[:, None, d] - high[None, :, d])
            gap += np.square(np.maximum(away, 0))
        # The nearest few of all leaves in the projection bound each k-th distance from the start.
        first = min(4 * k, len(rows) - 1)
        few, few_near = np.zeros((len(group), 0), np.int64), np.zeros((len(group), 0), np.float32)
        for members in leaves:
            near = projected_squares(qp, projected[members])
            near[qid[:, None] == row_ids[members][None, :]] = np.inf
            few_near, few = np.hstack((few_near, near)), np.hstack((few, np.broadcast_to(members, near.shape)))
            if few.shape[1] > first > 0:
                nearest = np.argpartition(few_near, first - 1, axis=1)[:, :first]
                few_near, few = np.take_along_axis(few_near, nearest, 1), np.take_along_axis(few, nearest, 1)
        known = np.where(np.isfinite(few_near), np.linalg.norm(rows[few] - q[:, None], axis=2), np.inf)
        verified += known.size
        bound = np.partition(known, k - 1, axis=1)[:, k - 1] if known.shape[1] >= k else np.full(len(group), np.inf)
        best = np.repeat(bound[:, None] * (1 + 1e-6), k, axis=1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for leaf in np.argsort(gap.min(axis=0), kind="stable"):
            open_ = np.flatnonzero(gap[:, leaf] <= stop * np.square(best.max(axis=1)) + NEAR_SLACK)
            if not len(open_):
                continue
            members = leaves[leaf]
            near = projected_squares(qp[open_], projected[members])
            near[qid[open_, None] == row_ids[members][None, :]] = np.inf
            x, y = q[open_], rows[members]
            a, b, d, best[open_] = verify_in_order(near, lambda a, b: pair_distances(x, y, a, b), best[open_], stop)  # noqa: B023
            verified += len(a)
            close = d <= best[open_].max(axis=1)[a]
            found.append((open_[a[close]], row_ids[members[b[close]]], d[close]))
        if not found:
            continue
        a, names, d = (np.concatenate([f[i] for f in found]) for i in range(3))
        top = _best(a, names, 1.0 - np.square(d) / 2, k)
        out_q.append(qid[a[top]])
        out_r.append(names[top])
        out_c.append(1.0 - np.square(d[top]) / 2)
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(out_q, np.int64), join(out_r, np.int64), join(out_c, np.float64), verified


def _classes(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with the representative of their class, and the representatives' vectors."""
    keys = units.groupBy("class_key").agg(F.min("id").alias("rep"))
    members = materialise(units.join(keys, "class_key").select("id", "rep", "unit"), "vectors")
    return members.select("id", "rep"), members.where("id = rep").select("id", "unit")


def neighbours_of_queries(rows: DataFrame, queries: Column, k: int = K, id_col: str = "id", vector_col: str = "embedding", dimension: int = DIMENSION) -> DataFrame:
    """``(id, neighbour, cosine, rank)``: the k most similar other rows of each query row.

    ``queries``: a condition on the column ``id``.  Unusable vectors are neither queries nor
    neighbours; repeated ids count once; ties go to the smaller id; fewer than k rows give all of
    them.  Rows with equal directions are found through one representative each.
    """
    members, reps = _classes(unit_vectors(rows, id_col, vector_col, dimension))
    wanted = members.where(queries).select("rep").distinct()
    asked = reps.join(wanted.withColumnRenamed("rep", "id"), "id", "left_semi")
    n_rows, n_queries = reps.count(), wanted.count()
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism  # so many blocks at least, if they aren't small
    row_blocks = max(1, -(-n_rows // ROW_BLOCK), min(-(-tasks // query_blocks), n_rows // SMALL_BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.col("id").alias("query"), F.col("unit").alias("query_unit")).withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int")).withColumn("rb", numbers(row_blocks))
    right = reps.select("id", "unit").toDF("id", "unit").withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int")).withColumn("qb", numbers(query_blocks))

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "near": [], "cosine": []})
        q, r, c, _ = search_block(_matrix(a["query_unit"], dimension), a["query"].to_numpy(), _matrix(b["unit"], dimension), b["id"].to_numpy(), k)
        return pd.DataFrame({"rep": q, "near": r, "cosine": c.astype(np.float64)})

    local = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(run, "rep bigint, near bigint, cosine double")
    return _ranked(_to_members(members.where(queries), members, local, k), k)


def _to_members(askers: DataFrame, members: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """``(id, neighbour, cosine)`` candidates of the asking members: the k + 1 smallest ids of
    each near class and of their own class."""
    from pyspark.sql import Window

    firsts = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).select(F.col("id").alias("neighbour"), F.col("rep").alias("near"))
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "near"))).where(F.col("n") <= k).drop("n")
    own = askers.select("rep").distinct().select("rep", F.col("rep").alias("near"), F.lit(1.0).alias("cosine"))
    reach = best.unionByName(own).join(firsts, "near").select("rep", "neighbour", "cosine")
    # Of a class's many members only k + 1 can be among the k best of any asker.
    top = reach.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("n") <= k + 1).drop("n")
    return askers.join(top, "rep").where(F.col("id") != F.col("neighbour")).select("id", "neighbour", "cosine")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbour", "cosine", "rank")


# --- the plan with a least similarity ---------------------------------------------------------


def _packed(units: np.ndarray) -> list[bytes]:
    """The rows with 16 bits a component, so that a tree shuffles half of them."""
    return [r.tobytes() for r in np.round(units.astype(np.float64) * PACK_SCALE).astype("<i2")]


def _unpacked(packed, dimension: int) -> np.ndarray:
    """The normalised rows that :func:`_packed` has packed."""
    x = np.frombuffer(b"".join(packed), "<i2").reshape(-1, dimension).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pack_error(dimension: int) -> float:
    """By how much packing moves the distance of two normalised vectors at most; the hundredth
    more is for the rounding of the vectors and of the distance itself."""
    return 2.02 * math.sqrt(dimension) * 0.5 / PACK_SCALE


def trees_for(rows: int, least: float, loss: float = LOSS, leaf_rows: int = LEAF_ROWS) -> int:
    """Trees over so many rows for which a pair at the least similarity is separated in all of them
    with a probability of at most ``loss``.

    A split at the median of a projection separates vectors at an angle t with probability t / pi;
    each halving of the rows down to a leaf is one split.  The number grows with about the 0.22th
    power of the rows at a cosine of 0.9.
    """
    if not 0.0 < least <= 1.0:
        raise ValueError("the least similarity must be above 0 and at most 1")
    splits = math.ceil(math.log2(max(rows / leaf_rows, 1.0)))
    if not splits:
        return 1
    together = min((1.0 - math.acos(least) / math.pi) ** splits, 1.0 - loss)
    return max(LEAST_TREES, math.ceil(math.log(loss) / math.log(1.0 - together)))


def search_cell(units: np.ndarray, ids: np.ndarray, least: float, k: int, leaf_rows: int, seed: int, error: float = 0.0, coordinates: int = COORDINATES_LEAST, confidence: float = CONFIDENCE_LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each row of a cell all others in its leaf that may be among its k most similar of at
    least ``least``, if each distance is known up to ``error``; and the pairs verified.

    The true k-th distance is at most the k-th measured plus ``error``, so a row is kept up to
    twice that beyond the k-th: ranks among nearly equal rows are left to the exact test.
    """
    p = projection(units.shape[1], coordinates, seed)
    projected = units.astype(np.float32) @ p
    reach = math.sqrt(2.0 - 2.0 * least) + error
    stop = chi_square_quantile(confidence, coordinates)
    out, verified = [], 0
    for leaf in kd_cells(projected, leaf_rows):
        x, own, whole = projected[leaf], ids[leaf], units[leaf]
        for at in range(0, len(leaf), 512):
            near = projected_squares(x[at : at + 512], x)
            near[np.arange(len(near)), at + np.arange(len(near))] = np.inf
            some = np.flatnonzero(near.min(axis=1) <= stop * reach * reach + NEAR_SLACK)
            if not len(some):
                continue
            mine = whole[at + some]
            a, b, d, best = verify_in_order(near[some], lambda a, b: pair_distances(mine, whole, a, b), np.full((len(some), k), reach), stop, error)  # noqa: B023
            verified += len(a)
            good = d <= np.minimum(best.max(axis=1)[a] + 2 * error + ROOT_SLACK, reach)
            out.append((own[at + some[a[good]]], own[b[good]], d[good]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), verified
    a, b, d = (np.concatenate([x[i] for x in out]) for i in range(3))
    return a, b, 1.0 - np.square(d) / 2, verified


def similar_neighbours(rows: DataFrame, least: float, k: int = K, id_col: str = "id", vector_col: str = "embedding", dimension: int = DIMENSION, trees: int | None = None) -> DataFrame:
    """``(id, neighbour, cosine, rank)``: of each row's k most similar other rows those with a
    cosine of at least ``least``.

    That is the same as searching for the k most similar and filtering them afterwards: a
    neighbour's rank depends only on rows at least as similar as it.  ``trees``: their number, by
    default :func:`trees_for` the rows.  Unusable vectors, repeated ids, ties and equal directions:
    as in :func:`neighbours_of_queries`.
    """
    members, reps = _classes(unit_vectors(rows, id_col, vector_col, dimension))
    spark = rows.sparkSession
    count = reps.count()
    cells = max(1, -(-count // CELL_ROWS))
    trees = trees or trees_for(count, least, LOSS, LEAF_ROWS)
    sample = reps.select("unit") if count <= SAMPLE_ROWS else reps.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) < F.lit(int(900_000 * SAMPLE_ROWS / count))).select("unit").limit(SAMPLE_ROWS)
    held = _matrix([bytes(r[0]) for r in sample.collect()], dimension) if cells > 1 else np.zeros((0, dimension), np.float32)
    tops = [Tree(held @ projection(dimension, TREE_COORDINATES, SEED + t), cells) for t in range(trees)]
    shared = spark.sparkContext.broadcast([(t.depth, t.axis, t.value) for t in tops])  # at most 2 * cells numbers a tree, cells = rows / CELL_ROWS

    def sender(first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = []
            for t, (depth, axis, value) in list(enumerate(shared.value))[first : first + TREES_AT_ONCE]:
                tree = Tree.__new__(Tree)
                tree.depth, tree.axis, tree.value = depth, axis, value
                known.append((t, tree, projection(dimension, TREE_COORDINATES, SEED + t)))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix([v.as_py() for v in batch.column(1)], dimension)
                packed = pa.array(_packed(x), pa.binary())
                for t, tree, p in known:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(tree.cell(x @ p), pa.int32()), batch.column(0), packed], names=["tree", "cell", "id", "unit"])

        return send

    def search(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        # Every pair within the rounding of the k-th best comes out; the exact test follows on whole vectors.
        a, b, _, _ = search_cell(_unpacked(cell["unit"], dimension), cell["id"].to_numpy(), least, k, LEAF_ROWS, SEED + key[0], pack_error(dimension))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    # A few cells a task, however many rows there are; the grouping keeps this partitioning.  A few trees
    # at a time, so that the disk holds no more of their copies at once.
    found = []
    for first in range(0, trees, TREES_AT_ONCE):
        sent = reps.mapInArrow(sender(first), "tree int, cell int, id bigint, unit binary")
        tasks = max(2 * spark.sparkContext.defaultParallelism, -(-min(TREES_AT_ONCE, trees - first) * cells // CELLS_A_TASK))
        near = sent.repartition(tasks, "tree", "cell").groupBy("tree", "cell").applyInPandas(search, "a bigint, b bigint")
        found.append(materialise(near.distinct(), "pairs"))
        if first + TREES_AT_ONCE < trees:
            spark.sparkContext._jvm.System.gc()  # the driver drops the shuffle files of what it no longer refers to
    pairs = reduce(DataFrame.unionByName, found)
    pairs = pairs.distinct() if len(found) > 1 else pairs
    exact = _verified(pairs, reps, dimension).where(F.col("cosine") >= least)
    both = exact.select(F.col("a").alias("rep"), F.col("b").alias("near"), "cosine").unionByName(exact.select(F.col("b").alias("rep"), F.col("a").alias("near"), "cosine"))
    # Only members that share their class or have a near class can have a neighbour.
    crowded = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    asking = both.select("rep").unionByName(crowded).distinct()
    askers = members.join(asking, "rep", "left_semi").select("id", "rep")
    return _ranked(_to_members(askers, members, both, k), k).where(F.col("cosine") >= least)


def _verified(pairs: DataFrame, reps: DataFrame, dimension: int) -> DataFrame:
    """Exact cosines of the pairs ``(a, b)``, in double precision."""
    joined = pairs.join(reps.select(F.col("id").alias("a"), F.col("unit").alias("ua")), "a").join(reps.select(F.col("id").alias("b"), F.col("unit").alias("ub")), "b").select("a", "b", "ua", "ub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_matrix([v.as_py() for v in batch.column(i)], dimension).astype(np.float64) for i in (2, 3))
            c = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c, pa.float64())], names=["a", "b", "cosine"])

    return joined.mapInArrow(run, "a bigint, b bigint, cosine double")


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``, of rows that are each other's neighbours."""
    pairs = neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
    return pairs.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("id_a", "id_b")
