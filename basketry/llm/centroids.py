"""Centroid clustering in exact integers, screened in float32.

Components are turned into integers, and all sums, means and distances are integers. In each round a
task multiplies its vectors with all centroids in float32. The rounding error of such a product is
bounded (products and sums of n terms in any order, and the rounding of both factors), which gives an
interval for each distance. Centroids whose interval overlaps that of the nearest are the shortlist;
where it holds more than one, their distances are computed again in 64-bit integers, and the lowest
number of the nearest wins.

A task emits the sums of its vectors by centroid and component, which Spark adds up; k times the
dimensions numbers reach the driver in each round, and k centroids go to the tasks, whatever the
number of vectors. Each round reads the table again, so nothing of its size is written in between,
and a lost executor costs the tasks that it ran.

Defined results: vectors that are null, have another length, or hold a null or non-finite component
take no part; a vector with a null id can't be a first centroid, but is assigned; repeated rows count
each by itself; fewer vectors than k give as many centroids; an empty table gives an empty result; if
no vector has an id, clusters and distances are null. Components whose integer exceeds 2^27 are
handled in unbounded integers; a distance or inertia beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import cut, unused

#: Integers up to this size have distances of up to 64 components within 64 bits.
NARROW = 1 << 27
#: Sums leave a task in parts of so many bits.
PART_BITS = 40
#: The unit of rounding of float32.
UNIT = 2.0**-24


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly; scale is a power of two."""
    return math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale


def integers(column: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that take part, their integers, and which of these rows are wider than NARROW (their integers are 0 there)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dimensions)
    flat = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dimensions)  # a null becomes NaN
    finite = np.isfinite(x).all(axis=1)
    rows, x = rows[finite], x[finite]
    wide = (np.abs(x) >= NARROW / scale).any(axis=1)
    return rows, np.floor(np.where(wide[:, None], 0, x) * scale).astype(np.int64), wide


def wide_integers(column: pa.Array, row: int, scale: int) -> list[int]:
    return [whole(float(x), scale) for x in column[row].as_py()]


def error_bound(terms: int) -> float:
    """For a float32 dot product of so many terms, both factors rounded: error / (norm * norm)."""
    n = (terms + 2) * UNIT
    return n / (1 - n)


class Centroids:
    def __init__(self, points: list[list[int]]):
        self.points = points
        self.narrow = bool(points) and all(abs(v) <= NARROW for p in points for v in p)
        if self.narrow:
            self.c = np.array(points, np.int64)
            self.c32 = self.c.astype(np.float32)
            self.squares = (self.c**2).sum(axis=1).astype(np.float64)

    def shortlist(self, x: np.ndarray) -> np.ndarray:
        """Which centroids may be the nearest of each row; surely all that are."""
        dot = (x.astype(np.float32) @ self.c32.T).astype(np.float64)
        # What all distances of a row share, its own square, is left out.
        part = self.squares - 2 * dot
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(self.squares) * (1 + 1e-9)
        error = 2 * error_bound(x.shape[1]) * norms + 2.0**-50 * (self.squares + 2 * np.abs(dot))
        return part - error <= (part + error).min(axis=1)[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row of narrow integers."""
        if not self.narrow:
            return np.array([self.exact([int(v) for v in row])[0] for row in x], np.int64)
        short = self.shortlist(x)
        best = short.argmax(axis=1)
        open_ = np.flatnonzero(short.sum(axis=1) > 1)
        if len(open_):
            row, number = np.nonzero(short[open_])
            exact = np.full((len(open_), len(self.c)), np.iinfo(np.int64).max)
            exact[row, number] = ((x[open_[row]] - self.c[number]) ** 2).sum(axis=1)
            best[open_] = exact.argmin(axis=1)  # the first of equals
        return best

    def distances(self, x: np.ndarray, best: np.ndarray) -> list[int]:
        if self.narrow:
            return ((x - self.c[best]) ** 2).sum(axis=1).tolist()
        return [self.distance([int(v) for v in row], k) for row, k in zip(x, best.tolist(), strict=True)]

    def distance(self, row: list[int], k: int) -> int:
        return sum((a - b) ** 2 for a, b in zip(row, self.points[k], strict=True))

    def exact(self, row: list[int]) -> tuple[int, int]:
        """The number of the nearest centroid and its distance, in unbounded integers."""
        distance, k = min((self.distance(row, k), k) for k in range(len(self.points)))
        return k, distance


def _parts(value: int) -> list[int]:
    """value as parts of PART_BITS bits, the lowest first, all with its sign."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest:
        out.append(sign * (rest & ((1 << PART_BITS) - 1)))
        rest >>= PART_BITS
    return out or [0]


def _sums(centroids: Centroids, dimensions: int, scale: int):
    """From vectors to (cluster, place, part, value): sums of the components (places from 0) and the count (place -1)."""
    k = len(centroids.points)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        wide_sums: dict[int, list[int]] = defaultdict(lambda: [0] * dimensions)
        for batch in batches:
            rows, x, wide = integers(batch.column(0), dimensions, scale)
            narrow = x[~wide]
            if len(narrow):
                best = centroids.nearest(narrow)
                counts += np.bincount(best, minlength=k)
                for number in np.unique(best).tolist():
                    sums[number] += narrow[best == number].sum(axis=0)
            for row in rows[wide].tolist():
                values = wide_integers(batch.column(0), row, scale)
                number, _ = centroids.exact(values)
                counts[number] += 1
                wide_sums[number] = [a + b for a, b in zip(wide_sums[number], values, strict=True)]
        out = [(n, -1, 0, int(counts[n])) for n in range(k) if counts[n]]
        for n in range(k):
            total = [int(a) + b for a, b in zip(sums[n], wide_sums.get(n, [0] * dimensions), strict=True)] if counts[n] else []
            out += [(n, place, part, value) for place, v in enumerate(total) for part, value in enumerate(_parts(v))]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=["cluster", "place", "part", "value"])

    return run


def _assigned(centroids: Centroids, dimensions: int, scale: int):
    """From (id, vector) to (id, cluster, distance)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x, wide = integers(batch.column(1), dimensions, scale)
            cluster: list[int | None] = [None] * len(rows)
            distance: list[int | None] = [None] * len(rows)
            if centroids.points:
                at = np.flatnonzero(~wide)
                if len(at):
                    best = centroids.nearest(x[at])
                    for k, number, d in zip(at.tolist(), best.tolist(), centroids.distances(x[at], best), strict=True):
                        cluster[k], distance[k] = number, d
                for k in np.flatnonzero(wide).tolist():
                    cluster[k], distance[k] = centroids.exact(wide_integers(batch.column(1), int(rows[k]), scale))
            held = [d if d is not None and d < 1 << 63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cluster, pa.int32()), pa.array(held, pa.int64())], names=["id", "cluster", "distance"])

    return run


def _taking_part(vector: Column, dimensions: int) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(vector) == dimensions) & ~odd


def first_centroids(vectors: DataFrame, id_col: str, vector_col: str, k: int, dimensions: int, scale: int, seed: int) -> list[list[int]]:
    """The k vectors with the least hash of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    chosen = vectors.where(F.col(id_col).isNotNull() & _taking_part(F.col(vector_col), dimensions)).select(order.alias("h"), F.col(vector_col).alias("v")).orderBy("h", "v").limit(k)
    return [[whole(float(x), scale) for x in r["v"]] for r in chosen.collect()]


def moved(vectors: DataFrame, points: list[list[int]], dimensions: int, scale: int) -> list[list[int]]:
    """The floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    parts = vectors.mapInArrow(_sums(Centroids(points), dimensions, scale), "cluster int, place int, part int, value long")
    # k times (dimensions + 1) rows, or a few times as many for wide integers.
    summed = parts.groupBy("cluster", "place", "part").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect()
    total: dict[tuple[int, int], int] = defaultdict(int)
    for r in summed:
        total[r["cluster"], r["place"]] += int(r["value"]) << (PART_BITS * r["part"])
    return [[total[n, d] // total[n, -1] for d in range(dimensions)] if total[n, -1] else p for n, p in enumerate(points)]


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that takes part.

    scale: a power of two; components become floor(scale * x). dimensions: up to 64.
    """
    if scale & (scale - 1) or not 1 <= dimensions <= 64:
        raise ValueError("scale must be a power of two, dimensions lie between 1 and 64")
    points = first_centroids(vectors, id_col, vector_col, k, dimensions, scale, seed)
    for _ in range(rounds if points else 0):
        points = moved(vectors.select(vector_col), points, dimensions, scale)
    kind = vectors.schema[id_col].dataType.simpleString()
    assigned = cut(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(_assigned(Centroids(points), dimensions, scale), f"id {kind}, cluster int, distance long"))
    # A sum of distances that holds one beyond a long is beyond it too.
    exact = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(20,0)")))
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(exact.alias("s")).collect()}
    by_number = lambda values, t: F.coalesce(*(F.when(F.col("cluster") == n, F.lit(v)) for n, v in values.items()), F.lit(None)).cast(t)
    fits = lambda x: None if x is None or x >= 1 << 63 else int(x)
    digests = {n: hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for n, p in enumerate(points)}
    total = None if any(s is None for s in sums.values()) else fits(sum(sums.values()))
    out = assigned.select(
        F.col("id").alias(unused(assigned.drop("id"), id_col)), "cluster", "distance",
        by_number({n: fits(s) for n, s in sums.items() if n is not None}, "long").alias("cluster_inertia"),
        F.lit(total).cast("long").alias("inertia"),
        by_number(digests, "string").alias("centroid_sha256"),
    )
    return out
