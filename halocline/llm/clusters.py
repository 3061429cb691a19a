"""Centroids of integer vectors by sort-means.

Each round orders the other centroids by their distance from each centroid. A vector scans them from the centroid that
it is assigned to, nearest first, and stops at the first that is strictly farther from that centroid than twice its own
distance: by the triangle inequality none from there on is nearer, or as near. All arithmetic is exact.

Vectors stay where they are: a round reads them once and sends sums, one row a task, centroid and component. Where the
rounds before have left a vector is found by replaying them on it, since the assignments were last written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm.workspace import Workspace

SCALE = 1024
LIMB = 28  # bits of a digit of a long sum
LARGEST = (1 << 63) - 1


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles: as doubles, or as Python integers if one is too large for exact squares of doubles."""
    if not x.size or np.abs(x).max() < (1 << 42) / SCALE:
        return np.floor(x * SCALE)
    whole = np.array([int(np.floor(v * SCALE)) if abs(v) < 2.0**52 else int(v) * SCALE for v in x.ravel()], object)
    return whole.reshape(x.shape)


def _exact(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if the sum of squared differences is exact in them, else both as Python integers."""
    if v.dtype != object and c.dtype != object:
        most = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0))
        if 4 * most * most * max(1, v.shape[1]) < 1 << 53:
            return v, c
    return _whole(v), _whole(c)


def _whole(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else x.astype(np.int64).astype(object)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``v`` from ``c``, a vector or a row for each."""
    d = v - c
    return (d * d).sum(1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


def scan(v: np.ndarray, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids ``c`` to each row of ``v``, the smaller number of equally near ones, and the squared
    distance; ``at``: the centroids that the rows are assigned to so far."""
    v, c = _exact(v, c)
    own = squared(v, c[at])
    best, least = at.copy(), own.copy()
    for a in np.unique(at):
        apart = squared(c, c[a])
        order = sorted((o for o in range(len(c)) if o != a), key=lambda o: (apart[o], o))
        rows = np.flatnonzero(at == a)
        for o in order:
            rows = rows[apart[o] <= 4 * own[rows]]
            if not len(rows):
                break
            d = squared(v[rows], c[o])
            nearer = (d < least[rows]) | ((d == least[rows]) & (o < best[rows]))
            best[rows[nearer]], least[rows[nearer]] = o, d[nearer]
    return best, least


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return integers(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """(place, digit): digits of LIMB bits, the last signed, so small that their sums over many tasks fit a long."""
    place = 0
    while abs(total) >= 1 << 40:
        yield place, total & ((1 << LIMB) - 1)
        total >>= LIMB
        place += 1
    yield place, total


def sort_means(vectors: DataFrame, k: int, rounds: int, dims: int, first: Column, replay: int = 8, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector of exactly ``dims`` components, none null or non-finite: vec_id, cluster, distance (squared, of
    floor(1024 * component)), cluster_inertia and inertia (distance summed over its cluster and over all), centroid_sha256
    (of the final centroid's components as decimal integers joined by commas). Other rows are left out.

    The ``k`` vectors of smallest ``first``, null last and then by components, are the centroids 0, 1, ...; of fewer
    vectors there are as many centroids. In each of ``rounds`` rounds every vector goes to the nearest centroid, of equal
    ones the smaller number, and centroids become the floor of their vectors' mean; empty ones stay. Repeated rows, and
    rows of equal or null vec_id, count one by one. Components of any finite size are exact; a distance or sum beyond the
    largest long is given as that. An empty table gives no rows. The driver holds ``k`` centroids, and tasks get them.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "clusters")
    e = F.col("embedding")
    sound = e.isNotNull() & (F.size(e) == dims) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), first.alias("first")).filter(sound)
    table = work.write(kept.withColumn("cluster", F.lit(0)), "vectors")
    drawn = table.orderBy(F.col("first").asc_nulls_last(), "embedding").limit(k).select("embedding").collect()
    table = table.drop("first")
    start = integers(np.array([r[0] for r in drawn], np.float64).reshape(-1, dims))
    past: list[np.ndarray] = [start]  # centroids of the rounds since assignments were written, the newest last

    def placed(batches: Iterator[pa.RecordBatch], seen: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                v, at = _vectors(batch, dims), batch.column("cluster").to_numpy()
                for c in seen:
                    at, distance = scan(v, at, c)
                yield batch, v, at, distance

    for _ in range(rounds if len(start) else 0):
        if len(past) > replay:
            table, past = _assigned(work, table, past[:-1], placed), past[-1:]

        def sums(batches: Iterator[pa.RecordBatch], seen: list[np.ndarray] = list(past)) -> Iterator[pa.RecordBatch]:  # noqa: B006  a copy for the task
            totals, counts = np.zeros((len(seen[-1]), dims), object), np.zeros(len(seen[-1]), np.int64)
            for _, v, at, _ in placed(batches, seen):
                counts += np.bincount(at, minlength=len(counts))
                for a in np.unique(at):
                    totals[a] += _whole(v[at == a].sum(0))
            rows = [(a, -1, 0, int(n)) for a, n in enumerate(counts) if n]
            rows += [(a, j, p, x) for a in np.flatnonzero(counts) for j in range(dims) for p, x in _limbs(int(totals[a, j]))]
            cluster, component, place, value = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch({"cluster": pa.array(cluster, pa.int32()), "component": pa.array(component, pa.int32()), "place": pa.array(place, pa.int32()), "value": pa.array(value, pa.int64())})

        summed = table.mapInArrow(sums, "cluster int, component int, place int, value long").groupBy("cluster", "component", "place").agg(F.sum("value").alias("value"))
        centroids, counts = _whole(past[-1]).copy(), [0] * len(start)
        totals = np.zeros_like(centroids)
        for a, j, p, x in summed.collect():  # k times the components
            if j < 0:
                counts[a] = x
            else:
                totals[a, j] += x << (LIMB * p)
        for a, n in enumerate(counts):
            if n:
                centroids[a] = totals[a] // n
        past.append(_small(centroids))

    def last(batches: Iterator[pa.RecordBatch], seen: list[np.ndarray] = list(past)) -> Iterator[pa.RecordBatch]:  # noqa: B006
        for batch, _, at, distance in placed(batches, seen):
            long = pa.array([min(int(d), LARGEST) for d in distance], pa.int64())
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "cluster": pa.array(at, pa.int32()), "distance": long})

    schema = table.select("vec_id").schema.add("cluster", "integer").add("distance", "long")
    found = work.write(table.mapInArrow(last, schema), "found")
    work.keep("found")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = spark.createDataFrame([(a, ",".join(str(int(x)) for x in c)) for a, c in enumerate(past[-1])], "cluster int, components string")
    by = found.groupBy("cluster").agg(total.alias("own"))
    every = by.agg(F.sum("own").alias("all"))
    capped = [F.least(F.col(c), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias(a) for c, a in (("own", "cluster_inertia"), ("all", "inertia"))]
    sides = whole.join(by, "cluster").crossJoin(every).select("cluster", *capped, F.sha2("components", 256).alias("centroid_sha256"))  # a row a centroid
    return found.join(F.broadcast(sides), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _small(x: np.ndarray) -> np.ndarray:
    """Integers as doubles where these hold them exactly."""
    return x.astype(np.float64) if all(abs(v) < 1 << 52 for v in x.ravel()) else x


def _assigned(work: Workspace, table: DataFrame, seen: list[np.ndarray], placed) -> DataFrame:
    """``table`` written again with the assignments of the rounds so far."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, at, _ in placed(batches, seen):
            yield batch.set_column(batch.schema.get_field_index("cluster"), "cluster", pa.array(at, pa.int32()))

    return work.write(table.mapInArrow(keep, table.schema), "assigned")
