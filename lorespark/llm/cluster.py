"""11. Centroid clustering with block-norm screening."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.frames import cut

DIMENSION = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
SEGMENTS = 8
MOST = 2**63 - 1  # distances and their sums that no long holds stand as this
_NARROW = 1 << 25  # components below this have squared distances below 2 ** 58, and sums of a batch in a long
_LIMB = 30


def segment_norms(v: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The Euclidean norms of each row's ``segments`` stretches of components (of equal length, but for the last ones)."""
    parts = np.array_split(np.arange(v.shape[1]), segments)
    wide = _floats(v)
    with np.errstate(over="ignore"):
        return np.stack([np.sqrt((wide[:, p] ** 2).sum(axis=1)) for p in parts], axis=1)


def _floats(v: np.ndarray) -> np.ndarray:
    """As doubles; whole numbers beyond them are infinite."""
    if v.dtype != object:
        return v.astype(float)
    most = 1 << 1023
    return np.array([float(x) if -most < x < most else np.inf for x in v.ravel()]).reshape(v.shape)


def lower_bounds(norms: np.ndarray, centre_norms: np.ndarray) -> np.ndarray:
    """Of each vector and centroid, a bound that their squared distance is not below, from segment norms alone.

    In each segment x.c <= |x||c| (Cauchy and Schwarz), so |x - c|^2 >= (|x| - |c|)^2. A
    part in a million is left for the rounding of norms, which is relative to their size.
    """
    made = np.zeros((len(norms), len(centre_norms)))
    size = np.zeros_like(made)
    with np.errstate(over="ignore", invalid="ignore"):
        for s in range(norms.shape[1]):
            made += (norms[:, s, None] - centre_norms[None, :, s]) ** 2
            size += norms[:, s, None] ** 2 + centre_norms[None, :, s] ** 2
        made -= 1e-6 * size + 1e-6
    return np.where(np.isfinite(made), made, -np.inf)  # of numbers beyond doubles nothing is known


def nearest(v: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), the exact squared distance, and how many exact distances that took.

    Centroids are taken in the order of their bounds; one whose bound is above the best
    exact distance so far is passed over. Rows of Python integers (dtype object) may be of any size.
    """
    bounds = lower_bounds(norms, segment_norms(centres, norms.shape[1]))
    order = np.argsort(bounds, axis=1, kind="stable")
    rows = np.arange(len(v))
    best, cluster, taken = None, np.zeros(len(v), np.int64), 0
    for turn in range(len(centres)):
        k = order[rows, turn]
        open_ = rows if best is None else np.flatnonzero(bounds[rows, k] <= _floats(best))
        if not len(open_):
            break  # bounds only rise from here on
        k = k[open_]
        exact = ((v[open_] - centres[k]) ** 2).sum(axis=1)
        taken += len(open_)
        if best is None:
            best, cluster = exact, k
            continue
        closer = (exact < best[open_]) | ((exact == best[open_]) & (k < cluster[open_]))
        best[open_[closer]], cluster[open_[closer]] = exact[closer], k[closer]
    return cluster, best, taken


def _limbs(x: int) -> list[int]:
    """A whole number as signed digits to the base 2 ** 30, which can be summed one by one."""
    out, sign, x = [], -1 if x < 0 else 1, abs(x)
    while x:
        out.append(sign * (x & ((1 << _LIMB) - 1)))
        x >>= _LIMB
    return out


def kept_vectors(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id, v, norms and wide of the rows with exactly ``dimension`` components, none null or not finite.

    ``v`` holds floor(scale * x) of each component: 32-bit integers, or, in a wide row
    (a component of 2 ** 25 or more), decimal text joined by commas. ``norms`` are the
    segment norms, which every round screens by.
    """

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.cast(batch.column(1), pa.large_list(pa.float64()))
            column = pc.if_else(pc.equal(pc.list_value_length(column), dimension), column, pa.scalar(None, column.type))
            keep = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            x = column.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)  # a null component is not a number here
            fine = np.isfinite(x).all(axis=1)
            keep, x = keep[fine], x[fine]
            with np.errstate(over="ignore"):
                made = np.floor(x * scale)
            wide = ~(np.abs(made) < _NARROW).all(axis=1)
            narrow = np.where(wide[:, None], 0, made).astype("<i4")
            v = [r.tobytes() for r in narrow]
            norms = segment_norms(narrow)
            for i in np.flatnonzero(wide):
                whole = [_floor_of(c, scale) for c in x[i].tolist()]
                v[i] = ",".join(map(str, whole)).encode()
                norms[i] = segment_norms(np.array([whole], object))[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), pa.array(v, pa.binary()), pa.array([r.astype("<f8").tobytes() for r in norms], pa.binary()), pa.array(wide)],
                names=["vec_id", "v", "norms", "wide"],
            )

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(floors, "vec_id long, v binary, norms binary, wide boolean")


def _floor_of(x: float, scale: int) -> int:
    over, under = x.as_integer_ratio()
    return over * scale // under


def _values(v: bytes, wide: bool) -> list[int]:
    return [int(c) for c in v.split(b",")] if wide else np.frombuffer(v, "<i4").tolist()


def first_centroids(kept: DataFrame, n: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The ``n`` kept vectors with the smallest sha256 of ``seed:vec_id``, in the order of the hashes.

    Vectors that share an id follow each other in the order of their components' bytes; one without an id comes last.
    """
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.select(place.alias("place"), "v", "wide").orderBy(F.asc_nulls_last("place"), "wide", "v").limit(n)
    return [_values(bytes(r["v"]), r["wide"]) for r in first.collect()]  # n rows


def _batches(batches: Iterator[pa.RecordBatch], centres: list[list[int]]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, components, clusters and distances: narrow rows as longs, wide ones as Python integers."""
    whole = np.array(centres, object).reshape(len(centres), -1)
    small = all(abs(c) < _NARROW for row in centres for c in row)
    fixed = whole.astype(np.int64) if small else whole
    for batch in batches:
        wide = batch.column(3).to_numpy(zero_copy_only=False)
        for kind in (False, True):
            rows = np.flatnonzero(wide == kind)
            if not len(rows):
                continue
            mine = batch.take(pa.array(rows))
            if kind:
                v = np.array([_values(x.as_py(), True) for x in mine.column(1)], object)
            else:
                v = np.frombuffer(b"".join(x.as_py() for x in mine.column(1)), "<i4").reshape(len(rows), -1).astype(np.int64)
            norms = np.frombuffer(b"".join(x.as_py() for x in mine.column(2)), "<f8").reshape(len(rows), -1)
            cluster, distance, _ = nearest(v if not kind and small else v.astype(object), norms, fixed if not kind else whole)
            yield mine.column(0), v, cluster, distance


def next_centroids(kept: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """One round: every vector goes to its nearest centroid, and each non-empty centroid becomes the floor of its vectors' mean.

    Tasks send on the sums of their own rows, a few rows for each centroid, so no
    cluster's vectors meet, however many there are.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for _, v, cluster, _ in _batches(batches, centres):
            for k in np.unique(cluster).tolist():
                mine = v[cluster == k]
                part = [len(mine), *mine.sum(axis=0).tolist()]
                total[k] = [a + b for a, b in zip(total.get(k, [0] * len(part)), part, strict=True)]
        rows = []
        for k, values in total.items():
            digits = [_limbs(int(x)) for x in values]
            for limb in range(max(map(len, digits))):
                rows.append((k, limb, [d[limb] if limb < len(d) else 0 for d in digits]))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)]
        yield pa.RecordBatch.from_arrays(made, names=["cluster", "limb", "digits"])

    parts = kept.mapInArrow(sums, "cluster int, limb int, digits array<long>")
    width = len(centres[0]) + 1
    summed = parts.groupBy("cluster", "limb").agg(F.array(*[F.sum(F.col("digits")[i]) for i in range(width)]).alias("digits"))
    totals: dict[int, list[int]] = {}
    for r in summed.collect():  # a few rows for each centroid
        have = totals.setdefault(r["cluster"], [0] * width)
        totals[r["cluster"]] = [a + (b << (_LIMB * r["limb"])) for a, b in zip(have, r["digits"], strict=True)]
    return [[x // totals[k][0] for x in totals[k][1:]] if k in totals else c for k, c in enumerate(centres)]


def assigned(kept: DataFrame, centres: list[list[int]]) -> DataFrame:
    """vec_id, cluster and squared distance of every kept vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _batches(batches, centres):
            capped = pa.array([min(int(d), MOST) for d in distance] if distance.dtype == object else distance, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), capped], names=["vec_id", "cluster", "distance"])

    return kept.mapInArrow(assign, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance of every kept vector, and the final centroids.

    Vectors are turned into integers once, with their segment norms, and cut off in the
    shared checkpoint folder; each round reads them there, and only sums come back.
    With fewer than ``n`` kept vectors there are as many centroids; with none no rows.
    """
    kept = cut(kept_vectors(vectors, dimension, scale))
    centres = first_centroids(kept, n, seed)
    for _ in range(rounds if centres else 0):
        centres = next_centroids(kept, centres)
    return assigned(kept, centres or [[0] * dimension]), centres


def clustered_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    A null vector, one of another length than 64, or with a component that is null or not
    finite is left out. Every row counts: repeated rows are vectors of their own, of equal
    results; a null id is carried, and seeds a centroid only after all others. Components
    may be of any size; a distance or a sum beyond a long stands as the largest long. Other
    columns aren't read. An empty table gives no rows.
    """
    found, centres = clusters(vectors)
    found = cut(found)
    own = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # one row for each centroid
    capped = lambda x: min(int(x), MOST)
    every = capped(sum(int(r["own"]) for r in own))
    rows = [(r["cluster"], capped(r["own"]), every, hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()) for r in own]
    totals = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
