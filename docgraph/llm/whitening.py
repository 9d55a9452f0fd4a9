"""Embedding whitening: leading eigenvectors of the covariance by FEAST contour integration, and every row's whitened components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import with_fields, written

#: Entries become floor(SCALE * c) + SHIFT. The shift moves neither centred vectors nor deviations, so it is left out of stored vectors.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Quadrature nodes on the upper half of a contour, and eigenvalues that one contour holds at most, but for clusters.
NODES, PER_CONTOUR = 8, 8
#: Vectors of a block beside twice as many as its contour holds.
SPARE = 4
#: An eigenvalue below this share of the trace is rounding error, and has no component.
NOTHING = 1e-12
ROUNDS = 12


def grid(vector: Column) -> Column:
    """floor(64 * c) of every entry as long; null where the vector is null or an entry is null, not finite or too large for a long."""
    real = F.transform(vector, lambda c: c.cast("double"))
    good = F.forall(real, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e16))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(real, lambda c: F.floor(c * SCALE).cast("long")))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, y) of the rows that have a usable vector of the commonest length (of equally common ones the longest), written."""
    rows = written(vectors.select("vec_id", grid(F.col("embedding")).alias("y")).where("y is not null and size(y) > 0"), "whitening-rows")
    sizes = rows.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return rows if len(sizes) < 2 else rows.where(F.size("y") == sizes[0]["d"])


def stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """(n, sum of each dimension as Python integers) of fit(y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = stacked(batch.column(0))
            exact = y if not y.size or float(np.abs(y).max()) * len(y) < 2**62 else y.astype(object)
            total = [int(t) for t in exact.sum(axis=0)]
            yield pa.RecordBatch.from_pydict({"j": pa.array([-1, *range(len(total))], pa.int32()), "s": pa.array([len(y), *total], pa.decimal128(38, 0))})

    got = {r["j"]: int(r["s"]) for r in fit.select("y").mapInArrow(run, "j int, s decimal(38,0)").groupBy("j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return got.get(-1, 0), np.array([got[j] for j in range(len(got) - 1)], dtype=object)


def covariance(fit: DataFrame, mean: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Covariance of fit(y), or of its coordinates on the columns of basis; divisor n, centred before multiplying.

    Each task adds up its rows; the sums of a dimension meet in one row per task, and are added per dimension. What comes back
    is a square of the dimensions, whatever the rows.
    """
    shared = fit.sparkSession.sparkContext.broadcast((mean, basis))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, basis = shared.value
        total, n = 0.0, 0
        for batch in batches:
            z = stacked(batch.column(0)) - mean
            z = z if basis is None else z @ basis
            total, n = total + z.T @ z, n + len(z)
        if n:
            d = len(total)
            yield pa.RecordBatch.from_pydict({"j": pa.array(np.arange(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "row": pa.ListArray.from_arrays(pa.array(np.arange(0, d * d + 1, d), pa.int32()), pa.array(total.ravel()))})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            for j, n, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), stacked(batch.column(2)), strict=True):
                kept = rows.setdefault(j, [0, 0.0])
                rows[j] = [kept[0] + n, kept[1] + row]
        if rows:
            yield pa.RecordBatch.from_pydict({"j": pa.array(list(rows), pa.int32()), "n": pa.array([n for n, _ in rows.values()], pa.int64()), "row": pa.array([r.tolist() for _, r in rows.values()], pa.list_(pa.float64()))})

    ddl = "j int, n long, row array<double>"
    found = fit.select("y").mapInArrow(partial, ddl).repartition("j").sortWithinPartitions("j", "n", F.col("row")[0]).mapInArrow(added, ddl).collect()
    out = np.stack([np.array(r["row"]) / r["n"] for r in sorted(found, key=lambda r: r["j"])])
    return (out + out.T) / 2


def pivots(a: np.ndarray) -> tuple[int, float]:
    """(positive ones, size of the least) of the pivots of a symmetric factorisation.

    Pivots are the larger of the best diagonal entry and the best 2 by 2 block, which counts as one on either side of zero.
    """
    above, least = 0, np.inf
    while len(a):
        diagonal = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        p, far = int(diagonal.argmax()), off.max()
        if diagonal[p] == far == 0:
            return above, 0.0
        pick = [p] if diagonal[p] >= 0.64 * far else list(divmod(int(off.argmax()), len(a)))
        block = a[np.ix_(pick, pick)]
        above += int(a[p, p] > 0) if len(pick) == 1 else 1
        least = min(least, diagonal[p] if len(pick) == 1 else abs(np.linalg.det(block)) / far)
        rest = np.setdiff1d(np.arange(len(a)), pick)
        side = a[np.ix_(rest, pick)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
    return above, least


def inertia(matrix: np.ndarray, shift: float, block: int = 64) -> int:
    """Number of eigenvalues above shift (Sylvester's law): positive pivots of a leading block, then of what it leaves of the rest.

    A leading block without a sound pivot gives way to pivots from the whole of what is left.
    """
    a, above = matrix - shift * np.eye(len(matrix)), 0
    tiny = 1e-8 * float(np.abs(a).max(initial=0))
    while len(a) > block:
        more, least = pivots(a[:block, :block])
        if least <= tiny:
            break
        above += more
        a = a[block:, block:] - a[block:, :block] @ np.linalg.solve(a[:block, :block], a[:block, block:])
    return above + pivots(a)[0]


def cut_above(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[float, int]:
    """(shift, eigenvalues above it): the largest shift found by bisection with at least `count` above it and none close by."""
    near = 1e-9 * high
    for _ in range(200):
        middle = (low + high) / 2
        found = inertia(matrix, middle)
        if found >= count:
            low = middle
            if found == count and inertia(matrix, middle - near) == inertia(matrix, middle + near) == found:
                break
        else:
            high = middle
        if high - low < 4 * near:  # a cluster: all of it stays above
            low -= 4 * near
            break
    return low, inertia(matrix, low)


def contours(matrix: np.ndarray, want: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of intervals, from the top, that hold the first `want` eigenvalues and whatever clusters with them."""
    floor, high = float(np.trace(matrix)) * NOTHING, float(np.linalg.norm(matrix)) * 1.01
    want = min(want, inertia(matrix, floor))
    low = floor
    while high - low > 1e-9 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if inertia(matrix, middle) else (low, middle)
    out, seen = [], 0
    while seen < want:
        low, above = cut_above(matrix, floor, high, min(want, seen + PER_CONTOUR))
        low = max(low, floor)
        above = inertia(matrix, low)
        if not out:  # a contour much wider than its eigenvalues would not tell them from their neighbours
            high += max((high - low) / 4, 1e-8 * high)
        out += narrowed(matrix, low, high, above - seen)
        high, seen = low, above
    return out


def narrowed(matrix: np.ndarray, low: float, high: float, inside: int) -> list[tuple[float, float, int]]:
    """The interval, halved as long as more eigenvalues lie near its outside than a block has spare vectors.

    A contour damps what is far from it by its own width. One that a lone large eigenvalue makes wide would not damp the
    bulk below; halves without eigenvalues are dropped, and the rest is as narrow as its surroundings ask for.
    """
    half, near = (high - low) / 2, 1e-9 * high
    outside = inertia(matrix, low - half) - inertia(matrix, low) + inertia(matrix, high) - inertia(matrix, high + half)
    if inside == 0 or outside <= inside + SPARE or half < 1e3 * near:
        return [(low, high, inside)] if inside else []
    for share in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65):
        middle = low + 2 * half * share
        above = inertia(matrix, middle)
        if inertia(matrix, middle - near) == above == inertia(matrix, middle + near):
            above -= inertia(matrix, high)
            return narrowed(matrix, middle, high, above) + narrowed(matrix, low, middle, inside - above)
    return [(low, high, inside)]


def solves(spark: SparkSession, matrix: np.ndarray, bounds: list[tuple[float, float, int]], guesses: list[np.ndarray]) -> list[np.ndarray]:
    """Each interval's guess, filtered: the contour integral of the resolvent applied to it, a shifted complex solve per node and task."""
    points, weights = np.polynomial.legendre.leggauss(NODES)
    shared = spark.sparkContext.broadcast((matrix, bounds, guesses))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, bounds, guesses = shared.value
        for part in parts:
            for i, node in zip(part["i"], part["node"], strict=True):
                low, high, _ = bounds[i]
                angle = np.pi / 2 * (points[node] + 1)
                turn = np.exp(1j * angle)
                z = (low + high) / 2 + (high - low) / 2 * turn
                x = np.linalg.solve(z * np.eye(len(matrix)) - matrix, guesses[i].astype(complex))
                yield pd.DataFrame({"i": [i], "node": [node], "x": [(weights[node] / 2 * (high - low) / 2 * (turn * x).real).ravel()]})

    tasks = spark.createDataFrame([(i, n) for i in range(len(bounds)) for n in range(NODES)], "i int, node int").repartition(len(bounds) * NODES, "i", "node")
    rows = sorted(tasks.mapInPandas(run, "i int, node int, x array<double>").collect(), key=lambda r: (r["i"], r["node"]))
    return [np.sum([r["x"] for r in rows if r["i"] == i], axis=0).reshape(g.shape) for i, g in enumerate(guesses)]


def rayleigh_ritz(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of matrix on the span of basis, values falling; directions that rounding made are left out."""
    u, s, _ = np.linalg.svd(basis, full_matrices=False)
    q = u[:, s > s[0] * 1e-13] if len(s) else u
    values, small = np.linalg.eigh(q.T @ matrix @ q)
    return values[::-1], (q @ small)[:, ::-1]


def leading(spark: SparkSession, matrix: np.ndarray, want: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the first `want` components of a symmetric matrix, fewer where the rest is zero.

    FEAST: per interval, solves at the nodes of a circle around it project a random block on the eigenvectors inside;
    Rayleigh-Ritz extracts them, and rounds go on until each interval has as many small residuals as its inertia says.
    """
    if not len(matrix) or np.trace(matrix) <= 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    bounds = contours(matrix, want)
    rng, norm = np.random.default_rng(7), float(np.linalg.norm(matrix))
    blocks = [rng.standard_normal((len(matrix), min(len(matrix), 2 * m + SPARE))) for _, _, m in bounds]
    polished = False
    for _ in range(ROUNDS):
        found, ready = [], True
        for k, ((low, high, m), block) in enumerate(zip(bounds, solves(spark, matrix, bounds, blocks), strict=True)):
            values, vectors = rayleigh_ritz(matrix, block)
            inside = (values > low) & (values <= high)
            residual = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
            good = inside & (residual < 1e-13 * norm * len(matrix) ** 0.5)
            ready &= int(good.sum()) == m
            found.append(vectors[:, good])
            blocks[k] = vectors
        if ready and not polished:
            polished = True  # one round more takes what is left of the residuals down to rounding
        elif ready:
            values, vectors = rayleigh_ritz(matrix, np.hstack(found))
            return values[:want], vectors[:, :want]
    raise ArithmeticError("the contours did not give as many eigenvectors as the inertia counts")


def deviations(y: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exactly; null where it does not fit a long."""
    most = max(map(abs, total), default=0)
    reach = n * int(np.abs(y).max(initial=0)) + most
    if len(total) * reach**2 < 2**62:
        z = n * y - total.astype(np.int64)
        return (z * z).sum(axis=1).tolist()
    z = n * y.astype(object) - total
    return [int(v) if v < 2**63 else None for v in (z * z).sum(axis=1)]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of vectors(vec_id, embedding).

    Rows whose vector is null, empty, or holds null or non-finite entries (or some that fit no long) are left out, as are rows that
    are not of the commonest length. Covariances and means are those of the distinct vectors, so copies (a hot vector among
    them) count once; Spark combines equal ones before the shuffle. The square of the dimensions is all that the driver holds:
    32 MB at 2,000. Components of no variance are left out, so one distinct vector, or none, gives no rows. Repeated rows are
    whitened alike. Columns other than the two aren't read. Nothing is kept on executors but written tables.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    fit = written(rows.select("y").distinct(), "whitening-fit")
    n, total = sums(fit)
    schema = with_fields(rows.select("vec_id").schema, "component int, n long, deviation long, whitened double, explained double, identity_error double")
    if n == 0:
        return spark.createDataFrame([], schema)
    mean = np.array([t / n for t in total], dtype=np.float64)
    matrix = covariance(fit, mean)
    values, axes = leading(spark, matrix, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    basis, share = axes / np.sqrt(values), values / np.trace(matrix)
    error = float(np.abs(covariance(fit, mean, basis) - np.eye(len(values))).max())
    shared = spark.sparkContext.broadcast((n, total, mean, basis, share, error))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, mean, basis, share, error = shared.value
        k = len(share)
        for batch in batches:
            if not len(batch):
                continue
            y = stacked(batch.column(1))
            white = (y - mean) @ basis
            each = np.repeat(np.arange(len(y)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()),
                    pa.array(np.full(len(each), n), pa.int64()),
                    pa.array(deviations(y, n, total), pa.int64()).take(pa.array(each)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(share, len(y))),
                    pa.array(np.full(len(each), error)),
                ],
                names=schema.names,
            )

    return rows.select("vec_id", "y").mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitens all embeddings on their first sixteen components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
