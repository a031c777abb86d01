"""Whitening of embeddings by their leading principal components (operator 13).

The components are eigenvectors of the covariance, found by Jacobi-Davidson: the
covariance is never formed, only multiplied, each product a pass over the rows in
which tasks add up their own share. The correction equations of all wanted pairs
are solved side by side, so that a step of MINRES costs one pass for all of them.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from textloom.llm.common import fresh, stored

#: Components wanted, steps of MINRES for a correction, most passes of the outer loop.
COMPONENTS, INNER, OUTER = 8, 6, 60
#: Residuals, over the largest eigenvalue, at which a pair is done.
EXACT = 4e-15
#: Residuals that rounding may leave where no correction helps any more.
ROUNDING = 1e-12
#: Scale and shift that turn an entry into a whole number, and the largest entry they are made for.
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 40)


def scaled(vector: str | Column) -> Column:
    """floor(1024 c) + 100000 of each entry, as longs; null for vectors that are left out."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) > LARGEST))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT))
    return F.when(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)), whole)


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Fit:
    """Rows of whole-number vectors with their count and exact sums per dimension."""

    rows: DataFrame
    n: int
    sums: np.ndarray

    @property
    def d(self) -> int:
        return len(self.sums)

    def added(self, share: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all rows of ``share``, a matrix of centred rows -> a matrix of any fixed shape.

        Tasks add up their own rows; the sums meet by matrix row, not in the driver.
        """
        n, sums, d = self.n, self.sums, self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    own = share((n * _rows(batch, d) - sums) / n)
                    total = own if total is None else total + own
            if total is not None:
                lines = pa.array(list(total), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), lines], ["i", "v"])

        parts = self.rows.select("x").mapInArrow(run, "i long, v array<double>")
        width = share(np.zeros((0, d))).shape[1]
        sums_ = [F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(width)]
        found = {r["i"]: r[1:] for r in parts.groupBy("i").agg(*sums_).collect()}
        return np.array([found[i] for i in range(len(found))], np.float64)

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``block``, in one pass over the rows."""
        return self.added(lambda c: c.T @ (c @ block)) / self.n


def fit(vectors: DataFrame, column: str = "embedding") -> Fit:
    """Whole-number vectors of ``vectors``, written once, with every other column kept.

    Vectors that are null, empty or hold null, non-finite or absurd entries (over
    2^40) are left out, and so are vectors of another length than most have (of
    equally many the longer).
    """
    x = fresh(vectors, "x")
    kept = stored(vectors.withColumn(x, scaled(column)).filter(F.col(x).isNotNull()), "vectors")
    lengths = kept.groupBy(F.size(x).alias("d")).agg(F.count("*").alias("n"))
    most = lengths.agg(F.max(F.struct("n", "d")).alias("most")).first()["most"]
    n, d = most or (0, 0)
    kept = kept.filter(F.size(x) == d)
    rows = kept.select(F.col(x).alias("x"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(vectors.columns)))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, np.int64)
        for batch in batches:
            total += _rows(batch, d).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(total)], ["i", "s"])

    if not n:
        return Fit(rows, 0, np.zeros(0, np.int64))
    sums = rows.select("x").mapInArrow(share, "i long, s long").groupBy("i").agg(F.sum("s").alias("s"))
    found = dict(map(tuple, sums.collect()))
    return Fit(rows, n, np.array([found[i] for i in range(d)], np.int64))


def _apart(block: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``block`` adds to the columns of ``others``."""
    out: list[np.ndarray] = []
    base = [o for o in others if o.shape[1]]
    for t in block.T:
        size = np.linalg.norm(t)
        if not size:
            continue
        t = t / size
        for _ in range(3):
            for o in base:
                t = t - o @ (o.T @ t)
            for o in out:
                t = t - o * (o @ t)
            left = np.linalg.norm(t)
            if left < 1e-10:
                break
            t = t / left
        else:
            out.append(t)
    return np.array(out).T if out else np.zeros((block.shape[0], 0))


def minres(times: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Solves ``times(t) = right`` for all columns side by side, ``times`` symmetric for each of them.

    A column that is solved exactly stays as it is while others go on.
    """
    tiny = np.finfo(float).tiny
    x = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    phi = beta.copy()
    old, new = np.zeros_like(right), right / np.maximum(beta, tiny)
    live = beta > 0
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    cos, sin = -np.ones(right.shape[1]), np.zeros(right.shape[1])
    delta_bar, eps = np.zeros(right.shape[1]), np.zeros(right.shape[1])
    beta_now = np.zeros(right.shape[1])
    for _ in range(steps):
        if not live.any():
            break
        next_ = times(new) - beta_now * old
        alpha = (new * next_).sum(axis=0)
        next_ = next_ - alpha * new
        beta_next = np.linalg.norm(next_, axis=0)
        # The rotations of earlier steps, then a new one that takes beta_next out.
        delta = cos * delta_bar + sin * alpha
        gamma_bar = sin * delta_bar - cos * alpha
        eps_now, eps = eps, sin * beta_next
        delta_bar = -cos * beta_next
        gamma = np.hypot(gamma_bar, beta_next)
        live &= gamma > 1e-14 * np.maximum(1, np.abs(alpha))
        safe = np.where(gamma > 0, gamma, 1)
        cos, sin = gamma_bar / safe, beta_next / safe
        w_old, w = w, (new - delta * w - eps_now * w_old) / safe
        x = np.where(live, x + cos * phi * w, x)
        phi = sin * phi
        old, new = new, next_ / np.maximum(beta_next, tiny)
        beta_now = beta_next
        live &= (beta_next > 1e-14 * np.maximum(1, np.abs(alpha))) & (np.abs(phi) > 1e-15 * beta)
    return x


def eigenpairs(
    times: Callable[[np.ndarray], np.ndarray], d: int, k: int = COMPONENTS, inner: int = INNER
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric positive matrix of ``d`` rows, and their unit vectors.

    ``times`` multiplies the matrix with a block of columns. A pair is locked once
    its residual is down to rounding: EXACT of the largest eigenvalue, or, where
    corrections no longer lower it, at most ROUNDING.
    """
    k = min(k, d)
    draw = np.random.default_rng(13)
    done, values = np.zeros((d, 0)), []
    basis = _apart(draw.standard_normal((d, min(d, k + 2))))
    image = times(basis)
    least = np.full(k, np.inf)  # smallest residual seen at each place
    stuck = np.zeros(k, int)
    for _ in range(OUTER):
        theta, s = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        order = np.argsort(-theta)
        theta, s = theta[order], s[:, order]
        ritz, ritz_image = basis @ s, image @ s
        # The places not locked yet, from the largest on.
        want = min(k - done.shape[1], len(theta))
        residual = ritz_image[:, :want] - ritz[:, :want] * theta[:want]
        residual -= done @ (done.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        top = max([*values, theta[0], 0.0])
        if top <= 0:
            return np.zeros(k), np.eye(d)[:, :k]
        place = np.arange(done.shape[1], done.shape[1] + want)
        stuck[place] = np.where(size < 0.5 * least[place], 0, stuck[place] + 1)
        least[place] = np.minimum(least[place], size)
        whole = done.shape[1] + basis.shape[1] >= d
        ready = (size <= EXACT * top) | ((size <= ROUNDING * top) & ((stuck[place] > 2) | whole))
        first = want if ready.all() else int(np.argmin(ready))
        if first:
            done = np.hstack([done, _apart(ritz[:, :first], done)])
            values += theta[:first].tolist()
            ritz, ritz_image, theta = ritz[:, first:], ritz_image[:, first:], theta[first:]
            residual, size = residual[:, first:], size[first:]
            want -= first
        if not want:
            break
        # A full basis shrinks to its best vectors, which keep their images.
        most = max(4 * k, want + 2)
        keep = min(ritz.shape[1], want + 4) if ritz.shape[1] + want > most else ritz.shape[1]
        basis, image = ritz[:, :keep], ritz_image[:, :keep]
        shifts, own = theta[:want], ritz[:, :want]

        def projected(t: np.ndarray) -> np.ndarray:
            """(I - zz') (A - shift) (I - zz') of each column, z its own Ritz vector and the locked ones."""

            def clear(y: np.ndarray) -> np.ndarray:
                y = y - done @ (done.T @ y)
                return y - own * (own * y).sum(axis=0)

            t = clear(t)
            return clear(times(t) - shifts * t)

        new = _apart(minres(projected, -residual, inner), done, basis)
        if not new.shape[1]:
            new = _apart(residual, done, basis)
        if not new.shape[1]:
            new = _apart(draw.standard_normal((d, want)), done, basis)
        if not new.shape[1]:
            # The basis and the locked vectors span everything: only its images can be made anew.
            image = times(basis)
            continue
        basis, image = np.hstack([basis, new]), np.hstack([image, times(new)])
    if done.shape[1] < k:
        raise ArithmeticError(f"only {done.shape[1]} of {k} eigenpairs reached double precision")
    # Rayleigh-Ritz once more over all locked vectors, with images of their own.
    again = times(done)
    theta, s = np.linalg.eigh((done.T @ again + again.T @ done) / 2)
    order = np.argsort(-theta)
    vectors = done @ s[:, order]
    return np.maximum(theta[order], 0.0), vectors / np.linalg.norm(vectors, axis=0)


def whitened(vectors: DataFrame, column: str = "embedding", k: int = COMPONENTS) -> tuple[DataFrame, str]:
    """A row for each vector that ``fit`` keeps and each of its first ``k`` components.

    Columns: those of ``vectors``, and a struct (its name is returned too) of
    component (from 1, by falling eigenvalue), n, deviation (sum of (n x - S)^2,
    exact; null where a long can't hold it), whitened, explained, identity_error.
    Components without any variance, as with a single vector, have a null whitened,
    and count neither for identity_error nor, where all are so, have an explained.
    Repeated rows are each kept and counted. An empty table gives no rows; vectors
    of fewer than ``k`` dimensions have that many components.
    """
    own = fit(vectors, column)
    name = fresh(vectors, "white")
    inside = StructType(
        [
            StructField("component", IntegerType()),
            StructField("n", LongType()),
            StructField("deviation", LongType()),
            StructField("whitened", DoubleType()),
            StructField("explained", DoubleType()),
            StructField("identity_error", DoubleType()),
        ]
    )
    schema = StructType([*vectors.schema.fields, StructField(name, inside)])
    if not own.n:
        return vectors.sparkSession.createDataFrame([], schema), name
    n, d, sums = own.n, own.d, own.sums
    k = min(k, d)
    trace = float(own.added(lambda c: np.array([[(c * c).sum()]]))[0, 0]) / n
    e, v = eigenpairs(own.times, d, k)
    good = e > 1e-14 * max(trace, 0.0)
    scale = np.where(good, 1 / np.sqrt(np.where(good, e, 1.0)), 0.0)
    project = v * scale

    def moments(c: np.ndarray) -> np.ndarray:
        y = c @ project
        return np.vstack([y.sum(axis=0), y.T @ y])

    sums_of = own.added(moments) / n
    covariance = sums_of[1:] - np.outer(sums_of[0], sums_of[0])
    wrong = np.abs(covariance - np.eye(k))[np.ix_(good, good)]
    error = float(wrong.max()) if good.any() else None
    explained = (e / trace).tolist() if trace > 0 else [None] * k
    kinds = pa.struct(
        [
            ("component", pa.int32()),
            ("n", pa.int64()),
            ("deviation", pa.int64()),
            ("whitened", pa.float64()),
            ("explained", pa.float64()),
            ("identity_error", pa.float64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            far = n * _rows(batch, d) - sums
            largest = int(np.abs(far).max())
            if largest * largest * d < 1 << 63:
                deviation = pa.array((far * far).sum(axis=1))
            else:
                exact = [sum(f * f for f in line) for line in far.tolist()]
                deviation = pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())
            y = ((far / n) @ project).ravel()
            at = np.repeat(np.arange(m), k)
            which = np.tile(np.arange(k), m)
            parts = [
                pa.array(which + 1, pa.int32()),
                pa.array(np.full(m * k, n)),
                deviation.take(pa.array(at)),
                pa.array(y, mask=~good[which]),
                pa.array([explained[j] for j in range(k)], pa.float64()).take(pa.array(which)),
                pa.array([error] * (m * k), pa.float64()),
            ]
            white = pa.StructArray.from_arrays(parts, fields=list(kinds))
            rest = [batch.column(f"c{j}").take(pa.array(at)) for j in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, white], [f"c{j}" for j in range(len(rest))] + ["white"])

    plain = StructType(
        [StructField(f"c{j}", f.dataType) for j, f in enumerate(vectors.schema.fields)] + [StructField("white", inside)]
    )
    out = own.rows.mapInArrow(run, plain)
    return out.toDF(*vectors.columns, name), name
