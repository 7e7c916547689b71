"""Whitening of embeddings by a compensated covariance and a tridiagonal divide-and-conquer eigen-solve.

Entries become whole numbers x = floor(1024 c) + 100000, whose sums per dimension are exact. Each task centres its rows at the mean, a
pair of doubles (high, low), and adds up their outer products in double-double: a centred row is cut into slices on fixed binary
grids, so narrow that a product of two slices over SLICE_ROWS rows has no rounding at all, in whatever order it is summed; these exact
products are added to (high, low) accumulators by two-sums. Tasks hand on both parts, row by row of the matrix, and merging adds them by
two-sums again, so neither the large offset nor the number of tasks costs digits.

The covariance is reduced to a tridiagonal matrix by reflections, which is split in halves by rank-one tears; the halves' eigen-systems
are joined by the roots of the secular equation, each found beside its nearest pole, with equal poles deflated. Vectors are then
refined against the matrix's high and low parts until they are right to double precision.

What the driver sees is n, the sums and K components of each vector length; lengths are taken MODEL_BYTES of model at a time.

Defined results: rows whose vector is null or holds null or non-finite entries go; so do empty vectors, which have no component;
vectors of each length are a fit list of their own; a length below K has as many components as dimensions; null ids stay, rows that
repeat are rows of their own and count as often; x is kept within +-2^52; `deviation` is null where it does not fit a long, `deviation_wide` then
has it, up to 38 digits; a component whose eigenvalue is not above the matrix's rounding, as when all vectors are equal or there are fewer than dimensions, has no whitened value (null),
and takes no part in identity_error; an empty table gives no row; other columns are ignored.
"""

import decimal
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

K = 8
SCALE, OFFSET, LIMIT = 1024.0, 100_000, float(1 << 52)
#: Rows whose products are summed without rounding: 2 * SLICE_BITS and their logarithm make 53 at most.
SLICE_ROWS, SLICE_BITS, SLICES = 2048, 21, 5
MODEL_BYTES = 64 << 20


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    v = F.col(f"`{vec_col}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.size(v).alias("dim"), v.cast("array<double>").alias("vec"))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(length, x as doubles that are whole numbers, ids) of a few thousand rows of one length at a time."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            whole = batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))
            rows = max(1, min(SLICE_ROWS, (1 << 22) // int(dim)))
            for at in range(0, whole.num_rows, rows):
                part = whole.slice(at, rows)
                entries = part.column("vec").flatten().to_numpy().reshape(part.num_rows, dim)
                with np.errstate(over="ignore"):
                    x = np.floor(entries * SCALE) + OFFSET
                yield int(dim), np.clip(x, -LIMIT, LIMIT), part.column("vec_id")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, i, n, s: exact sums of a task's rows."""
    n: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for dim, x, _ in _by_length(batches):
        high = np.floor(x / 2.0**26)  # both parts of SLICE_ROWS rows have exact sums in doubles
        new = [(int(a) << 26) + int(b) for a, b in zip(high.sum(axis=0), (x - high * 2.0**26).sum(axis=0), strict=True)]
        sums[dim] = [a + b for a, b in zip(sums[dim], new, strict=True)] if dim in sums else new
        n[dim] = n.get(dim, 0) + len(x)
    for dim, s in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n[dim]] * dim, pa.int64()), pa.array([decimal.Decimal(v) for v in s], pa.decimal128(38, 0))], names=["dim", "i", "n", "s"]
        )


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    (a_up, a_down), (b_up, b_down) = (_halves(x) for x in (a, b))
    p = a * b
    return p, ((a_up * b_up - p) + a_up * b_down + a_down * b_up) + a_down * b_down


def _halves(x):
    cut = x * 134217729.0  # 2^27 + 1
    up = cut - (cut - x)
    return up, x - up


def added(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two (high, low) pairs."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def mean_of(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """sums / n as (high, low)."""
    high = np.array([s / n for s in sums])  # of whole numbers, so rounded once
    low = []
    for s, h in zip(sums, high, strict=True):
        a, b = float(h).as_integer_ratio()
        low.append((s * b - n * a) / (n * b))
    return high, np.array(low)


def centred(x: np.ndarray, mean: tuple) -> tuple[np.ndarray, np.ndarray]:
    """x less the mean as (high, low)."""
    high, low = two_sum(x, -mean[0])
    return two_sum(high, low - mean[1])


def slices(high: np.ndarray, low: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A column's values as whole numbers of at most SLICE_BITS bits on ever finer grids, and the exponent of each column's first grid."""
    top = np.abs(high).max(axis=0, initial=0)
    exponent = np.where(top > 0, np.frexp(top)[1] + 1 - SLICE_BITS, 0)
    high, low, out = np.ldexp(high, -exponent), np.ldexp(low, -exponent), []
    for _ in range(SLICES):
        whole = np.rint(high)
        out.append(whole)
        high, low = two_sum(high - whole, low)
        high, low = np.ldexp(high, SLICE_BITS), np.ldexp(low, SLICE_BITS)
    return out, exponent


def crossed(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """a' b as (high, low), of matrices given as (high, low): the sum of the outer products of their rows."""
    out = (np.zeros((a[0].shape[1], b[0].shape[1])),) * 2
    for at in range(0, len(a[0]), SLICE_ROWS):
        here = slice(at, at + SLICE_ROWS)
        mine, e = slices(a[0][here], a[1][here])
        theirs, f = (mine, e) if a is b else slices(b[0][here], b[1][here])
        total = (np.zeros_like(out[0]),) * 2
        for depth in reversed(range(SLICES)):  # the least first
            for i in range(depth // 2 + 1 if a is b else depth + 1):
                exact = np.ldexp(mine[i].T @ theirs[depth - i], -SLICE_BITS * depth)
                total = added(total, (exact, np.zeros_like(exact)))
                if a is b and i != depth - i:
                    total = added(total, (exact.T, np.zeros_like(exact)))
        scale = e[:, None] + f[None, :]
        out = added(out, (np.ldexp(total[0], scale), np.ldexp(total[1], scale)))
    return out


PART = "dim int, i int, part int, high binary, low binary"


def _multiplied(batches: Iterator[pa.RecordBatch], means: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    """A task's (high, low) sums of outer products, a row of the matrix at a time."""
    from pyspark import TaskContext

    total: dict[int, tuple] = {}
    for dim, x, _ in _by_length(batches):
        rows = centred(x, means[dim])
        new = crossed(rows, rows)
        total[dim] = added(total[dim], new) if dim in total else new
    part = TaskContext.get().partitionId()
    for dim, (high, low) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([part] * dim, pa.int32()), pa.array([r.tobytes() for r in high], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary())],
            names=["dim", "i", "part", "high", "low"],
        )


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    total = None
    for high, low in zip(rows["high"], rows["low"], strict=True):
        new = (np.frombuffer(high), np.frombuffer(low))
        total = new if total is None else added(total, new)
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "i": rows["i"].iloc[:1], "part": rows["part"].iloc[:1], "high": [total[0].tobytes()], "low": [total[1].tobytes()]})


# --- the eigen-solve -----------------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q t q', by reflections."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        top = np.abs(v[1:]).max(initial=0)
        if top == 0:
            continue
        v /= max(top, abs(v[0]))
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho sum z^2 / (d - x), d rising and apart, rho > 0: (nearest pole's place, root less that pole).

    All roots are bracketed at once, on a scale of ratios, as a root may be very much nearer to its pole than to the next.
    """
    n, z2 = len(d), rho * z * z
    gaps = np.append(np.diff(d), z2.sum() * (1 + 1e-15))
    apart = d[None, :] - d[:, None]
    # A root lies between its pole and the next; the sign half way tells which is nearer, but the last one has no next.
    nearer = (1 + (z2 / (apart - gaps[:, None] / 2)).sum(axis=1) >= 0) | (np.arange(n) == n - 1)
    at = np.arange(n) + ~nearer
    apart, side = d[None, :] - d[at][:, None], np.where(nearer, 1.0, -1.0)
    high = np.where(np.arange(n) == n - 1, gaps, gaps / 2)
    low = high * 1e-45
    for _ in range(80):
        x = np.sqrt(low) * np.sqrt(high)
        beyond = (1 + (z2 / (apart - (side * x)[:, None])).sum(axis=1)) * side > 0
        low, high = np.where(beyond, low, x), np.where(beyond, x, high)
    return at, side * np.sqrt(low) * np.sqrt(high)


def _joined(d: np.ndarray, q: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigen-system of q (diag(d) + rho z z') q'."""
    if rho < 0:
        values, vectors = _joined(-d, q, z, -rho)
        return -values[::-1], vectors[:, ::-1]
    order = np.argsort(d, kind="stable")
    d, q, z = d[order], q[:, order].copy(), z[order].copy()
    size = np.linalg.norm(z)
    if rho == 0 or size == 0:
        return d, q
    z, rho = z / size, rho * size * size
    tiny = 8 * np.finfo(float).eps * max(np.abs(d).max(), rho)
    kept: list[int] = []
    d = d.copy()
    for i in range(len(d)):
        if rho * abs(z[i]) <= tiny:
            z[i] = 0  # an eigen-pair as it is
        elif kept and (d[i] - d[kept[-1]]) * abs(z[i] * z[kept[-1]]) <= tiny * (z[i] ** 2 + z[kept[-1]] ** 2):
            # Poles that are as good as equal: a rotation leaves the former one out.
            j, r = kept[-1], np.hypot(z[i], z[kept[-1]])
            c, s = z[i] / r, z[j] / r
            q[:, i], q[:, j] = c * q[:, i] + s * q[:, j], c * q[:, j] - s * q[:, i]
            d[i], d[j] = c * c * d[i] + s * s * d[j], s * s * d[i] + c * c * d[j]
            z[i], z[j] = r, 0
            kept[-1] = i
        else:
            kept.append(i)
    values, vectors = d.copy(), q
    if kept:
        poles = d[kept]
        at, off = _secular(poles, z[kept], rho)
        # root[k] - pole[j] without cancellation, and the z that has exactly these roots.
        apart = off[None, :] + (poles[at][None, :] - poles[:, None])
        n = len(kept)
        ratio = np.ones(n)
        for j in range(n):
            k = np.arange(n) != j
            ratio[j] = apart[j, j] * np.prod(apart[j, k] / (poles[k] - poles[j]))
        near = np.sqrt(np.abs(ratio)) * np.sign(z[kept])
        inner = near[:, None] / apart
        inner /= np.linalg.norm(inner, axis=0)
        values[kept] = poles[at] + off
        vectors = q.copy()
        vectors[:, kept] = q[:, kept] @ inner
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def divide_and_conquer(diagonal: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and the vectors of a symmetric tridiagonal matrix."""
    n = len(diagonal)
    if n == 1:
        return diagonal.copy(), np.ones((1, 1))
    m = n // 2
    rho = beside[m - 1]
    upper, lower = diagonal[:m].copy(), diagonal[m:].copy()
    upper[-1] -= rho
    lower[0] -= rho
    (d1, q1), (d2, q2) = divide_and_conquer(upper, beside[: m - 1]), divide_and_conquer(lower, beside[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    return _joined(np.append(d1, d2), q, np.append(q1[-1], q2[0]), float(rho))


def eigen(high: np.ndarray, low: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit vectors (columns) of a symmetric matrix (high, low)."""
    size = float(np.abs(high).max())
    if size == 0:
        return np.zeros(len(high)), np.eye(len(high))
    power = int(np.frexp(size)[1])
    high, low = np.ldexp(high, -power), np.ldexp(low, -power)
    diagonal, beside, q = tridiagonal(high)
    values, inner = divide_and_conquer(diagonal, beside)
    x = q @ inner
    zero = np.zeros_like(x)
    for _ in range(rounds):
        # First-order correction of all pairs at once, by what is wrong beyond double precision: r = I - x'x, s = x'Ax.
        own = crossed((x, zero), (x, zero))
        r = (np.eye(len(x)) - own[0]) - own[1]
        s = crossed((x, zero), crossed((high, low), (x, zero)))[0]
        values = np.diag(s) / (1 - np.diag(r))
        off = values[None, :] - values[:, None]
        # Pairs nearer than what is wrong, or than the matrix's rounding, are made orthogonal only.
        wrong = np.linalg.norm(s - np.diag(np.diag(s))) + np.linalg.norm(s) * np.linalg.norm(r)
        close = np.abs(off) <= max(2 * wrong, len(x) * np.finfo(float).eps * np.linalg.norm(s))
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.where(close, r / 2, (s + values[None, :] * r) / off)
        x = x + x @ e
        if np.abs(e).max() < 1e-15:
            break
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.linalg.norm(x[:, order], axis=0)
    return np.ldexp(values[order], power), x


def _solved(rows: pd.DataFrame, n: dict[int, int], k: int) -> pd.DataFrame:
    rows = rows.sort_values("i")
    dim = int(rows["dim"].iloc[0])
    high, low = (np.stack([np.frombuffer(b) for b in rows[c]]) for c in ("high", "low"))
    count = n[dim]
    quotient = high / count
    product = two_product(quotient, float(count))
    v = two_sum(quotient, ((high - product[0]) - product[1] + low) / count)
    values, vectors = eigen(*v)
    k = min(k, dim)
    fine = values[:k] > dim * np.finfo(float).eps * max(values[0], 0)
    trace = float(np.trace(v[0]))
    return pd.DataFrame({"dim": [dim], "values": [values[:k].tolist()], "vectors": [vectors[:, :k].T.ravel().tolist()], "fine": [fine.tolist()], "explained": [[e / trace if trace > 0 else None for e in values[:k].tolist()]]})


WHITE = "vec_id long, dim int, deviation decimal(38,0), white array<double>"


def _whitened(batches: Iterator[pa.RecordBatch], models: dict[int, dict]) -> Iterator[pa.RecordBatch]:
    for dim, x, ids in _by_length(batches):
        m = models[dim]
        high, low = centred(x, m["mean"])
        with np.errstate(divide="ignore", invalid="ignore"):
            white = (high @ m["vectors"].T + low @ m["vectors"].T) / np.sqrt(m["values"])
        white[:, ~m["fine"]] = np.nan
        yield pa.RecordBatch.from_arrays([ids, pa.array([dim] * len(x), pa.int32()), pa.array(_deviations(x, m["n"], m["sums"]), pa.decimal128(38, 0)), pa.array(list(white), pa.list_(pa.float64()))], names=["vec_id", "dim", "deviation", "white"])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[decimal.Decimal | None]:
    """sum over dimensions of (n x - S)^2, in whole numbers; null beyond 38 digits."""
    x = x.astype(np.int64)
    if int(np.abs(x).max(initial=0)) * n + max(map(abs, sums)) < 1 << 50 and len(sums) <= 1 << 12:
        off = x * n - np.array(sums, np.int64)
        up, down = off >> 25, off & ((1 << 25) - 1)  # whose products have sums below 2^63
        parts = zip((up * up).sum(axis=1).tolist(), (up * down).sum(axis=1).tolist(), (down * down).sum(axis=1).tolist(), strict=True)
        found = [(a << 50) + (b << 26) + c for a, b, c in parts]
    else:
        found = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [decimal.Decimal(v) if v < 10**38 else None for v in found]


def _model_chunks(dims: list[int], k: int) -> list[list[int]]:
    """Lengths, in groups whose models take MODEL_BYTES at most, or alone."""
    out, held = [], 0
    for dim in dims:
        size = 8 * dim * (k + 8)
        if not out or held + size > MODEL_BYTES:
            out.append([])
            held = 0
        out[-1].append(dim)
        held += size
    return out


def _fitted(rows: DataFrame, sums: DataFrame, dims: list[int], k: int) -> dict[int, dict]:
    """The models of some lengths."""
    told: dict[int, dict] = {d: {"n": 0, "sums": [0] * d} for d in dims}
    for r in sums.filter(F.col("dim").isin(dims)).collect():
        told[r["dim"]]["n"] = r["n"]
        told[r["dim"]]["sums"][r["i"]] = int(r["s"])
    means = {d: mean_of(m["n"], m["sums"]) for d, m in told.items()}
    parts = staged(rows.mapInArrow(lambda it: _multiplied(it, means), PART), "whitening-products")
    # A row of the matrix has one part a task; they are merged in two steps, the first of them over the root of their number.
    group = max(1, int(((parts.agg(F.max("part")).first()[0] or 0) + 1) ** 0.5))
    near = parts.withColumn("part", (F.col("part") / group).cast("int")).groupBy("dim", "i", "part").applyInPandas(_merged, PART)
    matrix = near.groupBy("dim", "i").applyInPandas(_merged, PART)
    n = {d: m["n"] for d, m in told.items()}
    solved = matrix.groupBy("dim").applyInPandas(lambda rows: _solved(rows, n, k), "dim int, values array<double>, vectors array<double>, fine array<boolean>, explained array<double>")
    for r in solved.collect():
        told[r["dim"]] |= {"mean": means[r["dim"]], "values": np.array(r["values"]), "vectors": np.array(r["vectors"]).reshape(-1, r["dim"]), "fine": np.array(r["fine"]), "explained": r["explained"]}
    return told


def whiten(vectors: DataFrame, k: int = K) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide of each usable row and component up to k."""
    spark = vectors.sparkSession
    with small_batches(spark, SLICE_ROWS):
        every = usable(vectors)
        sums = every.mapInArrow(_summed, "dim int, i int, n long, s decimal(38,0)").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
        sums = staged(sums, "whitening-sums")
        chunks = _model_chunks(sorted(r[0] for r in sums.select("dim").distinct().collect()), k)
        done = []
        for chunk in chunks:
            rows = every if len(chunks) == 1 else every.filter(F.col("dim").isin(chunk))
            models = _fitted(rows, sums, chunk, k)
            white = staged(rows.mapInArrow(lambda it, models=models: _whitened(it, models), WHITE), "whitened")
            facts = [(d, c + 1, m["n"], m["explained"][c]) for d, m in models.items() for c in range(len(m["values"]))]
            done.append(_reported(white, facts, k))
    if not done:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)")
    return reduce(DataFrame.union, done)


def _reported(white: DataFrame, facts: list[tuple], k: int) -> DataFrame:
    """Whitened rows a component at a time, beside how far their covariance is from the identity."""
    spark = white.sparkSession
    w = [F.nanvl(F.try_element_at("white", F.lit(c + 1)), F.lit(None).cast("double")) for c in range(k)]
    means = white.groupBy("dim").agg(*[F.avg(w[c]).alias(f"m{c}") for c in range(k)])
    centred_rows = white.join(F.broadcast(means), "dim").select("dim", *[(w[c] - F.col(f"m{c}")).alias(f"c{c}") for c in range(k)])
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    covariance = centred_rows.groupBy("dim").agg(*[F.abs(F.avg(F.col(f"c{a}") * F.col(f"c{b}")) - (1.0 if a == b else 0.0)).alias(f"v{a}_{b}") for a, b in pairs])
    error = F.array_max(F.array(*[F.col(f"v{a}_{b}") for a, b in pairs]))
    told = spark.createDataFrame(facts, "dim int, component int, n long, explained double").join(covariance.select("dim", error.alias("identity_error")), "dim")
    # The facts have k rows for each length of a chunk, which MODEL_BYTES bounds.
    long_rows = white.select("vec_id", "dim", "deviation", F.posexplode("white").alias("pos", "value")).withColumn("component", F.col("pos") + 1)
    joined = long_rows.join(F.broadcast(told), ["dim", "component"])
    fits = F.when(F.col("deviation") <= F.lit((1 << 63) - 1), F.col("deviation").cast("long"))
    nan_free = F.when(~F.isnan("value"), F.col("value"))
    return joined.select("vec_id", "component", "n", fits.alias("deviation"), nan_free.alias("whitened"), "explained", "identity_error", F.col("deviation").alias("deviation_wide"))
