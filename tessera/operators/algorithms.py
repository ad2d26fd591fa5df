"""Algorithms made of matrix operators, for rows (i, vec) with a label y, or for matrices of cells.

Closed forms need one pass. Iterative ones loop on the driver, which holds what is as narrow as the columns; each turn
is a pass of partial sums over the rows, which stay where they are.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ieee
from tessera.operators import matmul, rowvec
from tessera.plans.matrix import Matrix
from tessera.sources.shared import forget, table

#: Up to so many columns, sums over rows are native expressions, one a column.
NARROW = 32
#: From so many turns on, rows are written down before they are read again and again.
KEEP_FROM = 4
#: Turns of NMF between two writings of W.
NMF_WRITE = 4


def _sigma(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(float)


def kept(x: DataFrame, turns: int) -> DataFrame:
    """The rows written down once, if they are to be read in many turns."""
    return table(x, "rows") if turns >= KEEP_FROM else x


def _narrow_gradient(x: DataFrame, w: np.ndarray) -> dict[str, np.ndarray]:
    """Xᵀ(σ(Xw) - y) and the number of rows, by native expressions: one sum for each column."""
    at = [F.get("vec", F.lit(k)) for k in range(len(w))]
    z = functools.reduce(operator.add, (c * F.lit(float(wk)) for c, wk in zip(at, w, strict=True)))
    off = x.select("vec", (ieee.sigmoid(z) - F.col("y").cast("double")).alias("off"))
    got = off.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c * F.col("off")), F.lit(0.0)).alias(f"g{k}") for k, c in enumerate(at))).first()
    return {"g": np.array([got[f"g{k}"] for k in range(len(w))]), "n": np.array([got["n"]])}


def logistic(x: DataFrame, w: np.ndarray, rate: float = 1e-7, turns: int = 3, average: bool = False) -> np.ndarray:
    """w <- w - rate Xᵀ(σ(Xw) - y), full batch; ``average``: the gradient's mean over the rows, rate halved after each turn.

    Up to ``NARROW`` columns, a turn is one native aggregation; beyond, Arrow batches and BLAS. Many turns read a copy
    of the rows that is written once.
    """
    w, x = np.asarray(w, float), kept(x, turns)
    for _ in range(turns):
        now = w

        def gradient(batch, now=now):
            r = rowvec.rows(batch)
            return {"g": r.T @ (_sigma(r @ now) - _labels(batch)), "n": np.array([batch.num_rows])}

        got = _narrow_gradient(x, w) if 0 < len(w) <= NARROW else rowvec.sums(x, gradient)
        w = w - rate * (got["g"] / got["n"][0] if average else got["g"])
        rate = rate / 2 if average else rate
    return w


def sparse_logistic(x: Matrix, y: Matrix, w: Matrix, rate: float = 1e-7, turns: int = 3) -> Matrix:
    """As ``logistic``, of sparse X, y and w: one expression; rows without cells have σ(0)."""
    for _ in range(turns):
        w = w.densify() - rate * (x.T @ ((x @ w.sparsify()).sigmoid() - y))
    return w


def nmf(x: DataFrame, w: DataFrame, h: np.ndarray, turns: int = 3) -> tuple[DataFrame, np.ndarray]:
    """Multiplicative updates W <- W∘(XHᵀ)/(WHHᵀ), then H <- H∘(WᵀX)/(WᵀWH) with the new W, for X ≈ WH.

    x: rows (i, vec), w: rows (i, vec). They are joined once and written down together. A row of W depends on its row of
    X and the H's so far, so between two writings W is a function of the one written last: a turn is one pass over the
    joined rows, without a shuffle of them, and every ``NMF_WRITE`` turns they are written with the new W.
    """
    both = table(x.join(w.withColumnRenamed("vec", "w"), "i").select("i", "vec", "w"), "nmf")
    past: list[np.ndarray] = []

    def along(r: np.ndarray, v: np.ndarray, hs: list[np.ndarray]) -> np.ndarray:
        for one in hs:
            with np.errstate(divide="ignore", invalid="ignore"):
                v = v * (r @ one.T) / (v @ (one @ one.T))
        return v

    def now(df: DataFrame, hs: list[np.ndarray], with_x: bool) -> DataFrame:
        def last(batches):
            for batch in batches:
                if batch.num_rows:
                    v = pa.array(list(along(rowvec.rows(batch), rowvec.rows(batch, "w"), hs)), pa.list_(pa.float64()))
                    columns = [batch.column(0), batch.column(1), v] if with_x else [batch.column(0), v]
                    yield pa.RecordBatch.from_arrays(columns, ["i", "vec", "w"] if with_x else ["i", "vec"])

        return df.mapInArrow(last, "i long, vec array<double>" + ", w array<double>" * with_x)

    for _ in range(turns):
        if len(past) == NMF_WRITE:
            both, old, past = table(now(both, past, True), "nmf"), both, []
            forget(old)
        past.append(h)
        hs = list(past)

        def products(batch, hs=hs):
            r = rowvec.rows(batch)
            v = along(r, rowvec.rows(batch, "w"), hs)
            return {"wx": v.T @ r, "ww": v.T @ v}

        got = rowvec.sums(both, products)
        with np.errstate(divide="ignore", invalid="ignore"):
            h = h * got["wx"] / (got["ww"] @ h)
    return now(both, past, False), h


def pagerank(graph: Matrix, turns: int = 3, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """i, v: v <- d·M·v + (1-d)/N from v = 1/N, for a column-stochastic M; nodes that nothing points to keep (1-d)/N.

    The edges are written down once. Where the number of nodes bounds the ranks to what may be broadcast, a turn shuffles
    only partial sums. Beyond that, edges stay dealt by the node they come from, so that a turn moves ranks, not edges;
    the ranks of every ``cut_every`` turns go to the shared folder, which cuts the lineage.
    """
    n = graph.meta.rows
    edges, spark = table(graph.cells(), "edges"), graph.cells().sparkSession
    small = n <= matmul.BROADCAST_CELLS
    if not small:
        edges = edges.repartition("j").persist(StorageLevel.DISK_ONLY)
    nodes = spark.range(n).select(F.col("id").alias("i"))
    rank = nodes.withColumn("v", F.lit(1.0 / n))
    for turn in range(1, turns + 1):
        given = rank.select(F.col("i").alias("j"), F.col("v").alias("r"))
        moved = edges.join(F.broadcast(given) if small else given, "j").select("i", (F.col("v") * F.col("r")).alias("m"))
        received = moved.unionAll(nodes.select("i", F.lit(0.0).alias("m"))).groupBy("i").agg(F.sum("m").alias("m"))
        rank = received.select("i", (F.lit(damping) * F.col("m") + F.lit((1 - damping) / n)).alias("v"))
        if turn % cut_every == 0 and turn < turns or turn == turns and not small:
            rank = table(rank, "ranks")
    if not small:
        edges.unpersist()
    return rank


def normal_sums(x: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """XᵀX, Xᵀy, yᵀy, the sum of y and the number of rows."""
    got = rowvec.sums(x, lambda b: {"g": (r := rowvec.rows(b)).T @ r, "b": r.T @ (y := _labels(b)), "yy": np.array([y @ y]), "sy": np.array([y.sum()]), "n": np.array([len(y)])})
    return got["g"], got["b"], float(got["yy"][0]), float(got["sy"][0]), int(got["n"][0])


def least_squares(x: DataFrame, ridge: float = 0.0) -> np.ndarray:
    g, b, *_ = normal_sums(x)
    return np.linalg.solve(g + ridge * np.eye(len(g)), b)


def robust_errors(x: DataFrame, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The least-squares solution and its sandwich covariance (XᵀX)⁻¹ Xᵀ diag(r²) X (XᵀX)⁻¹."""
    g, b, *_ = normal_sums(x)
    w = np.linalg.solve(g, b) if w is None else np.asarray(w, float)

    def meat(batch):
        r = rowvec.rows(batch)
        e = _labels(batch) - r @ w
        return {"m": (r * (e**2)[:, None]).T @ r}

    bread = np.linalg.inv(g)
    return w, bread @ rowvec.sums(x, meat)["m"] @ bread


def conjugate_gradient(x: DataFrame, ridge: float = 0.0, intercept: bool = False, tolerance: float = 1e-10, most: int = 200, scale: bool = False) -> dict:
    """Linear regression by conjugate gradients on the normal equations; a pass Xᵀ(Xp) a turn, XᵀX is never formed.

    ``scale``: columns are shifted to mean 0 and scaled to deviation 1 while it runs (ridge is then on the scaled
    weights), which needs an intercept; constant columns are left as they are. Returns w (of the columns as given, the
    intercept last), turns, rss, rows, and the statistics of ``fit_statistics``.
    """
    if scale and not intercept:
        raise ValueError("shifted columns need an intercept")
    shift = factor = None
    x = kept(x, KEEP_FROM)
    if scale:
        got = rowvec.sums(x, lambda b: {"s": (r := rowvec.rows(b)).sum(0), "n": np.array([len(r)])})
        shift = got["s"] / got["n"][0]
        spread = rowvec.sums(x, lambda b: {"q": ((rowvec.rows(b) - shift) ** 2).sum(0)})["q"] / max(1, got["n"][0] - 1)
        factor = 1 / np.sqrt(np.where(spread > 0, spread, 1))
        shift = np.where(spread > 0, shift, 0)

    def wide(batch) -> np.ndarray:
        r = rowvec.rows(batch)
        r = r if shift is None else (r - shift) * factor
        return np.hstack([r, np.ones((len(r), 1))]) if intercept else r

    got = rowvec.sums(x, lambda b: {"b": wide(b).T @ (y := _labels(b)), "sy": np.array([y.sum()]), "n": np.array([len(y)])})
    shrink = np.full(len(got["b"]), ridge)
    if intercept:
        shrink[-1] = 0
    w, rest = np.zeros(len(got["b"])), got["b"].copy()
    p, square, turns = rest.copy(), float(rest @ rest), 0
    goal = tolerance**2 * square
    while square > goal and turns < most:
        q = rowvec.sums(x, lambda b, p=p: {"q": (r := wide(b)).T @ (r @ p)})["q"] + shrink * p
        step = square / (p @ q)
        w, rest = w + step * p, rest - step * q
        square, before, turns = float(rest @ rest), square, turns + 1
        p = rest + (square / before) * p
    rows, mean = int(got["n"][0]), got["sy"][0] / got["n"][0]

    def errors(batch):
        y = _labels(batch)
        e = y - wide(batch) @ w
        return {"e": np.array([e.sum(), (e**2).sum(), (y**2).sum(), ((y - mean) ** 2).sum()])}

    sums = rowvec.sums(x, errors)["e"]
    if scale:
        own = w[:-1] * factor
        w = np.append(own, w[-1] - own @ shift)
    return {"w": w, "turns": turns, "rss": float(sums[1]), "rows": rows, **fit_statistics(rows, len(w), intercept, mean, *map(float, sums))}


def fit_statistics(n: int, weights: int, intercept: bool, mean: float, e: float, ee: float, yy: float, spread: float) -> dict[str, float]:
    """Of a linear fit with so many weights: mean and deviation of y and of the residuals, dispersion, and R² plain and
    adjusted: against the mean of y (r2), with the residuals' mean taken off (r2_nobias), and against 0 (r2_vs_0).

    e, ee: sums of the residuals and their squares; yy: of y's squares; spread: of its squares around the mean.
    """
    over = lambda a, b: a / b if b > 0 else float("nan")
    columns = weights - intercept
    unbiased = ee - e * e / n
    dispersion = over(ee, n - weights)
    return {
        "mean_y": mean, "deviation_y": math.sqrt(over(spread, n - 1)), "mean_residual": e / n, "deviation_residual": math.sqrt(max(0.0, over(unbiased, n - columns - 1))), "dispersion": dispersion,
        "r2": 1 - over(ee, spread), "adjusted_r2": 1 - over(dispersion, over(spread, n - 1)),
        "r2_nobias": 1 - over(unbiased, spread), "adjusted_r2_nobias": 1 - over(over(unbiased, n - columns - 1), over(spread, n - 1)),
        "r2_vs_0": 1 - over(ee, yy), "adjusted_r2_vs_0": 1 - over(dispersion, over(yy, n)),
    }


def _softmax(r: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, and the logarithm of their denominators."""
    z = r @ w.T
    top = z.max(1, keepdims=True)
    z = np.exp(z - top)
    total = z.sum(1, keepdims=True)
    return z / total, (np.log(total) + top)[:, 0]


def multinomial(x: DataFrame, classes: int, ridge: float = 0.0, rate: float = 1.0, turns: int = 100) -> np.ndarray:
    """Weights (classes x columns) of softmax regression on labels 0, 1, ..., by accelerated full-batch descent on the mean loss."""
    x = kept(x, turns)
    d = len(rowvec.sums(x, lambda b: {"s": rowvec.rows(b).sum(0)})["s"])
    w, ahead, momentum = np.zeros((classes, d)), np.zeros((classes, d)), 1.0
    for _ in range(turns):

        def gradient(batch, now=ahead):
            r, y = rowvec.rows(batch), _labels(batch).astype(int)
            p, _ = _softmax(r, now)
            p[np.arange(len(y)), y] -= 1
            return {"g": p.T @ r, "n": np.array([len(y)])}

        got = rowvec.sums(x, gradient)
        new = ahead - rate * (got["g"] / got["n"][0] + ridge * ahead)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return w


def multinomial_newton(x: DataFrame, classes: int, ridge: float = 0.0, turns: int = 20, inner: int = 30, tolerance: float = 1e-8) -> np.ndarray:
    """As ``multinomial``, by Newton steps inside a trust region. Each step is found by conjugate gradients, which need
    the loss's second derivatives only as products with a direction: a pass over the rows each, no matrix of them."""
    x = kept(x, KEEP_FROM)
    d = len(rowvec.sums(x, lambda b: {"s": rowvec.rows(b).sum(0)})["s"])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        def of(batch):
            r, y = rowvec.rows(batch), _labels(batch).astype(int)
            p, log_total = _softmax(r, w)
            cost = (log_total - (r * w[y]).sum(1)).sum()
            p[np.arange(len(y)), y] -= 1
            return {"f": np.array([cost]), "g": p.T @ r, "n": np.array([len(y)])}

        got = rowvec.sums(x, of)
        return float(got["f"][0] / got["n"][0] + ridge / 2 * (w * w).sum()), got["g"] / got["n"][0] + ridge * w

    def curved(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        def of(batch):
            r = rowvec.rows(batch)
            p, _ = _softmax(r, w)
            t = p * (r @ v.T)
            return {"h": (t - p * t.sum(1, keepdims=True)).T @ r, "n": np.array([len(r)])}

        got = rowvec.sums(x, of)
        return got["h"] / got["n"][0] + ridge * v

    def to_border(s: np.ndarray, v: np.ndarray, radius: float) -> np.ndarray:
        a, b, c = (v * v).sum(), 2 * (s * v).sum(), (s * s).sum() - radius**2
        return s + (-b + math.sqrt(max(0.0, b * b - 4 * a * c))) / (2 * a) * v

    w = np.zeros((classes, d))
    f, g = loss(w)
    radius, start = 1.0 + math.sqrt((g * g).sum()), math.sqrt((g * g).sum())
    for _ in range(turns):
        size = math.sqrt((g * g).sum())
        if size <= tolerance * start:
            break
        s, bent = np.zeros_like(w), np.zeros_like(w)
        rest, v = -g, -g
        for _ in range(inner):
            square = (rest * rest).sum()
            if math.sqrt(square) <= min(0.1, math.sqrt(size)) * size:
                break
            hv = curved(w, v)
            curve = (v * hv).sum()
            step = square / curve if curve > 0 else 0.0
            if curve <= 0 or math.sqrt(((s + step * v) ** 2).sum()) >= radius:
                edge = to_border(s, v, radius)
                bent = bent + hv * (math.sqrt(((edge - s) ** 2).sum()) / math.sqrt((v * v).sum()))
                s = edge
                break
            s, bent, rest = s + step * v, bent + step * hv, rest - step * hv
            v = rest + (rest * rest).sum() / square * v
        hoped = -((g * s).sum() + (s * bent).sum() / 2)
        after, slope = loss(w + s)
        ratio, length = (f - after) / hoped if hoped > 0 else -1.0, math.sqrt((s * s).sum())
        if ratio < 0.25:
            radius = length / 4
        elif ratio > 0.75:
            radius = max(radius, 2 * length)
        if ratio > 1e-4:
            w, f, g = w + s, after, slope
        elif radius < 1e-12:
            break
    return w


def library_linear(x: DataFrame, most: int = 100):
    """Spark's own linear regression."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(maxIter=most).fit(x.select(array_to_vector("vec").alias("features"), F.col("y").cast("double").alias("label")))


def library_models(x: DataFrame, most: int = 3, k: int = 5) -> dict:
    """Spark's own logistic and linear regression and PCA on the same rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    data = x.select(array_to_vector("vec").alias("features"), F.col("y").cast("double").alias("label"))
    return {"logistic": LogisticRegression(maxIter=most).fit(data), "linear": LinearRegression(maxIter=most).fit(data), "pca": PCA(k=k, inputCol="features", outputCol="p").fit(data)}
