"""Every operator against NumPy, in dense and sparse form, with the awkward values and shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import features
from tessera.operators import algorithms, decompose, layout, rowvec, tiles
from tessera.plans import rules
from tessera.plans.matrix import AGGREGATES, Matrix
from tessera.plans.meta import DENSE, INT, SPARSE, Meta, result_format, result_type
from tessera.sources import files, tables

NAN, INF = float("nan"), float("inf")


def make(spark, a, fmt=DENSE, dtype="double", tile=(4, 3)):
    a = np.asarray(a, float)
    rows = [(int(i), int(j), float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if fmt == DENSE or a[i, j] != 0]
    return Matrix.from_cells(spark.createDataFrame(rows, "i long, j long, v double"), *a.shape, fmt, dtype, tile)


def same(matrix, expected, **close):
    np.testing.assert_allclose(matrix.to_numpy(), expected, **close)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    a = rng.integers(-3, 4, (7, 5)).astype(float)
    b = rng.integers(-3, 4, (7, 5)) * (rng.random((7, 5)) < 0.4) + 0.0
    b[6] = 0  # a row of zeros at the end
    c = rng.integers(-2, 3, (5, 6)).astype(float)
    return a, b, c


@pytest.fixture(scope="module")
def made(spark, data):
    a, b, c = data
    return make(spark, a), make(spark, b, SPARSE), make(spark, c)


def square():
    """A square matrix of several tiles with rows, columns and blocks that are mostly empty."""
    rng = np.random.default_rng(8)
    return np.where(rng.random((8, 8)) < 0.45, rng.integers(1, 400, (8, 8)), 0).astype(float)


def test_types_and_formats():
    assert [result_type(a, b) for a, b in (("int", "int"), ("int", "float"), ("float", "float"), ("int", "double"))] == ["int", "double", "float", "double"]
    assert result_format(SPARSE, SPARSE) == SPARSE and result_format(DENSE, SPARSE) == DENSE
    for wrong in ({"rows": -1, "cols": 1}, {"rows": 1, "cols": 1, "fmt": "x"}, {"rows": 1, "cols": 1, "tile": (0, 1)}):
        with pytest.raises(ValueError):
            Meta(**wrong)


def test_element_wise(data, made):
    (a, b, _), (x, y, _) = data, made
    for got, want in ((x + y, a + b), (x - y, a - b), (y - x, b - a), (x * y, a * b), (y * x, b * a), (x + x, 2 * a), (y + y, 2 * b), (y - y, 0 * b), (y * y, b * b)):
        same(got, want)
    assert (y - y).cells().count() == 0 and (y + y).meta.fmt == SPARSE and (x + y).meta.fmt == DENSE
    with np.errstate(all="ignore"):
        same(x / y, a / b)
        same(x / x, a / a)
        same(y / x, b / a)
        same(y / y, np.where(b == 0, 0, 1))
        same(2.0 / y, 2 / b)


def test_sparse_division_keeps_signs(spark):
    x, y = make(spark, [[-2, 3, 0, 4]], SPARSE), make(spark, [[0, 0, 5, 2]], SPARSE)
    assert (x / y).to_numpy().tolist() == [[-INF, INF, 0, 2]]


def test_constants(data, made):
    (a, b, _), (x, y, _) = data, made
    for got, want in ((x + 2.0, a + 2), (2.0 - x, 2 - a), (x - 2.0, a - 2), (3.0 * x, 3 * a), (x / 2.0, a / 2), (y * 3.0, 3 * b), (y + 1.0, b + 1), (1.0 - y, 1 - b), (y / 4.0, b / 4)):
        same(got, want)
    assert (y * 3.0).meta.fmt == SPARSE and (y + 1.0).meta.fmt == DENSE and (y * 0.0).cells().count() == 0


def test_functions(data, made):
    (a, b, _), (x, y, _) = data, made
    same(x.exp(), np.exp(a))
    same(y.exp(), np.exp(b))
    same(y.sigmoid(), 1 / (1 + np.exp(-b)))
    same(y.map_stored(F.abs), abs(b))
    assert y.map_stored(F.abs).meta.fmt == SPARSE


def test_integers(spark):
    x, y = make(spark, [[7, -7, 9]], dtype=INT), make(spark, [[2, 2, 3]], dtype=INT)
    assert (x / y).to_numpy().tolist() == [[3, -3, 3]] and (x / y).meta.dtype == INT
    assert dict((x + y).cells().dtypes)["v"] == "bigint"
    assert (x + 0.5).to_numpy().tolist() == [[7.5, -6.5, 9.5]]


def test_awkward_values(spark):
    a = np.array([[NAN, INF, -INF, -0.0, 1.0]])
    x = make(spark, a)
    same(x + x, a + a)
    with np.errstate(all="ignore"):
        same(x / make(spark, [[0, 0, 0, 0, 0]]), a / np.zeros((1, 5)))
    got = x.aggregates(("max", "min")).first()
    assert (got["max"], got["min"]) == (INF, -INF)
    assert make(spark, [[NAN, 2, 1]]).aggregates(("max", "min")).first()[:] == (2.0, 1.0)
    one = make(spark, [[5]]).aggregates(("var", "stdev")).first()
    assert np.isnan(one["var"]) and np.isnan(one["stdev"])


def test_layout(spark, data, made):
    (a, b, _), (x, y, _) = data, made
    same(x.T, a.T)
    same(y.T.T, b)
    same(x.subarray((1, 3), (2, 99)), a[1:4, 2:])
    same(y.subarray((5, 6), (0, 1)), b[5:7, :2])
    assert x.subarray((9, 12), (0, 1)).meta.shape == (0, 2) and x.subarray((9, 12), (0, 1)).cells().count() == 0
    same(y.densify(), b)
    assert y.densify().cells().count() == b.size and x.sparsify().cells().count() == (a != 0).sum()
    same(x.cbind(y), np.hstack([a, b]))
    same(y.rbind(y), np.vstack([b, b]))
    same(make(spark, a[:, :1]).diag(), np.diag(a[:, 0]))
    same(Matrix.full(spark, 3, 2, 1.5), np.full((3, 2), 1.5))
    same(Matrix.identity(spark, 4), np.eye(4))
    with pytest.raises(ValueError):
        x + x.T
    with pytest.raises(ValueError):
        x @ x


def test_n_dimensions(spark):
    cube = np.arange(24.0).reshape(2, 3, 4)
    df = spark.createDataFrame([(i, j, k, float(cube[i, j, k])) for i in range(2) for j in range(3) for k in range(4)], "d0 int, d1 int, d2 int, v double")
    turned = {(r.d0, r.d1, r.d2): r.v for r in layout.permute(df, (2, 0, 1)).collect()}
    assert all(turned[k, i, j] == cube[i, j, k] for i in range(2) for j in range(3) for k in range(4))
    thin = df.where("v % 3 = 0")
    other = np.where(cube % 3 == 0, cube, 0)
    for op, want in (("add", cube + other), ("sub", cube - other), ("mul", cube * other)):
        got = {(r.d0, r.d1, r.d2): r.v for r in layout.combine(df, thin, 3, op).collect()}
        assert got == {p: want[p] for p in np.ndindex(2, 3, 4) if want[p]}
    got = {(r.d0, r.d1, r.d2): r.v for r in layout.combine(df, thin, 3, "div").collect()}
    assert got[0, 0, 1] == INF and got[0, 0, 3] == 1 and np.isnan(got[0, 0, 0]) and len(got) == 24
    assert {(r.d0,): r.v for r in layout.reduce(df, (1,)).collect()} == {(j,): cube[:, j].sum() for j in range(3)}


@pytest.mark.parametrize("form", [DENSE, SPARSE])
def test_products_of_a_square(spark, form):
    a = square()
    m = make(spark, a, form)
    same(m @ m, a @ a)
    same(m.T @ m, a.T @ a)
    same(m @ m.T, a @ a.T)
    same(m.T @ m.T, a.T @ a.T)
    same(m @ m + m, a @ a + a)
    same(m.T @ m + m.T, a.T @ a + a.T)


def test_products(spark, data, made):
    (a, b, c), (x, y, z) = data, made
    same(x @ z, a @ c)
    same(y @ z, b @ c)
    same(y.T @ x, b.T @ a)
    same(make(spark, a[:, :1]) @ make(spark, b[:1], SPARSE), a[:, :1] @ b[:1])  # outer product
    empty = Matrix.from_cells(spark.createDataFrame([], "i long, j long, v double"), 5, 4, SPARSE)
    assert (x @ empty).cells().count() == 0 and (y + make(spark, np.zeros((7, 5)), SPARSE)).cells().count() == (b != 0).sum()


def test_algebra(data, made):
    (a, b, _), (x, y, _) = data, made
    same((x.T @ y).T, b.T @ a)
    assert (x.T @ x).subarray((0, 0), (0, 0)).to_numpy()[0, 0] == (a[:, 0] ** 2).sum()
    assert x.norm().scalar() == pytest.approx(np.linalg.norm(a)) and y.sum().scalar() == b.sum()
    same(x.window((1, 1), "sum"), a)


def test_aggregates(data, made):
    for m, a in zip(made[:2], data[:2], strict=True):
        for keep in ("rows", "cols", ""):
            got = {(r["i"] if keep == "rows" else r["j"] if keep else 0): r for r in m.aggregates(AGGREGATES, keep).collect()}
            for k, r in got.items():
                part = a[k] if keep == "rows" else a[:, k] if keep else a.ravel()
                want = [part.sum(), part.mean(), part.max(), part.min(), part.var(ddof=1), part.std(ddof=1), np.linalg.norm(part)]
                assert [r[f] for f in AGGREGATES[1:]] == pytest.approx(want)
                assert r["count"] == (part.size if m.meta.fmt == DENSE else np.count_nonzero(part))
    same(made[0].aggregate("avg", "cols"), data[0].mean(0, keepdims=True))
    same(made[1].aggregate("sum", "rows"), data[1].sum(1, keepdims=True))


@pytest.mark.parametrize("size", [(1, 1), (3, 3), (2, 4), (20, 2), (5, 20)])
def test_windows(data, made, size):
    a, x = data[0], made[0]
    got = {(r["i"], r["j"]): r for r in x.windows(size).collect()}
    assert len(got) == a.size
    for (i, j), r in got.items():
        (r0, r1), (c0, c1) = ((p - s // 2, p - s // 2 + s) for p, s in zip((i, j), size, strict=True))
        part = a[max(r0, 0) : r1, max(c0, 0) : c1]
        assert r["count"] == part.size
        assert [r[f] for f in AGGREGATES[1:]] == pytest.approx([part.sum(), part.mean(), part.max(), part.min(), part.var(), part.std(), np.linalg.norm(part)], abs=1e-9)


def test_windows_cross_blocks(spark, monkeypatch):
    from tessera.operators import window

    monkeypatch.setattr(window, "BLOCK", 4)
    a = np.arange(60.0).reshape(30, 2)
    got = make(spark, a).window((5, 1), "sum").to_numpy()
    want = np.array([[a[max(i - 2, 0) : i + 3, j].sum() for j in range(2)] for i in range(30)])
    assert (got == want).all()


def test_rewrites(spark, data, made):
    x, y, z = made
    assert rules.rewrite(x.T.T) is x
    assert rules.rewrite((x.T + y.T).T).op == "elementwise"
    tree = (x @ z).subarray((1, 3), (2, 9)).tree()
    assert tree.splitlines()[0].startswith("matmul") and tree.count("subarray") == 2
    t, u, v = make(spark, data[0][:, :1]), make(spark, data[0][:, 1:2]), make(spark, data[0][:, 2:3])
    chain = rules.rewrite((t @ u.T) @ v)
    assert chain.operands[0] is t and chain.operands[1].meta.shape == (1, 1)
    same((t @ u.T) @ v, data[0][:, :1] @ data[0][:, 1:2].T @ data[0][:, 2:3])
    assert rules.best_order([(10, 100), (100, 5), (5, 50)])[0] == 7500
    plan = (y.T)._with(y.T, "add").cells()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0


def test_subarrays_reach_the_scan(spark, tmp_path, data):
    stored = files.write(make(spark, data[0]), f"file://{tmp_path}/m")
    plan = (stored.T @ stored).subarray((1, 2), (0, 0)).cells()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(j,1), LessThanOrEqual(j,2)" in plan and "(i," not in plan.split("PushedFilters")[1]


def test_tiles(spark, data, made):
    (a, b, c), (x, y, z) = data, made
    packed = tiles.pack(y)
    assert {r["fmt"] for r in packed.collect()} <= {"dense", "csr"}
    same(tiles.unpack(packed, 7, 5, (4, 3), SPARSE), b)
    same(tiles.unpack(tiles.pack(x), 7, 5, (4, 3)), a)
    same(tiles.unpack(tiles.transpose(packed), 5, 7, (3, 4), SPARSE), b.T)
    same(tiles.unpack(tiles.multiply(tiles.pack(x), tiles.pack(z, (3, 3))), 7, 6, (4, 3)), a @ c)
    same(tiles.unpack(tiles.multiply(packed, tiles.pack(x), transpose_a=True), 5, 5, (3, 3)), b.T @ a)
    same(tiles.unpack(tiles.multiply(tiles.pack(x), packed, transpose_b=True), 7, 7, (4, 4)), a @ b.T)
    same(x.retile((2, 2)), a)


def test_files(spark, tmp_path, data, made):
    a, y, b = data[0], made[1], data[1]
    path = f"file://{tmp_path}"
    stored = files.write(y, f"{path}/y")
    assert stored.meta == y.meta
    same(stored, b)
    files.compact(spark, f"{path}/y", 1)
    same(files.read(spark, f"{path}/y"), b)
    files.write_triples(y, f"{path}/t")
    same(files.read_triples(spark, f"{path}/t", 7, 5), b)
    files.write_matrix_market(y, f"{path}/mm")
    same(files.read_matrix_market(spark, f"{path}/mm"), b)
    (tmp_path / "sym.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 2\n2 1 5.0\n3 3 1.0\n")
    same(files.read_matrix_market(spark, f"{path}/sym.mtx"), [[0, 5, 0], [5, 0, 0], [0, 0, 1]])
    (tmp_path / "arr.mtx").write_text("%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n")
    same(files.read_matrix_market(spark, f"{path}/arr.mtx"), [[1, 3], [2, 4]])
    (tmp_path / "dense.csv").write_text("\n".join(",".join(map(str, r)) for r in a))
    same(files.read_dense_csv(spark, f"{path}/dense.csv", 7, 5), a)
    assert files.delete(spark, f"{path}/y") and not files.exists(spark, f"{path}/y")


def test_text_of_several_files(spark, tmp_path):
    """Lines are numbered by the files' names, not by the order in which Spark reads them: it packs large files first."""
    a = np.arange(40.0).reshape(10, 4)
    for n, (start, end) in enumerate(((0, 2), (2, 5), (5, 9), (9, 10))):
        (tmp_path / f"part-{n}.csv").write_text("\n".join(",".join(map(str, r)) for r in a[start:end]) + "\n\n")
    same(files.read_dense_csv(spark, f"file://{tmp_path}", 10, 4), a)
    folder = tmp_path / "market"
    folder.mkdir()
    (folder / "part-0").write_text("%%MatrixMarket matrix array real general\n% note\n3 2\n1\n")
    (folder / "part-1").write_text("2\n3\n4\n5\n")
    (folder / "part-2").write_text("6\n")
    same(files.read_matrix_market(spark, f"file://{folder}"), [[1, 4], [2, 5], [3, 6]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16b")
    try:
        same(files.read_dense_csv(spark, f"file://{tmp_path}/part-2.csv", 4, 4), a[5:9])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_text(spark, tmp_path, data, made):
    (a, b, _), (x, y, _), path = data, made, f"file://{tmp_path}"
    files.write_dense_csv(x, f"{path}/dense")
    same(files.read_dense_csv(spark, f"{path}/dense", 7, 5), a)
    for n, (m, want) in enumerate(((x, a), (y, b))):
        files.write_described(m, f"{path}/described-{n}")
        got = files.read_described(spark, f"{path}/described-{n}")
        assert got.meta.fmt == m.meta.fmt
        same(got, want)
    files.write_matrix_market(y, f"{path}/mm")
    first = sorted(p for p in (tmp_path / "mm").iterdir() if p.name.startswith("part-"))[0].read_text().splitlines()
    assert first[:2] == ["%%MatrixMarket matrix coordinate real general", f"7 5 {(b != 0).sum()}"]
    with pytest.raises(ValueError):
        files.write(files.write(y, f"{path}/own"), f"{path}/own")
    same(files.write(x, f"{path}/own", overwrite=True), a)


def test_npy(spark, tmp_path, monkeypatch):
    a = np.random.default_rng(2).normal(size=(50, 3))
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", a.astype(np.float32))
    monkeypatch.setattr(files, "NPY_BYTES", 200)
    same(files.read_npy(spark, f"file://{tmp_path}/a.npy"), a)
    same(files.read_npy(spark, f"{tmp_path}/b.npy"), a.astype(np.float32))
    np.save(tmp_path / "c.npy", np.zeros(3))
    with pytest.raises(ValueError):
        files.read_npy(spark, f"{tmp_path}/c.npy")


def test_shared_folder(spark, monkeypatch):
    """The session's setting comes first, then the folder it has set; a cluster without either is refused."""
    from types import SimpleNamespace

    from tessera.sources import shared

    assert shared.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    set_ = []
    session = lambda master, conf, own: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: conf), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: own, setCheckpointDir=set_.append))
    assert shared.shared_folder(session("spark://x", None, "hdfs://own/")) == "hdfs://own" and not set_
    with pytest.raises(ValueError):
        shared.shared_folder(session("spark://x", None, None))
    assert shared.shared_folder(session("local[2]", None, None)) == shared.LOCAL_FOLDER == set_[0]
    kept = shared.table(spark.range(3), "three")
    assert kept.count() == 3
    shared.forget(kept)
    assert not files.exists(spark, kept._shared_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_encodings_of_products(spark, data, made, monkeypatch):
    """Tall matrices held as rows need no join with themselves; large dense ones go through tiles; all agree."""
    from tessera.operators import matmul

    a, x = data[0], rowvec.to_matrix(rowvec.from_matrix(make(spark, data[0])), 7, 5)
    gram = (x.T @ x).cells()
    assert "Join" not in plan(gram) and "MapInArrow" in plan(gram)
    same(x.T @ x, a.T @ a)
    scaled = (x * 2.0 - 1.0).map(lambda v: v * v)
    assert "Join" not in plan((scaled.T @ scaled).cells())
    same(scaled.T @ scaled, ((2 * a - 1) ** 2).T @ (2 * a - 1) ** 2)
    same((x * 2.0).T @ x, 2 * a.T @ a)
    same(x.subarray((1, 6), (1, 3)).T @ x.subarray((1, 6), (0, 4)), a[1:, 1:4].T @ a[1:])
    same(x, a)
    monkeypatch.setattr(matmul, "BROADCAST_CELLS", 10)
    big, c = make(spark, a), make(spark, data[2])
    assert "PythonUDF" in plan((big @ c).cells()) or "MapInArrow" in plan((big @ c).cells())
    same(big @ c, a @ data[2])
    same(big.T @ big, a.T @ a)
    with pytest.raises(Exception, match="wider"):
        rowvec.sums(spark.range(1), lambda b: {"s": np.zeros((1, rowvec.MOST_COLUMNS + 1))})


def test_products_of_sparse_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a, b = (np.where(rng.random((30, 24)) < 0.08, rng.integers(1, 9, (30, 24)), 0).astype(float) for _ in range(2))
    monkeypatch.setattr(tiles, "ENTRY_COST", 1)
    x, y = (tiles.pack(make(spark, m, SPARSE), (10, 8)) for m in (a, b))
    same(tiles.unpack(tiles.multiply(x, y, transpose_a=True), 24, 24, (8, 8)), a.T @ b)
    same(tiles.unpack(tiles.multiply(x, y, transpose_b=True), 30, 30, (10, 10)), a @ b.T)


def shuffled(spark, run):
    """Rows that a run writes to shuffles."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def count():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = count()
    run()
    return count() - before


def test_nmf_shuffles_its_rows_once(spark):
    x = spark.range(300).select(F.col("id").alias("i"), F.array(*(((F.col("id") * 7 + k) % 10 + 1.0) for k in range(6))).alias("vec"))
    w = x.select("i", F.slice("vec", 1, 2).alias("vec"))
    h = np.arange(12.0).reshape(2, 6) + 1
    counts = {n: shuffled(spark, lambda n=n: algorithms.nmf(x, w, h, n)) for n in (1, 3, 9)}
    assert counts[9] - counts[3] < 300 and counts[3] - counts[1] < 300


@pytest.fixture(scope="module")
def xy(spark, data):
    x = rowvec.from_matrix(make(spark, data[0]))
    return x.withColumn("y", (F.col("i") % 2).cast("double")), data[0], np.arange(7) % 2


def test_closed_forms(xy):
    x, a, y = xy
    w = np.linalg.lstsq(a, y, rcond=None)[0]
    np.testing.assert_allclose(algorithms.least_squares(x), w)
    np.testing.assert_allclose(algorithms.least_squares(x, 0.5), np.linalg.solve(a.T @ a + 0.5 * np.eye(5), a.T @ y))
    bread, r = np.linalg.inv(a.T @ a), y - a @ w
    np.testing.assert_allclose(algorithms.robust_errors(x)[1], bread @ (a.T * r**2) @ a @ bread, atol=1e-12)
    got = algorithms.conjugate_gradient(x, intercept=True)
    wide = np.hstack([a, np.ones((7, 1))])
    np.testing.assert_allclose(got["w"], np.linalg.lstsq(wide, y, rcond=None)[0], atol=1e-6)
    np.testing.assert_allclose(decompose.inv(a.T @ a), bread)
    scaled = algorithms.conjugate_gradient(x, intercept=True, scale=True)
    np.testing.assert_allclose(scaled["w"], got["w"], atol=1e-6)
    e = y - wide @ got["w"]
    assert got["r2"] == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum()) and got["dispersion"] == pytest.approx(e @ e) and got["r2_vs_0"] == pytest.approx(1 - e @ e / (y @ y))
    assert got["adjusted_r2"] == pytest.approx(1 - (e @ e) / (((y - y.mean()) ** 2).sum() / 6))
    with pytest.raises(ValueError):
        algorithms.conjugate_gradient(x, scale=True)
    with pytest.raises(ValueError):
        decompose.inv(a)


def test_decompositions(xy):
    x, a, _ = xy
    u, s, v = decompose.svd(x)
    np.testing.assert_allclose(s, np.linalg.svd(a)[1])
    np.testing.assert_allclose(rowvec.to_matrix(u, 7, len(s)).to_numpy() @ np.diag(s) @ v.T, a, atol=1e-8)
    assert len(decompose.svd(x, 2)[1]) == 2
    projected, values, vectors = decompose.pca(x, 2)
    np.testing.assert_allclose(values, np.sort(np.linalg.eigvalsh(np.cov(a.T)))[::-1][:2])
    np.testing.assert_allclose(rowvec.to_matrix(projected, 7, 2).to_numpy(), (a - a.mean(0)) @ vectors, atol=1e-9)
    np.testing.assert_allclose(rowvec.to_matrix(decompose.pca(x, 2, centred=False)[0], 7, 2).to_numpy(), a @ vectors, atol=1e-9)


def test_iterative(spark, xy, data):
    x, a, y = xy
    sigma = lambda z: 1 / (1 + np.exp(-z))
    w = np.zeros(5)
    for _ in range(3):
        w = w - 0.1 * a.T @ (sigma(a @ w) - y)
    np.testing.assert_allclose(algorithms.logistic(x, np.zeros(5), 0.1), w)
    b, w = data[1], np.zeros((5, 1))
    for _ in range(2):
        w = w - 0.1 * b.T @ (sigma(b @ w) - y[:, None])
    sparse = algorithms.sparse_logistic(make(spark, b, SPARSE), make(spark, y[:, None], SPARSE), make(spark, np.zeros((5, 1)), SPARSE), 0.1, 2)
    same(sparse, w)
    rng = np.random.default_rng(3)
    m, w, h = abs(a) + 0.5, rng.random((7, 2)), rng.random((2, 5))
    w0, h0 = w, h
    for _ in range(3):
        w = w * (m @ h.T) / (w @ h @ h.T)
        h = h * (w.T @ m) / (w.T @ w @ h)
    got, factor = algorithms.nmf(rowvec.from_matrix(make(spark, m)), rowvec.from_matrix(make(spark, w0)), h0, 3)
    np.testing.assert_allclose(factor, h)
    np.testing.assert_allclose(rowvec.to_matrix(got, 7, 2).to_numpy(), w)


def test_pagerank(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 1), (3, 2), (3, 2)], "a long, b long")
    graph = tables.from_edges(edges, "a", "b", 5)
    m = np.zeros((5, 5))
    for i, j in {(0, 1), (1, 2), (2, 0), (2, 1), (3, 2)}:
        m[i, j] = 1
    m = m / np.maximum(m.sum(0), 1)
    v = np.full(5, 0.2)
    for _ in range(7):
        v = 0.85 * m @ v + 0.15 / 5
    got = {r["i"]: r["v"] for r in algorithms.pagerank(graph, 7).collect()}
    np.testing.assert_allclose([got[k] for k in range(5)], v)


def test_multinomial_and_library(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[3, 0], [-3, 0], [0, 4]])
    rows = [(k, [float(t) for t in [*(centres[k % 3] + rng.normal(0, 0.5, 2)), 1]], float(k % 3)) for k in range(90)]
    df = spark.createDataFrame(rows, "i long, vec array<double>, y double")
    w = algorithms.multinomial(df, 3, turns=20, rate=0.3)
    assert all((w @ np.array(v)).argmax() == y for _, v, y in rows)
    smooth = algorithms.multinomial_newton(df, 3, ridge=0.05)
    r, y = np.array([v for _, v, _ in rows]), np.array([int(t) for *_, t in rows])
    p = np.exp(r @ smooth.T)
    p /= p.sum(1, keepdims=True)
    p[np.arange(90), y] -= 1
    assert abs(p.T @ r / 90 + 0.05 * smooth).max() < 1e-6  # nothing is left to descend
    models = algorithms.library_models(df.where("y < 2"), k=2)
    assert models["logistic"].numClasses == 2 and models["pca"].pc.numCols == 2 and len(models["linear"].coefficients) == 3


def test_features(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "b", 3.0), (2, "b", None), (3, None, 5.0)], "i long, c string, x double")
    full = features.fill(df, ["x"], ["c"])
    assert [(r["value"], r["index"]) for r in features.string_index(full, "c").orderBy("index").collect()] == [("b", 0), ("", 1), ("a", 2)]
    assert {(r["i"], r["j"]) for r in features.one_hot(full, "i", "c").collect()} == {(0, 2), (1, 0), (2, 0), (3, 1)}
    scaled = [r["x"] for r in features.standard_scale(full, ["x"], centre=True).orderBy("i").collect()]
    x = np.array([1, 3, 0, 5.0])
    np.testing.assert_allclose(scaled, (x - x.mean()) / x.std(ddof=1))
    assert [r["vec"] for r in features.assemble(full, "i", ["x"]).orderBy("i").collect()] == [[1.0], [3.0], [0.0], [5.0]]


def test_introspection(made):
    assert tuple(tables.introspect(made[0].cells()).first()) == (7, 5, 35)
    assert tuple(tables.introspect(made[0].cells().limit(0)).first()) == (0, 0, 0)


def test_random(spark):
    a = Matrix.random(spark, 40, 5, seed=3).to_numpy()
    assert (a >= 0).all() and (a < 1).all() and len(np.unique(a)) > 190
    s = Matrix.random(spark, 100, 10, seed=3, density=0.2)
    assert 100 < s.cells().count() < 300 and s.meta.fmt == SPARSE


def test_more_sources(spark, tmp_path, data, made):
    a, b = data[:2]
    x, y = made[:2]
    path = f"file://{tmp_path}"
    same(Matrix.sequence(spark, 1, 2, 0.25), np.arange(1, 2.01, 0.25)[:, None])
    thin = Matrix.full(spark, 50, 10, 2.0, density=0.3, seed=1)
    assert thin.meta.fmt == SPARSE and 80 < thin.cells().count() < 220 and set(np.unique(thin.to_numpy())) == {0, 2}
    drawn = Matrix.random_triples(spark, 30, 20, 100, 4)
    assert drawn.to_numpy()[0, 0] >= 1 and drawn.to_numpy()[-1, -1] >= 1 and drawn.cells().groupBy("i", "j").count().where("count > 1").count() == 0
    files.write_tiles(tiles.pack(y), y.meta, f"{path}/t")
    read, meta = files.read_tiles(spark, f"{path}/t")
    same(tiles.unpack(read, *meta.shape, meta.tile, SPARSE), b)
    one, _ = files.read_tiles(spark, f"{path}/t", rows=(0, 0), cols=(1, 1))
    assert {(r["bi"], r["bj"]) for r in one.collect()} <= {(0, 1)}
    known = {(r["bi"], r["bj"]): r for r in tiles.describe(read).collect()}
    assert all(r["stored"] == (r["nr"] * r["nc"] if r["fmt"] == "dense" else np.count_nonzero(b[4 * i : 4 * i + 4, 3 * j : 3 * j + 3])) for (i, j), r in known.items())
    files.write_triples(y, f"{path}/d.csv")
    (tmp_path / "d.csv.mtd").write_text('{"rows": 7, "cols": 5, "nnz": 3, "sep": ","}')
    same(files.read_described(spark, f"{path}/d.csv"), b)


def test_more_maps(data, made):
    (a, b, _), (x, y, _) = data, made
    same(y.map_numpy(np.cos), np.cos(b))
    with np.errstate(all="ignore"):
        same((x / x).map_numpy(lambda v: v), a / a)
    same(x.persist() + x.checkpoint(), 2 * a)


def test_row_vectors(spark, data):
    a, x = data[0], rowvec.from_matrix(make(spark, data[0]))
    same(rowvec.to_matrix(rowvec.join(x, x), 7, 10), np.hstack([a, a]))
    for at in (0, 2, 4):
        got = rowvec.split_label(x, at).orderBy("i").collect()
        assert [r["y"] for r in got] == a[:, at].tolist() and [r["vec"] for r in got] == np.delete(a, at, 1).tolist()
    same(Matrix.from_cells(rowvec.gram_frame(x), 5, 5), a.T @ a)
    same(Matrix.from_cells(rowvec.times_vector(x, [1, 2, 3, 4, 5]), 7, 1), (a @ np.arange(1, 6))[:, None])
    assert rowvec.gram_frame(x.limit(0)).count() == 0


def few(spark, seed):
    """A sparse matrix of mostly gaps, among them whole rows, as an array too."""
    a = np.zeros((40, 300))
    a[np.random.default_rng(seed).integers(0, 30, 50), np.random.default_rng(seed + 1).integers(0, 300, 50)] = np.arange(1, 51) * (-1.0) ** np.arange(50)
    a[39, 299], a[0, 0] = seed, -1
    return a, make(spark, a, SPARSE)


def test_densify_shuffles_no_gaps(spark, monkeypatch):
    a, x = few(spark, 1)
    assert shuffled(spark, lambda: same(x.densify(), a)) < 500
    monkeypatch.setattr(layout, "FILL_WIDTH", 64)
    assert shuffled(spark, lambda: same(x.densify(), a)) < 500 and x.densify().cells().count() == a.size
    for shape in ((0, 3), (3, 0), (2, 2)):
        same(make(spark, np.zeros(shape), SPARSE).densify(), np.zeros(shape))


def test_constants_shuffle_no_gaps(spark):
    a, x = few(spark, 2)
    assert shuffled(spark, lambda: same((2.0 * (x + 1.0)) - 3.0, 2 * (a + 1) - 3)) < 500
    with np.errstate(all="ignore"):
        same(1.0 / x, 1 / a)
    same(make(spark, a, SPARSE, INT) + 1, a + 1)


def test_functions_shuffle_no_gaps(spark):
    a, x = few(spark, 3)
    assert shuffled(spark, lambda: same((x / 4.0).sigmoid().map(lambda v: v * 2), 2 / (1 + np.exp(-a / 4)))) < 500


@pytest.mark.parametrize("op", ["add", "mul", "div"])
def test_mixed_operands_shuffle_no_gaps(spark, op):
    (a, x), (b, y) = few(spark, 4), few(spark, 6)
    got, want = {"add": ((x + 1.0) + y, a + 1 + b), "mul": ((x + 2.0) * y, (a + 2) * b), "div": (y / (x + 2.5), b / (a + 2.5))}[op]
    assert shuffled(spark, lambda: same(got, want)) < 500


def test_differences_shuffle_no_gaps(spark):
    (a, x), (b, y) = few(spark, 4), few(spark, 6)
    assert shuffled(spark, lambda: same(y - (x + 1.0), b - a - 1)) < 500
    same((x + 1.0).T - y.T.densify(), (a + 1 - b).T)


@pytest.mark.parametrize("form", [DENSE, SPARSE])
def test_narrow_products_shuffle_no_sums(spark, form):
    a = np.random.default_rng(5).integers(-2, 3, (60, 4)).astype(float)
    a[7] = 0
    x = make(spark, a, form)
    assert shuffled(spark, lambda: same(x @ x.sparsify().T, a @ a.T)) < 1000
    got = {(r["i"], r["j"]): r["v"] for r in (x @ x.sparsify().T).cells().collect()}
    # an absent cell meets nothing: cells of a dense result are there where one of theirs is
    assert set(got) == {(i, j) for i in range(60) for j in range(60) if (j != 7 if form == DENSE else (a @ a.T)[i, j])}
    special = np.array([[INF, 0.0], [0.0, NAN]])
    y = make(spark, special, SPARSE)
    assert {(r["i"], r["j"]): str(r["v"]) for r in (y @ y).cells().collect()} == {(0, 0): "inf", (1, 1): "nan"}
    same(make(spark, a, form, INT) @ make(spark, a.T, form, INT), a @ a.T)


def test_narrow_products_of_two_large_matrices(spark, monkeypatch):
    from tessera.operators import matmul

    monkeypatch.setattr(matmul, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(matmul, "CELLS_A_TASK", 500)
    a = np.arange(120.0).reshape(40, 3)
    same(make(spark, a, SPARSE) @ make(spark, a, SPARSE).T, a @ a.T)
    monkeypatch.setattr(matmul, "BROADCAST_CELLS", 1000)
    same(make(spark, a, SPARSE) @ make(spark, a, SPARSE).T, a @ a.T)


@pytest.mark.parametrize("held", [1, 200_000])
def test_tiles_are_cut_many_at_a_time(spark, monkeypatch, held):
    monkeypatch.setattr(tiles, "HELD_ROWS", held)
    monkeypatch.setattr(tiles, "BATCH_CELLS", 50)
    a, x = few(spark, 8)
    a[20:28, 40:47] = np.arange(1, 57).reshape(8, 7)  # some full tiles
    x = make(spark, a, SPARSE)
    packed = tiles.pack(x, (8, 7))
    kinds = {(r["bi"], r["bj"]): r for r in packed.collect()}
    for (i, j), r in kinds.items():
        part = a[8 * i : 8 * i + 8, 7 * j : 7 * j + 7]
        assert (r["nr"], r["nc"]) == part.shape and r["fmt"] == ("dense" if np.count_nonzero(part) >= 0.3 * part.size else "csr")
        assert (tiles.dense(r.asDict()) == part).all() and (r["indptr"] is None) == (r["fmt"] == "dense")
    assert {(i // 8, j // 7) for i, j in zip(*np.nonzero(a), strict=True)} == set(kinds) and {r["fmt"] for r in kinds.values()} == {"dense", "csr"}
    same(tiles.unpack(tiles.transpose(packed), 300, 40, (7, 8), SPARSE), a.T)
    for plan in (packed, tiles.transpose(packed)):
        assert "FlatMapGroups" not in (text := plan._jdf.queryExecution().executedPlan().toString()) and "MapInPandas" not in text
    assert tiles.transpose(tiles.pack(make(spark, 0 * a, SPARSE), (8, 7))).count() == 0


@pytest.mark.parametrize("size", [(3, 4), (2, 1), (1, 1), (8, 8)])
def test_windows_of_sparse_matrices_shuffle_no_gaps(spark, monkeypatch, size):
    from tessera.operators import window

    a, x = few(spark, 9)
    monkeypatch.setattr(window, "BLOCK_ROWS", 16)
    monkeypatch.setattr(window, "BLOCK_COLS", 50)
    want = {f: np.empty(a.shape) for f in AGGREGATES}
    of = {"count": np.size, "sum": np.sum, "avg": np.mean, "max": np.max, "min": np.min, "var": np.var, "stdev": np.std, "norm": np.linalg.norm}
    for i, j in np.ndindex(a.shape):
        part = a[max(i - size[0] // 2, 0) : i - size[0] // 2 + size[0], max(j - size[1] // 2, 0) : j - size[1] // 2 + size[1]]
        for f in AGGREGATES:
            want[f][i, j] = of[f](part)
    assert shuffled(spark, lambda: same(x.window(size, "sum"), want["sum"])) < 50 * size[0] * size[1] + 500
    for f in AGGREGATES if size == (3, 4) else ("max",):
        same(x.window(size, f), want[f], atol=1e-9)


def test_tiles_meet_with_their_neighbours(spark):
    a, x = few(spark, 3)
    packed = tiles.pack(x, (4, 50))
    product = tiles.multiply(packed, packed, transpose_a=True, together=3)
    same(tiles.unpack(product, 300, 300, (50, 50), SPARSE), a.T @ a)
    assert "hashpartitioning(near" in product._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shape", [(3, 11), (11, 3), (1, 1), (9, 10), (8, 20)])
def test_filled_tile_by_tile(spark, monkeypatch, shape):
    for name, value in (("FILL_WIDTH", 5), ("FILL_ROWS", 4), ("FILL_TASKS", 3)):
        monkeypatch.setattr(layout, name, value)
    rng = np.random.default_rng(5)
    a = np.where(rng.random(shape) < 0.3, rng.integers(1, 9, shape), 0).astype(float)
    for form in (a, 0 * a, 0 * a + 1):
        x = make(spark, form, SPARSE)
        same(x + 1.0, form + 1)
        assert x.densify().cells().select("i", "j").distinct().count() == x.densify().cells().count() == a.size


def written(df, path):
    """Bytes a row of a table's columns in Parquet."""
    import pyarrow.parquet as pq

    df.write.parquet(str(path))
    footers = [pq.ParquetFile(f).metadata for f in path.glob("*.parquet")]
    groups = [m.row_group(g) for m in footers for g in range(m.num_row_groups)]
    return sum(g.column(c).total_compressed_size for g in groups for c in range(g.num_columns)) / sum(g.num_rows for g in groups)


def test_filled_cells_take_little_space(spark, tmp_path):
    x = Matrix.random(spark, 200, 20_000, 1, 0.001)
    for k, y in enumerate((x.densify(), x + 1.0, x.sigmoid(), x.window((3, 4), "sum"), (x + 1.0) * x)):
        assert written(y.cells(), tmp_path / str(k)) < 0.6
