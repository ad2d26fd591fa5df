"""The queries over the test tables, one for each operator, and the SQL that says what they must return.

Sums are over whole numbers wherever that is possible, so that the order of summation doesn't show; the rest is rounded
on both sides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import features, ieee
from tessera.operators import algorithms, decompose, layout, rowvec, tiles
from tessera.plans.matrix import AGGREGATES, Matrix
from tessera.plans.meta import FLOAT, INT, SPARSE
from tessera.sources import files, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


# the matrices, and the same in SQL


class Tables:
    """Matrices of the tables in a folder. Keys count from 0 without gaps, so counts give shapes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.dir, name)

    def e(self, scale: int = 64) -> Matrix:
        """Embeddings, in whole numbers."""
        df = self.read("embeddings")
        return tables.from_vectors(df, "vec_id", "embedding", df.count(), 64, lambda x: F.floor(scale * x))

    def p(self, dtype: str = "double") -> Matrix:
        """Parts by suppliers: quantities."""
        shape = self.read("part").count(), self.read("supplier").count()
        return tables.from_pairs(self.read("lineitem"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"), *shape, dtype)

    def d(self, dtype: str = "double") -> Matrix:
        """Of the same shape with another pattern: discounts in cents, some suppliers further on."""
        shape = self.read("part").count(), self.read("supplier").count()
        lines = self.read("lineitem").withColumn("further", (F.col("l_suppkey") + F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).otherwise(0)) % shape[1])
        return tables.from_pairs(lines, "l_partkey", "further", F.expr("round(l_discount * 100)").cast("bigint"), *shape, dtype)

    def u(self) -> Matrix:
        """Users by kinds of events, counted; dense."""
        events = self.read("events")
        kinds = F.array(*(F.count_if(F.col("event_type") == k) for k in _KINDS))
        users = events.groupBy(F.col("user_id").alias("i")).agg(kinds.alias("vec"))
        return Matrix.from_cells(users.select("i", F.posexplode("vec").alias("j", "v")), users.count(), len(_KINDS))

    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("double")).alias("vec"))

    def lines(self, label: str) -> DataFrame:
        """Rows (i, vec, y) of line items: 1, quantity, discount and tax in cents."""
        df = self.read("lineitem").withColumns({"one": F.lit(1), "cents": F.round(F.col("l_discount") * 100), "tax": F.round(F.col("l_tax") * 100), "label": F.expr(label)})
        return features.assemble(df, "l_orderkey", ["one", "l_quantity", "cents", "tax"], "label")


#: The kinds of events.
_KINDS = ("click", "error", "purchase", "signup", "view")

_E = "SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, floor({n} * unnest(embedding)::DOUBLE) AS v FROM embeddings"
E = _E.format(n=64)
P = "SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity::BIGINT)::DOUBLE AS v FROM lineitem GROUP BY ALL HAVING v <> 0"
D = "SELECT l_partkey AS i, (l_suppkey + CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 0 END) % (SELECT count(*) FROM supplier) AS j, sum(round(l_discount * 100)::BIGINT)::DOUBLE AS v FROM lineitem GROUP BY ALL HAVING v <> 0"
_KIND_SQL = " UNION ALL ".join(f"SELECT {k} AS j, '{name}' AS kind" for k, name in enumerate(_KINDS))
U = f"SELECT u.user_id AS i, k.j::BIGINT AS j, count(e.event_id)::DOUBLE AS v FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN ({_KIND_SQL}) k LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = k.kind GROUP BY ALL"
SHAPE = "SELECT (SELECT count(*) FROM part) AS rows, (SELECT count(*) FROM supplier) AS cols"
GRID = f"SELECT r.range AS i, c.range AS j FROM ({SHAPE}), range(rows) r, range(cols) c"
_DIV = "CASE WHEN {b} = 0 THEN {a} * 'inf'::DOUBLE ELSE {a} / {b} END"


def _sql(select: str, **named: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in named.items()) + " " + select


# sources and layouts


@_query(_sql("SELECT i, j, v FROM e", e=E))
def scan_dense_coo(spark, sf_dir):
    return Tables(spark, sf_dir).e().cells()


@_query("SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY ALL HAVING v <> 0")
def scan_sparse_int(spark, sf_dir):
    return Tables(spark, sf_dir).p(dtype=INT).cells()


@_query("SELECT r.range AS i, c.range AS j, 2.5::DOUBLE AS v FROM range(300) r, range(7) c")
def full_const(spark, sf_dir):
    return Matrix.full(spark, 300, 7, 2.5).cells()


@_query("SELECT range AS i, range AS j, 1.0::DOUBLE AS v FROM range(50)")
def identity(spark, sf_dir):
    return Matrix.identity(spark, 50).cells()


@_query("SELECT range AS i, 0::BIGINT AS j, 5 + range * 0.5::DOUBLE AS v FROM range(100)")
def sequence(spark, sf_dir):
    return Matrix.sequence(spark, 5, 54.5, 0.5).cells()


@_query(_sql("SELECT j AS i, i AS j, v FROM p", p=P))
def transpose_sparse(spark, sf_dir):
    return Tables(spark, sf_dir).p().T.cells()


@_query(_sql("SELECT j AS i, i AS j, v FROM e", e=E))
def transpose_dense(spark, sf_dir):
    return Tables(spark, sf_dir).e().T.cells()


@_query(_sql("SELECT i - 10 AS i, j - 5 AS j, v FROM p WHERE i BETWEEN 10 AND 90 AND j BETWEEN 5 AND 7", p=P))
def subarray_rebased(spark, sf_dir):
    return Tables(spark, sf_dir).p().subarray((10, 90), (5, 7)).cells()


@_query(_sql("SELECT i - 3 AS i, j, sum(x.v * y.v) AS v FROM (SELECT i, j AS k, v FROM e WHERE i BETWEEN 3 AND 9) x JOIN (SELECT i AS j, j AS k, v FROM e WHERE i <= 4) y USING (k) GROUP BY ALL", e=E))
def subarray_of_product(spark, sf_dir):
    e = Tables(spark, sf_dir).e()
    return (e @ e.T).subarray((3, 9), (0, 4)).cells()


@_query(_sql("SELECT i, j, coalesce(v, 0)::DOUBLE AS v FROM g LEFT JOIN p USING (i, j)", p=P, g=GRID))
def densify(spark, sf_dir):
    return Tables(spark, sf_dir).p().densify().cells()


@_query(_sql("SELECT i, j, v FROM u WHERE v <> 0", u=U))
def sparsify(spark, sf_dir):
    return Tables(spark, sf_dir).u().sparsify().cells()


@_query(
    _sql(
        """SELECT (i // 64)::INTEGER AS bi, (j // 16)::INTEGER AS bj, least(64, any_value(rows) - 64 * (i // 64))::INTEGER AS nr, least(16, any_value(cols) - 16 * (j // 16))::INTEGER AS nc,
                  CASE WHEN count(*) >= 0.3 * nr * nc THEN 'dense' ELSE 'csr' END AS fmt, (CASE WHEN count(*) >= 0.3 * nr * nc THEN nr * nc ELSE count(*) END)::BIGINT AS n, sum(v) AS total
           FROM p, s GROUP BY i // 64, j // 16""",
        p=P,
        s=SHAPE,
    )
)
def retile_counts(spark, sf_dir):
    packed = tiles.pack(Tables(spark, sf_dir).p().retile((64, 16)))
    return packed.select("bi", "bj", "nr", "nc", "fmt", F.size("data").cast("long").alias("n"), F.aggregate("data", F.lit(0.0), lambda s, x: s + x).alias("total"))


@_query(_sql("SELECT i, j, v FROM p", p=P))
def tile_round_trip(spark, sf_dir):
    p = Tables(spark, sf_dir).p()
    return tiles.unpack(tiles.transpose(tiles.pack(p, (100, 7))), p.meta.cols, p.meta.rows, (7, 100), SPARSE).T.cells()


@_query(_sql("SELECT (i // 100)::INTEGER AS bi, (j // 5)::INTEGER AS bj, count(*) AS n FROM p WHERE i // 100 = 1 AND j // 5 BETWEEN 0 AND 1 GROUP BY ALL", p=P))
def tile_lookup(spark, sf_dir):
    """Tiles stored and found by place."""
    p, path = Tables(spark, sf_dir).p(), files.scratch(spark, "tiles")
    files.write_tiles(tiles.pack(p, (100, 5)), p.meta, path)
    found, _ = files.read_tiles(spark, path, rows=(1, 1), cols=(0, 1))
    return found.select("bi", "bj", F.size(F.filter("data", lambda x: x != 0)).cast("long").alias("n"))


@_query(_sql("SELECT i, j, v FROM u UNION ALL SELECT i, j + 5, 2 * v FROM u", u=U))
def cbind(spark, sf_dir):
    u = Tables(spark, sf_dir).u()
    return u.cbind(2.0 * u).cells()


@_query(_sql("SELECT i, j, v FROM p UNION ALL SELECT i + rows, j, v FROM d, s", p=P, d=D, s=SHAPE))
def rbind(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.p().rbind(t.d()).cells()


@_query(_sql("SELECT i, i AS j, sum(v) AS v FROM p GROUP BY i", p=P))
def diag(spark, sf_dir):
    return Tables(spark, sf_dir).p().aggregate("sum", "rows").diag().cells()


_CUBE = f"SELECT e.user_id AS d0, k.j::BIGINT AS d1, hour(e.ts)::BIGINT AS d2, count(*)::DOUBLE AS v FROM events e JOIN ({_KIND_SQL}) k ON e.event_type = k.kind GROUP BY ALL"


def _cube(spark, sf_dir) -> DataFrame:
    kind = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("event_type")) - 1
    events = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("d0"), kind.alias("d1"), F.hour("ts").cast("bigint").alias("d2"))
    return events.groupBy("d0", "d1", "d2").agg(F.count(F.lit(1)).cast("double").alias("v"))


@_query(_sql("SELECT d2 AS d0, d0 AS d1, d1 AS d2, v FROM c", c=_CUBE))
def permute_3d(spark, sf_dir):
    return layout.permute(_cube(spark, sf_dir), (2, 0, 1))


@_query(_sql("SELECT d0 - 5 AS d0, d1, d2 - 6 AS d2, v FROM c WHERE d0 BETWEEN 5 AND 40 AND d2 BETWEEN 6 AND 17", c=_CUBE))
def subarray_3d(spark, sf_dir):
    return layout.subarray_nd(_cube(spark, sf_dir), [(5, 40), None, (6, 17)])


@_query(_sql("SELECT d2 AS d0, d1, sum(v) AS v FROM c GROUP BY ALL", c=_CUBE))
def reduce_3d(spark, sf_dir):
    return layout.reduce(_cube(spark, sf_dir), (2, 1))


@_query(_sql("SELECT d0, d1, d2, coalesce(x.v, 0) - coalesce(y.v, 0) AS v FROM c x FULL JOIN (SELECT d0, d1, 23 - d2 AS d2, v FROM c) y USING (d0, d1, d2) WHERE coalesce(x.v, 0) <> coalesce(y.v, 0)", c=_CUBE))
def sub_3d(spark, sf_dir):
    """The cube of events less itself with the hours turned round."""
    cube = _cube(spark, sf_dir)
    return layout.combine(cube, cube.withColumn("d2", 23 - F.col("d2")), 3, "sub")


@_query(_sql("SELECT max(i) + 1 AS rows, max(j) + 1 AS cols, count(*) AS nnz FROM p", p=P))
def introspect(spark, sf_dir):
    return tables.introspect(Tables(spark, sf_dir).p().cells())


# files: written to the shared folder and read again


@_query(_sql("SELECT i, j, v FROM p", p=P))
def io_parquet(spark, sf_dir):
    return files.write(Tables(spark, sf_dir).p(), files.scratch(spark, "parquet")).cells()


@_query(_sql("SELECT i, j, v FROM p", p=P))
def io_triples(spark, sf_dir):
    p, path = Tables(spark, sf_dir).p(), files.scratch(spark, "triples")
    files.write_triples(p, path)
    return files.read_triples(spark, path, *p.meta.shape).cells()


@_query(_sql("SELECT i, j, v FROM p", p=P))
def io_matrix_market(spark, sf_dir):
    p, path = Tables(spark, sf_dir).p(), files.scratch(spark, "market")
    files.write_matrix_market(p, path)
    return files.read_matrix_market(spark, path).cells()


@_query(_sql("SELECT i, j, v FROM e", e=E))
def io_dense_csv(spark, sf_dir):
    e, path = Tables(spark, sf_dir).e(), files.scratch(spark, "dense")
    files.write_dense_csv(e, path)
    return files.read_dense_csv(spark, path, *e.meta.shape).cells()


@_query(_sql("SELECT i, j, v FROM p UNION ALL SELECT -1 - i, j, v FROM u", p=P, u=U))
def io_described(spark, sf_dir):
    """A sparse and a dense matrix, each with its description beside it."""
    t, cells = Tables(spark, sf_dir), []
    for m in (t.p(), t.u()):
        path = files.scratch(spark, "described")
        files.write_described(m, path)
        cells.append(files.read_described(spark, path).cells())
    return cells[0].unionAll(cells[1].withColumn("i", -1 - F.col("i")))


@_query(_sql("SELECT i, j, v, 3 AS files FROM p", p=P))
def io_compact(spark, sf_dir):
    """A stored matrix rewritten into three files."""
    path = files.scratch(spark, "compact")
    files.write(Tables(spark, sf_dir).p(), path, band=64)
    files.compact(spark, path, 3)
    cells = files.read(spark, path).cells()
    return cells.withColumn("files", F.lit(len(cells.inputFiles())))


# cell by cell

_BOTH = "SELECT i, j, coalesce(p.v, 0)::DOUBLE AS a, coalesce(d.v, 0)::DOUBLE AS b FROM p FULL JOIN d USING (i, j)"


@_query(_sql("SELECT i, j, a + b AS v FROM b WHERE a + b <> 0", p=P, d=D, b=_BOTH))
def add_sparse(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.p() + t.d()).cells()


@_query(_sql("SELECT i, j, a - b AS v FROM b WHERE a - b <> 0", p=P, d=D, b=_BOTH))
def sub_sparse(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.p() - t.d()).cells()


@_query(_sql("SELECT i, j, p.v * d.v AS v FROM p JOIN d USING (i, j)", p=P, d=D))
def product_sparse(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.p() * t.d()).cells()


@_query(_sql(f"SELECT i, j, {_DIV.format(a='a', b='b')} AS v FROM b WHERE a <> 0", p=P, d=D, b=_BOTH))
def div_sparse_ieee(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.p() / t.d()).cells()


@_query(_sql("SELECT i, j, e.v::BIGINT // (2 * f.v + 1)::BIGINT AS v FROM e JOIN f USING (i, j)", e=E, f=_E.format(n=16)))
def div_int(spark, sf_dir):
    """Quotients of both signs, and of 0, cut towards zero; divisors are odd."""
    t = Tables(spark, sf_dir)
    return (t.e().cast(INT) / (2 * t.e(16).cast(INT) + 1)).cells()


@_query(_sql("SELECT i, j, trunc(v / 8)::BIGINT AS v FROM e", e=E))
def cast_int(spark, sf_dir):
    return (Tables(spark, sf_dir).e() / 8.0).cast(INT).cells()


@_query(
    _sql(
        """SELECT i, j, e.v / 8 + f.v / 8 AS v, 'float+float' AS pair, 'float' AS kind FROM e JOIN f USING (i, j) UNION ALL SELECT i, j, e.v * f.v / 8, 'int*float', 'double' FROM e JOIN f USING (i, j)
           UNION ALL SELECT i, j, e.v / 8 - f.v / 16, 'float-double', 'double' FROM e JOIN f USING (i, j) UNION ALL SELECT i, j, e.v - f.v, 'int-int', 'bigint' FROM e JOIN f USING (i, j)""",
        e=E,
        f=_E.format(n=32),
    )
)
def type_pairs(spark, sf_dir):
    """The types of results; the values are whole eighths and sixteenths, which a float holds."""
    t = Tables(spark, sf_dir)
    e, f = t.e(), t.e(32)
    e8, f8 = (e / 8.0).cast(FLOAT), (f / 8.0).cast(FLOAT)
    pairs = {"float+float": e8 + f8, "int*float": e.cast(INT) * f8, "float-double": e8 - f / 16.0, "int-int": e.cast(INT) - f.cast(INT)}
    out = [m.cells().select("i", "j", F.col("v").cast("double").alias("v"), F.lit(name).alias("pair"), F.typeof("v").alias("kind")) for name, m in pairs.items()]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


@_query(_sql("SELECT i, j, e.v + f.v AS v FROM e JOIN f USING (i, j)", e=E, f=_E.format(n=32)))
def add_dense(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.e() + t.e(32)).cells()


@_query(_sql("SELECT i, j, e.v - f.v AS v FROM e JOIN f USING (i, j)", e=E, f=_E.format(n=32)))
def sub_dense(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.e() - t.e(32)).cells()


@_query(_sql("SELECT i, j, e.v * f.v AS v FROM e JOIN f USING (i, j)", e=E, f=_E.format(n=32)))
def product_dense(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.e() * t.e(32)).cells()


@_query(_sql(f"SELECT i, j, {_DIV.format(a='e.v', b='f.v')} AS v FROM e JOIN f USING (i, j)", e=E, f=_E.format(n=32)))
def div_dense_ieee(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.e() / t.e(32)).cells()


_MIXED = "SELECT i, j, p.v AS a, coalesce(d.v, 0)::DOUBLE AS b FROM f p LEFT JOIN d USING (i, j)"
_FULL = "SELECT i, j, (coalesce(p.v, 0) + 1)::DOUBLE AS v FROM g LEFT JOIN p USING (i, j)"


def _mixed(op, spark, sf_dir, swapped=False):
    t = Tables(spark, sf_dir)
    a, b = t.p() + 1.0, t.d()
    return (op(b, a) if swapped else op(a, b)).cells()


@_query(_sql("SELECT i, j, a + b AS v FROM m", p=P, d=D, g=GRID, f=_FULL, m=_MIXED))
def add_mixed(spark, sf_dir):
    return _mixed(lambda a, b: a + b, spark, sf_dir)


@_query(_sql("SELECT i, j, b - a AS v FROM m", p=P, d=D, g=GRID, f=_FULL, m=_MIXED))
def sub_mixed(spark, sf_dir):
    return _mixed(lambda a, b: a - b, spark, sf_dir, swapped=True)


@_query(_sql("SELECT i, j, a * b AS v FROM m", p=P, d=D, g=GRID, f=_FULL, m=_MIXED))
def product_mixed(spark, sf_dir):
    return _mixed(lambda a, b: a * b, spark, sf_dir)


@_query(_sql(f"SELECT i, j, {_DIV.format(a='a', b='b')} AS v FROM m", p=P, d=D, g=GRID, f=_FULL, m=_MIXED))
def div_mixed(spark, sf_dir):
    return _mixed(lambda a, b: a / b, spark, sf_dir)


def _constant(name: str, sql: str, f, sparse: bool = False):
    _query(_sql(sql, **({"p": P, "g": GRID} if sparse else {"e": E})), name)(lambda spark, sf_dir: f(Tables(spark, sf_dir).p() if sparse else Tables(spark, sf_dir).e()).cells())


_constant("scalar_right_add", "SELECT i, j, v + 3 AS v FROM e", lambda m: m + 3.0)
_constant("scalar_left_sub", "SELECT i, j, 3 - v AS v FROM e", lambda m: 3.0 - m)
_constant("scalar_right_sub", "SELECT i, j, v - 3 AS v FROM e", lambda m: m - 3.0)
_constant("scalar_mul", "SELECT i, j, 0.5 * v AS v FROM e", lambda m: 0.5 * m)
_constant("scalar_left_div", f"SELECT i, j, {_DIV.format(a='3', b='v')} AS v FROM e", lambda m: 3.0 / m)
_constant("scalar_right_div", "SELECT i, j, v / 8 AS v FROM e", lambda m: m / 8.0)
_constant("scalar_mul_sparse", "SELECT i, j, 2 * v AS v FROM p", lambda m: m * 2.0, True)
_constant("scalar_add_sparse", "SELECT i, j, (coalesce(v, 0) + 1)::DOUBLE AS v FROM g LEFT JOIN p USING (i, j)", lambda m: m + 1.0, True)
_constant("scalar_left_div_sparse", f"SELECT i, j, {_DIV.format(a='1', b='coalesce(v, 0)')}::DOUBLE AS v FROM g LEFT JOIN p USING (i, j)", lambda m: 1.0 / m, True)
_constant("exp_dense", "SELECT i, j, round(exp(v / 64), 6) AS v FROM e", lambda m: (m / 64.0).exp().map(lambda c: F.round(c, 6)))
_constant("sigmoid_map", "SELECT i, j, round(1 / (1 + exp(-v / 64)), 6) AS v FROM e", lambda m: (m / 64.0).sigmoid().map(lambda c: F.round(c, 6)))
_constant("sigmoid_sparse", "SELECT i, j, round(1 / (1 + exp(-coalesce(v, 0) / 64)), 6) AS v FROM g LEFT JOIN p USING (i, j)", lambda m: (m / 64.0).sigmoid().map(lambda c: F.round(c, 6)), True)
_constant("abs_sqrt_log", "SELECT i, j, round(ln(1 + sqrt(abs(v))), 6) AS v FROM e", lambda m: m.map(lambda c: F.round(F.log(1 + F.sqrt(F.abs(c))), 6)))
_constant("pow_least", "SELECT i, j, least(pow(v, 2), 100) AS v FROM e", lambda m: m.map(lambda c: F.least(F.pow(c, F.lit(2.0)), F.lit(100.0))))


@_query(_sql("SELECT i, j, floor(v / 3) AS v FROM e", e=E))
def map_numpy(spark, sf_dir):
    return Tables(spark, sf_dir).e().map_numpy(lambda v: np.floor(v / 3)).cells()


# products

_PTP = "SELECT x.j AS i, y.j AS j, sum(x.v * y.v) AS v FROM {a} x JOIN {a} y USING (i) GROUP BY ALL"


@_query(_sql(_PTP.format(a="e"), e=E))
def gram_e(spark, sf_dir):
    e = Tables(spark, sf_dir).e()
    return (e.T @ e).cells()


@_query(_sql(_PTP.format(a="e"), e=E))
def gram_e_rowvec(spark, sf_dir):
    return rowvec.gram_frame(Tables(spark, sf_dir).vectors())


@_query(_sql(_PTP.format(a="e"), e=E))
def gram_e_tiles(spark, sf_dir):
    e = Tables(spark, sf_dir).e()
    packed = tiles.pack(e, (128, 64))
    return tiles.unpack(tiles.multiply(packed, packed, transpose_a=True), 64, 64, (64, 64)).cells()


@_query("SELECT x.j AS i, y.j AS j, round(sum(x.v * y.v), 6) AS v FROM (SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) x JOIN (SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) y USING (i) GROUP BY ALL")
def gram_real(spark, sf_dir):
    df = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("vec"))
    return rowvec.gram_frame(df).withColumn("v", F.round("v", 6))


@_query(_sql(_PTP.format(a="p"), p=P))
def gram_p(spark, sf_dir):
    p = Tables(spark, sf_dir).p()
    return (p.T @ p).cells()


@_query(_sql(_PTP.format(a="p"), p=P))
def gram_p_tiles(spark, sf_dir):
    p = Tables(spark, sf_dir).p()
    packed, n = tiles.pack(p, (512, 256)), p.meta.cols
    together = max(1, min(64, p.meta.rows // (512 * 32)))
    return tiles.unpack(tiles.multiply(packed, packed, transpose_a=True, together=together), n, n, (256, 256), SPARSE).cells()


@_query(_sql("SELECT x.i AS i, y.i AS j, sum(x.v * y.v) AS v FROM s x JOIN s y USING (j) GROUP BY ALL", u=U, s="SELECT * FROM u WHERE v <> 0"))
def matmul_aat(spark, sf_dir):
    u = Tables(spark, sf_dir).u().sparsify()
    return (u @ u.T).cells()


@_query(_sql("SELECT x.j AS i, y.j AS j, sum(x.v * y.v) AS v FROM p x JOIN d y USING (i) GROUP BY ALL HAVING sum(x.v * y.v) <> 0", p=P, d=D))
def matmul_sparse(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.p().T @ t.d()).cells()


@_query(_sql("SELECT x.i, y.j, sum(x.v * y.v) AS v FROM g x JOIN g y ON x.j = y.i GROUP BY ALL", e=E, g=_PTP.format(a="e")))
def matmul_tt(spark, sf_dir):
    e = Tables(spark, sf_dir).e()
    return (e.T @ ((e.T @ e) @ e.T).T).cells()


@_query(_sql("SELECT e.i, g.j, sum(e.v * g.v) AS v FROM e JOIN g ON e.j = g.i GROUP BY ALL", e=E, g=_PTP.format(a="e")))
def gmm(spark, sf_dir):
    e = Tables(spark, sf_dir).e()
    return (e @ (e.T @ e)).cells()


@_query(_sql("SELECT i, 0::BIGINT AS j, sum(v * (j % 7 + 1)) AS v FROM e GROUP BY i", e=E))
def mvm(spark, sf_dir):
    w = [float(k % 7 + 1) for k in range(64)]
    return rowvec.times_vector(Tables(spark, sf_dir).vectors(), w)


@_query(_sql("SELECT p.i AS i, 0::BIGINT AS j, sum(p.v * floor(s_acctbal)) AS v FROM p JOIN supplier ON s_suppkey = p.j GROUP BY p.i", p=P))
def spmv(spark, sf_dir):
    t = Tables(spark, sf_dir)
    w = t.read("supplier").select(F.col("s_suppkey").alias("i"), F.lit(0).alias("j"), F.floor("s_acctbal").alias("v"))
    p = t.p()
    return (p @ Matrix.from_cells(w, p.meta.cols, 1)).cells()


@_query(_sql("SELECT x.i AS i, y.i AS j, sum(x.v * y.v) AS v FROM u x JOIN u y USING (j) WHERE y.v <> 0 GROUP BY ALL", u=U))
def matmul_mixed(spark, sf_dir):
    u = Tables(spark, sf_dir).u()
    return (u @ u.sparsify().T).cells()


@_query(_sql("SELECT x.i AS i, y.j AS j, x.v * y.v + 0 AS v FROM (SELECT i, sum(v) AS v FROM e GROUP BY i) x CROSS JOIN (SELECT j, sum(v) AS v FROM e GROUP BY j) y", e=E))
def outer_product(spark, sf_dir):
    e = Tables(spark, sf_dir).e()
    return (e.aggregate("sum", "rows") @ e.aggregate("sum", "cols")).cells()


@_query(_sql("SELECT i, j, e.v + f.v + g.v + h.v + k.v AS v FROM e JOIN f USING (i, j) JOIN g USING (i, j) JOIN h USING (i, j) JOIN k USING (i, j)", e=E, f=_E.format(n=32), g=_E.format(n=16), h=_E.format(n=8), k=_E.format(n=4)))
def manyadd(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m, n, o, p, q = (t.e(s) for s in (64, 32, 16, 8, 4))
    return (((m + n) + (o + p)) + q).cells()


@_query(_sql("SELECT i, 0::BIGINT AS j, t * (SELECT sum(u * v) FROM r) + 0 AS v FROM r", r=f"SELECT i, sum(v) AS t, max(v) AS u, min(v) AS v FROM ({E}) GROUP BY i"))
def chain_order(spark, sf_dir):
    """(t·u)·v: the rewrite associates to the right, so that no N x N product is formed."""
    e = Tables(spark, sf_dir).e()
    t, u, v = (e.aggregate(f, "rows") for f in ("sum", "max", "min"))
    return ((t @ u.T) @ v).cells()


# aggregates and windows

_ROUNDED = ("var", "stdev", "norm", "avg")


def _agg_sql(key: str | None, source: str, names: dict) -> str:
    parts = [f"{key} AS {key}"] if key else []
    parts += [
        "count(*)::BIGINT AS count", "sum(v) AS sum", "round(avg(v), 6) AS avg", "max(v) AS max", "min(v) AS min",
        "round(var_samp(v), 6) AS var", "round(stddev_samp(v), 6) AS stdev", "round(sqrt(sum(v * v)), 6) AS norm",
    ]
    return _sql(f"SELECT {', '.join(parts)} FROM {source}" + (f" GROUP BY {key}" if key else ""), **names)


def _agg_sparse_sql(key: str | None) -> str:
    n = {"i": "any_value(cols)", "j": "any_value(rows)", None: "any_value(rows * cols)"}[key]
    parts = [key] if key else []
    parts += [
        "count(*)::BIGINT AS count", "sum(v) AS sum", f"round(sum(v) / {n}, 6) AS avg", f"CASE WHEN count(*) < {n} THEN greatest(max(v), 0) ELSE max(v) END::DOUBLE AS max",
        f"CASE WHEN count(*) < {n} THEN least(min(v), 0) ELSE min(v) END::DOUBLE AS min", f"round((sum(v * v) - sum(v) * sum(v) / {n}) / ({n} - 1), 6) AS var",
        f"round(sqrt((sum(v * v) - sum(v) * sum(v) / {n}) / ({n} - 1)), 6) AS stdev", "round(sqrt(sum(v * v)), 6) AS norm",
    ]
    return _sql(f"SELECT {', '.join(parts)} FROM p, s" + (f" GROUP BY {key}" if key else ""), p=P, s=SHAPE)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in _ROUNDED})


for _keep, _key in (("rows", "i"), ("cols", "j"), ("", None)):
    _by = _keep or "scalar"
    _query(_agg_sql(_key, "e", {"e": E}), f"agg_{_by}_dense")(lambda spark, sf_dir, keep=_keep: _rounded(Tables(spark, sf_dir).e().aggregates(AGGREGATES, keep)))
    _query(_agg_sparse_sql(_key), f"agg_{_by}_sparse")(lambda spark, sf_dir, keep=_keep: _rounded(Tables(spark, sf_dir).p().aggregates(AGGREGATES, keep)))
    for _func in AGGREGATES:
        _call = {"count": "count(*)::BIGINT", "sum": "sum(v)", "avg": "round(avg(v), 6)", "max": "max(v)", "min": "min(v)", "var": "round(var_samp(v), 6)", "stdev": "round(stddev_samp(v), 6)", "norm": "round(sqrt(sum(v * v)), 6)"}[_func]
        _places = f"{'i' if _keep == 'rows' else '0::BIGINT'} AS i, {'j' if _keep == 'cols' else '0::BIGINT'} AS j"
        _query(_sql(f"SELECT {_places}, {_call} AS v FROM e" + (f" GROUP BY e.{_key}" if _key else ""), e=E), f"agg_{_by}_{_func}")(
            lambda spark, sf_dir, keep=_keep, func=_func: (
                lambda cells: cells.withColumn("v", F.round("v", 6)) if func in _ROUNDED else cells
            )(Tables(spark, sf_dir).e().aggregate(func, keep).cells())
        )


def _window_sql(size: tuple[int, int]) -> str:
    (a, b), (c, d) = ((n // 2, n - 1 - n // 2) for n in size)
    first, second = f"(PARTITION BY j ORDER BY i RANGE BETWEEN {a} PRECEDING AND {b} FOLLOWING)", f"(PARTITION BY i ORDER BY j RANGE BETWEEN {c} PRECEDING AND {d} FOLLOWING)"
    variance = "greatest(q / n - (s / n) * (s / n), 0)"
    return _sql(
        f"SELECT i, j, n::BIGINT AS count, s AS sum, round(s / n, 6) AS avg, hi AS max, lo AS min, round({variance}, 6) AS var, round(sqrt({variance}), 6) AS stdev, round(sqrt(q), 6) AS norm FROM b",
        e=E,
        a=f"SELECT i, j, count(*) OVER w AS n, sum(v) OVER w AS s, sum(v * v) OVER w AS q, max(v) OVER w AS hi, min(v) OVER w AS lo FROM e WINDOW w AS {first}",
        b=f"SELECT i, j, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q, max(hi) OVER w AS hi, min(lo) OVER w AS lo FROM a WINDOW w AS {second}",
    )


for _name, _size in (("odd", (3, 5)), ("even", (2, 4)), ("wide", (9, 200))):
    _query(_window_sql(_size), f"window2d_{_name}")(lambda spark, sf_dir, size=_size: _rounded(Tables(spark, sf_dir).e().windows(size)))


@_query(
    _sql(
        "SELECT i, j, sum(s) OVER (PARTITION BY i ORDER BY j RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS v FROM a",
        p=P,
        g=GRID,
        a="SELECT i, j, sum(coalesce(v, 0)) OVER (PARTITION BY j ORDER BY i RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM g LEFT JOIN p USING (i, j)",
    )
)
def window_sparse(spark, sf_dir):
    return Tables(spark, sf_dir).p().window((3, 4), "sum").cells()


# algorithms


def _vector(spark, values, **names) -> DataFrame:
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(np.ravel(values))], "k long, v double")


def _graph(spark, sf_dir) -> Matrix:
    """Suppliers, then parts; an edge both ways where a part has been supplied."""
    t = Tables(spark, sf_dir)
    n, m = t.read("supplier").count(), t.read("part").count()
    lines = t.read("lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + n).alias("b")).distinct()
    return tables.from_edges(lines.unionAll(lines.select(F.col("b").alias("a"), F.col("a").alias("b"))), "a", "b", n + m)


def _pagerank_sql(turns: int) -> str:
    names = {
        "s": SHAPE,
        "half": "SELECT DISTINCT l_suppkey AS a, l_partkey + cols AS b FROM lineitem, s",
        "edges": "SELECT a AS i, b AS j FROM half UNION ALL SELECT b, a FROM half",
        "m": "SELECT i, j, 1.0::DOUBLE / count(*) OVER (PARTITION BY j) AS v FROM edges",
        "r0": "SELECT r.range AS i, 1.0::DOUBLE / (rows + cols) AS v FROM s, range(rows + cols) r",
    }
    for k in range(turns):
        names[f"r{k + 1}"] = f"SELECT n.i, 0.85::DOUBLE * coalesce(sum(m.v * r.v), 0) + (1 - 0.85::DOUBLE) / any_value(rows + cols) AS v FROM s, r0 n LEFT JOIN m ON m.i = n.i LEFT JOIN r{k} r ON r.i = m.j GROUP BY n.i"
    return _sql(f"SELECT i, round(v, 10) AS v FROM r{turns}", **names)


@_query(_pagerank_sql(3))
def pagerank_3it(spark, sf_dir):
    return algorithms.pagerank(_graph(spark, sf_dir), 3).withColumn("v", F.round("v", 10))


def _lr_sql(turns: int, rate: float = 1e-7, mean: bool = False) -> str:
    names = {"r": "SELECT row_number() OVER () AS i, [1.0::DOUBLE, l_quantity, round(l_discount * 100), round(l_tax * 100)] AS x, (l_returnflag = 'R')::INTEGER AS y FROM lineitem", "w0": "SELECT [0.0::DOUBLE, 0, 0, 0] AS w"}
    for k in range(turns):
        step = rate / 2**k if mean else rate
        g = ", ".join(f"w[{c}] - {step!r}::DOUBLE * {'avg' if mean else 'sum'}(x[{c}] * (1 / (1 + exp(-(x[1] * w[1] + x[2] * w[2] + x[3] * w[3] + x[4] * w[4]))) - y))" for c in range(1, 5))
        names[f"w{k + 1}"] = f"SELECT [{g}] AS w FROM r, w{k} GROUP BY w"
    return _sql(f"SELECT (generate_subscripts(w, 1) - 1)::BIGINT AS k, round(unnest(w), 6) AS v FROM w{turns}", **names)


@_query(_lr_sql(2))
def lr_2it(spark, sf_dir):
    w = algorithms.logistic(Tables(spark, sf_dir).lines("if(l_returnflag = 'R', 1, 0)"), np.zeros(4), turns=2)
    return _vector(spark, w).withColumn("v", F.round("v", 6))


@_query(_lr_sql(3, 0.001, mean=True))
def logit_mean_3it(spark, sf_dir):
    x = Tables(spark, sf_dir).lines("if(l_returnflag = 'R', 1, 0)")
    return _vector(spark, algorithms.logistic(x, np.zeros(4), rate=0.001, turns=3, average=True)).withColumn("v", F.round("v", 6))


def _sparse_lr_sql(turns: int) -> str:
    names = {"p": P, "s": SHAPE, "y": "SELECT p_partkey AS i FROM part WHERE p_size > 25", "w0": "SELECT range AS j, (range % 5 - 2) / 1000.0::DOUBLE AS w FROM s, range(cols)"}
    for k in range(turns):
        names[f"z{k}"] = f"SELECT p.i, 1 / (1 + exp(-sum(p.v * w.w))) - CASE WHEN i IN (SELECT i FROM y) THEN 1 ELSE 0 END AS z FROM p JOIN w{k} w USING (j) GROUP BY p.i"
        names[f"w{k + 1}"] = f"SELECT w.j, any_value(w.w) - 1e-4::DOUBLE * coalesce(sum(p.v * z.z), 0) AS w FROM w{k} w LEFT JOIN p ON p.j = w.j LEFT JOIN z{k} z ON z.i = p.i GROUP BY w.j"
    return _sql(f"SELECT j AS i, 0::BIGINT AS j, round(w, 6) AS v FROM w{turns}", **names)


@_query(_sparse_lr_sql(2))
def sparse_lr_2it(spark, sf_dir):
    """Two turns from weights that aren't 0."""
    t = Tables(spark, sf_dir)
    p = t.p()
    y = t.read("part").where("p_size > 25").select(F.col("p_partkey").alias("i"), F.lit(0).alias("j"), F.lit(1.0).alias("v"))
    w = Matrix.build(spark, p.meta.cols, 1, lambda i, j: (i % 5 - 2) / 1000.0)
    step = algorithms.sparse_logistic(p, Matrix.from_cells(y, p.meta.rows, 1, SPARSE), w, 1e-4, 2)
    return step.cells().withColumn("v", F.round("v", 6))


def _nmf(spark, sf_dir, turns: int):
    x = Tables(spark, sf_dir).vectors().select("i", F.transform("vec", lambda c: c + 64).alias("vec"))
    w = x.select("i", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: ((F.col("i") * 7 + r * 3) % 10 + 1) / 10.0).alias("vec"))
    h = np.array([[((r * 5 + j) % 10 + 1) / 10 for j in range(64)] for r in range(4)])
    return algorithms.nmf(x, w, h, turns)


def _nmf_sql(select: str, turns: int) -> str:
    names = {
        "x": f"SELECT i, j, v + 64 AS v FROM ({E})",
        "w0": "SELECT i, r.range AS r, ((i * 7 + r.range * 3) % 10 + 1) / 10.0::DOUBLE AS v FROM (SELECT vec_id AS i FROM embeddings), range(4) r",
        "h0": "SELECT r.range AS r, j.range AS j, ((r.range * 5 + j.range) % 10 + 1) / 10.0::DOUBLE AS v FROM range(4) r, range(64) j",
    }
    for k in range(turns):
        names |= {
            f"xh{k}": f"SELECT x.i, h.r, sum(x.v * h.v) AS v FROM x JOIN h{k} h USING (j) GROUP BY ALL",
            f"hh{k}": f"SELECT a.r AS r, b.r AS q, sum(a.v * b.v) AS v FROM h{k} a JOIN h{k} b USING (j) GROUP BY ALL",
            f"whh{k}": f"SELECT w.i, hh.q AS r, sum(w.v * hh.v) AS v FROM w{k} w JOIN hh{k} hh ON w.r = hh.r GROUP BY ALL",
            f"w{k + 1}": f"SELECT i, r, w.v * xh.v / whh.v AS v FROM w{k} w JOIN xh{k} xh USING (i, r) JOIN whh{k} whh USING (i, r)",
            f"wx{k}": f"SELECT w.r, x.j, sum(w.v * x.v) AS v FROM w{k + 1} w JOIN x USING (i) GROUP BY ALL",
            f"ww{k}": f"SELECT a.r AS r, b.r AS q, sum(a.v * b.v) AS v FROM w{k + 1} a JOIN w{k + 1} b USING (i) GROUP BY ALL",
            f"wwh{k}": f"SELECT ww.r, h.j, sum(ww.v * h.v) AS v FROM ww{k} ww JOIN h{k} h ON ww.q = h.r GROUP BY ALL",
            f"h{k + 1}": f"SELECT r, j, h.v * wx.v / wwh.v AS v FROM h{k} h JOIN wx{k} wx USING (r, j) JOIN wwh{k} wwh USING (r, j)",
        }
    return _sql(select, **names)


@_query(_nmf_sql("SELECT i, r AS j, round(v, 6) AS v FROM w1", 1))
def nmf_1it_w(spark, sf_dir):
    w, _ = _nmf(spark, sf_dir, 1)
    return w.select("i", F.posexplode("vec").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.round("v", 6).alias("v"))


@_query(_nmf_sql("SELECT r * 64 + j AS k, round(v, 6) AS v FROM h1", 1))
def nmf_1it_h(spark, sf_dir):
    _, h = _nmf(spark, sf_dir, 1)
    return _vector(spark, h).withColumn("v", F.round("v", 6))


@_query(_nmf_sql("SELECT r * 64 + j AS k, round(v, 5) AS v FROM h6", 6))
def nmf_6it_h(spark, sf_dir):
    """More turns than there are between two writings of W."""
    _, h = _nmf(spark, sf_dir, 6)
    return _vector(spark, h).withColumn("v", F.round("v", 5))


_Z = "SELECT [1.0::DOUBLE, l_quantity, round(l_discount * 100), round(l_tax * 100)] AS x, floor(l_extendedprice) AS y FROM lineitem"


@_query(_sql("SELECT 4 * (a.range) + b.range AS k, sum(x[a.range + 1] * x[b.range + 1]) AS v FROM z, range(4) a, range(4) b GROUP BY ALL UNION ALL SELECT 16 + a.range, sum(x[a.range + 1] * y) FROM z, range(4) a GROUP BY ALL", z=_Z))
def ols_normal_eq(spark, sf_dir):
    g, b, *_ = algorithms.normal_sums(Tables(spark, sf_dir).lines("floor(l_extendedprice)"))
    return _vector(spark, np.concatenate([g.ravel(), b]))


def _price_by_quantity(spark, sf_dir, *columns: str) -> DataFrame:
    df = tables.read(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    return features.assemble(df, "l_orderkey", list(columns), "l_extendedprice")


@_query("SELECT unnest([0, 1])::BIGINT AS k, round(unnest([regr_intercept(l_extendedprice, l_quantity), regr_slope(l_extendedprice, l_quantity)]), 4) AS v FROM lineitem")
def ols_simple(spark, sf_dir):
    return _vector(spark, algorithms.least_squares(_price_by_quantity(spark, sf_dir, "one", "l_quantity"))).withColumn("v", F.round("v", 4))


@_query("SELECT unnest([0, 1, 2])::BIGINT AS k, round(unnest([regr_slope(l_extendedprice, l_quantity), regr_intercept(l_extendedprice, l_quantity), regr_r2(l_extendedprice, l_quantity)]), 4) AS v FROM lineitem")
def linear_regression_cg(spark, sf_dir):
    got = algorithms.conjugate_gradient(_price_by_quantity(spark, sf_dir, "l_quantity"), intercept=True)
    return _vector(spark, [*got["w"], got["r2"]]).withColumn("v", F.round("v", 4))


_FIT = {
    "m": "SELECT count(*)::DOUBLE AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_extendedprice) AS y, sum(l_extendedprice * l_extendedprice) AS yy, regr_syy(l_extendedprice, l_quantity) AS spread FROM lineitem",
    "q": "SELECT any_value(n) AS n, any_value(y) AS y, any_value(yy) AS yy, any_value(spread) AS spread, any_value(a) AS a, any_value(b) AS b, sum(pow(l_extendedprice - a - b * l_quantity, 2)) AS ee FROM lineitem, m",
}


@_query(
    _sql(
        """SELECT unnest(['intercept', 'slope', 'mean_y', 'deviation_y', 'dispersion', 'r2', 'adjusted_r2', 'r2_vs_0', 'adjusted_r2_vs_0']) AS name,
                  round(unnest([a, b, y, sqrt(spread / (n - 1)), ee / (n - 2), 1 - ee / spread, 1 - (ee / (n - 2)) / (spread / (n - 1)), 1 - ee / yy, 1 - (ee / (n - 2)) / (yy / n)]), 4) AS v FROM q""",
        **_FIT,
    )
)
def linear_regression_scaled(spark, sf_dir):
    """Columns shifted and scaled while it runs, and the statistics of the fit."""
    got = algorithms.conjugate_gradient(_price_by_quantity(spark, sf_dir, "l_quantity"), intercept=True, scale=True)
    names = ("mean_y", "deviation_y", "dispersion", "r2", "adjusted_r2", "r2_vs_0", "adjusted_r2_vs_0")
    rows = [("intercept", float(got["w"][1])), ("slope", float(got["w"][0])), *((n, float(got[n])) for n in names)]
    return spark.createDataFrame(rows, "name string, v double").withColumn("v", F.round("v", 4))


@_query("SELECT unnest([0, 1])::BIGINT AS k, round(unnest([regr_intercept(l_extendedprice, l_quantity), regr_slope(l_extendedprice, l_quantity)]), 3) AS v FROM lineitem")
def library_linear(spark, sf_dir):
    """Spark's own linear regression on the same rows."""
    x = _price_by_quantity(spark, sf_dir, "l_quantity")
    model = algorithms.library_linear(x)
    return _vector(spark, [model.intercept, model.coefficients[0]]).withColumn("v", F.round("v", 3))


@_query("SELECT 0::BIGINT AS k, round(sum(l_quantity * l_extendedprice) / (sum(l_quantity * l_quantity) + 1e-6::DOUBLE), 4) AS v FROM lineitem")
def ridge_simple(spark, sf_dir):
    return _vector(spark, algorithms.least_squares(_price_by_quantity(spark, sf_dir, "l_quantity"), 1e-6)).withColumn("v", F.round("v", 4))


@_query("WITH b AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS b FROM lineitem) SELECT 0::BIGINT AS k, round(sqrt(sum(pow(l_quantity * (l_extendedprice - b * l_quantity), 2))) / sum(l_quantity * l_quantity), 6) AS v FROM lineitem, b")
def robust_se_simple(spark, sf_dir):
    _, cov = algorithms.robust_errors(_price_by_quantity(spark, sf_dir, "l_quantity"))
    return _vector(spark, np.sqrt(np.diag(cov))).withColumn("v", F.round("v", 6))


def _inverse_sql(name: str, n: int) -> dict[str, str]:
    """Steps of elimination on the cells (i, j, v) of ``name`` beside the identity; the last, ``inverse``, has its inverse."""
    steps = {"a0": f"SELECT i, j, v FROM {name} UNION ALL SELECT a.range, b.range + {n}, (a.range = b.range)::INTEGER::DOUBLE FROM range({n}) a, range({n}) b"}
    for k in range(n):
        steps[f"a{k + 1}"] = (
            f"SELECT a.i, a.j, CASE WHEN a.i = {k} THEN a.v / mid.v ELSE a.v - own.v * top.v / mid.v END AS v FROM a{k} a JOIN a{k} top ON top.i = {k} AND top.j = a.j"
            f" JOIN a{k} own ON own.i = a.i AND own.j = {k} JOIN a{k} mid ON mid.i = {k} AND mid.j = {k}"
        )
    return steps | {"inverse": f"SELECT i, j - {n} AS j, v FROM a{n} WHERE j >= {n}"}


_SOLVE = {
    "z": _Z,
    "g": "SELECT a.range AS i, b.range AS j, sum(x[a.range + 1] * x[b.range + 1]) AS v FROM z, range(4) a, range(4) b GROUP BY ALL",
    **_inverse_sql("g", 4),
    "b": "SELECT a.range AS i, sum(x[a.range + 1] * y) AS v FROM z, range(4) a GROUP BY ALL",
    "w": "SELECT list(v ORDER BY i) AS w FROM (SELECT inverse.i, sum(inverse.v * b.v) AS v FROM inverse JOIN b ON b.i = inverse.j GROUP BY inverse.i)",
    "meat": "SELECT a.range AS i, b.range AS j, sum(x[a.range + 1] * x[b.range + 1] * pow(y - x[1] * w[1] - x[2] * w[2] - x[3] * w[3] - x[4] * w[4], 2)) AS v FROM z, w, range(4) a, range(4) b GROUP BY ALL",
}


@_query(_sql("SELECT l.i AS k, round(sqrt(sum(l.v * meat.v * r.v)), 6) AS v FROM inverse l JOIN meat ON meat.i = l.j JOIN inverse r ON r.i = meat.j AND r.j = l.i GROUP BY l.i", **_SOLVE))
def robust_se(spark, sf_dir):
    _, cov = algorithms.robust_errors(Tables(spark, sf_dir).lines("floor(l_extendedprice)"))
    return _vector(spark, np.sqrt(np.diag(cov))).withColumn("v", F.round("v", 6))


def _eigen_sql(matrix: str, k: int, doublings: int = 16) -> dict[str, str]:
    """The largest k eigenvalues (val1, ...) and their vectors (vec1, ...) of the cells of a symmetric matrix: it is squared
    again and again, whose columns turn to the first vector, which is then taken off the matrix."""
    steps, rest = {}, matrix
    for n in range(1, k + 1):
        steps |= {
            f"pow{n}": f"""SELECT 0 AS step, i, j, v / (SELECT sum(v) FROM {rest} WHERE i = j) AS v FROM {rest} UNION ALL
                SELECT step + 1, i, j, v / sum(v) FILTER (i = j) OVER () FROM (SELECT a.step, a.i, b.j, sum(a.v * b.v) AS v FROM pow{n} a JOIN pow{n} b ON a.j = b.i WHERE a.step < {doublings} GROUP BY ALL)""",
            f"col{n}": f"SELECT i, v FROM pow{n} WHERE step = {doublings} AND j = (SELECT arg_max(i, v) FROM pow{n} WHERE step = {doublings} AND i = j)",
            f"vec{n}": f"SELECT i, v * sign((SELECT arg_max(v, abs(v)) FROM col{n})) / sqrt(sum(v * v) OVER ()) AS v FROM col{n}",
            f"val{n}": f"SELECT sum(x.v * m.v * y.v) AS v FROM {rest} m JOIN vec{n} x ON x.i = m.i JOIN vec{n} y ON y.i = m.j",
            f"rest{n}": f"SELECT m.i, m.j, m.v - (SELECT v FROM val{n}) * x.v * y.v AS v FROM {rest} m JOIN vec{n} x ON x.i = m.i JOIN vec{n} y ON y.i = m.j",
        }
        rest = f"rest{n}"
    return steps


def _recursive(select: str, **named: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{k} AS {'' if k.startswith('pow') else 'MATERIALIZED '}({v})" for k, v in named.items()) + " " + select


def _each(k: int, select: str) -> str:
    return " UNION ALL ".join(select.format(n=n, at=n - 1) for n in range(1, k + 1))


_MOMENTS = {"e": E, "g": _PTP.format(a="e")}
_COVARIANCE = {
    "e": E,
    "mean": "SELECT j, avg(v) AS v FROM e GROUP BY j",
    "c": "SELECT i, j, e.v - mean.v AS v FROM e JOIN mean USING (j)",
    "g": "SELECT x.j AS i, y.j AS j, sum(x.v * y.v) / (any_value(n) - 1) AS v FROM c x JOIN c y USING (i), (SELECT count(*) AS n FROM embeddings) GROUP BY ALL",
}


@_query(_sql("SELECT 0::BIGINT AS k, sum(v * v) AS v FROM e UNION ALL SELECT 1, sum(v * v) FROM g", e=E, g=_PTP.format(a="e")))
def svd_moments(spark, sf_dir):
    """Sums of the singular values' squares and fourth powers: the squared norms of X and of XᵀX."""
    _, s, _ = decompose.svd(Tables(spark, sf_dir).vectors())
    return _vector(spark, [(s**2).sum(), (s**4).sum()]).withColumn("v", F.round("v", 0))


@_query(_recursive(_each(10, "SELECT e.i, {at} AS j, round(sum(e.v * x.v) / sqrt(any_value(s.v)), 6) AS v FROM e JOIN vec{n} x ON x.i = e.j, val{n} s GROUP BY e.i"), **_MOMENTS, **_eigen_sql("g", 10)))
def svd_rank10(spark, sf_dir):
    u, _, _ = decompose.svd(Tables(spark, sf_dir).vectors(), 10)
    return u.select("i", F.posexplode("vec").alias("j", "v")).withColumn("v", F.round("v", 6))


@_query(_recursive(_each(10, "SELECT {at} AS j, x.i, round(x.v, 6) AS v, round(s.v, 3) AS value FROM vec{n} x, val{n} s"), **_MOMENTS, **_eigen_sql("g", 10)))
def eigen_gram(spark, sf_dir):
    """The largest eigenvalues of XᵀX and their vectors."""
    values, vectors = decompose.eigen(decompose.gram(Tables(spark, sf_dir).vectors()), 10)
    rows = [(n, i, float(vectors[i, n]), float(values[n])) for n in range(10) for i in range(len(vectors))]
    return spark.createDataFrame(rows, "j int, i long, v double, value double").withColumns({"v": F.round("v", 6), "value": F.round("value", 3)})


@_query(_recursive(_each(5, "SELECT {at}::BIGINT AS k, round(v, 4) AS v FROM val{n}"), **_COVARIANCE, **_eigen_sql("g", 5)))
def pca_variance(spark, sf_dir):
    """The largest eigenvalues of the covariance."""
    _, values, _ = decompose.pca(Tables(spark, sf_dir).vectors(), 5)
    return _vector(spark, values).withColumn("v", F.round("v", 4))


@_query(_recursive(_each(5, "SELECT c.i, {at} AS j, round(sum(c.v * x.v), 5) AS v FROM c JOIN vec{n} x ON x.i = c.j GROUP BY c.i"), **_COVARIANCE, **_eigen_sql("g", 5)))
def pca_project_5(spark, sf_dir):
    projected, _, _ = decompose.pca(Tables(spark, sf_dir).vectors(), 5)
    return projected.select("i", F.posexplode("vec").alias("j", "v")).withColumn("v", F.round("v", 5))


@_query(_sql("SELECT i * 4 + j AS k, round(v, 9) AS v FROM inverse", **_SOLVE))
def inverse_small(spark, sf_dir):
    g, *_ = algorithms.normal_sums(Tables(spark, sf_dir).lines("0"))
    return _vector(spark, decompose.inv(g)).withColumn("v", F.round("v", 9))


def _multinomial_sql(turns: int, ridge: float = 0.01, classes: int = 10) -> str:
    names = {
        "x": "SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings",
        "w0": f"SELECT c.range AS c, j.range AS j, 0::DOUBLE AS w, 0::DOUBLE AS ahead FROM range({classes}) c, range(64) j",
    }
    momentum = 1.0
    for k in range(turns):
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        names |= {
            f"z{k}": f"SELECT x.i, w.c, sum(x.v * w.ahead) AS z FROM x JOIN w{k} w USING (j) GROUP BY ALL",
            f"p{k}": f"SELECT i, c, exp(z - max(z) OVER r) AS p FROM z{k} WINDOW r AS (PARTITION BY i)",
            f"d{k}": f"SELECT i, c, p / sum(p) OVER (PARTITION BY i) - CASE WHEN c = label THEN 1 ELSE 0 END AS d FROM p{k} JOIN embeddings ON vec_id = i",
            f"g{k}": f"SELECT d.c, x.j, sum(d.d * x.v) / (SELECT count(*) FROM embeddings) AS g FROM d{k} d JOIN x USING (i) GROUP BY ALL",
            f"n{k}": f"SELECT c, j, w.w, ahead - (g + {ridge!r}::DOUBLE * ahead) AS new FROM w{k} w JOIN g{k} USING (c, j)",
            f"w{k + 1}": f"SELECT c, j, new AS w, new + {(momentum - 1) / after!r}::DOUBLE * (new - w) AS ahead FROM n{k}",
        }
        momentum = after
    return _recursive(f"SELECT c * 64 + j AS k, round(w, 5) AS v FROM w{turns}", **names)


@_query(_multinomial_sql(8))
def multinomial_logistic(spark, sf_dir):
    df = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("double").alias("y"))
    return _vector(spark, algorithms.multinomial(df, 10, ridge=0.01, turns=8)).withColumn("v", F.round("v", 5))


@_query(_sql("SELECT x.i AS i, x.v AS y, sum(z.v) AS total FROM (SELECT i, v FROM e WHERE j = 0) x JOIN (SELECT i, v FROM e WHERE j > 0 UNION ALL SELECT i, v FROM e) z USING (i) GROUP BY ALL", e=E))
def row_join_and_label(spark, sf_dir):
    """Rows joined by number; the first component split off as a label."""
    x = Tables(spark, sf_dir).vectors()
    return rowvec.split_label(rowvec.join(x, x)).select("i", "y", F.aggregate("vec", F.lit(0.0), lambda s, v: s + v).alias("total"))


# features


@_query("SELECT event_type AS value, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS index, count(*) AS n FROM events GROUP BY event_type")
def string_index(spark, sf_dir):
    return features.string_index(tables.read(spark, sf_dir, "events"), "event_type")


@_query("WITH x AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS j FROM events GROUP BY event_type) SELECT event_id AS i, j, 1.0::DOUBLE AS v FROM events JOIN x USING (event_type)")
def one_hot(spark, sf_dir):
    return features.one_hot(tables.read(spark, sf_dir, "events"), "event_id", "event_type")


@_query("SELECT o_orderstatus AS i, o_orderpriority AS j, count(*) AS v FROM orders GROUP BY ALL")
def contingency(spark, sf_dir):
    return features.contingency(tables.read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@_query("SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part), 6) AS price, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part), 6) AS size FROM part")
def standard_scale(spark, sf_dir):
    part = features.standard_scale(tables.read(spark, sf_dir, "part"), ["p_retailprice", "p_size"], centre=True)
    return part.select("p_partkey", F.round("p_retailprice", 6).alias("price"), F.round("p_size", 6).alias("size"))


@_query(_sql("SELECT j, round(sqrt(sum(v * v)), 6) AS norm, row_number() OVER (ORDER BY sum(v * v) DESC, j)::INTEGER AS place FROM e GROUP BY j", e=E))
def order_columns(spark, sf_dir):
    from pyspark.sql.window import Window

    squares = Tables(spark, sf_dir).e().map(lambda c: c * c).aggregates(("sum",), "cols")
    return squares.select("j", F.round(F.sqrt("sum"), 6).alias("norm"), F.row_number().over(Window.orderBy(F.desc("sum"), "j")).alias("place"))


@_query(_sql("SELECT i, j, v FROM e JOIN (SELECT i FROM e GROUP BY i HAVING sum(v) > 0) USING (i)", e=E))
def select_rows(spark, sf_dir):
    e = Tables(spark, sf_dir).e().cells()
    return e.join(e.groupBy("i").agg(F.sum("v").alias("s")).where("s > 0").select("i"), "i", "left_semi")


def _drawn(seed: int, *places: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(places)})), 1, 13))::BIGINT::DOUBLE / {16**13})"


_RANGES = "(SELECT r.range AS i, c.range AS j FROM range({rows}) r, range({cols}) c)"


@_query(f"SELECT i, j, {_drawn(5, 'i', 'j')} AS v FROM {_RANGES.format(rows=2000, cols=10)}")
def random_matrix(spark, sf_dir):
    return Matrix.random(spark, 2000, 10, seed=5).cells()


@_query(f"SELECT i, j, round(sqrt(-2 * ln(1 - {_drawn(7, 'i', 'j')})) * cos(2 * pi() * {_drawn(9, 'i', 'j')}), 9) AS v FROM {_RANGES.format(rows=900, cols=40)} WHERE {_drawn(8, 'i', 'j')} < 0.05::DOUBLE")
def random_sparse(spark, sf_dir):
    """Normal values in a share of the cells."""
    return Matrix.random(spark, 900, 40, seed=7, density=0.05, normal=True).cells().withColumn("v", F.round("v", 9))


@_query(
    f"""SELECT i, j, round(sum(v), 9) AS v FROM (
        SELECT floor({_drawn(3, 'range')} * 50)::BIGINT AS i, floor({_drawn(4, 'range')} * 30)::BIGINT AS j, {_drawn(5, 'range')} AS v FROM range(4000) UNION ALL VALUES (0, 0, 1.0), (49, 29, 1.0)) GROUP BY ALL"""
)
def random_triples(spark, sf_dir):
    """The generator of sparse matrices: values at drawn places, those that meet added up."""
    return Matrix.random_triples(spark, 50, 30, 4000, 3).cells().withColumn("v", F.round("v", 9))


@_query(f"SELECT i, j, 2.5::DOUBLE AS v FROM {_RANGES.format(rows=500, cols=30)} WHERE {_drawn(2, 'i', 'j')} < 0.1::DOUBLE")
def full_sparse(spark, sf_dir):
    return Matrix.full(spark, 500, 30, 2.5, density=0.1, seed=2).cells()


@_query(f"SELECT i, j, round(sqrt(i + 0.5 * j), 9) AS v FROM {_RANGES.format(rows=100, cols=30)}")
def build(spark, sf_dir):
    """A matrix by formula."""
    return Matrix.build(spark, 100, 30, lambda i, j: F.round(F.sqrt(i + 0.5 * j), 9)).cells()


@_query(_sql(f"SELECT i, j, v FROM e WHERE {_drawn(11, 'i')} < 0.25::DOUBLE", e=E))
def sample_rows(spark, sf_dir):
    return Tables(spark, sf_dir).e().sample(0.25, 11)


@_query(_sql(f"SELECT i, j, {_DIV.format(a='(v - 2)', b='v')} AS v FROM e", e=E))
def ieee_division(spark, sf_dir):
    e = Tables(spark, sf_dir).e()
    return e.map(lambda c: ieee.ieee_div(c - 2.0, c)).cells()
