"""Queries of proximal operators, solvers and block thresholding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.operators import blocks, linop, prox, solvers, transforms
from tensorloom.plans.shared import CENT, PI, Catalogue, complex_vectors, rnd, rounded, table

C = Catalogue()

# proximal operators on all vectors as complex entries
_X = f"{CENT}, x AS (SELECT vec_id, i, re, im FROM cent)"
_SOFT = "CASE WHEN sqrt({re} * {re} + {im} * {im}) > {t} THEN 1 - {t} / nullif(sqrt({re} * {re} + {im} * {im}), 0) ELSE 0 END"


def _x(spark, sf_dir) -> DataFrame:
    return complex_vectors(spark, sf_dir).df.select("vec_id", "i", "re", "im")


def _shrunk(re: str, im: str, t: str) -> tuple[str, str]:
    s = "(" + _SOFT.format(re=f"({re})", im=f"({im})", t=t) + ")"
    return f"({re}) * {s}", f"({im}) * {s}"


def _prox(name: str, make, alpha: float, re: str, im: str) -> None:
    def query(spark, sf_dir) -> DataFrame:
        x = _x(spark, sf_dir)
        return rounded(make(spark, x)(x, alpha), "vec_id", "i", re=F.col("re"), im=F.col("im"))

    C.add(f"prox_{name}", query, f"WITH {_X} SELECT vec_id, i, {rnd(re)} AS re, {rnd(im)} AS im FROM x")


_prox("zero", lambda s, x: prox.zero, 0.5, "re", "im")
_prox("soft", lambda s, x: prox.soft(0.2), 0.5, *_shrunk("re", "im", "0.1"))
_inner = _shrunk("re / 0.5", "im / 0.5", "0.4")
_prox("convex_conjugate", lambda s, x: prox.convex_conjugate(prox.soft(0.2)), 0.5, f"re - 0.5 * ({_inner[0]})", f"im - 0.5 * ({_inner[1]})")
_prox("postcomposition", lambda s, x: prox.postcomposition(prox.soft(0.2), 3.0), 0.5, *_shrunk("re", "im", "(0.2 * 1.5)"))
_inner = _shrunk("re * 2 + 0.25", "im * 2", "(0.2 * 2.0)")
_prox("precomposition", lambda s, x: prox.precomposition(prox.soft(0.2), 2.0, 0.25), 0.5, f"(({_inner[0]}) - 0.25) / 2", f"({_inner[1]}) / 2")
_prox("affine", lambda s, x: prox.affine(prox.soft(0.2), prox.scaled(x, 0.5)), 0.5, *_shrunk("re - 0.5 * (re * 0.5)", "im - 0.5 * (im * 0.5)", "0.1"))
_prox("l2_regularised", lambda s, x: prox.l2_regularised(prox.soft(0.2), 2.0, prox.scaled(x, 0.5)), 0.5, *_shrunk("re / 2 + (re * 0.5) / 2", "im / 2 + (im * 0.5) / 2", "(0.2 * 0.25)"))


@C.query(
    f"""WITH {_X}, f AS (SELECT unnest(range(32)) AS k), c AS (SELECT vec_id, k, sum(re * w) AS re, sum(im * w) AS im FROM
      (SELECT vec_id, k, re, im, (CASE WHEN k = 0 THEN sqrt(1.0 / 32) ELSE sqrt(2.0 / 32) END) * cos((2 * i + 1) * k * ({PI} / 64)) AS w FROM x, f) GROUP BY vec_id, k),
    t AS (SELECT vec_id, k, {_shrunk('re', 'im', '0.1')[0]} AS re, {_shrunk('re', 'im', '0.1')[1]} AS im FROM c), o AS (SELECT unnest(range(32)) AS i),
    b AS (SELECT vec_id, i, re, im, (CASE WHEN k = 0 THEN sqrt(1.0 / 32) ELSE sqrt(2.0 / 32) END) * cos((2 * i + 1) * k * ({PI} / 64)) AS w FROM t, o)
    SELECT vec_id, CAST(i AS INTEGER) AS i, {rnd('sum(re * w)')} AS re, {rnd('sum(im * w)')} AS im FROM b GROUP BY vec_id, i"""
)
def prox_l1_dct(spark, sf_dir):
    p = prox.l1_dct(transforms.dct(spark, 32), 0.2)
    return rounded(p(_x(spark, sf_dir), 0.5), "vec_id", "i", re=F.col("re"), im=F.col("im"))


# solvers: A is the vectors' Gram matrix plus the identity, b the mean vector
_AB = """e AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
 gram AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2),
 a AS MATERIALIZED (SELECT i, j, v + CASE WHEN i = j THEN 1 ELSE 0 END AS v FROM gram), b AS MATERIALIZED (SELECT i, sum(v) AS v FROM e GROUP BY i)"""


def _system(spark, sf_dir) -> tuple[linop.Linop, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    m = linop.gram(vectors).select("row", "col", (F.col("v") + F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0)).alias("mre"), F.lit(0.0).alias("mim"))
    b = vectors.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("double")).alias("re")).withColumn("im", F.lit(0.0))
    return linop.matrix(solvers.checkpointed(m)), solvers.checkpointed(b)


def _vector(x: DataFrame, factor: float = 1e3) -> DataFrame:
    return rounded(x, "i", digits=3, v=F.col("re") * factor)


def _power_sql(rounds: int) -> str:
    ctes = ["x0 AS (SELECT i, 1 / sqrt(64) AS v FROM b)"]
    for k in range(rounds):
        ctes.append(f"y{k} AS MATERIALIZED (SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x{k} x ON a.j = x.i GROUP BY a.i)")
        ctes.append(f"x{k + 1} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM y{k}) AS v FROM y{k})")
    return f"WITH {_AB}, {', '.join(ctes)} SELECT {rnd('sqrt(sum(v * v))', 3)} AS norm FROM y{rounds - 1}"


@C.query(_power_sql(5))
def power_iteration(spark, sf_dir):
    a, b = _system(spark, sf_dir)
    size, _ = solvers.power_iteration(a, b.withColumn("re", F.lit(1.0)), 5)
    return rounded(spark.createDataFrame([(size,)], "n double"), digits=3, norm=F.col("n"))


def _cg_sql(rounds: int) -> str:
    ctes = ["s0 AS (SELECT i, 0.0::DOUBLE AS x, v AS r, v AS p FROM b)"]
    for k in range(rounds):
        ctes += [
            f"m{k} AS MATERIALIZED (SELECT s.i, any_value(s.x) AS x, any_value(s.r) AS r, any_value(s.p) AS p, sum(a.v * t.p) AS ap FROM s{k} s JOIN a ON a.i = s.i JOIN s{k} t ON a.j = t.i GROUP BY s.i)",
            f"n{k} AS MATERIALIZED (SELECT i, x + al * p AS x, r - al * ap AS r, p, rr FROM m{k}, (SELECT sum(r * r) / sum(p * ap) AS al, sum(r * r) AS rr FROM m{k}))",
            f"s{k + 1} AS MATERIALIZED (SELECT i, x, r, r + (SELECT sum(r * r) FROM n{k}) / rr * p AS p FROM n{k})",
        ]
    return f"WITH {_AB}, {', '.join(ctes)} SELECT CAST(i AS INTEGER) AS i, {rnd('x * 1e3', 3)} AS v FROM s{rounds}"


@C.query(_cg_sql(4))
def conjugate_gradient(spark, sf_dir):
    a, b = _system(spark, sf_dir)
    return _vector(solvers.conjugate_gradient(a, b, prox.scaled(b, 0.0), 4))


def _gd_sql(rounds: int, step: float, accelerated: bool, lam: float) -> str:
    ctes, t = ["x0 AS (SELECT i, 0.0::DOUBLE AS v FROM b)", "z0 AS (SELECT * FROM x0)"], 1.0
    for k in range(rounds):
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2 if accelerated else 1.0
        pull = (t - 1) / t_next
        moved = f"z.v - {step!r} * (g.v - b.v)"
        ctes += [
            f"g{k} AS MATERIALIZED (SELECT a.i, sum(a.v * z.v) AS v FROM a JOIN z{k} z ON a.j = z.i GROUP BY a.i)",
            f"x{k + 1} AS MATERIALIZED (SELECT z.i, sign({moved}) * greatest(abs({moved}) - {lam * step!r}, 0) AS v FROM z{k} z JOIN g{k} g USING (i) JOIN b USING (i))",
            f"z{k + 1} AS MATERIALIZED (SELECT n.i, n.v * {1 + pull!r} - o.v * {pull!r} AS v FROM x{k + 1} n JOIN x{k} o USING (i))" if accelerated else f"z{k + 1} AS MATERIALIZED (SELECT * FROM x{k + 1})",
        ]
        t = t_next
    return f"WITH {_AB}, {', '.join(ctes)} SELECT CAST(i AS INTEGER) AS i, {rnd('v * 1e3', 3)} AS v FROM x{rounds}"


def _descent(spark, sf_dir, accelerated: bool) -> DataFrame:
    a, b = _system(spark, sf_dir)
    return _vector(solvers.gradient_descent(lambda z: prox.combine(a(z), b, 1.0, -1.0), prox.scaled(b, 0.0), 1e-3, 4, prox.soft(2.0), accelerated))


@C.query(_gd_sql(4, 1e-3, False, 2.0))
def gradient_descent(spark, sf_dir):
    return _descent(spark, sf_dir, False)


@C.query(_gd_sql(4, 1e-3, True, 2.0))
def fista(spark, sf_dir):
    return _descent(spark, sf_dir, True)


def _pdhg_sql(rounds: int, tau: float, sigma: float, lam: float) -> str:
    ctes = ["x0 AS (SELECT i, 0.0::DOUBLE AS v FROM b)", "y0 AS (SELECT * FROM x0)", "w0 AS (SELECT * FROM x0)"]
    for k in range(rounds):
        ctes += [
            f"y{k + 1} AS MATERIALIZED (SELECT y.i, least({lam!r}, greatest(-{lam!r}, any_value(y.v) + {sigma!r} * sum(a.v * w.v))) AS v FROM y{k} y JOIN a ON a.i = y.i JOIN w{k} w ON a.j = w.i GROUP BY y.i)",
            f"x{k + 1} AS MATERIALIZED (SELECT x.i, (any_value(x.v) - {tau!r} * sum(a.v * y.v) + {tau!r} * any_value(b.v)) / (1 + {tau!r}) AS v FROM x{k} x JOIN b USING (i) JOIN a ON a.i = x.i JOIN y{k + 1} y ON a.j = y.i GROUP BY x.i)",
            f"w{k + 1} AS MATERIALIZED (SELECT n.i, 2.0 * n.v - o.v AS v FROM x{k + 1} n JOIN x{k} o USING (i))",
        ]
    return f"WITH {_AB}, {', '.join(ctes)} SELECT CAST(i AS INTEGER) AS i, {rnd('v', 3)} AS v FROM x{rounds}"


@C.query(_pdhg_sql(3, 0.01, 0.01, 0.5))
def primal_dual(spark, sf_dir):
    """min 1/2 |x - b|^2 + 1/2 |A x|_1."""
    a, b = _system(spark, sf_dir)
    near = prox.l2_regularised(prox.zero, 1.0, b)
    x = solvers.primal_dual(a, near, prox.convex_conjugate(prox.soft(0.5)), prox.scaled(b, 0.0), prox.scaled(b, 0.0), 0.01, 0.01, 3)
    return _vector(x, 1.0)


def _admm_sql(rounds: int, rho: float, lam: float, inner: int) -> str:
    ctes = ["z0 AS (SELECT i, 0.0::DOUBLE AS v FROM b)", "u0 AS (SELECT * FROM z0)"]
    for k in range(rounds):
        ctes.append(f"s{k}_0 AS MATERIALIZED (SELECT i, 0.0::DOUBLE AS x, b.v + {rho!r} * (z.v - u.v) AS r, b.v + {rho!r} * (z.v - u.v) AS p FROM b JOIN z{k} z USING (i) JOIN u{k} u USING (i))")
        for n in range(inner):
            ctes += [
                f"m{k}_{n} AS MATERIALIZED (SELECT s.i, any_value(s.x) AS x, any_value(s.r) AS r, any_value(s.p) AS p, sum(a.v * t.p) + {rho!r} * any_value(s.p) AS ap FROM s{k}_{n} s JOIN a ON a.i = s.i JOIN s{k}_{n} t ON a.j = t.i GROUP BY s.i)",
                f"n{k}_{n} AS MATERIALIZED (SELECT i, x + al * p AS x, r - al * ap AS r, p, rr FROM m{k}_{n}, (SELECT sum(r * r) / sum(p * ap) AS al, sum(r * r) AS rr FROM m{k}_{n}))",
                f"s{k}_{n + 1} AS MATERIALIZED (SELECT i, x, r, r + (SELECT sum(r * r) FROM n{k}_{n}) / rr * p AS p FROM n{k}_{n})",
            ]
        x = f"s{k}_{inner}"
        ctes += [
            f"z{k + 1} AS MATERIALIZED (SELECT i, sign(x.x + u.v) * greatest(abs(x.x + u.v) - {lam / rho!r}, 0) AS v FROM {x} x JOIN u{k} u USING (i))",
            f"u{k + 1} AS MATERIALIZED (SELECT i, x.x + u.v - z.v AS v FROM {x} x JOIN u{k} u USING (i) JOIN z{k + 1} z USING (i))",
        ]
    return f"WITH {_AB}, {', '.join(ctes)} SELECT CAST(i AS INTEGER) AS i, {rnd('x * 1e3', 3)} AS v FROM s{rounds - 1}_{inner}"


@C.query(_admm_sql(2, 10.0, 0.5, 3))
def admm(spark, sf_dir):
    """min 1/2 <x, A x> - <b, x> + 1/2 |z|_1 with x = z; x by three steps of conjugate gradients."""
    a, b = _system(spark, sf_dir)
    start, op = prox.scaled(b, 0.0), linop.regularised(a, 10.0)
    x = solvers.admm(lambda v: solvers.conjugate_gradient(op, prox.combine(b, v, 1.0, 10.0), start, 3), prox.soft(0.5), start, 10.0, 2)
    return _vector(x)


@C.query(
    """WITH e AS (SELECT label, vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    m AS MATERIALIZED (SELECT a.label, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN 1 ELSE 0 END AS v FROM e a JOIN e b USING (label, vec_id) GROUP BY 1, 2, 3),
    s0 AS MATERIALIZED (SELECT label, i, 0.0::DOUBLE AS x, sum(v) AS r, sum(v) AS p FROM e GROUP BY 1, 2),
    """
    + ", ".join(
        f"""m{k} AS MATERIALIZED (SELECT s.label, s.i, any_value(s.x) AS x, any_value(s.r) AS r, any_value(s.p) AS p, sum(m.v * t.p) AS ap FROM s{k} s JOIN m ON m.label = s.label AND m.i = s.i JOIN s{k} t ON t.label = m.label AND t.i = m.j GROUP BY 1, 2),
    n{k} AS MATERIALIZED (SELECT label, i, x + al * p AS x, r - al * ap AS r, p, rr FROM m{k} JOIN (SELECT label, sum(r * r) / sum(p * ap) AS al, sum(r * r) AS rr FROM m{k} GROUP BY 1) USING (label)),
    s{k + 1} AS MATERIALIZED (SELECT label, i, x, r, r + q / rr * p AS p FROM n{k} JOIN (SELECT label, sum(r * r) AS q FROM n{k} GROUP BY 1) USING (label))"""
        for k in range(3)
    )
    + f" SELECT label, CAST(i AS INTEGER) AS i, {rnd('x')} AS x FROM s3"
)
def batched_conjugate_gradient(spark, sf_dir):
    """A system of 64 unknowns for each label."""
    m, b = _label_systems(spark, sf_dir)
    return rounded(solvers.batched_conjugate_gradient(m, b, "label", 3), "label", "i", x=F.col("x"))


def _label_systems(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(label, row, col, v), the Gram matrix of each label's vectors plus the identity, and (label, i, b), their sum."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").alias("e"))
    pairs = e.select("label", F.posexplode("e").alias("row", "v"), "e").select("label", "row", "v", F.posexplode("e").alias("col", "w"))
    one = F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0)
    m = pairs.groupBy("label", "row", "col").agg(F.sum(F.col("v").cast("double") * F.col("w").cast("double")).alias("v")).withColumn("v", F.col("v") + one)
    return m, e.select("label", F.posexplode("e").alias("i", "v")).groupBy("label", "i").agg(F.sum(F.col("v").cast("double")).alias("b"))


def _consensus_sql(rounds: int, inner: int, rho: float) -> str:
    ctes = [
        "e AS (SELECT label, vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
        "a AS MATERIALIZED (SELECT a.label, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN 1 ELSE 0 END AS v FROM e a JOIN e b USING (label, vec_id) GROUP BY 1, 2, 3)",
        "t0 AS MATERIALIZED (SELECT label, i, sum(v) AS b, 0.0::DOUBLE AS x, 0.0::DOUBLE AS z, 0.0::DOUBLE AS u, 0.0::DOUBLE AS y, 0.0::DOUBLE AS w FROM e GROUP BY 1, 2)",
    ]
    for k in range(rounds):
        ctes.append(f"g{k} AS MATERIALIZED (SELECT t.label, t.i, any_value(t.b + {rho!r} * (t.z - t.u + 0.5 * (t.y - t.w)) - {1.25 * rho!r} * t.x) - sum(a.v * o.x) AS r, any_value(t.x) AS x FROM t{k} t JOIN a ON a.label = t.label AND a.i = t.i JOIN t{k} o ON o.label = a.label AND o.i = a.j GROUP BY 1, 2)")
        ctes.append(f"s{k}_0 AS (SELECT label, i, x, r, r AS p FROM g{k})")
        for n in range(inner):
            ctes += [
                f"m{k}_{n} AS MATERIALIZED (SELECT s.label, s.i, any_value(s.x) AS x, any_value(s.r) AS r, any_value(s.p) AS p, sum(a.v * o.p) + {1.25 * rho!r} * any_value(s.p) AS ap FROM s{k}_{n} s JOIN a ON a.label = s.label AND a.i = s.i JOIN s{k}_{n} o ON o.label = a.label AND o.i = a.j GROUP BY 1, 2)",
                f"n{k}_{n} AS MATERIALIZED (SELECT label, i, x + al * p AS x, r - al * ap AS r, p, rr FROM m{k}_{n} JOIN (SELECT label, sum(r * r) / sum(p * ap) AS al, sum(r * r) AS rr FROM m{k}_{n} GROUP BY 1) USING (label))",
                f"s{k}_{n + 1} AS MATERIALIZED (SELECT label, i, x, r, r + q / rr * p AS p FROM n{k}_{n} JOIN (SELECT label, sum(r * r) AS q FROM n{k}_{n} GROUP BY 1) USING (label))",
            ]
        ctes += [
            f"v{k} AS MATERIALIZED (SELECT label, i, t.b, s.x, s.x + t.u AS c, 0.5 * s.x + t.w AS d FROM s{k}_{inner} s JOIN t{k} t USING (label, i))",
            f"f{k} AS MATERIALIZED (SELECT *, sign(c) * greatest(abs(c) - {0.5 / rho!r}, 0) AS z, d / (1 + 1 / {rho!r}) AS y FROM v{k})",
            f"t{k + 1} AS MATERIALIZED (SELECT label, i, b, x, z, c - z AS u, y, d - y AS w FROM f{k})",
        ]
    return f"WITH {', '.join(ctes)} SELECT label, CAST(i AS INTEGER) AS i, {rnd('x * 1e2')} AS x FROM t{rounds}"


@C.query(_consensus_sql(2, 2, 10.0))
def consensus(spark, sf_dir):
    """Of each label's system: 1/2 <x, A x> - <b, x> + 1/2 |x|_1 + 1/2 |x / 2|^2, with a copy and a dual for each of the two terms."""
    m, b = _label_systems(spark, sf_dir)
    m = solvers.checkpointed(m)

    def a(x: DataFrame) -> DataFrame:
        return m.join(x.withColumnRenamed("i", "col"), ["label", "col"]).groupBy("label", F.col("row").alias("i")).agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in ("re", "im")])

    right = solvers.checkpointed(b.select("label", "i", F.col("b").alias("re"), F.lit(0.0).alias("im")))
    terms = [solvers.Term(prox.soft(0.5)), solvers.Term(prox.l2_regularised(prox.zero, 1.0), linop.scale(0.5))]
    return rounded(solvers.consensus(a, right, terms, ["label"], 10.0, 2, 2), "label", "i", x=F.col("re") * 100)


# blocks: each vector is a frame of a 4 x 8 image
def _frames(spark, sf_dir) -> DataFrame:
    t = complex_vectors(spark, sf_dir).df
    return t.select(F.col("vec_id").alias("frame"), F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), "re", "im")


def _cube(spark, sf_dir) -> DataFrame:
    """The first frames: for the tests of the operators, not for the queries."""
    return _frames(spark, sf_dir).where("frame < 40")


def _svt(spark, sf_dir, amount: float, soft: bool) -> DataFrame:
    cube = blocks.svt(_frames(spark, sf_dir), ("y", "x"), ["frame"], (5, 9), size=4, stride=4, rounds=1, amount=amount, soft=soft, tall=True)
    return rounded(cube, "frame", "y", "x", re=F.col("re"), im=F.col("im"))


@C.query()
def svt_soft_blocks(spark, sf_dir):
    """Tested against numpy."""
    return _svt(spark, sf_dir, 0.1, True)


@C.query()
def svt_hard_blocks(spark, sf_dir):
    """Tested against numpy."""
    return _svt(spark, sf_dir, 2.0, False)


@C.query()
def svt_shifted_passes(spark, sf_dir):
    """Four passes, the later ones shifted, over all frames; tested against numpy."""
    cube = blocks.svt(_frames(spark, sf_dir), ("y", "x"), ["frame"], (5, 9), size=2, stride=2, rounds=4, amount=0.1, seed=5, tall=True)
    return rounded(cube, "frame", "y", "x", re=F.col("re"), im=F.col("im"))


@C.query()
def svt_random_blocks(spark, sf_dir):
    """Random blocks that overlap, each on what the earlier ones have left; tested against the sequential loop in numpy."""
    corners = blocks.random_corners(spark, 10, 3, ("y", "x"), (4, 8), seed=3)
    return rounded(blocks.svt_at(_frames(spark, sf_dir), ("y", "x"), ["frame"], corners, 3, 0.1, tall=True), "frame", "y", "x", re=F.col("re"), im=F.col("im"))


@C.query()
def svd_order_stats(spark, sf_dir):
    """Each label's vectors as a matrix; tested against numpy."""
    cube = complex_vectors(spark, sf_dir).df
    s = blocks.order_statistics(blocks.singular_values(cube, "label", ["vec_id"]))
    return rounded(s, "rank", least=F.col("least"), median=F.col("median"), largest=F.col("largest"), mean=F.col("mean"))
