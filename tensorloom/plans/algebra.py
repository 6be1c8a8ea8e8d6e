"""Queries of element-wise algebra, selections, reductions and order."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cplx import Cplx, cis, cplx
from tensorloom.operators import ordering, reductions, reshape, selection
from tensorloom.operators.tensor import Tensor
from tensorloom.plans.shared import CENT, ENT, PI, SAMPLES, Catalogue, complex_vectors, rnd, rounded, samples, signal, table, vectors

C = Catalogue()


def _next(t: Tensor) -> Tensor:
    """The same tree with each child's number less by one: zipping pairs every vector with the one after it."""
    return replace(t, df=t.df.withColumn("vec_id", F.col("vec_id") - 1))


def _zipped(name: str, op, sql: str) -> None:
    def query(spark, sf_dir) -> DataFrame:
        t = vectors(spark, sf_dir)
        return rounded(op(t, _next(t)).df, "vec_id", "i", v=F.col("re"))

    C.add(f"vec_{name}", query, f"WITH {ENT} SELECT a.vec_id, a.i, {rnd(sql)} AS v FROM ent a JOIN ent b ON b.vec_id = a.vec_id + 1 AND a.i = b.i")


_zipped("add", lambda a, b: a + b, "a.re + b.re")
_zipped("sub", lambda a, b: a - b, "a.re - b.re")
_zipped("mul", lambda a, b: a * b, "a.re * b.re")
_zipped("div", lambda a, b: a / b, "a.re / nullif(b.re, 0)")
_zipped("pow_zip", lambda a, b: a.abs().zip(b, lambda x, y: Cplx(F.pow(x.re, y.re), y.im)), "pow(abs(a.re), b.re)")


@C.query(f"WITH {ENT}, leaf AS (SELECT i, avg(re) AS m FROM ent GROUP BY i) SELECT vec_id, i, {rnd('re + m')} AS v FROM ent JOIN leaf USING (i)")
def vec_broadcast_leaf(spark, sf_dir):
    t = vectors(spark, sf_dir)
    leaf = Tensor(t.df.groupBy("i").agg(F.avg("re").alias("re")), ("i",))
    return rounded((t + leaf).df, "vec_id", "i", v=F.col("re"))


def _mapped(name: str, op, sql: str) -> None:
    C.add(f"vec_{name}", lambda spark, sf_dir: rounded(op(vectors(spark, sf_dir)).df, "vec_id", "i", v=F.col("re")), f"WITH {ENT} SELECT vec_id, i, {rnd(sql)} AS v FROM ent")


_mapped("scale", lambda t: t.scale(2.5), "re * 2.5")
_mapped("neg", lambda t: t.neg(), "-re")
_mapped("pow", lambda t: t.pow(3), "pow(re, 3)")
_mapped("abs", lambda t: t.abs(), "abs(re)")
_mapped("reciprocal", lambda t: t.map(lambda v: F.round(v, 1)).reciprocal(), "1 / CASE WHEN round(re, 1) = 0 THEN 1 ELSE round(re, 1) END")
_mapped("sanitize", lambda t: t.map(lambda v: F.when(v > 1, F.lit(float("inf"))).when(v < -1, F.lit(float("nan"))).otherwise(v)).sanitize(), "CASE WHEN abs(re) > 1 THEN 0 ELSE re END")


@C.query(f"WITH {CENT} SELECT vec_id, i, {rnd('sqrt(re * re + im * im)')} AS magnitude, {rnd('atan2(im, re)')} AS angle, {rnd('re')} AS re, {rnd('-im')} AS im_conj FROM cent")
def complex_parts(spark, sf_dir):
    t = complex_vectors(spark, sf_dir)
    z = t.complex()
    return rounded(t.df, "vec_id", "i", magnitude=z.abs(), angle=z.angle(), re=z.re, im_conj=z.conj().im)


@C.query(
    f"""WITH {CENT} SELECT a.vec_id, a.i, {rnd('a.re * b.re + a.im * b.im')} AS re, {rnd('a.re * b.im - a.im * b.re')} AS im
    FROM cent a JOIN cent b ON b.vec_id = a.vec_id + 1 AND a.i = b.i"""
)
def complex_conj_mul(spark, sf_dir):
    t = complex_vectors(spark, sf_dir)
    return rounded((t.conj() * _next(t)).df, "vec_id", "i", re=F.col("re"), im=F.col("im"))


@C.query(
    f"""WITH {CENT} SELECT a.vec_id, a.i, {rnd('(a.re * b.re + a.im * b.im) / nullif(b.re * b.re + b.im * b.im, 0)', 3)} AS re,
    {rnd('(a.im * b.re - a.re * b.im) / nullif(b.re * b.re + b.im * b.im, 0)', 3)} AS im
    FROM cent a JOIN cent b ON b.vec_id = a.vec_id + 1 AND a.i = b.i"""
)
def complex_div(spark, sf_dir):
    t = complex_vectors(spark, sf_dir)
    return rounded((t / _next(t)).df, "vec_id", "i", digits=3, re=F.col("re"), im=F.col("im"))


@C.query(
    f"""WITH {SAMPLES}, moved AS (SELECT s, re, im, 1.5 * kx - 0.5 * ky + 2 * kz AS a FROM samples)
    SELECT s, {rnd('re * cos(a) - im * sin(a)')} AS re, {rnd('re * sin(a) + im * cos(a)')} AS im FROM moved"""
)
def phase_translate(spark, sf_dir):
    z = cplx() * cis(1.5 * F.col("kx") - 0.5 * F.col("ky") + 2 * F.col("kz"))
    return rounded(samples(spark, sf_dir), "s", re=z.re, im=z.im)


@C.query(
    f"""WITH v AS (SELECT l_orderkey * 8 + l_linenumber AS s, l_extendedprice / 1000 AS mag, l_discount * 10 AS vx, l_tax * 10 AS vy, l_quantity / 50 AS vz FROM lineitem),
    e(enc, ex, ey, ez) AS (VALUES (0, 0, 0, 0), (1, -1, -1, -1), (2, 1, 1, -1), (3, 1, -1, 1), (4, -1, 1, 1)),
    a AS (SELECT s, enc, mag, (ex * vx + ey * vy + ez * vz) * ({PI} / (3.0 * sqrt(3.0))) AS p FROM v, e)
    SELECT s, enc, {rnd('mag * cos(p)', 6)} AS re, {rnd('mag * sin(p)', 6)} AS im FROM a"""
)
def velocity_encode(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    v = li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("s"),
        (F.col("l_extendedprice") / 1000).alias("mag"),
        (F.col("l_discount") * 10).alias("vx"),
        (F.col("l_tax") * 10).alias("vy"),
        (F.col("l_quantity") / 50).alias("vz"),
    )
    from tensorloom.operators.velocity import encode

    return rounded(encode(v, 3.0, "s"), "s", "enc", digits=6, re=F.col("re"), im=F.col("im"))


@C.query(
    f"""SELECT l_orderkey * 8 + l_linenumber AS s,
    {rnd(f'l_extendedprice / 1000 * sin({PI} * least(sqrt(pow(l_discount * 10, 2) + pow(l_tax * 10, 2) + pow(l_quantity / 50, 2)), 0.75) / 1.5)', 6)} AS v FROM lineitem"""
)
def complex_difference(spark, sf_dir):
    from tensorloom.operators.velocity import complex_difference as difference

    li = table(spark, sf_dir, "lineitem")
    v = difference(F.col("l_extendedprice") / 1000, (F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50), 1.5)
    return rounded(li.withColumn("s", F.col("l_orderkey") * 8 + F.col("l_linenumber")), "s", digits=6, v=v)


# selections
@C.query(
    f"""WITH {SAMPLES} SELECT s, {rnd(f'greatest(-0.99999 * {PI}, least(0.99999 * {PI}, kx * 1.2 * (0.9 * {PI} / 1.6)))')} AS kx,
    {rnd(f'greatest(-0.99999 * {PI}, least(0.99999 * {PI}, ky * 1.2 * (0.9 * {PI} / 2.0)))')} AS ky,
    {rnd(f'greatest(-0.99999 * {PI}, least(0.99999 * {PI}, kz * 1.2 * (0.9 * {PI} / 2.4)))')} AS kz, {rnd('re', 6)} AS re
    FROM samples WHERE abs(kx * 1.2) < 1.6 AND abs(ky * 1.2) < 2.0 AND abs(kz * 1.2) < 2.4"""
)
def crop_samples(spark, sf_dir):
    kept = selection.crop_samples(samples(spark, sf_dir), (4.0, 5.0, 6.0), crop=0.8, pre=1.2, post=0.9)
    return rounded(rounded(kept, "s", "re", kx=F.col("kx"), ky=F.col("ky"), kz=F.col("kz")), "s", "kx", "ky", "kz", digits=6, re=F.col("re"))


@C.query(
    f"""WITH {SAMPLES} SELECT batch, count(*) AS n, {rnd('sum(re)', 2)} AS re FROM samples
    WHERE abs(kx * (16 / (2 * {PI}))) < 3 AND abs(ky * (16 / (2 * {PI}))) < 3 AND abs(kz * (16 / (2 * {PI}))) < 3 GROUP BY batch"""
)
def center_weights(spark, sf_dir):
    kept = selection.center_weights(samples(spark, sf_dir), (16.0, 16.0, 16.0), 3.0)
    return rounded(kept.groupBy("batch").agg(F.count("*").alias("n"), F.sum("re").alias("re")), "batch", "n", digits=2, re=F.col("re"))


@C.query(f"WITH {ENT} SELECT vec_id, i, {rnd('re')} AS v FROM ent WHERE i >= 10 AND i < 20 AND vec_id >= 100 AND vec_id < 200")
def box_crop(spark, sf_dir):
    return rounded(selection.box(vectors(spark, sf_dir), i=(10, 20), vec_id=(100, 200)).df, "vec_id", "i", v=F.col("re"))


@C.query(
    f"""WITH {ENT}, r AS (SELECT *, sqrt(pow(i // 8 - 3.5, 2) + pow(i % 8 - 3.5, 2)) AS r FROM ent)
    SELECT vec_id, i, {rnd('re * CASE WHEN r > 2.0 THEN exp(-pow(1.5 * (r - 2.0) / 2.0, 2)) ELSE 1.0 END')} AS v FROM r"""
)
def radius_decay_mask(spark, sf_dir):
    r = F.sqrt(F.pow(F.floor(F.col("i") / 8) - 3.5, 2) + F.pow(F.col("i") % 8 - 3.5, 2))
    return rounded(vectors(spark, sf_dir).df, "vec_id", "i", v=F.col("re") * selection.radius_decay(r, 2.0, 1.5))


@C.query(f"WITH {ENT} SELECT vec_id, i, {rnd('re')} AS v FROM ent WHERE label IN (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey > 1)")
def coil_subset(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").where("n_regionkey > 1").select(F.col("n_regionkey").alias("label"))
    return rounded(selection.subset(vectors(spark, sf_dir).df, wanted, "label"), "vec_id", "i", v=F.col("re"))


@C.query("SELECT c_custkey, c_mktsegment FROM customer WHERE ((c_custkey + 5) * 2654435761 % 4294967296) / 4294967296.0 < 0.25")
def bernoulli_mask(spark, sf_dir):
    return selection.bernoulli(table(spark, sf_dir, "customer"), "c_custkey", 0.25, seed=5).select("c_custkey", "c_mktsegment")


@C.query(
    """WITH b AS (SELECT c_nationkey AS x, c_custkey % 7 AS y, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, CAST(CASE WHEN a.x = b.x AND a.y = b.y THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS BIGINT) AS pairs
    FROM b a JOIN b ON (a.x, a.y) <= (b.x, b.y) AND abs(a.x - b.x) < 3 AND abs(a.y - b.y) < 3"""
)
def blocks_overlap(spark, sf_dir):
    """How many pairs of customers' blocks share a cell, for each pair of places."""
    at = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("x"), (F.col("c_custkey") % 7).alias("y"))
    return selection.overlapping_blocks(at, ("x", "y"), 3)


# reductions over trees: the children are the line items of a return flag
def _tree(spark, sf_dir) -> Tensor:
    li = table(spark, sf_dir, "lineitem")
    return Tensor(li.select("l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i"), F.col("l_extendedprice").alias("re")), ("i",), "l_returnflag")


@C.query(f"SELECT {rnd('sum(l_extendedprice)', 1)} AS total FROM lineitem")
def tree_sum(spark, sf_dir):
    return rounded(_tree(spark, sf_dir).sum(), digits=1, total=F.col("re"))


@C.query(f"SELECT {rnd('avg(m)', 3)} AS mean FROM (SELECT avg(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag)")
def tree_mean(spark, sf_dir):
    return rounded(_tree(spark, sf_dir).mean(), digits=3, mean=F.col("re"))


@C.query(f"SELECT {rnd('avg(m)', 3)} AS mean_median FROM (SELECT quantile_disc(l_extendedprice, 0.5) AS m FROM lineitem GROUP BY l_returnflag)")
def tree_mean_median(spark, sf_dir):
    return rounded(_tree(spark, sf_dir).mean_median(), digits=3, mean_median=F.col("re"))


@C.query("SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem")
def tree_extremes(spark, sf_dir):
    return _tree(spark, sf_dir).extremes()


@C.query("SELECT count(*) AS n FROM lineitem")
def tree_numel(spark, sf_dir):
    return _tree(spark, sf_dir).numel()


@C.query(f"WITH {CENT} SELECT {rnd('sum(n)')} AS norm FROM (SELECT sqrt(sum(re * re + im * im)) AS n FROM cent GROUP BY vec_id)")
def tree_norm(spark, sf_dir):
    return rounded(complex_vectors(spark, sf_dir).norm(), norm=F.col("norm"))


@C.query(
    f"""WITH {CENT} SELECT {rnd('sum(a.re * b.re + a.im * b.im)', 3)} AS re, {rnd('sum(a.re * b.im - a.im * b.re)', 3)} AS im
    FROM cent a JOIN cent b ON b.vec_id = a.vec_id + 1 AND a.i = b.i"""
)
def tree_vdot(spark, sf_dir):
    t = complex_vectors(spark, sf_dir)
    return rounded(t.vdot(_next(t)), digits=3, re=F.col("re"), im=F.col("im"))


@C.query(
    f"""WITH {ENT} SELECT {rnd('sqrt(sum(pow(a.re - b.re, 2))) / nullif(sqrt(sum(b.re * b.re)), 0)')} AS relative_error
    FROM ent a JOIN ent b ON b.vec_id = a.vec_id + 1 AND a.i = b.i"""
)
def relative_error(spark, sf_dir):
    t = vectors(spark, sf_dir)
    return rounded(t.relative_error(_next(t)), relative_error=F.col("relative_error"))


@C.query(f"WITH {ENT} SELECT i, {rnd('sum(re)', 3)} AS v FROM ent GROUP BY i")
def coil_sum(spark, sf_dir):
    return rounded(reshape.sum_axes(vectors(spark, sf_dir).df, ["i"], "re"), "i", digits=3, v=F.col("re"))


_COILS = f"""{CENT}, maps AS (SELECT label, i, avg(re) AS sre, avg(im) AS sim FROM cent GROUP BY label, i),
 images AS (SELECT label, i, sum(re) AS re, sum(im) AS im FROM cent GROUP BY label, i)"""


def _coils(spark, sf_dir) -> DataFrame:
    t = complex_vectors(spark, sf_dir).df
    return t.groupBy("label", "i").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.avg("re").alias("sre"), F.avg("im").alias("sim"))


@C.query(f"WITH {_COILS} SELECT i, {rnd('sum(sre * re + sim * im)', 3)} AS re, {rnd('sum(sre * im - sim * re)', 3)} AS im FROM images JOIN maps USING (label, i) GROUP BY i")
def coil_combine(spark, sf_dir):
    return rounded(reductions.coil_combine(_coils(spark, sf_dir), "i"), "i", digits=3, re=F.col("re"), im=F.col("im"))


@C.query(
    f"""WITH {_COILS} SELECT i, {rnd('sum(sre * re + sim * im) / nullif(sum(sre * sre + sim * sim), 0)', 2)} AS re,
    {rnd('sum(sre * im - sim * re) / nullif(sum(sre * sre + sim * sim), 0)', 2)} AS im FROM images JOIN maps USING (label, i) GROUP BY i"""
)
def coil_combine_normalised(spark, sf_dir):
    return rounded(reductions.coil_combine(_coils(spark, sf_dir), "i", normalised=True), "i", digits=2, re=F.col("re"), im=F.col("im"))


@C.query(f"WITH {CENT}, r AS (SELECT i, sqrt(sum(re * re + im * im)) AS r FROM cent GROUP BY i) SELECT i, {rnd('r + 1e-5 * (SELECT max(r) FROM r)')} AS rss FROM r")
def rss_floor(spark, sf_dir):
    return rounded(reductions.rss(complex_vectors(spark, sf_dir).df, "i", floor=1e-5), "i", rss=F.col("rss"))


@C.query("SELECT (event_id // 256) AS segment, round(sum(value), 2) + 0.0 AS total FROM events GROUP BY 1")
def segmented_sum(spark, sf_dir):
    return rounded(reductions.segmented_sum(signal(spark, sf_dir), "event_id", "value", 256), "segment", digits=2, total=F.col("value"))


@C.query(
    """SELECT user_id, value AS objective, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events) WHERE r = 1"""
)
def best_of(spark, sf_dir):
    return ordering.best_of(signal(spark, sf_dir).withColumnRenamed("value", "objective"), "user_id", "objective", "event_id")


@C.query(f"WITH {ENT} SELECT label, i, {rnd('max(re)')} AS v FROM ent GROUP BY label, i")
def max_projection(spark, sf_dir):
    return rounded(reshape.max_projection(vectors(spark, sf_dir).df, ["label", "i"], "re"), "label", "i", v=F.col("re"))


@C.query(f"WITH {ENT}, m AS (SELECT avg(abs(re)) AS m FROM ent) SELECT vec_id, i, {rnd('re / nullif((SELECT m FROM m), 0)')} AS v FROM ent")
def normalise_by_mean(spark, sf_dir):
    return rounded(reductions.normalise(vectors(spark, sf_dir).df, "re"), "vec_id", "i", v=F.col("re"))


@C.query(f"WITH {CENT} SELECT i, {rnd('avg(sqrt(re * re + im * im))')} AS magnitude FROM cent GROUP BY i")
def mean_magnitude(spark, sf_dir):
    return rounded(reductions.mean_magnitude(complex_vectors(spark, sf_dir).df, "i"), "i", magnitude=F.col("magnitude"))


# order
_SORTED = "p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS position, l_extendedprice FROM lineitem)"


def _sorted(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return ordering.argsort(li, "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@C.query(f"WITH {_SORTED} SELECT position, l_orderkey, l_extendedprice FROM p")
def argsort_permutation(spark, sf_dir):
    return _sorted(spark, sf_dir).select("position", "l_orderkey", "l_extendedprice")


#: A permutation of the sorted places of the events: by the hash of the id.
_PERM = """p AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS position,
 row_number() OVER (ORDER BY (event_id + 3) * 2654435761 % 4294967296, event_id) - 1 AS source FROM events)"""


def _permutation(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ev = signal(spark, sf_dir).withColumn("h", selection.hash01(F.col("event_id"), 3))
    by_id = ordering.argsort(ev, "event_id")
    by_hash = ordering.argsort(ev.select("event_id", "h"), "h", "event_id", name="source")
    return by_id.select("position", "value"), by_id.select("event_id", "position").join(by_hash.select("event_id", "source"), "event_id").select("position", "source")


@C.query(f"WITH {_PERM} SELECT a.position, b.value FROM p a JOIN p b ON a.source = b.position")
def apply_permutation(spark, sf_dir):
    values, perm = _permutation(spark, sf_dir)
    return ordering.apply_permutation(values, perm).select("position", "value")


@C.query(f"WITH {_PERM} SELECT source AS position, position AS source FROM p")
def inverse_permutation(spark, sf_dir):
    return ordering.inverse_permutation(_permutation(spark, sf_dir)[1])


@C.query("SELECT c_custkey, c_acctbal FROM customer ORDER BY ((c_custkey + 11) * 2654435761 % 4294967296), c_custkey LIMIT 100")
def random_subset(spark, sf_dir):
    """A sampling operator: the limit is the feature."""
    return ordering.random_subset(table(spark, sf_dir, "customer"), "c_custkey", 100, seed=11).select("c_custkey", "c_acctbal")


@C.query(f"WITH {ENT} SELECT vec_id, i AS pivot, {rnd('abs(re)')} AS top FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(re) DESC, i) AS r FROM ent) WHERE r = 1")
def pivot_argmax(spark, sf_dir):
    return rounded(ordering.pivot_argmax(vectors(spark, sf_dir).df, "vec_id", "i", "re"), "vec_id", "pivot", top=F.col("top"))
