"""Queries of scalar expressions and their derivatives, fits, and text, array and map helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import dual, text
from tensorloom.operators import fitting, velocity
from tensorloom.plans.shared import Catalogue, rnd, rounded, signal, table
from tensorloom.streaming.gates import gate_stream

C = Catalogue()

# scalar functions: value and derivative side by side, u in (0.05, 0.95)
_U = "u AS (SELECT l_orderkey * 8 + l_linenumber AS s, l_partkey, l_suppkey, l_discount * 8 + 0.05 + l_tax AS u FROM lineitem)"


def _points(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("s"), "l_partkey", "l_suppkey", (F.col("l_discount") * 8 + 0.05 + F.col("l_tax")).alias("u"))


def _scalar(name: str, model, value: str, first: str) -> None:
    def query(spark, sf_dir) -> DataFrame:
        y = dual.over_columns(lambda u: model(u), ["u"], u=F.col("u"))
        return rounded(_points(spark, sf_dir), "s", "l_partkey", "l_suppkey", digits=6, v=y.value, d=y.d.get("u") if y.d.get("u") is not None else F.lit(0.0))

    C.add(f"expr_{name}", query, f"WITH {_U} SELECT s, l_partkey, l_suppkey, {rnd(value, 6)} AS v, {rnd(first, 6)} AS d FROM u")


_scalar("neg", lambda u: -u, "-u", "-1.0::DOUBLE")
_scalar("arithmetic", lambda u: (2 * u + 3) * (u - 1) / (u + 4), "(2 * u + 3) * (u - 1) / (u + 4)", "((4 * u + 1) * (u + 4) - (2 * u + 3) * (u - 1)) / pow(u + 4, 2)")
_scalar("pow", lambda u: u**2.5, "pow(u, 2.5)", "2.5 * pow(u, 1.5)")
_scalar("pow_variable", lambda u: u**u, "pow(u, u)", "pow(u, u) * (ln(u) + 1)")
_scalar("abs", lambda u: dual.abs_(u - 0.333), "abs(u - 0.333)", "CAST(sign(u - 0.333) AS DOUBLE)")
_scalar("sign", lambda u: dual.sign(u - 0.333), "CAST(sign(u - 0.333) AS DOUBLE)", "0.0::DOUBLE")
_scalar("sqrt", dual.sqrt, "sqrt(u)", "0.5 / sqrt(u)")
_scalar("square", lambda u: u * u, "u * u", "2 * u")
_scalar("exp", dual.exp, "exp(u)", "exp(u)")
_scalar("log", dual.log, "ln(u)", "1 / u")
_scalar("sin", dual.sin, "sin(u)", "cos(u)")
_scalar("cos", dual.cos, "cos(u)", "-sin(u)")
_scalar("tan", dual.tan, "tan(u)", "1 + pow(tan(u), 2)")
_scalar("asin", lambda u: dual.asin(u * 0.9), "asin(u * 0.9)", "0.9 / sqrt(1 - pow(u * 0.9, 2))")
_scalar("acos", lambda u: dual.acos(u * 0.9), "acos(u * 0.9)", "-0.9 / sqrt(1 - pow(u * 0.9, 2))")
_scalar("atan", dual.atan, "atan(u)", "1 / (1 + u * u)")
_scalar("sinh", dual.sinh, "sinh(u)", "cosh(u)")
_scalar("cosh", dual.cosh, "cosh(u)", "sinh(u)")
_scalar("tanh", dual.tanh, "tanh(u)", "1 - pow(tanh(u), 2)")
_scalar("asinh", dual.asinh, "asinh(u)", "1 / sqrt(1 + u * u)")
_scalar("acosh", lambda u: dual.acosh(u + 1.5), "acosh(u + 1.5)", "1 / sqrt(pow(u + 1.5, 2) - 1)")
_scalar("atanh", lambda u: dual.atanh(u * 0.9), "atanh(u * 0.9)", "0.9 / (1 - pow(u * 0.9, 2))")


# x sqrt(x^2 + y^2) + asinh(x y), with both first derivatives
@C.query(
    f"""WITH p AS (SELECT l_orderkey * 8 + l_linenumber AS s, l_partkey, l_suppkey, l_quantity / 10 AS x, l_discount * 10 + 0.1 AS y FROM lineitem)
    SELECT s, l_partkey, l_suppkey, {rnd('x * sqrt(x * x + y * y) + asinh(x * y)', 5)} AS v, {rnd('sqrt(x * x + y * y) + x * x / sqrt(x * x + y * y) + y / sqrt(1 + x * x * y * y)', 5)} AS dx,
    {rnd('x * y / sqrt(x * x + y * y) + x / sqrt(1 + x * x * y * y)', 5)} AS dy FROM p"""
)
def expr_gradient(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    f = dual.over_columns(lambda x, y: x * dual.sqrt(x * x + y * y) + dual.asinh(x * y), ["x", "y"], x=F.col("l_quantity") / 10, y=F.col("l_discount") * 10 + 0.1)
    rows = li.withColumn("s", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return rounded(rows, "s", "l_partkey", "l_suppkey", digits=5, v=f.value, dx=f.d["x"], dy=f.d["y"])


def biexponential(s0, f, d1, d2, b):
    return s0 * (f * dual.exp(-(b * d1)) + (1 - f) * dual.exp(-(b * d2)))


_B = "p AS (SELECT l_orderkey * 8 + l_linenumber AS s, l_partkey, l_suppkey, l_quantity AS s0, l_discount * 10 AS f, l_tax + 0.1 AS d1, l_linenumber / 10.0 AS d2, 2.0::DOUBLE AS b FROM lineitem)"
_HESSIAN = {
    "v": "s0 * (f * exp(-b * d1) + (1 - f) * exp(-b * d2))",
    "d_s0": "f * exp(-b * d1) + (1 - f) * exp(-b * d2)",
    "d_f": "s0 * (exp(-b * d1) - exp(-b * d2))",
    "d_d1": "-s0 * f * b * exp(-b * d1)",
    "d_d2": "-s0 * (1 - f) * b * exp(-b * d2)",
    "h_s0_f": "exp(-b * d1) - exp(-b * d2)",
    "h_s0_d1": "-f * b * exp(-b * d1)",
    "h_s0_d2": "-(1 - f) * b * exp(-b * d2)",
    "h_f_d1": "-s0 * b * exp(-b * d1)",
    "h_f_d2": "s0 * b * exp(-b * d2)",
    "h_d1_d1": "s0 * f * b * b * exp(-b * d1)",
    "h_d2_d2": "s0 * (1 - f) * b * b * exp(-b * d2)",
}


@C.query(f"WITH {_B} SELECT s, l_partkey, l_suppkey, {', '.join(f'{rnd(e, 5)} AS {n}' for n, e in _HESSIAN.items())} FROM p")
def expr_hessian(spark, sf_dir):
    """The two-exponential model: value, gradient, and the second derivatives that are not zero."""
    li = table(spark, sf_dir, "lineitem").withColumn("s", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    y = dual.over_columns(biexponential, ["s0", "f", "d1", "d2"], s0=F.col("l_quantity"), f=F.col("l_discount") * 10, d1=F.col("l_tax") + 0.1, d2=F.col("l_linenumber") / 10.0, b=F.lit(2.0))
    h = lambda a, b: y.h.get((a, b)) if y.h.get((a, b)) is not None else y.h[b, a]
    cols = {"v": y.value} | {f"d_{n}": y.d[n] for n in ("s0", "f", "d1", "d2")} | {n: h(*n[2:].split("_")) for n in _HESSIAN if n.startswith("h_")}
    return rounded(li, "s", "l_partkey", "l_suppkey", digits=5, **cols)


# fits
@C.query(f"SELECT l_suppkey, {rnd('regr_intercept(l_extendedprice, l_quantity)', 2)} AS c0, {rnd('regr_slope(l_extendedprice, l_quantity)', 2)} AS c1 FROM lineitem GROUP BY l_suppkey")
def polyfit_line(spark, sf_dir):
    c = fitting.polyfit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 1, "l_suppkey")
    return rounded(c, "l_suppkey", digits=2, c0=F.col("c0"), c1=F.col("c1"))


@C.query(
    f"""WITH p AS (SELECT l_linenumber AS g, l_quantity / 50 AS x, l_extendedprice / 1000 AS y FROM lineitem),
    s AS (SELECT g, count(*)::DOUBLE AS p0, sum(x) AS p1, sum(x ** 2) AS p2, sum(x ** 3) AS p3, sum(x ** 4) AS p4, sum(y) AS m0, sum(x * y) AS m1, sum(x * x * y) AS m2 FROM p GROUP BY g),
    d AS (SELECT *, p0 * (p2 * p4 - p3 * p3) - p1 * (p1 * p4 - p3 * p2) + p2 * (p1 * p3 - p2 * p2) AS det FROM s)
    SELECT g, {rnd('(m0 * (p2 * p4 - p3 * p3) - p1 * (m1 * p4 - p3 * m2) + p2 * (m1 * p3 - p2 * m2)) / det', 3)} AS c0,
    {rnd('(p0 * (m1 * p4 - p3 * m2) - m0 * (p1 * p4 - p3 * p2) + p2 * (p1 * m2 - m1 * p2)) / det', 3)} AS c1,
    {rnd('(p0 * (p2 * m2 - m1 * p3) - p1 * (p1 * m2 - m1 * p2) + m0 * (p1 * p3 - p2 * p2)) / det', 3)} AS c2 FROM d"""
)
def polyfit_quadratic(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("g"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(fitting.polyfit(li, "x", "y", 2, "g"), "g", digits=3, c0=F.col("c0"), c1=F.col("c1"), c2=F.col("c2"))


@C.query(
    f"""WITH p AS (SELECT p_partkey AS k, p_size + 10.0 AS a, (p_partkey % 7) / 2.0 AS b, (p_partkey % 5) / 3.0 AS c, sqrt(p_retailprice) AS y0, 1.0 AS y1, p_size / 10.0 AS y2 FROM part),
    d AS (SELECT *, a * (a * a - b * b) - b * (b * a - b * c) + c * (b * b - a * c) AS det FROM p)
    SELECT k, {rnd('(y0 * (a * a - b * b) - b * (y1 * a - b * y2) + c * (y1 * b - a * y2)) / det', 7)} AS x0,
    {rnd('(a * (y1 * a - b * y2) - y0 * (b * a - b * c) + c * (b * y2 - y1 * c)) / det', 7)} AS x1,
    {rnd('(a * (a * y2 - y1 * b) - b * (b * y2 - y1 * c) + y0 * (b * b - a * c)) / det', 7)} AS x2 FROM d"""
)
def ldl_solve(spark, sf_dir):
    """A symmetric system of three unknowns for each part."""
    k = F.col("k")
    a, b, c = F.col("p_size") + 10.0, (k % 7) / 2.0, (k % 5) / 3.0
    x = fitting.ldl_solve([[a], [b, a], [c, b, a]], [F.sqrt("p_retailprice"), F.lit(1.0), F.col("p_size") / 10.0])
    return rounded(table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k"), "k", digits=7, **{f"x{i}": v for i, v in enumerate(x)})


@C.query(
    f"""WITH m AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS p, embedding[5]::DOUBLE AS q, embedding[6]::DOUBLE AS r,
      embedding[7]::DOUBLE AS f, embedding[8]::DOUBLE AS g, embedding[9]::DOUBLE AS h FROM embeddings),
    w AS (SELECT *, greatest(abs(a), abs(b), abs(c)) AS top, greatest(abs(p), abs(q), abs(r)) AS off FROM m),
    v AS (SELECT *, greatest(top, off / sqrt(8.0), 1e-12) AS bound, 1e-12 * greatest(top + off, 1) AS least, CASE WHEN abs(a) = top THEN 0 WHEN abs(b) = top THEN 1 ELSE 2 END AS s FROM w),
    t AS (SELECT vec_id, bound, least, s, CASE s WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS a, CASE s WHEN 1 THEN a ELSE b END AS b, CASE s WHEN 2 THEN a ELSE c END AS c,
      CASE s WHEN 2 THEN r ELSE p END AS p, CASE s WHEN 1 THEN r ELSE q END AS q, CASE s WHEN 0 THEN r WHEN 1 THEN q ELSE p END AS r,
      CASE s WHEN 0 THEN f WHEN 1 THEN g ELSE h END AS f, CASE s WHEN 1 THEN f ELSE g END AS g, CASE s WHEN 2 THEN f ELSE h END AS h FROM v),
    d AS (SELECT *, greatest(abs(a), greatest(abs(p), abs(q)) ** 2 / bound, least) AS d1 FROM t),
    e AS (SELECT *, b - p * p / d1 AS b2, c - q * q / d1 AS c2, r - p * q / d1 AS r2 FROM d),
    u AS (SELECT *, abs(c2) > abs(b2) AS z FROM e),
    x AS (SELECT vec_id, bound, least, s, z, d1, CASE WHEN z THEN c2 ELSE b2 END AS b2, CASE WHEN z THEN b2 ELSE c2 END AS c2, r2, CASE WHEN z THEN q ELSE p END / d1 AS l21, CASE WHEN z THEN p ELSE q END / d1 AS l31,
      f, CASE WHEN z THEN h ELSE g END AS g, CASE WHEN z THEN g ELSE h END AS h FROM u),
    y AS (SELECT *, greatest(abs(b2), r2 * r2 / bound, least) AS d2 FROM x),
    n AS (SELECT *, r2 / d2 AS l32, greatest(abs(c2 - r2 * r2 / d2), least) AS d3 FROM y),
    k AS (SELECT *, (h - l31 * f - l32 * (g - l21 * f)) / d3 AS x3 FROM n),
    i AS (SELECT *, (g - l21 * f) / d2 - l32 * x3 AS x2 FROM k),
    j AS (SELECT vec_id, s, d1, d2, d3, f / d1 - l21 * x2 - l31 * x3 AS y1, CASE WHEN z THEN x3 ELSE x2 END AS y2, CASE WHEN z THEN x2 ELSE x3 END AS y3 FROM i)
    SELECT vec_id, {rnd('CASE s WHEN 0 THEN y1 WHEN 1 THEN y2 ELSE y3 END', 5)} AS x0, {rnd('CASE s WHEN 1 THEN y1 ELSE y2 END', 5)} AS x1, {rnd('CASE s WHEN 2 THEN y1 ELSE y3 END', 5)} AS x2,
    {rnd('d1', 5)} AS d0, {rnd('d2', 5)} AS d1, {rnd('d3', 5)} AS d2 FROM j"""
)
def modified_cholesky(spark, sf_dir):
    """Each vector's first numbers as a symmetric, mostly indefinite matrix of three and a right side, solved by the pivoted modified factor."""
    e = lambda i: F.col("embedding")[i].cast("double")
    places = [0, 3, 4, 3, 1, 5, 4, 5, 2]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*[e(i) for i in places]).alias("h"), F.array(*[e(i) for i in (6, 7, 8)]).alias("b"))
    solved = fitting.solve_rows(rows, "h", "b", "vec_id")
    return rounded(solved, "vec_id", digits=5, **{f"{n}{i}": F.col(n)[i] for n in ("x", "d") for i in range(3)})


def _decays(spark, sf_dir) -> DataFrame:
    """Signals of two exponentials with known parameters, one for each part."""
    p = table(spark, sf_dir, "part")
    b = [0.0, 0.2, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0]
    s0, f, d1, d2 = 1 + F.col("p_size") / 50, 0.3 + (F.col("p_partkey") % 5) / 20, 1.5 + (F.col("p_partkey") % 3) / 4, 0.1 + (F.col("p_partkey") % 4) / 40
    signal_at = lambda x: s0 * (f * F.exp(-x * d1) + (1 - f) * F.exp(-x * d2))
    return p.select("p_partkey", F.array(*[signal_at(F.lit(x)) for x in b]).alias("y"), F.array(*[F.lit(x) for x in b]).alias("b"), s0.alias("t_s0"), f.alias("t_f"), d1.alias("t_d1"), d2.alias("t_d2"))


_BOX = ({"s0": 1.0, "f": 0.5, "d1": 1.0, "d2": 0.2}, {"s0": 0.1, "f": 0.05, "d1": 0.6, "d2": 0.0}, {"s0": 5.0, "f": 0.95, "d1": 4.0, "d2": 0.5})


@C.query(
    f"""SELECT p_partkey, {rnd('1 + p_size / 50.0', 3)} AS s0, {rnd('0.3 + (p_partkey % 5) / 20.0', 3)} AS f, {rnd('1.5 + (p_partkey % 3) / 4.0', 3)} AS d1, {rnd('0.1 + (p_partkey % 4) / 40.0', 3)} AS d2 FROM part"""
)
def lm_fit(spark, sf_dir):
    """Damped Newton fits of all signals: the parameters they were made from come back."""
    start, low, high = _BOX
    found = fitting.fit(_decays(spark, sf_dir), biexponential, ["s0", "f", "d1", "d2"], "y", ["b"], start, low, high, "p_partkey", restarts=3)
    return rounded(found, "p_partkey", digits=3, **{n: F.col(n) for n in ("s0", "f", "d1", "d2")})


@C.query(
    f"""WITH g AS (SELECT * FROM (SELECT unnest([0.5, 1.0, 1.5]) AS a) x, (SELECT unnest([-1.0, 0.0, 2.0]) AS b) y)
    SELECT p_partkey, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, {rnd('pow(a - p_size / 50.0, 2) + b * b', 5)} AS objective FROM part, g"""
)
def objective_surface(spark, sf_dir):
    """A quadratic objective of each part at nine points of a grid."""
    out = fitting.objective_surface(table(spark, sf_dir, "part"), lambda a, b: (a - F.col("p_size") / 50.0) ** 2 + b * b, {"a": [0.5, 1.0, 1.5], "b": [-1.0, 0.0, 2.0]}, "p_partkey")
    return rounded(out, "p_partkey", "a", "b", digits=5, objective=F.col("objective"))


@C.query()
def random_search(spark, sf_dir):
    """The best of 64 draws for each signal; tested against the same draws in numpy."""
    _, low, high = _BOX

    def objective(s0, f, d1, d2):
        return F.aggregate(F.arrays_zip("b", "y"), F.lit(0.0), lambda a, z: a + F.pow(s0 * (f * F.exp(-z["b"] * d1) + (1 - f) * F.exp(-z["b"] * d2)) - z["y"], F.lit(2.0)))

    found = fitting.random_search(_decays(spark, sf_dir), objective, low, high, 64, "p_partkey", seed=7)
    return rounded(found, "p_partkey", **{n: F.col(n) for n in ("s0", "f", "d1", "d2", "objective")})


_V = "SELECT l_orderkey * 8 + l_linenumber AS s, min(l_extendedprice / 1000) AS mag, min(l_discount * 10 - 0.5) AS vx, min(l_tax * 10 - 0.4) AS vy, min(l_quantity / 50 - 0.5) AS vz FROM lineitem GROUP BY 1"


#: Line items of a task, on average: what a task holds of the grouped voxels and their encodes does not grow with the table.
VOXELS = 1 << 19


def _voxels(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("s"), "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // VOXELS))
    return li.repartition(parts, "s").groupBy("s").agg(F.min(F.col("l_extendedprice") / 1000).alias("mag"), F.min(F.col("l_discount") * 10 - 0.5).alias("vx"), F.min(F.col("l_tax") * 10 - 0.4).alias("vy"), F.min(F.col("l_quantity") / 50 - 0.5).alias("vz"))


_VOUT = f"SELECT s, {rnd('mag', 5)} AS mag, {rnd('vx', 5)} AS vx, {rnd('vy', 5)} AS vy, {rnd('vz', 5)} AS vz FROM ({_V})"


@C.query(_VOUT)
def velocity_decode_linear(spark, sf_dir):
    """Encoding and its linear decoding: the velocities come back."""
    out = velocity.decode_linear(velocity.encode(_voxels(spark, sf_dir), 3.0, "s"), 3.0, "s")
    return rounded(out, "s", digits=5, **{n: F.col(n) for n in ("mag", "vx", "vy", "vz")})


@C.query(_VOUT)
def velocity_decode_nonlinear(spark, sf_dir):
    out = velocity.decode_nonlinear(velocity.encode(_voxels(spark, sf_dir), 3.0, "s"), 3.0, "s")
    return rounded(out, "s", digits=5, **{n: F.col(n) for n in ("mag", "vx", "vy", "vz")})


# text, arrays, maps
def _text(name: str, make, sql: str, source: str = "documents", key: str = "doc_id") -> None:
    C.add(f"str_{name}", lambda spark, sf_dir: table(spark, sf_dir, source).select(key, make(F.col("text")).alias("v")), f"SELECT {key}, {sql} AS v FROM {source}")


_text("lower", F.lower, "lower(text)")
_text("no_white_space", text.without_white_space, "regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')")
_text("replace_all", lambda t: F.replace(t, F.lit("th"), F.lit("#")), "replace(text, 'th', '#')")
_text("remove_all", lambda t: F.replace(t, F.lit("th"), F.lit("")), "replace(text, 'th', '')")
_text("padded", lambda t: text.padded(t, 200), "CASE WHEN length(text) >= 200 THEN substr(text, 1, 200) ELSE rpad(text, 201, ' ') END")
_text("indented", lambda t: text.indented(t, ">> "), "replace(text, chr(10), chr(10) || '>> ')")
_text("md5_slice", lambda t: text.md5_slice(t, 8), "substr(md5(text), 2, 8)")
_text("repeated", lambda t: text.repeated(t, "-", 3), "text || repeat('-', 3)")


@C.query("SELECT doc_id, CAST(line AS INTEGER) AS line, lines[line] AS text FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))")
def str_numbered_lines(spark, sf_dir):
    return text.numbered_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@C.query("SELECT n_nationkey, 'nation ' || n_name || ' (' || n_nationkey || ') in region ' || n_regionkey AS v FROM nation")
def str_template(spark, sf_dir):
    values = {"name": F.col("n_name"), "key": F.col("n_nationkey"), "region": F.col("n_regionkey")}
    return table(spark, sf_dir, "nation").select("n_nationkey", text.rendered("nation {{name}} ({{key}}) in region {{region}}", values).alias("v"))


@C.query(
    f"""WITH d AS (SELECT o_orderkey, o_orderkey * 7919 AS n FROM orders),
    p AS (SELECT o_orderkey, {' || '.join(f"substr('{text.DIGITS}', CAST(n // {62**k} % 62 + 1 AS BIGINT), 1)" for k in range(9, -1, -1))} AS t FROM d)
    SELECT o_orderkey, CASE WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END AS v FROM p"""
)
def str_base62(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.base62(F.col("o_orderkey") * 7919).alias("v"))


@C.query(
    f"""SELECT vec_id, len(e || e[1:2]) AS n, list_contains(e, e[3]) AS held, {rnd('CAST(list_reverse(e)[1] AS DOUBLE)')} AS last,
    list_sum(list_transform(e, lambda x: CAST(trunc(x * 10) AS BIGINT)))::BIGINT AS cast_sum FROM (SELECT vec_id, embedding AS e FROM embeddings)"""
)
def array_helpers(spark, sf_dir):
    e = F.col("embedding")
    whole = F.aggregate(F.transform(e, lambda x: (x * 10).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.concat(e, F.slice(e, 1, 2))).cast("long").alias("n"), F.array_contains(e, e[2]).alias("held"), (F.round(F.reverse(e)[0].cast("double"), 4) + 0.0).alias("last"), whole.alias("cast_sum"))


@C.query(
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_size END AS a, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 WHEN p_partkey % 4 = 1 THEN 1 ELSE p_size END AS b FROM part)
    SELECT p_partkey, CASE WHEN a = 1 THEN '2,' || b WHEN b = 1 OR a = b THEN '2,' || a END AS shape FROM p"""
)
def broadcast_shapes(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, F.when(k % 3 == 0, F.lit(1)).otherwise(F.col("p_size")).alias("a"), F.when(k % 4 == 0, F.col("p_size") + 1).when(k % 4 == 1, F.lit(1)).otherwise(F.col("p_size")).alias("b"))
    shape = text.broadcast_shape(F.array(F.lit(2), F.col("a")), F.array(F.col("b")))
    return p.select("p_partkey", F.array_join(shape, ",").alias("shape"))


@C.query("SELECT c_custkey, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, CAST(3 AS BIGINT) AS n FROM customer")
def map_insert_lookup(spark, sf_dir):
    base = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.lit("none"))
    added = F.map_concat(F.map_filter(base, lambda k, v: k != "nation"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("key"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(added, "segment").alias("segment"), F.element_at(added, "nation").alias("nation"), F.size(added).cast("long").alias("n"))


@C.query(
    f"""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CAST(greatest(0, least(7, floor((value - 5.0) / (95.0 / 8)))) AS INTEGER) AS frame, count(*) AS n, {rnd('sum(value)', 2)} AS total
    FROM events WHERE value < 100 GROUP BY 1, 2"""
)
def gate_windows(spark, sf_dir):
    """The streaming gate over the static table; the stream itself is tested."""
    out = gate_stream(signal(spark, sf_dir), "ts", "value", 100.0, 8)
    return rounded(out, "start", "frame", "n", digits=2, total=F.col("total"))
