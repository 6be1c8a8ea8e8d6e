"""Queries of gating, binning, interpolation, smoothing and index arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.operators import gating, reshape
from tensorloom.plans.shared import CENT, ENT, PI, Catalogue, complex_vectors, rnd, rounded, signal, table, vectors

C = Catalogue()

_M = "m AS (SELECT avg(value) AS m FROM events)"


@C.query(
    f"""WITH {_M}, g AS (SELECT e.*, 2 * m AS upper, 0.05 * (2 * m) AS start FROM events e, m WHERE value < 2 * m),
    f AS (SELECT *, CAST(greatest(0, least(7, floor((value - start) / ((upper - start) / 8)))) AS INTEGER) AS frame FROM g)
    SELECT frame, count(*) AS n, {rnd('avg(value)', 3)} AS mean, max(value) AS top FROM f GROUP BY frame"""
)
def gate_ecg(spark, sf_dir):
    """Gating by value, the last part of the range dropped."""
    gated = gating.gate_by_value(signal(spark, sf_dir), "value", 8)
    sums = gated.groupBy("frame").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))
    return rounded(sums, "frame", "n", "top", digits=3, mean=F.col("mean"))


@C.query(
    f"""WITH {_M}, f AS (SELECT event_id, value, CAST(greatest(0, least(7, floor(value / (2 * m / 8) - 0.5))) AS INTEGER) AS frame FROM events, m)
    SELECT frame, count(*) AS n, max(value) AS top FROM f GROUP BY frame"""
)
def gate_open_end(spark, sf_dir):
    return gating.gate_open_end(signal(spark, sf_dir), "value", 8).groupBy("frame").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@C.query(
    """WITH p AS (SELECT event_id, value / 100 - 2.4 AS phase FROM events),
    bins AS (SELECT unnest(range(6)) AS frame), edges AS (SELECT frame, (frame * (2 * 3.141592 / 6)) AS lo, ((frame + 1) * (2 * 3.141592 / 6)) AS hi FROM bins)
    SELECT event_id, CAST(frame AS INTEGER) AS frame FROM p, edges
    WHERE abs(phase) <= 3.141592 AND (phase + 3.141592) / (2 * 3.141592 / 6) >= frame AND (phase + 3.141592) / (2 * 3.141592 / 6) <= frame + 1"""
)
def gate_closed_bins(spark, sf_dir):
    phases = signal(spark, sf_dir).withColumn("phase", F.col("value") / 100 - 2.4)
    return gating.gate_closed_bins(phases, "phase", 6).select("event_id", "frame")


@C.query()
def gate_respiratory(spark, sf_dir):
    """Each user's signal, in time order, low-passed and turned into phases; then closed bins. Tested against numpy."""
    phases = gating.respiratory_phase(signal(spark, sf_dir).select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("t"), "value"), "user_id", "t", "value", tie="event_id")
    return gating.gate_closed_bins(phases, "phase", 4).select("event_id", "user_id", "frame")


_BIN = "b AS (SELECT event_id, value, event_id * 7 % 16 AS bin, row_number() OVER (PARTITION BY event_id * 7 % 16 ORDER BY event_id) - 1 AS position FROM events)"


def _binned(spark, sf_dir) -> DataFrame:
    ev = signal(spark, sf_dir).withColumn("bin", F.col("event_id") * 7 % 16)
    return gating.bin_positions(ev, "bin", "event_id").select("event_id", "value", "bin", "position")


@C.query(f"WITH {_BIN} SELECT bin, position, event_id FROM b")
def bin_gate(spark, sf_dir):
    return _binned(spark, sf_dir).select("bin", "position", "event_id")


@C.query("SELECT event_id, value FROM events")
def unbin_gate(spark, sf_dir):
    """Binning and its inverse: the signal itself."""
    b = _binned(spark, sf_dir)
    return gating.unbin(b.select("bin", "position", "value"), b.select("bin", "position", "event_id"), "bin").select("event_id", "value")


_DAYS = "d AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, sum(value) AS v FROM events GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY day) - 1 AS k0, v FROM d)"


def _days(spark, sf_dir) -> DataFrame:
    """The daily series: one row a day."""
    d = signal(spark, sf_dir).groupBy(F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.sum("value").alias("v"))
    return d.select((F.row_number().over(Window.orderBy("day")) - 1).cast("long").alias("k0"), "v")


@C.query(
    f"""WITH {_DAYS}, l AS (SELECT *, lead(v) OVER (ORDER BY k0) AS nx FROM n), s AS (SELECT unnest(range(4)) AS step)
    SELECT k0, CAST(step AS INTEGER) AS step, {rnd('CASE WHEN nx IS NULL THEN v ELSE v * (1 - step / 4.0) + nx * (step / 4.0) END', 5)} AS v FROM l, s WHERE nx IS NOT NULL OR step = 0"""
)
def interpolate_frames(spark, sf_dir):
    return rounded(gating.interpolate_frames(_days(spark, sf_dir), "k0", "v", 3), "k0", "step", digits=5, v=F.col("v"))


@C.query(
    f"""WITH {_DAYS}, top AS (SELECT max(k0) AS m FROM n), g AS (SELECT unnest(range(CAST(ceil(m / 0.75) AS BIGINT))) AS k FROM top)
    SELECT k, {rnd('a.v * (1 - (k * 0.75 - a.k0)) + b.v * (k * 0.75 - a.k0)', 5)} AS v FROM g JOIN n a ON a.k0 = floor(k * 0.75) JOIN n b ON b.k0 = a.k0 + 1"""
)
def interp_linear(spark, sf_dir):
    return rounded(gating.interpolate_linear(_days(spark, sf_dir), "k0", "v", 0.75), "k", digits=5, v=F.col("v"))


@C.query(
    f"""WITH {ENT}, s AS (SELECT vec_id, i, re, coalesce(lag(re) OVER w, 0) AS a, coalesce(lead(re) OVER w, 0) AS b FROM ent WINDOW w AS (PARTITION BY vec_id ORDER BY i))
    SELECT vec_id, i, {rnd('(a + re + b) / (3 * 2.0) + re * 0.5')} AS v FROM s"""
)
def smooth_1d(spark, sf_dir):
    return rounded(gating.smooth_neighbours(vectors(spark, sf_dir).df, ("i",), "re", 2.0, "vec_id"), "vec_id", "i", v=F.col("re"))


@C.query(
    f"""WITH {ENT}, g AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, re FROM ent)
    SELECT a.vec_id, CAST(a.y AS INTEGER) AS y, CAST(a.x AS INTEGER) AS x, {rnd('sum(b.re) / (9 * 2.0) + max(a.re) * 0.5')} AS v
    FROM g a JOIN g b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.vec_id, a.y, a.x"""
)
def smooth_2d(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    return rounded(gating.smooth_neighbours(grid, ("y", "x"), "re", 2.0, "vec_id"), "vec_id", "y", "x", v=F.col("re"))


# index arithmetic: a vector as an 8 x 8 grid
_GRID = f"{ENT}, g AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, re FROM ent)"


def _grid(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).df.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), "re")


@C.query("SELECT 0 AS child, n_nationkey AS id FROM nation UNION ALL SELECT 1, r_regionkey FROM region")
def stack_tables(spark, sf_dir):
    parts = [table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))]
    return reshape.stack(parts)


@C.query("SELECT event_id % 5 AS enc, event_id, row_number() OVER (PARTITION BY event_id % 5 ORDER BY user_id, event_id) - 1 AS s FROM events")
def concat_frames(spark, sf_dir):
    ev = signal(spark, sf_dir).select((F.col("event_id") % 5).alias("enc"), F.col("user_id").alias("frame"), "event_id")
    return reshape.concat_frames(ev, "enc", "frame", "event_id").select("enc", "event_id", "s")


@C.query("SELECT l_orderkey * 8 + l_linenumber AS s, l_quantity FROM lineitem")
def flatten_spokes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return reshape.flatten_index(li, "l_orderkey", "l_linenumber", 8, "s")


@C.query("SELECT event_id // 100 AS spoke, event_id % 100 AS sample, value FROM events")
def unflatten_spokes(spark, sf_dir):
    return reshape.unflatten_index(signal(spark, sf_dir).select("event_id", "value"), "event_id", 100, "spoke", "sample")


@C.query(
    f"""WITH {_GRID}, full_grid AS (SELECT vec_id, CAST(unnest(range(72)) AS INTEGER) AS c FROM embeddings)
    SELECT f.vec_id, c // 6 AS y, c % 6 AS x, {rnd('coalesce(re, 0)')} AS v FROM full_grid f LEFT JOIN g ON g.vec_id = f.vec_id AND g.y = c // 6 - 2 AND g.x = c % 6 + 1"""
)
def resize_centre(spark, sf_dir):
    """8 x 8 to 12 x 6 about the centre: padded on one axis, cropped on the other."""
    small = reshape.resize_centre(_grid(spark, sf_dir), {"y": (8, 12), "x": (8, 6)})
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(71))).alias("c"))
    grid = cells.select("vec_id", F.floor(F.col("c") / 6).cast("int").alias("y"), (F.col("c") % 6).cast("int").alias("x"))
    return rounded(reshape.dense(small, grid, ["vec_id", "y", "x"], "re"), "vec_id", "y", "x", v=F.col("re"))


@C.query(f"WITH {_GRID}, s AS (SELECT vec_id, x, sum(re) AS re FROM g GROUP BY vec_id, x) SELECT vec_id, x, CAST(unnest(range(3)) AS INTEGER) AS y, {rnd('re')} AS v FROM s")
def tile_sum(spark, sf_dir):
    """A sum over an axis and its adjoint."""
    sums = reshape.sum_axes(_grid(spark, sf_dir), ["vec_id", "x"], "re")
    return rounded(reshape.tile(sums, "y", 3), "vec_id", "x", "y", v=F.col("re"))


@C.query(f"WITH {_GRID} SELECT vec_id, y // 2 AS y, x // 4 AS x, {rnd('re')} AS v FROM g WHERE y % 2 = 0 AND x % 4 = 0")
def downsample(spark, sf_dir):
    return rounded(reshape.downsample(_grid(spark, sf_dir), {"y": 2, "x": 4}), "vec_id", "y", "x", v=F.col("re"))


@C.query(f"WITH {_GRID} SELECT vec_id, x AS y, y AS x, {rnd('re')} AS v FROM g")
def transpose(spark, sf_dir):
    return rounded(reshape.permute(_grid(spark, sf_dir), {"y": "x", "x": "y"}), "vec_id", "y", "x", v=F.col("re"))


@C.query(f"WITH {_GRID} SELECT vec_id, y - 2 AS y, x - 3 AS x, {rnd('re')} AS v FROM g WHERE y >= 2 AND y < 5 AND x >= 3 AND x < 6")
def block_extract(spark, sf_dir):
    return rounded(reshape.extract_block(_grid(spark, sf_dir), {"y": 2, "x": 3}, 3), "vec_id", "y", "x", v=F.col("re"))


@C.query(f"WITH {_GRID} SELECT vec_id, y, x, {rnd('CASE WHEN y >= 2 AND y < 5 AND x >= 3 AND x < 6 THEN -re ELSE re END')} AS v FROM g")
def block_insert(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    block = reshape.extract_block(grid, {"y": 2, "x": 3}, 3).withColumn("re", -F.col("re"))
    return rounded(reshape.insert_block(grid, block, {"y": 2, "x": 3}, ["vec_id", "y", "x"], "re"), "vec_id", "y", "x", v=F.col("re"))


@C.query(
    f"""WITH {_GRID} SELECT vec_id, y, x, CASE WHEN y >= 1 AND (y - 1) % 3 < 2 AND (y - 1) // 3 * 3 + 1 + 2 < 8 THEN (y - 1) // 3 END AS block_y,
    CASE WHEN (x % 3) < 2 AND x // 3 * 3 + 2 < 8 THEN x // 3 END AS block_x FROM g"""
)
def block_index(spark, sf_dir):
    """Blocks of 2 x 2 at a stride of 3, shifted by 1 on one axis; a block that reaches the edge is skipped."""
    return reshape.with_blocks(_grid(spark, sf_dir), ("y", "x"), 2, 3, (1, 0), (8, 8)).drop("re")


@C.query(
    f"""WITH p AS (SELECT vec_id, embedding AS e FROM embeddings), c AS (SELECT vec_id, e, unnest(range(16)) AS c FROM p)
    SELECT vec_id, CAST(c // 4 AS INTEGER) AS row, CAST(c % 4 AS INTEGER) AS col,
    {rnd('CAST(e[CAST(greatest(c // 4, c % 4) * (greatest(c // 4, c % 4) + 1) // 2 + least(c // 4, c % 4) + 1 AS BIGINT)] AS DOUBLE)')} AS v FROM c"""
)
def unpack_symmetric(spark, sf_dir):
    packed = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 10).alias("p"))
    return rounded(reshape.unpack_symmetric(packed, "p", 4, "vec_id"), "vec_id", "row", "col", v=F.col("v").cast("double"))


@C.query(
    f"""WITH {ENT}, z AS (SELECT vec_id, unnest(range(127)) AS j FROM embeddings)
    SELECT z.vec_id, CAST(j AS INTEGER) AS i, {rnd('a.re * (1 - (j % 2) * 0.5) + coalesce(b.re, 0) * ((j % 2) * 0.5)')} AS v
    FROM z JOIN ent a ON a.vec_id = z.vec_id AND a.i = j // 2 LEFT JOIN ent b ON b.vec_id = z.vec_id AND b.i = j // 2 + 1"""
)
def zoom_linear(spark, sf_dir):
    """64 places to 127, on the lines between neighbours."""
    return rounded(reshape.zoom_linear(vectors(spark, sf_dir).df, "i", 64, 127, "re", "vec_id"), "vec_id", "i", v=F.col("re"))


@C.query(f"WITH {CENT} SELECT i, {rnd('avg(re)')} AS re, {rnd('avg(im)')} AS im FROM cent GROUP BY i")
def mean_image(spark, sf_dir):
    from tensorloom.sources.readers import mean_image as mean

    return rounded(mean(complex_vectors(spark, sf_dir).df, over=("vec_id", "label")), "i", re=F.col("re"), im=F.col("im"))


@C.query(f"SELECT CAST(y AS INTEGER) AS x, CAST(x AS INTEGER) AS y, {rnd(f'-{PI} + y * (2 * {PI} / 12)', 6)} AS kx, {rnd(f'-{PI} + x * (2 * {PI} / 12)', 6)} AS ky FROM (SELECT unnest(range(12)) AS y) a, (SELECT unnest(range(12)) AS x) b")
def grid_coordinates(spark, sf_dir):
    from tensorloom.sources.generators import grid_coords

    return rounded(grid_coords(spark, 12, 2), "x", "y", digits=6, kx=F.col("kx"), ky=F.col("ky"))


@C.query(
    f"""WITH a AS (SELECT o_orderkey AS spoke, {PI} * ((o_orderkey * 37 % 199) / 199.0) AS xa, 2 * {PI} * ((o_custkey * 11 % 211) / 211.0) AS za, CAST(unnest(range(8)) AS INTEGER) AS s FROM orders),
    l AS (SELECT *, {PI} * (s * ((4 / 3.0) / 7) - 1 / 3.0) AS z FROM a),
    k AS (SELECT spoke, s, 1.5 * (z * sin(xa) * sin(za)) AS kx, 1.5 * (-z * sin(xa) * cos(za)) AS ky, 1.5 * (z * cos(xa)) AS kz FROM l)
    SELECT spoke, s, {rnd('kx', 6)} AS kx, {rnd('ky', 6)} AS ky, {rnd('kz', 6)} AS kz FROM k WHERE abs(kx) < {PI} AND abs(ky) < {PI} AND abs(kz) < {PI}"""
)
def vipr_spokes(spark, sf_dir):
    """A tilted and turned line for each order, stretched and cropped to the period."""
    from tensorloom.sources.generators import vipr_spokes as lines

    pi = float(PI)
    angles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spoke"), (pi * ((F.col("o_orderkey") * 37 % 199) / 199.0)).alias("xangle"), (2 * pi * ((F.col("o_custkey") * 11 % 211) / 211.0)).alias("zangle"))
    return rounded(lines(angles, 8, noise=0.0, crop=1.5), "spoke", "s", digits=6, kx=F.col("kx"), ky=F.col("ky"), kz=F.col("kz"))
