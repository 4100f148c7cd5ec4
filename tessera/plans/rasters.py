"""Queries over interval rasters: areas, moments, shapes, lookups, merging, painting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import pixel as px
from tessera.operators import hierarchy, raster
from tessera.plans import fixtures as fx

QUERIES, ORACLE = {}, {}
KEYS = ["frame", "region_id", "y"]


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return add


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("g01_scanline_rle", fx.with_views("scan_interval", "SELECT * FROM scan_interval"))
def g01(spark, d):
    return fx.scan_intervals(spark, d)


@query("f01_raster_area", fx.with_views("scan_interval", "SELECT frame, region_id, CAST(sum(right_x - left_x + 1) AS BIGINT) AS area FROM scan_interval GROUP BY 1, 2"))
def f01(spark, d):
    return raster.area(fx.scan_intervals(spark, d), ["frame", "region_id"])


MOMENTS = """--cte px AS (SELECT frame, region_id, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x FROM labels),
mo AS (SELECT region_id, frame, CAST(count(*) AS DOUBLE) AS size, avg(x) AS mean_x, avg(y) AS mean_y, avg(x * x) AS moment_xx, avg(x * y) AS moment_xy, avg(y * y) AS moment_yy FROM px GROUP BY 1, 2)"""


@query("f02_shape_moments", fx.with_views("labels", MOMENTS + " SELECT region_id, frame, size, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean_x", "mean_y", "moment_xx", "moment_xy", "moment_yy")) + " FROM mo"))
def f02(spark, d):
    return r6(raster.moments(fx.scan_intervals(spark, d), ["region_id", "frame"]), "mean_x", "mean_y", "moment_xx", "moment_xy", "moment_yy")


MERGED = MOMENTS + """, mm AS (SELECT region_id, sum(size) AS size, sum(size * mean_x) / sum(size) AS mx, sum(size * mean_y) / sum(size) AS my, sum(size * moment_xx) / sum(size) AS xx, sum(size * moment_xy) / sum(size) AS xy, sum(size * moment_yy) / sum(size) AS yy FROM mo GROUP BY 1),
v AS (SELECT *, xx - mx * mx AS vx, yy - my * my AS vy, xy - mx * my AS c FROM mm),
e AS (SELECT *, (vx + vy) / 2e0 + sqrt(greatest(0e0, (vx - vy) * (vx - vy) / 4e0 + c * c)) AS e1, (vx + vy) / 2e0 - sqrt(greatest(0e0, (vx - vy) * (vx - vy) / 4e0 + c * c)) AS e2 FROM v),
ax AS (SELECT *, e1 - e2 <= 0.2e0 AS plain, CASE WHEN abs(e1 - vy) >= abs(e1 - vx) THEN e1 - vy ELSE c END AS dx, CASE WHEN abs(e1 - vy) >= abs(e1 - vx) THEN c ELSE e1 - vx END AS dy FROM e),
sh AS (SELECT region_id, size, mx AS center_x, my AS center_y, sqrt(greatest(0e0, CASE WHEN plain THEN vx ELSE e1 END)) AS mag_major, sqrt(greatest(0e0, CASE WHEN plain THEN vy ELSE e2 END)) AS mag_minor,
 CASE WHEN plain THEN 1e0 ELSE dx / nullif(sqrt(dx * dx + dy * dy), 0) END AS dir_major_x, CASE WHEN plain THEN 0e0 ELSE dy / nullif(sqrt(dx * dx + dy * dy), 0) END AS dir_major_y, size >= 10 AND e2 >= 1e0 AS valid FROM ax)"""
SHAPE = ("center_x", "center_y", "mag_major", "mag_minor", "dir_major_x", "dir_major_y")


def shapes(spark, d):
    per_frame = raster.moments(fx.scan_intervals(spark, d), ["region_id", "frame"])
    return raster.shape(raster.merge_moments(per_frame, ["region_id"]))


@query("f03_shape_descriptor", fx.with_views("labels", MERGED + " SELECT region_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in SHAPE) + ", valid FROM sh"))
def f03(spark, d):
    return r6(shapes(spark, d), *SHAPE).select("region_id", *SHAPE, "valid")


@query("f04_shape_box", fx.with_views("labels", MERGED + """ SELECT region_id, k AS corner, round(center_x + sx * (1.65e0 * mag_major + 2e0) * dir_major_x - sy * (1.65e0 * mag_minor + 2e0) * dir_major_y, 6) AS x,
 round(center_y + sx * (1.65e0 * mag_major + 2e0) * dir_major_y + sy * (1.65e0 * mag_minor + 2e0) * dir_major_x, 6) AS y FROM sh CROSS JOIN (VALUES (0, 1, 1), (1, 1, -1), (2, -1, -1), (3, -1, 1)) AS t(k, sx, sy)"""))
def f04(spark, d):
    corners = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("sx"), F.lit(b).alias("sy")) for k, (a, b) in enumerate(((1, 1), (1, -1), (-1, -1), (-1, 1)))]))
    s = shapes(spark, d).withColumn("c", corners)
    u, v = F.col("c.sx") * (1.65 * F.col("mag_major") + 2.0), F.col("c.sy") * (1.65 * F.col("mag_minor") + 2.0)
    return s.select("region_id", F.col("c.k").alias("corner"), F.round(F.col("center_x") + u * F.col("dir_major_x") - v * F.col("dir_major_y"), 6).alias("x"),
                    F.round(F.col("center_y") + u * F.col("dir_major_y") + v * F.col("dir_major_x"), 6).alias("y"))


@query("m04_ellipse_geometry", fx.with_views("labels", MERGED + " SELECT region_id, round(1.96e0 * mag_major, 6) AS a, round(1.96e0 * mag_minor, 6) AS b, round(atan2(dir_major_y, dir_major_x), 6) AS angle FROM sh WHERE valid"))
def m04(spark, d):
    return shapes(spark, d).filter("valid").select("region_id", F.round(1.96 * F.col("mag_major"), 6).alias("a"), F.round(1.96 * F.col("mag_minor"), 6).alias("b"), F.round(F.atan2("dir_major_y", "dir_major_x"), 6).alias("angle"))


@query("f05_parent_raster", fx.with_views("labels", """--cte p AS (SELECT frame, region_id // 2 AS region_id, y, x FROM labels),
q AS (SELECT *, x - row_number() OVER (PARTITION BY frame, region_id, y ORDER BY x) AS g FROM p) SELECT frame, CAST(region_id AS INTEGER) AS region_id, y, min(x) AS left_x, max(x) AS right_x FROM q GROUP BY frame, region_id, y, g"""))
def f05(spark, d):
    up = fx.scan_intervals(spark, d).withColumn("region_id", F.expr("cast(region_id div 2 as int)"))
    return raster.coalesce_adjacent(up, KEYS).select(*KEYS, "left_x", "right_x")


MERGE_SQL = """--cte s AS (SELECT *, region_id % 2 AS side, region_id // 2 AS rid FROM scan_interval),
t AS (SELECT *, min(side) OVER (PARTITION BY frame, rid, y) = max(side) OVER (PARTITION BY frame, rid, y) AS one FROM s),
u AS (SELECT *, CASE WHEN lag(right_x) OVER (PARTITION BY frame, rid, y ORDER BY left_x, right_x) + 1 = left_x THEN 0 ELSE 1 END AS n FROM t WHERE NOT one),
v AS (SELECT *, sum(n) OVER (PARTITION BY frame, rid, y ORDER BY left_x, right_x ROWS UNBOUNDED PRECEDING) AS g FROM u)
SELECT frame, CAST(rid AS INTEGER) AS region_id, y, min(left_x) AS left_x, max(right_x) AS right_x FROM v GROUP BY frame, rid, y, g UNION ALL SELECT frame, CAST(rid AS INTEGER), y, left_x, right_x FROM t WHERE one"""


def _merge(spark, d):
    s = fx.scan_intervals(spark, d)
    up = F.expr("cast(region_id div 2 as int)")
    even, odd = (s.filter(F.col("region_id") % 2 == k).withColumn("region_id", up) for k in (0, 1))
    return raster.merge(even, odd, KEYS).select(*KEYS, "left_x", "right_x")


query("e11_merge_rasters", fx.with_views("scan_interval", MERGE_SQL))(_merge)
query("e12_merge_rasters_3d", fx.with_views("scan_interval", MERGE_SQL.replace("SELECT frame, CAST(rid AS INTEGER) AS region_id, y, min", "SELECT frame, CAST(rid AS INTEGER) AS region_id, y, min") ))(_merge)


@query("e05_point_in_region", fx.with_views("scan_interval", """--cte pts AS (SELECT CAST(vec_id % 110 AS INTEGER) AS frame, CAST((vec_id * 7) % 10 AS INTEGER) AS y, CAST((vec_id * 3) % 9 AS INTEGER) AS x, vec_id FROM embeddings)
SELECT p.frame, p.y, p.x, p.vec_id, coalesce(i.region_id, -1) AS region_id FROM pts p LEFT JOIN scan_interval i ON p.frame = i.frame AND p.y = i.y AND p.x BETWEEN i.left_x AND i.right_x"""))
def e05(spark, d):
    v = F.col("vec_id")
    pts = fx.table(spark, d, "embeddings").select((v % 110).cast("int").alias("frame"), ((v * 7) % 10).cast("int").alias("y"), ((v * 3) % 9).cast("int").alias("x"), "vec_id")
    return raster.at_points(pts, fx.scan_intervals(spark, d))


@query("e06_locate_scan_line", fx.with_views("scan_interval", "SELECT * FROM scan_interval WHERE frame = 12 AND y = 3"))
def e06(spark, d):
    return fx.scan_intervals(spark, d).filter("frame = 12 and y = 3")


@query("d05_contains_region", fx.with_views("scan_interval", "SELECT DISTINCT frame FROM scan_interval WHERE region_id = 5"))
def d05(spark, d):
    return fx.scan_intervals(spark, d).filter("region_id = 5").select("frame").distinct()


BOUND = """--cte o AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS t(dy, dx)),
n AS (SELECT l.frame, l.region_id, l.y + dy AS y, l.x + dx AS x FROM labels l CROSS JOIN o)"""


@query("l01_boundary_inner", fx.with_views("labels", BOUND + """ SELECT l.frame, l.region_id, l.y, l.x FROM labels l LEFT JOIN (SELECT frame, region_id, y, x, count(*) AS k FROM n GROUP BY 1, 2, 3, 4) c USING (frame, region_id, y, x) WHERE coalesce(k, 0) < 4"""))
def l01(spark, d):
    return raster.boundary(raster.pixels(fx.scan_intervals(spark, d)))


@query("l01_boundary_outer", fx.with_views("labels", BOUND + " SELECT DISTINCT frame, region_id, y, x FROM n ANTI JOIN labels USING (frame, region_id, y, x)"))
def l01_outer(spark, d):
    return raster.boundary(raster.pixels(fx.scan_intervals(spark, d)), inner=False)


@query("m01_id_image", fx.with_views("labels", "SELECT frame, y, x, CAST(region_id // 2 AS INTEGER) AS id FROM labels"))
def m01(spark, d):
    return raster.pixels(fx.scan_intervals(spark, d)).select("frame", "y", "x", F.expr("cast(region_id div 2 as int)").alias("id"))


COLOURS = "--cte col AS (SELECT id, max_by(color, event_id) AS color FROM project_labels GROUP BY id)"


@query("m02_render_regions", fx.with_views("labels project_labels", COLOURS + " SELECT frame, y, x, color FROM labels JOIN col ON id = region_id"))
def m02(spark, d):
    colour = fx.project_labels(spark, d).groupBy("id").agg(F.max_by("color", "event_id").alias("color"))
    return raster.pixels(fx.scan_intervals(spark, d)).join(colour, F.col("id") == F.col("region_id")).select("frame", "y", "x", "color")


@query("m06_project_colours", fx.with_views("project_labels", COLOURS + " SELECT id, (color >> 16) & 255 AS r, (color >> 8) & 255 AS g, color & 255 AS b FROM col"))
def m06(spark, d):
    colour = fx.project_labels(spark, d).groupBy("id").agg(F.max_by("color", "event_id").alias("color"))
    return colour.select("id", F.shiftright("color", 16).bitwiseAND(255).alias("r"), F.shiftright("color", 8).bitwiseAND(255).alias("g"), F.col("color").bitwiseAND(255).alias("b"))


@query("d10_colourless_regions_skipped", fx.with_views("labels project_labels", "SELECT DISTINCT frame, region_id FROM labels SEMI JOIN (SELECT id FROM project_labels WHERE label = 'click') c ON c.id = region_id"))
def d10(spark, d):
    has = fx.project_labels(spark, d).filter("label = 'click'").select(F.col("id").alias("region_id"))
    return fx.labels(spark, d).select("frame", "region_id").distinct().join(has, "region_id", "left_semi").select("frame", "region_id")


EDGE_SQL = """--cte e AS (SELECT a.frame, a.y, a.x, CASE WHEN (r.region_id IS NOT NULL AND r.region_id <> a.region_id) OR (b.region_id IS NOT NULL AND b.region_id <> a.region_id) THEN 0 ELSE a.region_id * 10 + 5 END AS v
FROM labels a LEFT JOIN labels r ON r.frame = a.frame AND r.y = a.y AND r.x = a.x + 1 LEFT JOIN labels b ON b.frame = a.frame AND b.y = a.y + 1 AND b.x = a.x)"""


def _edges(spark, d):
    lab = fx.labels(spark, d)
    right = F.lead("region_id").over(Window.partitionBy("frame", "y").orderBy("x"))
    down = F.lead("region_id").over(Window.partitionBy("frame", "x").orderBy("y"))
    at = lab.withColumns({"r": right, "b": down})
    differs = lambda c: F.coalesce(F.col(c) != F.col("region_id"), F.lit(False))
    return at.select("frame", "y", "x", F.when(differs("r") | differs("b"), 0).otherwise(F.col("region_id") * 10 + 5).alias("v"))


query("m03_edge_highlight", fx.with_views("labels", EDGE_SQL + " SELECT * FROM e"))(_edges)
query("b09_bitmap_colour", fx.with_views("labels", EDGE_SQL + " SELECT frame, y, x, v & 255 AS b0, (v >> 8) & 255 AS b1 FROM e"))(
    lambda spark, d: _edges(spark, d).select("frame", "y", "x", F.col("v").bitwiseAND(255).alias("b0"), F.shiftright("v", 8).bitwiseAND(255).alias("b1")))


@query("m07_blend", fx.with_views("labels", EDGE_SQL + " SELECT e.frame, e.y, e.x, round(0.5e0 * c0 + 0.5e0 * v / 255e0, 6) AS out FROM e JOIN voxels USING (frame, y, x)"))
def m07(spark, d):
    return _edges(spark, d).join(fx.voxels(spark, d), ["frame", "y", "x"]).select("frame", "y", "x", F.round(0.5 * F.col("c0") + 0.5 * F.col("v") / 255.0, 6).alias("out"))


@query("k20_vertex_order", fx.with_views("labels", """--cte c AS (SELECT a.frame, a.y, a.x, CAST(a.region_id <> r.region_id AS INTEGER) + CAST(r.region_id <> q.region_id AS INTEGER) + CAST(q.region_id <> b.region_id AS INTEGER) + CAST(b.region_id <> a.region_id AS INTEGER) AS n
FROM labels a JOIN labels r ON r.frame = a.frame AND r.y = a.y AND r.x = a.x + 1 JOIN labels b ON b.frame = a.frame AND b.y = a.y + 1 AND b.x = a.x JOIN labels q ON q.frame = a.frame AND q.y = a.y + 1 AND q.x = a.x + 1)
SELECT frame, y, x, CASE WHEN n > 2 THEN n ELSE 1 END AS vertex_order FROM c"""))
def k20(spark, d):
    lab = fx.labels(spark, d)
    across = Window.partitionBy("frame", "y").orderBy("x")
    at = lab.withColumn("r", F.lead("region_id").over(across))
    down = Window.partitionBy("frame", "x").orderBy("y")
    at = at.withColumns({"b": F.lead("region_id").over(down), "q": F.lead("r").over(down)}).filter("r is not null and b is not null and q is not null")
    n = F.expr("int(region_id <> r) + int(r <> q) + int(q <> b) + int(b <> region_id)")
    return at.withColumn("n", n).select("frame", "y", "x", F.when(F.col("n") > 2, F.col("n")).otherwise(1).alias("vertex_order"))


@query("k26_intervals_touch", fx.with_views("scan_interval", """SELECT a.frame, a.region_id AS ra, b.region_id AS rb, a.y, a.left_x AS la, b.left_x AS lb, a.left_x <= b.right_x AND b.left_x <= a.right_x AS n4 FROM scan_interval a JOIN scan_interval b ON a.frame = b.frame AND b.y = a.y + 1 AND a.left_x <= b.right_x + 1 AND b.left_x <= a.right_x + 1"""))
def k26(spark, d):
    s = fx.scan_intervals(spark, d)
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("b.y") == F.col("a.y") + 1) & raster.touching("a", "b", True))
    return j.select("a.frame", F.col("a.region_id").alias("ra"), F.col("b.region_id").alias("rb"), "a.y", F.col("a.left_x").alias("la"), F.col("b.left_x").alias("lb"), raster.touching("a", "b", False).alias("n4"))


COMPONENTS = """WITH RECURSIVE {views}, iv AS (SELECT *, frame * 64 + y * 8 + left_x AS node FROM scan_interval),
lk AS (SELECT a.node AS p, b.node AS q FROM iv a JOIN iv b ON a.frame = b.frame AND a.region_id = b.region_id AND ((b.y = a.y + 1 AND a.left_x <= b.right_x + {gap} AND b.left_x <= a.right_x + {gap}){beside})),
ed AS (SELECT p, q FROM lk UNION SELECT q, p FROM lk), reach AS (SELECT node, node AS rep FROM iv UNION SELECT ed.q, reach.rep FROM reach JOIN ed ON ed.p = reach.node)
SELECT CAST(node AS BIGINT) AS node, CAST(min(rep) AS BIGINT) AS rep FROM reach GROUP BY node"""


def _components(n8: bool):
    def run(spark, d):
        iv = fx.scan_intervals(spark, d).withColumn("node", (F.col("frame").cast("long") * 64 + F.col("y") * 8 + F.col("left_x")))
        return raster.components(iv, n8)

    return run


for _n8 in (False, True):
    _sql = COMPONENTS.format(views=fx.with_views("scan_interval", "")[5:].rstrip(), gap=int(_n8), beside=" OR (b.y = a.y AND b.left_x = a.right_x + 1)" if _n8 else "")
    query(f"h18_components_{'n8' if _n8 else 'n4'}", _sql)(_components(_n8))


@query("l07_scale_vectorisation", "SELECT vec_id, list_transform(range(1, 65), lambda i: round(CASE WHEN i % 2 = 1 THEN least(320e0, abs(CAST(embedding[i] AS DOUBLE)) * 1000e0) ELSE least(240e0, abs(CAST(embedding[i] AS DOUBLE)) * 700e0) END, 6)) AS coord FROM embeddings")
def l07(spark, d):
    scaled = F.transform("embedding", lambda v, i: F.round(F.when(i % 2 == 0, F.least(F.lit(320.0), F.abs(v.cast("double")) * 1000.0)).otherwise(F.least(F.lit(240.0), F.abs(v.cast("double")) * 700.0)), 6))
    return fx.table(spark, d, "embeddings").select("vec_id", scaled.alias("coord"))


@query("l08_remove_raster", fx.with_views("scan_interval", "SELECT frame, region_id, CAST(NULL AS INTEGER) AS raster, true AS rasterization_removed FROM scan_interval GROUP BY frame, region_id"))
def l08(spark, d):
    return fx.scan_intervals(spark, d).select("frame", "region_id").distinct().withColumns({"raster": F.lit(None).cast("int"), "rasterization_removed": F.lit(True)})


@query("l09_boundary_key", fx.with_views("scan_interval", "SELECT frame, y, left_x, right_x, region_id, least(y * 100 + left_x, right_x * 100 + y) AS k0, greatest(y * 100 + left_x, right_x * 100 + y) AS k1, y * 100 + left_x > right_x * 100 + y AS swapped FROM scan_interval"))
def l09(spark, d):
    p, q = F.col("y") * 100 + F.col("left_x"), F.col("right_x") * 100 + F.col("y")
    return fx.scan_intervals(spark, d).select("frame", "y", "left_x", "right_x", "region_id", F.least(p, q).alias("k0"), F.greatest(p, q).alias("k1"), (p > q).alias("swapped"))


@query("d07_frame_border", fx.with_views("labels", "SELECT frame, region_id, bool_and(x IN (0, 7) OR y IN (0, 7)) AS on_border FROM labels GROUP BY 1, 2"))
def d07(spark, d):
    return fx.labels(spark, d).groupBy("frame", "region_id").agg(F.bool_and(F.col("x").isin(0, 7) | F.col("y").isin(0, 7)).alias("on_border"))


@query("d08_degenerate_polygons", fx.with_views("scan_interval", "SELECT frame, region_id, y, left_x FROM scan_interval WHERE NOT (right_x - left_x = 2 AND left_x % 2 = y % 2)"))
def d08(spark, d):
    return fx.scan_intervals(spark, d).filter("not (right_x - left_x = 2 and left_x % 2 = y % 2)").select("frame", "region_id", "y", "left_x")


@query("j05_unpaired_segments", fx.with_views("labels", """--cte s AS (SELECT frame, region_id, 2 * y AS sy, 2 * x + d AS sx FROM labels CROSS JOIN (VALUES (-1), (1)) AS t(d)) SELECT frame, sy, sx, min(region_id) AS region_id FROM s GROUP BY frame, sy, sx HAVING count(*) = 1"""))
def j05(spark, d):
    s = fx.labels(spark, d).select("frame", "region_id", (2 * F.col("y")).alias("sy"), F.explode(F.array(2 * F.col("x") - 1, 2 * F.col("x") + 1)).alias("sx"))
    return s.groupBy("frame", "sy", "sx").agg(F.min("region_id").alias("region_id"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


def _random_sql(seed: str, k: int) -> str:
    start, terms = px.random_terms(k)
    return "(((" + " + ".join(f"((({seed}) * {a} % 2147483647 * {b}) & 4294967295)" for a, b in zip(start, terms) if b) + ") & 4294967295) >> 1)"


def _colours_sql(seed: str) -> str:
    return ", ".join(f"CAST({_random_sql(seed, k)} % 255 AS INTEGER) AS c{k}" for k in range(3))


query("k23_random_colours", fx.with_views("labels", f"SELECT id, {_colours_sql('s')} FROM (SELECT DISTINCT region_id AS id, CAST(CASE WHEN region_id = 0 THEN 1 ELSE region_id END AS BIGINT) AS s FROM labels)"))(
    lambda spark, d: fx.labels(spark, d).select(F.col("region_id").alias("id")).distinct().select("id", *[c.alias(f"c{k}") for k, c in enumerate(px.region_colour(F.col("id")))]))


@query("m05_hierarchy_colours", fx.with_views("labels", f"SELECT frame, region_id, mapped_id, {_colours_sql('s')} FROM (SELECT DISTINCT frame, region_id, CAST(region_id // 2 AS INTEGER) AS mapped_id, CAST(CASE WHEN region_id // 2 = 0 THEN 1 ELSE region_id // 2 END AS BIGINT) AS s FROM labels)"))
def m05(spark, d):
    """Regions of each frame with their ancestor's id at level 1 and the colour of that id."""
    up = hierarchy.ancestors(fx.hierarchy_levels(spark, d), 0, 1).select(F.col("id").alias("region_id"), F.col("ancestor").cast("int").alias("mapped_id"))
    seen = fx.labels(spark, d).select("frame", "region_id").distinct().join(up, "region_id")
    return seen.select("frame", "region_id", "mapped_id", *[c.alias(f"c{k}") for k, c in enumerate(px.region_colour(F.col("mapped_id")))])
