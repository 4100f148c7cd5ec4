"""Views of the driver's tables shaped like voxels, labels, intervals and hierarchies.

Every view has a DataFrame form (a function of the session and the folder) and a SQL form
(``SQL``: common table expressions by name, with what each needs in ``NEEDS``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graph, hierarchy, raster

WIDTH = HEIGHT = 8
CHUNK_STRIDE = 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: five vectors make an 8 x 8 frame of three colours and two flow components."""
    long = table(spark, sf_dir, "embeddings").select(
        F.expr("cast(vec_id div 5 as int)").alias("frame"), (F.col("vec_id") % 5).alias("ch"), F.posexplode("embedding").alias("p", "e"))
    e = F.col("e").cast("double")
    colour = lambda c: F.max(F.when(F.col("ch") == c, F.greatest(F.lit(0.0), F.least(F.lit(1.0), e + 0.5)))).alias(f"c{c}")
    flow = lambda c, n: F.max(F.when(F.col("ch") == c, 8.0 * e)).alias(n)
    return long.groupBy("frame", F.expr("cast(p div 8 as int)").alias("y"), F.expr("cast(p % 8 as int)").alias("x")).agg(
        colour(0), colour(1), colour(2), flow(3, "fx"), flow(4, "fy"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: a region id per pixel; regions are unique within a chunk of 19 frames."""
    own = F.greatest(F.lit(0), F.least(F.lit(3), (8.0 * F.col("c0")).cast("int") - 2))
    return voxels(spark, sf_dir).select("frame", "y", "x", (4 * F.expr(f"frame div {CHUNK_STRIDE}") + own).cast("int").alias("region_id"))


def scan_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: maximal runs of equal labels in each row."""
    return raster.run_lengths(labels(spark, sf_dir))


def hierarchy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: level 0 are the V2 regions, a parent joins two, then two of those."""
    lab = labels(spark, sf_dir)
    base = lab.groupBy("region_id").agg(F.count(F.lit(1)).cast("long").alias("size"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))
    return hierarchy.build_levels(base.withColumnRenamed("region_id", "id"), graph.label_neighbours(lab), [2, 2])


def business_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: order, customer, nation, region as levels 0 to 3 with sizes and day bounds."""
    t = lambda n: table(spark, sf_dir, n)
    day = F.datediff("l_shipdate", F.lit("1970-01-01"))
    orders = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).cast("long").alias("size"), F.min(day).alias("start_frame"), F.max(day).alias("end_frame"))
    l0 = orders.join(t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id")), "id")
    up = lambda level, keys, key, parent: hierarchy.roll_up(level).join(t(keys).select(F.col(key).cast("long").alias("id"), F.col(parent).cast("long").alias("parent_id")), "id")
    l1 = up(l0, "customer", "c_custkey", "c_nationkey")
    l2 = up(l1, "nation", "n_nationkey", "n_regionkey")
    l3 = hierarchy.roll_up(l2).withColumn("parent_id", F.lit(-1).cast("long"))
    out = None
    for k, level in enumerate((l0, l1, l2, l3)):
        part = level.select(F.lit(k).alias("level"), "id", "size", "parent_id", "start_frame", "end_frame")
        out = part if out is None else out.unionByName(part)
    return out


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: normalised 4 x 4 x 4 histograms with a weight, in long form."""
    long = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("bin", "e")).withColumn("a", F.abs(F.col("e").cast("double")))
    return long.select("vec_id", "bin", (F.col("a") / F.sum("a").over(Window.partitionBy("vec_id"))).alias("value"), (F.col("vec_id") % 7 + 1).cast("double").alias("weight_sum"))


def frame_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: events as frames of four videos."""
    w = Window.partitionBy("video_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("int").alias("video_id"), "ts", "event_id", "value")
    pts = F.unix_micros(F.col("ts").cast("timestamp"))
    return ev.select("video_id", (F.row_number().over(w) - 1).alias("frame"), pts.alias("pts"), "value").withColumn(
        "period", (F.col("pts") - F.lag("pts").over(Window.partitionBy("video_id").orderBy("frame"))) / 1e6)


def project_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: labels of a project file: name, packed colour, region id."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(F.col("event_type").alias("label"), (k * 65793).alias("color"), (F.col("event_id") % 24).cast("int").alias("id"), "event_id")


# Rows of lineitem to a task of the region graph, so that its memory does not grow with the table.
TASK_ROWS = 1 << 18


def _parts(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the region graph. Counting rows of parquet reads no column."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS))


def region_links(spark: SparkSession, sf_dir: str, parts: int | None = None, weighted: bool = True) -> DataFrame:
    """Edges of V9, once for each row of src in an order with dst. The mean of a supplier goes
    to the rows of lineitem, not to the edges, of which there are more."""
    li = table(spark, sf_dir, "lineitem")
    some = li.select("l_orderkey", "l_suppkey")
    if weighted:
        # By hash: the means of a task are few, its lines need no sort.
        some = some.join(li.groupBy("l_suppkey").agg(F.avg("l_discount").alias("m")).hint("shuffle_hash"), "l_suppkey")
    some = some.repartition(parts or _parts(spark, sf_dir), "l_orderkey")
    end = lambda t, k, n: t.withColumnsRenamed({"l_suppkey": k, "m": n})
    # Repeated lines meet each other supplier of the order once, not each of its lines.
    once = end(some.dropDuplicates(["l_orderkey", "l_suppkey"]), "dst", "md")
    both = end(some, "src", "ms").hint("merge").join(once, "l_orderkey").filter("src < dst")
    weight = F.round(F.least(F.lit(1.0), 10.0 * F.abs(F.col("ms") - F.col("md"))), 9).alias("weight") if weighted else None
    return both.select("src", "dst", *[weight] * weighted)


def region_pairs(spark: SparkSession, sf_dir: str, weighted: bool = False) -> DataFrame:
    """Edges of V9 without their weights."""
    parts = _parts(spark, sf_dir)
    return region_links(spark, sf_dir, parts, weighted).repartition(parts, "src", "dst").dropDuplicates(["src", "dst"])


def region_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: suppliers that share an order, weighted by how far their discounts are."""
    return region_pairs(spark, sf_dir, weighted=True)


def region_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("size"))


NEEDS = {
    "voxels": (), "labels": ("voxels",), "scan_interval": ("labels",), "label_edges": ("labels",), "tree": ("labels", "label_edges"), "business_tree": (),
    "hist64": (), "frame_stream": (), "project_labels": (), "region_graph": (), "region_sizes": (),
    "spatial": ("voxels",), "temporal": ("voxels",), "flow_edges": ("voxels",),
}
SQL = {
    "voxels": """vox0 AS (SELECT vec_id // 5 AS frame, vec_id % 5 AS ch, unnest(range(0, 64)) AS p, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings),
voxels AS (SELECT CAST(frame AS INTEGER) AS frame, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x,
  max(CASE WHEN ch = 0 THEN greatest(0e0, least(1e0, e + 0.5e0)) END) AS c0, max(CASE WHEN ch = 1 THEN greatest(0e0, least(1e0, e + 0.5e0)) END) AS c1,
  max(CASE WHEN ch = 2 THEN greatest(0e0, least(1e0, e + 0.5e0)) END) AS c2, max(CASE WHEN ch = 3 THEN 8e0 * e END) AS fx, max(CASE WHEN ch = 4 THEN 8e0 * e END) AS fy
  FROM vox0 GROUP BY 1, 2, 3)""",
    "labels": """labels AS (SELECT frame, y, x, CAST(4 * (frame // 19) + greatest(0, least(3, CAST(trunc(8e0 * c0) AS INTEGER) - 2)) AS INTEGER) AS region_id FROM voxels)""",
    "scan_interval": """si0 AS (SELECT *, CASE WHEN lag(region_id) OVER (PARTITION BY frame, y ORDER BY x) = region_id THEN 0 ELSE 1 END AS new FROM labels),
si1 AS (SELECT *, sum(new) OVER (PARTITION BY frame, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS run FROM si0),
scan_interval AS (SELECT frame, any_value(region_id) AS region_id, y, min(x) AS left_x, max(x) AS right_x FROM si1 GROUP BY frame, y, run)""",
    "label_edges": """off AS (SELECT * FROM (VALUES (0, 0, 1), (0, 1, 0), (0, 1, -1), (0, 1, 1), (-1, -1, -1), (-1, -1, 0), (-1, -1, 1), (-1, 0, -1), (-1, 0, 0), (-1, 0, 1), (-1, 1, -1), (-1, 1, 0), (-1, 1, 1)) AS t(df, dy, dx)),
le0 AS (SELECT DISTINCT a.region_id AS p, b.region_id AS q FROM labels a CROSS JOIN off o JOIN labels b ON b.frame = a.frame + o.df AND b.y = a.y + o.dy AND b.x = a.x + o.dx WHERE a.region_id <> b.region_id),
label_edges AS (SELECT p AS id, q AS neighbor_id FROM le0 UNION SELECT q, p FROM le0)""",
    "tree": """tr0 AS (SELECT 0 AS level, region_id AS id, count(*) AS size, region_id // 2 AS parent_id, min(frame) AS start_frame, max(frame) AS end_frame FROM labels GROUP BY region_id),
tr1 AS (SELECT 1 AS level, parent_id AS id, CAST(sum(size) AS BIGINT) AS size, parent_id // 2 AS parent_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM tr0 GROUP BY tr0.parent_id),
tr2 AS (SELECT 2 AS level, parent_id AS id, CAST(sum(size) AS BIGINT) AS size, -1 AS parent_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM tr1 GROUP BY tr1.parent_id),
tre AS (SELECT 0 AS level, id, neighbor_id FROM label_edges UNION SELECT 1, id // 2, neighbor_id // 2 FROM label_edges WHERE id // 2 <> neighbor_id // 2 UNION SELECT 2, id // 4, neighbor_id // 4 FROM label_edges WHERE id // 4 <> neighbor_id // 4),
trn AS (SELECT level, id, list_sort(list(neighbor_id)) AS neighbor_id FROM tre GROUP BY level, id),
trc AS (SELECT level + 1 AS level, parent_id AS id, list_sort(list(id)) AS child_id FROM (SELECT * FROM tr0 UNION ALL SELECT * FROM tr1) GROUP BY level, parent_id),
tree AS (SELECT t.level, t.id, t.size, t.parent_id, t.start_frame, t.end_frame, coalesce(n.neighbor_id, []) AS neighbor_id, coalesce(c.child_id, []) AS child_id
  FROM (SELECT * FROM tr0 UNION ALL SELECT * FROM tr1 UNION ALL SELECT * FROM tr2) t LEFT JOIN trn n ON n.level = t.level AND n.id = t.id LEFT JOIN trc c ON c.level = t.level AND c.id = t.id)""",
    "business_tree": """bt0 AS (SELECT l_orderkey AS id, count(*) AS size, o_custkey AS parent_id, min(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS start_frame, max(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS end_frame FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_custkey),
bt1 AS (SELECT parent_id AS id, CAST(sum(size) AS BIGINT) AS size, CAST(c_nationkey AS BIGINT) AS parent, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM bt0 JOIN customer ON c_custkey = bt0.parent_id GROUP BY bt0.parent_id, c_nationkey),
bt2 AS (SELECT parent AS id, CAST(sum(size) AS BIGINT) AS size, CAST(n_regionkey AS BIGINT) AS up, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM bt1 JOIN nation ON n_nationkey = parent GROUP BY parent, n_regionkey),
bt3 AS (SELECT up AS id, CAST(sum(size) AS BIGINT) AS size, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM bt2 GROUP BY up),
business_tree AS (SELECT 0 AS level, id, size, parent_id, start_frame, end_frame FROM bt0 UNION ALL SELECT 1, id, size, parent, start_frame, end_frame FROM bt1
  UNION ALL SELECT 2, id, size, up, start_frame, end_frame FROM bt2 UNION ALL SELECT 3, id, size, -1, start_frame, end_frame FROM bt3)""",
    "hist64": """hi0 AS (SELECT vec_id, unnest(range(0, 64)) AS bin, abs(CAST(unnest(embedding) AS DOUBLE)) AS a FROM embeddings),
hist64 AS (SELECT vec_id, bin, a / sum(a) OVER (PARTITION BY vec_id) AS value, CAST(vec_id % 7 + 1 AS DOUBLE) AS weight_sum FROM hi0)""",
    "frame_stream": """fs0 AS (SELECT CAST(user_id % 4 AS INTEGER) AS video_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS frame, epoch_us(ts) AS pts, value FROM events),
frame_stream AS (SELECT video_id, CAST(frame AS INTEGER) AS frame, pts, value, (pts - lag(pts) OVER (PARTITION BY video_id ORDER BY frame)) / 1e6 AS period FROM fs0)""",
    "project_labels": """project_labels AS (SELECT event_type AS label, CAST(json_extract(props, '$.k') AS INTEGER) * 65793 AS color, CAST(event_id % 24 AS INTEGER) AS id, event_id FROM events)""",
    "region_graph": """rg0 AS (SELECT l_suppkey, avg(l_discount) AS m FROM lineitem GROUP BY 1), rg1 AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
rg2 AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM rg1 a JOIN rg1 b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey),
region_graph AS (SELECT src, dst, round(least(1e0, 10e0 * abs(s.m - d.m)), 9) AS weight FROM rg2 JOIN rg0 s ON s.l_suppkey = src JOIN rg0 d ON d.l_suppkey = dst)""",
    "spatial": """so AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 0), (2, 1, -1), (3, 1, 1)) AS t(seq, dy, dx)),
spatial AS (SELECT a.frame, 2 * a.frame AS list_idx, seq, CAST(a.frame * 64 + a.y * 8 + a.x AS BIGINT) AS src, CAST(b.frame * 64 + b.y * 8 + b.x AS BIGINT) AS dst, a.c0, a.c1, a.c2, a.fx, a.fy, b.c0 AS d_c0, b.c1 AS d_c1, b.c2 AS d_c2, b.fx AS d_fx, b.fy AS d_fy
  FROM voxels a CROSS JOIN so JOIN voxels b ON b.frame = a.frame AND b.y = a.y + dy AND b.x = a.x + dx)""",
    "temporal": """tof AS (SELECT row_number() OVER (ORDER BY dy, dx) - 1 AS seq, dy, dx FROM (VALUES (-1), (0), (1)) AS p(dy) CROSS JOIN (VALUES (-1), (0), (1)) AS q(dx)),
temporal AS (SELECT a.frame, 2 * a.frame - 1 AS list_idx, seq, CAST(a.frame * 64 + a.y * 8 + a.x AS BIGINT) AS src, CAST(b.frame * 64 + b.y * 8 + b.x AS BIGINT) AS dst, a.c0, a.c1, a.c2, b.c0 AS d_c0, b.c1 AS d_c1, b.c2 AS d_c2
  FROM voxels a CROSS JOIN tof JOIN voxels b ON b.frame = a.frame - 1 AND b.y = a.y + dy AND b.x = a.x + dx)""",
    "flow_edges": """fof AS (SELECT row_number() OVER (ORDER BY dy, dx) - 1 AS seq, dy, dx FROM (VALUES (-1), (0), (1)) AS p(dy) CROSS JOIN (VALUES (-1), (0), (1)) AS q(dx)),
fvo AS (SELECT *, greatest(0, least(7, CAST(trunc(y + fy) AS INTEGER))) AS py, greatest(0, least(7, CAST(trunc(x + fx) AS INTEGER))) AS px FROM voxels),
flow_edges AS (SELECT a.frame, 2 * a.frame - 1 AS list_idx, seq, CAST(a.frame * 64 + a.y * 8 + a.x AS BIGINT) AS src, CAST(b.frame * 64 + b.y * 8 + b.x AS BIGINT) AS dst, a.c0, a.c1, a.c2, b.c0 AS d_c0, b.c1 AS d_c1, b.c2 AS d_c2
  FROM fvo a CROSS JOIN fof JOIN voxels b ON b.frame = a.frame - 1 AND b.y = a.py + dy AND b.x = a.px + dx)""",
    "region_sizes": """region_sizes AS (SELECT l_suppkey AS id, count(*) AS size FROM lineitem GROUP BY 1)""",
}


def with_views(names: str, body: str) -> str:
    """SQL text of a query over the named views (space separated) and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(SQL[n] for n in order) + (",\n" if body.lstrip().startswith("--cte") else "\n") + body.replace("--cte", "", 1)
