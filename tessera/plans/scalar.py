"""Queries of the scalar functions and per-frame transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import pixel as px
from tessera.operators import graph
from tessera.plans import fixtures as fx

QUERIES, ORACLE = {}, {}


def _edges(kind: str):
    def make(spark, sf_dir):
        vox = fx.voxels(spark, sf_dir)
        cols = ["c0", "c1", "c2", "fx", "fy"]
        if kind == "spatial":
            return graph.spatial_edges(vox, 8, 8, cols)
        return graph.temporal_edges(vox, 8, 8, cols[:3], flow=kind == "flow_edges")

    return make


def _edge(name: str, cols: dict, kind: str = "spatial") -> None:
    """Query ``name``: rounded columns over the edges of a kind; cols: name -> (Column maker, SQL)."""
    def run(spark, sf_dir):
        e = _edges(kind)(spark, sf_dir)
        return e.select("src", "dst", *[F.round(make(), 6).alias(c) for c, (make, _) in cols.items()])

    QUERIES[name] = run
    ORACLE[name] = fx.with_views(kind, "SELECT src, dst, " + ", ".join(f"round({sql}, 6) AS {c}" for c, (_, sql) in cols.items()) + f" FROM {kind}")


def _c(*names):
    return [F.col(n) for n in names]


def A():
    return _c("c0", "c1", "c2")


def B():
    return _c("d_c0", "d_c1", "d_c2")


L1 = "(abs(c0 - d_c0) + abs(c1 - d_c1) + abs(c2 - d_c2)) / 3e0"
L2 = "sqrt(((c0 - d_c0) * (c0 - d_c0) + (c1 - d_c1) * (c1 - d_c1) + (c2 - d_c2) * (c2 - d_c2)) / 3e0)"
G2 = "least(1e0, 10e0 * sqrt(((fx - d_fx) * (fx - d_fx) + (fy - d_fy) * (fy - d_fy)) / 2e0))"
G1 = "(abs(fx - d_fx) + abs(fy - d_fy)) / 2e0"
FLOW, DFLOW = ("fx", "fy"), ("d_fx", "d_fy")
_edge("k01_colour_l1", {"d": (lambda: px.l1_colour(A(), B()), L1)})
_edge("k02_colour_l2", {"d": (lambda: px.l2_colour(A(), B()), L2)})
_edge("k03_gradient_distances", {"l2": (lambda: px.l2_gradient(_c(*FLOW), _c(*DFLOW)), G2), "l1": (lambda: px.l1_gradient(_c(*FLOW), _c(*DFLOW)), G1)})
_edge("k04_constant_distance", {"d": (lambda: F.lit(0.25), "0.25e0")})
_edge("k05_aggregators", {
    "linear": (lambda: px.linear(px.l1_colour(A(), B()), px.l2_colour(A(), B()), 0.7, 0.3), f"0.7e0 * ({L1}) + 0.3e0 * {L2}"),
    "independent": (lambda: px.independent(px.l1_colour(A(), B()), px.l2_colour(A(), B())), f"1e0 - (1e0 - ({L1})) * (1e0 - {L2})"),
    "root": (lambda: px.root(px.l1_colour(A(), B()), px.l2_colour(A(), B())), f"sqrt(({L1}) * ({L1}) + {L2} * {L2}) * 0.70711e0")})
_edge("k06_aggregated_distance", {
    "d": (lambda: px.linear(px.l2_colour(A(), B()), px.l2_gradient(_c(*FLOW), _c(*DFLOW))), f"0.5e0 * {L2} + 0.5e0 * {G2}")})
_edge("k07_descriptor_distances", {
    "colour_mean": (lambda: px.colour_mean_distance(A(), B(), px.l2_colour(A(), B()), 0.05), f"CASE WHEN {L2} < 0.05e0 AND {L2} < 0.2e0 THEN 0e0 ELSE {L2} END"),
    "gradient": (lambda: px.l2_gradient(_c(*FLOW), _c(*DFLOW)), G2),
    "mean_variance": (lambda: px.mean_variance_distance(A(), B(), [F.abs(F.col("fx")) / 8.0, F.abs(F.col("fy")) / 8.0, F.lit(0.0)]),
                      "least(1e0, 0.2e0 * sqrt((c0 - d_c0) * (c0 - d_c0) / greatest(1e-4, abs(fx) / 8e0) + (c1 - d_c1) * (c1 - d_c1) / greatest(1e-4, abs(fy) / 8e0) + (c2 - d_c2) * (c2 - d_c2) / greatest(1e-4, 0e0)))")})
_edge("k08_merge_test_flags", {"a_small": (lambda: (F.col("c0") < 0.4).cast("int") * 1.0, "CASE WHEN c0 < 0.4e0 THEN 1e0 ELSE 0e0 END"),
                               "any_small": (lambda: ((F.col("c0") < 0.4) | (F.col("d_c0") < 0.4)).cast("int") * 1.0, "CASE WHEN c0 < 0.4e0 OR d_c0 < 0.4e0 THEN 1e0 ELSE 0e0 END")})
_edge("k14_squared_or", {"d": (lambda: px.squared_or([px.l1_colour(A(), B()), px.l2_colour(A(), B())]), f"power(1e0 - (1e0 - ({L1})) * (1e0 - {L2}), 2)")})
_edge("k15_squared_or_penalised", {
    "d": (lambda: px.clamp01(px.squared_or([px.l1_colour(A(), B()), px.l2_colour(A(), B())]) * px.size_penalty(F.col("src") + 1.0, F.lit(2000.0))),
          f"greatest(0e0, least(1e0, power(1e0 - (1e0 - ({L1})) * (1e0 - {L2}), 2) * least(1e0, 1e0 + 0.25e0 * log2((src + 1e0) / 2000e0))))")})
_edge("k17_colour_diff_uint8", {"d": (lambda: F.lit(0.0) + F.abs((F.col("c0") * 255).cast("int") - (F.col("d_c0") * 255).cast("int")) + F.abs((F.col("c1") * 255).cast("int") - (F.col("d_c1") * 255).cast("int")) + F.abs((F.col("c2") * 255).cast("int") - (F.col("d_c2") * 255).cast("int")),
                                      "0e0 + abs(CAST(trunc(c0 * 255) AS INTEGER) - CAST(trunc(d_c0 * 255) AS INTEGER)) + abs(CAST(trunc(c1 * 255) AS INTEGER) - CAST(trunc(d_c1 * 255) AS INTEGER)) + abs(CAST(trunc(c2 * 255) AS INTEGER) - CAST(trunc(d_c2 * 255) AS INTEGER))")})


def _view(name: str, view: str, source, cols: dict, where: str = "") -> None:
    """Query ``name``: columns over a fixture; cols: name -> (Column maker, SQL)."""
    def run(spark, sf_dir):
        df = source(spark, sf_dir)
        df = df.filter(where) if where else df
        return df.select(*[make().alias(c) for c, (make, _) in cols.items()])

    QUERIES[name] = run
    body = "SELECT " + ", ".join(f"{sql} AS {c}" for c, (_, sql) in cols.items())
    ORACLE[name] = (fx.with_views(view, f"{body} FROM {view}") if view in fx.SQL else f"{body} FROM {view}") + (f" WHERE {where}" if where else "")


def _k(n):
    return (lambda: F.col(n), n)


KEY = {c: _k(c) for c in ("frame", "y", "x")}
u8 = lambda c: (F.col(c) * 255.0).cast("int")
S8 = lambda c: f"CAST(trunc({c} * 255e0) AS INTEGER)"
r6 = lambda c: F.round(c, 6)
_view("c01_luminance", "voxels", fx.voxels, {**KEY, "gray": (lambda: r6(px.luminance(*_c("c0", "c1", "c2"))), "round(0.299e0 * c0 + 0.587e0 * c1 + 0.114e0 * c2, 6)")})
_view("c02_flip_bgr", "voxels", fx.voxels, {**KEY, "b": (lambda: r6(F.col("c2")), "round(c2, 6)"), "g": (lambda: r6(F.col("c1")), "round(c1, 6)"), "r": (lambda: r6(F.col("c0")), "round(c0, 6)")})
_view("c03_color_twist", "voxels", fx.voxels, {**KEY, **{f"t{i}": (lambda i=i, w=w, o=o: px.twist(u8(f"c{i}"), w, o), f"CAST(trunc(greatest(0e0, least(255e0, {S8(f'c{i}')} * {w}e0 + {o}e0))) AS INTEGER)") for i, (w, o) in enumerate(((1.2, -10.0), (0.8, 5.0), (2.5, -90.0)))}})
_view("c04_scale_to_unit", "voxels", fx.voxels, {**KEY, "v": (lambda: r6(u8("c0") / 255.0), f"round({S8('c0')} / 255e0, 6)")})
_view("c08_flow_to_hsv", "voxels", fx.voxels, {**KEY, "hue": (lambda: r6((F.atan2("fy", "fx") / 3.141592653589793 + 1.0) * 90.0), "round((atan2(fy, fx) / 3.141592653589793e0 + 1e0) * 90e0, 6)"),
      "sat": (lambda: r6(F.least(F.lit(255.0), 20.0 * F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy")))), "round(least(255e0, 20e0 * sqrt(fx * fx + fy * fy)), 6)")})
_view("c10_channel_split", "voxels", fx.voxels, {**KEY, "flow_x": (lambda: r6(F.col("fx")), "round(fx, 6)"), "flow_y": (lambda: r6(F.col("fy")), "round(fy, 6)")})
_view("c11_frame_features", "voxels", fx.voxels, {**KEY, "c0": (lambda: r6(F.col("c0")), "round(c0, 6)"), "fx": (lambda: F.when(F.col("frame") > 0, r6(F.col("fx"))), "CASE WHEN frame > 0 THEN round(fx, 6) END")})
_view("c12_gradient_descriptor", "voxels", fx.voxels, {**KEY, "g0": (lambda: r6(F.abs(F.col("fx"))), "round(abs(fx), 6)"), "g1": (lambda: r6(F.when(F.col("fx") < 0, -F.col("fy")).otherwise(F.col("fy"))), "round(CASE WHEN fx < 0 THEN -fy ELSE fy END, 6)")})
_view("k12_norm_angle", "voxels", fx.voxels, {**KEY, "a": (lambda: r6(px.norm_angle(F.col("fx"), F.col("fy"))), "round(atan2(fy, fx) / (2e0 * 3.141592653589793e0 + 1e-4) + 0.5e0, 6)")})
_view("k13_gain_change", "voxels", fx.voxels, {**KEY, "g": (lambda: r6(px.gain_change(F.col("c0"), F.col("c1"))), "round(c0 / (c1 + 1e-3), 6)"),
      "above": (lambda: (px.gain_change(F.col("c0"), F.col("c1")) > 1.1) | (px.gain_change(F.col("c0"), F.col("c1")) < 1.0 / 1.1), "(c0 / (c1 + 1e-3) > 1.1e0 OR c0 / (c1 + 1e-3) < 1e0 / 1.1e0)")})
_view("k16_size_penalizer", "region_sizes", fx.region_sizes, {"id": _k("id"), "p": (lambda: r6(px.size_penalty(F.col("size").cast("double"), F.lit(600.0))), "round(least(1e0, 1e0 + 0.25e0 * log2(CAST(size AS DOUBLE) / 600e0)), 6)")})
_view("k18_point_helpers", "voxels", fx.voxels, {**KEY, "tx": (lambda: F.col("fx").cast("int"), "CAST(trunc(fx) AS INTEGER)"),
      "rx": (lambda: r6(F.cos(F.lit(0.5)) * F.col("fx") - F.sin(F.lit(0.5)) * F.col("fy")), "round(cos(0.5e0) * fx - sin(0.5e0) * fy, 6)"),
      "ry": (lambda: r6(F.sin(F.lit(0.5)) * F.col("fx") + F.cos(F.lit(0.5)) * F.col("fy")), "round(sin(0.5e0) * fx + cos(0.5e0) * fy, 6)"),
      "nx": (lambda: r6(F.try_divide(F.col("fx"), F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy")))), "round(fx / nullif(sqrt(fx * fx + fy * fy), 0), 6)"),
      "hx": (lambda: r6(F.when(F.col("c2") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("fx"), F.col("c2")))), "round(CASE WHEN c2 = 0 THEN 0e0 ELSE fx / c2 END, 6)")})
_view("k19_unordered_keys", "region_graph", fx.region_pairs, {"lo": (lambda: F.least("src", "dst"), "least(src, dst)"), "hi": (lambda: F.greatest("src", "dst"), "greatest(src, dst)"), "key": (lambda: F.least("src", "dst") * 1000003 + F.greatest("src", "dst"), "least(src, dst) * 1000003 + greatest(src, dst)")})
_view("k21_string_printf", "frame_stream", fx.frame_stream, {"video_id": _k("video_id"), "name": (lambda: F.format_string("frame%05d.pbtxt", F.col("frame")), "printf('frame%05d.pbtxt', frame)")})
_view("k24_channels", "nation", lambda s, d: fx.table(s, d, "nation"), {"n_nationkey": _k("n_nationkey"),
      "channels": (lambda: px.channels(F.element_at(F.array(*[F.lit(k) for k in px.CHANNELS]), (F.col("n_nationkey") % 8 + 1).cast("int"))), "CASE n_nationkey % 8 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 4 END")})
_view("k25_align_stride", "region_sizes", fx.region_sizes, {"id": _k("id"), "stride": (lambda: px.align(F.col("size") * 3), "CAST(ceil(size * 3 / 4e0) * 4 AS INTEGER)")})
_part = "(id % 11) / 10e0"
_view("k22_level_rules", "region_sizes", fx.region_sizes, {"id": _k("id"), **{n: (lambda n=n: px.level_rules((F.col("id") % 11) / 10.0, F.lit(5))[n], sql) for n, sql in {
      "converter": f"CASE WHEN {_part} = 0 OR {_part} >= 1 THEN CAST(trunc({_part}) AS INTEGER) ELSE CAST(trunc({_part} * 5) AS INTEGER) END",
      "renderer": f"CAST(trunc({_part} * 5) AS INTEGER)",
      "unit": f"least(4, CASE WHEN {_part} = floor({_part}) THEN CAST(trunc({_part}) AS INTEGER) ELSE CAST(trunc({_part} * 5) AS INTEGER) END)",
      "viewer": f"CAST(trunc({_part} * 4) AS INTEGER)"}.items()}})
_view("a02_fps_rule", "region_sizes", fx.region_sizes, {"id": _k("id"), "fps": (lambda: r6(px.sane_fps(F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("size") / 10.0))), "round(greatest(5e0, least(60e0, CASE WHEN id % 5 = 0 THEN 24e0 ELSE size / 10e0 END)), 6)")})
_view("a03_downscale", "region_sizes", fx.region_sizes, {"id": _k("id"),
      "w": (lambda: px.downscale(F.col("size"), F.col("size") * 3, F.lit(360.0) / F.col("size"))[0], "CAST(ceil(size * least(1e0, 360e0 / size)) AS INTEGER) + CAST(ceil(size * least(1e0, 360e0 / size)) AS INTEGER) % 2"),
      "h": (lambda: px.downscale(F.col("size"), F.col("size") * 3, F.lit(360.0) / F.col("size"))[1], "CAST(ceil(size * 3 * least(1e0, 360e0 / size)) AS INTEGER)")})
_view("a04_trim_frames", "frame_stream", fx.frame_stream, {c: _k(c) for c in ("video_id", "frame", "pts")}, "frame < 40")
_view("a05_seek_pts", "frame_stream", fx.frame_stream, {c: _k(c) for c in ("video_id", "frame", "pts")}, f"pts >= {1_705_000_000_000_000 + int(3 / 25 * 1e6)}")
_view("a11_project_json", "project_labels", fx.project_labels, {"label": _k("label"), "id": _k("id"), "event_id": _k("event_id"),
      "r": (lambda: F.shiftright("color", 16).bitwiseAND(255), "(color >> 16) & 255"), "g": (lambda: F.shiftright("color", 8).bitwiseAND(255), "(color >> 8) & 255"), "b": (lambda: F.col("color").bitwiseAND(255), "color & 255")})
_view("b05_writer_size", "region_sizes", fx.region_sizes, {"id": _k("id"), "w": (lambda: px.to_fraction(F.col("size"), 16), "CASE WHEN size % 16 < 8 THEN size - size % 16 ELSE size - size % 16 + 16 END")})
_view("b08_bitmap_ids", "project_labels", fx.project_labels, {"event_id": _k("event_id"), "b0": (lambda: F.col("event_id").bitwiseAND(255), "event_id & 255"), "b1": (lambda: F.shiftright("event_id", 8).bitwiseAND(255), "(event_id >> 8) & 255"), "b2": (lambda: F.shiftright("event_id", 16).bitwiseAND(255), "(event_id >> 16) & 255")})
_view("b10_strip_chunks", "frame_stream", fx.frame_stream, {"video_id": _k("video_id"), "frame": _k("frame"), "chunk": (lambda: F.expr("cast(greatest(frame - 1, 0) div 100 as int)"), "CAST(greatest(frame - 1, 0) // 100 AS INTEGER)")})
_view("i07_max_frames", "frame_stream", fx.frame_stream, {c: _k(c) for c in ("video_id", "frame", "pts")}, "frame < 100")
_view("n05_rate_policy", "frame_stream", fx.frame_stream, {"video_id": _k("video_id"), "frame": _k("frame"),
      "scale": (lambda: r6(F.greatest(F.lit(0.2), F.pow(F.lit(0.5), F.greatest(F.lit(0), F.col("frame") % 40 - 10) / 10.0))), "round(greatest(0.2e0, power(0.5e0, greatest(0, frame % 40 - 10) / 10e0)), 6)")})
_view("n06_back_pressure", "frame_stream", fx.frame_stream, {"video_id": _k("video_id"), "frame": _k("frame"), "rate": (lambda: F.when(F.col("frame") % 40 > 10, F.lit(2.0)).otherwise(F.lit(20.0)), "CASE WHEN frame % 40 > 10 THEN 2e0 ELSE 20e0 END")})
_view("n09_chunk_plan", "frame_stream", fx.frame_stream, {"video_id": _k("video_id"), "frame": _k("frame"), "chunk_id": (lambda: F.expr("cast(frame div 19 as int)"), "CAST(frame // 19 AS INTEGER)"), "hierarchy_frame_idx": (lambda: F.expr("cast(19 * (frame div 19) as int)"), "CAST(19 * (frame // 19) AS INTEGER)")})


def _normalised(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLE[name] = run, sql


def _mean_history(spark, sf_dir):
    m = fx.voxels(spark, sf_dir).groupBy("frame").agg(F.avg("c0").alias("m"))
    # Frames are numbered without gaps, so the mean k frames ago is an equi-join away.
    out = m.select("frame", F.round("m", 6).alias("m0"))
    for k in (1, 2):
        out = out.join(m.select((F.col("frame") + k).alias("frame"), F.round("m", 6).alias(f"m{k}")), "frame", "left")
    return out


_normalised("c09_mean_history", _mean_history, fx.with_views("voxels", "--cte m AS (SELECT frame, avg(c0) AS m FROM voxels GROUP BY frame) SELECT frame, " + ", ".join(f"round(lag(m, {k}) OVER (ORDER BY frame), 6) AS m{k}" for k in range(3)) + " FROM m"))


def _stencil(spark, sf_dir):
    """3 x 3 Gaussian with replicated borders, separable weights."""
    import math

    g = [math.exp(-d * d / (2 * 1.5 * 1.5)) for d in (-1, 0, 1)]
    g = [x / sum(g) for x in g]
    vox = fx.voxels(spark, sf_dir)
    offs = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(g[a + 1] * g[b + 1]).alias("w")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    at = vox.select("frame", "y", "x", offs.alias("o")).select("frame", "y", "x", "o.w", F.greatest(F.lit(0), F.least(F.lit(7), F.col("y") + F.col("o.dy"))).alias("ny"), F.greatest(F.lit(0), F.least(F.lit(7), F.col("x") + F.col("o.dx"))).alias("nx"))
    src = vox.select("frame", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("c0").alias("v"))
    return at.join(src, ["frame", "ny", "nx"]).groupBy("frame", "y", "x").agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("smooth"))


_normalised("c05_gaussian_3x3", _stencil, fx.with_views("voxels", """--cte g0 AS (SELECT d, exp(-d * d / 4.5e0) AS e FROM (VALUES (-1), (0), (1)) AS t(d)), g AS (SELECT d, e / sum(e) OVER () AS w FROM g0)
SELECT a.frame, a.y, a.x, round(sum(p.w * q.w * b.c0), 6) AS smooth FROM voxels a CROSS JOIN g p CROSS JOIN g q JOIN voxels b ON b.frame = a.frame AND b.y = greatest(0, least(7, a.y + p.d)) AND b.x = greatest(0, least(7, a.x + q.d)) GROUP BY a.frame, a.y, a.x"""))


def _bilateral(spark, sf_dir, sigma_space=1.0, sigma_colour=0.25):
    """Bilateral filter over a disc of radius int(1.5 sigma), borders replicated."""
    r = int(1.5 * sigma_space)
    cells = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]
    vox = fx.voxels(spark, sf_dir)
    offs = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in cells]))
    at = vox.select("frame", "y", "x", "c0", "c1", "c2", offs.alias("o")).withColumns({"ny": F.greatest(F.lit(0), F.least(F.lit(7), F.col("y") + F.col("o.dy"))), "nx": F.greatest(F.lit(0), F.least(F.lit(7), F.col("x") + F.col("o.dx")))})
    src = vox.select("frame", F.col("y").alias("ny"), F.col("x").alias("nx"), *[F.col(c).alias(f"d_{c}") for c in ("c0", "c1", "c2")])
    d2 = px.total([(F.col(c) - F.col(f"d_{c}")) * (F.col(c) - F.col(f"d_{c}")) for c in ("c0", "c1", "c2")])
    s2 = F.col("o.dy") * F.col("o.dy") + F.col("o.dx") * F.col("o.dx")
    w = F.exp(-s2 / (2.0 * sigma_space * sigma_space)) * F.exp(-d2 / (2.0 * sigma_colour * sigma_colour))
    return at.join(src, ["frame", "ny", "nx"]).withColumn("w", w).groupBy("frame", "y", "x").agg(F.round(F.sum(F.col("w") * F.col("d_c0")) / F.sum("w"), 6).alias("c0"))


_normalised("c06_bilateral", _bilateral, fx.with_views("voxels", """--cte o AS (SELECT dy, dx FROM (VALUES (-1), (0), (1)) AS p(dy) CROSS JOIN (VALUES (-1), (0), (1)) AS q(dx) WHERE dy * dy + dx * dx <= 1),
j AS (SELECT a.frame, a.y, a.x, b.c0 AS v, exp(-(dy * dy + dx * dx) / 2e0) * exp(-((a.c0 - b.c0) * (a.c0 - b.c0) + (a.c1 - b.c1) * (a.c1 - b.c1) + (a.c2 - b.c2) * (a.c2 - b.c2)) / (2e0 * 0.25e0 * 0.25e0)) AS w
FROM voxels a CROSS JOIN o JOIN voxels b ON b.frame = a.frame AND b.y = greatest(0, least(7, a.y + dy)) AND b.x = greatest(0, least(7, a.x + dx))) SELECT frame, y, x, round(sum(w * v) / sum(w), 6) AS c0 FROM j GROUP BY frame, y, x"""))
