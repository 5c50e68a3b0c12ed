"""The registered queries of the clustering engine and their DuckDB equivalents, over the shared Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointweave.functions.exprs import cell_scale, label_color, scene_color, squared_radius
from pointweave.operators import dbscan as D
from pointweave.operators import index as I
from pointweave.operators import summary as S
from pointweave.operators.noise import far_candidates

# --- clouds -------------------------------------------------------------------------------------------------------


def cloud(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data as points: point_id BIGINT, grp STRING, x, y, z FLOAT."""

    def read(t: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{t}.parquet")

    f = lambda c: c.cast("float")
    if name == "emb":
        e = F.col("embedding")
        return read("embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").cast("string").alias("grp"), *[f(e[i]).alias(c) for i, c in enumerate("xyz")])
    if name == "ev":
        seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000)).cast("long") % F.lit(86400)
        return read("events").select(F.col("event_id").alias("point_id"), F.col("event_type").alias("grp"), f(seconds.cast("double") / 3600.0).alias("x"), f(F.col("value") / 10.0).alias("y"), f(F.col("user_id").cast("double") / 10.0).alias("z"))
    if name == "od":
        days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
        return read("orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_orderstatus").alias("grp"), f(days / 30.0).alias("x"), f(F.col("o_totalprice") / 10000.0).alias("y"), f(F.col("o_custkey").cast("double") / 50.0).alias("z"))
    if name == "li":  # no unique key: points are the distinct positions
        li = read("lineitem").select(f(F.col("l_quantity")).alias("x"), f(F.round(F.col("l_discount") * 100.0)).alias("y"), f(F.round(F.col("l_tax") * 100.0)).alias("z"))
        ident = F.col("x").cast("long") * 10000 + F.col("y").cast("long") * 100 + F.col("z").cast("long")
        return li.withColumn("point_id", ident).withColumn("grp", F.lit("all"))
    raise KeyError(name)


CLOUD_SQL = {
    "emb": "SELECT vec_id AS point_id, CAST(label AS VARCHAR) AS grp, CAST(embedding[1] AS FLOAT) AS x, CAST(embedding[2] AS FLOAT) AS y, CAST(embedding[3] AS FLOAT) AS z FROM embeddings",
    "ev": "SELECT event_id AS point_id, event_type AS grp, CAST(CAST(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) % 86400 AS DOUBLE) / 3600.0::DOUBLE AS FLOAT) AS x, CAST(value / 10.0::DOUBLE AS FLOAT) AS y, CAST(CAST(user_id AS DOUBLE) / 10.0::DOUBLE AS FLOAT) AS z FROM events",
    "od": "SELECT o_orderkey AS point_id, o_orderstatus AS grp, CAST(CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) / 30.0::DOUBLE AS FLOAT) AS x, CAST(o_totalprice / 10000.0::DOUBLE AS FLOAT) AS y, CAST(CAST(o_custkey AS DOUBLE) / 50.0::DOUBLE AS FLOAT) AS z FROM orders",
    "li": "SELECT CAST(l_quantity AS BIGINT) * 10000 + CAST(round(l_discount * 100.0::DOUBLE) AS BIGINT) * 100 + CAST(round(l_tax * 100.0::DOUBLE) AS BIGINT) AS point_id, 'all' AS grp, CAST(l_quantity AS FLOAT) AS x, CAST(round(l_discount * 100.0::DOUBLE) AS FLOAT) AS y, CAST(round(l_tax * 100.0::DOUBLE) AS FLOAT) AS z FROM lineitem",
}

# --- SQL pieces ---------------------------------------------------------------------------------------------------


def _f32(v: float) -> str:
    return f"CAST({float(np.float32(v))!r} AS FLOAT)"


def _voxel(c: str, eps: float) -> str:
    return f"CAST(floor(greatest({_f32(-1048576)}, least({_f32(1048575)}, {c} * {_f32(float(cell_scale(eps)))}))) AS INTEGER)"


def _spread(c: str) -> str:
    return f"list_sum(list_transform(range(21), lambda i: (((CAST({c} AS BIGINT) + 1048576) >> i) & 1) * CAST(pow(8, i) AS BIGINT)))"


MORTON = f"CAST({_spread('vx')} + 2 * {_spread('vy')} + 4 * {_spread('vz')} AS BIGINT)"


def grid_sql(name: str, eps: float) -> str:
    return f"p AS ({CLOUD_SQL[name]}), g AS (SELECT *, {_voxel('x', eps)} AS vx, {_voxel('y', eps)} AS vy, {_voxel('z', eps)} AS vz FROM p)"


def sites_sql(name: str, eps: float, by_group: bool = False) -> str:
    """CTEs s (distinct positions with weight) and e (all neighbour pairs within eps, self included)."""
    k, on = ("grp, ", "AND a.grp = b.grp ") if by_group else ("", "")
    d = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
    return (
        f"{grid_sql(name, eps)}, s AS MATERIALIZED (SELECT {k}x, y, z, vx, vy, vz, count(*) AS w, min(point_id) AS site FROM g GROUP BY ALL), "
        "o AS (SELECT dx.i AS dx, dy.i AS dy, dz.i AS dz FROM range(-1, 2) dx(i), range(-1, 2) dy(i), range(-1, 2) dz(i)), "
        "probe AS (SELECT s.*, vx + dx AS nx, vy + dy AS ny, vz + dz AS nz FROM s, o), "
        f"e AS MATERIALIZED (SELECT a.site AS a, b.site AS b, b.w AS w FROM probe a JOIN s b ON a.nx = b.vx AND a.ny = b.vy AND a.nz = b.vz {on}WHERE {d} <= {_f32(squared_radius(eps))}), "
        "n AS MATERIALIZED (SELECT a AS site, CAST(sum(w) AS BIGINT) AS n FROM e GROUP BY a)"
    )


def label_sql(name: str, eps: float, min_pts: int, by_group: bool = False) -> str:
    """CTEs up to lab: a label for each site."""
    k = "grp, " if by_group else ""
    part = "PARTITION BY grp " if by_group else ""
    return (
        f"WITH RECURSIVE {sites_sql(name, eps, by_group)}, core AS MATERIALIZED (SELECT s.*, {MORTON} AS code FROM s JOIN n USING (site) WHERE n.n >= {min_pts}), "
        "ce AS MATERIALIZED (SELECT a, b FROM e JOIN core c ON e.a = c.site JOIN core d ON e.b = d.site WHERE a <> b), "
        "cc(id, root) USING KEY (id) AS (SELECT site, site FROM core UNION (SELECT ce.b, min(cc.root) FROM cc JOIN ce ON ce.a = cc.id JOIN recurring.cc AS was ON was.id = ce.b WHERE cc.root < was.root GROUP BY ce.b)), "
        f"first AS (SELECT {k}root, min(ROW(code, site)) AS f FROM core JOIN cc ON core.site = cc.id GROUP BY {k}root), "
        f"num AS (SELECT root, row_number() OVER ({part}ORDER BY f) AS label FROM first), "
        "cl AS MATERIALIZED (SELECT id AS site, label FROM cc JOIN num USING (root)), "
        "bl AS (SELECT e.a AS site, min(cl.label) AS label FROM e JOIN cl ON e.b = cl.site WHERE e.a NOT IN (SELECT site FROM core) GROUP BY e.a), "
        f"lab AS MATERIALIZED (SELECT {k}x, y, z, site, site IN (SELECT site FROM core) AS is_core, CAST(coalesce(cl.label, bl.label, 0) AS BIGINT) AS label FROM s LEFT JOIN cl USING (site) LEFT JOIN bl USING (site))"
    )


def points_sql(name: str, eps: float, min_pts: int, by_group: bool = False) -> str:
    same = "AND p.grp = lab.grp " if by_group else ""
    k = "p.grp, " if by_group else ""
    return label_sql(name, eps, min_pts, by_group) + f", pts AS (SELECT {k}p.point_id, CAST(p.x AS DOUBLE) AS x, CAST(p.y AS DOUBLE) AS y, CAST(p.z AS DOUBLE) AS z, lab.is_core, lab.label FROM p JOIN lab ON p.x = lab.x AND p.y = lab.y AND p.z = lab.z {same})"


# --- queries ------------------------------------------------------------------------------------------------------

EMB, EV, LI, OD = ("emb", 0.05, 4), ("ev", 0.5, 5), ("li", 0.5, 14), ("od", 1.0, 5)


def _wide(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in "xyz" if c in df.columns})


def _labels(which, by: str | None = None, **kw):
    name, eps, min_pts = which
    return lambda spark, d: D.dbscan(cloud(spark, d, name), eps, min_pts, by, **kw)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as one scan for each type, with ids that begin anew in each."""
    place = F.row_number().over(Window.partitionBy("grp").orderBy("point_id")).cast("long")
    return cloud(spark, sf_dir, "ev").withColumn("point_id", place)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _dbscan_queries() -> None:
    plan = {"task_points": 0}  # the distributed plan, whatever the size
    for key, which, by in (("dbscan_labels", EMB, None), ("dbscan_events", EV, None), ("dbscan_orders", OD, None), ("dbscan_per_group", ("ev", 1.0, 4), "grp")):
        _add(key, lambda s, d, w=which, b=by: _wide(_labels(w, b)(s, d)), points_sql(*which, by_group=bool(by)) + " SELECT * FROM pts")
    of_scans = points_sql("ev", 1.0, 4, True) + " SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY point_id) AS point_id, x, y, z, is_core, label FROM pts"
    _add("dbscan_scans", lambda s, d: _wide(D.dbscan(scans(s, d), 1.0, 4, "grp")), of_scans)
    _add("dbscan_scans_plan", lambda s, d: _wide(D.dbscan(scans(s, d), 1.0, 4, "grp", task_points=0)), of_scans)
    _add("dbscan_events_plan", lambda s, d: _wide(_labels(EV, task_points=0)(s, d)), points_sql(*EV) + " SELECT * FROM pts")

    def positions(s, d, name, eps, min_pts):
        """Duplicate-heavy input: one row for each distinct position."""
        rows = _wide(_labels((name, eps, min_pts))(s, d))
        return rows.groupBy("x", "y", "z").agg(F.count("*").alias("w"), F.first("is_core").alias("is_core"), F.first("label").alias("label"))

    _add("dbscan_lineitem_duplicates", lambda s, d: positions(s, d, *LI), label_sql(*LI) + " SELECT CAST(lab.x AS DOUBLE) AS x, CAST(lab.y AS DOUBLE) AS y, CAST(lab.z AS DOUBLE) AS z, s.w, lab.is_core, lab.label FROM lab JOIN s USING (site)")
    _add("core_points", lambda s, d: _labels(EMB)(s, d).where("is_core").select("point_id"), points_sql(*EMB) + " SELECT point_id FROM pts WHERE is_core")
    _add("core_components", lambda s, d: _labels(EV, **plan)(s, d).where("is_core").select("point_id", "label"), points_sql(*EV) + " SELECT point_id, label FROM pts WHERE is_core")
    _add("border_points", lambda s, d: _labels(EV, **plan)(s, d).where("not is_core and label > 0").select("point_id", "label"), points_sql(*EV) + " SELECT point_id, label FROM pts WHERE NOT is_core AND label > 0")
    _add("noise_points", lambda s, d: _labels(EMB)(s, d).where("label = 0").select("point_id"), points_sql(*EMB) + " SELECT point_id FROM pts WHERE label = 0")
    _add("min_pts_one", lambda s, d: _labels(("emb", 0.05, 1), **plan)(s, d).select("point_id", "label"), points_sql("emb", 0.05, 1) + " SELECT point_id, label FROM pts")
    _add("cluster_sizes", lambda s, d: S.cluster_sizes(_labels(EV)(s, d)), points_sql(*EV) + " SELECT label, count(*) AS size FROM pts WHERE label > 0 GROUP BY label")
    _add("cluster_summary", lambda s, d: S.cluster_summary(_labels(EMB)(s, d)), points_sql(*EMB) + " SELECT count(*) AS points, coalesce(max(label), 0) AS clusters, count(DISTINCT CASE WHEN label > 0 THEN label END) AS distinct_clusters, count(*) FILTER (label = 0) AS noise FROM pts")
    _add("group_summary", lambda s, d: S.cluster_summary(_labels(("ev", 1.0, 4), "grp")(s, d), ("grp",)), points_sql("ev", 1.0, 4, True) + " SELECT grp, count(*) AS points, coalesce(max(label), 0) AS clusters, count(DISTINCT CASE WHEN label > 0 THEN label END) AS distinct_clusters, count(*) FILTER (label = 0) AS noise FROM pts GROUP BY grp")
    _add("label_histogram", lambda s, d: _labels(OD, **plan)(s, d).groupBy("label", "is_core").agg(F.count("*").alias("n")), points_sql(*OD) + " SELECT label, is_core, count(*) AS n FROM pts GROUP BY ALL")
    _add("size_profile", lambda s, d: S.size_profile(_labels(EMB)(s, d)).select("sizes_text"), points_sql(*EMB) + ", c AS (SELECT count(*) AS size FROM pts WHERE label > 0 GROUP BY label) SELECT coalesce(string_agg(CAST(size AS VARCHAR), ',' ORDER BY size), '') AS sizes_text FROM c")
    _add("split_output_manifest", lambda s, d: _labels(EMB)(s, d).groupBy("label").agg(F.count("*").alias("lines")).select(F.when(F.col("label") == 0, "noise.xyz").otherwise(F.concat(F.lit("cluster_"), F.col("label").cast("string"), F.lit(".xyz"))).alias("file"), "lines"), points_sql(*EMB) + " SELECT CASE WHEN label = 0 THEN 'noise.xyz' ELSE 'cluster_' || label || '.xyz' END AS file, count(*) AS lines FROM pts GROUP BY label")
    rgb = ["CAST(r AS INTEGER) AS r", "CAST(g AS INTEGER) AS g", "CAST(b AS INTEGER) AS b"]
    for key, f, sql in (("label_colors_cli", label_color, _color_sql(False)), ("label_colors_script", scene_color, _color_sql(True))):
        _add(key, lambda s, d, f=f: _labels(EV)(s, d).select("label").distinct().select("label", f().alias("c")).select("label", *[F.col(f"c.{n}").cast("int").alias(n) for n in "rgb"]), points_sql(*EV) + f", l AS (SELECT DISTINCT label FROM pts), {sql} SELECT label, {', '.join(rgb)} FROM c")
    _add("xyz_lines", lambda s, d: _wide(_labels(EMB)(s, d)).select("point_id", F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("line")), points_sql(*EMB) + " SELECT point_id, printf('%.6f %.6f %.6f', x, y, z) AS line FROM pts")


def _color_sql(scene: bool) -> str:
    if scene:
        one, v, s, hue, grey, cond = "1.0::DOUBLE", "0.90::DOUBLE", "0.75::DOUBLE", "fmod(CAST(label AS DOUBLE) * 0.6180339887498948::DOUBLE, 1.0::DOUBLE) * 6.0::DOUBLE", 128, "label < 0"
        fin, kind = (lambda c: f"round_even({c} * 255.0::DOUBLE, 0)"), "DOUBLE"
    else:
        one, v, s, hue, grey, cond = _f32(1), _f32(0.95), _f32(0.75), f"fmod(CAST(label AS FLOAT) * {_f32(0.6180339887498948)}, {_f32(1)}) * {_f32(360)} / {_f32(60)}", 96, "label = 0"
        fin, kind = (lambda c: f"round(greatest({_f32(0)}, least({_f32(255)}, {c} * {_f32(255)})))"), "FLOAT"
    h = f"h AS (SELECT label, CAST({hue} AS {kind}) AS u FROM l), f AS (SELECT label, CAST(floor(u) AS INTEGER) AS k, u - CAST(floor(u) AS {kind}) AS f FROM h), "
    q = f"q AS (SELECT label, k, {v} AS v, {v} * ({one} - {s}) AS p, {v} * ({one} - {s} * f) AS q, {v} * ({one} - {s} * ({one} - f)) AS t FROM f), "
    table = (("v", "t", "p"), ("q", "v", "p"), ("p", "v", "t"), ("p", "q", "v"), ("t", "p", "v"), ("v", "p", "q"))
    channel = lambda i: f"CASE WHEN {cond} THEN {grey} ELSE {fin('CASE k ' + ' '.join(f'WHEN {k} THEN {row[i]}' for k, row in enumerate(table)) + ' ELSE v END')} END"
    return h + q + f"c AS (SELECT label, {channel(0)} AS r, {channel(1)} AS g, {channel(2)} AS b FROM q)"


def _index_queries() -> None:
    name, eps, _ = EV
    g = f"WITH {grid_sql(name, eps)} "
    _add("quantize_voxels", lambda s, d: I.quantize(cloud(s, d, name), eps).select("point_id", "vx", "vy", "vz"), g + "SELECT point_id, vx, vy, vz FROM g")
    _add("morton_codes", lambda s, d: I.with_morton(cloud(s, d, name), eps).select("point_id", "morton_code"), g + f"SELECT point_id, {MORTON} AS morton_code FROM g")
    _add("sorted_positions", lambda s, d: I.sorted_positions(cloud(s, d, name), eps).select("point_id", "sorted_pos"), g + f", m AS (SELECT point_id, {MORTON} AS c FROM g) SELECT point_id, row_number() OVER (ORDER BY c, point_id) - 1 AS sorted_pos FROM m")
    _add("sorted_positions_per_group", lambda s, d: I.sorted_positions(cloud(s, d, name), eps, ("grp",)).select("grp", "point_id", "sorted_pos"), g + f", m AS (SELECT grp, point_id, {MORTON} AS c FROM g) SELECT grp, point_id, row_number() OVER (PARTITION BY grp ORDER BY c, point_id) - 1 AS sorted_pos FROM m")
    spans = f", sp AS (SELECT vx, vy, vz, {MORTON} AS morton_code, count(*) AS len FROM g GROUP BY ALL), v AS (SELECT *, row_number() OVER (ORDER BY morton_code) - 1 AS voxel_idx, CAST(sum(len) OVER (ORDER BY morton_code) - len AS BIGINT) AS start FROM sp)"
    _add("voxel_spans", lambda s, d: I.voxel_spans(cloud(s, d, name), eps).select("voxel_idx", "start", "len", "morton_code", "vx", "vy", "vz"), g + spans + " SELECT voxel_idx, start, len, morton_code, vx, vy, vz FROM v")
    _add("voxel_neighbor_lut", lambda s, d: I.neighbor_lut(I.voxel_spans(cloud(s, d, "emb"), 0.05)), f"WITH {grid_sql('emb', 0.05)}" + spans + ", o AS (SELECT dx.i AS dx, dy.i AS dy, dz.i AS dz, CAST((dz.i + 1) * 9 + (dy.i + 1) * 3 + dx.i + 1 AS INTEGER) AS slot FROM range(-1, 2) dx(i), range(-1, 2) dy(i), range(-1, 2) dz(i)) SELECT a.voxel_idx, o.slot, b.voxel_idx AS neighbor_idx FROM v a CROSS JOIN o LEFT JOIN v b ON b.vx = a.vx + o.dx AND b.vy = a.vy + o.dy AND b.vz = a.vz + o.dz")
    _add("voxel_occupancy_stats", lambda s, d: I.occupancy(I.voxel_spans(cloud(s, d, name), eps)), g + spans + " SELECT count(*) AS n_voxels, avg(len) AS avg_len, coalesce(max(len), 0) AS max_len FROM v")
    _add("point_to_voxel", lambda s, d: I.quantize(cloud(s, d, name), eps).join(I.voxel_spans(cloud(s, d, name), eps), ["vx", "vy", "vz"]).select("point_id", "voxel_idx"), g + spans + " SELECT point_id, voxel_idx FROM g JOIN v USING (vx, vy, vz)")
    p = f"WITH p AS ({CLOUD_SQL['ev']}) "
    _add("bounding_box", lambda s, d: S.bounding_box(cloud(s, d, "ev"), 2.5), p + "SELECT " + ", ".join(f"CAST({n}({c}) AS DOUBLE) {sign} 2.5::DOUBLE AS {n}_{c}" for c in "xyz" for n, sign in (("min", "-"), ("max", "+"))) + " FROM p")
    _add("centroid", lambda s, d: S.centroid(cloud(s, d, "li")).select(*[F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in "xyz"]), f"WITH p AS ({CLOUD_SQL['li']}) SELECT " + ", ".join(f"round(avg(CAST({c} AS DOUBLE)), 6) AS mean_{c}" for c in "xyz") + " FROM p")
    _add("point_count", lambda s, d: cloud(s, d, "li").agg(F.count("*").alias("points")), f"WITH p AS ({CLOUD_SQL['li']}) SELECT count(*) AS points FROM p")
    _add("epsilon_pairs", lambda s, d: D.epsilon_pairs(cloud(s, d, "emb"), 0.05), f"WITH p AS ({CLOUD_SQL['emb']}) SELECT a.point_id AS a, b.point_id AS b FROM p a JOIN p b ON a.point_id < b.point_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {_f32(squared_radius(0.05))}")

    def counts(s, d):
        grid = D.sites(cloud(s, d, "li"), 0.5)
        return _wide(D.neighbor_counts(grid, D.site_pairs(grid, 0.5))).select("x", "y", "z", "w", "n")

    _add("neighbor_counts", counts, f"WITH {sites_sql('li', 0.5)} SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, w, n FROM s JOIN n USING (site)")
    _add("recentred", lambda s, d: _wide(S.recentre(cloud(s, d, "od"))).select("point_id", *[F.round(c, 2).alias(c) for c in "xyz"]), f"WITH p AS ({CLOUD_SQL['od']}), c AS (SELECT CAST(avg(CAST(x AS DOUBLE)) AS FLOAT) AS a, CAST(avg(CAST(y AS DOUBLE)) AS FLOAT) AS b, CAST(avg(CAST(z AS DOUBLE)) AS FLOAT) AS d FROM p) SELECT point_id, " + ", ".join(f"round(CAST({n} - {m} AS DOUBLE), 2) AS {n}" for n, m in zip("xyz", "abd", strict=True)) + " FROM p, c")
    far = "(c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y) + (c.z - o.z) * (c.z - o.z)"
    _add("noise_candidates_anti_join", lambda s, d: far_candidates(cloud(s, d, "ev"), cloud(s, d, "od"), 1.0).select("point_id"), f"WITH c AS ({CLOUD_SQL['ev']}), o AS ({CLOUD_SQL['od']}) SELECT point_id FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE {far} < {_f32(1.0)})")

    def stride(s, d):
        files = cloud(s, d, "emb").select(F.format_string("scan_%06d.bin", "point_id").alias("path"))
        from pointweave.sources.scans import every_nth

        return every_nth(files, "path", 7, 20)

    _add("scan_select_stride", stride, "WITH f AS (SELECT printf('scan_%06d.bin', vec_id) AS path FROM embeddings), r AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS k FROM f) SELECT path FROM r WHERE k % 7 = 0 AND k // 7 < 20")


_dbscan_queries()
_index_queries()
