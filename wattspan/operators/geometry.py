"""Plane geometry on tables: lines cut where buses touch them, convex hulls, Voronoi cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.operators.stored import spread, stored

#: Metres of a degree of latitude, and of longitude at the equator.
LAT_M, LON_M = 110_540.0, 111_320.0
#: Vertices of a line in one block of a running length.
VERTICES = 1024
#: Segments in a task that makes the cells they cross.
SEGMENTS = 200_000


def segments(vertices: DataFrame, line: str, seq: str, lat: str, lon: str) -> DataFrame:
    """``line, seq`` and, in metres around each line's mean latitude, ``x1, y1, x2, y2``, the running length ``s0`` before and
    ``length`` of each segment; ``lat1 .. lon2`` and ``lon_m`` (metres of a degree of longitude there).

    ``seq`` numbers a line's vertices without gaps. A line's length is summed by blocks, so a long line is not one task.
    """
    v = vertices.select(F.col(line).alias("line"), F.col(seq).cast("long").alias("seq"), F.col(lat).alias("lat1"), F.col(lon).alias("lon1"))
    middle = v.groupBy("line").agg((LON_M * F.cos(F.radians(F.avg("lat1")))).alias("lon_m"))
    # A block's last segment ends at the first vertex of the next block, which is in both.
    block = F.floor(F.col("seq") / VERTICES)
    shared = F.when(F.col("seq") % VERTICES == 0, F.array(block - 1, block)).otherwise(F.array(block))
    w = Window.partitionBy("line", "_block").orderBy("seq")
    s = v.join(middle, "line").withColumn("_block", F.explode(shared))
    s = s.withColumns({"_next": F.lead("seq").over(w), "lat2": F.lead("lat1").over(w), "lon2": F.lead("lon1").over(w)}).where("_next = seq + 1").drop("_next")
    plane = {"x1": F.col("lon1") * F.col("lon_m"), "y1": F.col("lat1") * LAT_M, "x2": F.col("lon2") * F.col("lon_m"), "y2": F.col("lat2") * LAT_M}
    s = s.withColumn("length", F.hypot(plane["x2"] - plane["x1"], plane["y2"] - plane["y1"]))
    s = stored(s.withColumn("s0", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))), "segments")
    if not s.where("_block <> 0").isEmpty():
        sums = s.groupBy("line", "_block").agg(F.sum("length").alias("_sum"))
        before = sums.select("line", "_block", F.coalesce(F.sum("_sum").over(Window.partitionBy("line").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
        later = stored(before.where("_before > 0"), "blocks")
        s = s.join(later, ["line", "_block"], "left").withColumn("s0", F.coalesce("_before", F.lit(0.0)) + F.col("s0")).drop("_before")
    return s.drop("_block").withColumns(plane)


def crossed_cells(segs: DataFrame, tol_m: float, size: float) -> DataFrame:
    """Segments, once for every cell of ``size`` degrees that holds a place within ``tol_m`` of them: by rows of cells, and
    in each only the columns that the segment's part there reaches. A long segment has cells in proportion to its length."""
    dlat, dlon = F.lit(tol_m / LAT_M), F.lit(tol_m) / F.col("lon_m")
    low, high = F.least("lat1", "lat2") - dlat, F.greatest("lat1", "lat2") + dlat
    rows = segs.withColumn("_row", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    # The part of the segment whose latitude is within reach of the row, as shares of its way.
    slope = F.col("lat2") - F.col("lat1")
    at = lambda lat: (lat - F.col("lat1")) / slope
    south, north = F.col("_row") * size - dlat, (F.col("_row") + 1) * size + dlat
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    t0 = F.when(slope == 0, F.lit(0.0)).otherwise(clip(F.least(at(south), at(north))))
    t1 = F.when(slope == 0, F.lit(1.0)).otherwise(clip(F.greatest(at(south), at(north))))
    lon = lambda t: F.col("lon1") + t * (F.col("lon2") - F.col("lon1"))
    west, east = F.least(lon(t0), lon(t1)) - dlon, F.greatest(lon(t0), lon(t1)) + dlon
    return rows.withColumn("_col", F.explode(F.sequence(F.floor(west / size), F.floor(east / size))))


def touching_buses(segs: DataFrame, buses: DataFrame, bus: str, lat: str, lon: str, tol_m: float, size: float = 0.05) -> DataFrame:
    """``line, bus, metres, s``: buses within ``tol_m`` of a line and where along it they lie nearest (the first such place)."""
    b = buses.select(F.col(bus).alias("bus"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), F.floor(F.col(lat) / size).alias("_row"), F.floor(F.col(lon) / size).alias("_col"))
    met = crossed_cells(spread(segs, SEGMENTS), tol_m, size).join(b, ["_row", "_col"])
    px, py = F.col("_lon") * F.col("lon_m"), F.col("_lat") * LAT_M
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.when(F.col("length") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / (dx * dx + dy * dy)))).otherwise(0.0)
    far = F.hypot(px - F.col("x1") - t * dx, py - F.col("y1") - t * dy)
    best = F.min(F.struct(far.alias("metres"), (F.col("s0") + t * F.col("length")).alias("s"))).alias("_m")
    return met.where(far <= tol_m).groupBy("line", "bus").agg(best).select("line", "bus", "_m.metres", "_m.s")


def split_lines(vertices: DataFrame, lines: DataFrame, buses: DataFrame, line: str, seq: str, bus: str, lat: str, lon: str, voltage: str, tol_m: float = 150.0, size: float = 0.05) -> DataFrame:
    """``line, piece, from_m, to_m``: lines cut where a bus of their voltage (10 % apart at most, or one unknown) touches
    their inside, farther than ``tol_m`` from both ends. Cuts are rounded to centimetres; pieces below a metre are left out,
    and a line that has no other piece stays whole."""
    segs = segments(vertices, line, seq, lat, lon)
    total = segs.groupBy("line").agg(F.sum("length").alias("total"))
    every = lines.select(F.col(line).alias("line"), F.col(voltage).alias("_kv"), F.lit(True).alias("_listed"))
    every = stored(every.join(total, "line", "full"), "line-lengths")
    # Buses of one voltage at one place cut a line at the same spot.
    spots = stored(buses.where(f"NOT ({lat} = 0 AND {lon} = 0)").groupBy(lat, lon, voltage).agg(F.min(bus).alias(bus)), "bus-places")
    hit = touching_buses(segs, spots, bus, lat, lon, tol_m, size)
    hit = hit.join(spots.select(F.col(bus).alias("bus"), F.col(voltage).alias("_bkv")), "bus").join(every, "line")
    alike = (F.col("_kv") <= 0) | (F.col("_bkv") <= 0) | (F.abs(F.col("_bkv") - F.col("_kv")) <= 0.1 * F.col("_kv"))
    cuts = hit.where(alike & (F.col("s") > tol_m) & (F.col("s") < F.col("total") - tol_m)).select("line", F.round("s", 2).alias("at"), F.lit(None).cast("double").alias("_whole"))
    length = F.coalesce("total", F.lit(0.0))
    ends = F.array(F.struct(F.lit(0.0).alias("at"), F.when(F.col("_listed"), length).alias("_whole")), F.struct(length.alias("at"), F.lit(None).cast("double").alias("_whole")))
    marks = cuts.unionByName(every.select("line", F.explode(ends).alias("_e")).select("line", "_e.*"))
    w = Window.partitionBy("line").orderBy("at")
    marks = marks.withColumn("to_m", F.lead("at").over(w)).withColumn("_piece", F.coalesce(F.col("to_m") - F.col("at") >= 1.0, F.lit(False)))
    pieces = F.count_if(F.col("_piece")).over(Window.partitionBy("line"))
    kept = marks.withColumn("_pieces", pieces).where("_piece OR (_pieces = 0 AND _whole IS NOT NULL)")
    every = kept.select("line", F.col("at").alias("from_m"), F.when(F.col("_piece"), F.col("to_m")).otherwise(F.col("_whole")).alias("to_m"))
    return every.withColumn("piece", F.row_number().over(Window.partitionBy("line").orderBy("from_m")) - 1).select("line", "piece", "from_m", "to_m")


# Convex hulls: parts of a group first, then the parts' hulls.


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of ``x, y`` rows, counter-clockwise, without points on its sides."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows: np.ndarray) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def hulls(points: DataFrame, keys: Sequence[str], x: str, y: str, parts: int = 64) -> DataFrame:
    """``keys, corners`` (array of x and y, counter-clockwise). Hulls of ``parts`` parts of each group are merged, so a group of
    any size is spread over tasks; only corners go on. Points at one place are one."""
    kinds = ", ".join(f"`{k}` {dict(points.dtypes)[k]}" for k in keys)

    def corners(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        h = _hull(p[["_x", "_y"]].to_numpy(float))
        return pd.DataFrame({**{k: [v] * len(h) for k, v in zip(keys, key, strict=False)}, "_x": h[:, 0], "_y": h[:, 1]})

    def whole(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        h = _hull(p[["_x", "_y"]].to_numpy(float))
        return pd.DataFrame([[*key, [{"x": a, "y": b} for a, b in h.tolist()]]], columns=[*keys, "corners"])

    spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).distinct()
    some = spots.withColumn("_part", F.pmod(F.xxhash64("_x", "_y"), F.lit(parts)))
    first = some.groupBy(*keys, "_part").applyInPandas(corners, f"{kinds}, _x double, _y double")
    return first.groupBy(*keys).applyInPandas(whole, f"{kinds}, corners array<struct<x:double,y:double>>")


def _sides(corners: Column) -> Column:
    """Pairs of corners that follow each other around."""
    turned = F.concat(F.slice(corners, 2, F.greatest(F.size(corners) - 1, F.lit(0))), F.slice(corners, 1, 1))
    return F.zip_with(corners, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def area(corners: Column) -> Column:
    return F.aggregate(_sides(corners), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def perimeter(corners: Column) -> Column:
    """Length around; of two corners there and back."""
    return F.aggregate(_sides(corners), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def buffered_area(corners: Column, r: float) -> Column:
    """Area of all within ``r`` of a convex hull."""
    return area(corners) + perimeter(corners) * r + math.pi * r * r


def development_zones(sites: DataFrame, site: str, lat: str, lon: str, cf: str, score: str, least_cf: float, least_score: float, grid_degrees: float, buffer_km: float, mw: float = 3.0) -> DataFrame:
    """Feasible sites (capacity factor and score high enough) in clusters of sites within one and a half grid steps, each with
    its members, hull, area with a buffer, means and capacity. Hulls are plane, in kilometres around a cluster's mean latitude."""
    from wattspan.operators.demand import density_clusters

    fine = stored(sites.where((F.col(cf) >= least_cf) & (F.col(score) >= least_score)), "feasible-sites")
    labels = density_clusters(fine, site, lat, lon, grid_degrees * LON_M / 1000 * 1.5)
    member = stored(fine.join(labels.select(F.col("node").alias(site), F.col("component").alias("zone")), site), "zone-members")
    zones = member.groupBy("zone").agg(F.count("*").alias("num_sites"), F.avg(cf).alias("avg_cf"), F.avg(score).alias("avg_score"), F.avg(lat).alias("_lat"))
    plane = member.join(zones.select("zone", "_lat"), "zone").select("zone", (F.col(lon) * F.cos(F.radians("_lat")) * LON_M / 1000).alias("x"), (F.col(lat) * LAT_M / 1000).alias("y"))
    around = hulls(plane, ["zone"], "x", "y")
    return zones.join(around, "zone").select("zone", "num_sites", "avg_cf", "avg_score", (F.col("num_sites") * mw).alias("total_mw"), "corners", area(F.col("corners")).alias("hull_km2"), buffered_area(F.col("corners"), buffer_km).alias("area_km2"))


# Voronoi cells.


def _clipped(polygon: list[tuple[float, float]], ax: float, ay: float, bx: float, by: float) -> list[tuple[float, float]]:
    """What of a convex polygon lies at least as near to a as to b."""
    nx, ny = bx - ax, by - ay
    c = (bx * bx + by * by - ax * ax - ay * ay) / 2
    out: list[tuple[float, float]] = []
    for (px, py), (qx, qy) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        dp, dq = nx * px + ny * py - c, nx * qx + ny * qy - c
        if dp <= 0:
            out.append((px, py))
        if (dp < 0 < dq) or (dq < 0 < dp):
            t = dp / (dp - dq)
            out.append((px + t * (qx - px), py + t * (qy - py)))
    return out


def voronoi_cells(sites: DataFrame, site: str, x: str, y: str, domain: Sequence[tuple[float, float]], reach: float) -> DataFrame:
    """``site, corners``: each site's cell in a convex domain (corners in order).

    A site's cell is the domain cut by the half-planes towards its neighbours. Neighbours come from cells of ``reach`` around
    it; a site farther off than twice the cell's farthest corner cannot cut it, so the cell is final once it is that small,
    and the sites that are left look twice as far in the next round. Sites at one place share a cell, given to the least.
    """
    corners = [(float(a), float(b)) for a, b in domain]
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, corners[1:] + corners[:1], strict=True)) < 0:
        corners.reverse()
    span = math.hypot(max(c[0] for c in corners) - min(c[0] for c in corners), max(c[1] for c in corners) - min(c[1] for c in corners))
    places = stored(sites.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.min(site).alias("site")), "voronoi-sites")
    shape = "array<struct<x:double,y:double>>"
    rest = places.withColumn("corners", F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in corners]))
    found: list[DataFrame] = []

    def cut(batches):
        for p in batches:
            out, final = [], []
            for ax, ay, polygon, near in zip(p["x"], p["y"], p["corners"], p["near"], strict=True):
                shape_, size = [(q["x"], q["y"]) for q in polygon], float(p["reach"].iloc[0])
                for bx, by in sorted(((q["x"], q["y"]) for q in near), key=lambda q: (q[0] - ax) ** 2 + (q[1] - ay) ** 2):
                    if shape_ and (bx, by) != (ax, ay):
                        shape_ = _clipped(shape_, ax, ay, bx, by)
                out.append([{"x": a, "y": b} for a, b in shape_])
                final.append(not shape_ or 2 * max(math.hypot(a - ax, b - ay) for a, b in shape_) <= size)
            yield pd.DataFrame({"site": p["site"], "x": p["x"], "y": p["y"], "corners": out, "final": final})

    kind = dict(places.dtypes)["site"]
    while True:
        cell = lambda c, d=0, size=reach: F.floor(F.col(c) / size) + d
        own = rest.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
        own = own.select("site", "x", "y", "corners", (cell("x") + F.col("_d.i")).alias("_cx"), (cell("y") + F.col("_d.j")).alias("_cy"))
        there = places.select(F.struct("x", "y").alias("_o"), cell("x").alias("_cx"), cell("y").alias("_cy"))
        met = own.join(there, ["_cx", "_cy"]).groupBy("site", "x", "y").agg(F.first("corners").alias("corners"), F.collect_list("_o").alias("near"))
        done = stored(met.withColumn("reach", F.lit(float(reach))).mapInPandas(cut, f"site {kind}, x double, y double, corners {shape}, final boolean"), "voronoi-round")
        enough = F.col("final") | F.lit(reach >= 2 * span + 1)
        found.append(done.where(enough))
        rest = done.where(~enough).select("site", "x", "y", "corners")
        if rest.isEmpty():
            break
        reach *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("site", F.col("corners").cast(shape).alias("corners"))
