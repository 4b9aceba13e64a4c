"""Points near other points, and points in regions, through adaptive cell coverages."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniva.plans.stage import PAIR_BLOCK, is_empty, join_checked, materialize

EARTH_RADIUS = 6_371_008.8


#: Part number of a cell taken as a whole; 0 to 3 are its quarters.
_WHOLE = 4


def usable(lat: Column, lon: Column) -> Column:
    """Whether coordinates are a place: neither null nor NaN nor out of range nor both 0."""
    good = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(good, F.lit(False))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS) -> Column:
    """Distance along the sphere (haversine, stable for small distances)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


class Grid:
    """Cells of the sphere: bands of equal latitude, each cut into a whole number of equal cells of about the same width.

    A level-0 cell is about ``side`` metres wide and high; level k has cells of side / 2**k inside them.
    """

    def __init__(self, side: float, radius: float = EARTH_RADIUS):
        self.radius = radius
        self.bands = max(1, int(math.pi * radius / side))
        self.height = 180.0 / self.bands

    def band(self, lat: Column) -> Column:
        return F.least(F.floor((lat + 90) / self.height), F.lit(self.bands - 1)).cast("int")

    def cells(self, band: Column) -> Column:
        """Level-0 cells of a band, by the edge nearest to the equator, so that none is wider than high."""
        south, north = band * self.height - 90, (band + 1) * self.height - 90
        edge = F.when((south <= 0) & (north >= 0), 0.0).otherwise(F.least(F.abs(south), F.abs(north)))
        return F.greatest(F.lit(1), F.ceil(F.cos(F.radians(edge)) * (360.0 / self.height)).cast("int"))


def near_pairs(df: DataFrame, key: str, lat: str, lon: str, metres: float, radius: float = EARTH_RADIUS) -> DataFrame:
    """Pairs of different keys at most ``metres`` apart: (key_1 < key_2), once each.

    Rows at the same place are one place with several keys. The disc around a place is covered by cells: those
    wholly inside it are joined on the cell alone and accepted, those on its border have a join of their own with the exact
    distance. A coverage is adaptive: full quarters count as one cell of level 0, others are cut into level-1 cells. Cells with many
    places are cut into blocks. Poles and the date line are crossed. Rows without a key or a usable place are left out; a key with several places is near wherever
    one of them is; repeated rows and extra columns change nothing; an empty table gives no rows.
    """
    places, members = _places(df, key, lat, lon)
    close = _near_places(places, metres, radius)
    a = members.select(F.col("place").alias("p"), F.col("key").alias("a"))
    b = members.select(F.col("place").alias("q"), F.col("key").alias("b"))
    across = close.join(a, "p").join(b, "q").select("a", "b").filter("a <> b")
    same = members.groupBy("place").count().filter("count > 1").select("place")
    shared = members.join(same, "place", "left_semi")
    here = shared.select("place", F.col("key").alias("a")).join(shared.select("place", F.col("key").alias("b")), "place").filter("a < b").select("a", "b")
    return across.union(here).select(F.least("a", "b").alias("key_1"), F.greatest("a", "b").alias("key_2")).distinct()


def near_classes(df: DataFrame, key: str, lat: str, lon: str, metres: float, radius: float = EARTH_RADIUS) -> tuple[DataFrame, DataFrame]:
    """Membership (place, key) of the keys at each distinct place, and pairs (p, q, metres) of different places within reach, once each."""
    places, members = _places(df, key, lat, lon)
    return members, _near_places(places, metres, radius)


def _places(df: DataFrame, key: str, lat: str, lon: str) -> tuple[DataFrame, DataFrame]:
    rows = df.filter(usable(F.col(lat), F.col(lon)) & F.col(key).isNotNull())
    # -0.0 and 0.0, and both signs of 180°, are one place
    x = F.when(F.col(lon) == -180, 180.0).otherwise(F.col(lon) + F.lit(0.0))
    rows = rows.select(F.col(key).alias("key"), (F.col(lat) + F.lit(0.0)).alias("lat"), x.alias("lon")).distinct()
    rows = materialize(rows, "located")
    places = materialize(rows.select("lat", "lon").distinct().withColumn("place", F.monotonically_increasing_id()), "places")
    return places, materialize(rows.join(places, ["lat", "lon"]).select("place", "key"), "members")


def _near_places(places: DataFrame, metres: float, radius: float, block: int | None = None) -> DataFrame:
    """Pairs of places (p < q) within ``metres``, staged."""
    if metres <= 0:
        raise ValueError("metres must be positive")
    if metres > radius * math.pi / 4:
        raise ValueError("discs larger than an eighth of the circumference aren't supported")
    grid = Grid(metres, radius)
    h = grid.height
    reach = math.degrees(metres / radius) * (1 + 1e-9)
    lat, lon = F.col("lat"), F.col("lon")
    # few files of places make many cells: spread them before they are cut up
    places = places.repartition(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place")

    # every place lies in one cell; its quarters tell in which level-1 cell
    band = grid.band(lat)
    own = places.withColumn("band", band).withColumn("n", grid.cells(F.col("band")))
    own = own.withColumn("cell", F.least(F.floor((lon + 180) / 360 * F.col("n")).cast("int"), F.col("n") - 1))
    up = (F.floor((lat + 90) / h * 2) - 2 * F.col("band")).cast("int")
    right = (F.floor((lon + 180) / 360 * F.col("n") * 2) - 2 * F.col("cell")).cast("int")
    inside = own.select("place", "lat", "lon", "band", "cell", (F.greatest(F.lit(0), F.least(F.lit(1), up)) * 2 + F.greatest(F.lit(0), F.least(F.lit(1), right))).alias("quarter"))
    inside = materialize(inside, "inside")
    crowded = inside.groupBy("band", "cell").agg(F.count("*").alias("size")).filter(F.col("size") > (block or PAIR_BLOCK))
    crowded = materialize(crowded.select("band", "cell", F.ceil(F.col("size") / (block or PAIR_BLOCK)).cast("int").alias("blocks")), "crowded")
    if is_empty(crowded):
        inside = inside.withColumn("block", F.lit(0))
    else:
        inside = join_checked(inside, crowded, ["band", "cell"], "left")
        inside = inside.withColumn("block", F.pmod(F.xxhash64("place"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int")).drop("blocks")

    # the disc's bands, then the cells of each band between its extreme longitudes
    low, high = F.floor((F.greatest(lat - reach, F.lit(-90.0)) + 90) / h), F.floor((F.least(lat + reach, F.lit(90.0)) + 90) / h)
    top = F.lit(grid.bands - 1).cast("bigint")
    discs = places.withColumn("band", F.explode(F.sequence(F.least(low, top), F.least(high, top)))).withColumn("band", F.col("band").cast("int"))
    discs = discs.withColumn("n", grid.cells(F.col("band")))
    sine = F.sin(F.radians(F.lit(reach))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    polar = (F.abs(lat) + reach >= 90) | (sine >= 1)
    width = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))) * (1 + 1e-9))
    first, last = F.floor((lon - width + 180) / 360 * F.col("n")), F.floor((lon + width + 180) / 360 * F.col("n"))
    last = F.least(last, first + F.col("n") - 1)
    discs = discs.withColumn("step", F.explode(F.sequence(first, last)))
    discs = discs.withColumn("cell", F.pmod(F.col("step"), F.col("n").cast("bigint")).cast("int"))

    # haversines of the corners of the quarters: three latitudes and three longitudes, nine corners. A quarter is interior when all its
    # corners are within reach, with room for the bulge of the sides; it is out when even its nearest edges are too far
    safe = metres * (1 - 1e-6) - metres * metres / radius
    inner, outer = (math.sin(max(m, 0.0) / radius / 2) ** 2 for m in (safe, metres * (1 + 1e-9)))
    calm = (F.greatest(F.abs(F.col("band") * h - 90), F.abs((F.col("band") + 1) * h - 90)) < 80) & F.lit(metres < radius / 100 and safe > 0)
    rows, cols = [(F.col("band") + i / 2) * h - 90 for i in range(3)], [(F.col("step") + j / 2) / F.col("n") * 360 - 180 for j in range(3)]
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    discs = discs.withColumns({"calm": calm, "own": F.cos(F.radians(lat))})
    discs = discs.withColumns({f"y{i}": half(rows[i] - lat) for i in range(3)} | {f"c{i}": F.col("own") * F.cos(F.radians(rows[i])) for i in range(3)} | {f"x{j}": half(cols[j] - lon) for j in range(3)})
    y, c, x = ([F.col(f"{k}{i}") for i in range(3)] for k in "ycx")

    def within(low: int, high: int, left: int, right: int) -> Column:
        return F.col("calm") & (F.greatest(*[y[i] + c[i] * x[j] for i in (low, high) for j in (left, right)]) <= inner)

    def out(i: int, j: int) -> Column:
        dy = F.when((lat >= rows[i]) & (lat <= rows[i + 1]), 0.0).otherwise(F.least(y[i], y[i + 1]))
        dx = F.when((lon >= cols[j]) & (lon <= cols[j + 1]), 0.0).otherwise(F.least(x[j], x[j + 1]))
        return F.col("calm") & (dy + F.least(c[i], c[i + 1]) * dx > outer)

    kinds = [F.when(within(i, i + 1, j, j + 1), 1).when(out(i, j), 0).otherwise(2) for i in (0, 1) for j in (0, 1)]
    discs = discs.withColumn("kinds", F.when(within(0, 2, 0, 2), F.array(*[F.lit(3)] * 4)).otherwise(F.array(*kinds)))
    cover = discs.select(F.col("place").alias("p"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "band", "cell", "kinds")
    if is_empty(crowded):
        cover = cover.withColumn("block", F.lit(0))
    else:
        cover = join_checked(cover, crowded, ["band", "cell"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    spots_of = lambda kind: F.filter(F.transform("kinds", lambda k, i: F.when(k == kind, i.cast("int"))), lambda k: k.isNotNull())
    whole = F.when(F.col("kinds")[0] == 3, F.array(F.lit(_WHOLE))).otherwise(spots_of(1))

    # interior cells: the equi-join alone decides, coordinates don't travel
    on = ["band", "cell", "block", "part"]
    spots = inside.select("place", "band", "cell", "block", F.explode(F.array("quarter", F.lit(_WHOLE))).alias("part"))
    # the planner's estimates don't know how many cells a disc has, so it must not pick a broadcast
    sure = cover.select("p", "band", "cell", "block", F.explode(whole).alias("part")).hint("merge").join(spots.hint("merge"), on).filter("p < place").select("p", F.col("place").alias("q"))
    # border cells: the exact distance of each pair
    exact = great_circle(F.col("lat1"), F.col("lon1"), lat, lon, radius) <= metres
    edge = cover.select("p", "lat1", "lon1", "band", "cell", "block", F.explode(spots_of(2)).alias("part"))
    border = edge.hint("merge").join(inside.withColumnRenamed("quarter", "part").hint("merge"), on)
    pairs = sure.union(border.filter("p < place").filter(exact).select("p", F.col("place").alias("q")))
    return materialize(pairs, "near")


def _cover_region(rings: list, side: float, levels: int, west: float, south: float) -> list[tuple[int, int, int, bool]]:
    """Cells (level, row, column, interior) of a region in degrees: a quadtree that stops at cells wholly inside and at the finest level."""
    edges = [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]

    def crosses(x0, y0, x1, y1) -> bool:
        for (ay, ax), (by, bx) in edges:
            t0, t1 = 0.0, 1.0
            for lo, hi, s, d in ((x0, x1, ax, bx - ax), (y0, y1, ay, by - ay)):
                if d == 0:
                    if s < lo or s > hi:
                        t0 = 2.0
                else:
                    u, v = sorted(((lo - s) / d, (hi - s) / d))
                    t0, t1 = max(t0, u), min(t1, v)
            if t0 <= t1:
                return True
        return False

    def holds(x, y) -> bool:
        odd = False
        for (ay, ax), (by, bx) in edges:
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    out, todo = [], []
    lats, lons = [y for ring in rings for y, _ in ring], [x for ring in rings for _, x in ring]
    if not lats:
        return out
    for r in range(math.floor((min(lats) - south) / side), math.floor((max(lats) - south) / side) + 1):
        for c in range(math.floor((min(lons) - west) / side), math.floor((max(lons) - west) / side) + 1):
            todo.append((0, r, c))
    while todo:
        k, r, c = todo.pop()
        w = side / 2**k
        box = (west + c * w, south + r * w, west + (c + 1) * w, south + (r + 1) * w)
        if crosses(box[0] - 1e-9, box[1] - 1e-9, box[2] + 1e-9, box[3] + 1e-9):  # rounding never makes a border cell an interior one
            if k == levels:
                out.append((k, r, c, False))
            else:
                todo += [(k + 1, 2 * r + i, 2 * c + j) for i in (0, 1) for j in (0, 1)]
        elif holds((box[0] + box[2]) / 2, (box[1] + box[3]) / 2):
            out.append((k, r, c, True))
    return out


def points_in_regions(points: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region: str, rings: str, side: float = 1.0, levels: int = 6) -> DataFrame:
    """(key, region) of the regions that contain each point, borders of the west and south side included.

    ``rings`` is array<array<struct<lat, lon>>> in degrees, straight in latitude and longitude, holes by the even-odd rule;
    regions across the date line are given in two parts. A region's cover has cells of ``side`` degrees cut down up to ``levels``
    times: points in interior cells are accepted by the equi-join alone, those in border cells are tested
    against the region's edges. Unusable points and null regions are left out.
    """
    kind = regions.schema[region].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for name, shape in zip(pdf["region"], pdf["rings"]):
                plain = [[(p["lat"], p["lon"]) for p in ring] for ring in shape if ring is not None and len(ring)]
                rows += [(name, *cell) for cell in _cover_region(plain, side, levels, -180.0, -90.0)]
            yield pd.DataFrame(rows, columns=["region", "level", "row", "col", "interior"])

    named = regions.select(F.col(region).alias("region"), F.col(rings).alias("rings")).dropna()
    named = materialize(named, "regions")
    cover = materialize(named.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, f"region {kind}, level int, row long, col long, interior boolean"), "cover")
    x, y = F.col(lon), F.col(lat)
    own = points.filter(usable(y, x)).select(F.col(key).alias("key"), y.alias("lat"), x.alias("lon"))
    at = own.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    w = F.lit(side) / F.pow(F.lit(2.0), F.col("level"))
    at = at.withColumn("row", F.floor((F.col("lat") + 90) / w)).withColumn("col", F.floor((F.col("lon") + 180) / w))
    met = at.hint("merge").join(cover.hint("merge"), ["level", "row", "col"])
    sure = met.filter("interior").select("key", "region")
    edges = F.flatten(F.transform("rings", lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), F.slice(r, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    border = join_checked(met.filter("not interior"), materialize(named.withColumn("edges", edges).drop("rings"), "edges"), "region")

    def cuts(e: Column) -> Column:
        ay, ax, by, bx = e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"]
        # level edges never count, so the divisor isn't 0 where its value matters
        return ((ay > F.col("lat")) != (by > F.col("lat"))) & (F.col("lon") < (bx - ax) * (F.col("lat") - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)

    odd = F.size(F.filter("edges", cuts)) % 2 == 1
    return sure.union(border.filter(odd).select("key", "region")).distinct()
