"""Exact nearest-point and within-radius joins between two unbounded tables.

Neither side is broadcast and no group is paired with itself. Points are counted
per cube at a few levels (``geo.LEVELS``), a pyramid that is built from the finest
level up and written once; a search walks from coarse cubes to fine ones and drops
every cube that cannot hold an answer:

1. the cubes a location lies in give a first upper bound on its distance;
2. at most 3 x 3 x 3 cubes cover the ball of that radius, most of them empty;
3. a crowded cube is replaced by its non-empty children, a bounded number, and
   cubes farther than the best representative are dropped, for as long as a crowded
   cube is left above the finest level;
4. the points of what is left are compared: cubes that are not crowded list them.

Steps 1-3 only shrink the search: step 4 looks at every point that may still win,
so the answer is exact however many rounds run. A city that holds a third of all
points costs a few more cubes per location, not a third of the table.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimscope.functions import geo
from claimscope.sources.settle import settled

CROWDED = 32                    # cubes with more points than this do not list them
ROUNDS = len(geo.LEVELS) - 1    # down to the finest level, whatever is left above it
_SLACK = 1e-9     # rounding allowance of the chord bounds

_PIN = ("px", "py", "pz")
_REP = ("rep.x", "rep.y", "rep.z")
_CUBE = ["level", "cell", "n", "copies", "rep", "members"]
_SPLIT = f"members is null and level < {geo.LEVELS[-1]}"
_SIDE = "pow(0.5D, level)"


def _points_with_vectors(points: DataFrame) -> DataFrame:
    """One row per category and coordinate pair: the lowest id stands for all facilities there."""
    x, y, z = geo.unit_vector("latitude", "longitude")
    return (
        points.where("latitude is not null and longitude is not null")
        .groupBy("category", "latitude", "longitude")
        .agg(
            F.expr("min_by(struct(facility_id, trust_score), facility_id)").alias("first"),
            F.count(F.lit(1)).alias("copies"),
        )
        .selectExpr(
            "category",
            "named_struct('facility_id', first.facility_id, 'trust_score', first.trust_score, "
            f"'latitude', latitude, 'longitude', longitude, 'x', {x}, 'y', {y}, 'z', {z}, 'copies', copies) as point",
        )
    )


class Pyramid:
    """Non-empty cubes of all levels, each level made of the one below it, and the points.

    A cube has its number of points and of facilities, one point to stand for it, and its points themselves while
    they are few: at most ``crowded`` of them, none of which shares a cube of the finest level. Each level is written
    once, and every search reads the same table.
    """

    def __init__(self, points: DataFrame, crowded: int = CROWDED):
        self.points = settled(_points_with_vectors(points))
        finest, levels = geo.LEVELS[-1], []
        below = self.points.selectExpr("category", f"{geo.cell_at('point.x', 'point.y', 'point.z', finest)} as cell", "1L as n", "point.copies as copies", "point as rep")
        for at in range(len(geo.LEVELS) - 1, -1, -1):
            sums = [F.sum("n").alias("n"), F.sum("copies").alias("copies"), F.expr("min_by(rep, rep.facility_id)").alias("rep")]
            if at == len(geo.LEVELS) - 1:  # a cube of this level may hold any number: only a lone point is named
                cubes = below.groupBy("category", "cell").agg(*sums).withColumn("members", F.expr("if(n = 1, array(rep), null)"))
            else:  # at most 8 x 8 x 8 children, whose lists are short
                whole = F.expr(f"if(count(members) = count(1) and sum(n) <= {crowded}, flatten(collect_list(members)), null)").alias("members")
                cubes = below.groupBy("category", "cell").agg(*sums, whole)
            up = geo.LEVELS[at - 1] if at else -1
            parent = geo.cell_at("rep.x", "rep.y", "rep.z", up) if at else "-1L"
            level = settled(cubes.selectExpr("category", f"{geo.LEVELS[at]} as level", "cell", f"{up} as parent_level", f"{parent} as parent", "n", "copies", "rep", "members"))
            levels.append(level)
            below = level.select("category", F.col("parent").alias("cell"), "n", "copies", "rep", "members")
        self.cubes = levels[0]
        for level in levels[1:]:
            self.cubes = self.cubes.unionByName(level)

    def members(self, live: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and ``p``, each point of the cubes of ``live``."""
        named = live.where("members is not null").selectExpr(*keep, "explode(members) as p")
        other = live.where("members is null")
        found = [r.level for r in other.select("level").distinct().collect()]  # the levels are seven
        if not found:
            return named
        cubes = ", ".join(f"named_struct('level', {lv}, 'cell', {geo.cell_at('point.x', 'point.y', 'point.z', lv)})" for lv in sorted(found))
        levelled = self.points.selectExpr("category", "point as p", f"inline(array({cubes}))")
        # An inner join, so that adaptive execution may split either side of a large cube.
        return named.unionByName(other.select(*keep, *(c for c in ("level", "cell", "category") if c not in keep)).join(levelled, ["category", "level", "cell"]).select(*keep, "p"))


def _located(locations: DataFrame, key: str) -> DataFrame:
    x, y, z = geo.unit_vector("latitude", "longitude")
    return locations.where("latitude is not null and longitude is not null").selectExpr(
        key, "latitude as plat", "longitude as plon", f"{x} as px", f"{y} as py", f"{z} as pz"
    )


def _cover(df: DataFrame, radius: str) -> DataFrame:
    """Add the cubes that meet the ball of ``radius`` (a chord) around each location.

    The level is the finest whose side is at least the ball's radius, hence at most
    three cubes per axis.
    """
    level = str(geo.LEVELS[0])
    for lv in geo.LEVELS[1:]:
        level = f"if({radius} * 1.000002D + 1e-12D <= {1.0 / (1 << lv)!r}D, {lv}, {level})"

    def axis(p: str) -> str:
        reach = f"({radius} * 1.000001D + 1e-12D)"
        lo = f"cast(floor(greatest(-1D, {p} - {reach}) / {_SIDE}) as bigint)"
        hi = f"cast(floor(least(1D, {p} + {reach}) / {_SIDE}) as bigint)"
        return f"sequence({lo}, {hi})"

    return (
        df.withColumn("level", F.expr(level))
        .selectExpr("*", f"explode({axis('px')}) as ix")
        .selectExpr("*", f"explode({axis('py')}) as iy")
        .selectExpr("*", f"explode({axis('pz')}) as iz")
        .withColumn("cell", F.expr(geo.pack_cell("ix", "iy", "iz")))
        .drop("ix", "iy", "iz")
    )


def _children(df: DataFrame, cubes: DataFrame) -> DataFrame:
    """The non-empty children of each cube of ``df`` in its place."""
    kids = cubes.selectExpr(
        "category", "parent_level as level", "parent as cell", f"struct({', '.join(_CUBE)}) as kid"
    )
    joined = df.drop(*(c for c in _CUBE if c not in ("level", "cell"))).join(kids, ["category", "level", "cell"])
    return joined.drop("level", "cell").selectExpr("*", "kid.*").drop("kid")


def nearest(
    locations: DataFrame,
    points: DataFrame,
    categories: list[str],
    key: str = "pin_code",
    rounds: int = ROUNDS,
    crowded: int = CROWDED,
) -> DataFrame:
    """The nearest point of every category for every location.

    ``locations(key, latitude, longitude)`` holds one row per key; ``points(category,
    facility_id, latitude, longitude, trust_score)`` any number. Ties go to the lowest
    facility id; a category without points gives no row. Returns ``(key, category,
    facility_id, trust_score, km)``.
    """
    pyramid = points if isinstance(points, Pyramid) else Pyramid(points, crowded)
    cubes = pyramid.cubes
    here = _located(locations, key)
    ids = [key, "category"]
    rep_chord = geo.chord(_PIN, _REP)
    near, _ = geo.cell_chord_bounds(_PIN, _REP, _SIDE)

    # 1. First upper bound: the representatives of the cubes the location lies in.
    own = ", ".join(f"named_struct('level', {lv}, 'cell', {geo.cell_at(*_PIN, lv)})" for lv in geo.LEVELS)
    reached = (
        here.selectExpr("*", f"inline(array({own}))")
        .join(cubes.select("category", "level", "cell", "rep"), ["level", "cell"])
        .selectExpr(key, "plat", "plon", *_PIN, "category", f"{rep_chord} as ub")
    )
    anywhere = here.selectExpr(
        "*", "explode(array(" + ", ".join(f"'{c}'" for c in categories) + ")) as category", "2D as ub"
    )
    bound = (
        anywhere.unionByName(reached)
        .groupBy(key, "plat", "plon", *_PIN, "category")
        .agg(F.min("ub").alias("ub"))
    )

    # 2. Cubes that meet the ball, then 3. split and drop, while some cube's points are not at hand.
    per_search = W.partitionBy(*ids)

    def drop_far(df: DataFrame) -> DataFrame:
        best = F.least(F.col("ub"), F.min(F.expr(rep_chord)).over(per_search))
        return df.withColumn("ub", best).where(f"{near} <= ub * {1 + _SLACK!r}D + 1e-12D")

    live = settled(drop_far(_cover(bound, "ub").join(cubes.select("category", *_CUBE), ["category", "level", "cell"])))
    for _ in range(rounds):
        if live.where(_SPLIT).isEmpty():
            break
        live = settled(drop_far(live.where(f"not ({_SPLIT})").unionByName(_children(live.where(_SPLIT), cubes))))

    # 4. The points of the cubes that are left.
    found = pyramid.members(live, [*ids, "plat", "plon"])
    km = geo.haversine_sql("plat", "plon", "p.latitude", "p.longitude")
    return (
        found.selectExpr(*ids, f"struct({km} as km, p.facility_id, p.trust_score) as hit")
        .groupBy(*ids)
        .agg(F.expr("min_by(hit, struct(hit.km, hit.facility_id))").alias("b"))
        .select(*ids, "b.facility_id", "b.trust_score", "b.km")
    )


def within_each(centres: DataFrame, points: DataFrame, key: str = "pin") -> DataFrame:
    """``(key, facility_id, km)`` of every point within ``far`` kilometres of each of ``centres(key, plat, plon, far)``."""
    cover = _cover(
        centres.withColumnsRenamed({"plat": "latitude", "plon": "longitude"}).where("latitude is not null and longitude is not null")
        .selectExpr(key, "far", "latitude as plat", "longitude as plon", *(f"{e} as {n}" for e, n in zip(geo.unit_vector("latitude", "longitude"), _PIN)))
        .withColumn("chord", F.expr(f"2D * sin(least(far / {2 * geo.EARTH_RADIUS_KM!r}D, pi() / 2))")),
        "chord",
    ).select(key, "far", "plat", "plon", "level", "cell")
    x, y, z = geo.unit_vector("latitude", "longitude")
    located = points.where("latitude is not null and longitude is not null").selectExpr("*", f"{x} as x", f"{y} as y", f"{z} as z")
    cubes = ", ".join(f"named_struct('level', {lv}, 'cell', {geo.cell_at('x', 'y', 'z', lv)})" for lv in geo.LEVELS)
    near = cover.join(located.selectExpr("facility_id", "latitude", "longitude", f"inline(array({cubes}))"), ["level", "cell"])
    return near.selectExpr(key, "facility_id", f"{geo.haversine_sql('plat', 'plon', 'latitude', 'longitude')} as km", "far").where("km <= far").drop("far")


def count_within(
    locations: DataFrame,
    points: DataFrame,
    radius_km: float,
    key: str = "pin_code",
    rounds: int = ROUNDS,
    crowded: int = CROWDED,
) -> DataFrame:
    """How many points of each category lie within ``radius_km`` of each location.

    Cubes wholly inside the ball add their count without being opened; only cubes on
    its rim are split, and only rim cubes are joined with points. Returns ``(key,
    category, n_within)`` for pairs with at least one point.
    """
    pyramid = points if isinstance(points, Pyramid) else Pyramid(points, crowded)
    ids = [key, "category"]
    r = geo.chord_of_km(radius_km)
    near, far = geo.cell_chord_bounds(_PIN, _REP, _SIDE)
    touches = f"{near} <= {r * (1 + _SLACK)!r}D"
    rim = f"{far} > {r * (1 - _SLACK)!r}D"

    live = settled(_cover(_located(locations, key), f"{r!r}D").join(pyramid.cubes.select("category", *_CUBE), ["level", "cell"]).where(touches))
    for _ in range(rounds):
        opened = f"{_SPLIT} and {rim}"
        if live.where(opened).isEmpty():
            break
        live = settled(live.where(f"not ({opened})").unionByName(_children(live.where(opened), pyramid.cubes).where(touches)))

    whole = live.where(f"not ({rim})").selectExpr(*ids, "copies as adds")
    km = geo.haversine_sql("plat", "plon", "p.latitude", "p.longitude")
    edge = pyramid.members(live.where(rim), [*ids, "plat", "plon"]).where(f"{km} <= {radius_km!r}D")
    return (
        whole.unionByName(edge.selectExpr(*ids, "p.copies as adds"))
        .groupBy(*ids)
        .agg(F.sum("adds").alias("n_within"))
        .where("n_within > 0")
    )
