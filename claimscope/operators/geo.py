"""Access to verified facilities: assembly, nearest lookup, severity reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions import classify, geo
from claimscope.functions.text import each
from claimscope.operators import nearest as N

CATEGORIES = list(K.CATEGORY_KEYWORDS)


def candidates(
    raw: DataFrame,
    structured: DataFrame,
    trust: DataFrame | None = None,
    default_trust: int | None = K.DEFAULT_TRUST,
) -> DataFrame:
    """Located facilities with their claims and score.

    A missing or zero score becomes ``default_trust``; ``None`` keeps the score as it is
    (missing stays null, zero stays zero). Without a trust table everyone gets the default.
    """
    df = raw.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "facility_id", "state", "district", "pin_code", "latitude", "longitude"
    ).join(structured.select("facility_id", "verified_capabilities"), "facility_id")
    if trust is None:
        return df.withColumn("trust_score", F.lit(default_trust).cast("int"))
    df = df.join(trust.select("facility_id", "trust_score"), "facility_id", "left")
    if default_trust is None:
        return df
    return df.withColumn(
        "trust_score", F.coalesce(F.nullif(F.col("trust_score"), F.lit(0)), F.lit(default_trust))
    )


def verified(
    located: DataFrame,
    min_trust_score: int = K.MIN_TRUST_SCORE,
    min_confidence: float | None = None,
) -> DataFrame:
    """One row per verified facility and category. All of it narrow: no join, no shuffle."""
    found = classify.categories_of_claims("verified_capabilities", min_confidence)
    return each(located.where(F.col("trust_score") >= min_trust_score), found, "category").select(
        "category", "facility_id", "latitude", "longitude", "trust_score"
    )


def pins(raw: DataFrame) -> DataFrame:
    """One point per postal code: that of its lowest facility id."""
    return (
        raw.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .groupBy("pin_code")
        .agg(F.min_by(F.struct("latitude", "longitude"), "facility_id").alias("p"))
        .select("pin_code", "p.latitude", "p.longitude")
    )


def nearest_verified(
    raw: DataFrame,
    structured: DataFrame,
    trust: DataFrame | None = None,
    min_trust_score: int = K.MIN_TRUST_SCORE,
    min_confidence: float | None = None,
    default_trust: int | None = K.DEFAULT_TRUST,
    include_unserved: bool = False,
) -> DataFrame:
    """The lookup table: nearest verified facility per postal code and category.

    ``min_confidence`` and ``default_trust=None`` give the strict reading of "verified".
    ``include_unserved`` adds a red row without distance where no facility qualifies.
    """
    where = pins(raw)
    good = verified(candidates(raw, structured, trust, default_trust), min_trust_score, min_confidence)
    hits = N.nearest(where, good, CATEGORIES)
    if include_unserved:
        grid = where.select("pin_code", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
        hits = grid.join(hits, ["pin_code", "category"], "left")
    return hits.select(
        "pin_code",
        F.col("category").alias("capability"),
        F.col("facility_id").alias("nearest_facility_id"),
        F.round("km", 2).alias("distance_km"),
        F.lit(None).cast("int").alias("travel_time_minutes"),
        F.col("trust_score").alias("nearest_trust_score"),
        geo.severity(F.col("km")).alias("desert_severity"),
    )


def within_radius(
    raw: DataFrame, structured: DataFrame, trust: DataFrame | None = None,
    radius_km: float = K.YELLOW_BELOW_KM, min_trust_score: int = K.MIN_TRUST_SCORE,
) -> DataFrame:
    """Verified facilities within a radius of each postal code, counted per category."""
    good = verified(candidates(raw, structured, trust), min_trust_score)
    return N.count_within(pins(raw), good, radius_km).withColumnRenamed("category", "capability")


def severity_distribution(lookup: DataFrame) -> DataFrame:
    """Counts and shares of green, yellow and red; absent classes count 0."""
    c = F.col("desert_severity")
    one = lookup.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c == s).alias(s) for s in ("green", "yellow", "red")]
    )
    rows = F.array(*[F.struct(F.lit(s).alias("desert_severity"), F.col(s).alias("n")) for s in ("green", "yellow", "red")])
    return one.select("total", F.explode(rows).alias("r")).select(
        "r.desert_severity", "r.n",
        F.coalesce(F.round(F.try_divide(F.col("r.n") * 100.0, F.col("total")), 1), F.lit(0.0)).alias("pct"),
    )


def by_capability(lookup: DataFrame, capability: str) -> DataFrame:
    return lookup.where(F.col("capability") == capability).select(
        "pin_code", "capability", "nearest_facility_id", "distance_km", "nearest_trust_score", "desert_severity"
    )


def red_zones(lookup: DataFrame, limit: int = 20) -> DataFrame:
    """Postal codes with the most red categories."""
    return (
        lookup.where(F.col("desert_severity") == "red").groupBy("pin_code").agg(F.count(F.lit(1)).alias("n_red"))
        .orderBy(F.desc("n_red"), "pin_code").limit(limit)
    )


def stats(located: DataFrame, where: DataFrame, lookup: DataFrame) -> DataFrame:
    """One row of totals, from three independent counts."""
    parts = [
        located.agg(F.count(F.lit(1)).alias("v")).select(F.lit("total_facilities").alias("metric"), "v"),
        where.agg(F.count(F.lit(1)).alias("v")).select(F.lit("unique_pin_codes").alias("metric"), "v"),
        lookup.agg(F.count(F.lit(1)).alias("v")).select(F.lit("total_lookups").alias("metric"), "v"),
    ]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2])
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("v"))).alias(m)
    return long.agg(
        pick("total_facilities"), pick("unique_pin_codes"), pick("total_lookups"),
        F.lit(len(CATEGORIES)).cast("bigint").alias("capabilities_computed"),
    )


def map_rollup(lookup: DataFrame, group: str = "pin_code") -> DataFrame:
    """Worst severity, least distance and the facility at that distance, per group."""
    c = lookup.groupBy(group).agg(
        F.max(geo.severity_rank(F.col("desert_severity"))).alias("rank"),
        F.min("distance_km").alias("distance_km"),
        F.min_by(
            F.struct("nearest_facility_id", "nearest_trust_score"), F.struct("distance_km", "nearest_facility_id")
        ).alias("b"),
    )
    return c.select(
        group, geo.severity_label(F.col("rank")).alias("desert_severity"), "distance_km",
        "b.nearest_facility_id", "b.nearest_trust_score",
    )


def pin_places(raw: DataFrame) -> DataFrame:
    """One state and district per postal code: those of its lowest facility id."""
    return raw.groupBy("pin_code").agg(
        F.min_by(F.struct("state", "district"), "facility_id").alias("p")
    ).select("pin_code", "p.state", "p.district")


def map_rollup_district(lookup: DataFrame, raw: DataFrame) -> DataFrame:
    return map_rollup(lookup.join(pin_places(raw), "pin_code"), "district")


def pin_access(lookup: DataFrame, pin_code: str | None = None, capability: str | None = None) -> DataFrame:
    """Access of one postal code (or all), for one category or for the nearest of any."""
    df = lookup.where(geo.is_pin(F.col("pin_code")))
    if pin_code is not None:
        df = df.where(F.col("pin_code") == pin_code)
    if capability is not None:
        df = df.where(F.col("capability") == capability)
    return df.groupBy("pin_code").agg(
        F.min_by(
            F.struct("capability", "distance_km", "desert_severity", "nearest_facility_id"),
            F.struct("distance_km", "capability"),
        ).alias("b")
    ).select("pin_code", "b.*")


def locations_or_lookup(raw: DataFrame, limit: int = 500) -> DataFrame:
    """What the map shows while there is no lookup table: plain facility locations."""
    return raw.select(
        "facility_id", "facility_name", "state", "district", "latitude", "longitude", "facility_type"
    ).orderBy("facility_id").limit(limit)


def capability_list(structured: DataFrame) -> DataFrame:
    """Every category with the number of facilities that claim it, zero included."""
    cats = F.array(*[F.struct(F.lit(c).alias("category"), F.array_contains("cats", c).cast("int").alias("hit")) for c in CATEGORIES])
    return (
        structured.select(classify.categories_of_claims("verified_capabilities").alias("cats"))
        .select(F.explode(cats).alias("r")).groupBy("r.category").agg(F.sum("r.hit").alias("n_facilities"))
    )


def extracted_capabilities(structured: DataFrame) -> DataFrame:
    """Distinct claimed capability names with the number of claims."""
    return (
        each(structured, "verified_capabilities", "c")
        .groupBy(F.lower("c.capability").alias("capability")).agg(F.count(F.lit(1)).alias("n_claims"))
    )


def region_summary(
    raw: DataFrame, structured: DataFrame, trust: DataFrame | None, lookup: DataFrame,
    min_trust_score: int = K.MIN_TRUST_SCORE,
) -> DataFrame:
    """Per district: facilities, verified ones and their share, and the nearest verified facility."""
    good = verified(candidates(raw, structured, trust), min_trust_score).select("facility_id").distinct()
    counts = (
        raw.select("facility_id", "district")
        .join(good.withColumn("ok", F.lit(1)), "facility_id", "left")
        .groupBy("district")
        .agg(F.count(F.lit(1)).alias("n_facilities"), F.count("ok").alias("n_verified"))
    )
    near = map_rollup_district(lookup, raw).select("district", "nearest_facility_id", "distance_km", "nearest_trust_score")
    return counts.join(near, "district", "left").withColumn(
        "pct_verified", F.round(F.col("n_verified") * 100.0 / F.col("n_facilities"), 1)
    )
