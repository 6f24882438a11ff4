"""Additive priority score, tiers, queues, ranking statistics and data health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarmark import rules
from cellarmark.functions.columns import contains_any
from cellarmark.functions.documents import site_columns


PERMIT_KINDS = ["importer", "distillery", "brewery", "winery"]


def competitor_name(c: Column) -> Column:
    up = F.upper(F.coalesce(c, F.lit("")))
    return (up != "") & (up != "NAN") & contains_any(up, rules.COMPETITOR_VARIANTS)


def product_score_of(class_type: Column) -> Column:
    """Highest keyword score contained in one class type."""
    up = F.upper(F.trim(class_type))
    return F.greatest(*[F.when(up.contains(k), F.lit(v)).otherwise(0) for k, v in rules.PRODUCT_SCORES.items()])


def product_score(class_types: Column) -> Column:
    scores = F.transform(F.coalesce(class_types, F.array().cast("array<string>")), product_score_of)
    return F.coalesce(F.array_max(scores), F.lit(0))


def sku_score(n: Column) -> Column:
    return F.when(n >= 5, 10).when(n >= 2, 7).when(n == 1, 3).otherwise(0)


def permit_kind(permit: Column) -> Column:
    return (
        F.when(permit.contains("-I-"), "importer")
        .when(permit.contains("DSP"), "distillery")
        .when(permit.contains("BR-"), "brewery")
        .when(permit.contains("BWN"), "winery")
    )


def is_premium(class_types: Column) -> Column:
    return contains_any(F.upper(F.array_join(class_types, "\n")), rules.PREMIUM_TERMS)


def tier_of(score: Column, competitor: Column) -> Column:
    return F.when(competitor, 1).when(score >= 90, 1).when(score >= 70, 2).when(score >= 50, 3).when(score >= 30, 4).otherwise(5)


def tier_label(score: Column, competitor: Column) -> Column:
    labels = rules.TIER_LABELS
    return (
        F.when(competitor, labels[0]).when(score >= 90, labels[1]).when(score >= 70, labels[2]).when(score >= 50, labels[3])
        .when(score >= 30, labels[4]).otherwise(labels[5])
    )


def holder_flags(tiers: DataFrame) -> DataFrame:
    """Per brand: competitor among importers or producers, any importer, number of permit kinds."""
    known = F.col("tier") != "brand_permit"
    kind = permit_kind(F.col("permit_no"))
    rival = known & (competitor_name(F.col("owner_name")) | competitor_name(F.col("operating_name")))
    return tiers.groupBy("brand_name").agg(
        F.coalesce(F.max(rival), F.lit(False)).alias("is_competitor_target"),
        F.max(F.col("tier") == "importer").alias("has_importer"),
        # four known kinds: their maxima add up to the distinct count without a second shuffle
        sum((F.max(F.coalesce(kind == k, F.lit(False))).cast("int") for k in PERMIT_KINDS), F.lit(0)).alias("permit_kinds"),
    )


def priority_scores(brands: DataFrame, flags: DataFrame, as_of: Column) -> DataFrame:
    """Score, tier and breakdown of every brand.

    ``brands`` carries countries, class_types, sku_count, created_date, updated_at and the website
    documents; ``as_of`` replaces the clock.
    """
    s = site_columns(F.col("enrichment_data"), F.col("website"))
    flagged = brands.join(flags, "brand_name", "left")
    competitor = F.coalesce("is_competitor_target", F.lit(False))
    importer = F.coalesce("has_importer", F.lit(False))
    recent = lambda c: F.coalesce(F.date_diff(as_of, F.col(c)) <= rules.RECENT_DAYS, F.lit(False))
    site = s["url"].isNotNull() | (F.coalesce(F.col("website"), F.lit("")) != "")

    def points(cond: Column, value: int) -> Column:
        return F.when(cond, value).otherwise(0)

    parts = {
        "competitor_target": points(competitor, rules.SCORE_COMPETITOR),
        "importer": points(~competitor & importer, rules.SCORE_IMPORTER),
        "has_website": points(site, rules.SCORE_WEBSITE),
        "product_type": product_score(F.col("class_types")),
        "sku_volume": sku_score(F.col("sku_count")),
        "recent_activity": points(recent("created_date") | recent("updated_at"), rules.SCORE_RECENT),
        "multiple_countries": points(F.size("countries") > 1, rules.SCORE_COUNTRIES),
        "multiple_permits": points(F.coalesce("permit_kinds", F.lit(0)) > 1, rules.SCORE_PERMITS),
        "premium_segment": points(is_premium(F.col("class_types")), rules.SCORE_PREMIUM),
    }
    scored = flagged.withColumns(parts)
    total = F.least(sum((F.col(p) for p in parts), F.lit(0)), F.lit(100))
    return (
        scored.withColumn("score", total)
        .withColumns({"tier": tier_of(F.col("score"), competitor), "tier_description": tier_label(F.col("score"), competitor)})
        .withColumn("has_enrichment", F.coalesce(F.col("enrichment_data"), F.lit("")) != "")
        .withColumn("is_competitor_target", competitor)
        .withColumn("breakdown", F.struct(*parts, F.col("score").alias("total")))
        .select(
            "brand_name", "score", "tier", "tier_description", "sku_count", "has_enrichment", "is_competitor_target",
            "class_types", *parts, "breakdown",
        )
    )


def rank_brands(scores: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = scores.orderBy(F.desc("score"), "brand_name")
    return ordered.limit(limit) if limit else ordered


def tier_queue(scores: DataFrame, tier: int, exclude_enriched: bool = True) -> DataFrame:
    out = scores.filter(F.col("tier") == tier)
    return out.filter(~F.col("has_enrichment")) if exclude_enriched else out


def tier_stats(scores: DataFrame) -> DataFrame:
    """Brands and enriched brands per tier, all five tiers present."""
    tiers = scores.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("tier"))
    counted = scores.groupBy("tier").agg(F.count("*").alias("brands"), F.count_if("has_enrichment").alias("enriched"))
    return tiers.join(counted, "tier", "left").select(
        "tier", F.coalesce("brands", F.lit(0)).alias("brands"), F.coalesce("enriched", F.lit(0)).alias("enriched")
    )


def ranking_stats(scores: DataFrame) -> DataFrame:
    p = F.col("product_type")
    return scores.agg(
        F.count("*").alias("total_brands"),
        F.count_if(p >= 25).alias("spirits_brands"),
        F.count_if((p >= 12) & (p < 25)).alias("wine_brands"),
        F.count_if((p >= 8) & (p < 12)).alias("beer_brands"),
        F.count_if(F.col("competitor_target") > 0).alias("competitor_target_brands"),
        F.count_if((F.col("importer") > 0) | (F.col("competitor_target") > 0)).alias("brands_with_importers"),
        F.count_if(F.col("has_website") > 0).alias("brands_with_websites"),
    )


def queue_preview(scores: DataFrame, k: int = 5) -> DataFrame:
    """Pending count per tier with its first k brands.

    The pre-selection keeps k rows per (tier, slice) before the window, so a tier holding most brands
    is not ranked by one task.
    """
    pending = scores.filter(~F.col("has_enrichment"))
    slices = F.pmod(F.xxhash64("brand_name"), F.lit(64))
    order = [F.desc("score"), F.asc("brand_name")]
    local = pending.withColumn("_rn", F.row_number().over(Window.partitionBy("tier", slices).orderBy(*order))).filter(F.col("_rn") <= k)
    top = local.withColumn("position", F.row_number().over(Window.partitionBy("tier").orderBy(*order))).filter(F.col("position") <= k)
    counts = pending.groupBy("tier").agg(F.count("*").alias("pending"))
    return top.join(counts, "tier").select("tier", "pending", "position", "brand_name", "score")


def batch_totals(results: DataFrame) -> DataFrame:
    """Totals per tier of a batch result table (status: success, failed, skipped)."""
    return results.groupBy("tier").agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )


def data_health(summary: DataFrame, scores: DataFrame) -> DataFrame:
    """Single-row health report with truncated scores and a status label."""
    row = summary.agg(
        F.count("*").alias("total_brands"),
        F.count_if(F.col("enrichment_data").isNotNull() | F.col("website").isNotNull()).alias("brands_with_websites"),
        F.count_if(F.col("importer_count") > 0).alias("brands_with_importers"),
        F.count_if(F.col("producer_count") > 0).alias("brands_with_producers"),
        F.count_if(F.size("countries") > 0).alias("brands_with_countries"),
        F.count_if((F.size("countries") == 0) | (F.size("class_types") == 0)).alias("missing_critical_data"),
    )
    base = F.greatest(F.lit(1), F.col("total_brands"))
    cut = lambda c: F.floor(c / base * 100).cast("int")
    site = F.col("brands_with_websites")
    row = row.withColumns(
        {
            "completeness_score": F.least(F.lit(100), cut(site)),
            "quality_score": F.greatest(F.lit(0), 100 - cut(F.col("missing_critical_data"))),
            "enrichment_rate": cut(site),
            "website_coverage": F.round(site / base * 100, 1),
            "pending_enrichment": F.col("total_brands") - site,
        }
    )
    overall = F.floor((F.col("completeness_score") + F.col("quality_score") + F.col("enrichment_rate")) / 3).cast("int")
    row = row.withColumn("overall_health_score", overall)
    status = F.when(overall >= 70, "Good").when(overall >= 40, "Fair").otherwise("Poor")
    tiers = scores.agg(F.count_if(F.col("tier") == 1).alias("total_critical"), F.count_if(F.col("tier") == 2).alias("total_high"))
    return row.withColumn("status", status).crossJoin(tiers)
