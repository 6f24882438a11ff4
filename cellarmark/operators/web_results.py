"""Scoring, ranking, deduplication and rescoring of web results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarmark import rules
from cellarmark.functions import web
from cellarmark.functions.columns import clamp01
from cellarmark.operators.sliced import first_per_group

EMPTY = "array<string>"


def score_results(results: DataFrame, learned_terms: Column | None = None, learned_negatives: Column | None = None) -> DataFrame:
    """Component scores and final score of every candidate.

    Context columns ``class_types``, ``countries``, ``producers`` and ``sku_count`` are optional.
    """

    def context(name: str) -> Column:
        return F.col(name) if name in results.columns else F.array().cast(EMPTY)

    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    dom, name = F.lower("domain"), F.col("brand_name")
    skus = F.col("sku_count") if "sku_count" in results.columns else F.lit(0)
    prepared = results.withColumns({"_text": text, "_dom": dom})
    t, d = F.col("_text"), F.col("_dom")
    gated = prepared.withColumns(
        {"blocked": web.is_blocked_domain(d), "relevant": web.relevance_gate(t, d, name, learned_terms)}
    ).withColumn("_live", ~F.col("blocked") & F.col("relevant"))
    parts = {
        "domain_score": web.domain_score(d, name),
        "brand_match_score": web.brand_match_score(t, d, name),
        "industry_score": web.industry_score(t, context("class_types"), context("countries")),
        "official_score": web.official_score(t),
        "negative_score": web.negative_score(t, d, learned_negatives),
        "context_score": web.context_score(t, context("countries"), context("producers"), skus),
    }
    scored = gated.withColumns({k: F.when(F.col("_live"), v) for k, v in parts.items()})
    w = rules.SCORE_WEIGHTS
    total = (
        F.col("domain_score") * w["domain"]
        + F.col("brand_match_score") * w["brand_match"]
        + F.col("industry_score") * w["industry"]
        + F.col("official_score") * w["official"]
        - F.col("negative_score") * w["negative"]
        + F.col("context_score") * w["context"]
    )
    explained = web.explain_score(*[F.coalesce(F.col(k), F.lit(0.0)) for k in parts])
    return (
        scored.withColumn("score", F.when(F.col("_live"), clamp01(total)).otherwise(0.0))
        .withColumn("explanation", explained)
        .drop("_text", "_dom", "_live")
    )


def rank_results(scored: DataFrame, k: int = 10) -> DataFrame:
    """Best k unblocked candidates of every brand."""
    return first_per_group(
        scored.filter(~F.col("blocked")), ["brand_name"], [F.desc("score"), F.asc("url")], k, name="position"
    )


def website_options(candidates: DataFrame, confidence: str, k: int = 3, accept: float = 0.9) -> DataFrame:
    """First result per domain, then the top three per brand; auto-selection at ``accept``."""
    order = [F.desc(confidence), F.asc("url")]
    best = candidates.withColumn("clean_domain", web.domain_of(web.decode_redirect(F.col("url")))).filter(F.col("clean_domain").isNotNull())
    # one row per (brand, domain): an aggregate, combined before the shuffle
    keep = [c for c in best.columns if c not in ("brand_name", "clean_domain")]
    unique = (
        best.groupBy("brand_name", "clean_domain")
        .agg(F.min_by(F.struct(*keep), F.struct(-F.col(confidence), F.col("url"))).alias("r"))
        .select("brand_name", "clean_domain", "r.*")
    )
    top = first_per_group(unique, ["brand_name"], order, k, name="position")
    lead = F.max(confidence).over(Window.partitionBy("brand_name"))
    return top.withColumn("needs_selection", lead < accept).filter(F.col("needs_selection") | (F.col("position") == 1))


def best_surviving(results: DataFrame) -> DataFrame:
    """Best unblocked result per brand, else the best blocked one."""
    rank = F.struct(web.is_fast_blocked(F.col("domain")), -F.col("confidence"), F.col("url"))
    keep = [c for c in results.columns if c != "brand_name"]
    return results.groupBy("brand_name").agg(F.min_by(F.struct(*keep), rank).alias("r")).select("brand_name", "r.*")


def picked_website(results: DataFrame, order: list[str]) -> DataFrame:
    """First result of each brand that survives the website filter, in result order."""
    ok = results.filter(web.survives_website_filter(F.col("title"), F.col("url"), F.col("brand_name")))
    keep = [c for c in ok.columns if c != "brand_name"]
    return ok.groupBy("brand_name").agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("r")).select("brand_name", "r.*")


def merge_sources(sources: list[DataFrame], k: int = 10) -> DataFrame:
    """Union of several engines' results: first per URL (source order), then k per brand."""
    tagged = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df)
    keep = [c for c in union.columns if c not in ("brand_name", "url")]
    first = (
        union.groupBy("brand_name", "url").agg(F.min_by(F.struct(*keep), F.struct("_source", "position")).alias("r")).select("brand_name", "url", "r.*")
    )
    return first_per_group(first, ["brand_name"], [F.asc("_source"), F.asc("position"), F.asc("url")], k, name="merged_position").drop("_source")


def rescore(sites: DataFrame, boosts: DataFrame, calibration: DataFrame, min_change: float = 0.05) -> DataFrame:
    """Learned confidence minus the category penalty, floor 0.1; only changes above ``min_change``."""
    from cellarmark.operators.learning import enhanced_confidence

    learned = enhanced_confidence(sites, boosts, calibration)
    mismatch = web.category_mismatch(F.col("class_types"), F.col("domain"))
    new = F.greatest(F.lit(0.1), F.col("enhanced_confidence") - F.when(mismatch, 0.3).otherwise(0.0))
    old = F.col("confidence_predicted")
    return (
        learned.withColumns({"category_mismatch": mismatch, "new_confidence": new})
        .withColumn("change", F.col("new_confidence") - old)
        .filter(F.abs("change") > min_change)
        .select(
            "brand_name", "domain", F.round(old, 2).alias("old_confidence"), F.round("new_confidence", 2).alias("new_confidence"),
            F.round("change", 2).alias("change"), "category_mismatch", F.col("category_mismatch").alias("needs_review"),
        )
    )


def biggest_changes(changes: DataFrame, k: int = 50) -> DataFrame:
    return changes.orderBy(F.desc(F.abs("change")), "brand_name").limit(k)
