"""Named queries over the registry tables: every operator applied to whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarmark.functions import names as N
from cellarmark.functions import web
from cellarmark.functions.columns import jaccard_or_half, sorted_join
from cellarmark.functions.documents import site_columns, website_view
from cellarmark.functions.similarity import boosted_ratio, longest_common_substring, plain_ratio
from cellarmark.operators import contacts, facets, insights, learning, permits, ranking, request_log, resolution, upserts, web_results
from cellarmark.operators.facets import BrandFilter
from cellarmark.plans.registry import AS_OF, Registry
from cellarmark.session import cut_lineage, spread_if_narrow
from cellarmark.sources.snapshots import export_views
from cellarmark.streaming import sessions

QUERIES: dict[str, Callable[[Registry], DataFrame]] = {}
EVENTS_END = "2024-01-31"


def query(fn: Callable[[Registry], DataFrame]) -> Callable[[Registry], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Callable[[Registry], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Registry(spark, sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}


# --- shared pieces ------------------------------------------------------------------------------
def masters(r: Registry) -> DataFrame:
    return permits.permit_masters(r.importers, r.spirit_producers, r.wine_producers)


def tiers(r: Registry) -> DataFrame:
    return permits.classify_permits(r.brand_permits, masters(r))


def importer_bridge(r: Registry) -> DataFrame:
    """Brand x importer for matched importer permits."""
    return r.brand_permits.join(r.importers, F.col("permit_no") == F.col("permit_number")).select("brand_name", "permit_no", "owner_name")


def sites(r: Registry, base: DataFrame | None = None) -> DataFrame:
    s = site_columns(F.col("enrichment_data"), F.col("website"))
    return (base if base is not None else r.brand_names).withColumns(s)


def brands_with_sites(r: Registry) -> DataFrame:
    return sites(r, r.brands)


def attributed(r: Registry) -> DataFrame:
    return permits.brand_producers(r.brand_permits, r.spirit_producers, r.wine_producers)


def domain_rows(r: Registry) -> DataFrame:
    return resolution.domain_members(brands_with_sites(r))


def scores(r: Registry) -> DataFrame:
    return ranking.priority_scores(r.brands, ranking.holder_flags(tiers(r)), F.lit(AS_OF).cast("date"))


def as_of_events():
    return F.to_timestamp(F.lit(EVENTS_END))


# --- permits -----------------------------------------------------------------------------------
@query
def permit_match(r):
    m = permits.match_permits(r.skus, r.importers, "permit_no", permits.permit_key_column(r.importers))
    return m.select("ttb_id", "permit_no", "brand_name", "owner_name", "state", "Match_Status", "filed")


@query
def permit_match_summary(r):
    return permits.match_summary(permits.match_permits(r.skus, r.importers, "permit_no", "permit_number"))


@query
def permit_tier(r):
    return tiers(r).select("brand_name", "permit_no", "tier", "owner_name")


@query
def permit_convert(r):
    held = r.skus.select("permit_no").distinct()
    return permits.producers_of_permits(held, r.spirit_producers, r.wine_producers).select(
        "permit_no", "converted_permit", "matched_via", "owner_name"
    )


@query
def producer_brands(r):
    every = permits.union_producers(r.spirit_producers, r.wine_producers)
    return permits.producer_brands(r.skus, every)


@query
def producer_attribution(r):
    return attributed(r).select("brand_name", "permit_no", "producer_type", "relationship", "confidence")


@query
def production_types(r):
    return permits.production_types(r.brand_names.select("brand_name"), attributed(r))


@query
def producer_analysis_totals(r):
    return permits.producer_analysis_totals(permits.production_types(r.brand_names.select("brand_name"), attributed(r)))


# --- faceted queries --------------------------------------------------------------------------
@query
def brand_summary(r):
    s = facets.brand_summary(r.brands, r.brand_permits, masters(r), r.spirit_producers, r.wine_producers)
    return s.select(
        "brand_name", "sku_count", F.size("countries").cast("long").alias("countries"), sorted_join(F.col("class_types")).alias("class_types"),
        "importer_count", "producer_count", "own_permit_count",
    )


FACETS = BrandFilter(
    search="widget", countries=("TEXAS", "NATION_7"), class_types=("vodka", "whisky"), website=("has_website",),
    producers=("Bonded Winery (CA)", "Brewer (TX)"), sort="skus", descending=True, page=2, per_page=20,
)


@query
def brand_facet_page(r):
    hit = facets.filter_brands(r.brands, FACETS, r.skus, importer_bridge(r))
    page = facets.page_of(facets.sort_brands(hit, FACETS.sort, FACETS.descending), FACETS.page, FACETS.per_page)
    return page.select("brand_name", "sku_count", "created_date")


@query
def brand_facet_total(r):
    hit = facets.filter_brands(r.brands, FACETS, r.skus, importer_bridge(r))
    return facets.page_info(hit, FACETS.page, FACETS.per_page)


@query
def brand_importer_filter(r):
    f = BrandFilter(importers=("PARKSTREET IMPORTS 68",), min_skus=3)
    return facets.filter_brands(r.brands, f, r.skus, importer_bridge(r)).select("brand_name", "sku_count")


@query
def brand_listing(r):
    """Simplified listing: brand, label count, first importer and producer names, website filter."""
    held = tiers(r).groupBy("brand_name").agg(
        F.min(F.when(F.col("tier") == "importer", F.col("owner_name"))).alias("first_importer"),
        F.min(F.when(F.col("tier").endswith("_producer"), F.col("owner_name"))).alias("first_producer"),
    )
    hit = facets.filter_brands(r.brands, BrandFilter(website=("verified",)), r.skus)
    return hit.join(held, "brand_name", "left").select("brand_name", "sku_count", "first_importer", "first_producer")


@query
def brand_search(r):
    return facets.search_names(r.brand_names.select("brand_name"), "gear")


@query
def brand_labels(r):
    return facets.brand_labels(r.skus, "BLUE ANVIL 13").select("ttb_id", "permit_no", "fanciful_name", "class_type_desc", "completed_date")


@query
def brand_detail(r):
    """Point lookup: header of one brand with its permit counts by tier."""
    return facets.brand_detail(r.brands, tiers(r), "BLUE ANVIL 13").select("brand_name", "importers", "producers", "own_permits", "site.url")


@query
def brand_permit_rows(r):
    """Point lookup: permits of one brand with tier and holder."""
    return facets.brand_permit_rows(tiers(r), "BLUE ANVIL 13")


@query
def website_resolution(r):
    v = website_view(F.col("enrichment_data"), F.col("website"))
    return r.brand_names.select("brand_name", v.alias("v")).select("brand_name", "v.url", "v.confidence", "v.origin")


@query
def producer_list(r):
    every = permits.union_producers(r.spirit_producers, r.wine_producers)
    found = facets.list_holders(every, "trading", ["owner_name", "operating_name", "permit_number", "city", "state"], "city", True, "wine_producer")
    return found.select("permit_number", "owner_name", "city", "producer_type")


@query
def importer_list(r):
    return facets.list_holders(r.importers, "supplier", ["owner_name", "permit_number"], "owner_name").select("permit_number", "owner_name")


@query
def facet_counts(r):
    return facets.facet_counts(r.skus, r.brand_names, tiers(r))


@query
def facet_counts_permit_label(r):
    return facets.facet_counts_by_label(r.skus, r.brand_names, tiers(r), r.brand_permits)


@query
def summary_facets(r):
    return facets.summary_facets(r.brands)


@query
def table_stats(r):
    return facets.table_stats(r.brand_names, r.skus, r.importers, importer_bridge(r))


@query
def producer_stats(r):
    return insights.single_row(
        r.spirit_producers.agg(F.count("*").alias("spirit_producers")), r.wine_producers.agg(F.count("*").alias("wine_producers"))
    ).withColumn("total_producers", F.col("spirit_producers") + F.col("wine_producers"))


@query
def importer_metrics(r):
    return facets.importer_brand_counts(tiers(r))


@query
def importer_brands(r):
    """Brands of every real importer, one row each."""
    return facets.importer_brands(tiers(r))


@query
def importer_leaderboard(r):
    return facets.importer_leaderboard(facets.importer_brand_counts(tiers(r)), by="name").select("permit_no", "company_name", "brand_count")


@query
def review_queue(r):
    return facets.review_queue(r.brand_names).select("brand_name", "url", "confidence")


@query
def review_triage(r):
    return facets.review_triage(r.brand_names)


@query
def contact_candidates(r):
    return facets.contact_candidates(r.brand_names, F.lit(None).cast("string")).select("brand_name", "url")


@query
def page_sku_total(r):
    page = facets.page_of(facets.sort_brands(r.brands, "skus", True), 1, 24)
    return page.agg(F.count("*").alias("brands"), F.sum("sku_count").alias("skus"))


# --- market report ---------------------------------------------------------------------------
@query
def overview(r):
    return insights.overview(r.brand_names, r.skus, r.importers, importer_bridge(r))


@query
def overview_dated(r):
    return insights.overview_dated(r.brand_names, r.skus, "1996-03-01", "1998-09-30")


@query
def geo(r):
    return insights.geography(r.skus)


@query
def geo_top(r):
    total = r.brand_names.agg(F.count("*").alias("total"))
    g = insights.geography(r.skus).filter(F.col("kind") == "country").select("name", "n")
    return insights.top_share(g, total, 10)


@query
def domestic_split(r):
    return insights.domestic_split(r.skus)


@query
def class_types(r):
    counts = insights.class_counts(r.skus)
    return insights.top_share(counts, counts.agg(F.sum("n").alias("total")), 15)


@query
def category_rollup(r):
    return insights.category_rollup(insights.class_counts(r.skus))


@query
def sku_histogram(r):
    return insights.sku_histogram(r.skus)


@query
def importer_histogram(r):
    return insights.importer_histogram(insights.importer_counts(r.importers, importer_bridge(r)))


@query
def importer_top(r):
    return insights.importer_top(insights.importer_counts(r.importers, importer_bridge(r)))


@query
def importer_top_ten_share(r):
    return insights.top_ten_share(insights.importer_counts(r.importers, importer_bridge(r)))


@query
def hhi_cr(r):
    return insights.concentration(insights.importer_counts(r.importers, importer_bridge(r)))


@query
def growth(r):
    return insights.growth(r.skus, insights.importer_counts(r.importers, importer_bridge(r)))


@query
def coverage(r):
    return insights.coverage(r.brand_names)


@query
def top_brands(r):
    return insights.top_performers(r.skus)


@query
def keywords(r):
    return insights.keyword_counts(r.brand_names).orderBy(F.desc("frequency"), "keyword").limit(20)


@query
def permit_types(r):
    return insights.permit_type_counts(r.importers)


@query
def location_chart(r):
    return insights.location_chart(r.skus)


@query
def location_chart_states(r):
    return insights.location_chart(r.skus, "usa-states")


@query
def class_chart(r):
    return insights.class_chart(insights.class_counts(r.skus))


@query
def market_report(r):
    return insights.full_report(r.brand_names, r.skus, r.importers, importer_bridge(r))


# --- ranking ----------------------------------------------------------------------------------
@query
def priority_rank(r):
    return scores(r).drop("breakdown", "class_types")


@query
def priority_top(r):
    return ranking.rank_brands(scores(r), 50).select("brand_name", "score", "tier")


@query
def tier_stats(r):
    return ranking.tier_stats(scores(r))


@query
def ranking_stats(r):
    return ranking.ranking_stats(scores(r))


@query
def tier_queue(r):
    return ranking.tier_queue(scores(r), 2).select("brand_name", "score", "tier_description")


@query
def queue_preview(r):
    return ranking.queue_preview(scores(r))


@query
def batch_totals(r):
    s = scores(r).withColumn("status", F.when(F.col("has_enrichment"), "skipped").when(F.col("score") % 2 == 0, "success").otherwise("failed"))
    return ranking.batch_totals(s)


@query
def data_health(r):
    s = facets.brand_summary(r.brands, r.brand_permits, masters(r), r.spirit_producers, r.wine_producers)
    return ranking.data_health(s, scores(r))


# --- upserts and state ---------------------------------------------------------------------------
def _split_upload(r: Registry) -> tuple[DataFrame, DataFrame]:
    """Labels filed before 2000 as the stored table (latest per id), the rest as the new upload."""
    old = upserts.last_in_file(r.skus.filter(F.col("filed") < "2000-01-01"), "ttb_id", "file_order")
    return old, r.skus.filter(F.col("filed") >= "2000-01-01")


@query
def sku_upsert(r):
    old, batch = _split_upload(r)
    return upserts.upsert(old.withColumnRenamed("filed", "added_date"), batch.withColumn("added_date", F.col("filed")), "ttb_id", "file_order", keep=("added_date",)).select(
        "ttb_id", "brand_name", "permit_no", "class_type_desc", "added_date", "change_type"
    )


@query
def change_counts(r):
    old, batch = _split_upload(r)
    return upserts.change_counts(upserts.upsert(old, batch, "ttb_id", "file_order"))


@query
def upload_counters(r):
    old, batch = _split_upload(r)
    return upserts.upload_counters(batch, old, old.select("brand_name").distinct(), masters(r))


@query
def brand_upsert(r):
    old, batch = _split_upload(r)
    existing = old.groupBy("brand_name").agg(F.collect_set("permit_no").alias("permit_numbers"), F.collect_set("origin_desc").alias("countries"), F.collect_set("class_type_desc").alias("class_types"))
    out = upserts.upsert_brands(existing, batch, {"permit_numbers": "permit_no", "countries": "origin_desc", "class_types": "class_type_desc"})
    return out.select("brand_name", sorted_join(F.col("permit_numbers")).alias("permit_numbers"), sorted_join(F.col("countries")).alias("countries"), "change_type")


@query
def master_upsert(r):
    stored = r.importers.filter(~F.col("city").endswith("4"))
    batch = r.importers.filter(F.col("city") > "CITY 2").withColumn("owner_name", F.concat("owner_name", F.lit(" LLC")))
    batch = batch.withColumn("file_order", F.struct("permit_number", "city"))
    return upserts.replace_masters(stored, batch, "file_order")


def _word_mapping(r: Registry) -> DataFrame:
    """Brands sharing their first two words merge into the shortest (then first) of them."""
    n = F.col("brand_name")
    two = F.substring_index(n, " ", 2)
    best = r.brand_names.groupBy(two.alias("w")).agg(F.min_by("brand_name", F.struct(F.length("brand_name"), "brand_name")).alias("canonical_name"))
    return r.brand_names.withColumn("w", two).join(best, "w").select("brand_name", "canonical_name", F.length("brand_name").alias("position"))


@query
def brand_merge(r):
    merged = upserts.merge_brands(brands_with_sites(r), _word_mapping(r), F.col("verified"))
    return merged.select(
        "brand_name", "merged_brands", "sku_count", F.size("permit_numbers").cast("long").alias("permits"), F.size("countries").cast("long").alias("countries"),
        sorted_join(F.col("class_types")).alias("class_types"), F.col("enrichment_data").isNotNull().alias("has_document"),
    )


@query
def brand_merge_skus(r):
    return upserts.rekey_skus(r.skus, _word_mapping(r)).groupBy("brand_name").agg(F.count("*").alias("labels"), F.count_distinct("original_brand").alias("brands"))


@query
def merge_history(r):
    return upserts.merge_history(_word_mapping(r), r.skus, "similarity", "registry")


@query
def manual_training(r):
    """Feedback events as manual training records."""
    return upserts.manual_training(r.feedback)


@query
def website_state(r):
    return upserts.website_state(r.feedback, ["ts", "event_id"]).select("brand_name", "domain", "verification_status", "confidence", "needs_review")


@query
def website_documents(r):
    """Website documents with dates and reasons; unselected results stand for documents that are set."""
    n, open_ = F.col("event_id"), F.col("user_action") == "not_selected"
    site = F.concat(F.lit('{"url": "https://'), "domain", F.lit('", "confidence": '), F.col("confidence_predicted").cast("string"), F.lit(', "needs_review": true}'))
    whole = F.when(n % 5 == 0, F.concat(F.lit('{"rating": '), F.coalesce(F.col("k").cast("string"), F.lit("null")), F.lit("}"))).otherwise(
        F.concat(F.lit('{"website": '), site, F.lit("}"))
    )
    events = r.feedback.withColumns(
        {
            "document": F.when(open_ & (n % 3 == 0), whole).when(open_, site),
            "reason": F.when((F.col("user_action") == "flagged") & (n % 2 == 0), F.concat(F.lit("k is "), F.col("k").cast("string"))),
            "user_action": F.when(open_ & (n % 3 == 0), "set_enrichment").when(open_, "set_website").otherwise(F.col("user_action")),
        }
    )
    return upserts.website_documents(events, ["ts", "event_id"])


@query
def contact_state(r):
    e = r.feedback.withColumns({"status": F.when(F.col("user_action") == "verified", "completed").otherwise("pending"), "company_id": F.col("k")})
    return upserts.contact_state(e, ["ts", "event_id"])


@query
def manual_entries(r):
    e = r.feedback.filter(F.col("user_action") == "verified")
    return upserts.manual_entries(e, F.date_trunc("day", "ts")).select("event_id", "brand_name", "entry_id")


# --- names -------------------------------------------------------------------------------------
@query
def name_normalize(r):
    n = F.col("brand_name")
    return r.brand_names.select("brand_name", N.normalize_name(n).alias("normalized"), sorted_join(N.significant_words(n)).alias("words"))


@query
def core_brand(r):
    return r.brand_names.select("brand_name", N.core_brand(F.col("brand_name")).alias("core"))


@query
def white_label(r):
    n = F.col("brand_name")
    return r.brand_names.select("brand_name", N.is_white_label(n).alias("white_label"), sorted_join(N.store_brands(n)).alias("stores"))


@query
def product_name_flag(r):
    n, c = F.col("brand_name"), F.col("class_types")
    return r.brands.select("brand_name", N.product_indicator_count(n, c).cast("long").alias("indicators"), N.is_product_name(n, c).alias("product_name"), N.is_company_name(n).alias("company_name"))


@query
def name_variations(r):
    """Spellings per brand and how many brands share each."""
    v = r.brand_names.select("brand_name", F.explode(N.name_variations(F.col("brand_name"))).alias("variation"))
    return v.groupBy("variation").agg(F.count("*").alias("brands"), F.min("brand_name").alias("first_brand"))


def _next_release(r: Registry) -> DataFrame:
    """Each brand with the brand of the same words and the next number: one partner at most."""
    stem = F.regexp_replace("brand_name", "[0-9]+$", "")
    n = F.regexp_extract("brand_name", "([0-9]+)$", 1).cast("int")
    s = sites(r, r.brands).withColumns({"stem": stem, "n": n})
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.stem") == F.col("b.stem")) & (F.col("a.n") + 1 == F.col("b.n")))


@query
def pair_confidence(r):
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    sim = boosted_ratio(a("brand_name"), b("brand_name"))
    conf = resolution.pair_confidence(
        sim, (web.domain_of(a("url")), web.domain_of(b("url"))), (a("countries"), b("countries")), (a("class_types"), b("class_types"))
    )
    return _next_release(r).select(
        a("brand_name").alias("name_a"), b("brand_name").alias("name_b"), F.round(sim, 6).alias("similarity"),
        web.domain_similarity(a("url"), b("url")).alias("domain_similarity"),
        F.round(jaccard_or_half(a("countries"), b("countries")), 6).alias("location_similarity"), F.round(conf, 6).alias("confidence"),
    )


@query
def variation_types(r):
    a, b = F.col("a.brand_name"), F.col("b.brand_name")
    return _next_release(r).select(a.alias("name_a"), b.alias("name_b"), N.variation_type(a, b).alias("kind"))


@query
def core_pairs_ratio(r):
    """Names and their core brand compared with the sequence ratio and their common base."""
    n, core = F.col("brand_name"), N.core_brand(F.col("brand_name"))
    p = r.brand_names.select("brand_name", core.alias("core"))
    return p.select("brand_name", "core", F.round(boosted_ratio(n, F.col("core")), 6).alias("boosted"), F.round(plain_ratio(n, F.col("core")), 6).alias("plain"), longest_common_substring(n, F.col("core")).alias("base"))


@query
def strategy_features(r):
    f = N.strategy_features(F.col("brand_name"), F.col("class_types"), F.col("countries"))
    return r.brands.select("brand_name", f.alias("f")).select(
        "brand_name", "f.starts_with_common_word", "f.has_numbers", F.col("f.word_count").cast("long").alias("word_count"), "f.is_wine", "f.is_spirits", "f.is_beer", "f.is_us_brand",
        N.strategy_key(F.lit("exact"), F.col("f")).alias("strategy_key"),
    )


@query
def name_suggestions(r):
    n = F.col("brand_name")
    return r.brand_names.select(
        "brand_name", N.direct_domain(n).alias("direct_domain"), F.array_join(N.search_phrases(n), "|").alias("phrases"),
        N.strip_trade_suffix(F.regexp_replace(n, " [0-9]+$", "")).alias("bare_name"), F.md5(n).alias("query_key"), F.substring(F.md5(n), 1, 8).alias("short_key"),
    )



# --- domains ----------------------------------------------------------------------------------
@query
def domain_extract(r):
    u = F.col("url")
    return r.table("pages").select("page_id", web.domain_of(u).alias("domain"), web.registered_domain(web.domain_of(u)).alias("registered"), web.domain_base(web.domain_of(u)).alias("base"))


@query
def domain_groups(r):
    return resolution.domain_groups(domain_rows(r))


def _domain_facts(r: Registry) -> DataFrame:
    full = resolution.completeness(F.col("countries"), F.col("class_types"), F.col("permit_numbers"), F.lit(True), F.col("enrichment_data").isNotNull())
    return domain_rows(r).select("brand_name", "domain", "class_types", "confidence", full.alias("completeness"))


def _hierarchy(r: Registry):
    return resolution.domain_hierarchy(_domain_facts(r))


@query
def domain_hierarchy(r):
    return _hierarchy(r)[0].select("proposal_id", "domain", "consolidation_type", "canonical_name", "confidence", "brands_to_merge")


@query
def domain_hierarchy_members(r):
    return _hierarchy(r)[1]


@query
def name_normalization(r):
    return resolution.name_normalization(_domain_facts(r))[0]


@query
def completeness(r):
    held = importer_bridge(r).select("brand_name").distinct().withColumn("imported", F.lit(True))
    b = r.brands.join(held, "brand_name", "left")
    c = resolution.completeness(F.col("countries"), F.col("class_types"), F.col("permit_numbers"), F.coalesce("imported", F.lit(False)), F.col("enrichment_data").isNotNull())
    return b.select("brand_name", c.alias("completeness"))


# --- proposals ---------------------------------------------------------------------------------
def _report(r: Registry) -> DataFrame:
    return _report_and_members(r)[0]


def _report_and_members(r: Registry) -> tuple[DataFrame, DataFrame]:
    """Normalisation and hierarchy proposals over one materialised table of brands with domains."""
    facts = cut_lineage(_domain_facts(r))
    norm, norm_rows = resolution.name_normalization(facts)
    tree, tree_rows = resolution.domain_hierarchy(facts)
    return resolution.opportunities([norm, tree]), norm_rows.unionByName(tree_rows)


@query
def proposals(r):
    return _report(r)


@query
def opportunity_breakdown(r):
    return resolution.opportunity_breakdown(_report(r))


@query
def approvals(r):
    return resolution.approvals(_report(r)).select("proposal_id", "kind", "confidence", "auto_approved")


@query
def batch_selection(r):
    """Proposals that a batch run takes at the default confidence."""
    return resolution.batch_selection(_report(r), 0.8).select("proposal_id", "canonical_name", "confidence")


@query
def merge_execution(r):
    """Approved proposals turned into a mapping and applied to the labels."""
    report, members = _report_and_members(r)
    approved = cut_lineage(resolution.approvals(report).filter("auto_approved"))
    mapping = cut_lineage(resolution.merge_mapping(approved, members))
    moved = upserts.rekey_skus(r.skus, mapping)
    return moved.groupBy("brand_name").agg(F.count("*").alias("labels"), F.count_distinct("original_brand").alias("brands"))


def _groups(r: Registry) -> DataFrame:
    return _word_mapping(r).select(F.col("canonical_name").alias("group_id"), "canonical_name", "brand_name", "position")


@query
def group_recommendations(r):
    g = resolution.average_similarity(_groups(r).select("group_id", F.col("brand_name").alias("name")), typed=True)
    return g.select("group_id", "comparisons", F.round("average_similarity", 6).alias("average_similarity"), resolution.recommendation(F.col("average_similarity")).alias("recommendation"))


@query
def proposal_documents(r):
    g = _groups(r)
    sim = resolution.average_similarity(g.select("group_id", F.col("brand_name").alias("name")))
    d = resolution.group_details(g, r.brands, attributed(r), sim)
    return d.select("group_id", "brand_count", "total_skus", "confidence_score", "proposal_type", "risk_level", "risks", "benefits")


@query
def proposal_rollup(r):
    """The figures behind the documents."""
    g = _groups(r)
    sim = resolution.average_similarity(g.select("group_id", F.col("brand_name").alias("name")))
    d = resolution.group_details(g, r.brands, attributed(r), sim)
    return d.select("group_id", "brand_count", "total_skus", "countries_n", "types_n", "permits", "distinct_permits", "primary_names", F.round("confidence_score", 4).alias("confidence_score"), "proposal_type", "risk_level")


@query
def sku_preview(r):
    return resolution.sku_preview(_groups(r), r.skus).select("group_id", "original_brand", "ttb_id", "new_sku_name")


@query
def merge_strategy(r):
    m = _groups(r).join(brands_with_sites(r), "brand_name")
    return resolution.merge_strategy(m)


@query
def canonical_by_score(r):
    return resolution.canonical_by_score(_groups(r).join(brands_with_sites(r), "brand_name"))


@query
def clusters_similarity(r):
    c = resolution.similar_brand_clusters(brands_with_sites(r).select("brand_name", "url", "countries", "class_types"))
    return c.select("name", "leader", F.round("score", 6).alias("score"))


@query
def clusters_levenshtein(r):
    c = resolution.fuzzy_name_clusters(r.brand_names, method="levenshtein")
    return c.select("name", "leader", F.round("score", 6).alias("score"))


@query
def clusters_cascade(r):
    c = resolution.cascade_clusters(resolution.cascade_features(r.brands, attributed(r)))
    return c.select("name", "leader", F.round("score", 6).alias("score"))


@query
def clusters_producer_aware(r):
    c = resolution.cascade_clusters(resolution.cascade_features(r.brands, attributed(r)), producer_aware=True)
    return c.select("name", "leader", F.round("score", 6).alias("score"))


def _past_decisions(r: Registry) -> DataFrame:
    """Past merge decisions: the first two-word groups, approved or rejected by their size."""
    g = _word_mapping(r)
    pair = g.filter(F.col("brand_name") != F.col("canonical_name")).groupBy("canonical_name").agg(F.min("brand_name").alias("m"), F.count("*").alias("n"))
    return pair.select(
        F.xxhash64("canonical_name").alias("feedback_id"), F.when(F.col("n") % 3 == 0, "rejected").otherwise("approved").alias("user_action"),
        F.array("canonical_name", "m").alias("brand_group"),
    )


@query
def clusters_predicted(r):
    adjust = resolution.feedback_adjustment(r.brand_names, _past_decisions(r))
    c = resolution.predicted_clusters(r.brand_names, adjust)
    return c.select("name", "leader", F.round("score", 6).alias("score"))


UPLOAD_FROM = "1995-06-01"


def _upload_pairs(r: Registry) -> DataFrame:
    """Names that first appear in the upload (labels filed from ``UPLOAD_FROM`` on) beside those filed before it."""
    stored = r.skus.filter(F.col("filed") < UPLOAD_FROM).select("brand_name")
    return learning.upload_variations(r.skus.filter(F.col("filed") >= UPLOAD_FROM).select("brand_name"), stored)


@query
def upload_variations(r):
    return _upload_pairs(r).withColumn("similarity", F.round("similarity", 6))


@query
def upload_patterns(r):
    """Merge patterns that the upload's pairs teach."""
    return learning.learned_patterns(_upload_pairs(r)).withColumn("confidence", F.round("confidence", 6))


# --- web results ---------------------------------------------------------------------------------
def _web_with_context(r: Registry) -> DataFrame:
    """Pages with a brand context chosen by page id."""
    c = F.array(F.when(F.col("page_id") % 2 == 0, "TABLE RED WINE").otherwise("STRAIGHT BOURBON WHISKY"))
    return r.web_results.withColumns(
        {"class_types": c, "countries": F.array(F.when(F.col("page_id") % 3 == 0, "France").otherwise("Ireland")), "sku_count": F.col("page_id") % 20}
    )


def _scored(r: Registry) -> DataFrame:
    return web_results.score_results(_web_with_context(r))


@query
def web_score(r):
    parts = ["domain_score", "brand_match_score", "industry_score", "official_score", "negative_score", "context_score", "score"]
    return _scored(r).select("page_id", "brand_name", "blocked", "relevant", *[F.round(p, 6).alias(p) for p in parts], "explanation")


@query
def web_rank(r):
    return web_results.rank_results(_scored(r), 3).select("brand_name", "page_id", "position", F.round("score", 6).alias("score"))


@query
def confidence_basic(r):
    w = r.web_results
    return w.select("page_id", F.round(web.basic_confidence(F.col("brand_name"), F.col("title"), F.col("snippet"), F.col("domain")), 6).alias("confidence"))


@query
def confidence_legacy(r):
    return r.feedback.select("event_id", F.round(web.legacy_confidence(F.col("brand_name"), F.col("domain")), 6).alias("confidence"))


def _basic(r: Registry) -> DataFrame:
    w = r.web_results
    return w.withColumn("confidence", web.basic_confidence(F.col("brand_name"), F.col("title"), F.col("snippet"), F.col("domain")))


@query
def web_dedupe(r):
    return web_results.website_options(_basic(r), "confidence").select(
        "brand_name", "clean_domain", "page_id", "position", F.round("confidence", 6).alias("confidence"), "needs_selection"
    )


@query
def web_best(r):
    return web_results.best_surviving(_basic(r)).select("brand_name", "page_id", F.round("confidence", 6).alias("confidence"))


@query
def web_merge_sources(r):
    b = _basic(r).withColumn("position", F.col("page_id"))
    return web_results.merge_sources([b.filter(F.col("url").startswith("https")), b]).select("brand_name", "url", "page_id", "merged_position")


@query
def web_relevance(r):
    w = r.web_results
    return w.select(
        "page_id",
        web.relevant_result(F.col("title"), F.col("snippet"), F.col("url"), F.col("domain"), F.col("brand_name")).alias("relevant"),
        web.survives_website_filter(F.col("title"), F.col("url"), F.col("brand_name")).alias("survives"),
        web.is_blocked_domain(F.col("domain")).alias("blocked"),
    )


@query
def picked_website(r):
    return web_results.picked_website(r.web_results, ["page_id"]).select("brand_name", "page_id", "url")


@query
def redirect_decode(r):
    """Every page URL wrapped as a search redirect and unwrapped again."""
    token = F.rtrim(F.regexp_replace(F.base64(F.encode("url", "utf-8")), "=+$", ""))
    wrapped = F.concat(F.lit("https://www.bing.com/ck/a?!&&p=1&u=a1"), F.translate(token, "+/", "-_"), F.lit("&ntb=1"))
    return r.table("pages").select("page_id", web.decode_redirect(wrapped).alias("url"))


@query
def url_features(r):
    f = web.url_features(F.col("brand_name"), F.concat(F.lit("https://"), F.col("domain"), F.lit("/")))
    cols = ["brand_in_domain", "brand_words_in_domain", "exact_brand_match", "has_industry_keyword", "numeric_match", "is_social_media", "tld"]
    return r.feedback.select("event_id", f.alias("f")).select("event_id", *[F.col("f")[c].alias(c) for c in cols])


@query
def category_mismatch(r):
    return domain_rows(r).select("brand_name", "domain", web.category_mismatch(F.col("class_types"), F.col("domain")).alias("mismatch"))


@query
def rescore_stats(r):
    return domain_rows(r).agg(F.count("*").alias("total_websites"), F.count_if(web.category_mismatch(F.col("class_types"), F.col("domain"))).alias("mismatches"))


def _rescore_inputs(r: Registry) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = learning.domain_patterns(r.feedback)
    s = domain_rows(r).select("brand_name", "domain", "class_types", F.coalesce("confidence", F.lit(0.5)).alias("confidence_predicted"))
    return s, learning.domain_boosts(s, p), learning.calibration(r.feedback)


@query
def rescore(r):
    return web_results.rescore(*_rescore_inputs(r))


@query
def biggest_rescores(r):
    """The report's fifty largest confidence changes."""
    changes = web_results.rescore(*_rescore_inputs(r))
    return web_results.biggest_changes(changes).select("brand_name", "old_confidence", "new_confidence", "change")


@query
def selection_reasons(r):
    w = _web_with_context(r)
    return w.select("page_id", web.selection_reasoning(F.col("domain"), F.col("title"), F.col("snippet"), F.col("class_types")).alias("reasoning"))


# --- learning ------------------------------------------------------------------------------------
@query
def domain_patterns(r):
    p = learning.domain_patterns(r.feedback)
    return p.select("pattern_type", "pattern", "sample_count", F.round("success_rate", 6).alias("success_rate"), F.round("confidence_boost", 6).alias("confidence_boost"), "last_updated")


@query
def discovered_patterns(r):
    return learning.discovered_patterns(r.feedback)


@query
def calibration(r):
    c = learning.calibration(r.feedback)
    return c.select("bin", "n", "verified", F.round("factor", 6).alias("factor"))


@query
def enhanced_confidence(r):
    p = learning.domain_patterns(r.feedback)
    e = learning.enhanced_confidence(r.feedback, learning.domain_boosts(r.feedback, p), learning.calibration(r.feedback))
    return e.select("event_id", F.round("enhanced_confidence", 6).alias("enhanced_confidence"))


@query
def relevance_terms(r):
    t = learning.relevance_terms(_web_with_context(r)).withColumn("verified", F.col("page_id") % 2 == 0)
    n = learning.rejection_terms(r.web_results.filter(F.col("page_id") % 2 == 1))
    p = learning.term_patterns(t, n)
    return p.select("term_type", "term", "sample_count", F.round("success_rate", 6).alias("success_rate"), "example_brands")


@query
def usable_terms(r):
    t = learning.relevance_terms(_web_with_context(r)).withColumn("verified", F.col("page_id") % 2 == 0)
    n = learning.rejection_terms(r.web_results.filter(F.col("page_id") % 2 == 1))
    return learning.usable_terms(learning.term_patterns(t, n)).select("list", "term", "sample_count")


def _selected(r: Registry) -> DataFrame:
    """Events as choices: the rank picked and the features of the picked URL."""
    f = web.url_features(F.col("brand_name"), F.concat(F.lit("https://"), F.col("domain"), F.lit("/")))
    rows = r.feedback.select("event_id", "ts", "user_action", (F.col("event_id") % 3 + 1).alias("selected_rank"), f.alias("features"))
    return learning.feature_patterns(rows)


@query
def selection_boosts(r):
    return learning.selection_boosts(_selected(r).filter(F.col("user_action") == "verified"))


@query
def rejection_boosts(r):
    return learning.rejection_boosts(_selected(r).filter(F.col("user_action") == "rejected"))


@query
def selection_events(r):
    """Choices among three options built per event; every third event rejects all."""
    option = lambda i: F.struct(
        F.concat(F.lit("https://"), F.lit(f"o{i}."), F.col("domain")).alias("url"), F.col("domain").alias("domain"), F.col("confidence_predicted").alias("confidence")
    )
    c = r.feedback.select("event_id", "brand_name", "ts", (F.col("event_id") % 4).cast("int").alias("selected_rank"), F.array(option(1), option(2), option(3)).alias("options"))
    return learning.selection_events(c).groupBy("event_type", "user_action", "option_rank").agg(F.count("*").alias("n"))


def _runs(r: Registry) -> DataFrame:
    kinds = F.array(F.when(F.col("k") % 3 == 0, "TABLE RED WINE").when(F.col("k") % 3 == 1, "VODKA").otherwise("BEER"))
    strategy = F.when(F.col("event_id") % 2 == 0, "exact").otherwise("domain")
    return r.feedback.filter(F.col("user_action") == "verified").select(
        "brand_name", "ts", strategy.alias("strategy"), F.col("confidence_predicted").alias("quality"), kinds.alias("class_types"), F.array(F.lit("FRANCE")).alias("countries")
    )


@query
def strategy_patterns(r):
    p = learning.strategy_patterns(_runs(r))
    return p.select("strategy_key", "strategy", "sample_count", "success_rate", F.round("average_confidence", 6).alias("average_confidence"))


@query
def strategy_examples(r):
    return learning.recent_examples(learning.with_strategy_key(_runs(r))).select("strategy_key", "brand_name", "recency")


@query
def recommended_strategy(r):
    return learning.recommended_strategy(r.brands, learning.strategy_patterns(_runs(r)))


def _steps(r: Registry) -> DataFrame:
    keep = F.col("user_action").isin("verified", "rejected")
    return r.feedback.filter(keep).select(
        F.concat(F.lit("p"), (F.col("k") % 20).cast("string")).alias("pattern"), "ts", "event_id", (F.col("user_action") == "verified").alias("success"),
        F.lit(0.9).alias("start"), F.date_trunc("day", "ts").alias("slice"),
    )


@query
def pattern_fold(r):
    return learning.pattern_fold(_steps(r))


@query
def pattern_boost(r):
    pairs = variation_types(r).filter(F.col("kind").isNotNull()).withColumn("pair_id", F.concat_ws("~", "name_a", "name_b"))
    p = learning.pattern_fold(_steps(r)).select(
        F.when(F.substring("pattern", 2, 2).cast("int") % 2 == 0, "year_variation").otherwise("special_edition").alias("pattern_type"),
        F.when(F.substring("pattern", 2, 2).cast("int") % 3 == 0, "").otherwise("ring").alias("base_pattern"), "confidence", "success_count", "failure_count",
    )
    return learning.pattern_boost(pairs, p).select("pair_id", F.round("boost", 6).alias("boost"))


@query
def feedback_insights(r):
    return learning.feedback_insights(r.feedback, as_of_events())


@query
def top_patterns(r):
    return learning.top_patterns(learning.domain_patterns(r.feedback)).select("pattern_type", "pattern", "sample_count", F.round("success_rate", 6).alias("success_rate"))


@query
def patterns_by_type(r):
    return learning.patterns_by_type(learning.domain_patterns(r.feedback)).select("pattern_type", "patterns", "position", "pattern", "sample_count")


@query
def knowledge_domains(r):
    return learning.knowledge_sets(r.feedback)


@query
def brand_interactions(r):
    return learning.brand_interactions(r.feedback).select("brand_name", "selections", "rejections", "last_interaction")


@query
def manual_split(r):
    return learning.manual_split(r.feedback, F.col("k") % 5 == 0, F.concat(F.lit("user"), (F.col("event_id") % 3).cast("string")))


@query
def merge_insights(r):
    p = learning.pattern_fold(_steps(r))
    f = r.feedback.withColumn("user_action", F.when(F.col("user_action") == "verified", "approved").otherwise("rejected"))
    return learning.merge_insights(p, f).withColumn("approval_rate", F.round("approval_rate", 6))


# --- exports -----------------------------------------------------------------------------------------
@query
def named_exports(r):
    """Rows of all named exports: the key of each and its count, where it has one."""
    views = export_views(r.brand_names, r.skus, importer_bridge(r), r.importers)
    keys = {"unmatched": "ttb_id", "importers": "permit_number", "active_importers": "permit_number", "importer_rankings": "permit_number"}
    amounts = {"brands_with_skus": "sku_count", "importer_rankings": "brand_count"}

    def rows(name: str) -> DataFrame:
        amount = F.col(amounts[name]) if name in amounts else F.lit(None)
        return views[name].select(F.lit(name).alias("export"), F.col(keys.get(name, "brand_name")).alias("key"), amount.cast("long").alias("amount"))

    return reduce(DataFrame.unionByName, map(rows, views))


@query
def filtered_export(r):
    """Matched brands of some size that have no enrichment document yet."""
    f = BrandFilter(min_skus=2, max_skus=9999, matched=True, enriched=False)
    hit = facets.filter_brands(r.brands, f, r.skus, importer_bridge(r))
    return hit.select("brand_name", "sku_count", F.array_join("countries", ", ").alias("countries"))


def _learning_export(r: Registry, terms: DataFrame) -> dict[str, DataFrame]:
    strategies = learning.with_examples(learning.strategy_patterns(_runs(r)), learning.with_strategy_key(_runs(r)))
    return learning.export_tables(r.feedback, learning.domain_patterns(r.feedback), terms, strategies)


@query
def export_learning_summary(r):
    """Summary figures; the terms, which have a query of their own, are not counted here."""
    none = r.spark.createDataFrame([], "term string, term_type string, success_rate double, sample_count long")
    return _learning_export(r, none)["summary_statistics"].filter(F.col("Metric") != "Relevance Patterns")


@query
def export_learning_strategies(r):
    none = r.spark.createDataFrame([], "term string, term_type string, success_rate double, sample_count long")
    return _learning_export(r, none)["strategy_patterns"]


# --- request log -------------------------------------------------------------------------------------
@query
def trailing_hour_count(r):
    return request_log.trailing_counts(r.requests, request_log.HOUR, "last_hour").select("event_id", "service", "last_hour")


@query
def burst_flag(r):
    return request_log.rate_limit_flags(r.requests, 5, 2).select("event_id", "last_hour", "last_five_minutes", "over_limit", "burst")


@query
def session_metrics(r):
    return request_log.session_metrics(r.requests)


@query
def session_metrics_stream(r):
    """session_metrics from the log read as a stream, with keyed state per (service, week)."""
    live = r.spark.readStream.schema(r.table("events").schema).parquet(f"{r.sf_dir}/events.parquet*")
    log = live.select("event_id", "ts", F.col("user_id").cast("long").alias("service"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"))
    return sessions.replayed_metrics(log)


@query
def failure_streak(r):
    return request_log.failure_streaks(r.requests, F.date_trunc("day", "ts")).select("event_id", "service", "failure_streak")


@query
def retention(r):
    return request_log.retain(r.requests, as_of_events(), 24 * 7).select("event_id", "service", "ok")


@query
def cached_results(r):
    asked = r.brand_names.select(F.col("brand_name").alias("query"))
    n = F.regexp_extract("brand_name", "([0-9]+)$", 1).cast("int")
    stored = r.brands.select(F.md5(F.concat(F.lit("bing_"), F.col("brand_name"))).alias("cache_key"), F.to_timestamp("updated_at").alias("ts"), n.alias("results"))
    return request_log.cached_results(stored, asked, F.to_timestamp(F.lit(AS_OF)), 60, "bing_").select("query", "results")


# --- people and companies -----------------------------------------------------------------------------
def _contacts(r: Registry) -> DataFrame:
    role = F.element_at(
        F.array(*[F.lit(t) for t in ("Owner", "VP Sales", "Sales Director", "Import Manager", "Office Manager", "Sales Rep", "Business Development", "Clerk")]),
        (F.col("c_custkey") % 8 + 1).cast("int"),
    )
    return r.table("customer").select(F.col("c_custkey").alias("contact_id"), F.col("c_nationkey").alias("company_id"), F.col("c_name").alias("contact_name"), role.alias("title"))


@query
def contact_relevance(r):
    t = F.col("title")
    s = contacts.contact_relevance(t)
    return _contacts(r).select("contact_id", s.alias("relevance_score"), (s >= 80).alias("is_decision_maker"))


@query
def contact_top(r):
    return contacts.rank_contacts(_contacts(r)).select("company_id", "contact_id", "relevance_score", "position")


def _companies(r: Registry) -> DataFrame:
    """Companies read off the brand domains: one per domain."""
    d = web.domain_of(F.col("url"))
    base = sites(r).select(d.alias("domain"), F.col("brand_name")).filter(F.col("domain").isNotNull())
    one = base.groupBy("domain").agg(F.min("brand_name").alias("company_name"))
    n = F.length("domain")
    return one.select(
        F.md5("domain").alias("company_id"), "company_name", "domain", F.when(n % 2 == 0, "Wine and Spirits").otherwise("Software").alias("industry"),
        F.lit("TEXAS").alias("country"), (n * 100).alias("employee_count"), F.concat(F.lit("https://"), F.col("domain")).alias("company_website"),
    )


@query
def company_match_domain(r):
    b = sites(r).select("brand_name", web.domain_of(F.col("url")).alias("domain")).filter(F.col("domain").isNotNull())
    return contacts.match_companies_by_domain(b, _companies(r)).select("brand_name", "domain", "company_id", "status", "match_confidence")


@query
def company_match(r):
    b = r.brands.filter(F.col("enrichment_data").isNull()).select("brand_name", "countries")
    return contacts.match_companies_by_name(b, _companies(r)).select(
        "brand_name", "company_name", "match_confidence", "status", "position"
    )


@query
def person_names(r):
    m = contacts.person_mentions(spread_if_narrow(r.table("documents"), "doc_id"), "text", "doc_id")
    return contacts.consolidate_people(m)


@query
def executive_titles(r):
    return r.table("documents").select(contacts.executive_title(F.col("text")).alias("title")).groupBy("title").agg(F.count("*").alias("documents"))


@query
def enrichment_confidence(r):
    k = F.col("k")
    c = contacts.enrichment_confidence(k % 3, k % 2 == 0, k % 4, k % 5, k % 2)
    return r.feedback.select("event_id", c.alias("confidence"))


@query
def contact_brand_match(r):
    """Contact list built from the customers: exact, suffixed and shortened brand names."""
    n = F.col("brand_name")
    k = F.regexp_extract(n, "([0-9]+)$", 1).cast("int") % 4
    listed = r.brand_names.select(
        F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(" Wines"))).when(k == 2, F.initcap(n)).otherwise(F.substring_index(n, " ", 2)).alias("company_name")
    )
    return contacts.match_contacts(listed, r.brand_names).select("company_name", "brand_name", "stage", F.round("similarity", 6).alias("similarity"))
