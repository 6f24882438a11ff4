"""Faceted brand queries: summary, filters, paging, facet counts, details and listings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarmark import rules
from cellarmark.functions.columns import string_array
from cellarmark.functions.documents import parse_document, site_columns, website_view
from cellarmark.functions.web import escape_like
from cellarmark.operators.permits import classify_permits, producers_of_permits


@dataclass(frozen=True)
class BrandFilter:
    """Facet selection: OR inside a facet, AND across facets."""

    search: str = ""
    countries: tuple[str, ...] = ()
    class_types: tuple[str, ...] = ()
    website: tuple[str, ...] = ()
    importers: tuple[str, ...] = ()
    producers: tuple[str, ...] = ()
    min_skus: int | None = None
    max_skus: int | None = None
    matched: bool | None = None
    enriched: bool | None = None
    sort: str = "name"
    descending: bool = False
    page: int = 1
    per_page: int = 24



def search_names(names: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Case-insensitive substring search, ordered, first hundred."""
    pattern = f"%{escape_like(query)}%"
    return names.filter(F.col("brand_name").ilike(pattern)).orderBy("brand_name").limit(limit)


def producer_label_prefix(label: str) -> str | None:
    """'Bonded Winery (CA)' to 'BWN-CA-'."""
    if not (label.endswith(")") and " (" in label):
        return None
    kind, state = label[:-1].split(" (", 1)
    code = {name: code for code, name in rules.PERMIT_TYPE_NAMES.items()}.get(kind, kind)
    return f"{code}-{state}-"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def filter_brands(brands: DataFrame, f: BrandFilter, skus: DataFrame | None = None, importer_bridge: DataFrame | None = None) -> DataFrame:
    """All facet predicates; importer and producer facets are left-semi joins on their bridges."""
    out = brands
    if f.search:
        out = out.filter(F.col("brand_name").ilike(f"%{escape_like(f.search)}%"))
    if f.countries:
        out = out.filter(F.arrays_overlap("countries", string_array(f.countries)))
    if f.class_types:
        lowered = [t.lower() for t in f.class_types]
        out = out.filter(F.exists("class_types", lambda x: _any([F.lower(x).contains(t) for t in lowered])))
    if f.website:
        s = site_columns(F.col("enrichment_data"), F.col("website"))
        tests = {"has_website": s["has_website"], "verified": s["any_verified"], "no_website": ~s["has_website"]}
        out = out.filter(_any([tests[w] for w in f.website]))
    if f.min_skus is not None:
        out = out.filter(F.col("sku_count") >= f.min_skus)
    if f.max_skus is not None:
        out = out.filter(F.col("sku_count") <= f.max_skus)
    if f.enriched is not None:
        out = out.filter(F.col("enrichment_data").isNotNull() == F.lit(f.enriched))
    if f.importers:
        wanted = importer_bridge.filter(F.col("owner_name").isin(*f.importers) | F.col("permit_no").isin(*f.importers))
        out = out.join(wanted.select("brand_name"), "brand_name", "left_semi")
    if f.matched is not None:
        out = out.join(importer_bridge.select("brand_name"), "brand_name", "left_semi" if f.matched else "left_anti")
    if f.producers:
        prefixes = [p for p in map(producer_label_prefix, f.producers) if p]
        wanted = skus.filter(_any([F.col("permit_no").startswith(p) for p in prefixes]))
        out = out.join(wanted.select("brand_name"), "brand_name", "left_semi")
    return out


def sort_brands(df: DataFrame, sort: str, descending: bool) -> DataFrame:
    column = F.col({"skus": "sku_count", "created": "created_date"}.get(sort, "brand_name"))
    return df.orderBy(column.desc() if descending else column.asc(), "brand_name")


def page_of(df: DataFrame, page: int, per_page: int) -> DataFrame:
    return df.offset((page - 1) * per_page).limit(per_page)


def page_info(df: DataFrame, page: int, per_page: int) -> DataFrame:
    """Pagination row: total, pages, has_prev, has_next."""
    total = F.count("*")
    pages = F.floor((total + per_page - 1) / per_page)
    return df.agg(
        total.alias("total"),
        pages.alias("pages"),
        F.lit(page).alias("page"),
        F.lit(page > 1).alias("has_prev"),
        (F.lit(page) < pages).alias("has_next"),
    )


def brand_summary(brands: DataFrame, brand_permits: DataFrame, masters: DataFrame, spirits: DataFrame, wines: DataFrame) -> DataFrame:
    """Brand summary: matched importers, producers (with the converted-permit fallback), own permits.

    Everything is aggregated on the brand-permit bridge and joined once; no per-brand lookups.
    """
    tiers = classify_permits(brand_permits, masters)
    per_brand = tiers.groupBy("brand_name").agg(
        F.count_if((F.col("tier") == "importer") & F.col("permit_no").contains("-I-")).alias("importer_count"),
        F.count_if(F.col("tier").endswith("_producer")).alias("direct_producers"),
        F.count_if(
            (F.col("tier") == "brand_permit") | ((F.col("tier") == "importer") & ~F.col("permit_no").contains("-I-"))
        ).alias("own_permit_count"),
    )
    found = producers_of_permits(brand_permits, spirits, wines)
    fallback = found.groupBy("brand_name").agg(F.count("*").alias("found_producers"))
    return (
        brands.join(per_brand, "brand_name", "left")
        .join(fallback, "brand_name", "left")
        .withColumn(
            "producer_count",
            F.when(F.col("direct_producers") > 0, F.col("direct_producers")).otherwise(F.coalesce("found_producers", F.lit(0))),
        )
        .drop("direct_producers", "found_producers")
    )


def brand_detail(brands: DataFrame, tiers: DataFrame, name: str) -> DataFrame:
    """Header of one brand: arrays, permit counts by tier, resolved website. Labels come separately."""
    key = F.col("brand_name") == name
    held = tiers.filter(key).groupBy("brand_name").agg(
        F.count_if(F.col("tier") == "importer").alias("importers"),
        F.count_if(F.col("tier").endswith("_producer")).alias("producers"),
        F.count_if(F.col("tier") == "brand_permit").alias("own_permits"),
    )
    site = website_view(F.col("enrichment_data"), F.col("website"))
    return brands.filter(key).withColumn("site", site).join(held, "brand_name", "left")


def brand_labels(skus: DataFrame, name: str) -> DataFrame:
    """Labels of one brand, one row each."""
    return skus.filter(F.col("brand_name") == name)


def brand_permit_rows(tiers: DataFrame, name: str) -> DataFrame:
    """Permits of one brand with tier and holder, one row each."""
    return tiers.filter(F.col("brand_name") == name).select("permit_no", "tier", "owner_name", "operating_name")


# --- facet counts -------------------------------------------------------------------------------
def _facet(df: DataFrame, facet: str, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).select(F.lit(facet).alias("facet"), "value", "n")


def website_facets(brands: DataFrame, strict: bool) -> DataFrame:
    """Website status counts: by presence of either column, or strictly by parsed content."""
    doc = parse_document(F.col("enrichment_data"))
    if strict:
        s = site_columns(F.col("enrichment_data"), F.col("website"))
        has, verified = s["has_website"], s["has_website"] & s["any_verified"]
    else:
        has = F.col("enrichment_data").isNotNull() | F.col("website").isNotNull()
        verified = F.coalesce(doc["website"]["verification_status"] == "verified", F.lit(False))
    counts = brands.agg(F.count_if(has).alias("h"), F.count_if(verified).alias("v"), F.count_if(~has).alias("n"))
    return counts.select(
        F.explode(
            F.array(
                F.struct(F.lit("has_website").alias("value"), F.col("h").alias("n")),
                F.struct(F.lit("verified").alias("value"), F.col("v").alias("n")),
                F.struct(F.lit("no_website").alias("value"), F.col("n").alias("n")),
            )
        ).alias("x")
    ).select(F.lit("websiteStatus").alias("facet"), "x.value", "x.n")


def label_facets(skus: DataFrame) -> DataFrame:
    """Country and class facets from one scan of the labels."""
    pairs = F.array(
        F.struct(F.lit("countries").alias("facet"), F.col("origin_desc").alias("value")),
        F.struct(F.lit("alcoholTypes").alias("facet"), F.col("class_type_desc").alias("value")),
    )
    seen = skus.select("brand_name", "origin_desc", "class_type_desc").distinct()
    rows = seen.select("brand_name", F.explode(pairs).alias("p")).select("brand_name", "p.*").filter(F.col("value").isNotNull())
    return rows.distinct().groupBy("facet", "value").agg(F.count("*").alias("n"))


def facet_counts(skus: DataFrame, brand_sites: DataFrame, tiers: DataFrame) -> DataFrame:
    """Facet counts with importer and producer owner names."""
    named = tiers.filter(F.coalesce(F.col("owner_name"), F.lit("")) != "")
    return (
        label_facets(skus)
        .unionByName(_facet(named.filter(F.col("tier") == "importer"), "importers", "owner_name"))
        .unionByName(_facet(named.filter(F.col("tier").endswith("_producer")), "producers", "owner_name"))
        .unionByName(website_facets(brand_sites, strict=False))
    )


def producer_label(permit: Column) -> Column:
    parts = F.split(permit, "-")
    names = F.create_map(*[F.lit(x) for kv in rules.PERMIT_TYPE_NAMES.items() for x in kv])
    label = F.concat(F.coalesce(F.try_element_at(names, parts[0]), parts[0]), F.lit(" ("), parts[1], F.lit(")"))
    return F.when(F.size(parts) >= 3, label)


def permit_label_facets(brand_permits: DataFrame) -> DataFrame:
    """Producer facet by permit label: distinct brands per permit, summed per label."""
    held = brand_permits.filter(~F.col("permit_no").contains("-I-") & (F.col("permit_no") != ""))
    return (
        held.withColumn("label", producer_label(F.col("permit_no")))
        .filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count("*").alias("n"))
    )


def facet_counts_by_label(skus: DataFrame, brand_sites: DataFrame, tiers: DataFrame, brand_permits: DataFrame) -> DataFrame:
    """The other facet variant: producer labels from permits, strict website status."""
    named = tiers.filter((F.col("tier") == "importer") & F.col("permit_no").contains("-I-"))
    return (
        label_facets(skus)
        .unionByName(_facet(named, "importers", "owner_name"))
        .unionByName(permit_label_facets(brand_permits).select(F.lit("producers").alias("facet"), F.col("label").alias("value"), "n"))
        .unionByName(website_facets(brand_sites, strict=True))
    )


def summary_facets(summary: DataFrame) -> DataFrame:
    """Fallback facets computed from the array columns of brand summaries."""
    return _facet(summary.select(F.explode("countries").alias("c")), "countries", "c").unionByName(
        _facet(summary.select(F.explode("class_types").alias("c")), "alcoholTypes", "c")
    )


def table_stats(brand_sites: DataFrame, skus: DataFrame, importers: DataFrame, importer_bridge: DataFrame) -> DataFrame:
    """Totals, importers with brands, brands with a URL; one row."""
    s = site_columns(F.col("enrichment_data"), F.col("website"))
    b = brand_sites.agg(F.count("*").alias("total_brands"), F.count_if(s["url"].isNotNull()).alias("brands_with_websites"))
    k = skus.agg(F.count("*").alias("total_skus"))
    i = importers.agg(F.count("*").alias("total_importers"))
    a = importer_bridge.agg(F.count_distinct("permit_no").alias("active_importers"))
    return b.crossJoin(k).crossJoin(i).crossJoin(a)  # four single-row frames side by side


# --- listings -----------------------------------------------------------------------------------
def list_holders(holders: DataFrame, search: str, columns: list[str], sort: str, descending: bool = False, kind: str | None = None) -> DataFrame:
    """Contains-search over several columns, optional type filter, case-insensitive sort."""
    out = holders
    if search:
        out = out.filter(_any([F.lower(F.coalesce(F.col(c), F.lit(""))).contains(search.lower()) for c in columns]))
    if kind:
        out = out.filter(F.col("producer_type") == kind)
    key = F.lower(F.coalesce(F.col(sort), F.lit("")))
    return out.orderBy(key.desc() if descending else key.asc(), "permit_number")


def importer_brand_counts(tiers: DataFrame) -> DataFrame:
    """Brand count of every real importer."""
    real = tiers.filter((F.col("tier") == "importer") & F.col("permit_no").contains("-I-"))
    return real.groupBy("permit_no").agg(
        F.first("owner_name").alias("owner_name"),
        F.first("operating_name").alias("operating_name"),
        F.count("*").alias("brand_count"),
    )


def importer_brands(tiers: DataFrame) -> DataFrame:
    """Brands of every real importer, one row each: the list stays flat however long it is."""
    return tiers.filter((F.col("tier") == "importer") & F.col("permit_no").contains("-I-")).select(
        "permit_no", "owner_name", "brand_name"
    )


def importer_leaderboard(counts: DataFrame, by: str = "brands") -> DataFrame:
    """Importers with brands, by brand count or by owner-or-operating name."""
    name = F.coalesce(F.nullif("owner_name", F.lit("")), "operating_name")
    named = counts.filter(F.col("brand_count") > 0).withColumn("company_name", name)
    if by == "brands":
        return named.orderBy(F.desc("brand_count"), "permit_no")
    return named.orderBy(F.lower("company_name"), "permit_no")


def review_queue(brand_sites: DataFrame) -> DataFrame:
    s = site_columns(F.col("enrichment_data"), F.col("website"))
    return brand_sites.withColumns({k: s[k] for k in ("url", "confidence", "needs_review")}).filter("needs_review")


def review_triage(brand_sites: DataFrame) -> DataFrame:
    """Counters of the review screen: status and confidence bands."""
    s = site_columns(F.col("enrichment_data"), F.col("website"))
    c = F.col("confidence")
    return (
        brand_sites.withColumns({k: s[k] for k in ("url", "confidence", "verified", "needs_review")})
        .filter(F.col("url").isNotNull())
        .agg(
            F.count("*").alias("total"),
            F.count_if("verified").alias("verified"),
            F.count_if("needs_review").alias("needs_review"),
            F.count_if(c < 0.5).alias("low"),
            F.count_if((c >= 0.5) & (c <= 0.8)).alias("medium"),
            F.count_if(c > 0.8).alias("high"),
        )
    )


def contact_candidates(brand_sites: DataFrame, status: Column, limit: int = 100) -> DataFrame:
    """Brands with a URL and no contact match started."""
    s = site_columns(F.col("enrichment_data"), F.col("website"))
    open_status = status.isNull() | (status == "not_started")
    return (
        brand_sites.withColumn("url", s["url"]).filter(F.col("url").isNotNull() & open_status).orderBy("brand_name").limit(limit)
    )


