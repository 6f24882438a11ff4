"""Market report: overview, geography, products, concentration, growth, coverage, trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarmark import rules
from cellarmark.functions.columns import contains_any, percent, registry_date, words
from cellarmark.functions.documents import site_columns


def dated(skus: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Labels whose M/D/YYYY completion date lies in the range; unparsable dates are dropped."""
    out = skus
    if start and end:
        day = registry_date(F.col("completed_date"))
        out = out.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out


def brands_with_dates(brands: DataFrame, skus: DataFrame) -> DataFrame:
    """Brands that have any dated label (the EXISTS test)."""
    return brands.join(skus.filter(F.col("completed_date") != "").select("brand_name"), "brand_name", "left_semi")


def single_row(*frames: DataFrame) -> DataFrame:
    """Lay one-row aggregates side by side."""
    return reduce(lambda a, b: a.crossJoin(b), frames)


def overview(brand_sites: DataFrame, skus: DataFrame, importers: DataFrame, importer_bridge: DataFrame) -> DataFrame:
    s = site_columns(F.col("enrichment_data"), F.col("website"))
    per_brand = skus.groupBy("brand_name").agg(F.count("*").alias("n"))
    row = single_row(
        brand_sites.agg(F.count("*").alias("total_brands"), F.count_if(s["url"].isNotNull()).alias("brands_with_websites")),
        per_brand.agg(F.sum("n").alias("total_skus"), F.round(F.avg("n"), 1).alias("avg_skus_per_brand")),
        importers.agg(F.count("*").alias("total_importers")),
        importer_bridge.agg(F.count_distinct("permit_no").alias("active_importers")),
    )
    return row.withColumn("enrichment_rate", percent(F.col("brands_with_websites"), F.col("total_brands")))


def overview_dated(brands: DataFrame, skus: DataFrame, start: str, end: str) -> DataFrame:
    """Brands with any dated label, and labels inside the range."""
    return single_row(
        brands_with_dates(brands, skus).agg(F.count("*").alias("total_brands")),
        dated(skus, start, end).agg(F.count("*").alias("total_skus")),
    )


# --- geography ----------------------------------------------------------------------------------
def geography(skus: DataFrame) -> DataFrame:
    """Brands per country and per US state; a brand with any US origin counts once as United States.

    The labels are scanned once and reduced to (brand, origin) pairs; each pair then becomes the
    entries it feeds.
    """
    pairs = skus.select("brand_name", "origin_desc").distinct()
    up = F.upper("origin_desc")
    is_state, is_us = up.isin(*rules.REPORT_STATES), up.isin(*rules.US_NAMES)

    def entry(cond: Column, kind: str, name: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), name.alias("name")))

    entries = F.array(
        entry(is_state, "state", F.col("origin_desc")),
        entry(~is_state & ~is_us, "country", F.col("origin_desc")),
        entry(is_state | is_us, "country", F.lit("United States")),
    )
    rows = pairs.select("brand_name", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
    return rows.select("brand_name", "e.*").distinct().groupBy("kind", "name").agg(F.count("*").alias("n"))


def top_share(counts: DataFrame, total: DataFrame, k: int, name: str = "name", by: str = "n") -> DataFrame:
    """Top k by count, name as tie-break, with a percentage of the one-row total."""
    return (
        counts.orderBy(F.desc(by), name).limit(k).crossJoin(total).withColumn("percentage", percent(F.col(by), F.col("total"))).drop("total")
    )


def domestic_split(skus: DataFrame) -> DataFrame:
    up = F.upper("origin_desc")
    per_brand = skus.groupBy("brand_name").agg(F.max(up.isin(*rules.REPORT_STATES, *rules.US_NAMES)).alias("us"))
    row = per_brand.agg(F.count_if("us").alias("domestic"), F.count_if(~F.col("us")).alias("international"))
    total = F.col("domestic") + F.col("international")
    return row.withColumns(
        {"domestic_percentage": percent(F.col("domestic"), total), "international_percentage": percent(F.col("international"), total)}
    )


# --- products -----------------------------------------------------------------------------------
def class_counts(skus: DataFrame) -> DataFrame:
    return (
        skus.select("brand_name", "class_type_desc").distinct().groupBy(F.col("class_type_desc").alias("name")).agg(F.count("*").alias("n"))
    )


def category_of(class_type: Column) -> Column:
    up, out = F.upper(class_type), None
    for category, keywords in rules.CATEGORY_KEYWORDS.items():
        hit = contains_any(up, keywords)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("Other")


def category_rollup(counts: DataFrame) -> DataFrame:
    return counts.groupBy(category_of(F.col("name")).alias("category")).agg(F.sum("n").alias("n"))


def sku_bucket(n: Column) -> Column:
    return (
        F.when(n == 1, "Single SKU")
        .when(n.between(2, 5), "2-5 SKUs")
        .when(n.between(6, 10), "6-10 SKUs")
        .when(n.between(11, 20), "11-20 SKUs")
        .when(n.between(21, 50), "21-50 SKUs")
        .otherwise("50+ SKUs")
    )


def brand_bucket(n: Column) -> Column:
    return (
        F.when(n == 0, "No brands")
        .when(n == 1, "1 brand")
        .when(n.between(2, 5), "2-5 brands")
        .when(n.between(6, 10), "6-10 brands")
        .when(n.between(11, 20), "11-20 brands")
        .when(n.between(21, 50), "21-50 brands")
        .otherwise("50+ brands")
    )


def sku_histogram(skus: DataFrame) -> DataFrame:
    per_brand = skus.groupBy("brand_name").agg(F.count("*").alias("n"))
    return per_brand.groupBy(sku_bucket(F.col("n")).alias("range_name")).agg(F.count("*").alias("brand_count"))


# --- importers ----------------------------------------------------------------------------------
def importer_counts(importers: DataFrame, importer_bridge: DataFrame) -> DataFrame:
    """Brand count of every importer, zero included."""
    counts = importer_bridge.groupBy("permit_no").agg(F.count("*").alias("brand_count"))
    name = F.coalesce(F.nullif("owner_name", F.lit("")), F.nullif("operating_name", F.lit("")), F.lit("Unknown"))
    return importers.join(counts, F.col("permit_number") == F.col("permit_no"), "left").select(
        "permit_number", name.alias("company_name"), F.coalesce("brand_count", F.lit(0)).alias("brand_count")
    )


def importer_histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy(brand_bucket(F.col("brand_count")).alias("range_name")).agg(F.count("*").alias("importer_count"))


def importer_top(counts: DataFrame, k: int = 20) -> DataFrame:
    """Top importers with their share among the listed ones (a k-row window)."""
    top = counts.filter(F.col("brand_count") > 0).orderBy(F.desc("brand_count"), "permit_number").limit(k)
    share = F.col("brand_count") / F.sum("brand_count").over(Window.partitionBy()) * 100
    return top.withColumn("market_share", F.round(share, 1))


def top_ten_share(counts: DataFrame) -> DataFrame:
    top = counts.orderBy(F.desc("brand_count"), "permit_number").limit(10).agg(F.sum("brand_count").alias("top_10_importers"))
    row = single_row(top, counts.agg(F.sum("brand_count").alias("all_brands")))
    return row.select(
        "top_10_importers",
        (F.col("all_brands") - F.col("top_10_importers")).alias("others"),
        percent(F.col("top_10_importers"), F.col("all_brands")).alias("top_10_percentage"),
    )


def concentration(counts: DataFrame) -> DataFrame:
    """HHI, CR4, CR8 and the structure label.

    sum(share^2) = sum(n^2) / sum(n)^2, so one plain aggregate gives the index; the ratios need only
    the eight largest counts.
    """
    active = counts.filter(F.col("brand_count") > 0)
    n = F.col("brand_count").cast("double")
    totals = active.agg(F.sum(n).alias("total"), F.sum(n * n).alias("squares"), F.count("*").alias("importers"))
    top = active.orderBy(F.desc("brand_count"), "permit_number").limit(8).agg(
        F.array_sort(F.collect_list("brand_count"), lambda a, b: b.cast("int") - a.cast("int")).alias("top")
    )
    head = lambda k: F.aggregate(F.slice("top", 1, k), F.lit(0).cast("long"), lambda a, x: a + x)
    hhi = F.coalesce(F.col("squares") / (F.col("total") * F.col("total")) * 10000, F.lit(0.0))

    def ratio(k: int) -> Column:
        return F.when(F.col("importers") >= k, F.round(head(k) / F.col("total") * 100, 1)).otherwise(0.0)

    structure = (
        F.when(F.col("importers") == 0, "Unknown").when(hhi < 1500, "Competitive").when(hhi < 2500, "Moderately Concentrated").otherwise("Highly Concentrated")
    )
    return single_row(totals, top).select(
        F.round(hhi, 1).alias("herfindahl_index"),
        ratio(4).alias("concentration_ratio_cr4"),
        ratio(8).alias("concentration_ratio_cr8"),
        structure.alias("market_structure"),
    )


def growth(skus: DataFrame, counts: DataFrame) -> DataFrame:
    def spread(df: DataFrame, column: str, subject: str) -> DataFrame:
        return df.agg(
            F.lit(subject).alias("subject"),
            F.round(F.avg(column), 1).alias("average"),
            F.max(column).alias("maximum"),
            F.min(column).alias("minimum"),
        )

    per_brand = skus.groupBy("brand_name").agg(F.count("*").alias("n"))
    return spread(counts.filter(F.col("brand_count") > 0), "brand_count", "brands_per_importer").unionByName(
        spread(per_brand, "n", "skus_per_brand")
    )


def coverage(brand_sites: DataFrame, like_match: bool = False) -> DataFrame:
    s = site_columns(F.col("enrichment_data"), F.col("website"))
    enriched = F.col("enrichment_data").isNotNull() & (F.col("enrichment_data") != "{}")
    verified = F.col("enrichment_data").like("%verified%true%") if like_match else s["verified"]
    row = brand_sites.agg(
        F.count("*").alias("total_brands"),
        F.count_if(enriched).alias("enriched_brands"),
        F.count_if(s["url"].isNotNull()).alias("brands_with_websites"),
        F.count_if(verified).alias("verified_websites"),
    )
    return row.withColumns(
        {
            "enrichment_rate": percent(F.col("enriched_brands"), F.col("total_brands")),
            "website_rate": percent(F.col("brands_with_websites"), F.col("total_brands")),
            "verification_rate": percent(F.col("verified_websites"), F.col("enriched_brands")),
        }
    )


def top_performers(skus: DataFrame, k: int = 10) -> DataFrame:
    """Three top lists: by labels, by countries (> 1), by class types (> 1)."""
    per_brand = skus.groupBy("brand_name").agg(F.count("*").alias("skus"))
    countries = skus.select("brand_name", "origin_desc").distinct().groupBy("brand_name").agg(F.count("*").alias("countries"))
    types = skus.select("brand_name", "class_type_desc").distinct().groupBy("brand_name").agg(F.count("*").alias("types"))

    def top(df: DataFrame, column: str, label: str, least: int) -> DataFrame:
        return (
            df.filter(F.col(column) > least)
            .orderBy(F.desc(column), "brand_name")
            .limit(k)
            .select(F.lit(label).alias("list"), "brand_name", F.col(column).alias("n"))
        )

    return top(per_brand, "skus", "brands_by_skus", 0).unionByName(top(countries, "countries", "brands_by_countries", 1)).unionByName(
        top(types, "types", "multi_product_brands", 1)
    )


def keyword_counts(brand_names: DataFrame) -> DataFrame:
    w = F.explode(words(F.upper("brand_name"))).alias("keyword")
    return (
        brand_names.select(w)
        .filter((F.length("keyword") > 3) & ~F.col("keyword").isin(*rules.KEYWORD_STOP_WORDS))
        .groupBy("keyword")
        .agg(F.count("*").alias("frequency"))
    )


def permit_type_counts(importers: DataFrame) -> DataFrame:
    letter = F.substring_index(F.col("permit_number"), "-", 2)
    code = F.substring(F.substring_index(letter, "-", -1), 1, 1)
    return (
        importers.filter(F.col("permit_number").isNotNull())
        .groupBy(F.concat(code, F.lit("-permit")).alias("type"))
        .agg(F.count("*").alias("n"))
    )


# --- dashboard charts ---------------------------------------------------------------------------
def chart_location(place: Column, mode: str) -> Column:
    low = F.lower(place)
    is_state = reduce(
        lambda a, b: a | b, [low.contains(s.lower()) | F.lit(s.lower()).contains(low) for s in rules.CHART_STATES]
    )
    if mode == "countries":
        return F.when(is_state, "United States").otherwise(place)
    if mode == "usa-states":
        return F.when(is_state, place)
    return place


def location_chart(skus: DataFrame, mode: str = "countries") -> DataFrame:
    """Brand mentions per mapped location; mapping runs on the distinct locations only."""
    counts = skus.select("brand_name", "origin_desc").distinct().groupBy("origin_desc").agg(F.count("*").alias("n"))
    return (
        counts.withColumn("location", chart_location(F.col("origin_desc"), mode))
        .filter(F.col("location").isNotNull())
        .groupBy("location")
        .agg(F.sum("n").alias("n"))
    )


def simplified_class(c: Column) -> Column:
    low, out = F.lower(c), None
    for triggers, refinements, default in rules.CLASS_CHART_RULES:
        inner = None
        for terms, label in refinements:
            hit = contains_any(low, terms)
            inner = F.when(hit, label) if inner is None else inner.when(hit, label)
        value = inner.otherwise(default) if inner is not None else F.lit(default)
        hit = contains_any(low, triggers)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.when(F.length(c) > 25, F.concat(F.substring(c, 1, 25), F.lit("..."))).otherwise(c))


def class_chart(counts: DataFrame, simplified: bool = True) -> DataFrame:
    c = F.col("name")
    detailed = F.when(F.length(c) > 30, F.concat(F.substring(c, 1, 30), F.lit("..."))).otherwise(c)
    return counts.groupBy((simplified_class(c) if simplified else detailed).alias("class")).agg(F.sum("n").alias("n"))


# --- whole report ---------------------------------------------------------------------------------
def long_format(section: str, df: DataFrame, label: str | None = None) -> DataFrame:
    """(section, name, metric, value) rows of a wide frame."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double")]
    name = F.col(label) if label else F.lit("")
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric])
    return df.select(F.lit(section).alias("section"), name.alias("name"), F.explode(pairs).alias("p")).select(
        "section", "name", "p.metric", "p.value"
    )


def full_report(brand_sites: DataFrame, skus: DataFrame, importers: DataFrame, importer_bridge: DataFrame) -> DataFrame:
    """All report sections in long format."""
    counts = importer_counts(importers, importer_bridge)
    classes = class_counts(skus)
    sections = [
        long_format("overview", overview(brand_sites, skus, importers, importer_bridge)),
        long_format("geographic", geography(skus), "name"),
        long_format("domestic", domestic_split(skus)),
        long_format("product", classes, "name"),
        long_format("category", category_rollup(classes), "category"),
        long_format("sku_distribution", sku_histogram(skus), "range_name"),
        long_format("importer", importer_histogram(counts), "range_name"),
        long_format("concentration", concentration(counts)),
        long_format("growth", growth(skus, counts), "subject"),
        long_format("coverage", coverage(brand_sites)),
        long_format("top", top_performers(skus), "brand_name"),
        long_format("permit_types", permit_type_counts(importers), "type"),
    ]
    return reduce(DataFrame.unionByName, sections)
