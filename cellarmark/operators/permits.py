"""Permit matching, classification, conversion and brand-producer attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarmark import rules
from cellarmark.functions.columns import clean_null, clean_permit, contains_any, words
from cellarmark.functions.names import is_white_label


HOLDER_COLUMNS = ["owner_name", "operating_name", "city", "state"]


def clean_labels(labels: DataFrame) -> DataFrame:
    """Trim and null the keys, upper-case permits, drop rows without a brand."""
    return labels.withColumns(
        {
            "permit_no": clean_permit(F.col("permit_no")),
            "brand_name": clean_null(F.col("brand_name")),
            "ttb_id": clean_null(F.col("ttb_id")),
        }
    ).filter(F.col("brand_name").isNotNull())


def permit_key_column(df: DataFrame) -> str:
    """The permit key of an upload: 'Permit_Number' when present, else the first *permit* column."""
    if "Permit_Number" in df.columns:
        return "Permit_Number"
    return next(c for c in df.columns if "permit" in c.lower())


def match_permits(labels: DataFrame, holders: DataFrame, label_key: str, holder_key: str) -> DataFrame:
    """Left join on cleaned permits with a Match_Status column; colliding names get '_importer'.

    Duplicate holder permits fan out, as an outer merge would. Catalyst broadcasts the holder side
    only when its measured size allows it.
    """
    taken = set(labels.columns)
    renamed = holders.select(
        clean_permit(F.col(holder_key)).alias("_key"),
        *[F.col(c).alias(f"{c}_importer" if c in taken else c) for c in holders.columns],
    ).filter(F.col("_key").isNotNull())
    left = labels.withColumn("_label_key", clean_permit(F.col(label_key)))
    joined = left.join(renamed, F.col("_label_key") == F.col("_key"), "left")
    status = F.when(F.col("_key").isNotNull(), "Matched").otherwise("No Match")
    return joined.withColumn("Match_Status", status).drop("_key", "_label_key")


def match_summary(matched: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("Match_Status") == "Matched")
    return matched.agg(
        F.count("*").alias("total_records"),
        hit.alias("matched_records"),
        (F.count("*") - hit).alias("unmatched_records"),
        F.round(hit / F.count("*") * 100, 2).alias("match_rate"),
    )


def union_producers(spirits: DataFrame, wines: DataFrame) -> DataFrame:
    return spirits.withColumn("producer_type", F.lit("spirit_producer")).unionByName(
        wines.withColumn("producer_type", F.lit("wine_producer"))
    )


def permit_masters(importers: DataFrame, spirits: DataFrame, wines: DataFrame) -> DataFrame:
    """One row per permit: importer before spirit producer before wine producer."""
    parts = [
        df.select("permit_number", *HOLDER_COLUMNS, F.lit(kind).alias("kind"), F.lit(rank).alias("_rank"))
        for rank, (kind, df) in enumerate(
            (("importer", importers), ("spirit_producer", spirits), ("wine_producer", wines)), start=1
        )
    ]
    cols = [*HOLDER_COLUMNS, "kind"]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("permit_number")
        .agg(F.min_by(F.struct(*cols), "_rank").alias("m"))
        .select("permit_number", *[F.col(f"m.{c}").alias(c) for c in cols])
    )


def classify_permits(permits: DataFrame, masters: DataFrame) -> DataFrame:
    """Tier of every permit: importer, spirit or wine producer, else the brand's own permit."""
    return permits.join(masters, F.col("permit_no") == F.col("permit_number"), "left").withColumn(
        "tier", F.coalesce("kind", F.lit("brand_permit"))
    )


def converted_permit(permit: Column) -> Column:
    """DSP-TX-n to TX-S-n and BWN-CA-n to CA-W-n; NULL for every other permit."""
    parts = F.split(permit, "-")
    letter = F.when(permit.startswith("DSP-"), "S").when(permit.startswith("BWN-"), "W")
    return F.when((F.size(parts) >= 3) & letter.isNotNull(), F.concat_ws("-", parts[1], letter, parts[2]))


def producers_of_permits(permits: DataFrame, spirits: DataFrame, wines: DataFrame) -> DataFrame:
    """Producer of each permit: the permit itself first, then its converted form, with provenance.

    A spirit producer matches a converted DSP permit only, a wine producer a converted BWN permit
    only; the letter in the converted key keeps them apart.
    """
    ranked = spirits.withColumns({"matched_via": F.lit("spirit_producer"), "_rank": F.lit(1)}).unionByName(
        wines.withColumns({"matched_via": F.lit("wine_producer"), "_rank": F.lit(2)})
    )
    cols = [*HOLDER_COLUMNS, "matched_via"]
    master = ranked.groupBy("permit_number").agg(F.min_by(F.struct(*cols), "_rank").alias("p"))
    direct = master.select(F.col("permit_number").alias("permit_no"), F.col("p").alias("direct"))
    fallback = master.select(F.col("permit_number").alias("converted_permit"), F.col("p").alias("fallback"))
    joined = (
        permits.withColumn("converted_permit", converted_permit(F.col("permit_no")))
        .join(direct, "permit_no", "left")
        .join(fallback, "converted_permit", "left")
    )
    used = F.col("direct").isNull() & F.col("fallback").isNotNull()
    hit = F.coalesce("direct", "fallback")
    return (
        joined.withColumn("converted_permit", F.when(used, F.col("converted_permit")))
        .select(*permits.columns, "converted_permit", *[hit[c].alias(c) for c in cols])
        .filter(F.col("matched_via").isNotNull())
    )


def producer_brands(skus: DataFrame, producers: DataFrame) -> DataFrame:
    """Brands and label counts of every producer permit."""
    counts = skus.groupBy("permit_no", "brand_name").agg(F.count("*").alias("sku_count"))
    return counts.join(producers, F.col("permit_no") == F.col("permit_number")).select(
        "permit_number", "owner_name", "producer_type", "brand_name", "sku_count"
    )


# --- brand-producer attribution -------------------------------------------------------------------
def _named_in(brand: Column, holder: Column) -> Column:
    up = F.upper(brand)
    return F.exists(words(F.upper(F.coalesce(holder, F.lit("")))), lambda w: (F.length(w) > 3) & up.contains(w))


def producer_relationship(brand: Column, owner: Column, operating: Column) -> Column:
    return (
        F.when(_named_in(brand, owner), "primary_producer")
        .when(is_white_label(brand), "contract_producer")
        .when(_named_in(brand, operating), "primary_producer")
        .otherwise("secondary_producer")
    )


def producer_confidence(brand: Column, owner: Column, relationship: Column) -> Column:
    weight = F.create_map(*[F.lit(x) for kv in rules.PRODUCER_WEIGHTS.items() for x in kv])[relationship]
    raised = F.when(_named_in(brand, owner), F.least(weight + 0.2, F.lit(1.0))).otherwise(weight)
    adjusted = F.when(
        is_white_label(brand),
        F.when(relationship == "contract_producer", F.least(raised + 0.1, F.lit(1.0))).otherwise(
            F.greatest(raised - 0.2, F.lit(0.1))
        ),
    ).otherwise(raised)
    return F.round(adjusted, 2)


def proposal_relationship(brand: Column, owner: Column) -> Column:
    """Shorter rule used inside proposals."""
    return (
        F.when(_named_in(brand, owner), "primary_producer")
        .when(contains_any(F.upper(brand), rules.PROPOSAL_CONTRACT_STORES), "contract_producer")
        .otherwise("secondary_producer")
    )


def proposal_producer_confidence(brand: Column, owner: Column) -> Column:
    return F.when(_named_in(brand, owner), 0.9).otherwise(0.7)


def brand_producers(brand_permits: DataFrame, spirits: DataFrame, wines: DataFrame) -> DataFrame:
    """Brand x producer with relationship and attribution confidence (spirit before wine)."""
    master = (
        union_producers(spirits, wines)
        .withColumn("_rank", F.when(F.col("producer_type") == "spirit_producer", 1).otherwise(2))
        .groupBy("permit_number")
        .agg(F.min_by(F.struct("owner_name", "operating_name", "producer_type"), "_rank").alias("p"))
    )
    brand, owner, operating = F.col("brand_name"), F.col("p.owner_name"), F.col("p.operating_name")
    return (
        brand_permits.join(master, F.col("permit_no") == F.col("permit_number"))
        .withColumn("relationship", producer_relationship(brand, owner, operating))
        .withColumn("confidence", producer_confidence(brand, owner, F.col("relationship")))
        .select(
            "brand_name", "permit_no", owner.alias("owner_name"), operating.alias("operating_name"),
            F.col("p.producer_type").alias("producer_type"), "relationship", "confidence",
        )
    )


def production_types(brand_names: DataFrame, attributed: DataFrame) -> DataFrame:
    """White-label candidate flag and production type per brand."""
    brand_words = words(F.upper(F.col("brand_name")))
    shared = F.arrays_overlap(brand_words, words(F.upper(F.col("owner_name"))))
    per_brand = attributed.groupBy("brand_name").agg(
        F.count("*").alias("producer_count"), F.max(shared).alias("named_after_producer")
    )
    has = F.coalesce("producer_count", F.lit(0)) > 0
    candidate = is_white_label(F.col("brand_name")) | (has & ~F.coalesce("named_after_producer", F.lit(False)))
    return brand_names.join(per_brand, "brand_name", "left").select(
        "brand_name",
        F.coalesce("producer_count", F.lit(0)).alias("producer_count"),
        candidate.alias("is_white_label_candidate"),
        F.when(candidate, "contract_production").when(has, "own_brand").otherwise("unknown").alias("production_type"),
    )


def producer_analysis_totals(types: DataFrame) -> DataFrame:
    return types.agg(
        F.count("*").alias("total_brands"),
        F.count_if(F.col("producer_count") > 0).alias("brands_with_producers"),
        F.count_if("is_white_label_candidate").alias("white_label_candidates"),
    )


