"""Keyed upserts, brand merges and website state, as new snapshots of the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarmark.functions.columns import clean_permit
from cellarmark.operators.sliced import row_numbers


def last_in_file(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last of the upload. An aggregate, so duplicates combine before the shuffle."""
    rest = [c for c in batch.columns if c not in (key, order)]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def upsert(existing: DataFrame, batch: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Replace or insert by key; ``keep`` columns retain their old value. Adds change_type."""
    new = last_in_file(batch, key, order)
    cols = [c for c in existing.columns if c != key]
    old = existing.select(F.col(key).alias("_k"), F.struct(*cols).alias("_old"))
    fresh = new.select(F.col(key).alias("_nk"), F.struct(*[c for c in new.columns if c != key]).alias("_new"))
    joined = old.join(fresh, F.col("_k") == F.col("_nk"), "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col("_old")[c]
        if c in keep:
            return F.coalesce(F.col("_old")[c], F.col("_new")[c])
        return F.when(F.col("_nk").isNotNull(), F.col("_new")[c]).otherwise(F.col("_old")[c])

    change = F.when(F.col("_k").isNull(), "new").when(F.col("_nk").isNotNull(), "updated").otherwise("unchanged")
    return joined.select(F.coalesce("_k", "_nk").alias(key), *[value(c).alias(c) for c in cols], change.alias("change_type"))


def upload_counters(batch: DataFrame, existing_skus: DataFrame, existing_brands: DataFrame, masters: DataFrame) -> DataFrame:
    """Total, matched, new brands, new and updated labels of one upload.

    Row-by-row semantics: the first row of an unknown key is new, every further row is an update.
    """
    rows = batch.join(masters.filter(F.col("kind") == "importer").select("permit_number"), F.col("permit_no") == F.col("permit_number"), "left")
    totals = rows.agg(F.count("*").alias("total_records"), F.count("permit_number").alias("matched_records"))
    new_brands = batch.select("brand_name").distinct().join(existing_brands.select("brand_name"), "brand_name", "left_anti")
    new_skus = batch.select("ttb_id").distinct().join(existing_skus.select("ttb_id"), "ttb_id", "left_anti")
    row = totals.crossJoin(new_brands.agg(F.count("*").alias("new_brands"))).crossJoin(new_skus.agg(F.count("*").alias("new_skus")))
    return row.withColumn("updated_skus", F.col("total_records") - F.col("new_skus"))


def upsert_brands(existing: DataFrame, batch: DataFrame, sets: dict[str, str]) -> DataFrame:
    """Add the batch's permits, countries and class types to the brand sets; create unseen brands.

    ``sets`` maps a brand array column to the batch column feeding it.
    """
    grown = batch.groupBy("brand_name").agg(*[F.collect_set(source).alias(f"_{target}") for target, source in sets.items()])
    empty = F.array().cast("array<string>")
    out = existing.withColumn("_old", F.lit(True)).join(grown.withColumn("_new", F.lit(True)), "brand_name", "full_outer")
    merged = {t: F.array_sort(F.array_union(F.coalesce(t, empty), F.coalesce(f"_{t}", empty))) for t in sets}
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNotNull(), "updated").otherwise("unchanged")
    return out.withColumns(merged).withColumn("change_type", change).drop("_old", "_new", *[f"_{t}" for t in sets])


def replace_masters(existing: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """INSERT OR REPLACE of permit holders by cleaned permit number."""
    cleaned = batch.withColumn("permit_number", clean_permit(F.col("permit_number"))).filter(F.col("permit_number").isNotNull())
    return upsert(existing, cleaned, "permit_number", order)


def change_counts(changed: DataFrame) -> DataFrame:
    return changed.groupBy("change_type").agg(F.count("*").alias("n"))


# --- merging brands -------------------------------------------------------------------------------
def merge_brands(brands: DataFrame, mapping: DataFrame, verified: Column) -> DataFrame:
    """Brands after merging: one row per canonical name.

    ``mapping`` holds (brand_name, canonical_name, position); unmapped brands stay. Sets are united.
    The document is the last verified one, else the first present, in position order.
    """
    m = brands.join(mapping, "brand_name", "left").withColumn("_verified", F.coalesce(verified, F.lit(False)))
    target = F.coalesce("canonical_name", "brand_name")
    pos = F.coalesce("position", F.lit(0))
    m = m.withColumns({"_target": target, "_pos": F.struct(pos.alias("p"), F.col("brand_name").alias("b"))})
    base = m.groupBy("_target").agg(
        F.count("*").alias("merged_brands"),
        F.sum("sku_count").alias("sku_count"),
        F.coalesce(
            F.max_by("enrichment_data", F.when(F.col("_verified"), F.col("_pos"))),
            F.min_by("enrichment_data", F.when(F.col("enrichment_data").isNotNull(), F.col("_pos"))),
        ).alias("enrichment_data"),
    )
    out = base
    for column in ("permit_numbers", "countries", "class_types"):
        united = (
            m.select("_target", F.explode(column).alias("_v")).distinct().groupBy("_target").agg(F.array_sort(F.collect_list("_v")).alias(column))
        )
        out = out.join(united, "_target", "left")
    return out.withColumnRenamed("_target", "brand_name")


def rekey_skus(skus: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels moved to their canonical brand; none is lost or duplicated."""
    return skus.join(mapping.select("brand_name", "canonical_name"), "brand_name", "left").withColumns(
        {"original_brand": F.col("brand_name"), "brand_name": F.coalesce("canonical_name", "brand_name")}
    ).drop("canonical_name")


def merge_history(mapping: DataFrame, skus: DataFrame, kind: str, performed_by: str) -> DataFrame:
    """Audit rows: one per merged-away brand with the labels it moved."""
    moved = skus.groupBy("brand_name").agg(F.count("*").alias("sku_count_moved"))
    return (
        mapping.filter(F.col("brand_name") != F.col("canonical_name"))
        .join(moved, "brand_name", "left")
        .select(
            F.col("brand_name").alias("old_brand"),
            F.col("canonical_name").alias("new_brand"),
            F.lit(kind).alias("consolidation_type"),
            F.coalesce("sku_count_moved", F.lit(0)).alias("sku_count_moved"),
            F.lit(performed_by).alias("performed_by"),
        )
    )


def history_of(history: DataFrame, name: str) -> DataFrame:
    return history.filter((F.col("old_brand") == name) | (F.col("new_brand") == name)).orderBy(F.desc("consolidation_date"))


# --- website and contact state ---------------------------------------------------------------------
def latest(events: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Latest event per key, by aggregate rather than window."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_l")).select(key, "_l.*")


def website_state(events: DataFrame, order: list[str]) -> DataFrame:
    """Website state after the last verify / reject / flag event of each brand."""
    now = latest(events, "brand_name", ["user_action", "domain", "confidence_predicted", *order], order)
    a = F.col("user_action")
    return now.select(
        "brand_name",
        F.when(a != "rejected", F.col("domain")).alias("domain"),
        F.when(a == "verified", "verified").when(a == "flagged", "flagged").when(a == "rejected", F.lit(None)).otherwise("pending").alias("verification_status"),
        F.when(a == "verified", 1.0).when(a != "rejected", F.col("confidence_predicted")).alias("confidence"),
        (a == "flagged").alias("needs_review"),
    )


WEBSITE_SETTERS = ("set_website", "set_enrichment")


def website_documents(events: DataFrame, order: list[str], initial: DataFrame | None = None) -> DataFrame:
    """Enrichment document of each brand after all its events, the last writer of each path counting.

    ``events``: brand_name, user_action, document, reason and the ``order`` columns, the first of which is the time. set_website
    replaces the website with the document, set_enrichment the whole document; rejected removes it (a document without a website
    too, which the single-row form would leave); verified and flagged write
    status, confidence, review mark, date and reason into a website that is there, and nothing otherwise. Other actions are
    ignored. ``initial`` (brand_name, enrichment_data) is taken as written before every event; without it brands start empty.

    One aggregate of maxima, so a brand with a third of all events is combined before the shuffle. Text that is not JSON is no
    website; repeated events count once; an event without a time precedes all others.
    """
    rows = events.select("brand_name", "user_action", "document", "reason", F.struct(*order).alias("at"))
    if initial is not None:
        never = F.lit(None).cast(rows.schema["at"].dataType)
        given = initial.filter(F.col("enrichment_data").isNotNull())
        rows = rows.unionByName(
            given.select("brand_name", F.lit("set_enrichment").alias("user_action"), F.col("enrichment_data").alias("document"), F.lit(None).cast("string").alias("reason"), never.alias("at"))
        )
    action = F.col("user_action")

    def last(condition: Column, *more: str) -> Column:
        return F.max(F.when(condition, F.struct("at", *more)))

    state = rows.groupBy("brand_name").agg(
        last(action.isin("rejected", *WEBSITE_SETTERS), "user_action", "document").alias("site"),
        last(action.isin("rejected", "set_enrichment"), "user_action", "document").alias("whole"),
        last(action == "verified").alias("yes"),
        last(action == "flagged", "reason").alias("flag"),
    )
    text = F.when(F.col("site.user_action") == "set_website", F.get_json_object("site.document", "$")).when(
        F.col("site.user_action") == "set_enrichment", F.get_json_object("site.document", "$.website")
    )

    def later(a: str, b: str) -> Column:
        """Whether event ``a`` happened and comes after ``b``; an absent ``b`` precedes everything."""
        return F.col(a).isNotNull() & (F.col(f"{b}.at").isNull() | F.coalesce(F.col(f"{a}.at") > F.col(f"{b}.at"), F.lit(False)))

    state = state.withColumn("web", text)
    there = F.col("web").isNotNull()
    state = state.withColumns({"has_yes": there & later("yes", "site"), "has_flag": there & later("flag", "site")})
    flag_wins = F.col("has_flag") & (~F.col("has_yes") | later("flag", "yes"))

    def held(path: str) -> Column:
        return F.get_json_object("web", f"$.{path}")

    def date(event: str) -> Column:
        return F.date_format(F.col(f"{event}.at.{order[0]}"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    reason = F.coalesce(F.when(F.col("flag.reason") != "", F.col("flag.reason")), F.lit("Manual review requested"))
    return state.select(
        "brand_name",
        held("url").alias("url"),
        F.when(flag_wins, "flagged").when(F.col("has_yes"), "verified").otherwise(held("verification_status")).alias("verification_status"),
        F.when(F.col("has_yes"), 1.0).otherwise(held("confidence").try_cast("double")).alias("confidence"),
        F.when(flag_wins, True).when(F.col("has_yes"), False).otherwise(held("needs_review").try_cast("boolean")).alias("needs_review"),
        F.when(F.col("has_yes"), date("yes")).otherwise(held("verified_date")).alias("verified_date"),
        F.when(F.col("has_flag"), reason).otherwise(held("flag_reason")).alias("flag_reason"),
        F.when(F.col("has_flag"), date("flag")).otherwise(held("flagged_date")).alias("flagged_date"),
        F.when(F.col("whole.user_action") == "set_enrichment", F.col("whole.document")).alias("base_document"),
    )


def manual_entries(events: DataFrame, slice_by: Column) -> DataFrame:
    """Manual website entries numbered per brand in time order: manual_1, manual_2, ..."""
    numbered = row_numbers(events, ["brand_name"], [F.col("ts"), F.col("event_id")], slice_by, "ordinal")
    return numbered.withColumn("entry_id", F.concat(F.lit("manual_"), F.col("ordinal").cast("string")))


def contact_state(events: DataFrame, order: list[str]) -> DataFrame:
    """Latest contact-match status per brand; brands without events are 'not_started'."""
    return latest(events, "brand_name", ["status", "company_id"], order)


def manual_training(events: DataFrame) -> DataFrame:
    """Manual training record: a verified website, confidence 0.8 unless given."""
    return events.select("brand_name", "domain", F.coalesce("confidence_predicted", F.lit(0.8)).alias("confidence"), F.lit("verified").alias("user_action"))
