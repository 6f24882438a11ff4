"""Registry tables derived from the star-schema test tables.

Real installations hold these as stored Parquet tables with the same columns; here every one of
them is a plan over the given files, so its size follows theirs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarmark.session import broadcast_if_small, spread_if_narrow

STATES = ["CA", "NY", "TX", "KY", "OR"]
NOUNS = ["RING", "WIDGET", "BOLT", "GEAR", "ANVIL", "PLATE", "ROD", "GIZMO"]
TRADES = ["distillery", "wines", "brewing", ""]
CLASS_OF_TYPE = {
    "STANDARD": "TABLE RED WINE",
    "ECONOMY": "MALT BEVERAGES SPECIALTIES",
    "MEDIUM": "STRAIGHT BOURBON WHISKY",
    "PROMO": "VODKA",
    "LARGE": "SINGLE MALT SCOTCH WHISKY",
    "SMALL": "COFFEE LIQUEUR",
}
ORIGIN_OF_NATION = {0: "CALIFORNIA", 1: "UNITED STATES", 5: "TEXAS", 6: "Kentucky"}
AS_OF = "2002-01-01"
FEEDBACK_ACTIONS = {"purchase": "verified", "error": "rejected", "view": "flagged"}


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def brand_name_of(p_name: Column, p_brand: Column, p_size: Column, p_partkey: Column) -> Column:
    number = F.replace(p_brand, F.lit("Brand#"), F.lit(""))
    batch = F.floor(p_partkey / 5000)
    word = _pick(
        [" DISTILLERY ", " WINERY ", " BREWING ", " RESERVE 20", " SPIRITS ", " ", " CALIFORNIA ", " SELECT "], p_size % 8
    )
    tail = F.when(p_size % 8 == 3, F.lpad(number, 2, "0")).otherwise(number)
    lot = F.when(batch > 0, F.concat(F.lit(" "), batch.cast("string"))).otherwise("")
    return F.concat(F.upper(p_name), lot, word, tail)


def website_facts(name: Column) -> dict[str, Column]:
    """Website document, in its two shapes, decided by the brand name alone."""
    n = F.regexp_extract(name, r"(\d+)$", 1).try_cast("int")
    first, second = F.lower(F.split_part(name, F.lit(" "), F.lit(1))), F.lower(F.split_part(name, F.lit(" "), F.lit(2)))
    key = F.concat(first, second)
    url = (
        F.when(n % 4 == 0, F.concat(F.lit("https://www."), key, F.lit(".com/")))
        .when(n % 4 == 1, F.concat(F.lit("http://"), key, F.lit("wines.com/about")))
        .when(n % 4 == 2, F.concat(F.lit("https://shop."), key, F.lit(".com")))
        .otherwise(F.concat(F.lit("https://"), second, F.lit("spirits.com/x")))
    )
    status = F.when(n % 5 == 1, "verified").otherwise("pending")
    body = F.concat(
        F.lit('"url": "'), url, F.lit('", "confidence": 0.'), (3 + n % 7).cast("string"),
        F.lit(', "verification_status": "'), status, F.lit('", "needs_review": '),
        F.when(n % 6 == 2, "true").otherwise("false"),
    )
    document = (
        F.when(n % 3 == 0, F.lit(None).cast("string"))
        .when(n % 13 == 5, F.lit('{"url": broken'))
        .when(n % 2 == 0, F.concat(F.lit('{"website": {'), body, F.lit("}}")))
        .otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    )
    legacy = F.concat(F.lit("https://legacy."), key, F.lit(".com"))
    website = F.when((n % 3 == 0) & (n % 5 == 0), F.concat(F.lit('{"url": "'), legacy, F.lit('", "verification_status": "verified"}'))).when(
        (n % 3 == 0) & (n % 2 == 0), legacy
    )
    return {"enrichment_data": document, "website": website}


class Registry:
    """Lazy registry tables for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def permit_holders(self) -> DataFrame:
        """One row per supplier: permit text, names and address, before any cleaning."""
        nation = self.table("nation")
        s = self.table("supplier").join(broadcast_if_small(nation, nation), F.col("s_nationkey") == F.col("n_nationkey"))
        k = F.col("s_suppkey")
        state = _pick(STATES, F.col("n_regionkey"))
        number = (10000 + k).cast("string")
        permit = (
            F.when(k % 4 == 0, F.concat(state, F.lit("-I-"), number))
            .when(k % 4 == 1, F.concat(F.lit("DSP-"), state, F.lit("-"), number))
            .when(k % 4 == 2, F.concat(F.lit("BWN-"), state, F.lit("-"), number))
            .otherwise(F.concat(F.lit("BR-"), state, F.lit("-"), number))
        )
        owner = (
            F.when(k % 17 == 0, F.concat(F.lit("PARKSTREET IMPORTS "), k.cast("string")))
            .when(k % 3 == 1, F.concat(_pick(NOUNS, k % 8), F.lit(" SUPPLIER "), k.cast("string")))
            .otherwise(F.concat(F.lit("SUPPLIER "), k.cast("string")))
        )
        origin = F.col("n_name")
        for key, value in ORIGIN_OF_NATION.items():
            origin = F.when(F.col("n_nationkey") == key, value).otherwise(origin)
        return s.select(
            k.alias("s_suppkey"),
            permit.alias("permit_no"),
            owner.alias("owner_name"),
            F.when(k % 5 == 0, "nan").otherwise(F.concat(F.col("n_name"), F.lit(" TRADING"))).alias("operating_name"),
            F.concat(F.lit("CITY "), (k % 30).cast("string")).alias("city"),
            state.alias("state"),
            origin.alias("origin_desc"),
        )

    def _master(self, kind: int, stored_letter: str | None, absent: Column) -> DataFrame:
        h = self.permit_holders
        k = F.col("s_suppkey")
        permit = F.col("permit_no")
        if stored_letter:
            converted = F.concat(F.col("state"), F.lit(f"-{stored_letter}-"), (10000 + k).cast("string"))
            permit = F.when(k % 3 == 0, converted).otherwise(permit)
        return h.filter((k % 4 == kind) & ~absent).select(
            permit.alias("permit_number"), "owner_name", "operating_name", "city", "state"
        )

    @cached_property
    def importers(self) -> DataFrame:
        return self._master(0, None, F.col("s_suppkey") % 20 == 0)

    @cached_property
    def spirit_producers(self) -> DataFrame:
        return self._master(1, "S", F.col("s_suppkey") % 5 == 2)

    @cached_property
    def wine_producers(self) -> DataFrame:
        return self._master(2, "W", F.col("s_suppkey") % 5 == 3)

    @cached_property
    def skus(self) -> DataFrame:
        """Label approvals as filed: one row per line item."""
        li = spread_if_narrow(self.table("lineitem"), "l_orderkey").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"
        )
        part = self.table("part").select(
            "p_partkey",
            brand_name_of(F.col("p_name"), F.col("p_brand"), F.col("p_size"), F.col("p_partkey")).alias("brand_name"),
            F.when(F.col("p_size") % 9 == 0, "").otherwise(F.col("p_name")).alias("fanciful_name"),
            F.create_map(*[F.lit(x) for kv in CLASS_OF_TYPE.items() for x in kv])[F.col("p_type")].alias("class_type_desc"),
        )
        holders = self.permit_holders.select("s_suppkey", "permit_no", "origin_desc")
        holders = broadcast_if_small(holders, self.table("supplier"))
        filed = F.col("l_shipdate").cast("date")
        return (
            li.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(holders, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ttb_id"),
                "permit_no",
                "brand_name",
                "fanciful_name",
                "class_type_desc",
                "origin_desc",
                F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") < 5), "")
                .otherwise(F.date_format(filed, "M/d/yyyy"))
                .alias("completed_date"),
                filed.alias("filed"),
                F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity").alias("file_order"),
            )
        )

    @cached_property
    def brands(self) -> DataFrame:
        """Brand documents: sets as arrays, website documents as JSON text."""
        return (
            self.skus.groupBy("brand_name")
            .agg(
                F.count("*").alias("sku_count"),
                F.min("filed").alias("created_date"),
                F.max("filed").alias("updated_at"),
                F.array_sort(F.collect_set("permit_no")).alias("permit_numbers"),
                F.array_sort(F.collect_set("origin_desc")).alias("countries"),
                F.array_sort(F.collect_set("class_type_desc")).alias("class_types"),
            )
            .withColumns(website_facts(F.col("brand_name")))
        )

    @cached_property
    def brand_names(self) -> DataFrame:
        """Distinct brand names with their website documents."""
        return self.skus.select("brand_name").distinct().withColumns(website_facts(F.col("brand_name")))

    @cached_property
    def brand_permits(self) -> DataFrame:
        return self.skus.select("brand_name", "permit_no").distinct()

    @cached_property
    def feedback(self) -> DataFrame:
        """Feedback events: brand, result domain, predicted confidence and the user's action."""
        e = self.table("events")
        noun = _pick(NOUNS, F.col("user_id") % 8)
        action = F.lit("not_selected")
        for kind, value in FEEDBACK_ACTIONS.items():
            action = F.when(F.col("event_type") == kind, value).otherwise(action)
        number = (F.col("user_id") % 40).cast("string")
        return e.select(
            "event_id",
            "ts",
            F.lit("user_feedback").alias("event_type"),
            F.concat(noun, F.lit(" SPIRITS "), number).alias("brand_name"),
            F.concat(
                F.lower(noun),
                F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("spirits"), number)).otherwise(_pick(TRADES, F.col("event_id") % 4)),
                F.lit(".com"),
            ).alias("domain"),
            F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence_predicted"),
            action.alias("user_action"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """Request log: service, time, outcome and latency."""
        return self.table("events").select(
            "event_id", "ts", F.col("user_id").alias("service"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency")
        )

    @cached_property
    def web_results(self) -> DataFrame:
        """Candidate web results: whole page text as snippet, brand read off the host name."""
        from cellarmark.functions import web

        host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
        label = F.regexp_extract(host, r"([a-z0-9-]+)\.example\.", 1)
        return spread_if_narrow(self.table("pages"), "page_id").select(
            "page_id",
            F.upper(F.replace(label, F.lit("-"), F.lit(" "))).alias("brand_name"),
            "url",
            host.alias("domain"),
            web.page_title(F.col("html")).alias("title"),
            web.page_text(F.col("html")).alias("snippet"),
        )
