"""Website documents stored as JSON text, in flat and nested shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SITE_SCHEMA = (
    "url string, domain string, confidence double, verification_status string, verified boolean, needs_review boolean,"
    " title string, snippet string, source string, category_mismatch boolean"
)


def _site_struct() -> str:
    fields = [f.strip().split(" ") for f in SITE_SCHEMA.split(",")]
    return "struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">"


DOCUMENT_SCHEMA = SITE_SCHEMA + f", website {_site_struct()}"


def parse_document(c: Column) -> Column:
    """Parsed document; every field is NULL when the text is not JSON."""
    return F.from_json(c, DOCUMENT_SCHEMA, {"mode": "PERMISSIVE"})


def _pick(doc: Column, field: str) -> Column:
    return F.coalesce(doc[field], doc["website"][field])


def document_url(doc: Column) -> Column:
    return F.nullif(_pick(doc, "url"), F.lit(""))


def document_confidence(doc: Column) -> Column:
    return _pick(doc, "confidence")


def document_verified(doc: Column) -> Column:
    return F.coalesce(
        (_pick(doc, "verification_status") == "verified") | doc["verified"] | doc["website"]["verified"], F.lit(False)
    )


def document_needs_review(doc: Column) -> Column:
    return F.coalesce(_pick(doc, "needs_review"), F.lit(False))


def legacy_url(c: Column) -> Column:
    """URL of the older column: plain text or a JSON object."""
    return F.when(c.startswith("{"), F.get_json_object(c, "$.url")).otherwise(F.nullif(c, F.lit("")))


def legacy_verified(c: Column) -> Column:
    status = F.when(c.startswith("{"), F.get_json_object(c, "$.verification_status"))
    return F.coalesce(status == "verified", F.lit(False))


def site_columns(document: Column, website: Column) -> dict[str, Column]:
    """Flat website columns of a brand row: URL, confidence and the status flags."""
    doc = parse_document(document)
    has = document_url(doc).isNotNull() | legacy_url(website).isNotNull()
    return {
        "url": document_url(doc),
        "confidence": document_confidence(doc),
        "verified": document_verified(doc),
        "needs_review": document_needs_review(doc),
        "has_website": has,
        "any_verified": document_verified(doc) | legacy_verified(website),
    }


def website_view(document: Column, website: Column) -> Column:
    """The one website record shown for a brand: older column, then nested, then flat document."""
    doc = parse_document(document)

    def record(url: Column, confidence: Column, origin: str) -> Column:
        return F.when(
            F.nullif(url, F.lit("")).isNotNull(),
            F.struct(url.alias("url"), F.coalesce(confidence, F.lit(0.95)).alias("confidence"), F.lit(origin).alias("origin")),
        )

    return F.coalesce(
        record(legacy_url(website), F.when(website.startswith("{"), F.get_json_object(website, "$.confidence").cast("double")), "website"),
        record(doc["website"]["url"], doc["website"]["confidence"], "nested"),
        record(doc["url"], doc["confidence"], "flat"),
    )
