"""DuckDB SQL with the same results as the catalog queries, for the side-by-side check."""

from __future__ import annotations

from cellarmark import rules
from cellarmark.plans.views_sql import with_views

ORACLE: dict[str, str] = {}


BODY: dict[str, str] = {}  # the final select of each entry


def add(name: str, sql: str, *views: str, **steps: str) -> None:
    BODY[name] = sql
    ORACLE[name] = with_views(sql, *views, **steps)


def q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def any_of(text: str, terms) -> str:
    """OR of literal containment tests."""
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def n_of(text: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{t}') AS INTEGER)" for t in terms) + ")"


def first_label(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs) + f" ELSE {default} END"


# The longest block that x shares with y (earliest in x, then in y): its length l and minus its place in x.
BLOCK = "list_max(flatten([[{l: l, i: -i} FOR l IN range(1, length(x) - i + 2) IF contains(y, x[i:i+l-1])] FOR i IN range(1, length(x) + 1)]))"


def matching_blocks(pairs: str) -> str:
    """Recursive step over texts (a, b): all matching blocks, each time the longest, then those before and after it."""
    rest = f"SELECT a, b, unnest([x[1:-m.i-1], x[m.l-m.i:]]) AS x, unnest([y[1:j-1], y[j+m.l:]]) AS y FROM (SELECT *, instr(y, x[-m.i:m.l-m.i-1]) AS j FROM {{name}} WHERE m IS NOT NULL)"
    return f"SELECT a, b, a AS x, b AS y, {BLOCK} AS m FROM (SELECT DISTINCT a, b FROM ({pairs})) UNION ALL SELECT a, b, x, y, {BLOCK} FROM ({rest}) WHERE x <> '' AND y <> ''"


def ratio_steps(pairs: str, name: str = "rt") -> dict[str, str]:
    """Named steps that end in ``name``: a, b, ratio (the sequence ratio) of the distinct texts in ``pairs``."""
    blocks = f"{name}_blocks"
    total = f"SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0::DOUBLE * coalesce(sum(m.l), 0) / (length(a) + length(b)) END::DOUBLE AS ratio FROM {blocks} GROUP BY a, b"
    return {blocks: matching_blocks(pairs).replace("{name}", blocks), name: total}


BOOSTED = "CASE WHEN contains({x}, {y}) OR contains({y}, {x}) THEN greatest(ratio, 0.8::DOUBLE) ELSE ratio END"
MASTERED = "SELECT b.*, m.owner_name, m.operating_name, coalesce(m.kind, 'brand_permit') AS tier FROM brand_permits b LEFT JOIN masters m ON permit_no = permit_number"
BRIDGE = "SELECT brand_name, permit_no, owner_name FROM brand_permits JOIN importers ON permit_no = permit_number"
IMPCOUNT = "SELECT permit_number, coalesce(nullif(owner_name, ''), nullif(operating_name, ''), 'Unknown') AS company_name, count(permit_no) AS brand_count FROM importers LEFT JOIN brand_permits ON permit_no = permit_number GROUP BY ALL"
US = q(rules.REPORT_STATES + rules.US_NAMES)
STATES = q(rules.REPORT_STATES)

# --- permits ----------------------------------------------------------------------------------
add("permit_match", """SELECT ttb_id, permit_no, brand_name, i.owner_name, i.state, CASE WHEN i.permit_number IS NULL THEN 'No Match' ELSE 'Matched' END AS "Match_Status", filed
  FROM skus LEFT JOIN importers i ON permit_no = i.permit_number""", "skus", "importers")
add("permit_match_summary", """SELECT count(*) AS total_records, count(i.permit_number) AS matched_records, count(*) - count(i.permit_number) AS unmatched_records,
  round(count(i.permit_number) / count(*) * 100, 2) AS match_rate FROM skus LEFT JOIN importers i ON permit_no = i.permit_number""", "skus", "importers")
add("permit_tier", "SELECT brand_name, permit_no, tier, owner_name FROM t", "brand_permits", "masters", t=MASTERED)
PRODUCERS = "SELECT *, 'spirit_producer' AS via, 1 AS prio FROM spirits UNION ALL SELECT *, 'wine_producer', 2 FROM wines"
FOUND = """SELECT h.*, CASE WHEN d.permit_number IS NULL THEN f.permit_number END AS converted_permit, coalesce(d.via, f.via) AS matched_via, coalesce(d.owner_name, f.owner_name) AS owner_name
  FROM (SELECT *, CASE WHEN permit_no LIKE 'DSP-%' THEN split_part(permit_no, '-', 2) || '-S-' || split_part(permit_no, '-', 3)
                       WHEN permit_no LIKE 'BWN-%' THEN split_part(permit_no, '-', 2) || '-W-' || split_part(permit_no, '-', 3) END AS conv FROM held) h
  LEFT JOIN prod d ON d.permit_number = permit_no LEFT JOIN prod f ON f.permit_number = conv
  WHERE coalesce(d.via, f.via) IS NOT NULL"""
add("permit_convert", "SELECT permit_no, converted_permit, matched_via, owner_name FROM found", "skus", "spirits", "wines",
    prod=PRODUCERS, held="SELECT DISTINCT permit_no FROM skus", found=FOUND)
add("producer_brands", """SELECT permit_number, owner_name, via AS producer_type, brand_name, count(*) AS sku_count
  FROM skus JOIN prod ON permit_no = permit_number GROUP BY ALL""", "skus", "spirits", "wines", prod=PRODUCERS)
WHITE = any_of("upper(brand_name)", rules.STORE_BRANDS + rules.PRIVATE_LABEL_TERMS)
NAMED = "(len(list_filter(string_split(upper(coalesce({h}, '')), ' '), lambda w: length(w) > 3 AND contains(upper(brand_name), w))) > 0)"
ATTR = f"""SELECT *, CASE relationship WHEN 'primary_producer' THEN 1.0 WHEN 'contract_producer' THEN 0.9 ELSE 0.8 END AS wgt FROM (
  SELECT brand_name, permit_no, owner_name, operating_name, via AS producer_type, {WHITE} AS white, {NAMED.format(h='owner_name')} AS by_owner,
    CASE WHEN {NAMED.format(h='owner_name')} THEN 'primary_producer' WHEN {WHITE} THEN 'contract_producer'
         WHEN {NAMED.format(h='operating_name')} THEN 'primary_producer' ELSE 'secondary_producer' END AS relationship
  FROM brand_permits JOIN prod ON permit_no = permit_number)"""
add("producer_attribution", """SELECT brand_name, permit_no, producer_type, relationship,
  round(CASE WHEN white AND relationship = 'contract_producer' THEN least(r + 0.1, 1.0) WHEN white THEN greatest(r - 0.2, 0.1) ELSE r END, 2)::DOUBLE AS confidence
  FROM (SELECT *, CASE WHEN by_owner THEN least(wgt + 0.2, 1.0) ELSE wgt END AS r FROM attr)""", "brand_permits", "spirits", "wines", prod=PRODUCERS, attr=ATTR)
PTYPES = f"""SELECT brand_name, coalesce(c, 0) AS producer_count, {WHITE} OR (coalesce(c, 0) > 0 AND NOT coalesce(named, false)) AS cand
  FROM (SELECT DISTINCT brand_name FROM brand_permits) LEFT JOIN (
    SELECT brand_name, count(*) AS c, bool_or(list_has_any(string_split(upper(brand_name), ' '), string_split(upper(owner_name), ' '))) AS named FROM attr GROUP BY 1) USING (brand_name)"""
add("production_types", """SELECT brand_name, producer_count, cand AS is_white_label_candidate,
  CASE WHEN cand THEN 'contract_production' WHEN producer_count > 0 THEN 'own_brand' ELSE 'unknown' END AS production_type FROM pt""",
    "brand_permits", "spirits", "wines", prod=PRODUCERS, attr=ATTR, pt=PTYPES)
add("producer_analysis_totals", """SELECT count(*) AS total_brands, count(*) FILTER (producer_count > 0) AS brands_with_producers, count(*) FILTER (cand) AS white_label_candidates FROM pt""",
    "brand_permits", "spirits", "wines", prod=PRODUCERS, attr=ATTR, pt=PTYPES)

# --- faceted queries --------------------------------------------------------------------------
SUMMARY = """SELECT b.*, importer_count, own_permit_count, CASE WHEN dp > 0 THEN dp ELSE coalesce(fp, 0) END AS producer_count FROM brands b
  LEFT JOIN (SELECT brand_name, count(*) FILTER (tier = 'importer' AND permit_no LIKE '%-I-%') AS importer_count, count(*) FILTER (tier LIKE '%\\_producer' ESCAPE '\\') AS dp,
      count(*) FILTER (tier = 'brand_permit' OR (tier = 'importer' AND permit_no NOT LIKE '%-I-%')) AS own_permit_count FROM t GROUP BY 1) USING (brand_name)
  LEFT JOIN (SELECT brand_name, count(*) AS fp FROM found GROUP BY 1) USING (brand_name)"""
SUMMARY_STEPS = dict(t=MASTERED, prod=PRODUCERS, held="SELECT * FROM brand_permits", found=FOUND, summ=SUMMARY)
add("brand_summary", """SELECT brand_name, sku_count, len(countries) AS countries, array_to_string(class_types, '|') AS class_types, importer_count, producer_count, own_permit_count FROM summ""",
    "brands", "brand_permits", "masters", **SUMMARY_STEPS)
FACETED = """SELECT * FROM brands b WHERE brand_name ILIKE '%widget%' AND list_has_any(countries, ['TEXAS', 'NATION_7'])
  AND len(list_filter(class_types, lambda x: contains(lower(x), 'vodka') OR contains(lower(x), 'whisky'))) > 0
  AND (url IS NOT NULL OR has_legacy)
  AND EXISTS (SELECT 1 FROM skus s WHERE s.brand_name = b.brand_name AND (permit_no LIKE 'BWN-CA-%' OR permit_no LIKE 'BR-TX-%'))"""
add("brand_facet_page", "SELECT brand_name, sku_count, created_date FROM hit ORDER BY sku_count DESC, brand_name LIMIT 20 OFFSET 20", "brands", hit=FACETED)
add("brand_facet_total", """SELECT count(*) AS total, (count(*) + 19) // 20 AS pages, 2::INTEGER AS page, true AS has_prev, 2 < (count(*) + 19) // 20 AS has_next FROM hit""", "brands", hit=FACETED)
add("brand_importer_filter", """SELECT brand_name, sku_count FROM brands WHERE sku_count >= 3 AND brand_name IN (SELECT brand_name FROM bridge WHERE owner_name = 'PARKSTREET IMPORTS 68')""",
    "brands", "brand_permits", "importers", bridge=BRIDGE)
add("brand_listing", """SELECT brand_name, sku_count, fi AS first_importer, fp AS first_producer FROM brands LEFT JOIN (
    SELECT brand_name, min(CASE WHEN tier = 'importer' THEN owner_name END) AS fi, min(CASE WHEN tier IN ('spirit_producer', 'wine_producer') THEN owner_name END) AS fp FROM t GROUP BY 1) USING (brand_name)
  WHERE verified OR legacy_verified""", "brands", "brand_permits", "masters", t=MASTERED)
add("brand_search", "SELECT brand_name FROM names WHERE brand_name ILIKE '%gear%' ORDER BY 1 LIMIT 100", "names")
add("brand_labels", "SELECT ttb_id, permit_no, fanciful_name, class_type_desc, completed_date FROM skus WHERE brand_name = 'BLUE ANVIL 13'", "skus")
add("brand_permit_rows", "SELECT permit_no, tier, owner_name, operating_name FROM t WHERE brand_name = 'BLUE ANVIL 13'", "brand_permits", "masters", t=MASTERED)
add("brand_detail", """SELECT n.brand_name, count(*) FILTER (tier = 'importer') AS importers, count(*) FILTER (tier LIKE '%\\_producer' ESCAPE '\\') AS producers, count(*) FILTER (tier = 'brand_permit') AS own_permits, any_value(url) AS url
  FROM names n JOIN t USING (brand_name) WHERE n.brand_name = 'BLUE ANVIL 13' GROUP BY 1""", "names", "brand_permits", "masters", t=MASTERED)
add("website_resolution", """SELECT brand_name, coalesce(legacy_url, url) AS url, CASE WHEN legacy_url IS NOT NULL THEN 0.95 ELSE confidence END AS confidence,
  CASE WHEN legacy_url IS NOT NULL THEN 'website' WHEN url IS NOT NULL AND nested THEN 'nested' WHEN url IS NOT NULL THEN 'flat' END AS origin FROM names""", "names")
add("producer_list", """SELECT permit_number, owner_name, city, 'wine_producer' AS producer_type FROM wines
  WHERE contains(lower(concat_ws('~', owner_name, operating_name, permit_number, city, state)), 'trading')""", "wines")
add("importer_list", "SELECT permit_number, owner_name FROM importers WHERE contains(lower(owner_name), 'supplier') OR contains(lower(permit_number), 'supplier')", "importers")
FACET_BASE = """SELECT 'countries' AS facet, origin_desc AS value, count(*) AS n FROM (SELECT DISTINCT brand_name, origin_desc FROM skus) GROUP BY ALL
  UNION ALL SELECT 'alcoholTypes', class_type_desc, count(*) FROM (SELECT DISTINCT brand_name, class_type_desc FROM skus) GROUP BY ALL"""
add("facet_counts", f"""{FACET_BASE}
  UNION ALL SELECT 'importers', owner_name, count(*) FROM t WHERE tier = 'importer' AND owner_name <> '' GROUP BY ALL
  UNION ALL SELECT 'producers', owner_name, count(*) FROM t WHERE tier IN ('spirit_producer', 'wine_producer') AND owner_name <> '' GROUP BY ALL
  UNION ALL SELECT 'websiteStatus', 'has_website', count(*) FILTER (has_document OR has_legacy) FROM names
  UNION ALL SELECT 'websiteStatus', 'verified', count(*) FILTER (nested AND verified) FROM names
  UNION ALL SELECT 'websiteStatus', 'no_website', count(*) FILTER (NOT (has_document OR has_legacy)) FROM names""", "names", "brand_permits", "masters", t=MASTERED)
add("facet_counts_permit_label", f"""{FACET_BASE}
  UNION ALL SELECT 'importers', owner_name, count(*) FROM t WHERE tier = 'importer' AND permit_no LIKE '%-I-%' GROUP BY ALL
  UNION ALL SELECT 'producers', label, count(*) FROM (SELECT CASE split_part(permit_no, '-', 1) WHEN 'DSP' THEN 'Distilled Spirits Producer' WHEN 'BWN' THEN 'Bonded Winery' WHEN 'BR' THEN 'Brewer'
      ELSE split_part(permit_no, '-', 1) END || ' (' || split_part(permit_no, '-', 2) || ')' AS label FROM brand_permits WHERE permit_no NOT LIKE '%-I-%') GROUP BY ALL
  UNION ALL SELECT 'websiteStatus', 'has_website', count(*) FILTER (url IS NOT NULL OR has_legacy) FROM names
  UNION ALL SELECT 'websiteStatus', 'verified', count(*) FILTER (verified OR legacy_verified) FROM names
  UNION ALL SELECT 'websiteStatus', 'no_website', count(*) FILTER (NOT (url IS NOT NULL OR has_legacy)) FROM names""", "names", "brand_permits", "masters", t=MASTERED)
add("summary_facets", FACET_BASE, "skus")
add("table_stats", """SELECT (SELECT count(*) FROM names) AS total_brands, (SELECT count(url) FROM names) AS brands_with_websites, (SELECT count(*) FROM skus) AS total_skus,
  (SELECT count(*) FROM importers) AS total_importers, (SELECT count(DISTINCT permit_no) FROM bridge) AS active_importers""", "names", "importers", "brand_permits", bridge=BRIDGE)
add("producer_stats", "SELECT (SELECT count(*) FROM spirits) AS spirit_producers, (SELECT count(*) FROM wines) AS wine_producers, (SELECT count(*) FROM spirits) + (SELECT count(*) FROM wines) AS total_producers", "spirits", "wines")
add("importer_metrics", "SELECT permit_no, any_value(owner_name) AS owner_name, any_value(operating_name) AS operating_name, count(*) AS brand_count FROM t WHERE tier = 'importer' GROUP BY permit_no", "brand_permits", "masters", t=MASTERED)
add("importer_brands", "SELECT permit_no, owner_name, brand_name FROM t WHERE tier = 'importer' AND contains(permit_no, '-I-')", "brand_permits", "masters", t=MASTERED)
add("importer_leaderboard", "SELECT permit_no, coalesce(nullif(any_value(owner_name), ''), any_value(operating_name)) AS company_name, count(*) AS brand_count FROM t WHERE tier = 'importer' GROUP BY permit_no", "brand_permits", "masters", t=MASTERED)
add("review_queue", "SELECT brand_name, url, confidence FROM names WHERE needs_review", "names")
add("review_triage", """SELECT count(*) AS total, count(*) FILTER (verified) AS verified, count(*) FILTER (needs_review) AS needs_review, count(*) FILTER (confidence < 0.5) AS low,
  count(*) FILTER (confidence BETWEEN 0.5 AND 0.8) AS medium, count(*) FILTER (confidence > 0.8) AS high FROM names WHERE url IS NOT NULL""", "names")
add("contact_candidates", "SELECT brand_name, url FROM names WHERE url IS NOT NULL ORDER BY brand_name LIMIT 100", "names")
add("page_sku_total", "SELECT count(*) AS brands, sum(sku_count)::BIGINT AS skus FROM (SELECT * FROM brands ORDER BY sku_count DESC, brand_name LIMIT 24)", "brands")

# --- market report ----------------------------------------------------------------------------
add("overview", """SELECT *, round(brands_with_websites / total_brands * 100, 1) AS enrichment_rate FROM (
  SELECT (SELECT count(*) FROM names) AS total_brands, (SELECT count(url) FROM names) AS brands_with_websites, (SELECT count(*) FROM skus) AS total_skus,
  (SELECT round(avg(n), 1) FROM (SELECT count(*) AS n FROM skus GROUP BY brand_name)) AS avg_skus_per_brand,
  (SELECT count(*) FROM importers) AS total_importers, (SELECT count(DISTINCT permit_no) FROM bridge) AS active_importers)""", "names", "importers", "brand_permits", bridge=BRIDGE)
add("overview_dated", """SELECT (SELECT count(DISTINCT brand_name) FROM skus WHERE completed_date <> '') AS total_brands,
  (SELECT count(*) FROM skus WHERE completed_date <> '' AND filed BETWEEN DATE '1996-03-01' AND DATE '1998-09-30') AS total_skus""", "skus")
PAIRS = "SELECT DISTINCT brand_name, origin_desc, upper(origin_desc) AS up FROM skus"
GEO = f"""SELECT 'state' AS kind, origin_desc AS name, count(*) AS n FROM p WHERE up IN ({STATES}) GROUP BY ALL
  UNION ALL SELECT 'country', origin_desc, count(*) FROM p WHERE up NOT IN ({US}) GROUP BY ALL
  UNION ALL SELECT 'country', 'United States', count(DISTINCT brand_name) FROM p WHERE up IN ({US}) HAVING count(*) > 0"""
add("geo", "SELECT * FROM g", "skus", p=PAIRS, g=GEO)
add("geo_top", "SELECT name, n, round(n / (SELECT count(*) FROM names) * 100, 1) AS percentage FROM g WHERE kind = 'country' ORDER BY n DESC, name LIMIT 10", "names", p=PAIRS, g=GEO)
add("domestic_split", f"""SELECT domestic, international, round(domestic / (domestic + international) * 100, 1) AS domestic_percentage, round(international / (domestic + international) * 100, 1) AS international_percentage
  FROM (SELECT count(*) FILTER (us) AS domestic, count(*) FILTER (NOT us) AS international FROM (SELECT brand_name, bool_or(up IN ({US})) AS us FROM p GROUP BY 1))""", "skus", p=PAIRS)
CLASSES = "SELECT class_type_desc AS name, count(DISTINCT brand_name) AS n FROM skus GROUP BY 1"
add("class_types", "SELECT name, n, round(n / (SELECT sum(n) FROM c) * 100, 1) AS percentage FROM c ORDER BY n DESC, name LIMIT 15", "skus", c=CLASSES)
CATEGORY = first_label([(any_of("upper(name)", kw), cat) for cat, kw in rules.CATEGORY_KEYWORDS.items()], "'Other'")
add("category_rollup", f"SELECT {CATEGORY} AS category, sum(n)::BIGINT AS n FROM c GROUP BY 1", "skus", c=CLASSES)
BUCKET = "CASE WHEN n = 1 THEN 'Single SKU' WHEN n <= 5 THEN '2-5 SKUs' WHEN n <= 10 THEN '6-10 SKUs' WHEN n <= 20 THEN '11-20 SKUs' WHEN n <= 50 THEN '21-50 SKUs' ELSE '50+ SKUs' END"
add("sku_histogram", f"SELECT {BUCKET} AS range_name, count(*) AS brand_count FROM (SELECT count(*) AS n FROM skus GROUP BY brand_name) GROUP BY 1", "skus")
BB = "CASE WHEN brand_count = 0 THEN 'No brands' WHEN brand_count = 1 THEN '1 brand' WHEN brand_count <= 5 THEN '2-5 brands' WHEN brand_count <= 10 THEN '6-10 brands' WHEN brand_count <= 20 THEN '11-20 brands' WHEN brand_count <= 50 THEN '21-50 brands' ELSE '50+ brands' END"
IV = ("importers", "brand_permits")
add("importer_histogram", f"SELECT {BB} AS range_name, count(*) AS importer_count FROM ic GROUP BY 1", *IV, ic=IMPCOUNT)
add("importer_top", "SELECT *, round(brand_count / sum(brand_count) OVER () * 100, 1) AS market_share FROM (SELECT * FROM ic WHERE brand_count > 0 ORDER BY brand_count DESC, permit_number LIMIT 20)", *IV, ic=IMPCOUNT)
add("importer_top_ten_share", """SELECT t10::BIGINT AS top_10_importers, (total - t10)::BIGINT AS others, round(t10 / total * 100, 1) AS top_10_percentage
  FROM (SELECT (SELECT sum(brand_count) FROM (SELECT brand_count FROM ic ORDER BY brand_count DESC LIMIT 10)) AS t10, (SELECT sum(brand_count) FROM ic) AS total)""", *IV, ic=IMPCOUNT)
HHI = """SELECT round(hhi, 1) AS herfindahl_index, CASE WHEN n >= 4 THEN round(c4 / total * 100, 1) ELSE 0.0::DOUBLE END AS concentration_ratio_cr4,
  CASE WHEN n >= 8 THEN round(c8 / total * 100, 1) ELSE 0.0::DOUBLE END AS concentration_ratio_cr8,
  CASE WHEN n = 0 THEN 'Unknown' WHEN hhi < 1500 THEN 'Competitive' WHEN hhi < 2500 THEN 'Moderately Concentrated' ELSE 'Highly Concentrated' END AS market_structure
  FROM (SELECT count(*) AS n, sum(brand_count)::DOUBLE AS total, sum(power(share, 2)) AS hhi, sum(CASE WHEN rn <= 4 THEN brand_count END)::DOUBLE AS c4, sum(CASE WHEN rn <= 8 THEN brand_count END)::DOUBLE AS c8
    FROM (SELECT brand_count, brand_count / sum(brand_count) OVER () * 100 AS share, row_number() OVER (ORDER BY brand_count DESC, permit_number) AS rn FROM ic WHERE brand_count > 0))"""
add("hhi_cr", HHI, *IV, ic=IMPCOUNT)
GROWTH = """SELECT 'brands_per_importer' AS subject, round(avg(brand_count), 1) AS average, max(brand_count) AS maximum, min(brand_count) AS minimum FROM ic WHERE brand_count > 0
  UNION ALL SELECT 'skus_per_brand', round(avg(n), 1), max(n), min(n) FROM (SELECT count(*) AS n FROM skus GROUP BY brand_name)"""
add("growth", GROWTH, *IV, ic=IMPCOUNT)
COVERAGE = """SELECT *, round(enriched_brands / total_brands * 100, 1) AS enrichment_rate, round(brands_with_websites / total_brands * 100, 1) AS website_rate,
  CASE WHEN enriched_brands > 0 THEN round(verified_websites / enriched_brands * 100, 1) ELSE 0.0::DOUBLE END AS verification_rate
  FROM (SELECT count(*) AS total_brands, count(*) FILTER (has_document) AS enriched_brands, count(url) AS brands_with_websites, count(*) FILTER (verified) AS verified_websites FROM names)"""
add("coverage", COVERAGE, "names")
add("top_brands", """SELECT 'brands_by_skus' AS list, brand_name, n FROM (SELECT brand_name, count(*) AS n FROM skus GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
  UNION ALL SELECT 'brands_by_countries', * FROM (SELECT brand_name, count(DISTINCT origin_desc) AS n FROM skus GROUP BY 1 HAVING n > 1 ORDER BY 2 DESC, 1 LIMIT 10)
  UNION ALL SELECT 'multi_product_brands', * FROM (SELECT brand_name, count(DISTINCT class_type_desc) AS n FROM skus GROUP BY 1 HAVING n > 1 ORDER BY 2 DESC, 1 LIMIT 10)""", "skus")
add("keywords", f"""SELECT keyword, count(*) AS frequency FROM (SELECT unnest(string_split(upper(brand_name), ' ')) AS keyword FROM names)
  WHERE length(keyword) > 3 AND keyword NOT IN ({q(rules.KEYWORD_STOP_WORDS)}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""", "names")
add("permit_types", "SELECT substr(permit_number, instr(permit_number, '-') + 1, 1) || '-permit' AS type, count(*) AS n FROM importers GROUP BY 1", "importers")
IS_STATE = "(" + " OR ".join(f"contains(lower(origin_desc), '{s.lower()}') OR contains('{s.lower()}', lower(origin_desc))" for s in rules.CHART_STATES) + ")"
add("location_chart", f"SELECT CASE WHEN {IS_STATE} THEN 'United States' ELSE origin_desc END AS location, count(*) AS n FROM p GROUP BY 1", "skus", p=PAIRS)
add("location_chart_states", f"SELECT origin_desc AS location, count(*) AS n FROM p WHERE {IS_STATE} GROUP BY 1", "skus", p=PAIRS)


def chart_case() -> str:
    out = []
    for triggers, refinements, default in rules.CLASS_CHART_RULES:
        hit = any_of("lower(name)", triggers)
        inner = first_label([(any_of("lower(name)", t), label) for t, label in refinements], f"'{default}'") if refinements else f"'{default}'"
        out.append(f"WHEN {hit} THEN {inner}")
    return "CASE " + " ".join(out) + " ELSE CASE WHEN length(name) > 25 THEN name[:25] || '...' ELSE name END END"


add("class_chart", f'SELECT {chart_case()} AS "class", sum(n)::BIGINT AS n FROM c GROUP BY 1', "skus", c=CLASSES)
# --- ranking --------------------------------------------------------------------------------------
PROD_SCORE = "greatest(" + ", ".join(f"CASE WHEN contains(upper(ct), '{k}') THEN {v} ELSE 0 END" for k, v in rules.PRODUCT_SCORES.items()) + ")"
RIVAL = " OR ".join(f"(upper(coalesce({c}, '')) NOT IN ('', 'NAN') AND {any_of(f'upper({c})', rules.COMPETITOR_VARIANTS)})" for c in ("owner_name", "operating_name"))
FLAGS = f"""SELECT brand_name, coalesce(bool_or(tier <> 'brand_permit' AND ({RIVAL})), false) AS rival, bool_or(tier = 'importer') AS imp,
  count(DISTINCT CASE WHEN contains(permit_no, '-I-') THEN 'i' WHEN contains(permit_no, 'DSP') THEN 'd' WHEN contains(permit_no, 'BR-') THEN 'b' WHEN contains(permit_no, 'BWN') THEN 'w' END) AS kinds FROM t GROUP BY 1"""
SCORES = f"""SELECT *, least(competitor_target + importer + has_website + product_type + sku_volume + recent_activity + multiple_countries + multiple_permits + premium_segment, 100)::INTEGER AS score FROM (
  SELECT brand_name, sku_count, has_document AS has_enrichment, rival AS is_competitor_target, CASE WHEN rival THEN 40 ELSE 0 END AS competitor_target, CASE WHEN NOT rival AND imp THEN 20 ELSE 0 END AS importer,
    CASE WHEN url IS NOT NULL OR has_legacy THEN 15 ELSE 0 END AS has_website,
    list_max(list_transform(class_types, lambda ct: {PROD_SCORE})) AS product_type,
    CASE WHEN sku_count >= 5 THEN 10 WHEN sku_count >= 2 THEN 7 WHEN sku_count = 1 THEN 3 ELSE 0 END AS sku_volume,
    CASE WHEN DATE '2002-01-01' - created_date <= 180 OR DATE '2002-01-01' - updated_at <= 180 THEN 5 ELSE 0 END AS recent_activity,
    CASE WHEN len(countries) > 1 THEN 5 ELSE 0 END AS multiple_countries, CASE WHEN kinds > 1 THEN 3 ELSE 0 END AS multiple_permits,
    CASE WHEN {any_of("upper(array_to_string(class_types, '~'))", rules.PREMIUM_TERMS)} THEN 2 ELSE 0 END AS premium_segment
  FROM brands JOIN flags USING (brand_name))"""
TIER = "CASE WHEN is_competitor_target OR score >= 90 THEN 1 WHEN score >= 70 THEN 2 WHEN score >= 50 THEN 3 WHEN score >= 30 THEN 4 ELSE 5 END"
TIER_LABEL = "CASE WHEN is_competitor_target THEN '{0}' WHEN score >= 90 THEN '{1}' WHEN score >= 70 THEN '{2}' WHEN score >= 50 THEN '{3}' WHEN score >= 30 THEN '{4}' ELSE '{5}' END".format(*rules.TIER_LABELS.values())
RANKED = f"SELECT *, {TIER} AS tier, {TIER_LABEL} AS tier_description FROM sc"
RV, RS = ("brands", "brand_permits", "masters"), dict(t=MASTERED, flags=FLAGS, sc=SCORES, rk=RANKED)
add("priority_rank", "SELECT * FROM rk", *RV, **RS)
add("priority_top", "SELECT brand_name, score, tier FROM rk ORDER BY score DESC, brand_name LIMIT 50", *RV, **RS)
add("tier_stats", "SELECT i::INTEGER AS tier, count(brand_name) AS brands, count(brand_name) FILTER (has_enrichment) AS enriched FROM range(1, 6) r(i) LEFT JOIN rk ON tier = i GROUP BY 1", *RV, **RS)
add("ranking_stats", """SELECT count(*) AS total_brands, count(*) FILTER (product_type >= 25) AS spirits_brands, count(*) FILTER (product_type BETWEEN 12 AND 24) AS wine_brands, count(*) FILTER (product_type BETWEEN 8 AND 11) AS beer_brands,
  count(*) FILTER (competitor_target > 0) AS competitor_target_brands, count(*) FILTER (importer > 0 OR competitor_target > 0) AS brands_with_importers, count(*) FILTER (has_website > 0) AS brands_with_websites FROM rk""", *RV, **RS)
add("tier_queue", "SELECT brand_name, score, tier_description FROM rk WHERE tier = 2 AND NOT has_enrichment", *RV, **RS)
add("queue_preview", """SELECT tier, pending, position::INTEGER AS position, brand_name, score FROM (SELECT *, count(*) OVER (PARTITION BY tier) AS pending, row_number() OVER (PARTITION BY tier ORDER BY score DESC, brand_name) AS position
  FROM rk WHERE NOT has_enrichment) WHERE position <= 5""", *RV, **RS)
add("batch_totals", """SELECT tier, count(*) AS processed, count(*) FILTER (NOT has_enrichment AND score % 2 = 0) AS successful, count(*) FILTER (NOT has_enrichment AND score % 2 = 1) AS failed,
  count(*) FILTER (has_enrichment) AS skipped FROM rk GROUP BY 1""", *RV, **RS)
add("data_health", """SELECT *, CASE WHEN overall_health_score >= 70 THEN 'Good' WHEN overall_health_score >= 40 THEN 'Fair' ELSE 'Poor' END AS status,
    (SELECT count(*) FROM rk WHERE tier = 1) AS total_critical, (SELECT count(*) FROM rk WHERE tier = 2) AS total_high FROM (
  SELECT *, ((completeness_score + quality_score + enrichment_rate) // 3)::INTEGER AS overall_health_score FROM (
  SELECT *, least(100, floor(brands_with_websites / total_brands * 100))::INTEGER AS completeness_score, greatest(0, 100 - floor(missing_critical_data / total_brands * 100))::INTEGER AS quality_score,
    floor(brands_with_websites / total_brands * 100)::INTEGER AS enrichment_rate, round(brands_with_websites / total_brands * 100, 1) AS website_coverage, total_brands - brands_with_websites AS pending_enrichment FROM (
  SELECT count(*) AS total_brands, count(*) FILTER (has_document OR has_legacy) AS brands_with_websites, count(*) FILTER (importer_count > 0) AS brands_with_importers, count(*) FILTER (producer_count > 0) AS brands_with_producers,
    count(*) FILTER (len(countries) > 0) AS brands_with_countries, count(*) FILTER (len(countries) = 0 OR len(class_types) = 0) AS missing_critical_data FROM summ)))""", *RV, **{**SUMMARY_STEPS, **RS})

# --- upserts and state ------------------------------------------------------------------------
OLD = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ttb_id ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM skus WHERE filed < DATE '2000-01-01') WHERE rn = 1"""
NEW = OLD.replace("filed < DATE", "filed >= DATE")
CHANGE = "CASE WHEN o.ttb_id IS NULL THEN 'new' WHEN n.ttb_id IS NOT NULL THEN 'updated' ELSE 'unchanged' END"
add("sku_upsert", f"""SELECT coalesce(n.ttb_id, o.ttb_id) AS ttb_id, coalesce(n.brand_name, o.brand_name) AS brand_name, coalesce(n.permit_no, o.permit_no) AS permit_no,
  coalesce(n.class_type_desc, o.class_type_desc) AS class_type_desc, coalesce(o.filed, n.filed) AS added_date, {CHANGE} AS change_type FROM o FULL JOIN n USING (ttb_id)""", "skus", o=OLD, n=NEW)
add("change_counts", f"SELECT {CHANGE} AS change_type, count(*) AS n FROM o FULL JOIN n USING (ttb_id) GROUP BY 1", "skus", o=OLD, n=NEW)
add("upload_counters", """SELECT *, total_records - new_skus AS updated_skus FROM (SELECT (SELECT count(*) FROM skus WHERE filed >= DATE '2000-01-01') AS total_records,
  (SELECT count(*) FROM skus WHERE filed >= DATE '2000-01-01' AND permit_no IN (SELECT permit_number FROM importers)) AS matched_records,
  (SELECT count(DISTINCT brand_name) FROM skus WHERE filed >= DATE '2000-01-01' AND brand_name NOT IN (SELECT brand_name FROM o)) AS new_brands,
  (SELECT count(*) FROM n WHERE ttb_id NOT IN (SELECT ttb_id FROM o)) AS new_skus)""", "skus", "importers", o=OLD, n=NEW)
add("brand_upsert", """SELECT brand_name, array_to_string(list_sort(list(DISTINCT permit_no)), '|') AS permit_numbers, array_to_string(list_sort(list(DISTINCT origin_desc)), '|') AS countries,
  CASE WHEN NOT bool_or(old) THEN 'new' WHEN bool_or(NOT old) THEN 'updated' ELSE 'unchanged' END AS change_type
  FROM (SELECT brand_name, permit_no, origin_desc, true AS old FROM o UNION ALL SELECT brand_name, permit_no, origin_desc, false FROM skus WHERE filed >= DATE '2000-01-01') GROUP BY 1""", "skus", o=OLD)
add("master_upsert", """SELECT permit_number, CASE WHEN city > 'CITY 2' THEN owner_name || ' LLC' ELSE owner_name END AS owner_name, operating_name, city, state,
  CASE WHEN city > 'CITY 2' THEN CASE WHEN city LIKE '%4' THEN 'new' ELSE 'updated' END ELSE 'unchanged' END AS change_type FROM importers WHERE city > 'CITY 2' OR city NOT LIKE '%4'""", "importers")
MAP = """SELECT brand_name, first_value(brand_name) OVER (PARTITION BY split_part(brand_name, ' ', 1), split_part(brand_name, ' ', 2) ORDER BY length(brand_name), brand_name) AS canonical_name, length(brand_name) AS position FROM names"""
add("brand_merge", """SELECT canonical_name AS brand_name, count(DISTINCT s.brand_name) AS merged_brands, count(*) AS sku_count, count(DISTINCT permit_no) AS permits, count(DISTINCT origin_desc) AS countries,
  array_to_string(list_sort(list(DISTINCT class_type_desc)), '|') AS class_types, bool_or(has_document) AS has_document FROM skus s JOIN mp USING (brand_name) JOIN names USING (brand_name) GROUP BY 1""", "names", mp=MAP)
add("brand_merge_skus", "SELECT canonical_name AS brand_name, count(*) AS labels, count(DISTINCT s.brand_name) AS brands FROM skus s JOIN mp USING (brand_name) GROUP BY 1", "names", mp=MAP)
add("merge_history", """SELECT mp.brand_name AS old_brand, canonical_name AS new_brand, 'similarity' AS consolidation_type, count(*) AS sku_count_moved, 'registry' AS performed_by
  FROM mp JOIN skus USING (brand_name) WHERE mp.brand_name <> canonical_name GROUP BY ALL""", "names", mp=MAP)
LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand_name ORDER BY ts DESC, event_id DESC) AS rn FROM feedback) WHERE rn = 1"
add("website_state", """SELECT brand_name, CASE WHEN user_action <> 'rejected' THEN domain END AS domain, CASE user_action WHEN 'verified' THEN 'verified' WHEN 'flagged' THEN 'flagged' WHEN 'rejected' THEN NULL ELSE 'pending' END AS verification_status,
  CASE WHEN user_action = 'verified' THEN 1.0 WHEN user_action <> 'rejected' THEN confidence_predicted END AS confidence, user_action = 'flagged' AS needs_review FROM lt""", "feedback", lt=LATEST)
SITE_EVENTS = """SELECT brand_name, ts, event_id, CASE WHEN user_action <> 'not_selected' THEN user_action WHEN event_id % 3 = 0 THEN 'set_enrichment' ELSE 'set_website' END AS act,
    CASE WHEN user_action = 'flagged' AND event_id % 2 = 0 THEN 'k is ' || k END AS reason,
    CASE WHEN user_action <> 'not_selected' THEN NULL WHEN event_id % 3 <> 0 THEN site WHEN event_id % 5 = 0 THEN '{"rating": ' || coalesce(k::VARCHAR, 'null') || '}' ELSE '{"website": ' || site || '}' END AS document
  FROM (SELECT *, '{"url": "https://' || domain || '", "confidence": ' || confidence_predicted || ', "needs_review": true}' AS site FROM feedback)"""


def last_event(acts: str) -> str:
    return f"SELECT * FROM ev WHERE act IN ({acts}) QUALIFY row_number() OVER (PARTITION BY brand_name ORDER BY ts DESC, event_id DESC) = 1"


add("website_documents", """SELECT brand_name, web->>'$.url' AS url, CASE WHEN fok AND (NOT vok OR (fts, fid) > (vts, vid)) THEN 'flagged' WHEN vok THEN 'verified' ELSE web->>'$.verification_status' END AS verification_status,
    CASE WHEN vok THEN 1.0::DOUBLE ELSE (web->>'$.confidence')::DOUBLE END AS confidence, CASE WHEN fok AND (NOT vok OR (fts, fid) > (vts, vid)) THEN true WHEN vok THEN false ELSE (web->>'$.needs_review')::BOOLEAN END AS needs_review,
    CASE WHEN vok THEN strftime(vts, '%Y-%m-%dT%H:%M:%S.%f') END AS verified_date, CASE WHEN fok THEN coalesce(reason, 'Manual review requested') END AS flag_reason,
    CASE WHEN fok THEN strftime(fts, '%Y-%m-%dT%H:%M:%S.%f') END AS flagged_date, base_document
  FROM (SELECT *, web IS NOT NULL AND vts IS NOT NULL AND (vts, vid) > (sts, sid) AS vok, web IS NOT NULL AND fts IS NOT NULL AND (fts, fid) > (sts, sid) AS fok FROM
    (SELECT b.brand_name, CASE s.act WHEN 'set_website' THEN s.document WHEN 'set_enrichment' THEN s.document->>'$.website' END AS web, s.ts AS sts, s.event_id AS sid, v.ts AS vts, v.event_id AS vid,
        f.ts AS fts, f.event_id AS fid, f.reason, CASE w.act WHEN 'set_enrichment' THEN w.document END AS base_document
      FROM (SELECT DISTINCT brand_name FROM ev) b LEFT JOIN ls s USING (brand_name) LEFT JOIN lw w USING (brand_name) LEFT JOIN lv v USING (brand_name) LEFT JOIN lf f USING (brand_name)))""", "feedback",
    ev=SITE_EVENTS, ls=last_event("'rejected', 'set_website', 'set_enrichment'"), lw=last_event("'rejected', 'set_enrichment'"), lv=last_event("'verified'"), lf=last_event("'flagged'"))
add("contact_state", "SELECT brand_name, CASE WHEN user_action = 'verified' THEN 'completed' ELSE 'pending' END AS status, k AS company_id FROM lt", "feedback", lt=LATEST)
add("manual_training", "SELECT brand_name, domain, coalesce(confidence_predicted, 0.8)::DOUBLE AS confidence, 'verified' AS user_action FROM feedback", "feedback")
add("manual_entries", "SELECT event_id, brand_name, 'manual_' || row_number() OVER (PARTITION BY brand_name ORDER BY ts, event_id) AS entry_id FROM feedback WHERE user_action = 'verified'", "feedback")
# --- names -----------------------------------------------------------------------------------------
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(upper(trim(brand_name)), '[\"'']', '', 'g'), '\b(LLC|INC|CORP|COMPANY|CO\.|BREWING|WINERY|DISTILLERY)\b', '', 'g'), '\s+', ' ', 'g'))"
add("name_normalize", f"""SELECT brand_name, normalized, array_to_string(list_sort(list_distinct(list_filter(string_split(normalized, ' '), lambda w: length(w) >= 3))), '|') AS words
  FROM (SELECT brand_name, {NORM} AS normalized FROM names)""", "names")
HEADS = ", ".join(f"nullif(trim(regexp_extract(up, '^(?:{p.replace(chr(39), chr(39) * 2)})', 1)), '')" for p in rules.CORE_NAME_PATTERNS)
EVERY = sorted({t for terms in rules.PRODUCT_TERMS.values() for t in terms})


def strip_all(expr: str, patterns) -> str:
    for p in patterns:
        expr = f"regexp_replace({expr}, '(?i){p}', '', 'g')"
    return expr


def tidy(expr: str) -> str:
    expr = f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"
    expr = f"trim(regexp_replace({expr}, '\\s*[-–—&]\\s*$', ''))"
    return f"trim(regexp_replace(regexp_replace({expr}, '(?i)^(?:THE|A|AN)\\s+', ''), '(?i)\\s+(?:THE|A|AN)$', ''))"


CASED = f"""array_to_string(list_transform(string_split(fin, ' '), lambda w: CASE WHEN upper(w) IN ({q(rules.UPPERCASE_WORDS)}) OR regexp_matches(upper(w), '^[IVX]+$') THEN upper(w)
   WHEN regexp_matches(w, '^[0-9]+$') THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ')"""
CORE = f"""SELECT brand_name, {CASED} AS core FROM (SELECT brand_name, CASE WHEN length(bare) < 2 THEN array_to_string(string_split(up, ' ')[1:3], ' ')
    WHEN len(string_split(bare, ' ')) > 4 THEN array_to_string(string_split(bare, ' ')[1:3], ' ') ELSE bare END AS fin
  FROM (SELECT brand_name, up, {tidy(strip_all("array_to_string(list_filter(string_split(coalesce(" + HEADS + ", up), ' '), lambda w: w <> '' AND NOT list_contains([" + q(EVERY) + "], w)), ' ')", rules.AGE_PATTERNS + rules.PROOF_PATTERNS))} AS bare
    FROM (SELECT brand_name, upper(trim(brand_name)) AS up FROM names)))"""
add("core_brand", "SELECT * FROM core", "names", core=CORE)
CORE_RATIO = f"""SELECT brand_name, core, round({BOOSTED.format(x='a', y='b')}, 6)::DOUBLE AS boosted, round(CASE WHEN trim(a) = trim(b) THEN 1.0 ELSE ratio END, 6)::DOUBLE AS plain, CASE WHEN m.l > 3 THEN brand_name[-m.i:m.l-m.i-1] ELSE '' END AS base
  FROM (SELECT *, {BLOCK} AS m FROM (SELECT brand_name, core, upper(brand_name) AS a, upper(core) AS b, lower(brand_name) AS x, lower(core) AS y FROM core)) JOIN rt USING (a, b)"""
STORES = "array_to_string(list_sort(list_filter([" + q(rules.STORE_BRANDS) + "], lambda s: contains(upper(brand_name), s))), '|')"
add("white_label", f"SELECT brand_name, {WHITE} AS white_label, {STORES} AS stores FROM names", "names")
IND = f"""({n_of("lower(brand_name)", [t for t in rules.PRODUCT_INDICATORS])} + CASE WHEN NOT contains(brand_name, ' ') AND length(brand_name) < 6 THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(brand_name, '[0-9]') AND NOT regexp_matches(brand_name, '18[0-9][0-9]|19[0-9][0-9]|20[0-9][0-9]') THEN 1 ELSE 0 END
  + len(list_filter(class_types, lambda ct: {" OR ".join(f"(contains(lower(ct), '{t}') AND contains(lower(brand_name), '{t}'))" for t in rules.PRODUCT_CLASS_TERMS)})))"""
COMPANY = f"({any_of('lower(brand_name)', rules.COMPANY_INDICATORS)} AND len(string_split(brand_name, ' ')) >= 2 AND regexp_matches(brand_name, '(^|\\s)[A-Z]'))"
add("product_name_flag", f"SELECT brand_name, {IND}::BIGINT AS indicators, {IND} >= 2 AS product_name, {COMPANY} AS company_name FROM brands", "brands")
TITLE = "array_to_string(list_transform(string_split(brand_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
add("name_variations", f"""SELECT variation, count(DISTINCT brand_name) AS brands, min(brand_name) AS first_brand FROM (
  SELECT brand_name, unnest(list_distinct([brand_name, core, upper(brand_name), lower(brand_name), {TITLE}, upper(core), lower(core)])) AS variation FROM core) GROUP BY 1""", "names", core=CORE)
NEXT = "SELECT *, regexp_replace(brand_name, '[0-9]+$', '') AS stem FROM brands"
DOM = r"replace(regexp_extract(lower({u}), '^(?:https?://)?([^/?#]+)', 1), 'www.', '')"
JAC = "(len(list_intersect(a.{c}, b.{c})) / len(list_distinct(list_concat(a.{c}, b.{c}))))"
NEXT_PAIRS = "SELECT upper(a.brand_name) AS a, upper(b.brand_name) AS b FROM nx a JOIN nx b ON a.stem = b.stem AND a.n + 1 = b.n"
PAIR = f"""SELECT a.brand_name AS name_a, b.brand_name AS name_b, {BOOSTED.format(x='rt.a', y='rt.b')} AS sim,
  {DOM.format(u='a.url')} AS da, {DOM.format(u='b.url')} AS db, {JAC.format(c='countries')} AS loc, {JAC.format(c='class_types')} AS typ FROM nx a JOIN nx b ON a.stem = b.stem AND a.n + 1 = b.n JOIN rt ON rt.a = upper(a.brand_name) AND rt.b = upper(b.brand_name)"""
LAST2 = "array_to_string(string_split({d}, '.')[-2:], '.')"
add("pair_confidence", f"""SELECT name_a, name_b, round(sim, 6) AS similarity, ds AS domain_similarity, round(loc, 6) AS location_similarity,
   round((sim * 0.4 + loc * 0.15 + typ * 0.15 + coalesce(ds, 0) * 0.3) / CASE WHEN ds IS NULL THEN 0.7 ELSE 1.0 END, 6)::DOUBLE AS confidence
  FROM (SELECT *, CASE WHEN da IS NULL OR db IS NULL THEN NULL WHEN da = db THEN 1.0 WHEN {LAST2.format(d='da')} = {LAST2.format(d='db')} THEN 0.8 ELSE 0.0 END::DOUBLE AS ds FROM pr)""", "brands", nx=NEXT, **ratio_steps(NEXT_PAIRS), pr=PAIR)
NOYEAR = r"trim(regexp_replace(lower({x}), '\b(18|19|20)\d{{2}}\b', '', 'g'))"
NOED = r"trim(regexp_replace(regexp_replace(lower({x}), '\b(limited|special|reserve|edition|select)\b', '', 'g'), '\s+', ' ', 'g'))"


def location_test() -> str:
    return "(" + " OR ".join(f"(trim(replace(la, '{p}', '')) = trim(replace(lb, '{p}', '')) AND trim(replace(la, '{p}', '')) <> '')" for p in rules.LOCATION_WORDS) + ")"


def suffix_test() -> str:
    one = "({x} LIKE '%{s}' AND {y} NOT LIKE '%{s}' AND trim(replace({x}, '{s}', '')) = {y})"
    return "(" + " OR ".join(one.format(x=x, y=y, s=s) for s in rules.BRAND_SUFFIXES for x, y in (("la", "lb"), ("lb", "la"))) + ")"


def abbreviation_test() -> str:
    one = "(contains({x}, '{f}') AND contains({y}, '{s}') AND replace({x}, '{f}', '{s}') = {y})"
    return "(" + " OR ".join(one.format(x=x, y=y, f=f, s=s) for f, ss in rules.NAME_ABBREVIATIONS.items() for s in ss for x, y in (("la", "lb"), ("lb", "la"))) + ")"


KIND = f"""CASE WHEN la = lb THEN 'exact' WHEN {NOYEAR.format(x='la')} = {NOYEAR.format(x='lb')} AND {NOYEAR.format(x='la')} <> '' AND regexp_matches(la, '\\b(18|19|20)\\d{{2}}\\b') AND regexp_matches(lb, '\\b(18|19|20)\\d{{2}}\\b') THEN 'year_variation'
  WHEN {location_test()} THEN 'location_variation' WHEN {suffix_test()} THEN 'suffix_variation' WHEN {abbreviation_test()} THEN 'abbreviation'
  WHEN {NOED.format(x='la')} = {NOED.format(x='lb')} AND {NOED.format(x='la')} <> '' THEN 'special_edition' END"""
KINDS = f"SELECT name_a, name_b, {KIND} AS kind FROM (SELECT a.brand_name AS name_a, b.brand_name AS name_b, lower(a.brand_name) AS la, lower(b.brand_name) AS lb FROM nx a JOIN nx b ON a.stem = b.stem AND a.n + 1 = b.n)"
add("variation_types", "SELECT * FROM kd", "brands", nx=NEXT, kd=KINDS)
CT = "lower(array_to_string(class_types, ' '))"
STRAT = f"""SELECT brand_name, regexp_matches(lower(brand_name), '^(a|the|an|and|or) ') AS starts_with_common_word, regexp_matches(brand_name, '[0-9]') AS has_numbers, len(string_split(brand_name, ' '))::BIGINT AS word_count,
  contains({CT}, 'wine') AS is_wine, {any_of(CT, rules.STRATEGY_SPIRIT_WORDS)} AS is_spirits, {any_of(CT, rules.STRATEGY_BEER_WORDS)} AS is_beer, contains(lower(array_to_string(countries, '~')), 'united states') AS is_us_brand FROM brands"""
KEYPARTS = "concat_ws(':', {s}, CASE WHEN starts_with_common_word THEN 'common_word_start' END, CASE WHEN has_numbers THEN 'has_numbers' END, CASE WHEN is_wine THEN 'wine' WHEN is_spirits THEN 'spirits' WHEN is_beer THEN 'beer' END)"
add("core_pairs_ratio", CORE_RATIO, "names", core=CORE, **ratio_steps("SELECT upper(brand_name) AS a, upper(core) AS b FROM core"))
add("strategy_features", f"SELECT *, {KEYPARTS.format(s=chr(39) + 'exact' + chr(39))} AS strategy_key FROM sf", "brands", sf=STRAT)
SUFFIXES = "|".join(s.replace(".", "\\.") for s in rules.TRAILING_TRADE_SUFFIXES)
add("name_suggestions", f"""SELECT brand_name, regexp_replace(lower(brand_name), '[^a-z0-9]', '', 'g') || '.com' AS direct_domain,
  '"' || brand_name || '"|"' || brand_name || '" official website|"' || brand_name || '" distillery|"' || brand_name || '" spirits|"' || brand_name || '" official website' AS phrases,
  trim(regexp_replace(regexp_replace(brand_name, ' [0-9]+$', ''), '(?i)(?:{SUFFIXES})$', '')) AS bare_name, md5(brand_name) AS query_key, md5(brand_name)[1:8] AS short_key FROM names""", "names")

# --- domains -------------------------------------------------------------------------------------
FIRSTLABEL = "split_part({d}, '.', 1)"
BASE = "upper(trim(regexp_replace(CASE " + " ".join(f"WHEN {FIRSTLABEL} LIKE '%{s}' THEN regexp_replace(regexp_replace({FIRSTLABEL}, '{s}$', ''), '[-_]+$', '')" for s in rules.DOMAIN_TRADE_SUFFIXES) + f" ELSE {FIRSTLABEL} END, '[-_]', ' ', 'g')))"
add("domain_extract", f"SELECT page_id, d AS domain, {LAST2.format(d='d')} AS registered, {BASE.format(d='d')} AS base FROM (SELECT page_id, {DOM.format(u='url')} AS d FROM pages)")
MEMBERS = f"SELECT *, {DOM.format(u='url')} AS domain FROM brands WHERE url IS NOT NULL"
add("domain_groups", "SELECT domain, count(*) AS brands FROM dm GROUP BY 1 HAVING count(*) > 1", "brands", dm=MEMBERS)
BASED = f"SELECT *, {BASE.format(d='domain')} AS base FROM dm"
TREE_PAIRS = "SELECT base AS a, brand_name AS b FROM db WHERE base <> '' AND NOT contains(brand_name, base)"
TREE_M = "SELECT db.*, CASE WHEN base = '' THEN 0.0 WHEN base = brand_name THEN 1.0 WHEN contains(brand_name, base) THEN 0.9 ELSE ratio END::DOUBLE AS sim FROM db LEFT JOIN rt ON base = a AND brand_name = b"
TREE = """SELECT *, CASE WHEN m > 0 THEN 'sku_to_brand_' || replace(domain, '.', '_') || '_' || (n - m) || '_brands' ELSE 'portfolio_' || replace(domain, '.', '_') || '_' || n || '_brands' END AS proposal_id,
    CASE WHEN m > 0 THEN 'SKU_TO_BRAND' ELSE 'PORTFOLIO_BRANDS' END AS consolidation_type, CASE WHEN m > 0 THEN parent ELSE richest END AS canonical_name,
    CASE WHEN m > 0 THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence, CASE WHEN m > 0 THEN n - m ELSE n - 1 END AS brands_to_merge FROM (
  SELECT domain, count(*) AS n, count(*) FILTER (sim > 0.7) AS m, first(brand_name ORDER BY coalesce(confidence, 0) DESC, sim DESC, brand_name) FILTER (sim > 0.7) AS parent,
    first(brand_name ORDER BY coalesce(confidence, 0) DESC, brand_name) AS richest FROM tm GROUP BY 1) WHERE n > 1 AND (m = 0 OR m < n)"""
TREE_STEPS = dict(dm=MEMBERS, db=BASED, **ratio_steps(TREE_PAIRS), tm=TREE_M, tree=TREE)
PCOLS = "proposal_id, consolidation_type, canonical_name, confidence, brands_to_merge"
add("domain_hierarchy", f"SELECT domain, {PCOLS} FROM tree", "brands", **TREE_STEPS)
TREE_ROWS = "SELECT proposal_id, brand_name FROM tm JOIN tree USING (domain) WHERE CASE WHEN m > 0 THEN sim <= 0.7 ELSE brand_name <> canonical_name END"
add("domain_hierarchy_members", TREE_ROWS, "brands", **TREE_STEPS)
BARE = "replace(replace(replace(domain, '.com', ''), '.net', ''), '.org', '')"
SPACED = "upper(trim(regexp_replace({x}, '[-_.]+', ' ', 'g')))"
EDGE = "regexp_replace({x}, '^[-_]+|[-_]+$', '', 'g')"
WINERY = EDGE.format(x=f"replace(replace({BARE}, 'winery', ''), 'wine', '')")
FROMDOM = f"""CASE WHEN contains({BARE}, 'brewing') THEN {SPACED.format(x=EDGE.format(x=f"replace({BARE}, 'brewing', '')"))} || ' BREWING'
  WHEN contains({BARE}, 'wine') THEN {SPACED.format(x=f"CASE WHEN {WINERY} LIKE '%works' THEN {EDGE.format(x=f'replace({WINERY}, chr(119)||chr(111)||chr(114)||chr(107)||chr(115), chr(32))')} ELSE {WINERY} END")} || ' WINERY'
  WHEN contains({BARE}, 'distillery') OR contains({BARE}, 'spirits') THEN {SPACED.format(x=EDGE.format(x=f"replace(replace({BARE}, 'distillery', ''), 'spirits', '')"))} || ' DISTILLERY'
  ELSE {SPACED.format(x=BARE)} END"""
NORMP = f"""SELECT 'normalization_' || replace(lower(s), ' ', '_') AS proposal_id, domain, 'normalization' AS consolidation_type, s AS canonical_name, CASE WHEN n = 1 THEN 0.85 ELSE 0.9 END::DOUBLE AS confidence, n AS brands_to_merge
  FROM (SELECT domain, n, p, only_one, coalesce(best, {FROMDOM}) AS s FROM (
    SELECT domain, count(*) AS n, count(*) FILTER ({IND} >= 2) AS p, min(brand_name) AS only_one, first(brand_name ORDER BY length(brand_name) DESC, brand_name) FILTER ({COMPANY}) AS best FROM dm GROUP BY 1))
  WHERE p > 0 AND s <> '' AND (n > 1 OR upper(only_one) <> upper(s))"""
add("name_normalization", "SELECT * FROM np", "brands", dm=MEMBERS, np=NORMP)
add("completeness", f"SELECT brand_name, round(0.6 + CASE WHEN brand_name IN (SELECT brand_name FROM bridge) THEN 0.2 ELSE 0 END + CASE WHEN has_document THEN 0.2 ELSE 0 END, 1)::DOUBLE AS completeness FROM brands", "brands", "brand_permits", "importers", bridge=BRIDGE)
REPORT = f"SELECT {PCOLS}, 0 AS source_priority FROM np UNION ALL SELECT {PCOLS}, 1 FROM tree"
PSTEPS = dict(**TREE_STEPS, np=NORMP, rep=REPORT)
add("proposals", "SELECT * FROM rep", "brands", **PSTEPS)
add("opportunity_breakdown", """SELECT consolidation_type, count(*) AS proposals, count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS medium,
  count(*) FILTER (confidence < 0.7) AS low FROM rep GROUP BY 1""", "brands", **PSTEPS)
KINDOF = "CASE WHEN starts_with(proposal_id, 'normalization_') THEN 'normalization' WHEN starts_with(proposal_id, 'sku_to_brand_') THEN 'sku_to_brand' ELSE 'portfolio_company' END"
APPROVED = f"SELECT *, {KINDOF} AS kind, confidence >= 0.95 OR (confidence >= 0.9 AND {KINDOF} <> 'portfolio_company') OR (confidence >= 0.85 AND {KINDOF} = 'portfolio_company') AS auto_approved FROM rep"
add("approvals", "SELECT proposal_id, kind, confidence, auto_approved FROM ap", "brands", **PSTEPS, ap=APPROVED)
add("batch_selection", "SELECT proposal_id, canonical_name, confidence FROM ap WHERE confidence >= 0.8", "brands", **PSTEPS, ap=APPROVED)
MROWS = f"SELECT proposal_id, brand_name FROM dm JOIN np USING (domain) UNION ALL {TREE_ROWS}"
ONE = """SELECT brand_name, first(canonical_name ORDER BY source_priority, confidence DESC, proposal_id) AS canonical_name FROM mr JOIN (SELECT * FROM ap WHERE auto_approved) USING (proposal_id) WHERE brand_name <> canonical_name GROUP BY 1"""
FINALMAP = """SELECT * FROM (WITH RECURSIVE walk AS (SELECT brand_name, canonical_name, 1 AS depth FROM one
    UNION ALL SELECT w.brand_name, o.canonical_name, depth + 1 FROM walk w JOIN one o ON o.brand_name = w.canonical_name WHERE depth < 64)
  SELECT brand_name, canonical_name FROM walk WHERE canonical_name NOT IN (SELECT brand_name FROM one))"""
add("merge_execution", "SELECT coalesce(f.canonical_name, s.brand_name) AS brand_name, count(*) AS labels, count(DISTINCT s.brand_name) AS brands FROM skus s LEFT JOIN fm f USING (brand_name) GROUP BY 1",
    "brands", **PSTEPS, ap=APPROVED, mr=MROWS, one=ONE, fm=FINALMAP)
# --- groups ----------------------------------------------------------------------------------------
PWHITE = any_of("upper(brand_name)", rules.PROPOSAL_WHITE_LABELS)
ROLL = f"""SELECT canonical_name AS group_id, count(*) AS brand_count, sum(sku_count)::BIGINT AS total_skus, count(DISTINCT core) AS cores, count(*) FILTER ({PWHITE}) AS white,
    len(list_distinct(flatten(list(countries)))) AS countries_n, len(list_distinct(flatten(list(class_types)))) AS types_n FROM mp JOIN brands USING (brand_name) JOIN core USING (brand_name) GROUP BY 1"""
MAKERS = "SELECT canonical_name AS group_id, count(*) AS permits, count(DISTINCT permit_no) AS distinct_permits, count(DISTINCT CASE WHEN relationship = 'primary_producer' THEN owner_name END) AS primary_names FROM mp JOIN attr USING (brand_name) GROUP BY 1"
GPAIRS = "SELECT x.canonical_name AS group_id, x.brand_name AS na, y.brand_name AS nb FROM mp x JOIN mp y ON x.canonical_name = y.canonical_name AND x.brand_name < y.brand_name"
GSIM = "SELECT group_id, avg(ratio) AS alike FROM gp JOIN rt ON a = upper(na) AND b = upper(nb) GROUP BY 1"
DOCS = """SELECT *, CASE WHEN cs >= 0.9 THEN 'high_confidence' WHEN cs >= 0.7 THEN 'medium_confidence' WHEN cs >= 0.5 THEN 'low_confidence' ELSE 'requires_investigation' END AS proposal_type,
    CASE WHEN mixed THEN 'high' WHEN types_n > 5 OR coalesce(primary_names, 0) > 2 THEN 'medium' ELSE 'low' END AS risk_level FROM (
  SELECT *, CASE WHEN brand_count < 2 THEN 0.0 ELSE round(greatest(0, least(1, CASE WHEN cores = 1 THEN 0.4 ELSE 0 END + CASE WHEN distinct_permits < permits THEN 0.3 ELSE 0 END + CASE WHEN types_n <= 3 THEN 0.15 ELSE 0 END
    + CASE WHEN countries_n = 1 THEN 0.1 ELSE 0 END + coalesce(alike, 0) * 0.2::DOUBLE - CASE WHEN mixed THEN 0.3 ELSE 0 END)), 6) END::DOUBLE AS cs FROM (SELECT *, white > 0 AND white < brand_count AS mixed FROM ro LEFT JOIN mk USING (group_id) LEFT JOIN gs USING (group_id)))"""
DOC_STEPS = dict(mp=MAP, core=CORE, prod=PRODUCERS, attr=ATTR, ro=ROLL, mk=MAKERS, gp=GPAIRS, **ratio_steps("SELECT upper(na) AS a, upper(nb) AS b FROM gp"), gs=GSIM, dc=DOCS)
DOC_VIEWS = ("brands", "brand_permits", "spirits", "wines")
add("proposal_rollup", "SELECT group_id, brand_count, total_skus, countries_n, types_n, permits, distinct_permits, primary_names, round(cs, 4) AS confidence_score, proposal_type, risk_level FROM dc", *DOC_VIEWS, **DOC_STEPS)
add("proposal_documents", """SELECT group_id, brand_count, total_skus, cs AS confidence_score, proposal_type, risk_level,
    concat_ws('; ', CASE WHEN mixed THEN 'Mixed white label and regular brands - may have different brand owners' END, CASE WHEN types_n > 5 THEN 'Wide variety of product categories - may be unrelated brands' END,
      CASE WHEN primary_names > 2 THEN 'Multiple primary producers - may indicate separate brands' END) AS risks,
    concat_ws('; ', 'Organize ' || total_skus || ' SKUs under unified brand', CASE WHEN brand_count > 2 THEN 'Consolidate ' || brand_count || ' brand variations into single entity' END) AS benefits FROM dc""", *DOC_VIEWS, **DOC_STEPS)
SCORES = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in rules.VARIATION_SCORES.items()) + "}"
GTYPED = f"""SELECT group_id, count(*) AS comparisons, avg(coalesce({SCORES}[kind], ratio)) AS alike FROM (SELECT *, {KIND} AS kind FROM (SELECT *, lower(na) AS la, lower(nb) AS lb FROM gp)) JOIN rt ON a = la AND b = lb GROUP BY 1"""
add("group_recommendations", """SELECT group_id, comparisons, round(alike, 6) AS average_similarity, CASE WHEN alike >= 0.9 THEN 'strongly_recommend' WHEN alike >= 0.7 THEN 'recommend' WHEN alike >= 0.5 THEN 'review_needed' ELSE 'not_recommended' END AS recommendation FROM gt""",
    "names", mp=MAP, gp=GPAIRS, **ratio_steps("SELECT lower(na) AS a, lower(nb) AS b FROM gp"), gt=GTYPED)
add("sku_preview", """SELECT canonical_name AS group_id, brand_name AS original_brand, ttb_id, coalesce(nullif(fanciful_name, ''), nullif(trim(replace(brand_name, canonical_name, '')), ''), 'Original') AS new_sku_name
  FROM skus JOIN mp USING (brand_name)""", "names", mp=MAP)
add("merge_strategy", """SELECT canonical_name AS group_id, last(brand_name ORDER BY position, brand_name) FILTER (verified) AS verified_enrichment,
    first(brand_name ORDER BY confidence DESC, position, brand_name) FILTER (confidence > 0) AS best_website, max(coalesce(confidence, 0)) AS highest_confidence, last(brand_name ORDER BY position, brand_name) AS most_complete_data
  FROM mp JOIN brands USING (brand_name) GROUP BY 1""", "brands", mp=MAP)
add("canonical_by_score", r"""SELECT group_id, first(brand_name ORDER BY s DESC, brand_name) AS canonical_name, max(s)::DOUBLE AS score FROM (
  SELECT canonical_name AS group_id, brand_name, (50 - length(brand_name)) * 0.5 + CASE WHEN regexp_matches(brand_name, '\b(18|19|20)\d{2}\b') THEN 0 ELSE 10 END
    + CASE WHEN regexp_matches(lower(brand_name), '\b(limited|special|reserve|edition|select)\b') THEN 0 ELSE 10 END + sku_count * 2 + CASE WHEN verified THEN 20 ELSE 0 END AS s FROM mp JOIN brands USING (brand_name)) GROUP BY 1""", "brands", mp=MAP)
FILED = "SELECT brand_name, min(filed) AS filed FROM skus GROUP BY 1"
UPP = f"""SELECT new_brand, existing_brand, la, lb, {KIND} AS kind FROM (SELECT n.brand_name AS new_brand, e.brand_name AS existing_brand, lower(trim(n.brand_name)) AS la, lower(trim(e.brand_name)) AS lb
  FROM fl n JOIN fl e ON n.filed >= DATE '1995-06-01' AND e.filed < DATE '1995-06-01')"""
CLOSE = "SELECT la AS a, lb AS b FROM up WHERE kind IS NULL AND levenshtein(la, lb) <= floor(0.3 * (length(la) + length(lb)) + 1e-9)"
UPS = f"""SELECT new_brand, existing_brand, coalesce({SCORES}[kind], ratio) AS similarity, coalesce(kind, 'fuzzy_match') AS pattern_type, lower(existing_brand) AS x, lower(new_brand) AS y
  FROM up LEFT JOIN rt ON kind IS NULL AND la = a AND lb = b WHERE kind IS NOT NULL OR ratio >= 0.7::DOUBLE"""
UPV = f"SELECT new_brand, existing_brand, similarity, pattern_type, CASE WHEN m.l > 3 THEN existing_brand[-m.i:m.l-m.i-1] ELSE '' END AS base_pattern FROM (SELECT *, {BLOCK} AS m FROM us)"
UPLOAD = {"fl": FILED, "up": UPP, **ratio_steps(CLOSE), "us": UPS, "uv": UPV}
add("upload_variations", "SELECT new_brand, existing_brand, round(similarity, 6) AS similarity, pattern_type, base_pattern FROM uv", "skus", **UPLOAD)
add("upload_patterns", """SELECT pattern_type, base_pattern, round(least(1.0, first(similarity ORDER BY new_brand, existing_brand) + 0.05::DOUBLE * (count(*) - 1)), 6)::DOUBLE AS confidence, count(*) AS success_count, 0::BIGINT AS failure_count,
  first(existing_brand ORDER BY new_brand, existing_brand) AS first_existing, first(new_brand ORDER BY new_brand, existing_brand) AS first_new FROM uv GROUP BY 1, 2""", "skus", **UPLOAD)
# --- web results -----------------------------------------------------------------------------------
WCTX = """SELECT *, lower(brand_name) AS b, lower(title || ' ' || snippet) AS t, lower(domain) AS d, lower(title) AS tl, lower(snippet) AS sl,
  CASE WHEN page_id % 2 = 0 THEN 'table red wine' ELSE 'straight bourbon whisky' END AS cls, CASE WHEN page_id % 3 = 0 THEN 'france' ELSE 'ireland' END AS ctry, page_id % 20 AS skn,
  list_filter(string_split(lower(brand_name), ' '), lambda w: length(w) > 2) AS kw, list_filter(string_split(lower(brand_name), ' '), lambda w: length(w) > 3) AS lw FROM web"""
ANYW = "(len(list_filter({l}, lambda w: contains({x}, w))) > 0)"
COMB = "(d || ' ' || t)"
GATE = f"""((contains({COMB}, b) AND {any_of(COMB, rules.GATE_PRODUCTS + rules.GATE_FACILITIES)}) OR {any_of(COMB, rules.GATE_FACILITIES + rules.GATE_EXTRA_FACILITIES)}
  OR ({any_of(COMB, rules.GATE_WORD_PRODUCTS)} AND {ANYW.format(l='kw', x=COMB)}))"""
BLOCKED = any_of("d", rules.BLOCKED_DOMAINS + rules.FORUM_WORDS)
DCLEAN = "replace(d, 'www.', '')"
NUM = "len(regexp_extract_all(brand_name, '[0-9]+')) > 0 AND regexp_extract_all(brand_name, '[0-9]+') = regexp_extract_all({d}, '[0-9]+')"
DSC = f"""greatest(0.0, least(1.0, greatest(CASE WHEN contains(replace({DCLEAN}, '.', ''), replace(b, ' ', '')) THEN 0.9 WHEN len(list_filter(kw, lambda w: NOT contains({DCLEAN}, w))) = 0 THEN 0.7 WHEN {ANYW.format(l='kw', x=DCLEAN)} THEN 0.5 ELSE 0.0 END,
   CASE WHEN {NUM.format(d=DCLEAN)} THEN 0.8 ELSE 0.0 END) + CASE WHEN {DCLEAN} LIKE '%.com' THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches({DCLEAN}, '\\.(tk|ml|ga|cf)$') THEN 0.3 ELSE 0 END))"""
W = "[\\pL\\pN_]"
MK, NM = W + r"\s+(?:distillery|brewery|winery)", r"\s+(?:" + W + r"+\s+)+(?:distillery|brewery|winery)"
REL = [(MK + r"\s+(?:produces?|makes?|crafts?)\s+(?:the\s+)?", ""), ("", r"\s+(?:is\s+)?(?:made|produced|crafted|distilled|brewed)\s+(?:by|at)" + NM), (r"(?:from|by)" + NM + ".*", ""),
       ("", r".*(?:from|by)" + NM), (MK + r".*(?:flagship|premium|signature)\s+(?:brand\s+)?", "")]
PORT = [(r"(?:brands?|portfolio|products?)\s+(?:include|feature)s?\s+.*", ""), ("", r"\s+(?:is\s+)?(?:one\s+of\s+)?(?:our|their)\s+(?:flagship|premium|signature|main)\s+(?:brands?|products?)"),
        (r"(?:featuring|including|offering)\s+.*", r".*(?:vodka|whiskey|whisky|gin|rum|bourbon|spirits?)"), (r"(?:makers?\s+of|producers?\s+of|creators?\s+of)\s+.*", "")]


def embedded(parts) -> str:
    return "(contains(t, b) AND (" + " OR ".join(f"regexp_matches(t, '{x}' || regexp_escape(b) || '{y}')" for x, y in parts) + "))"


MENT = "(length(t) - length(replace(t, b, ''))) / length(b)"
BM0 = f"CASE WHEN {MENT} >= 3 THEN 0.9 WHEN {MENT} >= 2 THEN 0.7 WHEN {MENT} >= 1 THEN 0.5 ELSE 0.0 END + CASE WHEN starts_with(t, b) THEN 0.1 ELSE 0 END"
BM1 = f"""greatest(CASE WHEN contains(t, 'welcome to ' || b) THEN 1.0 ELSE {BM0} END, CASE WHEN contains(t, b || ' distillery') OR contains(t, b || ' brewery') OR contains(t, b || ' winery') THEN 0.9 ELSE 0 END,
  CASE WHEN {embedded(REL)} THEN 0.85 ELSE 0 END, CASE WHEN {embedded(PORT)} THEN 0.8 ELSE 0 END,
  CASE WHEN len(string_split(b, ' ')) > 1 AND len(list_filter(kw, lambda w: contains(t, w))) >= len(kw) * 0.7 THEN 0.6 ELSE 0 END)"""
INDS = f"""(CASE WHEN {n_of('t', rules.INDUSTRY_WEIGHTS)} > 0 THEN ({' + '.join(f"CASE WHEN contains(t, '{k}') THEN {v} ELSE 0 END" for k, v in rules.INDUSTRY_WEIGHTS.items())}) / (1 + {n_of('t', rules.INDUSTRY_WEIGHTS)} * 0.3) ELSE 0 END)"""
BON = "CASE " + " ".join(f"WHEN {any_of('cls', trig)} THEN least(0.4, {n_of('t', terms)} * 0.15)" for trig, terms in rules.CLASS_CONTEXT_TERMS) + " ELSE 0 END"
REGION = "CASE WHEN contains(t, ctry) THEN 0.2 " + " ".join(f"WHEN ctry IN ({q(cs)}) AND {any_of('t', terms)} THEN {v}" for cs, terms, v in rules.REGION_TERMS) + " ELSE 0 END"
OFF = "least(1.0, greatest(" + ", ".join(f"CASE WHEN contains(t, '{k}') THEN {v} ELSE 0 END" for k, v in rules.OFFICIAL_WEIGHTS.items()) + ") + " + " + ".join(f"CASE WHEN contains(t, '{k}') THEN {v} * 0.5 ELSE 0 END" for k, v in rules.VISIT_WEIGHTS.items()) + ")"
NEG = "greatest(" + ", ".join(f"CASE WHEN contains(d, '{k}') THEN {-v * 1.5} WHEN contains(t, '{k}') THEN {-v} ELSE 0 END" for k, v in rules.NEGATIVE_WEIGHTS.items()) + ")"
CTX = f"least(1.0, CASE WHEN contains(t, ctry) THEN 0.3 ELSE 0 END + CASE WHEN skn > 10 AND {any_of('t', rules.HERITAGE_TERMS)} THEN 0.2 ELSE 0 END)"
PARTS = f"""SELECT page_id, brand_name, url, {BLOCKED} AS blocked, {GATE} AS relevant, ({DSC})::DOUBLE AS domain_score, ({BM1})::DOUBLE AS bm,
  len(list_filter(kw, lambda w: contains(regexp_replace(d, '[^\\pL\\pN_]', '', 'g'), w))) > 0 AS aligned, least(1.0, {INDS} + {BON} + {REGION})::DOUBLE AS industry_score, ({OFF})::DOUBLE AS official_score, ({NEG})::DOUBLE AS negative_score, ({CTX})::DOUBLE AS context_score FROM wc"""
WSC = """SELECT *, CASE WHEN live THEN greatest(0.0, least(1.0, domain_score * 0.3 + brand_match_score * 0.25 + industry_score * 0.2 + official_score * 0.15 - negative_score * 0.1 + context_score * 0.1)) ELSE 0.0 END AS score FROM (
  SELECT *, NOT blocked AND relevant AS live, least(1.0, bm + CASE WHEN aligned AND bm > 0 THEN 0.2 ELSE 0 END) AS brand_match_score FROM wp)"""
WS = dict(wc=WCTX, wp=PARTS, ws=WSC)
LIVE = ["domain_score", "brand_match_score", "industry_score", "official_score", "negative_score", "context_score"]
EXPL = """coalesce(nullif(concat_ws(' • ', CASE WHEN domain_score > 0.7 THEN 'Strong domain match' WHEN domain_score > 0.4 THEN 'Partial domain match' END, CASE WHEN brand_match_score > 0.7 THEN 'Multiple brand mentions' END,
   CASE WHEN industry_score > 0.6 THEN 'High industry relevance' WHEN industry_score > 0.3 THEN 'Industry-related content' END, CASE WHEN official_score > 0.7 THEN 'Official website indicators' END,
   CASE WHEN negative_score > 0.5 THEN '⚠️ Contains negative indicators' END, CASE WHEN context_score > 0.3 THEN 'Matches brand context' END), ''), 'General result')"""
add("web_score", f"""SELECT page_id, brand_name, blocked, relevant, {', '.join(f'CASE WHEN live THEN round({c}, 6) END AS {c}' for c in LIVE)}, round(score, 6) AS score, CASE WHEN live THEN {EXPL} ELSE 'General result' END AS explanation FROM ws""", "web", **WS)
add("web_rank", """SELECT brand_name, page_id, position::INTEGER AS position, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY brand_name ORDER BY score DESC, url) AS position FROM ws WHERE NOT blocked) WHERE position <= 3""", "web", **WS)


def plus(cond: str, value: float) -> str:
    return f"CASE WHEN {cond} THEN {value}::DOUBLE ELSE 0 END"


BASIC = f"""greatest(0.0, least(1.0, {plus(any_of('d', ['.com', '.net', '.org']), 0.3)} + CASE WHEN contains(d, b) THEN 0.4::DOUBLE WHEN {ANYW.format(l='lw', x='d')} THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN contains(tl, b) THEN 0.2::DOUBLE WHEN {ANYW.format(l='lw', x='tl')} THEN 0.1::DOUBLE ELSE 0 END + {plus(any_of('d', rules.FAST_INDUSTRY_TERMS), 0.2)} + {plus(any_of('tl', rules.FAST_INDUSTRY_TERMS), 0.1)} + {plus(any_of('sl', rules.FAST_INDUSTRY_TERMS), 0.1)}
  - {plus(any_of('d', rules.FAST_BAD_TERMS), 0.5)} - {plus(any_of('tl', rules.FAST_BAD_TERMS), 0.3)} + {plus(any_of('d', ['official', 'www']), 0.1)} - {plus(any_of('d', rules.FAST_LISTING_TERMS), 0.2)}))"""
BCONF = f"SELECT *, ({BASIC})::DOUBLE AS conf FROM wc"
add("confidence_basic", "SELECT page_id, round(conf, 6) AS confidence FROM bc", "web", wc=WCTX, bc=BCONF)
LEGACY = f"""least(1.0, {plus("contains(domain, replace(lower(brand_name), ' ', ''))", 0.4)} + {plus(any_of('domain', rules.LEGACY_SPIRIT_TERMS), 0.2)}
  + len(list_filter(string_split(lower(brand_name), ' '), lambda w: contains(domain, w))) / len(string_split(brand_name, ' ')) * 0.3
  + CASE WHEN length(domain) - length(replace(domain, '.', '')) = 1 AND NOT {any_of('domain', ['blog', 'shop', 'store', 'news'])} THEN 0.1 ELSE 0 END)"""
add("confidence_legacy", f"SELECT event_id, round({LEGACY}, 6)::DOUBLE AS confidence FROM feedback", "feedback")
UNIQ = f"SELECT * FROM (SELECT *, replace(d, 'www.', '') AS cd, row_number() OVER (PARTITION BY brand_name, replace(d, 'www.', '') ORDER BY conf DESC, url) AS rn FROM bc) WHERE rn = 1"
add("web_dedupe", """SELECT brand_name, cd AS clean_domain, page_id, position::INTEGER AS position, round(conf, 6) AS confidence, top < 0.9 AS needs_selection FROM (
  SELECT *, row_number() OVER (PARTITION BY brand_name ORDER BY conf DESC, url) AS position, max(conf) OVER (PARTITION BY brand_name) AS top FROM un) WHERE position <= 3 AND (top < 0.9 OR position = 1)""", "web", wc=WCTX, bc=BCONF, un=UNIQ)
add("web_best", f"""SELECT brand_name, page_id, round(conf, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY brand_name ORDER BY {any_of('d', rules.FAST_BLOCKED_DOMAINS)}, conf DESC, url) AS rn FROM bc) WHERE rn = 1""", "web", wc=WCTX, bc=BCONF)
add("web_merge_sources", """SELECT brand_name, url, page_id, m::INTEGER AS merged_position FROM (SELECT *, row_number() OVER (PARTITION BY brand_name ORDER BY src, page_id, url) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY brand_name, url ORDER BY src, page_id) AS rn FROM (SELECT *, 0 AS src FROM web WHERE starts_with(url, 'https') UNION ALL SELECT *, 1 FROM web)) WHERE rn = 1) WHERE m <= 10""", "web")
CONTENT = "(tl || ' ' || sl || ' ' || lower(url))"
ALLW = "len(list_filter(lw, lambda w: contains({x}, w))) > 0"
HASB = f"(contains({CONTENT}, b) OR {ALLW.format(x=CONTENT)})"
RELV = f"""(NOT {any_of(CONTENT, rules.RELEVANCE_AVOID)} AND (({any_of('d', rules.RELEVANCE_DOMAIN_TERMS)} AND {HASB}) OR ({any_of(CONTENT, rules.RELEVANCE_TERMS)} AND {HASB})
  OR ({any_of(CONTENT, rules.RELEVANCE_TERMS)} AND {any_of(CONTENT, ['official', 'distillery', 'brewery', 'winery'])}) OR {any_of('tl', ['distillery', 'brewery', 'winery', 'spirits'])}))"""
SURV = f"""(NOT {any_of('tl', rules.SKIP_TITLE_TERMS)} AND (contains(tl, b) OR {any_of('tl', rules.SURVIVOR_TITLE_TERMS)}) AND NOT {any_of(DCLEAN, rules.HISTORY_DOMAINS)} AND NOT {any_of('lower(url)', rules.HISTORY_PATHS)}
  AND (contains(lower(url), b) OR {any_of('lower(url)', rules.SURVIVOR_CONTENT_TERMS)} OR {any_of('tl', rules.SURVIVOR_CONTENT_TERMS)}))"""
add("web_relevance", f"SELECT page_id, {RELV} AS relevant, {SURV} AS survives, {BLOCKED} AS blocked FROM wc", "web", wc=WCTX)
add("picked_website", f"SELECT brand_name, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM wc WHERE {SURV} GROUP BY 1", "web", wc=WCTX)
add("redirect_decode", "SELECT page_id, url FROM pages")
UFEAT = f"""SELECT event_id, ts, user_action, contains(domain, replace(lower(brand_name), ' ', '')) AS brand_in_domain, len(list_filter(string_split(lower(brand_name), ' '), lambda w: length(w) > 2 AND contains(domain, w))) > 0 AS brand_words_in_domain,
  replace(lower(brand_name), ' ', '') = replace(domain, '.com', '') AS exact_brand_match, {any_of('domain', rules.FEATURE_KEYWORDS)} AS has_industry_keyword, {NUM.format(d='domain')} AS numeric_match,
  {any_of('domain', rules.SOCIAL_WORDS)} AS is_social_media, {any_of('domain', rules.MARKET_WORDS)} AS is_marketplace, contains(domain, 'wikipedia') AS is_wiki, string_split(domain, '.')[-1] AS tld FROM feedback"""
UCOLS = ["brand_in_domain", "brand_words_in_domain", "exact_brand_match", "has_industry_keyword", "numeric_match", "is_social_media"]
add("url_features", "SELECT event_id, " + ", ".join(f"{c}::VARCHAR AS {c}" for c in UCOLS) + ", tld FROM uf", "feedback", uf=UFEAT)
CUP = "upper(array_to_string(class_types, '~'))"
MISM = f"(({any_of(CUP, rules.MISMATCH_SPIRIT_CLASSES)} AND {any_of('domain', rules.MISMATCH_WINE_DOMAINS)}) OR (contains({CUP}, 'WINE') AND {any_of('domain', rules.MISMATCH_SPIRIT_DOMAINS)}))"
add("category_mismatch", f"SELECT brand_name, domain, {MISM} AS mismatch FROM dm", "brands", dm=MEMBERS)
add("rescore_stats", f"SELECT count(*) AS total_websites, count(*) FILTER ({MISM}) AS mismatches FROM dm", "brands", dm=MEMBERS)
REAS = f"""concat_ws(' • ', CASE WHEN {any_of('d', ['distillery', 'brewery', 'winery', 'spirits'])} THEN '🥃 Domain suggests alcohol industry' END, CASE WHEN {any_of('tl', ['distillery', 'brewery', 'spirits', 'whiskey', 'wine'])} THEN '🏭 Title mentions alcohol production' END,
  CASE WHEN contains(cls, 'whiskey') AND contains(sl, 'whiskey') THEN '🥃 Matches whiskey context' WHEN contains(cls, 'wine') AND contains(sl, 'wine') THEN '🍷 Matches wine context' END,
  CASE WHEN {any_of('sl', ['official', 'homepage', 'welcome to'])} THEN '🌐 Appears to be official website' END, CASE WHEN {any_of('sl', ['buy', 'shop', 'store', 'purchase'])} THEN '🛒 Commercial/retail site' END)"""
add("selection_reasons", f"SELECT page_id, coalesce(nullif({REAS}, ''), 'ℹ️ General information about brand') AS reasoning FROM wc", "web", wc=WCTX)

# --- learning ------------------------------------------------------------------------------------------
TOUCH = f"""SELECT ts, CASE WHEN user_action = 'verified' THEN 1 ELSE 0 END AS ok, 'exact_brand_match' AS pattern_type, replace(lower(brand_name), ' ', '') AS pattern FROM feedback WHERE contains(domain, replace(lower(brand_name), ' ', ''))
  UNION ALL SELECT ts, ok, 'brand_word_match', w FROM (SELECT ts, domain, CASE WHEN user_action = 'verified' THEN 1 ELSE 0 END AS ok, unnest(string_split(lower(brand_name), ' ')) AS w FROM feedback) WHERE length(w) > 3 AND contains(domain, w)
  UNION ALL SELECT ts, CASE WHEN user_action = 'verified' THEN 1 ELSE 0 END, 'industry_keyword', w FROM feedback, (SELECT unnest([{q(rules.INDUSTRY_KEYWORDS)}]) AS w) WHERE contains(domain, w)"""
DPAT = """SELECT *, CASE WHEN sample_count >= 3 THEN greatest(0.0, (success_rate - 0.5) * 0.4) ELSE 0.0 END::DOUBLE AS confidence_boost FROM (
  SELECT pattern_type, pattern, count(*) AS sample_count, sum(ok) / count(*) AS success_rate, max(ts) AS last_updated FROM touch GROUP BY 1, 2)"""
LSTEPS = dict(touch=TOUCH, dp=DPAT)
add("domain_patterns", "SELECT pattern_type, pattern, sample_count, round(success_rate, 6) AS success_rate, round(confidence_boost, 6) AS confidence_boost, last_updated FROM dp", "feedback", **LSTEPS)
CHARS = "list_distinct(list_filter(string_split({x}, ''), lambda c: c <> ''))"
B1, D1 = CHARS.format(x="replace(lower(brand_name), ' ', '')"), CHARS.format(x="replace(replace(lower(domain), '.', ''), '-', '')")
add("discovered_patterns", f"""SELECT pattern_type, pattern, min(ts) AS last_updated, 1.0::DOUBLE AS success_rate, 0.1::DOUBLE AS confidence_boost, 1::INTEGER AS sample_count FROM (
  SELECT ts, 'high_char_overlap' AS pattern_type, 'overlap_' || floor(o * 100 + 1e-9)::BIGINT AS pattern FROM (SELECT ts, len(list_intersect({B1}, {D1})) / greatest(len({B1}), 1) AS o FROM feedback WHERE user_action = 'verified') WHERE o > 0.6
  UNION ALL SELECT ts, 'numeric_match', regexp_extract(brand_name, '[0-9]+') FROM feedback WHERE user_action = 'verified' AND {NUM.format(d='domain')}) GROUP BY 1, 2""", "feedback")
CBIN = "CASE WHEN c < 0.2 THEN 0 WHEN c < 0.4 THEN 1 WHEN c < 0.6 THEN 2 WHEN c < 0.8 THEN 3 ELSE 4 END"
CAL = f"""SELECT *, CASE WHEN n >= 5 THEN least(1.5, greatest(0.5, verified / n / greatest((bin * 2 + 1) / 10.0, 0.1))) ELSE 1.0 END::DOUBLE AS factor FROM (
  SELECT {CBIN} AS bin, count(*) AS n, count(*) FILTER (user_action = 'verified') AS verified FROM (SELECT *, confidence_predicted AS c FROM feedback WHERE confidence_predicted >= 0 AND confidence_predicted < 1) GROUP BY 1)"""
add("calibration", "SELECT bin, n, verified, round(factor, 6) AS factor FROM cal", "feedback", cal=CAL)
BOOST = "SELECT domain, sum(confidence_boost) AS boost FROM (SELECT DISTINCT domain FROM {s}), dp WHERE sample_count >= 3 AND contains(lower(domain), pattern) GROUP BY 1"
ENH = f"""SELECT f.*, least(1.0, c + coalesce(boost, 0)) * coalesce(factor, 1.0) AS enhanced FROM (SELECT *, {CBIN} AS bin0 FROM {{s}}) f LEFT JOIN bo USING (domain) LEFT JOIN cal ON bin = bin0 AND c >= 0 AND c < 1"""
FB = "SELECT *, confidence_predicted AS c FROM feedback"
add("enhanced_confidence", "SELECT event_id, round(enhanced, 6)::DOUBLE AS enhanced_confidence FROM en", "feedback", **LSTEPS, cal=CAL, fb=FB, bo=BOOST.format(s="fb"), en=ENH.format(s="fb"))
SITES = "SELECT *, coalesce(confidence, 0.5) AS c FROM dm"
add("rescore", f"""SELECT brand_name, domain, round(c, 2)::DOUBLE AS old_confidence, round(nc, 2)::DOUBLE AS new_confidence, round(nc - c, 2)::DOUBLE AS change, mm AS category_mismatch, mm AS needs_review FROM (
  SELECT *, greatest(0.1, enhanced - CASE WHEN mm THEN 0.3 ELSE 0 END) AS nc FROM (SELECT *, {MISM} AS mm FROM en)) WHERE abs(nc - c) > 0.05""", "brands", "feedback", **LSTEPS, cal=CAL, dm=MEMBERS, st=SITES, bo=BOOST.format(s="st"), en=ENH.format(s="st"))
add("biggest_rescores", f"SELECT brand_name, old_confidence, new_confidence, change FROM ({BODY['rescore']}) ORDER BY abs(change) DESC, brand_name LIMIT 50", "brands", "feedback", **LSTEPS, cal=CAL, dm=MEMBERS, st=SITES, bo=BOOST.format(s="st"), en=ENH.format(s="st"))
FEATP = "SELECT event_id, ts, user_action, event_id % 3 + 1 AS rk, pattern_type, pattern FROM (" + " UNION ALL ".join(
    f"SELECT event_id, ts, user_action, '{c}' AS pattern_type, 'true' AS pattern FROM uf WHERE {c}" for c in [*UCOLS, "is_marketplace", "is_wiki"]) + " UNION ALL SELECT event_id, ts, user_action, 'tld', lower(tld) FROM uf)"
add("selection_boosts", """SELECT pattern_type, pattern, count(*) AS sample_count, round(least(0.3, arg_min(start, (ts, event_id)) + sum(step) - arg_min(step, (ts, event_id))), 6)::DOUBLE AS confidence_boost FROM (
  SELECT *, CASE WHEN rk = 1 THEN 0.05 WHEN rk = 2 THEN 0.03 ELSE 0.01 END AS step, CASE WHEN rk = 1 THEN 0.1 ELSE 0.05 END AS start FROM fp WHERE user_action = 'verified') GROUP BY 1, 2""", "feedback", uf=UFEAT, fp=FEATP)
add("rejection_boosts", """SELECT 'negative_' || pattern_type AS pattern_type, pattern, count(*) AS sample_count, round(greatest(-0.2, -0.1 - (count(*) - 1) * 0.02), 6)::DOUBLE AS confidence_boost FROM fp WHERE user_action = 'rejected' GROUP BY 1, 2""", "feedback", uf=UFEAT, fp=FEATP)
add("selection_events", """SELECT CASE WHEN s = 0 THEN 'multi_choice_rejection_all' WHEN s = i THEN 'multi_choice_selection' ELSE 'multi_choice_rejection' END AS event_type,
  CASE WHEN s = 0 THEN 'rejected_all' WHEN s = i THEN 'selected' ELSE 'not_selected' END AS user_action, i::INTEGER AS option_rank, count(*) AS n FROM (SELECT event_id % 4 AS s FROM events), range(1, 4) r(i) GROUP BY 1, 2, 3""")
RUNS = """SELECT brand_name, ts, event_id, confidence_predicted AS quality, CASE WHEN event_id % 2 = 0 THEN 'exact' ELSE 'domain' END AS strategy, CASE WHEN event_id % 2 = 0 THEN 'exact' ELSE 'domain' END || ':has_numbers:' ||
   CASE k % 3 WHEN 0 THEN 'wine' WHEN 1 THEN 'spirits' ELSE 'beer' END AS strategy_key FROM feedback WHERE user_action = 'verified'"""
add("strategy_patterns", "SELECT strategy_key, any_value(strategy) AS strategy, count(*) AS sample_count, 1.0::DOUBLE AS success_rate, round(avg(quality), 6) AS average_confidence FROM ru GROUP BY 1", "feedback", ru=RUNS)
add("strategy_examples", """SELECT strategy_key, brand_name, rn::INTEGER AS recency FROM (SELECT *, row_number() OVER (PARTITION BY strategy_key ORDER BY seen DESC, brand_name DESC) AS rn FROM (
   SELECT strategy_key, brand_name, min(ts) AS seen FROM ru GROUP BY 1, 2)) WHERE rn <= 5""", "feedback", ru=RUNS)
add("feedback_insights", """SELECT count(*) AS total_events, count(*) FILTER (user_action = 'verified') AS verified, count(*) FILTER (user_action = 'rejected') AS rejected, count(*) FILTER (user_action = 'flagged') AS flagged,
  round(count(*) FILTER (user_action = 'verified') / count(*) * 100, 2) AS success_rate, round(avg(confidence_predicted) FILTER (confidence_predicted <> 0), 4) AS average_confidence,
  count(*) FILTER (ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS recent_activity FROM feedback""", "feedback")
add("top_patterns", "SELECT pattern_type, pattern, sample_count, round(success_rate, 6) AS success_rate FROM dp WHERE sample_count >= 3 ORDER BY success_rate DESC, sample_count DESC, pattern_type, pattern LIMIT 5", "feedback", **LSTEPS)
add("patterns_by_type", """SELECT pattern_type, patterns, position::INTEGER AS position, pattern, sample_count FROM (SELECT *, count(*) OVER (PARTITION BY pattern_type) AS patterns,
  row_number() OVER (PARTITION BY pattern_type ORDER BY sample_count DESC, pattern) AS position FROM dp) WHERE position <= 3""", "feedback", **LSTEPS)
add("knowledge_domains", f"SELECT domain, count(*) AS rejections FROM feedback WHERE user_action = 'rejected' AND domain NOT IN ({q(rules.FALSE_POSITIVE_DOMAINS)}) GROUP BY 1", "feedback")
add("brand_interactions", "SELECT brand_name, count(*) FILTER (user_action = 'verified') AS selections, count(*) FILTER (user_action <> 'verified') AS rejections, max(ts) AS last_interaction FROM feedback GROUP BY 1", "feedback")
add("manual_split", "SELECT CASE WHEN k % 5 = 0 THEN 'manual' ELSE 'automatic' END AS origin, CASE WHEN k % 5 = 0 THEN 'user' || (event_id % 3) END AS source, count(*) AS events FROM feedback GROUP BY 1, 2", "feedback")

# --- request log -----------------------------------------------------------------------------------
TRAIL = "count(*) OVER (PARTITION BY service ORDER BY epoch_us(ts) RANGE BETWEEN {n} PRECEDING AND CURRENT ROW)"
BRIDGE = "SELECT bp.brand_name, bp.permit_no FROM brand_permits bp JOIN importers i ON bp.permit_no = i.permit_number"
add("named_exports", """SELECT 'brands_with_importers' AS export, brand_name AS key, NULL::BIGINT AS amount FROM names WHERE brand_name IN (SELECT brand_name FROM br)
  UNION ALL SELECT 'brands_without_importers', brand_name, NULL FROM names WHERE brand_name NOT IN (SELECT brand_name FROM br) UNION ALL SELECT 'brands_with_skus', brand_name, count(*) FROM skus GROUP BY 2
  UNION ALL SELECT 'unmatched', ttb_id, NULL FROM skus WHERE permit_no NOT IN (SELECT permit_no FROM br) UNION ALL SELECT 'importers', permit_number, NULL FROM importers
  UNION ALL SELECT 'active_importers', permit_number, NULL FROM importers WHERE permit_number IN (SELECT permit_no FROM br) UNION ALL SELECT 'importer_rankings', permit_no, count(*) FROM br GROUP BY 2""", "brand_permits", "importers", "names", "skus", br=BRIDGE)
add("filtered_export", "SELECT brand_name, sku_count, array_to_string(countries, ', ') AS countries FROM brands WHERE sku_count BETWEEN 2 AND 9999 AND NOT has_document AND brand_name IN (SELECT brand_name FROM br)", "brands", "brand_permits", "importers", br=BRIDGE)
add("export_learning_summary", """SELECT unnest(['Total Learning Events', 'Verified Count', 'Rejected Count', 'Flagged Count', 'Success Rate (%)', 'Average Confidence', 'Domain Patterns', 'Strategy Patterns']) AS Metric,
  unnest([n, v, j, f, round(v / n * 100, 2), round(c, 3), (SELECT count(*) FROM dp), (SELECT count(DISTINCT strategy_key) FROM ru)]::DOUBLE[]) AS Value
  FROM (SELECT count(*) AS n, count(*) FILTER (user_action = 'verified') AS v, count(*) FILTER (user_action = 'rejected') AS j, count(*) FILTER (user_action = 'flagged') AS f, avg(confidence_predicted) FILTER (confidence_predicted <> 0) AS c FROM feedback)""", "feedback", ru=RUNS, **LSTEPS)
add("export_learning_strategies", """SELECT strategy, success_rate, average_confidence, sample_count, examples FROM (SELECT strategy_key, any_value(strategy) AS strategy, count(*) AS sample_count, 1.0::DOUBLE AS success_rate, round(avg(quality), 3) AS average_confidence FROM ru GROUP BY 1)
  JOIN (SELECT strategy_key, string_agg(brand_name, ', ' ORDER BY rn DESC) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY strategy_key ORDER BY seen DESC, brand_name DESC) AS rn FROM (
    SELECT strategy_key, brand_name, min(ts) AS seen FROM ru GROUP BY 1, 2)) WHERE rn <= 5 GROUP BY 1) USING (strategy_key)""", "feedback", ru=RUNS)
add("trailing_hour_count", f"SELECT event_id, service, {TRAIL.format(n=3599999999)} AS last_hour FROM requests", "requests")
add("burst_flag", f"""SELECT *, last_hour >= 5 AS over_limit, last_five_minutes >= 2 AS burst FROM (SELECT event_id, {TRAIL.format(n=3599999999)} AS last_hour, {TRAIL.format(n=299999999)} AS last_five_minutes FROM requests)""", "requests")
ISL = "SELECT *, sum(ok::INTEGER) OVER (PARTITION BY service ORDER BY ts, event_id) AS isl FROM requests"
STREAK = "SELECT *, sum((NOT ok)::INTEGER) OVER (PARTITION BY service, isl ORDER BY ts, event_id) AS streak FROM il"
add("failure_streak", "SELECT event_id, service, streak::BIGINT AS failure_streak FROM sk", "requests", il=ISL, sk=STREAK)
add("session_metrics", """SELECT service, count(*) AS total, count(*) FILTER (ok) AS successful, round(count(*) FILTER (ok) / count(*) * 100, 2) AS success_rate, round(avg(latency), 4) AS avg_latency,
  last(streak ORDER BY ts, event_id)::BIGINT AS failure_streak FROM sk GROUP BY 1""", "requests", il=ISL, sk=STREAK)
add("session_metrics_stream", BODY["session_metrics"], "requests", il=ISL, sk=STREAK)
add("retention", "SELECT event_id, service, ok FROM requests WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR", "requests")
add("cached_results", "SELECT brand_name AS query, n AS results FROM brands WHERE updated_at > DATE '2002-01-01' - INTERVAL 60 DAY", "brands")

# --- people and companies ---------------------------------------------------------------------------
RELEV = "([100, 90, 85, 80, 70, 75, 75, 50])[c_custkey % 8 + 1]"
add("contact_relevance", f"SELECT c_custkey AS contact_id, {RELEV}::INTEGER AS relevance_score, {RELEV} >= 80 AS is_decision_maker FROM customer")
add("contact_top", f"""SELECT company_id, contact_id, s::INTEGER AS relevance_score, position::INTEGER AS position FROM (SELECT c_nationkey AS company_id, c_custkey AS contact_id, {RELEV} AS s,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY {RELEV} DESC, c_custkey) AS position FROM customer) WHERE position <= 10""")
NDOM = f"SELECT brand_name, {DOM.format(u='url')} AS domain FROM names WHERE url IS NOT NULL"
add("company_match_domain", """SELECT brand_name, domain, md5(domain) AS company_id, 'auto_completed' AS status, 100::INTEGER AS match_confidence FROM nd""", "names", nd=NDOM)
add("enrichment_confidence", """SELECT event_id, round(least(1.0, CASE WHEN k % 3 > 0 THEN 0.3 ELSE 0 END + CASE WHEN k % 3 > 1 THEN 0.1 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN k % 4 > 0 THEN 0.2 ELSE 0 END
  + CASE WHEN k % 5 > 0 THEN 0.3 ELSE 0 END + CASE WHEN k % 5 > 0 AND k % 2 > 0 THEN 0.1 ELSE 0 END), 2)::DOUBLE AS confidence FROM feedback""", "feedback")
FIRSTTITLE = "CASE " + " ".join(f"WHEN contains(lower(text), '{t}') THEN '{t.title()}'" for t in rules.EXECUTIVE_TITLES) + " ELSE 'Executive' END"
add("executive_titles", f"SELECT {FIRSTTITLE} AS title, count(*) AS documents FROM documents GROUP BY 1")
# --- folds and reports -----------------------------------------------------------------------------
FOLD = """SELECT 'p' || (k % 20) AS pattern, count(*) FILTER (user_action = 'verified') AS success_count, count(*) FILTER (user_action = 'rejected') AS failure_count,
  round(list_reduce(list(CASE WHEN user_action = 'verified' THEN 0.05::DOUBLE ELSE -0.1::DOUBLE END ORDER BY ts, event_id), lambda a, x: CASE WHEN x > 0 THEN least(1.0::DOUBLE, a + x) ELSE greatest(0.1::DOUBLE, a + x) END, 0.9::DOUBLE), 6) AS confidence
  FROM feedback WHERE user_action IN ('verified', 'rejected') GROUP BY 1"""
add("pattern_fold", "SELECT * FROM fo", "feedback", fo=FOLD)
add("merge_insights", """SELECT count(*) AS patterns, count(*) FILTER (confidence > 0.8) AS high_confidence, (SELECT count(*) FROM feedback) AS feedback_events,
  (SELECT round(count(*) FILTER (user_action = 'verified') / count(*), 6) FROM feedback) AS approval_rate FROM fo""", "feedback", fo=FOLD)
BOOSTP = """SELECT CASE WHEN i % 2 = 0 THEN 'year_variation' ELSE 'special_edition' END AS pattern_type, CASE WHEN i % 3 = 0 THEN '' ELSE 'ring' END AS base, confidence * success_count / greatest(success_count + failure_count, 1) * 0.1 AS gain
  FROM (SELECT *, pattern[2:]::INTEGER AS i FROM fo)"""
add("pattern_boost", """SELECT name_a || '~' || name_b AS pair_id, round(least(0.3, coalesce(sum(gain), 0)), 6)::DOUBLE AS boost FROM kd LEFT JOIN bp ON kind = pattern_type AND (base = '' OR contains(lower(name_a), base) OR contains(lower(name_b), base))
  WHERE kind IS NOT NULL GROUP BY 1""", "brands", "feedback", nx=NEXT, kd=KINDS, fo=FOLD, bp=BOOSTP)
STRATLIB = """SELECT strategy_key, strategy, arg_min(brand_name, (ts, brand_name)) AS b0, arg_min(k3, (ts, brand_name)) AS k3, avg(quality) AS quality FROM (SELECT r.*, CASE WHEN strategy_key LIKE '%wine' THEN 0 WHEN strategy_key LIKE '%spirits' THEN 1 ELSE 2 END AS k3 FROM ru r) GROUP BY 1, 2 HAVING count(*) >= 2"""
SAME = """((NOT s.starts_with_common_word)::INTEGER + s.has_numbers::INTEGER + (s.word_count = len(string_split(b0, ' ')))::INTEGER + (length(s.brand_name) = length(b0))::INTEGER + (s.is_wine = (k3 = 0))::INTEGER
  + (s.is_spirits = (k3 = 1))::INTEGER + (s.is_beer = (k3 = 2))::INTEGER + 1 + (NOT s.is_us_brand)::INTEGER) / 9"""
add("recommended_strategy", f"""SELECT brand_name, strategy, strategy_key, round(v, 6) AS value FROM (SELECT b.brand_name, x.strategy, x.strategy_key, x.v, row_number() OVER (PARTITION BY b.brand_name ORDER BY x.v DESC NULLS LAST, x.strategy DESC, x.strategy_key DESC) AS rn
  FROM sf b LEFT JOIN (SELECT s.brand_name, l.strategy, l.strategy_key, quality * {SAME} AS v FROM sf s, sl l WHERE {SAME} > 0.5) x ON x.brand_name = b.brand_name) WHERE rn = 1""", "brands", "feedback", sf=STRAT, ru=RUNS, sl=STRATLIB)


def unpivot(section: str, sql: str, columns, label: str = "''") -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {label} AS name, '{c}' AS metric, {c}::DOUBLE AS value FROM {sql}" for c in columns)


REPORT_PARTS = [
    unpivot("overview", "ov", ["total_brands", "brands_with_websites", "total_skus", "avg_skus_per_brand", "total_importers", "active_importers", "enrichment_rate"]),
    unpivot("geographic", "g", ["n"], "name"),
    unpivot("domestic", "ds", ["domestic", "international", "domestic_percentage", "international_percentage"]),
    unpivot("product", "c", ["n"], "name"),
    unpivot("category", "cr", ["n"], "category"),
    unpivot("sku_distribution", "sh", ["brand_count"], "range_name"),
    unpivot("importer", "ih", ["importer_count"], "range_name"),
    unpivot("concentration", "hh", ["herfindahl_index", "concentration_ratio_cr4", "concentration_ratio_cr8"]),
    unpivot("growth", "gr", ["average", "maximum", "minimum"], "subject"),
    unpivot("coverage", "cv", ["total_brands", "enriched_brands", "brands_with_websites", "verified_websites", "enrichment_rate", "website_rate", "verification_rate"]),
    unpivot("top", "tb", ["n"], "brand_name"),
    unpivot("permit_types", "pty", ["n"], "type"),
]

add("market_report", " UNION ALL ".join(REPORT_PARTS), "names", "importers", "brand_permits", bridge=BRIDGE, ic=IMPCOUNT, p=PAIRS, g=GEO, c=CLASSES,
    ov=BODY["overview"], ds=BODY["domestic_split"], cr=BODY["category_rollup"], sh=BODY["sku_histogram"], ih=BODY["importer_histogram"], hh=BODY["hhi_cr"], gr=BODY["growth"],
    cv=BODY["coverage"], tb=BODY["top_brands"], pty=BODY["permit_types"])
