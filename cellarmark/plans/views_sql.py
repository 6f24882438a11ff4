"""The registry tables of ``registry.py`` once more, as ANSI SQL common table expressions.

Written for the DuckDB side of the comparison; nothing in the package reads it at run time.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "holders": ((), """
        SELECT s_suppkey, permit_no, owner_name, operating_name, city, state, origin_desc FROM (
        SELECT s_suppkey, st AS state,
          CASE s_suppkey % 4 WHEN 0 THEN st || '-I-' || (10000 + s_suppkey)
                             WHEN 1 THEN 'DSP-' || st || '-' || (10000 + s_suppkey)
                             WHEN 2 THEN 'BWN-' || st || '-' || (10000 + s_suppkey)
                             ELSE 'BR-' || st || '-' || (10000 + s_suppkey) END AS permit_no,
          CASE WHEN s_suppkey % 17 = 0 THEN 'PARKSTREET IMPORTS ' || s_suppkey
               WHEN s_suppkey % 3 = 1 THEN (['RING','WIDGET','BOLT','GEAR','ANVIL','PLATE','ROD','GIZMO'])[s_suppkey % 8 + 1] || ' SUPPLIER ' || s_suppkey
               ELSE 'SUPPLIER ' || s_suppkey END AS owner_name,
          CASE WHEN s_suppkey % 5 = 0 THEN 'nan' ELSE n_name || ' TRADING' END AS operating_name,
          'CITY ' || (s_suppkey % 30) AS city,
          CASE n_nationkey WHEN 0 THEN 'CALIFORNIA' WHEN 1 THEN 'UNITED STATES' WHEN 5 THEN 'TEXAS' WHEN 6 THEN 'Kentucky' ELSE n_name END AS origin_desc
        FROM (SELECT *, (['CA','NY','TX','KY','OR'])[n_regionkey + 1] AS st FROM supplier JOIN nation ON s_nationkey = n_nationkey))"""),
    "importers": (("holders",), """
        SELECT permit_no AS permit_number, owner_name, operating_name, city, state FROM holders
        WHERE s_suppkey % 4 = 0 AND s_suppkey % 20 <> 0"""),
    "spirits": (("holders",), """
        SELECT CASE WHEN s_suppkey % 3 = 0 THEN state || '-S-' || (10000 + s_suppkey) ELSE permit_no END AS permit_number,
               owner_name, operating_name, city, state FROM holders
        WHERE s_suppkey % 4 = 1 AND s_suppkey % 5 <> 2"""),
    "wines": (("holders",), """
        SELECT CASE WHEN s_suppkey % 3 = 0 THEN state || '-W-' || (10000 + s_suppkey) ELSE permit_no END AS permit_number,
               owner_name, operating_name, city, state FROM holders
        WHERE s_suppkey % 4 = 2 AND s_suppkey % 5 <> 3"""),
    "skus": (("holders",), """
        SELECT l_orderkey || '-' || l_linenumber AS ttb_id, permit_no, brand_name, fanciful_name, class_type_desc, origin_desc,
               CASE WHEN l_linenumber = 7 AND l_quantity < 5 THEN '' ELSE strftime(l_shipdate, '%-m/%-d/%Y') END AS completed_date,
               CAST(l_shipdate AS DATE) AS filed, l_shipdate, l_partkey, l_suppkey, l_quantity
        FROM lineitem
        JOIN (SELECT p_partkey,
                upper(p_name) || CASE WHEN p_partkey // 5000 > 0 THEN ' ' || (p_partkey // 5000) ELSE '' END
                || ([' DISTILLERY ',' WINERY ',' BREWING ',' RESERVE 20',' SPIRITS ',' ',' CALIFORNIA ',' SELECT '])[p_size % 8 + 1]
                || CASE WHEN p_size % 8 = 3 THEN lpad(replace(p_brand, 'Brand#', ''), 2, '0') ELSE replace(p_brand, 'Brand#', '') END AS brand_name,
                CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name END AS fanciful_name,
                CASE p_type WHEN 'STANDARD' THEN 'TABLE RED WINE' WHEN 'ECONOMY' THEN 'MALT BEVERAGES SPECIALTIES'
                            WHEN 'MEDIUM' THEN 'STRAIGHT BOURBON WHISKY' WHEN 'PROMO' THEN 'VODKA'
                            WHEN 'LARGE' THEN 'SINGLE MALT SCOTCH WHISKY' WHEN 'SMALL' THEN 'COFFEE LIQUEUR' END AS class_type_desc
              FROM part) ON l_partkey = p_partkey
        JOIN (SELECT s_suppkey, permit_no, origin_desc FROM holders) ON l_suppkey = s_suppkey"""),
    "names": (("skus",), """
        SELECT brand_name, n, url AS true_url,
               CASE WHEN n % 3 = 0 OR n % 13 = 5 THEN NULL ELSE url END AS url,
               CASE WHEN n % 3 = 0 OR n % 13 = 5 THEN NULL ELSE CAST('0.' || (3 + n % 7) AS DOUBLE) END AS confidence,
               n % 3 <> 0 AND n % 13 <> 5 AND n % 5 = 1 AS verified,
               n % 3 <> 0 AND n % 13 <> 5 AND n % 6 = 2 AS needs_review,
               n % 3 <> 0 AS has_document,
               n % 3 <> 0 AND n % 13 <> 5 AND n % 2 = 0 AS nested,
               n % 3 = 0 AND (n % 5 = 0 OR n % 2 = 0) AS has_legacy,
               n % 3 = 0 AND n % 5 = 0 AS legacy_verified,
               CASE WHEN n % 3 = 0 AND (n % 5 = 0 OR n % 2 = 0) THEN 'https://legacy.' || key || '.com' END AS legacy_url
        FROM (SELECT brand_name, n, key,
                CASE n % 4 WHEN 0 THEN 'https://www.' || key || '.com/' WHEN 1 THEN 'http://' || key || 'wines.com/about'
                           WHEN 2 THEN 'https://shop.' || key || '.com' ELSE 'https://' || w2 || 'spirits.com/x' END AS url
              FROM (SELECT brand_name, CAST(regexp_extract(brand_name, '([0-9]+)$', 1) AS INTEGER) AS n,
                      lower(split_part(brand_name, ' ', 1)) || lower(split_part(brand_name, ' ', 2)) AS key,
                      lower(split_part(brand_name, ' ', 2)) AS w2
                    FROM (SELECT DISTINCT brand_name FROM skus)))"""),
    "brands": (("skus", "names"), """
        SELECT * FROM (SELECT brand_name, count(*) AS sku_count, min(filed) AS created_date, max(filed) AS updated_at,
                 list_sort(list(DISTINCT permit_no)) AS permit_numbers, list_sort(list(DISTINCT origin_desc)) AS countries,
                 list_sort(list(DISTINCT class_type_desc)) AS class_types
               FROM skus GROUP BY brand_name) JOIN names USING (brand_name)"""),
    "brand_permits": (("skus",), "SELECT DISTINCT brand_name, permit_no FROM skus"),
    "masters": (("importers", "spirits", "wines"), """
        SELECT permit_number, arg_min(owner_name, prio) AS owner_name, arg_min(operating_name, prio) AS operating_name,
               arg_min(kind, prio) AS kind FROM (
          SELECT *, 1 AS prio, 'importer' AS kind FROM importers UNION ALL
          SELECT *, 2, 'spirit_producer' FROM spirits UNION ALL SELECT *, 3, 'wine_producer' FROM wines)
        GROUP BY permit_number"""),
    "feedback": ((), """
        SELECT event_id, ts, 'user_feedback' AS event_type, noun || ' SPIRITS ' || (user_id % 40) AS brand_name,
               lower(noun) || CASE WHEN event_id % 3 = 0 THEN 'spirits' || (user_id % 40)
                                   ELSE (['distillery','wines','brewing',''])[event_id % 4 + 1] END || '.com' AS domain,
               least(value / 100, 1.0) AS confidence_predicted,
               CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'flagged' ELSE 'not_selected' END AS user_action,
               CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
        FROM (SELECT *, (['RING','WIDGET','BOLT','GEAR','ANVIL','PLATE','ROD','GIZMO'])[user_id % 8 + 1] AS noun FROM events)"""),
    "requests": ((), "SELECT event_id, ts, user_id AS service, event_type <> 'error' AS ok, value AS latency FROM events"),
    "web": ((), r"""
        SELECT page_id, upper(replace(regexp_extract(host, '([a-z0-9-]+)\.example\.', 1), '-', ' ')) AS brand_name, url, host AS domain,
               trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
               trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS snippet
        FROM (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)"""),
}


def with_views(sql: str, *names: str, **extra: str) -> str:
    """Prefix a query with the views it needs, in dependency order, then its own named steps."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + sql
