"""Brand resolution: pair scores, domain groups, proposals, approval and execution."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarmark import rules
from cellarmark.functions import names as N
from cellarmark.functions import web
from cellarmark.functions.candidates import near_places
from cellarmark.functions.columns import jaccard_or_half, join_present
from cellarmark.functions.similarity import (
    digit_free,
    levenshtein_similarity,
    ratcliff_ratio,
    ratio_totals,
)
from cellarmark.operators.clustering import default_order, greedy_clusters, name_blocks
from cellarmark.operators.contacts import name_candidates
from cellarmark.session import cut_lineage


# --- pair scores ------------------------------------------------------------------------------------
def _host_similarity(a: Column, b: Column) -> Column:
    """Domain similarity of two already extracted hosts."""
    last_two = lambda d: F.substring_index(d, ".", -2)
    return F.when(a == b, 1.0).when(last_two(a) == last_two(b), 0.8).when(a.isNotNull() & b.isNotNull(), 0.0)


def pair_confidence(similarity: Column, domains: tuple[Column, Column], places: tuple[Column, Column], kinds: tuple[Column, Column]) -> Column:
    """Weighted mean of name .4, domain .3 (when both have one), location .15, class types .15."""
    both = domains[0].isNotNull() & domains[1].isNotNull()
    score = similarity * 0.4 + jaccard_or_half(*places) * 0.15 + jaccard_or_half(*kinds) * 0.15
    score = score + F.coalesce(_host_similarity(*domains), F.lit(0.0)) * 0.3
    return score / F.when(both, 1.0).otherwise(0.7)


def _boosted(measure: Column, up_a: Column, up_b: Column) -> Column:
    """At least 0.8 when one upper-cased name contains the other."""
    contained = up_a.contains(up_b) | up_b.contains(up_a)
    return F.greatest(measure, F.when(contained, 0.8).otherwise(0.0))


def _texts(rows: pd.DataFrame, column: str) -> list[str]:
    return [x or "" for x in rows[column]]


def _shared(xs: pd.Series, ys: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many values each two lists share, and the lists' sizes (as a column and a row); a list repeats no value."""
    xs, ys = ([[] if v is None else list(v) for v in side] for side in (xs, ys))
    codes = {v: n for n, v in enumerate({v for x in xs for v in x}.intersection(v for y in ys for v in y))}

    def held(side: list[list]) -> np.ndarray:
        out = np.zeros((len(side), len(codes)), np.float32)
        at = [(n, codes[v]) for n, values in enumerate(side) for v in values if v in codes]
        if at:
            out[tuple(np.array(at).T)] = 1
        return out

    size = lambda side: np.array([len(v) for v in side], np.int64)
    return (held(xs) @ held(ys).T).astype(np.int64), size(xs)[:, None], size(ys)[None, :]


def _jaccard_or_half(xs: pd.Series, ys: pd.Series) -> np.ndarray:
    both, m, k = _shared(xs, ys)
    return np.where((m > 0) & (k > 0), both / np.maximum(m + k - both, 1), 0.5)


def _equal(xs: pd.Series, ys: pd.Series) -> np.ndarray:
    """Whether two values are present and equal, for each pair."""
    codes, _ = pd.factorize(pd.concat([xs, ys], ignore_index=True))
    x, y = codes[: len(xs), None], codes[None, len(xs) :]
    return (x == y) & (x >= 0)


def similar_brand_clusters(brands: DataFrame, method: str = "ratio", threshold: float = 0.7, **options) -> DataFrame:
    """Greedy clusters of brands that share a significant word and score at least the threshold.

    ``brands``: brand_name, url, countries, class_types.
    """
    name = F.col("brand_name")
    nodes = brands.select(
        name.alias("name"), name.alias("ord"), F.upper(name).alias("up"), F.length(N.normalize_name(name)).alias("norm_length"),
        web.domain_of(F.col("url")).alias("domain"), "countries", "class_types",
    )
    blocks = name_blocks(nodes, N.significant_words(F.col("name")))
    exact = ratcliff_ratio if method == "ratio" else levenshtein_similarity

    def confidence(a, b, measure) -> Column:
        sim = _boosted(measure(a("up"), b("up")), a("up"), b("up"))
        return pair_confidence(sim, (a("domain"), b("domain")), (a("countries"), b("countries")), (a("class_types"), b("class_types")))

    def possible(a, b):
        la, lb = a("norm_length"), b("norm_length")
        return F.abs(la - lb) <= F.greatest(la, lb) * F.lit(0.6)

    def gate(leaders: pd.DataFrame, later: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        # the name must supply what domain, places and class types leave open
        x, y = leaders["domain"], later["domain"]
        same, both = _equal(x, y), x.notna().to_numpy()[:, None] & y.notna().to_numpy()[None, :]
        tail = lambda d: d.str.split(".").str[-2:].str.join(".")
        host = np.where(same, 1.0, np.where(_equal(tail(x), tail(y)), 0.8, 0.0))
        rest = sum(_jaccard_or_half(leaders[c], later[c]) for c in ("countries", "class_types")) * 0.15
        least = (threshold * np.where(both, 1.0, 0.7) - rest - host * 0.3) / 0.4
        return near_places(_texts(leaders, "up"), _texts(later, "up"), least - 1e-9, 0.8)

    gated = (gate, ["up", "domain", "countries", "class_types"])
    return greedy_clusters(nodes, blocks, possible, lambda a, b: confidence(a, b, exact), threshold, gate=gated, **options)


def fuzzy_name_clusters(brands: DataFrame, method: str = "ratio", threshold: float = 0.8, **options) -> DataFrame:
    """Name-only clusters above the threshold, for brands outside the domain groups."""
    nodes = brands.select(F.col("brand_name").alias("name"), F.upper(F.trim("brand_name")).alias("up")).withColumn("ord", default_order())
    exact = ratcliff_ratio if method == "ratio" else levenshtein_similarity

    def gate(leaders: pd.DataFrame, later: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        # either similarity is at most 2 * common characters in order / both lengths
        return near_places(_texts(leaders, "up"), _texts(later, "up"), threshold)

    return greedy_clusters(
        nodes, None, lambda a, b: F.lit(True), lambda a, b: exact(a("up"), b("up")), threshold, strict=True, gate=(gate, ["up"]), **options
    )


# --- rule cascades ----------------------------------------------------------------------------------
def cascade_features(brands: DataFrame, attributed: DataFrame) -> DataFrame:
    """Per-brand features of the rule cascades, computed once and joined: white label, core, producers."""
    own = attributed.groupBy("brand_name").agg(
        F.array_sort(F.collect_set("permit_no")).alias("producers"),
        F.array_sort(F.collect_set(F.when(F.col("relationship") == "primary_producer", F.col("permit_no")))).alias("primary"),
        F.min_by("owner_name", "permit_no").alias("first_producer"),
        F.max(F.arrays_overlap(F.split(F.upper("brand_name"), " "), F.split(F.upper("owner_name"), " "))).alias("named"),
    )
    name = F.col("brand_name")
    none = F.array().cast("array<string>")
    return brands.select("brand_name", "class_types").join(own, "brand_name", "left").select(
        name.alias("name"),
        F.upper(name).alias("up"),
        "class_types",
        F.coalesce("producers", none).alias("producers"),
        F.coalesce("primary", none).alias("primary"),
        F.upper("first_producer").alias("first_producer"),
        N.is_white_label(name).alias("white_label"),
        (N.is_white_label(name) | ((F.size(F.coalesce("producers", none)) > 0) & ~F.coalesce("named", F.lit(False)))).alias("white_label_candidate"),
        N.store_brands(name).alias("stores"),
        F.upper(N.core_brand(name)).alias("core"),
    )


def _different_owners(a, b, flag: str) -> Column:
    both = a(flag) & b(flag) & ~F.arrays_overlap(a("stores"), b("stores"))
    return (a(flag) != b(flag)) | both


def family_confidence(core_a: Column, core_b: Column, ratio: Column, same_producer: Column) -> Column:
    """Brand-family confidence; 0 when the names are not a family."""
    known = (core_a != "") & (core_b != "")
    return F.when(
        known,
        F.when(core_a == core_b, 0.95)
        .when(core_a.contains(core_b) | core_b.contains(core_a), 0.85)
        .when(ratio > 0.8, ratio)
        .when(same_producer & (ratio > 0.6), ratio + 0.2)
        .otherwise(0.0),
    ).otherwise(0.0)


def cascade_score(a, b, core_ratio: Column, name_ratio: Column) -> Column:
    """Matcher cascade: owners differ, same producer, same core, family, name with class; else 0."""
    same_maker = F.arrays_overlap(a("producers"), b("producers"))
    same_first = F.coalesce(a("first_producer") == b("first_producer"), F.lit(False))
    family = family_confidence(a("core"), b("core"), core_ratio, same_first)
    return (
        F.when(_different_owners(a, b, "white_label"), 0.0)
        .when(same_maker & (core_ratio > 0.7), rules.CONFIDENCE_SAME_PRODUCER)
        .when((a("core") != "") & (a("core") == b("core")), 0.90)
        .when(family > 0.8, family)
        .when((name_ratio > 0.85) & F.arrays_overlap(a("class_types"), b("class_types")), F.least(name_ratio + 0.1, F.lit(1.0)))
        .otherwise(0.0)
    )


def producer_cascade_score(a, b, core_ratio: Column, name_ratio: Column) -> Column:
    """Producer-aware variant: candidates instead of names decide the white-label guard."""
    same_primary = F.arrays_overlap(a("primary"), b("primary"))
    root = F.when((a("core") != "") & (b("core") != ""), core_ratio).otherwise(0.0)
    return (
        F.when(_different_owners(a, b, "white_label_candidate"), 0.0)
        .when(same_primary & (name_ratio > 0.6), rules.CONFIDENCE_SAME_PRODUCER)
        .when(root > 0.8, 0.7 + (root - 0.8) * 1.5)
        .when(name_ratio > 0.85, rules.CONFIDENCE_NAME_ONLY)
        .otherwise(0.0)
    )


def cascade_clusters(features: DataFrame, producer_aware: bool = False, method: str = "ratio", **options) -> DataFrame:
    """Greedy clusters under a rule cascade: shortest names first, or name order when producer-aware."""
    nodes = features.withColumn("ord", F.col("name") if producer_aware else default_order())
    formula = producer_cascade_score if producer_aware else cascade_score
    threshold = 0.5 if producer_aware else 0.6

    def measured(x: Column, y: Column) -> Column:
        return ratcliff_ratio(x, y) if method == "ratio" else levenshtein_similarity(x, y)

    flag = "white_label_candidate" if producer_aware else "white_label"
    makers = "primary" if producer_aware else "producers"

    def gate(leaders: pd.DataFrame, later: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        # the branches' own tests on upper bounds of the two similarities
        core, name = ((_texts(leaders, c), _texts(later, c)) for c in ("core", "up"))
        kinds = True if producer_aware else _shared(leaders["class_types"], later["class_types"])[0] > 0
        surely = [near_places(*core, 0.8, 0.8), near_places(*name, np.where(kinds, 0.85, 2.0))]
        near = near_places(*name, 0.6, 0.8) if producer_aware else near_places(*core, 0.6)
        sets = [[frozenset(v) if v is not None else frozenset() for v in side[makers]] for side in (leaders, later)]
        first = np.zeros((len(leaders), len(later)), bool) if producer_aware else _equal(leaders["first_producer"], later["first_producer"])
        found = np.zeros_like(first)
        for i, j in surely:
            found[i, j] = True
        by_maker = [(i, j) for i, j in zip(*near) if not found[i, j] and (first[i, j] or not sets[0][i].isdisjoint(sets[1][j]))]
        if by_maker:
            found[tuple(np.array(by_maker).T)] = True
        return np.nonzero(found)

    def score(a, b) -> Column:
        core = measured(a("core"), b("core"))
        core = _boosted(core, a("core"), b("core")) if producer_aware else core
        return formula(a, b, core, _boosted(measured(a("up"), b("up")), a("up"), b("up")))

    return greedy_clusters(
        nodes, None, lambda a, b: ~_different_owners(a, b, flag), score, threshold,
        gate=(gate, ["core", "up", "class_types", makers, "first_producer"]), alone=F.col(flag) & (F.size("stores") == 0), **options
    )


def cascade_canonical(clusters: DataFrame) -> DataFrame:
    """Canonical name of every cluster: the first member with the most common core brand."""
    c = clusters.withColumn("core", N.core_brand(F.col("name")))
    cores = c.filter(F.col("core") != "").groupBy("leader", "core").agg(F.count("*").alias("n"), F.min(default_order()).alias("first"))
    top = cores.groupBy("leader").agg(F.min_by("core", F.struct(-F.col("n"), F.col("first"))).alias("core"))
    return c.join(top, ["leader", "core"]).groupBy("leader").agg(F.min_by("name", default_order()).alias("canonical_name"))


def typed_similarity(a: Column, b: Column, ratio: Column, boost: Column | None = None) -> Column:
    """Variation score where a rule holds, else the ratio of the lower-cased names plus the pattern boost."""
    fuzzy = F.least(F.lit(1.0), ratio + (boost if boost is not None else F.lit(0.0)))
    return F.coalesce(N.variation_score(N.variation_type(a, b)), fuzzy)


def predicted_clusters(brands: DataFrame, adjustments: DataFrame | None = None, method: str = "ratio", threshold: float = 0.6, **options) -> DataFrame:
    """Learned prediction: typed similarity plus per-brand feedback adjustment, shortest names first.

    ``adjustments`` (brand_name, approved, rejected: ids of past groups) comes from :func:`feedback_adjustment`.
    """
    nodes = brands.select(F.col("brand_name").alias("name"))
    none = F.array().cast("array<long>")
    if adjustments is not None:
        adjustments = cut_lineage(adjustments)
        nodes = nodes.join(adjustments.withColumnRenamed("brand_name", "name"), "name", "left")
        nodes = nodes.withColumns({c: F.coalesce(c, none) for c in ("approved", "rejected")})
    else:
        nodes = nodes.withColumns({"approved": none, "rejected": none})
    nodes = nodes.withColumns({"low": F.lower(F.trim("name")), "keys": N.variation_keys(F.col("name")), "ord": default_order()})
    def build(a, b, measure):
        # every rule-based variation shares a key, so the rules run for those pairs only
        ratio = measure(a("low"), b("low"))
        typed = F.when(F.arrays_overlap(a("keys"), b("keys")), typed_similarity(a("name"), b("name"), ratio)).otherwise(ratio)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), typed + pair_adjustment(a, b)))

    exact = ratcliff_ratio if method == "ratio" else levenshtein_similarity

    def gate(leaders: pd.DataFrame, later: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        def touched(column: str) -> np.ndarray:
            both, m, k = _shared(leaders[column], later[column])
            return m + k - both

        adjustment = APPROVED_STEP * touched("approved") + REJECTED_STEP * touched("rejected")
        i, j = near_places(_texts(leaders, "low"), _texts(later, "low"), threshold - adjustment - 1e-6)
        # pairs of a common key may fall under a rule, whose score is no ratio
        holders: dict[str, list[int]] = {}
        for n, keys in enumerate(leaders["keys"]):
            for key in keys:
                holders.setdefault(key, []).append(n)
        ruled = {(n, at) for at, keys in enumerate(later["keys"]) for key in keys for n in holders.get(key, ())}.difference(zip(i.tolist(), j.tolist()))
        more = np.array(sorted(ruled), np.int64).reshape(-1, 2)
        return np.concatenate([i, more[:, 0]]), np.concatenate([j, more[:, 1]])

    gated = (gate, ["low", "keys", "approved", "rejected"])
    return greedy_clusters(nodes, None, lambda a, b: F.lit(True), lambda a, b: build(a, b, exact), threshold, gate=gated, **options)


APPROVED_STEP, REJECTED_STEP = 0.1, -0.2
CHAIN_ROUNDS = 20


def pair_adjustment(a, b) -> Column:
    """+.1 per approved and -.2 per rejected past group that touches either name, once each."""
    touched = lambda c: F.size(F.array_union(a(c), b(c)))
    return F.round(APPROVED_STEP * touched("approved") + REJECTED_STEP * touched("rejected"), 6)


def feedback_adjustment(brand_names: DataFrame, feedback: DataFrame, least_similar: float = 0.7) -> DataFrame:
    """brand_name with the ids of approved and rejected past groups that hold a similar name.

    Similar is a rule-based variation (equal variation keys) or a ratio above ``least_similar``.
    """
    members = feedback.select("feedback_id", "user_action", F.explode("brand_group").alias("member"))
    past = members.select("member").distinct()
    keyed = past.select("member", F.explode(N.variation_keys(F.col("member"))).alias("key"))
    mine = brand_names.select("brand_name", F.explode(N.variation_keys(F.col("brand_name"))).alias("key"))
    by_rule = mine.join(keyed, "key").filter(N.variation_type(F.col("brand_name"), F.col("member")).isNotNull()).select("brand_name", "member")
    near = name_candidates(brand_names.select("brand_name").distinct(), past, "brand_name", "member", least_similar)
    by_ratio = near.filter(ratcliff_ratio(F.lower(F.trim("brand_name")), F.lower(F.trim("member"))) > least_similar)
    hits = by_rule.union(by_ratio).distinct().join(members, "member").select("brand_name", "feedback_id", "user_action").distinct()

    def ids(action: str) -> Column:
        return F.collect_set(F.when(F.col("user_action") == action, F.col("feedback_id"))).alias(action)

    return hits.groupBy("brand_name").agg(ids("approved"), ids("rejected"))


# --- groups by domain ---------------------------------------------------------------------------------
def domain_members(brand_sites: DataFrame) -> DataFrame:
    """Brands with a website domain; brand_sites carries url and confidence."""
    return brand_sites.withColumn("domain", web.domain_of(F.col("url"))).filter(F.col("domain").isNotNull())


def domain_groups(members: DataFrame) -> DataFrame:
    return members.groupBy("domain").agg(F.count("*").alias("brands")).filter(F.col("brands") > 1)


def completeness(countries: Column, class_types: Column, permits: Column, importers: Column, document: Column) -> Column:
    """0.2 for each filled field."""
    filled = [F.coalesce(F.size(countries), F.lit(0)) > 0, F.coalesce(F.size(class_types), F.lit(0)) > 0, F.coalesce(F.size(permits), F.lit(0)) > 0, importers, document]
    return F.round(sum((F.when(x, 0.2).otherwise(0.0) for x in filled), F.lit(0.0)), 1)


def domain_hierarchy(members: DataFrame, measure=ratcliff_ratio) -> tuple[DataFrame, DataFrame]:
    """(proposals, proposal members) for domains shared by two or more brands.

    ``members``: brand_name, domain, confidence, completeness. SKU_TO_BRAND when some names match the
    domain and others do not, PORTFOLIO_BRANDS when none does, nothing when all do.
    """
    sim = web.domain_brand_similarity(web.domain_base(F.col("domain")), F.col("brand_name"), measure)
    m = members.withColumn("similarity", sim).withColumn("matches", F.col("similarity") > 0.7)
    conf = F.coalesce("confidence", F.lit(0.0))
    parent = F.when(F.col("matches"), F.struct((-conf).alias("c"), (-F.col("similarity")).alias("s"), F.col("brand_name").alias("n")))
    richest = F.struct((-conf).alias("c"), (-F.col("completeness")).alias("s"), F.col("brand_name").alias("n"))
    d = m.groupBy("domain").agg(
        F.count("*").alias("n"), F.count_if("matches").alias("matching"),
        F.min(parent).alias("parent"), F.min(richest).alias("richest"),
    ).filter(F.col("n") > 1)
    slug = F.replace("domain", F.lit("."), F.lit("_"))
    others = F.col("n") - F.col("matching")
    sku = (F.col("matching") > 0) & (others > 0)
    folio = F.col("matching") == 0
    proposals = d.filter(sku | folio).select(
        F.when(sku, F.concat(F.lit("sku_to_brand_"), slug, F.lit("_"), others.cast("string"), F.lit("_brands")))
        .otherwise(F.concat(F.lit("portfolio_"), slug, F.lit("_"), F.col("n").cast("string"), F.lit("_brands"))).alias("proposal_id"),
        "domain",
        F.when(sku, "SKU_TO_BRAND").otherwise("PORTFOLIO_BRANDS").alias("consolidation_type"),
        F.when(sku, F.col("parent.n")).otherwise(F.col("richest.n")).alias("canonical_name"),
        F.when(sku, 0.9).otherwise(0.75).alias("confidence"),
        F.when(sku, others).otherwise(F.col("n") - 1).alias("brands_to_merge"),
    )
    member_rows = (
        m.join(proposals.select("proposal_id", "domain", "consolidation_type", "canonical_name"), "domain")
        .filter(F.when(F.col("consolidation_type") == "SKU_TO_BRAND", ~F.col("matches")).otherwise(F.col("brand_name") != F.col("canonical_name")))
        .select("proposal_id", "brand_name")
    )
    return proposals, member_rows


def name_normalization(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals, proposal members): product-like names replaced by the company name of their domain."""
    product = N.is_product_name(F.col("brand_name"), F.col("class_types"))
    company = F.when(N.is_company_name(F.col("brand_name")), F.struct((-F.length("brand_name")).alias("l"), F.col("brand_name").alias("n")))
    d = members.groupBy("domain").agg(
        F.count("*").alias("n"), F.count_if(product).alias("products"), F.min(company).alias("best"), F.min("brand_name").alias("only")
    )
    real = F.coalesce("best.n", web.company_from_domain(F.col("domain")))
    proposals = (
        d.withColumn("suggested_name", real)
        .filter((F.col("products") > 0) & (F.col("suggested_name") != ""))
        .filter((F.col("n") > 1) | (F.upper("only") != F.upper("suggested_name")))
        .select(
            F.concat(F.lit("normalization_"), F.replace(F.lower("suggested_name"), F.lit(" "), F.lit("_"))).alias("proposal_id"),
            "domain", F.lit("normalization").alias("consolidation_type"), F.col("suggested_name").alias("canonical_name"),
            F.when(F.col("n") == 1, 0.85).otherwise(0.9).alias("confidence"), F.col("n").alias("brands_to_merge"),
        )
    )
    rows = members.join(proposals.select("proposal_id", "domain"), "domain").select("proposal_id", "brand_name")
    return proposals, rows


# --- cluster proposals -------------------------------------------------------------------------------
def similarity_proposals(clusters: DataFrame, brands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals, members) from similarity clusters: longest company-like name, mean confidence <= .95."""
    c = clusters.join(brands.select(F.col("brand_name").alias("name"), "class_types"), "name")
    product = N.is_product_name(F.col("name"), F.col("class_types"))
    rank = F.struct(product.cast("int").alias("p"), (-F.length("name")).alias("l"), (F.col("name") != F.col("leader")).alias("f"), F.col("name").alias("n"))
    g = c.groupBy("leader").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min(rank).alias("best")).filter(F.col("n") > 1)
    proposals = g.select(
        "leader", N.proposal_slug("similarity_", F.col("best.n")).alias("proposal_id"), F.lit("similarity").alias("consolidation_type"),
        F.col("best.n").alias("canonical_name"), F.least(F.col("mean"), F.lit(0.95)).alias("confidence"), (F.col("n") - 1).alias("brands_to_merge"),
    )
    rows = clusters.join(proposals.select("leader", "proposal_id", "canonical_name"), "leader").filter(F.col("name") != F.col("canonical_name"))
    return proposals.drop("leader"), rows.select("proposal_id", F.col("name").alias("brand_name"))


def fuzzy_proposals(clusters: DataFrame, brands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals, members) from name-only clusters; confidence .6 + .1 per name, kept uncapped as given.

    ``brands``: brand_name, confidence, completeness, url.
    """
    b = brands.select(F.col("brand_name").alias("name"), F.coalesce("confidence", F.lit(0.0)).alias("c"), "completeness", F.col("url").isNotNull().alias("u"))
    rank = F.struct((-F.col("c")).alias("c"), (-F.col("completeness")).alias("k"), (~F.col("u")).alias("u"), F.length("name").alias("l"), F.col("name").alias("n"))
    g = clusters.join(b, "name").groupBy("leader").agg(F.count("*").alias("n"), F.min(rank).alias("best")).filter(F.col("n") > 1)
    slug = F.lower(F.replace("best.n", F.lit(" "), F.lit("_")))
    proposals = g.select(
        "leader", F.concat(F.lit("similar_names_"), slug, F.lit("_"), F.col("n").cast("string"), F.lit("_variations")).alias("proposal_id"),
        F.lit("SIMILAR_NAMES").alias("consolidation_type"), F.col("best.n").alias("canonical_name"),
        (F.lit(0.6) + F.col("n") * 0.1).alias("confidence"), (F.col("n") - 1).alias("brands_to_merge"),
    )
    rows = clusters.join(proposals.select("leader", "proposal_id", "canonical_name"), "leader").filter(F.col("name") != F.col("canonical_name"))
    return proposals.drop("leader"), rows.select("proposal_id", F.col("name").alias("brand_name"))


def opportunities(parts: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Combined report of several proposal lists in priority order."""
    cols = ["proposal_id", "consolidation_type", "canonical_name", "confidence", "brands_to_merge"]
    tagged = [df.select(*cols, F.lit(i).alias("source_priority")) for i, df in enumerate(parts)]
    out = reduce(DataFrame.unionByName, tagged)
    if limit:
        return out.orderBy(F.desc("confidence"), F.desc("brands_to_merge"), "proposal_id").limit(limit)
    return out


def opportunity_breakdown(report: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return report.groupBy("consolidation_type").agg(
        F.count("*").alias("proposals"), F.count_if(c >= 0.9).alias("high"),
        F.count_if((c >= 0.7) & (c < 0.9)).alias("medium"), F.count_if(c < 0.7).alias("low"),
    )


def approval_kind(proposal_id: Column) -> Column:
    return (
        F.when(proposal_id.startswith("normalization_"), "normalization")
        .when(proposal_id.startswith("sku_to_brand_"), "sku_to_brand")
        .when(proposal_id.startswith("portfolio_"), "portfolio_company")
        .when(proposal_id.startswith("similar_names_"), "similar_names")
        .otherwise("similarity")
    )


def auto_approved(kind: Column, confidence: Column) -> Column:
    return (
        (confidence >= 0.95)
        | ((confidence >= 0.90) & kind.isin("sku_to_brand", "normalization"))
        | ((confidence >= 0.85) & (kind == "portfolio_company"))
    )


def approvals(report: DataFrame) -> DataFrame:
    kind = approval_kind(F.col("proposal_id"))
    return report.withColumns({"kind": kind, "auto_approved": auto_approved(kind, F.col("confidence"))})


def batch_selection(report: DataFrame, min_confidence: float, limit: int | None = None) -> DataFrame:
    out = report.filter(F.col("confidence") >= min_confidence)
    return out.orderBy(F.desc("confidence"), "proposal_id").limit(limit) if limit else out


def merge_mapping(approved: DataFrame, members: DataFrame) -> DataFrame:
    """(brand_name, canonical_name, position) of the approved proposals.

    A brand in several proposals follows the best one (source priority, confidence, id). Chains are
    followed to their end; names that only lead back to themselves stay.
    """
    order = F.struct("source_priority", (-F.col("confidence")).alias("c"), "proposal_id")
    pick = members.join(approved, "proposal_id").filter(F.col("brand_name") != F.col("canonical_name"))
    mapping = cut_lineage(pick.groupBy("brand_name").agg(F.min_by("canonical_name", order).alias("canonical_name")))
    for _ in range(CHAIN_ROUNDS):  # each round doubles the length of the chains that are resolved
        further = mapping.select(F.col("brand_name").alias("canonical_name"), F.col("canonical_name").alias("_next"))
        jumped = mapping.join(further, "canonical_name", "left")
        mapping = cut_lineage(jumped.select("brand_name", F.coalesce("_next", "canonical_name").alias("canonical_name"), F.col("_next").isNotNull().alias("moved")))
        if mapping.filter("moved").isEmpty():
            break
        mapping = mapping.drop("moved")
    ends = mapping.join(mapping.select(F.col("brand_name").alias("canonical_name")), "canonical_name", "left_anti")
    return ends.select("brand_name", "canonical_name").withColumn("position", F.lit(1))


# --- group measures ------------------------------------------------------------------------------------
ROWS_A_TASK = 256


def average_similarity(groups: DataFrame, chunk: int = 1024, typed: bool = False) -> DataFrame:
    """Mean pairwise similarity of the names of each group, every pair counted.

    ``groups``: group_id, name. Names are packed into chunks; two chunks meet in one row and only
    their partial sum leaves it, so a group of n names makes (n / chunk)^2 / 2 rows, not n^2 / 2. Names that differ by
    numbers only are packed together, as their pairs are counted by kinds. With ``typed``
    the pairs of which a variation rule may hold, those of a common key, change from their ratio to the rule's score.
    """
    case = F.lower if typed else F.upper
    masked = groups.withColumn("mask", digit_free(case("name")))
    alike = masked.groupBy("group_id", "mask").agg(F.count("*").alias("m"))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    by_name = F.pmod(F.xxhash64("name"), F.ceil(F.col("m") / chunk))
    cell = F.when(F.col("m") >= chunk // 16, F.xxhash64("mask", by_name)).otherwise(F.pmod(F.xxhash64("mask"), F.ceil(F.col("n") / chunk)))
    cells = masked.join(alike, ["group_id", "mask"]).join(sizes, "group_id").withColumn("cell", cell)
    chunks = cut_lineage(cells.groupBy("group_id", "cell").agg(F.array_sort(F.collect_list("name")).alias("names")))
    per_group = chunks.groupBy("group_id").agg(F.count("*").alias("c"))
    rows = per_group.agg(F.coalesce(F.sum(F.expr("c * (c + 1) div 2")), F.lit(0))).first()[0]
    a, b = chunks.alias("a"), chunks.alias("b")
    met = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.cell") <= F.col("b.cell"))).select(
        F.col("a.group_id").alias("group_id"), F.col("a.cell").alias("_x"), F.col("b.cell").alias("_y"), F.col("a.names").alias("xs"), F.col("b.names").alias("ys")
    )
    # few bytes and much work: neither one task for a group nor few tasks for all, nor more rows than a task can hold
    met = met.repartition(max(4 * groups.sparkSession.sparkContext.defaultParallelism, rows // ROWS_A_TASK), "group_id", "_x", "_y")
    sums = ratio_totals("xs", F.transform("xs", case), "ys", F.transform("ys", case), F.col("_x") == F.col("_y"))
    parts = met.select("group_id", sums.alias("t")).select("group_id", F.col("t.total").alias("s"), F.col("t.pairs").alias("k"))
    if typed:
        parts = parts.unionByName(_rule_changes(groups))
    return parts.groupBy("group_id").agg(F.try_divide(F.sum("s"), F.sum("k")).alias("average_similarity"), F.sum("k").alias("comparisons"))


def _rule_changes(groups: DataFrame) -> DataFrame:
    """group_id, s, k = 0: what the pairs under a variation rule add to the sum of the ratios of their group."""
    spread = 4 * groups.sparkSession.sparkContext.defaultParallelism
    keyed = groups.groupBy("group_id", "name").agg(F.count("*").alias("c")).withColumn("key", F.explode(N.variation_keys(F.col("name"))))
    x, y = (keyed.select("group_id", "key", F.col("name").alias(n), F.col("c").alias(f"c_{n}")) for n in "xy")
    pairs = x.join(y, ["group_id", "key"]).filter("x < y").select("group_id", "x", "y", "c_x", "c_y")
    kinds = pairs.repartition(spread, "group_id", "x", "y").distinct().withColumn("kind", N.variation_type(F.col("x"), F.col("y"))).filter("kind is not null")
    gain = (N.variation_score(F.col("kind")) - ratcliff_ratio(F.lower("x"), F.lower("y"))) * F.col("c_x") * F.col("c_y")
    return kinds.select("group_id", gain.alias("s"), F.lit(0).cast("long").alias("k"))


def recommendation(average: Column) -> Column:
    return (
        F.when(average >= 0.9, "strongly_recommend").when(average >= 0.7, "recommend").when(average >= 0.5, "review_needed").otherwise("not_recommended")
    )


def group_details(members: DataFrame, brands: DataFrame, attributed: DataFrame, name_similarity: DataFrame) -> DataFrame:
    """Proposal document per group: totals, confidence factors, type, risk and benefits.

    ``members``: group_id, canonical_name, brand_name; factors are aggregates over flat bridges.
    """
    rows = members.join(brands, "brand_name")
    white = N.proposal_white_label(F.col("brand_name"))
    base = rows.groupBy("group_id", "canonical_name").agg(
        F.count("*").alias("brand_count"),
        F.sum("sku_count").alias("total_skus"),
        F.min("created_date").alias("earliest"),
        F.max("updated_at").alias("latest"),
        F.count_distinct(F.nullif(N.core_brand(F.col("brand_name")), F.lit(""))).alias("cores"),
        F.count_if(white).alias("white_labels"),
    )
    places = rows.select("group_id", F.explode("countries").alias("v")).groupBy("group_id").agg(F.count_distinct("v").alias("countries_n"))
    kinds = rows.select("group_id", F.explode("class_types").alias("v")).groupBy("group_id").agg(F.count_distinct("v").alias("types_n"))
    held = members.select("group_id", "brand_name").join(attributed, "brand_name")
    makers = held.groupBy("group_id").agg(
        F.count("permit_no").alias("permits"), F.count_distinct("permit_no").alias("distinct_permits"),
        F.count_distinct(F.when(F.col("relationship") == "primary_producer", F.col("owner_name"))).alias("primary_names"),
    )
    d = base.join(places, "group_id", "left").join(kinds, "group_id", "left").join(makers, "group_id", "left").join(name_similarity, "group_id", "left")
    mixed = (F.col("white_labels") > 0) & (F.col("white_labels") < F.col("brand_count"))
    when = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), v).otherwise(0.0)
    factors = {
        "same_core_brand": when(F.col("cores") == 1, 0.4),
        "same_producers": when(F.col("distinct_permits") < F.col("permits"), 0.3),
        "similar_categories": when(F.coalesce("types_n", F.lit(0)) <= 3, 0.15),
        "same_countries": when(F.col("countries_n") == 1, 0.1),
        "name_similarity": F.coalesce("average_similarity", F.lit(0.0)) * 0.2,
        "white_label_penalty": when(mixed, -0.3),
    }
    d = d.withColumns(factors)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((F.col(f) for f in factors), F.lit(0.0))))
    wide, makers_many = F.coalesce("types_n", F.lit(0)) > 5, F.coalesce("primary_names", F.lit(0)) > 2
    # the level is the alphabetical maximum of 'low' and 'medium', as in the published rule
    level = F.when(mixed, "high").when(wide | makers_many, "medium").otherwise("low")
    reasons = join_present(
        [
            F.when(mixed, "Mixed white label and regular brands - may have different brand owners"),
            F.when(wide, "Wide variety of product categories - may be unrelated brands"),
            F.when(makers_many, "Multiple primary producers - may indicate separate brands"),
        ],
        "; ",
    )
    benefits = join_present(
        [
            F.concat(F.lit("Organize "), F.col("total_skus").cast("string"), F.lit(" SKUs under unified brand")),
            F.when(F.col("brand_count") > 2, F.concat(F.lit("Consolidate "), F.col("brand_count").cast("string"), F.lit(" brand variations into single entity"))),
        ],
        "; ",
    )
    return d.withColumns(
        {
            "confidence_score": F.when(F.col("brand_count") < 2, 0.0).otherwise(F.round(score, 6)),
            "risk_level": level, "risks": reasons, "benefits": benefits,
        }
    ).withColumn("proposal_type", proposal_type(F.col("confidence_score")))


def proposal_type(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.9, "high_confidence").when(confidence >= 0.7, "medium_confidence").when(confidence >= 0.5, "low_confidence").otherwise("requires_investigation")
    )


def sku_preview(members: DataFrame, skus: DataFrame) -> DataFrame:
    """Labels of each group under their new names."""
    return members.join(skus, "brand_name").select(
        "group_id", "canonical_name", F.col("brand_name").alias("original_brand"), "ttb_id",
        N.sku_name(F.col("brand_name"), F.col("canonical_name"), F.col("fanciful_name")).alias("new_sku_name"),
    )


def merge_strategy(members: DataFrame) -> DataFrame:
    """Which brand's data to keep per group: last verified, highest confidence, last complete.

    ``members``: group_id, position, brand_name, verified, confidence, countries, class_types, sku_count.
    """
    pos = F.struct("position", "brand_name")
    filled = F.size("countries") * 0.3 + F.size("class_types") * 0.3 + F.col("sku_count") * 0.4
    conf = F.coalesce("confidence", F.lit(0.0))
    first_best = F.when(conf > 0, F.struct((-conf).alias("c"), F.col("position").alias("p"), F.col("brand_name").alias("n")))
    return members.groupBy("group_id").agg(
        F.max_by("brand_name", F.when(F.col("verified"), pos)).alias("verified_enrichment"),
        F.min(first_best)["n"].alias("best_website"),
        F.max(conf).alias("highest_confidence"),
        F.coalesce(F.max_by("brand_name", F.when(filled > 0, pos)), F.min_by("brand_name", pos)).alias("most_complete_data"),
    )


def canonical_by_score(members: DataFrame) -> DataFrame:
    """Canonical name by score: short, no year, no edition word, many labels, verified website."""
    n = F.col("brand_name")
    score = (
        (50 - F.length(n)) * 0.5
        + F.when(~n.rlike(rules.YEAR_PATTERN), 10).otherwise(0)
        + F.when(~F.lower(n).rlike(rules.EDITION_PATTERN), 10).otherwise(0)
        + F.col("sku_count") * 2
        + F.when(F.col("verified"), 20).otherwise(0)
    )
    return members.groupBy("group_id").agg(F.min_by("brand_name", F.struct(-score, F.col("brand_name"))).alias("canonical_name"), F.max(score).alias("score"))
