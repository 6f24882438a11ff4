"""What is learned from feedback events, as aggregates over the event log."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarmark import rules
from cellarmark.functions import web
from cellarmark.functions.candidates import near_pairs
from cellarmark.functions.columns import string_array, words
from cellarmark.functions.names import strategy_features, strategy_key, variation_keys, variation_score, variation_type
from cellarmark.functions.similarity import longest_common_substring, ratcliff_ratio
from cellarmark.operators.sliced import first_per_group
from cellarmark.session import cut_lineage


def _pattern(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("pattern_type"), value.alias("pattern"))


def event_patterns(brand: Column, domain: Column) -> Column:
    """Patterns an event touches: whole name, words over three letters, industry keywords.

    A repeated brand word counts each time, as it does in the event-by-event fold.
    """
    d, glued = F.lower(domain), F.replace(F.lower(brand), F.lit(" "), F.lit(""))
    exact = F.when(d.contains(glued), F.array(_pattern("exact_brand_match", glued)))
    hits = F.filter(words(F.lower(brand)), lambda w: (F.length(w) > 3) & d.contains(w))
    trade = F.filter(string_array(rules.INDUSTRY_KEYWORDS), lambda k: d.contains(k))
    none = F.array().cast("array<struct<pattern_type:string,pattern:string>>")
    return F.concat(
        F.coalesce(exact, none),
        F.transform(hits, lambda w: _pattern("brand_word_match", w)),
        F.transform(trade, lambda k: _pattern("industry_keyword", k)),
    )


def touched_patterns(events: DataFrame) -> DataFrame:
    return events.select(
        "ts", (F.col("user_action") == "verified").cast("int").alias("success"),
        F.explode(event_patterns(F.col("brand_name"), F.col("domain"))).alias("p"),
    ).select("p.*", "ts", "success")


def confidence_boost(rate: Column, n: Column) -> Column:
    boost = F.greatest(F.lit(0.0), (rate - 0.5) * 0.4)
    return F.when(n >= rules.PATTERN_MIN_SAMPLES, boost).otherwise(0.0)


def domain_patterns(events: DataFrame) -> DataFrame:
    """Success rate, sample count and boost of every pattern; exact and independent of event order."""
    stats = touched_patterns(events).groupBy("pattern_type", "pattern").agg(
        F.sum("success").alias("successes"), F.count("*").alias("sample_count"), F.max("ts").alias("last_updated")
    )
    rate = F.col("successes") / F.col("sample_count")
    return stats.withColumns({"success_rate": rate, "confidence_boost": confidence_boost(rate, F.col("sample_count"))})


def discovered_patterns(events: DataFrame) -> DataFrame:
    """First-seen record of character-overlap and number patterns of verified events."""
    brand, domain = F.lower("brand_name"), F.lower("domain")
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    b = letters(F.replace(brand, F.lit(" "), F.lit("")))
    d = letters(F.replace(F.replace(domain, F.lit("."), F.lit("")), F.lit("-"), F.lit("")))
    overlap = F.size(F.array_intersect(b, d)) / F.greatest(F.size(b), F.lit(1))
    numbers = F.regexp_extract_all("brand_name", F.lit(r"(\d+)"), F.lit(1))
    found = F.array(
        F.when(overlap > 0.6, _pattern("high_char_overlap", F.concat(F.lit("overlap_"), F.floor(overlap * 100 + 1e-9).cast("string")))),
        F.when(web.numbers_match(F.col("brand_name"), domain), _pattern("numeric_match", F.try_element_at(numbers, F.lit(1)))),
    )
    return (
        events.filter(F.col("user_action") == "verified")
        .select("ts", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("p"))
        .groupBy("p.pattern_type", "p.pattern")
        .agg(F.min("ts").alias("last_updated"))
        .withColumns({"success_rate": F.lit(1.0), "confidence_boost": F.lit(0.1), "sample_count": F.lit(1)})
    )


# --- confidence -----------------------------------------------------------------------------------
def calibration(events: DataFrame) -> DataFrame:
    """Calibration factor per 0.2-wide confidence bin, at most five rows; 1.0 exactly is in no bin."""
    c = F.col("confidence_predicted")
    bins = (
        events.filter((F.col("event_type") == "user_feedback") & (c >= 0) & (c < 1))
        .groupBy(confidence_bin(c).alias("bin"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("user_action") == "verified").alias("verified"))
    )
    expected = (F.col("bin") * 2 + 1) / 10.0
    factor = F.col("verified") / F.col("n") / F.greatest(expected, F.lit(0.1))
    bounded = F.least(F.lit(1.5), F.greatest(F.lit(0.5), factor))
    return bins.withColumn("factor", F.when(F.col("n") >= rules.CALIBRATION_MIN_SAMPLES, bounded).otherwise(1.0))


def confidence_bin(c: Column) -> Column:
    return F.when(c < 0.2, 0).when(c < 0.4, 1).when(c < 0.6, 2).when(c < 0.8, 3).otherwise(4)


def domain_boosts(domains: DataFrame, patterns: DataFrame) -> DataFrame:
    """Sum of the boosts of all usable patterns contained in each domain.

    "Contains" becomes an equality join: the substrings of a host name are few (its length is bounded
    by DNS), so each distinct domain is expanded to its substrings and joined on them.
    """
    usable = patterns.filter(
        (F.col("sample_count") >= rules.PATTERN_MIN_SAMPLES)
        & F.col("pattern_type").isin("exact_brand_match", "brand_word_match", "industry_keyword")
        & (F.col("confidence_boost") > 0)
    ).select("pattern", "confidence_boost")
    d = F.lower("domain")
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))),
            lambda i: F.transform(F.sequence(F.lit(1), F.length(d) - i + 1), lambda n: F.substring(d, i, n)),
        )
    )
    parts = domains.select("domain").distinct().select("domain", F.explode(F.array_distinct(pieces)).alias("pattern"))
    return parts.join(usable, "pattern").groupBy("domain").agg(F.sum("confidence_boost").alias("boost"))


def enhanced_confidence(rows: DataFrame, boosts: DataFrame, calibrated: DataFrame) -> DataFrame:
    """min(1, base + boosts) x calibration factor of the base; may exceed 1 by design."""
    base = F.col("confidence_predicted")
    joined = rows.join(boosts, "domain", "left").withColumn("bin", F.when((base >= 0) & (base < 1), confidence_bin(base)))
    joined = joined.join(calibrated.select("bin", "factor"), "bin", "left")
    raised = F.least(F.lit(1.0), base + F.coalesce("boost", F.lit(0.0)))
    return joined.withColumn("enhanced_confidence", raised * F.coalesce("factor", F.lit(1.0))).drop("bin", "factor", "boost")


# --- relevance terms --------------------------------------------------------------------------------
def _extracted(text: Column, patterns: Iterable[str]) -> Column:
    """Group 1 of every match of every pattern, Unicode words as in the source patterns."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(1)) for p in patterns]))


def relevance_terms(results: DataFrame) -> DataFrame:
    """(page text) to (term, term_type, context) rows; columns url, title, snippet, class_types."""
    text = F.lower(F.concat_ws(" ", "url", "title", "snippet"))
    known_products, known_facilities = set(rules.GATE_PRODUCTS), set(rules.GATE_FACILITIES)
    descriptors = F.filter(
        F.transform(_extracted(text, rules.DESCRIPTOR_PATTERNS), F.lower),
        lambda t: (F.length(t) > 2) & ~t.isin(*known_products, *known_facilities),
    )
    facilities = F.filter(
        F.transform(_extracted(text, rules.FACILITY_PATTERNS), F.lower), lambda t: (F.length(t) > 2) & ~t.isin(*known_facilities)
    )
    classes = F.col("class_types") if "class_types" in results.columns else F.array().cast("array<string>")
    product_words = F.filter(
        F.flatten(F.transform(classes, lambda c: words(F.lower(c)))), lambda t: (F.length(t) > 3) & ~t.isin(*known_products)
    )

    def tagged(terms: Column, kind: str, context: str) -> Column:
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(kind).alias("term_type"), F.lit(context).alias("context")))

    every = F.concat(
        tagged(descriptors, "product_descriptor", "snippet"),
        tagged(facilities, "facility_type", "snippet"),
        tagged(product_words, "product_type", "brand_context"),
    )
    keep = [c for c in results.columns if c not in ("title", "snippet", "class_types")]
    return results.select(*keep, F.explode(every).alias("t")).select(*keep, "t.*")


def rejection_terms(results: DataFrame) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "url", "title", "snippet"))
    keep = [c for c in results.columns if c not in ("title", "snippet", "class_types")]
    return results.select(*keep, F.explode(F.transform(_extracted(text, rules.REJECTION_PATTERNS), F.lower)).alias("term"))


def term_patterns(terms: DataFrame, rejections: DataFrame) -> DataFrame:
    """Success rate and samples of every learned term; rejection terms have rate 0.

    ``terms`` has a boolean column verified. Contexts and example brands stay countable here; their
    listing is a separate distinct, so no group is collected.
    """
    positive = terms.groupBy("term_type", "term").agg(
        F.count("*").alias("sample_count"),
        (F.count_if("verified") / F.count("*")).alias("success_rate"),
        F.count_distinct(F.when(F.col("verified"), F.col("brand_name"))).alias("example_brands"),
    )
    negative = rejections.groupBy(F.lit("negative_indicator").alias("term_type"), "term").agg(
        F.count("*").alias("sample_count"), F.lit(0.0).alias("success_rate"), F.lit(0).cast("long").alias("example_brands")
    )
    return positive.unionByName(negative)


def usable_terms(patterns: DataFrame) -> DataFrame:
    """Terms trusted in scoring: rate >= 0.7 (negatives <= 0.3), at least two samples."""
    group = (
        F.when(F.col("term_type") == "negative_indicator", "negative_indicators")
        .when(F.col("term_type") == "product_type", "products")
        .when(F.col("term_type") == "facility_type", "facilities")
        .otherwise("descriptors")
    )
    enough = F.col("sample_count") >= rules.TERM_MIN_SAMPLES
    negative = F.col("term_type") == "negative_indicator"
    ok = F.when(negative, F.col("success_rate") <= 0.3).otherwise(F.col("success_rate") >= 0.7)
    return patterns.filter(enough & ok).select(group.alias("list"), "term", "success_rate", "sample_count")


# --- selections ----------------------------------------------------------------------------------
def selection_events(choices: DataFrame) -> DataFrame:
    """One event per presented option: selected, not selected, or rejected with all others.

    ``choices``: brand_name, ts, selected_rank (0 = all rejected), options array<struct<url,domain,confidence>>.
    """
    rank = F.col("pos") + 1
    chosen = F.col("selected_rank")
    return choices.select("brand_name", "ts", "selected_rank", F.posexplode("options").alias("pos", "o")).select(
        "brand_name", "ts", "selected_rank", rank.alias("option_rank"), F.col("o.url").alias("url"), F.col("o.domain").alias("domain"),
        F.col("o.confidence").alias("confidence_predicted"),
        F.when(chosen == 0, "multi_choice_rejection_all").when(rank == chosen, "multi_choice_selection").otherwise("multi_choice_rejection").alias("event_type"),
        F.when(chosen == 0, "rejected_all").when(rank == chosen, "selected").otherwise("not_selected").alias("user_action"),
    )


def selection_boosts(selected: DataFrame) -> DataFrame:
    """Pattern boosts of selected options: first .1 or .05, later +.05/.03/.01, capped at .3.

    All steps are positive, so capping the sum equals capping every step. ``selected`` has
    pattern_type, pattern, selected_rank, ts and a tie-break id.
    """
    r = F.col("selected_rank")
    step = F.when(r == 1, 0.05).when(r == 2, 0.03).otherwise(0.01)
    start = F.when(r == 1, 0.1).otherwise(0.05)
    order = F.struct("ts", "event_id")
    agg = selected.groupBy("pattern_type", "pattern").agg(
        F.count("*").alias("sample_count"),
        F.sum(step).alias("_steps"),
        F.min_by(F.struct(start.alias("start"), step.alias("step")), order).alias("_first"),
    )
    boost = F.least(F.lit(0.3), F.col("_first.start") + F.col("_steps") - F.col("_first.step"))
    return agg.select("pattern_type", "pattern", "sample_count", F.round(boost, 6).alias("confidence_boost"))


def rejection_boosts(rejected: DataFrame) -> DataFrame:
    """Negative boosts: -.1, then -.02 per repetition, floor -.2."""
    n = F.count("*")
    boost = F.greatest(F.lit(-0.2), F.lit(-0.1) - (n - 1) * 0.02)
    return rejected.groupBy(F.concat(F.lit("negative_"), F.col("pattern_type")).alias("pattern_type"), "pattern").agg(
        n.alias("sample_count"), F.round(boost, 6).alias("confidence_boost")
    )


def feature_patterns(rows: DataFrame) -> DataFrame:
    """True flags and text features of each row as patterns; column features is a string map."""
    pairs = F.filter(F.map_entries("features"), lambda e: ~e["value"].isin("false", ""))
    keep = [c for c in rows.columns if c != "features"]
    return rows.select(*keep, F.explode(pairs).alias("e")).select(
        *keep, F.col("e.key").alias("pattern_type"), F.lower("e.value").alias("pattern")
    )


# --- strategies ------------------------------------------------------------------------------------
def strategy_patterns(runs: DataFrame) -> DataFrame:
    """Sample count, success rate and mean quality per strategy key.

    ``runs``: brand_name, strategy, quality, class_types, countries, ts.
    """
    keyed = with_strategy_key(runs)
    # every feature except the two counts is decided by the first run of the key
    return keyed.groupBy("strategy_key").agg(
        F.min_by("strategy", F.struct("ts", "brand_name")).alias("strategy"),
        F.min_by("features", F.struct("ts", "brand_name")).alias("features"),
        F.count("*").alias("sample_count"),
        F.lit(1.0).alias("success_rate"),
        F.avg("quality").alias("average_confidence"),
    )


def with_strategy_key(runs: DataFrame) -> DataFrame:
    feats = strategy_features(F.col("brand_name"), F.col("class_types"), F.col("countries"))
    return runs.withColumn("features", feats).withColumn("strategy_key", strategy_key(F.col("strategy"), F.col("features")))


def recent_examples(keyed: DataFrame, k: int = 5) -> DataFrame:
    """Last k distinct examples per key, by first appearance."""
    first_seen = keyed.groupBy("strategy_key", "brand_name").agg(F.min("ts").alias("first_seen"))
    return first_per_group(first_seen, ["strategy_key"], [F.desc("first_seen"), F.desc("brand_name")], k, name="recency")


def recommended_strategy(brands: DataFrame, patterns: DataFrame) -> DataFrame:
    """Best strategy per brand: n >= 2, feature match > 0.5, highest rate x quality x match.

    The learned patterns are one row per strategy key, a closed set of at most 24 per strategy name.
    They are folded into one array row, so brands are compared inside an expression and no pair of
    rows is formed.
    """
    names = ["starts_with_common_word", "has_numbers", "word_count", "brand_length", "is_wine", "is_spirits", "is_beer", "has_location", "is_us_brand"]
    library = patterns.filter(F.col("sample_count") >= 2).agg(
        F.array_sort(F.collect_list(F.struct("strategy_key", "strategy", "features", "success_rate", "average_confidence"))).alias("library")
    )
    feats = strategy_features(F.col("brand_name"), F.col("class_types"), F.col("countries"))
    rows = brands.withColumn("_f", feats).crossJoin(library)  # one-row library

    def scored(p: Column) -> Column:
        same = sum(((F.col("_f")[n] == p["features"][n]).cast("int") for n in names), F.lit(0)) / len(names)
        value = F.when(same > 0.5, p["success_rate"] * p["average_confidence"] * same)
        return F.struct(value.alias("value"), p["strategy"].alias("strategy"), p["strategy_key"].alias("strategy_key"))

    best = F.array_max(F.filter(F.transform("library", scored), lambda s: s["value"].isNotNull()))
    return rows.withColumn("_b", best).select("brand_name", F.col("_b.strategy").alias("strategy"), F.col("_b.strategy_key").alias("strategy_key"), F.round("_b.value", 6).alias("value"))


# --- merge patterns ----------------------------------------------------------------------------------
FOLD_BITS = 12


def pattern_fold(steps: DataFrame) -> DataFrame:
    """Confidence of each merge pattern after its successes (+.05, cap 1) and failures (-.1, floor .1), in order of (ts, event_id).

    Clamping both ways depends on order, yet each step is x -> min(hi, max(lo, x + d)) and such maps compose to the same form.
    The steps are placed by one range sort over pattern and time, which splits a hot pattern over tasks and a hot day too; runs
    of at most 4096 consecutive places are composed to one map, then runs of these, so no array is longer, whatever the counts.
    """
    order = ["pattern", "ts", "event_id"]
    good = F.col("success")
    level = steps.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "pattern", F.monotonically_increasing_id().alias("place"), F.when(good, 0.05).otherwise(-0.1).alias("d"),
        F.when(good, -9.0).otherwise(0.1).alias("lo"), F.when(good, 1.0).otherwise(9.0).alias("hi"),
        F.when(good, 1).otherwise(0).cast("long").alias("success_count"), F.when(~good, 1).otherwise(0).cast("long").alias("failure_count"), "start",
    )
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(-9.0).alias("lo"), F.lit(9.0).alias("hi"))

    def compose(f: Column, g: Column) -> Column:
        # g after f; clamp(x + d) on [lo, hi]
        clampg = lambda v: F.least(g["hi"], F.greatest(g["lo"], v + g["d"]))
        return F.struct((f["d"] + g["d"]).alias("d"), clampg(f["lo"]).alias("lo"), clampg(f["hi"]).alias("hi"))

    # a place is a task's number times 2 ** 33 plus the row's number in it: five levels reach 2 ** 60
    for depth in range(1, 6):
        run = F.shiftright("place", FOLD_BITS * depth)
        level = level.groupBy("pattern", run.alias("run")).agg(
            F.aggregate(F.array_sort(F.collect_list(F.struct("place", "d", "lo", "hi"))), zero, compose).alias("m"), F.min("place").alias("first"),
            F.sum("success_count").alias("success_count"), F.sum("failure_count").alias("failure_count"), F.min_by("start", "place").alias("start"),
        ).select("pattern", F.col("first").alias("place"), "m.d", "m.lo", "m.hi", "success_count", "failure_count", "start")
    value = F.least("hi", F.greatest(F.col("lo"), F.col("start") + F.col("d")))
    return level.select("pattern", "success_count", "failure_count", F.round(value, 6).alias("confidence"))


def pattern_boost(pairs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Boost of a pair from learned merge patterns of its variation type: min(.3, sum conf x rate x .1).

    ``pairs``: pair_id, name_a, name_b, kind; ``patterns``: pattern_type, base_pattern, confidence,
    success_count, failure_count. The join key is the type; an empty base matches every pair.
    """
    rate = F.col("success_count") / F.greatest(F.col("success_count") + F.col("failure_count"), F.lit(1))
    p = patterns.select("pattern_type", F.lower("base_pattern").alias("_base"), (F.col("confidence") * rate * 0.1).alias("_gain"))
    hit = (F.col("_base") == "") | F.lower("name_a").contains(F.col("_base")) | F.lower("name_b").contains(F.col("_base"))
    joined = pairs.join(p, (F.col("kind") == F.col("pattern_type")) & hit, "left")
    return joined.groupBy("pair_id").agg(F.least(F.lit(0.3), F.coalesce(F.sum("_gain"), F.lit(0.0))).alias("boost"))


# --- upload learning -----------------------------------------------------------------------------------
LEAST_SIMILAR = 0.7


def matched_patterns(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """name, gains (struct<id, gain> of each learned pattern that any pair with this name matches), gain (their sum).

    A pattern of a rule type needs that rule, whose pairs have fixed scores; the others match where their base occurs in
    one of the names. Bases are found by equality with the names' substrings, once per name.
    """
    rate = F.col("success_count") / F.greatest(F.col("success_count") + F.col("failure_count"), F.lit(1))
    free = patterns.filter(~F.col("pattern_type").isin([k for k in rules.VARIATION_SCORES if k != "exact"]))
    free = free.select(F.lower("base_pattern").alias("_base"), F.struct(F.xxhash64("pattern_type", "base_pattern").alias("id"), (F.col("confidence") * rate * 0.1).alias("gain")).alias("_g"))
    low, n = F.lower("name"), F.length("name")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n))
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - i + 1)), lambda size: F.substring(low, i, size))))
    keyed = names.select("name", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), pieces))).alias("_base"))
    found = keyed.join(free, "_base").groupBy("name").agg(F.collect_set("_g").alias("gains"))
    none = F.array().cast("array<struct<id:bigint,gain:double>>")
    held = names.join(found, "name", "left").withColumn("gains", F.coalesce("gains", none))
    return held.withColumn("gain", F.aggregate("gains", F.lit(0.0), lambda total, g: total + g["gain"]))


def upload_variations(new_names: DataFrame, existing_names: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """new_brand, existing_brand, similarity, pattern_type, base_pattern of all pairs of at least ``LEAST_SIMILAR``.

    A new name is one that is not among the existing ones. The first rule that holds gives the type and score of a pair, the
    sequence ratio (plus the boost of learned ``patterns``, at most .3) that of a fuzzy one. Candidates share a rule key
    or as many characters as the boost of both names leaves necessary, so no pair is lost. The base is the longest
    block of the existing name that the new one has too, if longer than three characters.
    """
    old = cut_lineage(existing_names.select(F.col("brand_name").alias("name")).filter("name is not null").distinct())
    new = cut_lineage(new_names.select(F.col("brand_name").alias("name")).filter("name is not null").distinct().join(old, "name", "left_anti"))
    none = F.array().cast("array<struct<id:bigint,gain:double>>")
    if patterns is None:
        old, new = (side.withColumns({"gains": none, "least": F.lit(LEAST_SIMILAR)}) for side in (old, new))
    else:
        old, new = matched_patterns(old, patterns), matched_patterns(new, patterns)
        most_old, most_new = (side.agg(F.coalesce(F.max("gain"), F.lit(0.0)).alias("most")) for side in (old, new))  # one row each
        least = F.lit(LEAST_SIMILAR) - F.least(F.lit(0.3), F.col("gain") + F.col("most"))
        old = old.crossJoin(F.broadcast(most_new)).select("name", "gains", least.alias("least"))
        new = new.crossJoin(F.broadcast(most_old)).select("name", "gains", least.alias("least"))

    def keyed(side: DataFrame, name: str, keys: Column) -> DataFrame:
        return side.select(F.col("name").alias(name), F.col("least").alias(f"least_{name}"), F.explode(keys).alias("_key"))

    trimmed = F.lower(F.trim("name"))
    ruled = keyed(new, "new_brand", variation_keys(F.col("name"))).join(keyed(old, "existing_brand", variation_keys(F.col("name"))), "_key")
    listed = lambda side, name: side.select(F.col("name").alias(name), trimmed.alias("text"), "least")
    alike = near_pairs(listed(new, "new_brand"), listed(old, "existing_brand"), ordered=True).toDF("new_brand", "existing_brand")
    a, b = F.lower(F.trim("new_brand")), F.lower(F.trim("existing_brand"))
    spread = 4 * new_names.sparkSession.sparkContext.defaultParallelism  # comparisons are the work, however few bytes they take
    key = ["new_brand", "existing_brand"]
    kind = variation_type(F.col("new_brand"), F.col("existing_brand"))
    ruled = cut_lineage(ruled.select(*key).repartition(spread, *key).distinct().withColumn("kind", kind).filter("kind is not null"))
    boost = F.lit(0.0)
    if patterns is not None:
        alike = alike.join(new.select(F.col("name").alias("new_brand"), F.col("gains").alias("_n")), "new_brand").join(old.select(F.col("name").alias("existing_brand"), F.col("gains").alias("_o")), "existing_brand")
        boost = F.least(F.lit(0.3), F.aggregate(F.array_union("_n", "_o"), F.lit(0.0), lambda total, g: total + g["gain"]))
    fuzzy = alike.select(*key, F.lit("fuzzy_match").alias("pattern_type"), F.least(ratcliff_ratio(a, b) + boost, F.lit(1.0)).alias("similarity"))
    fuzzy = fuzzy.filter(F.col("similarity") >= LEAST_SIMILAR).repartition(spread, *key).join(ruled, key, "left_anti")
    scored = ruled.select(*key, F.col("kind").alias("pattern_type"), variation_score(F.col("kind")).alias("similarity")).unionByName(fuzzy)
    base = longest_common_substring(F.col("existing_brand"), F.col("new_brand"))
    return scored.filter(F.col("similarity") >= LEAST_SIMILAR).select(*key, "similarity", "pattern_type", base.alias("base_pattern"))


def learned_patterns(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Patterns after an upload's pairs: a new one starts at its first pair's similarity, each further pair adds .05 up to 1.

    ``known`` patterns (pattern_type, base_pattern, confidence, success_count, failure_count, first_existing, first_new) go on from
    where they stand; pairs come in the order of their names.
    """
    first = F.min_by(F.struct("similarity", "existing_brand", "new_brand"), F.struct("new_brand", "existing_brand")).alias("_f")
    found = pairs.groupBy("pattern_type", "base_pattern").agg(F.count("*").alias("_n"), first)
    step = rules.PATTERN_SUCCESS_STEP
    fresh = F.least(F.lit(1.0), F.col("_f.similarity") + step * (F.col("_n") - 1))
    if known is None:
        return found.select("pattern_type", "base_pattern", fresh.alias("confidence"), F.col("_n").alias("success_count"), F.lit(0).cast("long").alias("failure_count"), F.col("_f.existing_brand").alias("first_existing"), F.col("_f.new_brand").alias("first_new"))
    both = known.join(found, ["pattern_type", "base_pattern"], "full")
    added = F.coalesce("_n", F.lit(0))
    stood = F.col("confidence").isNotNull()
    return both.select(
        "pattern_type", "base_pattern",
        F.when(~stood, fresh).when(added > 0, F.least(F.lit(1.0), F.col("confidence") + step * added)).otherwise(F.col("confidence")).alias("confidence"),
        (F.coalesce("success_count", F.lit(0)) + added).alias("success_count"), F.coalesce("failure_count", F.lit(0)).cast("long").alias("failure_count"),
        F.coalesce("first_existing", "_f.existing_brand").alias("first_existing"), F.coalesce("first_new", "_f.new_brand").alias("first_new"),
    )


def learn_from_upload(new_names: DataFrame, existing_names: DataFrame, log: str, upload_id: str, patterns: DataFrame | None = None) -> DataFrame:
    """Append an upload's pairs to the log (one folder per upload) and return them; a replayed upload adds nothing.

    The log is only ever appended to: pairs that it already has for this upload are left out of the write.
    """
    spark = new_names.sparkSession
    pairs = upload_variations(new_names, existing_names, patterns).withColumn("upload_id", F.lit(upload_id))
    key = ["upload_id", "new_brand", "existing_brand"]
    try:
        logged = spark.read.schema(pairs.schema).parquet(log).filter(F.col("upload_id") == upload_id).select(*key)
        fresh = pairs.join(logged, key, "left_anti")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        fresh = pairs
    fresh.write.mode("append").partitionBy("upload_id").parquet(log)
    return spark.read.schema(pairs.schema).parquet(log).filter(F.col("upload_id") == upload_id)


# --- insights -----------------------------------------------------------------------------------------
def feedback_insights(events: DataFrame, as_of: Column) -> DataFrame:
    total, a = F.count("*"), F.col("user_action")
    c = F.col("confidence_predicted")
    return events.agg(
        total.alias("total_events"),
        F.count_if(a == "verified").alias("verified"),
        F.count_if(a == "rejected").alias("rejected"),
        F.count_if(a == "flagged").alias("flagged"),
        F.round(F.count_if(a == "verified") / F.greatest(total, F.lit(1)) * 100, 2).alias("success_rate"),
        F.round(F.avg(F.when(c != 0, c)), 4).alias("average_confidence"),
        F.count_if(F.col("ts") > as_of - F.make_dt_interval(F.lit(7))).alias("recent_activity"),
    )


def top_patterns(patterns: DataFrame, k: int = 5) -> DataFrame:
    return (
        patterns.filter(F.col("sample_count") >= rules.PATTERN_MIN_SAMPLES)
        .orderBy(F.desc("success_rate"), F.desc("sample_count"), "pattern_type", "pattern")
        .limit(k)
    )


def patterns_by_type(patterns: DataFrame, k: int = 3) -> DataFrame:
    """Pattern count per type with its k most sampled patterns."""
    top = first_per_group(patterns, ["pattern_type"], [F.desc("sample_count"), F.asc("pattern")], k, name="position")
    counts = patterns.groupBy("pattern_type").agg(F.count("*").alias("patterns"))
    return top.join(counts, "pattern_type")


def merge_insights(patterns: DataFrame, feedback: DataFrame) -> DataFrame:
    p = patterns.agg(F.count("*").alias("patterns"), F.count_if(F.col("confidence") > 0.8).alias("high_confidence"))
    approved = F.count_if(F.col("user_action") == "approved")
    f = feedback.agg(F.count("*").alias("feedback_events"), (approved / F.greatest(F.count("*"), F.lit(1))).alias("approval_rate"))
    return p.crossJoin(f)


def knowledge_sets(events: DataFrame) -> DataFrame:
    """False-positive domains learned from rejections, beyond the known ones; one row per domain."""
    return (
        events.filter((F.col("user_action") == "rejected") & ~F.lower("domain").isin(*rules.FALSE_POSITIVE_DOMAINS))
        .groupBy("domain")
        .agg(F.count("*").alias("rejections"))
    )


def brand_interactions(events: DataFrame) -> DataFrame:
    return events.groupBy("brand_name").agg(
        F.count_if(F.col("user_action") == "verified").alias("selections"),
        F.count_if(F.col("user_action") != "verified").alias("rejections"),
        F.max("ts").alias("last_interaction"),
    )


def manual_split(events: DataFrame, manual: Column, source: Column) -> DataFrame:
    """Manual and automatic event counts, manual ones per source."""
    return events.groupBy(F.when(manual, "manual").otherwise("automatic").alias("origin"), F.when(manual, source).alias("source")).agg(
        F.count("*").alias("events")
    )


def export_tables(events: DataFrame, patterns: DataFrame, terms: DataFrame, strategies: DataFrame) -> dict[str, DataFrame]:
    """The five export tables of the learning state; lists of examples and contexts give their first five entries as one text.

    ``events`` may carry a map of features, ``terms`` arrays contexts and brand_examples, ``strategies`` an array examples; where
    they are absent the count is 0 and the text empty. Figures that need an event are left out of the summary of none.
    """

    def listed(df: DataFrame, column: str) -> Column:
        return F.array_join(F.slice(column, 1, 5), ", ") if column in df.columns else F.lit("")

    def rounded(column: str) -> Column:
        return F.round(column, 3).alias(column)

    features = F.coalesce(F.size("features"), F.lit(0)) if "features" in events.columns else F.lit(0)
    verified = F.count_if(F.col("user_action") == "verified")
    confident = F.when(F.col("confidence_predicted") != 0, F.col("confidence_predicted"))
    summary = events.agg(
        F.count("*").alias("Total Learning Events"),
        verified.alias("Verified Count"),
        F.count_if(F.col("user_action") == "rejected").alias("Rejected Count"),
        F.count_if(F.col("user_action") == "flagged").alias("Flagged Count"),
        F.round(F.try_divide(verified * 100, F.count("*")), 2).alias("Success Rate (%)"),
        F.round(F.avg(confident), 3).alias("Average Confidence"),
    )
    for name, df in {"Domain Patterns": patterns, "Relevance Patterns": terms, "Strategy Patterns": strategies}.items():
        summary = summary.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    metrics = F.array(*[F.struct(F.lit(c).alias("Metric"), F.col(f"`{c}`").cast("double").alias("Value")) for c in summary.columns])
    return {
        "learning_events": events.select(
            "ts", "event_type", "brand_name", "domain", F.coalesce(F.round("confidence_predicted", 3), F.lit(0.0)).alias("confidence_predicted"), "user_action", features.alias("feature_count")
        ),
        "domain_patterns": patterns.select("pattern", "pattern_type", rounded("success_rate"), rounded("confidence_boost"), "sample_count", "last_updated"),
        "relevance_patterns": terms.select("term", "term_type", rounded("success_rate"), "sample_count", listed(terms, "contexts").alias("contexts"), listed(terms, "brand_examples").alias("brand_examples")),
        "strategy_patterns": strategies.select("strategy", rounded("success_rate"), rounded("average_confidence"), "sample_count", listed(strategies, "examples").alias("examples")),
        "summary_statistics": summary.select(F.explode(metrics).alias("m")).select("m.*").filter(F.col("Value").isNotNull()),
    }


def with_examples(patterns: DataFrame, keyed: DataFrame, k: int = 5) -> DataFrame:
    """Strategy patterns with their last k distinct example brands, the oldest of them first; k bounds the list."""
    recent = recent_examples(keyed, k).groupBy("strategy_key").agg(F.sort_array(F.collect_list(F.struct((-F.col("recency")).alias("n"), "brand_name"))).alias("e"))
    return patterns.join(recent.select("strategy_key", F.col("e.brand_name").alias("examples")), "strategy_key", "left")


