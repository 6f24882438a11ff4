"""Brand-name expressions: normalisation, core names, variation tests, name classes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarmark import rules
from cellarmark.functions.columns import contains_any, count_terms, squeeze, string_array, words


def normalize_name(c: Column) -> Column:
    """Upper case, quotes and business words removed, spaces squeezed."""
    bare = F.regexp_replace(F.upper(F.trim(c)), "[\"']", "")
    return squeeze(F.regexp_replace(bare, rules.BUSINESS_WORDS, ""))


def significant_words(c: Column) -> Column:
    """Distinct words of at least three characters of the normalised name."""
    return F.array_distinct(F.filter(words(normalize_name(c)), lambda w: F.length(w) >= 3))


def names_might_match(norm_a: Column, norm_b: Column) -> Column:
    """Length half of the cheap pre-test; the shared word comes from the blocking join."""
    la, lb = F.length(norm_a), F.length(norm_b)
    return F.abs(la - lb) <= F.greatest(la, lb) * F.lit(0.6)


def _class_terms(class_type: Column | None) -> Column:
    general = rules.PRODUCT_TERMS["general"]
    if class_type is None:
        every = [t for terms in rules.PRODUCT_TERMS.values() for t in terms]
        return string_array(dict.fromkeys(every))
    lower = F.lower(class_type)
    sized = general + rules.PRODUCT_TERMS["size_volume"]
    chosen = None
    for category, terms in rules.PRODUCT_TERMS.items():
        hit = lower.contains(category) | F.lit(category).contains(lower)
        value = string_array(dict.fromkeys(sized + terms))
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    every = string_array(dict.fromkeys(t for terms in rules.PRODUCT_TERMS.values() for t in terms))
    return F.when(F.coalesce(class_type, F.lit("")) == "", every).otherwise(
        chosen.otherwise(string_array(dict.fromkeys(sized)))
    )


def proper_case(c: Column) -> Column:
    def one(w: Column) -> Column:
        up = F.upper(w)
        return (
            F.when(up.isin(*rules.UPPERCASE_WORDS) | up.rlike("^[IVX]+$"), up)
            .when(w.rlike("^[0-9]+$"), w)
            .otherwise(F.initcap(w))
        )

    return F.array_join(F.transform(words(c), one), " ")


def core_brand(c: Column, class_type: Column | None = None) -> Column:
    """Core brand name: pattern strip, product words, ages and proofs, tidy-up, length rules, case."""
    upper = F.upper(F.trim(c))
    heads = [
        F.nullif(F.trim(F.regexp_extract(upper, "^(?:" + p + ")", 1)), F.lit(""))
        for p in rules.CORE_NAME_PATTERNS
    ]
    head = F.coalesce(*heads, upper)
    terms = _class_terms(class_type)
    general = string_array(rules.PRODUCT_TERMS["general"])
    kept = F.filter(
        words(head), lambda w: ~F.array_contains(terms, w) & ~F.array_contains(general, w)
    )
    bare = F.array_join(kept, " ")
    for pattern in rules.AGE_PATTERNS + rules.PROOF_PATTERNS:
        bare = F.regexp_replace(bare, "(?i)" + pattern, "")
    bare = squeeze(bare)
    bare = F.trim(F.regexp_replace(bare, r"\s*[-–—&]\s*$", ""))
    bare = F.regexp_replace(bare, r"(?i)^(?:THE|A|AN)\s+", "")
    bare = F.trim(F.regexp_replace(bare, r"(?i)\s+(?:THE|A|AN)$", ""))
    parts = words(bare)
    first_three = F.array_join(F.slice(words(upper), 1, 3), " ")
    final = (
        F.when(F.length(bare) < 2, first_three)
        .when(F.size(parts) > 4, F.array_join(F.slice(parts, 1, 3), " "))
        .otherwise(bare)
    )
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(proper_case(final))


def name_variations(c: Column) -> Column:
    """Distinct non-empty spellings used for matching."""
    core = core_brand(c)
    spellings = F.array(c, core, F.upper(c), F.lower(c), F.initcap(c), F.upper(core), F.lower(core))
    return F.array_sort(F.array_distinct(F.filter(spellings, lambda v: v != "")))


# --- white labels, product names, company names -------------------------------------------------
def is_white_label(c: Column) -> Column:
    return contains_any(F.upper(c), rules.STORE_BRANDS + rules.PRIVATE_LABEL_TERMS)


def store_brands(c: Column) -> Column:
    """The store brands named in the text; two white labels share an owner when these overlap."""
    up = F.upper(c)
    return F.filter(string_array(rules.STORE_BRANDS), lambda s: up.contains(s))


def proposal_white_label(c: Column) -> Column:
    return contains_any(F.upper(c), rules.PROPOSAL_WHITE_LABELS)


def product_indicator_count(name: Column, class_types: Column) -> Column:
    lower = F.lower(name)
    base = count_terms(lower, rules.PRODUCT_INDICATORS)
    short = ((F.size(words(name)) == 1) & (F.length(name) < 6)).cast("int")
    number = (name.rlike(r"\d+") & ~name.rlike(r"18\d{2}|19\d{2}|20\d{2}")).cast("int")
    aligned = F.size(
        F.filter(
            F.coalesce(class_types, F.array().cast("array<string>")),
            lambda ct: reduce(
                lambda a, b: a | b,
                [F.lower(ct).contains(t) & lower.contains(t) for t in rules.PRODUCT_CLASS_TERMS],
            ),
        )
    )
    return base + short + number + aligned


def is_product_name(name: Column, class_types: Column) -> Column:
    return product_indicator_count(name, class_types) >= 2


def is_company_name(name: Column) -> Column:
    return (
        contains_any(F.lower(name), rules.COMPANY_INDICATORS)
        & (F.size(words(name)) >= 2)
        & name.rlike(r"(^|\s)\p{Lu}")
    )


# --- variation keys --------------------------------------------------------------------------
def year_free(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), rules.YEAR_PATTERN, ""))


def has_year(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike(rules.YEAR_PATTERN)


def edition_free(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(F.trim(c)), rules.EDITION_PATTERN, ""))


def is_year_variation(a: Column, b: Column) -> Column:
    return (year_free(a) == year_free(b)) & (year_free(a) != "") & has_year(a) & has_year(b)


def is_location_variation(a: Column, b: Column) -> Column:
    la, lb = F.lower(F.trim(a)), F.lower(F.trim(b))
    tests = []
    for place in rules.LOCATION_WORDS:
        ra = F.trim(F.replace(la, F.lit(place), F.lit("")))
        rb = F.trim(F.replace(lb, F.lit(place), F.lit("")))
        tests.append((ra == rb) & (ra != ""))
    return reduce(lambda x, y: x | y, tests)


def is_suffix_variation(a: Column, b: Column) -> Column:
    la, lb = F.lower(F.trim(a)), F.lower(F.trim(b))
    tests = []
    for suffix in rules.BRAND_SUFFIXES:
        s = F.lit(suffix)
        bare_a, bare_b = F.trim(F.replace(la, s, F.lit(""))), F.trim(F.replace(lb, s, F.lit("")))
        tests.append(la.endswith(s) & ~lb.endswith(s) & (bare_a == lb))
        tests.append(lb.endswith(s) & ~la.endswith(s) & (bare_b == la))
    return reduce(lambda x, y: x | y, tests)


def is_abbreviation(a: Column, b: Column) -> Column:
    la, lb = F.lower(F.trim(a)), F.lower(F.trim(b))
    tests = []
    for full, shorts in rules.NAME_ABBREVIATIONS.items():
        for short in shorts:
            forward = la.contains(full) & lb.contains(short)
            tests.append(forward & (F.replace(la, F.lit(full), F.lit(short)) == lb))
            backward = ~forward & lb.contains(full) & la.contains(short)
            tests.append(backward & (F.replace(lb, F.lit(full), F.lit(short)) == la))
    return reduce(lambda x, y: x | y, tests)


def is_special_edition(a: Column, b: Column) -> Column:
    return (edition_free(a) == edition_free(b)) & (edition_free(a) != "")


def variation_type(a: Column, b: Column) -> Column:
    """First variation rule that holds, NULL when none does."""
    return (
        F.when(F.lower(F.trim(a)) == F.lower(F.trim(b)), "exact")
        .when(is_year_variation(a, b), "year_variation")
        .when(is_location_variation(a, b), "location_variation")
        .when(is_suffix_variation(a, b), "suffix_variation")
        .when(is_abbreviation(a, b), "abbreviation")
        .when(is_special_edition(a, b), "special_edition")
    )


def variation_score(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in rules.VARIATION_SCORES.items() for x in kv])[kind]


def variation_keys(c: Column) -> Column:
    """Exact blocking keys: every pair in a rule-based variation shares one of them."""
    low = F.lower(F.trim(c))
    keys = [
        F.concat(F.lit("x:"), low),
        F.concat(F.lit("e:"), edition_free(c)),
        F.when(has_year(c), F.concat(F.lit("y:"), year_free(c))),
    ]
    for place in rules.LOCATION_WORDS:
        bare = F.concat(F.lit("x:"), F.trim(F.replace(low, F.lit(place), F.lit(""))))
        keys.append(F.when(low.contains(place), bare))
    for suffix in rules.BRAND_SUFFIXES:
        keys.append(
            F.when(low.endswith(suffix), F.concat(F.lit("x:"), F.trim(F.replace(low, F.lit(suffix), F.lit("")))))
        )
    for full, shorts in rules.NAME_ABBREVIATIONS.items():
        for short in shorts:
            keys.append(F.when(low.contains(full), F.concat(F.lit("x:"), F.replace(low, F.lit(full), F.lit(short)))))
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull()))


# --- misc -------------------------------------------------------------------------------------
def sku_name(brand: Column, canonical: Column, fanciful: Column) -> Column:
    rest = F.trim(F.replace(brand, canonical, F.lit("")))
    fancy = F.when((fanciful != "") & (fanciful != "nan"), fanciful)
    return F.coalesce(fancy, F.nullif(rest, F.lit("")), F.lit("Original"))


def strip_trade_suffix(c: Column) -> Column:
    pattern = "(?i)(?:" + "|".join(re.escape(s) for s in rules.TRAILING_TRADE_SUFFIXES) + ")$"
    return F.when(c.rlike(pattern), F.trim(F.regexp_replace(c, pattern, ""))).otherwise(c)


def starts_with_common_word(c: Column) -> Column:
    return F.lower(c).rlike("^(?:a|the|an|and|or) ")


def brand_characteristics(name: Column) -> Column:
    digits = name.rlike("[0-9]")
    return F.struct(
        F.length(name).alias("brand_length"),
        digits.alias("has_numbers"),
        name.contains(" ").alias("has_spaces"),
        F.size(words(name)).alias("word_count"),
        starts_with_common_word(name).alias("starts_with_common"),
        (digits & (F.length(name) <= 6)).alias("is_numerical"),
        name.rlike("[.&'-]").alias("has_special_chars"),
    )


def strategy_features(name: Column, class_types: Column, countries: Column) -> Column:
    classes = F.lower(F.array_join(class_types, " "))
    return F.struct(
        starts_with_common_word(name).alias("starts_with_common_word"),
        name.rlike("[0-9]").alias("has_numbers"),
        F.size(words(name)).alias("word_count"),
        F.length(name).alias("brand_length"),
        F.exists(class_types, lambda ct: F.lower(ct).contains("wine")).alias("is_wine"),
        contains_any(classes, rules.STRATEGY_SPIRIT_WORDS).alias("is_spirits"),
        contains_any(classes, rules.STRATEGY_BEER_WORDS).alias("is_beer"),
        (F.size(countries) > 0).alias("has_location"),
        F.exists(countries, lambda x: F.lower(x).contains("united states")).alias("is_us_brand"),
    )


def strategy_key(strategy: Column, features: Column) -> Column:
    kind = (
        F.when(features["is_wine"], "wine").when(features["is_spirits"], "spirits").when(features["is_beer"], "beer")
    )
    parts = F.array(
        strategy,
        F.when(features["starts_with_common_word"], "common_word_start"),
        F.when(features["has_numbers"], "has_numbers"),
        kind,
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), ":")


def search_phrases(name: Column) -> Column:
    """Up to five suggested search phrases."""
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    extra = [
        F.when(name.rlike("[0-9]"), F.concat(quoted, F.lit(" official website"))),
        F.when(F.size(words(name)) > 1, F.concat(quoted, F.lit(" distillery"))),
        F.when(F.size(words(name)) > 1, F.concat(quoted, F.lit(" spirits"))),
    ]
    base = [F.concat(quoted, F.lit(" " + t)) for t in rules.SEARCH_TERMS[:3]]
    return F.slice(F.filter(F.array(quoted, *base, *extra), lambda p: p.isNotNull()), 1, 5)


def direct_domain(name: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", ""), F.lit(".com"))


def proposal_slug(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit('"'), F.lit("")))
