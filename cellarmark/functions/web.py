"""URL, domain and web-result expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarmark import rules
from cellarmark.functions.columns import (
    clamp01,
    contains_any,
    count_terms,
    ends_with_any,
    join_present,
    words,
)


def domain_of(url: Column) -> Column:
    """Host of a URL (scheme optional), lower case, 'www.' removed; NULL when there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:https?://)?([^/?#]+)", 1)
    return F.nullif(F.replace(host, F.lit("www."), F.lit("")), F.lit(""))


def registered_domain(domain: Column) -> Column:
    return F.array_join(F.slice(F.split(domain, r"\."), -2, 2), ".")


def domain_similarity(url_a: Column, url_b: Column) -> Column:
    """1 same host, 0.8 same last two labels, else 0; NULL when either URL is missing."""
    a, b = domain_of(url_a), domain_of(url_b)
    last_two = lambda d: F.regexp_extract(d, r"([^.]+(?:\.[^.]+)?)$", 1)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(
        F.when(a == b, 1.0).when(last_two(a) == last_two(b), 0.8).otherwise(0.0)
    )


def domain_base(domain: Column) -> Column:
    """First label without its trade suffix, dashes as spaces, upper case."""
    first = F.element_at(F.split(domain, r"\."), 1)
    # the first listed suffix that ends the label is the one removed
    bare = None
    for suffix in rules.DOMAIN_TRADE_SUFFIXES:
        cut = F.regexp_replace(first, suffix + "$", "")
        cut = F.regexp_replace(cut, "[-_]+$", "")
        bare = F.when(first.endswith(suffix), cut) if bare is None else bare.when(first.endswith(suffix), cut)
    return F.upper(F.trim(F.regexp_replace(bare.otherwise(first), "[-_]", " ")))


def domain_brand_similarity(base: Column, name: Column, measure) -> Column:
    """1 equal, 0.9 contained, else the given two-argument measure."""
    up = F.upper(F.trim(name))
    return (
        F.when((F.coalesce(base, F.lit("")) == "") | (F.coalesce(name, F.lit("")) == ""), 0.0)
        .when(base == up, 1.0)
        .when(up.contains(base), 0.9)
        .otherwise(measure(base, up))
    )


def company_from_domain(domain: Column) -> Column:
    """Company name read off the domain: trade word moved to the end."""
    bare = domain
    for tld in (".com", ".net", ".org"):
        bare = F.replace(bare, F.lit(tld), F.lit(""))

    def strip(c: Column, *terms: str) -> Column:
        for t in terms:
            c = F.replace(c, F.lit(t), F.lit(""))
        return F.regexp_replace(c, "^[-_]+|[-_]+$", "")

    def spaced(c: Column) -> Column:
        return F.upper(F.trim(F.regexp_replace(c, "[-_.]+", " ")))

    winery = strip(bare, "winery", "wine")
    winery = F.when(winery.endswith("works"), strip(winery, "works")).otherwise(winery)
    return (
        F.when(bare.contains("brewing"), F.concat(spaced(strip(bare, "brewing")), F.lit(" BREWING")))
        .when(bare.contains("wine"), F.concat(spaced(winery), F.lit(" WINERY")))
        .when(
            bare.contains("distillery") | bare.contains("spirits"),
            F.concat(spaced(strip(bare, "distillery", "spirits")), F.lit(" DISTILLERY")),
        )
        .otherwise(spaced(bare))
    )


def decode_redirect(url: Column) -> Column:
    """Target of a search-engine redirect link; the URL itself when it is not one or does not decode.

    Line breaks inside the token, as MIME encoders set them every 76 characters, are no part of it.
    """
    token = F.regexp_replace(F.regexp_extract(url, r"[?&#]u=a1([^&]+)", 1), r"\s+", "")
    plain = F.regexp_extract(url, r"[?&#](?:u|url|q)=(https?[^&]+)", 1)
    standard = F.translate(token, "-_", "+/")
    padded = F.rpad(standard, (F.ceil(F.length(standard) / 4) * 4).cast("int"), F.lit("="))
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    is_redirect = url.contains("bing.com/ck/a")
    return (
        F.when(is_redirect & (token != "") & decoded.startswith("http"), decoded)
        .when(is_redirect & (plain != ""), F.url_decode(plain))
        .otherwise(url)
    )


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(html: Column) -> Column:
    """Visible text of a page: script and style blocks and tags removed, whole document kept."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))


def is_blocked_domain(domain: Column) -> Column:
    return contains_any(F.lower(domain), rules.BLOCKED_DOMAINS + rules.FORUM_WORDS)


def is_fast_blocked(domain: Column) -> Column:
    return contains_any(F.lower(domain), rules.FAST_BLOCKED_DOMAINS)


def _any_term(terms: Column | None, text: Column) -> Column:
    if terms is None:
        return F.lit(False)
    return F.exists(F.coalesce(terms, F.array().cast("array<string>")), lambda t: text.contains(t))


def relevance_gate(text: Column, domain: Column, name: Column, learned: Column | None = None) -> Column:
    """Strict gate: brand with context, or a facility word, or a brand word with a product word."""
    brand = F.lower(name)
    combined = F.concat_ws(" ", F.lower(domain), F.lower(text))
    context = contains_any(combined, rules.GATE_PRODUCTS + rules.GATE_FACILITIES) | _any_term(learned, combined)
    facility = contains_any(combined, rules.GATE_FACILITIES + rules.GATE_EXTRA_FACILITIES)
    product = contains_any(combined, rules.GATE_WORD_PRODUCTS)
    word_hit = F.exists(words(brand), lambda w: (F.length(w) > 2) & combined.contains(w))
    return (combined.contains(brand) & context) | facility | (product & word_hit)


def relevant_result(title: Column, snippet: Column, url: Column, domain: Column, name: Column) -> Column:
    """Looser relevance test over title, snippet and URL."""
    t, brand, dom = F.lower(title), F.lower(name), F.lower(domain)
    content = F.concat_ws(" ", t, F.lower(snippet), F.lower(url))
    has_brand = content.contains(brand) | F.exists(
        words(brand), lambda w: (F.length(w) > 3) & content.contains(w)
    )
    trade = contains_any(content, rules.RELEVANCE_TERMS)
    avoid = contains_any(content, rules.RELEVANCE_AVOID)
    keep = (
        (contains_any(dom, rules.RELEVANCE_DOMAIN_TERMS) & has_brand)
        | (trade & has_brand)
        | (trade & contains_any(content, ["official", "distillery", "brewery", "winery"]))
        | contains_any(t, ["distillery", "brewery", "winery", "spirits"])
    )
    return ~avoid & keep


def survives_website_filter(title: Column, url: Column, name: Column) -> Column:
    """Result filter of the website picker: history, brand/trade, domain, path and content tests."""
    t, brand = F.lower(title), F.lower(name)
    actual = decode_redirect(url)
    low = F.lower(actual)
    domain = domain_of(actual)
    on_topic = t.contains(brand) | contains_any(t, rules.SURVIVOR_TITLE_TERMS)
    content = contains_any(low, rules.SURVIVOR_CONTENT_TERMS) | contains_any(t, rules.SURVIVOR_CONTENT_TERMS)
    return (
        ~contains_any(t, rules.SKIP_TITLE_TERMS)
        & on_topic
        & domain.isNotNull()
        & ~contains_any(F.coalesce(domain, F.lit("")), rules.HISTORY_DOMAINS)
        & ~contains_any(low, rules.HISTORY_PATHS)
        & (low.contains(brand) | content)
    )


# --- the weighted web-result score ----------------------------------------------------------------
def domain_score(domain: Column, name: Column) -> Column:
    clean = F.replace(F.lower(domain), F.lit("www."), F.lit(""))
    glued = F.replace(F.lower(name), F.lit(" "), F.lit(""))
    key_words = F.filter(words(F.lower(name)), lambda w: F.length(w) > 2)
    base = (
        F.when(F.replace(clean, F.lit("."), F.lit("")).contains(glued), 0.9)
        .when(F.forall(key_words, lambda w: clean.contains(w)), 0.7)
        .when(F.exists(key_words, lambda w: clean.contains(w)), 0.5)
        .otherwise(0.0)
    )
    base = F.when(numbers_match(name, clean), F.greatest(base, F.lit(0.8))).otherwise(base)
    base = base + F.when(clean.endswith(".com"), 0.1).otherwise(0.0)
    return clamp01(base - F.when(ends_with_any(clean, rules.SUSPICIOUS_TLDS), 0.3).otherwise(0.0))


def numbers_match(name: Column, domain: Column) -> Column:
    brand_numbers = F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1))
    return (F.size(brand_numbers) > 0) & (brand_numbers == F.regexp_extract_all(domain, F.lit(r"(\d+)"), F.lit(1)))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


_PLACE = r"(?:distillery|brewery|winery)"
# a place noun after at least one word; the words before that cannot change whether it matches
_MAKER = r"(?U:\w)\s+" + _PLACE
_NAMED = r"\s+(?:(?U:\w)+\s+)+" + _PLACE


def _brand_patterns(brand: Column) -> tuple[Column, Column]:
    """Relation and portfolio patterns with the quoted brand built in, one alternation each."""
    q = _quoted(brand)
    relation = [
        (_MAKER + r"\s+(?:produces?|makes?|crafts?)\s+(?:the\s+)?", ""),
        ("", r"\s+(?:is\s+)?(?:made|produced|crafted|distilled|brewed)\s+(?:by|at)" + _NAMED),
        (r"(?:from|by)" + _NAMED + ".*", ""),
        ("", r".*(?:from|by)" + _NAMED),
        (_MAKER + r".*(?:flagship|premium|signature)\s+(?:brand\s+)?", ""),
    ]
    portfolio = [
        (r"(?:brands?|portfolio|products?)\s+(?:include|feature)s?\s+.*", ""),
        ("", r"\s+(?:is\s+)?(?:one\s+of\s+)?(?:our|their)\s+(?:flagship|premium|signature|main)\s+(?:brands?|products?)"),
        (r"(?:featuring|including|offering)\s+.*", r".*(?:vodka|whiskey|whisky|gin|rum|bourbon|spirits?)"),
        (r"(?:makers?\s+of|producers?\s+of|creators?\s+of)\s+.*", ""),
    ]

    def union(parts: list[tuple[str, str]]) -> Column:
        pieces: list[Column] = []
        for i, (before, after) in enumerate(parts):
            pieces += [F.lit(("|" if i else "") + "(?:" + before), q, F.lit(after + ")")]
        return F.concat(*pieces)

    return union(relation), union(portfolio)


def brand_match_score(text: Column, domain: Column, name: Column) -> Column:
    brand = F.lower(name)
    mentions = (F.length(text) - F.length(F.replace(text, brand, F.lit("")))) / F.length(brand)
    score = F.when(mentions >= 3, 0.9).when(mentions >= 2, 0.7).when(mentions >= 1, 0.5).otherwise(0.0)
    score = score + F.when(text.startswith(brand), 0.1).otherwise(0.0)
    score = F.when(text.contains(F.concat(F.lit("welcome to "), brand)), 1.0).otherwise(score)
    maker = reduce(
        lambda a, b: a | b,
        [text.contains(F.concat(brand, F.lit(s))) for s in (" distillery", " brewery", " winery")],
    )
    score = F.when(maker, F.greatest(score, F.lit(0.9))).otherwise(score)
    relation, portfolio = _brand_patterns(brand)
    present = text.contains(brand)  # every pattern contains the brand: test that first
    score = F.when(present & F.regexp_like(text, relation), F.greatest(score, F.lit(0.85))).otherwise(score)
    score = F.when(present & F.regexp_like(text, portfolio), F.greatest(score, F.lit(0.8))).otherwise(score)
    key_words = F.filter(words(brand), lambda w: F.length(w) > 2)
    found = F.size(F.filter(key_words, lambda w: text.contains(w)))
    many = (F.size(words(brand)) > 1) & (found >= F.size(key_words) * F.lit(0.7))
    score = F.when(many, F.greatest(score, F.lit(0.6))).otherwise(score)
    glued_domain = F.regexp_replace(domain, r"(?U)\W", "")
    aligned = F.exists(key_words, lambda w: glued_domain.contains(w)) & (score > 0)
    return F.least(F.lit(1.0), score + F.when(aligned, 0.2).otherwise(0.0))


def industry_score(text: Column, class_types: Column, countries: Column) -> Column:
    total = reduce(lambda a, b: a + b, [F.when(text.contains(t), w).otherwise(0.0) for t, w in rules.INDUSTRY_WEIGHTS.items()])
    hits = count_terms(text, rules.INDUSTRY_WEIGHTS)
    score = F.when(hits > 0, total / (1 + hits * 0.3)).otherwise(0.0)
    classes = F.lower(F.array_join(class_types, " "))
    bonus = None
    for triggers, terms in rules.CLASS_CONTEXT_TERMS:
        value = F.least(F.lit(0.4), count_terms(text, terms) * 0.15)
        hit = contains_any(classes, triggers)
        bonus = F.when(hit, value) if bonus is None else bonus.when(hit, value)
    score = score + F.coalesce(bonus.otherwise(0.0), F.lit(0.0))
    # countries in order: regional bonuses add up until a country is named in the text
    regional = {c: F.when(contains_any(text, t), F.lit(b)).otherwise(0.0) for cs, t, b in rules.REGION_TERMS for c in cs}

    def region_bonus(country: Column) -> Column:
        out = None
        for known, value in regional.items():
            out = F.when(country == known, value) if out is None else out.when(country == known, value)
        return out.otherwise(0.0)

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("done"))

    def step(acc: Column, country: Column) -> Column:
        low = F.lower(country)
        named = text.contains(low)
        gain = F.when(acc["done"], 0.0).when(named, 0.2).otherwise(region_bonus(low))
        return F.struct((acc["sum"] + gain).alias("sum"), (acc["done"] | named).alias("done"))

    known = F.coalesce(countries, F.array().cast("array<string>"))
    score = score + F.aggregate(known, start, step, lambda acc: acc["sum"])
    return F.least(F.lit(1.0), score)


def official_score(text: Column) -> Column:
    best = F.greatest(*[F.when(text.contains(t), w).otherwise(0.0) for t, w in rules.OFFICIAL_WEIGHTS.items()])
    visits = reduce(lambda a, b: a + b, [F.when(text.contains(t), w * 0.5).otherwise(0.0) for t, w in rules.VISIT_WEIGHTS.items()])
    return F.least(F.lit(1.0), best + visits)


def negative_score(text: Column, domain: Column, learned: Column | None = None) -> Column:
    worst = F.greatest(
        *[F.when(domain.contains(t), -w * 1.5).when(text.contains(t), -w).otherwise(0.0) for t, w in rules.NEGATIVE_WEIGHTS.items()]
    )
    learned_worst = F.when(_any_term(learned, domain), 0.8).when(_any_term(learned, text), 0.6).otherwise(0.0)
    return F.greatest(worst, learned_worst)


def context_score(text: Column, countries: Column, producers: Column, sku_count: Column) -> Column:
    none = F.array().cast("array<string>")
    country = F.when(F.exists(F.coalesce(countries, none), lambda c: text.contains(F.lower(c))), 0.3).otherwise(0.0)
    producer = F.when(F.exists(F.coalesce(producers, none), lambda p: text.contains(F.lower(p))), 0.4).otherwise(0.0)
    heritage = F.when((sku_count > 10) & contains_any(text, rules.HERITAGE_TERMS), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), country + producer + heritage)


def explain_score(domain: Column, brand: Column, industry: Column, official: Column, negative: Column, context: Column) -> Column:
    text = join_present(
        [
            F.when(domain > 0.7, "Strong domain match").when(domain > 0.4, "Partial domain match"),
            F.when(brand > 0.7, "Multiple brand mentions"),
            F.when(industry > 0.6, "High industry relevance").when(industry > 0.3, "Industry-related content"),
            F.when(official > 0.7, "Official website indicators"),
            F.when(negative > 0.5, "⚠️ Contains negative indicators"),
            F.when(context > 0.3, "Matches brand context"),
        ],
        " • ",
    )
    return F.when(text == "", "General result").otherwise(text)


# --- the two simpler confidences -----------------------------------------------------------------
def basic_confidence(name: Column, title: Column, snippet: Column, domain: Column) -> Column:
    brand, t, s, d = F.lower(name), F.lower(title), F.lower(snippet), F.lower(domain)
    long_words = F.filter(words(brand), lambda w: F.length(w) > 3)

    def add(cond: Column, value: float) -> Column:
        return F.when(cond, value).otherwise(0.0)

    total = (
        add(contains_any(d, [".com", ".net", ".org"]), 0.3)
        + F.when(d.contains(brand), 0.4).when(F.exists(long_words, lambda w: d.contains(w)), 0.2).otherwise(0.0)
        + F.when(t.contains(brand), 0.2).when(F.exists(long_words, lambda w: t.contains(w)), 0.1).otherwise(0.0)
        + add(contains_any(d, rules.FAST_INDUSTRY_TERMS), 0.2)
        + add(contains_any(t, rules.FAST_INDUSTRY_TERMS), 0.1)
        + add(contains_any(s, rules.FAST_INDUSTRY_TERMS), 0.1)
        - add(contains_any(d, rules.FAST_BAD_TERMS), 0.5)
        - add(contains_any(t, rules.FAST_BAD_TERMS), 0.3)
        + add(contains_any(d, ["official", "www"]), 0.1)
        - add(contains_any(d, rules.FAST_LISTING_TERMS), 0.2)
    )
    return clamp01(total)


def legacy_confidence(name: Column, domain: Column) -> Column:
    glued, d = F.replace(F.lower(name), F.lit(" "), F.lit("")), F.lower(domain)
    parts = words(F.lower(name))
    share = F.size(F.filter(parts, lambda w: d.contains(w))) / F.size(parts) * 0.3
    dots = F.length(d) - F.length(F.replace(d, F.lit("."), F.lit("")))
    total = (
        F.when(d.contains(glued), 0.4).otherwise(0.0)
        + F.when(contains_any(d, rules.LEGACY_SPIRIT_TERMS), 0.2).otherwise(0.0)
        + F.when(F.size(parts) > 1, share).otherwise(0.0)
        + F.when((dots == 1) & ~contains_any(d, ["blog", "shop", "store", "news"]), 0.1).otherwise(0.0)
    )
    return F.least(F.lit(1.0), total)


def category_mismatch(class_types: Column, domain: Column) -> Column:
    classes, d = F.upper(F.array_join(class_types, "\n")), F.lower(domain)
    spirits_on_wine = contains_any(classes, rules.MISMATCH_SPIRIT_CLASSES) & contains_any(d, rules.MISMATCH_WINE_DOMAINS)
    wine_on_spirits = classes.contains("WINE") & contains_any(d, rules.MISMATCH_SPIRIT_DOMAINS)
    return spirits_on_wine | wine_on_spirits


def url_features(name: Column, url: Column) -> Column:
    """Boolean and text features of a (brand, URL) pair, all as strings in a map."""
    domain = F.regexp_extract(F.lower(url), r"^https?://([^/?#]+)", 1)
    glued = F.replace(F.lower(name), F.lit(" "), F.lit(""))
    core = domain
    for tld in (".com", ".net", ".org"):
        core = F.replace(core, F.lit(tld), F.lit(""))
    flags = {
        "brand_in_domain": domain.contains(glued),
        "brand_words_in_domain": F.exists(words(F.lower(name)), lambda w: (F.length(w) > 2) & domain.contains(w)),
        "exact_brand_match": glued == core,
        "has_industry_keyword": contains_any(domain, rules.FEATURE_KEYWORDS),
        "numeric_match": numbers_match(name, domain),
        "is_social_media": contains_any(domain, rules.SOCIAL_WORDS),
        "is_marketplace": contains_any(domain, rules.MARKET_WORDS),
        "is_wiki": domain.contains("wikipedia"),
    }
    pairs: list[Column] = []
    for key, flag in flags.items():
        pairs += [F.lit(key), flag.cast("string")]
    tld = F.when(domain.contains("."), F.element_at(F.split(domain, r"\."), -1)).otherwise("unknown")
    return F.create_map(*pairs, F.lit("tld"), tld)


def selection_reasoning(domain: Column, title: Column, snippet: Column, class_types: Column) -> Column:
    d, t, s = F.lower(domain), F.lower(title), F.lower(snippet)
    none = F.array().cast("array<string>")

    def context(ct: Column) -> Column:
        low = F.lower(ct)
        return (
            F.when(low.contains("whiskey") & s.contains("whiskey"), "🥃 Matches whiskey context")
            .when(low.contains("wine") & s.contains("wine"), "🍷 Matches wine context")
            .when(low.contains("beer") & contains_any(s, ["beer", "brewery"]), "🍺 Matches beer context")
        )

    matches = F.filter(F.transform(F.coalesce(class_types, none), context), lambda x: x.isNotNull())
    head = F.filter(
        F.array(
            F.when(contains_any(d, ["distillery", "brewery", "winery", "spirits"]), "🥃 Domain suggests alcohol industry"),
            F.when(contains_any(t, ["distillery", "brewery", "spirits", "whiskey", "wine"]), "🏭 Title mentions alcohol production"),
        ),
        lambda x: x.isNotNull(),
    )
    tail = F.filter(
        F.array(
            F.when(contains_any(s, ["official", "homepage", "welcome to"]), "🌐 Appears to be official website"),
            F.when(contains_any(s, ["buy", "shop", "store", "purchase"]), "🛒 Commercial/retail site"),
        ),
        lambda x: x.isNotNull(),
    )
    text = F.array_join(F.concat(head, matches, tail), " • ")
    return F.when(text == "", "ℹ️ General information about brand").otherwise(text)


def escape_like(term: str) -> str:
    return re.sub(r"([%_\\])", r"\\\1", term)
