"""Worked examples and reference measures on small inline frames."""

import re
from datetime import datetime, timedelta
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from cellarmark import rules
from cellarmark.functions import documents, names, similarity, web
from cellarmark.functions.columns import clean_null, iso_to_registry_text, registry_date
from cellarmark.operators import contacts, learning, permits, ranking, request_log, upserts
from cellarmark.operators.sliced import row_numbers


def values(spark, rows, schema, *cols):
    out = spark.createDataFrame(rows, schema).select(*cols).collect()
    return [tuple(r) if len(cols) > 1 else r[0] for r in out]


def test_missing_values(spark):
    assert values(spark, [("",), ("nan",), (" NaN ",), (" x ",)], "c string", clean_null(F.col("c"))) == [None, None, None, "x"]


def test_dates(spark):
    c = F.col("c")
    got = values(spark, [("3/7/1999",), ("bad",), ("",)], "c string", registry_date(c).cast("string"))
    assert got == ["1999-03-07", None, None]
    assert values(spark, [("1999-03-07",), ("3/7/1999",)], "c string", iso_to_registry_text(c)) == ["3/7/1999", "3/7/1999"]


def test_permit_conversion(spark):
    got = values(spark, [("DSP-TX-20010",), ("BWN-CA-21001",), ("BR-CA-1",), ("DSP-TX",)], "p string", permits.converted_permit(F.col("p")))
    assert got == ["TX-S-20010", "CA-W-21001", None, None]


def test_ratio_is_difflib_and_bound_holds(spark):
    pairs = [("RED OAK", "RED OAKS"), ("ABCD", "DCBA"), ("JACK DANIELS", "JACK DANIEL"), ("", "A"), ("AAAA", "AA"), ("1220 SPIRITS", "SPIRITS 1220")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select("a", "b", similarity.ratcliff_ratio("a", "b").alias("r"), similarity.ratio_upper_bound(F.col("a"), F.col("b")).alias("u")).collect()
    for r in got:
        assert abs(r["r"] - SequenceMatcher(None, r["a"], r["b"]).ratio()) < 1e-12
        assert r["r"] <= r["u"] + 1e-12


def test_core_brand(spark):
    cases = {
        "JACK'S PREMIUM": "Jack",
        "HEAVEN HILL DISTILLERY": "Heaven Hill",
        "JACK DANIELS NO 7": "Jack Daniels No",  # the greedy group keeps NO
        "KIRKLAND SIGNATURE BOURBON": "Kirkland",  # SIGNATURE is itself a product word
        "THE OLD FOX": "Old Fox",
        "": "",
    }
    got = values(spark, [(k,) for k in cases], "n string", names.core_brand(F.col("n")))
    assert got == list(cases.values())


def test_variation_types(spark):
    cases = [
        ("FOX 2019", "FOX 2020", "year_variation"), ("FOX CALIFORNIA", "FOX", "location_variation"), ("FOX SPIRITS", "FOX", "suffix_variation"),
        ("FOX WHISKEY CO", "FOX WHISKY CO", "abbreviation"), ("FOX RESERVE OAK", "FOX OAK", "special_edition"), ("FOX", "OWL", None), ("Fox", "FOX", "exact"),
    ]
    a, b = F.col("a"), F.col("b")
    got = values(spark, [c[:2] for c in cases], "a string, b string", names.variation_type(a, b), F.arrays_overlap(names.variation_keys(a), names.variation_keys(b)))
    assert [g[0] for g in got] == [c[2] for c in cases]
    # every rule-based pair shares a blocking key
    assert all(shared for (kind, shared) in got if kind)


def test_numeric_domain_match(spark):
    got = values(spark, [("1220 SPIRITS", "1220spirits.com"), ("FOX", "1.com")], "n string, d string", web.numbers_match(F.col("n"), F.col("d")))
    assert got == [True, False]


def test_redirects_and_domains(spark):
    import base64

    target = "https://www.fox-oak.com/a?b=1"
    token = base64.urlsafe_b64encode(target.encode()).decode().rstrip("=")
    rows = [(f"https://www.bing.com/ck/a?p=1&u=a1{token}&ntb=1",), (target,), ("https://www.bing.com/ck/a?p=1&u=a1%%%",)]
    got = values(spark, rows, "u string", web.decode_redirect(F.col("u")))
    assert got == [target, target, rows[2][0]]
    assert values(spark, rows[1:2], "u string", web.domain_of(F.col("u")), web.domain_base(web.domain_of(F.col("u")))) == [("fox-oak.com", "FOX OAK")]


def test_redirect_token_with_line_breaks(spark):
    target = "https://www.fox-oak.com/en/7662?utm_source=feed&page=1&and=some-more-of-it"
    # base64() breaks its lines after 76 characters, unpadded lengths of all remainders
    token = F.translate(F.regexp_replace(F.base64(F.encode("u", "utf-8")), "=+$", ""), "+/", "-_")
    wrapped = F.concat(F.lit("https://www.bing.com/ck/a?p=1&u=a1"), token, F.lit("&ntb=1"))
    targets = [target[:n] for n in range(50, len(target) + 1)]
    assert values(spark, [(t,) for t in targets], "u string", web.decode_redirect(wrapped)) == targets


def test_documents_in_all_shapes(spark):
    rows = [
        ('{"url": "http://a.com", "confidence": 0.5}', None), ('{"website": {"url": "http://b.com", "verified": true}}', None), ("{broken", "http://c.com"),
        (None, '{"url": "http://d.com", "verification_status": "verified"}'), (None, None),
    ]
    s = documents.site_columns(F.col("e"), F.col("w"))
    got = values(spark, rows, "e string, w string", s["url"], s["has_website"], s["any_verified"])
    assert got == [("http://a.com", True, False), ("http://b.com", True, True), (None, True, False), (None, True, True), (None, False, False)]


def score(spark, owner, classes, skus, countries, url, recent):
    created = "2001-12-01" if recent else "1990-01-01"
    doc = '{"url": "http://x.com"}' if url else None
    brands = spark.createDataFrame(
        [("B", countries, classes, skus, created, created, doc, None)],
        "brand_name string, countries array<string>, class_types array<string>, sku_count long, created_date string, updated_at string, enrichment_data string, website string",
    ).withColumns({"created_date": F.to_date("created_date"), "updated_at": F.to_date("updated_at")})
    tier = "importer" if owner else "brand_permit"
    held = spark.createDataFrame([("B", "CA-I-1", tier, owner, None)], "brand_name string, permit_no string, tier string, owner_name string, operating_name string")
    r = ranking.priority_scores(brands, ranking.holder_flags(held), F.lit("2002-01-01").cast("date")).first()
    return r["score"], r["tier"]


def test_published_score_examples(spark):
    assert score(spark, "MHW LTD", ["SINGLE MALT SCOTCH WHISKY"], 5, ["A"], True, False) == (100, 1)
    assert score(spark, "ACME", ["VODKA"], 3, ["A"], True, False) == (72, 2)
    assert score(spark, "ACME", ["TABLE RED WINE"], 2, ["A", "B"], False, True) == (52, 3)
    assert score(spark, None, ["VODKA"], 1, ["A"], False, False) == (33, 4)


def test_upsert_is_idempotent_and_last_row_wins(spark):
    old = spark.createDataFrame([("1", "A", "d0"), ("2", "B", "d0")], "ttb_id string, brand_name string, added_date string")
    batch = spark.createDataFrame([("2", "X", "d1", 1), ("2", "Y", "d1", 2), ("3", "C", "d1", 3)], "ttb_id string, brand_name string, added_date string, ord int")
    once = upserts.upsert(old, batch, "ttb_id", "ord", keep=("added_date",))
    rows = {r["ttb_id"]: (r["brand_name"], r["added_date"], r["change_type"]) for r in once.collect()}
    assert rows == {"1": ("A", "d0", "unchanged"), "2": ("Y", "d0", "updated"), "3": ("C", "d1", "new")}
    twice = upserts.upsert(once.drop("change_type"), batch, "ttb_id", "ord", keep=("added_date",))
    assert sorted(map(tuple, twice.drop("change_type").collect())) == sorted(map(tuple, once.drop("change_type").collect()))


def test_rekey_keeps_every_label(spark):
    skus = spark.createDataFrame([("1", "A"), ("2", "A 2"), ("3", "B")], "ttb_id string, brand_name string")
    mapping = spark.createDataFrame([("A 2", "A"), ("A", "A")], "brand_name string, canonical_name string")
    got = upserts.rekey_skus(skus, mapping).collect()
    assert len(got) == 3 and {r["ttb_id"]: r["brand_name"] for r in got} == {"1": "A", "2": "A", "3": "B"}


def test_sliced_row_number_equals_plain(spark):
    from pyspark.sql import Window

    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).alias("o"), "id")
    sliced = row_numbers(df, ["g"], [F.col("o"), F.col("id")], F.floor(F.col("o") / 10))
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")).cast("long"))
    assert sorted(map(tuple, sliced.select("id", "rn").collect())) == sorted(map(tuple, plain.select("id", "rn").collect()))


def test_streaks_and_trailing_counts_by_brute_force(spark):
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(minutes=(i * 17) % 400), i % 2, (i * 7) % 5 > 1, 1.0) for i in range(120)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, service long, ok boolean, latency double")
    got = {r["event_id"]: r["failure_streak"] for r in request_log.failure_streaks(log, F.date_trunc("hour", "ts")).collect()}
    counts = {r["event_id"]: r["n"] for r in request_log.trailing_counts(log, 3600, "n").collect()}
    for service in (0, 1):
        streak = 0
        mine = sorted((r for r in rows if r[2] == service), key=lambda r: (r[1], r[0]))
        for r in mine:
            streak = 0 if r[3] else streak + 1
            assert got[r[0]] == streak
            assert counts[r[0]] == sum(1 for x in mine if r[1] - timedelta(hours=1) < x[1] <= r[1])


def test_pattern_fold_by_brute_force(spark):
    base = datetime(2024, 1, 1)
    rows = [(f"p{i % 3}", base + timedelta(hours=i), i, (i * i) % 7 < 4, 0.9, base + timedelta(days=i // 24)) for i in range(200)]
    steps = spark.createDataFrame(rows, "pattern string, ts timestamp, event_id long, success boolean, start double, slice timestamp")
    want = {}
    for p, _, _, ok, start, _ in rows:
        c = want.get(p, start)
        want[p] = min(c + 0.05, 1.0) if ok else max(c - 0.1, 0.1)
    got = {r["pattern"]: r["confidence"] for r in learning.pattern_fold(steps).collect()}
    assert got == {p: round(v, 6) for p, v in want.items()}


def test_relevance_terms_match_plain_regex(spark):
    text = "Our craft gin house and brewhouse: bourbon aged in oak, single malt, café spirits. The Oak farm company"
    df = spark.createDataFrame([("B", "http://x.com", "T", text)], "brand_name string, url string, title string, snippet string")
    got = {(r["term_type"], r["term"]) for r in learning.relevance_terms(df).collect()}
    low, want = f"http://x.com T {text}".lower(), set()
    for p in rules.DESCRIPTOR_PATTERNS:
        want |= {("product_descriptor", m) for m in re.findall(p, low) if len(m) > 2 and m not in rules.GATE_PRODUCTS + rules.GATE_FACILITIES}
    for p in rules.FACILITY_PATTERNS:
        want |= {("facility_type", m) for m in re.findall(p, low) if len(m) > 2 and m not in rules.GATE_FACILITIES}
    assert got == want


def test_people(spark):
    text = "Founded by John Smith in 1999. Mary Ann Jones, CEO, and master distiller: Bob O Hill Group"
    df = spark.createDataFrame([(1, text), (2, "Founded by JOHN SMITH.")], "doc_id long, text string")
    m = contacts.person_mentions(df, "text", "doc_id")
    people = {r["name_key"]: (r["mention_count"], r["confidence"]) for r in contacts.consolidate_people(m).collect()}
    assert any(k.startswith("john smith") for k in people)
    assert values(spark, [("CEO",), ("Import Manager",), ("Clerk",)], "t string", contacts.contact_relevance(F.col("t"))) == [100, 80, 50]


def test_contact_matching_stages(spark):
    brands = spark.createDataFrame([("CHATEAU EXAMPLE WINES",), ("RED FOX",), ("OAK HILL",)], "brand_name string")
    listed = spark.createDataFrame([("RED FOX",), ("Red Foxx",), ("EXAMPLE",), ("NOBODY",)], "company_name string")
    # 'Red Foxx' shares only the word RED with its brand
    got = {r["company_name"]: (r["brand_name"], r["stage"]) for r in contacts.match_contacts(listed, brands).collect()}
    assert got == {"RED FOX": ("RED FOX", "exact"), "Red Foxx": ("RED FOX", "fuzzy"), "EXAMPLE": ("CHATEAU EXAMPLE WINES", "contains")}
    assert [r[0] for r in contacts.unmatched_contacts(listed, contacts.match_contacts(listed, brands)).collect()] == ["NOBODY"]
