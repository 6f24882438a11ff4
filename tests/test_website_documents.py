"""Website documents against a step-by-step fold of the same events."""

import datetime as dt
import json
import random

from cellarmark.operators.upserts import website_documents

EVENTS = "brand_name string, user_action string, document string, reason string, ts timestamp, event_id long"
START = dt.datetime(2024, 1, 1)


def folded(events, initial):
    """The documents after applying each event in order."""
    docs = {b: json.loads(t) for b, t in initial.items() if t}
    for b, action, document, reason, ts, _ in sorted(events, key=lambda e: (e[4], e[5])):
        docs.setdefault(b, None)
        site = (docs[b] or {}).get("website")
        stamp = ts.isoformat(timespec="microseconds")
        if action == "set_website":
            docs[b] = {**(docs[b] or {}), "website": json.loads(document)}
        elif action == "set_enrichment":
            docs[b] = json.loads(document)
        elif site is not None and action == "rejected":
            docs[b] = None
        elif site is not None and action == "verified":
            site.update(verification_status="verified", confidence=1.0, needs_review=False, verified_date=stamp)
        elif site is not None and action == "flagged":
            site.update(verification_status="flagged", needs_review=True, flag_reason=reason or "Manual review requested", flagged_date=stamp)
    fields = ("url", "verification_status", "confidence", "needs_review", "verified_date", "flag_reason", "flagged_date")
    return {b: tuple(((d or {}).get("website") or {}).get(f) for f in fields) for b, d in docs.items()}


def test_random_events_equal_the_fold(spark):
    rng = random.Random(3)
    events = []
    for n in range(400):
        action = rng.choice(["verified", "flagged", "set_website", "set_enrichment", "rejected", "opened"])
        site = {"url": f"u{n}", "confidence": round(rng.random(), 3), "needs_review": n % 2 == 0}
        document = {"set_website": site, "set_enrichment": {"website": site} if n % 3 else {"rating": n}}.get(action)
        when = START + dt.timedelta(seconds=rng.randrange(300), microseconds=rng.randrange(3))
        events.append((f"B{rng.randrange(60)}", action, json.dumps(document) if document else None, rng.choice([None, "", "odd"]), when, n))
    initial = {f"B{n}": json.dumps({"website": {"url": f"old{n}", "verification_status": "pending", "flag_reason": "before"}}) if n % 2 else None for n in range(0, 70)}
    given = spark.createDataFrame(list(initial.items()), "brand_name string, enrichment_data string")
    rows = website_documents(spark.createDataFrame([*events, *events[:20]], EVENTS), ["ts", "event_id"], given).drop("base_document").collect()
    want = folded(events, initial)
    assert {r[0]: tuple(r[1:]) for r in rows} == want


def test_odd_documents(spark):
    def states(*events):
        made = [(b, a, d, None, None if s is None else START + dt.timedelta(seconds=s), n) for n, (b, a, d, s) in enumerate(events)]
        return {r["brand_name"]: (r["url"], r["verification_status"]) for r in website_documents(spark.createDataFrame(made, EVENTS), ["ts", "event_id"]).collect()}

    got = states(
        ("broken", "set_website", '{"url": ', 1), ("broken", "verified", None, 2), ("none", "verified", None, 1),
        ("timeless", "set_website", '{"url": "t"}', None), ("timeless", "verified", None, 1), ("empty", "set_website", "", 1), (None, "set_website", '{"url": "n"}', 1),
    )
    assert got == {"broken": (None, None), "none": (None, None), "timeless": ("t", "verified"), "empty": (None, None), None: ("n", None)}
    assert states() == {}
