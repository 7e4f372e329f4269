"""Every check on hand-made pages: one report per case, all cases in one job."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pageloom.operators import audit
from pageloom.operators.facts import page_facts
from pageloom.plans.schema import PAGES, SITE_AUX

AS_OF = datetime(2024, 6, 1)
LONG = "Looms weave plain data into readable reports for busy people everywhere " * 40
LEAD = "Our workshop repairs old looms and ships them to schools across the whole country."
ANSWER = " ".join(["word"] * 40) + "."
FULL_HEAD = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><link rel="canonical" href="https://a.example/x">'
    '<meta name="viewport" content="width=device-width"><meta property="og:title" content="t"><link rel="icon" href="/f">'
    '<script type="application/ld+json">{"@type":"Organization","name":"Loom Co","sameAs":["https://x.com/l",'
    '"https://y.com/l"]}</script><script defer src="/a.js"></script></head><body><h1>Loom</h1><h2>Next</h2>'
    '<img src="a.webp" alt="a" width="1" height="1" loading="lazy"><time datetime="2024-05-20">May</time></body></html>')
MD = (f"{LEAD}\n\n## Key takeaways\n\n- one\n- two\n- three\n\n## Prices\n\n{ANSWER}\n\nGrowth was 40% and 12 percent, $49 each. "
      f"See [x](https://en.wikipedia.org/wiki/Loom).\n\n### Why us?\n{LONG}")


def page(**kw):
    base = dict(source_url="https://a.example/x", status_code=200, title="A title of good length", description="d" * 100,
                language="en", markdown=MD, html=None, raw_html=FULL_HEAD)
    return base | kw


def md(text):
    return page(markdown=text)


def raw(html):
    return page(raw_html=html)


def aux(**kw):
    base = dict(root_url="https://a.example/", robots_fetched=None, robots_txt=None, sitemap_found=None, llms_txt_found=None,
                headers_fetched=None, headers=None, root_html=None, gtm_body=None)
    return base | kw


def hdr(**h):
    return aux(headers_fetched=True, headers={k.replace("_", "-"): v for k, v in h.items()})


GTM = "<script src='https://www.googletagmanager.com/gtm.js?id=GTM-ABC'></script>"
# name, pages, site inputs, expected ratios
CASES = [
    ("good", [page()], aux(), {i: 1.0 for i in (
        "S1 S2 S3 S4 S5 S10 S12 S13 S17 S18 S23 G1 G4 G5 G6 G7 G8 G11 G12 G14 G15 G18 G20 TB1 TB3 TB4 TB10 TB12 TB6 TB20 TB19 "
        "TB22").split()} | {"G19": 0.5, "S14": None, "S15": None, "S16": None, "S21": None, "G3": None, "G9": None, "T1": None, "T20": None}),
    ("bad", [page(source_url="http://a.example/", title="Home", description=None, markdown="Hi.",
                  raw_html='<html><head><meta content="noindex" name="robots"></head><h1>a</h1><h1>b</h1>')], aux(),
     {"S1": 0.0, "S2": 0.0, "S3": 0.0, "S4": 0.0, "S5": 1.0, "S18": 0.0, "TB1": 0.0, "TB4": 0.0, "TB22": 0.0, "G1": 0.0, "T1": None}),
    ("title14", [page(title="x" * 14)], aux(), {"S1": 0.0}), ("title15", [page(title=" " + "x" * 15)], aux(), {"S1": 1.0}),
    ("title60", [page(title="x" * 60)], aux(), {"S1": 1.0}), ("title61", [page(title="x" * 61)], aux(), {"S1": 0.0}),
    ("desc69", [page(description="x" * 69)], aux(), {"S2": 0.0}), ("desc160", [page(description="x" * 160)], aux(), {"S2": 1.0}),
    ("words299", [md("w " * 299)], aux(), {"S10": 0.0}), ("words300", [md("w " * 300)], aux(), {"S10": 1.0}),
    ("emptymd", [page(markdown="", html="<p>" + "w " * 400)], aux(), {"S10": 0.0}),
    ("nullmd", [page(markdown=None, html="<p>" + "w " * 400)], aux(), {"S10": 1.0, "G20": 0.0}),
    ("status", [page(status_code=404), page(status_code=503), page(status_code=301), page(status_code=None)], aux(), {"S17": 0.5}),
    ("soft404", [page(title="Page not found", markdown="gone")], aux(), {"S17": 0.0}),
    ("about404", [page(title="How to fix a 404", markdown="w " * 60)], aux(), {"S17": 1.0}),
    ("jump", [raw("<h1>a</h1><h3>b</h3>")], aux(), {"S18": 0.0}), ("nohead", [raw("<p>a")], aux(), {"S18": 0.0, "S5": 0.0, "TB20": None}),
    ("hreflang", [raw('<link rel="alternate" hreflang="zh-Hant"><link rel="alternate" hreflang="fil">')], aux(), {"S21": 1.0}),
    ("badhreflang", [raw('<link rel="alternate" hreflang="en_us">'), page()], aux(), {"S21": 0.5}),
    ("canon-none", [raw("<p>")], aux(), {"S23": 1.0, "S3": 0.0}),
    ("canon-other", [raw('<link rel="canonical" href="/y">')], aux(), {"S23": 0.0}),
    ("canon-slash", [raw('<link href="https://www.A.example/x/?q#f" rel="canonical">')], aux(), {"S23": 1.0}),
    ("canon-proto", [raw('<link rel="canonical" href="//a.example/x">')], aux(), {"S23": 1.0}),
    ("unique", [page(title="One title here", description="a"), page(title=" one TITLE here ", description="b"), page(title="Two")],
     aux(), {"S15": pytest.approx(1 / 3), "S16": 1.0}),
    ("alts", [raw('<img src=a><img src=b alt=""><img alt="c">'), raw("<p>")], aux(), {"S13": pytest.approx((2 / 3 + 1) / 2)}),
    ("stats-bare", [md("5m tall, 3x more, 7k, percentage 10 percentage")], aux(), {"G6": 0.0}),
    ("stats-pct", [md("10% and 20 percent and 3.5‰")], aux(), {"G6": 1.0}), ("stats-mix", [md("1.5m units, 250k, 3 in 10")], aux(), {"G6": 1.0}),
    ("stats-accent", [md("é10k é20k é30k")], aux(), {"G6": 1.0}),
    ("lead-heading", [md("# Title\n" + LEAD)], aux(), {"G4": 0.0}), ("lead-skip", [md("- item\n> q\n1. a\nshort\n" + LEAD)], aux(), {"G4": 1.0}),
    ("lead-long", [md("x" * 401 + ".")], aux(), {"G4": 0.0}), ("lead-nodot", [md("x" * 80)], aux(), {"G4": 0.0}),
    ("lead-59", [md("*" * 5 + "x" * 58 + ".")], aux(), {"G4": 0.0}), ("lead-late", [md("short\n" * 30 + LEAD)], aux(), {"G4": 1.0}),
    ("section-filler", [md("## A\nThis " + ANSWER + "\n## B\nТова " + ANSWER + "\n## C\nItem " + ANSWER)], aux(), {"G19": pytest.approx(1 / 3)}),
    ("section-sub", [md("## A\n### sub\n" + ANSWER + "\n## B\n- skip\n" + ANSWER)], aux(), {"G19": 0.5}),
    ("takeaway-bg", [md("# x\n## Ключови изводи\n- a")], aux(), {"G20": 1.0}), ("takeaway-word", [md("## Summaryx\n- a")], aux(), {"G20": 0.0}),
    ("takeaway-late", [md("w" * 600 + "\n## Summary\n- a")], aux(), {"G20": 0.0}), ("takeaway-bare", [md("## Summary\ntext")], aux(), {"G20": 0.0}),
    ("lists", [md("- a\n- b")], aux(), {"G14": 0.0}), ("table", [md("| a |\n| b |")], aux(), {"G14": 1.0}),
    ("cite-self", [page(source_url="https://www.mit.edu/a", markdown="[a](https://mit.edu/b)")], aux(), {"G15": 0.0}),
    ("cite-gov", [md("[a](https://data.gov.uk/b)")], aux(), {"G15": 1.0}), ("cite-fake", [md("[a](https://notft.com/b)")], aux(), {"G15": 0.0}),
    ("fresh-old", [raw('"dateModified": "2020-01-01"')], aux(), {"G7": 0.1}), ("fresh-bad", [raw('"dateModified": "soon"')], aux(), {"G7": 0.3}),
    ("fresh-hint", [raw("Last updated")], aux(), {"G7": 0.3}), ("fresh-none", [raw("<p>")], aux(), {"G7": 0.0}),
    ("fresh-mid", [raw('"datePublished":"June 2, 2023"')], aux(), {"G7": pytest.approx(1 - (365 - 90) / 640 * 0.9)}),
    ("brand", [page(title="x", raw_html='<meta property="og:site_name" content="Loom"> {"@type":"Organization","name":"Loom Co"}'),
               page(title="x", raw_html='<meta content="Other" property="og:site_name">')], aux(), {"G17": 0.75}),
    ("brand-clash", [raw('<meta property="og:site_name" content="Abc">{"@type":"Organization","name":"Xyz"}')], aux(), {"G17": 0.3}),
    ("sameas-one", [raw('"sameAs":["https://x.com/a"]')], aux(), {"G18": 0.0, "G8": 1.0}),
    ("sameas-wiki", [raw('"sameAs" : ["https://www.wikidata.org/a"]')], aux(), {"G18": 1.0}),
    ("typed", [raw('"@type":"Article" "author":1 "datePublished":2')], aux(), {"G11": 1.0}), ("untyped", [raw('"@type":"Article"')], aux(), {"G11": 0.0}),
    ("mixed", [raw('<img src="http://a/b"><link rel="stylesheet" href="http://c"><a href="http://d">')], aux(), {"TB3": 0.0}),
    ("anchor-only", [raw('<a href="http://d">')], aux(), {"TB3": 1.0}),
    ("charset", [raw('<meta charset="utf-8">')], aux(), {"TB10": 0.0}), ("bom", [raw("﻿ <!DOCTYPE HTML>")], aux(), {"TB22": 1.0}),
    ("blocking", [raw('<head><script src="a.js"></script></head>'), raw('<head><script type="module" src="a"></script></head>')], aux(), {"TB20": 0.5}),
    ("images", [raw('<img src="a.png"><img src="https://x.imgix.net/b" loading="lazy" width=1 height=1>')], aux(), {"TB19": 0.5, "TB6": 0.5, "S13": 0.0}),
    ("nosnippet", [raw('<meta name="robots" content="max-snippet: 0">')], aux(), {"G12": 0.0}),
    ("nosnippet-header", [page(), page()], hdr(x_robots_tag="nosnippet"), {"G12": 0.0}),
    ("robots-star", [page()], aux(robots_fetched=True, robots_txt="User-agent: *\r\nDisallow: / # all"), {"TB5": 0.0, "G9": 1.0}),
    ("robots-last", [page()], aux(robots_fetched=True, robots_txt="User-agent: *\nUser-agent: b\nDisallow: /"), {"TB5": 1.0}),
    ("robots-bot", [page()], aux(robots_fetched=True, robots_txt="user-agent: GPTBot\nDisallow: /\nUser-agent: *\nAllow: /"), {"TB5": 1.0, "G9": 0.0}),
    ("robots-path", [page()], aux(robots_fetched=True, robots_txt="User-agent: *\nDisallow: /private", sitemap_found=True, llms_txt_found=False),
     {"TB5": 1.0, "S14": 1.0, "G16": 0.0}),
    ("headers", [page()], hdr(strict_transport_security="max-age=31536000", content_security_policy="default-src; frame-ancestors 'none'",
                              x_content_type_options="NoSniff", referrer_policy="x", feature_policy="y"),
     {"TB30": 1.0, "TB31": 1.0, "TB32": 1.0, "TB33": 1.0, "TB34": 1.0, "TB35": 1.0}),
    ("headers-weak", [page()], hdr(strict_transport_security="max-age=5", content_security_policy="script-src 'unsafe-inline'", x_frame_options=" "),
     {"TB30": 0.5, "TB31": 0.5, "TB32": 0.0, "TB33": 0.0, "TB34": 0.0}),
    ("hsts-off", [page()], hdr(strict_transport_security="max-age=0"), {"TB30": 0.0, "TB31": 0.0}),
    ("tracking-inline", [raw("gtag('config','G-ABCDEFGHIJ')")], aux(), {"T1": 1.0, "T2": 1.0, "T3": None, "T5": 0.0, "T7": 0.0, "T12": 1.0}),
    ("tracking-gtm", [raw(GTM + "clarity.ms")], aux(), {"T1": None, "T3": 1.0, "T5": None, "T7": None, "T8": None, "T12": None}),
    ("tracking-container", [raw(GTM)], aux(gtm_body="gtm.start G-ABCDEFGH1 analytics_storage"), {"T1": 1.0, "T5": 1.0, "T6": 0.0, "T7": None}),
    ("tracking-firstparty", [raw("<script src='https://d.a.example/x.js?id=GTM-XYZ1'>")], aux(), {"T3": 1.0, "T7": None}),
    ("tracking-ua", [raw("ga('create','UA-12345-1'); static.hotjar.com")], aux(), {"T2": 0.0, "T1": 0.0, "T12": 0.0}),
    ("recorder-only", [raw("static.hotjar.com")], aux(), {"T1": None, "T2": None, "T12": None}),
    ("consent-v2-split", [raw("ad_user_data"), raw("ad_personalization dataLayer.push(")], aux(), {"T6": 0.0, "T15": 1.0}),
    ("order-ok", [page()], aux(root_html="gtag('consent', 'default') googletagmanager.com/gtag/js"), {"T20": 1.0, "G3": 1.0}),
    ("order-bad", [page()], aux(root_html="googletagmanager.com/gtm.js gtag('consent','default')"), {"T20": 0.0}),
    ("order-none", [page()], aux(root_html="googletagmanager.com/gtm.js"), {"T20": None}),
    ("ssr", [page(html="<p>" + "w " * 100)], aux(root_html="<script>x y z</script><p>" + "w " * 30), {"G3": 0.5}),
    ("ssr-tiny", [page(html="<p>one two")], aux(root_html="<p>"), {"G3": 1.0}),
    ("ssr-home", [page(source_url="https://b.example/", html="<p>" + "w " * 100), page(html="<p>one two")], aux(root_html="<p>x"), {"G3": 1.0}),
    ("no-url", [page(source_url=None)], aux(), {"TB1": 1.0, "S23": 0.0}),
    ("no-url-http", [page(source_url=None)], aux(root_url="http://a.example/"), {"TB1": 0.0}),
]


@pytest.fixture(scope="module")
def tables(spark):
    pages, sites = [], []
    for name, rows, site, _ in CASES:
        for i, p in enumerate(rows):
            pages.append((name, i, p["source_url"], p["status_code"], p["title"], p["description"], p["language"], p["markdown"],
                          p["html"], p["raw_html"], None))
        sites.append((name, *site.values()))
    facts = page_facts(spark.createDataFrame(pages, PAGES)).cache()
    return facts, spark.createDataFrame(sites, SITE_AUX).cache()


@pytest.fixture(scope="module")
def ratios(tables):
    facts, site = tables
    return {(r.report_id, r.check_id): r.ratio for r in audit.check_results(facts, site, AS_OF).collect()}


@pytest.mark.parametrize("name,expected", [(c[0], c[3]) for c in CASES], ids=[c[0] for c in CASES])
def test_ratios(ratios, name, expected):
    assert {k: ratios[(name, k)] for k in expected} == expected


def test_every_report_has_58_checks(ratios):
    assert len(ratios) == 58 * len(CASES)


def test_reasons(tables):
    facts, site = tables
    rows = audit.page_failures(facts, site).withColumn("t", audit.reason_text(F.col("reason"))).collect()
    text = {(r.report_id, r.check_id): r.t for r in rows}
    assert text[("title14", "S1")] == "too short (14 < 15)"
    assert text[("title61", "S1")] == "too long (61 > 60)"
    assert text[("jump", "S18")] == "heading level h1 jumps to h3 (skipped h2)"
    assert text[("badhreflang", "S21")] == "invalid hreflang value 'en_us'"
    assert text[("canon-other", "S23")] == "canonical mismatch (expected /x, got /y)"
    assert text[("mixed", "TB3")] == "found 2 insecure http:// sub-resources on an HTTPS page (expected 0)"
    assert text[("charset", "TB10")] == "missing <html lang>"
    assert len([r for r in rows if r.report_id == "nosnippet-header" and r.check_id == "G12"]) == 2


def test_order_of_partitions_does_not_matter(tables, ratios):
    facts, site = tables
    shuffled = facts.repartition(7, "title_len").orderBy(F.desc("page_ord"))
    again = {(r.report_id, r.check_id): r.ratio for r in audit.check_results(shuffled, site, AS_OF).collect()}
    assert {k: v and round(v, 9) for k, v in again.items()} == {k: v and round(v, 9) for k, v in ratios.items()}


def test_evidence_is_capped_and_deduplicated(spark):
    rows = [("r", i, f"https://a.example/p{i:02d}", 200, "Home", None, None, "x", None, None, None) for i in range(14)]
    rows += [("r", 20, "https://a.example/p00/", 200, None, None, None, "x", None, None, None)]
    fails = audit.page_failures(page_facts(spark.createDataFrame(rows, PAGES)))
    ev = {r.check_id: r for r in audit.evidence(fails, limit=12).collect()}
    assert [f.path for f in ev["S1"].failing] == [f"/p{i:02d}" for i in range(12)]
    assert ev["S1"].more == 2
    assert ev["S1"].failing[0].reason.kind == "too_short"  # the first page of a path decides
    assert audit.pages_with_issues(fails).first().pages_with_issues == 14
