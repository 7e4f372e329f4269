"""Addresses, domains, contract, redaction, page picks."""

import json

import pytest
from pyspark.sql import functions as F

from pageloom.functions import network, urls
from pageloom.operators import contract, sampling


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_private_addresses(spark):
    private = ["0.0.0.0", "10.1.2.3", "127.0.0.1", "169.254.169.254", "172.16.0.1", "172.31.255.255", "192.168.1.1", "100.64.0.1",
               "192.0.0.8", "224.0.0.1", "255.255.255.255", "::1", "::", "fe80::1", "fd00::1", "::ffff:10.0.0.1", "nonsense", "", "1.2.3",
               "300.1.1.1", "01.2.3.4", "1:2:3"]
    public = ["8.8.8.8", "172.15.0.1", "172.32.0.1", "100.128.0.1", "192.0.2.1", "2606:4700::1111", "::ffff:8.8.8.8", "1:2:3:4:5:6:7:8"]
    assert column(spark, private, network.is_private_ip) == [True] * len(private)
    assert column(spark, public, network.is_private_ip) == [False] * len(public)


def test_private_hosts(spark):
    private = ["localhost", "x.localhost", "db.internal", "printer.lan", "a.home.arpa", "router", "192.0.2.9", "10.0.0.1:80", "[::1]", "fd12::1",
               "::ffff:127.0.0.1", "a.local.", ""]
    public = ["example.com", "example.com:8080", "8.8.8.8", "192.0.0.1", "2606:4700::1"]
    assert column(spark, private, network.is_private_host) == [True] * len(private)
    assert column(spark, public, network.is_private_host) == [False] * len(public)


def test_domains(spark):
    e = network.DOMAIN_ERRORS
    cases = {
        " Example.com ": "example.com", "https://www.example.co.uk/a?b": "example.co.uk", "http://u:p@example.io:8080": "example.io",
        "xn--e1aybc.xn--p1ai": "xn--e1aybc.xn--p1ai", "": e["empty"], "a" * 254: e["long"], "ftp://example.com": e["scheme"],
        "1.2.3.4": e["ip"], "https://[::1]/": e["ip"], "999.1.1.1": e["shape"], "localhost": e["local"], "a.internal": e["local"],
        "stripe": e["single"], "example.c0m": e["ending"], "-a.com": e["shape"], "a..com": e["shape"], "a b.com": e["shape"],
        "javascript://x": e["scheme"], "bücher.de": e["shape"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "typed string")
    got = {r.typed: r.domain or r.error for r in network.normalize_domains(df, "typed").collect()}
    assert got == cases


def test_redacted_urls(spark):
    texts = ["GET https://a.example/customer/42?token=x failed", "https://a.example?token=s", "https://u:p@h.example/p and http://b.example#f", "none",
             "https://plain.example", "(see 'https://a.example/x')"]
    assert column(spark, texts, urls.redacted) == [
        "GET https://a.example/[redacted] failed", "https://a.example/[redacted]", "https://h.example/[redacted] and http://b.example/[redacted]",
        "none", "https://plain.example", "(see 'https://a.example/[redacted]')"]


def test_paths_and_hosts(spark):
    u = ["https://www.A.example/x//", "https://a.example", "http://a.example/p?q#f", "about:x", "", "https://a.example/" + "p" * 300]
    assert column(spark, u, urls.path_of) == ["/x", "/", "/p", "about:x", "/", "/" + "p" * 300]
    assert column(spark, u, urls.host_of) == ["a.example", "a.example", "a.example", "", "", "a.example"]


def test_disposable(spark):
    assert column(spark, ["a@mailinator.com", "a@b@YOPMAIL.com ", "a@example.com", "mailinator.com"], contract.is_disposable) == [True, True, False, False]


def doc(**kw):
    dims = [{"id": i, "label": i, "score": 1, "rawScore": 1.5, "capped": False, "checks": [
        {"id": "c", "ratio": None, "evidence": {"where": "w", "failing": [{"path": "/a"}]}}]} for i in ("seo", "tracking", "geo", "tech")]
    base = {"overall": 50, "grade": "D", "capped": False, "dimensions": dims, "actionPlan": [{"checkId": "a", "finding": "b", "severity": "low"}],
            "pages": [{"path": "/a"}], "more": {"kept": True}}
    return {k: v for k, v in (base | kw).items() if v != "drop"}


@pytest.mark.parametrize("payload,tier,broken", [
    (doc(), "strict", []), (json.dumps(doc()), "strict", []), (doc(pages="drop"), "strict", []), (doc(pages=[{"path": "/b"}]), "minimal", ["mirror"]),
    (doc(overall=101), "minimal", ["overall"]), (doc(overall="50"), "rejected", ["overall"]), (doc(grade="drop"), "minimal", ["grade"]),
    (doc(capped=1), "minimal", ["capped"]), (doc(dimensions=[]), "minimal", ["dimensions"]), (doc(actionPlan="drop"), "rejected", ["actionPlan"]),
    (doc(pages=[{"path": "/a"}, {"path": "/x‮"}]), "minimal", ["pages"]), (doc(pages=[{"path": "/a"}, {"path": "/x​"}]), "minimal", ["pages"]),
    (doc(pagesWithIssues=-1), "minimal", ["pagesWithIssues"]), (doc(pagesExcluded=1.5), "minimal", ["pagesExcluded"]),
    (doc(pagesFailed=[{"path": "/z", "reason": "403"}]), "minimal", ["pagesFailed"]), (doc(pages=None), "minimal", ["pages"]),
])
def test_result_tiers(spark, payload, tier, broken):
    df = spark.createDataFrame([(json.dumps(payload),)], "raw string")
    row = contract.validate_results(df, "raw").first()
    assert (row.tier, row.violations) == (tier, broken)


def test_unreadable_results(spark):
    df = spark.createDataFrame([("no json",), (None,), ("[1]",)], "raw string")
    assert [r.tier for r in contract.validate_results(df, "raw").collect()] == ["rejected"] * 3


def test_field_redaction_at_any_depth(spark):
    df = spark.createDataFrame([(([{"path": "/a"}], "https://x", [([1, 2], "k")]), "keep", "u")],
                               "extra struct<pages:array<map<string,string>>,sourceURL:string,list:array<struct<failing:array<int>,id:string>>>, note string, rootUrl string")
    row = contract.redact_fields(df).first()
    assert row.extra.pages == "[scrubbed] (1 entries)" and row.extra.sourceURL == "[scrubbed] (9 chars)"
    assert row.extra.list[0].failing == "[scrubbed] (2 entries)" and row.extra.list[0].id == "k"
    assert row.note == "keep" and row.rootUrl == "[scrubbed] (1 chars)"


def test_page_pick(spark):
    urls_ = ["https://a.example/", "https://www.a.example/pricing", "https://a.example/blog/x", "https://a.example/about#team", "https://a.example/about",
             "https://b.example/pricing", "https://a.example/admin/x", "https://a.example/deep/er/path"] + [f"https://a.example/p{i}" for i in range(12)]
    links = spark.createDataFrame([("r", i, u) for i, u in enumerate(urls_)], "report_id string, link_ord int, url string")
    roots = spark.createDataFrame([("r", "https://a.example/")], "report_id string, root_url string")
    picks = [r.url for r in sampling.pick_pages(links, roots, size=10).orderBy("pos").collect()]
    assert len(picks) == 10
    assert picks[:3] == ["https://a.example/", "https://www.a.example/pricing", "https://a.example/about#team"]
    assert picks[3:] == [f"https://a.example/p{i}" for i in range(7)]
    assert sampling.excluded_counts(links, roots).first().pages_excluded == 1


def test_failed_pages(spark):
    sub = spark.createDataFrame([("r", i, f"https://a.example/{p}") for i, p in enumerate(["a", "b", "c", "d"])], "report_id string, url_ord int, url string")
    ret = spark.createDataFrame([("r", 0, "https://a.example/a", 200, "x", None, None), ("r", 1, "https://a.example/b", 503, "", None, None),
                                 ("r", 2, "https://a.example/c/", None, None, None, None)],
                                "report_id string, page_ord int, source_url string, status_code int, html string, raw_html string, markdown string")
    strict = {r.path: r.reason for r in sampling.failed_pages(sub, ret, content_only=True).collect()}
    assert strict == {"/b": "5xx", "/c": "no-content", "/d": "timeout"}
    assert {r.path: r.reason for r in sampling.failed_pages(sub, ret).collect()} == {"/d": "timeout"}
