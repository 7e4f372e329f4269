"""Site-level signals: tag detectors over page source, robots.txt, tag-container and header rules.

Detectors are mostly lists of literals, so they are byte searches on the lower-cased source; regular expressions are
kept for the few signatures that need one and are only tried where a literal they contain occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import any_of, found, found_all, matches, plain_space, trimmed

# Signatures (lower case) of each detector.
ANALYTICS = [
    "googletagmanager.com/gtag", "plausible.io/js", "cdn.usefathom.com", "_paq.push", "static.cloudflareinsights.com",
    "adobedtm.com", ".omtrdc.net", "appmeasurement", "cdn.segment.com", "cdn.heapanalytics.com", ".amplitude.com",
    "mixpanel.com", "cdn.mxpanel", "simpleanalyticscdn.com", "umami.is", "pirsch.io",
]
BANNERS = [
    "cookiebot", "onetrust", "cookielaw.org", "usercentrics", "cookieyes", "iubenda", "didomi", "termly", "trustarc",
    "complianz", "axeptio", "klaro", "cookiefirst", "consentmanager.net", "quantcast", "sourcepoint", "osano",
    "tarteaucitron", "__tcfapi", "cookie-law-info", "cookielawinfo", "borlabs-cookie", "moove_gdpr", "cmplz",
    "real-cookie-banner", "cookie-notice", "cookieconsent", "cookie-consent", "cky-consent",
]
PIXELS = [
    "fbevents.js", "connect.facebook.net", "snap.licdn.com", "_linkedin_partner_id", "analytics.tiktok.com",
    "bat.bing.com", "s.pinimg.com/ct", "pintrk(", "redditstatic.com", "static.ads-twitter.com", "sc-static.net",
    "snaptr(", "q.quora.com", "criteo.com", "criteo.net", "amazon-adsystem.com", "cdn.taboola.com", "outbrain.com",
]
RECORDERS = [
    "clarity.ms", "static.hotjar.com", "_hjsettings", "window.clarity", "mouseflow", "fullstory.com", "crazyegg",
    "posthog", "logrocket", "smartlook", "inspectlet", "luckyorange", "contentsquare", "glassbox",
    "visualwebsiteoptimizer", "quantummetric", "sessioncam",
]
AI_CRAWLERS = [
    "gptbot", "oai-searchbot", "chatgpt-user", "claudebot", "claude-searchbot", "claude-web", "anthropic-ai",
    "perplexitybot", "perplexity-user", "google-extended", "ccbot", "applebot-extended", "amazonbot",
    "meta-externalagent", "bytespider",
]
CONTAINER_PIXELS = r"(?i)fbevents|connect\.facebook|bat\.bing|analytics\.tiktok|snap\.licdn|_linkedin_partner_id"

DETECTORS = ["ga4", "gtm", "consent", "consent_v2", "cmp", "pixels", "data_layer", "ua", "recorder"]


def page_detectors(src: Column, low: Column) -> dict[str, Column]:
    """The nine detectors of one page; ``low`` is ``lower(src)``."""

    def gated(literal: str, pattern: str) -> Column:
        return F.contains(low, F.lit(literal)) & matches(src, pattern)

    return {
        "ga4": any_of(low, ANALYTICS)
        | gated("id=g-", r"(?i)[?&]id=G-[A-Z0-9]{10}(?!\w)")
        | gated("gtag(", r"""(?i)gtag\(\s*['"]config['"]\s*,\s*['"]G-[A-Z0-9]{10}""")
        | gated("matomo.", r"(?i)(?<!\w)matomo\.(?:js|php)(?!\w)"),
        "gtm": F.contains(low, F.lit("googletagmanager.com/gtm.js")) | gated("id=gtm-", r"(?i)[?&/]id=GTM-[A-Z0-9]+"),
        "consent": gated("consent", r"""(?i)gtag\(\s*['"]consent['"]"""),
        "consent_v2": F.contains(low, F.lit("ad_user_data")) & F.contains(low, F.lit("ad_personalization")),
        "cmp": any_of(low, BANNERS),
        "pixels": any_of(low, PIXELS) | gated("rdt(", r"(?i)(?<!\w)rdt\(") | gated("twq(", r"(?i)(?<!\w)twq\("),
        "data_layer": F.contains(low, F.lit("datalayer.push("))
        | gated("datalayer", r"(?i)dataLayer\s*=\s*(?:\[|window\.dataLayer)"),
        "ua": F.contains(low, F.lit("google-analytics.com/analytics.js"))
        | gated("ua-", r"(?i)(?<!\w)UA-\d{4,}-\d+")
        | gated("ga(", r"""(?i)(?<!\w)ga\(\s*['"]create['"]"""),
        "recorder": any_of(low, RECORDERS),
    }


def container_id(src: Column) -> Column:
    return found(src, r"GTM-[A-Z0-9]+")


def container_facts(body: Column) -> Column:
    """What a tag container is configured to fire; NULL unless the body looks like one."""
    parsed = F.struct(
        F.array_distinct(found_all(body, r"G-[A-Z0-9]{8,}")).alias("ga4"),
        F.array_distinct(found_all(body, r"AW-[0-9]+")).alias("adwords"),
        matches(body, r"(?<!\w)UA-\d{4,}-\d+").alias("ua"),
        matches(body, r"analytics_storage|ad_storage").alias("consent"),
        (F.contains(body, F.lit("ad_user_data")) & F.contains(body, F.lit("ad_personalization"))).alias("consent_v2"),
        matches(body, CONTAINER_PIXELS).alias("pixels"),
    )
    return F.when(matches(body, r"(?i)google_tag_manager|gtm\.start|gtag"), parsed)


def _robots_blocks(txt: Column, agents: list[str]) -> Column:
    """Fold over the lines: the last agent line decides, a bare ``Disallow: /`` under a listed agent blocks."""
    lines = F.transform(F.split(txt, r"\r?\n"), lambda l: trimmed(F.regexp_replace(l, r"#.*\z", "")))
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("blocked"))

    def step(state: Column, line: Column) -> Column:
        agent = F.lower(trimmed(found(line, r"(?i)^user-agent:\s*(.+)\z", 1)))
        bare = matches(line, r"(?i)^disallow:\s*/\s*\z")
        return F.when(agent.isNotNull(), F.struct(agent.isin(agents).alias("inside"), state["blocked"].alias("blocked"))
        ).otherwise(F.struct(state["inside"].alias("inside"), (state["blocked"] | (state["inside"] & bare)).alias("blocked")))

    return F.aggregate(lines, start, step, lambda s: s["blocked"])


def robots_blocks_site(txt: Column) -> Column:
    return _robots_blocks(plain_space(F.coalesce(txt, F.lit(""))), ["*"])


def robots_blocks_ai(txt: Column) -> Column:
    return _robots_blocks(plain_space(F.coalesce(txt, F.lit(""))), AI_CRAWLERS)


def robots_flags(site_aux: DataFrame) -> DataFrame:
    return site_aux.select(
        "report_id",
        robots_blocks_site(F.col("robots_txt")).alias("site_blocked"),
        robots_blocks_ai(F.col("robots_txt")).alias("ai_blocked"),
    )


def merged_detectors(det: dict[str, Column], container: Column) -> dict[str, Column]:
    """Page detectors OR what the container is configured to fire."""
    has = container.isNotNull()
    out = dict(det)
    ads = (F.size(container["ga4"]) > 0) | (F.size(container["adwords"]) > 0)
    out["ga4"] = det["ga4"] | F.coalesce(has & ads, F.lit(False))
    for key in ("ua", "consent", "consent_v2", "pixels"):
        out[key] = det[key] | F.coalesce(has & container[key], F.lit(False))
    return out


def any_tracking(det: dict[str, Column]) -> Column:
    """A session recorder alone does not count as visible tracking."""
    out = F.lit(False)
    for key in DETECTORS:
        if key != "recorder":
            out = out | det[key]
    return out


def configured_score(detected: Column, verified: Column, tracking: Column, gtm: Column) -> Column:
    """1 if seen; 0 if a known container lacks it; N/A if nothing is visible or a tag manager may hide it; else 0."""
    return F.when(detected, 1.0).when(verified, 0.0).when(~tracking | gtm, F.lit(None)).otherwise(0.0)


def confidence_score(detected: Column, tracking: Column, gtm: Column) -> Column:
    return F.when(detected, 1.0).when(~tracking | gtm, F.lit(None)).otherwise(0.0)


def tracking_ratios(det: dict[str, Column], verified: Column, root_html: Column) -> dict[str, Column]:
    seen = any_tracking(det)
    gtm = det["gtm"]
    consent_at = F.regexp_instr(
        root_html, F.lit(r"""(?i)gtag\(\s*['"]consent['"]\s*,\s*['"]default['"]""")
    )
    loader_at = F.regexp_instr(root_html, F.lit(r"(?i)googletagmanager\.com/(?:gtm\.js|gtag/js)"))
    return {
        "T1": configured_score(det["ga4"], verified, seen, gtm),
        "T2": F.when(seen, F.when(det["ua"], 0.0).otherwise(1.0)),
        "T3": F.when(gtm, 1.0),
        "T5": configured_score(det["consent"], verified, seen, gtm),
        "T6": configured_score(det["consent_v2"], verified, seen, gtm),
        "T7": confidence_score(det["cmp"], seen, gtm),
        "T8": confidence_score(det["pixels"], seen, gtm),
        "T12": F.when(~seen, F.lit(None))
        .when(~det["recorder"], 1.0)
        .when(det["cmp"], 1.0)
        .when(gtm, F.lit(None))
        .otherwise(0.0),
        "T15": F.when(det["data_layer"], 1.0),
        "T20": F.when((consent_at > 0) & (loader_at > 0), F.when(consent_at < loader_at, 1.0).otherwise(0.0)),
    }


def header_ratios(fetched: Column, headers: Column) -> dict[str, Column]:
    """Checks on the response headers of the root URL; N/A when they were not fetched."""

    def value(name: str) -> Column:
        return F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(""))

    def present(name: str) -> Column:
        return trimmed(value(name)) != ""

    hsts, csp = value("strict-transport-security"), value("content-security-policy")
    age = F.coalesce(found(hsts, r"(?i)max-age=(\d+)", 1).cast("double"), F.lit(0.0))
    as_score = lambda c: F.when(c, 1.0).otherwise(0.0)
    rules = {
        "TB30": F.when(hsts == "", 0.0).when(age >= 31536000, 1.0).when(age > 0, 0.5).otherwise(0.0),
        "TB31": F.when(csp == "", 0.0).when(matches(csp, r"(?i)unsafe-inline|unsafe-eval"), 0.5).otherwise(1.0),
        "TB32": as_score(matches(value("x-content-type-options"), r"(?i)nosniff")),
        "TB33": as_score(present("x-frame-options") | matches(csp, r"(?i)frame-ancestors")),
        "TB34": as_score(present("referrer-policy")),
        "TB35": as_score(present("permissions-policy") | present("feature-policy")),
    }
    return {k: F.when(F.coalesce(fetched, F.lit(False)), v) for k, v in rules.items()}


def blocks_snippets(headers: Column) -> Column:
    value = F.coalesce(F.try_element_at(headers, F.lit("x-robots-tag")), F.lit(""))
    return matches(value, r"(?i)nosnippet|max-snippet:\s*0")
