"""The audit in SQL, written independently of the Spark side, for comparison.

``AUDIT`` is a chain of common table expressions: crawl -> aux -> p (text layers) -> f (page verdicts) -> checks.
Patterns follow the second engine's dialect (no look-arounds).
"""

from __future__ import annotations

from pageloom.plans.rubric import AVG_IDS, CHECK_IDS, COV_IDS, DIMENSIONS, GRADES, RUBRIC, SEVERITIES
from pageloom.workload import crawl_sql, site_sql


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def m(col: str, pattern: str) -> str:
    """Case-insensitive match."""
    return f"regexp_matches({col}, {lit('(?i)' + pattern)})"


def cnt(col: str, pattern: str, flags: str = "(?i)") -> str:
    return f"len(regexp_extract_all({col}, {lit(flags + pattern)}))"


def ext(col: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({col}, {lit('(?i)' + pattern)}, {group}), '')"


Q = "[\"']"
PATH = (
    "CASE WHEN regexp_matches(url, '(?i)^https?://[^/]+') THEN coalesce(nullif(regexp_replace(regexp_extract(url, "
    "'(?i)^https?://[^/]+(/[^?#]*)?', 1), '/+$', ''), ''), '/') ELSE coalesce(nullif(url, ''), '/') END"
)


def host(col: str) -> str:
    return f"lower(regexp_replace(regexp_extract({col}, '(?i)^https?://([^/?#]+)', 1), '^www[.]', ''))"


def comparable(col: str) -> str:
    for pattern in ("(?i)^https?://", "(?i)^www[.]", "[#?].*$", "/+$"):
        col = f"regexp_replace({col}, {lit(pattern)}, '')"
    return f"lower({col})"


WORDS = lambda c: cnt(c, r"[^\s]+", "")
STRIP = lambda c: f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
UNSCRIPT = lambda c: (
    f"regexp_replace(regexp_replace({c}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g')")
LEVELS = "array_to_string(regexp_extract_all(html, '(?i)<h([1-6])[\\s>]', 1), '')"
LINES = lambda c: f"list_transform(string_split({c}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)))"
CLEAN = lambda c: f"trim(regexp_replace({c}, '[#*_`>\\[\\]()]', '', 'g'))"

OPENERS = "it|this|that|these|those|they|we|our|here|below"  # those the derived texts can start with
SECTIONS = "list_slice(regexp_split_to_array(md, '(?m)^##\\s+[^\\n]+$'), 2, 1000000)"
SECTION_OK = (
    "list_transform(list_transform(" + SECTIONS + ", lambda s: list_filter(" + LINES("s") + ", lambda l: l <> '' AND NOT "
    "regexp_matches(l, '^([-*>!|]|\\d+\\.\\s)'))[1]), lambda l: l IS NOT NULL AND NOT regexp_matches(l, '^#{1,6}\\s') AND "
    + WORDS(CLEAN("l")) + " BETWEEN 30 AND 130 AND NOT regexp_matches(" + CLEAN("l") + ", "
    + lit(f"(?i)^({OPENERS})([^A-Za-z0-9_]|$)") + "))"
)
LEAD = (
    "list_filter(list_transform(" + LINES("md") + ", lambda l: CASE WHEN l = '' THEN '' "
    "WHEN regexp_matches(l, '^#{1,6}\\s') THEN 'heading' WHEN regexp_matches(l, '^([-*>|!]|\\d+\\.\\s)') THEN '' "
    "WHEN length(" + CLEAN("l") + ") BETWEEN 60 AND 400 AND regexp_matches(l, '[.!?。]$') THEN 'pass' "
    "WHEN length(" + CLEAN("l") + ") >= 60 THEN 'unfit' ELSE '' END), lambda s: s <> '')[1]"
)
STATS = " + ".join([
    cnt("md", r"\d[\d.,]*\s*(%|‰|percent)([^a-z]|$)"),
    cnt("md", r"[€$£¥]\s?\d[\d.,]*", ""),
    cnt("md", r"\b(\d{2,}|\d+[.,]\d+)[\d.,]*\s*(k|m|bn|million|billion|thousand)([^a-z]|$)"),
    cnt("md", r"\b\d+\s*(in|of|out of)\s*\d+\b"),
])
TOP = "substring(md, 1, greatest(500, CAST(floor(length(md) * 0.25) AS INT)))"
TAKE = ext(TOP, r"((^|\n)#{1,6}\s*(tl;?dr|summary)([^A-Za-z0-9_].*|$))".replace(".*", r"[\s\S]*"))
ORG = ext("src", r'"@type"\s*:\s*"Organization"[\s\S]{0,300}?"name"\s*:\s*"([^"]+)"')
OG = ext("src", rf"property={Q}og:site_name{Q}[^>]*content={Q}([^\"']+){Q}")
NORM = lambda c: f"coalesce(regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g'), '')"
CANON = (
    "coalesce(" + ext("src", rf"<link[^>]+rel={Q}canonical{Q}[^>]*href={Q}([^\"']+){Q}") + ", "
    + ext("src", rf"<link[^>]+href={Q}([^\"']+){Q}[^>]*rel={Q}canonical{Q}") + ")"
)
AUTH = (
    "len(list_filter(list_transform(regexp_extract_all(md, '(?i)\\]\\((https?://[^)]+)\\)', 1), lambda u: "
    + host("u") + "), lambda h: h <> '' AND h <> " + host("url") + " AND (regexp_matches(h, '\\.(gov|edu|int)(\\.[a-z]{2})?$') OR "
    "regexp_matches(h, '(^|\\.)(wikipedia\\.org|wikidata\\.org|doi\\.org|who\\.int|nih\\.gov|nature\\.com|nasa\\.gov|europa\\.eu|"
    "reuters\\.com|ft\\.com|arxiv\\.org|ieee\\.org|gartner\\.com|statista\\.com|mckinsey\\.com)$'))))"
)
TYPED = " OR ".join([
    "(" + m("src", r'"@type"\s*:\s*"Organization"') + " AND " + m("src", r'"(name|sameAs|logo)"\s*:') + ")",
    "(" + m("src", r'"@type"\s*:\s*"(Article|BlogPosting|NewsArticle)"') + " AND " + m("src", r'"author"\s*:') + " AND "
    + m("src", r'"datePublished"\s*:') + ")",
    "(" + m("src", r'"@type"\s*:\s*"Product"') + " AND " + m("src", r'"(offers|aggregateRating)"\s*:') + ")",
    m("src", r'"@type"\s*:\s*"(FAQPage|HowTo|BreadcrumbList|Recipe|Event|LocalBusiness)"'),
])
IMGS = "regexp_extract_all(html, '(?i)<img\\b[^>]*>')"
SAME = ext("src", r'"sameAs"\s*:\s*\[([\s\S]*?)\]')

DERIVED = {
    "words": WORDS(f"coalesce(markdown, {STRIP('html')})"),
    "levels": LEVELS,
    "lead": LEAD,
    "stats": STATS,
    "take": TAKE,
    "canon": f"trim({CANON})",
    "same": SAME,
    "same_links": "CASE WHEN " + SAME + " IS NULL THEN 0 ELSE " + cnt(SAME, r"https?://[^\"']+") + " END",
    "bad_lang": "list_filter(list_transform(regexp_extract_all(src, '(?i)hreflang=[\"'']([^\"'']+)[\"'']', 1), lambda v: "
                "trim(v)), lambda v: NOT regexp_matches(v, '(?i)^([a-z]{2,3}(-[a-z]{4})?(-[a-z]{2})?|x-default)$'))[1]",
    "declares": m("src", rf"rel={Q}alternate{Q}[^>]*hreflang="),
    "og_n": NORM(OG),
    "org_n": NORM(ORG),
    "imgs": IMGS,
    "head": ext("raw", r"(<head[\s>][\s\S]*?</head>)"),
    "rendered": WORDS(STRIP(UNSCRIPT("html"))),
    "insecure": cnt("html", rf"\b(src|srcset|poster)={Q}http://") + " + " + cnt("html", rf"<link[^>]+href={Q}http://")
    + " + " + cnt("html", r"url\(\s*[\"']?http://"),
    "phrase": m("lower(title)", r"\b(404|not found|no longer (exists|available))\b") + " OR "
    + m(STRIP("regexp_extract(html, '(?i)<h1[^>]*>([\\s\\S]*?)</h1>', 1)"), r"\b(404|not found)\b"),
    "fresh": "coalesce(" + ext("src", r'"date(?:Modified|Published)"\s*:\s*"([^"]+)"') + ", "
    + ext("src", rf"<time[^>]+datetime={Q}([^\"']+){Q}") + ")",
}


def _length_rule(col: str, what: str, low: int, high: int) -> str:
    n = f"length(trim({col}))"
    return (f"CASE WHEN {n} = 0 THEN 'missing {what}' WHEN {n} < {low} THEN 'too short (' || {n} || ' < {low})' "
            f"WHEN {n} > {high} THEN 'too long (' || {n} || ' > {high})' END")


def _need(cond: str, what: str) -> str:
    return f"CASE WHEN NOT ({cond}) THEN {lit('missing ' + what)} END"


def _fail(cond: str, text: str) -> str:
    return f"CASE WHEN {cond} THEN {text} END"


RESOLVED = ("CASE WHEN starts_with(canon, '//') THEN 'https:' || canon WHEN starts_with(canon, '/') THEN "
            "regexp_extract(url, '(?i)^https?://[^/]+', 0) || canon ELSE canon END")
JUMP = "regexp_extract(levels, '1[3-6]|2[4-6]|3[56]|46', 0)"
H1S = "(length(levels) - length(replace(levels, '1', '')))"
HAS_CHARSET, HAS_LANG = m("src", "<meta[^>]+charset"), m("src", "<html[^>]+lang=")

# Coverage checks: the sentence of the failure, NULL when the page passes.
COV_SQL = {
    "S1": _length_rule("title", "title", 15, 60),
    "S2": _length_rule("description", "meta description", 70, 160),
    "S3": _need(m("src", rf"<link[^>]+rel={Q}canonical{Q}"), "canonical link tag"),
    "S4": _fail(m("src", rf"<meta[^>]+(name={Q}(robots|googlebot){Q}[^>]*content={Q}[^\"']*noindex|content={Q}[^\"']*noindex"
                         rf"[^>]*name={Q}(robots|googlebot){Q})"), "'set to noindex'"),
    "S5": _need(cnt("html", r"<h1[\s>]") + " >= 1", "h1 heading"),
    "S10": _fail("words < 300", "'too short (' || words || ' < 300)'"),
    "S12": _need(m("src", rf"property={Q}og:(title|image){Q}"), "og:title and og:image"),
    "S17": "CASE WHEN status_code < 200 OR status_code >= 400 THEN 'returned HTTP ' || status_code "
           "WHEN phrase AND words < 50 THEN 'looks like a soft 404' END",
    "S18": f"CASE WHEN levels = '' THEN 'missing heading tags' WHEN {H1S} <> 1 THEN 'found ' || {H1S} || "
           f"' h1 heading (expected 1)' WHEN {JUMP} <> '' THEN 'heading level h' || left({JUMP}, 1) || ' jumps to h' || "
           f"right({JUMP}, 1) || ' (skipped h' || (CAST(left({JUMP}, 1) AS INT) + 1) || ')' END",
    "S21": _fail("multilingual AND bad_lang IS NOT NULL", "'invalid hreflang value ''' || bad_lang || ''''"),
    "S23": f"CASE WHEN canon IS NOT NULL AND {comparable(RESOLVED)} <> {comparable('url')} THEN 'canonical mismatch (expected ' "
           f"|| path || ', got ' || coalesce(nullif(regexp_replace(regexp_replace({RESOLVED}, "
           "'(?i)^https?://[^/]+', ''), '[#?].*$', ''), ''), '/') || ')' END",
    "G1": _need(m("src", rf"<script[^>]+type={Q}application/ld\+json{Q}"), "JSON-LD <script>"),
    "G4": "CASE WHEN lead = 'pass' THEN NULL WHEN lead = 'heading' THEN 'first content line is a heading, not a lead paragraph' "
          "WHEN lead = 'unfit' THEN 'lead paragraph found but it is too long or lacks ending punctuation' "
          "ELSE 'no lead paragraph (60-400 chars) before the first heading' END",
    "G5": _need(m("src", r'FAQPage|"@type"\s*:\s*"Question"') + " OR " + m("md", r"(^|\n)#+[^\n]*\?") + " OR "
                + m("html", r"<summary[^>]*>[^<]*\?"), "Q&A / FAQ structure"),
    "G6": _fail("stats < 3", "'found ' || stats || ' concrete statistics (%, currency, ratios) (expected 3)'"),
    "G8": _need(m("src", rf"\"author\"|rel={Q}author{Q}|\"Organization\"|\"sameAs\""),
                "author / Organization / sameAs signals"),
    "G11": _need(TYPED, "typed schema (Organization / Article / Product / FAQ / HowTo / ...)"),
    "G12": _fail(m("src", rf"<meta[^>]+name={Q}robots{Q}[^>]*content={Q}[^\"']*(nosnippet|max-snippet:\s*0)")
                 + " OR (h_fetched AND " + m("h_robots", r"nosnippet|max-snippet:\s*0") + ")",
                 "'nosnippet / max-snippet:0 directive blocks citation'"),
    "G14": _need(cnt("md", r"^\s*([-*]\s+|\d+\.\s+)", "(?m)") + " >= 3 OR " + cnt("md", r"^\s*\|[^\n]*\|\s*$", "(?m)")
                 + " >= 2 OR " + m("html", r"<table[\s>]"), "extractable lists or tables"),
    "G15": _need(AUTH + " >= 1", "outbound citation to an authoritative source"),
    "G18": "CASE WHEN same IS NULL THEN 'missing Organization.sameAs JSON-LD block' WHEN "
           + m("same", r"wikipedia\.org|wikidata\.org") + " OR same_links >= 2 THEN NULL ELSE 'found ' || same_links || "
           "' sameAs URLs (Wikipedia/Wikidata or 2+ socials) (expected 2)' END",
    "G20": "CASE WHEN md = '' THEN 'missing page content' WHEN take IS NULL THEN "
           "'missing TL;DR / Key Takeaways heading in the top quarter' WHEN NOT "
           + m("take", r"(^|\n)\s*([-*]\s+|\d+\.\s+)")
           + " THEN 'Key Takeaways heading found but no bullet/numbered list follows' END",
    "TB1": _fail("NOT starts_with(url, 'https://')", "'served over plain HTTP'"),
    "TB3": _fail("starts_with(url, 'https://') AND insecure > 0",
                 "'found ' || insecure || ' insecure http:// sub-resources on an HTTPS page (expected 0)'"),
    "TB4": _need(m("src", rf"<meta[^>]+name={Q}viewport{Q}"), '<meta name="viewport"> tag'),
    "TB10": f"CASE WHEN {HAS_CHARSET} AND {HAS_LANG} THEN NULL WHEN {HAS_CHARSET} THEN 'missing <html lang>' WHEN {HAS_LANG} "
            "THEN 'missing <meta charset>' ELSE 'missing <meta charset> and <html lang>' END",
    "TB12": _need(m("src", rf"<link[^>]+rel={Q}[^\"']*icon"), 'favicon <link rel="icon">'),
    "TB22": _need(m("raw", r"^\s*<!doctype html>"), "<!DOCTYPE html> at document start"),
}

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
FRESH_AT = "try_cast(fresh AS TIMESTAMP)"
DAYS = f"(epoch_us({AS_OF}) - epoch_us({FRESH_AT})) / 86400000000.0"
SHARE = lambda cond: (
    f"CASE WHEN len(imgs) = 0 THEN 1.0 ELSE len(list_filter(imgs, lambda t: {cond})) / len(imgs) END")
AVG_SQL = {
    "S13": "CASE WHEN " + cnt("html", r"<img[\s>]") + " = 0 THEN 1.0 ELSE " + cnt("html", r"<img[^>]+\balt=") + " / "
           + cnt("html", r"<img[\s>]") + " END",
    "G7": f"CASE WHEN fresh IS NULL THEN CASE WHEN {m('src', 'last updated|<time')} THEN 0.3 ELSE 0.0 END WHEN {FRESH_AT} IS NULL "
          f"THEN 0.3 WHEN {DAYS} <= 90 THEN 1.0 WHEN {DAYS} >= 730 THEN 0.1 ELSE 1 - ({DAYS} - 90) / 640 * 0.9 END",
    "G19": f"CASE WHEN len({SECTIONS}) = 0 THEN 0.0 ELSE len(list_filter({SECTION_OK}, lambda b: b)) / len({SECTIONS}) END",
    "TB6": SHARE("(" + m("t", r"\bwidth=") + " AND " + m("t", r"\bheight=") + ") OR " + m("t", "aspect-ratio")),
    "TB20": "CASE WHEN head IS NOT NULL THEN CASE WHEN len(list_filter(regexp_extract_all(head, "
            "'(?i)<script\\b[^>]*\\bsrc=[^>]*>'), lambda t: NOT " + m("t", rf"\b(async|defer)\b|type={Q}module{Q}")
            + ")) = 0 THEN 1.0 ELSE 0.0 END END",
    "TB19": "CASE WHEN len(imgs) = 0 THEN 1.0 ELSE (least(" + cnt("html", r"\.(webp|avif)\b") + " + "
            + cnt("html", r"<picture[\s>]") + " + len(list_filter(imgs, lambda t: " + m("t", r"\.imgix\.net")
            + ")), len(imgs)) / len(imgs) + len(list_filter(imgs, lambda t: " + m("t", rf"loading={Q}lazy{Q}")
            + ")) / len(imgs)) / 2 END",
}

DETECT_SQL = {
    "ga4": m("src", r"[?&]id=G-[A-Z0-9]{10}\b|gtag\(\s*[\"']config[\"']\s*,\s*[\"']G-[A-Z0-9]{10}|googletagmanager\.com/gtag"),
    "gtm": m("src", r"googletagmanager\.com/gtm\.js|[?&/]id=GTM-[A-Z0-9]+"),
    "consent": m("src", r"gtag\(\s*[\"']consent[\"']"),
    "consent_v2": m("src", "ad_user_data") + " AND " + m("src", "ad_personalization"),
    "cmp": m("src", r"cookiebot|onetrust|cookieconsent|usercentrics|didomi|klaro|cookie-notice"),
    "pixels": m("src", r"fbevents\.js|connect\.facebook\.net|bat\.bing\.com|pintrk\(|\brdt\(|\btwq\("),
    "data_layer": m("src", r"dataLayer\.push\(|dataLayer\s*=\s*(\[|window\.dataLayer)"),
    "ua": m("src", r"\bUA-\d{4,}-\d+|google-analytics\.com/analytics\.js|\bga\(\s*[\"']create[\"']"),
    "recorder": m("src", r"clarity\.ms|static\.hotjar\.com|fullstory\.com|posthog|mouseflow"),
}
BOTS = ("gptbot,oai-searchbot,chatgpt-user,claudebot,claude-searchbot,claude-web,anthropic-ai,perplexitybot,perplexity-user,"
        "google-extended,ccbot,applebot-extended,amazonbot,meta-externalagent,bytespider").split(",")


def _robots_sql(agents: list[str]) -> str:
    """Reports with a bare Disallow whose closest agent line above is one of the agents."""
    names = ", ".join(lit(a) for a in agents)
    return (
        "SELECT DISTINCT d.report_id FROM robot_lines d ASOF JOIN (SELECT report_id, i, lower(trim(regexp_extract(l, "
        "'(?i)^user-agent:\\s*(.+)$', 1))) AS agent FROM robot_lines WHERE regexp_matches(l, '(?i)^user-agent:\\s*.+$')) a "
        "ON d.report_id = a.report_id AND d.i >= a.i WHERE regexp_matches(d.l, '(?i)^disallow:\\s*/\\s*$') "
        f"AND a.agent IN ({names})"
    )


def _tracking() -> dict[str, str]:
    any_t = "(ga4 OR gtm OR consent OR consent_v2 OR cmp OR pixels OR data_layer OR ua)"
    cfg = lambda d: f"CASE WHEN {d} THEN 1.0 WHEN known THEN 0.0 WHEN NOT {any_t} OR gtm THEN NULL ELSE 0.0 END"
    tna = lambda d: f"CASE WHEN {d} THEN 1.0 WHEN NOT {any_t} OR gtm THEN NULL ELSE 0.0 END"
    at = lambda p: f"length(regexp_extract(root_html, {lit('(?is)^(.*?)' + p)}, 1))"
    consent, loader = r"gtag\(\s*[\"']consent[\"']\s*,\s*[\"']default[\"']", r"googletagmanager\.com/(gtm\.js|gtag/js)"
    return {
        "T1": cfg("ga4"),
        "T2": f"CASE WHEN {any_t} THEN CASE WHEN ua THEN 0.0 ELSE 1.0 END END",
        "T3": "CASE WHEN gtm THEN 1.0 END",
        "T5": cfg("consent"),
        "T6": cfg("consent_v2"),
        "T7": tna("cmp"),
        "T8": tna("pixels"),
        "T12": f"CASE WHEN NOT {any_t} THEN NULL WHEN NOT recorder OR cmp THEN 1.0 WHEN gtm THEN NULL ELSE 0.0 END",
        "T15": "CASE WHEN data_layer THEN 1.0 END",
        "T20": f"CASE WHEN {m('root_html', consent)} AND {m('root_html', loader)} THEN CASE WHEN {at(consent)} < {at(loader)} "
               "THEN 1.0 ELSE 0.0 END END",
    }


def _yes(cond: str, known: str) -> str:
    return f"CASE WHEN {known} THEN CASE WHEN {cond} THEN 1.0 ELSE 0.0 END END"


SITE_SQL = {
    "S14": _yes("sitemap_status = 200 OR " + m("robots", r"(^|\n)\s*sitemap:"), "sitemap_status IS NOT NULL"),
    "S15": "u_title", "S16": "u_desc",
    "G3": "CASE WHEN root_html = '' THEN NULL WHEN coalesce(home_words, first_words) <= 20 THEN 1.0 ELSE least(1.0, "
          + WORDS(STRIP(UNSCRIPT("root_html"))) + " / greatest(coalesce(home_words, first_words) * 0.6, 1)) END",
    "G9": _yes("report_id NOT IN (SELECT report_id FROM blocked_ai)", "robots_status IS NOT NULL"),
    "G16": _yes("llms_status = 200", "llms_status IS NOT NULL"),
    "G17": "brand",
    "TB5": _yes("report_id NOT IN (SELECT report_id FROM blocked_site)", "robots_status IS NOT NULL"),
    "TB30": "CASE WHEN hdr THEN CASE WHEN coalesce(TRY_CAST(regexp_extract(h_hsts, 'max-age=(\\d+)', 1) AS BIGINT), 0) >= 31536000 "
            "THEN 1.0 WHEN coalesce(TRY_CAST(regexp_extract(h_hsts, 'max-age=(\\d+)', 1) AS BIGINT), 0) > 0 THEN 0.5 ELSE 0.0 "
            "END END",
    "TB31": "CASE WHEN hdr THEN CASE WHEN h_csp = '' THEN 0.0 WHEN " + m("h_csp", "unsafe-inline|unsafe-eval")
            + " THEN 0.5 ELSE 1.0 END END",
    "TB32": _yes(m("h_nosniff", "nosniff"), "hdr"),
    "TB33": _yes("trim(h_xfo) <> '' OR " + m("h_csp", "frame-ancestors"), "hdr"),
    "TB34": _yes("trim(h_referrer) <> ''", "hdr"),
    "TB35": _yes("trim(h_permissions) <> ''", "hdr"),
} | _tracking()


def _audit() -> str:
    derived = ",\n  ".join(f"{expr} AS {name}" for name, expr in DERIVED.items())
    cov = ",\n  ".join(f"{expr} AS v_{i}" for i, expr in COV_SQL.items())
    avg = ",\n  ".join(f"{expr} AS m_{i}" for i, expr in AVG_SQL.items())
    det = ",\n  ".join(f"({expr}) AS d_{d}" for d, expr in DETECT_SQL.items())
    roll = ", ".join(
        [f"count(*) FILTER (v_{i} IS NULL) / count(*) AS {i}" for i in COV_IDS]
        + [f"avg(m_{i}) AS {i}" for i in AVG_IDS] + [f"bool_or(d_{d}) AS p_{d}" for d in DETECT_SQL])
    known = "CASE WHEN gtm_id IS NOT NULL AND regexp_matches(gtm_body, '(?i)google_tag_manager|gtm\\.start|gtag') THEN true ELSE false END"
    merged = ", ".join([
        "p_ga4 OR (known AND regexp_matches(gtm_body, 'G-[A-Z0-9]{8,}|AW-[0-9]+')) AS ga4", "p_gtm AS gtm",
        "p_consent OR (known AND regexp_matches(gtm_body, 'analytics_storage|ad_storage')) AS consent",
        "p_consent_v2 OR (known AND contains(gtm_body, 'ad_user_data') AND contains(gtm_body, 'ad_personalization')) "
        "AS consent_v2", "p_cmp AS cmp",
        "p_pixels OR (known AND regexp_matches(gtm_body, '(?i)fbevents|bat\\.bing')) AS pixels",
        "p_data_layer AS data_layer", "p_ua OR (known AND regexp_matches(gtm_body, '\\bUA-\\d{4,}-\\d+')) AS ua",
        "p_recorder AS recorder"])
    values = ", ".join(
        f"({lit(i)}, CAST({'CASE WHEN multilingual THEN S21 END' if i == 'S21' else i if i in COV_IDS + AVG_IDS else SITE_SQL[i]} "
        "AS DOUBLE))" for i in CHECK_IDS)
    rubric = ", ".join(
        f"({lit(r[0])}, {k}, {lit(r[1])}, {lit(r[2])}, {r[3]}, {lit(r[4])}, {r[5]}, {dict(SEVERITIES)[r[4]]}, {lit(r[6])})"
        for k, r in enumerate(RUBRIC))
    dims = ", ".join(f"({k}, {lit(d[0])}, {lit(d[1])}, {d[2]})" for k, d in enumerate(DIMENSIONS))
    return f"""crawl AS MATERIALIZED ({crawl_sql()}),
aux AS MATERIALIZED (SELECT *, coalesce(CASE WHEN robots_status = 200 THEN robots_body END, '') AS robots,
  h_fetched AND (h_hsts || h_csp || h_nosniff || h_xfo || h_referrer || h_permissions || h_robots) <> '' AS hdr
  FROM ({site_sql()})),
p AS (SELECT c.report_id, page_ord, source_url, coalesce(source_url, root_url) AS url, status_code,
  coalesce(title, '') AS title, coalesce(description, '') AS description, markdown, coalesce(raw_html, '') AS raw,
  coalesce(html, raw_html, '') AS html, coalesce(raw_html, '') || chr(10) || coalesce(html, '') AS src,
  coalesce(markdown, '') AS md, h_fetched, h_robots, a.root_url FROM crawl c JOIN aux a USING (report_id)),
d AS MATERIALIZED (SELECT *, {PATH} AS path,
  {derived} FROM p),
f AS MATERIALIZED (SELECT report_id, page_ord, source_url, url, path, root_url, title, description, rendered, brand_score, declares,
  nullif(regexp_extract(src, 'GTM-[A-Z0-9]+', 0), '') AS gtm_id, words, canon, stats,
  {cov},
  {avg},
  {det}
  FROM (SELECT *, bool_or(declares) OVER (PARTITION BY report_id) AS multilingual,
    CASE WHEN og_n <> '' AND org_n <> '' THEN CASE WHEN contains(og_n, org_n) OR contains(org_n, og_n) THEN 1.0 ELSE 0.3 END
    WHEN og_n <> '' OR org_n <> '' THEN CASE WHEN contains({NORM('title')}, CASE WHEN og_n <> '' THEN og_n ELSE org_n END)
    THEN 1.0 ELSE 0.5 END END AS brand_score FROM d)),
uniq AS (SELECT report_id, max(s) FILTER (kind = 't') AS u_title, max(s) FILTER (kind = 'd') AS u_desc FROM (
  SELECT report_id, kind, CASE WHEN sum(k) >= 2 THEN coalesce(sum(k) FILTER (k = 1), 0) / sum(k) END AS s FROM (
    SELECT report_id, 't' AS kind, lower(trim(title)) AS v, count(*) AS k FROM f WHERE trim(title) <> '' GROUP BY ALL
    UNION ALL SELECT report_id, 'd', lower(trim(description)), count(*) FROM f WHERE trim(description) <> '' GROUP BY ALL)
  GROUP BY report_id, kind) GROUP BY report_id),
robot_lines AS (SELECT report_id, i, trim(regexp_replace(l, '#.*$', '')) AS l FROM (SELECT report_id,
  unnest(string_split(robots, chr(10))) AS l, generate_subscripts(string_split(robots, chr(10)), 1) AS i FROM aux)),
blocked_site AS ({_robots_sql(['*'])}),
blocked_ai AS ({_robots_sql(BOTS)}),
roll AS (SELECT report_id, count(*) AS n, {roll}, avg(brand_score) AS brand, bool_or(declares) AS multilingual,
  arg_min(gtm_id, page_ord) FILTER (gtm_id IS NOT NULL) AS gtm_id, arg_min(rendered, page_ord) AS first_words,
  arg_min(rendered, page_ord) FILTER ({host("coalesce(source_url, '')")} = {host('root_url')}) AS home_words
  FROM f GROUP BY report_id),
site AS (SELECT *, {merged} FROM (SELECT r.*, u.u_title, u.u_desc, a.* EXCLUDE (report_id), {known} AS known
  FROM roll r LEFT JOIN uniq u USING (report_id) JOIN aux a USING (report_id))),
rubric(check_id, ordinal, label, dimension, weight, severity, effort, impact, kind) AS (VALUES {rubric}),
dim_list(dim_ord, dimension, dim_label, dim_weight) AS (VALUES {dims}),
checks AS MATERIALIZED (SELECT report_id, n, known, v.check_id, v.ratio FROM site, LATERAL (VALUES {values}) v(check_id, ratio)),
results AS (SELECT * FROM checks JOIN rubric USING (check_id))"""


AUDIT = _audit()
FAILURES = ("fails AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT report_id, page_ord, path, {lit(i)} AS check_id, v_{i} AS reason FROM f WHERE v_{i} IS NOT NULL"
    for i in COV_SQL) + ")), "
    "fpaths AS (SELECT report_id, check_id, path, min(page_ord) AS first_ord, arg_min(reason, page_ord) AS reason FROM fails "
    "GROUP BY ALL), "
    "franked AS (SELECT *, row_number() OVER (PARTITION BY report_id, check_id ORDER BY first_ord, path) AS pos, "
    "count(*) OVER (PARTITION BY report_id, check_id) AS total FROM fpaths)")
_r1 = lambda x: f"floor({x} * 10 + 0.5) / 10"
DIMS = (
    "dims AS (SELECT report_id, dim_ord, dimension, dim_label, dim_weight, coalesce(" + _r1("CASE WHEN caps > 0 THEN least(raw, 59.0) "
    "ELSE raw END") + ", 0.0) AS score, coalesce(" + _r1("raw") + ", 0.0) AS raw_score, caps > 0 AS capped, capped_by, "
    "raw IS NULL AS not_applicable FROM (SELECT report_id, dim_ord, dimension, dim_label, dim_weight, "
    "100 * sum(weight * ratio) / sum(weight) FILTER (ratio IS NOT NULL) AS raw, "
    "count(*) FILTER (severity = 'critical' AND ratio = 0) AS caps, "
    "string_agg(check_id, ',' ORDER BY ordinal) FILTER (severity = 'critical' AND ratio = 0) AS capped_by "
    "FROM results JOIN dim_list USING (dimension) GROUP BY ALL))")
_g = lambda x: "CASE " + " ".join(f"WHEN {x} >= {low} THEN '{g}'" for g, low in GRADES) + " ELSE 'F' END"
OVERALL = (
    "maths AS (SELECT report_id, coalesce(sum(dim_weight * score) FILTER (NOT not_applicable) / sum(dim_weight) FILTER "
    "(NOT not_applicable), 0.0) AS math, bool_or(capped) AS capped FROM dims GROUP BY report_id), "
    "overall AS (SELECT report_id, math, capped, CAST(floor(CASE WHEN capped AND math >= 90 THEN least(math, 89.0) "
    "WHEN capped AND math >= 80 THEN least(math, 79.0) WHEN capped AND math >= 70 THEN least(math, 69.0) "
    "WHEN capped AND math >= 60 THEN least(math, 59.0) ELSE math END + 0.5) AS INT) AS overall FROM maths), "
    f"graded AS (SELECT *, {_g('overall')} AS grade FROM overall)")
PLAN = (
    "plan AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY priority DESC, impact DESC, ordinal) AS rank FROM ("
    "SELECT report_id, check_id, label AS finding, severity, ordinal, dimension, impact, effort, impact * 2 - effort AS priority, "
    "impact >= 4 AND effort <= 2 AS quick_win, dimension = 'tracking' AS requires_approval FROM results WHERE ratio < 1))")


def audit_query(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join((AUDIT, *parts)) + "\n" + select
