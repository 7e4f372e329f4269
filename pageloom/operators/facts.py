"""Page facts: the one pass over page bodies.

``page_facts`` reads html and markdown once and leaves a narrow row per page (numbers, flags, short strings). Nothing
after it touches a page body, so every shuffle in the audit moves facts, never html.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import (
    collapsed,
    found,
    found_all,
    matches,
    occurrences,
    plain_space,
    replaced,
    trimmed,
    without_tags,
    word_count,
    word_count_of_collapsed,
)
from pageloom.functions.urls import host_of
from pageloom.operators.signals import container_id, page_detectors

# Hosts that count as authoritative sources, image delivery networks, languages' filler openers and
# summary headings.
AUTHORITY_SUFFIX = r"\.(?:gov|edu|int)(?:\.[a-z]{2})?\z"
AUTHORITY_HOSTS = [
    "wikipedia.org", "wikidata.org", "doi.org", "who.int", "nih.gov", "nature.com", "nasa.gov", "europa.eu",
    "reuters.com", "ft.com", "arxiv.org", "ieee.org", "gartner.com", "statista.com", "mckinsey.com",
]
IMAGE_NETWORKS = [
    "res.cloudinary.com", ".imgix.net", "imagedelivery.net", "/cdn-cgi/image/", "/_next/image", "/_vercel/image",
    "cdn.shopify.com", ".twic.pics", "wsrv.nl",
]
FILLER_OPENERS = [
    "it", "this", "that", "these", "those", "they", "we", "our", "here", "below", "es", "sie", "wir", "dies", "diese",
    "hier", "il", "elle", "nous", "ici", "ce", "cette", "esto", "esta", "este", "nosotros", "questo", "questa", "deze",
    "dit", "това", "този", "тази", "тези", "тук", "ние", "те", "нашия", "нашата", "нашите", "это", "этот", "эта",
    "эти", "здесь", "мы", "они",
]
SUMMARY_HEADINGS = [
    "tl;?dr", "key takeaways", "in short", "in summary", "summary", "key points", "at a glance", "the gist", "resumen",
    "zusammenfassung", "in sintesi", "in breve", "samenvatting", "points? cl[eé]s", "en bref", "punti chiave", "resumo",
    "kernpunten", "резюме", "обобщение", "накратко", "ключови изводи", "ключови точки", "кратко", "итоги",
    "ключевые выводы", "резиме", "podsumowanie", "w skrócie", "najważniejsze", "rezumat", "pe scurt",
]
# How a page that was not found reads, and what ends a word.
NOT_FOUND_PHRASE = (
    r"(?<!\w)(?:404|not found|page not found|page (?:does ?n'?t|cannot be) found|"
    r"no longer (?:exists|available))(?!\w)"
)
WORD_END = r"(?![A-Za-z0-9_Ѐ-ӿ])"
MARKUP_CHARS = r"[#*_`>\[\]()]"


def usable(pages: DataFrame) -> DataFrame:
    """Pages with any content or metadata; the rest are crawl failures, not audited pages."""
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    meta = F.col("source_url").isNotNull() | F.col("status_code").isNotNull() | F.col("title").isNotNull() | F.col(
        "description").isNotNull() | F.col("language").isNotNull()
    return pages.filter(filled("html") | filled("raw_html") | filled("markdown") | meta)


def layered(pages: DataFrame) -> DataFrame:
    """Text layers of a page: raw, html, src (both, for tag presence) and md, all with plain space."""
    texts = pages.withColumns({c: plain_space(F.col(c)) for c in ("raw_html", "html", "markdown")})
    raw = F.coalesce(F.col("raw_html"), F.lit(""))
    return texts.select(
        "report_id", "page_ord", "source_url", "status_code",
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.col("markdown"),
        raw.alias("raw"),
        F.coalesce(F.col("html"), F.col("raw_html"), F.lit("")).alias("html"),
        F.concat(raw, F.lit("\n"), F.coalesce(F.col("html"), F.lit(""))).alias("src"),
        F.coalesce(F.col("markdown"), F.lit("")).alias("md"),
    ).withColumn("low", F.lower("src"))


def visible_text() -> Column:
    return collapsed(F.coalesce(F.col("markdown"), without_tags(F.col("html"))))


def _within(literal: str, pattern: str) -> Column:
    """Pattern on the source, tried only where a literal it needs occurs."""
    return F.contains(F.col("low"), F.lit(literal)) & matches(F.col("src"), pattern)


def _lead_state(md: Column) -> Column:
    """What the first decisive line of the text is: pass, heading, unfit (long or unpunctuated) or none."""

    def state(line: Column) -> Column:
        fits = F.length(trimmed(F.regexp_replace(line, MARKUP_CHARS, "")))
        return (
            F.when(F.length(line) < 60, F.when(matches(line, r"^#{1,6}\s"), "heading"))
            .when(matches(line, r"^#{1,6}\s"), "heading")
            .when(matches(line, r"^(?:[-*>|!]|\d+\.\s)"), F.lit(None).cast("string"))
            .when(fits < 60, F.lit(None).cast("string"))
            .when((fits <= 400) & matches(line, r"[.!?。]\z"), "pass")
            .otherwise("unfit")
        )

    def first_of(lines: Column) -> Column:
        # Two steps, so that each lambda evaluates its line once.
        return F.get(F.filter(F.transform(F.transform(lines, trimmed), state), lambda s: s.isNotNull()), F.lit(0))

    # The deciding line is nearly always among the first; the rest is only looked at when it is not.
    lines = F.split(md, "\n")
    head, rest = F.slice(lines, 1, 20), F.slice(lines, F.lit(21), F.size(lines))
    return F.coalesce(first_of(head), first_of(rest), F.lit("none"))


def _sections(md: Column) -> Column:
    """Text pieces between H2 headings, the piece before the first heading included; NULL without headings."""
    return F.when(F.contains(md, F.lit("##")), F.split(md, r"(?m)^##\s+.+$"))


def _section_share(sections: Column) -> Column:
    """Share of H2 sections whose first prose line is a self-contained answer; 0 without sections."""
    opener = "(?iu)^(?:" + "|".join(FILLER_OPENERS) + ")" + WORD_END
    skipped = r"^(?:[-*>!|]|\d+\.\s)"

    def first_of(lines: Column) -> Column:
        return F.get(F.filter(F.transform(lines, trimmed), lambda l: (l != "") & ~matches(l, skipped)), F.lit(0))

    def first_line(lines: Column) -> Column:
        return F.coalesce(first_of(F.slice(lines, 1, 10)), first_of(F.slice(lines, F.lit(11), F.size(lines))), F.lit("#"))

    # One step per value that later steps read more than once.
    lines = F.transform(F.slice(sections, F.lit(2), F.size(sections)), lambda s: F.split(s, "\n"))
    prose = F.filter(F.transform(lines, first_line), lambda l: ~matches(l, r"^#{1,6}(?:\s|\z)"))
    clean = F.transform(prose, lambda l: trimmed(F.regexp_replace(l, MARKUP_CHARS, "")))
    sized = F.transform(clean, lambda c: F.struct(c.alias("text"), word_count(c).alias("n")))
    hits = F.size(F.filter(sized, lambda c: (c["n"] >= 30) & (c["n"] <= 130) & ~matches(c["text"], opener)))
    n = F.size(sections) - 1
    return F.when(n > 0, hits / n).otherwise(0.0)


def _takeaway_state(md: Column) -> Column:
    heading = r"(?iu)(?:^|\n)#{1,6}\s*(?:" + "|".join(SUMMARY_HEADINGS) + ")" + WORD_END + r"[\s\S]*"
    top = F.substring(md, F.lit(1), F.greatest(F.lit(500), F.floor(F.length(md) * 0.25)).cast("int"))
    rest = F.when(F.contains(md, F.lit("#")), found(top, heading))
    return (
        F.when(md == "", "empty")
        .when(rest.isNull(), "none")
        .when(matches(rest, r"(?:^|\n)\s*(?:[-*]\s+|\d+\.\s+)"), "pass")
        .otherwise("bare")
    )


def _statistics(md: Column) -> Column:
    def where(mark: str, pattern: str) -> Column:
        return F.when(matches(md, mark), occurrences(md, pattern)).otherwise(0)

    return (
        where("(?i)[%‰]|percent", r"(?i)\d[\d.,]*\s*(?:%|‰|percent)(?![a-z])")
        + where("[€$£¥]", r"[€$£¥]\s?\d[\d.,]*")
        + occurrences(
            md,
            r"(?i)(?<!\w)(?:\d{2,}|\d+[.,]\d+)[\d.,]*\s*(?:k|m|bn|million|billion|thousand)(?![a-z])",
        )
        + occurrences(md, r"(?i)(?<!\w)\d+\s*(?:in|of|out of)\s*\d+(?!\w)")
    )


def _authority_links(md: Column) -> Column:
    """Distinct authoritative hosts linked from the text; the page's own host is taken out later."""
    listed = r"(?:^|\.)(?:" + "|".join(h.replace(".", r"\.") for h in AUTHORITY_HOSTS) + r")\z"
    hosts = F.transform(found_all(md, r"(?i)\]\((https?://[^)]+)\)", 1), host_of)
    good = F.filter(hosts, lambda h: (h != "") & (matches(h, AUTHORITY_SUFFIX) | matches(h, listed)))
    return F.when(F.contains(md, F.lit("](")), F.array_sort(F.array_distinct(good))).otherwise(
        F.array().cast("array<string>"))


def _brand_score(src: Column, low: Column, title: Column) -> Column:
    """Agreement of the brand declared in og:site_name, in the Organization schema and in the title; NULL if none."""
    norm = lambda c: F.coalesce(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", ""), F.lit(""))
    og = F.when(F.contains(low, F.lit("og:site_name")), F.coalesce(
        found(src, r"""(?i)property=["']og:site_name["'][^>]*content=["']([^"']+)["']""", 1),
        found(src, r"""(?i)content=["']([^"']+)["'][^>]*property=["']og:site_name["']""", 1),
    ))
    org = F.when(F.contains(low, F.lit("organization")), found(
        src, r'(?i)"@type"\s*:\s*"Organization"[\s\S]{0,300}?"name"\s*:\s*"([^"]+)"', 1))
    og, org, title = norm(og), norm(org), norm(title)
    both = (og != "") & (org != "")
    one = F.when(og != "", og).otherwise(org)
    return (
        F.when(both, F.when(F.contains(og, org) | F.contains(org, og), 1.0).otherwise(0.3))
        .when(one != "", F.when(F.contains(title, one), 1.0).otherwise(0.5))
    )


def _typed_schema() -> Column:
    s = F.col("src")
    is_type = lambda t: matches(s, r'(?i)"@type"\s*:\s*"(?:' + t + ')"')
    has = lambda k: matches(s, r'(?i)"(?:' + k + r')"\s*:')
    return F.contains(F.col("low"), F.lit('"@type"')) & (
        (is_type("Organization") & has("name|sameAs|logo"))
        | (is_type("Article|BlogPosting|NewsArticle") & has("author") & has("datePublished"))
        | (is_type("Product") & has("offers|aggregateRating"))
        | is_type("FAQPage|HowTo|BreadcrumbList|Recipe|Event|LocalBusiness")
    )


def page_facts(pages: DataFrame) -> DataFrame:
    """One narrow row per usable page. A projection only: no shuffle, page bodies read once."""
    parts, facts = _fact_columns()
    return layered(usable(pages)).withColumns(parts).select(*facts)


@lru_cache(maxsize=1)
def _fact_columns() -> tuple[dict[str, Column], list[Column]]:
    """Intermediate pieces that several facts read, and the facts. Built once: expressions hold no data."""
    src, low, html, md, raw = (F.col(c) for c in ("src", "low", "html", "md", "raw"))
    title, desc = trimmed(F.col("title")), trimmed(F.col("description"))

    parts = {
        "text": visible_text(),
        "levels": F.array_join(found_all(html, r"(?i)<h([1-6])[\s>]", 1), ""),
        "imgs": found_all(html, r"(?i)<img(?!\w)[^>]*>"),
        "head": found(raw, r"(?i)<head[\s>][\s\S]*?</head>"),
        "hreflangs": F.when(
            F.contains(low, F.lit("hreflang=")), found_all(src, r"""(?i)hreflang=["']([^"']+)["']""", 1)),
        "first_h1": F.when(F.contains(low, F.lit("<h1")), F.lower(without_tags(
            F.regexp_extract(html, r"(?i)<h1[^>]*>([\s\S]*?)</h1>", 1)))).otherwise(""),
        "sections": _sections(md),
        "same_as": F.when(F.contains(low, F.lit('"sameas"')), found(src, r'(?i)"sameAs"\s*:\s*\[([\s\S]*?)\]', 1)),
    }
    imgs, head = F.col("imgs"), F.col("head")
    n_img = F.size(imgs)
    img_tags = occurrences(html, r"(?i)<img[\s>]")
    sized = F.size(F.filter(imgs, lambda t: (matches(t, r"(?i)(?<!\w)width=") & matches(t, r"(?i)(?<!\w)height="))
                            | matches(t, r"(?i)aspect-ratio")))
    network = "(?i)" + "|".join(n.replace(".", r"\.") for n in IMAGE_NETWORKS)
    modern = F.least(
        occurrences(html, r"(?i)\.(?:webp|avif)(?!\w)") + occurrences(html, r"(?i)<picture[\s>]")
        + F.size(F.filter(imgs, lambda t: matches(t, network))), n_img)
    lazy = F.size(F.filter(imgs, lambda t: matches(t, r"""(?i)loading=["']lazy["']""")))
    blocking = F.filter(
        found_all(head, r"(?i)<script(?!\w)[^>]*(?<!\w)src=[^>]*>"),
        lambda t: ~matches(t, r"""(?i)(?<!\w)(?:async|defer)(?!\w)|type=["']module["']"""))
    not_shown = replaced(replaced(html, r"(?i)<script[\s\S]*?</script>", " "), r"(?i)<style[\s\S]*?</style>", " ")
    bad_hreflang = F.get(F.filter(F.transform(F.col("hreflangs"), trimmed), lambda v: ~matches(
        v, r"(?i)^[a-z]{2,3}(-[a-z]{4})?(-[a-z]{2})?\z|^x-default\z")), F.lit(0))
    fresh = F.when(
        F.contains(low, F.lit('"date')) | F.contains(low, F.lit("<time")),
        F.coalesce(
            found(src, r'(?i)"date(?:Modified|Published)"\s*:\s*"([^"]+)"', 1),
            found(src, r"""(?i)<time[^>]+datetime=["']([^"']+)["']""", 1)))

    facts = [
        *map(F.col, ("report_id", "page_ord", "source_url", "status_code")),
        F.length(title).alias("title_len"),
        F.lower(title).alias("title_key"),
        F.length(desc).alias("desc_len"),
        F.lower(desc).alias("desc_key"),
        _within("canonical", r"""(?i)<link[^>]+rel=["']canonical["']""").alias("has_canonical"),
        F.when(F.contains(low, F.lit("canonical")), F.coalesce(
            found(src, r"""(?i)<link[^>]+rel=["']canonical["'][^>]*href=["']([^"']+)["']""", 1),
            found(src, r"""(?i)<link[^>]+href=["']([^"']+)["'][^>]*rel=["']canonical["']""", 1),
        )).alias("canonical_href"),
        _within(
            "noindex",
            r"""(?i)<meta[^>]+(?:name=["'](?:robots|googlebot)["'][^>]*content=["'][^"']*noindex"""
            r"""|content=["'][^"']*noindex[^>]*name=["'](?:robots|googlebot)["'])""",
        ).alias("noindex"),
        occurrences(html, r"(?i)<h1[\s>]").alias("h1_tags"),
        word_count_of_collapsed(F.col("text")).alias("words"),
        _within("og:", r"""(?i)property=["']og:(?:title|image)["']""").alias("has_og"),
        F.when(img_tags > 0, occurrences(html, r"(?i)<img[^>]+(?<!\w)alt=") / img_tags).otherwise(1.0).alias("alt_share"),
        (matches(F.lower("title"), NOT_FOUND_PHRASE) | matches(F.col("first_h1"), NOT_FOUND_PHRASE)).alias("not_found"),
        F.length("levels").alias("headings"),
        (F.length("levels") - F.length(F.replace(F.col("levels"), F.lit("1"), F.lit("")))).alias("h1_levels"),
        found(F.col("levels"), "1[3-6]|2[4-6]|3[56]|46").alias("level_jump"),
        _within("hreflang=", r"""(?i)rel=["']alternate["'][^>]*hreflang=""").alias("declares_hreflang"),
        bad_hreflang.alias("bad_hreflang"),
        _within("ld+json", r"""(?i)<script[^>]+type=["']application/ld\+json["']""").alias("has_jsonld"),
        _lead_state(md).alias("lead_state"),
        (_within("@type", r'(?i)"@type"\s*:\s*"Question"') | F.contains(low, F.lit("faqpage"))
         | (F.contains(md, F.lit("#")) & matches(md, r"(^|\n)#+[^\n]*\?"))
         | (F.contains(low, F.lit("<summary")) & matches(html, r"(?i)<summary[^>]*>[^<]*\?"))).alias("has_qa"),
        _statistics(md).alias("statistics"),
        fresh.alias("fresh_date"),
        (F.contains(low, F.lit("last updated")) | F.contains(low, F.lit("<time"))).alias("fresh_hint"),
        (F.contains(low, F.lit('"author"')) | F.contains(low, F.lit('"organization"'))
         | F.contains(low, F.lit('"sameas"')) | _within("author", r"""(?i)rel=["']author["']""")).alias("has_author"),
        _typed_schema().alias("typed_schema"),
        _within(
            "snippet",
            r"""(?i)<meta[^>]+name=["']robots["'][^>]*content=["'][^"']*(?:nosnippet|max-snippet:\s*0)""",
        ).alias("nosnippet"),
        ((occurrences(md, r"(?m)^\s*(?:[-*]\s+|\d+\.\s+)") >= 3)
         | (F.contains(md, F.lit("|")) & (occurrences(md, r"(?m)^\s*\|.*\|\s*$") >= 2))
         | matches(html, r"(?i)<table[\s>]")).alias("extractable"),
        _authority_links(md).alias("authority_hosts"),
        _brand_score(src, low, F.col("title")).alias("brand_score"),
        (F.col("same_as").isNotNull()).alias("has_same_as"),
        F.coalesce(matches(F.col("same_as"), r"(?i)wikipedia\.org|wikidata\.org"), F.lit(False)).alias("same_as_wiki"),
        F.coalesce(occurrences(F.col("same_as"), r"""(?i)https?://[^"']+"""), F.lit(0)).alias("same_as_links"),
        F.when(F.col("sections").isNull(), 0.0).otherwise(_section_share(F.col("sections"))).alias("section_share"),
        _takeaway_state(md).alias("takeaway_state"),
        F.when(F.contains(F.lower(html), F.lit("http://")),
               occurrences(html, r"""(?i)(?<!\w)(?:src|srcset|poster)=["']http://""")
               + occurrences(html, r"""(?i)<link[^>]+href=["']http://""")
               + occurrences(html, r"""(?i)url\(\s*['"]?http://""")).otherwise(0).alias("insecure_refs"),
        _within("viewport", r"""(?i)<meta[^>]+name=["']viewport["']""").alias("has_viewport"),
        _within("charset", r"(?i)<meta[^>]+charset").alias("has_charset"),
        _within("lang=", r"(?i)<html[^>]+lang=").alias("has_lang"),
        _within("icon", r"""(?i)<link[^>]+rel=["'][^"']*icon""").alias("has_favicon"),
        F.when(n_img > 0, sized / n_img).otherwise(1.0).alias("sized_share"),
        F.when(head.isNotNull(), F.when(F.size(blocking) == 0, 1.0).otherwise(0.0)).alias("head_free"),
        F.when(n_img > 0, (modern / n_img + lazy / n_img) / 2).otherwise(1.0).alias("modern_share"),
        matches(raw, r"(?i)^\s*<!doctype html>").alias("html5"),
        word_count(without_tags(not_shown)).alias("rendered_words"),
        container_id(src).alias("container_id"),
        *[flag.alias(f"det_{name}") for name, flag in page_detectors(src, low).items()],
    ]
    return parts, facts
