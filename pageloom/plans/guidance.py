"""Guidance per check: why it matters, how to fix it, an example, when it does not apply, and what it reads.

A deployment may pass its own table with these columns wherever one is taken; the texts below are the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "check_id string, why string, fix string, example string, when_na string, looks_for string"

_NO_TRACKING = "No tracking was visible, or a tag manager may load it where a crawl cannot see it."
_NO_HEADERS = "The response headers of the root URL were not recorded."
_NO_ROBOTS = "robots.txt was not requested."
GUIDANCE = [
    ("S1", "Searchers read the title first; a clipped or vague one loses the click.", "Write one distinct title of 15 to 60 characters per page.", "<title>Plans and prices | Acme</title>", None),
    ("S2", "The description is the sales line under the search result.", "Describe each page in 70 to 160 characters.", None, None),
    ("S3", "Without a canonical link, duplicates of a page compete with each other.", "Name the preferred URL of every page.", '<link rel="canonical" href="https://example.com/page">', None),
    ("S4", "A noindex page cannot be found in search at all.", "Take the noindex directive off pages that should rank.", None, None),
    ("S5", "The main heading tells readers and engines what the page is about.", "Give every page a main heading.", "<h1>Plans and prices</h1>", None),
    ("S10", "Very short pages rarely answer a question in full.", "Cover the topic in at least 300 words.", None, None),
    ("S12", "Shared links without preview data look broken.", "Add Open Graph title and image tags.", '<meta property="og:title" content="Plans">', None),
    ("S13", "Alternative texts serve screen readers and image search.", "Describe every meaningful image.", '<img src="team.jpg" alt="Our team">', None),
    ("S14", "A sitemap leads crawlers to all pages.", "Publish a sitemap and name it in robots.txt.", None, "The sitemap was not requested."),
    ("S15", "Equal titles make pages compete for the same query.", "Give every page its own title.", None, "Fewer than two pages have a title."),
    ("S16", "Equal descriptions tell searchers nothing about the difference.", "Write a description for each page.", None, "Fewer than two pages have a description."),
    ("S17", "Broken pages waste visits and crawl budget.", "Repair, redirect or remove pages that answer with errors.", None, None),
    ("S18", "Headings in order let people and machines skim.", "Use one main heading and do not skip levels.", None, None),
    ("S21", "Wrong language codes send visitors to the wrong version.", "Use valid language and region codes.", 'hreflang="pt-BR"', "No page declares other language versions."),
    ("S23", "A canonical that points elsewhere drops the page from search.", "Point each canonical at its own page.", None, None),
    ("T1", "Without analytics nobody knows what works.", "Install an analytics tool.", None, _NO_TRACKING),
    ("T2", "The old analytics property no longer collects data.", "Remove the old snippet.", None, _NO_TRACKING),
    ("T3", "A tag manager keeps tags in one place.", "Load tags through a tag manager.", None, "No tag manager was seen; it is optional."),
    ("T5", "Consent signals decide what may be measured.", "Set consent defaults before any tag.", "gtag('consent', 'default', {...})", _NO_TRACKING),
    ("T6", "Advertising needs the two newer consent signals.", "Set ad_user_data and ad_personalization.", None, _NO_TRACKING),
    ("T7", "Visitors must be able to refuse tracking.", "Show a consent banner.", None, _NO_TRACKING),
    ("T8", "Campaigns cannot be measured without their pixel.", "Install the pixels of the channels in use.", None, _NO_TRACKING),
    ("T12", "Recording visits without consent is a privacy risk.", "Start recordings only after consent.", None, _NO_TRACKING),
    ("T15", "Tags read page data from the data layer.", "Create the data layer before the tags.", "window.dataLayer = window.dataLayer || [];", "No data layer was seen; it is optional."),
    ("T20", "Tags that fire before the consent default ignore it.", "Move the consent default above the loader.", None, "The served html lacks one of the two markers."),
    ("G1", "Structured data states facts machines can rely on.", "Add JSON-LD for what the page is about.", '<script type="application/ld+json">{...}</script>', None),
    ("G3", "Readers without scripts, many answer engines among them, see only served html.", "Render the main content on the server.", None, "The served html was not recorded."),
    ("G4", "An opening that answers the question gets quoted.", "Open with one complete sentence before the first heading.", None, None),
    ("G5", "Questions with answers match how people ask.", "Add a short list of questions and answers.", None, None),
    ("G6", "Concrete numbers make a text worth citing.", "State figures with their units.", None, None),
    ("G7", "Fresh pages are preferred; undated ones look stale.", "Publish the date of the last change.", '"dateModified": "2024-01-31"', None),
    ("G8", "Known authors make a text credible.", "Name the author or the organisation behind the page.", None, None),
    ("G9", "A blocked crawler cannot cite the site.", "Allow the crawlers of answer engines in robots.txt.", None, _NO_ROBOTS),
    ("G11", "Typed entities tell engines what a thing is.", "Describe organisation, article or product with its fields.", None, None),
    ("G12", "Pages that forbid snippets cannot be quoted.", "Remove nosnippet and max-snippet:0.", None, None),
    ("G14", "Lists and tables can be lifted as they are.", "Turn enumerations into lists or tables.", None, None),
    ("G15", "Claims with sources are trusted.", "Link to an authoritative source.", None, None),
    ("G16", "An index for language models points to the key pages.", "Publish llms.txt.", None, "llms.txt was not requested."),
    ("G17", "One brand name in all places makes one entity.", "Use the same name in title, schema and site name.", None, "No page declares a brand name."),
    ("G18", "Profiles elsewhere confirm who the site belongs to.", "List the profiles under sameAs.", None, None),
    ("G19", "Sections that open with the answer get extracted.", "Start each section with an answer of 30 to 130 words.", None, None),
    ("G20", "A summary near the top is easy to lift.", "Add a short list of key points at the top.", None, None),
    ("TB1", "Unencrypted pages are marked as unsafe.", "Serve everything over https.", None, None),
    ("TB5", "A site that blocks all crawlers disappears from search.", "Remove the site-wide Disallow.", None, _NO_ROBOTS),
    ("TB3", "Browsers block insecure files on secure pages.", "Load all files over https.", None, None),
    ("TB4", "Without a viewport phones show the desktop page.", "Declare the viewport.", '<meta name="viewport" content="width=device-width">', None),
    ("TB10", "Encoding and language prevent garbled text.", "Declare charset and lang.", '<html lang="en">', None),
    ("TB12", "The icon identifies the site in tabs and results.", "Add a favicon.", None, None),
    ("TB6", "Images without a size make the page jump.", "Give images width and height.", None, None),
    ("TB20", "Blocking scripts delay the first paint.", "Load head scripts with defer or async.", "<script defer src=\"app.js\"></script>", "No page has a readable head."),
    ("TB19", "Modern formats and lazy loading save traffic.", "Serve WebP or AVIF and load images lazily.", None, None),
    ("TB22", "Without a doctype browsers fall back to old rules.", "Start the document with the HTML5 doctype.", "<!DOCTYPE html>", None),
    ("TB30", "Strict transport keeps visitors on https.", "Send the header with a max-age of a year.", "Strict-Transport-Security: max-age=31536000", _NO_HEADERS),
    ("TB31", "A content policy limits what injected code can do.", "Send a policy without unsafe-inline.", None, _NO_HEADERS),
    ("TB32", "Type sniffing can turn files into scripts.", "Send nosniff.", "X-Content-Type-Options: nosniff", _NO_HEADERS),
    ("TB33", "Framed pages can be abused for click theft.", "Forbid framing by other sites.", None, _NO_HEADERS),
    ("TB34", "Referrers can leak addresses.", "Send a referrer policy.", None, _NO_HEADERS),
    ("TB35", "Unused browser features should be off.", "Send a permissions policy.", None, _NO_HEADERS),
]
# What a check reads, and from what on it passes.
LOOKS_FOR = {
    "S1": "Length of the trimmed title: 15 to 60 characters passes.",
    "S2": "Length of the trimmed description: 70 to 160 characters passes.",
    "S3": "A canonical link element anywhere in the source.",
    "S4": "A robots or googlebot meta element whose content says noindex.",
    "S5": "The number of main headings in the markup: one or more passes.",
    "S10": "Words of visible text: 300 or more passes.",
    "S12": "An Open Graph title or image property.",
    "S13": "Images with an alt attribute, as a share of all images.",
    "S14": "The answer for the sitemap address, and sitemap lines in robots.txt.",
    "S15": "Titles that occur on a single page, as a share of all titles.",
    "S16": "Descriptions that occur on a single page, as a share of all descriptions.",
    "S17": "The status code, and short pages whose title or heading says that nothing was found.",
    "S18": "The order of heading levels: one main heading and no level left out on the way down.",
    "S21": "Every language value of pages that declare other versions.",
    "S23": "The canonical address against the address of the page, without scheme, query and case.",
    "T1": "Signatures of analytics vendors in sources and in the tag container.",
    "T2": "Property numbers and loaders of the retired analytics generation.",
    "T3": "The tag manager's loader or a container number.",
    "T5": "A consent command in sources or in the container.",
    "T6": "Both newer consent fields on one page, or in the container.",
    "T7": "Signatures of consent banners.",
    "T8": "Signatures of advertising and social pixels.",
    "T12": "Session recorders on sites without a consent banner.",
    "T15": "A data layer that is set up or pushed to.",
    "T20": "Where the consent default stands in the first HTML against the first tag loader.",
    "G1": "A linked-data script element.",
    "G3": "Words in the HTML before scripts run against words of the rendered home page.",
    "G4": "The first prose line of the text: 60 to 400 characters that end as a sentence.",
    "G5": "Question markup, headings that ask, or summaries that ask.",
    "G6": "Percentages, amounts of money, magnitudes and ratios: three or more pass.",
    "G7": "The newest declared date, by its age in days.",
    "G8": "An author, an organisation or profile links in the markup.",
    "G9": "Rules of robots.txt that shut out crawlers of AI services.",
    "G11": "Entity types with the properties that make them useful.",
    "G12": "Directives that forbid snippets, in pages and in the root's headers.",
    "G14": "Three list items, two table rows or a table.",
    "G15": "A link to another host that is public, academic or widely cited.",
    "G16": "The answer for the llms.txt address.",
    "G17": "The brand as the site name, the organisation and the title state it.",
    "G18": "A profile list with an encyclopedia entry or two addresses.",
    "G19": "Sections whose first prose line has 30 to 130 words and no filler opening, as a share.",
    "G20": "A summary heading near the top with a list behind it.",
    "TB1": "The scheme of each page's address.",
    "TB5": "Rules of robots.txt that shut out everyone.",
    "TB3": "Images, styles and scripts that secure pages load without encryption.",
    "TB4": "A viewport meta element.",
    "TB10": "A character set and a language of the document.",
    "TB12": "An icon link element.",
    "TB6": "Images with both dimensions or an aspect ratio, as a share.",
    "TB20": "Scripts in the head that are neither deferred, asynchronous nor modules.",
    "TB19": "Modern formats and lazy loading, as shares of all images.",
    "TB22": "The document type at the very begin of the source.",
    "TB30": "The transport-security header and how long it holds: a year or more passes.",
    "TB31": "The content policy header and whether it allows unsafe code.",
    "TB32": "The header against content sniffing.",
    "TB33": "The frame options header, or frame ancestors in the content policy.",
    "TB34": "The referrer policy header.",
    "TB35": "The permissions policy header or its older name.",
}


def guidance(spark: SparkSession) -> DataFrame:
    """58 fixed rows; safe to broadcast."""
    return spark.createDataFrame([(*g, LOOKS_FOR[g[0]]) for g in GUIDANCE], COLUMNS)
