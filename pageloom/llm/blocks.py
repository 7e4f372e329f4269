"""Leaf blocks of a page's tree: runs of text between block tags, with the tags they stand under."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

# Tag names of the markup language by what they do to text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody "
    "td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN_TAGS = frozenset("head iframe noembed noframes noscript object script style svg template textarea title".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())  # any other ends an open head
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes".split())  # no tags inside
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl select".split())  # a sibling's implied end does not reach over these
CLOSES_P = BLOCK_TAGS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option", "optgroup", "frameset"}

SPACE = "\t\n\f\r "
NAME = re.compile(rf"[a-zA-Z][^{SPACE}/>]*+")
# A tag with attributes as they should be, none of whose parts is read twice; whatever else a tag holds is read by its states.
TIDY = re.compile(rf"((?:[{SPACE}/]++[^{SPACE}/>=\"'<]++(?:=(?:\"[^\"]*+\"|'[^']*+'|[^{SPACE}>=\"'<`]++))?+)*+[{SPACE}/]*+)>")
BREAK = re.compile(rf"[{SPACE}/>=]")
VALUE_END = re.compile(rf"[{SPACE}>]")
DEEPEST = 512  # open tags whose names a path takes in: what is nested deeper stands under these, as in the trees of browsers
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PAIRS = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
WORDS = re.compile(r"[a-z]+")
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[{SPACE}/>])|\Z", re.I) for tag in RAW_TAGS}


@lru_cache(maxsize=50_000)
def _attributes(tag: str, text: str) -> tuple[bool, tuple[str, ...]]:
    """Whether the attributes hide the element, and the words of its names."""
    named = tuple(w for found in NAMES.findall(text) for w in WORDS.findall("".join(found).lower()))
    hides = any(name.lower() == "hidden" or (name.lower() == "style" and NOT_SHOWN.search("".join(value))) for name, *value in PAIRS.findall(text))
    return hides, tuple(f"{tag}.{w}" for w in named)


def _untidy(html: str, at: int) -> tuple[int, str] | None:
    """End of a tag and its attributes, rewritten with quotes around values; None where the page ends inside the tag."""
    found, size = [], len(html)
    while True:
        slash = False
        while at < size and (html[at] in SPACE or html[at] == "/"):
            slash = html[at] == "/"
            at += 1
        if at >= size:
            return None
        if html[at] == ">":
            return at + 1, "".join(found) + "/" * slash
        m = BREAK.search(html, at + 1)  # a first sign of equality is part of a name
        if m is None:
            return None
        name, at = html[at : m.start()], m.start()
        while at < size and html[at] in SPACE:
            at += 1
        value = ""
        if at < size and html[at] == "=":
            at += 1
            while at < size and html[at] in SPACE:
                at += 1
            if at < size and html[at] in "\"'":
                end = html.find(html[at], at + 1)
                if end < 0:
                    return None
                value, at = html[at + 1 : end], end + 1
            elif at < size and html[at] != ">":
                m = VALUE_END.search(html, at)
                if m is None:
                    return None
                value, at = html[at : m.start()], m.start()
        found.append(f' {name}="{value}"'.replace('"', " ") if '"' in name else f' {name}="{value.replace(chr(34), " ")}"')


def next_tag(html: str, at: int) -> tuple[int, int, bool, str, str] | None:
    """The next markup from a place on: (begin, end, whether it closes, tag, attributes); the tag of comments and the like is empty.

    One forward scan with the states of the language's standard: quotes count only at the begin of a value, a comment or a tag that
    the page does not end reaches to its end, and a sign that opens no markup is text. No part of a page is read more
    than twice.
    """
    size = len(html)
    while (at := html.find("<", at)) >= 0:
        sign = html[at + 1 : at + 2]
        if sign in ("!", "?"):
            if html.startswith("<!--", at):
                end = html.find("-->", at + 2) if html.startswith(("<!-->", "<!--->"), at) else html.find("-->", at + 4)
                return at, size if end < 0 else end + 3, False, "", ""
            end = html.find(">", at)
            return at, size if end < 0 else end + 1, False, "", ""
        closes = sign == "/"
        name = NAME.match(html, at + 1 + closes)
        if name:
            if tidy := TIDY.match(html, name.end()):
                return at, tidy.end(), closes, name[0].lower(), tidy[1]
            found = _untidy(html, name.end())
            return (at, size, False, "", "") if found is None else (at, found[0], closes, name[0].lower(), found[1])
        if closes and at + 2 < size:
            end = html.find(">", at)
            return at, size if end < 0 else end + 1, False, "", ""
        at += 1
    return None


class Block(NamedTuple):
    """Text as read, share of it inside links, its nearest block tag, and what it stands under, outermost first."""

    text: str
    linked: float
    tag: str
    path: tuple[str, ...]


def leaf_blocks(html: str | None, hidden: bool = False) -> Iterator[Block]:
    """Blocks in page order: character references decoded, white space as one space, blank ones left out.

    Ends that nothing opened are ignored; a block tag ends an open ``p``, and items and cells end the ones before them.
    An open ``head`` ends at text, at ``body`` and at the first tag that cannot stand in it.
    The path names each open tag, and the words of its class, id and role as ``tag.word``. Elements hidden by their ``hidden``
    attribute or style are left out; with ``hidden`` they are read, and the path has ``tag.:hidden`` for them.
    """
    html = html or ""
    stack: list[tuple[str, str, tuple[str, ...], bool]] = [("", "", (), False)]  # tag, nearest block tag, path, unseen
    text: list[str] = []
    linked = at = 0
    open_tags = {"a": 0, "p": 0}

    def block() -> Block | None:
        nonlocal linked
        said = "".join(text)
        size, in_links = len(said), linked
        text.clear()
        linked = 0
        said = " ".join((unescape(said) if "&" in said else said).split())
        return Block(said, in_links / size, stack[-1][1], stack[-1][2]) if said else None

    def pop(to: int) -> None:
        for entry in stack[to:]:
            if entry[0] in open_tags:
                open_tags[entry[0]] -= 1
        del stack[to:]

    def innermost(tags: frozenset[str] | set[str], stop: frozenset[str] = frozenset()) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in stop:
                return 0
            if stack[k][0] in tags:
                return k
        return 0

    while True:
        markup = next_tag(html, at)
        end = markup[0] if markup else len(html)
        if end > at and stack[-1][0] == "head" and not html[at:end].isspace():
            pop(len(stack) - 1)
        if end > at and not stack[-1][3]:
            text.append(html[at:end])
            if open_tags["a"]:
                linked += end - at
        if markup is None:
            break
        _, at, closes, tag, attributes = markup
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            if text and (found := block()):
                yield found
        elif tag == "br" and not stack[-1][3]:
            text.append(" ")
        if closes:
            place = len(stack) - 1 if stack[-1][0] == tag else innermost({tag})
            if place:
                pop(place)
            continue
        if stack[-1][0] == "head" and tag not in HEAD_TAGS:
            pop(len(stack) - 1)
        elif tag == "body" and (place := innermost({"head"})):
            pop(place)
        if open_tags["p"] and tag in CLOSES_P:
            pop(innermost({"p"}))
        if tag in CLOSED_BY_SIBLING and (place := innermost(CLOSED_BY_SIBLING[tag], SCOPES)):
            pop(place)
        if tag in VOID_TAGS:
            continue
        if tag in RAW_TAGS:
            at = RAW_ENDS[tag].search(html, at).start()  # its end tag, which nothing opened, is read next
            continue
        if attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        _, near, path, unseen = stack[-1]
        hides, named = _attributes(tag, attributes) if "=" in attributes or "hidden" in attributes.lower() else (False, ())
        if hidden and hides:
            hides, named = False, (*named, f"{tag}.:hidden")
        if tag in BLOCK_TAGS:
            near = tag
        if len(stack) <= DEEPEST and (tag in BLOCK_TAGS or named):
            path = (*path, tag, *named)
        stack.append((tag, near, path, unseen or hides or tag in UNSEEN_TAGS))
        if tag in open_tags:
            open_tags[tag] += 1
    if text and (found := block()):
        yield found
