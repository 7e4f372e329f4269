"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class, with an allow list."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.columns import flat

# The base patterns of the contract, in order of kind.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs, since a match takes all it can
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20  # characters that one entropy is taken over
LABEL = 40  # characters before a candidate that the allow list may go by, such as sha256:
#: class: its characters, and the bits per character from which a window counts. A window of 20 characters drawn evenly from
#: 16, 32 or 64 signs has about 3.3, 3.7 and 4.0 bits; letters of prose alone stay below 3.6 and never make a candidate.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 3.0),
    ("base32", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 3.4),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="), 3.7),
)
#: What looks random and is public: numbered ids, digests that name content, placeholders, paths, dates, one sign repeated.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i:sha(1|256|384|512)[-:=]?[A-Za-z0-9+/=_-]+)",
    r"(?i:.*(example|sample|placeholder|changeme|your[-_]|dummy|redacted).*)",
    r"(/?[A-Za-z_.-]*[A-Za-z_.-]/)+[A-Za-z0-9_.-]*",
    r"[0-9+/_=-]*",
    r"(.)\1*",
)

RUN = np.zeros(256, bool)
RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="]] = True


def window_entropies(text: str, size: int = WINDOW) -> Iterator[float]:
    """Bits per character of each window, by counts that change by one sign in and one out."""
    log = [0.0] + [n * np.log2(n) for n in range(1, size + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for k, sign in enumerate(text):
        if k >= size:
            n = counts[text[k - size]]
            total += log[n - 1] - log[n]
            counts[text[k - size]] = n - 1
        n = counts.get(sign, 0)
        total += log[n + 1] - log[n]
        counts[sign] = n + 1
        if k >= size - 1:
            yield np.log2(size) - total / size


def random_spans(text: str, allowed: Callable[[str], bool], size: int = WINDOW) -> list[tuple[int, int]]:
    """Parts of one candidate string that some class's windows call random; windows that overlap make one part.

    A part must mix digits with letters, and be refused by the allow list, as must the whole candidate.
    """
    if len(text) < size or not any(c.isdigit() for c in text) or not any(c.isalpha() for c in text) or allowed(text):
        return []
    hits = np.zeros(len(text), bool)
    for _, signs, least in CLASSES:
        begin = 0
        while begin < len(text):
            end = begin
            while end < len(text) and text[end] in signs:
                end += 1
            if end - begin >= size:
                for k, bits in enumerate(window_entropies(text[begin:end], size)):
                    if bits >= least:
                        hits[begin + k : begin + k + size] = True
            begin = end + 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hits.astype(np.int8), [0]))))
    parts = [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2], strict=True)]
    return [(s, e) for s, e in parts if any(c.isdigit() for c in text[s:e]) and any(c.isalpha() for c in text[s:e]) and not allowed(text[s:e])]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind; what is too short is dropped."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def spans(text: str, allowed: Callable[[str], bool]) -> list[tuple[int, int, int]]:
    """Base spans and those of entropy that overlap none of them, by start, then kind."""
    base = base_spans(text)
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW, text):
        label = re.search(r"[^\s\"'=]*\Z", text[max(0, m.start() - LABEL) : m.start()])[0]
        if label and allowed(label + m[0]):
            continue
        for s, e in random_spans(m[0], allowed):
            s, e = s + m.start(), e + m.start()
            if not any(s < be and bs < e for bs, be, _ in base):
                more.append((s, e, 3))
    return sorted(base + more, key=lambda s: (s[0], s[2]))


def _suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a span of any kind: a long run of key signs, or one of the words that patterns begin with."""
    marks = np.zeros(len(offsets) - 1, bool)
    if not len(raw):
        return marks
    stops = np.concatenate(([-1], np.flatnonzero(~RUN[raw]), [len(raw)]))
    long = np.flatnonzero(np.diff(stops) > 16)  # key ids of 16 signs are the shortest; a run over a row's end only adds rows
    for s, e in zip(stops[long] + 1, stops[long + 1], strict=True):
        first, last = np.searchsorted(offsets, (s, e - 1), "right") - 1
        marks[first : last + 1] = True
    return marks


_STARTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def scan(column: pa.Array, allow: Sequence[str]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) of every row; rows that cannot hold any are not searched sign by sign. Null is empty."""
    pattern = re.compile("|".join(f"(?:{a})" for a in _numbered(allow))) if allow else None
    allowed = (lambda s: pattern.fullmatch(s) is not None) if pattern else (lambda s: False)
    raw, offsets = flat(column)
    runs = _suspects(raw, offsets)
    for k in range(len(offsets) - 1):
        text = raw[offsets[k] : offsets[k + 1]].tobytes()
        lower = text.lower()
        if runs[k] or any(word in lower for word in _STARTS):
            decoded = text.decode("utf-8", "replace")
            yield decoded, spans(decoded, allowed)
        else:
            yield "", []


def _numbered(allow: Sequence[str]) -> list[str]:
    """Patterns that refer to their own group by \\1 are given the number the group has in the whole alternation."""
    out, before = [], 0
    for a in allow:
        out.append(re.sub(r"\\([1-9])", lambda m, b=before: f"\\{int(m[1]) + b}", a))
        before += re.compile(a).groups
    return out


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, e, kind in found)


def found_secrets(docs: DataFrame, allow: Sequence[str] = ALLOW) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans)`` for every row of the documents.

    Offsets are code points, the end exclusive. Base spans always stay; the allow list speaks only to spans that entropy
    adds. Null and empty texts have no spans (and the digest of nothing); texts of any length are read whole; rows that repeat give a
    result each; other columns play no part; an empty table gives an empty result.
    """
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [s for _, s in scan(batch.column(1), allow)]
            numbers = [pa.array([sum(x[2] == k for x in r) for r in rows], pa.int64()) for k in range(len(KINDS))]
            base = [hashlib.sha256(written([x for x in r if x[2] < 3]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(base, pa.string()), pa.array(list(map(written, rows)), pa.string())],
                                             names=["doc_id", *counts, "base_sha256", "spans"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def masked(text: str, found: list[tuple[int, int, int]], mask: str) -> str:
    """The text with every span, overlapping ones as one, replaced by the mask."""
    out, at = [], 0
    for s, e, _ in found:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, allow: Sequence[str] = ALLOW, mask: str = "<hidden>") -> DataFrame:
    """All documents, their secrets masked and ``n_chars`` (where there is such a column) brought up to date.

    Rows without secrets pass unchanged, those with null and empty texts among them; all columns stay as they came.
    """
    place = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = {k: masked(text, s, mask) for k, (text, s) in enumerate(scan(batch.column(place), allow)) if s}
            columns = list(batch.columns)
            if changed:
                for at, value in ((place, str), (length, len)):
                    if at is not None:
                        rows = columns[at].to_pylist()
                        for k, text in changed.items():
                            rows[k] = value(text)
                        columns[at] = pa.array(rows, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
