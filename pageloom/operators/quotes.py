"""Quote checks: which of many phrases occur in the text of their report, by an index of the phrases that page windows are looked up in.

A report's text is all its pages joined by blanks. It is never assembled: phrases are looked for inside pages and, because they
may run over page ends, in the seams between pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import collapsed, plain_space, trimmed
from pageloom.operators.folds import ordered_fold
from pageloom.plans.rubric import SEMANTIC_CHECKS
from pageloom.session import materialize, salted_join, salts

MIN_QUOTE = 8
WINDOW = MIN_QUOTE  # characters of a phrase's head that the index holds: no phrase is shorter
PHRASES_AT_ONCE = 20_000  # of a report that one task indexes
STRIP = 1 << 20  # characters that are looked up in one step
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: products of its powers keep every bit


def normal_quote(c: Column) -> Column:
    return collapsed(plain_space(F.lower(F.coalesce(c, F.lit("")))))


def page_texts(pages: DataFrame) -> DataFrame:
    """``(report_id, page_ord, text)``: the normalised text of every page that has one."""
    texts = pages.select("report_id", "page_ord", F.lower("markdown").alias("text"))
    tidy = texts.withColumn("text", plain_space(F.col("text"))).withColumn("text", collapsed(F.col("text")))
    # A filter on the text would be pushed below it and evaluate it twice; a generator is not.
    return tidy.withColumn("text", F.explode(F.filter(F.array("text"), lambda t: t != "")))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    powers = np.full(n, _BASE)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


class PhraseIndex:
    """Phrases by the hash of their first ``WINDOW`` characters, each with its length and the hash of all of it.

    ``find`` hashes every window of a text, looks all of them up at once, and compares the stretch of text behind each hit
    with the phrase: by hash for all hits together, then by characters for those that are left.
    """

    def __init__(self, phrases: list[str]) -> None:
        hashes = [_codes(p) for p in phrases]
        weights = _powers(max(map(len, hashes)))
        heads = np.array([(c[:WINDOW] * weights[:WINDOW]).sum(dtype=np.uint64) for c in hashes])
        self.order = np.argsort(heads, kind="stable")
        self.phrases = [phrases[k] for k in self.order]
        self.lengths = np.array([len(hashes[k]) for k in self.order])
        self.whole = np.array([(hashes[k] * weights[: len(hashes[k])]).sum(dtype=np.uint64) for k in self.order])
        self.heads, self.first, self.sizes = np.unique(heads[self.order], return_index=True, return_counts=True)

    def find(self, text: str) -> set[int]:
        """Numbers, in the order given, of the phrases that occur in the text."""
        found: set[int] = set()
        longest = int(self.lengths.max())
        for start in range(0, max(1, len(text) - WINDOW + 1), STRIP):
            self._strip(text[start : start + STRIP + longest - 1], found)
        return {int(self.order[k]) for k in found}

    def _strip(self, text: str, found: set[int]) -> None:
        windows = min(len(text) - WINDOW + 1, STRIP)
        if windows <= 0:
            return
        codes = _codes(text)
        weights = _powers(len(codes) + 1)
        hashes = np.zeros(windows, np.uint64)
        for k in range(WINDOW):
            hashes += codes[k : k + windows] * weights[k]
        at = np.minimum(np.searchsorted(self.heads, hashes), len(self.heads) - 1)
        begin = np.flatnonzero(self.heads[at] == hashes)
        if not len(begin):
            return
        head, sums = at[begin], np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * weights[:-1], dtype=np.uint64)))
        for nth in range(int(self.sizes[head].max())):  # phrases that share a head, one after the other
            some = self.sizes[head] > nth
            phrase, place = self.first[head[some]] + nth, begin[some]
            inside = place + self.lengths[phrase] <= len(codes)
            phrase, place = phrase[inside], place[inside]
            same = sums[place + self.lengths[phrase]] - sums[place] == self.whole[phrase] * weights[place]
            for k, p in zip(phrase[same].tolist(), place[same].tolist(), strict=True):
                if k not in found and text.startswith(self.phrases[k], p):
                    found.add(k)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: for one part of a report after the other, its phrases (text and number) and then its pieces of text; numbers found go out."""
    key: tuple | None = None
    phrases: list[str] = []
    numbers: list[int] = []
    left: set[int] = set()
    index: PhraseIndex | None = None
    for batch in batches:
        out: list[int] = []
        keys = zip(*(batch.column(n).to_pylist() for n in ("report_id", "tile", "block")), strict=True)
        for now, number, text in zip(keys, batch.column("phrase").to_pylist(), batch.column("text"), strict=True):
            if now != key:
                key, phrases, numbers, left, index = now, [], [], set(), None
            if number is not None:
                phrases.append(text.as_py())
                numbers.append(number)
                left.add(len(numbers) - 1)
            elif left:
                index = index or PhraseIndex(phrases)
                new = index.find(text.as_py()) & left
                left -= new
                out += [numbers[k] for k in sorted(new)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["phrase"])


def occurring(pieces: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(phrase)``: numbers of the phrases that occur in a piece of their report, each once.

    ``pieces``: ``report_id, spread, text``, where ``spread`` deals the pieces of a report out to tasks; ``phrases``: ``report_id, phrase, text``, a
    number and ``WINDOW`` characters or more. Only pieces of reports with phrases are moved, once; a report's pieces are dealt
    over blocks, to each of which its phrases go, in tiles if there are many, so no report is one task's work.
    """
    blocks = salts(pieces.sparkSession)
    tiles = phrases.groupBy("report_id").agg(F.ceil(F.count("*") / PHRASES_AT_ONCE).cast("int").alias("tiles"))
    asked = salted_join(pieces, tiles, ["report_id"], "inner", "spread").select(
        "report_id", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.pmod(F.col("spread"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(None).cast("long").alias("phrase"), "text")
    known = phrases.join(tiles, "report_id").select(
        "report_id", F.pmod(F.xxhash64("phrase"), F.col("tiles")).cast("int").alias("tile"),
        F.explode(F.array(*[F.lit(k) for k in range(blocks)])).alias("block"), "phrase", "text")
    key = ["report_id", "tile", "block"]
    dealt = known.unionByName(asked).repartition(*key).sortWithinPartitions(*key, F.col("phrase").asc_nulls_last())
    return dealt.mapInArrow(_looked_up, "phrase long").distinct()


class _Seams:
    """Text around page boundaries: the tail of everything before a page, up to the report's ``reach`` in characters, and the page's head."""

    def start(self, key: Any) -> str:
        return ""

    def _join(self, before: str, text: str) -> str:
        return before + " " + text if before else text

    def summarize(self, rows: pd.DataFrame) -> tuple[str, bool, int]:
        # Only the last `reach` characters matter; `full` says that older text cannot reach past this run.
        tail, full, reach = "", False, int(rows["reach"].iloc[0])
        for head, end, whole in zip(rows["head"], rows["tail"], rows["whole"]):
            tail = self._join(tail, head) if whole else end
            full = full or not whole or len(tail) > reach
            tail = tail[-reach:]
        return tail, full, reach

    def merge(self, first: tuple[str, bool, int], second: tuple[str, bool, int]) -> tuple[str, bool, int]:
        if second[1]:
            return second
        joined, reach = self._join(first[0], second[0]), first[2]
        return joined[-reach:], first[1] or len(joined) > reach, reach

    def advance(self, state: str, summary: tuple[str, bool, int]) -> str:
        tail, full, reach = summary
        return (tail if full else self._join(state, tail))[-reach:]

    def emit(self, state: str, rows: pd.DataFrame) -> tuple[str, pd.DataFrame]:
        seams, reach = [], int(rows["reach"].iloc[0])
        for head, end, whole in zip(rows["head"], rows["tail"], rows["whole"]):
            seams.append(self._join(state, head))
            state = (self._join(state, head) if whole else end)[-reach:]
        out = rows[["report_id"]].copy()
        out["seam"] = seams
        return state, out


def _seams(texts: DataFrame, reaches: DataFrame) -> DataFrame:
    """``(report_id, seam)``: the text around each page's begin, as far as its report's longest phrase can reach over it."""
    reach = F.col("reach")
    ends = salted_join(texts, reaches, ["report_id"], "inner", "page_ord").select(
        "report_id", "page_ord", F.left("text", reach).alias("head"), F.right("text", reach).alias("tail"),
        (F.length("text") <= reach).alias("whole"), "reach")
    return ordered_fold(ends, "report_id", ["page_ord"], _Seams(), "report_id string, seam string")


def verified_in(verdicts: DataFrame, texts: DataFrame) -> DataFrame:
    """Verdicts ``(report_id, check_id, verdict, quote)`` that hold: known check, finite value, and for positive ones a
    quote of ``MIN_QUOTE`` normalised characters or more that occurs in the report's text.

    ``texts`` are those of ``page_texts``, a written table: it is read once for its pages and once for their ends.
    """
    value = F.least(F.greatest(F.col("verdict"), F.lit(0.0)), F.lit(1.0))
    finite = F.col("verdict").isNotNull() & ~F.isnan("verdict") & (F.abs("verdict") != float("inf"))
    known = verdicts.filter(F.col("check_id").isin(*SEMANTIC_CHECKS) & finite).select(
        "report_id", "check_id", value.alias("verdict"), normal_quote(F.col("quote")).alias("text"))
    free = known.filter(F.col("verdict") <= 0).select("report_id", "check_id", "verdict")
    claims = materialize(known.filter((F.col("verdict") > 0) & (F.length("text") >= MIN_QUOTE)).withColumn(
        "phrase", F.monotonically_increasing_id()), "claims")
    reaches = claims.groupBy("report_id").agg((F.max(F.length("text")) - 1).alias("reach"))
    pieces = texts.select("report_id", F.xxhash64("page_ord").alias("spread"), "text").unionByName(
        _seams(texts, reaches).select("report_id", F.xxhash64("seam").alias("spread"), F.col("seam").alias("text")))
    held = occurring(pieces, claims.select("report_id", "phrase", "text"))
    return free.unionByName(claims.join(held, "phrase", "left_semi").select("report_id", "check_id", "verdict").distinct())


def verified_verdicts(verdicts: DataFrame, pages: DataFrame) -> DataFrame:
    """``verified_in`` for pages ``(report_id, page_ord, markdown)``: texts of the reports with verdicts are normalised once, into a table."""
    judged = salted_join(pages, verdicts.select("report_id").distinct(), ["report_id"], "left_semi", "page_ord")
    return verified_in(verdicts, materialize(page_texts(judged), "page-texts"))
