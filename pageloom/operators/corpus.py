"""The searchable corpus: documents, chunks, metadata, conversations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import ALL_SPACE, plain_space, trimmed, without_tags
from pageloom.functions.urls import page_kind
from pageloom.session import materialize, salted_join

BLOCK = 1_000
CHUNK_CHARS = 1_200
CHUNK_OVERLAP = 120
TEXTS_AT_ONCE = 4 << 20


# --- documents and chunks -----------------------------------------------------------------------------------------


def with_document_text(pages: DataFrame) -> DataFrame:
    """Adds ``content``: markdown if there is any, else html without tags; blanks before a line end go.

    In steps, because each reads the one before several times.
    """
    text = F.coalesce(F.nullif("markdown", F.lit("")), without_tags(F.coalesce("html", F.lit(""))))
    plain = pages.withColumn("content", text).withColumn("content", plain_space(F.col("content")))
    tidy = F.when(F.contains("content", F.lit("\n")), F.regexp_replace("content", r"\s+\n", "\n")).otherwise(F.col("content"))
    return plain.withColumn("content", trimmed(tidy))


def prepared_documents(pages: DataFrame, roots: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """One document per page with text, whole; with a ``budget``, those of each report in page order until it is used up."""
    texts = with_document_text(pages).select("report_id", "page_ord", "source_url", F.coalesce("title", F.lit("")).alias("title"), "content")
    # A filter on the text would be pushed below it and evaluate it twice; a generator is not.
    docs = texts.withColumn("content", F.explode(F.filter(F.array("content"), lambda c: c != "")))
    if budget is not None:
        docs = within_budget(materialize(docs, "documents"), budget)
    if roots is not None:
        docs = salted_join(docs, roots.select("report_id", "root_url"), ["report_id"], "left", "page_ord")
        url = F.coalesce("source_url", "root_url")
    else:
        url = F.col("source_url")
    return docs.select("report_id", "page_ord", url.alias("url"), "title", page_kind(url).alias("page_type"), "content")


def within_budget(docs: DataFrame, budget: int) -> DataFrame:
    """Documents of each report in page order until ``budget`` characters are used up, the last one cut.

    A running sum per report, worked out on lengths alone and in two steps, so that a report with a third of all pages is
    not one window: sums per block of page numbers first (a thousandth of the rows), then, only in the blocks where the
    budget is not yet used up, page by page. Texts join back afterwards.
    """
    sizes = docs.select("report_id", "page_ord", F.floor(F.col("page_ord") / BLOCK).alias("block"), F.length("content").alias("chars"))

    def before(order: str) -> Column:
        rows = Window.partitionBy("report_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("chars").over(rows), F.lit(0))

    open_blocks = (
        sizes.groupBy("report_id", "block").agg(F.sum("chars").alias("chars"))
        .withColumn("spent", before("block")).filter(F.col("spent") < budget).select("report_id", "block")
    )
    kept = (
        sizes.join(open_blocks, ["report_id", "block"], "left_semi")
        .withColumn("used", before("page_ord")).filter(F.col("used") < budget)
        .select("report_id", "page_ord", "used")
    )
    return docs.join(kept, ["report_id", "page_ord"]).withColumn(
        "content", F.expr(f"substring(content, 1, cast({budget} - used as int))")).drop("used")


def fixed_chunks(docs: DataFrame, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` characters, each repeating the last ``overlap`` of the one before; only windows leave the row."""
    step = size - overlap
    n = F.length("content")
    last = F.greatest(F.ceil((n - overlap) / F.lit(step)).cast("int"), F.lit(1)) - 1
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("content"), i * step + 1, F.lit(size)))
    return docs.select(*[c for c in docs.columns if c != "content"], F.posexplode(cut).alias("chunk_no", "content"))


def _packed(begins: np.ndarray, ends: np.ndarray, joint: int, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last part of each chunk of a run of parts, none longer than ``size``, that ``joint`` characters join.

    A chunk takes parts as long as they fit. The next one begins with the first part from which on what it repeats is no
    longer than ``overlap`` and the part that did not fit does; both are searches in running sums, for all parts at once.
    The chunks are the chain of these pointers from the first part, followed by doubling.
    """
    n = len(begins)
    sums = np.concatenate(([0], np.cumsum(ends - begins + joint)))
    after = np.searchsorted(sums, sums[:-1] + size + joint, "right") - 1
    more = np.minimum(after + 1, n)
    least = np.maximum(sums[after] - joint - overlap, sums[more] - joint - size)
    following = np.append(np.where(after == n, n, np.minimum(np.searchsorted(sums, least), after)), n)
    first = np.zeros(1, np.int64)
    while first[-1] < n:
        first = np.concatenate((first, following[first]))
        following = following[following]
    first = first[: int(np.searchsorted(first, n))]
    return first, after[first] - 1


def _joined(text: str, begins: np.ndarray, ends: np.ndarray, separator: str) -> str:
    """Parts joined by one separator; a stretch of the text as it is, where nothing else stands between them."""
    if ends[-1] - begins[0] == (ends - begins).sum() + len(separator) * (len(begins) - 1):
        return text[begins[0] : ends[-1]]
    return separator.join([text[b:e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)])


def chunked(text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Chunks of at most ``size`` characters, cut at paragraphs, else lines, else blanks, else anywhere.

    A stretch is cut at the coarsest separator it has. Parts that are still too long are stretches for the finer separators;
    neighbours between them are packed into chunks, which repeat at most ``overlap`` characters of the one before.
    White space at the ends of chunks goes, and empty ones with it.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lines = np.flatnonzero(codes == 10)
    in_run = np.arange(len(lines)) - np.maximum.accumulate(np.where(np.diff(lines, prepend=-2) > 1, np.arange(len(lines)), 0))
    doubled = np.append(np.diff(lines) == 1, False) & (in_run % 2 == 0)  # newlines in twos from the begin of each run of them
    chunks: list[tuple[int, int, str]] = []
    stretches = [(0, len(codes))]
    for separator, cuts in (("\n\n", lines[doubled]), ("\n", lines), (" ", np.flatnonzero(codes == 32))):
        longer = []
        for begin, end in stretches:
            own = cuts[np.searchsorted(cuts, begin) : np.searchsorted(cuts, end)]
            if not len(own):
                longer.append((begin, end))
                continue
            begins, ends = np.append(begin, own + len(separator)), np.append(own, end)
            begins, ends = begins[ends > begins], ends[ends > begins]
            long = ends - begins > size
            longer += zip(begins[long].tolist(), ends[long].tolist(), strict=True)
            for run in np.split(np.arange(len(begins)), np.flatnonzero(long)):
                run = run[~long[run]]
                if len(run):
                    b, e = begins[run], ends[run]
                    for k, (i, j) in enumerate(zip(*_packed(b, e, len(separator), size, overlap), strict=True)):
                        chunks.append((int(b[0]), k, _joined(text, b[i : j + 1], e[i : j + 1], separator)))
        stretches = longer
    for begin, end in stretches:
        for k, start in enumerate(range(begin, max(end - overlap, begin + 1), size - overlap)):
            chunks.append((begin, k, text[start : min(start + size, end)]))
    stripped = [chunk.strip(ALL_SPACE) for _, _, chunk in sorted(chunks, key=lambda c: c[:2])]
    return [c for c in stripped if c]


def _slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Texts in runs of at most ``size`` bytes, or of one text that is longer."""
    begin = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > begin and held + (n or 0) > size:
            yield texts.slice(begin, i - begin)
            begin, held = i, 0
        held += n or 0
    if begin < len(texts):
        yield texts.slice(begin)


def separator_chunks(docs: DataFrame, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks that prefer paragraph, line and word ends, of whole documents.

    Texts pass in Arrow batches of many rows, whatever their lengths; they are cut, and their chunks go back, in slices of ``TEXTS_AT_ONCE`` bytes.
    """

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in _slices(batch, TEXTS_AT_ONCE):
                yield pa.array([chunked(t, size, overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    return docs.select(
        *[c for c in docs.columns if c != "content"], F.posexplode(cut("content")).alias("chunk_no", "content"))


def corpus_sizes(reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks per report; a report without any cannot be searched."""
    counts = chunks.groupBy("report_id").agg(F.count("*").alias("chunks"))
    return reports.select("report_id").join(counts, "report_id", "left").select(
        "report_id", F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.coalesce(F.col("chunks") > 0, F.lit(False)).alias("searchable"))


# --- metadata -----------------------------------------------------------------------------------------------------


def contains_filter(metadata: Column, wanted: Column) -> Column:
    """All pairs of the filter map are in the metadata map."""
    return F.forall(F.map_entries(wanted), lambda e: F.try_element_at(metadata, e["key"]).eqNullSafe(e["value"]))


# --- conversations ------------------------------------------------------------------------------------------------


def history(messages: DataFrame) -> DataFrame:
    """Messages of every report in order, as sorted rows (a long conversation is never gathered into one value)."""
    return messages.select("report_id", "message_id", "role", "content").repartitionByRange(
        "report_id", "message_id").sortWithinPartitions("report_id", "message_id")


def recent_window(messages: DataFrame, size: int) -> DataFrame:
    """The last ``size`` messages of each conversation."""
    order = Window.partitionBy("report_id").orderBy(F.desc("message_id"))
    return messages.withColumn("age", F.row_number().over(order)).filter(F.col("age") <= size)
