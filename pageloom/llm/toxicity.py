"""Toxicity: windows of text compressed under a toxic and an ordinary zstandard dictionary, and a calibrated score."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.columns import PIECE, flat, mixed_bits, pieces, word_bounds, word_hashes

WINDOW = 64  # bytes of a window
TOXIC_ROWS, ORDINARY_ROWS, CALIBRATION_ROWS = 1500, 6000, 6000  # labelled rows that training reads at most
WORDS_AT_ONCE = 1 << 19
SAMPLES = 60_000  # pieces of ordinary text that the dictionary is trained on
TRAINING_CHARS = 200_000  # longer labelled texts are not trained on; every text is scored whole
TRAINING_BYTES = 192 << 20  # of text that training reads at most, in the order in which rows are chosen
ORDINARY_BYTES, TOXIC_BYTES = 8192, 4096  # of the dictionaries
TAIL = 48  # bytes of shared text after a window
RATIO = 8.0  # how much more often than in ordinary text a word of the toxic sample has to occur
EDGES = (2, 3, 4, 6)  # bytes saved from which a window counts, one feature each
MISS_COST = 3.0  # of a toxic row scored low, against an ordinary row scored high
PARAMETERS = dict(window_log=16, hash_log=16, chain_log=16, search_log=6, min_match=4, target_length=32,
                  strategy=zstandard.STRATEGY_LAZY2, write_checksum=False, write_content_size=False, write_dict_id=False)
REPEATS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"  # fixed value: what ends the header of a dictionary in the format's own layout


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the weights of the calibrated score; without training rows of both classes the base rate only."""

    ordinary: bytes
    toxic: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float


def tidy(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def windows(raw: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and row of windows of whole words that cover every text; a longer word is a window of its own."""
    begin, end = word_bounds(raw, offsets)
    row = np.searchsorted(offsets, begin, "right") - 1
    cell = (end - offsets[row]) // size
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])))) if len(row) else np.zeros(0, np.int64)
    last = np.concatenate((first[1:], [len(row)]))[: len(first)] - 1
    return begin[first], end[last] - begin[first], row[first]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**PARAMETERS), dict_data=content)


def saved(raw: np.ndarray, begin: np.ndarray, length: np.ndarray, model: Model) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window against the ordinary one.

    The last bytes of the part that both dictionaries share follow each window: the compressor looks for no match that begins in
    the last 16 bytes of its input, and stores short inputs raw. They cost both a single match.
    """
    if not len(begin):
        return np.zeros(0, np.int64)
    tail = np.frombuffer(model.ordinary[-TAIL:], np.uint8)
    whole = length + len(tail)
    at = np.cumsum(whole) - whole
    joined = np.empty(int(whole.sum()), np.uint8)
    joined[((at + length)[:, None] + np.arange(len(tail))).ravel()] = np.tile(tail, len(at))
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    joined[inside + np.repeat(at, length)] = raw[inside + np.repeat(begin, length)]
    buffer = zstandard.BufferWithSegments(joined.tobytes(), np.stack([at, whole], 1).astype(np.uint64).tobytes())
    sizes = [np.fromiter(map(len, compressor(d).multi_compress_to_buffer(buffer, threads=1)), np.int64, len(begin))
             for d in (model.ordinary, model.toxic)]
    return sizes[0] - sizes[1]


def features(column: pa.Array, model: Model) -> np.ndarray:
    """Per row: logs of the shares of windows that save enough, the mean saving, and the log of the windows' number."""
    raw_all, offsets_all = flat(tidy(column))
    out = np.zeros((len(column), len(EDGES) + 2))
    for first, last in pieces(offsets_all, PIECE):
        offsets = offsets_all[first : last + 1] - offsets_all[first]
        raw = raw_all[offsets_all[first] : offsets_all[last]]
        begin, length, row = windows(raw, offsets)
        won = saved(raw, begin, length, model)
        n = last - first
        count = np.bincount(row, minlength=n) + 1.0
        for k, edge in enumerate(EDGES):
            out[first:last, k] = np.log((np.bincount(row, won >= edge, minlength=n) + 0.1) / count)
        out[first:last, -2] = np.bincount(row, np.clip(won - 1, 0, 8), minlength=n) / count
        out[first:last, -1] = np.log(count)
    return out


def scores(column: pa.Array, model: Model) -> np.ndarray:
    rows = features(column, model) if len(model.weights) else np.zeros((len(column), 0))
    return 1 / (1 + np.exp(-((rows - model.centre) / model.scale @ model.weights + model.intercept)))


def _content(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """Content of a dictionary trained on the samples; where there are too few to train on, their own last bytes."""
    try:
        trained = zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
        return trained[trained.index(REPEATS) + len(REPEATS) :]
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


class _Words:
    """All words of some texts as arrays: a few numbers a word, where lists of strings would fill the driver."""

    def __init__(self, texts: list[str]):
        self.raw, offsets = flat(tidy(pa.array(texts, pa.large_string())))
        self.begin, self.end = word_bounds(self.raw, offsets)
        steps = [slice(k, k + WORDS_AT_ONCE) for k in range(0, len(self.begin), WORDS_AT_ONCE)]
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *(word_hashes(self.raw, self.begin[k], self.end[k]) for k in steps)])
        row = np.searchsorted(offsets, self.begin, "right")
        before = np.where(row == np.concatenate(([-1], row[:-1])), np.concatenate((self.hashes[:1], self.hashes[:-1])), np.uint64(0))
        _, one = np.unique(mixed_bits(before) + self.hashes, return_index=True)
        self.known, at, self.counts = np.unique(self.hashes[one], return_index=True, return_counts=True)
        self.sample = one[at]  # a place where each known word stands

    def contexts(self, words: np.ndarray) -> np.ndarray:
        """In how many different places, told apart by the word before, each word stands: copies count once."""
        if not len(self.known):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, self.counts[at], 0)

    def spelled(self, places: np.ndarray) -> list[bytes]:
        return [self.raw[s:e].tobytes() for s, e in zip(self.begin[places], self.end[places], strict=True)]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The ordinary dictionary, and the toxic one: words that stand out in toxic text, put in front of the same ordinary text.

    Sharing the ordinary part makes both compress ordinary windows alike, so that a difference comes from toxic words.
    """
    bad, good = _Words(toxic), _Words(ordinary)
    n_bad, n_good = max(1, int(bad.counts.sum())), max(1, int(good.counts.sum()))
    least = max(3, round(3.5e-5 * n_bad))
    rare = bad.counts / n_bad >= RATIO * (good.contexts(bad.known) + 1) / n_good
    telling = bad.known[(bad.counts >= least) & rare & (bad.end[bad.sample] - bad.begin[bad.sample] >= 4)]
    found = [b" " + w + b" " for w in bad.spelled(np.flatnonzero(np.isin(bad.hashes, telling)))]
    chunks = np.arange(0, len(good.begin), 30)[:SAMPLES]
    runs = [good.raw[good.begin[k] : good.end[min(k + 29, len(good.end) - 1)]].tobytes() for k in chunks]
    common = _content([b" ".join(r.split()) for r in runs], ORDINARY_BYTES, 64, 8)
    return common, _content([b"".join(found[k : k + 6]) for k in range(0, len(found), 6)], TOXIC_BYTES, 16, 6) + common


def logistic(rows: np.ndarray, labels: np.ndarray, cost: float = MISS_COST, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps; a row of label 1 counts ``cost`` times."""
    weight = np.where(labels == 1, cost, 1.0)
    x = np.c_[rows, np.ones(len(rows))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - labels)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(rows: list[tuple[str, int]], dictionary_rows: int) -> Model:
    """The first ``dictionary_rows`` of each kind's share make the dictionaries; the score is calibrated on the others."""
    toxic, ordinary = ([t for t, y in rows if y == k] for k in (1, 0))
    rate = (len(toxic) + 1) / (len(rows) + 2)
    base = Model(b"", b"", np.zeros(0), np.ones(0), np.zeros(0), float(np.log(rate / (1 - rate))))
    if len(toxic) < 4 or len(ordinary) < 4:
        return base
    half = (min(dictionary_rows, len(toxic) * 2 // 3), min(ORDINARY_ROWS, len(ordinary) * 2 // 3))
    common, telling = dictionaries(toxic[: half[0]], ordinary[: half[1]])
    if telling == common:
        return base
    model = Model(common, telling, np.zeros(len(EDGES) + 2), np.ones(len(EDGES) + 2), np.zeros(len(EDGES) + 2), 0.0)
    rest = [(t, 1) for t in toxic[half[0] :]] + [(t, 0) for t in ordinary[half[1] :]]
    x, y = features(pa.array([t for t, _ in rest], pa.large_string()), model), np.array([k for _, k in rest])
    centre, scale = x.mean(0), x.std(0) + 1e-9
    weights, intercept = logistic((x - centre) / scale, y)
    return Model(common, telling, centre, scale, weights, intercept)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS + CALIBRATION_ROWS // 4,
           ordinary_rows: int = ORDINARY_ROWS + CALIBRATION_ROWS) -> Model:
    """A model from a bounded sample of labelled rows that are not held out: of each label, those that come first by hash.

    Labels are rows (doc_id, toxic); an id with a label of 1 is toxic, ids or labels that are null are left out. The
    sample's size does not depend on the input: ``toxic_rows`` and ``ordinary_rows`` texts of up to TRAINING_CHARS characters,
    one for each id (of several the first by its digest), and TRAINING_BYTES of them meet in one task, and the driver gets the
    model alone.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order).limit(toxic_rows).union(known.where("toxic = 0").orderBy(order).limit(ordinary_rows))
    texts = docs.select(F.col("doc_id"), F.col("text")).where(F.length("text") <= TRAINING_CHARS).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        model = train([(text, toxic) for _, _, text, toxic in rows], TOXIC_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(astuple(model))], pa.binary())], names=["model"])

    single = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic"))
    placed = single.select(order.alias("at"), F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic")).repartition(1)
    read = F.sum(F.octet_length("text")).over(Window.orderBy("at", "doc_id"))  # over the chosen rows alone, a bounded number
    sample = placed.withColumn("read", read).where(F.col("read") <= TRAINING_BYTES).select("at", "doc_id", "text", "toxic")
    found = sample.mapInArrow(run, "model binary").collect()
    return Model(*pickle.loads(found[0][0])) if found else train([], 0)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, the whole text of each in windows.

    Only the text is scored. Null and empty texts have no window and get the score that a text without evidence has; equal
    texts get equal scores. Without enough labelled rows of both kinds every score is the base rate. A null doc_id is not held out.
    """
    model = fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(batch.column(2), model))],
                                             names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score stays under ``least``, with all their columns, without a shuffle."""
    model = fitted(docs, labels)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = pa.array(scores(batch.column(place), model) < least)
            yield pa.RecordBatch.from_arrays([pc.filter(c, stays) for c in batch.columns], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
