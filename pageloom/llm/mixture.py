"""Mixing sources to target weights: whole copies that are certain, then a Pareto order sample with unequal probabilities, of fixed size in words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.columns import WORD
from pageloom.session import materialize

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BINS = 1 << 12  # of rank, per source, that are summed before any row is ranked: a window over one source reads no more rows


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``(source, source_size, target)`` from rows (source, size): the words to be taken from each source.

    Sources in order of code point, null last, have the weights in turn and share the words of all; a target stops at ``most``
    times its source's size and what is left over is shared again by weight until none is above. Sources are capped in order
    of room per weight, so the level that the others reach follows from running sums over one row per source.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    by_room = Window.orderBy(F.col("room"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    levels = weighed.withColumn("room", F.lit(float(most)) * F.col("source_size") / F.col("weight")).select(
        "*",
        F.row_number().over(by_room).alias("place"),
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("capped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    ).withColumn("level", (F.col("total") - F.lit(float(most)) * F.col("capped")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("place", "level"))).over(every)["level"]
    return levels.withColumn("reached", level).select(
        "source", "source_size",
        F.when(F.col("room") < F.col("reached"), F.lit(float(most)) * F.col("source_size"))
        .otherwise(F.col("reached") * F.col("weight")).alias("target"))


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) from the row itself, the same in every run: 52 bits of an MD5 digest."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def odds_rank(u: Column, inclusion: Column) -> Column:
    """Random odds divided by inclusion odds; the smallest ranks make a sample with about these inclusion probabilities."""
    return (u / (1 - u)) / (inclusion / (1 - inclusion))


def _bin(rank: Column) -> Column:
    return F.least(F.floor(rank / (1 + rank) * BINS), F.lit(BINS - 1)).cast("int")


def pareto_cuts(rows: DataFrame) -> DataFrame:
    """``(source, edge_bin, cut)``: where the sample of each source ends, in order of rank.

    Wants (source, rank, key, size, lacks): rows are taken in order of (rank, key, size) until their sizes come nearest to
    ``lacks``; a null rank is never taken. A source may hold any number of rows: sizes are summed by bin of rank first,
    running sums over the bins tell in which the boundary falls, and only the rows of that bin are ranked one by one.
    No row for a source all of whose ranked rows are taken; a null cut when its edge bin has none that is taken.
    """
    binned = rows.where("rank is not null").withColumn("bin", _bin(F.col("rank")))
    sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"), F.first("lacks").alias("want"))
    bins = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    over = sums.withColumn("below", F.coalesce(F.sum("in_bin").over(bins), F.lit(0))).where("below + in_bin > want")
    edges = over.groupBy("source").agg(F.min(F.struct("bin", "below")).alias("edge"))
    edges = materialize(edges.select(F.col("source").alias("of"), F.col("edge.bin").alias("edge_bin"), F.col("edge.below").alias("below")), "edges")
    at_edge = binned.join(edges, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("edge_bin")))
    order = Window.partitionBy("source").orderBy("rank", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    here = F.col("below") + F.coalesce(F.sum("size").over(order), F.lit(0))
    last = at_edge.select("source", F.when(here + F.col("size") / 2 <= F.col("lacks"), F.struct("rank", "key", "size")).alias("cut"), "edge_bin")
    return last.groupBy("source").agg(F.first("edge_bin").alias("edge_bin"), F.max("cut").alias("cut"))


def expected_copies(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``(source, amount, source_size, target, certain, share, lacks)``: how often documents of each amount are to be taken.

    Wants (source, size, amount). Expected copies are in proportion to a document's amount, up to ``most``, so that a source's
    expected words are its target: the level is the one at which the largest amount that is not capped stays below the cap,
    by running sums over a source's few amounts. The whole part of the expected copies is certain, the rest is the inclusion
    probability, and ``lacks`` are the words that the source still wants.
    """
    groups = rows.groupBy("source", "amount").agg(F.sum("size").alias("words"))
    targets = source_targets(rows, weights, most).withColumnRenamed("source", "of")
    known = groups.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of").where("amount > 0")
    falling = Window.partitionBy("source").orderBy(F.desc("amount"))
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    rest = falling.rowsBetween(0, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("words").over(before), F.lit(0))
    level = (F.col("target") - F.lit(float(most)) * capped) / F.sum(F.col("amount") * F.col("words")).over(rest)
    leveled = known.withColumn("level", level)
    fits = F.col("level") * F.col("amount") <= F.lit(float(most))
    chosen = leveled.withColumn("reached", F.max(F.when(fits, F.struct("amount", "level"))).over(Window.partitionBy("source"))["level"])
    copies = chosen.withColumn("copies", F.coalesce(F.least(F.lit(float(most)), F.col("reached") * F.col("amount")), F.lit(float(most))))
    parts = copies.withColumn("certain", F.floor("copies").cast("long")).withColumn("share", F.col("copies") - F.col("certain"))
    sure = F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("source"))
    return parts.select("source", "amount", "source_size", "target", "certain", "share", (F.col("target") - sure).alias("lacks"))


def repeated(rows: DataFrame) -> DataFrame:
    """``(row, copy)`` of the rows that are alike in key and text: which of the alike ones a row is, from 1.

    Rows are numbered in the part of the table in which they lie, and parts by running sums, so any number may be alike.
    """
    alike = rows.groupBy("key", "digest").count().where("count > 1").select(F.col("key").alias("k"), F.col("digest").alias("d"))
    some = rows.join(alike, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left_semi").select(
        "row", "key", "digest", F.shiftright("row", 33).alias("part"))
    here = some.withColumn("nth", F.row_number().over(Window.partitionBy("key", "digest", "part").orderBy("row")))
    parts = some.groupBy("key", "digest", "part").count()
    before = F.sum("count").over(Window.partitionBy("key", "digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(F.col("key").alias("k"), "digest", "part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = here.join(offsets, ["digest", "part"]).where(F.col("key").eqNullSafe(F.col("k")))
    return materialize(numbered.select("row", (F.col("before") + F.col("nth")).alias("copy")), "repeated")


def with_targets(rows: DataFrame, expected: DataFrame, seed: str) -> DataFrame:
    """Adds each row's source_size, target, certain copies, words its source still lacks, and its rank (null where none is drawn)."""
    plan = expected.withColumnRenamed("source", "of").withColumnRenamed("amount", "a")
    known = rows.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("amount") == F.col("a"))).drop("of", "a")
    u = uniform(F.lit(seed), F.col("key"), F.col("digest"), F.col("copy"))
    return known.withColumn("rank", F.when(F.col("share") > 0, odds_rank(u, F.col("share"))))


def copies_of(rows: DataFrame, expected: DataFrame, cuts: DataFrame, seed: str) -> DataFrame:
    """Adds ``copies`` and ``taken``; a row's own rank against its source's cut decides, so rows are not shuffled."""
    ranked = with_targets(rows, expected, seed).join(cuts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
    place = _bin(F.col("rank"))
    inside = F.col("edge_bin").isNull() | (place < F.col("edge_bin")) | (
        (place == F.col("edge_bin")) & (F.struct("rank", "key", "size") <= F.col("cut")))
    picked = F.col("rank").isNotNull() & F.coalesce(inside, F.lit(False))
    copies = F.col("certain") + picked.cast("long")
    return ranked.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """``(row, key, source, size, amount, digest, copy)`` of every document, and ``more`` columns, written once.

    A document's amount is the number of bits of its size: 0 without words, and one more whenever the size doubles.
    """
    size = word_count(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("source").cast("string").alias("source"), size.alias("size"),
                       F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"), *more)
    amount = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(F.lit(0))
    table = materialize(rows.withColumn("amount", amount).withColumn("row", F.monotonically_increasing_id()), "sizes")
    copies = repeated(table.select("row", "key", "digest"))
    return table.join(copies, "row", "left").withColumn("copy", F.coalesce("copy", F.lit(1).cast("long")))


def plan(rows: DataFrame, weights: Sequence[float], most: float, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets, expected copies and cuts: written tables of a few rows per source, so that Spark knows their size."""
    targets = materialize(source_targets(rows, weights, most), "targets")
    expected = materialize(expected_copies(rows, weights, most), "expected")
    return targets, expected, materialize(pareto_cuts(with_targets(rows, expected, seed)), "cuts")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)`` for every document: how often, and with how many words, it is taken.

    A document's expected copies are in proportion to the bits of its size, at the level at which its source's expected words
    are the target: the whole part is certain, and the rest is its inclusion probability in a Pareto order sample whose size is
    what the target still lacks in words. Null and empty texts have size 0 and are never taken; a null source is a source
    of its own; null and repeated ids are ranked by their text as well, and rows alike in both by their number among these,
    so each is drawn for itself. An empty table gives an empty result.
    """
    rows = sized(docs)
    targets, expected, cuts = plan(rows, weights, most, seed)
    taken = copies_of(rows, expected, cuts, seed).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "copies", "taken")
    zero = F.lit(0).cast("long")
    blank = rows.where("amount = 0").join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", zero.alias("copies"), zero.alias("taken"))
    return taken.unionByName(blank)


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """The documents that the mix takes: their columns under ``document``, and the amounts; a row per document, not per copy.

    Documents without words have nothing to give to a mix of words and are never among them. Words are counted once, into a
    table that keeps the documents beside their sizes.
    """
    rows = sized(docs, F.struct(*docs.columns).alias("document"))
    _, expected, cuts = plan(rows.drop("document"), weights, most, seed)
    return copies_of(rows, expected, cuts, seed).where("copies > 0").select("document", "size", "source_size", "target", "copies", "taken")
