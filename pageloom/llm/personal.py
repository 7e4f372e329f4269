"""Personal data by bootstrapped contextual extraction: seeds induce lexical patterns, which find identifiers no rule knows.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.session import materialize, small

# The base patterns of the contract, in order of kind. The e-mail pattern may only begin where a run of its first
# signs does, or where the last match ended, that of addresses only at the first digit of a run (a match ends at the last of one);
# that is where a leftmost match begins, and no run is read twice. Repeated groups are
# possessive: the same matches, in a loop; greedy ones recurse, and a run of some thousand digits or labels ends the JVM.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "found")
WORD = r"\S+"
BLANKS = "\t\n\x0b\f\r"  # with the plain blank, what WORD stops at
OPENING = r"^[\"'(\[{<]++"
EDGE_SIGNS = OPENING + r"|(?:\G|(?<![\"')\]}>,;:.!?]))[\"')\]}>,;:.!?]++\z"
ROUNDS = 3
LEAST_SEEDS = 5  # different seed entities that a pattern has to stand before
LEAST_CONFIDENCE = 0.8
SHARES = (64, 8)  # of the rows, one in so many, that patterns are tried on before all rows are read for those that are left
SLOTS = 1 << 16  # rows of 64 bits, at most, of the table that words are tried on before they are joined
CHUNK = 256  # array elements whose sum is taken in one step


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running_sums(sizes: Column) -> Column:
    """Sum of the elements before each, in steps of CHUNK so that long arrays do not cost the square of their length."""
    zero = F.lit(0).cast("long")

    def scan(part: Column, base: Column) -> Column:
        start = F.struct(base.alias("sum"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out")))["out"]

    starts = F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(CHUNK))
    totals = F.transform(starts, lambda s: F.aggregate(F.slice(sizes, s + 1, CHUNK), zero, lambda acc, x: acc + x))
    bases = scan(totals, zero)
    return F.flatten(F.transform(F.arrays_zip(starts.alias("s"), bases.alias("b")), lambda z: scan(F.slice(sizes, z["s"] + 1, CHUNK), z["b"])))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match, left) of all matches: code points, end exclusive, left the text since the last match."""

    def placed(pair: Column, at: Column) -> Column:
        start = at + F.length(pair["left"])
        return F.struct(start.alias("start"), (start + F.length(pair["match"])).alias("end"), pair["match"].alias("match"), pair["left"].alias("left"))

    def paired(both: Column) -> Column:
        return F.transform(both["found"], lambda m, k: F.struct(m.alias("match"), F.get(both["between"], k).alias("left")))

    def summed(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda p: (F.length(p["left"]) + F.length(p["match"])).cast("long"))
        return let(let(sizes, running_sums), lambda sums: F.transform(pairs, lambda p, k: placed(p, F.get(sums, k))))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return let(let(both, paired), summed)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Check sum of a string of digits: every second digit from the right doubled, its own digits added."""
    signs = F.transform(F.split(F.reverse(number), ""), lambda c, k: F.when(k % 2 == 0, F.ascii(c) - 48).otherwise(
        (F.ascii(c) - 48) * 2 - F.when(F.ascii(c) > 52, 9).otherwise(0)))
    return F.aggregate(signs, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        number = digits(match)
        return F.length(number).between(16, 19) & luhn(number)
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


GATES = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9][\\x20-]?[0-9]"),
         "phone": lambda t: t.rlike(r"\+[0-9]")}


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, match) of the base entities, by kind, then start; kinds as numbers in their order."""
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,match:string>>")

    def part(k: int, kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["match"]))
        spans = F.transform(good, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match")))
        return F.when(GATES[kind](text), spans).otherwise(empty)

    return F.concat(*[part(k, kind) for k, kind in enumerate(PATTERNS)])


def contexts(text: Column) -> Column:
    """For each word (run of signs that are not blank) the two before it, in lower case, a number as #; null for the first two."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(text), "[0-9]+", "#"), F.lit(WORD), F.lit(0))
    return let(words, lambda w: F.transform(w, lambda _, k: F.concat(F.get(w, k - 2), F.lit(" "), F.get(w, k - 1))))


def word_numbers(words: Column, base: Column) -> Column:
    """The words in which base entities begin and end, as numbers from 0: two for each entity, in their order.

    Starts of words and places are sorted together, so that the words before a place are a running sum.
    """

    def mark(pos: Column, at: Column) -> Column:
        return F.struct(pos.cast("long").alias("pos"), at.cast("int").alias("at"))

    starts = F.transform(words, lambda w: mark(w["start"], F.lit(-1)))
    places = F.flatten(F.transform(base, lambda b, j: F.array(mark(b["start"], 2 * j), mark(b["end"] - 1, 2 * j + 1))))

    def numbered(marks: Column) -> Column:
        sums = running_sums(F.transform(marks, lambda m: F.when(m["at"] < 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
        both = let(sums, lambda n: F.transform(marks, lambda m, k: F.struct(m["at"].alias("at"), (F.get(n, k) - 1).cast("int").alias("word"))))
        return F.transform(F.sort_array(F.filter(both, lambda x: x["at"] >= 0)), lambda x: x["word"])

    return let(F.sort_array(F.concat(starts, places)), numbered)


def seeds_and_held(text: Column, base: Column) -> Column:
    """Of the base entities: ``seeds``, an array of (pattern, instance) of those that begin in the third word or later, and
    ``held``, the numbers of the words they lie in."""

    def told(numbers: Column) -> Column:
        held = F.array_distinct(F.flatten(F.transform(base, lambda _, j: F.sequence(F.get(numbers, 2 * j), F.get(numbers, 2 * j + 1)))))
        seeds = let(contexts(text), lambda c: F.transform(base, lambda b, j: F.struct(
            F.get(c, F.get(numbers, 2 * j)).alias("pattern"), F.lower(b["match"]).alias("instance"))))
        return F.struct(F.filter(seeds, lambda x: x["pattern"].isNotNull()).alias("seeds"), held.alias("held"))

    none = F.struct(F.array().cast("array<struct<pattern:string,instance:string>>").alias("seeds"), F.array().cast("array<int>").alias("held"))
    return F.when(F.size(base) > 0, let(let(matches(text, WORD), lambda w: word_numbers(w, base)), told)).otherwise(none)


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(rows: DataFrame) -> DataFrame:
    """(row, pattern, start, raw) of every word outside base entities with two words before it."""
    text = F.col("text")

    def free(words: Column) -> Column:
        left = F.when(F.size(words) > 2, F.array_except(F.sequence(F.lit(2), F.size(words) - 1), F.col("held")))
        return let(contexts(text), lambda c: F.transform(left, lambda k: F.struct(
            F.get(c, k).alias("pattern"), F.get(words, k)["start"].alias("start"), F.get(words, k)["match"].alias("raw"))))

    return rows.select("row", F.inline(let(matches(text, WORD), free)))


def _inner(raw: Column) -> Column:
    """A word without the quotes, brackets and closing signs at its edges; the pattern runs only where such a sign may stand."""

    def bare(sign: Column) -> Column:
        return ((sign >= "a") & (sign < "{")) | ((sign >= "A") & (sign < "[")) | ((sign >= "0") & (sign < ":")) | (sign >= "~")

    return F.when(bare(raw) & bare(F.substring(raw, -1, 1)), raw).otherwise(F.regexp_replace(raw, EDGE_SIGNS, ""))


def _instances(words: DataFrame) -> DataFrame:
    """Words as instances, whatever their signs: without the quotes, brackets and closing signs at their edges, in lower case."""
    inner = words.withColumn("inner", _inner(F.col("raw")))
    start = F.col("start") + F.length(F.regexp_extract("raw", OPENING, 0))
    return inner.where("inner != ''").select("row", "pattern", F.lower("inner").alias("instance"), start.alias("start"), (start + F.length("inner")).alias("end"))


def _followers(rows: DataFrame, *more: str) -> DataFrame:
    """(more, pattern, instance) of every word outside base entities with two words before it: as ``_instances``, without the places.

    No lambda stands between the text and the instance, so Spark compiles the whole of it.
    """

    def cut(text: Column) -> Column:
        return F.array_remove(F.split(text, " "), "")

    line = F.lower(F.coalesce("text", F.lit("")))
    for sign in BLANKS:
        line = F.replace(line, F.lit(sign), F.lit(" "))
    lines = rows.select(*more, F.coalesce("held", F.array().cast("array<int>")).alias("held"), line.alias("line"))
    masked = F.when(F.col("line").rlike("[0-9]"), cut(F.regexp_replace("line", "[0-9]+", "#")))
    words = lines.select(*more, "held", cut(F.col("line")).alias("raw"), masked.alias("masked"))
    places = F.when(F.size("raw") > 2, F.sequence(F.lit(2), F.size("raw") - 1))
    words = words.select(*more, "held", "raw", F.coalesce("masked", "raw").alias("masked"), places.alias("places"))
    free = F.when(F.size("held") == 0, F.col("places")).otherwise(F.array_except("places", "held"))
    each = words.select(*more, "raw", "masked", F.explode(free).alias("k"))
    pattern = F.concat(F.get("masked", F.col("k") - 2), F.lit(" "), F.get("masked", F.col("k") - 1))
    return each.select(*more, pattern.alias("pattern"), _inner(F.get("raw", F.col("k"))).alias("instance")).where("instance != ''")


def _slot(column: str) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(column), 6), F.lit(SLOTS))


def _near(rows: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Those of the rows, and some more, whose column ``name`` is in ``values`` (its column ``_key``), with the column ``_slot``: where a bit that the hash names
    is set in a table of ``SLOTS`` rows at most, which is broadcast however many values there are."""

    def bit(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(64)).cast("int")

    mark = F.call_function("shiftleft", F.lit(1).cast("long"), bit("_key"))
    marks = small(values.groupBy(_slot("_key").alias("_slot")).agg(F.bit_or(mark).alias("_marks")))
    return rows.join(marks, (_slot(name) == F.col("_slot")) & (F.bit_get("_marks", bit(name)) == 1)).drop("_marks")


def _among(words: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``words`` whose column ``name`` is in the table ``keys``.

    Where that is too large to be broadcast, Spark moves the words that share a bit with a key, and not all words of all texts. The
    slot of the bit is in the condition, or else the plan has this join below that of the bits.
    """
    values = keys.select(F.col(name).alias("_key"), _slot(name).alias("_at"))
    same = (F.col(name) == F.col("_key")) & (F.col("_slot") == F.col("_at"))
    return _near(words, values, name).join(values, same, "left_semi").select(*words.columns)


def hopeful_patterns(rows: DataFrame, before: DataFrame, least_seeds: int, least: float, read: DataFrame | None = None) -> DataFrame:
    """``(pattern)``: those that can be confident, given ``before``, the (pattern, instance) of all instances that are sure in part or whole.

    A pattern before n of them scores n / (D + 1) at most, where D is the number of all different instances that it stands
    before. Any part of the rows gives a lower bound of D, so patterns are tried on ever larger shares of the rows, and
    those that the bound rules out already are struck. What is left is what all rows would leave, and some more. Patterns of ``read``
    are not tried. No more is read once none is left.
    """
    edges = before.distinct()
    known = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least_seeds)
    left = materialize(known if read is None else known.join(read, "pattern", "left_anti"), "hopeful-patterns")
    for share in SHARES:
        if left.isEmpty():
            break
        part = _among(_followers(rows.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0)), left, "pattern")
        seen = part.union(edges.join(left, "pattern", "left_semi")).distinct().groupBy("pattern").agg(F.count("*").alias("seen"))
        left = materialize(left.join(seen, "pattern").where(F.col("n") / (F.col("seen") + 1) >= least - 1e-9).select("pattern", "n"), "hopeful-patterns")
    return left.select("pattern")


def telling_patterns(rows: DataFrame, rounds: int, least_seeds: int, least: float) -> DataFrame:
    """``confident_patterns`` of all words of the texts; see ``patterns_and_places``."""
    return patterns_and_places(rows, rounds, least_seeds, least)[0]


def patterns_and_places(rows: DataFrame, rounds: int, least_seeds: int, least: float) -> tuple[DataFrame, DataFrame | None]:
    """``confident_patterns`` of all words of the texts, of which only those are kept that a round can need, and (row, pattern,
    instance) of every word that those patterns and some others stand before (None if no pattern is hopeful).

    A pattern scores only before ``least_seeds`` different sure instances. Those of the first round are the seeds, later
    also what confident patterns stand before; each round takes the patterns that can be confident with those, and the
    words after them in all texts. Patterns left out have no score in that round, however many seeds they stand before: their other
    words were not read. A sure instance stays sure and a hopeful pattern hopeful from round to round, so all texts are read for new patterns and
    for new sure instances only. Nothing more is read once no pattern is hopeful or none is confident.
    """
    seeds = materialize(rows.select(F.inline("seeds")).distinct(), "seeds")
    before, told, wanted, places, grown = seeds, None, None, None, True
    for k in range(1, rounds + 1):
        if grown:
            new = hopeful_patterns(rows, before, least_seeds, least, wanted)
            if not new.isEmpty():
                found = materialize(_among(_followers(rows, "row"), new, "pattern"), "places")
                wanted, places = (new, found) if wanted is None else (wanted.union(new), places.union(found))
            elif wanted is None:
                return new.withColumn("confidence", F.lit(0.0)), None
        after = places.select("pattern", "instance").distinct()
        edges = materialize(seeds.withColumn("seed", F.lit(True)).union(after.withColumn("seed", F.lit(False))), "instances")
        scores = confident_patterns(edges, k, least_seeds, least, wanted)
        if k == rounds or scores.isEmpty():
            break
        sure = edges.where("not seed").join(scores, "pattern", "left_semi").select("instance").distinct()
        fresh = materialize(sure if told is None else sure.join(told, "instance", "left_anti"), "told")
        grown = not fresh.isEmpty()
        if grown:
            told = fresh if told is None else told.union(fresh)
            before = materialize(before.union(_among(_followers(rows), fresh, "instance").select("pattern", "instance")).distinct(), "sure")
    return scores, places


def confident_patterns(instances: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS,
                       least: float = LEAST_CONFIDENCE, whole: DataFrame | None = None) -> DataFrame:
    """``(pattern, confidence)`` from the graph of patterns and instances, for patterns of at least ``least``; with ``whole``, for its
    patterns only: of others the graph may lack instances, which would make them look more sure than they are.

    A seed is sure. A pattern's confidence is the mean sureness of the different instances it stands before, one doubtful
    one added; only patterns before ``least_seeds`` different sure instances count. An instance that confident patterns
    stand before is as sure as they make it together (one minus the product of their doubts). Each round scores all patterns,
    then all instances. Edges are summed before they are joined, and Spark may split the join's many-rows side.
    """
    edges = materialize(instances.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pattern-graph")
    sure = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("sure"))
    scored = edges if whole is None else materialize(edges.join(whole, "pattern", "left_semi"), "pattern-graph")
    scores = None
    for k in range(rounds):
        joined = scored.join(sure.where("sure > 0"), "instance", "left")
        scores = joined.groupBy("pattern").agg(
            (F.sum(F.coalesce("sure", F.lit(0.0))) / (F.count("*") + 1)).alias("confidence"),
            F.sum((F.col("sure") >= least).cast("long")).alias("supports")).where((F.col("supports") >= least_seeds) & (F.col("confidence") >= least))
        scores = materialize(scores.select("pattern", "confidence"), "pattern-scores")
        if k < rounds - 1:
            doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999999)))))
            by_pattern = edges.join(scores, "pattern").groupBy("instance").agg((1 - doubt).alias("told"))
            seeds = edges.where("seed").select("instance", F.lit(1.0).alias("told"))
            sure = materialize(by_pattern.union(seeds).groupBy("instance").agg(F.max("told").alias("sure")), "instance-scores")
    return scores


def found_personal_data(docs: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, n_found, base_sha256, spans)`` for every row of the documents.

    Base entities are seeds; the two words before the word they begin in are patterns; what confident patterns stand before
    elsewhere is found, unless it overlaps a base entity. Offsets are code points, the end exclusive. Null and empty texts
    have no spans; rows that repeat give a result each (copies of a text add nothing to a pattern, which counts different
    instances). An empty table gives an empty result. Base entities are searched for once; texts are kept beside them,
    as each round of patterns reads their words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spans = docs.select(F.col("doc_id").cast("long"), text.alias("text"), base_spans(text).alias("base"))
    slim = F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"]))
    parsed = spans.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", slim.alias("slim"), seeds_and_held(F.col("text"), F.col("base")).alias("words"))
    rows = materialize(parsed, "spans").select("row", "doc_id", "text", F.col("slim").alias("base"), "words.seeds", "words.held")
    patterns, places = patterns_and_places(rows, rounds, least_seeds, least)
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    if patterns.isEmpty():
        joined = rows.select("doc_id", "base", none.alias("found"))
    else:
        hits = places.join(patterns, "pattern", "left_semi").select(F.col("row").alias("_key"))
        new = _instances(_among(_words(_near(rows, hits, "row")), patterns, "pattern")).groupBy("row").agg(F.sort_array(F.collect_list(
            F.struct(F.lit(len(PATTERNS)).alias("kind"), "start", "end"))).alias("found"))
        joined = rows.join(new, "row", "left").select("doc_id", "base", F.coalesce("found", none).alias("found"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return joined.select("doc_id", *counts, F.size("found").cast("long").alias("n_found"), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                         written(F.concat("base", "found")).alias("spans"))
