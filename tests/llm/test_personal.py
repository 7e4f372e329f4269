import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pageloom.llm import personal
from tests.llm.odd import no_documents, odd_documents

RULES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(p) <= 255 for p in m[0].split(".")) if k == 1 else True,
                    16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + j % 2), 10)) for j, c in enumerate(d[::-1])) % 10 == 0, 8 <= len(d) <= 15][k]
            if good:
                out.append((k, m.start(), m.end()))
    return out


def random_texts(n):
    dice = random.Random(7)
    parts = ["a", "b.c", "@", "x@y.de", ".", "-", "_", "4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "1.2.3.4", "256.1.1.1", "001.2.3.255", "+1 (988) 555-2485",
             "+49", " ", "  ", "\n", "é", "\U0001f600", "0", "7", "12345678", "(", ")", "%", "a@b", "c.d_e@f.g"]
    return ["".join(dice.choices(parts, k=dice.randint(0, 14))) for _ in range(n)] + ["é4111111111111111é" * 300, "1 2 " * 1000, "a.b@c.d " * 700]


def test_base_spans_against_plain_rules(spark):
    texts = random_texts(1500)
    rows = personal.found_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        names = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in range(4)], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest() and (r.spans + ",").startswith(names), texts[r.doc_id]


def test_long_runs_of_digits_and_labels(spark):
    texts = ["1 2 " * 50_000, "7" * 100_000, "1-2-" * 50_000, "a@b" + ".c" * 100_000, "x 4111 1111 1111 1111 y",
             "1.2 " + "1" * 1_000_000, "1.2.3." + "4" * 500_000 + ".5.6x" + ".7" * 100_000]
    rows = personal.found_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans for r in rows if r.doc_id < 6} == {0: "", 1: "", 2: "", 3: "email:0:200003", 4: "card:2:21", 5: ""}
    assert [(r.n_ip, r.n_card) for r in rows if r.doc_id == 6] == [(100_000 // 4, 0)]


def teaching(n=12):
    """Seeds after a telling phrase, an identifier of unknown form after the same phrase, and the like after idle words."""
    rows = [(k, f"please write reach me on +1 (988) 555-{2000 + k} soon") for k in range(n)]
    rows += [(100, "é you may reach me on (QX-77412/9), or not"), (101, "the lot number was QX-99999/1 then"), (102, "go on reach me on x@y.com now")]
    return rows + [(200 + k, f"there were about {1000 + 7 * k} of them") for k in range(30)]


def test_patterns_find_identifiers_no_rule_knows(spark):
    got = {r.doc_id: r for r in personal.found_personal_data(spark.createDataFrame(teaching(), "doc_id long, text string")).collect()}
    assert got[100].spans == "found:23:33" and got[100].n_found == 1
    assert teaching()[12][1][23:33] == "QX-77412/9"
    assert got[101].spans == "" and all(got[200 + k].spans == "" for k in range(30))
    assert got[0].spans == "phone:25:42" and got[0].n_found == 0
    assert sum(r.n_found for r in got.values()) == 1


def test_entities_and_identifiers_without_digits(spark):
    """Seeds and discoveries need no digit; a phrase that stands before ordinary words too is not confident."""
    letters = "abcdefghijkl"
    rows = [(k, f"please send mail to jane.{c}@example.com or sit down at bob.{c}@example.org then") for k, c in enumerate(letters)]
    rows += [(50, "é go send mail to (Quinn_Smith), now"), (51, "mail to xy"), (52, "they met Quinn_Smith there")]
    rows += [(100 + k, f"they sat down at {c * 4} again") for k, c in enumerate(letters)]
    got = {r.doc_id: r.spans for r in personal.found_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "found:19:30" and rows[12][1][19:30] == "Quinn_Smith" and got[51] == "found:8:10"
    assert {got[52], *(got[100 + k] for k in range(12))} == {""} and all("found" not in got[k] for k in range(12))


def test_found_of_the_second_round(spark):
    """An identifier found after one phrase makes another phrase confident, and that phrase finds the next."""
    names = [f"user{c}" for c in "abcdefgh"]
    rows = [(k, f"please send mail to jane.{c}@example.com now") for k, c in enumerate("abcdefghijklmnopqrstuvwxyzabcdefghijkl".upper())]
    rows += [(100 + k, f"so send mail to {n} now") for k, n in enumerate(names[:6])] + [(200 + k, f"the account named {n} is") for k, n in enumerate(names)]
    got = {r.doc_id: r.spans for r in personal.found_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), least=0.6).collect()}
    assert all(got[100 + k] == "found:16:21" for k in range(6)) and all(got[200 + k] == "found:18:23" for k in range(8))


def test_words_before_are_those_of_the_text(spark):
    """A number next before a seed or an identifier is a word like others, and long words stay whole."""
    long = "w" * 150
    rows = [(k, f"at number {k + 3} write to unit {k + 5} +1 (988) 555-{2000 + k} now") for k in range(12)]
    rows += [(100 + k, f"{k} {long} id jane{k}@example.com") for k in range(12)]
    rows += [(50, "user in unit 42 MRN12345 here"), (51, f"so {long} id QX-77412, and"), (52, "so w id QX-77413 and"), (53, "a lot 42 MRN12346")]
    got = {r.doc_id: r.spans for r in personal.found_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(50, 54)] == ["found:16:24", "found:157:165", "", ""]
    assert got[100] == f"email:{len(long) + 6}:{len(rows[12][1])}" and "found" not in got[0]


def test_numbers_of_words(spark):
    texts = [t for t in random_texts(300)[:300] if t.strip()]
    rows = [(k, t, [(s, e) for _, s, e in plain(t)]) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "k int, text string, base array<struct<start:long,end:long>>")
    got = frame.select("k", personal.word_numbers(personal.matches(F.col("text"), personal.WORD), F.col("base")).alias("n")).collect()
    for r in got:
        words = [m.start() for m in re.finditer(r"\S+", texts[r.k])]
        assert r.n == [sum(w <= p for w in words) - 1 for s, e in rows[r.k][2] for p in (s, e - 1)], texts[r.k]


def test_bounds_strike_no_pattern_that_is_confident(spark):
    """Patterns of many counts of sure and of other followers: every one that all rows make confident is hopeful on shares of them."""
    dice = random.Random(2)
    rows, edges = [], set()
    for p in range(60):
        n, others = dice.randrange(2, 40), dice.choice([0, 0, 1, 2, 5, 10])
        for i in range(n):
            rows.append(f"ab pa{p}x is user{p}v{i}@mail.com now")
            edges.add((f"pa{p}x is", i))
        rows += [f"ab pa{p}x is other{p}z{i} now" for i in range(others)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    text = F.col("text")
    parsed = frame.select(F.col("doc_id").alias("row"), "text", personal.seeds_and_held(text, personal.base_spans(text)).alias("words"))
    table = parsed.select("row", "text", "words.seeds", "words.held").cache()
    seeds = table.select(F.inline("seeds")).distinct()
    after = personal._followers(table)
    whole = seeds.withColumn("seed", F.lit(True)).union(after.withColumn("seed", F.lit(False)))
    want = {r.pattern for r in personal.confident_patterns(whole, rounds=1).collect()}
    hopeful = {r.pattern for r in personal.hopeful_patterns(table, seeds, personal.LEAST_SEEDS, personal.LEAST_CONFIDENCE).collect()}
    assert want and want <= hopeful and {r.pattern for r in personal.telling_patterns(table, 1, personal.LEAST_SEEDS, personal.LEAST_CONFIDENCE).collect()} == want
    assert len(hopeful) < 60


def test_struck_patterns_have_no_score(spark):
    """Beside a confident pattern, one that stands before six seeds and 400 other words finds nothing, though the words were not all read."""
    rows = [f"please write to user{k}@mail.com now" for k in range(12)] + ["please write to qx_smith now"]
    rows += [f"one of the user{k}@post.com now" for k in range(6)]
    rows += [f"one of the {a}{b}house then" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    got = personal.found_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).where("n_found > 0")
    assert [(r.doc_id, r.spans) for r in got.collect()] == [(12, "found:16:24")]


def test_followers_against_plain_words(spark):
    """Words of texts with all blanks and edge signs, of which some are held: as a plain loop has them."""
    dice = random.Random(11)
    parts = ["A", "b1c", "77", "1", "(x)", "\"Q'", "...", ")(", "é", "\u00c9T\u00c9!", "\u212a9", "x-", "|", "~a", "`", "#", "@", "Z]", "{", "\U0001f600", " ", " ", "  ", "\t", "\n", "\x0b", "\f\r", "\u00a0"]
    texts = ["".join(dice.choices(parts, k=dice.randint(0, 40))) for _ in range(800)] + ["", " ", "a b c", "\na\tb  c "]
    words = [re.findall(r"[^ \t\n\x0b\f\r]+", t.lower()) for t in texts]
    held = [sorted(dice.sample(range(len(w)), dice.choice([0, 0, min(3, len(w))]))) for w in words]
    want = []
    for k, w in enumerate(words):
        masked = [re.sub("[0-9]+", "#", x) for x in w]
        for j in range(2, len(w)):
            inner = re.sub(r"[\"')\]}>,;:.!?]+\Z", "", re.sub(r"\A[\"'(\[{<]+", "", w[j]))
            if j not in held[k] and inner:
                want.append((k, f"{masked[j - 2]} {masked[j - 1]}", inner))
    table = spark.createDataFrame(list(zip(range(len(texts)), texts, held)), "row long, text string, held array<int>")
    assert sorted(tuple(r) for r in personal._followers(table, "row").collect()) == sorted(want)


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_words_among_keys(spark, monkeypatch, limit):
    """The join after the bits is exact, also where bits are shared and where Spark may not broadcast."""
    monkeypatch.setattr(personal, "SLOTS", 2)
    words = spark.createDataFrame([(k, f"w{k % 500}") for k in range(2000)] + [(-1, None)], "row long, pattern string")
    keys = spark.createDataFrame([(f"w{k}",) for k in range(3, 600, 7)], "pattern string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = sorted(r.row for r in personal._among(words, keys, "pattern").collect())
        plan = personal._among(words, keys, "pattern")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [k for k in range(2000) if k % 500 in range(3, 600, 7)]
    assert plan.index("LeftSemi") < plan.index("Inner")


def test_texts_are_read_for_new_patterns_only(spark, monkeypatch):
    """Three rounds over texts with one confident pattern read all texts for it and for what it tells, and no more."""
    reads, plain = [], personal._followers
    monkeypatch.setattr(personal, "_followers", lambda rows, *more: reads.append(more) or plain(rows, *more))
    got = personal.found_personal_data(spark.createDataFrame(teaching(), "doc_id long, text string")).where("n_found > 0").collect()
    shares = len(personal.SHARES)
    assert [r.doc_id for r in got] == [100] and len(reads) <= 2 * shares + 2


def test_copies_do_not_make_a_pattern(spark):
    rows = [(k, "please reach me on +1 (988) 555-2000 soon") for k in range(50)] + [(99, "please reach me on QX-77412/9 soon")]
    got = personal.found_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).where("n_found > 0")
    assert got.count() == 0


def test_scores_of_the_graph_against_plain_rounds(spark):
    dice = random.Random(5)
    seeds = [f"s{k}" for k in range(20)]
    edges = {(f"p{dice.randrange(12)}", dice.choice(seeds * (j % 4) + [f"u{k}" for k in range(12)])) for j in range(260)}
    known = dict.fromkeys(seeds, 1.0)
    for k in range(3):
        scores = {}
        for p in {p for p, _ in edges}:
            own = [known.get(i, 0.0) for q, i in edges if q == p]
            if sum(s >= 0.6 for s in own) >= 3 and sum(own) / (len(own) + 1) >= 0.6:
                scores[p] = sum(own) / (len(own) + 1)
        known = dict.fromkeys(seeds, 1.0)
        for p, i in edges:
            if p in scores and not i.startswith("s"):
                known[i] = 1 - (1 - known.get(i, 0.0)) * (1 - scores[p])
    rows = spark.createDataFrame([(p, i, i.startswith("s")) for p, i in edges], "pattern string, instance string, seed boolean")
    got = {r.pattern: r.confidence for r in personal.confident_patterns(rows, rounds=3, least_seeds=3, least=0.6).collect()}
    assert got == pytest.approx(scores) and scores


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    sizes = list(range(1, n + 1))
    got = spark.createDataFrame([(sizes,)], "a array<long>").select(personal.running_sums(F.col("a")).alias("s")).first().s
    assert got == [sum(sizes[:k]) for k in range(n)]


def test_odd_rows(spark):
    got = personal.found_personal_data(odd_documents(spark, [(30, None, None, None, None)])).collect()
    assert len(got) == 12 and all(r.spans == "" for r in got)
    assert personal.found_personal_data(no_documents(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = personal.found_personal_data(odd_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
