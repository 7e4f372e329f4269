import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalog import registry
from pageloom import workload
from pageloom.operators import corpus, quotes

PAGE_COLS = "report_id string, page_ord bigint, source_url string, title string, markdown string, html string"


SIZES = [12_500, 0, 11_000, 50, 12_000, 12_000, 12_000, 12_000, 12_000, 9_000, 4_000]


def sized_pages(spark):
    rows = [("r", i, f"https://a.example/p{i}", "t" * 300, "x" * n, None) for i, n in enumerate(SIZES)]
    return spark.createDataFrame(rows, PAGE_COLS)


def test_documents_are_whole(spark):
    docs = corpus.prepared_documents(sized_pages(spark)).collect()
    assert {d.page_ord: len(d.content) for d in docs} == {i: n for i, n in enumerate(SIZES) if n}
    assert all(len(d.title) == 300 for d in docs)


def test_a_budget_is_used_in_page_order(spark):
    docs = corpus.prepared_documents(sized_pages(spark), budget=60_000).collect()
    used, want = 0, {}
    for i, n in enumerate(SIZES):
        take = min(n, 60_000 - used)
        if take > 0:
            want[i], used = take, used + take
    assert {d.page_ord: len(d.content) for d in docs} == want and sum(want.values()) == 60_000


def test_document_text(spark):
    rows = [("r", 0, "https://a.example/", None, "a  \n\n b \n", None), ("r", 1, "https://a.example/pricing", None, "", "<p>x</p> <b>y</b>"),
            ("r", 2, "https://a.example/x", None, "  ", None)]
    docs = corpus.prepared_documents(spark.createDataFrame(rows, PAGE_COLS)).orderBy("page_ord").collect()
    assert [(d.content, d.page_type) for d in docs] == [("a\n b", "homepage"), ("x   y", "pricing")]


@pytest.mark.parametrize("n", [1, 120, 121, 1200, 1201, 2280, 2281, 12_000])
def test_fixed_chunks_cover_the_text(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    df = spark.createDataFrame([("r", text)], "report_id string, content string")
    chunks = [r.content for r in corpus.fixed_chunks(df).orderBy("chunk_no").collect()]
    assert "".join([chunks[0]] + [c[120:] for c in chunks[1:]]) == text
    assert all(len(c) <= 1200 for c in chunks)


def test_separator_split_properties():
    rnd = random.Random(1)
    for _ in range(200):
        number = iter(range(100_000))  # no piece of the text occurs twice
        word = lambda k: "".join("A" + "".join(chr(97 + int(c)) for c in f"{next(number):04d}") for _ in range(k))
        text = "".join(rnd.choice([word(1), word(2), " ", " ", "\n", "\n\n", word(8), word(30)]) for _ in range(rnd.randrange(1, 100)))
        chunks = corpus.chunked(text, 60, 10)
        assert all(0 < len(c) <= 60 for c in chunks)
        squeeze = lambda s: "".join(s.split())
        rest = squeeze(text)
        at = 0
        for c in chunks:  # every chunk occurs in order; together they leave nothing out
            pos = rest.find(squeeze(c))
            assert 0 <= pos <= at
            at = max(at, pos + len(squeeze(c)))
        assert at == len(rest)


def test_separator_split_prefers_paragraphs():
    text = "\n\n".join(["one two three", "four five six", "seven"])
    assert corpus.chunked(text, 18, 0) == ["one two three", "four five six", "seven"]
    assert corpus.chunked("aaa bbb ccc ddd", 7, 3) == ["aaa bbb", "bbb ccc", "ccc ddd"]


def test_metadata_containment(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1"}), ({"a": "1"}, {"a": "1", "b": "2"}), ({"a": "1"}, {})],
                               "m map<string,string>, f map<string,string>")
    assert [r[0] for r in df.select(corpus.contains_filter(F.col("m"), F.col("f"))).collect()] == [True, False, True]


def test_quotes_against_the_whole_text(spark):
    """Random quotes, many over page ends and over pages shorter than the quote, against the joined text."""
    rnd = random.Random(4)
    pages, verdicts, want = [], [], set()
    for r in range(6):
        texts = [" ".join(rnd.choice(["ab", "c", "dé", "EF"]) for _ in range(rnd.choice([0, 1, 2, 30]))) for _ in range(60)]
        joined = " ".join(t for t in " ".join(texts).lower().split())
        pages += [(f"r{r}", i, t) for i, t in enumerate(texts)]
        for check in ("G4", "G6", "G8", "G19"):
            at = rnd.randrange(0, len(joined) - 40)
            quote = joined[at:at + rnd.randrange(8, 40)].strip()
            if rnd.random() < 0.4:
                quote = quote[: len(quote) // 2] + "zz" + quote[len(quote) // 2:]
            verdicts.append((f"r{r}", check, 0.5, quote.upper()))
            if len(quote) >= 8 and quote in joined:
                want.add((f"r{r}", check))
    df = spark.createDataFrame(pages, "report_id string, page_ord long, markdown string").repartition(7)
    vs = spark.createDataFrame(verdicts, "report_id string, check_id string, verdict double, quote string")
    got = {(r.report_id, r.check_id) for r in quotes.verified_verdicts(vs, df).collect()}
    assert got == want and len(want) > 5


def test_verdict_rules(spark):
    pages = spark.createDataFrame([("r", 0, "Some words on a page")], "report_id string, page_ord long, markdown string")
    vs = spark.createDataFrame([("r", "G4", 2.0, "words  ON a"), ("r", "G6", 0.0, ""), ("r", "G8", float("nan"), "words on a"), ("r", "G19", 1.0, "short"),
                                ("r", "S1", 1.0, "words on a")], "report_id string, check_id string, verdict double, quote string")
    assert {(r.check_id, r.verdict) for r in quotes.verified_verdicts(vs, pages).collect()} == {("G4", 1.0), ("G6", 0.0)}


def test_index_finds_what_a_search_finds():
    """Phrases that share heads, overlap, repeat and run over strips, against substring search."""
    rnd = random.Random(8)
    for strip in (16, 50, quotes.STRIP):
        for _ in range(150):
            text = "".join(rnd.choices("abé \U0001f600", weights=[8, 2, 1, 2, 1], k=rnd.randrange(0, 200)))
            phrases = []
            for _ in range(rnd.randrange(1, 12)):
                at = rnd.randrange(0, max(1, len(text) - 8))
                cut = text[at : at + rnd.randrange(8, 60)]
                phrases.append(cut if len(cut) >= 8 and rnd.random() < 0.7 else (cut + "abbaabba")[: rnd.randrange(8, 30)] + "a" * 8)
            before, quotes.STRIP = quotes.STRIP, strip
            try:
                assert quotes.PhraseIndex(phrases).find(text) == {k for k, p in enumerate(phrases) if p in text}
            finally:
                quotes.STRIP = before


def test_quotes_of_one_large_report(spark):
    """A report with most pages and thousands of quotes, in several tiles, next to reports without pages or quotes."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "délta"]) + str(rnd.randrange(50)) for _ in range(rnd.randrange(0, 40))) for _ in range(400)]
    joined = " ".join(t for t in texts if t)
    wanted = [(f"G{rnd.choice([4, 6, 8, 19])}", 1.0 - k / 10_000, joined[k * 7 : k * 7 + 30] + ("" if k % 3 else "!")) for k in range(3000)]
    pages = spark.createDataFrame([("big", i, t) for i, t in enumerate(texts)] + [("quiet", 0, "nothing asked here")], "report_id string, page_ord long, markdown string")
    vs = spark.createDataFrame([("big", *w) for w in wanted] + [("gone", "G4", 1.0, "nothing asked here")], "report_id string, check_id string, verdict double, quote string")
    before, quotes.PHRASES_AT_ONCE = quotes.PHRASES_AT_ONCE, 500
    try:
        got = {(r.report_id, r.check_id, r.verdict) for r in quotes.verified_verdicts(vs, pages.repartition(5)).collect()}
    finally:
        quotes.PHRASES_AT_ONCE = before
    assert got == {("big", c, v) for c, v, q in wanted if len(q.strip()) >= 8 and " ".join(q.split()) in joined} and len(got) > 1500


def test_separator_chunks_pass_in_slices(spark, monkeypatch):
    """Texts of one Arrow batch are cut a slice at a time; what comes out is every chunk of every text, in order."""
    assert [s.to_pylist() for s in corpus._slices(pa.array(["aaa", "bb", None, "cccccc", "", "d"]), 5)] == [["aaa", "bb", None], ["cccccc"], ["", "d"]]
    monkeypatch.setattr(corpus, "TEXTS_AT_ONCE", 3000)
    texts = [f"{i} " + "one two three\n" * (i * 7) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "page_ord int, content string").coalesce(1)
    got = {(r.page_ord, r.chunk_no): r.content for r in corpus.separator_chunks(docs).collect()}
    assert got == {(i, k): c for i, t in enumerate(texts) for k, c in enumerate(corpus.chunked(t))}


def test_facts_deal_out_files_of_one_row_group(spark, tmp_path, monkeypatch, capsys):
    rows = [(i if i % 5 else None, f"https://a.example/{i}", f"<html><p>{i}</p></html>") for i in range(20)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    rows = [(i if i % 5 else None, f"text {i}", "en", "src") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    plain, dealt = (workload.crawl(spark, str(tmp_path), dealt=d) for d in (False, True))
    assert dealt.exceptAll(plain).isEmpty() and dealt.count() == plain.count() == 40
    monkeypatch.setattr(registry, "materialize", lambda df, name: df)
    monkeypatch.setattr(registry, "_TABLES", {})
    registry.facts(spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(page_id" in plan
