"""Corpus, vector search, quote verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.check_sql import audit_query
from catalog.registry import AS_OF, aux, facts, register, vector_index
from pageloom import workload
from pageloom.operators import audit, corpus, quotes, vectors
from pageloom.session import materialize, salted_join
from pageloom.workload import table

_CRAWL = f"crawl AS ({workload.crawl_sql()})"
_KIND = ("CASE WHEN pth IN ('', '/') THEN 'homepage' WHEN regexp_matches(pth, 'pricing|/plans|/price') THEN 'pricing' WHEN regexp_matches(pth, "
         "'/(about|company|team)') THEN 'about' WHEN regexp_matches(pth, '/(product|feature|solution|platform)') THEN 'product' WHEN "
         "regexp_matches(pth, '/(blog|news|article|post|guide)|/20\\d\\d/') THEN 'blog' WHEN regexp_matches(pth, '/(contact|support|help|docs?)') "
         "THEN 'contact' ELSE 'other' END")
# Here pages enter with their html as rendered html, so that both tables give documents.
_DOCS = (f"""{_CRAWL}, texts AS (SELECT report_id, page_ord, source_url AS url, coalesce(title, '') AS title, trim(regexp_replace(
  coalesce(nullif(markdown, ''), regexp_replace(coalesce(html, raw_html, ''), '<[^>]+>', ' ', 'g')), '\\s+\\n', chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))
  AS content FROM crawl),
docs AS (SELECT report_id, page_ord, url, title, {_KIND} AS page_type, content FROM (SELECT *,
  lower(regexp_replace(coalesce(url, ''), '(?i)^https?://[^/]+', '')) AS pth FROM texts WHERE content <> ''))""")


def _docs(spark, sf_dir):
    pages = workload.crawl(spark, sf_dir)
    return corpus.prepared_documents(pages.withColumn("html", F.coalesce("html", "raw_html")))


@register("prepared_documents", f"WITH {_DOCS} SELECT report_id, page_ord, url, title, page_type, length(content) AS chars, md5(content) AS digest FROM docs")
def prepared_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("report_id", "page_ord", "url", "title", "page_type", F.length("content").alias("chars"),
                                       F.md5("content").alias("digest"))


@register("fixed_chunks", f"WITH {_DOCS} SELECT report_id, page_ord, page_type, CAST(i AS INT) AS chunk_no, md5(substring(content, CAST(i * 1080 + 1 AS INT), 1200)) AS "
          "digest FROM (SELECT *, unnest(range(CAST(greatest(ceil((length(content) - 120) / 1080), 1) AS BIGINT))) AS i FROM docs)")
def fixed_chunks(spark, sf_dir):
    return corpus.fixed_chunks(_docs(spark, sf_dir)).select("report_id", "page_ord", "page_type", "chunk_no", F.md5("content").alias("digest"))


def _separator_sql(size: int = corpus.CHUNK_CHARS, overlap: int = corpus.CHUNK_OVERLAP) -> str:
    """Stretches are cut level by level; chunks are a chain of pointers into the running sums of a run of parts."""
    parts = ["in0 AS (SELECT report_id, page_ord, '' AS path, content AS piece FROM docs)"]
    for k, sep in enumerate(("chr(10) || chr(10)", "chr(10)", "' '")):
        parts.append(f"""cut{k} AS (SELECT report_id, page_ord, path, part, i, length(part) > {size} AS long FROM (SELECT report_id, page_ord, path, unnest(p) AS part, generate_subscripts(p, 1) AS i
  FROM (SELECT *, list_filter(string_split(piece, {sep}), lambda x: x <> '') AS p FROM in{k} WHERE contains(piece, {sep}))))""")
        parts.append(f"""sums{k} AS (SELECT *, sum(length(part) + length({sep})) OVER (PARTITION BY report_id, page_ord, path, g ORDER BY i) AS t FROM (
  SELECT *, sum(CAST(long AS INT)) OVER (PARTITION BY report_id, page_ord, path ORDER BY i) AS g FROM cut{k}) WHERE NOT long)""")
        parts.append(f"""runs{k} AS (SELECT report_id, page_ord, path || '/' || lpad(CAST(min(i) AS STRING), 9, '0') AS place, {sep} AS sep, list(part ORDER BY i) AS parts,
  list_prepend(0, list(CAST(t AS BIGINT) ORDER BY i)) AS t FROM sums{k} GROUP BY report_id, page_ord, path, g)""")
        parts.append(f"""in{k + 1} AS (SELECT report_id, page_ord, path, piece FROM in{k} WHERE NOT contains(piece, {sep}) UNION ALL
  SELECT report_id, page_ord, path || '/' || lpad(CAST(i AS STRING), 9, '0'), part FROM cut{k} WHERE long)""")
    parts.append("runs AS (SELECT *, length(sep) AS s FROM (SELECT * FROM runs0 UNION ALL SELECT * FROM runs1 UNION ALL SELECT * FROM runs2))")
    step = f"len(list_filter(t, lambda x: x <= t[i + 1] + {size} + s)) - 1"
    follow = f"len(list_filter(t, lambda x: x < greatest(t[e + 1] - s - {overlap}, t[e + 2] - s - {size})))"
    parts.append(f"""chain AS (SELECT *, {step} AS e FROM (SELECT *, CAST(0 AS BIGINT) AS i, 0 AS seq FROM runs)
  UNION ALL SELECT *, {step} FROM (SELECT report_id, page_ord, place, sep, parts, t, s, {follow} AS i, seq + 1 AS seq FROM chain WHERE e < len(parts)))""")
    parts.append(f"""chunks AS (SELECT report_id, page_ord, place, seq, CASE length(sep) + ascii(sep) WHEN 33 THEN array_to_string(parts[i + 1 : e], ' ')
  WHEN 11 THEN array_to_string(parts[i + 1 : e], chr(10)) ELSE array_to_string(parts[i + 1 : e], chr(10) || chr(10)) END AS chunk FROM chain UNION ALL
  SELECT report_id, page_ord, path || '/', CAST(i AS INT), substring(piece, CAST(i * {size - overlap} + 1 AS INT), {size}) FROM (
    SELECT *, unnest(range(CAST(greatest(ceil((length(piece) - {overlap}) / {size - overlap}), 1) AS BIGINT))) AS i FROM in3))""")
    return (f"WITH RECURSIVE {_DOCS}, {', '.join(parts)} SELECT report_id, page_ord, CAST(row_number() OVER (PARTITION BY report_id, page_ord ORDER BY place, seq) - 1 AS INT) AS chunk_no, "
            "content FROM (SELECT *, trim(chunk, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content FROM chunks) WHERE content <> ''")


@register("separator_chunks", _separator_sql())
def separator_chunks(spark, sf_dir):
    return corpus.separator_chunks(_docs(spark, sf_dir)).select("report_id", "page_ord", "chunk_no", "content")


@register("corpus_sizes", f"WITH {_DOCS} SELECT report_id, coalesce(n, 0) AS chunks, coalesce(n > 0, false) AS searchable FROM (SELECT DISTINCT report_id FROM crawl "
          "UNION ALL SELECT 'customer-' || CAST(c_custkey AS STRING) FROM customer) LEFT JOIN (SELECT report_id, CAST(sum(greatest(ceil((length(content) - 120) / "
          "1080), 1)) AS BIGINT) AS n FROM docs GROUP BY 1) USING (report_id)")
def corpus_sizes(spark, sf_dir):
    asked = workload.crawl(spark, sf_dir).select("report_id").distinct().unionByName(
        table(spark, sf_dir, "customer").selectExpr("'customer-' || CAST(c_custkey AS STRING) AS report_id"))
    return corpus.corpus_sizes(asked, corpus.fixed_chunks(_docs(spark, sf_dir)))


_VEC = "vecs AS (SELECT vec_id AS id, 'label-' || CAST(label AS STRING) AS report_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "'label-' || CAST(label AS STRING) AS report_id", "embedding")


def _query_vector(spark, sf_dir) -> list[float]:
    """The question: one row, a vector."""
    return list(_vectors(spark, sf_dir).orderBy("id").first()["embedding"])


@register("vector_search", f"WITH {_VEC} SELECT id, report_id, round(list_cosine_similarity(embedding, (SELECT embedding FROM vecs ORDER BY id LIMIT 1)), 8) AS similarity FROM "
          "vecs ORDER BY list_cosine_similarity(embedding, (SELECT embedding FROM vecs ORDER BY id LIMIT 1)) DESC, id LIMIT 500")
def vector_search(spark, sf_dir):
    out, _ = vectors.search(vector_index(spark, sf_dir), _query_vector(spark, sf_dir), k=500)
    return out.withColumn("similarity", F.round("similarity", 8))


@register("vector_search_filtered", f"WITH {_VEC} SELECT id, report_id, round(list_cosine_similarity(embedding, (SELECT embedding FROM vecs ORDER BY id LIMIT 1)), 8) AS "
          "similarity FROM vecs WHERE report_id = 'label-3' ORDER BY list_cosine_similarity(embedding, (SELECT embedding FROM vecs ORDER BY id LIMIT 1)) DESC, id LIMIT 10")
def vector_search_filtered(spark, sf_dir):
    out, _ = vectors.search(vector_index(spark, sf_dir), _query_vector(spark, sf_dir), k=10, where={"report_id": "label-3"})
    return out.withColumn("similarity", F.round("similarity", 8))


@register("vector_search_batch", f"WITH {_VEC}, qs AS (SELECT report_id, min(id) AS query_id, arg_min(embedding, id) AS query FROM vecs GROUP BY 1) SELECT query_id, report_id, id, "
          "round(s, 8) AS similarity, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS pos FROM (SELECT query_id, v.report_id, id, "
          "list_cosine_similarity(embedding, query) AS s FROM vecs v JOIN qs USING (report_id))) WHERE pos <= 10")
def vector_search_batch(spark, sf_dir):
    queries = _vectors(spark, sf_dir).groupBy("report_id").agg(F.min("id").alias("query_id"), F.min_by("embedding", "id").alias("query"))
    return vectors.search_batch(vector_index(spark, sf_dir), queries, k=10).withColumn("similarity", F.round("similarity", 8))


@register("metadata_containment", "SELECT event_id, json_extract(props, '$.k') = '7' AND event_type = 'view' AS contained FROM events")
def metadata_containment(spark, sf_dir):
    meta = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    wanted = F.create_map(F.lit("k"), F.lit("7"), F.lit("type"), F.lit("view"))
    return table(spark, sf_dir, "events").select("event_id", corpus.contains_filter(meta, wanted).alias("contained"))


# Verdicts of an outside judge, per report: a true quote, an invented one, a negative, one that runs over a page end,
# and one for a check that takes no verdicts.
_NORM = "trim(regexp_replace(lower(coalesce(markdown, '')), '\\s+', ' ', 'g'))"
_VERDICTS = (f"""norms AS (SELECT report_id, page_ord, {_NORM} AS t FROM crawl WHERE {_NORM} <> ''),
firsts AS (SELECT report_id, t, nxt FROM (SELECT *, lead(t) OVER w AS nxt, row_number() OVER w AS i FROM norms WINDOW w AS (PARTITION BY report_id ORDER BY page_ord))
  WHERE i = 1),
verdicts AS (SELECT report_id, 'G4' AS check_id, 1.0 AS verdict, upper(substring(t, 3, 40)) AS quote FROM firsts UNION ALL SELECT report_id, 'G6', 0.5, 'words that no page '
  || 'holds' FROM firsts UNION ALL SELECT report_id, 'G8', 0.0, '' FROM firsts UNION ALL SELECT report_id, 'G19', 1.7, right(t, 12) || '  ' || left(nxt, 12) FROM firsts UNION
  ALL SELECT report_id, 'S1', 1.0, substring(t, 3, 40) FROM firsts)""")
_VERIFIED = ("corp AS (SELECT report_id, string_agg(t, ' ' ORDER BY page_ord) AS corpus FROM norms GROUP BY 1), verified AS (SELECT report_id, check_id, CAST(least(greatest(verdict, "
             "0), 1) AS DOUBLE) AS verdict FROM verdicts JOIN corp USING (report_id) WHERE check_id <> 'S1' AND (verdict <= 0 OR (length(q) >= 8 AND contains(corpus, q))))")
_VERIFIED = _VERIFIED.replace("FROM verdicts JOIN", "FROM (SELECT *, trim(regexp_replace(lower(quote), '\\s+', ' ', 'g')) AS q FROM verdicts) JOIN")


def _verified(spark, sf_dir):
    # The given files are one row group each; dealt out first, texts are normalised by all tasks, once.
    pages = workload.crawl(spark, sf_dir).select("report_id", "page_ord", "markdown").filter("markdown <> ''").repartition("report_id", "page_ord")
    texts = materialize(quotes.page_texts(pages), "page-texts")
    ends = texts.select("report_id", F.struct("page_ord", F.left("text", F.lit(60)).alias("t"), F.right("text", F.lit(12)).alias("tail")).alias("page"))
    first = ends.groupBy("report_id").agg(F.min("page").alias("first"))
    second = salted_join(ends, first, ["report_id"], "inner", "page").filter("page.page_ord > first.page_ord").groupBy("report_id").agg(
        F.min("page").alias("second"))
    firsts = first.join(second, "report_id", "left").select("report_id", "first.t", "first.tail", F.col("second.t").alias("nxt"))
    verdicts = firsts.select("report_id", F.explode(F.array(*[F.struct(
        F.lit(c).alias("check_id"), F.lit(v).alias("verdict"), q.alias("quote")) for c, v, q in (
            ("G4", 1.0, F.upper(F.substring("t", 3, 40))), ("G6", 0.5, F.lit("words that no page holds")), ("G8", 0.0, F.lit("")),
            ("G19", 1.7, F.concat("tail", F.lit("  "), F.left("nxt", F.lit(12)))),
            ("S1", 1.0, F.substring("t", 3, 40)))])).alias("v")).select("report_id", "v.*")
    return quotes.verified_in(verdicts, texts)


@register("verified_verdicts", f"WITH {_CRAWL}, {_VERDICTS}, {_VERIFIED} SELECT report_id, check_id, verdict FROM verified")
def verified_verdicts(spark, sf_dir):
    return _verified(spark, sf_dir)


@register("results_with_verdicts", audit_query(
    "SELECT r.report_id, r.check_id, round(coalesce(v.verdict, r.ratio), 9) AS ratio, v.verdict IS NOT NULL AS semantic FROM results r LEFT JOIN verified v USING "
    "(report_id, check_id)", _VERDICTS, _VERIFIED))
def results_with_verdicts(spark, sf_dir):
    out = audit.check_results(facts(spark, sf_dir), aux(spark, sf_dir), AS_OF, _verified(spark, sf_dir))
    return out.select("report_id", "check_id", F.round("ratio", 9).alias("ratio"), "semantic")

