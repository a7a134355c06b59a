"""Retrieval and text queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import udfs
from tessera.operators import folds as F_
from tessera.operators import retrieval as R
from tessera.sources.tables import EVIDENCE, LEDGER, evidence, ledger, table

BUDGET = 4000


def retr_lexical_topk(spark, d):
    return R.lexical(table(spark, d, "benchmark"), table(spark, d, "documents").select("doc_id", "text"), 2)


def retr_bm25_topk(spark, d):
    return R.bm25(table(spark, d, "benchmark"), table(spark, d, "documents").select("doc_id", "text"), 3)


def retr_dense_topk(spark, d):
    return R.dense(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, 3)


HALF_LIFE, MARGIN, NOW = 400.0, 0.05, 1200


def retr_rrf_fusion(spark, d):
    """Words, BM25, names and vectors, fused and weighed by the documents' age, term and status; NOW and the term count in ids."""
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents").select("doc_id", "text")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.join(b.select(F.col("item_id").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("item_id"), F.lit(None).cast("long").alias("own"), "embedding")
    names = R.channels(b, docs, 10, words=X.names).where("channel = 'lexical'").withColumn("channel", F.lit("entity"))
    return R.abstaining(R.recalled([R.channels(b, docs, 10), names, R.nearest(vectors, asked, 10)], _memories(spark, d), F.lit(NOW), 3, HALF_LIFE, MARGIN), b)


def _memories(spark, d):
    i = F.col("id")
    status = F.when(F.col("status") == "PENDING", "CANDIDATE").when((F.col("status") == "ACTIVE") & (i % 11 == 0), "SUPERSEDED").when((F.col("status") == "ACTIVE") & (i % 13 == 0), "ARCHIVED").otherwise(F.col("status"))
    return evidence(spark, d).select(i.alias("doc_id"), i.alias("occurred"), F.when(i % 5 == 0, i + 100).alias("valid_from"), F.when(i % 9 == 0, i + 200).alias("valid_to"), (i % 4 / 4).alias("importance"), status.alias("status"))


def retr_bounded_sources(spark, d):
    """What of a site's pages, in order of their ids, a question may be given."""
    pages = table(spark, d, "pages").withColumn("site", X.host(F.col("url")))
    return F_.bounded_sources(pages, "site", "page_id", "url", "html").select("site", "place", "content_hash")


def retr_context_pack(spark, d):
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents").select("doc_id", "text")
    best = R.lexical(b, docs, 8).join(docs.select("doc_id", F.length("text").alias("size")), "doc_id")
    return R.packed(best, "item_id", "place", F.col("size"), BUDGET)


def retr_inherited(spark, d):
    """Events as runs of their users, naming runs by number; those with an even k were published; pages as their sources."""
    e = ledger(spark, d)
    runs = e.select(F.col("event_id").alias("run_id"), (F.col("user_id") % 10).alias("scope_id"), F.when(F.col("k") % 9 == 0, "INVALIDATED").otherwise("READY").alias("phase"))
    wanted = e.select(F.col("event_id").alias("run_id"), F.explode(F.transform(F.sequence(F.lit(1), F.col("k") % 16 + 1), lambda i: F.struct(((F.col("event_id") * 7 + F.floor(i / 2) * 10) % 900).alias("from_run"), i.alias("place")))).alias("x")).select("run_id", "x.from_run", "x.place")
    sources = table(spark, d, "pages").select((F.col("page_id") % 900).alias("run_id"), "url", (F.col("page_id") % 1700).alias("retrieved_at"))
    return R.inherited(runs, wanted, e.where("k % 2 = 0").select(F.col("event_id").alias("run_id")), sources, F.lit(1000))


def retr_official_first(spark, d):
    return R.official_first(table(spark, d, "pages").select("page_id", "url"))


def retr_host_parse(spark, d):
    return table(spark, d, "pages").select("page_id", X.host(F.col("url")).alias("host"))


def retr_source_years(spark, d):
    return table(spark, d, "pages").select("page_id", X.years(F.col("html")).alias("years"))


def retr_cache_fresh(spark, d):
    return R.fresh_hits(ledger(spark, d), 24 * 3600)


def text_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("n_words"), F.size(X.terms(F.col("text"))).cast("long").alias("n_terms"))


def text_normalised(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.normalised(F.col("text")).alias("normalised"))


def text_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimated_tokens(F.col("text")).alias("tokens"))


def text_redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.redacted(F.col("text"), 4200), 256).alias("redacted"))


def text_numbers(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(X.numbers(F.col("html"))).cast("array<string>"), ",").alias("numbers"))


def text_excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


def text_permission_demands(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(udfs.permission_demands("text"), "\n").alias("demands"))


def text_query_refusals(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.query_refusal(F.col("text")).alias("refused"))


WORDS = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')"
NAMES = r"regexp_extract_all(text, '\p{Lu}[\p{L}\p{N}_]{7,}')"
LEXICAL = f"""q AS (SELECT item_id, unnest(list_distinct({WORDS})) AS term FROM benchmark), dt AS (SELECT doc_id, unnest(list_distinct({WORDS})) AS term FROM documents),
      lex AS (SELECT item_id, doc_id, overlap, CAST(row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS INT) AS place FROM (SELECT item_id, doc_id, count(*) AS overlap FROM q JOIN dt ON dt.term = q.term GROUP BY item_id, doc_id))"""
BM25 = f"""w AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM w),
      tf AS (SELECT doc_id, len, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, len, term),
      df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
      sc AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
        FROM tf JOIN df ON df.term = tf.term JOIN q ON q.term = tf.term CROSS JOIN s GROUP BY item_id, doc_id),
      bm AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS place FROM sc)"""
HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"

SQL = {
    "retr_lexical_topk": f"WITH {LEXICAL} SELECT item_id, doc_id, overlap, place FROM lex WHERE place <= 2",
    "retr_bm25_topk": f"WITH {LEXICAL}, {BM25} SELECT item_id, doc_id, score, place FROM bm WHERE place <= 3",
    "retr_dense_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
      s AS (SELECT q.vec_id AS item_id, e.vec_id, round(list_sum(list_transform(range(1, len(e.e) + 1), lambda i: e.e[i] * q.e[i])) / (sqrt(list_sum(list_transform(e.e, lambda x: x * x))) * sqrt(list_sum(list_transform(q.e, lambda x: x * x)))), 6) AS score
        FROM e JOIN q ON e.vec_id <> q.vec_id)
      SELECT item_id, vec_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS INT) AS place FROM s QUALIFY place <= 3""",
    "retr_rrf_fusion": f"""WITH {LEXICAL}, {BM25}, {EVIDENCE},
      nq AS (SELECT item_id, unnest(list_distinct({NAMES})) AS term FROM benchmark), nd AS (SELECT doc_id, unnest(list_distinct({NAMES})) AS term FROM documents),
      en AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS place FROM (SELECT item_id, doc_id, count(*) AS n FROM nq JOIN nd ON nd.term = nq.term GROUP BY item_id, doc_id)),
      v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), vq AS (SELECT vec_id AS item_id, e FROM v WHERE vec_id IN (SELECT item_id FROM benchmark)),
      de AS (SELECT item_id, vec_id AS doc_id, cosine, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, vec_id) AS place FROM (SELECT item_id, vec_id,
        round(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: v.e[i] * vq.e[i])) / (sqrt(list_sum(list_transform(v.e, lambda x: x * x))) * sqrt(list_sum(list_transform(vq.e, lambda x: x * x)))), 6) AS cosine FROM v CROSS JOIN vq)),
      l AS (SELECT item_id, doc_id, place, 0.0::DOUBLE AS cosine, overlap FROM lex WHERE place <= 10 UNION ALL SELECT item_id, doc_id, place, 0, 0 FROM bm WHERE place <= 10
        UNION ALL SELECT item_id, doc_id, place, 0, 0 FROM en WHERE place <= 10 UNION ALL SELECT item_id, doc_id, place, cosine, 0 FROM de WHERE place <= 10),
      p AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + place)) AS rrf, max(cosine) AS semantic, max(overlap)::DOUBLE AS overlap FROM l GROUP BY item_id, doc_id),
      t AS (SELECT *, max(rrf) OVER w AS most_rrf, max(overlap) OVER w AS most_overlap FROM p WINDOW w AS (PARTITION BY item_id)),
      m AS (SELECT *, CASE WHEN status = 'PENDING' THEN 0.8::DOUBLE WHEN id % 11 = 0 THEN 0.4::DOUBLE WHEN id % 13 = 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS damp FROM evidence WHERE status <> 'DELETED'),
      fs AS (SELECT item_id, doc_id, round(rrf / most_rrf * (0.3::DOUBLE * greatest(semantic, 0) + 0.25::DOUBLE * CASE WHEN most_overlap > 0 THEN overlap / most_overlap ELSE 0 END + 0.15::DOUBLE * pow(0.5::DOUBLE, greatest({NOW} - id, 0) / {HALF_LIFE}::DOUBLE)
        + 0.1::DOUBLE * (id % 4 / 4::DOUBLE) + 0.1::DOUBLE * CAST((id % 5 <> 0 OR id + 100 <= {NOW}) AND (id % 9 <> 0 OR {NOW} < id + 200) AS INT) + 0.1::DOUBLE * damp) * damp, 9) AS score FROM t JOIN m ON m.id = t.doc_id),
      o AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS next FROM fs WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)),
      y AS (SELECT item_id, score - coalesce(next, 0) > {MARGIN}::DOUBLE AS sure FROM o WHERE place = 1)
      SELECT b.item_id, CAST(o.place AS INT) AS place, o.doc_id, o.score FROM benchmark b LEFT JOIN y ON y.item_id = b.item_id AND sure LEFT JOIN o ON o.item_id = y.item_id AND o.place <= 3""",
    "retr_context_pack": f"""WITH RECURSIVE {LEXICAL}, b AS (SELECT item_id, place, lex.doc_id, length(text) AS size FROM lex JOIN documents d ON d.doc_id = lex.doc_id WHERE place <= 8),
      p(item_id, place, used, packed) AS (SELECT DISTINCT item_id, 0, 0::BIGINT, '' FROM b UNION ALL
        SELECT p.item_id, b.place, CASE WHEN used + size <= {BUDGET} THEN used + size ELSE used END,
          CASE WHEN used + size <= {BUDGET} THEN packed || CASE WHEN packed = '' THEN '' ELSE ',' END || b.doc_id ELSE packed END FROM p JOIN b ON b.item_id = p.item_id AND b.place = p.place + 1)
      SELECT item_id, max_by(used, place) AS used, max_by(packed, place) AS packed FROM p GROUP BY item_id""",
    "retr_inherited": f"""WITH {LEDGER}, w AS (SELECT event_id AS run_id, (event_id * 7 + i // 2 * 10) % 900 AS from_run, i FROM (SELECT event_id, unnest(range(1, k % 16 + 2)) AS i FROM ledger)),
      n AS (SELECT run_id, from_run, row_number() OVER (PARTITION BY run_id ORDER BY min(i)) AS nth FROM w GROUP BY run_id, from_run), p AS (SELECT page_id % 900 AS run, url FROM pages WHERE 1000 - page_id % 1700 BETWEEN 0 AND 900)
      SELECT n.run_id, n.from_run, url FROM n JOIN ledger a ON a.event_id = n.run_id JOIN ledger b ON b.event_id = n.from_run JOIN p ON p.run = n.from_run
      WHERE nth <= 12 AND n.run_id <> n.from_run AND a.user_id % 10 = b.user_id % 10 AND b.k % 2 = 0 AND b.k % 9 <> 0""",
    "retr_official_first": rf"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages), a AS (SELECT *, CASE WHEN regexp_matches(host, '\.(gov\.cn|edu\.cn|gov|edu)$') THEN 'OFFICIAL_DOMAIN' ELSE 'OTHER' END AS authority FROM h)
      SELECT page_id, host, authority, CAST(row_number() OVER (PARTITION BY host ORDER BY authority <> 'OFFICIAL_DOMAIN', page_id) AS INT) AS position FROM a""",
    "retr_host_parse": f"SELECT page_id, {HOST} AS host FROM pages",
    "retr_source_years": r"SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(html, '\b(20\d\d)\b', 1))), ','), '') AS years FROM pages",
    "retr_cache_fresh": f"""WITH {LEDGER}, b AS (SELECT event_id, us - max(us) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS age FROM ledger)
      SELECT event_id, coalesce(age BETWEEN 0 AND {24 * 3600 * 1_000_000}, false) AS hit FROM b""",
    "text_terms": f"SELECT doc_id, len({WORDS}) AS n_words, len(list_distinct({WORDS})) AS n_terms FROM documents",
    "text_normalised": r"SELECT item_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]', '', 'g') AS normalised FROM benchmark",
    "text_token_estimate": r"""WITH w AS (SELECT doc_id, text, length(regexp_replace(text, '[\x00-\x7f]', '', 'g')) AS wide FROM documents)
      SELECT doc_id, CAST(floor(wide * 1.5 + (length(text) - wide) / 3.0::DOUBLE) AS BIGINT) + 104 AS tokens FROM w""",
    # RE2 has no look-around: a digit that may not stand beside a number is matched with it and put back; twice, as neighbours share it.
    "text_redaction": r"""WITH k AS (SELECT doc_id, regexp_replace(text, '(?i)(?:sk-|tvly-|Bearer\s+)\S{8,}|\b[A-Za-z0-9_-]{32,}\b', '[hidden]', 'g') AS t FROM documents),
      m AS (SELECT doc_id, regexp_replace(t, '[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}', '[private]', 'g') AS t FROM k),
      n AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\1[private]\2', 'g'), '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\1[private]\2', 'g') AS t FROM m),
      i AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])', '\1[private]\2', 'g'), '(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])', '\1[private]\2', 'g') AS t FROM n)
      SELECT doc_id, sha256(substring(t, 1, 4200)) AS redacted FROM i""",
}
QUERIES = [f for n, f in list(globals().items()) if n.startswith(("retr_", "text_"))]
