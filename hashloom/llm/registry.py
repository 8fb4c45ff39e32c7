"""Queries of the training-data operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.ints import u32
from hashloom.llm import contamination, heavy_hitters, language, mixing, near_dups, set_join, top_n
from hashloom.runtime import small_side, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The corpus, on all cores: every operator here spends far more on a text than reading it."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def _frequent(spark: SparkSession, sf_dir: str, share: str) -> DataFrame:
    return heavy_hitters.frequent_values(table(spark, sf_dir, "fingerprints"), "hashes", share, prepare=heavy_hitters.mask_u32, prepared=u32)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u32 hashes that make up at least 0.2 % of all stored hash elements."""
    return _frequent(spark, sf_dir, "0.002").select(F.col("value").alias("hash"))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of at least 0.05 % with exact counts; within_bounds: the summary's bounds hold the exact count."""
    found = _frequent(spark, sf_dir, "0.0005")
    return found.select(F.col("value").alias("hash"), F.col("count").alias("n"), "total", F.col("count").between(F.col("low"), F.col("high")).alias("within_bounds"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of stored ids whose newest hash sets have a Jaccard similarity of 0.5 or more."""
    return set_join.similar_pairs(table(spark, sf_dir, "fingerprints"), "id", "hashes", "0.5", "version").select("id_a", "id_b")


def p2_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests whose query set overlaps a stored id by 0.5 or more, with the overlap."""
    stored = table(spark, sf_dir, "fingerprints")
    asked = table(spark, sf_dir, "search_requests").select(F.col("query_id").alias("id"), F.col("query").alias("hashes"), F.lit(0).alias("version"))
    found = set_join.similar_between(asked, stored, "id", "hashes", "0.5", "version")
    return found.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("stored_id"), F.col("overlap").cast("bigint").alias("overlap"), F.col("joined").cast("bigint").alias("joined"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of pending inserts linked by a Jaccard similarity of 0.8 or more."""
    return near_dups.groups(table(spark, sf_dir, "pending_inserts"), "id", "hashes", "0.8").select("id", "group_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first N hits of every search request, N = result_limit (null 40) within 1..100."""
    hits = table(spark, sf_dir, "search_hits")
    best = top_n.top_n_newest(hits, "query_id", "id", "score", "commit_id", 100)
    limits = table(spark, sf_dir, "search_requests").groupBy("query_id").agg(F.max(F.greatest(F.least(F.coalesce("result_limit", F.lit(40)), F.lit(100)), F.lit(1))).alias("most"))
    return best.join(small_side(limits, "limits"), "query_id").where("rank <= most").select("query_id", "id")


def p7_best_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best distinct hits of every query by score, ties by id."""
    hits = table(spark, sf_dir, "search_hits").select("query_id", "id", "score").where("score is not null").distinct()
    return top_n.top_n(hits, "query_id", "score", ["id"], 10).select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 15 or more consecutive words of a test item."""
    items, docs = table(spark, sf_dir, "eval_items"), documents(spark, sf_dir, "doc_id", "text")
    return contamination.leaks(items, "item_id", "text", docs, "doc_id", "text").select("item_id", "doc_id")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(documents(spark, sf_dir, "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "text")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every copy of a document in the mixture."""
    chosen, _ = _mixture(spark, sf_dir)
    return chosen.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each listed source gives to the mixture, against its target."""
    return mixing.shares(*_mixture(spark, sf_dir))


def _profiles(spark: SparkSession, sf_dir: str) -> language.Profiles:
    return language.train(table(spark, sf_dir, "lang_samples"), "sample_id", "lang", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents with a missing or wrong label or with several languages."""
    return language.wrong_labels(_profiles(spark, sf_dir), documents(spark, sf_dir, "doc_id", "text", "lang"), "doc_id", "text", "lang").select("doc_id", "lang").distinct()


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every one-language segment of every document with its confidence."""
    return language.segments(_profiles(spark, sf_dir), documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its main language and all that make up a tenth of it; one row of nulls if none is found, as without text."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = language.document_languages(_profiles(spark, sf_dir), docs, "doc_id", "text", "lang")
    rows = found.select("doc_id", "lang", (F.col("lang") == F.col("main_lang")).alias("main"), "share", "several", "confidence")
    return table(spark, sf_dir, "documents").select("doc_id").distinct().join(rows, "doc_id", "left").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p2_between": p2_between,
    "p3_found": p3_found,
    "p7_found": p7_found,
    "p7_best_by_score": p7_best_by_score,
    "p8_found": p8_found,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_documents": p10_documents,
    "p10_segments": p10_segments,
}

_POSTINGS = "SELECT h & 4294967295 AS hash FROM (SELECT unnest(hashes) AS h FROM fingerprints) WHERE h IS NOT NULL"

_SET = "list_distinct(list_transform(list_filter(hashes, lambda x: x IS NOT NULL), lambda x: x & 4294967295))"
_STORED = f"stored AS (SELECT id, {_SET} AS s FROM (SELECT id, hashes, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM fingerprints) WHERE rn = 1)"
_ASKED = f"asked AS (SELECT DISTINCT ON (query_id) query_id AS id, {_SET.replace('hashes', 'query')} AS s FROM search_requests)"


def _overlaps(left: str, right: str) -> str:
    return f"""met AS (SELECT a.id AS ia, b.id AS ib, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
FROM (SELECT id, len(s) AS n, unnest(s) AS h FROM {left}) a JOIN (SELECT id, len(s) AS n, unnest(s) AS h FROM {right}) b ON a.h = b.h {"AND a.id < b.id" if left == right else ""} GROUP BY 1, 2)"""


def _without_brackets(text: str) -> str:
    """Pairs of brackets up to three levels deep."""
    for _ in range(3):
        text = f"regexp_replace(regexp_replace({text}, '\\([^()]*\\)', ' ', 'g'), '\\[[^\\[\\]]*\\]', ' ', 'g')"
    return text


def _runs(table: str, item: str) -> str:
    """Each run of 15 words of each text, as p8 sees words."""
    words = f"regexp_extract_all(replace(strip_accents(lower({_without_brackets('text')})), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
    return f"""SELECT DISTINCT {item}, unnest(list_transform(range(1, len(w) - {contamination.RUN - 2}), lambda i: array_to_string(w[i:i+{contamination.RUN - 1}], ' '))) AS run
FROM (SELECT {item}, {words} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= {contamination.RUN}"""


ORACLES = {
    "p8_found": f"SELECT DISTINCT item_id, doc_id FROM ({_runs('eval_items', 'item_id')}) i JOIN ({_runs('documents', 'doc_id')}) d ON i.run = d.run",
    "p1_found": f"WITH p AS ({_POSTINGS}) SELECT hash FROM p GROUP BY hash HAVING count(*) * 1000 >= 2 * (SELECT count(*) FROM p)",
    "p1_counts": f"WITH p AS ({_POSTINGS}) SELECT hash, count(*) AS n, (SELECT count(*) FROM p) AS total, true AS within_bounds FROM p GROUP BY hash HAVING count(*) * 10000 >= 5 * (SELECT count(*) FROM p)",
    "p2_found": f"WITH {_STORED}, {_overlaps('stored', 'stored')} SELECT ia AS id_a, ib AS id_b FROM met WHERE k * 2 >= na + nb - k",
    "p2_between": f"WITH {_STORED}, {_ASKED}, {_overlaps('asked', 'stored')} SELECT ia AS query_id, ib AS stored_id, k AS overlap, na + nb - k AS joined FROM met WHERE k * 2 >= na + nb - k",
    "p3_found": f"""WITH RECURSIVE pending AS (SELECT DISTINCT ON (id) id, {_SET} AS s FROM pending_inserts), {_overlaps('pending', 'pending')},
  links AS (SELECT ia AS u, ib AS v FROM met WHERE k * 5 >= (na + nb - k) * 4), sym AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
  reach AS (SELECT u, v FROM sym UNION SELECT r.u, s.v FROM reach r JOIN sym s ON r.v = s.u)
SELECT u AS id, min(v) AS group_id FROM reach GROUP BY u""",
    "p7_found": """
WITH newest AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id, id ORDER BY commit_id DESC NULLS LAST, score DESC) AS rn FROM search_hits WHERE score IS NOT NULL),
  ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM newest WHERE rn = 1),
  limits AS (SELECT DISTINCT query_id, least(greatest(coalesce(result_limit, 40), 1), 100) AS n FROM search_requests)
SELECT query_id, id FROM ranked JOIN limits USING (query_id) WHERE r <= n""",
    "p7_best_by_score": """
SELECT query_id, id, score, r AS rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r
FROM (SELECT DISTINCT query_id, id, score FROM search_hits WHERE score IS NOT NULL)) WHERE r <= 10""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
