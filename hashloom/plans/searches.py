"""Registered queries of search, state, feeds and segments, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions import names
from hashloom.functions.ints import default_min_score
from hashloom.operators import changelog, feeds, merge, state
from hashloom.operators.kernel import search_all_docs, search_docs
from hashloom.operators.search import SearchOptions, postings, search
from hashloom.plans import fixtures as fx
from hashloom.runtime import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a function as a query of its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _search_sql(postings_sql: str, queries_sql: str, min_score: str, pct: str, most: str, columns: str) -> str:
    """``postings (hash, id)``, ``queries (query_id, hash)`` with repeated rows; the rest are SQL expressions over n, the raw length."""
    return f"""
WITH p AS ({postings_sql}), q AS ({queries_sql}),
  raw AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
  hits AS (SELECT u.query_id, p.id, count(*) AS score FROM p JOIN (SELECT DISTINCT query_id, hash FROM q) u ON p.hash = u.hash GROUP BY 1, 2),
  kept AS (SELECT h.query_id, h.id, h.score, greatest({min_score}, 1) AS floor_ FROM hits h JOIN raw r ON h.query_id = r.query_id WHERE h.score >= greatest({min_score}, 1)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM kept)
SELECT {columns} FROM ranked WHERE rank <= {most} AND (rank = 1 OR score >= greatest(floor_, best * {pct} // 100))
"""


_BASKETS = "SELECT l_partkey AS hash, l_orderkey + 1 AS id FROM lineitem"
_DEFAULT = "(n + 19) // 20"
#: In place of a limit: ``rank <= rank`` holds for every row.
_NO_LIMIT = "rank"


_FIFTIETH = "SELECT l_orderkey + 1 AS query_id, l_partkey AS hash FROM lineitem WHERE l_orderkey % 50 = 0"
_ORDER_100 = "SELECT l_orderkey + 1 AS query_id, l_partkey AS hash FROM lineitem WHERE l_orderkey = 100"


@query(_search_sql(_BASKETS, _ORDER_100, _DEFAULT, "10", "40", "id, score"))
def search_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share the most parts with one order."""
    return search(fx.baskets(spark, sf_dir), fx.basket_queries(spark, sf_dir, 100)).select("id", "score")


@query(_search_sql(_BASKETS, _FIFTIETH, _DEFAULT, "10", "40", "query_id, id, score, rank"))
def search_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(fx.baskets(spark, sf_dir), fx.basket_queries(spark, sf_dir))


@query(_search_sql(_BASKETS, _FIFTIETH, _DEFAULT, "10", "40", "query_id, id, score, rank"))
def search_split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over documents stored in several rows each, one for each flag and status: their elements are one bag."""
    stored = fx.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") + 1).alias("id"), "l_returnflag", "l_linestatus").agg(F.collect_list("l_partkey").alias("hashes"))
    nameless = spark.createDataFrame([(None, "A", "F", [1, 2, 3])], stored.schema)
    return search_docs(stage(stored.unionByName(nameless), "stored"), fx.basket_queries(spark, sf_dir))


@query(_search_sql(_BASKETS, _FIFTIETH, "2", "10", "100", "query_id, id, score"))
def search_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = SearchOptions(limit=100, min_score=2)
    return search(fx.baskets(spark, sf_dir), fx.basket_queries(spark, sf_dir), options).select("query_id", "id", "score")


@query(_search_sql(_BASKETS, _FIFTIETH, "0", "50", "100", "query_id, id, score"))
def search_score_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = SearchOptions(limit=1000, min_score=0, score_pct=50)
    return search(fx.baskets(spark, sf_dir), fx.basket_queries(spark, sf_dir), options).select("query_id", "id", "score")


@query(_search_sql(_BASKETS, _FIFTIETH, "1", "150", "40", "query_id, id, score"))
def search_pct_above_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first survivor stays, whatever the percentage."""
    options = SearchOptions(min_score=1, score_pct=150)
    return search(fx.baskets(spark, sf_dir), fx.basket_queries(spark, sf_dir), options).select("query_id", "id", "score")


@query(_search_sql(_BASKETS, f"{_ORDER_100} UNION ALL {_ORDER_100}", _DEFAULT, "10", "40", "id, score"))
def search_dup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(fx.baskets(spark, sf_dir), fx.basket_queries(spark, sf_dir, 100, 2)).select("id", "score")


@query("SELECT l_orderkey + 1 AS id, l_partkey AS hash, count(*) AS multiplicity FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def search_bag_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.baskets(spark, sf_dir).groupBy("id", "hash").agg(F.count("*").alias("multiplicity")).where("multiplicity > 1")


@query(
    _search_sql(
        "SELECT b.hash, b.id FROM (SELECT l_partkey AS hash, l_orderkey + 1 AS id FROM lineitem) b JOIN "
        "(SELECT hash, id FROM (SELECT hash, id, row_number() OVER (PARTITION BY hash ORDER BY id) AS r FROM (SELECT DISTINCT l_partkey AS hash, l_orderkey + 1 AS id FROM lineitem)) WHERE r <= 10) c "
        "ON b.hash = c.hash AND b.id = c.id",
        _FIFTIETH, _DEFAULT, "10", "40", "query_id, id, score",
    )
)
def search_hash_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ten documents of each hash count: the deterministic form of an opt-in cut of hot hashes."""
    options = SearchOptions(max_docs_per_hash=10)
    return search(fx.baskets(spark, sf_dir), fx.basket_queries(spark, sf_dir), options).select("query_id", "id", "score")


_EVENTS = """SELECT event_id + 1 AS seq, event_id // 100 + 1 AS commit_id, event_id + 1 AS ordinal, user_id + 1 AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS op,
 [CAST(round(value * 100) AS BIGINT), 1000000 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 2000000 + hour(ts)] AS hashes FROM events"""
_NEWEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY commit_id DESC, ordinal DESC) AS r FROM ({_EVENTS})) WHERE r = 1"
_LIVE_POSTINGS = f"SELECT unnest(hashes) AS hash, id FROM ({_NEWEST}) WHERE op = 'insert'"
_HOURS = "SELECT h AS query_id, 2000000 + h AS hash FROM range(24) t(h) UNION ALL SELECT h, 1000000 + h FROM range(24) t(h)"


def hour_queries(spark: SparkSession) -> DataFrame:
    return spark.range(24).select(F.col("id").alias("query_id"), F.array(F.col("id") + 2_000_000, F.col("id") + 1_000_000).alias("hashes"))


def live_search(changes: DataFrame) -> DataFrame:
    """Search of hours over the live documents of a change log."""
    return search(postings(state.live_docs(changes)), hour_queries(changes.sparkSession))


@query(_search_sql(_LIVE_POSTINGS, _HOURS, _DEFAULT, "10", "40", "query_id, id, score"))
def search_live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_search(fx.event_changes(spark, sf_dir)).select("query_id", "id", "score")


def _shingles(name: str, item: str) -> str:
    return f"""SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: ('0x' || substr(md5(array_to_string(w[i:i+2], ' ')), 1, 8))::BIGINT)) AS hash
 FROM (SELECT {item} + 1 AS id, string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ') AS w FROM {name} WHERE text IS NOT NULL) WHERE len(w) >= 3"""


def _doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, without reading their texts."""
    return fx.table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"))


@query(
    _search_sql(
        _shingles("documents", "doc_id").replace("SELECT id, unnest", "SELECT hash, id FROM (SELECT id, unnest") + ")",
        _shingles("eval_items", "item_id").replace("SELECT id, unnest", "SELECT id AS query_id, hash FROM (SELECT id, unnest") + ")",
        _DEFAULT, "10", "40", "query_id - 1 AS item_id, id - 1 AS doc_id, score",
    )
)
def search_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test passages as queries over all documents, by shared three-word shingles: the 40 best documents of each.

    A top-40 report of the search operator. ``search_contamination_all`` has every document, and ``p8_found`` is the leak detection.
    """
    items = fx.shingle_docs(fx.table(spark, sf_dir, "eval_items"), "item_id").withColumnRenamed("id", "query_id")
    docs = fx.shingle_docs(fx.table(spark, sf_dir, "documents"), "doc_id")
    found = search_docs(docs, items, ids=_doc_ids(spark, sf_dir))
    return found.select((F.col("query_id") - 1).alias("item_id"), (F.col("id") - 1).alias("doc_id"), "score")


@query(
    _search_sql(
        _shingles("documents", "doc_id").replace("SELECT id, unnest", "SELECT hash, id FROM (SELECT id, unnest") + ")",
        _shingles("eval_items", "item_id").replace("SELECT id, unnest", "SELECT id AS query_id, hash FROM (SELECT id, unnest") + ")",
        f"least({_DEFAULT}, 13)", "0", _NO_LIMIT, "query_id - 1 AS item_id, id - 1 AS doc_id, score",
    )
)
def search_contamination_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test passages with all documents that share a twentieth of their three-word shingles or 13 of them, however many they are.

    Fifteen equal words are 13 equal shingles, so every document with such a run is there. Words are compared as written;
    ``p8_found`` also finds runs that differ in case, accents, punctuation or remarks in brackets.
    """
    items = fx.shingle_docs(fx.table(spark, sf_dir, "eval_items"), "item_id").withColumnRenamed("id", "query_id")
    items = items.withColumn("min_score", F.least(default_min_score(F.size("hashes")), F.lit(13)))
    docs = fx.shingle_docs(fx.table(spark, sf_dir, "documents"), "doc_id")
    found = search_all_docs(docs, items, SearchOptions(score_pct=0), ids=_doc_ids(spark, sf_dir))
    return found.select((F.col("query_id") - 1).alias("item_id"), (F.col("id") - 1).alias("doc_id"), "score")


@query(
    _search_sql(
        _shingles("documents", "doc_id").replace("SELECT id, unnest", "SELECT hash, id FROM (SELECT id, unnest") + ")",
        _shingles("documents", "doc_id").replace("SELECT id, unnest", "SELECT id AS query_id, hash FROM (SELECT id, unnest").replace("WHERE text IS NOT NULL", "WHERE text IS NOT NULL AND doc_id % 50 = 0") + ")",
        "(n + 1) // 2", "50", "40", "query_id - 1 AS doc_id, id - 1 AS other_id, score",
    )
)
def search_documents_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document as a query over all documents: the 40 best that score at least half of its shingles and of the best score.

    A top-40 report of the search operator; ``search_documents_neardup_all`` gives every such document.
    """
    docs = fx.shingle_docs(fx.table(spark, sf_dir, "documents"), "doc_id")
    asked = docs.where("(id - 1) % 50 = 0").select(F.col("id").alias("query_id"), "hashes", F.floor((F.size("hashes") + 1) / 2).alias("min_score"), F.lit(50).alias("score_pct"))
    found = search_docs(docs, asked, ids=_doc_ids(spark, sf_dir))
    return found.select((F.col("query_id") - 1).alias("doc_id"), (F.col("id") - 1).alias("other_id"), "score")


@query(
    _search_sql(
        _shingles("documents", "doc_id").replace("SELECT id, unnest", "SELECT hash, id FROM (SELECT id, unnest") + ")",
        _shingles("documents", "doc_id").replace("SELECT id, unnest", "SELECT id AS query_id, hash FROM (SELECT id, unnest").replace("WHERE text IS NOT NULL", "WHERE text IS NOT NULL AND doc_id % 50 = 0") + ")",
        "(n + 1) // 2", "0", _NO_LIMIT, "query_id - 1 AS doc_id, id - 1 AS other_id, score",
    )
)
def search_documents_neardup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document with all documents that score at least half of its shingles, however many they are.

    As in every search, a score counts each repetition of a shingle in the found document.
    """
    docs = fx.shingle_docs(fx.table(spark, sf_dir, "documents"), "doc_id")
    asked = docs.where("(id - 1) % 50 = 0").select(F.col("id").alias("query_id"), "hashes", F.floor((F.size("hashes") + 1) / 2).alias("min_score"))
    found = search_all_docs(docs, asked, SearchOptions(score_pct=0), ids=_doc_ids(spark, sf_dir))
    return found.select((F.col("query_id") - 1).alias("doc_id"), (F.col("id") - 1).alias("other_id"), "score")


_VECTORS = " UNION ALL ".join(
    f"SELECT {band * 65536} + " + " + ".join(f"CASE WHEN embedding[{band * 16 + i + 1}] > 0 THEN {2**i} ELSE 0 END" for i in range(16)) + " AS hash, vec_id + 1 AS id FROM embeddings" for band in range(4)
)


@query(_search_sql(_VECTORS, f"SELECT id AS query_id, hash FROM ({_VECTORS}) WHERE (id - 1) % 50 = 0", _DEFAULT, "10", "40", "query_id, id, score"))
def search_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as a query over all vectors: bands of equal signs.

    A fixture of set overlap, no nearest-neighbour index: four bands of 16 signs find little besides the query itself.
    """
    rows = fx.signed_vectors(spark, sf_dir)
    asked = rows.where("(id - 1) % 50 = 0").groupBy(F.col("id").alias("query_id")).agg(F.collect_list("hash").alias("hashes"))
    return search(rows, asked).select("query_id", "id", "score")


_SET = "list_distinct(list_transform(list_filter({0}, lambda x: x IS NOT NULL), lambda x: x & 4294967295))"
_REQUESTS = f"""
WITH docs AS (SELECT id, index_name, hashes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS r FROM fingerprints) WHERE r = 1),
  p AS (SELECT id, index_name, h & 4294967295 AS hash FROM (SELECT id, index_name, unnest(hashes) AS h FROM docs) WHERE h IS NOT NULL),
  req AS (SELECT DISTINCT query_id, index_name, query, least(greatest(coalesce(result_limit, 40), 1), 100) AS most,
          greatest(coalesce(min_score, (len(list_filter(query, lambda x: x IS NOT NULL)) + 19) // 20), 1) AS floor_, coalesce(score_pct, 10) AS pct FROM search_requests),
  q AS (SELECT query_id, index_name, unnest({_SET.format("query")}) AS hash FROM req),
  hits AS (SELECT q.query_id, p.id, count(*) AS score FROM p JOIN q ON p.hash = q.hash AND p.index_name = q.index_name GROUP BY 1, 2),
  ranked AS (SELECT h.*, req.floor_, req.pct, req.most, row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, h.id) AS rank, max(h.score) OVER (PARTITION BY h.query_id) AS best
             FROM hits h JOIN req ON h.query_id = req.query_id WHERE h.score >= floor_)
SELECT query_id, id, score, rank FROM ranked WHERE rank <= most AND (rank = 1 OR score >= greatest(floor_, best * pct // 100))
"""


@query(_REQUESTS)
def search_requests_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored search requests, with their own limits, over the newest fingerprints of their index."""
    stored = fx.table(spark, sf_dir, "fingerprints")
    newest = stored.groupBy("id").agg(F.max("version").alias("version"))
    docs = stored.join(newest, ["id", "version"]).dropDuplicates(["id"])
    asked = fx.table(spark, sf_dir, "search_requests").select("query_id", "index_name", F.col("query").alias("hashes"), F.col("result_limit").alias("limit"), "min_score", "score_pct").distinct()
    return search_docs(docs, asked, scope=("index_name",))


@query(f"SELECT hash, id FROM ({_BASKETS})")
def explode_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags = fx.baskets(spark, sf_dir).groupBy("id").agg(F.collect_list("hash").alias("hashes"))
    return postings(bags).orderBy("hash", "id")


@query(f"SELECT id, commit_id AS version, op = 'delete' AS deleted FROM ({_NEWEST})")
def latest_doc_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.doc_versions(fx.event_changes(spark, sf_dir))


@query(f"SELECT commit_id, id, op FROM (SELECT *, row_number() OVER (PARTITION BY commit_id, id ORDER BY ordinal DESC) AS r FROM ({_EVENTS})) WHERE r = 1")
def batch_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_in_commit(fx.event_changes(spark, sf_dir)).select("commit_id", "id", "op")


@query(f"SELECT id FROM ({_NEWEST}) WHERE op = 'delete'")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tombstones(fx.event_changes(spark, sf_dir))


@query(f"SELECT id FROM ({_NEWEST}) WHERE op = 'insert'")
def live_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.live_docs(fx.event_changes(spark, sf_dir)).select("id")


@query(f"WITH e AS ({_EVENTS}) SELECT id, seq FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.id = a.id AND b.commit_id > a.commit_id)")
def superseded_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that no newer commit shadows."""
    return state.not_superseded(fx.event_changes(spark, sf_dir)).select("id", "seq")


@query(
    f"""WITH e AS ({_EVENTS}) SELECT max(commit_id) AS version, (SELECT count(*) FROM (SELECT DISTINCT commit_id, id FROM e)) AS num_docs, (SELECT count(*) FROM ({_NEWEST}) WHERE op = 'insert') AS num_live,
 min(id) AS min_doc_id, max(id) AS max_doc_id, count(DISTINCT commit_id) AS num_segments FROM e"""
)
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.statistics(fx.event_changes(spark, sf_dir))


@query("SELECT r_name AS key, arg_max(n_name, n_nationkey) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def metadata_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.metadata_state(fx.region_metadata(spark, sf_dir))


@query(
    f"""WITH e AS ({_EVENTS}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit_id, id ORDER BY ordinal DESC) AS r FROM e) WHERE r = 1),
 newest AS (SELECT id, max(commit_id) AS commit_id FROM last GROUP BY id)
SELECT unnest(l.hashes) AS hash, l.id FROM last l JOIN newest n ON l.id = n.id AND l.commit_id = n.commit_id WHERE l.op = 'insert'"""
)
def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commits of the event log merged into one segment's postings."""
    docs = state.last_in_commit(fx.event_changes(spark, sf_dir))
    items = docs.where("kind = 'i'").select("commit_id", F.explode("hashes").alias("hash"), "id")
    return merge.merged_postings(items, docs.select("commit_id", "id"))


def _infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = fx.event_changes(spark, sf_dir)
    return changes.groupBy("commit_id").agg(F.max("seq").alias("version")).select("commit_id", F.lit(0).cast("bigint").alias("merges"), F.when(F.col("commit_id") % 2 == 0, F.col("version")).alias("version"))


_INFOS = f"SELECT commit_id, 0 AS merges, CASE WHEN commit_id % 2 = 0 THEN max(seq) END AS version FROM ({_EVENTS}) GROUP BY commit_id"


@query(f"SELECT min(commit_id) AS commit_id, CAST(sum(merges + 1) - 1 AS BIGINT) AS merges, max(version) AS version FROM ({_INFOS})")
def segment_info_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merged_info(_infos(spark, sf_dir))


@query(f"SELECT max(commit_id + merges) AS commit_id, max(coalesce(version, commit_id + merges)) AS version FROM ({_INFOS})")
def segment_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.watermarks(_infos(spark, sf_dir))


@query(f"SELECT a.commit_id, count(*) AS n FROM (SELECT commit_id, commit_id % 5 AS merges FROM ({_INFOS})) a JOIN ({_INFOS}) b ON a.commit_id <= b.commit_id AND a.commit_id + a.merges >= b.commit_id GROUP BY 1")
def segment_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many commits each merged interval holds."""
    infos = _infos(spark, sf_dir)
    a = infos.select("commit_id", (F.col("commit_id") % 5).alias("merges"))
    # Candidates by the few commits an interval can hold: an equi-join, not a range join over all pairs.
    a = a.withColumn("inner_id", F.explode(F.sequence("commit_id", F.col("commit_id") + F.col("merges"))))
    b = infos.select(F.col("commit_id").alias("inner_id"), F.col("merges").alias("inner_merges"))
    held = a.join(b, "inner_id").where(merge.contains(F.col("commit_id"), F.col("merges"), F.col("inner_id"), F.col("inner_merges")))
    return held.groupBy("commit_id").agg(F.count("*").alias("n"))


@query(f"SELECT commit_id, least(100, commit_id % 120 + 10) * n // 100 AS items FROM (SELECT commit_id, count(*) AS n FROM ({_EVENTS}) GROUP BY 1)")
def merge_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = fx.event_changes(spark, sf_dir).groupBy("commit_id").agg(F.count("*").alias("n"))
    return sizes.select("commit_id", merge.merge_estimate(F.col("n"), F.col("commit_id") % 120).alias("items"))


@query(f"SELECT seq, id, op FROM ({_EVENTS}) WHERE seq > 5000 ORDER BY seq LIMIT 1024")
def feed_read_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.read_after(fx.event_changes(spark, sf_dir), 5000, 100_000).select("seq", "id", "op")


@query(f"SELECT (SELECT max(seq) FROM ({_EVENTS})) + row_number() OVER (ORDER BY event_id) AS seq, user_id + 1 AS id FROM events")
def feed_append_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log appended to itself once more: each operation gets the next position."""
    changes = fx.event_changes(spark, sf_dir)
    last = changes.agg(F.max("seq")).first()[0] or 0
    return changelog.appended(changes.select("id", F.col("seq").alias("place")), last, "place").select("seq", "id")


_META = "SELECT event_id + 1 AS pos, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' END AS kind, 'u' || user_id AS index_name FROM events WHERE event_type IN ('signup', 'error')"
_FOLDED = f"SELECT index_name, max(pos) AS generation, arg_max(kind, pos) = 'create' AS active FROM ({_META}) GROUP BY 1"


@query(_FOLDED)
def meta_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.folded_meta(fx.user_registry(spark, sf_dir))


@query(f"SELECT DISTINCT index_name FROM ({_META}) WHERE index_name NOT IN (SELECT index_name FROM ({_FOLDED}) WHERE active)")
def stale_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = fx.user_registry(spark, sf_dir)
    return changelog.stale(ops.select("index_name"), changelog.folded_meta(ops))


@query("SELECT DISTINCT m.index_name, m.pos AS generation FROM meta_feed m JOIN (SELECT index_name, max(pos) AS pos FROM meta_feed GROUP BY 1) l ON m.index_name = l.index_name AND m.pos = l.pos WHERE m.kind = 'create'")
def active_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.active_generations(fx.table(spark, sf_dir, "meta_feed"))


@query(
    """SELECT 'http://peer-' || s_suppkey AS base_url, CAST(floor(abs(s_acctbal)) AS BIGINT) AS file_version, row_number() OVER (ORDER BY floor(abs(s_acctbal)) DESC, 'http://peer-' || s_suppkey) AS rank
FROM supplier WHERE s_acctbal > 0 AND s_nationkey % 3 + 1 = 2 AND floor(abs(s_acctbal)) > 1000"""
)
def donor_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.ranked_donors(fx.supplier_probes(spark, sf_dir), 2, 1000).select("base_url", "file_version", "rank")


_DELTAS = "SELECT hash, id, id - coalesce(lag(id) OVER (PARTITION BY hash ORDER BY id), 0) AS delta FROM (SELECT DISTINCT l_partkey AS hash, l_orderkey + 1 AS id FROM lineitem)"


@query(_DELTAS)
def delta_encode_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.delta_encoded(fx.baskets(spark, sf_dir).distinct())


@query(_DELTAS)
def delta_decode_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = merge.delta_encoded(fx.baskets(spark, sf_dir).distinct())
    return merge.delta_decoded(encoded.select("hash", F.col("id").alias("place"), "delta"))


@query("SELECT hash, hash - coalesce(lag(hash) OVER (ORDER BY hash), 0) AS gap FROM (SELECT DISTINCT l_partkey AS hash FROM lineitem)")
def hash_gap_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.hash_gaps(fx.baskets(spark, sf_dir))


@query(
    f"WITH n AS (SELECT hash, count(*) AS n FROM ({_BASKETS}) GROUP BY hash) SELECT b AS le, (SELECT count(*) FROM n WHERE n <= b) AS cnt FROM unnest([1, 2, 3, 5, 10, 50, 100, 500, 1000]) t(b) UNION ALL SELECT NULL, count(*) FROM n"
)
def scanned_docs_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fx.baskets(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("n"))
    return merge.histogram(counts, "n", merge.SCANNED_DOCS)


_LISTS = ("1,2,3", "-1,-2147483648,4294967295", "10,-7,4294967296", "2147483648,0")


@query(
    "SELECT row_number, pos, hash FROM (SELECT l.row_number, unnest(range(1, len(l.items) + 1)) AS pos, unnest(list_transform(l.items, lambda x: CAST(x AS BIGINT) & 4294967295)) AS hash FROM (VALUES "
    + ", ".join(f"({i}, string_split('{text}', ','))" for i, text in enumerate(_LISTS))
    + ") l(row_number, items))"
)
def parse_signed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(_LISTS)), "row_number int, text string")
    parsed = rows.select("row_number", F.posexplode(names.parse_hash_list(F.col("text"))).alias("pos", "hash"))
    return parsed.select("row_number", (F.col("pos") + 1).cast("bigint").alias("pos"), "hash")


@query("SELECT DISTINCT index_name AS name, regexp_full_match(index_name, '[A-Za-z0-9_-]{1,255}') AS valid FROM (SELECT index_name FROM meta_feed UNION ALL SELECT agenda_item FROM documents WHERE agenda_item IS NOT NULL)")
def valid_index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = fx.table(spark, sf_dir, "meta_feed").select(F.col("index_name").alias("name")).unionAll(fx.table(spark, sf_dir, "documents").where("agenda_item is not null").select("agenda_item"))
    return every.distinct().select("name", names.valid_index_name(F.col("name")).alias("valid"))


@query(
    f"SELECT commit_id, printf('%016x-%08x.data', commit_id, commit_id % 7) AS segment, printf('%016x.xlog', commit_id) AS log, printf('v%06d', commit_id * 1000) AS dir, commit_id % 7 AS merges FROM (SELECT DISTINCT commit_id FROM ({_EVENTS}))"
)
def segment_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = fx.event_changes(spark, sf_dir).select("commit_id").distinct()
    named = commits.select(
        "commit_id", names.segment_name(F.col("commit_id"), F.col("commit_id") % 7).alias("segment"), names.log_name(F.col("commit_id")).alias("log"), names.lineage_dir(F.col("commit_id") * 1000).alias("dir"),
    )
    return named.withColumn("merges", names.parse_segment_name(F.col("segment"))["merges"])


@query(f"SELECT qid AS query_id, string_agg(id || ':' || score, ' ' ORDER BY score DESC, id) AS line FROM ({_search_sql(_BASKETS, _FIFTIETH, _DEFAULT, '10', '40', 'query_id AS qid, id, score')}) GROUP BY qid")
def session_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a batch as lines of the line protocol (at most 40 results each)."""
    found = search(fx.baskets(spark, sf_dir), fx.basket_queries(spark, sf_dir))
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("r"))
    return lists.select("query_id", names.format_results(F.col("r")).alias("line"))


@query("SELECT least(greatest(coalesce(result_limit, 40), 1), 100) AS result_limit, least(coalesce(timeout_ms, 500), 10000) AS timeout_ms, count(*) AS n FROM search_requests GROUP BY 1, 2")
def option_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.greatest(F.least(F.coalesce("result_limit", F.lit(40)), F.lit(100)), F.lit(1))
    timeout = F.least(F.coalesce("timeout_ms", F.lit(500)), F.lit(10_000))
    return fx.table(spark, sf_dir, "search_requests").groupBy(limit.alias("result_limit"), timeout.alias("timeout_ms")).agg(F.count("*").alias("n"))


@query("SELECT index_name, generation, seq FROM (SELECT DISTINCT index_name, generation, seq, change.id AS id, change.op AS op FROM changelog) WHERE (id IS NULL OR id < 1 OR id > 4294967295) AND left(op, 1) IN ('i', 'd')")
def invalid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries whose document id no write accepts."""
    rows = fx.table(spark, sf_dir, "changelog").select("index_name", "generation", "seq", F.col("change.id").alias("id"), feeds.op_kind(F.col("change.op")).alias("kind"))
    return rows.where("kind in ('i', 'd') and (id is null or id < 1 or id > 4294967295)").select("index_name", "generation", "seq").distinct()


@query("SELECT index_name, generation, max(seq) AS seq FROM changelog GROUP BY 1, 2")
def feed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "changelog").groupBy("index_name", "generation").agg(F.max("seq").alias("seq"))


@query("SELECT index_name, count(*) AS searches, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM (SELECT r.index_name, r.query_id, EXISTS (SELECT 1 FROM search_hits h WHERE h.query_id = r.query_id AND h.score IS NOT NULL) AS hit FROM (SELECT DISTINCT query_id, index_name FROM search_requests) r) GROUP BY 1")
def search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches, hits and misses of each index."""
    answered = fx.table(spark, sf_dir, "search_hits").where("score is not null").select("query_id").distinct().withColumn("hit", F.lit(True))
    asked = fx.table(spark, sf_dir, "search_requests").select("query_id", "index_name").distinct().join(answered, "query_id", "left")
    hit = F.col("hit").isNotNull()
    return asked.groupBy("index_name").agg(F.count("*").alias("searches"), F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(~hit, 1)).alias("misses"))
