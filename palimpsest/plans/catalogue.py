"""The queries over the driver's tables, each with the SQL that says the same where SQL can.

How the tables stand for the memory model: documents are memories (id = doc_id + 1, one tag, scope = source),
orders are an exclusive relation of customers (`has status`), lineitem links suppliers, parts and orders,
events are relations with polarity, conversations are chains of superseding memories, benchmark texts are
queries, and every hundredth row of embeddings asks the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import temporal as T
from palimpsest.functions import text as X
from palimpsest.operators import evaluation, graph, maintenance, paths, ranking, resolve, retrieval, timeline, validity

EPOCH, DAY = 1_704_067_200, 86_400
NOW = EPOCH + 500 * DAY
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seconds(column: str):
    return F.unix_timestamp(column)


# ---- shared pieces -------------------------------------------------------------------------------


def memories(spark: SparkSession, d: str) -> DataFrame:
    """documents as memories, with ends and expiries by rule of the id."""
    quality = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    docs = table(spark, d, "documents").join(quality, "doc_id", "left")
    start = F.lit(EPOCH) + (F.col("doc_id") % 1000) * DAY
    return docs.select(
        (F.col("doc_id") + 1).alias("id"), F.col("text").alias("content"), F.lit("note").alias("kind"), F.array("lang").alias("tags"), F.coalesce(F.col("q").cast("double"), F.lit(0.5)).alias("importance"),
        F.col("source").alias("scope"), start.alias("valid_from"), F.when(F.col("doc_id") % 3 == 0, start + (30 + F.col("doc_id") % 60) * DAY).alias("valid_to"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(NOW)).alias("expired_at"), F.when(F.col("doc_id") % 14 == 0, F.col("doc_id") + 2).alias("superseded_by"),
    )


MEMORIES = f"""memories AS (
  SELECT doc_id + 1 AS id, text AS content, [lang] AS tags, coalesce(q::DOUBLE, 0.5) AS importance, source AS scope, {EPOCH} + (doc_id % 1000) * {DAY} AS valid_from,
    CASE WHEN doc_id % 3 = 0 THEN {EPOCH} + (doc_id % 1000) * {DAY} + (30 + doc_id % 60) * {DAY} END AS valid_to, CASE WHEN doc_id % 7 = 0 THEN {NOW} END AS expired_at,
    CASE WHEN doc_id % 14 = 0 THEN doc_id + 2 END AS superseded_by
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id))"""


def fold_sql(c: str) -> str:
    out = f"lower({c})"
    for _ in range(2):
        out = f"regexp_replace({out}, '([\\p{{L}}\\p{{N}}])[''’ʼ]([\\p{{L}}\\p{{N}}])', '\\1\\2', 'g')"
    out = f"translate({out}, '{X.ACCENTED}', '{X.PLAIN}')"
    for letter, pair in X.DIGRAPHS.items():
        out = f"replace({out}, '{letter}', '{pair}')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def tokens_sql(c: str) -> str:
    return f"list_filter(string_split(coalesce({fold_sql(c)}, ''), ' '), lambda w: w <> '')"


STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
TERMS = f"""asked AS (SELECT item_id AS query_id, list_distinct(list_filter({tokens_sql("text")}, lambda w: length(w) >= 2 AND NOT list_contains({STOP}, w))) AS terms FROM benchmark)"""
WORDS = f"""docs AS (SELECT id, {tokens_sql("content")} AS words, tags FROM memories)"""
BM25 = f"""{MEMORIES}, {TERMS}, {WORDS},
lengths AS (SELECT id, len(words) + len(tags) AS length FROM docs), stats AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths),
terms AS (SELECT id, unnest(words) AS asked, 1.0 AS w FROM docs UNION ALL SELECT id, unnest(tags), 2.0 FROM docs),
wanted AS (SELECT query_id, unnest(terms) AS asked FROM asked),
tf AS (SELECT id, asked, sum(w) AS tf FROM terms WHERE asked IN (SELECT asked FROM wanted) GROUP BY id, asked),
df AS (SELECT asked, count(*) AS df FROM tf GROUP BY asked),
parts AS (SELECT id, asked, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS part FROM tf JOIN df USING (asked) JOIN lengths USING (id), stats),
scored AS (SELECT query_id, id, sum(part) AS score FROM parts JOIN wanted USING (asked) GROUP BY query_id, id),
bm25 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored)"""


def bm25_of(spark: SparkSession, d: str, k: int) -> DataFrame:
    docs = memories(spark, d).select("id", X.tokens(F.col("content")).alias("words"), "tags")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), X.search_terms(F.col("text")).alias("terms"))
    found = retrieval.bm25(retrieval.postings(docs, {"words": 1.0, "tags": 2.0}), asked, 2 * k)
    return by_nine_digits(found, k)


def by_nine_digits(found: DataFrame, k: int) -> DataFrame:
    """The k best again: sums of doubles differ in their last digits by order, so ranks go by nine digits."""
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return rows, rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding", "label")


COSINE = """cosines AS (
  SELECT q.vec_id AS query_id, r.vec_id AS id, q.label AS ql, r.label AS rl, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS cosine
  FROM embeddings q JOIN embeddings r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)"""


def statuses(spark: SparkSession, d: str) -> DataFrame:
    """orders as rows of an exclusive relation."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("subj"), F.col("o_orderstatus").alias("value"), seconds("o_orderdate").alias("valid_from"), F.col("o_orderkey").alias("seq"))


STATUSES = """rows AS (SELECT o_custkey AS subj, o_orderstatus AS value, epoch(o_orderdate)::BIGINT AS valid_from, o_orderkey AS seq FROM orders),
wins AS (SELECT *, first_value(seq) OVER s AS wseq, first_value(value) OVER s AS wvalue FROM rows WINDOW s AS (PARTITION BY subj, valid_from ORDER BY seq DESC)),
kept AS (SELECT *, coalesce((lag(value) OVER (PARTITION BY subj ORDER BY valid_from, seq) <> value)::INTEGER, 1) AS fresh FROM wins WHERE value = wvalue),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY subj ORDER BY valid_from, seq ROWS UNBOUNDED PRECEDING) AS run FROM kept),
runs AS (SELECT subj, value, run, min(valid_from) AS valid_from, min(seq) AS seq, count(*) AS evidence FROM numbered GROUP BY subj, value, run),
chain AS (SELECT subj, value, valid_from, lead(valid_from) OVER o AS valid_to, seq, evidence, lead(seq) OVER o AS ended_by, false AS retired FROM runs WINDOW o AS (PARTITION BY subj ORDER BY run)),
timeline AS (SELECT * FROM chain UNION ALL SELECT subj, value, valid_from, valid_from, seq, 1, wseq, true FROM wins WHERE value <> wvalue)"""


def star_edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with nations and parts, customers with nations, nations with regions: one graph over disjoint ids."""
    c, s, n, li = (table(spark, d, t) for t in ("customer", "supplier", "nation", "lineitem"))
    node = lambda base, col: (F.lit(base) + F.col(col)).cast("long")
    rel = (
        c.select(node(10**9, "c_custkey").alias("u"), node(0, "c_nationkey").alias("v"), F.lit(1).cast("long").alias("evidence"))
        .unionByName(s.select(node(2 * 10**9, "s_suppkey").alias("u"), node(0, "s_nationkey").alias("v"), F.lit(1).cast("long").alias("evidence")))
        .unionByName(n.select(node(0, "n_nationkey").alias("u"), node(500, "n_regionkey").alias("v"), F.lit(1).cast("long").alias("evidence")))
        .unionByName(li.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("evidence")).select(node(2 * 10**9, "l_suppkey").alias("u"), node(3 * 10**9, "l_partkey").alias("v"), "evidence"))
    )
    return graph.edges(relations=rel)


EDGES = """rel AS (
  SELECT 1000000000 + c_custkey AS u, c_nationkey::BIGINT AS v, 1 AS evidence FROM customer UNION ALL SELECT 2000000000 + s_suppkey, s_nationkey, 1 FROM supplier
  UNION ALL SELECT n_nationkey, 500 + n_regionkey, 1 FROM nation UNION ALL SELECT 2000000000 + l_suppkey, 3000000000 + l_partkey, count(*) FROM lineitem GROUP BY ALL),
edges AS (SELECT least(u, v) AS u, greatest(u, v) AS v, sum(greatest(ln(1 + evidence), 0.5)) AS weight FROM rel WHERE u <> v GROUP BY ALL)"""


def star_relations(spark: SparkSession, d: str) -> DataFrame:
    """(id, src, dst) of the same graph without parts: customers and suppliers in nations, nations in regions."""
    edges = star_edges(spark, d).where(f"v < 3000000000 AND u < 1000 AND v <> {0}")
    return edges.select((F.col("u") * 10**10 + F.col("v")).alias("id"), F.col("v").alias("src"), F.col("u").alias("dst"))


# ---- text and filters ----------------------------------------------------------------------------


@query(f"""
WITH t AS (SELECT doc_id, {fold_sql("coalesce(text, '')")} AS folded, {tokens_sql("text")} AS words FROM documents)
SELECT doc_id, len(words)::INTEGER AS n_tokens, len(list_distinct(words))::INTEGER AS n_distinct, len(list_filter(words, lambda w: list_contains({STOP}, w)))::INTEGER AS n_stop, md5(folded) AS folded_md5 FROM t""")
def text_fold_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Folding and words of every text."""
    words = table(spark, d, "documents").select("doc_id", X.fold(F.coalesce("text", F.lit(""))).alias("folded"), X.tokens(F.col("text")).alias("words"))
    return words.select("doc_id", F.size("words").alias("n_tokens"), F.size(F.array_distinct("words")).alias("n_distinct"), F.size(F.filter("words", lambda w: w.isin(*X.STOPWORDS))).alias("n_stop"), F.md5("folded").alias("folded_md5"))


@query(f"""
WITH t AS (SELECT doc_id, md5(concat(lang, '|', {fold_sql("coalesce(text, '')")})) AS key FROM documents)
SELECT key, count(*) AS n, min(doc_id) AS kept FROM t GROUP BY key""")
def content_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Exact duplicates by kind and folded content: the first stays."""
    key = F.md5(F.concat("lang", F.lit("|"), X.fold(F.coalesce("text", F.lit("")))))
    return table(spark, d, "documents").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("kept"))


@query(f"""WITH t AS (SELECT doc_id, hex(encode('note' || chr(0) || {fold_sql("coalesce(text, '')")})) AS x FROM documents)
SELECT doc_id, lower(lpad(to_hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616::HUGEINT)::UBIGINT), 16, '0')) AS content_hash FROM t""")
def content_hash_fnv(spark: SparkSession, d: str) -> DataFrame:
    """The stored content hash (FNV-1a) of every text."""
    return table(spark, d, "documents").select("doc_id", X.vectorised(X.content_hash)(F.lit("note"), F.coalesce("text", F.lit(""))).alias("content_hash"))


@query(f"""
WITH {MEMORIES}
SELECT id, valid_from, valid_to FROM memories
WHERE expired_at IS NULL AND valid_from <= {EPOCH + 200 * DAY} AND (valid_to IS NULL OR {EPOCH + 200 * DAY} < valid_to)
  AND list_has_any(tags, ['de', 'fr']) AND scope IN ('src1', 'src2', 'src3', 'src4') AND valid_from < {EPOCH + 180 * DAY} AND (valid_to IS NULL OR valid_to > {EPOCH + 20 * DAY})""")
def tag_kind_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """Eligible memories as of a day, by tag, scope and overlap."""
    as_of = EPOCH + 200 * DAY
    fits = validity.eligible(as_of=as_of, kinds=("note",), tags=("DE", "fr"), since=EPOCH + 20 * DAY, until=EPOCH + 180 * DAY)
    return memories(spark, d).where(fits & F.col("scope").isin("src1", "src2", "src3", "src4")).select("id", "valid_from", "valid_to")


# ---- search --------------------------------------------------------------------------------------


@query(f"WITH {BM25} SELECT query_id, id, rank::INTEGER AS rank, round(score, 5) AS score FROM bm25 WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best memories for each benchmark text, words as they are, tags counting double."""
    return bm25_of(spark, d, 10).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


@query()
def bm25_topk_porter(spark: SparkSession, d: str) -> DataFrame:
    """The same over Porter stems, with prefixes of four letters or more."""
    docs = memories(spark, d).select("id", retrieval.text_stems(F.col("content")).alias("words"), "tags")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), retrieval.stemmed(X.search_terms(F.col("text"))).alias("terms"))
    found = retrieval.bm25(retrieval.postings(docs, {"words": 1.0, "tags": 2.0}), asked, 20, prefix_min=4)
    return by_nine_digits(found, 10).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


@query(f"WITH {COSINE}, r AS (SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM cosines) SELECT query_id, id, rank::INTEGER AS rank, round(cosine, 5) AS cosine FROM r WHERE rank <= 10")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors by cosine, exactly."""
    rows, asking = vectors(spark, d)
    return retrieval.knn(rows, asking, 10).select("query_id", "id", "rank", F.round("cosine", 5).alias("cosine"))


@query(f"WITH {COSINE}, r AS (SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM cosines WHERE rl <> 0) SELECT query_id, id, rank::INTEGER AS rank, round(cosine, 5) AS cosine FROM r WHERE rank <= 10")
def knn_live_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same among live rows only (label 0 stands for expired): the filter comes before the ranking."""
    rows, asking = vectors(spark, d)
    return retrieval.knn(rows.where("label <> 0"), asking, 10).select("query_id", "id", "rank", F.round("cosine", 5).alias("cosine"))


@query(f"WITH {COSINE}, r AS (SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM cosines) SELECT query_id, id, round(cosine, 5) AS cosine FROM r WHERE rank = 1 AND cosine >= 0.37")
def near_duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vector of each query, where it is near enough to report."""
    rows, asking = vectors(spark, d)
    return retrieval.near_duplicates(rows, asking, 0.37).select("query_id", "id", F.round("cosine", 5).alias("cosine"))


@query(f"WITH {COSINE}, r AS (SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM cosines) SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, round(max(cosine), 5) AS score FROM r WHERE rank <= 3 AND cosine >= 0.35 GROUP BY 1, 2")
def similar_edges_top3(spark: SparkSession, d: str) -> DataFrame:
    """Synonym edges: up to three near vectors each, smaller id first."""
    rows, asking = vectors(spark, d)
    near = retrieval.knn(rows, asking, 3).where("cosine >= 0.35")
    return near.groupBy(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).agg(F.round(F.max("cosine"), 5).alias("score"))


def channels(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists a query: words, and newness among what words found."""
    found = bm25_of(spark, d, 50).select("query_id", "id", "rank")
    newest = found.join(memories(spark, d).select("id", "valid_from"), "id")
    order = W.partitionBy("query_id").orderBy(F.col("valid_from").desc(), "id")
    newest = newest.withColumn("rank", F.row_number().over(order)).where("rank <= 20")
    return found.withColumn("channel", F.lit("bm25")).unionByName(newest.select("query_id", "id", "rank").withColumn("channel", F.lit("time")))


FUSED = f"""{BM25}, found AS (SELECT query_id, id, rank FROM bm25 WHERE rank <= 50),
newest AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY valid_from DESC, id) AS rank FROM found JOIN memories USING (id)),
channels AS (SELECT *, 1.0 AS w FROM found UNION ALL SELECT *, 1.0 FROM newest WHERE rank <= 20),
fused AS (SELECT query_id, id, sum(w / (5 + rank)) * (1 + 0.05 * (count(*) - 1)) AS score, min(rank) AS best_rank, count(*) AS channels FROM channels GROUP BY query_id, id)"""


@query(f"WITH {FUSED} SELECT query_id, id, best_rank::INTEGER AS best_rank, channels, round(score, 9) AS score FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Weighted reciprocal ranks of both lists, raised by agreement."""
    fused = ranking.rrf(channels(spark, d), {"bm25": 1.0, "time": 1.0})
    return fused.select("query_id", "id", "best_rank", "channels", F.round("score", 9).alias("score"))


MODIFIED = f"""{FUSED}, modified AS (
  SELECT query_id, id, importance, content, score * CASE WHEN coalesce(valid_to <= {NOW}, false) OR expired_at IS NOT NULL THEN 0.35 ELSE 1 END
    * CASE WHEN valid_from >= {EPOCH} AND valid_from < {EPOCH + 100 * DAY} THEN 1.25 ELSE 1 END
    * (0.9 + 0.1 * pow(2.0, -greatest({NOW} - valid_from, 0) / {DAY}.0 / 90)) * (0.9 + 0.2 * importance) AS score
  FROM fused JOIN memories USING (id) WHERE NOT (expired_at IS NOT NULL AND superseded_by IS NULL)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM modified)"""


@query(f"WITH {MODIFIED} SELECT query_id, id, rank::INTEGER AS rank, round(score, 9) AS score FROM ranked WHERE rank <= 8")
def recall_lite(spark: SparkSession, d: str) -> DataFrame:
    """Recall of benchmark texts end to end: two channels, fusion, modifiers, the eight best."""
    return _modified(spark, d).where("rank <= 8").select("query_id", "id", "rank", F.round("score", 9).alias("score"))


def _modified(spark: SparkSession, d: str) -> DataFrame:
    fused = ranking.rrf(channels(spark, d), {"bm25": 1.0, "time": 1.0})
    rows = fused.join(memories(spark, d).drop("tags", "kind", "scope"), "id").where(~validity.forgotten())
    window = F.col("valid_from").between(EPOCH, EPOCH + 100 * DAY - 1)
    score = ranking.modified(F.col("score"), validity.ended(NOW), window, F.lit(NOW) - F.col("valid_from"), F.col("importance"))
    rows = rows.withColumn("score", score)
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order))


@query("""SELECT o_orderkey AS id, round(o_totalprice / 1000 * CASE WHEN o_orderstatus = 'F' THEN 0.35 ELSE 1 END * CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 1.25 ELSE 1 END
  * (0.9 + 0.1 * pow(2.0, -greatest(epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate), 0) / 86400.0 / 90)) * (0.9 + 0.2 * CASE WHEN o_orderpriority LIKE '1%' THEN 1.0 ELSE 0.5 END), 9) AS score FROM orders""")
def score_modifiers(spark: SparkSession, d: str) -> DataFrame:
    """End, window, recency and importance factors on orders."""
    when = F.col("o_orderdate")
    window = (when >= "1996-01-01") & (when < "1997-01-01")
    importance = F.when(F.col("o_orderpriority").startswith("1"), 1.0).otherwise(0.5)
    age = F.lit(946_684_800) - seconds("o_orderdate")
    score = ranking.modified(F.col("o_totalprice") / 1000, F.col("o_orderstatus") == "F", window, age, importance)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(score, 9).alias("score"))


@query(f"""WITH RECURSIVE {MODIFIED}, costed AS (SELECT query_id, rank, id, ceil((strlen(content) + 12) / 4.0)::BIGINT AS cost FROM ranked WHERE rank <= 50),
walk AS (
  SELECT query_id, rank, id, cost, cost AS used, true AS kept FROM costed WHERE rank = 1
  UNION ALL SELECT c.query_id, c.rank, c.id, c.cost, w.used + CASE WHEN w.used + c.cost <= 1200 THEN c.cost ELSE 0 END, w.used + c.cost <= 1200 FROM walk w JOIN costed c ON c.query_id = w.query_id AND c.rank = w.rank + 1)
SELECT query_id, id, cost FROM walk WHERE kept""")
def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    """What of each query's fifty best fits into a budget of 1200, whole items, the first always."""
    return ranking.packed(_modified(spark, d).where("rank <= 50").withColumn("cost", X.cost(F.col("content"))), 1200)


@query()
def mmr_diversify(spark: SparkSession, d: str) -> DataFrame:
    """Eight of each query's 24 nearest, relevance against likeness to those before."""
    rows, asking = vectors(spark, d)
    near = retrieval.knn(rows, asking, 24).join(rows.select("id", "embedding"), "id").withColumnRenamed("cosine", "score")
    return ranking.diversified(near, 8)


# ---- time ----------------------------------------------------------------------------------------


@query(f"WITH {STATUSES} SELECT subj, value, valid_from, valid_to, evidence FROM timeline WHERE NOT retired AND valid_from <= 883612800 AND (valid_to IS NULL OR 883612800 < valid_to)")
def as_of_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's status as of 1998-01-01."""
    return timeline.exclusive(statuses(spark, d), ["subj"], "value").where(~F.col("retired") & validity.valid_at(883_612_800)).select("subj", "value", "valid_from", "valid_to", "evidence")


@query(f"""WITH {STATUSES}, windows AS (SELECT DISTINCT epoch(date_trunc('month', o_orderdate))::BIGINT AS start, epoch(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::BIGINT AS "end" FROM orders)
SELECT start, "end", (SELECT count(*) FROM timeline WHERE NOT retired AND valid_from < windows."end" AND (valid_to IS NULL OR valid_to > start)) AS n FROM windows""")
def interval_overlap_window(spark: SparkSession, d: str) -> DataFrame:
    """How many statuses held at some time in each month."""
    month = F.date_trunc("month", "o_orderdate")
    windows = table(spark, d, "orders").select(month.alias("m")).distinct().select(F.unix_timestamp("m").alias("start"), F.unix_timestamp(F.add_months("m", 1).cast("timestamp")).alias("end"))
    return timeline.overlap_counts(timeline.exclusive(statuses(spark, d), ["subj"], "value").where("NOT retired"), windows)


@query(f"WITH {STATUSES} SELECT subj, value, valid_from, valid_to, seq, evidence, ended_by, retired FROM timeline")
def exclusive_timeline(spark: SparkSession, d: str) -> DataFrame:
    """One status a customer at a time: what ends what."""
    return timeline.exclusive(statuses(spark, d), ["subj"], "value")


@query("""WITH rows AS (SELECT event_id, user_id, event_type, (value >= 20)::INTEGER AS polarity, epoch_us(ts) AS valid_from FROM events),
ends AS (SELECT *, first_value(CASE WHEN polarity = 0 THEN valid_from END IGNORE NULLS) OVER w AS z, first_value(CASE WHEN polarity = 1 THEN valid_from END IGNORE NULLS) OVER w AS o FROM rows
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY valid_from, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, polarity, valid_from, CASE WHEN polarity = 1 THEN z ELSE o END AS valid_to, coalesce(CASE WHEN polarity = 1 THEN z ELSE o END = valid_from, false) AS retired FROM ends""")
def polarity_flip(spark: SparkSession, d: str) -> DataFrame:
    """A small value denies what a large one says, and the other way round."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.col("value") >= 20).cast("int").alias("polarity"), F.unix_micros(F.col("ts").cast("timestamp")).alias("valid_from"), F.col("event_id").alias("seq"))
    return timeline.polarity(rows, ["user_id", "event_type"]).select("event_id", "polarity", "valid_from", "valid_to", "retired")


@query("""SELECT l_orderkey AS memory_id, max(epoch(l_shipdate))::BIGINT AS valid_to FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag <> 'N')""")
def evidence_end_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines have all ended end with the last of them."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.when(F.col("l_returnflag") != "N", seconds("l_shipdate")).alias("valid_to"))
    return timeline.ended_evidence(lines)


@query("""SELECT conv_id, turn, role, lead(turn) OVER w AS superseded_by, lead(turn * 60) OVER w AS valid_to, lead(turn) OVER w IS NULL AS live FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)""")
def supersede_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each turn replaces the one before of its role."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("turn").alias("id"), F.col("turn").alias("seq"), (F.col("turn") * 60).alias("valid_from"))
    return timeline.superseded(rows, ["conv_id", "role"]).select("conv_id", "turn", "role", "superseded_by", "valid_to", "live")


@query(f"""WITH rows AS (SELECT l_suppkey AS supp, epoch(l_shipdate)::BIGINT AS valid_from, epoch(l_shipdate)::BIGINT + 30 * {DAY} AS valid_to FROM lineitem),
marked AS (SELECT *, coalesce((valid_from > max(valid_to) OVER (PARTITION BY supp ORDER BY valid_from, valid_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INTEGER, 1) AS fresh FROM rows),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY supp ORDER BY valid_from, valid_to ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT supp, min(valid_from) AS valid_from, max(valid_to) AS valid_to, count(*) AS evidence FROM numbered GROUP BY supp, island""")
def relation_merge_islands(spark: SparkSession, d: str) -> DataFrame:
    """Touching intervals of a supplier's deliveries, merged."""
    start = seconds("l_shipdate")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supp"), start.alias("valid_from"), (start + 30 * DAY).alias("valid_to"), F.lit(1).cast("long").alias("evidence"))
    return timeline.islands(rows, ["supp"])


@query("""WITH days AS (SELECT event_type, epoch(date_trunc('week', ts))::BIGINT AS start, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL)
SELECT event_type, start, n, row_number() OVER (PARTITION BY event_type ORDER BY round(v, 6) DESC, start)::INTEGER AS rank FROM days""")
def temporal_window_channel(spark: SparkSession, d: str) -> DataFrame:
    """Weeks of each event type by what happened in them."""
    week = F.unix_timestamp(F.date_trunc("week", F.col("ts").cast("timestamp")))
    days = table(spark, d, "events").groupBy("event_type", week.alias("start")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return days.select("event_type", "start", "n", F.row_number().over(W.partitionBy("event_type").orderBy(F.round("v", 6).desc(), "start")).alias("rank"))


# ---- names ---------------------------------------------------------------------------------------

ALIASES = f"""aliases AS (
  SELECT n_nationkey AS entity_id, {fold_sql("n_name")} AS alias FROM nation UNION ALL SELECT 500 + r_regionkey, {fold_sql("r_name")} FROM region
  UNION ALL SELECT 1000 + p_partkey, {fold_sql("p_name")} FROM part
  UNION ALL SELECT 1000000 + item_id, array_to_string(list_slice({tokens_sql("text")}, 1, 3), ' ') FROM benchmark),
own AS (SELECT alias, min(entity_id) AS entity_id FROM aliases WHERE length(alias) >= 3 GROUP BY alias HAVING count(DISTINCT entity_id) = 1)"""


@query(f"""WITH {ALIASES}, words AS (SELECT doc_id, {tokens_sql("text")} AS w FROM documents), places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words),
runs AS (SELECT doc_id, array_to_string(w[p : p + k - 1], ' ') AS alias FROM places, (VALUES (1), (2), (3), (4)) AS v(k) WHERE p + k - 1 <= len(w))
SELECT DISTINCT doc_id AS id, entity_id FROM runs JOIN own USING (alias)""")
def entity_alias_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold an alias which names exactly one entity: nations, regions, parts, and the first words of benchmark texts."""
    name = lambda t, key, col, base: table(spark, d, t).select((F.lit(base) + F.col(key)).cast("long").alias("entity_id"), X.fold(F.col(col)).alias("alias"))
    passages = table(spark, d, "benchmark").select((F.lit(1_000_000) + F.col("item_id")).alias("entity_id"), F.array_join(F.slice(X.tokens(F.col("text")), 1, 3), " ").alias("alias"))
    aliases = name("nation", "n_nationkey", "n_name", 0).unionByName(name("region", "r_regionkey", "r_name", 500)).unionByName(name("part", "p_partkey", "p_name", 1000)).unionByName(passages)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.tokens(F.col("text")).alias("words"))
    return resolve.gazetteer(docs, aliases)


@query("""WITH names AS (SELECT DISTINCT p_name AS name FROM part WHERE length(p_name) >= 5)
SELECT a.name AS a, b.name AS b, round(jaro_winkler_similarity(a.name, b.name), 5) AS score FROM names a JOIN names b ON a.name < b.name AND a.name[1:3] = b.name[1:3]
WHERE regexp_replace(a.name, '[^0-9]', '', 'g') = regexp_replace(b.name, '[^0-9]', '', 'g') AND jaro_winkler_similarity(a.name, b.name) >= 0.88""")
def entity_lexical_match(spark: SparkSession, d: str) -> DataFrame:
    """Part names that nearly spell the same."""
    return resolve.lexical_pairs(table(spark, d, "part").select(F.col("p_name").alias("name")), 0.88).withColumn("score", F.round("score", 5))


@query("""WITH w AS (SELECT p_partkey, list_filter(string_split(trim(p_name), ' '), lambda x: x <> '') AS parts FROM part)
SELECT p_partkey, CASE WHEN len(parts) >= 2 THEN nullif(array_to_string(list_transform(list_filter(parts, lambda x: lower(x) NOT IN ('of', 'and', 'the')), lambda x: upper(regexp_extract(x, '[\\p{L}\\p{N}]'))), ''), '') END AS acronym FROM w""")
def acronym_match(spark: SparkSession, d: str) -> DataFrame:
    """Initials of part names."""
    return table(spark, d, "part").select("p_partkey", X.acronym(F.col("p_name")).alias("acronym"))


@query("SELECT o_custkey AS entity_id, count(*) AS mentions, 1.0::DOUBLE / count(*) AS weight FROM orders GROUP BY o_custkey")
def mention_specificity(spark: SparkSession, d: str) -> DataFrame:
    """Customers mentioned seldom say more."""
    return resolve.specificity(table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id")))


@query("""WITH m AS (SELECT o_custkey AS cust, l_orderkey AS id, count(DISTINCT l_partkey) AS n, any_value(o_totalprice) AS importance, any_value(epoch(o_orderdate)::BIGINT) AS valid_from FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY n DESC, importance DESC, valid_from DESC, id) AS k FROM m) SELECT cust, id, n FROM r WHERE k = 1""")
def community_representative(spark: SparkSession, d: str) -> DataFrame:
    """The order of each customer that mentions most parts."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("importance"), seconds("o_orderdate").alias("valid_from"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("entity_id")).join(orders.select("id", "cust"), "id")
    return resolve.representative(lines, orders, "cust")


# ---- graph ---------------------------------------------------------------------------------------


@query(f"WITH {EDGES} SELECT u, v, round(weight, 5) AS weight FROM edges")
def graph_edges_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Edges and weights of the star schema as a graph."""
    return star_edges(spark, d).withColumn("weight", F.round("weight", 5))


def _ppr_sql(steps: int) -> str:
    sql = f"""WITH {EDGES}, directed AS (SELECT u, v, weight FROM edges UNION ALL SELECT v, u, weight FROM edges),
walk AS (SELECT u, v, weight / sum(weight) OVER (PARTITION BY u) AS share FROM directed), s AS (SELECT 500 + r_regionkey AS query_id, 500 + r_regionkey AS node, 1.0::DOUBLE AS score FROM region), p0 AS (SELECT * FROM s)"""
    for k in range(1, steps + 1):
        sql += f""",
p{k} AS (SELECT query_id, node, sum(score) AS score FROM (SELECT query_id, node, 0.5 * score AS score FROM s UNION ALL SELECT query_id, v, 0.5 * score * share FROM p{k - 1} JOIN walk ON node = u) GROUP BY query_id, node)"""
    return sql + f"\nSELECT query_id::BIGINT AS query_id, node::BIGINT AS node, round(score, 7) AS score FROM p{steps}"


@query(_ppr_sql(3))
def ppr_power_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Three steps of personalised PageRank from each region, all at once."""
    region = (F.lit(500) + F.col("r_regionkey")).cast("long")
    seeds = table(spark, d, "region").select(region.alias("query_id"), region.alias("node"), F.lit(1.0).alias("mass"))
    return graph.ppr_power(star_edges(spark, d), seeds, 0.5, 3).withColumn("score", F.round("score", 7))


@query()
def ppr_push_csr(spark: SparkSession, d: str) -> DataFrame:
    """Personalised PageRank by pushing, over nations and regions (a fixed number of rows), from each region."""
    rows = star_relations(spark, d).where("src < 1000").select("src", "dst").collect()
    snap = graph.Snapshot((r.src, r.dst, 1.0) for r in rows)
    out = [(r, n, round(p, 7)) for r in sorted({x.src for x in rows} | {x.dst for x in rows}) if r >= 500 for n, p in snap.push({r: 1.0}).items()]
    return spark.createDataFrame(out, "query_id long, node long, score double")


@query()
def communities_overview(spark: SparkSession, d: str) -> DataFrame:
    """Communities of nations, regions and market segments (a fixed number of nodes), by how many customers they hold."""
    c = table(spark, d, "customer")
    seg = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).collect()  # nations x segments
    names = {s: 10_000 + k for k, s in enumerate(sorted({r.c_mktsegment for r in seg}))}
    links = [(r.c_nationkey, names[r.c_mktsegment], float(r.n)) for r in seg] + [(r.src, r.dst, 1.0) for r in star_relations(spark, d).where("src < 1000").collect()]
    home = graph.louvain(links)
    size = {}
    for r in seg:
        size[home[r.c_nationkey]] = size.get(home[r.c_nationkey], 0) + r.n
    return spark.createDataFrame([(n, h, size.get(h, 0)) for n, h in sorted(home.items())], "node long, community long, customers long")


RELATIONS = f"""{EDGES}, r AS (SELECT u * 10000000000 + v AS id, v AS src, u AS dst FROM edges WHERE v < 3000000000 AND u < 1000 AND v <> 0),
sides AS (SELECT src AS entity, false AS reverse, dst AS other, id FROM r WHERE src <> dst UNION ALL SELECT dst, true, src, id FROM r WHERE src <> dst)"""


def _follow_sql() -> str:
    step = lambda k, seen, reached: f""",
t{k} AS (SELECT f.query_id, s.id, min(struct_pack(entity := s.entity, reverse := s.reverse, other := s.other)) AS x FROM f{k - 1} f JOIN sides s USING (entity) WHERE NOT EXISTS (SELECT 1 FROM ({seen}) q WHERE q.query_id = f.query_id AND q.id = s.id) GROUP BY f.query_id, s.id),
f{k} AS (SELECT DISTINCT query_id, x.other AS entity FROM t{k} WHERE NOT EXISTS (SELECT 1 FROM ({reached}) q WHERE q.query_id = t{k}.query_id AND q.entity = t{k}.x.other))"""  # noqa: E731
    sql = f"WITH {RELATIONS}, f0 AS (SELECT 500 + r_regionkey AS query_id, (500 + r_regionkey)::BIGINT AS entity FROM region)"
    seen, reached = ["SELECT NULL::BIGINT AS query_id, NULL::BIGINT AS id"], ["SELECT query_id, entity FROM f0"]
    for k in (1, 2, 3):
        sql += step(k, " UNION ALL ".join(seen), " UNION ALL ".join(reached))
        seen.append(f"SELECT query_id, id FROM t{k}")
        reached.append(f"SELECT query_id, entity FROM f{k}")
    return sql + "\n" + " UNION ALL ".join(f"SELECT query_id::BIGINT AS query_id, id, {k} AS hops, CASE WHEN x.reverse THEN 'in' ELSE 'out' END AS direction FROM t{k}" for k in (1, 2, 3))


@query(_follow_sql())
def follow_depth3(spark: SparkSession, d: str) -> DataFrame:
    """All relations within three hops of each region."""
    region = (F.lit(500) + F.col("r_regionkey")).cast("long")
    return paths.follow(star_relations(spark, d), table(spark, d, "region").select(region.alias("query_id"), region.alias("entity")), 3)


@query("""SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus <> 'P') AS ends, count(*) FILTER (WHERE o_orderstatus <> 'P') AS facts, count(*) FILTER (WHERE o_orderstatus = 'P') AS negatives FROM orders GROUP BY o_custkey""")
def aggregate_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Distinct priorities of each customer's orders, pending ones counted apart."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority", (F.col("o_orderstatus") != "P").cast("int").alias("polarity"))
    return paths.aggregate(rows, "o_custkey", "o_orderpriority")


@query()
def path_lexical_beam(spark: SparkSession, d: str) -> DataFrame:
    """Chains from each region by the words of a question about suppliers in nations."""
    rel = star_relations(spark, d).withColumn("words", F.when(F.col("src") >= 2 * 10**9, F.array(F.lit("supplier"), F.lit("live"))).when(F.col("src") >= 10**9, F.array(F.lit("customer"), F.lit("live"))).otherwise(F.array(F.lit("nation"), F.lit("region"))))
    terms = F.array(*[F.array(*map(F.lit, t)) for t in paths.query_terms("which suppliers of a nation")])
    region = (F.lit(500) + F.col("r_regionkey")).cast("long")
    asked = table(spark, d, "region").select(region.alias("query_id"), region.alias("entity"), terms.alias("terms"))
    return paths.lexical_beam(rel, asked).select("query_id", "position", "coverage", F.round("score", 6).alias("score"), "end")


@query(f"WITH {STATUSES} SELECT subj, count(*) AS facts, count(*) FILTER (WHERE valid_to IS NULL) AS current FROM timeline WHERE NOT retired GROUP BY subj HAVING count(*) >= 2")
def facts_current_values(spark: SparkSession, d: str) -> DataFrame:
    """Customers with two facts or more, and how many of them still hold."""
    rows = timeline.exclusive(statuses(spark, d), ["subj"], "value").where("NOT retired")
    return rows.groupBy("subj").agg(F.count("*").alias("facts"), F.count_if(F.col("valid_to").isNull()).alias("current")).where("facts >= 2")


# ---- upkeep --------------------------------------------------------------------------------------


@query("""SELECT 'order without customer' AS "check", count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'line without part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'line without supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'document without label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def validate_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Rows that point nowhere."""
    t = lambda n: table(spark, d, n)
    return maintenance.dangling({
        "order without customer": (t("orders"), "o_custkey", t("customer"), "c_custkey"), "line without order": (t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        "line without part": (t("lineitem"), "l_partkey", t("part"), "p_partkey"), "line without supplier": (t("lineitem"), "l_suppkey", t("supplier"), "s_suppkey"),
        "label without document": (t("labels"), "doc_id", t("documents"), "doc_id"), "document without label": (t("documents"), "doc_id", t("labels"), "doc_id"),
    })


_COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("\nUNION ALL ".join(f"SELECT '{t}' AS metric, count(*) AS n FROM {t}" for t in _COUNTED))
def stats_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every table."""
    return maintenance.counts({t: table(spark, d, t) for t in _COUNTED})


@query(f"""WITH {COSINE}, r AS (SELECT query_id, id, ql, rl, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM cosines),
expected AS (SELECT query_id, id, rank FROM r WHERE ql = rl)
SELECT query_id, round(avg((rank <= 8)::INTEGER), 9) AS recall, round(coalesce(max(CASE WHEN rank <= 8 THEN 1.0 / rank END), 0)::DOUBLE, 9) AS rr FROM expected GROUP BY query_id""")
def eval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Recall and reciprocal rank of the eight nearest, those of the query's label being right."""
    rows, asking = vectors(spark, d)
    results = retrieval.knn(rows, asking, 8)
    expected = asking.select("query_id", F.col("label").alias("l")).join(rows.select("id", "label"), F.col("l") == F.col("label")).where("id <> query_id").select("query_id", "id")
    return evaluation.metrics(results, expected, 8).select("query_id", F.round("recall", 9).alias("recall"), F.round("rr", 9).alias("rr"))


@query("""WITH l AS (SELECT l_orderkey, '[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || ',"l_suppkey":' || l_suppkey || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || ']' AS lines FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, '{"id":"m' || o_orderkey || '","kind":"' || o_orderstatus || '","valid_from":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"' || coalesce(',"lines":' || lines, '') || '}' AS record FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def export_records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as export records: one JSON line each, with their lines inside."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    when = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select("o_orderkey", F.to_json(F.struct(F.concat(F.lit("m"), "o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), when.alias("valid_from"), "lines")).alias("record"))


# ---- operators one by one ------------------------------------------------------------------------


@query(f"""WITH {STATUSES}, shown AS (
  SELECT seq, valid_from <= 883612800 AND (valid_to IS NULL OR 883612800 < valid_to) AND NOT retired AS now, valid_from <= 883612800 AS ever,
    valid_from <= 852076800 AND (valid_to IS NULL OR 852076800 < valid_to) AS before FROM timeline)
SELECT seq, now, ever, before FROM shown""")
def relation_visibility(spark: SparkSession, d: str) -> DataFrame:
    """Whether each status shows: now and live, ever so far, and as of a year before."""
    rows = timeline.exclusive(statuses(spark, d), ["subj"], "value").withColumn("expired_at", F.when(F.col("retired"), F.lit(NOW)))
    now, before = 883_612_800, 852_076_800
    return rows.select("seq", validity.visible(now).alias("now"), validity.visible(now, history=True).alias("ever"), validity.visible(now, as_of=before).alias("before"))


@query(f"""WITH {MEMORIES}
SELECT id, expired_at IS NULL AS plain, NOT (expired_at IS NOT NULL AND superseded_by IS NULL) AS history,
  expired_at IS NULL AND valid_from <= {EPOCH + 100 * DAY} AND (valid_to IS NULL OR {EPOCH + 100 * DAY} < valid_to) AS then,
  coalesce(valid_to <= {NOW}, false) OR expired_at IS NOT NULL AS ended FROM memories""")
def eligibility_modes(spark: SparkSession, d: str) -> DataFrame:
    """Which memories may be returned plainly, with history, and as of a day; and which have ended."""
    return memories(spark, d).select("id", validity.eligible().alias("plain"), validity.eligible(history=True).alias("history"), validity.eligible(as_of=EPOCH + 100 * DAY).alias("then"), validity.ended(NOW).alias("ended"))


@query("""SELECT o_orderkey AS id, round(o_totalprice / 1000 * CASE WHEN o_orderstatus = 'F' THEN 1.5 ELSE 1 END
  * (0.9 + 0.1 * pow(2.0, -greatest(epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate), 0) / 86400.0 / 90)) * (0.9 + 0.2 * 0.5), 9) AS score FROM orders""")
def score_modifiers_history(spark: SparkSession, d: str) -> DataFrame:
    """The same when the past is asked for: what has ended counts more."""
    score = ranking.modified(F.col("o_totalprice") / 1000, F.col("o_orderstatus") == "F", F.lit(False), F.lit(946_684_800) - seconds("o_orderdate"), F.lit(0.5), history=True)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(score, 9).alias("score"))


@query(f"WITH {STATUSES} SELECT a.seq, a.subj, a.value, b.value AS ended_by FROM timeline a JOIN timeline b ON a.ended_by = b.seq AND a.subj = b.subj AND NOT b.retired")
def ended_by_fact(spark: SparkSession, d: str) -> DataFrame:
    """The fact that ended a fact."""
    rows = timeline.exclusive(statuses(spark, d), ["subj"], "value")
    later = rows.where("NOT retired").select(F.col("seq").alias("ended_by"), "subj", F.col("value").alias("by"))
    return rows.select("seq", "subj", "value", "ended_by").join(later, ["ended_by", "subj"]).select("seq", "subj", "value", F.col("by").alias("ended_by"))


@query("SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS n, min(l_orderkey) AS kept FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_relations(spark: SparkSession, d: str) -> DataFrame:
    """Equal triples, which a merge joins into the first."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_orderkey").alias("id"))
    return maintenance.duplicates(rows, ["src", "dst"])


@query("""WITH m AS (SELECT l_suppkey AS src, 100000 + l_partkey % 50 AS dst, l_orderkey * 10 + l_linenumber AS id FROM lineitem),
moved AS (SELECT CASE WHEN src = 2 THEN 1 ELSE src END AS src, dst, id FROM m)
SELECT src, dst, min(id) AS id, count(*) AS evidence_count FROM moved WHERE src <> dst GROUP BY src, dst""")
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    """Supplier 2 becomes supplier 1: equal triples are joined, loops go."""
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("subj"), F.col("l_suppkey").alias("src"), F.lit(1).cast("long").alias("predicate_id"), (100_000 + F.col("l_partkey") % 50).alias("dst"),
        F.lit(1).alias("polarity"), F.lit(0).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.lit(None).cast("long").alias("expired_at"), F.lit(1).cast("long").alias("evidence_count"),
    )
    mentions = rows.select(F.col("id").alias("memory_id"), F.col("src").alias("entity_id"))
    return maintenance.merge(rows, mentions, 1, 2, NOW)[0].where("expired_at IS NULL").select("src", "dst", "id", "evidence_count")


@query("""WITH gone AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'),
lost AS (SELECT l_partkey AS id FROM lineitem GROUP BY l_partkey HAVING bool_and(l_orderkey IN (SELECT id FROM gone)))
SELECT p_partkey AS id, p_partkey IN (SELECT id FROM lost) AS retracted FROM part""")
def forget_soft(spark: SparkSession, d: str) -> DataFrame:
    """Pending orders are forgotten: parts that only they evidence are retracted."""
    orders = table(spark, d, "orders")
    made = orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("expired_at"), F.lit(None).cast("long").alias("superseded_by"))
    facts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(None).cast("long").alias("expired_at"))
    evidence = table(spark, d, "lineitem").select(F.col("l_partkey").alias("relation_id"), F.col("l_orderkey").alias("memory_id"))
    facts = maintenance.forget(made, facts, evidence, orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")), NOW)[1]
    return facts.select("id", F.col("expired_at").isNotNull().alias("retracted"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN greatest(epoch(o_orderdate)::BIGINT, 852076800) END AS valid_to FROM orders")
def invalidate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders end on a day, none before it starts."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), seconds("o_orderdate").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    ids = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit(852_076_800).cast("long").alias("at"))
    return maintenance.invalidate(rows, ids).select("id", "valid_to")


@query("""WITH d AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders), w AS (SELECT strftime(m, 'what was ordered in %B %Y') AS q, epoch(m)::BIGINT AS a, epoch(m + INTERVAL 1 MONTH)::BIGINT AS z FROM d)
SELECT q, a, z, count(*) AS n FROM w JOIN orders ON epoch(o_orderdate) >= a AND epoch(o_orderdate) < z GROUP BY ALL""")
def find_window_months(spark: SparkSession, d: str) -> DataFrame:
    """The window that a question names, and how many orders lie in it."""
    clock = T.Clock(NOW, 0)

    def window(q: str) -> str | None:
        w = T.find_window(q, clock)
        return f"{w.start},{w.end}" if w else None

    months = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    asked = months.select(F.concat(F.lit("what was ordered in "), F.date_format("m", "MMMM yyyy")).alias("q"), F.unix_timestamp("m").alias("m"), "n")
    spans = asked.select("q", F.split(X.vectorised(window)(F.col("q")), ",").alias("w")).select("q", F.element_at("w", 1).cast("long").alias("a"), F.element_at("w", 2).cast("long").alias("z"))
    # a window of whole months holds the months that start in it
    return spans.join(asked.select("m", "n").withColumnRenamed("m", "a"), "a").select("q", "a", "z", "n")


@query("SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS day, epoch(date_trunc('day', o_orderdate))::BIGINT AS phrase FROM orders")
def parse_instants(spark: SparkSession, d: str) -> DataFrame:
    """Instants from ISO times and from dates in words; each distinct text is read once."""
    clock = T.Clock(NOW, 0)
    instant = X.vectorised(lambda s: T.parse_instant(s, clock), "long")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.date_format("o_orderdate", "MMMM d, yyyy").alias("said"))
    iso, said = rows.select("iso").distinct().select("iso", instant("iso").alias("day")), rows.select("said").distinct().select("said", instant("said").alias("phrase"))
    return rows.join(iso, "iso").join(said, "said").select("id", "day", "phrase")


@query(f"""WITH t AS (SELECT conv_id, turn, {fold_sql("coalesce(text, '')")} AS f FROM conversations)
SELECT conv_id, turn, contains(f, 'no longer') OR list_has_any(string_split(f, ' '), [{", ".join(f"'{w}'" for w in sorted(paths.NEGATION_WORDS))}]) AS negated FROM t""")
def negation_intent(spark: SparkSession, d: str) -> DataFrame:
    """Turns that deny something."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.vectorised(paths.negated, "boolean")(F.coalesce("text", F.lit(""))).alias("negated"))


@query("""WITH n AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part),
grams AS (SELECT a, b, list_distinct(list_transform(range(1, length(a) + 3), lambda k: ('  ' || a || '  ')[k : k + 2])) AS x, list_distinct(list_transform(range(1, length(b) + 3), lambda k: ('  ' || b || '  ')[k : k + 2])) AS y FROM n)
SELECT a, b, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 9) AS score FROM grams""")
def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Shared trigrams of part names and types."""
    score = X.vectorised(X.trigram_jaccard, "double")
    return table(spark, d, "part").select(F.col("p_name").alias("a"), F.col("p_type").alias("b")).distinct().select("a", "b", F.round(score("a", "b"), 9).alias("score"))


@query(f"""WITH w AS (SELECT DISTINCT p_type AS name, string_split({fold_sql("p_type")}, ' ') AS w FROM part) SELECT name, array_to_string(CASE WHEN w[1] IN ('a', 'an', 'the') THEN w[2:] ELSE w END, ' ') AS norm FROM w""")
def norm_names(spark: SparkSession, d: str) -> DataFrame:
    """Keys of names (these types have no plurals)."""
    return table(spark, d, "part").select(F.col("p_type").alias("name")).distinct().select("name", X.vectorised(X.norm_name)("name").alias("norm"))


@query("""SELECT o_custkey, o_orderkey AS id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate) DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def newest_each(spark: SparkSession, d: str) -> DataFrame:
    """The three newest orders of each customer."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), seconds("o_orderdate").alias("score"))
    return retrieval.top(rows, 3).select(F.col("query_id").alias("o_custkey"), "id", "rank")


@query("""WITH g AS (SELECT l_suppkey AS supp, epoch(max(l_shipdate))::BIGINT AS valid_to, bool_and(l_returnflag <> 'N') AS gone FROM lineitem GROUP BY l_suppkey, l_partkey),
c AS (SELECT supp, count(*) AS n FROM g WHERE NOT gone GROUP BY supp HAVING count(*) > 1) SELECT supp, n FROM c""")
def exclusive_violators(spark: SparkSession, d: str) -> DataFrame:
    """Subjects that hold several live values of what should be one."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("value")).agg(F.when(F.bool_and(F.col("l_returnflag") != "N"), F.max(seconds("l_shipdate"))).alias("valid_to"))
    return maintenance.duplicates(lines.where("valid_to IS NULL").withColumn("id", F.col("value")), ["supp"]).select("supp", "n")
