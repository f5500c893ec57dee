"""The registry of queries over the common tables, each with SQL that states the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import grouped, text
from siftlake.operators import measure, select
from siftlake.plans import loop
from siftlake.plans import signal as sig
from siftlake.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _scratch_uri(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/siftlake-table-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{path}/table"


def _table(df: DataFrame, key: str) -> table.Dataset:
    return table.create(df, _scratch_uri(df.sparkSession), key)


def _documents(spark: SparkSession, sf_dir: str) -> table.Dataset:
    return _table(read(spark, sf_dir, "documents"), "doc_id")


def _row(spark: SparkSession, kinds: str, *values) -> DataFrame:
    return spark.createDataFrame([values], kinds)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = r"len(regexp_extract_all(text, '[^\t\n\f\r ]+'))"
_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_UNIT = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
_STEPS = """(SELECT *, abs(value - lag(value) OVER w) AS d1, abs((value - lag(value) OVER w) - (lag(value) OVER w - lag(value, 2) OVER w)) AS d2
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"""SELECT lang, count(*) AS docs, sum(n_words)::BIGINT AS words FROM (
 SELECT lang, {_WORDS} AS n_words, row_number() OVER (PARTITION BY md5({_CLEAN}) ORDER BY doc_id) > 1 AS is_dup FROM documents)
 WHERE n_words >= 50 AND NOT is_dup GROUP BY lang""")
def curated_by_lang(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("n_words", text.length(F.col("text")))
    kept = select.exact_dup(docs, "text", "doc_id").where("n_words >= 50 AND NOT is_dup")
    return kept.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"))


@query(f"SELECT doc_id, {_WORDS}::INT AS n_words FROM documents")
def text_length(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.length(F.col("text")).alias("n_words"))


@query("SELECT doc_id, length(text)::INT AS chars, (('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 50)::BIGINT AS part FROM documents")
def n_chars_hash_split(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.n_chars(F.col("text")).alias("chars"), text.hash_part(F.col("doc_id"), 50).alias("part"))


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY md5({_CLEAN}) ORDER BY doc_id) > 1 AS is_dup FROM documents")
def exact_dedup(spark, sf_dir):
    return select.exact_dup(read(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "is_dup")


def _contaminated_sql(n: int) -> str:
    grams = f"""SELECT {{key}}, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))
     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram
     FROM (SELECT {{key}}, list_filter(string_split({_CLEAN.replace('text', 'lower(text)')}, ' '), lambda x: x <> '') AS w FROM {{table}})"""
    bank, docs = grams.format(key="item_id", table="benchmark"), grams.format(key="doc_id", table="documents")
    return f"SELECT doc_id, doc_id IN (SELECT doc_id FROM ({docs}) WHERE gram IN (SELECT gram FROM ({bank}))) AS contaminated FROM documents"


@query(_contaminated_sql(13))
def contaminated_13(spark, sf_dir):
    return select.contaminated(read(spark, sf_dir, "documents"), "text", read(spark, sf_dir, "benchmark"), "text", "doc_id", 13).select("doc_id", "contaminated")


@query(_contaminated_sql(5))
def contaminated_5(spark, sf_dir):
    return select.contaminated(read(spark, sf_dir, "documents"), "text", read(spark, sf_dir, "benchmark"), "text", "doc_id", 5).select("doc_id", "contaminated")


@query("SELECT doc_id, rn <= 450 AS sample_450 FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS rn FROM documents)")
def sample_n(spark, sf_dir):
    return select.sample(read(spark, sf_dir, "documents"), "doc_id", 450).select("doc_id", "sample_450")


@query("""SELECT doc_id, rn <= 450 AS sample_450 FROM (SELECT doc_id, row_number() OVER (ORDER BY r, h, doc_id) AS rn FROM (
 SELECT doc_id, md5('0:' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) AS r FROM documents))""")
def sample_by_lang(spark, sf_dir):
    return select.sample(read(spark, sf_dir, "documents"), "doc_id", 450, by="lang").select("doc_id", "sample_450")


@query(f"""WITH u AS {_UNIT}, c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(v[i]) AS m FROM u, range(1, 65) r(i) GROUP BY i)),
 s AS (SELECT vec_id, v, list_dot_product(v, c) / sqrt(list_dot_product(c, c)) AS sim FROM u, c),
 k AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS rk FROM s)
 SELECT vec_id, EXISTS (SELECT 1 FROM k b WHERE b.rk < a.rk AND list_dot_product(a.v, b.v) > 0.4) AS is_dup, 0 AS cluster FROM k a""")
def semantic_dedup_k1(spark, sf_dir):
    return select.semantic_dup(read(spark, sf_dir, "embeddings"), "embedding", "vec_id", 0.4, k=1).select("vec_id", "is_dup", "cluster")


def semantic_dedup(spark, sf_dir):
    return select.semantic_dup(read(spark, sf_dir, "embeddings"), "embedding", "vec_id", 0.4).select("vec_id", "is_dup", "cluster")


QUERIES["semantic_dedup"] = semantic_dedup


@query("""SELECT round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.05), 4) AS p5,
 round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, count(*) FILTER (value IS NULL) AS nulls FROM events""")
def stats_numeric(spark, sf_dir):
    """Dataset.stats of a column of numbers."""
    s = _table(read(spark, sf_dir, "events"), "event_id").stats(["value"])["value"]
    return _row(spark, "mean double, low double, high double, p5 double, p50 double, p95 double, nulls long", *[s[k] for k in ("mean", "min", "max", "p5", "p50", "p95", "nulls")])


@query("SELECT count(*) FILTER (toxic = 1) AS n_true, round(avg((toxic = 1)::INT), 4) AS frac, count(*) FILTER (toxic IS NULL) AS nulls FROM labels")
def stats_bool(spark, sf_dir):
    """Dataset.stats of a column of booleans."""
    flags = read(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("flag"))
    s = _table(flags, "doc_id").stats()["flag"]
    return _row(spark, "n_true long, frac double, nulls long", s["true"], s["frac"], s["nulls"])


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 8")
def stats_top(spark, sf_dir):
    return measure.top_values(read(spark, sf_dir, "documents"), "source")


@query("""SELECT count(*) AS groups, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS p50 FROM (SELECT user_id, min(value) AS v FROM events GROUP BY user_id)""")
def grouped_stats(spark, sf_dir):
    """Grouped.stats: the least value of each group, summarised."""
    s = _table(read(spark, sf_dir, "events"), "event_id").group("user_id").stats(["value"])
    return _row(spark, "groups long, mean double, p50 double", s["groups"], s["value"]["mean"], s["value"]["p50"])


_EPISODES = f"""SELECT event_id, user_id, (count(*) OVER u)::INT AS length, coalesce(avg(d2) OVER u, 0)::FLOAT AS jerk, coalesce(avg((d1 < 1.0)::INT) OVER u, 1)::FLOAT AS idle,
 coalesce(sum(d1) OVER u, 0)::FLOAT AS path, (max(value) OVER u)::FLOAT AS peak, coalesce(bool_or(event_type = 'purchase') OVER u, false) AS success
 FROM {_STEPS} WINDOW u AS (PARTITION BY user_id)"""


def _episodes(spark: SparkSession, sf_dir: str) -> table.Grouped:
    """Events of a user as an episode, with all group signals."""
    e = read(spark, sf_dir, "events").withColumn("flag", F.col("event_type") == "purchase")
    g = _table(e, "event_id").group("user_id", "ts")
    return g.signal(length=sig.Group("length"), jerk=sig.Group("jerk", "value"), idle=sig.Group("idle_fraction", "value", 1.0), path=sig.Group("path_length", "value"), peak=sig.Group("peak", "value"), success=sig.Group("success", "flag"))


@query(f"SELECT event_id, length, round(jerk::DOUBLE, 3) AS jerk, round(idle::DOUBLE, 3) AS idle, round(path::DOUBLE, 1) AS path, round(peak::DOUBLE, 3) AS peak, success FROM ({_EPISODES})")
def group_signals(spark, sf_dir):
    d = _episodes(spark, sf_dir).data.df(["event_id", "length", "jerk", "idle", "path", "peak", "success"])
    return d.select("event_id", "length", *[F.round(F.col(c).cast("double"), n).alias(c) for c, n in (("jerk", 3), ("idle", 3), ("path", 1), ("peak", 3))], "success")


@query(f"""WITH e AS ({_EPISODES}), g AS (SELECT user_id, min(jerk)::DOUBLE AS jerk, min(idle)::DOUBLE AS idle, min(length) AS length FROM e GROUP BY user_id),
 q AS (SELECT round(quantile_cont(jerk, 0.95), 4) AS a, round(quantile_cont(idle, 0.95), 4) AS b, floor(quantile_cont(length, 0.05)) AS c FROM g)
 SELECT count(DISTINCT user_id) AS episodes, count(*) AS frames FROM e, q WHERE jerk::DOUBLE <= a AND idle::DOUBLE <= b AND length >= c""")
def robot_rule(spark, sf_dir):
    """The robot pipeline: group signals, their summary, a rule from its quantiles, a tag, what is kept."""
    g = _episodes(spark, sf_dir)
    s = g.stats(["length", "jerk", "idle"])
    good = g.data.filter(f"double(jerk) <= {s['jerk']['p95']} AND double(idle) <= {s['idle']['p95']} AND length >= {s['length']['p5']}")
    good.tag("smooth")
    return _row(spark, "episodes long, frames long", len(good.group("user_id")), len(table.load(spark, good.uri, tag="smooth")))


@query("SELECT conv_id, turn, (count(*) OVER (PARTITION BY conv_id))::INT AS turns FROM conversations")
def group_turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", grouped.length("conv_id").alias("turns"))


@query(f"""SELECT round(corr(a, b), 6) AS spearman FROM (SELECT row_number() OVER (ORDER BY n_chars, doc_id) AS a, row_number() OVER (ORDER BY w, doc_id) AS b
 FROM (SELECT doc_id, n_chars, {_WORDS} AS w FROM documents))""")
def spearman(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", text.length(F.col("text")).alias("w"))
    return measure.spearman(d, "n_chars", "w", "doc_id").select(F.round("spearman", 6).alias("spearman"))


@query(f"SELECT vec_id, round(list_dot_product(v, lag(v) OVER (PARTITION BY label ORDER BY vec_id)), 5) AS cosine FROM {_UNIT}")
def consecutive_cosine(spark, sf_dir):
    return measure.consecutive_cosine(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("vec_id", F.round("cosine", 5).alias("cosine"))


@query(f"WITH u AS {_UNIT} SELECT a.vec_id, round(max(list_dot_product(a.v, b.v)), 5) AS cosine FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id")
def nearest_neighbour(spark, sf_dir):
    return measure.nearest_neighbour(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("vec_id", F.round("cosine", 5).alias("cosine"))


@query(f"""WITH d AS (SELECT doc_id, list_filter(string_split({_CLEAN.replace('text', 'lower(text)')}, ' '), lambda x: x <> '') AS w FROM documents),
 t AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'license')) AS f1, len(list_filter(w, lambda x: x = 'under')) AS f2 FROM d),
 s AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM t)
 SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / a))
  + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / a)) AS score FROM t, s) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_search(spark, sf_dir):
    found = measure.search(read(spark, sf_dir, "documents"), "license under", "text", "doc_id", 10)
    return found.select("doc_id", F.round("_score", 6).alias("score"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE text LIKE '%License%'")
def filter_like(spark, sf_dir):
    return _documents(spark, sf_dir).filter("text LIKE '%License%'").df(["doc_id", "lang", "n_chars"])


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000 AND NOT (source = 'src0')")
def view_conjunction(spark, sf_dir):
    return _documents(spark, sf_dir).filter("(lang = 'en') AND (n_chars > 1000)").filter("NOT (source = 'src0')").df(["doc_id", "n_chars"])


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def limit_topk(spark, sf_dir):
    return read(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "n_chars")


@query("SELECT d.doc_id, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def drop_null(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return _table(d, "doc_id").drop_null(["doc_id", "quality", "toxic"])


@query("""WITH g AS (SELECT user_id, count(*) AS n, sum(value) AS total FROM events GROUP BY user_id), q AS (SELECT quantile_cont(total, 0.95) AS hi, quantile_cont(total, 0.05) AS lo FROM g)
 SELECT count(DISTINCT e.user_id) AS groups, count(*) AS n_rows FROM events e JOIN g ON e.user_id = g.user_id, q WHERE total <= hi AND total >= lo""")
def quantile_rule(spark, sf_dir):
    """A rule from quantiles of sums; the quantiles stay in the plan."""
    e = read(spark, sf_dir, "events")
    g = e.groupBy("user_id").agg(F.sum("value").alias("total"))
    q = g.agg(F.percentile("total", F.array(F.lit(0.95), F.lit(0.05))).alias("q")).select(F.get("q", F.lit(0)).alias("hi"), F.get("q", F.lit(1)).alias("lo"))
    kept = e.join(g.join(F.broadcast(q), (F.col("total") <= F.col("hi")) & (F.col("total") >= F.col("lo"))), "user_id")  # one row
    return kept.agg(F.count_distinct("user_id").alias("groups"), F.count("*").alias("n_rows"))


@query("""WITH t AS (SELECT a.vec_id AS q, b.vec_id AS i, list_dot_product(a.embedding::DOUBLE[], list_reverse(b.embedding::DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label)
 SELECT round(100 * avg((r < 1)::INT), 4) AS r1, round(100 * avg((r < 5)::INT), 4) AS r5 FROM (SELECT t.q, count(*) FILTER (t.s > m.s) AS r FROM t JOIN t m ON m.q = t.q AND m.i = m.q GROUP BY t.q)""")
def recall_at_k(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    out = measure.retrieval(e, "label", "vec_id", "embedding")
    return out.select(F.round("r1", 4).alias("r1"), F.round("r5", 4).alias("r5"))


@query(f"SELECT doc_id, CASE WHEN lang = 'en' OR n_chars > 500 THEN {_WORDS}::INT END AS n_words FROM documents")
def resume_partial(spark, sf_dir):
    """A signal on one view, then on another: the second pass computes what is null."""
    d = _documents(spark, sf_dir)
    d.filter("lang = 'en'").signal(n_words=sig.length("text"))
    d.filter("n_chars > 500").signal(n_words=sig.length("text"))
    return d.df(["doc_id", "n_words"])


@query(f"SELECT doc_id, {_WORDS}::INT AS n_words FROM documents WHERE lang = 'fr' AND {_WORDS} >= 50")
def tag_roundtrip(spark, sf_dir):
    """A tag keeps what it named: a later column of the table doesn't show in it."""
    d = _documents(spark, sf_dir).signal(n_words=sig.length("text"))
    d.filter("lang = 'fr'").filter("n_words >= 50").tag("french")
    d.signal(chars=sig.n_chars("text"))
    return table.load(spark, d.uri, tag="french").df(["doc_id", "n_words"])


@query(f"SELECT doc_id, lang, {_WORDS}::INT AS n_words FROM documents WHERE lang <> 'en'")
def export_roundtrip(spark, sf_dir):
    d = _documents(spark, sf_dir).signal(n_words=sig.length("text"))
    at = _scratch_uri(spark)
    d.filter("lang <> 'en'").export(at, ["doc_id", "lang", "n_words"])
    return table.load(spark, at).df()


@query(f"""SELECT doc_id, sha FROM (SELECT doc_id, md5(text) AS sha, {_WORDS} AS n, row_number() OVER (PARTITION BY md5({_CLEAN}) ORDER BY doc_id) AS r FROM documents WHERE lang = 'en') WHERE n >= 50 AND r = 1""")
def view_dedup(spark, sf_dir):
    """The text pipeline on a table: a view, signals, exact dedup of the view, a rule."""
    d = _documents(spark, sf_dir).filter("lang = 'en'").signal(n_words=sig.length("text"), n_chars2=sig.n_chars("text"))
    kept = d.dedup("text").filter("n_words >= 50")
    return kept.df(["doc_id", "text"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("sha"))


_PAIRS = f"""SELECT vec_id, list_dot_product(v, w) AS cosine FROM (SELECT vec_id, v, lead(v) OVER (ORDER BY h, vec_id) AS w FROM
 (SELECT vec_id, v, md5('0:' || vec_id) AS h FROM {_UNIT} ORDER BY h, vec_id LIMIT 301)) WHERE w IS NOT NULL"""


@query(f"WITH u AS {_UNIT} SELECT vec_id, round(cosine, 5) AS cosine FROM ({_PAIRS})")
def random_pairs(spark, sf_dir):
    return measure.random_pairs(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 300).select("vec_id", F.round("cosine", 5).alias("cosine"))


_QUANTILES = ", ".join(f"round(quantile_cont(cosine, {q / 100}), 4) AS p{q}" for q in (5, 25, 50, 75, 95))


@query(f"""WITH u AS {_UNIT}, c AS (SELECT list_dot_product(v, lag(v) OVER (PARTITION BY label ORDER BY vec_id)) AS cosine FROM u),
 n AS (SELECT max(list_dot_product(a.v, b.v)) AS cosine FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 10 = 0 GROUP BY a.vec_id)
 SELECT 'consecutive' AS kind, {_QUANTILES} FROM c UNION ALL SELECT 'random_pair', {_QUANTILES} FROM ({_PAIRS}) UNION ALL SELECT 'nearest_neighbour', {_QUANTILES} FROM n""")
def similarity_distribution(spark, sf_dir):
    """What a threshold for near duplicates is chosen from: three distributions of cosines (neighbours of a stated query set, against all)."""
    e = read(spark, sf_dir, "embeddings")
    parts = {"consecutive": measure.consecutive_cosine(e, "label", "vec_id", "embedding"), "random_pair": measure.random_pairs(e, "vec_id", "embedding", 300), "nearest_neighbour": measure.nearest_neighbour(e, "label", "vec_id", "embedding", queries="vec_id % 10 = 0")}
    rows = [measure.distribution(df, "cosine").select(F.lit(kind).alias("kind"), "*") for kind, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""SELECT vec_id, size FROM (SELECT *, (count(*) OVER (PARTITION BY label))::INT AS size FROM embeddings) JOIN (
 {ORACLE_SQL['semantic_dedup_k1']}) USING (vec_id) WHERE NOT is_dup AND size >= 20""")
def world_model(spark, sf_dir):
    """The world-model pipeline: group signals, near duplicates of the embeddings dropped, a rule, a tag."""
    d = _table(read(spark, sf_dir, "embeddings"), "vec_id")
    d.group("label", "vec_id").signal(size=sig.Group("length"))
    kept = d.dedup("embedding", threshold=0.4, k=1).filter("size >= 20")
    kept.tag("frames")
    return table.load(spark, d.uri, tag="frames").df(["vec_id", "size"])


@query(f"""SELECT doc_id, n_words FROM (SELECT doc_id, {_WORDS}::INT AS n_words, row_number() OVER (PARTITION BY md5({_CLEAN}) ORDER BY doc_id) AS r FROM documents WHERE lang = 'en')
 JOIN ({_contaminated_sql(13)}) USING (doc_id) WHERE r = 1 AND n_words >= 50 AND NOT contaminated""")
def text_pipeline(spark, sf_dir):
    """The text pipeline: signals on a view, contamination by a bank, exact dedup, a rule, a tag."""
    bank = [r.text for r in read(spark, sf_dir, "benchmark").select("text").collect()]  # the bank of an evaluation is small
    view = _documents(spark, sf_dir).filter("lang = 'en'").signal(n_words=sig.length("text"), dirty=sig.contaminated("text", bank))
    kept = view.dedup("text").filter("n_words >= 50 AND NOT dirty")
    kept.tag("clean")
    return table.load(spark, kept.uri, tag="clean").df(["doc_id", "n_words"])


@query("""SELECT 'all' AS arm, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('1:' || doc_id), doc_id) AS r FROM documents WHERE ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 50 <> 0) WHERE r <= 100
 UNION ALL SELECT 'long', doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('1:' || doc_id), doc_id) AS r FROM documents WHERE ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 50 <> 0 AND n_chars > 1000) WHERE r <= 100""")
def text_arms(spark, sf_dir):
    """Arms of a training comparison: a held-out part, then a sample of one size from each view."""
    d = _documents(spark, sf_dir).signal(part=sig.hash_part("doc_id", 50))
    train = d.filter("part <> 0")
    arms = {"all": train.sample(100, seed=1, name="arm_all"), "long": train.filter("n_chars > 1000").sample(100, seed=1, name="arm_long")}
    rows = [view.df(["doc_id"]).select(F.lit(name).alias("arm"), "doc_id") for name, view in arms.items()]
    return rows[0].unionByName(rows[1])


_TRIALS = ["TRUE", "lang = 'en'", "n_chars > 1000", "lang = 'xx'"]


def _text(w: str) -> str:
    return chr(39) + w.replace(chr(39), 2 * chr(39)) + chr(39)


@query(" UNION ALL ".join(f"SELECT 'trial_{i}' AS name, {_text(w)} AS where_, round(avg(n_chars), 4) AS score, count(*) AS n_rows FROM documents WHERE {w}" for i, w in enumerate(_TRIALS)))
def search_loop(spark, sf_dir):
    """The search loop over fixed filters; a trial is scored by the mean length of what it keeps, and too small ones stay unscored."""
    d = _documents(spark, sf_dir)
    trials = loop.Loop(d, lambda view, name: view.stats(["n_chars"])["n_chars"]["mean"], loop.grid(_TRIALS), minimize=False, budget=len(_TRIALS), columns=["n_chars"]).run()
    return spark.createDataFrame([(t.name, t.where, t.score, t.rows) for t in trials], "name string, where_ string, score double, n_rows long")


_STOPS = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(map(_text, ws))})))" for ws in text.STOP_WORDS.values())


@query(f"""SELECT doc_id, CASE WHEN list_sum(h) > 0 AND list_max(h) / list_sum(h) >= 0.5 THEN [{', '.join(map(_text, text.STOP_WORDS))}][list_position(h, list_max(h))] ELSE 'und' END AS language
 FROM (SELECT doc_id, [{_STOPS}] AS h FROM (SELECT doc_id, list_filter(string_split(lower(trim(substr({_CLEAN}, 1, 2000))), ' '), lambda x: x <> '') AS w FROM documents))""")
def language(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.language(F.col("text")).alias("language"))


def quality_signal(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", sig.quality("text").column().alias("quality"))


def embed_signal(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", sig.embed("text", 64).column().alias("embedding"))


@query(f"SELECT doc_id, len(list_filter(string_split({_CLEAN}, ' '), lambda x: x <> ''))::INT AS n_tokens FROM documents")
def tokenize_signal(spark, sf_dir):
    """Without a tokenizer's file a word is a token."""
    d = _documents(spark, sf_dir).signal(ids=sig.tokenize("text"))
    return d.df(["doc_id", "ids"]).select("doc_id", text.n_tokens(F.col("ids")).alias("n_tokens"))


def tokenize_file(spark, sf_dir):
    """By a tokenizer's file, where one is there."""
    try:
        import public_tokenizers

        file = public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        file = ""
    ids = read(spark, sf_dir, "documents").select("doc_id", sig.tokenize("text", file).column().alias("ids"))
    return ids.select("doc_id", text.n_tokens(F.col("ids")).alias("n_tokens"))


QUERIES |= {f.__name__: f for f in (quality_signal, embed_signal, tokenize_file)}
