"""Duplicate keys, contamination, splits, audits and metrics over documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation, filters, windows
from .common import table
from .registry import query


@query("SELECT p_partkey, CASE WHEN t <> '' AND b <> '' THEN substr(t, 1, 60) || '|' || b || '|' || substr(lower(p_type), 1, 24) END AS key FROM (SELECT *, lower(p_name) AS t, trim(regexp_replace(lower(p_brand), '[^a-z0-9 ]', ' ', 'g')) AS b FROM part)")
def duplicate_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", curation.duplicate_key(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("key"))


@query("SELECT h, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents) GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", curation.text_hash(F.col("text")).alias("h"))
    return rows.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("""
SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, b ORDER BY doc_id) AS r2 FROM (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY doc_id) AS r1, substr(text, 1, 40) AS b FROM (SELECT *, substr(text, 1, 300) AS a FROM documents)) WHERE r1 = 1) WHERE r2 = 1
""")
def title300_dup(spark, sf):
    docs = table(spark, sf, "documents")
    return curation.first_of(docs, [[F.substring("text", 1, 300)], [F.col("lang"), F.substring("text", 1, 40)]], [F.col("doc_id")]).select("doc_id")


@query("""
WITH t AS (SELECT DISTINCT sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents WHERE source < 'src3'), d AS (SELECT DISTINCT sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents WHERE source >= 'src3')
SELECT (SELECT count(*) FROM t) AS train, (SELECT count(*) FROM d) AS dev, (SELECT count(*) FROM t WHERE h IN (SELECT h FROM d)) AS shared, round(100.0 * (SELECT count(*) FROM t WHERE h IN (SELECT h FROM d)) / (SELECT count(*) FROM d), 2) AS percent
""")
def contamination(spark, sf):
    docs = table(spark, sf, "documents")
    return curation.contamination(docs.where("source < 'src3'"), docs.where("source >= 'src3'"), "text")


@query("SELECT doc_id FROM documents WHERE source < 'src3' AND sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))) NOT IN (SELECT sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))) FROM documents WHERE source >= 'src3')")
def contamination_removed(spark, sf):
    docs = table(spark, sf, "documents")
    return curation.without_contaminated(docs.where("source < 'src3'"), docs.where("source >= 'src3'"), "text").select("doc_id")


@query("""
SELECT doc_id, CASE WHEN v < 0.05 THEN 'test' WHEN v < 0.11 THEN 'dev' ELSE 'train' END AS split FROM (SELECT doc_id, CAST(('0x' || substr(sha1(source || lang), 1, 8)) AS BIGINT) / 4294967296.0 AS v FROM documents)
""")
def hash_split(spark, sf):
    return curation.split(table(spark, sf, "documents"), F.concat("source", "lang"), {"test": 0.05, "dev": 0.06}, "train").select("doc_id", "split")


@query("SELECT doc_id FROM documents WHERE CAST(('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.1")
def deterministic_hash_sample(spark, sf):
    """A sampling operator: ten percent of the rows by the hash of their id."""
    return table(spark, sf, "documents").where(windows.hash_share(F.col("doc_id")) < 0.1).select("doc_id")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 12")
def stratified_md5_sample(spark, sf):
    """A sampling operator: twelve rows a language."""
    return windows.stratified_sample(table(spark, sf, "documents"), "lang", "doc_id", 12).select("lang", "doc_id")


@query("""
WITH a AS (SELECT *, length(text) < 200 AS poor, row_number() OVER (PARTITION BY lang, length(text) < 200 ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rp FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM a WHERE NOT poor OR rp <= 24)
SELECT lang, doc_id FROM b WHERE rn <= 120 AND lang IN (SELECT lang FROM b WHERE rn <= 120 GROUP BY 1 HAVING count(*) >= 110)
""")
def balanced_sample(spark, sf):
    """A sampling operator: at most 120 rows a language, at most a fifth of them short, no language under 110."""
    return curation.balanced(table(spark, sf, "documents"), "lang", "doc_id", 120, 110, F.length("text") < 200, 0.2).select("lang", "doc_id")


@query("""
SELECT conv_id, roles, empty, (roles = 'user,assistant,user,assistant' AND empty = 0) AS valid FROM (
  SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles, count(*) FILTER (WHERE length(trim(text)) = 0) AS empty FROM conversations GROUP BY 1)
""")
def conv_structure_audit(spark, sf):
    return curation.chat_audit(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", ["user", "assistant", "user", "assistant"])


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5))
SELECT w.doc_id, coalesce(r, 0) AS repeated FROM w LEFT JOIN (SELECT doc_id, count(*) - count(DISTINCT g) AS r FROM g GROUP BY 1) q ON q.doc_id = w.doc_id
""")
def repeated_5gram(spark, sf):
    return table(spark, sf, "documents").select("doc_id", curation.repeated_ngrams(filters.words(F.col("text")), 5).cast("long").alias("repeated"))


@query("""
SELECT lang, count(*) AS n, count(*) FILTER (WHERE length(text) < 40) AS short, count(*) FILTER (WHERE h IN (SELECT h FROM (SELECT sha1(text) AS h FROM documents) GROUP BY 1 HAVING count(*) > 1)) AS copies, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{3,}')) AS numbers
FROM (SELECT *, sha1(text) AS h FROM documents) GROUP BY 1
""")
def dataset_audit_flags(spark, sf):
    docs = table(spark, sf, "documents").withColumn("h", F.sha1("text"))
    copies = docs.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    flagged = docs.join(copies, "h", "left")
    return flagged.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.length("text") < 40).alias("short"), F.count("c").alias("copies"), F.count_if(F.col("text").rlike("[0-9]{3,}")).alias("numbers"))


@query("""
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good' WHEN d.n_chars > 500 THEN 'long' ELSE 'other' END AS label, CASE WHEN l.toxic = 1 THEN 'code' WHEN l.quality = 1 THEN 'rule' WHEN d.n_chars > 500 THEN 'model' ELSE 'default' END AS origin
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def label_priority(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    label, origin = curation.by_priority([("code", F.when(F.col("toxic") == 1, "toxic")), ("rule", F.when(F.col("quality") == 1, "good")), ("model", F.when(F.col("n_chars") > 500, "long")), ("default", F.lit("other"))])
    return joined.select("doc_id", label.alias("label"), origin.alias("origin"))


SCORED_SQL = "(SELECT l.doc_id, l.quality, l.toxic, d.source, d.n_chars, (d.n_chars > 800) AS guess FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def scored(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id").withColumn("guess", F.col("n_chars") > 800)


@query(f"SELECT quality, guess, count(*) AS n FROM {SCORED_SQL} GROUP BY 1, 2")
def confusion(spark, sf):
    return curation.confusion(scored(spark, sf), "quality", "guess")


@query(f"""
SELECT source, tp, fp, fn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM (
  SELECT source, count(*) FILTER (WHERE quality = 1 AND guess) AS tp, count(*) FILTER (WHERE quality = 0 AND guess) AS fp, count(*) FILTER (WHERE quality = 1 AND NOT guess) AS fn FROM {SCORED_SQL} GROUP BY 1)
""")
def f1_by_source(spark, sf):
    return curation.precision_recall(scored(spark, sf), F.col("quality") == 1, F.col("guess"), ["source"])


@query(f"""
WITH r AS (SELECT (rank() OVER (ORDER BY n_chars)) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS a, (rank() OVER (ORDER BY quality + toxic)) + (count(*) OVER (PARTITION BY quality + toxic) - 1) / 2.0 AS b FROM {SCORED_SQL})
SELECT round(corr(a, b), 6) AS spearman FROM r
""")
def spearman(spark, sf):
    return curation.spearman(scored(spark, sf).select("n_chars", (F.col("quality") + F.col("toxic")).alias("k")), "n_chars", "k")


@query(f"""
WITH r AS (SELECT quality, (rank() OVER (ORDER BY n_chars)) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM {SCORED_SQL})
SELECT round((sum(CASE WHEN quality = 1 THEN r END) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)), 6) AS auc FROM r
""")
def auc(spark, sf):
    return curation.auc(scored(spark, sf), F.col("quality") == 1, "n_chars")


@query()
def bootstrap_interval(spark, sf):
    rows = scored(spark, sf).select("doc_id", ((F.col("quality") == 1) == F.col("guess")).cast("int").alias("right"))
    return curation.bootstrap(rows, F.col("right"), 200, 7)


@query(f"""
WITH s AS (SELECT doc_id, CAST((quality = 1) = guess AS INTEGER) - CAST((quality = 1) = (n_chars > 400) AS INTEGER) AS d FROM {SCORED_SQL}),
u AS (SELECT r, d, CAST('0x' || substr(sha1('7|' || r || '|' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM s, range(1, 201) t(r)),
w AS (SELECT r, d, CASE WHEN u < 0.367879 THEN 0 WHEN u < 0.735759 THEN 1 WHEN u < 0.919699 THEN 2 WHEN u < 0.981012 THEN 3 WHEN u < 0.996340 THEN 4 WHEN u < 0.999406 THEN 5 WHEN u < 0.999917 THEN 6 ELSE 7 END AS w FROM u),
m AS (SELECT r, sum(d * w) / nullif(sum(w), 0) AS m FROM w GROUP BY 1),
e AS (SELECT round(quantile_cont(m, 0.05), 4) AS low, round(quantile_cont(m, 0.95), 4) AS high FROM m)
SELECT (SELECT round(avg(d), 4) FROM s) AS difference, low, high, low > 0 OR high < 0 AS differs FROM e
""")
def paired_bootstrap(spark, sf):
    """Whether one guess of quality is better than another on the same documents, and by how much."""
    right = lambda least: ((F.col("quality") == 1) == (F.col("n_chars") > least)).cast("int")
    return curation.paired_bootstrap(scored(spark, sf), "doc_id", right(800), right(400), 200, 7)


@query("""
WITH w AS (SELECT p_partkey, title, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS t FROM (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS title FROM part)),
k AS (SELECT DISTINCT title AS known_title, t FROM w)
SELECT p_partkey, known_title, round(len(list_intersect(w.t, k.t)) / len(list_distinct(list_concat(w.t, k.t))), 4) AS jaccard FROM w JOIN k ON len(w.t) > 0 AND len(k.t) > 0
  AND 100 * len(list_intersect(w.t, k.t)) >= 85 * len(list_distinct(list_concat(w.t, k.t)))
""")
def fuzzy_title_match(spark, sf):
    """Every part's title against all titles."""
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"))
    return curation.fuzzy_titles(parts, parts, "p_partkey", "title", 85)


@query("""
WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS t FROM documents),
k AS (SELECT min(doc_id) AS known_id, t FROM w WHERE len(t) > 0 GROUP BY t),
p AS (SELECT a.known_id AS a, b.known_id AS b, len(list_intersect(a.t, b.t)) AS c, len(a.t) + len(b.t) AS n FROM k a JOIN k b ON 100 * least(len(a.t), len(b.t)) >= 85 * greatest(len(a.t), len(b.t)))
SELECT w.doc_id, p.b AS known_id, round(c / (n - c), 4) AS jaccard FROM w JOIN k ON k.t = w.t JOIN p ON p.a = k.known_id WHERE 100 * c >= 85 * (n - c)
""")
def near_dup_jaccard(spark, sf):
    """Documents alike in the token sets of their whole texts, to the representative of every class alike."""
    return curation.alike_texts(table(spark, sf, "documents"), "doc_id", "text", 85)
