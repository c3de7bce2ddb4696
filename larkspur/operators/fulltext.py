"""Full text by a stored inverted index: built once, then asked without opening a text.

A posting row is a token, a stretch of ids and the sorted ids of that stretch that hold the token, so no row grows
with the corpus. Rows lie in folders by a hash of the token, sorted by token: a question reads the folders of its tokens
and of these the row groups that can hold them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import words

BUCKETS = 64
#: Ids of one posting row at most; they lie within so many numbers.
STRETCH = 1 << 16


def bucket(token):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def build_index(df: DataFrame, id_column: str, text: str, folder: str) -> None:
    """Write the index of an integer id and a text. Null ids and texts are left out; ids that repeat share their words."""
    rows = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.explode(F.array_distinct(words(F.col(text)))).alias("token"))
    stretch = F.floor(F.col("id") / STRETCH) if STRETCH & (STRETCH - 1) else F.shiftright("id", STRETCH.bit_length() - 1)
    postings = rows.groupBy("token", stretch.alias("stretch")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    postings = postings.withColumn("bucket", bucket("token"))
    # a bucket's rows are split by their stretch as well, so that no task writes all of a bucket
    dealt = postings.repartition("bucket", F.pmod(F.xxhash64("stretch"), F.lit(BUCKETS))).sortWithinPartitions("bucket", "token", "stretch")
    dealt.write.partitionBy("bucket").parquet(folder)


def tokens_of(questions: DataFrame, question: str, id_column: str) -> DataFrame:
    return questions.select(id_column, F.array_distinct(words(F.col(question))).alias("tokens"))


def ask(spark: SparkSession, folder: str, questions: DataFrame, question_id: str, question: str) -> DataFrame:
    """(question id, id): the ids whose text holds every token of the question (a bounded list of questions).

    Within a stretch the postings are intersected from the shortest on. A question without tokens finds nothing.
    """
    asked = tokens_of(questions, question, question_id).where(F.size("tokens") > 0)
    wanted = sorted({t for r in asked.select("tokens").collect() for t in r.tokens})  # the questions' own words
    buckets = sorted({r.b for r in spark.createDataFrame([(t,) for t in wanted], "token string").select(bucket("token").alias("b")).collect()})
    schema = "token string, stretch long, ids array<long>, bucket int"
    postings = spark.read.schema(schema).parquet(folder).where(F.col("bucket").isin(buckets) & F.col("token").isin(wanted))
    each = asked.select(question_id, F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    met = postings.join(F.broadcast(each), "token").groupBy(question_id, "n", "stretch").agg(F.sort_array(F.collect_list(F.struct(F.size("ids").alias("size"), "ids"))).alias("lists"))
    whole = met.where(F.size("lists") == F.col("n"))
    first = F.col("lists")[0]["ids"]
    both = F.aggregate(F.slice("lists", 2, F.size("lists")), first, lambda kept, x: F.array_intersect(kept, x["ids"]))
    return whole.select(question_id, F.explode(both).alias("id"))


def matching(df: DataFrame, id_column: str, text: str, folder: str, question: str) -> DataFrame:
    """The ids of one question, building the index first."""
    build_index(df, id_column, text, folder)
    spark = df.sparkSession
    return ask(spark, folder, spark.createDataFrame([(0, question)], "q int, question string"), "q", "question").select(F.col("id").alias(id_column))


__all__: Sequence[str] = ("ask", "build_index", "matching")
