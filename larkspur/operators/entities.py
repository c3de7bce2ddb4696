"""Entities: dictionary and label matchers, places, company keys, linkage, variants, cascades, one call per text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import chase
from .lifecycle import update_from
from .windows import top_per_group

#: Terms that are sent to all workers; more are joined by shuffles.
BROADCAST_TERMS = 100_000


def words_of(text: Column) -> Column:
    """Words (letters, digits, + and #) in lower case, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}+#]+"), lambda w: w != "")


def ngrams(text: Column, lengths: Sequence[int]) -> Column:
    """Distinct runs of words of the given lengths, joined by blanks."""

    def runs(ws: Column, n: int) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1))), lambda i: i + (n - 1) <= F.size(ws))
        return F.transform(places, lambda i: F.array_join(F.slice(ws, i, n), " "))

    return F.transform(F.array(words_of(text)), lambda ws: F.array_distinct(F.flatten(F.array(*(runs(ws, n) for n in lengths)))))[0]


def matched(df: DataFrame, id_column: str, text: str, terms: DataFrame, term: str, language: tuple[str, str] | None = None) -> DataFrame:
    """(id, all columns of the term's row) for each term that occurs in the text as whole words: an equi-join on n-grams.

    Runs are as long as the terms are (the lengths that occur are counted first). ``language`` names a column of the
    texts and one of the terms: a term with a language is only looked for in texts of that language.
    """
    spelled = terms.withColumn("__words", words_of(F.col(term))).where(F.size("__words") > 0).withColumn("__gram", F.array_join("__words", " "))
    counts = dict(spelled.groupBy(F.size("__words")).count().collect())
    lengths = sorted(counts)
    grams = df.select(id_column, *([F.col(language[0]).alias("__lang")] if language else []), F.explode(ngrams(F.col(text), lengths or [1])).alias("__gram"))
    # Spark takes the exploded runs for as small as their table, so it must be told which side is the small one
    spelled = spelled.drop("__words")
    found = (grams.join(F.broadcast(spelled), "__gram") if sum(counts.values()) <= BROADCAST_TERMS else grams.hint("merge").join(spelled, "__gram")).drop("__gram")
    return found.where(F.col(language[1]).isNull() | (F.col(language[1]) == F.col("__lang"))).drop("__lang") if language else found


def classify(df: DataFrame, id_column: str, title: str, dictionary: DataFrame) -> DataFrame:
    """(id, family, confidence) by the longest dictionary word in the title (columns word, family)."""
    found = matched(df, id_column, title, dictionary, "word")
    best = top_per_group(found, [id_column], [F.length("word").desc(), F.col("word"), F.col("family")], 1)
    share = F.length("word") / F.greatest(F.length(title), F.lit(1)) + 0.3
    return best.join(df.select(id_column, title), id_column).select(id_column, "family", F.round(F.least(share, F.lit(0.95)), 4).alias("confidence"))


def labels(df: DataFrame, id_column: str, text: str, vocabulary: DataFrame, label: str, unwanted: Sequence[str] = (), most: int = 25) -> DataFrame:
    """(id, labels): the vocabulary's labels found in the text, sorted, at most ``most``."""
    found = matched(df, id_column, text, vocabulary.where(~F.lower(F.col(label)).isin("", *unwanted)), label)
    return found.groupBy(id_column).agg(F.slice(F.sort_array(F.collect_set(label)), 1, most).alias("labels"))


def locate(df: DataFrame, id_column: str, text: str, places: DataFrame) -> DataFrame:
    """(id, country) by the places a text names (columns name, country, rank, population): least rank, most people."""
    found = matched(df, id_column, text, places, "name")
    return top_per_group(found, [id_column], [F.col("rank"), F.col("population").desc_nulls_last(), F.col("country")], 1).select(id_column, "country")


def cascade(df: DataFrame, id_column: str, levels: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Each row's result from the first level that has one; a later level sees only what is left. Levels give (id, value)."""
    left, out = df, None
    for name, level in levels:
        got = level(left).select(id_column, "value").withColumn("level", F.lit(name))
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select(id_column), id_column, "left_anti")
    return out


def once_per_text(df: DataFrame, text: str, infer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``infer`` (text_hash, text -> text_hash and results) on distinct texts only and join its results back."""
    keyed = df.withColumn("text_hash", F.sha1(F.col(text)))
    distinct = keyed.groupBy("text_hash").agg(F.first(text).alias(text))
    return keyed.join(infer(distinct), "text_hash", "left")


def case_variants(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Rows whose key differs from another's by case only, with the key that is elected to stay (``kept``)."""
    low = df.withColumn("__low", F.lower(key))
    groups = low.groupBy("__low").agg(F.count_distinct(key).alias("n")).where("n > 1").select("__low")
    members = low.join(groups, "__low")
    heads = top_per_group(members, ["__low"], order, 1).select("__low", F.col(key).alias("kept"))
    return members.join(heads, "__low").drop("__low")


def variants_by_ids(df: DataFrame, key: str, id_column: str, least: float = 0.5) -> DataFrame:
    """(key, kept): keys that differ by case only and share at least ``least`` of the smaller one's ids, with the one that has
    most ids (ties: the least by spelling). Ids meet by an equi-join within one spelling, so no two keys are compared blindly."""
    rows = df.select(F.col(key).alias("k"), F.lower(key).alias("l"), F.col(id_column).alias("i")).distinct()
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.l") == F.col("b.l")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.k") != F.col("b.k")))
    shared = pairs.groupBy(F.col("a.k").alias("k"), F.col("b.k").alias("o")).agg(F.count("*").alias("both"))
    sized = shared.join(sizes, "k").join(sizes.select(F.col("k").alias("o"), F.col("n").alias("m")), "o")
    better = sized.where((F.col("both") >= least * F.least("n", "m")) & ((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("o") < F.col("k")))))
    return top_per_group(better, ["k"], [F.col("m").desc(), F.col("o")], 1).select(F.col("k").alias(key), F.col("o").alias("kept"))


def shared_domains(df: DataFrame, domain: str, company: str, least: int = 10) -> DataFrame:
    """Domains that ``least`` companies or more claim (a vendor's, not theirs), with their number."""
    pairs = df.where(F.col(domain).isNotNull()).select(domain, company).distinct()
    return pairs.groupBy(domain).agg(F.count("*").alias("companies")).where(F.col("companies") >= least)


def canonical_companies(df: DataFrame, id_column: str, domain: str, name: str, order: Sequence[Column]) -> DataFrame:
    """(id, canonical): rows that share a domain or a normalised name elect a head each way; chains are followed to the end.

    A row's own election by domain wins over that by name; ``order`` ranks heads (and must be total).
    """
    keys = F.array_compact(F.array(F.when(F.col(domain) != "", F.concat(F.lit("dom:"), F.col(domain))), F.when(F.col(name) != "", F.concat(F.lit("nom:"), F.col(name)))))
    keyed = df.withColumn("__key", F.explode(keys))
    heads = top_per_group(keyed, ["__key"], order, 1).select("__key", F.col(id_column).alias("__head"))
    votes = keyed.select(F.col(id_column).alias("node"), "__key").join(heads, "__key").where(F.col("node") != F.col("__head"))
    pointer = votes.groupBy("node").agg(F.min(F.struct("__key", "__head"))["__head"].alias("target"))
    # a head stands before all rows of its key in the one total order, so pointers never lead back
    ends = chase(pointer, "node", "target")
    return df.select(id_column).join(ends.select(F.col("node").alias(id_column), F.col("target").alias("canonical")), id_column, "left").withColumn("canonical", F.coalesce("canonical", id_column))


def link_records(own: DataFrame, external: DataFrame, key: str, columns: Sequence[str], tie: Sequence[Column]) -> DataFrame:
    """Own rows with the external record of their key that has most of ``columns`` filled (ties: ``tie``)."""
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    wanted = external.join(own.select(key).distinct(), key, "left_semi")
    best = top_per_group(wanted.withColumn("__filled", filled), [key], [F.col("__filled").desc(), *tie], 1).drop("__filled")
    return own.join(best, key, "left")


def upsert_two_keys(target: DataFrame, batch: DataFrame, first: str, second: str, columns: Sequence[str]) -> DataFrame:
    """Batch rows update the target row of the same ``first`` key, else that of the same ``second``; the others are added."""
    by_first = batch.join(target.select(first), first, "left_semi")
    rest = batch.join(target.select(first), first, "left_anti")
    by_second = rest.join(target.select(second), second, "left_semi")
    fresh = rest.join(target.select(second), second, "left_anti").dropDuplicates([second])
    updated = update_from(update_from(target, by_first, [first], columns), by_second, [second], columns)
    return updated.unionByName(fresh.select(*target.columns))
