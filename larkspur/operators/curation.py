"""Dataset curation: duplicate keys, contamination, splits, structure audits, label priorities, evaluation metrics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from contextlib import ExitStack

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, lent
from . import alike
from .windows import hash_share, running_total, top_per_group

#: Rows that say which texts are copies or to be read again are broadcast up to this number (about 100 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Of the cells in which whole sets are compared: pairs around one class from which they are dealt out, and tokens of all sets.
CELL_PAIRS, CELL_TOKENS = 50_000, 500_000


def squeezed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def text_hash(text: Column) -> Column:
    return F.sha1(squeezed(text).cast("binary"))


def flat(text: Column) -> Column:
    """Lower case, anything but a-z, 0-9 and blank as blank, squeezed."""
    return squeezed(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "))


def duplicate_key(title: Column, owner: Column, place: Column) -> Column:
    """title[:60]|owner|place[:24], flattened; null where title or owner is empty."""
    t, o = flat(title), flat(owner)
    key = F.concat(F.substring(t, 1, 60), F.lit("|"), o, F.lit("|"), F.substring(F.coalesce(flat(place), F.lit("")), 1, 24))
    return F.when((F.length(t) > 0) & (F.length(o) > 0), key)


def first_of(df: DataFrame, keys: Sequence[Sequence[Column]], order: Sequence[Column]) -> DataFrame:
    """Rows that are first for every one of several keys in turn."""
    for key in keys:
        df = top_per_group(df, list(key), list(order), 1)
    return df


def contamination(train: DataFrame, dev: DataFrame, text: str) -> DataFrame:
    """Distinct normalised texts of the train and dev side, how many they share, and the share of dev in percent."""
    hashes = lambda df, side: df.select(text_hash(F.col(text)).alias("h"), F.lit(side).alias("side"))
    sides = hashes(train, 1).unionByName(hashes(dev, 2)).groupBy("h").agg(F.max((F.col("side") == 1).cast("int")).alias("t"), F.max((F.col("side") == 2).cast("int")).alias("d"))
    both = F.sum(F.col("t") * F.col("d"))
    return sides.agg(F.sum("t").alias("train"), F.sum("d").alias("dev"), both.alias("shared"), F.round(100.0 * both / F.sum("d"), 2).alias("percent"))


def without_contaminated(train: DataFrame, dev: DataFrame, text: str) -> DataFrame:
    return train.withColumn("__h", text_hash(F.col(text))).join(dev.select(text_hash(F.col(text)).alias("__h")).distinct(), "__h", "left_anti").drop("__h")


def split(df: DataFrame, group: Column, parts: Mapping[str, float], rest: str) -> DataFrame:
    """Adds ``split``: by the hash of the group, so that a group never lies on two sides."""
    at, edge, tests = hash_share(group), 0.0, []
    for name, share in parts.items():
        edge += share
        tests.append((edge, name))
    out = F.lit(rest)
    for edge, name in reversed(tests):
        out = F.when(at < edge, name).otherwise(out)
    return df.withColumn("split", out)


def balanced(df: DataFrame, group: str, id_column: str, cap: int, floor: int, poor: Column, poor_share: float) -> DataFrame:
    """At most ``cap`` rows a group by md5 order, at most ``poor_share`` of them poor; groups under ``floor`` are left out."""
    order = [F.md5(F.col(id_column).cast("string")), F.col(id_column)]
    sized = df.withColumn("__poor", poor)
    limited = sized.withColumn("__rn", F.row_number().over(Window.partitionBy(group, "__poor").orderBy(*order))).where(~F.col("__poor") | (F.col("__rn") <= int(cap * poor_share)))
    kept = limited.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__rn") <= cap)
    big = kept.groupBy(group).agg(F.count("*").alias("__n")).where(F.col("__n") >= floor).select(group)
    return kept.join(big, group, "left_semi").drop("__poor", "__rn")


def chat_audit(turns: DataFrame, conversation: str, turn: str, role: str, text: str, wanted: Sequence[str]) -> DataFrame:
    """Per conversation its roles in order, and whether they are exactly ``wanted`` with no empty text."""
    grouped = turns.groupBy(conversation).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, role))), lambda x: x[role]), ",").alias("roles"), F.count_if(F.length(F.btrim(text)) == 0).alias("empty"))
    return grouped.withColumn("valid", (F.col("roles") == ",".join(wanted)) & (F.col("empty") == 0))


def audit(df: DataFrame, group: str, text: Column, words: Column, most_words: int, least_words: int, known: Sequence[str]) -> DataFrame:
    """Per group: rows, exact copies, rows over and under a length, with long numbers, with two capitalised words in a row, of
    an unknown group, and the median length (the lower one)."""
    rows = df.select(F.col(group), F.sha1(text).alias("__h"), words.alias("__w"), text.rlike("[0-9]{3,}").alias("__n"), text.rlike("(^|[^A-Za-z])[A-Z][a-z]+ [A-Z][a-z]+").alias("__c"))
    copies = rows.groupBy("__h").agg(F.count("*").alias("__copies")).where("__copies > 1")
    flagged = rows.join(copies, "__h", "left")
    return flagged.groupBy(group).agg(
        F.count("*").alias("n"), F.count("__copies").alias("copies"), F.count_if(F.col("__w") > most_words).alias("cut"), F.count_if(F.col("__w") < least_words).alias("short"), F.count_if("__n").alias("numbers"), F.count_if("__c").alias("names"),
        F.count_if(~F.col(group).isin(*known)).alias("odd_language"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY __w)").cast("long").alias("median_words"),
    )


def repeated_ngrams(words: Column, n: int) -> Column:
    """How many n-grams of ``words`` are not the first of their kind."""
    def count(w: Column) -> Column:
        size = F.greatest(F.size(w) - (n - 1), F.lit(0))
        grams = F.transform(F.arrays_zip(*(F.slice(w, i + 1, size) for i in range(n))), lambda x: F.xxhash64(*(x[str(i)] for i in range(n))))
        return F.transform(F.array(grams), lambda g: F.size(g) - F.size(F.array_distinct(g)))[0]

    return F.transform(F.array(words), count)[0]  # the words are computed once, whatever is made of them


def windows_of(words: Column, size: int, overlap: int) -> Column:
    """array of word arrays of ``size`` that overlap by ``overlap``; the last one may be shorter."""
    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - overlap, F.lit(1)), F.lit(size - overlap))
        return F.transform(starts, lambda i: F.slice(w, i, size))

    return F.transform(F.array(words), cut)[0]


def by_priority(candidates: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(label, origin): the first candidate that is not null, and its name."""
    label = F.coalesce(*(c for _, c in candidates))
    origin = F.coalesce(*(F.when(c.isNotNull(), F.lit(name)) for name, c in candidates))
    return label, origin


def threshold_sweep(df: DataFrame, truth: Column, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Precision, recall and f1 at each of a few thresholds, in one pass with partial counts."""
    steps = df.select(truth.alias("t"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), F.col(score).alias("s"))
    return precision_recall(steps.withColumn("g", F.col("s") >= F.col("threshold")), F.col("t"), F.col("g"), ["threshold"])


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count("*").alias("n"))


def precision_recall(df: DataFrame, truth: Column, guess: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of a boolean guess."""
    counts = df.groupBy(*by).agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    return counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def mean_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the average rank of tied values, from counts per distinct value: values are ranked, not rows.

    Values are dealt out by ranges; each range sums up on its own, and the driver sees one count a range.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    below = running_total(counts, value, "__n", "__below")
    return df.join(below.select(value, (F.col("__below") + (F.col("__n") + 1) / 2).alias(name)), value)


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Linear correlation of two columns."""
    return df.agg(F.round(F.corr(a, b), 6).alias("pearson"))


def best_threshold(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """(threshold, f1): the score from which on rows are taken for true with the best f1; ties: the highest threshold."""
    counts = df.select(truth.alias("__t"), (-F.col(score)).alias("__s")).where(F.col("__s").isNotNull()).groupBy("__s").agg(F.count("*").alias("__n"), F.count_if("__t").alias("__p"))
    taken = running_total(running_total(counts, "__s", "__n", "__taken"), "__s", "__p", "__right")
    positives = counts.agg(F.sum("__p")).first()[0] or 0
    f1 = 2 * (F.col("__right") + F.col("__p")) / F.nullif(F.col("__taken") + F.col("__n") + F.lit(positives), F.lit(0))
    best = taken.agg(F.max(F.struct(f1.alias("f1"), (-F.col("__s")).alias("threshold"))).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"), F.round("b.f1", 6).alias("f1"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation, tied values sharing their average rank."""
    return mean_ranks(mean_ranks(df.select(a, b), a, "__ra"), b, "__rb").agg(F.round(F.corr("__ra", "__rb"), 6).alias("spearman"))


def auc(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties counted half."""
    ranked = mean_ranks(df.withColumn("__t", truth), score, "__r")
    sums = ranked.agg(F.sum(F.when(F.col("__t"), F.col("__r"))).alias("s"), F.count_if("__t").alias("p"), F.count_if(~F.col("__t")).alias("q"))
    return sums.select(F.round((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 6).alias("auc"))


# Cumulative probabilities of Poisson(1).
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917)


def poisson(at: Column) -> Column:
    """The Poisson(1) quantile of a number in [0, 1)."""
    weight = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        weight = F.when(at < POISSON[k], k).otherwise(weight)
    return weight


def bootstrap(df: DataFrame, value: Column, rounds: int, seed: int) -> DataFrame:
    """Mean of ``value`` and its 5 and 95 percent points over ``rounds`` Poisson resamples, in one pass over the rows.

    Each row's weight in round r is the Poisson(1) quantile of a hash of (seed, r, row), so rows need not be gathered.
    """
    at = F.pmod(F.xxhash64(F.lit(seed), F.col("__round"), *df.columns), F.lit(1_000_000)) / F.lit(1_000_000.0)
    rows = df.withColumn("__v", value).withColumn("__round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("__w", poisson(at))
    means = rows.groupBy("__round").agg((F.sum(F.col("__v") * F.col("__w")) / F.nullif(F.sum("__w"), F.lit(0))).alias("m"))
    return means.agg(F.round(F.percentile("m", F.lit(0.05)), 4).alias("low"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.percentile("m", F.lit(0.95)), 4).alias("high"))


def paired_bootstrap(df: DataFrame, key: str, first: Column, second: Column, rounds: int, seed: int) -> DataFrame:
    """(difference, low, high, differs): the mean of ``first`` less ``second`` over the same rows, its 5 and 95 percent
    points over ``rounds`` Poisson resamples, and whether they lie on one side of zero.

    A resample weighs a row's two values alike, by a hash of (seed, round, ``key``); rows with a null value do not count.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), (first - second).alias("d")).where("d IS NOT NULL")
    # rows of one key weigh alike, so they are added up before the rounds multiply them
    sums = rows.groupBy("k").agg(F.sum("d").alias("d"), F.count("*").alias("n"))
    each = sums.select("d", "n", "k", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    each = each.withColumn("w", poisson(hash_share(F.concat_ws("|", F.lit(str(seed)), F.col("round").cast("string"), "k"))))
    means = each.groupBy("round").agg((F.sum(F.col("d") * F.col("w")) / F.nullif(F.sum(F.col("n") * F.col("w")), F.lit(0))).alias("m"), (F.sum("d") / F.sum("n")).alias("whole"))
    ends = means.agg(F.round(F.max("whole"), 4).alias("difference"), F.round(F.percentile("m", F.lit(0.05)), 4).alias("low"), F.round(F.percentile("m", F.lit(0.95)), 4).alias("high"))
    return ends.withColumn("differs", (F.col("low") > 0) | (F.col("high") < 0))


def fuzzy_titles(df: DataFrame, known: DataFrame, id_column: str, title: str, percent: int = 85) -> DataFrame:
    """(id, known_title, jaccard) of titles whose token sets are similar to a known one.

    Titles of one token set are a class; classes are compared, and members follow by membership. Exact prefix filter:
    two sets of a Jaccard of at least t share one of their first n - ceil(t * n) + 1 tokens in any fixed order, so only
    these are joined (by their hashes), rarest first, with the sizes and the places of a shared token as bounds.
    """
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda w: w != "")))
    named = lambda rows, *columns: rows.select(*columns, tokens.alias("t")).where(F.size("t") > 0).withColumn("set", F.unhex(F.md5(F.array_join("t", " "))))
    left = cut(named(df, F.col(id_column)))
    right = cut(named(known.select(title).distinct(), F.col(title).alias("known_title")))
    sides = left.select("set", "t", F.lit(True).alias("asks"), F.lit(False).alias("known")).unionByName(right.select("set", "t", F.lit(False).alias("asks"), F.lit(True).alias("known")))
    classes = cut(sides.groupBy("set").agg(F.any_value("t").alias("t"), F.bool_or("asks").alias("asks"), F.bool_or("known").alias("known")))
    words = classes.select("set", "asks", "known", F.size("t").alias("n"), F.explode(F.transform("t", lambda w: F.xxhash64(w))).alias("w"))
    order = words.groupBy("w").agg(F.count("*").alias("df"))
    keep = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    ranked = words.join(order, "w").groupBy("set", "asks", "known", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    prefixes = cut(ranked.select("set", "asks", "known", "n", F.posexplode(F.slice(F.col("o")["w"], 1, keep)).alias("i", "w")))
    a, b = (prefixes.where(side).select("w", F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("i").alias(f"i{x}")) for x, side in (("a", "asks"), ("b", "known")))
    shared = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    likely = (F.col("a") != F.col("b")) & ((100 + percent) * shared >= percent * (F.col("na") + F.col("nb")))
    pairs = a.join(b, "w").where(likely).select("a", "b").distinct()
    x, y = (classes.select(F.col("set").alias(k), F.col("t").alias(f"t{k}")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("ta", "tb"))).withColumn("union", F.size("ta") + F.size("tb") - F.col("common"))
    alike = both.where(100 * F.col("common") >= percent * F.col("union")).select("a", "b", F.round(F.col("common") / F.col("union"), 4).alias("jaccard"))
    same = classes.where("asks AND known").select(F.col("set").alias("a"), F.col("set").alias("b"), F.lit(1.0).alias("jaccard"))
    found = left.select(id_column, F.col("set").alias("a")).join(cut(alike.unionByName(same)), "a")
    return found.join(right.select("known_title", F.col("set").alias("b")), "b").select(id_column, "known_title", "jaccard")


def rarest_first(rows: DataFrame, percent: int) -> DataFrame:
    """(k, n, skip, p, bits) of ``rows`` (k, n, h), as ``alike.prefixes`` gives them."""
    # every task ranks tokens alike, by a byte of each of a fixed number of counters
    rank = bytearray(alike.COUNTERS)
    for chunk, part in rows.select("h").mapInArrow(alike.counted, "chunk int, at binary, n binary").groupBy("chunk").applyInArrow(alike.ranks, "chunk int, ranks binary").collect():
        rank[chunk * alike.CHUNK : (chunk + 1) * alike.CHUNK] = part
    shared = rows.sparkSession.sparkContext.broadcast(bytes(rank))
    return rows.select("k", "n", "h").mapInArrow(lambda batches: alike.prefixes(batches, shared.value, percent), "k long, n int, skip int, p array<int>, bits binary")


def likely_alike(heads: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of ``heads`` that share a hash of their prefixes and whose sizes, places and parities allow the rest."""
    # a token's place bounds the sizes of the sets that can be alike, so the smaller set asks for one band of sizes or two
    width = max(1.5 * math.log(100 / percent), 1e-6)
    band = lambda n: F.floor(F.log(n) / width).cast("int")
    places = heads.select("k", "n", "skip", "p", F.posexplode("p").alias("i", "w")).select("k", "n", (F.col("skip") + F.col("i")).alias("i"), "w", F.get("p", F.col("i") - 1).alias("v"))
    largest = F.floor((100 + percent) * (F.col("n") - F.col("i")) / percent) - F.col("n")
    short = places.where(largest >= F.col("n")).withColumn("band", F.explode(F.sequence(band("n"), band(largest))))
    side = lambda rows, x: rows.select(F.hash("w", "band").alias("w"), *(F.col(c).alias(c + x) for c in "kniv"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ka") < F.col("kb")))
    likely = (100 + percent) * F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= percent * (F.col("na") + F.col("nb"))
    # where the tokens before are the same, too, these give the pair
    again = F.coalesce(F.col("va") == F.col("vb"), F.lit(False))
    pairs = side(short, "a").join(side(places.withColumn("band", band("n")), "b"), "w").where(smaller & likely & ~again).select(F.col("ka").alias("a"), F.col("kb").alias("b")).distinct()
    bits = lambda x: heads.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    close = (100 + percent) * alike.differing("bitsa", "bitsb") <= (100 - percent) * (F.col("na") + F.col("nb"))
    return pairs.join(bits("a"), "a").join(bits("b"), "b").where(close).select("a", "b")


def alike_texts(df: DataFrame, id_column: str, text: str, percent: int = 85) -> DataFrame:
    """(id, known_id, jaccard) of whole texts alike in their token sets, each to the representatives of all classes.

    Texts of one token set are a class, represented by the smallest id; only classes are compared, then members follow
    by membership. Exact prefix filter as in ``fuzzy_titles``, on 32-bit hashes of the tokens, with the sizes and the
    places of a shared token as bounds; parities of the sets rule out what shares a rare token by chance. Only the sets of
    classes that still have a pair are read again, and go to the cells of pairs that compare them, not to each pair.
    """
    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    joined = F.array_join(F.sort_array("t"), " ")
    digest = lambda words: F.unhex(F.sha2(words, 256))
    texts = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    few = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    numbered = texts.select("id", tokens.alias("t"), F.monotonically_increasing_id().alias("k")).where(F.size("t") > 0)
    hashed = numbered.select("id", "k", F.size("t").alias("n"), digest(joined).alias("set"), F.transform("t", lambda w: F.hash(w)).alias("h"))
    with ExitStack() as later:
        with lent(hashed) as rows:
            classes = cut(rows.groupBy("set").agg(F.min("id").alias("rep"), F.min("k").alias("k"), F.min_by("id", "k").alias("own"), F.any_value("n").alias("n")).where("rep IS NOT NULL"))
            copies = cut(rows.select("id", "k", "set").join(classes.select("k"), "k", "left_anti"))
            heads = later.enter_context(lent(rarest_first(rows, percent).join(few(copies.select("k")), "k", "left_anti")))
        near = cut(likely_alike(heads, percent))
    members = classes.select(F.col("own").alias("id"), "rep").union(classes.select("set", "rep").join(few(copies), "set").select("id", "rep"))

    # pairs around one class go to one cell, so a set goes to few; a crowd is dealt out to cells by both of its sides
    least = near.select("a", "b").union(near.select("b", "a")).groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    size = least.join(classes.select(F.col("k").alias("a"), "n"), "a").agg(F.sum("n")).first()[0] or 0
    cells = max(df.sparkSession.sparkContext.defaultParallelism, size // CELL_TOKENS)
    around = near.join(least, "a")
    crowds = around.groupBy("m").agg(F.ceil(F.sqrt(F.count("*") / CELL_PAIRS)).alias("parts")).where("parts > 1")
    dealt = lambda key, parts: F.pmod(F.xxhash64(key), parts)
    cell = F.xxhash64(dealt("m", F.lit(cells)), dealt("a", F.coalesce("parts", F.lit(1))), dealt("b", F.coalesce("parts", F.lit(1))))
    placed = around.join(F.broadcast(crowds), "m", "left").select(cell.alias("cell"), "a", "b")

    # the sets of the classes in pairs, from texts with the id and the tokens of one
    homes = placed.select(F.explode(F.array("a", "b")).alias("k"), "cell").groupBy("k").agg(F.collect_set("cell").alias("homes"))
    wanted = cut(classes.select("k", F.col("rep").alias("id"), "set").join(few(cut(homes)), "k"))
    # with a column that is not deterministic, tokens are made once a row and after the join
    read = texts.join(few(wanted), "id").select("k", F.col("id").alias("rep"), "set", "homes", tokens.alias("t"), F.monotonically_increasing_id().alias("row"))
    read = read.where("row >= 0").select("k", "rep", "set", "homes", joined.alias("words"), F.monotonically_increasing_id().alias("row"))
    sets = read.where((digest(F.col("words")) == F.col("set")) & (F.col("row") >= 0)).select(F.explode("homes").alias("home"), "k", "rep", "words")
    kind = df.schema[id_column].dataType.simpleString()
    found = placed.groupBy("cell").cogroup(sets.groupBy("home")).applyInArrow(lambda pairs, sets: alike.compared(pairs, sets, percent), f"rep_a {kind}, rep_b {kind}, common long, total long")

    way = lambda a, b: F.struct(F.col(a).alias("rep"), F.col(b).alias("known_id"))
    ways = found.select(F.explode(F.array(way("rep_a", "rep_b"), way("rep_b", "rep_a"))).alias("way"), F.round(F.col("common") / F.col("total"), 4).alias("jaccard"))
    ways = ways.select("way.*", "jaccard").union(classes.select("rep", "rep", F.lit(1.0)))
    return members.join(ways, "rep").select(F.col("id").alias(id_column), "known_id", "jaccard")


def soft_match(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Micro precision, recall and f1 of lists, where two entries agree if one contains the other (lower case)."""
    agree = lambda x, y: F.contains(F.lower(x), F.lower(y)) | F.contains(F.lower(y), F.lower(x))
    hits = lambda a, b: F.size(F.filter(F.col(a), lambda x: F.exists(F.col(b), lambda y: agree(x, y))))
    sums = df.agg(F.sum(hits(guess, truth)).alias("right"), F.sum(F.size(guess)).alias("given"), F.sum(hits(truth, guess)).alias("found"), F.sum(F.size(truth)).alias("wanted"))
    p, r = F.col("right") / F.nullif("given", F.lit(0)), F.col("found") / F.nullif("wanted", F.lit(0))
    return sums.select(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 4).alias("f1"))
