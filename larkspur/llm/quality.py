"""Quality rules: per-document counts and cross-document line frequency, all in Catalyst expressions.

Line frequency: lines are normalised (outer white space stripped, lower case) and hashed; distinct documents are
counted per host (the ``source`` column) and line hash. A line is boilerplate when at least ``MIN_DOCS`` documents of
its host hold it and they are more than ``MAX_SHARE`` of the host's documents or at least ``MAX_DOCS``, a limit that
does not grow with the host. Documents that keep less than ``MIN_KEPT`` of their words, or fewer than ``MIN_WORDS``,
after boilerplate lines go are depleted and rejected.

Each text is split once; hashes and word counts of its lines are stored, and all later steps read those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import forget, stored

WORD = r"[^\x20\x09-\x0D]+"
WORD_SPLIT = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOL = "[#*$%&|<>]"
MIN_DOCS = 10
MAX_SHARE = 0.01
MAX_DOCS = 1000
MIN_KEPT = 0.3
MIN_WORDS = 50
#: Boilerplate lines up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it for ``body`` (an array of one element, transformed)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """array of words [^\\x20\\x09-\\x0D]+ of ``text``."""
    return F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """How many words lie in 3-word windows that the text holds at least twice (first occurrences included).

    ``words`` must be bound (an attribute or a lambda variable). Only texts in which some window's hash repeats sort
    their windows.
    """
    n = F.greatest(F.size(words) - 2, F.lit(0))
    windows = F.transform(F.arrays_zip(F.slice(words, 1, n), F.slice(words, 2, n), F.slice(words, 3, n)), lambda x: F.xxhash64(x["0"], x["1"], x["2"]))

    def placed(ks: Column) -> Column:
        return let(F.sort_array(F.transform(ks, lambda k, i: F.struct(k.alias("k"), i.alias("p")))), repeated)

    def repeated(s: Column) -> Column:
        m = F.greatest(F.size(s) - 1, F.lit(0))
        pairs = F.filter(F.arrays_zip(F.slice(s, 1, m), F.slice(s, 2, m)), lambda z: z["0"]["k"] == z["1"]["k"])
        starts = F.flatten(F.transform(pairs, lambda z: F.array(z["0"]["p"], z["1"]["p"])))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    return let(windows, lambda ks: F.when(F.size(F.array_distinct(ks)) == F.size(ks), F.lit(0)).otherwise(placed(ks)))


def word_counts(words: Column) -> Column:
    """struct(n, chars, repeated) of an array of words."""
    return let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).cast("long").alias("repeated")))


def line_key(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(SPACE_CHARS)))


def boilerplate_lines(base: DataFrame, min_docs: int, max_share: float, max_docs: int) -> DataFrame:
    """(host, line) held by at least ``min_docs`` documents of the host, and by more than ``max_share`` of them or ``max_docs``."""
    held = base.select("host", "doc", F.explode(F.array_distinct("lines.line")).alias("line"))
    # counted in two steps: (host, line, doc) first, so that a line that all documents hold is spread over all tasks
    counts = held.groupBy("host", "line").agg(F.count_distinct("doc").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    hosts = base.groupBy("host").agg(F.count_distinct("doc").alias("host_docs"))
    return counts.join(hosts, "host").where((F.col("n_docs") > F.col("host_docs") * max_share) | (F.col("n_docs") >= max_docs)).select("host", "line")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document with the counts, base_failed, the words on boilerplate lines, and kept.

    Null text counts as empty (no words, base_failed). A null host is a host of its own. Documents of a host are told
    apart by id, those without an id by text: repeated rows count once and get the same verdict each. Texts of any
    length are read whole. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(host_col).isNull(), F.col(host_col)).alias("host"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("parts"),
    )
    base = rows.select(
        "doc_id", "host", "text_hash",
        F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id"), F.col("text_hash"))).alias("doc"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("parts") - F.size(F.array_distinct("parts"))).cast("long").alias("n_dup_lines"),
        word_counts(words_of(F.col("text"))).alias("w"),
        F.transform("parts", lambda x: F.struct(F.xxhash64(line_key(x)).alias("line"), F.size(words_of(x)).alias("words"))).alias("lines"),
    )
    base = stored(base, "quality-lines")
    boilerplate = stored(boilerplate_lines(base, min_docs, max_share, max_docs), "quality-boilerplate")
    known = F.broadcast(boilerplate) if boilerplate.count() <= BROADCAST_ROWS else boilerplate
    lost = (
        base.select("doc_id", "host", "text_hash", F.posexplode("lines").alias("at", "l"))
        .select("doc_id", "host", "text_hash", "at", "l.line", "l.words").join(known, ["host", "line"])
        .groupBy("doc_id", "host", "text_hash", "at").agg(F.max("words").alias("words"))
        .groupBy("doc_id", "host", "text_hash").agg(F.sum("words").alias("lost"))
        .select(F.col("doc_id").alias("lost_id"), F.col("host").alias("lost_host"), F.col("text_hash").alias("lost_hash"), "lost")
    )
    lost = stored(lost, "quality-lost")
    forget(boilerplate)
    same = F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("host") == F.col("lost_host")) & (F.col("text_hash") == F.col("lost_hash"))
    done = base.join(lost, same, "left").select("doc_id", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("w.repeated").alias("n_repeat_words"), F.coalesce("lost", F.lit(0)).cast("long").alias("n_boilerplate_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    enough = (left >= min_kept * F.col("n_words")) & (left >= min_words)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & enough).alias("kept"), "n_boilerplate_words")
