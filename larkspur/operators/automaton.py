"""Label matching by one automaton over words: all labels are looked for in one pass over each text.

The automaton is a trie of the labels' words with a failure link for each state, held as flat arrays. It is built once
on the driver and sent to all workers if its labels take at most ``AUTOMATON_BYTES``; a larger vocabulary is joined on
runs of words instead (``entities.matched``), with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entities import matched, words_of

AUTOMATON_BYTES = 64 << 20
SHORTEST, LONGEST, MOST = 4, 60, 25
WORD = regex.compile(r"[\p{L}\p{N}+#]+")


class Automaton:
    """Finds sequences of words. States are numbers, 0 the start; ``edges`` holds state << 32 | word in order."""

    def __init__(self, terms: Iterable[Sequence[str]]):
        words: dict[str, int] = {}
        goto: dict[int, int] = {}
        parent, via, depth, ends = [0], [0], [0], [-1]
        for number, term in enumerate(terms):
            state = 0
            for word in term:
                edge = state << 32 | words.setdefault(word, len(words))
                state = goto.get(edge, 0)
                if not state:
                    state = goto[edge] = len(parent)
                    parent.append(edge >> 32)
                    via.append(edge & 0xFFFFFFFF)
                    depth.append(depth[parent[-1]] + 1)
                    ends.append(-1)
            if state:
                ends[state] = number
        fail, link = [0] * len(parent), [0] * len(parent)
        for state in sorted(range(1, len(parent)), key=depth.__getitem__):
            back = fail[parent[state]]
            while back and back << 32 | via[state] not in goto:
                back = fail[back]
            fail[state] = goto.get(back << 32 | via[state], 0) if depth[state] > 1 else 0
            link[state] = fail[state] if ends[fail[state]] >= 0 else link[fail[state]]
        self.words = "\n".join(words)
        edges = sorted(goto)
        self.edges, self.to = np.array(edges, np.int64), np.array([goto[e] for e in edges], np.int32)
        self.fail, self.ends, self.link = (np.array(x, np.int32) for x in (fail, ends, link))
        self._open = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": None}

    def find(self, words: Iterable[str]) -> set[int]:
        """Numbers of the terms that stand in ``words``."""
        if self._open is None:  # once a worker
            numbers = {w: i for i, w in enumerate(self.words.split("\n"))}
            self._open = numbers, dict(zip(self.edges.tolist(), self.to.tolist(), strict=True)), self.fail.tolist(), self.ends.tolist(), self.link.tolist()
        numbers, goto, fail, ends, link = self._open
        state, met = 0, set()
        for word in words:
            number = numbers.get(word)
            if number is None:
                state = 0
                continue
            step = goto.get(state << 32 | number)
            while step is None and state:
                state = fail[state]
                step = goto.get(state << 32 | number)
            state = step or 0
            if state:
                met.add(state)
        found: set[int] = set()
        for state in met:
            while state and ends[state] not in found:
                if ends[state] >= 0:
                    found.add(ends[state])
                state = link[state]
        return found


def accepted(vocabulary: DataFrame, unwanted: Sequence[str]) -> DataFrame:
    """(gram, name, lang) of the labels to look for; ``vocabulary``: label, name, lang, preferred.

    A label has 4 to 60 characters and is not unwanted. One of a single word must be a preferred one, and counts in its
    language only (never without one); longer ones count in all languages.
    """
    words = words_of(F.col("label"))
    spelled = vocabulary.withColumn("__words", words).withColumn("gram", F.array_join("__words", " "))
    spelled = spelled.where(F.length("gram").between(SHORTEST, LONGEST) & ~F.col("gram").isin("", *unwanted))
    single = F.size("__words") == 1
    kept = spelled.where(~single | (F.coalesce("preferred", F.lit(False)) & F.col("lang").isNotNull()))
    return kept.select("gram", F.col("name"), F.when(single, F.col("lang")).alias("lang")).distinct()


def label_names(df: DataFrame, id_column: str, text: str, language: str, vocabulary: DataFrame, unwanted: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """(id, names): the names of all labels that stand in the text as whole words, sorted, at most ``most``.

    Texts without a label are left out; null texts hold none; ids that repeat give a row each.
    """
    entries = accepted(vocabulary, unwanted)
    size = entries.agg(F.sum(F.octet_length("gram") + F.octet_length("name")).alias("n")).first().n or 0
    if size > AUTOMATON_BYTES:
        # a row is its id, text and language; numbers given to rows would not survive a second reading
        key = F.sha2(F.to_json(F.struct(F.col(id_column), F.col(text), F.col(language)), {"ignoreNullFields": "false"}), 256)
        rows = df.select(key.alias("__row"), id_column, F.col(text).alias("__text"), F.col(language).alias("__language"))
        found = matched(rows.drop(id_column).distinct(), "__row", "__text", entries, "gram", ("__language", "lang"))
        names = found.groupBy("__row").agg(F.slice(F.array_sort(F.collect_set("name")), 1, most).alias("names"))
        return rows.select("__row", id_column).join(names, "__row").select(id_column, "names")
    grams: dict[str, list[tuple[str, str | None]]] = {}
    for r in entries.collect():  # bounded by the check above
        grams.setdefault(r.gram, []).append((r["name"], r.lang))
    terms = sorted(grams)
    shared = df.sparkSession.sparkContext.broadcast((Automaton(t.split(" ") for t in terms), [grams[t] for t in terms]))

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        automaton, meanings = shared.value
        for texts, languages in batches:
            out = []
            for words, lang in zip(texts, languages, strict=True):
                numbers = automaton.find(WORD.findall(words)) if words else ()
                out.append(sorted({name for n in numbers for name, own in meanings[n] if own is None or own == lang})[:most])
            yield pd.Series(out)

    return df.select(id_column, find(F.lower(F.col(text)), F.col(language)).alias("names")).where(F.size("names") > 0)


def label_pairs(words: Column) -> Column:
    """Neighbouring words of an array, joined by a blank."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.transform(F.arrays_zip(F.slice(words, 1, n), F.slice(words, 2, n)), lambda z: F.concat_ws(" ", z["0"], z["1"]))
