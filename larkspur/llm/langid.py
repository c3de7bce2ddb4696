"""Language identification by hierarchical discrimination.

A multinomial linear model first picks the language family; one-versus-one linear support vector machines then vote
among the learned languages of that family. Features are hashed letter 1- to 3-grams of the whole text. The models are
fitted on the driver from a bounded sample: about ``SAMPLE_PER_LANG`` labelled training texts a language, drawn by their
hash, of at most ``MOST_LANGS`` languages; feature vectors have a fixed length, so what reaches the driver has a fixed bound per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import with_python_columns

SAMPLE_PER_LANG = 500
MOST_LANGS = 256
BUCKETS = (256, 2048, 4096)
DIMS = sum(BUCKETS)
UNDETERMINED = "und"
#: Below this score the pipeline's language stage takes a document for none of the learned languages.
MIN_SCORE = 0.2

# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt", "am"),
    "indo-aryan": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
    "sinitic": ("zh", "yue"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def features(text: str | None) -> np.ndarray | None:
    """Unit-length square-root frequencies of hashed letter n-grams (word ends count as a letter); None without letters."""
    if not text:
        return None
    letters = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not letters.any():
        return None
    keep = np.ones(len(letters) + 1, bool)
    letters = np.concatenate([np.zeros(1, np.uint32), letters])
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
    x = letters[keep].astype(np.uint64)
    out, gram = [], x[x != 0]
    for n, size in enumerate(BUCKETS, 1):
        if n > 1:
            gram = x[: len(x) - n + 1].copy()
            for k in range(1, n):
                gram = gram * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - n + 1 + k]
        hashed = (gram * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - size.bit_length() + 1)
        counts = np.sqrt(np.bincount(hashed.astype(np.int64), minlength=size).astype(np.float32))
        norm = np.sqrt((counts * counts).sum())
        out.append(counts / norm if norm else counts)
    return np.concatenate(out) / np.float32(np.sqrt(len(BUCKETS)))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 2 when divided by 4: never learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def descend(x: np.ndarray, gradient, shape: tuple, steps: int = 300, rate: float = 2.0) -> np.ndarray:
    """Full-batch gradient descent with momentum."""
    w, v = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    for _ in range(steps):
        v = 0.9 * v - rate * gradient(w)
        w = w + v
    return w


class Model:
    """families: linear softmax over families; duels: {(a, b): weights} positive for a. A last weight is the bias."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.family_of = {code: FAMILY_OF.get(code, code) for code in self.langs}
        self.families = sorted(set(self.family_of.values()))
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        y = np.array([self.families.index(self.family_of[code]) for code in langs])
        weight = (1 / np.bincount(y, minlength=len(self.families))[y] / len(self.families)).astype(np.float32)
        hot = np.eye(len(self.families), dtype=np.float32)[y]

        def softmax_gradient(w):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            return x.T @ ((p - hot) * weight[:, None]) + np.float32(1e-4) * w

        self.family_w = descend(x, softmax_gradient, (x.shape[1], len(self.families)))
        codes = np.array(langs)
        self.duels = {}
        for a, b in combinations(self.langs, 2):
            if self.family_of[a] == self.family_of[b]:
                rows = (codes == a) | (codes == b)
                xs, sign = x[rows], np.where(codes[rows] == a, 1, -1).astype(np.float32)
                w8 = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum()).astype(np.float32)

                def hinge_gradient(w, xs=xs, sign=sign, w8=w8):
                    slack = np.maximum(0, 1 - sign * (xs @ w))
                    return -2 * (xs.T @ (sign * slack * w8)) + np.float32(1e-4) * w

                self.duels[a, b] = descend(xs, hinge_gradient, (x.shape[1],), rate=0.5)

    def predict(self, f: np.ndarray) -> tuple[str, float]:
        z = f @ self.family_w[:-1] + self.family_w[-1]
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        members = [code for code in self.langs if self.family_of[code] == self.families[best]]
        if len(members) == 1:
            return members[0], float(p[best])
        votes, trust = dict.fromkeys(members, 0.0), {}
        for (a, b), w in self.duels.items():
            if a in votes:
                margin = float(f @ w[:-1] + w[-1])
                votes[a if margin >= 0 else b] += 1 + 1e-3 * min(abs(margin), 9)
                trust[a, b] = 1 / (1 + np.exp(-4 * margin))
        winner = max(members, key=lambda c: (votes[c], c))
        sure = min(t if a == winner else 1 - t for (a, b), t in trust.items() if winner in (a, b))
        return winner, float(min(1.0, max(0.0, p[best] * sure)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG, most_langs: int = MOST_LANGS) -> Model | None:
    """A model from the labelled rows that are not held out; None if there is none with a letter.

    The driver gets about ``per_lang`` different texts of each of the ``most_langs`` languages with most of them (ties: by
    name), whatever the table holds: texts are drawn by their hash, equal ones count once.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col(id_col)))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not counts:
        return None
    space = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("text")), F.lit(space))
    chosen = None
    for lang, n in sorted(counts.items()):
        part = (F.col("lang") == lang) & (draw < int(min(1.0, per_lang / n) * space))
        chosen = part if chosen is None else chosen | part

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(lang, f) for lang, f in zip(batch["lang"], map(features, batch["text"]), strict=True) if f is not None]
            at = [np.flatnonzero(f) for _, f in made]
            yield pd.DataFrame({"lang": [lang for lang, _ in made], "at": [i.astype("<u2").tobytes() for i in at], "value": [f[i].astype("<f4").tobytes() for i, (_, f) in zip(at, made, strict=True)]})

    got = rows.where(chosen).select("lang", "text").distinct().mapInPandas(run, "lang string, at binary, value binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.value)))
    x = np.zeros((len(got), DIMS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.at, "<u2")] = np.frombuffer(r.value, "<f4")
    return Model(x, [r.lang for r in got])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with lang_pred and score; columns of those names are replaced.

    Null, empty or letterless text, and any text under no model, gets ``und`` with score 0. Whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts):
        found = shared.value
        for text in texts:
            f = features(text) if found is not None else None
            yield (UNDETERMINED, 0.0) if f is None else found.predict(f)

    return with_python_columns(docs, [text_col], {"lang_pred": "string", "score": "double"}, make)


def language_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learns from the rows that are not held out.

    Null lang rows are predicted but not learned from; null text is ``und``; rows without an id are not held out; texts of
    any length are read whole; of languages that tie in votes the last by name wins; repeated rows are predicted alike and
    learned from once; an empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, id_col, text_col, lang_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return identify(narrow, model).drop("text")


def keep_known_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose whole text is in a learned language (score of ``min_score`` at least), with their own columns."""
    model = fit(docs, id_col, text_col, lang_col)
    narrow = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    known = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)
    return identify(narrow, model).where(known).select("row.*")
