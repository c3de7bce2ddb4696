"""Secret scan: pattern spans, plus credential values whose guess cost is high.

The guess cost of a value is the least total log10 guesses over all its segmentations (dynamic programming over end
positions) into

- words: the rank among common words, those of the corpus (the most frequent ``MOST_WORDS``, held by many texts) and a
  fixed list of what passwords and placeholders are made of;
- dates;
- repeats: the unit of up to ``MOST_UNIT`` characters that goes before, ``k`` times in all: log10(k);
- keyboard walks: neighbouring keys, or letters in the order of the alphabet;
- single characters by brute force.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import forget, stored, with_python_columns

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
# a whole name and a sign of assignment; or the password of an address with a user
NAMED = re.compile(r"""(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)["']?[\x20\t]*+(?::=|=>|[:=])|://[^\s/:@]++:([^\s/@]++)@""")
# the value after a sign, looked for only behind the name of a credential, so that no text is read once for each name
VALUE = re.compile(r"""[\x20\t]*+(?ai:(?:bearer|basic)[\x20\t]++)?(?:"([^"\n]+)"|'([^'\n]+)'|`([^`\n]+)`|["'`]?([^\s"'`<>,;]+))""")
# a name speaks of a credential if such a word stands in it, at its end or before another part of the name
CREDENTIAL = re.compile(r"(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|authorization|auth|credentials?|login|bearer)(?:$|[_0-9-]|[A-Z][a-z])")
MIN_GUESSES = 10.0
MOST_WORDS = 20_000
#: A common word is held by texts of at least so many of 64 hash classes, so copies of one text do not make it common.
LEAST_CLASSES = 8
MOST_UNIT = 16

# Common words of passwords and placeholders, most common first (their place is their rank).
WORDS = (
    "password pass word admin user login welcome secret master root test guest example sample demo default change changeme "
    "letmein monkey dragon football baseball iloveyou sunshine princess shadow superman batman trustno access hello freedom "
    "whatever hunter summer winter spring autumn flower cookie cheese computer internet server database system service token "
    "private public key your here none null true false undefined placeholder redacted hidden empty required optional string "
    "value text number field input output file path name email account basic bearer api app web site home house love baby angel "
    "michael jordan michelle jessica daniel thomas charlie robert matthew andrew joshua george jennifer monday friday january "
    "december london paris berlin madrid america england france germany spain soccer hockey tiger lion eagle silver gold "
    "purple orange yellow green blue black white red star moon sun"
).split()
LISTED: Mapping[str, int] = {w: i + 1 for i, w in enumerate(WORDS)}
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz")
NEXT = {(a, b) for row in KEYBOARD for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
YEAR, MONTH, DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
DATES = [re.compile(p, re.ASCII) for p in (rf"{YEAR}([-/._]?){MONTH}\1{DAY}", rf"{DAY}([-/._]?){MONTH}\1{YEAR}", rf"{MONTH}([-/._]?){DAY}\1{YEAR}", YEAR)]
WALK_START, DATE_GUESSES = math.log10(47), math.log10(365 * 120)
LEAST_SPAN = 3  # characters of a word or a walk


def char_cost(c: str) -> float:
    if "0" <= c <= "9":
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log10(26)
    return math.log10(33) if c < "\x7f" else 2.0


def word_cost(rank: int, cased: bool) -> float:
    return math.log10(rank * (2 if cased else 1) + 1)


class Starts:
    """Start positions from which a span goes on, with the cost so far; the price of a span is the log of its length.

    As a span grows, an earlier start only gains on a later one. So a later start that costs as much as an earlier one
    is dropped for good, and so is an earlier one that was dearer to reach; few are ever left.
    """

    __slots__ = ("held",)

    def __init__(self):
        self.held: list[tuple[int, float]] = []

    def add(self, at: int, cost: float) -> None:
        while self.held and self.held[-1][1] >= cost:
            self.held.pop()
        self.held.append((at, cost))

    def least(self, end: int, fixed: float, unit: int, ahead: int) -> float:
        """The least cost of a span that ends at ``end``: fixed + log10(ahead + length / unit)."""
        out, left = math.inf, []
        for at, cost in self.held:
            total = cost + fixed + math.log10(ahead + (end - at) / unit)
            if total < out:
                out = total
                left.append((at, cost))
        self.held = left
        return out


def guess_cost(value: str, ranks: Mapping[str, int] = LISTED, longest: int | None = None, enough: float = math.inf) -> float:
    """Least log10 guesses over all segmentations of ``value``, or ``enough`` if it is no less; 0 for an empty value.

    Costs only add up, so positions that cost ``enough`` to reach are given up: a long random value ends early.
    """
    longest = longest or max(map(len, ranks), default=0)
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    best = [0.0] + [math.inf] * n
    walk, walk_from = Starts(), 0
    same = [0] * (MOST_UNIT + 1)  # for each unit, how many characters equal those a unit before
    repeats: dict[tuple[int, int], Starts] = {}
    dates: dict[int, list[int]] = {}
    last = 0
    for i in range(1, n + 1):
        c = low[i - 1]
        at = i - 1
        if "0" <= c <= "9":
            for end in {m.end() for p in DATES if (m := p.match(low, at))}:
                dates.setdefault(end, []).append(at)
        cost = best[at] + char_cost(value[at])
        for size in range(LEAST_SPAN, min(longest, i) + 1):
            if best[i - size] < enough and (rank := ranks.get(low[i - size : i])):
                cost = min(cost, best[i - size] + word_cost(rank, value[i - size : i] != low[i - size : i]))
        if i > 1 and (low[i - 2], c) not in NEXT:
            walk, walk_from = Starts(), at
        if i - walk_from >= LEAST_SPAN:
            if best[i - LEAST_SPAN] < enough:
                walk.add(i - LEAST_SPAN, best[i - LEAST_SPAN])
            cost = min(cost, walk.least(i, WALK_START, 1, 0))
        for unit in range(1, min(MOST_UNIT, at) + 1):
            if low[at] != low[at - unit]:
                if same[unit]:
                    same[unit] = 0
                    for k in range(unit):
                        repeats.pop((unit, k), None)
                continue
            same[unit] += 1
            if same[unit] >= unit:
                own = repeats.setdefault((unit, i % unit), Starts())
                if best[i - unit] < enough:
                    own.add(i - unit, best[i - unit])
                cost = min(cost, own.least(i, 0.0, unit, 1))
        for start in dates.pop(i, ()):
            cost = min(cost, best[start] + DATE_GUESSES)
        if cost < enough:
            best[i], last = cost, i
        elif i - last > longest and not walk.held and not any(s.held for s in repeats.values()) and not dates:
            return enough
    return min(best[n], enough)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the pattern kinds, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guessed_spans(text: str, base: list[tuple[int, int, str]], min_guesses: float = MIN_GUESSES, ranks: Mapping[str, int] = LISTED, longest: int | None = None) -> list[tuple[int, int, str]]:
    """Values in credential contexts, outside the base spans, that cost at least 10 ** ``min_guesses`` guesses."""
    if ":" not in text and "=" not in text:
        return []
    apart: list[list[int]] = []  # the stretches that base spans cover
    for start, _, end in base:
        if apart and start < apart[-1][1]:
            apart[-1][1] = max(apart[-1][1], end)
        else:
            apart.append([start, end])
    found, at = [], 0
    while m := NAMED.search(text, at):
        bare = True
        if m[1] is not None:
            if not CREDENTIAL.search(m[1]):
                at = m.end(1)
                continue
            name, m = m, VALUE.match(text, m.end())
            if m is None:
                at = name.end()
                continue
            bare = m.lastindex == 4
        at = m.end()
        start, end = m.span(m.lastindex)
        while bare and end > start and text[end - 1] in ".)]}!?":
            end -= 1
        before = bisect.bisect_left(apart, [end]) - 1
        if (before < 0 or apart[before][1] <= start) and guess_cost(text[start:end], ranks, longest, min_guesses) >= min_guesses:
            found.append((start, 3, end))
    return found


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def common_words(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS, least_classes: int = LEAST_CLASSES) -> dict[str, int]:
    """{word: rank} of the most frequent words (3 to 32 letters, lower case) of all texts, ties by the word.

    Only words that texts of at least ``least_classes`` of 64 hash classes hold, and only those more frequent than the
    one after the first ``most``: the driver gets ``most`` rows at most, wherever they lie, and one for each power of two
    and for each number of occurrences between two of them.
    """
    words = docs.select(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{text_col}`), 64) as int))").alias("class"), F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word"))
    words = words.where(F.length("word").between(LEAST_SPAN, 32))
    counts = words.groupBy("word").agg(F.count("*").alias("n"), F.bit_or("class").alias("classes")).where(F.bit_count("classes") >= least_classes).select("word", "n")
    counts = stored(counts, "word-counts")
    size = F.floor(F.log2("n"))
    floor, taken = 0, 0  # words that occur more than ``floor`` times are at most ``most``
    for power, k in sorted(((r[0], r[1]) for r in counts.groupBy(size).count().collect()), reverse=True):
        if taken + k <= most:
            taken += k
            continue
        for n, same in sorted(((r[0], r[1]) for r in counts.where(size == power).groupBy("n").count().collect()), reverse=True):
            if taken + same > most:
                floor = n
                break
            taken += same
        break
    top = counts.where(F.col("n") > floor).collect()
    forget(counts)
    return {r.word: i + 1 for i, r in enumerate(sorted(top, key=lambda r: (-r.n, r.word)))}


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_guesses: float = MIN_GUESSES, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, counts of the pattern kinds, base_sha256 and all spans (kind:start:end, code points) of every row, then
    n_guess, the number of added spans.

    Null text counts as empty: no spans, the digest of nothing. Texts and values of any length are read whole. Words that
    tie in frequency rank by spelling. Repeated rows give repeated results; an empty table gives no rows; other columns
    are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ranks = common_words(narrow, most=most_words)
    for word, rank in LISTED.items():
        ranks[word] = min(rank, ranks.get(word, rank))
    shared = docs.sparkSession.sparkContext.broadcast((ranks, max(map(len, ranks))))

    def make(texts):
        known, longest = shared.value
        for text in texts:
            base = base_spans(text or "")
            guessed = guessed_spans(text or "", base, min_guesses, known, longest)
            yield (*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + guessed)), len(guessed))

    outputs = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string", "n_guess": "long"}
    return with_python_columns(narrow, ["text"], outputs, make, drop=("text",))
