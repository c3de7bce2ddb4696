"""Personal data: pattern spans, plus spans decoded by a linear-chain conditional random field over word shapes.

The field is trained on the driver from a small labelled table (sentences made from the templates below by a fixed
seed). Tokens are runs without white space. Tokens that hold a digit (of any script) or an ``@``, capitalised
words, neighbours of digits and linking words between such tokens can carry a label other than ``O``; a text's label
sequence falls apart exactly at all other tokens, and between capitalised words at the end of a sentence or line; the
runs in between are decoded by Viterbi, many runs to a numpy batch. Names are known by the words before them and by what
follows: two capitalised words alone are none. Decoded spans that overlap pattern spans are dropped.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import with_python_columns

BASE = ("email", "ip", "card", "phone")
FOUND = ("crf_email", "crf_ip", "crf_card", "crf_phone", "crf_id", "crf_name", "crf_street")
KINDS = BASE + FOUND
LABELS = ["O", *(f"{p}-{k}" for k in FOUND for p in "BI")]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\t-\r]+")
MAYBE = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[\d@]")
DECIMAL = re.compile(r"\d")
LINKS = frozenset("de la le du des van von der den di del da".split())
# Words whose full stop ends no sentence.
TITLES = frozenset("mr mrs ms dr prof st sr jr herr fr hr mme mlle sra".split())
EDGES = ".,;:!?\"'<>[]{}"


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(twice[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, in linear time: each @ looks left to the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern kinds, in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    if not MAYBE.search(text):
        return found
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


# The labelled table's templates. {kind:form} is a labelled span, # a digit, the rest is O.
TEMPLATES = (
    "please call {phone} before noon", "phone: {phone}", "tel {phone} or write to {email}", "my number is {phone} thanks", "fax {phone} today",
    "mobile {phone}", "reach us at {email} or {phone}", "contact {email} for details", "mail {email} now", "e-mail: {email}", "{email} wrote on ##.##.####",
    "the host {ip} was down", "from ip {ip} to {ip}", "address {ip} port ####", "login by {email} from {ip}", "ssn {id}", "social security number {id} on file",
    "iban {id} bank", "account iban {id}", "card {card} expires ##/##", "visa {card} charged", "credit card {card} and {phone}", "pay with {card}",
    "{phone} {card}", "{phone} {email}", "{ip} {card} {phone}", "{email} {ip}", "we met in #### at the fair", "about ## people and ### houses", "costs ##.## euros",
    "version #.#.# was released", "on ####-##-## at ##:##", "page ### of ####", "order ############ shipped", "serial ########-####",
    "between #### and ####", "hash {hex} matches", "token {hex}", "chapter #", "#,### readers", "## # # ### ##", "## ## ####", "no ####.####", "a ratio of #:#", "{phone} {card} and {email}", "at {ip} {card} {phone}", "call {phone} {card}", "in #### #### people left",
    "the ####s and ####s", "room ### floor #", "score ##-##", "growth of #.# %", "#### #### ####", "section #.# and #.#.#", "see [##] and (##)", "follow @{name} here", "@{name}", "{name}@ home",
    "iban {id} please", "IBAN {id} please", "to account {id} today", "pay {id} now", "mr {person} said", "Mrs {person} wrote", "dear {person}, thank you", "my name is {person}", "my name is {person} and more", "name: {person}", "Name: {person} Phone: {phone}", "Herr {person} sagte", "Frau {person} schrieb", "Monsieur {person} est venu", "Dr. {person} called", "signed by {person}",
    "lives at {street}", "lives at {street} today", "address: {street}", "Address: {street}", "wohnt in der {street} seit", "deliver to {street} please", "habite au {street}", "{person}, {street}", "the {Cap} {Cap} was closed", "In {Cap} der {Cap} und {Cap}", "{Cap} {Cap} {Cap} read", "on {Cap} ## the {Cap} met", "{Cap} #### was a year", "die {Cap} hat ## {Cap} verkauft", "{Cap} and {Cap} went to {Cap}", "The {Cap} of {Cap}", "chapter # The {Cap} {Cap}", "{CAP} {CAP} {CAP}", "see {CAP} ####", "{CAP} {CAP} #### {Cap}",
    "{name} mr {person} {name}", "{name} mrs {person} {name} {name}", "Frau {person} {name} {name}", "{name} Herr {person} {name}", "dear {person} {name}", "{name} is dr {person} {name}", "my name is {person} {name} {name}", "name is {person}, {name}",
    # running prose: sentence starts, titles, products and licences
    "{Cap} {name} {name} {name}. {Cap} {name} {name}", "{Cap} {Cap} {name} {name}.", "{Cap} {Cap}, {name} {Cap} {Cap}", "{Cap}, {Cap} {name} {name}", "{name} {name} {Cap} {Cap} {name}", "{name} {Cap} {Cap} {Cap} {name} {name}", "{Cap} de {Cap} {name}", "{Cap} la {name} de {Cap}", "{name} {Cap} van {Cap} {name}", "{Cap} {name}. {Cap} {Cap} de la {Cap}", "{Cap} {Cap} de la {Cap} {name}", "{Cap} {Cap} de {Cap}", "{Cap} de la {Cap}", "{name} {Cap} de la {Cap}",
    "licensed under the {Cap} License, Version #.#", "the {Cap} General Public License, version #", "{Cap} Public License", "the {Cap} {Cap} project", "{name} with {Cap} {Cap} and {Cap}", "by {Cap} {Cap} {name}", "is {Cap} {Cap} {name}", "{Cap} is {Cap} {Cap}", "{Cap} {name} in {Cap} {Cap}. {Cap} {Cap} {name}", "{name}: {Cap} {Cap}", "{Cap}: {Cap} {name}", "{name} {Cap} {Cap}", "{name} {Cap} {Cap}.",
)
FORMS = {
    "phone": ("(###) ###-####", "###-###-####", "###.###.####", "+# (###) ###-####", "+## ### ### ####", "+## ## ## ## ## ##", "0### #######", "(0##) ### ####", "1-800-###-####", "+###########"),
    "card": ("#### #### #### ####", "####-####-####-####", "#### ###### #####", "################", "################", "###############"),
    "ip": ("1##.##.#.##", "10.#.##.1##", "192.168.#.##", "2#.1##.##.#"),
    "email": ("{name}.##@{name}.com", "{name}@{name}.org", "{name}_{name}@{name}.co", "{name}##@{name}.net", "{name}@{name}"),
    "id": ("###-##-####", "DE## #### #### #### ##", "FR##############", "GB##ABCD##########", "GB## {CAP} #### #### #### ##", "NL## {CAP} #### #### ##"),
    "person": ("{Cap} {Cap}", "{Cap} {Cap}", "{Cap} {Cap} {Cap}", "{Cap} van {Cap}", "{Cap} de {Cap}"),
    "street": ("## {Cap} Street", "### {Cap} Road", "# {Cap} Avenue", "{Cap}straße ##", "{Cap}strasse #", "{Cap}weg ##", "{Cap} Platz #", "## rue de {Cap}", "# rue {Cap}", "## {Cap} Lane"),
}
#: No identifier, name or street has more tokens; cutting back long spans stays linear in the text.
MOST_TOKENS = 40
SENTENCES = 1200
SEED = 11


def labelled_table() -> list[tuple[list[str], list[str]]]:
    """(tokens, labels) of each sentence of the training table."""
    rnd = random.Random(SEED)

    def fill(form: str) -> str:
        form = re.sub(r"\{name\}", lambda m: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(3, 9))), form)
        form = re.sub(r"\{Cap\}", lambda m: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(3, 9))).capitalize(), form)
        form = re.sub(r"\{CAP\}", lambda m: "".join(rnd.choice("ABCDEFGHIJKLMNOPRSTUVW") for _ in range(4)), form)
        form = form.replace("{hex}", "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice((16, 18, 32, 40)))))
        return re.sub("#", lambda m: rnd.choice("0123456789"), form)

    out = []
    for n in range(SENTENCES):
        tokens, labels = [], []
        for piece in re.split(r"(\{(?:phone|card|ip|email|id|person|street)\})", TEMPLATES[n % len(TEMPLATES)]):
            kind = piece[1:-1] if piece[1:-1] in FORMS else None
            words = fill(rnd.choice(FORMS[kind]) if kind else piece).split()
            tokens += words
            labels += [f"{'I' if i else 'B'}-crf_{'name' if kind == 'person' else kind}" if kind else "O" for i in range(len(words))]
        if rnd.random() < 0.2:
            tokens[-1] += rnd.choice(".,;")
        out.append((tokens, labels))
    return out


def shape(token: str) -> str:
    """Word shape: digits d (runs over 6 as D), lower a, upper A (runs squeezed), other letters w, the rest kept."""
    out, i, n = [], 0, len(token)
    while i < n:
        c, j = token[i], i
        if c.isdigit():
            while j < n and token[j].isdigit():
                j += 1
            out.append("d" * (j - i) if j - i <= 6 else f"D{min(j - i, 20)}")
        elif c.isalpha():
            while j < n and token[j].isalpha():
                j += 1
            part = token[i:j]
            out.append("a" if part.islower() else "A" if part.isupper() else "w")
        else:
            j = i + 1
            out.append(c)
        i = j
    return "".join(out)


NO_DIGITS = str.maketrans("", "", "dD0123456789")


def facts_of(token: str) -> tuple[str, str, str, str, str]:
    """(shape, word, ending, shape without digits, digits and marks) of a token, as features name them."""
    bare = token.strip(EDGES)
    own, word = shape(bare), bare.lower()
    letters = word.isalpha()
    marks = "".join(c for c in "@+().-:/%" if c in token)
    return own, word if letters else "", word[-5:] if letters else "", own.translate(NO_DIGITS), f"{min(sum(c.isdigit() for c in token), 20)}|{marks}"


#: Facts of short tokens are kept, of a bounded number; long ones are made anew.
CACHED_LENGTH = 48
cached_facts = lru_cache(maxsize=1 << 16)(facts_of)


def ends_sentence(token: str) -> bool:
    """Whether a full stop, question or exclamation mark ends the token, but for titles and initials."""
    bare = token.rstrip("\"')]}")
    return bare[-1:] in ("!", "?") or (bare[-1:] == "." and len(bare) > 2 and bare[:-1].lower() not in TITLES)


def starts_of(tokens: list[str], lines: list[bool] | None = None) -> list[bool]:
    """For each token whether a sentence or a line starts with it."""
    return [i == 0 or (lines is not None and lines[i]) or ends_sentence(tokens[i - 1]) for i in range(len(tokens))]


def word_before(tokens: list[str], i: int, starts: list[bool]) -> str:
    if i <= 0 or starts[i]:
        return ""
    t = tokens[i - 1]
    return (cached_facts(t) if len(t) <= CACHED_LENGTH else facts_of(t))[1]


def feature_names(tokens: list[str], i: int, starts: list[bool]) -> tuple[str, ...]:
    near = (tokens[i - 1] if i else "", tokens[i], tokens[i + 1] if i + 1 < len(tokens) else "")
    (sb, word, *_), (own, _, end, bare, counts), (sa, later, *_) = (cached_facts(t) if len(t) <= CACHED_LENGTH else facts_of(t) for t in near)
    marks = counts[counts.index("|") + 1 :]
    before = word_before(tokens, i, starts)
    further = word_before(tokens, i - 1, starts) if before else ""
    return ("bias", "s=" + own, "b=" + sb, "a=" + sa, f"bs={sb}|{own}", f"sa={own}|{sa}", "n=" + counts, "m=" + marks, "w=" + word, "x=" + bare, "e=" + end, "v=" + later, "u=" + before, f"t={further}|{before}", f"^={starts[i]}|{own}")


def may_carry(token: str) -> bool:
    """Digits, ``@`` and capitalised words; neighbours and linking words follow in ``runs_of``."""
    return DIGIT.search(token) is not None or token.lstrip(EDGES + "(")[:1].isupper()


def runs_of(tokens: list[str], starts: list[bool]) -> Iterator[tuple[int, int]]:
    """Maximal stretches of tokens that may carry a label, cut where a sentence or line starts between words without
    digits. One capitalised word by itself is no run, as nothing that it could be is plausible."""
    own = [may_carry(t) for t in tokens]
    on = own.copy()
    for i, t in enumerate(tokens):
        if own[i] and DIGIT.search(t):
            for k in range(max(0, i - 1), min(i + 2, len(tokens))):
                on[k] = True
        elif t in LINKS and i and on[i - 1]:
            on[i] = True
    digits = [DIGIT.search(t) is not None for t in tokens]
    start, end = None, len(tokens)
    for i in range(end + 1):
        carries = i < end and on[i]
        cut = carries and start is not None and starts[i] and not digits[i] and not digits[i - 1]
        if start is not None and (cut or not carries):
            if i - start > 1 or digits[start]:
                yield start, i
            start = None
        if carries and start is None:
            start = i


class Field:
    """emit: feature number x label; step: label x label; first and last: label (the neighbours outside are O)."""

    def __init__(self, table: list[tuple[list[str], list[str]]], epochs: int = 80):
        number: dict[str, int] = {}
        data = []
        for tokens, labels in table:
            starts = starts_of(tokens)
            for a, b in runs_of(tokens, starts):
                feats = [[number.setdefault(f, len(number)) for f in feature_names(tokens, i, starts)] for i in range(a, b)]
                data.append((feats, [LABELS.index(x) for x in labels[a:b]]))
        self.number, k, s = number, len(feature_names(["a"], 0, [True])), len(LABELS)
        longest = max(len(y) for _, y in data)
        feats = np.full((len(data), longest, k), len(number))
        gold = np.zeros((len(data), longest), int)
        mask = np.zeros((len(data), longest), bool)
        for n, (x, y) in enumerate(data):
            feats[n, : len(y)], gold[n, : len(y)], mask[n, : len(y)] = x, y, True
        self.banned = np.zeros((s, s))
        for j, to in enumerate(LABELS):
            if to[0] == "I":
                for i, frm in enumerate(LABELS):
                    if frm[2:] != to[2:]:
                        self.banned[i, j] = -1e4
        flat = np.where(mask[:, :, None], feats, len(number)).ravel()
        order = np.argsort(flat, kind="stable")
        present, starts = np.unique(flat[order], return_index=True)
        theta = [np.zeros((len(number) + 1, s)), np.zeros((s, s))]
        m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        for epoch in range(1, epochs + 1):
            for i, g in enumerate(self._gradient(theta, feats, gold, mask, (order // k, present, starts))):
                g = g + 2e-2 * theta[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                theta[i] = theta[i] - 0.1 * (m[i] / (1 - 0.9**epoch)) / (np.sqrt(v[i] / (1 - 0.99**epoch)) + 1e-8)
            theta[0][-1] = 0
        self.emit, self.step = theta[0], theta[1] + self.banned

    def _gradient(self, theta, feats, gold, mask, groups):
        """Expected minus observed counts of features and transitions, by scaled forward and backward sums."""
        emit, step = theta[0], np.exp(theta[1] + self.banned)
        score = emit[feats].sum(2)
        score = np.exp(score - score.max(2, keepdims=True))
        n, t, s = score.shape
        alpha, beta = np.zeros((n, t, s)), np.zeros((n, t, s))
        for i in range(t):
            here = score[:, i] * (alpha[:, i - 1] @ step if i else step[0])
            alpha[:, i] = np.where(mask[:, i, None], here / here.sum(1, keepdims=True), alpha[:, i - 1])
        beta[:, t - 1] = step[:, 0]
        for i in range(t - 2, -1, -1):
            here = (score[:, i + 1] * beta[:, i + 1]) @ step.T
            beta[:, i] = np.where(mask[:, i + 1, None], here / here.sum(1, keepdims=True), step[:, 0])
        p = alpha * beta
        p = p / p.sum(2, keepdims=True) * mask[:, :, None]
        p[np.arange(n)[:, None], np.arange(t), gold] -= mask
        grad = np.zeros_like(emit)
        tokens, present, starts = groups
        grad[present] = np.add.reduceat(p.reshape(n * t, s)[tokens], starts, axis=0)
        steps = np.zeros_like(step)
        for i in range(1, t):
            on = mask[:, i]
            before, after = alpha[on, i - 1], score[on, i] * beta[on, i]
            whole = ((before @ step) * after).sum(1, keepdims=True)
            steps += step * ((before / whole).T @ after)
            np.add.at(steps, (gold[on, i - 1], gold[on, i]), -1)
        return grad, steps

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best label numbers of each run of emission scores (tokens x labels), in batches of runs of like length."""
        out: list = [None] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        at = 0
        while at < len(order):
            longest = len(runs[order[at]])
            part = []
            while at < len(order) and len(runs[order[at]]) <= longest + longest // 2 and len(part) < 512:
                part.append(order[at])
                at += 1
            t = max(len(runs[i]) for i in part)
            score = np.zeros((len(part), t, len(LABELS)))
            score[:, :, 1:] = -1e6
            for row, i in enumerate(part):
                score[row, : len(runs[i])] = runs[i]
            best, back = score[:, 0] + self.step[0], []
            for i in range(1, t):
                every = best[:, :, None] + self.step
                back.append(every.argmax(1))
                best = every.max(1) + score[:, i]
            last = (best + self.step[:, 0]).argmax(1)
            path = np.empty((len(part), t), int)
            path[:, t - 1] = last
            for i in range(t - 2, -1, -1):
                path[:, i] = back[i][np.arange(len(part)), path[:, i + 1]]
            for row, i in enumerate(part):
                out[i] = path[row, : len(runs[i])]
        return out

    def scores(self, tokens: list[str], a: int, b: int, starts: list[bool]) -> np.ndarray:
        """Emission scores of a run; of the text only the neighbouring tokens are looked at."""
        get, none = self.number.get, len(self.number)
        return self.emit[[[get(f, none) for f in feature_names(tokens, i, starts)] for i in range(a, b)]].sum(1)


@lru_cache(maxsize=1)
def trained() -> Field:
    return Field(labelled_table())


def plausible(kind: str, text: str) -> bool:
    """What a decoded span must hold besides its shape."""
    digits = "".join(DECIMAL.findall(text))
    if kind == "crf_email":
        return 0 < text.find("@") < len(text) - 1
    if kind == "crf_ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "crf_card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "crf_phone":
        return 7 <= len(digits) <= 15
    if kind == "crf_name":
        words = text.split()
        whole = [w[:1].isupper() and not (w.isupper() and len(w) > 2) for w in words]
        return not digits and "\n" not in text and sum(whole) >= 2 and whole[0] and whole[-1] and all(a != b for a, b in zip(words, words[1:], strict=False)) and not any(c in ",;:!?" for c in text)
    if kind == "crf_street":
        return bool(digits) and any(c.isalpha() for c in text) and len(text.split()) >= 2
    return 9 <= len(digits) <= 30


def stripped(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without the punctuation at its edges."""
    while start < end and text[start] in EDGES:
        start += 1
    while end > start and text[end - 1] in EDGES:
        end -= 1
    return start, end


def field_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Decoded spans of each text that touch none of its pattern spans."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs, where = [], []
    for n, text in enumerate(texts):
        if DIGIT.search(text) or not text.islower():
            places = [m.span() for m in TOKEN.finditer(text)]
            tokens = [text[a:b] for a, b in places]
            starts = starts_of(tokens, [i > 0 and "\n" in text[places[i - 1][1] : p[0]] for i, p in enumerate(places)])
            for a, b in runs_of(tokens, starts):
                runs.append(field.scores(tokens, a, b, starts))
                where.append((n, places[a:b]))
    for (n, places), path in zip(where, field.decode(runs), strict=True):
        i = 0
        while i < len(path):
            label = LABELS[path[i]]
            if label == "O":
                i += 1
                continue
            j = i + 1
            while j < min(len(path), i + MOST_TOKENS) and LABELS[path[j]] == "I" + label[1:]:
                j += 1
            while j > i:
                span = stripped(texts[n], places[i][0], places[j - 1][1])
                if plausible(label[2:], texts[n][span[0] : span[1]]):
                    if not any(a < span[1] and span[0] < b for a, _, b in bases[n]):
                        out[n].append((span[0], KINDS.index(label[2:]), span[1]))
                    break
                j -= 1  # a decoded span that runs on into other digits is cut back to its longest plausible start
            i = max(j, i + 1)
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the pattern kinds, base_sha256 and all spans (kind:start:end, code points) of every row, then
    n_spans, their number.

    Null text counts as empty: no spans, the digest of nothing. Texts of any length are read whole; a decoded span has at
    most ``MOST_TOKENS`` tokens. Of label sequences that tie the first in the order of ``LABELS`` is taken. Repeated rows
    give repeated results; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def make(texts):
        texts = [t or "" for t in texts]
        bases = [base_spans(t) for t in texts]
        for base, more in zip(bases, field_spans(texts, bases, shared.value), strict=True):
            yield (*(sum(x[1] == k for x in base) for k in range(4)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + more)), len(base) + len(more))

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    outputs = {"n_email": "long", "n_ip": "long", "n_card": "long", "n_phone": "long", "base_sha256": "string", "spans": "string", "n_spans": "long"}
    return with_python_columns(narrow, ["text"], outputs, make, drop=("text",))
