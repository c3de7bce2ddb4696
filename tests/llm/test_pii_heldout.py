"""Precision and recall of the field on sentences, and some forms, that its labelled table does not hold."""

import random
import re

from larkspur.llm import pii

# {kind:value}; # is a digit, A a capital, a a letter, N a capitalised word
SENTENCES = (
    "you can ring {crf_phone:(###) ###-####} after lunch", "her cell is {crf_phone:###-###-####} if you need it", "office {crf_phone:###.###.####} ask for help",
    "we dialled {crf_phone:(###) ###-####} twice", "number {crf_phone:### ### ####} is ours", "ring {crf_phone:(###)###-####} now", "we live at {crf_street:## N Drive} since may", "ask mrs {crf_name:N N N} about it", "support line {crf_phone:1-800-###-####} is open",
    "his ssn {crf_id:###-##-####} leaked", "the number {crf_id:###-##-####} is on the form", "send it to iban {crf_id:DE## #### #### #### #### ##} soon",
    "transfer from {crf_id:GB## AAAA #### #### #### ##} arrived", "iban {crf_id:NL## AAAA #### #### ##} was used",
    "yesterday mr {crf_name:N N} came by", "dear {crf_name:N N}, we write to you", "my name is {crf_name:N N} and i live here", "Frau {crf_name:N N} kam gestern",
    "he moved to {crf_street:## N Street} last year", "send the parcel to {crf_street:### N Road} please", "sie wohnt in der {crf_street:Naastraße ##} seit mai", "address: {crf_street:# N Avenue}",
    "the meeting of ## people in #### cost ###.## euros", "on ####-##-## we shipped order ############", "see page ### and table #.#", "build #.##.# is out", "the N N was open in ####",
    "In der N lag ein N und das N", "between ## and ## percent of all ####", "we sold #,### units at ##.## each", "score ##-## in game #", "hash a#a##aa#a##a#a## is wrong",
)


def filled(rnd, text):
    text = re.sub(r"\bN(?=aa|\b)", lambda m: "".join(rnd.choice("abdefghiklmnoprstuw") for _ in range(rnd.randint(4, 8))).capitalize(), text)
    text = re.sub("#", lambda m: rnd.choice("123456789"), text)
    return text.replace("Naastra", "Bergstra")


def made(n=800, seed=77):
    rnd = random.Random(seed)
    for i in range(n):
        text, truth = "", set()
        for piece in re.split(r"(\{[^}]*\})", SENTENCES[i % len(SENTENCES)]):
            if piece.startswith("{"):
                kind, form = piece[1:-1].split(":", 1)
                value = filled(rnd, re.sub("AAAA", lambda m: "".join(rnd.choice("ABCDEFGHKLMNPQRSTUVW") for _ in range(4)), form))
                truth.add((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += filled(rnd, piece)
        yield text, truth


def measured():
    """{kind: (right, found, true)}."""
    counts = {k: [0, 0, 0] for k in pii.FOUND}
    texts, truths = zip(*made(), strict=True)
    for want, spans in zip(truths, pii.field_spans(list(texts), [pii.base_spans(t) for t in texts], pii.trained()), strict=True):
        got = {(pii.KINDS[k], a, b) for a, k, b in spans}
        for kind in counts:
            own = {x for x in got if x[0] == kind}
            true = {x for x in want if x[0] == kind}
            counts[kind][0] += len(own & true)
            counts[kind][1] += len(own)
            counts[kind][2] += len(true)
    return counts


def test_held_out_precision_and_recall():
    counts = measured()
    right, found, true = (sum(c[i] for c in counts.values()) for i in range(3))
    assert right >= 0.9 * found and right >= 0.9 * true, counts
