"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, grp long, line string, size long"
VOCAB = ["the", "and", "of", "house", "river", "Stone", "über", "ñandú", "ciel", "bright", "###", "x1", "été", "table", "window", "green"]


def texts(n=60, seed=7):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        lines = [" ".join(rnd.choice(VOCAB) for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 6))]
        out.append("\n".join(lines))
    footer = "All rights reserved, the house of the river."
    return [f"{t}\n{footer if i % 2 else footer.upper() + ' '}" if i % 3 else t for i, t in enumerate(out)]


def rows():
    t = texts()
    t += [None, "", " ", "\n", "\n\n \t", "a", "a b", "word " * 3000, "1 2 3 4 5 1 2 3 4 5", "line one is long enough here\n" * 5, "tab\tsep\x0bvt\x0cff\rcr nbsp ls", "emoji 😀😀 <|endoftext|> 'll we're  \n\n  x" ]
    t += [t[0], t[0], t[1], t[3] + " extra"]
    out = [(i, x, "en", None if i % 7 == 0 else f"s{i % 2}", None, "w", 1, "l", 5) for i, x in enumerate(t)]
    return out + [out[5]]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
