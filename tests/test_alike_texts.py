from larkspur.operators import curation


def test_long_texts_that_differ_at_their_start_are_linked(spark):
    body = " ".join(f"word{i}" for i in range(200))
    texts = ["an opening of its own, longer than fifty characters in all " + body, "Quite another beginning; " + body, body + " " + body.upper(), body, "nothing alike here", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.known_id): r.jaccard for r in curation.alike_texts(df, "doc_id", "text").collect()}
    sets = [set(t.lower().replace(",", "").replace(";", "").split()) if t else set() for t in texts]
    known = [i for i, s in enumerate(sets) if s and sets.index(s) == i]
    want = {(i, k): round(len(s & sets[k]) / len(s | sets[k]), 4) for i, s in enumerate(sets) if s for k in known if 100 * len(s & sets[k]) >= 85 * len(s | sets[k])}
    assert got == want and (0, 1) in got and (3, 2) in got
