import itertools
import random
import re

from larkspur.llm import decontam, queries

from .fixture import SCHEMA, docs, none, rows

BENCH = "item_id long, text string, doc_id long, seed long"


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def best_overlap(doc, item):
    """Largest agreeing share over all alignments and stretches."""
    wide, best = min(len(item), decontam.WINDOW), 0
    for shift in range(-len(item) + 1, len(doc)):
        same = [int(0 <= shift + k < len(doc) and doc[shift + k] == x) for k, x in enumerate(item)]
        best = max(best, max(sum(same[i : i + wide]) for i in range(len(same) - wide + 1)))
    return best / wide


def made(seed=3, replaced=0.1):
    """Documents that hold benchmark items with a share of words replaced, and clean ones."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 60))
    items = [[word() for _ in range(rnd.randint(15, 50))] for _ in range(20)]
    texts, truth = [], []
    for i in range(120):
        body = [word() for _ in range(rnd.randint(0, 80))]
        if i % 2:
            leak = [w if rnd.random() >= replaced else word() for w in items[i % 20]]
            at = rnd.randint(0, len(body))
            body[at:at] = leak
        texts.append(" ".join(body).upper() if i % 3 == 0 else ", ".join(body))
        truth.append(bool(i % 2))
    return [" ".join(x) for x in items], texts, truth


def run(spark, items, texts):
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(items)], BENCH)
    df = spark.createDataFrame([(i, t, None, None, 1, "w", 1, "l", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return {r.doc_id: r for r in decontam.contamination(df, bench).collect()}


def test_whole_items_are_all_found_and_clean_texts_left(spark):
    items, texts, truth = made(replaced=0)
    got = run(spark, items, texts)
    assert [got[i].contaminated for i in range(len(texts))] == truth


def test_replaced_words_against_brute_force(spark):
    items, texts, _ = made(replaced=0.12)
    got = run(spark, items, texts)
    want = {i: {k: best_overlap(words(t), words(x)) for k, x in enumerate(items)} for i, t in enumerate(texts)}
    hard = {i for i in want if max(want[i].values()) >= 0.8}
    found = {i for i in got if got[i].contaminated}
    assert found == hard and len(hard) > 40
    for i in found:
        ids = [int(x) for x in got[i]["items"].split(",")]
        assert ids == [k for k in sorted(want[i]) if want[i][k] >= 0.8] and got[i].n_items == len(ids) and abs(got[i].overlap - max(want[i].values())) < 1e-9


def test_both_joins_give_the_same(spark, monkeypatch):
    items, texts, _ = made(replaced=0.05)
    one = run(spark, items, texts)
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    assert run(spark, items, texts) == one


def test_edges(spark):
    bench = spark.createDataFrame([(1, None, 1, 1), (2, "", 1, 1), (3, "too short to look for", 1, 1), (None, "one two three four five six seven eight nine ten", 1, 1), (4, rows()[0][1], 1, 1), (4, rows()[0][1], 1, 1)], BENCH)
    got = decontam.contamination(docs(spark), bench).collect()
    assert len(got) == len(rows())
    text = {i: t for i, t, *_ in rows()}
    for r in got:
        assert r.contaminated >= (text[r.doc_id] == text[0])
    assert decontam.contamination(none(spark), bench).count() == 0
    clean = decontam.contamination(docs(spark), bench.limit(0)).collect()
    assert len(clean) == len(rows()) and not any(r.contaminated for r in clean)
    kept = decontam.without_contaminated(docs(spark), bench)
    assert kept.columns == docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.contaminated)


def test_masks_fit_between_any_differences_that_pass():
    """Every set of places that may differ in a stretch leaves room for a mask, at every length from 14 to ``WINDOW``."""
    assert len(set(decontam.MASKS)) == 2 and all(set(decontam.COMMON) < set(m) for m in decontam.MASKS)
    for wide in range(decontam.THIRDS + 1, decontam.WINDOW + 1):
        most = wide - -(-wide * decontam.PERCENT // 100)
        for gone in itertools.combinations(range(wide), most):
            assert any(all(at + k not in gone for k in m) for m in decontam.MASKS for at in range(wide - m[-1]))


def test_no_overlap_is_lost_at_any_length(spark):
    """Items of 1 to 30 tokens with up to as many replaced as the rule allows, enumerated or (long ones) drawn."""
    rnd, items, texts, want = random.Random(8), [], [], []
    for n in range(1, 31):
        item = [f"w{n}x{k}" for k in range(n)]
        items.append(" ".join(item))
        wide = min(n, decontam.WINDOW)
        most = 0 if n < decontam.SPAN else wide - -(-wide * decontam.PERCENT // 100)
        places = list(itertools.combinations(range(n), most))
        for gone in places if len(places) <= 120 else rnd.sample(places, 120):
            texts.append(" ".join("other" if k in gone else w for k, w in enumerate(item)))
            want.append(n - 1)
    got = run(spark, items, texts)
    assert [got[i]["items"] for i in range(len(texts))] == [str(n) for n in want]


def test_the_tables_whole_items(spark):
    sf = "/root/testdata/sf0.001"
    items = [words(r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    held = {r.doc_id for r in queries.table(spark, sf, "documents").collect() for t in [" " + " ".join(words(r.text)) + " "] if any(" " + " ".join(x) + " " in t for x in items)}
    found = {r.doc_id for r in queries.op10_decontamination(spark, sf).where("contaminated").collect()}
    assert held <= found and held


def test_unspaced_scripts_equal_the_sql(spark):
    """Chinese, Japanese and Thai items inside longer texts, with and without replaced characters."""
    import duckdb

    from larkspur.llm.queries import OP10_SQL

    items = ["今天天气很好我们一起去公园散步吧然后回家吃饭", "日本語のテストはひらがなとカタカナを含みます", "สวัสดีครับวันนี้อากาศดีมากไปเที่ยวกัน", "mixed 漢字 and words of latin text in one item here", "短い文"]
    texts = [f"前言。{i}后记也在这里" for i in items] + [items[0].replace("公园", "学校"), items[1].replace("テスト", "試験紙"), "这是完全不同的一段文字没有任何重复", items[3].upper(), items[4], None]
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", list(enumerate(rows)))
    cursor = con.execute(OP10_SQL)
    names = [d[0] for d in cursor.description]
    want = {r["doc_id"]: r for r in (dict(zip(names, row, strict=True)) for row in cursor.fetchall())}
    docs, bench = (spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string") for key, rows in (("doc_id", texts), ("item_id", items)))
    got = {r.doc_id: r.asDict() for r in decontam.contamination(docs, bench).collect()}
    assert got == want
    assert [got[i]["contaminated"] for i in (0, 1, 2, 3, 4, 5, 7, 8)] == [True] * 6 + [False, True]
