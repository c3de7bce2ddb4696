import random

from .test_decontam import run


def test_short_items_are_found_word_for_word(spark):
    items = ["Paris is it", "seven small words of a short item", "alone", ""]
    got = run(spark, items, ["they say Paris, is it?", "paris is", "a seven small words of a short item b", "seven small words of the short item", "Alone", "", None])
    assert [got[i]["items"] for i in range(7)] == ["0", "", "1", "", "2", "", ""]
    assert all(got[i].overlap == 1 for i in (0, 2, 4))


def test_items_of_ten_to_thirteen_tokens_with_any_two_substitutions(spark):
    items = [" ".join(f"w{n}x{k}" for k in range(n)) for n in range(10, 14)]
    texts, want = [], []
    rnd = random.Random(2)
    for n, item in enumerate(items):
        words = item.split()
        for a in range(len(words)):
            for b in range(a, len(words)):
                texts.append("before it " + " ".join("other" if k in (a, b) else w for k, w in enumerate(words)) + " after")
                want.append(str(n))
        for _ in range(10):
            gone = rnd.sample(range(len(words)), 3)
            texts.append(" ".join("other" if k in gone else w for k, w in enumerate(words)))
            want.append("")
    got = run(spark, items, texts)
    assert [got[i]["items"] for i in range(len(texts))] == want


def test_unspaced_scripts_are_read_by_character(spark):
    item = "敏捷的棕色狐狸跳过了那只懒惰的狗然后回家睡觉"
    thai = "กขคงจฉชซฌญฎฏฐฑฒณด"
    got = run(spark, [item, thai], [f"前面的话{item}后面的话", item.replace("狐", "猫"), "前面的话后面的话", f"ดด{thai}กก ok"])
    assert [got[i]["items"] for i in range(4)] == ["0", "0", "", "1"]
