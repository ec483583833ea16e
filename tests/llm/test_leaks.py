import random

from spanloom.llm.leaks import leaks, words

R = random.Random(4)
VOCAB = ["".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(R.randint(2, 9))) for _ in range(900)]


def text(n):
    return [R.choice(VOCAB) for _ in range(n)]


ITEM, SHORT, OTHER = text(60), text(12), text(50)
D, I = "doc_id bigint, text string, item_id string, id bigint, t string", "item_id bigint, text string, suite string, doc_id bigint"  # noqa: E741


def found(spark, docs, items=None):
    items = items or [(1, " ".join(ITEM), "a", 9), (2, " ".join(SHORT), None, None), (3, " ".join(OTHER), "b", 1), (4, None, None, None), (None, "x" * 30, None, None)]
    df = spark.createDataFrame([(i, t, "c", 1, "t") for i, t in docs], D)
    return sorted(map(tuple, leaks(df, "doc_id", "text", spark.createDataFrame(items, I), "item_id", "text").collect()))


def around(ws):
    return " ".join(text(40)) + " " + " ".join(ws) + " " + " ".join(text(40))


def test_whole_part_altered_parted_and_interrupted(spark):
    part = ITEM[10:35]
    few, many = list(part), list(part)
    few[5] = few[17] = "zzzz"
    for k in (2, 6, 10, 14, 18, 22):
        many[k] = "zzzz"
    docs = [
        (1, around(ITEM)), (2, around(part).upper()), (3, around(few)), (4, around(many)), (5, around(ITEM[3:15])), (6, around(SHORT)), (7, around(SHORT[:9])),
        (8, around(part[:8] + ["(An hon. Member: Shame!)"] + part[8:16] + ["[Noise [still]]"] + part[16:])), (9, around([w[:2] + "-\n" + w[2:] if len(w) > 4 else w for w in part])),
        (10, around([", ".join(part[:12]), " ".join(part[12:]) + "."])), (11, " ".join(text(200))), (12, ""), (13, None), (None, around(ITEM)), (14, around(sorted(part))), (15, "(" + " ".join(part) + ")"),
    ]
    assert found(spark, docs) == sorted([(1, 1), (2, 1), (3, 1), (6, 2), (8, 1), (9, 1), (10, 1), (15, 1)])


def test_shared_passages_and_repeats_count_each(spark):
    items = [(1, " ".join(ITEM), None, None), (2, " ".join(text(20) + ITEM[:30]), None, None)]
    assert found(spark, [(1, around(ITEM[2:28])), (1, around(ITEM[2:28])), (2, around(ITEM[2:28]))], items) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_random_cases_against_exact_search(spark):
    r = random.Random(8)
    docs, want = [], []
    for i in range(120):
        n = r.choice([8, 12, 15, 22, 30, 45])
        at = r.randrange(0, 60 - n)
        ws = ITEM[at : at + n]
        docs.append((i, around(ws)))
        if n >= 20:
            want.append((i, 1))
    assert found(spark, docs) == want


def test_a_very_long_document_and_nothing(spark):
    long = " ".join(text(60000) + ITEM[5:30] + text(60000))
    assert found(spark, [(1, long)]) == [(1, 1)]
    assert found(spark, []) == []
    assert found(spark, [(1, "x")], [(1, None, None, None)]) == []


def test_items_shorter_than_a_gram(spark):
    items = [(1, "ab", None, None), (2, "To be!", None, None), (3, "?!", None, None)]
    docs = [(1, "cab AB, x"), (2, "cab"), (3, "[to] be"), (4, "to-\n be"), (5, "... to  BE"), (6, ""), (7, "to (or not) be")]
    assert found(spark, docs, items) == [(1, 1), (3, 2), (5, 2), (7, 2)]


def test_brackets_of_any_length(spark):
    five = ["melon", "harbour", "violet", "engine", "cradle"]
    items = [(1, " ".join(five), None, None), (2, " ".join(ITEM[:10]) + " (" + " ".join(ITEM[10:14]) + ") " + " ".join(ITEM[14:24]), None, None)]
    docs = [(1, around(["(" + " ".join(five) + ")"])), (2, around([*five[:2], "(Hear, hear)", *five[2:]])), (3, around(ITEM[:10] + ["("] + ITEM[10:14] + [")"] + ITEM[14:24]))]
    assert found(spark, docs, items) == [(1, 1), (2, 1), (3, 2)]


def test_recall_of_altered_words_of_all_lengths(spark):
    r = random.Random(3)
    docs, want = [], []
    for i in range(150):
        at = r.randrange(0, 39)
        ws = list(ITEM[at : at + 21])
        for k in r.sample(range(1, 20), 2):
            ws[k] = r.choice(["", "z", "z" * 9, "z" * (len(ws[k]) + 24)])
        docs.append((i, around(ws)))
        want.append((i, 1))
    assert found(spark, docs) == want
    grown = ["z" * 60 if k in (6, 13) else w for k, w in enumerate(ITEM[10:31])]
    df = spark.createDataFrame([(1, around(grown), "c", 1, "t")], D)
    item = spark.createDataFrame([(1, " ".join(ITEM), "a", 9)], I)
    assert leaks(df, "doc_id", "text", item, "item_id", "text").count() == 0
    assert leaks(df, "doc_id", "text", item, "item_id", "text", grow=60).count() == 1


def test_words():
    assert words("Co-oper-\nation, it's  ÉTÉ — 12,5!") == [b"cooperation", b"its", b"ete", b"125"]
