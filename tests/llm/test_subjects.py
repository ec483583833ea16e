import random

from pyspark.sql import functions as F

import numpy as np

from spanloom.llm.subjects import Settings, components, subjects, term_weights, words

TOPICS = {"law": ["court", "judge", "verdict", "prison", "lawyer", "witness"], "sport": ["football", "referee", "stadium", "athlete", "tournament", "coach"], "energy": ["turbine", "grid", "pylon", "gas", "coal", "tariff"]}
FRAMES = ["We visited {} and saw what the {} needs.", "My constituents ask about the {} and the {} again.", "The committee heard that {} will help every {} soon."]
FILL = ["I have listened carefully to the minister.", "The figures speak for themselves today.", "That is a matter for the whole house."]
D = "doc_id bigint, text string, lang string, id bigint, kind string, sents string, subject string"


def corpus(n):
    r = random.Random(6)
    docs, truth, labels = [], {}, []
    for i in range(n):
        s = r.choice(list(TOPICS))
        body = [r.choice(FRAMES).format(*r.sample(TOPICS[s], 2)) for _ in range(r.choice([1, 4, 6]))]
        truth[i] = {s} if len(body) >= 3 else set()
        other = r.choice([x for x in TOPICS if x != s])
        body += r.sample(FILL, 2) + [f"The next paper concerns the {r.choice(TOPICS[other])}."]
        r.shuffle(body)
        docs.append((i, " ".join(body), r.choice(["en", None]), 0, "k", "s", "x"))
        if i % 5 == 0:
            labels.append((i, s if i % 50 else r.choice(list(TOPICS)), "a"))
    return docs, truth, labels + labels[:20]


def test_subjects_of_a_corpus(spark):
    docs, truth, labels = corpus(1200)
    df = spark.createDataFrame(docs, D).repartition(5)
    lab = spark.createDataFrame([*labels, (None, "law", None), (3, None, None), (4, "unknown", None)], "doc_id bigint, subject string, annotator string")
    got = {}
    for r in subjects(df, "doc_id", "text", F.col("lang"), lab, "doc_id", "subject", list(TOPICS), Settings(components=12)).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    hit = sum(len(truth[i] & got.get(i, set())) for i in truth)
    assert hit >= 0.95 * sum(map(len, truth.values()))
    assert hit >= 0.95 * sum(map(len, got.values()))


def test_nothing_to_learn_from(spark):
    docs, _, labels = corpus(30)
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string")
    none = spark.createDataFrame([], "doc_id bigint, subject string, annotator string")
    df = spark.createDataFrame(docs, D)
    assert subjects(df, "doc_id", "text", F.col("lang"), none, "doc_id", "subject", list(TOPICS)).collect() == []
    assert subjects(df.limit(0), "doc_id", "text", F.col("lang"), lab, "doc_id", "subject", list(TOPICS)).collect() == []
    odd = spark.createDataFrame([(0, None, None, 0, "k", "s", "x"), (None, "Text.", None, 0, "k", "s", "x"), (1, "", "en", 0, "k", "s", "x"), (0, "word " * 50000, "en", 0, "k", "s", "x")], D)
    assert subjects(odd, "doc_id", "text", F.col("lang"), lab, "doc_id", "subject", list(TOPICS)).collect() == []


def test_words_and_sentences():
    hashed, sent, doc = words(["One (aside [deep]) two. Three!\n\nFour 12 x", "", "\x00ONE coal-\n  fired; cut) (off"])
    one, two, three, four, again, fired, cut, off = hashed.tolist()
    assert one == again and len({one, two, three, four, fired, cut, off}) == 7
    assert doc.tolist() == [0, 0, 0, 0, 2, 2, 2, 2]
    assert sent[0] == sent[1] and len(set(sent.tolist())) == 4 and sent[4] == sent[-1]
    assert words(["coalfired"])[0][0] == fired and words([""])[0].tolist() == words([])[0].tolist() == []
    assert len(words(["\U0001d400\U0001d401 \ud800ab"])[0]) == 2


def test_components_of_one_pass():
    r = np.random.default_rng(1)
    a = r.standard_normal((200, 6)) @ np.diag([9, 7, 5, 3, 2, 1.0]) @ np.linalg.qr(r.standard_normal((40, 6)))[0].T
    way = np.linalg.qr(r.standard_normal((40, 12)))[0]
    got, true = components(way, a.T @ (a @ way), 6), np.linalg.svd(a, full_matrices=False)[2][:6].T
    assert np.allclose(np.linalg.svd(got.T @ true)[1], 1, atol=1e-3)
    assert not components(way, np.zeros((40, 12)), 3).any()


def test_many_kinds_and_sentences_below_the_least(spark):
    docs, truth, labels = corpus(900)
    docs = [(i, t, "en" if i % 3 else f"k{i}", *rest) for i, t, _, *rest in docs]
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string")
    got = subjects(spark.createDataFrame(docs, D), "doc_id", "text", F.col("lang"), lab, "doc_id", "subject", list(TOPICS), Settings(components=12, kinds=2)).collect()
    hit = sum(r["subject"] in truth[r["doc_id"]] for r in got)
    assert hit >= 0.9 * len(got) and hit >= 0.9 * sum(map(len, truth.values()))


def test_weights_favour_specific_terms():
    w = term_weights(np.array([[90.0, 1, 1], [30, 30, 30], [0.5, 0.2, 0.1], [1, 90, 1], [1, 1, 90]]), 5.0, 0.02)
    assert w[0] > 0.99 and w[1] == 0 and w[2] < 0.2
