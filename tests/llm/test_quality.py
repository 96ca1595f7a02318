import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidemark.llm import quality
from tidemark.llm.common import table


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(five).items() if n > 1}
    covered = {i + k for i, w in enumerate(five) if w in twice for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def compare(df):
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    rows = quality.query(df.sparkSession, df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_whole_table_as_brute_force(spark, sf):
    compare(table(spark, sf, "documents"))


def test_odd_and_random_texts_as_brute_force(spark, docs):
    rng = random.Random(3)
    compare(docs(ODD + ["".join(rng.choice(["a", "b", " ", " ", "\n", "é", "#", "\t", " ", "a b c d e "]) for _ in range(rng.randrange(80))) for _ in range(400)]).withColumn("votes", F.lit("clash")))


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.1"
    x = quality.query(spark, table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").where("not base_failed").toPandas()
    assert x[x.quality == 1].kept.mean() > 0.99
    assert x[x.quality == 0].kept.mean() < 0.05


def test_estimate_as_numpy(spark):
    rng = np.random.default_rng(1)
    good = rng.random(6000) < 0.7
    right = np.array([[0.99, 0.6], [0.97, 0.5], [0.95, 0.8], [0.98, 0.3]])
    told = np.where(rng.random((6000, 4)) < np.where(good[:, None], right[:, 0], right[:, 1]), 1, -1) * np.where(good, 1, -1)[:, None]
    votes = np.where(rng.random((6000, 4)) < 0.1, 0, told)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    df = spark.createDataFrame([(p.tolist(), int(k)) for p, k in zip(patterns, n)], "votes array<int>, n long")
    got, rates = quality.estimate(df, 4)
    pi, g, b = 0.8, np.full(4, 0.98), np.full(4, 0.4)
    for _ in range(quality.ROUNDS):
        odds = np.log(pi / (1 - pi)) + np.where(patterns > 0, np.log(g / (1 - b)), np.where(patterns < 0, np.log((1 - g) / b), 0)).sum(1)
        q = n / (1 + np.exp(-odds))
        bad = n - q
        part = lambda w, at: (w[:, None] * at).sum(0)
        pi = (q.sum() + 0.8) / (n.sum() + 1)
        g, b = (part(q, patterns > 0) + 0.98) / (part(q, patterns != 0) + 1), (part(bad, patterns < 0) + 0.4) / (part(bad, patterns != 0) + 1)
        bound = (part(q, patterns < 0) + part(bad, patterns < 0) + 0.4) / (quality.CHANCE * part(q, patterns != 0) + part(bad, patterns != 0) + 1)
        fair = 1 - g <= quality.CHANCE * b
        g, b = np.where(fair, g, 1 - quality.CHANCE * bound), np.where(fair, b, bound)
    assert got == pytest.approx(pi, abs=1e-9)
    assert np.array(rates) == pytest.approx(np.c_[g, b], abs=1e-9)
    assert got == pytest.approx(0.7, abs=0.05)


def test_empty(spark, docs):
    assert quality.query(spark, docs([])).count() == 0


def test_columns_of_the_same_names_give_way(spark, docs):
    df = docs(["a b c d e f g h i j k l.", "", None]).withColumns({c: F.lit("x") for c in ("n_words", "votes", "p_good", "__w", "n_lines")})
    got = quality.judge(df.unionByName(df)).orderBy("doc_id").collect()
    assert [r.n_words for r in got] == [12, 12, 0, 0, 0, 0] and all(0 < r.p_good < 1 for r in got)
