import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, SCHEMA
from tests.oracle import connect, differences
from tidemark.llm import interactions, queries

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = least.get(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": first is not None and (i is None or i > first),
        }
        rows.append((lang or "", {k for k, x in fails.items() if x}, i in good, i in bad))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for o in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(o):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                failing = [r for r in mine if f in r[1]]
                out[part, "".join(o), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, o, s), v in out.items():
            if p == part:
                v.append(shapley[o[s - 1]])
    return out


def compare(spark, docs, labels):
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in docs], SCHEMA)
    got = interactions.query(spark, df, spark.createDataFrame(labels, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == brute(docs, labels)
    assert len(got) == len({d[2] or "" for d in docs}) * 600


def test_table_as_sql(spark, sf):
    n, m, bad = differences(spark, connect(sf), queries.QUERIES["op12_filter_audit"], interactions.SQL, sf)
    assert n == m and not bad


def test_odd_and_random_texts_as_brute_force(spark):
    rng = random.Random(7)
    pieces = ["a", "B", "word", "longerthaneight", "longerthaneighU", "é漢", " ", " ", " ", "\n", "\x0b", "#", "x" * 300, "x" * 299 + "y", "nul\x00", "nul"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(400))) for _ in range(300)]
    varied = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([99, 100, 101, 150]))) for _ in range(100)]
    docs = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate([*ODD, *made, *varied, *made[:40], *varied[:30]])]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.sample(range(400), 200)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (9999, 1, 1)]
    compare(spark, docs, labels)


def test_ids_null_repeated_and_largest(spark):
    text = " ".join(f"w{k}" for k in range(120))
    docs = [(None, text, "en"), (None, text, "en"), (5, text, "en"), (5, text, "de"), (2**63 - 1, text, "en"), (None, "alone", "en"), (None, "alone", "en"), (None, None, "fr"), (7, "", "fr"), (-1, "b", "fr"), (-2, "b", "fr")]
    compare(spark, docs, [(5, 1, 1), (None, 1, 1)])
    compare(spark, docs, [])
    compare(spark, [], [(5, 1, 1)])


def test_distinct_words_counted_anew_where_hashes_collide():
    texts = ["a b a c", "", "q q q", "bb cc dd bb", "longlonglong longlonglonh longlonglong"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    flat = lambda windows, data, start, size: np.zeros(len(start), np.uint64)
    assert interactions.scan(data, edges, flat)["distinct"].tolist() == [len(set(t.split())) for t in texts]
    assert interactions.scan(data, edges)["distinct"].tolist() == [len(set(t.split())) for t in texts]


def test_long_text_and_clashing_columns(spark, docs):
    text = " ".join(f"w{k % 70_000}" for k in range(500_000))
    df = docs([text, "x" * 3_000_000, "tiny"]).withColumns({c: F.lit("x") for c in ("id", "part", "digest", "__id", "n", "mask", "good")})
    got = interactions.masks(df, spark.createDataFrame([(0, 1, 0)], LABELS).withColumn("good", F.lit(3))).collect()
    assert sorted((r["mask"], r.good, r.n) for r in got) == [(1, False, 2), (2, True, 1)]
    assert df.select(interactions.counts(F.col("text")).alias("c")).select("c.words", "c.distinct").collect() == [(500_000, 70_000), (1, 1), (1, 1)]
