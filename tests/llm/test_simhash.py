import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64

from tests.llm.conftest import ODD
from tidemark.llm import graph, simhash
from tidemark.llm.common import table


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = np.array(sorted(set(fps)), np.uint64)
    for i, x in enumerate(u):
        for y in u[i + 1 :][np.bitwise_count(u[i + 1 :] ^ x) <= 4]:
            parent[find(int(x))] = find(int(y))
    least = {}
    for i, f in zip(ids, fps):
        least[find(f)] = min(i, least.get(find(f), i))
    return [least[find(f)] for f in fps]


def compare(df):
    rows = sorted(simhash.query(df.sparkSession, df).collect())
    texts = dict(df.select("doc_id", "text").collect())
    fps = [brute_fingerprint(texts[r.doc_id]) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in rows] == brute_components([r.doc_id for r in rows], fps)
    assert len(rows) == df.count()


def test_whole_table_as_brute_force(spark, sf):
    compare(table(spark, sf, "documents"))


def test_odd_texts_and_chains_of_copies(spark, docs):
    rng = random.Random(1)
    texts = list(ODD)
    for _ in range(12):
        words = [f"w{rng.randrange(999)}" for _ in range(400)]
        for _ in range(20):
            texts.append(" ".join(words))
            words[rng.randrange(400)] = "edit"
    compare(docs(texts).withColumn("fp", F.lit("clash")))


@pytest.mark.parametrize("groups", [5, 6, 8, 12])
def test_links_as_brute_force(spark, groups):
    rng = random.Random(groups)
    some = [rng.getrandbits(64) for _ in range(150)] + [0, 2**64 - 1, 2**63]
    for x in list(some):
        for n in range(1, 7):
            for b in rng.sample(range(64), n):
                x ^= 1 << b
            some.append(x)
    u = np.array(sorted(set(some)), np.uint64).view(np.int64)
    nodes = spark.createDataFrame([(False, k, int(x)) for k, x in enumerate(u)], "none boolean, least long, fp long")
    got = [tuple(sorted((r.a.fp, r.b.fp))) for r in simhash.links(nodes, groups=groups).collect()]
    want = {(int(min(a, b)), int(max(a, b))) for i, a in enumerate(u) for b in u[i + 1 :] if np.bitwise_count(np.uint64(int(a) & (2**64 - 1)) ^ np.uint64(int(b) & (2**64 - 1))) <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 900), rng.randrange(300, 900)) for _ in range(400)] + [(5, 5), (1000, 1001), (1001, 1000)]
    got = dict(graph.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


def test_null_ids_and_one_kept(spark, docs):
    df = docs([(1, "a b c d e", "s"), (2, "a b c d e", "s"), (2, "a b c d e", "s"), (None, "a b c d e", "s"), (3, "quite another text here", "s"), (None, None, "s")])
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(df).where("doc_id is not null").collect()) == [(1, "a b c d e"), (3, "quite another text here")]
    assert simhash.keep_one(df).count() == 4 and simhash.query(spark, df).count() == 6
    assert simhash.query(spark, docs([])).count() == 0


def test_keep_one_of_each_group_where_texts_share_an_id(spark, docs):
    a, b = (" ".join(f"{w}{k}" for k in range(60)) for w in "ab")
    rows = simhash.keep_one(docs([(1, a, "s"), (1, b, "s"), (1, b, "s"), (2, a, "s"), (3, b, "s"), (None, a, "s")])).collect()
    assert sorted((r.doc_id or 9, r.text) for r in rows) == [(1, a), (1, b), (9, a)]


def test_groups_grow_with_the_fingerprints_and_names_may_clash(spark, docs):
    assert [simhash.groups_for(n) for n in (0, 1 << 21, (1 << 21) + 1, 1 << 30)] == [6, 6, 8, 12]
    df = docs(["a b c d e", "a b c d e", None]).withColumns({c: F.lit("x") for c in ("__id", "__hash", "__kept", "root", "least")})
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [0, 2]


@pytest.mark.parametrize("hot", [0, 3])
def test_rows_of_hot_and_other_fingerprints(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)  # none hot; those with a third of the rows
    words = "a b c d e f g h i j k l m n o p".split()
    compare(docs(["same words in this text here"] * 9 + [" ".join(words[k:]) for k in range(9)] + [None, ""]))


def test_the_largest_id_is_no_null(spark, docs):
    most = 2**63 - 1
    df = docs([(most, "p q r s t", "s"), (None, "p q r s t", "s"), (None, "other words of no kin", "s"), (None, "other words of no kin", "s")])
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.query(spark, df).collect())
    assert got == sorted([(str(most), str(most)), ("None", str(most)), ("None", "None"), ("None", "None")])


def test_crowded_cells_make_no_pairs_and_lose_no_link(spark):
    """Fingerprints about a few centres, and some in chains from one to the next: components as of all pairs, for any bound of a cell."""
    rng = np.random.default_rng(12)
    u = set()
    for centre in rng.integers(0, 1 << 63, 3).tolist():
        for _ in range(250):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            u.add(centre ^ sum(1 << int(b) for b in flips))
        at = centre
        for k in range(0, 60, 4):
            at ^= 0b1111 << k
            u.add(at)
    u |= set(rng.integers(0, 1 << 63, 100).tolist())
    fps = np.array(sorted(u), dtype=np.uint64)
    far = np.bitwise_count(fps[:, None] ^ fps[None, :])
    signed = fps.view(np.int64).tolist()
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(far <= 4, 1))):
        root[max(find(i), find(j))] = min(find(i), find(j))
    nodes = spark.createDataFrame([(False, k, x) for k, x in enumerate(signed)], "none boolean, least long, fp long").cache()
    for cell in (10, 100, 10_000):
        found = simhash.links(nodes, cell=cell).cache()
        assert cell < 10_000 or all(far[r.a.least, r.b.least] <= 4 for r in found.collect())
        got = {r.node.least: r.root.least for r in graph.components(found).collect()}
        assert {k: find(k) for k in range(len(fps)) if (far[k] <= 4).sum() > 1} == got


def test_a_crowd_about_one_fingerprint_has_few_links(spark):
    """1,500 within two bits of one: all pairs are links, over a million."""
    rng = np.random.default_rng(13)
    u = {0x0123456789ABCDEF} | {0x0123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(63, 2, replace=False)) for _ in range(2600)}
    nodes = spark.createDataFrame([(False, k, x) for k, x in enumerate(sorted(u))], "none boolean, least long, fp long")
    found = simhash.links(nodes, cell=300).cache()
    assert len(u) > 1_400 and found.count() < 5 * len(u)
    assert {r.root.least for r in graph.components(found).collect()} == {0}
