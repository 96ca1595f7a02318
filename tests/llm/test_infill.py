import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tests.oracle import connect, differences
from tidemark.llm import infill, queries

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    told = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(told[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def compare(df):
    want = sorted((str(i), *map(str, brute(i, t))) for i, t in df.select("doc_id", "text").collect())
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in infill.query(df.sparkSession, df).collect()]
    assert sorted(tuple(map(str, r)) for r in got) == want


def test_rank_and_select_as_counted():
    rng = np.random.default_rng(1)
    for size, share in ((0, 0.5), (1, 1), (63, 0.5), (64, 0), (512, 1), (513, 0.3), (5000, 0.01), (5000, 0.9)):
        flags = rng.random(size) < share
        bits = infill.Bits(flags)
        assert (bits.rank(np.arange(size + 1)) == np.concatenate([[0], np.cumsum(flags)])).all()
        assert (bits.select(np.arange(flags.sum())) == np.flatnonzero(flags)).all()


def test_odd_and_random_texts_as_brute_force(spark, docs):
    rng = random.Random(5)
    made = ["".join(rng.choice(["ab", "c", " ", "é", "漢", "🙂", "<", "P>", "<S", ">", "\n", "7"]) for _ in range(rng.randrange(60))) for _ in range(600)]
    compare(docs([*ODD, "<P>", "a<M>b", "<<S", *made]))
    compare(docs([(None, "ab cd ef", "s"), (None, "", "s"), (3, "ab cd ef", "s"), (3, "ab cd ef", "s"), (-4, "x y z", "s"), (2**63 - 1, "x y z", "s")]))
    compare(docs([]))


def test_table_as_sql(spark, sf):
    n, m, bad = differences(spark, connect(sf), queries.QUERIES["op11_infill"], infill.SQL, sf)
    assert n == m and not bad


def test_long_texts_beyond_a_slice(spark, docs):
    compare(docs(["ab 1é" * 700_000, "z", "word " * 900_000, ""]))


def test_pieces_are_rebuilt_and_clashing_columns_give_way(spark, docs):
    df = docs(["one two three four", "five", None]).withColumns({c: F.lit(7) for c in ("n", "form", "__cut", "__whole", "prefix_chars", "extra")})
    rows = infill.transform(df, plain=0, spm=50, out="made").withColumn("back", infill.restore(F.col("made"), F.col("form"))).collect()
    assert [r.back for r in rows] == ["one two three four", "five", ""] and all(r.extra == r["__cut"] == 7 for r in rows)
    assert {r.form for r in rows} <= {"psm", "spm", "plain"} and rows[0].form != "plain"
