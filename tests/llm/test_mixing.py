import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidemark.llm import mixing
from tidemark.llm.common import table


def oracle(df, block=1024):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    return sorted(con.execute(mixing.SQL.replace("1024", str(block)).replace("1023", str(block - 1))).fetchall(), key=str)


def got(df, **how):
    return sorted((tuple(r) for r in mixing.mix(df, **how).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots").collect()), key=str)


def test_as_sql(spark, sf):
    df = table(spark, sf, "documents")
    assert got(df) == oracle(df)
    assert got(df, block=50) == oracle(df, 50)


@pytest.mark.parametrize("rows", [[], [None], ["", None], ["a b c"], ODD])
def test_odd_texts(spark, docs, rows):
    df = docs(rows).withColumn("size", F.lit("clash"))
    assert got(df, block=16) == oracle(df.drop("size"), 16)


def test_sources_null_tied_hot_and_repeated_rows(spark, docs):
    rows = [(i, "w " * (i % 9 + 1), None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 11}") for i in range(500)]
    df = docs(rows + rows[:40] + [(None, "no id", "s1"), (None, "no id", "s1")])
    rows = got(df, block=8)
    assert rows == oracle(df, 8)
    assert all(taken <= 2 * size for _, size, _, _, taken, _, _ in rows)
    for x in mixing.mix(df, block=8).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("a")).collect():
        assert 0 <= x.a - x.t < 1


def test_schedule_spreads_each_source(spark, sf):
    sized = table(spark, sf, "documents").select("doc_id", "source", mixing.n_words("text").alias("size"))
    sources = mixing.plan(mixing.targets(sized), 16)
    n = sources.agg(F.sum("slots")).first()[0]
    slots = mixing.schedule(sources, n, 16).toPandas()
    assert len(slots) == n and slots.slot.is_unique
    width = 1 << (n - 1).bit_length()
    for _, x in slots.groupby("sid"):
        x = x.sort_values("slot")
        assert list(x["rank"]) == list(range(len(x)))
        spread = (x.slot.values + 1) / width * len(x) - range(1, len(x) + 1)
        assert abs(spread).max() < 2 + width.bit_length() / 2  # the discrepancy grows as the logarithm


def test_mixed_documents_hold_the_words_taken(spark, sf):
    df = table(spark, sf, "documents")
    wanted = {r.doc_id: r.taken for r in mixing.mix(df).collect() if r.taken}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    found = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(mixing.n_words("text")).alias("n")).collect()}
    assert found == wanted


def test_mixed_documents_stand_by_slot_and_take_any_columns(spark, sf):
    clash = table(spark, sf, "documents").withColumns({c: F.lit("x") for c in ("__n", "__part", "__id", "__source", "__size", "__taken", "slot", "__slot")})
    out = mixing.mixed_documents(clash, block=16, slot="at")
    rows = out.select("at", "source", "doc_id", F.spark_partition_id().alias("p")).collect()
    assert out.drop("at").columns == clash.columns
    assert [r["at"] for r in rows] == sorted(r["at"] for r in rows)
    first = {r.doc_id: r.first_slot for r in mixing.mix(clash, block=16).collect() if r.taken}
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, r["at"])
    assert all(seen[d] >= first[d] for d in seen) and np.mean([seen[d] == first[d] for d in seen]) > 0.9
    firsts = [r.source for r in rows[: len(rows) // 4]]
    shares = {s: sum(r.source == s for r in rows) / len(rows) for s in {r.source for r in rows}}
    assert all(abs(firsts.count(s) / len(firsts) - share) < 0.2 for s, share in shares.items())


def test_rows_alike_lose_no_word(spark, docs):
    for rows in ([(None, "a b c d e f g h i j", "s")] * 40, [(7, f"a b c d e f g h i j{k % 3}", "s") for k in range(41)] + [(k, "one two", "t") for k in range(9)], [(None, None, "s"), (None, "", "s"), (None, "x", None), (None, "y", None)]):
        df = docs(rows).withColumns({c: F.lit("x") for c in ("__turn", "__k", "__words")})
        for block in (16, 1024):
            taken = {r.source: r.t for r in mixing.mix(df, block=block).groupBy("source").agg(F.sum("taken").alias("t")).collect() if r.t}
            out = mixing.mixed_documents(df, block=block)
            assert out.columns == df.columns
            assert {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.n_words("text")).alias("n")).collect()} == taken
            most = out.groupBy("doc_id", "source", "text").count().agg(F.max("count")).first()[0] or 0
            assert most <= 2 * len(rows)
