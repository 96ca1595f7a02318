import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidemark.llm import substrings
from tidemark.llm.common import table


def brute(texts, length=100):
    """Texts by id: (n_bytes, n_removed, n_spans, sha256 of what is kept)."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def compare(df):
    rows = substrings.query(df.sparkSession, df).collect()
    want = brute(dict(df.select("doc_id", "text").collect()))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(rows) == len(want)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_whole_table_as_brute_force(spark, sf):
    compare(table(spark, sf, "documents"))


@pytest.mark.parametrize("buffer", [250, 1 << 20])
def test_planted_repeats_as_brute_force(spark, docs, buffer, monkeypatch):
    monkeypatch.setattr(substrings, "BUFFER", buffer)
    rng = random.Random(buffer)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [make(rng.randrange(90, 300)) for _ in range(12)]
    texts = list(ODD) + ["x" * 400, "ab" * 300, "x" * 99, "x" * 100, "x" * 101]
    for _ in range(60):
        text = "".join(rng.choice([make(rng.randrange(40)), rng.choice(passages), rng.choice(passages)[rng.randrange(30) :]]) for _ in range(rng.randrange(6)))
        texts += [text, text[:200] + "!" + text[201:]]
    rng.shuffle(texts)
    compare(docs(texts).withColumn("id", F.lit("clash")))


def test_ids_null_or_repeated(spark, docs):
    a, b = "".join(map(str, range(300))), "".join(map(str, range(900, 1200)))
    rows = substrings.query(spark, docs([(1, a, "s"), (1, a, "s"), (1, b, "s"), (2, b + a, "s"), (None, a, "s")])).collect()
    assert sorted((r.doc_id or 9, r.n_bytes, r.n_removed) for r in rows) == [(1, len(a), 0)] * 2 + [(1, len(b), 0), (2, len(a + b), len(a + b)), (9, len(a), len(a))]
    assert substrings.query(spark, docs([])).count() == 0


def test_thousands_of_texts_without_an_id(spark, docs):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, texts = make(150), [make(rng.randrange(1, 40)) for _ in range(4000)]
    plain = [None, *(x + chr(0x4E00 + k) + passage for k, x in enumerate(texts[:50]))]  # bytes before the passage differ
    rows = substrings.query(spark, docs([(None, x, "s") for x in dict.fromkeys(texts[50:] + plain)])).collect()
    assert len({(r.n_bytes, r.kept_sha256) for r in rows}) > 3000
    assert sorted(r.n_removed for r in rows if r.n_removed) == [150] * 49
    long = [make(300) for _ in range(3000)]
    got = substrings.remove(docs([(None, x, "s") for x in long]).unionByName(docs([(5, long[0], "s")]))).collect()
    assert sorted(r.n_removed for r in got) == [0] * 3000 + [300]
    assert {bytes(r.kept).decode() for r in got if r.n_removed == 0} == {*long[1:], long[0]}


def test_cover_brings_any_two_places_together():
    for a in range(substrings.PERIOD):
        for b in range(substrings.PERIOD):
            assert any((a + d) % substrings.PERIOD in substrings.COVER and (b + d) % substrings.PERIOD in substrings.COVER for d in range(substrings.PERIOD))


def test_a_content_in_thousands_of_contexts(spark, docs, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 16)
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [make(rng.randrange(60)) + "-" * rng.randrange(40, 70) + make(rng.randrange(60)) for _ in range(3000)]
    texts += [texts[k] + make(9) for k in range(0, 600, 3)]
    compare(docs(texts))


def test_the_largest_id_is_no_null(spark, docs):
    last = (1 << 63) - 1
    text = "".join(map(str, range(100)))
    for rows in ([(last, text, "s")], [(None, text, "s")], [(None, text + "!", "s"), (last, text, "s")], [(None, text, "s"), (last, text, "s"), (last, text + "?", "s"), (3, "x", "s")]):
        got = substrings.query(spark, docs(rows)).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes) for r in got) == sorted((i is None, i or 0, len(t)) for i, t, _ in rows)
        assert all(r.n_removed == 0 for r in got if r.doc_id == last and len(rows) < 4)
        assert [r.n_removed for r in got if r.doc_id is None and len(rows) > 1] == [len(text)] * (len(rows) > 1)


def _around_one_sentence(n):
    rng = random.Random(n)
    make = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    sentence = "This site keeps cookies; read our notice before you go on..."
    texts = [make(120) + sentence + make(120) for _ in range(n)]
    return texts + [texts[k][:300] + make(5) for k in range(0, n, 50)]


def test_strings_around_a_common_sentence_go_to_many_buckets(spark, docs):
    df = docs(_around_one_sentence(8000))
    rows, sizes = substrings.keyed(df), {}
    whole = np.array([(0, 10**6)], substrings.RUN).tobytes()
    left = substrings.packed(rows).select("id", "tie", "data", F.array().cast("array<binary>").alias("repeats"), F.array(F.lit(whole)).alias("unsure"))
    crowded = substrings._crowded(left.where("id % 16 = 0").mapInArrow(substrings._sampled, "least long, n long"))
    assert len(crowded)
    for turn in range(substrings.TURNS):
        for r in left.mapInArrow(substrings._suffixes(512, turn, crowded), substrings.BUCKETED).collect():
            sizes[r.bucket] = sizes.get(r.bucket, 0) + len(r.rows)
    assert max(sizes.values()) < 0.05 * sum(sizes.values())


def test_a_crowded_sentence_as_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(substrings, "CROWD", 64)
    compare(docs(_around_one_sentence(1500)))


def test_different_contents_stay_apart_in_a_large_corpus():
    """Contents taken for one leave their strings open: of 2.2 million, 32 bits alone take some 1,100 for another."""
    texts = [np.random.default_rng(k).bytes(1 << 20) for k in range(16)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(16), pa.int64()), pa.array([0] * 16, pa.int64()), pa.array(texts, pa.binary())], ["id", "tie", "data"])
    blobs = {}
    for rows in substrings._ranked(512)(iter([batch])):
        for bucket, data in zip(rows.column("bucket").to_pylist(), rows.column("rows").to_pylist()):
            blobs.setdefault(bucket, []).append(data)
    n = alike = 0
    for some in blobs.values():
        content = substrings._together(substrings.PLACE, some)[0]["content"]
        n += len(content)
        alike += len(content) - len(np.unique(content))
    assert n > 2_200_000 and alike < 30


def test_the_first_step_keeps_a_row_or_two_of_a_copied_text(spark, docs, monkeypatch):
    written, write = [], substrings.rewritten
    monkeypatch.setattr(substrings, "rewritten", lambda df: written.append(write(df)) or written[-1])
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(5_000)) for _ in range(20)]
    found = substrings.query(spark, docs(texts * 3)).collect()
    assert sorted(r.n_removed for r in found) == [0] * 20 + [5_000] * 40
    assert written[0].count() <= 2 * 60


def test_many_turns_and_a_long_text_as_brute_force(spark, docs, monkeypatch):
    turns, suffixes = set(), substrings._suffixes
    monkeypatch.setattr(substrings, "SUFFIX_BYTES", 3_000)
    monkeypatch.setattr(substrings, "_suffixes", lambda buckets, turn, *rest: turns.add(turn) or suffixes(buckets, turn, *rest))
    rng = random.Random(4)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [make(rng.randrange(120, 2_000)) for _ in range(20)]
    long = make((1 << 20) - 700) + passages[0] + make(200) + passages[1] + make(60_000)
    compare(docs([long, *["".join(rng.choice([make(rng.randrange(200)), rng.choice(passages)]) for _ in range(8)) for _ in range(60)], long[:40] + "!" + long[41:]]))
    assert len(turns) > 2
