import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MORE = ["don't we'll  x's", "a \n b", "a\n \n b ", "tab\t x \t", "  x　 y", "1234567 89", "aaaa" * 999, "=-" * 5000, "ab" * 7001 + "\n" + "ba" * 3000, " 's 'S", "a\n b\n  c", " \n", "\n "]


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def oracle(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def unpack(b):
    return [int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)]


@pytest.mark.parametrize("together", [1, 500, 10**9])
def test_as_tiktoken(ranks, oracle, together, monkeypatch):
    monkeypatch.setattr(bpe, "TOGETHER", together)
    monkeypatch.setattr(bpe, "CACHE", 50 if together == 500 else 10**6)
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + MORE
    texts += ["".join(rng.choice("ab c\n\t .1'sé漢") for _ in range(rng.randrange(60))) for _ in range(1500)]
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert unpack(ids) == oracle.encode_ordinary(t), t[:80]


def test_long_pretoken_takes_the_queue(ranks, oracle):
    word = "".join(random.Random(1).choice("etaoin") for _ in range(50_000))
    encoder, ids = bpe.Encoder(ranks, public_tokenizers.PATTERN), oracle.encode_ordinary(word)
    assert encoder.merge(word.encode()) == ids
    assert [unpack(x) for x in encoder.merge_all([word.encode(), b"ab", word.encode()])] == [ids, encoder.merge(b"ab"), ids]


def test_merges_together_where_a_merge_brings_up_a_lower_rank():
    """Vocabularies made at random, in which the order within a pre-token matters."""
    rng = random.Random(8)
    for _ in range(150):
        tokens = [bytes([k]) for k in range(256)]
        more = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(2, 40))})
        rng.shuffle(more)
        encoder = bpe.Encoder({t: r for r, t in enumerate(tokens + more)}, ".+")
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 24))) for _ in range(40)]
        assert [unpack(x) for x in encoder.merge_all([p for p in pieces if p not in encoder.ranks])] == [encoder.merge(p) for p in pieces if p not in encoder.ranks]


def test_queue_orders_by_rank_then_position():
    rng, queue, held = random.Random(2), bpe.RankQueue(), []
    for _ in range(4000):
        if held and rng.random() < 0.45:
            rank = queue.first()
            assert (rank, queue.pop(rank)) == min(held)
            held.remove(min(held))
        else:
            held.append((rng.randrange(60_000), rng.randrange(1000)))
            queue.push(*held[-1])


def test_query_and_round_trip(spark, docs, ranks, oracle):
    texts = ODD + MORE
    df = docs(texts).withColumn("ids", F.lit("clash"))
    rows = {r.doc_id: r for r in bpe.query(spark, df, PATH, public_tokenizers.PATTERN).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = oracle.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    kept = bpe.encode(df, ranks, public_tokenizers.PATTERN)
    assert kept.columns == df.columns and dict(kept.dtypes)["ids"] == "array<int>"


def test_empty_table(spark, docs):
    assert bpe.query(spark, docs([]), PATH, public_tokenizers.PATTERN).count() == 0
