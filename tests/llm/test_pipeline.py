"""The pipeline's rows against the same stages done plainly, one text at a time."""

import hashlib
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.conftest import ODD
from tidemark.llm import bpe, mixing, simhash, toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    plain = "the river runs past the old mill and the children play near the water every long summer day"
    texts = []
    for i in range(60):
        words = plain.split()
        ordinary = " ".join(words[(i * 7 + k * (i + 3)) % len(words)] + ("" if k % 4 else str(i * 31 + k)) for k in range(30))
        texts.append(f"you vile scumbag{i % 3} {ordinary} rotten scumbag filth" if i % 4 == 0 else ordinary)
    texts += [texts[1], texts[2] + " ", "Mail ann@example.org or call +49 30 1234567 now", "card 4111 1111 1111 1111", *[t for t in ODD if "\x00" not in (t or "")]]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    docs(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def test_rows_match_plain_version(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    rows = sorted((r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), key=lambda r: r["doc_id"])
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r, p in zip(rows, model.of([r["text"] for r in rows])) if p < 0.5]
    toxic = {i for i in range(60) if i % 4 == 0}
    assert not toxic & {r["doc_id"] for r in rows} and len(rows) > 50

    prints = [simhash.fingerprint_of(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    rows = [r for i, r in enumerate(rows) if top(i) == i]

    for r in rows:
        t = r["text"]
        if t is not None and "@" in t:
            r["text"] = "Mail [EMAIL] or call [PHONE] now"
        elif t is not None and "4111" in t:
            r["text"] = "card [CARD]"
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in rows])
    takes = {d[0]: d[4] for d in db.execute(mixing.SQL).fetchall()}
    encoding = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    want = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        while takes[r["doc_id"]] > 0:
            n = min(takes[r["doc_id"]], len(words))
            takes[r["doc_id"]] -= n
            text = r["text"] if n == len(words) else " ".join(words[:n])
            want.append((r["doc_id"], encoding.encode_ordinary(text)))
    assert sorted((r.doc_id, r.ids) for r in got) == sorted(want)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_columns_and_stand_empty_tables(spark, sf_dir):
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for rows in (whole.limit(0), whole):
        now = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.rewritten(stage(spark, now, sf_dir))
            assert now.columns == whole.columns, name
    out = corpus_pipeline.STAGES[-1][1](spark, whole.limit(0), sf_dir)
    assert out.count() == 0


def test_digest_of_ids_is_stable(spark, sf_dir):
    def digest():
        return hashlib.sha256(repr(sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect())).encode()).hexdigest()

    assert digest() == digest()
