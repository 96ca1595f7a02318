import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidemark.llm import pii
from tidemark.llm.common import table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def compare(df):
    for r, text in ((r, r.text) for r in pii.query(df.sparkSession, df).join(df.select("doc_id", "text"), "doc_id").collect()):
        want = brute(text)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), (text, want, r)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in PLAIN]
        assert r.spans == told or r.spans.startswith(told)


def test_whole_table_as_brute_force(spark, sf):
    compare(table(spark, sf, "documents"))


def test_random_texts_as_brute_force(spark, docs):
    rng = random.Random(4)
    bits = ["a@b.c", "x_y%z@d-e.f.g", "@", ".", "..", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+", "+49", " ", "-", "é", "漢", "🙂", "(", "12", "\n", "a_", "+12345678901234567", "9" * 25]
    compare(docs(ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(1500)]))


def test_long_runs_take_linear_time(spark, docs):
    texts = ["a" * 300_000 + "@", "1" * 300_000, "1 " * 150_000, "+1" + "(" * 300_000, "A" * 100_000, "." * 100_000 + "@b.c", "a@b" + ".c" * 100_000, "1.2.3.4 " * 3_000]
    got = pii.query(spark, docs(texts)).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [(0, 0, 0, 0)] * 5 + [(1, 0, 0, 0)] * 2 + [(0, 3000, 0, 0)]
    assert got[5].spans == "email:0:100004" and got[6].spans == "email:0:200003"
    assert got[7].spans == ",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(3000))


def test_checksums_and_context(spark, docs):
    texts = ["pay to GB82 WEST 1234 5698 7654 32 today", "pay to GB82 WEST 1234 5698 7654 33 today", "DE89370400440532013000", "password=b7db7aa4a5fcc78305", "plain b7db7aa4a5fcc78305 here", "call (030) 1234-5678 now", "see (030) 1234-5678 now", "SSN 123-45-6789", "no 123-45-6789", "é iban DE89370400440532013000"]
    got = [r.spans for r in pii.query(spark, docs(texts)).orderBy("doc_id").collect()]
    assert got == ["iban:7:34", "", "iban:0:22", "secret:9:27", "", "local_phone:5:20", "", "national_id:4:15", "", "iban:7:29"]


def test_redact(spark, docs):
    df = docs(["mail a@b.cc or +1 (988) 555-2485!", None, "none", "é a@b.cc"]).withColumn("__spans", F.lit(1))
    got = [r.text for r in pii.redact(df).orderBy("doc_id").collect()]
    assert got == ["mail [EMAIL] or [PHONE]!", None, "none", "é [EMAIL]"]


def test_empty(spark, docs):
    assert pii.query(spark, docs([])).count() == 0


def test_secrets_have_no_longest_length(spark, docs):
    got = [r.spans for r in pii.query(spark, docs(["secret=" + "a1" * n for n in (5, 95, 120, 50_000)] + [None])).orderBy("doc_id").collect()]
    assert got == ["", *(f"secret:7:{7 + 2 * n}" for n in (95, 120, 50_000)), ""]
    rows = pii.query(spark, docs([(None, "a@b.cc", "s"), (None, "a@b.cc", "s"), (1, "a@b.cc", "s"), (1, "a@b.cc", "s")])).collect()
    assert [r.spans for r in rows] == ["email:0:6"] * 4
