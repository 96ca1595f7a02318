import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, differences
from tidemark.llm import hosts, queries

SCHEMA = "page_id long, url string, html string"


def write(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def linked(*targets):
    return "<p>" + "".join(f'<a class="x" HREF="{t}">t</a>' for t in targets)


def both(spark, folder):
    return differences(spark, connect(folder), queries.QUERIES["op13_url_trust"], hosts.SQL, folder)


ODD = [
    (1, None, None), (2, "", ""), (3, "no scheme/x", linked("https://a.net/")), (4, "http://", None), (5, "HTTP://WWW.Example.NET/en/a?b#c", None), (6, "x://net/", None), (7, "http://net", None), (8, "http://xnet/", None),
    (9, "http://a.example.net/en", None), (10, "http://a.example.net/en/", None), (11, "http://example.com/de/x", None), (12, "http://m.example.com/DE/x", None), (13, "a://b://c.net/x", None), (14, "http://É.Net/\n/x", None),
    (15, "http://user@h.org:80/fr/", None), (16, "http://..net/", None), (None, "http://q.org/fr/", None), (None, "http://q.org/fr/", None), (17, "http://q.org?x/fr/", None), (18, "http://q.org/fr/#" + "x" * 50_000, "<a <a " * 20_000),
]


def test_tables_as_sql(spark, sf):
    n, m, bad = both(spark, sf)
    assert n == m and not bad


def test_odd_urls_as_sql(spark, tmp_path):
    n, m, bad = both(spark, write(spark, ODD, tmp_path))
    assert n == m == len(ODD) and not bad


def test_empty(spark, tmp_path):
    assert both(spark, write(spark, [], tmp_path)) == (0, 0, [])


def test_verdicts_of_rules(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.query(spark, spark.createDataFrame(ODD, SCHEMA)).collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[5] == ("www.example.net", "/en/a", "example.net/en/", "allow")
    assert got[6] == ("net", "/", "net/", "block") and got[7][2] is None and got[8][2] is None
    assert got[9][2:] == ("net/", "block") and got[10][2:] == ("example.net/en/", "allow") and got[11][2:] == ("example.com/de/", "block") and got[12][2] is None
    assert got[13][:3] == ("b:", "//c.net/x", None) and got[14][:2] == ("É.net", "/\n/x") and got[17][1] == ""


@pytest.fixture(scope="module")
def web():
    """Random links among 60 hosts, trusted, blocked and unknown, and a hub that a third of all pages belong to and link to."""
    rng, names = random.Random(2), [f"h{k}.example.org" for k in range(40)] + [f"s{k}.net" for k in range(12)] + [f"t{k}.info" for k in range(8)]
    rows = []
    for k in range(1500):
        name = "hub.info" if k % 3 == 0 else rng.choice(names)
        out = [rng.choice(["https://", "//", "HTTP://"]) + rng.choice(names).upper() + rng.choice(["", "/x", "?y"]) for _ in range(rng.randrange(4))]
        rows.append((k, f"http://{name}/{rng.choice(['fr', 'en'])}/{k}", linked(*out, "/own", *(["//hub.info/"] if rng.random() < 0.3 else []))))
    return rows


def test_links_as_sql(spark, web, tmp_path):
    n, m, bad = both(spark, write(spark, web, tmp_path))
    assert n == m == len(web) and not bad


def test_scores_as_numpy(spark, web):
    rng = np.random.default_rng(3)
    for most in (hosts.EDGES, 7):
        pairs = sorted({(a, b) for a, b in rng.integers(0, 50, (400, 2)).tolist() if a != b} | {(k, 0) for k in range(1, 50)})
        n = rng.integers(1, 5, len(pairs))
        seed = rng.random((50, 2)) * (rng.random((50, 2)) < 0.2)
        edges = spark.createDataFrame([(str(a), str(b), int(x)) for (a, b), x in zip(pairs, n)], "source string, target string, n long")
        seeds = spark.createDataFrame([(str(k), float(s[0]), float(s[1])) for k, s in enumerate(seed)], "host string, trust double, distrust double")
        got = {int(r.host): (r.trust, r.distrust) for r in hosts.propagate(edges, seeds, most=most).collect()}
        w = np.zeros((50, 50))
        for (a, b), x in zip(pairs, n):
            w[a, b] = x
        for kind, m in enumerate((w, w.T)):
            share = m / np.maximum(m.sum(1, keepdims=True), 1)
            v = 0.15 * seed[:, kind]
            for _ in range(hosts.ROUNDS):
                v = 0.15 * seed[:, kind] + 0.85 * share.T @ v
            assert [got.get(k, (0, 0))[kind] for k in range(50)] == pytest.approx(v.tolist(), abs=1e-12)


def test_distrust_flows_against_links_and_trust_along_them(spark):
    pages = [(1, "http://farm.info/1", linked("https://spam.net/", "https://more.net/x")), (2, "http://spam.net/", None), (3, "http://good.org/fr/1", linked("https://friend.info/")), (4, "http://friend.info/1", linked("https://spam.net/")), (5, "http://plain.info/1", None), (6, "http://more.net/", None)]
    got = {r.host: r for r in hosts.query(spark, spark.createDataFrame(pages, SCHEMA)).collect()}
    assert [got[h].verdict for h in ("farm.info", "friend.info", "plain.info", "good.org", "spam.net")] == ["block", "allow", "allow", "allow", "block"]
    assert got["farm.info"].distrust > hosts.BLOCK and got["friend.info"].trust > got["friend.info"].distrust > 0


def test_clashing_columns_give_way_and_others_stay(spark):
    df = spark.createDataFrame(ODD[:6], SCHEMA).withColumns({c: F.lit("mine") for c in ("host", "path", "rule", "n_pages", "rules", "Verdict", "rule_host")})
    rows = hosts.judge(df, hosts.rules_table(spark)).collect()
    assert len(rows) == 6 and {r.rule_host for r in rows} == {"mine"} and {r.host for r in rows} == {"", "www.example.net", "net"}
