"""URL filters by link-graph propagation.

Rules allow or block hosts, with all their subdomains, from a path on. Pages that a rule
fits are settled by it, and make their hosts seeds: a host's share of allowed pages is
its trust, of blocked pages its distrust. Trust goes along the links, shared among the hosts that
a host links to; distrust goes against them, shared among the hosts that link to a host.
Both are personalised PageRanks: at each step a host keeps ``1 - DAMPING`` of its seed and
takes ``DAMPING`` of what arrives. Scores are in shares of a wholly allowed or blocked
host, whatever the number of hosts, so that one threshold serves every size of graph.

All of it is joins and sums by host. Edges are pairs of hosts, counted once a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import durable

#: Host and path of each rule, and its verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Share of a host's score that comes over links, rounds, and the distrust from which a host is blocked: that of a host by itself with half its pages blocked.
DAMPING, ROUNDS, BLOCK = 0.85, 20, 0.075
#: Edges of a host in one direction that one task joins; the edges of a host with more are dealt to several.
EDGES = 250_000
#: A host is hot if one of this many pages or more is its own: there are never more hot ones than this, and they are broadcast.
HOT = 1000

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)<a\s[^<>]*?\bhref\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(value: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(value, _UPPER, _LOWER)


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, question mark or hash, A-Z lower-cased; empty where there is none."""
    return lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path(url: Column) -> Column:
    """From the host's end up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(v).alias("rule_verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: those whose host it is or lies under, the longest first, a longer host first among equals and then block. ``hosts`` has a column ``host`` without repeats."""
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
    named = F.concat("rule_host", "rule_path")
    found = above.join(rules, "rule_host").groupBy("host").agg(
        F.sort_array(F.collect_set(F.struct((-F.length(named)).alias("size"), (-F.length("rule_host")).alias("host_size"), F.when(F.col("rule_verdict") == "block", 0).otherwise(1).alias("kind"), named.alias("rule"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict")))).alias("rules")
    )
    return hosts.join(found, "host", "left")


def rule_of(rules: Column, path: Column) -> Column:
    """The first of a host's rules that fits the path: a struct, or null."""
    return F.get(F.filter(F.coalesce(rules, F.array().cast("array<struct<size:int,host_size:int,kind:int,rule:string,path:string,verdict:string>>")), lambda r: F.startswith(path, r["path"])), F.lit(0))


def by_host(pages: DataFrame, hosts: DataFrame, counted: DataFrame, total: int) -> DataFrame:
    """``pages`` (with a column ``host``) joined to ``hosts``. Hosts of a thousandth of all pages or more, of which there are at most a thousand, are
    broadcast, so that no task gets a hot host's pages; the others are joined by host. ``counted`` has host and n_pages."""
    hot = F.col("n_pages") * HOT >= total
    marked = counted.where(hot).select("host", F.lit(True).alias("__hot"))
    dealt = pages.join(F.broadcast(marked), "host", "left")
    first = dealt.where("__hot").drop("__hot").join(F.broadcast(hosts.join(F.broadcast(marked), "host", "left_semi")), "host")
    rest = dealt.where("__hot is null").drop("__hot").join(hosts.join(F.broadcast(marked), "host", "left_anti"), "host")
    return first.unionByName(rest)


def edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """source, target, n: links to other hosts, each pair of hosts once a page. ``pages`` has a column ``host``."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)), lower))
    linked = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(targets).alias("target"))
    return linked.where("target <> '' and target <> source").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, most: int = EDGES) -> DataFrame:
    """host, trust, distrust for each host that has a score, from edges (source, target, n) and seeds (host, trust, distrust).

    Trust of a host is ``(1 - damping)`` of its seed and ``damping`` of what its links bring: each source gives its
    trust to its targets, in proportion to n. Distrust is the same with all edges turned. What a host without
    edges would give on is lost. A host's edges are dealt to tasks by its number of them, and sums are partial before a shuffle, so that
    hosts that a third of all others link to are no task's alone.
    """
    both = edges.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("source").alias("giver"), F.col("target").alias("taker"), "n"), F.struct(F.lit(1).alias("kind"), F.col("target").alias("giver"), F.col("source").alias("taker"), "n"))).alias("e")).select("e.*")
    givers = both.groupBy("kind", "giver").agg(F.sum("n").alias("given"), F.count(F.lit(1)).alias("n_edges"))
    givers = durable(givers.select("kind", "giver", "given", F.ceil(F.col("n_edges") / most).cast("int").alias("parts")))
    # a giver with several parts is repeated for each of them, and its edges are dealt by their takers
    repeated = givers.select("kind", "giver", "given", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    large = givers.where("parts > 1").select("kind", "giver", F.col("parts").alias("__parts"))  # one for each EDGES edges at most
    dealt = both.join(F.broadcast(large), ["kind", "giver"], "left").withColumn("part", F.pmod(F.xxhash64("taker"), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    weighed = durable(dealt.join(repeated.drop("parts"), ["kind", "giver", "part"]).select("kind", "giver", "part", "taker", (damping * F.col("n") / F.col("given")).alias("share")))
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trust").alias("score")), F.struct(F.lit(1).alias("kind"), F.col("distrust").alias("score")))).alias("s")).select("s.kind", "host", ((1 - damping) * F.col("s.score")).alias("score"))
    start = durable(start.where("score > 0"))
    parts = givers.select("kind", F.col("giver").alias("host"), "parts")
    now = start
    for k in range(rounds if weighed.take(1) else 0):
        held = now.join(parts, ["kind", "host"]).select("kind", F.col("host").alias("giver"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "score")
        came = weighed.join(held, ["kind", "giver", "part"]).select("kind", F.col("taker").alias("host"), (F.col("share") * F.col("score")).alias("score"))
        now = start.unionByName(came).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % 5 == 4 or k + 1 == rounds:
            now = durable(now)
    return now.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("score"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("score"))), F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html", damping: float = DAMPING, rounds: int = ROUNDS, block: float = BLOCK) -> DataFrame:
    """Adds host, path, rule, verdict, trust and distrust to all columns of ``pages`` but the html, in place of columns of these names.

    A page's verdict is its rule's; without one, block if its host's distrust is above its trust and at least ``block``, else allow.
    A null url, or one without ``://``, has an empty host and path, no rule and no scores, and is allowed. Null html has no links. Pages that come again count again.
    """
    added = {"host", "path", "rule", "verdict", "trust", "distrust"}
    others = [c for c in pages.columns if c.lower() not in added | {html.lower()}]
    told = pages.select(F.struct(*[F.col(c) for c in others]).alias("page") if others else F.lit(0).alias("page"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    counted = told.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    hosts = durable(fitting(counted, rules))
    total = hosts.agg(F.coalesce(F.sum("n_pages"), F.lit(0))).first()[0]
    counted = hosts.select("host", "n_pages")
    ruled = by_host(pages.select(host(F.col(url)).alias("host"), path(F.col(url)).alias("path")), hosts.where(F.col("rules").isNotNull()).select("host", "rules"), counted, total)
    settled = ruled.select("host", rule_of(F.col("rules"), F.col("path"))["verdict"].alias("v")).where("v is not null").groupBy("host").agg(F.count_if(F.col("v") == "allow").alias("allowed"), F.count_if(F.col("v") == "block").alias("blocked"))
    seeds = counted.join(settled, "host").select("host", (F.col("allowed") / F.col("n_pages")).alias("trust"), (F.col("blocked") / F.col("n_pages")).alias("distrust"))
    scores = propagate(edges(pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html"))), seeds, damping, rounds)
    settled = durable(hosts.join(scores, "host", "left").select("host", "rules", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    found = by_host(told, settled, counted, total).withColumn("rule", rule_of(F.col("rules"), F.col("path")))
    method = F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= block), "block").otherwise("allow")
    return found.select(*[F.col("page")[c].alias(c) for c in others], "host", "path", F.col("rule")["rule"].alias("rule"), F.coalesce(F.col("rule")["verdict"], method).alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url", "html"), rules_table(spark)).select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def _sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    start = f"""
WITH rules AS (
  SELECT * FROM (VALUES {rules}) r(rule_host, rule_path, rule_verdict)
), p AS (
  SELECT row_number() OVER () AS row_id, page_id, coalesce(html, '') AS html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), r AS (
  SELECT row_id, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY row_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_verdict DESC) AS place
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), judged AS (
  SELECT p.*, rule, rule_verdict FROM p LEFT JOIN r ON p.row_id = r.row_id AND place = 1
), seeds AS (
  SELECT host, count(*) FILTER (rule_verdict = 'allow') / count(*) AS trust, count(*) FILTER (rule_verdict = 'block') / count(*) AS distrust FROM judged GROUP BY host
), links AS (
  SELECT host AS source, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)<a\\s[^<>]*?\\bhref\\s*=\\s*[\"'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"''\\s<>]*)', 1), lambda x: translate(x, '{_UPPER}', '{_LOWER}')))) AS target
  FROM p WHERE host <> ''
), edges AS (
  SELECT source, target, count(*) AS n FROM links WHERE target <> '' AND target <> source GROUP BY ALL
), turned AS (
  SELECT 0 AS kind, source AS giver, target AS taker, n FROM edges UNION ALL SELECT 1, target, source, n FROM edges
), shares AS (
  SELECT kind, giver, taker, {DAMPING} * n / sum(n) OVER (PARTITION BY kind, giver) AS share FROM turned
), s0 AS MATERIALIZED (
  SELECT 0 AS kind, host, {1 - DAMPING:.2f} * trust AS score FROM seeds WHERE trust > 0 UNION ALL SELECT 1, host, {1 - DAMPING:.2f} * distrust FROM seeds WHERE distrust > 0
)"""
    for k in range(1, ROUNDS + 1):
        start += f""", s{k} AS MATERIALIZED (
  SELECT kind, host, sum(score) AS score FROM (SELECT * FROM s0 UNION ALL SELECT e.kind, taker, share * score FROM shares e JOIN s{k - 1} s ON e.kind = s.kind AND giver = host) GROUP BY ALL
)"""
    return start + f""", scores AS (
  SELECT host, coalesce(sum(score) FILTER (kind = 0), 0) AS trust, coalesce(sum(score) FILTER (kind = 1), 0) AS distrust FROM s{ROUNDS} GROUP BY host
)
SELECT page_id, j.host, path, rule, coalesce(rule_verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) AND distrust >= {BLOCK} THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust
FROM judged j LEFT JOIN scores s ON j.host = s.host
"""


SQL = _sql()
