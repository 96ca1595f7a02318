"""Quotation linking: replies tied to the messages that they quote.

A line that begins with ``>`` signs is quoted, as deep as it has signs. Lines of one
depth that stand together form a passage; a passage of several lines is also taken
line by line, as a reply may quote part of a paragraph. Passages and lines are
normalised (case of A-Z, white space, so that wrapped lines don't matter) and hashed,
and joined by conversation and hash to the first message that has them in its own
words. A message replies to the earlier one that most of its shallowest linked
quotes come from. The chain of replies gives each message its thread, its depth and
its position: the place in a walk through the thread that goes from each message to its
replies in their order, so that by (thread, position) a conversation reads as it was answered.
Only line feeds end lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import durable, free, looked_up, two_level_sum
from tidemark.llm.pii import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The signs of a quoted line, and a line that says whose words follow.
SIGNS = r"^[ \t]*>[> \t]*"
ATTRIBUTION = r"(on|am|le|el) [^\n]*:"
#: Stands between a line's signs and its words; in texts it counts as white space.
MARK = "\x02"


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), r"[\x20\x09-\x0D\x02]+", " "))


def _depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, SIGNS, 0), "[^>]", ""))


def passages(text: Column) -> Column:
    """array<struct<level int, lines array<string>>>: runs of normalised lines of one
    depth, without blank lines and attributions. Level 0 is the message's own."""
    marked = F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.repeat(F.lit(">"), _depth(x)), F.lit(MARK), _normal(F.regexp_replace(x, SIGNS, ""))))
    joined = F.array_join(marked, "\n")
    own = F.regexp_replace(joined, rf"(?md)^{MARK}{ATTRIBUTION}\n(?=>)", "")
    spaced = F.regexp_replace(F.regexp_replace(own, rf"(?md)^>*{MARK}$", ""), rf"(?md)^(>*){MARK}([^\n]+)\n(?!\1{MARK})", rf"$1{MARK}$2" + "\n\n")
    runs = F.filter(F.split(spaced, "\n{2,}", -1), lambda p: F.length(F.trim(F.translate(p, "\n", " "))) > 0)

    def run(p: Column) -> Column:
        signs = F.instr(p, MARK) - 1
        return F.struct(signs.alias("level"), F.transform(F.filter(F.split(p, "\n", -1), lambda x: F.length(x) > 0), lambda x: F.substring(x, signs + 2, F.length(x))).alias("lines"))

    return F.transform(runs, run)


def units(messages: DataFrame) -> DataFrame:
    """conversation, turn, level, unit (hash), size in characters: each passage, and each line of longer ones."""
    each = messages.select("conversation", "turn", F.explode(passages(F.coalesce("text", F.lit("")))).alias("p")).select("conversation", "turn", "p.*")
    parts = F.concat(F.array(F.array_join("lines", " ")), F.when(F.size("lines") > 1, F.col("lines")).otherwise(F.array().cast("array<string>")))
    return each.select("conversation", "turn", "level", F.explode(parts).alias("part")).select("conversation", "turn", "level", F.md5(F.col("part").cast("binary")).alias("unit"), F.length("part").alias("size"))


def links(messages: DataFrame) -> DataFrame:
    """conversation, turn, level, unit, size, origin: each quoted unit that an earlier message has in its own words; origin is the turn of the first that does."""
    quoted = durable(units(messages.where(F.col("text").contains(">"))).where("level > 0 and turn is not null"))
    first = units(messages).where("level = 0").groupBy(F.col("conversation").alias("__c"), F.col("unit").alias("__u")).agg(F.min("turn").alias("origin"))
    asked = quoted.select(F.col("conversation").alias("__c"), F.col("unit").alias("__u")).distinct()
    first = durable(first.join(asked, ["__c", "__u"], "left_semi"))  # it is read twice, and the most of it is never quoted
    return looked_up(quoted, ["conversation", "unit"], first, ["__c", "__u"]).where("origin < turn")


def replies(linked: DataFrame) -> DataFrame:
    """conversation, turn, parent, n_links from ``links``. Of the shallowest level with links the origin with most characters, of equals the latest."""
    votes = linked.groupBy("conversation", "turn", "level", "origin").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    best = F.max_by("origin", F.struct(-F.col("level"), "size", "origin"))
    return votes.groupBy("conversation", "turn").agg(best.alias("parent"), F.sum("n").alias("n_links"))


def _summed_upwards(replied: DataFrame, value: str) -> DataFrame:
    """Adds thread (the turn that a chain of parents ends at), depth (its length) and ``sum`` of ``value`` along it, its own included.

    Pointers are doubled: rounds grow as the logarithm of the longest chain, and the
    driver sees one count a round. A parent is always earlier, so chains end.
    """
    now = durable(replied.select("*", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth"), F.col(value).alias("sum")))
    total = now.count()
    while True:
        up = now.select(F.col("conversation").alias("__c"), F.col("turn").alias("__t"), F.col("thread").alias("__up"), F.col("depth").alias("__more"), F.col("sum").alias("__sum"))
        ends = now.select(F.col("conversation").alias("__c"), F.col("thread").alias("__t")).distinct()
        if not ends.join(up, ["__c", "__t"], "left_semi").limit(1).count():
            return now
        longer = looked_up(now, ["conversation", "thread"], up, ["__c", "__t"], total).select(*replied.columns, F.coalesce("__up", "thread").alias("thread"), *[(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("depth", "__more"), ("sum", "__sum"))])
        now = durable(longer)


def _sizes(replied: DataFrame) -> DataFrame:
    """Adds ``size``: the message and all that follow from it. In round k a message has counted those less than 2^k replies away, and adds what the ones 2^k away have."""
    now = durable(replied.select("*", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("size")))
    at, total = (F.col("conversation") == F.col("__c")) & (F.col("turn") == F.col("__t")), now.count()
    while now.where("jump is not null").limit(1).count():
        below = now.where("jump is not null").groupBy(F.col("conversation").alias("__c"), F.col("jump").alias("__t")).agg(F.sum("size").alias("__size"))
        up = now.select(F.col("conversation").alias("__c2"), F.col("turn").alias("__t2"), F.col("jump").alias("__up"))
        grown = looked_up(now.join(below, at, "left"), ["conversation", "jump"], up, ["__c2", "__t2"], total)
        now = durable(grown.select(*replied.columns, F.col("__up").alias("jump"), (F.col("size") + F.coalesce("__size", F.lit(0))).alias("size")))
    return now.drop("jump")


def threads(replied: DataFrame) -> DataFrame:
    """Adds thread, depth, and position: the messages of the thread that stand before, in a walk from each to its replies by turn.

    That is, summed along the chain, one and the sizes of the earlier replies to the same message. These are
    summed in two levels, as one message may have any number of replies.
    """
    sized = _sizes(replied).withColumn("chunk", F.floor(F.col("turn") / 4096))
    ahead = two_level_sum(sized, ["conversation", "parent"], "chunk", ["turn"], "size", "ahead")
    step = ahead.select("conversation", "turn", "parent", "n_links", (1 + F.col("ahead")).cast("long").alias("step"))
    return _summed_upwards(step, "step").select("conversation", "turn", "parent", "n_links", "thread", "depth", F.col("sum").alias("position"))


def without_quotes(text: Column) -> Column:
    """The message's own lines, trimmed; a text without quoted lines is left as it is, null too."""

    def own(lines: Column) -> Column:
        def keep(x: Column, i: Column) -> Column:
            follows = F.get(lines, i + 1).rlike(SIGNS)
            names = F.coalesce(follows, F.lit(False)) & _normal(x).rlike(rf"^{ATTRIBUTION}\z")
            return ~x.rlike(SIGNS) & ~names

        return F.regexp_replace(F.array_join(F.filter(lines, keep), "\n"), r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")

    return F.when(text.rlike(rf"(?md){SIGNS}"), let(F.split(text, "\n", -1), own)).otherwise(text)


def n_quotes(text: Column) -> Column:
    return F.when(text.contains(">"), F.size(F.filter(passages(text), lambda p: p["level"] > 0))).otherwise(0).cast("long")


def link(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The messages, ``text`` without quotes, with n_quotes (quoted passages), n_links (quoted passages and
    lines whose origin was found), parent (turn replied to, or null), thread (turn that the chain of replies
    starts with; its own if it replies to none), depth (replies up to that) and position (messages of the
    thread before it, 0 for the first).

    Rows that agree in conversation and turn are parts of one message: they share parent, thread, depth and position. A
    row without conversation or turn is linked to nothing. Null and empty texts quote nothing. Other
    columns stay, whatever their names, but for those named as the added ones, which are replaced. Ordered by conversation, thread and position, a conversation
    reads in the order of its replies. A conversation may hold any part of all rows, and so may the messages that quote one passage or reply to one message:
    every join is by conversation and turn, or conversation and hash, with one row on one side, and goes to the rows where a key is hot.
    """
    added = ("n_quotes", "n_links", "parent", "thread", "depth", "position")
    base = messages.drop(*added)
    plain = base.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.col(text).alias("text"))
    own = [free("__c", base), free("__t", base)]
    found = threads(replies(links(plain))).select(F.col("conversation").alias(own[0]), F.col("turn").alias(own[1]), *added[1:])
    both = looked_up(base, [conversation, turn], found, own)
    return both.select(
        *[F.col(c) if c != text else without_quotes(F.col(c)).alias(c) for c in base.columns],
        F.coalesce(n_quotes(F.col(text)), F.lit(0).cast("long")).alias("n_quotes"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "parent",
        F.coalesce("thread", F.col(turn)).alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("position", F.lit(0)).cast("long").alias("position"),
    )


def query(spark: SparkSession, messages: DataFrame) -> DataFrame:
    return link(messages.select("conv_id", "turn", "role", "text"))


SQL = r"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text FROM conversations),
lines AS (
  SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM src WHERE text IS NOT NULL),
parsed AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*>[> \t]*'), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(translate(regexp_replace(line, '^[ \t]*>[> \t]*', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D\x02]+', ' ', 'g')) AS body
  FROM lines),
marked AS (
  SELECT *, level = 0 AND regexp_full_match(body, '(on|am|le|el) .*:')
    AND coalesce(lead(level) OVER (PARTITION BY rid ORDER BY i), 0) > 0 AS attribution FROM parsed),
kept AS (SELECT * FROM marked WHERE NOT attribution AND body <> ''),
breaks AS (
  SELECT *, CASE WHEN i - lag(i) OVER w = 1 AND level = lag(level) OVER w THEN 0 ELSE 1 END AS b FROM kept WINDOW w AS (PARTITION BY rid ORDER BY i)),
runs AS (SELECT *, sum(b) OVER (PARTITION BY rid ORDER BY i) AS run FROM breaks),
paragraphs AS (
  SELECT rid, conv_id, turn, level, run, string_agg(body, ' ' ORDER BY i) AS part, count(*) AS n FROM runs GROUP BY ALL),
units AS (
  SELECT rid, conv_id, turn, level, part FROM paragraphs
  UNION ALL
  SELECT r.rid, r.conv_id, r.turn, r.level, r.body FROM runs r JOIN paragraphs p ON p.rid = r.rid AND p.run = r.run WHERE p.n > 1),
origins AS (SELECT conv_id, part, min(turn) AS origin FROM units WHERE level = 0 GROUP BY ALL),
links AS (
  SELECT u.*, o.origin FROM units u JOIN origins o ON u.conv_id = o.conv_id AND u.part = o.part WHERE u.level > 0 AND o.origin < u.turn),
votes AS (SELECT conv_id, turn, level, origin, sum(length(part)) AS size, count(*) AS n FROM links GROUP BY ALL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, size DESC, origin DESC) AS rk,
    sum(n) OVER (PARTITION BY conv_id, turn) AS n_links FROM votes),
replies AS (SELECT conv_id, turn, origin AS parent, n_links FROM best WHERE rk = 1),
chain AS (
  SELECT conv_id, turn, parent AS up, 1 AS depth FROM replies
  UNION ALL
  SELECT c.conv_id, c.turn, r.parent, c.depth + 1 FROM chain c JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.up),
tops AS (SELECT conv_id, turn, min(up) AS thread, max(depth) AS depth FROM chain GROUP BY ALL),
sizes AS (
  SELECT r.conv_id, r.turn, r.parent, 1 + count(c.turn) AS size FROM replies r
  LEFT JOIN chain c ON c.conv_id = r.conv_id AND c.up = r.turn GROUP BY ALL),
steps AS (
  SELECT *, 1 + coalesce(sum(size) OVER (PARTITION BY conv_id, parent ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step
  FROM sizes),
positions AS (
  SELECT s.conv_id, s.turn, any_value(s.step) + coalesce(sum(u.step), 0) AS position FROM steps s
  JOIN chain c ON c.conv_id = s.conv_id AND c.turn = s.turn LEFT JOIN steps u ON u.conv_id = c.conv_id AND u.turn = c.up GROUP BY ALL),
own AS (
  SELECT rid, max(level) AS most, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT attribution) AS reply FROM marked GROUP BY rid),
quotes AS (SELECT rid, count(*) AS n_quotes FROM paragraphs WHERE level > 0 GROUP BY rid)
SELECT s.conv_id, s.turn, s.role,
  CASE WHEN own.most > 0 THEN regexp_replace(coalesce(own.reply, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') ELSE s.text END AS text,
  coalesce(q.n_quotes, 0) AS n_quotes, CAST(coalesce(r.n_links, 0) AS BIGINT) AS n_links, r.parent,
  coalesce(t.thread, s.turn) AS thread, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth,
  CAST(coalesce(p.position, 0) AS BIGINT) AS position
FROM src s LEFT JOIN own ON own.rid = s.rid LEFT JOIN quotes q ON q.rid = s.rid
LEFT JOIN replies r ON r.conv_id = s.conv_id AND r.turn = s.turn LEFT JOIN tops t ON t.conv_id = s.conv_id AND t.turn = s.turn
LEFT JOIN positions p ON p.conv_id = s.conv_id AND p.turn = s.turn
"""
