"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in a shuffled order, form a stream of words that
repeats, and the stream is cut into blocks of equal length. A source needs so
many blocks for its target; the slots of the mix are dealt to the sources by a
van der Corput sequence: slot k's point is the number k with its bits reversed,
over 2^m, and the point falls into one source's part of the cumulative weights.
As every point of the grid comes once, each source gets exactly the slots it
needs, evenly spread over the whole mix. The r-th slot of a source then takes
the source's r-th block, the last one only as far as the target goes.

Only numbers are sorted and joined; texts are read once to count their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import durable, free, n_words, two_level_sum, words

#: Weights of the sources in code point order, repeating; share of all words to take; how often a source may repeat.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Words in a block.
BLOCK = 1024
SEED = "mix:"


def shuffled(doc_id: str | Column) -> Column:
    """The key that documents of a source are shuffled by, the same on every run."""
    return F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """A row for each source (null is one): sid, source, source_size, docs, weight, target.

    Water filling: a source whose part by weight exceeds ``repeats`` times its size
    stops there, and the rest is shared anew. In the order of size to weight the
    sources that stop come first, so one pass over running sums finds them all.
    The window spans one row for each source, never documents.
    """
    by_name = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name = by_name.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    by_name = by_name.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    by_name = by_name.withColumn("cap", repeats * F.col("source_size")).withColumn("level", F.col("cap") * 1.0 / F.col("weight"))
    order = W.orderBy("level", "sid")
    rest = F.lit(share) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_name = by_name.withColumn("each", rest / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    free = F.when(F.col("each") * F.col("weight") <= F.col("cap"), F.struct("level", "sid", "each"))
    each = F.min(free).over(W.partitionBy())["each"]
    return by_name.withColumn("target", F.least(F.col("cap").cast("double"), each * F.col("weight"))).drop("cap", "level", "each")


def plan(sources: DataFrame, block: int) -> DataFrame:
    """Adds to ``targets`` what the schedule needs: blocks, full passes, words of the last pass, slots, first cell."""
    take = F.floor("target").cast("long")
    some = F.col("source_size") > 0
    got = sources.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    got = got.withColumn("passes", F.when(some, F.floor(take / F.col("source_size"))).otherwise(0).cast("long"))
    got = got.withColumn("over", take - F.col("passes") * F.col("source_size"))
    got = got.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("over") / block).cast("long"))
    return got.withColumn("first", F.coalesce(F.sum("slots").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def schedule(sources: DataFrame, slots: int, block: int) -> DataFrame:
    """sid, slot (place in the mix), rank (the source's slots counted), block, limit (words taken from the block's start)."""
    m = max(2, (max(slots, 1) - 1).bit_length())
    wide = 1 << max(10, (m + 1) // 2)  # cells that a source is looked up by
    cells = sources.sparkSession.range(slots).select(F.col("id").alias("cell"), F.floor(F.col("id") / wide).alias("near"))
    parts = sources.where("slots > 0").select("sid", "blocks", "passes", "over", "slots", "first", F.explode(F.sequence(F.floor(F.col("first") / wide), F.floor((F.col("first") + F.col("slots") - 1) / wide))).alias("near"))
    owned = cells.join(parts, "near").where((F.col("cell") >= F.col("first")) & (F.col("cell") < F.col("first") + F.col("slots")))
    slot = F.conv(F.reverse(F.lpad(F.bin("cell"), m, "0")), 2, 10).cast("long")
    dealt = owned.select("sid", "blocks", "passes", "over", slot.alias("slot")).withColumn("chunk", F.shiftright("slot", m // 2)).withColumn("one", F.lit(1).cast("long"))
    ranked = two_level_sum(dealt, ["sid"], "chunk", ["slot"], "one", "rank")
    number = F.pmod(F.col("rank"), F.col("blocks"))
    last = F.floor(F.col("rank") / F.col("blocks")) >= F.col("passes")
    limit = F.when(last, F.least(F.lit(block).cast("long"), F.col("over") - number * block)).otherwise(F.lit(block).cast("long"))
    return ranked.select("sid", "slot", "rank", number.alias("block"), limit.alias("limit"))


def _source_of(sources: DataFrame, *more: str) -> DataFrame:
    return sources.select(F.col("source").alias("__source"), *more)


def pieces(docs: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """sid, doc_id, source, size, start, slot, from, to: the words that each slot takes of each document, counted from its first word.

    ``docs`` has doc_id, source and size. A source's shuffled documents are cut into blocks, and its r-th slot takes
    its r-th block; so a document has a piece for each slot of each block that it reaches into.
    """
    slots, rows = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    bits = min(28, (rows.bit_length() + 1) // 2)
    some = docs.where("size > 0").join(_source_of(sources, "sid"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("key", shuffled("doc_id"))
    some = some.withColumn("chunk", F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("long"), 28 - bits))
    placed = two_level_sum(some, ["sid"], "chunk", ["key", "doc_id", "size"], "size", "start")
    cut = placed.select("sid", "doc_id", "source", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    begins = F.greatest(F.col("start"), F.col("block") * block)
    ends = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("limit"))
    each = cut.join(schedule(sources, slots, block), ["sid", "block"]).where(ends > begins)
    return each.select("sid", "doc_id", "source", "size", "start", "slot", (begins - F.col("start")).alias("from"), (ends - F.col("start")).alias("to"))


def _prepared(docs: DataFrame, weights: tuple[int, ...], share: float, repeats: int, block: int) -> tuple[DataFrame, DataFrame]:
    sized = durable(docs.select("doc_id", "source", n_words("text").alias("size")))
    return sized, durable(plan(targets(sized, weights, share, repeats), block))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot, n_slots: how many of a document's words the mix takes, repeats counted, and
    the first and the number of the slots that take them.

    A null or empty text has no words and is not taken. A null source is a source,
    the last one; a null id is shuffled as an empty one. Rows alike in all columns are
    rows of their own. Only doc_id, text and source are read. The counts of each
    source are exact: floor(target) words.
    """
    sized, sources = _prepared(docs, weights, share, repeats, block)
    took = pieces(sized, sources, block).groupBy("sid", "start").agg(F.sum(F.col("to") - F.col("from")).alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"), *[F.first(c).alias(c) for c in ("doc_id", "source", "size")])
    # those that no slot takes, by number: rows alike in these columns needn't be told apart
    same = ("doc_id", "source", "size")
    left = sized.groupBy(*same).agg(F.count(F.lit(1)).alias("rows")).join(took.groupBy(*[F.col(c).alias(f"__{c}") for c in same]).agg(F.count(F.lit(1)).alias("took")), _and(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same), "left")
    none = left.withColumn("n", (F.col("rows") - F.coalesce("took", F.lit(0))).cast("int")).where("n > 0").select(*same, F.explode(F.array_repeat(F.lit(0).cast("long"), F.col("n"))).alias("taken"))
    none = none.select(*same, "taken", F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("n_slots"))
    both = took.select(*none.columns).unionByName(none)
    named = both.join(_source_of(sources, "source_size", "target"), F.col("source").eqNullSafe(F.col("__source")))
    return named.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def _and(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, slot: str | None = None) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns, sorted by slot, so that files and partitions follow the mix.

    Each pass over a source takes a document once, and its copy stands at the first slot of that pass that takes words of it.
    Whole passes give whole copies; a last, partial pass gives a copy with the first
    words only, joined by single spaces (at most one document of a source). Rows that
    agree in doc_id, source and size are numbered by their texts' hashes, and the k-th of them is the k-th that the mix takes. ``slot`` names a column to add with the slot.
    """
    sized, sources = _prepared(docs, weights, share, repeats, block)
    same = ("doc_id", "source", "size")
    # the k-th time that a document's first word is taken begins its k-th copy
    starts = pieces(sized, sources, block).groupBy(*same, "start").agg(F.sum(F.col("to") - F.col("from")).alias("taken"), F.array_sort(F.collect_list(F.when(F.col("from") == 0, F.col("slot")))).alias("slots"))
    n, cut, id_, source, size, slots, counted, k = (free(x, docs) for x in ("__n", "__part", "__id", "__source", "__size", "__slots", "__words", "__k"))
    took = durable(starts.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size), F.col("start").alias(k), F.col("taken").alias(n), F.col("slots").alias(slots)))
    alike = sized.where("size > 0").groupBy(*same).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size))
    sizes = docs.withColumn(counted, n_words("text"))
    keys = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(counted) == F.col(size))
    alike = durable(alike)
    if alike.isEmpty():
        got = sizes.join(took.drop(k), keys)
    else:
        twin = _and(took[c].eqNullSafe(alike[c]) for c in (id_, source, size))
        many = took.join(alike, twin, "left_semi").withColumn(k, F.row_number().over(W.partitionBy(id_, source, size).orderBy(k)))
        turn = free("__turn", docs)
        numbered = sizes.join(alike, keys, "left_semi").withColumn(turn, F.row_number().over(W.partitionBy("doc_id", "source", counted).orderBy(F.xxhash64("text"))))
        got = sizes.join(took.join(alike, twin, "left_anti").drop(k), keys).unionByName(numbered.join(many, keys & (F.col(turn) == F.col(k))).drop(turn, k))
    passes, rest = F.floor(F.col(n) / F.col(size)).cast("int"), (F.col(n) % F.col(size)).cast("int")
    parts = F.concat(F.array_repeat(F.lit(0), passes), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    placed = F.transform(parts, lambda p, i: F.struct(p.alias("part"), F.coalesce(F.get(F.col(slots), i), F.element_at(F.col(slots), -1)).alias("slot")))
    got = got.withColumn(cut, F.explode(placed))
    part = F.col(cut)["part"]
    text = F.when(part > 0, F.array_join(F.slice(words("text"), F.lit(1), part), " ")).otherwise(F.col("text"))
    columns = {c: F.col(c) for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(part > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    by = free("__slot", docs)
    out = got.select(*[x.alias(c) for c, x in columns.items()], F.col(cut)["slot"].alias(by))
    out = out.repartitionByRange(by, "doc_id").sortWithinPartitions(by, "doc_id")
    return out.withColumnRenamed(by, slot) if slot else out.drop(by)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk
  FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM named),
levels AS (
  SELECT *, 2 * source_size * CAST(1.0 AS DOUBLE) / weight AS level FROM weighed),
shares AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY level, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(weight) OVER (ORDER BY level, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS each
  FROM levels),
level AS (SELECT each FROM shares WHERE each * weight <= 2 * source_size ORDER BY level, rk LIMIT 1),
aims AS (
  SELECT s.source, s.source_size, least(CAST(2 * s.source_size AS DOUBLE), level.each * s.weight) AS target FROM shares s, level),
placed AS (
  SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM sized),
takes AS (
  SELECT p.doc_id, p.source, p.size, a.source_size, a.target, p.start,
         CASE WHEN a.source_size > 0 THEN CAST(floor(a.target) AS BIGINT) // a.source_size ELSE 0 END AS passes,
         CASE WHEN a.source_size > 0 THEN CAST(floor(a.target) AS BIGINT) % a.source_size ELSE 0 END AS over
  FROM placed p JOIN aims a ON p.source IS NOT DISTINCT FROM a.source),
needs AS (
  SELECT source, any_value(source_size) AS source_size, any_value(passes) AS passes, any_value(over) AS over,
         (any_value(source_size) + 1023) // 1024 AS blocks, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
  FROM takes GROUP BY source),
dealt AS (
  SELECT *, passes * blocks + (over + 1023) // 1024 AS slots,
         coalesce(sum(passes * blocks + (over + 1023) // 1024) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM needs),
bits AS (SELECT greatest(2, CASE WHEN sum(slots) > 1 THEN length(bin(CAST(sum(slots) - 1 AS BIGINT))) ELSE 0 END) AS m, CAST(coalesce(sum(slots), 0) AS BIGINT) AS n FROM dealt),
cells AS (SELECT unnest(range(n)) AS cell, m FROM bits),
turned AS (SELECT cell, CAST(sum(((cell >> i) & 1) << (m - 1 - i)) AS BIGINT) AS slot FROM (SELECT cell, m, unnest(range(m)) AS i FROM cells) GROUP BY cell),
ranked AS (
  SELECT d.*, t.slot, row_number() OVER (PARTITION BY d.sid ORDER BY t.slot) - 1 AS rank
  FROM turned t JOIN dealt d ON t.cell >= d.first AND t.cell < d.first + d.slots),
slotted AS (
  SELECT source, slot, rank % blocks AS block, CASE WHEN rank // blocks >= passes THEN least(1024, over - (rank % blocks) * 1024) ELSE 1024 END AS most FROM ranked),
each_block AS (SELECT *, unnest(range(start // 1024, (start + size - 1) // 1024 + 1)) AS block FROM takes WHERE size > 0),
used AS (
  SELECT e.doc_id, e.source, e.size, e.start, min(s.slot) AS first_slot, count(*) AS n_slots
  FROM each_block e JOIN slotted s ON s.source IS NOT DISTINCT FROM e.source AND s.block = e.block
  WHERE least(e.start + e.size, e.block * 1024 + s.most) > greatest(e.start, e.block * 1024) GROUP BY ALL)
SELECT t.doc_id, t.size, t.source_size, t.target, CAST(t.passes * t.size + greatest(0, least(t.size, t.over - t.start)) AS BIGINT) AS taken,
       u.first_slot, coalesce(u.n_slots, 0) AS n_slots
FROM takes t LEFT JOIN used u ON u.source IS NOT DISTINCT FROM t.source AND u.start = t.start AND u.size = t.size AND u.doc_id IS NOT DISTINCT FROM t.doc_id
"""
