"""Quality rules as weak supervision.

Each rule votes for a text (1), against it (-1) or abstains (0). How far to trust
a rule is estimated from the votes alone, by expectation-maximisation over a
hidden quality: the probabilities that a rule which votes does so rightly, for good
and for bad texts each. A text's posterior probability of being good then decides,
instead of the demand that it passes every rule.

The votes of R rules make at most 3^R patterns, so that the estimate is a fold over
one small array of patterns and their counts, as a Spark expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, WORD, durable, words

SYMBOLS = "[#*$%&|<>]"
#: Rounds of expectation-maximisation, and the posterior from which a text is kept.
ROUNDS, KEEP = 60, 0.5
#: How much less likely a vote against must be for a good text than for a bad one.
CHANCE = 0.2


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


#: Columns that are added, and those made on the way: a table's own of these names give way.
ADDED = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_marks", "n_ends", "n_distinct", "votes", "p_good", "__t", "__w", "__lines", "__h", "__five", "__again", "__sorted", "__twice", "__at"}


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of the whole text, for each row of ``docs``: n_words, word_chars, n_symbols,
    n_lines (with a word), n_dup_lines, n_repeat_words, n_letters, n_upper, n_marks (! and ?), n_ends (lines with a word that end a sentence), n_distinct (words).

    A null text counts as empty. Equal 5-word windows are found by 64-bit hashes of their words;
    in a text of a million words two windows share one by chance once in 10^7.
    """
    others = [c for c in docs.columns if c.lower() not in ADDED]
    t = docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    t = t.select(*others, "__t", words("__t").alias("__w"), F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD)).alias("__lines"))
    counts = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.array_join("__w", "")),
        "n_symbols": F.length("__t") - F.length(F.regexp_replace("__t", SYMBOLS, "")),
        "n_lines": F.size("__lines"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_letters": F.length("__t") - F.length(F.regexp_replace("__t", r"\p{L}+", "")),
        "n_upper": F.length("__t") - F.length(F.regexp_replace("__t", r"\p{Lu}", "")),
        "n_marks": F.length("__t") - F.length(F.regexp_replace("__t", "[!?]", "")),
        "n_ends": F.size(F.filter("__lines", lambda x: F.rtrim(F.regexp_replace(x, SPACE, " ")).rlike("[.!?。！？…][\"')\\]]?$"))),
    }
    t = t.select(*others, *[c.cast("long").alias(k) for k, c in counts.items()], F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))
    h = F.col("__h")
    five = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, h[i + 1], h[i + 2], h[i + 3], h[i + 4]))
    t = t.withColumn("__five", five).withColumn("n_distinct", F.size(F.array_distinct("__h")).cast("long")).drop("__h")
    t = t.withColumn("__again", F.size(F.array_distinct("__five")) < F.size("__five"))
    placed = F.sort_array(F.transform(F.col("__five"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    t = t.withColumn("__sorted", F.when(F.col("__again"), placed)).drop("__five")
    s = F.col("__sorted")
    twice = F.filter(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.struct(a["h"].eqNullSafe(b["h"]).alias("same"), a["i"].alias("a"), b["i"].alias("b"))), lambda x: x["same"])
    t = t.withColumn("__twice", F.when(F.col("__again"), twice)).drop("__sorted")
    at = F.sort_array(F.array_distinct(F.concat(F.transform("__twice", lambda x: x["a"]), F.transform("__twice", lambda x: x["b"]))))
    t = t.withColumn("__at", F.when(F.col("__again"), at)).drop("__twice", "__again")
    covered = _sum(F.zip_with("__at", F.slice("__at", F.lit(2), F.size("__at")), lambda p, q: F.coalesce(F.least(F.lit(5), q - p), F.lit(5)).cast("long")))
    return t.withColumn("n_repeat_words", F.when(F.col("__at").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("__at")


@dataclass(frozen=True)
class Rule:
    """Votes against where ``bad`` holds, else for where ``good`` holds."""

    name: str
    bad: Callable[[], Column]
    good: Callable[[], Column]


def _per(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


RULES = (
    Rule("length", lambda: F.col("n_words") < 10, lambda: F.col("n_words") >= 20),
    Rule("word_length", lambda: ~_per("word_chars", "n_words").between(2.5, 14), lambda: _per("word_chars", "n_words").between(3, 11)),
    Rule("symbols_to_words", lambda: _per("n_symbols", "n_words") > 0.1, lambda: _per("n_symbols", "n_words") < 0.02),
    Rule("symbols_to_letters", lambda: _per("n_symbols", "n_letters") > 0.05, lambda: _per("n_symbols", "n_letters") < 0.01),
    Rule("letters", lambda: _per("n_letters", "word_chars") < 0.85, lambda: _per("n_letters", "word_chars") > 0.92),
    Rule("capitals", lambda: _per("n_upper", "n_letters") > 0.4, lambda: _per("n_upper", "n_letters") < 0.15),
    Rule("marks", lambda: _per("n_marks", "n_words") > 0.3, lambda: _per("n_marks", "n_words") < 0.1),
    Rule("repeated_words", lambda: _per("n_repeat_words", "n_words") > 0.2, lambda: _per("n_repeat_words", "n_words") < 0.05),
    Rule("distinct_words", lambda: _per("n_distinct", "n_words") < 0.25, lambda: _per("n_distinct", "n_words") > 0.4),
    Rule("repeated_lines", lambda: _per("n_dup_lines", "n_lines") > 0.4, lambda: _per("n_dup_lines", "n_lines") < 0.1),
    Rule("sentences", lambda: (F.col("n_lines") >= 3) & (_per("n_ends", "n_lines") < 0.2), lambda: _per("n_ends", "n_lines") > 0.5),
)


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.array(*[F.when(r.bad(), -1).when(r.good(), 1).otherwise(0) for r in rules])


def posterior(vote: Column, good: Column, right: Column) -> Column:
    """P(good) by Bayes. ``right`` says for each rule how often it is right where it votes, on good texts (g) and on bad ones (b). Abstaining tells nothing."""
    told = F.zip_with(vote, right, lambda v, p: F.when(v > 0, F.ln(p["g"] / (1 - p["b"]))).when(v < 0, F.ln((1 - p["g"]) / p["b"])).otherwise(0.0))
    odds = F.aggregate(told, F.ln(good / (1 - good)), lambda a, x: a + x)
    return 1 / (1 + F.exp(-odds))


def estimate(seen: DataFrame, n_rules: int, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """The share of good texts and the rules' accuracies (g, b), from rows (votes, n) that say how often each pattern of votes occurs.

    The first guess is that most texts are good, that rules seldom accuse a good one and find some of
    the bad ones. What a rule finds another often doesn't look for, so votes alone can't tell a rule that finds
    its own kind of bad text from one that errs. Hence the one assumption: a vote against is at least ``1 / CHANCE`` times as likely
    for a bad text as for a good one. Where the likeliest accuracies break it, the likeliest ones that don't are taken.
    """
    def between(x: Column) -> Column:
        return F.least(F.lit(0.999), F.greatest(F.lit(0.001), x))

    zero = F.array(*[F.struct(*[F.lit(0.0).alias(k) for k in ("g_hit", "g_all", "b_hit", "b_all")]) for _ in range(n_rules)])

    def accuracy(s: Column) -> Column:
        g, b = between((s["g_hit"] + 0.98) / (s["g_all"] + 1)), between((s["b_hit"] + 0.4) / (s["b_all"] + 1))
        bound = between((s["g_all"] - s["g_hit"] + s["b_hit"] + 0.4) / (CHANCE * s["g_all"] + s["b_all"] + 1))
        fair = 1 - g <= CHANCE * b
        return F.struct(F.when(fair, g).otherwise(1 - CHANCE * bound).alias("g"), F.when(fair, b).otherwise(bound).alias("b"))

    def once(state: Column, _: Column) -> Column:
        weighed = F.transform("seen", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * posterior(x["votes"], state["good"], state["right"])).alias("q")))

        def gather(s: Column, x: Column) -> Column:
            def add(a: Column, v: Column) -> Column:
                bad = x["n"] - x["q"]
                return F.struct(
                    (a["g_hit"] + F.when(v > 0, x["q"]).otherwise(0.0)).alias("g_hit"),
                    (a["g_all"] + F.when(v != 0, x["q"]).otherwise(0.0)).alias("g_all"),
                    (a["b_hit"] + F.when(v < 0, bad).otherwise(0.0)).alias("b_hit"),
                    (a["b_all"] + F.when(v != 0, bad).otherwise(0.0)).alias("b_all"),
                )

            return F.struct((s["n"] + x["n"]).alias("n"), (s["q"] + x["q"]).alias("q"), F.zip_with(s["by_rule"], x["votes"], add).alias("by_rule"))

        start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("q"), zero.alias("by_rule"))
        return F.aggregate(weighed, start, gather, lambda s: F.struct(between((s["q"] + 0.8) / (s["n"] + 1)).alias("good"), F.transform(s["by_rule"], accuracy).alias("right")))

    first = F.struct(F.lit(0.8).alias("good"), F.array(*[F.struct(F.lit(0.98).alias("g"), F.lit(0.4).alias("b")) for _ in range(n_rules)]).alias("right"))
    counted = seen.agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("seen"))
    got = counted.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, once).alias("model")).first()["model"]
    return got["good"], [(r["g"], r["b"]) for r in got["right"]]


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds the features, ``votes`` and ``p_good`` to all columns of ``docs`` but the text.

    Columns of the names that are added are replaced; a null id is a row like any other, and rows that come again are judged again.
    Features are computed once and kept in the shared checkpoint folder. An empty table has no votes and gives no rows.
    """
    told = durable(features(docs, text).drop(text).withColumn("votes", votes(rules)))
    good, right = estimate(told.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), len(rules))
    accuracies = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(b).alias("b")) for g, b in right])
    return told.withColumn("p_good", posterior(F.col("votes"), F.lit(good), accuracies))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    got = judge(docs.select("doc_id", "text")).withColumn("base_failed", failed)
    kept = ~failed & (F.col("p_good") >= KEEP)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "p_good")
