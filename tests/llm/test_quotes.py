import duckdb
import pytest

from tests.llm.conftest import ODD
from tidemark.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"
MAIL = [
    (1, 0, "a", "The first point stands.\nAnd it wraps\nover lines.\n\nA second thing."),
    (1, 1, "b", "On Monday a wrote:\n> The first point stands. And it\n> wraps over lines.\n\nI agree.\n"),
    (1, 2, "c", ">> A second thing.\n> I agree.\nSo do I."),
    (1, 3, "d", "> > and it wraps\nA line of a paragraph."),
    (1, 4, "e", "> nobody said this\nUnlinked."),
    (1, 5, "f", "> A line of a paragraph.\n> So do I.\n\nOn we go:\nnot an attribution"),
    (2, 0, "a", "thanks"),
    (2, 1, "b", "thanks"),
    (2, 2, "c", "> thanks\nthanks"),
    (2, 3, "d", "> thanks\r\n> thanks\r\n"),
    (2, 3, "d2", "more of the same turn"),
    (3, 1, "later", "> only said later"),
    (3, 2, "x", "only said later"),
    (None, 0, "n", "> thanks"),
    (2, None, "n", "> thanks\nno turn"),
    (4, 0, "a", "quote me \x02 with a mark"),
    (4, 1, "b", " >\tquote me with a mark\nyes"),
]


@pytest.fixture
def rows(spark):
    def run(messages):
        df = spark.createDataFrame(messages, SCHEMA)
        got = quotes.query(spark, df)
        db = duckdb.connect()
        db.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
        want = db.execute(quotes.SQL).fetchall()
        names = [d[0] for d in db.description]
        assert got.columns == names
        key = lambda r: tuple((x is not None, x) for x in r)
        return sorted((tuple(r) for r in got.collect()), key=key), sorted(want, key=key)

    return run


def test_links_nested_quotes(rows):
    got, want = rows(MAIL)
    assert got == want
    at = {r[:2]: r for r in got if r[2] != "d2"}
    assert at[1, 1][3:] == ("I agree.", 1, 1, 0, 0, 1, 1)
    assert at[1, 2][3:] == ("So do I.", 2, 2, 1, 0, 2, 2)
    assert at[1, 3][6] == 0 and at[1, 4][6] is None
    assert at[1, 5][6:] == (3, 0, 2, 4)
    assert at[1, 5][3] == "On we go:\nnot an attribution"
    assert at[2, 2][6] == 0 and at[2, 3][6] == 0
    assert at[3, 1][6] is None
    assert at[4, 1][6] == 0


def test_odd_texts(rows):
    messages = [(7, i, "r", t) for i, t in enumerate(ODD)] + [(8, i, "r", "> " + (t or "")) for i, t in enumerate(ODD)] + [(8, 99, "r", ">" * 3000), (8, 99, "r", "a\n" * 3000)]
    messages = [m for m in messages if "\x00" not in (m[3] or "")]
    got, want = rows(messages)
    assert got == want


def test_long_chain(rows):
    messages = [(1, i, "r", f"> words of {i - 1}\nwords of {i}") for i in range(40)]
    got, want = rows(messages)
    assert got == want
    assert [r[-1] for r in got] == [r[-2] for r in got] == list(range(40)) and {r[-3] for r in got} == {0}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", thread string, conversation long")
    assert quotes.link(df).count() == 0
    df = spark.createDataFrame([(1, 0, "a", "x", "old", 5), (1, 1, "a", "> x", "old", 5)], SCHEMA + ", thread string, conversation long")
    got = {r.turn: r for r in quotes.link(df).collect()}
    assert got[1].thread == 0 and got[1].conversation == 5


ENDS = ["  lead\r> b  ", " x\u2028> y ", "\u2028first", "> \u2028first", ">\u2028first", "a\x85> b", "On x wrote:\u2028\n> a", "On x wrote:\r\n> lead", "> x\u2029> y\nown", "\u2029"]


def test_only_line_feeds_end_lines(rows):
    got, want = rows([(1, i, "r", t) for i, t in enumerate(ENDS)] + [(2, i, "r", t) for i, t in enumerate(["\u2028lead", "> \u2028lead\nmine", "plain\r> x"])])
    assert got == want
    assert {r[:2]: r for r in got}[2, 1][5:7] == (1, 0)


def test_thousands_of_random_threads(rows):
    import random

    rng, messages = random.Random(3), []
    for c in range(250):
        lines: list[list[str]] = []
        for t in range(rng.randrange(1, 16)):
            own = [f"Line {rng.randrange(40)} of {c} " + rng.choice(["stays", "goes  on", "ENDS here"]) for _ in range(rng.randrange(1, 4))]
            quoted = []
            for _ in range(rng.randrange(3) if t else 0):
                back = rng.choice(lines)
                quoted += [rng.choice(["> ", ">> ", "> > ", " >"]) + x for x in rng.sample(back, rng.randrange(1, len(back) + 1))] + rng.choice([[], [""], ["reply " + str(rng.randrange(30))]])
            lines.append(own)
            messages.append((c, t * rng.choice([1, 1, 3000]), "r", "\n".join(rng.choice([[], ["On day x wrote:"]]) + quoted + own)))
    got, want = rows(messages)
    assert got == want
    assert sum(r[6] is not None for r in got) > 800 and max(r[8] for r in got) > 4 and max(r[9] for r in got) > 6


def test_a_walk_goes_from_each_message_to_its_replies(rows):
    texts = {0: "root", 1: "> root\na", 2: "> root\nb", 3: "> a\nc", 4: "> a\nd", 5: "> c\ne", 6: "> b\nf", 7: "alone"}
    got, want = rows([(1, t, "r", x) for t, x in texts.items()])
    assert got == want
    order = [r[1] for r in sorted(got, key=lambda r: (r[7], r[9]))]
    assert order == [0, 1, 3, 5, 4, 2, 6, 7]


def test_helper_names_clash(spark):
    names = ["__c", "__t", "__hot0", "__hot1", "__n", "__up", "chunk", "parent_"]
    df = spark.createDataFrame([(1, 0, "a", "x", *names), (1, 1, "a", "> x", *names)], SCHEMA + "".join(f", {n} string" for n in names))
    got = {r.turn: r for r in quotes.link(df).collect()}
    assert got[1].parent == 0 and all(got[t][n] == n for t in (0, 1) for n in names)


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_a_passage_and_a_message_that_all_quote(rows, monkeypatch, hot):
    from tidemark.llm import common

    monkeypatch.setattr(common, "HOT", hot)
    messages = [(1, 0, "a", "the notice that all quote\n\na second one")] + [(1, t, "r", f"> the notice that all quote\nanswer {t}") for t in range(1, 60)]
    messages += [(1, t, "r", f"> answer {t - 60}\nand {t}") for t in range(61, 100)] + [(1, t, "r", "> answer 7\nso it is") for t in range(100, 130)]
    messages += [(None, t, "n", "> the notice that all quote") for t in range(40)] + [(2, None, "n", "> x")] * 20 + [(3, 1, "r", "many rows of one message")] * 30
    got, want = rows(messages)
    assert got == want
    assert sum(r[6] == 0 for r in got) == 59 and sum(r[6] == 7 for r in got) == 31
