"""The price cache reads gaps alone and never mistakes a field; tables of web pages with spans."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalogue
from tidemark.sources import cache, markup


@pytest.fixture(scope="module")
def bars(spark):
    day = F.expr("date_add(date'2000-01-01', cast(id as int))").alias("date")
    x = spark.range(60).select("id", day).crossJoin(spark.createDataFrame([("a",), ("b",)], "ticker string"))
    return x.select("ticker", "date", F.col("id").cast("double").alias("close"), (1000 + F.col("id")).cast("double").alias("volume")).where("not (ticker = 'b' and id between 10 and 12)").cache()


def asked(spark, field, start, end, *tickers):
    return cache.requests(spark, spark.createDataFrame([(t,) for t in tickers], "ticker string"), field, start, end)


def told(gaps):
    return sorted((r.ticker, r.field, str(r.start)[5:], str(r.end)[5:]) for r in gaps.collect())


def test_only_gaps_are_read_and_fields_stay_apart(spark, bars, tmp_path):
    root, seen = str(tmp_path), []
    source = cache.from_bars(bars)
    read = lambda gaps: seen.append(told(gaps)) or source(gaps)
    load = lambda *request: cache.load(spark, root, asked(spark, *request), read)
    first, gaps = load("close", "2000-01-05", "2000-01-20", "a", "b")
    assert told(gaps) == [("a", "close", "01-05", "01-20"), ("b", "close", "01-05", "01-20")] and first.count() == 16 + 13
    volume, gaps = load("volume", "2000-01-05", "2000-01-20", "a")
    assert told(gaps) == [("a", "volume", "01-05", "01-20")] and volume.agg(F.min("value")).first()[0] == 1004
    same, gaps = load("close", "2000-01-06", "2000-01-12", "b")  # days without a price are not asked for again
    assert gaps.count() == 0 and len(seen) == 2 and same.count() == 5 and same.agg(F.max("value")).first()[0] == 9
    wide, gaps = load("close", "2000-01-01", "2000-01-25", "a", "c")
    assert told(gaps) == [("a", "close", "01-01", "01-04"), ("a", "close", "01-21", "01-25"), ("c", "close", "01-01", "01-25")]
    assert sorted(r.value for r in wide.collect()) == [float(k) for k in range(25)]
    nothing, gaps = load("close", "2000-01-09", "2000-01-01", "a")
    assert nothing.count() == gaps.count() == 0


def test_a_load_that_fails_leaves_nothing(spark, bars, tmp_path):
    def broken(gaps):
        raise OSError("the source is down")

    with pytest.raises(OSError):
        cache.load(spark, str(tmp_path), asked(spark, "close", "2000-01-01", "2000-01-09", "a"), broken)
    cache.from_bars(bars)(asked(spark, "close", "2000-01-01", "2000-01-09", "a")).write.parquet(f"{tmp_path}/data/lost")  # written, not committed
    rows, gaps = cache.load(spark, str(tmp_path), asked(spark, "close", "2000-01-01", "2000-01-03", "a"), cache.from_bars(bars))
    assert told(gaps) == [("a", "close", "01-01", "01-03")] and rows.count() == 3
    # two loads at once may hold the same days
    missing = cache.catalogue(spark, str(tmp_path)).withColumn("part", F.lit("twin"))
    cache.from_bars(bars)(missing).write.parquet(f"{tmp_path}/data/twin")
    missing.write.parquet(f"{tmp_path}/catalogue/twin")
    assert cache.load(spark, str(tmp_path), asked(spark, "close", "2000-01-01", "2000-01-03", "a"), broken)[0].count() == 3


def test_gaps_as_sets_of_days(spark):
    import datetime
    import random

    rng, start = random.Random(6), datetime.date(2000, 1, 1)
    at = lambda k: start + datetime.timedelta(k)
    spans = lambda n: [(rng.choice("ab"), "f", a := rng.randrange(60), a + rng.randrange(9)) for _ in range(n)]
    for n, m in ((1, 0), (3, 10), (6, 25), (0, 5)):
        want, held = spans(n), spans(m)
        frame = lambda x: spark.createDataFrame([(t, f, at(a), at(b)) for t, f, a, b in x], "ticker string, field string, start date, end date")
        days = lambda x: {(t, k) for t, _, a, b in x for k in range(a, b + 1)}
        got = [(r.ticker, r.field, (r.start - start).days, (r.end - start).days) for r in cache.gaps(frame(want), frame(held).withColumn("part", F.lit("p"))).collect()]
        assert days(got) == days(want) - days(held) and len(days(got)) == sum(b - a + 1 for _, _, a, b in got)


PAGE = """<html><TABLE><tr><td>no</td></tr></TABLE><!-- <table><tr><th>Symbol</th></tr><tr><td>hidden</td></tr></table> -->
<table class="x"><thead><tr><th colspan=2>Name</th><th>Symbol</th></tr></thead><tbody>
<tr><td rowspan="3">one</td><td>p</td><td><a href="/x">BRK.B</a> &amp; co</td></tr>
<tr><td colspan='2'> two
 words </td></tr><tr><td>q<td>BF.B
<tr><td>r</td></tr></tbody></table></html>"""


def test_spans_headers_and_unclosed_cells(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<table>"), (5, "<table></table><p>x"), (None, "<table><tr><th>Symbol<th>Symbol<tr><td>a<td>b</table>")], "page_id long, html string")
    cells = markup.tables(pages).cache()
    got = {(r.n, r.row, r.col): r.text for r in cells.where("page_id = 1").collect()}
    assert got == {
        (0, 0, 0): "no", (1, 0, 0): "Name", (1, 0, 1): "Name", (1, 0, 2): "Symbol",
        (1, 1, 0): "one", (1, 1, 1): "p", (1, 1, 2): "BRK.B & co", (1, 2, 0): "one", (1, 2, 1): "two words", (1, 2, 2): "two words",
        (1, 3, 0): "one", (1, 3, 1): "q", (1, 3, 2): "BF.B", (1, 4, 0): "r",
    }
    assert {r.page_id for r in cells.collect()} == {1, None} and {r.text for r in cells.where("header").collect()} == {"Name", "Symbol"}
    assert sorted((r.row, r.value) for r in markup.column(cells.where("page_id = 1"), "Symbol").collect()) == [(1, "BRK-B & co"), (2, "two words"), (3, "BF-B")]
    assert markup.column(cells, "Other").count() == 0


def test_a_page_is_read_once(spark, sf):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    plan = markup.tables(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?is)<table") == plan.count("(?is)<tr") == 1  # no filter reads it before
    plan = catalogue.QUERIES["html_table_column"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 4 and "regexp_extract_all" not in plan  # the cells are kept


def test_cells_stand_beside_those_that_reach_down(spark):
    import random

    rng = random.Random(3)
    grids = [[[(rng.randrange(1, 4), rng.randrange(1, 5)) for _ in range(rng.randrange(4))] for _ in range(rng.randrange(2, 9))] for _ in range(60)]
    cell = lambda wide, high, name: f"<td colspan={wide} rowspan={high}>{name}</td>"
    html = lambda rows: "<table>" + "".join("<tr>" + "".join(cell(*c, f"{r}:{k}") for k, c in enumerate(cells)) + "</tr>" for r, cells in enumerate(rows)) + "</table>"
    want = []
    for page, rows in enumerate(grids):
        busy = {}  # column: the texts there, with the row that each reaches to
        for r, cells in enumerate(rows):
            down, at = {c: [x for x in xs if x[1] > r] for c, xs in busy.items()}, 0
            busy = {c: list(xs) for c, xs in down.items()}
            for k, (wide, high) in enumerate(cells):
                while down.get(at):
                    at += 1
                for c in range(at, at + wide):
                    busy.setdefault(c, []).append((f"{r}:{k}", r + high))
                at += wide
            want += [(page, r, c, text) for c, xs in busy.items() for text, _ in xs]
    got = markup.tables(spark.createDataFrame([(k, html(rows)) for k, rows in enumerate(grids)], "page_id long, html string"))
    assert sorted((x.page_id, x.row, x.col, x.text) for x in got.collect()) == sorted(want)


def test_a_long_table(spark):
    rows = "".join(f"<tr><td>{k}</td><td>v{k}</td></tr>" for k in range(20_000))
    pages = spark.createDataFrame([(1, f"<table><tr><th>A</th><th>B</th></tr>{rows}</table>" + "<table " * 2000)], "page_id long, html string")
    assert markup.column(markup.tables(pages), "B").agg(F.count("*"), F.max("row")).first()[:] == (20_000, 20_000)
