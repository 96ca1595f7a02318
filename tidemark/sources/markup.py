"""Tables of web pages: rows and cells as nested arrays, spans filled in, columns by the name over them.

Only expressions over one page. Tables within tables aren't told apart from the outer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE = r"(?is)<table\b[^>]*>(.*?)(?:</table\s*>|\z)"
ROW = r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr\b|</t(?:head|body|foot)\b|\z)"
CELL = r"(?is)(<t[hd]\b[^>]*>.*?)(?=<t[hd]\b|</t[hdr]\b|\z)"
#: The entities that texts are written with.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _let(value: Column, of) -> Column:
    """``of`` a value that is worked out once, however often ``of`` names it."""
    return F.transform(F.array(value), of)[0]


def _plain(cell: Column) -> Column:
    def written_out(text: Column) -> Column:
        plain = text
        for entity, sign in ENTITIES:
            plain = F.replace(plain, F.lit(entity), F.lit(sign))
        return F.when(F.contains(text, F.lit("&")), plain).otherwise(text)

    text = _let(F.regexp_replace(cell, r"(?is)<!--.*?-->|<[^<>]*>", ""), written_out)
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def _span(cell: Column, name: str) -> Column:
    """A cell's span; 1 where it has none, and a thousand at most, as browsers have it."""
    said = F.regexp_extract(cell, rf"(?is)^<t[hd]\b[^>]*\b{name}\s*=\s*[\"']?\s*(\d{{1,9}})", 1)
    return F.greatest(F.lit(1), F.least(F.lit(1000), F.coalesce(said.try_cast("int"), F.lit(1))))


def _cells(row: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(row, F.lit(CELL), F.lit(1)),
        lambda c: F.struct(_plain(c).alias("text"), F.lower(F.substring(c, 1, 3)).eqNullSafe("<th").alias("header"), _span(c, "colspan").alias("wide"), _span(c, "rowspan").alias("high")),
    )


def _placed(rows: Column) -> Column:
    """Rows of cells with their columns: each cell in the first ones that no cell of an earlier row reaches down to."""
    kind = "array<struct<col:int,text:string,header:boolean,until:int>>"

    def cell_in(r: Column, taken: Column):
        def add(state: Column, c: Column) -> Column:
            free = F.array_min(F.array_except(F.sequence(state["at"], state["at"] + F.size(taken)), taken))

            def put(at: Column) -> Column:
                new = F.transform(F.sequence(at, at + c["wide"] - 1), lambda k: F.struct(k.alias("col"), c["text"].alias("text"), c["header"].alias("header"), (r + c["high"]).alias("until")))
                return F.struct((at + c["wide"]).alias("at"), F.concat(state["cells"], new).alias("cells"))

            return _let(free, put)

        return add

    def row(state: Column, cells: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("cells"))
        r = state["r"]  # those busy reach down to it
        here = _let(F.transform(state["busy"], lambda b: b["col"]), lambda taken: F.aggregate(cells, start, cell_in(r, taken), lambda s: s["cells"]))
        whole = F.array_sort(F.concat(here, state["busy"]))
        return _let(whole, lambda x: F.struct((r + 1).alias("r"), F.filter(x, lambda b: b["until"] > r + 1).cast(kind).alias("busy"), F.concat(state["rows"], F.array(x)).alias("rows")))

    zero = F.struct(F.lit(0).alias("r"), F.array().cast(kind).alias("busy"), F.array().cast(f"array<{kind}>").alias("rows"))
    return F.aggregate(rows, zero, row, lambda s: s["rows"])


def _plainly(rows: Column) -> Column:
    """As ``_placed`` where no cell is higher or wider than one."""
    return F.transform(rows, lambda cells: F.transform(cells, lambda c, k: F.struct(k.alias("col"), c["text"].alias("text"), c["header"].alias("header"), F.lit(0).alias("until"))))


def tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, n (table of the page), row, col, text, header: every cell of every table, a cell with spans once for each place that it covers.

    Pages without a table, empty tables and null html have no rows. Texts are without marks and comments, white space is single.
    Arrays are opened as outer ones: for others Spark asks their size first, and so works out all that is in them twice.
    """
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "(?s)<!--.*?-->", ""), F.lit(TABLE), F.lit(1))
    each = pages.select(key, F.posexplode_outer(found).alias("n", "body")).where("body is not null")
    cut = each.select(key, "n", F.transform(F.regexp_extract_all("body", F.lit(ROW), F.lit(1)), _cells).alias("rows"))
    spanned = F.exists("rows", lambda r: F.exists(r, lambda c: (c["wide"] > 1) | (c["high"] > 1)))
    whole = cut.select(key, "n", F.when(spanned, _placed(F.col("rows"))).otherwise(_plainly(F.col("rows"))).alias("rows"))
    lines = whole.select(key, "n", F.posexplode_outer("rows").alias("row", "cells"))
    return lines.select(key, F.col("n").cast("long"), F.col("row").cast("long"), F.explode_outer("cells").alias("c")).where("c is not null").select(key, "n", "row", F.col("c.col").cast("long").alias("col"), "c.text", "c.header")


def column(cells: DataFrame, name: str, key: str = "page_id") -> DataFrame:
    """key, n, row, value: the cells under the header ``name`` in the first table of a page that has one, dots as hyphens. The header stands in the table's first row;
    of several alike the first counts."""
    heads = cells.where((F.col("row") == 0) & (F.col("text") == name)).groupBy(key).agg(F.min(F.struct("n", "col")).alias("at")).select(F.col(key).alias("__key"), F.col("at.n").alias("__n"), F.col("at.col").alias("__col"))
    under = cells.join(heads, (F.col(key) == F.col("__key")) & (F.col("n") == F.col("__n")) & (F.col("col") == F.col("__col")))
    return under.where("row > 0").select(key, "n", "row", F.translate("text", ".", "-").alias("value"))
