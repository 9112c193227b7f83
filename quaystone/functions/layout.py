"""Geometry of table pages: clusters of positions, grids from rules, running lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions.text import line_shape


def clusters(df: DataFrame, by: list[str], position: str, tolerance: float) -> DataFrame:
    """Positions whose neighbours are at most ``tolerance`` apart, as (by, cluster_no, centre, members)."""
    w = Window.partitionBy(*by).orderBy(position)
    gap = F.col(position) - F.lag(position).over(w)
    numbered = df.withColumn("cluster_no", F.sum(F.when(gap > tolerance, 1).otherwise(0)).over(w))
    return numbered.groupBy(*by, "cluster_no").agg(F.avg(position).alias("centre"), F.count(F.lit(1)).alias("members"))


#: Fixed values, in points: the thickest and the narrowest mark that is an edge, how far positions of one edge may differ, and the
#: share of a section's pages that must agree on a column.
MAX_THICKNESS, MIN_WIDTH, TOLERANCE, QUORUM = 2.0, 40.0, 2.0, 0.5


def centres(positions: Column, tolerance: float = TOLERANCE) -> Column:
    """Means of the clusters of an array of positions; neighbours in a cluster are at most ``tolerance`` apart."""
    empty = F.array().cast("array<struct<total:double,members:int,last:double>>")

    def step(done: Column, at: Column) -> Column:
        last = F.element_at(done, -1)
        one = F.struct(at.alias("total"), F.lit(1).alias("members"), at.alias("last"))
        grown = F.struct((last["total"] + at).alias("total"), (last["members"] + 1).alias("members"), at.alias("last"))
        return F.when((F.size(done) > 0) & (at - last["last"] <= tolerance), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(one)))

    return F.transform(F.aggregate(F.array_sort(positions), empty, step), lambda c: c["total"] / c["members"])


def page_rules(shapes: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, page, x0, x1, y) of the marks thin and wide enough to be an edge; ``shapes`` has x0, x1, top and bottom as drawn."""
    edge = (F.abs(F.col("bottom") - F.col("top")) <= MAX_THICKNESS) & (F.abs(F.col("x1") - F.col("x0")) >= MIN_WIDTH)
    return shapes.where(edge).select(doc, page, F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), ((F.col("top") + F.col("bottom")) / 2).cast("double").alias("y"))


def column_edges(rules: DataFrame, pages: DataFrame, doc: str, page: str) -> DataFrame:
    """doc, ``edges``: the vertical edges on which a section's pages agree; sections with fewer than two have no row.

    A position counts on a page if marks begin or end there at two heights or more, which an underline drawn once does not. It must
    count on half of the section's pages, those without marks included (``pages`` lists them all). All marks of a page are one array.
    """
    marks = rules.groupBy(doc, page).agg(F.collect_list(F.struct("x0", "x1", "y")).alias("marks"))

    def heights(edge: Column) -> Column:
        touching = F.filter("marks", lambda m: (F.abs(m["x0"] - edge) <= TOLERANCE) | (F.abs(m["x1"] - edge) <= TOLERANCE))
        return F.size(F.array_distinct(F.transform(touching, lambda m: m["y"])))

    ends = F.flatten(F.transform("marks", lambda m: F.array(m["x0"], m["x1"])))
    voted = marks.select(doc, page, F.explode(F.array_distinct(F.transform(F.filter(centres(ends), lambda e: heights(e) >= 2), lambda e: F.round(e, 1)))).alias("edge"))
    total = pages.select(doc, page).distinct().groupBy(doc).agg(F.count(F.lit(1)).alias("total"))
    agreed = voted.groupBy(doc, "edge").agg(F.count(F.lit(1)).alias("votes")).join(total, doc).where(F.col("votes") >= F.greatest(F.lit(1), F.floor(F.col("total") * QUORUM)))
    return agreed.groupBy(doc).agg(centres(F.collect_list("edge")).alias("edges")).where(F.size("edges") >= 2)


def row_edges(rules: DataFrame, columns: DataFrame, doc: str, page: str) -> DataFrame:
    """doc, page, ``rows``: heights of the marks that reach from one column edge to the next; a page with fewer than two has no table."""
    spans = F.exists(F.sequence(F.lit(0), F.size("edges") - 2), lambda i: (F.abs(F.col("x0") - F.col("edges")[i]) <= TOLERANCE) & (F.abs(F.col("x1") - F.col("edges")[i + 1]) <= TOLERANCE))
    return rules.join(columns, doc).where(spans).groupBy(doc, page).agg(centres(F.collect_list("y")).alias("rows")).where(F.size("rows") >= 2)


def cell_of(position: Column, edges: Column) -> Column:
    """Number of the cell between sorted edges that holds the position, null outside."""
    inside = F.size(F.filter(edges, lambda e: e <= position))
    return F.when((inside > 0) & (inside < F.size(edges)), inside - 1)


def running_lines(lines: DataFrame, doc: str, page: str, text: str, share: float = 0.8) -> DataFrame:
    """doc, shape, pages: lines that repeat, but for digits and spacing, on at least ``share`` of the pages and on two or more."""
    shaped = lines.select(doc, page, line_shape(F.col(text)).alias("shape")).where(F.col("shape") != "")
    total = lines.groupBy(doc).agg(F.countDistinct(page).alias("total"))
    seen = shaped.groupBy(doc, "shape").agg(F.countDistinct(page).alias("pages"))
    return seen.join(total, doc).where(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("total") * share))).select(doc, "shape", "pages")


def lost_characters(source: DataFrame, cells: DataFrame, by: list[str], text: str) -> DataFrame:
    """by, char, lost: characters, blanks apart, that the cells hold less often than the source (negative: more often)."""

    def counted(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*by, F.explode(F.split(F.regexp_replace(F.col(text), r"\s+", ""), "")).alias("char")).where("char <> ''").groupBy(*by, "char").agg((F.count(F.lit(1)) * sign).alias("n"))

    return counted(source, 1).unionByName(counted(cells, -1)).groupBy(*by, "char").agg(F.sum("n").alias("lost")).where("lost <> 0")


def page_lines(words: DataFrame, by: list[str], x: str, top: str, text: str, tolerance: float = 3.0) -> DataFrame:
    """by, line_no, top, text: words of a page grouped to lines; a word joins the line whose first word stands at most ``tolerance`` higher.

    The anchor is the line's first word, so this is a fold over the page's words in reading order, inside one array per page.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(top).alias("t"), F.col(x).alias("x"), F.col(text).alias("w"))))
    empty = F.array().cast("array<struct<t:double,words:array<struct<x:double,w:string>>>>")

    def step(done: Column, word: Column) -> Column:
        last = F.element_at(done, -1)
        one = F.struct(word["x"].cast("double").alias("x"), word["w"].alias("w"))
        same = (F.size(done) > 0) & (word["t"] - last["t"] <= tolerance)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["t"].alias("t"), F.concat(last["words"], F.array(one)).alias("words"))))
        return F.when(same, grown).otherwise(F.concat(done, F.array(F.struct(word["t"].cast("double").alias("t"), F.array(one).alias("words")))))

    lines = words.groupBy(*by).agg(F.aggregate(ordered, empty, step).alias("lines"))
    out = lines.select(*by, F.posexplode("lines").alias("line_no", "l"))
    return out.select(*by, "line_no", F.col("l.t").alias("top"), F.array_join(F.transform(F.array_sort("l.words"), lambda w: w["w"]), " ").alias("text"))


def grid_rows(words: DataFrame, edges: DataFrame, rows: DataFrame, doc: str, page: str, x: str, y: str, text: str) -> DataFrame:
    """doc, page, row, cells: the words of each cell of a ruled table, by column and row edges; words outside the grid are left out.

    ``edges`` is (doc, edge) of the document's columns, ``rows`` (doc, page, edge) of the page's row rules.
    """
    columns = edges.groupBy(doc).agg(F.array_sort(F.collect_list("edge")).alias("xs"))
    bands = rows.groupBy(doc, page).agg(F.array_sort(F.collect_list("edge")).alias("ys"))
    placed = words.join(columns, doc).join(bands, [doc, page]).select(doc, page, cell_of(F.col(x), F.col("xs")).alias("col"), cell_of(F.col(y), F.col("ys")).alias("row"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(text).alias("w"))
    cells = placed.where(F.col("col").isNotNull() & F.col("row").isNotNull()).groupBy(doc, page, "row", "col").agg(F.array_sort(F.collect_list(F.struct("y", "x", "w"))).alias("ws"))
    joined = cells.withColumn("cell", F.array_join(F.transform("ws", lambda w: w["w"]), " "))
    return joined.groupBy(doc, page, "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("col"), F.col("cell"))))).alias("cells"))
