"""Tables on a page: regions, columns and rows of tables without lines, and tables drawn as text."""

from __future__ import annotations

from itertools import accumulate, pairwise
from textwrap import wrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Units of a region's side; the page's upper and lower share outside a borderless table; room above a heading; signs that don't count at a word's ends.
UNITS, TOP, BOTTOM, ROOM, SIGNS = 1000, 0.12, 0.895, 5.0, ".,:;"
# Least and most width of a drawn column; lines that a borderless table has at least, gap between its headings, least and relative tolerance of a line.
NARROW, WIDE, LEAST_LINES, HEADING_GAP, LEAST_TOLERANCE, TOLERANCE = 3, 24, 3, 25.0, 3.0, 0.6


def region_boxes(regions: DataFrame) -> DataFrame:
    """Regions (left, top, right, bottom in thousandths of page_width and page_height) with x0, y0, x1, y1 in points."""
    side = lambda size, part: F.col(size) * F.col(part) / UNITS
    return regions.withColumns({"x0": side("page_width", "left"), "y0": side("page_height", "top"), "x1": side("page_width", "right"), "y1": side("page_height", "bottom")})


def refined_boxes(regions: DataFrame, words: DataFrame) -> DataFrame:
    """region_id, x0, y0, x1, y1 of borderless tables' boxes (document_id, region_id, page, page_height, is_first, headings, x0 to y1) without the page's margins and, on a table's first page, from the word (document_id, page, x0, top, text) on that its first heading begins with, if it is there."""
    bare = lambda c: F.btrim(F.lower(c), F.lit(SIGNS))
    first = F.try_element_at(F.filter("headings", lambda h: F.trim(h) != ""), F.lit(1))
    r = regions.withColumns({"y0": F.greatest("y0", F.col("page_height") * TOP), "y1": F.least("y1", F.col("page_height") * BOTTOM), "token": F.when(F.col("is_first"), bare(F.split(F.trim(first), r"\s+")[0]))})
    w = words.select("document_id", "page", F.col("x0").alias("_x"), F.col("top").alias("_top"), bare(F.col("text")).alias("token"))
    hits = r.join(w, ["document_id", "page", "token"]).filter("_x BETWEEN x0 AND x1 AND _top BETWEEN y0 AND y1").groupBy("region_id").agg(F.min("_top").alias("_top"))
    return r.join(hits, "region_id", "left").select("region_id", "x0", F.greatest("y0", F.col("_top") - ROOM).alias("y0"), "x1", "y1")


def _grid(words: list[tuple[float, float, float, float]]) -> tuple[list[float], list[float]] | None:
    """Edges of columns and rows of words (top, x0, x1, bottom): headings of the first line lie apart, and the widest gap between two of them that cuts no word is their border."""
    lines: list[list[tuple]] = []
    for w in sorted(words):
        if lines and abs(w[0] - lines[-1][0][0]) <= max(LEAST_TOLERANCE, (w[3] - w[0]) * TOLERANCE):
            lines[-1].append(w)
        else:
            lines.append([w])
    if len(lines) < LEAST_LINES:
        return None
    headings: list[list[float]] = []
    for _, x0, x1, _ in sorted(lines[0], key=lambda w: w[1]):
        if headings and x0 - headings[-1][1] < HEADING_GAP:
            headings[-1][1] = x1
        else:
            headings.append([x0, x1])
    if len(headings) < 2:
        return None
    columns = [min(w[1] for w in words)]
    for a, b in pairwise(sum(h) / 2 for h in headings):
        best, since = (0, 0.0), None
        for x in range(int(a) + 1, int(b) + 1):
            if x < int(b) and not any(w[1] < x < w[2] for w in words):
                since = x if since is None else since
            elif since is not None:
                best, since = max(best, (x - since, (since + x - 1) / 2), key=lambda g: g[0]), None
        if not best[0]:
            return None
        columns.append(best[1])
    edges = [(max(w[3] for w in a) + min(w[0] for w in b)) / 2 for a, b in pairwise(lines)]
    return [*columns, max(w[2] for w in words)], [min(w[0] for w in lines[0]), *edges, max(w[3] for w in lines[-1])]


def borderless(words: DataFrame) -> DataFrame:
    """region_id, columns, rows (edges in points) of the regions whose words (region_id, top, x0, x1, bottom) form a table of three lines and two headings at least. A region is one group: a page's words at most."""

    def run(frame):
        import pandas as pd

        found = _grid(list(frame[["top", "x0", "x1", "bottom"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(frame["region_id"].iloc[0], *found)] if found else [], columns=["region_id", "columns", "rows"])

    kinds = [F.col(c).cast("double").alias(c) for c in ("top", "x0", "x1", "bottom")]
    return words.select(F.col("region_id").cast("string").alias("region_id"), *kinds).groupBy("region_id").applyInPandas(run, "region_id string, columns array<double>, rows array<double>")


def _drawn(cells: list[tuple[int, int, int, int, str]], columns: int) -> str:
    widths = [NARROW] * columns
    for _, _, c0, c1, value in cells:
        if c0 == c1:
            widths[c0 - 1] = max(widths[c0 - 1], min(len(value), WIDE))
    edge = list(accumulate((w + 3 for w in widths), initial=0))
    rule = "+" + "".join("-" * (w + 2) + "+" for w in widths)
    out, last = [rule], max(c[1] for c in cells)
    for r in range(1, last + 1):
        inside = sorted((c for c in cells if c[0] <= r <= c[1]), key=lambda c: c[2])
        rooms = [edge[c[3]] - edge[c[2] - 1] - 3 for c in inside]
        texts = [wrap(c[4], room) if c[0] == r and c[4] else [] for c, room in zip(inside, rooms, strict=True)]
        for i in range(max([1, *map(len, texts)])):
            out.append("|" + "".join(f" {(t[i] if i < len(t) else '').ljust(room)} |" for t, room in zip(texts, rooms, strict=True)))
        line = list(rule)
        for r0, r1, c0, c1, _ in cells if r < last else []:
            if r0 <= r < r1:
                line[edge[c0 - 1] + 1 : edge[c1]] = " " * (edge[c1] - edge[c0 - 1] - 1)
        out.append("".join(line))
    return "\n".join(out)


def drawn(cells: DataFrame) -> DataFrame:
    """table_id, text: cells (table_id, row_start, row_end, column_start, column_end, value) drawn with borders, merged ones as one box, long values wrapped. A table is one group."""

    def run(frame):
        import pandas as pd

        rows = [(int(a), int(b), int(c), int(d), v or "") for a, b, c, d, v in frame[["row_start", "row_end", "column_start", "column_end", "value"]].itertuples(index=False, name=None)]
        return pd.DataFrame([(frame["table_id"].iloc[0], _drawn(rows, max(r[3] for r in rows)))], columns=["table_id", "text"])

    return cells.withColumn("table_id", F.col("table_id").cast("string")).groupBy("table_id").applyInPandas(run, "table_id string, text string")
