"""Words of pages: visible characters, the gutter between columns, rows, boxes, blocks of wrapped lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let


def visible_chars(chars: Column | str, smallest: float = 4.0, white: float = 0.95) -> Column:
    """Of array<struct<c, size, color: array<double>>> those large enough and not white: gray or RGB all near one, CMYK all near zero."""

    def shown(x):
        n = F.size(x["color"])
        light = F.when(n == 4, F.forall(x["color"], lambda v: v <= 1 - white)).when(n > 0, F.forall(x["color"], lambda v: v >= white)).otherwise(False)
        return (F.coalesce(x["size"], F.lit(smallest)) >= smallest) & ~F.coalesce(light, F.lit(False))

    return F.filter(chars, shown)


# Fixed values of the search for a gutter: step and padding in points, the part of the page, and shares of its words.
GUTTER = {"step": 2, "pad": 4.0, "from": 0.15, "to": 0.85, "least_words": 20, "side": 0.15, "crossing": 0.01}
PAGE = ["doc_id", "page"]


def crossings(words: DataFrame) -> DataFrame:
    """(doc_id, page, n, x, cross, left): for every place x of the middle of a page the words that cross it, padded, and those that end before it.

    words: doc_id, page, width (of the page), x0, x1. Running counts over places: a word meets its first and last place only.
    """
    g = GUTTER
    pages = words.groupBy(*PAGE).agg(F.max("width").alias("width"), F.count("*").alias("n")).where(F.col("n") >= g["least_words"])
    pages = pages.withColumns({"first": F.floor(F.col("width") * g["from"]).cast("int"), "stop": F.floor(F.col("width") * g["to"]).cast("int")})
    places = pages.where("first < stop").select(*PAGE, "n", "first", F.explode(F.sequence(F.col("first"), F.col("stop") - 1, F.lit(g["step"]))).alias("x"))
    places = places.select(*PAGE, "n", ((F.col("x") - F.col("first")) / g["step"]).cast("long").alias("i"), F.col("x").cast("double").alias("x"))
    own = words.join(pages.select(*PAGE, "first"), PAGE)
    # Number of the first place beyond an edge (open), or at it (closed).
    beyond = lambda e: F.greatest(F.floor((e - F.col("first")) / g["step"]) + 1, F.lit(0))
    at = lambda e: F.greatest(F.ceil((e - F.col("first")) / g["step"]), F.lit(0))
    moves = own.select(*PAGE, F.explode(F.array(
        F.struct(beyond(F.col("x0") - g["pad"]).alias("i"), F.lit(1).alias("cross"), F.lit(0).alias("left")),
        F.struct(at(F.col("x1") + g["pad"]).alias("i"), F.lit(-1).alias("cross"), F.lit(0).alias("left")),
        F.struct(at(F.col("x1")).alias("i"), F.lit(0).alias("cross"), F.lit(1).alias("left")),
    )).alias("m")).select(*PAGE, "m.*").groupBy(*PAGE, "i").agg(F.sum("cross").alias("cross"), F.sum("left").alias("left"))
    line = places.unionByName(moves, allowMissingColumns=True)
    run = Window.partitionBy(*PAGE).orderBy("i").rangeBetween(Window.unboundedPreceding, 0)
    line = line.withColumns({c: F.coalesce(F.sum(c).over(run), F.lit(0)) for c in ("cross", "left")})
    return line.where(F.col("x").isNotNull()).select(*PAGE, "n", "x", "cross", "left")


def gutter(words: DataFrame) -> DataFrame:
    """(doc_id, page, x): the place that fewest words cross, the leftmost of equals, if it parts the page into columns.

    Either side needs its share of the words. Right-aligned fragments are no column, and a place within a line of
    running text is no gutter. words: doc_id, page, width, top, x0, x1.
    """
    g = GUTTER
    each = crossings(words).where(F.least(F.col("left"), F.col("n") - F.col("left") - F.col("cross")) >= F.col("n") * g["side"])
    best = each.groupBy(*PAGE).agg(F.min(F.struct("cross", "x")).alias("b"), F.max("n").alias("n")).where(F.col("b.cross") <= F.col("n") * g["crossing"]).select(*PAGE, "b.x")
    own = words.join(best, PAGE)
    aligned = right_aligned(row_numbers(own.where("x0 >= x")).groupBy(*PAGE, "row").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")), *PAGE).where("aligned")
    cut = cuts_a_line(row_numbers(own)).where("cuts").select(*PAGE).distinct()
    return best.join(aligned, PAGE, "left_anti").join(cut, PAGE, "left_anti")


def row_numbers(words: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """words with the number of their row on the page: a row is what lies within the tolerance of its first word, from the top down."""
    tops = words.groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.col("top").cast("double"))).alias("tops"))  # a page's lines

    def step(acc, t):
        new = (F.size(acc) == 0) | (t - F.element_at(acc, -1)["first"] > tolerance)
        row = F.struct(t.alias("top"), F.when(new, t).otherwise(F.get(acc, F.size(acc) - 1)["first"]).alias("first"), F.when(new, F.coalesce(F.get(acc, F.size(acc) - 1)["row"], F.lit(-1)) + 1).otherwise(F.get(acc, F.size(acc) - 1)["row"]).alias("row"))
        return F.concat(acc, F.array(row))

    start = F.array().cast("array<struct<top:double,first:double,row:int>>")
    rows = tops.select(*PAGE, F.inline(F.aggregate("tops", start, step))).select(*PAGE, F.col("top").alias("_top"), "row")
    return words.withColumn("_top", F.col("top").cast("double")).join(rows, [*PAGE, "_top"]).select(*words.columns, "row")


def rows_of(words: Column | str, tolerance: float = 2.0) -> Column:
    """array of rows: words from the top down; one belongs to a row if it is within the tolerance of the row's first word. words: array<struct<top, x0, ...>>.

    The fold keeps where each row starts, and grows with a page's rows only; the words of a row are a slice.
    """

    def cut(own):
        def step(acc, w):
            near = (F.size(acc["at"]) > 0) & (F.abs(w["top"].cast("double") - acc["top"]) <= tolerance)
            new = F.struct((acc["n"] + 1).alias("n"), w["top"].cast("double").alias("top"), F.concat(acc["at"], F.array(acc["n"])).alias("at"))
            return F.when(near, F.struct((acc["n"] + 1).alias("n"), acc["top"].alias("top"), acc["at"].alias("at"))).otherwise(new)

        start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("top"), F.array().cast("array<int>").alias("at"))
        starts = F.aggregate(own, start, step, lambda a: a["at"])
        return let(starts, lambda at: F.transform(at, lambda i, k: F.slice(own, i + 1, F.coalesce(F.get(at, k + 1), F.size(own)) - i)))

    return let(F.array_sort(words), cut)


def right_aligned(rows: DataFrame, *by: str) -> DataFrame:
    """by, aligned: of three rows or more the right edges spread less than half as much as the left ones. rows: x0, x1 of each row's span."""
    return rows.groupBy(*by).agg((F.count("*") >= 3).alias("enough"), (F.stddev_pop("x1") < F.stddev_pop("x0") / 2).alias("right")).select(*by, (F.col("enough") & F.col("right")).alias("aligned"))


def cuts_a_line(words: DataFrame, x: str = "x", gap: float = 8.0) -> DataFrame:
    """(doc_id, page, row, cuts): whether a gutter at x runs through a word that has neighbours, or through a gap too small for one."""
    left = F.max(F.when(F.col("x1") <= F.col(x), F.col("x1")))
    right = F.min(F.when(F.col("x0") >= F.col(x), F.col("x0")))
    straddles = F.max(((F.col("x0") < F.col(x)) & (F.col("x1") > F.col(x))).cast("int"))
    out = words.groupBy("doc_id", "page", "row").agg(left.alias("l"), right.alias("r"), straddles.alias("s"))
    return out.select("doc_id", "page", "row", F.coalesce(((F.col("s") == 1) & (F.col("l").isNotNull() | F.col("r").isNotNull())) | (F.col("r") - F.col("l") < gap), F.lit(False)).alias("cuts"))


def boxes(rectangles: DataFrame, tables: DataFrame) -> DataFrame:
    """Rectangles (doc_id, page, width, x0, top, x1, bottom) large enough for text, not nearly as wide as the page, whose centre no table holds."""
    own = rectangles.where((F.col("x1") - F.col("x0") >= 40) & (F.col("bottom") - F.col("top") >= 20) & (F.col("x1") - F.col("x0") <= 0.9 * F.col("width")))
    return in_box(own, tables, "left_anti")


#: The side of a tile in points, and the tiles that a box may cover in either direction.
TILE, BOX_TILES = 50.0, 100


def inside(prefix: str) -> Column:
    """Whether the centre of x0, top, x1, bottom lies in the box of the prefixed columns."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    return x.between(F.col(f"{prefix}x0"), F.col(f"{prefix}x1")) & y.between(F.col(f"{prefix}top"), F.col(f"{prefix}bottom"))


def in_box(words: DataFrame, box: DataFrame, how: str = "inner") -> DataFrame:
    """Words with the box their centre lies in, or (left_anti) those in none.

    A page's words meet the boxes of their own tile only, so that no word is compared with all of a page. A box of more
    tiles than BOX_TILES lies in none and is compared by page. For left_anti a box that comes again is one.
    """
    edges = ("x0", "top", "x1", "bottom")
    b = box.select(F.col("doc_id").alias("bd"), F.col("page").alias("bp"), *(F.col(c).alias(f"b_{c}") for c in edges))
    b = b.distinct() if how == "left_anti" else b
    tile = lambda c: F.floor(c / TILE)
    span = lambda a, z: tile(F.col(f"b_{z}")) - tile(F.col(f"b_{a}")) + 1
    far = (span("x0", "x1") > BOX_TILES) | (span("top", "bottom") > BOX_TILES)
    numbers = lambda a, z: F.sequence(tile(F.col(f"b_{a}")), tile(F.col(f"b_{z}")))
    own = b.where((F.col("b_x0") <= F.col("b_x1")) & (F.col("b_top") <= F.col("b_bottom")))
    near = own.where(~far).withColumn("_tx", F.explode(numbers("x0", "x1"))).withColumn("_ty", F.explode(numbers("top", "bottom")))
    page = (F.col("doc_id") == F.col("bd")) & (F.col("page") == F.col("bp")) & inside("b_")
    at = (tile((F.col("x0") + F.col("x1")) / 2) == F.col("_tx")) & (tile((F.col("top") + F.col("bottom")) / 2) == F.col("_ty"))
    if how == "left_anti":
        return words.join(near, page & at, how).join(own.where(far), page, how)
    return words.join(near, page & at, how).drop("_tx", "_ty").unionByName(words.join(own.where(far), page, how))


def table_text(cells: Column | str) -> Column:
    """A line for each cell that isn't empty, row by row, from array<array<string>>."""
    return F.array_join(F.filter(F.flatten(cells), lambda c: F.coalesce(F.trim(c), F.lit("")) != ""), "\n")


def body_size(chars: DataFrame, *by: str) -> DataFrame:
    """The usual size (median) and the largest one."""
    return chars.groupBy(*by).agg(F.percentile("size", F.lit(0.5)).alias("body"), F.max("size").alias("largest"))
