"""Fields found on page images: two detections as one set of boxes, without those that lie inside another.

Boxes are (x0, y_top, x1, y_bot) in pixels, y downwards, with `ord`, the order of their detection. Who lies in whom comes
from a join on grid cells: a box is entered in the few cells it touches of a grid as coarse as itself, and the corner of a
smaller box looks into one cell of each grid in use on its page, so that a pair meets once and disjoint boxes do not meet.

Defined results: sides that are null, not finite or the wrong way round are no box and go out; of equal boxes the first
stays, boxes before underlines; null pages are a page like any other; an empty detection adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.session import ensure_checkpoint_dir

SIDES = ["x0", "y_top", "x1", "y_bot"]

# Pixels at 150 dots an inch.
MIN_WIDTH, MIN_HEIGHT = 20, 14
CHECKBOX_MAX = 45
UNDERLINE_MIN, FIELD_BAND = 60, 30
CORNER_TOLERANCE = 3


def detected_boxes(
    boxes: DataFrame,
    underlines: DataFrame,
    key: list[str],
    *,
    tolerance: float = CORNER_TOLERANCE,
    underline_min: float = UNDERLINE_MIN,
    band: float = FIELD_BAND,
    min_width: float = MIN_WIDTH,
    min_height: float = MIN_HEIGHT,
) -> DataFrame:
    """(key, detection, ord, kind, x0, y_top, x1, y_bot) of the fields of every page.

    An underline counts where it is long enough and its centre is in no box; its field is the band above it. From the
    largest area down, in order of detection where areas are equal, a box goes that lies in one kept before it, give or
    take the tolerance on each side; what is too small goes last, so it can hide others.
    """
    first, second = _valid(boxes, key), _valid(underlines, key).where(F.col("x1") - F.col("x0") >= underline_min)
    inside = _holders(_at(second, (F.col("x0") + F.col("x1")) / 2, (F.col("y_top") + F.col("y_bot")) / 2), first, 0.0)
    ids = ["_page", *SIDES, "ord"]
    second = second.join(inside.select(*(F.col(f"_p.{c}").alias(c) for c in ids)).distinct(), ids, "left_anti")
    field = F.greatest(F.col("y_top") - band, F.lit(0.0))
    second = second.withColumn("y_bot", F.col("y_bot") + 1).withColumn("y_top", field)
    both = first.withColumn("detection", F.lit(0)).unionByName(second.withColumn("detection", F.lit(1)))
    return _outermost(both, tolerance).where((_width() >= min_width) & (_height() >= min_height)).select(
        *(F.col(f"_page.{c}").alias(c) for c in key), "detection", "ord", box_kind().alias("kind"), *SIDES
    )


def box_kind(limit: float = CHECKBOX_MAX) -> Column:
    """`checkbox` for small boxes that are nearly square, `text` for the others."""
    small = (_width() <= limit) & (_height() <= limit) & (_height() > 0)
    return F.when(small & _width().between(0.6 * _height(), 1.8 * _height()), "checkbox").otherwise("text")


def _width() -> Column:
    return F.col("x1") - F.col("x0")


def _height() -> Column:
    return F.col("y_bot") - F.col("y_top")


def _valid(boxes: DataFrame, key: list[str]) -> DataFrame:
    """(_page, sides as doubles, ord) of what is a box."""
    rows = boxes.select(F.struct(*key).alias("_page"), *(F.col(s).cast("double").alias(s) for s in SIDES), "ord")
    finite = [F.col(s).isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) for s in SIDES]
    for ok in [*finite, F.col("x0") <= F.col("x1"), F.col("y_top") <= F.col("y_bot")]:
        rows = rows.where(ok)
    return rows


def _level(side: Column) -> Column:
    """The grid for a side: cells of 2^level pixels are no smaller."""
    return F.ceil(F.log2(F.greatest(side, F.lit(1.0))))


def _cell(at: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), F.col("_level")))


def _at(rows: DataFrame, x: Column, y: Column, side: Column | None = None) -> DataFrame:
    """Rows as points (_page, px, py, _least, _p): only grids from `_least` on can hold what is around them."""
    # a level lower than the side asks for, since differences of floating numbers are rounded
    least = F.lit(0) if side is None else _level(side) - 1
    return rows.select("_page", x.alias("px"), y.alias("py"), least.cast("long").alias("_least"), F.struct(*rows.columns).alias("_p"))


def _holders(points: DataFrame, boxes: DataFrame, tolerance: float) -> DataFrame:
    """(_p, _b): every point and each box around it, give or take the tolerance."""
    b = F.col("_b")
    side = F.greatest(_width(), _height()) + 2 * tolerance
    placed = boxes.select("_page", F.struct(*boxes.columns).alias("_b"), _level(side).alias("_level"))
    across = F.sequence(_cell(b["x0"] - tolerance), _cell(b["x1"] + tolerance))
    down = F.sequence(_cell(b["y_top"] - tolerance), _cell(b["y_bot"] + tolerance))
    entered = placed.withColumn("_cx", F.explode(across)).withColumn("_cy", F.explode(down))
    levels = placed.select("_page", "_level").distinct()
    looks = points.join(levels, "_page").where("_level >= _least").select(
        "_page", "px", "py", "_p", "_level", _cell(F.col("px")).alias("_cx"), _cell(F.col("py")).alias("_cy")
    )
    met = looks.join(entered, ["_page", "_level", "_cx", "_cy"])
    around = F.col("px").between(b["x0"] - tolerance, b["x1"] + tolerance) & F.col("py").between(b["y_top"] - tolerance, b["y_bot"] + tolerance)
    return met.where(around).select("_p", "_b")


def _rank(box: Column) -> Column:
    """What comes first is larger, or found before."""
    area = (box["x1"] - box["x0"]) * (box["y_bot"] - box["y_top"])
    return F.struct((-area).alias("less"), *(box[c].alias(c) for c in ["detection", "ord", *SIDES]))


def _outermost(boxes: DataFrame, tolerance: float) -> DataFrame:
    """Boxes that lie in no box kept before them; boxes of one place are one. Pairs are pairs of numbers."""
    first = F.min(F.struct("detection", "ord")).alias("_f")
    one = boxes.groupBy("_page", *SIDES).agg(first).select("_page", *SIDES, "_f.*")
    one = _cut(one.withColumn("_id", F.monotonically_increasing_id()))
    inner, outer = F.col("_p"), F.col("_b")
    met = _holders(_at(one, F.col("x0"), F.col("y_top"), F.greatest(_width(), _height())), one, tolerance)
    within = (inner["x1"] <= outer["x1"] + tolerance) & (inner["y_bot"] <= outer["y_bot"] + tolerance)
    edges = met.where(within & (_rank(outer) < _rank(inner))).select(outer["_id"].alias("outer"), inner["_id"].alias("inner"))
    hidden = _hidden(edges).withColumnRenamed("inner", "_id")
    return one.join(hidden, "_id", "left_anti").select("_page", "detection", "ord", *SIDES)


def _hidden(edges: DataFrame) -> DataFrame:
    """(inner) of the boxes that a kept box holds. What nothing undecided holds is kept and hides all inside it.

    A round decides whole nests at once: more than two follow only where boxes are shifted within the tolerance, so that
    one lies in the next, but not in the one after it.
    """
    edges = _cut(edges.distinct())
    gone = edges.select("inner").limit(0)
    while not edges.isEmpty():
        held = edges.select(F.col("inner").alias("outer")).distinct()
        now = _cut(edges.join(held, "outer", "left_anti").select("inner").distinct())
        gone = gone.unionByName(now)
        edges = edges.join(now, "inner", "left_anti").join(now.withColumnRenamed("inner", "outer"), "outer", "left_anti")
        edges = _cut(edges.select("outer", "inner"))
    return gone


def _cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
