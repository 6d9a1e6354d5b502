"""Layout of declarative scenes: tiles, flexible views, rescaling, flattening.

A scene is rows: one for each node, with its parent and place among its
siblings.  Sizes come from the parents down, one join for each level of depth,
which is small; everything within a level is expressions and windows over the
children of one parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _tile_width(n_columns: Column, n_rows: Column) -> Column:
    """Width of a tile in a grid of that many columns and rows; needs width, height, aspect_w, aspect_h, margin, padding."""
    free_x = F.greatest(F.lit(0.0), F.col("width") - n_columns * 2.0 * F.col("padding") - (n_columns + 1) * F.col("margin"))
    free_y = F.greatest(F.lit(0.0), F.col("height") - n_rows * 2.0 * F.col("padding") - (n_rows + 1) * F.col("margin"))
    return F.least(free_x / n_columns / F.col("aspect_w"), free_y / n_rows / F.col("aspect_h")) * F.col("aspect_w")


def tile_grid(layouts: DataFrame) -> DataFrame:
    """Add n_rows, n_columns, tile_width, tile_height: the grid whose tiles are widest, of equals that with fewest rows.

    ``layouts``: one row each with n, width, height, aspect_w, aspect_h, margin, padding.
    """
    def option(i: Column) -> Column:
        cols = F.ceil(F.col("n") / i)
        w = _tile_width(cols, i)
        return F.struct(F.when(w > 0, w).otherwise(0.0).alias("w"), (-i).alias("neg_rows"), cols.cast("long").alias("cols"))

    best = F.array_max(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long")), option))
    out = layouts.withColumn("__best", best)
    return out.select(
        *layouts.columns,
        (-F.col("__best.neg_rows")).alias("n_rows"),
        F.col("__best.cols").alias("n_columns"),
        F.col("__best.w").alias("tile_width"),
        (F.col("__best.w") / F.col("aspect_w") * F.col("aspect_h")).alias("tile_height"),
    )


def _spread(align: Column, before: tuple[str, ...], middle: str, after: str, free: Column, count: Column) -> tuple[Column, Column]:
    """Space before the first item, and that between items."""
    gap = F.when(align == "justified", free / (count + 1)).otherwise(0.0)
    first = F.when(align == middle, free / 2).when(align == after, free).when(align == "justified", gap).otherwise(0.0)
    return first, gap


def tile_positions(layouts: DataFrame) -> DataFrame:
    """One row for each tile: tile_ix, top, left, tile_width, tile_height; needs valign and halign, too."""
    grid = tile_grid(layouts).withColumn("tile_ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)))
    r, c = F.floor(F.col("tile_ix") / F.col("n_columns")), F.col("tile_ix") % F.col("n_columns")
    rows, last = F.col("n_rows"), F.col("n") - (F.col("n_rows") - 1) * F.col("n_columns")
    in_row = F.when(r < rows - 1, F.col("n_columns")).otherwise(last)
    pad, margin = F.col("padding"), F.col("margin")
    free_y = F.col("height") - (F.col("tile_height") + 2 * pad) * rows - margin * (rows + 1)
    free_x = F.col("width") - (F.col("tile_width") + 2 * pad) * in_row - margin * (in_row + 1)
    y0, gap_y = _spread(F.col("valign"), ("top",), "center", "bottom", free_y, rows)
    x0, gap_x = _spread(F.col("halign"), ("left",), "center", "right", free_x, in_row)
    top = y0 + pad + margin + r * (F.col("tile_height") + margin + 2 * pad + gap_y)
    left = x0 + pad + margin + c * (F.col("tile_width") + margin + 2 * pad + gap_x)
    return grid.withColumn("top", top).withColumn("left", left)


def fit_into(tile_w: Column, tile_h: Column, w: Column, h: Column) -> Column:
    """Struct (top, left, width, height) of a child in a tile, whole and centred; a child of unknown size fills it."""
    scale = F.least(tile_w / w, tile_h / h)
    known = w.isNotNull() & h.isNotNull()
    value = lambda inside, outside: F.when(known, inside).otherwise(outside)
    return F.struct(
        value((tile_h - scale * h) / 2, F.lit(0.0)).alias("top"), value((tile_w - scale * w) / 2, F.lit(0.0)).alias("left"),
        value(scale * w, tile_w).alias("width"), value(scale * h, tile_h).alias("height"),
    )


def rescale(width: Column, height: Column, border: Column, child_w: Column, child_h: Column, mode: Column, halign: Column, valign: Column) -> Column:
    """Struct (scale, top, left, width, height) of a child scaled to fit into or fill what its parent has inside the border."""
    inner_w, inner_h = F.greatest(width - 2 * border, F.lit(0.0)), F.greatest(height - 2 * border, F.lit(0.0))
    x, y = inner_w / child_w, inner_h / child_h
    scale = F.when(child_w.isNull() & child_h.isNull(), 1.0).when(child_w.isNull(), y).when(child_h.isNull(), x).when(mode == "fill", F.greatest(x, y)).otherwise(F.least(x, y))
    place = lambda align, end, inner, child: F.coalesce(
        F.when(align == end, inner - child * scale).when(align.isin("center", "justified"), (inner - child * scale) / 2).otherwise(0.0), F.lit(0.0)
    )
    return F.struct(
        scale.alias("scale"), place(valign, "bottom", inner_h, child_h).alias("top"), place(halign, "right", inner_w, child_w).alias("left"),
        F.coalesce(child_w * scale, inner_w).alias("width"), F.coalesce(child_h * scale, inner_h).alias("height"),
    )


def absolute(parent_w: Column, parent_h: Column, w: Column, h: Column, top: Column, left: Column, bottom: Column, right: Column) -> Column:
    """Struct (top, left, width, height) of a child placed by offsets from its parent's sides."""
    own_w, own_h = F.coalesce(w, parent_w), F.coalesce(h, parent_h)
    return F.struct(
        F.coalesce(top, parent_h - bottom - own_h).alias("top"), F.coalesce(left, parent_w - right - own_w).alias("left"), own_w.alias("width"), own_h.alias("height")
    )


def clipped_radius(radius: Column, width: Column, height: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(radius, F.greatest(F.lit(0.0), F.least(width, height) / 2)))


def flex(parents: DataFrame, children: DataFrame, clip: bool = True) -> DataFrame:
    """Children of views in a row or column: adds top, left, child_width, child_height, scale.

    ``parents``: parent_id, view_width, view_height, direction, border,
    pad_top, pad_right, pad_bottom, pad_left, overflow.  ``children``:
    parent_id, child_ix, width, height (null where unknown).  Children of
    unknown size share what the others leave; ``fit`` scales all down.  Borders
    wider than the view leave no room inside; without ``clip`` they leave less than none.
    """
    j = children.join(parents, "parent_id")
    row = F.col("direction") == "row"
    own_w, own_h = (F.greatest(F.lit(0.0), x) if clip else x for x in (F.col("view_width") - 2 * F.col("border"), F.col("view_height") - 2 * F.col("border")))
    main, cross = F.when(row, F.col("width")).otherwise(F.col("height")), F.when(row, F.col("height")).otherwise(F.col("width"))
    w = Window.partitionBy("parent_id")
    total, unknown, widest = F.coalesce(F.sum(main).over(w), F.lit(0.0)), F.count_if(main.isNull()).over(w), F.coalesce(F.max(cross).over(w), F.lit(0.0))
    j = j.withColumns({"__w": own_w, "__h": own_h, "__main": main, "__total": total, "__unknown": unknown, "__cross": widest})
    pad_x, pad_y = F.col("pad_left") + F.col("pad_right"), F.col("pad_top") + F.col("pad_bottom")
    room = F.when(row, F.col("__w") - pad_x).otherwise(F.col("__h") - pad_y)
    share = F.when(F.col("__unknown") > 0, F.greatest(F.lit(0.0), (room - F.col("__total")) / F.col("__unknown"))).otherwise(0.0)
    along, across = F.when(row, F.col("__w")).otherwise(F.col("__h")), F.when(row, F.col("__h")).otherwise(F.col("__w"))
    least = F.lit(1e-9)
    scale = F.when(F.col("overflow") == "fit", F.least(F.lit(1.0), along / F.greatest(F.col("__total"), least), across / F.greatest(F.col("__cross"), least))).otherwise(1.0)
    j = j.withColumns({"scale": scale, "__size": F.coalesce("__main", share)})
    before = Window.partitionBy("parent_id").orderBy("child_ix").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("border") / F.col("scale") + F.coalesce(F.sum("__size").over(before), F.lit(0.0))
    edge = F.col("border") / F.col("scale")
    return j.select(
        *children.columns,
        F.when(row, edge + F.col("pad_top")).otherwise(offset + F.col("pad_top")).alias("top"),
        F.when(row, offset + F.col("pad_left")).otherwise(edge + F.col("pad_left")).alias("left"),
        F.when(row, F.col("__size")).otherwise(F.coalesce("width", F.col("__w") - pad_x)).alias("child_width"),
        F.when(row, F.coalesce("height", F.col("__h") - pad_y)).otherwise(F.col("__size")).alias("child_height"),
        "scale",
    )


_MASK = "array<struct<top:double,left:double,width:double,height:double,radius:double>>"
_CROP = "struct<top:double,left:double,width:double,height:double>"
_SHADOWS = "array<struct<offset_x:double,offset_y:double,blur:double>>"
_OPTIONAL = {"crop": _CROP, "shadows": _SHADOWS, "radius": "double", "source_width": "double", "source_height": "double"}


def flatten(nodes: DataFrame) -> DataFrame:
    """Nested rectangles in coordinates of the output, each node and each of its shadows a row.

    ``nodes``: output_id, node_id, parent_id (null for a root), child_ix, top,
    left, width, height, scale_x, scale_y, rotation, border, mask (struct or
    null); optional: crop (of what its children show, in their coordinates),
    shadows (offset_x, offset_y, blur), radius, source_width and source_height
    (of a picture that fills the node).  Adds abs_top, abs_left, abs_width,
    abs_height, abs_rotation, abs_border, abs_radius, masks, source_crop, depth,
    shadow_ix (null for the node itself), abs_blur and path, which orders rows
    as they are drawn: shadows of all children of a node come before them.

    Scaling and clipping of all ancestors add up to one scale and one window
    on each axis, so nodes are placed from the roots down, one join a level
    until a level is empty; each level is written once.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    nodes = nodes.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in nodes.columns})
    columns = list(nodes.columns)
    number = lambda c: F.lpad(c.cast("string"), 12, "0")

    def placed(df: DataFrame, top: Column, left: Column) -> DataFrame:
        """From the parent's scales and windows (p_...) to a rectangle of the node."""
        axis = {"top": ("p_y", "p_sy", "height", top), "left": ("p_x", "p_sx", "width", left)}
        out = df
        for side, (origin, scale, size, own) in axis.items():
            out = out.withColumn(f"__{side}", F.col(origin) + own * F.col(scale)).withColumn(f"__{size}", F.col(size) * F.col(scale))
            low, high = F.greatest(F.col(f"__{side}"), F.col(f"p_{side}_lo")), F.least(F.col(f"__{side}") + F.col(f"__{size}"), F.col(f"p_{side}_hi"))
            out = out.withColumn(f"abs_{side}", low).withColumn(f"abs_{size}", high - low)
        return out.withColumns({"abs_rotation": F.col("p_rotation") + F.col("rotation"), "masks": F.col("p_masks")})

    def with_inner(df: DataFrame) -> DataFrame:
        """What the node hands on to its children."""
        sx, sy = F.col("p_sx") * F.col("scale_x"), F.col("p_sy") * F.col("scale_y")
        cut = F.col("crop").isNotNull()
        moved = F.when(
            F.col("mask").isNotNull(),
            F.array(F.struct((F.col("p_mask_y") + F.col("mask.top") * F.col("p_sy")).alias("top"), (F.col("p_mask_x") + F.col("mask.left") * F.col("p_sx")).alias("left"),
                             (F.col("mask.width") * F.col("p_sx")).alias("width"), (F.col("mask.height") * F.col("p_sy")).alias("height"), (F.col("mask.radius") * F.col("p_unified")).alias("radius"))),
        ).otherwise(F.array().cast(_MASK))
        window = lambda side, scale, size: {
            f"i_{side}_lo": F.when(cut, F.greatest(F.col(f"p_{side}_lo"), F.col(f"__{side}"))).otherwise(F.col(f"p_{side}_lo")),
            f"i_{side}_hi": F.when(cut, F.least(F.col(f"p_{side}_hi"), F.col(f"__{side}") + F.col(f"crop.{size}") * scale)).otherwise(F.col(f"p_{side}_hi")),
        }
        inner = {
            "i_sx": sx, "i_sy": sy, "i_unified": F.col("p_unified") * F.least("scale_x", "scale_y"), "i_rotation": F.col("abs_rotation"), "i_masks": F.concat("p_masks", moved.cast(_MASK)),
            "i_y": F.col("__top") - F.when(cut, F.col("crop.top") * sy).otherwise(0.0), "i_x": F.col("__left") - F.when(cut, F.col("crop.left") * sx).otherwise(0.0),
            "i_mask_y": F.col("p_mask_y") + F.col("top") * F.col("p_sy"), "i_mask_x": F.col("p_mask_x") + F.col("left") * F.col("p_sx"),
        } | window("top", sy, "height") | window("left", sx, "width")
        return df.withColumns(inner)

    def out_of(level: DataFrame, depth: int) -> DataFrame:
        """The rows of a level: its nodes, and their shadows."""
        share = lambda at, side, of: F.try_divide(F.col(f"abs_{side}") - F.col(f"__{side}"), F.col(f"__{of}")) * F.col(at)
        source = F.struct(
            share("source_height", "top", "height").alias("top"), share("source_width", "left", "width").alias("left"),
            (F.try_divide("abs_width", "__width") * F.col("source_width")).alias("width"), (F.try_divide("abs_height", "__height") * F.col("source_height")).alias("height"),
        )
        keep = [*columns, "abs_top", "abs_left", "abs_width", "abs_height", "abs_rotation", "abs_border", "abs_radius", "masks", "source_crop", "depth", "shadow_ix", "abs_blur", "path"]
        own = level.withColumns(
            {
                "abs_border": F.col("border") * F.col("p_unified"), "abs_radius": F.col("radius") * F.col("p_unified"), "source_crop": F.when(F.col("source_width").isNotNull(), source),
                "depth": F.lit(depth), "shadow_ix": F.lit(None).cast("int"), "abs_blur": F.lit(None).cast("double"),
            }
        )
        cast = level.select(*columns, *[c for c in level.columns if c.startswith("p_")], F.posexplode("shadows").alias("shadow_ix", "s"))
        cast = placed(cast, F.col("top") + F.col("s.offset_y"), F.col("left") + F.col("s.offset_x")).withColumns(
            {
                "abs_border": F.lit(0.0), "abs_radius": (F.coalesce("radius", F.lit(0.0)) + F.col("s.blur") / 2) * F.col("p_unified"), "source_crop": F.lit(None).cast(_CROP), "depth": F.lit(depth),
                "abs_blur": F.col("s.blur") * F.col("p_unified"), "path": F.concat("p_path", F.lit("0/"), number(F.col("child_ix")), F.lit("."), number(F.col("shadow_ix"))),
            }
        )
        return own.select(*keep).unionByName(cast.select(*keep))

    low, high, none = F.lit(float("-inf")), F.lit(float("inf")), F.array().cast(_MASK)
    start = {"p_y": zero, "p_x": zero, "p_mask_y": zero, "p_mask_x": zero, "p_sx": one, "p_sy": one, "p_unified": one, "p_rotation": zero, "p_masks": none, "p_path": F.lit(""), "p_top_lo": low, "p_top_hi": high, "p_left_lo": low, "p_left_hi": high}
    level, out, depth = nodes.where("parent_id is null").withColumns(start), None, 0
    while True:
        level = with_inner(placed(level, F.col("top"), F.col("left"))).withColumn("path", F.concat("p_path", F.lit("1/"), number(F.col("child_ix"))))
        level = written(level, f"level-{depth}")
        if depth and level.isEmpty():
            return out
        rows = out_of(level, depth)
        out = rows if out is None else out.unionByName(rows)
        inner = [c for c in level.columns if c.startswith("i_")]
        up = level.select("output_id", F.col("node_id").alias("parent_id"), F.concat("path", F.lit("/")).alias("p_path"), *[F.col(c).alias("p" + c[1:]) for c in inner])
        level, depth = nodes.join(up, ["output_id", "parent_id"]).select(*columns, *[c for c in up.columns if c not in ("output_id", "parent_id")]), depth + 1


def drawn(layouts: DataFrame, width: float, height: float) -> DataFrame:
    """Layouts that can change the output: not empty, not beyond its right or lower edge, not transparent.

    Needs abs_ columns, kind (color, child, shadow), alpha, border_alpha; of a
    child with a source_crop, what its crop leaves must lie in the picture.
    Borders thinner than one are none; masks that hold the whole layout go.
    """
    visible = (F.col("abs_width") > 0) & (F.col("abs_height") > 0) & (F.col("abs_top") <= height) & (F.col("abs_left") <= width)
    transparent = (F.col("alpha") == 0) & F.when(F.col("kind") == "color", (F.col("border_alpha") == 0) & (F.col("abs_border") <= 0)).otherwise(F.col("kind") == "shadow")
    cuts = lambda m: ~(
        (m["top"] + m["radius"] <= F.col("abs_top")) & (m["left"] + m["radius"] <= F.col("abs_left"))
        & (m["left"] + m["width"] - m["radius"] >= F.col("abs_left") + F.col("abs_width")) & (m["top"] + m["height"] - m["radius"] >= F.col("abs_top") + F.col("abs_height"))
    )
    if "source_crop" in layouts.columns:
        c = F.col("source_crop")
        outside = (c["left"] > F.col("source_width")) | (c["top"] > F.col("source_height")) | (c["top"] + c["height"] < 0) | (c["left"] + c["width"] < 0)
        visible &= ~F.coalesce((F.col("kind") == "child") & outside, F.lit(False))
    border = F.when(F.col("abs_border") < 1, 0.0).otherwise(F.col("abs_border"))
    return layouts.where(visible & ~transparent).withColumn("abs_border", border).withColumn("masks", F.filter("masks", cuts))


def capped(layouts: DataFrame, most: int = 100, masks: int = 20) -> DataFrame:
    """The first layouts of each output in drawing order, and the first masks of each."""
    w = Window.partitionBy("output_id").orderBy("path")
    return layouts.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n").withColumn("masks", F.slice("masks", 1, masks))


def bound(leaves: DataFrame, samples: DataFrame) -> DataFrame:
    """Leaves of scenes with the frame that their input shows: adds frame_id, and stub where there is none.

    ``leaves``: slot_pts, output_id, node_id, input_id; ``samples``: slot_pts,
    input_id, frame_id.  An input that isn't there or shows nothing gives an empty stub.
    """
    shown = samples.where("frame_id is not null").select("slot_pts", "input_id", "frame_id")
    return leaves.join(shown, ["slot_pts", "input_id"], "left").withColumn("stub", F.col("frame_id").isNull())


def resample_plan(crop_left: Column, crop_width: Column, width: Column, crop_top: Column, crop_height: Column, height: Column) -> Column:
    """Struct (passes, first, levels_x, levels_y, shift) of the filter passes that bring a crop to a size.

    An axis that keeps its scale and begins on a whole pixel needs no pass, its
    ``shift`` rides along with the other's; two passes begin with the axis that
    shrinks more.  ``levels``: halvings before the filter, so that at most a
    factor of four is left to it.
    """
    same = lambda a, b: F.abs(a - b) < 0.001
    direct = lambda offset, size, to: same(size, to) & same(offset, F.round(offset))
    x, y = direct(crop_left, crop_width, width), direct(crop_top, crop_height, height)
    sx, sy = F.try_divide(crop_width, width), F.try_divide(crop_height, height)
    levels = lambda s: F.when(s.isNull() | F.isnan(s) | (s <= 4), 0).otherwise(F.least(F.lit(16), F.ceil(F.log2(s / 4)).cast("int")))
    first = F.when(x & y, F.lit(None)).when(y, "horizontal").when(x, "vertical").when(sy > sx, "vertical").otherwise("horizontal")
    shift = F.when(x & ~y, F.round(crop_left)).when(y & ~x, F.round(crop_top)).otherwise(0).cast("int")
    passes = F.when(x & y, 0).when(x | y, 1).otherwise(2)
    return F.struct(passes.alias("passes"), first.alias("first"), levels(sx).alias("levels_x"), levels(sy).alias("levels_y"), shift.alias("shift"))


def first_inputs(nodes: DataFrame, most: int = 16) -> DataFrame:
    """The first inputs of each shader node, in order; the rest isn't bound."""
    w = Window.partitionBy("output_id", "node_id").orderBy("input_ix")
    return nodes.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def problems(nodes: DataFrame) -> DataFrame:
    """(output_id, component_id, problem) of what a scene may not have: ids used twice, a web page on several outputs."""
    twice = nodes.where("component_id is not null").groupBy("output_id", "component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pages = nodes.where("type = 'web_view'").groupBy(F.col("instance_id").alias("component_id")).agg(F.countDistinct("output_id").alias("n"), F.min("output_id").alias("output_id")).where("n > 1")
    return twice.select("output_id", "component_id", F.lit("duplicate id").alias("problem")).unionByName(pages.select("output_id", "component_id", F.lit("shared page").alias("problem")))


def moved_tiles(start: DataFrame, end: DataFrame, state: Column) -> DataFrame:
    """Tiles between two layouts: (output_id, tile_id, top, left, width, height).

    A tile in both moves in a line.  A new one shows at once, unless a tile
    that stays elsewhere was in its place before: then only at the end.
    """
    from ..functions.easing import lerp

    sides = ["top", "left", "width", "height"]
    s = start.select("output_id", "tile_id", *[F.col(c).alias(f"s_{c}") for c in sides])
    both = end.join(s, ["output_id", "tile_id"], "left").withColumn("__state", state)
    kept = start.join(end.select("output_id", "tile_id"), ["output_id", "tile_id"], "left_semi")
    # places to a thousandth: equal ones meet in the same or a neighbouring cell
    cell = lambda c: F.floor(F.col(c) / 0.001)
    near = F.explode(F.array(*[F.struct((cell("top") + i).alias("y"), (cell("left") + k).alias("x")) for i in (-1, 0, 1) for k in (-1, 0, 1)]))
    taken = kept.select("output_id", F.struct(cell("top").alias("y"), cell("left").alias("x")).alias("cell"), *[F.col(c).alias(f"t_{c}") for c in sides])
    fresh = end.join(start.select("output_id", "tile_id"), ["output_id", "tile_id"], "left_anti").withColumn("cell", near)
    close = [F.abs(F.col(c) - F.col(f"t_{c}")) < 0.001 for c in sides]
    hidden = fresh.join(taken, ["output_id", "cell"]).where(close[0] & close[1] & close[2] & close[3]).select("output_id", "tile_id").distinct().withColumn("__hidden", F.lit(True))
    out = both.join(hidden, ["output_id", "tile_id"], "left").where((F.col("__state") >= 1) | F.col("__hidden").isNull())
    return out.select("output_id", "tile_id", *[F.when(F.col("__state") >= 1, F.col(c)).when(F.col(f"s_{c}").isNull(), F.col(c)).otherwise(lerp(F.col(f"s_{c}"), F.col(c), F.col("__state"))).alias(c) for c in sides])
