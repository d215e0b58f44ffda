"""Bounding boxes as structs ``x, y, w, h`` of doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def box(x, y, w, h) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def overlap_area(a: Column, b: Column) -> Column:
    side = lambda p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0.0))
    return side("x", "w") * side("y", "h")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = overlap_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share more than an edge."""
    return (a["x"] < b["x"] + b["w"]) & (a["x"] + a["w"] > b["x"]) & (a["y"] < b["y"] + b["h"]) & (a["y"] + a["h"] > b["y"])


def any_overlap(boxes: Column) -> Column:
    """Whether any two boxes of an array overlap."""
    indexed = F.transform(boxes, lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    return F.exists(indexed, lambda p: F.exists(indexed, lambda q: (p["i"] < q["i"]) & overlaps(p["b"], q["b"])))


def area_difference(a: Column, b: Column) -> Column:
    """Difference of two areas relative to the larger one; null if both are empty."""
    return F.try_divide(F.abs(area(a) - area(b)), F.greatest(area(a), area(b)))


def centre_distance(a: Column, b: Column) -> Column:
    dx = a["x"] + a["w"] / 2 - b["x"] - b["w"] / 2
    dy = a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2
    return F.sqrt(dx * dx + dy * dy)


def nearest_distances(boxes: Column) -> Column:
    """For each box the least distance of its centre from another's; infinite for a single one."""
    far = F.lit(float("inf"))
    indexed = F.transform(boxes, lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    return F.transform(indexed, lambda p: F.aggregate(F.filter(indexed, lambda q: q["i"] != p["i"]), far, lambda m, q: F.least(m, centre_distance(p["b"], q["b"]))))


def isolated_positions(boxes: Column, least: float = 50.0, most: int = 3) -> Column:
    """Positions, in order, of boxes at least so far from all others; one fewer than there are boxes at most."""
    near = F.transform(nearest_distances(boxes), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    found = F.transform(F.filter(near, lambda s: s["d"] >= least), lambda s: s["i"])
    return F.slice(found, 1, F.greatest(F.least(F.lit(most), F.size(boxes) - 1), F.lit(0)))


def prefixes(items: Column) -> Column:
    """The first element, the first two, and so on."""
    return F.when(F.size(items) == 0, F.array().cast("array<array<int>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))), lambda n: F.slice(items, 1, n)))


def corners(b: Column) -> Column:
    """x0, y0, x1, y1."""
    return F.struct(b["x"].alias("x0"), b["y"].alias("y0"), (b["x"] + b["w"]).alias("x1"), (b["y"] + b["h"]).alias("y1"))


def normalized(b: Column, width: Column, height: Column) -> Column:
    """Corners as shares of the picture's size."""
    c = corners(b)
    return F.struct((c["x0"] / width).alias("x0"), (c["y0"] / height).alias("y0"), (c["x1"] / width).alias("x1"), (c["y1"] / height).alias("y1"))


def unnormalized(b: Column, width: Column, height: Column) -> Column:
    return box(b["x"] * width, b["y"] * height, b["w"] * width, b["h"] * height)


def rescaled(b: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    """A box of one picture size in another, cut to whole pixels."""
    return F.struct(*[(b[c] * to / from_).cast("int").alias(c) for c, from_, to in (("x", from_w, to_w), ("y", from_h, to_h), ("w", from_w, to_w), ("h", from_h, to_h))])


def grown_centred(b: Column, share: float = 0.1) -> Column:
    return box(b["x"] - b["w"] * (share / 2), b["y"] - b["h"] * (share / 2), b["w"] * (1 + share), b["h"] * (1 + share))


def grown_right_down(b: Column, share: float = 0.1) -> Column:
    return box(b["x"], b["y"], b["w"] * (1 + share), b["h"] * (1 + share))


def off_edges(b: Column, width: Column, height: Column, shift: float) -> Column:
    """A box that touches an edge moved away from it; the left and upper edges go first."""
    move = lambda p, s, size: F.when(b[p] <= 0, b[p] + shift).when(b[p] + b[s] >= size, b[p] - shift).otherwise(b[p])
    return box(move("x", "w", width), move("y", "h", height), b["w"], b["h"])


def swapped_places(boxes: Column) -> Column:
    """Each box at the place of the next one, the last at the first's, with its own size."""
    return F.transform(boxes, lambda b, i: box(boxes[(i + 1) % F.size(boxes)]["x"], boxes[(i + 1) % F.size(boxes)]["y"], b["w"], b["h"]))


def union_crop(corners_: Column, width: Column, height: Column) -> Column:
    """The region that holds all boxes, given as corners in shares of the picture, widened and cut to whole pixels; null for no boxes."""
    least = lambda c, s, k: F.array_min(F.transform(corners_, lambda b: b[c] * s * k)).cast("int")
    most = lambda c, s, k: F.array_max(F.transform(corners_, lambda b: b[c] * s * k)).cast("int")
    return F.when(F.size(corners_) > 0, F.struct(least("x0", width, 0.9).alias("x0"), least("y0", height, 0.9).alias("y0"), most("x1", width, 1.1).alias("x1"), most("y1", height, 1.1).alias("y1")))


def small_boxes(boxes: Column, width: Column, height: Column, share: float = 0.85) -> Column:
    """Boxes that cover less than so much of the picture."""
    return F.filter(boxes, lambda b: area(b) / (width * height) < share)


def fitted_size(width: Column, height: Column, target: int = 256) -> Column:
    """Width and height with the longer side as given and the shape kept."""
    ratio = width / height
    return F.struct(F.when(ratio > 1, target).otherwise((target * ratio).cast("int")).alias("w"), F.when(ratio > 1, (target / ratio).cast("int")).otherwise(target).alias("h"))


def closest_ratio(width: Column, height: Column, ratios: list[tuple[int, int]], size: int) -> Column:
    """The tiling (columns, rows) whose shape is closest; of equally close ones a later one if the picture has more than half of its area."""
    shape, have = width / height, width * height
    best = F.struct(F.lit(float("inf")).alias("d"), F.lit(1).alias("c"), F.lit(1).alias("r"))
    for c, r in ratios:
        d = F.abs(shape - F.lit(c / r))
        here = F.struct(d.alias("d"), F.lit(c).alias("c"), F.lit(r).alias("r"))
        best = F.when(d < best["d"], here).when((d == best["d"]) & (have > 0.5 * size * size * c * r), here).otherwise(best)
    return F.struct(best["c"].alias("columns"), best["r"].alias("rows"))


def tile_ratios(most: int, least: int = 1) -> list[tuple[int, int]]:
    """Tilings (columns, rows) of ``least`` to ``most`` tiles, the fewest tiles first."""
    return sorted(((c, r) for c in range(1, most + 1) for r in range(1, most + 1) if least <= c * r <= most), key=lambda t: (t[0] * t[1], t))


def tiles(columns: Column, rows: Column, size: int) -> Column:
    """The square tiles of a tiling, row by row, as corners."""

    def tile(i: Column) -> Column:
        x, y = (i % columns) * size, F.floor(i / columns).cast("int") * size
        return F.struct(x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1"))

    return F.transform(F.sequence(F.lit(0), columns * rows - 1), tile)
