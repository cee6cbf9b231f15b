"""Column expressions on bounding boxes (min_x, min_y, max_x, max_y), points and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The world in degrees, the scale and offsets of the Morton code, the depth of the tree.
WORLD = (-180.0, -90.0, 180.0, 90.0)
MORTON_SCALE = 1e6
DEPTH = 17
#: Sums below this are looked up in a table of logarithms.
LOOKED_UP = 1024


def intersects(a: list[Column], b: list[Column]) -> Column:
    """Closed overlap: touching boxes intersect. A box that covers another one intersects it, too."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def intersection(a: list[Column], b: list[Column]) -> list[Column]:
    return [F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])]


def centre(low: Column, high: Column) -> Column:
    return (low + high) / 2.0


def floor_log2(n: Column) -> Column:
    """floor(log2 n) for n >= 1, exact for the whole range of LONG; 63 for 0."""
    known = F.lit([63] + [k.bit_length() - 1 for k in range(1, LOOKED_UP)])
    return F.when((n >= 0) & (n < LOOKED_UP), F.get(known, n.cast("int"))).otherwise(F.length(F.bin(n)) - 1).cast("long")


def pair_weight(a: Column, b: Column) -> Column:
    """s * floor(log2 s) of the sum of both weights, 0 for 0."""
    s = a + b
    return F.when(s == 0, 0).otherwise(s * floor_log2(s)).cast("long")


def inside(x: Column, y: Column, b: list[Column]) -> Column:
    """Half-open point-in-box test."""
    return (x >= b[0]) & (x < b[2]) & (y >= b[1]) & (y < b[3])


def spread(n: Column) -> Column:
    """The bits of a 32-bit number, moved to the even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
    return n


def morton(x: Column, y: Column) -> Column:
    """Z-order code of millionths of a degree: x on even bits, y on odd ones."""
    ix = ((x + 180.0) * MORTON_SCALE).cast("long")
    iy = ((y + 90.0) * MORTON_SCALE).cast("long")
    return spread(ix).bitwiseOR(F.shiftleft(spread(iy), 1))


def places(x: Column, y: Column, root: list[Column], depth: int = DEPTH) -> list[Column]:
    """Column and row, from the lower left, of the cell of a depth that holds a point. Points outside the
    root go to the nearest side. The quotient is off by one at most; the cell's own sides, which are exact where halving is, decide.
    A depth's sides are among those of deeper ones, so the places of a lesser depth are the same shifted to the right."""
    def place(v: Column, low: Column, high: Column) -> Column:
        n = 1 << depth
        step = (high - low) / float(n)
        k = F.floor((v - low) / (high - low) * float(n))
        k = k - F.when(v < low + k * step, 1).otherwise(0) + F.when(v >= low + (k + 1) * step, 1).otherwise(0)
        return F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)).cast("long")

    return [place(x, root[0], root[2]), place(y, root[1], root[3])]


def path_of(ix: Column, iy: Column, depth: int = DEPTH) -> Column:
    """Base-4 code of the quadrants from the root down to the cell in a column and row: 2 for the lower half, 1 for the right one."""
    full = F.lit((1 << depth) - 1)
    return spread(ix).bitwiseOR(F.shiftleft(spread(full - iy), 1))


def tree_path(x: Column, y: Column, root: list[Column], depth: int = DEPTH) -> Column:
    """The path of the cell that holds a point."""
    return path_of(*places(x, y, root, depth), depth)


def unspread(n: Column) -> Column:
    """The bits on even places, moved together."""
    n = n.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        n = n.bitwiseOR(F.shiftright(n, shift)).bitwiseAND(F.lit(mask))
    return n


def node_box(depth: Column, path: Column, root: list[Column]) -> list[Column]:
    """The box of a tree node."""
    parts = F.pow(F.lit(2.0), depth)
    ix = unspread(path).cast("double")
    iy = parts - 1.0 - unspread(F.shiftright(path, 1)).cast("double")
    wide, high = (root[2] - root[0]) / parts, (root[3] - root[1]) / parts
    return [root[0] + ix * wide, root[1] + iy * high, root[0] + (ix + 1.0) * wide, root[1] + (iy + 1.0) * high]


def polygon(b: list[Column]) -> Column:
    """The box as WKT, six decimals, from the lower left corner clockwise, closed."""
    x0, y0, x1, y1 = b
    return F.format_string("POLYGON ((%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f))", x0, y0, x0, y1, x1, y1, x1, y0, x0, y0)


def world() -> list[Column]:
    return [F.lit(v) for v in WORLD]
