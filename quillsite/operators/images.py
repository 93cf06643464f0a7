"""Grey images as arrays of numbers: resizing and flattening. Built-in array functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_matrix(flat: Column, rows: int, cols: int) -> Column:
    """An array of rows of a flat array."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(flat, i * cols + 1, cols))


def resize(image: Column, rows: int, cols: int, to_rows: int, to_cols: int) -> Column:
    """The image (an array of rows) at another size, each pixel from the nearest one."""
    near = lambda i, a, b: F.least(F.floor((i + 0.5) * a / b), F.lit(a - 1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(to_rows - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(to_cols - 1)), lambda j: F.get(F.get(image, near(i, rows, to_rows)), near(j, cols, to_cols)))
    )


def bilinear(image: Column, rows: int, cols: int, to_rows: int, to_cols: int) -> Column:
    """The image at another size, each pixel a mean of those around it, weighed by a triangle as wide as the scale.

    Weights depend on sizes only and enter as literals; a pixel's weights sum to one.
    """
    across, down = (_triangles(a, b) for a, b in ((cols, to_cols), (rows, to_rows)))
    mean = lambda weights, at: sum((F.lit(w) * at(k) for k, w in weights), F.lit(0.0))
    thin = F.transform(image, lambda row: F.array(*(mean(ws, lambda k, r=row: F.get(r, F.lit(k))) for ws in across)))
    pixel = lambda m, ws, j: mean(ws, lambda k: F.get(F.get(m, F.lit(k)), F.lit(j)))
    return F.get(F.transform(F.array(thin), lambda m: F.array(*(F.array(*(pixel(m, ws, j) for j in range(to_cols))) for ws in down))), F.lit(0))


def _triangles(n: int, to: int) -> list[list[tuple[int, float]]]:
    """For each of `to` places along n pixels: the pixels that it is made of, and their weights."""
    scale = n / to
    reach, out = max(scale, 1.0), []
    for j in range(to):
        centre = (j + 0.5) * scale
        low, high = max(int(centre - reach + 0.5), 0), min(int(centre + reach + 0.5), n)
        ws = [(k, max(1 - abs((k + 0.5 - centre) / reach), 0.0)) for k in range(low, high)]
        whole = sum(w for _, w in ws)
        out.append([(k, w / whole) for k, w in ws if w])
    return out


def channels(flat: Column, n: int, rows: int, cols: int) -> Column:
    """n images of a flat array that holds one channel after the other."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: as_matrix(F.slice(flat, c * rows * cols + 1, rows * cols), rows, cols))


def to_vector(image: Column) -> Column:
    """The rows of an image one after the other."""
    return F.flatten(image)
