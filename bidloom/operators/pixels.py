"""Image steps as Spark expressions: each image is a row with a flat array of gray values (0 to 255), row by row, and its width.

Everything stays in the JVM. All steps are Column expressions on a row, so images spread over tasks as they lie; ``cleaned``, whose work
is large for few bytes, deals them evenly first. The published algorithms; exact parity with a particular imaging library is not claimed. A null image gives null, an empty one
an empty one; ids may be null or repeat, as no step asks for them. Widths may be numbers or columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import any_glare, blur_variance, clamped, mirrored

Size = int | Column


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, and not for every element of a lambda that reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cells(height: Column, width: Column, value: Callable[[Column, Column], Column]) -> Column:
    """A flat array of value(row, column)."""
    n = (height * width).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: value(F.floor(i / width).cast("int"), i % width))


def _height(gray: Column, width: Size) -> Column:
    return F.when(F.size(gray) > 0, (F.size(gray) / width).cast("int")).otherwise(0)


def _byte(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), value))


# ------------------------------------------------------------------ size and shape

#: Least width of an image that is read, and the cubic kernel's parameter.
LEAST_WIDTH, CUBIC = 1200, -0.75


def _cubic(t: Column) -> list[Column]:
    """Weights of the four places around one that lies t behind the second of them."""
    near = lambda x: ((CUBIC + 2) * x - (CUBIC + 3)) * x * x + 1
    far = lambda x: ((CUBIC * x - 5 * CUBIC) * x + 8 * CUBIC) * x - 4 * CUBIC
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def resized(gray: Column, width: Size, new_width: Size, new_height: Size) -> Column:
    """Cubic interpolation, first along rows and then along columns; places beyond the borders count as the border."""
    width, new_width, new_height = F.lit(width), F.lit(new_width), F.lit(new_height)

    def along(k: Column, scale: Column, n: Column, read: Callable[[Column], Column]) -> Column:
        def mix(place: Column) -> Column:
            first = F.floor(place).cast("int")
            values = [w * read(clamped(first + d, n)) for d, w in zip((-1, 0, 1, 2), _cubic(place - first), strict=True)]
            return values[0] + values[1] + values[2] + values[3]

        return bound((k + 0.5) * scale - 0.5, mix)

    def both(g: Column) -> Column:
        height = _height(g, width)
        wide = _cells(height, new_width, lambda r, c: along(c, width / new_width, width, lambda x: F.get(g, r * width + x)))
        tall = lambda a: _cells(new_height, new_width, lambda r, c: _byte(along(r, height / new_height, height, lambda y: F.get(a, y * new_width + c))))
        return F.when(F.size(g) > 0, bound(wide, tall)).otherwise(g)

    return bound(gray, both)


def upscaled(gray: Column, width: Size, least: int = LEAST_WIDTH) -> Column:
    """(gray, width): at least ``least`` wide, the height in proportion; wider images stay as they are."""
    w = F.lit(width)
    height = F.round(_height(gray, width) * (F.lit(least) / w)).cast("int")
    small = w < least
    return F.struct(F.when(small, resized(gray, width, least, height)).otherwise(gray).alias("gray"), F.when(small, least).otherwise(w).cast("int").alias("width"))


def _between(g: Column, width: Column, height: Column, y: Column, x: Column, outside: Column | None) -> Column:
    """The value at a place between pixels; beyond the borders ``outside``, or the border where that is None."""

    def at(row: Column, col: Column) -> Column:
        found = F.get(g, clamped(row, height) * width + clamped(col, width))
        return found if outside is None else F.when((row >= 0) & (row < height) & (col >= 0) & (col < width), found).otherwise(outside)

    def mix(p: Column) -> Column:
        r, c, down, right = p["r"], p["c"], p["y"] - p["r"], p["x"] - p["c"]
        top = at(r, c) * (1 - right) + at(r, c + 1) * right
        return top * (1 - down) + (at(r + 1, c) * (1 - right) + at(r + 1, c + 1) * right) * down

    place = F.struct(y.alias("y"), x.alias("x"))
    whole = lambda p: F.struct(p["y"], p["x"], F.floor(p["y"]).cast("int").alias("r"), F.floor(p["x"]).cast("int").alias("c"))
    return bound(bound(place, whole), mix)


def rotated(gray: Column, width: Size, degrees: Column) -> Column:
    """The image turned counter-clockwise about its middle, of the same size; beyond its borders it goes on as they are."""
    w = F.lit(width)

    def turn(g: Column) -> Column:
        height = _height(g, w)
        cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
        my, mx = F.floor(height / 2), F.floor(w / 2)
        return F.when(g.isNotNull(), _cells(height, w, lambda r, c: _between(g, w, height, (r - my) * cos + (c - mx) * sin + my, (c - mx) * cos - (r - my) * sin + mx, None)))

    return bound(gray, turn)


def page_of(gray: Column, width: Size, corners: Column) -> Column:
    """(gray, width, height): the quadrilateral with the corners (array of x, y: top left, top right, bottom right, bottom left) made
    a rectangle. It is as wide and high as the longer of opposite edges; places outside the image are 0. Corners that span nothing
    (an edge of less than a pixel, three in a line at the far corner) give null."""
    w = F.lit(width)
    dot = lambda i: (F.get(corners, F.lit(i))["x"].cast("double"), F.get(corners, F.lit(i))["y"].cast("double"))
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = map(dot, range(4))
    edge = lambda xa, ya, xb, yb: F.floor(F.sqrt((xa - xb) * (xa - xb) + (ya - yb) * (ya - yb))).cast("int")
    wide = F.greatest(edge(x2, y2, x3, y3), edge(x1, y1, x0, y0))
    high = F.greatest(edge(x1, y1, x2, y2), edge(x0, y0, x3, y3))
    # the projective map of the unit square onto the quadrilateral
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    den = (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)
    p = F.try_divide(sx * (y3 - y2) - (x3 - x2) * sy, den)
    q = F.try_divide((x1 - x2) * sy - sx * (y1 - y2), den)
    terms = F.struct(
        (x1 - x0 + p * x1).alias("a"), (x3 - x0 + q * x3).alias("b"), x0.alias("c"), (y1 - y0 + p * y1).alias("d"), (y3 - y0 + q * y3).alias("e"), y0.alias("f"), p.alias("p"), q.alias("q"),
        wide.alias("wide"), high.alias("high"),
    )

    def warp(g: Column, m: Column) -> Column:
        height = _height(g, w)

        def value(r: Column, c: Column) -> Column:
            u, v = c / F.greatest(m["wide"] - 1, F.lit(1)), r / F.greatest(m["high"] - 1, F.lit(1))
            depth = m["p"] * u + m["q"] * v + 1
            return _between(g, w, height, (m["d"] * u + m["e"] * v + m["f"]) / depth, (m["a"] * u + m["b"] * v + m["c"]) / depth, F.lit(0.0))

        made = F.struct(_cells(m["high"], m["wide"], value).alias("gray"), m["wide"].alias("width"), m["high"].alias("height"))
        return F.when((m["wide"] > 0) & (m["high"] > 0) & m["p"].isNotNull() & g.isNotNull(), made)

    return bound(terms, lambda m: bound(gray, lambda g: warp(g, m)))


# ------------------------------------------------------------------ light

#: Brightness from which a pixel is glare; clip factor and tiles along a side of the local contrast.
GLARE, CLIP, TILES = 240, 2.5, 8
BINS = 256


def _bin(value: Column) -> Column:
    return F.floor(_byte(value) + 0.5).cast("int")


def _curves(g: Column, w: Column, height: Column, tiles: int, clip: float) -> Column:
    """For each tile the clipped running count of its 256 gray values, its pixels and the excess to spread; null for a tile without
    pixels. Pixels are sorted by tile and value once, so each tile is a slice."""
    part = lambda k, n: F.floor(k * tiles / n).cast("int")
    codes = F.sort_array(F.transform(g, lambda x, i: (part(F.floor(i / w), height) * tiles + part(i % w, w)) * BINS + _bin(x)))
    begin = lambda k, n: F.ceil(k * n / F.lit(tiles)).cast("int")

    def running(kept: Column, area: Column) -> Column:
        first = F.filter(F.transform(kept, lambda x, i: F.when((i == 0) | (F.get(kept, i - 1) != x), F.struct(x.alias("bin"), i.alias("at")))), lambda x: x.isNotNull())

        def counted(first: Column) -> Column:
            of = lambda x, i: F.array_repeat(F.coalesce(F.get(first, i + 1)["at"], F.size(kept)), F.coalesce(F.get(first, i + 1)["bin"], F.lit(BINS)) - x["bin"])
            held = F.concat(F.array_repeat(F.lit(0), F.get(first, F.lit(0))["bin"]), F.flatten(F.transform(first, of)))
            return F.struct(held.alias("held"), area.alias("area"), (area - F.size(kept)).alias("excess"))

        return bound(first, counted)

    def clipped(bins: Column) -> Column:
        most = F.greatest(F.lit(1), F.floor(clip * F.size(bins) / BINS).cast("int"))
        # among sorted values one is past the limit if the value so many places before is the same
        return bound(F.filter(bins, lambda x, i: (i < most) | (F.get(bins, i - most) != x)), lambda kept: running(kept, F.size(bins)))

    def tile(codes: Column, t: Column) -> Column:
        r, c = F.floor(t / tiles).cast("int"), t % tiles
        r0, c0, rows, cols = begin(r, height), begin(c, w), begin(r + 1, height) - begin(r, height), begin(c + 1, w) - begin(c, w)
        return F.when(rows * cols > 0, bound(F.transform(F.slice(codes, r0 * w + rows * c0 + 1, rows * cols), lambda x: x % BINS), clipped))

    return bound(codes, lambda codes: F.transform(F.sequence(F.lit(0), F.lit(tiles * tiles - 1)), lambda t: tile(codes, t)))


def evened(gray: Column, width: Size, tiles: int = TILES, clip: float = CLIP) -> Column:
    """Contrast-limited histogram equalisation over tiles × tiles parts, interpolated between their middles. A gray value's new one is its
    clipped running count and its part of the excess, which is spread evenly, as a share of the tile."""
    w = F.lit(width).cast("int")

    def equalised(g: Column, curves: Column) -> Column:
        height = _height(g, w)

        def mix(p: Column) -> Column:
            r, c, down, right, b = p["r"], p["c"], p["y"] - p["r"], p["x"] - p["c"], p["bin"]

            def at(row: Column, col: Column) -> Column:
                new = lambda k: F.floor((F.get(k["held"], b) + F.floor((b + 1) * k["excess"] / BINS)) * 255 / k["area"] + 0.5).cast("int")
                # small images have no pixel in some tiles: those leave the values as they are
                return F.coalesce(bound(F.get(curves, clamped(row, F.lit(tiles)) * tiles + clamped(col, F.lit(tiles))), new), b)

            top = at(r, c) * (1 - right) + at(r, c + 1) * right
            return top * (1 - down) + (at(r + 1, c) * (1 - right) + at(r + 1, c + 1) * right) * down

        def pixel(x: Column, i: Column) -> Column:
            y, z = (F.floor(i / w) + 0.5) * tiles / height - 0.5, (i % w + 0.5) * tiles / w - 0.5
            place = F.struct(y.alias("y"), z.alias("x"), _bin(x).alias("bin"))
            whole = lambda p: F.struct(p["y"], p["x"], F.floor(p["y"]).cast("int").alias("r"), F.floor(p["x"]).cast("int").alias("c"), p["bin"])
            return bound(bound(place, whole), mix)

        return F.transform(g, pixel)

    return bound(gray, lambda g: F.when(F.size(g) > 0, bound(_curves(g, w, _height(g, w), tiles, clip), lambda k: equalised(g, k))).otherwise(g))


def local_contrast(images: DataFrame, gray_col: str, width: Size, out_col: str, tiles: int = TILES, clip: float = CLIP) -> DataFrame:
    """Adds ``out_col``, the image ``evened``."""
    return images.select(*[f"`{c}`" for c in images.columns if c != out_col], evened(F.col(gray_col), width, tiles, clip).alias(out_col))


def glare_filled(gray: Column, width: Size, most: float = GLARE, steps: int = 60) -> Column:
    """Pixels over ``most`` begin as the mean of the others and are evened out with their neighbours, ``steps`` times; an image of
    nothing else stays as it is."""
    w = F.lit(width)

    def fill(g: Column) -> Column:
        height = _height(g, w)
        dull = F.filter(g, lambda x: x <= most)
        mean = F.aggregate(dull, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(dull), F.lit(0))
        start = bound(mean, lambda m: F.transform(g, lambda x: F.when(x > most, m).otherwise(x).cast("double")))

        def step(now: Column, _: Column) -> Column:
            def pixel(x: Column, i: Column) -> Column:
                r, c = F.floor(i / w).cast("int"), i % w
                near = lambda dr, dc: F.get(now, clamped(r + dr, height) * w + clamped(c + dc, w))
                return F.when(F.get(g, i) > most, (near(-1, 0) + near(1, 0) + near(0, -1) + near(0, 1)) / 4).otherwise(x)

            return F.transform(now, pixel)

        return F.when(any_glare(g) & (F.size(dull) > 0), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)).otherwise(g)

    return bound(gray, fill)


# ------------------------------------------------------------------ edges

#: Spread of the blur, share of the image and of its blur, variance under which an image is blurred.
SIGMA, IMAGE_SHARE, BLUR_SHARE, BLURRED = 3.0, 1.5, -0.5, 100
#: Side of the surroundings, their weight and the range of deviations of the local threshold.
WINDOW, LOCAL_WEIGHT, DEVIATIONS = 51, 0.2, 128.0


def gaussian(sigma: float = SIGMA) -> dict[int, float]:
    """Weights by offset, to three times the spread."""
    raw = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-math.ceil(3 * sigma), math.ceil(3 * sigma) + 1)}
    return {d: v / sum(raw.values()) for d, v in raw.items()}


def smoothed(gray: Column, width: Size, weights: dict[int, float]) -> Column:
    """The weights along rows, then along columns; mirrored at the borders. The weights are looped over, so wide ones cost no plan."""
    w, each = F.lit(width), F.array(*[F.struct(F.lit(d).alias("d"), F.lit(v).alias("w")) for d, v in weights.items()])

    def along(g: Column, read: Callable[[Column, Column, Column, Column], Column]) -> Column:
        height = _height(g, w)
        total = lambda i: F.aggregate(each, F.lit(0.0), lambda s, k: s + k["w"] * read(F.floor(i / w).cast("int"), i % w, k["d"], height))
        return F.transform(g, lambda _, i: total(i))

    rows = bound(gray, lambda g: along(g, lambda r, c, d, _: F.get(g, r * w + mirrored(c + d, w))))
    return bound(rows, lambda g: along(g, lambda r, c, d, height: F.get(g, mirrored(r + d, height) * w + c)))


def sharpened(gray: Column, width: Size, sigma: float = SIGMA) -> Column:
    """One and a half times the image less half its blur, where it is blurred."""

    def sharpen(g: Column) -> Column:
        mixed = F.zip_with(g, smoothed(g, width, gaussian(sigma)), lambda x, b: _byte(IMAGE_SHARE * x + BLUR_SHARE * b))
        return F.when((F.size(g) > 0) & (blur_variance(g, width) < BLURRED), mixed).otherwise(g)

    return bound(gray, sharpen)


def _window_sums(line: Column, half: int) -> Column:
    """Sums over the ``half`` values before and behind each and itself, from running sums; mirrored at the ends, however far."""

    def sums(p: Column) -> Column:
        n = F.size(p) - 1
        period = F.greatest(2 * n - 2, F.lit(1))
        whole = F.get(p, n) + F.when(n > 1, F.get(p, n - 1) - F.get(p, F.lit(1))).otherwise(0.0)

        def until(m: Column) -> Column:
            q = F.pmod(m, period)
            return F.floor(m / period) * whole + F.when(q <= n, F.get(p, q)).otherwise(whole - F.get(p, period - q + 1) + F.get(p, F.lit(1)))

        return F.transform(F.slice(p, F.lit(2), n), lambda _, i: until(i + half + 1) - until(i - half))

    running = F.aggregate(line, F.array(F.lit(0.0)), lambda p, x: F.concat(p, F.array(F.element_at(p, -1) + x)))
    return bound(running, sums)


def averaged(gray: Column, width: Size, window: int) -> Column:
    """The mean over window × window surroundings, mirrored at the borders; its work does not grow with the window."""
    w = F.lit(width)

    def turned(lines: Column) -> Column:
        return bound(lines, lambda a: F.transform(F.get(a, F.lit(0)), lambda _, c: F.transform(a, lambda line: F.get(line, c))))

    def mean(g: Column) -> Column:
        lines = F.transform(F.sequence(F.lit(0), _height(g, w) - 1), lambda r: F.slice(g, r * w + 1, w))
        along = lambda a: F.transform(a, lambda line: _window_sums(line, window // 2))
        sums = F.flatten(turned(along(turned(along(lines)))))
        return F.when(F.size(g) > 0, F.transform(sums, lambda x: x / (2 * (window // 2) + 1) ** 2)).otherwise(g)

    return bound(gray, mean)


def binarized(gray: Column, width: Size, window: int = WINDOW, weight: float = LOCAL_WEIGHT, deviations: float = DEVIATIONS) -> Column:
    """255 where a pixel exceeds its local threshold, mean * (1 + weight * (deviation / deviations - 1)) over its surroundings, else 0."""
    def threshold(mean: Column, square: Column) -> Column:
        deviation = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
        return mean * (1 + weight * (deviation / deviations - 1))

    def cut(g: Column) -> Column:
        limits = F.zip_with(averaged(g, width, window), averaged(F.transform(g, lambda x: x * x), width, window), threshold)
        return F.zip_with(g, limits, lambda x, t: F.when(x > t, 255.0).otherwise(0.0))

    return bound(gray, cut)


def cleaned(images: DataFrame, gray_col: str, width_col: str, angle_col: str | None = None, corners_col: str | None = None, least_width: int = LEAST_WIDTH) -> DataFrame:
    """All steps in their order: size, glare (local contrast and filling, where there is any), skew, page, edges, black and white.

    Images are dealt evenly to tasks, however few files hold them. The image and its width change in place. Where an angle or corners are null, or a step has no result, the image goes on as it was.
    """
    gray, width = F.col(gray_col), F.col(width_col)
    own, spark = images.columns, images.sparkSession
    dealt = images.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sized = dealt.withColumn("_sized", upscaled(gray.cast("array<double>"), width, least_width)).withColumns({gray_col: F.col("_sized.gray"), width_col: F.col("_sized.width")})
    even = local_contrast(sized, gray_col, width, "_even")
    out = even.withColumn(gray_col, F.when(any_glare(gray), glare_filled(F.transform("_even", lambda x: x.cast("double")), width)).otherwise(gray))
    if angle_col:
        out = out.withColumn(gray_col, F.when(F.col(angle_col).isNotNull(), rotated(gray, width, F.col(angle_col))).otherwise(gray))
    if corners_col:
        out = out.withColumn("_page", page_of(gray, width, F.col(corners_col)))
        out = out.withColumns({gray_col: F.coalesce("_page.gray", gray), width_col: F.coalesce("_page.width", width)})
    out = out.withColumn(gray_col, F.coalesce(sharpened(gray, width), gray))
    return out.withColumn(gray_col, F.coalesce(binarized(gray, width), gray)).select(*[f"`{c}`" for c in own])
