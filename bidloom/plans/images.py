"""Queries of image steps, over rasters of eight by eight drawn from the vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels, raster, recognition
from .catalogue import _GRAY, _gray, read, register

SIDE = 8
_G = f"g AS (SELECT vec_id, embedding AS e, {_GRAY} AS g FROM embeddings)"
_CUBIC = """(CASE d WHEN -1 THEN ((-0.75::DOUBLE * (t + 1) + 3.75) * (t + 1) - 6) * (t + 1) + 3 WHEN 0 THEN (1.25::DOUBLE * t - 2.25) * t * t + 1
 WHEN 1 THEN (1.25::DOUBLE * (1 - t) - 2.25) * (1 - t) * (1 - t) + 1 ELSE ((-0.75::DOUBLE * (2 - t) + 3.75) * (2 - t) - 6) * (2 - t) + 3 END)"""
#: A value between four pixels at (y, x), places beyond the borders as the border.
_EDGE = "g[(least(7, greatest(0, floor(y) + {a})) * 8 + least(7, greatest(0, floor(x) + {b})) + 1)::BIGINT]"
_BETWEEN = " + ".join(f"{_EDGE.format(a=a, b=b)} * {'(y - floor(y))' if a else '(1 - (y - floor(y)))'} * {'(x - floor(x))' if b else '(1 - (x - floor(x)))'}" for a in (0, 1) for b in (0, 1))
_MIRROR = "(CASE WHEN ({x} + 56) % 14 >= 8 THEN 14 - ({x} + 56) % 14 ELSE ({x} + 56) % 14 END)"
_LISTED = "string_agg(CAST(floor(v + 0.5) AS INTEGER)::VARCHAR, ',' ORDER BY i)"


def _listed(gray: Column) -> Column:
    """An image as text: its values as integers."""
    return F.array_join(F.transform(gray, lambda x: F.floor(x + 0.5).cast("int").cast("string")), ",")


@register(f"""
WITH {_G}, k AS (SELECT j, d, least(7, greatest(0, floor(p)::INT + d)) AS s, p - floor(p) AS t FROM (SELECT j, (j + 0.5)::DOUBLE * 0.4::DOUBLE - 0.5 AS p FROM range(0, 20) r(j)), (SELECT unnest([-1, 0, 1, 2]) AS d)),
w AS (SELECT j, s, sum({_CUBIC}) AS w FROM k GROUP BY 1, 2), rows AS (SELECT vec_id, r, j, sum(w * g[r * 8 + s + 1]) AS v FROM g, range(0, 8) y(r), w GROUP BY 1, 2, 3),
c AS (SELECT vec_id, w.j * 20 + rows.j AS i, least(255, greatest(0, sum(w.w * v))) AS v FROM rows JOIN w ON w.s = r GROUP BY 1, 2)
SELECT vec_id, 20::INT AS width, {_LISTED} AS pixels FROM c GROUP BY 1""")
def image_upscale(s: SparkSession, d: str) -> DataFrame:
    made = _gray(s, d).select("vec_id", pixels.upscaled(F.col("g"), SIDE, 20).alias("m"))
    return made.select("vec_id", "m.width", _listed(F.col("m.gray")).alias("pixels"))


@register(f"""
WITH {_G}, p AS (SELECT vec_id, g, i, i // 8 - 4 AS r, i % 8 - 4 AS c, cos(radians(e[1]::DOUBLE * 100)) AS k, sin(radians(e[1]::DOUBLE * 100)) AS n FROM g, range(0, 64) t(i)),
q AS (SELECT vec_id, g, i, r * k + c * n + 4 AS y, c * k - r * n + 4 AS x FROM p), v AS (SELECT vec_id, i, {_BETWEEN} AS v FROM q)
SELECT vec_id, {_LISTED} AS pixels FROM v GROUP BY 1""")
def image_turn(s: SparkSession, d: str) -> DataFrame:
    """Each raster turned by an angle of its own."""
    angled = _gray(s, d).join(read(s, d, "embeddings").select("vec_id", (F.get("embedding", F.lit(0)).cast("double") * 100).alias("angle")), "vec_id")
    return angled.select("vec_id", _listed(pixels.rotated(F.col("g"), SIDE, F.col("angle"))).alias("pixels"))


@register(f"""
WITH {_G}, o AS (SELECT vec_id, g, 1 + e[1]::DOUBLE AS x0, 1 + e[2]::DOUBLE AS y0, 6 + e[3]::DOUBLE AS x1, 1 + e[4]::DOUBLE AS y1, 6 + e[5]::DOUBLE AS x2, 6 + e[6]::DOUBLE AS y2, 1 + e[7]::DOUBLE AS x3, 6 + e[8]::DOUBLE AS y3 FROM g),
m AS (SELECT *, floor(greatest(sqrt((x2 - x3) ** 2 + (y2 - y3) ** 2), sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)))::INT AS w, floor(greatest(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2), sqrt((x0 - x3) ** 2 + (y0 - y3) ** 2)))::INT AS h,
  (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS den, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy FROM o),
n AS (SELECT *, (sx * (y3 - y2) - (x3 - x2) * sy) / den AS p, ((x1 - x2) * sy - sx * (y1 - y2)) / den AS q FROM m),
u AS (SELECT *, unnest(range(0, w * h)) AS i FROM n), z AS (SELECT *, (i % w)::DOUBLE / greatest(w - 1, 1) AS a, (i // w)::DOUBLE / greatest(h - 1, 1) AS b FROM u),
l AS (SELECT vec_id, g, w, h, i, ((y1 - y0 + p * y1) * a + (y3 - y0 + q * y3) * b + y0) / (p * a + q * b + 1) AS y, ((x1 - x0 + p * x1) * a + (x3 - x0 + q * x3) * b + x0) / (p * a + q * b + 1) AS x FROM z),
v AS (SELECT vec_id, w, h, i, {_BETWEEN} AS v FROM l)
SELECT vec_id, w AS width, h AS height, {_LISTED} AS pixels FROM v GROUP BY 1, 2, 3""")
def page_rectangle(s: SparkSession, d: str) -> DataFrame:
    """A quadrilateral within each raster made a rectangle; its corners lie inside, so nothing beyond the borders is read."""
    at = lambda k, base: base + F.get("embedding", F.lit(k)).cast("double")
    corners = F.array(*[F.struct(at(k, x).alias("x"), at(k + 1, y).alias("y")) for k, x, y in ((0, 1, 1), (2, 6, 1), (4, 6, 6), (6, 1, 6))])
    quads = _gray(s, d).join(read(s, d, "embeddings").select("vec_id", corners.alias("corners")), "vec_id")
    made = quads.select("vec_id", pixels.page_of(F.col("g"), SIDE, F.col("corners")).alias("m"))
    return made.select("vec_id", "m.width", "m.height", _listed(F.col("m.gray")).alias("pixels"))


@register(f"""
WITH {_G}, p AS (SELECT vec_id, i, i // 8 AS r, i % 8 AS c, floor(g[i + 1] + 0.5)::INT AS b FROM g, range(0, 64) t(i)), n AS (SELECT vec_id, r // 4 AS tr, c // 4 AS tc, b, count(*) AS n FROM p GROUP BY ALL),
e AS (SELECT vec_id, tr, tc, sum(n - 1) AS excess FROM n GROUP BY ALL),
q AS (SELECT *, (r + 0.5)::DOUBLE * 0.25 - 0.5 AS y, (c + 0.5)::DOUBLE * 0.25 - 0.5 AS x FROM p),
f AS (SELECT vec_id, i, b, least(1, greatest(0, floor(y)::INT + dy)) AS tr, least(1, greatest(0, floor(x)::INT + dx)) AS tc,
  sum((CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END)) AS w FROM q, range(0, 2) a(dy), range(0, 2) o(dx) GROUP BY ALL),
k AS (SELECT f.vec_id, f.i, f.b, f.tr, f.tc, f.w, count(n.n) AS held FROM f LEFT JOIN n ON n.vec_id = f.vec_id AND n.tr = f.tr AND n.tc = f.tc AND n.b <= f.b GROUP BY ALL),
v AS (SELECT vec_id, i, sum(w * floor((held + (b + 1) * excess::BIGINT // 256)::DOUBLE * 255 / 16 + 0.5)) AS v FROM k JOIN e USING (vec_id, tr, tc) GROUP BY 1, 2)
SELECT vec_id, {_LISTED} AS pixels FROM v GROUP BY 1""")
def image_contrast(s: SparkSession, d: str) -> DataFrame:
    """Local contrast over two by two tiles of sixteen pixels; so few that every gray value is clipped to one."""
    return pixels.local_contrast(_gray(s, d), "g", SIDE, "even", tiles=2).select("vec_id", _listed(F.col("even")).alias("pixels"))


_NEAR = " + ".join(f"g[{x}]" for x in ("greatest(i // 8 - 1, 0) * 8 + i % 8 + 1", "least(i // 8 + 1, 7) * 8 + i % 8 + 1", "i // 8 * 8 + greatest(i % 8 - 1, 0) + 1", "i // 8 * 8 + least(i % 8 + 1, 7) + 1"))


@register(f"""
WITH RECURSIVE s(vec_id, n, m, g) AS (
  SELECT vec_id, 0, g, list_transform(g, lambda x: CASE WHEN x > 240 AND len(list_filter(g, lambda y: y <= 240)) > 0 THEN list_avg(list_filter(g, lambda y: y <= 240)) ELSE x END) FROM (SELECT vec_id, {_GRAY} AS g FROM embeddings)
  UNION ALL SELECT vec_id, n + 1, m, list_transform(range(0, 64), lambda i: CASE WHEN m[i + 1] > 240 THEN ({_NEAR}) / 4 ELSE g[i + 1] END) FROM s WHERE n < 60)
SELECT vec_id, array_to_string(list_transform(g, lambda x: CAST(floor(x + 0.5) AS INTEGER)::VARCHAR), ',') AS pixels FROM s WHERE n = 60""")
def glare_fill(s: SparkSession, d: str) -> DataFrame:
    return _gray(s, d).select("vec_id", _listed(pixels.glare_filled(F.col("g"), SIDE)).alias("pixels"))


_FADED = f"(SELECT vec_id, list_transform({_GRAY}, lambda x: CASE WHEN vec_id % 2 = 0 THEN 128 + (x - 128) * 0.05::DOUBLE ELSE x END) AS g FROM embeddings)"


def _faded(s: SparkSession, d: str) -> DataFrame:
    """Every other raster with little contrast."""
    return _gray(s, d).withColumn("g", F.when(F.col("vec_id") % 2 == 0, F.transform("g", lambda x: 128 + (x - 128) * 0.05)).otherwise(F.col("g")))


def _smooth_sql(weights: str, value: str) -> str:
    """CTEs that end in b(vec_id, i, v): the weights w(s, t, w) from place s to place t of eight, along rows and columns."""
    return f"""w AS ({weights}), h AS (SELECT vec_id, r, t AS c, sum(w * {value}) AS v FROM g, range(0, 8) y(r), w GROUP BY 1, 2, 3), b AS (SELECT vec_id, t * 8 + c AS i, sum(w * v) AS v FROM h JOIN w ON s = r GROUP BY 1, 2)"""


_GAUSS = f"SELECT {_MIRROR.format(x='t + d')} AS s, t, sum(exp(-d * d / 18.0::DOUBLE)) / (SELECT sum(exp(-k * k / 18.0::DOUBLE)) FROM range(-9, 10) z(k)) AS w FROM range(0, 8) y(t), range(-9, 10) x(d) GROUP BY 1, 2"
_BOX = f"SELECT {_MIRROR.format(x='t + d')} AS s, t, count(*) / 51.0::DOUBLE AS w FROM range(0, 8) y(t), range(-25, 26) x(d) GROUP BY 1, 2"


@register(f"""
WITH g AS {_FADED}, {_smooth_sql(_GAUSS, "g[r * 8 + s + 1]")},
l AS (SELECT vec_id, g[(CASE i // 8 WHEN 0 THEN 1 ELSE i // 8 - 1 END) * 8 + i % 8 + 1] + g[(CASE i // 8 WHEN 7 THEN 6 ELSE i // 8 + 1 END) * 8 + i % 8 + 1] + g[i // 8 * 8 + (CASE i % 8 WHEN 0 THEN 1 ELSE i % 8 - 1 END) + 1]
  + g[i // 8 * 8 + (CASE i % 8 WHEN 7 THEN 6 ELSE i % 8 + 1 END) + 1] - 4 * g[i + 1] AS x FROM g, range(0, 64) t(i)), blur AS (SELECT vec_id, var_pop(x) < 100 AS blurred FROM l GROUP BY 1),
v AS (SELECT vec_id, i, blurred, CASE WHEN blurred THEN least(255, greatest(0, 1.5 * g[i + 1] - 0.5 * b.v)) ELSE g[i + 1] END AS v FROM b JOIN g USING (vec_id) JOIN blur USING (vec_id))
SELECT vec_id, blurred, {_LISTED} AS pixels FROM v GROUP BY 1, 2""")
def image_sharpen(s: SparkSession, d: str) -> DataFrame:
    g = F.col("g")
    return _faded(s, d).select("vec_id", (raster.blur_variance(g, SIDE) < pixels.BLURRED).alias("blurred"), _listed(pixels.sharpened(g, SIDE)).alias("pixels"))


@register(f"""
WITH g AS {_FADED}, {_smooth_sql(_BOX, "g[r * 8 + s + 1]")}, h2 AS (SELECT vec_id, r, t AS c, sum(w * g[r * 8 + s + 1] * g[r * 8 + s + 1]) AS v FROM g, range(0, 8) y(r), w GROUP BY 1, 2, 3),
q AS (SELECT vec_id, t * 8 + c AS i, sum(w * v) AS v FROM h2 JOIN w ON s = r GROUP BY 1, 2),
v AS (SELECT vec_id, i, CASE WHEN g[i + 1] > b.v * (1 + 0.2::DOUBLE * (sqrt(greatest(q.v - b.v * b.v, 0)) / 128 - 1)) THEN 255 ELSE 0 END AS v FROM b JOIN q USING (vec_id, i) JOIN g USING (vec_id))
SELECT vec_id, {_LISTED} AS pixels FROM v GROUP BY 1""")
def image_binarize(s: SparkSession, d: str) -> DataFrame:
    return _faded(s, d).select("vec_id", _listed(pixels.binarized(F.col("g"), SIDE)).alias("pixels"))


@register(f"""
WITH {_G}, m AS (SELECT vec_id, len(list_filter(g, lambda x: x > 240)) / len(g) AS bright, list_stddev_pop(g) AS spread, list_avg(list_transform(range(0, 16), lambda i: CASE WHEN e[4 * i + 3] <> e[4 * i + 1] THEN
  abs((e[4 * i + 4]::DOUBLE - e[4 * i + 2]::DOUBLE) / (e[4 * i + 3]::DOUBLE - e[4 * i + 1]::DOUBLE)) END)) / 20 AS slope FROM g)
SELECT vec_id, round(slope, 6) AS slope, CASE WHEN bright > 0.15 THEN 'image_photo_glare' WHEN slope > 0.15 THEN 'image_skewed' WHEN spread < 60 THEN 'image_scan' ELSE 'image_photo' END AS class,
 CASE WHEN bright > 0.15 THEN 0.85 WHEN slope > 0.15 THEN 0.8 WHEN spread < 60 THEN 0.8 ELSE 0.75 END::DOUBLE AS confidence FROM m""")
def image_classes(s: SparkSession, d: str) -> DataFrame:
    """Rasters classed by brightness, spread and the mean slope of sixteen lines, a twentieth as steep as the vectors give them."""
    at = lambda i, k: F.get("embedding", 4 * i + k).cast("double")
    slopes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: raster.slope(at(i, 0), at(i, 1), at(i, 2), at(i, 3))), lambda x: x.isNotNull())
    mean = F.aggregate(slopes, F.lit(0.0), lambda n, x: n + x) / F.size(slopes) / 20
    rasters = _gray(s, d).join(read(s, d, "embeddings").select("vec_id", mean.alias("slope")), "vec_id")
    kind = recognition.document_type(F.lit("scan.png"), F.lit("image/png"), F.lit(None).cast("double"), raster.bright_ratio(F.col("g")), F.col("slope"), raster.spread(F.col("g")))
    return rasters.select("vec_id", F.round("slope", 6).alias("slope"), kind.alias("k")).select("vec_id", "slope", F.col("k.doc_type").alias("class"), "k.confidence")


@register()
def images_cleaned(s: SparkSession, d: str) -> DataFrame:
    """All steps in their order; the rasters of even ids have an angle, those of every third id have corners."""
    at = lambda k, base: base + F.get("embedding", F.lit(k)).cast("double") * 3
    corners = F.array(*[F.struct(at(k, x).alias("x"), at(k + 1, y).alias("y")) for k, x, y in ((0, 2, 2), (2, 9, 2), (4, 9, 9), (6, 2, 9))])
    own = read(s, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.get("embedding", F.lit(9)).cast("double") * 100).alias("angle"), F.when(F.col("vec_id") % 3 == 0, corners).alias("corners"))
    images = _gray(s, d).join(own, "vec_id").withColumn("width", F.lit(SIDE))
    done = pixels.cleaned(images, "g", "width", "angle", "corners", least_width=12)
    return done.select("vec_id", "width", (F.size("g") / F.col("width")).cast("int").alias("height"), F.size(F.filter("g", lambda x: x > 0)).alias("n_white"), _listed(F.col("g")).alias("pixels"))
