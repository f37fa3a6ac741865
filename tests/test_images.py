"""Image steps against plain numpy, on rasters larger than those of the queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidloom.operators import pixels, raster


def _raster(h, w, seed=3):
    return np.random.default_rng(seed).uniform(0, 255, (h, w))


def _frame(spark, *images):
    return spark.createDataFrame([(None if g is None else np.asarray(g, float).ravel().tolist(), w) for g, w in images], "g array<double>, w int")


def _contrast(img, tiles, clip):
    h, w = img.shape
    bins = np.floor(img + 0.5).astype(int)
    rows, cols = np.arange(h) * tiles // h, np.arange(w) * tiles // w
    curves = {}
    for a in range(tiles):
        for b in range(tiles):
            part = bins[np.ix_(rows == a, cols == b)].ravel()
            if part.size:
                n = np.bincount(part, minlength=256)
                limit = max(1, int(clip * part.size // 256))
                excess = int(np.maximum(n - limit, 0).sum())
                share = np.minimum(n, limit).cumsum() + (np.arange(1, 257) * excess) // 256
                curves[a, b] = np.floor(share * 255 / part.size + 0.5)
    out = np.zeros((h, w))
    for r in range(h):
        for c in range(w):
            y, x = (r + 0.5) * tiles / h - 0.5, (c + 0.5) * tiles / w - 0.5
            for a in (0, 1):
                for b in (0, 1):
                    fy, fx = y - np.floor(y), x - np.floor(x)
                    at = tuple(int(min(tiles - 1, max(0, np.floor(p) + k))) for p, k in ((y, a), (x, b)))
                    out[r, c] += (fy if a else 1 - fy) * (fx if b else 1 - fx) * (curves[at][bins[r, c]] if at in curves else bins[r, c])
    return out


def test_local_contrast(spark):
    a, b = _raster(30, 41), np.round(_raster(60, 50, 5) / 40) * 40
    got = pixels.local_contrast(_frame(spark, (a, 41), (b, 50), (a, 41), (None, 3), ([], 3), (_raster(2, 3), 3)), "g", F.col("w"), "o", tiles=4).collect()
    assert len(got) == 6
    for row in got:
        if not row["g"]:
            assert row["o"] == row["g"]
            continue
        img = np.array(row["g"]).reshape(-1, row["w"])
        assert np.allclose(np.array(row["o"]).reshape(img.shape), _contrast(img, 4, 2.5))


def test_steps_against_numpy(spark):
    img = _raster(13, 17)
    img[4:6, 5:9] = 250
    soft = 100 + img / 100
    g, w = F.col("g"), F.col("w")
    steps = [pixels.glare_filled(g, w).alias("filled"), pixels.binarized(g, w, 9).alias("cut"), pixels.sharpened(g, w).alias("sharp"), pixels.upscaled(g, w, 34).alias("up"), pixels.rotated(g, w, F.lit(90.0)).alias("turned")]
    hard, pale, none, empty = _frame(spark, (img, 17), (soft, 17), (None, 4), ([], 4)).select(*steps).collect()
    assert np.allclose(np.array(hard["filled"]).reshape(img.shape), raster.remove_glare(img))
    assert pale["filled"] == pytest.approx(soft.ravel().tolist())
    assert np.array_equal(np.array(hard["cut"]).reshape(img.shape), raster.sauvola(img, 9))
    cut = _frame(spark, (img[:, :1], 1), (img[:1], 17), (img, 17)).select(pixels.averaged(g, w, 51)).collect()
    for got, part in zip(cut, (img[:, :1], img[:1], img), strict=True):
        wide = np.pad(part, 25, mode="reflect")
        assert np.allclose(np.array(got[0]).reshape(part.shape), [[wide[r : r + 51, c : c + 51].mean() for c in range(part.shape[1])] for r in range(part.shape[0])])
    assert hard["sharp"] == pytest.approx(img.ravel().tolist())
    k = np.array(list(pixels.gaussian().values()))
    padded = np.pad(soft, 9, mode="reflect")
    blur = sum(k[i] * k[j] * padded[i : i + 13, j : j + 17] for i in range(19) for j in range(19))
    assert np.allclose(np.array(pale["sharp"]).reshape(soft.shape), 1.5 * soft - 0.5 * blur)
    assert hard["up"]["width"] == 34 and len(hard["up"]["gray"]) == 34 * 26
    turned = np.array(hard["turned"]).reshape(img.shape)
    assert turned[6, 8] == pytest.approx(img[6, 8]) and turned[6 - 2, 8] == pytest.approx(img[6, 8 + 2])
    assert none["filled"] is None and none["cut"] is None and none["sharp"] is None and none["up"]["gray"] is None and none["turned"] is None
    assert empty["filled"] == [] and empty["cut"] == [] and empty["sharp"] == [] and empty["up"]["gray"] == [] and empty["turned"] == []


def test_page_of(spark):
    img = _raster(20, 30)
    corner = lambda *xy: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in xy])
    square, point, tilted = corner((3, 2), (12, 2), (12, 8), (3, 8)), corner((3, 2), (3, 2), (3, 2), (3, 2)), corner((2, 3), (25, 1), (28, 18), (4, 15))
    g, w = F.col("g"), F.col("w")
    row, none = _frame(spark, (img, 30), (None, 30)).select(pixels.page_of(g, w, square).alias("s"), pixels.page_of(g, w, point).alias("p"), pixels.page_of(g, w, tilted).alias("t")).collect()
    assert (row["s"]["width"], row["s"]["height"]) == (9, 6) and row["p"] is None and none["s"] is None
    assert row["s"]["gray"][0] == pytest.approx(img[2, 3]) and row["s"]["gray"][-1] == pytest.approx(img[8, 12])
    # against the map that a linear solve finds
    wide, high = row["t"]["width"], row["t"]["height"]
    to = raster.homography(np.array([[0, 0], [wide - 1, 0], [wide - 1, high - 1], [0, high - 1]]), np.array([[2, 3], [25, 1], [28, 18], [4, 15]]))
    for r, c in ((0, 0), (high - 1, wide - 1), (5, 7), (high // 2, wide // 3)):
        x, y, z = to @ np.array([c, r, 1.0])
        x, y = x / z, y / z
        a, b = int(y + 1e-9), int(x + 1e-9)
        want = sum(img[min(a + i, 19), min(b + j, 29)] * (y - a if i else 1 - y + a) * (x - b if j else 1 - x + b) for i in (0, 1) for j in (0, 1))
        assert row["t"]["gray"][r * wide + c] == pytest.approx(want, abs=1e-6)


def test_cleaned_in_order(spark):
    img = _raster(12, 16)
    frame = _frame(spark, (img, 16), (img, 16), (None, 16)).withColumn("angle", F.lit(None).cast("double")).withColumn("corners", F.lit(None).cast("array<struct<x:double,y:double>>"))
    rows = pixels.cleaned(frame, "g", "w", "angle", "corners", least_width=16).collect()
    even = _contrast(img, 8, 2.5)
    filled = np.array(_frame(spark, (even, 16)).select(pixels.glare_filled(F.col("g"), 16).alias("g")).first()[0]).reshape(12, 16)
    want = np.array(_frame(spark, (filled, 16)).select(pixels.binarized(F.col("g"), 16).alias("g")).first()[0])
    assert sorted(r["g"] is None for r in rows) == [False, False, True]
    for r in rows:
        assert r["w"] == 16 and (r["g"] is None or np.array_equal(np.array(r["g"]), want))


def test_cleaned_deals_images_once(spark):
    """One shuffle, which deals the images of a single file to all tasks; local contrast adds none."""
    frame = spark.createDataFrame([(i, [float(x) for x in range(64)], 8) for i in range(20)], "id long, g array<double>, w int").coalesce(1)
    assert "Exchange" not in pixels.local_contrast(frame, "g", 8, "e")._jdf.queryExecution().executedPlan().toString()
    plan = pixels.cleaned(frame, "g", "w", least_width=10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "RoundRobinPartitioning" in plan


def test_workbook_cells_with_repeated_and_null_ids(spark):
    from bidloom.sources import exports

    rows = spark.range(3).select(F.when(F.col("id") < 2, 7).alias("job"), F.col("id"))
    empty = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    text = ("nha_cung_cap", "so_bao_gia", "ngay_bao_gia", "khach_hang", "don_vi_tien", "dieu_kien_thanh_toan", "thoi_gian_giao_hang", "bao_hanh")
    money = [F.lit(None).cast("double").alias(n) for n in ("tong_chua_vat", "thue_vat_tien", "tong_sau_vat", "thue_vat_pct")]
    item = F.from_json(F.concat(F.lit('{"ten_sp": "a & b", "confidence": 0.5, "so_luong": '), F.col("id").cast("string"), F.lit("}")), "ma_sp string, stt int, ten_sp string, dvt string, so_luong double, don_gia double, thanh_tien double, chiet_khau_pct double, ghi_chu string, confidence double")
    docs = rows.select("job", *empty(*text), *money, F.array(item).alias("items"))
    cells = exports.workbook_cells(exports.workbooks(docs, "job"), "job").where("sheet = 'Bảng Giá' AND row = 2").collect()
    found = sorted((r["job"] or 0, r["col"], r["value"]) for r in cells if r["col"] in (1, 3, 5, 10))
    assert found == sorted((j, c, v) for j, n in ((7, "0.0"), (7, "1.0"), (0, "2.0")) for c, v in ((1, "1"), (3, "a & b"), (5, n), (10, "50%")))
    assert exports.workbook_cells(exports.workbooks(docs.limit(0), "job"), "job").count() == 0


def test_sheets_made_and_read_for_many_documents_at_once():
    import io
    import zipfile
    from xml.etree.ElementTree import ParseError

    import pyarrow as pa

    from bidloom.sources import exports

    names = ("stt", "ma_sp", "ten_sp", "dvt", "so_luong", "don_gia", "chiet_khau_pct", "thanh_tien", "ghi_chu", "confidence")
    kinds = (pa.int32(), *[pa.string()] * 3, *[pa.float64()] * 4, pa.string(), pa.float64())
    items = [
        (None, None, "a <b> & \"c\"", "", 1.0, 1e16, None, 0.1, " x ", 0.125), (0, "Mã", "x" * 80, "kg", None, None, None, None, "&lt;", 1.0),
        (7, "", "dòng 1\ndòng 2 😀", None, -0.0, 1e-7, 2.5, float("inf"), None, 0.0), (3, "m", "]]>", "cái", 12345678.25, 2.0, 1.0, float("nan"), "'", 0.995),
    ]
    starts = np.array([0, 1, 4, 6])
    items += [items[1], items[3]]
    fields = {n: pa.array([x[k] for x in items], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))}
    lines = [("Nhà cung cấp", None), ("Thuế VAT (10%)", "<&>"), ("x", "")] * 3
    told = {"label": pa.array([a for a, _ in lines]), "value": pa.array([b for _, b in lines], pa.string())}
    made = list(zip(exports._item_sheets(fields, starts), exports._summary_sheets(told, np.array([0, 3, 6, 9])), strict=True))
    for (a, b), pair in zip(zip(starts, starts[1:], strict=False), made, strict=True):
        cells = [(x[0] or k, *x[1:9], f"{x[9]:.0%}") for k, x in enumerate(items[a:b], 1)]
        file = io.BytesIO()
        exports.write_xlsx(file, [("1", [exports.SHEET_COLUMNS, *cells]), ("2", [("Thông tin", "Giá trị"), *lines[:3]])])
        with zipfile.ZipFile(file) as z:
            assert [z.read(f"xl/worksheets/sheet{i}.xml") for i in (1, 2)] == list(pair)
        texts, lengths = exports._plain_cells(pair[0])
        assert lengths == [10] * (1 + b - a) and texts[10:] == ["" if v is None else str(v) for row in cells for v in row]
        parsed = pair[0].replace(b"<cols>", b"<cols><!-- not plain -->")
        assert exports._plain_cells(parsed) is None and exports._sheet_cells(parsed) == (texts, lengths)
    sheet = made[0][0]
    for was, now in ((b"</v>", b"</t></is>"), (b"</row>", b""), (b"</c>", b"</c>\0"), (b"Th", b"<Th"), (b"<v>", b"<v><b>")):
        assert was in sheet and exports._plain_cells(sheet.replace(was, now, 1)) is None
        with pytest.raises(ParseError):
            exports._sheet_cells(sheet.replace(was, now, 1))
