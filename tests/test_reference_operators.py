"""Unit vectors of the tag operators, and every query against its DuckDB twin."""

from __future__ import annotations

import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tagforge.functions import geometry, pixels, similarity, text
from tagforge.operators import fields, images, ocr, pipeline, records, sampling, tracks
from tagforge.plans import registry
from tagforge.sources import tables
from tagforge.streaming import detections

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [
    ("319.99", "319.99"), ("319,99", "319.99"), ("319 99", "319.99"), ("319 99", "319.99"), ("319", "319.00"), ("5", ""), ("1234567.89", "234567.89"), ("1234567", ""), ("12.345", "12.00"),
    ("500г", ""), ('599"', "599.00"), ("Фитнес 230 359", "230.00"), ("12 345.67", "345.67"), ("19,9 20", "9.20"), ("7 99", "7.99"), (None, ""),
])
def test_extract_price(spark, given, want):
    assert one(spark, text.extract_price(F.lit(given))) == want


def test_parse_code(spark):
    full = lambda s: {k: v for k, v in one(spark, text.parse_code(F.lit(s))).asDict().items() if v}
    assert full("barcode=4601;p1=10.5;PRICE1=11;junk;ap=a=b; ac = Z ;x=1") == {"qr_code_barcode": "4601", "price1_qr": "11", "action_price_qr": "a=b", "action_code_qr": "Z"}
    assert full("price1=5;p1=") == full("") == full(None) == {}
    assert text.parse_code is not None and full(" p2 =\n7 ;p3=a\nb") == {"price2_qr": "7", "price3_qr": "a\nb"}


def line(t, x, y, h=10):
    return f"struct(array(array({x - 5}D, {y - h / 2}D), array({x + 5}D, {y - h / 2}D), array({x + 5}D, {y + h / 2}D), array({x - 5}D, {y + h / 2}D)) as bbox, '{t}' as text)"


@pytest.mark.parametrize(("color", "lines", "code_bottom", "on", "want"), [
    ("red", [("Мед", 50, 20), ("599", 150, 40), ("-30", 50, 80), ("469 99", 150, 80)], None, True, ("Мед", "599.99", "469.99", "-30%")),
    ("red", [("Мед", 50, 20), ("599", 150, 40), ("-30", 50, 80), ("469 99", 150, 80)], None, False, ("Мед", "599.00", "469.99", "-30%")),
    ("red", [("599", 150, 40), ("319@", 50, 80)], None, True, ("", "599.99", "-319", "")),
    ("red", [("368", 150, 40), ("469 99", 150, 80)], None, True, ("", "", "469.99", "")),
    ("red", [("25%", 50, 80)], None, True, ("", "", "", "-25%")),
    ("red", [("100", 150, 70), ("200", 150, 85)], None, True, ("", "", "100.99", "")),
    ("red", [("100", 150, 70), ("200", 150, 85, 20)], None, True, ("", "", "200.99", "")),
    ("red", [("111", 150, 20), ("222", 150, 40)], 30, True, ("", "222.99", "", "")),
    ("red", [("111", 150, 20), ("222", 150, 40)], 54, True, ("", "111.99", "", "")),
    ("red", [("599", 150, 55)], None, True, ("", "", "599.99", "")),
    ("yellow", [("469", 50, 20), ("99", 50, 40)], None, True, ("469 99", "469.99", "", "")),
    ("unknown", [], None, True, ("", "", "", "")),
    ("red", [("a 9" + "9" * 45, 50, 80)], None, True, ("", "", "-9" + "9" * 45, "")),
])
def test_parse_fields(spark, color, lines, code_bottom, on, want):
    array = f"array({', '.join(line(*x) for x in lines)})" if lines else "cast(array() as array<struct<bbox:array<array<double>>,text:string>>)"
    box = F.expr(f"array(array(1D, 2D), array(3D, {code_bottom}D))") if code_bottom else F.lit(None).cast("array<array<double>>")
    got = one(spark, fields.parse_fields(F.expr(array), box, F.lit(color), F.lit(200), F.lit(100), on))
    assert (got.product_name, got.price_default, got.price_discount, got.discount_amount) == want and got.price_card == ""


def test_tracks(spark):
    boxes = spark.createDataFrame([(7, 3, 0, 0.5, 10.0), (7, 1, 0, 0.5, 10.0), (7, 2, 0, 0.4, 9.0), (8, 1, 1, 0.2, 99.0), (None, 1, 2, 0.9, 9.0), (9, 1, 4, 0.9, None), (9, 4, 0, 0.3, 1.0)], "track_id long, frame_idx long, box_idx int, conf double, sharpness double")
    best = tracks.track_best(boxes)
    assert {(r.track_id, r.frame_idx) for r in best.collect()} == {(7, 1), (9, 4)}
    assert [(r.frame_idx, r.tracks) for r in tracks.frame_tracks(best, 30.0).orderBy("frame_idx").collect()] == [(1, [7]), (4, [9])]
    assert tracks.track_best(boxes.limit(0)).count() == 0
    assert one(spark, geometry.frame_ms(F.lit(61), F.lit(29.97))) == 2035 and one(spark, geometry.frame_ms(F.lit(3), F.lit(0.0))) == 120
    frames = spark.createDataFrame([(1, i, v, v) for i, v in enumerate([5.0, 30.0, 35.0, 45.0, 41.0, 100.0])] + [(1, 9, None, 3.0)], "video long, frame_idx long, sharpness double, signal double")
    assert sampling.sample_frames(frames, 20, 10, 5).first().kept == [1, 3, 5] and sampling.sample_frames(frames, 20, 10, 2).first().kept == [1, 3]
    log = spark.createDataFrame([("t", i, v) for i, v in enumerate([0.0, 0.3, 0.2, 0.3, 0.55])] + [("t", 9, None)], "task_id string, seq long, fraction double")
    assert [r.fraction for r in tracks.monotone_progress(log).orderBy("seq").collect()] == [0, 0.3, 0.3, 0.55]


def test_geometry(spark):
    box = geometry.corners(F.lit(-3.7), F.lit(1), F.lit(5.2), F.lit(51))
    assert tuple(one(spark, geometry.bounding_box(box))) == (-3, 1, 5, 51)
    size = one(spark, geometry.upright_size(box))
    assert (size.w, size.h) == (8, 50) and not one(spark, geometry.usable(geometry.upright_size(box)))
    point = F.array(F.array(F.lit(3.0), F.lit(2.0)))
    assert [one(spark, geometry.turned(point, F.lit(k), F.lit(10), F.lit(20))) for k in range(4)] == [[[3, 2]], [[7, 3]], [[16, 7]], [[2, 16]]]
    assert one(spark, geometry.upright_points(point, F.lit(20), F.lit(10))) == [[2, 6]] and one(spark, geometry.upright_points(point, F.lit(10), F.lit(20))) == [[3, 2]]


def test_colors(spark):
    red, yellow, other = (0, 0, 200), (0, 200, 200), (200, 200, 200)
    cases = {1: (5, 0), 2: (6, 0), 3: (6, 50), 4: (0, 6)}
    rows = [(i, *p) for i, (r, y) in cases.items() for p in [red] * r + [yellow] * y + [other] * (100 - r - y)]
    out = {r.image_id: r.color for r in images.tag_color(spark.createDataFrame(rows, "image_id long, b int, g int, r int")).collect()}
    assert out == {1: "unknown", 2: "red", 3: "red", 4: "yellow"}


def test_grids(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    g = rng.integers(0, 255, (5, 7)).astype(float)
    m = np.pad(g, 1, mode="reflect")
    edges = m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:] - 4 * g
    flat = F.array(*map(F.lit, g.ravel().tolist()))
    assert math.isclose(one(spark, pixels.sharpness(flat, 5, 7)), edges.var()) and one(spark, pixels.sharpness(flat, 5, 6)) is None
    same = images.consecutive_similarity(spark.createDataFrame([(1, [1.0, 9.0]), (2, [1.0, 9.0]), (4, [1.0, 9.0])], "i long, g array<double>"), "i", "g").collect()
    assert [(r.i, round(r.similarity, 9)) for r in same] == [(2, 1.0)]
    # colored pixels at the left: a quarter clockwise turns them up, three quarters down
    rows = [(1, 4, 6, y, x, x < 3) for y in range(4) for x in range(6)] + [(2, 2, 2, y, x, y < 1) for y in range(2) for x in range(2)]
    out = {r.image_id: (r.quarters, r.score) for r in images.best_turn(spark.createDataFrame(rows, "image_id long, h int, w int, y int, x int, colored boolean")).collect()}
    assert out == {1: (3, 1.0), 2: (0, 0.0)}


def test_records_round_trip(spark, tmp_path):
    out = registry.QUERIES["q17_record"](spark, SF)
    assert out.columns == records.COLUMNS and len(out.columns) == 31
    odd = out.limit(3).withColumn("raw_text", F.lit('a "b", \\ c'))
    tables.write_results(odd, f"{tmp_path}/csv")
    back = tables.read_results(spark, f"{tmp_path}/csv")
    assert sorted(map(str, back.collect())) == sorted(map(str, odd.withColumn("frame_timestamp", F.col("frame_timestamp").cast("long")).collect()))
    html = [r.value for r in tables.html_rows(odd.withColumn("raw_text", F.lit("<b>"))).collect()]
    assert len(html) == 3 and all("&lt;b&gt;" in x and "<b>" not in x and "<td>-</td>" in x for x in html)
    frames = spark.createDataFrame([("v", 5, [{"track_id": 1}, {"track_id": 2}]), ("v", 6, [])], "video string, timestamp_ms long, price_tags array<struct<track_id:long>>")
    assert [(r.tag_ord, r.track_id) for r in records.explode_tags(frames).collect()] == [(0, 1), (1, 2)]


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text('filename,price_card,price1_qr,discount_amount,wholesale_level_1_coun,x_min,code\r\n"v ","415,79",415.79,-23%,нет,"3194,5",нет')
    row = tables.read_labels(spark, f"{tmp_path}/l.csv").first()
    assert (row.filename, str(row.price_card), str(row.price1_qr), row.discount_amount, row.wholesale_level_1_count, row.x_min, row.code) == ("v", "415.79", "415.79", -23, None, 3194.5, None)


def test_strip_and_separators(spark):
    assert one(spark, text.strip(F.lit("\x1c \x1f\u00a0a b\x85\x1d"))) == "\x1c \x1f\u00a0a b\x85\x1d".strip() == "a b"
    assert one(spark, text.extract_price(F.lit("319\x1f99"))) == "319.99"
    codes = one(spark, text.parse_code(F.lit("p1=2&p1=&P2 = 7&ap=a;b"), "&"))
    assert (codes.price1_qr, codes.price2_qr, codes.action_price_qr) == ("", "7", "a;b")
    assert one(spark, text.parse_code(F.lit("p1=2|p2=3"), "|")).price2_qr == "3"


@pytest.mark.parametrize("raw", [b"abc", b"a\xffb", b"\xd0\x96\xd0", b"\xef\xbf\xbd!\xf0\x9f\x98", b"", b"\xe2\x28\xa1", "жёлтый".encode("cp1251"), b"\xed\xa0\x80x", "\ue000\ufdd0\ue001".encode(), "\ue0001\ufffd\ue0000\ue000".encode() + b"\xee\x80"])
def test_decoded(spark, raw):
    assert one(spark, text.decoded(F.lit(raw))) == raw.decode("utf-8", "ignore")


def test_names(spark):
    assert one(spark, text.frame_name(F.lit(40))) == "frame_000040.png" and one(spark, text.frame_name(F.lit(1234567))) == "frame_1234567.png"
    assert [one(spark, text.frame_name(F.lit(7), F.lit(x))) for x in (2.5, 3.5, 100.4)] == [f"frame_{7:06d}_quality={x:.0f}.png" for x in (2.5, 3.5, 100.4)]
    assert one(spark, text.crop_path("a/100%/", F.lit(40), F.lit(2), F.lit(True))) == "a/100%/warped_40_2.png" and one(spark, text.crop_path("a", F.lit(1), F.lit(0), F.lit(False))) == ""
    assert one(spark, text.overlay(F.lit("x" * 30))) == "x" * 20
    assert one(spark, geometry.frame_rate(F.lit(0.0))) == one(spark, geometry.frame_rate(F.lit(None))) == 30 and one(spark, geometry.frame_rate(F.lit(25.0))) == 25


def test_ocr_forms(spark):
    box = "array(array(1D, 2D), array(3D, 2D), array(3D, 4D), array(1D, 4D))"
    found = one(spark, ocr.lines_of_lists(F.expr("array('a', 'b', 'c')"), F.expr("array(0.5D, 0.25D)"), F.expr(f"array({box})")))
    assert [(x.text, x.conf, x.bbox[2]) for x in found] == [("a", 0.5, [3, 4]), ("b", 0.25, [0, 0]), ("c", 0.0, [0, 0])]
    assert one(spark, ocr.lines_of_lists(F.lit(None).cast("array<string>"), F.lit(None).cast("array<double>"), F.lit(None).cast("array<array<array<double>>>"))) == []
    pairs = F.expr(f"array(named_struct('bbox', {box}, 'line', named_struct('text', 'a', 'conf', 0.5D)), named_struct('bbox', {box}, 'line', null), null)")
    assert [(x.text, x.conf) for x in one(spark, ocr.lines_of_pairs(pairs))] == [("a", 0.5)]
    assert one(spark, ocr.lines_of_images(F.lit(False), ocr.lines_of_pairs(pairs))) == []


def test_turned_and_resized_grids(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for shape in ((3, 5), (4, 4), (1, 6)):
        g = rng.integers(0, 255, shape).astype(float)
        grid = F.array(*map(F.lit, g.ravel().tolist()))
        for k in range(4):
            assert one(spark, pixels.turned_grid(grid, F.lit(shape[0]), F.lit(shape[1]), F.lit(k))) == np.rot90(g, -k).ravel().tolist()
        for to in ((2, 3), (6, 10), (5, 2), shape):
            want = similarity.resized(g, *to)
            assert one(spark, pixels.resized_grid(grid, F.lit(shape[0]), F.lit(shape[1]), F.lit(to[0]), F.lit(to[1]))) == want.ravel().tolist()
        assert (similarity.resized(g, *shape) == g).all()


def test_windowed_similarity():
    import numpy as np

    rng = np.random.default_rng(5)
    a = rng.integers(0, 255, (12, 9)).astype(float)
    b = np.clip(a + rng.normal(0, 20, a.shape), 0, 255)
    scores = []
    for y in range(12 - 6):
        for x in range(9 - 6):
            p, q = a[y : y + 7, x : x + 7].ravel(), b[y : y + 7, x : x + 7].ravel()
            c = np.cov(p, q)
            scores.append((2 * p.mean() * q.mean() + 6.5025) * (2 * c[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (c[0, 0] + c[1, 1] + 58.5225)))
    assert math.isclose(similarity.windowed_similarity(a, b), np.mean(scores), rel_tol=1e-9)
    assert math.isclose(similarity.windowed_similarity(a, a), 1) and math.isclose(similarity.windowed_similarity(a[:2], a[:2]), 1)


def test_sample_images(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.integers(0, 255, (10, 10)).astype(float)
    other = rng.integers(0, 255, (12, 8)).astype(float)
    frames = [base, base + 1, rng.integers(0, 255, (10, 10)).astype(float), base, other, similarity.resized(other, 10, 10), base]
    rows = [("v", i, 50.0 if i == 6 else 200.0, *g.shape, g.ravel().tolist()) for i, g in enumerate(frames)] + [("w", 3, 200.0, 10, 10, base.ravel().tolist()), ("w", 4, 200.0, 10, 10, None), ("w", 5, 200.0, 3, 10, base.ravel().tolist())]
    df = spark.createDataFrame(rows, "video string, frame_idx long, sharpness double, rows int, cols int, grid array<double>")
    last, want = None, []
    for i, g in enumerate(frames[:6]):
        if last is None or similarity.windowed_similarity(g, last if last.shape == g.shape else similarity.resized(last, *g.shape)) <= 0.95:
            last = g
            want.append(i)
    assert {r.video: r.kept for r in tracks.sample_images(df.repartition(3)).collect()} == {"v": want, "w": [3]} and 1 not in want and {2, 3, 4} <= set(want)
    assert {r.video: r.kept for r in tracks.sample_images(df, most=2).collect()} == {"v": want[:2], "w": [3]}
    assert tracks.sample_images(df.limit(0)).count() == 0


def plain_sample(rows, gate, change, most):
    """rows: video, frame_idx, sharpness, signal."""
    out = {}
    for video in {r[0] for r in rows}:
        last, kept = None, []
        for _, i, sharp, x in sorted((r for r in rows if r[0] == video and None not in r[1:] and r[2] >= gate and not math.isnan(r[3])), key=lambda r: (r[1], r[3])):
            if len(kept) < most and (last is None or abs(x - last) > change):
                last = x
                kept.append(i)
        if kept:
            out[video] = kept
    return out


@pytest.mark.parametrize("block", [1, 5, 64, 1 << 16])
def test_sample_frames(spark, block):
    """Walks, steps, constant stretches, rising and falling signals over many blocks and tasks a video; nulls, repeated numbers, null videos."""
    import random

    rng = random.Random(block)
    rows, level = [], 0.0
    for i in range(400):
        level += rng.choice([0, 0, 1, -1, 4])
        rows.append(("walk", i, rng.choice([50.0, 5.0]), level))
    rows += [("flat", i, 30.0, 7.0 if i < 290 else 99.0) for i in range(300)] + [("up", i, 30.0, float(i)) for i in range(200)] + [("saw", i, 30.0, float(-i % 13)) for i in range(200)]
    rows += [(None, i, 30.0, float(i % 5 * 6)) for i in range(40)] + [("nulls", None, 30.0, 1.0), ("nulls", 1, None, 1.0), ("nulls", 2, 30.0, None), ("nulls", 3, 30.0, float("nan")), ("dull", 1, 1.0, 1.0)]
    rows += [("same", 4, 30.0, x) for x in (20.0, 0.0, 40.0)] + [("far", 10**12 * i, 30.0, 11.0 * i) for i in range(30)]
    df = spark.createDataFrame(rows, "video string, frame_idx long, sharpness double, signal double").repartition(6)
    for most in (1, 6, 200):
        got = {r.video: r.kept for r in sampling.sample_frames(df, 20, 10, most, block).collect()}
        assert got == plain_sample(rows, 20, 10, most)
    assert sampling.sample_frames(df.limit(0), 20, 10, 5, block).count() == 0


def test_sample_images_with_missing_levels(spark):
    """A frame with a null level neither ends its video's sample nor becomes its last kept frame."""
    grid = lambda n: [float((i * n) % 7 * 30) for i in range(64)]
    rows = [("v", i, 200.0, 8, 8, grid(i + 1)) for i in range(6)]
    rows[0] = (*rows[0][:5], [None, *rows[0][5][1:]])
    rows[3] = (*rows[3][:5], [*rows[3][5][:-1], float("nan")])
    df = spark.createDataFrame(rows, "video string, frame_idx long, sharpness double, rows int, cols int, grid array<double>")
    kept = tracks.sample_images(df).first().kept
    assert kept[0] == 1 and not {0, 3} & set(kept) and len(kept) >= 3


def test_progress_blocks(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.random()])) for i in range(300)]
    most, want = {}, []
    for task, seq, value in rows:
        if value is not None and value >= most.get(task, 0):
            most[task] = value
            want.append((task, seq, value))
    log = spark.createDataFrame(rows, "task_id string, seq long, fraction double")
    for block in (7, 1000):
        assert sorted(map(tuple, tracks.monotone_progress(log, block).collect()), key=lambda r: r[1]) == want
    sparse = log.withColumn("seq", F.col("seq") * 1_000_000_000)
    plan = tracks.monotone_progress(sparse, 100)
    assert plan.count() == len(want) and sorted(r.seq // 1_000_000_000 for r in plan.collect()) == [s for _, s, _ in want]


def test_pipeline_of_tags(spark, tmp_path):
    """Two tracks whose best frame is one, one in another frame, one whose frame is missing; both orientations."""
    box = lambda track, frame, n, conf, sharp, w=60, h=30: ("in/v.mp4", frame, n, track, conf, 10.0 * (track or 0), 5.0, 10.0 * (track or 0) + w, 5.0 + h, sharp)
    boxes = spark.createDataFrame([box(2, 1, 0, 0.9, 50.0), box(1, 3, 1, 0.9, 80.0), box(2, 3, 2, 0.9, 80.0), box(3, 5, 3, 0.9, 10.0), box(4, 6, 4, 0.5, 10.0, 30, 60), box(5, 6, 5, 0.4, 10.0, 8, 8), box(None, 6, 6, 0.9, 1.0)], tables.DETECTIONS)
    frames = spark.createDataFrame([("in/v.mp4", i, f"p{i}") for i in (1, 3, 6)], "video string, frame_idx long, pixels string")
    videos = spark.createDataFrame([("in/v.mp4", 0.0)], "video string, fps double")
    found = {r.frame_idx: r for r in pipeline.keyframes(boxes, frames, videos).collect()}
    assert {i: [t.track_id for t in r.price_tags] for i, r in found.items()} == {3: [2, 1], 6: [4, 5]} and found[3].timestamp_ms == 100 and found[6].pixels == "p6"
    kept = pipeline.keyframes(boxes, frames, videos)
    assert tuple(pipeline.counts(kept).first()) == (2, 4, 4)
    assert tuple(pipeline.counts(kept, pipeline.best_frames(boxes, videos)).first()) == (2, 4, 4, 1, 1)
    assert tuple(pipeline.counts(kept.limit(0)).first()) == (0, 0, 0)
    line = "array(named_struct('bbox', array(array(2D, 2D), array(8D, 2D), array(8D, 6D), array(2D, 6D)), 'text', 'Tea'), named_struct('bbox', array(array(40D, 2D), array(44D, 2D), array(44D, 6D), array(40D, 6D)), 'text', '99.50'))"
    read = spark.range(1).select(F.lit("in/v.mp4").alias("video"), F.explode(F.array(F.lit(2), F.lit(4), F.lit(5))).alias("track_id"), F.lit("yellow").alias("color"), F.lit("p1=3;barcode=7").alias("qr_data"), F.expr("array(array(3D, 2D), array(5D, 4D))").alias("qr_bbox"), F.expr(line).alias("ocr_text"))
    heard, folder = [], f"warped_tags/v.mp4-{hashlib.md5(b'in/v.mp4').hexdigest()[:8]}"
    out = pipeline.in_order(pipeline.price_tags(boxes, frames, videos, read.withColumn("track_id", F.col("track_id").cast(boxes.schema["track_id"].dataType)), "aspect", progress=lambda *x: heard.append(x)))
    rows = out.collect()
    assert [(r.frame_timestamp, r.x_min, r.product_name, r.price_default, r.color, r.warped_image) for r in rows] == [
        (100, 20, "Tea", "99,50", "yellow", f"{folder}/warped_100_0.png"), (100, 10, "", "", "unknown", f"{folder}/warped_100_1.png"),
        (200, 40, "Tea", "99,50", "yellow", f"{folder}/warped_200_0.png"), (200, 50, "", "", "unknown", ""),
    ]
    shares = [x for _, x in heard]
    assert rows[0].price1_qr == "3" and shares == sorted(shares) and {0.0, 0.3, 0.35, 0.5, 0.55, 0.9, 1.0} <= set(shares)
    tables.write_results(out, f"{tmp_path}/one", one_file=True)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    assert [r.frame_timestamp for r in tables.read_results(spark, f"{tmp_path}/one").collect()] == [100, 100, 200, 200]
    tags = spark.createDataFrame([("a", 20, 10, [[3.0, 2.0]]), ("b", 20, 10, None), ("c", None, None, None)], "warped_image string, warp_w int, warp_h int, qr_bbox array<array<double>>")
    turns = spark.createDataFrame([("a", 1), ("b", 3)], "warped_image string, quarters long")
    got = {r.warped_image: (r.quarters, r.warp_w, r.warp_h, r.qr_bbox) for r in pipeline.oriented(tags, "color", turns).collect()}
    assert got == {"a": (1, 10, 20, [[7, 3]]), "b": (3, 10, 20, None), "c": (0, None, None, None)}
    for mode, given in (("upside down", turns), ("color", None)):
        with pytest.raises(ValueError):
            pipeline.oriented(tags, mode, given)


def test_color_without_pixels(spark):
    points = spark.createDataFrame([(1, 10, 10, 220)] * 3, "image_id long, b int, g int, r int")
    every = spark.createDataFrame([(1,), (2,), (2,)], "image_id long")
    assert {(r.image_id, r.n, r.color) for r in images.tag_color(points, images=every).collect()} == {(1, 3, "red"), (2, 0, "unknown")}


def test_labelled_and_page(spark):
    out = registry.QUERIES["q17_record"](spark, SF).limit(2).withColumn("thumbnail", F.lit("data:image/png;base64,AA=="))
    shown = records.labelled(out.withColumn("color", F.lit("red")))
    assert shown.columns == list(records.LABELS.values()) and len(shown.columns) == 30 and shown.first()["Цвет"] == "красный"
    assert {r["Цвет"] for r in records.labelled(out.drop("thumbnail").withColumn("color", F.lit("-"))).collect()} == {"неизвестно"}
    page = [r.value for r in tables.html_page(out.withColumn("price_default", F.lit("7.50"))).collect()]
    assert page[0].startswith("<html>") and page[0].count("<th>") == 30 and page[-1].endswith("</html>") and len(page) == 4
    assert all('<img src="data:image/png;base64,AA==">' in x and "<td>7,50</td>" in x for x in page[1:3])
    evil = [r.value for r in tables.html_rows(out.withColumn("thumbnail", F.lit('"><script>'))).collect()]
    assert all("<script>" not in x for x in evil)


def test_small_sources_and_sinks(spark, tmp_path):
    """Image files below a folder, progress messages, gray levels, an image without a usable size."""
    (tmp_path / "crops").mkdir()
    (tmp_path / "crops" / "a.png").write_bytes(b"\x89PNG")
    (tmp_path / "crops" / "b.txt").write_bytes(b"no image")
    assert [(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in tables.read_images(spark, str(tmp_path)).collect()] == [("a.png", b"\x89PNG")]
    log = spark.createDataFrame([("t", "Reading", 0.55)], "task_id string, message string, fraction double")
    assert tables.progress_json(log).first().value == '{"message":"Reading","progress":0.55}'
    assert [one(spark, pixels.gray(*map(F.lit, p))) for p in ((0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255))] == [0, 255, 29, 150, 76]
    empty = spark.createDataFrame([("in/v.mp4", 5, [[0.0, 0.0]] * 4, None, "p1=2", None, None, None, None)], "video string, timestamp_ms long, corners array<array<double>>, color string, qr_data string, qr_bbox array<array<double>>, ocr_text array<struct<bbox:array<array<double>>,text:string>>, warp_w int, warp_h int")
    row = records.records(empty).first()
    assert (row.color, row.product_name, row.raw_text, row.price1_qr, row.x_max) == ("unknown", "", "", "2", 0)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("v", i, 0, i % 7 if i % 11 else None, (i % 10) / 10, 0.0, 0.0, 1.0, 1.0, float(i * 37 % 50)) for i in range(300)]
    boxes = spark.createDataFrame(rows, tables.DETECTIONS)
    boxes.repartition(3).write.parquet(f"{tmp_path}/in")
    detections.start_best_tracks(detections.detection_stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = {(r.track_id, r.frame_idx, r.score) for r in detections.merged_best(spark, f"{tmp_path}/out").collect()}
    assert got == {(r.track_id, r.frame_idx, r.score) for r in tracks.track_best(boxes).collect()}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "documents", "embeddings", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = lambda found, names: sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)
