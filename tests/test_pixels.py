"""Tiles, crops, masks, thumbnails, sharpness on frames, files and progress against plain Python."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagforge.functions import pixels, raster
from tagforge.operators import crops, images, pipeline, progress, prune
from tagforge.plans import queries
from tagforge.sources import tables

CORNERS = "video string, frame_idx long, tag int, corners array<array<double>>"


def pictures(spark, *sizes, seed=3):
    rng = np.random.default_rng(seed)
    made = [(f"v{i % 2}", i, h, w, rng.integers(0, 256, (h, w, 3)).astype(np.uint8)) for i, (h, w) in enumerate(sizes)]
    df = spark.createDataFrame([(v, i, h, w, bytearray(x.tobytes())) for v, i, h, w, x in made], "video string, frame_idx long, h int, w int, data binary")
    return df, {(v, i): x for v, i, _, _, x in made}


def plain_crop(img, corners, w, h):
    """Point by point: the projective map by elimination over four corners, then bilinear."""
    to = [(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)]
    a = [row for (u, v), (x, y) in zip(to, corners, strict=True) for row in ([u, v, 1, 0, 0, 0, -x * u, -x * v], [0, 0, 0, u, v, 1, -y * u, -y * v])]
    m = np.append(np.linalg.solve(np.array(a, float), np.array(corners, float).ravel()), 1)
    level = lambda y, x: img[y, x].astype(float) if 0 <= y < img.shape[0] and 0 <= x < img.shape[1] else np.zeros(3)
    out = np.zeros((h, w, 3))
    for v in range(h):
        for u in range(w):
            z = m[6] * u + m[7] * v + 1
            x, y = (m[0] * u + m[1] * v + m[2]) / z, (m[3] * u + m[4] * v + m[5]) / z
            x0, y0 = int(np.floor(x)), int(np.floor(y))
            fx, fy = x - x0, y - y0
            out[v, u] = (level(y0, x0) * (1 - fx) + level(y0, x0 + 1) * fx) * (1 - fy) + (level(y0 + 1, x0) * (1 - fx) + level(y0 + 1, x0 + 1) * fx) * fy
    return out


def test_crops(spark):
    """Upright boxes at sub-pixel corners, over borders and many tiles, and slanted ones; tiles of several sides."""
    df, of = pictures(spark, (40, 70), (33, 20), (64, 64))
    box = lambda x1, y1, x2, y2: [[x1, y1], [x2, y1], [x2, y2], [x1, y2]]
    tags = [
        ("v0", 0, 0, box(3.0, 4.0, 15.0, 16.0)), ("v0", 0, 1, box(-5.25, -3.5, 20.0, 18.75)), ("v0", 0, 2, box(55.5, 30.25, 90.0, 60.0)), ("v1", 1, 0, box(2.0, 2.0, 11.9, 30.0)), ("v1", 1, 1, box(1.5, 2.5, 14.0, 30.25)),
        ("v0", 2, 0, [[10.0, 8.0], [50.0, 14.0], [44.0, 55.0], [6.0, 40.0]]), ("v0", 2, 1, [[30.0, 5.0], [55.0, 30.0], [30.0, 55.0], [5.0, 30.0]]), ("v0", 2, 2, None), ("v0", 2, 3, box(float("nan"), 1.0, 30.0, 30.0)),
        ("v0", 9, 0, box(1.0, 1.0, 20.0, 20.0)), ("v0", 2, 4, box(-90.0, -90.0, -60.0, -60.0)), ("v0", 2, 5, [[5.0, 5.0], [25.0, 25.0], [45.0, 45.0], [5.0, 5.0]]),
    ]
    asked = spark.createDataFrame(tags, CORNERS)
    for side in (7, 16, 256):
        got = {(r.video, r.frame_idx, r.tag): r for r in crops.crops(crops.tiles(df.repartition(2), side), asked, side).collect()}
        for video, frame, tag, corners in tags[:2] + tags[2:3] + tags[4:7]:
            r = got[video, frame, tag]
            want = plain_crop(of[video, frame], corners, r.w, r.h)
            assert np.abs(raster.image(bytes(r.data), r.h, r.w) - want).max() <= 0.5 + 1e-6
        assert ("v1", 1, 0) not in got and ("v0", 9, 0) not in got and ("v0", 2, 2) not in got  # under 10 wide, no frame, no corners
        with pytest.raises(Exception, match="squares of 9"):
            crops.crops(crops.tiles(df, side), asked, 9).collect()
        assert got["v0", 0, 0].h == 12 and got["v0", 2, 0].w == int(np.hypot(40, 6)) and (got.get(("v0", 2, 4)) is None)
        black = raster.image(bytes(got["v0", 0, 2].data), got["v0", 0, 2].h, got["v0", 0, 2].w)
        assert not black[15:].any() and not black[:, 20:].any()


def test_tiles_stay_off_the_driver(spark):
    """Tiles look small to Spark before they are made: neither they nor tags nor what was read of tags may be broadcast."""
    frames = spark.range(40).select(F.lit("v").alias("video"), F.col("id").alias("frame_idx"), F.lit(20).alias("h"), F.lit(30).alias("w"), F.lit(bytearray(range(200)) * 9).alias("data"))
    corners = F.expr("array(array(2D, 3D), array(25D, 3D), array(25D, 17D), array(2D, 17D))")
    asked = frames.select("video", "frame_idx", F.explode(F.array(F.lit(0), F.lit(1))).alias("tag"), corners.alias("corners"))
    cut = crops.crops(crops.tiles(frames, 8), asked, 8)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(cut) and "SortMergeJoin" in plan(cut)
    q26, q27 = (query(spark, "/root/testdata/sf0.001") for query in (queries.q26, queries.q27))
    assert "Broadcast" not in plan(q26) and "BroadcastHashJoin" not in plan(q27)
    want = sorted(map(tuple, cut.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # a tag's tiles come in two batches
    try:
        assert sorted(map(tuple, crops.crops(crops.tiles(frames, 8), asked, 8).collect())) == want and len(want) == 80
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pictures_are_dealt_to_many_tasks(spark):
    """One small file of numbers is one task; the pixels made from it are not."""
    made = queries.pictures(spark.range(0, 400, 1, 1).select(F.lit("v").alias("video"), F.col("id").alias("frame_idx")))
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 8 and made.count() == 400


def test_measures_agree(spark):
    """Colors, turns, gray levels and edges of arrays in tasks and of pixels as rows or expressions are the same."""
    rng = np.random.default_rng(8)
    made = [rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for h, w in ((12, 15), (5, 9), (3, 8), (1, 1))]
    made[0][:6], made[0][6:] = [20, 10, 220], 130
    made[1][:, :3], made[1][:, 3:] = [30, 200, 230], 250
    rows = [(i, x.shape[0], x.shape[1], y, c, *map(int, x[y, c])) for i, x in enumerate(made) for y in range(x.shape[0]) for c in range(x.shape[1])]
    points = spark.createDataFrame(rows, "image_id int, h int, w int, y int, x int, b int, g int, r int")
    colors = {r.image_id: r.color for r in images.tag_color(points).collect()}
    p = pixels.hsv(F.col("b"), F.col("g"), F.col("r"))
    turns = {r.image_id: (r.quarters, round(r.score, 9)) for r in images.best_turn(points.withColumn("colored", pixels.is_red(p) | pixels.is_yellow(p))).collect()}
    grays = {(r.image_id, r.y, r.x): r.level for r in points.withColumn("level", pixels.gray(F.col("b"), F.col("g"), F.col("r"))).collect()}
    for i, x in enumerate(made):
        red, yellow = raster.masks(x)
        turn, score = raster.best_turn(red | yellow)
        assert colors[i] == raster.color_of(red, yellow) and turns[i] == (turn, round(score, 9))
        assert all(grays[i, y, c] == v for (y, c), v in np.ndenumerate(raster.gray(x)))
        flat = spark.createDataFrame([(raster.gray(x).ravel().tolist(),)], "grid array<double>")
        want = flat.select(pixels.sharpness(F.col("grid"), *x.shape[:2])).first()[0]
        assert all(raster.sharpness(x, block) == pytest.approx(want) for block in (1, 20, 1 << 20))
    assert colors[0] == "red" and colors[1] == "yellow" and turns[0][0] == 2 and raster.color_of(np.zeros((0, 3), bool), np.zeros((0, 3), bool)) == "unknown"


def test_sharpness_touches_only_frames_with_boxes(spark):
    """Frames without boxes don't reach the kernel: bad bytes there would stop it."""
    df, of = pictures(spark, (9, 8), (10, 7), (4, 4))
    boxes = spark.createDataFrame([("v0", 0), ("v0", 0), ("v0", 2), ("v1", 77)], "video string, frame_idx long")
    touched = spark.sparkContext.accumulator(0)

    def seen(row):
        touched.add(1)
        return [0]

    got = {(r.video, r.frame_idx): r.sharpness for r in crops.sharpness(df, boxes).collect()}
    assert got == {k: pytest.approx(raster.edges(raster.gray(of[k])).var()) for k in (("v0", 0), ("v0", 2))}
    crops.mapped(df.join(boxes.distinct(), ["video", "frame_idx"], "left_semi"), "n int", seen).collect()
    assert touched.value == 2


def test_only_listed(spark):
    """All that is listed passes, hardly anything else; no key and null keys."""
    rows = spark.range(20_000).select((F.col("id") % 7).cast("string").alias("video"), F.col("id").alias("frame_idx"), F.lit("pixels").alias("data"))
    listed = rows.where("frame_idx % 50 = 3").select("video", "frame_idx")
    left = prune.only_listed(rows.unionByName(spark.sql("SELECT null AS video, 3L AS frame_idx, 'x' AS data")), listed, ["video", "frame_idx"])
    assert left.join(listed, ["video", "frame_idx"]).count() == 400 and left.count() < 420 and left.where("video is null").count() == 0
    assert prune.only_listed(rows, listed.limit(0), ["video", "frame_idx"]).count() == 0
    narrow = listed.withColumn("frame_idx", F.col("frame_idx").cast("int"))
    assert prune.only_listed(rows, narrow, ["video", "frame_idx"]).join(narrow, ["video", "frame_idx"]).count() == 400


def plain_inside(corners, y, x):
    inside = False
    for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1], strict=True):
        if (ya > y) != (yb > y) and x < xa + (y - ya) * (xb - xa) / (yb - ya):
            inside = not inside
    return inside


@pytest.mark.parametrize("corners", [[(2, 3), (15, 3), (15, 12), (2, 12)], [(8, 1), (17, 9), (7, 16), (1, 6)], [(1, 1), (18, 17), (18, 1), (1, 17)], [(-5, -5), (9, 2), (3, 30), (-2, 4)]])
def test_masks(corners):
    """Scan conversion against the even-odd rule at every point that isn't on the outline."""
    mask, line = raster.inside_polygon(np.array(corners), 20, 20), raster.outline(np.array(corners), 20, 20)
    assert all(mask[y, x] == plain_inside(corners, y, x) for y in range(20) for x in range(20) if not line[y, x]) and (mask & line == line).all()


def test_debug_images(spark):
    df, of = pictures(spark, (30, 40))
    tag = [[5.0, 6.0], [20.9, 6.0], [20.9, 18.0], [5.0, 18.0]]
    frames = df.withColumn("price_tags", F.expr(f"array(named_struct('corners', array({', '.join(f'array({x}D, {y}D)' for x, y in tag)})))"))
    r = crops.debug_frames(frames).first()
    out, img = raster.image(bytes(r.data), r.h, r.w), of["v0", 0]
    assert (out[10, 10] == img[10, 10]).all() and (out[25, 30] == (img[25, 30] * 0.3).astype(np.uint8)).all() and out[6, 10].tolist() == [0, 255, 0]
    plain = crops.debug_frames(df.withColumn("price_tags", F.expr("cast(array() as array<struct<corners:array<array<double>>>>)"))).first()
    assert bytes(plain.data) == (img * 0.3).astype(np.uint8).tobytes()
    codes = df.withColumn("qr_bbox", F.expr("array(array(3D, 3D), array(9D, 3D), array(9D, 9D))")).unionByName(df.withColumns({"frame_idx": F.lit(5).cast("long"), "qr_bbox": F.lit(None).cast("array<array<double>>")}))
    got = {r.frame_idx: raster.image(bytes(r.data), r.h, r.w) for r in crops.debug_codes(codes).collect()}
    assert got[0][3, 5].tolist() == [0, 255, 0] and (got[5] == img).all()
    turned = crops.upright(df.withColumn("quarters", F.lit(1))).first()
    assert (raster.image(bytes(turned.data), turned.h, turned.w) == np.rot90(img, -1)).all() and (turned.h, turned.w) == (40, 30)


def unpacked(blob):
    """Pixels of a PNG whose rows aren't filtered, color as blue, green, red."""
    at, parts = 8, {}
    while at < len(blob):
        n, kind = int.from_bytes(blob[at : at + 4], "big"), blob[at + 4 : at + 8]
        assert zlib.crc32(blob[at + 4 : at + 8 + n]) == int.from_bytes(blob[at + 8 + n : at + 12 + n], "big")
        parts[kind], at = blob[at + 8 : at + 8 + n], at + 12 + n
    w, h = (int.from_bytes(parts[b"IHDR"][i : i + 4], "big") for i in (0, 4))
    return np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, -1)[:, 1:].reshape(h, w, -1)[..., ::-1]


def test_thumbnails_and_files(spark, tmp_path):
    """Sides, shape and totals kept, a constant image stays constant, small ones stay; files are read back and shown."""
    df, of = pictures(spark, (100, 50), (20, 7), (333, 500))
    flat = df.where("frame_idx = 0").withColumns({"frame_idx": F.lit(7).cast("long"), "data": F.lit(bytearray(b"\x4d" * 15_000))})
    rows = df.unionByName(flat).withColumn("path", F.format_string("p%d.png", "frame_idx")).unionByName(df.limit(1).withColumns({"path": F.lit("none"), "data": F.lit(None).cast("binary")}))
    got = {r.path: r for r in crops.thumbnails(rows, 20).collect()}
    assert [(got[f"p{i}.png"].h, got[f"p{i}.png"].w) for i in (0, 1, 2)] == [(20, 10), (20, 7), (13, 20)] and got["none"].content is None
    assert (unpacked(bytes(got["p1.png"].content)) == of["v1", 1]).all() and set(unpacked(bytes(got["p7.png"].content)).ravel()) == {0x4D}
    assert np.abs(unpacked(bytes(got["p0.png"].content)).mean(axis=(0, 1)) - of["v0", 0].mean(axis=(0, 1))).max() < 0.5
    assert np.allclose(raster.area_weights(7, 3).sum(axis=1), 1) and np.allclose(raster.area_weights(7, 3).sum(axis=0), 3 / 7)
    written = tables.write_images(crops.as_png(rows.withColumn("path", F.concat(F.lit("a/"), F.col("path")))), f"file://{tmp_path}/img")
    assert written == 4
    read = tables.read_images(spark, f"file://{tmp_path}/img")
    assert {r.path.rpartition("/img/")[2] for r in read.collect()} == {f"a/p{i}.png" for i in (0, 1, 2, 7)}
    assert (unpacked((tmp_path / "img" / "a" / "p1.png").read_bytes()) == of["v1", 1]).all()
    assert base64.b64encode((tmp_path / "img" / "a" / "p7.png").read_bytes()).startswith(b"iVBOR")


def test_write_images_stays_inside(spark, tmp_path):
    bad = spark.createDataFrame([("../out.png", bytearray(b"x"))], "path string, content binary")
    with pytest.raises(Exception, match="outside"):
        tables.write_images(bad, f"file://{tmp_path}/img")
    assert not (tmp_path / "out.png").exists()


def test_tags_of_two_videos(spark):
    """Equal timestamps and places in two videos: crops have paths of their own, colors and turns come from each one's pixels."""
    img = np.full((60, 80, 3), 200, np.uint8)
    red, yellow = img.copy(), img.copy()
    red[5:15, 5:45], yellow[5:35, 25:45] = [10, 10, 220], [20, 200, 230]
    frames = spark.createDataFrame([("a/v.mp4", 3, 60, 80, bytearray(red.tobytes())), ("b/v.mp4", 3, 60, 80, bytearray(yellow.tobytes()))], "video string, frame_idx long, h int, w int, data binary")
    boxes = spark.createDataFrame([(v, 3, 0, 1, 0.9, 5.0, 5.0, 45.0, 35.0, 50.0) for v in ("a/v.mp4", "b/v.mp4")], tables.DETECTIONS)
    videos = spark.createDataFrame([("a/v.mp4", 25.0), ("b/v.mp4", 25.0)], "video string, fps double")
    found = spark.createDataFrame([], "video string, track_id long, qr_data string, qr_bbox array<array<double>>, ocr_text array<struct<bbox:array<array<double>>,text:string,conf:double>>")
    told = []
    out = pipeline.price_tags(boxes, frames, videos, found, tiles=crops.tiles(frames, 16), side=16, progress=lambda *x: told.append(x)).collect()
    assert sorted(r.color for r in out) == ["red", "yellow"] and len({r.warped_image for r in out}) == 2
    turns = spark.createDataFrame([(r.warped_image, q) for r in out for q in (1, 2)], "warped_image string, quarters int")
    assert pipeline.price_tags(boxes, frames, videos, found.withColumn("color", F.lit("red")), turns=turns).count() == 2
    shares = [s for _, s in told]
    assert shares == sorted(shares) and shares[0] == 0 and shares[-1] == 1


def test_no_share_before_its_action(spark, tmp_path):
    """Shares rise with tasks; the end of a stage is told after its action, a failing one tells no end."""
    told = []
    run = progress.Progress(spark, lambda m, s: told.append((m, s)), f"file://{tmp_path}/log", "task", every=0.02)
    slow = spark.range(8, numPartitions=8).mapInPandas(lambda it: (__import__("time").sleep(0.3) or b for b in it), "id long")
    held, seen = progress.observed(slow, most=F.max("id"))
    assert run.stage("read", 0.2, 0.6, lambda: (held.repartition(4).count(), list(told))) == (8, [x for x in told if x[1] < 0.6])
    assert seen.get == {"rows": 8, "most": 7}
    assert told[0] == ("read", 0.2) and told[-1] == ("read", 0.6) and any(0.2 < s < 0.6 for _, s in told)
    with pytest.raises(ZeroDivisionError):
        run.stage("next", 0.7, 0.9, lambda: 1 / 0)
    assert told[-1] == ("next", 0.7) and not run.tell("old", 0.5) and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    log = progress.read_log(spark, f"file://{tmp_path}/log")
    assert [(r.message, r.fraction) for r in log.orderBy("seq").collect()] == told
    assert tables.progress_json(log.where("seq = 0")).first().value == '{"message":"read","progress":0.2}'
