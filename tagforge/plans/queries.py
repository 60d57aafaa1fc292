"""The reference operators over the supplied tables; the module `oracle` has the same rows in DuckDB's SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagforge.functions import geometry, pixels, text
from tagforge.operators import crops, detection_metrics, evaluate, fields, images, ocr, ordered, pipeline, records, sampling, tracks
from tagforge.sources.tables import read_parquet

FPS = 29.97


def boxes(spark: SparkSession, d: str) -> DataFrame:
    e = read_parquet(spark, d, "events")
    return e.select(F.col("user_id").alias("track_id"), F.expr("event_id div 50").alias("frame_idx"), F.col("event_id").alias("box_idx"), ((F.col("event_id") % 100) / 100).alias("conf"), F.col("value").alias("sharpness"))


def q01(spark: SparkSession, d: str) -> DataFrame:
    return tracks.track_best(boxes(spark, d)).withColumn("score", F.round("score", 6))


def q02(spark: SparkSession, d: str) -> DataFrame:
    out = tracks.frame_tracks(tracks.track_best(boxes(spark, d)), FPS)
    return out.select("frame_idx", F.array_join(F.transform("tracks", lambda t: t.cast("string")), ",").alias("tracks"), "timestamp_ms")


def q03(spark: SparkSession, d: str) -> DataFrame:
    x1, y1 = F.col("l_quantity"), F.col("l_discount") * 100
    rows = read_parquet(spark, d, "lineitem").withColumn("corners", geometry.corners(x1, y1, x1 + F.col("l_extendedprice") / 1000, y1 + F.col("l_tax") * 1000))
    rows = rows.withColumns({"box": geometry.bounding_box(F.col("corners")), "size": geometry.upright_size(F.col("corners"))})
    return rows.select("l_orderkey", "l_linenumber", "box.*", F.when(geometry.usable(F.col("size")), F.col("size.w")).alias("warp_w"), F.when(geometry.usable(F.col("size")), F.col("size.h")).alias("warp_h"))


def tag_lines(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as lines of a tag of 200 x 100, four corners around a derived center."""
    t = read_parquet(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    cx, cy = (F.col("turn") * 37 + F.col("conv_id") * 11) % 200, (F.col("turn") * 53 + F.length("text")) % 100
    line = F.struct("turn", geometry.corners(cx - 4, cy - 2, cx + 4, cy + 2).alias("bbox"), "text")
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def q04(spark: SparkSession, d: str) -> DataFrame:
    return tag_lines(spark, d).select("conv_id", fields.joined(F.col("lines")).alias("raw_text"))


def q05(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.split(text.text_of(F.col("text")), "\n", -1), lambda x: F.struct(x.alias("text")))
    return read_parquet(spark, d, "documents").select("doc_id", fields.first_price(lines).alias("price"))


def q06(spark: SparkSession, d: str) -> DataFrame:
    part = lambda top, left: fields.joined(fields.zone(F.col("lines"), F.lit(200), F.lit(100), top, left))
    return tag_lines(spark, d).select("conv_id", part(True, True).alias("left_top"), part(True, False).alias("right_top"), part(False, True).alias("left_bottom"), part(False, False).alias("right_bottom"))


def q07(spark: SparkSession, d: str) -> DataFrame:
    n = ((F.col("l_discount") * 1000 + F.col("l_quantity")).cast("long") % 150).cast("string")
    k = F.col("l_linenumber") % 4
    left = F.when(k == 0, F.concat(n, F.lit("%"))).when(k == 1, F.concat(F.lit("x -"), n)).when(k == 2, "abc").otherwise("")
    right = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("save "), n, F.lit(" %"))).otherwise("x")
    line = lambda c: F.struct(c.alias("text"))
    rows = read_parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(line(left)).alias("left"), F.array(line(left), line(right)).alias("bottom"))
    return rows.select("l_orderkey", "l_linenumber", fields.discount(F.col("left"), F.col("bottom")).alias("d")).select("l_orderkey", "l_linenumber", "d.*")


def price_texts(rows: DataFrame) -> DataFrame:
    whole, cents = (F.col("o_orderkey") % 5000).cast("string"), (F.col("o_custkey") % 100).cast("string")
    default = F.when(F.col("o_orderkey") % 3 == 0, F.concat(whole, F.lit(".00"))).when(F.col("o_orderkey") % 3 == 1, F.concat(whole, F.lit("."), F.lpad(cents, 2, "0"))).otherwise("")
    return rows.select("o_orderkey", default.alias("before"), F.concat((F.col("o_custkey") * 7 % 5000).cast("string"), F.lit(".00")).alias("after"), F.concat(F.lit("N "), whole, F.lit(" "), F.lpad(cents, 2, "0")).alias("words"))


def q08(spark: SparkSession, d: str) -> DataFrame:
    rows = price_texts(read_parquet(spark, d, "orders"))
    before = text.assume_kopecks(F.coalesce(F.nullif("before", F.lit("")), text.extract_price(F.col("words"))))
    after = text.assume_kopecks(F.col("after"))
    return rows.select("o_orderkey", text.format_price(fields.sane_default(before, after)).alias("price_default"), text.format_price(after).alias("price_discount"))


def payload() -> F.Column:
    key = F.col("o_orderkey").cast("string")
    return F.concat(F.lit(" Barcode ="), key, F.lit(";p1="), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(";PRICE1 = "), key)).otherwise(""), F.lit(";junk;ap=a=b; ac = "), F.col("o_orderstatus"), F.lit(" ;unknown=1;p2="))


def q09(spark: SparkSession, d: str) -> DataFrame:
    """Payloads made from orders, and the queries of the URLs of pages, whose parts are separated by `&`."""
    made = read_parquet(spark, d, "orders").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("key"), text.parse_code(payload()).alias("c"))
    query = F.concat(F.coalesce(F.get(F.split("url", "\\?", 2), 1), F.lit("")), F.lit("&p3="), F.col("page_id").cast("string"))
    urls = read_parquet(spark, d, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("key"), text.parse_code(F.replace(query, F.lit("page="), F.lit("P2=")), "&").alias("c"))
    return made.unionByName(urls).select("key", "c.*")


def q10(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda n: F.when(F.col("event_id") % n == 0, "QRCODE").otherwise("EAN13")
    symbols = F.array(F.struct(kind(3).alias("type"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("").alias("data")), F.struct(kind(5).alias("type"), F.lit("second").alias("data")))
    return read_parquet(spark, d, "events").select("event_id", tracks.pick_payload(symbols, F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("string"))).alias("qr_data"))


def q11(spark: SparkSession, d: str) -> DataFrame:
    points = read_parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 256).alias("b"), (F.col("l_suppkey") * 3 % 256).alias("g"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 31) % 256).alias("r"))
    out = images.tag_color(points)
    return out.select("image_id", "n", F.round("red_share", 9).alias("red_share"), F.round("yellow_share", 9).alias("yellow_share"), "color")


def q12(spark: SparkSession, d: str) -> DataFrame:
    cells = read_parquet(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i"))
    points = cells.select("image_id", F.lit(6).alias("h"), F.lit(5).alias("w"), F.expr("i div 5").alias("y"), (F.col("i") % 5).alias("x"), (F.col("image_id") * (F.expr("i div 5") * 5 + F.col("i") % 5 + 1) % 7 < 2).alias("colored"))
    return images.best_turn(points).withColumn("score", F.round("score", 9))


def grids(spark: SparkSession, d: str) -> DataFrame:
    return read_parquet(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 128).cast("double")).alias("grid"))


def q13(spark: SparkSession, d: str) -> DataFrame:
    """Of 64 whole levels, 4096 times the variance is a whole number."""
    return grids(spark, d).select("vec_id", F.round(pixels.sharpness(F.col("grid"), 8, 8) * 4096).cast("long").alias("sharpness_4096"))


def q14(spark: SparkSession, d: str) -> DataFrame:
    frames = read_parquet(spark, d, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame_idx"), F.col("value").alias("sharpness"), F.col("value").alias("signal"))
    return sampling.sample_frames(frames, 20, 10, 5).select("video", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"))


def q15(spark: SparkSession, d: str) -> DataFrame:
    return images.consecutive_similarity(grids(spark, d), "vec_id", "grid").withColumn("similarity", F.round("similarity", 6))


def q16(spark: SparkSession, d: str) -> DataFrame:
    log = read_parquet(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("value").alias("fraction"))
    return tracks.monotone_progress(log)


def tags(spark: SparkSession, d: str) -> DataFrame:
    """One tag of 200 x 100 for each order: a name, prices before and after a discount, the discount."""
    key = F.col("o_orderkey")
    line = lambda t, x, y: F.struct(geometry.corners(F.lit(x - 5), F.lit(y - 5), F.lit(x + 5), F.lit(y + 5)).alias("bbox"), t.alias("text"))
    number = lambda c: c.cast("string")
    lines = F.array(
        line(F.concat(F.lit(" Item "), F.col("o_orderpriority")), 50, 20), line(number(key % 900 + 100), 150, 40),
        line(F.concat(F.lit("-"), number(F.col("o_custkey") % 130)), 50, 80), line(F.concat(number(F.col("o_custkey") % 700 + 100), F.lit(" 49")), 150, 80),
    )
    color = F.when(key % 3 == 0, "red").when(key % 3 == 1, "yellow")
    return read_parquet(spark, d, "orders").select(
        F.concat(F.lit("/in/video_"), number(key % 10), F.lit(".mp4")).alias("video"), (key * 40).alias("timestamp_ms"), geometry.corners(key % 50, key % 40, key % 50 + 200, key % 40 + 100).alias("corners"),
        color.alias("color"), payload().alias("qr_data"), F.lit(None).cast("array<array<double>>").alias("qr_bbox"), lines.alias("ocr_text"), F.lit(200).alias("warp_w"), F.lit(100).alias("warp_h"),
        F.concat(F.lit("img/"), number(key)).alias("warped_image"),
    )


def q17(spark: SparkSession, d: str) -> DataFrame:
    return records.records(tags(spark, d))


def q18(spark: SparkSession, d: str) -> DataFrame:
    return records.display(q17(spark, d))


def q19(spark: SparkSession, d: str) -> DataFrame:
    blobs = read_parquet(spark, d, "documents").select(F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return records.with_thumbnails(q17(spark, d), blobs).select("warped_image", F.md5("thumbnail").alias("thumbnail_md5"))


def q20(spark: SparkSession, d: str) -> DataFrame:
    """Best frames of three videos (one without a frame rate) joined with a table of frames that lacks some."""
    e, p, key = read_parquet(spark, d, "events"), read_parquet(spark, d, "part"), F.col("p_partkey")
    video = lambda c: F.concat(F.lit("v"), (c % 3).cast("string")).alias("video")
    found = e.select(video(F.col("user_id")), F.col("user_id").alias("track_id"), F.expr("event_id div 50").alias("frame_idx"), F.col("event_id").alias("box_idx"), ((F.col("event_id") % 100) / 100).alias("conf"), F.col("value").alias("sharpness"), *((F.col("event_id") % n).cast("double").alias(c) for c, n in (("x1", 50), ("y1", 40))), *((F.col("event_id") % n + 60).cast("double").alias(c) for c, n in (("x2", 70), ("y2", 90))))
    frames = p.select(video(key), F.expr("p_partkey div 3").alias("frame_idx"), "p_name")
    videos = spark.createDataFrame([("v0", 0.0), ("v1", 25.0), ("v2", FPS)], "video string, fps double")
    out = pipeline.keyframes(found, frames, videos)
    tracks_of = F.array_join(F.transform("price_tags", lambda t: t["track_id"].cast("string")), ",")
    x = F.transform("price_tags", lambda t: t["corners"][2][0].cast("int").cast("string"))
    return out.select("video", "frame_idx", "timestamp_ms", F.round("sharpness", 6).alias("sharpness"), tracks_of.alias("tracks"), F.array_join(x, ",").alias("right_edges"), "p_name")


def varied_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of 200 x 100 for all orders whose lines, heights and codes vary: two prices above, two below, a discount."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = lambda x: x.cast("string")
    line = lambda t, x, y, h=10: F.struct(geometry.corners(F.lit(x - 5), y - h / 2, F.lit(x + 5), y + h / 2).alias("bbox"), t.alias("text"))
    lines = F.array(
        line(F.concat(F.lit(" Item "), F.col("o_orderpriority")), 50, F.lit(20)),
        line(F.when(k % 5 == 0, "no price").otherwise(number(k % 900 + 100)), 150, 15 + k % 3 * 12),
        line(F.concat(number(c % 800 + 100), F.lit("."), F.lpad(number(k % 100), 2, "0")), 150, F.lit(45)),
        line(F.when(k % 7 == 0, "abc").otherwise(F.concat(F.lit("-"), number(c % 130), F.when(k % 2 == 0, "%").otherwise(""))), 50, F.lit(80)),
        line(F.when(k % 11 == 0, "x").otherwise(F.concat(number(c % 700 + 100), F.lit(" 49"))), 150, F.lit(70), 8 + k % 4 * 4),
        line(F.when(k % 6 == 0, "x").otherwise(F.concat(number(c % 600 + 100), F.lit(",00"))), 150, F.lit(90), F.lit(12)),
    )
    bottom = (10 + k % 3 * 20).cast("double")
    box = F.when(k % 4 == 0, F.array(F.array(F.lit(110.0), F.lit(2.0)), F.array(F.lit(140.0), bottom)))
    color = F.when(k % 3 == 0, "red").when(k % 3 == 1, "yellow").otherwise("unknown")
    return read_parquet(spark, d, "orders").select("o_orderkey", lines.alias("lines"), box.alias("box"), color.alias("color"))


def q21(spark: SparkSession, d: str) -> DataFrame:
    found = fields.parse_fields(F.col("lines"), F.col("box"), F.col("color"), F.lit(200), F.lit(100))
    return varied_tags(spark, d).select("o_orderkey", found.alias("f")).select("o_orderkey", "f.*")


def q22(spark: SparkSession, d: str) -> DataFrame:
    blobs = read_parquet(spark, d, "documents").select(F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return records.labelled(records.with_thumbnails(q17(spark, d), blobs).withColumn("thumbnail", F.when(F.col("thumbnail") != "", F.md5("thumbnail")).otherwise("")))


def q23(spark: SparkSession, d: str) -> DataFrame:
    """File names of frames and crops, the start of a code's text, and the progress while tags are read."""
    ms, place = F.col("o_orderkey") * 40, F.col("o_orderkey") % 3
    return read_parquet(spark, d, "orders").select(
        "o_orderkey", text.frame_name(ms).alias("frame"), text.frame_name(ms, F.col("o_custkey") / 2).alias("best_frame"),
        text.crop_path("out/warped_tags/", ms, place, F.col("o_orderkey") % 4 != 0).alias("crop"), text.overlay(payload()).alias("overlay"),
        F.round(pipeline.read_progress(place + 1, F.lit(3)), 9).alias("progress"),
    )


def q24(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a recognizer's parallel lists, of which scores and boxes are too short."""
    t = read_parquet(spark, d, "conversations").withColumn("text", text.text_of(F.col("text")))
    lists = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).withColumn("n", F.size("t"))
    upto = lambda k: F.filter(F.sequence(F.lit(0), F.col("n")), lambda i: i < F.floor(F.col("n") / k))
    scores = F.transform(upto(2), lambda i: (i + 1) / 10)
    corner = lambda i: F.array(F.lit(1.0), (i * 2).cast("double"))
    boxes = F.transform(upto(3), lambda i: F.array(corner(i), corner(i), corner(i), corner(i)))
    lines = ocr.lines_of_lists(F.col("t.text"), scores, boxes)
    return lists.select("conv_id", F.posexplode(lines).alias("place", "x")).select("conv_id", "place", "x.text", "x.conf", F.col("x.bbox")[2][1].alias("y"))


def q25(spark: SparkSession, d: str) -> DataFrame:
    """How many prices and discounts of the varied tags occur among labels made from parts."""
    key = F.col("p_partkey")
    labels = read_parquet(spark, d, "part").select(F.concat(F.lit(" "), (key % 300 + 100).cast("string"), F.lit(",99")).alias("price_card"), F.concat(F.lit("-"), (key % 20).cast("string"), F.lit("%")).alias("discount_amount"), F.lit("").alias("code"))
    return evaluate.matched(q21(spark, d), labels, {"price_discount": "price_card", "discount_amount": "discount_amount", "price_card": "code"})


def picture(n: int, h: int = 24, w: int = 32) -> np.ndarray:
    """The h x w frame number n: gradients, with a red lower half in every third and yellow on the left in the next."""
    y, x = np.mgrid[:h, :w]
    out = np.stack([n * 7 + y * 13 + x * 29, n * 3 + y * y + x, n + x * x * 5 + y * 3], axis=2) % 256
    if n % 3 == 0:
        out[h // 2 :] = np.stack([(x * y + n) % 40, (x * y + n) % 40, 200 + (x + y) % 50], axis=2)[h // 2 :]
    if n % 3 == 1:
        out[:, : w // 2] = np.stack([20 + y % 9, 190 + (x + n) % 9, np.full_like(x, 225)], axis=2)[:, : w // 2]
    return out.astype(np.uint8)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a small file, which is one task, as several tasks for each core."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def pictures(numbers: DataFrame) -> DataFrame:
    """numbers: video, frame_idx -> also h, w, data.

    A few bytes of numbers become many of pixels, so they are dealt to several tasks for each core before.
    """
    rows = dealt(numbers, "video", "frame_idx").select("video", "frame_idx", F.lit(24).alias("h"), F.lit(32).alias("w"))
    return crops.mapped(rows, "data binary", lambda row: [picture(row["frame_idx"]).tobytes()])


def level_sums(row: dict) -> list[int]:
    """Sums of a crop's blue, green and red, and of all levels weighted by their place."""
    levels = np.frombuffer(row["data"], np.uint8).astype(int)
    return [*(int(levels[c::3].sum()) for c in range(3)), int((levels * (np.arange(len(levels)) % 97 + 1)).sum())]


def tag_corners(k: F.Column) -> list[F.Column]:
    """Left, top, right and bottom of the box of tag k at quarters of a pixel; some leave the frame, some are too small."""
    left, top = 2 + k % 8 / 4, 1 + k % 12 / 4
    return [left, top, left + 12 + k % 15, top + 8 + k % 12]


def q26(spark: SparkSession, d: str) -> DataFrame:
    """Crops of one tag in the picture of every part, from tiles of 16 x 16 pixels: sums of their levels, color and turn."""
    p = read_parquet(spark, d, "part").select(F.lit("v").alias("video"), F.col("p_partkey").alias("frame_idx"))
    tags = dealt(p, "frame_idx").select("video", "frame_idx", F.col("frame_idx").alias("tag"), geometry.corners(*tag_corners(F.col("frame_idx"))).alias("corners"))
    cut = crops.crops(crops.tiles(pictures(p), 16), tags, 16)
    summed = crops.mapped(cut, "blue long, green long, red long, checked long", level_sums)
    return summed.select(F.col("tag").alias("p_partkey"), "h", "w", "blue", "green", "red", "checked", "color", "quarters")


def q27(spark: SparkSession, d: str) -> DataFrame:
    """Records of two videos with equal timestamps from boxes, frames, tiles, codes and text; every eleventh frame is missing."""
    k = F.col("p_partkey")
    video = F.concat(F.lit("in/v"), (k % 2).cast("string"), F.lit(".avi")).alias("video")
    p = read_parquet(spark, d, "part")
    seen = p.select(video, k.alias("track_id"), k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("n"))
    left, top, right, bottom = tag_corners(F.col("k"))
    boxes = seen.select("video", "track_id", (F.floor(F.col("k") / 4) + F.col("n")).alias("frame_idx"), (F.col("k") * 2 + F.col("n")).alias("box_idx"), F.lit(0.9).alias("conf"), (50.0 + F.when(F.col("n") == 0, F.col("k") % 7).otherwise(F.col("k") * 3 % 7)).alias("sharpness"), left.alias("x1"), top.alias("y1"), right.alias("x2"), bottom.alias("y2"))
    frames = boxes.select("video", "frame_idx").distinct().where("frame_idx % 11 <> 0")
    videos = p.select(video, F.lit(25.0).alias("fps")).distinct()
    line = lambda t, x: F.struct(geometry.corners(F.lit(x - 1.0), F.lit(0.0), F.lit(x + 1.0), F.lit(2.0)).alias("bbox"), t.alias("text"))
    found = p.select(video, k.alias("track_id"), F.concat(F.lit("p1="), k.cast("string"), F.lit(".5;barcode="), k.cast("string")).alias("qr_data"), F.lit(None).cast("array<array<double>>").alias("qr_bbox"), F.array(line(F.col("p_brand"), 1.0), line((k % 900 + 100).cast("string"), 30.0)).alias("ocr_text"))
    return pipeline.price_tags(boxes, frames, videos, found, tiles=crops.tiles(pictures(frames), 16), side=16)


def q28(spark: SparkSession, d: str) -> DataFrame:
    """All orders numbered by date, latest first, over many tasks."""
    rows = read_parquet(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return ordered.numbered(rows, [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "place")


def q29(spark: SparkSession, d: str) -> DataFrame:
    """The picture of every part, no side longer than 16: sums of its levels."""
    p = read_parquet(spark, d, "part").select(F.lit("v").alias("video"), F.col("p_partkey").alias("frame_idx"))
    small = crops.shrunk(pictures(p), 16)
    return crops.mapped(small, "blue long, green long, red long, checked long", level_sums).select(F.col("frame_idx").alias("p_partkey"), "h", "w", "blue", "green", "red", "checked")


def q30(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of boxes made from lineitem against those of its parts: several predictions for a truth, false ones, three labels."""
    k = F.col("p_partkey")
    truths = read_parquet(spark, d, "part").select((k % 50).alias("image"), F.concat(F.lit("l"), (k % 3).cast("string")).alias("label"), k.alias("id"), *(x.cast("double").alias(c) for c, x in zip(detection_metrics.SIDES, (k * 40, k % 7 * 10, k * 40 + 20, k % 7 * 10 + 20), strict=True)))
    n = F.row_number().over(Window.partitionBy("l_partkey", "l_orderkey", "l_linenumber", "l_quantity").orderBy("l_extendedprice", "l_suppkey", "l_discount", "l_tax", "l_shipdate"))
    line = read_parquet(spark, d, "lineitem").withColumn("n", n).where("n = 1 and l_linenumber < 3")
    p, off = F.col("l_partkey"), F.col("l_quantity") % 12
    id_ = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + F.col("l_quantity")).cast("long") * 1_000_000 + p
    conf = (F.col("l_orderkey") * 7 + p) % 101 / 101
    sides = (p * 40 + off, p % 7 * 10, p * 40 + off + 20, p % 7 * 10 + 20)
    predictions = line.select((p % 50).alias("image"), F.concat(F.lit("l"), (p % 3).cast("string")).alias("label"), id_.alias("id"), conf.alias("conf"), *(x.cast("double").alias(c) for c, x in zip(detection_metrics.SIDES, sides, strict=True)))
    out = detection_metrics.average_precision(predictions, truths, (0.5, 0.75))
    return out.select("label", "level", "n_truths", "n_predictions", "n_matched", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "average_precision")))
