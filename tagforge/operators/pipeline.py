"""From detections to records: best frames, their tags, crops, orientation, text, codes, and the result in order.

Detectors, recognizers and code readers stay outside; what they find comes in as tables.  Every step
is a DataFrame: the best observations are one aggregation, frames are joined once the winners are
known (metadata first, pixels of winners only), colors and turns are measured on crops of the frames' tiles, and
everything else is expressions on a tag's row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagforge.functions import geometry, text
from tagforge.operators import crops as pixels
from tagforge.operators.progress import Progress
from tagforge.operators.prune import only_listed
from tagforge.operators.records import COLUMNS, explode_tags, records
from tagforge.operators.tracks import track_best
from tagforge.sources.stage import staged

ORIENTATIONS = ("color", "aspect")
# What is told at each stage, and the share of the work that is done then.
STAGES = {"track": 0.0, "frames": 0.3, "crop": 0.35, "orient": 0.5, "read": 0.55, "done": 1.0}
READ_SHARE = 0.35
#: What records are listed by.
ORDER = ("filename", "frame_timestamp", "tag_ord")


def best_frames(boxes: DataFrame, videos: DataFrame) -> DataFrame:
    """boxes: video, track_id, frame_idx, box_idx, conf, sharpness, x1..y2; videos: video, fps -> video, frame_idx,
    timestamp_ms, sharpness, price_tags: the frames that are the best of a track.

    A frame that is the best of several tracks lists them in the order in which they were first seen.
    """
    keyed = boxes.where("track_id is not null").withColumn("track_id", F.struct("video", "track_id"))
    best = track_best(keyed, ("sharpness", "x1", "y1", "x2", "y2"))
    tag = F.struct("first_frame", "first_box", geometry.corners(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("corners"), F.col("conf").alias("confidence"), F.col("track_id.track_id").alias("track_id"))
    plain = lambda x: F.struct(x["corners"].alias("corners"), x["confidence"].alias("confidence"), x["track_id"].alias("track_id"))
    wanted = best.groupBy(F.col("track_id.video").alias("video"), "frame_idx").agg(F.max("sharpness").alias("sharpness"), F.transform(F.array_sort(F.collect_list(tag)), plain).alias("price_tags"))
    timed = wanted.join(videos.select("video", geometry.frame_rate(F.col("fps")).alias("fps")), "video").withColumn("timestamp_ms", geometry.frame_ms(F.col("frame_idx"), F.col("fps")))
    return timed.select("video", "frame_idx", "timestamp_ms", "sharpness", "price_tags")


def with_frames(wanted: DataFrame, frames: DataFrame) -> DataFrame:
    """The best frames (a written table) that frames (video, frame_idx and more) has, with its columns; others cost their own tags only.

    Frames that aren't wanted are left out where they are read, so their pixels don't move, however many are wanted.
    """
    few = only_listed(frames, wanted, ["video", "frame_idx"]) if len(frames.columns) > 2 else frames
    return wanted.join(few.hint("merge"), ["video", "frame_idx"])  # Spark can't tell how large pixels are


def keyframes(boxes: DataFrame, frames: DataFrame, videos: DataFrame) -> DataFrame:
    """best_frames, found at once and written, with what frames has of them."""
    return with_frames(staged(best_frames(boxes, videos), "best-frames"), frames)


def oriented(tags: DataFrame, mode: str, turns: DataFrame | None = None, image: str = "warped_image") -> DataFrame:
    """tags: warp_w, warp_h, qr_bbox and more -> also quarters, with sizes and code points turned.

    `color` takes quarters from the tags, if they have them, or by image from turns (`images.best_turn`; the least of an image
    that has several), none for other images; `aspect` turns an image that is higher than wide.  A tag without an image stays as it is.
    """
    if mode not in ORIENTATIONS:
        raise ValueError(f"orientation is one of {ORIENTATIONS}, not {mode!r}")
    h, w = F.col("warp_h"), F.col("warp_w")
    if mode == "aspect":
        rows = tags.withColumn("quarters", F.when(h > w, 3).otherwise(0))
    elif turns is not None:
        by_image = turns.groupBy(F.col(image)).agg(F.min("quarters").cast("int").alias("quarters"))
        rows = tags.drop("quarters").join(by_image.hint("merge"), image, "left").withColumn("quarters", F.coalesce("quarters", F.lit(0)))
    elif "quarters" in tags.columns:
        rows = tags.withColumn("quarters", F.coalesce("quarters", F.lit(0)))
    else:
        raise ValueError("orientation by color needs crops or the turns of the images")
    odd = F.col("quarters") % 2 == 1
    # in two steps: names inside a lambda would mean the new sizes
    rows = rows.withColumn("qr_bbox", geometry.turned(F.col("qr_bbox"), F.col("quarters"), h, w))
    return rows.withColumns({"warp_w": F.when(odd, h).otherwise(w), "warp_h": F.when(odd, w).otherwise(h)})


def in_order(rows: DataFrame) -> DataFrame:
    """Records as they are listed: by video, best frame, then the order in which tracks were first seen."""
    return rows.orderBy(*ORDER).select(COLUMNS)


def counts(frames: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row: frames, tags and tracks of the best frames that were found; given all that were wanted, also what was lost with a missing frame."""
    key = ["video", "frame_idx"]
    every = frames if wanted is None else wanted.join(frames.select(*key, F.lit(True).alias("here")), key, "left")
    here = F.lit(True) if wanted is None else F.col("here").isNotNull()
    rows = every.select(F.struct(*key).alias("frame"), here.alias("here"), F.explode_outer("price_tags").alias("tag"))
    rows = rows.withColumn("track", F.when(F.col("tag").isNotNull(), F.struct("frame.video", "tag.track_id")))
    distinct = lambda ok, c, name: F.count_distinct(F.when(ok, F.col(c))).alias(name)
    found = [distinct(F.col("here"), "frame", "n_frames"), F.count_if(F.col("here") & F.col("tag").isNotNull()).alias("n_tags"), distinct(F.col("here"), "track", "n_tracks")]
    lost = [] if wanted is None else [distinct(~F.col("here"), "frame", "n_lost_frames"), F.count_if(~F.col("here") & F.col("tag").isNotNull()).alias("n_lost_tags")]
    return rows.agg(*found, *lost)


def read_progress(done: Column, total: Column) -> Column:
    """The share of all work that is done when `done` of `total` tags have been read."""
    return F.lit(STAGES["read"]) + READ_SHARE * done / total


def folder_of(crops: str, video: Column) -> Column:
    """A folder of its own for each video's crops: its name and the start of a digest of its path."""
    return F.concat(F.lit(crops.rstrip("/") + "/"), text.base_name(video), F.lit("-"), F.substring(F.md5(text.text_of(video)), 1, 8))


def price_tags(
    boxes: DataFrame, frames: DataFrame, videos: DataFrame, found: DataFrame, orientation: str = "color", assume_99: bool = True,
    turns: DataFrame | None = None, crops: str = "warped_tags", progress: Progress | Callable[[str, float], None] | None = None,
    tiles: DataFrame | None = None, side: int = pixels.SIDE,
) -> DataFrame:
    """The 31 columns and tag_ord of every tag of the best frames (`in_order` lists them).

    found: video, track_id, qr_data, qr_bbox, ocr_text and, without tiles, color of the tags that were read; others have
    none.  With tiles (`crops.tiles` of the frames, squares of side pixels) colors and turns are measured on the crops.  `progress` hears what is being done and the
    share that is done; its stages are run and written one by one then, and otherwise only the best frames are found at once.
    """
    told = progress if isinstance(progress, Progress) else Progress(boxes.sparkSession, progress)
    run = told.stage if progress else (lambda message, begin, end, action: action())
    kept = staged if progress else (lambda rows, name: rows)
    share = STAGES.get
    best = run("track", share("track"), share("frames"), lambda: staged(best_frames(boxes, videos), "best-frames"))

    def with_crops() -> DataFrame:
        tags = explode_tags(with_frames(best, frames.select("video", "frame_idx")), "frame_idx")
        tags = tags.withColumn("corners", geometry.finite(F.col("corners")))
        size = geometry.upright_size(F.col("corners"))
        usable = geometry.usable(size)
        tags = tags.withColumns({"warp_w": F.when(usable, size["w"]), "warp_h": F.when(usable, size["h"])})
        tags = tags.withColumn("warped_image", text.crop_path(folder_of(crops, F.col("video")), F.col("timestamp_ms"), F.col("tag_ord"), F.coalesce(usable, F.lit(False))))
        if tiles is not None:
            seen = pixels.crops(tiles, tags.withColumnRenamed("tag_ord", "tag"), side, pixels_too=False)
            tags = tags.join(seen.select("video", "frame_idx", F.col("tag").alias("tag_ord"), "color", "quarters").hint("merge"), ["video", "frame_idx", "tag_ord"], "left")
        return kept(tags, "tags")

    tags = run("crop", share("crop"), share("orient"), with_crops)
    read = found.drop("color") if tiles is not None else found
    tags = tags.join(read.hint("merge"), ["video", "track_id"], "left")  # as many rows as tags: not through the driver
    # a tag too small for an image has nothing that is read from one
    tags = tags.withColumns({c: F.when(F.col("warp_w").isNotNull(), F.col(c)) for c in ("color", "qr_data", "qr_bbox", "ocr_text")})
    tags = oriented(tags, orientation, turns)
    rows = run("read", share("read"), share("read") + READ_SHARE, lambda: kept(records(tags, assume_99, keep=("tag_ord",)), "records"))
    if progress:
        told.tell("done", share("done"))
    return rows
