"""Pixels of frames: tiles, the upright crop of every tag, what is measured on it, and images written as files.

A frame's pixels are row-major bytes, blue-green-red.  Frames are cut into tiles first, in the task that
reads them; a tag's box is an interval of rows and one of columns, so it meets the tiles that it touches
by an equality join on (video, frame, tile row, tile column) and only these move, between executors and never
through the driver.  A tag's tiles come together, sorted by tag in one task, which holds those of one tag at a time; there the
crop is sampled, bilinear at sub-pixel places, through the homography that carries its corners to an upright rectangle.

Edge cases: a tag that is too small has a null crop and keeps its row, as does one whose frame or tiles are
missing; points outside of the frame are black; corners on one line or not finite, or missing, give no crop; frames
whose bytes don't fit their size give no tiles; repeated frames would give a tag two crops, so a
frame's key is its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagforge.functions import geometry, raster
from tagforge.sources.stage import ship_code

#: Rows and columns of a tile.
SIDE = 256
#: Bytes of tiles that are sent at once.
BATCH_BYTES = 4 << 20
#: Largest number of pixels of a crop that is sampled; a larger box is no tag of one frame.
MOST_PIXELS = 1 << 26
TILE = "video string, frame_idx long, side int, tile_y int, tile_x int, frame_h int, frame_w int, h int, w int, data binary"


def cut(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("video", pa.string()), ("frame_idx", pa.int64()), *((c, pa.int32()) for c in ("side", "tile_y", "tile_x", "frame_h", "frame_w", "h", "w")), ("data", pa.binary())])
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for video, frame, h, w, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                img = raster.image(data, h, w)
                if img is None:
                    continue
                for y in range(0, h, side):
                    for x in range(0, w, side):
                        part = img[y : y + side, x : x + side]
                        held.append((video, frame, side, y // side, x // side, h, w, part.shape[0], part.shape[1], part.tobytes()))
                        size += part.size
                        if size > BATCH_BYTES:
                            yield out()
                            held, size = [], 0
        if held:
            yield out()

    return run


def tiles(frames: DataFrame, side: int = SIDE) -> DataFrame:
    """frames: video, frame_idx, h, w, data -> TILE: squares of side pixels, smaller at the right and lower border."""
    ship_code(frames.sparkSession)
    rows = frames.select(F.col("video").cast("string").alias("video"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "data")
    return rows.mapInArrow(cut(side), TILE)


def touched(tags: DataFrame, side: int = SIDE) -> DataFrame:
    """tags: video, frame_idx, tag, corners -> a row for each tile that a usable tag's samples can read."""
    tags = tags.withColumn("corners", geometry.finite(F.col("corners")))
    box = geometry.bounding_box(F.col("corners"))
    usable = geometry.usable(geometry.upright_size(F.col("corners")))
    least, most = (lambda c: F.greatest(F.lit(0), F.floor((F.col(f"box.{c}") - 1) / side))), (lambda c: F.floor((F.col(f"box.{c}") + 2) / side))  # one pixel more for cut and neighbour
    rows = tags.where(usable).select("video", "frame_idx", "tag", "corners", box.alias("box")).where("box.x_max >= 0 and box.y_max >= 0")
    rows = rows.withColumn("tile_y", F.explode(F.sequence(least("y_min"), most("y_max")).cast("array<int>")))
    return rows.withColumn("tile_x", F.explode(F.sequence(least("x_min"), most("x_max")).cast("array<int>"))).drop("box")


def measured(bgr: np.ndarray) -> dict:
    """What later steps need of a crop: its color, and the turn that brings the colored part down."""
    red, yellow = raster.masks(bgr)
    turn, score = raster.best_turn(red | yellow)
    return {"color": raster.color_of(red, yellow), "quarters": turn, "turn_score": score}


CROP = "h int, w int, data binary, color string, quarters int, turn_score double"


def cropped(side: int, pixels_too: bool):
    """Rows sorted by tag -> each tag's key and crop; one tag's tiles and a few megabytes of crops are held at a time."""

    def crop(corners: list, tiles: list[tuple]) -> list:
        """tiles: tile_y, tile_x, frame_h, frame_w, h, w, data."""
        corners = np.array(corners, float)
        edge = lambda i, j: float(np.sqrt(((corners[i] - corners[j]) ** 2).sum()))
        w, h = int(max(edge(2, 3), edge(1, 0))), int(max(edge(1, 2), edge(0, 3)))
        if w * h > MOST_PIXELS:
            return [None] * 6
        top, left = min(t[0] for t in tiles) * side, min(t[1] for t in tiles) * side
        high, wide = tiles[0][2:4]
        below, right = (max(t[i] for t in tiles) * side + side for i in (0, 1))
        region = np.zeros((min(below, high) - top, min(right, wide) - left, 3), np.uint8)
        for tile_y, tile_x, _, _, own_h, own_w, data in tiles:
            y, x = tile_y * side - top, tile_x * side - left
            region[y : y + own_h, x : x + own_w] = raster.image(data, own_h, own_w)
        img = raster.sampled(region, *raster.source_points(corners, w, h), left, top)
        return [h, w, img.tobytes() if pixels_too else None, *measured(img).values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("h", "w", "data", "color", "quarters", "turn_score")
        kinds = [pa.string(), pa.int64(), None, pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int32(), pa.float64()]
        key, corners, tiles, held, size = None, None, [], [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held, strict=True), kinds, strict=True)], names=["video", "frame_idx", "tag", *names])
        same = lambda a, b: a is not None and all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds[2] = batch.schema.field("tag").type
            if any(x != side for x in batch.column("side").unique().to_pylist()):
                raise ValueError(f"the tiles aren't squares of {side} pixels")
            column = lambda c: batch.column(c).to_pylist()  # noqa: E731, B023
            own = zip(*map(column, ("tile_y", "tile_x", "frame_h", "frame_w", "h", "w", "data")), strict=True)
            for i, (new, tile) in enumerate(zip(zip(*map(column, ("video", "frame_idx", "tag")), strict=True), own, strict=True)):
                if not same(key, new):
                    if tiles:
                        held.append((*key, *crop(corners, tiles)))
                        size += len(held[-1][5] or b"") + 100
                    if size > BATCH_BYTES:
                        yield out()
                        held, size = [], 0
                    key, corners, tiles = new, batch.column("corners")[i].as_py(), []
                tiles.append(tile)
        if tiles:
            held.append((*key, *crop(corners, tiles)))
            yield out()

    return run


def crops(cut_frames: DataFrame, tags: DataFrame, side: int = SIDE, pixels_too: bool = True) -> DataFrame:
    """tiles of frames and tags (video, frame_idx, tag, corners) -> each usable tag's video, frame_idx, tag and CROP.

    The crop is w x h pixels, w and h being the longer of each two opposite edges; color and quarters are those of the crop,
    whose pixels come back only if they are asked for.
    """
    ship_code(tags.sparkSession)
    keys = ["video", "frame_idx", "tile_y", "tile_x"]
    kind = tags.schema["tag"].dataType.simpleString()
    wanted = touched(tags.select(F.col("video").cast("string").alias("video"), F.col("frame_idx").cast("long").alias("frame_idx"), "tag", "corners"), side)
    # Spark can't tell how large tiles are, nor how many of them a tag touches: neither side may be taken for a small one and sent through the driver
    met = wanted.join(cut_frames.hint("merge"), keys)
    together = met.repartition("video", "frame_idx", "tag").sortWithinPartitions("video", "frame_idx", "tag")
    return together.mapInArrow(cropped(side, pixels_too), f"video string, frame_idx long, tag {kind}, {CROP}")


def mapped(images: DataFrame, made: str, step: Callable[[dict], list]) -> DataFrame:
    """images with the columns of `made` added, which step gives for each row; rows of an Arrow batch at once, no shuffle."""
    ship_code(images.sparkSession)
    new = T._parse_datatype_string(made)
    schema = T.StructType([*images.schema.fields, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new.fields]
        for batch in batches:
            found = [step(row) for row in batch.to_pylist()]
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(f.name for f in new.fields)])

    return images.mapInArrow(run, schema)


def upright(images: DataFrame) -> DataFrame:
    """images: h, w, data, quarters and more -> data and sides turned clockwise by quarters; the rest stays."""
    def turn(row: dict) -> list:
        img = raster.image(row["data"], row["h"], row["w"])
        if img is None or not row["quarters"]:
            return [row["h"], row["w"], row["data"]]
        out = raster.turned(img, row["quarters"])
        return [out.shape[0], out.shape[1], out.tobytes()]

    return _replaced(mapped(images, "__h int, __w int, __data binary", turn), {"h": "__h", "w": "__w", "data": "__data"}, images.columns)


def _replaced(rows: DataFrame, new: dict[str, str], columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(new.get(c, c)).alias(c) for c in columns))


def shrunk(images: DataFrame, most: int = 200) -> DataFrame:
    """images: h, w, data and more -> with no side longer than most, the shape kept; null without pixels."""
    def shrink(row: dict) -> list:
        img = raster.image(row["data"], row["h"], row["w"])
        if img is None:
            return [None, None, None]
        out = raster.thumbnail(img, most)
        return [out.shape[0], out.shape[1], out.tobytes()]

    return _replaced(mapped(images, "__h int, __w int, __data binary", shrink), {"h": "__h", "w": "__w", "data": "__data"}, images.columns)


def thumbnails(images: DataFrame, most: int = 200) -> DataFrame:
    """images: path, h, w, data -> path, h, w, content: PNG files with no side longer than most; null without pixels."""
    rows = shrunk(images.select("path", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "data"), most)
    return mapped(rows, "content binary", _png).select("path", "h", "w", "content")


def _png(row: dict) -> list:
    img = raster.image(row["data"], row["h"], row["w"])
    return [None if img is None else raster.png(img)]


def debug_frames(frames: DataFrame) -> DataFrame:
    """frames: h, w, data, price_tags (structs with corners) and more -> also data darkened outside of its tags, which are outlined."""
    def darken(row: dict) -> list:
        img = raster.image(row["data"], row["h"], row["w"])
        polygons = [t["corners"] for t in row["price_tags"] or [] if t["corners"]]
        return [None if img is None else raster.highlighted(img, polygons).tobytes()]

    return _replaced(mapped(frames, "__data binary", darken), {"data": "__data"}, frames.columns)


def debug_codes(images: DataFrame) -> DataFrame:
    """images: h, w, data, qr_bbox and more -> data with the code outlined."""
    def draw(row: dict) -> list:
        img = raster.image(row["data"], row["h"], row["w"])
        if img is None or not row["qr_bbox"]:
            return [row["data"]]
        out = img.copy()
        out[raster.outline(np.trunc(np.array(row["qr_bbox"], float)), *img.shape[:2], raster.THICK)] = raster.GREEN
        return [out.tobytes()]

    return _replaced(mapped(images, "__data binary", draw), {"data": "__data"}, images.columns)


def as_png(images: DataFrame) -> DataFrame:
    """images: path, h, w, data -> path, content; images without pixels are left out."""
    return mapped(images.select("path", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "data"), "content binary", _png).where("content is not null").select("path", "content")


def sharpness(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """frames: video, frame_idx, h, w, data; boxes: video, frame_idx -> video, frame_idx, sharpness of the frames that have boxes.

    Frames without boxes are left out before their pixels move or are touched.
    """
    def measure(row: dict) -> list:
        img = raster.image(row["data"], row["h"], row["w"])
        return [None if img is None else raster.sharpness(img)]

    rows = frames.select("video", "frame_idx", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "data")
    return mapped(rows.join(boxes.select("video", "frame_idx").distinct(), ["video", "frame_idx"], "left_semi"), "sharpness double", measure).select("video", "frame_idx", "sharpness")
