"""Uncompressed video as a Spark data source: YUV4MPEG2 files and folders of PPM images.

`spark.read.format("frames").load(path)` gives one row a frame: video, frame_idx, fps, h, w and data (row-major
blue-green-red bytes).  Every frame has a fixed size in the file, so a partition is a range of frames that is read by
seeking, and filters on frame_idx that Spark pushes down cut the ranges: only wanted frames are read.  Headers are
read once, on the driver; pixels only in tasks.

Edge cases: a frame rate of 0 is 30, as with one that is missing; a last frame that is cut off is left out; an empty file or
one without a header is an error that names it; colors are taken as BT.601 in full range, and planes of 4:2:0 and 4:2:2 are
repeated to full size; videos of a folder are numbered by nothing: `video` is each one's path.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tagforge.functions.geometry import DEFAULT_RATE

SCHEMA = "video string, frame_idx long, fps double, h int, w int, data binary"
#: Bytes of pixels that a partition reads, and those of one batch.
PART_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: Columns and rows of a chroma plane for each of the image's, by the format's name.
CHROMA = {"420": (2, 2), "422": (2, 1), "444": (1, 1), "mono": None}


def file_system(path: str):
    """pyarrow's file system for a path, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


@dataclass
class Video:
    """Where a video's frames are: `first` bytes, then frames of `size` bytes each led by `lead`; or one image file a frame."""

    path: str
    h: int
    w: int
    fps: float
    n: int
    chroma: str = ""
    first: int = 0
    lead: int = 0
    files: tuple[str, ...] = ()

    @property
    def size(self) -> int:
        if self.files:
            return 3 * self.h * self.w
        across = CHROMA[self.chroma]
        return self.h * self.w + (2 * -(-self.w // across[0]) * -(-self.h // across[1]) if across else 0)


def rate(text: str | None) -> float:
    """Frames a second of `n:d`; DEFAULT_RATE if that is missing or 0."""
    n, _, d = (text or "0:1").partition(":")
    found = float(n) / float(d or 1) if float(d or 1) else 0.0
    return found or DEFAULT_RATE


def y4m(files, path: str, length: int) -> Video:
    """The header of a YUV4MPEG2 file."""
    with files.open_input_file(path) as f:
        head = f.read(4096)
        line, _, rest = head.partition(b"\n")
        words = line.split(b" ")
        if words[0] != b"YUV4MPEG2":
            raise ValueError(f"{path} is no YUV4MPEG2 file")
        tags = {x[:1].decode(): x[1:].decode() for x in words[1:] if x}
        chroma = next((c for c in CHROMA if tags.get("C", "420").startswith(c)), None)
        if chroma is None or re.search(r"p\d\d", tags.get("C", "")):
            raise ValueError(f"{path}: frames of format C{tags.get('C')} aren't read")
        lead = rest.find(b"\n") + 1 if rest.startswith(b"FRAME") else 6
        out = Video(path, int(tags["H"]), int(tags["W"]), rate(tags.get("F")), 0, chroma, len(line) + 1, lead)
    out.n = max(length - out.first, 0) // (out.lead + out.size)
    return out


PPM = re.compile(rb"^P6\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s")


def ppm(data: bytes, path: str) -> np.ndarray:
    """An image of three 8-bit channels as blue, green, red."""
    found = PPM.match(data)
    if not found or int(found[3]) != 255:
        raise ValueError(f"{path} is no PPM file of 8 bits")
    w, h = int(found[1]), int(found[2])
    return np.frombuffer(data, np.uint8, 3 * h * w, found.end()).reshape(h, w, 3)[..., ::-1]


def videos(path: str, fps: float) -> list[Video]:
    """The videos at a path: a .y4m file, a folder of .ppm files in the order of their names, or a folder of either."""
    from pyarrow import fs

    files, at = file_system(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.File:
        return [y4m(files, at, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"there is no {path}")
    below = sorted(files.get_file_info(fs.FileSelector(at, recursive=True)), key=lambda x: x.path)
    out = [y4m(files, x.path, x.size) for x in below if x.path.endswith(".y4m")]
    folders: dict[str, list[str]] = {}
    for x in below:
        if x.path.endswith(".ppm"):
            folders.setdefault(posixpath.dirname(x.path), []).append(x.path)
    for folder, names in folders.items():
        with files.open_input_file(names[0]) as f:
            h, w = ppm(f.read(), names[0]).shape[:2]
        out.append(Video(folder, h, w, fps or DEFAULT_RATE, len(names), files=tuple(names)))
    return out


def bgr(video: Video, raw: bytes) -> np.ndarray:
    """A frame's planes as blue, green, red, rounded half up."""
    h, w = video.h, video.w
    luma = np.frombuffer(raw, np.uint8, h * w).reshape(h, w).astype(float)
    across = CHROMA[video.chroma]
    if across is None:
        return np.repeat(luma.astype(np.uint8)[..., None], 3, axis=2)
    cw, ch = -(-w // across[0]), -(-h // across[1])
    planes = [np.frombuffer(raw, np.uint8, ch * cw, h * w + i * ch * cw).reshape(ch, cw).astype(float) - 128 for i in (0, 1)]
    u, v = (np.repeat(np.repeat(p, across[1], axis=0), across[0], axis=1)[:h, :w] for p in planes)
    out = np.stack([luma + 1.772 * u, luma - 0.344136 * u - 0.714136 * v, luma + 1.402 * v], axis=2)
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)


@dataclass
class Frames(InputPartition):
    video: Video
    begin: int
    end: int


class FrameReader(DataSourceReader):
    """Ranges of frames; filters that compare frame_idx or video with constants cut them."""

    def __init__(self, options: dict) -> None:
        self.path, self.fps = options["path"], float(options.get("fps") or 0)
        self.part_bytes = int(options.get("part_bytes") or PART_BYTES)
        self.low, self.high, self.only, self.names = 0, None, None, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            kind, name = type(f), getattr(f, "attribute", ())
            if name == ("frame_idx",) and kind in (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo, In):
                self._cut(kind, f)
            elif name == ("video",) and kind in (EqualTo, In):
                wanted = set(f.value) if kind is In else {f.value}
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def _cut(self, kind: type, f) -> None:
        top = lambda n: n if self.high is None else min(self.high, n)
        if kind is GreaterThan:
            self.low = max(self.low, f.value + 1)
        elif kind is GreaterThanOrEqual:
            self.low = max(self.low, f.value)
        elif kind is LessThan:
            self.high = top(f.value)
        elif kind is LessThanOrEqual:
            self.high = top(f.value + 1)
        else:
            wanted = set(f.value) if kind is In else {f.value}
            self.only = wanted if self.only is None else self.only & wanted

    def ranges(self, n: int) -> list[tuple[int, int]]:
        """Ranges of n frames that the filters leave, from begin to before end."""
        low, high = self.low, n if self.high is None else min(self.high, n)
        if self.only is None:
            return [(low, high)] if low < high else []
        out: list[tuple[int, int]] = []
        for i in sorted(x for x in self.only if x is not None and low <= x < high):
            out[-1:] = [(out[-1][0], i + 1)] if out and out[-1][1] == i else [*out[-1:], (i, i + 1)]
        return out

    def partitions(self) -> list[Frames]:
        out = []
        for video in videos(self.path, self.fps):
            if self.names is not None and video.path not in self.names:
                continue
            step = max(self.part_bytes // max(video.size, 1), 1)
            out += [Frames(video, a, min(a + step, end)) for begin, end in self.ranges(video.n) for a in range(begin, end, step)]
        return out

    def read(self, partition: Frames | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's single partition where none is left
            return
        video = partition.video
        files, _ = file_system(self.path)
        step = max(BATCH_BYTES // max(3 * video.h * video.w, 1), 1)
        for begin in range(partition.begin, partition.end, step):
            numbers = range(begin, min(begin + step, partition.end))
            yield self._batch(video, numbers, [img.tobytes() for img in self._images(files, video, numbers)])

    @staticmethod
    def _images(files, video: Video, numbers: range) -> Iterator[np.ndarray]:
        if video.files:
            for i in numbers:
                with files.open_input_file(video.files[i]) as f:
                    yield ppm(f.read(), video.files[i])
            return
        with files.open_input_file(video.path) as f:
            for i in numbers:
                f.seek(video.first + i * (video.lead + video.size) + video.lead)
                yield bgr(video, f.read(video.size))

    @staticmethod
    def _batch(video: Video, numbers: range, data: list[bytes]) -> pa.RecordBatch:
        n = len(numbers)
        columns = [pa.array([video.path] * n, pa.string()), pa.array(numbers, pa.int64()), pa.array([video.fps] * n, pa.float64()), pa.array([video.h] * n, pa.int32()), pa.array([video.w] * n, pa.int32()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["video", "frame_idx", "fps", "h", "w", "data"])


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


def read_frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """SCHEMA of all videos at a path.  Options: fps of image folders, part_bytes."""
    from tagforge.sources.stage import ship_code

    ship_code(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    return spark.read.format("frames").options(**options).load(path)


def video_rates(spark: SparkSession, path: str, fps: float = 0.0) -> DataFrame:
    """video, fps, n_frames, from headers alone."""
    return spark.createDataFrame([(v.path, v.fps, v.n) for v in videos(path, fps)], "video string, fps double, n_frames long")
