"""The source of frames against files made here."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagforge.functions import raster
from tagforge.operators import crops
from tagforge.sources import video


def y4m(path, n, h=6, w=9, chroma="444", rate="25:1", cut=0):
    rng = np.random.default_rng(n)
    across = video.CHROMA[chroma]
    size = h * w + (2 * -(-w // across[0]) * -(-h // across[1]) if across else 0)
    frames = [rng.integers(0, 256, size).astype(np.uint8).tobytes() for _ in range(n)]
    name = {"444": "C444", "422": "C422", "420": "C420jpeg", "mono": "Cmono"}[chroma]
    data = f"YUV4MPEG2 W{w} H{h} F{rate} Ip A1:1 {name}\n".encode() + b"".join(b"FRAME\n" + f for f in frames)
    path.write_bytes(data[: len(data) - cut])
    return frames


def plain(raw, h, w, chroma):
    """Pixel by pixel."""
    across = video.CHROMA[chroma]
    out = np.zeros((h, w, 3), np.uint8)
    for y in range(h):
        for x in range(w):
            u = v = 0
            if across:
                cw, ch = -(-w // across[0]), -(-h // across[1])
                at = h * w + (y // across[1]) * cw + x // across[0]
                u, v = raw[at] - 128, raw[at + cw * ch] - 128
            luma = raw[y * w + x]
            out[y, x] = [min(max(int(np.floor(c + 0.5)), 0), 255) for c in (luma + 1.772 * u, luma - 0.344136 * u - 0.714136 * v, luma + 1.402 * v)]
    return out


@pytest.mark.parametrize("chroma", ["444", "422", "420", "mono"])
def test_y4m(spark, tmp_path, chroma):
    frames = y4m(tmp_path / "a.y4m", 7, 5, 9, chroma, "0:1", cut=3)
    got = video.read_frames(spark, str(tmp_path / "a.y4m"), part_bytes="300").collect()
    assert sorted(r.frame_idx for r in got) == list(range(6))  # the last one is cut off
    assert all((raster.image(bytes(r.data), 5, 9) == plain(frames[r.frame_idx], 5, 9, chroma)).all() and r.fps == 30 for r in got)
    assert tuple(video.video_rates(spark, str(tmp_path / "a.y4m")).first())[1:] == (30, 6)


def test_only_wanted_ranges_are_read(spark, tmp_path, monkeypatch):
    """Pushed filters leave the partitions of wanted frames alone: bytes read are counted."""
    y4m(tmp_path / "a.y4m", 40)
    y4m(tmp_path / "b.y4m", 40, rate="30000:1001")
    a = str(tmp_path / "a.y4m")
    asked = {
        "frame_idx >= 10 AND frame_idx < 13": [10, 11, 12], "frame_idx = 39": [39], "frame_idx IN (3, 4, 5, 20, 99)": [3, 4, 5, 20], "frame_idx > 36 AND frame_idx <= 38": [37, 38],
        "frame_idx BETWEEN 2 AND 4 AND h = 6": [2, 3, 4], "frame_idx > 100": [], "frame_idx IN (1, 2) AND frame_idx IN (2, 3)": [2], "frame_idx % 20 = 1": [1, 21],
    }
    df = video.read_frames(spark, str(tmp_path), part_bytes="1000")
    for where, want in asked.items():
        assert sorted(r.frame_idx for r in df.where(where).where(F.col("video") == a).select("video", "frame_idx").collect()) == want, where
    assert df.where("frame_idx < 2").count() == 4 and {round(r.fps, 3) for r in df.select("fps").distinct().collect()} == {25.0, 29.97}

    def reader(filters):
        r = video.FrameReader({"path": str(tmp_path), "part_bytes": "1000"})
        return r, list(r.pushFilters(filters))

    r, left = reader([video.GreaterThanOrEqual(("frame_idx",), 10), video.LessThan(("frame_idx",), 13), video.EqualTo(("video",), a), video.EqualTo(("h",), 6)])
    assert len(left) == 1 and [(p.video.path, p.begin, p.end) for p in r.partitions()] == [(a, 10, 13)]
    taken = []
    real = video.bgr
    monkeypatch.setattr(video, "bgr", lambda v, raw: taken.append(len(raw)) or real(v, raw))
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 3 and taken == [162] * 3
    r, _ = reader([video.In(("frame_idx",), (3, 4, 5, 20, 99)), video.EqualTo(("video",), a)])
    assert [(p.begin, p.end) for p in r.partitions()] == [(3, 6), (20, 21)]


def test_ppm_folder(spark, tmp_path):
    rng = np.random.default_rng(4)
    made = [rng.integers(0, 256, (4, 5, 3)).astype(np.uint8) for _ in range(3)]
    (tmp_path / "seq").mkdir()
    for i, x in enumerate(made):
        (tmp_path / "seq" / f"{i:03}.ppm").write_bytes(b"P6\n# made here\n5 4\n255\n" + x[..., ::-1].tobytes())
    got = {r.frame_idx: r for r in video.read_frames(spark, f"file://{tmp_path}", fps="12.5").collect()}
    assert all((raster.image(bytes(got[i].data), 4, 5) == x).all() for i, x in enumerate(made)) and got[0].fps == 12.5
    boxes = spark.createDataFrame([(got[0].video, 1)], "video string, frame_idx long")
    sharp = crops.sharpness(video.read_frames(spark, f"file://{tmp_path}"), boxes).collect()
    assert [(r.frame_idx, r.sharpness) for r in sharp] == [(1, pytest.approx(raster.edges(raster.gray(made[1])).var()))]


def test_bad_files(spark, tmp_path):
    (tmp_path / "x.y4m").write_bytes(b"not a video")
    with pytest.raises(Exception, match="x.y4m"):
        video.read_frames(spark, str(tmp_path / "x.y4m")).count()
    with pytest.raises(Exception, match="nowhere"):
        video.read_frames(spark, str(tmp_path / "nowhere.y4m")).count()
    (tmp_path / "deep.y4m").write_bytes(b"YUV4MPEG2 W2 H2 F25:1 C420p10\n")
    with pytest.raises(Exception, match="420p10"):
        video.read_frames(spark, str(tmp_path / "deep.y4m")).count()
    (tmp_path / "none").mkdir()
    assert video.read_frames(spark, str(tmp_path / "none")).count() == 0
