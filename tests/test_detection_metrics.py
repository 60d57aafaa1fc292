"""Average precision against a plain loop over predictions in order of confidence."""

from __future__ import annotations

import random

import pytest

from tagforge.operators import detection_metrics as metrics


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = w * h if w > 0 and h > 0 else 0.0
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return common / (area(a) + area(b) - common)


def plain(predictions, truths, level):
    """(image, label, id, conf, box) and (image, label, id, box) -> label: the row."""
    out = {}
    for label in {p[1] for p in predictions} | {t[1] for t in truths}:
        own = sorted((p for p in predictions if p[1] == label), key=lambda p: (p[3] is None, -(p[3] or 0), p[2]))
        free = {t[2]: t for t in truths if t[1] == label}
        n, hits = len(free), []
        for p in own:
            near = [(-overlap(p[4], t[3]), i) for i, t in free.items() if t[0] == p[0] and None not in p[4] and overlap(p[4], t[3]) >= level]
            hits.append(bool(near))
            if near:
                free.pop(min(near)[1])
        points = [(sum(hits[: i + 1]), sum(hits[: i + 1]) / (i + 1)) for i, h in enumerate(hits) if h]
        area = sum(max((p for k, p in points if k * 100 // n >= g), default=0.0) for g in range(101)) / 101 if n else None
        out[label] = (n, len(own), sum(hits), sum(hits) / len(own) if own else None, sum(hits) / n if n else None, area)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_average_precision(spark, seed):
    """Crowds in which many predictions want the same truths, boxes over many cells, ties, labels of one side only, bad boxes."""
    rng = random.Random(seed)
    truths, predictions = [], []
    box = lambda: (x := rng.uniform(-20, 60), y := rng.uniform(0, 60), x + rng.uniform(10, 60), y + rng.uniform(10, 60))
    for i in range(60):
        truths.append((rng.randrange(4), rng.choice(["a", "b", "c"]), i, box()))
    for i in range(200):
        t = rng.choice(truths)
        moved = tuple(v + rng.uniform(-6, 6) for v in t[3])
        predictions.append((t[0], t[1], 1000 + i, rng.choice([0.1, 0.5, 0.5, 0.9, round(rng.random(), 3), None]), moved))
    predictions += [(0, "only predicted", 5000, 0.5, (0.0, 0.0, 9.0, 9.0)), (0, "a", 5001, 0.99, (None, 0.0, 9.0, 9.0)), (0, "a", 5002, 0.98, (5.0, 5.0, 5.0, 9.0))]
    truths.append((0, "only true", 900, (0.0, 0.0, 9.0, 9.0)))
    frame = lambda rows, more: spark.createDataFrame([(*r[:-1], *r[-1]) for r in rows], f"image long, label string, id long, {more}x1 double, y1 double, x2 double, y2 double")
    levels = (0.3, 0.5, 0.8)
    out = metrics.average_precision(frame(predictions, "conf double, ").repartition(5), frame(truths, ""), levels, cell=rng.choice([7, 40, 1000]), parts=3)
    rows = out.collect()
    for level in levels:
        want = plain(predictions, truths, level)
        got = {r.label: tuple(r)[2:] for r in rows if r.level == level}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    area = {(r.label, r.level): r.average_precision for r in rows if r.average_precision is not None}
    mean = metrics.mean_average_precision(out).first()
    assert mean.map_all == pytest.approx(sum(area.values()) / len(area)) and mean.map_least == pytest.approx(sum(v for (_, x), v in area.items() if x == 0.3) / 4)


def test_no_boxes(spark):
    none = spark.createDataFrame([], "image long, label string, id long, conf double, x1 double, y1 double, x2 double, y2 double")
    assert metrics.average_precision(none, none.drop("conf")).count() == 0
