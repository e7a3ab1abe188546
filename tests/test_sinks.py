"""Drawings and crop files, with tasks that fail."""

import re

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from strandline.operators import labels, rasters
from strandline.sources import sinks


def test_drawings_hold_every_frame_in_order(spark, tmp_path):
    rows = [(f"s{s}", f, 10.0 * k, 5.0, 10.0 * k + 8, 25.0, f"{k}|<X>|7:0.1") for s in range(3) for f in range(30) for k in range(2)] + [("s0", 30, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "sequence_id string, frame_idx long, x1 double, y1 double, x2 double, y2 double, label string").repartition(5)
    labels.draw_frames(df, f"{tmp_path}/out", 100, 50)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["s0.svg", "s1.svg", "s2.svg"]
    for s, n in (("s0", 31), ("s1", 30)):
        text = (tmp_path / "out" / f"{s}.svg").read_text()
        assert [int(x) for x in re.findall(r'id="frame(\d+)"', text)] == list(range(n)) and text.count("<rect") == 60 and "0|&lt;X&gt;|7:0.1" in text
        assert re.findall(r'begin="([\d.]+)s"', text)[:3] == ["0", "0.04", "0.08"] and text.endswith("</svg>\n")
    labels.draw_frames(df.limit(0), f"{tmp_path}/none")
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").iterdir())


def test_crops_are_named_sampled_and_readable(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows, pictures = [], {}
    for track, n in ((1, 25), (2, 3)):
        for i in range(n):
            pixels = rng.integers(0, 256, (6, 4, 3), np.uint8)
            pictures[track, 100 + i] = pixels
            rows.append((track, 2 * i, 100 + i, "7" if track == 1 else None, rasters.as_raster(pixels) if (track, i) != (2, 1) else None))
    df = spark.createDataFrame(rows, f"track_id long, idx int, frame_idx long, truth string, crop {rasters.RASTER}").repartition(3)
    labels.save_crops(df, f"{tmp_path}/crops")
    names = sorted(p.name for p in (tmp_path / "crops").iterdir())
    assert names == [f"track0001_frame{100 + 2 * i:05d}_gt7.png" for i in range(10)] + [f"track0002_frame{f:05d}_gtNone.png" for f in (100, 102)]
    for r in rasters.images(spark, f"{tmp_path}/crops", "png").collect():
        track, frame = map(int, re.search(r"track(\d+)_frame(\d+)", r["path"]).groups())
        assert (rasters.as_array(r["image"]) == pictures[track, frame]).all()


def test_failed_tasks_leave_nothing_behind(spark, tmp_path):
    spark.dataSource.register(sinks.Files)
    rows = spark.range(0, 40, 1, 4).select(F.format_string("f%02d.bin", "id").alias("name"), F.col("id").cast("string").cast("binary").alias("content"))

    def failing(batches):
        for batch in batches:
            yield batch
            if TaskContext.get().partitionId() == 3:
                raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        rows.mapInArrow(failing, rows.schema).write.format("strandline_files").mode("append").save(f"{tmp_path}/out")
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    rows.write.format("strandline_files").mode("append").save(f"{tmp_path}/out")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"f{i:02d}.bin": str(i).encode() for i in range(40)}
    for bad, why in ((F.lit("same.bin"), "one name"), (F.lit("../x"), "no name")):
        with pytest.raises(Exception, match=why):
            rows.withColumn("name", bad).write.format("strandline_files").mode("append").save(f"{tmp_path}/bad")
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())
