"""Publishing, documents and stores of arrays."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionspark import sinks, sources
from regionspark.functions import documents as doc
from regionspark.operators import frames, raster, state, stores, visible


def rows(spark, path):
    return sorted(r.v for r in spark.read.parquet(path).collect())


def test_publish_and_undo(spark, tmp_path):
    a, b, work = (str(tmp_path / n) for n in ("a", "b", "work"))
    spark.range(3).select(F.col("id").alias("v")).write.parquet(a)
    new = spark.range(10, 12).select(F.col("id").alias("v"))
    record = sinks.publish(spark, [sinks.Target(new, a), sinks.Target(new, b)], work)
    assert rows(spark, a) == rows(spark, b) == [10, 11]
    spark.catalog.refreshByPath(a)
    sinks.undo(spark, record)
    spark.catalog.refreshByPath(a)
    assert rows(spark, a) == [0, 1, 2]
    assert not (tmp_path / "b").exists()


def test_publish_leaves_all_as_it_was_if_one_fails(spark, tmp_path):
    a, b, work = (str(tmp_path / n) for n in ("a", "b", "work"))
    spark.range(3).select(F.col("id").alias("v")).write.parquet(a)
    new = spark.range(10, 12).select(F.col("id").alias("v"))
    with pytest.raises(ValueError, match="not valid"):
        sinks.publish(spark, [sinks.Target(new, a), sinks.Target(new, b, lambda df: df.filter("v = 11"))], work)
    (tmp_path / "file").write_text("x")  # a place that nothing can move into
    with pytest.raises(Exception, match=r"\w"):
        sinks.publish(spark, [sinks.Target(new, a), sinks.Target(new, str(tmp_path / "file" / "inside"))], work)
    assert rows(spark, a) == [0, 1, 2]
    assert not (tmp_path / "b").exists()


def test_documents(spark, tmp_path):
    path = str(tmp_path / "in" / "d.json")
    for n in (1, 2):
        sinks.write_json(spark, path, {"n": n, "名": "é"})
    assert json.loads((tmp_path / "in" / "d.json").read_text()) == {"n": 2, "名": "é"}
    (tmp_path / "in" / "broken.json").write_text("{no")
    found = {r.path.rsplit("/", 1)[-1]: r.document for r in sources.documents(spark, str(tmp_path / "in" / "*.json"), "n long").collect()}
    assert found["d.json"].n == 2
    assert found["broken.json"] is None


def test_logs(spark, tmp_path):
    log = str(tmp_path / "log")
    for n in (1, 2):
        sinks.append_edit_log(spark.createDataFrame([(n, "x")], "seq long, path string"), log)
    assert sorted(r.seq for r in spark.read.option("header", True).csv(log).collect()) == ["1", "2"]
    now = datetime.datetime(2024, 1, 3)
    files = spark.createDataFrame([("a", now - datetime.timedelta(hours=25)), ("b", now - datetime.timedelta(hours=23))], "path string, changed timestamp")
    assert [r.path for r in sinks.old_files(files, F.lit(now)).collect()] == ["a"]


def test_array_stores(spark, tmp_path):
    masks = np.zeros((4, 3, 5), dtype=np.uint8)
    masks[0, 0, :2], masks[1, 1:] = 255, 1
    np.savez(tmp_path / "one.npz", masks=masks, scores=np.array([0.5, 0.9, 0.1, 0.2], dtype=np.float32), request_id=7)
    np.savez(tmp_path / "two.npz", masks=masks, scores=np.array([0.5]), request_id=7)
    (tmp_path / "three.npz").write_bytes(b"no store")
    found = sources.array_stores(spark, str(tmp_path / "*.npz"))
    assert found.filter("problem is not null").count() == 1
    got = [(r["index"], round(r.score, 3), r.foreground, round(r.share, 3)) for r in sources.predictions(found, 7).orderBy("index").collect()]
    assert got == [(0, 0.5, 2, 0.133), (1, 0.9, 10, 0.667), (2, 0.1, 0, 0.0)]
    assert sources.predictions(found, 8).isEmpty()


def test_settings(spark):
    stored = spark.createDataFrame([("a", "12"), ("b", "x"), ("c", "99"), ("z", "1")], "key string, value string")
    got = {r.key: r.value for r in sources.settings(stored, {"a": (1, 0, 50), "b": (2, 0, 50), "c": (3, 0, 50), "d": (4, 0, 50)}).collect()}
    assert got == {"a": 12, "b": 2, "c": 50, "d": 4}


def test_components_and_empty_frames(spark):
    rng = np.random.default_rng(2)
    height, width, runs, want = 7, 9, [], {}
    for sid in range(1, 30):
        mask = rng.random((height, width)) < (0.0 if sid == 5 else 0.35)
        flat = np.flatnonzero(np.diff(np.concatenate([[0], mask.T.ravel().astype(int), [0]])))
        runs += [(1, sid, int(s), int(e)) for s, e in flat.reshape(-1, 2)]
        left, n = {(y, x) for y, x in zip(*np.nonzero(mask), strict=True)}, 0
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                y, x = todo.pop()
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                todo += near
        want[sid] = (int(mask.sum()), n)
    masks = spark.createDataFrame(runs, "image long, sid long, s long, e long")
    members = spark.createDataFrame([(1, sid) for sid in want], "image long, sid long")
    found = frames.metrics(masks, members, height, width)
    assert {r.sid: (r.foreground, r.components) for r in found.collect()} == want
    changed = {r.sid: r for r in frames.changes(masks, found, height).collect()}
    assert (changed[1].area_ratio, changed[1].iou) == (None, None)
    assert (changed[5].area_ratio, changed[5].iou) == (0.0, 0.0)
    assert (changed[6].area_ratio, changed[6].iou) == (None, None)


def test_warning_codes(spark):
    rows = [(0.0, 0, False, 0.0, 0.0, 0), (0.0, 0, False, None, None, 0), (0.9, 11, True, 5.0, 0.9, 99), (0.1, 1, False, 0.2, 0.01, 9)]
    frame = spark.createDataFrame(rows, "share double, components long, edges boolean, ratio double, iou double, n long")
    got = [r.c for r in frame.select(frames.warning_codes(*(F.col(c) for c in ("share", "components", "edges", "ratio", "iou", "n"))).alias("c")).collect()]
    assert got == [["EMPTY_MASK", "LOW_IOU"], ["EMPTY_MASK"], ["TOO_LARGE", "MANY_COMPONENTS", "TOUCHES_ALL_EDGES", "AREA_GROWTH"], ["AREA_DROP", "LOW_IOU"]]


def test_unknown_decisions_and_missing_reviews_are_errors(spark):
    members = spark.createDataFrame([(1, 1)], "image long, sid long")
    with pytest.raises(Exception, match="unknown decision"):
        state.normalised(members, spark.createDataFrame([(1, 1, "maybe")], "image long, sid long, decision string"), ["image", "sid"]).collect()
    runs = spark.createDataFrame([(1, "a", 0, 3), (1, "b", 3, 5)], "image long, label string, s long, e long")
    made = spark.createDataFrame([(1, "a", "keep")], "image long, label string, decision string")
    assert [r.s for r in visible.composed_runs(runs, made, "remove").collect()] == [0]
    with pytest.raises(Exception, match="not reviewed"):
        visible.composed_runs(runs, made).collect()


def test_kernels_and_offsets(spark):
    assert sorted(raster.ellipse(3)) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
    assert len(raster.ellipse(5)) == 17
    frame = spark.createDataFrame([(1, [0, 2, 5], 2, 5), (2, [1, 0], 2, 9)], "image long, offsets array<int>, members int, values int")
    assert sorted((r.image, r.problem) for r in stores.offset_violations(frame).collect()) == [(2, "END"), (2, "LENGTH"), (2, "ORDER"), (2, "START")]
    assert stores.schema_problems(frame, {"image": "bigint", "offsets": "array<bigint>", "x": "int"}) == ["missing x", "type of offsets: array<int>", "extra members", "extra values"]


def test_reference_masks(spark):
    frame = spark.createDataFrame([(1, 4, 5, 0, 3), (2, 4, 5, 1, 0), (3, 3, 5, 0, 15)], "image long, mask_height int, mask_width int, other_values int, foreground int")
    assert {r.image: r.errors for r in frames.reference_errors(frame, 4, 5).collect()} == {1: "", 2: "VALUES,EMPTY", 3: "SIZE,FULL"}
    at = spark.sql("select timestamp'2024-01-02 03:04:05.000006' as t").select(doc.iso_time(F.col("t")).alias("s")).first().s
    assert at == "2024-01-02T03:04:05.000006+00:00"
