"""Sources, streams and kernels on small inputs."""

import json

from regionspark import plans, sources, streaming


def test_project_scan(spark, tmp_path):
    images = tmp_path / "images"
    (images / "部屋 1").mkdir(parents=True)
    for name in ("b.jpg", "a.PNG", "c.Jpg", "部屋 1/d.png", "notes.txt"):
        (images / name).write_bytes(b"x")
    listed = tmp_path / "images.txt"
    listed.write_text("# comment\n1 0 0 0 0 0 0 0 1 b.jpg\n\n2 0 0 0 0 0 0 0 1 d.png\n1 2 3\n3 short\n\n")
    names = sources.registered_names(spark, str(listed))
    assert [tuple(r) for r in names.orderBy("registration_index").collect()] == [(0, "b.jpg"), (1, "d.png")]
    found = sources.project(sources.image_files(spark, str(images)), names).collect()
    assert [(r.rel_path, r.registered) for r in found] == [("b.jpg", True), ("部屋 1/d.png", True), ("a.PNG", False)]


def test_mask_paths(spark):
    images = spark.createDataFrame([("a.jpg",), ("d/b.jpg",), ("c.png",), ("e.jpg",)], "rel_path string")
    masks = spark.createDataFrame([("a.jpg.png",), ("a.png",), ("d/b.png",), ("c.png",)], "rel_path string")
    found = {r.rel_path: r.mask_path for r in sources.mask_paths(images, masks).collect()}
    assert found == {"a.jpg": "a.jpg.png", "d/b.jpg": "d/b.png", "c.png": "c.png", "e.jpg": None}


def test_event_stream(spark, tmp_path):
    lines = [{"seq": i, "protocol_version": 1 + (i == 4), "status": "error" if i == 2 else "ok", "event": "frame_ready", "job_id": "ab"[i % 2]} for i in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part.json").write_text("\n".join([*map(json.dumps, lines), "not json"]))
    events = streaming.accepted(streaming.worker_events(spark, str(tmp_path / "in")), ["a"], 1)
    query = streaming.job_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("counts").collect()] == [("a", "frame_ready", 2, 2)]
    batch = streaming.is_error(streaming.worker_events(spark, str(tmp_path / "in"), streaming=False))
    assert [r.seq for r in batch.filter("is_error").collect()] == [2]


def test_decision_log(spark):
    log = [(1, "x", "set", "keep"), (2, "x", "set", "remove"), (3, "x", "undo", None), (4, "y", "set", "keep"), (5, "y", "set", "keep"), (6, "y", "undo", None), (7, "z", "undo", None)]
    frame = spark.createDataFrame(log, "seq long, id string, op string, decision string")
    got = {r.id: (r.decision, r.depth) for r in streaming.folded_decisions(frame, ["id"]).collect()}
    assert got == {"x": ("keep", 1), "y": ("unreviewed", 0), "z": ("unreviewed", 0)}


def test_components(spark):
    picture = ["aab", "bab", "bba"]
    rows = [(1, y * 3 + x, x, y, c) for y, line in enumerate(picture) for x, c in enumerate(line)]
    frame = spark.createDataFrame(rows, "image long, k long, x long, y long, label string")
    eight = {r.k: r.component for r in plans.connected_components(frame).collect()}
    four = {r.k: r.component for r in plans.connected_components(frame, diagonal=False).collect()}
    assert len(set(eight.values())) == 2
    assert eight[8] == eight[0]
    assert four[8] != four[0]


def test_small_regions(spark):
    rows = [
        *((1, n, area, c) for n, area, c in ((1, 50, 0.0), (2, 3, 1.0), (3, 2, 1.5), (4, 60, 9.0), (5, 4, 4.5))),
        *((2, n, area, c) for n, area, c in ((1, 2, 0.0), (2, 3, 1.0), (3, 3, 5.0))),
        (3, 7, 1, 2.0),
        *((4, n, area, c) for n, area, c in ((1, 2, 0.0), (2, 2, 4.0), (3, 2, 5.0), (4, 90, 5.5))),
    ]
    edges = [(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 1, 5), (1, 4, 5), (2, 1, 2), (2, 2, 3), (4, 1, 2), (4, 2, 3), (4, 3, 4)]
    regions = spark.createDataFrame(rows, "image long, label long, area long, c double")
    graph = spark.createDataFrame(edges, "image long, a long, b long")
    got = {}
    for r in plans.small_regions_merged(regions, graph, 10, ("c",)).collect():
        got.setdefault(r.image, {})[r.label] = r.merged
    assert got[1] == {1: 1, 2: 1, 3: 4, 4: 4, 5: 1}  # a large neighbour before a nearer small one; of equals the lowest
    assert got[2] == {1: 1, 2: 2, 3: 2}  # 1 and 2 pick each other and stay, 3 joins
    assert got[3] == {7: 7}
    assert got[4] == {1: 4, 2: 4, 3: 4, 4: 4}  # a chain ends in the large one


def test_tree_cut(spark):
    rows = [(1, 1, None, None, 0.0), (1, 2, None, None, 0.0), (1, 3, None, None, 0.0), (1, 4, 1, 2, 0.1), (1, 5, 4, 3, 0.2)]
    frame = spark.createDataFrame(rows, "image long, node_id long, left_id long, right_id long, merge_cost double")
    shown = {n: sorted(r.node_id for r in plans.tree_cut(frame, n).collect()) for n in (1, 2, 3, 9)}
    assert shown == {1: [5], 2: [3, 4], 3: [1, 2, 3], 9: [1, 2, 3]}


def test_merge_small_query(spark):
    """Every region goes to a region of its own image that goes to itself."""
    from regionspark import catalogue

    rows = catalogue.queries()["merge_small"](spark, "/root/testdata/sf0.001").collect()
    goes = {(r.image, r.label): r.merged for r in rows}
    assert len(goes) == len(rows) > 0
    assert all(goes[image, merged] == merged for (image, _), merged in goes.items())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
