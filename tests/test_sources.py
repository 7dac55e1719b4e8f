import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwarden.constants import Params
from listwarden.schemas import PHOTOS, RAW_PHOTOS, struct as typed
from listwarden.sources import annotations as A
from listwarden.sources import images as I
from listwarden.sources import labels as L
from listwarden.sources import tables as S
from listwarden.streaming.ingest import ingest_new_shards
from listwarden.streaming.scoring import run_available, score_stream


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW_PHOTOS)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_photo_rows(spark):
    df = raw(spark, [
        ("a/x.png", [[0, 0, 100, 50], [10, 10, 1, 50], [-5, 4000, 300, 100]], [1, 2, 3], 4032, 3024, 6),
        ("y.jpg", None, None, 640, 480, 0),
    ])
    first, second = A.photo_rows(df, "train").orderBy("file").collect()
    assert (first.file, first.width, first.height, first.orig_size) == ("x.jpg", 960, 1280, [3024, 4032])
    assert first.labels == [1, 3] and first.n_dropped_boxes == 1 and first.exif_orientation == 6
    assert first.boxes[1] == [0.0, pytest.approx(1269.8), pytest.approx(93.7), 1280.0]
    assert second.boxes == [] and second.exif_orientation == 1 and second.width == 640
    items = A.photo_items(A.photo_rows(df, "train")).collect()
    assert [(i.item_id, i.label) for i in items] == [("x_0", 1), ("x_1", 3)]


def test_unequal_boxes_and_labels_fail(spark):
    for labels in ([1], [1, 2, 3]):
        with pytest.raises(Exception, match="differ in length"):
            A.photo_rows(raw(spark, [("x.png", [[0, 0, 9, 9], [1, 1, 9, 9]], labels, 40, 30, 1)]), "train").collect()
    uneven = spark.createDataFrame([("x.jpg", [[0., 0., 9., 9.]], [1, 2])], "file string, boxes array<array<double>>, labels array<int>")
    with pytest.raises(Exception, match="differ in length"):
        A.photo_items(uneven).collect()


def test_json_lines(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    line = {"file": "đ.jpg", "width": 5, "labels": [1], "note": "kept", "n": 3}
    (path / "a.jsonl").write_text("\n" + json.dumps(line, ensure_ascii=False) + "\n\n", encoding="utf-8")
    back = A.read_jsonl(spark, str(path), PHOTOS).collect()
    assert len(back) == 1 and back[0].file == "đ.jpg" and back[0].height is None
    (path / "b.jsonl").write_text(json.dumps({"other": 1}) + "\n" + json.dumps({"file": None}) + "\n")
    assert A.read_jsonl(spark, str(path), PHOTOS).count() == 3
    for bad in ("{no json", json.dumps({"width": "wide"})):
        (tmp_path / "bad.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
            A.read_jsonl(spark, str(tmp_path / "bad.jsonl"), PHOTOS).collect()
    (path / "b.jsonl").unlink()
    extra = A.read_open_jsonl(spark, str(path), "file STRING, width INT, labels ARRAY<INT>").first()
    assert extra.width == 5 and extra.extra == {"note": "kept", "n": "3"}
    out = str(tmp_path / "out")
    A.write_jsonl(spark.createDataFrame([("đ",)], "file string"), out)
    assert "đ" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))
    assert A.read_allowlists(spark, str(tmp_path / "missing")).count() == 0


def test_map_and_labelled_photos(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"l1": ["a.jpg", "b.jpg"], "l2": ["b.jpg"]}, indent=1))
    pairs = A.read_map(spark, str(path))
    assert sorted((r.allowlist_id, r.photo_id) for r in pairs.collect()) == [
        ("l1", "a.jpg"), ("l1", "b.jpg"), ("l2", "b.jpg")]
    from listwarden.operators.catalog import photo_list

    photos = spark.createDataFrame([("a.jpg", [1]), ("b.jpg", [2]), ("c.jpg", []), ("d.jpg", [3])],
                                   "file string, labels array<int>")
    got = {r.file: r.allowlist_id for r in A.labelled_photos(photos, photo_list(pairs)).collect()}
    assert got == {"a.jpg": "l1", "b.jpg": "l2", "d.jpg": None}


def test_shards(spark, tmp_path):
    for i in range(3):
        spark.range(i, i + 1).select(F.col("id").alias("k")).toPandas().to_parquet(tmp_path / f"train-{i}.parquet")
    spark.range(9, 10).select(F.col("id").alias("k")).toPandas().to_parquet(tmp_path / "test-0.parquet")
    read = lambda **kw: sorted(r.k for r in A.read_shards(spark, str(tmp_path), "train", "k LONG", **kw).collect())
    assert read() == [0, 1, 2] and read(first=2) == [0, 1]


def test_frozen_split_and_tables(spark, tmp_path):
    path = str(tmp_path / "split")
    calls = []

    def make():
        calls.append(1)
        return (spark.createDataFrame([("p", f"s{len(calls)}")], "photo_id string, subset string"),
                spark.createDataFrame([(4,)], "class_id int"))

    assert S.frozen_split(spark, path, make)[0].first().subset == "s1"
    assert S.frozen_split(spark, path, make)[0].first().subset == "s1" and len(calls) == 1
    assert S.frozen_split(spark, path, make, force=True)[0].first().subset == "s2"
    scenarios = spark.createDataFrame([("p#clean", "clean", "p", None, [1], [])],
                                      "scenario_id string, kind string, photo_id string, allowlist_id string, "
                                      "listed array<int>, removed array<int>")
    told = spark.createDataFrame([("p#clean", 0, 1, "in", "listed")],
                                 "scenario_id string, item_idx int, label int, gt string, reason string")
    S.save_scenarios(scenarios, told, str(tmp_path / "sc"))
    a, b = S.load_scenarios(spark, str(tmp_path / "sc"))
    assert rows(a) == rows(scenarios) and rows(b) == rows(told)


def test_params(spark, tmp_path):
    params = Params(temperature=0.08, platt_b=0.5)
    S.save_params(spark, params, str(tmp_path / "p"))
    assert S.load_params(spark, str(tmp_path / "p")) == params
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "p.json").write_text('{"temperature": 0.1, "surprise": 3}')
    assert S.load_params(spark, str(tmp_path / "q")) == Params(temperature=0.1)


def test_label_lines(spark, tmp_path):
    items = spark.createDataFrame([("p", 1, 0., 0., 10., 20.), ("p", 0, 5., 5., 5., 9.), ("p", 2, 10., 0., 30., 20.)],
                                  "photo_id string, item_idx int, x1 double, y1 double, x2 double, y2 double")
    photos = spark.createDataFrame([("p", 100, 50), ("q", 10, 10)], "photo_id string, width int, height int")
    lines = L.label_lines(items, photos)
    assert {(r.photo_id, r.item_idx): r.line for r in lines.collect()} == {
        ("p", 1): "0 0.050000 0.200000 0.100000 0.400000", ("p", 2): "0 0.200000 0.200000 0.200000 0.400000", ("q", None): ""}
    by_subset = spark.createDataFrame([("p", "val")], "photo_id string, subset string")
    L.write_labels(lines, by_subset, str(tmp_path / "table"))
    assert {(r.photo_id, r.subset) for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {("p", "val"), ("q", "train")}
    L.write_label_files(lines, str(tmp_path / "labels"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "labels" / "photo_id=p").glob("*.txt")))
    assert text.splitlines()[0].startswith("0 0.05") and len(text.splitlines()) == 2
    split = spark.createDataFrame([("a.jpg", "train"), ("b.jpg", "val")], "photo_id string, subset string")
    L.write_path_lists(L.path_lists(split, "data"), str(tmp_path / "lists"))
    assert "data/images/b.jpg" in "".join(f.read_text() for f in (tmp_path / "lists" / "subset=val").glob("*.txt"))


def png(pixels):
    height, width = pixels.shape[:2]
    raw_rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(height))
    chunk = lambda kind, data: (struct.pack(">I", len(data)) + kind + data
                                + struct.pack(">I", zlib.crc32(kind + data)))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw_rows)) + chunk(b"IEND", b"")


def test_image_crops(spark, tmp_path):
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (40, 60, 3), dtype=np.uint8)
    (tmp_path / "p.png").write_bytes(png(pixels))
    (tmp_path / "broken.png").write_bytes(b"no image")
    items = spark.createDataFrame([("p.png", "p_0", 1, 10., 10., 26., 26.), ("p.png", "p_1", 2, -30., -30., -20., -20.),
                                   ("broken.png", "b_0", 3, 0., 0., 4., 4.), ("gone.png", "g_0", 3, 0., 0., 4., 4.)],
                                  "photo_id string, item_id string, label int, x1 double, y1 double, x2 double, y2 double")
    crops = I.item_crops(I.read_images(spark, str(tmp_path)), items, size=16, context=0.0)
    assert {r.item_id for r in crops.collect() if r.data is None} == {"b_0", "g_0"}
    got = {r.item_id: np.frombuffer(r.data, np.uint8).reshape(16, 16, 3) for r in crops.filter("data is not null").collect()}
    assert (got["p_0"] == pixels[10:26, 10:26]).all() and (got["p_1"] == 114).all()
    scored = I.score_crops(crops, lambda x: x.reshape(len(x), -1)[:, :4])
    assert scored.count() == 2
    assert all(np.linalg.norm(r.embedding) == pytest.approx(1, abs=1e-5) for r in scored.collect())


def test_windows_and_inputs():
    flat = np.full((7, 5, 3), 9, np.uint8)
    whole = [[0, 0, 5, 7]]
    assert (I.sample_windows(flat, whole, 13, 4) == 9).all() and (I.sample_windows(flat, whole, 7, 5)[0] == flat).all()
    edge = I.sample_windows(flat, [[-5, 0, 5, 7]] * 20, 7, 10)
    assert edge.shape == (20, 7, 10, 3) and (edge[:, :, :5] == 114).all() and (edge[:, :, 5:] == 9).all()
    ramp = np.repeat(np.arange(0, 40, 10, dtype=np.uint8)[None, :, None], 3, axis=2).repeat(2, axis=0)
    assert I.sample_windows(ramp, [[0, 0, 4, 2]], 2, 8)[0, 0, :, 0].tolist() == [0, 3, 8, 13, 18, 23, 28, 30]
    assert I.embed_input(flat[None]).shape == (1, 3, 7, 5) and I.detector_input(flat[None]).max() == np.float32(9 / 255)


def test_stream_ingest_resumes(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()

    def shard(i):
        df = raw(spark, [(f"{i}_{j}.jpg", [[0, 0, 9, 9]], [j], 100, 100, 1) for j in range(3)])
        df.toPandas().to_parquet(tmp_path / "in" / f"train-{i}.parquet")

    shard(0)
    for done in (3, 3):
        ingest_new_shards(spark, source, "train", RAW_PHOTOS, A.photo_rows, out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == done
    shard(1)
    ingest_new_shards(spark, source, "train", RAW_PHOTOS, A.photo_rows, out, mark, files_per_trigger=1).awaitTermination()
    table = spark.read.parquet(out)
    assert table.count() == 6 and table.select("file").distinct().count() == 6
    assert typed(PHOTOS).names == table.columns


def test_stream_scoring_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(f"p{i % 4}", f"d{i}", rng.normal(size=4).tolist()) for i in range(20)]
    schema = "photo_id string, det_id string, embedding array<double>"
    dets = spark.createDataFrame(data, schema)
    dets.repartition(2).write.parquet(str(tmp_path / "dets"))
    lists = spark.createDataFrame([("p0", [0]), ("p1", [1, 9]), ("p2", []), ("p3", None)],
                                  "photo_id string, listed array<int>")
    protos = spark.createDataFrame([(c, 0, np.eye(4)[c].tolist()) for c in range(3)],
                                   "class_id int, proto_no int, vector array<double>")
    batch = score_stream(dets, lists, protos, Params())
    stream = score_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "dets")), lists, protos, Params())
    run_available(stream, str(tmp_path / "scored"), str(tmp_path / "mark")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "scored")).select(batch.columns)) == rows(batch)
