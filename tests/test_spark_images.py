"""Files through Spark: scan, classify, decode, recolour, disks, PNG sink and stream."""

import numpy as np
from pyspark.sql import functions as F

from pixelmill.functions import palettes as C
from pixelmill.operators import edits, export, images
from pixelmill.operators.classify import classify, is_disk
from pixelmill.sources.disks import counts, disk_entries
from pixelmill.sources.raw import modern_images, raw_files
from pixelmill.streaming.watch import new_images
from tests.test_formats import fat_disk

RNG = np.random.default_rng(3)


def test_classifier_order(spark):
    body = lambda n, head=b"": head + bytes(n - len(head))
    cases = [
        ("a.png", body(10), "modern"), ("a.gr5", body(7680), "msx5"), ("a.bbm2", body(20480), "bbc2"), ("a.pi3", body(32066), "coco3_320"), ("a.pi1", body(32034), "degas"), ("a.gr9", body(7680), "gr9"),
        ("x", body(100, b"\x89PNG"), "modern"), ("x", body(100, b"BM"), "bmp"), ("x", body(200, b"\x0a"), "pcx"), ("p#c00001", body(900), "shr_packed"), ("p#c10002", body(38400), "shr3200"),
        ("x", body(50, b"FORM"), "iff"), ("x", body(10000), "plus4"), ("x", body(10003, b"\0\x60"), "koala"), ("x", body(10003, b"\1\1"), "plus4"), ("x", body(10006), "koala"), ("x", body(10018), "art_studio"),
        ("x", body(9009), "c64_hires"), ("x", body(9002), "art_studio_hires"), ("x", body(6912), "zx"), ("x", body(3060), "vic20"), ("a.scr", body(16384), "cpc"), ("x", body(16384), "dhgr"), ("x", body(32000), "coco3_320"),
        ("x", body(32768, b"\xff" * 32), "shr"), ("x", body(600), "paintworks"), ("x", body(30000, b"\xff" * 32), "coco3_320"), ("x", body(50000, b"\xff" * 40)[:38000], "macpaint"), ("x", body(38400), "shr3200"), ("x", body(8192), "hgr"), ("a.mac", body(600), "macpaint"), ("x", body(6144), "pmode4"), ("x", b"", None), ("x", body(77), None),
    ]
    df = spark.createDataFrame([(i, n, bytearray(c)) for i, (n, c, _) in enumerate(cases)], "id int, name string, content binary")
    got = {r["id"]: r["kernel"] for r in classify(df).collect()}
    assert [got[i] for i in range(len(cases))] == [k for _, _, k in cases]


def test_files_to_images_and_back(spark, tmp_path):
    zx = RNG.integers(0, 256, 6912).astype(np.uint8).tobytes()
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "screen.dat").write_bytes(zx)
    (tmp_path / ".hidden").write_bytes(zx)
    (tmp_path / "empty.dat").write_bytes(b"")
    (tmp_path / "disk.st").write_bytes(fat_disk()[0])
    files = raw_files(spark, str(tmp_path))
    assert {r["name"] for r in files.select("name").collect()} == {"screen.dat", "disk.st"}
    pictures = files.where(~is_disk(F.col("name"), F.col("content")))
    image = images.decoded(pictures).collect()
    assert [(r["family"], r["width"], r["height"]) for r in image] == [("ZXSpectrum", 256, 192)]
    assert image[0]["palette"][1] == 0x0000D7
    red = images.decoded(files.where("name = 'screen.dat'"), F.array(*(F.lit(0xFF0000) for _ in range(16)))).first()
    assert set(np.frombuffer(red["pixels"], np.uint8).reshape(-1, 3).sum(0).tolist()) == {255 * 256 * 192, 0}
    entries = disk_entries(files)
    assert {r["entry_path"] for r in entries.collect()} == {"PICTURE.PI1", "LOOP.BIN"}
    assert counts(entries).first()["files"] == 2
    out = export.png_files(images.decoded(pictures), 2).first()
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.png").write_bytes(out["content"])
    back = modern_images(spark, str(tmp_path / "out")).first()
    bgr = np.frombuffer(back["pixels"], np.uint8).reshape(384, 512, 3)
    assert (bgr[::2, ::2, ::-1].reshape(-1) == np.frombuffer(image[0]["pixels"], np.uint8)).all()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(bytes(6912))
    q = new_images(spark, str(tmp_path / "in")).select("name", "family").writeStream.format("memory").queryName("seen_images").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("seen_images").collect()] == [("a", "ZXSpectrum")]


def test_edits_and_plans(spark):
    rows = spark.createDataFrame([(f"i{k}", f"n{k}.scr") for k in range(4)], "image_id string, name string")
    one = rows.where("image_id = 'i1'")
    assert edits.selected(rows, one).count() == 1 and edits.deleted(rows, one).count() == 3
    assert edits.selected_or_current(rows, one.limit(0), "i2").count() == 1 and edits.selected_or_current(rows, one.limit(0), None).count() == 4
    log = spark.createDataFrame([("i1", s) for s in range(12)] + [("gone", 1)], "image_id string, seq long")
    assert edits.undo_log(log).count() == 11 and edits.undone(log, rows).count() == 12
    assert edits.toggled(log).select("image_id").first()[0] == "gone"
    assert [r["path"] for r in edits.recent(spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "path string, seq long")).collect()] == ["a", "b"]
    plan = export.export_plan(rows, ["png", "gif"])
    assert plan.count() == 8 and plan.where("sharing > 1").count() == 0
    assert [r["out_name"] for r in export.renamed(rows, "{n}_{name}", ["image_id"]).orderBy("image_id").collect()][0] == "1_n0"
    t = export.timeline(rows.withColumn("g", F.lit(1)), ["g"], ["image_id"], 2.0).orderBy("image_id").collect()
    assert [(r["shown"], r["changing"], r["first_frame"]) for r in t] == [(45, 15, 0), (45, 15, 60), (45, 15, 120), (60, 0, 180)]
    assert rows.select(images.with_color(F.array(F.lit(1), F.lit(2)), 1, 9)).first()[0] == [1, 9]
    assert C.hex_string((1, 2, 255)) == "#0102FF"
