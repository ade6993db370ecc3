"""File types, disk entries to images, transforms, numbering, writers and further decoders."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import palettes as C
from pixelmill.operators import classify, decoders, edits, export, filetypes, images
from pixelmill.operators import pixels as P
from pixelmill.sources import disks
from tests.test_formats import fat_disk

RNG = np.random.default_rng(11)


def noise(n):
    return RNG.integers(0, 256, n).astype(np.uint8)


def test_atari_colors_follow_the_registers():
    assert C.ATARI.shape == (128, 3) and decoders.atari_palette(np.array([0x0E, 0x46], np.uint8)).tolist() == [[0xDC] * 3, [0xAA, 0x4C, 0x58]]
    screen = bytes(range(256)) * 30
    assert decoders.decode("gr15", screen).palettes[0].tolist() == C.ATARI[[0, 2, 4, 7]].tolist()
    assert decoders.decode("gr9", screen + b"\x42").palettes[0].tolist() == C.ATARI[[32 + k // 2 for k in range(16)]].tolist()
    assert decoders.decode("gr11", screen).palettes[0].tolist() == C.ATARI[[h * 8 + 3 for h in range(16)]].tolist()
    assert decoders.decode("gr10", screen).palettes[0].tolist() == C.ATARI[[0, 1, 2, 3, 4, 5, 6, 7, 7]].tolist()
    assert decoders.decode("mic", screen + bytes([2, 4, 6, 8])).palettes[0].tolist() == C.ATARI[[0, 2, 4, 7]].tolist()
    assert decoders.decode("mic", screen + bytes([2, 4, 6, 8]) + bytes(36)).palettes[0].tolist() == C.ATARI[[1, 2, 3, 4]].tolist()


def test_msx_screen_1_pixel_by_pixel():
    b = noise(7 + 768 + 2048 + 20)
    b[0] = 0xFE
    p, v = decoders.decode("msx1", b.tobytes()), b[7:]
    for y, x in RNG.integers(0, 192, (60, 2)).tolist():
        code = int(v[y // 8 * 32 + x // 8])
        ink = int(v[2816 + code // 8]) if code // 8 < 20 else 0xF1
        color = ink >> 4 if v[768 + code * 8 + y % 8] >> (7 - x % 8) & 1 else ink & 15
        assert p.indices[y, x] == (color or 1)


def test_artifact_and_vic20_programs():
    assert decoders.decode("pmode4_artifact", bytes([0b00011011] * 6144)).indices[0, :8].tolist() == [0, 0, 1, 1, 2, 2, 3, 3]
    data = np.concatenate([np.arange(506) % 256, np.full(506, 2), np.zeros(2048)]).astype(np.uint8).tobytes()
    stub = bytes([1, 0x12]) + bytes(12) + bytes([0xA9, 0x5E, 0x8D, 0x0F, 0x90]) + bytes(42)
    assert set(decoders.decode("vic20", data).indices.ravel().tolist()) == {0}
    assert set(decoders.decode("vic20", stub + data).indices.ravel().tolist()) == {5}
    assert decoders.decode("vic20", stub + data[:506] + bytes([255]) * 506 + data[1012:]) is None
    striped = data[:1012] + bytes([0xF0]) * 2048
    whole = decoders.decode("vic20", stub + striped).indices
    assert set(whole.ravel().tolist()) == {2, 5}
    # with more behind it, the colours at the end are none, and the codes that count up tell where the screen is
    assert (decoders.decode("vic20", stub + striped + bytes([0xF0]) * 379).indices == whole).all()


def test_content_tests_at_their_bounds():
    block = np.repeat(np.array([0x00, 0x55, 0xAA, 0xFF], np.uint8), 1536)
    assert classify.pmode_3_or_4(np.full(6144, 0b00111100, np.uint8)) == "pmode4"
    assert classify.pmode_3_or_4(np.repeat(np.array([0x05, 0x0F, 0x3F, 0xC0], np.uint8), 1536)) == "pmode3"
    assert classify.pmode_3_or_4(block) == "pmode4"
    rows = np.full((200, 160), 0x11, np.uint8)
    assert classify.coco3_320_or_640(np.where(np.arange(200)[:, None] % 2, 0xEE, rows).astype(np.uint8).ravel()) == "coco3_320"
    rows[:101:2] = 0xEE  # rows beyond the first hundred are alike, and are not compared
    assert classify.coco3_320_or_640(rows.ravel()) == "coco3_320"
    rows[40:101] = 0xEE  # now most of the first hundred are alike, which makes the third point
    assert classify.coco3_320_or_640(rows.ravel()) == "coco3_640"


def test_neochrome_and_cut_atari_names_are_routed(spark):
    cases = [("a.neo", 32128, "neochrome"), ("a.gr10", 7689, "gr10"), ("a.gr1", 7689, "gr10"), ("a.gr1", 7684, "gr15"), ("a.sc1", 3000, "msx1"), ("a.mic", 7720, "mic")]
    df = spark.createDataFrame([(i, n, bytearray(s)) for i, (n, s, _) in enumerate(cases)], "id int, name string, content binary")
    got = {r["id"]: r["kernel"] for r in classify.classify(df).collect()}
    assert [got[i] for i in range(len(cases))] == [k for _, _, k in cases]


def test_prodos_types(spark):
    rows = spark.createDataFrame([(0xC0, 0x0002), (0xC0, 0x1234), (0xC3, 0), (0x99, 5), (0x04, None)], "file_type int, aux int")
    got = {(r["file_type"], r["aux"]): r["type_info"] for r in filetypes.with_prodos_type(rows).collect()}
    assert got[0xC0, 2]["description"] == "Apple Preferred Format" and got[0xC0, 0x1234]["short_name"] == "PNT" and got[0xC0, 2]["is_graphics"]
    assert not got[0xC3, 0]["is_graphics"] and got[0x99, 5]["description"] == "Type $99" and got[0x99, 5]["category"] == "Unknown"
    assert got[0x04, None]["short_name"] == "TXT" and len(got) == 5
    types = filetypes.prodos_types(spark)
    assert types.count() == types.select("file_type", "aux").distinct().count()


def test_labels_and_entry_kernels(spark):
    cases = [
        ("Atari ST", "d.st", "A.NEO", 32128, 0, "NEOchrome", "neochrome"), ("Atari ST", "d.st", "A.PI3", 32034, 0, "Degas", "degas"), ("Atari ST", "d.st", "A.XYZ", 50, 0, "XYZ", None),
        ("Atari ST", "d.st", "A", 50, 0, "Unknown", None), ("MSX", "d.dsk", "A.SC5", 27136, 0, "MSX Screen 5", "msx5"), ("ATR", "d.atr", "A.GR1", 7689, 0, "Graphics 10 (9 colors)", "gr10"),
        ("BBC Micro", "d.ssd", "PIC", 20480, 0x3000, "Screen (20KB)", "bbc1"), ("BBC Micro", "mode_2.ssd", "PIC", 20489, 0x3000, "Screen (20KB)", "bbc2"),
        ("BBC Micro", "d.ssd", "PIC", 10240, 0x5800, "Screen (10KB)", "bbc5"), ("BBC Micro", "d.ssd", "MODE4A", 10240, 0, "Screen (10KB)", "bbc4"), ("BBC Micro", "d.ssd", "X", 10, 0, "Binary", None),
        ("D64", "d.d64", "X", 10003, 0, None, "koala"),
    ]
    df = spark.createDataFrame([(i, f, d, n, bytearray([200] * s), a) for i, (f, d, n, s, a, _, _) in enumerate(cases)], "id int, f string, d string, n string, c binary, a int")
    got = df.select("id", filetypes.type_label(*map(F.col, "f n c a".split())).alias("label"), filetypes.entry_kernel(*map(F.col, "f d n c".split())).alias("kernel")).orderBy("id").collect()
    assert [(r["label"], r["kernel"]) for r in got] == [(label, k) for *_, label, k in cases]


def test_bbc_disk_info(spark):
    b = bytearray(102400)
    b[:8], b[256:260], b[261], b[262], b[263] = b"PICTURES", b" 1\0x", 16, 0x31, 0x20
    df = spark.createDataFrame([("a", b), ("b", bytearray(9))], "path string, content binary")
    assert [tuple(r) for r in filetypes.bbc_disk_info(df).orderBy("path").collect()] == [("a", "PICTURES 1", 2, 1, 3 * 256 + 32), ("b", "", 0, 0, 0)]


def dos_order_disk():
    """ProDOS directory at sector 11 down; a file of one block, an indexed one, one as a run, and a name twice."""
    image = np.zeros((35, 16, 256), np.uint8)
    blocks = {}
    entry = lambda kind, name, key, size: (bytes([kind << 4 | len(name)]) + name.ljust(15, b"\0") + bytes([6]) + struct.pack("<HH", key, 1) + size.to_bytes(3, "little") + bytes(15)).ljust(39, b"\0")
    head = (bytes([0xF4]) + b"DISK".ljust(15, b"\0")).ljust(39, b"\0")
    blocks[2] = bytes(4) + head + entry(1, b"ONE", 20, 300) + entry(2, b"MANY", 24, 700) + entry(1, b"ONE", 21, 9) + entry(2, b"RUN", 200, 600)
    index = bytearray(512)
    index[0], index[1] = 30, 31
    blocks |= {20: b"o" * 512, 24: bytes(index), 30: b"a" * 512, 31: b"b" * 512}
    for k, body in blocks.items():
        body = np.frombuffer(body.ljust(512, b"\0"), np.uint8)
        for half in (0, 1):
            at = k * 2 + half
            image[at // 16, disks.REVERSED[at % 16]] = body[half * 256 : half * 256 + 256]
    raw = bytearray(image.tobytes())
    raw[200 * 512 : 200 * 512 + 1024] = bytes(256) + b"\xee" * 768  # no index in any order
    return bytes(raw)


def test_prodos_in_dos_order():
    name, found = disks.catalogue(dos_order_disk())
    assert name == "Apple II" and [e.name for e in found] == ["ONE", "MANY", "RUN"]
    assert found[0].content == b"o" * 300 and found[1].content == b"a" * 512 + b"b" * 188 and found[2].content == bytes(256) + b"\xee" * 344


def test_sector_orders_are_permutations():
    b = noise(143360)
    assert sorted(disks.SECTOR_ORDER) == sorted(disks.REVERSED) == list(range(16))
    moved = disks.permuted(b, disks.SECTOR_ORDER).reshape(35, 16, 256)
    assert all((moved[t, disks.SECTOR_ORDER[s]] == b.reshape(35, 16, 256)[t, s]).all() for t in (0, 34) for s in range(16))
    assert disks.to_prodos_order(b.tobytes()) == moved.tobytes()


def test_disk_entries_become_images(spark):
    disk = bytearray(fat_disk()[0])
    files = spark.createDataFrame([("/x/d.st", "d.st", disk)], "path string, name string, content binary")
    entries = disks.disk_entries(files)
    assert disks.counts(entries, F.col("name").endswith("PI1")).select("files", "images", "directories").first() == (2, 1, 0)
    assert [(r["name"], r["family"]) for r in images.imported(entries).collect()] == [("LOOP.BIN", "TRS80")]  # by its 1,024 bytes; 2,500 are no picture
    screen = bytes([0, 0]) + noise(32032).tobytes()
    made = entries.where("name = 'PICTURE.PI1'").withColumn("content", F.lit(bytearray(screen)))
    got = images.imported(made).collect()
    assert [(r["family"], r["name"], r["width"]) for r in got] == [("Degas", "PICTURE.PI1", 320)]
    assert images.imported(made, made.where("false")).count() == 0


def test_all_images_below_a_folder(spark, tmp_path):
    picture = noise(30 * 20 * 3).reshape(20, 30, 3)
    (tmp_path / "a.png").write_bytes(export.png(picture))
    (tmp_path / "b.dat").write_bytes(noise(6912).tobytes())
    (tmp_path / "c.txt").write_bytes(b"no image")
    got = {r["name"]: r for r in images.opened(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.png", "b.dat"] and got["a.png"]["family"] == "Modern" and got["b.dat"]["family"] == "ZXSpectrum"
    assert got["a.png"]["pixels"] == picture.tobytes() and not got["a.png"]["editable"]


def test_transforms_of_chosen_images(spark):
    a, b = noise(4 * 6 * 3).reshape(4, 6, 3), noise(3 * 2 * 3).reshape(3, 2, 3)
    df = spark.createDataFrame([("a", 6, 4, bytearray(a.tobytes())), ("b", 2, 3, bytearray(b.tobytes())), ("n", 1, 1, None)], "name string, width int, height int, pixels binary")
    got = {r["name"]: r for r in images.transformed(df, ("rotate", 1), ("invert",), ("crop", (0, 0), (3, 2)), where=F.col("name") != "b").collect()}
    want = P.crop(P.invert(P.rotate(a)), (0, 0), (3, 2))
    assert (got["a"]["width"], got["a"]["height"], got["a"]["pixels"]) == (3, 2, want.tobytes())
    assert got["b"]["pixels"] == b.tobytes() and got["n"]["pixels"] is None
    with pytest.raises(ValueError):
        images.transformed(df, ("sharpen",))


def test_numbers_of_a_whole_list(spark):
    names = [f"n{k:04d}" for k in RNG.permutation(3000)] + ["n0007"] * 5
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = export.numbered(df, ["name"]).collect()
    assert sorted(r["n"] for r in got) == list(range(1, len(names) + 1))
    assert [r["name"] for r in sorted(got, key=lambda r: r["n"])] == sorted(names)
    plan = export.numbered(df, ["name"])._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_range" in plan
    assert export.numbered(df.where("false"), ["name"]).count() == 0
    assert export.screensaver_names(df.where("name < 'n0002'"), ["name"]).orderBy("name").first()["out_name"] == "001_n0000.png"


def test_writers(spark, tmp_path):
    picture = noise(5 * 7 * 3).reshape(5, 7, 3)
    df = spark.createDataFrame([("a.scr", 7, 5, bytearray(picture.tobytes()))], "name string, width int, height int, pixels binary")
    files = export.image_files(df, "tiff", 2).withColumn("name", F.concat("name", F.lit(".tiff")))
    written = [tuple(r) for r in export.save_files(files, str(tmp_path / "out")).collect()]
    raw = (tmp_path / "out" / "a.tiff").read_bytes()
    assert written == [("a.tiff", len(raw))]
    count = struct.unpack_from("<H", raw, 8)[0]
    tags = {t: (v if k == 4 else v & 0xFFFF) for t, k, _, v in (struct.unpack_from("<HHII", raw, 10 + 12 * i) for i in range(count))}
    assert (tags[256], tags[257], tags[279]) == (14, 10, 420) and raw[tags[273] :] == P.upscale(picture, 2).tobytes()
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.tiff"]


def test_blended_frames_and_durations(spark):
    a, b = np.full((2, 2, 3), 200, np.uint8), np.full((1, 2, 3), 100, np.uint8)
    assert export.blend(a, b, 0.0, 4, 4).tolist() == P.upscale(a, 2).tolist()
    full = export.blend(a, b, 1.0, 4, 4)
    assert full[0].max() == 0 and (full[1:3] == 100).all()
    df = spark.createDataFrame([("x", 2, 2, bytearray(a.tobytes()), 2, 1, bytearray(b.tobytes()), 1.0)], "name string, width int, height int, pixels binary, next_width int, next_height int, next_pixels binary, alpha double")
    assert export.blended(df, 4, 4).first()["pixels"] == full.tobytes()
    texts = spark.createDataFrame([(7.9,), (60.0,), (187.2,)], "s double").select(export.duration_text(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in texts] == ["7s", "1m 0s", "3m 7s"]


def test_transitions_and_names(spark):
    df = spark.createDataFrame([("fade",), ("slide_left",), ("wipe_left",), ("zoom_in",)], "kind string")
    got = {r["kind"]: r["f"] for r in df.select("kind", export.transition_frame(F.col("kind"), F.lit(0.25), 100, 50).alias("f")).collect()}
    assert got["fade"]["alpha"] == 0.25 and got["slide_left"]["dx"] == 75.0 and got["wipe_left"]["clip"] == 0.25 and got["zoom_in"]["zoom"] == 0.25
    kinds = spark.range(300).select(export.random_transition(F.col("id")).alias("k"))
    assert {r["k"] for r in kinds.distinct().collect()} == set(export.TRANSITIONS)
    one = spark.createDataFrame([("PIC", 0xC1, 2)], "n string, t int, a int")
    assert one.select(export.name_with_type(F.col("n"), F.col("t"), F.col("a"))).first()[0] == "PIC#c10002"
    line = F.array(*(F.lit(k) for k in range(6)))
    assert one.select(images.palette_for_line(line, 2, F.array(F.lit(0), F.lit(2)), F.lit(1))).first()[0] == [4, 5]
    assert classify.filtered_by_platform(spark.createDataFrame([("AmstradCPC",), ("MSX",)], "family string"), "cpc").count() == 1


def test_palettes_are_copied_and_reset(spark):
    own = spark.createDataFrame([("a", [1, 2]), ("b", [3, 4]), ("c", [5, 6])], "image_id string, palette array<int>")
    to = spark.createDataFrame([("b",), ("b",)], "image_id string")
    got = {r["image_id"]: r["palette"] for r in edits.pasted(own, to, "a").collect()}
    assert got == {"a": [1, 2], "b": [1, 2], "c": [5, 6]}
    assert {r["image_id"]: r["palette"] for r in edits.pasted(own, to, "none").collect()}["b"] == [3, 4]
    assert edits.palettes_reset(own, to).count() == 2 and edits.cleared(own).count() == 0


def test_frames_are_not_broadcast(spark):
    """A few rows of a time line make many frames, which Spark's estimate of their size does not show."""
    rows = spark.createDataFrame([(i // 3, i) for i in range(30)], "movie long, picture long")
    times = export.timeline(rows, ["movie"], ["picture"], 3.0, key="picture")
    frames = export.frames_at(export.frame_numbers(times, ["movie"], 7), times, ["movie"], "picture")
    assert "Broadcast" not in frames._jdf.queryExecution().executedPlan().toString()
    assert frames.count() == 10 * len(range(0, 270, 7))


def test_kernels_hand_on_bounded_batches(monkeypatch):
    monkeypatch.setattr(P, "ROWS", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([bytes(range(30))] * 50)], names=["key", "blob"])
    run = P._over_blobs(lambda b: (b.astype(np.int64),), ["key", "v"], [pa.int64()])
    got = list(run(iter([batch])))
    assert [b.num_rows for b in got] == [120] * 12 + [60]
    assert [k for b in got for k in b.column("key").to_pylist()] == [k for k in range(50) for _ in range(30)]
