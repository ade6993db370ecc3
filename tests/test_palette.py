"""Median cut against a plain version, and imports of files that come back."""

import random

import pytest
from pyspark.sql import functions as F

from pixelmill.operators import median_cut
from pixelmill.streaming import watch


def plain_cut(colors, levels):
    boxes = {0: colors}
    for _ in range(levels):
        out = {}
        for box, own in boxes.items():
            parts = [[(c >> s) & 255 for c in own] for s in (16, 8, 0)]
            lengths = [max(p) - min(p) for p in parts]
            k = lengths.index(max(lengths))
            if not lengths[k]:
                out[2 * box] = own
                continue
            values = sorted(zip(parts[k], own.values()))
            whole, up, last = sum(own.values()), 0, None
            for v in sorted(set(parts[k]))[:-1]:
                up = sum(n for x, n in values if x <= v)
                last = v
                if up * 2 >= whole:
                    break
            shift = 16 - 8 * k
            out[2 * box] = {c: n for c, n in own.items() if (c >> shift) & 255 <= last}
            out[2 * box + 1] = {c: n for c, n in own.items() if (c >> shift) & 255 > last}
        boxes = out
    return boxes


@pytest.mark.parametrize("kind", ["many", "few", "one", "hot"])
def test_median_cut(spark, kind):
    rng = random.Random(kind)
    n = {"many": 900, "few": 5, "one": 1, "hot": 300}[kind]
    colors = {rng.randrange(1 << 24) & (0xFF0FFF if kind == "hot" else 0xFFFFFF): rng.randint(1, 50) for _ in range(n)}
    if kind == "hot":
        colors[0x123456] = 100_000  # one colour is most of the pixels
    df = spark.createDataFrame(list(colors.items()), "rgb int, n long")
    got, cuts = median_cut.global_palette(df, levels=4)
    want = plain_cut(colors, 4)
    rows = {r["box"]: (r["rgb"], r["n"], r["colors"]) for r in got.collect()}
    assert rows.keys() == want.keys()
    for box, own in want.items():
        total = sum(own.values())
        mean = [(2 * sum(((c >> s) & 255) * n for c, n in own.items()) + total) // (2 * total) for s in (16, 8, 0)]
        assert rows[box] == (mean[0] << 16 | mean[1] << 8 | mean[2], total, len(own))
    index = {r["rgb"]: r["box"] for r in df.select("rgb", cuts.box(F.col("rgb")).alias("box")).collect()}
    assert all(index[c] == box for box, own in want.items() for c in own)


def test_no_colors(spark):
    assert median_cut.global_palette(spark.createDataFrame([], "rgb int, n long"), 3)[0].count() == 0


def test_import_once(spark, tmp_path):
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    (folder / "sub").mkdir(parents=True)

    def run():
        files = watch.new_files(spark, str(folder), times=True)
        watch.import_once(files, table, checkpoint).trigger(availableNow=True).start().awaitTermination()
        return {(r["name"], r["size"]) for r in watch.seen(spark, table).collect()}

    (folder / "a.scr").write_bytes(b"picture")
    (folder / "b.scr").write_bytes(b"another")
    (folder / "copy of a.scr").write_bytes(b"picture")
    first = run()
    assert len(first) == 2 and ("b.scr", 7) in first
    (folder / "a.scr").rename(folder / "sub" / "moved.scr")
    (folder / "c.scr").write_bytes(b"third one")
    (folder / "b2.scr").write_bytes(b"another")
    assert run() == first | {("c.scr", 9)}
    assert run() == first | {("c.scr", 9)}


def test_a_trigger_that_runs_again(spark, tmp_path):
    table = str(tmp_path)
    schema = "path string, name string, ext string, size long, modified timestamp, digest string"
    one = spark.createDataFrame([("/p", "p", "", 1, None, "x"), ("/a", "a", "", 1, None, "x"), ("/q", "q", "", 2, None, "y")], schema)
    two = spark.createDataFrame([("/r", "r", "", 1, None, "x"), ("/s", "s", "", 3, None, "z")], schema)
    for batch, k in ((one, 0), (one, 0), (two, 1), (two, 1)):
        watch.keep_new(batch, k, table)
    assert sorted((r["digest"], r["name"], r["batch_id"]) for r in watch.seen(spark, table).collect()) == [("x", "a", 0), ("y", "q", 0), ("z", "s", 1)]
