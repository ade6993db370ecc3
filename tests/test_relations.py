"""Chains, names, frames, trees and palettes of a time against brute force in plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import chains, edits, export, trees
from pixelmill.operators import pixels as P
from pixelmill.runtime import settled


# ---- chains ----


def walk(nexts, start):
    path = [start]
    while (to := nexts.get(path[-1])) is not None and to in nexts:
        if to in path:
            return path, True
        path.append(to)
    return path, False


def test_chains_against_a_walk(spark):
    rng = random.Random(8)
    rows = []
    for disk in range(3):
        cells = list(range(60))
        for c in cells:  # crossing chains, ends, links out of the disk, loops and closed circles
            rows.append((disk, c, rng.choice([None, 0, 999, *cells, *cells])))
        rows += [(disk, 100, 101), (disk, 101, 102), (disk, 102, 100), (disk, 200, 200)]
    df = spark.createDataFrame(rows, "disk long, cell long, next long").repartition(3)
    want, lost = set(), set()
    for disk in range(3):
        nexts = {c: n for d, c, n in rows if d == disk}
        heads = set(nexts) - {n for n in nexts.values()}
        seen = set()
        for h in heads:
            path, loops = walk(nexts, h)
            want |= {(disk, h, k, c, loops) for k, c in enumerate(path)}
            seen |= set(path)
        lost |= {(disk, c) for c in set(nexts) - seen}
    got = chains.followed(df)
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in chains.unreached(df, got).collect()} == lost and lost

    starts = spark.createDataFrame([(0, 100), (0, 200), (1, 5), (1, 5), (2, 12345)], "disk long, cell long")
    for s, path in (((0, 100), [100, 101, 102]), ((0, 200), [200])):
        some = [tuple(r) for r in chains.followed(df, starts).where((F.col("disk") == s[0]) & (F.col("start") == s[1])).orderBy("position").collect()]
        assert some == [(*s, k, c, True) for k, c in enumerate(path)]
    assert {r["start"] for r in chains.followed(df, starts).collect()} == {100, 200, 5}


def test_a_chain_of_ten_thousand_links(spark):
    order = np.random.default_rng(3).permutation(10_001).tolist()
    cells = spark.createDataFrame(list(zip([7] * 10_000, order, order[1:])), "disk long, cell long, next long")
    last = spark.createDataFrame([(7, order[-1], None)], "disk long, cell long, next long")
    got = [r["cell"] for r in chains.followed(cells.union(last)).orderBy("position").collect()]
    assert got == order


@pytest.mark.parametrize("block", [64, chains.BLOCK])
def test_neighbours_are_followed_without_a_round_for_each_doubling(spark, monkeypatch, block):
    nexts = {c: c + 1 for c in range(3_000)} | {499: None, 999: 0, 1999: 1000, 2500: 2500, 2999: 5}
    written = []

    def count(df):
        out = settled(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(chains, "settled", count)
    monkeypatch.setattr(chains, "BLOCK", block)
    cells = spark.createDataFrame([(4, c, n) for c, n in nexts.items()], "disk long, cell long, next long").repartition(5)
    heads = set(nexts) - set(nexts.values())
    for own in (heads, {500, 1200, 2501}):
        written.clear()
        starts = None if own is heads else spark.createDataFrame([(4, c) for c in own], "disk long, cell long")
        got = {tuple(r) for r in chains.followed(cells, starts).collect()}
        paths = {h: walk(nexts, h) for h in own}
        assert got == {(4, h, k, c, loops) for h, (path, loops) in paths.items() for k, c in enumerate(path)}
        assert sum(written) < 2 * len(nexts)


def test_no_cells(spark):
    assert chains.followed(spark.createDataFrame([], "disk long, cell long, next long")).count() == 0


# ---- names ----


def greedy(names, taken):
    """Names in turn: the first free number of each, where names that files have by themselves are not free for others."""
    own, used, out = set(names), set(taken), []
    for name in names:
        stem = re.sub(r"\.[^.]*$", "", name)
        k = 1
        while True:
            new = name if k == 1 else f"{stem} ({k}){name[len(stem):]}"
            if new not in used and (k == 1 or new not in own):
                break
            k += 1
        used.add(new)
        out.append(new)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unique_names(spark, monkeypatch, seed):
    monkeypatch.setattr(export, "CUTS", 9)
    monkeypatch.setattr(export, "SPAN", 8)
    rng = random.Random(seed)
    kinds = ["a.png", "a (2).png", "a (3).png", "a (2) (2).png", "b", "b (7)", "c.d.e", ".hidden", ".hidden (2)", "a (02).png", "a (1).png", "a ().png", "ü (4).x", "ü.x"]
    kinds += [f"a ({k}).png" for k in range(20, 45)]
    names = [rng.choice(kinds) for _ in range(200)] + ["a.png"] * 150  # one name has most files
    rng.shuffle(names)
    taken = ["a.png", "a (5).png", "b (2)", "zzz", "a (2) (2).png"]
    rows = [(k, n, "x", "y") for k, n in enumerate(names)]
    files = spark.createDataFrame(rows, "k long, out_name string, _j string, _key string").repartition(4)
    there = spark.createDataFrame([(t,) for t in taken], "name string")
    for extra in (None, there):
        got = export.unique_names(files, ["k"], taken=extra)
        assert got.columns == files.columns
        new = [r["out_name"] for r in got.orderBy("k").collect()]
        assert new == greedy(names, taken if extra is not None else [])
        assert len(set(new)) == len(new)
    assert [r["out_name"] for r in export.unique_names(files.repartition(2), ["k"], taken=there).orderBy("k").collect()] == new


def test_names_that_are_null_or_none(spark):
    files = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "k long, out_name string")
    assert sorted(map(tuple, export.unique_names(files, ["k"]).collect()), key=str) == [(1, None), (2, "a"), (3, None)]
    assert export.unique_names(files.where("k > 9"), ["k"]).count() == 0


def test_numbers_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(export, "CUTS", 5)
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(400), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, _range long, k long")
    got = export.numbered(df, ["_range", "k"], ["g"], "place", large=True)
    assert got.columns == ["g", "_range", "k", "place"]
    groups = defaultdict(list)
    for r in got.collect():
        groups[r["g"]].append((r["place"], r["_range"], r["k"]))
    for g, places in groups.items():
        assert [p for p, _, _ in sorted(places)] == list(range(1, len(places) + 1))
        assert [(a, b) for _, a, b in sorted(places)] == sorted((a, b) for n, a, b in rows if n == g)


def test_export_keeps_every_image(spark, tmp_path):
    pixels = [bytes([k] * 12) for k in range(4)]
    images = spark.createDataFrame([("x.scr", 2, 2, bytearray(pixels[0])), ("x.koa", 2, 2, bytearray(pixels[1])), ("y", 2, 2, bytearray(pixels[2]))], "name string, width int, height int, pixels binary")
    (tmp_path / "x (2).png").write_bytes(b"mine")
    export.export_images(images, str(tmp_path), ["png", "tiff"], ["name"])
    found = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    assert sorted(found) == ["x (2).png", "x (2).tiff", "x (3).png", "x.png", "x.tiff", "y.png", "y.tiff"]
    assert found["x (2).png"] == b"mine" and found["x.png"] == export.png(np.frombuffer(pixels[1], np.uint8).reshape(2, 2, 3))
    export.export_images(images, str(tmp_path), ["png"], ["name"], overwrite=True)
    assert (tmp_path / "x (2).png").read_bytes() == export.png(np.frombuffer(pixels[0], np.uint8).reshape(2, 2, 3))
    assert len(list(tmp_path.iterdir())) == 7


def test_export_of_catalogue_files(spark, tmp_path):
    rows = [("d", "A/HELLO", 0, "HELLO", 0xFC, False, bytearray(b"1")), ("d", "HELLO", 1, "HELLO", 0x02, False, bytearray(b"2")), ("d", "A", 2, "A", 0x0F, True, None)]
    rows += [("d", "PIC", 3, "PIC", 0xC1, False, bytearray(b"3")), ("d", "T", 4, "T", 4, False, bytearray(b"4")), ("d", "N.X", 5, "N.X", 0, False, bytearray(b"5")), ("e", "PIC", 0, "PIC", 0xC1, False, bytearray(b"6"))]
    entries = spark.createDataFrame(rows, "disk_path string, entry_path string, ord int, name string, file_type int, is_directory boolean, content binary")
    export.export_entries(entries, entries.where("entry_path <> 'T'"), str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"HELLO.bas": b"1", "HELLO (2).bas": b"2", "PIC.dat": b"3", "PIC (2).dat": b"6", "N.X": b"5"}


# ---- frames ----


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(export, "BUCKET", 50)
    images = spark.createDataFrame([(m, k) for m, n in ((1, 5), (2, 1), (3, 40)) for k in range(n)], "movie long, image long")
    times = export.timeline(images, ["movie"], ["image"], 2.0, key="image")
    got = defaultdict(list)
    for r in export.frames_at(export.frame_numbers(times, ["movie"]), times, ["movie"], "image").orderBy("movie", "frame").collect():
        got[r["movie"]].append((r["frame"], r["image"], r["next_key"], r["alpha"]))
    for movie, n in ((1, 5), (2, 1), (3, 40)):
        want = []
        for k in range(n):
            last = k == n - 1
            want += [(k, None, 0.0)] * (60 if last else 45) + [(k, k + 1, t / 15) for t in range(1, 16) if not last]
        assert got[movie] == [(f, *w) for f, w in enumerate(want)]
    asked = spark.createDataFrame([(1, 44), (1, 45), (1, 10_000), (9, 0), (1, 45)], "movie long, frame long")
    assert sorted((r["frame"], r["next_key"]) for r in export.frames_at(asked, times, ["movie"], "image").collect()) == [(44, None), (45, 1), (45, 1)]
    assert {r["frame"] for r in export.frames_at(asked, times, ["movie"], "image").collect()} == {44, 45}


def test_pictures_are_rendered_once(spark):
    a, b = np.full((2, 2, 3), 200, np.uint8), np.full((1, 2, 3), 100, np.uint8)
    images = spark.createDataFrame([("a", 2, 2, bytearray(a.tobytes())), ("b", 2, 1, bytearray(b.tobytes()))], "image string, width int, height int, pixels binary")
    times = export.timeline(images.select(F.lit(1).alias("movie"), "image"), ["movie"], ["image"], 1.0, key="image")
    frames = export.frames_at(export.frame_numbers(times, ["movie"]), times, ["movie"], "image")
    got = {(r["image"], r["next_key"], round(r["alpha"] * 15)): r["pixels"] for r in export.rendered(frames, images, "image", 4, 4).collect()}
    assert frames.count() == 60 and len(got) == 17
    assert got["a", None, 0] == P.upscale(a, 2).tobytes() and got["a", "b", 7] == export.blend(a, b, 7 / 15, 4, 4).tobytes()


# ---- trees ----


def test_tree_sizes(spark):
    rng = random.Random(9)
    paths = ["/".join(rng.choice("abc") + rng.choice(["", "é", "-"]) for _ in range(rng.randint(1, 6))) for _ in range(300)] + ["top", None, "x//y", "deep/" * 30 + "f"]
    rows = [(p, rng.randint(0, 99) if k % 11 else None) for k, p in enumerate(paths)]
    sums = defaultdict(lambda: [0, 0, 0])
    for p, size in rows:
        parts = (p or "").split("/")[:-1]
        for n in range(len(parts) + 1):
            s = sums[tuple(parts[:n])]
            s[0] += n == len(parts)
            s[1] += 1
            s[2] += size or 0
    order = sorted(sums, key=lambda d: [x.encode() for x in d])
    want = {("/".join(d), len(d), *sums[d], k, k + sum(e[: len(d)] == d for e in order) - 1) for k, d in enumerate(order, 1)}
    got = trees.tree_sizes(spark.createDataFrame(rows, "path string, size long").repartition(3))
    assert {tuple(r) for r in got.collect()} == want
    root = next(w for w in want if w[1] == 0)
    assert root[3] == len(rows) and root[5:] == (1, len(want))


# ---- palettes ----


@pytest.mark.parametrize("cuts", [0, 3, 40])
def test_palettes_at(spark, monkeypatch, cuts):
    monkeypatch.setattr(export, "CUTS", cuts)
    rng = random.Random(5)
    log = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randint(0, 60), k, rng.randrange(5), rng.randrange(1 << 24)) for k in range(400)]
    shown = [(k, rng.choice(["hot", "a", "b", "none"]), rng.randint(-3, 65)) for k in range(80)]
    want = set()
    for picture, key, at in shown:
        palette = {}
        for _, _, slot, rgb in sorted((t, s, slot, rgb) for k, t, s, slot, rgb in log if k == key and t <= at):
            palette[slot] = rgb
        want |= {(picture, slot, rgb) for slot, rgb in palette.items()}
    edit_rows = spark.createDataFrame(log, "image string, ts long, seq long, slot int, rgb int").repartition(3)
    pictures = spark.createDataFrame(shown, "picture long, image string, ts long")
    assert {tuple(r) for r in edits.palettes_at(pictures, edit_rows, "image", "picture").collect()} == want
    assert edits.palettes_at(pictures, edit_rows.where("seq < 0"), "image", "picture").count() == 0


# ---- columns of any name ----


def test_columns_with_helpers_names(spark):
    from pixelmill.operators import images

    names = ["_k", "_n", "_last", "_copied", "_target", "_chosen", "_key", "_cuts", "_range", "_size", "_first", "_some"]
    rows = [(i, f"n{i % 3}.png", i * 2, [i], 1, 1, bytearray(b"abc"), *range(len(names))) for i in range(6)]
    df = spark.createDataFrame(rows, "image_id long, name string, seq long, palette array<int>, width int, height int, pixels binary, " + ", ".join(f"{n} int" for n in names))
    some = df.select("image_id").where("image_id < 2")
    outs = [
        edits.first_wins(df, F.col("name"), ["seq"]), edits.undo_log(df), edits.undone(df, some), edits.pasted(df, some, 3), edits.selected(df, some), edits.selected_or_current(df, some, None),
        export.numbered(df, ["seq"]), export.renamed(df, "{n}-{name}", ["seq"]), export.screensaver_names(df, ["seq"]), export.export_plan(df, ["png"]), images.transformed(df, ("invert",)),
    ]
    for out in outs:
        assert out.columns[: len(df.columns)] == df.columns
        assert out.count() and all(r[n] == k for r in out.collect() for k, n in enumerate(names))
