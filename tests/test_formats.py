"""Codecs, decoders and disk readers on small blobs that the tests build themselves."""

import struct
import zlib

import numpy as np
import pytest

from pixelmill.functions import codecs
from pixelmill.functions import palettes as C
from pixelmill.operators import classify, decoders, export
from pixelmill.operators import pixels as P
from pixelmill.sources import disks

RNG = np.random.default_rng(11)


def blob(n):
    return RNG.integers(0, 256, n).astype(np.uint8)


# ---- codecs: written by tiny encoders, read back ----


def literals(data, most, head):
    return b"".join(bytes([head(len(data[i : i + most]))]) + data[i : i + most] for i in range(0, len(data), most))


def test_round_trips():
    data = blob(1000).tobytes()
    assert codecs.pack_bytes(literals(data, 64, lambda n: n - 1)) == data
    assert codecs.pack_bytes(bytes([0x40 | 4, 7, 0x80 | 1, 1, 2, 3, 4, 0xC0 | 1, 9])) == bytes([7] * 5 + [1, 2, 3, 4] * 2 + [9] * 8)
    assert codecs.pack_bits(literals(data, 128, lambda n: n - 1)) == data
    assert codecs.pack_bits(bytes([254, 5, 128, 0, 6])) == bytes([5, 5, 5, 6])
    assert codecs.pack_bits(bytes([128, 6]), run_of_128=True) == bytes([6] * 129)
    assert codecs.pcx_rle(bytes([0xC3, 200, 5]), 10) == bytes([200] * 3 + [5])
    assert codecs.lzw(b"") is None


def lzw_encode(data):
    table, width, out, acc, held, last = {bytes([i]): i for i in range(256)}, 9, bytearray(), 0, 0, b""
    nxt = 258

    def put(code):
        nonlocal acc, held
        acc |= code << held
        held += width
        while held >= 8:
            out.append(acc & 255)
            acc >>= 8
            held -= 8

    for c in data:
        if last + bytes([c]) in table:
            last += bytes([c])
            continue
        put(table[last])
        if nxt < 4096:
            table[last + bytes([c])] = nxt
            nxt += 1
            if nxt - 1 >= 1 << width and width < 12:
                width += 1
        last = bytes([c])
    put(table[last])
    put(257)
    put(0)
    return bytes(out)


@pytest.mark.parametrize("data", [b"abababababababab" * 3, bytes(range(200)), b"x" * 300])
def test_lzw(data):
    assert codecs.lzw(lzw_encode(data)) == data


@pytest.mark.parametrize("f", [codecs.pack_bytes, codecs.pack_bits, codecs.lzw, lambda b: codecs.pcx_rle(b, 500)])
def test_truncated_input(f):
    data = blob(60).tobytes()
    for n in range(len(data)):
        f(data[:n])


# ---- decoders ----


def test_zx():
    b = blob(6912)
    rgb = decoders.zx(b).colors()
    for y in range(0, 192, 7):
        for x in range(0, 256, 11):
            at = (y // 64) * 2048 + (y % 8) * 256 + (y % 64 // 8) * 32 + x // 8
            a = int(b[6144 + y // 8 * 32 + x // 8])
            ink = (a & 7 if b[at] >> 7 - x % 8 & 1 else a >> 3 & 7) + (8 if a & 64 else 0)
            assert tuple(rgb[y, x]) == tuple(C.ZX[ink])
    assert decoders.zx(b[:-1]) is None


def test_koala():
    b = blob(10003)
    rgb = decoders.KERNELS["koala"](b).colors()
    assert rgb.shape == (200, 320, 3)
    for y in range(0, 200, 13):
        for x in range(0, 320, 17):
            cell = y // 8 * 40 + x // 8
            pair = b[2 + cell * 8 + y % 8] >> 6 - x % 8 // 2 * 2 & 3
            index = [b[10002] & 15, b[8002 + cell] >> 4, b[8002 + cell] & 15, b[9002 + cell] & 15][pair]
            assert tuple(rgb[y, x]) == tuple(C.C64[index])


def test_hgr():
    b = blob(8192)
    rgb = decoders.hgr(b).colors()
    for y in range(0, 192, 11):
        line = b[(y & 7) * 1024 + (y >> 3 & 7) * 128 + (y >> 6) * 40 :][:40]
        on = [int(v >> k & 1) for v in line for k in range(7)] + [0]
        for x in range(280):
            high = line[x // 7] >> 7
            if on[x] == on[x + 1]:
                want = on[x]
            else:
                own = on[x] == 1
                want = ((5 if own else 4) if high else (3 if own else 2)) if x % 2 == 0 else ((4 if own else 5) if high else (2 if own else 3))
            assert tuple(rgb[y, x]) == tuple(C.HGR[want])


def test_shr_lines_choose_palettes():
    b = blob(32768)
    b[32000:32200] &= 15
    p = decoders.shr(b)
    rgb = p.colors()
    for y in range(0, 200, 19):
        at = 32256 + 32 * int(b[32000 + y])
        for x in range(0, 320, 23):
            n = int(b[y * 160 + x // 2] >> (4 if x % 2 == 0 else 0) & 15)
            low, high = int(b[at + 2 * n]), int(b[at + 2 * n + 1])
            assert tuple(rgb[y, x]) == ((high & 15) * 17, (low >> 4) * 17, (low & 15) * 17)
    changed = p.palettes.copy()
    changed[:] = 9
    assert (p.colors(changed) == 9).all()


def test_hold_and_modify_is_the_sequential_fold():
    index, palette = RNG.integers(0, 64, (8, 40)), RNG.integers(0, 256, (16, 3))
    got = decoders.hold_and_modify(index, palette, 6)
    for y in range(8):
        r, g, b = palette[0]
        for x in range(40):
            c, v = index[y, x] >> 4, index[y, x] & 15
            if c == 0:
                r, g, b = palette[v]
            elif c == 1:
                b = v * 17
            elif c == 2:
                r = v * 17
            else:
                g = v * 17
            assert tuple(got[y, x]) == (r, g, b)


def test_bmp_and_pcx():
    rgb = RNG.integers(0, 256, (5, 3, 3)).astype(np.uint8)
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" * 3 for r in rgb[::-1])
    file = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IIIHHIIIIII", 40, 3, 5, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (decoders.decode("bmp", file).colors() == rgb).all()
    head = bytearray(128)
    head[0], head[3], head[65] = 10, 8, 3
    head[8:12] = struct.pack("<HH", 2, 4)
    head[66:68] = struct.pack("<H", 3)
    body = b"".join(bytes([0xC1, int(v)]) for y in range(5) for c in range(3) for v in rgb[y, :, c])
    assert (decoders.decode("pcx", bytes(head) + body).colors() == rgb).all()


def test_degas_and_ilbm_planes():
    index = RNG.integers(0, 16, (200, 320)).astype(np.uint8)
    words = np.stack([np.packbits(index >> p & 1, axis=1).reshape(200, 20, 2) for p in range(4)], 2)
    palette = RNG.integers(0, 256, 32).astype(np.uint8)
    p = decoders.decode("degas", b"\0\0" + palette.tobytes() + words.tobytes())
    assert (p.indices == index).all() and (p.palettes[0] == C.words_st(palette, 0)).all()
    chunk = lambda tag, body: tag + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)
    planes = np.stack([np.packbits(index >> k & 1, axis=1) for k in range(4)], 1)
    cmap = RNG.integers(0, 256, (16, 3)).astype(np.uint8)
    body = chunk(b"BMHD", struct.pack(">HHHHBBBBHBBHH", 320, 200, 0, 0, 4, 0, 1, 0, 0, 1, 1, 320, 200)) + chunk(b"CMAP", cmap.tobytes()) + chunk(b"BODY", literals(planes.tobytes(), 128, lambda n: n - 1))
    assert (decoders.decode("iff", b"FORM" + struct.pack(">I", len(body) + 4) + b"ILBM" + body).colors() == cmap[index]).all()


@pytest.mark.parametrize("name", sorted(decoders.KERNELS))
def test_kernels_survive_any_size(name):
    for n in (1, 2, 127, 128, 1023, 1024, 3060, 6143, 6144, 6912, 7680, 7689, 8192, 9002, 10003, 10018, 10240, 16384, 16512, 20480, 32000, 32016, 32034, 32768, 38400, 54272):
        decoders.decode(name, blob(n).tobytes())


def test_content_tests():
    assert classify.cpc_or_dhgr(np.zeros(16384, np.uint8)) == "dhgr"
    assert classify.cpc_or_dhgr(blob(16384)) == "cpc"
    assert classify.coco3_320_or_640(blob(32016)) == "coco3_640" and classify.coco3_320_or_640(np.zeros(32016, np.uint8)) == "coco3_320"
    assert classify.pmode_3_or_4(np.zeros(6144, np.uint8)) == "pmode4"


def test_geometry():
    image = RNG.integers(0, 256, (6, 9, 3)).astype(np.uint8)
    turned = image
    for _ in range(4):
        turned = P.rotate(turned)
    assert (turned == image).all() and (P.flip(P.flip(image, True), True) == image).all() and (P.invert(P.invert(image)) == image).all()
    assert P.crop(image, (5, 4), (2, 1)).shape == (3, 3, 3) and P.crop(image, (2, 2), (2, 5)) is None
    assert (P.upscale(image, 3)[::3, ::3] == image).all() and (P.resize_nearest(image, 18, 12) == P.upscale(image, 2)).all()
    assert (P.adjust(image) == image).all() and P.adjust(image, 1.0).min() == 255
    raw = export.png(image)
    assert zlib.decompress(raw[41 : 41 + struct.unpack(">I", raw[33:37])[0]])[1:28] == image[0].tobytes()


# ---- disks ----


def fat_disk(oem=b"      "):
    b = bytearray(737280)
    b[3:9], b[11:13], b[13], b[14:16], b[16], b[17:19], b[21], b[22:24] = oem, struct.pack("<H", 512), 2, struct.pack("<H", 1), 2, struct.pack("<H", 112), 0xF9, struct.pack("<H", 3)
    body = bytes(i % 251 for i in range(2500))
    data = (1 + 6) * 512 + 112 * 32
    for k, c in enumerate((2, 4, 6)):  # a chain with gaps
        b[data + (c - 2) * 1024 : data + (c - 1) * 1024] = body[k * 1024 : (k + 1) * 1024].ljust(1024, b"\0")
    fat = [0xFF9, 0xFFF, 4, 0, 6, 0, 0xFFF, 7]
    raw = b"".join(bytes([x & 255, x >> 8 | (y & 15) << 4, y >> 4]) for x, y in zip(fat[::2], fat[1::2]))
    b[512 : 512 + len(raw)] = raw
    b[2048 : 2048 + len(raw)] = raw
    e = lambda name, attr, first, size: name + bytes([attr]) + bytes(14) + struct.pack("<HI", first, size)
    root = (1 + 6) * 512
    b[root : root + 96] = e(b"PICTURE PI1", 0, 2, 2500) + e(b"\xe5ONE    PI1", 0, 2, 5) + e(b"LOOP    BIN", 0, 7, 4000)
    return bytes(b), body


def test_fat():
    raw, body = fat_disk()
    name, found = disks.catalogue(raw)
    assert [e.name for e in found] == ["LOOP.BIN", "PICTURE.PI1"] and found[1].content == body and len(found[0].content) == 1024
    assert disks.catalogue(fat_disk(b"MSX   ")[0])[0] == "MSX"


def test_d64():
    b = bytearray(174848)
    at = lambda t, s: (t - 1) * 21 * 256 + s * 256 if t <= 17 else (17 * 21 + (t - 18) * 19) * 256 + s * 256
    b[at(18, 1) : at(18, 1) + 2] = bytes([0, 255])
    b[at(18, 1) + 2 : at(18, 1) + 5] = bytes([0x82, 1, 0])
    b[at(18, 1) + 5 : at(18, 1) + 21] = b"PIC".ljust(16, b"\xa0")
    b[at(1, 0) : at(1, 0) + 256] = bytes([1, 5]) + bytes(range(254))
    b[at(1, 5) : at(1, 5) + 256] = bytes([0, 11]) + bytes(range(10)) + bytes(244)
    name, found = disks.catalogue(bytes(b))
    assert name == "D64" and found[0].name == "PIC" and found[0].content == bytes(range(254)) + bytes(range(10))


def test_prodos_with_directory_and_holes():
    b = bytearray(143360)
    blk = lambda k: slice(k * 512, k * 512 + 512)
    entry = lambda kind, name, ftype, key, size, aux: (bytes([kind << 4 | len(name)]) + name.ljust(15, b"\0") + bytes([ftype]) + struct.pack("<HH", key, 1) + size.to_bytes(3, "little") + bytes(7) + struct.pack("<H", aux)).ljust(39, b"\0")
    head = bytes([0xF4]) + b"DISK".ljust(15, b"\0") + bytes(17) + struct.pack("<H", 2) + bytes(4)
    b[blk(2)] = (bytes(4) + head + entry(2, b"TREE", 0xC1, 10, 1300, 0x2000) + entry(13, b"SUB", 15, 20, 512, 0)).ljust(512, b"\0")
    index = bytearray(512)
    index[0], index[2] = 11, 12  # the second block is a hole
    b[blk(10)] = bytes(index)
    b[blk(11)], b[blk(12)] = b"a" * 512, b"c" * 512
    b[blk(20)] = (bytes(4) + bytes(39) + entry(1, b"LEAF", 6, 21, 5, 0x300)).ljust(512, b"\0")
    b[blk(21)] = b"hello".ljust(512, b"\0")
    name, found = disks.catalogue(bytes(b))
    assert [(e.parent, e.name, e.is_directory) for e in found] == [("", "TREE", False), ("", "SUB", True), ("SUB/", "LEAF", False)]
    assert found[0].content == b"a" * 512 + bytes(512) + b"c" * 276 and found[2].content == b"hello" and found[1].size == 5
    two = b"2IMG" + bytes(8) + b"\1" + bytes(11) + struct.pack("<II", 64, len(b)) + bytes(32)
    assert disks.catalogue(two + bytes(b))[0] == "2IMG"


def test_tr_dos_and_dfs():
    b = bytearray(655360)
    b[:16] = b"SCREEN  C" + struct.pack("<HHBBB", 0x4000, 300, 2, 0, 1)
    b[2048 + 231], b[2048 + 227] = 0x10, 0x16
    b[4096:4396] = bytes(i % 200 for i in range(300))
    name, found = disks.catalogue(bytes(b))
    assert name == "TR-DOS" and found[0].name == "SCREEN.C" and found[0].content == bytes(i % 200 for i in range(300))
    b = bytearray(102400)
    b[8:16] = b"PIC    $"
    b[0x105], b[0x106], b[0x107] = 8, 1, 0x90
    b[0x108:0x110] = struct.pack("<HHHBB", 0x3000, 0, 600, 0, 3)
    b[768:1368] = b"z" * 600
    name, found = disks.catalogue(bytes(b))
    assert name == "BBC Micro" and found[0].content == b"z" * 600 and found[0].load_address == 0x3000


@pytest.mark.parametrize("reader", [r for _, r in disks.READERS])
def test_readers_survive_noise(reader):
    good = [fat_disk()[0], blob(143360).tobytes(), blob(174848).tobytes(), b"\x96\x02" + blob(92174).tobytes(), b"DOS\0" + blob(901116).tobytes(), b"MV - CPC" + blob(5000).tobytes(), b"2IMG" + blob(3000).tobytes(), b"", b"\0"]
    for b in good:
        try:
            list(reader(b))
        except (disks.NotThis, IndexError):
            pass
