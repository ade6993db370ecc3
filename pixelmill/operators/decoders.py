"""Image decoders: bytes to an index map and the palette it looks up, or to colours directly.

Every family is an address map and a bit extraction in numpy. Decoding and recolouring share the index map, so
they cannot drift apart. ``decode`` runs the family that ``classify.family_of`` has named, and gives None where the
bytes don't fit it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from pixelmill.functions import codecs
from pixelmill.functions import palettes as C
from pixelmill.operators.pixels import artifact_colors


@dataclass
class Picture:
    """``indices`` (h, w) into ``palettes`` (p, n, 3); rows choose their palette by ``lines``. Or ``rgb`` (h, w, 3)."""

    family: str
    mode: str
    indices: np.ndarray | None = None
    palettes: np.ndarray | None = None
    lines: np.ndarray | None = None
    rgb: np.ndarray | None = None
    editable: bool = True

    def colors(self, palettes: np.ndarray | None = None) -> np.ndarray:
        """The pixels, with other palettes if given; indices beyond a palette are black."""
        if self.rgb is not None:
            return self.rgb
        use = self.palettes if palettes is None else palettes
        padded = np.zeros((len(use), 256, 3), np.uint8)
        padded[:, : use.shape[1]] = use
        rows = np.zeros(len(self.indices), np.int64) if self.lines is None else self.lines
        return padded[rows[:, None], self.indices]


def _one(family: str, mode: str, indices: np.ndarray, palette: np.ndarray) -> Picture:
    return Picture(family, mode, indices.astype(np.uint8), np.asarray(palette, np.uint8)[None])


def bits(data: np.ndarray, per_pixel: int) -> np.ndarray:
    """Pixels of 1, 2, 4 or 8 bits, high bits first, along the last axis."""
    shifts = np.arange(8 - per_pixel, -1, -per_pixel).astype(np.uint8)
    out = (data[..., None] >> shifts) & ((1 << per_pixel) - 1)
    return out.reshape(*data.shape[:-1], -1)


def _cells(data: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Bitmaps stored cell by cell, eight bytes each, as lines of bytes."""
    return data[: rows * columns * 8].reshape(rows, columns, 8).transpose(0, 2, 1).reshape(rows * 8, columns)


def _spread(cells: np.ndarray, rows: int, columns: int, width: int) -> np.ndarray:
    """One value a cell to one a pixel."""
    return np.repeat(np.repeat(cells[: rows * columns].reshape(rows, columns), 8, 0), width, 1)


def _interleaved(data: np.ndarray) -> np.ndarray:
    """192 lines of 40 bytes: eight-line groups and thirds of an 8 KB page."""
    y = np.arange(192)
    at = (y & 7) << 10 | (y >> 3 & 7) << 7
    return data[(at + (y >> 6) * 40)[:, None] + np.arange(40)]


# ---- 8-bit home computers -----------------------------------------------------------------------


def zx(b: np.ndarray) -> Picture | None:
    if len(b) != 6912:
        return None
    y = np.arange(192)
    line = (y & 0xC0) << 5 | (y & 7) << 8 | (y & 0x38) << 2
    on = bits(b[line[:, None] + np.arange(32)], 1)
    a = _spread(b[6144:], 24, 32, 8)
    bright = (a >> 6 & 1) * 8
    return _one("ZXSpectrum", "", np.where(on, a & 7, a >> 3 & 7) + bright, C.ZX)


def c64_multicolor(b: np.ndarray, bitmap: int, screen: int, color: int, background: int, mode: str) -> Picture | None:
    if len(b) <= max(background, color + 999):
        return None
    pair = bits(_cells(b[bitmap:], 25, 40), 2)
    s, c = _spread(b[screen:], 25, 40, 4), _spread(b[color:], 25, 40, 4)
    index = np.choose(pair, [np.full(pair.shape, b[background] & 15), s >> 4, s & 15, c & 15])
    return _one("C64", mode, np.repeat(index, 2, 1), C.C64)


def c64_hires(b: np.ndarray, mode: str) -> Picture | None:
    if len(b) < 9002:
        return None
    on, s = bits(_cells(b[2:], 25, 40), 1), _spread(b[8002:], 25, 40, 8)
    return _one("C64", mode, np.where(on, s >> 4, s & 15), C.C64)


def plus4(b: np.ndarray) -> Picture | None:
    """Two colours a cell, or four where the file starts with two background colours."""
    multi = len(b) >= 10002 and b[0] < 128 and b[1] < 128 and len(b) <= 10004
    at = 2 if multi else len(b) - 10000
    if len(b) < at + 10000 or at < 0:
        return None
    luma, hue, bitmap = b[at : at + 1000], b[at + 1000 : at + 2000], b[at + 2000 :]
    wide = 4 if multi else 8
    l, h = _spread(luma, 25, 40, wide).astype(np.int64), _spread(hue, 25, 40, wide).astype(np.int64)
    first, second = ((l & 7) * 16 + (h >> 4)) % 128, ((l >> 4 & 7) * 16 + (h & 15)) % 128
    if not multi:
        return _one("Plus4", "HiRes", np.where(bits(_cells(bitmap, 25, 40), 1), first, second), C.PLUS4)
    pair = bits(_cells(bitmap, 25, 40), 2)
    index = np.choose(pair, [np.full(pair.shape, int(b[0])), first, second, np.full(pair.shape, int(b[1]))])
    return _one("Plus4", "Multicolor", np.repeat(index, 2, 1), C.PLUS4)


VIC20_SCREEN = 506  # cells, for codes and for colours; 2048 bytes of characters follow


def _vic20_start(b: np.ndarray) -> int | None:
    """Where a program's screen starts: at the end less its size, or where the codes count up from 0, by which colours are valid."""
    end, size = len(b) - 3060, VIC20_SCREEN
    if end == 0:
        return 0
    color = lambda at: b[at + size : at + 2 * size]
    counting = [at for at in range(14, min(150, end + 1)) if (b[at : at + 6] == np.arange(6)).all()]
    at = end
    if end < 2 or (color(end) < 16).sum() <= 400 and counting and (color(counting[0]) < 16).sum() > 400:
        at = counting[0] if counting else 61
    return at if 2 <= at <= end and (color(at) < 24).sum() >= 400 else None


def _vic20_stored(b: np.ndarray, at: int, register: int) -> int | None:
    """The value that the viewer in front of the screen stores in a video register ($90xx)."""
    for i in range(16, min(at - 3, 70)) if at >= 20 else ():
        if b[i - 2] == 0xA9 and b[i] == 0x8D and b[i + 1] == register and b[i + 2] == 0x90:
            return int(b[i - 1])
    return None


def vic20(b: np.ndarray) -> Picture | None:
    """22 by 23 characters of 8 by 8 from screen codes, colours and a character set.

    The background and the colours that cells share are those that the viewer stores; black, white and yellow without one.
    """
    if len(b) < 3060:
        return None
    start = _vic20_start(b)
    if start is None:
        return None
    ground, aux = _vic20_stored(b, start, 0x0F), _vic20_stored(b, start, 0x0E)
    back, border = (0, 1) if ground is None else (ground >> 4, ground & 15)
    body = b[start : start + 3060]
    screen, color, chars = body[:506], body[506:1012], body[1012:3060].reshape(256, 8)
    glyph = chars[screen].reshape(23, 22, 8).transpose(0, 2, 1).reshape(184, 22)
    c = color.reshape(23, 22)
    if (color >= 8).sum() > 250:
        pair, own = bits(glyph, 2), np.repeat(np.repeat(c & 7, 8, 0), 4, 1)
        index = np.repeat(np.choose(pair, [np.full(pair.shape, back), np.full(pair.shape, border), own, np.full(pair.shape, 7 if aux is None else aux >> 4)]), 2, 1)
        return _one("VIC20", "Multicolor", index, C.VIC20)
    return _one("VIC20", "HiRes", np.where(bits(glyph, 1), np.repeat(np.repeat(c & 7, 8, 0), 8, 1), back), C.VIC20)


def cpc(b: np.ndarray) -> Picture | None:
    """16 KB of eight interleaved blocks; a longer file has a header with the palette's hardware colours."""
    if not 16000 <= len(b) <= 17000:
        return None
    own = None
    if len(b) > 16384:
        head, b = b[:128], b[128:]
        if (head[69:85] <= 26).all() and head[69:85].any():
            own = head[69:85].astype(np.int64)
    y = np.arange(200)
    at = ((y % 8) * 2048 + y // 8 * 80)[:, None] + np.arange(80)
    raw = np.where(at < len(b), b[np.minimum(at, len(b) - 1)], 0).astype(np.uint8)
    one = own is not None and not own[4:].any()
    if own is None:
        seen = set()
        for p in _cpc_pixels(b[:2000], 0):
            seen.update(np.unique(p).tolist())
        one = len(seen) <= 4
    pixels = np.stack(_cpc_pixels(raw, 1 if one else 0), -1).reshape(200, -1)
    ink = own if own is not None else np.array(C.CPC_MODE1 if one else C.CPC_MODE0)
    return _one("AmstradCPC", "1" if one else "0", pixels, C.CPC[ink])


def _cpc_pixels(v: np.ndarray, mode: int) -> list[np.ndarray]:
    """A byte's pixels, whose bits are dealt over it."""
    if mode:
        return [(v >> 7 - p & 1) | (v >> 3 - p & 1) << 1 for p in range(4)]
    return [(v >> 7 - p & 1) | (v >> 3 - p & 1) << 1 | (v >> 5 - p & 1) << 2 | (v >> 1 - p & 1) << 3 for p in range(2)]


def msx(b: np.ndarray, screen: int) -> Picture | None:
    at = 7 if len(b) and b[0] == 0xFE else 0
    v = b[at:]
    if screen == 8:
        if len(v) < 54272:
            return None
        p = v[:54272].reshape(212, 256).astype(np.int64)
        rgb = np.stack([(p >> 5) * 255 // 7, (p >> 2 & 7) * 255 // 7, (p & 3) * 255 // 3], -1).astype(np.uint8)
        return Picture("MSX", "8", rgb=rgb, editable=False)
    if screen in (5, 7):
        lead = C.msx2(v, 0) if len(v) >= 27136 + 32 else None
        if len(v) < 27136 and len(v) < 0x6A00:
            return None
        palette = next((p for p in (C.msx2(v, 0x7680), lead, C.msx2(v, 27136)) if p is not None), C.MSX)
        pixels = v[32:] if lead is not None and palette is lead else v
        return _one("MSX", "5", bits(pixels[: 212 * 128].reshape(212, 128), 4), palette)
    if screen == 1:
        if len(v) < 2048:
            return None
        v = np.concatenate([v, np.zeros(max(0, 2816 - len(v)), np.uint8)])
        names, patterns = v[:768].astype(np.int64), v[768:2816].reshape(256, 8)
        ink = np.full(32, 0xF1, np.uint8)  # of eight patterns each; white on black where the file ends before
        ink[: len(v[2816:2848])] = v[2816:2848]
        own = np.repeat(np.repeat(ink[names // 8].reshape(24, 32), 8, 0), 8, 1)
        index = np.where(bits(patterns[names].reshape(24, 32, 8).transpose(0, 2, 1).reshape(192, 32), 1), own >> 4, own & 15)
        return _one("MSX", "1", np.where(index == 0, 1, index), C.MSX)
    if len(v) >= 14336:
        names, patterns, colors = v[0x1800:0x1B00], v[:0x1800], v[0x2000:0x3800]
    elif len(v) >= 12288:
        patterns, colors = v[:6144], v[6144:12288]
        names = v[12288:13056] if len(v) >= 13056 else np.tile(np.arange(256, dtype=np.uint8), 3)
    else:
        return None
    bank = np.repeat(np.arange(3), 256) * 2048
    row = (bank[:, None] + names[:768, None].astype(np.int64) * 8 + np.arange(8))
    line = patterns[row].reshape(24, 32, 8).transpose(0, 2, 1).reshape(192, 32)
    ink = np.repeat(colors[row].reshape(24, 32, 8).transpose(0, 2, 1).reshape(192, 32), 8, 1)
    index = np.where(bits(line, 1), ink >> 4, ink & 15)
    return _one("MSX", "2", np.where(index == 0, 1, index), C.MSX)


def bbc(b: np.ndarray, mode: int) -> Picture | None:
    size, colors = (20480, {0: 2, 1: 4, 2: 16}[mode]) if mode < 3 else (10240, {4: 2, 5: 4}[mode])
    if len(b) < size:
        return None
    ink = np.array({2: (0, 7), 4: (0, 1, 3, 7), 16: (0, 1, 2, 3, 4, 5, 6, 7) * 2}[colors])
    if len(b) == size + 1 + colors and b[size] == mode and (b[size + 1 :] < 8).all():
        ink = b[size + 1 :].astype(np.int64)
    line = _cells(b, 32, size // 256)
    if colors == 2:
        index = bits(line, 1)
    else:
        per = 2 if colors == 4 else 4  # a pixel's bits are 8 / per apart
        step = 8 // per
        pixels = [sum(((line >> (7 - p - step * k)) & 1) << (per - 1 - k) for k in range(per)) for p in range(step)]
        index = np.stack(pixels, -1).reshape(256, -1)
    if mode in (2, 5):
        index = np.repeat(index, 2, 1)
    return _one("BBCMicro", str(mode), index, C.BBC[ink])


def trs80_blocks(b: np.ndarray) -> Picture | None:
    """64 by 16 characters of two by three blocks, where the top bit is set."""
    if len(b) < 1024:
        return None
    c = b[:1024].reshape(16, 64)
    on = np.stack([(c >> k & 1) & (c >> 7) for k in range(6)], -1).reshape(16, 64, 3, 2).transpose(0, 2, 1, 3).reshape(48, 128)
    return _one("TRS80", "Blocks", np.repeat(np.repeat(on, 4, 0), 4, 1), np.array([[0, 0, 0], [255, 255, 255]]))


def pmode(b: np.ndarray, mode: int) -> Picture | None:
    if len(b) < 6144:
        return None
    line = b[:6144].reshape(192, 32)
    if mode == 3:
        return _one("CoCo", "PMODE3", np.repeat(bits(line, 2), 2, 1), C.COCO[1:5])
    if mode == 4:
        return _one("CoCo", "PMODE4", bits(line, 1), C.COCO[[0, 5]])
    return _one("CoCo", "Artifact", np.repeat(bits(line, 2), 2, 1), C.COCO_ARTIFACT)


def coco3(b: np.ndarray, wide: bool = False) -> Picture | None:
    palette = C.gime()[list(C.COCO3_DEFAULT)]
    if len(b) == 32016:
        if (b[:16] < 64).all() and b[:16].any():
            palette, b = C.gime()[b[:16]], b[16:]
        elif (b[32000:] < 64).all():
            palette = C.gime()[b[32000:]]
    rows = min(200, len(b) // 160)
    if rows == 0:
        return None
    return _one("CoCo3", "640" if wide else "320", bits(b[: rows * 160].reshape(rows, 160), 2 if wide else 4), palette)


def atari_palette(registers: np.ndarray) -> np.ndarray:
    """Colour registers as colours: the hue is the high nibble, the luminance the next three bits."""
    return C.ATARI[registers.astype(np.int64) >> 1]


def atari8(b: np.ndarray, mode: int, name: str = "", at_least: int = 4) -> Picture | None:
    """192 lines of 40 bytes; registers after them give the colours, the hue (mode 9) or the luminance (mode 11)."""
    if len(b) < 7680:
        return None
    line, rest = b[:7680].reshape(192, 40), b[7680:]
    if mode == 8:
        ink = rest[:2] if len(rest) >= 2 else np.array([0, 14], np.uint8)
        return _one("Atari8bit", "GR8", bits(line, 1), atari_palette(ink))
    if mode == 15:
        ink = rest[:4] if len(rest) >= at_least else np.array([0, 4, 8, 14], np.uint8)
        return _one("Atari8bit", name or "GR15", bits(line, 2), atari_palette(ink))
    index = np.repeat(bits(line, 4), 2, 1)
    if mode == 9:
        hue = int(rest[0]) >> 4 if len(rest) else 0
        return _one("Atari8bit", "GR9", index, C.ATARI[hue * 8 + np.arange(16) // 2])
    if mode == 11:
        luma = int(rest[0]) >> 1 & 7 if len(rest) else 3
        return _one("Atari8bit", "GR11", index, C.ATARI[np.arange(16) * 8 + luma])
    ink = rest[:9] if len(rest) >= 9 else np.minimum(np.arange(9, dtype=np.uint8), 7) * 2
    return _one("Atari8bit", "GR10", np.minimum(index, 8), atari_palette(ink))


# ---- Apple --------------------------------------------------------------------------------------


def hgr(b: np.ndarray) -> Picture | None:
    """280 by 192; a colour follows from a bit, the next one, the column's parity and the byte's high bit."""
    if len(b) < 8184:
        return None
    line = _interleaved(np.concatenate([b, np.zeros(max(0, 8192 - len(b)), np.uint8)]))
    return _one("HGR", "", artifact_colors(line), C.HGR)


def dhgr(b: np.ndarray) -> Picture | None:
    """Two pages give seven bits each in turn, four bits a colour; 560 columns shown as 280."""
    if len(b) < 16384:
        return None
    both = np.stack([_interleaved(b[:8192]), _interleaved(b[8192:16384])], 2)
    on = ((both[..., None] >> np.arange(7, dtype=np.uint8)) & 1).reshape(192, 560)
    index = (on.reshape(192, 140, 4) << np.arange(4, dtype=np.uint8)).sum(2)
    return _one("DHGR", "", np.repeat(index, 2, 1), C.DHGR)


def _shr_lines(pixels: np.ndarray, modes: np.ndarray | None) -> np.ndarray:
    """Lines of 160 bytes to 320 indices, or 640 where the mode's top bit is set (then all lines are 640 wide)."""
    low = bits(pixels, 4)
    wide = np.zeros(len(pixels), bool) if modes is None else modes >> 7 == 1
    if not wide.any():
        return low
    pairs = bits(pixels, 2) + np.tile(np.array([8, 12, 0, 4], np.uint8), pixels.shape[1])
    return np.where(wide[:, None], pairs, np.repeat(low, 2, 1))


def shr(b: np.ndarray, mode: str = "Standard") -> Picture | None:
    if len(b) < 32000:
        return None
    pixels = b[:32000].reshape(200, 160)
    if mode == "3200":
        table = np.stack([C.words_0rgb(b, 32000 + 32 * y, reverse=True) for y in range(200)])
        return Picture("SHR", mode, bits(pixels, 4), table, np.arange(200))
    scb = b[32000:32200] if len(b) >= 32200 else np.zeros(200, np.uint8)
    table = np.stack([C.words_0rgb(b, 32256 + 32 * k) for k in range(16)])
    return Picture("SHR", mode, _shr_lines(pixels, scb), table, (scb & 15).astype(np.int64))


def shr_3201(b: np.ndarray) -> Picture | None:
    at = 4 if bytes(b[:4]) == b"\xc1\xd0\xd0\x00" else 0
    if len(b) < at + 6400:
        return None
    raw = np.frombuffer(codecs.pack_bytes(bytes(b[at + 6400 :])), np.uint8)
    if len(raw) < 32000:
        return None
    table = np.stack([C.words_0rgb(b, at + 32 * y, reverse=True) for y in range(200)])
    return Picture("SHR", "3200 Packed", bits(raw[:32000].reshape(200, 160), 4), table, np.arange(200))


def shr_packed(b: np.ndarray) -> Picture | None:
    raw = np.frombuffer(codecs.pack_bytes(bytes(b)), np.uint8)
    return shr(raw, "816/Paint" if bytes(raw[32224:32233]) == b"816/Paint" else "Packed")


def paintworks(b: np.ndarray) -> Picture | None:
    if len(b) < 0x222:
        return None
    body, raw = bytes(b[0x222:]), b""
    for unpack in (codecs.pack_bytes, codecs.pack_bits):
        raw = unpack(body)
        if len(raw) >= 32000:
            break
    v = np.frombuffer(raw if len(raw) >= 32000 else body, np.uint8)
    rows = min(len(v) // 160, 396)
    return _one("SHR", "Paintworks", bits(v[: rows * 160].reshape(rows, 160), 4), C.words_0rgb(b, 0)) if rows else None


def dreamgrafix(b: np.ndarray, packed: bool) -> Picture | None:
    foot = bytes(b[-17:])
    if len(b) < 17 or foot[6] != 10 or foot[7:] != b"DreamWorld":
        return None
    mode, height, width = (int.from_bytes(foot[i : i + 2], "little") for i in (0, 2, 4))
    body = bytes(b[:-17])
    raw = codecs.lzw(body) if packed else body
    n = (width // 2) * height
    if mode > 1 or height > 400 or width > 640 or not raw or len(raw) < n or not n:
        return None
    v = np.frombuffer(raw, np.uint8)
    pixels = v[:n].reshape(height, width // 2)
    if mode == 1:
        table = np.stack([C.words_0rgb(v, n + 32 * y, reverse=True) for y in range(height)])
        return Picture("SHR", "DreamGrafix 3200", bits(pixels, 4), table, np.arange(height))
    scb = v[n : n + height] if len(v) >= n + height else np.zeros(height, np.uint8)
    table = np.stack([C.words_0rgb(v, n + 256 + 32 * k) for k in range(16)])
    return Picture("SHR", "DreamGrafix", _shr_lines(pixels, scb), table, (scb & 15).astype(np.int64))


def apf(b: np.ndarray) -> Picture | None:
    """Blocks of a length, a name and data; MAIN has the picture, MULTIPAL a palette a line."""
    raw, at, blocks = bytes(b), 0, {}
    while at + 5 <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "little")
        name = raw[at + 5 : at + 5 + raw[at + 4]]
        if size < 5 + raw[at + 4]:
            break
        blocks.setdefault(name, raw[at + 5 + raw[at + 4] : at + size])
        at += size
    m = blocks.get(b"MAIN")
    if m is None or len(m) < 6:
        return None
    le = lambda i: int.from_bytes(m[i : i + 2], "little")
    width, tables, at = le(2), le(4), 6
    v = np.frombuffer(m, np.uint8)
    palette = np.stack([C.words_0rgb(v, at + 32 * k) for k in range(max(1, min(tables, 16)))])
    at += 32 * tables
    height = le(at)
    if not 0 < width <= 1280 or not 0 < height <= 400 or at + 2 + 4 * height > len(m):
        return None
    sizes, modes = [le(at + 2 + 4 * y) for y in range(height)], np.array([m[at + 4 + 4 * y] for y in range(height)], np.uint8)
    at += 2 + 4 * height
    wide = -(-width // (4 if modes[0] >> 7 else 2))
    lines = np.zeros((height, wide), np.uint8)
    for y, n in enumerate(sizes):
        row = codecs.pack_bytes(m[at : at + n], wide)
        lines[y, : len(row)] = np.frombuffer(row, np.uint8)
        at += n
    multi = blocks.get(b"MULTIPAL")
    if multi and len(multi) >= 2 + 32 * height:
        table = np.stack([C.words_0rgb(np.frombuffer(multi, np.uint8), 2 + 32 * y) for y in range(height)])
        return Picture("SHR", "APF 3200", bits(lines, 4), table, np.arange(height))
    return Picture("SHR", "APF", _shr_lines(lines, modes), palette, np.minimum(modes & 15, len(palette) - 1).astype(np.int64))


def macpaint(b: np.ndarray) -> Picture | None:
    raw = np.frombuffer(codecs.pack_bits(bytes(b[512:]), 51840, run_of_128=True), np.uint8)
    if len(raw) < 51840 * 8 // 10:
        return None
    full = np.concatenate([raw, np.zeros(51840 - len(raw), np.uint8)])
    return _one("MacPaint", "", bits(full.reshape(720, 72), 1), C.MONO)


# ---- 16-bit machines and PC ---------------------------------------------------------------------


def _planes_to_index(planes: np.ndarray) -> np.ndarray:
    """(rows, planes, bytes) to indices, the first plane lowest."""
    on = np.unpackbits(planes, axis=2)
    return (on << np.arange(planes.shape[1], dtype=np.uint8)[None, :, None]).sum(1)


def _st(b: np.ndarray, resolution: int, palette: int, at: int, family: str) -> Picture | None:
    width, height, planes = ((320, 200, 4), (640, 200, 2), (640, 400, 1))[resolution]
    if len(b) < at + 32000:
        return None
    words = b[at : at + 32000].reshape(height, width // 16, planes, 2).transpose(0, 2, 1, 3).reshape(height, planes, width // 8)
    return _one(family, ("Low", "Medium", "High")[resolution], _planes_to_index(words), C.words_st(b, palette)[: 1 << planes])


def degas(b: np.ndarray) -> Picture | None:
    word = int(b[0]) << 8 | int(b[1]) if len(b) >= 34 else 9
    return _st(b, word, 2, 34, "Degas") if word <= 2 else None


def neochrome(b: np.ndarray) -> Picture | None:
    return _st(b, min(2, int(b[3])), 4, 128, "NEOchrome") if len(b) == 32128 else None


def ilbm(b: np.ndarray) -> Picture | None:
    """Chunks BMHD, CMAP, CAMG and BODY; planes to indices, hold-and-modify, or 24 bits."""
    raw = bytes(b)
    if raw[:4] != b"FORM":
        return None
    at, parts = 12, {}
    while at + 8 <= len(raw):
        size = int.from_bytes(raw[at + 4 : at + 8], "big")
        parts.setdefault(raw[at : at + 4], raw[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    head, body = parts.get(b"BMHD", b""), parts.get(b"BODY")
    if len(head) < 11 or body is None:
        return None
    width, height = int.from_bytes(head[:2], "big"), int.from_bytes(head[2:4], "big")
    planes, masking, compression = head[8], head[9], head[10]
    row = (width + 15) // 16 * 2
    stored = planes + (masking == 1)
    need = row * stored * height
    if not need:
        return None
    if compression == 1:
        body = codecs.pack_bits(body, need)
    v = np.frombuffer(body[:need].ljust(need, b"\0"), np.uint8).reshape(height, stored, row)[:, :planes]
    view = int.from_bytes(parts.get(b"CAMG", b"\0" * 4)[:4], "big")
    cmap = np.frombuffer(parts.get(b"CMAP", b""), np.uint8)
    palette = cmap[: len(cmap) // 3 * 3].reshape(-1, 3)
    if planes >= 24:
        on = np.unpackbits(v[:, :24], axis=2)[:, :, :width].reshape(height, 3, 8, width)
        rgb = (on << np.arange(8, dtype=np.uint8)[None, None, :, None]).sum(2).transpose(0, 2, 1).astype(np.uint8)
        return Picture("IFF", "24-bit", rgb=rgb, editable=False)
    index = _planes_to_index(v)[:, :width]
    if view & 0x800 and planes in (6, 8):
        return Picture("IFF", f"HAM{planes}", rgb=hold_and_modify(index, palette, planes), editable=False)
    if len(palette) < 1 << planes:
        palette = C.gray(1 << planes)
    wide = np.repeat(index, 2, 1) if height / width > 1.2 else index
    return _one("IFF", "EHB" if view & 0x80 else "ILBM", wide, palette)


def hold_and_modify(index: np.ndarray, palette: np.ndarray, planes: int) -> np.ndarray:
    """Each channel keeps the last value set left of a pixel: the windows' running last value, as index arithmetic."""
    low = planes - 2
    control, value = index >> low, index & ((1 << low) - 1)
    base = np.zeros((1 << low, 3), np.int64)
    base[: len(palette)] = palette[: 1 << low]
    level = value * 17 if low == 4 else value << 2 | value >> 4
    out = np.zeros((*index.shape, 3), np.uint8)
    x = np.arange(index.shape[1])
    for channel, own in ((2, 1), (0, 2), (1, 3)):
        sets = (control == 0) | (control == own)
        last = np.maximum.accumulate(np.where(sets, x, -1), axis=1)
        given = np.where(control == 0, base[value, channel], level)
        out[..., channel] = np.where(last >= 0, np.take_along_axis(given, np.maximum(last, 0), 1), base[0, channel])
    return out


def bmp(b: np.ndarray) -> Picture | None:
    raw = bytes(b)
    if len(raw) < 54 or raw[:2] != b"BM":
        return None
    le = lambda at, n: int.from_bytes(raw[at : at + n], "little")
    start, head, width, height, depth = le(10, 4), le(14, 4), le(18, 4), le(22, 4), le(28, 2)
    if depth not in (1, 4, 8, 24) or le(30, 4) or not 0 < width < 1 << 15 or not 0 < height < 1 << 15:
        return None
    row = (width * depth + 31) // 32 * 4
    if start + row * height > len(raw):
        return None
    lines = b[start : start + row * height].reshape(height, row)[::-1]
    if depth == 24:
        return Picture("BMP", "24", rgb=lines[:, : width * 3].reshape(height, width, 3)[:, :, ::-1].copy(), editable=False)
    n = 1 << depth
    table = np.frombuffer(raw[14 + head : 14 + head + 4 * n].ljust(4 * n, b"\0"), np.uint8).reshape(n, 4)[:, 2::-1]
    return _one("BMP", str(depth), (bits(lines, depth) if depth < 8 else lines)[:, :width], table)


def pcx(b: np.ndarray) -> Picture | None:
    raw = bytes(b)
    if len(raw) < 128 or raw[0] != 10:
        return None
    le = lambda at: int.from_bytes(raw[at : at + 2], "little")
    width, height, depth, planes, row = le(8) - le(4) + 1, le(10) - le(6) + 1, raw[3], raw[65], le(66)
    need = row * planes * height
    if width <= 0 or height <= 0 or not 0 < need < 1 << 26:
        return None
    v = np.frombuffer(codecs.pcx_rle(raw[128:], need).ljust(need, b"\0"), np.uint8).reshape(height, planes, row)
    header = np.frombuffer(raw[16:64], np.uint8).reshape(16, 3)
    if depth == 8 and planes == 3:
        return Picture("PCX", "24", rgb=v[:, :, :width].transpose(0, 2, 1).copy(), editable=False)
    if depth == 8 and planes == 1:
        vga = np.frombuffer(raw[-768:], np.uint8).reshape(256, 3) if len(raw) > 897 and raw[-769] == 12 else C.gray(256)
        return _one("PCX", "8", v[:, 0, :width], vga)
    if depth == 1:
        index = _planes_to_index(v)[:, :width]
        palette = np.array([[0, 0, 0], [255, 255, 255]]) if planes == 1 else header if header.any() else C.EGA
        return _one("PCX", str(planes), index, palette)
    if depth == 2 and planes == 4:
        index = sum(bits(v[:, p], 2).astype(np.int64) << 2 * p for p in range(3))
        return _one("PCX", "6", index[:, :width], C.ega64())
    if depth in (2, 4) and planes == 1:
        return _one("PCX", str(depth), bits(v[:, 0], depth)[:, :width], header if header.any() else C.EGA)
    return None


# ---- dispatch -----------------------------------------------------------------------------------

#: By the family and mode that the classifier names; each may still give None.
KERNELS: dict[str, Callable[[np.ndarray], Picture | None]] = {
    "zx": zx, "koala": lambda b: c64_multicolor(b, 2, 8002, 9002, 10002, "Koala"), "art_studio": lambda b: c64_multicolor(b, 2, 8002, 9018, 9003, "Multicolor"),
    "art_studio_hires": lambda b: c64_hires(b, "Art Studio Hi-Res"), "c64_hires": lambda b: c64_hires(b, "HIRES"), "plus4": plus4, "vic20": vic20, "cpc": cpc,
    "msx1": lambda b: msx(b, 1), "msx2": lambda b: msx(b, 2), "msx5": lambda b: msx(b, 5), "msx8": lambda b: msx(b, 8), **{f"bbc{m}": lambda b, m=m: bbc(b, m) for m in (0, 1, 2, 4, 5)},
    "trs80": trs80_blocks, "pmode3": lambda b: pmode(b, 3), "pmode4": lambda b: pmode(b, 4), "pmode4_artifact": lambda b: pmode(b, 5), "coco3_320": coco3, "coco3_640": lambda b: coco3(b, wide=True),
    **{f"gr{m}": lambda b, m=m: atari8(b, m) for m in (8, 9, 10, 11, 15)}, "gr7": lambda b: atari8(b, 15, "GR7"), "mic": lambda b: atari8(b, 15, at_least=40), "hgr": hgr, "dhgr": dhgr, "shr": shr, "shr3200": lambda b: shr(b, "3200"), "shr3201": shr_3201,
    "shr_packed": shr_packed, "paintworks": paintworks, "dreamgrafix_packed": lambda b: dreamgrafix(b, packed=True), "dreamgrafix": lambda b: dreamgrafix(b, packed=False),
    "apf": apf, "macpaint": macpaint, "degas": degas, "neochrome": neochrome, "iff": ilbm, "bmp": bmp, "pcx": pcx,
}


def decode(kernel: str, content: bytes) -> Picture | None:
    """The picture, or None if the kernel is not known or the bytes don't fit it."""
    run = KERNELS.get(kernel)
    return run(np.frombuffer(content, np.uint8)) if run and content else None
