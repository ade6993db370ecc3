"""Hardware palettes, and palettes read from bytes."""

from __future__ import annotations

import numpy as np


def _rgb(*codes: int) -> np.ndarray:
    """0xRRGGBB numbers to an (n, 3) array."""
    v = np.array(codes, np.int64)
    return np.stack([v >> 16, v >> 8 & 255, v & 255], 1).astype(np.uint8)


# The colours of the machines, as 0xRRGGBB in index order.
ZX = _rgb(0x000000, 0x0000D7, 0xD70000, 0xD700D7, 0x00D700, 0x00D7D7, 0xD7D700, 0xD7D7D7, 0x000000, 0x0000FF, 0xFF0000, 0xFF00FF, 0x00FF00, 0x00FFFF, 0xFFFF00, 0xFFFFFF)
CPC = _rgb(
    0x010200, 0x6B0200, 0xF4020C, 0x01026C, 0x680269, 0xF2026C, 0x0605F3, 0x6802F0, 0xF402F3, 0x017802, 0x687800, 0xF47B0C, 0x017B6E, 0x6B7D6E,
    0xF67B6E, 0x0D7DF3, 0x6B7DF3, 0xF980FA, 0x01F002, 0x6BF300, 0xF2F30F, 0x04F571, 0x6BF371, 0xF4F371, 0x0DF3F3, 0x6DF3F3, 0xF9F3FF,
)
CPC_MODE0 = (1, 24, 20, 6, 26, 0, 2, 8, 10, 12, 14, 16, 18, 22, 24, 13)
CPC_MODE1 = (1, 24, 20, 6)
HGR = _rgb(0x000000, 0xFFFFFF, 0x20C020, 0xA020F0, 0xFF6400, 0x3C3CFF)
DHGR = _rgb(0x000000, 0x8612C0, 0x00652B, 0x3030FF, 0xA55F00, 0xACACAC, 0x00E200, 0x00FF92, 0xE00027, 0xDF11D4, 0x515151, 0x4E9EFF, 0xFF2700, 0xFF9699, 0xFFFD00, 0xFFFFFF)
EGA = _rgb(0x000000, 0x0000AA, 0x00AA00, 0x00AAAA, 0xAA0000, 0xAA00AA, 0xAA5500, 0xAAAAAA, 0x555555, 0x5555FF, 0x55FF55, 0x55FFFF, 0xFF5555, 0xFF55FF, 0xFFFF55, 0xFFFFFF)
COCO = _rgb(0x000000, 0x00FF00, 0xFFFF00, 0x0000FF, 0xFF0000, 0xFFFFFF, 0x00FFFF, 0xFF00FF, 0xFF8000, 0x008000, 0x000080, 0x800000, 0x808080, 0x008080, 0x800080, 0x804000)
COCO_ARTIFACT = _rgb(0x000000, 0x0080FF, 0xFF8000, 0xFFFFFF)
COCO3_DEFAULT = (0, 63, 48, 12, 3, 15, 51, 60, 21, 42, 32, 8, 2, 52, 44, 7)
VIC20 = _rgb(0x000000, 0xFFFFFF, 0xF00000, 0x00F0F0, 0x600060, 0x00A000, 0x0000F0, 0xD0D000, 0xC0A000, 0xFFA000, 0xF08080, 0x00FFFF, 0xFF00FF, 0x00FF00, 0x00A0FF, 0xFFFF00)
C64 = _rgb(0x000000, 0xFFFFFF, 0x68372B, 0x70A4B2, 0x6F3D86, 0x588D43, 0x352879, 0xB8C76F, 0x6F4F25, 0x433900, 0x9A6759, 0x444444, 0x6C6C6C, 0x9AD284, 0x6C5EB5, 0x959595)
BBC = _rgb(0x000000, 0xFF0000, 0x00FF00, 0xFFFF00, 0x0000FF, 0xFF00FF, 0x00FFFF, 0xFFFFFF)
MSX = _rgb(0x000000, 0x000000, 0x21C842, 0x5EDC78, 0x5455ED, 0x7D76FC, 0xD4524D, 0x42EBF5, 0xFC5554, 0xFF7978, 0xD4C154, 0xE6CE80, 0x21B03B, 0xC95BBA, 0xCCCCCC, 0xFFFFFF)
# The 8-bit Atari's 128 colours: 16 hues, a line each, of eight luminances.
ATARI = _rgb(
    0x000000, 0x1C1C1C, 0x393939, 0x595959, 0x7A7A7A, 0x9C9C9C, 0xBCBCBC, 0xDCDCDC,
    0x261000, 0x442C00, 0x644C0C, 0x846C2C, 0xA48C4C, 0xC4AC6C, 0xE4CC8C, 0xFFECAC,
    0x390400, 0x5A2000, 0x7A4000, 0x9A6014, 0xBA8034, 0xDAA054, 0xFAC074, 0xFFE094,
    0x450000, 0x661400, 0x86340C, 0xA6542C, 0xC6744C, 0xE6946C, 0xFFB48C, 0xFFD4AC,
    0x4A0008, 0x6A0C18, 0x8A2C38, 0xAA4C58, 0xCA6C78, 0xEA8C98, 0xFFACB8, 0xFFCCD8,
    0x46002C, 0x660844, 0x862864, 0xA64884, 0xC668A4, 0xE688C4, 0xFFA8E4, 0xFFC8FF,
    0x3A004C, 0x580468, 0x782488, 0x9844A8, 0xB864C8, 0xD884E8, 0xF8A4FF, 0xFFC4FF,
    0x260064, 0x420880, 0x6228A0, 0x8248C0, 0xA268E0, 0xC288FF, 0xE2A8FF, 0xFFC8FF,
    0x100070, 0x28108C, 0x4830AC, 0x6850CC, 0x8870EC, 0xA890FF, 0xC8B0FF, 0xE8D0FF,
    0x00006C, 0x08188C, 0x2838AC, 0x4858CC, 0x6878EC, 0x8898FF, 0xA8B8FF, 0xC8D8FF,
    0x00045C, 0x00247C, 0x14449C, 0x3464BC, 0x5484DC, 0x74A4FC, 0x94C4FF, 0xB4E4FF,
    0x001044, 0x003064, 0x045084, 0x2470A4, 0x4490C4, 0x64B0E4, 0x84D0FF, 0xA4F0FF,
    0x001C28, 0x003C48, 0x005C68, 0x147C88, 0x349CA8, 0x54BCC8, 0x74DCE8, 0x94FCFF,
    0x00240C, 0x004424, 0x046444, 0x248464, 0x44A484, 0x64C4A4, 0x84E4C4, 0xA4FFE4,
    0x002800, 0x0C4804, 0x2C6824, 0x4C8844, 0x6CA864, 0x8CC884, 0xACE8A4, 0xCCFFC4,
    0x142400, 0x344400, 0x54640C, 0x74842C, 0x94A44C, 0xB4C46C, 0xD4E48C, 0xF4FFAC,
)
MONO = _rgb(0xFFFFFF, 0x000000)
# The TED's 128 colours: eight luminances of 16 hues.
PLUS4 = _rgb(
    0x000000, 0x171717, 0x0A0746, 0x262A00, 0x46023E, 0x003300, 0x700D0F, 0x00211F, 0x000E3E, 0x001730, 0x002B0F, 0x260346, 0x0A3100, 0x611703, 0x70071F, 0x003103,
    0x000000, 0x262626, 0x171459, 0x373B01, 0x590C51, 0x014505, 0x851C1E, 0x003230, 0x011C51, 0x002742, 0x003C1E, 0x370E59, 0x174201, 0x75260F, 0x851330, 0x00430F,
    0x000000, 0x373737, 0x27236D, 0x494E0C, 0x6D1B64, 0x0C5812, 0x9B2C2E, 0x004441, 0x0C2C64, 0x003855, 0x004E2E, 0x491D6D, 0x27550C, 0x8A371D, 0x9B2241, 0x00561D,
    0x000000, 0x4A4A4A, 0x383381, 0x5D611A, 0x822A79, 0x1A6C20, 0xB13D3F, 0x005754, 0x1A3D79, 0x074A68, 0x00623F, 0x5D2D81, 0x38691A, 0xA0492D, 0xB13354, 0x07692D,
    0x000000, 0x7B7B7B, 0x6762B8, 0x909644, 0xB958AF, 0x44A14C, 0xEB6D70, 0x1F8A87, 0x446EAF, 0x2B7C9D, 0x1F9670, 0x905AB8, 0x679E44, 0xD97B5B, 0xEB6287, 0x2B9E5B,
    0x000000, 0x9B9B9B, 0x8681DB, 0xB1B761, 0xDC76D1, 0x60C369, 0xFF8C8F, 0x38ABA8, 0x608DD1, 0x459CBF, 0x38B78F, 0xB179DB, 0x86C061, 0xFD9B79, 0xFF80A8, 0x45C079,
    0x000000, 0xE0E0E0, 0xC9C3FF, 0xF8FEA0, 0xFFB7FF, 0x9FFFA9, 0xFFD0D3, 0x71F1ED, 0x9FD1FF, 0x81E0FF, 0x71FED3, 0xF8BAFF, 0xC9FFA0, 0xFFE0BB, 0xFFC3ED, 0x81FFBB,
    0x000000, 0xFFFFFF, 0xFFFFFF, 0xFFFFFD, 0xFFFFFF, 0xFDFFFF, 0xFFFFFF, 0xC9FFFF, 0xFDFFFF, 0xDBFFFF, 0xC9FFFF, 0xFFFFFF, 0xFFFFFD, 0xFFFFFF, 0xFFFFFF, 0xDBFFFF,
)


def gray(n: int) -> np.ndarray:
    return np.repeat((np.arange(n) * 255 // max(1, n - 1)).astype(np.uint8)[:, None], 3, 1)


def gime() -> np.ndarray:
    """The 64 RRGGBB colours of two bits a channel."""
    i = np.arange(64)
    return (np.stack([i >> 4 & 3, i >> 2 & 3, i & 3], 1) * 85).astype(np.uint8)


def ega64() -> np.ndarray:
    """The 64 rgbRGB colours: a high and a low bit a channel."""
    i = np.arange(64)
    return np.stack([(i >> h & 1) * 170 + (i >> l & 1) * 85 for h, l in ((5, 2), (4, 1), (3, 0))], 1).astype(np.uint8)


def words_0rgb(data: np.ndarray, offset: int, reverse: bool = False) -> np.ndarray:
    """16 little-endian $0RGB words as colours; missing ones are a grey ramp."""
    if offset + 32 > len(data):
        return np.repeat((np.arange(16) * 17).astype(np.uint8)[:, None], 3, 1)
    v = data[offset : offset + 32].astype(np.int64).reshape(16, 2)
    out = np.stack([v[:, 1] & 15, v[:, 0] >> 4, v[:, 0] & 15], 1) * 17
    return (out[::-1] if reverse else out).astype(np.uint8)


def words_st(data: np.ndarray, offset: int) -> np.ndarray:
    """16 big-endian words of three bits a channel."""
    v = data[offset : offset + 32].astype(np.int64).reshape(16, 2)
    return (np.stack([v[:, 0] & 7, v[:, 1] >> 4 & 7, v[:, 1] & 7], 1) * 255 // 7).astype(np.uint8)


def msx2(data: np.ndarray, offset: int) -> np.ndarray | None:
    """16 entries of (0RRR0BBB, 00000GGG); None if they don't look like colours."""
    if offset < 0 or offset + 32 > len(data):
        return None
    v = data[offset : offset + 32].astype(np.int64).reshape(16, 2)
    out = np.stack([v[:, 0] >> 4 & 7, v[:, 1] & 7, v[:, 0] & 7], 1) * 255 // 7
    return out.astype(np.uint8) if (out.sum(1) > 0).sum() >= 3 and out.sum() > 100 else None


def hex_string(rgb: tuple[int, int, int]) -> str:
    return "#{:02X}{:02X}{:02X}".format(*rgb)
