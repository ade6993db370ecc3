"""Disk images as table functions: one blob in, a row a file or directory out.

A reader is a generator of ``Entry`` over bytes that raises ``NotThis`` where the blob is not its format. Chains of
sectors, blocks and clusters are followed with a visited set and so end on cycles; pointers outside the blob end a
chain, too. Rows are flat: a directory's children carry its path, and ``ord`` keeps the order on the disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.pixels import filled_slices
from pixelmill.runtime import ship


class NotThis(Exception):
    """The blob has another format."""


@dataclass
class Entry:
    name: str
    content: bytes = b""
    size: int = 0
    file_type: int = 0
    load_address: int = 0
    blocks: int = 0
    parent: str = ""
    is_directory: bool = False


def _need(test: bool) -> None:
    if not test:
        raise NotThis


def _le(b: bytes, at: int, n: int = 2) -> int:
    return int.from_bytes(b[at : at + n], "little")


def _be(b: bytes, at: int, n: int = 4) -> int:
    return int.from_bytes(b[at : at + n], "big")


def _seven_bit(raw: bytes) -> str:
    return "".join(chr(c & 127) for c in raw).rstrip(" \0")


def chain(first: int, following: Callable[[int], int | None], most: int = 4096) -> Iterator[int]:
    """``first`` and what follows it, up to None, a cycle, or ``most`` links."""
    seen: set[int] = set()
    at: int | None = first
    while at is not None and at not in seen and len(seen) < most:
        seen.add(at)
        yield at
        at = following(at)


# ---- FAT12: Atari ST and MSX --------------------------------------------------------------------


def fat12(b: bytes) -> Iterator[Entry]:
    """Both machines' layout; entries of sub-directories carry their path."""
    _need(len(b) >= 4096)
    sector, per, reserved, fats, slots, fat_size = _le(b, 11), b[13], _le(b, 14), b[16], _le(b, 17), _le(b, 22)
    _need(sector == 512 and per in (1, 2, 4) and fats in (1, 2) and 0 < slots <= 512 and 0 < fat_size <= 32 and reserved > 0)
    table = b[reserved * 512 : (reserved + fat_size) * 512]
    root = (reserved + fats * fat_size) * 512
    data, cluster = root + slots * 32, per * 512

    def following(c: int) -> int | None:
        at = c * 3 // 2
        if at + 2 > len(table):
            return None
        v = _le(table, at) >> 4 if c % 2 else _le(table, at) & 0xFFF
        return v if 2 <= v < 0xFF0 else None

    def body(c: int) -> bytes:
        return b"".join(b[data + (k - 2) * cluster : data + (k - 1) * cluster] for k in chain(c, following)) if c >= 2 else b""

    def walk(raw: bytes, parent: str, depth: int) -> Iterator[Entry]:
        for at in range(0, len(raw) - 31, 32):
            e = raw[at : at + 32]
            if e[0] == 0:
                break
            if e[0] == 0xE5 or e[11] & 8 or e[:1] == b".":
                continue
            stem, ext = e[:8].decode("latin-1").rstrip(), e[8:11].decode("latin-1").rstrip()
            name = f"{stem}.{ext}" if ext else stem
            if e[11] & 16:
                yield Entry(name, parent=parent, is_directory=True)
                if depth < 16:
                    yield from walk(body(_le(e, 26)), f"{parent}{name}/", depth + 1)
            else:
                size = _le(e, 28, 4)
                yield Entry(name, body(_le(e, 26))[:size], size, parent=parent)

    yield from walk(b[root:data], "", 0)


def atari_st(b: bytes) -> Iterator[Entry]:
    _need(any(abs(len(b) - n * 1024) <= 1024 for n in (360, 400, 720, 800, 1440)) and b[3:6] != b"MSX")
    return fat12(b)


def msx(b: bytes) -> Iterator[Entry]:
    _need(len(b) in (368640, 737280) and _le(b, 14) > 0)
    fat = _le(b, 14) * 512
    _need(b[fat] == b[21] and b[fat + 1 : fat + 3] == b"\xff\xff")
    return fat12(b)


# ---- Commodore ----------------------------------------------------------------------------------


def d64(b: bytes) -> Iterator[Entry]:
    _need(len(b) in (174848, 175531))
    # Sectors of a track by zone.
    per = [21] * 17 + [19] * 7 + [18] * 6 + [17] * 5
    first = [sum(per[:t]) for t in range(36)]

    def sector(ts: int) -> bytes | None:
        t, s = ts >> 8, ts & 255
        if not 1 <= t <= 35 or s >= per[t - 1]:
            return None
        at = (first[t - 1] + s) * 256
        return b[at : at + 256]

    def following(ts: int) -> int | None:
        d = sector(ts)
        return d[0] << 8 | d[1] if d and d[0] else None

    def body(ts: int) -> bytes:
        out = b""
        for k in chain(ts, following, 1000):
            d = sector(k)
            if d is None:
                break
            out += d[2:] if d[0] else d[2 : max(2, d[1] + 1)]
        return out

    for ts in chain(18 << 8 | 1, following, 20):
        d = sector(ts)
        for at in range(0, 256, 32) if d else ():
            e = d[at : at + 32]
            if e[2] & 7 and e[3]:
                content = body(e[3] << 8 | e[4])
                name = e[5:21].split(b"\xa0")[0].decode("latin-1")
                yield Entry(name, content, len(content), e[2] & 7, _le(content, 0) if len(content) > 1 else 0, _le(e, 30))


# ---- Apple II -----------------------------------------------------------------------------------

# The place in ProDOS order of each sector of a DOS-order track, and the reversed interleave, which gives
# the sector that each half of a block is read from.
SECTOR_ORDER = (0, 7, 14, 6, 13, 5, 12, 4, 11, 3, 10, 2, 9, 1, 8, 15)
REVERSED = (0, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 15)
FLOPPY_BLOCKS = 280


def permuted(b: np.ndarray, order: tuple[int, ...], size: int = 256) -> np.ndarray:
    """Sector ``s`` of each track moved to place ``order[s]``; an unfinished last track is dropped."""
    track = len(order) * size
    return b[: len(b) // track * track].reshape(-1, len(order), size)[:, np.argsort(order)].reshape(-1)


def to_prodos_order(b: bytes) -> bytes:
    _need(len(b) == 143360)
    return permuted(np.frombuffer(b, np.uint8), SECTOR_ORDER).tobytes()


def to_reversed_order(b: bytes) -> bytes:
    _need(len(b) == 143360)
    return np.frombuffer(b, np.uint8).reshape(35, 16, 256)[:, REVERSED].tobytes()


def _indexed_file(b: bytes, kind: int, key: int, size: int) -> bytes | None:
    """A file by its index blocks, of which holes are left out; None where the key block cannot be an index."""
    block = lambda k: b[k * 512 : k * 512 + 512]
    numbers = lambda k: [low | high << 8 for low, high in zip(block(k)[:256], block(k)[256:])]
    if not 0 < key < FLOPPY_BLOCKS:
        return None
    if kind == 1:
        return block(key)[:size] or None
    index = numbers(key)
    if kind == 2:
        if max(index) >= 512 or not any(0 < k < FLOPPY_BLOCKS for k in index):
            return None
        data = index
    else:
        if max(index[:128]) >= FLOPPY_BLOCKS:
            return None
        data = [k for i in index[:128] if i for k in numbers(i)]
    return b"".join(block(k) for k in data if 0 < k < FLOPPY_BLOCKS)[:size] or None


def prodos_in_dos_order(b: bytes) -> Iterator[Entry]:
    """ProDOS written through a DOS-order image: the directory goes down from sector 11.

    A file is read by the first order in which its index makes sense: reversed, ProDOS, as stored; then as one run of
    blocks. Of entries with one name the first stands; directories are left out.
    """
    views = (to_reversed_order(b), to_prodos_order(b), b)
    head = b[2816:3072]
    _need(head[4] >> 4 == 15 and head[4] & 15 > 0 and all(c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789." for c in head[5 : 5 + (head[4] & 15)]) and _le(head, 0x25) < 1000)
    seen: set[str] = set()
    for top in range(11, 0, -2):
        d = b[top * 256 : top * 256 + 256] + b[(top - 1) * 256 : top * 256]
        for at in range(43 if top == 11 else 4, 512 - 38, 39):
            e = d[at : at + 39]
            kind, name = e[0] >> 4, e[1 : 1 + (e[0] & 15)].decode("latin-1")
            if kind not in (1, 2, 3) or not name or name in seen:
                continue
            seen.add(name)
            key, size = _le(e, 17), _le(e, 21, 3)
            found = next((f for f in (_indexed_file(v, kind, key, size) for v in views) if f is not None), None)
            if found is None:
                found = b[key * 512 : min(FLOPPY_BLOCKS, key + -(-size // 512)) * 512][:size]
            yield Entry(name, found, size, e[16], _le(e, 31), _le(e, 19))
        if not _le(d, 2):
            break


def dos33(b: bytes) -> Iterator[Entry]:
    _need(len(b) == 143360)
    at = lambda ts: b[((ts >> 8) * 16 + (ts & 255)) * 256 :][:256] if ts >> 8 < 35 and ts & 255 < 16 else b""
    vtoc = at(17 << 8)
    _need(vtoc[1] < 35 and vtoc[2] < 16 and vtoc[0x34] in (0, 35) and vtoc[0x35] in (0, 16) and vtoc[1] > 0)

    def following(ts: int) -> int | None:
        d = at(ts)
        return d[1] << 8 | d[2] if d and d[1] else None

    def body(ts: int) -> bytes:
        out = b""
        for k in chain(ts, following, 1000):
            d = at(k)
            for p in range(12, 256, 2) if d else ():
                if d[p]:
                    out += at(d[p] << 8 | d[p + 1])
        return out

    for ts in chain(vtoc[1] << 8 | vtoc[2], following, 100):
        d = at(ts)
        for p in range(11, 256 - 34, 35) if d else ():
            e = d[p : p + 35]
            if e[0] in (0, 255):
                continue
            content, kind, load = body(e[0] << 8 | e[1]), e[2] & 127, 0
            size = len(content)
            if kind == 4 and size >= 4:
                load, content = _le(content, 0), content[4 : 4 + _le(content, 2)]
            yield Entry(_seven_bit(e[3:33]), content, size, kind, load, _le(e, 33))


def prodos(b: bytes) -> Iterator[Entry]:
    _need(len(b) >= 1536)
    block = lambda k: b[k * 512 : k * 512 + 512]
    head = block(2)
    _need(head[4] >> 4 == 15 and head[4] & 15 > 0 and all(c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789." for c in head[5 : 5 + (head[4] & 15)]) and _le(head, 4 + 0x21) < 1000)

    def indexed(key: int, n: int) -> list[int]:
        d = block(key)
        return [d[i] | d[256 + i] << 8 for i in range(n)] if len(d) == 512 else []

    def body(kind: int, key: int, size: int) -> bytes:
        n = -(-size // 512)
        if kind == 1:
            keys = [key]
        elif kind == 2:
            keys = indexed(key, min(256, n))
        else:
            keys = [k for index in indexed(key, min(128, -(-n // 256))) for k in (indexed(index, 256) if index else [0] * 256)]
        return b"".join(block(k).ljust(512, b"\0") if k else bytes(512) for k in keys[:n])[:size]

    def walk(first: int, parent: str, depth: int) -> Iterator[Entry]:
        start = True
        for k in chain(first, lambda k: _le(block(k), 2) or None, 100):
            d = block(k)
            for at in range(4 + 39 * start, 512 - 39, 39):
                e = d[at : at + 39]
                kind = e[0] >> 4 if e else 0
                if kind in (1, 2, 3, 13):
                    name, size = e[1 : 1 + (e[0] & 15)].decode("latin-1"), _le(e, 21, 3)
                    if kind == 13:
                        inner = list(walk(_le(e, 17), f"{parent}{name}/", depth + 1)) if depth < 16 else []
                        yield Entry(name, b"", sum(x.size for x in inner if x.parent == f"{parent}{name}/"), e[16], parent=parent, is_directory=True, blocks=_le(e, 19))
                        yield from inner
                    else:
                        yield Entry(name, body(kind, _le(e, 17), size), size, e[16], _le(e, 31), _le(e, 19), parent)
            start = False

    yield from walk(2, "", 0)


def apple_any_order(b: bytes) -> Iterator[Entry]:
    """ProDOS, DOS 3.3, or ProDOS on a disk in DOS order."""
    for reader in (prodos, dos33, prodos_in_dos_order, lambda x: prodos(to_prodos_order(x))):
        try:
            found = list(reader(b))
        except (NotThis, IndexError):
            continue
        if found:
            return iter(found)
    raise NotThis


def two_img(b: bytes) -> Iterator[Entry]:
    _need(b[:4] == b"2IMG" and len(b) > 64)
    at, n = _le(b, 24, 4), _le(b, 28, 4)
    body = b[at : at + n] if n else b[at:]
    return dos33(body) if b[12] == 0 else apple_any_order(body)


# ---- Amiga --------------------------------------------------------------------------------------


def adf(b: bytes) -> Iterator[Entry]:
    _need(len(b) in (901120, 1802240) and b[:3] == b"DOS")
    block = lambda k: b[k * 512 : k * 512 + 512] if 0 < k * 512 <= len(b) - 512 else b""
    fast, root = b[3] & 1, len(b) // 1024
    name_of = lambda d: d[433 : 433 + min(30, d[432])].decode("latin-1")

    def body(d: bytes, key: int, size: int) -> bytes:
        keys: list[int] = []
        for k in chain(key, lambda k: _be(block(k), 504) or None, 1000):
            e = block(k)
            if not e:
                break
            keys += [_be(e, 308 - 4 * i) for i in range(min(72, _be(e, 8)))]
        parts = [block(k) for k in keys]
        if fast:
            return b"".join(parts)[:size]
        if not all(len(p) == 512 and _be(p, 0) == 8 and _be(p, 4) == key for p in parts) or not parts:
            # A broken list: the data blocks name their file and their place in it.
            parts = [p for p in (b[i : i + 512] for i in range(0, len(b), 512)) if _be(p, 0) == 8 and _be(p, 4) == key]
        parts = list({_be(p, 8): p for p in reversed(parts)}.items())
        return b"".join(p[24 : 24 + min(488, _be(p, 12))] for _, p in sorted(parts))[:size]

    def walk(key: int, parent: str, depth: int) -> Iterator[Entry]:
        d = block(key)
        for slot in range(24, 312, 4) if d else ():
            first = _be(d, slot)
            for k in chain(first, lambda k: _be(block(k), 496) or None, 1000) if first else ():
                e = block(k)
                if not e:
                    break
                kind, size = _be(e, 508), _be(e, 324)
                if kind == 2:
                    yield Entry(name_of(e), parent=parent, is_directory=True)
                    if depth < 16:
                        yield from walk(k, f"{parent}{name_of(e)}/", depth + 1)
                elif kind == 0xFFFFFFFD:
                    yield Entry(name_of(e), body(e, k, size), size, parent=parent)

    yield from walk(root, "", 0)


# ---- Amstrad CPC --------------------------------------------------------------------------------


def cpc_dsk(b: bytes) -> Iterator[Entry]:
    extended = b[:21] == b"EXTENDED CPC DSK File"
    _need(len(b) > 256 and (extended or b[:8] == b"MV - CPC"))
    tracks, sides = b[0x30], b[0x31]
    sectors: dict[tuple[int, int], bytes] = {}
    at = 256
    for t in range(tracks * sides):
        size = b[0x34 + t] * 256 if extended else _le(b, 0x32)
        info, data = b[at : at + 256], at + 256
        if size and info[:10] == b"Track-Info":
            for s in range(min(29, info[0x15])):
                e = info[0x18 + 8 * s : 0x20 + 8 * s]
                n = _le(e, 6) if extended and _le(e, 6) else 128 << (e[3] & 7)
                sectors[t, e[2]] = b[data : data + n]
                data += n
        at += size
    base = next((k for k in (0xC1, 0x41, 0x01) if any(s == k for _, s in sectors)), None)
    _need(base is not None)
    skip = {0xC1: 0, 0x41: 2, 0x01: 1}[base]
    linear = lambda n: sectors.get(((n // 9 + skip) * sides, base + n % 9), b"")
    catalogue = b"".join(linear(n) for n in range(4))
    extents: dict[str, list[tuple[int, int, list[int]]]] = {}
    for at in range(0, len(catalogue) - 31, 32):
        e = catalogue[at : at + 32]
        if e[0] > 15 or not e[1] & 127 or e[1] == 0xE5:
            continue
        stem, ext = _seven_bit(e[1:9]), _seven_bit(e[9:12])
        extents.setdefault(f"{stem}.{ext}" if ext else stem, []).append((e[12] + e[14] * 32, e[15], [k for k in e[16:32] if k]))
    for name in sorted(extents, key=str.lower):
        parts = sorted(extents[name])
        size = sum(records for _, records, _ in parts) * 128
        content = b"".join(linear(k * 2) + linear(k * 2 + 1) for _, _, blocks in parts for k in blocks)
        yield Entry(name, content[:size], size, blocks=sum(len(p[2]) for p in parts))


# ---- Atari 8-bit, BBC, CoCo, TR-DOS -------------------------------------------------------------


def atr(b: bytes) -> Iterator[Entry]:
    _need(b[:2] == b"\x96\x02" and len(b) > 16 and _le(b, 4) in (128, 256, 512))
    size = _le(b, 4)
    short = 3 if size > 128 and (len(b) - 16) % size == 384 % size else 0  # the first three sectors have 128 bytes

    def sector(k: int) -> bytes:
        if k < 1:
            return b""
        at = 16 + (k - 1) * 128 if k <= short else 16 + short * 128 + (k - 1 - short) * size
        return b[at : at + (128 if k <= short else size)]

    def body(first: int, count: int) -> bytes:
        def following(k: int) -> int | None:
            d = sector(k)
            return (d[-3] & 3) << 8 | d[-2] or None if len(d) == size else None

        out = b"".join(d[: min(d[-1], size - 3)] for d in (sector(k) for k in chain(first, following)) if len(d) == size)
        if len(out) >= max(1, (count - 1) * (size - 3) // 2):
            return out
        return b"".join(sector(first + k) for k in range(count))

    found = False
    for at in (e for k in range(361, 369) for d in [sector(k)] for e in (d[i : i + 16] for i in range(0, min(128, len(d)), 16))):
        if at[0] & 0x42 and not at[0] & 0x80 and len(at) == 16:
            found = True
            stem, ext = at[5:13].decode("latin-1").rstrip(), at[13:16].decode("latin-1").rstrip()
            content = body(_le(at, 3), _le(at, 1))
            yield Entry(f"{stem}.{ext}" if ext else stem, content, len(content), at[0], blocks=_le(at, 1))
    if not found:  # no directory: whole screens
        for at in filled_slices(np.frombuffer(b, np.uint8)[16:], 7680, (0,), 100)[0].tolist():
            yield Entry(f"SCREEN{at // 7680 + 1}.GR8", b[16 + at : 16 + at + 7680], 7680)


def dfs(b: bytes) -> Iterator[Entry]:
    _need(len(b) >= 1024 and b[0x105] % 8 == 0 and b[0x105] // 8 <= 31 and len(b) <= 409600 + 1024)
    n, sectors = b[0x105] // 8, (b[0x106] & 3) << 8 | b[0x107]
    _need(sectors in (400, 800) or n > 0 and sectors * 256 <= 2 * len(b))
    for i in range(n):
        name, info = b[8 + 8 * i : 16 + 8 * i], b[0x108 + 8 * i : 0x110 + 8 * i]
        high = info[6]
        size, first, load = _le(info, 4) | (high >> 4 & 3) << 16, info[7] | (high & 3) << 8, _le(info, 0) | (high >> 2 & 3) << 16
        yield Entry(_seven_bit(name[:7]), b[first * 256 : first * 256 + size], size, name[7] & 127, load)


def rs_dos(b: bytes) -> Iterator[Entry]:
    _need(140000 <= len(b) <= 380000)
    track = 17 * 18 * 256
    fat = b[track + 256 : track + 256 + 68]
    _need(sum(v < 68 or 0xC0 <= v <= 0xC9 or v == 0xFF for v in fat) >= 60 and any(v == 0xFF or v >= 0xC0 for v in fat))
    granule = lambda g: b[(g // 2 + (g >= 34)) * 4608 + g % 2 * 2304 :][:2304]
    entries = b[track + 512 : track + 512 + 72 * 32]
    for at in range(0, len(entries), 32):
        e = entries[at : at + 32]
        if e[0] == 255 and entries[at + 32 : at + 33] == b"\xff":
            break
        if e[0] in (0, 255):
            continue
        out, last = b"", None
        for g in chain(e[13], lambda g: fat[g] if fat[g] < 68 else None, 68) if e[13] < 68 else ():
            out, last = out + granule(g), fat[g]
        if last is not None and 0xC0 <= last <= 0xC9:
            full = len(out) - 2304
            out = out[: full + max(0, (last & 15) - 1) * 256 + _be(e, 14, 2)]
        stem, ext = e[:8].decode("latin-1").rstrip(), e[8:11].decode("latin-1").rstrip()
        yield Entry(f"{stem}.{ext}" if ext else stem, out, len(out), e[11])


def tr_dos(b: bytes) -> Iterator[Entry]:
    _need(len(b) >= 2304 and b[2048 + 231] == 0x10 and b[2048 + 227] in (0x16, 0x17, 0x18, 0x19))
    for at in range(0, 2048, 16):
        e = b[at : at + 16]
        if e[0] == 0:
            break
        if e[0] > 1:
            first, length = (e[15] * 16 + e[14]) * 256, _le(e, 11)
            yield Entry(f"{e[:8].decode('latin-1').rstrip()}.{chr(e[8])}", b[first : first + min(length, e[13] * 256) if length else first + e[13] * 256], length, e[8], _le(e, 9), e[13])


# ---- the table function -------------------------------------------------------------------------

#: Formats in the order in which they are tried; the first that the blob fits gives the rows.
READERS: tuple[tuple[str, Callable[[bytes], Iterator[Entry]]], ...] = (
    ("2IMG", two_img), ("CPC", cpc_dsk), ("ATR", atr), ("D64", d64), ("ADF", adf), ("TR-DOS", tr_dos), ("MSX", msx), ("Atari ST", atari_st), ("CoCo", rs_dos), ("Apple II", apple_any_order), ("BBC Micro", dfs),
)


#: Formats whose catalogues are shown by name; a directory comes before what it holds.
BY_NAME = ("CPC", "ATR", "MSX", "Atari ST", "CoCo", "BBC Micro")


def catalogue(content: bytes) -> tuple[str, list[Entry]] | None:
    """The format's name and all entries, or None if no reader knows the blob."""
    for name, reader in READERS:
        try:
            found = list(reader(content))
        except (NotThis, IndexError):
            continue
        if found:
            return name, sorted(found, key=lambda e: (e.parent + e.name).lower().split("/")) if name in BY_NAME else found
    return None


_ENTRY = [
    ("disk_format", pa.string()), ("entry_path", pa.string()), ("parent_path", pa.string()), ("depth", pa.int32()), ("ord", pa.int32()), ("name", pa.string()), ("file_type", pa.int32()),
    ("size", pa.int64()), ("blocks", pa.int32()), ("load_address", pa.int32()), ("content", pa.binary()), ("is_directory", pa.bool_()),
]
_SQL = "disk_format string, entry_path string, parent_path string, depth int, ord int, name string, file_type int, size long, blocks int, load_address int, content binary, is_directory boolean"


def disk_entries(files: DataFrame) -> DataFrame:
    """``files(path, name, content)`` to a row for each entry of each disk image; other files have none."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, disk, content in zip(batch.column("path").to_pylist(), batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                got = catalogue(content) if content else None
                if got is None:
                    continue
                rows = [
                    {"disk_format": got[0], "entry_path": e.parent + e.name, "parent_path": e.parent, "depth": e.parent.count("/"), "ord": k, "name": e.name, "file_type": e.file_type, "size": e.size,
                     "blocks": e.blocks, "load_address": e.load_address, "content": e.content, "is_directory": e.is_directory}
                    for k, e in enumerate(got[1])
                ]
                cols = [pa.array([path] * len(rows), pa.string()), pa.array([disk] * len(rows), pa.string()), *(pa.array([r[n] for r in rows], t) for n, t in _ENTRY)]
                yield pa.RecordBatch.from_arrays(cols, names=["disk_path", "disk_name", *(n for n, _ in _ENTRY)])

    return files.select("path", "name", "content").mapInArrow(run, f"disk_path string, disk_name string, {_SQL}")


def extents(pairs: DataFrame, file: str, order: str, block: str) -> DataFrame:
    """``extents``, a file's blocks in order as ``order:block``, and ``n``, their number."""
    listed = F.sort_array(F.collect_list(F.struct(order, block)))
    text = F.array_join(F.transform(listed, lambda p: F.concat_ws(":", p[order], p[block])), " ")
    return pairs.groupBy(file).agg(text.alias("extents"), F.count("*").alias("n"))


def rollup_counts(entries: DataFrame, by: str, is_file: Column, is_image: Column) -> DataFrame:
    """``entries``, ``files`` and ``images`` of each group."""
    return entries.groupBy(by).agg(F.count("*").alias("entries"), F.count_if(is_file).alias("files"), F.count_if(is_image).alias("images"))


def counts(entries: DataFrame, is_image: Column | None = None) -> DataFrame:
    """Files, directories and images of each disk, and the files' bytes; ``is_image`` is the caller's test, none by default."""
    is_file = ~F.col("is_directory")
    image = F.lit(False) if is_image is None else is_image & is_file
    return entries.groupBy("disk_path").agg(
        F.count_if(is_file).alias("files"), F.count_if(image).alias("images"), F.count_if("is_directory").alias("directories"), F.sum(F.when(is_file, F.col("size"))).alias("bytes")
    )


def directory_sizes(entries: DataFrame, directory: str, name: str, counted: str, size: str) -> DataFrame:
    """``files`` and ``size`` of each entry and, with an empty ``name``, of each directory; absent files count as 0."""
    sums = entries.rollup(directory, name).agg(F.count(counted).alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("size"), F.grouping(directory).alias("_all"), F.grouping(name).alias("_whole"))
    return sums.where("_all = 0").withColumn(name, F.when(F.col("_whole") == 1, "").otherwise(F.col(name))).drop("_all", "_whole")
