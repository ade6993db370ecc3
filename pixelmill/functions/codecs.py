"""Decompressors of the file formats. Each is a state machine over bytes, bounded by an output cap."""

from __future__ import annotations


def pack_bytes(data: bytes, most: int = 65536) -> bytes:
    """PackBytes: the two top bits choose literal, repeated byte, repeated four bytes, or byte repeated by four."""
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < most:
        kind, count = data[at] >> 6, (data[at] & 63) + 1
        at += 1
        if kind == 0:
            out += data[at : at + count]
            at += count
        elif kind == 2:
            out += data[at : at + 4] * count if at + 4 <= n else b""
            at += 4
        elif at < n:
            out += data[at : at + 1] * (count * (4 if kind == 3 else 1))
            at += 1
    return bytes(out[:most])


def pack_bits(data: bytes, most: int = 65536, run_of_128: bool = False) -> bytes:
    """PackBits: up to 127 a literal of n + 1, above 128 a run of 257 - n; 128 is nothing, or a run of 129."""
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < most:
        c = data[at]
        at += 1
        if c < 128:
            out += data[at : at + c + 1]
            at += c + 1
        elif c > 128 or run_of_128:
            if at < n:
                out += data[at : at + 1] * (257 - c)
            at += 1
    return bytes(out[:most])


def pcx_rle(data: bytes, most: int) -> bytes:
    """Runs where the two top bits are set, else a byte by itself."""
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < most:
        c = data[at]
        at += 1
        if c >= 192:
            if at < n:
                out += data[at : at + 1] * (c & 63)
            at += 1
        else:
            out.append(c)
    return bytes(out[:most])


def lzw(data: bytes, most: int = 50_000) -> bytes | None:
    """LZW with codes of 9 to 12 bits, low bits first; 256 clears, 257 ends. None if nothing comes out."""
    out, table, width, bits, held, at = bytearray(), {}, 9, 0, 0, 0
    last = b""
    while len(out) <= most:
        while held < width and at < len(data):
            bits |= data[at] << held
            held += 8
            at += 1
        if held < width:
            break
        code = bits & ((1 << width) - 1)
        bits >>= width
        held -= width
        if code == 257:
            break
        if code == 256:
            table, width, last = {}, 9, b""
            continue
        if code < 256:
            entry = bytes([code])
        elif code in table:
            entry = table[code]
        elif last and code == 258 + len(table):
            entry = last + last[:1]
        else:
            break
        out += entry
        if last and len(table) < 4096 - 258:
            table[258 + len(table)] = last + entry[:1]
            if 258 + len(table) >= 1 << width and width < 12:
                width += 1
        last = entry
    return bytes(out) or None
