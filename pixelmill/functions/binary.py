"""Integers and structs out of binary columns, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_uint(blob: Column, offset: int, size: int) -> Column:
    """Unsigned big-endian integer of up to 7 bytes at an offset; 0 beyond the end."""
    part = F.substring(blob, offset + 1, size)
    return F.when(F.length(blob) >= offset + size, F.conv(F.hex(part), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def le_uint(blob: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian integer of up to 7 bytes at an offset; 0 beyond the end."""
    digits = F.concat(*(F.hex(F.substring(blob, offset + k + 1, 1)) for k in reversed(range(size))))
    return F.when(F.length(blob) >= offset + size, F.conv(digits, 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def starts_with(blob: Column, magic: bytes) -> Column:
    return F.hex(F.substring(blob, 1, len(magic))) == magic.hex().upper()


def holds(blob: Column, offset: int, magic: bytes) -> Column:
    return F.hex(F.substring(blob, offset + 1, len(magic))) == magic.hex().upper()


def extension(name: Column) -> Column:
    """What follows the last dot, lower-cased; empty without one."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.element_at(F.split(name, "[.]"), -1))).otherwise(F.lit(""))
