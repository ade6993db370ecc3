"""The ordered classifier: extension, signature, size and content statistics to a kernel's name.

One ``F.when`` chain over the file's metadata and first bytes; the content statistics that overlapping sizes need are
taken by one kernel, only for the sizes that need them. The first match wins, and the order is part of the result:
``pi3`` and ``pic`` go to the CoCo rules before the Atari ones, ``gr5`` to MSX, and 32000 bytes are always CoCo 3.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pixelmill.functions.binary import extension, holds, starts_with
from pixelmill.operators.pixels import nibbles
from pixelmill.runtime import ship, unused

# The extensions that decide a family by themselves, in the order in which they are tried.
MODERN = "png jpg jpeg gif tiff tif heic heif webp".split()
MSX_EXT = {"msx1": "sc1 ge1".split(), "msx2": "sc2 sr2 ge2".split(), "msx5": "sc5 sr5 sc7 ge5 ge7 gr5".split(), "msx8": "sc8 sr8 ge8".split()}
BBC_EXT = {0: "bbm0 mode0", 1: "bbm1 mode1 bbc", 2: "bbm2 mode2", 4: "bbm4 mode4", 5: "bbm5 mode5"}
COCO_EXT = "max cm3 pi3 mg3 pic pix bin".split()
ATARI_EXT = {"gr8": "gr8", "gr9": "gr9", "gr11": "gr11", "gr10": "gr10", "gr15": "gr15 gr7", "mic": "mic"}
ATARI_CUT = "gr1 gr2 gr3 gr4 gr6".split()
DISK_EXT = "2mg hdv po do dsk d64 adf st msa atr ssd dsd trd img xdf".split()
PRODOS = {"#c00000": "paintworks", "#c00001": "shr_packed", "#c00002": "apf", "#c00003": "apf", "#c08005": "dreamgrafix_packed", "#c10000": "shr", "#c10002": "shr3200", "#c18003": "dreamgrafix"}


def cpc_or_dhgr(b: np.ndarray) -> str:
    """Which of two 16 KB formats: CPC screens have rich blocks, double hi-res pages start with zeros."""
    rich = sum(len(np.unique(b[i : i + 100])) > 50 for i in range(0, len(b), 2048))
    blocks = -(-len(b) // 2048)
    dhgr = blocks - rich + 3 * int((b[:1024] == 0).sum() > 512)
    return "cpc" if rich > dhgr + 2 else "dhgr"


# Fixed values of the PMODE test: transitions and mixed pairs from which a screen is dithered, the share from which a pair
# value counts as used, the share of solid bytes, and the bytes that are solid.
DITHERED, MIXED, USED, SOLID, SOLID_BYTES = 0.35, 0.40, 20, 0.30, (0x00, 0xFF, 0xAA, 0x55)
# Fixed values of the CoCo 3 test: bound of chi-square, nibbles used, share of equal pairs, pairs used, share of bytes near
# the one above, rows that are compared, and the score of 640 columns.
CHI, NIBBLES_USED, EQUAL_PAIRS, PAIRS_USED, NEAR, NEAR_ROWS, WIDE = 8000, 12, 0.15, 3, 0.30, 100, 3


def _pairs(v: np.ndarray) -> np.ndarray:
    """How often each two-bit value occurs."""
    return np.bincount(np.concatenate([v >> s & 3 for s in (6, 4, 2, 0)]), minlength=4)


def pmode_3_or_4(b: np.ndarray) -> str:
    """One-bit screens are dithered (many transitions or mixed pairs) or hold two opposite pair values only."""
    v = b[:6144].astype(np.int64)
    if not len(v):
        return "pmode4"
    n = _pairs(v)
    used = set(np.flatnonzero(n > n.sum() // USED).tolist())
    dithered = np.unpackbits(((v ^ v >> 1) & 127).astype(np.uint8)).sum() / (7 * len(v)) > DITHERED or (n[1] + n[2]) / n.sum() > MIXED
    solid = np.isin(v, SOLID_BYTES).mean() > SOLID and len(used) <= 2
    return "pmode4" if dithered or solid or used in ({0, 3}, {1, 2}) else "pmode3"


def coco3_320_or_640(b: np.ndarray) -> str:
    """A table of signals and their weights; enough of them make it 640 columns."""
    v = b[:32000]
    if not len(v):
        return "coco3_320"
    n, pairs = np.bincount(nibbles(v), minlength=16).astype(float), _pairs(v.astype(np.int64))
    even = n.sum() / 16
    rows = v[: (NEAR_ROWS + 1) * 160].astype(np.int64)
    near = np.abs(rows[160:] - rows[:-160]) < 64
    signals = (
        (2, ((n - even) ** 2).sum() / even < CHI),
        (2, (n > n.sum() // 100).sum() >= NIBBLES_USED),
        (1, n[[0, 5, 10, 15]].sum() / n.sum() > EQUAL_PAIRS),
        (2, (pairs > pairs.sum() // 50).sum() >= PAIRS_USED),
        (1, len(near) > 0 and near.mean() > NEAR),
    )
    return "coco3_640" if sum(weight for weight, holds_true in signals if holds_true) >= WIDE else "coco3_320"


_TESTS = {"?16384": cpc_or_dhgr, "?6144": pmode_3_or_4, "?32016": coco3_320_or_640}


@F.arrow_udf(StringType())
def _tested(kernel: pa.Array, content: pa.Array) -> pa.Array:
    """The kernel that the content of an undecided file tells; what is decided comes without content and goes as it came."""
    kinds = kernel.to_pylist()
    for i, k in enumerate(kinds):
        if k in _TESTS:
            kinds[i] = _TESTS[k](np.frombuffer(content[i].as_buffer(), np.uint8))
    return pa.array(kinds, pa.string())


def paintworks_palette(content: Column) -> Column:
    """Whether the high nibbles of the first 16 little-endian words are 0."""
    return F.forall(F.sequence(F.lit(0), F.lit(15)), lambda k: F.substring(F.hex(F.substring(content, 1, 32)), k * 4 + 3, F.lit(1)) == "0")


def is_disk(name: Column, content: Column) -> Column:
    """Whether a file goes to the disk readers: by its extension, unless it starts as a modern image does."""
    magic = starts_with(content, b"\x89PNG") | starts_with(content, b"\xff\xd8") | starts_with(content, b"GIF") | starts_with(content, b"BM") | starts_with(content, b"\x0a")
    return extension(name).isin(DISK_EXT) & ~magic


def first_match(rules: list[tuple[Column, str | Column]], otherwise: str | None = None) -> Column:
    """The value of the first rule that holds; ``otherwise`` if none does."""
    out = F.lit(otherwise).cast("string")
    for test, value in reversed(rules):
        out = F.when(test, F.lit(value) if isinstance(value, str) else value).otherwise(out)
    return out


def contains_text(column: Column, part: str) -> Column:
    """Whether a text holds ``part``, whatever the case."""
    return F.lower(column).contains(part.lower())


def kernel_of(name: Column, content: Column) -> Column:
    """The kernel's name from metadata and signatures; ``?size`` where the content has to decide, null for unknown."""
    ext, size, low = extension(name), F.length(content), F.lower(name)
    first = F.conv(F.hex(F.substring(content, 1, 1)), 16, 10).cast("int")
    second = F.conv(F.hex(F.substring(content, 2, 1)), 16, 10).cast("int")
    rules: list[tuple[Column, str | Column]] = [(ext.isin(MODERN), "modern")]
    rules += [(ext.isin(e), k) for k, e in MSX_EXT.items()]
    rules += [(ext.isin(e.split()), f"bbc{m}") for m, e in BBC_EXT.items()]
    coco = F.when(size == 32016, "?32016").when(size >= 24000, "coco3_320").when(size.between(6144, 6145), "?6144").when(size == 1024, "trs80")
    rules += [(ext.isin(COCO_EXT), coco), (ext.isin("pi1", "pi2"), F.lit("degas"))]
    rules += [(ext.isin(e.split()), k) for k, e in ATARI_EXT.items()]
    rules += [(ext.isin(ATARI_CUT), F.when(size == 7689, "gr10").otherwise("gr15")), ((ext == "neo") & (size == 32128), "neochrome")]
    rules += [
        ((size >= 8) & (starts_with(content, b"\x89PNG") | starts_with(content, b"\xff\xd8") | starts_with(content, b"GIF")), "modern"),
        ((size >= 14) & starts_with(content, b"BM"), "bmp"),
        ((size >= 128) & (first == 0x0A), "pcx"),
    ]
    rules += [(low.contains(tag) & (size >= {"shr": 32000, "shr3200": 38400}.get(k, 0)), k) for tag, k in PRODOS.items()]
    load = (first == 0) & second.isin(0x60, 0x58, 0x40)
    rules += [
        (low.contains(".3201"), "shr3201"),
        (holds(content, 4, b"\x04MAIN") | holds(content, 4, b"\x08MULTIPAL"), "apf"),
        (F.hex(F.substring(content, -10, 10)) == b"DreamWorld".hex().upper(), "dreamgrafix_packed"),
        ((size >= 12) & starts_with(content, b"FORM"), "iff"),
        (size.between(10000, 10001), "plus4"),
        (size.between(10002, 10004) & (first < 128) & (second < 128) & ~load, "plus4"),
        (size.between(10003, 10010), "koala"),
        (size == 10018, "art_studio"), (size == 9009, "c64_hires"), (size == 9002, "art_studio_hires"), (size == 6912, "zx"), (size.between(3060, 3500), "vic20"),
        (size == 16384, F.when(ext == "scr", "cpc").when(ext.isin("2mg", "po", "dsk"), "dhgr").otherwise("?16384")),
        (size == 16512, "cpc"), (size.between(54272, 54279), "msx8"), (size.between(27136, 27143), "msx5"), (size.between(14336, 14343), "msx2"),
        (size.isin(20480, 20736), "bbc1"), (size.isin(10240, 10496), "bbc4"), (size == 7680, "gr8"), (size == 1024, "trs80"), (size == 6144, "?6144"), (size == 32000, "coco3_320"),
        (ext.isin("mac", "pntg") & (size >= 512), "macpaint"),
        (size.isin(32034, 32066) & (first == 0) & (second <= 2), "degas"),
        (size.between(32767, 32768), "shr"), (size >= 38400, "shr3200"), (size.between(8184, 8200), "hgr"),
        ((size >= 546) & paintworks_palette(content), "paintworks"), (size.between(24000, 33000), "coco3_320"), (size.between(20000, 100000), "macpaint"),
    ]
    return F.when(size > 0, first_match(rules))


def classify(files: DataFrame, kernel: Column | None = None) -> DataFrame:
    """``files(name, content, ...)`` with the name of the ``kernel`` that decodes each; null if unknown.

    ``kernel`` takes the place of ``kernel_of`` where more is known of the files. Python gets the names of kernels, and
    the bytes of files alone whose size leaves the kernel open.
    """
    ship(files.sparkSession)
    (first,) = unused(files, "kernel")
    named = files.withColumn(first, kernel_of(F.col("name"), F.col("content")) if kernel is None else kernel)
    undecided = F.col(first).startswith("?")
    return named.withColumn("kernel", _tested(F.col(first), F.when(undecided, F.col("content")))).drop(first)


def filtered_by_platform(images: DataFrame, platform: str) -> DataFrame:
    """Images whose family holds ``platform``, whatever its case; all for an empty one."""
    return images.where(contains_text(F.col("family"), platform)) if platform else images
