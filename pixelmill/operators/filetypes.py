"""File types of disk entries: the ProDOS table, labels of other systems, and the kernel that an entry goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions.binary import extension, le_uint, starts_with
from pixelmill.operators.classify import contains_text, first_match, kernel_of
from pixelmill.operators.export import name_with_type

# ProDOS type, auxiliary type (* for any other), short name, category and description. All types of the
# category Graphics hold images but C3 and CA.
PRODOS_TYPES = """
08 4000 HGR Graphics Packed Hi-Res
08 4001 DHGR Graphics Packed Double Hi-Res
08 8001 HGR Graphics Printographer Packed HGR
08 8002 DHGR Graphics Printographer Packed DHGR
08 8003 HGR Graphics Softdisk Hi-Res
08 8004 DHGR Graphics Softdisk Double Hi-Res
08 2000 HGR Graphics Hi-Res Graphics
08 * FOT Graphics Apple II Graphics
C0 0000 PNT Graphics Paintworks Packed
C0 0001 SHR Graphics Packed Super Hi-Res
C0 0002 PIC Graphics Apple Preferred Format
C0 0003 PICT Graphics Packed QuickDraw II PICT
C0 8001 PIC Graphics GTv Background
C0 8005 DGX Graphics DreamGrafix
C0 8006 GIF Graphics GIF Image
C0 * PNT Graphics Packed Super Hi-Res
C1 0000 SHR Graphics Super Hi-Res Screen
C1 0001 PICT Graphics QuickDraw PICT
C1 0002 SHR Graphics SHR 3200 Color
C1 8001 IMG Graphics Allison Raw Image
C1 8002 IMG Graphics ThunderScan
C1 8003 DGX Graphics DreamGrafix
C1 * PIC Graphics Super Hi-Res Picture
C2 * ANI Graphics Paintworks Animation
C3 * PAL Graphics Paintworks Palette
53 8010 DRW Graphics AppleWorks GS Graphics
53 * DRW Graphics Drawing
C5 8000 DRW Graphics Draw Plus
C5 C000 ARC Graphics DYOH Architecture
C5 C006 LND Graphics DYOH Landscape
C5 C007 PYW Graphics PyWare
C5 * OOG Graphics Object Graphics
00 * NON General Unknown
01 * BAD System Bad Blocks
04 * TXT Text Text File
06 * BIN Code Binary
07 * FNT Font Apple III Font
02 * PCD Code Pascal Code (SOS)
03 * PTX Text Pascal Text (SOS)
05 * PDA Data Pascal Data (SOS)
09 * BA3 Code Apple III BASIC
0A * DA3 Data Apple III Data
0B 8001 WTW Productivity Write This Way
0B 8002 W&P Productivity Writing & Publishing
0B * WPF Productivity Word Processor
0C * SOS System Apple III SOS System
0F * DIR System Folder
10 * RPD Data RPS Data
11 * RPI Data RPS Index
12 * AFD Data AppleFile Discard
13 * AFM Data AppleFile Model
14 * AFR Data AppleFile Report
15 * SCL Data Screen Library
16 0001 PFS Productivity PFS:File
16 0002 PFS Productivity PFS:Write
16 0003 PFS Productivity PFS:Graph
16 0004 PFS Productivity PFS:Plan
16 * PFS Productivity PFS Document
19 * ADB Productivity AppleWorks Database
1A * AWP Productivity AppleWorks Word Proc
1B * ASP Productivity AppleWorks Spreadsheet
20 * TDM Productivity Desktop Manager
2A * 8SC Code Apple II Source Code
2B 8001 8OB Code GBBS Pro Object
2B * 8OB Code Apple II Object Code
2C * 8IC Code Apple II Interpreted
2D * 8LD Code Apple II Language Data
2E * P8C Code ProDOS 8 Module
40 * DIC Data Dictionary
41 * OCR Data OCR Data
42 * FTD System File Type Names
50 8010 GWP Productivity AppleWorks GS WP
50 5445 TCH Productivity Teach Document
50 8001 DWR Productivity DeluxeWrite
50 8003 PJN Productivity Personal Journal
50 * GWP Productivity GS Word Processing
51 8010 GSS Productivity AppleWorks GS SS
51 * GSS Productivity GS Spreadsheet
52 8010 GDB Productivity AppleWorks GS DB
52 8013 GSA Productivity GSAS Accounting
52 8014 GSA Productivity GSAS Accounting
52 * GDB Productivity GS Database
54 8010 GDP Productivity AppleWorks GS DTP
54 DD3E MED Productivity Medley
54 * GDP Productivity Desktop Publishing
55 0001 HYP Hypermedia HyperCard GS Stack
55 8002 HYP Hypermedia HyperStudio
55 8003 NEX Hypermedia Nexus
55 * HMD Hypermedia Hypermedia
56 * EDU Education Educational Data
57 * STN Productivity Stationery
58 * HLP System Help File
59 * COM Communications Communications
5A * CFG System Configuration
5B * ANM Multimedia Animation
5C * MUM Multimedia Multimedia
5D * ENT Entertainment Game/Entertainment
5E * DVU Development Development Utility
5F * FIN Productivity Financial
6B * BIO System PC Transporter BIOS
6D * TDR System PC Transporter Driver
6E * PRE System PC Transporter Pre-boot
6F * HDV System PC Transporter Volume
A0 * WP Productivity WordPerfect
AB * GSB Code IIGS BASIC Program
AC * TDF Code IIGS BASIC TDF
AD * BDF Data IIGS BASIC Data
FA * INT Code Integer BASIC
FB * IVR Data Integer Variables
FC * BAS Code Applesoft BASIC
FD * VAR Data Applesoft Variables
B0 0001 TXT Code APW Text
B0 0003 ASM Code APW Assembly
B0 0005 PAS Code ORCA Pascal
B0 0008 C Code ORCA C
B0 000A C Code APW C
B0 0719 PS Code PostScript
B0 * SRC Code GS Source Code
B1 * OBJ Code GS Object Code
B2 * LIB Code GS Library
B3 * S16 System GS/OS Application
B4 * RTL System GS Runtime Library
B5 * EXE System GS Shell Application
B6 * PIF System Permanent Init File
B7 * TIF System Temporary Init File
B8 * NDA System New Desk Accessory
B9 * CDA System Classic Desk Accessory
BA * TOL System Tool
BB * DVR System Device Driver
BC * LDF System Load File
BD * FST System File System Translator
BF * DOC Document GS/OS Document
C6 * SCR Code Script
C7 * CDV System Control Panel
C8 0001 TTF Font TrueType Font
C8 * FON Font Font
C9 * FND System Finder Data
CA * ICN Graphics Icons
D5 0000 MCS Multimedia Music Construction Set
D5 0007 SND Multimedia SoundSmith
D5 8003 MTJ Multimedia Master Tracks Jr
D5 * MUS Multimedia Music Sequence
D6 * INS Multimedia Instrument
D7 * MDI Multimedia MIDI Data
D8 * SND Multimedia Sampled Sound
DB * DBM Productivity DB Master
E0 8002 SHK Archive ShrinkIt (NuFX)
E0 0005 DC Archive DiskCopy Image
E0 8000 BNY Archive Binary II
E0 * LBR Archive Archival Library
E2 * ATK Communications AppleTalk Data
EE * R16 Code EDASM 816 Relocatable
EF * PAS System Pascal Area
F0 * CMD Code BASIC Command
F1 * US1 User User #1
F2 * US2 User User #2
F3 * US3 User User #3
F4 * US4 User User #4
F5 * US5 User User #5
F6 * US6 User User #6
F7 * US7 User User #7
F8 * US8 User User #8
F9 * OS System GS/OS System
FE * REL Code Relocatable Code
FF * SYS System ProDOS 8 Application
"""
NOT_IMAGES = (0xC3, 0xCA)

# Labels of the extensions of each system.
LABELS = {
    "Atari ST": {"Degas": "pi1 pi2 pi3", "Degas Elite": "pc1 pc2 pc3", "NEOchrome": "neo", "Tiny": "tny tn1 tn2 tn3", "IFF": "iff lbm", "GEM IMG": "img", "Spectrum 512": "spu spc"},
    "MSX": {
        "MSX Screen 2": "sc2 grp", "MSX Screen 5": "sc5", "MSX Screen 7": "sc7", "MSX Screen 8": "sc8", "MSX Screen C": "scc", "MSX Screen 5 (SR)": "sr5", "MSX Screen 7 (SR)": "sr7",
        "MSX Screen 8 (SR)": "sr8", "MSX Picture": "pic", "MSX GL": "gl", "MSX Graph Saurus": "ge5 ge7 ge8", "BASIC Program": "bas", "Binary": "bin", "Executable": "com", "Data": "dat", "Text": "txt",
    },
    "ATR": {
        "Graphics 8 (Hi-Res)": "gr8", "Graphics 9 (GTIA)": "gr9", "Graphics 15/7 (4-color)": "gr15 gr7", "Graphics 10 (9 colors)": "gr10", "Graphics 11 (GTIA)": "gr11",
        "MicroIllustrator": "mic", "Atari Picture": "pic", "Atari BASIC": "bas", "Executable": "com xex", "Object File": "obj", "Data": "dat", "Text": "txt doc", "Font": "fnt",
    },
    "BBC Micro": {
        "Screen Data": "scr screen", "MODE 0 Screen": "mode0 m0", "MODE 1 Screen": "mode1 m1", "MODE 2 Screen": "mode2 m2", "MODE 4 Screen": "mode4 m4", "MODE 5 Screen": "mode5 m5",
        "BASIC Program": "bas basic", "Text File": "txt text",
    },
}
ST_KERNELS = {"degas": "pi1 pi2 pi3 pc1 pc2 pc3", "neochrome": "neo", "iff": "iff lbm"}
# Bytes of the BBC's large and small screens, with and without colours after them.
LARGE_SCREEN, SMALL_SCREEN = (20480, 20489), (10240, 10245)


def prodos_types(spark: SparkSession) -> DataFrame:
    """``file_type, aux, short_name, category, description, is_graphics``; a null ``aux`` stands for any other."""
    rows = []
    for line in PRODOS_TYPES.strip().splitlines():
        kind, aux, short, category, text = line.split(" ", 4)
        code = int(kind, 16)
        rows.append((code, None if aux == "*" else int(aux, 16), short, category, text, category == "Graphics" and code not in NOT_IMAGES))
    return spark.createDataFrame(rows, "file_type int, aux int, short_name string, category string, description string, is_graphics boolean")


def looked_up(rows: DataFrame, types: DataFrame, kind: str, aux: str, value: Column, name: str, otherwise: Column) -> DataFrame:
    """``name``: ``value`` of the type with the row's kind and aux, else of the kind with a null aux, else ``otherwise``.

    ``types`` holds one row a pair and is small: both joins broadcast it.
    """
    keyed = types.withColumn(name, value)
    exact = keyed.where(F.col(aux).isNotNull()).select(kind, aux, F.col(name).alias(f"{name}_exact"))
    wild = keyed.where(F.col(aux).isNull()).select(kind, F.col(name).alias(f"{name}_any"))
    joined = rows.join(F.broadcast(exact), [kind, aux], "left").join(F.broadcast(wild), kind, "left")
    return joined.withColumn(name, F.coalesce(f"{name}_exact", f"{name}_any", otherwise)).drop(f"{name}_exact", f"{name}_any")


def with_prodos_type(entries: DataFrame) -> DataFrame:
    """``entries(file_type, aux, ...)`` with the struct ``type_info`` of the ProDOS table; unknown types are named by their number."""
    fields = ("short_name", "category", "description", "is_graphics")
    code = F.format_string("$%02X", "file_type")
    unknown = F.struct(code.alias("short_name"), F.lit("Unknown").alias("category"), F.concat(F.lit("Type "), code).alias("description"), F.lit(False).alias("is_graphics"))
    return looked_up(entries, prodos_types(entries.sparkSession), "file_type", "aux", F.struct(*fields), "type_info", unknown)


def type_label(disk_format: Column, name: Column, content: Column, load_address: Column) -> Column:
    """What a directory shows for an entry of an Atari ST, MSX, 8-bit Atari or BBC disk; null for other disks."""
    ext, size = extension(name), F.length(content)
    of = lambda system: disk_format == system
    rules: list[tuple[Column, str | Column]] = [(of("ATR") & ext.isin("gr1 gr2 gr3 gr4 gr5 gr6".split()), F.when(size == 7689, "Graphics 10 (9 colors)").otherwise("Graphics 15 (4-color)"))]
    rules += [(of(system) & ext.isin(e.split()), label) for system, labels in LABELS.items() for label, e in labels.items()]
    low = load_address.bitwiseAND(0xFFFF)
    large, small = size.between(*LARGE_SCREEN), size.between(*SMALL_SCREEN)
    rules += [
        (of("Atari ST") & size.isin(32034, 32066) & (le_uint(content, 0, 2) <= 2), "Degas"), (of("Atari ST") & (size == 32128), "NEOchrome"), (of("Atari ST") & starts_with(content, b"FORM"), "IFF"),
        (of("MSX") & (size >= 7) & starts_with(content, b"\xfe"), "MSX BSAVE"), (of("ATR") & (size >= 4) & starts_with(content, b"\xff\xff"), "Atari Binary"),
        (of("BBC Micro") & low.isin(0x3000, 0x0E00) & large, "Screen (20KB)"), (of("BBC Micro") & low.isin(0x5800, 0x0E00) & small, "Screen (10KB)"),
        (of("BBC Micro") & (size >= 2) & starts_with(content, b"\r"), "BASIC Program"), (of("BBC Micro") & large, "Screen (20KB)"), (of("BBC Micro") & small, "Screen (10KB)"), (of("BBC Micro"), "Binary"),
        (disk_format.isin("Atari ST", "MSX", "ATR"), F.when(ext == "", "Unknown").otherwise(F.upper(ext))),
    ]
    return first_match(rules)


def mode_hint(disk_name: Column) -> Column:
    """The BBC screen mode that a disk's name tells: ``mode2``, ``mode_2`` or ``mode 2``; null without one."""
    found = F.regexp_extract(F.lower(disk_name), "mode[_ ]?([01245])", 1)
    return F.when(found != "", found.cast("int"))


def entry_name(disk_format: Column, name: Column, file_type: Column, load_address: Column) -> Column:
    """The name that the classifier sees: Apple II entries carry their type, as ``name#tttaaaa``."""
    return F.when(disk_format.isin("Apple II", "2IMG"), name_with_type(name, file_type, load_address)).otherwise(name)


def without_header(file_type: Column, content: Column) -> Column:
    """A binary's bytes without its four bytes of address and length, where they name a graphics page."""
    length = le_uint(content, 2, 2)
    headed = (file_type == 6) & le_uint(content, 0, 2).isin(0x2000, 0x4000) & (length > 0) & (length <= F.length(content) - 4)
    return F.when(headed, F.substring(content, F.lit(5), F.length(content))).otherwise(content)


def entry_kernel(disk_format: Column, disk_name: Column, name: Column, content: Column) -> Column:
    """The kernel of a disk's entry: the system's own rules first, then the general classifier's."""
    ext, size, hint = extension(name), F.length(content), mode_hint(disk_name)
    bbc = [(ext.isin(f"mode{m}", f"m{m}") & (size >= least), f"bbc{m}") for m, least in ((0, 20480), (1, 20480), (2, 20480), (4, 10240), (5, 10240))]
    bbc += [((contains_text(name, f"mode{m}") | contains_text(name, f"mode {m}")) & (size >= least), f"bbc{m}") for m, least in ((0, 20480), (1, 20480), (2, 20480), (4, 10240), (5, 10240))]
    for span, modes, default in ((LARGE_SCREEN, (0, 1, 2), 1), (SMALL_SCREEN, (4, 5), 5)):
        bbc.append((size.between(*span), F.concat(F.lit("bbc"), F.when(hint.isin(*modes), hint).otherwise(F.lit(default)).cast("string"))))
    rules = [((disk_format == "BBC Micro") & test, kernel) for test, kernel in bbc]
    rules += [((disk_format == "Atari ST") & ext.isin(e.split()), k) for k, e in ST_KERNELS.items()]
    own = first_match([(size > 0, first_match(rules))])
    return F.coalesce(own, kernel_of(name, content))


def bbc_disk_info(files: DataFrame) -> DataFrame:
    """``files(path, content)`` of BBC disks to ``path, title, entries, boot_option, sectors``; zeros below two sectors."""

    def text(first: int, n: int) -> Column:
        codes = F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda i: F.conv(F.hex(F.substring(F.col("content"), i + 1, F.lit(1))), 16, 10).cast("int"))
        ends = F.array_position(codes, 0)
        kept = F.when(ends > 0, F.slice(codes, F.lit(1), (ends - 1).cast("int"))).otherwise(codes)
        return F.array_join(F.transform(kept, lambda c: F.chr(c.bitwiseAND(127))), "")

    byte = lambda at: le_uint(F.col("content"), at, 1)
    whole = F.length("content") >= 512
    zero = F.lit(0).cast("long")
    return files.select(
        "path",
        F.when(whole, F.trim(F.concat(text(0, 8), text(256, 4)))).otherwise("").alias("title"),
        F.when(whole, F.floor(byte(261) / 8)).otherwise(zero).alias("entries"),
        F.when(whole, byte(262).bitwiseAND(3)).otherwise(zero).alias("boot_option"),
        F.when(whole, F.shiftright(byte(262), 4).bitwiseAND(3) * 256 + byte(263)).otherwise(zero).alias("sectors"),
    )
