"""Documents as files of token ids, compressed by Re-Pair grammars, and read back.

Texts are tokenised by the tokenizers library, with an end id after each, and sorted by doc_id over ranges. Each range
is a file ``part-N.rpr`` of blocks (``re_pair``), each with a grammar of its own and of about ``BLOCK_TOKENS`` tokens or
one longer document. The sink moves files into place once all are whole (``sources.store``).

Words are cut at blanks, tabs and line breaks, which the vocabulary drops and never joins over, so that equal words are
tokenised once a worker; other white space is left to the library.

Reading decodes block by block. A document's ``start`` is the ids of all documents before it: those of its file, and a
two-level running total over files.

Edge cases: a null or empty text is its end id alone; null ids come last, in the files and in what is read; rows that
repeat a doc_id are documents of their own, in the order of their ids' checksums; other columns are ignored; an empty
table gives no files and an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelmill.sources.store import opened, paths_in, write_files

from .common import Scratch, blocks, cut, text_bytes
from .packing import byte_of_char
from .re_pair import HEAD, Block

END_ID = 1
BLOCK_TOKENS = 1 << 20
#: Bytes of ids in a file, and, beyond ``MANY`` files, in each of more.
FILE_BYTES, LARGE_BYTES, MANY = 16 << 20, 128 << 20, 4096
#: Words, and characters of them, whose ids a worker remembers, and words that are tokenised at once.
MOST_WORDS, MOST_CHARS, CHUNK = 250_000, 32_000_000, 2000
#: Files whose totals are added up in one group.
VOLUME = 1024


class _Numbers(dict):
    """Word to its number; a new word gets the next one and waits for its ids."""

    def __init__(self, waiting: list[str]) -> None:
        self.waiting, self.first = waiting, 1

    def __missing__(self, word: str) -> int:
        k = self[word] = self.first + len(self.waiting)
        self.waiting.append(word)
        return k


class _Ids:
    """Lists of ids by number, as one array and where each begins."""

    def __init__(self) -> None:
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of numbers, and how many each has."""
        first = self.starts[numbers]
        count = self.starts[numbers + 1] - first
        stop = np.cumsum(count)
        return self.flat[np.repeat(first - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)], count


#: Words of these alone are cut and tokenised many at a time: ASCII but for the apostrophe, and Latin-1 letters.
_PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_LETTER, _DIGIT, _MARK = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER


class WordIds:
    """Ids of whole texts, by tokenising each distinct word once.

    The vocabulary lower-cases words and takes them apart into runs of letters, single digits and runs of marks, each of
    which is merged by itself and ends in an id of its own kind. Plain words are cut so with a fixed number of array
    passes, and tiktoken, with an end mark for the end of a run, merges them by the same ranks. All others (other scripts,
    apostrophes, added tokens, control characters) go to the tokenizers library one by one. A probe compares the two.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.model, self.end_id = Tokenizer.from_file(path), end_id
        self.size = max(self.model.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.closes = np.zeros(self.size, bool)  # ids that end a run
        byte, ranks = byte_of_char(), {}
        for token, i in self.model.get_vocab(with_added_tokens=False).items():
            body = token.removesuffix("</w>") or token
            self.closes[i] = body != token
            ranks[bytes(byte[c] for c in body) + b"\x01" * (body != token)] = i
        self.engine = tiktoken.Encoding("runs", pat_str="[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={})
        probe = "It's a probe:\t1234 Äö  你好,\n\r\nnaïvé ́x --- WORDS'll do.<|endoftext|> ΣΣ İ, i, <|endoftext|>! word\u0301, ÀÉ$$$99.5%ß ª \x01 "
        self._clear()
        for _ in range(2):  # new words, and known ones
            if self.encode([probe])[0].tolist()[:-1] != self.model.encode(probe, add_special_tokens=False).ids:
                raise ValueError(f"{path} does not tokenise word by word")

    def _clear(self) -> None:
        self.new_words: list[str] = []
        self.words, self.chars, self.ids = _Numbers(self.new_words), 0, _Ids()
        self.ids.add(np.array([self.end_id]), np.array([1]))  # number 0 is the end

    def _plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, and how many each has."""
        chars = np.frombuffer(" ".join(["", *words, ""]).lower().encode("latin-1"), np.uint8)
        kind = _KIND[chars]
        ends = np.flatnonzero((kind[:-1] > 0) & ((kind[:-1] != kind[1:]) | (kind[:-1] == _DIGIT)))
        marked = np.insert(chars, ends + 1, 1)
        flat = np.array(self.engine.encode_ordinary(marked[marked != 0x20].tobytes().decode("latin-1")), np.uint32)
        runs = np.diff(np.searchsorted(ends, np.flatnonzero(chars == 0x20)))
        stops = np.concatenate([[0], np.flatnonzero(self.closes[flat]) + 1])
        return flat, np.diff(stops[np.concatenate([[0], np.cumsum(runs)])])

    def _other_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for k in range(0, len(words), CHUNK):
            got = [e.ids for e in self.model.encode_batch_fast(words[k : k + CHUNK], add_special_tokens=False)]
            flat += [i for ids in got for i in ids]
            sizes += map(len, got)
        return np.array(flat, np.uint32), np.array(sizes, np.int64)

    def _add_words(self) -> None:
        plain = [_PLAIN.fullmatch(w) is not None and "<|" not in w for w in self.new_words]
        own = _Ids()
        own.add(*self._other_ids([w for w, p in zip(self.new_words, plain) if not p]))
        own.add(*self._plain_ids([w for w, p in zip(self.new_words, plain) if p]))
        back = np.empty(len(plain), np.int64)
        back[np.argsort(plain, kind="stable")] = np.arange(len(plain))
        self.ids.add(*own.take(back))
        self.chars += sum(map(len, self.new_words))
        self.words.first += len(self.new_words)
        self.new_words.clear()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, an end id after each, and the ``len + 1`` offsets of the texts."""
        if len(self.words) > MOST_WORDS or self.chars > MOST_CHARS:
            self._clear()
        find, numbers, ends = self.words.__getitem__, [], [0]
        for t in texts:
            numbers.extend(map(find, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))
            numbers.append(0)
            ends.append(len(numbers))
        if self.new_words:
            self._add_words()
        ids, count = self.ids.take(np.array(numbers, np.int64))
        return ids, np.concatenate([[0], np.cumsum(count)])[np.array(ends)]


@lru_cache(maxsize=1)
def _words(path: str, end_id: int) -> WordIds:
    return WordIds(path, end_id)


def _tokenised(path: str, end_id: int):  # noqa: ANN202
    """``doc_id, text`` to ``doc_id, crc, ids``, the ids as numbers of four bytes or, if the vocabulary allows, two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _words(path, end_id)
        kind = "<u2" if model.size <= 1 << 16 else "<u4"
        for batch in batches:
            _, offs = text_bytes(batch.column("text"))
            for lo, hi in blocks(offs):
                ids, at = model.encode(batch.column("text").slice(lo, hi - lo).to_pylist())
                whole = np.ascontiguousarray(ids, "<u4")
                crc = np.fromiter((zlib.crc32(whole[a:b]) for a, b in zip(at[:-1], at[1:])), np.int64, hi - lo)
                small = np.ascontiguousarray(ids, kind)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((at * small.itemsize).astype(np.int64)), pa.py_buffer(small)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(crc), packed], names=["doc_id", "crc", "ids"])

    return run


def _compressed(base: int):  # noqa: ANN202
    """A sorted partition's documents to the blocks of its file; ids are below ``base``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _words.cache_clear()  # the words of an earlier task of this worker
        kind = "<u2" if base <= 1 << 16 else "<u4"
        name = f"part-{TaskContext.get().partitionId():06d}.rpr"
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        n = 0

        def block() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            content = Block.build(base, docs, np.concatenate(parts), starts).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["name", "content"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                own = np.frombuffer(ids.as_buffer(), kind)
                if parts and n + len(own) > BLOCK_TOKENS:
                    yield block()
                    docs, parts, n = [], [], 0
                docs.append(doc)
                parts.append(own)
                n += len(own)
        if parts:
            yield block()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, overwrite: bool = False) -> None:
    """Writes the token ids of ``docs(doc_id, text)``, in ascending order of doc_id, as files below ``folder``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = scratch.table(texts.mapInArrow(_tokenised(tokenizer_path, end_id), "doc_id long, crc long, ids binary"), "ids")
    size = ids.agg(F.sum(F.length("ids"))).first()[0] or 0
    parts = max(1, min(-(-size // FILE_BYTES), max(MANY, -(-size // LARGE_BYTES))))
    # Rows that repeat an id, a third of all perhaps, are dealt by checksum and place, so that no range has to hold them all.
    placed = ids.withColumn("none", F.col("doc_id").isNull()).withColumn("place", F.monotonically_increasing_id())
    order = ["none", "doc_id", "crc", "place"]
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    write_files(ranged.mapInArrow(_compressed(WordIds(tokenizer_path, end_id).size), "name string, content binary"), folder, overwrite)
    scratch.drop()


def blocks_of(path: str) -> Iterator[Block]:
    """The blocks of a file, read one after the other."""
    store, place = opened(path)
    with store.open_input_file(place) as file:
        while head := file.read(HEAD.size):
            yield Block.from_bytes(memoryview(head + file.read(Block.size_of(head) - HEAD.size)))


_READ = "file string, at long, doc_id long, before long, n_tokens long, ids_crc32 long"


def _read(with_ids: bool):  # noqa: ANN202
    """Files by their paths to a row for each document: its place in the file, and what is before it there.

    A task holds one block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name, at, before = path.rpartition("/")[2], 0, 0
                for block in blocks_of(path):
                    ids, starts = np.ascontiguousarray(block.ids(), "<u4"), block.token_starts
                    n = len(block.doc_ids)
                    crc = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:])), np.int64, n)
                    cols = [pa.array([name] * n), pa.array(np.arange(at, at + n)), pa.array(block.doc_ids, pa.int64()), pa.array(starts[:-1] + before), pa.array(np.diff(starts)), pa.array(crc)]
                    names = [c.split()[0] for c in _READ.split(", ")]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    at, before = at + n, before + int(starts[-1])

    return run


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files in ``folder``: ``file, at`` (the place there), ``doc_id, before, n_tokens, ids_crc32`` and, if asked for, ``ids``."""
    schema = _READ + ", ids array<int>" * with_ids
    return paths_in(spark, folder).mapInArrow(_read(with_ids), schema)


def with_starts(found: DataFrame) -> DataFrame:
    """``read_token_files`` with ``start``: the ids of all documents before, in this and in earlier files."""
    number = F.regexp_extract("file", r"(\d+)", 1).cast("long")
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("number", number).withColumn("volume", F.floor(F.col("number") / VOLUME))
    inside = Window.partitionBy("volume").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    outside = Window.orderBy("volume").rowsBetween(Window.unboundedPreceding, -1)  # a row for every VOLUME files
    volumes = totals.groupBy("volume").agg(F.sum("n").alias("v")).select("volume", F.coalesce(F.sum("v").over(outside), F.lit(0)).alias("above"))
    bases = totals.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(volumes, "volume").select("file", (F.col("ahead") + F.col("above")).alias("base"))
    return found.join(bases, "file").withColumn("start", F.col("base") + F.col("before")).drop("base")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes token files, reads them back and returns ``doc_id, start, n_tokens, ids_crc32`` of each document from them."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    folder = f"{scratch.root}/files"
    write_token_files(docs, tokenizer_path, folder, end_id)
    if not docs.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = scratch.table(read_token_files(spark, folder), "found")
    out = cut(with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32"))
    scratch.drop()
    return out
