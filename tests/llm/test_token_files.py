"""Token files against the tokenizers library, and Re-Pair blocks by exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelmill.llm import re_pair, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, start string, file string"


def block_of(docs, base):
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    return re_pair.Block.build(base, list(range(len(docs))), np.array([i for d in docs for i in d], np.uint32), starts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=12), st.sampled_from([4, 70_000]), st.data())
def test_round_trip(docs, base, data):
    block = next(re_pair.Block.all_in(block_of(docs, base).to_bytes()))
    assert block.ids().tolist() == [i for d in docs for i in d]
    k = data.draw(st.integers(0, len(docs) - 1))
    a, b = sorted(data.draw(st.tuples(st.integers(0, 70), st.integers(0, 70))))
    assert block.tokens(k, a, b).tolist() == docs[k][a:b]


def test_grammar_compresses():
    rng = random.Random(4)
    phrases = [[rng.randrange(40_000) for _ in range(rng.randint(3, 30))] for _ in range(200)]
    docs = [[i for _ in range(rng.randint(5, 40)) for i in rng.choice(phrases)] + [1] for _ in range(300)] + [[7] * 5000, [1], [8, 9] * 3001 + [8]]
    block = block_of(docs, 49_408)
    assert len(block.symbols) * 5 < sum(map(len, docs)) and len(block.to_bytes()) * 2 < 2 * sum(map(len, docs))
    assert block.ids().tolist() == [i for d in docs for i in d]
    for k in (0, 17, 300, 302):
        assert block.tokens(k).tolist() == docs[k] and block.tokens(k, 3, 9).tolist() == docs[k][3:9]
    ends = set(block.symbol_starts[1:].tolist())  # no rule crosses documents
    assert len(ends) == len(docs) and (np.diff(block.symbol_starts) > 0).all()
    used = np.bincount(block.rules.reshape(-1), minlength=49_408 + len(block.rules)) + np.bincount(block.symbols, minlength=49_408 + len(block.rules))
    assert (used[49_408:] > 0).all()


def test_files_end_where_blocks_do():
    a, b = block_of([[1, 2, 3]], 4), block_of([[3], [2, 2]], 4)
    assert [x.ids().tolist() for x in re_pair.Block.all_in(a.to_bytes() + b.to_bytes())] == [[1, 2, 3], [3, 2, 2]]
    with pytest.raises(ValueError, match="not a block"):
        list(re_pair.Block.all_in(b"x" * 4 + a.to_bytes()[4:]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeäßÇΣ日1'!́ \x1c<") for _ in range(rng.randint(1, 8)))
    texts = [rng.choice([" ", "\n", "  ", "\t"]).join(word() for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += [None, "", " ", "\n\n", "<|endoftext|> it's<|startoftext|>x", "a" * 20000, "ab " * 40000, "  \u0085 x"]
    out = [(i * 3 % 101, t, "x", "y", "z") for i, t in enumerate(texts)]
    return out + [(500, "the same row", "x", "y", "z")] * 70 + [(500, "another", "x", "y", "z"), (None, "no id", "x", "y", "z"), (None, None, "x", "y", "z")]


def test_token_files(spark, rows, monkeypatch):
    model = Tokenizer.from_file(PATH)
    want = []
    for doc, text, *_ in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc is None, doc, zlib.crc32(ids.tobytes()), len(ids)))
    want.sort(key=lambda r: (r[0], r[1] or 0, r[2]))
    starts = np.concatenate([[0], np.cumsum([w[3] for w in want])])
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    got = token_files.token_files(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH).collect()
    assert sorted((r["start"], r["doc_id"] is None, r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in got) == [(int(s), *w) for s, w in zip(starts, want)]


def test_files_are_shared_out_and_read_with_ids(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    docs = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, text string").repartition(3)
    token_files.write_token_files(docs, PATH, str(tmp_path))
    names = sorted(p.name for p in tmp_path.iterdir())
    assert len(names) > 3 and names[0] == "part-000000.rpr"
    model = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r["ids"] for r in token_files.read_token_files(spark, str(tmp_path), with_ids=True).collect()}
    assert got == {i: [*model.encode(r[1] or "", add_special_tokens=False).ids, 1] for i, r in enumerate(rows)}


def test_empty(spark):
    assert token_files.token_files(spark.createDataFrame([], SCHEMA), PATH).collect() == []
