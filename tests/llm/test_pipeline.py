"""The pipeline's stages, each on what the one before has kept, against brute-force versions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pixelmill.llm import line_dups, near_dups, toxicity

from tests.llm.test_operators import brute_mix, brute_near, union_find

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, D).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    before, after = seen["toxicity"]
    scored = toxicity.toxicity(before, spark.read.parquet(f"{D}/labels.parquet"))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in scored.where("predicted = 0").collect()}
    before, after = seen["line_dedup"]
    assert {r["doc_id"]: r["text"] for r in after.collect()} == brute_lines({r["doc_id"]: r["text"] for r in before.collect()})
    before, after = seen["minhash_near_dedup"]
    rows = sorted(before.collect(), key=lambda r: r["doc_id"])
    _, roots = brute_near([r["text"] for r in rows], 80)
    assert {r["doc_id"] for r in after.collect()} == {rows[i]["doc_id"] for i in set(roots)}
    before, after = seen["source_mixing"]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
    whole = brute_mix(rows)[4]
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({rows[i][0]: n for i, n in whole.items() if n})
    before, after = seen["best_fit_packing"]
    packed(before.collect(), after.collect())


def brute_lines(texts):
    """Texts without the lines that come later than another of their component."""
    n = line_dups.WIDTH
    units = [(i, k, line) for i in sorted(texts) for k, line in enumerate(line_dups.normal_lines(texts[i] or "")) if line]
    sets = [frozenset(u[2][j : j + n] for j in range(max(1, len(u[2]) - n + 1))) for u in units]
    kinds = sorted(set(sets), key=len)
    by_shingle, links = defaultdict(set), []
    for a, own in enumerate(kinds):
        shared = Counter(b for shingle in own for b in by_shingle[shingle])
        links += [(a, b) for b, both in shared.items() if 100 * both >= 80 * (len(own) + len(kinds[b]) - both)]
        for shingle in own:
            by_shingle[shingle].add(a)
    place = {s: k for k, s in enumerate(kinds)}
    roots, seen, gone = union_find(len(kinds), links), set(), defaultdict(set)
    for (i, k, _), s in zip(units, sets):
        root = roots[place[s]]
        if root in seen:
            gone[i].add(k)
        seen.add(root)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}


def packed(docs, pieces):
    """Pieces are the library's ids, in full sequences but for few, without gap or overlap."""
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d in docs:
        ids = [*model.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        head, at, k = (len(ids) - 1) % 2048 + 1, 0, 0
        while at < len(ids):
            stop = head if k == 0 else at + 2048
            want[d["doc_id"], k, at, stop - at, zlib.crc32(np.array(ids[at:stop], "<u4").tobytes())] += 1
            at, k = stop, k + 1
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == want
    spans = defaultdict(list)
    for p in pieces:
        spans[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in spans.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and own[-1][0] + own[-1][1] <= 2048
    least = -(-sum(p["length"] for p in pieces) // 2048)
    assert least <= len(spans) <= least * 1.02 + 1


def test_near_bands_at_threshold():
    rng = np.random.default_rng(4)
    n = 20000
    sets = rng.integers(0, 2**63, (n, 50)).astype(np.uint64)
    one, other = sets[:, :45], np.concatenate([sets[:, :40], sets[:, 45:]], axis=1)  # 40 of 50 in both
    assert corpus_pipeline.NEAR["percent"] == 80
    bands = [near_dups._bands(near_dups.sketch(x.reshape(-1), np.repeat(np.arange(n), 45), n), corpus_pipeline.NEAR["rows"]) for x in (one, other)]
    assert (bands[0] == bands[1]).any(axis=1).all()


def test_empty_and_nulls(spark, tmp_path):
    schema = spark.read.parquet(f"{D}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, D)
        assert docs.count() == len(rows)
