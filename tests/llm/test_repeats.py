"""Rows that repeat an id, or are repeated as a whole: each operator's stated result."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import hard_negatives, line_dups, packing, token_files, toxicity, unit_dups, url_filter, vector_search

TOKENS = public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    base = [(i, f"{words(rng, 12)}\n{words(rng, 9)}\nshared line of a few words here and there") for i in range(12)]
    return base, [base[3]] * 2 + [base[7]] + [(None, base[2][1])] * 2


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_lines_and_units_of_repeated_rows(spark, rows):
    base, more = rows
    for run in (lambda df: line_dups.dedup_lines(df), lambda df: unit_dups.unit_report(df).drop("n_units")):
        once = {r["doc_id"]: tuple(r)[1:] for r in run(table(spark, base)).collect()}
        got = defaultdict(list)
        for r in run(table(spark, base + more)).collect():
            got[r["doc_id"]].append(tuple(r)[1:])
        assert {i: len(v) for i, v in got.items()} == Counter(i for i, _ in base + more)
        for i, results in got.items():
            assert len(set(results)) == 1  # repeated rows fare alike
            if i is not None:
                assert results[0] == once[i]  # and no row with an id of its own is changed by them


def test_scores_of_repeated_rows(spark, rows):
    base, more = rows
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    got = defaultdict(set)
    for r in toxicity.toxicity(table(spark, base + more), labels).collect():
        got[r["doc_id"]].add((r["score"], r["predicted"], r["held_out"]))
    assert all(len(v) == 1 for v in got.values()) and len(got) == 13
    pages = [(1, "http://a.com/en/x"), (1, "http://a.com/en/x"), (1, "http://b.net/de/y"), (None, None), (None, None)]
    verdicts = Counter((r["page_id"], r["host"], r["verdict"]) for r in url_filter.url_verdicts(spark.createDataFrame(pages, "page_id long, url string")).collect())
    assert verdicts[1, "a.com", "block"] == 2 and verdicts[1, "b.net", "allow"] == 1 and sum(verdicts.values()) == 5


def test_pieces_of_repeated_rows(spark, rows):
    base, more = rows
    got = packing.best_fit_packing(table(spark, base + more), TOKENS, capacity=64).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, _ in base + more)
    for sequence in {r["sequence_id"] for r in got}:
        spans = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == sequence)
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 64


def test_token_files_of_repeated_rows(spark, rows):
    base, more = rows
    got = token_files.token_files(table(spark, base + more), public_tokenizers.path("word_bpe_49k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in base + more if i is not None)) + [None, None]
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]


def test_vectors_of_repeated_rows(spark):
    rng = random.Random(5)
    base = [(i, [rng.uniform(-1, 1) for _ in range(4)], i % 2) for i in range(60)]
    df = spark.createDataFrame(base + [base[7], base[7], base[20]], "vec_id long, embedding array<double>, label int").repartition(3)
    score = lambda a, b: sum(x * y for x, y in zip(base[a][1], base[b][1]))
    got = defaultdict(Counter)
    for r in vector_search.nearest(df, F.col("vec_id") == 40, 62, factor=1.0).collect():
        got[r["query_id"]][r["vec_id"]] += 1
    assert got[40] == Counter(i for i, *_ in base + [base[7], base[7], base[20]] if i != 40)
    negatives = hard_negatives.hard_negatives(df, F.col("vec_id") == 20, positives=3, negatives=4, percent=0).collect()
    assert {r["anchor_id"] for r in negatives} == {20} and 20 not in {r["negative_id"] for r in negatives} | {r["positive_id"] for r in negatives}
    positive = sorted((i for i in range(60) if i % 2 == 0 and i != 20), key=lambda i: (-score(20, i), i))[:3]
    assert {r["positive_id"] for r in negatives} <= set(positive)
