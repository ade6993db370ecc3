"""The operators of pixelmill.llm against brute-force versions on small fixtures with nulls, ties and repeats."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelmill.llm import exact_dups, line_dups, mixing, near_dups, packing, set_links, substring_dups, suffixes, toxicity, unit_dups, url_filter, vector_search
from pixelmill.llm.components import components
from pixelmill.llm.common import Scratch

TOKENS = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, extra string, size string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeäß") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, a hot group, shared passages, nulls, empty texts, a repeated row, a long text, a clashing column."""
    rng = random.Random(5)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(40)]
    base, shared = words(rng, 150), words(rng, 60)
    for k in range(25):
        w = base.split()
        w[k * 5] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [base] * 12 + [base.upper(), f"{words(rng, 30)}\n{shared}\n{words(rng, 20)}", f"{words(rng, 9)} {shared}", None, "", " \n ", "a", "A b", words(rng, 20000)]
    texts += ["ab" * 300, "x" * 250, "One sentence of quite some words here. " * 3]
    rows = [(i, t, [None, "s1", "s2", "\U0001f600", "s3"][i % 5], "x", "y") for i, t in enumerate(texts)]
    rows.append((None, "a text without an id", None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def union_find(n, links):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


# ---- op1 ----


def test_url_filter(spark, empty):
    urls = ["http://a.Example.com/en/7x?q", "https://example.com/en/8", "ftp://x.net/de/8#f", "http://www.example.net/de/81", "http://org/es/", "http://borg/es/", "http://h?x/en/", "no scheme", None, "://host/p"]
    rows = [(i, u, "html") for i, u in enumerate(urls)] + [(100 + i, f"http://good{i}.net/de/page", "") for i in range(60)] + [(300 + i, f"http://bad{i}.com/en/spam", "") for i in range(60)]
    rows += [(900, "http://good5.info/de/page", ""), (901, "http://bad5.info/en/spam", "")]
    got = {r["page_id"]: r for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(10)] == [
        ("a.example.com", "/en/7x", "example.com/en/7"), ("example.com", "/en/8", "com/en/"), ("x.net", "/de/8", "net/de/"), ("www.example.net", "/de/81", "example.net/de/8"),
        ("org", "/es/", "org/es/"), ("borg", "/es/", None), ("h", "", None), ("", "", None), ("", "", None), ("host", "/p", None),
    ]
    assert [got[i]["verdict"] for i in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert got[900]["verdict"] == "allow" and got[901]["verdict"] == "block"
    assert url_filter.url_verdicts(empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))).count() == 0


def test_markov_sums_to_one():
    rng = np.random.default_rng(1)
    counts = np.zeros(url_filter.SYMBOLS ** (url_filter.ORDER + 1))
    np.add.at(counts, rng.integers(0, len(counts), 500), 1)
    p = np.exp(url_filter.log_probabilities(counts)).reshape(-1, url_filter.SYMBOLS)
    assert np.allclose(p.sum(1), 1)


# ---- op2 ----


def brute_substrings(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("most_kinds", [20_000, 1])
def test_substrings(spark, corpus, most_kinds):
    df, rows = corpus
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dups.without_repeats(df, 200, most_kinds=most_kinds).collect()}
    want = brute_substrings([(r[1] or "").encode() for r in rows], 200)
    assert [got[r[0]] for r in rows] == want


def test_substring_texts(spark, corpus, empty):
    df, rows = corpus
    for r in substring_dups.without_repeats(df, 200, with_text=True).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert substring_dups.without_repeats(empty).count() == 0
    twice = spark.createDataFrame([(1, "q" * 3 + words(random.Random(1), 80))] * 2, "doc_id long, text string")
    assert [r["n_removed"] == r["n_bytes"] for r in substring_dups.without_repeats(twice).collect()] == [True, True]


def test_suffix_array():
    rng = np.random.default_rng(0)
    for trial in range(200):
        t = np.concatenate([rng.integers(1, 2 + trial % 4, int(rng.integers(1, 50))), [0]]).astype(np.uint16)
        s, l = suffixes.suffix_array(t, 6), t.tolist()
        assert s.tolist() == sorted(range(len(l)), key=lambda i: l[i:])
        before, common = suffixes.permuted_common_prefixes(t, s)
        for a, b in zip(s[:-1], s[1:]):
            same = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(l[a:], l[b:])))
            assert before[b] == a and common[b] == same


# ---- op3 ----


def test_lines(spark, corpus, empty):
    df, rows = corpus
    units = [(r[0], k, line) for r in rows for k, line in enumerate(line_dups.normal_lines(r[1] or "")) if line]
    units.sort(key=lambda u: (u[0] is None, u[0] or 0, u[1]))
    n = line_dups.WIDTH
    sets = [{u[2][i : i + n] for i in range(max(1, len(u[2]) - n + 1))} for u in units]
    links = [(i, j) for i in range(len(units)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    gone = defaultdict(set)
    for i, root in enumerate(union_find(len(units), links)):
        if root != i:
            gone[units[i][0]].add(units[i][1])
    got = {r["doc_id"]: r for r in line_dups.dedup_lines(df).collect()}
    for r in rows:
        want = None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[r[0]])
        assert got[r[0]]["text"] == want and got[r[0]]["extra"] == r[3]
    assert line_dups.dedup_lines(empty).count() == 0


def test_short_lines(spark):
    texts = ["Menu\n\n* a", "Menus\n menu \n\nMENU\n* b", None, "* A\n \n\u83dc\u5355\n", "\u83dc\u5355"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dups.dedup_lines(df).collect()}
    assert got == {0: (texts[0], 0), 1: ("Menus\n\n* b", 2), 2: (None, 0), 3: (" \n\u83dc\u5355\n", 1), 4: ("", 1)}


def test_short_lines_link_with_longer_ones(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["\n".join(letters[:n] for n in range(14, 18)), letters[:13], letters[:6], f"{letters[:6]}\n{letters[:7]}\n{letters[:5]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["text"] for r in line_dups.dedup_lines(df).collect()}
    # Neighbours of 14 to 17 characters share 0.9 of their runs and more, those of 13 and 14 8 of 9; those of 6 and 7 half.
    assert got == {0: letters[:14], 1: "", 2: letters[:6], 3: f"{letters[:7]}\n{letters[:5]}"}


def test_line_bands_at_threshold():
    rng = np.random.default_rng(3)
    n = 2000
    sets = rng.integers(0, 2**63, (n, 100)).astype(np.uint64)
    one, other = sets[:, :90], np.concatenate([sets[:, :80], sets[:, 90:]], axis=1)  # 80 of 100 in both
    bands = [near_dups._bands(near_dups.sketch(x.reshape(-1), np.repeat(np.arange(n), 90), n, line_dups.BINS), line_dups.ROWS) for x in (one, other)]
    assert (bands[0] == bands[1]).any(axis=1).all()


# ---- op4 ----


def test_units(spark, corpus, empty):
    df, rows = corpus
    seen, want = set(), {}
    for r in sorted((r for r in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        spans, n = [], 0
        for m in unit_dups.UNIT.finditer(r[1] or ""):
            unit = lower(unit_dups.BLANKS.sub(" ", m[0]).strip(" "))
            if len(unit.split(" ")) >= unit_dups.MIN_WORDS:
                n += 1
                if unit in seen:
                    spans.append(m.span())
                seen.add(unit)
        want[r[0]] = (n, len(spans), ",".join(f"{a}-{b}" for a, b in spans))
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["removed"]) for r in unit_dups.unit_report(df).collect()}
    assert got == want
    texts = {r["doc_id"]: r["text"] for r in unit_dups.without_units(df).collect()}
    for r in rows:
        if r[1] is not None:
            t = r[1]
            for a, b in reversed([tuple(map(int, s.split("-"))) for s in want[r[0]][2].split(",") if s]):
                t = t[:a] + t[b:]
            assert texts[r[0]] == t
    assert unit_dups.unit_report(empty).count() == 0


def brute_passages(texts, least):
    """Spans of each text's runs of clauses that an earlier text, or an earlier place, has."""
    seen, out, ends = set(), [], " " + unit_dups.CLAUSE_ENDS
    for text in texts:
        spans, run, words = [], [], 0
        units = [(m.span(), lower(unit_dups.BLANKS.sub(" ", m[0])).strip(ends)) for m in unit_dups.CLAUSE.finditer(text or "")]
        for span, unit in [u for u in units if u[1]] + [((0, 0), None)]:
            if unit is not None and unit in seen:
                run.append(span)
                words += max(len(unit.split(" ")), len(unit.split(" ")) - 1 + len(unit_dups.UNSPACED.findall(unit)))
                continue
            if words >= least:
                spans.append((run[0][0], run[-1][1]))
            run, words = [], 0
            seen.add(unit)
        out.append(spans)
    return out


def test_passages(spark, corpus, empty):
    rng = random.Random(17)
    clause = lambda: words(rng, rng.randint(1, 6)) + rng.choice([",", ".", ";", "!? ", "\u3002", "\n", ", and:"])
    passage = "".join(clause() + " " for _ in range(9))
    texts = [f"{clause()} {passage} {clause()}", f"new words {re.sub('[a-z]', lambda m: m[0].upper(), passage)}\n{clause()}", passage[:60] + "!", None, "", "...", "a, b. a, b. " * 30, "\u6625\u7720\u4e0d\u89c9\u6653\u3002" * 9]
    texts += [" ".join(rng.choice(["yes,", "no.", "so it is;", "here we go."]) for _ in range(6)) for _ in range(5)] + [r[1] for r in corpus[1]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, removed string").repartition(4)
    want = brute_passages(texts, unit_dups.LEAST_WORDS)
    got = {r["doc_id"]: r for r in unit_dups.passage_report(df).collect()}
    left = {r["doc_id"]: r["text"] for r in unit_dups.without_passages(df, removed_as="spans").collect()}
    assert want[1] and want[6] and want[7] and not any(want[8:13])
    for i, t in enumerate(texts):
        assert (got[i]["removed"], got[i]["n_removed"], got[i]["removed_chars"]) == (",".join(f"{a}-{b}" for a, b in want[i]), len(want[i]), sum(b - a for a, b in want[i]))
        kept = t
        for a, b in reversed(want[i]):
            kept = kept[:a] + kept[b:]
        assert left[i] == kept
    assert unit_dups.passage_report(empty).count() == 0


def test_units_are_whole_lines_too(spark):
    short, dense, dense_sentence = "Yes. No. I see. So be it.", "\u6625\u7720\u4e0d\u89c9\u6653", "\u5904\u5904\u95fb\u557c\u9e1f\u591c\u6765\u3002"
    texts = [f"{short}\nA first line.\n{dense}", f"Before.\n  {short.upper()} \nAfter, yes.\n\n{dense}\n", f"Yes. No.\n\u6211{dense_sentence}{dense_sentence}\u5b8c\u3002", f"\u4f60\u3002{dense_sentence}", "One. Two. A sentence of more than six words.\nOne. Two. A sentence of more than six words."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in unit_dups.without_units(df).collect()}
    assert got == {0: texts[0], 1: "Before.\n\nAfter, yes.\n\n\n", 2: texts[2], 3: "\u4f60\u3002", 4: texts[4].split("\n")[0] + "\n"}
    report = {r["doc_id"]: r for r in unit_dups.unit_report(df).collect()}
    assert (report[4]["n_units"], report[4]["n_removed"], report[4]["removed_chars"], report[4]["removed"]) == (2, 1, 44, "45-89")
    assert report[1]["n_removed"] == 2


# ---- op5 ----


def brute_near(texts, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], union_find(len(sets), links)


@pytest.mark.parametrize("percent", [85, 80])
def test_near(spark, corpus, empty, percent):
    df, rows = corpus
    sizes, roots = brute_near([r[1] for r in rows], percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(df, percent).collect()}
    for i, r in enumerate(rows):
        assert got[r[0]] == (sizes[i], rows[roots[i]][0], roots[i] == i)
    assert near_dups.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("small, medium", [(2, 3), (2, 1000), (4, 9)])
def test_links_of_larger_buckets(spark, monkeypatch, small, medium):
    """Groups of copies near the threshold, with shared and own edits: components by pairs in buckets and by differences."""
    monkeypatch.setattr(set_links, "SMALL", small)
    monkeypatch.setattr(set_links, "MEDIUM", medium)
    rng = random.Random(11)
    texts = []
    for _ in range(3):
        base = words(rng, 80).split()
        kinds = [(rng.randrange(80), f"kind{k}") for k in range(6)]
        for i in range(30):
            w = list(base)
            for at, new in rng.sample(kinds, rng.randint(0, 3)):
                w[at] = new
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(80)] = f"own{rng.randrange(10**6)}"
            texts.append(" ".join(w if i % 5 else w[: rng.randint(50, 80)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sizes, roots = brute_near(texts, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(df, 80, rows=4).collect()}
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}
    assert 5 < len(set(roots)) < len(texts)


def test_pivots_of_a_batch_are_read_at_once():
    calls = []

    def sets(column):
        calls.append(len(column))
        yield from line_dups.line_sets(column, 6)

    texts = [f"line {i} of a text with some words" for i in range(40)]
    pivots = [i // 3 for i in range(40)]
    names = ["c", "p", "text", "pivot_text"]
    table = pa.table([list(range(40)), pivots, texts, [texts[p] for p in pivots]], names=names)
    got = pa.Table.from_batches(set_links._verify(sets)(iter(table.to_batches(max_chunksize=16)))).to_pylist()
    own = [set(h.tolist()) for _, h in line_dups.line_sets(pa.array(texts), 6)]
    assert got == [{"c": i, "p": p, "n_both": len(own[i] & own[p]), "n_union": len(own[i] | own[p])} for i, p in enumerate(pivots)]
    assert len(calls) <= 2 * 3


def test_components_with_more_links(spark):
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (8, 3), (5, 5), (6, 5)], "node long, comp long")
    more = spark.createDataFrame([(4, 9), (9, 0), (8, 2), (11, 12), (2, 1)], "a long, b long")
    scratch = Scratch(spark)
    got = {tuple(r) for r in set_links._joined(comp, more, scratch).collect()}
    scratch.drop()
    assert got == {(n, 0) for n in (0, 1, 2, 3, 4, 8, 9)} | {(5, 5), (6, 5), (11, 11), (12, 11)}


def test_near_rows(spark):
    text = words(random.Random(3), 30)
    rows = [(5, text), (5, text), (None, text), (None, text), (None, "other words"), (None, "other words"), (7, ""), (7, "")]
    got = near_dups.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(5, text), (None, "other words"), (7, ""), (7, "")])


def test_clashing_columns(spark):
    text = words(random.Random(6), 40)
    names = ["_doc", "_hash", "gone", "_gone", "n_dropped", "removed", "_times", "_copy", "_rows", "_size", "_portion", "_k", "_source", "c", "k1", "band", "comp", "shuffled", "range"]
    rows = [(i, t, "s", *range(len(names))) for i, t in enumerate([text, text + " more", None, "", f"{text}\n{text}"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    for out in (line_dups.dedup_lines(df, count="n"), unit_dups.without_units(df, removed_as="spans"), near_dups.without_near_duplicates(df), mixing.mixed_documents(df), toxicity.drop_toxic(df, labels)):
        got = out.collect()
        assert out.columns[: len(df.columns)] == df.columns and got
        assert all(r[n] == k for r in got for k, n in enumerate(names))
    for run in (near_dups.near_duplicates, exact_dups_of, mixing.mixture, unit_dups.unit_report, unit_dups.passage_report, substring_dups.without_repeats):
        assert run(df).count() == 5


def exact_dups_of(df):
    return exact_dups.exact_duplicates(df, F.col("doc_id") % 2 == 0)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:270], rng.integers(0, 2**63, 30).astype(np.uint64)])
    one = near_dups.sketch(np.concatenate([a, b, a[:1]]), np.repeat([0, 1, 2], [300, 300, 1]), 3)
    assert (one != near_dups._FULL).all() and abs((one[0] == one[1]).mean() - 270 / 330) < 0.15


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 60), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(edges, Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 50: 40, 60: 40}


# ---- op6 ----


def test_exact(spark, corpus, empty):
    df, rows = corpus
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    for new in (F.col("doc_id") % 3 == 0, F.lit(True), F.lit(False)):
        got = {r["doc_id"]: r for r in exact_dups.exact_duplicates(df, new).collect()}
        for r in rows:
            ids = [i for i in groups[lower(r[1])] if i is not None]
            keep = max(ids) if ids else None
            g = got[r[0]]
            assert (g["keep_id"], g["group_size"], g["kept"], g["text_sha256"]) == (keep, len(groups[lower(r[1])]), r[0] == keep, hashlib.sha256(lower(r[1]).encode()).hexdigest())
    assert exact_dups.exact_duplicates(empty, F.lit(True)).count() == 0


def test_batches_against_a_saved_snapshot(spark, corpus, monkeypatch, tmp_path):
    df, rows = corpus
    monkeypatch.setattr(exact_dups, "SHARD_KEYS", 7)
    old, folder = [r for r in rows if r[0] is None or r[0] % 3], str(tmp_path / "snapshot")
    exact_dups.save_snapshot(spark.createDataFrame(old, SCHEMA), folder)
    monkeypatch.setattr(exact_dups, "fuse_build", None)  # a batch builds no filter
    before = {p: p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    for batch in ([r for r in rows if r[0] is not None and r[0] % 3 == 0] + [(9999, rows[1][1], None, None, None), (9998, "quite new", None, None, None), (9998, "quite new", None, None, None)], [(7, "alone", None, None, None)], []):
        groups = defaultdict(list)
        for r in old + batch:
            groups[lower(r[1])].append(r[0])
        want = []
        for r in batch:
            same = groups[lower(r[1])]
            keep = max(i for i in same if i is not None)
            want.append((r[0], keep, len(same), r[0] == keep, hashlib.sha256(lower(r[1]).encode()).hexdigest()))
        got = exact_dups.batch_duplicates(spark.createDataFrame(batch, SCHEMA), folder).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert before == {p: p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}


@pytest.mark.parametrize("n", [0, 1, 2, 50, 3000])
def test_fuse(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    f = exact_dups.fuse_build(keys)
    assert exact_dups.fuse_contains(f, keys).all()
    assert exact_dups.fuse_contains(f, rng.integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.01


# ---- op7 ----


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 12)).astype(np.float32)
    x[100:160] = x[100]  # a hot vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 12, 0), (902, [float("nan")] + [1.0] * 11, 0), (903, [None] + [1.0] * 11, 0), (904, [1.0] * 5, 0), (None, [1.0] * 12, 0), (905, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in vector_search.nearest(df, F.col("vec_id") % 20 == 0, 20, factor=1.0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 700, 20))
    d = x.astype(float)
    for q, found in got.items():
        found.sort()
        score = (d * d[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(700), -score)) if i != q][:20]
        assert [f[0] for f in found] == list(range(1, 21)) and np.allclose([f[2] for f in found], score[want])
        assert [f[1] for f in found] == want or len(set(np.round(score[want], 12))) < 20
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, label int")
    assert vector_search.nearest(few, F.lit(True)).count() == 6
    assert vector_search.nearest(few.limit(0), F.lit(True)).count() == 0


def best_of_all(rows, every, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for i in ids[ids % every == 0].tolist():
        score = (x * x[ids == i][0]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        yield i, [(int(ids[j]), float(score[j])) for j in order]


def found_for(spark, rows, k, **how):
    got = defaultdict(list)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for r in vector_search.nearest(df, F.col("vec_id") % 20 == 0, k, **how).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def test_nearest_with_ties_everywhere(spark, monkeypatch):
    """Vectors of small whole numbers: many distinct ones share an inner product with a query."""
    monkeypatch.setattr(vector_search, "SHARD_ROWS", 700)
    monkeypatch.setattr(vector_search, "LEAF", 16)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-3, 4, (2000, 4)).astype(float)) if v.any()]
    got = found_for(spark, rows, 20, factor=1.0)
    for query, want in best_of_all(rows, 20, 20):
        assert got[query] == want


def test_recall_of_relaxed_search(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "LEAF", 32)
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (3000, 24)) + rng.normal(0, 1, (30, 24))[rng.integers(30, size=3000)])]
    got, hits, total = found_for(spark, rows, 20), 0, 0
    for query, want in best_of_all(rows, 20, 20):
        hits += len(set(got[query]) & set(want))
        total += len(want)
    assert hits >= 0.9 * total and len(got) == 150


# ---- op8 ----


def test_packing(spark, corpus, empty):
    df, rows = corpus
    tok = Tokenizer.from_file(TOKENS)
    capacity, by_seq, total = 256, defaultdict(list), 0
    parts = defaultdict(dict)
    for r in packing.best_fit_packing(df, TOKENS, capacity).collect():
        parts[r["doc_id"]][r["piece"]] = r
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        own, at = parts[r[0]], 0
        assert sorted(own) == list(range(-(-len(ids) // capacity)))
        for k in sorted(own):
            p = own[k]
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes()) and (k == 0 or p["length"] == capacity)
            at += p["length"]
        assert at == len(ids)
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_seq) <= -(-total // capacity) * 1.02 + 1
    assert packing.best_fit_packing(empty, TOKENS).count() == 0


def test_added_tokens(spark):
    tok, end = Tokenizer.from_file(TOKENS), "<|endoftext|>"
    texts = [end, end * 2, f" {end} ", f"hello {end} world", f"a{end}", f"{end}b", f"{end[:6]}{end}", f"x  {end}\n{end} y", f"word {end} " * 1500]
    got = defaultdict(list)
    for r in packing.best_fit_packing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENS).collect():
        got[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        pieces = sorted(got[i], key=lambda r: r["piece"])
        assert sum(p["length"] for p in pieces) == len(ids) and all(p["length"] == 2048 for p in pieces[1:])
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())


def test_plan_covers():
    rng = np.random.default_rng(4)
    for n in (0, 1, 30, 4000):
        hist = np.bincount(np.minimum(64, rng.geometric(0.05, n)), minlength=65)
        hist[0] = 0
        used = np.zeros(65, int)
        for pattern, times in packing.pack_plan(hist, 64):
            assert sum(pattern) <= 64 and times > 0
            for v in pattern:
                used[v] += times
        assert (used == hist).all()


# ---- op9 ----


def brute_mix(rows):
    """Of ``rows(doc_id, text, source)``: sizes, words and targets by source, words taken of each row, and whole copies."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for i, r in enumerate(rows)}
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    total = {s: sum(size[i] for i, r in enumerate(rows) if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    budget, full = 1.5 * sum(total.values()), set()
    while True:
        level = (budget - sum(2 * total[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and level * weight[s] > 2 * total[s]}
        if not more:
            break
        full |= more
    target = {t: float(2 * total[t]) if t in full else level * weight[t] for t in sources}
    # All copies by virtual finish, cut where the budget is used up.
    left, taken, whole = int(budget + 0.5), Counter(), Counter()
    copies = []
    for t in sources:
        end = 0
        for copy in (1, 2):
            for i in sorted((i for i, r in enumerate(rows) if r[2] == t), key=lambda i: hashlib.md5(("" if rows[i][0] is None else str(rows[i][0])).encode()).hexdigest()):
                end += size[i]
                copies.append((end / target[t] if target[t] else 0.0, sources.index(t), copy, end, i))
    for _, _, copy, _, i in sorted(copies):
        given = min(left, size[i])
        taken[i] += given
        left -= given
        whole[i] += given == size[i] if size[i] else copy == 1
    return size, total, target, taken, whole


def test_mixing(spark, corpus, empty):
    df, rows = corpus
    size, total, target, taken, whole = brute_mix([(r[0], r[1], r[2]) for r in rows])
    got = {r["doc_id"]: r for r in mixing.mixture(df).collect()}
    for i, r in enumerate(rows):
        g = got[r[0]]
        assert g["size"] == size[i] and g["source_size"] == total[r[2]] and g["taken"] == taken[i] <= 2 * size[i]
        assert abs(g["target"] - target[r[2]]) < 1e-6
    assert sum(taken.values()) == int(1.5 * sum(total.values()) + 0.5)
    assert {r["doc_id"]: r["taken"] for r in mixing.mixture(df.repartition(3)).collect()} == {k: v["taken"] for k, v in got.items()}
    assert mixing.mixture(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter({rows[i][0]: n for i, n in whole.items() if n})


def test_mixing_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(1, "a b c", "t"), (None, "", None), (None, "", None)], "doc_id long, text string, source string").repartition(3)
    got = mixing.mixture(df).collect()
    assert len(got) == 8 and sum(r["taken"] for r in got) == 27 and max(r["taken"] for r in got) <= 6
    mixed = Counter((r["doc_id"], r["source"]) for r in mixing.mixed_documents(df).collect())
    assert mixed[(None, None)] == 2 and mixed[(1, "t")] == 2 and 6 <= mixed[(1, "s")] <= 7
    assert mixing.mixed_documents(df.where("text = ''")).count() == 2


# ---- op10 ----


def test_toxicity(spark, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        t = words(rng, rng.randint(20, 60))
        bad = i % 4 == 0
        if bad:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vilething", "nastyword", "vilestuff"]))
            t = " ".join(w)
        rows.append((i, t, "s", None, None))
        labels.append((i, int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "nastyword vilething", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame([*labels, (None, 1), (5000, 1), (7, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, lab).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(400))
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1000]["score"] == got[1001]["score"] and got[None]["held_out"] is False
    for i in range(400):
        for p in got[i]["passages"]:
            assert re.search(b"vile|nasty", rows[i][1].encode()[p["start"] : p["stop"]])
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, lab).collect()}
    assert kept == {k for k, r in got.items() if r["predicted"] == 0}
    assert toxicity.toxicity(empty, lab).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, lab.limit(0)).collect()} == {0.0}


def test_maximal_segments():
    rng = random.Random(9)
    for _ in range(200):
        v = np.array([rng.choice([-2, -1, 1, 2]) for _ in range(rng.randint(1, 12))], float)
        got = toxicity.maximal_segments(v)
        if (v > 0).any():
            best = max(v[a:b].sum() for a in range(len(v)) for b in range(a + 1, len(v) + 1))
            assert max(s for _, _, s in got) == best
        for a, b, s in got:
            assert s == v[a:b].sum() > 0
            # No proper part of a maximal segment scores more.
            assert all(v[x:y].sum() <= s for x in range(a, b) for y in range(x + 1, b + 1))


def test_bitmaps_of_long_sets(spark):
    """Unrelated sets of any size are ruled out, linked ones never; bits are parities of the distinct elements."""
    rng = np.random.default_rng(5)
    sets = []
    for n in (300, 1000, 3000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        near = np.concatenate([a[: n - n // 10], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)])
        sets += [np.unique(x) for x in (a, near, rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))]
    columns = set_links.signs(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*[c.to_pylist() for c in columns]))], "c long, " + set_links.SIGNS_SCHEMA)
    x, y = df.alias("x"), df.alias("y")
    met = x.join(y, (F.col("x.c") < F.col("y.c")) & set_links._may_link("x", "y", 80)).select("x.c", "y.c")
    assert {tuple(r) for r in met.collect()} == {(0, 1), (3, 4), (6, 7)}
    word, bit = int(sets[0][0] >> np.uint64(55)) // 64, int(sets[0][0] >> np.uint64(55)) % 64
    odd = sum(int(h) >> 55 == word * 64 + bit for h in sets[0]) % 2
    assert (columns[1 + word][0].as_py() >> bit) & 1 == odd


def test_sketch_rounds_together(monkeypatch):
    """Few elements take several rounds at once, with no hashing of all elements in each, and bins as one round after the other fills them."""
    t, calls = 24, []
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in (1, 2, 5, 30, 300)]
    step = near_dups.mix(np.arange(2 * t, dtype=np.uint64)) | np.uint64(1)
    expected = np.full((len(sets), t), 2**64 - 1, np.uint64)
    for row, own in zip(expected, sets):
        for i in range(2 * t):
            for x in (own * step[i] if i else own).tolist():
                k = i - t if i >= t else ((x >> 32) * t) >> 32
                row[k] = min(int(row[k]), i << 32 | x & 0xFFFFFFFF)
    plain = near_dups.mix
    monkeypatch.setattr(near_dups, "mix", lambda h, seed=0: calls.append(len(h)) or plain(h, seed))
    found = near_dups.sketch(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]), len(sets), t)
    assert (found == expected).all()
    assert calls == [2 * t]
