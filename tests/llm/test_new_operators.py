"""Exact dedup, fill-in-the-middle and importance resampling against brute force, on texts of all kinds."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from massloom.llm.exact_dedup import exact_copies, without_copies
from massloom.llm.fill_in_middle import fill_in_middle, restored, words
from massloom.llm.resampling import block_features, importance_resample, join_crcs, ranked

_WORDS = "the of Ärger naïve 東京 😀 a1b2 İstanbul ſ K <P> x".split()


def texts():
    rng = np.random.default_rng(5)
    out = [None, "", " ", "a", "A", "Ä", "ä", "é", "😀😀", "<P>a", "b<M>", "<<S>", "<P", "K", "k", "x " * 30000]
    out += [" ".join(rng.choice(_WORDS, n)) for n in rng.integers(1, 60, 60)]
    out += [t.upper() for t in out[20:40]] + out[16:50] + ["Twice Twice"] * 40
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 - 5, t, "x", i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, content string, keep_id int").repartition(3)


def lower(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def copies_of(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    return sorted((i, best(groups[lower(t)]), len(groups[lower(t)]), i == best(groups[lower(t)]), hashlib.sha256(lower(t)).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize(("keep", "best"), [("largest", max), ("smallest", min)])
def test_exact_copies(docs, keep, best, limit):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, exact_copies(docs, keep, broadcast_groups=limit).collect())) == copies_of(rows, best)


@pytest.mark.parametrize("limit", [0, 1000])
def test_texts_that_share_a_hash_are_told_apart(docs, limit):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    weak = lambda t: F.substring(t, 1, 1).cast("binary")
    assert sorted(map(tuple, exact_copies(docs, "largest", content_hash=weak, broadcast_groups=limit).collect())) == copies_of(rows, max)


def test_documents_without_copies(docs):
    left = without_copies(docs, "largest")
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _, _, kept, _ in copies_of([(r.doc_id, r.text) for r in docs.collect()], max) if kept)


def test_exact_copies_without_ids_and_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "A"), (1, "b"), (None, "B"), (2, "c"), (2, "C"), (2, "d"), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_copies(df).collect())
    assert got == Counter({(None, None, 2, True): 2, (1, 1, 2, True): 1, (None, 1, 2, False): 1, (2, 2, 2, True): 2, (2, 2, 1, True): 1, (None, None, 1, True): 1})
    assert exact_copies(df.limit(0)).count() == 0 and without_copies(df).count() == 7


def test_exact_copies_are_native(docs):
    for text in (exact_copies(docs)._jdf.queryExecution().toString(), without_copies(docs)._jdf.queryExecution().toString()):
        assert not re.search("Python|Pandas|Arrow", text)


def cut_of(i, t, units, n):
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, t, t
    if h[3] % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}", t
    return i, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}", t


@pytest.mark.parametrize("chunk", [1, 5, 4096])
def test_fill_in_middle(docs, chunk):
    out = fill_in_middle(docs, chunk=chunk) if chunk > 1 else fill_in_middle(docs.where("length(text) < 500 or text is null"), chunk=chunk)
    got = out.select("*", restored(F.col("output"), F.col("form")).alias("back")).collect()
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(known) - (chunk == 1)
    for r in got:
        t = known[r.doc_id]
        assert tuple(r) == cut_of(r.doc_id, t, list(t), len(t))


def test_cuts_between_words(docs):
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in fill_in_middle(docs, predicate=words, chunk=7).collect():
        t = known[r.doc_id]
        units = re.findall(r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", t)
        assert "".join(units) == t
        assert tuple(r) == cut_of(r.doc_id, t, units, len(units))[:6]


def test_fill_in_middle_without_ids_and_rows(spark):
    df = spark.createDataFrame([(None, "some text here"), (None, "some text here"), (4, None)], "doc_id long, text string")
    got = sorted(map(tuple, fill_in_middle(df).collect()), key=repr)
    assert got == sorted([cut_of(None, "some text here", list("some text here"), 14)[:6]] * 2 + [(4, 0, "plain", None, None, "")], key=repr)
    assert fill_in_middle(df.limit(0)).count() == 0


def features_of(t):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    return len(w), [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resample_of(docs, target, percent, least):
    found = [(i, *features_of(t)) for i, t in docs]
    s = Counter(zlib.crc32(f) % 10000 for _, _, fs in found for f in fs)
    t = Counter(zlib.crc32(f) % 10000 for x in target for f in features_of(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for i, n, fs in found:
        weight = sum(gain[zlib.crc32(f) % 10000] for f in fs)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0]))
    ranks = {r[0]: k for k, r in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted((*r[:4], ranks.get(r[0])) for r in out)


def test_importance_resample(spark, docs):
    target = spark.createDataFrame([("the of 東京 x", 1), (None, 2), ("a1b2 the K k", 3)], "text string, doc_id int")
    got = importance_resample(docs, target, percent=30, least_words=5)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == resample_of([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], 30, 5)


def test_importance_resample_of_little(spark, docs):
    none = spark.createDataFrame([], "text string")
    few = spark.createDataFrame([(1, "a b"), (None, "c d e"), (2, None), (3, "a b"), (3, "b " * 40)], "doc_id long, text string")
    got = importance_resample(few, none, percent=100, least_words=2).collect()
    assert sorted((r.doc_id, r.n_features) for r in got) == [(1, 3), (2, 0), (3, 3), (3, 117)]
    assert sorted(r.rank or 0 for r in got) == [0, 1, 2, 3]
    assert importance_resample(few.limit(0), none).count() == 0


def test_ranks_over_ranges(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 50).alias("score"))
    order = sorted(((r.score, r.doc_id) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    got = ranked(df.repartition(7), ["score desc", "doc_id"], 700).collect()
    assert len(got) == 2000
    assert [(r.score, r.doc_id) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == order[:700]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30) | st.none(), min_size=1, max_size=8))
def test_block_features_are_those_of_each_text(rows):
    crcs, counts, places, owners, n_words = block_features(pa.array([(t or "").encode("utf-8", "ignore").decode() for t in rows], pa.string()))
    want = [features_of((t or "").encode("utf-8", "ignore").decode()) for t in rows]
    assert n_words.tolist() == [n for n, _ in want]
    for k, (_, fs) in enumerate(want):
        assert sorted(crcs[places[owners == k]].tolist()) == sorted(zlib.crc32(f) for f in fs)
    assert sorted(np.repeat(crcs, counts).tolist()) == sorted(zlib.crc32(f) for _, fs in want for f in fs)
    assert len(crcs) == len({f for _, fs in want for f in fs})


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=40), st.binary(min_size=1, max_size=3000))
def test_crc_of_a_whole_is_that_of_its_parts(a, b):
    from massloom.llm.resampling import _shift_table

    table = np.stack([_shift_table(len(b))])
    got = join_crcs(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), table, np.zeros(1, np.int64))
    assert int(got[0]) == zlib.crc32(a + b)
