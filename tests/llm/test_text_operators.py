import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from massloom.llm import components, decontamination, html_text, lm_score, near_dedup, packing, substring_dedup, token_counts, toxicity, url_filter, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "a", "  x", "a  b c   d\n  e  \n f", "it's <|endoftext|> we'll", "<|startoftext|>x<|endoftext|>", "ÀÉ ΣΑΣ İx é \x1c x 12345 $$%", "\n\n b\t c\r\n d", "日本語 🎉🎉", "q\x00w  e", "a" * 3000, "word " * 4000]
DOCS = "doc_id long, text string, source string, id long, kept boolean, length long"


def docs(spark, texts, first=0):
    """Documents with more columns, some named like the operators' own."""
    return spark.createDataFrame([(first + i, t, None, None, None, None) for i, t in enumerate(texts)], DOCS)


def make(rng, n, vocabulary=3000):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab AB\t\né日", max_size=30), max_size=6))
def test_word_hashes_are_those_of_words(texts):
    h, rows = words.word_hashes(pa.array(texts, pa.string()))
    found = [w.translate(LOWER) for t in texts for w in WORD.findall(t)]
    assert len(h) == len(found) and np.diff(rows).tolist() == [len(WORD.findall(t)) for t in texts]
    by = defaultdict(set)
    for w, x in zip(found, h.tolist(), strict=True):
        by[w].add(x)
    assert all(len(v) == 1 for v in by.values()) and len(set(h.tolist())) == len(by)


@lru_cache
def library_of(path):
    return Tokenizer.from_file(path)


def test_token_counts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = {r.doc_id: r for r in token_counts.token_counts(docs(spark, ODD), path, 50).collect()}
    for i, t in enumerate(ODD):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((t or "").encode()), n > 50)
    assert token_counts.token_counts(docs(spark, []), path, 50).count() == 0


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ODD + [make(np.random.default_rng(i), 30 * i) for i in range(40)]
    rows = packing.pack_documents(docs(spark, [*texts]).unionByName(docs(spark, ["twice"], 999)).unionByName(docs(spark, ["twice"], 999)), path, 2, 256).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert sum(p.length for p in pieces) == len(ids) and [p.length for p in pieces[1:]] == [256] * (len(pieces) - 1) and len(pieces) == -(-len(ids) // 256)
        for p in pieces:
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    assert len(by[999]) == 2
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for x in at.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 256
    assert len(at) <= -(-sum(r.length for r in rows) // 256) + 2
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - n)
    return gaps


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.lists(st.integers(1, 20), max_size=60))
def test_a_sweep_is_best_fit_decreasing(lengths, gaps):
    left, rest, placed = packing.best_fit([(n, 0, k) for n, k in Counter(lengths).items()], [(g, i, 1) for i, g in enumerate(gaps)], 20)
    expected, free = [], list(gaps)
    for n in sorted(lengths, reverse=True):
        fit = [g for g in free if g >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            expected.append(n)
    assert sorted(n for n, _, k in left for _ in range(k)) == sorted(expected)
    assert sorted(g for g, _, k in rest for _ in range(k)) == sorted(g for g in free if g)
    ranks = Counter((n, r) for n, first, k, *_ in placed for r in range(first, first + k)) + Counter((n, r) for n, first, k in left for r in range(first, first + k))
    assert ranks == Counter((n, r) for n, k in Counter(lengths).items() for r in range(k))


def test_rounds_need_about_as_few_sequences_as_best_fit_decreasing(spark):
    rng = np.random.default_rng(5)
    for capacity, mean, spread in ((64, 0.3, 0.6), (100, 0.35, 0.1), (20, 0.5, 0.8)):
        lengths = np.clip(rng.lognormal(np.log(capacity * mean), spread, 1500).astype(int), 1, capacity).tolist()
        df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "id long, length long, part string")
        rows = packing.pack(df, capacity).collect()
        assert sorted((r.id, r.length, r.part) for r in rows) == [(i, n, "x") for i, n in enumerate(lengths)]
        used = defaultdict(list)
        for r in rows:
            used[r.sequence_id].append((r.offset, r.length))
        for x in used.values():
            x.sort()
            assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= capacity
        assert len(used) <= 1.02 * len(best_fit_decreasing(lengths, capacity))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab Z9'.,-\n\t  éÀß×÷日<|>"), st.characters(codec="utf-8")), max_size=40), max_size=8))
def test_encoder_gives_the_ids_of_the_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.encoder_of(path)
    ids, before = encoder.encode(pa.array(texts, pa.string()))
    assert encoder.merger is not None
    for i, t in enumerate(texts):
        assert ids[before[i] : before[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab Z9'.,-\n\t  éÀß×÷日<|>ΣİΑ"), st.characters(codec="utf-8")), max_size=40), max_size=8))
def test_counts_are_those_of_the_library(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = library_of(path)
    assert token_counts.merger_of(path).count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 40)] + [tuple(map(int, x)) for x in rng.integers(2000, 2300, (200, 2))]
    df = spark.createDataFrame([*links, (5, 5), (None, 4), (9, -7)], "a long, b long").repartition(7)
    got = {r.node: r.root for r in components.components(df, "test")[0].collect()}
    links = [(a, b) for a, b in [*links, (9, -7)] if a != b]
    assert got == roots({x for p in links for x in p}, links)
    assert components.components(spark.createDataFrame([], "a long, b long"), "test")[0].count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", " ", "one", "One", "a b c d", "a b c d e", "A B C D E", "x " * 3000]
    for k in range(25):
        base = make(rng, int(rng.integers(20, 400))).split()
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 6))):
            changed = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 25))):
                changed[int(rng.integers(0, len(base)))] = f"z{rng.integers(0, 9)}"
            texts.append(" ".join(changed))
    hot = make(rng, 120).split()
    for i in range(120):
        texts.append(" ".join([*hot[: i % 3], *hot[3:], f"tail{i % 40}"]))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    expected = roots(range(len(sets)), links)
    extra = spark.createDataFrame([(None, "nobody here at all today", None, None, None, None)], DOCS)
    rows = near_dedup.near_duplicates(docs(spark, texts).unionByName(extra)).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got.pop(None) == (1, None, True)
    assert got == {i: (len(sets[i]), expected[i], expected[i] == i) for i in range(len(sets))}
    kept = near_dedup.without_near_duplicates(docs(spark, texts))
    assert {r.doc_id for r in kept.collect()} == set(expected.values()) and kept.columns == docs(spark, []).columns
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_in_large_regions(spark):
    """A hub with many variants that are unlike each other, and a pair among many texts just below the threshold."""
    rng = np.random.default_rng(12)

    def variant(base, changes, places):
        out = list(base)
        for p in rng.choice(places, changes, replace=False):
            out[p] = f"v{rng.integers(10**9)}"
        return " ".join(out)

    hub = [f"h{i}" for i in range(204)]
    spread = np.arange(2, 200, 5)
    texts = [" ".join(hub), *(variant(hub, 5, spread) for _ in range(250))]
    form = [f"f{i}" for i in range(204)]
    texts += [variant(form, 7, spread) for _ in range(250)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(200)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (400 - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert found == {i: find(i) for i in range(len(texts))}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=25), min_size=1, max_size=4), st.integers(1, 6))
def test_compact_windows_cover_each_run_once(rows, least):
    h = np.array([x for r in rows for x in r], np.uint64)
    ends = np.cumsum([0, *map(len, rows)])
    for value, row, centre, left, right in substring_dedup.compact_windows(h, ends, least):
        for k, r in enumerate(rows):
            cover = np.zeros((len(r), len(r)), int)
            for i in np.flatnonzero(row == k):
                cover[left[i] : centre[i] + 1, centre[i] : right[i] + 1] += 1
            assert all(cover[i, j] == 1 for i in range(len(r)) for j in range(i + least - 1, len(r)))
    assert len(value) <= max(len(h), 0) * 2 + 1


def test_repeated_passages(spark):
    rng = np.random.default_rng(4)
    passage = make(rng, 80)
    line = make(rng, 20)
    texts = [f"{make(rng, 60)} {passage} {make(rng, 40)}", f"{make(rng, 200)} {passage.upper()}", f"{line} {make(rng, 100)} {line}", f"{line} {make(rng, 90)}", passage, None, "", "short text", make(rng, 300), passage]
    near = passage.split()
    near[40] = "changed"
    texts.append(f"{make(rng, 30)} {' '.join(near)} {make(rng, 30)}")
    texts += [f"{make(rng, 30)} {passage} {i}" for i in range(60)]
    rows = substring_dedup.repeated_passages(docs(spark, texts)).collect()
    cut = defaultdict(set)
    for r in rows:
        assert r.kept_doc_id < r.doc_id
        cut[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    assert set(cut) == {1, 4, 9, 10, *range(11, 71)}
    assert cut[1] == set(range(200, 280)) and cut[4] == set(range(80)) and cut[9] == set(range(80)) and cut[11] == set(range(30, 110))
    assert {30, 109} <= cut[10] and cut[10] <= set(range(30, 110))
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs(spark, texts)).collect()}
    assert set(left) == set(range(71)) - {4, 9} and left[0] == texts[0] and left[2] == texts[2] and left[1] == " ".join(texts[1].split()[:200])
    assert substring_dedup.repeated_passages(docs(spark, [])).count() == 0
    assert substring_dedup.cut_words("a b\nc d", [(1, 2)]) == "a d" and substring_dedup.cut_words(" a ", []) == " a "


@pytest.mark.parametrize(("parts", "keys"), [(1, 2_000_000), (16, 2_000_000), (3, 0)])
def test_passages_whose_parts_are_common(spark, monkeypatch, parts, keys):
    """Pairs share two lines that many smaller documents hold one of."""
    monkeypatch.setattr(substring_dedup, "BROADCAST_KEYS", keys)
    rng = np.random.default_rng(11)
    texts, expected = [], {}
    for _ in range(40):
        one, two = make(rng, 30, 30000), make(rng, 30, 30000)
        texts += [f"{make(rng, 20, 30000)} {line} {make(rng, 20, 30000)}" for line in (one, two) for _ in range(12)]
        texts += [f"{make(rng, n, 30000)} {one} {two} {make(rng, 20, 30000)}" for n in (20, 15)]
        expected[len(texts) - 1] = (15, 60, len(texts) - 2, 20)
    rows = substring_dedup.repeated_passages(docs(spark, texts).repartition(parts)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == expected and len(rows) == len(expected)


def test_repeated_passages_against_brute_force(spark):
    """Every stretch of 50 words that a smaller document holds is found, and only passages like one of it are."""
    rng = np.random.default_rng(14)
    lines = [make(rng, int(n), 500) for n in rng.integers(10, 90, 12)]
    texts = []
    for _ in range(150):
        parts = [lines[int(rng.integers(0, 12))] if rng.random() < 0.6 else make(rng, int(rng.integers(5, 60)), 500) for _ in range(int(rng.integers(1, 7)))]
        texts.append(" ".join(parts))
    seen, repeats = {}, defaultdict(set)
    for i, t in enumerate(texts):
        w = t.split()
        for a in range(len(w) - 49):
            if seen.setdefault(tuple(w[a : a + 50]), i) < i:
                repeats[i] |= set(range(a, a + 50))
    rows = substring_dedup.repeated_passages(docs(spark, texts)).collect()
    found = defaultdict(set)
    for r in rows:
        found[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
        mine = texts[r.doc_id].split()[r.first_word : r.first_word + r.n_words]
        theirs = texts[r.kept_doc_id].split()[max(0, r.kept_first_word - 10) : r.kept_first_word + r.n_words + 20]
        mine, theirs = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (mine, theirs))
        assert r.kept_doc_id < r.doc_id and len(mine & theirs) >= 0.7 * len(mine)
    assert sum(map(len, repeats.values())) > 5000 and all(repeats[i] <= found[i] for i in repeats)


def test_similar_passages_with_words_put_in():
    x = np.arange(56)
    y = np.concatenate((np.arange(26), 1000 + np.arange(7), np.arange(30, 56)))  # three words put in
    assert substring_dedup.repeated_runs(x, y, np.array([[0, 0, 10]]), 75) == [(0, 56, 0)]
    y = np.concatenate((np.arange(10), 1000 + np.arange(30), np.arange(10, 56)))
    assert substring_dedup.repeated_runs(x, y, np.array([[-30, 10, 10]]), 75) == [(10, 56, 40)]
    assert substring_dedup.repeated_runs(x, x + 100, np.array([[0, 0, 10]]), 75) == []


def test_passages_of_odd_rows(spark):
    rng = np.random.default_rng(15)
    passage = make(rng, 70)
    rows = [(1, passage, "a"), (1, passage, "b"), (None, passage, "c"), (2, f"x {passage}", "d"), (3, "same " * 9000, "e"), (4, "same " * 5000 + passage, "f"), (5, None, "g"), (5, f"{passage} y", "h")]
    df = spark.createDataFrame(rows, "doc_id int, text string, spans string").withColumn("key_id", F.lit(1)).withColumn("cut_id", F.lit(2))
    found = {(r.doc_id, r.first_word, r.n_words, r.kept_doc_id) for r in substring_dedup.repeated_passages(df).collect()}
    assert {(2, 1, 70, 1), (5, 0, 70, 1)} <= found and {d for d, *_ in found} == {2, 4, 5}
    left = substring_dedup.without_repeats(df)
    assert left.columns == df.columns
    assert sorted((r.spans, r.text) for r in left.collect() if r.spans in "abcdgh") == [("a", passage), ("b", passage), ("c", passage), ("d", "x"), ("g", None), ("h", "y")]


def test_decontamination(spark):
    questions = ["Tom has 12 apples and gives 5 km of rope to Anna Lee before he walks 12 miles home again", "What is it?", None, "", "short one"]
    items = spark.createDataFrame(list(enumerate(questions)) + [(None, "a b c d e f")], "item_id long, text string")
    filler = "the quick brown fox jumps over a lazy dog and then sleeps for a long while"
    texts = [
        f"{filler} {questions[0]} {filler}",
        f"{filler}. Tom has 31 apples and gives 7 km of rope to Mary Ann before he walks 31 miles home again. {filler}",
        f"{filler}. Tom has 31 apples and gives 7 km of rope to Mary Ann before he walks 99 miles home again. {filler}",
        filler, None, "", "What is it really", "so what is it? yes", "short one",
        "tom has 12 apples and gives 5 km of rope",
    ]
    rows = {(r.doc_id, r.item_id): r for r in decontamination.benchmark_matches(docs(spark, texts), items).collect()}
    assert set(rows) == {(0, 0), (1, 0), (6, 1), (7, 1), (8, 4)}
    assert not rows[0, 0].reworded and rows[1, 0].reworded and rows[1, 0].n_matched >= 0.75 * rows[1, 0].n_windows
    left = decontamination.without_benchmark(docs(spark, texts), items)
    assert {r.doc_id for r in left.collect()} == {2, 3, 4, 5, 9} and left.columns == docs(spark, []).columns
    assert decontamination.benchmark_matches(docs(spark, []), items).count() == 0
    assert decontamination.benchmark_matches(docs(spark, texts), items.where("false")).count() == 0
    text = decontamination.benchmark_matches(docs(spark, texts), items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", text)


def test_slots_over_all_distances(spark):
    question = "Tom has 12 apples and gives some of the rope to Anna before he walks with Ben over the hill for 12 miles home and sleeps until the next morning comes"
    items = spark.createDataFrame([(0, question), (0, question)], "item_id long, text string")
    filler = "the quick brown fox jumps over a lazy dog and then sleeps for a long while. "
    inserted = question.replace("he walks", "he slowly walks")
    texts = [
        filler + inserted,
        filler + inserted.replace("12", "31"),
        filler + inserted.replace("12 apples", "31 apples").replace("12 miles", "99 miles"),
        filler + question.replace("12", "31") + " " + filler + question.replace("12", "99"),
        filler + question.replace("Anna", "Mary").replace("Ben", "John"),
        filler + question.replace("Anna", "Mary").replace("Ben", "Mary"),
    ]
    found = decontamination.benchmark_matches(docs(spark, texts), items).collect()
    assert sorted(r.doc_id for r in found) == [0, 1, 3, 4]
    assert {r.doc_id for r in found if r.reworded} == {1, 3, 4}


def test_lm_scores_are_those_of_exact_counts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [None, "", "Aa aa\tbb", *(make(rng, int(rng.integers(1, 200)), 300) for _ in range(80))]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for t in texts]
    tokens.append(["zz", None])  # a repeated id
    held[len(texts)] = held[7]
    counts = Counter(w for i, t in enumerate(tokens) if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    levels = {w: int(lm_score.level_of(np.array([c]))[0]) for w, c in counts.items()}
    pairs = Counter(p for i, t in enumerate(tokens) if not held[i] for p in zip([None, *t[:-1]], t, strict=True))

    def low(c):
        return int(lm_score.level_floor(lm_score.level_of(np.array([c])))[0]) if c else 0

    def score(t):
        total = 0
        for v, w in zip([None, *t[:-1]], t, strict=True):
            high, own = (int(lm_score.level_floor(np.array([levels[x] + 1]))[0]) - 1 if x in levels else 0 for x in (v, w))
            both = min(low(pairs[v, w]), high, own)
            total += np.log10((both + lm_score.PRIOR * (low(counts[w]) + 1) / (n + v_ + 1)) / (high + lm_score.PRIOR))
        return total

    v_ = v
    close = 0
    tokens.pop()
    for size in (64 << 20, 64):
        monkeypatch.setattr(lm_score, "FILTER_BYTES", size)
        found = lm_score.score_documents(docs(spark, texts).unionByName(docs(spark, ["zz"], 7)).repartition(3)).collect()
        rows = {r.doc_id: r for r in found if r.doc_id != 7}
        assert len(found) == len(texts) + 1
        for i, t in enumerate(tokens):
            if i == 7:
                continue
            r = rows[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
            assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
            assert r.score == pytest.approx(score(t), rel=0.1)  # but for false hits
            close += r.score == pytest.approx(score(t), rel=0.01)
    assert close > 1.6 * len(texts)
    assert lm_score.score_documents(docs(spark, [])).count() == 0


def test_lm_learns_order(spark):
    rng = np.random.default_rng(9)
    chain = {f"w{i}": [f"w{(3 * i + k) % 50}" for k in range(3)] for i in range(50)}

    def walk(n):
        out = ["w0"]
        while len(out) < n:
            out.append(chain[out[-1]][int(rng.integers(0, 3))])
        return " ".join(out)

    rows = lm_score.score_documents(docs(spark, [walk(100) for _ in range(150)])).collect()
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > 0.6 * sum(r.base_score for r in unseen)


def test_lm_score_does_not_depend_on_the_size_for_a_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(10)
    texts = [None, "", "Aa aa\tbb", *(make(rng, int(rng.integers(1, 100)), 300) for _ in range(60))]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(None, "b c", None, None, None, None)], DOCS))
    whole = {r.doc_id: r for r in lm_score.score_documents(df).collect()}
    monkeypatch.setattr(lm_score, "FILTER_BYTES", 64)
    rows = lm_score.score_documents(df.repartition(5)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.score, r.base_score) == (pytest.approx(whole[r.doc_id].score, rel=1e-9), pytest.approx(whole[r.doc_id].base_score, rel=1e-9))
        assert (r.n_tokens, r.n_known, r.held_out) == (whole[r.doc_id].n_tokens, whole[r.doc_id].n_known, whole[r.doc_id].held_out)


def test_bloom_levels():
    counts = np.array([1, 1, 2, 3, 10, 1000])
    keys = words.mix(np.arange(6, dtype=np.uint64))
    levels = lm_score.level_of(counts)
    assert (lm_score.level_floor(levels) <= counts).all() and (counts < lm_score.level_floor(levels + 1)).all()
    bloom = lm_score.BloomCounts([np.tile(lm_score.filter_slice(keys, counts), 1)])
    assert (bloom.levels(keys) >= levels).all()
    assert (bloom.levels(words.mix(np.arange(100, 400, dtype=np.uint64))) > 0).mean() < 0.05


def brute_templates(rows):
    """Template by (host, path), node by node."""
    out, todo = {}, [(h, "", [(p, p.split("/")[1:], n) for g, p, n in rows if g == h]) for h in {r[0] for r in rows}]
    shape = {"end": lambda s: s is None, "slash": lambda s: s == "", "number": str.isdigit, "code": lambda s: re.fullmatch("[0-9A-Fa-f-]*[0-9][0-9A-Fa-f-]*", s), "word": lambda s: True}
    while todo:
        host, node, inside = todo.pop()
        out |= {(host, p): node for p, rest, _ in inside if not rest}
        inside = [x for x in inside if x[1]]
        counts = Counter()
        for _, rest, n in inside:
            counts[rest[0]] += n
        literal = {s for s, n in counts.items() if n >= url_filter.LEAST and n >= url_filter.SHARE * counts.total()}
        after = Counter()
        for _, rest, n in inside:
            if rest[0] in literal:
                s = rest[1] if len(rest) > 1 else None
                after[rest[0], next(k for k, test in shape.items() if test(s))] += n
        branch = {}
        if after:
            table = pd.DataFrame([(host, node, s, k, n) for (s, k), n in after.items()], columns=["host", "node", "segment", "shape", "n"])
            branch = {r.segment: r.branch for r in url_filter._merge_siblings(table).itertuples()}
        below = defaultdict(list)
        for p, rest, n in inside:
            below[branch.get(rest[0], "*")].append((p, rest[1:], n))
        todo += [(host, f"{node}/{name}", xs) for name, xs in below.items()]
    return out


def test_templates_against_brute_force(spark):
    rng = np.random.default_rng(21)
    names = ["a", "b", "news", "shop", "7", "x1", "", "zz"]
    rows = {("h" if i % 3 else "k", "".join(f"/{names[int(j)]}" for j in rng.integers(0, 8, int(rng.integers(0, 6))))): int(rng.integers(1, 9)) for i in range(300)}
    rows |= {("h", "/long" * 400): 9, ("h", "/long" * 400 + "/a"): 1, ("h", "/rare/" + "s/" * 500): 2, ("", ""): 3, ("k", "/once" * 300): 1}
    rows = [(*k, n) for k, n in rows.items()]
    df = spark.createDataFrame(rows, "host string, path string, n long")
    got = {(r.host, r.path): r.template for r in url_filter.templates(df).collect()}
    assert got == brute_templates(rows)


def test_url_rules_and_templates(spark):
    rules = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"))
    urls = [None, "", "no scheme", "http://WWW.Example.COM/en/x?q#f", "https://a.example.com/en/1", "https://a.example.com/de/1", "http://x.net/es/", "http://x.net/fr", "http://com", "http://notcom/", "://h/p", "http://a#://b/c"]
    urls += [f"http://site.org/spam/{i}" for i in range(40)] + [f"http://site.org/news/{i}.html" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, path string")
    labels = spark.createDataFrame([(i, int(i < 52)) for i in range(12, 92, 2)] + [(None, 1)], "page_id long, bad int")
    rows = {r.page_id: r for r in url_filter.judge_urls(pages, labels, rules).collect()}
    assert len(rows) == len(urls)
    head = [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(12)]
    assert head == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.example.com", "/en/1", "example.com/en/", "block"), ("a.example.com", "/de/1", "com/", "allow"),
        ("x.net", "/es/", "net/es/", "block"), ("x.net", "/fr", None, "allow"), ("com", "", None, "allow"), ("notcom", "/", None, "allow"), ("h", "/p", None, "allow"), ("a", "", None, "allow"),
    ]
    assert {rows[i].verdict for i in range(12, 52)} == {"block"} and {rows[i].verdict for i in range(52, 92)} == {"allow"}
    assert rows[12].template == "/spam/*" and rows[52].template == "/news/*"
    assert url_filter.judge_urls(pages.where("false"), labels, rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages.where("page_id > 11"), labels.where("false"), rules).collect()} == {"allow"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav>
<header>Site</header><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more %d</h1><p>First   <b>bold</b> text&nbsp;here.<p>Second<br>line</p>
<ul><li>one<li>two</ul><form><input><label>Name</label></form><div class="comments"><p>Nice!</p></div></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""
BARE = "<html><body><div class='menu'>A B</div><div id='content'><p>Text number %d of this page goes on and on.</p><p>More %d text.</p></div><div class='legal'><p>Always the same words</p></div></body></html>"


def test_html(spark):
    sources = [("http://a.com/1", PAGE % 1), ("http://a.com/2", PAGE % 2), *((f"http://b.com/{i}", BARE % (i, i)) for i in range(5)), ("http://c.com/", None), ("http://c.com/", ""), (None, "<p>x &lt; y</p>"), ("http://d.com", "<article>1 < 2 and <b>3</article><p>after")]
    pages = spark.createDataFrame([(i, u, h, "t") for i, (u, h) in enumerate(sources)], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in html_text.main_text(pages).collect()}
    assert rows[0].text == "Title & more 1\nFirst bold text here.\nSecond\nline\none\ntwo" and rows[0].n_chars == len(rows[0].text)
    assert rows[3].text == "Text number 1 of this page goes on and on.\nMore 1 text."
    assert rows[7].text == rows[8].text == "" and rows[9].text == "x < y" and rows[10].text == "1 < 2 and 3"
    assert html_text.main_text(pages.where("false")).count() == 0


def test_html_of_hosts_with_several_templates(spark):
    def long(word, i):
        return " ".join(f"{word}{i}x{k}" for k in range(40))

    sources = [("http://a.com/", f"<body><article><p>{long('art', i)}</p></article></body>", long("art", i)) for i in range(4)]
    sources += [("http://a.com/", f"<body><div class=text><p>{long('own', i)}</p></div></body>", long("own", i)) for i in range(4)]
    sources += [("http://b.com/", f"<body><div class=post><p>{long('post', i)}</p></div></body>", long("post", i)) for i in range(30)]
    sources += [("http://b.com/", f"<body><div class=story><p>{long('story', i)}</p></div></body>", long("story", i)) for i in range(2)]
    sources += [("http://c.com/", f"<body><div class=text><div class=para>{12 * long('para', i)}</div><div class=quote>{long('quote', i)}</div></div></body>", f"{12 * long('para', i)}\n{long('quote', i)}") for i in range(5)]
    sources += [("http://d.com/", "<body><div><h1>Title</h1><p>Only paragraph</p></div></body>", "Title\nOnly paragraph")] * 4
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(sources)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert found == {i: text for i, (_, _, text) in enumerate(sources)}


def test_wrappers_align():
    a = html_text.page_wrapper(html_text.page_blocks(PAGE % 1))
    b = html_text.page_wrapper(html_text.page_blocks((PAGE % 2).replace("<aside>Side</aside>", "")))
    both = html_text.align(a, b)
    aside = [s for s in both if s[0].endswith("aside")]
    assert aside[0][1] and not [s for s in both if s[0].endswith("h1")][0][1]
    assert [s[2] for s in both if s[0].endswith("li")] == [True]
    h1 = next(s for s in both if s[0].endswith("h1"))
    footer = next(s for s in both if s[0].endswith("footer"))
    assert h1[4] != h1[5] and footer[4] == footer[5]


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    bad = ["vile", "nasty", "awful"]
    texts, labels = [None, ""], [(0, 0), (1, None)]
    for i in range(2, 600):
        w = make(rng, int(rng.integers(5, 80)), 200).replace("w", "word").translate(str.maketrans("0123456789", "abcdefghij")).split()
        toxic = i % 6 == 0
        if toxic:
            for b in rng.choice(bad, int(rng.integers(1, 4)), replace=False):
                w.insert(int(rng.integers(0, len(w))), str(b).upper() + ",")
        texts.append(" ".join(w))
        if i < 400:
            labels.append((i, int(toxic)))
    grades = spark.createDataFrame([*labels, (None, 1)], "doc_id long, grade int")
    model = toxicity.fit_severity(docs(spark, texts), grades, 3, split=True)
    assert (np.diff(model.thresholds) > 0).all()
    rows = {r.doc_id: r for r in toxicity.severity(docs(spark, texts), model).collect()}
    assert all(rows[i].toxic == (i % 6 == 0) for i in range(400, 600))
    assert all(0 <= r.severity <= 2 and 0 <= r.grade <= 2 for r in rows.values()) and not rows[0].toxic
    left = toxicity.without_toxic(docs(spark, texts), model)
    assert {r.doc_id for r in left.collect()} == {i for i in range(600) if not rows[i].toxic} and left.columns == docs(spark, []).columns
    none = toxicity.fit_severity(docs(spark, texts), grades.where("false"), 3, split=True)
    assert toxicity.severity(docs(spark, texts), none).where("toxic").count() == 0
