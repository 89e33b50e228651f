"""Few peptides are found in sequences where these are; many by the shuffled join; both alike."""

import random

from massloom.operators import joins
from massloom.plans import protein_queries

from test_queries import plan


def test_both_ways_give_the_same(spark):
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACDé") for _ in range(rng.randrange(0, 200))) for _ in range(80)] + ["AAAAAAAA" * 9, "", None, "A\x00CD"]
    wanted = {s[i : i + rng.randrange(1, 14)] for s in seqs if s for i in (0, len(s) // 2, len(s) - 2)} | {"A", "AA", "AAAAAAAAA", "é", "\x00C", "WWW"}
    p = spark.createDataFrame([(i % 90, s) for i, s in enumerate(seqs + seqs[:9])], "protein_id int, seq string")
    q = spark.createDataFrame([(w,) for w in [*sorted(wanted), "", None, "A"]], "peptide string")
    want = sorted({(i % 90, w) for i, s in enumerate(seqs + seqs[:9]) for w in wanted if s and w in s})
    assert sorted(map(tuple, joins.peptide_search(p, q).collect())) == want and len(want) > 500
    assert sorted(map(tuple, joins.peptide_search(p, q, most_letters=0).collect())) == want
    assert joins.peptide_search(p, q.limit(0)).count() == joins.peptide_search(p.limit(0), q).count() == 0


def test_texts_lie_in_several_blocks():
    tree = joins.PrefixTree(["ABC", "AB", "C", "BCA"])
    data = tree.kind[[ord(c) for c in "ABCAB-"]]
    whole = [tuple(map(int, x)) for x in zip(*tree.found(data, 0, 6))]
    parts = [tuple(map(int, x)) for k in range(6) for x in zip(*tree.found(data, k, k + 1))]
    assert sorted(whole) == sorted(parts) == [(0, 0), (0, 1), (1, 3), (2, 2), (3, 1)]


def test_runs_of_sequences_are_not_shuffled(spark):
    """Each run of six letters of all sequences was a row of a join."""
    text = plan(protein_queries.peptide_search(spark, "/root/testdata/sf0.001"))
    assert "Generate" not in text and "Join" not in text
