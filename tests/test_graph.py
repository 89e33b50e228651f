"""Graph features and the peptide search against plain loops."""

import random

from pyspark.sql import functions as F

from massloom.operators import joins, proteins

from test_queries import plan


def test_linked_features(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(25), rng.randrange(3), rng.randrange(30)) for _ in range(90)]
    df = spark.createDataFrame(rows, "pep long, form long, protein long")
    got = {(r.pep, r.form): r for r in proteins.linked_features(df, "pep", "form", "protein").collect()}
    held, spectra, forms = {}, {}, {}
    for pep, form, protein in rows:
        held.setdefault(pep, set()).add(protein)
        spectra[pep] = spectra.get(pep, 0) + 1
        forms[pep, form] = forms.get((pep, form), 0) + 1
    assert set(got) == set(forms)
    of = {p: [pep for pep in held if p in held[pep]] for p in {r[2] for r in rows}}
    for (pep, form), r in got.items():
        n = len(held[pep])
        best, link, other = 0, (0, 0), 0
        for p in sorted(held[pep]):
            u = sum(spectra[q] for q in of[p] if len(held[q]) == 1) - (n == 1)
            s = sum(spectra[q] for q in of[p] if len(held[q]) > 1) - (n > 1)
            if u + s > best:
                best, link = u + s, (u, s)
            other = max([other, *(spectra[q] for q in of[p] if q != pep)])
        assert (r.form_spectra, r.peptide_spectra, r.n_proteins) == (forms[pep, form], spectra[pep], n)
        assert (r.linked_unique, r.linked_shared, r.most_other_spectra) == (*link, other)
        assert r.peptides == max(len(of[p]) for p in held[pep])
        assert r.unique_peptides == (sum(len(held[q]) == 1 for q in of[min(held[pep])]) if n == 1 else 0)
        assert r.shared_peptides == (max(sum(len(held[q]) > 1 for q in of[p]) for p in held[pep]) if n > 1 else 0)


def test_peptide_search(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACDE") for _ in range(rng.randrange(0, 90))) for _ in range(60)] + ["COMMON" + c * 20 for c in "ACDEFGHI"] + [None, ""]
    wanted = [s[5 : 5 + rng.randrange(1, 12)] for s in seqs if s and len(s) > 20] + ["COMMONA", "COMMONIII", "COMMON", "A", "WWWWWWW", "", None, "A"]
    p = spark.createDataFrame(list(enumerate(seqs)), "protein_id int, seq string")
    q = spark.createDataFrame([(w,) for w in wanted], "peptide string")
    got = joins.peptide_search(p, q)
    assert sorted(map(tuple, got.collect())) == sorted({(i, w) for i, s in enumerate(seqs) for w in wanted if s and w and w in s})
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_a_run_that_all_proteins_hold_is_no_key(spark):
    p = spark.createDataFrame([(i, f"SHARED{'ACDEFGHIKL'[i % 10] * 3}{'MNPQRSTVWY'[i // 10] * 3}") for i in range(100)], "protein_id int, seq string")
    q = p.select(F.substring("seq", 1, 12).alias("peptide"))
    found = joins.rarest_kmers(p, q, 6).collect()
    assert len(found) == 100 and max(r.holders for r in found) == 1
    assert joins.peptide_search(p, q).count() == 100
    assert joins.peptide_search(p.limit(0), q).count() == 0
