"""Quantification: reporter ions, label percentages, spectral counts and modification sites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reporter_intensities(peaks: Column, ions: Mapping[str, float], tolerance: float) -> list[Column]:
    """Highest intensity within tolerance of each ion's m/z, 0 if none. peaks: array of structs mz, inten."""

    def near(mz: float) -> Column:
        return F.transform(F.filter(peaks, lambda p: F.abs(p["mz"] - mz) <= tolerance), lambda p: p["inten"])

    return [F.coalesce(F.array_max(near(mz)), F.lit(0.0)).alias(name) for name, mz in ions.items()]


def impurity_corrected(values: Sequence[Column], impurity: np.ndarray) -> list[Column]:
    """Solve impurity^T x = values for each row; the matrix is inverted once, rows are dot products; negative results are 0."""
    inverse = np.linalg.inv(np.asarray(impurity, float).T)
    return [F.greatest(sum((v * float(w) for v, w in zip(values, row, strict=True)), F.lit(0.0)), F.lit(0.0)) for row in inverse]


def intensity_normalised(df: DataFrame, ions: Sequence[str]) -> DataFrame:
    """Scale every ion's column so that all ions have the mean total."""
    totals = df.agg(*(F.sum(c).alias(f"_t_{c}") for c in ions))
    everything = sum((F.col(f"_t_{c}") for c in ions), F.lit(0.0))
    scaled = df.crossJoin(F.broadcast(totals))  # one row
    return scaled.select(*(c for c in df.columns if c not in ions), *((F.col(c) * everything / (len(ions) * F.col(f"_t_{c}"))).alias(c) for c in ions))


def labelled_summary(psms: DataFrame, by: Sequence[str], pct: str, threshold: float) -> DataFrame:
    """For each group: n_psms, median_pct, n_labelled (pct over threshold, strictly)."""
    return psms.groupBy(*by).agg(F.count("*").alias("n_psms"), F.median(pct).alias("median_pct"), F.count(F.when(F.col(pct) > threshold, 1)).alias("n_labelled"))


def spectra_pivot(psms: DataFrame, protein: str, file: str, files: Sequence[str]) -> DataFrame:
    """Matches of each protein by file, one column a file; the files are stated, so no pass is needed to find them."""
    counts = [F.count(F.when(F.col(file) == f, 1)).alias(f"n_{f}") for f in files]
    present = sum((F.when(F.col(f"n_{f}") > 0, 1).otherwise(0) for f in files), F.lit(0))
    return psms.groupBy(protein).agg(*counts).withColumn("n_files", present.cast("long"))


def coverage(places: DataFrame) -> DataFrame:
    """Covered residues of each protein from occurrences (protein_id, start from 1, length, protein_length): covered, coverage."""
    spots = places.select("protein_id", "protein_length", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("position")).distinct()
    return spots.groupBy("protein_id", "protein_length").agg(F.count("*").alias("covered")).withColumn("coverage", F.col("covered") / F.col("protein_length"))


def modification_sites(peptides: DataFrame, symbols: str) -> DataFrame:
    """Each modification of an identified peptide (with symbols after residues): peptide, stripped, offset (from 0), residue, ptm."""
    letters = F.split("peptide", "")
    stripped = F.regexp_replace("peptide", f"[{''.join('\\' + s for s in symbols)}]", "")
    spots = peptides.select("peptide", stripped.alias("stripped"), F.posexplode(F.filter(letters, lambda c: c != "")).alias("at", "letter"), F.filter(letters, lambda c: c != "").alias("letters"))
    hit = spots.where(F.col("letter").isin(*symbols))
    before = F.size(F.filter(F.slice("letters", 1, F.col("at")), lambda c: ~c.isin(*symbols)))
    return hit.select("peptide", "stripped", (before - 1).alias("offset"), F.element_at("letters", F.col("at")).alias("residue"), F.col("letter").alias("ptm"))


def occurrences(df: DataFrame, seq: str, peptide: str) -> DataFrame:
    """Each (possibly overlapping) place, from 1, at which the row's seq holds its peptide: column start."""
    last = F.length(seq) - F.length(peptide) + 1
    starts = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(F.col(seq), i, F.length(peptide)) == F.col(peptide))
    return df.where(F.length(peptide) > 0).withColumn("start", F.explode(starts))


def context(seq: Column, position: Column, reach: int = 10) -> tuple[Column, Column]:
    """Residues before and after a position (from 1), up to reach."""
    first = F.greatest(position - reach, F.lit(1))
    return F.substring(seq, first, position - first), F.substring(seq, position + 1, F.lit(reach))


def site_table(peptides: DataFrame, proteins: DataFrame, symbols: str) -> DataFrame:
    """Modified and unmodified counts of each modified protein position.

    peptides: protein_id, peptide (with symbols), spectra, score; proteins: protein_id, seq.
    Returns protein_id, position (from 1), residue, ptm, modified_peptides, modified_spectra,
    unmodified_peptides, unmodified_spectra, best_score, before, after.
    """
    stripped = F.regexp_replace("peptide", f"[{''.join('\\' + s for s in symbols)}]", "")
    placed = occurrences(peptides.withColumn("stripped", stripped).join(proteins, "protein_id"), "seq", "stripped")
    sites = modification_sites(peptides.select("peptide").distinct(), symbols).drop("stripped")
    modified = placed.join(sites, "peptide").withColumn("position", F.col("start") + F.col("offset"))
    counted = modified.groupBy("protein_id", "seq", "position", "residue", "ptm").agg(F.count_distinct("peptide").alias("modified_peptides"), F.sum("spectra").alias("modified_spectra"), F.max("score").alias("best_score"))
    spots = counted.select("protein_id", "position", "residue", "ptm")
    covering = placed.withColumn("position", F.explode(F.sequence("start", F.col("start") + F.length("stripped") - 1))).select("protein_id", "peptide", "spectra", "position")
    here = modified.select("protein_id", "peptide", "position", "ptm").distinct()
    bare = covering.join(spots, ["protein_id", "position"]).join(here, ["protein_id", "peptide", "position", "ptm"], "left_anti").groupBy("protein_id", "position", "ptm").agg(F.count_distinct("peptide").alias("unmodified_peptides"), F.sum("spectra").alias("unmodified_spectra"))
    before, after = context(F.col("seq"), F.col("position"))
    out = counted.join(bare, ["protein_id", "position", "ptm"], "left")
    return out.select("protein_id", "position", "residue", "ptm", "modified_peptides", "modified_spectra", F.coalesce("unmodified_peptides", F.lit(0)).alias("unmodified_peptides"), F.coalesce("unmodified_spectra", F.lit(0)).alias("unmodified_spectra"), "best_score", before.alias("before"), after.alias("after"))


def peak_heights(used: DataFrame, chromatograms: DataFrame, key: list[str], psm: str, chromatogram: str, height: str) -> DataFrame:
    """Summed heights of the distinct chromatograms that hold a key's matches; 1 where that is 0.

    used: key and match, a row each; chromatograms: chromatogram, height and match, a row for each match it holds.
    """
    reached = used.select(*key, psm).distinct().join(chromatograms.select(psm, chromatogram, height).distinct(), psm, "left")
    once = reached.groupBy(*key, chromatogram).agg(F.max(height).alias("_height"))
    total = once.groupBy(*key).agg(F.coalesce(F.sum("_height"), F.lit(0.0)).alias("_sum"))
    return total.select(*key, F.when(F.col("_sum") == 0, 1.0).otherwise(F.col("_sum")).alias("peak_height"))


def labelled_by_file(psms: DataFrame, file: str, protein: str, peptide: str, level: str, threshold: float) -> DataFrame:
    """A row for each file: matches, proteins and distinct peptides in it, and of each those above the threshold of label; a protein
    is labelled if the median of its matches is. Null levels count as no label.
    """
    above = F.coalesce(F.col(level) > threshold, F.lit(False))
    of_protein = psms.groupBy(file, protein).agg(F.count("*").alias("n"), F.count(F.when(above, 1)).alias("labelled"), F.median(level).alias("median"))
    proteins = of_protein.groupBy(file).agg(F.sum("n").alias("psms"), F.sum("labelled").alias("labelled_psms"), F.count("*").alias("proteins"), F.count(F.when(F.col("median") > threshold, 1)).alias("labelled_proteins"))
    peptides = psms.groupBy(file, peptide).agg(F.max(above.cast("int")).alias("above")).groupBy(file).agg(F.count("*").alias("peptides"), F.sum("above").alias("labelled_peptides"))
    return proteins.join(peptides, file)


def matches_of_groups(psms: DataFrame, members: DataFrame, protein: str, group: str, match: list[str]) -> DataFrame:
    """Distinct matches of protein groups: a match that several proteins of a group share comes once. members: protein, group."""
    return psms.join(members.select(protein, group).distinct(), protein).select(group, *match).distinct()
