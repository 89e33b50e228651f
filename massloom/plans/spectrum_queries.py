"""Queries over scans, peaks and sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massloom.functions import chemistry
from massloom.operators import digest, joins, quant, spectra
from massloom.plans.tables import PEAKS, PROTEINS, Registry, peaks, proteins, scans, table

REGISTRY = Registry()
query = REGISTRY.add
#: Peptides as fragments of proteins: KR cleaved, few enough to score.
AFTER, BEFORE = "KR", "ACDEFGHIKLMNQRSTVWY"


@query("SELECT o_orderkey, p_partkey, o_totalprice FROM orders JOIN part ON o_totalprice BETWEEN p_partkey * 20.0 - 0.5 AND p_partkey * 20.0 + 0.5")
def precursor_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans_ = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    peptides = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 20.0).alias("mass"))
    joined = joins.range_join(scans_, peptides, "o_totalprice", F.col("mass") - 0.5, F.col("mass") + 0.5, 1.0)
    return joined.select("o_orderkey", "p_partkey", "o_totalprice")


@query("SELECT DISTINCT o_orderkey, p_partkey FROM orders JOIN part ON " + " OR ".join(f"o_totalprice BETWEEN p_partkey * 20.0 + ({w * chemistry.NEUTRON}) - 0.3 AND p_partkey * 20.0 + ({w * chemistry.NEUTRON}) + 0.3" for w in (-2, -1, 0, 1, 2)))
def multi_window_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans_ = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    peptides = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 20.0).alias("mass"))
    return joins.multi_window_join(scans_, peptides, "o_totalprice", "mass", [w * chemistry.NEUTRON for w in (-2, -1, 0, 1, 2)], 0.3).select("o_orderkey", "p_partkey")


_IONS = "(SELECT vec_id AS scan, i AS ion, 97.0 + 13.0 * i AS mz FROM embeddings, unnest(range(0, 40)) AS u(i))"


def _ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scan"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("ion")).withColumn("ion_mz", 97.0 + 13.0 * F.col("ion"))


@query(f"SELECT scan, ion, mz, inten FROM (SELECT i.scan, i.ion, p.mz, p.inten, row_number() OVER (PARTITION BY i.scan, i.ion ORDER BY abs(i.mz - p.mz), p.mz) r FROM {_IONS} i JOIN {PEAKS} p ON i.scan = p.scan AND abs(i.mz - p.mz) < 4) WHERE r = 1")
def nearest_peak_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = joins.best_in_tolerance(_ions(spark, sf_dir), peaks(spark, sf_dir), ["scan"], "ion_mz", "mz", 4.0, [F.abs(F.col("ion_mz") - F.col("mz")), F.col("mz")], ["scan", "ion"], strict=True)
    return near.select("scan", F.col("ion").cast("long").alias("ion"), "mz", "inten")


@query(f"SELECT scan, ion, mz, inten FROM (SELECT i.scan, i.ion, p.mz, p.inten, row_number() OVER (PARTITION BY i.scan, i.ion ORDER BY p.inten DESC, p.mz) r FROM {_IONS} i JOIN {PEAKS} p ON i.scan = p.scan AND abs(i.mz - p.mz) <= 12) WHERE r = 1")
def strongest_peak_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = joins.best_in_tolerance(_ions(spark, sf_dir), peaks(spark, sf_dir), ["scan"], "ion_mz", "mz", 12.0, [F.desc("inten"), F.col("mz")], ["scan", "ion"])
    return near.select("scan", F.col("ion").cast("long").alias("ion"), "mz", "inten")


_REPORTERS = {"ion_126": 130.0, "ion_127": 205.0, "ion_128": 333.0}


@query(f"SELECT scan, {', '.join(f'coalesce(max(CASE WHEN abs(mz - {m}) <= 6 THEN inten END), 0) AS {n}' for n, m in _REPORTERS.items())} FROM {PEAKS} GROUP BY scan")
def reporter_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(spark, sf_dir).select("scan", *quant.reporter_intensities(F.col("peaks"), _REPORTERS, 6.0))


@query(f"SELECT scan, z, CAST(count(*) AS BIGINT) AS n_peaks, round(sum(inten), 6) AS total, max(inten) AS most FROM {PEAKS} GROUP BY scan, z")
def scan_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["inten"])
    return scans(spark, sf_dir).select("scan", "z", F.size("peaks").cast("long").alias("n_peaks"), F.round(total, 6).alias("total"), F.array_max(F.transform("peaks", lambda p: p["inten"])).alias("most"))


@query("WITH s AS (SELECT event_id, value * 4 + 300 AS parent, list_sort(list_transform(range(0, 40), lambda i: CAST(100 + (event_id * 37 + i * 29) % 700 AS DOUBLE)), 'DESC') AS mz, event_type = 'view' AS unknown FROM events WHERE value IS NOT NULL) SELECT event_id, unnest(CASE WHEN NOT unknown THEN [2] WHEN mz[2] < parent THEN [1] ELSE [2, 3] END) AS z FROM s")
def charge_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    mz = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: (F.lit(100) + (F.col("event_id") * 37 + i * 29) % 700).cast("double"))
    rows = table(spark, sf_dir, "events").where("value is not null").select("event_id", (F.col("value") * 4 + 300).alias("parent_mz"), mz.alias("mz"), F.when(F.col("event_type") == "view", 0).otherwise(2).alias("charge"))
    return rows.select("event_id", F.explode(spectra.possible_charges(F.col("charge"), F.col("mz"), F.col("parent_mz"))).alias("z"))


@query(f"SELECT scan, place, mz, inten FROM (SELECT *, sum(inten) OVER w - inten AS before, sum(inten) OVER (PARTITION BY scan) AS total FROM {PEAKS} WINDOW w AS (PARTITION BY scan ORDER BY inten DESC, mz ROWS UNBOUNDED PRECEDING)) WHERE round(before, 9) < round(0.98 * total, 9)")
def tic_98_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = scans(spark, sf_dir).select("scan", F.explode(spectra.most_intense(F.col("peaks"), 0.98)).alias("p"))
    return kept.select("scan", F.round((F.col("p.mz") - 100) / 10).cast("long").alias("place"), "p.mz", "p.inten")


@query(f"SELECT scan, mz, inten, max(inten) OVER (PARTITION BY scan ORDER BY CAST(mz AS BIGINT) RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS local_max FROM {PEAKS}")
def local_max_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("scan").orderBy(F.col("mz").cast("long")).rangeBetween(-50, 50)
    return peaks(spark, sf_dir).select("scan", "mz", "inten", F.max("inten").over(w).alias("local_max"))


#: RE2 has no look-ahead and a site's second residue may be a first one, too, so the marking runs twice.
_CUT = f"(SELECT protein_id, list_filter(string_split(regexp_replace(regexp_replace(seq, '([KR])([{BEFORE}])', '\\1 \\2', 'g'), '([KR])([{BEFORE}])', '\\1 \\2', 'g'), ' '), lambda x: x <> '') AS pieces FROM {PROTEINS})"


def _digest_sql(missed: int) -> str:
    return f"SELECT protein_id, peptide, CAST(count(*) AS BIGINT) AS n FROM (SELECT protein_id, array_to_string(pieces[i:i + k], '') AS peptide FROM (SELECT protein_id, pieces, k, unnest(range(1, len(pieces) - k + 1)) AS i FROM {_CUT}, unnest(range(0, {missed + 1})) AS u(k))) WHERE length(peptide) BETWEEN 7 AND 30 GROUP BY ALL"


def _digest(spark: SparkSession, sf_dir: str, missed: int) -> DataFrame:
    return digest.digest(proteins(spark, sf_dir), AFTER, BEFORE, missed, 7, 30, places=False).groupBy("protein_id", "peptide").agg(F.count("*").alias("n"))


@query(_digest_sql(0))
def digest_0mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir, 0)


@query(_digest_sql(2))
def digest_2mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir, 2)


@query(f"WITH f AS (SELECT protein_id, regexp_replace(seq, '^M', '') AS seq FROM {PROTEINS}) SELECT protein_id, seq, false AS is_decoy FROM f UNION ALL SELECT 'Rev_' || protein_id, regexp_replace(reverse(seq), '^M', ''), true FROM f")
def decoy_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_decoys(proteins(spark, sf_dir))


@query(f"SELECT protein_id, CAST(length(seq) AS INTEGER) AS residues, CAST(greatest(len(pieces) - 1, 0) AS INTEGER) AS missed FROM {_CUT} JOIN {PROTEINS} USING (protein_id)")
def missed_cleavages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins(spark, sf_dir).select("protein_id", F.length("seq").alias("residues"), digest.missed_cleavages(F.col("seq"), AFTER, BEFORE).alias("missed"))


_SHORT = f"(SELECT DISTINCT peptide FROM ({_digest_sql(0)}))"


@query(f"SELECT peptide, CAST(i AS INTEGER) AS position, peptide[1:i] || '~' || peptide[i + 1:] AS modified FROM (SELECT peptide, unnest(range(1, length(peptide) + 1)) AS i FROM {_SHORT}) WHERE peptide[i] = 'M'")
def ptm_single_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    peptides = digest.digest(proteins(spark, sf_dir), AFTER, BEFORE, 0, 7, 30, places=False).select("peptide").distinct()
    return digest.single_modifications(peptides, "~", "M").select("peptide", "position", "modified")


@query("SELECT CAST(p_partkey AS DOUBLE) AS n, round(lgamma(p_partkey + 1), 5) AS ln_factorial FROM part")
def ln_factorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("double").alias("n"), F.round(chemistry.ln_factorial(F.col("p_partkey")), 5).alias("ln_factorial"))


@query("SELECT p_partkey, round(power(0.98930, p_size % 7), 5) AS p0, round(CASE WHEN p_size % 7 >= 1 THEN (p_size % 7) * 0.01070 * power(0.98930, p_size % 7 - 1) ELSE 0 END, 5) AS p1 FROM part")
def isotope_convolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two isotope peaks of small carbon counts, by repeated convolution."""
    carbon = (np.array([12.0, 13.003355]), np.array([0.98930, 0.01070]))
    known = [np.pad(chemistry.multiply(carbon, n)[1] * 1.0, (0, 2))[:2] for n in range(7)]
    first, second = (F.array(*(F.lit(float(k[i])) for k in known)) for i in (0, 1))
    at = (F.col("p_size") % 7 + 1).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.element_at(first, at), 5).alias("p0"), F.round(F.element_at(second, at), 5).alias("p1"))


@query("SELECT s_suppkey % 4 AS part, CAST(count(*) AS BIGINT) AS n, min(s_suppkey) AS first FROM supplier GROUP BY 1")
def db_split_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 4).alias("part")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))


@query("SELECT CAST(i AS INTEGER) AS level, CASE WHEN i = 1 THEN 1.07 ELSE i END / 100.0 AS heavy, 'C13_' || CASE WHEN i = 1 THEN 1070 ELSE i * 1000 END || 'Pct' AS search_name FROM unnest(range(0, 101)) AS u(i)")
def pct_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.enrichment_levels(spark).select("level", "heavy", "search_name")


_FORMS = {"~": "M", "!": "NQ"}


@query(f"""WITH RECURSIVE sites AS MATERIALIZED (SELECT peptide, i AS pos, CASE WHEN peptide[i] = 'M' THEN '~' ELSE '!' END AS symbol FROM (SELECT DISTINCT peptide FROM ({_digest_sql(0).replace('BETWEEN 7 AND 30', 'BETWEEN 7 AND 60')})), unnest(range(1, length(peptide) + 1)) AS u(i) WHERE peptide[i] IN ('M', 'N', 'Q')),
    forms(peptide, modified, pos, n) AS (SELECT peptide, peptide[:pos] || symbol || peptide[pos + 1:], pos, 1 FROM sites UNION ALL SELECT f.peptide, modified[:s.pos + n] || symbol || modified[s.pos + n + 1:], s.pos, n + 1 FROM forms f JOIN sites s ON s.peptide = f.peptide AND s.pos > f.pos WHERE n < 2)
    SELECT peptide, modified, CAST(n AS INTEGER) AS n_modifications FROM forms""")
def ptm_combinatorics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All peptides of 7 to 60 residues with one or two modifications."""
    peptides = digest.digest(proteins(spark, sf_dir), AFTER, BEFORE, 0, 7, 60, places=False).select("peptide").distinct()
    return digest.modify(peptides, _FORMS, 2)


@query()
def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    peptides = digest.digest(proteins(spark, sf_dir), AFTER, BEFORE, 0, 7, 8, places=False).select("peptide").distinct()
    return digest.substitute(peptides, AFTER, BEFORE, 0)
