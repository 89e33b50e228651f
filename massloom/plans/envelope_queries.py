"""Queries over isotope envelopes, isotope distributions and enrichment levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.chemistry import NEUTRON
from massloom.operators import digest, envelopes, isotopes, sweep
from massloom.plans.spectrum_queries import AFTER, BEFORE
from massloom.plans.tables import PEAKS, Registry, proteins, scans, table

REGISTRY = Registry()
query = REGISTRY.add

#: Envelopes of the ions looked up in each spectrum: a flat one, a symmetric one and a single peak, by the ion's number modulo 3.
_SHARES = ((0.1, 0.6, 0.2, 0.1), (0.05, 0.25, 0.4, 0.25, 0.05), (1.0,))
_IONS, _TOLERANCE = 16, 12.0

_ENVELOPE_SQL = f"""
WITH shares AS (SELECT * FROM (VALUES {", ".join(f"({k}, {list(s)})" for k, s in enumerate(_SHARES))}) AS t(kind, share)),
peaks AS MATERIALIZED (SELECT scan, place, mz, inten, place % 3 AS charge FROM {PEAKS}),
ions AS MATERIALIZED (
    SELECT vec_id AS scan, i AS ion, 1 + i % 2 AS charge, j - 1 AS place, 118.3 + 37.0 * i + 10.4 * (j - 1) AS mz, share[j] / list_max(share) AS relative,
        list_position(share, list_max(share)) - 1 AS top, len(share) AS n,
        CASE WHEN len(share) > 1 THEN list_position(list_transform(share, lambda s, k: CASE WHEN k = list_position(share, list_max(share)) THEN 0 ELSE s END), list_max(list_transform(share, lambda s, k: CASE WHEN k = list_position(share, list_max(share)) THEN 0 ELSE s END))) - 1 END AS second
    FROM embeddings, unnest(range(0, {_IONS})) AS u(i) JOIN shares ON kind = i % 3, unnest(range(1, len(share) + 1)) AS v(j)
), tallest AS MATERIALIZED (
    SELECT scan, ion, p.mz - i.mz AS shift, p.inten AS height, p.charge AS seen_charge, p.place AS peak FROM ions i JOIN peaks p USING (scan)
    WHERE i.place = i.top AND p.mz BETWEEN i.mz - {_TOLERANCE} AND i.mz + {_TOLERANCE} QUALIFY row_number() OVER (PARTITION BY scan, ion ORDER BY p.inten DESC, p.mz) = 1
), near AS MATERIALIZED (
    SELECT i.scan, i.ion, i.place, i.top, i.relative, i.mz, p.mz AS peak_mz, p.inten / t.height AS ratio
    FROM ions i JOIN tallest t USING (scan, ion) LEFT JOIN peaks p ON p.scan = i.scan AND p.mz BETWEEN i.mz + t.shift - {_TOLERANCE / 2} AND i.mz + t.shift + {_TOLERANCE / 2} WHERE i.place <> i.top
), reached AS (
    SELECT DISTINCT scan, ion, place, bool_and(there) OVER (PARTITION BY scan, ion, sign(place - top) ORDER BY abs(place - top)) AS there
    FROM (SELECT scan, ion, place, top, count(peak_mz) > 0 AS there FROM near GROUP BY ALL)
), isotopes AS (
    SELECT scan, ion, place, relative, peak_mz - mz AS error FROM near JOIN reached USING (scan, ion, place)
    WHERE there AND ratio > relative * 0.5 AND ratio < least(relative * 5, 1.5) QUALIFY row_number() OVER (PARTITION BY scan, ion, place ORDER BY peak_mz) = 1
    UNION ALL SELECT scan, ion, place, relative, shift FROM ions JOIN tallest USING (scan, ion) WHERE place = top
), found AS (
    SELECT scan, ion, sum(error * relative) / sum(relative) AS error, count(*) AS n_peaks, list(place) AS places FROM isotopes GROUP BY scan, ion
), judged AS (
    SELECT f.scan, f.ion, t.peak, f.error, f.n_peaks, (CASE WHEN s.n = 1 THEN 1.0 WHEN list_contains(f.places, s.second) THEN 2.0 WHEN r.relative > 0.5 THEN 0.5 ELSE 1.0 END) / (CASE WHEN t.seen_charge NOT IN (0, s.charge) THEN 2 ELSE 1 END) AS weight
    FROM found f JOIN tallest t USING (scan, ion) JOIN ions s ON s.scan = f.scan AND s.ion = f.ion AND s.place = s.top LEFT JOIN ions r ON r.scan = f.scan AND r.ion = f.ion AND r.place = s.second
)
SELECT scan, ion, peak, n_peaks, weight, round(error, 6) AS error, round(error - avg(error) OVER (PARTITION BY scan), 6) AS recentred FROM judged
"""


@query(_ENVELOPE_SQL)
def envelope_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spectrum's ions by their isotope envelopes, with errors before and after the spectrum's own shift is taken out."""
    shares = F.array(*(F.array(*map(F.lit, s)) for s in _SHARES))
    numbers = F.sequence(F.lit(0), F.lit(_IONS - 1))
    ions = F.transform(numbers, lambda i: F.struct((1 + i % 2).alias("charge"), F.transform(F.get(shares, i % 3), lambda s, j: 118.3 + 37.0 * i + 10.4 * j).alias("mz"), F.get(shares, i % 3).alias("share")))
    peaks = F.transform("peaks", lambda p, k: F.struct(p["mz"], p["inten"], (k % 3).alias("charge")))
    rows = scans(spark, sf_dir).select("scan", peaks.alias("peaks"), ions.alias("ions"))
    found = envelopes.match_envelopes(rows, _TOLERANCE).select("scan", F.explode(F.arrays_zip("found", envelopes.recentred(F.col("found")).alias("recentred"))).alias("f"))
    long = lambda c: F.col(f"f.found.{c}").cast("long")
    return found.select("scan", long("ion").alias("ion"), long("place").alias("peak"), long("n_peaks").alias("n_peaks"), "f.found.weight", F.round("f.found.error", 6).alias("error"), F.round("f.recentred", 6).alias("recentred"))


_SWEEP_TOLERANCE = 0.6  # above half a neutron: a level's windows are one


@query(f"""WITH levels AS (SELECT i - 1 AS level, ({list(sweep.CARBON_CENTRES)})[i] AS c, ({list(sweep.CARBON_WIDTHS)})[i] AS w FROM unnest(range(1, 102)) AS u(i)),
    windows AS MATERIALIZED (SELECT p_partkey, level, p_partkey * 20.0 + (c - w) * {NEUTRON} - {_SWEEP_TOLERANCE} AS low, p_partkey * 20.0 + (c + w) * {NEUTRON} + {_SWEEP_TOLERANCE} AS high FROM part, levels)
    SELECT CAST(level AS INTEGER) AS level, p_partkey, o_orderkey, o_totalprice FROM orders JOIN windows ON o_totalprice >= low AND o_totalprice <= high""")
def sweep_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All peptides at all enrichment levels with the precursors in the windows of each level."""
    precursors = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    peptides = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 20.0).alias("mass"))
    found = sweep.level_join(precursors, peptides, "o_totalprice", "mass", sweep.level_windows(tolerance=_SWEEP_TOLERANCE))
    return found.select("level", "p_partkey", "o_orderkey", "o_totalprice")


@query()
def peptide_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotope distributions of all peptides of 7 to 60 residues, without label and with half of the carbon labelled."""
    peptides = digest.digest(proteins(spark, sf_dir), AFTER, BEFORE, 0, 7, 60, places=False).select("peptide").distinct()
    plain, labelled = isotopes.ISOTOPES, isotopes.enriched("C", 0.5)
    wanted = {"lowest_mass": (plain, "lowest_mass"), "average_mass": (plain, "average_mass"), "share": (plain, "share"), "labelled_mass": (labelled, "most_abundant_mass"), "labelled_peaks": (labelled, "peaks")}
    rounded = {"lowest_mass": 5, "average_mass": 4, "labelled_mass": 4}
    found = isotopes.peptide_columns(peptides, wanted)
    return found.select("peptide", *(F.round(c, rounded[c]).alias(c) if c in rounded else F.transform(c, lambda s: F.round(s, 6)).alias(c) if c == "share" else c for c in wanted))
