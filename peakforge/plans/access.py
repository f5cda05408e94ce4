"""Queries over files and batches: the MGF source, the flat and the clustered store, FASTA, shuffled and padded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.functions import peptide as P
from peakforge.operators import batches, spectra
from peakforge.plans import fixtures as X
from peakforge.plans.catalog import _peaks, _peptides, _precursors, _tokens_sql, query
from peakforge.sources import mgf, mgf_source, ragged
from peakforge.sources.scratch import scratch


def _whole_spectra(spark, d) -> DataFrame:
    """All precursors, with or without peaks."""
    return _precursors(spark, d).join(spectra.collect_peaks(_peaks(spark, d)), "spectrum_id", "left")


def _damaged_mgf(spark, d) -> str:
    """A folder of MGF text in which some titles hold END IONS, some records lack their end or PEPMASS, and some have a bad peak."""
    k = F.col("spectrum_id") % 10
    title = F.concat(F.when(k == 1, "END IONS ").otherwise("s"), F.col("spectrum_id").cast("string"))
    text = mgf.mgf_text(_whole_spectra(spark, d).withColumn("title", title))
    v = F.col("value")
    v = F.when(k == 3, F.regexp_replace(v, "\nEND IONS$", "")).when(k == 7, F.regexp_replace(v, "END IONS$", "12.5 x\nEND IONS")).when(k == 9, F.regexp_replace(v, r"PEPMASS=.*\n", "")).otherwise(v)
    path = f"{scratch(spark)}/mgf"
    text.select(v).write.option("lineSep", "\r\n\n").text(path)
    return path


#: What the reader makes of _damaged_mgf, from the tables.
_RECORDS = f"""SELECT q.spectrum_id, CASE WHEN q.spectrum_id % 10 = 1 THEN 'END IONS ' ELSE 's' END || q.spectrum_id AS title, CASE WHEN q.spectrum_id % 10 <> 9 THEN precursor_mz END AS precursor_mz, CAST(charge AS SMALLINT) AS charge,
  CASE WHEN q.spectrum_id % 10 IN (3, 9) THEN 'damaged' WHEN charge NOT BETWEEN 1 AND 10 THEN 'charge' WHEN q.spectrum_id % 10 = 7 THEN 'damaged' ELSE 'ok' END AS status, coalesce(n, 0) AS n
FROM ({X.PRECURSORS}) q LEFT JOIN (SELECT spectrum_id, count(*) AS n, FROM ({X.PEAKS}) p GROUP BY spectrum_id) c USING (spectrum_id)"""


@query(f"SELECT title, round(precursor_mz, 4) AS precursor_mz, charge, status, CAST(CASE WHEN status = 'ok' THEN n END AS BIGINT) AS n_peaks FROM ({_RECORDS}) r")
def mgf_source_records(spark, d):
    rows = mgf_source.scan_mgf(spark, _damaged_mgf(spark, d), skipped=True, partition_bytes=1 << 20)
    return rows.select("title", F.round("precursor_mz", 4).alias("precursor_mz"), "charge", "status", F.when(F.col("peaks").isNotNull(), F.size("peaks")).cast("long").alias("n_peaks"))


@query(f"SELECT CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS n_spectra, CAST(count(*) FILTER (status = 'damaged') AS BIGINT) AS n_damaged, CAST(count(*) FILTER (status = 'charge') AS BIGINT) AS n_charge, CAST(sum(n) FILTER (status = 'ok') AS BIGINT) AS n_peaks FROM ({_RECORDS}) r")
def mgf_skip_counts(spark, d):
    """Skips counted per file, then summed, as Spark names the files it writes at random."""
    each = mgf_source.skip_counts(mgf_source.scan_mgf(spark, _damaged_mgf(spark, d), skipped=True, partition_bytes=1 << 20))
    return each.agg(*[F.sum(c).alias(c) for c in each.columns[1:]])


@query(f"SELECT title, charge, CAST(n AS BIGINT) AS n_peaks FROM ({_RECORDS}) r WHERE status = 'ok' AND charge IN (2, 3) AND precursor_mz < 900")
def mgf_pushed_scan(spark, d):
    """Charge and m/z are decided in the source, from headers, before peaks are parsed."""
    rows = mgf_source.scan_mgf(spark, _damaged_mgf(spark, d)).where("charge in (2, 3) and precursor_mz < 900")
    return rows.select("title", "charge", F.size("peaks").cast("long").alias("n_peaks"))


@query(f"SELECT title, CAST(n AS BIGINT) AS n_peaks FROM ({_RECORDS}) r WHERE spectrum_id % 10 NOT IN (3, 7)")
def mgf_level_one(spark, d):
    """At MS level 1 a record needs no precursor and any charge will do."""
    return mgf_source.scan_mgf(spark, _damaged_mgf(spark, d), ms_level=1).select("title", F.size("peaks").cast("long").alias("n_peaks"))


@query(f"""SELECT spectrum_id, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, intensity) - 1 AS pos, round(mz, 6) AS mz, round(intensity, 6) AS intensity
FROM ({X.PEAKS}) p JOIN ({X.PRECURSORS}) q USING (spectrum_id) WHERE charge = 7""")
def peaks_lookup(spark, d):
    """Spectra of one charge, looked up in the flat store by the index."""
    path = f"{scratch(spark)}/flat"
    ragged.write_ragged(_whole_spectra(spark, d).select("spectrum_id", "peaks"), path, 64 << 10)
    found = ragged.lookup(spark, path, _precursors(spark, d).where("charge = 7"))
    return found.withColumns({c: F.round(c, 6) for c in ("mz", "intensity")})


@query(f"SELECT spectrum_id, row_number() OVER (ORDER BY md5('11:' || spectrum_id), spectrum_id) - 1 AS row, (row_number() OVER (ORDER BY md5('11:' || spectrum_id), spectrum_id) - 1) // 32 AS batch FROM ({X.peptides(True)}) f")
def shuffled_batches(spark, d):
    return batches.shuffled_batches(_peptides(spark, d).select("spectrum_id"), ["spectrum_id"], 32, 11)


@query(f"""WITH t AS ({_tokens_sql("ASC")}), l AS (SELECT spectrum_id, CAST(string_split(tokens, ',') AS INT[]) AS v FROM t),
b AS (SELECT *, (row_number() OVER (ORDER BY len(v) // 4, md5('5:' || spectrum_id), spectrum_id) - 1) // 32 AS batch FROM l), w AS (SELECT *, max(len(v)) OVER (PARTITION BY batch) AS width FROM b)
SELECT spectrum_id, batch, CAST(width AS INT) AS width, array_to_string(v || list_transform(range(0, width - len(v)), lambda i: 0), ',') AS tokens,
  array_to_string(list_transform(range(0, width), lambda i: i < len(v)), ',') AS mask FROM w""")
def padded_batches(spark, d):
    """Token ids in batches of similar length, padded to the longest of each batch."""
    tokens = _peptides(spark, d).select("spectrum_id", P.tokenize(F.col("peptide")).alias("tokens"))
    rows = batches.padded(batches.shuffled_batches(tokens, ["spectrum_id"], 32, 5, [F.floor(F.size("tokens") / 4)]), "tokens")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rows.select("spectrum_id", "batch", "width", text("tokens"), text("mask"))


@query(f"""WITH p AS (SELECT spectrum_id, count(*) AS n FROM ({X.PEAKS}) x GROUP BY spectrum_id), b AS (SELECT *, (row_number() OVER (ORDER BY md5('3:' || spectrum_id), spectrum_id) - 1) // 16 AS batch FROM p)
SELECT batch, count(*) AS n_spectra, CAST(sum(n) AS BIGINT) AS n_true, CAST(max(n) AS INT) AS width, CAST(max(n) * count(*) - sum(n) AS BIGINT) AS n_padding FROM b GROUP BY batch""")
def padded_spectra(spark, d):
    """Peaks in rectangles: zero pairs as padding, masked where both are 0."""
    rows = spectra.collect_peaks(_peaks(spark, d))
    pad = F.struct(F.lit(0.0).alias("mz"), F.lit(0.0).alias("intensity"))
    wide = batches.padded(batches.shuffled_batches(rows, ["spectrum_id"], 16, 3), "peaks", pad=pad)
    true = F.size(F.filter("mask", lambda m: m))
    return wide.groupBy("batch").agg(F.count("*").alias("n_spectra"), F.sum(true).alias("n_true"), F.max(F.size("peaks")).alias("width"), F.sum(F.size("mask") - true).alias("n_padding"))
