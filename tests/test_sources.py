"""The MGF source, the stores and FASTA on files with every kind of damage."""

import json
import time

import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull

from peakforge.sources import files, mgf_source, ragged


def record(title, *, mz="500.25", charge="2+", peaks=("100.0 5.0", "200.5 7.5"), end=True, extra=()):
    head = ["BEGIN IONS", f"TITLE={title}", *([f"PEPMASS={mz}"] if mz else []), *([f"CHARGE={charge}"] if charge else []), *extra]
    return "\n".join([*head, *peaks, *(["END IONS"] if end else [])]) + "\n\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("mgf")
    good = [record(f"s{i}", mz=f"{400 + i}.5 12", charge=f"{i % 4 + 1}+", extra=[f"SEQ=PEP{i}"]) for i in range(40)]
    odd = [
        record("END IONS"), record("BEGIN IONS inside"), record("cut", end=False), record("no mass", mz=None), record("odd mass", mz="abc"), record("bad peak", peaks=("1 2", "3 x")), record("no peaks", peaks=()),
        record("no charge", charge=None), record("charge 12", charge="12+"), "# a comment\n\n", record("bad and charge 12", charge="12+", peaks=("x y",)), record("last", end=False),
    ]
    (path / "a.mgf").write_text("".join(good[:20]) + "".join(odd))
    (path / "b.mgf").write_bytes(("CHARGE=3+\n\n" + record("by default", charge=None) + "".join(good[20:])).replace("\n", "\r\n").encode())
    (path / "deep").mkdir()
    (path / "deep" / "c.mgf").write_text(record("deep"))
    (path / "deep" / "c.txt").write_text(record("no mgf"))
    return path


def rows(df):
    return sorted((r.source_path.rpartition("/")[2], r.title, r.precursor_mz, r.charge, r.annotation, r.status, None if r.peaks is None else [tuple(p) for p in r.peaks]) for r in df.collect())


def test_every_cut_into_ranges_reads_the_same(spark, folder):
    want = rows(mgf_source.scan_mgf(spark, str(folder), skipped=True))
    assert len(want) == 20 + 11 + 21
    by = {w[1]: w for w in want}
    assert {t: w[5] for t, w in by.items() if t[0] != "s"} == {
        "END IONS": "ok", "BEGIN IONS inside": "ok", "cut": "damaged", "no mass": "damaged", "odd mass": "damaged", "bad peak": "damaged", "no peaks": "ok", "no charge": "charge",
        "charge 12": "charge", "bad and charge 12": "charge", "last": "damaged", "by default": "ok",
    }
    assert by["s7"][2:] == (407.5, 4, "PEP7", "ok", [(100.0, 5.0), (200.5, 7.5)]) and by["no peaks"][6] == [] and by["by default"][3] == 3
    for size in (64, 97, 333, 1000):
        assert rows(mgf_source.scan_mgf(spark, str(folder), skipped=True, partition_bytes=size)) == want
    sound = rows(mgf_source.scan_mgf(spark, str(folder), partition_bytes=200))
    assert sound == [w for w in want if w[5] == "ok"]
    counts = {r.source_path.rpartition("/")[2]: tuple(r)[1:] for r in mgf_source.skip_counts(mgf_source.scan_mgf(spark, str(folder), skipped=True)).collect()}
    assert counts == {"a.mgf": (23, 5, 3, 44), "b.mgf": (21, 0, 0, 42)}


def test_levels_folders_and_orders(spark, folder):
    one = mgf_source.scan_mgf(spark, str(folder), ms_level=1)
    assert {(r.precursor_mz, r.charge) for r in one.collect()} == {(None, 0)} and one.where("title = 'no mass'").count() == 1
    assert mgf_source.scan_mgf(spark, str(folder), recursive=True).where("title in ('deep', 'no mgf')").count() == 1
    assert mgf_source.scan_mgf(spark, str(folder / "deep")).count() == 2
    assert mgf_source.scan_mgf(spark, str(folder / "nothing")).count() == 0
    placed = mgf_source.scan_mgf(spark, str(folder / "a.mgf"), skipped=True, partition_bytes=300).orderBy("part", "place").collect()
    assert [r.title for r in placed[:20]] == [f"s{i}" for i in range(20)] and placed[-1].title == "last"


def test_filters_are_decided_in_the_source(spark, folder):
    df = mgf_source.scan_mgf(spark, str(folder), skipped=True).where("charge = 2 and precursor_mz > 410 and title is not null")
    assert "Filter" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.title for r in df.collect()) == sorted([f"s{i}" for i in range(40) if i % 4 == 1 and i >= 10] + ["END IONS", "BEGIN IONS inside", "cut", "bad peak", "no peaks", "last"])
    reader = mgf_source.MgfReader({"path": str(folder), "validcharge": json.dumps([1, 2, 3, 4])})
    assert list(reader.pushFilters([EqualTo(("charge",), 1), GreaterThan(("status",), "a"), IsNotNull(("title",))])) == [GreaterThan(("status",), "a")]
    kept = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert {r["title"] for r in kept} == {f"s{i}" for i in range(0, 40, 4)}


def read_rows(df):
    """Rows that the scans of a plan have put out."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if "Scan parquet" in p.nodeName():
            total += p.metrics().get("numOutputRows").get().value()
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def spectra(spark):
    peak = F.transform(F.sequence(F.lit(1), (F.col("id") % 90).cast("int")), lambda k: F.struct((F.col("id") + k / 100).alias("mz"), (F.rand(3) + k).alias("intensity")))
    peaks = F.when(F.col("id") % 90 == 0, F.array().cast("array<struct<mz: double, intensity: double>>")).when(F.col("id") != 5, peak)
    return spark.range(900).select(F.col("id").alias("spectrum_id"), peaks.alias("peaks"), (F.col("id") % 6).cast("int").alias("charge"), (300 + F.col("id") * 7919 % 1000).cast("double").alias("precursor_mz"))


def test_flat_store(spark, spectra, tmp_path, monkeypatch):
    path = str(tmp_path / "flat")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    ragged.write_ragged(spectra, path, 8 << 10)
    index = {r.spectrum_id: (r.start, r.n_peaks) for r in spark.read.parquet(f"{path}/index").collect()}
    at = 0
    for i in range(900):
        n = 0 if i == 5 else i % 90
        assert index[i] == (at, n)
        at += n
    ids = [3, 5, 89, 90, 451, 899, 5000]
    want = sorted((r.spectrum_id, k, *p) for r in spectra.where(F.col("spectrum_id").isin(ids)).collect() for k, p in enumerate(r.peaks or []))
    asked = spark.createDataFrame([(i,) for i in [*ids, 3, None]], "spectrum_id long")
    assert sorted(map(tuple, ragged.lookup(spark, path, asked).collect())) == want
    few = ragged.slices(spark, path, [451])
    assert read_rows(few) < at / 4  # row groups that can't hold the slice are passed over
    monkeypatch.setattr(ragged, "RANGES", 2)
    assert sorted(map(tuple, ragged.lookup(spark, path, asked).collect())) == want
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_clustered_store(spark, spectra, tmp_path):
    path = str(tmp_path / "store")
    files.write_store(spectra, path, 8 << 10)
    df = files.read_store(spark, path, (2,), (500.0, 600.0))
    want = {r.spectrum_id for r in spectra.collect() if r.charge == 2 and 500 <= r.precursor_mz <= 600}
    assert {r.spectrum_id for r in df.collect()} == want and read_rows(df) < 450
    assert files.read_store(spark, path).count() == 900


def test_fasta(spark, tmp_path):
    want = [("a > b", "MKV"), ("x", "P" * 150), ("empty", ""), (">", "AC")]
    (tmp_path / "x.fasta").write_text("\n>a > b\nMK\nV\n\n>x \n" + "P" * 70 + "\r\n" + "P" * 80 + "\n>empty\n>>\nA C")
    got = sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "x.fasta")).collect()))
    assert got == sorted([*want[:3], ("", "AC")])  # a > at the head of a name is lost
    files.write_fasta(spark.createDataFrame(want[:3], "name string, sequence string"), str(tmp_path / "out"), 60)
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "out")).collect())) == sorted(want[:3])
    assert max(len(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()) == 60


def test_text_scan_agrees_with_the_source(spark, folder):
    """The scan by Spark's text reader, for stores that only Spark can open, on sound records."""
    from peakforge.sources import mgf

    key = lambda df: sorted((r.title, r.precursor_mz, r.charge, r.annotation, [tuple(p) for p in r.peaks]) for r in df.where("title like 's%' or title = 'END IONS'").collect())
    got, want = key(mgf.read_mgf(spark, str(folder))), key(mgf_source.scan_mgf(spark, str(folder)))
    assert got == want and len(got) == 41


def test_lines_cost_their_own_bytes(tmp_path):
    """Reading a line must not copy the rest of the buffer: with a buffer of 4 MB, 200,000 short lines took over 10 s."""
    data = b"".join(b"%d.25 1.5\n" % i for i in range(200_000)) + b"no end"
    (tmp_path / "x").write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as f:
        began = time.thread_time()
        assert list(mgf_source._Lines(f, 4 << 20)) == data.splitlines(keepends=True)
        assert time.thread_time() - began < 2
    for size in (1, 7, 64):
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as f:
            some = mgf_source._Lines(f, size)
            some.seek(len(data) - 100)
            assert list(some) == data[-100:].splitlines(keepends=True)
