import duckdb

from peakforge.plans import catalog
from peakforge.plans import fixtures as X


def test_only_incomplete_spectra_go(spark, tmp_path):
    ids = [i for i in range(32) if i != 11]  # spectrum 1 lacks a step; 3, the last, is complete
    spark.createDataFrame([(i, [float((i * 31 + k * 17) % 13) for k in range(64)]) for i in ids], "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = X.view(spark, str(tmp_path), X.logits(False), "embeddings")
    assert {r.spectrum_id for r in rows.select("spectrum_id").distinct().collect()} == {0, 2, 3}
    assert {r.spectrum_id for r in catalog.QUERIES["greedy_decode_whole"](spark, str(tmp_path)).collect()} == {0, 2, 3}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(X.logits(True)).fetchall()) == sorted(map(tuple, rows.collect()))


def test_accuracy_covers_all_places(spark):
    got = {r.direction: r for r in catalog.QUERIES["teacher_accuracy_whole"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 2 and all(r.n == 62 and abs(r.accuracy - 21 / 62) < 1e-6 for r in got.values())


def test_records_have_all_peaks(spark):
    rows = catalog.QUERIES["mgf_text_peaks"](spark, "/root/testdata/sf0.001").collect()
    assert sum(len(r.value.split("\n")) - 5 for r in rows) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
