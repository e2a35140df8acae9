"""Raw matrices with sidecars, against Parquet and by hand."""

import json
import math

import numpy as np
import pytest

from pluvia.sources import matrix


def test_matrices_equal_parquet_and_are_projected(spark, tmp_path, monkeypatch):
    matrix.register(spark)
    rows = spark.range(1000).selectExpr("CAST(id AS float) AS a", "IF(id % 7 = 0, NULL, id / 4) AS b", "CAST(id AS int) AS c").repartition(3)
    rows.write.format("f32matrix").mode("append").save(f"{tmp_path}/m")
    rows.selectExpr("a", "CAST(b AS float) AS b", "CAST(c AS float) AS c").write.parquet(f"file://{tmp_path}/p")
    plain = lambda df: sorted(tuple(None if v is None or math.isnan(v) else v for v in r) for r in df.collect())
    key = lambda rs: sorted(rs, key=lambda r: r[0])
    got = spark.read.format("f32matrix").load(f"{tmp_path}/m")
    assert got.columns == ["a", "b", "c"] and [f.dataType.simpleString() for f in got.schema] == ["float"] * 3
    clean = lambda df: key([tuple(None if v is None or math.isnan(v) else v for v in r) for r in df.collect()])
    assert clean(got) == clean(spark.read.parquet(f"file://{tmp_path}/p"))
    some = spark.read.format("f32matrix").option("columns", "c,a").load(f"{tmp_path}/m")
    assert some.columns == ["c", "a"] and plain(some) == [(float(i), float(i)) for i in range(1000)]
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("f32matrix").option("columns", "z").load(f"{tmp_path}/m").count()
    rows.limit(5).write.format("f32matrix").mode("overwrite").save(f"{tmp_path}/m")
    assert spark.read.format("f32matrix").load(f"{tmp_path}/m").count() == 5


def test_a_matrix_of_another_program_is_read_in_ranges(spark, tmp_path):
    matrix.register(spark)
    m = np.arange(30, dtype="<f4").reshape(10, 3)
    (tmp_path / "dump.f32").write_bytes(m.tobytes())
    (tmp_path / "dump.f32.json").write_text(json.dumps({"columns": ["x", "y", "z"], "rows": 10, "regions": ["a"]}))
    (tmp_path / "left.f32").write_bytes(b"unfinished")  # without a sidecar: not read
    got = spark.read.format("f32matrix").load(str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [tuple(map(float, r)) for r in m]
    reader = matrix.MatrixReader(str(tmp_path), ["y"])
    matrix.SPLIT, before = 4 * 3 * 4, matrix.SPLIT
    parts = reader.partitions()
    matrix.SPLIT = before
    assert [(p.first, p.rows) for p in parts] == [(0, 4), (4, 4), (8, 2)]
    assert [v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist()] == m[:, 1].tolist()
    (tmp_path / "dump.f32").write_bytes(m.tobytes()[:-4])
    with pytest.raises(Exception, match="bytes"):
        spark.read.format("f32matrix").load(str(tmp_path)).count()
