"""Data sources of wide matrices and ARFF tables, appends that may run again, database tables."""

import glob
import uuid

import pytest
from pyspark.sql import functions as F

from matrixmill.sources import matrix as SRC
from matrixmill.sources import wide as W


@pytest.fixture(scope="module")
def src(spark):
    W.register(spark)
    return spark


def cells_of(df):
    return sorted((r.feature, r["sample"], r.pos, r.value) for r in df.collect())


@pytest.mark.parametrize("split", [1, 7, 40, 1 << 20])
def test_each_line_is_read_once_at_any_split(src, tmp_path, split):
    head = "#1.2\n2\t2\nid\tName\tDescription\tA-1\tB-2\n"
    (tmp_path / "1.gct").write_text(head + "id\tn1\tgeneA\t0\t1.5\n\n1\tn2\tgeneB\tNA\t3\n2\tn\xe4\tgene\xe9\t1e3\t-4")
    (tmp_path / "2.gct").write_text(head + "7\tn7\tgeneC\t\t5\n")
    (tmp_path / "_SUCCESS").write_text("")
    read = src.read.format("wide_matrix").option("splitBytes", split)
    got = read.option("layout", "long").load(str(tmp_path))
    want = [("geneA", 0.0, 1.5), ("geneB", None, 3.0), ("geneC", None, 5.0), ("gene\xe9", 1000.0, -4.0)]
    got = got.withColumnRenamed("Description", "feature")
    key = lambda r: (r.feature, r.pos)
    assert [(r.feature, r["sample"], r.value) for r in sorted(got.collect(), key=key)] == [(f, s, v) for f, a, b in want for s, v in (("A-1", a), ("B-2", b))]
    wide = read.option("layout", "wide").load(str(tmp_path))
    assert wide.columns == ["row_pos", "id", "Name", "Description", "A-1", "B-2"]
    assert sorted((r.Description, r["A-1"], r["B-2"]) for r in wide.fillna(-1.0).collect()) == sorted((f, -1.0 if a is None else a, b) for f, a, b in want)
    first = [r.Description for r in wide.filter("id <> '7'").orderBy("row_pos").collect()]
    assert first == ["geneA", "geneB", "gene\xe9"]


def test_wide_rows_of_another_width(src, tmp_path):
    (tmp_path / "r.gct").write_text("#\n#\nid\tn\tfeature\tA\tA\n0\tx\ta\t1\t2\n1\tx\tb\t3\n2\tx\tc\t4\t5\n")
    read = src.read.format("wide_matrix").option("layout", "long")
    with pytest.raises(Exception, match="[Ee]xpected"):
        read.load(str(tmp_path)).collect()
    # samples may share a name
    assert cells_of(read.option("ragged", "drop").load(str(tmp_path))) == [("a", "A", 0, 1.0), ("a", "A", 1, 2.0), ("c", "A", 0, 4.0), ("c", "A", 1, 5.0)]
    with pytest.raises(Exception, match="ragged"):
        read.option("ragged", "other").load(str(tmp_path)).collect()


def test_wide_round_trip_and_batches_again(src, tmp_path):
    path = str(tmp_path / "m")
    rows = src.range(500).select(F.col("id").cast("string").alias("id"), F.lit("n").alias("name"), F.concat(F.lit("g"), "id").alias("feature"), (F.col("id") / 7).alias("s1"), F.when(F.col("id") % 3 > 0, F.col("id") * 1e-9).alias("s2"))
    write = lambda df, batch, mode="append": df.repartition(3).write.format("wide_matrix").option("batch", batch).mode(mode).save(path)
    write(rows.filter("id < 300"), "a")
    write(rows.filter("id >= 300"), "b")
    write(rows.filter("id >= 300").repartition(7), "b")
    got = src.read.format("wide_matrix").load(path).drop("row_pos")
    assert got.count() == 500 and got.exceptAll(rows).isEmpty() and rows.exceptAll(got).isEmpty()
    assert not glob.glob(path + "/_staging*")
    write(rows.filter("id < 10"), "c", "overwrite")
    assert src.read.format("wide_matrix").load(path).count() == 10
    with pytest.raises(Exception, match="separator"):
        write(rows.withColumn("name", F.lit("a\tb")), "d")
    assert src.read.format("wide_matrix").load(path).count() == 10 and not glob.glob(path + "/_staging*")


def test_arff(src, tmp_path):
    p = tmp_path / "t.arff"
    p.write_text("% note\n@RELATION r\n\n@attribute 'long name' numeric\n@attribute size INTEGER\n@attribute kind {a, 'b c'}\n@ATTRIBUTE class {x,y}\n@DATA\n% none\n1.5,2,a,x\n?, 3, 'b c', y\n\n-2e3,?,?,x\n")
    for split in (1, 30, 1 << 20):
        t = src.read.format("arff").option("splitBytes", split).load(str(p))
        assert dict(t.dtypes) == {"row_pos": "bigint", "long name": "double", "size": "double", "kind": "string", "class": "string"}
        assert [tuple(r)[1:] for r in t.orderBy("row_pos").collect()] == [(1.5, 2.0, "a", "x"), (None, 3.0, "b c", "y"), (-2000.0, None, None, "x")]
    table, targets = SRC.read_dataset(src, str(p))
    assert table.count() == 3 and sorted(r["class"] for r in targets.collect()) == ["x", "x", "y"]
    assert table.join(targets.withColumnRenamed("class", "own"), "row_id").filter(F.col("class") != F.col("own")).isEmpty()


def test_dataset_of_text(src, tmp_path):
    (tmp_path / "d.csv").write_text("name;x;target\nr1;1,5;0\nr2;2,5;1\n")
    table, targets = SRC.read_dataset(src, str(tmp_path / "d.csv"))
    assert table.columns == ["row_id", "x", "target"]
    assert sorted(map(tuple, targets.collect())) == [("r1", 0), ("r2", 1)]
    (tmp_path / "e.csv").write_text("x,y\n1,2\n1,3\n")
    table, targets = SRC.read_dataset(src, str(tmp_path / "e.csv"))
    assert targets is None and table.select("row_id").distinct().count() == 2


def test_append_again_writes_no_row_twice(src, tmp_path):
    path = str(tmp_path / "t")
    rows = src.range(100).withColumn("v", F.col("id") * 2)
    SRC.append_table(rows.filter("id < 40"), path, "one")
    SRC.append_table(rows.filter("id >= 40"), path, "two")
    SRC.append_table(rows.filter("id < 40").repartition(5), path, "one")
    got = src.read.parquet(path)
    assert got.count() == 100 and got.select("id").distinct().count() == 100
    with pytest.raises(ValueError):
        SRC.append_table(rows.withColumn("v", F.lit("text")), path, "three")


def test_jdbc_ranges_and_append_again(src):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = src.range(1000).select("id", (F.col("id") % 10).cast("int").alias("g"))
    SRC.append_jdbc(rows.filter("id < 0"), url, "numbers", ["id"])
    assert SRC.read_jdbc(src, url, "numbers", "id", 4).count() == 0
    SRC.append_jdbc(rows.filter("id < 600"), url, "numbers", ["id"], chunk=100)
    SRC.append_jdbc(rows, url, "numbers", ["id"], chunk=100)
    got = SRC.read_jdbc(src, url, "numbers", "id", 4)
    assert got.rdd.getNumPartitions() == 4
    assert sorted((r[0], r[1]) for r in got.collect()) == [(i, i % 10) for i in range(1000)]
