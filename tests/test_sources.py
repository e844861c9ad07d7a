import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.sources import formats as S


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    S.register(spark)


def vectors(spark, n=103, dim=5, kind="float"):
    v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.col("id") * 10 + i).cast(kind))
    return spark.range(n).select(F.col("id").alias("ordinal"), v.alias("vec"))


@pytest.mark.parametrize(("element", "kind"), [("f32", "float"), ("f64", "double"), ("f16", "float"), ("i32", "int"), ("i64", "bigint"), ("u16", "int"), ("u32", "bigint")])
def test_xvec_round_trip(spark, tmp_path, element, kind):
    df = vectors(spark, 20, kind=kind)
    df.coalesce(1).write.format("xvec").option("element", element).mode("append").save(f"{tmp_path}/v")
    got = spark.read.format("xvec").option("range", 100).load(f"{tmp_path}/v")
    assert got.schema["vec"].dataType.elementType.simpleString() == kind
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_xvec_file_made_elsewhere(spark, tmp_path):
    a = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "x.fvecs").write_bytes(b"".join(struct.pack("<i", 3) + r.tobytes() for r in a))
    got = spark.read.format("xvec").load(str(tmp_path / "x.fvecs")).where("ordinal >= 2").collect()
    assert [(r.ordinal, r.vec) for r in got] == [(2, [6.0, 7.0, 8.0]), (3, [9.0, 10.0, 11.0])]
    assert S.probe(str(tmp_path / "x.fvecs")) == "xvec"


def test_damaged_xvec(spark, tmp_path):
    (tmp_path / "x.fvecs").write_bytes(struct.pack("<i", 3) + b"\0" * 11)
    with pytest.raises(Exception, match="no whole number"):
        spark.read.format("xvec").load(str(tmp_path / "x.fvecs")).collect()


def test_vvec(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("ordinal"), F.transform(F.sequence(F.lit(0), (F.col("id") % 4).cast("int")), lambda i: i).alias("vec"))
    df.coalesce(1).write.format("vvec").option("element", "i32").mode("append").save(f"{tmp_path}/v")
    got = spark.read.format("vvec").option("range", 64).load(f"{tmp_path}/v")
    assert got.rdd.getNumPartitions() > 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_scalar_over_several_files(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("ordinal"), (F.col("id") % 200).cast("smallint").alias("value"))
    df.repartitionByRange(3, "ordinal").sortWithinPartitions("ordinal").write.format("scalar").option("element", "u8").mode("append").save(f"{tmp_path}/s")
    got = spark.read.format("scalar").option("range", 128).load(f"{tmp_path}/s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_overwrite_and_u64(spark, tmp_path):
    for top in (2**64 - 1, 2**63):
        df = spark.sql(f"SELECT 0L AS ordinal, CAST({top} AS DECIMAL(20,0)) AS value")
        df.write.format("scalar").option("element", "u64").mode("overwrite").save(f"{tmp_path}/u")
    got = spark.read.format("scalar").load(f"{tmp_path}/u").collect()
    assert [int(r.value) for r in got] == [2**63]


def test_npy(spark, tmp_path):
    a = np.random.default_rng(0).normal(size=(57, 6)).astype(np.float32)
    np.save(tmp_path / "a.npy", a)
    got = spark.read.format("npy").option("range", 200).load(str(tmp_path / "a.npy")).orderBy("ordinal").collect()
    assert np.array_equal(np.array([r.vec for r in got], np.float32), a)


def test_slab_with_gaps(spark, tmp_path):
    rows = [(i, bytes([i % 251]) * (i % 40)) for i in [*range(100), *range(500, 620)]]
    df = spark.createDataFrame([(1, i, bytearray(r)) for i, r in rows], "namespace int, ordinal bigint, payload binary")
    df.coalesce(1).sortWithinPartitions("ordinal").write.format("slab").option("page_size", 512).mode("append").save(f"{tmp_path}/s")
    got = spark.read.format("slab").option("range", 2000).load(f"{tmp_path}/s")
    assert got.rdd.getNumPartitions() > 1
    assert sorted((r.ordinal, bytes(r.payload)) for r in got.collect()) == rows
    few = spark.read.format("slab").option("first", 90).option("last", 505).load(f"{tmp_path}/s")
    assert sorted(r.ordinal for r in few.collect()) == [*range(90, 100), *range(500, 506)]


def test_slab_page_layout():
    page = S.slab_page([b"ab", b"", b"cde"], 7)
    assert page[:4] == b"SLAB" and struct.unpack("<I", page[4:8])[0] == len(page) == 8 + 5 + 16 + 16
    assert S.slab_records(page) == [(7, b"ab"), (8, b""), (9, b"cde")]
    assert S.slab_footer(page[-16:]) == (7, 3, len(page), 2, 1)
    with pytest.raises(ValueError, match="damaged"):
        S.slab_records(b"SLUB" + page[4:])
