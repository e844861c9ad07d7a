import json

import pytest

from orrery.functions.predicate import to_column
from orrery.operators import catalog, slab, synth
from orrery.plans import example, pipeline
from orrery.plans.dataset import Dataset
from orrery.plans.dataset import catalog as rows_of
from orrery.sources import formats


def test_example_dataset_verifies(spark, tmp_path):
    d, facets = example.example_dataset(spark, str(tmp_path), n=300, n_queries=20, dim=16, k=10)
    assert all(r.ok for r in example.verify_dataset(facets, 10).collect())
    assert facets["neighbor_indices"].count() == 200 and set(d.profiles["default"]) == set(facets)
    assert pipeline.evaluate("count:base_vectors", facets) == 300 and pipeline.evaluate("dim:base_vectors", facets) == 16
    assert pipeline.evaluate("${x}", facets, {"x": 5}) == 5 and pipeline.evaluate("plain", facets) == "plain"
    pipeline.require(facets, ["base_vectors"], 300)
    with pytest.raises(ValueError):
        pipeline.require(facets, ["nothing"])


def test_slab_life(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "in.txt").write_text("\n".join(f"line {i}" for i in range(200)))
    records = slab.import_lines(spark, str(tmp_path / "in.txt"))
    slab.save(records, f"{tmp_path}/s", page_size=512, files=3)
    got = slab.load(spark, f"{tmp_path}/s")
    assert [r.value for r in slab.export_text(got).orderBy("ordinal").collect()] == [f"line {i}" for i in range(200)]
    assert slab.get(spark, f"{tmp_path}/s", 77) == b"line 77" and slab.get(spark, f"{tmp_path}/s", 999) is None
    assert slab.check(spark, f"{tmp_path}/s").count() == 0 and slab.pages(spark, f"{tmp_path}/s").count() > 3
    assert [tuple(r) for r in slab.namespaces(got).collect()] == [(1, 200)]
    slab.rewrite(spark, f"{tmp_path}/s", f"{tmp_path}/t", 4096)
    assert slab.pages(spark, f"{tmp_path}/t").count() < slab.pages(spark, f"{tmp_path}/s").count()
    both = slab.append(got, slab.load(spark, f"{tmp_path}/t"))
    assert both.count() == 400 and both.agg({"ordinal": "max"}).first()[0] == 399
    assert slab.export_text(got.where("ordinal = 1"), "hex").first().value == b"line 1".hex()
    assert json.loads(slab.export_text(got.where("ordinal = 1"), "json").first().value) == {"ordinal": 1, "payload": "line 1"}
    file = formats.listing(f"{tmp_path}/s")[0][0]
    data = bytearray(open(file, "rb").read())
    data[0] = 0
    open(file, "wb").write(data)
    assert slab.check(spark, f"{tmp_path}/s").first().problem == "a slab page is damaged"


def test_catalog_json(spark):
    d = Dataset("d", {"default": {"base_vectors": "b.fvec"}, "10": {"base_vectors": "b.fvec[0..10)"}})
    got = json.loads(catalog.dataset_json(rows_of(spark, [d])).first().json)
    assert got == {"profiles": d.profiles}
    v = spark.createDataFrame([("d", "b", "2"), ("d", "a", "1")], "dataset_name string, key string, value string")
    assert catalog.variables_json(v).first().json == '{"a":"1","b":"2"}'


def test_compound_predicates(spark):
    df = synth.generate_metadata(spark, 3000, {"a": (1, 1000), "b": (1, 1000), "c": (1, 4)}, 5)
    preds = synth.compound_predicates(df, 20, 0.1, fields=["a", "b"], joined=2, key="ordinal", unique=0.1)
    for p in set(preds):
        assert abs(df.where(to_column(p, df.schema)).count() / 3000 - 0.1) < 0.03
    assert {p.op for p in synth.compound_predicates(df, 9, 0.25, fields=["c"], ops=("eq",))} == {"eq"}
    with pytest.raises(ValueError, match="differ"):
        synth.compound_predicates(df, 50, 0.1, fields=["a"], unique=0.9)
    with pytest.raises(ValueError, match="needed"):
        synth.compound_predicates(df, 5, 0.1, fields=["a"], joined=2)
    p = synth.from_template("a < ? AND c = 2", df, 0.3)
    assert abs(df.where(to_column(p.children[0], df.schema)).count() / 3000 - 0.3) < 0.02 and p.children[1].values == (2,)
