"""Files written in several parts are read whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.sources import formats


@pytest.mark.parametrize("kind", ["gml", "graphml", "gexf"])
def test_folders_of_many_files(spark, tmp_path, kind):
    g = Graph(spark.range(50), spark.range(1, 50).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"), (F.col("id") * 0.5).alias("weight")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        formats.write_graph(g, str(tmp_path / kind), kind)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / kind).glob("part-*"))) > 1
    back = formats.read_graph(spark, str(tmp_path / kind), kind)
    assert back.vertices.count() == 50
    assert sorted(r.weight for r in back.edges.collect()) == [i * 0.5 for i in range(1, 50)]
    if kind == "gml":
        assert sorted(map(tuple, back.edges.select("src", "dst").collect())) == [(i, i - 1) for i in range(1, 50)]


def test_gml_of_another_layout(spark, tmp_path):
    (tmp_path / "x.gml").write_text("graph [ directed 1\n node [ id 1 ] node [\n id 2 ]\n edge [ source 2 target 1 ] ]\n")
    g = formats.read_gml(spark, str(tmp_path / "x.gml"))
    assert g.directed and [tuple(r) for r in g.edges.collect()] == [(2, 1, 1.0)]
