"""Recurrence clusters over blocks of notes."""

from lodestone.operators import clusters
from pyspark.sql import functions as F


def test_recurrence_leaves_a_forest(spark, monkeypatch):
    """Notes that are all linked return fewer links than notes a pair of blocks, not one a pair of notes."""
    monkeypatch.setattr(clusters, "BLOCK_CLASSES", 100)
    rows = [(f"n{i:04d}", f"b{i % 2}", [1.0, i / 400], ["same", "words", f"w{i}"]) for i in range(400)]
    classes = spark.createDataFrame(rows, "node string, brain string, vec array<double>, tokens array<string>").withColumn("kind", F.lit("memory"))
    links = clusters._class_links(classes, 0.5, 0.3)
    assert links.count() <= 10 * 230
    assert clusters.connected_components(links).select("component").distinct().count() == 1
