"""What splits segments in a cell: crossings and corners on an edge, not corners that neighbours share."""

from orbweave.operators import overlay


def _squares(spark, *corners):
    ring = lambda x, y: [(x, y), (x + 2.0, y), (x + 2.0, y + 2.0), (x, y + 2.0)]
    return spark.createDataFrame([(1, [ring(*c)]) for c in corners], "g int, rings array<array<struct<x:double,y:double>>>")


def _split(monkeypatch, shapes):
    """The area of the union, and how many segments were split on the way."""
    seen, write = [], overlay.materialized
    monkeypatch.setattr(overlay, "materialized", lambda df: seen.append(write(df)) or seen[-1])
    area = overlay.measured(overlay.dissolved(shapes, "g", 100.0), ["g"]).first().area
    return area, [df.count() for df in seen if "_p" in df.columns]


def test_shared_corners_split_nothing(spark, monkeypatch):
    assert _split(monkeypatch, _squares(spark, (1.0, 1.0), (3.0, 1.0), (3.0, 3.0))) == (12.0, [0])


def test_crossings_split_both_segments(spark, monkeypatch):
    assert _split(monkeypatch, _squares(spark, (1.0, 1.0), (2.0, 2.0))) == (7.0, [4])
