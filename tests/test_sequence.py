"""Sequence pairs look forward only, whatever the order of identifiers and frames."""

from fathomline.operators import dedup


def test_only_later_frames(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    rows = [(1, "A", 5, *box), (2, "A", 3, *box), (3, "A", 6, *box), (4, "A", 8, *box), (5, "A", 9, *box), (6, "B", 6, *box), (7, "A", 8, 9.0, 9.0, 19.0, 19.0)]
    table = spark.createDataFrame(rows, "obs long, cls string, frame_index long, x0 double, y0 double, x1 double, y1 double")
    got = {tuple(r) for r in dedup.sequence_edges(table).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and 0 <= b[2] - a[2] <= 3 and a[3] == b[3]}
    assert got == want and (1, 2) not in got and (1, 3) in got
