"""Files in: headers, encodings, names; files out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import text
from tallyfold.sources import files


def _write(folder, **contents):
    for name, raw in contents.items():
        path = folder / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.with_suffix(".csv").write_bytes(raw)
    return str(folder)


def read(spark, folder, **more):
    return sorted((r["path"].rsplit("/", 1)[1], r["t"], r["v"]) for r in files.read_series(spark, folder, ["t", "v"], recursive=True, **more).collect())


def test_only_a_first_line_is_a_header(spark, tmp_path):
    folder = _write(tmp_path, a=b"day,price\n1,2.5\n2,N/A\n3,-\n", b=b"1,7\n2,x\n", c=b"1,\n2,8\n")
    kept = [("a.csv", "1", "2.5"), ("a.csv", "2", "N/A"), ("a.csv", "3", "-"), ("b.csv", "1", "7"), ("b.csv", "2", "x"), ("c.csv", "1", None), ("c.csv", "2", "8")]
    assert read(spark, folder) == kept
    assert read(spark, folder, header=False) == sorted([*kept, ("a.csv", "day", "price")])
    assert read(spark, folder, header=True) == [x for x in kept if x[:2] not in (("b.csv", "1"), ("c.csv", "1"))]


def test_encodings_in_turn(spark, tmp_path):
    folder = _write(tmp_path, a="é,1\n".encode(), b="é,2\n".encode("latin-1"))
    assert read(spark, folder, encoding=["UTF-8", "ISO-8859-1"]) == [("a.csv", "é", "1"), ("b.csv", "é", "2")]


def test_names_by_whole_folders(spark):
    paths = ["file:/top/in/a/x/s.csv", "file:/top/in/b/x/s.csv", "file:/top/in/s.csv", "file:/top/in/b/t.csv"]
    got = {r["path"]: r["series_id"] for r in files.series_names(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert [got[p] for p in paths] == ["a_x_s", "b_x_s", "s", "t"]
    one = files.series_names(spark.createDataFrame([(paths[0],)], "path string"))
    assert one.first()["series_id"] == "s"


def test_one_frame(spark):
    long = spark.createDataFrame([("s", 1, "v", 1.0), ("s", 1, "w", 2.0), ("t", 2, "v", 3.0)], "series_id string, time int, field string, value double")
    assert files.one_frame(long).columns == ["time", "s_v", "s_w", "t_v"]
    assert files.one_frame(long.filter("field = 'v'")).columns == ["time", "s", "t"]
    assert files.one_frame(long.filter("series_id = 's'")).columns == ["time", "v", "w"]


def test_fingerprints_differ(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("x", None), ("", "x"), ("x", "")], "p string, q string")
    got = [r[0] for r in rows.select(text.fingerprint([F.lit("p"), F.lit("q")], [F.col("p"), F.col("q")])).collect()]
    assert len(set(got)) == len(got)


def test_upsert(spark, tmp_path):
    """Only periods with new data are written anew; the other files keep their names; a second run changes nothing."""
    import datetime as d

    from tests.test_operators import rows

    day = lambda m, k: d.date(2024, m, k)
    path = f"{tmp_path}/store"
    files.upsert(rows(spark, series_id=["a", "a", "b"], time=[day(1, 3), day(2, 3), day(3, 3)], value=[1.0, 2.0, 3.0]), path)
    names = lambda: {p.relative_to(path).as_posix() for p in tmp_path.glob("store/period=*/*.parquet")}
    before = names()
    new = rows(spark, series_id=["a", "b"], time=[day(2, 3), day(2, 9)], value=[20.0, 9.0])
    stored = lambda: sorted((r["series_id"], r["time"], r["value"]) for r in spark.read.parquet(path).collect())
    for _ in range(2):
        assert [str(p) for p in files.upsert(new, path)] == ["2024-02-01"]
        assert stored() == [("a", day(1, 3), 1.0), ("a", day(2, 3), 20.0), ("b", day(2, 9), 9.0), ("b", day(3, 3), 3.0)]
    assert {n for n in before if "2024-02" not in n} == {n for n in names() if "2024-02" not in n}
    with pytest.raises(ValueError):
        files.upsert(new.unionByName(new), path)
    assert len(stored()) == 4
