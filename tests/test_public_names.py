"""What can be imported from the package itself, and the small text conversions."""

import subprocess
import sys

import pytest

import plumbline
from plumbline.sources import tables


def test_every_public_name_is_there():
    assert len(plumbline.__all__) == len(set(plumbline.__all__)) > 50
    for name in plumbline.__all__:
        assert getattr(plumbline, name) is not None and name in dir(plumbline)
    with pytest.raises(AttributeError):
        plumbline.no_such_name


def test_importing_loads_no_operator():
    code = "import plumbline, sys; print([m for m in sys.modules if m.startswith(('plumbline.', 'pyspark'))])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True).stdout.strip() == "[]"


def test_texts_that_are_no_numbers_stay(spark, tmp_path):
    rows = spark.createDataFrame([("1.5",), ("7",), ("x y",), ("",), (None,)], "c string").select(tables.number_or_text("c").alias("v")).collect()
    assert [(r["v"]["number"], r["v"]["text"]) for r in rows] == [(1.5, None), (7.0, None), (None, "x y"), (None, None), (None, None)]
    none = tables.read_csv_or_empty(spark, f"{tmp_path}/none.csv", ["a", "b"])
    assert none.columns == ["a", "b"] and none.count() == 0
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert [tuple(r) for r in tables.read_csv_or_empty(spark, f"{tmp_path}/t.csv", ["b"]).collect()] == [("x",)]
