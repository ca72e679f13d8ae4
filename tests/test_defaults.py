"""Registered queries call these operators with the operators' own rounds and levels."""

import pytest

import __spark_entry__ as entry
from pointgrid.checks import voxels
from pointgrid.operators import graph, neighbors
from pointgrid.plans import labelling, placing

CALLS = {
    "e11_refine": (neighbors, "refine"),
    "e17_plan_doors": (placing, "plan_doors"),
    "e18_label_graph": (graph, "label_graph"),
    "k04_label_scans": (labelling, "label_scans"),
}


class Called(Exception):
    pass


@pytest.mark.parametrize("key", sorted(CALLS))
def test_defaults(spark, sf_dir, monkeypatch, key):
    def spy(*args, **named):
        raise Called(sorted(set(named) & {"rounds", "patience", "levels", "out_levels"}))

    kept = spark.createDataFrame([(0, "point")], "scan_id long, kind string")
    meta = spark.createDataFrame([(0, 0)], "scan_id long, rot int")
    monkeypatch.setattr(voxels, "voxel_files", lambda *_: (kept, kept, meta))
    monkeypatch.setattr(*CALLS[key], spy)
    with pytest.raises(Called) as said:
        entry.queries()[key](spark, sf_dir)
    assert said.value.args[0] == []
