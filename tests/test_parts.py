"""Work that is cut into parts of a fixed number of rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from shutterlake.plans import catalog, gallery, imaging
from tests.test_queries import SF


@pytest.mark.parametrize("module, limit, most, name", [(imaging, "FACES_A_TASK", 50, "face_owners"), (imaging, "FACES_A_TASK", 50, "face_parts"), (gallery, "ENTRIES_A_TASK", 2000, "album_photos")])
def test_parts_follow_the_rows(spark, monkeypatch, module, limit, most, name):
    def run(rows):
        monkeypatch.setattr(module, limit, rows)
        found = catalog.queries()[name](spark, SF)
        return found._jdf.queryExecution().executedPlan().toString(), found.agg(F.count(F.lit(1)), F.sum(F.hash(*found.columns).cast("long"))).first()

    (_, want), (plan, got) = run(10**9), run(most)
    parts = [int(n) for n in re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan)]
    assert got == want and parts and min(parts) >= 3
