"""Findings of all tasks from lines that are made once."""

import os

from millrace.plans import catalog
from millrace.sources.shared import shared_dir

SF = "/root/testdata/sf0.001"


def test_lines_are_joined_and_costed_once(spark, monkeypatch):
    """Every decision reads one table of lines, which is gone when the rows are returned."""
    read, decide = [], catalog.commerce.evidence

    def evidence(df, *more):
        read.append(df._jdf.queryExecution().optimizedPlan().toString())
        return decide(df, *more)

    monkeypatch.setattr(catalog.commerce, "evidence", evidence)
    folder = shared_dir(spark).removeprefix("file://") + "/millrace"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = catalog.QUERIES["verified_finding"](spark, SF).collect()
    assert len({(r.language, r.task) for r in rows}) == len(rows) == 6
    assert len(read) == 3 and not any("Join" in plan or "sha2" in plan for plan in read)
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before
