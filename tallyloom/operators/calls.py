"""Tool calls joined with their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = ["file_id", "call_id"]


def gated_calls(calls: DataFrame, outputs: DataFrame, values: list[str], keys: list[str] = CALL) -> DataFrame:
    """Calls whose last output says that it worked (``ok``). Of repeated calls the last counts; calls without an output don't."""
    c = calls.groupBy(*keys).agg(F.max_by(F.struct("line_no", *values), "line_no").alias("c"))
    o = outputs.groupBy(*keys).agg(F.max_by("ok", "line_no").alias("ok"))
    return c.join(o, keys).where("ok").select(*keys, "c.*")


def resolved_calls(rows: DataFrame) -> DataFrame:
    """``(file_id, call_id, done)`` of calls that may go on in waits.

    ``rows``: file_id, line_no, kind (call, wait or output), call_id, cell_id, state (completed, failed or running). A running output
    hands its call over to a cell; a wait on that cell speaks for the call, and its output may hand over again. The chain is as long as
    the file makes it and its order counts, so each file's few call rows are walked in order.
    """

    def walk(pdf):
        import pandas as pd

        origin, cell, done = {}, {}, {}
        for r in pdf.sort_values("line_no").itertuples(index=False):
            if r.kind == "call":
                origin[r.call_id] = r.call_id
                done.setdefault(r.call_id, None)
            elif r.kind == "wait":
                if r.cell_id in cell:
                    origin[r.call_id] = cell[r.cell_id]
            elif r.call_id in origin:
                first = origin[r.call_id]
                if r.state == "running":
                    cell[r.cell_id] = first
                else:
                    done[first] = r.state == "completed"
        return pd.DataFrame([(pdf["file_id"].iloc[0], c, d) for c, d in done.items() if d is not None], columns=["file_id", "call_id", "done"])

    need = rows.select("file_id", "line_no", "kind", "call_id", "cell_id", "state")
    return need.groupBy("file_id").applyInPandas(walk, "file_id string, call_id string, done boolean")
