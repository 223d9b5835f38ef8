"""Panes: sums leave a task as a row for each pane, and never wrap around."""

from datetime import datetime

import pandas as pd
import pytest

from mnemoria.llm import panes


def test_a_task_sends_a_row_for_each_pane():
    frame = pd.DataFrame({"shard": [3] * 1000 + [3, 5], "hour": [-7] * 1000 + [0, 0], "kind": ["view"] * 1000 + ["", "view"], "cents": [(1 << 62) - 1] * 1000 + [0, -9], "ends": [False] * 1000 + [True, False]})
    out = pd.concat(panes.sums_by_pane(iter([frame[:600], frame[600:]]))).astype(object)
    assert sorted(map(tuple, out.values.tolist())) == [(3, -7, "view", 1000, 1000 * ((1 << 62) - 1)), (3, 0, "", 0, 0), (5, 0, "view", 1, -9)]


def test_one_stateful_operator(spark, tmp_path):
    feed = spark.readStream.schema(panes.FEED).parquet(str(tmp_path))
    plan = panes.pane_changes(feed, 0, panes.NEVER, True)._jdf.queryExecution().analyzed().toString()
    assert plan.count("WithState") == 1


def test_sums_beyond_a_long_end_the_query(spark):
    rows = [(i, datetime(1970, 1, 1, 5), datetime(1970, 1, 1, 5), "view", 6e16) for i in range(2)]
    clicks = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double")
    with pytest.raises(Exception, match=r"beyond a long|too large|out of bounds|Overflow|overflow"):
        panes.panes_with_revisions(clicks, n_batches=1, shards=2).collect()
