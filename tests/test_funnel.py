"""The funnel counts what the veto, the gate and the dedupe keep."""

import datetime as dt

from newsweft.plans.registry import probe_funnel
from newsweft.plans.workload import HEADLINES

AT = dt.datetime(2024, 1, 30, 12, 0, 0)


def test_kept_is_what_the_real_gate_keeps(spark, tmp_path):
    rows = [  # template, event type, kept
        (4, "view", True),  # score 14
        (2, "view", True),  # score 3, anchored
        (7, "view", False),  # score 0
        (7, "signup", True),  # score 0, humanitarian
        (7, "error", True),  # score 0, alert
        (7, "purchase", False),
        (8, "signup", False),  # noise
        (8, "error", False),
        (8, "view", False),  # noise with a score of 6
    ]
    events = [(len(HEADLINES) * n + t, AT, n, kind, 5.0) for n, (t, kind, _) in enumerate(rows)]
    events.append(events[0])  # a repeated id counts once
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    row = probe_funnel(spark, str(tmp_path)).first()
    assert row.seen == len(rows) + 1
    assert row.kept == sum(kept for _, _, kept in rows)
