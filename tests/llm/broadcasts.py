"""What a session's executions broadcast."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Keys of classes and rows that are wanted again (their real size is known after a shuffle), the largest classes and
#: the block counts of long lists.
SMALL = {"class", "id", "hot_fingerprint", "hot_component", "shingle", "main", "loose_blocks", "all_blocks"}


def columns(spark, run: Callable[[], object]) -> set[str]:
    """Names of the columns that are in a broadcast of any plan while ``run`` is at work."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    listed = store.executionsList()
    before = max((listed.apply(i).executionId() for i in range(listed.size())), default=-1)
    run()
    bus.waitUntilEmpty(30_000)
    listed = store.executionsList()
    plans = [e.physicalPlanDescription() for e in map(listed.apply, range(listed.size())) if e.executionId() > before]
    assert plans
    inputs = [m for p in plans for m in re.findall(r"\) BroadcastExchange\nInput \[\d+\]: \[(.*)\]", p)]
    return {re.sub(r"#\d+L?$", "", c) for found in inputs for c in found.split(", ")}
