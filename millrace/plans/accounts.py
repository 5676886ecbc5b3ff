"""What the Spark jobs of a tag have read, written and spilled, by Spark's own accounts: no job is added for it.

The accounts are those of the driver's status store, which lives whether or not the web page is served.
It keeps the newest jobs and stages (``spark.ui.retainedJobs``, ``spark.ui.retainedStages``); what a step
has done in stages beyond these is missing from its sums. Attempts that failed count too, as their rows
were read. Rows read are those that scans hand on, after row groups were skipped by their bounds.
"""

from __future__ import annotations

import contextlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: A statistic's action, and the store's numbers that add up to it.
SUMS = {
    "rows_read": ("inputRecords",),
    "bytes_read": ("inputBytes",),
    "rows_written": ("outputRecords",),
    "bytes_written": ("outputBytes",),
    "bytes_shuffled": ("shuffleWriteBytes",),
    "bytes_spilled": ("memoryBytesSpilled", "diskBytesSpilled"),
}
#: Milliseconds to wait for events that are still under way.
SETTLE_MS = 10_000


class JobAccounts:
    """The jobs of a tag from now on: those that it had before, as of an earlier try, are left out."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag
        self.context = spark.sparkContext._jsc.sc()
        self.before = self.jobs()

    def jobs(self) -> set[int]:
        return set(self.context.statusTracker().getJobIdsForTag(self.tag))

    def stages(self) -> set[int]:
        """Stages of the jobs, each once: jobs of one query list those that they share."""
        tracker = self.spark.sparkContext.statusTracker()
        found = (tracker.getJobInfo(job) for job in self.jobs() - self.before)
        return {stage for info in found if info for stage in info.stageIds}

    def sums(self) -> dict[str, int]:
        with contextlib.suppress(Py4JJavaError):  # a bus that others keep busy; ours are old by then
            self.context.listenerBus().waitUntilEmpty(SETTLE_MS)
        gateway, store = self.spark.sparkContext._gateway, self.context.statusStore()
        no_tasks, no_quantiles = gateway.jvm.java.util.ArrayList(), gateway.new_array(gateway.jvm.double, 0)
        out = dict.fromkeys(SUMS, 0)
        for stage in sorted(self.stages()):
            attempts = store.stageData(stage, False, no_tasks, False, no_quantiles).iterator()
            while attempts.hasNext():
                attempt = attempts.next()
                for action, names in SUMS.items():
                    out[action] += sum(getattr(attempt, name)() for name in names)
        return out
