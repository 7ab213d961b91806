"""Small inputs spread over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Inputs whose files hold less than this many bytes are dealt out anew before Python work.
SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many partitions as there are cores if what it is read from is small,
    as a table of one file is one task otherwise. A larger input has partitions enough and
    is left alone: its texts are not shuffled. The sizes are those of the plan's leaves (an
    estimate for chosen columns says little about texts); nothing is run for them. Rows that
    were just dealt are not dealt again."""
    plan = df._jdf.queryExecution().optimizedPlan()
    top = plan
    while top.nodeName() == "Project":
        top = top.child()
    if top.nodeName() == "Repartition" and top.shuffle():
        return df
    leaves = plan.collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size >= SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
