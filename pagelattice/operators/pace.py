"""The pace a crawl keeps on each host: a state machine over its pages in order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Signals in a row that slow a host, normal pages in a row that ease it, and
# milliseconds: the first and the longest wait, the hold of a host that sends pages away, the
# wait from which a signal can prove not to be about pace, and the highest floor.
SLOW_AFTER, EASE_AFTER = 2, 10
FIRST_MS, LONGEST_MS, HOLD_MS, SETTLE_MS, FLOOR_MS = 2_000, 120_000, 60_000, 32_000, 8_000
SENT_AWAY = "redirected_off_page"
SETTLES = frozenset((SENT_AWAY, "verification_failed"))


class Pace(NamedTuple):
    """A host's wait and what led to it."""

    delay: int = 0
    streak: int = 0
    calm: int = 0
    slowdowns: int = 0
    floor: int = 0
    cause: str = ""
    eased: bool = False
    settled: str = ""  # signals that no longer count, each between bars


def step(p: Pace, signal: str | None, earlier: str | None = None, baseline: int = 0) -> tuple[Pace, str | None, int]:
    """The pace after one page, the change if there is one, and for how long the host is then
    left alone. ``earlier`` is what the same page's read before this one signalled.

    The second signal in a row doubles the wait; the tenth normal page in a row halves it, down
    to the floor, and at the baseline the host is as before. A page that was sent away and now
    answers makes the wait in force the floor. A signal that alone set a long wait and comes
    again from the same page is settled: it counts no more.
    """
    if signal and f"|{signal}|" in p.settled:
        return p, None, 0
    if signal:
        if earlier == signal and signal in SETTLES and p.cause == signal and p.delay >= SETTLE_MS:
            return Pace(delay=baseline, settled=f"{p.settled}|{signal}|"), "settled", 0
        if p.streak + 1 < SLOW_AFTER:
            return p._replace(streak=p.streak + 1, calm=0), None, 0
        delay = min(LONGEST_MS, max(FIRST_MS, 2 * p.delay if p.slowdowns else 0))
        fresh = not p.slowdowns or p.eased
        cause = signal if not p.slowdowns or p.cause == signal else ""
        hold = max(delay, HOLD_MS) if signal == SENT_AWAY and fresh else delay
        return p._replace(delay=delay, streak=0, calm=0, slowdowns=p.slowdowns + 1, cause=cause, eased=False), "slowed", hold
    if not p.slowdowns:
        return p._replace(streak=0), None, 0
    if earlier == SENT_AWAY:
        p = p._replace(floor=max(p.floor, min(p.delay, FLOOR_MS)))
    if p.calm + 1 < EASE_AFTER:
        return p._replace(streak=0, calm=p.calm + 1, eased=True), None, 0
    delay = max(baseline, p.floor, p.delay // 2)
    if delay <= baseline:
        return Pace(delay=baseline, settled=p.settled), "restored", 0
    return p._replace(delay=delay, streak=0, calm=0, eased=True), "eased" if delay != p.delay else None, 0


PACED = "host string, seq long, delay_ms long, change string, hold_ms long"


def pacing(pages: DataFrame, host: str, order: str, signal: str, earlier: str | None = None, baseline: int = 0) -> DataFrame:
    """``host, seq, delay_ms, change, hold_ms`` after each page. The order decides, so a host's
    rows pass one task one after another; they are streamed, with one state at a time, and
    never held as a group. Null hosts give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, p = None, Pace(delay=baseline)
        for b in batches:
            out = []
            for h, s, e in zip(b["host"], b["signal"], b["earlier"]):
                if h != at:
                    at, p = h, Pace(delay=baseline)
                p, change, hold = step(p, s, e, baseline)
                out.append((p.delay, change, hold))
            delays, changes, holds = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({"host": b["host"], "seq": b["seq"], "delay_ms": delays, "change": pd.Series(changes, dtype="object"), "hold_ms": holds})

    rows = pages.select(
        F.col(host).alias("host"), F.col(order).cast("long").alias("seq"), F.col(signal).alias("signal"),
        (F.col(earlier) if earlier else F.lit(None)).cast("string").alias("earlier"),
    )
    return rows.where("host is not null").repartition("host").sortWithinPartitions("host", "seq").mapInPandas(run, PACED)
