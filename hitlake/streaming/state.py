"""Streams that remember: duplicates with a refreshed time to live, sessions that late hits do not change.

Both keep keyed state in Spark's state store and give the same rows for the same batches,
whatever executors are lost in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hitlake.operators.basics import GAP
from hitlake.operators.sessions import VISITOR

#: A duplicate's time to live in seconds, and how many keys are remembered at most (fixed values).
TTL, MOST_KEYS = 600, 100_000


def suppress_duplicates(stream: DataFrame, key: str, at: str = "timestamp", ttl: int = TTL, most_keys: int = MOST_KEYS, buckets: int = 64) -> DataFrame:
    """Rows whose key was not seen in the ``ttl`` seconds before; a row that is left out counts as seen and starts the time anew.

    Keys lie in ``buckets`` by hash. A bucket remembers its share of ``most_keys`` keys,
    the least recently seen go first, so state is bounded however many keys there are. Rows are
    taken batch by batch, inside a batch by time; a row older than the last of its key is a
    duplicate. A null key or time is never one.
    """
    names, share = stream.columns, max(1, most_keys // buckets)
    where, when = names.index(key), names.index(at)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__bucket")

    def fresh(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get, strict=True)) if state.exists else {}  # in order of last use
        frame = pd.concat(list(frames), ignore_index=True)  # a bucket's rows of one batch
        frame = frame.sort_values(names[when], kind="stable", na_position="last")
        keep = []
        for k, t in zip(frame[names[where]], frame[names[when]], strict=True):
            if k is None or pd.isna(k) or pd.isna(t):
                keep.append(True)
                continue
            before = last.pop(k, None)
            keep.append(before is None or t >= before + ttl)
            last[k] = int(t) if before is None else max(before, int(t))
            if len(last) > share:
                del last[next(iter(last))]
        state.update((list(last), list(last.values())))
        yield frame.loc[keep, names]

    keyed = stream.select(bucket, *[F.col(f"`{c}`") for c in names])
    return keyed.groupBy("__bucket").applyInPandasWithState(fresh, stream.schema, "keys array<string>, last array<long>", "append", GroupStateTimeout.NoTimeout)


_SESSION = "start_ts long, end_ts long, entry_url string, exit_url string, page_count long"


def running_sessions(stream: DataFrame, gap: int = GAP, late: str | None = None, buckets: int = 4096) -> DataFrame:
    """Page views (visitor, timestamp, id, url) as sessions, in update mode: a row for each session that a batch began or went on with.

    A visitor's state is the last session. A hit older than its end changes no session (hits
    and roll-ups, which other sinks keep, still count it); one within the gap goes on with
    it, another begins a new one. The last row of a (visitor, start_ts) holds. With ``late``
    (and a column ts) visitors are forgotten when the watermark has passed their last session by
    the gap; without it they stay, as in the stored table of last sessions.

    Visitors lie in ``buckets`` by hash, a group of the state store each: a group costs
    milliseconds a batch, which most visitors' few hits are not worth.
    """
    pv = stream.where("pageview_flag = 1")
    bucket = F.pmod(F.xxhash64(*VISITOR), F.lit(buckets)).alias("__bucket")
    cols, n = [*VISITOR, "timestamp", "id", "url"], len(VISITOR)
    pv = pv.select(bucket, *cols) if late is None else pv.withWatermark("ts", late).select(bucket, *cols, "ts")

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = {tuple(x[:n]): [int(x[n]), int(x[n + 1]), x[n + 2], x[n + 3], int(x[n + 4])] for x in zip(*state.get, strict=True)} if state.exists else {}
        out: dict[tuple, tuple] = {}
        seen = set()
        if not state.hasTimedOut:
            frame = pd.concat(list(frames), ignore_index=True).sort_values(["timestamp", "id"])  # a bucket's hits of one batch
            for visitor, t, url in zip(zip(*[frame[c] for c in VISITOR], strict=True), frame["timestamp"], frame["url"], strict=True):
                t, now = int(t), last.get(visitor)
                seen.add(visitor)
                if now is not None and t < now[1]:
                    continue
                if now is None or t - now[1] > gap:
                    now = last[visitor] = [t, t, url, url, 1]
                else:
                    now[1], now[3], now[4] = t, url, now[4] + 1
                out[(visitor, now[0])] = (*visitor, *now)
        passed = None if late is None else state.getCurrentWatermarkMs()
        if passed is not None:
            last = {v: x for v, x in last.items() if v in seen or (x[1] + gap) * 1000 >= passed}
        if last:
            state.update(tuple(list(c) for c in zip(*((*v, *x) for v, x in last.items()), strict=True)))
            if passed is not None:
                state.setTimeoutTimestamp(max(min(x[1] + gap for x in last.values()) * 1000, passed + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(list(out.values()), columns=[*VISITOR, "start_ts", "end_ts", "entry_url", "exit_url", "page_count"])

    timeout = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    schema = ", ".join(f"{c} string" for c in VISITOR) + ", " + _SESSION
    held = ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in schema.split(", "))
    return pv.groupBy("__bucket").applyInPandasWithState(step, schema, held, "update", timeout)
