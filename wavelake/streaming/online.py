"""Streaming operators.

Event time must be TIMESTAMP: a TIMESTAMP_NTZ column is cast first (session time zone UTC).  Rows later than
the watermark are dropped, by all of these.

The operators that depend on order (refractory alerts, ring windows) hold rows back in an event-time buffer
per key and take them, in order, when the watermark has passed them; no row that comes later can belong before
them.  So the result is that of a batch over the rows that were not too late, however they arrived.  Nothing is
kept for ever: a timer at the first buffered row wakes a key even if it stays silent, and another one drops the
key's state once it can matter no more.

A call of Python for each key and trigger costs milliseconds, whatever little it has to do.  So keys are dealt into
`GROUPS` by their hash, and a call takes all keys of a group.  A group's state is arrays over its keys and held rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups of keys; each has one state and is one call a trigger.
GROUPS = 1024
#: A time before all others, for keys without one.
_NEVER = -(1 << 62)


def read_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed(df: DataFrame, ts: str, keys: Sequence[str], value: str, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding event-time windows; works on streams and on tables."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = event_time(df, ts, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(df: DataFrame, ts: str, keys: Sequence[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    """Session windows: rows at most ``gap`` apart belong together."""
    g = event_time(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _key_text(df: DataFrame, key: str) -> tuple[Column, Callable[[Column], Column]]:
    """(``key`` as text, null where it is null; the way back), exact for atomic types.  Pandas would turn whole numbers with nulls into floats."""
    kind, at = df.schema[key].dataType, F.col(key)
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType | T.VariantType):
        raise TypeError(f"a key of type {kind.simpleString()}")
    if isinstance(kind, T.BinaryType):
        return F.hex(at), F.unhex
    if isinstance(kind, T.TimestampType):  # its text is ambiguous where clocks are set back
        return F.unix_micros(at).cast("string"), lambda c: F.timestamp_micros(c.cast("long"))
    if isinstance(kind, T.FloatType | T.DoubleType):
        at = at + F.lit(0.0)  # -0.0 and 0.0 are one key
    return at.cast("string"), lambda c: c.cast(kind)


def _by_groups(df: DataFrame, key: str, ts: str, columns: Sequence[Column], run: Callable, out: str, held: str) -> DataFrame:
    """``columns`` of ``df``, dealt into groups of keys for ``run``; its output with the key itself in place of ``__key``."""
    text, back = _key_text(df, key)
    dealt = df.select(text.alias("__key"), ts, *columns).withColumn("__group", F.pmod(F.xxhash64("__key"), F.lit(GROUPS)))
    found = dealt.groupBy("__group").applyInPandasWithState(run, f"__key string, {out}", held, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(back(F.col("__key")).alias(key), *(c for c in found.columns if c != "__key"))


def _packed(*columns: Sequence | np.ndarray, kinds: str) -> list[bytes]:
    return [np.asarray(c, k).tobytes() for c, k in zip(columns, kinds, strict=True)]


def _unpacked(columns: Sequence[bytes], kinds: str) -> list[np.ndarray]:
    return [np.frombuffer(bytes(c), k) for c, k in zip(columns, kinds, strict=True)]


def _ripe(frames: Iterator[pd.DataFrame], keys: list, held: Sequence[np.ndarray], columns: Sequence[str], watermark: int) -> tuple[list, list[np.ndarray], list[np.ndarray]]:
    """(keys, rows that the watermark has passed, rows still held), the rows as arrays in order.

    The first array numbers the keys, old ones as before; the others are ``columns``, the first of them the time in microseconds.
    """
    frames = [f.dropna(subset=[columns[0]]) for f in frames]
    codes, names = pd.factorize(np.concatenate([np.array(keys, object), *(f["__key"].to_numpy(object) for f in frames)]), use_na_sentinel=False)
    rows = [np.concatenate([held[0], codes[len(keys):]]), *(np.concatenate([h, *(f[c].to_numpy(h.dtype) for f in frames)]) for c, h in zip(columns, held[1:], strict=True))]
    order = np.lexsort(rows[::-1])
    rows = [r[order] for r in rows]
    passed = rows[1] <= watermark * 1000
    return [None if pd.isna(k) else k for k in names], [r[passed] for r in rows], [r[~passed] for r in rows]


def _kept(of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys that have held rows or an end, their numbers for the held rows)."""
    stay = ends > _NEVER
    stay[of] = True
    return np.flatnonzero(stay), (np.cumsum(stay) - 1)[of]


def _wake(state: GroupState, at: np.ndarray, ends: np.ndarray) -> None:
    """A timer when the first held row is passed or the first key's state ends; no state without rows and without an end."""
    times = [*(-(-at // 1000)), *ends[ends > _NEVER]]
    if times:
        state.setTimeoutTimestamp(max(int(min(times)), state.getCurrentWatermarkMs() + 1))
    else:
        state.remove()


def _ends(last: np.ndarray, lasts: int, watermark: int) -> np.ndarray:
    """The millisecond when each key's state ends, ``lasts`` microseconds after its last time; none where that is over or there was no time."""
    ends = np.where(last > _NEVER, (last + lasts) // 1000 + 1, _NEVER)
    return np.where(ends > watermark, ends, _NEVER)


def refractory(df: DataFrame, key: str, ts: str, score: str, threshold: float, lock_seconds: float, delay: str = "10 minutes") -> DataFrame:
    """(key, ts) of alerts: a hot row fires unless the key fired at most ``lock_seconds`` before.

    Only hot rows are held.  A key's state ends when its last lock does.  The key is of an atomic type.
    """
    lock = round(lock_seconds * 1e6)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, *arrays = state.get if state.exists else ([], b"", b"", b"")
        last, *held = _unpacked(arrays, "qqq")
        watermark = state.getCurrentWatermarkMs()
        keys, (of, at), (held_of, held_at) = _ripe(() if state.hasTimedOut else (f[f["hot"]] for f in frames), list(keys), held, ("at",), watermark)
        last = [*last.tolist(), *[_NEVER] * (len(keys) - len(last))]
        fired = []
        for i, t in zip(of.tolist(), at.tolist(), strict=True):
            if t - last[i] > lock:
                last[i] = t
                fired.append((keys[i], t))
        last = np.array(last, np.int64)
        ends = _ends(last, lock, watermark)  # after it no row that is still to come can be locked
        stay, number = _kept(held_of, ends)
        state.update(([keys[i] for i in stay], *_packed(np.where(ends > _NEVER, last, _NEVER)[stay], number, held_at, kinds="qqq")))
        _wake(state, held_at, ends)
        yield pd.DataFrame(fired, columns=["__key", "at"])

    # rows that are not hot go along, for a filter here would move below the watermark, which then would stand still between alerts
    columns = [F.unix_micros(ts).alias("at"), F.coalesce(F.col(score) >= threshold, F.lit(False)).alias("hot")]
    found = _by_groups(event_time(df, ts, delay), key, ts, columns, run, "at long", "keys array<string>, last binary, number binary, held binary")
    return found.select(key, F.timestamp_micros("at").alias(ts))


def ring_windows(
    df: DataFrame, key: str, ts: str, value: str, size: int = 160, hop: int = 32, mean: float = 0.0, sd: float = 1.0, scale: float = 1.0, zero_point: int = 0,
    delay: str = "10 minutes", idle_seconds: float = 86_400.0, tie: str | None = None,
) -> DataFrame:
    """(key, seen, q): whenever ``hop`` more samples have come and ``size`` are held, the window, normalised and quantised to int8.

    The last ``size`` samples of a key are the state, besides the buffer.  A key that was silent for over ``idle_seconds``
    begins anew, so its state ends then.  Samples of one time go by ``tie``.  The deviation counts as 1 up to 1e-6.
    The key is of an atomic type.
    """
    divide, idle = sd if sd > 1e-6 else 1.0, round(idle_seconds * 1e6)

    def windows(x: np.ndarray, held: int, seen: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the samples that end a window, quantised windows); x holds ``held`` old samples first, ``seen`` came before it."""
        ends = np.arange(max(size, held + 1), len(x) + 1)
        ends = ends[(seen - held + ends) % hop == 0]
        v = (np.lib.stride_tricks.sliding_window_view(x, size)[ends - size] - mean) / divide / scale if len(ends) else np.zeros((0, size))
        whole = np.trunc(np.abs(v) + 0.5) * np.where(v >= 0, 1, -1)  # halves go away from zero
        return seen - held + ends, np.clip(whole + zero_point, -128, 127).astype(int)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, *arrays = state.get if state.exists else ([], *[b""] * 7)
        seen, last, samples, *held = _unpacked(arrays, "qqdqqqd")
        watermark = state.getCurrentWatermarkMs()
        rings = np.split(samples, np.cumsum(np.minimum(seen, size))[:-1]) if len(seen) else []
        keys, (of, at, _, x), waiting = _ripe(() if state.hasTimedOut else frames, list(keys), held, ("at", "tie", "value"), watermark)
        more = len(keys) - len(seen)
        seen, last, rings = [*seen.tolist(), *[0] * more], np.append(last, np.full(more, _NEVER)), [*rings, *[np.zeros(0)] * more]
        # parts of a key without a long silence
        first = np.diff(of, prepend=-1) != 0
        before = np.where(first, last[of], np.roll(at, 1))
        anew = (before > _NEVER) & (at - before > idle)
        names, numbers, quantised = [], [], []
        for start, stop in itertools.pairwise([*np.flatnonzero(first | anew), len(at)]):
            i = of[start]
            if anew[start]:
                seen[i], rings[i] = 0, np.zeros(0)
            part = np.concatenate([rings[i], x[start:stop]])
            n, q = windows(part, len(rings[i]), seen[i])
            names += [keys[i]] * len(n)
            numbers += n.tolist()
            quantised += list(q)
            seen[i], rings[i], last[i] = seen[i] + int(stop - start), part[-size:], at[stop - 1]
        ends = _ends(last, idle, watermark)
        for i in np.flatnonzero(ends == _NEVER):
            seen[i], last[i], rings[i] = 0, _NEVER, np.zeros(0)
        stay, number = _kept(waiting[0], ends)
        state.update(([keys[i] for i in stay], *_packed([seen[i] for i in stay], last[stay], np.concatenate([np.zeros(0), *(rings[i] for i in stay)]), number, *waiting[1:], kinds="qqdqqqd")))
        _wake(state, waiting[1], ends)
        yield pd.DataFrame({"__key": names, "seen": numbers, "q": quantised})

    order = F.coalesce(F.col(tie).cast("long"), F.lit(-(1 << 63))) if tie else F.lit(0).cast("long")
    columns = [F.unix_micros(ts).alias("at"), order.alias("tie"), F.col(value).cast("double").alias("value")]
    held = "keys array<string>, seen binary, last binary, rings binary, number binary, times binary, ties binary, held binary"
    return _by_groups(event_time(df, ts, delay), key, ts, columns, run, "seen long, q array<int>", held)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet under ``folder``, and read the result.

    ``append``: what the watermark closed.  ``complete``: every group as of the last trigger, also open ones.
    """
    spark, latest = stream.sparkSession, [-1]
    w = stream.writeStream.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "complete":
        def keep(df: DataFrame, i: int) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/data/{i}")
            latest[0] = i

        w.foreachBatch(keep).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/data/{latest[0]}")
    w.format("parquet").option("path", f"{folder}/data").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")
