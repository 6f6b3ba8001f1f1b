"""Streaming episodes (X-01, X-02, F-07 stream form) on typed state.

Both operators work on GRPO groups ``(run_id, step)`` and are keyed by a bucket of groups, a hash of
the two columns, so that a call, its state, its timer and its output serve all groups of a bucket at
once: each of these is a message between Spark and its Python worker, whatever it holds.

X-01 keeps, per trajectory ``(run_id, step, g)``, its progress (all of a bucket's in one value state:
next expected turn, done, best reward, the turns held) and the turns that arrived ahead of their
predecessor (a map state by trajectory and turn, so that a batch writes the turns that arrived and no
others). A scored turn goes in; reward, done and the
next prompt come out, in turn order. Turns after ``done`` are dropped (H-13). A timer on event time
ends an episode: when the watermark has passed its last turn by the expiry, turns still held for a
missing predecessor are emitted with ``expired = true``. A bucket has one timer, set for the
trajectory that expires first.

X-02 keeps a mark per GRPO group ``(run_id, step, group_size)`` (all of a bucket's in one value
state) and the credited reward of each finished trajectory (a list state of the bucket, at most
``G`` values a group) and emits the group's advantages once all ``G`` have finished;
rewards of a group that a batch completes are not written first. A timer flushes a group that never completes, flagged ``complete = false`` (our policy). A complete
group drops its rewards and leaves its mark until the same expiry, so a redelivered trajectory does
not open it again.

:func:`training_stream` is both as one query: finished episodes go straight into the group
barrier, the watermark passing through the first operator into the second.

Event times reach the state as epoch milliseconds taken in Spark, so results do not depend on the
session's time zone. A group's state is bounded by configuration (``G`` trajectories of ``max_turns`` turns, ``G`` rewards), so
no group can accumulate an unbounded state; a bucket's value holds its share of the groups that have
not expired, and a batch rewrites the values of the buckets it touches. ``buckets`` (one number for
the life of a checkpoint) should be some times the shuffle partitions and keep that share in the
hundreds; :func:`state_sizes` reports the sizes. They need the RocksDB
state store. (State TTL exists in processing time only; on event time the timers take its place.)
"""
from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rewardlake.functions import text as tx
from rewardlake.session import ship_package

STEP_OUT = ("run_id string, step long, g int, turn int, reward double, solved boolean, "
            "done boolean, next_prompt string, expired boolean")
# Further columns of a step for what follows it in the same query.
CHAIN_OUT = STEP_OUT + ", best_reward double, reward_mode string, group_size int, ts timestamp"
HELD = ("reward double, solved boolean, action string, feedback string, max_turns int, "
        "entry_point string, prompt string, reward_mode string, group_size int")
HELD_FIELDS = tuple(c.split()[0] for c in HELD.split(", "))
# Of a bucket: its timer and its trajectories; of a trajectory, after its name, when it expires.
PROGRESS = ("timer_ms long, entries array<struct<run_id: string, step: long, g: int, at_ms: long, "
            "last_ms: long, next_turn: int, done: boolean, best: double, held: array<int>>>")
NOT_BEGUN = (0, 0, 0, False, None, ())
REWARD, MAX_TURNS = HELD_FIELDS.index("reward"), HELD_FIELDS.index("max_turns")

GROUP_OUT = ("run_id string, step long, g int, reward double, advantage double, "
             "complete boolean")
# Of a bucket: its timer and its groups; of a group, after its name, when it expires.
MARKS = ("timer_ms long, entries array<struct<run_id: string, step: long, group_size: int, "
         "at_ms: long, last_ms: long, emitted: boolean, waiting: array<int>>>")
NOT_SEEN = (0, 0, False, ())
REWARDS = "run_id string, step long, group_size int, g int, reward double"

# Buckets of groups that each operator's state is keyed by (default).
BUCKETS = 4096

# Held turns, unfinished groups and marks of complete groups expire once the
# event-time watermark has passed them by this much (default).
STATE_TIMEOUT_MS = 3_600_000
WATERMARK = "1 hour"


def _next_prompt(row, done: bool) -> str | None:
    """P-07 / P-08; null where a text it needs is null, as in the batch form."""
    if done:
        return ""
    if row["entry_point"] is None or row["prompt"] is None or (
            row["feedback"] and row["action"] is None):
        return None
    return tx.revision_text(row["entry_point"], row["prompt"], row["action"], row["feedback"])


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms // 1000, timezone.utc) + timedelta(milliseconds=ms % 1000)


def _row(schema: str) -> Row:
    return Row(*[c.split()[0] for c in schema.split(", ")])


def _plain(v: float | str | None) -> float | None:
    """A number, as it stands in JSON if infinite; not-a-number as null."""
    return None if v is None or math.isnan(v := float(v)) else v


CHAIN_ROW, GROUP_ROW = _row(CHAIN_OUT), _row(GROUP_OUT)


class BucketProcessor(StatefulProcessor):
    """A bucket of groups: its entries (trajectories or groups) by name, all in one value state, and
    one timer for the entry that expires first."""

    ENTRIES: str

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", self.ENTRIES)

    def _saved(self) -> tuple[int, dict]:
        """The bucket's timer and its entries: name to (expiry, rest)."""
        timer_ms, entries = self.entries.get() or (0, ())
        return timer_ms, {(run_id, step, n): rest for run_id, step, n, *rest in entries}

    def _save(self, timer_ms: int, entries: dict) -> None:
        """Arms the bucket's only timer for the entry that expires first."""
        at = min((e[0] for e in entries.values()), default=0)
        if at != timer_ms:
            if timer_ms:
                self.handle.deleteTimer(timer_ms)
            if at:
                self.handle.registerTimer(at)
        if entries:
            self.entries.update((at, [(*name, *rest) for name, rest in entries.items()]))
        else:
            self.entries.clear()

    def _expiry(self, last_ms: int, watermark: int) -> int:
        return max(last_ms + self.expire_ms, watermark + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        _, entries = self._saved()
        gone = {name: e for name, e in entries.items() if e[0] <= watermark}
        out = self._expired(gone, watermark)
        # the timer that fired is gone by itself
        self._save(0, {name: e for name, e in entries.items() if name not in gone})
        yield from out

    def _expired(self, gone: dict, watermark: int) -> list[Row]:
        """Removes what else the state holds of entries that expired; the rows they leave."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class EpisodeSteps(BucketProcessor):
    """X-01: the trajectories of a bucket, each by itself."""

    ENTRIES = PROGRESS

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getMapState("held", "run_id string, step long, g int, turn int", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer_ms, episodes = self._saved()
        new: dict[tuple, dict[int, tuple]] = {}
        last: dict[tuple, int] = {}
        for run_id, step, g, t, ms, *rec in _packed(rows):
            name = (run_id, step, g)
            last[name] = max(last.get(name, 0), ms or 0)
            turns = new.setdefault(name, {})
            _, _, next_turn, done, _, _ = episodes.get(name, NOT_BEGUN)
            most = rec[MAX_TURNS]
            # only turns that can still be stepped are kept: state <= max_turns
            if t is not None and most is not None and not done and next_turn <= t < most:
                if t not in turns:
                    rec[REWARD] = _plain(rec[REWARD])
                    turns[t] = tuple(rec)
        watermark = timerValues.getCurrentWatermarkInMs()
        out: list[Row] = []
        for name, turns in new.items():
            episodes[name] = self._stepped(name, turns, episodes.get(name, NOT_BEGUN), last[name],
                                           watermark, out)
        self._save(timer_ms, episodes)
        yield from out

    def _stepped(self, name: tuple, new: dict, before, last_ms: int, watermark: int, out: list
                 ) -> list:
        """The trajectory's state after the turns of a batch; rows of turns stepped go to ``out``."""
        _, before_ms, next_turn, done, best, held = before
        held = list(held)
        last_ms = max(last_ms, before_ms)
        # a step's time is its trajectory's latest, which no watermark has passed yet
        ts = _time(max(last_ms, watermark))
        while not done:
            if next_turn in held:       # the first delivery counts
                rec = self._release(name, next_turn)
                held.remove(next_turn)
                new.pop(next_turn, None)
            elif next_turn in new:
                rec = new.pop(next_turn)
            else:
                break
            r = dict(zip(HELD_FIELDS, rec))
            reward, solved = r["reward"], bool(r["solved"])
            done = solved or next_turn + 1 >= int(r["max_turns"])
            if reward is not None:
                best = reward if best is None else max(best, reward)
            out.append(CHAIN_ROW(*name, next_turn, reward, solved, done, _next_prompt(r, done),
                                 False, best, r["reward_mode"], r["group_size"], ts))
            next_turn += 1
        if done:
            for t in held:
                self.held.removeKey((*name, t))
            held = []
        else:
            for t, rec in new.items():
                if t not in held:
                    self.held.updateValue((*name, t), rec)
                    held.append(t)
        return [self._expiry(last_ms, watermark), last_ms, next_turn, done, best, held]

    def _release(self, name: tuple, turn: int) -> tuple:
        """Removes and returns a held turn."""
        rec = self.held.getValue((*name, turn))
        self.held.removeKey((*name, turn))
        return rec

    def _expired(self, gone: dict, watermark: int) -> list[Row]:
        ts, out = _time(watermark), []
        for name, (*_, held) in gone.items():
            for t in sorted(held):          # quarantine: a predecessor never came
                r = dict(zip(HELD_FIELDS, self._release(name, t)))
                out.append(CHAIN_ROW(*name, t, r["reward"], bool(r["solved"]), False, "", True,
                                     None, r["reward_mode"], r["group_size"], ts))
        return out


def _bucketed(df: DataFrame, cols, ts: str, buckets: int):
    """The rows keyed by their group's bucket, their ``cols`` as one text: a state operator takes its
    rows value by value, which costs more than reading them from JSON."""
    bucket = F.pmod(F.xxhash64("run_id", "step"), F.lit(buckets)).cast("int")
    packed = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return df.select(bucket.alias("bucket"), packed.alias("packed"), ts).groupBy("bucket")


def _packed(rows: Iterator[Row]) -> Iterator[list]:
    """The columns of rows that :func:`_bucketed` packed."""
    for row in rows:
        yield list(json.loads(row["packed"]).values())


def _watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    # withWatermark rejects TIMESTAMP_NTZ (H-17): use a session-zone timestamp.
    return (df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
            .withColumn("event_ms", F.unix_millis(ts)))


def _steps(turns: DataFrame, ts: str, delay: str, expire_ms: int, buckets: int) -> DataFrame:
    """X-01 with the columns of ``CHAIN_OUT``; its event time is ``ts``."""
    ship_package(turns.sparkSession)
    optional = {"reward_mode": "string", "group_size": "int"}
    have = turns.withColumns({c: F.lit(None).cast(t) for c, t in optional.items()
                              if c not in turns.columns})
    cols = ["run_id", "step", "g", "turn", "event_ms", *HELD_FIELDS]
    return (_bucketed(_watermarked(have, ts, delay), cols, ts, buckets)
            .transformWithState(EpisodeSteps(expire_ms), CHAIN_OUT, "Append", "EventTime",
                                eventTimeColumnName="ts"))


def episode_stream(turns: DataFrame, ts: str = "ts", delay: str = WATERMARK,
                   expire_ms: int = STATE_TIMEOUT_MS, buckets: int = BUCKETS) -> DataFrame:
    """X-01 over a streaming DataFrame of scored turns with ``run_id,
    step, g, turn, reward, solved, action, feedback, max_turns,
    entry_point, prompt`` and an event time ``ts``."""
    return _steps(turns, ts, delay, expire_ms, buckets).select(
        *[c.split()[0] for c in STEP_OUT.split(", ")])


def episode_batch_twin(turns: DataFrame) -> DataFrame:
    """The same result in batch form: W-08 trim + next prompt (P-07/P-08)."""
    from rewardlake.operators.episodes import trim_episodes
    t = trim_episodes(turns)
    nxt = F.when(F.col("done"), F.lit("")).otherwise(
        tx.revision_prompt("entry_point", "prompt", "action", "feedback"))
    return t.select("run_id", "step", "g", "turn", "reward", "solved", "done",
                    nxt.alias("next_prompt"), F.lit(False).alias("expired"))


def _advantages(rows):
    r = [x[1] for x in rows]
    n = len(r)
    mean = sum(r) / n
    std = math.sqrt(sum((x - mean) ** 2 for x in r) / (n - 1)) if n > 1 else float("nan")
    ok = n > 1 and std > 1e-6
    return [(g, x, ((x - mean) / (std + 1e-8)) if ok else 0.0) for g, x in rows]


class GroupBarrier(BucketProcessor):
    """X-02: the groups of a bucket, each by itself."""

    ENTRIES = MARKS

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rewards = handle.getListState("rewards", REWARDS)

    def _rows(self, name: tuple, got: dict, complete: bool) -> list[Row]:
        run_id, step, _ = name
        rows = sorted((int(g), math.nan if r is None else float(r)) for g, r in got.items())
        return [GROUP_ROW(run_id, step, g, _plain(x), _plain(a), complete)
                for g, x, a in _advantages(rows)]

    def _taken(self, names: set) -> dict[tuple, dict]:
        """The waiting rewards of the named groups by ``g``, which are removed."""
        taken, rest = {name: {} for name in names}, []
        for *name, g, reward in self.rewards.get() if names else ():
            if tuple(name) in taken:
                taken[tuple(name)][g] = reward
            else:
                rest.append((*name, g, reward))
        if rest:
            self.rewards.put(rest)
        elif names:
            self.rewards.clear()
        return taken

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer_ms, groups = self._saved()
        new: dict[tuple, dict[int, float | None]] = {}
        last: dict[tuple, int] = {}
        for run_id, step, size, g, reward, ms in _packed(rows):
            name = (run_id, step, size)
            last[name] = max(last.get(name, 0), ms or 0)
            got = new.setdefault(name, {})
            _, _, emitted, waiting = groups.get(name, NOT_SEEN)
            if not emitted and g not in got and g not in waiting:   # first delivery
                got[g] = _plain(reward)
        watermark = timerValues.getCurrentWatermarkInMs()
        full = {name for name, got in new.items() if self._fills(name, got, groups)}
        # rewards of a group that is full with this batch never enter the state
        taken = self._taken({name for name in full if groups.get(name, NOT_SEEN)[-1]})
        out: list[Row] = []
        added: list[tuple] = []
        for name, got in new.items():
            _, before_ms, emitted, waiting = groups.get(name, NOT_SEEN)
            last_ms = max(last[name], before_ms)
            if name in full:
                out.extend(self._rows(name, {**taken.get(name, {}), **got}, True))
                emitted, waiting = True, ()
            else:
                added.extend((*name, g, reward) for g, reward in got.items())
            groups[name] = [self._expiry(last_ms, watermark), last_ms, emitted,
                            [] if emitted else [*waiting, *got]]
        if added:
            self.rewards.appendList(added)
        self._save(timer_ms, groups)
        yield from out

    @staticmethod
    def _fills(name: tuple, got: dict, groups: dict) -> bool:
        _, _, emitted, waiting = groups.get(name, NOT_SEEN)
        return not emitted and len(waiting) + len(got) >= int(name[2])

    def _expired(self, gone: dict, watermark: int) -> list[Row]:
        taken = self._taken({name for name, (*_, waiting) in gone.items() if waiting})
        return [row for name, got in taken.items() for row in self._rows(name, got, False)]


def _barrier(finished: DataFrame, ts: str, expire_ms: int, buckets: int) -> DataFrame:
    """X-02 over rows that have a watermark and ``event_ms`` already."""
    cols = ["run_id", "step", "group_size", "g", "reward", "event_ms"]
    return (_bucketed(finished, cols, ts, buckets)
            .transformWithState(GroupBarrier(expire_ms), GROUP_OUT, "Append", "EventTime"))


def group_barrier(finished: DataFrame, ts: str = "ts", delay: str = WATERMARK,
                  expire_ms: int = STATE_TIMEOUT_MS, buckets: int = BUCKETS) -> DataFrame:
    """X-02 over finished trajectories ``run_id, step, g, reward,
    group_size, ts``: advantages once all G trajectories of a group
    finished; a group still open when the watermark passes it by
    ``expire_ms`` is flushed with ``complete = false``."""
    ship_package(finished.sparkSession)
    return _barrier(_watermarked(finished, ts, delay), ts, expire_ms, buckets)


def training_stream(turns: DataFrame, ts: str = "ts", delay: str = WATERMARK,
                    expire_ms: int = STATE_TIMEOUT_MS, buckets: int = BUCKETS) -> DataFrame:
    """X-01 into X-02 as one streaming query: scored turns (with ``reward_mode`` and
    ``group_size``) in, the advantages of each group out once its last trajectory has finished. The
    credited reward is the last or the best of the episode's turns (A-06)."""
    from rewardlake.operators.episodes import credit
    steps = _steps(turns, ts, delay, expire_ms, buckets).where("done and not expired")
    finished = steps.withColumn("final_reward", F.coalesce("reward", F.lit(0.0))).withColumn(
        "best_reward", F.coalesce("best_reward", F.lit(0.0)))
    return _barrier(finished.select("run_id", "step", "g", credit().alias("reward"), "group_size",
                                    F.unix_millis("ts").alias("event_ms"), "ts"),
                    "ts", expire_ms, buckets)


def training_twin(turns: DataFrame) -> DataFrame:
    """:func:`training_stream` in batch form, for the trajectories that finished without a gap in
    their turns: W-08, A-02..A-06, W-01, with ``complete``."""
    from rewardlake.operators import episodes as ep
    t = ep.trim_episodes(turns)
    traj = ep.trajectories(t, (*ep.TRAJ_KEYS, "group_size", "reward_mode"),
                           (F.bool_or("done").alias("finished"), F.max("turn").alias("last_turn"))
                           ).where(F.col("finished") & (F.col("n_turns") == F.col("last_turn") + 1))
    out = group_barrier_twin(traj.withColumn("reward", ep.credit()))
    return out.select("run_id", "step", "g", "reward", "advantage", "complete")


def state_sizes(query: StreamingQuery) -> list[dict]:
    """Of each stateful operator of ``query``, as of its last batch: the rows in state, the rows
    changed, and the bytes the state store holds in memory."""
    last = query.lastProgress
    return [{"operator": o["operatorName"], "rows": o["numRowsTotal"],
             "updated": o["numRowsUpdated"], "memory_bytes": o["memoryUsedBytes"]}
            for o in (last["stateOperators"] if last else [])]


def group_barrier_twin(finished: DataFrame) -> DataFrame:
    """X-02 in batch form: every finished trajectory with its group's
    advantage (W-01 over the trajectories present) and whether all G had
    finished (``complete``); the stream emits complete groups at once and
    the rest when the watermark times them out."""
    from pyspark.sql import Window

    from rewardlake.operators.groups import advantage
    w = Window.partitionBy("run_id", "step")
    out = advantage(finished, "reward", scale=True)
    return out.withColumn("complete", F.count(F.lit(1)).over(w) >= F.col("group_size"))
