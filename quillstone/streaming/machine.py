"""State machines: a pure step, a batch fold over ordered events, and the same as a stateful stream."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import scalars as S

_WORDS = {True: "on", False: "off", None: "null"}


def seconds(value: Any) -> float:
    """Of a number, or of a text such as 1h30m, by the rules of functions.scalars.to_seconds."""
    if value is None:
        return 0.0
    if isinstance(value, int | float):
        return float(value)
    text = str(value).strip()
    if re.match(S.FLOAT, text):
        return float(text)
    lead = re.match(rf"(?:{S.PART})+", text)
    return sum((float(n) * S.SECONDS.get(u.lower(), 0) for n, u in re.findall(S.PART, lead[0])), 0.0) if lead else 0.0


def _texts(value: Any) -> Any:
    """Mapping keys as text: YAML 1.1 reads on and off as booleans."""
    if isinstance(value, dict):
        return {_WORDS[k] if k is None or isinstance(k, bool) else str(k): _texts(v) for k, v in value.items()}
    return [_texts(v) for v in value] if isinstance(value, list) else value


def _state_name(value: Any) -> str:
    return _WORDS[value] if isinstance(value, bool) else str(value)


@dataclass
class Machine:
    """States by name; each has transitions, tried in order: when all of its conditions hold, or always without any."""

    config: dict[str, Any]
    start: str = "start"
    states: dict[str, dict] = field(init=False)

    def __post_init__(self) -> None:
        self.config = _texts(self.config)
        self.states = self.config["states"]
        if self.start not in self.states:
            raise ValueError(f"no state {self.start!r}")

    @staticmethod
    def holds(when: dict[str, Any], env: dict[str, Any], elapsed: float) -> bool:
        """All conditions; one on a name that the environment lacks doesn't count."""
        for key, wanted in when.items():
            if key == "elapsed":
                if elapsed < seconds(wanted):
                    return False
            elif key in env and env[key] != wanted:
                return False
        return True

    def choices(self, state: str, env: dict[str, Any]) -> list[tuple[float, str]]:
        """(least seconds in the state, state entered) of the transitions that the environment allows, in the order they are tried."""
        out, fallback = [], []
        for transition in (self.states[state].get("transitions") or {}).values():
            if "when" not in transition:
                fallback.append(transition)
            elif self.holds(when := transition["when"] or {}, env, math.inf):
                out.append((seconds(when["elapsed"]) if "elapsed" in when else -math.inf, _state_name(transition["state"])))
        return out + [(-math.inf, _state_name(t["state"])) for t in fallback[:1]]

    def next(self, state: str, env: dict[str, Any], elapsed: float = 0.0) -> str | None:
        """The state that is entered now; None if none is. A state without transitions is final."""
        return next((to for least, to in self.choices(state, env) if not elapsed < least), None)

    def wait(self, state: str, env: dict[str, Any], elapsed: float) -> float | None:
        """Seconds until a transition is due by the passing of time alone; None if none ever is."""
        due = []
        for transition in (self.states[state].get("transitions") or {}).values():
            when = transition.get("when") or {}
            if "elapsed" in when and (left := seconds(when["elapsed"]) - elapsed) > 0 and self.holds(when, env, math.inf):
                due.append(left)
        return min(due, default=None)


class Runner:
    """One running machine: environment, current state, and a callback that may change or veto a transition."""

    def __init__(self, machine: Machine, env: dict[str, Any] | None = None, callback: Callable | None = None, clock: Callable[[], float] | None = None):
        import time

        self.machine, self.env, self.callback, self.clock = machine, env if env is not None else {}, callback, clock or time.time
        self.enter(machine.start)

    def enter(self, state: str) -> None:
        if state not in self.machine.states:
            raise ValueError(f"no state {state!r}")
        self.state, self.entered = state, self.clock()

    def tick(self) -> bool:
        """Whether a transition was taken."""
        to = self.machine.next(self.state, self.env, self.clock() - self.entered)
        if to is None or (self.callback and not self.callback(self, to)):
            return False
        self.enter(to)
        return True

    def run(self) -> int:
        """Ticks until nothing happens; how many transitions were taken. A machine that never rests never returns."""
        n = 0
        while self.tick():
            n += 1
        return n

    def save(self) -> dict[str, Any]:
        return {"config": self.machine.config, "environment": dict(self.env), "last_state": self.state}

    @classmethod
    def load(cls, saved: dict[str, Any], callback: Callable | None = None, with_env: bool = True) -> Runner:
        runner = cls(Machine(saved["config"]), dict(saved["environment"] or {}) if with_env else {}, callback)
        runner.enter(_state_name(saved["last_state"]))
        return runner


def _step(machine: Machine, state: str, env: dict, entered: float, at: float, change: str | None) -> tuple[str, dict, float, bool]:
    env = {**env, **(json.loads(change) if change else {})}
    to = machine.next(state, env, at - entered)
    return (state, env, entered, False) if to is None else (to, env, at, True)


#: Environments whose transitions a fold keeps worked out.
_KNOWN = 4096


class _Envs:
    """Environments by number, of the names that conditions ask for, with the choices of each state; forgotten when they are many."""

    def __init__(self, machine: Machine):
        transitions = (t for s in machine.states.values() for t in ((s or {}).get("transitions") or {}).values())
        self.machine, self.asked = machine, {name for t in transitions for name in t.get("when") or {}}
        self.forget()

    def forget(self) -> None:
        self.envs, self.numbers, self.changed, self.choices = [{}], {"{}": 0}, {}, {}

    def change(self, number: int, what: str) -> int:
        """The number of the environment that the change makes of this one; 0 is the empty one."""
        if (found := self.changed.get((number, what))) is not None:
            return found
        env = {k: v for k, v in {**self.envs[number], **json.loads(what)}.items() if k in self.asked}
        if full := len(self.changed) >= _KNOWN:
            self.forget()
        found = self.numbers.setdefault(json.dumps(env, sort_keys=True), len(self.envs))
        if found == len(self.envs):
            self.envs.append(env)
        if not full:
            self.changed[number, what] = found
        return found

    def of(self, state: str, number: int) -> list[tuple[float, str]]:
        if (found := self.choices.get((state, number))) is None:
            found = self.choices[state, number] = self.machine.choices(state, self.envs[number])
        return found


def fold(events: DataFrame, machine: Machine, *, key: str, at: str, order: str, change: str) -> DataFrame:
    """key, order, state after each event, and whether it was entered then: the events of each key in (at, order).

    change: a JSON object of what the event sets in the environment. at: a timestamp; order breaks its ties.
    Events are sorted by key on disk and read as one stream, so that neither many keys nor many events of a key cost more than their rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        envs = _Envs(machine)
        last, state, env, entered = None, machine.start, 0, 0.0
        for batch in batches:
            states, moves = [], []
            for k, when, what in zip(batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).tolist(), batch.column(3).to_pylist()):
                if k != last:
                    last, state, env, entered = k, machine.start, 0, when
                env = envs.change(env, what) if what else env
                moved = False
                for least, to in envs.of(state, env):
                    if not when - entered < least:
                        state, entered, moved = to, when, True
                        break
                states.append(state)
                moves.append(moved)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(states, pa.string()), pa.array(moves, pa.bool_())], ["key", "order", "state", "entered"])

    rows = events.select(F.col(key).cast("bigint").alias("_key"), F.col(order).cast("bigint").alias("_order"), F.unix_micros(F.col(at).cast("timestamp")).cast("double").alias("_us"), F.col(change).alias("_change"))
    rows = rows.select("_key", "_order", (F.col("_us") / 1e6).alias("_at"), "_change").where("_key is not null")
    rows = rows.repartition("_key").sortWithinPartitions("_key", F.asc_nulls_last("_at"), F.asc_nulls_last("_order"))
    return rows.mapInArrow(run, "key bigint, order bigint, state string, entered boolean")


def stream(events: DataFrame, machine: Machine, *, key: str, at: str, order: str, change: str) -> DataFrame:
    """The same over a stream, in the order of arrival: state lives with each key and is never forgotten.

    A transition that is due by time alone is taken without an event, once a processing-time timer of what was left of its time
    has run; its row has a null order, and it counts as entered at the time it was due.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    columns = ["key", "order", "state", "entered"]

    def run(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, env, entered, last, due = held.get if held.exists else (machine.start, "{}", float("nan"), float("nan"), None)
        env, rows = json.loads(env), []
        if held.hasTimedOut:
            state, env, entered, moved = _step(machine, state, env, entered, due, None)
            last = due
            rows += [(group[0], None, state, True)] if moved else []
        else:
            pdf = pd.concat(list(batches)).sort_values(["_at", "_order"], kind="stable")
            for when, number, what in zip(pdf["_at"], pdf["_order"], pdf["_change"]):
                entered, last = when if entered != entered else entered, when
                state, env, entered, moved = _step(machine, state, env, entered, when, what)
                rows.append((group[0], number, state, moved))
        left = machine.wait(state, env, last - entered)
        held.update((state, json.dumps(env), entered, last, None if left is None else last + left))
        if left is not None:
            held.setTimeoutDuration(max(1, math.ceil(left * 1000)))
        yield pd.DataFrame(rows, columns=columns).astype({"order": "Int64"})

    rows = events.select(F.col(key).cast("bigint").alias("_key"), F.col(order).cast("bigint").alias("_order"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("_at"), F.col(change).alias("_change"))
    return rows.where("_key is not null").groupBy("_key").applyInPandasWithState(run, "key bigint, order bigint, state string, entered boolean", "state string, env string, entered double, last double, due double", "append", GroupStateTimeout.ProcessingTimeTimeout)
