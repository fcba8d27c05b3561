"""Per-topic state of users from their events: replayed in batch, and as a stream with state.

An event is an answer (submit, with good 0 or 1 and a difficulty), a skip, an override of the level, or a revoke, which takes
back the last answer of its topic that still counts. Levels and difficulties are 0, 1 and 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Step of the score, its start, thresholds, answers that are looked back on and how many of them must
# qualify, answers that full coverage takes, and weights of right and wrong answers to easier, like and harder questions.
STEP, START, UP, DOWN, LAST, NEEDED, COVERED = 0.2, 0.5, 0.75, 0.25, 3, 2, 5
RIGHT_WEIGHTS, WRONG_WEIGHTS = (0.5, 1.0, 1.0), (1.0, 1.0, 0.5)


class State(NamedTuple):
    level: int
    score: float = START
    since: int = 0  # answers since the level changed
    recent: tuple = ()  # (good, difficulty) of the last answers since then
    attempts: int = 0
    right: int = 0


def answered(s: State, good: int, difficulty: int) -> State:
    """The state after an answer. A level moves when the score passes a threshold and enough of a full window qualify."""
    relation = (difficulty > s.level) - (difficulty < s.level) + 1
    score = s.score + STEP * (RIGHT_WEIGHTS if good else WRONG_WEIGHTS)[relation] * (good - s.score)
    recent = (*s.recent, (good, difficulty))[-LAST:]
    level = s.level
    if len(recent) == LAST:
        if s.level < 2 and score >= UP:
            level += sum(g == 1 and d > s.level for g, d in recent) >= NEEDED
        elif s.level > 0 and score <= DOWN:
            level -= sum(g == 0 and d <= s.level for g, d in recent) >= NEEDED
    if level != s.level:
        return State(level, attempts=s.attempts + 1, right=s.right + good)
    return State(level, score, s.since + 1, recent, s.attempts + 1, s.right + good)


class Replay:
    """A topic's state while its events come in order, with the states that later revocations may return to."""

    def __init__(self, level: int) -> None:
        self.now, self.undo = State(level), []

    def take(self, kind: str, good: int, difficulty: int, level: int, revokes_ahead: int) -> int:
        """Takes an event; 1 or -1 if an answer moved the level, else 0."""
        before = self.now
        if kind == "submit":
            self.undo.append(before)
            self.now = answered(before, good, difficulty)
        elif kind == "override":
            self.now = State(level, attempts=before.attempts, right=before.right)
            self.undo = [State(level, attempts=s.attempts, right=s.right) for s in self.undo]
        elif kind == "revoke" and self.undo:
            self.now = self.undo.pop()
        del self.undo[: max(0, len(self.undo) - revokes_ahead)]
        return (self.now.level > before.level) - (self.now.level < before.level) if kind == "submit" else 0


REPLAYED = [("move", "int"), ("level", "int"), ("score", "double"), ("since", "int"), ("attempts", "int"), ("right_ones", "int")]


def replayed(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each event (keys, order, kind, good, difficulty, level, start) with the state after it: (keys, place, kind, move, ...).

    Events are dealt by keys, sorted, and pass through as they come: a task holds one state, and as many earlier ones as
    there are revocations ahead, however many events a key has. Those are a key's revocations less the ones that have come, so
    no window goes over a key. start is the level before all events.
    """
    revoked = events.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count_if(F.col("kind") == "revoke").alias("revocations"))
    rows = events.join(revoked, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "kind", "good", "difficulty", "level", "start", "revocations")
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("place", T.IntegerType()), *rows.select("kind").schema.fields, *T._parse_datatype_string(", ".join(map(" ".join, REPLAYED))).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, replay, place, ahead = None, None, 0, 0
        for df in batches:
            out = []
            for *key, kind, good, difficulty, level, start, revocations in zip(*(df[c].tolist() for c in df.columns), strict=True):
                key = [None if k != k else k for k in key]
                if key != last:
                    last, replay, place, ahead = key, Replay(int(start)), 0, revocations
                place += 1
                ahead -= kind == "revoke"
                move = replay.take(kind, int(good == 1), int(difficulty), int(level), int(ahead))
                s = replay.now
                out.append((*key, place, kind, move, s.level, s.score, s.since, s.attempts, s.right))
            yield pd.DataFrame(out, columns=schema.names)

    return rows.mapInPandas(run, schema)


def states(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, attempts, right_ones, score, level, since, coverage): each group's state after all its events."""
    last = F.max_by(F.struct("attempts", "right_ones", "score", "level", "since"), "place")
    rows = replayed(events, keys, order).groupBy(*keys).agg(last.alias("s"))
    return rows.select(*keys, "s.attempts", "s.right_ones", F.round("s.score", 8).alias("score"), "s.level", "s.since", F.least(F.lit(1.0), F.col("s.since") / COVERED).alias("coverage"))


def stream_states(events: DataFrame, keys: list[str], order: list[str], *, undo: int = 100) -> DataFrame:
    """The same over a stream: each trigger gives the groups' new states. Events of a group must come in order of triggers.

    A group's state keeps the states before its last undo answers for revocations to come; one that reaches further back
    is left out, as one without an answer is.
    """
    types = dict(events.dtypes)
    kinds = ", ".join(f"{k} {types[k]}" for k in keys)
    columns = "attempts int, right_ones int, score double, level int, since int"

    def packed(s: State) -> list:
        return [s.level, s.score, s.since, [list(r) for r in s.recent], s.attempts, s.right]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import json

        rows = pd.concat(batches).sort_values(order)
        replay = Replay(int(rows["start"].iloc[0]))
        if state.exists:
            held = [State(level, score, since, tuple(map(tuple, recent)), attempts, right) for level, score, since, recent, attempts, right in json.loads(state.get[0])]
            replay.now, replay.undo = held[0], held[1:]
        for kind, good, difficulty, level in zip(*(rows[c].tolist() for c in ("kind", "good", "difficulty", "level")), strict=True):
            replay.take(kind, int(good == 1), int(difficulty), int(level), undo)
        state.update((json.dumps([packed(s) for s in (replay.now, *replay.undo)]),))
        s = replay.now
        yield pd.DataFrame([[*key, s.attempts, s.right, round(s.score, 8), s.level, s.since]], columns=[*keys, "attempts", "right_ones", "score", "level", "since"])

    return events.groupBy(*keys).applyInPandasWithState(update, f"{kinds}, {columns}", "held string", "update", "NoTimeout")
