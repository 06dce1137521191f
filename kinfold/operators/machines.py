"""State machines and activities over ordered events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ModelError


@dataclass(frozen=True)
class Transfer:
    """In `current`, an event for which `trigger` (event name, or a function of the event's columns) holds leads to `next`."""

    trigger: Any
    current: str
    next: str

    def holds(self, e: Callable[[str], Column], event: str) -> Column:
        return F.coalesce(self.trigger(e) if callable(self.trigger) else e(event) == self.trigger, F.lit(False))


@dataclass(frozen=True)
class StateMachine:
    initial: str
    transfers: tuple[Transfer, ...]
    states: tuple[str, ...] = ()
    values: dict[str, Callable] = field(default_factory=dict)

    def __post_init__(self):
        seen: dict[tuple, str] = {}
        for t in self.transfers:
            if not callable(t.trigger) and seen.setdefault((t.trigger, t.current), t.next) != t.next:
                raise ModelError(f"{t.trigger} in {t.current} leads to two states")

    def all_states(self) -> list[str]:
        return list(dict.fromkeys([self.initial, *self.states, *[s for t in self.transfers for s in (t.current, t.next)]]))

    def next_of(self, state: Column, e: Callable[[str], Column], event: str) -> Column:
        """The state after an event. Where triggers are functions, two that hold at once and lead to different states are an error."""
        out = state
        for t in reversed(self.transfers):
            out = F.when((state == t.current) & t.holds(e, event), F.lit(t.next)).otherwise(out)
        clash = F.lit(False)
        for i, t in enumerate(self.transfers):
            for u in self.transfers[:i]:
                if t.current == u.current and t.next != u.next and (callable(t.trigger) or callable(u.trigger)):
                    clash = clash | ((state == t.current) & t.holds(e, event) & u.holds(e, event))
        if any(callable(t.trigger) for t in self.transfers):
            out = F.when(clash, F.raise_error(F.lit("an event leads to two states")).cast("string")).otherwise(out)
        return out


def final_states(events: DataFrame, machine: StateMachine, key: list[str], order: list[str], event: str, chunk: Column) -> DataFrame:
    """(key, state) after all events of each key, in their order.

    An event is a function from states to states, and functions compose. Events of a key fold within chunks (a column that never decreases along the order,
    such as a day or a range of ids) for every state they may start in, then the chunks fold; a key with very many events is
    spread over as many groups as it has chunks."""
    states = machine.all_states()
    fields = sorted({event, *_fields(events)})
    ev = F.struct(*order, *[F.col(c).alias(c) for c in fields if c not in order])
    start = F.array(*[F.lit(s) for s in states])

    def step(acc: Column, e: Column) -> Column:
        return F.transform(acc, lambda s: machine.next_of(s, lambda c: e[c], event))

    part = events.withColumn("_chunk", chunk).groupBy(*key, "_chunk").agg(F.array_sort(F.collect_list(ev)).alias("es"))
    part = part.select(*key, "_chunk", F.aggregate("es", start, step).alias("to"))
    whole = part.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_chunk", "to"))).alias("cs"))
    at = lambda s: F.array_position(start, s).cast("int") - 1
    return whole.select(*key, F.aggregate("cs", F.lit(machine.initial), lambda s, c: F.get(c["to"], at(s))).alias("state"))


def initial_values(new: DataFrame, first: dict[str, StateMachine | Column | int | float | bool | str]) -> DataFrame:
    """Records as they are created, with the first value of each derived property: a machine's first state, or a value (0 for counts and sums,
    true for `every` of nothing, a column for what depends on the row). Properties that the payload has are left."""
    for name, v in first.items():
        if name not in new.columns:
            new = with_initial(new, v, name) if isinstance(v, StateMachine) else new.withColumn(name, v if isinstance(v, Column) else F.lit(v))
    return new


def with_initial(new: DataFrame, machine: StateMachine, name: str = "state", value: Column | None = None) -> DataFrame:
    """Records as they are created: in the machine's first state, or with the value that goes with it."""
    return new.withColumn(name, F.lit(machine.initial) if value is None else value)


def _fields(events: DataFrame) -> list[str]:
    return [c for c, t in events.dtypes if not t.startswith(("map", "variant"))]


def fold_values(events: DataFrame, machine: StateMachine, key: list[str], order: list[str], event: str, start: Column, value: Callable[[Column, Column, Callable], Column]) -> DataFrame:
    """(key, state, value): the value is recomputed from (last value, next state, event) whenever a transfer happens, and else kept.
    Any function may be given, so values don't compose and the events of one key fold in one task; see sum_values for those that do."""
    ev = F.struct(*order, *[c for c in _fields(events) if c not in order])
    init = F.struct(F.lit(machine.initial).alias("state"), start.alias("value"), F.lit(0).alias("moves"))

    def step(acc: Column, e: Column) -> Column:
        get = lambda c: e[c]
        nxt = machine.next_of(acc["state"], get, event)
        moved = F.lit(False)
        for t in machine.transfers:
            moved = moved | ((acc["state"] == t.current) & t.holds(get, event))
        return F.struct(nxt.alias("state"), F.when(moved, value(acc["value"], nxt, get)).otherwise(acc["value"]).alias("value"), (acc["moves"] + F.when(moved, 1).otherwise(0)).alias("moves"))

    g = events.groupBy(*key).agg(F.array_sort(F.collect_list(ev)).alias("es"))
    return g.select(*key, F.aggregate("es", init, step).alias("x")).select(*key, "x.state", "x.value", "x.moves")


def sum_values(events: DataFrame, machine: StateMachine, key: list[str], order: list[str], event: str, start: Column, add: Callable[[Column, Callable], Column], chunk: Column) -> DataFrame:
    """(key, state, value, moves): a value to which each transfer adds something that depends on the next state and the event alone. Such sums
    compose, so the events of a key fold by chunks (see final_states)."""
    states = machine.all_states()
    ev = F.struct(*order, *[c for c in _fields(events) if c not in order])
    names = F.array(*[F.lit(s) for s in states])
    begin = F.transform(names, lambda s: F.struct(s.alias("state"), F.lit(0.0).alias("value"), F.lit(0).cast("bigint").alias("moves")))

    def step(acc: Column, e: Column) -> Column:
        def one(s: Column) -> Column:
            get = lambda c: e[c]
            nxt, moved = machine.next_of(s["state"], get, event), F.lit(False)
            for t in machine.transfers:
                moved = moved | ((s["state"] == t.current) & t.holds(get, event))
            return F.struct(nxt.alias("state"), (s["value"] + F.when(moved, add(nxt, get).cast("double")).otherwise(0.0)).alias("value"), (s["moves"] + F.when(moved, 1).otherwise(0)).alias("moves"))

        return F.transform(acc, one)

    part = events.withColumn("_chunk", chunk).groupBy(*key, "_chunk").agg(F.array_sort(F.collect_list(ev)).alias("es"))
    part = part.select(*key, "_chunk", F.aggregate("es", begin, step).alias("to"))
    whole = part.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_chunk", "to"))).alias("cs"))

    def after(s: Column, c: Column) -> Column:
        t = F.get(c["to"], F.array_position(names, s["state"]).cast("int") - 1)
        return F.struct(t["state"].alias("state"), (s["value"] + t["value"]).alias("value"), (s["moves"] + t["moves"]).alias("moves"))

    first = F.struct(F.lit(machine.initial).alias("state"), start.cast("double").alias("value"), F.lit(0).cast("bigint").alias("moves"))
    return whole.select(*key, F.aggregate("cs", first, after).alias("x")).select(*key, "x.state", "x.value", "x.moves")


def targets(events: DataFrame, ids: Column, name: str = "target") -> DataFrame:
    """One row for each record that an event concerns: an id, an array of ids, or pairs of arrays (source and target, crossed)."""
    kind = events.select(ids.alias("x")).schema["x"].dataType.typeName()
    if kind == "struct":
        return events.withColumn("source", F.explode(ids["source"])).withColumn(name, F.explode(ids[name]))
    return events.withColumn(name, F.explode(F.array_distinct(ids))) if kind == "array" else events.withColumn(name, ids)


@dataclass
class Group:
    """Branches of interactions: `any` keeps the first branch that moves, `every` needs all, `race` ends with the first to end."""

    kind: str
    branches: list[list[str]]


@dataclass
class Activity:
    """One chain of interactions and groups. Events fold in order; an interaction that isn't available is refused."""

    chain: list[str | Group]

    def __post_init__(self):
        if not self.chain or not isinstance(self.chain[0], str):
            raise ModelError("an activity begins with an interaction")
        for g in self.chain:
            if isinstance(g, Group) and (g.kind not in ("any", "every", "race") or not all(g.branches)):
                raise ModelError("a group is any, every or race, with branches that aren't empty")

    def run(self, names: list[str]) -> tuple[str, int, int]:
        """(where it stands: a step number, `done` or `none`; accepted, refused)."""
        at, accepted, refused = -1, 0, 0
        pos: list[int] = []
        chosen: int | None = None

        def enter() -> None:
            nonlocal pos, chosen
            if 0 <= at < len(self.chain) and isinstance(self.chain[at], Group):
                pos, chosen = [0] * len(self.chain[at].branches), None

        for n in names:
            if at == len(self.chain):
                refused += 1
                continue
            node = self.chain[max(at, 0)]
            if isinstance(node, str):
                if n == node:
                    accepted, at = accepted + 1, max(at, 0) + 1
                    enter()
                else:
                    refused += 1
                continue
            open_ = [i for i, b in enumerate(node.branches) if pos[i] < len(b) and b[pos[i]] == n and (chosen is None or chosen == i)]
            if not open_:
                refused += 1
                continue
            i = open_[0]
            pos[i], accepted = pos[i] + 1, accepted + 1
            if node.kind == "any":
                chosen = i
            ended = [p == len(b) for p, b in zip(pos, node.branches)]
            if all(ended) if node.kind == "every" else ended[i]:
                at += 1
                enter()
        return "none" if at < 0 else "done" if at == len(self.chain) else str(at), accepted, refused


    def table(self) -> tuple[list[str], list[dict[str, int]], list[str]]:
        """The activity as an automaton: (names, for each state where each accepted name leads, for each state where it stands).
        State 0 is the first; a name that isn't in a state's mapping is refused there."""
        names = list(dict.fromkeys(n for c in self.chain for n in ([c] if isinstance(c, str) else [x for b in c.branches for x in b])))
        # a state is the accepted names that lead to it, in one of the ways; equal futures are told apart by place, positions and branch
        found: dict[tuple, int] = {}
        paths: list[tuple[str, ...]] = []
        moves: list[dict[str, int]] = []

        def state(path: tuple[str, ...]) -> int:
            k = self._mark(path)
            if k not in found:
                found[k] = len(paths)
                paths.append(path)
                moves.append({})
            return found[k]

        state(())
        at = 0
        while at < len(paths):
            for n in names:
                if self.run([*paths[at], n])[1] > len(paths[at]):
                    moves[at][n] = state((*paths[at], n))
            at += 1
        return names, moves, [self.run(list(p))[0] for p in paths]

    def _mark(self, accepted: tuple[str, ...]) -> tuple:
        """Where accepted names lead: the step, and what is left of it."""
        at, inside = -1, 0
        for k in range(len(accepted) + 1):  # the names since the step began
            step = self.run(list(accepted[:k]))[0]
            if step != at:
                at, inside = step, k
        node = self.chain[int(at)] if at not in ("none", "done") else None
        if not isinstance(node, Group):
            return (at,)
        pos, chosen = [0] * len(node.branches), None
        for n in accepted[inside:]:
            i = next(i for i, b in enumerate(node.branches) if pos[i] < len(b) and b[pos[i]] == n and (chosen is None or chosen == i))
            pos[i] += 1
            chosen = i if node.kind == "any" else None
        return (at, tuple(pos), chosen)


def run_activities(events: DataFrame, activity: Activity, key: str, order: list[str], event: str, chunk: Column | None = None) -> DataFrame:
    """(key, step, accepted, refused) of each activity instance.

    The activity is an automaton. The events of an instance fold within chunks (see final_states; without one, all of an instance are one chunk)
    for every state they may start in, and chunks compose, so an instance with very many events is spread out."""
    names, moves, stands = activity.table()
    size, refused = len(names), -1
    # state * size + name to the next state, as one array
    leads = F.array(*[F.lit(m.get(n, refused)) for m in moves for n in names])
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(event)).cast("int") - 1
    ev = F.struct(*order, code.alias("_code"))
    begin = F.array(*[F.struct(F.lit(s).alias("to"), F.lit(0).cast("bigint").alias("ok"), F.lit(0).cast("bigint").alias("no")) for s in range(len(moves))])

    def step(acc: Column, e: Column) -> Column:
        def one(s: Column) -> Column:
            to = F.get(leads, s["to"] * size + e["_code"])
            return F.struct(F.when(to < 0, s["to"]).otherwise(to).alias("to"), (s["ok"] + F.when(to < 0, 0).otherwise(1)).alias("ok"), (s["no"] + F.when(to < 0, 1).otherwise(0)).alias("no"))

        return F.transform(acc, one)

    part = events.filter(F.col(event).isin(*names)).withColumn("_chunk", F.lit(0) if chunk is None else chunk)
    part = part.groupBy(key, "_chunk").agg(F.array_sort(F.collect_list(ev)).alias("es")).select(key, "_chunk", F.aggregate("es", begin, step).alias("to"))
    whole = part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_chunk", "to"))).alias("cs"))

    def after(s: Column, c: Column) -> Column:
        t = F.get(c["to"], s["to"])
        return F.struct(t["to"].alias("to"), (s["ok"] + t["ok"]).alias("ok"), (s["no"] + t["no"]).alias("no"))

    first = F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("ok"), F.lit(0).cast("bigint").alias("no"))
    out = whole.select(key, F.aggregate("cs", first, after).alias("x"))
    return out.select(key, F.get(F.array(*[F.lit(s) for s in stands]), F.col("x.to")).alias("step"), F.col("x.ok").alias("accepted"), F.col("x.no").alias("refused"))
