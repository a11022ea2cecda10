"""Sequential per-key folds as Spark jobs.

A fold carries a small state from row to row (a kept timestamp, a machine
state, an undo depth). Keys within the group limit are hashed to tasks, sorted
there and streamed batch by batch with only the state held in memory.

A larger key is cut into ordered chunks. Each chunk is first reduced, in
parallel, to a summary saying what it does to any entry state; one short pass
over the summaries of a key gives every chunk its entry state; then all chunks
run in parallel from there. Both ways give the same rows.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.plans.ordered import CHUNK, chunk_rows, group_limit, null_safe, split_hot
from folioworks.session import spread_partitions


class Fold:
    """What a sequential fold must define. States and summaries are JSON values."""

    #: name -> Spark type of the columns the fold adds
    outputs: dict[str, T.DataType] = {}
    #: columns of the input that the fold reads
    inputs: list[str] = []

    def initial(self):
        raise NotImplementedError

    def run(self, rows, state):
        """Fold consecutive rows of one key, given as columns by name; return (dict of output lists, state)."""
        raise NotImplementedError

    def summarise(self, rows: pd.DataFrame):
        """What the rows do to any entry state."""
        raise NotImplementedError

    def apply_summary(self, state, summary):
        """The exit state of a summarised chunk entered in `state`."""
        raise NotImplementedError


# outputs are never null, so numbers and flags can be plain arrays
ARRAY_TYPES = {T.BooleanType: bool, T.LongType: "int64"}


def fold_rows(
    df: DataFrame, keys: list[str], order: list[str], fold: Fold, limit: int | None = None,
    widen: Callable[[DataFrame, bool], DataFrame] | None = None,
) -> DataFrame:
    """Add the fold's output columns to df; `order` must be a total order in a key.

    widen may add columns that the fold reads to rows. It gets those of small keys dealt by key, as the fold needs them, and is told
    so; if it leaves them there, they are moved once.
    """
    limit = group_limit(df, limit)
    cold, hot, hot_rows = split_hot(df, keys, limit)
    if widen is not None:
        cold = widen(cold.repartition(spread_partitions(df.sparkSession), *keys), True)
        hot = hot if hot is None else widen(hot, False)
    streamed = _folded(cold, keys, order, fold, cold.columns)
    if hot is None:
        return streamed
    chunks = chunk_rows(hot, keys, order, hot_rows, limit)
    entries = _entry_states(chunks, keys, order, fold)
    entered = chunks.join(entries, null_safe(chunks, entries, [*keys, CHUNK], "_e_")).select(
        *chunks.columns, "_state"
    )
    return streamed.unionByName(_folded(entered, [*keys, CHUNK], order, fold, cold.columns, entry="_state"))


def _folded(
    df: DataFrame, keys: list[str], order: list[str], fold: Fold, columns: list[str], entry: str | None = None
) -> DataFrame:
    """Hash and sort by key, then fold each task's rows in their order.

    Only the key and the fold's inputs cross to Python; the iterator keeps its
    state from batch to batch. It counts as non-deterministic, so the optimizer
    neither repeats it nor drops the sort before it.
    """
    used = list(dict.fromkeys([*keys, *fold.inputs, *([entry] if entry else [])]))
    added = T.StructType([T.StructField(name, kind) for name, kind in fold.outputs.items()])
    stream = F.pandas_udf(_stream(keys, fold, entry), added).asNondeterministic()
    # a fixed count: Python work is costly per byte, so small partitions must not merge
    n = spread_partitions(df.sparkSession)
    ordered = df.repartition(n, *keys).sortWithinPartitions(*keys, *order)
    folded = ordered.withColumn("_f", stream(F.struct(*used)))
    return folded.select(*columns, *[F.col(f"_f.{name}").alias(name) for name in fold.outputs])


def key_cuts(columns: list[np.ndarray]) -> list[int]:
    """Where runs of consecutive rows with equal keys begin, and the end; nulls are equal."""
    n = len(columns[0])
    changed = np.zeros(n, dtype=bool)
    for values in columns:
        differs = values[1:] != values[:-1]
        both_null = pd.isna(values[1:]) & pd.isna(values[:-1])
        changed[1:] |= (differs & ~both_null).astype(bool)
    return [0, *np.flatnonzero(changed).tolist(), n] if n else [0]


def _key_of(columns: list[np.ndarray], i: int) -> tuple:
    return tuple(None if pd.isna(c[i]) else c[i] for c in columns)


def _stream(keys: list[str], fold: Fold, entry: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            added: dict[str, list] = {name: [] for name in fold.outputs}
            # most keys have few rows, for which slices of a frame cost far more than the fold
            columns = {c: batch[c].to_numpy() for c in batch.columns}
            key_columns = [columns[k] for k in keys]
            cuts = key_cuts(key_columns)
            for start, end in zip(cuts[:-1], cuts[1:]):
                key = _key_of(key_columns, start)
                if current != key:
                    current = key
                    state = json.loads(columns[entry][start]) if entry else fold.initial()
                out, state = fold.run({c: columns[c][start:end] for c in fold.inputs}, state)
                for name in added:
                    added[name].extend(out[name])
            yield pd.DataFrame(
                {
                    name: pd.Series(values, dtype=ARRAY_TYPES.get(type(fold.outputs[name]), object))
                    for name, values in added.items()
                }
            )

    return run


def _entry_states(chunks: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """One row per (key, chunk) with the state the chunk starts from."""
    needed = [c for c in chunks.columns if c in {*keys, *order, *fold.inputs, CHUNK}]
    key_fields = [chunks.schema[k] for k in keys]
    chunk_field = T.StructField(CHUNK, T.IntegerType())
    summary_schema = T.StructType([*key_fields, chunk_field, T.StructField("_summary", T.StringType())])

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        head = rows.iloc[[0]][[*keys, CHUNK]].copy()
        head["_summary"] = json.dumps(fold.summarise(rows))
        return head

    summaries = (
        chunks.select(*needed).groupBy(*keys, CHUNK).applyInPandas(summarise, summary_schema)
    )

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            states = []
            key_columns = [batch[k].to_numpy() for k in keys]
            for i in range(len(batch)):
                key = _key_of(key_columns, i)
                if current != key:
                    current, state = key, fold.initial()
                states.append(json.dumps(state))
                state = fold.apply_summary(state, json.loads(batch["_summary"].iloc[i]))
            out = batch[[*keys, CHUNK]].rename(columns={c: "_e_" + c for c in [*keys, CHUNK]})
            out["_state"] = states
            yield out

    entry_schema = T.StructType(
        [
            *[T.StructField("_e_" + f.name, f.dataType) for f in key_fields],
            T.StructField("_e_" + CHUNK, T.IntegerType()),
            T.StructField("_state", T.StringType()),
        ]
    )
    return (
        summaries.repartition(*keys)
        .sortWithinPartitions(*keys, CHUNK)
        .mapInPandas(entries, entry_schema)
    )


class StateMachine(Fold):
    """Follow a transition table; an illegal event leaves the state as it was.

    The summary of a chunk is the exit state for every possible entry state.
    """

    outputs = {
        "state_before": T.StringType(),
        "state_after": T.StringType(),
        "accepted": T.BooleanType(),
    }

    def __init__(self, event: str, start: str, moves: dict[str, list[str]]):
        self.event, self.start = event, start
        self.moves = {state: set(targets) for state, targets in moves.items()}
        self.inputs = [event]

    def initial(self):
        return self.start

    def run(self, rows, state):
        before, after, accepted = [], [], []
        for event in rows[self.event]:
            ok = event in self.moves.get(state, ())
            before.append(state)
            state = event if ok else state
            after.append(state)
            accepted.append(ok)
        return {"state_before": before, "state_after": after, "accepted": accepted}, state

    def summarise(self, rows):
        return {state: self.run(rows, state)[1] for state in self.moves}

    def apply_summary(self, state, summary):
        return summary[state]


class Threshold(Fold):
    """Greedy runs over non-decreasing numbers: open a new run when the distance
    from the run's first `start` to the row's `end` passes `reach`.

    With inclusive=True a distance equal to `reach` already opens a new run.
    The state is the `start` of the open run and how many runs were opened.
    """

    outputs = {"opens": T.BooleanType(), "run": T.LongType()}

    def __init__(self, start: str, end: str, reach: int, inclusive: bool):
        self.start, self.end, self.reach, self.inclusive = start, end, reach, inclusive
        self.inputs = list({start, end})

    def initial(self):
        return {"open": None, "runs": 0}

    def _cut(self, opened: int, ends: list[int], low: int) -> int:
        """First position from `low` on that can not join the run opened at `opened`."""
        find = bisect.bisect_left if self.inclusive else bisect.bisect_right
        return find(ends, opened + self.reach, low)

    def _columns(self, rows):
        return [int(v) for v in rows[self.start]], [int(v) for v in rows[self.end]]

    def run(self, rows, state):
        starts, ends = self._columns(rows)
        opened, runs = state["open"], state["runs"]
        n = len(starts)
        opens, numbers = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        i = 0
        while i < n:
            cut = i if opened is None else self._cut(opened, ends, i)
            numbers[i:cut] = runs
            if cut == n:
                break
            # a run always takes its first row, however large it is
            opened, runs = starts[cut], runs + 1
            opens[cut], numbers[cut] = True, runs
            i = cut + 1
        return {"opens": opens.tolist(), "run": numbers.tolist()}, {"open": opened, "runs": runs}

    def summarise(self, rows):
        starts, ends = self._columns(rows)
        n = len(starts)
        # chain[i]: (runs opened, last open start) when a run opens at row i
        chain: list[tuple[int, int]] = [(0, 0)] * n
        for i in range(n - 1, -1, -1):
            cut = self._cut(starts[i], ends, i + 1)
            chain[i] = (1, starts[i]) if cut == n else (chain[cut][0] + 1, chain[cut][1])
        # the entry state lies at or before the first row, so its first cut is not
        # later than the cut of a run opened at the first row
        last = self._cut(starts[0], ends, 1)
        table = [[ends[i] - self.reach, *chain[i]] for i in range(min(last + 1, n))]
        return {"first": chain[0], "table": table}

    def apply_summary(self, state, summary):
        if state["open"] is None:
            count, opened = summary["first"]
            return {"open": opened, "runs": state["runs"] + count}
        find = bisect.bisect_left if self.inclusive else bisect.bisect_right
        bounds = [entry[0] for entry in summary["table"]]
        # row i is cut off when bound_i is past (or, inclusive, at) the open start
        i = find(bounds, state["open"])
        if i == len(bounds):
            return state
        _, count, opened = summary["table"][i]
        return {"open": opened, "runs": state["runs"] + count}


class UndoRedo(Fold):
    """Depth of the journal and of the redo stack after every operation.

    `undo` and `redo` move one operation between the stacks and fail on an empty
    one; anything else is pushed on the journal and clears the redo stack.
    """

    outputs = {
        "ok": T.BooleanType(),
        "journal_depth": T.LongType(),
        "redo_depth": T.LongType(),
    }

    def __init__(self, kind: str):
        self.kind = kind
        self.inputs = [kind]

    def initial(self):
        return [0, 0]

    def run(self, rows, state):
        depth, redo = state
        ok, depths, redos = [], [], []
        for kind in rows[self.kind]:
            done = True
            if kind == "undo":
                done = depth > 0
                depth, redo = (depth - 1, redo + 1) if done else (depth, redo)
            elif kind == "redo":
                done = redo > 0
                depth, redo = (depth + 1, redo - 1) if done else (depth, redo)
            else:
                depth, redo = depth + 1, 0
            ok.append(done)
            depths.append(depth)
            redos.append(redo)
        return {"ok": ok, "journal_depth": depths, "redo_depth": redos}, [depth, redo]

    def summarise(self, rows):
        """What a chunk does to any entry state, in a summary no longer than the chunk.

        Before the first push, depth + redo stays the same number and the depth walks between 0 and it: a shift
        clamped at both ends while that number is at least the walk's range, below that one end value per number.
        From the first push on the redo stack is known, and only small depths meet an empty journal.
        """
        kinds = rows[self.kind].to_numpy()
        undo, redo = kinds == "undo", kinds == "redo"
        pushes = ~(undo | redo)
        first = int(np.argmax(pushes)) if pushes.any() else len(kinds)
        steps = redo[:first].astype(int) - undo[:first].astype(int)
        walk = np.concatenate(([0], np.cumsum(steps)))
        shift, width = int(walk[-1]), int(walk.max() - walk.min())
        total = np.arange(width)
        ends = np.zeros(width, dtype=int)
        for step in steps if width else []:
            ends = np.clip(ends + step, 0, total)
        summary = {"shift": shift, "low": shift - int(walk.min()), "high": int(walk.max()) - shift, "ends": ends.tolist()}
        if first < len(kinds):
            undo, redo, pushes = undo[first + 1 :], redo[first + 1 :], pushes[first + 1 :]
            # depths from here on never meet an empty journal, whatever redos do
            deep = int(max(0, np.cumsum(undo.astype(int) - pushes.astype(int)).max(initial=0)))
            depth, stack = np.arange(deep + 1), np.zeros(deep + 1, dtype=int)
            for is_undo, is_redo in zip(undo, redo):
                if is_undo:
                    step = depth > 0
                    depth, stack = depth - step, stack + step
                elif is_redo:
                    step = stack > 0
                    depth, stack = depth + step, stack - step
                else:
                    depth, stack = depth + 1, np.zeros_like(stack)
            summary |= {"depth": depth.tolist(), "redo": stack.tolist()}
        return summary

    def apply_summary(self, state, summary):
        depth, redo = state
        total, ends = depth + redo, summary["ends"]
        if total < len(ends):
            depth = ends[total]
        else:
            depth = min(max(depth + summary["shift"], summary["low"]), total - summary["high"])
        if "depth" not in summary:
            return [depth, total - depth]
        depth += 1
        at = min(depth, len(summary["depth"]) - 1)
        return [summary["depth"][at] + depth - at, summary["redo"][at]]


class HeadRuns(Fold):
    """Start a new run when a row differs too much from the first row of its run.

    `same` columns must be equal; each `near` column may differ by its tolerance.
    """

    outputs = {"starts": T.BooleanType(), "run": T.LongType()}

    def __init__(self, same: list[str], near: dict[str, float]):
        self.same, self.near = same, near
        self.inputs = [*same, *near]

    def initial(self):
        return {"head": None, "runs": 0}

    def rows(self, rows):
        same = [[None if v is None or v != v else v for v in rows[c].tolist()] for c in self.same]
        near = [rows[c].astype("float64").tolist() for c in self.near]
        return list(zip(*same, *near))

    def _differs(self, head, row) -> bool:
        n = len(self.same)
        if head[:n] != row[:n]:
            return True
        return any(abs(a - b) > tol for a, b, tol in zip(head[n:], row[n:], self.near.values()))

    def follow(self, values, state):
        head, runs = state["head"], state["runs"]
        head = tuple(head) if head is not None else None
        starts, numbers = [], []
        for row in values:
            new = head is None or (row != head and self._differs(head, row))
            if new:
                head, runs = row, runs + 1
            starts.append(new)
            numbers.append(runs)
        return starts, numbers, {"head": list(head) if head else None, "runs": runs}

    def run(self, rows, state):
        starts, numbers, state = self.follow(self.rows(rows), state)
        return {"starts": starts, "run": numbers}, state

    def _certain_cut(self, before, row) -> bool:
        """Differs from any head the row before could have joined."""
        n = len(self.same)
        if before[:n] != row[:n]:
            return True
        return any(abs(a - b) > 2 * tol for a, b, tol in zip(before[n:], row[n:], self.near.values()))

    def summarise(self, rows):
        values = self.rows(rows)
        # equal neighbours share a run, so one of them stands for all
        values = [v for i, v in enumerate(values) if i == 0 or v != values[i - 1]]
        cut = next((i for i in range(1, len(values)) if self._certain_cut(values[i - 1], values[i])), None)
        if cut is None:
            return {"lead": [list(v) for v in values], "tail": None}
        _, _, tail = self.follow(values[cut:], self.initial())
        return {"lead": [list(v) for v in values[:cut]], "tail": tail}

    def apply_summary(self, state, summary):
        _, _, state = self.follow([tuple(v) for v in summary["lead"]], state)
        if summary["tail"] is None:
            return state
        return {"head": summary["tail"]["head"], "runs": state["runs"] + summary["tail"]["runs"]}


class JointSigning(Fold):
    """One envelope and its signers moving together, with the signing order as a parameter of the rows.

    Signer rows carry the signer's place (from 1), the number of signers and whether all may sign at once. The
    envelope follows its signers: a signature is refused out of turn, the last one completes the envelope, a refusal
    by a signer who has not looked yet ends it. Every refused row gets a reason.

    A chunk's summary is the few rows of it that can have an effect in any entry state. A row cannot if an earlier row
    of the chunk of the same kind and signer would have done the same and nothing since then could have made a
    difference: so signatures stay only after the sending, the signer's first view or a signature one place before.
    """

    outputs = {
        "state_before": T.StringType(),
        "state_after": T.StringType(),
        "signer_before": T.StringType(),
        "signer_after": T.StringType(),
        "accepted": T.BooleanType(),
        "reason": T.StringType(),
    }

    def __init__(self, event: str, place: str, signers: str, parallel: str, refusals: dict[str, str]):
        self.inputs = [event, place, signers, parallel]
        self.refusals = refusals

    def initial(self):
        return {"envelope": "draft", "signers": {}, "signed": 0}

    def _rows(self, rows):
        event, place, signers, parallel = (rows[c].tolist() for c in self.inputs)
        known = (~pd.isna(np.array(place, dtype=object))).tolist()
        return [
            (e, str(int(p)) if k else None, int(n) if k else 0, bool(a) if k else False)
            for e, p, n, a, k in zip(event, place, signers, parallel, known)
        ]

    def _refusal(self, state, row) -> str | None:
        event, place, _, parallel = row
        envelope, signer = state["envelope"], state["signers"].get(place, "pending")
        if event == "sent":
            return None if envelope == "draft" else "invalid_transition"
        if event in ("voided", "expired"):
            return None if envelope in ("sent", "partially_signed") else "invalid_transition"
        if event not in ("viewed", "signed", "declined"):
            return "invalid_transition"
        if place is None:
            return "signer_not_found"
        if event == "viewed":
            return None if signer == "pending" else "invalid_transition"
        if event == "declined":
            return None if (envelope, signer) == ("sent", "pending") else "invalid_transition"
        if envelope in self.refusals:
            return self.refusals[envelope]
        if signer != "viewed":
            return "signer_not_viewed_yet" if signer == "pending" else f"already_{signer}"
        # in order, those who have signed are the first ones
        return None if parallel or int(place) == state["signed"] + 1 else "signer_out_of_order"

    def _enter(self, state, row) -> None:
        event, place, signers, _ = row
        if event in ("sent", "voided", "expired"):
            state["envelope"] = event
            return
        state["signers"][place] = event
        if event == "declined":
            state["envelope"] = "declined"
        elif event == "signed":
            state["signed"] += 1
            state["envelope"] = "completed" if state["signed"] == signers else "partially_signed"

    def run(self, rows, state):
        state = {**state, "signers": dict(state["signers"])}
        out: dict[str, list] = {name: [] for name in self.outputs}
        for row in self._rows(rows):
            signer = None if row[1] is None else state["signers"].get(row[1], "pending")
            out["state_before"].append(state["envelope"])
            out["signer_before"].append(signer)
            reason = self._refusal(state, row)
            if reason is None:
                self._enter(state, row)
            out["state_after"].append(state["envelope"])
            out["signer_after"].append(None if row[1] is None else state["signers"].get(row[1], "pending"))
            out["accepted"].append(reason is None)
            out["reason"].append(reason)
        return out, state

    def summarise(self, rows):
        kept: list = []
        # position in `kept` of the last row of a kind and signer, and of what last could make a difference to it
        last: dict = {}
        sent = 0  # rows kept up to and with the first sending
        closed = False  # ended by a row of this chunk, whatever the entry state
        for row in self._rows(rows):
            event, place, _, parallel = row
            if event in ("viewed", "signed", "declined") and place is None:
                continue
            if event == "sent":
                keep = not sent
            elif event == "viewed":
                keep = (event, place) not in last
            elif closed:
                keep = False
            elif event in ("voided", "expired"):
                keep = True
            elif event == "declined":
                keep = last.get((event, place), -1) < sent
            elif event == "signed":
                before = 0 if parallel else last.get((event, str(int(place) - 1)), 0)
                keep = last.get((event, place), -1) < max(sent, last.get(("viewed", place), 0), before)
            else:
                keep = False
            if not keep:
                continue
            kept.append(list(row))
            last[event, place] = len(kept)
            if event == "sent":
                sent, closed = len(kept), False
            elif event in ("voided", "expired"):
                closed = True
        return kept

    def apply_summary(self, state, summary):
        state = {**state, "signers": dict(state["signers"])}
        for row in summary:
            if self._refusal(state, row) is None:
                self._enter(state, row)
        return state
