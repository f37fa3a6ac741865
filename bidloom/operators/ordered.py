"""Folds over the rows of a key in order whose result depends on all rows before, without a key's rows ever sitting together.

Rows are range-partitioned and sorted by key and order, so a hot key spreads over many partitions. A partition is read as a stream
with a small state. Only the first key of a partition may have begun in an earlier one; how that piece is settled is up to the fold:
the limiter settles it from its first pause on and hands on the rest, the state machine works it out for every state it may start in.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage


def _sorted(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = storage.scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------------ sliding-window limiter

_REQUEST, _CARRY, _OPEN = 0, 1, 2


def limiter(requests: DataFrame, client: str, ts: str, row: str, most: int = 30, seconds: float = 60.0) -> DataFrame:
    """(client, row, accepted): a request is rejected when ``most`` accepted ones of its client lie less than ``seconds`` before it.

    Rejected ones don't count, so each decision depends on those before; requests of one moment go by ``row``. After a pause of
    ``seconds`` nothing before matters: from the first pause of a partition's first client on all is settled where it lies. What lies
    before it (open) goes, with the at most ``most`` times that the partition before carries over, to one sorted stream a client. So
    a client is only followed through one task where it never pauses, and then with ``most`` times in memory. Null times are rejected.
    """
    timed = requests.select(F.col(client).alias("client"), F.col(ts).cast("timestamp").cast("double").alias("t"), F.col(row).alias("row"))
    kinds = {f.name: f.dataType.simpleString() for f in timed.schema}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque = deque()
        now = before = None
        started, is_open, head = False, False, False
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("client", "t", "row", "kind", "accepted")}
            for c, t, r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not started or c != now:
                    # only the first client of a partition can have rows in an earlier one
                    head = is_open = not started
                    started, now, before = True, c, None
                    held.clear()
                kind, accepted = _REQUEST, False
                if t is not None:
                    if before is not None and t - before >= seconds:
                        is_open = False
                        held.clear()
                    before = t
                    if is_open:
                        kind = _OPEN
                    else:
                        accepted = admit(held, t, most, seconds)
                for name, x in zip(out, (c, t, r, kind, accepted), strict=True):
                    out[name].append(x)
            yield _batch(out)
        if started and not is_open and held:
            # what the next partition's first client may need, if it is this one
            n = len(held)
            yield _batch({"client": [now] * n, "t": list(held), "row": [None] * n, "kind": [_CARRY] * n, "accepted": [None] * n})

    schema = f"client {kinds['client']}, t double, row {kinds['row']}, kind int, accepted boolean"
    arrow = _arrow(schema)
    _batch = lambda out: pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
    found = _kept(_sorted(timed, ["client", "t", "row"]).mapInArrow(first, schema), "limiter")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque = deque()
        now, carried = None, False
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("client", "t", "row", "kind", "accepted")}
            for c, t, r, kind in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if c != now or (kind == _CARRY and not carried):
                    held.clear()
                now, carried = c, kind == _CARRY
                if kind == _CARRY:
                    held.append(t)
                    continue
                for name, x in zip(out, (c, t, r, kind, admit(held, t, most, seconds)), strict=True):
                    out[name].append(x)
            yield _batch(out)

    clients = found.where(F.col("kind") == _OPEN).select(F.col("client").alias("_c")).distinct()
    chains = found.where(F.col("kind") != _REQUEST).join(clients, F.col("client").eqNullSafe(F.col("_c")), "left_semi").select("client", "t", "row", "kind")
    # a carry comes before open requests of its moment; both kinds never cross in time otherwise
    settled = chains.repartition("client").sortWithinPartitions("client", "t", "kind", "row").mapInArrow(rest, schema)
    both = found.where(F.col("kind") == _REQUEST).unionByName(settled)
    return both.select(F.col("client").alias(client), F.col("row").alias(row), "accepted")


def admit(held: deque, t: float, most: int, seconds: float) -> bool:
    while held and t - held[0] >= seconds:
        held.popleft()
    if len(held) < most:
        held.append(t)
        return True
    return False


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


# ------------------------------------------------------------------ state machine


_ROW, _FIRST, _LAST = 0, 1, 2


def state_machine(events: DataFrame, key: str, order: list[str], event: str, moves: dict[tuple[str, str], str], start: str) -> DataFrame:
    """The events with ``before`` and ``after``, the key's state around each, and ``rejected``, whether no move leads on.

    ``moves`` maps (state, event) to the next state. A rejected event, null ones included, leaves the state as it is. The moves of a
    partition's first key are worked out for every state at once (states are few), so that a piece is settled as soon as it is known
    in which state it starts: by composing the pieces before it, of which there is one a partition.
    """
    states = sorted({start, *(s for s, _ in moves), *moves.values()})
    number = {s: i for i, s in enumerate(states)}
    table = {e: [number[moves.get((s, e), s)] for s in states] for e in {e for _, e in moves}}
    legal = {(number[s], e) for s, e in moves}
    same = list(range(len(states)))
    cols = list(events.columns)
    extra = "_part int, _from array<int>, _to array<int>, _kind int"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", " + extra
    arrow = _arrow(schema)
    at_key, at_event = cols.index(key), cols.index(event)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, now, started, state = TaskContext.get().partitionId(), None, None, False, same
        for batch in batches:
            froms, tos = [], []
            for k, e in zip(batch.column(at_key).to_pylist(), batch.column(at_event).to_pylist(), strict=True):
                if not started:
                    first = k
                elif k != now:
                    # a key that begins here begins in the start state
                    state = [number[start]] * len(states)
                started, now = True, k
                froms.append(state)
                to = table.get(e)
                state = state if to is None else [to[i] for i in state]
                tos.append(state)
            n = batch.num_rows
            more = [pa.array([part] * n, pa.int32()), pa.array(froms, pa.list_(pa.int32())), pa.array(tos, pa.list_(pa.int32())), pa.array([_ROW] * n, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)] + more, schema=arrow)
        if started:
            # two rows of their own say which key the partition begins with and how it ends
            keys = [pa.array([first, now], f.type) if i == at_key else pa.nulls(2, f.type) for i, f in enumerate(list(arrow)[: len(cols)])]
            more = [pa.array([part] * 2, pa.int32()), pa.array([same] * 2, pa.list_(pa.int32())), pa.array([state] * 2, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*keys, *more, pa.array([_FIRST, _LAST], pa.int32())], schema=arrow)

    found = _kept(_sorted(events, [key, *order]).mapInArrow(run, schema), "machine")
    # two rows a partition: which state its first key enters in, by the partitions before
    begins: list[tuple[int, int]] = []
    carried: tuple | None = None
    for r in found.where(F.col("_kind") != _ROW).select("_part", "_kind", F.col(key).alias("k"), "_to").orderBy("_part", "_kind").collect():
        if r["_kind"] == _FIRST:
            begins.append((r["_part"], carried[1] if carried is not None and carried[0] == r["k"] else number[start]))
        else:
            carried = (r["k"], r["_to"][begins[-1][1]])
    starts = F.broadcast(events.sparkSession.createDataFrame(begins, "_part int, _enters int"))
    names = F.array(*map(F.lit, states))
    rows = found.where(F.col("_kind") == _ROW).join(starts, "_part")
    before, after = F.get("_from", F.col("_enters")), F.get("_to", F.col("_enters"))
    allowed = F.array(*[F.lit(f"{i}:{e}") for i, e in sorted(legal)])
    ok = F.array_contains(allowed, F.concat_ws(":", before.cast("string"), F.col(event))) & F.col(event).isNotNull()
    return rows.select(*cols, F.get(names, before).alias("before"), F.get(names, after).alias("after"), (~ok).alias("rejected"))
