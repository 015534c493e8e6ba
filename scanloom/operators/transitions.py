"""State machines as scans of composed transitions.

A stretch of a key's rows is a function from the state before it to the state
behind it, and such functions compose: stretches are reduced in parallel, one
small row per stretch is composed in order, and every stretch is then replayed
from its own start.  A key of any size spreads over tasks that way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.operators.ordering import keys_fit, previous_row, ranked_within

#: Rows of a stretch.
STRETCH = 1 << 16


def stretches(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """``_at`` (place of a row in its key) and ``_part`` (its stretch), by row count, whatever the times are."""
    d = ranked_within(rows, keys, [F.col(c) for c in order], into="_at").drop("group_size")
    return d.withColumn("_part", F.floor(F.col("_at") / size))


def compose(steps: np.ndarray) -> np.ndarray:
    """The function of all ``steps`` (one function per row, as its table) one after the other, by halving."""
    while len(steps) > 1:
        odd = steps[len(steps) - len(steps) % 2 :]
        first, second = steps[: len(steps) - len(odd) : 2], steps[1 : len(steps) - len(odd) : 2]
        steps = np.concatenate([np.take_along_axis(second, first, 1), odd])
    return steps[0]


def finite_replay(rows: DataFrame, keys: list[str], order: list[str], symbol: Column, table: list[list[int]], start: int = 0, size: int = STRETCH) -> DataFrame:
    """``rows`` with the state before and after each (``before``, ``after``).

    ``table[symbol][state]`` is the next state; rows of a key are taken in
    ``order``, which has to be total.
    """
    step, moves = np.array(table, np.int32), table
    if size >= STRETCH and keys_fit(rows.select(*keys), keys):  # a key follows the other in one pass
        columns = rows.columns
        schema = T.StructType([*rows.schema, T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType())])

        names = schema.fieldNames()

        def follow(batches):
            key, state = None, start
            for b in batches:
                befores, afters = [], []
                for *now, s in zip(*(b.column(c).to_pylist() for c in (*keys, "_symbol"))):
                    if now != key:
                        key, state = now, start
                    befores.append(state)
                    state = moves[s][state]
                    afters.append(state)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(befores, pa.int32()), pa.array(afters, pa.int32())], names)

        return rows.withColumn("_symbol", symbol.cast("int")).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(follow, schema)
    d = stretches(rows.withColumn("_symbol", symbol.cast("int")), keys, order, size)
    part_type = T.StructType([*(d.schema[k] for k in keys), d.schema["_part"]])

    def symbols(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        at = np.argsort(found.column("_at").to_numpy())
        return at, found.column("_symbol").to_numpy()[at]

    def reduce(found: pa.Table) -> pa.Table:
        whole = compose(step[symbols(found)[1]])
        return found.select([*keys, "_part"]).slice(0, 1).append_column("_whole", pa.array([whole.tolist()], pa.list_(pa.int32())))

    def begin(found: pa.Table) -> pa.Table:
        found, state, states = found.sort_by("_part"), start, []
        for whole in found.column("_whole").to_pylist():
            states.append(state)
            state = whole[state]
        return found.select([*keys, "_part"]).append_column("_state", pa.array(states, pa.int32()))

    reduced = d.select(*keys, "_part", "_at", "_symbol").groupBy(*keys, "_part").applyInArrow(reduce, T.StructType([*part_type, T.StructField("_whole", T.ArrayType(T.IntegerType()))]))
    begins = reduced.groupBy(*keys).applyInArrow(begin, T.StructType([*part_type, T.StructField("_state", T.IntegerType())]))  # one row per stretch
    kept = [c for c in d.columns if c not in ("_at", "_part", "_symbol")]

    def replay(found: pa.Table) -> pa.Table:
        at, given = symbols(found)
        state, states = found.column("_state")[0].as_py(), []
        for s in given.tolist():
            state = moves[s][state]
            states.append(state)
        before = np.r_[found.column("_state")[0].as_py(), states[:-1]].astype(np.int32)
        return found.take(pa.array(at)).select(kept).append_column("before", pa.array(before)).append_column("after", pa.array(states, pa.int32()))

    joined = d.join(begins, [*keys, "_part"])
    return joined.groupBy(*keys, "_part").applyInArrow(replay, T.StructType([*(d.schema[c] for c in kept), T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType())]))


JOURNAL = (None, "running", "committed", "failed")
ACTIONS = ("claim", "commit", "fail", "interrupt")


def work_journal(rows: DataFrame, keys: list[str], order: list[str], retry_limit: int, size: int = STRETCH) -> DataFrame:
    """Decision, status and attempts behind every ``action`` of a group (claim, commit, fail or interrupt).

    A claim is processed unless the group is committed or its attempts are used
    up; an interrupted attempt is given back.  The states are those of status
    and attempts, which the limit bounds.
    """
    most = max(retry_limit, 1)
    code = {(s, n): i for i, (s, n) in enumerate((s, n) for s in range(len(JOURNAL)) for n in range(most + 1))}

    def move(action: str, status: int, attempts: int) -> tuple[int, int]:
        name = JOURNAL[status]
        if action == "claim":
            return (status, attempts) if name == "committed" or (name and attempts >= most) else (1, min(attempts + 1, most))
        if not name:
            return status, attempts
        return (2 if action == "commit" else 3), max(attempts - 1, 0) if action == "interrupt" else attempts

    table = [[code[move(a, *s)] for s in code] for a in ACTIONS]
    which = sum((F.when(F.col("action") == a, i).otherwise(0) for i, a in enumerate(ACTIONS[1:], 1)), F.lit(0))
    d = finite_replay(rows, keys, order, which, table, size=size)
    status = lambda c: F.element_at(F.array(*map(F.lit, JOURNAL)), (F.floor(F.col(c) / (most + 1)) + 1).cast("int"))
    attempts = lambda c: F.col(c) % (most + 1)
    claim = F.when(status("before") == "committed", "already_committed").when(status("before").isNotNull() & (attempts("before") >= most), "retry_limit").otherwise("process")
    return d.select(*rows.columns, F.when(F.col("action") == "claim", claim).alias("decision"), status("after").alias("status"), attempts("after").alias("attempts"))


def lease_log(rows: DataFrame, keys: list[str], order: list[str], ttl_us: int, size: int = STRETCH) -> DataFrame:
    """Whether each ``action`` of an ``owner`` succeeds, with the ``holder`` and the time ``until`` behind it.

    acquire succeeds when the lease is free, expired or the owner's; renew and
    release only for the owner.  Whoever holds the lease where a stretch begins
    took or renewed it at the last such row of theirs, so the possible states
    there are known beforehand: free, and one per owner seen so far.  A stretch
    is reduced to what it makes of each of them.  ``order[0]`` is the time.
    """
    time = order[0]
    d = stretches(rows, keys, order, size)
    grants = d.filter(F.col("action") != "release").groupBy(*keys, "_part", F.col("owner").alias("_who")).agg(F.max(time).alias("_last"))
    parts = d.select(*keys, F.col("_part").alias("_here")).distinct()
    known = parts.join(grants, keys).filter("_part < _here").groupBy(*keys, "_here", "_who").agg(F.max("_last").alias("_last"))  # owners x stretches of a key
    starts = parts.join(known.groupBy(*keys, "_here").agg(F.collect_list(F.struct("_who", "_last")).alias("_known")), [*keys, "_here"], "left").withColumnRenamed("_here", "_part")
    d = d.join(starts, [*keys, "_part"])
    part_type = T.StructType([*(d.schema[k] for k in keys), d.schema["_part"]])
    free, kept = (None, 0), rows.columns

    def apply(state: tuple, action: str, owner: int, now: int) -> tuple[bool, tuple]:
        held, until = state
        if action == "acquire":
            ok = held is None or until <= now or held == owner
            return ok, (owner, now + ttl_us) if ok else state
        ok = held is not None and held == owner
        return ok, state if not ok else (owner, now + ttl_us) if action == "renew" else free

    def ordered(found: pa.Table):
        at = np.argsort(found.column("_at").to_numpy())
        return at, zip(*(found.column(c).take(pa.array(at)).to_pylist() for c in ("action", "owner", time)), strict=True)

    def reduce(found: pa.Table) -> pa.Table:
        states = {None: free, **{k["_who"]: (k["_who"], k["_last"] + ttl_us) for k in found.column("_known")[0].as_py() or []}}
        ends = {s: [who] for who, s in states.items()}  # states that have met go on together
        for action, owner, now in ordered(found)[1]:
            merged: dict = {}
            for s, whose in ends.items():
                merged.setdefault(apply(s, action, owner, now)[1], []).extend(whose)
            ends = merged
        to = [{"_from": who, "_to": s[0], "_until": s[1]} for s, whose in ends.items() for who in whose]
        kind = pa.list_(pa.struct([("_from", pa.int64()), ("_to", pa.int64()), ("_until", pa.int64())]))
        return found.select([*keys, "_part"]).slice(0, 1).append_column("_moves", pa.array([to], kind))

    def begin(found: pa.Table) -> pa.Table:
        found, state, states = found.sort_by("_part"), free, []
        for moves in found.column("_moves").to_pylist():
            states.append({"who": state[0], "until": state[1]})
            move = next(m for m in moves if m["_from"] == state[0])
            state = (move["_to"], move["_until"])
        return found.select([*keys, "_part"]).append_column("_state", pa.array(states, pa.struct([("who", pa.int64()), ("until", pa.int64())])))

    moves = d.groupBy(*keys, "_part").applyInArrow(reduce, T.StructType([*part_type, *T.StructType.fromDDL("_moves array<struct<_from:long,_to:long,_until:long>>")]))
    begins = moves.groupBy(*keys).applyInArrow(begin, T.StructType([*part_type, *T.StructType.fromDDL("_state struct<who:long,until:long>")]))

    def replay(found: pa.Table) -> pa.Table:
        at, given = ordered(found)
        first = found.column("_state")[0].as_py()
        state, out = (first["who"], first["until"]), []
        for action, owner, now in given:
            ok, state = apply(state, action, owner, now)
            out.append((ok, *state))
        rows_out = found.take(pa.array(at)).select(kept)
        for i, (name, kind) in enumerate((("ok", pa.bool_()), ("holder", pa.int64()), ("until", pa.int64()))):
            rows_out = rows_out.append_column(name, pa.array([o[i] for o in out], kind))
        return rows_out

    joined = d.drop("_known").join(begins, [*keys, "_part"])
    return joined.groupBy(*keys, "_part").applyInArrow(replay, T.StructType([*rows.schema, *T.StructType.fromDDL("ok boolean, holder long, until long")]))


def job_states(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state of every job after all its updates (status, progress, time).

    ``pending`` starts a job anew, so start and finish are looked for behind the
    last one, and an attempt is a running row whose last running or pending row
    was not running.  Aggregates only; no job is one task.
    """
    at, status, time = F.struct(*order), F.col("status"), order[0]
    told = status != "progress"
    whole = updates.groupBy(*keys).agg(
        F.max_by("status", F.when(told, at)).alias("_status"), F.max_by(F.when(status == "pending", 0.0).otherwise(F.col("progress")), at).alias("_progress"), F.max(F.when(status == "pending", at)).alias("_reset"))
    marks = previous_row(updates.filter(status.isin("running", "pending")), keys, order, ["status"])
    tries = marks.filter((status == "running") & ~F.col("prev.status").eqNullSafe("running")).groupBy(*keys).agg(F.count("*").cast("int").alias("attempts"))
    since = updates.join(whole.select(*keys, "_reset"), keys).filter(F.col("_reset").isNull() | (at > F.col("_reset")))
    times = since.groupBy(*keys).agg(F.min(F.when(status == "running", F.col(time))).alias("started_at"), F.max(F.when(status.isin("completed", "failed"), F.col(time))).alias("finished_at"))
    d = whole.join(times, keys, "left").join(tries, keys, "left")
    return d.select(*keys, F.coalesce("_status", F.lit("pending")).alias("status"), F.col("_progress").alias("progress"), "started_at", "finished_at",
                    F.when(F.col("_status") == "failed", "failed").alias("last_error"), F.coalesce("attempts", F.lit(0)).alias("attempts"))
