"""Chat formatting: minimum-cost repair of roles over a legal-turn automaton.

A legal conversation is an optional system turn, then user and assistant in turn, the user
first. Turns are repaired at least cost by a dynamic program over the role reached: a turn is
kept (0), merged into the turn before if it has the same role after repair (1), relabelled (2),
and empty turns are inserted where the automaton needs them (3 each); texts and order never
change. Of repairs that cost alike, the one whose last roles come first in system, user,
assistant is taken, so reruns agree.

A conversation may hold any share of the rows: rows are dealt by range of (conversation,
turn), each partition reduces the piece of a conversation that it holds at its edges to one
min-plus matrix between roles, and only those, two for each partition, meet in the driver.

One row for each turn of the result, in order of ``position`` (the rank of the source turn and
the place among what it gave); the segments ``rendered`` of a conversation, in that order, are
its rendering. A null or unknown role is relabelled; null text is empty; a null conversation id
is one conversation; null turns come first; turns of one number follow role, then text (nulls
first); repeated turns are merged or relabelled like others; conversation ids are text or can be cast to numbers; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidespark.sources.storage import checkpointed


ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
MERGE, RELABEL, INSERT = 1, 2, 3
INF = 1 << 60
#: Turns to insert before a turn of role b when role a was reached; None where no repair exists.
GAP = {
    (START, SYSTEM): [], (START, USER): [], (START, ASSISTANT): [USER],
    (SYSTEM, SYSTEM): None, (SYSTEM, USER): [], (SYSTEM, ASSISTANT): [USER],
    (USER, SYSTEM): None, (USER, USER): [ASSISTANT], (USER, ASSISTANT): [],
    (ASSISTANT, SYSTEM): None, (ASSISTANT, USER): [], (ASSISTANT, ASSISTANT): [USER],
}
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def moves(role: str | None) -> list[tuple[int, int, int, bool]]:
    """(from, to, cost, merged) of all ways to place a turn."""
    out = []
    for b in (SYSTEM, USER, ASSISTANT):
        own = 0 if role == ROLES[b - 1] else RELABEL
        for a in (START, SYSTEM, USER, ASSISTANT):
            gap = GAP[a, b]
            if a == b:
                out.append((a, b, own + MERGE, True))
            if gap is not None and not (a == b and INSERT * len(gap) >= MERGE):
                out.append((a, b, own + INSERT * len(gap), False))
    return out


MOVES = {r: moves(r) for r in (*ROLES, None)}


def forward(roles: list[str | None], costs: list[int]) -> tuple[list[int], list[list[tuple[int, bool]]]]:
    back = []
    for r in roles:
        new, how = [INF] * 4, [(-1, False)] * 4
        for a, b, c, merged in MOVES[r if r in ROLES else None]:
            if costs[a] + c < new[b]:
                new[b], how[b] = costs[a] + c, (a, merged)
        costs = new
        back.append(how)
    return costs, back


def matrix(roles: list[str | None]) -> list[list[int]]:
    return [forward(roles, [0 if i == a else INF for i in range(4)])[0] for a in range(4)]


def best_end(costs: list[int]) -> int:
    return min((SYSTEM, USER, ASSISTANT), key=lambda b: (costs[b], b))


def repair(roles: list[str | None], enter: int = START, leave: int | None = None) -> list[tuple[int, int, bool]]:
    """(role before, role, merged) of each turn on a cheapest way."""
    costs, back = forward(roles, [0 if i == enter else INF for i in range(4)])
    at, out = best_end(costs) if leave is None else leave, []
    for how in reversed(back):
        a, merged = how[at]
        out.append((a, at, merged))
        at = a
    return out[::-1]


def _runs(batches: Iterator[pa.RecordBatch]):
    """Conversations of a sorted partition with all their turns in it."""
    held, rows = None, None
    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if rows is None or conv != held:
                if rows is not None:
                    yield held, rows
                held, rows = conv, []
            rows.append((turn, role, text or ""))
    if rows is not None:
        yield held, rows


def _edges(kind: pa.DataType):
    """The first and the last conversation of a partition as matrices."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, first, last, count = TaskContext.get().partitionId(), None, None, 0
        for conv, rows in _runs(batches):
            if first is None:
                first = (conv, rows)
            last, count = (conv, rows), count + 1
        if first is not None:
            ends = [(first, True)] + [(last, False)] * (count > 1)
            names = ["pid", "first", "conv", "n", "costs"]
            cols = [[pid] * len(ends), [e for _, e in ends], [x[0] for x, _ in ends], [len(x[1]) for x, _ in ends], [sum(matrix([r[1] for r in x[1]]), []) for x, _ in ends]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), kind, pa.int64(), pa.list_(pa.int64())), strict=True)], names=names)

    return f


def _plan(edges: list) -> dict[tuple[int, bool], tuple[int, int, int, int]]:
    """For every edge piece: role before it, role after it, turns before it, cost of its conversation."""
    out, group = {}, []

    def settle() -> None:
        costs, trail = [0, INF, INF, INF], []
        for e in group:
            m = [list(e.costs[i : i + 4]) for i in (0, 4, 8, 12)]
            new, how = [INF] * 4, [-1] * 4
            for b in range(4):
                for a in range(4):
                    if costs[a] + m[a][b] < new[b]:
                        new[b], how[b] = costs[a] + m[a][b], a
            costs = new
            trail.append(how)
        at = best_end(costs)
        total, before = costs[at], sum(e.n for e in group)
        for e, how in zip(reversed(group), reversed(trail), strict=True):
            before -= e.n
            out[e.pid, e.first] = (how[at], at, before, total)
            at = how[at]

    for e in sorted(edges, key=lambda e: (e.pid, not e.first)):
        if group and e.conv != group[-1].conv:
            settle()
            group = []
        group.append(e)
    if group:
        settle()
    return out


def _render(plan, kind: pa.DataType):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        names = ["conv_id", "position", "turn", "role", "text", "action", "rendered", "cost"]
        out: list[tuple] = []

        def flush():
            cols = list(zip(*out, strict=True)) or [[]] * 8
            types = (kind, pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64())
            done = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)
            out.clear()
            return done

        number = 0
        held = None
        for item in _then(_runs(batches)):
            conv, rows, ends = item
            edge = plan.get((pid, number == 0)) if number == 0 or ends else None
            number += 1
            roles = [r[1] for r in rows]
            enter, leave, before, cost = edge or (START, None, 0, None)
            way = repair(roles, enter, leave)
            if cost is None:
                cost = forward(roles, [0, INF, INF, INF])[0][way[-1][1]]
            for k, ((turn, role, text), (a, b, merged)) in enumerate(zip(rows, way, strict=True)):
                place = (before + k) * 4
                start = a == START
                if not merged:
                    for x in GAP[a, b]:
                        out.append((conv, place, None, ROLES[x - 1], "", "insert", ("" if start else CLOSE) + OPEN.format(ROLES[x - 1]), cost))
                        place, start = place + 1, False
                name = ROLES[b - 1]
                action = ("merge" if merged else "keep") if role == name else ("relabel and merge" if merged else "relabel")
                out.append((conv, place, turn, name, text, action, ("\n" if merged else ("" if start else CLOSE) + OPEN.format(name)) + text, cost))
                if len(out) >= 2000:
                    yield flush()
        if out:
            yield flush()

    return f


def _then(items):
    """Each item with whether it is the last."""
    held = None
    for x in items:
        if held is not None:
            yield (*held, False)
        held = x
    if held is not None:
        yield (*held, True)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Repaired and rendered turns of all conversations."""
    name, kind = ("string", pa.string()) if dict(turns.dtypes)[conv_col] == "string" else ("long", pa.int64())
    rows = turns.select(F.col(conv_col).cast(name).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 256)).sortWithinPartitions("conv_id", "turn", "role", "text"))
    edges = dealt.mapInArrow(_edges(kind), f"pid long, first boolean, conv {name}, n long, costs array<long>").collect()  # two rows for each partition at most
    return dealt.mapInArrow(_render(_plan(edges), kind), f"conv_id {name}, position long, turn long, role string, text string, action string, rendered string, cost long")


def digest(turns: DataFrame) -> DataFrame:
    return format_chats(turns)


def oracle() -> str:
    """The same in DuckDB: costs forward turn by turn with the choice that made each, then the way back."""
    ways = {b: [(a, c - (0 if b == SYSTEM else RELABEL), merged) for a, to, c, merged in moves("system") if to == b] for b in (SYSTEM, USER, ASSISTANT)}
    own = lambda b: f"CASE WHEN role = '{ROLES[b - 1]}' THEN 0 ELSE {RELABEL} END"
    best = ", ".join(f"least({', '.join(f'(costs[{a + 1}] + {own(b)} + {c}) * 8 + {i}' for i, (a, c, _) in enumerate(ways[b]))})" for b in ways)
    pick = lambda k: "CASE " + " ".join(f"WHEN b = {b} AND v[{b}] % 8 = {i} THEN {int(w[k])}" for b in ways for i, w in enumerate(ways[b])) + " END"
    name = lambda c: f"CASE {c} " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(ROLES, 1)) + " END"
    gap = "CASE WHEN merged = 1 THEN NULL " + " ".join(f"WHEN a = {a} AND b = {b} THEN {g[0]}" for (a, b), g in GAP.items() if g) + " END"
    far = 1_000_000_000
    opened = lambda c: "'" + OPEN.replace("\n", "' || chr(10) || '").replace("{}", f"' || {name(c)} || '") + "'"
    return f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, count(*) OVER (PARTITION BY conv_id) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations),
f AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, [0, {far}, {far}, {far}]::BIGINT[] AS costs, [0, 0, 0]::BIGINT[] AS v FROM t
  UNION ALL
  SELECT conv_id, k, [{far}, v[1] // 8, v[2] // 8, v[3] // 8], v
  FROM (SELECT t.conv_id, t.k, [{best}]::BIGINT[] AS v
        FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.k = f.k + 1)),
w AS (
  SELECT f.conv_id, f.k, CASE WHEN costs[2] <= costs[3] AND costs[2] <= costs[4] THEN 1 WHEN costs[3] <= costs[4] THEN 2 ELSE 3 END AS b, list_min(costs) AS cost, v
  FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.k = f.k AND t.k = t.n
  UNION ALL
  SELECT f.conv_id, f.k, x.a, x.cost, f.v
  FROM (SELECT conv_id, k, cost, {pick(0)} AS a FROM w) x JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.k = x.k - 1 AND f.k > 0),
r AS (SELECT *, {gap} AS g FROM (SELECT conv_id, k, b, cost, {pick(0)} AS a, {pick(2)} AS merged FROM w))
SELECT conv_id, CAST((k - 1) * 4 AS BIGINT) AS position, CAST(NULL AS BIGINT) AS turn, {name("g")} AS role, '' AS text, 'insert' AS action,
       CASE WHEN a = 0 THEN '' ELSE '{CLOSE.strip()}' || chr(10) END || {opened("g")} AS rendered, CAST(cost AS BIGINT) AS cost
FROM r WHERE g IS NOT NULL
UNION ALL
SELECT r.conv_id, CAST((r.k - 1) * 4 + CASE WHEN g IS NULL THEN 0 ELSE 1 END AS BIGINT), CAST(t.turn AS BIGINT), {name("b")}, t.text,
       CASE WHEN t.role = {name("b")} THEN CASE merged WHEN 1 THEN 'merge' ELSE 'keep' END ELSE CASE merged WHEN 1 THEN 'relabel and merge' ELSE 'relabel' END END,
       CASE WHEN merged = 1 THEN chr(10) WHEN a = 0 AND g IS NULL THEN {opened("b")} ELSE '{CLOSE.strip()}' || chr(10) || {opened("b")} END || t.text, CAST(cost AS BIGINT)
FROM r JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.k = r.k"""
