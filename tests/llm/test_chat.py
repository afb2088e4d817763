import itertools
import random

import duckdb

from slidespark.llm import chat as C

from ..differential import compare


def least_cost(roles):
    """By all assignments of roles and all ways to part turns."""
    best = None
    for names in itertools.product((C.SYSTEM, C.USER, C.ASSISTANT), repeat=len(roles)):
        cost, at = 0, C.START
        for role, b in zip(roles, names, strict=True):
            cost += 0 if role == C.ROLES[b - 1] else C.RELABEL
            gap = C.GAP[at, b]
            ways = ([C.MERGE] if at == b else []) + ([C.INSERT * len(gap)] if gap is not None else [])
            if not ways:
                cost = None
                break
            cost, at = cost + min(ways), b
        if cost is not None and (best is None or cost < best):
            best = cost
    return best


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def test_repairs_are_cheapest_and_legal(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["system", "user", "assistant", "tool", None]), r.choice(["hi", "", None, "x\ny"]), "extra") for c in range(60) for t in range(r.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string")
    out = C.digest(df.repartition(5)).collect()
    for c in range(60):
        mine = sorted((x for x in out if x.conv_id == c), key=lambda x: x.position)
        roles = [x[2] for x in rows if x[0] == c]
        assert {x.cost for x in mine} == {least_cost(roles)}
        shown = [x.role for x in mine if "merge" not in x.action]
        assert legal(shown), shown
        assert [x.turn for x in mine if x.turn is not None] == list(range(len(roles)))
        assert sum(C.RELABEL * ("relabel" in x.action) + C.MERGE * ("merge" in x.action) + C.INSERT * (x.action == "insert") for x in mine) == mine[0].cost


def test_one_conversation_over_many_partitions(spark):
    r = random.Random(3)
    roles = [r.choice(["user", "assistant", "system", None]) for _ in range(300)]
    df = spark.createDataFrame([(None, t, x, "t", 1) for t, x in enumerate(roles)], "conv_id long, turn long, role string, text string, position int")
    out = sorted(C.format_chats(df).collect(), key=lambda x: x.position)
    want = C.forward(roles, [0, C.INF, C.INF, C.INF])[0]
    assert {x.cost for x in out} == {min(want[1:])}
    assert legal([x.role for x in out if "merge" not in x.action])
    text = "".join(x.rendered for x in out)
    assert text.count("<|end|>") == sum("merge" not in x.action for x in out) - 1


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "user", None), (1, 0, "user", "b"), (1, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    out = sorted(C.digest(df).collect(), key=lambda x: x.position)
    assert [x.action for x in out] == ["keep", "merge", "merge"]
    assert C.digest(df.limit(0)).count() == 0


def test_ties_agree_with_sql(spark, tmp_path):
    r = random.Random(5)
    rows = [(c, r.choice([0, 0, 1, None]), r.choice(["system", "user", "assistant", "tool", None]), r.choice(["hi", "a", "", "x" * 300 + "1", "x" * 300 + "0"])) for c in range(30) for _ in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c.parquet/*.parquet')")
    assert compare(C.digest(spark.read.parquet(f"{tmp_path}/c.parquet")), con, C.oracle()) == ""


def test_text_ids_and_long_texts(spark):
    long = "word " * 200_000
    df = spark.createDataFrame([("a", 0, "user", long), ("a", 1, "user", "x"), ("b", 0, "assistant", "y")], "conv_id string, turn long, role string, text string")
    out = sorted(C.digest(df).collect(), key=lambda x: (x.conv_id, x.position))
    assert [(x.conv_id, x.action) for x in out] == [("a", "keep"), ("a", "merge"), ("b", "relabel")] and out[0].rendered.endswith(long)
