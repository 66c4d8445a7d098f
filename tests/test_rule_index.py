"""An index over many rules gives what the rules give one by one."""

import random

import pytest

from tracehound.functions.literals import Automaton, Literal
from tracehound.operators import rule_index as I
from tracehound.operators import rules as U

WORDS = ["cmd", "CMD.exe", "powershell", "-enc", "\\\\temp\\\\", "c:/x", "4688", "4688.0", "7", "-1.5", "é", "", "a.b", "net  user"]


def rows(rng, n):
    out = []
    for i in range(n):
        row = {k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 3))) for k in rng.sample(["Image", "CommandLine", "EventID", "User", "Ip"], rng.randint(0, 5))}
        if rng.random() < 0.3:
            row["EventID"] = rng.choice(["4688", "4688.0", " 4688", "4.688e3", "1", "NaN", "-0"])
        if "Ip" in row:
            row["Ip"] = rng.choice(["10.0.0.1", "192.168.1.7", "x", ""])
        out.append((i, row))
    return out


def selection(rng):
    def one():
        kind = rng.choice(["", "|contains", "|startswith", "|endswith", "|contains|all", "|contains|windash", "|re", "null", "|cidr", "number"])
        if kind == "null":
            return {rng.choice(["User", "Ip"]): None}
        if kind == "|cidr":
            return {"Ip|cidr": ["10.0.0.0/8", "192.168.0.0/16"][: rng.randint(1, 2)]}
        if kind == "|re":
            return {rng.choice(["Image", "CommandLine"]) + kind: rng.choice(["power.hell", "c(md|.)", "^net", "temp$|cmd", "[0-9]{4}"])}
        if kind == "number":
            return {"EventID": rng.choice([4688, 1, "4688", 0, -1.5])}
        values = [rng.choice(WORDS) for _ in range(rng.randint(1, 3))]
        return {rng.choice(["Image", "CommandLine", "User", "EventID"]) + kind: values if rng.random() < 0.6 else values[0]}

    whole = {}
    for _ in range(rng.randint(1, 2)):
        whole |= one()
    return rng.choice([whole, [whole, one()], [rng.choice(WORDS), "user"], {}])


def rule(rng, i):
    condition = rng.choice(["a", "a and b", "a or b", "not a", "a and not b", "not (a or b)", "1 of x*", "all of them", "(a or not b) and xa", "missing or a", "1 of y*", "a and not 1 of x*"])
    return U.Rule(f"r{i}", {"a": selection(rng), "b": selection(rng), "xa": selection(rng), "xb": selection(rng), "condition": condition}, level=rng.choice(["low", "high", "odd"]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_the_rules_one_by_one(spark, seed):
    rng = random.Random(seed)
    df = spark.createDataFrame(rows(rng, 60), "i int, row map<string,string>").repartition(3)
    rules = [rule(rng, i) for i in range(70)]
    plain, indexed = (sorted(map(tuple, U.scan(df, rules, raw="row", keep=("i",), indexed=x).collect())) for x in (False, True))
    assert indexed == plain and len({r[1] for r in plain}) > 40


def test_typed_columns_nulls_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "ERROR", 7, None), (2, None, None, "x"), (3, "view", 7, "Error")], "id int, kind string, user_id int, props string")
    rules = [U.Rule("n", {"s": {"user_id": 7}, "f": {"kind": "error"}, "condition": "s and not f"}), U.Rule("w", {"s": ["error"], "condition": "s"}), U.Rule("p", {"s": {"props": None}, "condition": "s"})]
    found = U.scan(df, rules, keep=("id",), indexed=True)
    assert sorted((r["id"], r["rule"]) for r in found.collect()) == [(1, "p"), (1, "w"), (3, "n"), (3, "w")]
    assert U.scan(df.limit(0), rules, keep=("id",), indexed=True).count() == 0
    assert sorted((r["id"], r["rule"]) for r in U.scan(df, rules, keep=("id",), indexed=True, most=1, order="id").collect()) == [(1, "p"), (1, "w"), (3, "n")]


def test_few_rules_are_looked_at():
    index = I.AtomIndex(lambda name: None, None, lambda *_: None)
    nodes = [U.compile_rule(U.Rule("", {"s": {"Image|endswith": f"/tool{i}.exe", "CommandLine|contains": ["a", "b"]}, "f": {"User": None}, "condition": "s and not f"}), index) for i in range(50)]
    # The telling literal leads to a rule, not the short ones that all rules share.
    assert len({t for n in nodes for t in n.triggers}) == 50 and all(len(n.triggers) == 1 for n in nodes)
    assert U.compile_rule(U.Rule("", {"s": {"a": "b"}, "condition": "not s"}), index).triggers is None


def test_automaton():
    a = Automaton([Literal(0, "contains", 0, "he"), Literal(1, "contains", 0, "she"), Literal(2, "startswith", 0, "us"), Literal(3, "endswith", 0, "hers"), Literal(4, "equals", 1, "x"), Literal(5, "number", 0, 4.0)])
    assert a.find(["ushers", "x"], [4.0]) == [0, 1, 2, 3, 4, 5] and a.find([None, "xx"], [None]) == [] and a.find(["hers us", None], []) == [0]


def test_hits_of_a_batch_and_texts_that_are_sent(spark):
    from pyspark.sql import functions as F

    from tracehound.functions.literals import literal_hits

    df = spark.createDataFrame([(1, "xay", "b"), (2, None, None), (3, "bbb", "a"), (4, "", "")], "i int, used string, other string").coalesce(1)
    hits = df.select("i", literal_hits([F.col("used"), F.col("other")], [Literal(0, "contains", 0, "a"), Literal(63, "contains", 0, "b"), Literal(64, "equals", 0, "xay"), Literal(130, "endswith", 0, "y")]).alias("h"))
    assert {r["i"]: (r["h"]["ids"], r["h"]["bits"]) for r in hits.collect()} == {1: ([0, 64, 130], [1, 1, 4]), 2: ([], [0, 0, 0]), 3: ([63], [-(2**63), 0, 0]), 4: ([], [0, 0, 0])}
    sent = next(line for line in hits._jdf.queryExecution().optimizedPlan().toString().split("\n") if "find(" in line)
    assert "used#" in sent and "other#" not in sent
