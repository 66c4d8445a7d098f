"""Signatures found in a text are those that their patterns find one by one."""

import random
import re

import pytest

from tracehound.functions import signatures as S
from tracehound.functions.tables import COMMAND_SIGNATURES, PATH_SIGNATURES

PARTS = ["-e ", "-ENC ", "A" * 24, "-nop", "-noprofile", "powershell", "sc  \\\\\\\\srv", "sc.exe \\\\\\\\x", "at \\\\\\\\h", "schtasks /s x", "token", "cookies.json", "upload", "grab", "password", "7z a", "rar a", "Library", "able", "\\\\srv\\ADMIN$",
         "C:\\Windows\\x.exe", "\\Temp\\", "\\AppData\\Local\\Temp\\", "\u212aaseya", "KASEYA", "\u0130", "mimikatz", "vssadmin", "delete shadows", "reg add", "\\Run", "\n", "é"]


@pytest.mark.parametrize("table", [COMMAND_SIGNATURES, PATH_SIGNATURES, COMMAND_SIGNATURES[:3] + (("[0-9]{3}", "digits", "low"),)])
def test_equal_to_the_patterns_one_by_one(spark, table):
    rng = random.Random(len(table))
    texts = ["".join(rng.choice(PARTS) + rng.choice(["", " ", "x", "123"]) for _ in range(rng.randint(0, 6))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    for least in (0, 8):
        got = {r["i"]: [m["n"] for m in r["m"]] for r in df.select("i", S.all_matches(df["text"], table, least).alias("m")).collect()}
        found = lambda p, t: (m := re.search(f"(?ai){p}", t)) and len(m[0]) >= least
        assert got == {i: [n for n, (p, _, _) in enumerate(table) if t is not None and found(p, t)] for i, t in enumerate(texts)}
    first = {r["i"]: r["m"] for r in df.select("i", S.first_match(df["text"], table)["label"].alias("m")).collect()}
    assert first == {i: next((label for p, label, _ in table if t is not None and re.search(f"(?ai){p}", t)), None) for i, t in enumerate(texts)}


def test_a_text_is_read_once_for_all_literals(spark):
    assert all(S.gates(p) for p, _, _ in COMMAND_SIGNATURES)
    assert S.gates("(token|cookie)s?x.*(ab|cd)") == ["token", "cookie"] and S.gates("(abc|d)+x") == [] and S.gates("(abc)?x|def") == [] and S.gates("(?!abc)d") == []
    df = spark.createDataFrame([("x",)], "text string")
    plan = df.select(S.all_matches(df["text"]), S.first_match(df["text"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("find(text") <= 3 and "contains(" not in plan and plan.count("ArrowEvalPython") == 1
