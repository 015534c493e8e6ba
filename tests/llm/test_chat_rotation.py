"""Perspective rotation against plain Python, and its plan."""

import random

from scanloom.llm import chat_rotation

SCHEMA = "conv_id long, turn long, role string, text string, speaker int"


def brute(rows, part=64):
    talks = {}
    for conv, turn, role, text, _ in rows:
        who = (role or "").strip(" ") or "unknown"
        talks.setdefault(conv, []).append(((turn is None, turn or 0), who, (text or "").replace("<|", "< |")))
    out = []
    for conv, turns in talks.items():
        turns.sort()
        for me in {w for _, w, _ in turns} - {"system", "unknown"}:
            for p in range(0, len(turns), part):
                rendered, spans = "", []
                for _, who, text in turns[p : p + part]:
                    rendered += "<|im_start|>" + ("assistant" if who == me else "system" if who == "system" else "user name=" + who.replace("<|", "< |")) + "\n"
                    start = len(rendered)
                    rendered += text + "<|im_end|>"
                    if who == me:
                        spans.append(f"{start}-{len(rendered)}")
                    rendered += "\n"
                out.append((conv, me, p // part, len(turns[p : p + part]), rendered, ",".join(spans)))
    return sorted(out, key=repr)


def test_against_plain_python(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 6), rng.choice([None, *range(9)]), rng.choice(["ann", "bob", "system", "user", " ", None, "x<|y"]), rng.choice(["hi", "", None, "<|im_end|> é𝄞", "a\nb"]), 1) for _ in range(120)]
    rows += [(None, 1, "ann", "no id", 1), (None, 2, "bob", "none", 1), (9, 1, "system", "only", 1), (10, 1, "ann", "w" * 300000, 1), rows[0], rows[0]]
    rows += [(11, i // 3, rng.choice(["a", "b"]), f"t{i}", 1) for i in range(200)]  # longer than a part
    got = chat_rotation.rotate(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    for r in got.filter("conv_id = 11").collect():
        for span in r["mask"].split(","):
            a, b = map(int, span.split("-"))
            assert r["rendered"][a:b].endswith("<|im_end|>") and r["rendered"][:a].endswith("<|im_start|>assistant\n")


def test_empty_table(spark):
    assert chat_rotation.rotate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_in_the_plan(spark):
    df = chat_rotation.rotate(spark.createDataFrame([(1, 1, "a", "b", 1)], SCHEMA))
    assert "Python" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
