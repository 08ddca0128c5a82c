from cadenza.llm.preference import crossed_pairs, format_preferences

ROWS = [
    (1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes <|end|>"), (1, "rejected", 1, "assistant", None), (1, "rejected", 2, "user", "x"),
    (2, "chosen", 0, "user", None), (2, "rejected", 0, None, ""), (3, "rejected", 0, "user", "q"), (4, "chosen", None, "system", "s"), (4, "chosen", 5, "assistant", "a"),
    (5, "chosen", 0, "user", "same"), (5, "rejected", 0, "user", "same"), (5, "chosen", 0, "user", "same"), (5, "rejected", 0, "user", "same"), (None, "chosen", 0, "user", "n"),
]


def test_pairs(spark):
    df = spark.createDataFrame(ROWS, "pair_id long, side string, turn long, role string, text string").selectExpr("*", "1 as n", "2 as c")
    got = {r.pair_id: r for r in format_preferences(df).collect()}
    assert set(got) == {1, 2, 4, 5, None}
    a = got[1]
    assert (a.prompt_turns, a.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert a.chosen == "<|assistant|>\nyes < |end|><|end|>\n" and a.rejected == "<|assistant|>\n<|end|>\n<|user|>\nx<|end|>\n"
    assert [a.chosen[m.start : m.end] for m in a.chosen_mask] == ["yes < |end|><|end|>"] and [a.rejected[m.start : m.end] for m in a.rejected_mask] == ["<|end|>"]
    assert got[2].prompt_turns == 0 and got[4].rejected == "" and (got[5].prompt_turns, got[5].chosen, got[5].rejected) == (2, "", "")
    assert format_preferences(df.limit(0)).count() == 0


def test_marks_in_roles_and_texts(spark):
    rows = [(1, "chosen", 0, "a|>\nx<|end|>\n<|b", "t"), (1, "rejected", 0, "a|>\nx<|end|>\n<|b", "t"), (1, "chosen", 1, "assistant", "|> <|assistant|>"), (1, "rejected", 1, "assist|>ant", "r")]
    (r,) = format_preferences(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).collect()
    for text, turns in ((r.prompt, 1), (r.chosen, 1), (r.rejected, 1)):
        assert text.count("<|end|>\n") == turns and text.count("<|") == 2 * turns and text.count("|>\n") == 2 * turns
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == ["|> < |assistant|><|end|>"] and r.rejected_mask == []


def test_native(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = format_preferences(crossed_pairs(conv))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
