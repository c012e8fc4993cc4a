from pyspark.sql import functions as F

from panelloom.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def rendered(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def trained(text, mask):
    at, out = 0, []
    for m in mask:
        if m["loss"]:
            out.append(text[at : at + m["length"]])
        at += m["length"]
    assert at == len(text)
    return out


def test_prefix_is_rendered_once_and_completions_are_masked(spark):
    good = [("system", "be kind"), ("user", "hi"), ("assistant", "hellö"), ("user", "more"), ("assistant", "fine")]
    poor = [("system", "be kind"), ("user", "hi"), ("assistant", "go away")]
    make = lambda ts: spark.createDataFrame([(7, k, r, t) for k, (r, t) in enumerate(ts)], TURNS)
    (row,) = chat.preference_pairs(make(good), make(poor)).collect()
    assert row.n_prompt_turns == 2 and row.prompt == rendered(good[:2])
    assert row.chosen == rendered(good[2:]) and row.rejected == rendered(poor[2:])
    assert trained(row.chosen, row.chosen_mask) == ["hellö<|im_end|>\n", "fine<|im_end|>\n"]
    assert trained(row.rejected, row.rejected_mask) == ["go away<|im_end|>\n"]


def test_edges(spark):
    rows = [
        (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"),
        (8, 0, "user", None), (9, 1, "assistant", ""), (9, 0, None, "q"), (None, 0, "user", "lost"),
        (20, 0, "user", "u"), (20, 1, "assistant", "x"), (20, 1, "assistant", "x"), (20, 2, "user", "z" * 50_000),
    ]
    turns = spark.createDataFrame(rows, TURNS).withColumn("reply", F.lit(1)).withColumn("last", F.lit(2))
    got = {r.pair_id: r for r in chat.format_pairs(chat.pairs_from_conversations(turns)).collect()}
    assert set(got) == {2, 3, 8, 9, 20}
    assert got[2].n_prompt_turns == 2 and got[2].chosen == got[2].rejected == "" and got[2].chosen_mask == []
    assert got[8].prompt == rendered([("user", "")]) and got[8].chosen == ""
    assert got[9].prompt == rendered([(None, "q"), ("assistant", "")])
    assert got[20].prompt == rendered([("user", "u"), ("assistant", "x")]) and got[20].rejected == rendered([("assistant", "")])
    assert chat.format_pairs(chat.pairs_from_conversations(turns.limit(0))).count() == 0


def test_turns_after_the_last_reply_stay(spark):
    first = [("user", "a"), ("assistant", "b"), ("user", "thanks"), ("tool", None)]
    second = [("user", "c"), ("assistant", "d"), ("assistant", "e")]
    same = [("user", "c"), ("assistant", "e"), ("user", "bye")]
    rows = [(c, k, r, t) for c, ts in ((4, first), (5, second), (6, same), (7, same)) for k, (r, t) in enumerate(ts)]
    got = {r.pair_id: r for r in chat.format_pairs(chat.pairs_from_conversations(spark.createDataFrame(rows, TURNS), whole=True)).collect()}
    assert got[4].n_prompt_turns == 1 and got[4].prompt == rendered(first[:1])
    assert got[4].chosen == rendered(first[1:]) and got[4].rejected == rendered([("assistant", "e"), *first[2:]])
    assert trained(got[4].chosen, got[4].chosen_mask) == ["b<|im_end|>\n"]
    assert trained(got[4].rejected, got[4].rejected_mask) == ["e<|im_end|>\n"]
    assert got[5].n_prompt_turns == 2 and got[5].rejected == rendered([("assistant", "b")])
    assert got[6].prompt == rendered(same) and got[6].chosen == got[6].rejected == ""


def test_query_keeps_every_turn(spark, tmp_path):
    from panelloom.llm.registry import op4_preference_format

    rows = [(4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "thanks"), (5, 0, "assistant", "c")]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.pair_id: r for r in op4_preference_format(spark, str(tmp_path)).collect()}
    assert got[4].prompt + got[4].chosen == rendered([r[2:] for r in rows[:3]])
    assert got[4].rejected == rendered([("assistant", "c"), ("user", "thanks")])
    assert got[4].rejected_mask.endswith(":1,17:0,17:0")


def test_missing_side(spark):
    some = spark.createDataFrame([(1, 0, "user", "a")], TURNS)
    (row,) = chat.preference_pairs(some, some.limit(0)).collect()
    assert (row.n_prompt_turns, row.prompt, row.chosen, row.rejected) == (0, "", rendered([("user", "a")]), "")
