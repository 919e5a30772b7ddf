from __future__ import annotations

from fleetlens.llm.chat import preference_pairs

SCHEMA = "pair_id long, side string, turn long, role string, text string, cut int, turns string"


def pairs(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA)
    return {r.pair_id: r for r in preference_pairs(frame).collect()}


def text(segments):
    return "".join(s.text for s in segments)


def learned(segments):
    return "".join(s.text for s in segments if s.loss)


def test_prompt_is_the_shared_beginning(spark):
    shared = [(0, "system", "be kind"), (1, "user", "hello")]
    rows = [(1, side, *t) for side in ("chosen", "rejected") for t in shared]
    rows += [(1, "chosen", 2, "assistant", "hi"), (1, "rejected", 2, "assistant", "go away")]
    rows += [(1, "chosen", 3, "user", "same"), (1, "rejected", 3, "user", "same")]
    got = pairs(spark, rows)[1]
    assert got.n_prompt_turns == 2
    assert got.prompt == "<|system|>\nbe kind<|end|>\n<|user|>\nhello<|end|>\n"
    assert text(got.chosen) == "<|assistant|>\nhi<|end|>\n<|user|>\nsame<|end|>\n"
    assert learned(got.chosen) == "hi<|end|>\n" and learned(got.rejected) == "go away<|end|>\n"


def test_equal_sides_and_missing_sides(spark):
    rows = [(1, s, 0, "user", "a") for s in ("chosen", "rejected")] + [(2, "chosen", 0, "user", "b"), (3, "other", 0, "user", "c")]
    got = pairs(spark, rows)
    assert set(got) == {1, 2}
    assert got[1].chosen == [] == got[1].rejected and got[1].n_prompt_turns == 1
    assert got[2].prompt == "" and text(got[2].chosen).startswith("<|user|>\nb") and got[2].rejected == []


def test_nulls_repeats_ties_and_long_texts(spark):
    rows = [
        (None, "chosen", None, None, None),
        (None, "rejected", None, None, ""),
        (4, "chosen", 1, "user", "b"),
        (4, "chosen", 1, "user", "b"),
        (4, "chosen", 1, "user", "a"),
        (4, "rejected", 1, "user", "a"),
        (4, "rejected", 1, "user", "b"),
        (5, "chosen", 0, "assistant", "x" * 500_000),
        (5, "rejected", 0, "assistant", "x" * 500_000 + "y"),
    ]
    got = pairs(spark, rows)
    assert got[None].n_prompt_turns == 0 and text(got[None].chosen) == "<||>\n<|end|>\n"
    assert got[4].prompt == "<|user|>\na<|end|>\n<|user|>\nb<|end|>\n"
    assert got[5].n_prompt_turns == 0 and len(text(got[5].rejected)) == len(text(got[5].chosen)) + 1


def test_empty_table(spark):
    assert pairs(spark, []) == {}
