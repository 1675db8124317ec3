"""Edits of a conversation of four rounds and an answer, case by case."""

import re

import pytest
from pyspark.sql import functions as F

from roundweave.functions import text as T
from roundweave.operators import edit, rounds
from roundweave.plans import QUERIES
from tests.conftest import SF

TYPE = "array<struct<role:string,content:string>>"
NOTE = "Previous tool call results:\n"


def turn(r):
    return [("assistant", f'<think>t{r}</think><tool_call>{{"n":{r}}}</tool_call>'), ("user", f"<tool_response>result_{r}</tool_response>")]


BASE = [("user", "question"), *turn(2), *turn(3), *turn(4), ("assistant", "<think>t5</think><answer>ANSWER</answer>")]


def apply(spark, column, messages=BASE, **extra):
    rows = spark.createDataFrame([(messages,)], f"m {TYPE}")
    for name, (value, kind) in extra.items():
        rows = rows.withColumn(name, F.expr(value).cast(kind))
    out = rows.select(column).first()[0]
    return out


def merged(spark, groups, messages=BASE, **options):
    rows = spark.createDataFrame([(messages, groups)], f"m {TYPE}, g array<array<int>>")
    got = rows.select(edit.merged(F.col("m"), F.col("g"), **options)).first()[0]
    return [x and tuple(x) for x in got]


def evicted(spark, drop, messages=BASE):
    rows = spark.createDataFrame([(messages, drop)], f"m {TYPE}, d array<int>")
    return [x and tuple(x) for x in rows.select(edit.evicted(F.col("m"), F.col("d"))).first()[0]]


def test_evict(spark):
    got = evicted(spark, [3])
    assert [i for i, m in enumerate(got) if m is None] == [3, 4]
    assert [m for m in got if m] == [m for i, m in enumerate(BASE) if i not in (3, 4)]
    assert [i for i, m in enumerate(evicted(spark, [3, 4])) if m is None] == [3, 4, 5, 6]
    assert evicted(spark, [1, 99]) == BASE  # round 1 and rounds that aren't there stay as they are


def test_merge_two(spark):
    got = merged(spark, [[3, 4]])
    assert [i for i, m in enumerate(got) if m is None] == [5, 6]
    assert got[3] == ("assistant", '<think>t3;\nt4</think><tool_call>{"n":3}\n{"n":4}</tool_call>')
    assert got[4] == ("user", f"<tool_response>{NOTE}result_3\nresult_4</tool_response>")


def test_merge_three_repeats_the_note(spark):
    got = merged(spark, [[2, 3, 4]])
    assert got[1][1] == '<think>t2;\nt3;\nt4</think><tool_call>{"n":2}\n{"n":3}\n{"n":4}</tool_call>'
    assert got[2][1] == f"<tool_response>{NOTE}{NOTE}result_2\nresult_3\nresult_4</tool_response>"
    gathered = merged(spark, [[2, 3, 4]], pairwise=False)
    assert gathered[2][1] == f"<tool_response>{NOTE}result_2\nresult_3\nresult_4</tool_response>"
    assert gathered[1] == got[1]


def test_merge_nothing(spark):
    assert merged(spark, []) == BASE
    assert merged(spark, [[2]]) == BASE
    assert merged(spark, [[1, 2]]) == BASE  # the question is never merged


def test_merge_with_answer(spark):
    got = merged(spark, [[4, 5]])
    assert got[5][1] == "<think>t4;\nt5</think><answer>ANSWER</answer>" and got[7] is None
    assert got[6] == BASE[6]


def test_evict_then_merge(spark):
    rows = spark.createDataFrame([(BASE,)], f"m {TYPE}")
    column = edit.compact(edit.merged(edit.evicted(F.col("m"), F.array(F.lit(4))), F.array(F.array(F.lit(2), F.lit(3)))))
    assert len(rows.select(column).first()[0]) == 4


def test_rephrased(spark):
    known = F.create_map(F.lit("t2;\nt3;\nt4"), F.lit("SHORT"))
    got = merged(spark, [[2, 3, 4]], pairwise=False, rephrased=known)
    assert got[1][1].startswith("<think>SHORT</think><tool_call>")
    other = merged(spark, [[2, 3]], pairwise=False, rephrased=known)
    assert other[1][1].startswith("<think>t2;\nt3</think>")


@pytest.mark.parametrize(
    "text, want",
    [
        ('<think>a <tool_call>{"x":1}</tool_call> b</think>', '<think>a  b</think><tool_call>{"x":1}</tool_call>'),
        ("no tags", "<think></think><tool_call></tool_call>"),
        ("<think> a </think><think></think><answer>z</answer><tool_call>c</tool_call>", "<think>a</think><answer>z</answer>"),
    ],
)
def test_canonical(spark, text, want):
    rows = spark.createDataFrame([(text,)], "c string")
    once = T.canonical_assistant(F.col("c"))
    assert rows.select(once, T.canonical_assistant(once)).first()[:] == (want, want)


def test_images(spark):
    m = [("user", "q <image>"), ("assistant", "a"), ("user", "<image><image>"), ("assistant", "b"), ("user", "<image>"), ("assistant", "z")]
    rows = spark.createDataFrame([(m, ["i0", "i1", "i2", "i3"], ["x"])], f"m {TYPE}, i array<string>, few array<string>")
    dealt = edit.images_by_message(F.col("m"), F.col("i"))
    assert rows.select(dealt).first()[0] == [["i0"], [], ["i1", "i2"], [], ["i3"], []]
    assert rows.select(edit.images_by_message(F.col("m"), F.col("few"))).first()[0] is None
    one = rows.select(edit.merged_images(dealt, F.array(F.array(F.lit(2), F.lit(3))))).first()[0]
    assert one == [["i0"], [], ["i1", "i2", "i3"], [], [], []]
    assert rows.select(edit.kept_images(dealt, F.array(F.lit(2)))).first()[0] == ["i0", "i3"]


def test_replace_think(spark):
    rows = spark.createDataFrame([("a <think>x\ny</think> b <think>z</think>",), ("none",), ("",)], "c string")
    got = [r[0] for r in rows.select(T.replace_think(F.col("c"), F.lit("$1"))).collect()]
    assert got == ["a <think>$1</think> b <think>z</think>", "<think>$1</think>\nnone", "<think>$1</think>\n"]


def test_roles(spark):
    u, a = ("user", "q"), ("assistant", "r")
    cases = {"ok": [u, a, u, a], "twice": [u, u, a], "late": [u, a, a, u], "system": [("system", "s"), u, a], "hopeless": [a, a, a, a], "empty": []}
    rows = spark.createDataFrame(list(cases.items()), f"k string, m {TYPE}").select("k", rounds.alternates(F.col("m")), rounds.repair_roles(F.col("m")))
    got = {r[0]: (r[1], r[2] and [tuple(x) for x in r[2]]) for r in rows.collect()}
    assert got["ok"] == (True, [u, a, u, a]) and got["twice"] == (False, [u, a]) and got["late"] == (False, [u, a, u])
    assert got["system"] == (False, [u, a]) and got["hopeless"] == (False, None) and got["empty"] == (True, [])


def test_critical_path_order(spark):
    long = [("user", "q"), *turn(2), *turn(3), ("assistant", "<think>t</think><answer>in 1999</answer>")]
    grounded = [("user", "q"), ("assistant", "<think>t</think>"), ("user", "it was 1999"), *turn(3), ("assistant", "<answer>in 1999</answer>")]
    cases = [
        (long[:2], "reduce", [2]), (long[:5], "reduce", [2]), ([long[0], long[1], long[-1]], "reduce", [2]), (long, None, [2]),
        (long, "odd", [2]), (long, "illogical", [2]), (long, "reduce", [2, 3]), (grounded, "reduce", [2]), (grounded, "reduce", [3]), (long, "reduce", []),
    ]
    rows = spark.createDataFrame([(i, m, s, r) for i, (m, s, r) in enumerate(cases)], f"i int, messages {TYPE}, plan_status string, remove array<int>")
    rows = edit.critical_path(rounds.with_rounds(rows).withColumn("patches", F.create_map().cast("map<int,string>")))
    got = [(r["status"], r["reason"]) for r in rows.orderBy("i").collect()]
    assert got == [
        ("no_messages", ""), ("bad_structure", ""), ("non_reducible", "no_middle_rounds"), ("parse_json", ""), ("bad_status", "odd"), ("illogical", ""),
        ("skipped", "remove_all_middle"), ("non_reducible", "grounding_loss:1999"), ("reduce", ""), ("reduce", ""),
    ]


PARTS = "conv_id int, messages array<struct<role:string,content:variant>>, groups array<array<int>>"


def test_lists_of_parts(spark):
    """Pairwise, a list stays and nothing goes into one; gathered, it gives nothing and goes."""
    import json

    part = [{"type": "text", "text": "seen"}]
    turn = lambda k, listed=(): part if k in listed else f"<think>t{k}</think><tool_call>c{k}</tool_call>" if k % 2 else f"<tool_response>r{k}</tool_response>"
    cases = {0: (), 1: (3,), 2: (1,), 3: (2, 3), 4: (1, 3, 5), 5: (4,)}
    rows = [(i, [("assistant" if k % 2 else "user", json.dumps(turn(k, listed))) for k in range(7)]) for i, listed in cases.items()]
    table = spark.createDataFrame(rows, "i int, m array<struct<role:string,content:string>>")
    table = table.select("i", F.transform("m", lambda m: F.struct(m["role"].alias("role"), F.parse_json(m["content"]).alias("content"))).alias("m"))
    groups = F.array(F.array(F.lit(2), F.lit(3), F.lit(4)))

    def got(pairwise):
        shown = lambda m: F.when(m.isNotNull(), F.to_json(m["content"]))
        return {r["i"]: [None if c is None else json.loads(c) for c in r["c"]] for r in table.select("i", F.transform(edit.merged_parts(F.col("m"), groups, pairwise), shown).alias("c")).collect()}

    think = lambda *ks: f"<think>{';'.join(f'{chr(10) if n else str()}t{k}' for n, k in enumerate(ks))}</think><tool_call>{chr(10).join(f'c{k}' for k in ks)}</tool_call>"
    one = got(True)
    assert one[0][1] == think(1, 3, 5) and one[0][3] is None and one[0][5] is None
    assert one[1][1] == think(1, 5) and one[1][3] == part and one[1][5] is None
    assert one[2][1] == part and one[2][3] == turn(3) and one[2][5] == turn(5) and one[2][4] is None
    assert one[3][1] == think(1, 5) and one[3][2] == part and one[3][4] == turn(4) and one[3][6] == turn(6)
    assert one[4][1::2] == [part, part, part]
    two = got(False)
    assert all(two[i][k] is None for i in cases for k in (3, 4, 5, 6))
    assert two[1][1] == think(1, 5) and two[2][1] == think(3, 5) and two[4][1] == "<think></think><tool_call></tool_call>"
    texts = table.select(F.explode(F.flatten(F.collect_list(F.transform(edit.as_texts(F.col("m")), lambda m: m["content"]))))).collect()
    assert sum(r[0] is None for r in texts) == sum(map(len, cases.values()))


def test_single_turn_of_a_group_is_built_anew_when_gathered(spark):
    """The last round has no turn of the user; what it would have been merged with is put into canonical form all the same."""
    messages = [("user", "q"), ("assistant", "<think>a</think><tool_call>c</tool_call>"), ("user", "<tool_response>x</tool_response><tool_response>y</tool_response>"), ("assistant", "<think>b</think><answer>z</answer>")]
    row = spark.createDataFrame([(messages, [[2, 3]])], "m array<struct<role:string,content:string>>, g array<array<int>>")
    made = row.select(edit.merged(F.col("m"), F.col("g"), pairwise=False).alias("gathered"), edit.merged(F.col("m"), F.col("g")).alias("pairwise")).first()
    assert made["gathered"][2]["content"] == "<tool_response>Previous tool call results:\nx\ny</tool_response>"
    assert made["pairwise"][2]["content"] == messages[2][1]
    assert made["gathered"][1]["content"] == made["pairwise"][1]["content"] == "<think>a;\nb</think><answer>z</answer>"


@pytest.mark.parametrize("name", ["rephrase_parts", "merge_parts", "leaf_prune", "critical_path_messages"])
def test_no_filter_works_out_what_is_exploded(spark, name):
    """A filter on the size of an array, pushed below what makes it, makes it again for each use."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [c for c in re.findall(r"^[ :|+-]*Filter (.*)", plan, re.M) if "lambdafunction" in c]
