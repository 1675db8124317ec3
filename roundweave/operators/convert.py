"""Converters of samples to messages, tool calls and recorded traces. All are row-wise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundweave.functions import text as T

PART = "struct<role:string,value:string,loss_weight:double>"


def alpaca(system: Column, instruction: Column, input_: Column, output: Column) -> Column:
    """Messages (role, value, loss_weight) of an instruction sample; absent fields give none."""
    none = lambda *cs: [F.coalesce(c, F.lit("")) for c in cs]
    part = lambda role, value, weight, there: F.when(there, F.struct(F.lit(role).alias("role"), value.alias("value"), F.lit(weight).alias("loss_weight")))
    parts = F.array(
        part("system", system, 0.0, system.isNotNull()),
        part("user", F.concat(*none(instruction, input_)), 0.0, instruction.isNotNull() | input_.isNotNull()),
        part("assistant", output, 1.0, output.isNotNull()),
    )
    return F.filter(parts, lambda p: p.isNotNull())


CONVERTERS = {"alpaca": alpaca}


def converter(name: str):
    """A converter by name; an unknown name is an error."""
    if name not in CONVERTERS:
        raise ValueError(f"no converter named {name}")
    return CONVERTERS[name]


#: Columns that a converter takes, in its order.
CONVERTED = {"alpaca": ("system", "instruction", "input", "output")}


def converted(rows: DataFrame, name: str, kept: tuple[str, ...] = ("at",)) -> DataFrame:
    """``messages`` made by a converter of the columns that it takes, absent ones as null; of the others only ``kept`` ones stay."""
    make = converter(name)
    taken = (F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in CONVERTED[name])
    return rows.select(*(c for c in kept if c in rows.columns), make(*taken).alias("messages"))


#: Wordings of multiple-choice prompts by language (fixed values).
CHOICE_TEMPLATES = {
    "en": ("The following are multiple choice questions (with answers) about {subject}.\n\n", "\nAnswer:"),
    "zh": ("以下是中国关于{subject}考试的单项选择题，请选出其中的正确答案。\n\n", "\n答案："),
}


def choice_prompt(example: Column, lang: str = "en") -> Column:
    """Question, choices and call for an answer of a struct (question, A, B, C, D, answer)."""
    choices = [F.concat(F.lit(f"\n{c}. "), example[c]) for c in "ABCD"]
    return F.concat(example["question"], *(F.coalesce(c, F.lit("")) for c in choices), F.lit(CHOICE_TEMPLATES[lang][1]))


def few_shot(target: Column, support: Column, subject: str, lang: str = "en") -> Column:
    """Messages (role, content): the support set's questions and answers, then the target's."""
    both = lambda e: F.array(F.struct(F.lit("user").alias("role"), choice_prompt(e, lang).alias("content")), F.struct(F.lit("assistant").alias("role"), e["answer"].alias("content")))
    every = F.flatten(F.transform(F.concat(support, F.array(target)), both))
    head = F.lit(CHOICE_TEMPLATES[lang][0].format(subject=subject))
    return F.transform(every, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, F.concat(head, m["content"])).otherwise(m["content"]).alias("content")))


def request_error(messages: Column) -> Column:
    """What is wrong with a request's messages, or null. The error texts are fixed values."""
    rest = F.when(F.get(messages, F.lit(0))["role"] == "system", F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)
    fits = lambda m, i: F.when(i % 2 == 0, m["role"].isin("user", "tool")).otherwise(m["role"].isin("assistant", "function"))
    return F.when(F.size(messages) == 0, "Invalid length").when(F.size(rest) % 2 == 0, "Only supports u/a/u/a/u...").when(~F.forall(F.transform(rest, fits), lambda ok: ok), "Invalid role")


def tool_calls(c: Column) -> Column:
    """(calls, error): JSON objects of all call tags; any that isn't JSON makes it an error."""
    bodies = T.calls(c)
    bad = F.exists(bodies, lambda b: F.try_parse_json(b).isNull())
    objects = F.filter(bodies, lambda b: F.schema_of_variant(F.try_parse_json(b)).startswith("OBJECT"))
    return F.struct(F.when(~bad, objects).alias("calls"), F.when(bad, F.concat(F.lit("Error decoding JSON in <tool_call>: "), c)).alias("error"))


#: Names of tools and of their arguments (fixed values): tool, its aliases, its required argument's aliases.
TOOLS = [
    ("web_search", ["web_search", "search"], ["queries", "query", "q"], "queries"),
    ("visit", ["visit", "visit_url", "open_url"], ["url", "urls"], "url"),
    ("code_interpreter", ["code_interpreter", "run_python", "pythoninterpreter", "run_python_code"], ["code", "code_block"], "code"),
    ("image_search", ["image_search", "vlsearchimage"], ["images", "image_urls", "urls", "image", "image_url", "url"], "images"),
]


def normalised_call(call: Column) -> Column:
    """(tool, argument, error) of a call in JSON, with the aliases of names and arguments resolved. The error texts are fixed values."""
    field = lambda *paths: F.coalesce(*(F.nullif(F.get_json_object(call, f"$.{p}"), F.lit("")) for p in paths))
    given = lambda arguments: F.coalesce(field(*(f"arguments.{a}" for a in arguments)), field(*(f"parameters.{a}" for a in arguments)))
    known = F.struct(T.strip(F.coalesce(field("name", "tool_name"), F.lit(""))).alias("named"), *(given(arguments).alias(own) for own, _, arguments, _ in TOOLS))

    def resolved(x: Column) -> Column:
        name = F.lower(x["named"])
        tool, argument, error = F.lit(None).cast("string"), F.lit(None).cast("string"), F.concat(F.lit("Invalid tool name '"), x["named"], F.lit("'. Available tools: web_search, visit, code_interpreter, image_search."))
        for own, aliases, _, shown in reversed(TOOLS):
            tool = F.when(name.isin(aliases), own).otherwise(tool)
            argument = F.when(name.isin(aliases), x[own]).otherwise(argument)
            error = F.when(name.isin(aliases), F.when(x[own].isNull(), f"[{own}] Missing '{shown}' argument.")).otherwise(error)
        return F.struct(tool.alias("tool"), argument.alias("argument"), F.when(x["named"] == "", '"name" field is required. Specify a tool name').otherwise(error).alias("error"))

    return T.let(known, resolved)


#: Nudges to a model that didn't follow the format (fixed values).
WRONG_FORMAT = "Your output format is incorrect. Please use <think>, <tool_call>, <answer> tags to wrap your output."
NO_TOOL = "You do not invoke any tool. Continue thinking or answering the question. Remember to use <think></think> or <answer></answer> to wrap your response."


def traced_turn(output: Column, results: Column) -> Column:
    """(kind, assistant, user) of a recorded output: what the trace keeps, and what it is answered.

    ``results`` is what the tools said, one text for each call. An output with an answer ends the trace, and is answered by nothing.
    """
    has = lambda tag: F.contains(output, F.lit(tag))
    untagged = ~has("<think>") & ~has("<tool_call>") & ~has("<answer>")
    parsed = tool_calls(output)
    thought = F.when(has("<think>") | has("</think>"), F.concat(F.lit("<think>"), T.think_text(output), F.lit("</think>"))).otherwise("")
    plain = F.concat(F.when(untagged, F.concat(F.lit("<think>"), output, F.lit("</think>"))).otherwise(""), thought)
    called = F.concat(plain, F.lit("<tool_call>"), F.array_join(parsed["calls"], ""), F.lit("</tool_call>"))
    names = F.array_join(F.transform(parsed["calls"], lambda c, i: F.concat(F.lit("From: "), F.coalesce(F.get_json_object(c, "$.name"), F.lit("tool_call")), F.lit("\n"), F.coalesce(F.get(results, i), F.lit("")))), "")
    assistant = F.when(has("<tool_call>") & parsed["error"].isNull(), called).when(has("<tool_call>"), output).otherwise(plain)
    user = F.when(has("<tool_call>") & parsed["error"].isNull(), F.concat(F.lit("<tool_response>"), names, F.lit("</tool_response>"))).when(has("<tool_call>"), parsed["error"]).when(untagged, NO_TOOL).otherwise(WRONG_FORMAT)
    kind = F.when(has("<answer>"), "answer").when(has("<tool_call>") & parsed["error"].isNull(), "call").when(has("<tool_call>"), "bad_call").when(untagged, "untagged").otherwise("think")
    return F.struct(kind.alias("kind"), F.when(has("<answer>"), F.concat(assistant, F.lit("<answer>"), T.answer_text(output), F.lit("</answer>"))).otherwise(assistant).alias("assistant"), F.when(~has("<answer>"), user).alias("user"))


def forced_answer(output: Column) -> Column:
    """The answer turn of an output that was forced at the last round."""
    return F.concat(F.lit("<answer>"), F.when(F.contains(output, F.lit("<answer>")), T.answer_text(output)).otherwise(output), F.lit("</answer>"))


def closed_call(c: Column) -> Column:
    """An output whose last call lacks its closing tag, with the tag put on."""
    text = T.strip(c)
    opens = F.startswith(T.strip(F.substring_index(text, "</think>", -1)), F.lit("<tool_call>"))
    return F.when(opens & ~F.endswith(text, F.lit(">")), F.concat(text, F.lit("</tool_call>"))).otherwise(c)


def rolled_up(steps: DataFrame, key: str, order: str, limit: int = 32_000) -> DataFrame:
    """One record per trace: number of calls, steps by name, and the whole trace (responses cut to ``limit``)."""
    step = F.struct(F.col(order).alias("o"), "thinking", F.substring("response", 1, limit).alias("response"), F.col("is_call"))
    listed = F.sort_array(F.collect_list(step))
    rows = steps.groupBy(key).agg(listed.alias("s"))
    names = F.transform("s", lambda x, i: F.struct(F.concat(F.lit("Step "), i + 1), x["thinking"]))
    return rows.select(key, F.size(F.filter("s", lambda x: x["is_call"])).alias("num_tool_calls"), F.map_from_entries(names).alias("steps"), F.array_join(F.transform("s", lambda x: F.concat(x["thinking"], x["response"])), "").alias("trace"))
