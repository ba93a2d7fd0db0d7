"""Tool lists and tool calls in the dialects of model families.

Dialects with regular texts are expressions; tool lists and calls whose JSON has
to be kept word for word go through one Arrow function.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

CALLS = StructType([StructField("text", StringType()), StructField("calls", ArrayType(StructType([StructField("name", StringType()), StructField("arguments", StringType())])))])

#: The published texts around tool lists.
AROUND = {
    "default": (
        "You have access to the following tools:\n",
        'Use the following format if using a tool:\n```\nAction: tool name (one of [{names}])\nAction Input: the input to the tool, in a JSON format representing the kwargs (e.g. ```{{"input": "hello world", "num_beams": 5}}```)\n```\n',
    ),
    "glm4": ("你是一个名为 ChatGLM 的人工智能助手。你是基于智谱AI训练的语言模型 GLM-4 模型开发的，你的任务是针对用户的问题和要求提供适当的答复和支持。# 可用工具", ""),
    "llama3": (
        "Cutting Knowledge Date: December 2023\nToday Date: {date}\n\nYou have access to the following functions. To call a function, please respond with JSON for a function call. "
        'Respond in the format {{"name": function name, "parameters": dictionary of argument name and its value}}. Do not use variables.\n\n',
        "",
    ),
    "mistral": ("[AVAILABLE_TOOLS] ", "[/AVAILABLE_TOOLS]"),
    "qwen": (
        "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>",
        '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{{"name": <function-name>, "arguments": <args-json-object>}}\n</tool_call>',
    ),
}


def _dump(x, **how) -> str:
    return json.dumps(x, ensure_ascii=False, **how)


def _described(tool: dict) -> str:
    spec = tool["parameters"]
    needed = set(spec.get("required", []))
    out = [f"> Tool Name: {tool['name']}\nTool Description: {tool.get('description', '')}\nTool Args:\n"]
    for name, p in spec["properties"].items():
        kind = p.get("type", "") + (", required" if name in needed else "")
        more = (", should be one of [" + ", ".join(p["enum"]) + "]" if p.get("enum") else "") + (f", where each item should be {p['items'].get('type', '')}" if p.get("items") else "")
        out.append(f"  - {name} ({kind}): {p.get('description', '')}{more}\n")
    return "".join(out) + "\n"


def tools_text(dialect: str, tools: str, date: str = "") -> str:
    """The system text of a JSON list of tools; empty for none."""
    listed = json.loads(tools) if tools else []
    if not listed:
        return ""
    wrapped = [{"type": "function", "function": t} for t in listed]
    body = {
        "default": lambda: "".join(map(_described, listed)),
        "glm4": lambda: "".join(f"\n\n## {t['name']}\n\n{_dump(t, indent=4)}\n在调用上述函数时，请使用 Json 格式表示调用的参数。" for t in listed),
        "llama3": lambda: "".join(_dump(t, indent=4) + "\n\n" for t in wrapped),
        "mistral": lambda: _dump(wrapped),
        "qwen": lambda: "".join("\n" + _dump(t) for t in wrapped),
    }[dialect]()
    before, after = (x.format(date=date, names=", ".join(t["name"] for t in listed)) for x in AROUND[dialect])
    return before + body + after


def prompt(dialect: str, tools: Column, date: Column | None = None) -> Column:
    """The system text of a column of JSON tool lists.  date is only used where a dialect shows it; by default today."""
    shown = date if date is not None else F.date_format(F.current_date(), "dd MMM yyyy")

    @F.pandas_udf(StringType())
    def text(listed: pd.Series, day: pd.Series) -> pd.Series:
        return pd.Series([tools_text(dialect, x or "", d) for x, d in zip(listed, day, strict=True)], dtype=object)

    return text(tools, shown)


def calls_text(dialect: str, content: str) -> str:
    """The text of a JSON tool call or list of them; a leading <think> block stays in front.  ValueError for what can't be written."""
    thought = re.match(r"(?s)\s*<think>.*?</think>\s*", content)
    start = thought.group(0) if thought else ""
    calls = json.loads(content[len(start) :])
    calls = calls if isinstance(calls, list) else [calls]
    pairs = [(c["name"], _dump(c["arguments"])) for c in calls]
    if dialect in ("glm4", "llama3") and len(pairs) > 1:
        raise ValueError(f"{dialect} has no parallel calls")
    of = {
        "default": lambda: "".join(f"Action: {n}\nAction Input: {a}\n" for n, a in pairs),
        "glm4": lambda: "".join(f"{n}\n{a}" for n, a in pairs),
        "llama3": lambda: "".join(f'{{"name": "{n}", "parameters": {a}}}' for n, a in pairs),
        "mistral": lambda: "[" + ", ".join(f'{{"name": "{n}", "arguments": {a}}}' for n, a in pairs) + "]",
        "qwen": lambda: "\n".join(f'<tool_call>\n{{"name": "{n}", "arguments": {a}}}\n</tool_call>' for n, a in pairs),
    }
    return start + of[dialect]()


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def calls_of(dialect: str, content: str) -> list[tuple[str, str]] | None:
    """The (name, arguments) of a text's tool calls; None if it has none or one that isn't well formed."""
    if dialect == "default":
        found = re.findall(r"(?s)Action:\s*([a-zA-Z0-9_]+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*$)", content)
        items = [(name.strip(), _loads(args.strip().strip('"').strip("`"))) for name, args in found]
    elif dialect == "glm4":
        name, cut, args = content.partition("\n")
        items = [(name, _loads(args.strip()))] if cut else []
    else:
        bodies = re.findall(r"(?s)<tool_call>(.+?)</tool_call>(?=\s*<tool_call>|\s*$)", content) if dialect == "qwen" else [content]
        field = "parameters" if dialect == "llama3" else "arguments"
        items = []
        for body in bodies:
            got = _loads(body.strip())
            for call in got if isinstance(got, list) and dialect == "mistral" else [got]:
                well = isinstance(call, dict) and "name" in call and field in call
                items.append((call["name"], call[field]) if well else ("", None))
    if not items or any(args is None for _, args in items):
        return None
    return [(name, _dump(args)) for name, args in items]


def extract(dialect: str, content: Column) -> Column:
    """struct of text and calls: the calls of a text, or the text itself if it has none."""

    @F.pandas_udf(CALLS)
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [calls_of(dialect, x or "") for x in texts]
        return pd.DataFrame({"text": [None if f else x for f, x in zip(found, texts, strict=True)], "calls": [[{"name": n, "arguments": a} for n, a in f] if f else None for f in found]})

    return of(content)


def written(dialect: str, content: Column) -> Column:
    """The dialect's text of a column of JSON calls."""

    @F.pandas_udf(StringType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([calls_text(dialect, x) for x in texts], dtype=object)

    return of(content)
