"""Tools, flows of steps and the loop in which a model calls tools.

Models, web access and other backends are given as functions, so everything here
runs without a network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.json import parse_tolerant, path_steps

CHART_KINDS = ["area", "bar", "line", "composed", "scatter", "pie", "radar", "radialBar", "treemap", "funnel"]
ROUNDS = 100


def at_path(value: object, path: str) -> object:
    """The value at a path in an object or a JSON text: "" for nothing to look in, None where the path leads nowhere, objects as JSON."""
    value = parse_tolerant(value) if isinstance(value, str) else value
    if not path or not isinstance(value, (dict, list)) or not value:
        return ""
    for step in path_steps(path):
        if isinstance(step, int):
            value = value[step] if isinstance(value, list) and step < len(value) else None
        else:
            value = value.get(step) if isinstance(value, dict) else None
        if value is None:
            return None
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, (dict, list)) else value


def filled(config: object, variables: dict) -> object:
    """A configuration with ``${path}`` replaced at any depth; what has no value stays as it is."""
    if isinstance(config, str):
        def one(m: re.Match) -> str:
            found = at_path(variables, m[1])
            return m[0] if found is None else str(found)

        return re.sub(r"\$\{([^}]+)\}", one, config)
    if isinstance(config, dict):
        return {k: filled(v, variables) for k, v in config.items()}
    return [filled(v, variables) for v in config] if isinstance(config, list) else config


@dataclass
class Direct:
    """A result that goes to the user as it is, without another step or call."""

    value: object


@dataclass
class Tool:
    name: str
    description: str
    parameters: dict[str, dict]
    handler: Callable[..., object]
    required: list[str] = field(default_factory=list)


class Tools(dict):
    """Tools by name; one registered under a known name replaces it."""

    def register(self, tool: Tool) -> None:
        self[tool.name] = tool

    def problem(self, call: dict | None) -> str | None:
        """What is wrong with a call, None if nothing."""
        if not call or "name" not in call or "arguments" not in call:
            return "Missing name or arguments in function call."
        tool = self.get(call["name"])
        if tool is None:
            return "Function name does not exist."
        given = call["arguments"]
        for r in tool.required:
            if r not in given:
                return f"Missing required argument: {r}"
        unknown = [k for k in given if k not in tool.parameters]
        return f"Unknown argument: {unknown[0]} provided but not in schema." if unknown else None


def run_loop(complete: Callable[[list[dict], Tools], dict], messages: list[dict], tools: Tools, rounds: int = ROUNDS) -> object:
    """Ask the model, run the tool it calls, add the result and ask again, until it answers with ``result``.

    An unknown tool is told to the model; a repeated call with equal arguments
    isn't run again; :class:`Direct` results end the loop at once.
    """
    messages, seen = list(messages), set()
    for _ in range(rounds):
        answer = complete(messages, tools)
        call = answer.get("call")
        if call is None:
            return answer.get("result")
        key = json.dumps(call, sort_keys=True)
        if call["name"] not in tools:
            content = f'Function "{call["name"]}" not found. Try again.'
        elif key in seen:
            content = "This call was made before."
        else:
            seen.add(key)
            content = tools[call["name"]].handler(**call["arguments"])
            if isinstance(content, Direct):
                return content.value
        messages.append({"role": "function", "name": call["name"], "content": content})
    raise RuntimeError(f"no answer after {rounds} rounds")


def run_flow(steps: Iterable[dict], blocks: dict[str, Callable[[dict, dict], object]], given: dict | None = None) -> dict:
    """Steps one after the other: ``success``, ``results``, ``variables`` and ``direct``.

    A step has ``type`` and ``config``.  "start" sets variables that aren't given;
    the others run a block on the filled configuration, keep the result in the
    variable named by ``resultVariable`` or ``responseVariable``, and end the flow
    if ``directOutput`` is set.  An error ends it too.
    """
    steps, variables, results, direct = list(steps), {}, [], None
    for s in steps:
        if s["type"] == "start":
            variables |= {v["name"]: v.get("value", "") for v in s["config"].get("variables", [])}
    variables |= given or {}
    for s in steps:
        config = filled(s["config"], variables)
        try:
            if s["type"] == "start":
                result: object = dict(variables)
            else:
                if s["type"] not in blocks:
                    raise ValueError(f"Unknown flow type: {s['type']}")
                result = blocks[s["type"]](config, variables)
        except Exception as e:
            results.append({"success": False, "error": str(e)})
            break
        name = config.get("resultVariable") or config.get("responseVariable")
        if name:
            variables[name] = result
        if config.get("directOutput"):
            direct = result
            break
        results.append({"success": True, "result": result})
    return {"success": all(r["success"] for r in results), "results": results, "variables": variables, "direct": direct}


def frame_flow(df: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The same over a table: one plan of all steps."""
    for step in steps:
        df = df.transform(step)
    return df


def chart_problem(kind: str, dataset: str) -> str | None:
    """What is wrong with a chart's data, None if nothing."""
    if kind not in CHART_KINDS:
        return f"Unknown chart: {kind}"
    try:
        json.loads(dataset)
    except ValueError:
        return "The dataset is no JSON."
    return None


def call_rows(spark: SparkSession, calls: list[dict], tools: Tools) -> DataFrame:
    """(place, name, problem) of a list of calls."""
    rows = [(i, (c or {}).get("name"), tools.problem(c)) for i, c in enumerate(calls)]
    return spark.createDataFrame(rows, "place int, name string, problem string")
