"""Who says a line: the annotator protocol, a rule annotator that needs no model, and the policy for models behind an address.

An annotator takes rows (key, span_idx, text, before, after, expected, present) and gives them `speaker` and `reason`. A model is asked in
mapInPandas batches, on rows that a filter has left; its results are written before they are used twice.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TEXT_CALLS

# Fixed values of the model policy: seconds of rest after each kind of failure, and limits.
REST = {429: 120, 500: 60, 400: 300, "health": 300}
CONTEXT, OUTPUT, TURNS, TOKENS, TIMEOUT = 40_000, 2_048, 10, 18_000, 300
ERRORS_KEPT = 5
# What a user message says that wants a call, and the tool that it wants.
FORCING = ("MUST call read_novel_lines", "Call the tool read_novel_lines", "Call read_novel_lines")
FORCED = "read_novel_lines"
# The tools' arguments with their types; those before the bar are required.
TOOLS = {
    "read_novel_lines": ("Lines of the text from a line number on, as 'number: line'.", "start integer, count integer |"),
    "search_novel": ("Lines with a keyword, with the lines around them.", "keyword string | context_lines integer"),
    "deep_search_identity": ("Clues near a line to who a described person is.", "temp_name string, around_line integer | search_forward integer, search_backward integer"),
    "find_all_references": ("Lines that have a name, with the lines around them.", "name string | max_results integer"),
}
SPEECH_VERBS = ("说道", "问道", "答道", "喊道", "笑道", "说", "问", "答", "喊")


def _arguments(name: str) -> tuple[dict[str, str], list[str]]:
    """Types of a tool's arguments, and which it requires."""
    first, rest = ([a.split() for a in part.split(",") if a.strip()] for part in TOOLS[name][1].split("|"))
    return dict(first + rest), [a for a, _ in first]


def tool_schema(name: str) -> dict:
    """What a model is told of a tool; of an unknown one only its name."""
    if name not in TOOLS:
        return {"type": "function", "function": {"name": name}}
    types, required = _arguments(name)
    parameters = {"type": "object", "properties": {a: {"type": t} for a, t in types.items()}, "required": required}
    return {"type": "function", "function": {"name": name, "description": TOOLS[name][0], "parameters": parameters}}


def call_in_text(text: str, tools: list[dict]) -> list[dict]:
    """The first call of one of the tools that a text holds, as functions.text.parse_tool_call() reads it."""
    offered = {t.get("function", t).get("name") for t in tools}
    for name, pattern in TEXT_CALLS.items():
        if name in offered and (found := re.search(pattern, text or "", re.ASCII)):
            given = [(a, int(v) if t == "integer" else v) for (a, t), v in zip(_arguments(name)[0].items(), found.groups()) if v is not None]
            return [{"function": name, "arguments": dict(given)}]
    return []


class Annotator(Protocol):
    def annotate(self, rows: DataFrame) -> DataFrame: ...


@dataclass
class RuleAnnotator:
    """By order of evidence: a speech verb with a name before the line, one after it, the alternation's turn, a single person present."""

    verbs: tuple[str, ...] = SPEECH_VERBS
    name: str = "([一-鿿]{2,4})"
    unknown: str = "?"

    def _named(self, text: Column) -> Column:
        pattern = f"{self.name}(?:{'|'.join(map(re.escape, self.verbs))})"
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    def annotate(self, rows: DataFrame) -> DataFrame:
        before, after = self._named(F.coalesce("before", F.lit(""))), self._named(F.coalesce("after", F.lit("")))
        alone = F.when(F.size("present") == 1, F.get("present", F.lit(0)))
        tries = ((before, "speech verb before"), (after, "speech verb after"), (F.col("expected"), "alternation"), (alone, "only one present"))
        reason = F.coalesce(*(F.when(t.isNotNull(), F.lit(r)) for t, r in tries), F.lit("no evidence"))
        return rows.withColumns({"speaker": F.coalesce(*(t for t, _ in tries), F.lit(self.unknown)), "reason": reason})


@dataclass
class FunctionAnnotator:
    """Any function(list of row dicts) -> list of (speaker, reason), for example a client of a model; called on batches in Python workers."""

    call: Callable[[list[dict]], list[tuple[str, str]]]

    def annotate(self, rows: DataFrame) -> DataFrame:
        call, columns = self.call, rows.columns
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, speaker string, reason string"

        def run(batches: Iterator) -> Iterator:
            for pdf in batches:
                said = call(pdf.to_dict("records"))
                yield pdf[columns].assign(speaker=[s for s, _ in said], reason=[r for _, r in said])

        return rows.mapInPandas(run, schema)


@dataclass
class Provider:
    """forces: chat takes the name of the tool that has to be called as a third argument."""

    label: str
    model: str
    chat: Callable[..., dict]
    tools: bool = True
    interval: float = 0.0
    disabled: bool = False
    resting_until: float = 0.0
    last: float = field(default=0.0, repr=False)
    forces: bool = False

    def usable(self, needs_tools: bool, now: float) -> bool:
        return not self.disabled and now >= self.resting_until and (self.tools or not needs_tools)

    def failed(self, status: int, now: float) -> None:
        if status in (401, 403):
            self.disabled = True
        else:
            self.resting_until = now + REST[429 if status == 429 else 500 if status >= 500 else 400]


class ModelError(RuntimeError):
    """status: of the answer, 0 without one."""

    def __init__(self, text: str, status: int = 0):
        super().__init__(text)
        self.status = status


@dataclass
class ProviderChain:
    """Asks the first usable provider in order; a failing one rests. The clock is a parameter, so tests need no waiting."""

    providers: list[Provider]
    clock: Callable[[], float] = time.monotonic
    wait: Callable[[float], None] = time.sleep

    def select(self, wanted: str) -> list[Provider]:
        """Exact matches of label or model, else those that contain the text; small and capital letters are the same."""
        text = wanted.lower()
        exact = [p for p in self.providers if text in (p.label.lower(), p.model.lower())]
        return exact or [p for p in self.providers if text in p.label.lower() or text in p.model.lower()]

    def call(self, messages: list[dict], tools: list[dict] | None = None) -> tuple[str, dict]:
        if estimate(messages) + OUTPUT > CONTEXT:
            raise ModelError("the messages are over the context budget")
        errors: list[str] = []
        wanted = bool(tools) and expects_tool_call(messages, FORCING)
        for p in self.providers:
            if not p.usable(bool(tools), self.clock()):
                continue
            pause = p.last + p.interval - self.clock()
            if pause > 0:
                self.wait(pause)
            p.last = self.clock()
            try:
                reply = p.chat(messages, tools, FORCED) if wanted and p.forces else p.chat(messages, tools)
                if not reply.get("tool_calls") and (written := call_in_text(reply.get("content", ""), tools or [])):
                    reply = reply | {"tool_calls": written, "coerced": True}
                if not wanted or reply.get("tool_calls"):
                    return p.label, reply
                errors.append(f"{p.label}: no tool call")
            except Exception as e:  # whatever one provider does, the next one is asked
                errors.append(f"{p.label}: {e}")
                p.failed(getattr(e, "status", 0) or 500, self.clock())
        raise ModelError("; ".join(errors[-ERRORS_KEPT:]) or "no model is free")

    def check(self, probe: list[dict], tool_probe: list[dict] | None = None) -> list[str]:
        """Labels that answer, and that answer tool_probe with a call of their own if it is given; the others rest. None at all is an error."""
        good = []
        for p in self.providers:
            try:
                p.chat(probe, None)
                if tool_probe and not p.chat(tool_probe, [tool_schema(FORCED)]).get("tool_calls"):
                    raise ModelError(f"{p.label}: tools are not called")
                good.append(p.label)
            except Exception:
                p.resting_until = self.clock() + REST["health"]
        if not good:
            raise ModelError("no model answers")
        return good


def estimate(messages: list[dict]) -> int:
    """Characters, not tokens."""
    import json

    return sum(len(m.get("content") or "") + sum(len(json.dumps(c, ensure_ascii=False)) for c in m.get("tool_calls") or ()) for m in messages)


def expects_tool_call(messages: list[dict], markers: tuple[str, ...]) -> bool:
    """No tool has answered yet and the last user message asks for one."""
    if any(m["role"] == "tool" for m in messages):
        return False
    asked = [m["content"] for m in messages if m["role"] == "user"]
    return bool(asked) and any(x in asked[-1] for x in markers)


def with_call_ids(messages: list[dict]) -> list[dict]:
    """Tool calls get ids, and each tool answer the id of the oldest call without one."""
    out, waiting, n = [], [], 0
    for m in messages:
        m = dict(m)
        if m.get("tool_calls"):
            m["tool_calls"] = [c | {"id": f"call_{n + i}"} for i, c in enumerate(m["tool_calls"])]
            waiting += [c["id"] for c in m["tool_calls"]]
            n += len(m["tool_calls"])
        elif m["role"] == "tool" and waiting:
            m["tool_call_id"] = waiting.pop(0)
        out.append(m)
    return out


@dataclass
class ToolLoop:
    """Turns with a model until it answers: tool calls are run and their results given back. At `tokens` used it is asked for its answer; unusable answers are asked again."""

    chain: ProviderChain
    tools: dict[str, Callable[..., str]]
    usable: Callable[[str], bool]
    turns: int = TURNS
    tokens: int = TOKENS

    def run(self, messages: list[dict]) -> tuple[str | None, int, int]:
        """Answer, tokens and turns with tools."""
        messages, used, rounds = list(messages), 0, 0
        for _ in range(self.turns):
            _, reply = self.chain.call(messages, [tool_schema(n) for n in self.tools])
            used += reply.get("tokens", 0)
            calls = reply.get("tool_calls") or []
            messages.append({"role": "assistant", "content": reply.get("content", ""), **({"tool_calls": calls} if calls else {})})
            if calls:
                rounds += 1
                messages += [{"role": "tool", "content": self.tools[c["function"]](**c["arguments"])} for c in calls]
                if used >= self.tokens:
                    messages.append({"role": "user", "content": "Give the final answer now."})
            elif self.usable(reply.get("content", "")):
                return reply["content"], used, rounds
            else:
                messages.append({"role": "user", "content": "That is not a usable answer."})
        return None, used, rounds
