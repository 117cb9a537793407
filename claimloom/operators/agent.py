"""Tools and the loop that lets a chat model choose among them.

A tool is a named function with a JSON schema that returns (text, log); an error is its text, so that a model can read
it. The loop ends with the model's answer, or asks for a final one when the rounds or the tokens are used up.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of a final answer.
ANSWER_FIELDS = ("VERDICT", "EVIDENCE_CHUNKS", "PAPERS", "REASON")
FORCE = "The limit is reached. Answer now with what you have found."


@dataclass
class Tool:
    name: str
    description: str
    parameters: dict
    run: Callable[..., tuple[str, dict]]

    def schema(self) -> dict:
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": self.parameters}}


class Tools:
    """Tools by name."""

    def __init__(self, *tools: Tool):
        self.held: dict[str, Tool] = {t.name: t for t in tools}

    def add(self, tool: Tool) -> None:
        self.held[tool.name] = tool

    def get(self, name: str) -> Tool | None:
        return self.held.get(name)

    def names(self) -> list[str]:
        return list(self.held)

    def schemas(self) -> list[dict]:
        return [t.schema() for t in self.held.values()]

    def call(self, name: str, arguments: dict) -> tuple[str, dict]:
        tool = self.get(name)
        if tool is None:
            return f"Error: no tool {name}", {"error": "unknown_tool"}
        try:
            return tool.run(**arguments)
        except Exception as e:  # noqa: BLE001  the model reads what went wrong
            return f"Error: {type(e).__name__}: {e}", {"error": str(e)}


@dataclass
class Context:
    """What a run has used and read."""

    tokens: int = 0
    logs: list[dict] = field(default_factory=list)
    read: set[str] = field(default_factory=set)

    def note(self, tool: str, log: dict) -> None:
        self.tokens += int(log.get("retrieved_tokens", 0))
        self.logs.append({"tool": tool, **log})

    def fresh(self, chunk_ids: list[str]) -> list[str]:
        """Those not read before, now read."""
        new = [c for c in dict.fromkeys(chunk_ids) if c not in self.read]
        self.read.update(new)
        return new

    def summary(self) -> dict:
        calls: dict[str, int] = {}
        for x in self.logs:
            calls[x["tool"]] = calls.get(x["tool"], 0) + 1
        return {"retrieved_tokens": self.tokens, "calls": calls, "chunks_read": len(self.read)}


def run_agent(chat: Callable[[list[dict], list[dict]], dict], tools: Tools, question: str, system: str = "", most_loops: int = 12, most_tokens: int = 120_000) -> dict:
    """answer, loops, trajectory and context of one question.

    chat: (messages, tool schemas) to {content, tool_calls: [{name, arguments}], tokens}; without schemas it must answer.
    """
    messages = [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": question}]
    context, trajectory, used = Context(), [], 0
    for loop in range(1, most_loops + 1):
        reply = chat(messages, tools.schemas())
        used += int(reply.get("tokens", 0))
        calls = reply.get("tool_calls") or []
        if not calls:
            return {"answer": reply.get("content") or "", "loops": loop, "forced": False, "trajectory": trajectory, "context": context}
        messages.append({"role": "assistant", "content": reply.get("content") or "", "tool_calls": calls})
        for call in calls:
            raw = call.get("arguments") or {}
            try:
                arguments = json.loads(raw) if isinstance(raw, str) else dict(raw)
                text, log = tools.call(call["name"], arguments)
            except (json.JSONDecodeError, TypeError) as e:
                text, log = f"Error: {e}", {"error": "bad_arguments"}
            context.note(call["name"], log)
            trajectory.append({"loop": loop, "tool": call["name"], "result": text})
            messages.append({"role": "tool", "name": call["name"], "content": text})
        if used >= most_tokens:
            break
    reply = chat([*messages, {"role": "user", "content": FORCE}], [])
    return {"answer": reply.get("content") or "", "loops": loop, "forced": True, "trajectory": trajectory, "context": context}


def final_answer(text: Column) -> Column:
    """struct<verdict, evidence_chunks, papers, reason> of a reply's `KEY: value` lines; a value may go on in further lines."""
    keys = "|".join(ANSWER_FIELDS)

    def field_of(key: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?ims)^[^\S\n]*{key}[^\S\n]*:(.*?)(?=^[^\S\n]*(?:{keys})[^\S\n]*:|\z)"), F.lit(1))
        last = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))
        return F.trim(F.regexp_replace(last, r"[^\S\n]*\n\s*", " "))

    chunks = F.filter(F.transform(F.split(field_of("EVIDENCE_CHUNKS"), "[,，]"), lambda x: F.trim(x)), lambda x: x != "")
    none = F.upper(field_of("EVIDENCE_CHUNKS")).isin("NONE", "")
    return F.struct(
        field_of("VERDICT").alias("verdict"),
        F.when(none, F.array().cast("array<string>")).otherwise(chunks).alias("evidence_chunks"),
        field_of("PAPERS").alias("papers"),
        field_of("REASON").alias("reason"),
    )
