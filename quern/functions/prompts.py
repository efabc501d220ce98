"""Prompt templates as expressions, roles, and what a model's answer is parsed for."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

ROLES = {"human": "Human", "user": "Human", "ai": "AI", "assistant": "AI", "system": "System", "function": "Function", "tool": "Tool"}
VARIABLE = r"\{([^}]+)\}"


def role_name(role: Column) -> Column:
    """How a conversation shows a role; unknown roles are users."""
    return F.coalesce(*[F.when(role == k, F.lit(v)) for k, v in ROLES.items()], F.lit("Human"))


def known_role(role: Column) -> Column:
    return F.when(role.isin("system", "user", "assistant", "function", "tool"), role).otherwise("user")


def variables(template: Column) -> Column:
    """Names in braces, each once, in the order they first appear."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(VARIABLE), F.lit(1)))


def declared(template: str, names: Sequence[str]) -> None:
    missing = [v for v in re.findall(VARIABLE, template) if v not in names]
    if missing:
        raise ValueError(f"template uses undeclared variables: {missing}")


def fill(template: str | Column, values: Mapping[str, Column], missing: str = "error") -> Column:
    """Every place of every variable replaced, one variable after another.

    Variables without a value: an error, kept as they stand ("keep") or emptied ("empty"). A null value counts as one
    that is missing.
    """
    if isinstance(template, str):
        if missing == "error":
            declared(template, list(values))
        out = F.lit(template)
    else:
        out = template
    if missing == "empty":  # the template's own variables, before values with braces come in
        names = "|".join(re.escape(v) for v in values)
        others = "(?!(?:" + names + r")\})" if values else ""
        out = F.regexp_replace(out, r"\{" + others + r"[^}]+\}", "")
    for name, value in values.items():
        place, text = "{" + name + "}", value.cast("string")
        if missing == "error":
            text = F.coalesce(text, F.raise_error(F.lit(f"no value for {name}")).cast("string"))
        text = F.coalesce(text, F.lit("" if missing == "empty" else place))
        out = F.replace(out, F.lit(place), text)
    return out


@dataclass(frozen=True)
class Template:
    """A text with the variables that it may use; made by ``simple``, changed into new ones, filled as an expression."""

    text: str
    names: tuple[str, ...] = ()

    @classmethod
    def simple(cls, text: str) -> Template:
        """With the variables that the text shows."""
        return cls(text, tuple(dict.fromkeys(re.findall(VARIABLE, text))))

    def with_text(self, text: str) -> Template:
        return replace(self, text=text)

    def with_variable(self, name: str) -> Template:
        return self if name in self.names else replace(self, names=(*self.names, name))

    def without_variable(self, name: str) -> Template:
        return replace(self, names=tuple(n for n in self.names if n != name))

    def is_valid(self) -> bool:
        """Whether every variable of the text is declared."""
        return set(re.findall(VARIABLE, self.text)) <= set(self.names)

    def format(self, values: Mapping[str, Column]) -> Column:
        declared(self.text, self.names)
        return fill(self.text, {n: values[n] for n in self.names if n in values})


def few_shot(prefix: str, examples: Sequence[Mapping[str, str]], example: str, values: Mapping[str, Column], suffix: str = "", separator: str = "") -> Column:
    """Prefix, filled examples, the filled input and suffix, as a few-shot prompt has them."""

    def shown(e: Mapping[str, str]) -> str:
        out = example
        for k, v in e.items():
            out = out.replace("{" + k + "}", v)
        return out

    gap = separator + "\n\n" if separator else ""
    head = (prefix + "\n\n" if prefix else "") + gap.join(map(shown, examples)) + gap
    return F.concat(F.lit(head), fill(example, values), F.lit("\n\n" + suffix if suffix else ""))


def sanitize(template: Column) -> Column:
    """Three and more line feeds become two; white space around goes."""
    return F.btrim(F.regexp_replace(template, "\n{3,}", "\n\n"), F.lit(" \t\n\r"))


def pipeline(steps: Sequence[str], values: Mapping[str, Column]) -> Column:
    """Templates in turn; the i-th result (from 1) is step_<i>_result for those after it. The last is the result."""
    known, out = dict(values), F.lit("")
    for i, template in enumerate(steps):
        out = fill(template, known, "keep")
        known[f"step_{i + 1}_result"] = out
    return out


def few_shot_text(prefix: str, examples: Sequence[Mapping[str, str]], example: str, suffix: str = "", separator: str = "") -> str:
    """A few-shot prompt without its input: prefix, filled examples and suffix."""
    gap = separator + "\n\n" if separator else ""
    filled = [re.sub(VARIABLE, lambda m: e.get(m[1], m[0]), example) for e in examples]  # noqa: B023
    return (prefix + "\n\n" if prefix else "") + gap.join(filled) + gap + ("\n\n" + suffix if suffix else "")


def pipeline_text(steps: Sequence[str]) -> str:
    return "\n\n---\n\n".join(f"Step {i + 1}:\n{x}" for i, x in enumerate(steps))


def _rows(*parts: Column) -> Column:
    """The messages of a group in order; to be used in an aggregation."""
    return F.sort_array(F.collect_list(F.struct(*parts)))


def chat_text(turn: Column, role: Column, text: Column) -> Column:
    """Of a group of messages: a paragraph for each, with its role, in order of turns."""
    line = F.concat(F.lit("["), role, F.lit("]: "), text, F.lit("\n\n"))
    return F.array_join(F.transform(_rows(turn.alias("t"), line.alias("l")), lambda x: x["l"]), "")


def chat_json(turn: Column, role: Column, text: Column) -> Column:
    """Of a group of messages: {"messages": [{"role", "content"}, ...]} in order of turns, with escapes."""
    messages = F.transform(_rows(turn.alias("t"), role.alias("role"), text.alias("content")), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return F.to_json(F.struct(messages.alias("messages")))


def mock_completion(prompt: Column) -> Column:
    return F.concat(F.lit("Mock OpenAI response to: "), prompt)


def mock_stream(prompt: Column) -> Column:
    """What a model says in pieces of five characters."""
    return F.concat(F.lit("Mock streaming OpenAI response to: "), prompt)


#: What a model says to a conversation in pieces of three characters.
STREAMED_CHAT = "Mock streaming OpenAI chat response"


def mock_chat(turn: Column, role: Column, text: Column) -> Column:
    """Of a group of messages: the answer names all of them; a backslash and an n stand between."""
    line = F.concat(F.lit("["), role, F.lit("] "), text, F.lit("\\n"))
    return F.concat(F.lit("Mock OpenAI chat response to: "), F.array_join(F.transform(_rows(turn.alias("t"), line.alias("l")), lambda x: x["l"]), ""))


def chunks(text: Column, n: int) -> Column:
    """The text in pieces of n characters, as a stream gives them."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(text), F.lit(n)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


ACTION = r"Action:\s*(\w+)\s*\[?([^\]]*)\]?"


def action(text: Column) -> Column:
    """(tool, input) of an agent's answer; empty if it has no action."""
    return F.struct(F.regexp_extract(text, ACTION, 1).alias("tool"), F.regexp_extract(text, ACTION, 2).alias("input"))


def is_final(text: Column, stop: str = "Final Answer:") -> Column:
    return text.contains(stop)


# The models that are known by name.
MODELS = tuple("gpt-4 gpt-4-turbo-preview gpt-4-32k gpt-3.5-turbo gpt-3.5-turbo-16k text-davinci-003 text-davinci-002 text-curie-001 text-babbage-001 text-ada-001".split())


# What the known models can do.
CAPABILITIES = {"completion": True, "chat": True, "streaming": True, "function_calling": True, "multimodal": False}


def can(capability: Column) -> Column:
    """Whether a model has a capability; false for one that is not known."""
    return F.coalesce(*[F.when(capability == k, F.lit(v)) for k, v in CAPABILITIES.items()], F.lit(False))


def is_model_supported(name: Column) -> Column:
    return name.isin(*MODELS)


def priority_name(x: Column) -> Column:
    return F.when(x.isin("LOW", "NORMAL", "HIGH", "CRITICAL"), x).otherwise("NORMAL")


def status_name(x: Column) -> Column:
    return F.when(x.isin("PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"), x).otherwise("PENDING")
