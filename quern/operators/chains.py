"""Chains over a batch of inputs: each step adds columns. A model is a function from a Column to a Column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import ModelError
from quern.functions.prompts import VARIABLE, fill, mock_completion

Model = Callable[[Column], Column]


@dataclass(frozen=True)
class LLMChain:
    """Fills the template from the inputs (missing: empty), asks the model, trims the answer."""

    template: str
    output: str = "text"
    model: Model = mock_completion
    intermediate: bool = False

    def inputs(self) -> list[str]:
        import re

        return sorted(set(re.findall(VARIABLE, self.template)))

    def run(self, df: DataFrame) -> DataFrame:
        known = {v: F.col(f"`{v}`") for v in self.inputs() if v in df.columns}
        prompt = fill(self.template, known, "empty")
        out = df.withColumn("_prompt", prompt).withColumn("_answer", self.model(F.col("_prompt")))
        out = out.withColumn(self.output, F.btrim("_answer", F.lit(" \t\n\r\x0b\x0c")))
        if self.intermediate:
            return out.withColumnsRenamed({"_prompt": "prompt", "_answer": "llm_response"})
        return out.drop("_prompt", "_answer")


def sequential(df: DataFrame, chains: Sequence[LLMChain], return_all: bool = False, stop_on_error: bool | None = None) -> DataFrame:
    """Chain i + 1 sees the original inputs and chain i's output only. Results: the last output, or all of them.

    A null answer of a model is a failure. If ``stop_on_error`` is given, ``error`` names the first chain that failed;
    true: the row's later answers and results are null; false: the next chain goes on from what was there before.
    """
    original, now, every = list(df.columns), df, []
    for i, c in enumerate(chains):
        every.append(f"_out_{i}")
        before = F.col(c.output) if c.output in now.columns else F.lit(None).cast("string")
        held = "_held" if stop_on_error is not None else None
        if held:
            now = now.withColumn(held, before.cast("string"))
        now = c.run(now)
        if held:
            answer = F.col(c.output)
            text = F.lit(f"Chain {i} failed")
            error = F.coalesce(F.col("_error") if i else F.lit(None).cast("string"), F.when(answer.isNull(), text))
            now = now.withColumn("_error", error)
            stopped = F.col("_error").isNotNull() if stop_on_error else F.lit(False)
            now = now.withColumn(c.output, F.when(~stopped, F.coalesce(answer, F.col(held)) if not stop_on_error else answer))
        now = now.withColumn(f"_out_{i}", F.col(c.output))
        keep = [x for x in original if x != c.output]
        now = now.select(*keep, c.output, *every, *(["_error"] if held else []))
    outs = chains if return_all else chains[-1:]
    first = len(chains) - len(outs)
    names = {c.output: f"_out_{first + i}" for i, c in enumerate(outs)}
    errors = [] if stop_on_error is None else [F.col("_error").alias("error")]
    return now.select(*[x for x in original if x not in names], *[F.col(v).alias(k) for k, v in names.items()], *errors)


class Registry(dict):
    """Makers of chains, models or tools by name; names are listed in order, an unknown one is an error."""

    def make(self, name: str, *args, **kwargs):
        if name not in self:
            raise ModelError(f"nothing is registered as {name!r}")
        return self[name](*args, **kwargs)

    def names(self) -> list[str]:
        return sorted(self)


#: Models by provider: functions that make one from its settings. All are mocks, as no network is used.
MODELS = Registry(openai=lambda config=None: mock_completion)
CHAINS = Registry(llm=LLMChain, sequential=lambda chains, **k: lambda df: sequential(df, chains, **k))


def tools(df: DataFrame, registry: Mapping[str, Callable[[Column], Column]], tool: str = "tool", argument: str = "input") -> DataFrame:
    """Adds the observation of the tool that each row names; an unknown one is an error text."""
    found = F.coalesce(*[F.when(F.col(tool) == k, f(F.col(argument))) for k, f in registry.items()], F.concat(F.lit("Error: Tool not found: "), F.col(tool)))
    return df.withColumn("observation", found)
