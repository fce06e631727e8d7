"""Pluggable text -> text inference over a DataFrame.

``infer(df, fn, prompt_col)`` applies ``fn(list[str]) -> list[str]`` to Arrow
batches with ``mapInPandas``; ``fn`` is supplied by the user (a model client)
and resolved by name from a registry (argument > environment > default).
Filter rows BEFORE calling: Catalyst does not push filters through
``mapInPandas``, and every row that reaches it costs a model call.

Answers are put into a ledger in the shared folder after each call, by a digest of
the prompt.  A task that is run again (it failed half-way, or its executor was lost)
reads the ledger of its partition first and asks only for what is missing; so does a
second action on the same DataFrame.

``EchoModel`` is the deterministic offline model used by the tests: it
answers every ``### <n>. <label>`` item of a batch prompt with
``[<n>] summary of <label>``, and deviates by batch number so that the
parsing rules are exercised (batch % 5 == 0 drops item 2, % 7 == 0 repeats
item 1 with another text at the end, % 3 == 0 appends a code fence to each
text and a prose line).  For project prompts it echoes metadata.
"""

from __future__ import annotations

import hashlib
import inspect
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.store import SharedTables, scratch_path, spread

_ITEM = re.compile(r"^### (\d+)\. (\S+)", re.MULTILINE)
_BATCH = re.compile(r"^Batch (\d+)/(\d+)", re.MULTILINE)
_META = re.compile(r"^- (Language|Framework): (.+)$", re.MULTILINE)
_PROJECT = re.compile(r"^Project: (\S+)", re.MULTILINE)
_QUESTION = re.compile(r"\nQuestion: (.*)\Z", re.DOTALL)


class EchoModel:
    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) for p in prompts]

    @staticmethod
    def answer(prompt: str) -> str:
        if prompt is None:
            return ""
        q = _QUESTION.search(prompt)
        if q:
            return f"answer to: {q.group(1)}"
        proj = _PROJECT.search(prompt)
        if proj:
            meta = [v.strip() for _, v in _META.findall(prompt) if v.strip() != "Unknown"]
            return (f"SUMMARY: summary of project {proj.group(1)}\n"
                    f"TECHNOLOGIES: {', '.join(meta)}\nFEATURES: graphs, search, ")
        b = _BATCH.search(prompt)
        batch_no = int(b.group(1)) if b else 1
        lines = []
        items = _ITEM.findall(prompt)
        for pos, label in items:
            if batch_no % 5 == 0 and pos == "2":
                continue
            text = f"summary of {label}"
            if batch_no % 3 == 0:
                text += "```"
            lines.append(f"[{pos}] {text}")
        if batch_no % 7 == 0 and items:
            lines.append(f"[1] revised summary of {items[0][1]}")
        if batch_no % 3 == 0:
            lines.append("These are the summaries.")
        return "\n".join(lines)


PROVIDERS: dict[str, Callable[[], Callable[[list[str]], list[str]]]] = {
    "echo": EchoModel,
}
DEFAULT_PROVIDER = "echo"


def resolve_provider(provider: str | None = None) -> Callable[[list[str]], list[str]]:
    """Provider = argument, else $CODEWEAVE_PROVIDER, else the default;
    lower-cased and stripped; unknown names are an error."""
    name = (provider or os.environ.get("CODEWEAVE_PROVIDER") or DEFAULT_PROVIDER).strip().lower()
    if name not in PROVIDERS:
        raise ValueError(f"unknown inference provider {name!r}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name]()


def resolve_model(provider: str | None = None, model: str | None = None) -> str | None:
    """Model name = argument, else $CODEWEAVE_MODEL, the latter only when no
    provider was given (a name in the environment belongs to its provider)."""
    return model or (None if provider else os.environ.get("CODEWEAVE_MODEL")) or None


def infer(df: DataFrame, fn: Callable[..., list[str]] | str | None, prompt_col: str,
          out_col: str = "response", batch_size: int = 16, max_tokens_col: str | None = None,
          model: str | None = None, api_key: str | None = None, deal: bool = True) -> DataFrame:
    """Add ``out_col`` = fn(prompt) for every row, in batches of
    ``batch_size`` prompts per call.  Rows are dealt over the tasks first, unless they
    are already (``deal``).

    A function that names them gets ``max_tokens`` (F2: the response budget of
    each prompt, from ``max_tokens_col``), ``model`` and ``api_key``."""
    call = fn if callable(fn) else resolve_provider(fn)
    given = {"model": resolve_model(None if callable(fn) else fn, model), "api_key": api_key}
    known = inspect.signature(call).parameters
    every = any(p.kind is p.VAR_KEYWORD for p in known.values())
    given = {k: v for k, v in given.items() if v is not None and (every or k in known)}
    budget = max_tokens_col if max_tokens_col and (every or "max_tokens" in known) else None
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType())])
    names = df.columns

    ledger = SharedTables(scratch_path(df, "ledger"))
    settings = repr((given.get("model"), None if callable(fn) else fn))

    def digest(prompt: str | None, tokens) -> str:
        return hashlib.sha256(repr((prompt, tokens, settings)).encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = f"p{TaskContext.get().partitionId()}"
        told: dict[str, str] = {}
        for part in ledger.names(mine):
            table = ledger.get(part)
            told.update(zip(table.column("digest").to_pylist(), table.column("answer").to_pylist(), strict=True))
        for pdf in batches:
            prompts = pdf[prompt_col].tolist()
            tokens = pdf[budget].tolist() if budget else [None] * len(prompts)
            keys = [digest(p, t) for p, t in zip(prompts, tokens, strict=True)]
            todo = {k: i for i, k in reversed(list(enumerate(keys))) if k not in told}
            asked = sorted(todo.values())
            for at in range(0, len(asked), batch_size):
                some = asked[at:at + batch_size]
                more = {"max_tokens": [tokens[i] for i in some]} if budget else {}
                answers = dict(zip((keys[i] for i in some), call([prompts[i] for i in some], **more, **given), strict=True))
                ledger.put(f"{mine}/{uuid.uuid4().hex}", pa.table(
                    {"digest": pa.array(list(answers), pa.string()), "answer": pa.array(list(answers.values()), pa.string())}))
                told.update(answers)
            pdf = pdf[names].copy()
            pdf[out_col] = [told[k] for k in keys]
            yield pdf

    return (spread(df) if deal else df).mapInPandas(run, schema)
