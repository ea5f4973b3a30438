"""Models that work on batches, inside tasks: scorers of pairs, and writers of answers."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
#: The models that this worker has loaded; workers outlive their tasks.
_loaded: dict[str, Callable] = {}


def loaded(token: str, load: Callable[[], Callable]) -> Callable:
    """The model of that token, loaded once a worker."""
    if token not in _loaded:
        _loaded[token] = load()
    return _loaded[token]


@dataclass(frozen=True)
class BatchScorer:
    """A scorer of (query, text) pairs: ``load`` makes a function from a list of pairs to their scores, which gets ``batch`` pairs at a time."""

    load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]
    batch: int = 32
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __call__(self, query: Column, text: Column) -> Column:
        """The score of each row; null for the rows of a batch that fails, or whose score is no number."""
        load, batch, token = self.load, self.batch, self.token

        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for asked, texts in parts:
                pairs = list(zip(asked.fillna("").tolist(), texts.fillna("").tolist()))
                out: list[float | None] = []
                for at in range(0, len(pairs), batch):
                    some = pairs[at : at + batch]
                    try:
                        scores = [float(x) for x in loaded(token, load)(some)]
                        if len(scores) != len(some):
                            raise ValueError(f"{len(scores)} scores for {len(some)} pairs")
                    except Exception:
                        log.exception("a batch can't be scored; its queries keep their order")
                        scores = [None] * len(some)
                    out += scores
                yield pd.Series(out, index=asked.index, dtype="float64")

        run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "double")(query, text)


def written(prompts: DataFrame, load: Callable[[], Callable[[str], str | Iterator[str]]], retries: int = 1, token: str | None = None) -> DataFrame:
    """``prompts`` (prompt, ...) with reply and failure: what a model makes of each prompt, in tasks.

    A failing call is repeated ``retries`` times; after that the reply is empty and failure tells the error. A null
    prompt has an empty reply and fails.
    """
    token = token or uuid.uuid4().hex
    names = prompts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def one(prompt: str | None) -> tuple[str, str | None]:
        failure: str | None = "no prompt"
        for _ in range(1 + retries if prompt is not None else 0):
            try:
                reply = loaded(token, load)(prompt)
                return reply if isinstance(reply, str) else "".join(reply), None
            except Exception as e:
                failure = f"{type(e).__name__}: {e}"
        return "", failure

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            made = [one(None if p is None or p is pd.NA else p) for p in rows["prompt"].tolist()]
            yield rows.assign(reply=[r for r, _ in made], failure=pd.Series([f for _, f in made], index=rows.index, dtype=object))[[*names, "reply", "failure"]]

    return prompts.mapInPandas(run, f"{schema}, reply string, failure string")
