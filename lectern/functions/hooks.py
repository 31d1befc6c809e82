"""Places for models: tokenizers, embedders, rerankers and remote clients as Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokenizer_column(tokenize: Callable[[str], list[str]], c: Column) -> Column:
    """Tokens by a Python segmenter, in Arrow batches; NULL gives NULL."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else list(tokenize(x)))

    return run(c)


def embed(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """(key, embedding): ``load`` gives a batch embedder once in each task; blank texts get a zero vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            texts = batch[text].fillna("")
            vectors = model(texts.tolist()) if len(texts) else []
            yield pd.DataFrame({key: batch[key], "embedding": [[0.0] * len(v) if not t.strip() else list(v) for t, v in zip(texts, vectors, strict=True)]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def reranker_column(score: Callable[[list[str], list[str]], list[float]], query: Column, text: Column) -> Column:
    """Scores of (query, text) pairs by a model, in Arrow batches."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(score(queries.tolist(), texts.tolist()), dtype="float64")

    return run(query, text)


def model_outputs(df: DataFrame, key: str, prompt: str, client: Callable[[str], str], retries: int = 2) -> DataFrame:
    """(key, output, error): a client called for each row, again up to ``retries`` times; failures stay rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outputs, errors = [], []
            for text in batch[prompt]:
                output = error = None
                for _ in range(retries + 1):
                    try:
                        output, error = client(text), None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a remote client is a row's error
                        error = f"{type(e).__name__}: {e}"
                outputs.append(output)
                errors.append(error)
            yield pd.DataFrame({key: batch[key], "output": outputs, "error": errors})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, output string, error string")
