"""Encoder inputs: text with the model's query/passage prefix (unknown model: none)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.functions.text import encoder_prefix


def encoder_inputs(texts: DataFrame, key: str, text: str, models: list[str], profiles: dict) -> DataFrame:
    """One row per (model, mode, text): model_id, mode, key, input_text."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(mode).alias("mode"))
                      for m in models for mode in ("query", "passage")])
    x = texts.select(F.col(key).alias("key"), F.col(text).alias("text"), F.explode(pairs).alias("mm"))
    out = None
    for mode in ("query", "passage"):
        part = (x.filter(F.col("mm.mode") == mode)
                .select(F.col("mm.model_id").alias("model_id"), F.lit(mode).alias("mode"), "key",
                        F.concat(encoder_prefix(profiles, F.col("mm.model_id"), mode), F.col("text")).alias("input_text")))
        out = part if out is None else out.unionByName(part)
    return out


def encoder_slot(texts: DataFrame, encode_batch, key: str = "key", text: str = "text",
                 model_id: str = "model") -> DataFrame:
    """Encode texts with a sentence encoder via ``mapInPandas``.

    ``encode_batch(list[str]) -> 2-D array`` (rows unit-normalised by the slot);
    the result (model_id, key, vec) feeds ``match.dense_top_k``. Encode distinct
    texts only: deduplicate before calling the slot.
    """
    import numpy as np

    schema = f"model_id string, key {texts.schema[key].dataType.simpleString()}, vec array<double>"

    def run(batches):
        import pandas as pd
        for pdf in batches:
            if pdf.empty:
                continue
            m = np.asarray(encode_batch(pdf[text].tolist()), dtype=np.float64)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(n == 0, 1.0, n)
            yield pd.DataFrame({"model_id": model_id, "key": pdf[key].to_numpy(), "vec": list(m)})

    return texts.select(key, text).mapInPandas(run, schema)
