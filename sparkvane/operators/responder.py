"""Text generation stays outside Spark: a batch interface, and a template that stands in for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvane.functions.text import chat_turn, py_strip
from sparkvane.operators.tensorprep import Tokenizer

#: Fixed value: what an empty generation becomes.
EMPTY_RESPONSE = "Here are some songs you might enjoy."

Generate = Callable[[pd.DataFrame], "pd.Series"]


def template_responder(batch: pd.DataFrame) -> pd.Series:
    """Names the first candidate. Deterministic; not a model's output."""
    line = batch["system_prompt"].str.extract(r"\n1\. ([^\n]*)", expand=False).fillna("")
    return line.where(line == "", "Try " + line + ".")


def generation_inputs(prompts: DataFrame, tokenizer: Tokenizer, max_input: int = 3072) -> DataFrame:
    """prompts (session_id, system_prompt, query) and input_text, the chat up to where the assistant begins, and input_ids, cut on the right."""
    text = F.concat(chat_turn("system", F.col("system_prompt")), chat_turn("user", F.col("query")), F.lit("<|im_start|>assistant\n"))
    held = prompts.withColumn("input_text", text)
    return held.withColumn("input_ids", F.slice(tokenizer(F.col("input_text")), 1, max_input))


def respond(prompts: DataFrame, generate: Generate = template_responder) -> DataFrame:
    """session_id, predicted_response: generate runs once for each Arrow batch and sees every column of prompts."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"session_id": x["session_id"], "predicted_response": generate(x)})

    made = prompts.mapInPandas(batches, "session_id string, predicted_response string")
    text = py_strip(F.coalesce("predicted_response", F.lit("")))
    return made.withColumn("predicted_response", F.when(text == "", EMPTY_RESPONSE).otherwise(text))
