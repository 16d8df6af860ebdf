"""What a trainer outside Spark needs: its configuration as JSON, and how token rows are padded for it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

#: The layers that get adapters.
TARGETS = {
    "attn": ["q_proj", "k_proj", "v_proj", "o_proj"],
    "attn_mlp": ["q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj"],
}


def device(cuda: bool, mps: bool) -> tuple[str, str]:
    """Where a trainer or model runs and in which numbers, by what the machine has."""
    return ("cuda", "bfloat16") if cuda else ("mps", "float32") if mps else ("cpu", "float32")


@dataclass(frozen=True)
class TrainingConfig:
    # The defaults.

    base_model: str
    epochs: float = 1.0
    learning_rate: float = 1e-4
    device_batch: int = 1
    accumulate: int = 16
    rank: int = 16
    alpha: int = 32
    dropout: float = 0.05
    max_length: int = 2048
    eval_fraction: float = 0.02
    targets: str = "attn"
    seed: int = 42
    dtype: str = "float32"

    def __post_init__(self):
        if self.targets not in TARGETS:
            raise ValueError(f"targets must be one of {sorted(TARGETS)}, not {self.targets!r}")

    def exported(self, n_train: int, n_eval: int) -> dict:
        """The configuration for so many rows; without rows for evaluation no evaluation is asked for."""
        out = asdict(self) | {"targets": TARGETS[self.targets], "n_train": n_train, "n_eval": n_eval}
        # fixed values of the schedule
        out |= {"scheduler": "cosine", "warmup_ratio": 0.03, "logging_steps": 10, "save_steps": 200, "save_total_limit": 2, "bias": "none", "task": "CAUSAL_LM"}
        out |= {"gradient_checkpointing": True, "tokens_are_ready": True, "bf16": self.dtype == "bfloat16", "fp16": False, "report_to": []}
        return out | ({"eval_strategy": "steps", "eval_steps": 100} if n_eval else {"eval_strategy": "no"})


def pad_id(pad: int | None, end: int) -> int:
    """The id that fills rows: the vocabulary's own, else that of the text's end."""
    return end if pad is None else pad


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    """One JSON object as a text table, so that any store that Spark writes to will do."""
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])
