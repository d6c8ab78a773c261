"""Configuration records, validated when a plan is built."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRUE_WORDS = ("yes", "true", "t", "y", "1")
FALSE_WORDS = ("no", "false", "f", "n", "0")


def str2bool(value: object) -> bool:
    """A flag's text as a boolean; None is False, anything unknown an error."""
    if isinstance(value, bool):
        return value
    if value is None:
        return False
    word = str(value).strip().lower()
    if word in TRUE_WORDS or word in FALSE_WORDS:
        return word in TRUE_WORDS
    raise ValueError(f"not a boolean: {value!r}")


def parse_bool(flag: Column) -> Column:
    """:func:`str2bool` of a string column; unknown words fail the query."""
    word = F.lower(F.trim(flag))
    return (
        F.when(flag.isNull(), F.lit(False)).when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), flag)).cast("boolean"))
    )


@dataclass(frozen=True)
class ModelConfig:
    dim: int = 512
    n_layers: int = 8
    n_heads: int = 8
    n_kv_heads: int = 8
    vocab_size: int = 6400
    hidden_dim: int | None = None
    multiple_of: int = 64
    norm_eps: float = 1e-5
    max_seq_len: int = 1024
    rope_theta: float = 1e6
    dropout: float = 0.0

    def __post_init__(self) -> None:
        if self.n_heads % self.n_kv_heads:
            raise ValueError("n_heads must be divisible by n_kv_heads")
        if self.dim % self.n_heads:
            raise ValueError("dim must be divisible by n_heads")
        if self.max_seq_len <= 0:
            raise ValueError("max_seq_len must be positive")

    @property
    def head_dim(self) -> int:
        return self.dim // self.n_heads

    @property
    def ffn_dim(self) -> int:
        """Two thirds of four times the width, rounded up to a multiple of ``multiple_of``."""
        if self.hidden_dim is not None:
            return self.hidden_dim
        return -(-int(8 * self.dim / 3) // self.multiple_of) * self.multiple_of

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Every parameter; the embedding is the output head too."""
        d, kv, h = self.dim, self.n_kv_heads * self.head_dim, self.ffn_dim
        out: dict[str, tuple[int, ...]] = {"embedding": (self.vocab_size, d)}
        for i in range(self.n_layers):
            out |= {
                f"layers.{i}.attention_norm": (d,), f"layers.{i}.wq": (d, d), f"layers.{i}.wk": (kv, d), f"layers.{i}.wv": (kv, d), f"layers.{i}.wo": (d, d),
                f"layers.{i}.ffn_norm": (d,), f"layers.{i}.w1": (h, d), f"layers.{i}.w2": (d, h), f"layers.{i}.w3": (h, d),
            }
        return out | {"norm": (d,)}

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([asdict(self)], "dim int, n_layers int, n_heads int, n_kv_heads int, vocab_size int, hidden_dim int, multiple_of int, norm_eps double, max_seq_len int, rope_theta double, dropout double")


@dataclass(frozen=True)
class TrainConfig:
    """Options that all training stages share."""

    save_dir: str = "results"
    epochs: int = 1
    batch_size: int = 8
    learning_rate: float = 1e-4
    device: str = "cpu"
    use_tracker: bool = False
    tracker_project: str = "corpusloom"
    dtype: str = "float32"
    num_workers: int = 0
    accumulation_steps: int = 1
    grad_clip: float = 1.0
    log_step: int = 10
    save_step: int = 1000
    max_seq_len: int = 512
    data_path: str = "datasets/pretrain.jsonl"
    resume_from: str | None = None
    seed: int = 1337


#: What each stage sets differently.
STAGES: dict[str, dict] = {
    "pretrain": {"learning_rate": 5e-4},
    "sft": {"learning_rate": 1e-4, "data_path": "datasets/sft_512.jsonl"},
    "distill": {"batch_size": 4, "learning_rate": 1e-4, "log_step": 1, "max_seq_len": 256},
    "dpo": {"batch_size": 2, "learning_rate": 1e-5, "log_step": 1, "max_seq_len": 256},
}


def stage_config(stage: str, **options: object) -> TrainConfig:
    known = {f.name: f for f in fields(TrainConfig)}
    if unknown := set(options) - set(known):
        raise ValueError(f"unknown options: {sorted(unknown)}")
    if "use_tracker" in options:
        options["use_tracker"] = str2bool(options["use_tracker"])
    return TrainConfig(**(STAGES[stage] | options))


def precision(device: str, dtype: str) -> dict[str, bool]:
    """Whether mixed precision and loss scaling apply: only on CUDA, scaling only for float16."""
    half = device.startswith("cuda") and dtype in ("float16", "bfloat16")
    return {"autocast": half, "scaler": half and dtype == "float16"}
