"""A judge by a local text-pair classifier: model specifications, the tokenizer, and inference on the executors.

No model file comes with the package: a specification names a folder with model.onnx and tokenizer.json. Both files are read on the driver and
broadcast, so executors need neither the folder nor a network; each Python worker opens one session and keeps it.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..model import JudgeError
from .judge import LOWER, UPPER, Judge, model_judge

#: The environment variable that names the folder of models.
MODELS = "LINKWEAVE_MODELS"
# Subfolders by precision; families by name, folder and the memory they need.
PRECISIONS = {"base": "base", "fp16": "fp16", "fp16_fused": "fp16_fused"}
FAMILIES = {
    "minilm": ("cross-encoder/nli-MiniLM2-L6-H768", "nli-minilm-onnx", 256 << 20),
    "deberta-base": ("cross-encoder/nli-deberta-v3-base", "nli-deberta-v3-base-onnx", 2 << 30),
}


@dataclass(frozen=True)
class ModelSpec:
    name: str
    model_path: str
    tokenizer_path: str
    max_length: int = 512
    entailment: int = 1
    memory: int = 0

    @classmethod
    def of(cls, family: str, folder: str) -> ModelSpec:
        """A known family's model in a folder of its own."""
        name, _, memory = FAMILIES[family]
        return cls(name, os.path.join(folder, "model.onnx"), os.path.join(folder, "tokenizer.json"), memory=memory)


def models_folder(precision: str = "fp16_fused") -> str:
    """Where models of a precision lie, below the folder that the environment names."""
    return os.path.join(os.environ.get(MODELS, "models"), "nli-base", PRECISIONS[precision])


def choose(folder: str, memory: int) -> ModelSpec:
    """The larger family where its folder is there and the memory (bytes) suffices, else the smaller one."""
    _, large, needed = FAMILIES["deberta-base"]
    if memory >= needed and os.path.isdir(os.path.join(folder, large)):
        return ModelSpec.of("deberta-base", os.path.join(folder, large))
    return ModelSpec.of("minilm", os.path.join(folder, FAMILIES["minilm"][1]))


def tokenizer(content: bytes, max_length: int) -> Callable[[list[str]], dict[str, np.ndarray]]:
    """A function from texts to a model's inputs, as wide as the longest text of the batch and at most max_length; zeros beyond each text."""
    try:
        import tokenizers
    except ImportError as e:
        raise JudgeError("tokenizers is not installed") from e
    inner = tokenizers.Tokenizer.from_buffer(content)
    inner.no_padding()

    def encode(texts: list[str]) -> dict[str, np.ndarray]:
        found = inner.encode_batch(texts, add_special_tokens=True)
        width = min(max((len(e.ids) for e in found), default=1), max_length)
        out = {name: np.zeros((len(texts), width), np.int64) for name in ("input_ids", "attention_mask", "token_type_ids")}
        for i, e in enumerate(found):
            n = min(len(e.ids), width)
            for name, values in (("input_ids", e.ids), ("attention_mask", e.attention_mask), ("token_type_ids", e.type_ids)):
                out[name][i, :n] = values[:n]
        return out

    return encode


def scorer(model: bytes, encode: Callable[[list[str]], dict[str, np.ndarray]], entailment: int) -> Callable[[list[str]], list[float]]:
    """A function from texts to the probabilities of the entailment label. A model may do without token types."""
    try:
        import onnxruntime
    except ImportError as e:
        raise JudgeError("onnxruntime is not installed") from e
    session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
    wanted = {x.name for x in session.get_inputs()}

    def score(texts: list[str]) -> list[float]:
        logits = session.run(["logits"], {k: v for k, v in encode(texts).items() if k in wanted})[0].astype(np.float64)
        e = np.exp(logits - logits.max(1, keepdims=True))
        return (e / e.sum(1, keepdims=True))[:, entailment].tolist()

    return score


def nli_judge(spec: ModelSpec, upper: float = UPPER, lower: float = LOWER, batch: int = 64) -> Judge:
    """A judge for pipelines: pairs go to the model in batches, in Arrow batches on the executors."""

    def read(path: str) -> bytes:
        try:
            with open(path, "rb") as f:
                return f.read()
        except OSError as e:
            raise JudgeError(f"{spec.name}: {e}") from e

    def judge(pairs: DataFrame) -> DataFrame:
        files = pairs.sparkSession.sparkContext.broadcast((read(spec.model_path), read(spec.tokenizer_path)))
        held: dict = {}

        def score(texts: list[str]) -> list[float]:
            if "score" not in held:
                model, content = files.value
                held["score"] = scorer(model, tokenizer(content, spec.max_length), spec.entailment)
            return held["score"](texts)

        return model_judge(score, upper, lower, batch)(pairs)

    return judge
