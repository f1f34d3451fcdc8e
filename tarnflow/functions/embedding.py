"""Text to vector: normalisation, pre-tokens, word pieces and pooled static weights, as an Arrow-batched function."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

UNK, CLS, SEP = 100, 101, 102
LONGEST_WORD = 100
DIMENSIONS = 512

#: The blocks of CJK ideographs that are tokens of their own.
_CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
_cjk = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _CJK) + "])")


def _is_control(c: str) -> bool:
    return c not in "\t\n\r" and unicodedata.category(c) == "Cc"


def _is_punctuation(c: str) -> bool:
    return (c.isascii() and not c.isalnum() and not c.isspace() and c.isprintable()) or unicodedata.category(c).startswith("P")


def normalize(text: str) -> str:
    """Without control characters and marks, lower case, white space as spaces, ideographs set apart.

    Vertical tabs and form feeds are control characters and vanish; they don't separate words.
    """
    kept = "".join(" " if c.isspace() else c for c in text if c not in "\x00�" and not _is_control(c))
    spread = _cjk.sub(r" \1 ", kept) if not kept.isascii() else kept
    low = spread.lower()
    if low.isascii():
        return low
    return "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.category(c).startswith("M"))


def pretokens(text: str) -> list[str]:
    """Words of a normalised text; every punctuation character is a token of its own."""
    out: list[str] = []
    for word in text.split():
        start = 0
        for i, c in enumerate(word):
            if _is_punctuation(c):
                if start < i:
                    out.append(word[start:i])
                out.append(c)
                start = i + 1
        if start < len(word):
            out.append(word[start:])
    return out


def pieces(word: str, vocabulary: dict[str, int]) -> list[int]:
    """Greedy longest pieces of a word; what no piece fits becomes one unknown after the pieces already found."""
    if len(word) > LONGEST_WORD:
        return [UNK]
    out: list[int] = []
    at = 0
    while at < len(word):
        lead = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in vocabulary), None)
        if end is None:
            return [*out, UNK]
        out.append(vocabulary[lead + word[at:end]])
        at = end
    return out


@dataclass
class EmbeddingModel:
    """A vocabulary and a matrix of token weights, whole or quantised to 8 or 16 bits."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    low: float = 0.0
    scale: float = 1.0

    @property
    def dimensions(self) -> int:
        return self.weights.shape[1]

    def rows(self, ids: Sequence[int]) -> np.ndarray:
        w = self.weights[ids]
        return w.astype(np.float32) if w.dtype.kind == "f" else self.low + w.astype(np.float32) * np.float32(self.scale)

    def ids(self, text: str) -> list[int]:
        return [i for w in pretokens(normalize(text)) for i in pieces(w, self.vocabulary)]

    def encode(self, text: str) -> np.ndarray:
        """The sum of the tokens' weights and those of the two end marks, over the number of tokens (1 if none)."""
        ids = self.ids(text)
        return (self.rows([CLS, *ids, SEP]).sum(0) / max(len(ids), 1)).astype(np.float32)

    def encode_all(self, texts: Sequence[str | None]) -> np.ndarray:
        """The vectors of several texts as the rows of a matrix; null counts as empty."""
        ids = [self.ids(t) if t else [] for t in texts]
        flat = np.fromiter((i for x in ids for i in (CLS, *x, SEP)), np.int64)
        at = np.cumsum([0, *(len(x) + 2 for x in ids)])[:-1]
        if not len(ids):
            return np.zeros((0, self.dimensions), np.float32)
        sums = np.add.reduceat(self.rows(flat), at, axis=0)
        return (sums / np.maximum([len(x) for x in ids], 1)[:, None]).astype(np.float32)

    def quantized(self, bits: int = 8) -> EmbeddingModel:
        lo, hi = float(self.weights.min()), float(self.weights.max())
        levels = 2**bits - 1
        scale = (hi - lo) / levels or 1.0
        q = np.clip(np.rint((self.weights - lo) / scale), 0, levels).astype(np.uint8 if bits == 8 else np.uint16)
        return EmbeddingModel(self.vocabulary, q, lo, scale)

    def truncated(self, dimensions: int) -> EmbeddingModel:
        return EmbeddingModel(self.vocabulary, self.weights[:, :dimensions], self.low, self.scale)


def read_safetensors(data: bytes) -> dict[str, np.ndarray]:
    """Tensors of a safetensors file, as float32 (from F16, BF16, F32 or F64)."""
    (n,) = struct.unpack_from("<Q", data)
    out = {}
    for name, t in json.loads(data[8 : 8 + n]).items():
        if name == "__metadata__":
            continue
        a, b = t["data_offsets"]
        raw = data[8 + n + a : 8 + n + b]
        if t["dtype"] == "BF16":
            v = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
        else:
            v = np.frombuffer(raw, {"F16": "<f2", "F32": "<f4", "F64": "<f8"}[t["dtype"]]).astype(np.float32)
        out[name] = v.reshape(t["shape"])
    return out


def load_model(weights: str, tokenizer: str, dimensions: int = DIMENSIONS) -> EmbeddingModel:
    """A model from a safetensors file (its largest matrix) and a tokenizer file with ``model.vocab``."""
    with open(weights, "rb") as f:
        matrix = max((m for m in read_safetensors(f.read()).values() if m.ndim == 2), key=lambda m: m.size)
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return EmbeddingModel(vocabulary, matrix).truncated(dimensions)


def stand_in(words: Sequence[str], dimensions: int = 64) -> EmbeddingModel:
    """A deterministic model for use without weights: each word and letter has a vector derived from its hash."""
    vocabulary: dict[str, int] = {}
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    for w in [*(f"[unused{i}]" for i in range(UNK)), "[UNK]", "[CLS]", "[SEP]", *letters, *("##" + c for c in letters), *words]:
        vocabulary.setdefault(w, len(vocabulary))
    rows = [np.random.default_rng(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")).normal(0, 1, dimensions) for w in vocabulary]
    return EmbeddingModel(vocabulary, np.array(rows, np.float32))


def embed(spark: SparkSession, model: EmbeddingModel):
    """A Column function text -> array<float>; the model is broadcast once and texts pass in Arrow batches. Null stays null."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else v for t, v in zip(texts, shared.value.encode_all(list(texts)), strict=True)], dtype=object)

    return encode


def normalized(text: Column) -> Column:
    """``normalize`` as a Column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else normalize(t))

    return run(text)
