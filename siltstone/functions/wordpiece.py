"""Sub-word tokens and pooled embeddings for encoder models."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


class WordPiece:
    """Greedy longest-match sub-words of a vocabulary; text is cut at white space and marks, in lower case without accents."""

    def __init__(self, vocabulary: list[str], most_tokens: int = 256, lower: bool = True):
        self.ids = {t: i for i, t in enumerate(vocabulary)}
        self.most, self.lower = most_tokens, lower
        self.unknown, self.first, self.last = (self.ids[t] for t in ("[UNK]", "[CLS]", "[SEP]"))

    def words(self, text: str) -> list[str]:
        if self.lower:
            text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
        out, word = [], ""
        for c in text:
            alone = unicodedata.category(c)[0] in "PS" or 0x4E00 <= ord(c) <= 0x9FFF
            if c.isspace() or alone:
                if word:
                    out.append(word)
                word = ""
                if alone:
                    out.append(c)
            elif unicodedata.category(c)[0] != "C":
                word += c
        return [*out, word] if word else out

    def pieces(self, word: str) -> list[int]:
        out, at = [], 0
        while at < len(word):
            end = len(word)
            while end > at and (("##" if at else "") + word[at:end]) not in self.ids:
                end -= 1
            if end == at:
                return [self.unknown]
            out.append(self.ids[("##" if at else "") + word[at:end]])
            at = end
        return out

    def encode(self, text: str | None) -> list[int]:
        own = [i for w in self.words(text or "") for i in self.pieces(w)][: self.most - 2]
        return [self.first, *own, self.last]


def pool(states: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """Normalised vectors of token states ``batch x tokens x size``: the mean over the mask, or the first token."""
    if how == "cls":
        v = states[:, 0]
    else:
        m = mask[:, :, None].astype(states.dtype)
        v = (states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def onnx_embedder(model: str, vocabulary: list[str], prefix: str = "", how: str = "mean", batch: int = 32):
    """A pandas UDF that embeds texts with an ONNX encoder; the model is loaded once a worker."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime

        run, wp = onnxruntime.InferenceSession(model), WordPiece(vocabulary)
        named = {i.name for i in run.get_inputs()}
        for s in parts:
            out: list[list[float]] = []
            for at in range(0, len(s), batch):
                ids = [wp.encode(prefix + (t or "")) for t in s.iloc[at : at + batch]]
                width = max(map(len, ids))
                x = np.array([i + [0] * (width - len(i)) for i in ids], dtype=np.int64)
                mask = np.array([[1] * len(i) + [0] * (width - len(i)) for i in ids], dtype=np.int64)
                feed = {"input_ids": x, "attention_mask": mask, "token_type_ids": np.zeros_like(x)}
                out += pool(run.run(None, {k: v for k, v in feed.items() if k in named})[0], mask, how).tolist()
            yield pd.Series(out)

    return embed
