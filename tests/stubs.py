"""Python-side stand-ins that workers import."""

import numpy as np


class Letters:
    """A tokenizer whose ids are code points."""

    def encode_batch(self, texts, add_special_tokens):
        assert add_special_tokens is False
        return [type("Encoded", (), {"ids": [ord(c) for c in t]}) for t in texts]


class BadWordScorer:
    """Suspicious in proportion to the word `bad`."""

    def predict_probs(self, codes):
        assert 0 < len(codes) <= 16
        p = np.array([min(c.count("bad"), 4) / 4 for c in codes], dtype=np.float32)
        return np.column_stack([1 - p, p])


class LengthScorer:
    """Six classes, the best one by length."""

    def predict_probs(self, codes):
        out = np.full((len(codes), 6), 0.1)
        for row, c in zip(out, codes):
            row[len(c) % 6] = 0.5
        return out


class EchoScorer:
    """Answers with what it was made from."""

    def __init__(self, checkpoint, settings):
        self.row = [len(checkpoint), settings["max_length"], settings["head_ratio"]]

    def predict_probs(self, codes):
        return np.array([self.row] * len(codes), dtype=float)
