"""Quality: a compression classifier.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text is compressed
with either, in windows of ``WINDOW`` bytes so that the dictionaries count all along a long text,
and the difference of the compressed sizes over their sum becomes a score by isotonic regression on
labelled rows that built no dictionary.

Defined cases: a null or empty text has difference 0; without learnable rows of both classes every
score is the share of good rows (1 without any); repeated rows score alike; very long texts are
scored whole, window by window; other columns are left aside.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from criterium.llm.learning import Isotonic, class_weights, keep_scored, labelled_sample, score_texts

WINDOW, LEVEL, DICTIONARY = 4096, 3, 112_640


def windows(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[k : k + WINDOW] for k in range(0, len(data), WINDOW)]


def build_dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    """Dictionary bytes; too few samples for training serve as they are, as a raw-content dictionary."""
    samples = [w for t in texts for w in windows(t)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:].ljust(8, b" ")


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for d in (good, bad):
            kept = zstandard.ZstdCompressionDict(d)
            kept.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(dict_data=kept, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: str) -> float:
        """(bad size - good size) / (bad size + good size): above 0 where the good dictionary fits better."""
        parts = windows(text)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.pair)
        return (bad - good) / max(1, bad + good)


class QualityModel:
    """Fitted on a bounded labelled sample; ``per_class`` of :func:`score` is the bound."""

    def __init__(self, sample: list[tuple[str, int, bool]], sizes: dict[int, int]):
        y, hold = np.array([s[1] for s in sample]), np.array([s[2] for s in sample], dtype=bool)
        self.constant = None
        if len({*y[~hold]}) < 2 or len({*y[hold]}) < 2:
            self.constant = sizes.get(1, 0) / sum(sizes.values()) if sizes else 1.0
            return
        self.good, self.bad = (build_dictionary([t for t, c, h in sample if c == k and not h]) for k in (1, 0))
        tool = Compressors(self.good, self.bad)
        x = np.array([tool.difference(t) for t, _, h in sample if h])
        self.calibrated = Isotonic(x, y[hold].astype(float), class_weights(y[hold], sizes))

    def scorer(self):
        if self.constant is not None:
            return lambda texts: np.full(len(texts), self.constant)
        tool = Compressors(self.good, self.bad)
        return lambda texts: self.calibrated(np.array([tool.difference(t) for t in texts]))


def score(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, threshold: float = 0.3) -> DataFrame:
    """documents, labels (doc_id, quality) -> doc_id, held_out, score, predicted."""
    return score_texts(docs, QualityModel(*labelled_sample(docs, labels, "quality", per_class)).scorer, threshold)


def reject(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, threshold: float = 0.3) -> DataFrame:
    """The documents that are predicted good, all columns."""
    return keep_scored(docs, QualityModel(*labelled_sample(docs, labels, "quality", per_class)).scorer, lambda s: s >= threshold)
