"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a seed lexicon and of a lexicon learned from the labelled sample
(whole words and word beginnings that toxic texts hold significantly oftener), the densest window,
hits near second-person words, capitals, punctuation, and rates of obfuscated words.

Defined cases: a null or empty text has all densities 0 and gets the score of such a text; without
learnable rows of both classes every score is the share of toxic rows (0 without any); repeated
rows score alike; very long texts are scored whole; other columns are left aside.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame

from criterium.llm.learning import Isotonic, class_weights, keep_scored, labelled_sample, score_texts

# A public-knowledge list of insults, and second-person words, in the corpus languages.
SEED_LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage worthless pathetic clown disgusting imbecile cretin "
    "pig vermin filth bastard bitch asshole jerk freak hate kill die shut "
    "dumm dummkopf trottel arschloch abschaum widerlich idiota imbécil estúpido estúpida basura asqueroso payaso inútil "
    "imbécile crétin connard ordure dégoûtant minable".split()
)
SECOND_PERSON = frozenset("you your yours u ur yourself du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su sus".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
INNER = str.maketrans("", "", "*._-~'`^+#")
STEMS = (4, 5, 6)

SEED, LEARNED, SECOND, OBFUSCATED, HIDDEN = 1, 2, 4, 8, 16
FEATURES = 18
NEAR, WINDOW, KEPT = 5, 50, 400_000


def keys_of(word: str) -> list[str]:
    """What a lexicon may hold of a word: the word itself, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def core(token: str) -> str:
    return token.strip(string.punctuation + "«»“”„…¿¡")


def learn_lexicon(texts: list[str], y: np.ndarray, least: int = 6, g2: float = 30.0, ratio: float = 8.0) -> frozenset[str]:
    """Words and word beginnings bound to toxic texts: likelihood ratio of at least ``g2`` over document counts."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    hot: dict[str, int] = {}
    for t in (t for t, k in zip(texts, y) if k == 1):
        for key in {k for w in set(t.lower().split()) for k in keys_of(core(w))}:
            hot[key] = hot.get(key, 0) + 1
    hot = {k: n for k, n in hot.items() if n >= least and len(k) >= 3}
    cold = dict.fromkeys(hot, 0)
    for t in (t for t, k in zip(texts, y) if k == 0):
        for key in {k for w in set(t.lower().split()) for k in keys_of(core(w)) if k in cold}:
            cold[key] += 1
    found = set()
    for k, a in hot.items():
        b = cold[k]
        p = (a + b) / (pos + neg)
        likely = 2 * (a * np.log(a / (pos * p)) + (b * np.log(b / (neg * p)) if b else 0))
        if likely >= g2 and a / pos >= ratio * (b + 0.5) / (neg + 1):
            found.add(k)
    return frozenset(found)


class Featurizer:
    def __init__(self, learned: frozenset[str]):
        self.learned, self.flags = learned, {}
        table = np.zeros((256, 8))
        for c in range(256):
            ch = chr(c)
            table[c] = [c in range(65, 91), c in range(97, 123), ch.isdigit() and c < 128, ch == "!", ch == "?", ch in "*#@$%&", ch in string.punctuation, c >= 128]
        self.table = table

    def _flags(self, token: str) -> int:
        word = core(token)
        f = SEED * (word in SEED_LEXICON) | LEARNED * any(k in self.learned for k in keys_of(word)) | SECOND * (word in SECOND_PERSON)
        if word and not word.isalpha():
            plain = word.translate(INNER).translate(LEET)
            if plain != word and any(c.isalpha() for c in word):
                f |= OBFUSCATED
                if plain in SEED_LEXICON or any(k in self.learned for k in keys_of(plain)):
                    f |= HIDDEN
        if len(self.flags) > KEPT:
            self.flags.clear()
        self.flags[token] = f
        return f

    def row(self, text: str) -> list[float]:
        tokens = text.lower().split()
        get = self.flags.get
        codes = np.array([f if (f := get(t)) is not None else self._flags(t) for t in tokens], dtype="u1")
        n = max(1, len(tokens))
        hits = np.flatnonzero(codes & (SEED | LEARNED | HIDDEN))
        second = np.flatnonzero(codes & SECOND)
        near = densest = 0
        if len(hits):
            densest = int((np.searchsorted(hits, hits + WINDOW) - np.arange(len(hits))).max())
            if len(second):
                near = int((np.searchsorted(second, hits + NEAR, "right") > np.searchsorted(second, hits - NEAR)).sum())
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
        chars = np.bincount(raw, minlength=256) @ self.table / max(1, len(raw))
        per = [100.0 * int(np.count_nonzero(codes & bit)) / n for bit in (SEED, LEARNED, HIDDEN, OBFUSCATED, SECOND)]
        return [*per, float(len(hits)), 100.0 * len(hits) / n, float(densest), float(near), *chars, float(np.log1p(len(raw)))]

    def matrix(self, texts: list[str]) -> np.ndarray:
        return np.array([self.row(t) for t in texts]).reshape(len(texts), FEATURES)


class BoostedTrees:
    """Logistic gradient boosting with complete trees over quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 5.0, l2: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        b, inner, width = self._binned(x), 2**self.depth - 1, self.bins + 1
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        margin = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p) + 1e-9
            feature, cut, node = np.zeros(inner, int), np.full(inner, width), np.zeros(len(y), int)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    at = np.flatnonzero(node == k)
                    best = 1e-6
                    if len(at) >= 2:
                        total_g, total_h = g[at].sum(), h[at].sum()
                        for j in range(x.shape[1]):
                            gs = np.bincount(b[at, j], g[at], width).cumsum()
                            hs = np.bincount(b[at, j], h[at], width).cumsum()
                            ns = np.bincount(b[at, j], minlength=width).cumsum()
                            gain = gs**2 / (hs + self.l2) + (total_g - gs) ** 2 / (total_h - hs + self.l2) - total_g**2 / (total_h + self.l2)
                            gain[(ns < self.least) | (len(at) - ns < self.least)] = 0
                            if gain.max() > best:
                                best, feature[k], cut[k] = gain.max(), j, int(gain.argmax())
                    node[at] = 2 * k + 1 + (b[at, feature[k]] > cut[k])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            self.trees.append((feature, cut, value))
            margin += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows, inner = self._binned(x), np.arange(len(x)), 2**self.depth - 1
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out


class ToxicityModel:
    """Fitted on a bounded labelled sample; ``per_class`` of :func:`score` is the bound."""

    def __init__(self, sample: list[tuple[str, int, bool]], sizes: dict[int, int]):
        texts, y, hold = [s[0] for s in sample], np.array([s[1] for s in sample]), np.array([s[2] for s in sample], dtype=bool)
        self.constant = None
        if len({*y[~hold]}) < 2 or len({*y[hold]}) < 2:
            self.constant = sizes.get(1, 0) / max(1, sum(sizes.values()))
            return
        self.learned = learn_lexicon([t for t, c in zip(texts, hold) if not c], y[~hold])
        x = Featurizer(self.learned).matrix(texts)
        self.trees = BoostedTrees().fit(x[~hold], y[~hold].astype(float))
        self.calibrated = Isotonic(self.trees.margin(x[hold]), y[hold].astype(float), class_weights(y[hold], sizes))

    def scorer(self):
        if self.constant is not None:
            return lambda texts: np.full(len(texts), self.constant)
        features = Featurizer(self.learned)
        return lambda texts: self.calibrated(self.trees.margin(features.matrix(texts)))


def score(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000, threshold: float = 0.5) -> DataFrame:
    """documents, labels (doc_id, toxic) -> doc_id, held_out, score, predicted."""
    return score_texts(docs, ToxicityModel(*labelled_sample(docs, labels, "toxic", per_class)).scorer, threshold)


def reject(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000, threshold: float = 0.5) -> DataFrame:
    """The documents that are not predicted toxic, all columns."""
    return keep_scored(docs, ToxicityModel(*labelled_sample(docs, labels, "toxic", per_class)).scorer, lambda s: s < threshold)
