"""Personal data: spans of fixed patterns, and those that a semi-Markov conditional random field adds.

The field's segments are candidate spans of at most ``LONGEST`` characters or ``GROUPS`` digit groups, and single
characters outside of any. A segment is scored as a whole, per kind, by its digit groups, separators, check
digits, marks ("[at]", "dot"), neighbours and cue words before it; a weight per pair of kinds scores segments
that touch. Dynamic programming over the ends of the candidates chooses boundaries and kinds together. The
weights are fitted by the likelihood of windows of the corpus (at most ``per_kind`` a kind, ``WINDOW`` characters
each, chosen by hash) in which the patterns mark the spans, of copies of them with the spans disguised, which
stay marked, or broken, which do not, and of made values between the corpus's words. Spans of the field that
overlap none of a pattern's are added.

One pass over the texts cuts the windows, one more finds the spans; nothing but the windows is shuffled.

Defined cases: a null text is an empty one and has no spans; a corpus without digits and at-marks is searched
with a field fitted to made values; repeated rows give equal rows; very long texts are searched whole; an empty
table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from criterium.llm.common import lean

KINDS = ("email", "ip", "card", "phone")

#: Bounds of a candidate: characters on either side of an at-mark, digit groups; characters of a training window.
LONGEST, GROUPS, WINDOW = 80, 8, 240

# The patterns of the four kinds. Digits and local parts are matched from the start of their
# run, as a match from within it would fail too; addresses are searched from their at-sign.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def small_parts(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # addresses do not overlap
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    spans = [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if small_parts(m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return sorted(spans)


# Marks in place of signs.
_AT = re.compile(r"@|\s?[\[({<]\s?(?:@|at)\s?[\])}>]\s?|\sat\s", re.I)
_DOT = r"(?:\.|\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\sdot\s)"
_NAME = re.compile(rf"[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*$", re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_PIECE = re.compile(_DOT, re.I)
_BETWEEN = re.compile(r"(?:[  ./()–-]{1,3}|\[\.\]|\(\.\)|\s?[\[(]?dot[\])]?\s?)(?=[0-9])", re.I)
_CUES = (r"e-?mails?|mail|contact|write", r"ip|host|server|addr|address", r"card|visa|credit|account|pay", r"tel|phone|call|mobile|fax|cell")  # one a kind
_CUE = re.compile("|".join(rf"(\b(?:{c})\b)" for c in _CUES), re.I)
FEATURES = 48


def _number(text: str, groups: list[tuple[int, int]], start: int, end: int) -> list[float]:
    """What is common to all candidates that are made of digit groups."""
    parts = [text[a:b] for a, b in groups]
    digits, n = "".join(parts), len(parts)
    gaps = [text[a:b] for (_, a), (b, _) in zip(groups, groups[1:])]
    size = len(digits)
    plain = [g for g in gaps if g == "."]
    return [
        size < 8, 8 <= size < 10, 10 <= size < 12, 12 <= size < 13, 13 <= size < 16, size == 16, size > 16,
        n == 1, n == 2, n == 3, n == 4, n > 4, n == 4 and small_parts(parts), n == 4 and not small_parts(parts), all(len(p) == 4 for p in parts), size >= 12 and luhn(digits), size >= 12 and not luhn(digits),
        text[start] == "+", digits[:2] == "00", text[start] == "(" or any("(" in g for g in gaps), bool(gaps) and len({*gaps}) == 1, len({*gaps}) > 1,
        bool(gaps) and len(plain) == len(gaps), any(g == " " for g in gaps), any("-" in g for g in gaps), any(re.search(r"dot|\[|\(\.", g, re.I) is not None for g in gaps), any("/" in g for g in gaps),
        len(parts[-1]) == 4, len(parts[0]) <= 2, max(map(len, parts)) >= 8,
    ]


def candidates(text: str) -> tuple[list[tuple[int, int, tuple[int, ...]]], np.ndarray]:
    """(start, end, kinds it may be) of every candidate span, and a row of features each."""
    spans, rows = [], []

    def add(start: int, end: int, kinds: tuple[int, ...], number: list[float], email: list[float]) -> None:
        left, right = text[start - 1 : start], text[end : end + 1]
        cues = {m.lastindex for m in _CUE.finditer(text, max(0, start - 24), start)}
        around = [left.isalnum(), right.isalnum(), left in ("-", ".", "/", "_", "=", '"') and left != "", right in ("-", "/", "_", '"') and right != "", text[end : end + 2][1:].isdigit() and right in (" ", ".", "-", "/"), text[max(0, start - 2) : start - 1].isdigit() and left in (" ", ".", "-", "/")]
        spans.append((start, end, kinds))
        rows.append([1.0, *number, *email, *around, *(k in cues for k in (1, 2, 3, 4))])

    groups = [m.span() for m in _DIGITS.finditer(text)]
    for i, (start, _) in enumerate(groups):
        starts = [start]
        if start and text[start - 1] == "(":
            starts.append(start - 1)
        if starts[-1] and text[starts[-1] - 1] == "+":
            starts.append(starts[-1] - 1)
        size = 0
        for j in range(i, min(len(groups), i + GROUPS)):
            a, b = groups[j]
            gap = _BETWEEN.match(text, groups[j - 1][1]) if j > i else None
            if j > i and (not gap or gap.end() != a):
                break
            size += b - a
            if size > 19:
                break
            gaps = [text[x:y] for (_, x), (y, _) in zip(groups[i : j + 1], groups[i + 1 : j + 1])]
            words = any(re.search("dot", g, re.I) for g in gaps)
            kinds = ((1,) if j - i == 3 and all("." in g or words for g in gaps) else ()) + ((2,) if size >= 12 and not words else ()) + ((3,) if 7 <= size <= 15 and not words else ())
            if kinds:
                for s in starts:
                    add(s, b, kinds if s == start else tuple(k for k in kinds if k == 3), _number(text, groups[i : j + 1], s, b), [0.0] * 7)
    for m in _AT.finditer(text):
        name = _NAME.search(text[max(0, m.start() - LONGEST) : m.start()])
        host = _HOST.match(text[m.end() : m.end() + LONGEST])
        if not name or not host:
            continue
        base = max(0, m.start() - LONGEST)
        begins = [base + name.start(), *(base + name.start() + p.end() for p in _PIECE.finditer(name[0]))][-3:]
        dots = [p for p in _PIECE.finditer(host[0])]
        ends = [p.start() for p in dots[1:]] + [len(host[0])]
        marked = len(m[0]) > 1
        for e, end in enumerate(ends[:4]):
            hidden = sum(len(p[0]) > 1 for p in dots[: e + 1])
            if m[0].strip().lower() == "at" and not hidden:
                continue
            last = host[0][dots[e].end() : end]
            for begin in begins:
                inside = text[begin : m.start()]
                email = [not marked, marked, hidden > 0, hidden > 0 and hidden < e + 1, last.isalpha() and 2 <= len(last) <= 6, end == len(host[0]), begin == begins[0] or len(_PIECE.findall(inside)) == 0]
                add(begin, m.end() + end, (0,), [0.0] * 30, email)
    return spans, np.array(rows, float).reshape(-1, FEATURES)


def _lse(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


class Field:
    """Weights of the segments, kinds x features, and of touching pairs of kinds."""

    def __init__(self, weights: np.ndarray, touching: np.ndarray):
        self.weights, self.touching = weights, touching

    def _lattice(self, spans, scores):
        """Positions where candidates begin or end, and the (from, kind, score, candidate) of those that end at each."""
        places = sorted({p for a, b, _ in spans for p in (a, b)})
        at = {p: k for k, p in enumerate(places)}
        ends = [[] for _ in places]
        for c, (a, b, kinds) in enumerate(spans):
            for k in kinds:
                ends[at[b]].append((at[a], k, scores[c, k], c))
        return ends

    def decode(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation."""
        spans, x = candidates(text)
        if not spans:
            return []
        ends = self._lattice(spans, x @ self.weights.T)
        best: list[list[tuple[float, tuple | None]]] = []  # per place: outside, then per kind of the segment that ends here
        for p, own in enumerate(ends):
            row = [(0.0, None)] + [(-math.inf, None)] * len(KINDS)
            if p:
                y = max(range(len(KINDS) + 1), key=lambda y: best[p - 1][y][0])
                row[0] = (best[p - 1][y][0], (p - 1, y, None))
            for q, k, s, c in own:
                came = [best[q][y][0] + (self.touching[y - 1, k] if y else 0.0) for y in range(len(KINDS) + 1)]
                y = max(range(len(came)), key=came.__getitem__)
                if came[y] + s > row[k + 1][0]:
                    row[k + 1] = (came[y] + s, (q, y, c))
            best.append(row)
        p, y, found = len(best) - 1, max(range(len(KINDS) + 1), key=lambda y: best[-1][y][0]), []
        while best[p][y][1] is not None:
            q, z, c = best[p][y][1]
            if c is not None:
                found.append((spans[c][0], y - 1, spans[c][1]))
            p, y = q, z
        return sorted(found)

    def gradient(self, spans, x, gold: set[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log-likelihood of the gold segmentation, by forward and backward sums."""
        ends = self._lattice(spans, x @ self.weights.T)
        n, kinds = len(ends), len(KINDS)
        ahead = np.full((n, kinds + 1), -np.inf)
        back = np.full((n, kinds + 1), -np.inf)
        for p in range(n):
            ahead[p, 0] = _lse(ahead[p - 1].tolist()) if p else 0.0
            for k in range(kinds):
                into = [_lse([ahead[q, 0], *(ahead[q, 1:] + self.touching[:, k]).tolist()]) + s for q, kk, s, _ in ends[p] if kk == k]
                if into:
                    ahead[p, k + 1] = _lse(into)
        total = _lse(ahead[-1].tolist())
        begins = [[] for _ in range(n)]
        for p in range(n):
            for q, k, s, c in ends[p]:
                begins[q].append((p, k, s, c))
        for p in reversed(range(n)):
            out = [back[p + 1, 0]] if p + 1 < n else [0.0]
            after = [(k, s + back[q, k + 1]) for q, k, s, _ in begins[p]]
            back[p, 0] = _lse(out + [v for _, v in after])
            for y in range(kinds):
                back[p, y + 1] = _lse(out + [v + self.touching[y, k] for k, v in after])
        by_weight, by_pair, likelihood = np.zeros_like(self.weights), np.zeros_like(self.touching), -total
        for p in range(n):
            for q, k, s, c in ends[p]:
                came = np.append(ahead[q, 0], ahead[q, 1:] + self.touching[:, k])
                share = np.exp(came + s + back[p, k + 1] - total)
                real = (spans[c][0], k, spans[c][1]) in gold
                by_weight[k] += x[c] * (real - share.sum())
                by_pair[:, k] -= share[1:]
                likelihood += s * real
        order = sorted(gold)
        for (_, y, b), (a, k, _) in zip(order, order[1:]):
            if a == b:
                by_pair[y, k] += 1
                likelihood += self.touching[y, k]
        return by_weight, by_pair, likelihood

    @classmethod
    def fitted(cls, windows: list[tuple[str, list[tuple[int, int, int]]]], *, rounds: int = 40, ridge: float = 0.02) -> Field:
        """By Adam steps over all windows (text, gold spans); windows whose gold is no candidate are left out."""
        cases = []
        for text, gold in windows:
            spans, x = candidates(text)
            known = {(a, k, b) for a, b, ks in spans for k in ks}
            if spans and known.issuperset(gold):
                cases.append((spans, x, set(gold)))
        field = cls(np.zeros((len(KINDS), FEATURES)), np.full((len(KINDS), len(KINDS)), -1.0))
        field.weights[:, 0] = -2.0
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (field.weights, field.touching)]
        for t in range(1, rounds + 1):
            sums = [np.zeros_like(field.weights), np.zeros_like(field.touching)]
            for case in cases:
                for s, g in zip(sums, field.gradient(*case)[:2]):
                    s += g
            for w, g, m in zip((field.weights, field.touching), sums, moments):
                g = g / max(1, len(cases)) - ridge / max(1, len(cases)) * w
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
                w += 0.25 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-6)
        return field


# Training windows.


def _disguised(kind: int, span: str, draw: random.Random) -> str:
    """The same value in a form that no pattern has."""
    if kind == 0:
        at, dot = draw.choice([(" at ", " dot "), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("@", "[.]"), (" at ", "[dot]")])
        name, host = span.split("@")
        return name + at + host.replace(".", dot)
    digits = re.findall("[0-9]+", span)
    whole = "".join(digits)
    if kind == 1:
        return draw.choice(["[.]", "(.)", " dot ", " . ", "[dot]"]).join(digits)
    if kind == 2:
        return draw.choice([".", "/", " ", " - "]).join(whole[k : k + 4] for k in range(0, len(whole), 4))
    local = whole[-10:]
    a, b, c = local[:-7], local[-7:-4], local[-4:]
    return draw.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{len(a) % 10 + 1} {a} {b} {c}", f"1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"1 ({a}) {b} {c}"]) if a else f"{b}-{c}"


def _broken(kind: int, span: str, draw: random.Random) -> str:
    """A value like it that names nobody."""
    digits = re.findall("[0-9]+", span)
    if kind == 0:
        return draw.choice([span.replace("@", " @ "), span.replace("@", ""), span.split("@")[0] + " at the " + span.split("@")[1].split(".")[0]])
    if kind == 1:
        return draw.choice([".".join([str(int(digits[0]) % 90 + 300), *digits[1:]]), ".".join(digits[:3]), "/".join(digits), " ".join(digits)])
    if kind == 2:
        whole = "".join(digits)
        other = whole[:-1] + str((int(whole[-1]) + 1 + draw.randrange(9)) % 10)
        return draw.choice([other, other, whole[:9], " ".join(other[k : k + 4] for k in range(0, len(other), 4))])
    whole = "".join(digits)
    return draw.choice([whole[:6], whole, f"{whole[:4]}-{whole[4:6]}-{whole[6:8]}", f"{whole[:2]}/{whole[2:4]}/{whole[4:8]}", f"{whole[:3]}.{whole[3:5]}", " ".join(whole[k : k + 2] for k in range(0, 8, 2))])


def _made(kind: int, draw: random.Random) -> str:
    """A value that a pattern has."""
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice("aeioubdlmnrst") for _ in range(draw.randint(2, 8)))
    if kind == 0:
        return word() + draw.choice(["", "." + word(), digits(2), "_" + word()]) + "@" + ".".join([word() for _ in range(draw.randint(1, 2))]) + draw.choice([".com", ".org", ".net", ".de"])
    if kind == 1:
        return ".".join(str(draw.randrange(256)) for _ in range(4))
    if kind == 2:
        body = draw.choice("3456") + digits(14)
        whole = next(body + d for d in "0123456789" if luhn(body + d))
        return draw.choice([whole, " ".join(whole[k : k + 4] for k in range(0, 16, 4)), "-".join(whole[k : k + 4] for k in range(0, 16, 4))])
    a, b, c = digits(3), digits(3), digits(4)
    return f"+{draw.randint(1, 99)} " + draw.choice([f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}-{b}-{c}"])


def _altered(text: str, spans: list[tuple[int, int, int]], change, marked: bool, draw: random.Random) -> tuple[str, list]:
    out, at, gold = "", 0, []
    for a, k, b in spans:
        out += text[at:a]
        new = change(k, text[a:b], draw)
        if marked:
            gold.append((len(out), k, len(out) + len(new)))
        out, at = out + new, b
    out += text[at:]
    return out, gold if marked else _apart(pattern_spans(out))


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that do not overlap; the earlier and longer of two."""
    kept: list[tuple[int, int, int]] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[2])):
        if not kept or s[0] >= kept[-1][2]:
            kept.append(s)
    return kept


def training_set(windows: list[str], made: int = 40, seed: int = 7) -> list[tuple[str, list]]:
    """Windows with their marked spans: as they are, disguised, broken, and with made values."""
    draw, out = random.Random(seed), []
    words = sorted({w for t in windows for w in re.findall(r"[^\W\d_]{2,12}", t)}) or ["and", "of", "the", "to", "a"]
    for text in sorted(windows):
        spans = _apart(pattern_spans(text))
        out.append((text, spans))
        if spans:
            out += [_altered(text, spans, _disguised, True, draw), _altered(text, spans, _broken, False, draw)]
    some = lambda: " ".join(draw.choice(words) for _ in range(4))
    for kind in range(len(KINDS)):
        for _ in range(made):
            text = some() + " "
            value = _made(kind, draw)
            spans = [(len(text), kind, len(text) + len(value))]
            text += value + draw.choice([" ", ". ", ", ", "\n"]) + some()
            out += [(text, spans), _altered(text, spans, _disguised, True, draw), _altered(text, spans, _broken, False, draw)]
    return out


_SEED = re.compile(r"[0-9@]|[\[({]\s?(?:at|dot)\s?[\])}]|\bdot\b", re.I)


def regions(text: str, around: int = 100) -> Iterator[tuple[int, str]]:
    """Stretches of a text that can hold candidates, far enough from each other to be told apart."""
    first = last = None
    for m in _SEED.finditer(text):
        if last is not None and m.start() > last + 2 * around:
            yield max(0, first - around), text[max(0, first - around) : last + around]
            first = None
        first, last = m.start() if first is None else first, m.end()
    if last is not None:
        yield max(0, first - around), text[max(0, first - around) : last + around]


def _windows(per_kind: int):
    """mapInArrow: texts -> the task's first windows of each kind by hash (a kind's number, or that of none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[str, int]] = [{} for _ in range(len(KINDS) + 1)]
        heaps: list[list[tuple[int, str]]] = [[] for _ in kept]
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                for _, part in regions(text):
                    middle = max(0, len(part) // 2 - WINDOW // 2)
                    cuts = [(k, part[max(0, (a + b) // 2 - WINDOW // 2) :][:WINDOW]) for a, k, b in pattern_spans(part)] or [(len(KINDS), part[middle : middle + WINDOW])]
                    for k, cut in cuts:
                        h = -zlib.crc32(cut.encode("utf-8", "surrogatepass"))
                        if cut in kept[k] or len(heaps[k]) >= per_kind and h <= heaps[k][0][0]:
                            continue
                        kept[k][cut] = h
                        heapq.heappush(heaps[k], (h, cut))
                        if len(heaps[k]) > per_kind:
                            del kept[k][heapq.heappop(heaps[k])[1]]
        rows = [(k, -h, cut) for k, each in enumerate(kept) for cut, h in each.items()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["kind", "h", "cut"])

    return lean(run)


def fit(docs: DataFrame, *, per_kind: int = 80) -> Field:
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    found = texts.mapInArrow(_windows(per_kind), "kind int, h long, cut string").distinct()
    first = F.row_number().over(Window.partitionBy("kind").orderBy("h", "cut"))
    rows = found.withColumn("place", first).where(F.col("place") <= per_kind).select("cut").distinct().collect()  # at most per_kind windows a kind
    return Field.fitted(training_set([r["cut"] for r in rows]))


def spans_of(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The patterns' spans, and all spans."""
    base = pattern_spans(text)
    every, covered = list(base), []
    for a, _, b in base:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    at = 0
    for shift, part in regions(text):
        for a, k, b in field.decode(part):
            a, b = a + shift, b + shift
            while at < len(covered) and covered[at][1] <= a:
                at += 1
            if at == len(covered) or covered[at][0] >= b:
                every.append((a, k, b))
    return base, sorted(every)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def find(docs: DataFrame, *, per_kind: int = 80) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    field = fit(docs, per_kind=per_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, every = spans_of(text.as_py(), field)
                rows.append((doc_id, *(sum(s[1] == k for s in base) for k in range(len(KINDS))), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            yield pa.record_batch([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(_FOUND)], schema=_FOUND)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
