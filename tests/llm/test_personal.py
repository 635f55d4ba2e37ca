"""Personal data: patterns against Python's own search, the field against all segmentations written out."""

import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pytest

from criterium.llm import personal as p

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return [True, all(int(x) <= 255 for x in m.split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and p.luhn(digits), 9 <= len(digits) <= 15][kind]

    return sorted((m.start(), k, m.end()) for k, e in enumerate(PLAIN) for m in re.finditer(e, text) if good(k, m[0]))


@pytest.fixture(scope="module")
def field():
    return p.Field.fitted(p.training_set(["the house and the river are old", "on monday we met some people there"]))


def test_patterns_equal_plain_search_on_noise():
    draw = random.Random(3)
    parts = ["a", "b.c", "@", "x%y", ".", "-", " ", "+", "1", "22", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+1 (017) 555-7713", "1.2.3.4", "a@b.cd", "é", "(", ")", "\n", "00", "d@e"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(14)))
        assert p.pattern_spans(text) == plain(text), text


def test_patterns_equal_plain_search_on_documents(spark, data):
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        assert p.pattern_spans(r["text"]) == plain(r["text"])


def segmentations(spans, touching, scores):
    """Every set of candidates that do not overlap, with its score."""
    each = [(a, k, b, scores[c, k]) for c, (a, b, ks) in enumerate(spans) for k in ks]
    for size in range(len(each) + 1):
        for chosen in itertools.combinations(each, size):
            chosen = sorted(chosen)
            if all(x[2] <= y[0] for x, y in zip(chosen, chosen[1:])):
                yield sum(s for *_, s in chosen) + sum(touching[x[1], y[1]] for x, y in zip(chosen, chosen[1:]) if x[2] == y[0]), {c[:3] for c in chosen}


TEXTS = ["tel 017-555-7713.", "a at b dot cd now", "ip 1[.]2[.]3[.]4", "j@k.lm 10.0.0.1", "4111111111111111", "12345671234567", "+49 1234567"]


def drawn(seed):
    r = np.random.default_rng(seed)
    return p.Field(r.normal(size=(4, p.FEATURES)), r.normal(size=(4, 4)))


@pytest.mark.parametrize("text", TEXTS)
def test_decoding_finds_the_best_of_all_segmentations(text):
    spans, x = p.candidates(text)
    assert 0 < sum(len(s[2]) for s in spans) < 16
    for seed in range(5):
        f = drawn(seed)
        best, chosen = max(segmentations(spans, f.touching, x @ f.weights.T), key=lambda s: s[0])
        assert set(f.decode(text)) == chosen


@pytest.mark.parametrize("text", TEXTS)
def test_likelihood_sums_over_all_segmentations(text):
    spans, x = p.candidates(text)
    f = drawn(9)
    every = list(segmentations(spans, f.touching, x @ f.weights.T))
    gold_score, gold = max(every, key=lambda s: s[0])
    by_weight, by_pair, likelihood = f.gradient(spans, x, gold)
    total = math.log(sum(math.exp(s) for s, _ in every))
    assert likelihood == pytest.approx(gold_score - total)
    for k, j in [(0, 0), (1, 3), (3, 17), (3, 0), (2, 6)]:
        step = np.zeros_like(f.weights)
        step[k, j] = 1e-5
        up, down = (p.Field(f.weights + s * step, f.touching).gradient(spans, x, gold)[2] for s in (1, -1))
        assert by_weight[k, j] == pytest.approx((up - down) / 2e-5, abs=1e-5)
    step = np.zeros_like(f.touching)
    step[1, 2] = 1e-5
    up, down = (p.Field(f.weights, f.touching + s * step).gradient(spans, x, gold)[2] for s in (1, -1))
    assert by_pair[1, 2] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_held_out_disguises_are_found_and_broken_values_left(field):
    draw, hits, n, wrong = random.Random(99), 0, 0, 0
    for _ in range(150):
        kind = draw.randrange(4)
        value = p._made(kind, draw)
        hidden = p._disguised(kind, value, draw)
        text = f"we saw it there {hidden}, and went"
        n += 1
        hits += (16, kind, 16 + len(hidden)) in p.spans_of(text, field)[1]
        broken = f"we saw it there {p._broken(kind, value, draw)} and went"
        wrong += len(p.spans_of(broken, field)[1]) > len(plain(broken))
    assert hits >= 0.95 * n and wrong <= 0.05 * n


def test_pattern_spans_stay_and_added_ones_do_not_overlap(field):
    draw = random.Random(4)
    for _ in range(300):
        text = " ".join(draw.choice([p._made(k, draw), p._disguised(k, p._made(k, draw), draw), "and", "12", "v1.2.3"]) for k in [draw.randrange(4) for _ in range(5)])
        base, every = p.spans_of(text, field)
        assert base == plain(text) and set(base) <= set(every)
        for s in set(every) - set(base):
            assert all(s[2] <= b[0] or b[2] <= s[0] for b in every if b != s)


@pytest.mark.parametrize("text", ["1" * 300_000, "a." * 150_000, "+" * 300_000, "a@" * 100_000, "1 " * 60_000, "1." * 60_000, " at " * 60_000, "(" * 200_000, "+1" + " " * 300_000], ids=str.__len__)
def test_long_texts_take_linear_time(field, text):
    began = time.perf_counter()
    p.spans_of(text, field)
    assert time.perf_counter() - began < 25


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")) for r in df.collect()), key=repr)


def test_query_on_documents(spark, data):
    from criterium.llm.queries import op13_personal

    got = {r[0]: r for r in found(op13_personal(spark, data))}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = plain(d["text"])
        assert got[d["doc_id"]][1:5] == tuple(sum(s[1] == k for s in want) for k in range(4))
        assert got[d["doc_id"]][5] == hashlib.sha256(p.listed(want).encode()).hexdigest()
        assert set(filter(None, p.listed(want).split(","))) <= set(got[d["doc_id"]][6].split(","))
        if not re.search("[0-9@]", d["text"]):
            assert got[d["doc_id"]][6] == ""


def test_odd_rows(spark, odd, empty):
    got = found(p.find(odd))
    assert len(got) == odd.count() and all(r[6] == "" for r in got)
    assert found(p.find(empty)) == []
    one = found(p.find(spark.createDataFrame([(1, "mail é john [at] mail.example.com or a@b.cd", 5)], "doc_id long, text string, n_email int")))
    assert one == [(1, 1, 0, 0, 0, hashlib.sha256(b"email:37:43").hexdigest(), "email:7:33,email:37:43")]
