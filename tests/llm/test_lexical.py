"""Lexical ranks against a plain count of every document, with Python's integers."""

import math
import random
import re

import pytest

from criterium.llm import lexical
from criterium.llm.queries import ORACLE_SQL, op12_lexical
from tests.test_queries import matches


def plain(docs, items, k=10):
    tokens = lambda t: re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, tokens(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, every = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        want, scored = tokens(text), []
        for d, t in held:
            m = 25 + 75 * len(t) * n_docs // every
            score = 0
            for w in want:
                tf, df = t.count(w), sum(w in x for _, x in held)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


def test_query_equals_sql(spark, data):
    matches(spark, data, op12_lexical, ORACLE_SQL["op12_lexical"])


@pytest.mark.parametrize("parts,occurrences", [(1, 1_000_000), (7, 25)])
def test_blocks_and_partitions_change_nothing(spark, parts, occurrences):
    draw = random.Random(parts)
    text = lambda n: " ".join(draw.choice(["a", "B", "cc", "Dd", "é", "x1", "zz", "q", "rare" + str(draw.randrange(9))]) for _ in range(n))
    docs = [(i // 2 if i % 9 else None, text(draw.randrange(12))) for i in range(150)]
    items = [(i % 14, text(draw.randrange(7))) for i in range(16)]
    df, want = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
        got = found(lexical.search(df.repartition(parts), want, occurrences=occurrences))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain(docs, items)


def test_odd_rows(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "THE quick, word ½ 日本語?"), (2, None), (3, ""), (4, "@ [~] unseen"), (None, "dog dog Dog"), (1, "id")]
    want = spark.createDataFrame([(*i, "clash", 1) for i in items], "item_id long, text string, score string, rank int")
    assert found(lexical.search(odd, want)) == plain(docs, items)
    assert lexical.search(empty, want).count() == lexical.search(odd, want.limit(0)).count() == 0


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x180))) + " İstanbul ǅ naïve x \U0001f600y Ω"
    want = re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert [t.decode() for t in lexical.terms_of(text)] == want
