"""Every stage of the pipeline against a plain version of what it promises."""

import random
from collections import Counter

import pytest

from tests.llm.conftest import DOCS
from tests.llm.test_llm import brute_best_fit, check_packed
from tests.llm.test_near_duplicates import brute_classes, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Plain, toxic and poor texts, near copies, ids that repeat or are missing; labels on most."""
    rng, rows, labels = random.Random(12), [], []
    for k in range(420):
        kind = k % 4
        text = words(rng, rng.randint(30, 60))
        if kind == 1:
            text = " ".join(f"{w} you idiot moron" if rng.random() < 0.3 else w for w in text.split())
        if kind == 2:
            text = " ".join(rng.choice(["buy now!!!", "click here", "$$$ free"]) for _ in range(30))
            text += f" {k}"
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, int(kind != 2), int(kind == 1)))
        if kind == 0 and k % 20 == 0:
            rows.append((1000 + k, text + " " + words(rng, 2), "en", "s0", 0))
        if kind == 3 and k % 60 == 3:
            rows += [(k, words(rng, 40), "en", "s1", 0), (None, words(rng, 40), None, None, None)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    import corpus_pipeline
    from criterium.llm import quality, toxicity
    from criterium.llm.learning import labelled_sample

    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    models = {"toxicity": (toxicity.ToxicityModel, "toxic", 2000, lambda s: s < 0.5), "quality": (quality.QualityModel, "quality", 1500, lambda s: s >= 0.3)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        after = out.collect()
        if name in models:
            build, label, bound, keep = models[name]
            score = build(*labelled_sample(docs, labels, label, bound)).scorer()
            want = Counter(r for r in before if keep(score([r["text"]])[0]))
            assert Counter(after) == want and 0.6 < len(after) / len(before) < 1
        elif name == "near_duplicates":
            classes = brute_classes([r["text"] for r in before])
            kept = {(r["doc_id"], r["text"]) for r in after}
            assert len(after) == len(kept) == len(set(classes)) < len(before)
            for c in set(classes):
                own = [before[k] for k in range(len(before)) if classes[k] == c]
                ids = [r["doc_id"] for r in own if r["doc_id"] is not None]
                assert sum((r["doc_id"], r["text"]) in kept and (not ids or r["doc_id"] == min(ids)) for r in own) >= 1
        else:
            sizes, got = Counter(), Counter()
            for r in before:
                sizes[r["source"]] += len(r["text"].split())
            for r in after:
                got[r["source"]] += len(r["text"].split())
            longest = max(len(r["text"].split()) for r in before)
            total, weights = sum(sizes.values()), {}
            for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
                weights[s] = (5, 2, 1)[k % 3]
            lo, hi = 0.0, 10.0 * total
            for _ in range(100):
                level = (lo + hi) / 2
                lo, hi = (level, hi) if sum(min(2 * sizes[s], level * weights[s]) for s in sizes) < 1.5 * total else (lo, level)
            assert all(abs(got[s] - min(2 * sizes[s], lo * weights[s])) <= longest for s in sizes)
            assert max(Counter(after).values()) <= 2 and not Counter(after).keys() - Counter(before).keys()
        docs = spark.createDataFrame(after, docs.schema)
    rows = corpus_pipeline.packing(spark, docs, folder).collect()
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    once = Counter(d for d, _ in texts)
    check_packed([r for r in rows if once[r["doc_id"]] == 1], [t for t in texts if once[t[0]] == 1], whole=False)
    want, _ = brute_best_fit([r["length"] for r in rows], 2048)
    assert len({r["sequence_id"] for r in rows}) == want and sum(r["piece"] == 0 for r in rows) == docs.count()


def test_run(spark, folder):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and sum(r["length"] for r in rows) > 1000
