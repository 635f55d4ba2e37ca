"""The training-data operators against brute force, exact round trips, held-out accuracy and odd rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from criterium.llm import fingerprints, idpack, licenses, mixing, neighbours, packing, quality, queries, tokens, toxicity
from criterium.llm import common
from tests.llm.conftest import DOCS, ODD
from tests.test_queries import matches


@pytest.mark.parametrize("name", ["op4_merkle", "op5_mix", "op6_licenses"])
def test_equals_sql(spark, data, name):
    matches(spark, data, queries.QUERIES[name], queries.ORACLE_SQL[name])


# tokens and files


@pytest.mark.parametrize("text", [r[1] for r in ODD[:10] if r[1] and len(r[1]) < 1000] + ["a  b\n\n\nc \n d", "x\x1cy \x1c z", " it's 'S 's''s", "a_b _ c__", "<|endoftext|> a", "　x\xa0 y\x85"])
def test_chunks_encode_like_whole_texts(text):
    coder = tokens.ChunkEncoder(tokens.default_path(), kept=3)
    assert coder.encode(text) == coder.whole(text) == coder.encode(text)


def test_white_space_encodes_like_whole_texts():
    rng, coder = random.Random(6), tokens.ChunkEncoder(tokens.default_path(), kept=2000)
    for _ in range(3000):
        text = "".join(rng.choice([" ", " ", "\n", "\n", "\t", "\xa0", "a", "Word", "it's", ",", "1", "_", "é", "."][: rng.choice([4, 14, 14])]) for _ in range(rng.randint(0, 12)))
        assert coder.encode(text) == coder.whole(text), repr(text)


def test_groups_encode_like_whole_texts(monkeypatch):
    rng, coder = random.Random(7), tokens.ChunkEncoder(tokens.default_path(), kept=2000)
    monkeypatch.setattr(tokens, "GROUP", 200)
    parts = ["été", "ÿ", "Straße,", "naïve.", "word", "\n", "\n\n", " ", "it's", "don't!", ",,", "a,b", "ª", "Жук", "\t", "日本", "\u00ad", "x2;", "\x1f", "<|endoftext|>", "\U0001f600"]
    texts = [rng.choice(["", " "]).join(rng.choices(parts[: rng.choice([13, 17, len(parts)])], k=rng.randint(0, 60))) for _ in range(2000)]
    assert list(coder.encode_all(texts)) == [coder.whole(t) for t in texts]
    assert list(coder.encode_all([])) == []


def test_added_tokens_encode_like_the_library():
    from tokenizers import Tokenizer

    text, plain = "a <|endoftext|> b", Tokenizer.from_file(tokens.default_path())
    want = plain.encode(text, add_special_tokens=False).ids
    assert 50256 in want and list(np.frombuffer(tokens.ChunkEncoder(tokens.default_path()).encode(text), "<u4")) == want


def test_documents_encode_like_whole_texts(documents):
    coder = tokens.encoder()
    for r in documents.limit(60).collect():
        assert coder.encode(r["text"]) == coder.whole(r["text"])


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 999, dtype=np.uint64).astype("<u4")
    data = idpack.pack(ids, width)
    assert len(data) == -(-999 * width // 8)
    assert (idpack.unpack(data, width, 999) == ids).all()


def test_width():
    assert [idpack.width_of(v) for v in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_shard_random_access(tmp_path):
    import pyarrow as pa

    rng, path = np.random.default_rng(0), str(tmp_path / "s.ids")
    docs = [rng.integers(0, 8000, n, dtype=np.uint32) for n in (0, 1, 5000, 3, 9000, 4096)]
    with pa.OSFile(path, "wb") as f:
        w = idpack.ShardWriter(f, 13)
        for k, d in enumerate(docs):
            w.add(None if k == 3 else k, d)
        w.close()
    with pa.OSFile(path) as f:
        r = idpack.ShardReader(f)
        assert r.docs == [0, 1, 2, None, 4, 5]
        for k in (4, 0, 2, 5, 1, 3):
            assert (r.document(k) == docs[k]).all()
        assert (r.ids(4990, 5010) == np.concatenate(docs)[4990:5010]).all()


def brute_ids(rows):
    coder = tokens.encoder()
    return [(d, np.append(np.frombuffer(coder.whole(t or ""), "<u4"), np.uint32(0)).astype("<u4")) for d, t in rows]


def test_idpack(spark, odd, empty):
    path = common.fresh_path(spark, "t")
    idpack.write_ids(odd, path)
    got = sorted(tuple(r) for r in idpack.read_digests(spark, path).fillna(-1).collect())
    rows = sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in ODD)
    want, start = [], 0
    for d, ids in brute_ids(rows):
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    idpack.write_ids(empty, path + "-empty")
    assert idpack.read_digests(spark, path + "-empty").count() == 0


# packing


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms[rooms.index(min(fit))] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms), sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 4))]) for _ in range(rng.randint(0, 200))]
    segments, bins = packing.plan(Counter(lengths), capacity)
    used, spans = Counter(), {}
    counts = Counter(lengths)
    for i, (length, rank, first, each, offset) in enumerate(segments):
        after = next((s[1] for s in segments[i + 1 : i + 2] if s[0] == length), counts[length])
        for k in range(after - rank):
            b = first + k // each
            spans.setdefault(b, []).append((offset + k % each * length, length))
            used[length] += 1
    assert used == counts
    for b, s in spans.items():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    want, rooms = brute_best_fit(lengths, capacity)
    assert bins == want == len(spans)
    assert sorted(capacity - sum(n for _, n in s) for s in spans.values()) == rooms


def check_packed(rows, texts, whole=True):
    coder = tokens.encoder()
    by_bin, by_doc = {}, {}
    for r in rows:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for spans in by_bin.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at or not whole
            at = offset + length
        assert at <= 2048
    for d, t in texts:
        ids = coder.whole(t or "") + b"\0\0\0\0"
        for piece, start, length, crc in by_doc[d]:
            assert crc == zlib.crc32(ids[4 * start : 4 * (start + length)])
            assert length == 2048 or piece == 0
        assert sum(p[2] for p in set(by_doc[d])) == len(ids) // 4


def test_pack(spark, odd, empty, documents):
    check_packed(packing.pack(odd).collect(), [r[:2] for r in ODD])
    assert packing.pack(empty).count() == 0
    texts = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    rows = packing.pack(documents).collect()
    check_packed(rows, texts)
    want, _ = brute_best_fit([r["length"] for r in rows], 2048)
    assert len({r["sequence_id"] for r in rows}) == want


def test_pack_of_texts_encoded_together(spark, odd, empty, documents):
    for group in (1, 2_000, tokens.GROUP):
        assert sorted(map(str, packing.pack(odd, group=group, kept=10_000).collect())) == sorted(map(str, packing.pack(odd).collect()))
    assert packing.pack(empty, group=1).count() == 0
    assert sorted(packing.pack(documents, group=50_000).collect()) == sorted(packing.pack(documents).collect())


# mixing


def test_mix_words_near_targets(spark, documents):
    rows = mixing.mix(documents).collect()
    sums, targets, largest = Counter(), {}, Counter()
    for r, s in zip(rows, rows):
        assert r["taken"] <= 2 * r["size"]
    sources = {r["doc_id"]: r["source"] for r in documents.select("doc_id", "source").collect()}
    for r in rows:
        s = sources[r["doc_id"]]
        sums[s] += r["taken"]
        targets[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert r["target"] <= 2 * r["source_size"] + 1e-6
    assert all(abs(sums[s] - targets[s]) <= largest[s] for s in targets)
    assert abs(sum(targets.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-3
    assert {tuple(r) for r in mixing.mix(documents.repartition(7)).collect()} == {tuple(r) for r in rows}


def test_mix_odd(spark, odd, empty):
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(empty).count() == 0
    twins = odd.limit(0).unionByName(odd.sparkSession.createDataFrame([(3, f"{w} two three", "en", "s", k, "clash", 1.5) for k, w in enumerate("abcdefghij")], odd.schema))
    taken = [sorted(r["text"] for r in mixing.mixed(twins.repartition(n).orderBy(F.rand(n))).collect()) for n in (1, 4, 9)]
    assert taken[0] == taken[1] == taken[2]
    got = mixing.mixed(odd)
    assert got.columns == odd.columns
    assert got.count() == mixing.mix(odd).agg(F.sum("copies")).first()[0]
    rows = [(None, "a b c" if k % 2 else "d e", "s", k) for k in range(200)] + [(7, "x y", None, k) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int").selectExpr("*", "rank AS size", "rank AS _row", "rank AS target")
    taken = mixing.mixed(docs).collect()
    assert len(taken) == mixing.mix(docs).agg(F.sum("copies")).first()[0] and max(Counter((r["source"], r["rank"]) for r in taken).values()) <= 2


# classifiers


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_held_out(spark, module, label):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = module.score(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r[label] for r in rows) / len(rows)
    assert right >= 0.93 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored.collect())


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_odd(spark, odd, empty, module, label):
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 1), (99, 0)], f"doc_id long, {label} int")
    assert module.score(odd, labels).count() == len(ODD)
    assert module.score(odd, labels.limit(0)).count() == len(ODD)
    assert module.score(empty, labels).count() == 0
    assert module.reject(odd, labels.limit(0)).count() == len(ODD)
    many = spark.createDataFrame([(k, ("you idiot %d moron trash" if k % 2 else "fine prose %d here") % k + " and more words" * (k % 9), "en", "a", 0) for k in range(400)], DOCS)
    marks = spark.createDataFrame([(k, k % 2) for k in range(400)], f"doc_id long, {label} int")
    kept = module.reject(many, marks)
    assert kept.schema == many.schema
    wrong = {r["doc_id"] % 2 for r in kept.collect()}
    assert wrong == ({0} if label == "toxic" else {1})


def test_isotonic():
    from criterium.llm.learning import Isotonic

    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1])
    assert list(Isotonic(x, y, np.ones(5))(x)) == [0, 0.5, 0.5, 1, 1]


# fingerprints and licenses


def test_fingerprints_odd(spark, odd, empty):
    rows = fingerprints.compare(odd).collect()
    assert len(rows) == len(ODD)
    assert fingerprints.compare(empty).count() == 0
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[1] == prints[5] and prints[2] == prints[3] and prints[1] != prints[4]
    lone = fingerprints.compare(odd.where("doc_id = 4")).first()
    assert lone["near_next"] == 1.0 and lone["n_chars"] == 3


def test_edits_are_located(spark):
    df = spark.createDataFrame([("a b\nc d\n\ne f\ng h", "a b\nc x\n\ne f\ng h\nnew")], "l string, r string")
    p = lambda c: fingerprints.fingerprint(fingerprints.digests(F.col(c)))
    found = df.select(fingerprints.differing_paragraphs(p("l"), p("r")).alias("x")).first()["x"]
    assert [(x["section"], x["paragraph"]) for x in found] == [(0, 1), (1, 2)]


def test_edits_are_found_from_the_root_down(spark):
    """Random edits: the paragraphs and leaves that differ are those of the texts, and equal branches are not looked into."""
    rng = random.Random(8)
    text = lambda: "\n\n".join("\n".join(" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4)))
    pairs = []
    for _ in range(60):
        a = text()
        at = rng.randrange(len(a) + 1)
        pairs.append((a, a[:at] + rng.choice(["", "x", " new", "\n", "\n\n"]) + a[at + rng.randrange(2) :]))
    pairs += [("", ""), ("", "a"), ("a", "a")]

    def plain(a, b):
        def cut(p):
            return [m[0] for m in re.finditer(fingerprints.LEAVES, p)]

        out = []
        for i, (s, t) in enumerate(itertools.zip_longest(a.split("\n\n"), b.split("\n\n"))):
            for j, (p, q) in enumerate(itertools.zip_longest(s.split("\n") if s is not None else [], t.split("\n") if t is not None else [])):
                if p != q:
                    out.append((i, j, [k for k, (x, y) in enumerate(itertools.zip_longest(cut(p or ""), cut(q or ""))) if x != y]))
        return out

    p = lambda c: fingerprints.fingerprint(fingerprints.digests(F.col(c)))
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(pairs)], "k int, a string, b string").select("k", p("a").alias("a"), p("b").alias("b"))
    got = {r["k"]: [(x["section"], x["paragraph"], x["leaves"]) for x in r["x"]] for r in rows.select("k", fingerprints.differing(F.col("a"), F.col("b")).alias("x")).collect()}
    assert got == {k: plain(*x) for k, x in enumerate(pairs)}


def test_licenses_odd(spark, odd, empty):
    rows = licenses.scan(odd).collect()
    assert len(rows) == len(ODD) and all(r["labels"] == "" and r["score"] == 0 for r in rows)
    assert licenses.scan(empty).count() == 0
    text = "x MIT license, mit-LICENSE\nGNU General Public License\nLicensed under CC BY-NC 4.0.\nAll rights reserved"
    r = licenses.scan(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert len(r) == 2 and r[0] == r[1]
    assert (r[0]["n_base"], r[0]["first_word"], r[0]["last_word"], r[0]["base_labels"]) == (3, 1, 6, "gpl,mit")
    assert "cc-by-nc" in r[0]["labels"] and "reserved" in r[0]["labels"]


def test_licenses_over_lines_equal_brute_force(spark):
    """Wrapped and commented notices at any place of longer texts; every window against every template."""
    rng, texts = random.Random(4), []
    for label, notice in licenses.TEMPLATES:
        parts = notice.split()
        for _ in range(4):
            own = [w for w in parts if rng.random() > 0.03]
            own = [w + rng.choice([" ", ", ", "\n * ", "\r\n# ", " "]) for w in own]
            around = ["".join(rng.choice("abcde") for _ in range(3)) + rng.choice([" ", "\n"]) for _ in range(rng.randint(0, 150))]
            at = rng.randint(0, len(around))
            texts.append("".join([*around[:at], *own, *around[at:]]).upper() if rng.random() < 0.2 else "".join([*around[:at], *own, *around[at:]]))
    texts += ["released under the apache license", "x " * 5000 + "all rights reserved", "İ K license"]
    span = max(len(t.split()) - 1 for _, t in licenses.TEMPLATES)

    def brute(text):
        own = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))
        two = [(a, b) for a, b in zip(own, own[1:])]
        held = [{*two[k : k + 2 * span]} for k in range(0, len(two), span)]
        best = {}
        for label, notice in licenses.TEMPLATES:
            want = {*zip(notice.split(), notice.split()[1:])}
            share = max((len(want & h) / len(want) for h in held), default=0)
            if share >= licenses.THRESHOLD:
                best[label] = max(best.get(label, 0), share)
        plain = f" {' '.join(own)} "
        base = {label: len(re.findall(f"(?= {p} )", plain)) for p, label in licenses.PHRASES.items()}
        labels = {*best, *(k for k, n in base.items() if n)}
        return len(own), sum(base.values()), ",".join(sorted(labels)), 1.0 if any(base.values()) else max(best.values(), default=0.0)

    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["labels"], r["score"]) for r in rows}
    assert got == {k: brute(t) for k, t in enumerate(texts)}
    assert sum(bool(g[2]) for g in got.values()) > len(texts) // 2
    mit = licenses.TEMPLATES[2][1].split()
    wrapped = " * " + " ".join(mit[:12]) + ",\n * " + " ".join(mit[12:])
    assert licenses.scan(spark.createDataFrame([(1, wrapped)], "doc_id long, text string")).first()["labels"] == "mit"


def test_licenses_leave_prose_alone(spark):
    prose = ["The rights are reserved to all of us", "all the hotel rooms are reserved and civil rights matter too", "a license was released under the name mit by the school", "released under the terms we agreed, with the apache helicopter license"]
    notices = ["All Rights\n# Reserved.", "-- Released under the\n-- MIT license --", "/* Licensed under the Apache License,\n * Version 2.0 */"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(prose + notices)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in rows] == [""] * len(prose) + ["reserved", "mit", "apache"]
    assert all(r["score"] == 0 for r in rows[: len(prose)])
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), templates=[("one", "word")])


# neighbours


def test_neighbours_recall(spark, data):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in vectors.collect()]
    x, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    got = {}
    for r in neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, block=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for i, v in rows:
        if i % 20 == 0:
            s = x @ v
            order = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:20]
            assert [r for r, _, _ in sorted(got[i])] == list(range(1, 21))
            assert all(abs(score - s[list(ids).index(k)]) < 1e-9 for _, k, score in got[i])
            hits += len({k for _, k, _ in got[i]} & {int(ids[k]) for k in order})
            total += 20
    assert hits / total >= 0.9


def test_neighbours_candidates():
    """Of random vectors, which the tables' nearly are, a quarter is read for a recall of 0.9 and more; of vectors in tight groups, a few hundredths."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(16_000, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    tight = np.repeat(rng.normal(size=(400, 64)), 20, axis=0) + 0.05 * rng.normal(size=(8000, 64))
    tight /= np.sqrt((tight * tight).sum(axis=1))[:, None]
    for data, reach, floor, share, recall in ((x, neighbours.REACH, neighbours.LEAST, 0.3, 0.9), (tight, 0.02, 0, 0.05, 0.99)):
        n, asks = len(data), np.arange(0, len(data), 100)
        forest = neighbours.Forest(data, np.sqrt((data * data).sum(axis=1).max()))
        read = hits = 0
        for i, (rows, scores, candidates) in zip(asks, forest.search(data[asks], neighbours.strings(data[asks], np.zeros(len(asks))), 20, reach, floor)):
            near = np.argsort(-(data @ data[i]), kind="stable")[:20]
            hits += len({*near.tolist()} & {*rows.tolist()})
            read += candidates
        assert read / len(asks) / n < share and hits / 20 / len(asks) >= recall


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [-1.0, 1.0]), (None, [9.0, 9.0]), (10, [1.0, 2.0, 3.0]), (20, [3.0, 1.0]), (20, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [
        (0, 20, 3.0), (0, 20, 3.0), (0, 7, 2.0), (0, 8, 2.0), (0, 9, -1.0), (20, 7, 6.0), (20, 8, 6.0), (20, 0, 3.0), (20, 9, -2.0),
    ]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# the pipeline


def test_settings_are_read_from_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
