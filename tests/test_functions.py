"""Text, verifier and statistics functions on small cases."""

import json
import random
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from criterium.functions import stats, text, verifiers
from criterium.operators import contamination, loops, normalise, sampling
from criterium.operators.ranks import kendall_tau
from criterium.sources import readers, sinks
from criterium.streaming import incremental


def value(spark, column, **fields):
    names = list(fields)
    return spark.createDataFrame([tuple(fields[n] for n in names)], ", ".join(f"{n} {'array<string>' if isinstance(fields[n], list) else 'string'}" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("spec", "good", "bad"),
    [
        ({"type": "keyword_include", "keywords": ["Tide"]}, "the riptides rise", "the moon"),
        ({"type": "keyword_exclude", "keywords": ["salt"]}, "fresh water", "Basalt rock"),
        ({"type": "required_sections", "sections": ["Method"]}, "** Method **\nstir", "no method given"),
        ({"type": "no_placeholders"}, "see [note 4]", "yours, <SIGNATURE>"),
        ({"type": "casing", "mode": "upper"}, "LOW TIDE 06:12", "Low TIDE"),
        ({"type": "casing", "mode": "lower"}, "low tide 06:12", "06:12"),
        ({"type": "no_commas"}, "wind; rain", "wind, rain"),
        ({"type": "title"}, "x <<Harbour log>> y", "<<   >>"),
        ({"type": "end_phrase", "phrase": "Over and out"}, '"We land. over and out"', "over and out!"),
        ({"type": "start_phrase", "phrase": "Captain"}, "captain's log", "the captain"),
        ({"type": "word_count", "op": "range", "min": 2, "max": 4}, "three short  words", "one"),
        ({"type": "sentence_count", "op": "max", "n": 1}, "It rose 2.5 metres.", "It rose. It fell."),
        ({"type": "paragraph_count", "op": "exact", "n": 3}, "a\n\nb\n \t\nc", "a\nb\nc"),
        ({"type": "item_count", "op": "exact", "n": 3}, "* x\n+ y\n10. z", "* x\n*y\n10 z"),
        ({"type": "keyword_frequency", "keyword": "buoy", "op": "min", "n": 2}, "Buoy by buoy", "buoys, buoyant"),
        ({"type": "caps_word_frequency", "op": "exact", "n": 1}, "MAYDAY heard", "MAYDAY MAYDAY"),
        ({"type": "arithmetic_result", "expression": "2 ** 3 + 1"}, "sums to 9", "sums to 19"),
        ({"type": "ordering", "items": ["ebb", "flow"]}, "Ebb, then FLOW", "flow and ebb"),
        ({"type": "exact_repetition", "phrase": "ahoy", "count": 3}, "Ahoy ahoyAHOY", "ahoy ahoy"),
    ],
)
def test_verifier(spark, spec, good, bad):
    assert value(spark, verifiers.check(F.col("t"), spec), t=good) is True
    assert value(spark, verifiers.check(F.col("t"), spec), t=bad) is False


def test_checks_by_name(spark):
    assert len(verifiers.CHECKS) == 18
    with pytest.raises(KeyError):
        verifiers.check(None, {"type": "unknown"})
    with pytest.raises(ValueError):
        verifiers.with_checks(title=lambda t, s: t)
    assert len(verifiers.with_checks(rhymes=lambda t, s: t)) == 19
    assert value(spark, verifiers.score("word_count", F.col("t"), {"op": "exact", "n": 2}), t="two words") == 1.0
    assert value(spark, verifiers.score("word_count", F.col("t"), {"op": "around"}), t="two words") == 0.0


@pytest.mark.parametrize("text", ["1", "-7 // 2", "2 ** -1", "-2 ** 2", "2 ** 3 ** 2", "(1 + 2) * (3 - 4) % 5", "1.5e1 / .5", "--3 + +4", "7 % -3", "10 - 4 - 3", "2 * (3 + 4) ** 2 // 5"])
def test_arithmetic_equals_the_language(text):
    assert verifiers.evaluate(text) == eval(text)


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1)", "a + 1", "1 2", "__import__('os')", "True", "1 < 2", "* 3"])
def test_other_than_arithmetic(text):
    with pytest.raises(ValueError):
        verifiers.evaluate(text)


def test_rewards_of_nothing(spark):
    assert value(spark, verifiers.older_reward(F.col("t"), []), t="x") == 1.0
    assert value(spark, verifiers.reward(F.col("t"), []), t="x") == 0.0
    assert value(spark, verifiers.reward(F.col("t"), []), t=" ") == -1.0
    assert value(spark, verifiers.reward(F.col("t"), [{"type": "no_commas"}], 2), t="abc") == 0.5


def test_ngrams(spark):
    words = " ".join(f"w{k}" for k in range(13))
    assert len(value(spark, text.ngrams(F.col("t"), 13), t=words)) == 1
    assert value(spark, text.ngrams(F.col("t"), 13), t="few words") == []
    docs = spark.createDataFrame([(1, words.upper().replace(" ", ", ")), (2, " ".join(words.split()[:12]) + " other")], "doc_id long, text string")
    assert [r["doc_id"] for r in contamination.contaminated(docs, docs.where("doc_id = 1"), "doc_id").collect()] == [1]


def test_answers(spark):
    assert value(spark, text.final_answer(F.col("t")), t="a ===FINAL=== b ===FINAL=== c ") == "c"
    assert value(spark, text.final_answer(F.col("t")), t=" whole ") == "whole"
    assert value(spark, text.without_reasoning(F.col("t")), t="<think>x</think> y") == " y"
    assert value(spark, text.english_list(F.col("t")), t=["a", "b", "c"]) == "a, b, and c"
    assert value(spark, text.english_list(F.col("t")), t=["a", "b"]) == "a and b"


def brute_loop(t):
    tail = t[-4000:]
    seen = Counter(tail[k : k + 40] for k in range(len(tail) - 39))
    if len(tail) < 80 or max(seen.values()) < 20:
        return None
    best = next(tail[k : k + 40] for k in range(len(tail)) if seen[tail[k : k + 40]] == max(seen.values()))
    at = [k for k in range(len(t)) if t.startswith(best, k)]
    gaps = sorted(b - a for a, b in zip(at, at[1:]))
    return gaps[len(gaps) // 2], at[0]


def test_loops_equal_brute_force():
    rng = random.Random(1)
    some = lambda n: "".join(rng.choice("abcdé \U0001f600\n") for _ in range(n))
    texts = ["", "x" * 59, "x" * 79, "x" * 80, "y" * 9000, some(6000)]
    for period in (1, 7, 39, 40, 41, 150, 205, 220):
        unit = some(period)
        texts += [some(500) + unit * (4200 // period) + some(30), unit * 20 + some(3000), some(4000) + unit * 19]
    assert [loops.repetition(t) for t in texts] == [brute_loop(t) for t in texts]
    assert sum(brute_loop(t) is not None for t in texts) > 8


def test_statistics(spark):
    df = spark.createDataFrame([(10, 10), (0, 0)], "k int, n int")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    a, b = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert abs(a["lo"] - 0.722) < 1e-3 and abs(a["hi"] - 1) < 1e-9 and (b["lo"], b["hi"]) == (0.0, 1.0)
    ranks = lambda rows: kendall_tau(spark.createDataFrame(rows, "i string, a int, b int"), "a", "b").first()["tau"]
    assert ranks([("x", 1, 1), ("y", 2, 2), ("z", 3, 3)]) == 1
    assert ranks([("x", 1, 3), ("y", 2, 2), ("z", 3, 1)]) == -1
    assert abs(ranks([("x", 1, 1), ("y", 2, 3), ("z", 3, 2)]) - 1 / 3) < 1e-12
    assert ranks([("x", 1, 1)]) is None
    assert df.select(stats.percent(F.col("k"), F.col("n"), None).alias("p")).collect()[1]["p"] is None


def test_verdicts_are_completed(spark):
    parsed = spark.createDataFrame([("P", 0, "1", "pass", "r"), ("P", 1, "1", "FAIL", "again"), ("P", 2, "x", "PASS", ""), ("P", 3, "9", "PASS", "")], "id string, ord int, index string, verdict string, reason string")
    rows = normalise.verdicts(parsed, spark.createDataFrame([("P", 2)], "id string, n int"), ["id"]).orderBy("index").collect()
    assert [(r["index"], r["verdict"], r["reason"]) for r in rows] == [(1, "FAIL", "again"), (2, "FAIL", "missing_in_judge_output")]


def test_wide_criteria(spark):
    df = spark.createDataFrame([("a", " ", None, "nan", "b ")], "criterion_1 string, criterion_2 string, criterion_3 string, criterion_4 string, criterion_5 string")
    assert df.select(normalise.clean_criteria(df).alias("x")).first()["x"] == ["a", "b"]


def test_covering_selection(spark):
    rng = random.Random(2)
    rows = [(f"p{k}", rng.choice(["mail", "code", "code", "essay"]), rng.choice("uvwxyz"), rng.choice(["plain", "terse"])) for k in range(90)]
    df = spark.createDataFrame(rows, "id string, use_case string, instruction_type string, prompt_style string")
    kinds, sizes = {r[0]: r for r in rows}, Counter(r[1] for r in rows)

    def one_by_one(n):
        left, types, styles, out = sorted(rows, key=lambda r: md5(f"4:{r[0]}".encode()).hexdigest()), set(), set(), []
        while len(out) < min(n, len(rows)):
            for use in sorted(sizes, key=lambda u: (-sizes[u], u)):
                own = [r for r in left if r[1] == use]
                if own and len(out) < n:
                    best = min(own, key=lambda r: (r[2] in types) + (r[3] in styles))
                    left.remove(best)
                    types.add(best[2])
                    styles.add(best[3])
                    out.append(best[0])
        return sorted(out)

    for n in (1, 7, 24, 200):
        got = sorted(r["id"] for r in sampling.covering(df, n, 4).collect())
        assert got == one_by_one(n) and len({kinds[i][2] for i in got}) == min(n, 6)
    assert sampling.covering(df, 0, 4).count() == sampling.covering(df.limit(0), 5, 4).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_covering_of_many_values_and_nulls(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice([None, "a", "b", "b", "c"]), rng.choice([None, *range(30)]), rng.choice([None, *"pqrstuvw"])) for k in range(120)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, use_case string, instruction_type int, prompt_style string, _draw string, _place int")
    sizes = Counter(r[1] for r in rows)
    for n in (3, 40, 119):
        left, seen, out = sorted(rows, key=lambda r: md5(f"9:{r[0]}".encode()).hexdigest()), (set(), set()), []
        while len(out) < n:
            for use in sorted(sizes, key=lambda u: (-sizes[u], u is None, u or "")):
                own = [r for r in left if r[1] == use]
                if own and len(out) < n:
                    best = max(own, key=lambda r: (r[2] not in seen[0]) + (r[3] not in seen[1]))
                    left.remove(best)
                    seen[0].add(best[2])
                    seen[1].add(best[3])
                    out.append(best[0])
        got = sampling.covering(df.repartition(3), n, 9)
        assert sorted(r["id"] for r in got.collect()) == sorted(out) and got.columns == df.columns


def test_turns():
    assert sampling.turns_of({"a": 5, "b": 2, "c": 5}, 9) == {"a": 4, "b": 2, "c": 3}
    assert sampling.turns_of({"a": 1}, 9) == {"a": 1} and sampling.turns_of({}, 3) == {} and sampling.turns_of({"a": 2, None: 2}, 3) == {"a": 2, None: 1}


def test_json_sources(spark, tmp_path):
    schema = "id string, n int"
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n{"id": "y", "n": 2}\n')
    assert readers.json_any(spark, str(tmp_path / "a.jsonl"), schema).count() == 2
    (tmp_path / "b.json").write_text('[{"id": "x", "n": 1}, {"id": "y", "n": 2}, {"id": "z", "n": 3}]')
    assert readers.json_any(spark, str(tmp_path / "b.json"), schema, limit=2).count() == 2
    (tmp_path / "c.jsonl").write_text('{"id": "x", "n": 1}\n{broken\n')
    assert readers.json_lines(spark, str(tmp_path / "c.jsonl"), schema, tolerant=True).where("id is not null").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(tmp_path / "c.jsonl"), schema).collect()
    (tmp_path / "notes.txt").write_text("# head\n\n a note \n")
    assert [r["note"] for r in readers.notes(spark, str(tmp_path / "notes.txt")).collect()] == ["a note"]


def test_worksheet(spark):
    sheet = "intro\n## row 1\nhuman_label: a\nhuman_label: b\n## row 2\nhuman_label:\n"
    found = value(spark, readers.worksheet(F.col("t")), t=sheet)
    assert [(r["row"], r["label"]) for r in found] == [(1, "b"), (2, "")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("j", "m", "1"), ("j", "n", "2")], "judge string, model string, id string")
    sinks.append(df, str(tmp_path / "g"), ["judge", "model"])
    sinks.append(df, str(tmp_path / "g"), ["judge", "model"])
    assert readers.partitioned(spark, str(tmp_path / "g"), "id string").where("model = 'm'").count() == 2
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in sinks.repaired(old, new, ["k"]).collect()} == {(1, "a"), (2, "c")}
    assert sinks.log_union([old, df]).columns == ["k", "v", "judge", "model", "id"]
    models = spark.createDataFrame([("m", 50.0)], "model string, pass_rate double")
    for prompts in (spark.range(300).select((F.col("id") * 7 % 300).alias("k"), F.lit('a "quoted"\nline').alias("v")).repartition(5), old.limit(0)):
        sinks.write_document(sinks.results_document({"slug": "x"}, models, prompts, "k"), str(tmp_path / "doc"))
        doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*"))))
        assert doc["meta"] == {"slug": "x"} and doc["summary"] == {"criterion_pass_rate": {"m": 50.0}}
        assert [r["k"] for r in doc["prompts"]] == list(range(prompts.count())) and all(r["v"] == 'a "quoted"\nline' for r in doc["prompts"])


def test_stream_resumes(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.json").write_text('{"id": "a"}\n{"id": "a"}\n{"id": "b"}\n')
    run = lambda: incremental.upsert_batches(incremental.file_stream(spark, str(source), "id string"), out, str(tmp_path / "cp"), ["id"])
    run()
    (source / "2.json").write_text('{"id": "b"}\n{"id": "c"}\n')
    run()
    run()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_model_source(spark):
    class Fake(readers.ModelSource):
        def ask(self, prompt):
            return prompt[::-1], "stop"

    rows = readers.pull_rows(spark.createDataFrame([("1", "abc")], "id string, prompt string"), Fake()).collect()
    assert [tuple(r) for r in rows] == [("1", "cba", "stop")]
