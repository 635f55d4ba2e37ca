"""Queries over texts: verifiers, rewards, contamination, loops, pages, chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from criterium.functions import text as T
from criterium.functions import verifiers as V
from criterium.operators import contamination, loops, normalise, sampling
from criterium.plans.catalog import ORACLE_SQL, query
from criterium.plans.derive import table
from criterium.sources import readers

BLANK = "trim(coalesce({}, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = ''"

# (specification, its test in DuckDB over ``text``)
SPECS = {
    "keyword_include": ({"type": "keyword_include", "keywords": ["the", "is"]}, "contains(lower(text), 'the') AND contains(lower(text), 'is')"),
    "keyword_exclude": ({"type": "keyword_exclude", "keywords": ["license", "###"]}, "NOT contains(lower(text), 'license') AND NOT contains(lower(text), '###')"),
    "required_sections": (
        {"type": "required_sections", "sections": ["Is.", "And.", "The."]},
        r"len(list_intersect(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: lower(regexp_replace(x, '^[#*\-\s]+|[\s:*]+$', '', 'g'))), ['is.', 'and.', 'the.'])) = 3",
    ),
    "no_placeholders": ({"type": "no_placeholders"}, r"NOT regexp_matches(text, '\[[A-Z][A-Z0-9_ ]*\]|\{\{[^}]*\}\}|<[A-Z][A-Z0-9_]*>')"),
    "casing": ({"type": "casing", "mode": "upper"}, "text = upper(text) AND text <> lower(text)"),
    "no_commas": ({"type": "no_commas"}, "NOT contains(text, ',')"),
    "title": ({"type": "title"}, r"len(list_filter(regexp_extract_all(text, '<<([^\n]+)>>', 1), lambda x: trim(x) <> '')) > 0"),
    "end_phrase": ({"type": "end_phrase", "phrase": "the."}, r"""ends_with(lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g')), 'the.')"""),
    "start_phrase": ({"type": "start_phrase", "phrase": "The"}, r"""starts_with(lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g')), 'the')"""),
    "word_count": ({"type": "word_count", "op": "range", "min": 50, "max": 400}, r"len(regexp_extract_all(text, '\S+')) BETWEEN 50 AND 400"),
    "sentence_count": (
        {"type": "sentence_count", "op": "min", "n": 12},
        r"len(list_filter(string_split(regexp_replace(regexp_replace(text, '(\d)\.(\d)', '\1\2', 'g'), '[.!?]+(\s|$)', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '\s', '', 'g') <> '')) >= 12",
    ),
    "paragraph_count": ({"type": "paragraph_count", "op": "max", "n": 1}, r"len(list_filter(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n\s*\n'), lambda x: regexp_replace(x, '\s', '', 'g') <> '')) <= 1"),
    "item_count": ({"type": "item_count", "op": "max", "n": 0}, r"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*(?:[-*+]|\d+[.)])\s+\S'))) <= 0"),
    "keyword_frequency": ({"type": "keyword_frequency", "keyword": "the", "op": "min", "n": 5}, r"len(regexp_extract_all(text, '(?i)\bthe\b')) >= 5"),
    "caps_word_frequency": ({"type": "caps_word_frequency", "op": "min", "n": 3}, r"len(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]*'), lambda x: x = upper(x))) >= 3"),
    "arithmetic_result": ({"type": "arithmetic_result", "expression": "2 ** 3 + 4 // 2 - 6"}, r"regexp_matches(text, '(^|[^0-9])4([^0-9]|$)')"),
    "ordering": ({"type": "ordering", "items": ["the", "and", "of"]}, "instr(lower(text), 'the') > 0 AND instr(lower(text), 'and') >= instr(lower(text), 'the') AND instr(lower(text), 'of') >= instr(lower(text), 'and')"),
    "exact_repetition": ({"type": "exact_repetition", "phrase": "this", "count": 2}, "(length(lower(text)) - length(replace(lower(text), 'this', ''))) // 4 = 2"),
}


def docs(spark, d):
    return table(spark, d, "documents")


def _verifier(kind, spec, test):
    @query(f"SELECT doc_id, {test} AS passed FROM documents", name=f"verifier_{kind}")
    def run(spark, d):
        return docs(spark, d).select("doc_id", V.check(F.col("text"), spec).alias("passed"))


for _kind, (_spec, _test) in SPECS.items():
    _verifier(_kind, _spec, _test)


REWARDED = ["keyword_include", "no_commas", "word_count", "sentence_count"]


@query(f"""SELECT doc_id, CASE WHEN {BLANK.format('text')} THEN -1.0::DOUBLE ELSE ({' + '.join(f'({SPECS[k][1]})::INT' for k in REWARDED)}) / 4.0::DOUBLE - CASE WHEN length(text) > 3000 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS reward FROM documents""")
def reward_fraction(spark, d):
    return docs(spark, d).select("doc_id", V.reward(F.col("text"), [SPECS[k][0] for k in REWARDED], 3000).alias("reward"))


@query(r"""SELECT doc_id, ((len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) <= 400)::INT + (len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) >= 50)::INT + regexp_matches(text, '(?i)\bthe\b')::INT + (NOT regexp_matches(text, '(?i)\band\b'))::INT) / 4.0::DOUBLE AS reward FROM documents""")
def reward_older_family(spark, d):
    specs = [{"type": "max_words", "n": 400}, {"type": "min_words", "n": 50}, {"type": "keyword_include", "keyword": "the"}, {"type": "keyword_forbid", "keyword": "and"}]
    return docs(spark, d).select("doc_id", V.older_reward(F.col("text"), specs).alias("reward"))


GRAMS = r"""SELECT DISTINCT {key}, array_to_string(w[i + 1 : i + 13], ' ') AS gram FROM (SELECT {key}, w, unnest(range(len(w) - 12)) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM {table}) AS x WHERE len(w) >= 13) AS y"""


@query(None)
def contamination_13gram(spark, d):
    return contamination.contaminated(docs(spark, d), table(spark, d, "benchmark"), "doc_id", 13)


# plain SQL: its braces are no table names
ORACLE_SQL["contamination_13gram"] = f"""SELECT d.doc_id, count(*) AS shared FROM ({GRAMS.format(key='doc_id', table='documents')}) AS d
JOIN (SELECT DISTINCT gram FROM ({GRAMS.format(key='item_id', table='benchmark')}) AS z) AS b USING (gram) GROUP BY d.doc_id"""


LOOPS = """WITH t AS (SELECT doc_id, text, right(text, 4000) AS tail FROM documents WHERE length(right(text, 4000)) >= 80),
e AS (SELECT doc_id, unnest(list_transform(range(1, length(tail) - 38), lambda i: {'i': i, 's': substr(tail, i, 40)})) AS x FROM t),
s AS (SELECT doc_id, x.s AS shingle, count(*) AS n, min(x.i) AS first FROM e GROUP BY ALL),
b AS (SELECT doc_id, arg_max(shingle, n * 10000 - first) AS shingle FROM s GROUP BY doc_id HAVING max(n) >= 20),
p AS (SELECT doc_id, list_filter(range(1, length(text) - 38), lambda i: substr(text, i, 40) = shingle) AS spots FROM b JOIN t USING (doc_id)),
r AS (SELECT doc_id, list_sort(list_transform(range(1, len(spots)), lambda k: spots[k + 1] - spots[k])) AS gaps, spots[1] - 1 AS onset FROM p)"""


def _loops():
    from criterium.plans.catalog import ORACLE_SQL

    ORACLE_SQL["loop_detector"] = f"{LOOPS} SELECT d.doc_id, r.doc_id IS NOT NULL AS looping, CAST(r.gaps[len(r.gaps) // 2 + 1] AS BIGINT) AS period, CAST(r.onset AS BIGINT) AS onset FROM documents AS d LEFT JOIN r USING (doc_id)"
    ORACLE_SQL["decode_health"] = f"""{LOOPS}, x AS (SELECT d.lang AS model, d.doc_id % 3 = 0 AND r.doc_id IS NOT NULL AS rl, d.doc_id % 2 = 0 AND r.doc_id IS NOT NULL AS cl, d.doc_id % 7 <> 0 AND d.doc_id % 5 <> 0 AS clean FROM documents AS d LEFT JOIN r USING (doc_id))
SELECT model, count(*) AS n_responses, count(*) FILTER (WHERE rl) AS n_loop_reasoning, count(*) FILTER (WHERE cl) AS n_loop_content, count(*) FILTER (WHERE rl OR cl) AS n_loop_any,
  count(*) FILTER (WHERE (rl OR cl) AND clean) AS n_loop_escaped, count(*) FILTER (WHERE (rl OR cl) AND NOT clean) AS n_loop_died, count(*) FILTER (WHERE NOT clean) AS n_nonstop_finish FROM x GROUP BY model"""
    ORACLE_SQL["flagged_responses"] = f"""{LOOPS} SELECT d.doc_id AS id, d.lang AS model FROM documents AS d LEFT JOIN r USING (doc_id) WHERE ((d.doc_id % 3 = 0 OR d.doc_id % 2 = 0) AND r.doc_id IS NOT NULL) OR d.doc_id % 7 = 0 OR d.doc_id % 5 = 0"""


@query(None)
def loop_detector(spark, d):
    return docs(spark, d).select("doc_id", loops.loop("text").alias("x")).select("doc_id", "x.*")


@query(None)
def decode_health(spark, d):
    return loops.census(table(spark, d, "responses"))


@query(None)
def flagged_responses(spark, d):
    return loops.flagged(table(spark, d, "responses"), ["id"]).select("id", "model")


_loops()


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) - 1 AS dropped FROM documents GROUP BY text")
def dedup_exact(spark, d):
    rows = sampling.drop_exact_duplicates(docs(spark, d).select("doc_id", "text"), "text", "doc_id")
    return rows.select(F.md5("text").alias("digest"), "doc_id", "dropped")


@query("SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn, role, text) AS chat FROM conversations GROUP BY conv_id")
def chat_messages(spark, d):
    return normalise.chats(table(spark, d, "conversations"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)) AS n, array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), chr(10)) AS bodies FROM pages")
def html_script_extract(spark, d):
    return table(spark, d, "pages").select("page_id", readers.script_bodies(F.col("html")).alias("b")).select("page_id", F.size("b").cast("long").alias("n"), F.array_join("b", "\n").alias("bodies"))


@query("SELECT doc_id, CASE WHEN length(text) > 600 THEN left(text, 400) || ' [...] ' || right(text, 200) ELSE text END AS clipped, length(text) > 600 AS cut FROM documents")
def clipped_fields(spark, d):
    return docs(spark, d).select("doc_id", T.clip_middle(F.col("text"), 600, " [...] ").alias("clipped"), (F.length("text") > 600).alias("cut"))


@query(r"SELECT doc_id, regexp_replace(list_last(string_split(text, '. ')), '^\s+|\s+$', '', 'g') AS answer, list_last(string_split(text, ' the ')) AS tail, regexp_matches(text, '(?s)<think>.*?</think>') AS reasoned FROM documents".replace("list_last(", "list_extract(").replace("'. '))", "'. '), -1)").replace("' the '))", "' the '), -1)"))
def answer_extraction(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", T.final_answer(t, ". ").alias("answer"), T.without_reasoning(t, " the ").alias("tail"), T.has_reasoning(t).alias("reasoned"))


@query(r"SELECT doc_id, left(sha256(text), 12) AS digest, len(regexp_extract_all(text, '\S+')) AS n_words, concat(doc_id, '#c', lpad(CAST(doc_id % 40 AS STRING), 2, '0'), ':', lang) AS criterion, lang AS kind FROM documents")
def text_digests(spark, d):
    criterion = T.criterion_id(F.col("doc_id").cast("string"), F.col("doc_id") % 40, F.col("lang"))
    rows = docs(spark, d).withColumn("criterion", criterion)
    return rows.select("doc_id", T.short_digest(F.col("text")).alias("digest"), F.size(T.words(F.col("text"))).cast("long").alias("n_words"), "criterion", T.kind_of(F.col("criterion")).alias("kind"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k string")["k"].try_cast("long").alias("k"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    from criterium.streaming.incremental import pending

    return pending(docs(spark, d).select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def semi_join_selected(spark, d):
    return docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels").where("quality = 0"), "doc_id", "left_semi")


@query("SELECT doc_id, concat('1. ', lang, chr(10), '2. ', source) AS listed, concat(lang, ' and ', source) AS sentence, concat(lang, '__', source) AS cell FROM documents")
def rendered_lists(spark, d):
    items = F.array("lang", "source")
    return docs(spark, d).select("doc_id", T.numbered(items).alias("listed"), T.english_list(items).alias("sentence"), T.cell_id(F.col("lang"), F.col("source")).alias("cell"))


@query("SELECT doc_id, CASE WHEN finish = 'refusal' THEN 'judge_refusal' WHEN finish = 'max_tokens' THEN 'judge_truncated' WHEN source = 'src3' THEN 'judge_parse_error' ELSE 'ok' END AS state FROM (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN 'max_tokens' WHEN doc_id % 9 = 0 THEN 'refusal' ELSE 'stop' END AS finish FROM documents) AS x")
def judge_output_states(spark, d):
    stop = F.when(F.col("doc_id") % 4 == 0, "length").when(F.col("doc_id") % 9 == 0, "content_filter").otherwise("stop")
    return docs(spark, d).select("doc_id", normalise.output_state(stop, F.when(F.col("source") != "src3", F.col("text"))).alias("state"))
