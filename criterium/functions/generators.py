"""Table-valued functions: seeded specifications for a prompt, and parses that give any number of rows.

Both are Python UDTFs for lateral joins. What a generator draws comes from ``md5(seed:key:what)`` alone, so a row's
specifications are the same on every run, machine and partitioning.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StructType

KEYWORDS = ["harbour", "ledger", "lantern", "orchard", "quarry", "saddle", "thistle", "velvet", "willow", "anchor", "barley", "copper", "drizzle", "ember"]
AVOIDED = ["very", "really", "thing", "stuff", "basically", "obviously", "literally", "nice"]
SECTIONS = ["Purpose", "Background", "Method", "Results", "Risks", "Costs", "Schedule", "Next Steps", "Contacts"]
OPENINGS = ["Here is what we know so far.", "Let us begin with the facts.", "This note has one purpose."]
CLOSINGS = ["That is all for today.", "Please answer by Friday.", "We will write again soon."]
REPEATED = ["as agreed", "on the record", "without delay"]
SEQUENCES = [["survey", "draft", "review", "release"], ["sowing", "weeding", "harvest", "storage"], ["arrival", "briefing", "visit", "farewell"]]
STEMS = {
    "letters": ["Write a letter to a supplier whose delivery came late.", "Write to the tenants about repairs to the stairs."],
    "plans": ["Plan a day of training for new volunteers.", "Outline how a small library could lend tools."],
    "reports": ["Report on a season at a community garden.", "Summarise how three bus lines did this year."],
}
COVERAGE = ["keyword_include", "keyword_exclude", "required_sections", "casing", "no_commas", "end_phrase", "start_phrase"]
PRECISION = ["word_count", "sentence_count", "paragraph_count", "item_count", "keyword_frequency", "caps_word_frequency", "arithmetic_result", "ordering", "exact_repetition"]
#: Units, least and largest count, and of sixteen draws how many ask for an exact count.
COUNTED = {"word_count": ("words", 60, 180, 0), "sentence_count": ("sentences", 4, 9, 8), "paragraph_count": ("paragraphs", 2, 5, 8), "item_count": ("list items", 3, 7, 8), "keyword_frequency": ("times", 2, 4, 8)}


class Draws:
    """Numbers and choices of one key, each by the name of what is drawn."""

    def __init__(self, seed: int, key: str):
        self.base = f"{seed}:{key}"

    def number(self, what: str, lo: int, hi: int) -> int:
        return lo + int(md5(f"{self.base}:{what}".encode()).hexdigest()[:8], 16) % (hi - lo + 1)

    def choice(self, what: str, items: list):
        return items[self.number(what, 0, len(items) - 1)]

    def sample(self, what: str, items: list[str], k: int) -> list[str]:
        return sorted(items, key=lambda x: (md5(f"{self.base}:{what}:{x}".encode()).hexdigest(), x))[:k]


def listed(items: list) -> str:
    *head, last = map(str, items)
    return f"{', '.join(head)}{',' if len(head) > 1 else ''} and {last}" if head else last


def counted(op: str, n: int, unit: str) -> str:
    return f"{ {'exact': 'exactly', 'min': 'at least', 'max': 'at most'}[op] } {n} {unit}"


def count_spec(draws: Draws, kind: str) -> dict:
    """type, op, n: an exact count in so many of sixteen draws, else a least or a largest one."""
    _, lo, hi, exact = COUNTED[kind]
    at = draws.number(f"{kind}:op", 0, 15)
    return {"type": kind, "op": "exact" if at < exact else "min" if at % 2 else "max", "n": draws.number(f"{kind}:n", lo, hi)}


def generate(kind: str, draws: Draws) -> tuple[str, dict]:
    """The instruction in words, and the specification that checks it."""
    d = draws
    if kind in COUNTED:
        spec = count_spec(d, kind)
        if kind == "keyword_frequency":
            spec["keyword"] = d.choice("frequent", KEYWORDS)
            return f"Use the word '{spec['keyword']}' {counted(spec['op'], spec['n'], 'times')}.", spec
        return f"Write {counted(spec['op'], spec['n'], COUNTED[kind][0])}.", spec
    if kind == "keyword_include":
        words = d.sample(kind, KEYWORDS, d.number("included", 7, 10))
        return f"Mention {listed(words)}.", {"type": kind, "keywords": words}
    if kind == "keyword_exclude":
        words = d.sample(kind, AVOIDED, d.number("excluded", 3, 5))
        return f"Do without the words {listed(words)}.", {"type": kind, "keywords": words}
    if kind == "required_sections":
        names = d.sample(kind, SECTIONS, d.number("sections", 6, 8))
        return f"Use these section headers, each on a line of its own: {listed(names)}.", {"type": kind, "sections": names}
    if kind == "no_placeholders":
        return "Leave no placeholder in brackets; make up fitting details.", {"type": kind}
    if kind == "casing":
        mode = d.choice("casing", ["upper", "lower"])
        return f"Write everything in {mode} case.", {"type": kind, "mode": mode}
    if kind == "no_commas":
        return "Use no comma.", {"type": kind}
    if kind == "title":
        return "Set a title in double angle brackets.", {"type": kind}
    if kind in ("end_phrase", "start_phrase"):
        phrase = d.choice(kind, CLOSINGS if kind == "end_phrase" else OPENINGS)
        return f"{'End' if kind == 'end_phrase' else 'Begin'} with this sentence: {phrase}", {"type": kind, "phrase": phrase}
    if kind == "caps_word_frequency":
        spec = {"type": kind, "op": d.choice("caps:op", ["exact", "min"]), "n": d.number("caps:n", 1, 3)}
        return f"Write {counted(spec['op'], spec['n'], 'words in capitals')}.", spec
    if kind == "arithmetic_result":
        terms = [d.number(f"term{k}", 10, 99) for k in range(d.number("terms", 2, 3))]
        return f"Work out the sum of {listed(terms)} and give it.", {"type": kind, "expected": sum(terms)}
    if kind == "ordering":
        items = d.choice("sequence", SEQUENCES)[: d.number("length", 3, 4)]
        return f"Treat these in this order: {listed(items)}.", {"type": kind, "items": items}
    if kind == "exact_repetition":
        spec = {"type": kind, "phrase": d.choice("repeated", REPEATED), "count": d.number("repetitions", 2, 3)}
        return f"Say '{spec['phrase']}' {spec['count']} times.", spec
    raise KeyError(kind)


def kinds_for(archetype: str, draws: Draws) -> list[str]:
    if archetype == "coverage":
        return draws.sample("kinds", COVERAGE, draws.number("n", 6, 7))
    if archetype == "precision":
        return draws.sample("kinds", PRECISION, draws.number("n", 3, 4))
    raise ValueError(f"unknown archetype: {archetype}")


@udtf(returnType="position int, type string, op string, n int, instruction string, spec string")
class GeneratedSpecs:
    """(key, archetype, seed) -> a row a specification; without key or archetype none."""

    def eval(self, key: str, archetype: str, seed: int):
        if key is None or archetype is None:
            return
        draws = Draws(seed, key)
        for position, kind in enumerate(kinds_for(archetype, draws)):
            instruction, spec = generate(kind, draws)
            yield position, kind, spec.get("op"), spec.get("n"), instruction, json.dumps(spec)


def with_generated(rows: DataFrame, key: str, archetype: str, seed: int) -> DataFrame:
    """Every row with each of its specifications."""
    named = {c: F.col(c) for c in rows.columns}
    specs = GeneratedSpecs(F.col(key).cast("string").outer(), F.col(archetype).outer(), F.lit(seed))
    return rows.lateralJoin(specs).select(*named, "position", "type", "op", "n", "instruction", "spec")


def composed(rows: DataFrame, key: str, archetype: str, seed: int) -> DataFrame:
    """A prompt per row: key, archetype, domain, prompt, specs (JSON, in order), constraint_types.

    Coverage buries its requirements in prose, precision lists them.
    """
    specs = with_generated(rows.select(key, archetype).distinct(), key, archetype, seed)
    parts = specs.groupBy(key, archetype).agg(F.array_sort(F.collect_list(F.struct("position", "type", "instruction", "spec"))).alias("p"))  # seven a prompt at most
    at = lambda what, n: F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(f":{what}"))), F.lit(8)), 16, 10).cast("long") % n
    stems = F.array(*(F.struct(F.lit(d).alias("domain"), F.array(*map(F.lit, s)).alias("stems")) for d, s in STEMS.items()))
    stem = F.get(stems, at("domain", len(STEMS)).cast("int"))
    text, every = F.get(stem["stems"], at("stem", 2).cast("int")), F.col("p.instruction")
    prompt = F.when(F.col(archetype) == "coverage", F.concat(text, F.lit(" "), F.array_join(every, " "))).otherwise(F.concat(text, F.lit("\n\nRequirements:\n- "), F.array_join(every, "\n- ")))
    return parts.select(key, archetype, stem["domain"].alias("domain"), prompt.alias("prompt"), F.col("p.spec").alias("specs"), F.col("p.type").alias("constraint_types"))


def parsing(parse: Callable[[str, str | None], Iterable[tuple]], schema: str):
    """A UDTF from a parser of (text, stop reason): its rows with a null ``error``, or one row of nulls with the error's name and words.

    The columns are the parser's own and ``error``; null texts have no rows.
    """
    columns = StructType.fromDDL(schema)

    class Parsed:
        @staticmethod
        def analyze(text: AnalyzeArgument, stop_reason: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(schema=StructType([*columns.fields]).add("error", "string"))

        def eval(self, text: str, stop_reason: str) -> Iterator[tuple]:
            if text is None:
                return
            try:
                rows = [(*r, None) for r in parse(text, stop_reason)]
            except Exception as e:  # whatever a parser raises is its answer's error
                rows = [(*(None for _ in columns), f"{type(e).__name__}: {e}")]
            yield from rows

    return udtf(Parsed)
