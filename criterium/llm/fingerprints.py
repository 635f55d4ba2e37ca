"""Merkle fingerprints of documents, in DataFrame functions alone.

A text is split into sections (at blank lines), paragraphs (at line ends) and leaves (runs of at
most ``LEAF`` words with their white space); nothing is left out. A leaf's digest is its md5, a
paragraph's and a section's the md5 of their children's digests, the root the sha256 of the
sections'. A fingerprint is ``root:tree``; the tree lists the digests of all nodes in order, eight
characters each: ``S`` and a section's, then for each of its paragraphs ``P`` and the paragraph's,
then its leaves'; ``,`` stands between paragraphs and ``;`` between sections. Equal roots mean equal
texts. Two trees are compared from the root down: only sections whose digests differ are looked into,
and of these only paragraphs whose digests differ, so an edit is found in the branches that it touched.

Defined cases: a null text is an empty one; the fingerprint of an empty text has no leaf, and two
texts without leaves are alike (1.0) only if their roots are equal; documents with the same
doc_id follow each other by text; the document after the last is the first, and a lone document
follows itself; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 8
SPACE = r"[ \t\r\f]"
LEAVES = rf"{SPACE}*(?:[^ \t\r\f]+{SPACE}*){{1,{LEAF}}}|{SPACE}+"
SHORT = 8


def digests(text: Column) -> Column:
    """Digests of the leaves, by section and paragraph."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAVES), F.lit(0)), F.md5)
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), leaves))


def fingerprint(tree: Column) -> Column:
    """``root:tree`` of the digests of a text."""
    paragraph = lambda p: F.md5(F.array_join(p, ""))
    section = lambda s: F.md5(F.array_join(F.transform(s, paragraph), ""))
    root = F.sha2(F.array_join(F.transform(tree, section), ""), 256)
    short = lambda x: F.left(x, F.lit(SHORT))
    branch = lambda p: F.concat(F.lit("P"), short(paragraph(p)), F.array_join(F.transform(p, short), ""))
    whole = lambda s: F.concat(F.lit("S"), short(section(s)), F.array_join(F.transform(s, branch), ","))
    return F.concat_ws(":", root, F.array_join(F.transform(tree, whole), ";"))


def root_of(print_: Column) -> Column:
    return F.substring_index(print_, ":", 1)


def leaves_of(print_: Column) -> Column:
    """The distinct short digests of a fingerprint's leaves."""
    leaves = F.regexp_replace(F.substring_index(print_, ":", -1), rf"[SP][0-9a-f]{{{SHORT}}}", "")
    return F.array_distinct(F.regexp_extract_all(leaves, F.lit(rf"[0-9a-f]{{{SHORT}}}"), F.lit(0)))


def likeness(a: Column, b: Column, leaves_a: Column, leaves_b: Column) -> Column:
    """Of two fingerprints: the share of leaves that they have in common (Dice), 1 for equal roots."""
    both = F.size(leaves_a) + F.size(leaves_b)
    return F.when(root_of(a) == root_of(b), 1.0).when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(leaves_a, leaves_b)) / both)


def _unequal(a: Column, b: Column, mark: str, between: str) -> Column:
    """Children of two nodes, by place, whose own digests are not the same: place, and both branches (null where there is none)."""
    digest = lambda x: F.left(x, F.lit(1 + SHORT))
    children = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), between), lambda c: c.startswith(mark))
    pairs = F.transform(F.arrays_zip(children(a).alias("a"), children(b).alias("b")), lambda p, i: F.struct(i.alias("place"), p["a"].alias("a"), p["b"].alias("b")))
    return F.filter(pairs, lambda p: ~digest(p["a"]).eqNullSafe(digest(p["b"])))


def differing(a: Column, b: Column) -> Column:
    """Where two fingerprints differ, from the root down: (section, paragraph, leaves: places of the unequal leaves), from 0, of paragraphs that are not equal in place."""
    tree = lambda f: F.substring_index(f, ":", -1)
    inner = lambda x: F.substring(x, F.lit(2 + SHORT), F.length(x))
    cut = lambda x: F.regexp_extract_all(inner(F.coalesce(x, F.lit(""))), F.lit(rf"[0-9a-f]{{{SHORT}}}"), F.lit(0))
    places = lambda p: F.filter(F.transform(F.arrays_zip(cut(p["a"]).alias("a"), cut(p["b"]).alias("b")), lambda x, i: F.when(~x["a"].eqNullSafe(x["b"]), i)), lambda i: i.isNotNull())
    below = lambda s: F.transform(_unequal(inner(s["a"]), inner(s["b"]), "P", ","), lambda p: F.struct(s["place"].alias("section"), p["place"].alias("paragraph"), places(p).alias("leaves")))
    found = F.flatten(F.transform(_unequal(tree(a), tree(b), "S", ";"), below))
    return F.when(root_of(a) == root_of(b), F.slice(found, 1, 0)).otherwise(found)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """(section, paragraph) of :func:`differing`."""
    return F.transform(differing(a, b), lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph")))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text -> also next_text, the text after it in order of doc_id (after the last: the first).

    One shuffle of the texts, by ranges of doc_id; the head of each range, one row a range, is also
    sent to the end of the range before it, by that shuffle. Only numbers are broadcast, one row a range.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    text = F.coalesce("text", F.lit(""))
    cuts = docs.agg(F.percentile_approx(at, F.array(*(F.lit(k / n) for k in range(1, n))) if n > 1 else F.array(F.lit(0.5)), F.lit(max(1000, 10 * n)))).first()[0] or []
    in_range = places_below(sorted(set(cuts)), at)
    by_range = Window.orderBy("_range")  # one row for each of at most n ranges
    all_ranges = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = docs.groupBy(in_range.alias("_range")).agg(F.min(at).alias("_id"))
    first = first.select("_id", F.coalesce(F.lag("_range").over(by_range), F.max("_range").over(all_ranges)).alias("_range"))
    heads = docs.select(at.alias("_id"), text.alias("text")).join(F.broadcast(first), "_id").groupBy("_range").agg(F.min("text").alias("text"))

    rows = docs.select("doc_id", text.alias("text"), in_range.alias("_range"), F.lit(False).alias("_head"))
    rows = rows.unionByName(heads.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "_range", F.lit(True).alias("_head")))
    order = Window.partitionBy("_range").orderBy("_head", F.col("doc_id").asc_nulls_first(), "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).where(~F.col("_head")).select("doc_id", "text", "next_text")


def places_below(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are below the value: whole blocks of bounds first, then within the next block."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    longs = lambda b: F.array(*(F.lit(x).cast("long") for x in b)).cast("array<long>")
    below = lambda b: F.size(F.filter(b, lambda x: x < value))
    whole = below(longs(bounds[step - 1 :: step])) * step
    return whole + below(F.slice(longs(bounds), whole + 1, F.lit(step)))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; also to the next document's."""
    rows = with_next(docs)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    moved = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars as int) - cast(floor(n_chars / 4) as int))"), F.left(F.col("next_text"), moved)))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    for name in ("text", "edited", "next_text"):
        rows = rows.withColumn(f"{name}_print", digests(F.col(name))).withColumn(f"{name}_print", fingerprint(F.col(f"{name}_print")))
        rows = rows.withColumn(f"{name}_leaves", leaves_of(F.col(f"{name}_print")))
    near = lambda other: likeness(F.col("text_print"), F.col(f"{other}_print"), F.col("text_leaves"), F.col(f"{other}_leaves"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.col("text_print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        near("edited").alias("near_edited"), near("next_text").alias("near_next"),
    )
