"""Line dedup by a fixed-depth tree of line templates.

A line is cut into tokens, and a token with a digit is a variable field.  The tree has three levels: the number of tokens,
then the first ``DEPTH`` tokens; its leaves hold the lines that agree in these.  In a leaf, a token that stands at its place
in two documents or more is constant, all others are variable fields, and the line with its fields blanked is its
template, provided that constants make up at least ``SIMILAR`` of it.  The gate holds for every leaf, also for one whose lines are
all of one kind.  Where a template occurs in two documents or more,
its lines stay in the first of them (by doc_id) and are dropped from all others.

All of it is DataFrame work.  A document is known by its doc_id and a hash of its text; lines travel as hashes, and
texts only where a leaf is shared by documents.

Edge cases: lines of fewer than ``LEAST_TOKENS`` tokens are never dropped; a null text stays null and has no lines; a
text that loses all lines becomes empty; rows of one doc_id are one document, so that a repeated row drops nothing; null
doc_ids are one document, ordered last; columns of the input keep their values, but those that start with ``_`` and
``n_lines`` and ``n_dropped`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.vectors import let
from tracelake.llm.common import SPACE_CLASS
from tracelake.session import materialise

DEPTH, LEAST_TOKENS, SIMILAR = 3, 5, 0.75
FIELD = "<*>"
#: A token with a digit; tried only where a token starts, so that long tokens cost no more than their length.
_NUMBER = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
_NO_ID = (1 << 63) - 1
#: Bits of the bitmap of shared leaves.
BITS = 1 << 22


def _document_key() -> dict[str, Column]:
    """What tells a document, never null."""
    return {"_doc": F.coalesce("doc_id", F.lit(_NO_ID)).cast("long"), "_text": F.xxhash64("text")}


def _tokens_of(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1


def _evened(line: Column) -> Column:
    """The line with its tokens joined by single blanks; few lines need the regular expression."""
    odd = F.contains(line, F.lit("  "))
    for blank in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(blank))
    return F.btrim(F.when(odd, F.regexp_replace(line, f"[{SPACE_CLASS}]+", " ")).otherwise(line), F.lit(" "))


def _masked(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _NUMBER, FIELD)).otherwise(line)


def _steady(line: Column, n: Column) -> Column:
    """Whether tokens that are no field make up enough of a line; a line without a field costs no count."""
    fields = F.size(F.filter(F.split(line, " "), lambda t: t == FIELD))
    return F.when(F.contains(line, F.lit(FIELD)), n - fields >= SIMILAR * n).otherwise(True)


def _lines(docs: DataFrame, with_text: bool) -> DataFrame:
    """(_doc, _text, pos, leaf, kind, steady) and, if wanted, ``line`` of every line that is long enough, number fields blanked.

    The steps run inside the array of lines, so that each is done once for a line; as columns they would be repeated by
    every filter and key that uses them.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x, k: F.struct(k.alias("pos"), _evened(x).alias("line")))
    lines = F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), _tokens_of(x["line"]).alias("n")))
    lines = F.filter(lines, lambda x: x["n"] >= LEAST_TOKENS)
    lines = F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), _masked(x["line"]).alias("line"), x["n"].alias("n")))

    def keyed(x: Column) -> Column:
        leaf = F.xxhash64(x["n"], F.substring_index(x["line"], " ", DEPTH))
        fields = [x["pos"].alias("pos"), leaf.alias("leaf"), F.xxhash64(x["line"]).alias("kind"), _steady(x["line"], x["n"]).alias("steady")]
        return F.struct(*fields, *[x["line"].alias("line")] * with_text)

    return docs.select(*[c.alias(n) for n, c in _document_key().items()], F.inline(F.transform(lines, keyed)))


def _among(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """The lines whose leaf is among ``leaves``.

    A bitmap of the leaves' hashes goes ahead of the join, so that few other lines are shuffled.  It has at most
    ``BITS / 64`` rows, whatever the input, and so may be broadcast; the join decides.
    """
    bit = F.pmod("leaf", F.lit(BITS))
    places = {"_word": F.floor(bit / 64), "_bit": (bit % 64).cast("int")}
    words = leaves.withColumns(places).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    likely = lines.withColumns(places).join(F.broadcast(words), "_word").filter(F.getbit("_bits", F.col("_bit")) == 1)
    # Not a semi-join: that would be moved below the bitmap, to all lines.  ``leaves`` are distinct.
    return likely.drop("_word", "_bit", "_bits").join(leaves, "leaf")


def _recurring(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` with the first document, where there is more than one."""
    spans = rows.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return spans.filter(F.col("first") < F.col("last"))


def templates(docs: DataFrame, slim: DataFrame) -> DataFrame:
    """(leaf, kind, first): the lines whose template recurs, and the template's first document.

    ``slim`` has the leaf and kind of every line of ``docs``.
    """
    kinds = slim.groupBy("leaf", "kind").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last"), F.first("steady").alias("steady"))
    kinds = materialise(kinds)
    leaves = kinds.groupBy("leaf").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = materialise(leaves.filter((F.col("first") < F.col("last")) & (F.col("n") > 1)).select("leaf"))
    # A leaf of one kind is its own template, whose constants are all tokens but the number fields.
    alone = leaves.filter((F.col("first") < F.col("last")) & (F.col("n") == 1)).select("leaf")
    alone = kinds.filter("steady").join(alone, "leaf", "left_semi").select("leaf", "kind", "first")
    varied = materialise(
        _among(_lines(docs, with_text=True).select("leaf", "kind", "line", "_doc"), shared)
        .groupBy("leaf", "kind", "line").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last"))
    )
    each = varied.select("leaf", "kind", "first", "last", F.posexplode(F.split("line", " ")).alias("at", "token"))
    constant = _recurring(each.filter((F.col("at") >= DEPTH) & (F.col("token") != FIELD)), "leaf", "at", "token").select("leaf", "at", "token", F.lit(True).alias("constant"))
    told = each.join(constant, ["leaf", "at", "token"], "left")
    held = F.coalesce("constant", (F.col("at") < DEPTH) & (F.col("token") != FIELD))
    formed = told.groupBy("leaf", "kind", "first", "last").agg(
        F.sort_array(F.collect_list(F.when(held, F.struct("at", "token")))).alias("form"), F.count(F.lit(1)).alias("n")
    )
    formed = formed.filter(F.size("form") >= SIMILAR * F.col("n")).withColumn("template", F.xxhash64("leaf", "form"))
    formed = materialise(formed.select("leaf", "kind", "template", "first", "last"))
    several = formed.drop("first", "last").join(_recurring(formed, "template"), "template").select("leaf", "kind", "first")
    return alone.unionByName(several)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, and ``n_lines`` and ``n_dropped``."""
    slim = materialise(_lines(docs, with_text=False))
    found = templates(docs, slim)
    dropped = slim.join(found, ["leaf", "kind"]).filter(F.col("_doc") > F.col("first"))
    drops = dropped.groupBy("_doc", "_text").agg(F.collect_set("pos").alias("_drops"))  # no more than a text has lines
    rows = docs.withColumns(_document_key()).join(drops, ["_doc", "_text"], "left")
    all_lines = F.split("text", "\n", -1)

    def without_drops(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drops"))
        return F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")

    kept = let(all_lines, without_drops)
    return rows.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(all_lines)).cast("long"),
            "n_dropped": F.coalesce(F.size("_drops"), F.lit(0)).cast("long"),
            "text": F.when(F.col("_drops").isNull(), F.col("text")).otherwise(kept),
        }
    ).drop("_doc", "_text", "_drops").select(*docs.columns, "n_lines", "n_dropped")
