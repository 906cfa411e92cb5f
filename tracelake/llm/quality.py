"""Quality rules with risk-controlled thresholds.

A document has five measurements, each the larger the worse.  Labelled documents of good quality show how many good ones
a cutoff would reject.  In each stratum (a language) and for each measurement, cutoffs of a fixed ladder are tested from
the most lenient to the strictest: a cutoff passes if the exact binomial bound says that its false-rejection rate is at
most ``RISK / measurements`` with error at most ``DELTA / (strata * measurements)``; testing stops at the first that
fails, so the ladder itself costs no correction.  With probability 1 - DELTA, in every stratum at most ``RISK`` of the
good documents are rejected by all rules together.  All cutoffs that pass are safe at once; the one that best tells the
labelled poor from the good is used; without one the rule rejects nothing.

Edge cases: a null or word-less text has zero counts and fails the base rules; a null language is a stratum; a label
that is null or not of a known document is not used; documents that are labelled twice count once for each label;
without labels nothing is rejected beyond the base rules; repeated rows get equal verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import SPACE_CLASS, null_safe
from tracelake.session import materialise

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
RISK, DELTA = 0.1, 0.1
#: Among safe cutoffs, a rejected good document weighs as so many poor ones that stay.
REGRET = 10.0
#: Steps of every measurement's ladder: cutoffs at k / STEPS of its scale.
STEPS = 200
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Bytes of text measured together.
GROUP_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def _measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of each text; words are told apart exactly, windows by a 64-bit mix of their words' numbers."""
    n = len(texts)
    words = pc.ascii_split_whitespace(texts)
    rows, flat = np.asarray(pc.list_parent_indices(words)), pc.list_flatten(words)
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0), bool)
    rows, flat = rows[filled], flat.filter(pa.array(filled))
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": _per_row(np.asarray(pc.utf8_length(flat)), rows, n)}
    out["n_symbols"] = np.asarray(pc.count_substring_regex(texts, r"[#*$%&|<>]")).astype(np.int64)

    lines = pc.split_pattern(texts, "\n")
    line_rows, line = np.asarray(pc.list_parent_indices(lines)), pc.list_flatten(lines)
    worded = np.asarray(pc.match_substring_regex(line, f"[^{SPACE_CLASS}]"), bool)
    line_rows, line = line_rows[worded], line.filter(pa.array(worded))
    numbers = np.asarray(line.dictionary_encode().indices).astype(np.int64)
    distinct = np.unique(line_rows.astype(np.int64) * (len(line) + 1) + numbers)
    out["n_dup_lines"] = np.bincount(line_rows, minlength=n) - np.bincount(distinct // (len(line) + 1), minlength=n)

    ids = np.asarray(flat.dictionary_encode().indices).astype(np.uint64)
    covered = np.zeros(len(ids), bool)
    if len(ids) >= WINDOW:
        last = len(ids) - WINDOW + 1
        mixed = _scramble(rows[:last].astype(np.uint64) + _ODD)
        for k in range(WINDOW):
            mixed = _scramble(mixed + ids[k : k + last] * _ODD + np.uint64(k))
        whole = rows[:last] == rows[WINDOW - 1 :]
        starts = np.nonzero(whole)[0]
        order = np.argsort(mixed[starts], kind="stable")
        ordered = mixed[starts][order]
        same = np.zeros(len(ordered), bool)
        same[1:] = ordered[1:] == ordered[:-1]
        same[:-1] |= ordered[:-1] == ordered[1:]
        repeated = starts[order[same]]
        for k in range(WINDOW):
            covered[repeated + k] = True
    out["n_repeat_words"] = _per_row(covered, rows, n)
    return out


def _groups(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``GROUP_BYTES``; a longer text is a slice of its own."""
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + GROUP_BYTES, "right"))
        end = max(end, start + 1)
        yield texts.slice(start, end - start)
        start = end


def with_counts(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` and the counts of every whole text."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            done = [_measure(g) for g in _groups(texts)]
            counts = [pa.array(np.concatenate([d[c] for d in done]) if done else np.zeros(0), pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *counts], [*names, *COUNTS])

    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def measurements() -> dict[str, Column]:
    """Measurements from 0 (best) to 1, as steps of the ladder: a document is at step s if it is over every cutoff below s."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    length = F.col("word_chars") / words
    share = {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") * 10 / words,
        "repeats": F.col("n_repeat_words") / words,
        "long_words": (length - 3) / 17,
        "short_words": (6 - length) / 6,
    }
    return {k: F.ceil(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * STEPS).cast("int") for k, v in share.items()}


def most_rejected(n: int, rate: float, delta: float) -> int:
    """Largest k for which at most ``delta`` of the draws of Binomial(n, rate) are k or fewer; -1 if there is none.

    k rejections among n then bound the rejection rate by ``rate`` (the exact one-sided bound).  Sums start where terms
    are too small to matter, so the work grows with the square root of n.
    """
    spread = math.sqrt(n * rate * (1 - rate))
    k = max(0, int(n * rate - 40 * spread - 40))
    total = 0.0
    while k <= n:
        term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
        total += math.exp(term)
        if total > delta:
            return k - 1
        k += 1
    return n


def thresholds(counted: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """``stratum``, ``measure`` and ``cutoff``: the step above which documents are rejected.

    ``counted`` has the counts, doc_id and the stratum of all documents; ``labels`` doc_id and quality, 1 or 0.  Documents
    that fail the base rules are out of it.  All
    cutoffs that pass hold the risk together; of them the one is taken that rejects the most of the poor less that of
    ``REGRET`` times the good, each as a share, and of equal ones the most lenient.  A group has at most a row for each step.
    """
    labelled = counted.filter(~base_failed()).join(labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality"), "doc_id")
    steps = measurements()
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), s.alias("step")) for m, s in steps.items()]))
    ladder = materialise(
        labelled.select(stratum, "quality", entries.alias("_e"))
        .groupBy(stratum, "_e.measure", "_e.step")
        .agg(F.sum("quality").cast("long").alias("good"), F.sum(1 - F.col("quality")).cast("long").alias("poor"))
    )
    strata = max(1, ladder.select(stratum).distinct().count())
    rate, delta = RISK / len(steps), DELTA / (strata * len(steps))
    schema = T.StructType([ladder.schema[stratum], T.StructField("measure", T.StringType()), T.StructField("cutoff", T.IntegerType())])

    def over(pdf: pd.DataFrame, column: str) -> np.ndarray:
        """How many are rejected by each cutoff: those at a higher step."""
        at = np.zeros(STEPS + 1, np.int64)
        at[pdf["step"].to_numpy()] = pdf[column].to_numpy()
        return at.sum() - np.cumsum(at)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        good, poor = over(pdf, "good"), over(pdf, "poor")
        n_good, n_poor = int(pdf["good"].sum()), int(pdf["poor"].sum())
        passing = good <= most_rejected(n_good, rate, delta)  # stricter cutoffs reject more: the rest fail from some step down
        gain = np.where(passing, poor / max(n_poor, 1) - REGRET * good / max(n_good, 1), -1.0)
        cutoff = STEPS - int(gain[::-1].argmax())
        found = [cutoff] if gain[cutoff] > 0 else []
        one = pdf.head(len(found))
        return pd.DataFrame({stratum: one[stratum], "measure": one["measure"], "cutoff": pd.array(found, "int32")})

    return ladder.groupBy(stratum, "measure").applyInPandas(choose, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdicts of all documents, with the measurement steps that broke a cutoff."""
    counted = materialise(with_counts(docs, ["doc_id", "lang"]))
    chosen = thresholds(counted, labels)
    by_stratum = chosen.groupBy("lang").agg(*[F.min(F.when(F.col("measure") == m, F.col("cutoff"))).alias(f"_{m}") for m in measurements()])
    judged = null_safe(counted, materialise(by_stratum), ["lang"], "left")
    broken = [F.when(s > F.col(f"_{m}"), F.lit(m)) for m, s in measurements().items()]
    return judged.select(
        "doc_id",
        *COUNTS,
        base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(*broken).isNull()).alias("kept"),
        F.coalesce(*broken).alias("rule"),
    )
