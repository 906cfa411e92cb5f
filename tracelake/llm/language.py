"""Language identification by bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of the n-grams that are common in its learning texts.  All filters have the same size
and hash places and are stored sliced: one word of bits per place, bit k of which belongs to language k.  The AND of an
n-gram's words is the set of all languages that contain it.  A text's n-grams give one count per language; a filter with
false-positive rate p adds p of the n-grams that the language does not have, so the corrected share of a language is
(count / n - p) / (1 - p).  The largest corrected share decides; equal ones go to the more common language, then the
smaller name.

N-grams are runs of four code points of the lower-cased text in which everything but letters has become one space.

Edge cases: a null text or one without a letter is ``und`` with score 0; a text whose n-grams no language knows takes
the most common learned language with score 0; with nothing learned every text is ``und``; whole texts are used however
long; equal rows get equal results; input columns called score or lang_pred are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N = 4
#: Places of the filters (8 bytes a place for each 64 languages) and hash functions.
PLACES, HASHES = 1 << 20, 3
#: An n-gram belongs to a language if at least this share of its learning texts has it.
COMMON = 0.01
#: Learning texts of a language are a hash sample of about so many.
SAMPLE = 5_000
#: Code points that are turned to n-grams together.
PIECE = 1 << 18
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_LETTER = np.zeros(0x110000, bool)
_LETTER[[k for k in range(0x110000) if chr(k).isalpha()]] = True


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of others than letters as one space, with a space at both ends."""
    codes = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_LETTER[codes], codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams that have a letter, in pieces."""
    codes = _codes(text).astype(np.uint64)
    for start in range(0, max(1, len(codes) - N + 1), PIECE):
        piece = codes[start : start + PIECE + N - 1]
        if len(piece) < N:
            piece = np.concatenate([piece, np.full(N - len(piece), 32, np.uint64)])
        h = np.zeros(len(piece) - N + 1, np.uint64)
        for k in range(N):  # 21 bits hold a code point: exact up to three, mixed above
            h = (h ^ piece[k : k + len(h)]) * np.uint64(_MIX[0])
            h ^= h >> np.uint64(29)
        yield h


def places(h: np.ndarray) -> list[np.ndarray]:
    out = []
    for k in range(HASHES):
        x = (h ^ np.uint64(_MIX[(k + 1) % 3])) * np.uint64(_MIX[k])
        out.append(((x >> np.uint64(31)) & np.uint64(PLACES - 1)).astype(np.int64))
    return out


class Filters:
    """The sliced filters of the learned languages."""

    def __init__(self, languages: Sequence[str], slices: np.ndarray):
        self.languages, self.slices = list(languages), slices
        filled = [((slices[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.languages))]
        self.false_rate = np.array(filled) ** HASHES

    def shares(self, text: str) -> np.ndarray:
        """Corrected share of a text's n-grams in each language."""
        counts, n = np.zeros(len(self.languages), np.int64), 0
        for h in ngrams(text):
            at = places(h)
            n += len(h)
            for word, bits in enumerate(self.slices):
                sets = bits[at[0]]
                for p in at[1:]:
                    sets = sets & bits[p]
                for k in range(word * 64, min(len(self.languages), word * 64 + 64)):
                    counts[k] += np.count_nonzero(sets & np.uint64(1 << (k % 64)))
        return np.clip((counts / n - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0.0, 1.0)

    def judge(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        shares = self.shares(text)
        best = int(shares.argmax())
        return self.languages[best], float(shares[best])


def learn(docs: DataFrame) -> Filters:
    """Filters from ``text`` and non-null ``lang``.

    Learning texts of a language are a sample of about ``SAMPLE``, drawn by hash of text and doc_id, so that copies are
    drawn one by one; only n-gram counts are shuffled.  Each task counts n-grams by language before that; a language's
    common n-grams number at most the mean per text over ``COMMON``.  Only the finished slices, of fixed size, reach the
    driver.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()  # a row per language
    if not sizes:
        return Filters([], np.zeros((1, PLACES), np.uint64))
    number = {r["lang"]: k for k, r in enumerate(sizes)}
    spark = docs.sparkSession
    rates = F.create_map(*chain.from_iterable((F.lit(r["lang"]), F.struct(F.lit(k).alias("k"), F.lit(min(1.0, SAMPLE / r["n"])).alias("rate"))) for k, r in enumerate(sizes)))
    draw = F.pmod(F.xxhash64(*[c for c in ("text", "doc_id") if c in docs.columns]), F.lit(1 << 30)) / float(1 << 30)
    # The map is a literal, so texts that are not drawn go before anything is shuffled.
    sample = rows.withColumn("_of", rates[F.col("lang")]).filter(draw < F.col("_of.rate")).select(F.col("_of.k").alias("k"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_language: dict[int, list[np.ndarray]] = {}
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text")):
                by_language.setdefault(k, []).append(np.unique(np.concatenate(list(ngrams(text.as_py())))))
            for k, found in by_language.items():
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                columns = [pa.array(np.full(len(grams), k, np.int32)), pa.array(grams.view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["k", "gram", "n"])

    counted = sample.mapInArrow(count, "k int, gram long, n long")
    grams = counted.groupBy("k", "gram").agg(F.sum("n").alias("n"))
    learned = {r["lang"]: r["n"] * min(1.0, SAMPLE / r["n"]) for r in sizes}
    floor = spark.createDataFrame([(number[lang], max(1.0 if n < 20 else 2.0, COMMON * n)) for lang, n in learned.items()], "k int, floor double")
    common = grams.join(floor, "k").filter(F.col("n") >= F.col("floor")).select("k", "gram")

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_numpy()
            bit = (np.uint64(1) << (k % 64).astype(np.uint64)).view(np.int64)
            for at in places(batch.column("gram").to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(k // 64), pa.array(at), pa.array(bit)], ["word", "place", "bits"])

    merged = common.mapInArrow(sliced, "word int, place long, bits long").groupBy("word", "place").agg(F.bit_or("bits").alias("bits")).toArrow()
    slices = np.zeros(((len(sizes) + 63) // 64, PLACES), np.uint64)
    slices[merged["word"].to_numpy(), merged["place"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return Filters([r["lang"] for r in sizes], slices)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the winner's corrected share."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [shared.value.judge(t.as_py()) for t in batch.column("text")]
            found = [pa.array([x for x, _ in judged], pa.string()), pa.array([s for _, s in judged], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, "lang_pred", "score"])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *fields]))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def language_digest(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and judges all."""
    filters = learn(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, filters).drop("text")


#: A document is rejected if its language is undetermined or less than this share of its n-grams is known to the winner.
LEAST_SHARE = 0.3


def known_language(docs: DataFrame) -> DataFrame:
    """The rows, as they are, of documents whose language is determined; others go."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs.filter(~held_out()).select("doc_id", "text", "lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = (shared.value.judge(t.as_py()) for t in batch.column("text"))
            yield batch.filter(pa.array([lang != "und" and share >= LEAST_SHARE for lang, share in judged], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
