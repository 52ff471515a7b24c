"""Phrase collocation mining by best-first branch-and-bound growth.

Everything is per language (null: `und`). Phrases of two and three words are scored by their lowest cut, floor(1000000 a^2 / (l r)),
and a phrase is dropped if a longer candidate that contains it has at least half its count.

*Growth.* Words are counted first, then the pairs of words that both occur `LEAST` times; a word alone bounds no score below the
largest, so this level is whole. A pair p = (w1, w2) is then a prefix to grow: a phrase that begins with it occurs f(p) times at
most, and its rest at least as often as itself, so its score is at most 1000000 f(p) / f(w1) and its count at most f(p). These
bounds (score, then count) order the frontier. The best `TOP` * `BATCH` prefixes of each language are grown, and for as many best
pairs the phrases around them are counted on both sides, which tells whether they are dropped. The score and count of the
TOP-th survivor found so far, a bar that can only rise, then excludes all prefixes and pairs below it; those not below, ties
included, are grown next. After that nothing outside can reach the bar. A language without that many survivors grows everything.
As each step reads the corpus once, the frontier is grown in these two steps and not prefix by prefix.

*Counting.* A task encodes the words of some megabytes of text by their exact dictionary, counts its phrases as numbers, and
emits each once with its count and text; the sums are one aggregate by language and text. Bit maps of fixed largest size tell
the task which words and pairs matter: false hits cost time, since sums and joins go by text. Counts are exact, in 64 bits;
products are decimals of 38 digits, enough for counts below 10^16.

Null and empty texts have no words. Documents that repeat count each time. Phrases of equal score and count rank by their bytes.
Other columns than lang and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oeuvre.llm import words as w
from oeuvre.llm.shared import bit_map, in_map, mapped, on_workers, staged

TOP = 2000
LEAST = 10
SHARE = 50
SCALE = 1_000_000

#: Of how many times `TOP` pairs the first step counts the phrases.
BATCH = 4

#: Bytes of text that a task counts at a time; it needs some 30 times as many.
PIECE = 1 << 20

UNKNOWN = "und"

# Characters between the words of a piece, and between pieces.
BLANKS = [0x20, 0x09]
STOPS = [0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]

IS_STOP = np.zeros(256, bool)
IS_STOP[STOPS] = True
IN_WORD = ~IS_STOP
IN_WORD[BLANKS] = False

COUNTS = "lang string, phrase string, n long"


def text_hashes(texts: pa.StringArray) -> np.ndarray:
    """64-bit hashes of texts, for the bit maps."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lengths = np.diff(at)
    out = np.zeros(len(texts), np.uint64)
    full = lengths > 0
    out[full] = w.run_hashes(raw[at[0] : at[-1]], (at[:-1] - at[0])[full], lengths[full])
    return out


def chained(*parts: np.ndarray) -> np.ndarray:
    """A hash of several hashes in their order."""
    h = np.zeros_like(parts[0])
    for p in parts:
        h = w.mixed(h * w.BASE + p + np.uint64(1))
    return h


class Tokens:
    """The words of some documents: code in `dictionary`, language, and whether the next word follows in the same piece."""

    def __init__(self, piece: w.Piece, langs: np.ndarray):
        data = w.LOWER[piece.data]
        inside = IN_WORD[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = piece.bounds[:-1][piece.bounds[:-1] < len(data)]
        first[edges] = inside[edges]
        starts = np.flatnonzero(first)
        sums = np.concatenate([[0], np.cumsum(inside)])
        lengths = sums[np.append(starts[1:], len(data))] - sums[starts]
        ends = np.concatenate([sums[starts], sums[-1:]])
        texts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside]))
        coded = texts.dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.dictionary = coded.dictionary
        document = np.searchsorted(piece.bounds, starts, "right") - 1
        self.langs = langs[piece.first : piece.last][document]
        stops = np.concatenate([[0], np.cumsum(IS_STOP[data])])
        self.follows = np.zeros(len(starts), bool)
        self.follows[:-1] = (document[1:] == document[:-1]) & (stops[starts[1:]] == stops[(starts + lengths)[:-1]])


def counted(table: pa.DictionaryArray, tokens: Tokens, at: np.ndarray, width: int) -> pa.RecordBatch:
    """The phrases of `width` words that begin at `at`, each with its count."""
    size = max(1, len(tokens.dictionary))
    key = tokens.langs[at] * size + tokens.codes[at]
    for k in range(1, width):
        _, key = np.unique(key, return_inverse=True)
        key = key * size + tokens.codes[at + k]
    _, where, n = np.unique(key, return_index=True, return_counts=True)
    one = at[where]
    parts = [tokens.dictionary.take(pa.array(tokens.codes[one + k])) for k in range(width)]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if width > 1 else parts[0]
    return pa.record_batch({"lang": table.take(pa.array(tokens.langs[one])).cast(pa.string()), "phrase": phrase.cast(pa.string()), "n": n.astype(np.int64)})


def tasked(chosen, width: int):
    """Counts the phrases whose first words `chosen(tokens, hashes of languages)` gives, in pieces of the texts of a batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("lang")
            column = (column.cast(pa.string()) if not pa.types.is_string(column.type) else column).dictionary_encode()
            langs, table = column.indices.to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary
            hashes = text_hashes(table)
            for piece in w.pieces(batch.column("text"), PIECE):
                tokens = Tokens(piece, langs)
                at = chosen(tokens, hashes)
                for first in range(0, len(at), 1 << 24):
                    yield counted(table, tokens, at[first : first + (1 << 24)], width)

    return task


def word_hashes(tokens: Tokens, langs: np.ndarray) -> np.ndarray:
    """A hash of language and word of each place."""
    return chained(langs[tokens.langs], text_hashes(tokens.dictionary)[tokens.codes])


def all_words(tokens: Tokens, langs: np.ndarray) -> np.ndarray:
    return np.arange(len(tokens.codes))


def pairs_of(frequent):
    """Places of the pairs of frequent words."""

    def chosen(tokens: Tokens, langs: np.ndarray) -> np.ndarray:
        ok = in_map(frequent.value, word_hashes(tokens, langs))
        return np.flatnonzero(ok[:-1] & ok[1:] & tokens.follows[:-1])

    return chosen


def triples_of(frequent, heads, both):
    """Places of three words whose pairs are frequent, the first one in `heads` or either one in `both`."""

    def chosen(tokens: Tokens, langs: np.ndarray) -> np.ndarray:
        h = word_hashes(tokens, langs)
        pair = chained(h[:-1], h[1:])
        ok = in_map(frequent.value, pair) & tokens.follows[:-1]
        at = np.flatnonzero(ok[:-1] & ok[1:])
        grown = in_map(heads.value, pair[at]) | in_map(both.value, pair[at]) | in_map(both.value, pair[at + 1])
        return at[grown]

    return chosen


def hashed(width: int):
    """The hashes that the tasks look up, from phrases."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = text_hashes(batch.column("lang"))
            parts = [chained(lang, text_hashes(batch.column(f"w{k + 1}"))) for k in range(width)]
            h = parts[0] if width == 1 else chained(*parts)
            yield pa.record_batch({"h": pa.array(h.view(np.int64))})

    return task


def known(phrases: DataFrame, width: int):
    """A bit map of phrases (lang, w1, ...), sent to the tasks."""
    columns = ["lang", *[f"w{k + 1}" for k in range(width)]]
    bits = bit_map(mapped(phrases.select(columns), hashed(width), "h long"), phrases.count())
    return phrases.sparkSession.sparkContext.broadcast(bits)


def counts(texts: DataFrame, chosen, width: int) -> DataFrame:
    """lang, phrase, n of the chosen phrases."""
    return mapped(texts, tasked(chosen, width), COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def word_of(k: int) -> Column:
    return F.split("phrase", " ")[k].alias(f"w{k + 1}")


def whole(c: str) -> Column:
    return F.col(c).cast("decimal(16,0)")


def scored(df: DataFrame, name: str, a: str, left: str, right: str) -> DataFrame:
    """The score of a cut, exact: the quotient of decimals, rounded down."""
    df = df.withColumn("_top", whole(a) * whole(a) * F.lit(SCALE).cast("decimal(7,0)")).withColumn("_under", whole(left) * whole(right))
    return df.withColumn(name, F.expr("_top div _under")).drop("_top", "_under")


def pairs_scored(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, w1, w2, a, l, r, score and bound of the frequent pairs."""
    pairs = pairs.select("lang", "phrase", F.col("n").alias("a"), word_of(0), word_of(1))
    for side, name in ((1, "l"), (2, "r")):
        pairs = pairs.join(words.select("lang", F.col("phrase").alias(f"w{side}"), F.col("n").alias(name)), ["lang", f"w{side}"])
    return scored(pairs, "score", "a", "l", "r").withColumn("bound", F.expr(f"({SCALE} * cast(a as decimal(16,0))) div l"))


def triples_scored(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score, and the pairs that it contains."""
    rows = triples.select("lang", "phrase", F.col("n").alias("a"), word_of(0), word_of(1), word_of(2))
    rows = rows.withColumn("head", F.concat_ws(" ", "w1", "w2")).withColumn("tail", F.concat_ws(" ", "w2", "w3"))
    rows = rows.join(pairs.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l2"), F.col("l").alias("l1")), ["lang", "head"])
    rows = rows.join(pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r1"), F.col("r").alias("r2")), ["lang", "tail"])
    rows = scored(scored(rows, "s1", "a", "l1", "r1"), "s2", "a", "l2", "r2")
    first = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return rows.select("lang", "phrase", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"), "head", "tail")


def best(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each language, and their rank; each task passes on n rows of a language at most."""
    by = Window.partitionBy("lang").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def not_below(score: str) -> Column:
    """Whether (score, a) reaches the bar of the language, if it has one."""
    return F.col("bar").isNull() | (F.col(score) > F.col("bar.score")) | ((F.col(score) == F.col("bar.score")) & (F.col("a") >= F.col("bar.a")))


def undropped(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """Pairs that no counted phrase of at least half their count contains."""
    inside = triples.select("lang", F.col("head").alias("phrase"), F.col("a").alias("more")).unionByName(triples.select("lang", F.col("tail").alias("phrase"), F.col("a").alias("more")))
    inside = inside.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    left = pairs.join(inside, ["lang", "phrase"], "left")
    return left.where(F.col("more").isNull() | (F.col("more") * 100 < F.col("a") * SHARE)).drop("more")


def mine(documents: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language."""
    spark = documents.sparkSession
    on_workers(spark)
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text"))
    each = staged(counts(texts, all_words, 1), "words")
    total = each.groupBy("lang").agg(F.sum("n").alias("n"))
    often = each.where(F.col("n") >= least)
    pairs = counts(texts, pairs_of(known(often.withColumnRenamed("phrase", "w1"), 1)), 2).where(F.col("n") >= least)
    pairs = staged(pairs_scored(staged(pairs, "pairs"), often), "pairs")
    frequent = known(pairs, 2)

    def grown(heads: DataFrame, both: DataFrame) -> DataFrame:
        found = counts(texts, triples_of(frequent, known(heads, 2), known(both, 2)), 3).where(F.col("n") >= least)
        return staged(triples_scored(staged(found, "triples"), pairs), "triples")

    columns = ["lang", "phrase", "a", "l", "r", "score"]
    down = lambda c: F.col(c).desc()
    heads = staged(best(pairs, BATCH * top, down("bound"), down("a"), F.col("phrase")).select("lang", "phrase", "w1", "w2"), "heads")
    tried = staged(best(pairs, BATCH * top, down("score"), down("a"), F.col("phrase")).drop("rank"), "tried")
    triples = grown(heads, tried)
    settled = undropped(tried, triples).select(columns).unionByName(triples.select(columns))
    bar = best(settled, top, down("score"), down("a")).where(F.col("rank") == top)
    bar = staged(bar.select("lang", F.struct("score", "a").alias("bar")), "bar")

    reach = pairs.join(bar, "lang", "left")
    more_heads = staged(reach.where(not_below("bound")).select("lang", "phrase", "w1", "w2").join(heads, ["lang", "phrase"], "left_anti"), "heads")
    more_tried = staged(reach.where(not_below("score")).drop("bar").join(tried.select("lang", "phrase"), ["lang", "phrase"], "left_anti"), "tried")
    if not (more_heads.isEmpty() and more_tried.isEmpty()):
        again = grown(more_heads, more_tried)
        triples = staged(triples.unionByName(again).dropDuplicates(["lang", "phrase"]), "triples")
        tried = tried.unionByName(more_tried.select(tried.columns))
    found = undropped(tried, triples).select(columns).unionByName(triples.select(columns))
    found = found.join(bar, "lang", "left").where(not_below("score")).drop("bar")
    found = best(found, top, down("score"), down("a"), F.col("phrase"))
    return found.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))
