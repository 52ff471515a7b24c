"""Benchmark decontamination by templates: copies of benchmark items, also with other numbers, names and units.

A text becomes template tokens: words of folded case (all of Unicode), with typed placeholders for numbers (digits or number words), names
(capitalised within a sentence) and units after a number; a run of numbers or of names is one placeholder. A second, case-blind
template has no names, so that passages whose case was changed match too; each template is matched with its like only. Windows of
`WIDTH` tokens of the items are hash-joined with those of the documents. Matches are then grouped by document, item and
distance between their places. A group is a leak if it has `LEAST` windows, or all of the item, and its slots are consistent:
an item's value stands for one value in the document, and no other item value for the same, in at least `AGREE` of the values.
What is returned of a pair comes from the template with names, if that finds it.

An item shorter than a window is one window, of its own length. With `inside`, documents are cut into windows of these lengths too
(at most `WIDTH` - 1 of them), so that short items are found anywhere; without it only an equally short document equals one. The
query and the pipeline look inside. Windows with fewer than `LITERAL` words (or than all of a shorter window) match too much and
aren't used; an item that has no other is matched by its literal tokens, numbers and units as they are, and has to be there in whole.
A short item, be it one word, leaks into every document with these words.

Documents first meet a bit map of the items' windows, of bounded size, so only possible matches are shuffled. Null and empty texts
have no window. Rows that repeat give one result a doc_id and item; null ids are kept. Other columns than doc_id, item_id, text
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oeuvre.llm import words as w
from oeuvre.llm.shared import bit_map, in_map, mapped, packed, signed, staged

WIDTH = 8
LITERAL = 4
LEAST = 6
AGREE = 0.5

# Words for numbers, and units.
NUMBERS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half""".split()
UNITS = """mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds
ounce ounces oz ton tons ml l liter liters litre litres gallon gallons second seconds s minute minutes min hour hours h day days
week weeks month months year years dollar dollars usd euro euros eur cent cents percent degree degrees meter meters metre metres
kilometer kilometers kilometre kilometres centimeter centimeters hz khz mhz ghz kb mb gb tb w kw v volt volts watt watts""".split()

WORD, NUMBER, NAME, UNIT = range(4)
SLOTS = w.mixed(np.arange(1, 4, dtype=np.uint64))

# The kinds of templates. Their hashes differ by a salt.
NAMED, BLIND, LITERALLY = range(3)
SALTS = np.array([0, 0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F], np.uint64)

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".!?\n"]] = True
JOINS = np.zeros(256, bool)
JOINS[[ord(c) for c in ".,"]] = True


def hashes_of(names: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(names).encode(), np.uint8)
    sizes = np.array([len(n) for n in names])
    return np.sort(w.run_hashes(data, np.cumsum(sizes) - sizes, sizes))


NUMBER_HASHES = hashes_of(NUMBERS)
UNIT_HASHES = hashes_of(UNITS)


@dataclass
class Template:
    """Template tokens of a piece: hash, whether a placeholder, the value it stands for, where documents begin."""

    hashes: np.ndarray
    slot: np.ndarray
    values: np.ndarray
    bounds: np.ndarray


def folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The hashes of words, folded by all of Unicode; `values` are those with A-Z folded. A word and its upper case fold alike."""
    sums = np.concatenate([[0], np.cumsum(data >= 0x80)])
    wide = np.flatnonzero(sums[ends] > sums[starts])
    if not len(wide):
        return values
    _, first, again = np.unique(values[wide], return_index=True, return_inverse=True)
    raw = data.tobytes()
    texts = b"\n".join([raw[a:b] for a, b in zip(starts[wide[first]].tolist(), ends[wide[first]].tolist(), strict=True)])
    texts = texts.decode("utf-8", "surrogateescape").upper().casefold().encode("utf-8", "surrogateescape").split(b"\n")
    sizes = np.array([len(t) for t in texts])
    out = values.copy()
    out[wide] = w.run_hashes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)[again]
    return out


@dataclass
class Tokens:
    """Words and numbers of a piece: hash, type, whether first of a document or of a sentence, where documents begin."""

    values: np.ndarray
    types: np.ndarray
    opens: np.ndarray
    new_sentence: np.ndarray
    bounds: np.ndarray


def tokens(piece: w.Piece) -> Tokens:
    data, edges = piece.data, piece.bounds[:-1][piece.bounds[:-1] < len(piece.data)]
    digit = DIGIT[data]
    if len(data) > 2:
        between = JOINS[data[1:-1]] & digit[:-2] & digit[2:]
        kind = LETTER[data] + 2 * digit
        kind[1:-1][between] = 2
    else:
        kind = LETTER[data] + 2 * digit
    first = kind > 0
    first[1:] &= kind[1:] != kind[:-1]
    first[edges] = kind[edges] > 0
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, piece.bounds)
    if not len(starts):
        return Tokens(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool), bounds)
    inside = kind > 0
    sums = np.concatenate([[0], np.cumsum(inside)])
    lengths = sums[np.append(starts[1:], len(data))] - sums[starts]
    ends = starts + lengths
    values = folded(data, starts, ends, w.run_hashes(w.LOWER[data[inside]], sums[starts], lengths))

    opens = np.zeros(len(starts), bool)
    opens[bounds[:-1][bounds[:-1] < len(starts)]] = True
    stops = np.concatenate([[0], np.cumsum(BREAKS[data])])
    new_sentence = opens.copy()
    new_sentence[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    latin = (data[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    after = data[np.minimum(starts + 1 + latin, len(data) - 1)]
    then = data[np.minimum(starts + 2 + latin, len(data) - 1)]
    small = LETTER[after] & ~UPPER[after] & ~((after == 0xC3) & (then >= 0x80) & (then <= 0x9E)) & (lengths > 1 + latin)
    number = (kind[starts] == 2) | np.isin(values, NUMBER_HASHES)
    unit = np.isin(values, UNIT_HASHES) & ~opens & ~number
    unit[1:] &= number[:-1]
    unit[:1] = False
    name = (UPPER[data[starts]] | latin) & small & ~new_sentence & ~number & ~unit & (kind[starts] == 1)
    types = np.select([number, name, unit], [NUMBER, NAME, UNIT], WORD)
    return Tokens(values, types, opens, new_sentence, bounds)


def template(piece: w.Piece, kind: int = NAMED) -> Template:
    return of_kind(tokens(piece), kind)


def of_kind(text: Tokens, kind: int) -> Template:
    values, opens, new_sentence, bounds = text.values, text.opens, text.new_sentence, text.bounds
    if kind == LITERALLY:
        return Template(values, np.zeros(len(values), bool), values, bounds)
    types = np.where(text.types == NAME, WORD, text.types) if kind == BLIND else text.types
    if not len(values):
        return Template(values, np.zeros(0, bool), values, bounds)
    keep = np.ones(len(values), bool)
    keep[1:] = ~((types[1:] == types[:-1]) & np.isin(types[1:], [NUMBER, NAME]) & ~opens[1:] & ~new_sentence[1:])
    at = np.flatnonzero(keep)
    turn = np.arange(len(values)) - np.repeat(at, np.diff(np.append(at, len(values))))
    runs = w.mixed(np.add.reduceat(values * w.powers(w.STEP, int(turn.max()) + 1)[turn], at))
    kinds = types[at]
    hashes = np.where(kinds == WORD, values[at], SLOTS[np.maximum(kinds, 1) - 1])
    return Template(hashes, kinds != WORD, runs, np.searchsorted(at, bounds))


def windows(text: Template, width: int, inside: list[int] | None = None, least: int = LITERAL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first token and number of tokens of the windows. Short documents are one window, unless the lengths of
    short windows are given by `inside`; of equal ones without a slot the first of a document is taken."""
    literal = np.concatenate([[0], np.cumsum(~text.slot)])
    found, places, sizes = [], [], []
    n = np.diff(text.bounds)
    for size in range(width, 0, -1):
        if size == width or size in (inside or []):
            at = np.flatnonzero(w.window_starts(text.bounds, size))
        elif inside is None:
            at = text.bounds[:-1][n == size]
        else:
            continue
        words = literal[at + size] - literal[at]
        at, words = at[words >= min(least, size)], words[words >= min(least, size)]
        h = w.window_hashes(text.hashes, size)[at]
        if size < width:
            h = h + np.uint64(size)
        if size < width and inside:
            own = np.searchsorted(text.bounds, at, "right") - 1
            order = np.lexsort([at, h, own])
            again = np.zeros(len(at), bool)
            again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
            first = ~(again & (words == size))
            at, h = at[first], h[first]
        found.append(h)
        places.append(at)
        sizes.append(np.full(len(at), size))
    return np.concatenate(found), np.concatenate(places), np.concatenate(sizes)


FIELDS = "kind byte, size int, h long, at int, n int, slots array<long>"


def matched(known, width: int, lengths: dict[int, list[int] | None]):
    """The windows of each row that may be an item's, with the values of their slots. `known`: a bit map, or none for the items.
    `lengths`: for each kind the lengths of short windows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in w.pieces(batch.column("text")):
                words = tokens(piece)
                usable = np.zeros(piece.rows, bool)
                for kind, inside in sorted(lengths.items()):
                    text = of_kind(words, kind)
                    h, at, size = windows(text, width, inside, 0 if kind == LITERALLY else LITERAL)
                    h = h ^ SALTS[kind]
                    own = np.searchsorted(text.bounds, at, "right") - 1
                    total = np.bincount(own, minlength=piece.rows)[own]
                    hit = in_map(known.value, h) if known else np.ones(len(h), bool)
                    if kind == LITERALLY and not known:
                        hit = ~usable[own]
                    usable[own] = True
                    h, at, size, own, total = (x[hit] for x in (h, at, size, own, total))
                    slots = [text.values[a : a + n][text.slot[a : a + n]].view(np.int64) for a, n in zip(at, size, strict=True)]
                    ids = batch.column(0).take(pa.array(own + piece.first))
                    row = batch.column(1).take(pa.array(own + piece.first))
                    places = pa.array((at - text.bounds[own]).astype(np.int32))
                    kinds, tall = pa.array(np.full(len(h), kind, np.int8)), pa.array(size.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([ids, row, kinds, tall, signed(h), places, pa.array(total.astype(np.int32)), pa.array(slots, pa.list_(pa.int64()))], ["id", "row", "kind", "size", "h", "at", "n", "slots"])

    return task


def window_rows(texts: DataFrame, key: str, lengths: dict[int, list[int] | None], known=None, width: int = WIDTH) -> DataFrame:
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(key, F.xxhash64(key, "text").alias("row"), "text")
    return mapped(rows, matched(known, width, lengths), f"id {kind}, row long, {FIELDS}")


def leaks(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, inside: bool = False) -> DataFrame:
    """A row for each document and item that leaked into it: doc_id, row (hash of id and text), item_id, windows (matched),
    item_windows, slots (values compared), consistent (the share of them). `inside`: look for short items in longer documents."""
    spark = documents.sparkSession
    items = window_rows(benchmark, "item_id", dict.fromkeys((NAMED, BLIND, LITERALLY)), None, width)
    items = staged(items.dropDuplicates(["id", "row", "kind", "at"]), "items")
    lengths: dict[int, list[int] | None] = {}
    for r in items.select("kind", "size").distinct().collect():
        lengths.setdefault(r["kind"], []).extend([r["size"]] if r["size"] < width else [])
    if not inside:
        lengths = dict.fromkeys(lengths)
    distinct = items.select("h").distinct()
    known = spark.sparkContext.broadcast(bit_map(distinct, distinct.count()))
    hits = staged(window_rows(documents, "doc_id", lengths, known, width).drop("kind", "size"), "hits")
    theirs = items.select(F.col("id").alias("item_id"), F.col("row").alias("item"), "kind", "h", F.col("at").alias("item_at"), F.col("n").alias("item_windows"), F.col("slots").alias("item_slots"))
    pairs = hits.withColumnRenamed("id", "doc_id").join(theirs, "h").withColumn("shift", F.col("at") - F.col("item_at"))
    group = ["row", "item", "kind", "shift"]
    by = ["doc_id", "item_id", *group]
    groups = pairs.groupBy(*by).agg(F.count_distinct("item_at").alias("windows"), F.max("item_windows").alias("item_windows"))
    enough = F.when(F.col("kind") == LITERALLY, F.col("item_windows")).otherwise(F.least(F.lit(LEAST), "item_windows"))
    groups = staged(groups.where(F.col("windows") >= enough), "groups")
    kept = pairs.where(F.size("slots") > 0).select(*group, F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    kept = kept.select(*group, F.col("s.item_slots").alias("a"), F.col("s.slots").alias("b")).distinct()
    kept = kept.join(groups.select(*group).distinct(), group, "left_semi")
    ours = kept.groupBy(*group, "b").agg(F.count("*").alias("nb"))
    values = kept.join(ours, [*group, "b"]).groupBy(*group, "a")
    values = values.agg(((F.count("*") == 1) & (F.max("nb") == 1)).cast("int").alias("fits"))
    values = values.groupBy(*group).agg(F.count("*").alias("slots"), F.avg("fits").alias("consistent"))
    out = groups.join(values, group, "left").na.fill({"slots": 0, "consistent": 1.0})
    first = F.struct((-F.col("kind")).alias("order"), "windows", "consistent", "item_windows", "slots")
    best = out.where(F.col("consistent") >= AGREE).groupBy("doc_id", "row", "item_id").agg(F.max(first).alias("x"))
    return best.select("doc_id", "row", "item_id", "x.windows", F.col("x.item_windows").cast("long").alias("item_windows"), "x.slots", "x.consistent")


def without_leaks(documents: DataFrame, benchmark: DataFrame, inside: bool = False) -> DataFrame:
    """The documents that no item leaked into."""
    found = staged(leaks(documents, benchmark, inside=inside).select(F.col("row").alias("_row")).distinct(), "leaks")
    return packed(documents, _row=F.xxhash64("doc_id", "text")).join(found, "_row", "left_anti").select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), inside=True)
    return found.drop("row").groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("item_windows").alias("item_windows"), F.max("slots").alias("slots"), F.max("consistent").alias("consistent"))
