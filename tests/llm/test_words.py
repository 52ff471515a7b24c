"""Words, windows, bit maps, lookups and components against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oeuvre.llm import words as w
from oeuvre.llm.graph import components
from oeuvre.llm.shared import bit_map, in_map, lookup, vector_row, vector_sum

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\né Z", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40), st.integers(1, 4))
def test_words_and_windows(texts, size, width):
    column = pa.array(texts, pa.string())
    seen, windows, rows = {}, {}, 0
    for piece in w.pieces(column, size):
        own = w.words(piece)
        hashes, inside = w.window_hashes(own.hashes, width), w.window_starts(own.bounds, width)
        for i in range(piece.rows):
            a, b = own.bounds[i], own.bounds[i + 1]
            plain = (texts[piece.first + i] or "").encode().split()
            assert [piece.data[s:e].tobytes() for s, e in zip(own.starts[a:b], own.ends[a:b], strict=True)] == plain
            for word, h in zip(plain, own.hashes[a:b], strict=True):
                assert seen.setdefault(word, h) == h
            at = [k for k in range(a, b) if k < len(inside) and inside[k]]
            assert len(at) == max(0, len(plain) - width + 1)
            for k in at:
                assert windows.setdefault(tuple(plain[k - a : k - a + width]), hashes[k]) == hashes[k]
            rows += 1
    assert rows == len(texts)
    assert len(set(seen.values())) == len(seen) and len(set(windows.values())) == len(windows)


def test_sliced_and_large_columns():
    column = pa.array(["one", None, "two three", "four"])
    for own in (column.slice(1, 2), column.cast(pa.large_string()).slice(1, 2), column.cast(pa.binary()).slice(1, 2)):
        assert [w.words(p).counts().tolist() for p in w.pieces(own)] == [[0, 2]]
    assert list(w.pieces(pa.array([], pa.string()))) == []


def test_bit_map_and_vector_sum(spark):
    values = [x * 7919 for x in range(-500, 500)]
    bits = bit_map(spark.createDataFrame([(v,) for v in values], "h long"), len(values))
    assert in_map(bits, np.array(values, np.int64).view(np.uint64)).all()
    others = np.arange(10**9, 10**9 + 1000, dtype=np.int64).view(np.uint64)
    assert in_map(bits, others).mean() < 0.2
    assert not in_map(bit_map(spark.createDataFrame([], "h long"), 0), others).any()
    rows = [vector_row(np.array([k, 1])).to_pydict()["vector"][0] for k in range(10)]
    vectors = spark.createDataFrame([(bytearray(r),) for r in rows], "vector binary")
    assert vector_sum(vectors, 2).tolist() == [45, 10]
    assert vector_sum(vectors.limit(0), 2).tolist() == [0, 0]


def test_lookup_of_hot_and_null_keys(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(300)] + [("cold", 1), (None, 2), ("none", 3)], "key string, v long")
    found = spark.createDataFrame([("hot", 300, "a"), ("cold", 1, "b")], "key string, n_key long, x string")
    out = lookup(rows, found, "key", F.xxhash64("v"), rows.count())
    assert out.columns == ["key", "v", "x"]
    assert sorted((r["key"] or "-", r["x"] or "-") for r in out.collect()) == sorted([("hot", "a")] * 300 + [("cold", "b"), ("-", "-"), ("none", "-")])


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(20)] + [(5, 5)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in real}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
