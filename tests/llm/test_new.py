"""Faults found by review. Nearest neighbours, phrases and the conversation trie against plain versions; nulls, ties, repeats, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from oeuvre.llm import jaccard, language, licences, nearest, phrases, secrets, substring, trie, vectors

VECTORS = "vec_id long, embedding array<float>, label int, row string, rid string, dim string"


def plain_nearest(rows, k):
    ok = [(i, v) for i, v in rows if v and all(x is not None and abs(x) < float("inf") for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i is None or i % 20:
            continue
        found = []
        for b, (j, u) in enumerate(ok):
            if a != b and len(u) == len(v):
                score = 0.0
                for x, y in zip(v, u, strict=True):
                    score += x * y
                found.append((-score, j is None, j or 0, b))
        found.sort()
        out += [(i, n + 1, None if x[1] else x[2], -x[0]) for n, x in enumerate(found[:k])]
    return sorted(out, key=repr)


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CANDIDATES", 7)
    monkeypatch.setattr(nearest, "QUERIES", 3)
    monkeypatch.setattr(nearest, "FAN", 2)
    rng = random.Random(5)
    draw = lambda n: [float(rng.randint(-8, 8)) / 4 for _ in range(n)]
    rows = [(i, draw(6)) for i in range(90)]
    rows += [(i, rows[0][1]) for i in range(100, 160)]
    rows += [(200, draw(3)), (201, draw(3)), (220, [1.0]), (20, draw(6)), (None, draw(6))]
    rows += [(240, None), (260, []), (280, [0.0] * 6), (300, [float("nan")] * 6), (320, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(321, [float("inf")] * 6), (322, draw(6))]
    df = spark.createDataFrame([(i, v, None, "x", "y", "z") for i, v in rows], VECTORS)
    found = sorted((tuple(r) for r in nearest.nearest(df, k=5).collect()), key=repr)
    assert found == plain_nearest(rows, 5)
    assert nearest.nearest(df.limit(0)).collect() == []


def plain_phrases(documents, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in documents:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            own = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(own)
            for k in (1, 2, 3):
                for i in range(len(own) - k + 1):
                    f[lang or "und"][tuple(own[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= 10}
        more = Counter()
        for p, a in candidates.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    more[q] = max(more[q], a)
        rows = []
        for p, a in candidates.items():
            if 100 * more[p] >= 50 * a:
                continue
            cuts = [(1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("top", [3, 12, 2000])
@pytest.mark.parametrize("batch", [1, 4])
def test_phrases(documents, monkeypatch, top, batch):
    monkeypatch.setattr(phrases, "BATCH", batch)
    monkeypatch.setattr(phrases, "PIECE", 512)
    rng = random.Random(top)
    some = ["a", "B", "ç", "d e", "É", "f'"]
    rows = []
    for i in range(60):
        words = rng.choices(some, weights=[9, 7, 5, 3, 2, 1], k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\r\n", "\x0b"]) for w in words)
        rows.append((i, text, rng.choice(["en", "de", None])))
    rows += [(100, None, "en"), (101, "", "en"), (102, " . ! ", "fr"), (103, "x y " * 20000, "fr"), (7, "tie tie", "xx")]
    rows += [(i, "same words here", "it") for i in range(10)]
    found = sorted(tuple(r) for r in phrases.mine(documents(rows), top=top).collect())
    assert found == plain_phrases([(t, lang) for _, t, lang in rows], top)
    assert phrases.mine(documents(rows).where(F.lit(False))).collect() == []


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    full = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = turns.get(c - c % 20, [])[:h] + v[h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                children[tuple(v[: d - 1])].add(tuple(v[:d]))
        ends[tuple(v)].append(c)
    leaves, saved = Counter(), Counter()
    for node in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * words
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    out = []
    for node, m in members.items():
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), len(children[node]), leaves[node], saved[node], sha(ends[node])))
    return sorted(out, key=repr)


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("id", "parent", "place", "n", "pos", "t", "position", "depth"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def test_trie(spark):
    rng = random.Random(9)
    rows = []
    for c in [*range(130), 20_000_000_001, 400]:
        texts = [rng.choice(["yes", "no", "a b c d", "", None]) for _ in range(rng.choice([1, 2, 3, 6]))]
        rows += [(c, i if i else None, rng.choice(["user", None]) if i > 2 else "user", t) for i, t in enumerate(texts)]
    rows += [(60, i, "user", f"turn {i % 3}") for i in range(1, 150)] + [(61, i, "user", f"turn {i % 3}") for i in range(1, 190)]
    rows += [(None, 1, "user", "nobody"), (500, 1, None, "x " * 30000)]
    rng.shuffle(rows)
    rows = [r for i, r in enumerate(rows) if (r[0], r[1]) not in {(x[0], x[1]) for x in rows[:i]}]
    df = conversations(spark, rows)
    assert sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=repr) == plain_trie(rows)


def test_trie_without_turns(spark):
    """Conversations whose turns are all replaced by those of an absent first one end at the root; ties of a turn are ordered."""
    alone = [c for c in range(21, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3]
    rows = [(c, 1, "user", "x") for c in alone]
    assert sorted((tuple(r) for r in trie.prefix_trie(conversations(spark, rows)).collect()), key=repr) == plain_trie(rows)
    again = [(0, 1, "user", t) for t in ("b", "a", "a")] + [(20, 1, "user", t) for t in ("a", "b", "a")]
    found = trie.prefix_trie(conversations(spark, again))
    assert [r["n_convs"] for r in found.where("depth > 0").collect()] in ([2, 2, 2], [2] * 3)
    assert trie.prefix_trie(found.sparkSession.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def self_similar(n):
    """Two words of 2 ** n letters that have equal sums of powers modulo 2 ** 64, for every odd base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_self_similar_words_differ(documents):
    one, two = self_similar(11)
    common = " ".join(f"w{i}" for i in range(34))
    docs = documents([(1, f"{common} {one}"), (2, f"{common} {two}")])
    assert [r["n_removed"] for r in substring.remove_repeats(docs).collect()] == [0, 0]
    docs = documents([(1, f"a b c d {one}"), (2, f"a b c d {two}")])
    assert sorted(r["component_id"] for r in jaccard.classes(docs).collect()) == [1, 2]


def test_many_licence_sentences(documents):
    text = "".join(f"{s}\n" for s in list(licences.SENTENCES)[:3])
    docs = documents([(1, text + "Released under the MIT License.\n" * 20000), (2, " " * 200_000 + "x\n" + "# " * 100_000), (3, None)])
    found = {r["doc_id"]: r["licences"] for r in licences.scan(docs).collect()}
    assert "MIT" in found[1].split(",") and set(found) == {1}


def test_many_short_hex_runs(documents):
    key = "0123456789abcdef01234567"
    docs = documents([(1, "bad cafe 12 a " * 200_000 + key), (2, f"{key[:23]} AKIA{'A' * 15} AKIA{'B' * 16}")])
    found = secrets.update(docs)
    spans = sorted(r["spans"] for r in found.selectExpr("transform(spans, s -> array(s.kind, s.start, s.end)) AS spans").collect())
    n = 14 * 200_000
    assert spans == [[[1, 44, 64]], [[2, n, n + 24]]]


def test_sample_of_repeated_rows(documents, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "trained", lambda rows, frequency: seen.append(len(rows)))
    docs = documents([(1, "the same text", "en")] * 3000 + [(1, f"text {i}", "de") for i in range(500)])
    language.fit(docs, sample=40)
    assert seen[0] <= 100


def test_exact_way_below_recall(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(0, 120, 2):
        v = [rng.gauss(0, 1) for _ in range(8)]
        rows += [(i, v, 0), (i + 1, [x + 0.01 for x in v], 0)]
    rows += [(900, [1.0, 2.0], 0), (901, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    usual = sorted(tuple(r) for r in vectors.near_duplicates(df).collect())
    monkeypatch.setattr(vectors, "recall", lambda *_: 0.1)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "found_links", lambda nodes, *_: nodes.sparkSession.createDataFrame([], "a long, b long"))
    assert sorted(tuple(r) for r in vectors.near_duplicates(df).collect()) == usual
