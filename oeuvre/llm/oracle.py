"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from oeuvre.llm import licences

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {WORDS} AS w FROM documents),
places AS (SELECT row, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM docs),
windows AS (SELECT row, i, array_to_string(w[i:i + 34], ' ') AS win FROM places),
again AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
covered AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS k FROM windows SEMI JOIN again USING (win)),
words AS (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM docs),
kept AS (
    SELECT row, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n
    FROM words ANTI JOIN covered USING (row, k) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (row)
"""

JACCARD = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b USING (s)
    WHERE a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= 75 * (x.n + y.n - k)
),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""



def spans(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Rows (row, k, kind, a, b): the matches of a pattern in code points."""
    whole = f"([\\s\\S]*?)({pattern})"
    part = lambda g: f"regexp_extract_all(t, '{whole.replace(chr(39), chr(39) * 2)}', {g})"
    return f"""
SELECT row, {k} AS k, '{kind}' AS kind, b - own AS a, b, part FROM (
    SELECT row, own, part, sum(gap + own) OVER (PARTITION BY row ORDER BY i) AS b FROM (
        SELECT row, i, length(g[i]) AS gap, length(o[i]) AS own, length(p[i]) AS part FROM (
            SELECT *, unnest(range(1, len(o) + 1)) AS i FROM (
                SELECT row, {part(1)} AS g, {part(2)} AS o, {part(2 + group)} AS p FROM docs))))
WHERE part >= {least}"""


ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)

SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
{" UNION ALL ".join([spans(0, "assign", ASSIGN, 2, 6), spans(1, "access", "(AKIA[A-Z0-9]+)", 1, 20), spans(2, "hex", "([0-9a-f]+)", 1, 24)])}
),
each AS (
    SELECT row, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
        string_agg(concat_ws(':', kind, a::BIGINT, b::BIGINT), ',' ORDER BY a, k) AS spans
    FROM found GROUP BY row
)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
    sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN each USING (row)
"""

MIXING = rf"""
WITH marks AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS weight,
        (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
    FROM documents LEFT JOIN marks USING (doc_id)
),
sums AS (
    SELECT source, sum(size)::DOUBLE AS s, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
    FROM docs GROUP BY source
),
shares AS (
    SELECT source, s, w,
        2 * s / w <= (1.5 * sum(s) OVER () - coalesce(2 * sum(s) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))
            AS capped
    FROM sums
    WINDOW before AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
goals AS (
    SELECT source, s, CASE WHEN capped THEN 2 * s ELSE
        (1.5 * sum(s) OVER () - coalesce(sum(2 * s) FILTER (capped) OVER (), 0))
        / (sum(w) OVER () - coalesce(sum(w) FILTER (capped) OVER (), 0)) * w END AS target
    FROM shares
),
budgets AS (
    SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS epochs, floor(target) - epochs * s AS budget FROM goals
),
ranked AS (
    SELECT doc_id, size, s, target, epochs, budget, docs.source AS source,
        coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY 1 - pow(u, 1 / weight), doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM docs JOIN budgets ON docs.source IS NOT DISTINCT FROM budgets.source
)
SELECT doc_id, size, s::BIGINT AS source_size, target::DOUBLE AS target,
    (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken, source
FROM ranked
"""

WARC = """
WITH docs AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
first AS (SELECT b, min(page_id) AS least FROM docs WHERE octet_length(b) >= 100 GROUP BY b)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest,
    CASE WHEN least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN least <> page_id THEN least END AS refers_to
FROM docs LEFT JOIN first USING (b)
"""


def rule_pattern(ids: list[str]) -> str:
    """Matches a sequence ",id,id," in which these ids occur in order."""
    return "," + ",(?:[a-z0-9-]+,)*".join(ids) + ","


KNOWN = ", ".join(f"('{licences.normal(s)}', '{i}')" for i, s in licences.SENTENCES.items())
RULES = ", ".join(f"('{name}', '{rule_pattern(ids)}')" for name, ids in licences.RULES)

LICENCES = rf"""
WITH known(sentence, id) AS (VALUES {KNOWN}),
rules(name, pattern) AS (VALUES {RULES}),
docs AS (SELECT row_number() OVER () AS row, doc_id, lower(coalesce(text, '')) AS t FROM documents),
cuts AS (
    SELECT row, 0 AS cut, string_split_regex(t, '{licences.LINES}') AS parts FROM docs
    UNION ALL SELECT row, 1, string_split_regex(t, '{licences.STOPS}') FROM docs WHERE contains(t, chr(10))
),
each AS (SELECT row, cut, unnest(range(1, len(parts) + 1)) AS place, unnest(parts) AS part FROM cuts),
found AS (
    SELECT row, cut, ',' || string_agg(id, ',' ORDER BY place, id) || ',' AS ids
    FROM each JOIN known ON trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) = sentence GROUP BY row, cut
),
named AS (SELECT DISTINCT row, name FROM found JOIN rules ON regexp_matches(ids, pattern)),
names AS (
    SELECT row, string_agg(name, ',' ORDER BY name) AS licences FROM named
    WHERE name <> 'BSD-2-Clause' OR row NOT IN (SELECT row FROM named WHERE name = 'BSD-3-Clause') GROUP BY row
),
longest AS (SELECT row, arg_max(trim(ids, ','), length(ids) * 2 - cut) AS sentences FROM found GROUP BY row)
SELECT doc_id, coalesce(licences, '') AS licences, sentences
FROM longest JOIN docs USING (row) LEFT JOIN names USING (row)
"""

NEAREST = """
WITH vectors AS (
    SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (
    SELECT a.row, a.vec_id AS query_id, b.vec_id, b.row AS other, list_inner_product(a.v, b.v) AS score
    FROM vectors a JOIN vectors b ON a.row <> b.row AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

PHRASES = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
    SELECT lang, 1 AS k, unnest(w) AS phrase FROM split
    UNION ALL SELECT lang, 2, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) FROM split WHERE len(w) > 1
    UNION ALL SELECT lang, 3, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3]))
    FROM split WHERE len(w) > 2
),
f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
halves AS (
    SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
),
cuts AS (
    SELECT c.lang, c.k, c.phrase, c.a, x.a AS l, y.a AS r, cut,
        (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
    FROM halves c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
    SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS more
    FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM candidates WHERE k = 3) GROUP BY ALL
),
kept AS (
    SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE more IS NULL OR 100 * more < 50 * a
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

TRIE = r"""
WITH RECURSIVE given AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
),
hashes AS (
    SELECT conv_id, count(*) AS n, list_reduce(
        list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))
    ) AS crc FROM given GROUP BY conv_id
),
convs AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base, xor(crc, 4294967295) % 4 AS h FROM hashes),
lent AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS lent FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
turns AS (
    SELECT conv_id, g.place AS pos, role, text FROM lent JOIN given g USING (conv_id) WHERE g.place >= h AND lent = h
    UNION ALL SELECT conv_id, g.place - h + lent, role, text FROM lent JOIN given g USING (conv_id) WHERE g.place >= h AND lent < h
    UNION ALL SELECT l.conv_id, g.place, role, text FROM lent l JOIN given g ON g.conv_id = l.base WHERE g.place < lent
),
firsts AS (
    SELECT conv_id, pos + 1 AS depth, text, string_agg(length(role) || ':' || length(text) || ':' || role || text, '|')
        OVER (PARTITION BY conv_id ORDER BY pos) AS id FROM turns
),
path AS (
    SELECT conv_id, depth, text, sha256(id) AS id,
        coalesce(sha256(lag(id) OVER (PARTITION BY conv_id ORDER BY depth)), 'root') AS parent,
        depth = max(depth) OVER (PARTITION BY conv_id) AS ends
    FROM firsts
    UNION ALL SELECT conv_id, 0, '', 'root', NULL, conv_id NOT IN (SELECT conv_id FROM turns) FROM convs
),
nodes AS (
    SELECT id, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words,
        string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
    FROM path GROUP BY id
),
children AS (SELECT parent AS id, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
up(id, top) AS (
    SELECT id, id FROM nodes
    UNION ALL SELECT up.id, nodes.parent FROM up JOIN nodes ON nodes.id = up.top WHERE nodes.parent IS NOT NULL
),
totals AS (
    SELECT top AS id, sum((n_children IS NULL)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
    FROM up JOIN nodes USING (id) LEFT JOIN children USING (id) GROUP BY top
)
SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children,
    n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.id = x.parent LEFT JOIN children c ON c.id = x.id JOIN totals t ON t.id = x.id
"""

SQL = {
    "op3_licence_scan": LICENCES,
    "op9_warc_round_trip": WARC,
    "op4_secret_scan": SECRETS,
    "op6_mix_sources": MIXING,
    "op8_ngram_jaccard_join": JACCARD,
    "op10_substring_dedup": SUBSTRING,
    "op11_nearest_neighbours": NEAREST,
    "op12_phrase_mining": PHRASES,
    "op13_conversation_trie": TRIE,
}
