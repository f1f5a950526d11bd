"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), ratios AS (
  SELECT source_size * 3.0::DOUBLE / weight AS ratio, sum(source_size)::BIGINT AS size, sum(weight)::BIGINT AS weight FROM sources GROUP BY 1
), units AS (
  SELECT ratio,
    (sum(size) OVER () - 3 * (sum(size) OVER (ORDER BY ratio) - size))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY ratio) - weight))::DOUBLE AS unit
  FROM ratios
), level AS (SELECT arg_min(unit, ratio) AS unit FROM units WHERE ratio >= unit
), targets AS (
  SELECT source, source_size, least(unit * weight, source_size * 3.0::DOUBLE) AS target,
    least(floor(least(unit * weight, source_size * 3.0::DOUBLE) + 0.5), 3 * source_size)::BIGINT AS quota
  FROM sources, level
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.quota,
    coalesce(sum(d.size) OVER (PARTITION BY t.source ORDER BY md5(concat('42:', coalesce(d.doc_id::VARCHAR, '-'))), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, quota) - start)
   + greatest(0, least(source_size + start + size, quota) - source_size - start)
   + greatest(0, least(2 * source_size + start + size, quota) - 2 * source_size - start))::BIGINT AS taken
FROM placed
"""


# CRC-32 of a text's bytes, bit by bit (reflected polynomial 0xEDB88320).
CRC32 = """
xor(4294967295, list_reduce(
  list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, step: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))
"""


def merkle(levels: int = 7) -> str:
    """Manifest with proofs, written out for ``levels`` levels below the subroots and as many above: 8 ** levels rows a language."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen({0}::VARCHAR), ':', {0}::VARCHAR) END".format
    fields = [field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""leaves AS (
  SELECT doc_id, lang, sha256(concat({', '.join(fields)}, {field('text')})) AS leaf,
    CASE WHEN {CRC32.format('doc_id::VARCHAR')} % 3 = 0 THEN sha256(concat({', '.join(fields)}, {field(f'({lower})')})) END AS other
  FROM documents
), inner0 AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS total, leaf AS node, doc_id, leaf, other
  FROM leaves
), walk0 AS (
  SELECT lang, place, total, doc_id, leaf, coalesce(other, leaf) AS folded, '' AS proof FROM inner0
)"""]

    def level(k: int, name: str, walk: str, key: str) -> list[str]:
        same = f"a.{key} IS NOT DISTINCT FROM b.{key}"
        beside = "string_agg(CASE WHEN a.place <> b.place THEN b.node END, '' ORDER BY b.place)"
        with_own = "string_agg(CASE WHEN a.place = b.place THEN a.folded ELSE b.node END, '' ORDER BY b.place)"
        kept = f"a.{key}, a.total, a.doc_id, a.leaf, a.place, a.folded, a.proof{', a.subroot' if walk == 'climb' else ''}"
        out = f"{key}, place // 8 AS place, (total + 7) // 8 AS total, doc_id, leaf{', subroot' if walk == 'climb' else ''}"
        return [
            f"""{walk}{k + 1} AS (
  SELECT {out}, CASE WHEN total > 1 THEN sha256(joined) ELSE folded END AS folded, proof || CASE WHEN total > 1 THEN coalesce(others, '') ELSE '' END AS proof
  FROM (SELECT {kept}, {with_own} AS joined, {beside} AS others
    FROM {walk}{k} a JOIN {name}{k} b ON {same} AND a.place // 8 = b.place // 8 GROUP BY ALL)
)""",
            f"""{name}{k + 1} AS (
  SELECT {key}, place // 8 AS place, (any_value(total) + 7) // 8 AS total,
    CASE WHEN any_value(total) > 1 THEN sha256(string_agg(node, '' ORDER BY place)) ELSE any_value(node) END AS node
  FROM {name}{k} GROUP BY {key}, place // 8
)""",
        ]

    for k in range(levels):
        parts += level(k, "inner", "walk", "lang")
    parts.append(f"""outer0 AS (
  SELECT 0 AS tree, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS total, node, lang FROM inner{levels}
), climb0 AS (
  SELECT 0 AS tree, o.place, o.total, w.doc_id, w.leaf, o.node AS subroot, w.folded, w.proof FROM walk{levels} w JOIN outer0 o ON w.lang IS NOT DISTINCT FROM o.lang
)""")
    for k in range(levels):
        parts += level(k, "outer", "climb", "tree")
    return f"""WITH {', '.join(parts)}
SELECT doc_id, leaf, subroot, o.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = o.node AS verified
FROM climb{levels} JOIN outer{levels} o USING (tree)
"""


COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3]) AS k))
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS words FROM counts WHERE k > 1
), sides AS (
  SELECT c.*, x.f AS l, y.f AS r, ((1000000 * a::HUGEINT * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(words[cut + 1:], ' ')
), best AS (
  SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase, a FROM best WHERE k = 3
), inside AS (
  SELECT lang, phrase, max(a) AS most FROM longer GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE i.most IS NULL OR 100 * i.most < 50 * a
QUALIFY rank <= 2000
"""


LOWER_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Windows of item words against all stretches of document words of the same length.
DECONTAMINATION = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT item, least(len(words), 13) AS size, unnest(list_transform(range(1, greatest(len(words) - 12, 1) + 1), lambda i: array_to_string(words[i : i + least(len(words), 13) - 1], ' '))) AS stretch
  FROM items WHERE len(words) > 0
), places AS (
  SELECT row, size, i, array_to_string(words[i : i + size - 1], ' ') AS stretch
  FROM (SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)
), matches AS (
  SELECT DISTINCT p.row, p.i, p.size, w.item FROM places p JOIN windows w ON w.size = p.size AND w.stretch = p.stretch
), hits AS (
  SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT row, i, size FROM matches)) GROUP BY row
), named AS (
  SELECT row, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM matches GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hits USING (row) LEFT JOIN named USING (row)
"""

# The smallest document of every window of 50 bytes; what a later one covers with it goes.
SUFFIX_DEDUP = """
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS data, octet_length(encode(coalesce(text, ''))) AS size FROM documents
), windows AS (
  SELECT row, doc_id, i, data[i : i + 49] AS stretch FROM (SELECT row, doc_id, data, unnest(range(1, size - 48)) AS i FROM docs WHERE size >= 50)
), repeats AS (
  SELECT row, i FROM (SELECT row, doc_id, i, min(doc_id) OVER (PARTITION BY stretch) AS least FROM windows) WHERE least < doc_id
), marked AS (
  SELECT row, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY row ORDER BY i) + 50, 0) THEN 1 ELSE 0 END AS new FROM repeats
), spans AS (
  SELECT row, min(i) AS low, max(i) + 49 AS high FROM (SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i) AS span FROM marked) GROUP BY row, span
), gaps AS (
  SELECT row, coalesce(lag(high) OVER w, 0) + 1 AS low, low - 1 AS high FROM spans WINDOW w AS (PARTITION BY row ORDER BY low)
  UNION ALL SELECT s.row, max(s.high) + 1, any_value(d.size) FROM spans s JOIN docs d USING (row) GROUP BY s.row
), kept AS (
  SELECT row, string_agg(hex(data[low : high]), '' ORDER BY low) AS data FROM gaps JOIN docs USING (row) WHERE low <= high GROUP BY row
), counts AS (
  SELECT row, sum(high - low + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY row
)
SELECT d.doc_id, d.size::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN c.row IS NULL THEN d.data ELSE unhex(coalesce(k.data, '')) END) AS kept_sha256
FROM docs d LEFT JOIN counts c USING (row) LEFT JOIN kept k USING (row)
"""
