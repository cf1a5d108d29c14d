"""SQL twins of the operators on words: importance resampling, decontamination, spelling variants."""

from __future__ import annotations

# CTE with one row, the table of CRC-32 (polynomial 0xEDB88320, bits reversed), as a list.
CRC_TABLE = """crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS ct FROM (SELECT unnest(range(256)) AS i))"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text expression; `crc_table` has to be in scope."""
    data = f"""list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(ct[xor(c, b) % 256 + 1], c // 256)))"""


def lower_ascii(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words_of(text: str) -> str:
    return rf"regexp_extract_all({lower_ascii(f'''coalesce({text}, '')''')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


RESAMPLING = f"""WITH {CRC_TABLE},
  d AS (SELECT row_number() OVER () AS k, doc_id, {words_of("text")} AS words FROM documents),
  dw AS (SELECT k, unnest(words) AS word FROM d),
  bw AS (SELECT unnest({words_of("text")}) AS word FROM benchmark),
  codes AS (SELECT word, {crc32("word")} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table),
  s AS (SELECT bucket, count(*) AS s FROM dw JOIN codes USING (word) GROUP BY bucket),
  t AS (SELECT bucket, count(*) AS t FROM bw JOIN codes USING (word) GROUP BY bucket),
  sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
  gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((s::DOUBLE + 1) * (tt + 10000))))::BIGINT AS gain
    FROM s LEFT JOIN t USING (bucket), sums),
  w AS (SELECT k, sum(gain)::BIGINT AS weight FROM dw JOIN codes USING (word) JOIN gains USING (bucket) GROUP BY k),
  scored AS (SELECT k, doc_id, len(words) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (k)),
  drawn AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n, weight) AS rank FROM scored WHERE n >= 20)
  SELECT doc_id, n::BIGINT AS n_features, weight, score, rank FROM scored
  LEFT JOIN (SELECT * FROM drawn WHERE rank <= 10 * (SELECT count(*) FROM drawn) // 100) USING (k)"""

# Windows of every length that items have, looked up among the word sequences of that length.
DECONTAMINATION = rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {words_of("text")} AS words FROM documents),
  b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {words_of("text")} AS words FROM benchmark),
  windows AS (SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i:i + 9], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
  sizes AS (SELECT DISTINCT size FROM windows),
  runs AS (SELECT k, i, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
    FROM (SELECT k, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size)),
  met AS (SELECT k, i, size, item_id FROM runs JOIN windows USING (size, phrase)),
  hit AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT k, i, size FROM met)) GROUP BY k),
  items AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT k, item_id FROM met) GROUP BY k)
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (k) LEFT JOIN items USING (k)"""

# Edit distance counts bytes here, so every letter beyond ASCII is given an ASCII sign of its own first.
_BEYOND, _SIGNS = "".join(map(chr, range(0xC0, 0x100))), "".join(c for c in map(chr, range(35, 127)) if c not in "'\\" and not c.islower())[:64]
VARIANTS = f"""WITH RECURSIVE {CRC_TABLE},
  runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT k, doc_id, unnest(regexp_extract_all({lower_ascii("text")}, '[a-z\u00C0-\u00FF]+')) AS run
    FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents)) WHERE length(run) >= 6 GROUP BY k, doc_id, run),
  hashed AS (SELECT run, n, {crc32("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs, crc_table),
  slipped AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
  w AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
  lacking AS (SELECT DISTINCT word, v FROM (SELECT word, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
    UNION ALL SELECT word, word FROM w)),
  met AS (SELECT DISTINCT a.word, b.word AS near FROM lacking a JOIN lacking b USING (v) WHERE a.word <> b.word),
  near AS (SELECT word, near FROM met WHERE levenshtein(translate(word, '{_BEYOND}', '{_SIGNS}'), translate(near, '{_BEYOND}', '{_SIGNS}')) = 1),
  best AS (SELECT near.word, count(*) AS n_near, first(struct_pack(word := near, n := o.n) ORDER BY o.n DESC, near) AS b
    FROM near JOIN w o ON o.word = near GROUP BY near.word),
  forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * w.n THEN b.word END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n
    FROM w LEFT JOIN best USING (word)),
  chain(word, stop, depth) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.stop WHERE f.form IS NOT NULL),
  roots AS (SELECT word, arg_max(stop, depth) AS root FROM chain GROUP BY word)
  SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN roots USING (word)"""
