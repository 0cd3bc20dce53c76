"""SQL for the queries that SQL can express."""

_CUR = "cur AS (SELECT * FROM lessons QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, loaded_at DESC) = 1)"
_TAGS = f"""WITH {_CUR},
raw AS (
  SELECT id, unnest(CASE WHEN starts_with(trim(tags), '[') THEN from_json(trim(tags), '["VARCHAR"]') ELSE string_split(tags, ',') END) AS t FROM cur WHERE tags IS NOT NULL),
tag AS (SELECT DISTINCT id, lower(trim(t)) AS t FROM raw WHERE trim(t) <> ''),
size AS (SELECT id, count(*) AS n FROM tag GROUP BY id HAVING count(*) >= 4),
shared AS (
  SELECT a.id AS id_a, b.id AS id_b, count(*) AS n
  FROM tag a JOIN tag b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2),
near AS (SELECT id_a, id_b FROM shared JOIN size x ON x.id = id_a JOIN size y ON y.id = id_b WHERE shared.n >= 0.6 * (x.n + y.n - shared.n) - 1e-9)
"""
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_SHINGLES = f"""WITH {_CUR},
w AS (SELECT id, {_WORDS.format("content")} AS w FROM cur),
sh AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 10),
size AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
near AS (SELECT id_a, id_b FROM shared JOIN size x ON x.id = id_a JOIN size y ON y.id = id_b WHERE shared.n >= 0.5 * (x.n + y.n - shared.n) - 1e-9)
"""
_VECTORS = """WITH v AS (
  SELECT chunk_id AS id, min(embedding) AS e FROM chunks_vec
  WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY chunk_id),
u AS (SELECT id, (e::DOUBLE[])::DOUBLE[64] AS e FROM v),
"""

_LEAKS = r"""WITH
words AS (
  SELECT doc_id AS k, list_filter(regexp_split_to_array(lower(strip_accents(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w, false AS item FROM documents
  UNION ALL
  SELECT item_id, list_filter(regexp_split_to_array(lower(strip_accents(coalesce(passage, ''))), '[^\p{L}\p{N}]+'), lambda w: w <> ''), true FROM eval_items),
g AS (SELECT DISTINCT k, item, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) AS s FROM words WHERE len(w) >= 4),
r AS (SELECT DISTINCT k, item, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) AS s FROM words WHERE len(w) >= 12),
n AS (SELECT k, count(*) AS n FROM g WHERE item GROUP BY k),
part AS (SELECT d.k AS doc_id, i.k AS item_id, count(*) AS c FROM g d JOIN g i ON d.s = i.s AND i.item AND NOT d.item GROUP BY 1, 2)"""

SQL = {
    "p1_found": rf"""WITH {_CUR},
texts AS (SELECT 'lessons' AS table_name, id AS row_id, content AS t FROM cur
  UNION ALL SELECT 'lesson_chunks', id, arg_min(text, loaded_at) FROM lesson_chunks GROUP BY id)
SELECT table_name, row_id FROM texts WHERE length(trim(t, E' \t\r\n')) > 1000""",
    "p2_found": _TAGS + "SELECT id_a, id_b FROM near",
    "p2_links": _TAGS
    + """, sets AS (SELECT id, list_sort(list(t)) AS s FROM tag JOIN size USING (id) GROUP BY id),
cls AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies FROM sets),
ends AS (SELECT id_a AS id FROM near UNION ALL SELECT id_b FROM near)
SELECT cls.id, class_id, copies, (SELECT count(*) FROM ends WHERE ends.id = cls.id) AS links FROM cls""",
    "p3_found": _VECTORS
    + """pairs AS (SELECT a.id AS a, b.id AS b, array_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.id <> b.id),
top AS (SELECT * FROM pairs WHERE c >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY least(round(c, 12), 1) DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM top""",
    "p4_found": _SHINGLES + "SELECT id_a, id_b FROM near",
    "p4_groups": _SHINGLES.replace("WITH cur", "WITH RECURSIVE cur", 1)
    + """, ways AS (SELECT id_a AS a, id_b AS b FROM near UNION ALL SELECT id_b, id_a FROM near),
reach(id, r) AS (SELECT id, id FROM cur UNION SELECT reach.id, ways.b FROM reach JOIN ways ON ways.a = reach.r)
SELECT id, min(r) AS group_id FROM reach GROUP BY id""",
    "p2_archive": _TAGS.split("shared AS")[0].rstrip().rstrip(",")
    + """, old AS (SELECT id, arg_max(tags, archived_at) AS tags FROM lessons_archive GROUP BY id),
oraw AS (SELECT id, unnest(CASE WHEN starts_with(trim(tags), '[') THEN from_json(trim(tags), '["VARCHAR"]') ELSE string_split(tags, ',') END) AS t FROM old WHERE tags IS NOT NULL),
otag AS (SELECT DISTINCT id, lower(trim(t)) AS t FROM oraw WHERE trim(t) <> ''),
osize AS (SELECT id, count(*) AS n FROM otag GROUP BY id HAVING count(*) >= 4),
both_ AS (SELECT o.id AS archived_id, t.id AS lesson_id, count(*) AS n FROM otag o JOIN tag t ON t.t = o.t GROUP BY 1, 2)
SELECT archived_id, lesson_id, round(b.n / (x.n + y.n - b.n), 6) AS similarity FROM both_ b JOIN osize x ON x.id = archived_id JOIN size y ON y.id = lesson_id WHERE b.n >= 0.6 * (x.n + y.n - b.n) - 1e-9""",
    "p10_shares": rf"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) ELSE [] END AS g FROM w)
SELECT doc_id, len(g) AS runs, CASE WHEN len(g) = 0 THEN 0 ELSE round(1 - len(list_distinct(g)) / len(g), 9) END::DOUBLE AS share FROM g""",
    "p10_found": rf"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) AS g FROM w WHERE len(w) >= 44)
SELECT doc_id FROM g WHERE 1 - len(list_distinct(g)) / len(g) >= 0.3 - 1e-12""",
    "p9_found": _LEAKS + """SELECT doc_id, item_id FROM part JOIN n ON n.k = item_id WHERE c >= 0.5 * n - 1e-9
UNION
SELECT d.k, i.k FROM r d JOIN r i ON d.s = i.s AND i.item AND NOT d.item""",
    "p9_shares": _LEAKS
    + """, both_ AS (SELECT doc_id, item_id, c FROM part UNION ALL SELECT d.k, i.k, NULL FROM r d JOIN r i ON d.s = i.s AND i.item AND NOT d.item),
pair AS (SELECT doc_id, item_id, max(c) AS c, bool_or(c IS NULL) AS run12 FROM both_ GROUP BY 1, 2)
SELECT doc_id, item_id, run12, round(coalesce(c, 0) / n, 9) AS shared FROM pair JOIN n ON n.k = item_id WHERE run12 OR coalesce(c, 0) >= 0.25 * n""",
    "p1_whole": rf"""WITH {_CUR},
texts AS (SELECT 'lessons' AS table_name, id AS row_id, content AS t FROM cur
  UNION ALL SELECT 'lesson_chunks', id, arg_min(text, loaded_at) FROM lesson_chunks GROUP BY id),
bare AS (SELECT table_name, row_id, trim(t, E' \t\r\n') AS t FROM texts)
SELECT table_name, row_id, sha256(t) AS hash, true AS fits FROM bare WHERE t <> ''""",
    "p8_whole": "SELECT doc_id, coalesce(n_tokens, ceil(length(coalesce(\"text\", '')) / 4))::BIGINT AS tokens, true AS fits FROM documents",
}
