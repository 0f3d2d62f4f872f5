"""SQL twins of the queries that SQL can express, in DuckDB's dialect."""

ORACLES: dict[str, str] = {}

ORACLES["op5_line_spread"] = """
WITH pieces AS (
  SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), all_lines AS (
  SELECT doc_id, site, unnest(parts) AS part, unnest(range(len(parts))) AS place FROM pieces
), judged AS (
  SELECT *, trim(part, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM all_lines
), common AS (
  SELECT line, min((doc_id, place)) AS home FROM judged WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10
), marked AS (
  SELECT j.*, c.line IS NOT NULL AND (j.doc_id, j.place) <> c.home AS gone FROM judged j LEFT JOIN common c USING (line)
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(part, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS body
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

def _components(k: int, percent: int, columns: str) -> str:
    """Components of documents by the Jaccard likeness of their sets of ``k``-word shingles."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {k}
      THEN list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w
), n AS (
  SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {percent} * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
)
SELECT n.doc_id, {columns} FROM n
JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = n.doc_id
"""


ORACLES["op3_token_groups"] = _components(4, 85, "n.n AS n_shingles, r.c AS component_id")
ORACLES["minhash_components"] = _components(5, 80, "r.c AS component_id")

ORACLES["op4_window_repeats"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 33)) AS p,
    unnest(list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' ')))) AS h
  FROM w WHERE len(ws) >= 35
), often AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM windows SEMI JOIN often USING (h)
), removed AS (
  SELECT doc_id, list(i) AS places, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN ws
    ELSE list_filter(ws, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN removed r ON r.doc_id = w.doc_id
"""


def _framed(*columns: str) -> str:
    parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in columns]
    return f"sha256({' || '.join(parts)})"


def _crc32(text: str) -> str:
    """Bit by bit: the first element of each list is what the rest is folded into."""
    byte = (
        "list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda z, k: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384::BIGINT) ELSE z >> 1 END)"
    )
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295::BIGINT)"


def _tree(leaves: str) -> str:
    """Nodes (k, lvl, i, h) of all trees, n being those of the level, from leaves (k, i, h, n)."""
    return f"""
  SELECT k, 0 AS lvl, i, h, n FROM {leaves}
  UNION ALL
  SELECT k, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3 FROM {{self}} WHERE n > 1 GROUP BY k, lvl, i // 3"""


def _steps(nodes: str, wanted: str, last: str) -> str:
    """For each wanted node (id, k, i) and level: digests before and after its ancestor in the run."""
    return f"""
  SELECT w.id, a.lvl + {last} AS lvl,
    coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i < a.i), '') AS l,
    coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i > a.i), '') AS r
  FROM {wanted} w JOIN {nodes} a ON a.k = w.k AND a.i = w.i // CAST(pow(3, a.lvl) AS BIGINT) AND a.n > 1
  LEFT JOIN {nodes} s ON s.k = a.k AND s.lvl = a.lvl AND s.i // 3 = a.i // 3 AND s.i <> a.i
  GROUP BY w.id, a.lvl"""


ORACLES["op11_interval_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || source, '0') AS k, {_framed('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
    {_framed('doc_id', 'source', 'lang', 'n_chars', 'now')} AS present
  FROM (SELECT *, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents)
), leaves AS (
  SELECT doc_id AS id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY k) AS n FROM d
), nodes AS ({_tree('leaves').format(self='nodes')}
), roots AS (
  SELECT k AS id, '' AS k, row_number() OVER (ORDER BY k) - 1 AS i, h, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS ({_tree('roots').format(self='upper')}
), below AS ({_steps('nodes', 'leaves', '0')}
), beyond AS ({_steps('upper', 'roots', '1000')}
), steps AS (
  SELECT id, lvl, l, r FROM below UNION ALL SELECT d.doc_id, b.lvl, b.l, b.r FROM d JOIN beyond b ON b.id = d.k
), paths AS (
  SELECT id, string_agg(l || r, '' ORDER BY lvl) AS siblings, list(l || '|' || r ORDER BY lvl) AS path FROM steps GROUP BY id
), folded AS (
  SELECT d.doc_id, d.leaf, q.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_concat([d.present], coalesce(path, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM d JOIN roots q ON q.id = d.k LEFT JOIN paths p ON p.id = d.doc_id
)
SELECT *, folded_root = root AS verified FROM folded
"""

ORACLES["op13_projection_forest"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fit AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.x = v.vec_id) AS n_links, c.m AS component_id, v.vec_id = c.m AS kept
FROM v JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) c ON c.x = v.vec_id
"""
