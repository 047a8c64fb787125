"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this subpackage that has the function of that name.
_WHERE = {
    "op1_weak_supervision": "pii",
    "op2_association_rules": "urls",
    "op3_best_fit_packing": "packing",
    "op4_winnowing": "winnowing",
    "op5_merkle_tree": "merkle",
    "op6_hidden_markov": "hmm",
    "op7_schema_fingerprints": "chat",
    "op8_directly_addressable_codes": "dac",
    "op9_maximum_scoring_segments": "toxicity",
    "op10_universe_partition": "jaccard",
    "op11_inverted_multi_index": "negatives",
    "op12_merkle_manifest": "manifest",
    "op13_quality_rules": "quality",
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
),
hits AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

_CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\")


def _escaped_length(column: str) -> str:
    marks = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in _CONTROLS)
    return f"(length({column}) + {marks})"


_OP7 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_escaped_length("role")} + {_escaped_length("text")} + {len("<|turn|><|text|><|end|>") + 1}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


_OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= 75 * (len(a.s) + len(b.s) - c)),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM s LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY 1) ON x = doc_id
"""


_OP11 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3
"""


def _leaf(text: str) -> str:
    value = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"
    return "sha256(" + " || ".join(value.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# the check sum bit by bit, over the digits
_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda x, c: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(x, c)), CAST(4294967295 AS BIGINT)), 4294967295)"
_BEFORE, _AFTER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"


def _sides(rows: str, by: str) -> str:
    """Digests left and right of each node that has a parent."""
    w = f"PARTITION BY {by}level, i // 8 ORDER BY i"
    return f"SELECT *, coalesce(string_agg(h, '') OVER ({w} {_BEFORE}), '') AS l, coalesce(string_agg(h, '') OVER ({w} {_AFTER}), '') AS r FROM {rows} WHERE n > 1"


_OP12 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, leaf, CASE WHEN doc_id IS NOT NULL AND crc % 3 = 0 THEN other ELSE leaf END AS x,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {_leaf("text")} AS leaf, {_leaf(_LOWER)} AS other, {_CRC} AS crc FROM documents)
),
up AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM d
  UNION ALL SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, level, n, i // 8
),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, n, i // 8
),
near AS ({_sides("up", "lang, ")}),
far AS ({_sides("top", "")}),
one AS (
  SELECT doc_id, lang, leaf, 0 AS level, i, n, x, '' AS proof FROM d
  UNION ALL SELECT doc_id, one.lang, leaf, one.level + 1, one.i // 8, (one.n + 7) // 8, sha256(l || x || r), proof || l || r
  FROM one JOIN near ON one.lang IS NOT DISTINCT FROM near.lang AND one.level = near.level AND one.i = near.i WHERE one.n > 1
),
two AS (
  SELECT doc_id, leaf, s.h AS subroot, 0 AS level, s.i, s.n, x, proof FROM one JOIN subroots s ON one.lang IS NOT DISTINCT FROM s.lang WHERE one.n = 1
  UNION ALL SELECT doc_id, leaf, subroot, two.level + 1, two.i // 8, (two.n + 7) // 8, sha256(l || x || r), proof || l || r
  FROM two JOIN far ON two.level = far.level AND two.i = far.i WHERE two.n > 1
)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = h AS verified
FROM two JOIN top ON two.n = 1 AND top.n = 1
"""


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_winnowing": _OP4, "op7_schema_fingerprints": _OP7, "op10_universe_partition": _OP10, "op11_inverted_multi_index": _OP11, "op12_merkle_manifest": _OP12}
