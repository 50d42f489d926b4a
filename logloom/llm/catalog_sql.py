"""DuckDB checks of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op6_ngram_jaccard_join": f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS g
  FROM worded
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of l ON l.a = d.doc_id
""",
}

# unsigned crc32 of the decimal doc_id, bit by bit
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _tree(name: str, nodes: str, levels: int = 6) -> str:
    """Levels ``name``0, ``name``1 ... of trees over ``nodes`` (g, i, n, h); a node of a lower level knows its run (w) and place (p)."""
    parts = [f"{name}0 AS ({nodes})"]
    for k in range(levels):
        parts.append(
            f"{name}{k + 1} AS (SELECT g, i // 16 AS i, (n + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h, "
            f"list(h ORDER BY i) AS w FROM {name}{k} WHERE n > 1 GROUP BY g, i // 16, n)"
        )
    return ",\n".join(parts)


def _proof(name: str, levels: int = 6) -> str:
    """Runs above leaf (g, i) with its place in each, lowest first."""
    joins = " ".join(
        f"LEFT JOIN {name}{k} ON {name}{k}.g = {name}0.g AND {name}{k}.i = {name}0.i // {16 ** k}" for k in range(1, levels + 1)
    )
    runs = ", ".join(
        f"CASE WHEN {name}{k}.w IS NOT NULL THEN {{'w': {name}{k}.w, 'p': {name}0.i // {16 ** (k - 1)} % 16 + 1}} END"
        for k in range(1, levels + 1)
    )
    tops = ", ".join(f"CASE WHEN {name}{k}.n = 1 THEN {name}{k}.h END" for k in range(levels, -1, -1))
    return f"SELECT {name}0.*, list_filter([{runs}], lambda x: x IS NOT NULL) AS runs, coalesce({tops}) AS top FROM {name}0 {joins}"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
_CLAIMED = "sha256(" + " || ".join([*(_field(c) for c in ("doc_id", "source", "lang", "n_chars")), _field("lowered")]) + ")"
_FOLD = """list_reduce(list_prepend({'h': claimed, 'w': NULL::VARCHAR[], 'p': 0::BIGINT},
    list_transform(list_concat(s.runs, u.runs), lambda x: {'h': NULL::VARCHAR, 'w': x.w, 'p': x.p::BIGINT})),
    lambda a, x: {'h': sha256(array_to_string(list_transform(x.w, lambda d, j: CASE WHEN j = x.p THEN a.h ELSE d END), '')),
                  'w': NULL::VARCHAR[], 'p': 0::BIGINT})"""

ORACLE_SQL["op12_merkle_manifest"] = f"""
WITH lowered AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents
), leaves AS (
  SELECT doc_id, source, {_LEAF} AS leaf, CASE WHEN xor({_CRC}, 4294967295) % 5 = 0 THEN {_CLAIMED} ELSE {_LEAF} END AS claimed FROM lowered
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM leaves
), {_tree("s", "SELECT * FROM placed")},
source_proof AS ({_proof("s")}),
subroots AS (SELECT g AS i, any_value(top) AS h FROM source_proof GROUP BY g),
{_tree("u", "SELECT 0 AS g, i, count(*) OVER () AS n, h FROM subroots")},
upper_proof AS ({_proof("u")}),
proven AS (
  SELECT s.doc_id, s.leaf, s.top AS subroot, u.top AS root, {_FOLD}.h AS folded_root,
    sha256(array_to_string(flatten(list_transform(list_concat(s.runs, u.runs), lambda x: list_filter(x.w, lambda d, j: j <> x.p))), '')) AS proof_sha256
  FROM source_proof s JOIN upper_proof u ON u.i = s.g
)
SELECT *, folded_root = root AS verified FROM proven
"""

ORACLE_SQL["op13_embedding_near_dedup"] = """
WITH RECURSIVE sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(c.n, 0) AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(l.b, vec_id)) AS kept
FROM embeddings LEFT JOIN least_of l ON l.a = vec_id LEFT JOIN counts c ON c.a = vec_id
"""

_RUN_BYTES = """flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda x:
    CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + ord(x)::BIGINT // 64, 128 + ord(x)::BIGINT % 64] END))"""
_RUN_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_RUN_BYTES}),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

ORACLE_SQL["op11_spelling_variant_grouping"] = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL),
digested AS (SELECT *, {_RUN_CRC} AS h FROM counted),
cut AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM digested
), words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
one_way AS (
  SELECT x.word AS a, y.word AS b FROM shorter x JOIN shorter y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT y.word, w.word FROM shorter y JOIN words w ON w.word = y.rest
), near AS (SELECT a, b FROM one_way UNION SELECT b, a FROM one_way),
best AS (
  SELECT a, count(*) AS n_near, arg_min(struct_pack(word := b, n := w.n), struct_pack(less := -w.n, word := b)) AS top
  FROM near JOIN words w ON w.word = b GROUP BY a
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 2 * w.n THEN top.word END AS form,
    CASE WHEN top.n >= 2 * w.n THEN top.n END AS form_n
  FROM words w LEFT JOIN best ON best.a = w.word
), followed AS (
  SELECT word, word AS step, 0 AS steps FROM formed
  UNION ALL SELECT f.word, g.form, steps + 1 FROM followed f JOIN formed g ON g.word = f.step WHERE g.form IS NOT NULL
), ends AS (SELECT word, arg_max(step, steps) AS root FROM followed GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
