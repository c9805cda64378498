"""DuckDB SQL of the operators that SQL can express, held against the queries' whole results."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOPK_SEARCH = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY low) AS keep_id, count(*) OVER (PARTITION BY low) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY low) AS kept, sha256(low) AS text_sha256
FROM t
"""

LEXICAL_SEARCH = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, '%(upper)s', '%(lower)s'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), sized AS (SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized),
asked AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '%(upper)s', '%(lower)s'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY item_id, term
), posted AS (
  SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(ws) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term
), weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM posted, corpus GROUP BY term
), summed AS (
  SELECT item_id, doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN weighed USING (term) JOIN posted USING (term), corpus GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM summed WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
""" % {"upper": UPPER, "lower": LOWER}


def _field(column: str) -> str:
    value = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


def _tree(name: str, key: str, levels: int) -> str:
    """CTEs ``name_0`` (given: key, p, h, c) to ``name_levels`` and the runs under each, ``name_run_k``."""

    parts = []
    for k in range(levels):
        parts.append(f"""{name}_run_{k} AS MATERIALIZED (
  SELECT {key}, p // 16 AS p, string_agg(h, '' ORDER BY p) AS run, any_value(c) AS c
  FROM {name}_{k} WHERE c > 1 GROUP BY {key}, p // 16)""")
        parts.append(f"""{name}_{k + 1} AS MATERIALIZED (
  SELECT {key}, p, sha256(run) AS h, (c + 15) // 16 AS c FROM {name}_run_{k}
  UNION ALL SELECT {key}, p, h, c FROM {name}_{k} WHERE c = 1)""")
    return ",\n".join(parts)


def merkle(levels: int = 6) -> str:
    """Trees of up to ``16 ** levels`` leaves a source and as many sources."""

    crc = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda d, z: xor(d >> 1, (d & 1) * 3988292384))), 4294967295)"""
    head = " || ".join(f"({_field(c)})" for c in ("doc_id", "source", "lang", "n_chars"))
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    joins, paths, turns = [], [], []
    for tree, place, key in (("s", "p0", "g"), ("r", "q0", "one")):
        for k in range(levels):
            at = f"{place} // {16 ** k}"
            joins.append(f"LEFT JOIN {tree}_run_{k} ON {tree}_run_{k}.{key} = d.{key} AND {tree}_run_{k}.p = {place} // {16 ** (k + 1)}")
            run, turn = f"{tree}_run_{k}.run", f"CAST(64 * (({at}) % 16) AS BIGINT)"
            turns.append((run, turn))
            paths.append(f"coalesce(substr({run}, 1, {turn}) || substr({run}, {turn} + 65), '')")
    steps = []
    for i, (run, turn) in enumerate(turns):
        name = run.replace(".", "_")
        steps.append(f"f_{i + 1} AS (SELECT * EXCLUDE (cur), CASE WHEN {name} IS NULL THEN cur ELSE "
                     f"sha256(substr({name}, 1, turn_{i}) || cur || substr({name}, turn_{i} + 65)) END AS cur FROM f_{i})")
    columns = ", ".join(f"{run} AS {run.replace('.', '_')}, {turn} AS turn_{i}" for i, (run, turn) in enumerate(turns))
    return f"""
WITH leaves AS MATERIALIZED (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS g, sha256({head} || ({_field("text")})) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND ({crc}) % 5 = 0 THEN sha256({head} || ({_field(low)})) END AS altered
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p0,
    count(*) OVER (PARTITION BY g) AS c0, dense_rank() OVER (ORDER BY g) - 1 AS q0, 1 AS one FROM leaves
), s_0 AS MATERIALIZED (SELECT g, p0 AS p, leaf AS h, c0 AS c FROM placed),
{_tree("s", "g", levels)},
r_0 AS MATERIALIZED (
  SELECT 1 AS one, row_number() OVER (ORDER BY g) - 1 AS p, h, count(*) OVER () AS c, g FROM s_{levels}),
{_tree("r", "one", levels)},
f_0 AS (
  SELECT d.doc_id, d.leaf, r_0.h AS subroot, r_{levels}.h AS root, sha256({" || ".join(paths)}) AS proof_sha256,
    coalesce(d.altered, d.leaf) AS cur, {columns}
  FROM placed d JOIN r_0 ON r_0.g = d.g JOIN r_{levels} ON r_{levels}.one = d.one
  {" ".join(joins)}
), {", ".join(steps)}
SELECT doc_id, leaf, subroot, root, proof_sha256, cur AS folded_root, cur = root AS verified FROM f_{len(turns)}
"""


ORACLES = {
    "op6_topk_search": TOPK_SEARCH,
    "op11_merkle_manifest": merkle(),
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_exact_dedup": EXACT_DEDUP,
}
