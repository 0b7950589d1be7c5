"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from vigilspark.llm import codes, licenses, merkle, mixing

TOPK = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""


def mixing_sql() -> str:
    """Raking and calibration as a chain of common table expressions."""
    text = "coalesce(text, '')"
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower({text}), '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in mixing.TOPICS)
    parts = [
        f"""d AS (SELECT doc_id, coalesce(source, '(none)') AS mix_source, coalesce(lang, '(none)') AS mix_lang,
  CASE {whens} ELSE 'prose' END AS mix_topic,
  CAST(len(regexp_extract_all({text}, '[^ \\t-\\r]+')) AS BIGINT) AS n_tokens FROM documents)""",
        "c AS (SELECT mix_source, mix_lang, mix_topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM d GROUP BY ALL)",
    ]
    parts.append("b AS (SELECT sum(n) AS total FROM c)")
    for k in mixing.KEYS:
        order = f"ORDER BY m / t, {k} ROWS BETWEEN"
        parts.append(f"t_{k} AS (SELECT {k}, sum(n) AS m, pow(sum(n), {mixing.TEMPERATURE}) AS t FROM c GROUP BY {k} HAVING sum(n) > 0)")
        parts.append(f"l_{k} AS (SELECT *, ({mixing.BUDGET} * total - coalesce(sum(m) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(t) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t_{k}, b)")
        parts.append(f"w_{k} AS (SELECT {k}, least(m, t * coalesce((SELECT level FROM l_{k} WHERE m / t >= level ORDER BY m / t, {k} LIMIT 1), 'inf')) AS want_{k} FROM l_{k})")
    joins = " ".join(f"LEFT JOIN w_{k} USING ({k})" for k in mixing.KEYS)
    parts.append(f"r0 AS MATERIALIZED (SELECT *, CAST({mixing.BUDGET} AS DOUBLE) AS ratio FROM c {joins})")
    step = 0
    for _ in range(mixing.CYCLES):
        for k in mixing.KEYS:
            kept = f"sum(n * least(1.0, ratio)) OVER (PARTITION BY {k})"
            parts.append(f"r{step + 1} AS MATERIALIZED (SELECT * REPLACE (least({mixing.MOST}, coalesce(ratio * want_{k} / nullif({kept}, 0), ratio)) AS ratio) FROM r{step})")
            step += 1
    parts.append(f"p AS (SELECT mix_source, mix_lang, mix_topic, round(CASE WHEN n > 0 THEN least(1.0, ratio) ELSE 1.0 END, 6) AS probability FROM r{step})")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, n_tokens, mix_topic AS topic, probability,
  CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / pow(2.0, 32) < probability AS sampled
FROM d JOIN p USING (mix_source, mix_lang, mix_topic)"""


def license_sql() -> str:
    """Every block and every join of sentences of every document against every template, without anchors."""
    rows = ", ".join(f"({k}, '{name}', {licenses.template_bigrams(body)!r})" for k, (name, body) in enumerate(licenses.TEMPLATES))
    words = "string_split(trim(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g')), ' ')"
    sentences = "string_split(regexp_replace(text, '([.!?;:])[ \\t\\n]+', '\\1' || chr(1), 'g'), chr(1))"
    bare = r"regexp_replace(text, '(?m)^[ \t]*(?:/\*+|\*+/|//+|--+|[*#;%]+)[ \t\r]*$', '', 'g')"
    paragraphs = "regexp_split_to_array({}, '\\n[ \\t\\r]*\\n')"
    blocks = ["string_split(text, chr(10))", sentences, paragraphs.format("text"), paragraphs.format(bare), "[text]"]
    whole = blocks[0]
    for b in blocks[1:]:
        whole = f"list_concat({whole}, {b})"

    def scored(source: str, keys: str, name: str) -> str:
        return f"""{name}w AS (SELECT {keys}, {words} AS w FROM {source}
), {name}g AS (SELECT {keys}, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bg FROM {name}w WHERE len(w) >= 2
), {name}s AS (SELECT {keys}, k, license, 2.0 * len(list_intersect(bg, tg)) / (len(bg) + len(tg)) AS dice FROM {name}g JOIN t ON len(bg) * 4 <= 9 * len(tg) AND len(tg) * 4 <= 9 * len(bg)
), {name}m AS (SELECT {keys}, max(dice) AS dice, arg_max(license, (dice, -k)) AS license, arg_max(-k, (dice, -k)) AS nk FROM {name}s WHERE dice >= {licenses.THRESHOLD} GROUP BY {keys})"""

    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(k, license, tg)), b AS (SELECT DISTINCT doc_id, unnest({whole}) AS b FROM documents
), {scored("b", "doc_id, b", "b")}, sentence AS (SELECT doc_id, {sentences} AS s FROM documents
), span AS (SELECT doc_id, i, n, array_to_string(s[i:i + n - 1], ' ') AS b FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM sentence), (SELECT unnest(range(1, {licenses.RUN + 1})) AS n) WHERE i + n - 1 <= len(s)
), {scored("span", "doc_id, i, n", "j")}, best AS (SELECT * FROM jm x WHERE NOT EXISTS (
  FROM jm y WHERE y.doc_id = x.doc_id AND y.i < x.i + x.n AND x.i < y.i + y.n AND (y.dice, y.nk) > (x.dice, x.nk))
), more AS (SELECT doc_id, license, max(dice) AS dice, arg_max(nk, (dice, nk)) AS nk FROM best WHERE NOT EXISTS (FROM bm WHERE bm.doc_id = best.doc_id AND bm.license = best.license) GROUP BY doc_id, license
), m AS (SELECT doc_id, license, dice, nk FROM bm UNION ALL SELECT doc_id, license, dice, nk FROM more
), d AS (SELECT doc_id, arg_max(license, (dice, nk)) AS license, max(dice) AS dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n_matches FROM m GROUP BY doc_id)
SELECT doc_id, d.license, coalesce(round(d.dice, 6), 0.0) AS dice, coalesce(d.licenses, '') AS licenses, coalesce(n_matches, 0) AS n_matches FROM documents LEFT JOIN d USING (doc_id)"""


def merkle_sql(depth: int = 8) -> str:
    """Trees of up to `depth` levels: a tree that is down to one node stays as it is."""
    f = merkle.FANOUT
    cell = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(cell.format(text if c == "text" else c) for c in merkle.FIELDS) + ")"

    parts = [
        "bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)))",
        f"d AS (SELECT *, {leaf('text')} AS leaf, {leaf(lowered)} AS low, coalesce('=' || source, '') AS tree, "
        "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, bits.t[(xor(a, b) & 255) + 1])), 4294967295) % 5 = 0 AS bad FROM documents, bits)",
        "l AS (SELECT doc_id, leaf, CASE WHEN bad THEN low ELSE leaf END AS given, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i0 FROM d)",
        "s0 AS (SELECT tree, i0 AS i, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM l)",
    ]

    def climb(name: str) -> None:
        for k in range(depth):
            parts.append(f"{name}r{k} AS MATERIALIZED (SELECT tree, i // {f} AS run, n, list(node ORDER BY i) AS kids FROM {name}{k} GROUP BY tree, i // {f}, n)")
            parts.append(f"{name}{k + 1} AS (SELECT tree, run AS i, CASE WHEN n > 1 THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS node, (n + {f - 1}) // {f} AS n FROM {name}r{k})")

    climb("s")
    parts.append(f"t0 AS (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY tree) - 1 AS i, node, count(*) OVER () AS n FROM s{depth})")
    climb("t")
    steps = [("s", k, "l.tree", f"l.i0 // {f**k}") for k in range(depth)] + [("t", k, "''", f"t0.i // {f**k}") for k in range(depth)]
    joins, lefts = [f"JOIN t0 ON t0.source = l.tree JOIN t{depth} top ON true"], []
    for x, k, tree, at in steps:
        joins.append(f"JOIN {x}r{k} ON {x}r{k}.tree = {tree} AND {x}r{k}.run = ({at}) // {f}")
        lefts.append((f"array_to_string({x}r{k}.kids[1:({at}) % {f}], '')", f"array_to_string({x}r{k}.kids[({at}) % {f} + 2:], '')", f"{x}r{k}.n"))
    cells = ", ".join(f"{a} AS a{j}, {b} AS b{j}, {n} AS n{j}" for j, (a, b, n) in enumerate(lefts))
    parts.append(f"f0 AS (SELECT l.doc_id, l.leaf, t0.node AS subroot, top.node AS root, l.given AS g, {cells} FROM l {' '.join(joins)})")
    for j in range(len(steps)):
        parts.append(f"f{j + 1} AS (SELECT * REPLACE (CASE WHEN n{j} > 1 THEN sha256(a{j} || g || b{j}) ELSE g END AS g) FROM f{j})")
    proof = " || ".join(f"a{j} || b{j}" for j in range(len(steps)))
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, g AS folded_root, g = root AS verified FROM f{len(steps)}"


def codes_sql() -> str:
    """Every distance of every round, in whole numbers."""
    n, finite = codes.PARTS, "len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0"
    parts = [
        f"v AS (SELECT vec_id, label, [CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL AND {finite})",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, e[part * len(e) // {n} + 1:(part + 1) * len(e) // {n}] AS s FROM v, (SELECT unnest(range({n})) AS part))",
        f"c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, s FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {codes.ENTRIES})",
    ]
    for k in range(codes.ROUNDS + 1):
        far = "list_sum([(p.s[i] - c.s[i]) * (p.s[i] - c.s[i]) FOR i IN range(1, len(p.s) + 1)])"
        parts.append(f"a{k} AS MATERIALIZED (SELECT vec_id, label, part, any_value(p.s) AS s, min({{'far': CAST({far} AS BIGINT), 'entry': entry}}) AS best FROM p JOIN c{k} c USING (part) GROUP BY vec_id, label, part)")
        if k < codes.ROUNDS:
            parts.append(f"u{k} AS (SELECT part, best.entry AS entry, i, sum(s[i]) AS total, count(*) AS m FROM (SELECT part, best, s, unnest(range(1, len(s) + 1)) AS i FROM a{k}) GROUP BY ALL)")
            parts.append(f"m{k} AS (SELECT part, entry, list(CAST((total - ((total % m) + m) % m) // m AS BIGINT) ORDER BY i) AS s FROM u{k} GROUP BY part, entry)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.s, c.s) AS s FROM c{k} c LEFT JOIN m{k} m USING (part, entry))")
    last = f"a{codes.ROUNDS}"
    parts.append(f"r AS (SELECT vec_id, label, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM {last} GROUP BY vec_id, label)")
    parts.append(f"h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{codes.ROUNDS})")
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h"
