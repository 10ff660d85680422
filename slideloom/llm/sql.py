"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from . import mixing, quality

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_BENCH_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def mix_sources(rounds: int = mixing.ROUNDS, budget: float = mixing.BUDGET, tolerance: float = mixing.TOLERANCE) -> str:
    """Raking unrolled: one table of factors for each dimension and round; after a round within tolerance factors stay."""
    dims = list(mixing.POWERS)
    steps = [
        f"""d AS (SELECT doc_id, source, lang, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN (length(text) - length(replace(text, '|', ''))) * 40 > length(text) THEN 'table'
        WHEN (length(text) - length(regexp_replace(text, '[#*$%&<>]', '', 'g'))) * 25 > length(text) THEN 'symbols' WHEN contains(text, 'icensed under') OR contains(text, 'ights reserved') THEN 'licensed'
        WHEN contains(text, '@') THEN 'contact' WHEN length(text) < 600 THEN 'short' ELSE 'prose' END AS topic, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS tokens FROM documents)""",
        "c AS MATERIALIZED (SELECT coalesce(source, chr(0)) AS source, coalesce(lang, chr(0)) AS lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    for dim in dims:
        steps.append(
            f"""t_{dim} AS MATERIALIZED (SELECT {dim}, h, p / sum(p) OVER () AS t, {budget} * sum(h) OVER () AS b
            FROM (SELECT {dim}, sum(tokens) AS h, pow(sum(tokens), {mixing.POWERS[dim]}) AS p FROM c GROUP BY 1)), l_{dim}_0 AS (SELECT max(b) AS l FROM t_{dim})"""
        )
        for k in range(1, mixing.LEVEL_STEPS + 1):
            full = f"h <= (SELECT l FROM l_{dim}_{k - 1}) * t"
            steps.append(
                f"l_{dim}_{k} AS MATERIALIZED (SELECT CASE WHEN sum(t) FILTER (NOT {full}) > 0 THEN (max(b) - coalesce(sum(h) FILTER ({full}), 0)) / sum(t) FILTER (NOT {full}) ELSE (SELECT l FROM l_{dim}_{k - 1}) END AS l FROM t_{dim})"
            )
        first = budget if dim == dims[0] else 1.0
        steps.append(f"f_{dim}_0 AS MATERIALIZED (SELECT {dim}, goal, CASE WHEN goal >= h THEN {mixing.FULL} ELSE {first} END::DOUBLE AS f, 1e300 AS gap FROM (SELECT *, least(h, (SELECT l FROM l_{dim}_{mixing.LEVEL_STEPS}) * t) AS goal FROM t_{dim}))")
    steps.append(f"e_0 AS (SELECT false AS ok), s AS (SELECT sum(goal) AS s FROM f_{dims[0]}_0)")
    for k in range(1, rounds + 1):
        for at, dim in enumerate(dims):
            tables = {o: f"f_{o}_{k if i < at else k - 1}" for i, o in enumerate(dims)}
            joins = " ".join(f"JOIN {table} ON {table}.{o} = c.{o}" for o, table in tables.items())
            product = " * ".join(f"{table}.f" for table in tables.values())
            step = "CASE WHEN p.goal < r.reached THEN p.goal / r.reached WHEN r.open > 0 THEN (p.goal - r.full_) / r.open ELSE 1.0 END"
            steps.append(
                f"""f_{dim}_{k} AS MATERIALIZED (SELECT p.{dim}, p.goal, CASE WHEN (SELECT ok FROM e_{k - 1}) THEN p.f ELSE p.f * {step} END AS f, abs(p.goal - r.reached) AS gap FROM f_{dim}_{k - 1} p
                JOIN (SELECT {dim}, sum(tokens * least(w, 1.0)) AS reached, coalesce(sum(tokens) FILTER (w >= 1), 0) AS full_, coalesce(sum(tokens * w) FILTER (w < 1), 0) AS open FROM (SELECT c.*, {product} AS w FROM c {joins}) GROUP BY 1) r USING ({dim}))"""
            )
        gap = f"greatest({', '.join(f'(SELECT max(gap) FROM f_{dim}_{k})' for dim in dims)})"
        steps.append(f"e_{k} AS MATERIALIZED (SELECT (SELECT ok FROM e_{k - 1}) OR {gap} <= {tolerance} * (SELECT s FROM s) AS ok)")
    joins = " ".join(f"JOIN f_{o}_{rounds} USING ({o})" for o in dims)
    product = " * ".join(f"f_{o}_{rounds}.f" for o in dims)
    steps.append(f"w AS (SELECT {', '.join(dims)}, CASE WHEN tokens > 0 THEN least({product}, 1.0) ELSE 0 END AS probability FROM c {joins})")
    return (
        f"WITH {', '.join(steps)}, p AS (SELECT d.*, w.probability FROM d JOIN w ON coalesce(d.source, chr(0)) = w.source AND coalesce(d.lang, chr(0)) = w.lang AND d.topic = w.topic) "
        f"SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(probability / {budget}, 6) AS weight, round(probability, 6) AS probability, "
        "('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 < probability AS kept FROM p"
    )


def quality_rules(max_rate: float = quality.MAX_HOST_RATE) -> str:
    rules = {
        "few": "n_words < 50",
        "repeats": "100 * n_repeat_words > 50 * n_words",
        "symbols": "n_symbols > 0.25 * n_words",
        "lines": "n_dup_lines > 0.3 * per",
        "length": "NOT word_chars / per BETWEEN 2 AND 20",
    }
    counts = ", ".join(f"count(*) FILTER ({failed}) AS k_{r}" for r, failed in rules.items())
    moments = ", ".join(f"sum(k_{r}) / sum(n) AS m_{r}, sum(k_{r} * k_{r} / n) / sum(n) AS w_{r}" for r in rules)
    strength = "least(greatest(m_{0} * (1 - m_{0}) / greatest(w_{0} - m_{0} * m_{0} - m_{0} * (1 - m_{0}) / size, 1e-6) - 1, 1.0), 1000.0)"
    priors = ", ".join(f"m_{r}, {strength.format(r)} AS s_{r}" for r in rules)
    verdict = " AND ".join(f"(k_{r} + m_{r} * s_{r}) / (n + s_{r}) <= {max_rate}" for r in rules)
    return f"""WITH t AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents), s AS (SELECT *, regexp_extract_all(text, {_WORD}) AS w FROM t),
        i AS (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM s), g AS (SELECT id, i, count(*) OVER (PARTITION BY id, w[i], w[i + 1], w[i + 2]) AS n FROM i),
        r AS (SELECT id, count(DISTINCT p) AS n_repeat_words FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY id),
        m AS (SELECT id, doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS l FROM s),
        b AS (SELECT m.*, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r USING (id)),
        j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS per FROM b),
        h AS (SELECT source, count(*) AS n, {counts} FROM j GROUP BY source),
        q AS (SELECT sum(n) / count(*) AS size, {moments} FROM h), v AS (SELECT {priors} FROM q),
        o AS (SELECT source, {verdict} AS ok FROM h CROSS JOIN v)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND ok AS kept
        FROM j JOIN o ON j.source IS NOT DISTINCT FROM o.source"""


def decontaminate(window: int = 10) -> str:
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_BENCH_WORD}) AS w FROM documents),
        b AS (SELECT item_id, w, least(len(w), {window}) AS m FROM (SELECT item_id, regexp_extract_all({_LOWER}, {_BENCH_WORD}) AS w FROM benchmark) WHERE len(w) > 0),
        k AS (SELECT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
        x AS (SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM b)),
        f AS (SELECT DISTINCT doc_id, x.i, x.m, item_id FROM x JOIN k ON k.m = x.m AND k.g = array_to_string(x.w[x.i:x.i + x.m - 1], ' ')),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM f) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM f) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Rounds unrolled: one table of codebook entries for each.  Vectors of the first one's length only."""
    distance = "list_sum(list_transform(list_zip(p.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = f"SELECT id, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT p.id, p.part, c.e, {distance} AS d FROM p JOIN {{c}} c USING (part)) GROUP BY id, part"
    floored = "CASE WHEN sum(x) % count(*) < 0 THEN (sum(x) - sum(x) % count(*) - count(*)) // count(*) ELSE sum(x) // count(*) END"
    steps = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS id, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
        WHERE len(v) % {parts} = 0), n AS (SELECT len(v) AS n, len(v) // {parts} AS w FROM k ORDER BY id LIMIT 1)""",
        f"""p AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY id) AS id, vec_id, label, part, v[part * w + 1 : (part + 1) * w] AS s FROM k, n, range({parts}) r(part) WHERE len(v) = n)""",
        f"c_0 AS MATERIALIZED (SELECT part, id - 1 AS e, s FROM p WHERE id <= {entries})",
    ]
    for r in range(1, rounds + 1):
        old = f"c_{r - 1}"
        steps.append(f"a_{r} AS MATERIALIZED ({nearest.format(c=old)})")
        steps.append(
            f"""m_{r} AS MATERIALIZED (SELECT part, e, list(CAST(x AS BIGINT) ORDER BY i) AS s FROM (SELECT part, e, i, {floored} AS x
            FROM (SELECT part, e, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM p JOIN a_{r} USING (id, part)) GROUP BY part, e, i) GROUP BY part, e)"""
        )
        steps.append(f"c_{r} AS MATERIALIZED (SELECT part, e, coalesce(m_{r}.s, {old}.s) AS s FROM {old} LEFT JOIN m_{r} USING (part, e))")
    last = f"c_{rounds}"
    steps.append(f"f AS MATERIALIZED ({nearest.format(c=last)})")
    steps.append("""o AS (SELECT any_value(p.vec_id) AS vec_id, any_value(p.label) AS label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f JOIN p USING (id, part) GROUP BY id)""")
    digest = f"(SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, e)) FROM {last})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM o"


def fill_middle(seed: str = "1", percent: int = 90, suffix_first: int = 20) -> str:
    """Units as lists; the original is rebuilt from the output by the places of its markers."""
    h = ", ".join(f"CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * i + 1}, 8) AS UBIGINT) AS h{i + 1}" for i in range(4))
    plain = f"n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {percent}"
    between = lambda a, b: f"substr(output, instr(output, '{a}') + 3, instr(output, '{b}') - instr(output, '{a}') - 3)"
    after = "substr(output, instr(output, '<M>') + 3)"
    return f"""WITH u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, {h} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST(least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS b FROM u),
    s AS (SELECT doc_id, text, n, CASE WHEN {plain} THEN 'plain' WHEN h4 % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c),
    o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM s)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
        sha256(output) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {between('<P>', '<S>')} || {after} || {between('<S>', '<M>')} ELSE {between('<P>', '<M>')} || {after} || {between('<S>', '<P>')} END) AS restored_sha256
    FROM o"""
