"""SQL oracles of the operators that SQL can express, in the dialect of DuckDB; written as plain brute force."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}))"


def _codebook_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""
near{turn} AS MATERIALIZED (
  SELECT r, part, min({{'d': list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i])))::BIGINT, 'j': entry}}) AS best
  FROM pieces JOIN book{turn} USING (part) GROUP BY r, part)""")
        if turn < rounds:
            steps.append(f"""
sums{turn} AS (
  SELECT part, n.best.j AS entry, k, floor(sum(v[k])::DOUBLE / count(*))::BIGINT AS m
  FROM pieces JOIN near{turn} n USING (r, part), unnest(range(1, len(v) + 1)) u(k) GROUP BY ALL),
means{turn} AS (SELECT part, entry, list(m ORDER BY k) AS e FROM sums{turn} GROUP BY ALL),
book{turn + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM book{turn} b LEFT JOIN means{turn} m USING (part, entry))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (
  SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) p(part)),
book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v AS e FROM pieces WHERE r <= {entries}),
{",".join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', n.best.j), '' ORDER BY part) AS code, sum(n.best.d)::BIGINT AS error FROM near{rounds} n GROUP BY r),
books AS (
  SELECT sha256(string_agg(c, ',' ORDER BY part, entry)) AS h FROM (SELECT part, entry, array_to_string(e, ',') AS c FROM book{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), books"""


def _host_sql(limit: float = 0.5, z: float = 1.645) -> str:
    levels, keys = [], ""
    for level in ("suffix", "domain", "host"):
        inner = f"{keys}, {level}" if keys else level
        mean = f"JOIN post_{keys.split(', ')[-1]} USING ({keys})" if keys else "CROSS JOIN (SELECT rate AS mean FROM overall)"
        levels.append(f"""
count_{level} AS (SELECT {inner}, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL),
under_{level} AS MATERIALIZED (SELECT c.*, mean, mean * (1 - mean) AS v FROM count_{level} c {mean}),
size_{level} AS MATERIALIZED (
  SELECT 1 / least(greatest(CASE WHEN sum(n * (n - 1) * v) > 0 THEN sum((bad - n * mean) * (bad - n * mean) - n * v) / sum(n * (n - 1) * v) ELSE 0.5::DOUBLE END, 0.0001), 0.5::DOUBLE) - 1 AS m
  FROM under_{level}),
post_{level} AS MATERIALIZED (SELECT {inner}, (bad + m * mean) / (n + m) AS mean, n + m AS size FROM under_{level}, size_{level})""".replace("AS mean, n + m AS size", "AS mean" + (", n + m AS size" if level == "host" else "")))
        keys = inner
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
known AS (
  SELECT doc_id AS page_id, max(greatest((toxic = 1)::INT, (quality = 0)::INT)) AS bad FROM labels WHERE {crc32("doc_id::VARCHAR")} % 4 <> 2 GROUP BY 1),
named AS MATERIALIZED (
  SELECT host, string_split(host, '.')[-1] AS suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
    count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM parts LEFT JOIN known USING (page_id) GROUP BY host),
overall AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) ELSE 0.5::DOUBLE END AS rate FROM named),
{",".join(levels)},
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(verdict, h, p)),
judged AS (
  SELECT parts.*, (SELECT max_by({{'rule': h || p, 'verdict': verdict}}, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS found
  FROM parts)
SELECT page_id, host, path, found.rule AS rule,
  coalesce(found.verdict, CASE WHEN mean - {z}::DOUBLE * sqrt(mean * (1 - mean) / (size + 1)) > {limit} THEN 'block' ELSE 'allow' END) AS verdict,
  round(mean, 6) AS rate, round(greatest(mean - {z}::DOUBLE * sqrt(mean * (1 - mean) / (size + 1)), 0), 6) AS bound
FROM judged JOIN post_host USING (host)"""


def _repair_sql() -> str:
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    far = 1 << 40
    edits = {  # delete, keep and rerole from each state, by the vector behind the row
        "s0": f"least(2 + b.s0, CASE WHEN must THEN {far} ELSE cut + least(1 + b.s2, CASE i WHEN 's' THEN b.s1 WHEN 'u' THEN b.s2 ELSE {far} END) END)",
        "s1": f"least(2 + b.s1, CASE WHEN must THEN {far} ELSE cut + least(1 + b.s2, CASE i WHEN 'u' THEN b.s2 ELSE {far} END) END)",
        "s2": f"least(2 + b.s2, CASE WHEN must THEN {far} ELSE cut + least(1 + b.s3, CASE i WHEN 'a' THEN b.s3 ELSE {far} END) END)",
        "s3": f"least(2 + b.s3, CASE WHEN must THEN {far} ELSE cut + least(1 + b.s2, CASE i WHEN 'u' THEN b.s2 ELSE {far} END) END)",
    }
    inserts = "{'s0': least(x0, 5 + x2, 10 + x3), 's1': least(x1, 5 + x2, 10 + x3), 's2': least(x2, 5 + x3), 's3': least(x3, 5 + x2)}"
    cost = lambda v, s: f"(CASE {s} WHEN 0 THEN {v}.s0 WHEN 1 THEN {v}.s1 WHEN 2 THEN {v}.s2 ELSE {v}.s3 END)"
    into = "(CASE f.state WHEN 2 THEN 3 ELSE 2 END)"
    kept = "(CASE WHEN i = 's' AND f.state = 0 THEN 1 WHEN i = 'u' AND f.state <> 2 THEN 2 WHEN i = 'a' AND f.state = 2 THEN 3 END)"
    return f"""
WITH RECURSIVE filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT *, {crc32("k")} % 20 AS kind FROM filled),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
    rtrim(text, {spaces}) AS bare FROM damaged),
marked AS MATERIALIZED (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS i, bare = '' AS blank,
    bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate,
    bare <> '' AND right(bare, 1) NOT IN ('.', '!', '?') AS open_,
    count(*) OVER (PARTITION BY conv_id) AS n, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
  FROM placed),
faults AS MATERIALIZED (SELECT *, blank OR duplicate AS must, CASE WHEN open_ AND NOT duplicate THEN 5 ELSE 0 END AS cut FROM marked),
back AS (
  SELECT conv_id, n + 1 AS pos, {{'s0': 0::BIGINT, 's1': 10::BIGINT, 's2': 5::BIGINT, 's3': 0::BIGINT}} AS b FROM (SELECT DISTINCT conv_id, n FROM faults)
  UNION ALL
  SELECT conv_id, pos, {inserts} FROM (
    SELECT f.conv_id, f.pos, {edits["s0"]} AS x0, {edits["s1"]} AS x1, {edits["s2"]} AS x2, {edits["s3"]} AS x3
    FROM back JOIN faults f ON f.conv_id IS NOT DISTINCT FROM back.conv_id AND f.pos = back.pos - 1)),
vectors AS MATERIALIZED (SELECT * FROM back),
walked AS (
  SELECT conv_id, 1::BIGINT AS pos, 0 AS state, '' AS audit, []::VARCHAR[] AS texts FROM (SELECT DISTINCT conv_id FROM faults)
  UNION ALL
  SELECT conv_id, pos + (CASE e WHEN 'I' THEN 0 ELSE 1 END), to_, audit || e,
    CASE e WHEN 'D' THEN texts
      WHEN 'K' THEN list_append(texts, role || ':' || text)
      ELSE list_append(texts, (CASE to_ WHEN 2 THEN 'user' ELSE 'assistant' END) || ':' || (CASE e WHEN 'R' THEN text ELSE '' END)) END
  FROM (
    SELECT f.*, w.role, w.text,
      CASE WHEN w.pos IS NOT NULL AND {cost("v.b", "f.state")} = 2 + {cost("x.b", "f.state")} THEN 'D'
        WHEN {cost("v.b", "f.state")} = 5 + {cost("v.b", into)} THEN 'I'
        WHEN NOT w.must AND {kept} IS NOT NULL AND {cost("v.b", "f.state")} = w.cut + {cost("x.b", kept)} THEN 'K'
        WHEN w.pos IS NOT NULL THEN 'R' END AS e,
      CASE e WHEN 'D' THEN f.state WHEN 'K' THEN {kept} ELSE {into} END AS to_
    FROM walked f JOIN vectors v ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND v.pos = f.pos
      LEFT JOIN vectors x ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.pos = f.pos + 1
      LEFT JOIN faults w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.pos = f.pos)
  WHERE e IS NOT NULL),
finals AS (
  SELECT conv_id, arg_max({{'audit': audit, 'text': array_to_string(texts, chr(10))}}, length(audit)) AS a FROM walked GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (open_ AND NOT duplicate) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
costs AS (SELECT conv_id, b.s0 AS cost FROM vectors WHERE pos = 1)
SELECT c.conv_id, coalesce(k.gaps, 0)::BIGINT AS gaps, coalesce(k.blank, 0)::BIGINT AS blank, coalesce(k.duplicate, 0)::BIGINT AS duplicate,
  coalesce(k.truncated, 0)::BIGINT AS truncated, coalesce(k.illegal, 0)::BIGINT AS illegal, coalesce(t.cost, 0)::BIGINT AS cost,
  coalesce(z.a.audit, '') AS audit, sha256(coalesce(z.a.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN costs t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN finals z ON z.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLES: dict[str, str] = {
    "op11_adaptive_bounds": _codebook_sql(),
    "op12_host_reputation": _host_sql(),
    "op13_checkpointed_repair": _repair_sql(),
}
