"""DuckDB SQL of conversation repair (crc32 and all, a state per place and message) and of exact k-means by full scans."""

from __future__ import annotations


def _entry(parts: list[str]) -> str:
    """The least of several (cost, audit, text) entries."""
    return f"list_min([{', '.join(parts)}])"


def _plus(e: str, cost: str, initial: str, line: str = "''") -> str:
    return f"struct_pack(cost := {e}.cost + {cost}, audit := {e}.audit || {initial}, done := {e}.done || {line})"


def _message(role: str, to: str) -> str:
    """Keep or re-role into ``role`` from entry ``to``; blank and duplicate messages cost too much to stay."""
    keep = f"CASE WHEN m.i0 = '{role[0]}' THEN 0 ELSE 3 END"
    cost = f"({keep} + CASE m.fault WHEN 't' THEN 3 WHEN '-' THEN 0 ELSE 1000000000 END)"
    line = f"(chr(10) || CASE WHEN m.i0 = '{role[0]}' THEN m.role ELSE '{role}' END || ':' || m.text)"
    return _plus(to, cost, f"CASE WHEN m.i0 = '{role[0]}' THEN 'K' ELSE 'R' END", line)


def _inserted(e: str, role: str) -> str:
    return _plus(e, "3", "'I'", f"(chr(10) || '{role}:')")


def _closure(alias: str) -> str:
    e = [f"{alias}.e{p}" for p in range(4)]
    n2 = _entry([e[2], _inserted(e[0], "user"), _inserted(e[1], "user"), _inserted(e[3], "user")])
    return f"{e[0]} AS n0, {e[1]} AS n1, {n2} AS n2, {_entry([e[3], _inserted(n2, 'assistant')])} AS n3"


_NEVER = "struct_pack(cost := 1000000000, audit := '', done := '')"
_NOTHING = "struct_pack(cost := 0, audit := '', done := '')"
_SYSTEM = _plus("w.n0", "(CASE WHEN m.i0 = 's' THEN CASE m.fault WHEN 't' THEN 3 WHEN '-' THEN 0 ELSE 1000000000 END ELSE 1000000000 END)",
                "'K'", "(chr(10) || m.role || ':' || m.text)")
_STEP = ", ".join([
    _plus("w.n0", "4", "'D'") + " AS e0",
    _entry([_plus("w.n1", "4", "'D'"), _SYSTEM]) + " AS e1",
    _entry([_plus("w.n2", "4", "'D'"), *[_message("user", f"w.n{p}") for p in (0, 1, 3)]]) + " AS e2",
    _entry([_plus("w.n3", "4", "'D'"), _message("assistant", "w.n2")]) + " AS e3"])

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE bits AS (SELECT b, 0 AS k, b AS v FROM (SELECT unnest(range(256)) AS b)
    UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT b, v FROM bits WHERE k = 8),
keys AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
walk AS (SELECT s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM keys
    UNION ALL SELECT s, i + 1, xor(c >> 8, v) FROM walk JOIN crc ON b = xor(c & 255, ascii(s[i + 1])) WHERE i < length(s)),
how AS (SELECT s, xor(c, 4294967295) % 20 AS h FROM walk WHERE i = length(s)),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, h FROM conversations
    JOIN how ON s = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
hurt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM hurt),
msg AS MATERIALIZED (SELECT conv_id, turn, role, text, i, role[1:1] AS i0, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
    WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '-' ELSE 't' END AS fault FROM placed),
paths AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {_closure('z')} FROM (
        SELECT DISTINCT conv_id, {_NOTHING} AS e0, {_NEVER} AS e1, {_NEVER} AS e2, {_NEVER} AS e3 FROM conversations) z
    UNION ALL SELECT conv_id, i, {_closure('y')} FROM (
        SELECT w.conv_id, m.i, {_STEP} FROM paths w JOIN msg m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1) y),
ended AS (SELECT conv_id, {_entry(['n0', 'n3'])} AS best FROM paths
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
pairs AS (SELECT conv_id, turn, fault, lag(i0) OVER (PARTITION BY conv_id ORDER BY i) || i0 AS two FROM msg),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
    CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit,
    sha256(best.done[2:]) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def _nearest(n: int) -> str:
    return f"""
d{n} AS (SELECT x.rid, c.j, sum((x.v[i] - c.v[i]) * (x.v[i] - c.v[i])) AS d FROM x, c{n} c, (SELECT unnest(range(1, 65)) AS i) GROUP BY x.rid, c.j),
a{n} AS (SELECT rid, min(j) AS j, min(d) AS d FROM (SELECT *, min(d) OVER (PARTITION BY rid) AS m FROM d{n}) WHERE d = m GROUP BY rid)"""


def _moved(n: int) -> str:
    return f"""
c{n + 1} AS (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
    SELECT j, list((s - (s % k + k) % k) // k ORDER BY i) AS v FROM (SELECT a.j, i, CAST(sum(x.v[i]) AS BIGINT) AS s, count(*) AS k
        FROM a{n} a JOIN x USING (rid), (SELECT unnest(range(1, 65)) AS i) GROUP BY a.j, i) GROUP BY j) m USING (j))"""


NS_BOUNDS = """
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v FROM (
    SELECT v, sha256('1:' || vec_id) AS h FROM x WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16)),""" + ",".join(
    _nearest(n) + ("," + _moved(n) if n < 3 else "") for n in range(4)) + """
SELECT x.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
    CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a3 a JOIN x USING (rid) JOIN c3 c ON c.j = a.j
"""
