"""DuckDB texts of those corpus queries that SQL can express."""

from __future__ import annotations

_SAID = "'</s>[INST] ok [/INST]'"
_ESCAPED = r"length(regexp_replace({0}, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\])', '\1\\\2\3', 'g'))"
_ROLE = r"replace(replace(role, '\', '\\'), chr(10), '\n')"

CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_SAID}
  UNION ALL SELECT -1, 1, 'assistant', {_SAID})
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + {_ESCAPED.format(_ROLE)} + {_ESCAPED.format('text')}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def _words(table: str, key: str) -> str:
    return f"""(SELECT {key}, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
        FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL)"""


_RUNS = "unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS shingle"

CONTAMINATION = f"""
WITH items AS (SELECT *, least(len(w), 5) AS width FROM {_words('benchmark', 'item_id')} WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, {_RUNS} FROM items),
d AS (SELECT DISTINCT doc_id, {_RUNS} FROM {_words('documents', 'doc_id')}, (SELECT DISTINCT width FROM items)),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM d JOIN i USING (shingle) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 5 >= n_shingles * 4"""

SEARCH = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5"""


# Kinds: name, pattern in RE2, the group that is the secret, its least length.
_KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
               r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("key", r"\b(gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|xox[abprs]-[A-Za-z0-9-]{20,}"
            r"|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,})", 0, 16),
)


def _kind(number: int) -> str:
    _, pattern, group, least = _KINDS[number]
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT doc_id, owner, {number} AS k, start, start + length(w) AS stop, v FROM (
    SELECT doc_id, owner, m[i] AS w, v[i] AS v,
           coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT doc_id, coalesce(source, '') AS owner, regexp_extract_all(text, {quoted}, 0) AS m,
                 regexp_extract_all(text, {quoted}, {group}) AS v, string_split_regex(text, {quoted}) AS p
          FROM documents WHERE regexp_matches(text, {quoted})) AS found, unnest(range(1, len(m) + 1)) AS t(i)
    WHERE length(v[i]) >= {least})"""


def _secrets() -> str:
    names = "[" + ", ".join(f"'{k[0]}'" for k in _KINDS) + "][k + 1]"
    base = ("assign", "access", "hex")
    each = f"{names} || ':' || start || ':' || stop, ',' ORDER BY start, k"
    counts = ", ".join(f"coalesce(count(*) FILTER (k = {n}), 0) AS n_{kind}" for n, kind in enumerate(base))
    verdict = ("CASE WHEN n_owners >= 5 OR n_owners >= 2 AND n_repositories >= 100 THEN 'copied'"
               " WHEN len(list_distinct(string_split(v, ''))) >= 6 AND NOT regexp_matches(lower(v),"
               " 'example|sample|changeme|dummy|placeholder|your|xxxx|redacted') THEN 'live' ELSE 'sample' END")
    tallies = ", ".join(f"count(*) FILTER (verdict = '{v}') AS n_{v}" for v in ("live", "copied", "sample"))
    return f"""
WITH spans AS ({' UNION ALL '.join(_kind(n) for n in range(len(_KINDS)))}),
owners AS (SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT doc_id) AS n_repositories FROM spans GROUP BY v),
judged AS (SELECT *, {verdict} AS verdict FROM spans JOIN owners USING (v)),
held AS (SELECT doc_id, {counts}, string_agg({each}) FILTER (k < 3) AS base, string_agg({each}) AS spans, {tallies}
         FROM judged GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in base)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(n_sample, 0) AS n_sample
FROM documents d LEFT JOIN held USING (doc_id)"""


SECRETS = _secrets()


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: eight steps a character."""
    bits = f"list_transform(range(0, 8 * length({text})), lambda i: (ascii(substr({text}, i // 8 + 1, 1)) >> (i % 8)) & 1)"
    step = "lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_transform({bits}, lambda x: CAST(x AS BIGINT)), {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


_FAULT = f"""{_crc32("place")} % 20"""

#: Steps over insertions (state, how many, state after, roles) and what a row's edit leads to.
REPAIR = rf"""
WITH RECURSIVE placed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
faults AS (SELECT *, {_FAULT} AS fault FROM placed),
damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faults, unnest(range(0, CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copies(c) WHERE fault <> 0),
cored AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS core FROM damaged),
numbered AS (
  SELECT *, row_number() OVER w AS n, lag(role[1]) OVER w AS before
  FROM cored WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS times FROM numbered),
marked AS (
  SELECT conv_id, turn, role, text, n, before, CASE WHEN core = '' THEN 'blank' WHEN times > 1 THEN 'duplicate'
    WHEN core[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS flaw FROM seen),
counts AS (
  SELECT conv_id, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (flaw = 'blank') AS blank, count(*) FILTER (flaw = 'duplicate') AS duplicate,
         count(*) FILTER (flaw = 'truncated') AS truncated,
         count(*) FILTER (n > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
gaps(state, times, after, turns) AS (VALUES
  (0, 0, 0, []), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']),
  (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
  (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']),
  (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])),
edits(letter, state, initial, after, cost, role) AS (VALUES
  ('K', 0, 's', 1, 0, NULL), ('K', 0, 'u', 2, 0, NULL), ('K', 1, 'u', 2, 0, NULL), ('K', 3, 'u', 2, 0, NULL),
  ('K', 2, 'a', 3, 0, NULL), ('R', 0, NULL, 2, 3, 'user'), ('R', 1, NULL, 2, 3, 'user'), ('R', 3, NULL, 2, 3, 'user'),
  ('R', 2, NULL, 3, 3, 'assistant'), ('D', 0, NULL, 0, 4, NULL), ('D', 1, NULL, 1, 4, NULL), ('D', 2, NULL, 2, 4, NULL),
  ('D', 3, NULL, 3, 4, NULL)),
ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS turns FROM counts
  UNION ALL
  SELECT conv_id, n, state, cost, audit, turns FROM (
    SELECT m.conv_id, m.n, e.after AS state,
           w.cost + 3 * g.times + e.cost + CASE WHEN e.letter <> 'D' AND m.flaw = 'truncated' THEN 3 ELSE 0 END AS cost,
           w.audit || repeat('I', g.times) || e.letter AS audit,
           list_concat(w.turns, g.turns, CASE WHEN e.letter = 'D' THEN [] ELSE [coalesce(e.role, m.role) || ':' || m.text] END) AS turns
    FROM ways w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n + 1
    JOIN gaps g ON g.state = w.state JOIN edits e ON e.state = g.after
    WHERE (e.initial IS NULL OR e.initial = m.role[1]) AND (e.letter = 'D' OR m.flaw IN ('truncated', 'fine')))
  QUALIFY row_number() OVER (PARTITION BY conv_id, n, state ORDER BY cost, audit) = 1),
ends AS (
  SELECT w.conv_id, w.cost + 3 * g.times AS cost, w.audit || repeat('I', g.times) AS audit,
         array_to_string(list_concat(w.turns, g.turns), chr(10)) AS repaired
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n_rows = w.n
  JOIN gaps g ON g.state = w.state AND g.after IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * g.times, w.audit || repeat('I', g.times)) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""

TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
seqs AS (
  SELECT conv_id, list(struct_pack(said := md5(length(role) || ':' || role || text), size := strlen(text))
                       ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS said
  FROM turns GROUP BY conv_id),
shared AS (SELECT conv_id, said, {_crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM seqs),
rebuilt AS (
  SELECT s.conv_id, list_concat(list_slice(coalesce(b.said, []), 1, s.h), list_slice(s.said, s.h + 1, len(s.said))) AS said
  FROM shared s LEFT JOIN seqs b ON b.conv_id = s.conv_id - s.conv_id % 5),
prefixes AS (
  SELECT conv_id, d AS depth, list_transform(list_slice(said, 1, d), lambda x: x.said) AS key,
         CASE WHEN d = 0 THEN 0 ELSE said[d].size END AS size, d = len(said) AS ends
  FROM rebuilt, unnest(range(0, len(said) + 1)) AS t(d)),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY key, depth),
births AS (SELECT list_slice(key, 1, depth - 1) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
grown AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN births USING (key)),
subtrees AS (
  SELECT list_slice(key, 1, d) AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM grown, unnest(range(0, depth + 1)) AS t(d) GROUP BY 1)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM grown g JOIN subtrees s ON s.key = g.key
LEFT JOIN nodes p ON g.depth > 0 AND p.depth = g.depth - 1 AND p.key = list_slice(g.key, 1, g.depth - 1)"""
