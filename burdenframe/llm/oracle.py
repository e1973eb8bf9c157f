"""DuckDB SQL that must give the rows of the registered queries. Values are written out, not taken from the operators."""

from __future__ import annotations

#: Words, line rules and counts of the quality query, set down with DuckDB's list functions.
QUALITY = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t
), w AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l
), f AS (
  SELECT doc_id, line, len(ws) AS n, length(array_to_string(ws, '')) AS chars,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
    CASE
      WHEN len(regexp_extract_all(line, '[|»›•·→]')) * 3 >= len(ws) THEN true
      WHEN len(regexp_extract_all(line, '[#*$%&|<>]')) * 4 > len(ws) THEN true
      WHEN len(regexp_extract_all(line, '[!?]')) > len(ws) THEN true
      WHEN len(ws) < 3 AND NOT regexp_matches(ws[-1], '[.!?…:;,"''”’»)\]]$') THEN true
      WHEN len(ws) < 40 AND regexp_matches(lower(line), 'all rights reserved|accept cookies|apache license|cookie policy|creative commons|enable javascript|general public license|licensed under|mit license|privacy policy|released under the|sign up for our newsletter|subscribe to our newsletter|terms of service|terms of use') THEN true
      WHEN len(regexp_extract_all(line, '\p{Lu}')) >= 10
        AND len(regexp_extract_all(line, '\p{Lu}')) > len(regexp_extract_all(line, '\p{Ll}')) THEN true
      ELSE len(ws) >= 8 AND len(list_distinct(ws)) * 4 < len(ws)
    END AS bad
  FROM w WHERE len(ws) > 0
), s AS (
  SELECT doc_id, sum(n) AS n_words, sum(chars) AS word_chars, sum(symbols) AS n_symbols,
    count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS n_lines_removed,
    coalesce(sum(chars) FILTER (bad), 0) AS lost_chars
  FROM f GROUP BY doc_id
), a AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t
), g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'i': i, 'k': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]})) AS x
  FROM a WHERE len(ws) >= 3
), v AS (
  SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.k) AS times FROM g
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM v WHERE times > 1) GROUP BY doc_id
), q AS (
  SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    coalesce(n_symbols, 0)::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed,
    coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM t LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 40 * word_chars AS kept
FROM q
"""


def spans(kinds: dict[str, tuple[str, str]], table: str) -> str:
    """Spans of ``table`` (doc_id, text): per kind a pattern and a condition on the match ``v`` with ``text``, ``b`` and ``e`` at hand.

    Starts follow from the lengths of the matches and of what lies between them.
    """
    parts = []
    for order, (kind, (pattern, condition)) in enumerate(kinds.items()):
        quoted = pattern.replace("'", "''")
        parts.append(f"""
            SELECT doc_id, '{kind}' AS kind, {order} AS o, b, e FROM (
                SELECT doc_id, text, m[i] AS v, b, b + length(m[i]) AS e FROM (
                    SELECT doc_id, text, m, i,
                        list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b
                    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
                        SELECT doc_id, text, regexp_extract_all(text, '{quoted}') AS m, string_split_regex(text, '{quoted}') AS g FROM {table}
                    ) WHERE len(m) > 0))) WHERE {condition}""")
    return " UNION ALL ".join(parts)


def digest(kinds: dict[str, tuple[str, str]], base: int, more: str = "") -> str:
    """Counts of the first ``base`` kinds, the hash of their spans and all spans as text, per document."""
    names = list(kinds)
    text = "kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in names[:base])
    joined = f"coalesce(string_agg({text}, ',' ORDER BY b, o) FILTER (o < {base}), '')"
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        f AS ({spans(kinds, 't')})
        SELECT t.doc_id, {counts}, sha256({joined}) AS base_sha256, coalesce(string_agg({text}, ',' ORDER BY b, o) FILTER (o IS NOT NULL), '') AS spans{more}
        FROM t LEFT JOIN f ON t.doc_id = f.doc_id GROUP BY t.doc_id, t.text"""


#: Patterns and conditions of personal data, plainly.
_LUHN = "(list_sum(list_transform(string_split(reverse(regexp_replace(v, '[^0-9]', '', 'g')), ''), lambda c, i: CASE WHEN i % 2 = 0 THEN c::INT * 2 - CASE WHEN c::INT > 4 THEN 9 ELSE 0 END ELSE c::INT END)) % 10 = 0)"
_DIGITS = "length(regexp_replace(v, '[^0-9]', '', 'g'))"
_NEAR = "regexp_matches(lower(substr(text, greatest(b - 40, 0)::BIGINT + 1, (b - greatest(b - 40, 0))::BIGINT) || chr(10) || substr(text, e::BIGINT + 1, 40)), '{}')"
_ACCOUNT = "replace(v, ' ', '')"
_MOD = (
    f"(length({_ACCOUNT}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(array_to_string(list_transform("
    f"string_split(substr({_ACCOUNT}, 5) || substr({_ACCOUNT}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), ''), ''), "
    "lambda c: c::BIGINT)), lambda a, c: (a * 10 + c) % 97) = 1)"
)
PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(v, '.'), lambda p: TRY_CAST(p AS HUGEINT))) <= 255 AND NOT list_contains(list_transform(string_split(v, '.'), lambda p: TRY_CAST(p AS HUGEINT) IS NULL), true)"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"{_DIGITS} BETWEEN 14 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"{_DIGITS} BETWEEN 10 AND 15"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _MOD),
    "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", f"NOT regexp_matches(v, '^(?:000|666|9)|-00-|-0000$') AND {_NEAR.format(chr(92) + 'bssn' + chr(92) + 'b|social security')}"),
    "local_phone": (r"\b[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b", _NEAR.format("phone|tel|call|mobile|fax")),
}
#: Patterns and conditions of secrets, plainly.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_BEARER = r"\b[Bb]earer\x20+([A-Za-z0-9._~+/=-]{20,})"
_ENTROPY = f"(list_sum(list_transform(list_distinct(string_split(regexp_extract(v, '{_BEARER}', 1), '')), lambda c: -ln(len(list_filter(string_split(regexp_extract(v, '{_BEARER}', 1), ''), lambda d: d = c)) / length(regexp_extract(v, '{_BEARER}', 1))::DOUBLE) / ln(2) * len(list_filter(string_split(regexp_extract(v, '{_BEARER}', 1), ''), lambda d: d = c)) / length(regexp_extract(v, '{_BEARER}', 1))::DOUBLE)) >= 3)"
SECRETS = {
    "assign": (_ASSIGN, "length(regexp_extract(v, '" + _ASSIGN.replace("'", "''") + "', 1)) >= 6"),
    "access": (r"AKIA[A-Z0-9]+", "length(v) >= 20"),
    "hex": (r"[0-9a-f]+", "length(v) >= 24"),
    "private_key": (r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----(?:[^-]*-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?", "true"),
    "code_host": (r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", "true"),
    "chat": (r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    "web_token": (r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    "cloud": (r"\bAIza[A-Za-z0-9_-]{35}", "true"),
    "payment": (r"\b[sr]k_live_[A-Za-z0-9]{16,}", "true"),
    "url_password": (r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:([^\s/:@]{3,200})@", "true"),
    "bearer": (_BEARER, _ENTROPY),
}

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(root, node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT root, b FROM reach JOIN edges ON node = a WHERE b > root
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) m ON m.node = w.doc_id
"""

#: Words with CRC-32 bit by bit, single edits by words with one letter masked or left out, forms followed by recursion.
SPELLING = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL
), r AS (
  SELECT doc_id, run, count(*) AS k, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS b FROM t WHERE length(run) >= 6 GROUP BY doc_id, run
), crc AS (
  SELECT list(c ORDER BY v) AS steps FROM (
    SELECT v, list_reduce(list_prepend(v, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM range(256) g(v))
), h AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT)),
    lambda x, y: xor(x // 256, steps[xor(x % 256, y) + 1]))) AS h
  FROM r, crc
), w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5
), cut AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w
), part AS (
  SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS kept, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM cut
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM part a JOIN part b ON a.kept = b.kept AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM part a JOIN w b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM part a JOIN w b ON a.less = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN top >= 5 * w.n THEN (SELECT min(encode(other)) FROM pairs p WHERE p.word = w.word AND p.other_n = top) END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM w LEFT JOIN best USING (word)
), named AS (
  SELECT word, n, n_near, decode(form) AS form, form_n FROM formed
), way AS (
  SELECT word, word AS at FROM w
  UNION ALL SELECT way.word, named.form FROM way JOIN named ON named.word = way.at WHERE named.form IS NOT NULL
)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n
FROM named f JOIN way USING (word) JOIN named l ON l.word = way.at WHERE l.form IS NULL
"""

ORACLE: dict[str, str] = {
    "op2_line_quality": QUALITY,
    "op3_exact_top_k": TOP_K,
    "op6_personal_data": digest(PERSONAL, 4),
    "op8_ngram_jaccard_join": JACCARD,
    "op10_secret_ledger": digest(SECRETS, 3, ", sha256(t.text) AS blob"),
    "op13_spelling_variants": SPELLING,
}
