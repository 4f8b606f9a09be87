"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_LETTERS}', CAST(1 + ((v{part} >> {35 - 5 * i}) & 31) AS BIGINT), 1)" for part in range(4) for i in range(8))

WARC = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
  v AS (SELECT *, {", ".join(f"CAST('0x' || substr(h, {1 + 10 * k}, 10) AS BIGINT) AS v{k}" for k in range(4))}, max(page_id) OVER (PARTITION BY html) AS first FROM p)
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to, url FROM v"""

SUBSTRINGS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
  f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s), g AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE least < doc_id),
  b AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM g),
  n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM b),
  r AS (SELECT doc_id, k, min(i) AS lo, max(i) + 50 AS hi FROM n GROUP BY doc_id, k), x AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM r),
  a AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept FROM x JOIN d USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: kind, pattern, what must be left of a match without its head, and how long that must be.
_KINDS = (
    ("assign", rf"(?:{_NAMES})[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9+/_.=-]+", rf"^(?:{_NAMES})[\"'']?\x20*[:=]\x20*[\"'']?", 6),
    ("access", "AKIA[A-Z0-9]+", "^", 20),
    ("hex", "[0-9a-f]+", "^", 24),
    ("forge", "gh[opsu]_[A-Za-z0-9]+", "^", 40),
    ("chat", "xox[abprs]-[A-Za-z0-9-]+", "^", 20),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "^", 1),
)


def _spans(order: int, kind: str, pattern: str, head: str, least: int) -> str:
    """Matches and the parts between them, in turn: a match begins where the lengths of what stands before it end."""
    return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, CAST(list_sum([length(g) FOR g IN gaps[1:j]]) + coalesce(list_sum([length(m) FOR m IN ms[1:j - 1]]), 0) AS BIGINT) AS a, ms[j] AS m
      FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS j FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS ms, regexp_split_to_array(coalesce(text, ''), '{pattern}') AS gaps FROM documents))
      WHERE length(regexp_replace(ms[j], '{head}', '')) >= {least}"""


SECRETS = f"""WITH s AS ({" UNION ALL ".join(_spans(o, *k) for o, k in enumerate(_KINDS))}), t AS (SELECT *, kind || ':' || a || ':' || (a + length(m)) AS span FROM s),
  g AS (SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
    string_agg(span, ',' ORDER BY a, o) FILTER (WHERE o < 3) AS base, string_agg(span, ',' ORDER BY a, o) AS spans FROM t GROUP BY doc_id)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)"""


def _weak_rules() -> str:
    """Counts, votes and the model of ``weak_rules``, its rounds as a recursive query over one row of parameters."""
    from ravelin.llm import weak_rules as w

    rules = range(1, len(w.RULES) + 1)
    less = "length(translate({0}, '{1}', ''))".format
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    votes = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {r.ratio} <= {r.good} THEN 1 WHEN {r.ratio} >= {r.bad} THEN -1 ELSE 0 END" for r in w.RULES)
    weigh = "list_sum([CASE WHEN {v}[r] = 1 THEN ln(a[r] / (1 - b[r])) WHEN {v}[r] = -1 THEN ln((1 - a[r]) / b[r]) ELSE 0.0 END FOR r IN range(1, {n})])".format
    odds = lambda v: f"1 / (1 + exp(-(ln(prior / (1 - prior)) + {weigh(v=v, n=len(rules) + 1)})))"
    each = lambda r, test, q, less: f"({less} + list_sum([CASE WHEN ps[i].votes[{r}] {test} THEN ps[i].n * {q} ELSE 0.0 END FOR i IN range(1, len(ps) + 1)]))"
    a = ", ".join(f"{each(r, '= 1', 'qs[i]', w.BELIEF_A[0])} / {each(r, '<> 0', 'qs[i]', sum(w.BELIEF_A))}" for r in rules)
    b = ", ".join(f"{each(r, '= -1', '(1 - qs[i])', w.BELIEF_B[0])} / {each(r, '<> 0', '(1 - qs[i])', sum(w.BELIEF_B))}" for r in rules)
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  wl AS (SELECT doc_id, [x FOR x IN string_split(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ') IF x <> ''] AS ws FROM d),
  g AS (SELECT doc_id, i, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM wl)),
  c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM g), o AS (SELECT DISTINCT doc_id, i + k AS at FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
  rp AS (SELECT doc_id, count(*) AS n_repeat_words FROM o GROUP BY doc_id),
  ln AS (SELECT doc_id, [x FOR x IN string_split(t, chr(10)) IF length(translate(x, {space}, '')) > 0] AS ls FROM d),
  m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(translate(t, {space}, '')) AS word_chars, length(t) - {less("t", w.SYMBOLS)} AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) - {less("t", w.UPPER)} AS n_upper, length(t) - {less("t", w.LOWER)} AS n_lower,
    length(t) - {less("t", "!?")} AS n_shouts, length(t) - {less("t", "0123456789")} AS n_digits FROM d JOIN wl USING (doc_id) JOIN ln USING (doc_id) LEFT JOIN rp USING (doc_id)),
  v AS (SELECT *, [{votes}] AS votes, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
  pat AS (SELECT list({{'votes': votes, 'n': n}} ORDER BY votes) AS ps FROM (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM v WHERE NOT base_failed GROUP BY votes)),
  em AS (SELECT 0 AS k, CAST({w.PRIOR} AS DOUBLE) AS prior, [CAST({w.START[0]} AS DOUBLE) FOR r IN range({len(rules)})] AS a, [CAST({w.START[1]} AS DOUBLE) FOR r IN range({len(rules)})] AS b UNION ALL
    SELECT k + 1, ({w.BELIEF_PRIOR[0]} + list_sum([ps[i].n * qs[i] FOR i IN range(1, len(ps) + 1)])) / ({sum(w.BELIEF_PRIOR)} + list_sum([p.n FOR p IN ps])), [{a}], [{b}]
    FROM (SELECT em.*, ps, [{odds("p.votes")} FOR p IN ps] AS qs FROM em, pat WHERE k < {w.ROUNDS}))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept, round(q, 6) AS p_quality
  FROM (SELECT v.*, {odds("votes")} AS q FROM v, (SELECT * FROM em WHERE k = {w.ROUNDS}))"""


WEAK_RULES = _weak_rules()


def _crc32(text: str) -> str:
    """The checksum of a string's UTF-8 bytes, by its table of 256 remainders."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    raw = f"hex(encode({text}))"
    steps = f"list_concat([CAST(4294967295 AS BIGINT)], [CAST('0x' || substr({raw}, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length({raw}) // 2)])"
    return f"xor(4294967295, list_reduce({steps}, lambda c, b: xor(c >> 8, {table}[1 + (xor(c, b) & 255)])))"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUNS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FEATURES = "unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))])) AS f"

RESAMPLING = f"""WITH w AS (SELECT doc_id, {_RUNS} AS ws FROM documents), tw AS (SELECT {_RUNS} AS ws FROM benchmark),
  f AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, {_FEATURES} FROM w) GROUP BY ALL), tf AS (SELECT f, count(*) AS n FROM (SELECT {_FEATURES} FROM tw) GROUP BY f),
  h AS (SELECT f, {_crc32("f")} % 10000 AS b FROM (SELECT f FROM f UNION SELECT f FROM tf)),
  s AS (SELECT b, sum(n) AS s FROM f JOIN h USING (f) GROUP BY b), t AS (SELECT b, sum(n) AS t FROM tf JOIN h USING (f) GROUP BY b),
  n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
  g AS (SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (ss + 10000) / ((CAST(s AS DOUBLE) + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), n),
  q AS (SELECT doc_id, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM f JOIN h USING (f) JOIN g USING (b) GROUP BY doc_id),
  d AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS words, CAST(greatest(0, 2 * len(ws) - 1) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN q USING (doc_id)),
  r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM d WHERE words >= 20)
  SELECT d.doc_id, n_features, weight, score, CASE WHEN k <= (SELECT 25 * count(*) // 100 FROM r) THEN k END AS rank FROM d LEFT JOIN r USING (doc_id)"""


def _add(value: str, cost: str, letters: str) -> str:
    """A way and what it costs, as nine digits before its letters, made longer; none stays none."""
    return f"lpad(CAST(CAST(substr({value}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({value}, 10) || '{letters}'"


def _conversations() -> str:
    """The repair as the cheapest ways to four places in the order of roles (nothing, a system, a user, an assistant),
    row by row; what is put in follows on what a row gave."""
    drop = {x: _add(x, "4", "D") for x in ("z", "s", "u", "a")}
    keep = lambda x, letter: f"CASE WHEN NOT gone AND l = '{letter}' THEN {_add(x, 'more', 'K')} END"
    change = lambda x: f"CASE WHEN NOT gone THEN {_add(x, '3 + more', 'R')} END"
    user = ", ".join([drop["u"], *(f(x) for x in ("z", "s", "a") for f in (lambda x: keep(x, "u"), change))])
    space = r"\x20\x09-\x0D"
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations),
  r AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c FROM k),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c) AS i FROM r),
  m AS (SELECT *, left(role, 1) AS l, CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][{space}]*$') THEN 't' ELSE '' END AS fault,
    left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) NOT IN ('su', 'ua', 'au') AS odd FROM o),
  x AS (SELECT *, fault IN ('b', 'd') AS gone, CASE fault WHEN 't' THEN 3 ELSE 0 END AS more FROM m),
  dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS z, CAST(NULL AS VARCHAR) AS s, '000000003I' AS u, '000000006II' AS a FROM conversations UNION ALL
    SELECT conv_id, i, z, s, least(u, {_add("z", "3", "I")}, {_add("s", "3", "I")}, {_add("a", "3", "I")}), least(a, {_add(f"least(u, {_add('z', '3', 'I')}, {_add('s', '3', 'I')})", "3", "I")})
    FROM (SELECT dp.conv_id, x.i, {drop["z"]} AS z, least({drop["s"]}, {keep("z", "s")}) AS s, least({user}) AS u, least({drop["a"]}, {keep("u", "a")}, {change("u")}) AS a FROM dp JOIN x ON dp.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = dp.i + 1)),
  e AS (SELECT conv_id, arg_max(least(z, a), i) AS best FROM dp GROUP BY conv_id), v AS (SELECT conv_id, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM e),
  p AS (SELECT conv_id, substr(audit, j, 1) AS edit, length(replace(substr(audit, 1, j), 'I', '')) AS i, length(replace(substr(audit, 1, j), 'D', '')) AS place FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM v)),
  y AS (SELECT p.*, x.role, x.text, coalesce(max(CASE WHEN place = 1 AND edit = 'K' AND x.l = 's' THEN 1 END) OVER (PARTITION BY p.conv_id), 0) AS sys FROM p LEFT JOIN x ON p.conv_id IS NOT DISTINCT FROM x.conv_id AND p.i = x.i AND edit <> 'I' WHERE edit <> 'D'),
  t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS body FROM y GROUP BY conv_id),
  c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (odd) AS illegal FROM m GROUP BY conv_id)
  SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
  FROM v LEFT JOIN c ON v.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON v.conv_id IS NOT DISTINCT FROM t.conv_id"""


CONVERSATIONS = _conversations()
