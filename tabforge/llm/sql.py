"""DuckDB SQL of the registered queries that SQL can express on the given tables."""

SQL = {}

# words, lines and 8-word windows of each text; a window's occurrences make its words repeated
SQL["op1_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS win
        FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(generate_series(0, 7)) AS o) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT w.doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 4 * len(list_filter(words, lambda x: NOT regexp_matches(x, '[\p{L}\p{N}]'))) > n_words
            OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > word_chars
            OR 3 * len(list_filter(words, lambda x: x LIKE '%!!')) > n_words
            OR 20 * list_sum(list_transform(generate_series(0, (len(words) - 1) // 1000), lambda b: len(list_distinct(words[1000 * b + 1:1000 * b + 1000])))) < n_words) AS kept
FROM b"""

SQL["op2_decontamination"] = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN p ON p.win = dw.win AND p.n = dw.n),
words AS (SELECT doc_id, count(DISTINCT j) AS c FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS c, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.c, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.c, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.c, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

SQL["op4_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length(regexp_replace(text, '<(\\*)(/?turn>)', '<\\\1\2', 'g')) AS escaped_text,
             regexp_matches(text, '</?turn>|<\\+/?turn>') OR regexp_matches(role, '</?turn>|\\|\n') AS escaped,
             length(replace(replace(regexp_replace(role, '<(\\*)(/?turn>)', '<\\\1\2', 'g'), '\', '\\'), chr(10), '\n')) AS escaped_role FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN escaped THEN escaped_role + escaped_text ELSE length(role) + length(text) END + 15) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""

SQL["op6_line_dedup"] = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, text, i - 1 AS line, list_filter(string_split(translate(lower(lines[i]), chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> '') AS w
      FROM (SELECT doc_id, text, lines, unnest(generate_series(1, len(lines))) AS i FROM d)),
t AS (SELECT doc_id, line, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))
                                              ELSE [array_to_string(w, ' ')] END) AS s FROM l WHERE len(w) > 0),
c AS (SELECT *, dense_rank() OVER (ORDER BY k) AS class FROM (SELECT doc_id, line, s, array_to_string(list_sort(s), chr(10)) AS k FROM t)),
f AS (SELECT class, any_value(s) AS s, min((doc_id, line)) AS first FROM c GROUP BY class),
e AS (SELECT class, first, len(s) AS n, unnest(s) AS token FROM f),
o AS (SELECT b.class, a.n AS an, b.n AS bn, count(*) AS common FROM e a JOIN e b ON a.token = b.token AND a.first < b.first GROUP BY a.class, b.class, a.n, b.n),
gone AS (SELECT DISTINCT class FROM o WHERE 5 * common >= 4 * (an + bn - common)),
r AS (SELECT doc_id, line FROM c JOIN f USING (class) WHERE (doc_id, line) <> first OR class IN (FROM gone)),
g AS (SELECT doc_id, list(line) AS gone, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS s FROM r GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, coalesce(g.s, '') AS removed_lines,
       CASE WHEN g.n > 0 THEN array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) ELSE text END AS text
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)"""

# n-grams of pieces; 128-bit integers keep the score exact
SQL["op13_collocations"] = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, w[i:i + k - 1] AS p FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
      FROM w, (SELECT unnest(generate_series(1, 5)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, p, len(p) AS m, count(*) AS c FROM g GROUP BY lang, p),
n AS (SELECT lang, sum(c) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE m >= 2 AND c >= 100),
cut AS (SELECT lang, p, m, c, unnest(generate_series(1, m - 1)) AS k FROM cand),
s AS (SELECT cut.lang, cut.p, cut.c AS a, cut.k, x.c AS l, y.c AS r, n.n,
             (1000::HUGEINT * cut.c * n.n) // (x.c::HUGEINT * y.c) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.p = cut.p[1:cut.k] JOIN f y ON y.lang = cut.lang AND y.p = cut.p[cut.k + 1:cut.m]
      JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
sub AS (SELECT lang, c, k, p, unnest(generate_series(1, m - k + 1)) AS i FROM (SELECT lang, p, m, c, unnest(generate_series(2, m - 1)) AS k FROM cand WHERE m > 2)),
inside AS (SELECT lang, p[i:i + k - 1] AS p, max(c) AS most FROM sub GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.p = best.p WHERE most IS NULL OR most < a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
                  array_to_string(p, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000"""

# crc32 is linear: the exclusive or of a term for each byte and its distance from the end, and a term of the length;
# words one replacement apart agree without one position, words one deletion apart once it is done
SQL["op11_spelling_variants"] = r"""
WITH RECURSIVE bits AS (SELECT b, b AS c, 0 AS step FROM (SELECT unnest(generate_series(0, 255)) AS b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
t0 AS (SELECT b, c FROM bits WHERE step = 8),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
             unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS h FROM r WHERE length(run) >= 6 GROUP BY id, run),
longest AS (SELECT coalesce(max(length(h)) // 2, 0) AS m FROM d),
far AS (SELECT b, c, 0 AS k FROM t0 UNION ALL SELECT far.b, xor(t0.c, far.c >> 8), k + 1 FROM far JOIN t0 ON t0.b = far.c & 255, longest WHERE k < m),
zero AS (SELECT 4294967295 AS c, 0 AS k UNION ALL SELECT xor(t0.c, zero.c >> 8), k + 1 FROM zero JOIN t0 ON t0.b = zero.c & 255, longest WHERE k < m),
byte AS (SELECT id, run, h, length(h) // 2 AS len, unnest(generate_series(1, length(h) // 2)) AS i FROM d),
part AS (SELECT id, run, len, bit_xor(far.c) AS x FROM byte JOIN far ON far.k = len - i AND far.b = CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT) GROUP BY ALL),
crc AS (SELECT id, run, xor(xor(x, zero.c), 4294967295) AS c FROM part JOIN zero ON zero.k = len),
e AS (SELECT CASE WHEN c % 199 = 0 THEN left(run, c % length(run)) || substr(run, c % length(run) + 2) ELSE run END AS word, n FROM d JOIN crc USING (id, run)),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gap AS (SELECT word, n, length(word) AS len, left(word, i - 1) || chr(1) || substr(word, i + 1) AS g, left(word, i - 1) || substr(word, i + 1) AS less
        FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v)),
pair AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gap a JOIN gap b ON a.g = b.g AND a.word <> b.word
         UNION SELECT gap.word, gap.n, v.word, v.n FROM gap JOIN v ON gap.less = v.word
         UNION SELECT v.word, v.n, gap.word, gap.n FROM gap JOIN v ON gap.less = v.word),
best AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS top, max(near_n) AS top_n FROM pair GROUP BY word, n),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * v.n THEN top END AS form, CASE WHEN top_n >= 5 * v.n THEN top_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS ahead FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.ahead)
SELECT f.word, form, chain.root, n, n_near, form_n FROM f JOIN chain ON chain.word = f.word AND chain.ahead IS NULL"""

# every 100-byte string by 128 bits of md5; covered bytes as islands of repeated starts
SQL["op12_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS i FROM d)),
later AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
edge AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM later),
island AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edge),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM island GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
kept AS (SELECT d.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS t
         FROM gap JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE t || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
