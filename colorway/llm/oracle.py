"""DuckDB texts of the queries that SQL can express: near copies by all pairs
that share a shingle, repeated windows, risk-controlled rules, budgets. They
are written from the operators' definitions and share none of their code."""

_WORDS = r"[x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']"

_SHINGLES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n, string_agg(s, chr(10) ORDER BY s) AS whole FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT pair.a, pair.b FROM pair JOIN size x ON x.doc_id = pair.a JOIN size y ON y.doc_id = pair.b
         WHERE 5 * pair.n >= 4 * (x.n + y.n - pair.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS class_id,
       CASE WHEN size.whole IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY size.whole) END AS copies,
       (SELECT count(*) FROM link WHERE link.a = d.doc_id) AS n_links
FROM d LEFT JOIN size ON size.doc_id = d.doc_id
"""

_WINDOWS = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN low ON win.h = low.h AND low.low < win.doc_id),
word AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(word.w, ' ' ORDER BY word.i) AS text
         FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

# The rules' statistics, the path's factors and quantiles, the
# risk and error allowed.
_RULES = {"symbols": "n_symbols / greatest(word_chars, 1)", "repeated": "n_repeat_words / greatest(n_words, 1)",
          "lines": "n_dup_lines / greatest(n_lines, 1)", "marks": "n_bangs / greatest(n_words, 1)",
          "capitals": "n_capitals / greatest(word_chars, 1)"}
_STEPS = ", ".join(f"({k}, {f}, NULL)" for k, f in enumerate((4.0, 3.0, 2.0, 1.5, 1.2, 1.0))) + ", " + \
    ", ".join(f"({k}, NULL, {q})" for k, q in enumerate((0.999, 0.998, 0.995, 0.99), 6))
_RISK, _ERROR = 0.02, 0.05

_STATISTICS = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{rule}' AS rule, {k} AS nth, ({e})::DOUBLE AS x FROM base"
                                 for k, (rule, e) in enumerate(_RULES.items()))

_RISK_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_WORDS} AS w,
                  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS i
          FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
again AS (SELECT doc_id, count(*) AS n FROM twice GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_bangs,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN again ON again.doc_id = d.doc_id),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
stat AS ({_STATISTICS}),
good AS (SELECT stat.*, ('0x' || substr(md5(stat.doc_id::VARCHAR), 1, 8))::BIGINT % 10 < 2 AS on_path
         FROM stat WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
step(step, factor, quantile) AS (VALUES {_STEPS}),
cell AS (SELECT rule, least(ceil(x * 1000), 100000) AS x, count(*) AS n FROM good WHERE on_path GROUP BY ALL),
grown AS (SELECT *, sum(n) OVER (PARTITION BY rule ORDER BY x) AS through, sum(n) OVER (PARTITION BY rule) AS total FROM cell),
cutoff AS (SELECT rule, step, CASE WHEN factor IS NOT NULL THEN max(x) * any_value(factor)::DOUBLE / 1000
                  ELSE min(x) FILTER (WHERE through >= ceil(total * quantile::DOUBLE)) / 1000 END AS cutoff
           FROM grown, step GROUP BY rule, step, factor),
hit AS (SELECT stratum, step, count(*) AS n, count(*) FILTER (WHERE is_hit) AS k
        FROM (SELECT stratum, doc_id, step, bool_or(x > cutoff) AS is_hit FROM good JOIN cutoff USING (rule) WHERE NOT on_path GROUP BY ALL)
        GROUP BY ALL),
level AS (SELECT {_ERROR} / count(DISTINCT stratum) AS level, {_RISK}::DOUBLE AS p FROM hit),
tail AS (SELECT stratum, step, level, (SELECT sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END
                - CASE WHEN n = i THEN 0 ELSE lgamma(n - i + 1) END + i * ln(p) + (n - i) * ln(1 - p)))
         FROM (SELECT unnest(range(0, k + 1)) AS i)) AS tail FROM hit, level),
taken AS (SELECT stratum, max(step) AS step FROM (
            SELECT *, bool_and(tail <= level) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM tail) WHERE ok GROUP BY stratum),
allowed AS (SELECT stratum, rule, cutoff FROM taken JOIN cutoff USING (step)),
bad AS (SELECT doc_id, string_agg(stat.rule, ',' ORDER BY nth) AS rules FROM stat JOIN allowed
        ON allowed.stratum = stat.stratum AND allowed.rule = stat.rule AND stat.x > allowed.cutoff GROUP BY doc_id)
SELECT base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.rules IS NULL AS kept, coalesce(bad.rules, '') AS rejected_by
FROM base LEFT JOIN bad ON bad.doc_id = base.doc_id
"""


def _filled(name: str, children: str, parent: str, budget: str, child: str, weight: str) -> str:
    """Splits each parent's budget among its children: in the order of capacity
    by weight, those that would overflow are full, the rest share what is left."""
    of = f"PARTITION BY {parent}"
    ahead = f"{of} ORDER BY c / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    onward = f"{of} ORDER BY c / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"""
{name}_child AS (SELECT {children}, {weight} AS w, 2.0 * sum(n) AS c FROM supply GROUP BY {children} HAVING sum(n) > 0),
{name}_full AS (SELECT *, (b - coalesce(sum(c) OVER ({ahead}), 0)) * w / sum(w) OVER ({onward}) >= c AS is_full FROM ({budget})),
{name} AS (SELECT {children}, CASE WHEN is_full THEN c ELSE
             (b - coalesce(sum(c) FILTER (WHERE is_full) OVER ({of}), 0)) * w / sum(w) FILTER (WHERE NOT is_full) OVER ({of}) END AS b
           FROM {name}_full)"""


_BUDGETS = rf"""
WITH doc AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' WHEN regexp_matches(source, '^src[1-9]$') THEN 'web' ELSE 'books' END AS domain,
         coalesce(lang, '') AS language, coalesce(source, '') AS leaf, len({_WORDS})::BIGINT AS n_tokens, md5(coalesce(text, '')) AS text FROM documents),
supply AS (SELECT domain, language, leaf, sum(n_tokens)::DOUBLE AS n FROM doc GROUP BY ALL),
{_filled("one", "domain", "1", "SELECT *, (SELECT 0.5 * sum(n) FROM supply) AS b FROM one_child", "domain",
         "CASE domain WHEN 'crawl' THEN 0.4 WHEN 'web' THEN 0.35 ELSE 0.25 END::DOUBLE")},
{_filled("two", "domain, language", "domain", "SELECT two_child.*, one.b FROM two_child JOIN one USING (domain)", "language",
         "CASE language WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.1 ELSE 1 END::DOUBLE")},
{_filled("three", "domain, language, leaf", "domain, language",
         "SELECT three_child.*, two.b FROM three_child JOIN two USING (domain, language)", "leaf", "1.0::DOUBLE")},
plan AS (SELECT s.domain, s.language, s.leaf, s.n::BIGINT AS n, floor(coalesce(three.b, 0) + 1e-6)::BIGINT AS b
         FROM supply s LEFT JOIN three USING (domain, language, leaf)),
part AS (SELECT *, CASE WHEN n > 0 THEN least(2, b // n) ELSE 0 END AS whole FROM plan),
placed AS (
  SELECT doc.*, part.whole, CASE WHEN whole < 2 THEN b - whole * n ELSE 0 END AS rest,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || text || ':' || whole || ':17'), 1, 15))::BIGINT AS place
  FROM doc JOIN part USING (domain, language, leaf))
SELECT doc_id, domain, language, leaf, n_tokens,
       (whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, language, leaf ORDER BY place, doc_id NULLS FIRST, text
                                                           ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM placed
"""

_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
         lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))"""

_TRIE = f"""
WITH t AS (SELECT conv_id, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
built AS (SELECT c.conv_id, m, text, row_number() OVER (PARTITION BY c.conv_id ORDER BY k) AS depth
          FROM c JOIN t ON t.conv_id = CASE WHEN k <= h THEN c.conv_id - c.conv_id % 100 ELSE c.conv_id END),
path AS (SELECT conv_id, depth, length(text) AS size, md5(string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM built
         UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
step AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
                depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM path),
node AS (SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
                (count(*) - 1) * any_value(size) AS own, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end) AS ends
         FROM step GROUP BY node),
child AS (SELECT parent AS node, count(*) AS n FROM node GROUP BY parent),
below AS (SELECT path.node, sum(node.own) AS saved, count(*) FILTER (WHERE child.n IS NULL) AS leaves
          FROM node LEFT JOIN child ON child.node = node.node
          JOIN path ON path.conv_id = node.conv_id AND path.depth <= node.depth GROUP BY path.node)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n, 0) AS n_children,
       below.leaves AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN below ON below.node = node.node LEFT JOIN child ON child.node = node.node LEFT JOIN node up ON up.node = node.parent
"""

_BYTES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT r, i, md5(b[i:i + 399]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400)),
twice AS (SELECT r, i FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
edge AS (SELECT *, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 400, 0) AS is_new FROM twice),
span AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM (SELECT *, sum(is_new::INT) OVER (PARTITION BY r ORDER BY i) AS s FROM edge) GROUP BY r, s),
gap AS (SELECT r, z AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS z FROM span UNION ALL SELECT r, 1, min(a) FROM span GROUP BY r),
kept AS (SELECT gap.r, unhex(string_agg(hex(b[gap.a:coalesce(gap.z, octet_length(b) + 1) - 1]), '' ORDER BY gap.a)) AS b
         FROM gap JOIN d ON d.r = gap.r WHERE coalesce(gap.z, octet_length(b) + 1) > gap.a GROUP BY gap.r),
total AS (SELECT r, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed FROM span GROUP BY r)
SELECT doc_id, octet_length(d.b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN total.r IS NULL THEN d.b ELSE coalesce(kept.b, ''::BLOB) END) AS kept_sha256
FROM d LEFT JOIN total ON total.r = d.r LEFT JOIN kept ON kept.r = d.r
"""

_NEGATIVES = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_join": _SHINGLES, "op7_suffix_automata": _WINDOWS, "op8_risk_rules": _RISK_RULES, "op9_budget_mix": _BUDGETS,
            "op11_prefix_trie": _TRIE, "op12_suffix_ranks": _BYTES, "op13_hard_negatives": _NEGATIVES}
