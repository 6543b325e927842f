"""DuckDB SQL of the queries that SQL can express."""

# Words, and the rule counts of op3; the host prior follows ``host_rates``.
QUALITY_RULES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs
), windows AS (
  SELECT rid, i, list_slice(words, i, i + 4) AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + j) AS n_repeat_words
  FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY rid
), lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), counts AS (
  SELECT w.rid, doc_id, host, len(words) AS n_words,
    length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)
), base AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM counts
), hosts AS (
  SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM base GROUP BY host
), total AS (
  SELECT sum(k) / sum(n) AS mean, sum(n) AS n, count(*) AS m, sum(k * k / n) AS kk, sum(n * n) AS nn FROM hosts
), spread AS (
  SELECT mean, CASE WHEN m > 1 AND n > nn / n
    THEN ((kk - n * mean * mean) - (m - 1) * mean * (1 - mean)) / (n - nn / n) ELSE 0 END AS spread FROM total
), prior AS (
  SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1), 1000) ELSE 1000 END AS weight
  FROM spread
), rates AS (
  SELECT host, (k + mean * weight) / (n + weight) AS r, n + weight AS ab FROM hosts, prior
), bounds AS (
  SELECT host, r, greatest(0, r - 1.96 * sqrt(r * (1 - r) / (ab + 1))) AS low FROM rates
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  (NOT base_failed AND low <= 0.5) AS kept, host, round(r, 9) AS host_rate, round(low, 9) AS host_bound
FROM base JOIN bounds USING (host)
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

def _weight(children: str) -> str:
    """Prior weight by moments of a table n, k, mean, as in ``url_filter``."""
    return f"""(
  SELECT CASE WHEN spread IS NULL OR spread <= chance OR room = 0 OR room IS NULL THEN 1000.0
    ELSE least(greatest(room / (spread - chance) - 1, 1.0), 1000.0) END AS weight
  FROM (SELECT sum((k - n * mean) * (k - n * mean) / n) AS spread, sum(mean * (1 - mean)) AS chance,
      sum(mean * (1 - mean) * (n - 1)) AS room FROM {children} WHERE n > 0))"""


_TWO = (
    "('ac.uk', 'co.uk', 'gov.uk', 'org.uk', 'com.au', 'net.au', 'co.jp', 'or.jp', 'co.nz', 'com.br', 'co.in', 'co.za')"
)

URL_FILTER = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), p AS (
  SELECT page_id, lower(raw) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts
), outcomes AS (
  SELECT host, (coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT AS bad
  FROM p JOIN labels ON doc_id = try_cast(regexp_extract(path, '([0-9]+)(?:\.html|/)?$', 1) AS BIGINT)
  WHERE quality IS NOT NULL OR toxic IS NOT NULL
), hosts AS (
  SELECT h.host, coalesce(n, 0)::DOUBLE AS n, coalesce(k, 0)::DOUBLE AS k,
    array_to_string((string_split(h.host, '.'))[-2:], '.') AS two,
    array_to_string((string_split(h.host, '.'))[-3:], '.') AS three,
    array_to_string((string_split(h.host, '.'))[-1:], '.') AS one
  FROM (SELECT DISTINCT host FROM p) h
  LEFT JOIN (SELECT host, count(*) AS n, sum(bad) AS k FROM outcomes GROUP BY host) USING (host)
), named AS (
  SELECT host, n, k, CASE WHEN two IN {_TWO} THEN three ELSE two END AS domain,
    CASE WHEN two IN {_TWO} THEN two ELSE one END AS suffix FROM hosts
), domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM named GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL
), total AS (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) AS mean FROM suffixes
), level1 AS (SELECT suffix, n, k, mean FROM suffixes, total
), m1 AS (SELECT suffix, (k + weight * mean) / (n + weight) AS mean FROM level1, {_weight("level1")}
), level2 AS (SELECT suffix, domain, n, k, mean FROM domains JOIN m1 USING (suffix)
), m2 AS (SELECT suffix, domain, (k + weight * mean) / (n + weight) AS mean FROM level2, {_weight("level2")}
), level3 AS (SELECT host, n, k, mean FROM named JOIN m2 USING (suffix, domain)
), rated AS (
  SELECT host, (k + weight * mean) / (n + weight) AS r, n + weight + 1 AS ab FROM level3, {_weight("level3")}
), bounds AS (SELECT host, r, greatest(0, r - 1.96 * sqrt(r * (1 - r) / ab)) AS low FROM rated
), rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fitting AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
    arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM (SELECT DISTINCT host, path FROM p)
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule,
  coalesce(rverdict, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  round(r, 9) AS bad_rate, round(low, 9) AS bad_bound
FROM p JOIN bounds ON bounds.host = p.host LEFT JOIN fitting ON fitting.host = p.host AND fitting.path = p.path
"""


def _mix_sources(sweeps: int = 12, steps: int = 8) -> str:
    """Raking as one table per factor and sweep."""
    power = {"source": 0.5, "lang": 0.7, "topic": 0.7}
    parts = [
        r"""d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN regexp_matches(text, '(?i)licensed under|all rights reserved|copyright') THEN 'licensing'
      WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}|(?i:password=|token = )') THEN 'credentials'
      WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]{2}') THEN 'contacts'
      WHEN regexp_matches(text, '\|[^|\n]*\|') THEN 'tables' ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0 AS draw
  FROM documents)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM d GROUP BY ALL)",
    ]
    for margin, p in power.items():
        parts.append(
            f"t_{margin} AS MATERIALIZED (SELECT {margin} AS value, pow(n / sum(n) OVER (), {p}) / sum(pow(n / total, {p})) OVER () "
            f"* total AS target FROM (SELECT {margin}, sum(n) AS n, sum(sum(n)) OVER () AS total FROM cells "
            f"GROUP BY {margin} HAVING sum(n) > 0))"
        )
    current = {m: f"(SELECT DISTINCT {m} AS value, 1.0 AS factor FROM cells)" for m in power}
    for k in range(sweeps):
        for margin in power:
            others = [m for m in power if m != margin]
            joins = " ".join(
                f"LEFT JOIN {current[m]} f_{m} ON f_{m}.value = cells.{m}" for m in others
            )
            product = " * ".join(f"coalesce(f_{m}.factor, 1)" for m in others)
            parts.append(
                f"f{k}_{margin} AS MATERIALIZED (SELECT value, CASE WHEN there > 0 THEN target / there ELSE 1 END AS factor "
                f"FROM (SELECT cells.{margin} AS value, sum(n * {product}) AS there FROM cells {joins} "
                f"GROUP BY cells.{margin}) JOIN t_{margin} USING (value))"
            )
            current[margin] = f"f{k}_{margin}"
    joins = " ".join(f"LEFT JOIN {t} f_{m} ON f_{m}.value = cells.{m}" for m, t in current.items())
    product = " * ".join(f"coalesce(f_{m}.factor, 1)" for m in power)
    parts.append(f"w AS MATERIALIZED (SELECT source, lang, topic, n, {product} AS weight FROM cells {joins})")
    parts.append("s0 AS MATERIALIZED (SELECT 0.5 * sum(n) / sum(n * weight) AS scale FROM w)")
    for k in range(1, steps + 1):
        parts.append(
            f"s{k} AS MATERIALIZED (SELECT greatest(any_value(scale), coalesce((0.5 * sum(n) - "
            f"coalesce(sum(n) FILTER (weight * scale >= 1), 0)) / nullif(sum(n * weight) FILTER (weight * scale < 1), 0), 0)) "
            f"AS scale FROM w, s{k - 1})"
        )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight,
  round(least(1, weight * scale), 6) AS probability, draw < least(1, weight * scale) AS sampled
FROM d JOIN w USING (source, lang, topic), s{steps}
"""
    )


HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER best::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10
"""

# CRC-32 bit by bit (its table by rule), near words by what is left when a code point goes.
SPELLING_VARIANTS = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)
), found AS (
  SELECT id, run, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY ALL
), bytes AS (
  SELECT run, times, hex(encode(id || ':' || run)) AS digits FROM found
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(digits) // 2),
    lambda i: ('0x' || substr(digits, (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]))) AS h
  FROM bytes, crc_table
), words AS MATERIALIZED (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
    sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(times) >= 3
), cut AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT cut.word, rest FROM cut JOIN words w ON w.word = rest
  UNION SELECT rest, cut.word FROM cut JOIN words w ON w.word = rest
), best AS (
  SELECT pairs.word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n
  FROM pairs JOIN words ON words.word = near GROUP BY 1
), told AS MATERIALIZED (
  SELECT w.word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word
), walk AS (
  SELECT word, word AS at FROM told UNION ALL SELECT walk.word, form FROM walk JOIN told ON told.word = walk.at WHERE form IS NOT NULL
)
SELECT told.word, told.form, walk.at AS root, told.n, told.n_near, told.form_n
FROM told JOIN walk ON walk.word = told.word JOIN told e ON e.word = walk.at AND e.form IS NULL
"""

ORACLES = {
    "op1_mix_sources": _mix_sources(),
    "op3_quality_rules": QUALITY_RULES,
    "op7_exact_dedup": EXACT_DEDUP,
    "op8_url_filter": URL_FILTER,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op13_spelling_variants": SPELLING_VARIANTS,
}
