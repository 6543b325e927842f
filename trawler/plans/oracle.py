"""The registered queries as plain SQL over the same tables.

Written from the definitions, not from the Spark plans: every query starts
from the raw tables and computes its own tokens, chunks and ranks.
"""

from __future__ import annotations

from trawler.functions.stem import STEP_2, STEP_3, STEP_4

TITLE = """coalesce(nullif(trim(substr(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: trim(x)), lambda x: starts_with(x, '# '))[1], 3)), ''), CAST(doc_id AS VARCHAR))"""

CORPUS = f"""corpus AS (
  SELECT doc_id AS rowid, lang AS collection, source || '/' || doc_id || '.md' AS rel_path, text AS body,
         {TITLE} AS title,
         lang || ':' || substr(sha1(lang || chr(0) || source || '/' || doc_id || '.md'), 1, 12) AS id
  FROM documents)"""


def words(text: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({text})), '[\p{{L}}\p{{N}}]+')"


def _shape(x: str) -> str:
    """Consonants as c and vowels as v; a y takes turns."""
    x = f"regexp_replace({x}, '[^\\x00-\\x7F]', 'cc', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[^aeiouy]', 'c', 'g'), '[aeiou]', 'v', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '^y', 'c'), 'vy', 'vc', 'g')"
    return f"replace(regexp_replace({x}, 'yy', 'vc', 'g'), 'y', 'v')"


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_shape(x)}, 'v+c+'))"


def _cvc(x: str) -> str:
    return f"(ends_with({_shape(x)}, 'cvc') AND NOT regexp_matches({x}, '[wxy]$'))"


def _but(x: str, chars: int) -> str:
    return f"substr({x}, 1, greatest(length({x}) - {chars}, 0))"


def stems(name: str, terms: str) -> str:
    """CTEs ending in ``name(term, stem)``: the suffix rules of 1980, one CTE per step."""
    steps = [f"SELECT DISTINCT term, term AS w FROM {terms}"]

    def step(sql: str) -> None:
        steps.append(sql.replace("FROM last", f"FROM {name}_{len(steps) - 1}"))

    step(f"""SELECT term, CASE WHEN regexp_matches(w, '(?s).sses$') OR (length(w) > 3 AND ends_with(w, 'ies')) THEN {_but('w', 2)}
      WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_but('w', 1)} ELSE w END AS w FROM last""")
    step("""SELECT term, w, length(w) > 3 AND ends_with(w, 'eed') AS eed,
      CASE WHEN length(w) > 3 AND ends_with(w, 'eed') THEN '' ELSE regexp_extract(w, '(?s)^(.*)(?:ed|ing)$', 1) END AS s FROM last""")
    step(f"""SELECT term, CASE WHEN eed THEN CASE WHEN {_measure(_but('w', 3))} > 0 THEN {_but('w', 1)} ELSE w END
      WHEN NOT contains({_shape('s')}, 'v') THEN w
      WHEN regexp_matches(s, '(?:at|bl|iz)$') THEN s || 'e'
      WHEN length(s) > 1 AND s[-1] = s[-2] AND NOT contains('aeioulsz', s[-1]) THEN {_but('s', 1)}
      WHEN {_measure('s')} = 1 AND {_cvc('s')} THEN s || 'e' ELSE s END AS w FROM last""")
    step(f"SELECT term, CASE WHEN ends_with(w, 'y') AND contains({_shape(_but('w', 1))}, 'v') THEN {_but('w', 1)} || 'i' ELSE w END AS w FROM last")
    for rules in (STEP_2, STEP_3):
        pattern = f"(?s)^(.+?)({'|'.join(a for a, _ in rules)})$"
        swap = " ".join(f"WHEN '{a}' THEN s || '{b}'" for a, b in rules)
        step(f"SELECT term, w, regexp_extract(w, '{pattern}', 1) AS s, regexp_extract(w, '{pattern}', 2) AS e FROM last")
        step(f"SELECT term, CASE WHEN e <> '' AND {_measure('s')} >= 1 THEN CASE e {swap} END ELSE w END AS w FROM last")
    pattern = f"(?s)^(.+?)({'|'.join(STEP_4)})$"
    step(f"SELECT term, w, regexp_extract(w, '{pattern}', 1) AS s, regexp_extract(w, '{pattern}', 2) AS e FROM last")
    step(f"SELECT term, CASE WHEN e <> '' AND {_measure('s')} > 1 AND (e <> 'ion' OR s[-1] IN ('s', 't')) THEN s ELSE w END AS w FROM last")
    step(f"SELECT term, w, {_but('w', 1)} AS s, {_measure(_but('w', 1))} AS m FROM last")
    step(f"SELECT term, CASE WHEN ends_with(w, 'e') AND (m > 1 OR (m = 1 AND NOT {_cvc('s')})) THEN s ELSE w END AS w FROM last")
    step(f"""SELECT term, CASE WHEN strlen(term) NOT BETWEEN 3 AND 64 THEN term
      WHEN ends_with(w, 'll') AND {_measure(_but('w', 1))} > 1 THEN {_but('w', 1)} ELSE w END AS stem FROM last""")
    ctes = [f"{name}_{k} AS MATERIALIZED ({sql})" for k, sql in enumerate(steps[:-1])]
    return ", ".join([*ctes, f"{name} AS MATERIALIZED ({steps[-1]})"])


def postings(name: str, rows: str, fields: dict[str, str], stemmed: bool = False) -> str:
    """Token occurrences of the fields of a row source with ``rowid``."""
    if stemmed:
        raw = postings(f"{name}_raw", rows, fields)
        rewritten = f"{name} AS (SELECT rowid, field, stem AS term, pos FROM {name}_raw JOIN {name}_stem USING (term))"
        sizes = f"{name}_lens AS (FROM {name}_raw_lens), {name}_stats AS (FROM {name}_raw_stats)"
        return f"{raw}, {stems(name + '_stem', name + '_raw')}, {rewritten}, {sizes}"
    parts = " UNION ALL ".join(
        f"SELECT rowid, '{f}' AS field, {words(expr)} AS toks FROM {rows}" for f, expr in fields.items()
    )
    return (
        f"{name} AS (SELECT rowid, field, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM ({parts})), "
        f"{name}_lens AS (SELECT rowid, count(*) AS d FROM {name} GROUP BY rowid), "
        f"{name}_stats AS (SELECT n, t / n AS avgd FROM (SELECT count(*) * 1.0 AS n FROM {rows}), "
        f"(SELECT count(*) * 1.0 AS t FROM {name}))"
    )


DOC_FIELDS = {"filepath": "collection || '/' || rel_path", "title": "title", "body": "body"}
WEIGHT = "CASE p0.field WHEN 'filepath' THEN 1.5 WHEN 'title' THEN 4.0 ELSE 1.0 END"
DOCS = CORPUS + ", " + postings("post", "corpus", DOC_FIELDS)
STEMMED_DOCS = CORPUS + ", " + postings("post", "corpus", DOC_FIELDS, stemmed=True)


def clause(tokens: str, index: str = "post") -> str:
    """Weighted hits per row: ``word*`` is a prefix, several words a phrase."""
    terms = tokens.split()

    def test(i, term):
        return f"starts_with(p{i}.term, '{term[:-1]}')" if term.endswith("*") else f"p{i}.term = '{term}'"

    joins = "".join(
        f" JOIN {index} p{i} ON p{i}.rowid = p0.rowid AND p{i}.field = p0.field AND p{i}.pos = p0.pos + {i}"
        f" AND {test(i, t)}"
        for i, t in enumerate(terms)
        if i
    )
    return f"SELECT p0.rowid, sum({WEIGHT}) AS f FROM {index} p0{joins} WHERE {test(0, terms[0])} GROUP BY p0.rowid"


def bm25(name: str, clauses: list[str], without: list[list[str]] = (), any_clause=False, index="post") -> str:
    """CTEs ending in ``name(rowid, bm25)``."""
    ctes, score = [], []
    for i, c in enumerate(clauses):
        ctes.append(f"{name}_c{i} AS ({clause(c, index)})")
        idf = (
            f"(SELECT CASE WHEN x > 0 THEN x ELSE 1e-6 END FROM (SELECT ln((s.n - count(*) + 0.5) / (count(*) + 0.5)) AS x"
            f" FROM {name}_c{i}))"
        )
        f = f"coalesce(c{i}.f, 0)"
        score.append(f"{idf} * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * l.d / s.avgd))")
    joins = "".join(f" LEFT JOIN {name}_c{i} c{i} ON c{i}.rowid = l.rowid" for i in range(len(clauses)))
    keep = (" OR " if any_clause else " AND ").join(f"c{i}.f > 0" for i in range(len(clauses)))
    drop = ""
    for g, group in enumerate(without):
        inside = " AND ".join(f"l.rowid IN (SELECT rowid FROM ({clause(c, index)}))" for c in group)
        drop += f" AND NOT ({inside})"
    score = [x.replace("s.n -", f"(SELECT n FROM {index}_stats) -") for x in score]
    ctes.append(
        f"{name} AS (SELECT l.rowid, -({' + '.join(score)}) AS bm25 FROM {index}_lens l CROSS JOIN {index}_stats s"
        f"{joins} WHERE ({keep}){drop})"
    )
    return ", ".join(ctes)


def lex_list(name: str, clauses: list[str], collection="", limit=20, without=(), min_score=0.0) -> str:
    """CTEs ending in ``name`` with score and bm25_rank."""
    cut = limit * 10 if collection else limit
    where = f"WHERE d.collection = '{collection}'" if collection else ""
    floor = f"WHERE score >= {min_score}" if min_score else ""
    return (
        bm25(f"{name}_m", clauses, without)
        + f", {name}_k AS (SELECT * FROM {name}_m ORDER BY bm25, rowid LIMIT {cut})"
        + f", {name}_h AS (SELECT d.rowid, d.id, d.collection, d.rel_path, k.bm25, abs(k.bm25) / (1 + abs(k.bm25)) AS score"
        f" FROM {name}_k k JOIN corpus d USING (rowid) {where} ORDER BY k.bm25, rowid LIMIT {limit})"
        + f", {name} AS (SELECT *, CAST(row_number() OVER (ORDER BY bm25, rowid) AS INT) AS bm25_rank FROM {name}_h {floor})"
    )


HIT = "SELECT rowid, collection, rel_path, round(score, 9) AS score, bm25_rank FROM"


def lexical(clauses, collection="", limit=20, without=(), min_score=0.0, docs=DOCS) -> str:
    return f"WITH {docs}, {lex_list('a', clauses, collection, limit, without, min_score)} {HIT} a"


def fused(queries: list[list[str]], limit: int) -> str:
    """CTEs ending in ``fused``: equal-weight fusion scaled to the best."""
    lists = ", ".join(lex_list(f"q{i}", c, limit=limit) for i, c in enumerate(queries))
    union = " UNION ALL ".join(f"SELECT *, {i} AS li FROM q{i}" for i in range(len(queries)))
    return f"""{DOCS}, {lists}, allq AS ({union}),
  sums AS (SELECT rowid, sum(1.0 / (60.0 + bm25_rank)) AS f, min(li * 1000 + bm25_rank) AS seen FROM allq GROUP BY rowid),
  fused AS (SELECT a.rowid, a.collection, a.rel_path, s.f / (SELECT max(f) FROM sums) AS score, a.bm25_rank, s.seen
            FROM sums s JOIN allq a ON a.rowid = s.rowid AND a.li * 1000 + a.bm25_rank = s.seen
            ORDER BY round(s.f, 14) DESC, s.seen LIMIT {limit})"""


# --- chunks: greedy byte windows, cut at the best line end -------------------

CHUNKS = r"""sized AS (SELECT doc_id, text, strlen(text) AS size FROM documents),
lines AS (
  SELECT doc_id, n, line, lead(line) OVER w AS following, max(n) OVER (PARTITION BY doc_id) AS last_n,
         sum(strlen(line) + 1) OVER w - 1 AS pos
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS n FROM sized WHERE size > 3600)
  WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
breaks AS (
  SELECT doc_id, pos,
         CASE WHEN following = '' AND n + 1 < last_n THEN 20
              WHEN regexp_matches(following, '^#{1,6}([^#]|$)') THEN 110 - 10 * strlen(regexp_extract(following, '^#+'))
              WHEN starts_with(following, '```') THEN 80
              WHEN trim(following) IN ('---', '***', '___') AND n + 1 < last_n THEN 60
              WHEN regexp_matches(following, '^([-*] |[0-9]+\. )') THEN 5
              ELSE 1 END AS score
  FROM lines WHERE n < last_n AND (n = 0 OR line <> '')),
chars AS (
  SELECT doc_id, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY k) - strlen(c) AS cp
  FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(len(string_split(text, '')))) AS k
        FROM sized WHERE size > 3600)),
spans AS (
  SELECT doc_id, size, 0 AS idx, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS s, CAST(NULL AS BIGINT) AS b
  FROM sized WHERE size > 3600
  UNION ALL
  SELECT doc_id, size, idx + 1,
         CASE WHEN stop >= size THEN size WHEN back > a THEN back ELSE stop END, a, stop
  FROM (
    SELECT m.*, CASE WHEN m.stop >= m.size THEN 0 ELSE (SELECT max(c.cp) FROM chars c
             WHERE c.doc_id = m.doc_id AND c.cp <= m.stop - 540 AND c.cp >= m.stop - 543) END AS back
    FROM (
      SELECT t.*, CASE WHEN t.target >= t.size THEN t.size ELSE coalesce((
               SELECT CASE WHEN p > t.a THEN p END FROM (
                 SELECT arg_max(k.pos, k.score * (1 - 0.7 * ((t.target - k.pos) / 800.0) * ((t.target - k.pos) / 800.0))
                                       - k.pos * 1e-15) AS p
                 FROM breaks k WHERE k.doc_id = t.doc_id AND k.pos <= t.target AND k.pos >= t.target - 800)),
               t.target) END AS stop
      FROM (
        SELECT x.doc_id, x.size, x.idx, x.a,
               CASE WHEN x.a + 3600 >= x.size THEN x.size ELSE (SELECT max(c.cp) FROM chars c
                 WHERE c.doc_id = x.doc_id AND c.cp <= x.a + 3600 AND c.cp >= x.a + 3597) END AS target
        FROM spans x WHERE x.a < x.size) t) m) n),
cut AS (
  SELECT doc_id AS rowid, idx - 1 AS chunk_index, s, b FROM spans WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, 0, 0, size FROM sized WHERE size <= 3600),
chunk_text AS (
  SELECT c.rowid, CAST(c.chunk_index AS INT) AS chunk_index, c.s AS start_offset, c.b AS end_offset,
         decode(encode(z.text)[c.s + 1:c.b]) AS content
  FROM cut c JOIN sized z ON z.doc_id = c.rowid),
chunks AS (
  SELECT *, coalesce(regexp_replace(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)),
           lambda x: starts_with(x, '#'))[1], '^#+ *', ''), '') AS heading
  FROM chunk_text)"""



def _chunk_post(stemmed: bool) -> str:
    return (
        "chunk_rows AS (SELECT rowid * 1048576 + chunk_index AS rowid, rowid AS doc, chunk_index, heading, content FROM chunks), "
        + postings("cpost", "chunk_rows", {"heading": "heading", "content": "content"}, stemmed)
    )


def chunk_list(name: str, clauses: list[str], limit: int) -> str:
    return (
        bm25(f"{name}_m", clauses, any_clause=True, index="cpost")
        + f", {name} AS (SELECT rowid, -bm25 AS bm25_score, CAST(row_number() OVER (ORDER BY bm25, rowid) AS INT) AS rank"
        f" FROM {name}_m ORDER BY bm25, rowid LIMIT {limit})"
    )


def on_chunks(rest: str, stemmed: bool = False) -> str:
    return f"WITH RECURSIVE {CHUNKS}, {_chunk_post(stemmed)}, {rest}"


# --- vectors -----------------------------------------------------------------

VECTORS = """vecs AS (
  SELECT format('v{:08d}', vec_id) AS chunk_id, vec_id, (vec_id // 2) % (SELECT count(*) FROM documents) AS doc, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
dvecs AS (SELECT v.*, c.id AS doc_id, c.collection FROM vecs v JOIN corpus c ON c.rowid = v.doc)"""
WITH_VECTORS = f"WITH {CORPUS}, {VECTORS}"


def target(vec_id: int) -> str:
    """A query vector: one stored vector plus half of the next one."""
    return (
        "(SELECT list_transform(list_zip(a.e, b.e), lambda p: p[1] + 0.5 * p[2]) FROM vecs a, vecs b"
        f" WHERE a.vec_id = {vec_id} AND b.vec_id = {vec_id + 1})"
    )


def vec_list(name: str, ids: list[int], collection="", limit=20, floor=-2.0) -> str:
    """CTEs ending in ``name``: documents by best chunk over the variants."""
    where = f"WHERE collection = '{collection}'" if collection else ""
    union = " UNION ALL ".join(
        f"SELECT {i} AS variant, * FROM (SELECT chunk_id, doc_id, doc, collection, list_cosine_similarity(e, {target(v)}) AS score,"
        f" list_distance(e, {target(v)}) AS dist FROM dvecs ORDER BY dist, chunk_id LIMIT {limit * 3})"
        for i, v in enumerate(ids)
    )
    return f"""{name}_n AS ({union}),
  {name}_d AS (SELECT *, row_number() OVER (PARTITION BY variant, doc_id ORDER BY score DESC, chunk_id) AS r FROM {name}_n {where}),
  {name}_v AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY score DESC, doc_id, chunk_id) AS vr FROM {name}_d WHERE r = 1),
  {name}_b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, variant) AS br FROM {name}_v WHERE vr <= {limit}),
  {name} AS (SELECT doc AS rowid, doc_id AS id, collection, chunk_id, score,
             CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS vector_rank
             FROM {name}_b WHERE br = 1 AND score >= {floor}
             QUALIFY vector_rank <= {limit})"""


def vector_hits(ids, collection="", limit=20, floor=-2.0) -> str:
    return (
        f"{WITH_VECTORS}, {vec_list('v', ids, collection, limit, floor)} "
        "SELECT rowid, collection, chunk_id, round(score, 9) AS score, vector_rank FROM v"
    )


# --- hybrid ------------------------------------------------------------------


def hybrid(lists: list[tuple], chunks=False, prefix="h", cut=40) -> str:
    """CTEs ending in ``<prefix>``: fused and ranked candidates.

    ``lists``: (cte name, source, weight, list index).
    """
    union = " UNION ALL ".join(
        f"SELECT id, rowid, {i} AS li, '{src}' AS src, {w} AS w, {'bm25_rank' if src == 'fts' else 'vector_rank'} AS rank,"
        f" score, {'bm25_rank' if src == 'fts' else '0'} AS bm25_rank, {'vector_rank' if src == 'vec' else '0'} AS vector_rank FROM {n}"
        for n, src, w, i in lists
    )
    return f"""{prefix}_u AS ({union}),
  {prefix}_f AS (SELECT id, any_value(rowid) AS rowid, sum(w / (60.0 + rank)) AS base, CAST(min(rank) AS INT) AS top_rank,
         CAST(count(*) AS INT) AS lists, min(li) AS first_list,
         arg_min(w, li) AS first_weight, arg_min(score, li) FILTER (src = 'fts') AS fts_score,
         arg_min(score, li) FILTER (src = 'vec') AS vec_score FROM {prefix}_u GROUP BY id),
  {prefix}_t AS (SELECT f.*, CASE WHEN top_rank = 1 THEN 0.05 WHEN top_rank <= 3 THEN 0.02 ELSE 0.0 END AS bonus,
         u.bm25_rank, u.vector_rank, c.collection, c.rel_path
         FROM {prefix}_f f JOIN {prefix}_u u ON u.id = f.id AND u.li = f.first_list JOIN corpus c ON c.id = f.id),
  {prefix} AS (SELECT *, CAST(row_number() OVER (ORDER BY round(base + bonus, 14) DESC, collection || '/' || rel_path) AS INT) AS rank
         FROM {prefix}_t QUALIFY rank <= {cut})"""


CONTEXTS = """ctx AS (
  SELECT lang AS collection, '/' || source AS prefix, 'source ' || source || ' in ' || lang AS text
  FROM (SELECT DISTINCT lang, source FROM documents) WHERE source NOT IN ('src3', 'src7', 'src9')
  UNION ALL SELECT lang, '/', 'language ' || lang FROM (SELECT DISTINCT lang FROM documents) WHERE lang <> 'es'),
context AS (
  SELECT c.rowid, coalesce(arg_max(x.text, length(x.prefix)), 'all documents') AS context
  FROM corpus c LEFT JOIN ctx x ON x.collection = c.collection AND starts_with('/' || c.rel_path, x.prefix) GROUP BY c.rowid)"""


def best_chunk(question: list[str], intent: list[str]) -> str:
    """CTE ``best``: per document the chunk with most terms, first on ties."""
    score = " + ".join(
        [f"2 * CAST(contains(lower(content), '{t}') AS INT)" for t in question]
        + [f"CAST(contains(lower(content), '{t}') AS INT)" for t in intent]
    )
    return f"""best AS (SELECT rowid, arg_min(chunk_index, -overlap * 1000000 + chunk_index) AS ci, max(overlap) AS overlap,
    arg_min(start_offset, -overlap * 1000000 + chunk_index) AS pos
    FROM (SELECT *, {score} AS overlap FROM chunks) GROUP BY rowid)"""


_LEX_AND_VEC = f"{DOCS}, {VECTORS}"

# --- pages and sessions --------------------------------------------------------

RUN_ROWS = """msgs AS (
  SELECT user_id, ts, event_id, value, props, '[' || event_id || ']' AS content, 'call' || event_id AS call_id,
         CASE WHEN event_type IN ('view', 'click') THEN 'text' WHEN event_type = 'purchase' THEN 'tool_use'
              WHEN event_type = 'signup' THEN 'tool_result' ELSE 'error' END AS kind FROM events),
linked AS (
  SELECT *, kind = 'text' AS is_text, coalesce(lag(kind = 'text') OVER w, false) AS after_text
  FROM msgs WHERE kind <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (
  SELECT *, CAST(sum(CASE WHEN is_text AND NOT after_text THEN 1 ELSE 0 END) OVER
           (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS message_no FROM linked)"""

SESSIONS = """sess AS (SELECT CAST(user_id AS VARCHAR) AS id, max(ts) AS updated_at, count(*) AS events,
  arg_min(event_type, (ts, event_id)) AS agent_id FROM events GROUP BY user_id)"""

_EVENT = "SELECT user_id, event_id, CAST({seq} AS INT) AS seq, '{kind}' AS type, message_no, {call} AS call_id, {body} AS body FROM numbered WHERE {when}"
_NO = "''"


def _event(seq, kind, when, call=_NO, body=_NO) -> str:
    return _EVENT.format(seq=seq, kind=kind, when=when, call=call, body=body)


ORACLES = {
    "lex_prefix_bm25": lexical(["enheit*"]),
    "lex_and_not": lexical(["tion*", "the*"], without=[["queque*"], ["of*", "en*"]]),
    "lex_phrase": lexical(["of the"]),
    "lex_fielded_weights": lexical(["src3*", "the*"], limit=50),
    "lex_candidate_cut": lexical(["tion*"], "fr", limit=5),
    "lex_min_score": lexical(["cionas*"], min_score=0.82, limit=100),
    "lex_hyphen_dotted": lexical(["to the", "en*", "src1*"], limit=30),
    "search_many_rrf": f"WITH {fused([['tion*'], ['of*', 'the*'], ['ndtion*']], 20)} {HIT} fused",
    "search_fanout": f"WITH {DOCS}, {lex_list('a', ['tion*'], limit=50)} {HIT} a WHERE collection IN ('de', 'en') ORDER BY bm25_rank LIMIT 10",
    "page_folder_search": f"WITH {fused([['tion*'], ['src1*']], 50)} SELECT rowid, rel_path, round(score, 9) AS score FROM fused WHERE starts_with(rel_path, 'src1/')",
    "page_folder_fallback": f"WITH {CORPUS} SELECT rowid, rel_path, -1.0::DOUBLE AS score FROM corpus WHERE starts_with(rel_path, 'src1/') AND (contains(lower(body), 'ngth') OR contains(lower(body), 'itung'))",
    "lex_all_matches": f"""WITH {DOCS}, {bm25('a', ['enheit*'])}, {bm25('b', ['of the'])}, u AS (SELECT rowid, max(abs(bm25) / (1 + abs(bm25))) AS score
      FROM (FROM a UNION ALL FROM b) GROUP BY rowid) SELECT rowid, collection, round(score, 9) AS score FROM u JOIN corpus USING (rowid) WHERE score >= 0.1""",
    "legacy_or_search": f"""WITH {CORPUS}, {postings('post', 'corpus', {'id': 'id', 'content': 'body', 'tags': 'collection', 'article_path': 'rel_path'})},
      {bm25('m', ['queque*', 'enlich es*'], any_clause=True)},
      tagged AS (SELECT m.rowid, bm25, collection, rel_path FROM m JOIN corpus USING (rowid) WHERE collection LIKE '%e%')
      SELECT rowid, collection, rel_path, round(-bm25, 9) AS bm25_score, CAST(row_number() OVER (ORDER BY bm25, rowid) AS INT) AS rank
      FROM tagged ORDER BY bm25, rowid LIMIT 10""",
    "chunk_search": on_chunks(
        f"{chunk_list('a', ['enheit*', 'queque*'], 20)} SELECT doc AS rowid, chunk_index, round(bm25_score, 9) AS bm25_score, rank"
        " FROM a JOIN chunk_rows USING (rowid)"
    ),
    "chunk_multi_rrf": on_chunks(
        f"{chunk_list('a', ['tion*'], 20)}, {chunk_list('b', ['ndtion*'], 20)}, {chunk_list('c', ['of*'], 20)},"
        " r AS (SELECT rowid, sum(1.0 / (60.0 + rank)) AS rrf FROM (FROM a UNION ALL FROM b UNION ALL FROM c) GROUP BY rowid)"
        " SELECT doc AS rowid, chunk_index, round(rrf, 9) AS rrf, CAST(row_number() OVER (ORDER BY round(rrf, 12) DESC, r.rowid) AS INT) AS rank"
        " FROM r JOIN chunk_rows USING (rowid) ORDER BY round(rrf, 12) DESC, r.rowid LIMIT 20"
    ),
    "chunk_doc_ids": on_chunks(
        f"{chunk_list('a', ['tion*'], 50)}, d AS (SELECT doc AS rowid, min(rank) AS best_rank FROM a JOIN chunk_rows USING (rowid) GROUP BY doc)"
        " SELECT *, CAST(row_number() OVER (ORDER BY best_rank) AS INT) AS position FROM d"
    ),
    "porter_search": f"""WITH {STEMMED_DOCS}, {lex_list('a', ['tion*', 'estion*'])}, {lex_list('b', ['er*'], limit=30)}
      SELECT rowid, collection, rel_path, round(score, 9) AS score, bm25_rank FROM a UNION ALL {HIT} b""",
    "porter_phrase": lexical(["the er"], without=[["quequ*"]], docs=STEMMED_DOCS),
    "porter_chunk_search": on_chunks(
        f"{chunk_list('a', ['er*', 'estion*'], 20)} SELECT doc AS rowid, chunk_index, round(bm25_score, 9) AS bm25_score, rank"
        " FROM a JOIN chunk_rows USING (rowid)",
        stemmed=True,
    ),
    "porter_hybrid": f"""WITH {STEMMED_DOCS}, {VECTORS}, {lex_list('a', ['er*', 'estion*'])}, {vec_list('b', [12])},
      {hybrid([('a', 'fts', 2.0, 0), ('b', 'vec', 2.0, 1)])}
      SELECT id, rank, round(base, 9) AS base_score, round(base + bonus, 9) AS total_score, lists FROM h""",
    "knn_cosine": f"{WITH_VECTORS} SELECT chunk_id, round(s, 9) AS score FROM (SELECT chunk_id, list_cosine_similarity(e, {target(0)}) AS s FROM vecs) ORDER BY s DESC, chunk_id LIMIT 20",
    "knn_l2_rescored": f"{WITH_VECTORS} SELECT chunk_id, round(list_cosine_similarity(e, {target(1)}), 9) AS score FROM vecs ORDER BY list_distance(e, {target(1)}), chunk_id LIMIT 60",
    "knn_filtered_docs": f"WITH {_LEX_AND_VEC}, {lex_list('a', ['the*'], limit=250)} SELECT chunk_id, round(s, 9) AS score FROM (SELECT chunk_id, list_cosine_similarity(e, {target(2)}) AS s FROM dvecs WHERE doc_id IN (SELECT id FROM a)) ORDER BY s DESC, chunk_id LIMIT 20",
    "knn_best_per_doc": f"{WITH_VECTORS}, n AS (SELECT doc_id, chunk_id, list_cosine_similarity(e, {target(3)}) AS s FROM dvecs ORDER BY s DESC, chunk_id LIMIT 60) SELECT doc_id, chunk_id, round(s, 9) AS score FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, chunk_id) = 1",
    "knn_variants_max": vector_hits([0, 1, 2], limit=10),
    "search_vector_collection": vector_hits([4], "en", 20),
    "vector_min_score": vector_hits([5, 6], limit=10, floor=0.3),
    "vector_mean_pool": "SELECT label, CAST(i - 1 AS INT) AS at, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i".replace(" AS at,", ' AS "at",'),
    "vector_l2_normalize": "SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS length, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / n) AS u FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS e FROM embeddings)))".replace(" AS first ", ' AS "first" '),
    "doc_vector_knn": f"{WITH_VECTORS}, cells AS (SELECT doc_id, i, avg(e[i]) AS x FROM dvecs, range(1, 65) r(i) GROUP BY doc_id, i), pooled AS (SELECT doc_id, list(x ORDER BY i) AS e FROM cells GROUP BY doc_id) SELECT doc_id, round(s, 9) AS score FROM (SELECT doc_id, list_cosine_similarity(e, {target(7)}) AS s FROM pooled) ORDER BY s DESC, doc_id LIMIT 10",
    "doc_vector_upsert": f"""{WITH_VECTORS}, parts AS (SELECT doc_id, CASE WHEN doc % 3 = 0 THEN 32 ELSE 64 END AS width, CASE WHEN doc % 3 = 0 THEN 2 ELSE 1 END * e[1] AS x
      FROM dvecs WHERE doc % 7 <> 0) SELECT doc_id, CAST(any_value(width) AS INT) AS width, round(avg(x), 9) AS head FROM parts GROUP BY doc_id""",
    "vector_upsert": f"{WITH_VECTORS} SELECT chunk_id, CAST(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS INT) AS rev, CAST(CASE WHEN vec_id % 3 = 0 THEN 16 ELSE 64 END AS INT) AS width FROM dvecs",
    "hybrid_rrf": f"""WITH RECURSIVE {CHUNKS}, {_LEX_AND_VEC}, {CONTEXTS}, {best_chunk(['enheit', 'the'], [])},
      {lex_list('a', ['enheit*', 'the*'])}, {vec_list('b', [0])}, {hybrid([('a', 'fts', 2.0, 0), ('b', 'vec', 2.0, 1)])}
      SELECT h.id, h.collection, h.rel_path AS path, round(1.0 / h.rank, 9) AS score, CAST(h.bm25_rank AS INT) AS bm25_rank,
        CAST(h.vector_rank AS INT) AS vector_rank, x.context, substr(sha256(c.body), 1, 6) AS doc_id,
        h.id || ':c' || b.ci AS chunk_id, b.pos AS best_chunk_pos
      FROM h JOIN corpus c USING (rowid) JOIN context x USING (rowid) JOIN best b USING (rowid) WHERE h.rank <= 20""",
    "hybrid_rrf_explain": f"""WITH {_LEX_AND_VEC}, {lex_list('a', ['tion*'])}, {vec_list('b', [8])}, {hybrid([('a', 'fts', 2.0, 0), ('b', 'vec', 2.0, 1)])}
      SELECT id, rank, top_rank, round(base, 9) AS base_score, round(base + bonus, 9) AS total_score, round(bonus, 9) AS bonus, lists,
        round(coalesce(fts_score, -9.0), 6) AS fts_score, round(coalesce(vec_score, -9.0), 6) AS vec_score FROM h""",
    "hybrid_structured_weights": f"""WITH {_LEX_AND_VEC}, {lex_list('a', ['ndtion*'])}, {vec_list('b', [1])}, {vec_list('c', [2])},
      {hybrid([('a', 'fts', 2.0, 0), ('b', 'vec', 1.0, 1), ('c', 'vec', 1.0, 2)])}
      SELECT id, round(1.0 / rank, 9) AS score, round(base + bonus, 9) AS total_score, CAST(first_list AS INT) AS list_index,
        CAST(first_weight AS DOUBLE) AS weight FROM h WHERE rank <= 30""",
    "hybrid_search_queries": f"""WITH {_LEX_AND_VEC}, {lex_list('a', ['ndtion*'])}, {vec_list('b', [3])}, {lex_list('c', ['of*', 'the*'])}, {lex_list('d', ['queque*'])},
      {hybrid([('a', 'fts', 2.0, 0), ('b', 'vec', 2.0, 1), ('c', 'fts', 1.0, 2), ('d', 'fts', 1.0, 3)])}
      SELECT id, round(1.0 / rank, 9) AS score, round(base + bonus, 9) AS total_score, CAST(first_list AS INT) AS list_index FROM h WHERE rank <= 30""",
    "rerank_blend": f"""WITH {_LEX_AND_VEC}, {lex_list('a', ['tion*'])}, {vec_list('b', [9])}, {hybrid([('a', 'fts', 2.0, 0), ('b', 'vec', 2.0, 1)])},
      w AS (SELECT h.*, CAST(CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END AS DOUBLE) AS weight,
        CAST(coalesce(l.quality, 0) AS DOUBLE) AS rerank_score FROM h LEFT JOIN labels l ON l.doc_id = h.rowid)
      SELECT id, round(weight * (1.0 / rank) + (1 - weight) * rerank_score, 9) AS score, weight, rerank_score FROM w
      ORDER BY round(weight * (1.0 / rank) + (1 - weight) * rerank_score, 14) DESC, collection || '/' || rel_path LIMIT 20""",
    "query_merge_collections": f"WITH {_LEX_AND_VEC}, "
    + ", ".join(
        f"{lex_list('a_' + c, ['tion*'], c)}, {vec_list('b_' + c, [10], c)}, {hybrid([('a_' + c, 'fts', 2.0, 0), ('b_' + c, 'vec', 2.0, 1)], prefix='h_' + c)}"
        for c in ("de", "en", "es", "fr")
    )
    + " SELECT collection, rel_path AS path, round(1.0 / rank, 9) AS score FROM ("
    + " UNION ALL ".join(f"SELECT * FROM h_{c} WHERE rank <= 30" for c in ("de", "en", "es", "fr"))
    + ") ORDER BY 1.0 / rank DESC, collection, rel_path LIMIT 15",
    "rrf_two_lists": f"""WITH {_LEX_AND_VEC}, {lex_list('a', ['ndtion*'])}, {vec_list('b', [11])},
      r AS (SELECT id, sum(1.0 / (60.0 + rank)) AS rrf FROM (SELECT id, bm25_rank AS rank FROM a UNION ALL SELECT id, vector_rank FROM b) GROUP BY id)
      SELECT id, round(rrf, 9) AS rrf FROM r ORDER BY round(rrf, 12) DESC, id LIMIT 20""",
    "best_query_chunk": f"""WITH RECURSIVE {CHUNKS}, {CORPUS}, {best_chunk(['tion', 'the', 'enheit'], ['queque', 'ndtion'])}
      SELECT c.id AS doc_id, c.id || ':c' || ci AS chunk_id, pos AS best_chunk_pos, CAST(overlap AS INT) AS overlap FROM best JOIN corpus c USING (rowid)""",
    "doc_title_snippet": f"""WITH {CORPUS}, flat AS (SELECT rowid, title, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS s FROM corpus)
      SELECT rowid, title, CASE WHEN length(s) <= 180 THEN s ELSE substr(s, 1, 180) || '...' END AS snippet FROM flat""",
    "doc_ids_hashes": f"WITH {CORPUS} SELECT rowid, id, sha256(body) AS hash, substr(sha256(body), 1, 6) AS short, 'doc://' || collection || '/' || rel_path AS uri FROM corpus",
    "context_longest_prefix": f"WITH {CORPUS}, {CONTEXTS} SELECT rowid, context FROM context",
    "chunk_markdown": f"WITH RECURSIVE {CHUNKS} SELECT rowid, chunk_index, start_offset, end_offset, heading, md5(content) AS content_md5 FROM chunks",
    "token_estimate": r"SELECT doc_id, CAST(floor(1.5 * c) + (length(text) - c) // 4 AS INT) AS estimate FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[\p{Han}\p{Hangul}\p{Katakana}\p{Hiragana}]')) AS c FROM documents)",
    "glob_filter": rf"""WITH {CORPUS} SELECT rowid, rel_path FROM corpus
      WHERE (regexp_matches(rel_path, '^src1/[^/]*\.md$') OR regexp_matches(rel_path, '/[^/]*[05]\.md$') OR regexp_matches(rel_path, '^src2[^/]/[^/]*$'))
      AND NOT (regexp_matches(rel_path, '^src15/[^/]*$') OR regexp_matches(rel_path, '/1[^/]*0\.md$'))""",
    "slugify": "SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM (SELECT page_id AS id, url AS name FROM pages UNION ALL SELECT p_partkey, p_name FROM part)",
    "haystack_search": f"WITH {CORPUS} SELECT rel_path, title AS slug, title FROM corpus WHERE contains(lower(title || chr(10) || title || chr(10) || chr(10) || body), 'queque') OR contains(lower(body), 'enheit')",
    "rerank_parse": r"""SELECT id, text, CAST(CASE WHEN contains(lower(text), 'yes') THEN 1 WHEN contains(lower(text), 'no') THEN 0
      ELSE least(greatest(coalesce(TRY_CAST(regexp_extract(text, '[-+]?(?:\d+(?:\.\d*)?|\.\d+)') AS DOUBLE), 0), 0), 1) END AS DOUBLE) AS score
      FROM (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT p_partkey, 'score: ' || CASE WHEN p_size > 40 THEN '-' ELSE '' END || '0.' || p_size FROM part)""",
    "collection_stats": """SELECT name, count(d.doc_id) AS doc_count, count(d.doc_id) FILTER (coalesce(l.toxic, 0) = 0) AS active_count,
      CAST(max(DATE '2024-01-01' + CAST(d.doc_id % 365 AS INT)) AS DATE)::VARCHAR AS last_modified
      FROM (SELECT DISTINCT lang AS name FROM documents UNION ALL SELECT r_name FROM region) c
      LEFT JOIN documents d ON d.lang = c.name LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY name""",
    "index_status": f"""WITH RECURSIVE {CHUNKS}, {CORPUS}, {VECTORS}, s AS (
      SELECT c.rowid, (SELECT count(*) FROM chunks k WHERE k.rowid = c.rowid) AS k, (SELECT count(*) FROM dvecs v WHERE v.doc = c.rowid) AS v
      FROM corpus c LEFT JOIN labels l ON l.doc_id = c.rowid WHERE coalesce(l.toxic, 0) = 0)
      SELECT count(*) AS total_documents, (SELECT count(*) FROM dvecs) AS vector_count, count(*) FILTER (k > 0 AND v < k) AS needs_embedding FROM s""",
    "embed_pending": f"""WITH RECURSIVE {CHUNKS}, {CORPUS}, {VECTORS}, s AS (
      SELECT c.collection, c.rel_path, (SELECT count(*) FROM chunks k WHERE k.rowid = c.rowid) AS chunks, (SELECT count(*) FROM dvecs v WHERE v.doc = c.rowid) AS vectors
      FROM corpus c LEFT JOIN labels l ON l.doc_id = c.rowid WHERE coalesce(l.toxic, 0) = 0)
      SELECT * FROM s WHERE chunks > 0 AND vectors < chunks""",
    "incremental_diff": f"""WITH {CORPUS} SELECT collection, rel_path,
      CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality <> 1 THEN 'changed' WHEN l.toxic <> 0 THEN 'restored' ELSE 'unchanged' END AS status
      FROM corpus LEFT JOIN labels l ON l.doc_id = rowid UNION ALL SELECT 'web', url || '#' || page_id, 'removed' FROM pages""",
    "index_counts": f"WITH RECURSIVE {CHUNKS} SELECT (SELECT count(*) FROM documents) AS entries, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT CAST(max(len(embedding)) AS INT) FROM embeddings) AS dimensions",
    "wiki_page_parse": """SELECT d.doc_id, CASE WHEN lang <> 'de' THEN 'Doc ' || d.doc_id ELSE CAST(d.doc_id AS VARCHAR) END AS title,
      CAST(d.doc_id AS VARCHAR) AS slug, 'topic' AS kind, source AS summary,
      'card' || CASE WHEN quality = 1 THEN ',core' ELSE '' END || CASE WHEN toxic = 0 THEN ',explain' ELSE '' END AS section_names,
      CAST(length(rtrim(text, chr(10))) AS INT) AS card_chars
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "wiki_document_check": """SELECT 'wiki/topics/' || doc_id || '.md' AS rel_path, 'wiki/topics/' || doc_id || '.md: missing required section "' || s || '"' AS issue
      FROM (SELECT doc_id, unnest(CASE WHEN quality IS DISTINCT FROM 1 THEN ['core'] ELSE [] END
        || CASE WHEN toxic IS DISTINCT FROM 0 THEN ['explain'] ELSE [] END) AS s FROM documents LEFT JOIN labels USING (doc_id))""",
    "wiki_table_search": """SELECT 'wiki/' || lower(n_name) || '.md' AS rel_path, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS INT) AS row_no,
      c_name AS slug, c_mktsegment AS type, 'about ' || c_name AS description FROM customer JOIN nation ON n_nationkey = c_nationkey
      QUALIFY contains(lower(c_mktsegment || ' about ' || c_name || ' ' || c_name), 'building') OR contains(lower(c_name), '00001')""",
    "wiki_table_terms": "SELECT n_nationkey, CAST(count(*) AS INT) AS row_count FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey",
    "session_list": f"WITH {SESSIONS} SELECT id, updated_at, events FROM sess ORDER BY updated_at DESC, id LIMIT 500",
    "session_list_agent": f"WITH {SESSIONS} SELECT id, updated_at, agent_id FROM sess WHERE agent_id = 'click' ORDER BY updated_at DESC, id LIMIT 20",
    "session_update": f"""WITH {SESSIONS}, bought AS (SELECT CAST(user_id AS VARCHAR) AS id, max(ts) AS at,
        arg_max(CASE WHEN value > 20 THEN CAST(event_id AS VARCHAR) ELSE '' END, (ts, event_id)) AS run FROM events WHERE event_type = 'purchase' GROUP BY user_id)
      SELECT s.id, coalesce(b.at, s.updated_at) AS updated_at, CASE WHEN b.run <> '' THEN 'running' ELSE 'idle' END AS status,
        coalesce(b.run, '') AS last_run_id, 'thr_' || s.id AS backend_thread_id FROM sess s LEFT JOIN bought b USING (id)""",
    "session_edit": f"""WITH {SESSIONS}, bought AS (SELECT CAST(user_id AS VARCHAR) AS id, max(ts) AS at, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id)
      SELECT s.id, coalesce(substr(trim(repeat(s.id || ' buys ', n)), 1, 80), 'user ' || s.id) AS title, coalesce(b.at, s.updated_at) AS updated_at
      FROM sess s LEFT JOIN bought b USING (id) WHERE CAST(s.id AS BIGINT) % 7 <> 0""",
    "message_ordinals": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal FROM events",
    "message_upsert": "SELECT conv_id || '/' || role AS id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) = 1",
    "latest_user_message": "SELECT conv_id, turn, substr(trim(text), 1, 30) AS title FROM conversations WHERE role = 'user' AND text <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "run_status_fold": """SELECT user_id, arg_max(CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END, (ts, event_id)) AS status,
      count(*) AS changes FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY user_id""",
    "event_text_runs": f"WITH {RUN_ROWS} "
    + " UNION ALL ".join(
        [
            _event(0, "TEXT_MESSAGE_START", "is_text AND NOT after_text"),
            _event(1, "TEXT_MESSAGE_CONTENT", "is_text", body="content"),
            _event(0, "TEXT_MESSAGE_END", "NOT is_text AND after_text"),
            _event(1, "TOOL_CALL_START", "kind = 'tool_use'", "call_id", "'exec_command'"),
            _event(2, "TOOL_CALL_ARGS", "kind = 'tool_use' AND value > 10", "call_id", "props"),
            _event(1, "TOOL_CALL_END", "kind = 'tool_result'", "call_id"),
            _event(2, "TOOL_CALL_RESULT", "kind = 'tool_result' AND value > 10", "call_id", "props"),
            "SELECT user_id, event_id, 0, 'RUN_ERROR', -1, '', content FROM msgs WHERE kind = 'error'",
            "SELECT user_id, -1, 0, 'TEXT_MESSAGE_END', message_no, '', '' FROM (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE is_text",
        ]
    ),
    "event_saved_messages": f"""WITH {RUN_ROWS} SELECT user_id, message_no, 'assistant' AS role, '' AS tool_call_id, string_agg(content, '' ORDER BY ts, event_id) AS content
      FROM numbered WHERE is_text GROUP BY user_id, message_no
      UNION ALL SELECT user_id, message_no, 'tool', call_id, props FROM numbered WHERE kind = 'tool_result' AND value > 10""",
    "event_notifications": """WITH noted AS (
      SELECT user_id || '/' || CAST(ts AS DATE) AS run_id, (ts, event_id) AS pos, event_id, props, '[' || event_id || ']' AS mark, CASE
        WHEN event_type = 'view' THEN 'text' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'tool_use' WHEN event_type = 'click' THEN 'tool_result'
        WHEN event_type = 'signup' THEN 'turn' WHEN event_type = 'purchase' AND value > 50 THEN 'end' WHEN event_type = 'purchase' THEN 'idle'
        WHEN value > 10 THEN 'error_end' END AS kind FROM events),
    marked AS (
      SELECT *, coalesce(bool_or(kind = 'turn') OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS opened FROM noted),
    stops AS (SELECT *, kind IN ('end', 'error_end') OR (kind = 'idle' AND opened) AS stop FROM marked WHERE kind IS NOT NULL),
    kept AS (
      SELECT * EXCLUDE (kind), CASE WHEN kind = 'idle' THEN 'end' ELSE kind END AS kind, CASE WHEN kind = 'error_end' THEN mark
        WHEN kind = 'end' AND event_id % 4 = 2 THEN 'turn was aborted'
        WHEN kind = 'end' AND event_id % 4 IN (1, 3) THEN CASE WHEN event_id % 8 < 4 THEN mark ELSE 'codex turn failed' END ELSE '' END AS failure
      FROM (SELECT *, count(*) FILTER (stop) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM stops)
      WHERE before = 0 AND kind <> 'turn' AND (kind <> 'idle' OR stop)),
    linked AS (SELECT *, kind = 'text' AS is_text, coalesce(lag(kind = 'text') OVER w, false) AS after_text,
      lead(kind) OVER w IS NULL AS is_last FROM kept WINDOW w AS (PARTITION BY run_id ORDER BY pos)),
    numbered AS (SELECT *, CAST(sum(CASE WHEN is_text AND NOT after_text THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY pos) AS BIGINT) AS message_no FROM linked)
    """
    + " UNION ALL ".join(
        f"SELECT run_id, {event} AS event_id, CAST({seq} AS INT) AS seq, '{kind}' AS type, {no} AS message_no, {call} AS call_id, {body} AS body FROM numbered WHERE {when}"
        for event, seq, kind, no, call, body, when in (
            ("event_id", 0, "TEXT_MESSAGE_START", "message_no", "''", "''", "is_text AND NOT after_text"),
            ("event_id", 1, "TEXT_MESSAGE_CONTENT", "message_no", "''", "mark", "is_text"),
            ("-1", 0, "TEXT_MESSAGE_END", "message_no", "''", "''", "is_text AND is_last"),
            ("event_id", "CASE WHEN kind = 'error_end' THEN 1 ELSE 0 END", "TEXT_MESSAGE_END", "message_no", "''", "''", "NOT is_text AND after_text"),
            ("event_id", 1, "TOOL_CALL_START", "message_no", "CAST(event_id AS VARCHAR)", "'exec_command'", "kind = 'tool_use'"),
            ("event_id", 2, "TOOL_CALL_ARGS", "message_no", "CAST(event_id AS VARCHAR)", "'{\"command\":\"' || mark || '\"}'", "kind = 'tool_use'"),
            ("event_id", 1, "TOOL_CALL_END", "message_no", "CAST(event_id AS VARCHAR)", "''", "kind = 'tool_result'"),
            ("event_id", 2, "TOOL_CALL_RESULT", "message_no", "CAST(event_id AS VARCHAR)", "props", "kind = 'tool_result' AND props <> ''"),
            ("event_id", 1, "RUN_FINISHED", "-1", "''", "''", "kind = 'end' AND failure = ''"),
            ("event_id", 1, "RUN_ERROR", "-1", "''", "failure", "kind = 'end' AND failure <> ''"),
            ("event_id", 0, "RUN_ERROR", "-1", "''", "failure", "kind = 'error_end'"),
            ("event_id", 2, "RUN_ERROR", "-1", "''", "failure", "kind = 'error_end'"),
        )
    ),
    "json_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
}
