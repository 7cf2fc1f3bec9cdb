"""SQL twins of the registered queries, over the same whole tables."""

from __future__ import annotations

from reviewsieve.operators.curves import T_975
from reviewsieve.operators.policies import POLICIES
from reviewsieve.registry.fixtures import RUNS, STUDY_POLICIES

RUN = "topic, policy, run"

ARTICLES = """
articles AS (
  SELECT lang AS topic, doc_id AS pmid, split_part(text, chr(10), 1) AS title,
         CASE WHEN strpos(text, chr(10)) > 0
              THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS abstract
  FROM documents)"""
JUDGED = """
judged AS (
  SELECT lang AS topic, doc_id AS pmid, toxic AS label FROM labels JOIN documents USING (doc_id))"""
ITEMS = """
judged AS (
  SELECT 'vectors' AS topic, vec_id AS pmid, CAST(label = 0 AS INTEGER) AS label FROM embeddings),
dims AS (
  SELECT pmid, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x
  FROM (SELECT vec_id AS pmid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"""
WORDS = ARTICLES + """,
fields AS (
  SELECT topic, pmid, 'title' AS field, title AS text FROM articles
  UNION ALL SELECT topic, pmid, 'abstract', abstract FROM articles),
runs_of_words AS (
  SELECT topic, pmid, field,
         unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{Nl}\\p{No}_]+)', 1)) AS word
  FROM fields),
words AS (
  SELECT * FROM runs_of_words
  WHERE length(word) BETWEEN 2 AND 15 AND NOT starts_with(word, '_'))"""
VOCABULARY = WORDS + """,
vocabulary AS (
  SELECT word, embedding AS vector
  FROM (SELECT DISTINCT word FROM words) JOIN embeddings
    ON CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % greatest(1, 2 * (SELECT count(*) FROM embeddings)) = vec_id)"""
LINES = r"""
lines AS (
  SELECT concat_ws(' ', lang, '0', doc_id, toxic) AS value, 'toxic' AS source_set,
         lang AS cd, doc_id AS pmid, toxic AS label
  FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL
  SELECT '  ' || concat_ws(chr(9), lang, '0', doc_id, quality) || ' ' || chr(9), 'quality',
         lang, doc_id, quality
  FROM documents LEFT JOIN labels USING (doc_id))"""
VERSIONS = ARTICLES + """,
base AS (
  SELECT a.*, l.quality, l.toxic FROM articles a JOIN labels l ON l.doc_id = a.pmid),
versions AS (
  SELECT topic, pmid, title, abstract, quality, toxic, pmid AS seq FROM base
  UNION ALL
  SELECT topic, pmid, 'new: ' || title, abstract, quality, toxic, pmid + 1000000000000
  FROM base WHERE quality = 0)"""
RECORDS = VERSIONS + """,
records AS (
  SELECT pmid, arg_max(title, seq) AS title, arg_max(abstract, seq) AS abstract
  FROM versions WHERE abstract <> '' GROUP BY pmid)"""
XML = r"""
clean AS (
  SELECT doc_id, lang, source, n_chars,
         regexp_replace(split_part(text, chr(10), 1),
           '[^\t\n\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g') AS title,
         regexp_replace(CASE WHEN strpos(text, chr(10)) > 0
             THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END,
           '[^\t\n\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g') AS abstract
  FROM documents),
xml_rows AS (
  SELECT doc_id // 250 AS response, lang = 'de' AS is_book, CAST(doc_id AS VARCHAR) AS pmid,
         nullif(title, '') AS title, title AS raw_title,
         CASE WHEN abstract = '' THEN 'Abstract not available' ELSE abstract END AS abstract,
         CASE WHEN lang = 'de' THEN source END AS book_title, lang, source, n_chars
  FROM clean)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(part.strip() for part in parts)


def _log(policies: tuple[str, ...], only: str = "") -> str:
    starts = ", ".join(
        f"('{p}', {run}, {10 * POLICIES.index(p) + run})" for p in policies for run in range(RUNS)
    )
    return f"""
placed AS (
  SELECT {RUN}, pmid, label,
         row_number() OVER (PARTITION BY {RUN}
           ORDER BY md5(concat_ws('|', seed, pmid)), pmid) AS pos
  FROM judged CROSS JOIN (VALUES {starts}) AS s(policy, run, seed)),
log AS (
  SELECT * FROM (
    SELECT {RUN}, pmid, label, pos,
           CAST(CASE WHEN pos <= 4 THEN 0 ELSE (pos - 5) // 25 + 1 END AS INTEGER) AS round,
           CAST(CASE WHEN pos <= 4 THEN pos ELSE (pos - 5) % 25 + 1 END AS INTEGER)
             AS rank_in_round
    FROM placed) {only})"""


SO_FAR = "WHERE round <= run + 1"


def _pool(policies: tuple[str, ...], seed: int = 0) -> str:
    """Unlabelled rows of broken-off reviews with their next round and draw."""
    return _log(policies, SO_FAR) + f""",
state AS (
  SELECT {RUN}, max(round) + 1 AS round,
         sum(CASE WHEN label = 1 AND round > 0 THEN 1 ELSE 0 END) AS found
  FROM log GROUP BY {RUN}),
here AS (
  SELECT s.topic, s.policy, s.run, CAST(s.round AS INTEGER) AS round, j.pmid, j.label,
         md5(concat_ws('|', {seed} + s.run, s.round, j.pmid)) AS draw,
         CAST('0x' || substr(md5(concat_ws('|', 'p', j.pmid)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE
           AS p,
         s.found / nullif((SELECT count(*) FROM judged n WHERE n.topic = s.topic AND n.label = 1), 0)
           AS recall
  FROM judged j JOIN state s USING (topic)
  WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.topic = s.topic AND l.policy = s.policy
                    AND l.run = s.run AND l.pmid = j.pmid))"""


def _margin_picks(policy: str, largest: str) -> str:
    return _with(JUDGED, _pool((policy,))) + f""",
ranked AS (
  SELECT *, abs(2 * p - 1) AS m,
         row_number() OVER (PARTITION BY {RUN}, round ORDER BY
           CASE WHEN {largest} THEN -abs(2 * p - 1) ELSE abs(2 * p - 1) END, draw, pmid) AS place
  FROM here)
SELECT {RUN}, round, CAST(row_number() OVER (PARTITION BY {RUN}, round ORDER BY m, draw, pmid)
       AS INTEGER) AS rank_in_round, pmid
FROM ranked WHERE place <= 25"""


def _distances(policy: str) -> str:
    return _with(ITEMS, _pool((policy,))) + f""",
vectors AS (SELECT vec_id AS pmid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
measured AS (
  SELECT h.topic, h.policy, h.run, h.round, h.pmid, h.draw,
         min(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2))))
           AS min_dist
  FROM here h JOIN vectors a ON a.pmid = h.pmid
  JOIN log l ON l.topic = h.topic AND l.policy = h.policy AND l.run = h.run
  JOIN vectors b ON b.pmid = l.pmid
  GROUP BY ALL)"""


def _min_variance_step(step: int, source: str = "here") -> str:
    """The row nearest to the mean of the labelled rows and of the picks so far."""
    earlier = "".join(f" UNION ALL SELECT {RUN}, pmid FROM pick{i}" for i in range(1, step))
    gone = "".join(
        f" AND NOT EXISTS (SELECT 1 FROM pick{i} q WHERE q.run = h.run AND q.pmid = h.pmid)"
        for i in range(1, step)
    )
    return f""",
centre{step} AS (
  SELECT {RUN}, dim, avg(x) AS m
  FROM (SELECT {RUN}, pmid FROM log{earlier}) k JOIN dims USING (pmid) GROUP BY {RUN}, dim),
gaps{step} AS (
  SELECT h.topic, h.policy, h.run, h.round, h.pmid, h.draw, sqrt(sum((d.x - c.m) ** 2)) AS gap
  FROM {source} h JOIN dims d ON d.pmid = h.pmid
  JOIN centre{step} c ON c.topic = h.topic AND c.policy = h.policy AND c.run = h.run
    AND c.dim = d.dim
  WHERE true{gone} GROUP BY ALL),
pick{step} AS (
  SELECT {RUN}, round, CAST({step} AS INTEGER) AS rank_in_round, pmid
  FROM (SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY gap, draw, pmid) AS n
        FROM gaps{step}) WHERE n = 1)"""


# Ten seeds for every policy, and the fifty articles that all of them may choose from first.
_FIRST_ROUND = f"""
classed AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY draw, pmid) AS n
  FROM (SELECT *, md5(concat_ws('|', 0, pmid)) AS draw FROM judged)),
seeds AS MATERIALIZED (
  SELECT topic, pmid, label FROM classed
  QUALIFY row_number() OVER (ORDER BY CASE WHEN n = 1 THEN label ELSE 2 END, draw, pmid) <= 10),
chosen_by AS (SELECT unnest([{", ".join(f"'{p}'" for p in POLICIES)}]) AS policy),
log AS MATERIALIZED (SELECT topic, policy, CAST(0 AS INTEGER) AS run, pmid, label FROM seeds, chosen_by),
here AS MATERIALIZED (
  SELECT topic, policy, CAST(0 AS INTEGER) AS run, CAST(1 AS INTEGER) AS round, pmid, label, draw
  FROM (SELECT topic, pmid, label, md5(concat_ws('|', 0, 1, pmid)) AS draw FROM judged
        WHERE pmid NOT IN (SELECT pmid FROM seeds)
        QUALIFY row_number() OVER (ORDER BY draw, pmid) <= 50), chosen_by)"""


def _farthest_step(step: int) -> str:
    """The five rows farthest from all that is labelled before this round."""
    earlier = "".join(f" UNION ALL SELECT pmid FROM far{i}" for i in range(1, step))
    return f""",
known{step} AS MATERIALIZED (SELECT pmid FROM start{earlier}),
gaps{step} AS MATERIALIZED (
  SELECT a.pmid, md5(concat_ws('|', 0, {step}, a.pmid)) AS draw, min(list_distance(a.v, b.v)) AS gap
  FROM vectors a, known{step} k JOIN vectors b ON b.pmid = k.pmid
  WHERE a.pmid NOT IN (SELECT pmid FROM known{step}) GROUP BY ALL),
far{step} AS MATERIALIZED (
  SELECT 'vectors' AS topic, 'diversity' AS policy, CAST(0 AS INTEGER) AS run,
         CAST({step} AS INTEGER) AS round,
         CAST(row_number() OVER (ORDER BY gap, draw, pmid) AS INTEGER) AS rank_in_round, pmid
  FROM (SELECT *, row_number() OVER (ORDER BY gap DESC, draw, pmid) AS n FROM gaps{step})
  WHERE n <= 5)"""


# Accelerated gradient steps until the fit stands; a step moves by the inverse of a bound on the
# curvature, a quarter of the sum of squares plus the penalty's.
_FIT = f""",
vectors AS (SELECT vec_id AS pmid, list_append(CAST(embedding AS DOUBLE[]), 1.0) AS v FROM embeddings),
given AS MATERIALIZED (
  SELECT {RUN}, list(v ORDER BY pmid) AS x, list(CAST(label AS DOUBLE) ORDER BY pmid) AS y
  FROM log JOIN vectors USING (pmid) GROUP BY {RUN}
  HAVING count(DISTINCT label) = 2),
sides AS MATERIALIZED (
  SELECT *, list_transform(range(1, len(x[1]) + 1), lambda i: list_transform(x, lambda r: r[i])) AS t,
         1 + list_sum(list_transform(x, lambda r: list_dot_product(r, r))) / 4 AS bend
  FROM given),
fit AS (
  SELECT {RUN}, 0 AS step, list_transform(x[1], lambda z: 0.0::DOUBLE) AS w,
         list_transform(x[1], lambda z: 0.0::DOUBLE) AS before
  FROM sides
  UNION ALL
  SELECT {RUN}, step + 1,
         list_transform(range(1, len(ahead) + 1), lambda i: ahead[i] - (list_dot_product(t[i], miss)
           + CASE WHEN i < len(ahead) THEN ahead[i] ELSE 0 END) / bend), w
  FROM (
    SELECT *, list_transform(range(1, len(x) + 1),
                lambda r: 1 / (1 + exp(-list_dot_product(x[r], ahead))) - y[r]) AS miss
    FROM (
      SELECT f.*, s.x, s.y, s.t, s.bend,
             list_transform(range(1, len(w) + 1), lambda i:
               w[i] + (sqrt(bend) - 1) / (sqrt(bend) + 1) * (w[i] - before[i])) AS ahead
      FROM fit f JOIN sides s USING ({RUN}) WHERE step < 600))),
fitted AS (SELECT {RUN}, w FROM fit WHERE step = 600)"""

# Squared distance of two vectors; seeds of a round; one chance a row and round.
_GAP = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) ** 2))"
_CHANCE = "CAST('0x' || substr(md5(concat_ws('|', 0, {0}, h.draw)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


def _seeding(i: int, k: int) -> str:
    return f""",
near{i} AS MATERIALIZED (
  SELECT h.run, h.pmid, h.draw, h.v, {_CHANCE.format(i)} AS chance, min({_GAP.format("h.v", "s.v")}) AS gap
  FROM points h JOIN seeds{i} s ON s.run = h.run GROUP BY ALL),
seeds{i + 1} AS MATERIALIZED (
  SELECT * FROM seeds{i} UNION ALL
  SELECT run, pmid, draw, v FROM (SELECT *, sum(gap) OVER (PARTITION BY run) AS total FROM near{i})
  WHERE chance * total < 2 * {k} * gap)"""


def _clusters(k: int, source: str = "here") -> str:
    """Seeds, their reduction to k, ten steps, and the rows of ``source`` with their cluster."""
    return f""",
points AS MATERIALIZED (
  SELECT h.*, v FROM {source} h
  JOIN (SELECT vec_id AS pmid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) USING (pmid)),
seeds0 AS MATERIALIZED (
  SELECT run, pmid, draw, v FROM points
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY draw, pmid) = 1)""" + "".join(
        _seeding(i, k) for i in range(3)
    ) + f""",
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY draw, pmid) AS i FROM seeds3),
weighed AS (
  SELECT run, i, count(*) AS weight FROM (
    SELECT h.run, s.i FROM points h JOIN numbered s ON s.run = h.run
    QUALIFY row_number() OVER (PARTITION BY h.run, h.pmid ORDER BY {_GAP.format("h.v", "s.v")}, s.i) = 1)
  GROUP BY run, i),
offered AS MATERIALIZED (
  SELECT run, list(v ORDER BY i) AS s, list(coalesce(weight, 0) ORDER BY i) AS w
  FROM numbered LEFT JOIN weighed USING (run, i) GROUP BY run),
chosen AS (
  SELECT run, 1 AS n, [list_position(w, list_max(w))] AS c,
         list_transform(s, lambda x: {_GAP.format("x", "s[list_position(w, list_max(w))]")}) AS gap
  FROM offered
  UNION ALL
  SELECT run, n + 1, list_append(c, best), list_transform(range(1, len(s) + 1),
           lambda j: least(gap[j], {_GAP.format("s[j]", "s[best]")}))
  FROM (
    SELECT *, list_position(score, list_max(score)) AS best
    FROM (SELECT f.*, s, list_transform(range(1, len(s) + 1), lambda j: w[j] * gap[j]) AS score
          FROM chosen f JOIN offered USING (run) WHERE n < {k} AND len(s) > {k}))),
first AS MATERIALIZED (
  SELECT run, CASE WHEN len(s) <= {k} THEN s ELSE list_transform(c, lambda j: s[j]) END AS m
  FROM offered JOIN chosen USING (run) QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC) = 1),
rows_of AS MATERIALIZED (SELECT run, list(v ORDER BY pmid) AS x FROM points GROUP BY run),
steps AS (
  SELECT run, 0 AS step, m FROM first
  UNION ALL
  SELECT run, step + 1, list_transform(range(1, len(m) + 1), lambda k:
    CASE WHEN len(list_filter(a, lambda z: z = k)) = 0 THEN m[k] ELSE
      list_transform(range(1, len(m[k]) + 1), lambda j: list_avg(list_transform(
        list_filter(range(1, len(x) + 1), lambda r: a[r] = k), lambda r: x[r][j]))) END)
  FROM (
    SELECT *, list_transform(d, lambda e: list_position(e, list_min(e))) AS a
    FROM (SELECT t.*, x, list_transform(x, lambda p: list_transform(m, lambda q: list_distance(p, q))) AS d
          FROM steps t JOIN rows_of USING (run) WHERE step < 10))),
grouped AS (
  SELECT *, list_position(e, list_min(e)) - 1 AS cluster
  FROM (SELECT h.topic, h.policy, h.run, h.round, h.pmid, h.draw,
               list_transform(m, lambda q: list_distance(h.v, q)) AS e
        FROM points h JOIN steps t ON t.run = h.run AND t.step = 10))"""


def _curve(policies: tuple[str, ...] = STUDY_POLICIES) -> str:
    return _log(policies) + f""",
totals AS (
  SELECT topic, count(*) AS n_all, count(*) FILTER (WHERE label = 1) AS n_included
  FROM judged GROUP BY topic),
rounds AS (
  SELECT {RUN}, round, count(*) AS revealed,
         count(*) FILTER (WHERE label = 1 AND round > 0) AS hits
  FROM log GROUP BY {RUN}, round),
running AS (
  SELECT *, CAST(coalesce(sum(revealed) OVER w, 0) AS BIGINT) AS labelled,
         CAST(coalesce(sum(hits) OVER w, 0) AS BIGINT) AS found
  FROM rounds
  WINDOW w AS (PARTITION BY {RUN} ORDER BY round
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
curve AS (
  SELECT {RUN}, round, labelled, found, 100.0::DOUBLE * labelled / n_all AS effort_pct,
         100.0::DOUBLE * found / nullif(n_included, 0) AS recall_pct
  FROM running JOIN totals USING (topic) WHERE round > 0)"""


def _area(curve: str, y: str, name: str) -> str:
    return f"""
{name}_pairs AS (
  SELECT *, lag(effort_pct) OVER w AS px, lag({y}) OVER w AS py FROM {curve}
  WINDOW w AS (PARTITION BY {RUN} ORDER BY round)),
{name} AS (
  SELECT {RUN}, CASE WHEN count(*) FILTER (WHERE {y} IS NULL) = 0
         THEN coalesce(sum((effort_pct - px) * ({y} + py) / 2), 0) END AS auc
  FROM {name}_pairs GROUP BY {RUN})"""


def _coverage(prefix: str) -> str:
    """Running population variance per dimension over the reveal order."""
    at = "r.round" if prefix == "index" else "r.labelled"
    return f"""
whole AS (SELECT dim, var_pop(x) AS v FROM dims GROUP BY dim),
prefix_variance AS (
  SELECT {RUN}, pos, dim, var_pop(x) OVER (PARTITION BY {RUN}, dim ORDER BY pos) AS v
  FROM log JOIN dims USING (pmid)),
covered AS (
  SELECT {RUN}, pos, least(100 * avg(
           CASE WHEN p.v = 0 THEN 1e-10 ELSE p.v END / CASE WHEN w.v = 0 THEN 1e-10 ELSE w.v END
         ), 100) AS coverage_pct
  FROM prefix_variance p JOIN whole w USING (dim) GROUP BY {RUN}, pos),
coverage AS (
  SELECT r.topic, r.policy, r.run, r.round, coalesce(c.coverage_pct, 0) AS coverage_pct
  FROM running r LEFT JOIN covered c ON c.topic = r.topic AND c.policy = r.policy
    AND c.run = r.run AND c.pos = {at}
  WHERE r.round > 0)"""


_GRID = f"""
sizes AS (SELECT {RUN}, count(*) AS n FROM curve GROUP BY {RUN}),
longest AS (SELECT topic, policy, max(n) AS size FROM sizes GROUP BY topic, policy),
places AS (
  SELECT {RUN}, unnest(range(size)) AS grid, size
  FROM sizes JOIN longest USING (topic, policy)),
grid_points AS (
  SELECT *, CASE WHEN size > 1 THEN grid * 100.0::DOUBLE / (size - 1) ELSE 0 END AS grid_x
  FROM places),
around AS (
  SELECT {RUN}, grid, grid_x,
         max(effort_pct) FILTER (WHERE effort_pct <= grid_x) AS x0,
         arg_max(recall_pct, effort_pct) FILTER (WHERE effort_pct <= grid_x) AS y0,
         min(effort_pct) FILTER (WHERE effort_pct >= grid_x) AS x1,
         arg_min(recall_pct, effort_pct) FILTER (WHERE effort_pct >= grid_x) AS y1
  FROM grid_points JOIN curve USING ({RUN}) GROUP BY {RUN}, grid, grid_x),
on_grid AS (
  SELECT {RUN}, grid, grid_x,
         CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN x0 = x1 THEN y0
              ELSE y0 + (y1 - y0) / (x1 - x0) * (grid_x - x0) END AS recall_pct
  FROM around)"""



def _grid(curve: str = "curve", y: str = "recall_pct") -> str:
    read = _GRID.replace("FROM curve ", f"FROM {curve} ").replace("JOIN curve ", f"JOIN {curve} ")
    return read.replace("recall_pct", y)


GRID = _grid()
BOTH_CURVES = f"both_curves AS (SELECT * FROM curve JOIN coverage USING ({RUN}, round))"


def _band(y: str, columns: str = "") -> str:
    return f"""
SELECT topic, policy, {columns}grid, runs, round(m, 4) AS mean,
       round(m - t.v * sem, 4) AS low, round(m + t.v * sem, 4) AS high
FROM (SELECT topic, policy, grid, count({y}) AS runs, avg({y}) AS m,
             stddev_samp({y}) / sqrt(count({y})) AS sem
      FROM on_grid GROUP BY topic, policy, grid)
LEFT JOIN (VALUES {_T}) AS t(df, v) ON t.df = runs - 1"""


_T = ", ".join(f"({df}, {t}::DOUBLE)" for df, t in enumerate(T_975, start=1))

ORACLES: dict[str, str] = {
    "qrels_scan": _with(LINES) + """
SELECT source_set, cd, CAST(0 AS INTEGER) AS misc, pmid, label FROM lines WHERE label IS NOT NULL""",
    "qrels_rejects": _with(LINES) + """
SELECT source_set, value, 'columns: 3' AS reason FROM lines WHERE label IS NULL""",
    "topics": _with(LINES) + """
SELECT DISTINCT cd FROM lines WHERE label IS NOT NULL""",
    "topic_scan": _with(VERSIONS) + """
SELECT topic, CAST(pmid AS VARCHAR) AS pmid, arg_max(toxic, seq) AS label, min(seq) AS first_seq,
       arg_max(title, seq) AS title, md5(arg_max(abstract, seq)) AS abstract_md5
FROM versions GROUP BY topic, pmid""",
    "topic_files": _with(VERSIONS) + """
SELECT topic, CAST(pmid AS VARCHAR) AS pmid, toxic AS label, md5(title) AS title_md5 FROM base""",
    "topic_counts": _with(JUDGED) + """
SELECT topic, count(*) AS n_all, count(*) FILTER (WHERE label = 1) AS n_included,
       count(*) FILTER (WHERE label = 0) AS n_excluded
FROM judged GROUP BY topic""",
    "enrich": _with(LINES, RECORDS) + """
SELECT source_set, cd, CAST(0 AS INTEGER) AS misc, CAST(l.pmid AS VARCHAR) AS pmid, label, r.title,
       md5(r.abstract) AS abstract_md5
FROM lines l LEFT JOIN records r USING (pmid) WHERE label IS NOT NULL""",
    "enrich_unmatched": _with(LINES, RECORDS) + """
SELECT source_set, cd, CAST(pmid AS VARCHAR) AS pmid FROM lines
WHERE label IS NOT NULL AND pmid NOT IN (SELECT pmid FROM records)""",
    "xml_records": _with(XML) + """
SELECT response, is_book, pmid, title, book_title, md5(abstract) AS abstract_md5 FROM xml_rows""",
    "xml_bulk_scan": _with(XML) + """
SELECT is_book, pmid, source FROM xml_rows""",
    "xml_full_text": _with(XML) + r"""
SELECT pmid, trim(regexp_replace(raw_title || 'more text', '[ \t\n\x{0B}\f\r]+', ' ', 'g'))
       AS title,
       md5(trim(regexp_replace(abstract, '[ \t\n\x{0B}\f\r]+', ' ', 'g'))) AS abstract_md5
FROM xml_rows""",
    "xml_citations": _with(XML) + """
SELECT pmid, CASE WHEN is_book THEN 'editor; ' || source || ', ' || lang
            ELSE source || ', ' || lang || '; ' || source END AS authors,
       CASE WHEN NOT is_book THEN source END AS journal,
       CASE WHEN NOT is_book THEN (2000 + n_chars % 20) || '-May'
            || CASE WHEN n_chars > 500 THEN '-7' ELSE '' END END AS pubdate,
       CASE WHEN NOT is_book AND n_chars > 1000 THEN '10.1/' || pmid
            ELSE 'DOI not available' END AS doi
FROM xml_rows""",
    "xml_attributes": _with(XML) + """
SELECT pmid AS "PMID", coalesce(book_title, 'BookTitle not available') AS "BookTitle",
       CASE WHEN NOT is_book AND n_chars > 500 THEN '7' ELSE 'Day not available' END AS "Day"
FROM xml_rows""",
    "xml_tag_texts": _with(XML) + r"""
, tagged AS (
  SELECT pmid, 'PMID' AS tag, pmid AS text FROM xml_rows
  UNION ALL SELECT pmid, 'ArticleTitle', raw_title FROM xml_rows
  UNION ALL SELECT pmid, 'i', 'more' FROM xml_rows
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'AbstractText', abstract FROM clean
  UNION ALL SELECT pmid, 'LastName', source FROM xml_rows
  UNION ALL SELECT pmid, 'ForeName', lang FROM xml_rows
  UNION ALL SELECT pmid, 'CollectiveName', source FROM xml_rows WHERE NOT is_book
  UNION ALL SELECT pmid, 'BookTitle', source FROM xml_rows WHERE is_book
  UNION ALL SELECT pmid, 'Title', source FROM xml_rows WHERE NOT is_book
  UNION ALL SELECT pmid, 'Year', CAST(2000 + n_chars % 20 AS VARCHAR) FROM xml_rows WHERE NOT is_book
  UNION ALL SELECT pmid, 'Month', 'May' FROM xml_rows WHERE NOT is_book
  UNION ALL SELECT pmid, 'Day', '7' FROM xml_rows WHERE NOT is_book AND n_chars > 500
  UNION ALL SELECT pmid, 'ArticleId', '10.1/' || pmid FROM xml_rows WHERE NOT is_book AND n_chars > 1000)
SELECT tag, count(*) AS records, count(DISTINCT text) AS texts,
       CAST(sum(CAST('0x' || substr(md5(pmid || '|' || text), 1, 8) AS BIGINT)) AS BIGINT) AS mark
FROM tagged WHERE regexp_matches(text, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')
GROUP BY tag""",
    "xml_rejects": """
SELECT doc_id AS response,
       CASE WHEN lang = 'es' THEN 'error: no record of ' || doc_id ELSE 'not well formed' END AS reason
FROM documents WHERE lang IN ('es', 'fr')""",
    "xml_requested": _with(XML) + """
SELECT pmid, is_book FROM xml_rows WHERE CAST(pmid AS BIGINT) IN (SELECT doc_id FROM labels)""",
    "record_text": _with(XML) + r"""
SELECT pmid, md5(CASE WHEN is_book
    THEN 'PMID: ' || pmid || chr(10) || 'Book Title: ' || book_title || chr(10)
         || 'Chapter Title: ' || coalesce(title, 'null') || chr(10) || 'Abstract: ' || abstract
    ELSE 'PMID: ' || pmid || chr(10) || 'Title: ' || coalesce(title, 'null') || chr(10)
         || 'Abstract: ' || abstract END) AS text_md5
FROM xml_rows""",
    "fetch_plan": """
WITH placed AS (
  SELECT lang AS topic, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 1000
         AS batch FROM documents)
SELECT topic, batch, count(*) AS n_ids, CASE WHEN count(*) > 200 THEN 'POST' ELSE 'GET' END AS method,
       string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS id_list
FROM placed GROUP BY topic, batch""",
    "word_vectors": _with(VOCABULARY) + """
SELECT word, CAST(len(vector) AS INTEGER) AS width,
       round(list_sum(CAST(vector AS DOUBLE[])), 4) AS total,
       round(CAST(vector[1] AS DOUBLE), 4) AS "first"
FROM vocabulary""",
    "tokens": _with(WORDS) + """
SELECT field, word, count(DISTINCT pmid) AS articles, count(*) AS occurrences
FROM words GROUP BY field, word""",
    "doc_vectors": _with(VOCABULARY) + """
, known AS (
  SELECT pmid, field, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS dim
  FROM words JOIN vocabulary USING (word)),
means AS (
  SELECT pmid, CASE WHEN field = 'title' THEN dim ELSE dim + 64 END AS dim,
         avg(CAST(x AS DOUBLE)) AS value
  FROM known GROUP BY pmid, field, dim)
SELECT a.pmid, CAST(d.dim AS INTEGER) AS dim, coalesce(round(m.value, 4), 0) AS value
FROM articles a CROSS JOIN (SELECT unnest(range(128)) AS dim) d
LEFT JOIN means m ON m.pmid = a.pmid AND m.dim = d.dim""",
    "shuffle": """
SELECT lang AS topic, doc_id AS pmid,
       row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', 42, doc_id)), doc_id) AS pos
FROM documents""",
    "start_pool": _with(JUDGED) + """
, drawn AS (SELECT *, md5(concat_ws('|', 7, pmid)) AS draw FROM judged),
classed AS (
  SELECT *, row_number() OVER (PARTITION BY topic, label ORDER BY draw, pmid) AS n FROM drawn),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY
           CASE WHEN n = 1 AND label IN (0, 1) THEN label ELSE 2 END, draw, pmid) AS rank_in_round
  FROM classed)
SELECT topic, CAST(rank_in_round AS INTEGER) AS rank_in_round, pmid, label
FROM ordered WHERE rank_in_round <= 6""",
    "seed_pools": _with(JUDGED) + """
, drawn AS (
  SELECT *, md5(concat_ws('|', 0, attempt, pmid)) AS draw
  FROM judged CROSS JOIN (SELECT unnest(range(50)) AS attempt)),
classed AS (
  SELECT *, row_number() OVER (PARTITION BY topic, attempt, label ORDER BY draw, pmid) AS n
  FROM drawn),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY topic, attempt ORDER BY
           CASE WHEN n = 1 AND label IN (0, 1) THEN label ELSE 2 END, draw, pmid) AS place
  FROM classed),
pools AS (
  SELECT topic, attempt, string_agg(CAST(pmid AS VARCHAR), ',' ORDER BY pmid) AS pmids,
         bool_or(label = 0) AND bool_or(label = 1) AS both_classes
  FROM ordered WHERE place <= 4 GROUP BY topic, attempt),
different AS (
  SELECT topic, pmids, CAST(min(attempt) AS INTEGER) AS attempt, bool_and(both_classes) AS both_classes
  FROM pools GROUP BY topic, pmids)
SELECT topic, CAST(pool_id AS INTEGER) AS pool_id, attempt, pmids, both_classes
FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY attempt) AS pool_id FROM different)
WHERE pool_id <= 5""",
    "pool_state": _with(JUDGED, _pool(("random", "certainty"))) + f"""
SELECT {RUN}, pmid FROM here""",
    "run_state": _with(JUDGED, _log(STUDY_POLICIES, SO_FAR)) + f""",
totals AS (
  SELECT topic, count(*) AS n_all, count(*) FILTER (WHERE label = 1) AS n_included
  FROM judged GROUP BY topic),
runs AS (
  SELECT {RUN}, max(round) AS last_round, count(*) AS n_labelled,
         count(*) FILTER (WHERE label = 1 AND round > 0) AS found
  FROM log GROUP BY {RUN})
SELECT {RUN}, last_round, n_labelled, n_all - n_labelled AS n_pool, found,
       round(found / nullif(n_included, 0), 4) AS recall,
       n_all = n_labelled OR (found = n_included AND n_included > 0) AS done
FROM runs JOIN totals USING (topic)""",
    "candidates": _with(JUDGED, _pool(("random", "certainty"), 3)) + f"""
SELECT {RUN}, CAST(run + 2 AS INTEGER) AS round, pmid FROM (
  SELECT *, row_number() OVER (PARTITION BY {RUN}
    ORDER BY md5(concat_ws('|', 3 + run, run + 2, pmid)), pmid) AS n FROM here) WHERE n <= 50""",
    "margins": """
SELECT lang AS topic, doc_id AS pmid,
       round(abs(2 * (CAST('0x' || substr(md5(concat_ws('|', 'p', doc_id)), 1, 8) AS BIGINT)
         / 4294967296.0::DOUBLE) - 1), 6) AS margin
FROM documents""",
    "pick_uncertainty": _margin_picks("uncertainty", "true"),
    "pick_certainty": _margin_picks("certainty", "false"),
    "pick_alternating": _margin_picks("alternating", "round % 2 = 1"),
    "pick_adaptive": _margin_picks(
        "adaptive_certainty_uncertainty", "coalesce(recall >= 0.1, false)"
    ),
    "pick_random": _with(JUDGED, _pool(("random",))) + f"""
SELECT {RUN}, round, CAST(n AS INTEGER) AS rank_in_round, pmid FROM (
  SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY draw, pmid) AS n FROM here)
WHERE n <= 25""",
    "reveal": _with(JUDGED, _pool(("random",))) + f"""
, grown AS (
  SELECT {RUN}, round, rank_in_round, pmid, label FROM log
  UNION ALL
  SELECT {RUN}, round, CAST(n AS INTEGER), pmid, label FROM (
    SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY draw, pmid) AS n FROM here)
  WHERE n <= 25)
SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY round, rank_in_round) AS pos FROM grown""",
    "min_distances": _distances("diversity") + f"""
SELECT {RUN}, round, pmid, round(min_dist, 6) AS min_dist FROM measured""",
    "pick_diversity": _distances("diversity") + f"""
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY min_dist DESC, draw, pmid) AS n
  FROM measured)
SELECT {RUN}, round, CAST(row_number() OVER (PARTITION BY {RUN} ORDER BY min_dist, draw, pmid)
       AS INTEGER) AS rank_in_round, pmid
FROM ranked WHERE n <= 25""",
    "pick_min_variance": _with(ITEMS, _pool(("minimum_variance",)))
    + "".join(_min_variance_step(i) for i in (1, 2, 3)) + """
SELECT * FROM pick1 UNION ALL SELECT * FROM pick2 UNION ALL SELECT * FROM pick3""",
    "pick_min_variance_batch": _with(ITEMS, _pool(("minimum_variance",))) + f""",
batch AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY draw, pmid) AS n FROM here)
  WHERE n <= 50)"""
    + "".join(_min_variance_step(i, "batch") for i in (1, 2, 3)) + """
SELECT * FROM pick1 UNION ALL SELECT * FROM pick2 UNION ALL SELECT * FROM pick3""",
    "pick_clustering": _with(ITEMS, _pool(("clustering",)), recursive=True) + _clusters(25) + f"""
SELECT {RUN}, round, CAST(row_number() OVER (PARTITION BY {RUN} ORDER BY cluster) AS INTEGER)
       AS rank_in_round, pmid
FROM (SELECT * FROM grouped
      QUALIFY row_number() OVER (PARTITION BY {RUN}, cluster ORDER BY draw, pmid) = 1)""",
    "scores": _with(ITEMS, _pool(("certainty",)), recursive=True) + _FIT + f"""
SELECT {RUN}, round, pmid, round(1 / (1 + exp(-list_dot_product(v, w))), 4) AS p
FROM here JOIN fitted USING ({RUN}) JOIN vectors USING (pmid)""",
    # The two directions of a plane's largest variance in closed form.
    "projection_plane": """
WITH points AS (
  SELECT 'class ' || label AS topic, vec_id AS pmid, CAST(embedding[1] AS DOUBLE) AS a,
         CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
turned AS (
  SELECT topic, atan2(2 * covar_samp(a, b), var_samp(a) - var_samp(b)) / 2 AS t
  FROM points GROUP BY topic),
axes AS (
  SELECT topic, cos(t) AS c, sin(t) AS s,
         CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sign(cos(t)) ELSE sign(sin(t)) END AS first,
         CASE WHEN abs(sin(t)) >= abs(cos(t)) THEN sign(-sin(t)) ELSE sign(cos(t)) END AS second
  FROM turned)
SELECT topic, pmid, round(first * (a * c + b * s), 4) AS x, round(second * (b * c - a * s), 4) AS y
FROM points JOIN axes USING (topic)""",
    "acquire_round": _with(ITEMS, _FIRST_ROUND, recursive=True) + _FIT
    + _clusters(10, "(SELECT * FROM here WHERE policy = 'clustering')")
    + ", mv AS (SELECT * FROM here WHERE policy = 'minimum_variance')"
    + "".join(_min_variance_step(i, "mv") for i in range(1, 11)) + f""",
scored AS (
  SELECT h.*, abs(2 / (1 + exp(-list_dot_product(v, w))) - 1) AS margin,
         policy IN ('uncertainty', 'alternating') AS largest
  FROM here h JOIN fitted USING ({RUN}) JOIN vectors USING (pmid)
  WHERE policy IN ('uncertainty', 'certainty', 'alternating', 'adaptive_certainty_uncertainty')),
far AS (
  SELECT h.*, (SELECT min(list_distance(a.v, b.v)) FROM seeds JOIN vectors b USING (pmid)) AS gap
  FROM here h JOIN vectors a USING (pmid) WHERE policy = 'diversity'),
picks AS (
  SELECT policy, pmid, row_number() OVER (PARTITION BY policy ORDER BY margin, draw, pmid) AS place
  FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY policy
          ORDER BY CASE WHEN largest THEN -margin ELSE margin END, draw, pmid) <= 10)
  UNION ALL
  SELECT policy, pmid, row_number() OVER (ORDER BY draw, pmid) FROM here WHERE policy = 'random'
  QUALIFY row_number() OVER (ORDER BY draw, pmid) <= 10
  UNION ALL
  SELECT policy, pmid, row_number() OVER (ORDER BY gap, draw, pmid)
  FROM (SELECT * FROM far QUALIFY row_number() OVER (ORDER BY gap DESC, draw, pmid) <= 10)
  UNION ALL
  SELECT policy, pmid, row_number() OVER (ORDER BY cluster)
  FROM (SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY draw, pmid) = 1)
  UNION ALL
  SELECT policy, pmid, rank_in_round
  FROM ({" UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(1, 11))}))
SELECT j.topic, policy, CAST(0 AS INTEGER) AS run, CAST(1 AS INTEGER) AS round,
       CAST(place AS INTEGER) AS rank_in_round, pmid, j.label
FROM picks JOIN judged j USING (pmid)""",
    "diversity_rounds": _with(ITEMS) + """,
vectors AS MATERIALIZED (SELECT vec_id AS pmid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
classed AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY draw, pmid) AS n
  FROM (SELECT *, md5(concat_ws('|', 0, pmid)) AS draw FROM judged)),
start AS MATERIALIZED (
  SELECT pmid FROM classed
  QUALIFY row_number() OVER (ORDER BY CASE WHEN n = 1 THEN label ELSE 2 END, draw, pmid) <= 10)"""
    + "".join(_farthest_step(i) for i in (1, 2, 3)) + """
SELECT f.*, label FROM (
  SELECT * FROM far1 UNION ALL SELECT * FROM far2 UNION ALL SELECT * FROM far3) f
JOIN judged USING (topic, pmid)""",
    "frame_points": _with(ITEMS, _log(("random", "certainty"), SO_FAR)) + f"""

SELECT l.topic, l.policy, l.run, e.vec_id AS pmid,
       round(CAST(e.embedding[1] AS DOUBLE), 4) AS x, round(CAST(e.embedding[2] AS DOUBLE), 4) AS y,
       l.label, l.round AS from_round
FROM log l JOIN embeddings e ON e.vec_id = l.pmid""",
    "frame_sizes": _with(JUDGED, _log(STUDY_POLICIES)) + f"""
SELECT {RUN}, round, CAST(sum(n) OVER (PARTITION BY {RUN} ORDER BY round) AS BIGINT) AS labelled
FROM (SELECT {RUN}, round, count(*) AS n FROM log GROUP BY {RUN}, round)""",
    "recall_curve": _with(JUDGED, _curve()) + f"""
SELECT {RUN}, round, labelled, found, round(effort_pct, 4) AS effort_pct,
       round(recall_pct, 4) AS recall_pct
FROM curve""",
    "recall_curve_final": _with(JUDGED, _log(STUDY_POLICIES)) + f"""
, totals AS (
  SELECT topic, count(*) AS n_all, count(*) FILTER (WHERE label = 1) AS n_included
  FROM judged GROUP BY topic),
ends AS (SELECT {RUN}, max(round) AS last FROM log GROUP BY {RUN}),
points AS (SELECT {RUN}, CAST(unnest(range(1, last + 2)) AS INTEGER) AS round FROM ends),
states AS (
  SELECT {RUN}, p.round, count(*) AS labelled, count(*) FILTER (WHERE l.label = 1) AS found
  FROM points p JOIN log l USING ({RUN}) WHERE l.round < p.round GROUP BY {RUN}, p.round)
SELECT {RUN}, round, labelled, found, round(100.0::DOUBLE * labelled / n_all, 4) AS effort_pct,
       round(100.0::DOUBLE * found / nullif(n_included, 0), 4) AS recall_pct
FROM states JOIN totals USING (topic)""",
    "coverage_curve": _with(ITEMS, _curve(), _coverage("index")) + f"""
SELECT {RUN}, round, round(coverage_pct, 4) AS coverage_pct FROM coverage""",
    "coverage_curve_rounds": _with(ITEMS, _curve(), _coverage("round")) + f"""
SELECT {RUN}, round, round(coverage_pct, 4) AS coverage_pct FROM coverage""",
    "curve_auc": _with(JUDGED, _curve(), _area("curve", "recall_pct", "areas")) + f"""
SELECT {RUN}, round(auc, 4) AS auc FROM areas""",
    "policy_summary": _with(
        ITEMS, _curve(), _coverage("index"),
        f"both_curves AS (SELECT * FROM curve JOIN coverage USING ({RUN}, round))",
        _area("both_curves", "recall_pct", "recall_areas"),
        _area("both_curves", "coverage_pct", "coverage_areas"),
    ) + f""",
means AS (
  SELECT topic, policy, count(*) AS runs, avg(r.auc) AS auc_recall, avg(c.auc) AS auc_coverage
  FROM recall_areas r JOIN coverage_areas c USING ({RUN}) GROUP BY topic, policy)
SELECT topic, policy, runs, round(auc_recall, 4) AS auc_recall, round(auc_coverage, 4) AS auc_coverage,
       printf('%-20s | %13.2f | %25.2f', policy, auc_recall, auc_coverage) AS line
FROM means""",
    "curve_grid": _with(JUDGED, _curve(), GRID) + f"""
SELECT {RUN}, grid, round(grid_x, 4) AS grid_x, round(recall_pct, 4) AS recall_pct FROM on_grid""",
    "curve_grid_coverage": _with(
        ITEMS, _curve(), _coverage("index"), BOTH_CURVES, _grid("both_curves", "coverage_pct")
    ) + f"""
SELECT {RUN}, grid, round(grid_x, 4) AS grid_x, round(coverage_pct, 4) AS coverage_pct FROM on_grid""",
    "curve_band_coverage": _with(
        ITEMS, _curve(), _coverage("index"), BOTH_CURVES, _grid("both_curves", "coverage_pct")
    ) + _band("coverage_pct"),
    "compare_policies": "SELECT * FROM (" + _with(
        ITEMS, _curve(), _coverage("index"), BOTH_CURVES, _grid("both_curves", "coverage_pct")
    ) + _band("coverage_pct", "'coverage' AS measure, ") + ") UNION ALL SELECT * FROM (" + _with(
        ITEMS, _curve(), GRID
    ) + _band("recall_pct", "'recall' AS measure, ") + ")",
    "load_topics": _with(VOCABULARY, VERSIONS.removeprefix(ARTICLES).lstrip(",\n")) + r"""
, last AS (
  SELECT topic, pmid, arg_max(toxic, seq) AS label, arg_max(title, seq) AS title,
         arg_max(abstract, seq) AS abstract
  FROM versions GROUP BY topic, pmid),
read AS (
  SELECT topic, pmid, field, unnest(regexp_extract_all(lower(text), '([\p{L}\p{Nl}\p{No}_]+)', 1)) AS word
  FROM (SELECT topic, pmid, 'title' AS field, title AS text FROM last
        UNION ALL SELECT topic, pmid, 'abstract', abstract FROM last)),
means AS (
  SELECT topic, pmid, avg(CAST(vector[1] AS DOUBLE)) FILTER (WHERE field = 'title') AS a,
         avg(CAST(vector[1] AS DOUBLE)) FILTER (WHERE field = 'abstract') AS b
  FROM read JOIN vocabulary USING (word)
  WHERE length(word) BETWEEN 2 AND 15 AND NOT starts_with(word, '_') GROUP BY topic, pmid)
SELECT l.topic, CAST(l.pmid AS VARCHAR) AS pmid, l.label,
       row_number() OVER (PARTITION BY l.topic
         ORDER BY md5(concat_ws('|', 42, l.pmid)), CAST(l.pmid AS VARCHAR)) AS pos,
       coalesce(round(a, 4), 0) AS title_first, coalesce(round(b, 4), 0) AS abstract_first
FROM last l LEFT JOIN means m ON m.topic = l.topic AND m.pmid = l.pmid""",
    "curve_band": _with(JUDGED, _curve(), GRID) + f"""
, stats AS (
  SELECT topic, policy, grid, count(recall_pct) AS runs, avg(recall_pct) AS m,
         stddev_samp(recall_pct) / sqrt(count(recall_pct)) AS sem
  FROM on_grid GROUP BY topic, policy, grid)
SELECT topic, policy, grid, runs, round(m, 4) AS mean,
       round(m - t.v * sem, 4) AS low, round(m + t.v * sem, 4) AS high
FROM stats LEFT JOIN (VALUES {_T}) AS t(df, v) ON t.df = runs - 1""",
}
# Batch by batch or all at once, the last record counts.
ORACLES["enrich_batches"] = ORACLES["enrich"]
