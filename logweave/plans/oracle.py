"""DuckDB SQL oracles, one per query of :mod:`logweave.plans.catalog`.

Written independently of the Spark plans: time windows as a range join over
generated windows, line numbers with ``row_number()``, and so on.  The driver
tables are registered as views under their own names.
"""

from __future__ import annotations

from ..functions import logline as L
from ..functions import tokens as T

ORACLE: dict[str, str] = {}

# The syslog view rendered from events (same rule as logweave.sources.tables).

def mask_sql(text: str) -> str:
    """P2, P3 in DuckDB, with the patterns of :mod:`logweave.functions.logline`."""
    return (f"regexp_replace(regexp_replace({text}, '{L.HEX_PATTERN}', '{L.HEX_TOKEN}', 'g'), "
            f"'{L.DIGIT_PATTERN}', '{L.DIGIT_TOKEN}', 'g')")


LOG = f"""
log AS (
  SELECT event_id + 1 AS line_id,
         '<13>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-00:00 c0-0c' || CAST(user_id % 3 AS VARCHAR)
         || 's' || CAST(user_id AS VARCHAR) || ' ' || event_type || ' ' || CAST(event_id AS VARCHAR)
         || ' - -  ' || CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END
         || ' reading: addr=0x' || lower(to_hex(event_id)) || ' value=' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
         AS line
  FROM events
),
tok AS (
  SELECT line_id, line, string_split_regex(trim(line), '\\s+') AS toks FROM log
),
parsed AS (
  SELECT line_id,
         TRY_CAST(regexp_extract(toks[1], '^<([0-9]+)>', 1) AS INTEGER) AS pri,
         try_strptime(substr(toks[2], 1, 19), '%Y-%m-%dT%H:%M:%S') AS ts,
         toks[3] AS host, toks[4] AS program, toks[5] AS pid,
         regexp_extract(line, '^\\s*(?:\\S+\\s+){{7}}(.*)$', 1) AS message,
         line
  FROM tok
),
masked AS (
  SELECT line_id, pri, ts, CAST(epoch(ts) AS BIGINT) AS t, host, program, pid, message, line,
         {mask_sql('line')} AS template
  FROM parsed WHERE ts IS NOT NULL AND program IS NOT NULL
),
counts AS (
  SELECT template, count(*) AS cnt FROM masked GROUP BY template
),
dict AS (
  SELECT template, CAST(row_number() OVER (ORDER BY cnt, template) - 1 AS INTEGER) AS idx FROM counts
)
"""


def with_log(body: str) -> str:
    return "WITH " + LOG.strip() + "\n" + body


def sql(name: str, body: str) -> None:
    ORACLE[name] = with_log(body)


sql("parse_log", "SELECT line_id, pri, ts, t, host, program, pid, message, line FROM masked")
sql("mask_templates", "SELECT line_id, t, host, program, template FROM masked")
ORACLE["line_count"] = with_log("SELECT count(*) AS cnt FROM log")
sql("template_counts", "SELECT template, cnt FROM counts")
sql("template_counts_by_program",
    "SELECT program, template, count(*) AS cnt FROM masked GROUP BY program, template")
sql("template_counts_by_host", """
SELECT CASE WHEN grouping(host) = 1 THEN 'ALL' ELSE host END AS host, template, count(*) AS cnt
FROM masked GROUP BY GROUPING SETS ((host, template), (template))""")
sql("template_dictionary", "SELECT template, idx FROM dict")
sql("one_hot_dictionary", """
SELECT template, idx, CAST((SELECT count(*) FROM dict) AS INTEGER) AS size FROM dict""")
sql("oov_templates", """
SELECT c.template, c.cnt FROM counts c
WHERE c.template NOT IN (SELECT template FROM counts ORDER BY cnt DESC, template LIMIT 10)""")

# ---- milestone 2 ----------------------------------------------------------------------

WINDOWS = """,
bounds AS (SELECT min(t) AS S, max(t) AS E FROM masked),
nwin AS (SELECT S, E, greatest(CAST(trunc((E - S - 1800) / 600.0 + 1) AS BIGINT), 0) AS n FROM bounds),
wins AS (
  SELECT i AS win, S + i * 600 AS ws, S + i * 600 + 1800 AS we
  FROM (SELECT S, unnest(range(n)) AS i FROM nwin)
  UNION ALL SELECT n AS win, S + n * 600 AS ws, E AS we FROM nwin
),
tw AS (
  SELECT w.win, w.ws, w.we, m.template, count(*) AS cnt
  FROM masked m JOIN wins w ON m.t BETWEEN w.ws AND w.we
  GROUP BY w.win, w.ws, w.we, m.template
),
targets AS (SELECT DISTINCT t AS t0 FROM masked WHERE contains(template, ' error ')),
tgw AS (
  SELECT t0 - 1800 AS ws, t0 AS we, m.template, count(*) AS cnt
  FROM masked m JOIN targets ON m.t BETWEEN t0 - 1800 AND t0
  GROUP BY t0, m.template
),
freqs AS (
  SELECT tw.win, tw.ws, tw.we, d.idx, tw.template, tw.cnt,
         tw.cnt / sum(tw.cnt) OVER (PARTITION BY tw.win, tw.ws, tw.we) AS freq
  FROM tw JOIN dict d USING (template)
),
labels AS (
  SELECT k.win, k.ws, k.we, CASE WHEN tg.t0 IS NULL THEN 0.0 ELSE 1.0 END AS label
  FROM (SELECT DISTINCT win, ws, we FROM tw) k
  LEFT JOIN targets tg ON k.ws = tg.t0 - 1800 AND k.we = tg.t0
)
"""


def wsql(name: str, body: str) -> None:
    ORACLE[name] = "WITH " + LOG.strip() + WINDOWS + body


sql("line_numbers", "SELECT line_id, template, row_number() OVER (ORDER BY line_id) AS line_no FROM masked")
sql("time_sorted_log", "SELECT t, line_id, template, row_number() OVER (ORDER BY t, line_id) AS rank FROM masked")
sql("count_windows_fixed", """
SELECT CAST(ceil(line_id / 5) AS BIGINT) AS win, template, count(*) AS cnt FROM masked GROUP BY 1, 2""")
sql("count_windows_sliding", """
SELECT win, template, count(*) AS cnt FROM (
  SELECT line_id AS win, template FROM masked WHERE line_id < 5
  UNION ALL
  SELECT unnest(range(line_id - 4, line_id)) AS win, template FROM masked WHERE line_id >= 5
) GROUP BY win, template""")
wsql("time_windows", "SELECT win, ws, we, template, cnt FROM tw")
sql("calendar_windows", """
SELECT date_trunc('day', ts) AS wkey, CAST(hour(ts) // 3 + 1 AS INTEGER) AS code, template, count(*) AS cnt
FROM masked GROUP BY 1, 2, 3""")
sql("target_events", "SELECT line_id, t, template FROM masked WHERE contains(template, ' error ')")
wsql("target_windows", "SELECT ws, we, template, cnt FROM tgw")
wsql("window_frequencies", "SELECT win, ws, we, idx, template, cnt, freq FROM freqs")
wsql("window_mean_vector", """,
vecpos AS (SELECT CAST(vec_id AS INTEGER) AS idx, embedding, unnest(range(len(embedding))) AS p FROM embeddings),
vec AS (SELECT idx, CAST(p AS INTEGER) AS pos, CAST(embedding[p + 1] AS DOUBLE) AS v FROM vecpos)
SELECT tw.win, tw.ws, tw.we, vec.pos, round(sum(tw.cnt * vec.v) / sum(tw.cnt), 6) + 0.0 AS val
FROM tw JOIN dict USING (template) JOIN vec USING (idx)
GROUP BY tw.win, tw.ws, tw.we, vec.pos""")
wsql("labeled_windows", "SELECT win, ws, we, label FROM labels")
wsql("training_set", """
SELECT 'main' AS kind, f.ws, f.we, l.label, f.idx, f.freq
FROM freqs f JOIN labels l ON f.ws = l.ws AND f.we = l.we
UNION ALL
SELECT 'target' AS kind, g.ws, g.we, 1.0 AS label, d.idx,
       g.cnt / sum(g.cnt) OVER (PARTITION BY g.ws, g.we) AS freq
FROM tgw g JOIN dict d USING (template)""")

# ---- milestone 3 ----------------------------------------------------------------------

ORACLE["confusion_matrix"] = """
SELECT count_if(quality = 1 AND toxic = 1) AS tp, count_if(quality = 0 AND toxic = 0) AS tn,
       count_if(quality = 0 AND toxic = 1) AS fp, count_if(quality = 1 AND toxic = 0) AS fn,
       count(*) AS n, count_if(quality <> toxic) / count(*) AS error
FROM labels"""

ORACLE["similar_vectors"] = """
WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS qv FROM embeddings WHERE vec_id = 0),
e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id <> 0),
s AS (
  SELECT vec_id,
         list_reduce(list_prepend(0.0, list_transform(list_zip(v, qv), lambda p: p[1] * p[2])), lambda a, b: a + b) AS d,
         sqrt(list_reduce(list_prepend(0.0, list_transform(v, lambda x: x * x)), lambda a, b: a + b)) AS nv,
         sqrt(list_reduce(list_prepend(0.0, list_transform(qv, lambda x: x * x)), lambda a, b: a + b)) AS nq
  FROM e, q
)
SELECT vec_id, round(d / (nv * nq), 6) + 0.0 AS similarity FROM s
ORDER BY similarity DESC, vec_id LIMIT 5"""

# ---- milestone 4 ----------------------------------------------------------------------

LISTED = "program IN (SELECT event_type FROM events WHERE length(event_type) > 4)"
sql("split_by_program", f"SELECT program, line_id, line FROM masked WHERE {LISTED}")
sql("compact_counts", f"""
SELECT program, count(*) AS n_lines, true AS enough_files, true AS small_enough
FROM masked WHERE {LISTED} GROUP BY program""")
sql("read_text_log", f"""
SELECT line_id, program, line FROM (
  SELECT row_number() OVER (ORDER BY line_id) AS line_id, program, line FROM masked) WHERE {LISTED}""")
sql("stored_counts", "SELECT template, cnt FROM counts")
ORACLE["stored_metrics"] = ORACLE["confusion_matrix"]
sql("read_stored_dictionary", "SELECT template, idx FROM dict")
sql("quarantined", r""",
bad AS (
  SELECT line_id, CASE line_id % 7
           WHEN 0 THEN regexp_replace(line, '^(\S+ \S{16})\S*', '\1')
           WHEN 1 THEN regexp_replace(line, '^(\S+ \S{10})\S*', '\1')
           WHEN 2 THEN regexp_replace(line, '^(\S+ \S{4})\S*', '\1')
           WHEN 3 THEN regexp_extract(line, '^(\S+ \S+ \S+)', 1) ELSE line END AS line
  FROM log),
btok AS (SELECT line_id, string_split_regex(trim(line), '\s+') AS toks FROM bad)
SELECT line_id, CASE WHEN len(toks) < 4 THEN 'too few tokens' ELSE 'bad timestamp' END AS reason FROM btok
WHERE len(toks) < 4 OR length(toks[2]) < 19 OR try_strptime(substr(toks[2], 1, 19), '%Y-%m-%dT%H:%M:%S') IS NULL""")
sql("gather_templates", "SELECT program, template, count(*) AS cnt FROM masked GROUP BY program, template")
ORACLE["sentences_by_source"] = """
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, count(*) AS n_lines,
       count(DISTINCT """ + mask_sql("line") + """) AS n_words
FROM l GROUP BY source"""

# ---- milestone 5: LogSig ----------------------------------------------------------------


def _tokens_sql(text: str) -> str:
    """P6 + P7 (intent weekday rule) in DuckDB."""
    s = f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"
    s = f"regexp_replace({s}, '{T.SEPARATORS}', ' ', 'g')"
    s = f"regexp_replace({s}, '{T.SPACED_SIGN}', ' {T.SPACED_SIGN} ', 'g')"
    s = f"regexp_replace({s}, '{T.NUMBER_RUN}', '{T.NUMBER_TOKEN}', 'g')"
    return f"list_slice(string_split_regex({s}, '\\s+'), {T.HEADER_TOKENS + 1}, 2147483647)"


_DAYS = "(" + ", ".join(f"'{day}'" for day in T.WEEKDAYS) + ")"


def _weekday_sql(arr: str) -> str:
    return (f"CASE WHEN {arr}[1] = '*' AND {arr}[2] IN {_DAYS} THEN list_slice({arr}, 11, 2147483647) "
            f"WHEN {arr}[1] IN {_DAYS} THEN list_slice({arr}, 10, 2147483647) ELSE {arr} END")


LOGSIG = f"""
WITH raw_log AS (
  SELECT event_id + 1 AS line_id,
         '<13>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-00:00 c0-0c' || CAST(user_id % 3 AS VARCHAR)
         || 's' || CAST(user_id AS VARCHAR) || ' ' || event_type || ' ' || CAST(event_id AS VARCHAR)
         || ' - -  ' || CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END
         || ' reading: addr=0x' || lower(to_hex(event_id)) || ' value=' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
         AS line
  FROM events
),
t0 AS (SELECT line_id, {_tokens_sql('line')} AS toks FROM raw_log),
ls AS (SELECT line_id, CAST(line_id % 10 AS INTEGER) AS cluster, {_weekday_sql('toks')} AS tokens FROM t0),
pos AS (SELECT line_id, cluster, tokens, unnest(range(1, len(tokens))) AS i FROM ls),
pr AS (SELECT line_id, cluster, tokens[i] AS a, unnest(list_slice(tokens, i + 1, len(tokens))) AS b FROM pos),
lp AS (SELECT line_id, cluster, a, b, count(*) AS occ FROM pr WHERE NOT (a = '*' AND b = '*') GROUP BY ALL),
nt AS (SELECT cluster, a, b, count(*) AS n FROM lp GROUP BY ALL),
ln AS (SELECT cluster, count(*) AS len FROM ls GROUP BY cluster),
aa AS (
  SELECT lp.line_id, lp.cluster AS ci, nt.cluster AS cj, sum(CAST(lp.occ AS HUGEINT) * nt.n * nt.n) AS A
  FROM lp JOIN nt ON lp.a = nt.a AND lp.b = nt.b GROUP BY ALL
),
tg AS (
  SELECT line_id, cluster, CAST(j AS INTEGER) AS target
  FROM (SELECT line_id, cluster, unnest(range(10)) AS j FROM ls) WHERE j <> cluster
),
sc AS (
  SELECT tg.line_id, tg.cluster, tg.target,
         CAST(3 * coalesce(aj.A, 0) AS DOUBLE) / CAST(lj.len * lj.len AS DOUBLE)
         - CAST(3 * coalesce(ai.A, 0) AS DOUBLE) / CAST(li.len * li.len AS DOUBLE) AS score
  FROM tg
  LEFT JOIN aa aj ON aj.line_id = tg.line_id AND aj.cj = tg.target
  LEFT JOIN aa ai ON ai.line_id = tg.line_id AND ai.cj = tg.cluster
  JOIN ln lj ON lj.cluster = tg.target
  JOIN ln li ON li.cluster = tg.cluster
)
"""

ORACLE["logsig_tokens"] = LOGSIG + "SELECT line_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS token_text FROM ls"
ORACLE["term_pairs"] = LOGSIG + "SELECT line_id, a, b FROM pr"
ORACLE["cluster_init"] = LOGSIG + "SELECT line_id, cluster FROM ls"
ORACLE["pair_counts"] = LOGSIG + "SELECT cluster, a, b, n FROM nt"
ORACLE["cluster_potential"] = LOGSIG + """
SELECT ln.cluster, ln.len,
       CAST(coalesce(pp.num, 0) AS DOUBLE) / CAST(ln.len * ln.len AS DOUBLE) AS potential
FROM ln LEFT JOIN (
  SELECT lp.cluster, sum(CAST(lp.occ AS HUGEINT) * nt.n * nt.n * nt.n) AS num
  FROM lp JOIN nt USING (cluster, a, b) GROUP BY lp.cluster
) pp USING (cluster)"""
ORACLE["logsig_scores"] = LOGSIG + "SELECT line_id, cluster, target, round(score, 6) + 0.0 AS score FROM sc"
ORACLE["logsig_reassign"] = LOGSIG + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, target) AS r FROM sc)
SELECT line_id, cluster,
       CASE WHEN score > 0 THEN target ELSE cluster END AS new_cluster,
       round(CASE WHEN score > 0 THEN score ELSE 0.0 END, 6) + 0.0 AS gain
FROM rk WHERE r = 1"""

_SIG_TOKENS = _tokens_sql(mask_sql("line"))


def _signatures(rule: str) -> str:
    return f""",
st AS (
  SELECT line_id, program || ' ' || regexp_extract(message, '^(\\S+)', 1) AS cluster, {_SIG_TOKENS} AS toks
  FROM masked
),
sg AS (SELECT line_id, cluster, {_weekday_sql('toks')} AS tokens FROM st),
spos AS (SELECT line_id, cluster, tokens, unnest(range(1, len(tokens))) AS i FROM sg),
spr AS (SELECT line_id, cluster, tokens[i] AS a, unnest(list_slice(tokens, i + 1, len(tokens))) AS b FROM spos),
slp AS (SELECT DISTINCT line_id, cluster, a, b FROM spr WHERE NOT (a = '*' AND b = '*')),
snt AS (SELECT cluster, a, b, count(*) AS n FROM slp GROUP BY ALL),
sln AS (SELECT cluster, count(*) AS len FROM sg GROUP BY cluster),
bad AS (
  SELECT DISTINCT slp.line_id FROM slp JOIN snt USING (cluster, a, b) JOIN sln USING (cluster)
  WHERE 2 * snt.n < sln.len
),
kept AS (SELECT * FROM sg WHERE line_id NOT IN (SELECT line_id FROM bad) AND {rule}),
sig AS (
  SELECT cluster,
         CASE WHEN len(tokens) <= 1 THEN ''
              ELSE array_to_string(list_filter(list_slice(tokens, 1, len(tokens) - 1),
                                               lambda x, i: i = 1 OR x <> tokens[i - 1]), ' ') END AS signature
  FROM kept
)
SELECT cluster, signature, count(*) AS cnt FROM sig GROUP BY ALL"""


sql("logsig_signatures", _signatures("true"))
sql("logsig_signatures_literal", _signatures("len(list_filter(tokens, lambda x: x = '*')) < 2"))


# ---- flags, orders, count windows and label totals ----------------------------------------

sql("count_windows_sliding_full", """
SELECT unnest(range(greatest(1, line_id - 4), line_id + 1)) AS win, template, count(*) AS cnt FROM masked GROUP BY 1, 2""")
wsql("target_windows_open", """
SELECT t0 - 1800 AS ws, t0 AS we, m.template, count(*) AS cnt
FROM masked m JOIN targets ON m.t >= t0 - 1800 AND m.t < t0 GROUP BY t0, m.template""")
wsql("labeled_windows_horizon", """
SELECT k.win, k.ws, k.we, CASE WHEN EXISTS (SELECT 1 FROM targets g WHERE g.t0 > k.we AND g.t0 <= k.we + 600) THEN 1.0 ELSE 0.0 END AS label
FROM (SELECT DISTINCT win, ws, we FROM tw) k""")
sql("template_counts_ranked", "SELECT row_number() OVER (ORDER BY cnt DESC, template) AS rank, template, cnt FROM counts")
sql("windows_in_order", """
SELECT row_number() OVER (ORDER BY win, template) AS place, win, template, cnt FROM (
  SELECT CAST(ceil(line_id / 5) AS BIGINT) AS win, template, count(*) AS cnt FROM masked GROUP BY 1, 2)""")
sql("calendar_window_frequencies", """
SELECT wkey, code, template, cnt, cnt / sum(cnt) OVER (PARTITION BY wkey, code) AS freq FROM (
  SELECT date_trunc('day', ts) AS wkey, CAST(hour(ts) // 3 + 1 AS INTEGER) AS code, template, count(*) AS cnt
  FROM masked GROUP BY 1, 2, 3)""")
sql("missing_vectors", "SELECT idx, cnt FROM dict JOIN counts USING (template) WHERE idx NOT IN (SELECT vec_id FROM embeddings)")

COUNT_WINDOWS = """,
cw AS (
  SELECT 'fixed' AS kind, CAST(ceil(line_id / 5) AS BIGINT) AS win, template FROM masked
  UNION ALL SELECT 'sliding', line_id, template FROM masked WHERE line_id < 5
  UNION ALL SELECT 'sliding', unnest(range(line_id - 4, line_id)), template FROM masked WHERE line_id >= 5
),
hit AS (
  SELECT DISTINCT 'fixed' AS kind, CAST(ceil(line_id / 5) AS BIGINT) - 1 AS win FROM masked WHERE contains(template, ' error ')
  UNION SELECT 'sliding', line_id - 5 FROM masked WHERE contains(template, ' error ')
)
"""
sql("count_window_labels", COUNT_WINDOWS + """
SELECT k.kind, k.win, CASE WHEN hit.win IS NULL THEN 0.0 ELSE 1.0 END AS label
FROM (SELECT DISTINCT kind, win FROM cw) k LEFT JOIN hit ON hit.kind = k.kind AND hit.win = k.win""")
sql("count_window_vectors", COUNT_WINDOWS + """,
vecpos AS (SELECT CAST(vec_id AS INTEGER) AS idx, embedding, unnest(range(len(embedding))) AS p FROM embeddings),
vec AS (SELECT idx, CAST(p AS INTEGER) AS pos, CAST(embedding[p + 1] AS DOUBLE) AS v FROM vecpos),
cc AS (SELECT kind, win, template, count(*) AS cnt FROM cw GROUP BY ALL)
SELECT kind, win, pos, round(sum(cnt * v) / sum(cnt), 6) + 0.0 AS val
FROM cc JOIN dict USING (template) JOIN vec USING (idx) GROUP BY kind, win, pos""")

# ---- calendar labels, windows within a controller, coverage, files, neighbours -------------

VECTORS = """,
vecpos AS (SELECT CAST(vec_id AS INTEGER) AS idx, embedding, unnest(range(len(embedding))) AS p FROM embeddings),
vec AS (SELECT idx, CAST(p AS INTEGER) AS pos, CAST(embedding[p + 1] AS DOUBLE) AS v FROM vecpos)"""

CALENDAR = """,
cal AS (SELECT date_trunc('day', ts) AS wkey, CAST(hour(ts) // 3 + 1 AS INTEGER) AS code, ts, template FROM masked)"""
sql("calendar_window_labels", CALENDAR + """,
hits AS (
  -- three hours before a target, in the day and window of that time
  SELECT DISTINCT date_trunc('day', ts - INTERVAL 3 HOUR) AS wkey, CAST(hour(ts - INTERVAL 3 HOUR) // 3 + 1 AS INTEGER) AS code
  FROM cal WHERE contains(template, ' error ')
)
SELECT k.wkey, k.code, CASE WHEN h.code IS NULL THEN 0.0 ELSE 1.0 END AS label
FROM (SELECT DISTINCT wkey, code FROM cal) k LEFT JOIN hits h ON h.wkey = k.wkey AND h.code = k.code""")
sql("calendar_window_vectors", CALENDAR + VECTORS + """,
cc AS (SELECT wkey, code, template, count(*) AS cnt FROM cal GROUP BY ALL)
SELECT wkey, code, pos, round(sum(cnt * v) / sum(cnt), 6) + 0.0 AS val
FROM cc JOIN dict USING (template) JOIN vec USING (idx) GROUP BY wkey, code, pos""")

HOST_WINDOWS = """,
hl AS (SELECT host, row_number() OVER (PARTITION BY host ORDER BY line_id) AS x, template FROM masked),
cw AS (
  SELECT 'fixed' AS kind, host, CAST(ceil(x / 5) AS BIGINT) AS win, template FROM hl
  UNION ALL SELECT 'sliding', host, x, template FROM hl WHERE x < 5
  UNION ALL SELECT 'sliding', host, unnest(range(x - 4, x)), template FROM hl WHERE x >= 5
),
hit AS (
  SELECT DISTINCT 'fixed' AS kind, host, CAST(ceil(x / 5) AS BIGINT) - 1 AS win FROM hl WHERE contains(template, ' error ')
  UNION SELECT 'sliding', host, x - 5 FROM hl WHERE contains(template, ' error ')
)
"""
sql("host_window_labels", HOST_WINDOWS + """
SELECT k.kind, k.host, k.win, CASE WHEN hit.win IS NULL THEN 0.0 ELSE 1.0 END AS label
FROM (SELECT DISTINCT kind, host, win FROM cw) k LEFT JOIN hit ON hit.kind = k.kind AND hit.host = k.host AND hit.win = k.win""")
sql("host_window_vectors", HOST_WINDOWS + VECTORS + """,
cc AS (SELECT kind, host, win, template, count(*) AS cnt FROM cw GROUP BY ALL)
SELECT kind, host, win, pos, round(sum(cnt * v) / sum(cnt), 6) + 0.0 AS val
FROM cc JOIN dict USING (template) JOIN vec USING (idx) GROUP BY kind, host, win, pos""")
sql("held_out_coverage", """,
sides AS (SELECT CASE WHEN starts_with(host, 'c0-0c1s') THEN 'test' ELSE 'train' END AS side, template FROM masked),
known AS (SELECT DISTINCT template FROM sides WHERE side = 'train')
SELECT side, count(*) AS lines, count(k.template) AS known_lines, count(DISTINCT s.template) AS templates,
       count(DISTINCT k.template) AS known_templates, count(k.template) / count(*) AS line_share
FROM sides s LEFT JOIN known k ON k.template = s.template GROUP BY side""")
sql("file_sentences", """,
words AS (
  SELECT substr(host, 1, 6) AS grp, (line_id - 1) // 1500 AS stretch, line_id, template AS word FROM masked
  UNION ALL SELECT DISTINCT substr(host, 1, 6), (line_id - 1) // 1500, 9223372036854775807, '' FROM masked
),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp, stretch ORDER BY line_id) - 1 AS pos FROM words)
SELECT grp, stretch, pos // 400 AS piece, CAST(count(*) AS INTEGER) AS n_words, CAST(count(DISTINCT word) AS INTEGER) AS n_distinct,
       arg_min(word, pos) AS first_word, arg_max(word, pos) AS last_word
FROM placed GROUP BY grp, stretch, pos // 400""")
sql("file_embedding_sizes", """
SELECT DISTINCT template AS word, CAST(50 AS INTEGER) AS size FROM masked UNION ALL SELECT '', 50 FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM masked)""")
ORACLE["nearest_vectors"] = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (
  SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS similarity
  FROM e a JOIN e b ON a.vec_id <> b.vec_id
),
r AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS INTEGER) AS rank, neighbour, similarity FROM s)
SELECT vec_id, rank, neighbour, similarity FROM r WHERE rank <= 5"""

sql("word2vec_sentences", """
SELECT host, (r - 1) // 1000 AS piece, CAST(count(*) AS INTEGER) AS n
FROM (SELECT host, row_number() OVER (PARTITION BY host ORDER BY line_id) AS r FROM masked) GROUP BY ALL""")
sql("template_embedding_sizes", "SELECT DISTINCT template AS word, CAST(50 AS INTEGER) AS size FROM masked")


def _totals(name: str, source: str) -> str:
    return (f"SELECT '{name}' AS model, count(*) AS n, count_if(label = 1) AS positives, count_if(label = 0) AS negatives, "
            f"least(count_if(label = 1), count_if(label = 0)) / count(*) AS majority_error FROM {source}")


wsql("model_label_totals", """,
everything AS (SELECT label FROM labels UNION ALL SELECT 1.0 FROM targets),
gm AS (SELECT t, template FROM masked WHERE starts_with(host, 'c0-0c1s')),
gb AS (SELECT min(t) AS S, max(t) AS E FROM gm),
gn AS (SELECT S, E, greatest(CAST(trunc((E - S - 1800) / 600.0 + 1) AS BIGINT), 0) AS n FROM gb),
gw AS (
  SELECT S + i * 600 AS ws, S + i * 600 + 1800 AS we FROM (SELECT S, unnest(range(n)) AS i FROM gn)
  UNION ALL SELECT S + n * 600, E FROM gn
),
held AS (
  SELECT CASE WHEN EXISTS (SELECT 1 FROM gm WHERE contains(template, ' error ') AND t = gw.we AND t - 1800 = gw.ws) THEN 1.0 ELSE 0.0 END AS label
  FROM gw WHERE EXISTS (SELECT 1 FROM gm WHERE t BETWEEN gw.ws AND gw.we)
)
""" + _totals("svm", "everything") + " UNION ALL " + _totals("logreg", "everything") + " UNION ALL " + _totals("tree", "held"))


def _round(r: int) -> str:
    """One damped round of moves on ``state{r}(line_id, rep, cluster, tokens)``, taken back if the potential does not rise."""
    def potential(name, state):
        return f"""
n{name} AS MATERIALIZED (SELECT s.cluster, p.a, p.b, count(*) AS n, sum(p.occ) AS m FROM {state} s JOIN lp p USING (line_id) GROUP BY ALL),
l{name} AS MATERIALIZED (SELECT cluster, count(*) AS len FROM {state} GROUP BY cluster),
p{name} AS MATERIALIZED (
  SELECT sum(CAST(num AS DOUBLE) / CAST(len * len AS DOUBLE)) AS total
  FROM (SELECT cluster, sum(CAST(m AS HUGEINT) * n * n * n) AS num FROM n{name} GROUP BY cluster) JOIN l{name} USING (cluster))"""

    return f""",{potential(f'a{r}', f'state{r}')},
v{r} AS MATERIALIZED (
  SELECT p.line_id, n.cluster AS cj, sum(CAST(p.occ AS HUGEINT) * n.n * n.n) AS A FROM lp p JOIN na{r} n USING (a, b) GROUP BY ALL),
s{r} AS (
  SELECT x.line_id, x.cluster, x.rep, x.target,
         CASE WHEN lj.len IS NULL THEN 0.0 ELSE CAST(3 * coalesce(aj.A, 0) AS DOUBLE) / CAST(lj.len * lj.len AS DOUBLE) END
         - CAST(3 * coalesce(ai.A, 0) AS DOUBLE) / CAST(li.len * li.len AS DOUBLE) AS score
  FROM (SELECT line_id, rep, cluster, CAST(j AS INTEGER) AS target FROM (SELECT *, unnest(range(10)) AS j FROM state{r}) WHERE j <> cluster) x
  LEFT JOIN v{r} aj ON aj.line_id = x.line_id AND aj.cj = x.target
  LEFT JOIN v{r} ai ON ai.line_id = x.line_id AND ai.cj = x.cluster
  LEFT JOIN la{r} lj ON lj.cluster = x.target JOIN la{r} li ON li.cluster = x.cluster
),
m{r} AS MATERIALIZED (
  SELECT line_id, rep, CASE WHEN score > 0 AND (rep + {r}) % 2 = 0 THEN target ELSE cluster END AS cluster
  FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, target) AS k FROM s{r}) WHERE k = 1),{potential(f'b{r}', f'm{r}')},
state{r + 1} AS MATERIALIZED (
  SELECT o.line_id, o.rep, CASE WHEN (SELECT total FROM pb{r}) > (SELECT total FROM pa{r}) THEN m.cluster ELSE o.cluster END AS cluster
  FROM state{r} o JOIN m{r} m USING (line_id))"""


ORACLE["logsig_two_rounds"] = LOGSIG + """,
state0 AS MATERIALIZED (SELECT line_id, cluster, min(line_id) OVER (PARTITION BY cluster, tokens) AS rep FROM ls)""" + _round(0) + _round(1) + """
SELECT line_id, cluster FROM state2"""
ORACLE["stored_clusters"] = ORACLE["logsig_two_rounds"]
ORACLE["stored_signatures"] = ORACLE["logsig_signatures"]
