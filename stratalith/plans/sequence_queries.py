"""Queries over ordered events and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sequence as S
from .registry import query, table

_BY, _ORDER = ["user_id"], ["ts", "event_id"]


def _events(spark, d):
    return table(spark, d, "events")


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
WHERE event_type IS NULL OR event_type = '' OR b IS NULL OR event_type <> b
""")
def consecutive_dedup(spark, d):
    return S.consecutive_distinct(_events(spark, d), _BY, _ORDER, "event_type").select("event_id", "user_id", "event_type")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def near_dup_first_seen(spark, d):
    return S.first_seen(table(spark, d, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query("""
WITH r AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS raw FROM events),
k AS (SELECT user_id, raw, row_number() OVER (PARTITION BY user_id ORDER BY raw) - 1 AS chunk FROM r GROUP BY 1, 2 HAVING count(*) >= 10),
c AS (SELECT r.user_id, k.chunk, list(event_id ORDER BY event_id) AS l FROM r JOIN k ON r.user_id = k.user_id AND r.raw = k.raw GROUP BY 1, 2)
SELECT user_id, chunk, l[1] AS first, l[-1] AS last, l[len(l) // 2 + 1] AS middle, len(l) AS n FROM c
""")
def tumbling_chunks(spark, d):
    chunked = S.chunks(_events(spark, d), _BY, _ORDER, 20, least=10)
    return S.chunk_rows(chunked, _BY, "event_id").withColumn("chunk", F.col("chunk").cast("long"))


def _gram_sql(n):
    lead = ", ".join(f"lead(t, {i}) OVER w AS t{i}" for i in range(1, n))
    names = ["t", *[f"t{i}" for i in range(1, n)]]
    return f"""
WITH m AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN event_type END AS t FROM events),
g AS (SELECT user_id, t, {lead} FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, concat_ws('_', {', '.join(names)}) AS gram, count(*) AS cnt FROM g WHERE {' AND '.join(f'{x} IS NOT NULL' for x in names)} GROUP BY 1, 2
"""


def _grams(spark, d, n):
    known = _events(spark, d).select("event_type").distinct().where("event_type <> 'error'")
    return S.ngrams(S.masked(_events(spark, d), known, "event_type"), _BY, _ORDER, "event_type", n)


@query(_gram_sql(2))
def bigrams(spark, d):
    return _grams(spark, d, 2)


@query(_gram_sql(3))
def trigrams(spark, d):
    return _grams(spark, d, 3)


@query("""
WITH s AS (SELECT user_id, ts::DATE AS day, ts, event_id, event_type AS t FROM events),
p AS (SELECT user_id, day, coalesce(lag(t) OVER w, 'BOL') AS src, t AS dst FROM s WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)
  UNION ALL SELECT user_id, day, arg_max(t, (ts, event_id)), 'EOL' FROM s GROUP BY 1, 2)
SELECT src, dst, count(*) AS cnt FROM p GROUP BY 1, 2
""")
def transitions_bol_eol(spark, d):
    e = _events(spark, d).withColumn("day", F.to_date("ts"))
    return S.transitions(e, ["user_id", "day"], _ORDER, "event_type").groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))


@query("""
WITH f AS (SELECT user_id, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, count(*) AS n FROM f WHERE f GROUP BY 1, 2)
SELECT user_id, count(*) AS n_runs, round(avg(n + 1), 6) AS mean_length, round(avg((n + 1 >= 3)::INT), 6) AS long_share FROM r GROUP BY 1
""")
def run_lengths(spark, d):
    out = S.run_summary(S.runs(_events(spark, d), _BY, _ORDER, F.col("event_type") == "error"), _BY)
    return out.select("user_id", "n_runs", F.round("mean_length", 6).alias("mean_length"), F.round("long_share", 6).alias("long_share"))


@query("""
SELECT e.event_id, coalesce(s.event_id::VARCHAR, '(start)') AS section FROM events e
ASOF LEFT JOIN (SELECT user_id, event_id FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.event_id >= s.event_id
""")
def asof_section(spark, d):
    e = _events(spark, d).select("event_id", "user_id")
    marks = _events(spark, d).where("event_type = 'signup'").select("user_id", F.col("event_id").alias("start"), F.col("event_id").cast("string").alias("section"))
    return S.as_of(e, marks, ["user_id"], "event_id", "start", "section", "(start)").select("event_id", "section")


@query("""
WITH t AS (SELECT event_id, ['a', 'b', event_type] AS x, string_split(event_type, 'r') AS y FROM events)
SELECT event_id, i - 1 AS pos, x[i] AS a, y[i] AS b FROM (SELECT *, unnest(range(1, least(len(x), len(y)) + 1)) AS i FROM t)
""")
def zip_positional(spark, d):
    t = _events(spark, d).select("event_id", F.array(F.lit("a"), F.lit("b"), F.col("event_type")).alias("x"), F.split("event_type", "r").alias("y"))
    zipped = F.slice(F.arrays_zip("x", "y"), F.lit(1), F.least(F.size("x"), F.size("y")))
    return t.select("event_id", F.posexplode(zipped).alias("pos", "z")).select("event_id", F.col("pos").cast("long").alias("pos"), F.col("z.x").alias("a"), F.col("z.y").alias("b"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events")
def json_extract(spark, d):
    return _events(spark, d).select("event_id", F.coalesce(F.from_json("props", "k long").k, F.lit(0)).alias("k"))


_TAG = "CASE event_type WHEN 'click' THEN 'Case=Genitive, Number=Sing' WHEN 'view' THEN 'Compound' WHEN 'purchase' THEN 'VerbForm=Part, Tense=Past' WHEN 'error' THEN '_' ELSE 'Person=3, Tense=Present, Mood=Optative, Formation=aor' END"


@query(f"""
WITH t AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'tad' ELSE 'gam' END AS lemma, {_TAG} AS tag FROM events)
SELECT event_id, CASE WHEN contains(tag, 'Compound') THEN 'CPD' WHEN contains(tag, 'Person=') THEN 'VFIN' WHEN contains(tag, 'VerbForm=Part') THEN 'PART'
  WHEN contains(tag, 'Case=') THEN CASE WHEN lemma = 'tad' THEN 'PRON' ELSE 'NOUN' END WHEN trim(tag) IN ('', '_') THEN 'INDC' ELSE 'X' END AS pos,
  contains(tag, 'VerbForm=Part') AND contains(tag, 'Tense=Past') AS ppp,
  CASE WHEN contains(tag, 'Case=') THEN 'Case=Genitive' WHEN contains(tag, 'VerbForm') THEN 'VerbForm=Part|Tense=Past' WHEN contains(tag, 'Person') THEN 'Finite|Tense=Present|Mood=Optative|Formation=aor' ELSE '' END AS feats
FROM t
""")
def pos_cascade(spark, d):
    t = _events(spark, d).select("event_id", F.when(F.col("user_id") % 2 == 0, "tad").otherwise("gam").alias("lemma"), F.expr(_TAG).alias("tag"))
    pos = T.pos_class(F.col("lemma"), F.col("tag"))
    return t.select("event_id", pos.alias("pos"), T.tag_flags(F.col("tag"), pos).c_ppp.alias("ppp"), F.concat_ws("|", T.tag_features(F.col("tag"))).alias("feats"))
