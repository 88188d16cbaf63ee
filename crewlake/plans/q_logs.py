"""Queries for names in text, retrieval and log analytics (T, L)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlake.operators import logs as L
from crewlake.operators import patterns as P
from crewlake.operators import resolve as T
from crewlake.operators import retrieve as RT
from crewlake.plans.registry import add
from crewlake.plans.stand_in import AS_OF, Tables

# --- vocabulary ------------------------------------------------------------------------------------------


def names(t: Tables) -> DataFrame:
    def of(table: str, column: str, kind: str, rank: int) -> DataFrame:
        return t.raw(table).select(F.lit(kind).alias("type"), F.col(column).alias("value"), F.lit(rank).alias("source_rank")).distinct()
    return (of("part", "p_name", "site", 0).unionByName(of("part", "p_brand", "project", 0)).unionByName(of("nation", "n_name", "supplier", 0))
            .unionByName(of("region", "r_name", "client", 0)).unionByName(of("customer", "c_mktsegment", "company", 0)))


VOCAB = """src AS (SELECT DISTINCT 'site' AS type, p_name AS value FROM part UNION SELECT 'project', p_brand FROM part UNION SELECT 'supplier', n_name FROM nation
  UNION SELECT 'client', r_name FROM region UNION SELECT 'company', c_mktsegment FROM customer),
named AS (SELECT type, value, regexp_replace(replace(lower(value),'&',' and '),'[^a-z0-9]','','g') AS norm FROM src),
people2 AS (SELECT 'person' AS type, 'Customer '||lpad(CAST(c_custkey AS VARCHAR),9,'0') AS value, lpad(CAST(c_custkey AS VARCHAR),9,'0') AS last FROM customer),
vocab AS (SELECT * FROM named UNION ALL SELECT type, value, 'customer'||last FROM people2 UNION ALL SELECT type, value, last FROM people2)"""
add("vocabulary", lambda t: T.vocabulary(names(t), t.person), f"""
WITH {VOCAB} SELECT type, norm, value FROM vocab""")

ALIASES = {"SR": "small ring", "T&H": "red widget", "nobody": "no such thing"}


def mentions(t: Tables) -> DataFrame:
    p = t.raw("part").select("p_name", "p_brand").distinct()
    kinds = F.array(F.upper("p_name"), F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)")), F.concat(F.lit("x"), F.reverse("p_name")),
                    F.expr("substring(p_name, 1, 7)"), F.lit("S.R."), F.lit("T & H"), F.lit("q"))
    return p.select(F.explode(kinds).alias("mention")).distinct()


MENTIONS = """m AS (SELECT DISTINCT unnest([upper(p_name), substr(p_name,1,2)||substr(p_name,4), 'x'||reverse(p_name), substr(p_name,1,7), 'S.R.', 'T & H', 'q']) AS mention FROM part),
mn AS (SELECT mention, regexp_replace(replace(lower(mention),'&',' and '),'[^a-z0-9]','','g') AS norm FROM m)"""
# longest common subsequence row by row: each letter of one word becomes a list of match flags against the other
LCS = """list_reduce([[CASE WHEN a[i] = b[j] THEN 1 ELSE 0 END for j in range(1, len(b)+1)] for i in range(1, len(a)+1)],
  lambda acc, x: list_reduce([[j] for j in range(1, len(b)+1)], lambda nw, k: list_append(nw,
    CASE WHEN x[k[1]] = 1 THEN acc[k[1]] + 1 ELSE greatest(acc[k[1]+1], nw[k[1]]) END), [0]), [0 for z in range(len(b)+1)])[len(b)+1]"""


def _scores(terms: str) -> str:
    return f"""pairs0 AS (SELECT DISTINCT t.norm, v.norm AS vnorm, string_split(t.norm,'') AS a, string_split(v.norm,'') AS b FROM {terms} t, (SELECT DISTINCT norm FROM vocab) v
  WHERE t.norm <> '' AND levenshtein(t.norm, v.norm) <= (length(t.norm) + length(v.norm)) * 0.45 + 1e-9),
pairs1 AS (SELECT norm, vnorm, 200.0 * {LCS} / (len(a) + len(b)) AS raw FROM pairs0),
scored AS (SELECT p.norm, v.type, v.value, v.norm AS vnorm, p.raw, round(p.raw,1) AS score FROM pairs1 p JOIN vocab v ON v.norm = p.vnorm)"""


def _vocab(t: Tables) -> DataFrame:
    return T.vocabulary(names(t), t.person)


add("near_names", lambda t: T.near_names(mentions(t).withColumn("norm", T.norm_name("mention")).filter("length(norm) >= 2"), _vocab(t), 70.0)
    .select("norm", "type", "value", "score"), f"""
WITH {VOCAB}, {MENTIONS}, ok AS (SELECT * FROM mn WHERE length(norm) >= 2), {_scores('ok')} SELECT norm, type, value, score FROM scored WHERE raw >= 70 - 1e-9""")
PRIORITY = "list_position(['site','client','supplier','project','company','person'], type)"
ORDER = "list_position(['site','project','client','supplier','company','person'], type)"
add("resolve_mentions", lambda t: T.resolve_mentions(mentions(t), _vocab(t), T.alias_table(t.spark, ALIASES)).select(
    "mention", "status", "type", "value", "score", F.nullif("candidates", F.lit("")).alias("candidates")), f"""
WITH {VOCAB}, {MENTIONS}, one AS (SELECT * FROM vocab WHERE TRUE QUALIFY row_number() OVER (PARTITION BY norm ORDER BY {ORDER}) = 1),
alias AS (SELECT * FROM (VALUES ('sr','smallring'),('tandh','redwidget'),('nobody','nosuchthing')) x(norm, goal)),
exact AS (SELECT mention, 'exact' AS status, type, value FROM mn JOIN one USING (norm) WHERE length(norm) >= 2),
ali AS (SELECT mn.mention, 'alias' AS status, one.type, one.value FROM mn JOIN alias USING (norm) JOIN one ON one.norm = goal WHERE mention NOT IN (SELECT mention FROM exact)),
open AS (SELECT * FROM mn WHERE length(norm) >= 2 AND mention NOT IN (SELECT mention FROM exact) AND mention NOT IN (SELECT mention FROM ali)), {_scores('open')},
c1 AS (SELECT * FROM scored WHERE raw >= 70 - 1e-9 QUALIFY row_number() OVER (PARTITION BY norm, vnorm ORDER BY score DESC, {PRIORITY}, value DESC) = 1),
c2 AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, {PRIORITY}, value) AS n FROM c1 QUALIFY n <= 4),
c3 AS (SELECT norm, max(score) AS top, count(*) AS k, count(*) FILTER (n > 1 AND score >= 90) AS runners, max(type) FILTER (n = 1) AS type, max(value) FILTER (n = 1) AS value,
  string_agg(value||' ('||type||')', ' / ' ORDER BY n) AS every, string_agg(value||' ('||type||')', ' / ' ORDER BY n) FILTER (n > 1) AS rest FROM c2 GROUP BY norm)
SELECT mention, status, type, value, 100.0 AS score, NULL AS candidates FROM exact UNION ALL SELECT mention, status, type, value, 100.0, NULL FROM ali
UNION ALL SELECT o.mention, CASE WHEN top IS NULL THEN 'none' WHEN top >= 90 AND runners = 0 THEN 'fuzzy' WHEN top >= 90 OR k > 1 THEN 'ambiguous' ELSE 'none' END,
  CASE WHEN top >= 90 AND runners = 0 THEN type END, CASE WHEN top >= 90 AND runners = 0 THEN value END, CASE WHEN top >= 90 AND runners = 0 THEN top END,
  CASE WHEN top >= 90 AND runners = 0 THEN rest ELSE every END FROM open o LEFT JOIN c3 USING (norm)
UNION ALL SELECT mention, 'none', NULL, NULL, NULL, NULL FROM mn WHERE length(norm) < 2""")
add("suggest", lambda t: T.suggest(mentions(t), _vocab(t), 3).select("mention", "n", "type", "value", "score"), f"""
WITH {VOCAB}, {MENTIONS}, {_scores('mn')}, s1 AS (SELECT * FROM scored WHERE raw >= 55 - 1e-9 QUALIFY row_number() OVER (PARTITION BY norm, value ORDER BY score DESC, {ORDER}) = 1),
s2 AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, {ORDER}, value) AS n FROM s1 QUALIFY n <= 3)
SELECT mention, CAST(n AS INTEGER) AS n, type, value, score FROM mn JOIN s2 USING (norm)""")


def questions(t: Tables) -> DataFrame:
    c = t.raw("customer")
    k = F.col("c_custkey")
    small = F.element_at(F.array(F.lit("small ring"), F.lit("red widgte"), F.lit("no such place"), F.lit("T&H"), F.lit("NATION_7 and hot bolt")), (k % 5 + 1).cast("int"))
    return c.select(k.alias("question_id"), F.when(k % 7 == 0, F.concat(F.lit("hours for site = "), small)).otherwise(
        F.concat(F.lit("show the roster for "), small, F.lit(" this week"))).alias("text"))


def _detected(t: Tables) -> DataFrame:
    return T.detect_mentions(questions(t), _vocab(t), T.alias_table(t.spark, ALIASES)).select("question_id", "type", "value", "score")


add("detect_mentions", _detected, """
SELECT c_custkey AS question_id, 'site' AS type,
  CASE WHEN e THEN CASE k WHEN 0 THEN 'small ring' WHEN 1 THEN 'red widgte' WHEN 2 THEN 'no such place' WHEN 3 THEN 'red widget' ELSE 'NATION_7 and hot bolt' END
       ELSE CASE k WHEN 0 THEN 'small ring' WHEN 3 THEN 'red widget' ELSE 'hot bolt' END END AS value,
  CAST(CASE WHEN e AND k IN (1, 2, 4) THEN 0.0 ELSE 100.0 END AS DOUBLE) AS score
FROM (SELECT c_custkey, c_custkey % 5 AS k, c_custkey % 7 = 0 AS e FROM customer) WHERE e OR k IN (0, 3, 4)""")


def _diagnosis(t: Tables) -> DataFrame:
    probes = [("employee_profile", t.person, "last_name", "a known worker"), ("site_assignment", t.assignments, "site_name", "assigned to the site"),
              ("project_bridge", t.bridge, "job_title", "a bridged job")]
    first = t.raw("part").agg(F.min("p_name").alias("p_name"))
    asked = first.select(F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)")).alias("mention"))
    return T.zero_row_diagnosis(t.roster, "roster_date", "2031-01-01", "2031-02-01", probes, "site 3", asked, _vocab(t))


add("zero_row_diagnosis", _diagnosis, f"""
WITH {VOCAB}, q AS (SELECT regexp_replace(lower(substr(n,1,2)||substr(n,4)),'[^a-z0-9]','','g') AS norm FROM (SELECT min(p_name) AS n FROM part)), {_scores('q')},
s1 AS (SELECT * FROM scored WHERE raw >= 55 - 1e-9 QUALIFY row_number() OVER (PARTITION BY norm, value ORDER BY score DESC, {ORDER}) = 1)
SELECT 'coverage' AS step, min(roster_date)||'..'||max(roster_date) AS subject, 'range is AFTER coverage' AS detail FROM roster
UNION ALL SELECT 'related', 'site_assignment', 'assigned to the site: '||count(*) FROM assignments WHERE site_name ILIKE '%site 3%'
UNION ALL SELECT 'candidate', value, type||' '||printf('%.1f', score) FROM (SELECT * FROM s1 ORDER BY score DESC, {ORDER}, value LIMIT 3)""")


def utterances(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    n = F.length("text")
    more = (F.when(n < 60, "").when(n < 100, "BMA Site requires: wah, VOC and gas test.").when(n < 150, "Who is on site?").when(n < 200, "Delta Crew keeps causing issues")
            .when(n < 250, "Green day means a day without any alerts").when(n < 300, "remind me every Monday").when(n < 350, "Always wear boots").otherwise(""))
    return c.select("conv_id", "turn", F.concat("text", F.lit(" . "), more).alias("text"))


def _kinds(t: Tables) -> DataFrame:
    k = T.classify_utterance("text")
    return utterances(t).select(k["kind"].alias("kind"), k["site"].alias("site"), F.array_join(k["tickets"], "|").alias("tickets")).groupBy("kind", "site", "tickets").agg(
        F.count("*").alias("utterances"))


add("classify_utterance", _kinds, """
SELECT kind, CASE WHEN kind = 'site_rule' THEN 'bma_site' END AS site, CASE WHEN kind = 'site_rule' THEN 'wah|voc|gas test' END AS tickets, count(*) AS utterances FROM (
SELECT CASE WHEN n >= 60 AND n < 100 THEN 'site_rule' WHEN n >= 100 AND n < 150 THEN 'question'
  WHEN regexp_matches(text,'(?i)[?？]|^(who|what|which|how|when|where|is |are |do |does |can |show|list|give)') THEN 'question'
  WHEN n >= 150 AND n < 200 THEN 'supplier_flag' WHEN n >= 200 AND n < 250 THEN 'definition' WHEN n >= 250 AND n < 300 THEN 'preference' WHEN n >= 300 AND n < 350 THEN 'fact'
  WHEN regexp_matches(text,'(?i)policy|rule|remember|always|never') THEN 'fact' ELSE 'none' END AS kind FROM (SELECT *, length(text) AS n FROM conversations)) GROUP BY 1""")
add("recall_rules", lambda t: T.recall_rules(questions(t).withColumn("text", F.concat("text", F.lit(" risk at bma site"))), ["bma_site", "t&h", "delta"], ["hot bolt"], ["Delta Crew"]), """
SELECT c_custkey AS question_id, 'site_rule' AS kind, 'bma_site' AS subject FROM customer UNION ALL SELECT c_custkey, 'site_rule', 't&h' FROM customer WHERE c_custkey % 5 = 3
UNION ALL SELECT c_custkey, 'definition', 'hot bolt' FROM customer WHERE c_custkey % 5 = 4 UNION ALL SELECT c_custkey, 'supplier_flag', 'Delta Crew' FROM customer""")


# --- over the given texts: names, rules and follow-ups as they stand there -------------------------------------

TERMS = r"""w0 AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations),
wc AS (SELECT w, count(*) AS n FROM w0 WHERE length(w) >= 6 GROUP BY w)"""


def _words(t: Tables, least: int) -> DataFrame:
    words = t.raw("conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)).alias("w"))
    return words.filter(F.length("w") >= least).groupBy("w").agg(F.count("*").alias("n"))


def _named(t: Tables) -> DataFrame:
    """Every long word and every opening pair of words of the conversations, looked up in all documents."""
    opening = t.raw("conversations").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0).alias("w")).filter(F.size("w") >= 2)
    vocab = _words(t, 9).select(F.lit("site").alias("type"), F.col("w").alias("value")).unionByName(
        opening.select(F.lit("client").alias("type"), F.concat_ws(" & ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("value")).distinct())
    return P.named_in(t.raw("documents").select("doc_id", "text"), vocab)


add("named_in_documents", _named, r"""
WITH w0 AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations),
names AS (SELECT DISTINCT 'site' AS type, x AS value, ' '||x||' ' AS pattern FROM (SELECT unnest(w) AS x FROM w0) WHERE length(x) >= 9
  UNION SELECT DISTINCT 'client', w[1]||' & '||w[2], ' '||w[1]||' '||w[2]||' ' FROM w0 WHERE len(w) >= 2),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
grams AS (SELECT doc_id, ' '||x||' ' AS pattern FROM (SELECT doc_id, unnest(w) AS x FROM d)
  UNION ALL SELECT doc_id, ' '||w[i]||' '||w[i+1]||' ' FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d))
SELECT doc_id, type, value, count(*) AS hits FROM grams JOIN names USING (pattern) GROUP BY ALL""")


def _recalled(t: Tables) -> DataFrame:
    """The thirty most frequent long words as subjects of rules: ten of each kind."""
    top = [r.w for r in _words(t, 6).orderBy(F.desc("n"), "w").limit(30).collect()]
    asked = t.raw("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), "text")
    return T.recall_rules(asked, top[:10], top[10:20], top[20:])


add("recall_rules_in_conversations", _recalled, f"""
WITH {TERMS}, top AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM wc QUALIFY r <= 30),
rules AS (SELECT w AS subject, CASE WHEN r <= 10 THEN 'site_rule' WHEN r <= 20 THEN 'definition' ELSE 'supplier_flag' END AS kind FROM top)
SELECT DISTINCT conv_id||':'||turn AS question_id, kind, subject FROM conversations, rules
WHERE contains(lower(text), subject) OR (kind = 'supplier_flag' AND regexp_matches(lower(text), 'supplier|供应商|risk|风险'))""")


def _told(t: Tables) -> DataFrame:
    """Conversations with their own texts; long turns of users stand for tool calls."""
    c = t.raw("conversations")
    call = (F.col("role") == "user") & (F.length("text") > 120)
    args = F.create_map(F.lit("worker_name"), F.lit("Jane"), F.lit("site"), F.lit("A"))
    turns = c.select(F.col("conv_id").alias("conversation_id"), "turn", "text", F.when(call, "timesheet").alias("tool"),
                     F.when(call, "get_weekly_timesheet").alias("function"), F.when(call, args).alias("args"))
    out = T.followups(turns, AS_OF, F.floor(F.col("turn") / 2))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("args")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.withColumn("args", text)


add("followups_in_conversations", _told, """
WITH told AS (SELECT *, role = 'user' AND length(text) > 120 AS call FROM conversations),
heard AS (SELECT *, max(CASE WHEN call THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z]{2,}') AND w NOT IN
    ('What','About','And','The','How','Who','Show','Same','Last','This','Next','Week','Month','Today','Tomorrow'))[1] AS who FROM told)
SELECT conv_id AS conversation_id, turn, 'timesheet' AS tool, 'get_weekly_timesheet' AS function, 'site=A;worker_name='||who AS args,
  FALSE AS time_changed, TRUE AS person_changed, FALSE AS entity_changed FROM heard
WHERE before IS NOT NULL AND who IS NOT NULL AND (length(trim(text)) <= 12
  OR regexp_matches(text, '(?i)那|呢|换成|改成|那么|还有|这个|那个|他|她|这周|上周|下周|这个月|上个月|what about|how about|and (for|in|at)\\b|same (for|but)|instead'))""")


def _turns(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    n = F.length("text")
    call = (F.col("role") == "user") & (n > 120)
    args = F.create_map(F.lit("worker_name"), F.lit("Jane"), F.lit("date_from"), F.lit("2000-01-01"), F.lit("site"), F.lit("A"))
    asked = F.when(n > 200, "what about last month").when(n > 150, "how about site = small ring").when(n > 100, "show me what Carter did").otherwise("and for Carter")
    said = F.when(F.col("role") == "user", asked).when(F.col("turn") > 2, "yesterday").otherwise("fine")
    return c.select(F.col("conv_id").alias("conversation_id"), "turn", said.alias("text"), F.when(call, "timesheet").alias("tool"),
                    F.when(call, "get_weekly_timesheet").alias("function"), F.when(call, args).alias("args"))


def _followups(t: Tables) -> DataFrame:
    turns = _turns(t)
    known = T.vocabulary(names(t).filter("type = 'site'"))
    told = T.detect_mentions(turns.filter("text LIKE '%site =%'").select(F.struct("conversation_id", "turn").alias("question_id"), "text"), known, T.alias_table(t.spark, ALIASES))
    out = T.followups(turns, AS_OF, F.floor(F.col("turn") / 2), told.select("question_id.*", "type", "value"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("args")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.withColumn("args", text)


add("followups", _followups, """
SELECT conv_id AS conversation_id, turn, 'timesheet' AS tool, 'get_weekly_timesheet' AS function,
  CASE said WHEN 'month' THEN 'date_from=2000-05-01;date_to=2000-05-31;site=A;worker_name=Jane' WHEN 'person' THEN 'date_from=2000-01-01;site=A;worker_name=Carter'
    WHEN 'site' THEN 'date_from=2000-01-01;site=small ring;worker_name=Jane'
    ELSE 'date_from=2000-05-31;date_to=2000-05-31;site=A;worker_name=Jane' END AS args, said IN ('month','day') AS time_changed, said = 'person' AS person_changed, said = 'site' AS entity_changed
FROM (SELECT c.*, CASE WHEN role = 'user' THEN CASE WHEN length(text) > 200 THEN 'month' WHEN length(text) > 150 THEN 'site' WHEN length(text) > 100 THEN NULL ELSE 'person' END WHEN turn > 2 THEN 'day' END AS said FROM conversations c)
WHERE said IS NOT NULL AND EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = conversations.conv_id AND p.turn < turn AND p.role = 'user' AND length(p.text) > 120)
""".replace("p.conv_id = conversations.conv_id AND p.turn < turn", "p.conv_id = x.conv_id AND p.turn < x.turn").replace("FROM conversations c)\nWHERE", "FROM conversations c) x\nWHERE"))

# --- retrieval ------------------------------------------------------------------------------------------------------


def _docs(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.regexp_replace("text", "\n", "\n## ").alias("text"))


add("chunks", lambda t: RT.chunks(_docs(t)), r"""
WITH RECURSIVE parts AS (SELECT doc_id, 'doc '||doc_id AS stem, string_split(text, chr(10)) AS p FROM documents),
secs AS (SELECT doc_id, stem, i, len(p) AS n, CASE WHEN i > 1 THEN '## ' ELSE '' END||p[i]||CASE WHEN i < len(p) THEN chr(10) ELSE '' END AS seg,
  CASE WHEN i = 1 THEN stem ELSE regexp_replace(p[i],'^\s+|\s+$','','g') END AS t FROM (SELECT *, unnest(range(1, len(p)+1)) AS i FROM parts)),
fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS buf, '' AS title, CAST([] AS STRUCT(title VARCHAR, text VARCHAR)[]) AS out FROM parts
UNION ALL SELECT doc_id, i, substr(nbuf, CAST(cuts*3600+1 AS BIGINT)), ntitle,
  CASE WHEN NOT fits AND regexp_replace(buf,'^\s+|\s+$','','g') <> '' THEN [{'title': coalesce(nullif(title,''),stem), 'text': regexp_replace(buf,'^\s+|\s+$','','g')}] ELSE [] END
  || [{'title': coalesce(nullif(ntitle,''),stem), 'text': substr(nbuf, CAST(k*3600+1 AS BIGINT), 3600)} for k in range(CAST(cuts AS BIGINT))]
FROM (SELECT *, greatest(ceil(length(nbuf)/3600.0)-1, 0) AS cuts FROM (
  SELECT f.doc_id, s.i, s.stem, f.buf, f.title, length(f.buf)+length(s.seg) <= 1800 AS fits,
    CASE WHEN length(f.buf)+length(s.seg) <= 1800 THEN f.buf||CASE WHEN f.buf <> '' THEN chr(10) ELSE '' END||s.seg ELSE s.seg END AS nbuf,
    CASE WHEN length(f.buf)+length(s.seg) <= 1800 THEN coalesce(nullif(f.title,''), s.t) ELSE s.t END AS ntitle
  FROM fold f JOIN secs s ON s.doc_id = f.doc_id AND s.i = f.i + 1))),
ends AS (SELECT f.doc_id, f.i + 1 AS i, [{'title': coalesce(nullif(title,''),stem), 'text': regexp_replace(buf,'^\s+|\s+$','','g')}] AS out
  FROM fold f JOIN (SELECT doc_id, stem, len(p) AS n FROM parts) z ON z.doc_id = f.doc_id AND z.n = f.i WHERE regexp_replace(buf,'^\s+|\s+$','','g') <> ''),
every AS (SELECT doc_id, i, j, out[j] AS c FROM (SELECT doc_id, i, out, unnest(range(1, len(out)+1)) AS j FROM (SELECT doc_id, i, out FROM fold UNION ALL SELECT doc_id, i, out FROM ends)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS chunk, c.title AS title, c.text AS text FROM every""")

VECTORS = {f"v{q}": [round(math.sin((i + 1) * (q + 1)), 6) for i in range(64)] for q in range(3)}
add("vector_search", lambda t: RT.vector_search(t.raw("embeddings"), VECTORS, "vec_id", "embedding", 5), "WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({v} AS DOUBLE[])) AS raw FROM embeddings" for n, v in VECTORS.items()) + """)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS INTEGER) AS rank, round(raw,4) AS score FROM s WHERE raw > 0 QUALIFY rank <= 5""")
WORDS = {"en": "that the with whale", "de": "Nicht und die Zebra der", "none": "qqqq"}
KEYWORD = "WITH q AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {sorted(set(w.lower().split()))})" for n, w in WORDS.items()) + r""") x(query_id, words)),
s AS (SELECT query_id, doc_id, len(list_intersect(words, list_distinct(regexp_split_to_array(lower(text),'[^\p{L}\p{N}]+')))) / len(words) AS raw FROM documents, q),
hits AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS INTEGER) AS rank, round(raw,4) AS score FROM s WHERE raw > 0 QUALIFY rank <= 5) """
add("keyword_search", lambda t: RT.keyword_search(t.raw("documents"), WORDS, "doc_id", "text", 5), KEYWORD + "SELECT * FROM hits")
add("search_company_knowledge", lambda t: RT.search_company_knowledge(RT.keyword_search(t.raw("documents"), WORDS, "doc_id", "text", 5)), KEYWORD + """
SELECT query_id, count(*) AS hits, max(score) AS best, CASE WHEN max(score) >= 0.45 THEN 'High' ELSE 'Medium' END AS confidence FROM hits GROUP BY 1""")

# --- logs ------------------------------------------------------------------------------------------------------------

add("merge_feedback", lambda t: L.merge_feedback(t.traces, t.feedback).select("trace_id", "user_feedback", "correction_flag"), "SELECT trace_id, user_feedback, correction_flag FROM traced")
add("conversations", lambda t: L.conversations(t.traces).withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm")), """
SELECT conversation_id, arg_min(question, turn) AS title, count(*) AS turns, strftime(max(ts),'%Y-%m-%d %H:%M') AS last_ts FROM traces GROUP BY 1""")
add("conversation_turns", lambda t: L.conversation_turns(L.merge_feedback(t.traces, t.feedback)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), """
SELECT conversation_id, turn, strftime(ts,'%Y-%m-%d %H:%M:%S') AS ts, question, answer, concat_ws('.', tool, function) AS step, CASE WHEN correction_flag THEN 'down' ELSE 'up' END AS feedback FROM traced""")


def _flagged(t: Tables) -> DataFrame:
    rare = t.traces.withColumn("user_feedback", F.lit(None)).withColumn("correction_flag", F.length("question") > 420)
    return L.bug_inbox(rare, AS_OF)


INBOX = """inbox AS (SELECT trace_id, CASE WHEN length(question) > 420 THEN 'tool_routing_error' WHEN needs_clarification THEN 'semantic_gap'
  WHEN answer LIKE 'Tool error%' OR validator_errors > 0 THEN 'answer_quality_issue'
  WHEN question LIKE 'Last week%' AND args NOT LIKE '%date_from%' THEN 'time_parse_error'
  WHEN entity IS NOT NULL AND engine = 'deterministic' AND coalesce(resolved_terms,'') NOT LIKE '%westlake%' THEN 'entity_resolution_error'
  WHEN coalesce(result_rows,0) = 0 AND tool IS NOT NULL THEN 'data_quality_issue' WHEN confidence = 'Low' THEN 'answer_quality_issue'
  WHEN engine = 'deterministic' AND resolved_terms IS NULL AND tool IS NULL THEN 'business_definition_gap' END AS category FROM traces)"""
add("bug_inbox", lambda t: _flagged(t).select("trace_id", "category"), f"WITH {INBOX} SELECT trace_id, category FROM inbox WHERE category IS NOT NULL")
add("bug_counts", lambda t: L.bug_counts(_flagged(t)), f"""
WITH {INBOX} SELECT coalesce(category,'(all)') AS category, count(*) AS traces FROM inbox WHERE category IS NOT NULL GROUP BY ROLLUP (category)""")
add("retro_signals", lambda t: t.usage.select("call_id", "corrected", "followed_up"), "SELECT call_id, corrected, followed_up FROM usage")
RATES = """SELECT CASE WHEN tool IS NULL THEN '(clarification)' ELSE tool||'.'||function END AS tool_function, count(*) AS uses, round(avg(CAST(ok AS INTEGER)),2) AS success_rate,
  round(avg(CAST(ok AND row_count = 0 AS INTEGER)),2) AS zero_row_rate, round(avg(CAST(followed_up AS INTEGER)),2) AS followup_rate,
  round(avg(CAST(corrected AS INTEGER)),2) AS correction_rate, round(avg(CAST(confidence = 'High' AS INTEGER)),2) AS high_confidence_rate FROM """
add("usage_report", lambda t: L.usage_report(t.usage, 100), RATES + "(SELECT * FROM usage ORDER BY ts DESC, call_id DESC LIMIT 100) GROUP BY 1")
add("usage_report_all", lambda t: L.usage_report(t.usage, None), RATES + "usage GROUP BY 1")


def _actions(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.raw("events").select(
        F.col("event_id"), F.col("ts"), F.concat(F.lit("iss-"), F.col("user_id").cast("string"), F.when(F.col("value") > 30, "-x").otherwise("")).alias("issue_id"),
        F.when(kind.isin("click", "error"), "executed").when(kind == "view", "approved").when(kind == "purchase", "dry_run").otherwise("snoozed").alias("status"),
        F.when(kind == "error", "failed").when((kind == "click") & (F.col("value") > 5), "resolved").alias("result"))


add("action_status", lambda t: L.action_status(_actions(t)), """
SELECT issue_id, coalesce(arg_max(state, ts) FILTER (state IS NOT NULL), 'previewed') AS status, count(*) AS events FROM (
SELECT 'iss-'||user_id||CASE WHEN value > 30 THEN '-x' ELSE '' END AS issue_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN CASE WHEN value > 5 THEN 'resolved' ELSE 'executed' END
  WHEN 'view' THEN 'approved' WHEN 'signup' THEN 'snoozed' END AS state FROM events) GROUP BY 1""")
add("failure_streaks", lambda t: L.failure_streaks(t.runs), """
SELECT job, count(*) AS runs, arg_max(status, started) AS latest_status, count(*) FILTER (later_good = 0 AND status = 'Failed') AS streak FROM (
SELECT *, count(*) FILTER (status <> 'Failed') OVER (PARTITION BY job ORDER BY started ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later_good FROM runs) GROUP BY 1""")


def _cases(t: Tables) -> DataFrame:
    cases = t.traces.select("trace_id", F.lit("timesheet").alias("tool"), F.lit("get_weekly_timesheet").alias("function"), F.when(F.col("turn") > 0, F.lit("deterministic")).alias("engine"))
    return L.expected_vs_actual(cases, t.traces, "trace_id", ["tool", "function", "engine"])


add("expected_vs_actual", _cases, """
SELECT trace_id, 'tool' AS field, 'timesheet' AS expected, tool AS actual FROM traces WHERE tool IS NULL
UNION ALL SELECT trace_id, 'function', 'get_weekly_timesheet', function FROM traces WHERE function IS NULL
UNION ALL SELECT trace_id, 'engine', 'deterministic', engine FROM traces WHERE turn > 0 AND engine <> 'deterministic'""")


def _nudges(t: Tables) -> DataFrame:
    o = t.raw("orders")
    items = o.select(F.when(F.col("o_orderstatus") == "F", " ").when(F.col("o_orderstatus") == "O", "done").alias("status"), F.col("o_orderdate").alias("created"),
                     F.lit("jobs").alias("table"), F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("creator"),
                     F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("w"), F.col("o_custkey").cast("string"))).alias("email"))
    log = o.filter("o_totalprice > 400000").select(F.concat(F.lit("jobs:"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderdate").alias("ts"))
    return L.nudges(items, log, "2001-07-20", 30)


add("nudges", _nudges, """
SELECT 'jobs:'||o_orderkey AS key, 'jobs' AS "table", o_orderkey AS item_id, o_orderpriority AS title, o_custkey AS creator, 'w'||o_custkey AS email FROM orders
WHERE o_orderstatus <> 'O' AND o_orderdate >= DATE '2001-06-20' AND o_orderpriority <> '5-LOW' AND NOT (o_totalprice > 400000 AND o_orderdate > DATE '2001-06-20')""")


def _asked(t: Tables) -> DataFrame:
    return t.raw("events").select(F.col("user_id").alias("user"), F.col("event_id").alias("question_id"), "ts", F.concat(F.col("event_type"), F.lit("/Detail")).alias("domain"),
                                  F.col("props").alias("question"))


add("user_focus", lambda t: L.user_focus(_asked(t)), 'SELECT user_id AS "user", event_type AS focus, count(*) AS questions FROM events GROUP BY 1, 2')
add("recent_questions", lambda t: L.recent_questions(_asked(t), 50), """
SELECT user_id AS "user", CAST(n AS INTEGER) AS n, props AS question FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50""")
