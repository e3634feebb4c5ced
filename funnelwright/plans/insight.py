"""Findings, lineage and text quality."""

from pyspark.sql import Window as W, functions as F

from funnelwright.functions import lexicons as LX
from funnelwright.functions.scalars import r
from funnelwright.operators import findings as L
from funnelwright.operators import text as N
from funnelwright.plans.registry import query

# --- findings: revenue of a segment and priority against the year before -----------------

_DESC = {"1-URGENT": "Checkout conversion on mobile", "2-HIGH": "Retention of paid plan", "3-MEDIUM": "Monthly growth on web", "4-NOT SPECIFIED": "Unusual spike on ios", "5-LOW": "Revenue of enterprise"}
_case = "case o_orderpriority " + " ".join(f"when '{k}' then '{v}'" for k, v in _DESC.items()) + " end"
FIND_SQL = f"""fo as (select c_mktsegment as seg, o_orderpriority as pri, year(o_orderdate) as y, max({_case}) as d, sum(o_totalprice) as v, count(*) as n from orders join customer on o_custkey=c_custkey group by 1,2,3),
  fl as (select *, lag(v) over (partition by seg, pri order by y) as b, n/sum(n) over (partition by pri, y)::double as aff from fo),
  fd as (select seg || '|' || pri || '|' || y as finding_id, d || ' for ' || seg as description, 'Revenue ' || pri as metric_name, v as metric_value, b as baseline_value, aff as affected_pct, pri in ('1-URGENT','2-HIGH') as actionable, (n%11)/10.0::double as confidence, (n%7)/100.0::double as p_value, abs(v-b)/b as effect_size,
    case when v > b*1.02 then 'up' when v < b*0.98 then 'down' else '' end as direction, case when y%2=0 then 'segment' else '' end as category from fl where b is not null),
  sc as (select *, case when baseline_value=0 then 15 when abs(metric_value-baseline_value)/baseline_value>0.5 then 25 when abs(metric_value-baseline_value)/baseline_value>0.2 then 20 when abs(metric_value-baseline_value)/baseline_value>0.1 then 15 when abs(metric_value-baseline_value)/baseline_value>0.05 then 10 else 5 end as magnitude,
    case when affected_pct>0.5 then 25 when affected_pct>0.3 then 20 when affected_pct>0.1 then 15 when affected_pct>0.05 then 10 else 5 end as breadth, least(25, case when actionable then 25 else 5 end + case when effect_size>0.5 then 5 else 0 end) as actionability,
    greatest(0, least(25, cast(round_even(confidence*25,0) as integer) + case when p_value<0.05 then 5 else 0 end)) as conf_score from fd), fs as (select *, magnitude+breadth+actionability+conf_score as score from sc)"""


def findings(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    desc = F.create_map(*[x for k, v in _DESC.items() for x in (F.lit(k), F.lit(v))])[F.col("pri")]
    g = o.groupBy(F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("pri"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))
    g = g.withColumns({"b": F.lag("v").over(W.partitionBy("seg", "pri").orderBy("y")), "aff": F.col("n") / F.sum("n").over(W.partitionBy("pri", "y"))}).where("b is not null")
    return g.select(
        F.concat_ws("|", "seg", "pri", "y").alias("finding_id"), F.concat(desc, F.lit(" for "), "seg").alias("description"), F.concat(F.lit("Revenue "), "pri").alias("metric_name"), F.col("v").alias("metric_value"), F.col("b").alias("baseline_value"),
        F.col("aff").alias("affected_pct"), F.col("pri").isin("1-URGENT", "2-HIGH").alias("actionable"), (F.col("n") % 11 / 10.0).alias("confidence"), (F.col("n") % 7 / 100.0).alias("p_value"), (F.abs(F.col("v") - F.col("b")) / F.col("b")).alias("effect_size"),
        F.when(F.col("v") > F.col("b") * 1.02, "up").when(F.col("v") < F.col("b") * 0.98, "down").otherwise("").alias("direction"), F.when(F.col("y") % 2 == 0, "segment").otherwise("").alias("category"),
    )


@query("l01_score_findings", f"with {FIND_SQL} select finding_id, magnitude, breadth, actionability, conf_score, score, row_number() over (order by score desc, finding_id) as rank from fs")
def _(t):
    return L.rank_findings(L.score_findings(findings(t)), "finding_id").select("finding_id", "magnitude", "breadth", "actionability", "conf_score", "score", "rank")


def _like(words):
    return "regexp_matches(lower(description), '" + "|".join(words) + "')"


@query("l02_theme_findings", f"""with {FIND_SQL}, th as (select *, case when category<>'' then upper(category[1]) || category[2:] {" ".join(f"when {_like(w)} then '{k}'" for k, w in LX.THEMES.items())} else 'Other' end as theme from fs)
  select theme, count(*) as n, count(case when actionable then 1 end) as n_actionable, max(score) as best, arg_max(description, (score, finding_id)) as leader, count(case when score>=60 then 1 end) as n_high from th group by 1""")
def _(t):
    return L.theme_findings(L.score_findings(findings(t)))


@query("l03_contradictions", f"""with {FIND_SQL}, d as (select * from fd where direction in ('up','down')), p as (select a.finding_id, a.metric_name, a.direction, case when b.finding_id is null then 0 when lower(a.metric_name)=lower(b.metric_name) then 1 when (a.direction='up' and b.affected_pct>0.2) or (a.direction='down' and a.affected_pct>0.2) then 2 when a.confidence>=0.8 and b.confidence>=0.8 then 3 else 0 end as k from d a left join d b on a.direction<>b.direction)
  select finding_id, metric_name, direction, count(case when k=1 then 1 end) as same_metric, count(case when k=2 then 1 end) as large_decline, count(case when k=3 then 1 end) as both_confident from p group by 1,2,3""")
def _(t):
    return L.contradictions(findings(t))


@query("l04_meta_patterns", f"""with {FIND_SQL}, th as (select *, case when category<>'' then upper(category[1]) || category[2:] {" ".join(f"when {_like(w)} then '{k}'" for k, w in LX.THEMES.items())} else 'Other' end as theme from fs), w as (select unnest([{", ".join(f"'{w}'" for w in LX.DIMENSION_WORDS)}]) as name), h as (select name, count(*) as n from w join fd on contains(lower(description), name) group by 1 having count(*)>=2), g as (select count(case when direction='up' then 1 end) u, count(case when direction='down' then 1 end) d, count(case when direction<>'' then 1 end) n from fd)
  select 'dimension' as pattern, name, n from h union all select 'direction', case when n>=2 and u=n then 'all up' when n>=2 and d=n then 'all down' when u>=2 and d>=2 then 'mixed' end, n from g where (n>=2 and (u=n or d=n)) or (u>=2 and d>=2)
  union all select 'theme', theme, count(case when score>=60 then 1 end) from th group by theme having count(case when score>=60 then 1 end) >= 2""")
def _(t):
    return L.meta_patterns(findings(t), L.theme_findings(L.score_findings(findings(t))))


# --- lineage: each part's step reads the outputs of two earlier ones ----------------------

def step_log(t):
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("t"), c)
    return t.part.select(F.concat(F.lit("s"), k).alias("step"), F.array(name(F.expr("p_partkey div 2")), name(F.expr("p_partkey div 3"))).alias("inputs"), F.array(name(k)).alias("outputs"))


EDGE_SQL = "lg as (select p_partkey as k, unnest([p_partkey//2, p_partkey//3]) as i from part), ed as (select distinct 's' || a.k as child, 's' || b.p_partkey as parent, 't' || a.i as \"table\" from lg a join part b on a.i=b.p_partkey where a.k<>b.p_partkey)"


@query("l05_lineage_edges", f"with {EDGE_SQL} select * from ed")
def _(t):
    return L.lineage_edges(step_log(t))


@query("l06_lineage_ancestors", f"with recursive {EDGE_SQL}, an as (select 's' || (select max(p_partkey) from part) as step, 0 as depth union select ed.parent, an.depth+1 from an join ed on ed.child=an.step) select step, min(depth)::int as depth from an group by 1")
def _(t):
    start = t.part.agg(F.concat(F.lit("s"), F.max("p_partkey")).alias("step"))
    return L.lineage_ancestors(step_log(t), start)


@query("l07_miss_summary", """with m as (select 'k' || (user_id%4) as kind, count(*) as n, count(case when ts > timestamp '2024-01-18' and ts <= timestamp '2024-01-25' then 1 end) as recent from events where event_type='error' group by 1) select kind, n, recent, round(n/sum(n) over ()::double,6) as share, round(recent/7.0,6)::double as per_day from m""")
def _(t):
    log = t.events.where("event_type = 'error'").withColumn("kind", F.concat(F.lit("k"), F.col("user_id") % 4))
    return L.miss_summary(log, "kind", "ts", "2024-01-25", 7).select("kind", "n", "recent", r("share").alias("share"), r("per_day").alias("per_day"))


ISSUE_SQL = "iss as (select o_orderstatus as source, case when o_totalprice>300000 then 'size' else 'delay' end as category, case when o_totalprice > 490000 and o_orderstatus='P' then 'Rare Case, order ' || o_orderkey else 'Order ' || o_orderkey || ' (' || o_orderpriority || ')!' end as issue from orders), nk as (select *, trim(regexp_replace(regexp_replace(lower(issue), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as issue_key from iss)"


def issues(t):
    o = t.orders
    return o.select(F.col("o_orderstatus").alias("source"), F.when(F.col("o_totalprice") > 300000, "size").otherwise("delay").alias("category"),
                    F.when((F.col("o_totalprice") > 490000) & (F.col("o_orderstatus") == "P"), F.concat(F.lit("Rare Case, order "), "o_orderkey")).otherwise(F.concat(F.lit("Order "), "o_orderkey", F.lit(" ("), "o_orderpriority", F.lit(")!"))).alias("issue"))


@query("u06_union_merge", "select o_orderstatus as source, count(*) as n from orders group by 1")
def _(t):
    i = issues(t)
    return L.union_merge([i.where("source = 'F'"), i.where("source = 'O'"), i.where("source = 'P'")]).groupBy("source").agg(F.count("*").alias("n"))


@query("u06_dedup_merge", f"with {ISSUE_SQL} select category, issue_key, min(source) as first_source, count(*) as n, count(distinct source) as sources from nk group by 1,2")
def _(t):
    return L.dedup_merge(issues(t), "category", "issue", "source")


@query("u06_consensus_merge", f"with {ISSUE_SQL} select category, issue_key, count(distinct source) as votes, case when count(distinct source)>=2 then 'confirmed' else 'tentative' end as status, round(count(distinct source)/3.0::double,6) as confidence from nk group by 1,2")
def _(t):
    return L.consensus_merge(issues(t), "category", "issue", "source", 3).withColumn("confidence", r("confidence"))


@query("u06_scored_merge", "with g as (select p_brand, p_type, avg(p_size) as m from part group by 1,2) select p_brand, p_type, round(m,6) as mean_score, round(avg(m) over (partition by p_brand),6) as total from g")
def _(t):
    return L.scored_merge(t.part, "p_brand", "p_type", "p_size").select("p_brand", "p_type", r("mean_score").alias("mean_score"), r("total").alias("total"))


# --- text: documents with planted phrases --------------------------------------------------

PLANTS = ["Here's the thing: it really works. ", "Let's dive in — the stakes are high. ", "It is not just a tool, it's a “landscape”. ", "Fast, cheap, and simple. **Bold** move. ", "One two three. Four five six. Seven eight nine. ", ""]
PLANTS_ZH = ["值得注意的是，赋能闭环。", "标志着众多显著变化。", "", "未来可期，持续发力。"]


def planted(t, plants=PLANTS):
    p = F.array(*[F.lit(x) for x in plants])
    return t.documents.withColumn("text", F.concat(F.get(p, F.pmod(F.col("doc_id"), F.lit(len(plants))).cast("int")), "text"))


def _q(s):
    return "'" + s.replace("'", "''") + "'"


def _docs_sql(plants=PLANTS):
    return f"docs as (select doc_id, lang, source, ([{', '.join(_q(p) for p in plants)}])[(doc_id % {len(plants)} + 1)::bigint] || text as text from documents)"


def _count_sql(pattern):
    return f"len(regexp_extract_all(text, {_q(pattern)}))"


def _alternation(phrases):
    return "(" + "|".join(sorted((p.replace("?", "\\?").replace(".", "\\.") for p in phrases), key=lambda p: (-len(p), p))) + ")"


def _lex_sql(lexicon, words=True):
    """Case-insensitive counts written independently of the engine's pattern builder."""
    return {g: _count_sql(("(?i)\\b" if words else "") + _alternation(p)) for g, p in lexicon.items()}


def _cols(d):
    return ", ".join(f"{v}::int as {k}" for k, v in d.items())


@query("n01_phrase_hits", f"with {_docs_sql()} select doc_id, {_cols(_lex_sql(LX.PHRASES))} from docs")
def _(t):
    return N.phrase_hits(planted(t), "text", LX.PHRASES, ["doc_id"])


@query("n02_punctuation_tells", f"with {_docs_sql()} select doc_id, {_cols({k: _count_sql(v) for k, v in N.MARKS.items()})} from docs")
def _(t):
    return N.punctuation_tells(planted(t), "text", ["doc_id"])


@query("n03_rhythm", f"""with {_docs_sql()}, s as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: x <> '') as ss from docs), w as (select doc_id, list_transform(ss, lambda x: len(regexp_split_to_array(x, '\\s+'))) as n from s)
  select doc_id, len(n) as sentences, round(list_sum(n)/len(n)::double,6) as mean_words, list_max(n)::bigint as longest, case when len(n)>=3 then len(list_filter(range(1, len(n)-1), lambda i: n[i]=n[i+1] and n[i+1]=n[i+2])) else 0 end as equal_runs from w""")
def _(t):
    return N.rhythm(planted(t), "doc_id", "text").withColumn("mean_words", r("mean_words"))


@query("n04_contrast_patterns", f"with {_docs_sql()} select doc_id, {_cols({k: _count_sql(v) for k, v in N.CONTRASTS.items()})} from docs")
def _(t):
    return N.contrast_patterns(planted(t), "text", ["doc_id"])


@query("n05_zh_phrase_hits", f"with {_docs_sql(PLANTS_ZH)} select doc_id, {_cols(_lex_sql(LX.PHRASES_ZH, False))} from docs")
def _(t):
    return N.phrase_hits(planted(t, PLANTS_ZH), "text", LX.PHRASES_ZH, ["doc_id"], words=False)


@query("n05_zh_patterns", f"with {_docs_sql(PLANTS_ZH)} select doc_id, {_cols({k: _count_sql(v) for k, v in N.PATTERNS_ZH.items()})} from docs")
def _(t):
    return N.zh_patterns(planted(t, PLANTS_ZH), "text", ["doc_id"])


_HITS = "+".join(_lex_sql(LX.PHRASES).values())


@query("n06_text_score", f"with {_docs_sql()}, h as (select doc_id, length(text)::int as chars, {_HITS} as hits from docs) select doc_id, chars, hits, round(hits*1000.0::double/chars,6) as density from h")
def _(t):
    return N.text_score(planted(t), "text", LX.PHRASES, ["doc_id"]).withColumn("density", r("density"))


@query("n06_score_by_source", f"with {_docs_sql()}, h as (select lang, source, length(text) as chars, {_HITS} as hits from docs) select lang, source, count(*) as docs, sum(hits)::bigint as hits, sum(chars)::bigint as chars, count(case when hits>0 then 1 end) as docs_with_hits, round(sum(hits)*1000.0::double/sum(chars),6) as density from h group by 1,2")
def _(t):
    return N.score_summary(N.text_score(planted(t), "text", LX.PHRASES, ["lang", "source"]), ["lang", "source"]).withColumn("density", r("density"))


@query("n06_score_by_label", f"with {_docs_sql()}, h as (select doc_id, length(text) as chars, {_HITS} as hits from docs) select quality, toxic, count(*) as docs, sum(hits)::bigint as hits, round(sum(hits)*1000.0::double/sum(chars),6) as density from h join labels using (doc_id) group by 1,2")
def _(t):
    s = N.text_score(planted(t), "text", LX.PHRASES, ["doc_id"]).join(t.labels, "doc_id")
    return N.score_summary(s, ["quality", "toxic"]).select("quality", "toxic", "docs", "hits", r("density").alias("density"))
