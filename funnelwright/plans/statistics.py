"""Statistics."""

from pyspark.sql import functions as F

from funnelwright.functions import dist
from funnelwright.functions.scalars import r, ratio
from funnelwright.operators import ordered as O
from funnelwright.operators import stats as D
from funnelwright.plans.registry import query

Z = repr(D.Z975)
OUT = lambda df, keep, cols, digits=6: df.select(*keep, *[r(c, digits).alias(c) for c in cols])


@query("d01_labels", """with p as (select o_orderpriority as k, count(*) % 97 / 97.0::double * 0.1 as p, (avg(o_totalprice) - 240000)/30000 as d from orders group by 1)
  select k, case when p < 0.001 then 'Highly significant (p<0.001)' when p < 0.05 then printf('Statistically significant (p=%.3f)', p) else printf('Not statistically significant (p=%.3f)', p) end as label,
  printf('%s effect (d=%.2f)', case when abs(d) < 0.2 then 'Small' when abs(d) <= 0.8 then 'Medium' else 'Large' end, abs(d)) as effect from p""")
def _(t):
    p = t.orders.groupBy(F.col("o_orderpriority").alias("k")).agg((F.count("*") % 97 / 97.0 * 0.1).alias("p"), ((F.avg("o_totalprice") - 240000) / 30000).alias("d"))
    return p.select("k", D.significance_label("p").alias("label"), D.effect_label("d").alias("effect"))


@query("d02_mean_stats", "select c_mktsegment, count(*) as n, round(avg(c_acctbal),6) as mean, round(stddev_samp(c_acctbal),6) as sd, round(stddev_samp(c_acctbal)/sqrt(count(*)),6) as se from customer group by 1")
def _(t):
    return OUT(D.mean_stats(t.customer, ["c_mktsegment"], "c_acctbal"), ["c_mktsegment", "n"], ["mean", "sd", "se"])


@query("d02_mean_ci")
def _(t):
    return D.mean_ci(t.customer, ["c_mktsegment"], "c_acctbal")


@query("d03_distributions")
def _(t):
    g = t.orders.groupBy(F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"))
    z = (F.col("mean") - 250000) / (F.col("sd") / F.sqrt("n"))
    return g.select("m", dist.p_norm_two_sided(z).alias("p_norm"), dist.p_t_two_sided(z, F.col("n") - 1).alias("p_t"), dist.p_chi2(z * z, F.lit(1)).alias("p_chi2"), dist.p_f(z * z, F.lit(1), F.col("n") - 1).alias("p_f"), dist.q_t(F.lit(0.975), F.col("n") - 1).alias("t975"))


ZT = f"""with g as (select count(case when user_id%2=0 then 1 end)::double na, count(case when user_id%2=1 then 1 end)::double nb, count(case when user_id%2=0 and event_type='purchase' then 1 end)::double xa, count(case when user_id%2=1 and event_type='purchase' then 1 end)::double xb from events),
  p as (select *, xa/na pa, xb/nb pb, (xa+xb)/(na+nb) pp from g)"""


def ztest(t):
    return D.prop_ztest(t.events, F.col("user_id") % 2, F.col("event_type") == "purchase", 0, 1)


@query("d04_prop_ztest", ZT + f" select na::bigint as n_a, nb::bigint as n_b, xa::bigint as x_a, xb::bigint as x_b, round(pa,6) as prop_a, round(pb,6) as prop_b, round(pb-pa,6)+0.0 as diff, round((pb-pa)/sqrt(pp*(1-pp)*(1/na+1/nb)),6)+0.0 as z, round((pb-pa)/pa,6)+0.0 as lift, round(pb-pa-{Z}*sqrt(pa*(1-pa)/na+pb*(1-pb)/nb),6)+0.0 as ci_lower, round(pb-pa+{Z}*sqrt(pa*(1-pa)/na+pb*(1-pb)/nb),6)+0.0 as ci_upper from p")
def _(t):
    return OUT(ztest(t), ["n_a", "n_b", "x_a", "x_b"], ["prop_a", "prop_b", "diff", "z", "lift", "ci_lower", "ci_upper"])


@query("d04_prop_ztest_p")
def _(t):
    return D.with_normal_p(ztest(t))


WT = """with g as (select count(*) filter (where o_orderstatus='F')::double na, avg(o_totalprice) filter (where o_orderstatus='F') ma, var_samp(o_totalprice) filter (where o_orderstatus='F') va, count(*) filter (where o_orderstatus='O')::double nb, avg(o_totalprice) filter (where o_orderstatus='O') mb, var_samp(o_totalprice) filter (where o_orderstatus='O') vb from orders)
  select na::bigint as n_a, nb::bigint as n_b, round(ma,4) as mean_a, round(mb,4) as mean_b, round((ma-mb)/sqrt(va/na+vb/nb),6)+0.0 as t, round((va/na+vb/nb)**2/((va/na)**2/(na-1)+(vb/nb)**2/(nb-1)),4) as df, round((mb-ma)/sqrt(((na-1)*va+(nb-1)*vb)/(na+nb-2)),6)+0.0 as cohens_d from g"""


@query("d05_welch_ttest", WT)
def _(t):
    w = D.welch_ttest(t.orders, F.col("o_orderstatus"), "o_totalprice", "F", "O")
    return w.select("n_a", "n_b", r("mean_a", 4).alias("mean_a"), r("mean_b", 4).alias("mean_b"), r("t").alias("t"), r("df", 4).alias("df"), r("cohens_d").alias("cohens_d"))


@query("d05_welch_ttest_p")
def _(t):
    return D.with_t_p(D.welch_ttest(t.orders, F.col("o_orderstatus"), "o_totalprice", "F", "O"))


MW = """with x as (select l_returnflag as g, l_quantity as v from lineitem where l_returnflag in ('A','R')), c as (select v, count(*) as t, count(case when g='A' then 1 end) as ta from x group by 1), k as (select *, sum(t) over (order by v) - (t-1)/2.0::double as rk from c),
  s as (select sum(ta)::double na, (sum(t)-sum(ta))::double nb, sum(ta*rk) ra, sum(t::double**3-t) ties from k), u as (select *, ra-na*(na+1)/2 as u from s)
  select na::bigint as n_a, nb::bigint as n_b, u, round((greatest(u,na*nb-u)-na*nb/2-0.5)/sqrt(na*nb/12*((na+nb+1)-ties/((na+nb)*(na+nb-1)))),6) as z, round(1-2*u/(na*nb),6)+0.0 as rank_biserial, (select median(v) from x where g='A') as median_a, (select median(v) from x where g='R') as median_b from u"""


@query("d06_mann_whitney", MW)
def _(t):
    return D.mann_whitney(t.lineitem, "l_returnflag", "l_quantity", "A", "R").select("n_a", "n_b", "u", r("z").alias("z"), r("rank_biserial").alias("rank_biserial"), "median_a", "median_b")


@query("d06_mann_whitney_p")
def _(t):
    return D.with_normal_p(D.mann_whitney(t.lineitem, "l_returnflag", "l_quantity", "A", "R"))


@query("d07_chi2", """with c as (select o_orderstatus r, o_orderpriority c, count(*)::double o from orders group by 1,2), e as (select *, sum(o) over (partition by r)*sum(o) over (partition by c)/sum(o) over () as e from c)
  select sum(o)::bigint as n, round(sum((o-e)**2/e),6) as chi2, ((count(distinct r)-1)*(count(distinct c)-1))::bigint as dof from e""")
def _(t):
    return D.chi2_independence(t.orders, "o_orderstatus", "o_orderpriority").select("n", r("chi2").alias("chi2"), "dof")


@query("d07_chi2_2x2", """with c as (select l_linestatus r, l_quantity > 30 c, count(*)::double o from lineitem group by 1,2), e as (select *, sum(o) over (partition by r)*sum(o) over (partition by c)/sum(o) over () as e from c)
  select sum(o)::bigint as n, round(sum((abs(o-e)-least(0.5,abs(o-e)))**2/e),6) as chi2, 1::bigint as dof from e""")
def _(t):
    return D.chi2_independence(t.lineitem.withColumn("big", F.col("l_quantity") > 30), "l_linestatus", "big").select("n", r("chi2").alias("chi2"), "dof")


@query("d07_chi2_p")
def _(t):
    d = D.chi2_independence(t.orders, "o_orderstatus", "o_orderpriority")
    return d.withColumn("p_value", dist.p_chi2("chi2", "dof")).withColumn("label", D.significance_label("p_value"))


def boot_sql(stat, plain, n=100, seed=42):
    """The same draws: three rounds of xor-shift and multiplication modulo 2^32 over both halves of the key."""
    m, mix = 4294967295, lambda x: f"((xor({x}, {x} >> 16) * 73244475) & {m})"
    weight = "case " + " ".join(f"when u < {p:.17e} then {k}" for k, p in enumerate(D._POISSON1)) + f" else {len(D._POISSON1)} end"
    return f"""with b as (select unnest(range(1, {n + 1}))::bigint as b), k as (select o_orderkey::bigint as k, o_totalprice as v from orders), s0 as (select b, k, v, xor(k & {m}, ({seed * 2654435769}::bigint + b * 40503) & {m}) as x from k, b),
      s1 as (select b, k, v, {mix('x')} as x from s0), s2 as (select b, v, xor(x, k >> 32) as x from s1), s3 as (select b, v, {mix('x')} as x from s2), s4 as (select b, v, {mix('x')} as x from s3), s5 as (select b, v, xor(x, x >> 16) / 4294967296.0::double as u from s4),
      w as (select b, v, {weight} as w from s5), r as (select b, {stat} as s from w group by b)
      select round(quantile_cont(s, 0.025), 4) as ci_lower, round(quantile_cont(s, 0.975), 4) as ci_upper, count(s) as replicates, (select round({plain}, 4) from orders) as stat from r"""


@query("d08_bootstrap_ci", boot_sql("sum(v * w) / sum(w)", "avg(o_totalprice)"))
def _(t):
    return OUT(D.bootstrap_ci(t.orders, "o_orderkey", "o_totalprice", D.weighted_mean_stat, replicates=100), ["replicates"], ["ci_lower", "ci_upper", "stat"], 4)


@query("y01_bootstrap_custom_statistic", boot_sql("sum(case when v > 300000 then w else 0 end) / sum(w)::double", "sum((o_totalprice > 300000)::int) / count(*)::double"))
def _(t):
    share = lambda v, w: F.sum(F.when(v > 300000, w).otherwise(0)) / F.sum(w)
    return OUT(D.bootstrap_ci(t.orders, "o_orderkey", "o_totalprice", share, replicates=100), ["replicates"], ["ci_lower", "ci_upper", "stat"], 4)


PV = "p as (select o_orderstatus as fam, o_custkey % 50 as k, least(1.0, abs(avg(o_totalprice) - 250000)/90000) as p from orders group by 1,2)"


@query("d09_adjust_pvalues", f"""with {PV}, r as (select *, count(*) over (partition by fam) as n, row_number() over (partition by fam order by p, k) as rk from p)
  select fam, k, round(p,6) as p, round(least(p*n,1),6) as bonferroni, round(least(max(p*(n-rk+1)) over (partition by fam order by p, k),1),6) as holm, round(least(min(p*n/rk) over (partition by fam order by p, k rows between current row and unbounded following),1),6) as bh from r""")
def _(t):
    p = t.orders.groupBy(F.col("o_orderstatus").alias("fam"), (F.col("o_custkey") % 50).alias("k")).agg(F.least(F.lit(1.0), F.abs(F.avg("o_totalprice") - 250000) / 90000).alias("p"))
    return OUT(D.adjust_pvalues(p, "p", ["fam"], "k"), ["fam", "k"], ["p", "bonferroni", "holm", "bh"])


K2_SQL = """k1 as (select *, g1*sqrt((n+1)*(n+3)/(6*(n-2))) y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) b2, (g2+3-3*(n-1)/(n+1))/sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) x, 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) sb from mo),
  k2 as (select *, sqrt(2*(b2-1))-1 w2, 6+8/sb*(2/sb+sqrt(1+4/(sb*sb))) a from k1), k3 as (select *, asinh(y/sqrt(2/(w2-1)))/sqrt(0.5*ln(w2)) z1, 1+x*sqrt(2/(a-4)) den from k2),
  k4 as (select *, (1-2/(9*a)-sign(den)*((1-2/a)/abs(den))**(1.0/3))/sqrt(2/(9*a)) z2 from k3), k5 as (select *, z1*z1+z2*z2 as k2v from k4)"""
MOM_SQL = """raw as (select {g} as g, {x}::double as x from {t}), mo as (select g, count(*)::double n, avg(x) mean, stddev_samp(x) sd, skewness(x)*(count(*)-2)/sqrt(count(*)*(count(*)-1.0)) g1,
  (avg(x**4)-4*avg(x)*avg(x**3)+6*avg(x)**2*avg(x**2)-3*avg(x)**4)/var_pop(x)**2-3 g2 from raw group by 1)"""


@query("d10_characterise", "with raw as (select 'l_quantity' as g, l_quantity as x from lineitem union all select 'l_discount', l_discount from lineitem union all select 'l_extendedprice', l_extendedprice from lineitem), " + MOM_SQL.split("), ", 1)[1] + f""", {K2_SQL},
  q as (select g, quantile_cont(x,0.05) p5, quantile_cont(x,0.25) p25, median(x) md, quantile_cont(x,0.75) p75, quantile_cont(x,0.95) p95 from raw group by 1)
  select g as column_name, n::bigint as n, round(mean,6) as mean, round(sd,6) as sd, round(p5,6) as p5, round(p25,6) as p25, round(md,6) as median, round(p75,6) as p75, round(p95,6) as p95, round(g1,5)+0.0 as skewness, round(g2,5)+0.0 as kurtosis, exp(-k2v/2) >= 0.05 as is_normal,
  case when abs(g1)<0.5 then 'approximately symmetric' when g1>0 then 'right-skewed' else 'left-skewed' end || case when g2>1 then ', heavy-tailed' when g2<-1 then ', light-tailed' else '' end as shape from k5 join q using (g)""")
def _(t):
    d = D.characterise(t.lineitem, ["l_quantity", "l_discount", "l_extendedprice"])
    return d.select("column_name", F.col("n").cast("long").alias("n"), *[r(c).alias(c) for c in ("mean", "sd", "p5", "p25", "median", "p75", "p95")], r("skew_biased", 5).alias("skewness"), r("kurt_biased", 5).alias("kurtosis"), "is_normal", "shape")


@query("d10_modality", """with b as (select min(o_totalprice) lo, max(o_totalprice) hi from orders), h as (select least(cast(floor((o_totalprice-lo)/((hi-lo)/20)) as integer),19) as bin, count(*) n from orders, b group by 1), f as (select i.bin, coalesce(n,0) n from (select unnest(range(0,20)) as bin) i left join h using (bin)),
  p as (select n, lag(n) over (order by bin) l, lead(n) over (order by bin) r from f) select count(case when (l is null or n>l) and (r is null or n>r) then 1 end) as peaks, case when count(case when (l is null or n>l) and (r is null or n>r) then 1 end) <= 1 then 'unimodal' when count(case when (l is null or n>l) and (r is null or n>r) then 1 end) = 2 then 'bimodal' else 'multimodal' end as modality from p""")
def _(t):
    return D.modality(t.orders, "o_totalprice", 20)


@query("d11_rank_dimensions", """with l as (select 'l_returnflag' as dimension, l_returnflag as m, l_extendedprice x from lineitem union all select 'l_linestatus', l_linestatus, l_extendedprice from lineitem union all select 'l_linenumber', l_linenumber::varchar, l_extendedprice from lineitem union all select 'l_suppkey', l_suppkey::varchar, l_extendedprice from lineitem),
  gm as (select dimension, avg(x) as gm, count(*) as nt, var_pop(x)*count(*) as sst from l group by 1), g as (select dimension, m, count(*) n, avg(x) mx, var_pop(x)*count(*) ssw from l group by 1,2),
  s as (select g.dimension, count(*) k, sum(n*(mx-gm)**2) ssb, max(sst) sst, sum(ssw) ssw, max(nt) nt from g join gm using (dimension) where n>=2 group by 1)
  select dimension, round(ssb/sst,8) as eta_squared, k as n_groups, round((ssb/(k-1))/(ssw/(nt-k)),5) as f_statistic, cast(row_number() over (order by ssb/sst desc, dimension) as integer) as rank from s""")
def _(t):
    d = D.rank_dimensions(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"])
    return d.select("dimension", r("eta_squared", 8).alias("eta_squared"), "n_groups", r("f_statistic", 5).alias("f_statistic"), "rank")


@query("d11_rank_dimensions_p")
def _(t):
    d = D.rank_dimensions(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus", "l_suppkey"])
    return d.withColumn("p_value", dist.p_f("f_statistic", "df1", "df2"))


@query("d12_segment_summary", "select c_mktsegment, round(avg(c_acctbal),6) as mean, round(median(c_acctbal),6) as median, round(stddev_samp(c_acctbal),6) as sd, count(*) as n from customer group by 1")
def _(t):
    s = D.segment_stats(t.customer, "c_mktsegment", "c_acctbal")
    return s.select("c_mktsegment", *[r(c).alias(c) for c in ("mean", "median", "sd")], F.col("n").cast("long").alias("n"))


@query("d12_compare_segments", """with x as (select c_mktsegment s, c_acctbal v from customer), m as (select s, count(*)::double n, avg(v) m, var_samp(v) va from x group by 1), pr as (select a.s sa, b.s sb, a.n na, b.n nb, a.m ma, b.m mb, a.va va, b.va vb from m a join m b on a.s<b.s),
  u as (select p.sa, p.sb, sum(case when y.v < x.v then 1.0 when y.v = x.v then 0.5 else 0 end)::double as u from pr p join x on x.s=p.sa join x y on y.s=p.sb group by 1,2)
  select pr.sa as seg_a, pr.sb as seg_b, 'mann-whitney' as test_used, u as stat, round((ma-mb)/sqrt(((na-1)*va+(nb-1)*vb)/(na+nb-2)),6)+0.0 as effect_size from pr join u on pr.sa=u.sa and pr.sb=u.sb""")
def _(t):
    d = D.compare_segments(t.customer, "c_mktsegment", "c_acctbal")
    return d.select("seg_a", "seg_b", "test_used", "stat", r("effect_size").alias("effect_size"))


@query("d12_segments_vs_rest", """with x as (select c_mktsegment s, c_acctbal v from customer), g as (select s, count(*)::double n, avg(v) m, var_samp(v) va from x group by 1), o as (select g.s, count(*)::double n, avg(v) m, var_samp(v) va from g join x on x.s<>g.s group by 1),
  rk as (select s, rank() over (order by v) + (count(*) over (partition by v)-1)/2.0 as r from x), u as (select s, sum(r) as rs from rk group by 1), tie as (select sum(c*c*c-c)::double as t from (select count(*)::double c from x group by v)),
  j as (select g.s, g.n, o.n as nr, g.m, o.m as mr, g.va, o.va as vr, rs - g.n*(g.n+1)/2 as u, t from g join o using (s) join u using (s), tie)
  select s as segment, 'mann-whitney' as test_used, round(u,4)::double as stat, round((m-mr)/sqrt(((n-1)*va+(nr-1)*vr)/(n+nr-2)),6)+0.0 as effect_size, round((greatest(u, n*nr-u)-n*nr/2-0.5)/sqrt(n*nr/12*(n+nr+1-t/((n+nr)*(n+nr-1)))),5)::double as z from j""")
def _(t):
    d = D.segments_vs_rest(t.customer, "c_mktsegment", "c_acctbal")
    return d.select("segment", "test_used", r("stat", 4).alias("stat"), r("effect_size").alias("effect_size"), r("z", 5).alias("z"))


@query("d12_compare_segments_p")
def _(t):
    return D.with_pairwise_p(D.compare_segments(t.customer, "c_mktsegment", "c_acctbal"))


@query("d13_correlations", """with c as (select 'l_quantity' a, 'l_extendedprice' b, corr(l_quantity,l_extendedprice) r from lineitem union all select 'l_quantity','l_discount',corr(l_quantity,l_discount) from lineitem union all select 'l_quantity','l_tax',corr(l_quantity,l_tax) from lineitem union all select 'l_extendedprice','l_discount',corr(l_extendedprice,l_discount) from lineitem union all select 'l_extendedprice','l_tax',corr(l_extendedprice,l_tax) from lineitem union all select 'l_discount','l_tax',corr(l_discount,l_tax) from lineitem)
  select a as col_a, b as col_b, round(r,6)+0.0 as r, case when abs(r)>=0.8 then 'very strong' when abs(r)>=0.6 then 'strong' when abs(r)>=0.4 then 'moderate' else 'weak' end as strength, case when r>0 then 'positive' else 'negative' end as direction from c where abs(r) >= 0.002""")
def _(t):
    d = D.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.002)
    return d.select("col_a", "col_b", r("r").alias("r"), "strength", "direction")


@query("d14_group_difference", """with q as (select median(l_extendedprice) md from lineitem), x as (select case when l_extendedprice>md then 'h' else 'l' end s, l_quantity, l_discount, l_tax from lineitem, q), l as (select 'l_quantity' attribute, s, l_quantity x from x union all select 'l_discount', s, l_discount from x union all select 'l_tax', s, l_tax from x),
  g as (select attribute, avg(case when s='h' then x end) mh, avg(case when s='l' then x end) ml, stddev_samp(x) sd from l group by 1)
  select attribute, round(mh,6) as mean_high, round(ml,6) as mean_low, round(mh-ml,6)+0.0 as diff, round((mh-ml)/sd,6)+0.0 as scaled, cast(row_number() over (order by abs((mh-ml)/sd) desc, attribute) as integer) as rank from g""")
def _(t):
    return OUT(D.group_difference(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), ["attribute", "rank"], ["mean_high", "mean_low", "diff", "scaled"])


@query("d15_feature_importance")
def _(t):
    li = t.lineitem.withColumns({"l_month": F.month("l_shipdate"), "l_dow": F.weekday("l_shipdate")})
    return D.feature_importance(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_month", "l_dow"])


@query("d16_run_summary", """with l as (select o_orderstatus as config, 'price' as metric, o_totalprice x from orders union all select o_orderstatus, 'key', (o_orderkey%1000)::double from orders), g as (select metric, config, avg(x) m, stddev_samp(x) sd, min(x) lo, max(x) hi from l group by 1,2)
  select metric, config, round(m,6) as mean, round(sd,4) as sd, round(lo,2) as lo, round(hi,2) as hi, round(max(case when config='O' then m end) over w - max(case when config='F' then m end) over w,5)+0.0 as delta from g window w as (partition by metric)""")
def _(t):
    o = t.orders.select(F.col("o_orderstatus").alias("config"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 1000).alias("key"))
    d = D.run_summary(o, "config", ["price", "key"], "F", "O")
    return d.select("metric", "config", r("mean").alias("mean"), r("sd", 4).alias("sd"), r("lo", 2).alias("lo"), r("hi", 2).alias("hi"), r("delta", 5).alias("delta"))


@query("d17_segment_summary", """with l as (select 'segment' as dimension, c_mktsegment as member, c_acctbal x from customer union all select 'nation', c_nationkey::varchar, c_acctbal from customer), g as (select dimension, member, count(*) n, avg(x) m, sum(x) s from l group by 1,2), h as (select *, sum(s) over w / sum(n) over w as o, max(m) over w - min(m) over w as gap, n/sum(n) over w::double as share from g window w as (partition by dimension))
  select dimension, member, n, round(m,6) as mean, round(share,6) as share, round(o,6) as overall, round(gap,6) as gap, round(m/o-1,6)+0.0 as vs_overall, abs(m/o-1)>0.2 as stands_out, n<100 as too_small from h""")
def _(t):
    c = t.customer.select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), "c_acctbal")
    d = D.segment_summary(c, ["segment", "nation"], "c_acctbal")
    return d.select("dimension", "member", "n", *[r(c).alias(c) for c in ("mean", "share", "overall", "gap", "vs_overall")], "stands_out", "too_small")
