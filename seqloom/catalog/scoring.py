"""Variant sets over the documents read as sequences: three variants each, windows of 32."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import scoring
from .base import SEQ_SQL, query, rounded, sequences_of

_WINDOW, _STRIDE = 32, 20

#: One or two mutations per variant, at places that follow from the document's number.
_VARIANTS = f"""targets as (select doc_id as assay, replace({SEQ_SQL}, '*', 'X') as target from documents where doc_id is not null and length({SEQ_SQL}) >= 8),
places as (select assay, target, j, assay * 10 + j as variant_id, length(target) as n, ((assay * 7 + j * 13) % length(target))::int as a, ((assay * 7 + j * 13 + (assay + j) % 40) % length(target))::int as b
  from targets cross join (select unnest([1, 2, 3]) as j)),
listed as (select *, list_sort(list_distinct([a, b])) as ps, (a + case when a = b then 0 else b end) // case when a = b then 1 else 2 end as c from places),
wins as (select *, (case when n <= {_WINDOW} or c < {_WINDOW // 2} then 0 when c >= n - {_WINDOW // 2} then n - {_WINDOW} else greatest(0, c - {_WINDOW // 2}) end)::int as s,
  (case when n <= {_WINDOW} then n when c < {_WINDOW // 2} then {_WINDOW} when c >= n - {_WINDOW // 2} then n else least(n, c + {_WINDOW // 2}) end)::int as e from listed),
variants as (select *, list_transform(ps, lambda p: p - s) as rel, ps[1] >= s and ps[-1] < e as inside, substr(target, s + 1, e - s) as wild,
  case when substr(target, ps[1] + 1, 1) = 'A' then 'C' else 'A' end as m1, case when substr(target, ps[-1] + 1, 1) = 'A' then 'C' else 'A' end as m2 from wins)"""


def _variants(spark, sf):
    t = sequences_of(spark, sf).where("doc_id is not null").select(F.col("doc_id").alias("assay"), F.replace("seq", F.lit("*"), F.lit("X")).alias("target"))
    t = t.withColumn("n", F.length("target")).where("n >= 8").withColumn("j", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    a = (F.col("assay") * 7 + F.col("j") * 13) % F.col("n")
    b = (F.col("assay") * 7 + F.col("j") * 13 + (F.col("assay") + F.col("j")) % 40) % F.col("n")
    t = t.withColumn("ps", F.array_sort(F.array_distinct(F.array(a.cast("int"), b.cast("int")))))
    t = t.withColumn("subs", F.transform("ps", lambda p: F.struct(p.alias("p"), F.substring("target", p + 1, F.lit(1)).alias("wild"))))
    new = lambda s: F.when(s["wild"] == "A", "C").otherwise("A")
    mutant = F.array_join(F.transform("subs", lambda s: F.concat(s["wild"], (s["p"] + 1).cast("string"), new(s))), ":")
    put = lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["p"]), new(s), F.substring(acc, s["p"] + 2, F.length(acc)))
    return t.select((F.col("assay") * 10 + F.col("j")).alias("variant_id"), "assay", "target", F.aggregate("subs", F.col("target"), put).alias("mutated"), mutant.alias("mutant"), "ps", "n")


def stand_in_model(windows, masked, wanted):
    """Log-probabilities by arithmetic on the window, what is masked and what can be seen at the position."""
    symbols = np.array([ord(c) for c in scoring.ALPHABET])
    out = []
    for w, hidden, at in zip(windows, masked, wanted, strict=True):
        seen = np.array([ord("?") if p in set(hidden) else ord(w[p]) for p in at])
        base = np.array(at) * 17 + len(w) * 3 + ord(w[0]) * 5 + len(hidden) * 7 + seen * 11
        out.append(-((symbols[None] * 31 + base[:, None]) % 101) / 10)
    return out


def _logp(symbol: str, place: str, window: str, hidden: str, seen: str) -> str:
    return f"-((ascii({symbol}) * 31 + {place} * 17 + length({window}) * 3 + ascii({window}) * 5 + {hidden} * 7 + {seen} * 11) % 101) / 10.0"


def _score_sql(window: str, hidden: str, seen: str) -> str:
    """Sum over one or two mutations; ``seen`` takes the place as {p} and the new symbol as {m}."""
    parts = []
    for k, m in ((1, "m1"), (-1, "m2")):
        p = f"rel[{k}]"
        shown = seen.format(p=p, m=m)
        parts.append(f"({_logp(m, p, window, hidden, shown)}) - ({_logp(f'substr(wild, {p} + 1, 1)', p, window, hidden, shown)})")
    return f"case when inside then round({parts[0]} + case when len(rel) = 2 then {parts[1]} else 0 end, 5) end"


_MUTATED = "substr(left(wild, rel[1]) || m1 || substr(wild, rel[1] + 2), 1, case when len(rel) = 2 then rel[-1] else 999 end) || case when len(rel) = 2 then m2 || substr(wild, rel[-1] + 2) else '' end"


def _scores(spark, sf, method):
    contexts, links = scoring.plan_contexts(_variants(spark, sf), method, _WINDOW)
    return rounded(scoring.mapped_scores(links, scoring.score_contexts(contexts, stand_in_model)).select("variant_id", "score"), "score", places=5)


@query(f"with {_VARIANTS} select variant_id, {_score_sql('wild', 'len(rel)', '63')} as score from variants")
def masked_contexts(spark, sf):
    """Masked marginals; a context per window and set of masked positions."""
    return _scores(spark, sf, "masked_marginal")


@query(f"with {_VARIANTS} select variant_id, {_score_sql('wild', '0', 'ascii(substr(wild, {p} + 1, 1))')} as score from variants")
def wild_type_contexts(spark, sf):
    """Wild-type marginals; a context per window, whatever its variants."""
    return _scores(spark, sf, "wild_type_marginal")


@query(f"with {_VARIANTS}, shown as (select * exclude (wild), wild, {_MUTATED} as mutated from variants) select variant_id, {_score_sql('mutated', '0', 'ascii({m})')} as score from shown")
def mutant_contexts(spark, sf):
    """Mutant marginals; a context per variant."""
    return _scores(spark, sf, "mutant_marginal")


@query(f"""with {_VARIANTS}, v as (select * from variants where inside),
w as (select assay, s, unnest(rel) as p, rel from v)
select 'masked_marginal' as method, count(distinct (assay, s, rel)) as n_contexts, (select count(*) from (select distinct assay, s, rel, unnest(rel) as p from v)) as n_wanted from v
union all select 'wild_type_marginal', count(distinct (assay, s)), (select count(*) from (select distinct assay, s, p from w)) from v
union all select 'mutant_marginal', count(*), sum(len(rel))::bigint from v""")
def context_plan(spark, sf):
    """How many contexts each method evaluates, and positions in them."""
    out, variants = None, _variants(spark, sf)
    for method in scoring.METHODS:
        c = scoring.plan_contexts(variants, method, _WINDOW)[0].agg(F.lit(method).alias("method"), F.count(F.lit(1)).alias("n_contexts"), F.sum(F.size("wanted")).alias("n_wanted"))
        out = c if out is None else out.unionByName(c)
    return out


@query(f"""with {_VARIANTS}, w as (select assay, k::int as window_no, (k * {_STRIDE})::int as start, least(k * {_STRIDE} + {_WINDOW}, n)::int as "end"
  from (select assay, length(target) as n, unnest(range(0, length(target) // {_STRIDE} + 1)) as k from targets) where k * {_STRIDE} < n),
j as (select variant_id, window_no, start, "end", row_number() over (partition by variant_id order by window_no nulls last) as r
  from variants v left join w on w.assay = v.assay and w.start <= v.ps[1] and v.ps[-1] < w."end")
select variant_id, window_no, start, "end" from j where r = 1""")
def variant_to_window(spark, sf):
    """The first of overlapping windows that holds all mutations of a variant."""
    v = _variants(spark, sf)
    t = v.select("assay", F.col("n")).distinct()
    w = t.select("assay", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _STRIDE).cast("int"))).alias("window_no"))
    w = w.select("assay", "window_no", (F.col("window_no") * _STRIDE).alias("start"), F.least(F.col("window_no") * _STRIDE + _WINDOW, F.col("n")).alias("end"))
    asked = v.select("variant_id", "assay", F.array_min("ps").alias("first"), F.array_max("ps").alias("last"))
    return scoring.windows_of(asked, w, "assay", "first", "last").select("variant_id", "window_no", "start", "end")


@query(f"""with {_VARIANTS}, m as (select unnest(['plain', 'shifted', 'broken']) as model), k as (select unnest(['masked_marginal', 'mutant_marginal']) as method),
c as (select assay, count(*) filter (inside) as scored, count(*) as n_variants, count(distinct (s, rel)) filter (inside) as masked from variants group by assay)
select model, method, assay, n_variants, case when model = 'broken' then 0 else scored end::bigint as n_scored,
  case when method = 'masked_marginal' then masked else scored end::bigint as n_contexts, case when model <> 'broken' then 0 when method = 'masked_marginal' then masked else scored end::bigint as n_failed, true as timed
from c, m, k""")
def scoring_runs(spark, sf):
    """Three models, one of which always fails, by two methods over all assays, with their times."""

    def broken(windows, masked, wanted):
        raise ValueError("no weights")

    models = {"plain": stand_in_model, "shifted": lambda w, m, p: [x + 1 for x in stand_in_model(w, m, p)], "broken": broken}
    _, summary = scoring.run_models(_variants(spark, sf), models, ("masked_marginal", "mutant_marginal"), _WINDOW)
    return summary.withColumn("timed", F.col("seconds") >= 0).drop("seconds")
