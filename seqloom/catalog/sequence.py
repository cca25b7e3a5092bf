"""Sequence functions, cleaning and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, sequences
from ..operators import cleaning
from .base import SEQ_SQL, SEQS, UPPER_SQL, query, sequences_of, table, upper_text

_CODON_KEYS = "[" + ", ".join(f"'{k}'" for k in sequences.HUMAN_CODON) + "]"
_CODON_VALUES = "[" + ", ".join(f"'{v}'" for v in sequences.HUMAN_CODON.values()) + "]"
_DNA = f"array_to_string(list_transform(string_split(seq, ''), lambda c: coalesce({_CODON_VALUES}[list_position({_CODON_KEYS}, c)], 'GCT')), '')"
_DNA_KEYS = "[" + ", ".join(f"'{k}'" for k in sequences.DNA_TO_AMINO_ACID) + "]"
_DNA_VALUES = "[" + ", ".join(f"'{v}'" for v in sequences.DNA_TO_AMINO_ACID.values()) + "]"
_NON_EMPTY = "(select * from seqs where seq <> '')"
_AA = f"replace(array_to_string(list_transform(range(0, length(dna) // 3), lambda i: {_DNA_VALUES}[list_position({_DNA_KEYS}, substr(dna, 3 * i + 1, 3))]), ''), '*', '')"


@query(f"select doc_id, {SEQ_SQL} as seq, regexp_replace(coalesce(text, ''), '[^LAGVSERTIPDKQNFYMHWCXBUOZ*]', '', 'g') as strict_seq from documents")
def seq_sanitize(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", sequences.sanitize(F.coalesce("text", F.lit("")), fold=True).alias("seq"), sequences.sanitize(F.coalesce("text", F.lit(""))).alias("strict_seq"))


@query(f"with {SEQS} select doc_id, substr(seq, 1, 2048) as seq from seqs")
def seq_truncate(spark, sf):
    return sequences_of(spark, sf).withColumn("seq", sequences.truncate(F.col("seq"), 2048))


_PAIRS = """pairs as (
  select conv_id, turn, a, b from (
    select conv_id, turn, role, coalesce(text, '') as a,
      lead(coalesce(text, '')) over (partition by conv_id order by turn) as b,
      lead(role) over (partition by conv_id order by turn) as next_role from conversations)
  where role = 'user' and next_role = 'assistant')"""


def pairs_of(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("a", F.coalesce("text", F.lit("")))
    c = c.withColumn("b", F.lead("a").over(w)).withColumn("next_role", F.lead("role").over(w))
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "a", "b")


@query(f"""with {_PAIRS}, s as (
  select *, length(a) as la, length(b) as lb, length(a) + length(b) - 120 as e from pairs)
select conv_id, turn,
  case when e <= 0 then a when e <= abs(la - lb) then case when la > lb then substr(a, 1, la - e) else a end else substr(a, 1, 60) end as a,
  case when e <= 0 then b when e <= abs(la - lb) then case when lb > la then substr(b, 1, lb - e) else b end else substr(b, 1, 60) end as b
from s""")
def pair_truncate(spark, sf):
    a, b = sequences.truncate_pair(F.col("a"), F.col("b"), 120)
    return pairs_of(spark, sf).select("conv_id", "turn", a.alias("a"), b.alias("b"))


@query(f"with {SEQS} select doc_id, {_DNA} as dna from seqs")
def aa_to_dna(spark, sf):
    return sequences_of(spark, sf).select("doc_id", sequences.amino_acids_to_dna(F.col("seq")).alias("dna"))


@query(f"with {SEQS} select doc_id, translate({_DNA}, 'T', 'U') as rna from seqs")
def aa_to_rna(spark, sf):
    return sequences_of(spark, sf).select("doc_id", sequences.amino_acids_to_rna(F.col("seq")).alias("rna"))


def _dna_of(spark, sf):
    """Letters mapped onto A, C, G, T and cut to whole codons: every codon occurs."""
    dna = F.translate("seq", "LAGVSERTIPDKQNFYMHWCXBUOZ*", "ACGTACGTACGTACGTACGTACGTAC")
    whole = F.floor(F.length("seq") / 3).cast("int") * 3
    return sequences_of(spark, sf).select("doc_id", F.substring(dna, F.lit(1), whole).alias("dna"))


_DNAS = f"""dnas as (select doc_id, substr(translate(seq, 'LAGVSERTIPDKQNFYMHWCXBUOZ*', 'ACGTACGTACGTACGTACGTACGTAC'), 1, (length(seq) // 3) * 3) as dna
  from (select doc_id, {SEQ_SQL} as seq from documents))"""


@query(f"with {_DNAS} select doc_id, case when dna = '' then '' else {_AA} end as aa from dnas")
def dna_to_aa(spark, sf):
    return _dna_of(spark, sf).select("doc_id", sequences.dna_to_amino_acids(F.col("dna")).alias("aa"))


@query(f"with {_DNAS} select doc_id, case when dna = '' then '' else {_AA} end as aa from dnas")
def rna_to_aa(spark, sf):
    return _dna_of(spark, sf).select("doc_id", sequences.rna_to_amino_acids(F.translate("dna", "T", "U")).alias("aa"))


_TOK, _TOK_AA = sequences.CODON_TOKENS, sequences.TOKEN_AMINO_ACIDS
_TOK_KEYS = "[" + ", ".join(f"'{t}'" for t in _TOK) + "]"
_TOK_VALUES = "[" + ", ".join(f"'{a}'" for a in _TOK_AA) + "]"


@query(f"""select doc_id, array_to_string(list_transform(string_split(t, ''), lambda c:
  case when list_contains({_TOK_KEYS}, c) then nullif({_TOK_VALUES}[list_position({_TOK_KEYS}, c)], '*') else c end), '') as aa
from (select doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') as t from documents)""")
def codon_to_aa(spark, sf):
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    return table(spark, sf, "documents").select("doc_id", sequences.codon_tokens_to_amino_acids(t).alias("aa"))


@query(f"""with {SEQS} select doc_id, translate(seq, '{sequences.AMINO_ACIDS}XBUOZ*', '{sequences.AMINO_ACID_TOKENS}AAAAAA') as codons from seqs""")
def aa_to_codon(spark, sf):
    return sequences_of(spark, sf).select("doc_id", sequences.amino_acids_to_codon_tokens(F.col("seq")).alias("codons"))


# Mutations: three substitutions written from a row's own numbers.
_MUT = """muts as (select l_orderkey * 10 + l_linenumber as id,
  substr('ACDEFGHIKLMNPQRSTVWY', (l_partkey % 20)::int + 1, 1) || (l_suppkey % 90 + 1) || substr('ACDEFGHIKLMNPQRSTVWY', (l_orderkey % 20)::int + 1, 1)
  || case when l_linenumber >= 2 then ':A' || (l_partkey % 90 + 1) || 'C' else '' end
  || case when l_linenumber >= 3 then repeat(':G' || (l_linenumber + 3) || 'W', l_linenumber - 2) else '' end
  || case when l_linenumber = 4 then ':bad' else '' end as mutant from lineitem)"""


def mutants_of(spark, sf):
    letter = lambda c: F.expr(f"substring('ACDEFGHIKLMNPQRSTVWY', int({c} % 20) + 1, 1)")
    n = F.col("l_linenumber")
    m = F.concat(
        letter("l_partkey"), (F.col("l_suppkey") % 90 + 1).cast("string"), letter("l_orderkey"),
        F.when(n >= 2, F.concat(F.lit(":A"), (F.col("l_partkey") % 90 + 1).cast("string"), F.lit("C"))).otherwise(""),
        F.when(n >= 3, F.expr("repeat(concat(':G', l_linenumber + 3, 'W'), l_linenumber - 2)")).otherwise(""),
        F.when(n == 4, ":bad").otherwise(""),
    )
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("id"), m.alias("mutant"))


@query(f"""with {_MUT}, parts as (
  select id, list_transform(list_filter(string_split(mutant, ':'), lambda p: regexp_matches(p, '^([A-Z])([0-9]+)([A-Z])')),
    lambda p: {{'wt': substr(p, 1, 1), 'pos': regexp_extract(p, '^([A-Z])([0-9]+)([A-Z])', 2)::bigint - 1}}) as m from muts)
select id, len(m)::bigint as n_muts, coalesce(list_sum(list_transform(m, lambda x: x.pos)), 0)::bigint as sum_pos,
  array_to_string(list_sort(list_transform(m, lambda x: x.wt)), '') as wts from parts""")
def mutation_parse(spark, sf):
    m = mutants_of(spark, sf).withColumn("m", sequences.parse_mutations(F.col("mutant")))
    return m.select(
        "id", F.size("m").cast("long").alias("n_muts"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["pos"]).alias("sum_pos"),
        F.array_join(F.array_sort(F.transform("m", lambda x: x["wt"])), "").alias("wts"),
    )


@query(f"""with {_MUT} select case when len(string_split(mutant, ':')) >= 5 then '5+' else len(string_split(mutant, ':'))::varchar end as depth, count(*) as n_rows
from muts group by all""")
def mutation_depth(spark, sf):
    d = sequences.depth_bucket(sequences.mutation_depth(F.col("mutant")))
    return mutants_of(spark, sf).groupBy(d.alias("depth")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("""with n as (select n_nationkey as k, rpad(n_name, 16, '.') as s from nation)
select a.k as a, b.k as b, list_filter(range(0, 16), lambda i: substr(a.s, i + 1, 1) <> substr(b.s, i + 1, 1))::int[] as positions
from n a join n b on a.k < b.k""")
def hamming_positions(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), F.rpad("n_name", 16, ".").alias("sa"))
    m = n.select(F.col("a").alias("b"), F.col("sa").alias("sb"))
    return n.join(m, F.col("a") < F.col("b")).select("a", "b", sequences.hamming_positions(F.col("sa"), F.col("sb")).alias("positions"))


@query("""select n_nationkey, array_to_string(list_transform(string_split(n_name, ''), lambda c, i: case when (i - 1) % 3 = 0 then '<mask>' else c end), '') as masked from nation""")
def mask_positions(spark, sf):
    every = F.expr("sequence(0, length(n_name), 3)")
    return table(spark, sf, "nation").select("n_nationkey", sequences.mask_positions(F.col("n_name"), every).alias("masked"))


_ALPHA = sequences.PROTEIN_ALPHABET


@query(f"""with {SEQS} select doc_id,
  list_concat([{len(_ALPHA) + 1}], list_transform(string_split(seq, ''), lambda c: strpos('{_ALPHA}', c)::int), [{len(_ALPHA) + 2}],
    list_resize([]::int[], greatest(0, 64 - length(seq) - 2), 0))::int[] as ids from seqs""")
def tokenize(spark, sf):
    return sequences_of(spark, sf).select("doc_id", sequences.tokenize(F.col("seq"), _ALPHA, 64).alias("ids"))


@query(f"with {SEQS} select doc_id, seq from seqs")
def detokenize(spark, sf):
    ids = sequences.tokenize(F.col("seq"), _ALPHA, 64)
    return sequences_of(spark, sf).select("doc_id", sequences.detokenize(ids, _ALPHA).alias("seq"))


@query("with " + SEQS + " select doc_id, " + ", ".join(f"length(seq) - length(replace(seq, '{c}', '')) as n_{i}" for i, c in enumerate(_ALPHA)) + " from seqs")
def onehot_counts(spark, sf):
    return sequences_of(spark, sf).select("doc_id", *[c.cast("long") for c in sequences.symbol_counts(F.col("seq"), _ALPHA)])


@query("""select n_nationkey, list_transform(string_split(n_name, ''), lambda c:
  [(c = 'A')::int, (c = 'C')::int, (c = 'E')::int, (c not in ('A', 'C', 'E'))::int]) as rows from nation""")
def onehot_matrix(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", sequences.one_hot(F.col("n_name"), "ACE").alias("rows"))


_TEXTS = """texts as (select l_orderkey * 10 + l_linenumber as id, case l_linenumber % 6
  when 0 then '' || l_partkey when 1 then l_partkey || '.25' when 2 then l_partkey || '.5±0.2' when 3 then l_partkey || '.5Â±0.3'
  when 4 then l_partkey || '.0+/-0.4' else 'not-a-number' end as t from lineitem)"""


@query(f"""with {_TEXTS} select id, try_cast(trim(regexp_split_to_array(t, 'Â±|±|\\+/-')[1]) as double) as value from texts""")
def metric_string_parse(spark, sf):
    n, p = F.col("l_linenumber") % 6, F.col("l_partkey").cast("string")
    t = (
        F.when(n == 0, p).when(n == 1, F.concat(p, F.lit(".25"))).when(n == 2, F.concat(p, F.lit(".5±0.2")))
        .when(n == 3, F.concat(p, F.lit(".5Â±0.3"))).when(n == 4, F.concat(p, F.lit(".0+/-0.4"))).otherwise("not-a-number")
    )
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), numeric.parse_metric(t).alias("value"))


@query(f"""with u as (select doc_id, unnest(string_split({UPPER_SQL}, '')) as c from documents where text <> '')
select doc_id, array_to_string(list_sort(list_distinct(list_filter(list(c), lambda x: not contains('ABCDEFGHIJKLMNOPQRSTUVWXYZ ', x)))), '') as bad from u group by doc_id""")
def bad_chars(spark, sf):
    d = table(spark, sf, "documents").where("text <> ''")
    return d.select("doc_id", F.array_join(sequences.bad_symbols(upper_text(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ "), "").alias("bad"))


@query("select n_nationkey, upper(substr(lower(n_name), 1, 1)) || substr(lower(n_name), 2) as name from nation")
def capitalize_first(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", sequences.capitalize_first(F.lower("n_name")).alias("name"))


@query("""with p as (select r.r_regionkey, string_agg(n_name, ',' order by n_name) as t from nation join region r on n_regionkey = r_regionkey group by all),
s as (select r_regionkey, unnest(string_split(t, ',')) as part, unnest(range(0, len(string_split(t, ',')))) as seq_index from p),
o as (select *, sum(length(part)) over (partition by r_regionkey order by seq_index) - length(part) as before from s)
select r_regionkey, seq_index::int as seq_index, pos::int as pos, (before + pos)::int as global_pos from (
  select *, unnest(range(0, length(part))) as pos from o)""")
def multi_positions(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    t = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("t"))
    return t.select("r_regionkey", F.explode(sequences.multi_sequence_positions(F.col("t"))).alias("p")).select("r_regionkey", "p.*")


# --- cleaning ---


@query("""select doc_id, text, quality from documents left join labels using (doc_id) where text is not null and quality is not null""")
def drop_missing(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "text", "quality")
    return cleaning.drop_missing(d, ["text", "quality"])


@query("""select doc_id, regexp_replace(coalesce(text, ''), '[^LAGVSERTIPDKQNFYMHWCXBUOZ*]', '', 'g') as seq from documents
where regexp_replace(coalesce(text, ''), '[^LAGVSERTIPDKQNFYMHWCXBUOZ*]', '', 'g') <> ''""")
def drop_empty(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", sequences.sanitize(F.coalesce("text", F.lit(""))).alias("seq"))
    return cleaning.drop_empty(d, ["seq"])


@query(f"with {_PAIRS} select conv_id, turn, length(a) + length(b) as n from pairs where length(a) + length(b) <= 400")
def length_trim(spark, sf):
    kept = cleaning.drop_long(pairs_of(spark, sf), ["a", "b"], 400)
    return kept.select("conv_id", "turn", (F.length("a") + F.length("b")).cast("long").alias("n"))


@query(f"""with {SEQS}, j as (select d.lang, seq from seqs join documents d using (doc_id))
select lang, count(*) as n_rows, count(*) filter (where not (length(seq) <= 2048)) as n_dropped,
  round(100.0 * (count(*) filter (where not (length(seq) <= 2048))) / count(*), 6) as pct_dropped from j group by lang""")
def drop_report(spark, sf):
    d = table(spark, sf, "documents").select("lang", sequences.sanitize(upper_text()).alias("seq"))
    return cleaning.drop_report(d, F.length("seq") <= 2048, "lang")


@query("""with s as (select doc_id, case when (doc_id * 7919 + 3 * 104729) % 1009 % 10 < 1 then 'valid'
  when (doc_id * 7919 + 3 * 104729) % 1009 % 10 < 2 then 'test' else 'train' end as split from documents)
select split, count(*) as n_rows, sum(doc_id)::bigint as ids from s group by split""")
def split_assign(spark, sf):
    s = cleaning.assign_splits(table(spark, sf, "documents").select("doc_id"), "doc_id", 3)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("doc_id").alias("ids"))


@query("""select role, case lower(role) when 'user' then 'train' when 'assistant' then 'valid' else null end as split, count(*) as n from conversations group by all""")
def split_alias(spark, sf):
    name = F.when(F.lower("role") == "user", "TRAIN").when(F.lower("role") == "assistant", "Validation")
    c = table(spark, sf, "conversations").select("role", cleaning.canonical_split(name).alias("split"))
    return c.groupBy("role", "split").agg(F.count(F.lit(1)).alias("n"))


@query("""select count(*) as n, 'singlelabel' as label_type, (max(quality) + 1)::bigint as num_labels, min(quality)::double as min_label,
  max(quality)::double as max_label, false as sigmoid_range from labels""")
def label_profile(spark, sf):
    return cleaning.label_profile(table(spark, sf, "labels"), "quality")


@query("""select count(*) as n, 'regression' as label_type, 1::bigint as num_labels, round(min(l_discount * 9.9), 6) as min_label, round(max(l_discount * 9.9), 6) as max_label,
  (min(l_discount * 9.9) > -1e-6 and max(l_discount * 9.9) < 1 + 1e-6 and max(l_discount * 9.9) - min(l_discount * 9.9) > 0.75
    and count(distinct len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::double[], lambda e: e <= l_discount * 9.9))) >= 7) as sigmoid_range from lineitem""")
def label_profile_regression(spark, sf):
    return cleaning.label_profile(table(spark, sf, "lineitem").select((F.col("l_discount") * 9.9).alias("y")), "y")


@query("""select doc_id, [(quality = 0)::int, (quality = 1)::int, (toxic = 1)::int] as hot from labels""")
def multi_hot(spark, sf):
    idx = F.filter(F.array(F.col("quality"), F.when(F.col("toxic") == 1, F.lit(2))), lambda x: x.isNotNull())
    return table(spark, sf, "labels").select("doc_id", numeric.multi_hot(idx, 3).alias("hot"))


@query(f"""with {_PAIRS}, u as (select a as seq from pairs union select b from pairs) select seq, length(seq)::int as seq_len from u""")
def sequence_universe(spark, sf):
    return cleaning.sequence_universe(pairs_of(spark, sf), ["a", "b"])


@query("""select tag, (row_number() over (order by tag) - 1)::int as id from (select distinct event_type as tag from events)""")
def tag_map(spark, sf):
    return cleaning.tag_map(table(spark, sf, "events").select(F.array("event_type").alias("t")), "t")


@query(f"""with {SEQS}, j as (select seq, quality from seqs join labels using (doc_id)),
c as (select substr(seq, 1, 2048) as seqs, quality as labels from j where seq <> '' and quality is not null)
select labels, count(*) as n_rows, count(distinct seqs) as n_seqs, sum(length(seqs))::bigint as n_symbols from c group by labels""")
def prepared_labels(spark, sf):
    j = sequences_of(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("seq", F.col("quality").alias("label"))
    p = cleaning.prepare(j)
    return p.groupBy("labels").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("seqs").alias("n_seqs"), F.sum(F.length("seqs")).alias("n_symbols"))
