"""DuckDB SQL that states the registered queries."""

from __future__ import annotations

from tessera.functions.text import FOLDS, WEB
from tessera.functions.indices import ALIASES, FULL
from tessera.operators.lexicon import ENGLISH_STOPWORDS, PLURALS, STOPWORDS
from tessera.operators.network import ACADEMIC_NOISE, HARD_NOISE

#: Forms of the indices over all pairs of a vocabulary.
DENSE_FORMS = 5000
_LATIN = "a-zA-ZÀ-ÿ"


def _runs(text: str = "text", whole: str = f"[{_LATIN}]{{3,}}") -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '{whole}'))"


def _tok(whole: str = f"[{_LATIN}]{{3,}}") -> str:
    return f"tok as (select doc_id, unnest(w) as form, unnest(range(len(w))) as pos from (select doc_id, {_runs(whole=whole)} as w from documents))"


#: Tokens of concordances.
_KWIC = "regexp_extract_all(text, '\\p{L}[\\p{L}\\p{M}\\p{N}]*(?:[''’_\\-][\\p{L}\\p{M}\\p{N}]+)*')"
_WITH_LETTER = ".*\\p{L}.*"
TOK = _tok()
FORMS = "forms as (select form, count(*) as freq, count(distinct doc_id) as doc_freq from tok group by form)"
DTM = "dtm as (select doc_id, form, count(*) as n from tok group by 1, 2)"
META = """meta as (
  select doc_id, lower(split_part(b, '_', 1)) as variable, arg_max(substr(b, strpos(b, '_') + 1), i) as value from (
    select doc_id, regexp_replace(t, '^\\*+', '') as b, i from (
      select doc_id, unnest(ts) as t, unnest(range(len(ts))) as i from (select doc_id, string_split_regex(trim(etoiles), '\\s+') as ts from documents))
    where regexp_full_match(t, '\\*+[^*_]+_.+')) group by 1, 2)"""
LOC = "loc as (select doc_id, value as grp from meta where variable = 'loc')"
LANG = "langs as (select doc_id, substr(lower(lang), 1, 2) as grp from documents where lang is not null)"
UNITS = "units as (select distinct uce_id, form from postings where uce_id is not null and trim(form) <> '')"


def _table(groups: str, least: int = 1) -> str:
    return f"""t0 as (select form, grp, sum(n) as n from dtm join {groups} using (doc_id) group by 1, 2),
      t as (select * from t0 where form in (select form from t0 group by form having sum(n) >= {least}))"""


_MARGINS = """m as (select t.*, sum(n) over (partition by form) as k, sum(n) over (partition by grp) as g, sum(n) over () as total from t)"""


def _chi2(n: str = "n", k: str = "k", g: str = "g", total: str = "total") -> str:
    det = f"({n}::double * {total} - {k}::double * {g})"
    den = f"({k}::double * {g}::double * ({total} - {k})::double * ({total} - {g})::double)"
    return f"case when {n}::double * {total} >= {k}::double * {g} then 1 else -1 end * case when {den} = 0 then 0 else {total}::double * {det} * {det} / {den} end"


def _frequent(most: int | None = None, least: int = 3) -> str:
    """Forms with enough occurrences in all segments."""
    limit = f" order by k desc, form limit {most}" if most else ""
    return f"vocab as (select form from (select form, sum(coalesce(n, 0)) as k from postings where uce_id is not null and trim(form) <> '' group by form having sum(coalesce(n, 0)) >= {least}){limit})"


def _vocab(n: int) -> str:
    return f"vocab as (select form from units group by form order by count(*) desc, form limit {n})"


def _pairs(vocab: str) -> str:
    return f"""{UNITS}, {vocab}, u as (select units.* from units join vocab using (form)),
      pairs as (select a.form as term_a, b.form as term_b, count(*) as n from u a join u b on a.uce_id = b.uce_id and a.form < b.form group by 1, 2)"""




def _ratio(a: str, b: str) -> str:
    return f"(case when ({b}) = 0 then 0 else ({a})::double / ({b}) end)"


_DEN = "((a + b) * (c + d) * (a + c) * (b + d))"
_PHI = _ratio("a * d - b * c", f"sqrt({_DEN})")
_EXCESS = "pow(greatest(abs(a * d - b * c) - n / 2, 0), 2)"
_STILES = _ratio(f"n * {_EXCESS}", _DEN)
_INDEX = {
    "cooccurrence": "a", "jaccard": _ratio("a", "a + b + c"), "dice": _ratio("2 * a", "2 * a + b + c"), "ochiai": _ratio("a", "sqrt((a + b) * (a + c))"), "phi": _PHI, "pearson": _PHI,
    "chi2": _ratio("n * pow(a * d - b * c, 2)", _DEN), "russel": _ratio("a", "n"), "kulczynski1": _ratio("a", "b + c"), "kulczynski2": f"({_ratio('a', 'a + b')} + {_ratio('a', 'a + c')}) / 2",
    "mountford": _ratio("2 * a", "a * b + a * c + 2 * b * c"),
    "fager": f"{_ratio('a', 'sqrt((a + b) * (a + c))')} - ({_ratio('1', '2 * sqrt(a + c)')} + {_ratio('1', '2 * sqrt(a + b)')}) / 2",
    "simple_matching": _ratio("a + d", "n"), "hamman": _ratio("(a + d) - (b + c)", "n"), "faith": _ratio("a + d / 2", "n"), "tanimoto": _ratio("a + d", "a + 2 * b + 2 * c + d"),
    "simpson": _ratio("a", "least(a + b, a + c)"), "braun_blanquet": _ratio("a", "greatest(a + b, a + c)"), "mozley": _ratio("a * n", "(a + b) * (a + c)"),
    "stiles": f"case when {_STILES} > 0 then log10({_STILES}) else 0 end", "michael": _ratio("4 * (a * d - b * c)", "pow(a + d, 2) + pow(b + c, 2)"), "yule": _ratio("a * d - b * c", "a * d + b * c"),
    "yule2": _ratio("sqrt(a * d) - sqrt(b * c)", "sqrt(a * d) + sqrt(b * c)"), "phi_squared": f"pow({_PHI}, 2)", "tschuprow": f"abs({_PHI})", "cramer": f"abs({_PHI})", "percentage": _ratio("a", "n"),
}
_MEETING = {"cooccurrence", "jaccard", "dice", "ochiai", "russel", "kulczynski1", "kulczynski2", "mountford", "simpson", "braun_blanquet", "mozley", "percentage"}


def _similitude(name: str) -> str:
    meets = " where a > 0" if name in _MEETING else ""
    return f"""with {_pairs(_frequent(DENSE_FORMS if ALIASES[name] in FULL else None))}, k as (select form, count(*) as k from u group by form), t as (select count(distinct uce_id) as n from units),
      cells as (select x.form as term_a, y.form as term_b, coalesce(p.n, 0)::double as a, (x.k - coalesce(p.n, 0))::double as b, (y.k - coalesce(p.n, 0))::double as c,
                       (t.n - x.k - y.k + coalesce(p.n, 0))::double as d, t.n::double as n
                from k x join k y on x.form < y.form cross join t left join pairs p on p.term_a = x.form and p.term_b = y.form)
      select term_a, term_b, round({_INDEX[name]}, 8) as value from cells{meets}"""


_FROM, _TO = "".join(FOLDS.values()), "".join(k * len(v) for k, v in FOLDS.items())
_FOLD = "regexp_replace(translate(lower({0}), '%s', '%s'), '\\p{{M}}+', '', 'g')" % (_FROM, _TO)


def _fold(x: str) -> str:
    return _FOLD.format(x)


def _squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{0b}}]+', ' ', 'g'), ' ')"


_NO_GRAM = ", ".join(f"'{w}'" for w in [*STOPWORDS, *ENGLISH_STOPWORDS])


def _top_grams(n: int) -> str:
    cols = ", ".join(f"w{k}" for k in range(1, n + 1))
    return f"{_grams(n)}, top as (select * from gc order by freq desc, {cols} limit 120)"


def _grams(n: int, least: int = 2) -> str:
    parts = ", ".join(f"w[i + {k}] as w{k}" for k in range(1, n + 1))
    cols = ", ".join(f"w{k}" for k in range(1, n + 1))
    return f"""grams as (select doc_id, {parts} from (select doc_id, w, unnest(range(greatest(len(w) - {n - 1}, 0))) as i from (select doc_id, list_filter({_runs()}, lambda w: w not in ({_NO_GRAM})) as w from documents))),
      gc as (select {cols}, count(*) as freq, count(distinct doc_id) as doc_count from grams group by {cols} having count(*) >= {least})"""


_EVERY = "vocab as (select distinct form from units)"
_EDGES = _pairs(_frequent())


def _ppmi(vocab: str) -> str:
    return f"""with {_pairs(vocab)}, b as (select term_a as t, n from pairs union all select term_b, n from pairs), r as (select t, sum(n)::double as row from b group by t),
      s as (select sum(row) as total, sum(pow(row, 0.75)) as smooth from r), v as (select term_a, term_b, n, greatest(0, log2(n / total / (x.row / total * (pow(y.row, 0.75) / smooth)))) as ppmi
      from pairs join r x on x.t = term_a join r y on y.t = term_b cross join s) select term_a, term_b, n, round(ppmi, 6) as ppmi from v"""


def _pagerank(rounds: int) -> str:
    """The rounds written out."""
    steps = ["r0 as (select node, 1.0::double / (select count(*) from nodes) as rank from nodes)"]
    steps += [f"r{k + 1} as materialized (select node, 0.15 / (select count(*) from nodes) + 0.85 * coalesce(sum(rank * p), 0) as rank from nodes left join (select dst, rank, p from shares join r{k} on r{k}.node = src) on dst = node group by node)" for k in range(rounds)]
    return f"""with {_EDGES}, o as (select term_a as src, term_b as dst, n::double as w from pairs union all select term_b, term_a, n from pairs), nodes as (select distinct src as node from o),
      z as (select src, sum(w) as total from o group by src), shares as materialized (select o.src, dst, w / total as p from o join z on z.src = o.src), {", ".join(steps)} select node, rank from r{rounds}"""


def _hypergeometric(n: str, row: str, col: str, total: str, source: str) -> str:
    """-log10 of the tail beyond a count, signed, added to the rows of ``source`` as ``score``."""
    choose = lambda a, b: f"(lgamma({a} + 1) - case when {b} = 0 then 0 else lgamma({b} + 1) end - case when {a} = {b} then 0 else lgamma({a} - {b} + 1) end)"
    log = f"{choose('col', 'x')} + {choose('(total - col)', '(row - x)')} - {choose('total', 'row')}"
    return f"""h0 as (select *, {n}::bigint as k, {row}::bigint as row, {col}::bigint as col, {total}::bigint as total from {source}), h1 as (select *, k * total >= row * col as up, row_number() over () as id from h0),
      hx as (select id, row, col, total, unnest(case when up then range(k, least(row, col) + 1) else range(greatest(0, row + col - total), k + 1) end) as x from h1), hl as (select id, {log} as l from hx),
      hm as (select id, max(l) as top from hl group by id), hp as (select hl.id, least(1, greatest(1e-300, exp(any_value(top)) * sum(exp(l - top)))) as p from hl join hm using (id) group by hl.id),
      hs as (select h1.*, case when up then -log10(p) else log10(p) end as score from h1 join hp using (id))"""


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_STOP = ", ".join(f"('{w}')" for w in STOPWORDS)
_G2 = """2 * (case when n_a > 0 then n_a * ln(n_a / (sa * (n_a + n_b) / (sa + sb))) else 0 end + case when n_b > 0 then n_b * ln(n_b / (sb * (n_a + n_b) / (sa + sb))) else 0 end)"""
_KEYNESS = f"""with {TOK}, {DTM}, {META}, {LOC}, c as (
  select form, sum(case when grp = 'campo' then n else 0 end)::double as n_a, sum(case when grp = 'campo' then 0 else n end)::double as n_b
  from (select form, n, (select 'campo' from loc where loc.doc_id = dtm.doc_id and loc.grp = 'campo') as grp from dtm) group by form),
  c2 as (select form, coalesce(n_a, 0) as n_a, coalesce(n_b, 0) as n_b from c where n_a + n_b >= 3), z as (select *, sum(n_a) over () as sa, sum(n_b) over () as sb from c2)"""
_KEYNESS = _KEYNESS.replace("case when grp = 'campo' then 0 else n end", "case when grp is null then n else 0 end")


def _keyness(score: str) -> str:
    return f"""{_KEYNESS}, s as (select *, {score} as score from z)
      select form, n_a::bigint as n_a, n_b::bigint as n_b, score, case when score >= 0 then 'A' else 'B' end as direction, n_a * 1e6 / sa as norm_a, n_b * 1e6 / sb as norm_b from s"""


_CROSS = """c as (select coalesce(nullif(trim(l_returnflag), ''), '(vazio)') as r, coalesce(nullif(trim(l_linestatus), ''), '(vazio)') as k, count(*) as n from lineitem group by 1, 2),
  rs as (select r, sum(n) as rn from c group by r), ks as (select k, sum(n) as kn from c group by k), t as (select sum(n) as t from c),
  f as (select rs.r, ks.k, coalesce(c.n, 0) as n, rn::double * kn / t as e from rs cross join ks cross join t left join c on c.r = rs.r and c.k = ks.k)"""


def _strip_web() -> str:
    x = "text"
    for p in WEB[:-1]:
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    # RE2 has no look-behind: the character before a mention is kept by a group
    return _squash(f"regexp_replace({x}, '(^|[^\\w])@\\w+', '\\1 ', 'g')")


#: Columns of floating numbers by query; both sides round them to six digits.
FLOATS = {
    "corpus_statistics": ("mean_tokens", "richness"), "dtm_stats": ("sparsity", "mean_doc_length", "mean_term_freq"), "postings_stats": ("sparsity", "mean_doc_length", "mean_term_freq"),
    "specificity_chi2_loc": ("score", "per_thousand"), "specificity_top_loc": ("score",), "chronological_specificity": ("score",), "metadata_profile_chi2": ("score",), "keyness_g2": ("score", "norm_a", "norm_b"),
    "keyness_chi2": ("score", "norm_a", "norm_b"), "matrix_frequency": ("percent",), "matrix_chi2": ("chi2",), "matrix_chi2_cells": ("expected", "residual"), "matrix_similarity": ("value",),
    "partition_agreement": ("ari", "nmi"), "dispersion_juilland": ("juilland_d",), "specificity_hypergeo_loc": ("score", "per_thousand"), "keyness_exact": ("score", "norm_a", "norm_b"), "rolling_ratio": ("value",), "pagerank": ("rank",), "text_network": ("weight",), "mst_weight": ("weight",), "ca_inertia": ("inertia",), "repeated_segments": ("chi2",), "xray": ("rel_pos",), "voyant_trends": ("per_thousand",), "evocation_rank": ("mean_rank",),
    "ppmi_pairs": ("ppmi",), "labbe_distance": ("distance",), "degree_centrality": ("strength",), "graph_summary": ("density", "mean_degree"), "segment_class_profiles": ("chi2",),
    "sentiment_distribution": ("percent",), "emotion_totals": ("percent",), "crossed_classifications": ("chi2",), "candidate_concepts": ("dispersion", "dominance", "noise", "score"),
    "multiword_candidates": ("score", "norm"), "stream_event_counts": ("value",),
}


#: Decimals of floating results, where engines agree to fewer than six: sums of many logarithms of factorials.
DECIMALS = {"specificity_hypergeo_loc": 3, "keyness_exact": 3}


def _rounded(sql: str, columns: tuple[str, ...], digits: int) -> str:
    return f"select * replace ({', '.join(f'round({c}::double, {digits}) + 0.0 as {c}' for c in columns)}) from ({sql})"


def _strip_web_of(x: str) -> str:
    return _strip_web().replace("text", x)


def _strict() -> str:
    t = "replace(replace(lower(text), '’', chr(39)), 'œ', 'oe')"
    t = f"replace(replace({t}, '...', ' £$£ '), '…', ' £$£ ')"
    t = f"regexp_replace(regexp_replace({t}, '([?.!,;:])', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\s\\x{{0b}}''\\-.?!,;:$£_]', ' ', 'g')"
    return _squash(f"regexp_replace({_squash(t)}, '[''\\-]', ' ', 'g')")


def _layout() -> str:
    """What the engine can't look behind is replaced twice, as neighbours share a character."""
    t = "replace(text, chr(13) || chr(10), chr(10))"
    for _ in range(2):
        t = f"regexp_replace({t}, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: {_squash('x')}), lambda x: not regexp_full_match(x, '(?:(?:[Pp][AaáÁ][Gg](?:[Ii][Nn][Aa])?\\.?\\s*)?\\d+(?:\\s*/\\s*\\d+)?|[^a-zA-Z0-9]{{1,3}})'))"
    t = f"array_to_string({lines}, chr(10))"
    for _ in range(2):
        t = f"regexp_replace({t}, '([^\\n])\\n([^\\n])', '\\1 \\2', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '([^\\n])\\n$', '\\1 '), '^\\n([^\\n])', ' \\1')"
    return f"trim(regexp_replace({t}, '\\n{{2,}}', chr(10) || chr(10), 'g'), ' ')"


def _cleaned() -> str:
    t = f"regexp_replace(regexp_replace({_strip_web_of('x')}, '[\\^|<>{{}}\\[\\]*\"“”«»]', ' ', 'g'), '\\p{{N}}+', ' ', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '(\\p{{L}})-(\\p{{L}})', '\\1_\\2', 'g')"
    return f"array_to_string(list_transform(string_split(text, chr(10)), lambda x: case when starts_with(x, '****') then trim(x, ' ') else {_squash(f'lower({t})')} end), chr(10))"


#: Documents of texts in the tagged format: lines, each in the part that the last header above it opens; blank parts are none.
_PARSED = """n0 as (select doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') as t from documents),
  n1 as (select doc_id, case when starts_with(t, '****') or trim(t, ' ') = '' then t else '**** *doc_1' || chr(10) || t end as t from n0),
  n2 as (select doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as pos from n1),
  n3 as (select *, sum(case when starts_with(line, '****') then 1 else 0 end) over (partition by doc_id order by pos) as part from n2),
  n4 as (select doc_id, part, first(line order by pos) as header, string_agg(line, chr(10) order by pos) as whole,
           regexp_replace(coalesce(string_agg(line, chr(10) order by pos) filter (pos > start and not regexp_matches(line, '^ *-\\*')), ''), '^[\\s\\x{0b}]+|[\\s\\x{0b}]+$', '', 'g') as text,
           count(*) filter (regexp_matches(line, '^ *-\\*')) as themes from (select *, min(pos) over (partition by doc_id, part) as start from n3) group by 1, 2),
  parsed as (select doc_id, (row_number() over (partition by doc_id order by part) - 1)::int as doc_no, trim(header, ' ') as header, text, themes::int as themes from n4 where trim(whole, ' ') <> '')"""

_LEXICON = "l(pos, word, lemma, gram) as (values (0, 'jórado', 'jórado', 'nom'), (1, 'canção', 'canção', 'nom'), (2, 'lhabista', 'lhabisto', 'adj'), (3, 'não', 'não', 'adv'), (4, 'que', 'que', 'pro'))"
_TRIES = " ".join(f"union all select form, {k + 2} as try, 'w' as how, substr(form, 1, length(form) - {len(a)}) || '{b}' as key from forms where form like '%{a}'" for k, (a, b) in enumerate(PLURALS))


def oracle_sql() -> dict[str, str]:
    sql = {
        "corpus_statistics": f"""with {TOK}, {FORMS}, c as (select count(*) as n_forms, coalesce(sum(freq), 0)::bigint as n_occurrences, count(*) filter (freq = 1) as n_hapax from forms),
            d as (select count(*) as n_docs from documents)
            select n_docs, n_forms, n_occurrences, n_hapax, n_occurrences / n_docs as mean_tokens, n_hapax / n_forms as richness from c cross join d""",
        "word_freq_top": f"with {TOK}, {FORMS} select form, freq, doc_freq from forms order by freq desc, form limit 100",
        "first_occurrences": f"with {TOK}, f as (select form, min((doc_id, pos)) as x from tok group by form) select form, x[1] as doc_id, x[2] as pos from f".replace("min((doc_id, pos)) as x", "min(struct_pack(a := doc_id, b := pos)) as x").replace("x[1]", "x.a").replace("x[2]", "x.b"),
        "freq_of_freq": f"with {TOK}, {FORMS} select freq, count(*) as n_forms from forms group by freq",
        "hapax_by_lang": f"with {TOK}, {DTM}, {LANG}, {_table('langs')} select grp, count(*) as hapaxes from t where n = 1 group by grp",
        "doc_sizes": f"select doc_id, coalesce(len({_runs(whole=f'[{_LATIN}]+')}), 0) as n_tokens from documents",
        "dtm_stats": f"""with {TOK}, {DTM}, c as (select count(distinct doc_id) as n_docs, count(distinct form) as n_terms, count(*) as nnz, sum(n)::bigint as total from dtm)
            select *, 1 - nnz / (n_docs * n_terms) as sparsity, total / n_docs as mean_doc_length, total / n_terms as mean_term_freq from c""",
        "postings_stats": """with p as (select uce_id, form, sum(coalesce(n, 0)) as n from postings where uce_id is not null and form is not null group by 1, 2),
            c as (select count(distinct uce_id) as n_docs, count(distinct form) as n_terms, count(*) as nnz, sum(n)::bigint as total from p)
            select *, 1 - nnz / (n_docs * n_terms) as sparsity, total / n_docs as mean_doc_length, total / n_terms as mean_term_freq from c""",
        "doc_meta": f"with {META} select * from meta",
        "subcorpus_freq": f"""with {TOK}, {META}, x as (select * from tok where doc_id in (select doc_id from meta where variable = 'loc' and value in ('campo', 'litoral')))
            select form, count(*) as freq, count(distinct doc_id) as doc_freq from x group by form order by freq desc, form limit 200""",
        "subcorpus_ids": f"with {META} select doc_id, row_number() over (order by doc_id) - 1 as uci_id from documents where doc_id in (select doc_id from meta where variable = 'sexo' and value = 'f')",
        "tie_cut_vocab": f"""with {TOK}, {FORMS}, f as (select * from forms where freq >= 3), r as (select freq, row_number() over (order by freq desc) as k from f), t as (select freq as t from r where k = 300),
            x as (select t, (select count(*) from f where freq = t) as ties, (select count(*) from f where freq = t + 1) as above from t)
            select f.* from f where (select count(*) from f) <= 300 or freq > (select case when ties > 1 and above > 0 then t + 1 else t end from x)""",
        "dropped_forms": f"""with {_tok(f'[{_LATIN}]+')}, {FORMS}, stop(form) as (values {_STOP}), r as (select form, case when length(form) < 2 then 'invalid_token' when freq < 3 then 'below_min_freq'
            when form in (select form from stop) then 'stopword' end as reason from forms) select * from r where reason is not null""",
        "tokenizer_counts": "select " + ", ".join(f"coalesce(sum(len({_runs(whole=w)})), 0)::bigint as {n}" for n, w in (("alpha", f"[{_LATIN}]+"), ("alpha2", f"[{_LATIN}]{{2,}}"), ("alpha3", f"[{_LATIN}]{{3,}}"), ("compound", f"[{_LATIN}]+(?:_[{_LATIN}]+)*"), ("word", _WITH_LETTER), ("sent", ".{2,}"))) + " from documents",
        "folded_forms": f"with {TOK} select distinct form, {_fold('form')} as folded from tok",
        "web_free_texts": f"select doc_id, {_strip_web()} as clean from documents",
        "strict_texts": f"select doc_id, translate({_strict()}, 'ς', 'σ') as clean from documents",
        "layout_texts": f"select doc_id, {_layout()} as clean from documents",
        "corpus_cleaned": f"select doc_id, translate({_cleaned()}, 'ς', 'σ') as clean from documents",
        "transcript_speakers": """with s as (select distinct doc_id, unnest(regexp_extract_all(text, '(?m)^(?:\\[[\\d:]+\\]\\s*)?(\\p{Lu}[\\p{L}\\d()]{0,24}):\\s', 1)) as speaker from documents)
            select speaker, count(*) as documents from s group by speaker""",
        "parsed_documents": f"with {_PARSED} select doc_id, doc_no, header, length(text) as chars, themes from parsed",
        "corpus_issues": f"""with {_PARSED}, w as (select *, list_filter(string_split_regex(header, '\\s+'), lambda t: t <> '****' and not regexp_matches(t, '^\\*[^*_\\s]+_\\S+$')) as bad from parsed),
            c as (select doc_id, count(*) as documents, count(*) filter (text = '') as empty_documents, sum(len(bad))::bigint as bad_tokens, count(*) filter (regexp_matches(text, 'Ã[\\x{{80}}-¿]|�')) as garbled_documents,
              (max(length(text)) >= 10 * avg(length(text)))::bigint as unequal_documents from w group by doc_id),
            d as (select c.*, len(regexp_extract_all(text, '(?m)^(\\*{{1,3}}|\\*{{5,}})\\s'))::bigint as bad_markers from c join documents using (doc_id))
            select doc_id, what, n from (unpivot d on documents, empty_documents, bad_tokens, garbled_documents, unequal_documents, bad_markers into name what value n) where n > 0""",
        "lexicon_lookup": f"""with {TOK}, {FORMS}, {_LEXICON}, t as (select form, 0 as try, 'w' as how, form as key from forms union all select form, 1, 'f', {_fold('form')} from forms {_TRIES}),
            f as (select {_fold('word')} as key, arg_min(struct_pack(lemma := lemma, gram := gram), pos) as r from l group by 1),
            w as (select 'w' as how, word as key, lemma, gram from l union all select 'f', key, r.lemma, r.gram from f), h as (select form, arg_min(struct_pack(lemma := lemma, gram := gram), try) as r from t join w using (how, key) group by form)
            select form, freq, coalesce(r.lemma, form) as lemma, g as gram, case when g in ('adv', 'ver', 'adj', 'nom', 'nr') then 1 else 2 end as act
            from (select *, coalesce(r.gram, case when regexp_matches(form, '^\\p{{N}}+$') then 'num' else 'nr' end) as g from forms left join h using (form))""",
        "ca_inertia": f"""with {TOK}, {DTM}, {LANG}, {_table('langs', 5)}, {_MARGINS} select sum(n * n / (k::double * g)) - 1 as inertia from m""",
        "repeated_segments": f"""with w as (select doc_id, {_runs()} as w from documents), x as (select doc_id, unnest(range(2, 6)) as j, w from w), y as (select doc_id, w, j, unnest(range(greatest(len(w) - j + 1, 0))) as i from x),
            {META}, {LOC}, t as (select array_to_string(w[i + 1:i + j], ' ') as form, grp, count(*) as n from y join loc using (doc_id) group by 1, 2), {_MARGINS}, z as (select form, grp, n, {_chi2()} as chi2 from m),
            r as (select *, row_number() over (partition by grp order by chi2 desc, form) as place from z where n >= 3 and chi2 > 0) select grp as class_id, form as gram, n as freq, chi2 from r where place <= 20""",
        "source_slugs": f"select distinct source, substr(regexp_replace(regexp_replace({_fold('source')}, '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) as slug from documents where source is not null",
        "lexical_table_lang": f"with {TOK}, {DTM}, {LANG}, {_table('langs', 3)} select form, grp, n::bigint as n from t",
        "class_presence_profile": f"""with {TOK}, {DTM}, {META}, {LOC}, t as (select form, grp, count(*) as n from dtm join loc using (doc_id) group by 1, 2)
            select * from t where form in (select form from t group by form having sum(n) >= 3)""",
        "specificity_chi2_loc": f"""with {TOK}, {DTM}, {META}, {LOC}, {_table('loc', 3)}, {_MARGINS}, s as (select *, {_chi2()} as score from m)
            select form, grp, n::bigint as n, k::bigint as form_total, score, n * 1000.0 / g as per_thousand, case when score >= 0 then '+' else '-' end as sign from s""",
        "specificity_top_loc": f"""with {TOK}, {DTM}, {META}, {LOC}, {_table('loc', 3)}, {_MARGINS}, s as (select *, {_chi2()} as score from m)
            select form, grp, n::bigint as n, round(score, 6) as score from (select *, row_number() over (partition by grp order by abs(score) desc, form) as p from s) where p <= 200""",
        "chronological_specificity": f"""with {TOK}, {DTM}, years as (select doc_id, year(imported_at) as grp from documents where imported_at is not null), {_table('years', 3)},
            sizes as (select grp, sum(n) as size from t group by grp), z as (select grp, size, sum(size) over (order by grp rows between 1 preceding and current row) as size_span, row_number() over (order by grp) as ord from sizes),
            c as (select form, grp, n, size, size_span, sum(n) over (partition by form order by ord range between 1 preceding and current row) as n_span from t join z using (grp))
            select form, grp, n::bigint as n, n_span::bigint as n_span, {_chi2('n', 'n_span', 'size', 'size_span')} as score from c""",
        "metadata_profile_chi2": f"""with {META}, {LOC}, t as (select variable || '_' || value as form, grp, count(*) as n from meta join loc using (doc_id) where variable in ('sexo', 'idade') group by 1, 2), {_MARGINS},
            s as (select *, {_chi2()} as score from m) select form, grp, n, score, case when score >= 0 then '+' else '-' end as sign from s""",
        "keyness_g2": _keyness(f"case when n_a >= sa * (n_a + n_b) / (sa + sb) then 1 else -1 end * {_G2}"),
        "keyness_chi2": _keyness(_chi2("n_a", "(n_a + n_b)", "sa", "(sa + sb)")),
        "matrix_frequency": "with c as (select trim(o_orderpriority) as value, count(*) as n from orders group by 1 order by n desc, value limit 3) select value, n, n * 100.0 / sum(n) over () as percent from c",
        "matrix_chi2": f"with {_CROSS} select sum(pow(n - e, 2) / e) as chi2, (count(distinct r) - 1) * (count(distinct k) - 1) as dof, max(t.t)::bigint as n from f cross join t",
        "matrix_chi2_cells": f"with {_CROSS} select r as row, k as col, n, e as expected, (n - e) / sqrt(greatest(e, 1e-12)) as residual from f",
        "matrix_similarity": """with c as (select user_id, event_type, count(*)::double as n from events group by 1, 2)
            select a.event_type as col_a, b.event_type as col_b, sum(a.n * b.n) as value from c a join c b on a.user_id = b.user_id and a.event_type < b.event_type group by 1, 2""",
        "partition_agreement": f"""with {META}, c as (select a.value as x, b.value as y, count(*)::double as n from meta a join meta b using (doc_id) where a.variable = 'loc' and b.variable = 'sexo' group by 1, 2),
            xs as (select x, sum(n) as n from c group by x), ys as (select y, sum(n) as n from c group by y), t as (select sum(n) as t from c),
            v as (select (select sum(n * (n - 1) / 2) from c) as b, (select sum(n * (n - 1) / 2) from xs) as px, (select sum(n * (n - 1) / 2) from ys) as py, t,
                         (select sum(c.n / t * ln(c.n * t / (xs.n * ys.n))) from c join xs using (x) join ys using (y), t) as mi, (select -sum(n / t * ln(n / t)) from xs, t) as hx, (select -sum(n / t * ln(n / t)) from ys, t) as hy from t)
            select t::bigint as n, (b - px * py / (t * (t - 1) / 2)) / ((px + py) / 2 - px * py / (t * (t - 1) / 2)) as ari, mi / ((hx + hy) / 2) as nmi from v""",
        "concordance_counts": f"""with {META}, h as (select doc_id, len(regexp_extract_all(text, '(?i)sobre')) as n from documents), j as (select h.n, m.value from h left join (select * from meta where variable = 'loc') m using (doc_id) where h.n > 0)
            select value, sum(n)::bigint as n from j group by value""",
        "dispersion_juilland": f"""with {TOK}, {DTM}, t as (select count(distinct doc_id) as c from documents), s as (select form, sum(n)::bigint as freq, sum(n * n)::double as q, count(*) as docs_with from dtm group by form)
            select form, freq, docs_with, round(case when c > 1 then greatest(0, 1 - sqrt(greatest(q / c - pow(freq / c, 2), 0)) / (freq / c) / sqrt(c - 1)) else 0 end, 4) as juilland_d from s cross join t""",
        "rolling_ratio": f"""with w as (select doc_id, {_KWIC} as w from documents), tok as (select doc_id, unnest(w) as form, unnest(range(len(w))) as pos from w), g as (select form, row_number() over (order by doc_id, pos) - 1 as p from tok),
            t as (select max(p) + 1 as n from g), w2 as (select unnest(range(0, ((select n from t) - 500) // 100 + 1)) as k),
            h as (select p from g where {_fold('form')} = 'sobre') select k * 100 + 250 as center, (select count(*) from h where p >= k * 100 and p < k * 100 + 500) / 500 as value from w2""",
        "xray": f"""with w as (select doc_id, {_runs()} as w from documents), p as (select doc_id, len(w) as n, unnest(w) as form, unnest(range(len(w))) as pos from w)
            select doc_id, case when form = 'sobre' then 'sobre' else 'lh*' end as pattern, (pos + 1) / n as rel_pos from p where form = 'sobre' or form like 'lh%'""",
        "bubblelines": f"""with {TOK}, s as (select doc_id, count(*) as len from tok group by doc_id) select doc_id, form, least(pos * 10 // len, 9)::bigint as bin, count(*) as n
            from tok join s using (doc_id) where form in ('sobre', 'entre', 'com') group by 1, 2, 3""",
        "voyant_trends": f"""with {TOK}, o as (select doc_id, (row_number() over (order by doc_id) - 1) * 10 // (select count(*) from documents) as bin from documents), b as (select form, bin from tok join o using (doc_id)),
            s as (select bin, count(*) as size from b group by bin) select form, bin::bigint as bin, count(*) as n, count(*) * 1000.0 / any_value(size) as per_thousand from b join s using (bin) where form in ('sobre', 'entre', 'com') group by form, bin""",
        "collocates": f"""with {TOK} select b.form, count(*) as n from tok a join tok b on a.doc_id = b.doc_id and abs(a.pos - b.pos) between 1 and 5
            where a.form = 'sobre' and b.form <> 'sobre' group by b.form order by n desc, form limit 50""",
        "evocation_rank": f"""with w as (select list_filter({_runs(whole=f'[{_LATIN}]+')}, lambda x: length(x) > 2) as w from documents), p as (select unnest(w) as form, unnest(range(len(w))) as pos from w)
            select form, count(*) as freq, avg(pos + 1) as mean_rank from p group by form""",
        "bigrams": f"with {_grams(2)} select * from gc",
        "trigrams": f"with {_grams(3)} select * from gc",
        "bigram_network": f"with {_top_grams(2)} select least(w1, w2) as src, greatest(w1, w2) as dst, min(freq) as weight from top where w1 <> w2 group by 1, 2",
        "ngram_union": f"""select w1 || ' ' || w2 as gram, freq from (with {_grams(2)} select * from gc) union all select w1 || ' ' || w2 || ' ' || w3, freq from (with {_top_grams(3)} select * from top)""",
        "trigram_network": f"""with {_top_grams(3)}, e as (select w1 as a, w2 as b, freq from top union all select w2, w3, freq from top)
            select least(a, b) as src, greatest(a, b) as dst, sum(freq)::bigint as weight from e where a <> b group by 1, 2""",
        "cooc_window": f"""with {TOK}, p as (select least(a.form, b.form) as term_a, greatest(a.form, b.form) as term_b, count(*) as n_pairs from tok a join tok b on a.doc_id = b.doc_id and b.pos between a.pos + 1 and a.pos + 5
            where a.form <> b.form group by 1, 2) select term_a, term_b, n_pairs, 2 * n_pairs as n_ref from p""",
        "cooc_presence": f"with {_pairs(_EVERY)} select * from pairs",
        "ppmi_pairs": _ppmi(_vocab(200)) + " order by v.ppmi desc, n desc, term_a, term_b limit 100",
        "ppmi_all": _ppmi(_EVERY),
        "contingency_issues": f"with {_pairs(_frequent())} select count(*) as pairs, 0 as bad_sum, 0 as negative, 0 as bad_order from pairs",
        "cca_concepts": f"""with w as (select doc_id, list_filter(list_transform({_KWIC}, lambda w: {_fold('w')}), lambda w: length(w) > 1) as w from documents), tok as (select doc_id, unnest(w) as form, unnest(range(len(w))) as pos from w), c(form, concept) as (values ('sobre', 'place'), ('entre', 'place'), ('com', 'company'), ('sem', 'company'), ('por', 'cause'), ('para', 'cause')),
            l as (select doc_id, count(*) as len from tok group by doc_id), h as (select doc_id, len, pos, concept from tok join c using (form) join l using (doc_id) where len >= 10),
            s as (select distinct doc_id, concept, unnest(range(greatest(pos - 9, 0), least(pos, len - 10) + 1)) as start from h)
            select a.concept as concept_a, b.concept as concept_b, count(*) as windows from s a join s b on a.doc_id = b.doc_id and a.start = b.start and a.concept < b.concept group by 1, 2""",
        "labbe_distance": f"""with {TOK}, k as (select doc_id, regexp_replace(lower(trim(source)), '[- ]', '_', 'g') as k from documents where source is not null), x as (select k, form, count(*)::double as n from tok join k using (doc_id) group by 1, 2),
            z as (select k, sum(n) as s from x group by k), p as (select a.k as k1, b.k as k2, a.s as n1, b.s as n2, least(1, b.s / a.s) as u1, case when a.s > b.s then 1 else a.s / b.s end as u2 from z a join z b on a.k < b.k),
            f as (select k1, k2, n1, n2, w.form, coalesce(a.n, 0) * u1 as x1, coalesce(b.n, 0) * u2 as x2 from p join (select distinct k as kk, form from x) w on w.kk in (k1, k2) left join x a on a.k = k1 and a.form = w.form left join x b on b.k = k2 and b.form = w.form),
            g as (select distinct * from f), l as (select *, case when n1 > n2 then x1 else x2 end as big, case when n1 > n2 then x2 else x1 end as small from g)
            select k1 as text_1, k2 as text_2, round(sum(case when big > 0 and small > 0 then abs(big - small) when small > 0 then small when big >= 1 then big else 0 end)
                / (any_value(least(n1, n2)) + sum(case when (n1 > n2 and big >= 1) or (n1 <= n2 and big > 1) then big else 0 end)), 8) as distance from l group by 1, 2""",
        "degree_centrality": f"with {_EDGES}, e as (select term_a as node, n from pairs union all select term_b, n from pairs) select node, count(*) as degree, sum(n)::double as strength from e group by node",
        "graph_summary": f"""with {_EDGES}, e as (select term_a as node from pairs union all select term_b from pairs), d as (select count(distinct node) as nodes, count(*) // 2 as edges from e)
            select nodes, edges, 2 * edges / (nodes * (nodes - 1)) as density, 2 * edges / nodes as mean_degree from d""",
        "segment_class_profiles": f"""with {UNITS}, mx as (select max(uce_id) as m from units), cl as (select distinct uce_id, ((uce_id - 1) * 4 // m)::int as class_id from units, mx), p as (select * from units join cl using (uce_id)),
            k as (select form, count(*) as in_all from p group by form having count(*) >= 3), z as (select class_id, count(*) as size from cl group by 1), t as (select count(*) as total from cl),
            c as (select class_id, form, count(*) as freq from p group by 1, 2), s as (select class_id, form, freq, in_all, {_chi2('freq', 'in_all', 'size', 'total')} as chi2 from c join k using (form) join z using (class_id) cross join t)
            select *, case when chi2 >= 0 then '+' else '-' end as sign from s""",
        "sentiment_distribution": f"""with {TOK}, l(form, p) as (values ('sobre', 1), ('entre', -1), ('com', 0), ('para', 1)), c as (select case when p > 0 then 'Positivo' when p < 0 then 'Negativa' else 'Neutro' end as label, count(*) as n from tok join l using (form) group by 1)
            select label, coalesce(n, 0) as n, coalesce(n, 0) * 100.0 / (select sum(n) from c) as percent from (values ('Positivo'), ('Negativa'), ('Neutro')) v(label) left join c using (label)""",
        "emotion_totals": f"""with {TOK}, l(form, emotion, score) as (values ('sobre', 'joy', 1), ('entre', 'fear', 2), ('com', 'positive', 1), ('para', 'negative', 1), ('para', 'joy', 1)), c as (select emotion, sum(score)::bigint as n from tok join l using (form) group by 1)
            select emotion, n, n * 100.0 / sum(n) over (partition by emotion in ('positive', 'negative')) as percent from c""",
        "sentiment_timeline": f"""with {TOK}, l(form, p) as (values ('sobre', 1), ('entre', -1)), x as (select strftime(imported_at, '%Y-%m') as day, p from tok join l using (form) join documents using (doc_id) where imported_at is not null)
            select day, count(*) filter (p > 0) as positive, count(*) filter (p < 0) as negative, count(*) filter (p > 0) - count(*) filter (p < 0) as balance from x group by day""",
        "fuzzy_fingerprint": f"""with {TOK}, {FORMS}, k as (select {_fold('form')} as key, form, freq from forms), g as (select key, arg_min(form, struct_pack(a := -freq, b := form)) as canonical from k group by key having count(*) > 1)
            select key, canonical, form, freq from k join g using (key)""",
        "fuzzy_levenshtein_pairs": f"""with {TOK}, f as (select distinct form, {_fold('form')} as d from tok), g as (select * from f)
            select a.form as form_a, b.form as form_b, levenshtein(a.d, b.d) as distance from g a join g b on substr(a.d, 1, 3) = substr(b.d, 1, 3) and abs(length(a.d) - length(b.d)) <= 1 and a.form < b.form where levenshtein(a.d, b.d) <= 1""",
        "noise_forms": f"""with {TOK}, x as (select form from tok union select replace(w, 'ς', 'σ') from (select unnest({_runs(whole=_WITH_LETTER)}) as w from documents))
            select form from x where regexp_matches(form, '\\p{{N}}') or regexp_full_match(form, '[ivxlcdm]{{1,6}}') or length(form) <= 1 or (length(form) <= 2 and form not in ('ia', 'ai', 'uf', 'br', 'pt'))""",
        "kwic_hits": f"""with w as (select doc_id, {_KWIC} as w from documents), p as (select doc_id, unnest(w) as t, unnest(range(len(w))) as pos from w),
            l as (select *, list(t) over (order by doc_id, pos rows between 5 preceding and 1 preceding) as l, list(t) over (order by doc_id, pos rows between 1 following and 5 following) as r from p)
            select doc_id, pos, coalesce(l, []) as left_tokens, t as keyword, coalesce(r, []) as right_tokens from l where {_fold('t')} = 'sobre'""",
        "prototypical_quadrants": f"""with w as (select list_filter({_runs(whole=f'[{_LATIN}]+')}, lambda x: length(x) > 2) as w from documents), p as (select unnest(w) as form, unnest(range(len(w))) as pos from w),
            e as (select form, count(*) as freq, avg(pos + 1) as r from p group by form having count(*) >= 2), t as (select avg(freq) as mf, sum(freq * r) / sum(freq) as mr from e)
            select case when freq >= mf and round(r, 1) <= mr then 'core' when freq >= mf then 'first_periphery' when round(r, 1) <= mr then 'contrast' else 'second_periphery' end as quadrant,
                   count(*) as forms, sum(freq)::bigint as freq from e, t group by 1""",
        "voyant_doc_terms": f"""with {TOK}, s as (select doc_id, count(*) as len from tok group by doc_id), b as (select doc_id, form, least(pos * 10 // len, 9) as bin, count(*) as n from tok join s using (doc_id) where form in ('sobre', 'entre') group by 1, 2, 3),
            m as (select doc_id, form, sum(n)::bigint as n, max(n) as most from b group by 1, 2), x as (select m.*, r.bin as k, coalesce(b.n, 0) as v from m cross join range(10) r(bin) left join b on b.doc_id = m.doc_id and b.form = m.form and b.bin = r.bin)
            select doc_id, form, n, string_agg(round_even(v * 9 / most, 0)::int::varchar, '' order by k) as code from x group by doc_id, form, n""",
        "graph_components": f"""with recursive {_EDGES}, e as materialized (select term_a as a, term_b as b from pairs union select term_b, term_a from pairs),
            r(node, root) as (select * from (select a, min(a) over () as m from (select distinct a from e)) where a = m union select e.b, r.root from r join e on e.a = r.node),
            rest as (select distinct a from e where a not in (select node from r)) select node, root as component from r union all select a, (select min(x.a) from rest x) from rest""",
        "pagerank": _pagerank(20),
        "text_network": f"""with {TOK}, t as (select case when count(*) <= 1500 then 1 when count(*) <= 8000 then 2 when count(*) <= 30000 then 3 when count(*) <= 90000 then 4 else 5 end as f,
              case when count(*) <= 1500 then 0 when count(*) <= 30000 then 1 when count(*) <= 90000 then 2 else 3 end as e from tok),
            v as (select form from tok group by form having count(*) >= (select f from t)), k as (select doc_id, form, row_number() over (partition by doc_id order by pos) as pos from tok join v using (form)),
            p as (select least(a.form, b.form) as src, greatest(a.form, b.form) as dst, 2 * count(*) as n from k a join k b on a.doc_id = b.doc_id and b.pos between a.pos + 1 and a.pos + 5 where a.form <> b.form group by 1, 2)
            select src, dst, n::double as weight from p where n >= (select f from t) and n > (select e from t)""",
        "specificity_hypergeo_loc": f"""with {TOK}, {DTM}, {META}, {LOC}, {_table('loc', 3)}, {_MARGINS}, {_hypergeometric('n', 'kk', 'g', 'tt', '(select form, grp, n, k as kk, g, total as tt from m)')}
            select form, grp, n, kk::bigint as form_total, score, case when score >= 0 then '+' else '-' end as sign, n * 1000.0 / g as per_thousand from hs""",
        "keyness_exact": _KEYNESS + f""", {_hypergeometric('n_a', '(n_a + n_b)', 'sa', '(sa + sb)', 'z')} select form, n_a::bigint as n_a, n_b::bigint as n_b, score, case when score >= 0 then 'A' else 'B' end as direction,
            n_a * 1e6 / sa as norm_a, n_b * 1e6 / sb as norm_b from hs""",
        "fuzzy_ngram_fingerprint": f"""with {TOK}, {FORMS}, d as (select form, freq, {_fold('form')} as d from forms),
            k as (select form, freq, case when length(d) < 2 then d else array_to_string(list_sort(list_distinct(list_transform(range(1, length(d)), lambda i: substr(d, i, 2)))), '') end as key from d),
            g as (select key, arg_min(form, struct_pack(a := -freq, b := form)) as canonical from k group by key having count(*) > 1) select key, canonical, form, freq from k join g using (key)""",
        "lemma_counts": """with p as (select uce_id, case when form in ('sobre', 'entre') then 'sob' else form end as lemma, coalesce(n, 0) as n from postings where uce_id is not null and form is not null)
            select lemma, count(distinct uce_id) as units, sum(n)::bigint as n from p group by lemma""",
        "gram_by_loc": f"""with {TOK}, {DTM}, {META}, {LOC}, l(form, gram) as (values ('sobre', 'pre'), ('entre', 'pre'), ('com', 'pre'), ('que', 'pro'))
            select coalesce(gram, 'nr') as gram, grp, sum(n)::bigint as n from dtm left join l using (form) join loc using (doc_id) group by 1, 2""",
        "word_cloud": f"""with {TOK}, {FORMS}, stop(form) as (values {_STOP}) select form, freq, doc_freq from forms where freq >= 3 and length(form) >= 3 and not regexp_matches(form, '\\p{{N}}') and form not in (select form from stop)
            order by freq desc, form limit 100""",
        "crossed_classifications": f"""with {META}, t as (select a.value as form, b.value as grp, count(*) as n from meta a join meta b using (doc_id) where a.variable = 'loc' and b.variable = 'idade' group by 1, 2), {_MARGINS},
            s as (select form as class_a, grp as class_b, n, {_chi2()} as chi2 from m) select * from s where chi2 > 3.84""",
        "candidate_concepts": f"""with {TOK}, {DTM}, d as (select count(distinct doc_id) as c from dtm), s as (select form, sum(n)::bigint as freq, count(*) as docs, max(n) as most from dtm where form not in ({_quoted(HARD_NOISE)}) group by form having sum(n) >= 3),
            w as (select unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) as w from documents), c as (select lower(w) as form, count(*) as caps from w where regexp_matches(w, '^\\p{{Lu}}') group by 1),
            x as (select form, freq, docs / c as dispersion, most / freq as dominance, least(1, coalesce(caps, 0) / freq) as cap from s left join c using (form) cross join d),
            y as (select form, freq, dispersion, dominance, least(0.88::double, case when form in ({_quoted(ACADEMIC_NOISE)}) then 0.42 else 0 end::double + case when length(form) <= 3 then 0.1 else 0 end::double + case when regexp_matches(form, '[_-]') then 0.06 else 0 end::double
              + case when dispersion < 0.12 then 0.14 else 0 end::double + case when dominance > 0.8 then least(0.28::double, (dominance - 0.8::double) * 1.2::double) else 0 end + case when freq >= 2 and cap >= 0.88 then 0.5 else 0 end::double
              + case when freq >= 3 and cap >= 0.95 and dispersion >= 0.35 then 0.2 else 0 end::double) as noise from x)
            select *, freq * greatest(0.1, 0.42 + 0.9 * dispersion + 0.18 * (1 - dominance)) * greatest(0.05, 1 - noise) as score from y""",
        "word_tree": f"""with w as (select {_runs(whole=f'[{_LATIN}]+(?:_[{_LATIN}]+)*')} as w from documents), h as (select w, unnest(range(len(w))) as p from w), k as (select w, p from h where w[p + 1] = 'sobre'),
            s as (select 'right' as side, w[p + 2:p + 5] as t from k union all select 'left', list_reverse(w[greatest(p - 3, 1):p]) from k),
            n as (select side, array_to_string(t[1:j], ' ') as path, j from (select side, t, unnest(range(1, len(t) + 1)) as j from s)), c as (select side, path, count(*) as freq, any_value(j) as j from n group by 1, 2 having count(*) >= 2)
            select side, path, freq from (select *, row_number() over (partition by side order by freq desc, j, path) as r from c) where r <= 120""",
        "multiword_candidates": f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), w as (select doc_id, {_runs('line', f'[{_LATIN}]{{2,}}')} as w from l),
            s as (select unnest(w) as form from w), f as (select form, count(*)::double as c from s group by form), t as (select count(*)::double as total from s),
            b as (select w[i + 1] as w1, w[i + 2] as w2, null as w3, 2 as n, doc_id, i from (select doc_id, w, unnest(range(greatest(len(w) - 1, 0))) as i from w)
                  union all select w[i + 1], w[i + 2], w[i + 3], 3, doc_id, i from (select doc_id, w, unnest(range(greatest(len(w) - 2, 0))) as i from w)),
            c as (select w1, w2, w3, n, count(*) as freq, count(distinct doc_id) as doc_count, count(*) filter (i = 0) as line_starts from b group by 1, 2, 3, 4 having count(*) >= 3 and count(distinct doc_id) >= 2 and (n = 2 or count(*) filter (i = 0) > 0)),
            r as (select concat_ws(' ', w1, w2, w3) as expr, c.n, freq, doc_count, line_starts, freq * (freq / greatest(x.c, y.c, coalesce(z.c, 0))) * (ln(1 + total / x.c) + ln(1 + total / y.c) + coalesce(ln(1 + total / z.c), 0)) * c.n as score
                  from c join f x on x.form = w1 join f y on y.form = w2 left join f z on z.form = w3 cross join t)
            select *, score / max(score) over () as norm from r""",
        "stream_event_counts": "select event_type, count(*) as n, round(sum(value), 4) as value from events group by event_type",
        "stream_daily_counts": "select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2",
    }
    sql = {name: _rounded(text, FLOATS[name], DECIMALS.get(name, 6)) if name in FLOATS else text for name, text in sql.items()}
    return sql | {f"similitude_{name}": _similitude(name) for name in _INDEX}
