"""DuckDB SQL for the pN queries that SQL can state."""

from __future__ import annotations

#: White space of all scripts in RE2 syntax.
_SPACE = r"[\s\x{1c}-\x{1f}\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _term(column: str) -> str:
    return f"nullif(trim(regexp_replace(lower(nfc_normalize({column})), '{_SPACE}+', ' ', 'g')), '')"


def _terms(tab: str, column: str, record: str, frequency: str, doc_count: str) -> str:
    return f"""
    select '{tab}' as tab, term, cast(sum(coalesce(n, 0)) as bigint) as frequency, count(distinct record) as n_records,
           cast({doc_count} as bigint) as doc_count,
           case when count(distinct record) < 3 then 'rare'
                when count(distinct record) > 0.5 * (select count(distinct {record}) from {tab} where {_term(column)} is not null) then 'common'
                else 'useful' end as mark
    from (select {_term(column)} as term, {record} as record, {frequency} as n, {"doc_count" if tab == "keyphrases" else "null"} as d from {tab}) t
    where term is not null group by term"""


_P1 = _terms("postings", "form", "uce_id", "n", "count(distinct record)") + " union all " + _terms("keyphrases", "phrase", "uci_id", "frequency", "sum(coalesce(d, 0))")

_PAIRS = f"""
    with r as (select distinct uce_id, {_term("form")} as term from postings where uce_id is not null and {_term("form")} is not null),
         m as (select term, count(*) as n from r group by term),
         t as (select count(distinct uce_id) as total from r),
         c as (select a.term as term_a, b.term as term_b, count(*) as cooccurrence from r a join r b on a.uce_id = b.uce_id and a.term < b.term group by 1, 2),
         s as (select c.*, cooccurrence::double * total / (x.n::double * y.n::double) as lift
               from c join m x on x.term = term_a join m y on y.term = term_b cross join t)"""


def _top(tab: str, grp: str, item: str, score: str, frequency: str) -> str:
    return f"""
    select '{tab}' as tab, grp, item, score, frequency, cast(place as int) as place from (
      select *, row_number() over (partition by grp order by score desc, frequency desc nulls last, item) as place from (
        select {grp} as grp, {item} as item, {score} + 0.0 as score, {frequency} as frequency,
               row_number() over (partition by {grp}, {item} order by {score} desc, {frequency} desc nulls last) as k
        from {tab} where {score} is not null and not isnan({score}) and {grp} is not null and {item} is not null) where k = 1) where place <= 10"""


_P4 = _top("specificities", "variable", "word", "score", "frequency") + " union all " + _top("chd_profiles", "run_id || ':' || class_id", "form", "chi2", "freq")

_P5 = f"""
    with s as (select corpus_id, max(struct_pack(set_at := set_at, size := uce_size)).size as size from import_config
               where corpus_id is not null and uce_size >= 1 group by 1),
         r as (select record_id, corpus_id, len(list_filter(tokens, lambda t: t is not null and not regexp_full_match(t, '{_SPACE}*'))) as n,
                      row_number() over (partition by record_id order by loaded_at desc nulls last) as k
               from uci_records where record_id is not null)
    select record_id, n from r join s using (corpus_id) where k = 1 and n > size"""

_P6 = """
    select container_kind, capacity_tokens, (select count(*) from documents) as documents, 0 as overfull, 0 as split_needlessly
    from (select distinct container_kind, capacity_tokens from container_specs where capacity_tokens > 0)"""


def _source(column: str) -> str:
    return f"nullif(regexp_replace(lower(trim({column})), '[\\s-]+', '_', 'g'), '')"


_P7 = f"""
    with t as (select {_source("source")} as source, max(struct_pack(share := target_share, cap := max_repeats)) as r from mix_targets
               where {_source("source")} is not null and target_share > 0 and not isnan(target_share) group by 1),
         h as (select distinct {_source("source")} as source from documents where text <> ''),
         s as (select source, r.share / sum(r.share) over () as share, r.cap as cap, h.source is not null as here from t left join h using (source))
    select source, round(share, 6) as target_share, round(if(here, share, 0) / sum(if(here, share, 0)) over (), 6) as share_with_documents, cap, 0 as over_cap from s"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_terms": _P1,
        "p1_found": f"select tab, term from ({_P1}) where mark <> 'useful'",
        "p2_found": _PAIRS + " select term_a, term_b from s where cooccurrence >= 12 and lift >= 20",
        "p2_pairs": _PAIRS + " select term_a, term_b, cooccurrence, round(greatest(0, log2(lift)), 6) as ppmi from s",
        "p4_top": _P4,
        "p4_found": f"select tab, grp, item from ({_P4})",
        "p5_found": f"select record_id from ({_P5})",
        "p5_kept": f"select record_id, n as n_tokens, 0 as too_long, 0 as off from ({_P5})",
        "p6_kept": _P6,
        "p7_kept": _P7,
    }
