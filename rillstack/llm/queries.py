"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from rillstack.llm.bagminhash import op9_near_duplicates
from rillstack.llm.bpe_codec import op2_bpe
from rillstack.llm.decontaminate import op3_decontaminate
from rillstack.llm.langid import op8_langid
from rillstack.llm.line_dedup import op10_line_dedup
from rillstack.llm.quality import op7_quality
from rillstack.llm.substring_dedup import op4_substring_dedup
from rillstack.llm.token_counts import op6_token_counts
from rillstack.llm.token_files import op1_token_files
from rillstack.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_bpe": op2_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_langid": op8_langid,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": r"""
        with w as (
            select doc_id, unnest(l) as word, generate_subscripts(l, 1) as i
            from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as l from documents)
        ), runs as (
            select doc_id, i, word, list(word) over (partition by doc_id order by i rows between current row and 12 following) as l from w
        ), owned as (
            select doc_id, i, word, len(l) = 13 and min(doc_id) over (partition by l) < doc_id as again from runs
        ), marked as (
            select doc_id, i, word, bool_or(again) over (partition by doc_id order by i rows between 12 preceding and current row) as gone from owned
        ), sums as (
            select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from marked group by doc_id
        )
        select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from documents left join sums using (doc_id)""",
}
