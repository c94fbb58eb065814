"""DuckDB SQL of the ``opN_<name>`` queries that SQL can express."""

from stratamem.llm.secret_scan import BASE, RULES

OP4 = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as content
  from documents
), g as (
  select content, max(doc_id) as keep_id, count(*) as group_size from t group by content
)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.content) as text_sha256
from t join g using (content)
"""



def _secrets() -> str:
    """Spans from the lengths of matches and of the pieces between them, for each kind."""
    parts = []
    for n, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''").replace('\\"', '"')
        parts.append(
            f"select doc_id, {n} as k, '{rule.kind}' as kind, {rule.least} as least, regexp_extract_all(content, '{pattern}') as hits, "
            f"regexp_extract_all(content, '{pattern}', {rule.group}) as counted, string_split_regex(content, '{pattern}') as gaps from t"
        )
    return f"""
with t as (select doc_id, coalesce(text, '') as content from documents),
m as ({" union all ".join(parts)}),
u as (select doc_id, k, kind, least, i, len(hits[i]) as size, len(counted[i]) as counts,
  list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) as start
  from (select *, unnest(range(1, len(hits) + 1)) as i from m)),
s as (select doc_id, k, kind, start::bigint as start, (start + size)::bigint as stop from u where counts >= least),
g as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) filter (where k < {len(BASE)}), '') as base,
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) as spans from s group by 1)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join g using (doc_id)
"""


ORACLES = {"op9_secret_scan": _secrets(), "op4_exact_dedup": OP4}
