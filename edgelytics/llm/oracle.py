"""SQL counterparts, for the operators that SQL over whole tables can express."""

from edgelytics.llm.quality import LineRules

ORACLE: dict[str, str] = {}
_RULES = LineRules()

# The words of a text, between runs of the six ASCII blanks.
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE["op4_line_dedup"] = r"""
with lines as (
  select doc_id, generate_subscripts(l, 1) as place, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (
  select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), frequent as (
  select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (f.key is null), '')) as kept_sha256
from keyed k left join frequent f on k.key = f.key
group by doc_id
"""

ORACLE["op9_substring"] = rf"""
with docs as (
  select doc_id, {_WORDS} as w from documents
), words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place from docs
), windows as (
  select doc_id, place as s, array_to_string(body, ' ') as body from (
    select doc_id, place, list(word) over (partition by doc_id order by place rows between current row and 34 following) as body
    from words)
  where len(body) = 35
), repeated as (
  select doc_id, s from windows where body in (select body from windows group by body having count(*) > 1)
), covered as (
  select distinct doc_id, unnest(range(s, s + 35)) as place from repeated
), kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by place) as body
  from words anti join covered using (doc_id, place) group by doc_id
)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(body, '')) as kept_sha256
from docs left join kept using (doc_id)
"""

_BOILERPLATE = "|".join(f"(?:{p})" for p in _RULES.boilerplate)
ORACLE["op10_quality"] = rf"""
with docs as (
  select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents
), words as (
  select doc_id, unnest(w) as a, generate_subscripts(w, 1) as s from docs
), followed as (
  select *, lead(a, 1) over after as b, lead(a, 2) over after as c
  from words window after as (partition by doc_id order by s)
), triples as (
  select doc_id, s, count(*) over (partition by doc_id, a, b, c) as n from followed where c is not null
), repeats as (
  select doc_id, count(distinct place) as n
  from (select doc_id, unnest(range(s, s + 3)) as place from triples where n > 1) group by doc_id
), lines as (
  select doc_id, line_no, text as line, {_WORDS} as w
  from (select doc_id, generate_subscripts(l, 1) as line_no, unnest(l) as text
    from (select doc_id, string_split(text, chr(10)) as l from docs))
), placed as (
  select doc_id, line_no, unnest(w) as word, generate_subscripts(w, 1) as place from lines where len(w) >= {_RULES.run}
), runs as (
  select distinct doc_id, line_no from (
    select doc_id, line_no, word, place - row_number() over (partition by doc_id, line_no, word order by place) as run from placed)
  group by doc_id, line_no, word, run having count(*) >= {_RULES.run}
), judged as (
  select lines.doc_id, line, len(w) as n, len(w) > 0 and (
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > {_RULES.symbol_share} * strlen(array_to_string(w, ''))
    or (len(list_filter(w, lambda x: x in ('|', '>', '»', '·'))) >= {_RULES.separators}
      and len(list_filter(w, lambda x: x in ('|', '>', '»', '·'))) >= {_RULES.separator_share} * len(w))
    or regexp_matches(
      regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{_BOILERPLATE}', 'i')
    or runs.line_no is not null
  ) as failed from lines left join runs on lines.doc_id = runs.doc_id and lines.line_no = runs.line_no
), per_doc as (
  select doc_id, count(*) as n_lines, count(*) filter (failed) as n_failed_lines,
    coalesce(sum(n) filter (failed), 0) as n_failed_words,
    count(*) filter (n > 0) - count(distinct line) filter (n > 0) as n_dup_lines
  from judged group by doc_id
), measured as (
  select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, n_dup_lines,
    coalesce(r.n, 0) as n_repeat_words, n_lines, n_failed_lines, cast(n_failed_words as bigint) as n_failed_words
  from docs join per_doc using (doc_id) left join repeats r using (doc_id)
), based as (
  select *, n_words < {_RULES.least_words} or 100 * n_repeat_words > {_RULES.most_repeated} * n_words as base_failed from measured
)
select *, not base_failed and n_failed_words <= {_RULES.most_lost} * n_words as kept from based
"""

# Each order is applied filter by filter to the failed sets of each part.
ORACLE["op12_filter_audit"] = rf"""
with recursive docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, {_WORDS} as w from documents
), marks as (
  select doc_id, coalesce(max(case when quality = 1 then 1 else 0 end), 0) as good,
    coalesce(max(case when toxic = 1 then 1 else 0 end), 0) as toxic from labels group by doc_id
), judged as (
  select part, coalesce(good, 0) as good, coalesce(m.toxic, 0) as toxic,
    len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) as c,
    regexp_matches(text, '[#$%&*|]') as d,
    coalesce(doc_id > min(doc_id) over (partition by text), false) as e
  from docs left join marks m using (doc_id)
), sets as (
  select part, good, toxic, concat(case when a then 'A' else '' end, case when b then 'B' else '' end,
    case when c then 'C' else '' end, case when d then 'D' else '' end, case when e then 'E' else '' end) as failed,
    count(*) as n from judged group by all
), orders as (
  select '' as filter_order union all
  select filter_order || f from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) as v(f)
  where not contains(filter_order, f)
), steps as (
  select filter_order, step, substr(filter_order, step, 1) as f, substr(filter_order, 1, step - 1) as before
  from orders, (values (1), (2), (3), (4), (5)) as v(step) where length(filter_order) = 5
), met as (
  select part, filter_order, step, f, n, good, toxic, failed = f as alone, contains(failed, f) as mine,
    length(translate(failed, before, '')) < length(failed) as gone
  from sets, steps
), counted as (
  select part, filter_order, step, f,
    coalesce(sum(n) filter (not gone and not mine), 0)::bigint as kept,
    coalesce(sum(n) filter (not gone and mine), 0)::bigint as removed,
    coalesce(sum(n) filter (gone and mine), 0)::bigint as redundant,
    coalesce(sum(n) filter (alone), 0)::bigint as unique_fails,
    coalesce(sum(n) filter (not gone and mine and good = 1), 0)::bigint as good_lost,
    coalesce(sum(n) filter (not gone and mine and toxic = 1), 0)::bigint as toxic_lost
  from met group by part, filter_order, step, f
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, f))::bigint as shapley
from counted
"""

# All documents scored for all items that share a term with them.
ORACLE["op11_max_sketch"] = r"""
with docs as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') as t from documents
), items as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+')) as term from benchmark
), totals as (
  select count(*) as n_docs, sum(len(t))::bigint as n_terms from docs where len(t) > 0
), occurring as (
  select doc_id, len(t) as n, unnest(t) as term from docs
), counted as (
  select doc_id, n, term, count(*) as tf from occurring group by all
), weighed as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from counted, totals group by term, n_docs
), scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
  from items join counted using (term) join weighed using (term), totals group by item_id, doc_id
), ranked as (
  select *, (row_number() over (partition by item_id order by score desc, doc_id))::integer as rank from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""
