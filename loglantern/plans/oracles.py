"""SQL that gives the same rows as the queries, written independently of them for DuckDB."""

from __future__ import annotations

from ..functions import taxonomy
from .tables import TEMPLATES

_VALUES = ",\n".join(f"  ({i}, '{body}', {int(suffix)})" for i, (body, suffix) in enumerate(TEMPLATES))

_LOGS = f"""logs as (
select e.event_id as log_id, e.ts as "timestamp", 'src' || cast(e.user_id % 20 as varchar) as source,
  case e.event_type when 'error' then 'error' when 'signup' then 'warning' when 'click' then 'debug' else 'info' end as level,
  case when t.suffix = 1 then t.body || ' #' || cast(e.event_id % 500 as varchar) else t.body end as message,
  cast(e.user_id % 7 as bigint) as pid, 't' || cast(e.event_id % 64 as varchar) as thread_id,
  'host-' || cast(e.user_id % 7 as varchar) as host,
  '/var/log/app_' || cast(e.user_id % 5 as varchar) || '.log' as file,
  'file' as source_type, e.props as metadata
from events e join (values
{_VALUES}
) as t(tid, body, suffix) on e.event_id % 16 = t.tid)"""

_STORE = """store as (
select l.*, v.embedding::double[] as embedding from embeddings v join logs l on l.log_id = v.vec_id)"""

_AS_OF = "(select max(ts) from events)"


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"{column} ilike '%{word}%'" for word in words) + ")"


def _chain(column: str, lists: dict[str, tuple[str, ...]], default: str) -> str:
    cases = " ".join(f"when {_any(column, words)} then '{name}'" for name, words in lists.items())
    return f"case {cases} else {default} end"


def _count(condition: str, name: str) -> str:
    return f"cast(count(*) filter (where {condition}) as bigint) as {name}"


def _on_logs(body: str) -> str:
    return f"with {_LOGS}{body}" if body.startswith(",") else f"with {_LOGS}\n{body}"


def _on_store(body: str) -> str:
    return f"with {_LOGS},\n{_STORE}{body}"


_CATEGORY = taxonomy.CATEGORY_WORDS
_SUMMARY = ", ".join(
    [
        "count(*) as total_logs",
        _count(_any("message", _CATEGORY["error"]), "errors"),
        _count(_any("message", _CATEGORY["security"]), "security_issues"),
        _count(_any("message", _CATEGORY["hardware"]), "hardware_issues"),
    ]
)
_SEVERITY = ", ".join(_count(_any("message", words), name) for name, words in taxonomy.SEVERITY_WORDS.items())
_SEVERITY_NAMED = ", ".join(_count(_any("message", words), f"severity_{name}") for name, words in taxonomy.SEVERITY_WORDS.items())
_BY_LEVEL = ", ".join([_count("level = 'error'", "errors"), _count("level = 'warning'", "warnings")])

_SAMPLES = "\nunion all\n".join(
    f"select '{name}' as category, log_id, \"timestamp\", message, "
    f"row_number() over (order by \"timestamp\" desc, log_id) as rank from logs where {_any('message', words)}"
    for name, words in _CATEGORY.items()
)


def _statistics(source: str) -> str:
    return f"""
select 'total' as kind, '' as key, count(*) as count from {source}
union all select 'level', l.level, (select count(*) from {source} p where p.level = l.level)
  from (values ('debug'), ('info'), ('warning'), ('error'), ('critical')) as l(level)
union all select 'source', source, count(*) from {source} group by source"""


_LONG = "strlen(message) > 80"
_KEYWORD_OK = "message not like '%assertion failed%' and message not like '%Statistics:%' and message not like '%--enable-%'"
_SEMANTIC_OK = "message not like '%assertion failed%' and message not like '%Statistics:%'"

_HITS = "\nunion all\n".join(
    f"""select category, message, "timestamp", host, rank from (
  select '{name}' as category, message, "timestamp", host,
    row_number() over (order by "timestamp" desc, message, host) as rank
  from (select distinct message, "timestamp", host from logs
        where {_any('message', words)} and {_LONG} and {_KEYWORD_OK})) where rank <= 10"""
    for name, words in taxonomy.SEARCH_WORDS.items()
)

_ROUTE = _chain("query", taxonomy.ROUTE_WORDS, "null")


def _hybrid(threshold: str) -> str:
    return f""",
hits as ({_HITS}),
asked as (select log_id as qid, message as query, embedding, {_ROUTE} as category
  from (select *, message as query from store) where message <> ''),
sizes as (select category, count(*) as n from hits group by category),
by_words as (select a.qid, 0 as stage, h.rank, h.message, h."timestamp", h.host, 0.85::double as score, h.category
  from asked a join hits h on a.category = h.category),
unsure as (select a.* from asked a left join sizes s on a.category = s.category where coalesce(s.n, 0) < 3),
scored as (select u.qid, c.log_id, c.message, c."timestamp", c.host,
    list_cosine_similarity(u.embedding, c.embedding) as score
  from unsure u, (select * from store where {_LONG} and {_SEMANTIC_OK}) c),
ranked as (select *, row_number() over (partition by qid order by score desc, log_id) as rank from scored),
by_vectors as (select qid, 1 as stage, rank, message, "timestamp", host, score, 'semantic' as category
  from ranked where rank <= 10 and score > {threshold}),
merged as (select * from by_words union all select * from by_vectors),
uniq as (select * from (select *, row_number() over (partition by qid, substring(message, 1, 150)
    order by stage, rank) as k from merged) where k = 1),
answers as (select * from (select *, row_number() over (partition by qid order by stage, rank) as position from uniq)
  where position <= 10)"""


_SHOW_HYBRID = """
select qid, position, message, "timestamp", host, round(score, 5) as score, category from answers"""

_TEXT = """'Source: ' || source || ' | Level: ' || level || ' | Message: ' || message || ' | k: ' || json_extract_string(metadata, '$.k')"""


def _display(column: str) -> str:
    return f"""substring({column}, 1, 150) as key_150,
  substring({column}, 1, 80) || '...' as preview_80,
  case when length({column}) > 100 then substring({column}, 1, 100) || '...' else {column} end as short_100,
  case when length({column}) > 300 then substring({column}, 1, 300) || '...' else {column} end as body_300,
  replace(substring({column}, 1, 160), chr(10), ' ') as line_160"""


def _neighbours(k: int) -> str:
    return f"""select * from (
  select a.vec_id as qid, b.vec_id as vec_id,
    list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score,
    row_number() over (partition by a.vec_id
      order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) as rank
  from embeddings a, embeddings b) where rank <= {k}"""


_PREDICTED = "predicted as (select *, cast((label + vec_id % 2) % 10 as integer) as prediction from embeddings)"

_ENTRY = '"timestamp", source, level, message, metadata as log_metadata'
_VIEW = '"timestamp", source, message, pid, thread_id, metadata'
_HISTOGRAM = "select cast(strlen({c}) // 100 * 100 as integer) as bucket, count(*) as count from {t} where {c} <> '' group by 1"


def _recent(span: str) -> str:
    return f'"timestamp" >= {_AS_OF} - interval {span}'


def oracle_sql() -> dict[str, str]:
    knn = f"select qid, vec_id, round(score, 5) as score, rank from ({_neighbours(5)})"
    hourly = f"select date_trunc('hour', \"timestamp\") as hour, count(*) as count, {_BY_LEVEL} from logs"
    minutes = "select date_trunc('minute', \"timestamp\") as minute, count(*) as error_count"
    share = "cast(round(100.0 * count(*) / sum(count(*)) over (), 1) as double) as percentage"
    stripped = r"regexp_replace(message, '^\s+|\s+$', '', 'g')"
    return {
        "log_range_stats": _on_logs(
            'select count(*) as total, min("timestamp") as earliest, max("timestamp") as latest from logs'
        ),
        "total_count": _on_logs("select count(*) as total from logs"),
        "top_hosts": _on_logs("select host, count(*) as count from logs group by host order by 2 desc, 1 limit 10"),
        "top_files": _on_logs("select file, count(*) as count from logs group by file order by 2 desc, 1 limit 10"),
        "per_minute": _on_logs(
            "select strftime(\"timestamp\", '%Y-%m-%d %H:%M') as minute, count(*) as count from logs "
            "group by 1 order by 1 desc limit 120"
        ),
        "per_minute_text": _on_logs(
            'select substring(cast("timestamp" as varchar), 1, 16) as minute, count(*) as count from logs '
            "group by 1 order by 1 desc limit 120"
        ),
        "length_histogram": _on_logs(_HISTOGRAM.format(c="message", t="logs")),
        "length_histogram_docs": _HISTOGRAM.format(c="text", t="documents"),
        "severity_estimate": _on_logs(f"select {_SEVERITY} from logs"),
        "severity_estimate_docs": f"select {_SEVERITY} from (select text as message from documents)",
        "level_counts": _on_logs("select level, count(*) as count from logs group by level"),
        "level_counts_ranked": _on_logs(
            "select level, count(*) as count, "
            "cast(case level when 'info' then 1 when 'warning' then 2 when 'error' then 3 when 'debug' then 4 end as integer) "
            "as level_rank from logs group by level"
        ),
        "level_share": _on_logs(f"select level, count(*) as count, {share} from logs group by level"),
        "top_sources": _on_logs(
            f"select source, count(*) as count, {_BY_LEVEL} from logs group by source order by 2 desc, 1 limit 10"
        ),
        "hourly_counts": _on_logs(f"{hourly} where {_recent('24 hours')} group by 1"),
        "error_trend": _on_logs(
            f"{minutes}, count(distinct source) as unique_sources from logs "
            f"where level = 'error' and {_recent('24 hours')} group by 1"
        ),
        "log_statistics": _on_logs(
            f", part as (select * from logs where {_recent('1440 minutes')}){_statistics('part')}"
        ),
        "log_statistics_all": _on_logs(_statistics("logs")),
        "insights_summary": _on_logs(f"select {_SUMMARY} from logs"),
        "insights_summary_since": _on_logs(f"select {_SUMMARY} from logs where {_recent('24 hours')}"),
        "overview": _on_logs(
            'select count(*) as total, min("timestamp") as earliest, max("timestamp") as latest, '
            + ", ".join([_SEVERITY] + [_count(_any("message", w), f"category_{n}") for n, w in _CATEGORY.items()])
            + " from logs"
        ),
        "recent_activity": _on_logs(
            f"select count(*) as total_logs, {_count(_recent('1 hour'), 'recent_logs')}, "
            f"count(distinct case when {_recent('1 hour')} then source end) as active_sources from logs"
        ),
        "category_flags": _on_logs(
            "select log_id, "
            + ", ".join(f"{_any('message', words)} as is_{name}" for name, words in _CATEGORY.items())
            + " from logs"
        ),
        "category_samples": _on_logs(f"select * from ({_SAMPLES}) where rank <= 50"),
        "dashboard_samples": _on_logs(
            f"select category, rank, substring(message, 1, 80) || '...' as preview from ({_SAMPLES}) where rank <= 2"
        ),
        "collection_summary": _on_logs(
            f", part as (select * from logs where message <> '' and {_recent('1440 minutes')}) "
            f"select {_AS_OF} as \"timestamp\", 'system_log_parser' as source, 'info' as level, "
            "'Parsed ' || cast((select count(*) from logs) as varchar) || ' system log entries from lastmin.log' as message, "
            "(select count(*) from logs) as parsed_entries, "
            "(select count(*) from logs where message <> '') as stored_entries, count(*) as total_logs, "
            "cast(count(*) filter (where level = 'info') as bigint) as level_info, "
            "cast(count(*) filter (where level = 'error') as bigint) as level_error, "
            "cast(count(*) filter (where level = 'critical') as bigint) as level_critical from part"
        ),
        "search_logs": _on_logs(
            'select "timestamp", source, level, message, pid, thread_id from logs '
            "where message ilike '%request%' and source = 'src3' and level = 'error' "
            'order by "timestamp" desc, log_id limit 100'
        ),
        "search_logs_unfiltered": _on_logs(
            'select "timestamp", source, level, message, pid, thread_id from logs order by "timestamp" desc, log_id limit 100'
        ),
        "logs_in_range": _on_logs(
            f"select {_ENTRY} from logs where \"timestamp\" between timestamp '2024-01-10 06:00:00' "
            "and timestamp '2024-01-12 18:30:00'"
        ),
        "logs_last_minute": _on_logs(f"select {_ENTRY} from logs where {_recent('1 minute')}"),
        "logs_by_source": _on_logs(
            f"select {_ENTRY} from logs where source = 'src3' and {_recent('1440 minutes')}"
        ),
        "logs_by_level": _on_logs(
            f"select {_ENTRY} from logs where level = 'warning' and {_recent('1440 minutes')}"
        ),
        "retained_logs": _on_logs(f"select * from logs where {_recent('7 days')}"),
        "oldest_sample": _on_logs(
            'select "timestamp", host, file, source_type, message from logs where message <> \'\' '
            'order by "timestamp", log_id limit 10000'
        ),
        "newest_rows": _on_logs(
            'select "timestamp", source, level, message, pid, thread_id from logs order by "timestamp" desc, log_id limit 100'
        ),
        "newest_stored_rows": _on_logs(
            'select "timestamp", source, level, message, pid, thread_id from logs order by "timestamp" desc, log_id limit 100'
        ),
        "keyset_page": _on_logs(
            "select log_id, message, \"timestamp\", host, file from logs where message <> '' "
            "and (\"timestamp\", log_id) > (timestamp '2024-01-15 12:00:00', 0) "
            'order by "timestamp", log_id limit 2000'
        ),
        "noise_filter": _on_logs(
            f"select log_id, {_KEYWORD_OK} as keyword_ok, {_SEMANTIC_OK} as semantic_ok from logs where {_LONG}"
        ),
        "time_keys": _on_logs(
            'select log_id, substring(cast("timestamp" as varchar), 1, 16) as minute, '
            "cast(strftime(\"timestamp\", '%Y%m') as integer) as ym, "
            "cast(case level when 'info' then 1 when 'warning' then 2 when 'error' then 3 else 4 end as integer) as level_rank "
            "from logs"
        ),
        "display_rows": _on_logs(
            f"select log_id, {_display('message')}, round(0.85::double * 100, 1) as match_percent from logs"
        ),
        "display_docs": f"select doc_id, {_display('text')} from documents",
        "blank_texts": _on_logs(
            f"select log_id, {stripped} <> '' as has_text, cast(length({stripped}) as integer) as stripped_length from logs"
        ),
        "dedupe_prefix": _on_logs(
            'select log_id, "timestamp", message from (select *, row_number() over (partition by substring(message, 1, 150) '
            'order by "timestamp" desc, log_id) as k from logs) where k = 1'
        ),
        "dedupe_prefix_docs": "select doc_id, text from (select *, row_number() over "
        "(partition by substring(text, 1, 150) order by doc_id) as k from documents) where k = 1",
        "infer_level": _on_logs(
            f"select log_id, {_chain('message', taxonomy.LEVEL_WORDS, repr('info'))} as inferred_level from logs"
        ),
        "weak_labels": _on_logs(
            f"select log_id, {_chain('message', taxonomy.LABEL_WORDS, repr('info'))} as label from logs"
        ),
        "weak_labels_docs": f"select doc_id, {_chain('text', taxonomy.LABEL_WORDS, repr('info'))} as label from documents",
        "label_distribution": _on_logs(
            f"select label, count(*) as count, {share} from (select "
            f"{_chain('message', taxonomy.LABEL_WORDS, repr('info'))} as label from logs) group by label"
        ),
        "route_questions": "select conv_id, turn, category, cast(case category when 'security' then 6 "
        "when 'hardware' then 8 when 'error' then 6 when 'performance' then 7 end as integer) as n_keywords from "
        f"(select *, {_chain('text', taxonomy.ROUTE_WORDS, 'null')} as category from conversations)",
        "route_messages": _on_logs(
            "select log_id, category, case category "
            + " ".join(f"when '{n}' then '{','.join(w)}'" for n, w in taxonomy.SEARCH_WORDS.items())
            + f" end as keywords from (select *, {_chain('message', taxonomy.ROUTE_WORDS, 'null')} as category from logs)"
        ),
        "log_text": _on_logs(f"select log_id, {_TEXT} as text from logs"),
        "text_distribution": _on_logs(
            "select 'source' as kind, source as key, count(*) as count from logs group by source "
            "union all select 'level', level, count(*) from logs group by level"
        ),
        "store_stats": _on_logs(
            "select count(*) as total_embeddings, 384 as embedding_dimension, "
            "round(avg(length(text)), 1) as average_embedding_length, "
            "round(count(*) * 384 * 4 / 1048576.0::double, 2) as memory_usage_mb, max(\"timestamp\") as last_updated "
            f'from (select {_TEXT} as text, "timestamp" from logs)'
        ),
        "normalize_vectors": """with s as (select vec_id, list_transform(embedding, lambda x: x::double * (label + 0.5::double)) as s
  from embeddings), u as (select *, sqrt(list_dot_product(s, s)) as n from s),
v as (select vec_id, n, list_transform(s, lambda x: x / n) as u from u)
select vec_id, round(n, 5) as norm_before, round(sqrt(list_dot_product(u, u)), 5) as norm_after,
  round(list_max(u), 5) as greatest, round(list_min(u), 5) as least from v""",
        "semantic_topk": _on_store(
            """
select log_id, message, "timestamp", host, file, round(list_cosine_similarity(embedding,
  (select embedding::double[] from embeddings order by vec_id limit 1)), 5) as score from store
order by list_cosine_similarity(embedding, (select embedding::double[] from embeddings order by vec_id limit 1)) desc,
  log_id limit 10"""
        ),
        "knn_batch": knn,
        "knn_blocks": knn,
        "knn_quantised": f"{knn} where qid % 100 = 0",
        "knn_texts": f"with {_LOGS} select n.qid, n.vec_id, n.rank, l.message from ({_neighbours(3)}) n "
        "join logs l on l.log_id = n.vec_id",
        "pending_messages": _on_logs(
            "select log_id, message, \"timestamp\", host, file from logs where message <> '' "
            "and log_id not in (select vec_id from embeddings)"
        ),
        "document_embeddings": "select doc_id, 384 as dim, "
        r"case when regexp_matches(text, '[\p{L}\p{N}]') then 1.0::double else 0.0::double end as norm from documents",
        "embed_backfill": _on_logs(
            "select cast(log_id as bigint) as log_id, message, 384 as dim from logs where message <> '' "
            "and log_id not in (select vec_id from embeddings)"
        ),
        "text_vector_rebuild": _on_logs(f"select {_TEXT} as text, 384 as dim from logs"),
        "keyword_search": _on_logs(f"select *, 0.85::double as score from ({_HITS})"),
        "stored_keyword_search": _on_logs(f"select *, 0.85::double as score from ({_HITS})"),
        "hybrid_search": _on_store(_hybrid("0.4::double") + _SHOW_HYBRID),
        "hybrid_search_loose": _on_store(_hybrid("0.3::double") + _SHOW_HYBRID),
        "hybrid_search_shown": _on_store(
            _hybrid("0.3::double")
            + """
select a.qid, a.position, round(round(a.score, 5) * 100, 1) as match_percent, c.count from answers a
join (select qid, count(*) as count from answers group by qid) c on a.qid = c.qid where a.position <= 8"""
        ),
        "training_rows": _on_store(
            f"""
select log_id, message, "timestamp", {_chain('message', taxonomy.LABEL_WORDS, repr('info'))} as label
from (select * from store order by "timestamp" desc, log_id limit 200000)
where message <> '' and len(embedding) = (select max(len(embedding)) from embeddings)"""
        ),
        "confusion_matrix": f"with {_PREDICTED} select label, prediction, count(*) as count from predicted group by 1, 2",
        "confusion_table": f"with {_PREDICTED} select label, "
        + ", ".join(_count(f"prediction = {i}", f"p{i}") for i in range(10))
        + " from predicted group by label",
        "accuracy": f"with {_PREDICTED} select avg(case when label = prediction then 1.0::double else 0.0::double end) "
        "as accuracy from predicted",
        "classifier_checks": "select cast(label as varchar) as label, count(*) as n, count(*) as n_sum_one, count(*) as n_greatest "
        "from embeddings group by 1",
        "largest_entry": "select vec_id, 'e' || cast(list_position(embedding, list_max(embedding)) - 1 as varchar) as entry from embeddings",
        "classification_report": f"""with {_PREDICTED},
classes as (select label as c from predicted union select prediction from predicted),
sums as (select c, (select count(*) from predicted where label = c) as support,
  (select count(*) from predicted where prediction = c) as predicted_n,
  (select count(*) from predicted where label = c and prediction = c) as hits from classes),
pr as (select *, case when predicted_n > 0 then hits / predicted_n::double else 0 end as p,
  case when support > 0 then hits / support::double else 0 end as r from sums),
f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f from pr)
select cast(c as varchar) as name, round(p, 4) as "precision", round(r, 4) as recall, round(f, 4) as f1, support from f
union all select 'accuracy', null, null, round(sum(hits) / sum(support)::double, 4), cast(sum(support) as bigint) from f
union all select 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), cast(sum(support) as bigint) from f
union all select 'weighted avg', round(sum(p * support) / sum(support)::double, 4),
  round(sum(r * support) / sum(support)::double, 4), round(sum(f * support) / sum(support)::double, 4),
  cast(sum(support) as bigint) from f""",
        "split_shares": _on_logs(
            f"select label, count(*) as n, true as is_four_fifths from (select "
            f"{_chain('message', taxonomy.LABEL_WORDS, repr('info'))} as label from logs) group by label"
        ),
        "stored_table_scan": _on_logs(
            "select log_id, \"timestamp\", source, level, 202401 as ym from logs "
            "where \"timestamp\" between timestamp '2024-01-20 00:00:00' and timestamp '2024-01-25 00:00:00'"
        ),
        "newest_indexed_rows": _on_logs(
            'select "timestamp", source, level, message, pid, thread_id from logs order by "timestamp" desc, log_id limit 100'
        ),
        "indexed_summary": _on_logs(
            f"select {_SUMMARY}, {_SEVERITY_NAMED}, min(\"timestamp\") as least, max(\"timestamp\") as greatest from logs"
        ),
        "word_rows": _on_logs(f"select log_id, \"timestamp\", message from logs where {_any('message', ('libxpc', 'slow query', 'délai'))}"),
        "indexed_keyword_search": _on_logs(f"select *, 0.85::double as score from ({_HITS})"),
        "line_ingest": _on_logs(
            f"select message, {_chain('message', taxonomy.LEVEL_WORDS, repr('info'))} as level, "
            f"{_chain('message', taxonomy.LABEL_WORDS, repr('info'))} as label, {_any('message', _CATEGORY['error'])} as is_error, "
            f"{_any('message', taxonomy.SEARCH_WORDS['hardware'])} as find_hardware, count(*) as n from logs group by all"
        ),
        "knn_lsh_recall": "select true as recall_reached, count(*) as queries from embeddings",
        "stored_flags_summary": _on_logs(f"select {_SUMMARY} from logs"),
        "json_entries": _on_logs(
            'select date_trunc(\'milliseconds\', "timestamp") as "timestamp", source, level, message, '
            "json_extract_string(metadata, '$.k') as k from logs "
            f"where date_trunc('milliseconds', \"timestamp\") >= {_AS_OF} - interval 1440 minutes"
        ),
        "os_log_lines": _on_logs(
            "select \"timestamp\", case when log_id % 3 <> 0 then source else 'system' end as source, "
            f"{_chain('message', taxonomy.LEVEL_WORDS, repr('info'))} as level, message, host as process, "
            "'' as subsystem, '-' as absent from logs"
        ),
        "raw_rows_normalised": _on_logs(
            'select "timestamp", round(epoch_us("timestamp") / 1e6, 3) as unix, source_type as source, '
            f"{_chain('message', taxonomy.LEVEL_WORDS, repr('info'))} as level, message, host, cast(0 as bigint) as pid from logs"
        ),
        "csv_roundtrip": _on_logs(
            f"select source, count(*) as count, {_BY_LEVEL} from logs group by source order by 2 desc, 1 limit 10"
        ),
        "retention_cleanup": _on_logs(
            f"select {_count(_recent('10 days'), 'kept')}, "
            f'min("timestamp") filter (where {_recent("10 days")}) as earliest, '
            f"{_count('not (' + _recent('10 days') + ')', 'removed')}, count(*) as stored from logs"
        ),
        "error_view": _on_logs(f"select {_VIEW} from logs where level = 'error'"),
        "warning_view": _on_logs(f"select {_VIEW} from logs where level = 'warning'"),
        "hourly_stream": _on_logs(f"{hourly} group by 1"),
        "error_minutes_stream": _on_logs(f"{minutes} from logs where level = 'error' group by 1"),
        "stream_ingest": _on_logs(
            "select log_id, \"timestamp\", level, cast(strftime(\"timestamp\", '%Y%m') as integer) as ym from logs"
        ),
        "daily_from_hours": _on_logs(
            "select date_trunc('day', \"timestamp\") as day, cast(count(*) as bigint) as count, "
            f"{_BY_LEVEL}, count(distinct source) as unique_sources from logs group by 1"
        ),
        "backfill_copies": _on_logs(
            "select \"timestamp\", host, file, lower(message) as message, "
            "cast(count(*) * case when lower(message) like '%panic%' then 2 else 1 end as bigint) as copies, 384 as dim "
            "from logs where message <> '' group by \"timestamp\", host, file, lower(message)"
        ),
        "stream_retention": _on_logs(
            f"select log_id, \"timestamp\", source, level, message, (select count(*) from logs where not ({_recent('10 days')})) as removed "
            f"from logs where {_recent('10 days')} union all "
            f"select -log_id - 1, \"timestamp\", source, level, message, (select count(*) from logs where not ({_recent('10 days')})) "
            "from logs where level = 'error'"
        ),
        "view_retention": _on_logs(f"select {_VIEW} from logs where level = 'error' and {_recent('5 days')}"),
        "os_log_arrays": _on_logs(
            "select \"timestamp\", case when log_id % 3 <> 0 then source else 'system' end as source, "
            "'say \"' || message || '\" \\ ]}[{' as message, host as process from logs"
        ),
        "stream_enrich": _on_logs("select log_id, message, 384 as dim from logs where message <> ''"),
    }
