"""SQL for the catalogue queries, written for DuckDB over the same tables.

DuckDB has no NFKC; the SQL maps the no-break space, the only character of the tables that NFKC changes.
"""

from __future__ import annotations

# Fixed list of the coverage query; the repeated and the two-word term are on purpose.
TERMS = ("Урок", "урок", "школа", "lesson", "Unterricht", "leçon", "музей", "quaternion", "анализ данных", "робототехника")
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_\-]*[\p{L}\p{N}_]"
TOKEN3 = r"[\p{L}\p{N}_][\p{L}\p{N}_\-]+[\p{L}\p{N}_]"


def clean(c: str) -> str:
    x = f"replace(replace(coalesce({c}, ''), chr(160), ' '), chr(65279), ' ')"
    x = rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g')"
    x = rf"regexp_replace({x}, '[\t\r\x{{85}}\p{{Z}}]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\s+\n', chr(10), 'g')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip(c: str) -> str:
    white = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
    return f"regexp_replace({c}, '^{white}|{white}$', '', 'g')"


def squeeze(c: str) -> str:
    return rf"regexp_replace(lower({strip(f"coalesce({c}, '')")}), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')"


BASE = f"""c as (select doc_id, lang, {clean('text')} t from documents),
n as (select *, sha256(t) h from c where t <> ''),
u as (select doc_id, lang, t, h, copies from (select *, row_number() over (partition by h order by doc_id) rn, count(*) over (partition by h) copies from n) where rn = 1)"""
TOKENS = f"k as (select doc_id, unnest(regexp_extract_all(lower(t), '{TOKEN}')) term from u), v as (select term, count(*) freq from k group by 1)"
LENGTHS = f"""l as (select doc_id, length(t) chars, len(regexp_extract_all(lower(t), '{TOKEN}')) tokens,
cast(1 + greatest(0, ceil((length(t) - 600) / 480.0)) as bigint) chunks, regexp_matches(t, '[^\\x00-\\x7F]') non_ascii from u)"""


def _describe(measure: str, source: str, col: str) -> str:
    qs = ", ".join(f"round(quantile_cont({col}, {q}), 6) p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95))
    head = f"'{measure}' measure, " if measure else ""
    return f"select {head}count({col}) n, min({col})::double min, max({col})::double max, round(avg({col}), 6) mean, {qs} from {source}"


def _topk(score: str, k: int) -> str:
    return f"""h as (select q.vec_id query_id, e.vec_id, {score} score, row_number() over (partition by q.vec_id order by {score} desc, e.vec_id) rank
from embeddings q join embeddings e on q.vec_id % 50 = 0 and e.vec_id <> q.vec_id qualify rank <= {k})"""


COSINE = "list_cosine_similarity(q.embedding::double[], e.embedding::double[])"
L2 = "-list_sum(list_transform(list_zip(q.embedding::double[], e.embedding::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
STATE = f"""r as (select *, {squeeze('question')} qn, lower({strip("coalesce(model, '')")}) mk, sha256({squeeze('answer')}) ah from cached_answers where coalesce(question, '') <> '' and coalesce(answer, '') <> ''),
g as (select min(id) id, sha256(qn) question_hash, mk model_key, arg_max(answer, id) answer, arg_max(ah, id) answer_hash, arg_max(created_at, id) created_at,
arg_max(embedding, id) filter (where len(embedding) > 0) embedding, count(*) versions from r group by qn, mk)"""
OVERLAP = f"""qt as (select item_id query_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(question, '')), '{TOKEN}'))) term from eval_set_gold_manual),
qn as (select query_id, count(*) n from qt group by 1),
dt as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) term from documents),
o as (select query_id, doc_id, count(*) / any_value(n)::double score from qt join dt using (term) join qn using (query_id) group by 1, 2),
h as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from o)"""
SIMS = """s as (select a.vec_id, max(case when b.vec_id = a.vec_id + 1 then list_cosine_similarity(a.embedding::double[], b.embedding::double[]) end) ref_sim,
max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])) refs_sim from embeddings a left join embeddings b on b.vec_id between a.vec_id + 1 and a.vec_id + 3 group by 1)"""
EDGES = """e as (select event_id pos, 'u' || user_id head, case event_type when 'click' then 'uses' when 'view' then 'Part Of' when 'purchase' then 'supports' when 'signup' then '' else 'broken_by' end rel,
json_extract_string(props, '$.k') tail, case when event_id % 7 = 0 then null else value / 100 end score, ' event ' || event_id cite from events),
f as (select *, replace(lower(rel), ' ', '_') pred, head || '|' || replace(lower(rel), ' ', '_') || '|' || tail edge_id from e where rel <> 'broken_by' and (score is null or score >= 0.1)),
b as (select *, row_number() over (partition by edge_id order by score desc nulls last, pos) rn, min(pos) over (partition by edge_id) first_pos from f),
x as (select edge_id, head, coalesce(nullif(rel, ''), 'related_to') rel, tail, score, cite, first_pos from b where rn = 1)"""
LOG_STATS = """count(*) requests, round(avg(value), 6) duration_mean, round(quantile_cont(value, 0.5), 6) duration_p50, round(quantile_cont(value, 0.95), 6) duration_p95, round(quantile_cont(value, 0.99), 6) duration_p99,
round(avg(user_id), 6) text_len_mean, round(quantile_cont(user_id, 0.5), 6) text_len_p50, round(avg(try_cast(json_extract_string(props, '$.k') as bigint)), 6) token_count_mean,
null::double image_width_mean, null::double image_width_p50, null::double image_height_p50"""


def _metrics(asked: str, matches: str) -> str:
    """``asked``: query_id, n_refs; ``matches``: query_id, ref_no, rank."""
    ks = "".join(f", round(avg(coalesce(hit_{k}, 0) / greatest(n_refs, 1)), 6) recall_{k}, round(avg(coalesce(prec_{k}, 0) / {k}.0), 6) precision_{k}" for k in (5, 10))
    return f"""m as ({matches}), a as ({asked}),
    d as (select query_id, 1.0 / min(rank) mrr, sum(case when rank <= 3 then 1 / log2(rank + 1) end) dcg, count(*) filter (where rank <= 5) prec_5, count(*) filter (where rank <= 10) prec_10 from (select distinct query_id, rank from m) group by 1),
    r as (select query_id, count(distinct case when rank <= 5 then ref_no end) hit_5, count(distinct case when rank <= 10 then ref_no end) hit_10 from m group by 1)
    select count(*) questions{ks}, round(avg(coalesce(mrr, 0)), 6) mrr,
    round(avg(case when n_refs > 0 then coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_refs, 3) + 1), lambda i: 1 / log2(i + 1))) else 0 end), 6) ndcg_3
    from a left join d using (query_id) left join r using (query_id)"""


def _terms() -> str:
    return "t as (select lower(trim(x)) term, count(*) listed from (values " + ", ".join(f"('{x}')" for x in TERMS) + ") w(x) group by 1)"


def _quality() -> str:
    values = {
        "duplicate_ratio": "duplicates / processed", "error_rate": "errors / processed", "clean_text_coverage": "linked / uniq", "clean_text_linked_ratio": "linked / nullif(saved, 0)",
        "metadata_gap_ratio": "greatest(saved - linked, 0) / nullif(saved, 0)", "short_doc_ratio": "short / uniq", "long_doc_ratio": "long / uniq", "avg_tokens_per_document": "tokens / uniq",
        "avg_chars_per_document": "chars / uniq", "avg_chunks_per_document": "chunks / uniq", "avg_tokens_per_chunk": "tokens / chunks", "lexical_diversity": "types / tokens",
        "dominant_language_share": "dominant / uniq", "unique_token_count": "types", "largest_duplicate_group": "largest", "non_ascii_ratio": "non_ascii / uniq",
    }
    one = " union all ".join(f"select '{k}' metric, round(coalesce({v}, 0)::double, 6) \"value\" from w" for k, v in values.items())
    return f"""with {BASE}, {LENGTHS}, {TOKENS},
    w as (select (select count(*) from c) processed, (select count(*) from c where t = '') errors, (select count(*) from u) uniq, (select sum(copies - 1) from u) duplicates,
    (select coalesce(max(copies), 0) from u where copies > 1) largest, (select sum(chars) from l) chars, (select sum(tokens) from l) tokens, (select sum(chunks) from l) chunks,
    (select count(*) from l where tokens <= 200) short, (select count(*) from l where tokens >= 4000) long, (select count(*) from l where non_ascii) non_ascii,
    (select max(n) from (select count(*) n from u group by coalesce(lang, 'unknown'))) dominant, (select count(*) from v) types,
    (select count(*) from u where h in (select content_hash from document_records)) linked, (select count(*) from u where h in (select content_hash from document_records where output_path is not null)) saved) {one}"""


SQL = {
    "corpus_clean_stats": f"select count(*) docs, count(*) filter (where c = '') empty, count(*) filter (where c <> t) changed, sum(length(c))::bigint chars from (select coalesce(text, '') t, {clean('text')} c from documents)",
    "corpus_dedup_canonical": f"with {BASE} select doc_id, h hash, copies from u",
    "corpus_duplicate_groups": f"""with {BASE}, g as (select h, doc_id, copies from u where copies > 1 order by copies desc, doc_id limit 10),
        m as (select g.doc_id, g.copies, n.doc_id dup, row_number() over (partition by g.h order by n.doc_id) rn from g join n on n.h = g.h and n.doc_id > g.doc_id)
        select doc_id, any_value(copies) - 1 duplicates, string_agg(dup::varchar, ',' order by dup) filter (where rn <= 5) examples from m group by doc_id""",
    "corpus_language_share": f"with {BASE} select coalesce(lang, 'unknown') lang, count(*) docs, round(count(*) / sum(count(*)) over (), 6) share from u group by 1",
    "corpus_doc_lengths": f"with {BASE}, {LENGTHS} select * from l",
    "corpus_length_describe": f"with {BASE}, {LENGTHS} " + " union all ".join(_describe(c, "l", c) for c in ("chars", "tokens", "chunks")),
    "corpus_vocabulary_top50": f"with {BASE}, {TOKENS} select * from v order by freq desc, term limit 50",
    "corpus_lexical_diversity": f"with {BASE}, {TOKENS} select count(*) types, sum(freq)::bigint tokens, round(count(*) / sum(freq), 6) diversity from v",
    "corpus_tfidf_top50": f"""with {BASE}, tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(regexp_extract_all(lower(t), '{TOKEN3}')) term from u) group by 1, 2),
        f as (select term, count(*) df, sum(tf) cf from tf group by 1 having count(*) >= 2 order by cf desc, term limit 2000), n1 as (select count(*) n from u),
        w as (select doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) w from tf join f using (term), n1), m as (select doc_id, sqrt(sum(w * w)) m from w group by 1),
        s as (select term, sum(w / m) / (select n from n1) score from w join m using (doc_id) group by 1) select term, round(score, 6) score from s order by round(score, 9) desc, term limit 50""",
    "corpus_term_coverage": f"with {BASE}, {TOKENS}, {_terms()} select t.term, listed, coalesce(freq, 0) freq, freq is not null present from t left join v using (term)",
    "corpus_term_ratio": f"with {BASE}, {TOKENS}, {_terms()} select sum(listed)::bigint listed, coalesce(sum(listed) filter (where freq is not null), 0)::bigint present, round(coalesce(sum(listed) filter (where freq is not null), 0) / sum(listed), 6) ratio from t left join v using (term)",
    "corpus_term_sets": f"with {BASE}, {TOKENS}, {_terms()} select t.term, case when freq is null then 'missing' else 'present' end state from t left join v using (term)",
    "corpus_chunks": f"with {BASE}, k as (select doc_id, t, unnest(range(cast(1 + greatest(0, ceil((length(t) - 600) / 480.0)) as bigint))) chunk_no from u) select doc_id, chunk_no::int chunk_no, length(substring(t, chunk_no * 480 + 1, 600)) chunk_chars from k",
    "corpus_chunk_stats": f"with {BASE}, k as (select t, unnest(range(cast(1 + greatest(0, ceil((length(t) - 600) / 480.0)) as bigint))) i from u), z as (select length(substring(t, i * 480 + 1, 600)) n from k) " + _describe("", "z", "n").replace("count(n) n", "count(n) n"),
    "corpus_quality_metrics": _quality(),
    "corpus_classification_summary": "select field, value, count(*) total from (" + " union all ".join(f"select '{c}' field, coalesce({c}, 'unknown') \"value\" from documents" for c in ("file_type", "lang", "source")) + ") group by 1, 2",
    "corpus_document_details": f"with {BASE}, {LENGTHS} select u.doc_id, h hash, chars, tokens, h in (select content_hash from document_records) linked from u join l using (doc_id)",
    "catalog_record_links": """with p as (select pdf_file_name, min(page_id) page_id from scanned_pages where pdf_file_name is not null group by 1)
        select record_id, case when doc_id is not null then 'file' when page_id is not null then 'page' else 'none' end link, coalesce(doc_id, page_id) linked_id
        from document_records r left join documents d using (source_path) left join p on p.pdf_file_name = string_split(r.source_path, '/')[-1]""",
    "index_min_length_dedup": f"""with s as (select doc_id, source, {strip('text')} t from documents), k as (select *, row_number() over (partition by coalesce(source, 'None'), md5(t) order by doc_id) rn from s where length(t) >= 30)
        select doc_id, length(t) chars from k where rn = 1""",
    "index_resume_antijoin": "select doc_id, source_path from documents where source_path not in (select source_path from document_records where source_path is not null)",
    "index_replace_source": r"""with o as (select page_id id, regexp_extract(lower(page_url), '^https?://(?:www\.)?([^/:]+)', 1) source, 'page' kind from scanned_pages)
        select * from o where source not in (select source from documents where source is not null) union all select doc_id, source, 'document' from documents""",
    "vector_topk_cosine": f"with {_topk(COSINE, 10)} select query_id, vec_id, round(score, 6) score, rank::int rank from h",
    "vector_topk_l2": f"with {_topk(L2, 20)} select query_id, vec_id, round(score, 6) score, rank::int rank from h",
    "vector_rerank": f"""with {_topk(L2, 20)}, z as (select h.query_id, h.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s, rank from h join embeddings a on a.vec_id = h.vec_id join embeddings b on b.vec_id = h.query_id),
        y as (select *, row_number() over (partition by query_id order by s desc, rank) new_rank from z) select query_id, vec_id, round(s, 6) rerank_score, new_rank::int new_rank from y where new_rank <= 5""",
    "vector_unique_hits": f"with {_topk(COSINE, 20)}, z as (select query_id, h.vec_id, label, rank, row_number() over (partition by query_id, label order by rank) n from h join embeddings e on e.vec_id = h.vec_id) select query_id, vec_id, label, rank::int rank from z where n = 1",
    "retrieval_metrics_label": f"with {_topk(COSINE, 50)}, " + _metrics("select vec_id query_id, (select count(*) - 1 from embeddings z where z.label = y.label) n_refs from embeddings y where vec_id % 50 = 0", "select query_id, h.vec_id ref_no, rank from h join embeddings e on e.vec_id = h.vec_id join embeddings q on q.vec_id = h.query_id where e.label = q.label"),
    "retrieval_metrics_text": f"with {OVERLAP}, rf as (select item_id query_id, ref_no, refs[ref_no] ref from (select item_id, refs, unnest(range(1, len(refs) + 1)) ref_no from eval_set_gold_manual) where trim(refs[ref_no]) <> ''), "
    + _metrics("select item_id query_id, (select count(*) from rf where rf.query_id = item_id) n_refs from eval_set_gold_manual", "select h.query_id, ref_no, rank from h join documents d using (doc_id) join rf on rf.query_id = h.query_id where rank <= 50 and (contains(lower(ref), lower(coalesce(text, ''))) or contains(lower(coalesce(text, '')), lower(ref)))"),
    "answer_similarity_summary": f"with {SIMS} select count(*) answers, count(ref_sim) n_ref, round(avg(ref_sim), 6) avg_ref_sim, round(avg(refs_sim), 6) avg_refs_sim, round(median(ref_sim), 6) median_ref_sim, round(stddev_samp(ref_sim), 6) std_ref_sim from s",
    "similarity_histogram": f"with {SIMS}, e as (select min(ref_sim) lo, max(ref_sim) hi from s) select least(floor((ref_sim - lo) / (hi - lo) * 20), 19)::int bin, count(*) n from s, e where ref_sim is not null group by 1",
    "number_summary": "select count(v) n, round(avg(v), 6) mean, round(median(v), 6) median, round(stddev_samp(v), 6) std from (select try_cast(json_extract_string(props, '$.k') as double) v from events)",
    "cache_keys": f"select id, {squeeze('question')} question_normalized, {squeeze('answer')} answer_normalized, lower({strip("coalesce(model, '')")}) model_key, sha256({squeeze('question')}) question_hash, sha256({squeeze('answer')}) answer_hash from cached_answers",
    "cache_upsert_latest": f"with {STATE} select id, question_hash, model_key, answer, answer_hash, round(list_sum(embedding), 6) embedding_sum, versions from g",
    "cache_exact_lookup": f"""with {STATE}, a as (select id ask_id, sha256({squeeze('question')}) question_hash, lower({strip("coalesce(model, '')")}) want from cached_answers where id % 50 = 0),
        z as (select ask_id, g.id, row_number() over (partition by ask_id order by (model_key = want) desc, created_at desc, g.id desc) n from a join g using (question_hash) where model_key in (want, '')) select ask_id, id from z where n = 1""",
    "cache_similar_lookup": f"""with {STATE}, a as (select id ask_id, lower({strip("coalesce(model, '')")}) want, embedding q from cached_answers where id % 50 = 0), w as (select distinct want from a),
        p as (select want, g.*, row_number() over (partition by want order by created_at desc, g.id desc) rn from w join g on model_key in (want, '') where embedding is not null),
        z as (select ask_id, p.id, p.created_at, case when len(q) = len(embedding) then list_cosine_similarity(q, embedding) else 0 end s from a join p using (want) where rn <= 200),
        y as (select *, row_number() over (partition by ask_id order by s desc, created_at desc, id desc) n from z where s > 0.92) select ask_id, id, round(s, 6) similarity from y where n = 1""",
    "context_build": f"""with {OVERLAP}, z as (select query_id, rank, coalesce(source, 'unknown') s, {strip("coalesce(text, '')")} t from h join documents using (doc_id) where rank <= 5)
        select query_id, string_agg('[' || s || '] ' || case when length(t) > 1200 then left(t, 1199) || ':' else t end, chr(10) || chr(10) order by rank) context from z group by 1""",
    "log_history_200": "select event_id id, event_type status, value duration_ms, user_id text_len, try_cast(json_extract_string(props, '$.k') as bigint) token_count from events order by event_id desc limit 200",
    "log_stats": f"select {LOG_STATS} from events",
    "log_stats_by_status": f"select event_type status, {LOG_STATS} from events group by 1",
    "request_lengths": rf"""select id, length(t) text_len, len(list_filter(regexp_split_to_array(t, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda x: x <> '')) token_count, coalesce(nullif(model, ''), 'deepseek') model, left(answer, 200) response_preview from (select *, {strip("coalesce(question, '')")} t from cached_answers)""",
    "pages_url_normalize": r"""with p as (select page_id, page_url u, nullif(regexp_extract(page_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '') a,
        coalesce(nullif(string_split(regexp_replace(regexp_replace(page_url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*', ''), '/')[-1], ''), 'file') f from scanned_pages)
        select page_id, regexp_replace(regexp_replace(lower(trim(u)), '[?#;].*$', ''), '/+$', '') site_key, a authority, replace(a, '.', '_') slug, f file_name, lower(nullif(regexp_extract(f, '\.([A-Za-z0-9]+)$', 1), '')) file_type,
        coalesce(nullif(regexp_extract(u, '[?&]id=([^&#]+)', 1), ''), nullif(regexp_extract(u, '/d/([^/?#]+)', 1), '')) drive_id from p""",
    "pages_domain_counts": r"select coalesce(replace(nullif(regexp_extract(lower(page_url), '^[a-z][a-z0-9+.\-]*://([^/?#]*)', 1), ''), '.', '_'), 'unknown') slug, count(*) pages from scanned_pages group by 1",
    "pages_headings": "select page_id, (i - 1)::int pos, trim(headings[i]) heading from (select page_id, headings, unnest(range(1, len(headings) + 1)) i from scanned_pages) where trim(headings[i]) <> ''",
    "pages_titles": "select page_id, coalesce(nullif(trim(page_title), ''), page_url) title from scanned_pages",
    "pages_links": r"""with l as (select page_id, page_url, unnest(list_distinct(regexp_extract_all(page_text, '(https?://[^\s<>"''=]+)', 1))) link from scanned_pages),
        k as (select *, regexp_extract(lower(page_url), '^[a-z][a-z0-9+.\-]*://([^/?#]*)', 1) b, regexp_extract(lower(link), '^[a-z][a-z0-9+.\-]*://([^/?#]*)', 1) a, regexp_replace(lower(link), '[?#].*$', '') bare from l)
        select page_id, link, a <> '' and b <> '' and suffix(a, b) internal, contains(lower(link), 'drive.google.com') or regexp_matches(bare, '\.(pdf|docx|pptx|xlsx)$') or suffix(a, 'yadi.sk') or suffix(a, 'disk.yandex.ru') download,
        regexp_matches(lower(link), '\.(mp4|avi|mov)$') media from k""",
    "page_file_names": r"select page_id, left(regexp_replace(coalesce(page_title, page_url), '[^\p{L}\p{N}_\-.]', '_', 'g'), 150) safe_name from scanned_pages",
    "graph_edge_filter": f"with {EDGES} select edge_id, head, rel, tail, round(score, 6) score from x order by score desc nulls last, first_pos limit 40",
    "graph_edge_best": f"with {EDGES} select edge_id, rel, round(score, 6) score, first_pos from x",
    "graph_edge_parse": "select event_id, 'u' || user_id head, event_type rel, 'k' || json_extract_string(props, '$.k') tail, round(value, 2)::double score, event_id::varchar edge_id from events",
    "graph_context": f"""with {EDGES}, y as (select * from x order by score desc nulls last, first_pos limit 40),
        z as (select '[Связи]' || chr(10) || string_agg('- ' || head || ' -' || rel || '→ ' || tail || case when score is null then '' else ' [score=' || printf('%.2f', score) || ']' end || chr(10) || '   <' || trim(cite) || '>', chr(10) order by score desc nulls last, first_pos) t from y)
        select case when length(t) > 8000 then left(t, 7999) || ':' else t end context from z""",
    "files_coerce": "select id, coalesce(array_to_string(list_filter(files, lambda x: x is not null and x <> ''), '|'), '') files from cached_answers",
    "word_overlap_scores": r"""with g as (select item_id, coalesce(lower(answer_ref), '') a, lower(coalesce(r, '')) r from (select item_id, answer_ref, unnest(refs) r from eval_set_gold_manual)),
        w as (select *, list_filter(regexp_split_to_array(trim(a), '\s+'), lambda x: x <> '') aw, list_filter(regexp_split_to_array(trim(r), '\s+'), lambda x: x <> '') rw from g)
        select item_id, round(max(case when r = '' then 0 when contains(r, a) or contains(a, r) then 1 else len(list_intersect(aw, rw)) / greatest(len(aw), 1) end), 6) score from w group by 1""",
    "star_revenue": "select n_name, count(*) as lines, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
}
