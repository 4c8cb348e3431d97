"""Queries of the training-text operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import abuse, boilerplate, langid, leakage, mixing, neardup, pairs, sitelines, tokens
from tessella.plans.oracles import TOKEN, clean
from tessella.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    both = [("eval_set_gold_manual", "item_id", "answer_ref"), ("cached_answers", "id", "answer")]
    rows = [table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(i).alias("row_id"), F.col("question").alias("q"), F.col(a).alias("a")) for t, i, a in both]
    return pairs.pair_defects(rows[0].unionByName(rows[1]), "row_id", "q", "a", keep=("tbl",))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "scanned_pages")
    return boilerplate.furniture_lines(pages, boilerplate.fit_on(pages)).select("page_id", "line_no").distinct()


def p2_main_text(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "scanned_pages")
    return boilerplate.main_text(pages, boilerplate.fit_on(pages))


def _counted(spark: SparkSession, d: str, tokenizer: str = tokens.OWN) -> DataFrame:
    return tokens.record_tokens(table(spark, d, "document_records"), table(spark, d, "documents"), table(spark, d, "scanned_pages"), tokenizer)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return tokens.unreliable_counts(_counted(spark, d))


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals in tokens of a public byte-level BPE."""
    return tokens.token_totals(_counted(spark, d, f"bpe:{tokens.bpe_path()}"))


def p3_own_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals in the project's own tokens."""
    return tokens.token_totals(_counted(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.similar_pairs(table(spark, d, "scanned_pages"))
    return pairs.select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b")).distinct()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between different texts; ``p4_members`` has the pages of each text."""
    found = neardup.representative_pairs(table(spark, d, "scanned_pages"))[0]
    return found.select(F.least("a", "b").alias("rep_a"), F.greatest("a", "b").alias("rep_b"), F.round("similarity", 6).alias("similarity"))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return neardup.representative_pairs(table(spark, d, "scanned_pages"))[1].withColumnRenamed("id", "page_id")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.page_groups(table(spark, d, "scanned_pages")).withColumnRenamed("id", "page_id")


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.record_languages(table(spark, d, "document_records"), table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(_languages(spark, d))


def p5_passages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every record (passage_no 0; ``und`` where no language fits), and of the stretches that cover a mixed text (from 1)."""
    found = _languages(spark, d).where("main is not null").withColumn("x", F.explode(F.concat(
        F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.when(F.col("refused"), langid.UNKNOWN).otherwise(F.col("main")).alias("lang"), "confidence", "ambiguous", F.lit(0).alias("no"))),
        F.transform(F.when(F.size("langs") > 1, F.col("cover")).otherwise(F.slice("cover", 1, 0)), lambda c, i: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["lang"].alias("lang"), c["confidence"].alias("confidence"), c["ambiguous"].alias("ambiguous"), (i + 1).alias("no"))),
    )))
    return found.select("record_id", F.col("x.no").alias("passage_no"), F.col("x.lang").alias("lang_code"), F.col("x.confidence").alias("confidence"), "x.ambiguous", "x.start", "x.end")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.repeated_lines(table(spark, d, "scanned_pages")).select("site", "line_key")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "scanned_pages")
    return sitelines.without_repeats(pages, sitelines.repeated_lines(pages), sitelines.repeated_passages(pages))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_set_gold_manual"))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.near_matches(table(spark, d, "documents"), table(spark, d, "eval_set_gold_manual"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_own_quotas(spark: SparkSession, d: str) -> DataFrame:
    """The apportionment by the project's own tokens, which SQL can count too."""
    found = mixing.apportioned(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=tokens.OWN)
    return found.withColumn("wanted_share", F.round("wanted_share", 9))


def _scores(spark: SparkSession, d: str, keep: tuple[str, ...]) -> DataFrame:
    docs = table(spark, d, "documents")
    model = abuse.fit_on(docs, table(spark, d, "doc_labels"))
    return abuse.scored(docs.where("doc_id is not null") if "doc_id" in keep else docs, model, keep)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.flagged(_scores(spark, d, ("doc_id",)))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, ("doc_id",)).select("doc_id", *[F.round(c, 6).alias(c) for c in abuse.CATEGORIES])


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(_scores(spark, d, ("source",)))


def queries() -> dict[str, Query]:
    named = [
        p1_found, p2_found, p2_main_text, p3_found, p3_totals, p3_own_totals, p4_found, p4_pairs, p4_members, p4_groups, p5_found, p5_passages, p6_found, p6_cleaned, p7_found, p7_near, p8_selection, p8_shares, p8_own_quotas, p9_found, p9_scores, p9_rates,
    ]
    return {f.__name__: f for f in named}


LINE_KEY = r"lower(regexp_replace(trim(regexp_replace(line, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g')), '\p{Nd}+', '0', 'g'))"
SITE = r"nullif(regexp_replace(regexp_extract(lower(trim(page_url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)', 1), '^www\.', ''), '')"
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"


def _words(c: str) -> str:
    """Word list as the operators see it. DuckDB has no NFKC; in these tables it changes the no-break space and, on pages, the number sign."""
    return rf"regexp_extract_all({c}, '[\p{{L}}\p{{N}}]+')"


def _visible(c: str) -> str:
    return f"lower(regexp_replace(replace({c}, chr(160), ' '), '{INVISIBLE}', '', 'g'))"


def _grams(n: int) -> str:
    return f"array_to_string(w[i:i + {n - 1}], ' ')"


PAGE_SETS = f"""w as (select page_id, {_words('lower(page_text)')} w from scanned_pages where len({_words('lower(page_text)')}) > 2),
    u as (select page_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: {_grams(3)}))) s from w),
    s as (select page_id, s, min(page_id) over (partition by s) rep, count(*) over (partition by s) copies from u)"""
RECORDS = f"""d as (select source_path, source, len(regexp_extract_all(lower({clean('text')}), '{TOKEN}')) n from documents where source_path is not null),
    p as (select pdf_file_name, clean_text_hash, max(len(regexp_extract_all(lower({clean("replace(page_text, '№', 'No')")}), '{TOKEN}'))) n, min({SITE}) site from scanned_pages where pdf_file_name is not null and clean_text_hash is not null group by 1, 2),
    r as (select record_id, tokens, lower(coalesce(language, '')) language, coalesce(d.n, p.n) n, case when d.n is not null then 'documents' when p.n is not null then 'scanned_pages' end origin, coalesce(case when d.n is not null then d.source else p.site end, 'unknown') "domain"
      from document_records x left join d using (source_path) left join p on d.n is null and p.pdf_file_name = string_split(x.source_path, '/')[-1] and p.clean_text_hash = x.content_hash)"""
DOC_WORDS = rf"""v as (select doc_id, {_visible('text')} t from documents where text is not null),
    j as (select doc_id, t, regexp_replace(t, '(\p{{L}})[-‐‑]{WHITE}*\n{WHITE}*(\p{{L}})', '\1\2', 'g') t2 from v),
    dw as (select doc_id, 0 variant, {_words('t')} w from j union all select doc_id, 1, {_words('t2')} from j where t2 <> t)"""
ITEM_WORDS = f"""x as (select item_id, unnest([question, answer_ref] || coalesce(refs, [])) t from eval_set_gold_manual),
    iw as (select item_id, {_words(_visible('t'))} w from x where t is not null),
    runs as (select distinct item_id, w[i:i + 7] run from (select item_id, w, unnest(range(1, len(w) - 6)) i from iw))"""


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables, where SQL can say it."""
    return {
        "p3_found": f"with {RECORDS} select distinct record_id from r where tokens is null or abs(tokens - n) * 10 > n",
        "p3_own_totals": rf"""with {RECORDS}, b as (select regexp_extract(language, '([a-z]+)', 1) b, * from r where n is not null),
            l as (select origin, "domain", n, case when b in ('', 'unknown', 'und') then 'unknown' else coalesce(map {{'rus': 'ru', 'eng': 'en', 'ukr': 'uk', 'deu': 'de', 'ger': 'de', 'fra': 'fr', 'fre': 'fr'}}[b], b) end lang from b)
            select coalesce(origin, '*') origin, coalesce(lang, '*') lang, coalesce("domain", '*') "domain", count(*) records, sum(n)::bigint total_tokens from l
            group by grouping sets ((origin, lang, "domain"), (origin), (lang), ("domain"), ())""",
        "p4_found": f"""with w as (select page_id, {_words('lower(page_text)')} w from scanned_pages),
            s as (select distinct page_id, {_grams(3)} g from (select page_id, w, unnest(range(1, len(w) - 1)) i from w)), n as (select page_id, count(*) n from s group by 1),
            b as (select a.page_id page_id_a, b.page_id page_id_b, count(*) both_have from s a join s b on a.g = b.g and a.page_id < b.page_id group by 1, 2)
            select page_id_a, page_id_b from b join n x on x.page_id = page_id_a join n y on y.page_id = page_id_b where both_have >= 0.6 * (x.n + y.n - both_have)""",
        "p4_members": f"with {PAGE_SETS} select page_id, rep, copies from s",
        "p4_pairs": f"""with {PAGE_SETS}, n as (select page_id, len(s) n from s where page_id = rep), f as (select page_id, unnest(s) g from s where page_id = rep),
            b as (select x.page_id rep_a, y.page_id rep_b, count(*) both_have from f x join f y on x.g = y.g and x.page_id < y.page_id group by 1, 2)
            select rep_a, rep_b, round(both_have / (x.n + y.n - both_have), 6) similarity from b join n x on x.page_id = rep_a join n y on y.page_id = rep_b where both_have >= 0.6 * (x.n + y.n - both_have)""",
        "p4_groups": f"""with recursive {PAGE_SETS}, f as (select page_id, len(s) n, unnest(s) g from s where page_id = rep),
            b as (select x.page_id a, y.page_id b, count(*) both_have, any_value(x.n) + any_value(y.n) total from f x join f y on x.g = y.g and x.page_id <> y.page_id group by 1, 2),
            e as (select a, b from b where both_have >= 0.6 * (total - both_have)),
            r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a), g as (select a, least(a, min(b)) g from r group by a)
            select p.page_id, coalesce(g.g, s.rep, p.page_id) group_id, coalesce(s.copies, 1) copies from scanned_pages p left join s on s.page_id = p.page_id left join g on g.a = s.rep""",
        "p8_own_quotas": f"""with t as (select source, sum(greatest(coalesce(target_share, 0), 0)) target_share, max(greatest(coalesce(max_repeats, 1), 0)) max_repeats from mix_targets where source is not null group by 1),
            c as (select source, len(regexp_extract_all(lower({clean('text')}), '{TOKEN}')) n from documents),
            h as (select t.*, coalesce(docs, 0) docs, coalesce(tokens, 0) tokens, row_number() over (order by source) i from t left join (select source, count(*) docs, sum(n)::bigint tokens from c where n > 0 group by 1) using (source)),
            a as (select *, target_share / sum(target_share) over () share from h where tokens > 0 and target_share > 0 and max_repeats > 0),
            w as (select least(floor(min(max_repeats * tokens / share)), sum(max_repeats * tokens))::bigint total from a),
            z as (select total, greatest(1, total // 20000) block, total // greatest(1, total // 20000) blocks from w),
            k as (select source, i, target_share, unnest(range(0, least(max_repeats * tokens // block, blocks)::bigint)) k from a, z),
            m as (select source, count(*) won from (select *, row_number() over (order by target_share / (2 * k + 1) desc, i) rn from k), z where rn <= blocks group by 1)
            select h.source, h.target_share, h.max_repeats, h.docs, h.tokens available_tokens, (coalesce(won, 0) * block)::bigint quota_tokens, round(coalesce(a.share, 0), 9) wanted_share
            from h cross join z left join m on m.source = h.source left join a on a.source = h.source""",
        "p6_found": f"""
            with l as (select page_id, {SITE} site, unnest(string_split(page_text, chr(10))) line from scanned_pages),
            k as (select distinct site, page_id, {LINE_KEY} line_key from l),
            s as (select {SITE} site, count(*) n from scanned_pages group by 1)
            select k.site, line_key from k join s on s.site = k.site where line_key <> ''
            group by k.site, line_key, n having count(*) >= 5 and count(*) * 10 >= n""",
        "p7_found": f"""with {DOC_WORDS}, {ITEM_WORDS}, g as (select distinct doc_id, {_grams(8)} g from (select doc_id, w, unnest(range(1, len(w) - 6)) i from dw))
            select distinct doc_id, item_id from g join (select item_id, array_to_string(run, ' ') g from runs) using (g)""",
        "p7_near": f"""with {DOC_WORDS}, {ITEM_WORDS}, df as (select term, count(*) df from (select distinct doc_id, unnest(w) term from dw where variant = 0) group by 1),
            u as (select run, unnest(run) term, unnest(range(8)) off from (select distinct run from runs)), m as (select run, term, min(off) off from u group by 1, 2),
            a as (select run, term from m left join df using (term) qualify row_number() over (partition by run order by coalesce(df, 0), off) <= 3),
            o as (select doc_id, w, unnest(w) term, unnest(range(1, len(w) + 1)) pos from dw where len(w) > 0),
            h as (select doc_id, run, max(len(list_intersect(list_distinct(run), w[greatest(pos - 8, 1):pos + 8]))) matched from o join a using (term) group by 1, 2)
            select doc_id, item_id, max(matched) matched from h join runs using (run) where matched >= 6 group by 1, 2""",
    }
