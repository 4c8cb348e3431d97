"""Graph edges: parsing of formatted lines, predicate and score filter, best edge per key, context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import chop, py_strip

# Predicates that pass the filter.
ALLOWED = (
    "includes", "supports", "partners_with", "offers", "used_for", "targets", "improves", "enables", "develops", "aligns_with",
    "author", "conducts", "regulates", "requires", "part_of", "is_a", "uses", "has", "based_on", "developed_by",
)
LIMIT, CITE, TOTAL = 40, 240, 8000
# Patterns of a formatted edge line.
WHOLE_LINE, REL_LINE = r"-\s*(.*?)\s*-\s*([a-zA-Z_]+)\s*→\s*(.*?)(?:\s*\[|$)", r"-\s*([a-zA-Z_]+)\s*→"
SCORE_LINE, ID_LINE = r"\[score=([0-9]+(?:\.[0-9]+)?)\]", r"\[#edge:(\d+)\]"
# Titles of the sections of a context, and what stands for a missing relation or name.
EDGES, STRUCTURE, ANCHORS, SUMMARY = "[Связи]", "[Структура]", "[Якорные узлы] ", "[Сводка сообщества #"
LISTS = (("programs", "• Программы/проекты: "), ("partners", "• Партнёры: "), ("audiences", "• Аудитории/адресаты: "))
RELATED, NOBODY = "related_to", "?"


def parse_edge(line: Column) -> Column:
    """head, rel, tail, score, edge_id of a line '- head -rel→ tail [score=x] [#edge:n]'; missing parts are null."""
    got = lambda p, g: F.nullif(py_strip(F.regexp_extract(line, p, g)), F.lit(""))
    return F.struct(
        got(WHOLE_LINE, 1).alias("head"),
        F.coalesce(got(REL_LINE, 1), got(WHOLE_LINE, 2)).alias("rel"),
        got(WHOLE_LINE, 3).alias("tail"),
        got(SCORE_LINE, 1).try_cast("double").alias("score"),
        got(ID_LINE, 1).alias("edge_id"),
    )


def predicate(rel: Column) -> Column:
    return F.replace(F.lower(py_strip(F.coalesce(rel, F.lit("")))), F.lit(" "), F.lit("_"))


def filter_edges(edges: DataFrame, min_score: float = 0.0, allowed: tuple[str, ...] = ALLOWED, limit: int | None = LIMIT, form: str = "line") -> DataFrame:
    """Best edges by score (nulls last, then first seen), one per key; ``edges`` have pos, head, rel, tail, score, edge_id, cite.

    Edges that were formatted lines (``form="line"``) pass without a relation, which then reads ``related_to``; structured edges
    (``form="dict"``, whose relation and key may also be in ``predicate`` and ``id``) take that name first and must then be allowed like any
    other. A null score passes. The key is edge_id, else head|predicate|tail. Equal scores keep the first edge;
    a key keeps the place where it was first seen. One aggregation, then a bounded top-n; a limit of 0 or none keeps all.
    """
    either = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.nullif(F.col(b), F.lit(""))) if b in edges.columns else F.nullif(a, F.lit(""))
    rel, own = (either(F.col("rel"), "predicate"), either(F.col("edge_id"), "id")) if form == "dict" else (F.nullif("rel", F.lit("")), F.nullif("edge_id", F.lit("")))
    named = F.coalesce(rel, F.lit(RELATED))
    e = edges.withColumn("pred", predicate(named if form == "dict" else rel))
    e = e.where(((F.col("pred") == "") | F.col("pred").isin([a.lower() for a in allowed])) & (F.col("score").isNull() | (F.col("score") >= min_score)))
    head, tail = F.coalesce(F.nullif("head", F.lit("")), F.lit(NOBODY)), F.coalesce(F.nullif("tail", F.lit("")), F.lit(NOBODY))
    key = F.coalesce(own, F.concat_ws("|", head, "pred", tail))
    e = e.select("pos", key.alias("edge_id"), head.alias("head"), named.alias("rel"), tail.alias("tail"), "score", "cite")
    order = F.struct(F.col("score").isNotNull().alias("known"), F.coalesce("score", F.lit(0.0)).alias("s"), (-F.col("pos")).alias("p"))
    best = e.groupBy("edge_id").agg(F.min("pos").alias("first_pos"), F.max_by(F.struct("head", "rel", "tail", "score", "cite"), order).alias("b"))
    best = best.select("edge_id", "first_pos", "b.*")
    return best.orderBy(F.desc_nulls_last("score"), "first_pos").limit(limit) if limit and limit > 0 else best


def edge_line(cites: bool = True) -> Column:
    """Text of an edge with its score to two places and, on the next line, its source."""
    score = F.when(F.col("score").isNotNull(), F.format_string(" [score=%.2f]", F.col("score"))).otherwise("")
    line = F.concat(F.lit("- "), "head", F.lit(" -"), "rel", F.lit("→ "), "tail", score)
    cite = py_strip(F.coalesce("cite", F.lit("")))
    return F.concat(line, F.when(cite != "", F.concat(F.lit("\n   <"), chop(cite, CITE), F.lit(">"))).otherwise("")) if cites else line


def edge_context(edges: DataFrame, title: str = EDGES, limit: int = TOTAL) -> DataFrame:
    """One row: the bounded list of filtered edges as text, at most ``limit`` characters."""
    lines = edges.select(F.struct(F.coalesce(-F.col("score"), F.lit(1e308)).alias("s"), "first_pos", edge_line().alias("line")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    text = F.concat_ws("\n", F.lit(title), F.array_join(F.transform("x", lambda x: x["line"]), "\n"))
    return lines.where(F.size("x") > 0).select(chop(text, limit).alias("context"))


def graph_context(ctx: DataFrame, key: str, limit_edges: int = LIMIT, cites: bool = True, limit: int = TOTAL) -> DataFrame:
    """(key, context) of nested graph contexts: summaries, structure lists, edges, anchors; empty parts are left out.

    ``ctx`` has community_summaries, programs, partners, audiences, edges (head, rel, tail, score, cite) and anchors arrays. The first
    ``limit_edges`` edges are shown, with their sources if ``cites``; the whole is cut to ``limit`` characters.
    """
    n = lambda c: F.coalesce(F.col(c), F.array())
    text = lambda x, d: F.coalesce(x.cast("string"), F.lit(d))
    head = lambda x: F.concat(F.lit(SUMMARY), (x["i"] + 1).cast("string"), F.lit(" (L"), text(x["s"]["level"], "None"), F.lit(", id="), text(x["s"]["community_id"], "None"), F.lit(")]\n"))
    numbered = F.transform(F.col("community_summaries"), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    told = F.filter(numbered, lambda x: py_strip(F.coalesce(x["s"]["summary"], F.lit(""))) != "")
    summ = F.transform(told, lambda x: F.concat(head(x), chop(py_strip(x["s"]["summary"]), 1200)))
    part = lambda c, t: F.when(F.size(n(c)) > 0, F.concat(F.lit(t), chop(F.array_join(F.slice(c, 1, 12), ", "), 600)))
    listed = F.array_compact(F.array(*[part(c, t) for c, t in LISTS]))
    structure = F.when(F.size(listed) > 0, F.concat(F.lit(STRUCTURE + "\n"), F.array_join(listed, "\n")))
    q = lambda x, d: F.coalesce(F.nullif(x, F.lit("")), F.lit(d))
    score = lambda x: F.when(x.isNotNull(), F.format_string(" [score=%.2f]", x)).otherwise("")
    cite = lambda x: F.when(py_strip(F.coalesce(x, F.lit(""))) != "", F.concat(F.lit("\n   <"), chop(py_strip(x), CITE), F.lit(">"))).otherwise("") if cites else F.lit("")
    rows = F.transform(F.slice("edges", 1, limit_edges), lambda e: F.concat(F.lit("- "), q(e["head"], NOBODY), F.lit(" -"), q(e["rel"], RELATED), F.lit("→ "), q(e["tail"], NOBODY), score(e["score"]), cite(e["cite"])))
    edges = F.when(F.size(n("edges")) > 0, F.concat(F.lit(EDGES + "\n"), F.array_join(rows, "\n")))
    names = F.transform("anchors", lambda a: F.concat(q(a["name"], NOBODY), F.lit(" ("), q(a["type"], NOBODY), F.lit(")")))
    anchors = F.when(F.size(n("anchors")) > 0, F.concat(F.lit(ANCHORS), F.array_join(names, ", ")))
    first = F.when(F.size(summ) > 0, F.array_join(summ, "\n\n"))
    whole = F.array_join(F.array_compact(F.array(first, structure, edges, anchors)), "\n\n")
    return ctx.select(key, chop(whole, limit).alias("context"))
