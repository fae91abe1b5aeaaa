"""Lines, sentences and answers of given texts: kinds of lines, lines rejoined, languages checked, requests checked, folders created."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import access, tree
from . import derived as d
from .catalog import query, table
from .textual import _SPOKEN, _count, question_sql

# every text with the marks of a page below it: its number in two forms, and two points of a list
_MARKED = "concat(text, chr(10), 'Page ', doc_id, chr(10), '- ', doc_id, ' -', chr(10), '• first:', chr(10), '(3) third')"


def _hits(pattern: str, of: str = "x") -> str:
    return f"len(list_filter(t, lambda x: regexp_matches({of}, '{pattern}')))"


@query(
    f"""SELECT doc_id, len(t) AS lines, {_hits(r"(?i)^[^\p{L}]*(?:page|p\.)?[^\p{L}]*$")} AS page_numbers, {_hits(text.LIST_MARKER)} AS list_points, {_hits(text.PARAGRAPH_END.replace("'", "''"))} AS paragraph_ends
    FROM (SELECT doc_id, string_split({_MARKED}, chr(10)) AS t FROM documents WHERE text IS NOT NULL)"""
)
def line_kinds(spark, sf):
    lines = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.split(F.expr(_MARKED), "\n", -1).alias("t"))

    def hits(pattern):
        return F.size(F.filter("t", lambda x: x.rlike(pattern))).cast("long")

    return lines.select("doc_id", F.size("t").cast("long").alias("lines"), hits(text.PAGE_NUMBER).alias("page_numbers"), hits(text.LIST_MARKER).alias("list_points"), hits(text.PARAGRAPH_END).alias("paragraph_ends"))


# breaks at spaces behind some words: plain, behind a hyphen, behind a soft hyphen
_BREAKS = (("([ae]) ", "\\1\n"), ("(on|re) ", "\\1-\n"), ("(in|é) ", "\\1\u00ad\n"))
_BROKEN = "x"
for _word, _break in _BREAKS:
    _BROKEN = f"regexp_replace({_BROKEN}, '{_word}', '{_break}', 'g')"
# joins in an order that gives what a walk from break to break does: a hyphen kept by one join makes the next one's word a compound
_REJOINED = f"regexp_replace({_BROKEN}, '\\s*\\n\\s*', '\n', 'g')"
for _left, _to in [("\u00ad\n", ""), ("([\\p{L}\\p{N}]-)\n([\\p{Lu}\\p{Nd}])", "\\1\\2"), *[("([\\p{L}\\p{N}]-\\S*[\\p{L}\\p{N}]-)\n([\\p{L}\\p{N}])", "\\1\\2")] * 8, *[("(\\p{L})-\n(\\p{Ll})", "\\1\\2")] * 2, ("\n([.,;:!?%)\\]}])", "\\1"), ("\n", " ")]:
    _REJOINED = f"regexp_replace({_REJOINED}, '{_left}', '{_to}', 'g')"


@query(f"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim({_REJOINED})), chr(10)) AS joined FROM documents WHERE text IS NOT NULL")
def wrapped_lines(spark, sf):
    """Every paragraph is broken into lines and joined again."""

    def joined(paragraph):
        for word, at in _BREAKS:
            paragraph = F.regexp_replace(paragraph, word, at.replace("\\1", "$1"))
        lines = F.transform(F.split(paragraph, "\n", -1), lambda x: F.struct(x.alias("text"), F.lit(False).alias("trailing_space")))
        return text.join_wrapped_lines(lines)

    own = table(spark, sf, "documents").where("text IS NOT NULL")
    return own.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), joined), "\n").alias("joined"))


_WIDE_GAP = f"([{text.WIDE}]) +([{text.WIDE}])"


@query(
    f"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(t, lambda x, i: CASE WHEN i % 3 = 1 THEN '更换滤芯。' WHEN i % 3 = 2 THEN ' 请关闭电源' ELSE trim(x) END), lambda x: x <> ''), ' '), ' +', ' ', 'g'), '{_WIDE_GAP}', '\\1\\2', 'g') AS joined
    FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL)"""
)
def joined_sentences(spark, sf):
    """Each document's lines, two of three replaced by Chinese sentences, as one text."""
    made = lambda x, i: F.when(i % 3 == 0, "更换滤芯。").when(i % 3 == 1, " 请关闭电源").otherwise(x)
    own = table(spark, sf, "documents").where("text IS NOT NULL")
    return own.select("doc_id", F.regexp_replace(text.join_sentences(F.transform(F.split("text", "\n", -1), made)), " +", " ").alias("joined"))


_TURN = "(conv_id + turn)"
_ASKED = "CASE conv_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ko' WHEN 2 THEN 'zh-Hans' ELSE 'zh-Hant' END"
_ONLY = {name: f"(length(t) - length(translate(t, '{signs}', '')))" for name, signs in (("traditional", text.TRADITIONAL), ("simplified", text.SIMPLIFIED))}


@query(
    f"""WITH s AS (SELECT conv_id, turn, {_ASKED} AS asked, {_SPOKEN.format(_TURN)} AS t FROM conversations WHERE text IS NOT NULL),
    f AS (SELECT *, {question_sql("t")} AS found, {_ONLY["traditional"]} AS traditional, {_ONLY["simplified"]} AS simplified, {_count("t", text.HAN)} AS han, {_count("t", "A-Za-zÀ-ɏ")} AS latin FROM s)
    SELECT conv_id, turn, asked, found, CASE WHEN traditional > simplified THEN 'zh-Hant' ELSE 'zh-Hans' END AS script,
        CASE WHEN found IS NULL OR found = asked THEN true WHEN asked = 'en' THEN found NOT IN ('ko', 'other') AND han <= latin WHEN asked = 'ko' OR found NOT LIKE 'zh%' THEN false
        WHEN asked = 'zh-Hans' THEN NOT (traditional >= 3 AND simplified = 0) ELSE NOT (simplified >= 3 AND traditional = 0) END AS passes FROM f"""
)
def answers_in_language(spark, sf):
    """Whether each turn passes as written in the language that its conversation asked for."""
    t = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.expr(_ASKED).alias("asked"), F.expr(_SPOKEN.format(_TURN)).alias("t"))
    said = F.col("t")
    return t.select("conv_id", "turn", "asked", text.question_language(said).alias("found"), text.chinese_script(said).alias("script"), text.is_in_language(said, F.col("asked")).alias("passes"))


# answers of a model that thinks first: not at all, to an end, and without one
_THOUGHT = "CASE (conv_id + turn) % 3 WHEN 0 THEN text WHEN 1 THEN concat(' <think>', chr(10), 'is it so?', chr(10), '</think>', chr(10), text) ELSE concat('<think>', text) END"


@query(f"SELECT conv_id, turn, regexp_replace({_THOUGHT}, '^\\s*<think>.*?(</think>\\s*|$)', '', 's') AS answer FROM conversations WHERE text IS NOT NULL")
def answers_without_thoughts(spark, sf):
    t = table(spark, sf, "conversations").where("text IS NOT NULL")
    return t.select("conv_id", "turn", text.think_filtered(F.expr(_THOUGHT)).alias("answer"))


_HELD = "substr(text, 1, CAST((conv_id * 31 + turn * 17) % 160 AS INT))"


@query(f"SELECT conv_id, turn, length(h) AS held, length(h) >= 120 OR (length(h) >= 12 AND regexp_matches(h, '[.!?](?:\\s|$)|[。！？\\n]')) AS ready FROM (SELECT conv_id, turn, {_HELD} AS h FROM conversations WHERE text IS NOT NULL)")
def answers_ready(spark, sf):
    """Whether what has come of an answer is enough to judge its language."""
    t = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.expr(_HELD).alias("h"))
    return t.select("conv_id", "turn", F.length("h").cast("long").alias("held"), text.ready_to_check(F.col("h")).alias("ready"))


# requests: some without text, some too long, with counts from -1 to 149 and without one
_REQUEST = "CASE doc_id % 5 WHEN 0 THEN concat('  ', source, ' ') WHEN 1 THEN '  ' ELSE text END"
_ASKED_FOR = "CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 151 - 1 AS INT) END"


@query(
    f"""WITH r AS (SELECT doc_id, {_REQUEST} AS q, {_ASKED_FOR} AS k FROM documents WHERE doc_id IS NOT NULL),
    e AS (SELECT *, CASE WHEN coalesce(trim(q, ' ' || chr(10)), '') = '' OR length(q) > 2000 THEN 'query' WHEN k < 1 THEN 'top_k' END AS error FROM r)
    SELECT doc_id, CASE WHEN error IS NULL THEN trim(q, ' ' || chr(10)) END AS query, CASE WHEN error IS NULL THEN least(coalesce(k, 10), 100) END AS top_k, error FROM e"""
)
def search_requests(spark, sf):
    own = table(spark, sf, "documents").where("doc_id IS NOT NULL")
    return own.select("doc_id", access.checked_search(F.expr(_REQUEST), F.expr(_ASKED_FOR)).alias("r")).select("doc_id", "r.*")


@query(d.with_(d.PASSAGES) + "SELECT vec_id FROM passages WHERE language = 'en' AND kind IS DISTINCT FROM 'heading'")
def filters_of_readers(spark, sf):
    """A reader's filters on owner and visibility do not count, the one on language does."""
    asked = access.user_filters({"owner_id": "src1", "visibility": "public", "language": "en"}, is_admin=False)
    return d.passages(spark, sf).where(access.matching(asked) & access.searchable()).select("vec_id")


@query(d.with_(d.FOLDERS) + "SELECT folder_id, parent_id, name FROM folders UNION ALL SELECT 'new', 'n3', 'Archive'")
def tree_create(spark, sf):
    return tree.create(d.folders(spark, sf), "new", "n3", "Archive", most=None)
