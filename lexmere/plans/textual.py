"""Text function queries over the documents, conversations and small reference tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from . import derived as d
from .catalog import query, table


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query(
    r"""SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(replace(nfc_normalize(text), chr(13), ''), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) AS text
    FROM documents"""
)
def normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", text.normalize_text(F.col("text")).alias("text"))


_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z0-9"''(\[])', '\1' || chr(10) || '\2', 'g'), '\n+', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"""


@query(f"SELECT doc_id, len(s) AS sentences, CAST(list_max(list_transform(s, lambda x: length(x))) AS BIGINT) AS longest, s[1] AS first FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL)")
def split_sentences(spark, sf):
    s = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", text.split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"), F.get("s", F.lit(0)).alias("first"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x) <> '')) AS paragraphs FROM documents WHERE text IS NOT NULL")
def split_paragraphs(spark, sf):
    return _docs(spark, sf).where("text IS NOT NULL").select("doc_id", F.size(text.split_paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


_SPOKEN = d.spoken("text", "{0}")
# an id that is null or below 0 leaves no such remainder: its text stands as it is
_ANY_SPOKEN = f"coalesce({_SPOKEN.format('doc_id')}, text)"


def _count(x: str, signs: str) -> str:
    return f"len(regexp_extract_all({x}, '[{signs}]'))"


@query(
    f"""WITH c AS (SELECT doc_id, {_count("t", text.HANGUL)} AS ko, {_count("t", text.HAN)} AS zh, {_count("t", "A-Za-z")} AS en FROM (SELECT doc_id, {_ANY_SPOKEN} AS t FROM documents WHERE text IS NOT NULL)),
    s AS (SELECT *, ko + zh + en AS total, greatest(ko, zh, en) AS top FROM c)
    SELECT doc_id, CASE WHEN total < 10 THEN NULL WHEN top / total < 0.6 AND (total - top - least(ko, zh, en)) / total > 0.25 THEN 'mixed' WHEN ko = top THEN 'ko' WHEN zh = top THEN 'zh' ELSE 'en' END AS language FROM s"""
)
def language_label(spark, sf):
    spoken = _docs(spark, sf).where("text IS NOT NULL").select("doc_id", F.expr(_ANY_SPOKEN).alias("t"))
    return spoken.select("doc_id", text.document_language(F.col("t")).alias("language"))


def question_sql(x: str) -> str:
    """question_language of an expression, in DuckDB SQL."""
    hangul, kana, han, letters = (_count(x, c) for c in (text.HANGUL_ALL, text.KANA, text.HAN, "A-Za-zÀ-ɏ"))
    words, every = f"len(regexp_extract_all({x}, '[A-Za-zÀ-ɏ]+'))", f"len(regexp_extract_all({x}, '\\p{{L}}'))"
    only = lambda signs: f"(length({x}) - length(translate({x}, '{signs}', '')))"
    return f"""CASE WHEN {hangul} > 0 AND {hangul} >= {kana} THEN 'ko' WHEN {kana} > 0 THEN 'other' WHEN {every} - {han} - {letters} > {han} + {letters} THEN 'other'
        WHEN {han} > 0 AND {han} >= {words} THEN CASE WHEN {only(text.TRADITIONAL)} > {only(text.SIMPLIFIED)} THEN 'zh-Hant' ELSE 'zh-Hans' END
        WHEN {words} > 0 THEN 'en' WHEN {every} - {han} - {letters} <> 0 THEN 'other' END"""


@query(f"SELECT conv_id, turn, {question_sql('t')} AS language FROM (SELECT conv_id, turn, {_SPOKEN.format('conv_id + turn')} AS t FROM conversations WHERE text IS NOT NULL)".replace("conv_id + turn %", "(conv_id + turn) %"))
def question_language(spark, sf):
    spoken = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.expr(_SPOKEN.format("(conv_id + turn)")).alias("t"))
    return spoken.select("conv_id", "turn", text.question_language(F.col("t")).alias("language"))


@query("SELECT doc_id, CAST(length(text) // 3 + 1 AS INTEGER) AS tokens, CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS INTEGER) AS chars FROM documents WHERE text IS NOT NULL")
def token_estimate(spark, sf):
    return _docs(spark, sf).where("text IS NOT NULL").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"), text.char_count(F.col("text")).alias("chars"))


@query("SELECT count(*) AS texts, count(DISTINCT trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS keys FROM documents WHERE text IS NOT NULL")
def passage_keys(spark, sf):
    return _docs(spark, sf).where("text IS NOT NULL").agg(F.count("*").alias("texts"), F.countDistinct(text.passage_key(F.col("text"))).alias("keys"))


@query(
    """SELECT r_regionkey, '| region | nation |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_name || ' | ' || n_name || ' |', chr(10) ORDER BY n_name) AS markdown
    FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey"""
)
def markdown_table(spark, sf):
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    rows = r.join(F.broadcast(n), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", "r_name"))).alias("rows"))
    head = F.array(F.array(F.lit("region"), F.lit("nation")))
    return rows.select("r_regionkey", text.table_markdown(F.concat(head, F.transform("rows", lambda x: F.array(x["r_name"], x["n_name"])))).alias("markdown"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(url, '^.*/', ''), '[<>:\"|?*]', '_', 'g')) AS name FROM pages WHERE url IS NOT NULL")
def safe_names(spark, sf):
    return table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query("SELECT p_partkey, CASE WHEN trim(regexp_replace(p_name, '\\s+', ' ', 'g')) <> '' THEN trim(regexp_replace(p_name, '\\s+', ' ', 'g')) END AS folder FROM part")
def folder_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.folder_name(F.col("p_name")).alias("folder"))


@query("SELECT regexp_replace(regexp_replace(o_orderpriority, '\\s+', '', 'g'), '[0-9]+', '#', 'g') AS key, count(*) AS orders FROM orders GROUP BY key")
def digit_masks(spark, sf):
    return table(spark, sf, "orders").groupBy(text.digit_mask(F.col("o_orderpriority")).alias("key")).agg(F.count("*").alias("orders"))


@query("SELECT doc_id, CAST(ceil(length(text) / 100.0) AS BIGINT) AS pieces, substr(text, 101, 100) AS second FROM documents WHERE length(text) > 100")
def fixed_pieces(spark, sf):
    p = _docs(spark, sf).where("length(text) > 100").select("doc_id", text.fixed_pieces(F.col("text"), 100).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("pieces"), F.element_at("p", 2).alias("second"))


_ANSWER = "'Text [' || (item_id % 3 + 1) || '] and [2, ' || (item_id % 5 + 1) || '] **bold** end [x].'"


def _answers(spark, sf):
    n = F.col("item_id")
    answer = F.concat(F.lit("Text ["), (n % 3 + 1).cast("string"), F.lit("] and [2, "), (n % 5 + 1).cast("string"), F.lit("] **bold** end [x]."))
    return table(spark, sf, "benchmark").select("item_id", answer.alias("answer"))


@query("SELECT item_id, array_to_string(list_sort(list_distinct([item_id % 3 + 1, 2, item_id % 5 + 1])), ',') AS cited FROM benchmark")
def citation_extract(spark, sf):
    return _answers(spark, sf).select("item_id", F.array_join(text.cited_numbers(F.col("answer")).cast("array<string>"), ",").alias("cited"))


@query(
    """SELECT item_id, CASE WHEN a = 2 AND b = 2 THEN '2' WHEN a = 2 THEN '2,' || b WHEN b = a OR b = 2 THEN a || ',2' ELSE a || ',2,' || b END AS cited
    FROM (SELECT item_id, item_id % 3 + 1 AS a, item_id % 5 + 1 AS b FROM benchmark)"""
)
def citation_order(spark, sf):
    return _answers(spark, sf).select("item_id", F.array_join(text.cited_numbers(F.col("answer"), True).cast("array<string>"), ",").alias("cited"))


@query(f"SELECT item_id, replace({_ANSWER}, '**', '') AS answer FROM benchmark")
def clean_answers(spark, sf):
    return _answers(spark, sf).select("item_id", text.clean_answer(F.col("answer")).alias("answer"))


@query("SELECT item_id, 5 AS parts, 'Text ' AS first, '[2, ' || (item_id % 5 + 1) || ']' AS second_cite FROM benchmark")
def answer_parts(spark, sf):
    p = _answers(spark, sf).select("item_id", text.answer_parts(F.col("answer")).alias("p"))
    return p.select("item_id", F.size("p").alias("parts"), F.element_at("p", 1)["text"].alias("first"), F.element_at("p", 4)["text"].alias("second_cite"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(
    f"""SELECT ask_id, string_agg(t, ' ' ORDER BY -length(t), i) AS terms FROM (
        SELECT ask_id, t, min(i) AS i FROM (SELECT ask_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT ask_id, string_split_regex(question, '[\\s,，。、；;：:!?！？()（）"''“”]+') AS w FROM questions))
        WHERE length(t) >= 3 AND lower(t) NOT IN ({_STOP}) GROUP BY ask_id, t) GROUP BY ask_id""".replace("SELECT ask_id, string_agg", d.with_(d.QUESTIONS) + "SELECT ask_id, string_agg", 1)
)
def highlight_terms(spark, sf):
    return d.questions(spark, sf).select("ask_id", F.array_join(text.highlight_terms(F.col("question")), " ").alias("terms")).where("terms <> ''")


@query("SELECT item_id, regexp_replace(text, '(tion|the)', '<mark>\\1</mark>', 'gi') AS marked FROM benchmark")
def highlight_markup(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.highlighted(F.col("text"), F.array(F.lit("tion"), F.lit("the"))).alias("marked"))


@query(d.with_(d.PASSAGES) + "SELECT vec_id, CASE WHEN token_count >= 165 THEN 'strong' WHEN token_count >= 150 THEN 'good' ELSE 'weak' END AS band FROM passages")
def relevance_band(spark, sf):
    return d.passages(spark, sf).select("vec_id", text.relevance_band((F.col("token_count") - 100) / 100).alias("band"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS shown, '<text redacted, ' || length(text) || ' chars>' AS hidden FROM documents WHERE text IS NOT NULL")
def text_preview(spark, sf):
    return _docs(spark, sf).where("text IS NOT NULL").select("doc_id", text.redacted(F.col("text"), False).alias("shown"), text.redacted(F.col("text"), True).alias("hidden"))


@query("SELECT item_id, trim(substr(text, length(split_part(text, ' ', 1)) + 1)) AS body FROM benchmark")
def strip_repeated_heading(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.passage_body(F.col("text"), F.substring_index("text", " ", 1)).alias("body"))


@query("SELECT c_custkey, lower(trim(c_name)) AS key FROM customer")
def username_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.username_key(F.col("c_name")).alias("key"))


@query("SELECT item_id, '<source id=\"' || item_id || '\" file=\"f.pdf\" pages=\"1-2\" section=\"A ''b''\">' || chr(10) || trim(text) || chr(10) || '</source>' AS block FROM benchmark")
def source_blocks(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.source_block(F.col("item_id"), F.lit("f.pdf"), text.page_label(F.lit("f.pdf"), F.lit(1), F.lit(2)), F.lit('A "b"'), F.col("text")).alias("block"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS message FROM events")
def event_messages(spark, sf):
    from ..operators.rag import event_text

    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), event_text(F.col("event_type"), F.col("props")).alias("message"))


@query("""SELECT item_id, CASE WHEN item_id % 4 = 0 THEN NULL ELSE 'w' || item_id END AS delta FROM benchmark""")
def stream_deltas(spark, sf):
    from ..operators.rag import delta_text

    n = F.col("item_id").cast("string")
    line = F.when(F.col("item_id") % 4 == 0, "data: [DONE]").otherwise(F.concat(F.lit('data: {"choices":[{"delta":{"content":"w'), n, F.lit('"}}]}')))
    return table(spark, sf, "benchmark").select("item_id", delta_text(line).alias("delta"))
