"""Text functions as column expressions: normalising, sentences, languages, passages.

Character classes are fixed values: the ranges name scripts and their punctuation.
"""

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# fixed values: script ranges, terminators, hyphens, and signs that take no space before them
HAN = r"一-鿿㐀-䶿豈-﫿"
HANGUL = r"가-힣ㄱ-ㆎ"
HANGUL_ALL = r"가-힯ᄀ-ᇿ㄰-㆏"
KANA = r"぀-ヿㇰ-ㇿ"
WIDE = HAN + r"　-〿！-｠"
ZERO_WIDTH = r"​-‏⁠﻿­"
INLINE_SPACE = r" \t   -   　"
TERMINATORS = r"。！？；…．"
HYPHENS = r"\-‐‑"
HYPHENATED = rf"[\p{{L}}\p{{N}}][{HYPHENS}]"
SENTENCE_CUT = rf"(?<=[{TERMINATORS}])\s*|(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9{HAN}{HANGUL}])|\n+"
CLOSING = r".,;:!?%)\]}」』》〉）］｝。，、；：！？"
# fixed values: characters of one Chinese script only, traditional then simplified
SCRIPT_PAIRS = (
    "這这 個个 們们 來来 時时 會会 說说 對对 過过 還还 麼么 為为 與与 國国 學学 語语 發发 開开 關关 實实 現现 點点 體体 當当 從从 頭头 種种 樣样 經经 處处 問问 "
    "題题 機机 電电 長长 義义 區区 應应 書书 專专 業业 務务 單单 價价 產产 設设 計计 動动 員员 兩两 車车 無无 給给 買买 錢钱 讓让 進进 華华 東东 陽阳 門门 "
    "見见 歡欢 記记 覺觉 請请 談谈 論论 變变 顯显 驗验 壓压 換换 濾滤 護护 養养 檢检 際际 據据 裝装 線线 嗎吗 該该 測测 溫温 號号 級级 認认 證证 寫写 讀读 "
    "聽听 條条 運运 轉转 環环 響响 標标 簡简 統统 網网 鐘钟 檔档 擇择 調调 備备 數数 錯错 誤误 須须 規规 維维 閥阀 輸输 傳传 導导"
)
TRADITIONAL = "".join(p[0] for p in SCRIPT_PAIRS.split())
SIMPLIFIED = "".join(p[1] for p in SCRIPT_PAIRS.split())


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Canonical composition, which Spark has no expression for. The function is made on the driver, at use."""
    return pandas_udf(_composed, "string")(c)


def tidy(c: Column) -> Column:
    """Line ends, invisible signs, inline spaces and blank lines of a composed text."""
    lines = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), f"[{ZERO_WIDTH}]", "")
    lines = F.regexp_replace(lines, f"[{INLINE_SPACE}]+", " ")
    joined = F.array_join(F.transform(F.split(lines, "\n", -1), strip), "\n")
    return strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def normalize_text(c: Column) -> Column:
    """Composed, tidied text; '' for a null."""
    return tidy(nfc(F.coalesce(c, F.lit(""))))


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def split_paragraphs(c: Column) -> Column:
    return _pieces(F.split(c, r"(?U)\n\s*\n", -1))


def split_sentences(c: Column) -> Column:
    """Cut after full-width terminators, after .!? before a capital or CJK start, and at line ends."""
    return _pieces(F.split(c, "(?U)" + SENTENCE_CUT, -1))


def join_sentences(parts: Column) -> Column:
    return F.regexp_replace(F.array_join(_pieces(parts), " "), f"(?<=[{WIDE}]) +(?=[{WIDE}])", "")


def join_across_break(left: Column, right: Column, trailing_space: Column, midword: Column) -> Column:
    """Both sides joined where the break is surely inside a word; null otherwise."""
    return _across(F.regexp_replace(left, r"(?U)\s+$", ""), F.regexp_replace(right, r"(?U)^\s+", ""), trailing_space, midword, F.lit(False))


def _across(a: Column, b: Column, trailing_space: Column, midword: Column, hyphenated: Column) -> Column:
    """The same of sides without white space at the break. hyphenated: whether a's last word has a hyphen that a no longer shows."""
    glued, shortened = F.concat(a, b), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)
    compound = a.rlike(rf"{HYPHENATED}$") & (hyphenated | a.rlike(rf"(?U){HYPHENATED}\S*{HYPHENATED}$"))
    return (
        F.when((a == "") | (b == ""), F.lit(None).cast("string"))
        .when(a.endswith("­"), shortened)
        .when(compound & b.rlike(r"^[\p{L}\p{N}]"), glued)
        .when(a.rlike(rf"\p{{L}}[{HYPHENS}]$") & b.rlike(r"^\p{Ll}"), shortened)
        .when(midword & ~trailing_space & a.rlike(f"[{HANGUL}]$") & b.rlike(f"^[{HANGUL}]"), glued)
    )


def _pair(left: Column, right: Column, trailing_space: Column, midword: Column, hyphenated: Column) -> Column:
    """Two lines of a paragraph, without white space at their ends, as running text."""
    glued = F.concat(left, right)
    return F.coalesce(
        _across(left, right, trailing_space, midword, hyphenated),
        F.when(left.rlike(rf"[\p{{L}}\p{{N}}][{HYPHENS}]$") & right.rlike(r"^[\p{Lu}\p{Nd}]"), glued)
        .when(left.rlike(f"[{WIDE}]$") & right.rlike(f"^[{WIDE}]"), glued)
        .when(right.rlike(f"^[{CLOSING}]"), glued)
        .otherwise(F.concat(left, F.lit(" "), right)),
    )


#: of a longer last word only its end is held while lines are joined
HELD_WORD, HELD_END = 40, 8


def join_wrapped_lines(lines: Column, midword: bool = False) -> Column:
    """One paragraph of an array of lines (text, trailing_space).

    A fold that holds the last word so far, of a very long one its end and whether a hyphen
    stands before that: each line is read once, however long the paragraph.
    """
    kept = F.filter(F.transform(lines, lambda x: F.struct(strip(x["text"]).alias("text"), x["trailing_space"].alias("trailing_space"))), lambda x: x["text"] != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("word"), F.lit(False).alias("hyphenated"), F.lit(False).alias("space"))

    def joined(acc: Column, line: Column) -> Column:
        return F.when(acc["word"] == "", line["text"]).otherwise(_pair(acc["word"], line["text"], acc["space"], F.lit(midword), acc["hyphenated"]))

    def cut(acc: Column, line: Column, text: Column) -> Column:
        word = F.regexp_extract(text, r"(?U)(\S*)$", 1)
        word = F.when(F.length(word) > HELD_WORD, F.right(word, F.lit(HELD_END))).otherwise(word)
        let_go = F.substring(text, F.lit(1), F.length(text) - F.length(word))
        # a hyphen counts for the last word alone: with white space let go, only what stands behind that is of it
        same = F.regexp_extract(F.substring(text, F.lit(1), F.length(let_go) + 1), r"(?U)(\S*)$", 1)
        before = acc["hyphenated"] & ~text.rlike(r"(?U)\s")
        return F.struct(F.concat(acc["done"], F.array(let_go)).alias("done"), word.alias("word"), (before | same.rlike(HYPHENATED)).alias("hyphenated"), line["trailing_space"].alias("space"))

    def step(acc: Column, line: Column) -> Column:
        # the joined text is named once, as a one-element array, so that it is computed once
        return F.element_at(F.transform(F.array(joined(acc, line)), lambda text: cut(acc, line, text)), 1)

    return F.aggregate(kept, start, step, lambda a: F.concat(F.array_join(a["done"], ""), a["word"]))


def document_language(c: Column) -> Column:
    """ko, zh, en or mixed by shares of script; null below ten letters; ties in this order."""
    ko, zh, en = count_of(c, f"[{HANGUL}]"), count_of(c, f"[{HAN}]"), count_of(c, "[A-Za-z]")
    total = ko + zh + en
    top = F.greatest(ko, zh, en)
    second = ko + zh + en - top - F.least(ko, zh, en)
    return (
        F.when(total < 10, F.lit(None).cast("string"))
        .when((top / total < 0.6) & (second / total > 0.25), "mixed")
        .when(ko == top, "ko")
        .when(zh == top, "zh")
        .otherwise("en")
    )


def script_counts(c: Column) -> tuple[Column, Column]:
    """How many characters only traditional, and only simplified, Chinese has."""
    n = F.length(c)
    return n - F.length(F.translate(c, TRADITIONAL, "")), n - F.length(F.translate(c, SIMPLIFIED, ""))


def chinese_script(c: Column) -> Column:
    traditional, simplified = script_counts(c)
    return F.when(traditional > simplified, "zh-Hant").otherwise("zh-Hans")


LATIN_WORD = r"[A-Za-zÀ-ɏ]+"


def question_language(c: Column) -> Column:
    """ko, zh-Hans, zh-Hant, en or other; null without letters."""
    hangul, kana, han = count_of(c, f"[{HANGUL_ALL}]"), count_of(c, f"[{KANA}]"), count_of(c, f"[{HAN}]")
    words, letters = count_of(c, LATIN_WORD), count_of(c, r"[A-Za-zÀ-ɏ]")
    other = count_of(c, r"\p{L}") - han - letters
    return (
        F.when((hangul > 0) & (hangul >= kana), "ko")
        .when(kana > 0, "other")
        .when(other > han + letters, "other")
        .when((han > 0) & (han >= words), chinese_script(c))
        .when(words > 0, "en")
        .when(other != 0, "other")
    )


def choose_language(question: Column, top_passage: Column) -> Column:
    """(language, unsupported) of the answer to a question."""
    found = F.coalesce(question_language(question), F.when(top_passage != "", question_language(top_passage)))
    return F.struct(F.when(found.isNull() | (found == "other"), "en").otherwise(found).alias("language"), F.coalesce(found == "other", F.lit(False)).alias("unsupported"))


def is_in_language(c: Column, language: Column) -> Column:
    """Whether an answer passes as written in a language; only clear evidence counts against it."""
    found = question_language(c)
    traditional, simplified = script_counts(c)
    return (
        F.when(found.isNull() | (found == language), True)
        .when((language == "en") & found.isin("ko", "other"), False)
        .when(language == "en", count_of(c, f"[{HAN}]") <= count_of(c, r"[A-Za-zÀ-ɏ]"))
        .when((language == "ko") | ~found.startswith("zh"), False)
        .when(language == "zh-Hans", ~((traditional >= 3) & (simplified == 0)))
        .otherwise(~((simplified >= 3) & (traditional == 0)))
    )


def estimate_tokens(c: Column) -> Column:
    wide = count_of(c, f"[{HAN}{HANGUL_ALL}{KANA}]")
    return (wide + F.floor((F.length(c) - wide) / 3) + 1).cast("int")


def passage_key(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def page_label(filename: Column, start: Column, end: Column) -> Column:
    about = F.when(file_type(filename) == "docx", "~").otherwise("")
    return F.concat(about, F.when(end.isNotNull() & (end != 0) & (end != start), F.concat_ws("-", start, end)).otherwise(start.cast("string")))


def table_markdown(rows: Column) -> Column:
    """A table of an array of rows: padded to the widest, with a rule below the first."""
    width = F.array_max(F.transform(rows, F.size))
    full = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    lines = F.transform(full, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def file_type(filename: Column) -> Column:
    suffix = F.lower(F.regexp_extract(filename, r"\.([^./\\]+)$", 1))
    return F.when(suffix == "", "pdf").otherwise(suffix)


def safe_name(raw: Column) -> Column:
    """A file name without folders, unsafe signs and leading dots."""
    base = strip(F.regexp_replace(raw, r"^.*[/\\]", ""))
    return F.regexp_replace(F.regexp_replace(base, r"[\x00-\x1f<>:\"|?*]", "_"), r"^\.+", "")


def folder_name(raw: Column) -> Column:
    """A folder's name with even spacing; null if it is empty, too long or like a path."""
    name = strip(F.regexp_replace(raw, r"(?U)\s+", " "))
    return F.when((name == "") | (F.length(name) > 120) | name.isin(".", "..") | name.rlike(r"[/\\\x00]"), F.lit(None).cast("string")).otherwise(name)


def digit_mask(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", ""), r"\d+", "#")


def char_count(c: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(c, r"(?U)\s+", ""))


def fixed_pieces(c: Column, size: int) -> Column:
    """The text in pieces of so many characters."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def cited_numbers(c: Column, first_seen: bool = False) -> Column:
    """Numbers cited as [1] or [1, 2]; sorted, or in order of first appearance."""
    groups = F.regexp_extract_all(c, F.lit(r"\[\s*(\d+(?:\s*[,，、]\s*\d+)*)\s*\]"), F.lit(1))
    numbers = F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, "[,，、]"), lambda x: F.trim(x).cast("int")))))
    return numbers if first_seen else F.array_sort(numbers)


def answer_parts(c: Column) -> Column:
    """An answer as alternating text and citation parts (text, cite)."""
    pattern = r"(?:\[\s*\d+(?:\s*[,，、]\s*\d+)*\s*\])"
    marks = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(c, pattern, -1).alias("t"), marks.alias("m"))
    none = F.array().cast("array<int>")
    parts = F.flatten(F.transform(zipped, lambda x: F.array(F.struct(x["t"].alias("text"), none.alias("cite")), F.struct(F.coalesce(x["m"], F.lit("")).alias("text"), F.coalesce(cited_numbers(x["m"], True), none).alias("cite")))))
    return F.filter(parts, lambda p: p["text"] != "")


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def holds_facts(answer: Column, facts: Column) -> Column:
    flat = without_space(answer)
    return F.forall(facts, lambda x: flat.contains(without_space(x)))


def clean_answer(c: Column) -> Column:
    return F.replace(c, F.lit("**"), F.lit(""))


def attribute_value(c: Column) -> Column:
    return strip(F.regexp_replace(F.replace(c, F.lit('"'), F.lit("'")), "\n", " "))


def safe_body(c: Column) -> Column:
    """A passage that cannot close or open a source block."""
    return F.regexp_replace(strip(c), r"(?i)<(/?\s*sources?\b)", "‹$1")


def source_block(n: Column, filename: Column, pages: Column, heading: Column, text: Column) -> Column:
    section = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(' section="'), attribute_value(heading), F.lit('"'))).otherwise("")
    return F.concat(F.lit('<source id="'), n.cast("string"), F.lit('" file="'), attribute_value(filename), F.lit('" pages="'), pages, F.lit('"'), section, F.lit(">\n"), safe_body(text), F.lit("\n</source>"))


# fixed values: common words that are not marked
STOP_WORDS = (
    "about after again against all and any are because been before being between both but can did does doing down during each for from had has have having her here him "
    "his how into its itself just more most need not now only other our out over same she should some such than that the them then there these they this through too "
    "under until use very was way were what when where which who while why will with work would you your"
).split()
MARK_CJK = r"一-鿿㐀-䶿가-힯぀-ヿ"


def highlight_terms(query: Column) -> Column:
    """Words of a query worth marking, longest first: Latin words, CJK runs and their pairs."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.filter(F.split(F.coalesce(query, F.lit("")), r"(?U)[\s,，。、；;：:!?！？()（）\"'“”]+", -1), lambda x: x != "")

    def worth(w: Column) -> Column:
        return (F.length(w) >= 3) & ~F.array_contains(stop, F.lower(w))

    def run_terms(run: Column) -> Column:
        n = F.length(run)
        pairs = F.when(n > 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.when(n >= 2, F.array(run)).otherwise(F.array().cast("array<string>")), pairs)

    def of(word: Column) -> Column:
        runs = F.flatten(F.transform(F.regexp_extract_all(word, F.lit(f"[{MARK_CJK}]+"), F.lit(0)), run_terms))
        latin = F.filter(F.split(word, f"[{MARK_CJK}]+", -1), worth)
        return F.when(word.rlike(f"[{MARK_CJK}]"), F.concat(runs, latin)).otherwise(F.filter(F.array(word), worth))

    terms = F.array_distinct(F.flatten(F.transform(words, of)))
    placed = F.transform(terms, lambda t, i: F.struct((-F.length(t)).alias("k"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(placed), lambda x: x["t"])


def highlighted(text: Column, terms: Column) -> Column:
    """The text with every term marked, without regard to case."""
    quoted = F.transform(terms, lambda t: F.regexp_replace(t, r"([\\.*+?^${}()|\[\]])", r"\\$1"))
    pattern = F.concat(F.lit("(?i)("), F.array_join(quoted, "|"), F.lit(")"))
    return F.when(F.size(terms) == 0, text).otherwise(F.regexp_replace(text, pattern, F.lit("<mark>$1</mark>")))


def without_repeated_heading(text: Column, heading: Column) -> Column:
    start = F.regexp_replace(text, r"(?U)^\s+", "")
    rest = F.regexp_replace(F.substring(start, F.length(heading) + 1, F.length(start)), r"(?U)^\s+", "")
    return F.when(F.coalesce(heading, F.lit("")) == "", text).when(F.startswith(start, heading), rest).otherwise(text)


def passage_body(text: Column, heading: Column) -> Column:
    body = without_repeated_heading(text, heading)
    return F.when(body == "", strip(text)).otherwise(body)


def relevance_band(score: Column) -> Column:
    return F.when(score >= 0.65, "strong").when(score >= 0.5, "good").otherwise("weak")


def username_key(c: Column) -> Column:
    return F.lower(strip(c))


def ready_to_check(held: Column) -> Column:
    """Whether held-back text is long enough to judge: 12 characters with a sentence's end in them, or 120."""
    return (F.length(held) >= 120) | ((F.length(held) >= 12) & held.rlike(r"[.!?](?:\s|$)|[。！？\n]"))


def think_filtered(c: Column) -> Column:
    """An answer without a leading think block."""
    return F.regexp_replace(c, r"(?s)^\s*<think>.*?(</think>\s*|$)", "")


def redacted(c: Column, hide: bool) -> Column:
    n = F.length(c)
    if hide:
        return F.concat(F.lit("<text redacted, "), n.cast("string"), F.lit(" chars>"))
    return F.when(n > 200, F.concat(F.substring(c, 1, 200), F.lit("..."))).otherwise(c)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


# fixed values: page numbers, list markers, sentence ends before a new paragraph, and fonts of one width
PAGE_NUMBER = r"(?iU)^[\W\d_]*(?:page|p\.)?[\W\d_]*$"
LIST_MARKER = r"^(?:[•·‣◦▪●○■□◆◇➢➤→\-–—*]|\(?\d{1,3}[.)]|[①-⑳])"
PARAGRAPH_END = r"[。．.!?！？:：;；][\"'”’」』)）\]]*(?:\[\d+\])*$"
MONOSPACE = r"(?i)mono|courier|consol|menlo|code"
SENTENCE_TAIL = r"[。．.!?！？，,;；、:：]$"


def is_heading(text: Column, size: Column, body: Column, bold: Column) -> Column:
    """Large short lines, and short bold ones that end no sentence."""
    large = (F.length(text) <= 120) & (size >= 1.15 * body)
    strong = bold & (F.length(text) <= 80) & ~strip(text).rlike(SENTENCE_TAIL)
    return (strip(text) != "") & (large | strong)
