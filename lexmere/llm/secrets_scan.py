"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query over lower-case trigrams: a
match must hold one of several sets of trigrams. The index keeps postings
(trigram, document) for the trigrams that any rule asks for. Their intersection
names each document's candidate rules, and only those are verified; a rule whose
expression demands no trigram is verified everywhere.

Positions come from splitting the text at the matches: piece and match lengths,
in code points, add up. Failing base matches are found first and dropped then,
as a shorter search could start inside them.

Defined results: a null text is an empty one and has no spans. Rows that share a
doc_id, or have none, share candidates and are verified apart. Other columns are
not read, only carried along where asked. A text with very many spans takes time
in proportion to its length, whatever their number.
"""

from __future__ import annotations

import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .carry import with_rest

#: candidates are broadcast up to so many rows, joined by shuffle beyond
BROADCAST_ROWS = 1_000_000
MOST_STRINGS = 40


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what matches, and the group that needs so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    guard: str = ""


# fixed values: the three base kinds, as they are specified
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
)
# further kinds, by the published formats of such keys
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repository_token", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    # it begins where no sign of its own comes before and gives nothing back, so a run of beginnings is read once
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+"),
    Rule("payment_key", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@]{1,100}:[^\s:/@]{1,100}@"),
)


def _simple(dnf: set[frozenset[str]]) -> set[frozenset[str]]:
    """Without sets that hold another; an empty set asks for nothing."""
    return {x for x in dnf if not any(y < x for y in dnf)}


def _conjunction(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
    both = _simple({x | y for x in a for y in b})
    return both if len(both) <= MOST_STRINGS else min((a, b), key=len)


def _of_strings(strings: set[str]) -> set[frozenset[str]]:
    return _simple({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


ALWAYS = {frozenset()}


def _analyse(tree) -> tuple[set[str] | None, set[frozenset[str]]]:
    """(all strings that the tree matches, lower-cased, if they are few; a query that any match meets)."""
    exact: set[str] | None = {""}
    tail: set[str] = {""}
    query = ALWAYS
    for op, value in tree:
        name = str(op)
        own: set[str] | None = None
        own_query = ALWAYS
        if name == "LITERAL":
            own = {chr(value).lower()}
        elif name == "IN" and len(value) <= 8 and all(str(o) == "LITERAL" for o, _ in value):
            own = {chr(v).lower() for _, v in value}
        elif name == "SUBPATTERN":
            own, own_query = _analyse(value[3])
        elif name == "BRANCH":
            parts = [_analyse(x) for x in value[1]]
            own = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            own_query = _simple(set().union(*(p[1] for p in parts)))
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue  # no characters of its own
        elif name in ("MAX_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            strings, inner_query = _analyse(inner)
            if strings is not None and high == 1:
                own = strings | ({""} if low == 0 else set())
            elif low:
                own_query = inner_query
        if own is not None and len(own) * len(tail) <= MOST_STRINGS:
            tail = {a + b for a in tail for b in own}
            exact = {a + b for a in exact for b in own} if exact is not None and len(exact) * len(own) <= MOST_STRINGS else None
        else:
            query = _conjunction(query, _of_strings(tail))
            if own is not None:
                tail = set(own)
            else:
                query, tail = _conjunction(query, own_query), {""}
            exact = None
    return exact, _conjunction(query, _of_strings(tail))


def trigram_query(pattern: str) -> list[list[str]]:
    """Sets of trigrams, one of which every match holds in lower case; [] if none is mandatory."""
    query = _analyse(parser.parse(pattern))[1]
    return [] if frozenset() in query else sorted(sorted(x) for x in query)


class Plan:
    """The trigrams that the rules ask for, numbered, and each rule's sets as bit masks."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        queries = [trigram_query(r.pattern) for r in rules]
        self.trigrams = sorted({t for q in queries for s in q for t in s})
        at = {t: k for k, t in enumerate(self.trigrams)}
        self.sets = [[frozenset(at[t] for t in s) for s in q] for q in queries]


def postings(docs: DataFrame, plan: Plan) -> DataFrame:
    """The inverted index (trigram, doc_id) over the plan's trigrams; plain searches, as one pattern of all trigrams takes many times as long."""
    low = docs.select("doc_id", F.lower("text").alias("low")).where("low IS NOT NULL")
    held = F.array(*[F.when(F.col("low").contains(t), F.lit(k)) for k, t in enumerate(plan.trigrams)])
    return low.select("doc_id", F.explode(F.array_compact(held)).alias("trigram")).distinct()


def candidates(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, rules): a bit for each rule that has trigrams and whose query the document's postings meet."""
    words = -(-len(plan.trigrams) // 62) or 1
    bits = [F.coalesce(F.bit_or(F.when(F.col("trigram").between(62 * w, 62 * w + 61), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") - 62 * w))), F.lit(0)).alias(f"w{w}") for w in range(words)]
    seen = postings(docs, plan).groupBy("doc_id").agg(*bits)
    rules = F.lit(0).cast("long")
    for k, sets in enumerate(plan.sets):
        if sets:
            rules = rules + F.when(_any(sets, words), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return seen.select("doc_id", rules.alias("rules")).where("rules <> 0")


def _any(sets: list[frozenset[int]], words: int) -> Column:
    met = F.lit(False)
    for s in sets:
        all_of = F.lit(True)
        for w in range(words):
            mask = sum(1 << (t - 62 * w) for t in s if 62 * w <= t < 62 * w + 62)
            if mask:
                all_of = all_of & (F.col(f"w{w}").bitwiseAND(F.lit(mask)) == F.lit(mask))
        met = met | all_of
    return met


SPAN = "array<struct<s:int,k:int,e:int,kind:string>>"
#: an array is walked in stretches of this length, so that a step copies a stretch and not the whole
STRETCH = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers, those before it merged (0 for none); merge is associative."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def walk(own: Column, start: Column) -> Column:
        return F.aggregate(own, F.struct(start.alias("at"), none["out"].alias("out")), step)["out"]

    def of(stretches: Column) -> Column:
        ends = F.transform(stretches, lambda own: F.aggregate(own, F.lit(0), merge))
        return F.flatten(F.zip_with(stretches, F.aggregate(ends, none, step)["out"], walk))

    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(STRETCH)), lambda a: F.slice(values, a + 1, F.lit(STRETCH)))
    return _let(cut, of)


def _spans(k: int, rule: Rule) -> Column:
    """The rule's spans in the column text, in order: a match begins behind all pieces and matches before it and its own piece."""
    r, text = F.lit(rule.pattern), F.col("text")
    cut = F.arrays_zip(F.regexp_extract_all(text, r, F.lit(0)).alias("m"), F.regexp_extract_all(text, r, F.lit(rule.group)).alias("g"), F.split(text, rule.pattern, -1).alias("p"))
    sized = F.transform(cut, lambda x: F.struct(F.length(x["p"]).alias("p"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("m"), F.coalesce(F.length(x["g"]), F.lit(0)).alias("g")))

    def placed(own: Column) -> Column:
        start = _before(F.transform(own, lambda x: x["p"] + x["m"]), lambda a, b: a + b)
        spans = F.zip_with(own, start, lambda x, at: F.when(x["g"] >= F.lit(max(1, rule.least)), F.struct((at + x["p"]).alias("s"), F.lit(k).alias("k"), (at + x["p"] + x["m"]).alias("e"), F.lit(rule.kind).alias("kind"))))
        return F.array_compact(spans)

    return F.when(text.rlike(rule.guard or rule.pattern), _let(sized, placed)).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, more: tuple[Rule, ...] = MORE, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, text, found (spans sorted by start, then kind as listed); with carry also rest, a struct of all other columns."""
    rules = BASE + more
    plan = Plan(rules)
    own, _ = with_rest(docs, id_col, text_col)
    own = own.withColumn("text", F.coalesce("text", F.lit("")))
    likely = scratch.table(candidates(own, plan).withColumnRenamed("doc_id", "likely_id"), "candidates")
    if likely.count() <= BROADCAST_ROWS:
        likely = F.broadcast(likely)
    joined = own.join(likely, F.col("doc_id").eqNullSafe(F.col("likely_id")), "left")
    parts = []
    for k, rule in enumerate(rules):
        spans = _spans(k, rule)
        if plan.sets[k]:
            wanted = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
            spans = F.when(wanted, spans).otherwise(F.array().cast(SPAN))
        parts.append(spans)
    found = F.array_sort(F.flatten(F.array(*parts)))
    return joined.select("doc_id", "text", found.alias("found"), *(["rest"] if carry else []))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.filter("found", lambda x: x["k"] < len(BASE))
    counts = [F.size(F.filter("found", lambda x: x["kind"] == r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def _between(chunks: Column, a: Column, b: Column) -> Column:
    """The text from a to b, of its chunks of CHUNK characters."""
    first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
    part = lambda i: F.substring(F.get(chunks, i), F.greatest(a - i * CHUNK, F.lit(0)) + 1, F.least(b - i * CHUNK, F.lit(CHUNK)) - F.greatest(a - i * CHUNK, F.lit(0)))
    return F.when(b > a, F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), part), "")).otherwise("")


#: characters are counted from the start of a chunk and not of the text
CHUNK = 4096


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    n = F.length(text)
    chunks = F.transform(F.sequence(F.lit(0), F.floor(n / CHUNK).cast("int")), lambda i: F.substring(text, i * CHUNK + 1, F.lit(CHUNK)))

    def kept(held: Column) -> Column:
        reach = _before(F.transform(held["found"], lambda x: x["e"]), lambda a, b: F.greatest(a, b))
        opens = F.filter(F.zip_with(held["found"], reach, lambda x, at: F.struct(at.alias("a"), x["s"].alias("b"))), lambda x: x["b"] >= x["a"])
        parts = F.transform(opens, lambda x: F.concat(_between(held["chunks"], x["a"], x["b"]), F.lit(mark)))
        end = F.array_max(F.transform(held["found"], lambda x: x["e"]))
        return F.concat(F.array_join(parts, ""), _between(held["chunks"], end, held["n"]))

    return F.when(F.size(found) == 0, text).otherwise(_let(F.struct(chunks.alias("chunks"), found.alias("found"), n.alias("n")), kept))
