"""Text cut off by field limits (problem 8).

Prefix self-joins find values that stop where longer copies go on:

* whole values: distinct texts are range-partitioned and sorted; the longer
  copies of a text follow it without a gap, so one pass with a stack of open
  prefixes sees every way in which they go on (those still open at the end of a
  partition are held against all later texts);
* last words: the words of all texts, except each text's last, form the
  vocabulary; a last word that isn't a word but a strict prefix of words is cut.

Most cut texts have no longer copy, so the joins alone can't give the result.
They are completed by the form of the end: what was put after the break
(ellipses, broken characters) is taken off; then the last line decides. Code is
held against the grammars: it is cut if they fail at its end. A sentence is cut
if nothing ends it. List items, headings and short closing lines need no full
stop: they are cut if their last word is cut or never ends a line or clause in
the corpus (``the``), if the longer copy goes on within the line, or if the
text has exactly a length at which its source piles up unfinished texts. Which
short closing lines there are (``LGTM``) is learned: others than those that many
texts end with are cut.

Cases: null or blank texts are complete; repeated texts each count; a text whose
last sentence is complete is no case even if longer copies exist, unless one goes
on inside its last word or token (``3.`` and ``3.14``); code that fails to parse
before its end (``broken``) is judged as parsing code is; null sources
are one source; texts of any length are used whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.source_check import parse_as
from graphloom.session import cut, small_side, spread

#: What may stand after a break: ellipses, broken characters, bracketed remarks of cutting.
_MARKER = re.compile(r"(?:\s*(?:…|\.{3,}|�|\[(?:…|\.{3}|[^\]\n]*(?:truncated|cut|more|snip)[^\]\n]*)\]|\((?:…|\.{3}|[^)\n]*(?:truncated|cut off|snip|read more|continued)[^)\n]*)\)))+\s*$", re.IGNORECASE)
#: Phrases that are complete with an ellipsis (fixed values).
_AND_SO_ON = re.compile(r"(?:\band so (?:on|forth)|\betc\.?|\busw\.?|\bu\.\s?s\.\s?w\.?|\bund so weiter|\bet cetera)$", re.IGNORECASE)
_ENDED = re.compile(r"""[.?!。！？]["'”’»)\]`*_]*$""")
_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+\S")
_REFERENCE = re.compile(r"(?:[A-Z][\w-]*(?: \w+){0,2}: ?\S*(?:\d|\.\w{1,5}|/|>)|(?:Fixed|Closed|Closes|Fixes|Resolved|Since|Merged|See) (?:in |by )?[#\w/.-]*\d+|https?://\S+)$")
_WORDS, _DIGITS = re.compile(r"[^\W_]+"), re.compile(r"\d+")
#: A longer copy goes on in the next line, or in one that is indented; ends of values that a letter or digit goes on as one token.
_LINE_END, _DEEPER, _OPEN_TOKEN = re.compile(r"\s*(?:\n|$)"), re.compile(r"\s*\n+[ \t]+\S"), re.compile(r"[\w.?!/]\Z")
#: Letters looked at where a longer copy goes on.
AFTER = 80
#: A last word may end a line if at least this share of its other occurrences does; judged from this many on.
ENDER_SHARE, JUDGED_FROM = 0.02, 5
#: A short closing line stands for a complete text if at least this share of the corpus' texts with such lines end with the same.
CLOSING_SHARE = 0.02
#: A length is a limit of its source if this many unfinished texts have it, and this share of all its texts of that length.
PILE, PILE_SHARE = 5, 0.3


def _is_code(lang: str | None, source: str | None) -> str:
    for word in (lang or "").lower(), (source or "").lower().removeprefix("code_"):
        if word in ("python", "py"):
            return "py"
        if word in ("c", "h"):
            return "c"
    return ""


def ending(text: str | None, lang: str | None = None, source: str | None = None) -> tuple[str, str, int]:
    """Form of a text's end, its last word and the length of what follows the break.

    Forms: ``complete``, ``cut``, ``item`` (needs its last word judged), ``closing``
    (a short last paragraph, the same), ``code`` (parses; the longer copy decides),
    ``broken`` (code with an error before its end; the same).
    """
    if not text or not text.strip():
        return "complete", "", 0
    body = text.rstrip()
    marked = _MARKER.search(body)
    if marked and marked.start():
        before = body[: marked.start()].rstrip()
        if _AND_SO_ON.search(before):
            return "complete", "", 0
        return ("complete" if _ENDED.search(before) else "cut"), "", len(text) - marked.start()
    spare = len(text) - len(body)
    if language := _is_code(lang, source):
        found = parse_as(language, text)
        words = _WORDS.findall(body[-200:].rsplit("\n", 1)[-1])
        word = words[-1] if words and body.endswith(words[-1]) else ""
        if found.ok:
            return "code", word, spare
        return ("cut", "", spare) if found.at_end else ("broken", word, spare)
    lines = body.split("\n")
    last = re.sub(r"^(?:\s*>)+\s?", "", lines[-1]).rstrip()
    if sum(1 for x in lines if re.match(r"(?:\s*>)*\s*(?:```|~~~)", x)) % 2:
        return "cut", "", spare
    if re.match(r"\s*(?:```|~~~|-{3,}|={3,}|\*{3,})", last) or not last:
        return "complete", "", spare
    if last.lstrip().startswith("|"):
        cells = lines[-2].count("|") if len(lines) > 1 and lines[-2].lstrip("> ").startswith("|") else 0
        return ("complete" if last.endswith("|") and last.count("|") >= cells else "cut"), "", spare
    if _ENDED.search(last):
        return "complete", "", spare
    words = _WORDS.findall(last)
    word = words[-1] if words and re.search(re.escape(words[-1]) + r"""["'”’»)\]`*_]*$""", last) else ""
    if last.count("`") % 2:
        return "cut", word, spare
    if len(lines) > 1 and re.match(r"--\s?$", lines[-2]) or _REFERENCE.match(last):
        return "complete", "", spare
    if _ITEM.match(last) or last.startswith("#"):
        return "item", word, spare
    alone = len(lines) == 1 or not lines[-2].strip()
    if alone and len(last) < 80 and re.match(r"[\w./-]+(?:\([^)]*\))?!?: \S", last):  # a subject line
        return "item", word, spare
    if alone and len(last.split()) <= 4:
        return ("closing" if word else "complete"), word, spare
    return "cut", word, spare


def _endings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [ending(t, a, s) for t, a, s in zip(frame["text"], frame["lang"], frame["source"])]
        out = pd.DataFrame(rows, columns=["form", "word", "spare"])
        out["closing"] = [_DIGITS.sub("0", t.rstrip().rsplit("\n", 1)[-1].strip()) if r[0] == "closing" else None for t, r in zip(frame["text"], rows)]
        out.insert(0, "doc_id", frame["doc_id"].to_numpy())
        out["source"] = frame["source"].to_numpy()
        out["n"] = [len(t) if t else 0 for t in frame["text"]]
        out["h"] = frame["h"].to_numpy()
        yield out[["doc_id", "source", "h", "form", "word", "spare", "n", "closing"]]


def _ways(value: str, after: str) -> tuple[bool, bool, bool]:
    """How a longer copy goes on: within the line, in an indented line, inside the last word or token."""
    return not _LINE_END.match(after), bool(_DEEPER.match(after)), bool(_OPEN_TOKEN.search(value) and after[0].isalnum())


def _goes_on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In a sorted partition: each way in which a value goes on, once, and the values that the last one starts with."""
    columns = ["h", "after", "within_line", "deeper", "in_token", "value"]
    stack: list[tuple[int, str, set[tuple[bool, bool, bool]]]] = []
    for frame in frames:
        out = []
        for h, value in zip(frame["h"], frame["value"]):
            while stack and not value.startswith(stack[-1][1]):
                stack.pop()
            # a prefix shorter than the top by AFTER or more goes on as the top does
            for h2, prefix, seen in reversed(stack):
                if len(stack[-1][1]) - len(prefix) >= AFTER:
                    break
                after = value[len(prefix) : len(prefix) + AFTER]
                if (way := _ways(prefix, after)) not in seen:
                    seen.add(way)
                    out.append((h2, after, *way, None))
            stack.append((h, value, set()))
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame([(h, None, None, None, None, value) for h, value, _ in stack], columns=columns)


def _goes_on_later(values: DataFrame, still_open: DataFrame) -> DataFrame:
    """The same for values of other partitions, by a join with the few that are open at the end of one."""

    def ways(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = {(h, *_ways(p, a)): a for h, p, a in zip(frame["h"], frame["prefix"], frame["after"])}
            yield pd.DataFrame([(h, a, *way) for (h, *way), a in found.items()], columns=["h", "after", "within_line", "deeper", "in_token"])

    few = small_side(still_open.select(F.col("h").alias("h2"), F.col("value").alias("prefix")))
    joined = values.join(few, F.col("value").startswith(F.col("prefix")) & (F.length("value") > F.length("prefix")))
    joined = joined.select(F.col("h2").alias("h"), F.expr("right(prefix, 1)").alias("prefix"), F.expr(f"substring(value, length(prefix) + 1, {AFTER})").alias("after"))
    return joined.mapInPandas(ways, "h bigint, after string, within_line boolean, deeper boolean, in_token boolean")


def longer_copies(values: DataFrame, partitions: int | None = None) -> DataFrame:
    """(h, after, within_line, deeper, in_token): for each value (columns h, value; distinct) that is a strict prefix of others, how they go on."""
    n = partitions or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = values.select("h", "value")
    ordered = values.repartitionByRange(n, "value").sortWithinPartitions("value")
    found = cut(ordered.mapInPandas(_goes_on, "h bigint, after string, within_line boolean, deeper boolean, in_token boolean, value string"))
    later = _goes_on_later(values, found.filter("value is not null"))
    ways = found.filter("value is null").drop("value").unionByName(later)
    return ways.groupBy("h").agg(F.min("after").alias("after"), *(F.max(c).alias(c) for c in ("within_line", "deeper", "in_token")))


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, total, ends): words inside the texts, and how often a line or clause ends with them; each text's last word is left out."""
    parts = documents.filter("text is not null").select(F.explode(F.expr(r"regexp_extract_all(rtrim(text), '([\\p{L}\\p{N}]+)([^\\p{L}\\p{N}]+)', 0)")).alias("x"))
    word = F.regexp_extract("x", r"^([\p{L}\p{N}]+)", 1)
    tail = F.regexp_extract("x", r"^[\p{L}\p{N}]+([^\p{L}\p{N}]+)$", 1)
    return parts.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("total"), F.count_if(tail.rlike(r"""^["'”’»)\]`*_]*[ \t]*(?:[.?!,;:]|\n)""")).alias("ends"))


def judged_words(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, state): ``open`` never ends a line, ``partial`` is no word but the prefix of words, ``fine`` otherwise."""
    wanted = words.filter("word <> ''").select("word").distinct()
    longer = (
        vocab.filter("length(word) <= 60")
        .select("total", F.explode(F.expr("transform(sequence(1, greatest(length(word) - 1, 1)), i -> substring(word, 1, i))")).alias("p"), "word")
        .filter("p <> word")
        .groupBy(F.col("p").alias("word"))
        .agg(F.sum("total").alias("longer"))
    )
    joined = wanted.join(vocab, "word", "left").join(longer, "word", "left").fillna(0, ["total", "ends", "longer"])
    state = (
        F.when((F.col("total") >= JUDGED_FROM) & (F.col("ends") < ENDER_SHARE * F.col("total")), "open")
        .when((F.col("longer") > 0) & (F.col("total") * 50 < F.col("longer")) & (F.col("ends") < JUDGED_FROM), "partial")
        .otherwise("fine")
    )
    return joined.select("word", state.alias("state"))


def stock_closings(ends: DataFrame) -> DataFrame:
    """(closing) of the short closing lines that make up the share of all, each text counted once; at most 1 / ``CLOSING_SHARE`` rows."""
    counts = cut(ends.filter("closing is not null").select("h", "closing").distinct().groupBy("closing").agg(F.count(F.lit(1)).alias("texts")))
    total = counts.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    return counts.filter(F.col("texts") >= CLOSING_SHARE * total).select("closing")


def judge_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n, form, truncated) of every document."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source").withColumn("h", F.xxhash64("text"))
    ends = cut(spread(docs).mapInPandas(_endings, "doc_id bigint, source string, h bigint, form string, word string, spare int, n int, closing string"))
    spares = ends.select("h", "spare").distinct()
    # values: texts without what follows the break; texts that differ in that only share one value
    values = docs.filter("text is not null").select("h", "text").dropDuplicates(["h"]).join(spares, "h")
    values = values.select("h", F.expr("case when spare > 0 then substring(text, 1, length(text) - spare) else text end").alias("value")).filter("value <> ''")
    values = cut(values.withColumn("v", F.xxhash64("value")))
    copies = longer_copies(values.select(F.col("v").alias("h"), "value").dropDuplicates(["h"])).withColumnRenamed("h", "v")
    copies = values.select("h", "v").join(copies, "v").drop("v")
    words = judged_words(ends.filter("form in ('item', 'closing', 'code', 'broken')"), cut(vocabulary(documents)))
    # most texts have no word to be judged: they don't meet in one partition of the join
    known = ends.filter("word <> ''").join(words, "word", "left").unionByName(ends.filter("word = ''"), allowMissingColumns=True)
    judged = known.join(copies, "h", "left")
    piles = (
        ends.groupBy("source", "n")
        .agg(F.count_if(F.col("form") == "cut").alias("unfinished"), F.count(F.lit(1)).alias("all"))
        .filter((F.col("unfinished") >= PILE) & (F.col("unfinished") >= PILE_SHARE * F.col("all")))
        .select(F.col("source").alias("s2"), F.col("n").alias("n2"), F.lit(True).alias("at_limit"))
    )
    judged = judged.join(small_side(piles), F.col("source").eqNullSafe(F.col("s2")) & (F.col("n") == F.col("n2")), "left")
    judged = judged.join(small_side(stock_closings(ends)).withColumn("stock", F.lit(True)), "closing", "left")
    within_line, within_block, in_token = (F.coalesce(c, F.lit(False)) for c in ("within_line", "deeper", "in_token"))
    bad_word = F.coalesce(F.col("state").isin("open", "partial"), F.lit(False))
    limit = F.coalesce("at_limit", F.lit(False))
    truncated = (
        F.when(F.col("form") == "complete", in_token)
        .when(F.col("form") == "cut", True)
        .when(F.col("form").isin("code", "broken"), within_line | within_block | F.coalesce(F.col("state") == "partial", F.lit(False)))
        .otherwise(bad_word | within_line | limit | ((F.col("form") == "closing") & F.col("stock").isNull()))
    )
    return judged.select("doc_id", "source", "n", "form", "word", "state", "after", limit.alias("at_limit"), truncated.alias("truncated"))


def truncation_rates(judged: DataFrame) -> DataFrame:
    """Documents, truncated ones and their rate per source, with the source's most frequent truncated length."""
    lengths = judged.filter("truncated").groupBy("source", "n").count().groupBy("source").agg(F.max_by("n", F.struct("count", "n")).alias("top_length"))
    counts = judged.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("truncated").alias("truncated"))
    return counts.join(lengths.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").select(
        "source", "documents", "truncated", F.round(F.col("truncated") / F.col("documents"), 6).alias("rate"), "top_length"
    )
