"""URL filters: rules first, then host word segmentation and naive Bayes.

Names in hosts are concatenated words. A unigram Viterbi over word frequencies, learned from the pages' own text, splits them;
multinomial naive Bayes over segmented host words and path tokens judges the urls that no rule fits. It learns from the urls
that a rule decides. Word and token counts are tables that are joined to the distinct names, hosts and paths; none of them is
cut or sent to the driver.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emipanel.llm.common import rows, stored

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: A label of a host name has 63 letters at most, so no longer word can be part of one.
LONGEST_WORD = 63
_LETTERS = re.compile(rb"[a-z]+")
_RAW = re.compile(rb"<(script|style)\b")
_RAW_END = {name: re.compile(rb"</" + name + rb"\s*>") for name in (b"script", b"style")}
_PARTS = "([a-z]+|[0-9]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url):
    """Columns host and path of a url: after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(url.isNotNull() & (at > 0), F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_columns(host, path, rules):
    """Columns rule and verdict: the longest rule that fits the host, or a parent domain of it, and the path's beginning."""
    rule = verdict = F.lit(None).cast("string")
    for text, action in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, start = text.split("/", 1)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def outside_tags(html: bytes) -> bytes:
    """Lower-cased text outside tags, scripts and styles, in one pass whatever is left open: an unclosed script is an ordinary tag,
    a < without > is text."""
    text = html.lower()
    out, at, open_ended = [], 0, set()
    while (start := text.find(b"<", at)) >= 0:
        out.append(text[at:start])
        raw = _RAW.match(text, start)
        if raw and raw[1] not in open_ended:
            end = _RAW_END[raw[1]].search(text, raw.end())
            if end:
                at = end.end()
                continue
            open_ended.add(raw[1])
        end = text.find(b">", start)
        if end < 0:
            at = start
            break
        at = end + 1
    out.append(text[at:])
    return b" ".join(out)


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """(word, n): every word of up to LONGEST_WORD letters of the pages' text outside tags."""
    def run(batches):
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        for batch in batches:
            counts: dict[bytes, int] = {}
            for html in batch.column(0).to_pylist():
                for w in _LETTERS.findall(outside_tags(html)) if html else ():
                    counts[w] = counts.get(w, 0) + 1
            words = [w for w in counts if len(w) <= LONGEST_WORD]
            yield rows(schema, word=[w.decode() for w in words], n=[counts[w] for w in words])

    return (pages.select(F.col(html_col).cast("binary").alias("text")).mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


def segment(name: str, frequencies: dict[str, float], floor: float | None = None) -> list[str]:
    """The most probable split of a name into words (Viterbi over unigrams of log probabilities). An unknown piece costs like a rare
    word (``floor``) and more with every letter, so unknown letters stay together."""
    n = len(name)
    if floor is None:
        floor = min(frequencies.values(), default=-10.0) - 2.0
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            piece = name[start:end]
            score = best[start] + frequencies.get(piece, floor - 3.0 * len(piece))
            if score > best[end]:
                best[end], back[end] = score, start
    out, end = [], n
    while end:
        out.append(name[back[end]:end])
        end = back[end]
    return out[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct names -> (name, words). Each name meets the counts of those of its pieces that are words."""
    length = F.length("name")
    ends = F.sequence(F.col("start"), F.least(length, F.col("start") + LONGEST_WORD - 1))
    piece = (names.select("name", F.explode(F.sequence(F.lit(1), length)).alias("start"))
             .select("name", F.explode(F.transform(ends, lambda e: F.substring(F.col("name"), F.col("start"), e - F.col("start") + 1))).alias("word"))
             .distinct())
    known = piece.join(words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    whole = words.agg(F.sum("n").alias("total"), F.min("n").alias("least")).first()
    total, floor = whole["total"], math.log(whole["least"] / whole["total"]) - 2.0 if whole["total"] else -12.0

    def run(batches):
        schema = pa.schema([("name", pa.string()), ("words", pa.list_(pa.string()))])
        for batch in batches:
            part = batch.to_pydict()
            logs = [{k["word"]: math.log(k["n"] / total) for k in known or ()} for known in part["known"]]
            yield rows(schema, name=part["name"], words=[segment(n, x, floor) for n, x in zip(part["name"], logs)])

    return names.join(known, "name", "left").select("name", "known").mapInArrow(run, "name string, words array<string>")


def host_tokens(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct hosts -> (host, token, c): segmented words of all labels but the last (of the only one), numbers as one kind."""
    labels = F.regexp_replace("host", r"\.[^.]*\z", "")
    part = hosts.select("host", F.explode(F.regexp_extract_all(labels, F.lit(_PARTS), F.lit(1))).alias("name"))
    number = F.col("name").rlike("^[0-9]")
    names = part.filter(~number).select("name").distinct()
    split = stored(segmented(names, words), "names")
    tokens = part.filter(number).select("host", F.lit("h:0").alias("token")).unionByName(
        part.filter(~number).join(split, "name").select("host", F.explode("words").alias("w")).select("host", F.concat(F.lit("h:"), "w").alias("token")))
    return tokens.groupBy("host", "token").agg(F.count(F.lit(1)).alias("c"))


def path_tokens(paths: DataFrame) -> DataFrame:
    """Distinct paths (path_key, path) -> (path_key, token, c), numbers as one kind."""
    part = F.explode(F.regexp_extract_all(F.translate("path", _UPPER, _LOWER), F.lit(_PARTS), F.lit(1)))
    token = F.concat(F.lit("p:"), F.when(F.col("part").rlike("^[0-9]"), "0").otherwise(F.col("part")))
    return (paths.select("path_key", part.alias("part")).select("path_key", token.alias("token"))
            .groupBy("path_key", "token").agg(F.count(F.lit(1)).alias("c")))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (null if none fits), verdict, and score (log odds of block, rounded to
    nine places, where the classifier judged).

    Null urls and urls without :// have empty host and path and are judged by the class priors. Without any url that a rule
    decides everything else is allowed. Equal odds allow. Counts are over all pages, and all words and tokens count. Repeated
    rows count and are judged each for itself. Each distinct host and path is taken apart once; paths are known by their MD5.
    """
    host, path = url_parts(F.col(url_col))
    parted = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = parted.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("path_key", F.md5("path"))
    block, allow = (F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)) for v in ("block", "allow"))

    words = stored(word_counts(pages, html_col), "words")
    hosts = ruled.groupBy("host").agg(block.alias("b"), allow.alias("a"))
    paths = ruled.groupBy("path_key").agg(F.first("path").alias("path"), block.alias("b"), allow.alias("a"))
    of_host = stored(host_tokens(hosts.select("host"), words), "host-tokens")
    of_path = stored(path_tokens(paths.select("path_key", "path")), "path-tokens")

    taught = F.col("b") + F.col("a") > 0
    seen = of_host.join(hosts.filter(taught), "host").select("token", "c", "b", "a").unionByName(
        of_path.join(paths.filter(taught), "path_key").select("token", "c", "b", "a"))
    counts = stored(seen.groupBy("token").agg(F.sum(F.col("c") * F.col("b")).alias("b"), F.sum(F.col("c") * F.col("a")).alias("a")), "url-tokens")
    whole = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("b").alias("b"), F.sum("a").alias("a")).first()
    docs = ruled.agg(F.coalesce(block, F.lit(0)).alias("b"), F.coalesce(allow, F.lit(0)).alias("a")).first()
    unknown = math.log((whole["a"] or 0) + whole["v"] + 1) - math.log((whole["b"] or 0) + whole["v"] + 1)
    prior = math.log(docs["b"] + 1) - math.log(docs["a"] + 1)
    odds = counts.select("token", (F.log(F.col("b") + 1) - F.log(F.col("a") + 1) + unknown).alias("odds"))

    def scores(tokens, key, name):
        return (tokens.join(odds, "token", "left").groupBy(key)
                .agg(F.sum(F.col("c") * F.coalesce("odds", F.lit(unknown))).alias(name)))

    out = ["page_id", "host", "path", "rule"]
    rest = (ruled.filter("verdict is null").join(scores(of_host, "host", "host_score"), "host", "left")
            .join(scores(of_path, "path_key", "path_score"), "path_key", "left")
            .withColumn("score", F.round(prior + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0)), 9)))
    rest = rest.select(*out, F.when(F.col("score") > 0, "block").otherwise("allow").alias("verdict"), "score")
    return ruled.filter("verdict is not null").select(*out, "verdict", F.lit(None).cast("double").alias("score")).unionByName(rest)
