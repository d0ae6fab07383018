"""Secrets: exact base patterns, and further spans judged by who holds a value across the whole corpus.

All patterns run in Spark's regular expressions; split and extract give each match's place.  Broad generators propose
spans that the base patterns do not touch.  The value of every span, base or proposed, is hashed, and the hashes are
aggregated over the corpus by distinct repositories (a text; mirrored copies of one text count once) and distinct
owners.  A value that several owners hold in several different texts is a copied example; one that few owners hold is
specific to them, and if it also looks like a live credential (mixed characters, no placeholder) its proposals are
added.  Counting distinct owners and repositories aggregates before each shuffle, so a value in a third of all texts
loads no task; verdicts on frequent values, at most 1 / SUPPORT rows, go back by broadcast and the others by shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import SPACE, cut, plain_text

KINDS = ("assign", "access", "hex")
#: The contract's patterns; group 2 of the first is the value.  A run of 16 digits is entered where the run begins.
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
}
#: Length that the value of a base match must have.
AT_LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Wider forms of each kind: more names and signs, published token formats, other spellings of hexadecimal digits.
BROAD = {
    "assign": (r"""((?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|auth|bearer|credential|private_?key|access_?key|signature))"""
               r"""[A-Za-z0-9_]{0,24}["']?\x20*(?:=>|:=|==|=|:)\x20*["']?([A-Za-z0-9+/_.=~!@#$%^&*-]{12,})"""),
    "access": (r"(?:ASIA|AGPA|AIDA|AROA|ANPA)[A-Z0-9]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
               r"|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "hex": r"[0-9A-Fa-f]{32,}|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
}
#: A match is possible only where these are found, which is cheaper to see.
HINT = {"assign": r"[:=]>?\x20*+[\"']?+[A-Za-z0-9+/_.=~!@#$%^&*-]{12}", "hex": r"[0-9A-Fa-f]{8}(?:-|[0-9A-Fa-f]{8})"}
HINT_WORDS = ("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "ANPA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-",
              "sk_live_", "AIza", "eyJ")
#: Values with these are placeholders; live ones have letters, digits and at least VARIETY different characters.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|12345678|abcdefgh|00000000"
VARIETY = 8
#: Owners, and different texts, from which on a value is a copied example.
WIDE = 3
#: Share of all spans from which on a value is frequent.
SUPPORT = 1e-3


def _possible(text: Column, kind: str) -> Column:
    if kind == "access":
        return reduce(lambda a, b: a | b, [text.contains(w) for w in HINT_WORDS])
    return text.rlike(HINT[kind])


MATCHES = "array<struct<match:string,value:string,gap:int>>"


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (match, value, code points since the last match); a last entry without a match may follow."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    values = F.regexp_extract_all(text, F.lit(pattern), 2) if kind == "assign" else found
    # zipped rather than looked up: an expression inside a lambda would be evaluated again for each match
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    zipped = F.arrays_zip(found.alias("match"), values.alias("value"), gaps.alias("gap")).cast(MATCHES)
    return F.when(_possible(text, kind) & text.rlike(pattern), zipped).otherwise(F.array().cast(MATCHES))


def _spans(facts: DataFrame) -> DataFrame:
    """row, owner, repo, kind, base, start, end, value: base spans, and proposals that touch none of their kind."""
    each = facts.select("row", "owner", "seen.repo", F.explode("seen.found").alias("own")).select(
        "row", "owner", "repo", "own.kind", "own.base", F.posexplode("own.matches").alias("nth", "m"))
    so_far = Window.partitionBy("row", "kind", "base").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("m.match")
    end = F.sum(F.col("m.gap") + size).over(so_far)
    placed = each.filter("m.match IS NOT NULL").select("row", "owner", "repo", "kind", "base", (end - size).alias("start"), end.alias("end"), F.col("m.value").alias("value"))
    holds = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.char_length("value") >= n) for k, n in AT_LEAST.items()])
    kept = placed.filter(~F.col("base") | holds)
    order = Window.partitionBy("row", "kind").orderBy("start")
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    base_start = F.min(F.when(F.col("base"), F.col("start"))).over(order.rangeBetween(0, Window.unboundedFollowing))
    touches = (F.coalesce(base_end, F.lit(0)) > F.col("start")) | (F.coalesce(base_start, F.col("end")) < F.col("end"))
    return kept.withColumn("touches", touches).filter(F.col("base") | ~F.col("touches")).drop("touches")


def _looks_live(value: Column) -> Column:
    variety = F.size(F.array_distinct(F.regexp_extract_all(value, F.lit(r"(?s)."), 0)))
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (variety >= VARIETY) & ~value.rlike(PLACEHOLDER)


def _judged(spans: DataFrame, wide: int, support: float) -> DataFrame:
    """spans with the owners and repositories of their value, copied, and live."""
    hashed = cut(spans.withColumn("hash", F.unhex(F.sha2(F.lower("value"), 256))), "spans")
    held = cut(hashed.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"),
                                          F.count("*").alias("n")), "held")
    least = hashed.count() * support
    # the counts of all values add up to the spans, so at most 1/support values are frequent
    frequent, others = held.filter(F.col("n") > least), held.filter(F.col("n") <= least)
    hot = hashed.join(F.broadcast(frequent), "hash")
    cold = hashed.join(F.broadcast(frequent.select("hash")), "hash", "left_anti").join(others, "hash")
    copied = F.least("owners", "repos") >= wide
    return hot.unionByName(cold).withColumn("copied", copied).withColumn("live", ~copied & _looks_live(F.col("value")))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", wide: int = WIDE,
            support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, spans (array of start, end, kind, base, value, owners, repos, copied, live).

    Spans come by start, then kind as listed in KINDS; places count code points and end before `end`.  Base spans are
    all there; proposals are there only if live.  A repository is a text, equal up to white space; owner_col names the
    owner, and rows without one share an unknown owner.  Null and empty texts have no spans.  Whole texts are searched,
    however long.  Repeated rows and null ids are rows like any other, columns besides id, text and owner are ignored
    whatever their names, and an empty table gives an empty result.
    """
    text = plain_text(text_col)
    sets = [F.struct(F.lit(k).alias("kind"), F.lit(base).alias("base"), _matches(text, k, patterns[k]).alias("matches"))
            for base, patterns in ((True, BASE), (False, BROAD)) for k in KINDS]
    found = F.filter(F.array(*sets), lambda x: F.size(x["matches"]) > 0)
    owner = F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("unknown"))
    repo = F.unhex(F.sha2(F.encode(F.regexp_replace(text, SPACE, " "), "UTF-8"), 256))
    # one value under one condition, so that most texts meet the hints only
    seen = F.when(reduce(lambda a, b: a | b, [_possible(text, k) for k in KINDS]), F.struct(repo.alias("repo"), found.alias("found")))
    facts = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), owner.alias("owner"),
                            seen.alias("seen")), "facts")
    judged = _judged(_spans(facts), wide, support).filter("base OR live")
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", place.alias("place"), "end", "kind", "base", "value", "owners", "repos", "copied", "live")
    listed = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("listed"))
    plain = "array<struct<start:long,end:long,kind:string,base:boolean,value:string,owners:long,repos:long,copied:boolean,live:boolean>>"
    shown = F.transform("listed", lambda x: F.struct(*[x[n].alias(n) for n in ("start", "end", "kind", "base", "value", "owners", "repos", "copied", "live")]))
    return facts.select("row", "doc_id").join(listed, "row", "left").select(
        "doc_id", F.coalesce(shown, F.array()).cast(plain).alias("spans"))
