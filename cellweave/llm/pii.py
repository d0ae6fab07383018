"""Personal data: exact base patterns, and further spans from boosted trees over broad candidates.

All patterns run in Spark's regular expressions; split and extract give each match's place, and a running sum over a
document's matches gives its code points.  Repetitions are possessive, which keeps them linear in long runs.
Generators with high recall propose candidates that may overlap.  Gradient-boosted trees (Spark ML) are fitted on
two thirds of all labelled candidates, whose labels do not hang on the base patterns' shape.  Positive are base matches, two thirds of them
rewritten in place into other shapes: spelled-out or bracketed signs, a 00 or no prefix, other separators and groups.
Negative are candidates known to be something else: those of the base shape that fail its check (Luhn, numbers up to
255), those that overlap another base match, those inside words, quotes and code, and bare digit runs.  All others are
not labelled; the trees decide about them.  The features describe format and context but not the checks.  For each
kind the lowest threshold (at least one half) is taken at which held-out labelled candidates have the wanted precision;
unlabelled candidates above it that touch no base match are added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import cut, plain_text

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns; a run is entered at its start or where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A match is possible only where these are found, which is cheaper to see.
HINT = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?+){11}[0-9]", "phone": r"\+[0-9]"}
#: Broad candidates of each kind.
BROAD = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\x20?(?:\.|\(dot\)|\[\.\])\x20?[0-9]{1,3}+){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}+[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00|\()?+[0-9](?:[\x20()./-]{0,3}+[0-9]){7,14}+(?![0-9])",
}
BROAD_HINT = {"email": r"@|[(\[{]at[)\]}]", "ip": r"[0-9]\x20?[.(\[]", "card": r"(?:[0-9][\x20._/-]{0,2}+){11}[0-9]", "phone": r"(?:[0-9][\x20()./-]{0,3}+){7}[0-9]"}
CONTEXT = {"mail_word": r"(?i)mail|contact|write|kontakt|correo|courriel", "call_word": r"(?i)phone|tel|call|fax|mobil|handy",
           "card_word": r"(?i)card|visa|credit|karte|carte|tarjeta|iban", "net_word": r"(?i)\bip\b|host|server|address",
           "secret_word": r"(?i)token|key|secret|hash|version|isbn|order"}
#: What a candidate of the base shape looks like, whether or not it passes its check.
SHAPES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}",
          "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
#: Trees and their depth; precision that thresholds ask for.
TREES, DEPTH, PRECISION = 15, 4, 0.9
LEFT, RIGHT = 24, 12


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """Array of (text of the match, code points since the last match, context before and after)."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    # zipped rather than looked up: an expression inside a lambda would be evaluated again for each match
    zipped = F.filter(F.arrays_zip(found.alias("match"), gaps.alias("before"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("after")), lambda x: x["match"].isNotNull())

    def one(x: Column) -> Column:
        size = F.char_length(x["before"])
        return F.struct(x["match"].alias("match"), size.alias("gap"),
                        F.substring(x["before"], F.greatest(size - LEFT, F.lit(0)) + 1, F.lit(LEFT)).alias("left"),
                        F.substring(x["after"], 1, RIGHT).alias("right"))
    empty = F.array().cast("array<struct<match:string,gap:int,left:string,right:string>>")
    return F.when(text.rlike(hint), F.transform(zipped, one)).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digit sum with every second digit from the right doubled is a multiple of ten; up to 19 digits."""
    padded = F.lpad(digits, 20, "0")
    plain = [F.substring(padded, i, 1).cast("int") for i in range(2, 21, 2)]
    twice = [F.translate(F.substring(padded, i, 1), "0123456789", "0246813579").cast("int") for i in range(1, 21, 2)]
    return reduce(lambda a, b: a + b, plain + twice) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """The check that a base match must pass."""
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(12, 19) & _luhn(F.when(F.length(digits).between(12, 19), digits).otherwise("0"))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _placed(facts: DataFrame, column: str) -> DataFrame:
    """A row for each match: row, kind, start, end, match, left, right."""
    each = facts.select("row", F.explode(column).alias("own")).select("row", F.col("own.kind").alias("kind"), F.posexplode("own.found").alias("nth", "m"))
    order = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("m.match")
    end = F.sum(F.col("m.gap") + size).over(order)
    return each.select("row", "kind", (end - size).cast("long").alias("start"), end.cast("long").alias("end"), "m.match", "m.left", "m.right")


def _features(candidates: DataFrame) -> tuple[DataFrame, list[str]]:
    m, shape = F.col("match"), {}
    digits = _digits(m)
    shape |= {f"is_{k}": F.col("kind") == k for k in KINDS}
    shape |= {"length": F.char_length(m), "digits": F.length(digits), "letters": F.length(F.regexp_replace(m, r"[^A-Za-z]", ""))}
    shape |= {f"n_{n}": F.char_length(m) - F.char_length(F.replace(m, F.lit(c))) for n, c in
              (("space", " "), ("dash", "-"), ("dot", "."), ("open", "("), ("plus", "+"), ("at", "@"), ("slash", "/"))}
    shape |= {"groups": F.size(F.split(m, r"[^0-9A-Za-z]+", -1)), "spelled": m.rlike(r"[(\[{](?:at|dot)[)\]}]"),
              "first_group": F.length(F.regexp_extract(m, r"^\+?([0-9A-Za-z]+)", 1))}
    shape |= {"after_word": F.col("left").rlike(r"[\p{L}0-9_]$"), "before_word": F.col("right").rlike(r"^[\p{L}0-9_]"),
              "in_quotes": F.col("left").rlike(r"[\"'=][0-9A-Za-z]*$"), "after_space": F.col("left").rlike(r"(?:^|\s)$")}
    shape |= {n: F.col("left").rlike(p) for n, p in CONTEXT.items()}
    return candidates.select("*", *[c.cast("double").alias(n) for n, c in shape.items()]), list(shape)


def _rewritten(kind: Column, match: Column, way: Column) -> Column:
    """A base match in another shape of its kind; way 0 leaves it."""
    digits = _digits(match)

    def grouped(size: int, sign: str) -> Column:
        return F.regexp_replace(digits, f"([0-9]{{{size}}})(?=[0-9])", f"$1{sign}")

    def ways(one: Column, two: Column) -> Column:
        return F.when(way == 1, one).otherwise(two)
    spelled = F.regexp_replace(F.regexp_replace(match, "@", " (at) "), r"\.", " (dot) ")
    return (F.when(way == 0, match)
            .when(kind == "email", ways(spelled, F.regexp_replace(match, "@", "[at]")))
            .when(kind == "ip", ways(F.regexp_replace(match, r"\.", "[.]"), F.regexp_replace(match, r"\.", " (dot) ")))
            .when(kind == "card", ways(grouped(4, "."), grouped(4, "/")))
            .otherwise(ways(F.concat(F.lit("00"), F.regexp_replace(match, r"^\+", "")), F.concat(F.lit("("), grouped(3, ") ")))))


def _labelled(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """candidates with label (1.0, 0.0 or null) and `meets`, whether they overlap a base match of any kind."""
    known = base.select("row", "kind", "start", "end", F.lit(1).alias("base"))
    seen = candidates.join(known, ["row", "kind", "start", "end"], "left")
    both = seen.unionByName(base.select("row", "kind", "start", "end", F.lit(2).alias("base")), allowMissingColumns=True)
    by_place = Window.partitionBy("row").orderBy("start")
    other_end = F.max(F.when(F.col("base") == 2, F.col("end"))).over(by_place.rangeBetween(Window.unboundedPreceding, 0))
    other_start = F.min(F.when(F.col("base") == 2, F.col("start"))).over(by_place.rangeBetween(0, Window.unboundedFollowing))
    meets = (F.coalesce(other_end, F.lit(0)) > F.col("start")) | (F.coalesce(other_start, F.col("end")) < F.col("end"))
    placed = both.withColumn("meets", meets).filter("base IS NULL OR base = 1")
    m, left, right = F.col("match"), F.col("left"), F.col("right")
    shaped = reduce(lambda a, b: a | b, [(F.col("kind") == k) & m.rlike(f"^{SHAPES[k]}$") for k in KINDS])
    coded = left.rlike(r"[\p{L}0-9_]$") | right.rlike(r"^[\p{L}0-9_]") | left.rlike(r"[\"'=#/][0-9A-Za-z]*$")
    no = F.col("meets") | shaped | coded | ((F.col("kind") != "email") & m.rlike("^[0-9]+$"))
    label = F.when(F.col("base") == 1, F.lit(1.0)).when(no, F.lit(0.0))
    return placed.withColumn("label", label).drop("base")


def _selected(candidates: DataFrame, base: DataFrame) -> DataFrame | None:
    """Candidates that the trees add: row, kind, start, end."""
    labelled = cut(_labelled(candidates, base), "candidates")
    if labelled.filter("label IS NOT NULL").select("label").distinct().count() < 2:
        return None
    way = F.when(F.col("label") == 1, F.pmod(F.xxhash64("start", "row"), F.lit(3))).otherwise(0)
    lesson = labelled.filter("label IS NOT NULL").withColumn("match", _rewritten(F.col("kind"), F.col("match"), way))
    described, names = _features(lesson)
    drawn = cut(described.withColumn("held", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(3)) == 0), "drawn")
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    taught = assembler.transform(drawn.filter("NOT held")).select("features", "label")
    if {r.label for r in taught.select("label").distinct().collect()} != {0.0, 1.0}:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, maxBins=32).fit(taught)

    def scored(rows: DataFrame) -> DataFrame:
        found = model.transform(assembler.transform(rows))
        return found.withColumn("p", vector_to_array("probability")[1])

    bins = (scored(drawn.filter("held")).groupBy("kind", F.floor(F.col("p") * 100).alias("bin"))
            .agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy("kind", F.desc("bin")).collect())
    limits: dict[str, float] = {}
    good, n, kind = 0.0, 0, None
    for r in bins:  # at most 101 for each kind
        good, n = (good + r.good, n + r.n) if r.kind == kind else (r.good, r.n)
        kind = r.kind
        if good / n >= PRECISION and r.bin >= 50:
            limits[kind] = r.bin / 100
    if not limits:
        return None
    passes = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("p") >= v) for k, v in limits.items()])
    asked, _ = _features(labelled.filter("label IS NULL"))
    return scored(asked).filter(passes).select("row", "kind", "start", "end")


def _joined(spans: DataFrame, name: str) -> DataFrame:
    """row and its spans as kind:start:end, by start, then kind as listed."""
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    listed = F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind")))
    text = F.transform(listed, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"{name}_{k}") for k in KINDS]
    return spans.groupBy("row").agg(F.array_join(text, ",").alias(name), *counts)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are those of base matches; `spans` also holds what the trees add (n_added).  Null and
    empty texts have no spans.  Repeated rows and null ids are searched like any other row; an empty table gives an
    empty result.  Without base matches, or without other candidates, nothing is learned and nothing added.
    """
    text = plain_text(text_col)

    def all_kinds(patterns: dict[str, str], hints: dict[str, str]) -> Column:
        own = [F.struct(F.lit(k).alias("kind"), _matches(text, patterns[k], hints[k]).alias("found")) for k in KINDS]
        return F.filter(F.array(*own), lambda x: F.size(x["found"]) > 0)

    facts = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                            all_kinds(BASE, HINT).alias("base"), all_kinds(BROAD, BROAD_HINT).alias("broad")), "matches")
    holds = reduce(lambda a, b: a | b, [(F.col("kind") == k) & _holds(k, F.col("match")) for k in KINDS])
    base = cut(_placed(facts, "base").filter(holds).select("row", "kind", "start", "end"), "base")
    digits = F.length(_digits(F.col("match")))
    broad = _placed(facts, "broad").filter((F.col("kind") != "phone") | digits.between(9, 15))
    added = _selected(broad, base)
    spans = base if added is None else base.unionByName(cut(added, "added").distinct())
    out = facts.select("row", "doc_id").join(_joined(base, "base"), "row", "left").join(
        _joined(spans, "spans"), "row", "left")
    zero = F.lit(0).cast("long")
    total = [reduce(lambda a, b: a + b, [F.coalesce(f"{n}_{k}", zero) for k in KINDS]) for n in ("spans", "base")]
    return out.select("doc_id", *[F.coalesce(f"base_{k}", zero).alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
                      (total[0] - total[1]).alias("n_added"))
