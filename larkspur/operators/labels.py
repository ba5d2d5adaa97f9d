"""Fields of scanned lines by their labels, also where a scan has misread some characters.

Labels are an index of pieces: a label that may be misread in e places is cut into e + 1 pieces, of which any line that
holds the label so misread has one unchanged. Lines meet labels on such pieces only, so no line is tested against
every label; what has met is then compared by edit distance around the place of the piece.

Lines are rows (page, line_no, text). A value is what follows its label on the line, or else the line below. Values are
scored, and the best of a page and field is taken, of equal ones the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import names as N
from larkspur.sources.shared import written

# Points of a candidate, and the limits of the words for confidence.
WHOLE, EDIT, BELOW, INSIDE, COLON = 90.0, 15.0, 20.0, 10.0, 8.0
HIGH, FAIR = 90.0, 70.0
#: A label of this many characters may be misread in one place, of twice as many in two.
PER_EDIT = 4
MOST_EDITS = 2
#: What ends a value within its line, and what stands between a label and its value.
VALUE_END, BETWEEN = r"[，,;；]|\s{2,}", r"^[\s:：=＝]+"


def folded(c: Column) -> Column:
    """Characters as they are compared: each for itself, so places stay."""
    return F.translate(F.lower(N.narrow(F.coalesce(c, F.lit("")))), N.VARIANTS, N.PLAIN)


def pieces(labels: DataFrame) -> DataFrame:
    """field, label, edits, piece, start, length: the index of labels (field, label)."""
    text = folded(F.regexp_replace("label", r"[\s:：]+$", ""))
    own = labels.select("field", text.alias("label")).where("label <> ''").distinct()
    own = own.withColumn("edits", F.least(F.lit(MOST_EDITS), F.floor(F.length("label") / PER_EDIT)).cast("int"))
    n = F.length("label")
    cut = lambda i: F.floor(i * n / (F.col("edits") + 1)).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("edits")), lambda i: F.struct(cut(i).alias("start"), F.substring(F.col("label"), cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")))
    return own.withColumn("p", F.explode(each)).select("field", "label", "edits", "p.piece", "p.start", F.length("p.piece").alias("length"))


def candidates(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """page, line_no, field, label, edits, at (where the label begins), value, below (found on the next line), score."""
    index = written(pieces(labels), "label_pieces")  # so that its size is known
    lengths = [r["length"] for r in index.select("length").distinct().collect()]  # as many as labels have characters
    by_place = Window.partitionBy("page").orderBy("line_no")  # one page
    here = lines.select("page", "line_no", F.coalesce("text", F.lit("")).alias("text")).withColumn("next", F.lead("text").over(by_place)).withColumn("plain", folded(F.col("text")))
    n = F.length("plain")
    runs = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.struct(F.substring(F.col("plain"), i, F.lit(size)).alias("piece"), (i - 1).alias("place")))).otherwise(F.array().cast("array<struct<piece:string,place:int>>"))
    if not lengths:
        lengths = [1]
    grams = here.select("page", "line_no", F.explode(F.concat(*[runs(k) for k in sorted(lengths)])).alias("g")).select("page", "line_no", "g.piece", "g.place")
    met = grams.join(index, "piece").select("page", "line_no", "field", "label", "edits", (F.col("place") - F.col("start")).alias("at")).distinct()
    near = met.join(here.hint("merge"), ["page", "line_no"])

    # the label stands where its piece says, give or take the edits before it; its end moves by all edits
    size = F.length("label")
    spans = F.flatten(F.transform(F.sequence(-F.col("edits"), F.col("edits")), lambda a: F.transform(F.sequence(-F.col("edits"), F.col("edits")), lambda b: F.struct((F.col("at") + a).alias("at"), (size + b).alias("size")))))
    fits = F.filter(spans, lambda s: (s["at"] >= 0) & (s["size"] > 0) & (s["at"] + s["size"] <= n))
    # of equal fits the one that ends where a label ends, then the one of the label's length
    loose = lambda s: (~F.substring(F.col("plain"), s["at"] + s["size"] + 1, F.lit(1)).rlike(r"^[\s:=]?$")).cast("int")
    told = F.transform(fits, lambda s: F.struct(F.levenshtein(F.substring(F.col("plain"), s["at"] + 1, s["size"]), F.col("label")).alias("edits"), loose(s).alias("loose"), F.abs(s["size"] - size).alias("off"), s["at"].alias("at"), s["size"].alias("size")))
    near = near.withColumn("hit", F.array_min(told)).where("hit.edits <= edits")
    rest = F.substring(F.col("text"), F.col("hit.at") + F.col("hit.size") + 1, F.length("text"))
    clean = lambda c: F.trim(F.get(F.split(F.regexp_replace(c, BETWEEN, ""), VALUE_END), F.lit(0)))
    near = near.withColumns({"own": clean(rest), "colon": rest.rlike(r"^\s*[:：]")})
    below = F.col("own") == ""
    value = F.when(below, clean(F.coalesce("next", F.lit("")))).otherwise(F.col("own"))
    score = WHOLE - EDIT * F.col("hit.edits") - F.when(below, BELOW).otherwise(0.0) - F.when(F.col("hit.at") > 0, INSIDE).otherwise(0.0) + F.when(F.col("colon"), COLON).otherwise(0.0)
    each = near.select("page", "line_no", "field", "label", F.col("hit.edits").alias("edits"), F.col("hit.at").alias("at"), value.alias("value"), below.alias("below"), score.alias("score")).where("value <> ''").distinct()
    each = written(each, "label_candidates")
    # a label within a longer one that fits as well says less: of those that begin within it the longest stays
    longer = each.select("page", "line_no", F.col("at").alias("_a"), F.length("label").alias("_n"), F.col("edits").alias("_e"))
    inside = (F.col("_n") > F.length("label")) & (F.col("_e") <= F.col("edits")) & (F.col("at") >= F.col("_a")) & (F.col("at") < F.col("_a") + F.col("_n"))
    return each.join(longer, (each["page"] == longer["page"]) & (each["line_no"] == longer["line_no"]) & inside, "left_anti")


def best_fields(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """page, field, value, label, score, confidence (matcher-high, matcher, review): the best candidate of each page and field."""
    order = F.struct(F.col("score"), -F.col("line_no"), -F.col("at"), F.length("label"), "label", "value")
    best = candidates(lines, labels).groupBy("page", "field").agg(F.max_by(F.struct("value", "label", "score"), order).alias("b"))
    confidence = reduce(lambda a, x: a.when(F.col("b.score") >= x[0], x[1]), [(FAIR, "matcher")], F.when(F.col("b.score") >= HIGH, "matcher-high")).otherwise("review")
    return best.select("page", "field", "b.*", confidence.alias("confidence"))
