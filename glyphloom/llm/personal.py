"""Personal data: candidate spans, boosted trees and calibrated thresholds, in DataFrame expressions only.

Generators with high recall propose spans by pattern; a span is found by splitting the text at the
matches and adding up the lengths, so everything stays row-local and no text is shuffled. Four base
kinds are always spans. Gradient-boosted trees decide on the other candidates from their format and
context; they are fitted by Spark ML on the candidates of all documents, as counts of equal feature
vectors, and read out into one expression that is evaluated beside the patterns.

The trees learn from distant labels: a candidate counts as personal where a base span overlaps it or
a credential is being assigned. The threshold is the lowest score that reaches TARGET_PRECISION on the
third of the documents not used for fitting.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Base kinds, in the order in which spans are listed. A start inside a run can only fail like the run's own start, so look-behinds keep
#: matching linear; possessive loops give nothing back and do not recurse.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators of further candidates.
EXTRA = {
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+",
    "number": r"(?<![0-9A-Za-z+])[0-9][0-9 ().-]{5,}[0-9]",
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]++",
}
#: Shape of the trees; quantiles of a feature, over all candidates, at which they may split; steps of the margin in which the threshold is sought.
TREES, DEPTH, QUANTILES, STEPS = 12, 3, 64, 1024
#: Spark ML looks at every row for the places of splits up to the square of this.
ML_BINS = 1024
TARGET_PRECISION = 0.98

FEATURES = ["length", "digits", "letters", "upper", "marks", "distinct", "luhn", "secret", "number", "contact", "assigned", "named", "quoted", "closed", "lead_digit"]
#: Those of many values.
COUNTS = FEATURES[:6]


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array of (start, end, value), in code points."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc, m):
        a = acc["at"] + F.length(m["between"])
        b = a + F.length(m["found"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), m["found"].alias("value")))).alias("out"))

    zipped = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda f, b: F.struct(f.alias("found"), b.alias("between")))
    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(start["out"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return v.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(v))
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(v))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid base spans: array of (kind, start, end), by kind as listed, then start."""
    def spans(kind, pattern):
        valid = F.filter(matches(text, pattern), lambda m: _valid(kind, m["value"]))
        return F.transform(valid, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*(spans(k, p) for k, p in BASE.items()))


def candidates(text: Column, base: Column) -> Column:
    """Candidates of the further generators with features and distant label."""
    def described(kind, m):
        v, before = m["value"], F.substring(text, F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24)))
        after = F.substring(text, m["end"] + 1, F.lit(1))
        size = F.length(v)
        count = lambda chars: (size - F.length(F.regexp_replace(v, chars, ""))).cast("double")
        yes = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
        assigned = yes(F.lower(before).rlike(r"(?:token|key|secret|passw\w*|pwd|bearer|auth)\W{0,4}$"))
        overlaps = F.exists(base, lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"]))
        fields = {
            "length": size.cast("double"), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "upper": count("[A-Z]"), "marks": count("[^A-Za-z0-9]"),
            "distinct": F.size(F.array_distinct(F.split(v, ""))).cast("double"), "luhn": yes(F.call_function("luhn_check", _digits(v))),
            **{k: F.lit(float(k == kind)) for k in EXTRA}, "assigned": assigned,
            "named": yes(F.lower(before).rlike(r"(?:tel|phone|call|mobile|fax|mail|contact|card|account|iban|ssn|passport|licen[cs]e no|id)\W{0,4}$")),
            "quoted": yes(before.rlike("[\"'=:]$")), "closed": yes(after.rlike("[\"',;]")), "lead_digit": yes(v.rlike("^[0-9]")),
        }
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), overlaps.alias("covered"), (overlaps | (assigned > 0)).cast("double").alias("label"), *(c.alias(f) for f, c in fields.items()))

    def useful(kind, v):
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]") if kind == "secret" else F.length(_digits(v)).between(7, 25) if kind == "number" else F.lit(True)

    def spans(kind, pattern):
        return F.transform(F.filter(matches(text, pattern), lambda m: useful(kind, m["value"])), lambda m: described(kind, m))

    return F.concat(*(spans(k, p) for k, p in EXTRA.items()))


@dataclass
class Boosted:
    """Trees as (feature, threshold, left, right) or leaf values, their weights, and the margin from which a span is taken."""

    trees: list
    weights: list[float]
    threshold: float

    def margin(self, feature) -> Column:
        def tree(node):
            return F.lit(node) if isinstance(node, float) else F.when(feature(FEATURES[node[0]]) <= node[1], tree(node[2])).otherwise(tree(node[3]))

        return reduce(lambda a, b: a + b, (tree(t) * w for t, w in zip(self.trees, self.weights)))


def _node(n, edges: list[list[float]]):
    """A tree as tuples; splits between places become splits at the edges between these."""
    if n.subtreeDepth() == 0:
        return float(n.prediction())
    f = n.split().featureIndex()
    return f, edges[f][int(n.split().threshold())], _node(n.leftChild(), edges), _node(n.rightChild(), edges)


def _places(edges: list[list[float]]) -> list[Column]:
    """Every feature as the number of its edges below the value."""
    def below(c, e):
        return F.size(F.filter(F.lit(e).cast("array<double>"), lambda x: x < F.col(c))).cast("double").alias(c)

    return [below(c, e) for c, e in zip(FEATURES, edges)]


def fit(docs: DataFrame) -> Boosted | None:
    """Fit on the candidates of all documents, two thirds of them for the trees and a third, by hashed ids, for the threshold; None where
    the former hold no candidates of both labels.

    Equal feature vectors are one weighted row. Trees split at quantiles over all candidates.
    """
    text = F.coalesce("text", F.lit(""))
    held = (F.pmod(F.xxhash64(F.col("doc_id")), F.lit(3)) == 0).alias("held")
    found = docs.select(held, text.alias("text")).withColumn("base", base_spans(F.col("text")))
    rows = found.select("held", F.explode(candidates(F.col("text"), F.col("base"))).alias("c")).select("held", "c.label", *(f"c.{f}" for f in FEATURES))
    rows = rows.groupBy("held", "label", *FEATURES).agg(F.count("*").alias("n")).cache()
    try:
        train = rows.where("NOT held")
        shares = F.array(*(F.lit(i / QUANTILES) for i in range(1, QUANTILES)))
        counts = train.agg(F.sum("n"), F.sum(F.col("label") * F.col("n")), *(F.percentile(c, shares, F.col("n")) for c in COUNTS)).first()
        if not counts[0] or counts[1] in (0, counts[0]):
            return None
        edges = [sorted(set(e)) for e in counts[2:]] + [[0.0]] * (len(FEATURES) - len(COUNTS))
        placed = train.select("label", "n", *_places(edges)).groupBy("label", *FEATURES).agg(F.sum("n").cast("double").alias("n"))
        vectors = placed.select("label", "n", array_to_vector(F.array(*FEATURES)).alias("features"))
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=ML_BINS, weightCol="n", seed=1).fit(vectors)
        boosted = Boosted([_node(t._java_obj.rootNode(), edges) for t in model.trees], [float(w) for w in model.treeWeights], 0.0)
        step = (F.floor(boosted.margin(F.col) * STEPS) / STEPS).alias("m")
        scored = rows.where("held").select("label", "n", step).groupBy("m").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("all"))
        down = Window.orderBy(F.desc("m"))  # steps of a bounded range
        best = scored.select("m", (F.sum("good").over(down) / F.sum("all").over(down)).alias("precision")).where(F.col("precision") >= TARGET_PRECISION).agg(F.min("m")).first()[0]
        boosted.threshold = max(0.0, best) if best is not None else float("inf")
        return boosted
    finally:
        rows.unpersist()


def find_spans(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs with base (array of kind, start, end) and added (the same, of the other generators' kinds).

    Null text counts as empty. Positions are code points, end exclusive. Other columns stay.
    """
    out = docs.withColumn("base", base_spans(F.coalesce("text", F.lit(""))))
    kind = "array<struct<kind:string,start:int,end:int>>"
    if model is None or model.threshold == float("inf"):
        return out.withColumn("added", F.array().cast(kind))
    chosen = F.filter(candidates(F.coalesce("text", F.lit("")), F.col("base")), lambda c: ~c["covered"] & (model.margin(lambda f: c[f]) >= model.threshold))
    return out.withColumn("added", F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs with every span of `text` replaced by its kind in angle brackets; overlapping spans by the first one's."""
    found = find_spans(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def step(acc, s):
        end = -s["end"]
        fresh = F.struct(end.alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], end).alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    clean = F.when(F.size(spans) > 0, rest).otherwise(F.col("text"))
    return found.select(*(F.col("row")[c].alias(c) if c != "text" else clean.alias("text") for c in docs.columns))
