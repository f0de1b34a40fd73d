"""Personal data by candidate gradient boosting, in native Spark expressions.

Strict patterns give the base spans.  Looser generators propose overlapping
candidates for each kind; boosted trees over their format and context score
those apart from the base inside the row, and per-kind thresholds calibrated on
held-back candidates select which are added to it.  The trees are learned on a
bounded sample: real ones are base spans written in a looser form in their own
context, false ones the candidates that are not strict when written out; those
that are may be either and are not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: documents that are learned from at most (as expected by a hash of their ids)
SAMPLE_DOCS = 20_000
#: candidates of a kind that are learned from at most
SAMPLE_CANDIDATES = 20_000
TREES = 24
DEPTH = 3
SHRINK = 0.3
BINS = 32
LEAST = 5
#: share of candidates above a threshold that must be real on held-back ones
PRECISION = 0.95
CONTEXT = 24

#: the base patterns, written so that Java tries each stretch once: a start inside a
#: stretch of the first class can only match where the stretch's own start (or the end of
#: the match before, \G) does
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: the generators: high recall, overlapping the base and each other
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9.-]{2,255}+(?![(\[]at[)\]])",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+){2,5}+",
    "card": r"(?<![0-9])[0-9]{2,7}+(?:[\x20./_-]{0,2}+[0-9]{2,7}+){1,6}+",
    "phone": r"(?:\+|\(|(?<![0-9]))[0-9]{1,5}+(?:[\x20()./-]{1,3}+[0-9]{2,8}+){1,5}+",
}
#: characters beside a base span that a looser form of it is searched in
BESIDE = 64
#: the looser forms of base spans that are learned from: (pattern, replacement) in turn
FORMS = {
    "email": [[("@", at)] for at in ("(at)", "[at]", " (at) ", " [at] ", " @ ", " @", "@ ")],
    "ip": [[(r"\.", dot)] for dot in ("[.]", "(.)")],
    "card": [[(r"[^0-9]", ""), (r"([0-9]{4})(?=[0-9])", f"$1{by}")] for by in (".", "/", "_", " - ", "--")],
    "phone": [
        [(r"^\+[0-9]{1,3}[\x20.-]*(?=\()", "")],
        [(r"^\+", "")],
        [(r"^\+", "00")],
        [(r"^\+[0-9]{1,3}[\x20.-]+", ""), (r"[()]", ""), (r"[\x20.]", "-")],
    ],
}
#: words near personal data, fixed values
WORDS = "(?i)mail|contact|phone|tel|call|fax|mobile|card|visa|credit|account|host|addr|server|ip"
FEATURES = ("chars", "digits", "letters", "blanks", "dots", "dashes", "brackets", "plus", "at", "first_run", "last_run", "touches_before", "touches_after", "word_near", "written_out")

SPANS = "array<struct<start:int,end:int,value:string>>"


def locate(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their code point offsets.

    What lies between the matches gives their places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("value"))
    placed = F.aggregate(
        F.slice(pairs, F.lit(1), F.size(found)),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["gap"]) + F.length(p["value"])).alias("at"),
            F.concat(
                a["out"],
                F.array(
                    F.struct(
                        (a["at"] + F.length(p["gap"])).alias("start"),
                        (a["at"] + F.length(p["gap"]) + F.length(p["value"])).alias("end"),
                        p["value"].alias("value"),
                    )
                ),
            ).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def written_out(kind: str, value: Column) -> Column:
    """Whether a candidate in looser form is strict when written out."""
    if kind == "email":
        return F.regexp_replace(value, r"\x20?(?:@|\(at\)|\[at\])\x20?", "@").rlike(rf"^{BASE['email']}\.?$")
    if kind == "ip":
        plain = F.regexp_replace(value, r"[()\[\]]", "")
        return plain.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & _valid("ip", plain)
    if kind == "card":
        return _valid("card", value)
    shape = r"^\+|\(|^00|^[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}$"
    return _valid("phone", value) & value.rlike(shape)


def features(kind: str, text: Column, c: Column) -> Column:
    """Format and context of a candidate, as an array of ints in the order of FEATURES."""
    value, start, end = c["value"], c["start"], c["end"]
    count = lambda pattern: F.length(F.regexp_replace(value, f"[^{pattern}]+", ""))
    before = F.substr(text, F.greatest(F.lit(1), start + 1 - CONTEXT), F.least(F.lit(CONTEXT), start))
    return F.array(
        F.length(value),
        count("0-9"),
        count("A-Za-z"),
        count(r"\x20"),
        count("."),
        count(r"\-"),
        count(r"()\[\]"),
        count("+"),
        count("@"),
        F.length(F.regexp_extract(value, "[0-9]+", 0)),
        F.length(F.regexp_extract(value, "([0-9]*)[^0-9]*$", 1)),
        before.rlike(r"[\p{L}0-9@=\"'_-]$").cast("int"),
        F.substr(text, end + 1, F.lit(1)).rlike(r"[\p{L}0-9@=\"'_-]").cast("int"),
        before.rlike(WORDS).cast("int"),
        written_out(kind, value).cast("int"),
    )


def _overlaps(c: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))


def _placed(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc, text, base_<kind>, loose_<kind>): ``doc`` is a struct of the row's own columns."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    text = F.col("text")
    found = rows.select("doc", "text", *[locate(text, BASE[k]).alias(f"b_{k}") for k in KINDS], *[locate(text, LOOSE[k]).alias(f"loose_{k}") for k in KINDS])
    valid = lambda k: lambda s: _valid(k, s["value"])
    base = [F.filter(f"b_{k}", valid(k)).alias(f"base_{k}") for k in KINDS]
    return found.select("doc", "text", *base, *[f"loose_{k}" for k in KINDS])


@dataclass
class Split:
    """A node: rows with ``feature`` <= ``at`` go left; a leaf is a number."""

    feature: int
    at: float
    left: Split | float
    right: Split | float

    def values(self, x: np.ndarray) -> np.ndarray:
        side = lambda n, rows: n.values(rows) if isinstance(n, Split) else np.full(len(rows), n)
        low = x[:, self.feature] <= self.at
        out = np.empty(len(x))
        out[low], out[~low] = side(self.left, x[low]), side(self.right, x[~low])
        return out

    def column(self, x: Column) -> Column:
        side = lambda n: n.column(x) if isinstance(n, Split) else F.lit(float(n))
        return F.when(F.get(x, self.feature) <= self.at, side(self.left)).otherwise(side(self.right))


def _tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int) -> Split | float:
    """A regression tree on the second-order loss."""
    g, h = gradient.sum(), hessian.sum()
    leaf = SHRINK * g / (h + 1)
    if not depth or len(x) < 2 * LEAST:
        return leaf
    best, pick = 1e-6, None
    for f in range(x.shape[1]):
        known = np.unique(x[:, f])
        cuts = np.unique(np.quantile(known, np.linspace(0, 1, BINS), method="lower"))[:-1]
        for at in cuts:
            low = x[:, f] <= at
            n = int(low.sum())
            if LEAST <= n <= len(x) - LEAST:
                a, b = gradient[low].sum(), hessian[low].sum()
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best:
                    best, pick = gain, (f, float(at), low)
    if pick is None:
        return leaf
    f, at, low = pick
    return Split(f, at, _tree(x[low], gradient[low], hessian[low], depth - 1), _tree(x[~low], gradient[~low], hessian[~low], depth - 1))


@dataclass
class Boosted:
    """Trees of one kind and the score from which a candidate is selected."""

    start: float
    trees: list
    threshold: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += t.values(x) if isinstance(t, Split) else t
        return out

    def column(self, x: Column) -> Column:
        out = F.lit(self.start)
        for t in self.trees:
            out = out + (t.column(x) if isinstance(t, Split) else F.lit(float(t)))
        return out


def boost(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Boosted | None:
    """Gradient boosting of the logistic loss; None where no threshold is precise enough."""
    grown, kept = ~held, held
    if not y[grown].any() or y[grown].all() or not y[kept].any():
        return None
    rate = y[grown].mean()
    model = Boosted(float(np.log(rate / (1 - rate))), [])
    score = model.scores(x[grown])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x[grown], y[grown] - p, p * (1 - p), DEPTH)
        model.trees.append(tree)
        score += tree.values(x[grown]) if isinstance(tree, Split) else tree
    s, real = model.scores(x[kept]), y[kept]
    order = np.argsort(-s, kind="stable")
    share = np.cumsum(real[order]) / np.arange(1, len(order) + 1)
    # rows of one score stand or fall together
    last = np.r_[s[order][1:] != s[order][:-1], True]
    fits = np.flatnonzero(last & (share >= PRECISION))
    if not len(fits):
        return None
    model.threshold = float(s[order][fits[-1]]) - 1e-9
    return model


def _loosened(placed: DataFrame, kind: str) -> DataFrame:
    """(kind, held, x) of base spans of ``placed`` that are written in a looser form, which a hash chooses, in their context."""
    spans = placed.select("held", "text", F.explode(f"base_{kind}").alias("s")).select(
        "held",
        F.col("s.value").alias("value"),
        F.substr("text", F.greatest(F.lit(1), F.col("s.start") + 1 - BESIDE), F.least(F.lit(BESIDE), F.col("s.start"))).alias("before"),
        F.substr("text", F.col("s.end") + 1, F.lit(BESIDE)).alias("after"),
    )
    loose, chosen = F.col("value"), F.pmod(F.xxhash64("value", "before"), F.lit(len(FORMS[kind])))
    for k, steps in enumerate(FORMS[kind]):
        own = F.col("value")
        for pattern, by in steps:
            own = F.regexp_replace(own, pattern, by)
        loose = F.when(chosen == k, own).otherwise(loose)
    written = spans.select("held", F.length("before").alias("at"), loose.alias("loose"), F.concat("before", loose, "after").alias("text"))
    found = written.select("held", "at", "loose", "text", F.explode(locate(F.col("text"), LOOSE[kind])).alias("c"))
    end = F.col("at") + F.length("loose")
    # the candidate that holds the greater part of the span
    inside = F.least(end, F.col("c.end")) - F.greatest("at", F.col("c.start"))
    real = found.where((2 * inside > F.length("loose")) & written_out(kind, F.col("c.value")))
    return real.select(F.lit(kind).alias("kind"), "held", F.lit(True).alias("real"), features(kind, F.col("text"), F.col("c")).alias("x"))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Boosted]:
    """The models by kind; a kind without base spans, or without a precise enough threshold, has none.

    Where no candidate is known to be false, those are selected that are
    strict when written out.
    """
    total = docs.count()
    if not total:
        return {}
    million = 1_000_000
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        F.pmod(F.xxhash64("id"), F.lit(million)) < min(million, million * sample_docs // total + 1)
    )
    placed = _placed(some, "text").withColumn("held", F.pmod(F.xxhash64("doc.id", F.lit("held")), F.lit(3)) == 0)

    def marked(k: str):
        return lambda c: F.struct(F.lit(k).alias("kind"), F.col("held"), F.lit(False).alias("real"), features(k, F.col("text"), c).alias("x"))

    apart = lambda k: lambda c: ~_overlaps(c, F.col(f"base_{k}"))
    every = placed.select(F.explode(F.concat(*[F.transform(F.filter(f"loose_{k}", apart(k)), marked(k)) for k in KINDS])).alias("c")).select("c.*")
    every = every.where(F.element_at("x", -1) == 0)
    for k in KINDS:
        every = every.unionByName(_loosened(placed, k))
    models = {}
    found = every.groupBy("kind", "held", "real", "x").agg(F.count("*").alias("n")).orderBy("kind", F.xxhash64("x"), "held", "real").collect()
    for k in KINDS:
        own = [r for r in found if r.kind == k]
        if not any(r.real for r in own):
            continue
        if all(r.real for r in own):
            models[k] = Boosted(0.0, [Split(len(FEATURES) - 1, 0.5, -1.0, 1.0)])
            continue
        repeat = np.array([min(r.n, 50) for r in own], int)
        x, y, held = (np.repeat(np.array(v, float), repeat, axis=0)[:SAMPLE_CANDIDATES] for v in ([r.x for r in own], [r.real for r in own], [r.held for r in own]))
        model = boost(x, y, held > 0)
        if model:
            models[k] = model
    return models


def find_private(docs: DataFrame, models: dict[str, Boosted] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text, base, spans): ``doc`` is a struct of the row's columns; spans hold (start, rank, end, kind).

    base are the strict patterns' spans, spans those and the selected
    candidates that lie over no base span of their kind, in order of start and
    kind.  A null text is empty; models are learned from ``docs`` by default.
    """
    models = learn(docs, id_col=id_col, text_col=text_col) if models is None else models
    placed = _placed(docs, text_col)
    span = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), s["end"].alias("end"), F.lit(k).alias("kind"))
    base = F.concat(*[F.transform(f"base_{k}", span(k)) for k in KINDS])
    apart = lambda k: lambda c: ~_overlaps(c, F.col(f"base_{k}"))
    selected = lambda m: lambda c: m.column(c["x"]) >= m.threshold
    more = []
    for k, model in models.items():
        free = F.filter(f"loose_{k}", apart(k))
        scored = F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), features(k, F.col("text"), c).alias("x")))
        more.append(F.transform(F.filter(scored, selected(model)), span(k)))
    out = placed.select("doc", "text", base.alias("base"), F.concat(*more).alias("more") if more else F.array().alias("more"))
    spans = F.array_distinct(F.concat("base", "more")) if more else F.col("base")
    return out.select("doc", "text", F.sort_array("base").alias("base"), F.sort_array(spans).alias("spans"))


def redacted(found: DataFrame, out_col: str = "redacted") -> DataFrame:
    """The result of :func:`find_private` with each stretch of spans replaced by its first one's kind in brackets."""
    text = F.col("text")
    walked = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(
                F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))
            ).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))),
    )
    return found.withColumn(out_col, walked)


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def private_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null text has no spans; rows that repeat a doc_id are searched each.
    """
    found = find_private(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc.doc_id", *[count(k) for k in KINDS], F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
