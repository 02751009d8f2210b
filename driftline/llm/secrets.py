"""Secret scans: three key patterns and a randomness test battery, in SQL functions only.

Patterns give the base spans. Besides, every run of 20 or more characters of
the base64 alphabets is a candidate: its encoding is inferred (hexadecimal,
base32 or base64), and three tests ask how far its symbols are from uniform
and independent: chi-squared uniformity over the alphabet, Wald-Wolfowitz runs
about the middle of the alphabet, and lag-one serial correlation. The three
p-values are combined by Fisher's method. Candidates are then judged by length
class and encoding over the whole corpus: the share of truly random strings in
a class follows from its upper half of p-values, where text hardly ever falls,
and the least threshold is taken at which the expected share of text among the
accepted stays below ``fdr``. Short classes, where text passes the tests more
often, so get a higher threshold than long ones. A threshold is never above one
half: where even there the upper half's own share can't be told from text, what
lies above one half is accepted, and the rate isn't controlled in that class.

Defined cases: a null text counts as empty; spans are code points, end
exclusive; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import materialize

#: The base patterns, group 1 being all that stands before the
#: characters whose number is tested, and the least number of those. A run of
#: the last two kinds is matched whole or not at all, so the least number can
#: stand in the pattern; a short assignment takes up its characters all the same.
KINDS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 12),
    ("access", r"()(AKIA[A-Z0-9]{14,})", 18),
    ("hex", r"()([0-9a-f]{16,})", 16),
)
#: Runs that the battery tests, of RANDOM_MIN characters or more.
RANDOM = r"()([A-Za-z0-9+/_-]{20,}={0,2})"
RANDOM_MIN = 20
#: Symbols of each encoding, in the order of their values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Classes of p-values of a length class and encoding.
P_CLASSES = 40
#: Items that one step of an array function takes together.
CHUNK = 64
#: Tokens from which a length class has a threshold of its own.
POOL = 1000

_MARK, _SPLIT = "\x01", "\x03"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def in_chunks(items: Column, start: Column, advance: Callable[[Column, Column], Column], one: Callable[[Column, Column], Column]) -> Column:
    """Array of ``one(at, x)`` for each x, ``at`` being what ``advance`` makes of the items before it.

    An aggregate copies its state at each step, so a state that grows with the
    items would take quadratic time; chunks of CHUNK items keep it small.
    """
    n = F.ceil(F.size(items) / F.lit(float(CHUNK))).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), n), lambda k: F.slice(items, (k - 1) * CHUNK + 1, CHUNK))

    def run(held: Column) -> Column:
        starts = F.aggregate(held, F.array(start), lambda acc, c: F.concat(acc, F.array(F.aggregate(c, F.element_at(acc, -1), advance))))

        def inside(c: Column, at: Column) -> Column:
            places = F.aggregate(c, F.array(at), lambda acc, x: F.concat(acc, F.array(advance(F.element_at(acc, -1), x))))
            return bound(places, lambda p: F.zip_with(F.slice(p, 1, F.size(c)), c, one))

        return bound(starts, lambda s: F.flatten(F.zip_with(held, F.slice(s, 1, F.size(held)), inside)))

    return bound(chunks, run)


def _spans(text: Column, pattern: str, least: int) -> Column:
    """Matches in ``text`` (free of the two marks) as structs of start, end, body."""
    marked = F.split(F.regexp_replace(text, pattern, f"{_MARK}$1{_SPLIT}$2{_MARK}"), _MARK)
    none = F.expr("cast(array() as array<struct<start:int,end:int,body:string>>)")

    def found(pieces: Column) -> Column:
        # pieces at odd places are matches; a match is one character longer in here, by its _SPLIT
        places = in_chunks(pieces, F.lit(0), lambda at, x: at + F.length(F.replace(x, F.lit(_SPLIT))), lambda at, x: F.struct(at.alias("at"), x.alias("x")))
        matches = F.filter(places, lambda x, i: i % 2 == 1)
        spans = F.transform(matches, lambda m: F.struct(m["at"].alias("start"), (m["at"] + F.length(m["x"]) - 1).alias("end"), F.substring_index(m["x"], _SPLIT, -1).alias("body")))
        return F.filter(spans, lambda x: F.length(x["body"]) >= least)

    return bound(marked, lambda pieces: F.when(F.size(pieces) > 1, found(pieces)).otherwise(none))


def _tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2.0) / math.sqrt(2 * math.pi) * poly
    return F.greatest(F.when(z >= 0, upper).otherwise(1.0 - upper), F.lit(1e-300))


def battery(token: Column) -> Column:
    """struct(encoding, n, p_chi, p_runs, p_serial, p) of a token; p is Fisher's combination.

    An upper-case hexadecimal string counts as hexadecimal; ``-`` and ``_``
    count as ``+`` and ``/``. A constant string has p 0.
    """
    alphabets = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])

    def encoded(body: Column) -> Column:
        encoding = (
            F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
            .when(body.rlike("^[A-Z2-7]+$"), F.lit("base32"))
            .otherwise(F.lit("base64"))
        )
        return F.struct(body.alias("body"), encoding.alias("e"))

    def valued(s: Column) -> Column:
        folded = F.when(s["e"] == "hex", F.lower(s["body"])).otherwise(F.translate(s["body"], "-_", "+/"))
        alphabet = F.element_at(alphabets, s["e"])
        both = F.struct(folded.alias("body"), alphabet.alias("a"), s["e"].alias("e"))
        return bound(both, lambda t: F.struct(F.transform(F.split(t["body"], ""), lambda c: F.position(c, t["a"]) - 1).alias("v"), F.length(t["a"]).alias("k"), t["body"].alias("body"), t["a"].alias("a"), t["e"].alias("e")))

    def tests(s: Column) -> Column:
        n = F.size(s["v"]).cast("double")
        k = s["k"].cast("double")
        # chi-squared over the alphabet, brought to a normal by its exact first two moments
        squares = F.aggregate(F.split(s["a"], ""), F.lit(0.0), lambda a, c: a + F.pow((F.size(s["v"]) - F.length(F.replace(s["body"], c))).cast("double"), 2.0))
        z_chi = (squares * k / n - n - (k - 1.0)) / F.sqrt(2.0 * (k - 1.0) * (1.0 - 1.0 / n))
        # runs about the middle of the alphabet
        high = F.aggregate(s["v"], F.lit(0.0), lambda a, v: a + (v * 2 >= s["k"]).cast("double"))
        pairs = F.arrays_zip(F.slice(s["v"], 1, F.size(s["v"]) - 1).alias("a"), F.slice(s["v"], 2, F.size(s["v"]) - 1).alias("b"))
        runs = F.aggregate(pairs, F.lit(1.0), lambda a, x: a + ((x["a"] * 2 >= s["k"]) != (x["b"] * 2 >= s["k"])).cast("double"))
        low = n - high
        mean_runs = 2.0 * high * low / n + 1.0
        var_runs = (mean_runs - 1.0) * (mean_runs - 2.0) / (n - 1.0)
        z_runs = F.when(var_runs > 0, F.abs(runs - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(30.0))
        # serial correlation of neighbours
        # by sums, as a mean inside a lambda would be taken anew for every symbol
        total = F.aggregate(s["v"], F.lit(0.0), lambda a, v: a + v)
        var = F.aggregate(s["v"], F.lit(0.0), lambda a, v: a + v * v) - total * total / n
        products = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["a"] * x["b"])
        mean = total / n
        cov = products - mean * (2.0 * total - F.element_at(s["v"], 1) - F.element_at(s["v"], -1)) + (n - 1.0) * mean * mean
        z_serial = F.when(var > 0, F.abs(cov / var + 1.0 / n) * F.sqrt(n)).otherwise(F.lit(30.0))
        return F.struct(_tail(z_chi).alias("chi"), F.least(2.0 * _tail(z_runs), F.lit(1.0)).alias("runs"), F.least(2.0 * _tail(z_serial), F.lit(1.0)).alias("serial"))

    def combined(s: Column) -> Column:
        def fisher(t: Column) -> Column:
            h = -(F.log(t["chi"]) + F.log(t["runs"]) + F.log(t["serial"]))
            p = F.exp(-h) * (1.0 + h + h * h / 2.0)  # upper tail of chi-squared with 6 degrees at 2h
            return F.struct(s["e"].alias("encoding"), F.size(s["v"]).alias("n"), t["chi"].alias("p_chi"), t["runs"].alias("p_runs"), t["serial"].alias("p_serial"), p.alias("p"))

        return bound(tests(s), fisher)

    # what a lambda over the symbols uses must be bound outside: it would be taken anew for each
    return bound(F.regexp_replace(token, "=+$", ""), lambda body: bound(encoded(body), lambda s: bound(valued(s), combined)))


def _length_class(n: Column) -> Column:
    """Half octaves of length from 20 characters on, at most 20 classes."""
    return F.least(F.floor(2.0 * F.log2(n / F.lit(float(RANDOM_MIN)))), F.lit(19)).cast("int")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end), sorted, base spans first kept.

    ``keep_text`` brings the row's columns along, as a struct named ``row``.
    """
    clean = F.translate(F.coalesce(F.col(text_col), F.lit("")), _MARK + _SPLIT, "\x02\x02")
    found = docs.select(F.col(id_col).alias("doc_id"), *([F.struct(*docs.columns).alias("row")] if keep_text else []), clean.alias("clean"))
    found = found.select(*[c for c in found.columns if c != "clean"], *[_spans(F.col("clean"), p, least).alias(kind) for kind, p, least in KINDS], _spans(F.col("clean"), RANDOM, RANDOM_MIN).alias("random"))
    tested = F.transform("random", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["body"]).alias("test")))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    found = found.select(*[c for c in found.columns if c not in ("assign", "access", "hex", "random")], *[bare(k).alias(k) for k, _, _ in KINDS], F.when(F.size("random") > 0, tested).alias("tested"))
    found = materialize(found, "secrets")
    limits = thresholds(found, fdr)
    of = lambda t: F.coalesce(F.element_at(limits, F.concat_ws(":", t["encoding"], _length_class(t["n"]))), F.lit(2.0))
    rank = {k: i for i, k in enumerate([k for k, _, _ in KINDS] + ["random"])}
    span = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(rank[kind]).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    base = F.array_sort(F.concat(*[F.transform(k, span(k)) for k, _, _ in KINDS]))
    random = F.transform(F.filter("tested", lambda x: x["test"]["p"] > of(x["test"])), span("random"))
    random = F.coalesce(random, F.slice(F.transform("hex", span("random")), 1, 0))
    return found.withColumns({"base": base, "all": F.array_sort(F.concat(base, random))})


def thresholds(found: DataFrame, fdr: float) -> Column:
    """Map of "encoding:length class" to the p-value that a random string must exceed.

    The counts that reach the driver are at most 3 encodings x 20 length
    classes x P_CLASSES numbers, whatever the size of the corpus.
    """
    counts = (
        found.where("tested is not null")
        .select(F.explode("tested.test").alias("t"))
        .groupBy(F.concat_ws(":", "t.encoding", _length_class(F.col("t.n"))).alias("class"), F.least(F.floor(F.col("t.p") * P_CLASSES), F.lit(P_CLASSES - 1)).cast("int").alias("p"))
        .count()
        .collect()
    )
    classes: dict[str, list[int]] = {}
    for r in counts:
        classes.setdefault(r["class"], [0] * P_CLASSES)[r["p"]] += r["count"]
    limits = {name: limit(held, fdr) for name, held in pooled(classes).items()}
    if not limits:
        return F.create_map(F.lit("none"), F.lit(2.0))
    return F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])


def limit(held: list[int], fdr: float) -> float:
    """The least p-value from which the expected share of text among the accepted stays below ``fdr``, one half at most.

    ``held`` counts p-values by P_CLASSES classes of equal width; twice the
    upper half is the number of random strings, spread evenly.
    """
    upper = sum(held[P_CLASSES // 2 :])
    for i in range(P_CLASSES // 2):
        accepted, expected = sum(held[i:]), 2.0 * upper * (1.0 - i / P_CLASSES)
        if accepted and (accepted - expected) / accepted <= fdr:
            return i / P_CLASSES if i else 1.0 / (4 * P_CLASSES)
    return 0.5


def pooled(classes: dict[str, list[int]]) -> dict[str, list[int]]:
    """Classes of fewer than POOL tokens together with the nearest lengths of their encoding."""
    out = {}
    for name, held in classes.items():
        encoding, length = name.split(":")
        others = sorted((abs(int(x.split(":")[1]) - int(length)), x) for x in classes if x.split(":")[0] == encoding and x != name)
        out[name], at = list(held), None
        for distance, other in others:
            if sum(out[name]) >= POOL and distance != at:
                break
            out[name], at = [a + b for a, b in zip(out[name], classes[other], strict=True)], distance
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span, or union of overlapping spans, replaced by ``mask``."""

    def mended(apart: Column) -> Column:
        # a chunk's part of the text is cut out once, so that each cut in it is short
        n = F.ceil(F.size(apart) / F.lit(float(CHUNK))).cast("int")

        def chunk(k: Column) -> Column:
            first = F.element_at(apart, (k - 1) * CHUNK + 1)["at"]
            last = F.element_at(apart, F.least(k * CHUNK, F.size(apart)))["end"]
            local = lambda t: F.transform(F.slice(apart, (k - 1) * CHUNK + 1, CHUNK), lambda x: F.concat(t.substr(x["at"] - first + 1, x["start"] - x["at"]), F.lit(mask)))
            return F.array_join(bound(text.substr(first + 1, last - first), local), "")

        rest = text.substr(F.element_at(apart, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), n), chunk), ""), rest)

    ended = in_chunks(spans, F.lit(0), lambda at, x: F.greatest(at, x["end"]), lambda at, x: F.struct(at.alias("at"), x["start"].alias("start"), F.greatest(at, x["end"]).alias("end")))
    # spans that begin inside an earlier one only lengthen it
    done = bound(ended, lambda every: bound(F.filter(every, lambda x: x["start"] >= x["at"]), mended))
    return F.when(F.size(spans) > 0, done).otherwise(text)
