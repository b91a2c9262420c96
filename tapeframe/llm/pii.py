"""Personal data by weak supervision, in DataFrame expressions alone.

Patterns give candidate spans: the *base* spans of e-mail addresses, IP addresses, card and phone
numbers, which are always kept, and looser ones (spelt-out addresses, phone numbers without a country
code). Labelers vote on every candidate (yes, no or nothing): strict form (pattern), known names and
prefixes (gazetteer), words before it (context), and what it touches (edges). Votes are counted per
candidate kind and pattern of votes, a table whose size is fixed. On it expectation-maximisation
estimates how reliable each labeler is and how likely each pattern of votes is personal data; a logistic
classifier over kind, votes and length is trained on those probabilities. Looser candidates that it
finds likely are added.

Base patterns are written so that no input makes them backtrack: a run is entered at its start or where
the last match ended, and never given back.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned alike and counted
in training; a null doc_id is kept; without any candidate nothing is trained; an empty table gives no
rows; extra columns are ignored, whatever their names. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.session import staged

KINDS = ("email", "ip", "card", "phone")

# The patterns of each candidate kind, what a text must hold for the kind to occur, and whether it is base.
PATTERNS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True),
    ("card", r"[0-9](?:[ -]?[0-9])++", "", True),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", True),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63}){1,8}", "at", False),
    ("phone", r"(?<![0-9A-Za-z.(+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])", "", False),
)

# Endings of addresses, country calling codes, leading digits of cards, words that announce each kind.
ENDINGS = "com org net edu gov int mil info biz io de fr es it nl uk us eu ch at be pl se no dk fi ru jp cn in br au ca"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92"
CARD_PREFIXES = "3 4 5 6"
CONTEXT = {
    "email": "mail|contact|write|address|schreib|courriel|correo",
    "ip": r"\bip\b|host|server|login|address",
    "card": "card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|ruf|appel|llam",
}
AGAINST = r"version|order|serial|invoice|isbn|\bv$|#$"

_BEFORE = 32
_LABELERS = ("strict", "gazetteer", "context", "edges")


def _candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, found): all pattern matches of a text, failing ones included, as an array of structs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digits", F.col("text").rlike("[0-9]"))
    cut = {}
    for number, (_, pattern, needs, _) in enumerate(PATTERNS):
        here = F.contains("text", F.lit(needs)) & (F.lit(True) if needs in ("@", "at") else F.col("digits"))
        cut[f"h{number}"] = F.when(here, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        cut[f"p{number}"] = F.when(here, F.split("text", pattern, -1))  # what lies between the matches
    rows = rows.select("row", "doc_id", *[v.alias(k) for k, v in cut.items()])
    found = []
    for number in range(len(PATTERNS)):
        hits, pieces = F.col(f"h{number}"), F.col(f"p{number}")
        each = F.arrays_zip(hits.alias("hit"), F.slice(pieces, F.lit(1), F.size(hits)).alias("left"), F.slice(pieces, F.lit(2), F.size(hits)).alias("right"))
        struct = F.transform(each, _match(number))
        found.append(F.when(F.size(hits) > 0, struct))
    return rows.select("row", "doc_id", F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("found"))


def _match(number: int):
    def one(x: Column, i: Column) -> Column:
        return F.struct(F.lit(number).alias("source"), i.alias("place"), x["hit"].alias("hit"), F.length(x["left"]).alias("gap"),
                        F.right(x["left"], F.lit(_BEFORE)).alias("before"), F.left(x["right"], F.lit(1)).alias("after"))

    return one


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the checksum."""
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = 2 * d
        return total + F.when((F.length(digits) - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    n = F.length(digits)
    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0).otherwise(False)


def _valid(c: dict[str, Column]) -> Column:
    """Whether a match is a span at all: the base rules of its kind."""
    digits = F.regexp_replace(c["hit"], "[^0-9]", "")
    part = lambda p: F.regexp_replace(p, "^0+", "")
    octets = F.forall(F.split(c["hit"], r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    return (F.when(c["source"] == 1, octets).when(c["source"] == 2, _luhn(digits))
            .when(c["source"] == 3, F.length(digits).between(9, 15)).otherwise(True))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(c: dict[str, Column]) -> dict[str, Column]:
    """1, -1 or 0 of each labeler."""
    kind, hit, before, after = c["kind"], c["hit"], F.lower(c["before"]), c["after"]
    digits = F.regexp_replace(hit, "[^0-9]", "")
    listed = lambda words: "|".join(words.split())
    pick = lambda by: F.coalesce(*[F.when(kind == k, v) for k, v in by.items()])
    strict = pick({
        "email": _vote(hit.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]* ?(@|\[at\]|\(at\)) ?[A-Za-z0-9].*[. \])][A-Za-z]{2,24}$"), ~hit.rlike(r"[. \])][A-Za-z]{2,24}$")),
        "ip": _vote(hit.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$"), F.lit(True)),
        "card": _vote(hit.rlike(r"^([0-9]{13,19}|([0-9]{4}[ -]){3}[0-9]{1,7})$"), F.length(digits) * 2 < F.length(hit) + 2),
        "phone": _vote(F.length(digits).between(10, 13), ~F.length(digits).between(8, 15)),
    })
    gazetteer = pick({
        "email": _vote(F.lower(hit).rlike(rf"[. \])]({listed(ENDINGS)})$"), F.lit(False)),
        "ip": _vote(hit.rlike(r"^(10|172|192|[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-2][0-9])\."), hit.rlike(r"^(0|127|22[4-9]|2[3-9][0-9])\.")),
        "card": _vote(digits.rlike(rf"^({listed(CARD_PREFIXES)})"), F.lit(True)),
        "phone": _vote(hit.rlike(rf"^\+({listed(CALLING_CODES)})"), hit.rlike(r"^\(?[01]")),
    })
    context = F.when(before.rlike(AGAINST), -1).otherwise(pick({k: _vote(before.rlike(words), F.lit(False)) for k, words in CONTEXT.items()}))
    glued = c["before"].rlike(r"[\p{L}\p{N}_@/]$") | after.rlike(r"^[\p{L}\p{N}_@/]")
    edges = _vote((F.length("before") == 0) | c["before"].rlike(r"[\s(\[<\"':,;]$") & ~glued, glued)
    return {"strict": strict, "gazetteer": gazetteer, "context": context, "edges": edges}


def candidate_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): ``rows`` numbers the rows of ``docs``; ``spans`` has every valid candidate with its votes."""
    rows = staged(_candidates(docs, doc_id, text), "pii")
    one = rows.where(F.size("found") > 0).select("row", F.inline("found"))
    order = Window.partitionBy("row", "source").orderBy("place")
    length = F.length("hit")
    placed = one.withColumn("start", F.sum(F.col("gap") + length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length)
    c = {n: F.col(n) for n in ("source", "hit", "before", "after")}
    kind = F.element_at(F.array(*[F.lit(k) for k, *_ in PATTERNS]), F.col("source") + 1)
    base = F.element_at(F.array(*[F.lit(b) for *_, b in PATTERNS]), F.col("source") + 1)
    spans = placed.where(_valid(c)).withColumns({"kind": kind, "base": base, "end": F.col("start") + length})
    spans = spans.withColumns(_votes(c | {"kind": F.col("kind")}))
    size = F.least(F.floor(length / 6), F.lit(4)).cast("int")
    return rows.select("row", "doc_id"), spans.select("row", "source", "kind", "base", "start", "end", size.alias("size"), *_LABELERS)


def estimate(patterns: list[dict], rounds: int = 50) -> list[float]:
    """Expectation-maximisation on (kind, votes, n): the probability of each pattern to be personal data.

    Labelers are taken as independent given the truth; the first guess is the share of yes among the
    votes that are cast. A tenth of the weight is the assumption that labelers are better than chance,
    without which the two classes could stand for anything that divides the candidates.
    """
    if not patterns:
        return []
    assumed = {1: {1: 0.7, 0: 0.25, -1: 0.05}, 0: {1: 0.1, 0: 0.4, -1: 0.5}}
    every = sum(p["n"] for p in patterns)
    likely = []
    for p in patterns:
        cast = [p[v] for v in _LABELERS if p[v]]
        likely.append((0.5 + sum(x > 0 for x in cast)) / (1 + len(cast)))
    kinds = sorted({p["kind"] for p in patterns})
    for _ in range(rounds):
        prior = {}
        for k in kinds:
            n = sum(p["n"] for p in patterns if p["kind"] == k)
            prior[k] = (0.05 * n + sum(q * p["n"] for p, q in zip(patterns, likely, strict=True) if p["kind"] == k)) / (1.1 * n)
        table = {}
        for v in _LABELERS:
            for truth in (0, 1):
                weight = {x: 0.1 * every * assumed[truth][x] for x in (-1, 0, 1)}
                for p, q in zip(patterns, likely, strict=True):
                    weight[p[v]] += p["n"] * (q if truth else 1 - q)
                total = sum(weight.values())
                table[v, truth] = {x: w / total for x, w in weight.items()}
        new = []
        for p in patterns:
            odds = math.log(prior[p["kind"]]) - math.log1p(-prior[p["kind"]])
            odds += sum(math.log(table[v, 1][p[v]]) - math.log(table[v, 0][p[v]]) for v in _LABELERS)
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        if max((abs(a - b) for a, b in zip(new, likely, strict=True)), default=0) < 1e-9:
            break
        likely = new
    return likely


def _features(p: dict) -> list[tuple]:
    return [("bias",), ("kind", p["kind"]), ("size", p["kind"], p["size"]), *[("vote", v, p[v]) for v in _LABELERS]]


def train_classifier(patterns: list[dict], likely: list[float], rounds: int = 400, rate: float = 1.0, decay: float = 1e-3) -> dict[tuple, float]:
    """Logistic weights of the features, by gradient descent on the counted patterns (``n`` rows each)."""
    weights = {f: 0.0 for p in patterns for f in _features(p)}
    total = sum(p["n"] for p in patterns) or 1
    for _ in range(rounds):
        slope = {f: decay * w for f, w in weights.items()}
        for p, y in zip(patterns, likely, strict=True):
            own = _features(p)
            z = sum(weights[f] for f in own)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * p["n"] / total
            for f in own:
                slope[f] += error
        for f, g in slope.items():
            weights[f] -= rate * g
    return weights


def _logit(weights: dict[tuple, float]) -> Column:
    total = F.lit(weights.get(("bias",), 0.0))
    for f, w in weights.items():
        if f[0] == "kind":
            total += F.when(F.col("kind") == f[1], w).otherwise(0.0)
        elif f[0] == "size":
            total += F.when((F.col("kind") == f[1]) & (F.col("size") == f[2]), w).otherwise(0.0)
        elif f[0] == "vote":
            total += F.when(F.col(f[1]) == f[2], w).otherwise(0.0)
    return total


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (row, doc_id), and every kept span (row, kind, start, end, base, score)."""
    rows, found = candidate_spans(docs, doc_id, text)
    found = staged(found, "pii-spans")
    patterns = [r.asDict() for r in found.groupBy("kind", "size", *_LABELERS).agg(F.count("*").alias("n")).collect()]
    patterns.sort(key=lambda p: tuple(str(p[k]) for k in ("kind", "size", *_LABELERS)))
    weights = train_classifier(patterns, estimate(patterns))
    scored = found.withColumn("score", 1 / (1 + F.exp(-_logit(weights))))
    # A looser span that meets a base span of its text is part of it.
    up = Window.partitionBy("row").orderBy("start", "end", "source").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("source")).rowsBetween(Window.unboundedPreceding, -1)
    near = scored.withColumns({"before_end": F.max(F.when(F.col("base"), F.col("end"))).over(up),
                               "after_start": F.min(F.when(F.col("base"), F.col("start"))).over(down)})
    free = F.coalesce(F.col("before_end") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after_start") >= F.col("end"), F.lit(True))
    kept = near.where(F.col("base") | (free & (F.col("score") >= threshold)))
    return rows, kept.select("row", "kind", "start", "end", "base", "score")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, their digest, and all spans as text."""
    rows, found = spans(docs, doc_id, text)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    one = F.struct(rank.alias("rank"), F.col("start"), F.col("end"), F.col("kind"), F.col("base"))
    grouped = found.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("all"))
    joined = rows.join(grouped, "row", "left")
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    every = F.coalesce(F.col("all"), F.array().cast(grouped.schema["all"].dataType))
    base = F.filter(every, lambda s: s["base"])
    of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return joined.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(every).alias("spans"))
