"""Personal data by weak supervision, with DataFrame functions only.

Candidates are found by Java regular expressions: the text is split by a pattern and the pieces between matches
give the places (code points). Base candidates are fixed kinds with fixed checks; they vote and always stay. Near
misses are matches of the base patterns that fail their checks; they vote, so that both classes are seen, and are never
reported. Loose candidates of the same kinds have other forms (written-out e-mail addresses, local telephone numbers,
IPv6, grouped card numbers) and must not overlap a base span. Three labelers vote on every candidate of any sort, each
for (+1), against (-1) or not at all (0): the form, gazetteers of fixed values (domain endings, card issuers, reserved
networks, service codes), and words in the CONTEXT characters before it. Spark counts the patterns of votes and
features, a few thousand at most. On the votes expectation-maximisation estimates each labeler's reliability by kind,
without labels. A logistic classifier of each kind, over the votes, the span's length, the variety of its digits and
the character before it, is fitted to the posteriors, starting from and drawn to PRIOR, which decides where a kind was
hardly seen. It accepts or rejects the loose candidates.

The patterns equal the plain ones (see the tests); possessive loops and a look-behind keep them linear on long
texts. Defined results: null texts are empty; no span gives empty strings; repeated rows are judged each; other
columns are ignored; an empty table gives no rows; null doc_ids stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 40
ROUNDS = 60
KEEP = 0.5
#: Matches that one step's array holds before it is put away, so long lists of matches are not copied at every step.
HELD = 256

# The base patterns, written without backtracking.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The looser forms.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9-])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# A loose pattern is only tried where these substrings are found.
_NEEDS = {"email": ("at]", "at)"), "ip": (":",), "card": (), "phone": ()}
# Gazetteers and context words.
ENDINGS = "com org net edu gov mil int info biz io ai app dev co me tv uk us de fr es it nl be ch at se no fi dk pl cz pt ie gr ru ua tr in cn jp kr au nz br mx ar cl ca za eu"
FOR = {"email": rf"(?i)(\.|dot[\])] ?)({ENDINGS.replace(' ', '|')})$", "ip": r"^(?!0\.|127\.|22[4-9]\.|2[3-5][0-9]\.)", "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)", "phone": r"^\+?[1-9]|^\([2-9]"}
AGAINST = {"email": r"(?i)\.(invalid|test|localhost|png|jpg|gif|js|css|py|txt)$", "ip": r"^(0\.|127\.|255\.)|^2001:0?db8:|\.[0-9]{4,}|^[0-9]{4,}", "card": r"^(0|1|9)", "phone": r"^0{3}|555 ?[ .-]?01[0-9]{2}$|^\(?[01]"}
WORDS = {"email": r"(?i)\b(e-?mail|contact|write|mailto|reach)\b", "ip": r"(?i)\b(ip|server|host|address|login|from)\b", "card": r"(?i)\b(card|visa|credit|debit|payment|paid)\b", "phone": r"(?i)\b(call|phone|tel|mobile|fax|text|dial)\b"}
UNLIKE = {"email": r"(?i)\b(example of|regex|pattern)\b", "ip": r"(?i)\b(version|release|section|chapter)\b", "card": r"(?i)\b(isbn|order|serial|tracking|id)\b", "phone": r"(?i)\b(isbn|order|serial|version)\b"}
# Forms of loose candidates that speak for and against them (a card's form is its check digit).
LOOSE_FOR = {"email": r"(?i)[\[(]at[\])].*[\[(]dot[\])]", "ip": r"(?i)[a-f].*:.*[0-9]", "card": "", "phone": r"^\([2-9][0-9]{2}\)"}
LOOSE_AGAINST = {"email": r"^[^A-Za-z]+[\[( ]", "ip": r"^[0-9:]+$", "card": "", "phone": r"([0-9])(?:[ ().-]*\1){6}"}
#: Weights that every classifier starts from: of each vote for or against (form, list, context); the rest are 0.
PRIOR = (1.0, 0.7, 1.2)
#: Candidates that weigh as much as PRIOR.
STRENGTH = 4.0

_SPAN = "struct<s:int,e:int,x:string,b:string>"


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (s, e, x: match, b: the characters before it)."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    none = F.array().cast(f"array<{_SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"), F.array().cast(f"array<array<{_SPAN}>>").alias("full"))

    def step(acc: Column, z: Column) -> Column:
        gap, match = z["g"], z["m"]
        s = acc["at"] + F.length(gap)
        e = s + F.coalesce(F.length(match), F.lit(0))
        span = F.array(F.struct(s.alias("s"), e.alias("e"), match.alias("x"), F.right(gap, F.lit(CONTEXT)).alias("b")).cast(_SPAN))
        many = F.size(acc["out"]) >= HELD
        out = F.when(match.isNull(), acc["out"]).when(many, span).otherwise(F.concat(acc["out"], span))
        full = F.when(many & match.isNotNull(), F.concat(acc["full"], F.array(acc["out"]))).otherwise(acc["full"])
        return F.struct(e.alias("at"), out.alias("out"), full.alias("full"))

    return F.aggregate(pieces, start, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["out"]))))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        return acc + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(x, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(F.substring(bare(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda p: _valid(kind, p["x"])


def _missed(kind: str):
    """Matches that fail their check; short runs of digits are no near misses of a card."""
    return lambda p: ~_valid(kind, p["x"]) & (F.length(p["x"]) >= (13 if kind == "card" else 0))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _judged(spans: Column, order: int, kind: str, sort: str) -> Column:
    """Spans with their kind, the three votes and the features; sort is base, loose or miss."""
    strict = {"email": r"^[A-Za-z0-9]", "ip": r"^[0-9.]{7,15}$", "card": r"^[0-9]{15,16}$|^([0-9]{4}[ -]){3}[0-9]{4}$", "phone": r"[ ().-]"}[kind]

    def one(p: Column) -> Column:
        x, before = p["x"], p["b"]
        digits = F.regexp_replace(x, "[^0-9]", "")
        if sort == "miss":
            form = F.lit(-1)
        elif sort == "base":
            form = F.when(x.rlike(strict), 1).otherwise(0)
        elif kind == "card":
            form = F.when(_luhn(digits), 1).otherwise(-1)
        else:
            form = _vote(x.rlike(LOOSE_FOR[kind]), x.rlike(LOOSE_AGAINST[kind]))
        listed = _vote(x.rlike(FOR[kind]), x.rlike(AGAINST[kind]))
        near = _vote(before.rlike(WORDS[kind]), before.rlike(UNLIKE[kind]))
        size = F.when(F.length(x) < 12, 0).when(F.length(x) < 20, 1).otherwise(2)
        varied = (F.size(F.array_distinct(F.split(digits, ""))) >= 4).cast("int")
        inside = before.rlike(r"[\p{L}\p{N}_.-]$").cast("int")
        return F.struct(F.lit(order).alias("k"), p["s"].alias("s"), p["e"].alias("e"), F.lit(kind).alias("kind"), form.alias("v1"), listed.alias("v2"), near.alias("v3"), size.alias("size"), varied.alias("varied"), inside.alias("inside"))

    return F.transform(spans, one)


def with_candidates(rows: DataFrame, text: Column) -> DataFrame:
    """rows with _base, _loose and _miss: arrays of (k, s, e, kind, v1, v2, v3, size, varied, inside)."""
    none = F.array().cast(f"array<{_SPAN}>")
    digit = text.rlike("[0-9]")
    gate = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    base, loose, miss = [], [], []
    for k, kind in enumerate(KINDS):
        rows = rows.withColumn(f"_found{k}", F.when(gate[kind], spans_of(text, BASE[kind])).otherwise(none))
        base.append(_judged(F.filter(f"_found{k}", _checked(kind)), k, kind, "base"))
        if kind != "email":  # every match of it passes
            miss.append(_judged(F.filter(f"_found{k}", _missed(kind)), k, kind, "miss"))
        need = F.lit(False)
        for part in _NEEDS[kind]:
            need = need | F.contains(text, F.lit(part))
        more = F.when(need if _NEEDS[kind] else digit, spans_of(text, LOOSE[kind])).otherwise(none)
        loose.append(_judged(more, k, kind, "loose"))
    rows = rows.withColumns({"_base": F.concat(*base), "_loose": F.concat(*loose), "_miss": F.concat(*miss)}).drop(*[f"_found{k}" for k in range(len(KINDS))])
    free = lambda c: ~F.exists("_base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    return rows.withColumn("_loose", F.filter("_loose", free))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base, loose and miss of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    return with_candidates(rows, F.col("t")).select("doc_id", F.col("_base").alias("base"), F.col("_loose").alias("loose"), F.col("_miss").alias("miss"))


def reliabilities(counts: list[tuple[str, tuple[int, int, int], int]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Posterior of each (kind, votes) pattern by expectation-maximisation over (kind, votes, number): a hidden truth for
    each candidate, and per kind, labeler and truth the probabilities of its three votes."""
    post: dict[tuple, float] = {}
    for kind in KINDS:
        seen: dict[tuple, int] = {}
        for k, votes, n in counts:
            if k == kind:
                seen[votes] = seen.get(votes, 0) + n
        belief = {v: 1 / (1 + math.exp(-(0.5 + 1.5 * sum(v)))) for v in seen}
        for _ in range(rounds if seen else 0):
            share = {t: 1.0 for t in (0, 1)}
            table = {(t, j, x): 1.0 + (x == 1 if t else x == -1) for t in (0, 1) for j in range(3) for x in (-1, 0, 1)}
            for v, n in seen.items():
                for t in (0, 1):
                    w = n * (belief[v] if t else 1 - belief[v])
                    share[t] += w
                    for j, x in enumerate(v):
                        table[t, j, x] += w
            like = {}
            for v in seen:
                log = [math.log(share[t]) + sum(math.log(table[t, j, x] / sum(table[t, j, y] for y in (-1, 0, 1))) for j, x in enumerate(v)) for t in (0, 1)]
                like[v] = 1 / (1 + math.exp(max(-50.0, min(50.0, log[0] - log[1]))))
            belief = like
        post |= {(kind, v): b for v, b in belief.items()}
    return post


def _places(votes: tuple[int, int, int], size: int, varied: int, inside: int) -> list[int]:
    """The weights, of WEIGHTS, that a candidate adds up."""
    return [0, 2 + votes[0], 5 + votes[1], 8 + votes[2], 10 + size, 13 + varied, 15 + inside]


WEIGHTS = 17


def classifier(counts: list[tuple], post: dict[tuple, float], steps: int = 600) -> dict[str, list[float]]:
    """Weights of a logistic model for each kind, over (kind, votes, size, varied, inside, number), fitted to the
    posteriors of all candidates by gradient descent and drawn to PRIOR."""
    out = {}
    for kind in KINDS:
        first = [0.0] * WEIGHTS
        for j, x in enumerate(PRIOR):
            first[1 + 3 * j], first[3 + 3 * j] = -x, x
        rows = [(_places(v, *rest), post[k, v], n) for k, v, *rest, n in counts if k == kind]
        total = sum(r[2] for r in rows) + STRENGTH
        w = first[:]
        for _ in range(steps):
            grad = [STRENGTH / total * (a - b) * 0.1 for a, b in zip(w, first, strict=True)]
            for places, y, n in rows:
                p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(w[x] for x in places)))))
                for x in places:
                    grad[x] += (p - y) * n / total
            w = [a - g for a, g in zip(w, grad, strict=True)]
        out[kind] = w
    return out


def fitted(rows: DataFrame) -> dict[str, list[float]]:
    """The classifiers' weights from all candidates of rows(base, loose, miss)."""
    each = rows.select(F.explode(F.concat("base", "loose", "miss")).alias("c"))
    names = ("kind", "v1", "v2", "v3", "size", "varied", "inside")
    seen = each.groupBy(*[f"c.{x}" for x in names]).count().collect()  # at most 4 x 27 x 12 rows
    counts = sorted((r["kind"], (r["v1"], r["v2"], r["v3"]), r["size"], r["varied"], r["inside"], r["count"]) for r in seen)
    return classifier(counts, reliabilities([(c[0], c[1], c[-1]) for c in counts]))


def _kept(loose: str, weights: dict[str, list[float]]) -> Column:
    """The candidates whose probability is KEEP or more."""
    table = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.array(*[F.lit(float(w)) for w in weights[k]]))])

    def good(c: Column) -> Column:
        w = table[c["kind"]]
        return w[0] + w[c["v1"] + 2] + w[c["v2"] + 5] + w[c["v3"] + 8] + w[c["size"] + 10] + w[c["varied"] + 13] + w[c["inside"] + 15] >= math.log(KEEP / (1 - KEEP))

    return F.filter(loose, good)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base (checked spans) and spans (with the accepted further ones): arrays of (k, s, e, kind, ...) in order."""
    rows = settle(candidates(docs), "pii-candidates")
    kept = _kept("loose", fitted(rows))
    return rows.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", kept)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced by its kind in brackets, such as [EMAIL]; other columns stay.
    Overlapping spans are replaced together, by the kind of the first. A null text stays null."""
    weights = fitted(settle(candidates(docs), "pii-candidates"))
    text = F.coalesce("_row.text", F.lit(""))
    rows = with_candidates(docs.select(F.struct("*").alias("_row")), text)
    place = F.transform(F.concat("_base", _kept("_loose", weights)), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        fresh = c["s"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, c["s"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.upper(c["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], c["e"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.aggregate(F.array_sort(place), start, step, rest)
    new = F.when(F.col("_row.text").isNull() | (F.size(place) == 0), F.col("_row.text")).otherwise(clean)
    return rows.select(*[new.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The counts and strings of find_pii's spans."""
    line = lambda a: F.array_join(F.transform(a, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")
    of = lambda k: lambda c: c["kind"] == k
    count = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
