"""Personal data by weak supervision, with DataFrame functions alone.

Base spans come from four fixed patterns and checks and are always reported. Candidates come from wider patterns. Five
labelers vote -1, 0 or 1 on each: the strict pattern, a gazetteer, the words around it, its bounds, its shape. One
aggregation counts the vote patterns of the whole corpus, at most 5 * 3^5 rows, and expectation-maximisation estimates the
labelers' reliabilities from them on the driver. A second aggregation adds up the posteriors by span features (length, digits,
letter case, separators, neighbouring characters, check digits), at most 5 * 3456 rows, on which a logistic span classifier is trained
per kind. It never sees the votes. Candidates whose features it accepts and that touch no base span are added.

A match's place is found from the lengths of the pieces around all matches, in two levels of prefix sums, so no text is scanned by
position and the work for a text of n matches is close to n. Patterns are possessive and anchored to where a run begins, which changes no
match but keeps long runs of digits or letters linear.

Defined results: null and empty texts have no spans; texts of any length are searched whole; repeated rows each get their own; a corpus
without candidates adds nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import stage

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LABELERS = ("pattern", "gazetteer", "context", "bounds", "shape")

# Fixed values of the result contract, in possessive form.
_LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Wider patterns of candidates.
WIDE = {
    "email": r"(?<![^\s@<>\"'()])[^\s@<>\"'()]++@[^\s@<>\"'()]++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"[+(][0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key)[\x20]{0,2}[=:][\x20]{0,2}\"?[A-Za-z0-9+/_-]{16,}+\"?",
}


#: Words within 40 characters before a candidate that speak for its kind, and words that speak against any.
CUES = {
    "email": r"mail|contact|write|address|kontakt|courriel|correo",
    "ip": r"\bip\b|host|server|address|client|login",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|tel\b|tel\.|call|mobile|fax|telefon|téléphone|teléfono",
    "secret": r"token|secret|key|auth|bearer|credential",
}
AGAINST = r"version|\bv\.|isbn|issn|order|invoice|page|seite|doi|#\s*$"
_NOT_BYTE_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"

#: Gazetteers as patterns over a candidate.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|biz|io|de|fr|es|uk|us|eu|ch|at|it|nl|ca|au)$",
    "ip": r"^(?!0|127\.|255\.|22[4-9]\.|23[0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)",
    "phone": r"^\+\s?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"(?i)^(?:token|secret|passw(?:or)?d|api[_-]?key)",
}
SHAPE = {"email": r"^[^@]*[A-Za-z]", "ip": r"[1-9]", "card": r"^(?:[0-9]{4}[\x20-]?){3}", "phone": r"[0-9][\x20().-]+[0-9]", "secret": r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"}


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def base_valid(kind: str, m: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(_NOT_BYTE_PARTS)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


#: Matches whose places are found together; their totals are added up in a second level.
_CHUNK = 64


def _spans(text: Column, kind: str, pattern: str, keep, extra) -> Column:
    """Matches that keep(match) holds for, left to right: kind, start, end (code points) and extra(match, text before, text after)."""
    rows = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    width = lambda r: F.length(r["p"]) + F.length(r["m"])
    none = F.array().cast("array<int>")

    def over(x: Column) -> Column:
        n = F.size(x) - 1
        lists = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int")), lambda c: F.slice(x, c * _CHUNK + 1, F.least(F.lit(_CHUNK), n - c * _CHUNK)))
        ends = F.transform(lists, lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, r: F.struct((a["at"] + width(r)).alias("at"), F.concat(a["out"], F.array(a["at"] + width(r))).alias("out"))))

        def placed(e: Column) -> Column:
            bases = F.transform(e, lambda _, i: F.aggregate(F.slice(e, 1, i), F.lit(0), lambda a, y: a + y["at"]))
            return F.flatten(F.zip_with(e, bases, lambda y, base: F.transform(y["out"], lambda v: v + base)))

        def made(end: Column, i: Column) -> Column:
            r = x[i]
            fields = extra(r["m"], F.substring(r["p"], -40, 40), F.try_element_at(x, i + 2)["p"])
            return F.struct(F.lit(KINDS.index(kind)).alias("k"), (end - F.length(r["m"])).alias("s"), end.alias("e"), *fields, keep(r["m"]).alias("keep"))

        found = F.element_at(F.transform(F.array(ends), lambda e: F.transform(placed(e), made)), 1)
        return F.when(n > 0, F.filter(found, lambda c: c["keep"]))

    found = F.element_at(F.transform(F.array(rows), over), 1)
    return F.when(text.rlike(_HINTS[kind]), found)


#: A cheap test that a text can hold a match at all.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"[+(][0-9]", "secret": r"(?i)(?:token|secret|passw(?:or)?d|key)[\x20]{0,2}[=:]"}


def _votes(kind: str, m: Column, left: Column, right: Column) -> list[Column]:
    sign = lambda yes, no: F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0)).cast("int")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "secret":
        strict = m.rlike(r'(?i)"[0-9a-f]{32,}"$')
    elif kind == "email":
        strict = m.rlike(rf"^[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+[.,;:!?]*$")
    elif kind == "phone":
        strict = m.startswith("+") & F.length(digits).between(9, 15)
    else:
        strict = base_valid(kind, m)
    listed = m.rlike(GAZETTEER[kind])
    cue = F.lower(left).rlike(CUES[kind])
    against = F.lower(left).rlike(AGAINST)
    edge = ((left == "") | left.rlike(r"[\s\"'(\[<:;,=|]$")) & (F.coalesce(right, F.lit("")).rlike(r"^(?:$|[\s\"')\]>:;,.!?|&%*#$])"))
    shaped = m.rlike(SHAPE[kind])
    return [sign(strict, ~strict), sign(listed, ~listed), sign(cue & ~against, against), sign(edge, ~edge), sign(shaped, ~shaped)]


#: Span features and the number of values of each.
FEATURES = {"length": 4, "digits": 4, "case": 4, "separators": 3, "left": 3, "right": 3, "check": 2}


def _features(kind: str, m: Column, left: Column, right: Column) -> list[Column]:
    """The value of each of FEATURES, from 0."""
    n = F.length(m)
    share = F.length(F.regexp_replace(m, "[^0-9]", "")) / n
    apart = F.length(F.regexp_replace(m, r"[^\x20().@:=-]", ""))
    lower, upper = m.rlike("[a-z]").cast("int"), m.rlike("[A-Z]").cast("int")
    side = lambda x, end: F.when(x.rlike(r"\s$" if end else r"^\s") | (x == ""), 0).when(x.rlike(r"[\"'(\[<{:;,=|.!?]$" if end else r"^[\"')\]>}:;,.!?]"), 1).otherwise(2)
    if kind in ("ip", "card"):
        check = base_valid(kind, m)
    elif kind == "phone":
        check = F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    elif kind == "email":
        check = m.rlike(r"@[^@]+\.[A-Za-z]{2,}[.,;:!?]*$")
    else:
        check = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return [
        F.when(n < 8, 0).when(n < 16, 1).when(n < 32, 2).otherwise(3), F.when(share < 0.2, 0).when(share < 0.6, 1).when(share < 0.95, 2).otherwise(3), lower + 2 * upper,
        F.when(apart == 0, 0).when(apart <= 2, 1).otherwise(2), side(left, True), side(F.coalesce(right, F.lit("")), False), check.cast("int"),
    ]


def _code(values, sizes) -> Column:
    """One integer of several small ones, the first fastest."""
    code, unit = F.lit(0), 1
    for v, n in zip(values, sizes, strict=True):
        code, unit = code + v * unit, unit * n
    return code.cast("int")


def _values(code: int, sizes) -> list[int]:
    out = []
    for n in sizes:
        out.append(code % n)
        code //= n
    return out


_VOTES = (3,) * len(LABELERS)


def _found(text: Column) -> tuple[Column, Column]:
    """Base spans, and candidates with a code of their votes (v) and of their features (f), of a text, as arrays."""
    none = F.from_json(F.lit("[]"), "array<struct<k:int,s:int,e:int>>")
    base = [F.transform(_spans(text, k, BASE[k], lambda m, k=k: base_valid(k, m), lambda *_: []), lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"))) for k in BASE_KINDS]
    empty = F.from_json(F.lit("[]"), "array<struct<k:int,s:int,e:int,v:int,f:int,keep:boolean>>")
    least = {"card": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(12, 19)}

    def judged(kind: str):
        return lambda m, left, right: [_code([v + 1 for v in _votes(kind, m, left, right)], _VOTES).alias("v"), _code(_features(kind, m, left, right), FEATURES.values()).alias("f")]

    wide = F.concat(*(F.coalesce(_spans(text, k, WIDE[k], least.get(k, lambda m: F.length(m) >= 6), judged(k)), empty) for k in KINDS))
    return F.sort_array(F.concat(*(F.coalesce(x, none) for x in base))), wide


#: What is believed before the data speak, with the weight of BELIEF times the candidates: each labeler's votes 1, 0 and -1 on true and on
#: false spans. Two vote patterns that nearly always go together would leave the reliabilities open without it. The strict pattern counts most.
BELIEF = 2.0
VOTES_ON_TRUE = {"pattern": (0.9, 0.08, 0.02), "gazetteer": (0.7, 0.2, 0.1), "context": (0.4, 0.5, 0.1), "bounds": (0.9, 0.05, 0.05), "shape": (0.9, 0.05, 0.05)}
VOTES_ON_FALSE = {"pattern": (0.3, 0.1, 0.6), "gazetteer": (0.3, 0.3, 0.4), "context": (0.2, 0.5, 0.3), "bounds": (0.7, 0.1, 0.2), "shape": (0.7, 0.1, 0.2)}


def label_model(counts: dict[tuple[int, int], int], rounds: int = 60) -> dict[tuple[int, int], float]:
    """counts: (kind, code of votes) to number of candidates. The posterior of each, by two-class expectation-maximisation that starts from, and leans on, what is believed."""
    out = {}
    for kind in sorted({k for k, _ in counts}):
        codes = sorted(v for k, v in counts if k == kind)
        rows = [([x - 1 for x in _values(v, _VOTES)], counts[kind, v]) for v in codes]
        total = sum(n for _, n in rows)
        held = 1 + BELIEF * total
        post = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v, _ in rows]
        for _ in range(rounds):
            prior = (sum(p * n for p, (_, n) in zip(post, rows, strict=True)) + held / 2) / (total + held)
            table = []
            for j in range(len(LABELERS)):
                one, zero = ({v: held * share for v, share in zip((1, 0, -1), x[LABELERS[j]], strict=True)} for x in (VOTES_ON_TRUE, VOTES_ON_FALSE))
                for p, (v, n) in zip(post, rows, strict=True):
                    one[v[j]] += p * n
                    zero[v[j]] += (1 - p) * n
                a, b = sum(one.values()), sum(zero.values())
                table.append({v: math.log(one[v] / a) - math.log(zero[v] / b) for v in (-1, 0, 1)})
            score = [math.log(prior / (1 - prior)) + sum(t[x] for t, x in zip(table, v, strict=True)) for v, _ in rows]
            post = [1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in score]
        out.update({(kind, c): p for c, p in zip(codes, post, strict=True)})
    return out


def span_classifier(rows: dict[tuple[int, int], tuple[int, float]], steps: int = 30, ridge: float = 1.0) -> dict[tuple[int, int], float]:
    """rows: (kind, code of features) to (candidates, sum of their posteriors). The probability of each under a logistic regression per kind, by Newton steps."""
    import numpy as np

    out = {}
    for kind in sorted({k for k, _ in rows}):
        codes = sorted(f for k, f in rows if k == kind)
        n, p = (np.array([rows[kind, f][i] for f in codes], float) for i in (0, 1))
        x = np.ones((len(codes), 1 + sum(FEATURES.values())))
        for i, f in enumerate(codes):
            x[i, 1:] = np.concatenate([np.eye(size)[v] for v, size in zip(_values(f, FEATURES.values()), FEATURES.values(), strict=True)])
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * q - p) + ridge * w
            curve = (x * (n * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
            w = w - np.clip(np.linalg.solve(curve, slope), -2, 2)
        out.update({(kind, f): float(q) for f, q in zip(codes, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), strict=True)})
    return out


#: Parts of 1 in which posteriors are added up, so that sums are exact whatever the order.
_UNIT = 1_000_000


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """One row per row of df: the id, base and spans as arrays of struct<k,s,e> (index in KINDS, start, exclusive end), by start, then kind."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base, wide = _found(text)
    found = stage(df.select(F.col(f"`{id_col}`").alias("id"), base.alias("base"), F.transform(wide, lambda c: c.dropFields("keep")).alias("wide")), "spans")
    each = found.select(F.explode("wide").alias("c")).select("c.*")
    posterior = label_model({(r.k, r.v): r.n for r in each.groupBy("k", "v").agg(F.count("*").alias("n")).collect()})  # at most 5 * 3^5 rows
    listed_ = ", ".join(f"({k}, {v}, {round(p * _UNIT)}L)" for (k, v), p in posterior.items()) or "(-1, -1, 0L)"
    known = df.sparkSession.sql(f"SELECT * FROM VALUES {listed_} AS t(k, v, p)")
    sums = each.join(F.broadcast(known), ["k", "v"]).groupBy("k", "f").agg(F.count("*").alias("n"), F.sum("p").alias("p")).collect()  # at most 5 * 3456 rows
    yes = sorted(10_000 * k + f for (k, f), p in span_classifier({(r.k, r.f): (r.n, r.p / _UNIT) for r in sums}).items() if p >= least)

    def taken(c: Column) -> Column:
        free = ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
        return (10_000 * c["k"] + c["f"]).isin(yes or [-1]) & free

    added = F.transform(F.filter("wide", taken), lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))
    by_start = lambda a: F.transform(F.sort_array(F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return found.select("id", by_start(F.col("base")).alias("base"), by_start(F.concat("base", added)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == KINDS.index(kind))).cast("long")
