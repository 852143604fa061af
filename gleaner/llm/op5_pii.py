"""Personal data by weak supervision, in DataFrame functions alone.

A regular expression per kind finds candidates with their places: the matches and what stands between them have lengths
whose running sums are the places. Four labelers vote on each candidate (1 for, -1 against, 0 abstains): the kind's check
(Luhn, number ranges, digit counts), its shape, a gazetteer of beginnings or ends, and cue words before it. Votes and the
signs on both sides make a pattern, of which there are at most KINDS * 3**4 * 9; pattern counts over all documents are
collected, expectation-maximisation estimates each labeler's reliability per kind from them, and a logistic span
classifier is fitted to the posteriors on votes and neighbours. Its decisions per pattern go back as a literal. Base
matches that pass their check stay whatever it says; it adds others of the same kinds, of `secret` (keys, tokens,
passwords) and of `local` (telephone numbers without a country).

Regular expressions here match what the contract's do, but can't run away on long texts: a repeated group is possessive,
and a run of signs is entered at its start or where the last match ended.

Defined results: a null text is an empty one and has no spans; places count code points; a row per document, repeated
ones too; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, spread, table, written

#: Kinds in their order, the first four as the contract lists them.
KINDS = ("email", "ip", "card", "phone", "secret", "local")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+(?!@|\.[A-Za-z0-9])",
    "local": r"(?<![0-9+])(?<!\+[0-9]{1,3}[\x20(.-]{1,2})\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
SHAPES = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "ip": r"^[1-9][0-9]{0,2}(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]{16,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4,7})$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}$",
    "secret": r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Z0-9]{20}|[A-Za-z0-9_-]{32,})$",
    "local": r"^(?:\([0-9]{3}\)\x20|[0-9]{3}([.-]))[0-9]{3}[.-][0-9]{4}$",
}
GAZETTEERS = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|eu|us)$",
    "ip": r"^(?:10|127|172|192|[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|sk[-_]|pk[-_]|xox|eyJ|AIza)",
    "local": r"^\(?[2-9]",
}
CUES = {
    "email": r"(?i)(?:mail|contact|write|courriel|correo|@)",
    "ip": r"(?i)(?:\bip\b|host|server|address|addr|adresse)",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta|iban|account)",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|anruf)",
    "secret": r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|key)[\"']?\s*[:=]?\s*[\"']?$",
    "local": r"(?i)(?:phone|tel|call|fax|mobile|anruf)",
}
BEFORE = 24
LABELERS = 4
ROUNDS = 50


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often use reads it: what stands in lambdas is computed at every step."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(lengths: Column) -> Column:
    """Running sums of an array of numbers, by chunks so that long arrays aren't copied again at every step."""
    step = 256
    chunks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int"))
    whole = lambda c: F.aggregate(F.slice(lengths, c * step + 1, step), F.lit(0), lambda a, x: a + x)
    grow = lambda part, start: F.aggregate(part, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    inside = lambda starts: F.flatten(F.transform(chunks, lambda c: F.slice(grow(F.slice(lengths, c * step + 1, step), F.element_at(starts, c + 1)), 2, step)))
    return F.when(F.size(lengths) > 0, once(grow(F.transform(chunks, whole), F.lit(0)), inside)).otherwise(F.array().cast("array<int>"))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    def total(d: Column) -> Column:
        at = lambda i: F.substr(d, i, F.lit(1)).cast("int")
        # every second digit from the right counts double, less 9 where that has two digits
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, at(i)).when(at(i) < 5, at(i) * 2).otherwise(at(i) * 2 - 9))

    return once(F.reverse(digits(x)), total) % 10 == 0


def check(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(x)
    if kind == "phone":
        return F.length(digits(x)).between(8, 15)
    if kind == "secret":
        return F.size(F.array_distinct(F.split(x, ""))) >= 8
    return F.lit(True)


def side(char: Column) -> Column:
    """Class of a neighbouring character: none or white space, a letter or digit, or another sign."""
    return F.when((char == "") | char.rlike(r"^\s"), "s").when(char.rlike(r"^[A-Za-z0-9]"), "w").otherwise("p")


def votes(kind: str, x: Column, before: Column, after: Column) -> Column:
    vote = lambda ok: F.when(ok, "+").otherwise("-")
    some = lambda ok: F.when(ok, "+").otherwise("0")
    return F.concat(F.lit(f"{KINDS.index(kind)}"), vote(check(kind, x)), vote(x.rlike(SHAPES[kind])), some(x.rlike(GAZETTEERS[kind])), some(before.rlike(CUES[kind])), side(F.substring(before, -1, 1)), side(F.substring(after, 1, 1)))


def candidates(kind: str, text: Column) -> Column:
    """array<struct<kind,start,stop,pattern>> of a kind's matches in their order."""

    def placed(pieces: Column, found: Column, lengths: Column) -> Column:
        # each candidate: text before it, itself, text after it, and where it ends
        zipped = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m"), F.slice(pieces, 2, F.size(found)).alias("q"), running(lengths).alias("e"))
        return F.transform(zipped, lambda z: F.struct(F.lit(KINDS.index(kind)).alias("kind"), (z["e"] - F.length(z["m"])).alias("start"), z["e"].alias("stop"), votes(kind, z["m"], F.substring(z["p"], -BEFORE, BEFORE), F.substring(z["q"], 1, 1)).alias("pattern")))

    def made(found: Column) -> Column:
        pieces = F.split(text, PATTERNS[kind], -1)
        both = lambda pieces: F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
        some = once(pieces, lambda pieces: once(both(pieces), lambda lengths: placed(pieces, found, lengths)))
        return F.when(F.size(found) > 0, some).otherwise(F.array().cast("array<struct<kind:int,start:int,stop:int,pattern:string>>"))

    return once(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), made)


def reliabilities(counts: dict[str, int], rounds: int = ROUNDS) -> dict[str, tuple[float, list[dict[str, float]], list[dict[str, float]]]]:
    """Per kind: share of true candidates, and each labeler's chance of each vote if true and if not, by EM over pattern counts."""
    by_kind: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for p, n in counts.items():
        by_kind[p[0]][p[1 : 1 + LABELERS]] += n
    out = {}
    for kind, rows in by_kind.items():
        prior = 0.5
        yes = [{"+": 0.7, "0": 0.2, "-": 0.1} for _ in range(LABELERS)]
        no = [{"+": 0.1, "0": 0.4, "-": 0.5} for _ in range(LABELERS)]
        for _ in range(rounds):
            weight = {v: posterior(v, prior, yes, no) for v in rows}
            total = sum(rows.values())
            true = sum(n * weight[v] for v, n in rows.items())
            prior = (true + 1) / (total + 2)
            for k in range(LABELERS):
                for s in "+0-":
                    yes[k][s] = (sum(n * weight[v] for v, n in rows.items() if v[k] == s) + 1) / (true + 3)
                    no[k][s] = (sum(n * (1 - weight[v]) for v, n in rows.items() if v[k] == s) + 1) / (total - true + 3)
        out[kind] = (prior, yes, no)
    return out


def posterior(v: str, prior: float, yes: list[dict[str, float]], no: list[dict[str, float]]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(yes[k][s] / no[k][s]) for k, s in enumerate(v))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def accepted(counts: dict[str, int], steps: int = 200) -> list[str]:
    """Patterns that the span classifier takes: logistic regression per kind on votes and neighbours, fitted to the posteriors."""
    known = reliabilities(counts)
    kept = []
    for kind in sorted(known):
        rows = sorted((p, n) for p, n in counts.items() if p[0] == kind)
        total = sum(n for _, n in rows)
        target = {p: posterior(p[1 : 1 + LABELERS], *known[kind]) for p, _ in rows}
        weight: dict[tuple[int, str], float] = defaultdict(float)
        features = {p: [(0, "bias"), *enumerate(p[1:], 1)] for p, _ in rows}
        score = lambda p: sum(weight[f] for f in features[p])
        for _ in range(steps):
            slope: dict[tuple[int, str], float] = defaultdict(float)
            for p, n in rows:
                gap = n / total * (target[p] - 1 / (1 + math.exp(-max(-500.0, min(500.0, score(p))))))
                for f in features[p]:
                    slope[f] += gap
            for f, g in slope.items():
                weight[f] += 2.0 * g - 1e-4 * weight[f]
        kept += [p for p, _ in rows if score(p) > 0]
    return kept


def marked(docs: DataFrame) -> DataFrame:
    """doc_id and all candidates, written once to the shared folder: they carry no text."""
    text = F.coalesce("text", F.lit(""))
    given = spread(only(docs, "doc_id", "text")).select("doc_id", text.alias("text"))
    return written(given.select("doc_id", F.concat(*[candidates(k, F.col("text")) for k in KINDS]).alias("found")), "spans")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and all spans, each array<struct<kind,start,stop,pattern>> by kind and start."""
    found = marked(docs)
    rows = found.select(F.explode("found.pattern").alias("p")).groupBy("p").count().collect()  # a row for each pattern
    kept = accepted({r["p"]: r["count"] for r in rows})
    is_base = lambda s: (s["kind"] < 4) & (F.substring(s["pattern"], 2, 1) == "+")
    taken = F.from_json(F.lit("[" + ",".join(f'"{p}"' for p in kept) + "]"), "array<string>")
    return found.select("doc_id", F.filter("found", is_base).alias("base"), F.filter("found", lambda s: is_base(s) | F.array_contains(taken, s["pattern"])).alias("spans"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # filter gives a function of two arguments the element's place as the second, so that k must not be one
    of_kind = lambda k: lambda s: s["kind"] == k
    counted = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return detect(table(spark, sf_dir, "documents")).select("doc_id", *counted, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
