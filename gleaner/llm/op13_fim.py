"""Fill-in-middle transformation by an Aho-Corasick event scan.

A unit is a run of ASCII letters or any other single code point. One automaton runs over a text's classes, one character
for each code point: the letters and signs of the sentinels stand for themselves, and all other letters, and all other
code points, for one each. Its patterns are the pairs in which a letter meets something else, so that events mark where
runs of letters begin and end, and the sentinels. Between two events lies one unit (letters) or as many as there are code
points, so units are counted, and a unit's place is found, by arithmetic on the events alone: a unit's place is its number
plus what the runs before it have beyond a letter each. Python returns three numbers a document; texts are cut and joined
by Spark's own functions.

Defined results: a null text is an empty one, and plain; a null doc_id has no digits in what is hashed; repeated rows are
alike; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table

#: Prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
BEGINS, ENDS, MARK = 0, 1, 2
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
         CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


class Scanner:
    """Events of a text: where runs of letters begin and end, and whether a sentinel is there."""

    def __init__(self, sentinels: Sequence[str] = SENTINELS):
        if not all(x and x.isascii() for x in sentinels):
            raise ValueError("sentinels are ASCII and not empty")
        own = sorted(set("".join(sentinels)))
        letters = [c for c in own if c in LETTERS] + [next(c for c in LETTERS if c not in own)]
        other = next(c for c in map(chr, range(32, 127)) if c not in own and c not in LETTERS)
        others = [c for c in own if c not in LETTERS] + [other]
        self.other = other
        self.classes = bytes(ord(c if c in own else letters[-1] if c in LETTERS else other) for c in map(chr, range(256)))
        self.automaton = ahocorasick.Automaton()
        for a, b in itertools.product(letters, others):
            self.automaton.add_word(b + a, BEGINS)
            self.automaton.add_word(a + b, ENDS)
        for x in sentinels:
            self.automaton.add_word(x, MARK)
        self.automaton.make_automaton()

    def events(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Begins and ends of the runs of letters, as code points, and whether the text holds a sentinel."""
        # a code point beyond ASCII is one `?`, which is no letter; one such sign stands before the text and one after it
        view = (self.other.encode() + text.encode("ascii", "replace") + self.other.encode()).translate(self.classes).decode("ascii")
        flat = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(view)), np.int64)
        place, kind = flat[0::2] - 1, flat[1::2]
        return place[kind == BEGINS], place[kind == ENDS], bool((kind == MARK).any())


class Units:
    """Counts and places of units from a text's events."""

    def __init__(self, chars: int, begins: np.ndarray, ends: np.ndarray):
        self.beyond = np.concatenate([[0], np.cumsum(ends - begins - 1)])  # letters beyond the first of each run so far
        self.first = begins - self.beyond[:-1]  # each run's number as a unit
        self.count = chars - int(self.beyond[-1])

    def place(self, unit: int) -> int:
        """Code points before the unit of this number; for the count of units, all."""
        return unit + int(self.beyond[np.searchsorted(self.first, unit, "left")])


CUT = "n long, first long, second long, marked boolean"


def cuts(sentinels: Sequence[str]):
    """An Arrow function of a text and two numbers: units, code points before the lesser and the greater cut, whether a
    sentinel is in the text."""
    made: list[Scanner] = []

    @F.pandas_udf(CUT)
    def run(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Scanner(sentinels))
        out = []
        for t, x, y in zip(text.tolist(), h1.tolist(), h2.tolist(), strict=True):
            begins, ends, marked = made[0].events(t)
            units = Units(len(t), begins, ends)
            a, b = sorted((x % (units.count + 1), y % (units.count + 1)))
            out.append((units.count, units.place(a), units.place(b), marked))
        return pd.DataFrame(out, columns=["n", "first", "second", "marked"])

    return run


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars and output of every document."""
    p, s, m = (F.lit(x) for x in sentinels)
    given = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h1, h2, h3, h4 = drawn(F.col("doc_id"), seed)
    cut = given.select("doc_id", "text", (h3 % 100).alias("r3"), (h4 % 100).alias("r4"), cuts(sentinels)("text", h1, h2).alias("cut"))
    form = F.when((F.col("text") == "") | F.col("cut.marked") | (F.col("r3") >= fim_percent), "plain").when(F.col("r4") < spm_percent, "spm").otherwise("psm")
    at = cut.select("doc_id", "text", form.alias("form"), F.col("cut.n").alias("n"), F.col("cut.first").cast("int").alias("a"), F.col("cut.second").cast("int").alias("b"))
    prefix, middle = F.substring("text", F.lit(1), F.col("a")), F.substring("text", F.col("a") + 1, F.col("b") - F.col("a"))
    suffix = F.substring("text", F.col("b") + 1, F.length("text") - F.col("b"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cutting = F.col("form") != "plain"
    return at.select("doc_id", "n", "form", F.when(cutting, F.col("a").cast("long")).alias("prefix_chars"), F.when(cutting, (F.col("b") - F.col("a")).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text an output was made of, from the output and its form alone."""
    p, s, m = sentinels
    after = lambda text, mark: F.substring(text, F.length(F.substring_index(text, mark, 1)) + len(mark) + 1, F.length(text))
    psm, spm = F.substring(output, F.lit(len(p) + 1), F.length(output)), F.substring(output, F.lit(len(s) + 1), F.length(output))
    rest = after(psm, s)
    from_psm = F.concat(F.substring_index(psm, s, 1), after(rest, m), F.substring_index(rest, m, 1))
    tail = after(spm, p)
    from_spm = F.concat(F.substring_index(tail, m, 1), after(tail, m), F.substring_index(spm, p, 1))
    return F.when(form == "plain", output).when(form == "psm", from_psm).otherwise(from_spm)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
