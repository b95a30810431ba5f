"""Personal data: base patterns, and candidates chosen by boosted trees.

The base patterns' spans always count.  Beside them, high-recall generators propose further, also
overlapping spans: digit groups in any punctuation, and addresses spelled out with "at" and "dot".  Boosted
trees judge them by their format and by what stands before them; calibrated on rows that were not fitted,
a threshold selects those to redact.

No labelled personal data is at hand.  The trees are fitted on two bounded lots: generated candidates of known
kinds (``SAMPLE``, from a seeded generator), and the documents' own candidates (``SAMPLE`` of those in about
``SAMPLE_DOCS`` documents), labelled by whether a base pattern's span covers them.  The second lot tells what numbers
look like that mean nobody, and, by the words before what the base patterns find, how this corpus announces
personal data: the word before a candidate has its log odds among them as a feature.

Limits of form: a number has 7 to 31 digits with at most two marks between them, longer runs are no candidates; the
parts of a spelled-out address have up to 64, 63 and 10 characters, as addresses do; what stands before is looked at
for BEFORE characters.

All work on documents is DataFrame expressions.  Defined results: a null text is empty; a very long text is
searched as a whole; repeated rows and ties of doc_id get the spans of their own texts; without documents the trees
are fitted on the generated lot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import table, whole_text
from .spans import let, listed, matches, ranked, sha256

KINDS = ["email", "ip", "card", "phone", "number", "contact"]
BASE_KINDS = 4
#: Possessive forms of the base patterns: the same matches, without going back over long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_VALID = rf"^(?:{_PART}\.){{3}}{_PART}$"
#: The generators of further candidates.
NUMBER = r"[+(]?(?<![0-9])[0-9](?:[\x20().-]{0,2}[0-9]){6,30}+(?![0-9])"
CONTACT = r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:[\[(]at[\])]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+\x20?(?:[\[(]dot[\])]|\x20dot\x20)\x20?[A-Za-z]{2,10}"
BEFORE = 24
SAMPLE, SAMPLE_DOCS = 4000, 20_000
#: How often a word has to stand before a candidate of the sample to have log odds of its own, and the counts that they start from.
WORD_SEEN, WORD_START = 5, 2.0
PRECISION = 0.98
CUES = [
    r"(?i)phone|tel\b|tel[.:]|telefon|t[eé]l[eé]phone|tel[eé]fono|call|fax|mobile|cell\b|whatsapp",
    r"(?i)ssn|social|passport|iban|account|card|visa|license|tax id|insurance",
    r"(?i)isbn|version|order|total|price|page|figure|no\.|build|usd|eur|[$€£#=]\s*$",
    r"(?i)mail|contact|write|reach|address",
]


def word_before(before: Column) -> Column:
    """The last word of what stands before, in lower case, without other characters; empty without one."""
    return F.lower(F.regexp_extract(before, r"([\p{L}]+)[^\p{L}]*$", 1))


def _features(m: Column, before: Column, after: Column, words: dict[str, float] | None = None) -> list[Column]:
    """``words`` has the log odds of words before."""
    known = F.from_json(F.lit(json.dumps(words or {})), "map<string,double>")
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    digits = F.regexp_replace(m, "[^0-9]", "")
    return [
        F.char_length(digits).cast("double"),
        F.size(F.split(m, "[^0-9]+")).cast("double"),
        flag(F.contains(m, F.lit("("))), flag(F.startswith(m, F.lit("+"))), flag(F.call_function("luhn_check", digits)),
        *[flag(before.rlike(c)) for c in CUES],
        flag(before.rlike("[A-Za-z0-9_]$") | after.rlike("^[A-Za-z0-9_]")),
        flag(F.contains(m, F.lit("."))), flag(m.rlike(r"(?i)[\[(](?:at|dot)[\])]")), flag(m.rlike("[A-Za-z]")),
        F.coalesce(F.try_element_at(known, word_before(before)), F.lit(0.0)),
    ]


N_FEATURES = 10 + len(CUES)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        total += int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10))
    return bool(digits) and total % 10 == 0


def word_before_of(before: str) -> str:
    found = re.search(r"([^\W\d_]+)[\W\d_]*$", before)
    return found[1].lower() if found else ""


def features(m: str, before: str, after: str, words: dict[str, float] | None = None) -> list[float]:
    """The same as _features, of plain strings."""
    digits = re.sub("[^0-9]", "", m)
    return [
        len(digits), len(re.split("[^0-9]+", m)), "(" in m, m[:1] == "+", luhn(digits),
        *[re.search(c, before) is not None for c in CUES],
        bool(re.search("[A-Za-z0-9_]$", before) or re.search("^[A-Za-z0-9_]", after)),
        "." in m, re.search(r"(?i)[\[(](?:at|dot)[\])]", m) is not None, re.search("[A-Za-z]", m) is not None,
        (words or {}).get(word_before_of(before), 0.0),
    ]


def generated(n: int = SAMPLE, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(candidate, before, after, label): identifiers and numbers with and without the words that announce them."""
    dice = random.Random(seed)
    d = lambda k: "".join(dice.choice("0123456789") for _ in range(k))
    phone = lambda: dice.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"])
    number = lambda: dice.choice([d(7), d(9), d(16), d(20), f"{d(4)}-{d(2)}-{d(2)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(1)}.{d(2)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}"])
    ident = lambda: dice.choice([f"{d(3)}-{d(2)}-{d(4)}", d(9), f"{d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", d(10)])
    mail = lambda: dice.choice(["ann[at]site[dot]org", "j.doe (at) example (dot) com", "info at firm dot net", "x_y [at] host [dot] de"])
    plain = ["", "the sum of ", "in about ", "as with ", "und dann ", "entre le ", "and ", "room ", "from "]
    rows = []
    for _ in range(n):
        kind = dice.randrange(8)
        if kind == 0:
            m, before, y = phone(), dice.choice(["call ", "phone: ", "tel. ", "Fax ", "mobile ", "telefon "]), 1
        elif kind == 1:
            m, before, y = ident(), dice.choice(["ssn ", "passport no ", "IBAN DE", "account ", "insurance number "]), 1
        elif kind == 2:
            m, before, y = mail(), dice.choice(["mail me: ", "contact ", "write to ", "reach "]), 1
        elif kind == 3:
            m, before, y = dice.choice(["look at this dot com", "met at noon dot then"]), dice.choice(plain), 0
        elif kind == 4:
            m, before, y = phone() if dice.random() < 0.3 else number(), dice.choice(["isbn ", "version ", "order ", "total $", "page ", "build ", "#"]), 0
        elif kind == 5:
            m, before, y = number(), dice.choice(["call ", "card ", "x", "id_", "a"]) if dice.random() < 0.1 else dice.choice(plain), 0
        else:
            m, before, y = number() if kind == 6 else dice.choice([d(8), d(16), d(12)]), dice.choice(plain), 0
        rows.append((m, before, dice.choice([" ", ".", ",", "", "a"]) if not y else dice.choice([" ", ".", ","]), y))
    return rows


def own_candidates(docs: DataFrame, n: int = SAMPLE, n_docs: int = SAMPLE_DOCS) -> list[tuple[str, str, str, int]]:
    """(candidate, before, after, label) from about ``n_docs`` of (text): proposals, and 1 for those that a base span covers; ``n`` at most, by a hash."""
    total = docs.count()
    if not total:
        return []
    text = whole_text()
    found = let(text, lambda t: let(base_spans(t), lambda base: F.transform(F.concat(*proposed(t)), lambda s: F.struct(
        s["m"].alias("m"), _before(t, s).alias("before"), F.substring(t, s["end"] + 1, F.lit(1)).alias("after"),
        F.exists(base, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])).cast("int").alias("label"),
    ))))
    rows = docs.sample(min(1.0, n_docs / total), seed=3).select(F.explode(found).alias("c")).select("c.*")
    hashed = F.xxhash64("m", "before", "after", "label")
    return [tuple(r) for r in rows.orderBy(hashed, "m", "before", "after", "label").limit(n).collect()]


def log_odds(rows: list[tuple[str, str, str, int]]) -> dict[str, float]:
    """Of each word that stands before enough of the candidates, how much likelier it is before personal data; 0 is as likely as on the whole."""
    seen: dict[str, list[int]] = {}
    for _, before, _, y in rows:
        if word := word_before_of(before):
            seen.setdefault(word, [0, 0])[y] += 1
    whole = [WORD_START + sum(r[3] == y for r in rows) for y in (0, 1)]
    odds = lambda n: float(np.log((n[1] + WORD_START * whole[1] / sum(whole)) / (n[0] + WORD_START * whole[0] / sum(whole))) - np.log(whole[1] / whole[0]))
    return {w: round(odds(n), 4) for w, n in sorted(seen.items()) if sum(n) >= WORD_SEEN}


class Judge:
    """Trees with the log odds of words that they were fitted with."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        half = len(rows) // 2
        order = random.Random(1).sample(range(len(rows)), len(rows))
        fit, held = ([rows[i] for i in part] for part in (order[:half], order[half:]))
        self.words = log_odds(fit)
        x, z = (np.array([features(*r[:3], self.words) for r in part], np.float64) for part in (fit, held))
        y, w = (np.array([r[3] for r in part], np.float64) for part in (fit, held))
        self.trees = BoostedTrees().fit(x, y).calibrate(z, w, PRECISION)


@functools.cache
def model() -> Judge:
    """Without documents."""
    return Judge(generated())


def fitted(docs: DataFrame) -> Judge:
    """On the generated candidates and the documents' own."""
    own = own_candidates(docs.select("text"))
    return Judge(generated() + own) if own else model()


def base_spans(text: Column) -> Column:
    """Array<struct<start, kind, end>> of the base patterns, by kind."""
    digits = lambda m: F.char_length(F.regexp_replace(m, "[^0-9]", ""))
    email = matches(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(matches(text, IP, text.rlike(IP)), lambda s: s["m"].rlike(IP_VALID))
    card = matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"))
    card = F.filter(card, lambda s: digits(s["m"]).between(14, 19) & F.call_function("luhn_check", F.regexp_replace(s["m"], "[^0-9]", "")))
    phone = F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda s: digits(s["m"]).between(10, 15))
    return F.concat(ranked(email, 0), ranked(ip, 1), ranked(card, 2), ranked(phone, 3))


def _before(text: Column, s: Column) -> Column:
    return F.substring(text, F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE)))


def proposed(text: Column) -> tuple[Column, Column]:
    """Matches of the two generators: numbers, and spelled-out addresses."""
    number = matches(text, NUMBER, text.rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"))
    contact = matches(text, CONTACT, text.rlike(r"(?:[\[(]at[\])]|\x20at\x20)[^\n]{1,70}(?:[\[(]dot[\])]|\x20dot\x20)"))
    return number, contact


def chosen_spans(text: Column, base: Column, by: Judge | None = None) -> Column:
    """Candidates beside the base spans that the trees select."""
    by = by or model()

    def judge(s: Column) -> Column:
        parts = F.array(*_features(s["m"], _before(text, s), F.substring(text, s["end"] + 1, F.lit(1)), by.words))
        chance = let(parts, lambda f: by.trees.column([f[i] for i in range(N_FEATURES)]))
        return (chance >= F.lit(by.trees.threshold)) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return F.concat(*[ranked(F.filter(found, judge), kind) for found, kind in zip(proposed(text), (4, 5))])


def personal_spans(text: Column, by: Judge | None = None) -> Column:
    """All spans, sorted by place."""
    return let(base_spans(text), lambda base: F.sort_array(F.concat(base, chosen_spans(text, base, by))))


def redacted(text: Column, spans: Column) -> Column:
    """The text with a mark such as [EMAIL] in place of each sorted span, from the last to the first; of overlapping ones, what is left of each."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def put(acc: Column, s: Column) -> Column:
        rest = F.substring(acc["text"], F.least(s["end"], acc["limit"]) + 1, F.char_length(acc["text"]))
        done = F.concat(F.substring(acc["text"], F.lit(1), s["start"]), F.get(marks, s["kind"]), rest)
        return F.when(s["start"] < acc["limit"], F.struct(done.alias("text"), s["start"].alias("limit"))).otherwise(acc)

    start = F.struct(text.alias("text"), F.char_length(text).alias("limit"))
    return F.when(F.size(spans) > 0, F.aggregate(F.reverse(spans), start, put)["text"]).otherwise(text)


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by marks, and n_chars, if it is there, counted again; null texts stay."""
    by = fitted(docs)
    clean = let(F.col("text"), lambda t: redacted(t, personal_spans(t, by)))
    columns = {"text": F.when(F.col("text").isNotNull(), clean)}
    out = docs.withColumns(columns)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def op7_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    found = docs.select("doc_id", personal_spans(F.col("text"), fitted(docs)).alias("spans"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = listed(F.filter("spans", lambda s: s["kind"] < BASE_KINDS), KINDS)
    return found.select("doc_id", *[count(k) for k in range(BASE_KINDS)], sha256(base).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"))
