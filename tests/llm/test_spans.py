import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.llm import pii, secrets
from tarnfold.llm.boosting import BoostedTrees
from tarnfold.llm.spans import matches, running_sums

digits = lambda m: re.sub("[^0-9]", "", m)
SECRETS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
]


def brute(rules, text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m))
    return [f"{rules[k][0]}:{a}:{b}" for a, k, b in found]


def fuzz(seed, bits, n=1500):
    dice = random.Random(seed)
    return ["".join(dice.choice(bits) for _ in range(dice.randint(1, 25))) for _ in range(n)]


HARD = {
    "secrets": fuzz(1, ["token", "Secret", "API_KEY", "passwd", "=", ":", " ", '"', "'", "abc", "x1y2z3", "0123456789abcdef01234567", "AKIA", "ABCDEFGH12345678", "é", "-", "aPiKey"]),
    "personal": fuzz(2, ["1", "22", "255", "256", ".", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "4111111111111111", "4111 1111", "555-0199", "é", "_", "日"]),
}


@pytest.mark.parametrize("which", ["sf", "odd", "hard"])
@pytest.mark.parametrize("kind", ["secrets", "personal"])
def test_base_spans_against_brute_force(spark, request, tmp_path, which, kind):
    rules, query, base = (SECRETS, secrets.op6_blob_ledger_secrets, 3) if kind == "secrets" else (PERSONAL, pii.op7_boosted_candidates, 4)
    if which == "hard":
        spark.createDataFrame(list(enumerate(HARD[kind])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        path = str(tmp_path)
    else:
        path = request.getfixturevalue(which)
    texts = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    names = [r[0] for r in rules]

    def expected(t):
        spans = brute(rules, t)
        counts = tuple(sum(s.startswith(f"{n}:") for s in spans) for n in names)
        return *counts, hashlib.sha256(",".join(spans).encode()).hexdigest()

    got = query(spark, path).collect()
    assert sorted((str(r.doc_id), *(r[f"n_{n}"] for n in names), r.base_sha256) for r in got) == sorted((str(r.doc_id), *expected(r.text)) for r in texts)
    for r in got:  # the method adds spans and takes none away
        kept = [s for s in r.spans.split(",") if s.split(":")[0] in names[:base]]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r.base_sha256


def test_places_of_many_matches(spark):
    text = "é1 " * 3000
    row = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), "[0-9]").alias("m")).first()
    assert [(m.start, m.end) for m in row.m] == [(x.start(), x.end()) for x in re.finditer("[0-9]", text)]
    sums = spark.createDataFrame([([],), ([5],), (list(range(50)),)], "a array<int>").select(running_sums(F.col("a")).alias("s")).collect()
    assert [r.s for r in sums] == [[], [5], np.cumsum(range(50)).tolist()]


@pytest.mark.parametrize("few", [secrets.FEW, 0])
def test_the_ledger_scans_only_what_is_new(spark, monkeypatch, few):
    monkeypatch.setattr(secrets, "FEW", few)
    day = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    first = day(("a", "token=abcdef1"), ("b", "token=abcdef1"), ("c", None))
    ledger = secrets.scan(first)
    assert ledger.count() == 2
    second = day(("a", "token=abcdef1"), ("a", "token=abcdef1 x"), ("d", "nothing"))
    new = secrets.scan(second, ledger)
    assert new.count() == 2 and new.join(ledger, "blob").count() == 0
    assert secrets.scan(second, ledger, version="other").count() == 3
    found = secrets.findings(second, ledger.unionByName(new))
    assert {(r.path, len(r.spans)) for r in found.collect()} == {("a", 1), ("d", 0)} and found.count() == 3


def test_the_query_keeps_one_ledger_and_scans_unseen_blobs_only(spark, tmp_path, monkeypatch):
    """A later run extends the ledger by what is new; changed rules start anew; a scan that broke off doesn't count."""
    monkeypatch.setattr(secrets, "shared_folder", lambda spark: f"{tmp_path}/shared")
    day = [(1, "token=abcdef1"), (2, "token=abcdef1"), (3, None)]

    def run(rows, name):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return sorted((r.doc_id, r.spans) for r in secrets.op6_blob_ledger_secrets(spark, f"{tmp_path}/{name}").collect())

    sizes = lambda: sorted(spark.read.parquet(x).count() for x in secrets.complete_folders(spark, secrets.Ledger(spark).path))
    assert run(day, "one") == [(1, "assign:0:13"), (2, "assign:0:13"), (3, "")] and sizes() == [2]
    assert run([*day, (4, "x token=abcdef1")], "two")[-1] == (4, "assign:2:15") and sizes() == [1, 2]
    assert run(day, "three")[0] == (1, "assign:0:13") and sizes() == [0, 1, 2]
    broken = f"{secrets.Ledger(spark).path}/broken"
    spark.createDataFrame([("x", "y", [])], secrets.LEDGER).write.parquet(broken)
    (tmp_path / "shared/secrets-ledger" / broken.split("secrets-ledger/")[1] / "_SUCCESS").unlink()
    ledger = secrets.Ledger(spark)
    assert ledger.rows().count() == 3
    ledger.compact()
    assert sizes() == [3] and ledger.rows().count() == 3
    before = secrets.rule_version()
    monkeypatch.setattr(secrets, "MIN_VALUE", 8)
    assert secrets.rule_version() != before and run(day, "four") == [(1, ""), (2, ""), (3, "")] and sizes() == [2]


def test_trees_in_sql_equal_trees_in_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (400, 3)).astype(float)
    y = ((x[:, 0] > 1) & (x[:, 1] < 2) | (x[:, 2] == 3)).astype(float)
    trees = BoostedTrees(rounds=8).fit(x[:200], y[:200]).calibrate(x[200:], y[200:], 0.9)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r.p for r in rows.select(trees.column([F.col("a"), F.col("b"), F.col("c")]).alias("p")).collect()]
    assert np.allclose(got, trees.probability(x)) and ((trees.probability(x[200:]) > 0.5) == y[200:]).mean() > 0.97


def test_candidates_are_judged_by_their_context(spark):
    rows = [
        ("call 603-555-1234 now", 1), ("about 603-555-1234 of them", 0), ("ssn 123-45-6789.", 1), ("isbn 978-3-16-148410-0", 0),
        ("contact: ann [at] site [dot] org", 1), ("look at this dot com", 0), ("version 1.2.3.4567.8", 0), ("in 4425679706863801 cases", 0),
    ]
    df = spark.createDataFrame(rows, "text string, n int").select("text", "n", pii.personal_spans(F.col("text")).alias("spans"))
    assert [(r.text, len(r.spans)) for r in df.collect()] == rows


def test_sql_features_equal_python_features(spark):
    cases = [("603-555-1234", "please call ", " "), ("4111 1111 1111 1111", "x", "a"), ("ann[at]site[dot]org", "write to ", "."), ("+1 (22) 33.44", "total $", "")]
    df = spark.createDataFrame(cases, "m string, b string, a string")
    row = df.select(F.array(*pii._features(F.col("m"), F.col("b"), F.col("a"))).alias("f"))
    assert [r.f for r in row.collect()] == [list(map(float, pii.features(*c))) for c in cases]


def test_redaction(spark):
    rows = [(1, "mail a@b.cd or +1 (603) 555-8791!", 5, "k"), (2, None, None, None), (3, "clean", 5, None), (4, "+4111 1111 1111 1111 é", 3, None)]
    out = pii.cleaned(spark.createDataFrame(rows, "doc_id int, text string, n_chars long, spans string"))
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "mail [EMAIL] or [PHONE]!" and got[1].n_chars == len(got[1].text) and got[1].spans == "k"
    assert got[2].text is None and got[3].text == "clean" and "4111" not in got[4].text and got[4].text.endswith(" é")


def test_a_corpus_teaches_how_it_announces_personal_data(spark):
    """The word before what the base patterns find makes like numbers without their form personal too; other numbers stay."""
    dice = random.Random(6)
    d = lambda k: "".join(dice.choice("0123456789") for _ in range(k))
    texts = [f"und zorbel +1 ({d(3)}) {d(3)}-{d(4)} quen, la vemo {d(9)} tre" for _ in range(150)] + [f"at the ronta {d(3)}-{d(3)}-{d(4)} on" for _ in range(100)]
    by = pii.fitted(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert by.words["zorbel"] > 1 > 0 > by.words["ronta"]
    rows = [("und zorbel 603-555-1234 quen", 1), ("at the ronta 603-555-1234 on", 0), ("la vemo 603555123 tre", 0), ("und zorbel quen", 0)]
    df = spark.createDataFrame(rows, "text string, n int")
    got = df.select("text", "n", F.size(pii.personal_spans(F.col("text"), by)).alias("found")).collect()
    assert [r.found for r in got] == [r.n for r in got]
    plain = df.select("text", F.size(pii.personal_spans(F.col("text"))).alias("found")).collect()
    assert plain[0].found == 0  # which nobody could know without the corpus


def test_planted_candidates_in_real_documents(spark, sf):
    """Recall and precision of what the trees add, on announced and unannounced numbers put into documents of the test data."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 400").select("text").limit(400).collect()]
    dice = random.Random(9)
    d = lambda k: "".join(dice.choice("0123456789") for _ in range(k))
    bad = [lambda: f"call {d(3)}-{d(3)}-{d(4)}", lambda: f"tel. 0{d(3)} {d(6)}", lambda: f"ssn {d(3)}-{d(2)}-{d(4)}", lambda: f"passport no {d(9)}", lambda: "contact lee [at] some [dot] net"]
    good = [lambda: f"order {d(9)}", lambda: f"version {d(1)}.{d(2)}.{d(3)}.{d(4)}", lambda: d(8), lambda: f"isbn {d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: "look at this dot com"]
    rows = []
    for k, t in enumerate(docs):
        words, planted = t.split(" "), dice.choice(bad if k % 2 else good)()
        at = dice.randrange(1, len(words))
        rows.append((" ".join([*words[:at], planted, *words[at:]]), k % 2))
    df = spark.createDataFrame(rows, "text string, planted int")
    by = pii.fitted(spark.createDataFrame([(t,) for t in docs], "text string"))
    added = F.size(F.filter(pii.personal_spans(F.col("text"), by), lambda s: s["kind"] >= pii.BASE_KINDS))
    got = df.select("planted", added.alias("n")).collect()
    recall = np.mean([r.n > 0 for r in got if r.planted])
    wrong = np.mean([r.n > 0 for r in got if not r.planted])
    print(f"recall {recall:.3f}, wrongly added {wrong:.3f}")
    assert recall > 0.85 and wrong < 0.03
