import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lontar.errors import BadInput
from lontar.functions import text as X
from lontar.plans import experiment as P

# Fixed values throughout this file: published sentences and what becomes of them.
ROOTS = ["rumah", "buku", "pidato"]


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "out"),
    [("punya tanya hanya Kenya", "pu ta ha Ke"), ("cafénya RUMAHNYA x²nya", "café RUMAH x²"), ("nya nyanya _nya 9nya nyanyanya", "nya nya _ 9 nyanya"), ("mobilnyanya-ku Nya NYAnya", "mobilnya-ku Nya NYA"), ("", "")],
)
def test_naive_strip(spark, text, out):
    assert one(spark, text, X.naive_strip) == out
    assert out == re.sub(r"(\w+?)nya\b", r"\1", text, flags=re.I)


def test_sentinel(spark):
    assert one(spark, "punya rumahnya", X.sentinel) == "pu <NYA> rumah <NYA>"


@pytest.mark.parametrize(("text", "out"), [("Dia punya rumahnya", "Dia punya rumah"), ("rumahnya bukunya pidatonya", "rumah buku pidato"), ("Kenya  Sonya\nTanya rumahnya.", "Kenya Sonya Tanya rumahnya.")])
def test_guarded(spark, text, out):
    rows = spark.createDataFrame([(1, text)], "id int, contents string")
    roots = spark.createDataFrame([(r,) for r in ROOTS], "root string")
    assert P.apply_strategy(rows, "sastrawi_clitic", roots).first().contents == out


def test_pronoun_remover(spark):
    assert [one(spark, t, X.pronoun_remover) for t in ("bukuku", "buku-mu", "rumahnya", "kami")] == ["buku", "buku", "rumah", "kami"]


def test_normalises_only_where_needed(spark):
    text = unicodedata.normalize("NFD", "café")
    rows = spark.createDataFrame([(1, text), (2, "abc"), (3, None)], "id int, contents string")
    out = {r.id: r.contents for r in P.apply_strategy(rows, "keep").collect()}
    assert out == {1: "café", 2: "abc", 3: None}


def test_strategy_errors(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, contents string")
    with pytest.raises(BadInput):
        P.apply_strategy(rows, "no_such")
    with pytest.raises(BadInput):
        P.apply_strategy(rows, "rule_resolved")


def test_counts(spark):
    text = "Sukarno datang. Pidatonya juga. rumahnya."
    assert one(spark, text, X.count_suffix) == 2
    assert one(spark, text, X.count_anaphoric) == 2
    assert one(spark, text, lambda c: X.entity_referenced(c, F.lit("Sukarno"))) is True
    assert one(spark, text, lambda c: X.entity_referenced(c, F.lit("  "))) is False
    assert one(spark, "", X.count_anaphoric) == 0


def test_prepared_and_differences(spark):
    rows = spark.createDataFrame([("b", "rumahnya"), ("a", "buku")], "id string, contents string")
    roots = spark.createDataFrame([(r,) for r in ROOTS], "root string")
    out = P.prepared(rows, roots)
    assert out.count() == 10
    assert all(r.agree and r.rows == 2 for r in P.row_counts(out).collect())
    keep, strip = (out.where(F.col("strategy") == s) for s in ("keep", "naive_strip"))
    assert P.first_difference(keep, strip).first().id == "b"
    assert P.first_difference(keep, keep).count() == 0
    assert P.prepared(rows, roots, ["keep"], limit=1).first().id == "a"


def test_matrix():
    assert len(P.matrix()) == 10 and P.matrix()[0].run_id == "bm25__keep"
    assert len(P.pending(P.matrix(), {"bm25__keep"})) == 9


def reference_resolved(text, known, window=2):
    """A plain second version, with the whole left context."""
    entity = re.compile(r"\b[A-Z][\wÀ-ÿ]*(?:\s+[A-Z][\wÀ-ÿ]*)*")
    out, at = "", 0
    for m in re.finditer(r"\b([A-Za-zÀ-ÿ]+)nya\b", text, re.I):
        before = [s.strip() for s in re.findall(r"[^.!?]+[.!?]?", text[: m.start()]) if s.strip()]
        names = [e for s in reversed(before[-window:]) for e in entity.findall(s) if not e.lower().endswith("nya")]
        if m[1].lower() in known and names:
            out += text[at : m.start()] + m[1] + " " + names[0]
            at = m.end()
    return out + text[at:]


def test_resolver_against_second_version(spark):
    import random

    random.seed(5)
    words = ["Sukarno", "Hatta Muda", "pidatonya", "Pidatonya", "bukunya", "hujan", ".", "!", "...", "  ", "\n", "Kenya", "rumahnya", "di", "?"]
    rows = [(i, " ".join(random.choices(words, k=random.randrange(1, 60)))) for i in range(150)]
    known = ["pidato", "buku"]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("known", F.array(*map(F.lit, known)))
    got = {r.id: r.out for r in df.select("id", X.resolved(F.col("t"), F.col("known")).alias("out")).collect()}
    assert all(got[i] == reference_resolved(t, known) for i, t in rows)


def test_nominaliser(spark):
    """A root that the tagger calls a verb is left alone."""
    text = "Sukarno datang. Pidatonya terkenal. Bukunya laris."
    rows = spark.createDataFrame([(1, text)], "id int, contents string")
    roots = spark.createDataFrame([(r,) for r in ROOTS], "root string")
    tagger = lambda root: F.when(F.lower(root) == "pidato", "VERB").otherwise("NOUN")
    out = P.apply_strategy(rows, "rule_resolved", roots, tagger=tagger).first().contents
    assert out == "Sukarno datang. Pidatonya terkenal. Buku Sukarno laris."


def test_repeated_and_stemmed_query_terms(spark):
    from lontar.operators.retrieval import bm25, stemming_analyzer

    docs = spark.createDataFrame([(1, "satu dua"), (2, "satu tiga"), (3, "rumahnya besar")], "doc_id long, text string")
    one, two = (spark.createDataFrame([(1, t)], "query_id long, text string") for t in ("satu dua", "satu dua dua dua"))
    a, b = ({r.doc_id: r.score for r in bm25(q, docs).collect()} for q in (one, two))
    assert b[1] - b[2] == pytest.approx(3 * (a[1] - a[2]), abs=1e-5)
    asked = spark.createDataFrame([(1, "Di rumahkah")], "query_id long, text string")
    assert bm25(asked, docs).count() == 0
    assert [r.doc_id for r in bm25(asked, docs, analyzer=stemming_analyzer()).collect()] == [3]


@pytest.mark.parametrize("name", ["S" + "a" * 50_000, " ".join(["Su"] * 20_000)], ids=["word", "run"])
def test_long_names(spark, name):
    """A capitalised word, or a run of them, as long as a text."""
    known = F.array(F.lit("pidato"))
    assert one(spark, f"{name} datang. Pidatonya terkenal.", lambda c: X.resolved(c, known)) == f"{name} datang. Pidato {name} terkenal."
    assert one(spark, name, X.query_entity) == name


def test_occurrences_behind_long_names(spark):
    """What is found behind a run of capitalised words as long as a text has the whole run for antecedent."""
    name = "SUKARNO HATTA " * 5_000
    found = one(spark, f"{name}datang. Pidatonya terkenal. Bukunya laris.", lambda c: X.occurrences(c, F.array(F.lit("pidato"), F.lit("buku"))))
    assert [(o.token, o.antecedent, o.function) for o in found] == [("Pidatonya", name[:-1], "anaphoric"), ("Bukunya", name[:-1], "anaphoric")]


def test_long_sentence(spark):
    """A sentence as long as a text: what is kept to the left of an occurrence doesn't grow with it."""
    text = "hujan, " * 50 + "Sukarno Hatta, " + "Kenya datang dan pidatonya terkenal, " * 2_000
    lefts = one(spark, text, lambda c: F.transform(X._cut(c, "[A-Za-zÀ-ÿ]", "nya", 2, F.array(F.lit("pidato")), names_only=True), lambda p: p["left"]))
    assert len(lefts) == 2_001 and max(map(len, lefts)) < 50
    found = one(spark, text, lambda c: X.occurrences(c, F.array(F.lit("pidato"))))
    assert len(found) == 2_000 and {o.antecedent for o in found} == {"Sukarno Hatta"}
    assert {text[o.start : o.stop] for o in found} == {"pidatonya"}


def test_names_are_those_of_the_whole_left_side(spark):
    """Runs that an occurrence ends, that go on behind it, that end with the suffix or only look like the last one."""
    import random

    random.seed(7)
    words = ["Sukarno", "Hatta  Muda", "Muda\n", "pidatonya", "Pidatonya", "BUKUNYA", "hujan", "anaKenya", "Kenya", ".", "...", "!", "\n", "\t", ",", "(Kota", "9B", "é"]
    rows = [(i, "".join(w + random.choice(["", " ", "\n"]) for w in random.choices(words, k=random.randrange(1, 50)))) for i in range(300)]
    known = ["pidato", "buku", "ken", "hattapidato"]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("known", F.array(*map(F.lit, known)))
    got = {r.id: r.out for r in df.select("id", X.resolved(F.col("t"), F.col("known")).alias("out")).collect()}
    assert all(got[i] == reference_resolved(t, known) for i, t in rows)


def test_matrix_with_long_names(spark):
    """All ten conditions where a document and a query are one run of capitalised words, as long as a text."""
    name = "Sukarno " * 20_000
    docs = spark.createDataFrame([(1, f"{name}datang. Pidatonya terkenal."), (2, "Hatta punya buku."), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, f"{name}datang"), (2, "buku Hatta")], "query_id long, text string")
    judged = spark.createDataFrame([(1, 1, 1), (2, 2, 1)], "query_id long, doc_id long, relevance int")
    roots = spark.createDataFrame([(r,) for r in ROOTS], "root string")
    rows = P.evaluate_matrix(asked, docs, judged, roots, hits=2).collect()
    assert len(rows) == 20 and len({r.condition for r in rows}) == 10 and all(r.ndcg_1 == r.recall_10 == 1 for r in rows)


def test_texts_are_tokenised_once_for_postings(spark):
    """No filter before the words of a text makes them again; texts that are empty or null score nowhere."""
    from lontar.operators.retrieval import bm25

    docs = spark.createDataFrame([(1, "satu dua"), (2, ""), (3, None), (4, "...")], "doc_id long, text string")
    run = bm25(spark.createDataFrame([(1, "satu"), (2, ""), (3, None)], "query_id long, text string"), docs)
    assert [(r.query_id, r.doc_id) for r in run.collect()] == [(1, 1)]
    assert "size(regexp_extract_all" not in "".join(x for x in run._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x)
