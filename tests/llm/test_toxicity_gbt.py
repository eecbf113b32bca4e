import numpy as np
import pytest
from pyspark.sql import functions as F

from copair.llm import toxicity_gbt as tox
from tests.llm.helpers import no_docs, odd_docs

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()


def corpus(n=900):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        words = [WORDS[int(k)] for k in rng.integers(0, len(WORDS), int(rng.integers(20, 80)))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(2):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["idiot", "moron", "1diot", "mor0n", "scumbag"])))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return tox.learn(spark.createDataFrame(corpus(), "doc_id long, text string, toxic int"))


def test_held_out_accuracy(spark, model):
    rows = corpus(1500)[900:]
    x = np.array([tox.features(t, model.lexicon) for _, t, _ in rows])
    score, label = model.score(x), np.array([y for _, _, y in rows])
    assert ((score >= 0.5) == label).mean() > 0.97
    assert (0 <= score).all() and (score <= 1).all()


def test_lexicon_holds_insults_only(model):
    assert {"idiot", "moron", "scumbag"} <= set(model.lexicon.words)
    assert not set(model.lexicon.words) & set(WORDS)


def test_features_of_odd_texts():
    lexicon = tox.Lexicon({"idiot": 3.0}, {"idio": 3.0})
    for text in (None, "", "  \n"):
        assert tox.features(text, lexicon) == [0.0] * len(tox.FEATURES)
    f = dict(zip(tox.FEATURES, tox.features("YOU are an 1di0t!! idiot, idiotic sooo #$%", lexicon)))
    assert f["lexicon_density"] == pytest.approx(2 / 8) and f["disguised_density"] == pytest.approx(1 / 8)
    assert f["near_second_person"] == 1 and f["start_density"] > 0 and f["stretched_words"] > 0 and f["shouted_words"] > 0


def test_trees_fit_a_step_and_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    base, trees, rate = tox.fit_trees(x, y)
    margin = base + rate * sum(t.predict(x) for t in trees)
    assert ((margin > 0) == y).mean() > 0.97


def brute_isotonic(y):
    n = len(y)
    return [max(min(np.mean(y[i:j + 1]) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_isotonic_against_minmax_formula():
    rng = np.random.default_rng(2)
    margin = np.sort(rng.random(40))
    y = rng.integers(0, 2, 40).astype(float)
    at, value = tox.fit_isotonic(margin, y)
    assert (np.diff(value) > 0).all()
    want = brute_isotonic(y)
    assert sorted(set(np.round(value, 9))) == sorted(set(np.round(want, 9)))


def test_odd_documents(spark, model):
    docs = odd_docs(spark)
    rows = docs.withColumn("__s", tox.score_column("text", model)).collect()
    assert len(rows) == docs.count() and all(0 <= r["__s"] <= 1 for r in rows)
    assert len({r["__s"] for r in rows if not (r["text"] or "").strip()}) == 1


def test_one_label_and_empty_tables(spark):
    same = tox.learn(spark.createDataFrame([(1, "a b", 0), (2, None, 0)], "doc_id long, text string, toxic int"))
    none = tox.learn(no_docs(spark).withColumn("toxic", F.lit(1)))
    for m in (same, none):
        assert no_docs(spark).select(tox.score_column("text", m)).count() == 0
        assert (m.score(np.zeros((1, len(tox.FEATURES)))) < 0.5).all()


@pytest.mark.parametrize("text,hits", [
    ("¡idiota!", 1), ("«idiot»", 1), ("“idiot”", 1), ("‘idiot’", 1), ("idiot…", 1), ("you—idiot", 1), ("idiot/loser", 2),
    ("idiot,moron", 2), ("you.idiot", 1), ("idiot-moron", 2), ("¿1di0t?", 1), ("_idiot_", 1), ("你是白痴吗", 1), ("idiot白痴", 2)])
def test_glued_quoted_and_framed_words_are_looked_up(text, hits):
    lexicon = tox.Lexicon({w: 3.0 for w in ("idiot", "idiota", "loser", "moron", "白痴")}, {})
    f = dict(zip(tox.FEATURES, tox.features(text, lexicon)))
    assert f["lexicon_hits"] == pytest.approx(np.log1p(hits)) and 0 < f["lexicon_density"] <= 1
    assert f["near_second_person"] == (1 if "you" in text else 0)
    assert f["disguised_density"] == (1 if "1di0t" in text else 0)


def test_scoring_sees_every_word_that_training_counts():
    text = "¡Hola! «IDIOT» you—1diot idiot/loser “mor0n” a.b c_d 白痴你好。x Straße ΣΑΣ don't 7 #x# …"
    for word in tox.units(text):
        if not word.endswith("*"):
            assert tox.features(text, tox.Lexicon({word: 1.0}, {}))[FEATURE_HITS] > 0, word


FEATURE_HITS = tox.FEATURES.index("lexicon_hits")


@pytest.mark.parametrize("text", ["sTuPiD", "sTuPiD Ünï ÄÖx no shout", "LOUD sTuPiD", "none"])
def test_capitals_are_counted_over_the_whole_text(text):
    f = dict(zip(tox.FEATURES, tox.features(text, tox.Lexicon({}, {}))))
    assert f["capital_rate"] == pytest.approx(sum(c.isupper() for c in text) / len(text))
