import numpy as np
from pyspark.sql import functions as F

from copair.llm import hd_langid
from tests.llm.helpers import no_docs, odd_docs

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then it was thinking that the other things were there",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann ist er nicht mehr zurück gekommen",
    "fr": "le renard brun rapide saute par dessus le chien paresseux et puis il ne revient plus à la maison",
}


def brute_bundle(text, grams):
    clean = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    line = " " + " ".join(clean) + " "
    out = np.zeros(grams.dims)
    for i in range(len(line) - grams.n + 1) if clean else ():
        out += grams._vector(tuple(0 if c == " " else ord(c) for c in reversed(line[i:i + grams.n])))
    return out


def test_bundles_against_brute_force():
    grams = hd_langid.Grams(3, 64, 1)
    texts = ["hello world", " The, quick!! brown", "éé", "a", "x  ", "日本 語テスト ok", "..a..b", "", None, "12 34", "ʼn a" * 3]
    got, some = grams.bundles(texts)
    for t, v, s in zip(texts, got, some):
        assert np.array_equal(v, brute_bundle(t, grams))
        assert s == any(c.isalpha() for c in t or "")


def test_many_scripts_use_the_general_path():
    grams = hd_langid.Grams(3, 32, 1)
    texts = ["".join(chr(0x4e00 + 7 * i + j) for i in range(300)) for j in range(3)]
    got, _ = grams.bundles(texts)
    assert all(np.array_equal(v, brute_bundle(t, grams)) for t, v in zip(texts, got))


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        lang = list(TEXTS)[i % 3]
        words = TEXTS[lang].split()
        rows.append((i, " ".join(words[int(k)] for k in rng.integers(0, len(words), 12)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = hd_langid.learn(docs.where("doc_id < 150"))
    assert profiles.langs == ["de", "en", "fr"]
    out = docs.where("doc_id >= 150").select("lang", hd_langid.predicted("text", profiles).alias("p")).collect()
    assert np.mean([r["lang"] == r["p"]["lang_pred"] for r in out]) > 0.95
    assert all(0 <= r["p"]["score"] <= 1 for r in out)


def test_odd_documents(spark):
    docs = odd_docs(spark)
    profiles = hd_langid.learn(docs)
    out = {r["doc_id"]: r["p"] for r in docs.select("doc_id", hd_langid.predicted("text", profiles).alias("p")).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (3, 4, 5))
    assert out[7]["lang_pred"] == "es" and out[1] == out[2]


def test_empty_tables(spark):
    profiles = hd_langid.learn(no_docs(spark))
    assert profiles.langs == []
    assert no_docs(spark).select(hd_langid.predicted("text", profiles)).count() == 0
    some = odd_docs(spark).select(hd_langid.predicted("text", profiles).alias("p")).select(F.col("p.lang_pred")).distinct()
    assert [r[0] for r in some.collect()] == ["und"]
