"""Letter counts of the derived alignment."""

import pyarrow as pa

from copair.sources import documents


def test_letters_of_a_text_are_counted_once(spark):
    texts = ["", None, "AaBb xX", "ıſK Àé ḿM", "lL" * 5000 + "w", "no letters of these: 12"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(None, "Mm")], "doc_id long, text string")
    df = documents.alignment_from_documents(docs)
    # one pass over the text, whatever the number of columns and branches that use a count
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("letter_counts(") == 1 and "replace" not in plan
    count = lambda x, letter: sum((x or "").count(c) for c in (letter, letter.lower()))
    code = documents.RESIDUES_20
    got = {r.pair_id: (r.seq_a, r.seq_b) for r in df.collect()}
    for i, x in [*enumerate(texts), (None, "Mm")]:
        a = b = ""
        for p, (la, lb) in enumerate(zip(documents.LETTERS_A, documents.LETTERS_B)):
            m, ca, cb = 2 if p % 4 == 3 else 4, count(x, la), count(x, lb)
            a += code[ca % m] if ca else "-"
            b += "-" if not cb else code[5 + (ca if ca and i is not None and i % 4 else cb) % m]
        assert got[i] == (a + code[0], b + code[5])


def test_a_slice_of_texts_keeps_its_place():
    whole = pa.array(["a", None, "bB", "c"])
    assert documents.letter_counts(whole.slice(2)).to_pylist()[0][:3] == [0, 2, 0]
    assert documents.letter_counts(whole.slice(0, 0)).to_pylist() == []
