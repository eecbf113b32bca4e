import random
import re

import numpy as np
import pytest

from copair.llm import pii_crf
from tests.llm.helpers import no_docs, odd_docs


def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii_crf.luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii_crf.KINDS.index(s[0])))


def test_base_spans_against_patterns():
    rng = random.Random(1)
    bits = ["1", "2", "9", "0", "25", "255", "256", ".", "-", " ", "+", "@", "a", "b", "(", ")", "4111111111111111", "%", "_", "é", "٣"]
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        assert pii_crf.base_spans(text) == brute_spans(text), text


@pytest.mark.parametrize("text", ["a" * 200000 + "@", "1" * 200000, "1." * 100000, "+1" + " " * 200000, "@" * 100000,
                                  "a@" * 100000, "1 " * 100000, "9" * 5000 + ".1.1.1"])
def test_base_spans_are_linear(text):
    pii_crf.base_spans(text)


def test_luhn():
    assert pii_crf.luhn("4111111111111111") and not pii_crf.luhn("4111111111111112")


def brute_best(crf, chain):
    feats, _ = pii_crf.batch_features([chain])
    emit = crf.scores(feats)[0]
    best = {y: crf.first[y] + emit[0, y] for y in range(pii_crf.N_LABELS)}
    for t in range(1, len(emit)):
        best = {y: max(v + crf.move[x, y] for x, v in best.items()) + emit[t, y] for y in range(pii_crf.N_LABELS)}
    return max(best.values())


def path_score(crf, chain, labels):
    feats, _ = pii_crf.batch_features([chain])
    emit = crf.scores(feats)[0]
    return crf.first[labels[0]] + emit[range(len(labels)), labels].sum() + sum(crf.move[a, b] for a, b in zip(labels, labels[1:]))


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, f"some words before +1 (555) 555-{1000 + i} and name{i}@mail.example.com after it") for i in range(60)],
                                 "doc_id long, text string")
    return pii_crf.learn(docs)


def test_viterbi_is_exact_and_padding_is_neutral(model):
    texts = ["call +1 (555) 555-0100 now", "a@b.com", "no digits 7", "1.2.3.4 and 10.0.0.1, (at) x 5" * 2]
    chains = [pii_crf.chain_tokens(t, 0, len(t)) for t in texts]
    for chain, labels in zip(chains, model.viterbi(chains)):
        assert np.isclose(path_score(model, chain, labels.astype(int)), brute_best(model, chain), atol=1e-3)
        assert np.array_equal(labels, model.viterbi([chain])[0])
        assert all(pii_crf.allowed()[a, b] for a, b in zip(labels, labels[1:]))


def test_gradient_matches_numbers():
    rows = []
    for text in ("call +1 (555) 555-0100 now", "write a@b.com soon", "nothing 5 here"):
        chain = pii_crf.chain_tokens(text, 0, len(text))
        rows.append((chain, pii_crf.labels_of(chain, pii_crf.base_spans(text))))

    def likelihood(crf):
        total = 0.0
        for chain, y in rows:
            feats, _ = pii_crf.batch_features([chain])
            emit = crf.scores(feats)[0].astype(float)
            a = crf.first + emit[0]
            for t in range(1, len(emit)):
                m = a[:, None] + crf.move
                a = np.log(np.exp(m - m.max(0)).sum(0)) + m.max(0) + emit[t]
            total += path_score(crf, chain, np.array(y)) - (np.log(np.exp(a - a.max()).sum()) + a.max())
        return total

    short, long_ = pii_crf.train(rows, steps=3), pii_crf.train(rows, steps=60)
    assert likelihood(short) < likelihood(long_) <= 0.0
    assert likelihood(long_) > -0.5


def test_field_adds_what_the_patterns_miss(model):
    rng = np.random.default_rng(9)
    found = total = 0
    for kind, patterns in pii_crf.TEMPLATES.items():
        for pattern in patterns:
            for _ in range(10):
                value = pii_crf._fill(pattern, rng)
                text = f"some words before {value} after it"
                added = pii_crf.added_spans([text], [pii_crf.base_spans(text)], model)[0]
                found += any(k == kind and text[a:b] == value for k, a, b in added)
                total += not any(k == kind for k, _, _ in pii_crf.base_spans(text))
    assert found >= 0.8 * total


def test_clean_numbers_stay_clean(model):
    texts = ["version 2.0 of 2024-01-02 at 12:30", "Page 12 of 300, 45%", "4111111111111112 is no card", "a = 5, b = [7]"]
    assert pii_crf.added_spans(texts, [pii_crf.base_spans(t) for t in texts], model) == [[], [], [], []]


def test_base_spans_stay_and_masking(spark, model):
    docs = odd_docs(spark).limit(0).unionByName(odd_docs(spark))
    more = spark.createDataFrame([(50, "\U0001f600 mail a.b@c.de, 10.0.0.1 or +49 (30) 1234567 x")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    rows = both.select("doc_id", "text", pii_crf.pii_column("text", model, masked=True).alias("p")).collect()
    for r in rows:
        base = pii_crf.base_spans(r["text"] or "")
        assert r["p"]["base"] == pii_crf.join_spans(base)
        assert set(filter(None, r["p"]["base"].split(","))) <= set(filter(None, r["p"]["spans"].split(",")))
        assert [r["p"][f"n_{k}"] for k in pii_crf.KINDS] == [sum(s[0] == k for s in base) for k in pii_crf.KINDS]
        assert (r["p"]["masked"] is None) == (r["text"] is None)
    last = next(r for r in rows if r["doc_id"] == 50)["p"]
    assert last["masked"] == "\U0001f600 mail <EMAIL>, <IP> or <PHONE> x"
    assert last["base"].startswith("email:7:15,ip:17:25,phone:")


def test_empty_table(spark):
    docs = no_docs(spark)
    crf = pii_crf.learn(docs)
    assert docs.select(pii_crf.pii_column("text", crf)).count() == 0


@pytest.mark.parametrize("kind,pattern", [(k, p) for k, ps in pii_crf.TEMPLATES.items() for p in ps])
def test_each_template_is_found(model, kind, pattern):
    rng = np.random.default_rng(11)
    found = total = 0
    for before, after in [("some words before", "after it"), ("please write to", "or ask"), ("", "")] * 5:
        value = pii_crf._fill(pattern, rng)
        text = f"{before} {value} {after}"
        base = pii_crf.base_spans(text)
        if any(k == kind for k, _, _ in base):
            continue
        total += 1
        found += any(k == kind and text[a:b] == value for k, a, b in pii_crf.added_spans([text], [base], model)[0])
    assert total and found >= 0.8 * total


@pytest.mark.parametrize("address", [
    "maria @ mail.internal-services.example.com", "first.last [at] hosts [dot] com", "name (at) host.com",
    "anna (at) department-of-long-names.university-of-somewhere.example.org",
    "a-very-long-local-part-of.an-address.that-goes-on (at) host.com", "first.last at hosts dot com",
    "maria (at) averyveryverylongunbrokenhostname [dot] example [dot] com"])
def test_whole_addresses_without_base_pattern(model, address):
    text = f"some words before {address} after it"
    assert [text[a:b] for _, a, b in pii_crf.added_spans([text], [pii_crf.base_spans(text)], model)[0]] == [address]


def test_chains_end_at_token_borders():
    text = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz 7 abcdefghijklmnopqrstuvwxyz next words"
    assert [text[a:b] for a, b in pii_crf.chains(text)] == [text[:text.index(" next")]]
    assert pii_crf.chains("no trigger at all in this text, dotted or not") == []


@pytest.mark.parametrize("text", ["look at polka dot dresses", "we met at www.example.com", "one dot two", "(at last) we go"])
def test_spelled_words_in_prose_are_no_address(model, text):
    assert pii_crf.added_spans([text], [[]], model) == [[]]


@pytest.mark.parametrize("text", ["a" * 200000 + "@", "a@" * 50000, "at " * 50000, "a." * 50000 + "1", "[dot] " * 30000,
                                  "at a" + " dot a" * 30000, ". a" * 50000 + "1"])
def test_chains_are_linear(text):
    pii_crf.chains(text)
