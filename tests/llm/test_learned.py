import random

import numpy as np
import pyarrow as pa
import pytest

from opquality.llm import language, toxicity


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    syllables = {"xx": "ba re mi to lu san ver".split(), "yy": "öt kä ru schi ven pfa um".split(), "zz": "ño cia que los rra dez ita".split()}
    bad = {"xx": ["grimble", "snortwick"], "yy": ["pfuik", "dröm"], "zz": ["ñacas"]}
    rows = []
    for n in range(900):
        lang = rng.choice([*syllables])
        w = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic = n % 6 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(bad[lang])
        rows.append((n, " ".join(w), lang, int(toxic)))
    return rows


def test_held_out_toxic_texts_are_found(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxicity string, toxic int")
    learned = docs.where("doc_id % 5 != 0")
    confirmed = learned.where("toxic = 1 and doc_id % 2 = 0")
    model = toxicity.fit(learned, confirmed, 1 / 6)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "toxic", "toxicity"]
    held = [r for r in out.where("doc_id % 5 = 0").collect()]
    right = [(r.toxicity >= 0.5) == (r.toxic == 1) for r in held]
    assert np.mean(right) > 0.95
    assert sum(r.toxicity >= 0.5 for r in held if r.toxic) > 0.9 * sum(r.toxic for r in held)


def test_scores_of_empty_texts_and_nothing_learned(make):
    docs = make([(1, None), (2, ""), (3, "?!"), (4, "some words"), (4, "some words")])
    model = toxicity.fit(docs, docs.where("doc_id > 100"), 0.0)
    assert {0 <= r.toxicity < 0.5 for r in toxicity.score(docs, model).collect()} == {True}
    assert toxicity.score(make([]), model).collect() == []


def test_samples_are_bounded_whatever_the_ids(spark, texts, monkeypatch):
    # A third of all rows has one id, and some rows are there twice.
    rows = [(1 if n % 3 == 0 else n, text, lang, toxic) for n, text, lang, toxic in texts]
    docs = spark.createDataFrame(rows + rows[:90], "doc_id long, text string, lang string, toxic int")
    sizes = []
    monkeypatch.setattr(toxicity, "descend", lambda positive, unlabelled, n, size, *_: sizes.append((len(positive), n)) or (np.zeros(size), 0.0))
    toxicity.fit(docs, docs.where("toxic = 1"), 1 / 6, max_positive=100)
    toxicity.fit(docs, docs.where("toxic = 1"), 1 / 6)
    # Rows with a confirmed id are 301 texts, of which the repeated ones count once.
    assert sizes == [(100, 990), (301, 990)]
    monkeypatch.setattr(language, "train", lambda features, languages: sizes.append(len(languages)))
    sizes.clear()
    language.fit(docs, max_texts=60)
    language.fit(docs)
    assert sizes == [60, 900]


def some_bags(toxic, n):
    rng = np.random.default_rng(n)
    return toxicity.Bags([np.unique(np.concatenate((rng.integers(10, 50, 5), [7] if toxic(k) else [])).astype(np.int64)) for k in range(n)])


def test_the_risk_stays_above_zero():
    unlabelled = some_bags(lambda k: k % 10 == 0, 600)
    w, bias = toxicity.descend(some_bags(lambda k: True, 60), lambda w, b: toxicity.risk(unlabelled, np.ones(600), w, b), 600, 50, 0.1)
    assert w[7] > 0 > bias and bias + w[7] > 0 and (w >= 0).all()


def test_risk_and_derivative_equal_plain_ones():
    bags, times, rng = some_bags(lambda k: k % 3 == 0, 40), np.arange(40) % 4, np.random.default_rng(3)
    w, bias = rng.normal(size=50), -0.7

    def plain(w, bias):
        return sum(t * np.log1p(np.exp(bias + sum(w[k] for k in bags.items[a:b]))) for t, a, b in zip(times, bags.at[:-1], bags.at[1:]))

    loss, slope = toxicity.risk(bags, times, w, bias)
    assert np.isclose(loss, plain(w, bias))
    for k in range(50):
        step = np.zeros(50)
        step[k] = 1e-5
        assert np.isclose(slope[k], (plain(w + step, bias) - plain(w - step, bias)) / 2e-5, atol=1e-6)
    assert np.isclose(slope[50], (plain(w, bias + 1e-5) - plain(w, bias - 1e-5)) / 2e-5, atol=1e-6)


def test_every_unlabelled_row_counts(make):
    rows = [(n, t) for n, t in enumerate(["bad word", "word", None, "", "bad bad", "Bad word", "WORD"] * 30)]
    docs = make(rows).select("text").repartition(5)
    bucket_of = lambda word: next(iter(toxicity.word_buckets(pa.array([word]))))[0]
    buckets = np.unique(np.concatenate([bucket_of("bad"), bucket_of("word")]))
    counts, n = toxicity.bucket_counts(docs, buckets)
    assert n == 210 and (counts[bucket_of("bad")] == 90).all() and (counts[bucket_of("word")] == 120).all()
    sets = toxicity.telling_sets(docs, buckets)
    assert sorted(r.n for r in sets.collect()) == [30, 60, 60, 60]
    w = np.arange(1.0, len(buckets) + 1)
    z = lambda text: -1 + sum(w[np.searchsorted(buckets, k)] for k in next(iter(toxicity.word_buckets(pa.array([text]))))[0])
    loss, slope = toxicity.risk_of_sets(sets, w, -1.0)
    assert np.isclose(loss, sum(np.logaddexp(0, z(t or "")) for _, t in rows))
    assert np.isclose(slope[-1], sum(1 / (1 + np.exp(-z(t or ""))) for _, t in rows))


def test_languages_of_held_out_texts(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, lang_pred int")
    model = language.fit(docs.where("doc_id % 3 != 1"))
    assert model.languages == ["xx", "yy", "zz"]
    out = language.identify(docs.where("doc_id % 3 = 1"), model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "ambiguous"]
    got = out.collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.99 and all(0 <= r.lang_score <= 1 for r in got)


def test_texts_without_letters_and_nothing_learned(make, spark, texts):
    model = language.fit(spark.createDataFrame(texts[:60], "doc_id long, text string, lang string, x int"))
    odd = make([(1, None), (2, ""), (3, "12 ?!"), (4, "ba re mi to"), (4, "ba re mi to"), (5, "日")])
    got = {r.doc_id: r.lang_pred for r in language.identify(odd, model).collect()}
    assert [got[n] for n in (1, 2, 3)] == ["und"] * 3 and got[4] == "xx" and got[5] in ("xx", "yy", "zz")
    assert language.fit(odd.selectExpr("doc_id", "text", "cast(null as string) as lang")) is None
    assert {(r.lang_pred, r.lang_score) for r in language.identify(odd, None).collect()} == {("und", 0.0)}
    assert language.identify(make([]), model).collect() == []


def test_codewords_part_all_languages():
    for n in (2, 3, 4, 7, 12, 40):
        code = language.codewords(n)
        distance = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(distance) >= (1 if n == 2 else 2) and all(abs(c.sum()) < n for c in code.T)
    one = language.train(np.ones((3, language.SIZE)), ["xx"] * 3)
    assert language.decode(one, np.ones((1, language.SIZE)), 0.1)[0] == ["xx"]


def test_a_flipped_bit_is_corrected():
    code = language.codewords(4)
    model = language.Model(["a", "b", "c", "d"], code, np.zeros((language.SIZE, code.shape[1])), np.zeros(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    for n in range(4):
        model.bias = 4 * code[n]
        model.bias[2] *= -1
        names, score, unsure = language.decode(model, np.zeros((1, language.SIZE)), 0.01)
        assert names == [model.languages[n]]
