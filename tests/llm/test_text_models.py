import itertools

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import language, toxicity


def test_fold():
    assert toxicity.fold("1D10T ѕtuріd ｉｄｉｏｔ w0rthl3ss") == "idiot stupid idiot worthless"
    assert toxicity.fold("2024 10 a.b $5") == "2024 10 a.b $5"
    assert toxicity.fold("id​iot") == "idiot"


def test_lexicon_counts_words_outside_exceptions():
    lexicon = toxicity.Lexicon({"idiot ": 5.0, "achli": 3.0, "achlich ": 4.0, "trash ": 6.0}, exceptions=("trash can",))
    assert lexicon.found("an idiot, idiots") == (1, 5.0)
    assert lexicon.found("achlichkeit xachlich achlich") == (2, 7.0)
    assert lexicon.found("the trash can and trash") == (1, 6.0)
    assert toxicity.Lexicon({}, exceptions=()).found("any") == (0, 0.0)


def test_learned_scores(spark, documents):
    rng = np.random.default_rng(0)
    words = [a + b for a, b in itertools.product(["ba", "du", "ki", "lo", "me"], ["ra", "ti", "no", "su"])]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(words, 40))
        bad = i % 3 == 0
        if bad:
            text[5] = text[20] = "vermin"
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    labels += [(3, 0, None), (None, 1, 1)]
    docs = documents([*rows, (1000, None), (1001, ""), (1001, ""), (None, "a vermin vermin")])
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs.selectExpr("*", "1 AS score", "2 AS weight"), lexicon).collect()}
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in range(400))
    assert got[1000]["predicted"] == 0 and 0 <= got[1001]["score"] < 0.5 and got[None]["predicted"] == 1
    assert toxicity.score(docs.limit(0), lexicon).count() == 0
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r["predicted"] == 0 for r in toxicity.score(docs, none).collect())


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(1)
    width, k = 4, 3
    emission, transition, start = rng.normal(size=(2, width, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    live = np.array([[True] * 4, [True, True, False, False]])
    marginal, pairs = language.forward_backward(emission, live, transition, start)
    want_pairs = np.zeros((k, k))
    for c in range(2):
        n = int(live[c].sum())
        weight, total = np.zeros((n, k)), 0.0
        two = np.zeros((k, k))
        for path in itertools.product(range(k), repeat=n):
            p = np.exp(start[path[0]] + sum(emission[c, i, y] for i, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            for i, y in enumerate(path):
                weight[i, y] += p
            for a, b in zip(path, path[1:], strict=False):
                two[a, b] += p
        assert np.allclose(marginal[c, :n], weight / total)
        want_pairs += two / total
    assert np.allclose(pairs, want_pairs)
    ones = np.ones((2, k))
    assert np.allclose(language.marginals(emission.copy(), live, transition, ones * np.exp(start), ones)[live], marginal[live])


def _model(k=3, seed=3):
    rng = np.random.default_rng(seed)
    emission = rng.normal(size=(language.BUCKETS + k, k)).astype(np.float32) / 3
    return language.Crf([f"l{i}" for i in range(k)], emission, rng.normal(size=(k, k)).astype(np.float32), rng.normal(size=k).astype(np.float32), np.zeros(0, np.uint64), np.zeros((0, k), np.float32))


def test_messages_pass_block_ends():
    """Texts of 0 to 130 words, in blocks of 32, have the marginals and switches of one chain."""
    model, rng = _model(), np.random.default_rng(4)
    texts = [" ".join(rng.choice(["ab", "cde", "f", "ghij", "kl"], n)) for n in (100, 0, 1, 32, 33, 64, 65, 130)]
    total, words, switches = language.labelled(model, pa.array(texts))
    for text, got, n, changed in zip(texts, total, words, switches, strict=True):
        own = text.split()
        assert n == len(own)
        if not own:
            continue
        e = language._emit(model, own).astype(float)
        a, b = [np.exp(model.start + e[0])], [np.ones(3)]
        for x in e[1:]:
            a.append((a[-1] @ np.exp(model.transition)) * np.exp(x))
            a[-1] /= a[-1].sum()
        for x in e[:0:-1]:
            b.insert(0, np.exp(model.transition) @ (np.exp(x) * b[0]))
            b[0] /= b[0].sum()
        m = np.array(a) * np.array(b)
        m /= m.sum(axis=1, keepdims=True)
        assert np.allclose(m.sum(axis=0), got, atol=1e-3) and changed == (np.diff(m.argmax(axis=1)) != 0).sum()


def test_long_runs_are_labelled_piece_by_piece():
    values, codes, bounds = language._words(pa.array(["ab " + "x" * 60 + "y cd", None, "z" * 25]))
    assert [values[c] for c in codes[bounds[0] : bounds[1]]] == ["ab", "x" * 24, "x" * 24, "x" * 12 + "y", "cd"]
    assert bounds[1] == bounds[2] and [values[c] for c in codes[bounds[2] :]] == ["z" * 24, "z"]
    total, words, _ = language.labelled(_model(), pa.array(["w" * 100_000, "v " * 100_000]))
    assert list(words) == [-(-100_000 // 24), 100_000] and np.allclose(total.sum(axis=1), words, rtol=1e-3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "idiots", "trash", "can", "trash can", " ", "ab", "abc", "x", "!", "4bc", "é"]), max_size=25).map("".join))
def test_matcher_is_as_naive_scanning(text):
    terms, exceptions = {"idiot ": 5.0, "trash": 3.0, "ab": 1.0, "abc ": 4.0, "can ": 2.0}, ("trash can", "ab x")
    folded = toxicity.fold(text)
    hits, spared = {}, []
    for i in range(len(folded)):
        if i and folded[i - 1].isalpha():
            continue
        for term, weight in terms.items():
            word = term.rstrip()
            end = i + len(word)
            if folded.startswith(word, i) and (term == word or not folded[end : end + 1].isalpha()):
                hits[i] = max(hits.get(i, 0), weight)
        spared += [(i, i + len(p)) for p in exceptions if folded.startswith(p, i) and not folded[i + len(p) : i + len(p) + 1].isalpha()]
    left = [w for i, w in hits.items() if not any(a <= i < b for a, b in spared)]
    assert toxicity.Lexicon(terms, exceptions=exceptions).found(folded) == (len(left), sum(left))


def test_exceptions_are_learned(spark, documents):
    rng = np.random.default_rng(5)
    words = [a + b for a, b in itertools.product(["ba", "du", "ki", "lo", "me"], ["ra", "ti", "no", "su"])]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(words, 40))
        if i % 2:
            text[5] = text[20] = "vermin"
        elif i % 40 == 0:
            text[5:7] = ["vermin", "control"]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, i % 2))
    lexicon = toxicity.learn(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "vermin control" in lexicon.exceptions
    got = {r["doc_id"]: r for r in toxicity.score(documents([(1, "ba vermin control du"), (2, "ba vermin du"), (3, "ba " * 200_000 + "vermin control " * 50_000)]), lexicon).collect()}
    assert got[1]["n_hits"] == got[3]["n_hits"] == 0 and got[2]["n_hits"] == 1


def test_code_switched_words_are_told_apart(documents):
    one, two = "the and was thing ning with that".split(), "der und war keit lich mit dass".split()
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(one if i % 2 else two, 30)), "en" if i % 2 else "de", "s") for i in range(80)]
    mixed = [(900, "the and was thing the that der und war keit lich mit dass der und keit", "en", "s"), (901, "12 34 !!", "en", "s"), (902, None, None, "s"), (903, "", "en", "s"), (904, "the", None, "s")]
    docs = documents([*rows, *mixed])
    model = language.learn(docs.where("doc_id < 900"))
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(80))
    assert got[900]["switches"] == 1 and got[904]["lang_pred"] == "en"
    assert {got[i]["lang_pred"] for i in (901, 902, 903)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    twice = language.predict(docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3")).selectExpr("*", "1 AS score", "2 AS switches", "3 AS lang_pred"), model).collect()
    assert len(twice) == 6 and len(set(twice)) == 3
    at_block_end = documents([(1, " ".join(["the"] * 32 + ["und"] * 40))])
    assert language.predict(at_block_end, model).first()["switches"] == 1
    empty = language.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs.where("doc_id = 901"), empty).collect()} == {"und"}
