import hashlib
import random
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import secrets


def naive(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


PARTS = st.sampled_from(["token", "TOKEN", "api_key", "apikey", "secret", "toKen", " ", "=", ": ", '"', "abc123", "hunter2!", "AKIA", "ABCDEFGHIJ234567", "0123456789abcdef", "deadbeef", "é", "\n", "x"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == naive(text)


def test_costs_rank_values():
    cost = secrets.guess_cost
    for easy in ("password", "Password1", "qwertyuiop", "aaaaaaaaaaaa", "20240131", "abcabcabc", "12345678", "letmein", "changeme", ""):
        assert cost(easy) < secrets.LEAST_COST, easy
    for hard in ("tR7#qLm29!xZ", "9f8KsPq2vB7n", "correct-horse9battery7stap", "0c497b5014f705c0be648d68"):
        assert cost(hard) > secrets.LEAST_COST, hard
    assert cost("zxcvbnm") < cost("zxkvqnm")


def spans_of(df):
    return {r["doc_id"]: r for r in secrets.scan(df).collect()}


def test_scan(documents):
    hexes = "0123456789abcdef01234567"
    rows = [
        (1, f'x token = "{hexes}" y'), (2, "pwd: 'tR7#qLm29!xZ' set"), (3, "pwd: 'letmein'"), (4, None), (5, ""), (6, "AKIA" + "Q" * 16), (7, "password is required, secret = ****** and token: the"),
        (8, "https://bob:9f8KsPq2vB7n@host/x"), (9, "é token=abc12"), (9, "é token=abc12"), (None, "secret:abcdef"),
    ]
    got = spans_of(documents(rows).selectExpr("*", "1 AS spans", "2 AS n_hex"))
    assert got[1]["spans"] == f"assign:2:{11 + len(hexes)},hex:11:{11 + len(hexes)}" or got[1]["n_assign"] == got[1]["n_hex"] == 1
    assert got[2]["spans"] == "guess:6:18" and got[2]["n_assign"] == 0 and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3]["spans"] == "" and got[4]["spans"] == got[5]["spans"] == "" and got[6]["n_access"] == 1
    assert got[7]["spans"] == "" and got[8]["spans"] == "guess:12:24" and got[9]["n_assign"] == 0 and got[None]["n_assign"] == 1
    assert secrets.scan(documents(rows).limit(0)).count() == 0


def test_redaction(documents):
    df = documents([(1, "a token=abcdef1 b"), (2, "clean"), (3, None)]).selectExpr("*", "5 AS spans")
    got = {r["doc_id"]: r for r in secrets.redact_column(df).collect()}
    assert got[1]["text"] == "a [SECRET] b" and got[1]["n_chars"] == 12 and got[2]["text"] == "clean" and got[3]["text"] is None and got[3]["spans"] == 5


def test_values_reach_to_their_delimiter_at_any_length():
    rng = random.Random(3)
    long = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(3000))
    for text in (f'private_key="{long}" x', f"pwd: '{long}' x", f"Authorization: Bearer {long} x", f"say Bearer {long} x", f"https://bob:{long}@host/x", f"pwd: {'a' * 64 + long} x", "pwd: xqkzjvbwpfhm x"):
        at = max((len(w), text.index(w), w) for w in re.findall(r"[A-Za-z0-9]{12,}", text))
        assert secrets.guessed_spans(text, []) == [(at[1], 3, at[1] + at[0])], text[:40]
    assert secrets.guess_cost("a" * 10**6, 8.0) < 8.0 <= secrets.guess_cost("a" * 10**6 + long, 8.0)


def every_cover(value):
    """The cheapest of all segmentations, one after another."""
    import math

    at, brute, n = secrets.segments_from(value), math.log10(secrets._class_size(value)), len(value)
    best = math.inf

    def walk(i, cost, k, run):
        nonlocal best
        if i == n:
            best = min(best, cost + math.log10(math.factorial(k)))
            return
        for j, price in at(i):
            walk(j, cost + price, k + 1, False)
        if not run:
            for j in range(i + 1, n + 1):
                walk(j, cost + brute * (j - i), k + 1, True)

    walk(0, 0.0, 0, False)
    return best if n else 0.0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["pass", "word", "123", "aaa", "qwe", "2021", "X", "k7", "ab", "admin", "!"]), max_size=4).map("".join).filter(lambda v: len(v) <= 11))
def test_cost_is_that_of_the_cheapest_of_all_covers(value):
    assert abs(secrets.guess_cost(value) - every_cover(value)) < 1e-9


def test_words_of_the_corpus_are_cheap_and_passwords_in_copies_are_not(documents):
    rows = [(i, "the necessary blanket of strawberries lies beside the river; pwd: xqkzjvbwpfhm end") for i in range(20)]
    ranks = secrets.learn_words(documents(rows))
    assert {"necessary", "strawberries", "river"} <= set(ranks) and "xqkzjvbwpfhm" not in ranks
    assert secrets.guess_cost("strawberries", ranks=ranks) < 3 < secrets.LEAST_COST < secrets.guess_cost("strawberries")
    got = spans_of(documents([*rows, (50, "token is necessary, token: necessary"), (51, "pwd: xqkzjvbwpfhm")]))
    assert got[0]["n_guess"] == 1 and got[50]["n_guess"] == 0 and got[50]["n_weak"] == got[50]["n_values"] == 2 and got[51]["n_guess"] == 1
    assert secrets.learn_words(documents(rows).limit(0)) == secrets.RANK


def test_the_cost_of_each_base_value_is_asked_for(documents):
    got = spans_of(documents([(1, "token=abcdef1 and secret: tR7qLm29xZ0 then api_key=aaaaaaaa"), (2, "password=")]))
    assert (got[1]["n_assign"], got[1]["n_values"], got[1]["n_guess"], got[1]["n_weak"]) == (3, 3, 0, 2) and got[2]["n_values"] == 0


def test_long_values_are_redacted_whole_and_many_spans_in_time(documents):
    rng = random.Random(4)
    long = "".join(rng.choice(string.ascii_letters) for _ in range(360))
    text = " ".join(f"token=abc{i}def pwd: tR7#qL{i}m29!xZ" for i in range(20_000)) + " " + "g" * 300_000 + " : " + f"pwd: '{long}' x" + " token" * 50_000
    got = secrets.redact_column(documents([(1, text)])).first()["text"]
    assert long[-104:] not in got and got.count("[SECRET]") == 40_001
