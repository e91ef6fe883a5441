"""The skip-chain field against plain versions, and on generated texts with known repeats."""

import itertools
import random

import numpy as np
import pytest

from whorl.llm import pii


def plain_settle(unary, edges, strength, rounds):
    """Damped max-product, message by message in dictionaries."""
    n, k = unary.shape
    sent = {(i, j, e): [0.0] * k for e, (a, b) in enumerate(edges) for i, j in ((a, b), (b, a))}
    for _ in range(rounds):
        new = {}
        for (i, j, e), old in sent.items():
            belief = [unary[i, s] + sum(m[s] for (a, b, f), m in sent.items() if b == i and f != e) for s in range(k)]
            out = [max(max(belief), belief[s] + strength[e]) for s in range(k)]
            top = max(out)
            new[i, j, e] = [0.5 * o + 0.5 * (v - top) for o, v in zip(old, out, strict=True)]
        sent = new
    return [int(np.argmax([unary[i, s] + sum(m[s] for (a, b, f), m in sent.items() if b == i) for s in range(k)])) for i in range(n)]


def test_messages_equal_a_plain_version():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(2, 8))
        edges = [(i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4] or [(0, 1)]
        unary, strength = rng.normal(size=(n, 5)), rng.uniform(0, 3, len(edges))
        assert pii.settle(unary, np.array(edges), strength, 12).tolist() == plain_settle(unary, edges, strength, 12)


def test_labels_of_trees_are_the_best_of_all():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(2, 6))
        edges = np.array([(int(rng.integers(i)), i) for i in range(1, n)])
        unary, strength = rng.normal(size=(n, 3)), rng.uniform(0, 2, n - 1)
        score = lambda y: sum(unary[i, s] for i, s in enumerate(y)) + sum(p for (a, b), p in zip(edges, strength, strict=True) if y[a] == y[b])  # noqa: B023, E731
        assert tuple(pii.settle(unary, edges, strength, 200)) == max(itertools.product(range(3), repeat=n), key=score)


def generated(n, seed):
    """Texts with one base span or none, other forms of it (known), and numbers that are none, some of them repeated."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    for _ in range(n):
        noise = [digits(r.choice([4, 5, 6, 8, 11])) for _ in range(r.randint(0, 4))]
        items, known = [*noise, *noise[: r.randint(0, 1)]], []
        kind, first = r.choice(["phone", "email", "none"]), []
        if kind == "phone":
            p = digits(10)
            first, known = [f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}"], [f"1{p}", f"{p[:3]}-{p[3:6]}-{p[6:]}"][: r.randint(1, 2)]
        if kind == "email":
            user = f"{word()}.{word()}"
            first, known = [f"{user}@{word()}.org"], [f"{user}@{word()}"]
        items += known
        r.shuffle(items)
        text = " ".join(x for item in [*first, *items] for x in (*(word() for _ in range(r.randint(1, 6))), item)) + f" {word()}"
        out.append((text, set(known)))
    return out


@pytest.fixture(scope="module")
def field():
    return pii.fit([text for text, _ in generated(800, 1)])


def test_added_spans_are_the_other_forms_of_base_spans(field):
    hit = extra = missed = 0
    for text, known in generated(800, 2):
        got = {text[s:e] for s, _, e, base in pii.find(text, field) if not base}
        hit, extra, missed = hit + len(got & known), extra + len(got - known), missed + len(known - got)
    assert hit >= 0.85 * (hit + missed) and hit >= 0.97 * (hit + extra)


def test_edges_are_learned(field):
    assert (field.strengths >= 0).all() and field.strengths[pii.SAME] > 1 and field.strengths[pii.SIMILAR] > 1


def test_an_unrelated_base_span_does_not_decide(field):
    for body in ("order 48151623 and again 48151623 here", "see 9870157079875996 then 9870157079875996"):
        added = lambda text: [(text[s:e], k) for s, k, e, base in pii.find(text, field) if not base]
        assert added(body) == added("mail a.b@c.org first. " + body)


def test_base_spans_stay_and_fields_of_nothing_are_empty(field):
    text = "call +1 (555) 555-0100, or 15555550100; mail ann.lee@x.org or ann.lee@x"
    assert [x[:3] for x in pii.find(text, field) if x[3]] == pii.base_spans(text)
    assert pii.find("", field) == [] and pii.find("no digits", field) == []
    assert pii.find("12 12 12 12", field) == []
    assert pii.fit([]).weights.shape == (5, len(pii.features("x")))
