"""Spans of secrets and names reach to their ends, whatever their length, case and letters."""

import pytest

from tracemill.llm import pii


def spans(text, kind):
    return [text[a:b] for a, b, k in pii.added_candidates(text, pii.base_spans(text)) if k == kind]


LONG = "eyJ" + "aB3-x_" * 170


@pytest.mark.parametrize("text, secret", [(f"token={LONG} end", LONG), (f"key ghp_{LONG} end", f"ghp_{LONG}"), (f'"token": "{LONG}.{LONG}"', f"{LONG}.{LONG}")])
def test_long_secrets_are_whole(text, secret):
    assert len(secret) > 1000 and spans(text, "secret") == [secret]


@pytest.mark.parametrize("key", ["password", "PASSWORD", "Password", "DB_PASSWORD", "my_api_key", "Api_Key"])
def test_key_names_in_any_case_and_with_prefix(key):
    assert spans(f"x {key}=s3cr3tValue y", "secret") == ["s3cr3tValue"]


def test_other_words_are_no_key_names():
    assert spans("xpassword=s3cr3tValue tokens=s3cr3tValue", "secret") == []


@pytest.mark.parametrize("title, name", [("Herr", "Müller"), ("Sra", "Núñez"), ("Mme", "Élodie Lefèvre"), ("Dr.", "Müller"), ("Mr", "John Smith"), ("Prof.", "Ωmega"), ("Frau", "A" + "b" * 40)])
def test_names_of_any_letters(title, name):
    assert spans(f"an {title} {name}, hier", "name") == [name]


def test_redact_rows_without_id_or_with_a_repeated_one(spark):
    rows = [(None, "mail bob@example.com now"), (None, "from 10.1.2.3"), (1, "a bob@example.com b"), (1, "much longer before ann@example.com"), (2, None), (2, "plain")]
    found = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = [(None, "mail [email] now"), (None, "from [ip]"), (1, "a [email] b"), (1, "much longer before [email]"), (2, ""), (2, "plain")]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)


def test_base_spans_against_the_patterns():
    """Leftmost matches of the contract's patterns, filtered without retries, on texts made of their pieces."""
    import random
    import re

    from tracemill.llm import pii

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= sum(c.isdigit() for c in m) <= 19 and luhn(m)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= sum(c.isdigit() for c in m) <= 15),
    }

    def luhn(m):
        digits = [int(c) for c in m if c.isdigit()][::-1]
        return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0

    random.seed(3)
    pieces = ["a", "b.c", "@", "x@y", ".de", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 20 7946 0958", "+1", " ", "-", "(0)", "99", "1.1.1.1.1", "é", "\n"]
    for _ in range(3000):
        text = "".join(random.choices(pieces, k=random.randint(1, 9)))
        found = [(m.start(), m.end(), k) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]
        assert pii.base_spans(text) == sorted(found, key=lambda s: (s[0], list(kinds).index(s[2]))), text


def test_reliabilities_are_recovered():
    import itertools

    import numpy as np

    from tracemill.llm import pii

    right, prior = (0.9, 0.8, 0.7), 0.4  # how often each labeler that votes is right
    patterns = np.array(list(itertools.product((pii.NO, pii.YES), repeat=3)))
    counts = np.zeros(len(patterns))
    for truth, share in ((pii.NO, 1 - prior), (pii.YES, prior)):
        counts += share * np.prod([np.where(patterns[:, j] == truth, r, 1 - r) for j, r in enumerate(right)], axis=0)
    posterior, theta, found = pii.expectation_maximisation(patterns, counts * 100_000, rounds=500)
    assert abs(found - prior) < 0.05
    assert all(abs(theta[j, 1, pii.YES] - r) < 0.05 and abs(theta[j, 0, pii.NO] - r) < 0.05 for j, r in enumerate(right))
    assert posterior[patterns.tolist().index([pii.YES] * 3)] > 0.9


def test_every_added_kind_has_three_informed_labelers():
    from tracemill.llm import pii

    texts = ["ssn 123-45-6789", "no 000-00-0000 or 750-12-3456", "call 212-345-6789", "at 011-345-6789", "contact Dr Anna Schmidt", "by Mr Xu Xu", "password=Abc123xyz", "token: aaaaaa"]
    votes = {}
    for text in texts:
        for a, b, kind in pii.added_candidates(text, []):
            votes.setdefault(kind, []).append(pii._votes(text, a, b, kind))
    for kind in pii.ADDED_KINDS:
        shape, gazetteer, context = map(set, zip(*votes[kind]))
        assert len(shape) > 1 and pii.YES in gazetteer and pii.YES in context, kind
