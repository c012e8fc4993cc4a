import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelloom.llm import pii
from tests.llm.helpers import clashing, frame

STRICT = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in STRICT.items():
        for m in re.finditer(pattern, text):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            good = {
                0: lambda s=s: True,
                1: lambda s=s: all(int(p) <= 255 for p in s.split(".")),
                2: lambda d=d: 16 <= len(d) <= 19 and pii.luhn(d),
                3: lambda d=d: 8 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1204+.@- ()é\n", max_size=60))
def test_base_spans_follow_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_card_and_long_runs_stay_linear():
    assert pii.base_spans("pay 4111 1111-1111 1111 now") == [(2, 4, 23)]
    assert pii.base_spans("1" * 300_000 + "@" + "a" * 300_000) == []
    assert pii.wide_spans("7" * 100_000 + " x@y " + "b" * 100_000, []) == []


@pytest.fixture(scope="module")
def trained(spark):
    pii.bound_batches(spark)
    return pii.train(spark)


def test_parts_of_many_zeros_are_numbers():
    zeros = "0" * 5000
    for part, n in ((zeros + "9", 1), (zeros, 1), (zeros + "256", 0)):
        assert sum(kind == 1 for kind, *_ in pii.base_spans(f"at {part}.1.2.3 now")) == n


def test_candidates_are_judged_by_format_and_context(spark, trained):
    texts = [
        "please mail me at john.doe (at) example (dot) org today",
        "log in on server 10[.]20[.]30[.]40 tonight",
        "call (212) 555-0187 for more",
        "order 1234 5678 9012 3456 shipped",
        "version 1.22.333.4445 is out",
        "write a@b.co or +1 212 555 0187 or 10.0.0.1 or 4111111111111111",
        None,
        "",
    ]
    rows = {r.doc_id: r for r in pii.find_pii(clashing(frame(spark, texts)), *trained).collect()}
    assert rows[0].spans == "email:18:49" and rows[0].n_email == 0 and rows[1].spans.startswith("ip:") and rows[2].spans.startswith("phone:")
    assert rows[3].spans == rows[4].spans == rows[6].spans == rows[7].spans == ""
    r = rows[5]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.spans == "email:6:12,ip:35:43,card:47:63,phone:16:31"
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() and rows[7].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_edges(spark, trained):
    docs = frame(spark, ["a@b.co", "a@b.co", "x " * 30_000 + "a@b.co"], ids=[1, 1, None])
    rows = pii.find_pii(docs, *trained).collect()
    assert sorted(r.spans for r in rows) == ["email:0:6", "email:0:6", "email:60000:60006"]
    assert pii.find_pii(docs.limit(0), *trained).count() == 0


def test_generators_reach_most_of_what_is_personal():
    rows = pii.training_rows(1500, seed=23)
    reached = [bool(pii.wide_spans(t, b) or b) for t, y in rows if y for b in [pii.base_spans(t)]]
    assert sum(reached) >= 0.95 * len(reached)


def test_prose_with_secrets_and_look_alikes(spark, trained):
    """Accepted and rejected candidates in prose like that of a corpus, in upper case too."""
    import random

    from tests.llm.helpers import words

    rng = random.Random(31)
    digits = lambda n, of="0123456789": "".join(rng.choice(of) for _ in range(n))
    secret, plain = [], []
    for k in range(40):
        around = [" ".join(words(rng, rng.randint(3, 40))) for _ in range(2)]
        body = digits(15)
        wrong = body + next(c for c in "0123456789" if not pii.luhn(body + c))
        secret.append(f'{around[0]} token = "{digits(40, "0123456789abcdef")}" {around[1]}.')
        plain.append(f"{around[0]} {wrong if k % 2 else 'commit ' + digits(40, '0123456789abcdef')} {around[1]}.")
    texts = secret + plain + [t.upper() for t in secret[:10]]
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, texts), *trained).collect()}
    found = [got[k].spans.startswith("secret:") and got[k].n_spans == 1 for k in range(40)]
    clean = [got[k].spans == "" and got[k].n_spans == 0 for k in range(40, 80)]
    assert sum(found) >= 38 and sum(clean) >= 36
    at = texts[0].index('"') + 1
    assert got[0].spans == f"secret:{at}:{at + 40}"


def test_of_equal_scores_the_longer_then_the_earlier_stays():
    spans = [{"kind": 3, "start": 0, "stop": 8, "p": 0.9}, {"kind": 2, "start": 4, "stop": 20, "p": 0.9}, {"kind": 3, "start": 19, "stop": 35, "p": 0.9}]
    import pandas as pd

    assert pii._selected(pd.Series([""]), pd.Series([spans]))[0] == "card:4:20"
    assert pii._selected(pd.Series(["ip:40:47"]), pd.Series([spans[:1] + spans[2:]]))[0] == "ip:40:47,phone:0:8,phone:19:35"
