"""What the personal-data network adds: forms that no pattern knows, written by hand and not by the generator that it learns from."""

import itertools
import re

import numpy as np
import pytest

from evidra.llm import pii, tagger
from tests.conftest import DATA
from tests.llm.helpers import documents, rows_by_id

#: Texts with the spans that stand in braces.
SPOKEN = {
    "email": ["forward {jo @ example . com} everything", "complaints belong in {jane dot doe at example dot com} only", "visitors find {bob [at] mail [dot] org} helpful", "editor: {anna.k (at) uni-ulm.de}", "orders through {sales at bigshop dot net} arrive sooner", "subscribe using {max_m at mailbox dot de}, free of charge", "journalists should email {press [at] paper.fr} beforehand", "author {tom at home dot io}", "maintained by {lee.w @ lab . edu} during summer", "questions? {office(at)firm.com}"],
    "ip": ["gateway {10 . 0 . 0 . 1} replied", "suspicious packets left {192[.]168[.]1[.]10} yesterday", "resolver {2001:db8:85a3::8a2e:370:7334} times out", "routed via {172 . 16 . 254 . 3} overnight", "attacker {203[.]0[.]113[.]77} scanned ports", "nameserver {8 dot 8 dot 4 dot 4}", "pinging {198 . 51 . 100 . 23} succeeded", "neighbour {fe80::1ff:fe23:4567:890a} joined"],
    "card": ["visa {4532.0151.1283.0366} declined", "refund onto {4532/0151/1283/0366} please", "customer gave {4532  0151  1283  0366} yesterday", "expired {4532_0151_1283_0366}", "amex {3782 822463 10005} approved", "billing {4532 - 0151 - 1283 - 0366} monthly", "subscriber {4532 . 0151 . 1283 . 0366} cancelled", "deposit against {3782.822463.10005} returned"],
    "phone": ["hotline {(555) 123-4567} open daily", "Telephone {212-555-0187}", "secretary {0049 30 1234567} answers", "surgery: {030/1234567}", "taxi {06 12 34 56 78} anywhere", "plumber {415.555.2671} recommended", "whisper {five five five one two three four} quietly", "landline {(020) 794 1234}", "handset {0171 2345678}, evenings", "bookings {303 555 0148} required"],
}
#: Texts without personal data that look as if they had some.
HARMLESS = ["on 2024-01-15 at 10:30 we met", "version 1.2.3 of 10.4.2 is out", "pages 120-145, 1999-2004", "ISBN 978-3-16-148410-0 is in print", "Section 4.2.1.3 says so", "the price is $1,234.56 at most", "we met at the house. Then we left", "look at example two three times", "id 123456789012 of the order", "uuid 123e4567-e89b-12d3-a456-426614174000", "52.5200, 13.4050 is Berlin", "order 4532015112830367 shipped", "12 % of 3,400 people at 7:45", "chapter 3.4 and table 12.5", "@someone said that at the dot", "room 214, floor 2, desk 17", "from 1914 to 1918 and 1939 to 1945", "at 5 dot com firms failed", "one two of them, three or four", "0.25 0.5 0.75 1.0"]


@pytest.fixture(scope="module")
def finder():
    return pii.fitted(np.zeros((0, pii.WINDOW), np.int16), np.zeros((0, pii.WINDOW), np.int8), [])


def test_held_out_windows(finder):
    """Each kind's spans of held-out windows are found at the stated precision."""
    assert min(finder.recall) >= 0.8 and sum(finder.recall) / 4 >= 0.9 and all(0 < p < 1 for p in finder.least)


def test_forms_that_the_patterns_miss(finder):
    """By kind, at least 0.65 of spans in surroundings that the generator has none of, 0.75 on average (measured: email 0.7, ip
    and card 0.88, phone 0.8); and nothing in harmless texts."""
    share = {}
    for k, kind in enumerate(pii.KINDS):
        texts = [re.sub("[{}]", "", t) for t in SPOKEN[kind]]
        found = pii.model_spans(finder, texts)
        hits = 0
        for t, plain, spans in zip(SPOKEN[kind], texts, found, strict=True):
            a, b = t.index("{"), t.index("}") - 1
            assert not any(x < b and a < y for _, x, y in pii.base_spans(plain)) or kind == "card" or "@" in t, t
            hits += any(g == k and min(b, y) - max(a, x) >= 0.8 * max(b - a, y - x) for g, x, y in spans)
        share[kind] = hits / len(texts)
    assert min(share.values()) >= 0.65 and sum(share.values()) / 4 >= 0.75, share
    assert [(t, s) for t, s in zip(HARMLESS, pii.model_spans(finder, HARMLESS), strict=True) if s] == []


def test_findings_reach_the_result(spark, finder):
    texts = ["mail a.b@c.de or call (555) 123-4567 now", "pay with 4532.0151.1283.0366 now", "nothing here"]
    docs = documents(spark, texts)
    rows = rows_by_id(pii.scan(docs, finder))
    assert rows[0].spans == "email:5:13,phone:22:36" and rows[0].n_phone == 0 and rows[1].spans == "card:9:28" and rows[2].spans == ""
    assert rows_by_id(pii.redact(docs, finder))[0].text == "mail <EMAIL> or call <PHONE> now"


def test_fit_on_a_table(spark, finder):
    """Patterns' spans stay as they are; clean rows stay clean; an empty table gives a network, too."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    for r in pii.scan(docs, finder).collect():
        assert r.n_email + r.n_ip + r.n_card + r.n_phone <= len(r.spans.split(",")) if r.spans else True
    empty = pii.scan(documents(spark, []), finder)
    assert empty.collect() == []


def test_fit_without_rows(spark, monkeypatch):
    monkeypatch.setattr(pii, "MADE_WINDOWS", 64)
    found = pii.fit(documents(spark, []))
    assert len(found.least) == len(pii.KINDS)


def test_windows_are_reconciled(finder):
    """A span in the middle of a long text is found wherever window borders fall."""
    for shift in range(0, 64, 9):
        t = "write to us " * 30 + "x" * shift + " call (555) 123-4567 now " + "and then more " * 40
        got = pii.model_spans(finder, [t, "", "no numbers"])
        a = t.index("(555)")
        assert got[0] == [(3, a, a + 14)] and got[1:] == [[], []], shift


def test_span_probabilities_against_all_sequences():
    """Forward and backward sums against every tag sequence of a short row."""
    rng = np.random.default_rng(1)
    m = tagger.Tagger({"trans": rng.normal(size=(3, 3))}, 3)
    em = rng.normal(size=(1, 5, 3))
    n = 4  # the row is shorter than the array
    score = {}
    for tags in itertools.product(range(3), repeat=n):
        score[tags] = np.exp(sum(em[0, i, t] for i, t in enumerate(tags)) + sum(m.p["trans"][a, b] for a, b in zip(tags, tags[1:], strict=False)))
    total = sum(score.values())
    alpha, beta, logz = m.sums(em, np.array([n]))
    assert np.isclose(logz[0], np.log(total))
    for s, e in itertools.combinations(range(n + 1), 2):
        want = sum(v for t, v in score.items() if t[s] == 1 and all(x == 2 for x in t[s + 1 : e]) and (e == n or t[e] != 2)) / total
        assert np.isclose(m.span_probability(em[0, :n], alpha[:n, 0], beta[:n, 0], logz[0], s, e, 1), want)
