import random
import re
import time

import pytest

from prosegauge.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def checksum(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        d = int(c) * (2 if k % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and checksum(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


PARTS = ["a.b@c.de", "@", "x@y", "+1 (212) 555-0147", "+49 30 1234567", "4111 1111 1111 1111", "4111111111111111", "4111111111111112", "10.0.0.1", "999.1.1.1", "0255.00000000001.1.1", "1.2.3.4.5", "+", "-", " ", "\n", "word", "é", "😀", "..", "a@b.c@d.e", "12", "٣٤"]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_equal_the_patterns(seed):
    rng = random.Random(seed)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) + rng.choice(["", " ", "-"]) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == brute(text), text


SPELLED = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]+)+")


@pytest.mark.parametrize("seed", range(4))
def test_spelled_addresses_equal_the_pattern(seed):
    rng = random.Random(seed)
    parts = ["name", ".", " ", "(at)", "[ at ]", " (at ", "(dot)", " [dot] ", "org", "x-y", "@", "(", ")", "é", "at", "(at) "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert list(pii._spelled_emails(text)) == [m.span() for m in SPELLED.finditer(text)], text


MEGABYTE = 1_000_000


@pytest.mark.parametrize(
    "text",
    [
        "a" * MEGABYTE + " (at",
        "a" * MEGABYTE + " (at) x",
        "a (at) " * (MEGABYTE // 7),
        "a" * MEGABYTE + "@",
        "@" + "a" * MEGABYTE,
        "1" * MEGABYTE,
        "1" * MEGABYTE + ".1",
        "1." * (MEGABYTE // 2),
        "1 " * (MEGABYTE // 2),
        "+1" + " " * MEGABYTE,
        "+1(" * (MEGABYTE // 3),
        "token=" * (MEGABYTE // 6),
        "token=" + "a" * MEGABYTE,
        'token="9f86d081884c7d659a2feaa0c55ad015" ' * (MEGABYTE // 40),
        "10.0.0.1 " * (MEGABYTE // 9),
    ],
    ids=range(15),
)
def test_a_megabyte_takes_little_time(text):
    model = pii.PiiModel(weights={k: {"bias": 1.0} for k in pii.KINDS})
    began = time.process_time()
    first = model.spans(text)
    assert time.process_time() - began < (1.0 if len(first[1]) < 1000 else 10.0)


def test_taken_stretches():
    rng = random.Random(3)
    for _ in range(200):
        spans = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(6)))]
        taken = pii._Taken(spans)
        for _ in range(12):
            a = rng.randrange(60)
            b = a + rng.randrange(1, 9)
            free = all(y <= a or x >= b for x, y in spans)
            assert taken.add(a, b) == free
            if free:
                spans.append((a, b))


def sample():
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = [rng.choice("alpha beta gamma delta".split()) for _ in range(20)]
        if i % 3 == 0:
            words.insert(rng.randrange(20), rng.choice(["a.b@c.org", "10.1.2.3", "4111111111111111", "+1 (212) 555-0147"]))
        if i % 10 == 1:
            words.insert(3, "+1 (212) 555-0147 4111111111111111")
        if i % 10 == 2:
            words.insert(3, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"')
        rows.append((i, " ".join(words)))
    return rows


def test_added_spans_and_kept_base(spark):
    rows = [*sample(), (None, None), (900, ""), (900, "x " * 200_000 + " a.b@c.org")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, spans string")
    got = pii.fitted(docs).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    kinds = set()
    for r in got:
        base = [tuple(s) for s in r.base]
        every = [tuple(s) for s in r.spans]
        assert any(base == brute(t) for t in texts[r.doc_id]) and set(base) <= set(every)
        assert every == sorted(every, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        kinds |= {(s[0], r.doc_id % 10) for s in every if s not in base}
    assert {("card", 1), ("phone", 1), ("secret", 2)} <= kinds and {k for k, _ in kinds} <= {"card", "phone", "secret"}
    assert pii.fitted(docs.limit(0)).count() == 0


def test_reliabilities_favour_agreeing_labelers():
    rows = [("card", "1,1,0,1,1;a", 90), ("card", "-1,-1,0,1,-1;b", 60), ("card", "-1,1,0,-1,-1;b", 10)]
    model = pii.fit_from_counts(rows)
    good, bad, prior = model.reliability["card"]
    assert good[4][2] > 0.9 and bad[4][0] > 0.8 and 0.4 < prior < 0.7
    assert pii.PiiModel().probability(pii.Candidate("ip", 0, 1, False, (0,) * 5)) == 0.0


def test_masking(spark):
    model = pii.fit_pii(spark.createDataFrame(sample(), "doc_id long, text string"))
    assert pii.mask("to a.b@c.org, now", model) == "to <email>, now"
    assert pii.mask(None, model) is None and pii.mask("plain", model) == "plain"


def many_patterns():
    """Documents with over 20,000 patterns of emails, and some secrets once each."""
    rng = random.Random(7)
    rows = []
    for i in range(1000):
        found = []
        for _ in range(45):
            local = [*"7" * rng.randrange(26), *"k" * rng.randrange(26), *(c for c in "._%+-" if rng.random() < 0.5)]
            rng.shuffle(local)
            before, left, end, right = (rng.choice(c) for c in (["", "mail to ", "order no "], [" ", "(", "'", "é"], ["com", "zz"], [" ", ")", "'", "é"]))
            found.append(f"{before}{left}{''.join(local)}k@{'k' * rng.randrange(1, 9)}.{end}{right}")
        rows.append((i, "; ".join(found)))
    keys = ["9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "0123456789abcdef0123", "Zk3+Zk4/Zk5+Zk6/Zk7+Zk8/", "a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6e7f8"]
    return rows + [(5000 + i, f'the token = "{k}" here') for i, k in enumerate(keys)]


def test_rare_kinds_among_very_many_patterns(spark):
    rows = many_patterns()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts = {}
    for _, t in rows:
        for c in pii.candidates(t):
            key = (c.kind, f"{','.join(map(str, c.votes))};{'|'.join(c.form)}")
            counts[key] = counts.get(key, 0) + 1
    assert len(counts) > 20_000
    model, want = pii.fit_pii(docs), pii.fit_from_counts([(*k, n) for k, n in counts.items()])
    assert "secret" in model.weights and all([k for k, _, _ in model.spans(t)[1]] == ["secret"] for i, t in rows if i >= 5000)
    assert model.weights.keys() == want.weights.keys()
    for kind, w in want.weights.items():
        assert model.weights[kind] == pytest.approx(w, abs=1e-6)


def test_tasks_and_driver_fit_the_same_model(spark, monkeypatch):
    docs = spark.createDataFrame(sample(), "doc_id long, text string").repartition(3)
    want = pii.fit_pii(docs)
    monkeypatch.setattr(pii, "DRIVER_PATTERNS", 0)
    got = pii.fit_pii(docs)
    assert got.weights.keys() == want.weights.keys()
    for kind, w in want.weights.items():
        assert got.weights[kind] == pytest.approx(w, abs=1e-6)
    assert pii.fit_pii(docs.limit(0)).weights == {}
