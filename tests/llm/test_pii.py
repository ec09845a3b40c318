"""Personal data against plain regular expressions and a pattern graph in dictionaries."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from fixtures import documents, frame

from repovigil.llm import pii

KINDS = ["email", "ip", "card", "phone"]
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\Z)[A-Za-z0-9._%+-]+(?:@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
    r"| ?[\[(]at[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)*"
    r"| at [A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)+)"
    r"|\+[0-9][ ().0-9-]+[0-9]"
    r"|(?<![A-Za-z0-9])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![A-Za-z0-9:])"
    r"|(?<![A-Za-z0-9])[0-9]+(?:\[?\.\]?[0-9]+){3}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?:\([0-9]{1,5}\)[ .-]?)?[0-9](?:[ .-]?[0-9])+(?![A-Za-z0-9])"
)
by_all = lambda rows: sorted(rows, key=repr)


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(values)) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def valid(kind, s):
    d = digits(s)
    return {
        "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15,
    }[kind]()


def base(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text) if valid(k, m[0])]


def finds(text):
    """(kind, start, stop, seed, instance, patterns)"""
    hits = list(re.finditer(LOOSE, text))
    out = []
    for n, m in enumerate(hits):
        s, d = m[0], len(digits(m[0]))
        if re.search(r"@|[\[(]at[\])]| at ", s):
            kind = "email"
        elif s[0] == "+":
            kind = "phone" if 7 <= d <= 15 else None
        elif ":" in s or re.fullmatch(r"[0-9]+(?:\[?\.\]?[0-9]+){3}", s):
            kind = "ip"
        else:
            kind = "card" if 13 <= d <= 19 else "phone" if 7 <= d <= 12 else None
        if not kind:
            continue
        seed = any(re.fullmatch(PLAIN[k], s) and valid(k, s) for k in KINDS)
        before = text[hits[n - 1].end() if n else 0 : m.start()][-80:]
        after = text[m.end() : hits[n + 1].start() if n + 1 < len(hits) else len(text)][:80]
        left, right = (re.findall(r"[^\W_]+", re.sub("[0-9]+", "0", x.lower())) for x in (before, after))
        patterns = set()
        if len(left) > 1:
            patterns.add(("before", *left[-2:]))
        if len(right) > 1:
            patterns.add(("after", *right[:2]))
        if left and right:
            patterns.add(("both", left[-1], right[0]))
        instance = (kind, digits(s) if kind in ("card", "phone") else s.lower())
        out.append((kind, m.start(), m.end(), seed, instance, patterns))
    return out


def plain(rows, rounds=pii.ROUNDS):
    all_finds = [finds(t or "") for _, t in rows]
    holds = defaultdict(dict)
    for f in (f for fs in all_finds for f in fs):
        for p in f[5]:
            holds[p][f[4]] = holds[p].get(f[4], False) or f[3]
    scores = {}
    for _ in range(rounds):
        sure = {}
        for p, held in holds.items():
            for kind in KINDS:
                of = [(i, seed) for i, seed in held.items() if i[0] == kind]
                unknown = [i for i, seed in of if not seed]
                if not unknown:
                    continue
                gained = sum(scores.get(i, 0) for i in unknown)
                mass = 1000 * sum(seed for _, seed in of) + gained
                others = sum(seed for i, seed in held.items() if i[0] != kind)
                against = 1000 * others + pii.DOUBT * (1000 * len(unknown) - gained) // 1000 + 1000
                confidence = min(999, 1000 * mass // (mass + against))
                if mass >= 1000 * pii.LEAST_MASS and confidence >= pii.CONFIDENT:
                    sure[p, kind] = math.floor(-1e6 * math.log(1 - confidence / 1000))
        weight = defaultdict(int)
        for p, held in holds.items():
            for i, seed in held.items():
                if not seed and (p, i[0]) in sure:
                    weight[i] += sure[p, i[0]]
        scores = {i: math.floor(1000 * (1 - math.exp(-w / 1e6)) + 1e-6) for i, w in weight.items()}
    out = []
    for (doc, text), fs in zip(rows, all_finds):
        spans = base(text or "")
        added = [
            f[:3] for f in fs
            if not f[3] and scores.get(f[4], 0) >= pii.ACCEPT and not any(b < f[2] and f[1] < e for _, b, e in spans)
        ]
        write = lambda x: ",".join(f"{k}:{b}:{e}" for k, b, e in x)
        every = sorted([*spans, *added], key=lambda s: (KINDS.index(s[0]), *s[1:]))
        counts = [sum(s[0] == k for s in spans) for k in KINDS]
        out.append((doc, *counts, hashlib.sha256(write(spans).encode()).hexdigest(), write(every)))
    return out


CONTEXTS = ["please write to {} or come", "Call me on {}, any time", "from host {} port 22", "paid with card {} today", "see page {} of it", "the {} of the"]
TRAPS = [
    "a@b.c@d.e a@b", "x@y.z_w@v.u", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.0255", "4417 1234 5678 9113", "4417-1234-5678-9113 12",
    "44171234567891134", "+1 2 3 4 5 6 7 8 9 ", "+12345678+1234567890", "+1 (017) 555-7713.", "\x01a@b.cd\x02 \x01", "é🙂 a@b.cd 漢 1.1.1.1",
    "0" * 13, "+" * 40 + "1" * 9, "a." * 30 + "@b.c", "1 " * 30, "1-1-1-1-1-1-1-1-1-1-1-1-1-1", "fe80::1:2:3:4 12:30:45:10", "a at b.c", "call 10.0.0.1.",
]


def planted(seed=8):
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        d = num(15)
        return d + next(c for c in "0123456789" if luhn(d + c))

    known = [
        lambda: f"u{num(4)}@mail{num(1)}.example.com", lambda: f"+1 ({num(3)}) 555-{num(4)}",
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), card, lambda: num(8), lambda: num(r.randint(1, 20)),
    ]
    loose = [
        lambda: f"u{num(3)} (at) mail [dot] example.org", lambda: f"555-{num(4)}", lambda: f"10[.]0[.]{num(1)}[.]1",
        lambda: num(14), lambda: num(3), lambda: num(9),
    ]
    rows = []
    for i in range(160):
        k = r.randrange(6)
        value = (loose if r.random() < 0.25 else known)[k]()
        rows.append((1000 + i, "Some words first. " * r.randint(0, 3) + CONTEXTS[k].format(value)))
    # a known instance in one context, elsewhere without it; a second context learnt from the first
    lines = [f"444-777{i}" for i in range(6)]
    rows += [(2000 + i, f"Call me on {n}, any time") for i, n in enumerate(lines[:5] * 2)]
    rows += [(2100 + i, f"my old line {n} is off") for i, n in enumerate(lines)]
    rows += [(2200 + i, t) for i, t in enumerate(TRAPS)] + [(2300, " ".join(TRAPS))]
    rows += [(2400, "Call me on 333-9999, any time. " * 2000), (2401, "a@b" + ".c" * 5000), (2402, "7" * 20_000)]
    return rows


@pytest.fixture(scope="module")
def both(spark):
    rows = documents() + planted()
    return rows, [tuple(r) for r in pii.report(pii.find_personal_data(frame(spark, rows))).collect()], plain(rows)


def test_equals_plain_version(both):
    _, got, expected = both
    assert by_all(got) == by_all(expected)


def test_contexts_find_unseen_identifiers(both):
    rows, got, _ = both
    spans = {r[0]: r[6] for r in got}
    text = dict(rows)
    learnt = [d for d, t in text.items() if d and 1000 <= d < 2000 and re.search(r"\(at\)|on 555-|host 10\[", t)]
    assert len(learnt) > 10 and all(spans[d].count(":") == 2 for d in learnt)
    # the second round's pattern, from instances of the first
    assert spans[2105] == "phone:12:20"
    assert spans[2400].count("phone:") == 2000
    # a page number has no pattern of its own
    assert all(not spans[d] for d, t in text.items() if d and 1000 <= d < 2000 and re.search(r"page \d{8} ", t))


def test_base_formats_on_random_texts(spark):
    r = random.Random(11)
    rows = [(i, "".join(r.choice("01.2+- ()@ab_") for _ in range(r.randint(0, 80)))) for i in range(3000)]
    got = {x["doc_id"]: [(KINDS[s[0]], s[1], s[2]) for s in x["base"]] for x in pii.find_instances(frame(spark, rows, clash=False)).collect()}
    assert got == {i: base(t) for i, t in rows}


def test_nothing(spark):
    out = pii.report(pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")))
    assert out.count() == 0 and out.columns[-1] == "spans"
    none = pii.report(pii.find_personal_data(frame(spark, [(1, "Call me on 333-9999")]), rounds=0)).collect()
    assert none[0]["spans"] == ""


def test_no_python_in_the_plan(spark):
    out = pii.find_personal_data(frame(spark, planted()))
    found = pii.find_instances(frame(spark, planted()))
    for df in (out, found, pii.report(out), pii.accepted_instances(found)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|MapInArrow", plan)
