import hashlib
import math
import random
import re

from tallylens.llm import pii as P

from .conftest import ODD_ROWS

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            x = m.group()
            digits = [int(c) for c in x if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in x.split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


HARD = [
    "a@b.com_x@c.org;d@e.f..g @x.y a@@b.c a@b. x@y.z-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0300.1.1.1 000255.0.0.01 1.2.3 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 4111  1111 12 0000000000000 5",
    "+1 (456) 555-2186. +12 +1 2 +123456789 +1234567890123456 ++1 22 33 44 55 6",
    "é😀 x@y.co 😀 10.0.0.1 ñ +34 600 111 222 call (212) 555-1234 or john [at] mail [dot] com",
    "9" * 20000,
    "a" * 60000 + "@",
    "1-" * 15000,
    "x@y.z " * 300,
]


def test_base_equals_plain_patterns(spark, odd):
    texts = HARD + [r[1] for r in ODD_ROWS] + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in P.digest(P.find_pii(docs)).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        want = plain(text)
        assert rows[k].base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), text and text[:80]
        assert [rows[k][f"n_{kind}"] for kind in P.KINDS] == [sum(w[0] == kind for w in want) for kind in P.KINDS]
        have = rows[k].spans.split(",") if rows[k].spans else []
        assert {joined([w]) for w in want} <= set(have)
        place = [(P.KINDS.index(h.split(":")[0]), int(h.split(":")[1])) for h in have]
        assert place == sorted(place)


def test_loose_spans_are_added(spark):
    text = "please call (212) 555-1234 or write to john.doe [at] mail [dot] com, server ip 2001:0db8:0000:0000:0000:ff00:0042:8329"
    docs = spark.createDataFrame([(1, text), (2, "write an email to a.b@mail.example.com or call +1 (212) 555-9876")], "doc_id long, text string")
    rows = {r.doc_id: r for r in P.digest(P.find_pii(docs)).collect()}
    assert rows[1].n_phone == rows[1].n_email == 0
    kinds = {x.split(":")[0]: text[int(x.split(":")[1]) : int(x.split(":")[2])] for x in rows[1].spans.split(",")}
    assert kinds["phone"] == "(212) 555-1234" and kinds["email"] == "john.doe [at] mail [dot] com"


def test_em_finds_the_unreliable_labeler():
    counts = []
    for votes, true, false in [((1, 1, 1), 400, 2), ((1, 1, -1), 380, 2), ((-1, -1, 1), 3, 300), ((-1, -1, -1), 3, 310), ((1, -1, 0), 30, 10)]:
        counts.append(("email", votes, 1, 0, 0, true + false))
    post = P.reliabilities([(c[0], c[1], c[-1]) for c in counts])
    assert post["email", (1, 1, -1)] > 0.9 > 0.1 > post["email", (-1, -1, 1)]
    weights = P.classifier(counts, post)["email"]
    value = lambda v: sum(weights[x] for x in P._places(v, 1, 0, 0))
    assert value((1, 1, -1)) > 1.5 and value((-1, -1, 1)) < -1.5


def test_reliabilities_equal_plain_em():
    """Against expectation-maximisation over single candidates instead of counted patterns."""
    random.seed(3)
    single = [tuple(random.choices((-1, 0, 1), (1, 2, 3) if t else (3, 2, 1))[0] for _ in range(3)) for t in (random.random() < 0.6 for _ in range(300))]
    belief = [1 / (1 + math.exp(-(0.5 + 1.5 * sum(v)))) for v in single]
    for _ in range(10):
        share = [1 + sum(1 - b for b in belief), 1 + sum(belief)]
        table = [[{x: 1.0 + (x == (1 if t else -1)) for x in (-1, 0, 1)} for _ in range(3)] for t in (0, 1)]
        for v, b in zip(single, belief, strict=True):
            for j, x in enumerate(v):
                table[0][j][x] += 1 - b
                table[1][j][x] += b
        chance = lambda t, v: share[t] * math.prod(table[t][j][x] / sum(table[t][j].values()) for j, x in enumerate(v))
        belief = [chance(1, v) / (chance(0, v) + chance(1, v)) for v in single]
    post = P.reliabilities([("ip", v, single.count(v)) for v in set(single)], rounds=10)
    assert all(abs(post["ip", v] - b) < 1e-9 for v, b in zip(single, belief, strict=True))


def test_candidates_with_contrary_context_are_rejected(spark):
    good = ["please call (212) 555-1234 today", "write to john.doe [at] mail [dot] com", "server ip 2a02:0db8:0000:0000:0000:ff00:0042:8329"]
    bad = ["order serial 212.555.0123", "the regex pattern a1 [at] b.png", "release version 1111:2222:3333:4444:5555:6666:7777:8888", "order id 1234 5678 9012 3456"]
    filler = [f"call +1 (212) 555-98{k:02d} or e-mail p{k}@mail.org from host 10.0.{k}.7, card 4111 1111 1111 1111; version 1.2.{k}.999 order +12 3, serial 4111 1111 1111 1112" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(good + bad + filler)), "doc_id long, text string")
    rows = {r.doc_id: r for r in P.digest(P.find_pii(docs)).collect()}
    assert all(rows[k].spans for k in range(len(good)))
    assert not any(rows[len(good) + k].spans for k in range(len(bad)))


def test_odd(spark, odd, empty):
    assert P.digest(P.find_pii(odd)).count() == len(ODD_ROWS)
    assert P.digest(P.find_pii(empty)).count() == 0
