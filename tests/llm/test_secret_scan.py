import hashlib
import re

from llm.cases import DOCS, empty_frame, hard_docs, hard_frame
from parlance.llm.secret_scan import BASE, IDENTIFIERS, KINDS, SCOPE, SECRETS, scan_secrets, secret_digest


def brute(text):
    """All reported spans of a text, by Python's re and the gaps of all pairs."""
    text = text or ""
    found = []
    for kind, (pattern, group, least) in KINDS.items():
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(group)) >= least:
                found.append((m.start(), kind, m.end()))
    near = lambda x, kinds: any(k in kinds and max(a - x[2], x[0] - b) <= SCOPE for a, k, b in found)
    needs = {"ident": [SECRETS], "key": [IDENTIFIERS], "endpoint": [IDENTIFIERS, SECRETS]}
    keep = [x for x in found if x[1] in BASE or all(near(x, k) for k in needs[x[1]])]
    return sorted(keep, key=lambda x: (x[0], list(KINDS).index(x[1])))


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


CASES = [
    "password = hunter22 and token:abc",  # the second is too short
    "secret:token:abcdefgh",  # the failing match uses up the start
    "PassWd'  = \"x1/+=_.-\" Api_Key: abcdef apikey=zzzzzz",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "C AKIA" + "D" * 40,
    "0123456789abcdef01234567 " + "f" * 23 + " " + "0" * 60,
    "\U0001f600 é password: \U0001f600 password: secret1",
    "user=bob https://db.example.org/x " + "." * 100 + " password=letmein7",
    "user=bob " + " " * (SCOPE + 50) + "password=letmein7",
    "login: amy " + "x" * (SCOPE - 30) + " token=abcdef123",
    "A" * 36 + " " + "AKIA" + "Z" * 16 + " https://s3.example.com",
    "A" * 36 + " alone https://s3.example.com",
    "https://u.example.com user: me " + "0a1b" * 10,
    # the parts follow each other directly, however long one of them is
    "user: bob, token: " + "x1y2." * 120 + ", https://h.example.com/",
    "user: bob, token: " + "x1y2." * 120 + " " * (SCOPE - 1) + "https://h.example.com/",
    "user: bob, token: " + "x1y2." * 120 + " " * SCOPE + "  https://h.example.com/",
    "secret=https://u.example.com/user=bob",  # parts inside parts
    "token: abcdef1 " + "-" * 190 + " login: amy " + "+" * 190 + " https://h.example.com/",
]


def test_matches_brute_force(spark):
    texts = CASES + [" ".join(CASES), ("\n" * 300).join(CASES), ", ".join(CASES * 20)]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in secret_digest(scan_secrets(frame)).collect()}
    linked = 0
    for i, t in enumerate(texts):
        want = brute(t)
        base = [x for x in want if x[1] in BASE]
        assert got[i]["spans"] == told(want), t
        assert got[i]["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x[1] == k for x in want) for k in BASE]
        linked += got[i]["n_linked"]
    assert linked > 10


def test_hard_rows_and_empty_table(spark):
    got = secret_digest(scan_secrets(hard_frame(spark))).collect()
    assert len(got) == len(hard_docs())
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in hard_docs())
    assert all(r["spans"] == "" for r in got)
    assert secret_digest(scan_secrets(empty_frame(spark))).collect() == []
