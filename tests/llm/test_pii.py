"""PII: base spans against the plain patterns, added spans, redaction."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        if not re.search({"email": "@", "ip": r"[0-9]\.[0-9]"}.get(kind, ""), text):  # else the plain pattern runs over each tail of a long word
            continue
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def spans(found):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def check(docs):
    want = sorted(
        str((r.doc_id, *[sum(k == kind for k, _, _ in b) for kind in PATTERNS], hashlib.sha256(spans(b).encode()).hexdigest()))
        for r in docs.collect() for b in [brute(r.text or "")]
    )
    got = pii.counted(pii.detect(docs)).collect()
    assert sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in got) == want
    base = {}
    for r in docs.collect():
        base.setdefault(r.doc_id, []).append({f"{k}:{s}:{e}" for k, s, e in brute(r.text or "")})
    assert all(any(b <= set(r.spans.split(",")) for b in base[r.doc_id]) or not any(base[r.doc_id]) for r in got)


@pytest.mark.parametrize("name", ["edge", "tiny", "nothing"])
def test_documents(request, name):
    check(request.getfixturevalue(name))


def test_random_texts(spark):
    draw = random.Random(9)
    pieces = ["1", "22", "4539", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "@", ".", "a.b", "x@y.zz", "_q", "+", "+1 (555) 555-1234", "-", " ", "  ", "10.0.0.1", "256.1.1.1",
              "1.2.3.4.5", "é", "\U0001f600", "\n", "(", ")", "token = \"abcdef0123456789abcdef\"", "a@b.c_d@e.f", "%", "0" * 30, "7" * 17]
    rows = [(i, "".join(draw.choice(pieces) for _ in range(draw.randint(0, 25)))) for i in range(1500)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_very_long_texts(spark):
    texts = ["9" * 300_000, "a" * 300_000, "a.b" * 100_000, "1." * 150_000, "+1 " * 60_000, "x@y" + ".z" * 100_000, "1 " * 100_000, "x@y.com " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = pii.candidates(docs).select("doc_id", pii.joined(F.col("base")).alias("base")).collect()
    assert {r.doc_id: r.base for r in base} == {i: spans(brute(t)) for i, t in enumerate(texts)}


def test_secrets_are_learned_and_redacted(spark):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(900):
        kind = i % 3
        middle = f'token = "{word(32)}"' if kind == 0 else f"build {word(32)} done" if kind == 1 else f"call +1 (555) 555-{draw.randint(1000, 9999)} or m{i}@mail.example.com"
        rows.append((i, f"some text here {middle} and more text"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = pii.detect(docs).cache()
    got = {r.doc_id: r.spans for r in pii.counted(found).collect()}
    assert sum("token:" in got[i] for i in range(0, 900, 3)) >= 280 and sum("token:" in got[i] for i in range(1, 900, 3)) <= 10
    clean = {r.doc_id: r.text for r in pii.redact(docs, found).collect()}
    assert clean[2] == "some text here call [phone] or [email] and more text"
    assert all("token = \"[token]\"" in clean[i] for i in range(0, 900, 3) if "token:" in got[i])


def test_each_kind_can_be_selected(spark):
    """Local phone and identity numbers and short secrets without digits are found, a long run of letters before a digit too."""
    draw = random.Random(6)
    digits = lambda n: "".join(draw.choice("123456789") for _ in range(n))
    letters = lambda n: "".join(draw.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for i in range(2400):
        middle = (
            f"call {digits(3)}-{digits(3)}-{digits(4)} now", f"part {digits(3)}-{digits(3)}-{digits(4)} now", f"password: '{letters(12)}' set", f"colour: '{letters(12)}' set",
            f"token = {letters(300)}{digits(4)}", f"build {letters(30)}{digits(4)} done", f"mail m{i}@mail.example.com, +1 (555) 555-{digits(4)}", f"at 10.0.{i % 256}.7 or card 4111 1111 1111 1111",
        )[i % 8]
        rows.append((i, f"some text here {middle} and more"))
    got = {r.doc_id: set(re.findall("[a-z]+(?=:)", r.spans)) for r in pii.counted(pii.detect(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).collect()}
    share = lambda kind, k: sum(kind in got[i] for i in range(k, 2400, 8)) / 300
    assert share("number", 0) > 0.9 and share("number", 1) < 0.05
    assert share("value", 2) > 0.9 and share("value", 3) < 0.05
    assert share("token", 4) > 0.9 and share("token", 5) < 0.05
    assert set().union(*got.values()) == set(pii.KINDS)


def test_native_plan(tiny):
    plan = pii.counted(pii.detect(tiny))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_redaction_tells_texts_of_one_id_apart(spark):
    rows = [(1, "call +1 415 555 0100 now"), (1, "write to some.body@example.com now"), (None, "see 10.0.0.1"), (None, "nothing here"), (1, "write to some.body@example.com now")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, text_hash long")
    clean = sorted((r.text for r in pii.redact(docs, pii.detect(docs)).collect()))
    assert clean == sorted(["call [phone] now", "write to [email] now", "write to [email] now", "see [ip]", "nothing here"])


def test_every_candidate_is_learned_from(spark, monkeypatch):
    """the trees see all candidates of all texts."""
    seen, fit = [], pii.fitted
    monkeypatch.setattr(pii, "fitted", lambda known, *rest: seen.extend(known.select("kind", "match").collect()) or fit(known, *rest))
    rows = [(i, f"see 10.0.0.1 and 300.1.1.{i % 7} " + "key='abcd' " * 30) for i in range(800)]
    pii.detect(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    kinds = {k: sum(r.kind == k for r in seen) for k in pii.KINDS}
    assert kinds["value"] == 24_000 and kinds["ip"] == 1_600
