import hashlib
import math
import random
import re
import string
import time

import numpy as np
from profilescope.llm import secrets
from profilescope.llm.secrets import find_secrets, op5, redact

from .conftest import words

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
TEXTS = [
    "Token: token: abcdefgh1 secret=secret=abcdefgh API_KEY = 'A.b+c/d=e' password=short passwd:12345678",
    "AKIAAKIA12345678 AKIA123 xAKIAABCDEFGHIJKL0 AKIAABCDEFGHIJKLä",
    "0123456789abcdef0123456789abcdef0 \U0001f600 ffffffffffffffffffffffffffffffff\nDEADBEEF" * 2,
    "\U0001f600 é password = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"",
    None,
    "",
    "plain words only",
]


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_known_forms_match_definition(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in op5(docs).collect():
        spans = base(TEXTS[r["doc_id"]])
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in spans) for n in range(3)]


def test_random_strings_are_found_and_words_are_not(spark):
    rng, rows, random_ids = random.Random(6), [], set()
    alphabet = string.ascii_letters + string.digits
    for i in range(300):
        text = words(i, 20)
        if i % 5 == 0:
            text += " " + "".join(rng.choice(alphabet) for _ in range(40)) + " end"
            random_ids.add(i)
        if i % 7 == 1:
            text += " internationalization2024update aaaaaaaaaaaaaaaaaaaaaaaa1111111111111111 abcdefghijklmnopqrstuvwxyz0123456789"
        rows.append((i, text))
    found = {r["doc_id"]: r["n_random"] for r in op5(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = {i for i, n in found.items() if n}
    assert len(hits & random_ids) >= 0.6 * len(random_ids)
    assert len(hits - random_ids) <= 0.15 * len(hits)


def test_few_random_strings_are_found_too(spark):
    """Fewer than a class needs for its own estimate, without digits, and behind readable words."""
    rng = random.Random(3)

    def key(n, alphabet=string.ascii_letters + string.digits):
        return "".join(rng.choice(alphabet) for _ in range(n))

    def marked(before, secret, after=""):
        return f"see {before}{secret}{after} .", (4 + len(before), 4 + len(before) + len(secret))

    made = [marked("", key(80)), marked("", key(40, string.ascii_letters)), marked("customer_identification_number=", key(24))]
    made += [marked("/articles/of/the/general/overview/", key(33), "/summary/of/contents")]
    rows = [(i, text) for i, (text, _) in enumerate(made)]
    rows += [(i, "the internationalization of getElementByIdentifier in /usr/share/documentation/of/packages") for i in (10, 11)]
    got = {r["doc_id"]: r["secrets"] for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [[(s["start"], s["end"]) for s in got[i]] for i in range(len(made))] == [[span] for _, span in made]
    assert got[10] == got[11] == []


def p_of(token):
    """The combined p-value of a token by numpy, from the definition of the three statistics."""
    digits, lower, upper = string.digits, string.ascii_lowercase, string.ascii_uppercase
    smallest = [digits + "abcdef", digits + "ABCDEF", upper + "234567", digits + lower, digits + upper, digits + lower + upper]
    alphabet = next((a for a in smallest if set(token) <= set(a)), digits + lower + upper + "+/_=-")
    n, k = len(token), len(alphabet)
    codes = np.array([alphabet.index(c) + 1 for c in token], dtype=float)
    kind = lambda c: "d" if c in digits else "l" if c in lower else "u" if c in upper else "o"
    shares = np.array([sum(kind(c) == x for c in alphabet) / k for x in "dluo"])
    s2, s3 = (shares**2).sum(), (shares**3).sum()
    counts = np.bincount(codes.astype(int), minlength=k + 1)[1:]
    chi = ((counts**2).sum() * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    equal = sum(kind(a) == kind(b) for a, b in zip(token, token[1:], strict=False))
    runs = (equal - (n - 1) * s2) / math.sqrt((n - 1) * s2 * (1 - s2) + 2 * (n - 2) * (s3 - s2 * s2))
    centred = codes - (k + 1) / 2
    serial = (centred[1:] * centred[:-1]).sum() * 12 / ((k * k - 1) * math.sqrt(n - 1))
    return min(1.0, 3 * min(math.erfc(abs(z) / math.sqrt(2)) for z in (chi, runs, serial)))


def test_statistics_match_numpy(spark):
    rng = random.Random(12)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase + "019", "aB3/_x=-+"]
    tokens = ["".join(rng.choice(a) for _ in range(rng.randrange(16, 90))) + "zZ"[: i % 3] for a in alphabets for i in range(12)]
    tokens += ["a" * 20, "ab" * 30, "abcdefghijklmnopqrstuvwxyz", "Q" * 16 + "7"]
    rows = list(enumerate(tokens))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = 0
    for r in secrets.scan(docs, ["doc_id"]).collect():
        token = tokens[r["_document"]["doc_id"]]
        for c in r["_tested"]:
            assert abs(c["p"] - p_of(token[c["start"] : c["end"]])) < 0.002, token
            seen += 1
    assert seen > len(tokens)


def test_one_token_of_a_megabyte(spark):
    rng = random.Random(5)
    whole = "".join(rng.choices(string.ascii_letters + string.digits, k=1_000_000))
    docs = spark.createDataFrame([(1, f"see {whole} end"), (2, f"data:{whole[:300_000]}")], "doc_id long, text string")
    began = time.time()
    got = {r["_document"]["doc_id"]: r["_tested"] for r in secrets.scan(docs, ["doc_id"]).collect()}
    assert time.time() - began < 60
    assert [(c["start"], c["end"]) for c in got[1]] == [(4, 1_000_004)] and abs(got[1][0]["p"] - p_of(whole)) < 0.002


def test_many_spans_in_one_text(spark):
    parts = [f"token={i:09d} {i:032x} AKIA{i:016d} wort" for i in range(4000)]
    text = "\n".join(parts)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = op5(docs).first()
    assert [r["n_assign"], r["n_access"], r["n_hex"]] == [4000] * 3
    spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base(text))
    assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    clean = redact(docs).first()["text"]
    assert clean.count("[SECRET]") == 12_000 and clean.count("wort") == 4000
    assert time.time() - began < 120


def test_redaction(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars long")
    for r in redact(docs).collect():
        text, spans = TEXTS[r["doc_id"]], base(TEXTS[r["doc_id"]])
        if not spans:
            assert (r["text"], r["n_chars"]) == (text, 7)
            continue
        out, at = "", 0
        for a, _, b in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r["text"] == out + text[at:] and r["n_chars"] == len(r["text"])


def test_odd_documents(odd, odd_rows, none):
    found = find_secrets(odd)
    assert found.columns == [*odd.columns, "secrets"] and found.count() == len(odd_rows)
    assert redact(odd).columns == odd.columns
    assert {r["_text"] for r in redact(odd).collect()} == {"clash"}
    assert {r["spans"] for r in op5(odd).collect()} == {""}
    assert op5(none).count() == 0 and redact(none).count() == 0
