from __future__ import annotations

import base64
import hashlib
import re
import time

from cadenza.llm import secrets
from tests.llm.helpers import documents, empty, odd

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_are_those_of_plain_scans(spark, sf_dir):
    texts = dict(documents(spark, sf_dir).select("doc_id", "text").collect())
    rows = secrets.op2_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = base(texts[r.doc_id] or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in found) for n in range(3))


def test_keywords_within_values_hits_that_fail_and_odd_letters():
    keywords = secrets.automaton()
    for text in ["password=token=abcdef", "token=abc token=abcdefg", "API_KEY : 'abcdef", "İ secret: abcdef12", "AKIAAKIA" + "A" * 14, "passwd passwd=abcdef", "ſecret=abcdef", "secretsecret=abcdefgh", "a" * 30 + "g" + "0" * 24]:
        assert [s for s in secrets.find(text, keywords) if s[1] < 3] == base(text), text


def test_checksums_and_structure_decide():
    keywords = secrets.automaton()
    body = "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1"
    good = "ghp_" + body + secrets.crc_base62(body)
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    assert [s[1] for s in secrets.find(f"x {good} y", keywords)] == [3]
    assert secrets.find(f"x {good[:-1]}{'0' if good[-1] != '0' else '1'} y", keywords) == []
    assert [secrets.KINDS[s[1]] for s in secrets.find(f"npm_{body}{secrets.crc_base62(body)} {head}.eyJh.sig -----BEGIN RSA PRIVATE KEY-----\nabc=\n-----END RSA PRIVATE KEY-----", keywords)] == ["npm", "jwt", "pem"]
    assert secrets.find("eyJub3Q.eyJh.sig", keywords) == []


def test_odd_rows(spark):
    assert {r.doc_id: len(r.spans) for r in secrets.scan(odd(spark)).collect()} == dict.fromkeys([1, 2, None, 3, 4, 5, 6, 7, 8, 9], 0)
    assert secrets.scan(empty(spark)).count() == 0


def _part(said):
    return base64.urlsafe_b64encode(said.encode()).decode().rstrip("=")


def test_heads_that_are_no_objects_and_deep_ones():
    keywords = secrets.automaton()
    tail = "." + _part('{"x":1}') + ".sig"
    assert secrets.find(_part('{"a":' + "[" * 100_000) + tail, keywords) == []
    assert secrets.find(_part('["alg"]') + tail, keywords) == [] and secrets.find(_part('"alg"') + tail, keywords) == []
    token = _part('{"alg":"none"}') + tail
    assert secrets.find(f"x {token} {token}", keywords) == [(2, 5, 2 + len(token)), (3 + len(token), 5, 3 + 2 * len(token))]
    key = "-----BEGIN EC PRIVATE KEY-----\nab+/=\n-----END EC PRIVATE KEY-----"
    assert secrets.find(f"-----BEGIN PRIVATE KEY-----\nab ? {key}", keywords) == [(33, 6, 33 + len(key))]


def test_long_texts_take_time_by_their_length():
    keywords = secrets.automaton()
    texts = ["eyJ" * 350_000, "eyJ" * 200_000 + ".eyJ" + "eyJ" * 150_000, "eyJa." * 200_000, "-----BEGIN PRIVATE KEY-----\n" * 40_000, "-----BEGIN PRIVATE KEY-----" + "-----END " * 110_000, "-----BEGIN " + "A " * 500_000, "password" + " " * 1_000_000, "password " * 110_000, "token=" * 170_000, "AKIA" * 250_000, "0f" * 500_000]
    for text in texts:
        began = time.process_time()
        found = [s for s in secrets.find(text, keywords) if s[1] < 3]
        assert time.process_time() - began < 8, text[:40]
        assert found == base(text)
