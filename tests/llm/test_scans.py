"""Secrets and personal data against plain regular expressions."""

import base64
import hashlib
import json
import random
import re

import pytest

from quern.llm import pii, secrets

PII_RULES = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_pii(text):
    found = []
    for k, rule in enumerate(PII_RULES):
        for m in rule.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = (True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[k]
            if good:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def brute_secrets(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_pii_equals_rules(seed):
    rng = random.Random(seed)
    for _ in range(6000):
        text = "".join(rng.choice("0123456789.@+- ()ab%c1234é") for _ in range(rng.randint(0, 40)))
        assert [s for s in pii.pii_spans(text) if s[1] < 4] == brute_pii(text), text


@pytest.mark.parametrize("seed", range(4))
def test_secrets_equal_rules(seed):
    rng = random.Random(seed)
    parts = ["token", "secret", "API_KEY", "ToKen", "ſecret", "toKen", "=", ":", " ", "'", '"', "abc", "AKIA", "0123", "FF", "deadbeef", "ZZZZ", ".", "_", "PassWord", "\n"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == brute_secrets(text), text


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


PKCS1 = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([5 + i] * 70)) for i in range(8)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, PKCS1))
SEC1 = der(0x30, der(2, b"\1") + der(4, b"k" * 32) + der(0xA0, der(6, b"\x2a\x86\x48")))
SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"rest" * 8


@pytest.mark.parametrize(("data", "kind"), [(PKCS1, "der"), (PKCS8, "der"), (SEC1, "der"), (SSH, "ssh")])
def test_keys_are_confirmed(data, kind):
    for text in (base64.b64encode(data).decode(), base64.urlsafe_b64encode(data).decode().rstrip("=")):
        assert secrets.joined(secrets.confirmed_spans(f"é {text} end")) == f"{kind}:2:{2 + len(text)}"
    broken = base64.b64encode(data[:-3] if kind == "der" else data[4:]).decode()
    assert secrets.confirmed_spans(f"x {broken} end") == []


def test_hex_key_and_pem_and_token():
    assert secrets.confirmed_spans(PKCS8.hex())[0][1] == secrets.KINDS.index("der")
    pem = f"-----BEGIN PRIVATE KEY-----\n{base64.encodebytes(PKCS8).decode()}-----END PRIVATE KEY-----"
    assert secrets.KINDS.index("pem") in {k for _, k, _ in secrets.confirmed_spans(pem)}
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    good = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2ln"
    assert secrets.joined(secrets.confirmed_spans(good)) == f"jwt:0:{len(good)}"
    assert secrets.confirmed_spans(f"{part({'typ': 'JWT'})}.{part({'sub': 1})}.c2ln") == []


LOCKED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")) + der(0x30, b"")) + der(4, b"c" * 64))


def test_keys_in_other_places():
    key = base64.b64encode(PKCS8).decode().rstrip("=")
    for before in ("path/", "key_", "a-b-"):
        assert secrets.joined(secrets.confirmed_spans(f"{before}{key} end")) == f"der:{len(before)}:{len(before) + len(key)}"
    assert secrets.joined(secrets.confirmed_spans(f"x {SSH.hex()} y")) == f"ssh:2:{2 + len(SSH.hex())}"
    for data, kind in ((PKCS8, "der"), (SSH, "ssh"), (LOCKED, "der")):
        for end in ("\n", "\r\n", "\\n"):
            text = base64.encodebytes(data).decode().rstrip().replace("\n", end)
            assert secrets.joined(secrets.confirmed_spans(f"k: {text}\nprose{end}")) == f"{kind}:3:{3 + len(text)}", (kind, end)
    digest = der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201")) + der(5, b"")) + der(4, b"c" * 32))
    assert secrets.confirmed_spans(base64.b64encode(digest).decode()) == []


def test_locked_pem_and_spaced_token():
    for label, data in (("ENCRYPTED PRIVATE KEY", LOCKED), ("RSA PRIVATE KEY", b"Proc")):
        head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011\n\n" if data == b"Proc" else ""
        body = base64.encodebytes(bytes(range(64)) if head else data).decode()
        pem = f"-----BEGIN {label}-----\n{head}{body}-----END {label}-----"
        assert secrets.joined(secrets.confirmed_spans(pem)) == f"pem:0:{len(pem)}"
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    for header in (b'{ "alg": "HS256"}', b' {"alg":"HS256"}', b'{\n"alg":"none"}'):
        token = f"{part(header)}.{part(b'{}')}.c2ln"
        assert secrets.joined(secrets.confirmed_spans(f"a.{token}")) == f"jwt:2:{2 + len(token)}"


def test_scan_of_odd_documents(docs, no_docs):
    for r in secrets.scan_secrets(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        base = brute_secrets(r.text or "")
        assert r.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
    assert secrets.scan_secrets(docs).count() == docs.count()
    assert secrets.scan_secrets(no_docs).count() == 0


def test_pii_of_odd_documents(docs, no_docs):
    for r in pii.find_pii(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        base = brute_pii(r.text or "")
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
    assert pii.find_pii(docs).count() == docs.count()
    assert pii.find_pii(no_docs).count() == 0


def test_more_kinds_of_pii():
    text = "see https://bob:pa55@host.example/x and IBAN: DE89 3704 0044 0532 0130 00."
    kinds = [pii.KINDS[k] for _, k, _ in pii.pii_spans(text)]
    assert "login" in kinds and "iban" in kinds
    assert "iban" not in [pii.KINDS[k] for _, k, _ in pii.pii_spans("IBAN DE88370400440532013000 no")]


def test_redaction(docs):
    text = "a token = 'abcdefghijklmnop' b deadbeefdeadbeef c"
    assert secrets.redact_text(text) == "a [assign]' b [hex] c"
    assert secrets.redact_text("clean") == "clean"
    rows = {r.doc_id: r for r in secrets.redact_documents(docs).collect()}
    assert rows[0].text is None and rows[0].n_chars is None and rows[5].text == "The cat sat on the mat."
    assert rows[12].text == "[assign]' [access] [hex]" and rows[12].n_chars == len(rows[12].text)
