"""Keys and tokens in the forms that they have in prose, JSON and env files."""

import base64
import json
import time

import pytest

from millrace.llm import secrets


def _tlv(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


RSA = _tlv(0x30, _tlv(2, b"\0"), *(_tlv(2, bytes([1]) + b"\x11" * 63) for _ in range(8)))
SSH = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-rsa", b"\1\0\1", b"\7" * 257))
TOKEN = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":"1"}', b"s" * 32))
BODY = base64.b64encode(RSA).decode()
LINES = "\n".join(BODY[i : i + 64] for i in range(0, len(BODY), 64))
PEM = f"-----BEGIN RSA PRIVATE KEY-----\n{LINES}\n-----END RSA PRIVATE KEY-----\n"


def found(text, kind):
    return [text[a:b] for a, k, b in secrets.spans(text) if secrets.KINDS[k] == kind]


@pytest.mark.parametrize("text", [f"Use {TOKEN}. Then", f"Use {TOKEN}.", f"({TOKEN}...)", json.dumps({"t": f"a\n{TOKEN}"})])
def test_token_at_a_sentence_end(text):
    assert found(text, "jwt") == [TOKEN]


def test_no_token_of_more_parts():
    assert found(f"{TOKEN}.more", "jwt") == []


@pytest.mark.parametrize("text", [json.dumps({"private_key": PEM}), json.dumps(json.dumps(PEM)), f'KEY="{PEM}"'.replace("\n", r"\n"), PEM.replace("\n", r"\r\n"), json.dumps(PEM).replace("/", r"\/")])
def test_pem_with_escaped_breaks(text):
    (span,) = found(text, "pem")
    assert span.startswith("-----BEGIN") and span.endswith("KEY-----") and found(text, "der") == []


@pytest.mark.parametrize("width", [40, 64, 76])
@pytest.mark.parametrize("joint", ["\n", "\r\n", "\n    ", r"\n"])
@pytest.mark.parametrize(("key", "kind"), [(RSA, "der"), (SSH, "ssh")])
def test_wrapped_base64(key, kind, width, joint):
    body = base64.b64encode(key).decode()
    folded = joint.join(body[i : i + width] for i in range(0, len(body), width))
    for text in (folded, f"key: {folded}{joint}Then more words", f"some words{joint}{folded} end", f"{'x' * 20}{joint}{folded}{joint}{folded}"):
        assert set(found(text, kind)) == {folded}


def test_wrapped_words_are_no_key():
    body = base64.b64encode(b"0" + b"just some words that are no key " * 9).decode()
    assert secrets.spans("\n".join(body[i : i + 64] for i in range(0, len(body), 64))) == []


def test_wrapped_lines_take_no_square_time():
    line = "M" + "A" * 63
    text = "\n".join([line] * 20_000)
    start = time.process_time()
    assert secrets.wrapped(text) == [] and time.process_time() - start < 20
