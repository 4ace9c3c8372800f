from __future__ import annotations

import base64
import bz2
import gzip
import lzma
import re
import urllib.parse
import zlib

from tests.llm.conftest import corpus
from tillgrain.llm.secrets import all_spans, base_spans, find_secrets, joined

KEY = "0123456789abcdef0123"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def spans(text):
    return all_spans(text, base_spans(text))


def extra(text):
    return [s for s in spans(text) if s not in base_spans(text)]


def test_base_patterns_follow_the_plain_rules():
    for text in [
        'api_key = "abcdefghijkl"', "PassWord:short token=abcdefghijkl", "token:password:abcdefghijklmnop",
        "AKIAABCDEFGHIJKLMNO AKIA123", f"x{KEY}Y{KEY[:15]} ſecret=abcdefghijklm", "secret = = abcdefghijklmn",
    ]:
        want = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        kinds = ["assign", "access", "hex"]
        assert base_spans(text) == sorted(want, key=lambda s: (s[1], kinds.index(s[0])))


def test_layers_are_unwrapped_and_mapped():
    plain = f"see token={KEY} there"
    for wrapped in (
        urllib.parse.quote(plain, safe=""),
        "".join(f"\\u{ord(c):04x}" for c in plain),
        "".join(f"&#{ord(c)};" for c in plain),
        base64.b64encode(plain.encode()).decode(),
        base64.urlsafe_b64encode(gzip.compress(plain.encode())).decode(),
        urllib.parse.quote(urllib.parse.quote(base64.b64encode(plain.encode()).decode(), safe=""), safe=""),
        base64.b64encode(gzip.compress(base64.b64encode(plain.encode()))).decode(),
    ):
        text = f"before {wrapped} after"
        assert {kind for kind, _, _ in spans(text)} == {"assign", "hex"}, wrapped
        assert "assign" in {kind for kind, _, _ in extra(text)}
        for _, start, end in extra(text):
            assert 7 <= start < end <= 7 + len(wrapped)


def test_escapes_map_to_the_characters_they_come_from():
    text = "xx tok%65n=" + KEY + " yy"
    assert ("assign", 3, 3 + len("tok%65n=") + len(KEY)) in extra(text)


def test_an_escape_on_one_side_of_a_space_is_enough():
    for text in ("pass%77ord = hunter2hunter2", "api&#95;key: abcdefghijklmnop", r"\u0022token\u0022: \u0022abcdefghijkl", "token = abc%zz 100% tok\\x65n : abcdefghijklmnop"):
        assert "assign" in {kind for kind, _, _ in extra(text)}, text
    assert extra("pass%77ord = hunter2hunter2") == [("assign", 0, 27)]
    assert "assign" in {kind for kind, _, _ in extra("password: tok%65n:hunter2hunter2")}


def test_compressed_data_is_unwrapped_to_a_fixpoint():
    plain = f"see token={KEY} there".encode()
    twice = gzip.compress(zlib.compress(plain))
    for data in (twice, *(f(b"nothing here ") + f(plain) for f in (gzip.compress, bz2.compress, lzma.compress))):
        for wrapped in (
            base64.b64encode(data).decode(),
            base64.encodebytes(data).decode(),
            urllib.parse.quote_from_bytes(data, safe=""),
            "".join(f"\\x{b:02x}" for b in data),
        ):
            text = f"before {wrapped} after"
            assert {kind for kind, _, _ in extra(text)} == {"assign", "hex"}, wrapped
            assert all(7 <= start < end <= 7 + len(wrapped) for _, start, end in extra(text))


def test_base64_in_lines_or_glued_to_words():
    plain = b"some words before it, so that lines are needed: " * 2 + f"token={KEY} there".encode()
    for size in (64, 76):
        code = base64.b64encode(plain).decode()
        lines = "\r\n".join(code[i : i + size] for i in range(0, len(code), size))
        assert "assign" in {kind for kind, _, _ in extra(f"x {lines} y")}
    code = base64.b64encode(f"token={KEY}\0\x01".encode()).decode()
    for before in ("/v1/blob/", "x_", "a/", "ab-", "abc", ""):
        assert "assign" in {kind for kind, _, _ in extra(before + code)}, before


def test_cycles_and_junk_end():
    assert spans("%25" * 50) == []
    assert spans("\\u0025" * 20 + "%zz &#xFFFFFFF; \\u{110000} \\ud800 AAAAAAAAAAAAAAAAAAAAAAAA====") is not None
    assert spans("") == []


def test_documents(make_docs):
    wrapped = base64.b64encode(f"password: {KEY}".encode()).decode()
    rows = [*corpus(9), (3000, f"é {wrapped}", None, None), (3001, f"token = {KEY}", None, None)]
    found = {r.doc_id: r for r in find_secrets(make_docs(rows)).collect()}
    assert len(found) == len({i for i, *_ in rows})
    for i, text, *_ in rows:
        assert found[i].spans == joined(spans(text or ""))
    assert (found[3001].n_assign, found[3001].n_hex) == (1, 1)
    assert found[3000].n_assign == 0 and "assign:" in found[3000].spans
    assert find_secrets(make_docs([])).isEmpty()


def test_long_compressed_layers_are_scanned_to_their_end():
    import zstandard

    filler = b"nothing to see here. " * 3_400_000  # 71 MB
    secret = f" token={KEY} ".encode()
    for packed in (gzip.compress(filler + secret, 1), zstandard.ZstdCompressor(level=1).compress(filler + secret), bz2.compress(filler[:9_000_000] + secret, 1)):
        text = "data " + base64.b64encode(packed).decode() + " end"
        assert {kind for kind, _, _ in extra(text)} == {"assign", "hex"}
        for _, start, end in extra(text):
            assert 5 <= start < end <= len(text) - 4


def test_a_frame_that_claims_much_takes_little_memory():
    import resource

    import zstandard

    bomb = zstandard.ZstdCompressor(level=1).compress(bytes(200_000_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert extra("x " + base64.b64encode(bomb).decode()) == []
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150_000


def test_windows_cover_members_and_truncated_data(monkeypatch):
    from tillgrain.llm import secrets

    monkeypatch.setattr(secrets, "WINDOW", 100)
    monkeypatch.setattr(secrets, "OVERLAP", 40)
    content = bytes(range(1, 200)) * 5
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        for data in (pack(content), pack(content[:500]) + pack(content[500:]), pack(content) + b"xx"):
            windows = [(a, b, w) for a, b, w in secrets._inflated(b"??" + data) if a == 2]
            assert {(a, b) for a, b, _ in windows} == {(2, 2 + len(data.removesuffix(b"xx")))}
            joined_ = windows[0][2] + b"".join(w[40:] for _, _, w in windows[1:])
            assert joined_ == content
    cut = gzip.compress(content)[:-3]
    assert b"".join(w for _, _, w in secrets._inflated(cut))[:100] == content[:100]
    assert [w for _, _, w in secrets._inflated(b"x^2 + y^2, \x78\x9c no data, BZh9 neither")] == []
