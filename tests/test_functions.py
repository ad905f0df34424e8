import io
import zipfile

from hypothesis import given
from hypothesis import strategies as st

from mailloom.functions import mail, payload, tokens
from mailloom.functions.html import declared_charset, html_text
from mailloom.functions.rtf import rich_text


def test_html():
    assert html_text(b"no tags") == b"no tags"
    assert html_text(b"a<!-- > x -->b") == b"a b"
    assert html_text(b'<a title="x>y">link</a> tail') == b"link tail"
    assert html_text(b"1 <2 and <b>bold</b>").endswith(b"bold")
    assert html_text(b"<p>one</p><p>two<br>three") == b"\none\ntwo\nthree"
    assert html_text(b"<style>a{}<![CDATA[</style>]]></style><i>x</i>") == b"x"
    assert html_text(b'<p style="display: none">pre header</p><p>shown</p>') == b"[pre header]\nshown"
    assert html_text(b'<p>shown<span style="opacity:0">not</span> this') == b"\nshown this"
    assert html_text(b"<div>a</div><div class=x>b</div>") == b"\na b"
    assert declared_charset(b'<META http-equiv=x content="text/html; charset=ISO-8859-2">') == "iso-8859-2"


def test_headers():
    assert mail.decode_header("=?utf-8?q?caf=C3=A9?=") == "café"
    assert mail.decode_header("=?utf-8?B?w6k=?= =?utf-8?B?w6k?= tail") == "éé tail"
    assert mail.decode_header("=?utf-8?B?w6==?= x") is not None
    assert mail.split_address('"A, B" <a@b.c>') == ("a@b.c", "A, B")
    assert mail.split_address("a@b.c (Name)") == ("a@b.c", "(Name)")
    assert mail.split_address("nobody") == ("", "nobody")
    assert mail.decode_address("=?utf-8?q?a=40b=2Ec?=") == ("a@b.c", "")
    assert mail.untag("[SPAM] *****SPAM(7.5)***** hi") == "  hi"


NESTED = b"""From x
Subject: =?utf-8?q?h=C3=A9?=
\t[SPAM]
Content-Type: multipart/mixed; boundary="a b"

This is a MIME message.
--a b
Content-Type: multipart/alternative; boundary=i

--i
Content-Type: text/plain

plain text
--i
Content-Type: text/html; charset=utf-8
Content-Transfer-Encoding: quoted-printable

<p>r=C3=A9sum=C3=A9 that is long enough</p>
--i--
--a b
Content-Type: application/octet-stream; name="x.bin"
Content-Disposition: attachment
Content-Transfer-Encoding: base64

AAEC
--a b--
"""


def test_mime():
    for data in (NESTED, NESTED.replace(b"\n", b"\r\n")):
        root = mail.parse(data)
        found = mail.leaves(root)
        assert [(p.kind, at) for at, p in found] == [("text/plain", (0, 0)), ("text/html", (0, 1)), ("application/octet-stream", (1,))]
        assert found[2][1].payload == b"\x00\x01\x02" and found[2][1].name == "x.bin"
        subject, text = mail.best_text(root)
        assert subject.strip() == "hé" and text.strip() == "résumé that is long enough"
    assert mail.best_text(mail.parse(b"")) == (None, "")
    assert mail.best_text(mail.parse(b"Content-Type: message/rfc822\n\nSubject: x\n\nbody"))[1] == "body"
    missing = NESTED.replace(b"--a b--\n", b"")
    assert len(mail.leaves(mail.parse(missing))) == 3


def test_payloads():
    assert not payload.looks_utf8(b"ascii") and payload.looks_utf8("é".encode())
    assert payload.decode("árvíz".encode("iso8859-2"), "iso-8859-2") == "árvíz"
    assert payload.decode(b"x\xffy", "no-such-set") == "xÿy"
    assert payload.payload_text(b"BEGIN\nDESCRIPTION:one\\, two\\n\n three\nEND", "text/calendar") == "one, two\nthree"
    assert payload.payload_text(b"BEGIN", "text/calendar") == ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>a</w:t><w:tab/><w:t>b</w:t></w:p></w:document>')
    assert payload.payload_text(out.getvalue(), payload.WORD_TYPE) == "\na\nb"
    assert payload.payload_text(b"junk", payload.WORD_TYPE) == ""
    assert payload.payload_text(b"<html><body>x &amp; y</body>", "text/html") == "x & y"


def test_rich_text():
    assert rich_text(r"{\rtf1\ansicpg1250 \'e1r\u337?\par{\*\x hidden}{\fonttbl F}b\{}") == "árő\nb{"


@given(st.text())
def test_lossless_split(text):
    parts = tokens.split_lossless(text)
    assert "".join(parts) == text


def test_tokens():
    assert tokens.split_lossless("on 2024-01-05, ok")[1::2] == ["on", "2024-01-05", "ok"]
    assert tokens.hide_digits("Call 12-34a now!! Él_x") == ["call", "##", "##", "a", "now", "!", "elx"]
    assert tokens.hide_digits("a b", {"b"}) == ["b"]
    assert tokens.normalize("Ѕраm​  ﬁx") == "Spam fix"
    assert tokens.normalize("aé", {"a": "a"}, " ") == "a"
    assert [tokens.char_width(c) for c in "a字​\n"] == [1, 2, 0, -1]
    assert tokens.fit_width("字a\U0001f130") == "字​aA"


@given(st.text())
def test_normalize_twice(text):
    once = tokens.normalize(text)
    assert tokens.normalize(once) == tokens.normalize(tokens.normalize(once))
