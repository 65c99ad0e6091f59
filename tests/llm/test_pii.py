import re

import pytest

from draftspark.llm import pii as M

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "phone" and 9 <= len(digits) <= 15 \
                    or kind == "card" and 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0:
                out.append((kind, *m.span()))
    return out


TRICKY = ["a@b.c@d.e", "a@@b.co", "x.y@z.com.", "@a.b", "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "001.002.003.004", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112",
          "+1 (269) 555-3296 4524132264652876", "+12", "+1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", "é a@b.co é 1.2.3.4", "\U0001F389 a@b.co", "a" * 3000 + "@b.co", "1" * 5000, "a@b.co" * 50]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert M.identifiers(text) == brute(text)


@pytest.mark.parametrize("text,kind,found", [
    ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"), ("mail bob AT mail DOT example DOT com ok", "email", "bob AT mail DOT example DOT com"),
    ("j(at)example(dot)org", "email", "j(at)example(dot)org"), ("x @ example . com", "email", "x @ example . com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("jane@​example.com", "email", "jane@​example.com"),
    ("ip 192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1"), ("at 10 dot 0 dot 0 dot 1 there", "ip", "10 dot 0 dot 0 dot 1"),
    ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("call plus one five five five one two three four five six seven please", "phone", "plus one five five five one two three four five six seven"),
    *[(f"bob at acme dot {e} or call", "email", f"bob at acme dot {e}") for e in ("ca", "it", "nl", "pl", "jp", "in", "br", "dev", "co dot uk")],
    ("ana arroba casa punto br", "email", "ana arroba casa punto br"),
    ("on +1 555 five five 0199 now", "phone", "+1 555 five five 0199"), ("plus one (555) double five 0199 22", "phone", "plus one (555) double five 0199 22"),
    ("ip 192 dot 168 dot one dot 4", "ip", "192 dot 168 dot one dot 4"), ("4111 one one 11 1111 1111", "card", "4111 one one 11 1111 1111"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ("é vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins")])
def test_disguises(text, kind, found):
    base, added = M.find_spans(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in added] == [(kind, found)]


@pytest.mark.parametrize("text", ["look at the dot on the page", "one two three go", "we meet at home. come on", "a point at which two or three", "é à la une deux trois quatre fois", "zero to one hundred", "at this point in time", "look at the dot in it", "we met at noon dot or dot", "4 five 6", "chapter 2 one of 30 or 4 two"])
def test_clean_texts(text):
    assert M.find_spans(text) == ([], [])


@pytest.mark.parametrize("text,found", [("ask john.doe at example.com today", "john.doe at example.com"), ("ask jane@example . com today", "jane@example . com"),
                                        ("ask jane@mail. example.com today", "jane@mail. example.com"), ("ask jane\tARROBA\tmail.example .org today", "jane\tARROBA\tmail.example .org")])
def test_disguises_without_other_marks(text, found):
    base, added = M.find_spans(text)
    assert [(k, text[a:b]) for k, a, b in added] == [("email", found)]


def generated():
    ats = [f"{a}{w}{b}" for w in ("@", "[at]", "( AT )", "<@>") for a in ("", " ", "\t") for b in ("", " ")] + [f"{a}{w}{b}" for w in ("at", "At", "ät", "Ät", "arroba", "AROBASE") for a in " \t" for b in (" ", "\t ")]
    dots = [f"{a}.{b}" for a in ("", " ", "\t") for b in ("", " ", "\t")] + [" dot ", " DOT ", "\tpunkt\t", " point ", " po\u0130nt ", "[dot]", " ( . ) "]
    for at in ats:
        for dot in dots:
            for host in (f"example{dot}com", f"mail{dot}example.org", f"mail.example{dot}IO", f"example{dot}\u0130o", f"mail{dot}example{dot}nowhere"):
                yield f"Ask jo.doe{at}{host} or call. "
    for sep in (" ", "-", " - ", ", ", "\t", " . ", ".", " dot ", "[.]"):
        for words in ("one nine two one six", "(five five five five)", "double one triple two six seven", "f\u0130ve six nine f\u0130ve", "plus ACHT neun zehn", "un deux trois quatre"):
            yield f"is {sep.join(words.split(' '))}!"
    for sep in (" ", "-", " - ", "\t", ".", " dot ", "[.]", ") (", ") ", " ("):
        for words in ("+1 555 five 0199 2233", "+49 one 555 double five 0199 22", "1 two 3 four", "192 one 1 zero", "plus one 555 0199 22 five"):
            yield f"is {sep.join(words.split(' '))}!"
    yield from ("10 dot 0 dot 0 dot 1", "10\tpunkt 0 point 0 punto 1", "10[.]0{dot}0<.>1", "we meet at home. come on", "a@b.co. Com", "a@b.co")


def test_gate_hides_nothing(monkeypatch):
    texts = list(generated())
    gated = [M.find_spans(t) for t in texts]
    monkeypatch.setattr(M, "disguised", lambda text: True)
    assert [t for t, got in zip(texts, gated, strict=True) if got != M.find_spans(t)] == []


def test_documents_and_odd_rows(documents, odd, empty):
    for df in (documents, odd):
        for r in M.find(df).select("row.text", "spans").collect():
            assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == brute(r["text"])
    assert M.find(empty).count() == 0
