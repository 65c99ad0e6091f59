import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from draftspark.llm import paragraphs as M
from draftspark.llm import textkit as K


def heights(words):
    """The values that cuts compare, word by word, by plain integers."""
    full = (1 << 64) - 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        return h ^ h >> 31

    data, offsets = K.utf8(pa.array(words, pa.binary()))
    h = K.hash_spans(data, offsets[:-1], np.diff(offsets)).tolist()
    out = [0] + [mix(mix(a) ^ b) for a, b in zip(h, h[1:])]
    k = 0
    for _, run in itertools.groupby(words):
        n = len(list(run))
        if n >= 12:
            for edge in (k, k + n):
                if edge < len(words):
                    out[edge] = 0
        k += n
    return out


def pieces(line):
    """(start, end, words) of the paragraphs of a line of bytes."""
    found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", line)]
    words = [bytes(line[a:b]).lower() for a, b in found]
    if len(words) < 12:
        return []
    cut = []
    if len(words) > 32:
        g, places = heights(words), range(10, len(words) - 9)
        for i in places:
            if all(g[j] > g[i] if j < i else g[j] >= g[i] for j in range(i - 9, i + 10) if j != i and j in places):
                cut.append(i)
    edges = [0, *cut, len(words)]
    return [(found[a][0] if a else 0, found[b][0] if b < len(words) else len(line), tuple(words[a:b])) for a, b in itertools.pairwise(edges)]


def brute(rows):
    found, ids = [], {}
    for n, (i, t) in enumerate(rows):
        for k, line in enumerate((t or "").encode().split(b"\n")):
            for a, b, w in pieces(line) if i is not None else ():
                found.append((n, i, (k, a, b), ids.setdefault(w, len(ids))))
    sets = [frozenset(w[j:j + 5] for j in range(len(w) - 4)) for w in ids]
    label, where = list(range(len(sets))), collections.defaultdict(list)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, s in enumerate(sets):
        near = collections.Counter(m for x in s for m in where[x])
        for m, both in near.items():
            if both / (len(s) + len(sets[m]) - both) >= 0.8 and root(m) != root(n):
                label[max(root(m), root(n))] = min(root(m), root(n))
        for x in s:
            where[x].append(n)
    low, gone, seen = {}, collections.defaultdict(dict), set()
    for _, i, _, p in found:
        low[root(p)] = min(low.get(root(p), i), i)
    for n, i, k, p in found:
        c = root(p)
        if low[c] != i or (n, c) in seen:
            gone[n][k] = low[c]
        seen.add((n, c))
    out = []
    for n, (i, t) in enumerate(rows):
        kept = []
        for k, line in enumerate((t or "").encode().split(b"\n")):
            spans = [(a, b) for m, a, b in gone[n] if m == k]
            rest = bytes(c for x, c in enumerate(line) if not any(a <= x < b for a, b in spans))
            if rest or not spans:
                kept.append(rest)
        out.append((i, len(gone[n]), sorted(set(gone[n].values())), b"\n".join(kept)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r["doc_id"], r["n_removed"], r["classes"], r["text"].encode()) for r in M.dedup_paragraphs(df).collect()), key=str)


def test_documents_match_brute_force(documents):
    assert run(documents) == brute([(r[0], r[1]) for r in documents.select("doc_id", "text").collect()])


def test_odd_rows(odd, empty):
    assert run(odd) == brute([(r[0], r[1]) for r in odd.select("doc_id", "text").collect()])
    assert run(empty) == []


def test_hot_keys_in_chunks(llm, monkeypatch):
    """Near copies in one class and false neighbours, over several chunks."""
    monkeypatch.setattr(M, "CHUNK", 12)
    monkeypatch.setattr(M, "PIVOTS", 2)
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rnd.randrange(0, 4)):
            words[rnd.randrange(80)] = f"v{rnd.randrange(1000)}"
        rows.append((i, "a short line\n" + " ".join(words)))
    assert run(llm.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_passages_inside_long_lines(llm):
    """A passage of 50 to 200 words is found wherever it stands in a line, clean
    documents stay whole; exactly what brute force over the same pieces gives."""
    rnd = random.Random(11)
    say = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    passages = [say(rnd.randrange(50, 201)) for _ in range(40)]
    rows = [(i, " ".join(say(rnd.randrange(0, 90)) + p + say(rnd.randrange(0, 90)))) for i, p in enumerate(passages)]
    rows += [(100 + i, " ".join(say(rnd.randrange(20, 300)) + p + say(rnd.randrange(20, 300)))) for i, p in enumerate(passages)]
    rows += [(200 + i, " ".join(say(400)) + "\nonly a short line that many hold\n" + " ".join(say(40))) for i in range(40)]
    rows += [(300, " ".join(say(30) + ["again"] * 500 + say(30))), (301, " ".join(say(40) + ["again"] * 77))]
    got = run(llm.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows)
    removed = {i: n for i, n, _, _ in got}
    assert sum(removed[100 + i] > 0 for i in range(40)) >= 38 and removed[301] == 1
    assert not any(removed[i] for i in range(40)) and not any(removed[200 + i] for i in range(40))


def test_pieces_cover_long_lines():
    rnd = random.Random(3)
    for n in (12, 32, 33, 40, 200, 3000):
        text = "  " + " ".join(f"x{rnd.randrange(50)}" if rnd.random() < 0.7 else "same" for _ in range(n)) + " "
        p = M.Paragraphs(*K.utf8(pa.array([text])))
        assert p.start[0] == 0 and p.end[-1] == len(text) and (p.start[1:] == p.end[:-1]).all()
        size = [len(text[a:b].split()) for a, b in zip(p.start, p.end, strict=True)]
        assert min(size) >= 10 and sum(size) == n and (len(size) == 1) == (n <= 32 or len(size) == 1)


def test_bands_have_the_recall_asked_for():
    bands, rows = M.tune()
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999
    assert (bands, rows) == (M.BANDS, M.ROWS)
    assert 1 - (1 - 0.3 ** rows) ** bands <= 0.15


@pytest.mark.parametrize("cut", [60, 100, 200])
def test_recall_at_the_threshold(cut, monkeypatch):
    """Pairs of similarity just over 0.8 collide in a band (lines of any length left whole)."""
    monkeypatch.setattr(M, "LONGEST", 10**9)
    rnd, hit = random.Random(cut), 0
    for k in range(60):
        words = [f"a{rnd.randrange(10**9)}" for _ in range(cut)]
        near = words[: int(cut * 0.9)]
        sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (words, near)]
        assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8
        p = M.Paragraphs(*K.utf8(pa.array([" ".join(words), " ".join(near)])))
        hit += bool(np.any(p.bands[0] == p.bands[1]))
    assert hit >= 59
