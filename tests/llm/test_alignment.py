"""Alignment against both libraries on whole texts, fragments against each other in any bracketing."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from gramwise.llm import alignment
from gramwise.llm.queries import BYTE_LEVEL, PIECES
from tests.llm.conftest import TEXTS

PAIR = alignment.Pair.of(BYTE_LEVEL, PIECES)
ODD = [
    "", None, " ", "  ", "a", " leading", "trailing  ", "two  spaces\n and\nlines \t tab", "<|endoftext|> <s> </s> <unk> <0x41>", "x▁y spoils", "▁", "nul\x00 in \x01 it", " no break 　 wide   em",
    "日本語のテキストは空白がない" * 40, "🙂🙃 é Größe naïve\r\nline\r", "don't we'll '  '", "x" * 900, "ab " * 700, "\n\n\n ", "word\x1c word\x85 word",
]


def plain(rows):
    """{id: columns} by whole texts."""
    tokens, links = {}, {}
    for i, text in rows:
        text = text or ""
        raw = (" " + text).encode()
        a = PAIR.a.encode(" " + text, add_special_tokens=False).ids
        b = PAIR.b.encode(text)
        if not text or b"".join(PAIR.a_bytes[x] for x in a) != raw or b"".join(PAIR.b_bytes[x] for x in b) != raw:
            a = b = []
        spans = []
        for ids, table in ((a, PAIR.a_bytes), (b, PAIR.b_bytes)):
            at, own = 0, []
            for x in ids:
                own.append((at, at + len(table[x]), x))
                at += len(table[x])
            spans.append(own)
        ends = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        groups = []
        for own in spans:
            parts, now = [], []
            for _, e, x in own:
                now.append(str(x))
                if e in ends:
                    parts.append(",".join(now))
                    now = []
            groups.append(parts)
        tokens[i] = (len(a), len(b), len(ends), ";".join(f"{x}|{y}" for x, y in zip(*groups, strict=True)))
        found, k = [], 0
        for s, e, x in spans[0]:
            while k and spans[1][k - 1][1] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][1] <= s:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][0] < e:
                found.append((x, spans[1][m][2]))
                m += 1
        links[i] = found
    counts = Counter(p for found in links.values() for p in set(found))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return {i: (na, nb, ng, len(links[i]), sum(counts[p] == best[p[0]] for p in links[i]), sum(counts[p] for p in links[i]), sha256(text.encode()).hexdigest() if na else "") for i, (na, nb, ng, text) in tokens.items()}


@pytest.mark.parametrize("size", [alignment.RANGE, 40, 7])
def test_against_whole_texts(spark, size):
    rows = [(i, t) for i, t, *_ in TEXTS] + [(100 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, words string, seq int").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(df, BYTE_LEVEL, PIECES, size=size).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("size", [alignment.RANGE, 500])
def test_sample(spark, sample_df, sample, size):
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(sample_df, BYTE_LEVEL, PIECES, size=size).collect()}
    assert got == plain(sample)


def test_odd_and_empty_tables(odd, empty):
    rows = sorted(map(tuple, alignment.align(odd, BYTE_LEVEL, PIECES, size=6).collect()), key=str)
    want = plain([(0, "same text of a row"), (1, "same text of a row"), (2, "same text of a row"), (3, "another"), (4, None)])
    assert rows == sorted([(None, *want[0]), (5, *want[1]), (5, *want[2]), (5, *want[3]), (None, *want[4])], key=str)
    assert alignment.align(empty, BYTE_LEVEL, PIECES).count() == 0


def fragments(text, size, rng):
    """The fragments of a text at any offsets."""
    (a,), (b,), ok = PAIR.encode([" " + text])
    raw = (" " + text).encode()
    borders = [0, *sorted(rng.sample(range(1, len(raw)), min(size, len(raw) - 1))), len(raw)]
    return [alignment.partial(PAIR, " " + text, low, high, i)[0] for i, (low, high) in enumerate(zip(borders, borders[1:], strict=False))]


def test_composing_is_associative():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["un", "believ", "able ", "日本", "'s ", "12345", "xq", ", "]) for _ in range(rng.randint(2, 12)))
        parts = fragments(text, rng.randint(1, 9), rng)
        unit = alignment.Fragment()

        def tree(x):
            if len(x) == 1:
                return x[0]
            k = rng.randint(1, len(x) - 1)
            return alignment.composed(PAIR, tree(x[:k]), tree(x[k:]))

        one, two = tree(parts), tree([unit, *parts, unit])
        left = parts[0]
        for p in parts[1:]:
            left = alignment.composed(PAIR, left, p)
        assert one == two == left
        whole = alignment.finished(PAIR, one)
        assert whole.suffix == ((), ())
        (a,), (b,), _ = PAIR.encode([" " + text])
        g = alignment.groups_of(np.cumsum(PAIR.a_len[a]), np.cumsum(PAIR.b_len[b]))
        assert whole.n == (len(a), len(b), len(g.a_starts) - 1, len(g.link_a))


def test_ranges_cut_no_long_word():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", " ", "  ", "bcd ", "\n", "語語語語", "  ", "x" * 30 + " "]) for _ in range(rng.randint(1, 60)))
        raw = b" " + text.encode()
        found = alignment.ranges(text, rng.choice([3, 8, 20]))
        assert [x[0] for x in found] == list(range(len(found)))
        at = 0
        for _, before, after, words in found:
            own = words.encode()
            assert raw[at - before : at - before + len(own)] == own and words[0] == " "
            at += len(own) - before - after
        assert at == len(raw)


def test_hot_pair_and_long_texts(spark):
    rows = [(i, "the the the " * 3000) for i in range(40)] + [(99, "y" * 300_000), (100, "the " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(df, BYTE_LEVEL, PIECES, size=20_000).collect()}
    assert got == plain(rows)
