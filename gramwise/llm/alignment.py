"""Alignment of two tokenizers over the same texts: groups of tokens between common ends, links of tokens that overlap.

A byte range of a document is a fragment: an open prefix (tokens up to the first offset where tokens of both end), closed
groups, and an open suffix (tokens after the last such offset). Two fragments side by side make one: the left suffix and
the right prefix close as a group. This is associative, with the empty fragment as unit, so fragments of a long document are
cut in many tasks and composed as a tree, `FAN` at a time. A token belongs to the range that its end lies in.

Both tokenizers begin anew at a space after what is no white space, so texts are read word by word there; each distinct
word of a slice of text is encoded once (`Lexicon`). Only a word over a range's border needs open parts. A range never cuts a
word that is longer than a range, so long runs without a space are in one range whole.

Counts of id pairs: a slice adds up its pairs first, so a pair that every document holds is a row for each slice; of documents
of several ranges each (document, pair) is one row. Counts come back to slices by (slice, pair).

Null or empty texts, and texts that the tokens don't give back byte by byte, have no tokens. Rows that repeat an id and
null ids are texts of their own; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from gramwise.llm.common import id_kind, materialise, slices, with_row_ids

#: Bytes of a range, of the text that a slice holds, ranges composed at once, words that a lexicon keeps, and words that are
#: encoded at once.
RANGE, SLICE, FAN, LEXICON, AT_ONCE = 64 << 10, 4 << 20, 64, 400_000, 20_000
#: A space at which both tokenizers begin anew.
CUT = re.compile(rb"(?<=[^\x00-\x20])(?<!\xc2\x85)(?<!\xc2\xa0)(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80) ")
#: Ids of the second tokenizer are below this.
SECOND = 1 << 15


class Pair:
    """The two tokenizers, opened once in each worker, and the bytes of their tokens."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=second)
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in printed]
        byte = {chr(x): x for x in printed} | {chr(256 + i): x for i, x in enumerate(rest)}
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(byte[c] for c in entries[i]) if i in entries and all(c in byte for c in entries[i]) else b"" for i in range(max(entries) + 1)]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        if len(self.b_bytes) > SECOND:
            raise ValueError(f"the second tokenizer has more than {SECOND} ids")
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    _open: dict[tuple[str, str], Pair] = {}

    @classmethod
    def of(cls, first: str, second: str) -> Pair:
        if (first, second) not in cls._open:
            cls._open[first, second] = cls(first, second)
        return cls._open[first, second]

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of both for words that begin with a space, and which words the tokens give back."""
        a = [x.ids for x in self.a.encode_batch_fast(words, add_special_tokens=False)]
        b = self.b.encode([w[1:] for w in words], num_threads=1)
        b = [y if len(w) > 1 else [self.b.piece_to_id("▁")] for w, y in zip(words, b, strict=True)]  # a space at the end of a text
        ok = [b"".join([self.a_bytes[i] for i in x]) == (raw := w.encode()) and b"".join([self.b_bytes[i] for i in y]) == raw for w, x, y in zip(words, a, b, strict=True)]
        return a, b, np.array(ok, bool)


class Groups(NamedTuple):
    """Closed groups of token streams over the same bytes."""

    a_starts: np.ndarray  # group i has the tokens a[a_starts[i] : a_starts[i + 1]] and so of b
    b_starts: np.ndarray
    link_a: np.ndarray  # places of linked tokens
    link_b: np.ndarray


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> Groups:
    """Streams that begin and end together, by the ends of their tokens."""
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    starts = [np.concatenate(([0], np.searchsorted(ends, cuts) + 1)) for ends in (a_ends, b_ends)]
    # Token k of a lies over those of b that end after its start, up to the first that ends at or after its end.
    low = np.searchsorted(b_ends, np.concatenate(([0], a_ends))[:-1], "right")
    n = np.searchsorted(b_ends, a_ends, "left") - low + 1
    link_a = np.repeat(np.arange(len(a_ends)), n)
    link_b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return Groups(*starts, link_a, link_b)


def said(a: list[int], b: list[int], g: Groups) -> list[str]:
    """`a1,a2|b1` of each group."""
    sa, sb = list(map(str, a)), list(map(str, b))
    bounds = zip(g.a_starts[:-1].tolist(), g.a_starts[1:].tolist(), g.b_starts[:-1].tolist(), g.b_starts[1:].tolist(), strict=True)
    return [f"{','.join(sa[i:j])}|{','.join(sb[k:m])}" for i, j, k, m in bounds]


def codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) * SECOND + b


class Fragment(NamedTuple):
    """A byte range of one document. Without a common end (not cut) all its tokens are in the prefix.

    n: sums of its closed groups: tokens of a and of b, groups, links. made: groups that composing closed, as (the number of
    the range whose prefix ended them, text, pairs of ids).
    """

    cut: bool = False
    prefix: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())
    suffix: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())
    n: tuple[int, int, int, int] = (0, 0, 0, 0)
    made: tuple[tuple[int, str, tuple[int, ...]], ...] = ()
    seq: int = 0  # the range of its first common end


def closed_group(pair: Pair, a: tuple[int, ...], b: tuple[int, ...], seq: int) -> Fragment:
    """One group, of all the tokens given."""
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    g = groups_of(np.cumsum(pair.a_len[x]), np.cumsum(pair.b_len[y]))
    pairs = codes(x[g.link_a], y[g.link_b]).tolist()
    return Fragment(True, n=(len(a), len(b), 1, len(pairs)), made=((seq, f"{','.join(map(str, a))}|{','.join(map(str, b))}", tuple(pairs)),))


def composed(pair: Pair, left: Fragment, right: Fragment) -> Fragment:
    def both(x, y):
        return x[0] + y[0], x[1] + y[1]

    if not right.cut and right.prefix == ((), ()):
        return left
    if not left.cut and left.prefix == ((), ()):
        return right
    if not right.cut:
        return left._replace(suffix=both(left.suffix, right.prefix)) if left.cut else left._replace(prefix=both(left.prefix, right.prefix))
    if not left.cut:
        return right._replace(prefix=both(left.prefix, right.prefix))
    here = closed_group(pair, *both(left.suffix, right.prefix), right.seq)
    return Fragment(True, left.prefix, right.suffix, tuple(map(sum, zip(left.n, here.n, right.n, strict=True))), left.made + here.made + right.made, left.seq)


def finished(pair: Pair, whole: Fragment) -> Fragment:
    """The fragment of a whole document: its prefix is a group too, and nothing is open."""
    here = closed_group(pair, *whole.prefix, 0)
    return whole._replace(prefix=((), ()), n=tuple(map(sum, zip(here.n, whole.n, strict=True))), made=here.made + whole.made)


class Lexicon:
    """What is known of words: tokens, groups, links. Emptied when it holds LEXICON words."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.at: dict[str, int] = {}
        self.text: list[str] = []
        self.ok = np.zeros(0, bool)
        self.n = np.zeros((0, 4), np.int64)  # tokens of a and of b, groups, links
        self.pairs, self.first = none, np.zeros(1, np.int64)  # pairs of ids of word i: pairs[first[i] : first[i + 1]]

    def numbers(self, words: list[str]) -> np.ndarray:
        """Places of words (each begins with a space), after learning the new ones."""
        if len(self.at) + len(words) > LEXICON:
            self.clear()
        new = [w for w in words if w not in self.at]
        for i in range(0, len(new), AT_ONCE):
            self._learn(new[i : i + AT_ONCE])
        return np.fromiter((self.at[w] for w in words), np.int64, len(words))

    def _learn(self, new: list[str]) -> None:
        a, b, ok = self.pair.encode(new)
        a, b = ([x if good else [] for x, good in zip(ids, ok, strict=True)] for ids in (a, b))
        na, nb = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a, b))
        fa, fb = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((a, na), (b, nb)))
        g = groups_of(np.cumsum(self.pair.a_len[fa]), np.cumsum(self.pair.b_len[fb]))
        every = said(fa.tolist(), fb.tolist(), g)
        # Groups and links stand in the order of words.
        word = np.repeat(np.arange(len(new)), na)
        n_groups = np.bincount(word[g.a_starts[:-1]], minlength=len(new)) if len(every) else np.zeros(len(new), np.int64)
        n_links = np.bincount(word[g.link_a], minlength=len(new))
        stops = np.cumsum(n_groups)
        self.text += [";".join(every[i:j]) for i, j in zip((stops - n_groups).tolist(), stops.tolist(), strict=True)]
        self.at.update(zip(new, range(len(self.ok), len(self.ok) + len(new)), strict=True))
        self.ok = np.concatenate((self.ok, ok))
        self.n = np.concatenate((self.n, np.column_stack((na, nb, n_groups, n_links))))
        self.pairs = np.concatenate((self.pairs, codes(fa[g.link_a], fb[g.link_b])))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(n_links)))


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of texts that begin with a space, which of them each word of a text is, and where texts begin."""
    parts = pc.split_pattern(pc.utf8_slice_codeunits(texts.cast(pa.large_string()), 1), " ")
    starts = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    flat, starts = coded.indices.to_numpy().astype(np.int64), starts - starts[0]
    distinct = coded.dictionary.to_pylist()
    # What is empty or ends with white space goes on with what follows.
    goes_on = np.fromiter((not w or w[-1] < "!" or w[-1].isspace() for w in distinct), bool, len(distinct))[flat] if len(flat) else np.zeros(0, bool)
    goes_on[starts[1:][starts[1:] > starts[:-1]] - 1] = False
    if not goes_on.any():
        return [" " + w for w in distinct], flat, starts
    heads = np.concatenate(([True], ~goes_on[:-1]))
    at = np.flatnonzero(heads)
    stops = np.concatenate((at[1:], [len(flat)]))
    merged = {}
    number = flat[at].copy()
    for i in np.flatnonzero(stops - at > 1).tolist():
        word = " ".join([distinct[k] for k in flat[at[i] : stops[i]]])
        number[i] = merged.setdefault(word, len(distinct) + len(merged))
    return [" " + w for w in (*distinct, *merged)], number, np.concatenate(([0], np.cumsum(heads)))[starts]


def ranges(text: str, size: int) -> list[tuple[int, int, int, str]]:
    """(number, bytes of its first word before the range, bytes of its last word after the range, words) of the ranges of a
    text with a space before it. The last range ends with the text, and no border lies in a word longer than a range."""
    raw = b" " + text.encode()
    borders = [(0, 0, 0)]  # the border, the cut before it or there, the cut at or after it
    at = size
    while at < len(raw):
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        after = CUT.search(raw, at)
        after = after.start() if after else len(raw)
        before = borders[-1][1] if borders[-1][2] > at else borders[-1][2]
        for found in CUT.finditer(raw, max(before, at - size), at + 1):
            before = found.start()
        if at < len(raw) and after - before <= size and before >= borders[-1][1]:
            borders.append((at, before, after))
            at += size
        else:
            at = max(after, at + 1)
    borders.append((len(raw), len(raw), len(raw)))
    return [(i, low - before, after - high, raw[before:after].decode()) for i, ((low, before, _), (high, _, after)) in enumerate(zip(borders, borders[1:], strict=False))]


def partial(pair: Pair, word: str, low: int, high: int, seq: int) -> tuple[Fragment, list[str], np.ndarray]:
    """The fragment of the tokens of a word that end after its byte low, up to its byte high, with its closed groups and
    pairs."""
    (a,), (b,), ok = pair.encode([word])
    if not ok[0]:
        raise ValueError
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    a_ends, b_ends = np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b])
    own_a, own_b = (a_ends > low) & (a_ends <= high), (b_ends > low) & (b_ends <= high)
    a, a_ends, b, b_ends = a[own_a], a_ends[own_a], b[own_b], b_ends[own_b]
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    ids = lambda x: tuple(x.tolist())
    if not len(cuts):
        return Fragment(prefix=(ids(a), ids(b)), seq=seq), [], np.zeros(0, np.int64)
    head = ids(a[a_ends <= cuts[0]]), ids(b[b_ends <= cuts[0]])
    tail = ids(a[a_ends > cuts[-1]]), ids(b[b_ends > cuts[-1]])
    mid_a, mid_b = (a_ends > cuts[0]) & (a_ends <= cuts[-1]), (b_ends > cuts[0]) & (b_ends <= cuts[-1])
    x, y = a[mid_a], b[mid_b]
    g = groups_of(a_ends[mid_a] - cuts[0], b_ends[mid_b] - cuts[0])
    pairs = codes(x[g.link_a], y[g.link_b])
    return Fragment(True, head, tail, (len(x), len(y), len(cuts) - 1, len(pairs)), seq=seq), said(x.tolist(), y.tolist(), g), pairs


OPEN = "struct<cut:boolean,pa:array<int>,pb:array<int>,sa:array<int>,sb:array<int>,n:array<bigint>,made:array<struct<seq:int,text:string,pairs:array<bigint>>>,seq:int>"
_MADE = pa.struct([("seq", pa.int32()), ("text", pa.string()), ("pairs", pa.list_(pa.int64()))])
_OPEN = pa.struct([("cut", pa.bool_()), *((c, pa.list_(pa.int32())) for c in ("pa", "pb", "sa", "sb")), ("n", pa.list_(pa.int64())), ("made", pa.list_(_MADE)), ("seq", pa.int32())])


def _put(f: Fragment) -> dict:
    return {"cut": f.cut, "pa": f.prefix[0], "pb": f.prefix[1], "sa": f.suffix[0], "sb": f.suffix[1], "n": f.n, "made": [{"seq": s, "text": t, "pairs": p} for s, t, p in f.made], "seq": f.seq}


def _get(x: dict) -> Fragment:
    return Fragment(x["cut"], (tuple(x["pa"]), tuple(x["pb"])), (tuple(x["sa"]), tuple(x["sb"])), tuple(x["n"]), tuple((m["seq"], m["text"], tuple(m["pairs"])) for m in x["made"]), x["seq"])


def _slice_schema(kind: str) -> str:
    # Of each row: seq is -1 for a whole document. link_*: its pairs, as places in codes, and how often it has them.
    return (f"slice string, rid array<bigint>, id array<{kind}>, seq array<int>, ok array<boolean>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>, "
            f"text array<string>, open array<{OPEN}>, codes array<bigint>, docs array<bigint>, link_stop array<bigint>, link_at array<int>, link_n array<int>")  # fmt: skip


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs, by the tokenizer files first
    (of the tokenizers library, byte-level) and second (of sentencepiece)."""
    kind = id_kind(docs, id_col)
    rows = with_row_ids(docs, id_col, text_col)
    long = F.octet_length("text") >= size
    whole = rows.where(~long).select("rid", "id", F.lit(-1).alias("seq"), F.lit(0).alias("before"), F.lit(0).alias("after"), F.concat(F.lit(" "), "text").alias("words"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = ranges(batch.column("text")[i].as_py(), size)
                at = pa.array(np.full(len(found), i))
                cols = [batch.column(c).take(at) for c in ("rid", "id")]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string())))], ["rid", "id", "seq", "before", "after", "words"])

    schema = f"rid bigint, id {kind}, seq int, before int, after int, words string"
    parts = rows.where(long).mapInArrow(cut, schema).repartition("rid", "seq")
    taken = materialise(whole.unionByName(parts).mapInArrow(_tokenised(first, second, kind), _slice_schema(kind)), "slices")
    big = taken.select("slice", F.explode(F.arrays_zip("rid", "id", "seq", "ok", "text", "open")).alias("x")).select("x.*").where("seq >= 0")
    top = materialise(_composed(big.select("rid", "id", "seq", "ok", "open"), first, second), "documents")

    # In how many documents each pair is linked; whether no pair of its first id is in more.
    of_slices = taken.select(F.explode(F.arrays_zip("codes", "docs")).alias("x")).select("x.codes", F.col("x.docs").alias("n")).where("n > 0")
    rid_codes = taken.select(F.explode(_pairs_of_ranges()).alias("x")).select("x.rid", "x.code")
    made = top.where("ok").select("rid", F.explode("open.made").alias("m"))
    made_codes = made.select("rid", F.explode("m.pairs").alias("code"))
    sound = top.where("ok").select("rid")
    of_ranges = rid_codes.unionByName(made_codes).join(sound, "rid", "left_semi").distinct().groupBy(F.col("code").alias("codes")).agg(F.count("*").alias("n"))
    counts = of_slices.unionByName(of_ranges).groupBy(F.col("codes").alias("code")).agg(F.sum("n").alias("n"))
    # An id of the first has SECOND pairs at most.
    counts = materialise(counts.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(F.expr(f"code div {SECOND}")))), "counts")

    asked = taken.select("slice", F.posexplode("codes").alias("at", "code"))
    answers = asked.join(counts, "code").select(F.col("slice").alias("of"), "at", "n", "best")
    found = taken.select("slice", "rid", "id", "seq", "ok", "n_a", "n_b", "n_groups", "n_links", "sha", "link_stop", "link_at", "link_n")
    out = f"rid bigint, id {kind}, seq int, ok boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    scored = found.groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(_scored, out)
    if not top.take(1):  # no document of several ranges
        return _result(scored, id_col)
    scored = materialise(scored, "scored")
    joined = made_codes.join(counts, "code").groupBy("rid").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    sums = scored.where("seq >= 0").select("rid", "n_best", "count_sum").unionByName(joined).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    pieces = big.where("text != ''").select("rid", (F.col("seq") * 2 + 1).alias("place"), "text").unionByName(made.select("rid", (F.col("m.seq") * 2).alias("place"), F.col("m.text").alias("text")))
    ends = top.join(sums, "rid").join(_digests(pieces), "rid", "left").select("rid", "id", F.lit(-1).alias("seq"), "ok", *[F.col("open.n")[i].alias(c) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))], "n_best", "count_sum", "groups_sha256")
    return _result(scored.where("seq < 0").unionByName(ends), id_col)


def _result(scored: DataFrame, id_col: str) -> DataFrame:
    """Texts whose tokens don't give them back have none."""
    numbers = [F.when(F.col("ok"), F.col(c)).otherwise(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return scored.select(F.col("id").alias(id_col), *numbers, F.when(F.col("ok"), F.col("groups_sha256")).otherwise("").alias("groups_sha256"))


def _pairs_of_ranges():
    """(rid, code) of the ranges in a slice, each pair once a range."""
    starts = F.concat(F.array(F.lit(0).cast("bigint")), "link_stop")
    rows = F.filter(F.arrays_zip("rid", "seq", F.col("link_stop").alias("stop"), starts.alias("start")), lambda r: F.coalesce(r["seq"], F.lit(-1)) >= 0)
    return F.flatten(F.transform(rows, lambda r: F.transform(F.slice("link_at", (r["start"] + 1).cast("int"), (r["stop"] - r["start"]).cast("int")), lambda at: F.struct(r["rid"].alias("rid"), F.get(F.col("codes"), at).alias("code")))))


def _tokenised(first: str, second: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(first, second)
        lexicon = Lexicon(pair)
        for batch in batches:
            for part in slices(batch, "words", SLICE):
                yield _slice(part, pair, lexicon)

    return run


def _slice(part: pa.RecordBatch, pair: Pair, lexicon: Lexicon) -> pa.RecordBatch:
    seq, before, after = (part.column(c).to_numpy() for c in ("seq", "before", "after"))
    n_rows = part.num_rows
    distinct, number, starts = words_of(part.column("words"))
    at = lexicon.numbers(distinct)[number] if len(number) else number
    lengths = np.diff(starts)
    # An empty text is a space alone; a word that its tokens don't give back spoils its text.
    empty = pc.equal(part.column("words"), " ").to_numpy(zero_copy_only=False) & (seq < 0)
    row = np.repeat(np.arange(n_rows), lengths)
    ok = (np.bincount(row, ~lexicon.ok[at], n_rows) == 0) & ~empty
    own = np.ones(len(at), bool)  # words that are in the row whole
    inner = seq >= 0
    some = inner & (lengths > 0)
    own[starts[:-1][some]] = own[starts[1:][some] - 1] = False
    n = np.zeros((n_rows, 4), np.int64)
    sha, texts, opened = [""] * n_rows, [None] * n_rows, [None] * n_rows
    extra: dict[int, list[np.ndarray]] = {}
    for i in range(n_rows):
        words = at[starts[i] : starts[i + 1]]
        if not inner[i]:
            if ok[i]:
                n[i] = lexicon.n[words].sum(axis=0)
                sha[i] = sha256(";".join([lexicon.text[k] for k in words.tolist()]).encode()).hexdigest()
            continue
        if ok[i]:
            mid = words[1:-1]
            spelt = [distinct[k] for k in (number[starts[i]], number[starts[i + 1] - 1])]
            closed = [lexicon.text[k] for k in mid.tolist()]
            if len(words) == 1:
                size = len(spelt[0].encode())
                whole, groups, pairs = partial(pair, spelt[0], int(before[i]), size - int(after[i]), int(seq[i]))
                texts[i], extra[i] = ";".join(groups), [pairs]
            else:
                size = len(spelt[1].encode())
                head, one, p = partial(pair, spelt[0], int(before[i]), len(spelt[0].encode()), int(seq[i]))
                tail, two, q = partial(pair, spelt[1], 0, size - int(after[i]), int(seq[i]))
                # The word before ends at a cut, so what opens the last word closes here, and so do all words between.
                if tail.cut:
                    first = closed_group(pair, *tail.prefix, 0)
                    two = [first.made[0][1], *two]
                    q = np.concatenate((np.array(first.made[0][2], np.int64), q))
                    tail = tail._replace(prefix=((), ()), n=tuple(map(sum, zip(tail.n, first.n, strict=True))))
                    ends = tail.suffix
                else:
                    ends = tail.prefix
                sums = tuple(int(x) for x in lexicon.n[mid].sum(axis=0))
                whole = Fragment(True, head.prefix, ends, tuple(map(sum, zip(head.n, sums, tail.n, strict=True))), seq=int(seq[i]))
                texts[i], extra[i] = ";".join([*one, *closed, *two]), [p, q]
            n[i] = whole.n
            opened[i] = _put(whole)
        else:
            opened[i], texts[i] = _put(Fragment(seq=int(seq[i]))), ""
    # Pairs of all rows, each once a row.
    use = own & ok[row]
    links = lexicon.n[at[use], 3]
    flat = lexicon.pairs[np.repeat(lexicon.first[at[use]], links) + np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)]
    of_row = np.repeat(row[use], links)
    if extra:
        flat = np.concatenate([flat, *(y for x in extra.values() for y in x)])
        of_row = np.concatenate([of_row, *(np.full(len(y), i) for i, x in extra.items() for y in x)])
    every, place = np.unique(flat, return_inverse=True)
    keys, often = np.unique(of_row.astype(np.int64) * max(len(every), 1) + place, return_counts=True)
    of_row, place = keys // max(len(every), 1), keys % max(len(every), 1)
    docs = np.bincount(place[~inner[of_row]], minlength=len(every))
    stop = np.cumsum(np.bincount(of_row, minlength=n_rows))
    lists = [part.column("rid"), part.column("id"), part.column("seq"), pa.array(ok), *(pa.array(n[:, k]) for k in range(4)), pa.array(sha), pa.array(texts, pa.string()), pa.array(opened, _OPEN)]
    lists += [pa.array(every), pa.array(docs.astype(np.int64)), pa.array(stop.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(often.astype(np.int32))]
    names = ["slice", "rid", "id", "seq", "ok", "n_a", "n_b", "n_groups", "n_links", "sha", "text", "open", "codes", "docs", "link_stop", "link_at", "link_n"]
    pa.default_memory_pool().release_unused()
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)], names)


def _scored(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over the links of each row of a slice, with the counts of its pairs."""
    one = {c: table.column(c)[0].values for c in table.column_names if c != "slice"}
    at = answers.column("at").to_numpy()
    place, often, stop = (one[c].to_numpy() for c in ("link_at", "link_n", "link_stop"))
    size = max(at.max(initial=-1), place.max(initial=-1)) + 1  # pairs of no sound text have no count
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[at], best[at] = answers.column("n").to_numpy(), answers.column("best").to_numpy().astype(np.int64)
    sums = [np.concatenate(([0], np.cumsum(x[place] * often))) for x in (best, count)]
    start = np.concatenate(([0], stop[:-1])) if len(stop) else stop
    values = [one[c] for c in ("rid", "id", "seq", "ok", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*values, *(pa.array(x[stop] - x[start]) for x in sums), one["sha"]], ["rid", "id", "seq", "ok", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _composed(parts: DataFrame, first: str, second: str, fan: int = FAN) -> DataFrame:
    """(rid, id, ok, open): one finished fragment of each document; rounds compose `fan` neighbours at a time."""
    kind = dict(parts.dtypes)["id"]
    schema = f"rid bigint, id {kind}, seq int, ok boolean, open {OPEN}"

    def run(batches: Iterator[pa.RecordBatch], last: bool = False) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(first, second)
        for batch in batches:
            done = []
            for x in batch.column("parts").to_pylist():
                if all(p["ok"] for p in x):
                    whole = reduce(lambda a, b: composed(pair, a, b), [_get(p["open"]) for p in x])
                    done.append(_put(finished(pair, whole) if last else whole))
                else:
                    done.append(_put(Fragment()))
            oks = [all(p["ok"] for p in x) for x in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), batch.column("seq"), pa.array(oks, pa.bool_()), pa.array(done, _OPEN)], ["rid", "id", "seq", "ok", "open"])

    most = parts.agg(F.max("seq")).first()[0]
    if most is None:
        return parts.select("rid", "id", "ok", "open")
    while True:
        last = most < fan
        groups = parts.groupBy("rid", F.expr(f"seq div {fan}").cast("int").alias("up")).agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("seq", "ok", "open"))).alias("parts"))
        parts = groups.select("rid", "id", F.col("up").alias("seq"), "parts").mapInArrow(lambda x, last=last: run(x, last), schema)
        if last:
            return parts.drop("seq")
        parts, most = materialise(parts, "composed"), most // fan


def _digests(pieces: DataFrame) -> DataFrame:
    """(rid, groups_sha256) of the pieces of each document in order, joined by semicolons; a task holds one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if rid != now:
                    if sha:
                        done.append((now, sha.hexdigest()))
                    now, sha = rid, sha256()
                else:
                    sha.update(b";")
                sha.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], ["rid", "groups_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()])], ["rid", "groups_sha256"])

    return pieces.repartition("rid").sortWithinPartitions("rid", "place").mapInArrow(run, "rid bigint, groups_sha256 string")
