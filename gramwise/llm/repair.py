"""Conversation structure: damage for tests, faults of rows, and the cheapest repair by search over the edit lattice.

A conversation is well formed if its role initials are `(s?(ua)+)?`: an optional system row, then user and assistant in
turn. A lattice node is (rows read, state), the states being nothing yet, after s, after u, after a. Edits are Keep (0),
Rerole to user or assistant (1), Delete (2; the only one for blank rows and duplicates) and Insert of an empty user or
assistant row (5); a truncated row that stays costs 5 more.

The search runs from both ends: two heaps meet, all crossings of equal cost are finished, and the least concatenated audit
is picked. An audit fixes its path, so of two different audits that reach a node at one cost neither begins the other, and
the least prefix and the least suffix of a node make the least audit through it.

Long conversations: rows are numbered without a task for each conversation (`numbered`), cut into blocks of `BLOCK` rows,
and each block gives the cheapest audit from every state to every state. Blocks of one conversation are composed `FAN` at a
time by the same search over (block, state) until one is left. The repaired rows are hashed as a stream in order, as SHA-256
has to be: a task holds one batch of them.

Nulls count as one space. Rows of one turn are ordered by role, then by the text's SHA-256; repeated rows stay repeated.
A null conv_id is a conversation as others are. Other columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.llm.common import materialise
from gramwise.operators.numbering import numbered

#: Rows of a block, and blocks that are composed at once.
BLOCK, FAN = 512, 64
WORD = r"[^\x20\x09-\x0D]"
ROLES = {"u": "user", "a": "assistant"}
#: What each state may emit, and the state after it; audits end in the states of DONE.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DONE = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: From state to state: (state after, cost, audit).
Edges = tuple[tuple[tuple[int, int, str], ...], ...]
INSERTS: Edges = tuple(tuple((q, INSERT, "I") for x, q in out.items() if x in ROLES) for out in NEXT)
NO_INSERTS: Edges = ((), (), (), ())


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by crc32(`conv_id:turn`) modulo 20: 0 drops the row, 1 empties its
    text, 2 takes its `[.!?]`, 3 repeats it, 4 makes it the user's."""
    col = lambda c: F.col(f"`{c}`")
    said = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(col("conv_id"), col("turn"), said("role").alias("role"), said("text").alias("text"), draw.alias("draw")).where("draw != 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def key(conv_id: Column) -> Column:
    """A text for each id, the null one too."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def with_faults(rows: DataFrame) -> DataFrame:
    """(k, n, turn, role, text, code): n numbers a conversation's rows; code is the role's initial and the first fault: 1 blank,
    2 duplicate, 3 truncated, else 0."""
    keyed = rows.select(key(F.col("conv_id")).alias("k"), "turn", "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    rows = materialise(numbered(keyed, ["k"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]), "turns")
    # The first of equal rows; this joins by (k, n), of which each is met once, whatever is common.
    first = rows.groupBy("k", "role", "digest").agg(F.min("n").alias("n")).select("k", "n", F.lit(True).alias("first"))
    last = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(WORD), "1").when(F.col("first").isNull(), "2").when(~last.rlike("[.!?]"), "3").otherwise("0")
    start = F.substring("role", 1, 1)
    code = F.concat(F.when(start.isin("s", "u", "a"), start).otherwise("x"), fault)
    return rows.join(first, ["k", "n"], "left").select("k", "n", "turn", "role", "text", code.alias("code"))


@lru_cache(1 << 12)
def steps_of(code: str) -> Edges:
    """The edits that one row allows in each state."""
    initial, fault = code
    out = []
    for q, after in enumerate(NEXT):
        edges = [(q, DELETE, "D")]
        if fault not in "12":
            more = TRUNCATED if fault == "3" else 0
            if initial in after:
                edges.append((after[initial], KEEP + more, "K"))
            edges += [(to, REROLE + more, "R") for x, to in after.items() if x in ROLES]
        out.append(tuple(edges))
    return tuple(out)


def search(steps: list[Edges], inserts: Edges, start: int, ends: Iterable[int]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest way through steps from state start to one of ends, the ASCII-least audit of equal ones.

    Entries are popped by cost, then in the direction of reading, then by audit: edges that cost nothing lead on in that
    direction only, so a node's first entry has the least audit of its least cost.
    """
    m = len(steps)
    back: list[list[list[tuple[int, int, str]]]] = [[[], [], [], []] for _ in steps]  # into a state after a step
    for i, step in enumerate(steps):
        for q, edges in enumerate(step):
            for to, cost, said in edges:
                back[i][to].append((q, cost, said))
    before: list[list[tuple[int, int, str]]] = [[], [], [], []]
    for q, edges in enumerate(inserts):
        for to, cost, said in edges:
            before[to].append((q, cost, said))
    there: dict[tuple[int, int], tuple[int, str]] = {}
    home: dict[tuple[int, int], tuple[int, str]] = {}
    ahead, behind = [(0, 0, "", start)], [(0, -m, "", q) for q in ends]
    heapq.heapify(behind)
    best: tuple[int, str] | None = None
    while ahead and behind and (best is None or ahead[0][0] + behind[0][0] <= best[0]):
        if ahead[0][0] <= behind[0][0]:
            cost, i, audit, q = heapq.heappop(ahead)
            if (i, q) in there:
                continue
            there[i, q] = cost, audit
            found = [(home[i, q], "", 0)] if (i, q) in home else []
            onward = [(i, to, c, s) for to, c, s in inserts[q]] + ([(i + 1, to, c, s) for to, c, s in steps[i][q]] if i < m else [])
            for at, to, c, said in onward:
                if (at, to) not in there:
                    heapq.heappush(ahead, (cost + c, at, audit + said, to))
                if (at, to) in home:
                    found.append((home[at, to], said, c))
            for (rest, tail), said, c in found:
                whole = cost + c + rest, audit + said + tail
                best = whole if best is None or whole < best else best
        else:
            cost, i, tail, q = heapq.heappop(behind)
            i = -i
            if (i, q) in home:
                continue
            home[i, q] = cost, tail
            found = [(there[i, q], "", 0)] if (i, q) in there else []
            onward = [(i, to, c, s) for to, c, s in before[q]] + ([(i - 1, to, c, s) for to, c, s in back[i - 1][q]] if i else [])
            for at, to, c, said in onward:
                if (at, to) not in home:
                    heapq.heappush(behind, (cost + c, -at, said + tail, to))
                if (at, to) in there:
                    found.append((there[at, to], said, c))
            for (rest, audit), said, c in found:
                whole = cost + c + rest, audit + said + tail
                best = whole if best is None or whole < best else best
    return best


@lru_cache(1 << 14)
def through(codes: str, first: bool) -> Edges:
    """The cheapest audits of a block from each state (the first block: from none yet) to each state."""
    steps = [steps_of(codes[i : i + 2]) for i in range(0, len(codes), 2)]
    found = lambda q: ((to, search(steps, INSERTS, q, (to,))) for to in range(4))
    return tuple(tuple((to, *x) for to, x in found(q) if x) if q == 0 or not first else () for q in range(4))


def composed(blocks: list[Edges]) -> Edges:
    """The same of blocks one after another; inserts are in the blocks already."""
    found = lambda q: ((to, search(blocks, NO_INSERTS, q, (to,))) for to in range(4))
    return tuple(tuple((to, *x) for to, x in found(q) if x) for q in range(4))


EDGE = "struct<q:int,to:int,cost:bigint,audit:string>"
BLOCKS = f"k string, blk bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, edges array<{EDGE}>"


def _rows(edges: Edges) -> list[dict]:
    return [{"q": q, "to": to, "cost": cost, "audit": audit} for q, out in enumerate(edges) for to, cost, audit in out]


def _edges(rows: list[dict]) -> Edges:
    return tuple(tuple((x["to"], x["cost"], x["audit"]) for x in rows if x["q"] == q) for q in range(4))


def illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def audits(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(k, blank, duplicate, truncated, illegal, cost, audit) of each conversation of with_faults."""

    def search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                codes = "".join(c["code"] for c in x["codes"])
                starts, faults = codes[::2], codes[1::2]
                out.append({"k": x["k"], "blk": x["blk"], "blank": faults.count("1"), "duplicate": faults.count("2"), "truncated": faults.count("3"), "illegal": illegal(starts), "head": starts[0], "tail": starts[-1], "edges": _rows(through(codes, x["blk"] == 0))})
            yield from pa.Table.from_pylist(out, schema).to_batches()

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                parts = x["parts"]
                sums = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
                sums["illegal"] += sum(illegal(a["tail"] + b["head"]) for a, b in zip(parts, parts[1:], strict=False))
                edges = parts[0]["edges"] if len(parts) == 1 else _rows(composed([_edges(p["edges"]) for p in parts]))
                out.append({"k": x["k"], "blk": x["blk"], **sums, "head": parts[0]["head"], "tail": parts[-1]["tail"], "edges": edges})
            yield from pa.Table.from_pylist(out, schema).to_batches()

    edge = pa.struct([("q", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    schema = pa.schema([("k", pa.string()), ("blk", pa.int64()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("head", pa.string()), ("tail", pa.string()), ("edges", pa.list_(edge))])
    blk = F.expr(f"(n - 1) div {block}")
    # A list has `block` short codes at most.
    lists = rows.groupBy("k", blk.alias("blk")).agg(F.array_sort(F.collect_list(F.struct("n", "code"))).alias("codes"))
    now = materialise(lists.mapInArrow(search_blocks, BLOCKS), "blocks")
    last = now.agg(F.max("blk")).first()[0] or 0
    while last:
        names = [c for c in now.columns if c not in ("k", "blk")]
        groups = now.groupBy("k", F.expr(f"blk div {fan}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("blk", *names))).alias("parts"))
        now = materialise(groups.withColumnRenamed("up", "blk").mapInArrow(compose, BLOCKS), "blocks")
        last //= fan
    ended = F.array_min(F.transform(F.filter("edges", lambda e: (e["q"] == 0) & e["to"].isin(*DONE)), lambda e: F.struct(e["cost"], e["audit"])))
    return now.withColumn("best", ended).select("k", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(k, n, role, text) of the rows that audits leave; inserted rows have the n of the row that they stand before."""
    piece = F.posexplode(F.regexp_extract_all("audit", F.lit(r"I*[KRD]|I+\z"), F.lit(0))).alias("p", "piece")
    pieces = found.select("k", piece).select("k", (F.col("p") + 1).cast("long").alias("n"), "piece")
    both = pieces.join(rows.select("k", "n", "role", "text"), ["k", "n"], "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, 0
        for batch in batches:
            out = []
            for k, n, piece, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    now, state = k, 0
                for edit in piece:
                    if edit == "D":
                        continue
                    emitted = role[:1] if edit == "K" else "a" if state == 2 else "u"
                    out.append((k, n, role if edit == "K" else ROLES[emitted], "" if edit == "I" else text))
                    state = NEXT[state][emitted]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["k", "n", "role", "text"])

    return both.select("k", "n", "piece", "role", "text").repartition("k").sortWithinPartitions("k", "n").mapInArrow(apply, "k string, n bigint, role string, text string")


def digests(kept: DataFrame) -> DataFrame:
    """(k, repaired_sha256) of rows in order, each conversation's in one partition: `role:text`, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def out(ended: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in ended], pa.string()) for i in (0, 1)], ["k", "repaired_sha256"])

        for batch in batches:
            ended = []
            for k, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    if sha:
                        ended.append((now, sha.hexdigest()))
                    now, sha = k, sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield out(ended)
        if sha:
            yield out([(now, sha.hexdigest())])

    return kept.mapInArrow(run, "k string, repaired_sha256 string")


def repair(conversations: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row of each conversation after
    `damage`; one of which no row is left has zeros, an empty audit and the digest of an empty text."""
    rows = materialise(with_faults(damage(conversations)), "faults")
    found = materialise(audits(rows, block, fan), "audits")
    spans = rows.groupBy("k").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).cast("long").alias("gaps"))
    every = conversations.select(F.col("`conv_id`").alias("conv_id")).distinct().withColumn("k", key(F.col("conv_id")))
    whole = every.join(spans, "k", "left").join(found, "k", "left").join(digests(repaired(rows, found)), "k", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
