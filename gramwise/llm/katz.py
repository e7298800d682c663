"""Katz backoff: n-gram counts with Good-Turing discounts and exactly normalised backoff weights.

Texts are cut into blocks of a few megabytes, which are written once, as numbers of their words. A block counts its words, bigrams and
longer n-grams once and sends each bucket the hashes and counts of what it has met, packed, far fewer than tokens. A
bucket is chosen by the hash of the whole n-gram, so the followers of a common word are spread over all of them. It adds
the blocks up and answers each in the order of its question; of the blocks that met an n-gram in training, the first owns
it. Owners then send each n-gram's count and its lower order's to the bucket of its context, where they are added up in
turn, as whole numbers that any order of adding leaves alike and few bytes hold: counts that are discounted by how many
there are of each. It adds up one range of hashes after another, and one block's tallies after another, so that a task holds
little more than the hashes and counts it was sent. A context has one entry for each block at most, and none if one block alone has it. A bucket's sums are
written once, with what each block asks of them; they are sent to one half of the blocks after the other, as every block
that asks gets a copy. There every token is scored in its block, recursively: the n-gram if it was met often enough, else the backoff of its context times the
lower order.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gramwise.llm.common import crc_mod, give_back, id_kind, materialise, release, slices, with_row_ids
from gramwise.llm.tokens import word_hashes, words

U = np.uint64
#: Hashes that stand for the start of a text (a context only) and its end (a token).
START, END = U(1), U(2)
#: Counts up to this are discounted; bigrams met less often than LEAST back off unless a query says otherwise.
LARGE, LEAST = 5, 1
#: Bytes of text in a block, and blocks for each bucket on average.
BLOCK_BYTES, BLOCKS_A_BUCKET = 3 << 20, 8
FOLDS, HELD_OUT = 7, 2
#: N-grams that a bucket adds up at a time, as met in its blocks.
RANGE = 1 << 18
#: Parts of the blocks, of which one at a time is scored.
HALVES = 2
#: A slot is a bucket and, in its last bits, an order.
ORDERS = 3


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers by planes of bytes, without the planes that are all zero."""
    flat = np.ascontiguousarray(values, U).ravel()
    n = -(-int(flat.max(initial=0)).bit_length() // 8)
    rows = flat.view(np.uint8).reshape(-1, 8)
    planes = [rows[:, i].tobytes() for i in range(n)]
    return squeeze(b"".join([bytes([n]), *planes]) if n else bytes([0]) + len(flat).to_bytes(8, "little"))


def unpack(data: bytes) -> np.ndarray:
    data = unsqueeze(data)
    n = data[0]
    if not n:
        return np.zeros(int.from_bytes(data[1:9], "little"), U)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(n, -1)
    out = np.zeros(planes.shape[1], U)
    rows = out.view(np.uint8).reshape(-1, 8)
    for i, plane in enumerate(planes):
        rows[:, i] = plane
    return out


def pack_sorted(values: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return pack(np.diff(values, prepend=U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=U)


def tallies(at: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For each of n places, the counts over LARGE added up, and how many are 1, 2 .. LARGE: a row each."""
    large, out = counts > LARGE, np.empty((LARGE + 1, n), np.int64)
    out[0] = np.bincount(at[large], counts[large], n)
    for r in range(1, LARGE + 1):
        out[r] = np.bincount(at[counts == r], minlength=n)
    return out


def unpack_tallies(data: list[bytes]) -> np.ndarray:
    """Tallies of counts and of lower orders' counts, those of all parts side by side."""
    return np.concatenate([np.zeros((2, LARGE + 1, 0), np.int64), *map(unpack_tally, data)], axis=2)


def unpack_tally(data: bytes) -> np.ndarray:
    return unpack(data).view(np.int64).reshape(2, LARGE + 1, -1)


def frozen(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def thawed(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def grouped(batches, column: str, made):
    """What is made of the rows of each value of a column, one table at a time; batches come sorted by it. Freed memory goes
    back."""
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        held.clear()
        return made(table)

    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(column)).to_numpy()
        if not len(keys):
            continue
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(held[-1].schema.get_field_index(column))[0].as_py() != keys[a]:
                yield done()
                give_back()
            held.append(batch.slice(a, b - a))
        del batch, keys
    if held:
        yield done()
    give_back()


def then_give_back(out: pa.Table) -> pa.Table:
    """out, once the memory that was freed on the way goes back."""
    give_back()
    return out


def mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of contexts followed by words."""
    with np.errstate(over="ignore"):
        x = h * U(0x9E3779B97F4A7C15) + w
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Level:
    """A block's distinct n-grams of one order by hash: the places of their contexts and their last n - 1 words in the
    level below, and which one ends at each place of the line (-1 where none does)."""

    def __init__(self, key: np.ndarray, at: np.ndarray, ctx: np.ndarray | None = None, low: np.ndarray | None = None):
        self.key, self.at, self.ctx, self.low = key, at, ctx, low

    def above(self, words_: Level, places: np.ndarray) -> Level:
        """The n-grams of the next order that end at these places."""
        hashes = mixed(self.key[self.at[places - 1]], words_.key[words_.at[places]])
        order = np.argsort(hashes)
        hashes, places = hashes[order], places[order]
        new = np.concatenate((np.ones(min(len(hashes), 1), bool), hashes[1:] != hashes[:-1]))
        at = np.full(len(self.at), -1, np.int64)
        at[places] = np.cumsum(new) - 1
        first = places[new]
        return Level(hashes[new], at, self.at[first - 1], self.at[first])

    def buckets(self, bits: int):
        """(bucket, range of n-grams) for each bucket that has some."""
        top = (self.key >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.key), np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(top[1:] != top[:-1]) + 1, [len(top)])) if len(top) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(top[a]), slice(a, b)


class Block:
    """The tokens of a block's texts, and the distinct words and n-grams up to an order."""

    def __init__(self, data: bytes, order: int):
        rows, key, line = (data[a:b] for a, b in _parts(data))
        self.rows = thawed(rows)
        size = self.rows.column("words").to_numpy()
        n = len(size)
        begin = np.concatenate(([0], np.cumsum(size + 2)))[:-1]
        self.row = np.repeat(np.arange(n), size + 2)
        since = np.arange(len(self.row)) - begin[self.row]
        self.token = np.flatnonzero(since)  # all but START
        self.first = begin - np.arange(n)  # of each text among the tokens
        self.levels = [Level(unpack_sorted(key), unpack(line).astype(np.int64))]
        for k in range(2, order + 1):
            self.levels.append(self.levels[-1].above(self.levels[0], np.flatnonzero(since >= k - 1)))

    @staticmethod
    def write(batch: pa.RecordBatch) -> bytes:
        """The block of rows (rid, id, train, text): the rows without their texts, the words met, and the line of their
        numbers, each text from START to END."""
        w = words(batch.column(3), lower=True)
        coded, size = w.flat.dictionary_encode(), np.diff(w.starts)
        own = np.maximum(word_hashes(coded.dictionary), U(3))
        key, rank = np.unique(np.concatenate((np.array([START, END]), own)), return_inverse=True)
        end = np.cumsum(size + 2) - 1
        line = np.full(len(w.flat) + 2 * len(size), rank[0])
        line[end] = rank[1]
        place = np.ones(len(line), bool)
        place[end] = place[end - size - 1] = False
        line[place] = rank[2:][coded.indices.to_numpy()]
        rows = pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(size)], ["id", "train", "words"])
        parts = frozen(rows), pack_sorted(key), pack(line)
        return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _parts(data: bytes):
    """Where the parts of a written block stand."""
    at = 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        yield at + 8, at + 8 + size
        at += 8 + size


def _slot(bucket: int, order: int) -> int:
    return bucket << ORDERS | order


def _packed(out: list[tuple], fields: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    named = [f.split() for f in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[t]) for i, (_, t) in enumerate(named)], [c for c, _ in named])


def _cut(rows: DataFrame) -> DataFrame:
    """(block, size, data): texts of some bytes as a Block writes them, named by the first rid, from (rid, id, train, text)."""
    most = BLOCK_BYTES

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", most):
                size = pc.sum(pc.binary_length(part.column(3))).as_py()
                yield pa.RecordBatch.from_arrays([part.column(0)[:1], pa.array([size]), pa.array([Block.write(part)], pa.binary())], ["block", "size", "data"])

    return rows.mapInArrow(run, "block long, size long, data binary")


def _ask(blocks: DataFrame, bits: int, orders: range) -> DataFrame:
    """Each block's questions: hashes of n-grams of these orders, and how often it met them in training."""
    fields = "slot int, block long, u binary, n binary"

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b, out = Block(data.as_py(), orders[-1]), []
                train = b.rows.column("train").to_numpy().astype(bool)[b.row]
                for k in orders:
                    level = b.levels[k - 1]
                    count = np.bincount(level.at[train & (level.at >= 0)], minlength=len(level.key))
                    out += [(_slot(bucket, k), block, pack_sorted(level.key[u]), pack(count[u])) for bucket, u in level.buckets(bits)]
                out = _packed(out, fields)
                del b, train, level, count
                give_back()
                yield out

    return blocks.select("block", "data").mapInArrow(run, fields)


def _add_up(asked: DataFrame, orders: int) -> DataFrame:
    """Each slot's sums: how many n-grams were met once, twice.. (n; at 0 all their counts, at -1 how many there are),
    and for each block the counts of its n-grams, fourfold, and two more where it alone has them, one more where it owns
    them (r). o numbers, in the order of their hashes, those that other blocks have too, if they are contexts."""
    fields = "kind string, slot int, block long, h long, c long, a binary, o binary"

    def added(table: pa.Table) -> pa.RecordBatch:
        slot = table.column("slot")[0].as_py()
        first_order, top = slot % (1 << ORDERS) == 1, slot % (1 << ORDERS) == orders
        keys = [unpack_sorted(x.as_py()) for x in table.column("u")]
        said = [unpack(x.as_py()).view(np.int64) for x in table.column("n")]  # counts; a range that is done has the answers
        numbers: list[list[np.ndarray]] = [[] for _ in keys]
        least, most = min(int(x[0]) for x in keys), max(int(x[-1]) for x in keys)
        n = -(-sum(map(len, keys)) // RANGE)
        edges = np.array([least + (most - least) * j // n for j in range(1, n)], U)
        cuts = np.array([[0, *np.searchsorted(x, edges).tolist(), len(x)] for x in keys])
        types = total = common = 0
        met = np.zeros(LARGE + 2, np.int64)
        for a, b in zip(cuts.T[:-1], cuts.T[1:], strict=True):
            if not (b > a).any():
                continue
            key, m = (np.concatenate([x[i:j] for x, i, j in zip(xs, a, b, strict=True)]) for xs in (keys, said))
            order = np.argsort(key, kind="stable")
            key, m = key[order], m[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            sums = np.add.reduceat(m, first)
            upto = np.cumsum(m) - m
            owns = (m > 0) & (upto == np.repeat(upto[first], size))
            answer = np.empty(len(key), np.int64)
            answer[order] = np.repeat(sums * 4 + 2 * (size == 1), size) + owns
            number = np.empty(len(key), np.int64)
            number[order] = np.repeat(np.where(size > 1, np.cumsum(size > 1) - 1 + common, -1), size)
            real = sums[(sums > 0) & (key[first] != START)] if first_order else sums[sums > 0]
            types, total, common = types + len(real), total + int(real.sum()), common + int((size > 1).sum())
            met += np.bincount(real[real <= LARGE + 1], minlength=LARGE + 2)
            at = 0
            for x, mine, i, j in zip(said, numbers, a, b, strict=True):
                x[i:j], own, at = answer[at : at + j - i], number[at : at + j - i], at + j - i
                if not top:
                    mine.append(own[own >= 0].astype(U))
        del keys
        out = [("n", slot, None, h, c, None, None) for h, c in [(-1, types), (0, total), *list(enumerate(met.tolist()))[1:]]]
        for block, x, mine in zip(table.column("block").to_pylist(), said, numbers, strict=True):
            out.append(("r", slot, block, None, None, pack(x), None if top else pack_sorted(np.concatenate(mine))))
        return _packed(out, fields)

    return asked.repartition("slot").sortWithinPartitions("slot").mapInArrow(lambda batches: grouped(batches, "slot", added), fields)


def _weigh(parts: DataFrame) -> DataFrame:
    """(slot, half, t, blocks, u): tallies added up for each context by its number, and what each block of a half asks of
    them."""
    fields = "slot int, half int, t binary, blocks array<long>, u array<binary>"

    def added(table: pa.Table) -> pa.RecordBatch:
        asked = [unpack_sorted(x.as_py()).astype(np.int64) for x in table.column("u")]
        sums = np.zeros((2, LARGE + 1, 1 + max(int(x[-1]) for x in asked)), np.int64)
        for at, t in zip(asked, table.column("t"), strict=True):  # a block asks once for a number
            sums[:, :, at] += unpack_tally(t.as_py())
        slot, data, half, out = table.column("slot")[0].as_py(), pack(sums), table.column("half").to_numpy(), []
        for k in np.unique(half).tolist():
            mine = table.filter(pa.array(half == k))
            out.append((slot, k, data, mine.column("block").to_pylist(), mine.column("u").to_pylist()))
        return _packed(out, fields)

    return parts.repartition("slot").sortWithinPartitions("slot").mapInArrow(lambda batches: grouped(batches, "slot", added), fields)


def _tell(weighed: DataFrame) -> DataFrame:
    """(slot, block, t): the tallies for which each block asks, in the order of its question."""
    fields = "slot int, block long, t binary"

    def run(batches):
        for batch in batches:
            for slot, t, blocks, u in zip(*(batch.column(c) for c in ("slot", "t", "blocks", "u")), strict=True):
                sums = unpack_tally(t.as_py())
                out = [(slot.as_py(), block, pack(sums[:, :, unpack_sorted(x).astype(np.int64)])) for block, x in zip(blocks.as_py(), u.as_py(), strict=True)]
                out = _packed(out, fields)
                del sums
                give_back()
                yield out

    return weighed.select("slot", "t", "blocks", "u").mapInArrow(run, fields)


def _read(table: pa.Table, k: int, column: str) -> list[bytes]:
    """What the slots of an order answered, in order of bucket."""
    slot = table.column("slot").to_numpy()
    at = np.flatnonzero(slot % (1 << ORDERS) == k)
    return table.column(column).take(pa.array(at[np.argsort(slot[at], kind="stable")])).to_pylist()


def discounts(met: dict[int, int]) -> list[float]:
    """Katz's discounts of counts 1 to LARGE from how many types were met once, twice and so on; 1 where they give none."""
    n = [0, *[met.get(r, 0) for r in range(1, LARGE + 2)]]
    if not n[1]:
        return [1.0] * LARGE
    share = (LARGE + 1) * n[LARGE + 1] / n[1]
    out = []
    for r in range(1, LARGE + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if n[r] and share < 1 else 1.0
        out.append(d if 0 < d < 1 else 1.0)
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, least: int = LEAST) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Learns n-grams up to order (7 at most) from rows whose crc32(id as text) mod 7 is not 2; bigrams and longer ones met
    less often than least back off. Tokens are lower-cased (A-Z) words and one end; a null or empty text has the end
    alone. Scores are log10 probabilities. A word never met has what discounts leave of the words' mass, and if they
    leave none, as much as half a token. Rows that repeat an id, null ids too, are texts of their own; the remainder of
    a null id is 0. An empty table gives no rows; other columns are not read.
    """
    kind = id_kind(docs, id_col)
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rest = crc_mod(F.col("id"), FOLDS)
    blocks = materialise(_cut(with_row_ids(docs, id_col, text_col).select("rid", "id", (rest != HELD_OUT).alias("train"), "text")), "blocks")
    size = blocks.agg(F.sum("size")).first()[0]
    if size is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    bits = max(0, (-(-size // BLOCK_BYTES) // BLOCKS_A_BUCKET).bit_length())
    # The longest n-grams are most of all: what was shuffled for the others is gone before they are asked for.
    asked = [x for x in (range(1, order), range(order, order + 1)) if x]
    added = [materialise(_add_up(_ask(blocks, bits, x), order), "katz") for x in asked]
    found = reduce(DataFrame.unionByName, added)
    met = found.where("kind = 'n'").groupBy((F.col("slot") % (1 << ORDERS)).alias("k"), "h").agg(F.sum("c").alias("c")).collect()  # LARGE + 3 rows an order
    met = {(r["k"], r["h"]): r["c"] for r in met}
    tables = []  # by order, the discounted counts up to LARGE
    for k in range(1, order + 1):
        tables.append(np.array([0.0, *[r * d for r, d in enumerate(discounts({r: met.get((k, r), 0) for r in range(1, LARGE + 2)}), 1)]]))
    n_tokens, v = met.get((1, 0), 0), met.get((1, -1), 0)
    kept = sum((r - tables[0][r]) * met.get((1, r), 0) for r in range(1, LARGE + 1))
    n_all = n_tokens if kept else n_tokens + 0.5  # without discounts half a token is left for what was never met
    unknown = (kept or 0.5) / n_all if n_tokens else 1.0

    def shrunk(c: np.ndarray, k: int) -> np.ndarray:
        """Discounted counts of order k; none of those that back off."""
        out = np.where(c <= LARGE, tables[k - 1][np.minimum(c, LARGE)], c)
        return np.where(c >= least, out, 0.0) if k > 1 else out

    class Counted:
        """A block with the counts of its n-grams, and what its own n-grams give to their contexts."""

        def __init__(self, table: pa.Table):
            turn = table.column("turn").to_numpy()
            self.b = Block(table.filter(pa.array(turn == 0)).column("a")[0].as_py(), order)
            said = table.filter(pa.array(turn == 1))
            both = [np.concatenate([np.zeros(0, U), *map(unpack, _read(said, k, "a"))]).astype(np.int64) for k in range(1, order + 1)]
            self.c = [x >> 2 for x in both]
            self.own, self.asks, self.numbers = [], [], []
            for k in range(1, order):
                up, level, c = self.b.levels[k], self.b.levels[k - 1], self.c[k - 1]
                has = np.zeros(len(c), bool)
                has[up.ctx] = True
                # A context that no other block has is followed by what is here alone.
                common = both[k - 1] & 2 == 0
                self.asks.append(has & (c > 0) & common)
                number = np.full(len(c), -1, np.int64)
                number[common] = np.concatenate([np.zeros(0, U), *map(unpack_sorted, _read(said, k, "o"))])
                self.numbers.append(number)
                self.own.append(np.flatnonzero((both[k] & 1 == 1) & (self.c[k] >= least)))

        def given(self, k: int) -> np.ndarray:
            """What the block's own n-grams of order k + 1 give to their contexts: tallies of their counts and of the next
            lower order's."""
            up, c, mine = self.b.levels[k], self.c[k - 1], self.own[k - 1]
            out = np.empty((2, LARGE + 1, len(c)), np.int64)
            for part, x in zip(out, (self.c[k][mine], c[up.low[mine]]), strict=True):
                part[:] = tallies(up.ctx[mine], x, len(c))
            return out

    def share(table: pa.Table) -> pa.Table:
        x, out = Counted(table), []
        block = table.column("block")[0].as_py()
        for k, (asked, number) in enumerate(zip(x.asks, x.numbers, strict=True), 1):
            parts, number, upto = x.given(k)[:, :, asked], number[asked].astype(U), np.concatenate(([0], np.cumsum(asked)))
            for bucket, u in x.b.levels[k - 1].buckets(bits):
                a, b = upto[u.start], upto[u.stop]
                if a < b:
                    out.append((_slot(bucket, k), block, pack_sorted(number[a:b]), pack(parts[:, :, a:b])))
        return pa.Table.from_batches([_packed(out, shared)])

    def run(table: pa.Table, weights: pa.Table) -> pa.Table:
        x = Counted(table)
        b, c = x.b, x.c
        p = np.where(c[0] > 0, shrunk(c[0], 1) / n_all if n_tokens else 0.0, unknown)
        log, scale = np.zeros(len(b.row)), None
        for k, asked in enumerate(x.asks, 1):
            up, below, parts = b.levels[k], scale, x.given(k)
            places, at = np.flatnonzero(asked), 0
            for t in map(unpack_tally, _read(weights, k, "t")):
                parts[:, :, places[at : at + t.shape[2]]] = t
                at += t.shape[2]
            assert at == len(places)
            # Discounted; lower orders' counts as they are, contexts multiply them with their own scale.
            mass, low = (np.append(1.0, tables[y][1:]) @ part for y, part in zip((k, k - 1), parts, strict=True))
            some = mass > 0
            total = np.maximum(c[k - 1], 1)
            # 1 / count, less where discounts would leave no mass for the rest.
            scale = np.where(some, np.minimum(1.0, (total - 0.5) / np.where(some, mass, 1.0)) / total, 1.0)
            low = low * (1 / n_all if k == 1 else below[b.levels[k - 1].low])
            alpha = np.where(some, (1 - mass * scale) / np.maximum(1 - low, 1e-12), 1.0)
            own = shrunk(c[k], k + 1)
            p = np.where(own > 0, own * scale[up.ctx], alpha[up.ctx] * p[up.low])
            ends = np.flatnonzero(up.at >= 0)
            log[ends] = np.log10(np.maximum(p, 1e-300))[up.at[ends]]
        known = c[0][b.levels[0].at[b.token]]
        sums = [np.concatenate(([0.0], np.cumsum(y))) for y in (log[b.token], np.log10((known + 1.0) / (n_tokens + v + 1.0)), known > 0)]
        stop = np.concatenate((b.first[1:], [len(known)]))
        said = [y[stop] - y[b.first] for y in sums]
        train = b.rows.column("train").to_numpy().astype(bool)
        values = [b.rows.column("id").combine_chunks(), ~train, stop - b.first, said[2].astype(np.int64), np.full(len(stop), n_tokens), said[1], said[0]]
        return pa.table([y if isinstance(y, pa.Array) else pa.array(y) for y in values], names)

    shared = "slot int, block long, u binary, t binary"
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    texts = blocks.select("block", F.lit(0).alias("turn"), F.lit(0).alias("slot"), F.col("data").alias("a"), F.lit(None).cast("binary").alias("o"))
    answers = found.where("kind = 'r'").select("block", F.lit(1).alias("turn"), "slot", "a", "o")
    base, half = texts.unionByName(answers), F.pmod(F.xxhash64("block"), F.lit(HALVES)).cast("int")
    weighed = materialise(_weigh(base.groupBy("block").applyInArrow(lambda table: then_give_back(share(table)), shared).withColumn("half", half)), "sums")
    done = []
    for k in range(HALVES):
        told = _tell(weighed.where(F.col("half") == k))
        done.append(materialise(base.where(half == k).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda table, weights: then_give_back(run(table, weights)), schema), "scores"))
    release(blocks, weighed, *added)
    return reduce(DataFrame.unionByName, done).withColumnRenamed("id", id_col)
