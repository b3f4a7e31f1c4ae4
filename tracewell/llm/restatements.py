"""Records that restate each other with small edits: groups over the overlap of their word sets.

Two texts are alike if the words they share are at least ``share`` of the words of the smaller one.

1. Texts with equal word sets are one class, tied to its smallest id; all further work is on one record a class.
2. MinHash LSH forest: in each of ``TREES`` sorted prefix tries of MinHash labels (words weighted by rarity, so that
   stock phrases do not collide) a record meets those that share its longest prefixes; prefixes are shortened level by
   level while the node stays small. Crowded nodes give few of their pairs, and ``tree_recall`` gives the collision
   curve, so no pair is left to the tries alone: what they find is found by step 3 as well.
3. The collision curve depends on the Jaccard similarity, which falls to share / (r + 1 - share) for texts whose
   sizes differ by a factor r, and on rare words. All pairs are therefore found exactly: a set of n words that lacks at
   most m = n - ceil(share * n) in its partner is dealt into m + 1 groups led by its rarest words; at least one group
   lies wholly in the partner. A group led by a rare word is that word alone, and is tested by its posting list. Groups
   led by a frequent word are tested by bit maps within the records that hold that word, in blocks of bounded size; a
   pair that shares no leading rare word must reach the share by frequent words, so these are counted there.
4. All other candidates are verified on the word sets, and the links become groups.

Words are compared as 32-bit hashes, so two different words of one pair are taken as equal with odds of about 3e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import connected_groups, star_pairs
from tracewell.runtime import cut, release

TREES, DEPTH = 10, 6
#: Prefixes are shortened until a pair of this weighted similarity meets with this chance.
SIMILARITY, RECALL = 0.6, 0.9
#: Members of a trie node up to which all its pairs are candidates; larger nodes are told apart by longer prefixes.
NODE = 6
#: A word is frequent if this share of the sets hold it; at most mean size / share words are, whatever the corpus.
FREQUENT = 0.001
#: Records of one block of a leading word, guests that are tested at once, and words of a group that are looked up before the rest are counted.
BLOCK_ROWS, GUESTS, GROUP = 131072, 32768, 6
#: All bytes but those of [0-9a-z] become spaces; every byte of a letter outside ASCII is one of them.
APART = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for c in range(256))


def tree_recall(s: float, depth: int, trees: int = TREES) -> float:
    """Chance that a pair of weighted similarity ``s`` shares a prefix of ``depth`` in one of the tries."""
    return 1 - (1 - s**depth) ** trees


#: The longest prefix length that reaches the recall wanted.
LEAST_DEPTH = max(d for d in range(1, DEPTH + 1) if tree_recall(SIMILARITY, d) >= RECALL)


def word_sets(texts: DataFrame, id_col: str, text_col: str, least_runs: int) -> DataFrame:
    """(id, k1, k2, n, words): the distinct words of each text as sorted 32-bit hashes, and a 128-bit key of the set.

    Null texts and texts with fewer than ``least_runs`` words, counting repeats, are left out; texts of any length
    are read whole.
    """
    import xxhash

    src = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("id is not null and t is not null")

    class Hashes(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) > 1_000_000:
                self.clear()
            code = self[word] = xxhash.xxh32_intdigest(word)
            return code

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for b in batches:
            keep, k1, k2, size, words = [], [], [], [], []
            for at, t in enumerate(b.column(1).to_pylist()):
                runs = t.lower().encode("utf-8", "replace").translate(APART).split()
                if len(runs) < least_runs:
                    continue
                row = {known[w] for w in set(runs)}
                raw = np.sort(np.fromiter(row, np.uint32, len(row))).tobytes()
                key = xxhash.xxh3_128_digest(raw)
                keep.append(at)
                k1.append(int.from_bytes(key[:8], "little", signed=True))
                k2.append(int.from_bytes(key[8:], "little", signed=True))
                size.append(len(row))
                words.append(raw)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(size, pa.int32()), pa.array(words, pa.binary())],
                names=["id", "k1", "k2", "n", "words"],
            )

    return src.mapInArrow(parse, f"id {src.schema['id'].dataType.simpleString()}, k1 long, k2 long, n int, words binary")


def _joined(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed binaries, and the start of each row (one more than rows)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind) if len(column) and offsets[-1] > offsets[0] else np.zeros(0, kind)
    return data, (offsets - offsets[0]) // width


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer((starts * width).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _ramp_of(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each count in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _deltas(row: np.ndarray, code: np.ndarray, rows: int) -> pa.Array:
    """Rising codes of each row as bytes: the step to the next code, each 255 in it as a byte that adds on."""
    step = np.diff(code, prepend=0)
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    step[first] = code[first]
    over = step // 255
    width = over + 1
    out = np.full(width.sum(), 255, np.uint8)
    out[np.cumsum(width) - 1] = step % 255
    return _packed(out, np.r_[0, np.cumsum(np.bincount(row, weights=width, minlength=rows).astype(np.int64))])


def _undelta(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all rows and the start of each row."""
    raw, starts = _joined(column, np.uint8)
    total = np.r_[0, np.cumsum(raw.astype(np.int64))]
    ends = raw != 255
    before = np.repeat(total[starts[:-1]], np.diff(starts))
    count = np.r_[0, np.cumsum(ends)]
    return (total[1:] - before)[ends], count[starts]


def frequent_words(sets: DataFrame, total: int, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the frequent words, rarest first; counts cover all sets and are combined before the shuffle."""
    least = max(2.0, total * max(FREQUENT, mean / 32768))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(_joined(b.column(0), np.uint32)[0])
            size += len(held[-1])
            if size > 4_000_000:
                yield _counts(held)
                held, size = [], 0
        if held:
            yield _counts(held)

    def _counts(held: list[np.ndarray]) -> pa.RecordBatch:
        w, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(c.astype(np.int64))], names=["w", "c"])

    rows = sets.select("words").mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).orderBy("c", "w").collect()
    return np.array([r["w"] for r in rows], np.uint32), np.array([r["c"] for r in rows], np.int64)


def _codes(words: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Place of each word in ``freq`` (rarest first), or -1."""
    if not len(freq):
        return np.full(len(words), -1, np.int32)
    o = np.argsort(freq, kind="stable")
    at = np.minimum(np.searchsorted(freq[o], words), len(freq) - 1)
    return np.where(freq[o][at] == words, o[at], -1).astype(np.int32)


def forest_pairs(sets: DataFrame, freq: np.ndarray, counts: np.ndarray, total: int) -> DataFrame:
    """(a, b) of records (rid, words) that share a small node of one of the prefix tries."""
    rng = np.random.default_rng(2024)
    funcs = TREES * DEPTH
    mul, add = (rng.integers(0, 2**32, funcs, np.uint32) for _ in range(2))
    mul |= np.uint32(1)
    rare = math.log(max(total, 2) / max(1.0, 0.1 * FREQUENT * total)) ** 2
    weight = np.maximum(0.5, np.log(max(total, 2) / np.maximum(counts, 1)) ** 2).astype(np.float32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0).to_numpy()
            w, starts = _joined(b.column(1), np.uint32)
            if not len(rid):
                continue
            code = _codes(w, freq)
            scale = np.where(code >= 0, -1.0 / weight[code], -1.0 / np.float32(rare)).astype(np.float32) if len(freq) else np.full(len(w), -1.0 / np.float32(rare), np.float32)
            mixed = (w ^ (w >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            mixed ^= mixed >> np.uint32(12)
            for t in range(TREES):
                label = []
                for k in range(t * DEPTH, (t + 1) * DEPTH):
                    x = mixed * mul[k] + add[k]
                    u = (x >> np.uint32(8)).astype(np.float32)
                    u += np.float32(0.5)
                    u *= np.float32(2.0**-24)
                    np.log(u, out=u)
                    u *= scale
                    least = np.minimum.reduceat(u, starts[:-1]).view(np.uint32)
                    label.append(((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.uint64(t) << np.uint64(32) | label[0] << np.uint64(16) | label[1]).astype(np.int64)), pa.array((label[2] << np.uint64(48) | label[3] << np.uint64(32) | label[4] << np.uint64(16) | label[5]).view(np.int64)), pa.array(rid)],
                    names=["head", "tail", "rid"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by label; a run of one head is walked from long prefixes to short ones."""
        rest: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(3)]
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            run = cols[0] != cols[0][-1]
            last = int(np.nonzero(run)[0][-1]) + 1 if run.any() else 0
            if last == 0 and len(cols[0]) > 2_000_000:  # one head larger than that is handed on in parts that keep their last rows
                yield _pairs(cols)
                rest = [c[-NODE:] for c in cols]
                continue
            if last:
                yield _pairs([c[:last] for c in cols])
            rest = [c[last:] for c in cols]
        if rest is not None and len(rest[0]):
            yield _pairs(rest)

    def _pairs(cols: list[np.ndarray]) -> pa.RecordBatch:
        head, tail, rid = cols
        tail = tail.view(np.uint64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for depth in range(DEPTH, LEAST_DEPTH - 1, -1):
            part = tail >> np.uint64(16 * (DEPTH - depth))
            new = np.r_[True, (part[1:] != part[:-1]) | (head[1:] != head[:-1])]
            node = np.cumsum(new) - 1
            size = np.bincount(node)[node]
            for gap in range(1, NODE):
                ok = node[gap:] == node[:-gap]
                if depth < DEPTH:
                    ok &= size[gap:] <= NODE
                if depth < DEPTH and depth + 1 <= DEPTH:
                    deeper = tail >> np.uint64(16 * (DEPTH - depth - 1))
                    ok &= deeper[gap:] != deeper[:-gap]  # those met one level down
                left.append(rid[:-gap][ok])
                right.append(rid[gap:][ok])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    labels = sets.select("rid", "words").mapInArrow(sign, "head long, tail long, rid long")
    return labels.repartition("head").sortWithinPartitions("head", "tail", "rid").mapInArrow(meet, "a long, b long").filter("a != b").distinct()


def _lacking(n: np.ndarray, share: float) -> np.ndarray:
    """Words that a set of n may lack in its partner."""
    return n - np.ceil(share * n - 1e-9).astype(np.int64)


class _Union:
    """Union-find over the rows of one block."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join_all(self, x: int, others: np.ndarray) -> None:
        """x and all others are one set then."""
        sets = np.unique(self.roots()[others] if len(others) > 64 else [self.root(y) for y in others])
        own = self.root(x)
        least = min(own, int(sets[0]))
        self.up[sets] = least
        self.up[own] = least

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


class _Rows:
    """Records of a block, as they come from the shuffle, with their frequent codes, rarest first."""

    def __init__(self, parts: list[pa.RecordBatch], leader: int, share: float, largest_first: bool) -> None:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        if largest_first:
            t = t.take(pa.array(np.argsort(-t.column(2).to_numpy(), kind="stable")))
        meta = t.column(2).to_numpy()
        self.rid, self.n, leads = t.column(1).to_numpy(), meta >> 2, meta & 2 > 0
        self.code, starts = _undelta(t.column(3))
        many = np.diff(starts)
        self.row = np.repeat(np.arange(len(many)), many)
        self.need = np.ceil(share * self.n - 1e-9).astype(np.int64)
        self.who = np.nonzero(leads)[0]
        self.who = self.who[np.argsort(-self.n[self.who], kind="stable")]
        # the group of the leading word: that word, and every leaders-th of the words behind the leaders
        place = _ramp_of(many)
        leaders = np.clip(_lacking(self.n, share) + 1 - (self.n - many), 0, many)
        turn = np.zeros(len(many), np.int64)
        at = self.code == leader
        turn[self.row[at]] = place[at]
        per = np.maximum(leaders, 1)[self.row]
        mine = leads[self.row] & ((place == turn[self.row]) | ((place >= leaders[self.row]) & ((place - leaders[self.row] - turn[self.row]) % per == 0)))
        size = np.bincount(self.row[mine], minlength=len(many))
        rank = _ramp_of(size)
        first = rank < GROUP
        self.groups = np.full((len(many), GROUP), -1, np.int64)
        self.groups[self.row[mine][first], rank[first]] = self.code[mine][first]


class _Home:
    """Records of one block as bit maps: ``bits`` has the records that hold a word, ``byrow`` the words of a record.

    Larger sets come first, so that the partners of a set are looked for among the first records only.
    """

    def __init__(self, parts: list[pa.RecordBatch], leader: int, share: float, codes: int) -> None:
        self.leader, self.share = leader, share
        self.rows = _Rows(parts, leader, share, True)
        held = len(self.rows.rid)
        used = np.zeros(codes, bool)
        used[self.rows.code] = True
        used = np.nonzero(used)[0]
        # words that no record of the block holds have a row of zeros, and what is missing in a group one of ones
        self.local = np.full(codes + 1, len(used), np.int64)
        self.local[used] = np.arange(len(used))
        self.local[-1] = len(used) + 1
        self.words = -(-(len(used) + 1) // 64) * 64
        wide = -(-held // 64) * 8
        bits = np.zeros((len(used) + 2, wide), np.uint8)
        bits[-1] = 255
        self.byrow = np.zeros((held, self.words // 64), np.uint64)
        ends = np.searchsorted(self.rows.row, np.arange(0, held + 8192, 8192))
        for k, lo in enumerate(range(0, held, 8192)):
            hi = min(held, lo + 8192)
            dense = self._dense(self.rows.row[ends[k] : ends[k + 1]] - lo, self.rows.code[ends[k] : ends[k + 1]], hi - lo)
            self.byrow[lo:hi] = np.packbits(dense, axis=1, bitorder="little").view(np.uint64)
            some = np.packbits(dense, axis=0, bitorder="little").T
            bits[: len(used), lo // 8 : lo // 8 + some.shape[1]] = some[: len(used)]
        self.bits = bits.view(np.uint64)
        self.union = _Union(held)

    def _dense(self, row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
        """Words of records; those that the block does not have share one place beyond the others."""
        dense = np.zeros((rows, self.words), bool)
        dense[row, self.local[code]] = True
        return dense

    def meet(self, guests: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        """Ties guests, or the home records themselves if there are none, to home records; a star link for each guest tied."""
        held = len(self.rows.rid)
        if not guests:
            self._probe(self.rows, self.byrow, 0)
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = _Rows(guests, self.leader, self.share, False)
        dense = self._dense(rows.row, rows.code, len(rows.rid))
        self.union.up = np.r_[self.union.roots(), np.arange(held, held + len(rows.rid))]
        self._probe(rows, np.packbits(dense, axis=1, bitorder="little").view(np.uint64), held)
        roots = self.union.roots()
        own = roots[held:]
        self.union.up = roots[:held]  # the root of a set is its first row
        tied = np.nonzero(own < held)[0]
        return rows.rid[tied], self.rows.rid[own[tied]]

    def _probe(self, own: _Rows, byrow: np.ndarray, base: int) -> None:
        """Ties the leading records of ``own`` to their partners; ``base`` is the place of the first of them in the union."""
        home, lo = self.rows, 0
        groups = self.local[own.groups]
        due = 0
        while lo < len(own.who):
            if lo >= due:
                roots, due = self.union.roots(), lo + 4096
                large = np.bincount(roots) > 64
            some = own.who[lo : lo + 256]
            limit = int(np.searchsorted(-home.n, -own.n[some[-1]], side="right"))
            wide = -(-limit // 64)
            masks = self.bits[groups[some, 0], :wide]
            for k in range(1, int((own.groups[some] >= 0).sum(1).max())):
                masks &= self.bits[groups[some, k], :wide]
            # partners that are tied to a record already need no second look
            mine = roots[base + some]
            for r in np.unique(mine[large[mine]]):
                same = np.zeros(wide * 64, bool)
                same[:limit] = roots[:limit] == r
                masks[mine == r] &= ~np.packbits(same, bitorder="little").view(np.uint64)
            found = np.cumsum(np.bitwise_count(masks).sum(1, dtype=np.int64))
            take = max(1, int(np.searchsorted(found, 1_000_000)))
            some, masks, lo = some[:take], masks[:take], lo + min(take, len(some))
            k, x = np.nonzero(masks)
            if not len(k):
                continue
            h, bit = np.nonzero(np.unpackbits(masks[k, x].view(np.uint8).reshape(len(k), 8), axis=1, bitorder="little"))
            s, o = some[k[h]], x[h] * 64 + bit
            ok = ((home.n[o] > own.n[s]) | ((home.n[o] == own.n[s]) & (home.rid[o] > own.rid[s]))) & (roots[base + s] != roots[o])
            s, o = s[ok], o[ok]
            ok = np.zeros(len(s), bool)
            for i in range(0, len(s), 65536):
                part = slice(i, i + 65536)
                ok[part] = np.bitwise_count(byrow[s[part]] & self.byrow[o[part]]).sum(1, dtype=np.int64) >= own.need[s[part]]
            s, o = s[ok], o[ok]
            cuts = np.r_[0, np.nonzero(s[1:] != s[:-1])[0] + 1, len(s)] if len(s) else np.zeros(1, int)
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                self.union.join_all(base + s[i], o[i:j])
            if len(h) > 100_000:
                due = lo

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """What is tied together among the home records, as a star to the smallest of each set."""
        roots = self.union.roots()
        least = np.full(len(roots), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, self.rows.rid)
        tied = np.nonzero(least[roots] != self.rows.rid)[0]
        return self.rows.rid[tied], least[roots[tied]]


def contained_pairs(sets: DataFrame, freq: np.ndarray, counts: np.ndarray, share: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) of records (rid, n, words) that are tied by their frequent words alone.

    A set of n words that shares none of its leading rare words lacks all of them, so its frequent words reach ``share``
    by themselves, or ``rare_pairs`` has the pair. A group led by a frequent word is looked up as a whole among the
    records that hold the word, and the frequent words shared are counted. What is tied in a block comes out as a star,
    so that a large group of restatements gives a row a record, not a row a pair. Each record that leads goes to all
    blocks of its word; blocks are large, since that is what grows faster than the records.
    """
    if not len(freq):
        return sets.select(F.col("rid").alias("a"), F.col("rid").alias("b")).limit(0)
    blocks = np.maximum(1, -(-counts // block_rows))

    def parts(w: np.ndarray, starts: np.ndarray, n: np.ndarray):
        """Frequent codes of each row, rarest first, with row and place, and the number of leaders of each row."""
        code = _codes(w, freq)
        row = np.repeat(np.arange(len(n)), np.diff(starts))
        row, code = row[code >= 0], code[code >= 0]
        o = np.lexsort((code, row))
        row, code = row[o], code[o]
        many = np.bincount(row, minlength=len(n))
        place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        leaders = np.clip(_lacking(n, share) + 1 - (n - many), 0, many)
        return row, code, place, leaders

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(freq), np.iinfo(np.int64).max)
        for b in batches:
            w, starts = _joined(b.column(1), np.uint32)
            n = b.column(0).to_numpy().astype(np.int64)
            row, code, place, leaders = parts(w, starts, n)
            led = place < leaders[row]
            np.minimum.at(least, code[led], n[row[led]])
        at = np.nonzero(least < np.iinfo(np.int64).max)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(least[at])], names=["code", "n"])

    # the smallest set that each word leads; smaller records are nobody's partners there
    lead = np.full(len(freq), np.iinfo(np.int64).max)
    for r in sets.select("n", "words").mapInArrow(leading, "code long, n long").groupBy("code").agg(F.min("n").alias("n")).collect():
        lead[r["code"]] = r["n"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A record goes to each leading word it holds, in one block; where it leads itself, to all blocks."""
        for b in batches:
            rid, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            w, starts = _joined(b.column(2), np.uint32)
            row, code, place, leaders = parts(w, starts, n)
            packed = _deltas(row, code, len(n))
            pick = lead[code] <= n[row]
            row, code, own = row[pick], code[pick], place[pick] < leaders[row[pick]]
            copies = np.where(own, blocks[code], 1)
            home = rid[row] % blocks[code]
            each = np.repeat(np.arange(len(row)), copies)
            shift = _ramp_of(copies)
            block = (home[each] + shift) % blocks[code[each]]
            at = row[each]
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[each].astype(np.int64) << 32 | block), pa.array(rid[at]), pa.array((n[at] << 2 | own[each] << 1 | (shift == 0)).astype(np.int64)), packed.take(pa.array(at)).cast(pa.binary())],
                names=["key", "rid", "meta", "codes"],
            )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: of each block first those at home, which are held, then visitors, taken in bounded parts."""
        now, held, guests, waiting, home = None, [], [], 0, None
        for b in batches:
            key, here = b.column(0).to_numpy(), b.column(2).to_numpy() & 1
            edge = np.r_[0, np.nonzero((key[1:] != key[:-1]) | (here[1:] != here[:-1]))[0] + 1, len(key)] if len(key) else np.zeros(1, int)
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if key[lo] != now:
                    yield from _finish(now, held, guests, home)
                    now, held, guests, waiting, home = key[lo], [], [], 0, None
                part = b.slice(lo, hi - lo)
                if here[lo]:
                    held.append(part)
                    continue
                guests.append(part)
                waiting += hi - lo
                if waiting >= GUESTS and held:
                    home = home or _settled(now, held)
                    yield _links(*home.meet(guests))
                    guests, waiting = [], 0
        yield from _finish(now, held, guests, home)

    def _settled(key: int, held: list[pa.RecordBatch]) -> _Home:
        home = _Home(held, int(key) >> 32, share, len(freq))
        home.meet([])
        return home

    def _finish(key: int | None, held: list[pa.RecordBatch], guests: list[pa.RecordBatch], home: _Home | None) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        home = home or _settled(key, held)
        if guests:
            yield _links(*home.meet(guests))
        yield _links(*home.stars())

    def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    routed = sets.select("rid", "n", "words").mapInArrow(spread, "key long, rid long, meta long, codes binary")
    return routed.repartition("key").sortWithinPartitions(F.col("key"), F.expr("meta & 1").desc()).mapInArrow(test, "a long, b long").distinct()


def rare_pairs(sets: DataFrame, freq: np.ndarray, share: float) -> DataFrame:
    """(a, b) of records (rid, n, words) of which the smaller has one of its m + 1 groups led by a word that is not
    frequent, and that word is in the larger.

    Every record is posted under each of its rare words; up to m + 1 of them lead. All pairs of a posting list are
    compared, by 256-bit sketches: each bit of the smaller that the larger has not is a word it lacks, so a pair is left
    out only if more than m words are lacking for certain. A list has fewer rows than a word needs to be frequent.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            w, starts = _joined(b.column(2), np.uint32)
            if not len(w):
                continue
            spot = ((w * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint64)
            bit = np.uint64(1) << (spot & np.uint64(63))
            sketch = [np.bitwise_or.reduceat(np.where(spot >> np.uint64(6) == q, bit, np.uint64(0)), starts[:-1]).view(np.int64) for q in range(4)]
            rare = _codes(w, freq) < 0
            row = np.repeat(np.arange(len(n)), np.diff(starts))[rare]
            place = _ramp_of(np.bincount(row, minlength=len(n)))
            lead = place <= _lacking(n, share)[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(w[rare].view(np.int32)), pa.array(rid[row]), pa.array((n[row] << 1 | lead).astype(np.int32)), *(pa.array(x[row]) for x in sketch)],
                names=["word", "rid", "meta", "s0", "s1", "s2", "s3"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by word; the last word of a batch waits for the next."""
        rest: list[list[np.ndarray]] = []
        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(7)]
            if not len(cols[0]):
                continue
            start = int(np.searchsorted(cols[0], cols[0][-1]))
            if rest and (start > 0 or cols[0][0] != rest[0][0][-1]):
                yield from _lists([np.concatenate(c) for c in zip(*rest, [c[:start] for c in cols], strict=True)])
                rest = []
            elif start:
                yield from _lists([c[:start] for c in cols])
            rest.append([c[start:] for c in cols])
        if rest:
            yield from _lists([np.concatenate(c) for c in zip(*rest, strict=True)])

    def _lists(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        word, rid, meta, *sketch = cols
        sketch = [x.view(np.uint64) for x in sketch]
        n = (meta >> 1).astype(np.int64)
        most = _lacking(n, share)
        edge = np.r_[np.nonzero(word[1:] != word[:-1])[0] + 1, len(word)]
        end = np.repeat(edge, np.diff(np.r_[0, edge]))
        alive, gap, a, b, held = np.arange(len(word)), 1, [], [], 0
        while len(alive := alive[alive + gap < end[alive]]):
            i, j = alive, alive + gap
            swap = (n[i] > n[j]) | ((n[i] == n[j]) & (rid[i] > rid[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            leads = meta[i] & 1 > 0
            i, j = i[leads], j[leads]
            lacks = np.zeros(len(i), np.int64)
            for x in sketch:
                lacks += np.bitwise_count(x[i] & ~x[j])
                ok = lacks <= most[i]
                i, j, lacks = i[ok], j[ok], lacks[ok]
            a.append(rid[i])
            b.append(rid[j])
            held, gap = held + len(i), gap + 1
            if held > 1_000_000:
                yield _two(a, b)
                a, b, held = [], [], 0
        if held:
            yield _two(a, b)

    def _two(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        x, y = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    posted = sets.select("rid", "n", "words").mapInArrow(post, "word int, rid long, meta int, s0 long, s1 long, s2 long, s3 long")
    return posted.repartition("word").sortWithinPartitions("word").mapInArrow(meet, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """(a, b) of ``pairs`` whose shared words are ``share`` of the smaller set at least."""
    left, right = sets.select(F.col("rid").alias("a"), F.col("words").alias("wa")), sets.select(F.col("rid").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, xs), (y, ys) = _joined(b.column(2), np.uint32), _joined(b.column(3), np.uint32)
            rows = np.arange(b.num_rows, dtype=np.uint64) << np.uint64(32)
            p, q = (np.repeat(rows, np.diff(s)) | v.astype(np.uint64) for v, s in ((x, xs), (y, ys)))
            shared = np.intersect1d(p, q, assume_unique=True)
            both = np.bincount((shared >> np.uint64(32)).astype(np.int64), minlength=b.num_rows)
            ok = both >= np.ceil(share * np.minimum(np.diff(xs), np.diff(ys)) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(check, "a long, b long")


def restatement_groups(texts: DataFrame, id_col: str, text_col: str, share: float = 0.75, least_runs: int = 8) -> DataFrame:
    """(node, group) of the records linked with others, directly or over others; group is the smallest id.

    ``texts`` may hold an id several times, also with different texts: each of its texts links it. Records with null
    or short texts are in no group. Equal texts are one vertex, however many there are, and vertices are numbers; the
    ids come back in the end. Other columns of ``texts`` are ignored.
    """
    spark = texts.sparkSession
    base = cut(word_sets(texts, id_col, text_col, least_runs))
    sets = base.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("words").alias("words"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("rid"), "n", "words", "k1", "k2", "copies"))
    base = base.select("id", "k1", "k2")
    number = sets.select("rid", "k1", "k2", "copies")
    # the texts of one id are one record
    key = F.struct("k1", "k2")
    several = base.groupBy("id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo != hi").select("id")
    links = star_pairs(base.join(several, "id").join(number, ["k1", "k2"]).select("id", "rid"), "id", "rid").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    sets = sets.select("rid", "n", "words")
    release(spark)
    stats = sets.agg(F.count("*").alias("total"), F.avg("n").alias("mean")).first()
    if stats["total"] > 1:
        freq, counts = frequent_words(sets, stats["total"], stats["mean"])
        near = cut(forest_pairs(sets, freq, counts, stats["total"]))
        release(spark)
        within = cut(contained_pairs(sets, freq, counts, share))
        release(spark)
        rare = cut(rare_pairs(sets, freq, share))
        release(spark)
        links = cut(links.unionByName(within).unionByName(verified(near.unionByName(rare).distinct(), sets, share)))
        release(spark)
    found = connected_groups(links, "a", "b").select(F.col("node").alias("rid"), F.col("group").alias("label"))
    tied = number.join(found, "rid", "left").filter("label is not null or copies > 1").select("k1", "k2", F.coalesce("label", "rid").alias("label"))
    members = cut(base.join(tied, ["k1", "k2"]).select("id", "label").distinct())
    names = members.groupBy("label").agg(F.min("id").alias("group"), F.count("*").alias("c")).filter("c > 1")
    return members.join(names, "label").select(F.col("id").alias("node"), "group")
