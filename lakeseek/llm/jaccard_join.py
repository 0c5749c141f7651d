"""N-gram Jaccard join by a token-group matrix.

1. Every document becomes the set of its word shingles. Equal sets collapse to one representative. Pigeonhole signatures
   (shingles.Parts) are keys of which any two sets that can be similar enough share a certain number. Sets that share fewer with all others are done.
2. Similar sets form groups: each set goes to the group of the set that it shares most keys with (of the first sets of its keys), GROUP
   sets at most and that one. A group is counted exactly within itself, and stores the union of its members' tokens as a
   column of the token-group matrix: a bitmap of hashed tokens.
3. What groups link makes classes. Where the sets that share keys with one first set are of several classes, each one outside the largest class is a
   query to the groups of other classes. Its tokens whose bits the group's column lacks bound its overlap with every member.
4. Groups whose bound is below the threshold stay shut. In the others the set's own bitmap bounds its overlap with each member that shares the first set; only
   groups with a member that is left are opened: they get the token list, and all members are counted exactly. So every pair of sets that share
   a key and are of different classes is tested or bounded. Both bounds are taken in blocks of groups, each read once by a turn of sets that ask, so that no row is made for a set and a group.

Nothing is capped. Links within a class need no test once it is one, as only classes are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import components, discard, from_planes, release, saved, scoped, to_planes
from lakeseek.llm.shingles import Parts, WordHash, fingerprint, shingle_set, word_hashes

GROUP = 192
#: Cells of a group's matrix that are held one by one; a larger one is held by its filled cells only.
MOST_CELLS = 64_000_000
#: Queries that probe one copy of a group.
TURN = 256
#: Sets of groups that are bounded together, and sets that ask one copy of them.
BLOCK, ASKERS = 2048, 512
#: Sets (and tokens) in which equal signatures are joined before the shuffle.
BATCH, BATCH_TOKENS = 8192, 2_500_000
#: Bytes of text for each bucket of keys, about 150,000 keys.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 2 << 20, 64, 1 << 24
#: Bits of a column for each token of its largest member.
WIDTH = 4
_SIZE, _EQUAL, _LINK, _KEY, _MEMBER, _NEED = range(6)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (bucket, kind, n, a, b, c) of packed numbers."""
    at = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(at, kinds, strict=True)], names=["bucket", "kind", "n", "a", "b", "c"])


_PACKED = "bucket long, kind int, n int, a binary, b binary, c binary"


def _dealt(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, its rows of the columns), in the columns' order within a bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    for s, e in zip(starts, [*starts[1:], len(bucket)], strict=True):
        yield int(bucket[s]), [c[s:e] for c in columns]


def _signed(k: int, percent: int, n_buckets: int, keys: bool):
    """(doc, text) -> packed rows of what step 1 shuffles: sizes and fingerprints, or else keys.

    Of sets in a batch that share a key (or are equal) the first goes to the key's bucket, the others to any, so no key is hot.
    """

    def equals(prints: dict, ids: np.ndarray, at: int) -> list[tuple]:
        rows = []
        copies = [(ids[o[0]], ids[i]) for o in prints.values() for i in o[1:] if ids[i] != ids[o[0]]]
        if copies:
            a, b = np.array(copies, np.int64).T
            rows.append((at, _LINK, len(a), to_planes(b), to_planes(a), b""))
        two = np.array(list(prints), np.int64)
        for b, (x, y, d) in _dealt(two[:, 0] % n_buckets, two[:, 0], two[:, 1], ids[[o[0] for o in prints.values()]]):
            rows.append((b, _EQUAL, len(d), to_planes(x), to_planes(y), to_planes(d)))
        return rows

    def out(docs: list, sets: list):
        rows, at = [], abs(hash((len(docs), docs[0]))) % n_buckets
        known = np.array([d is not None for d in docs])
        ids = np.array([d if d is not None else 0 for d in docs], np.int64)
        if len(ids) and np.abs(ids).max() >= 2**62:
            raise ValueError("ids of 62 bits at most")
        size = np.array([len(s) for s in sets], np.int64)
        if keys:
            parts = worker_parts(percent)
            signs = [parts.signatures(x) if len(x) and d is not None else [] for x, d in zip(sets, docs, strict=True)]
            need = np.array([[x[j][1] if j < len(x) else 1 for j in range(2)] for x in signs], np.int64)
            rows.append((at, _NEED, len(docs), to_planes(ids), to_planes(need[:, 0], 4), to_planes(need[:, 1], 4)))
        else:
            rows.append((at, _SIZE, len(docs), to_planes(ids), to_planes(size), known.tobytes()))
        linked = np.flatnonzero(known & (size > 0))
        linked = linked[np.argsort(ids[linked], kind="stable")].tolist()
        prints: dict = {}
        for i in linked:  # the first is the one with the smallest id
            prints.setdefault(fingerprint(sets[i]), []).append(i)
        if not prints:
            return _record(rows)
        if not keys:
            return _record(rows + equals(prints, ids, at))
        signing = [o[0] for o in prints.values()]
        order = np.argsort(ids[signing], kind="stable")
        signing = [signing[i] for i in order]
        # A document's number and, lowest, which class a key is of: its own or the one before.
        key = np.concatenate([x for i in signing for x, _ in signs[i]])
        who = np.repeat(np.concatenate([[ids[i] * 2 + j for j in range(len(signs[i]))] for i in signing]), [len(x) for i in signing for x, _ in signs[i]])
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        own = np.zeros(len(key), bool)  # a document's second key of one value
        own[1:] = ~new[1:] & (who[1:] >> 1 == who[:-1] >> 1)
        key, who, new = key[~own], who[~own], new[~own]
        followed = np.append(~new[1:], False)[new]
        bucket, low = ((key >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64), (key & np.uint64(2**48 - 1)).astype(np.int64)
        least = int(who.min())
        for b, (x, d, f) in _dealt(bucket[new], low[new], who[new] - least, followed):
            rows.append((b, _KEY, len(d), to_planes(x, 6), to_planes(d), f.tobytes() + np.int64(least).tobytes()))
        if not new.all():
            rows.append((at, _MEMBER, int((~new).sum()), to_planes(_key64(bucket[~new], low[~new])), to_planes(who[~new]), b""))
        return _record(rows)

    def run(batches):
        known, docs, sets, tokens = WordHash(), [], [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                docs.append(d)
                sets.append(shingle_set(word_hashes(t.as_py(), known), k))
                tokens += len(sets[-1])
                if len(docs) >= BATCH or tokens > BATCH_TOKENS:
                    yield out(docs, sets)
                    docs, sets, tokens = [], [], 0
        if docs:
            yield out(docs, sets)

    return run


_PARTS: dict[int, Parts] = {}


def worker_parts(percent: int) -> Parts:
    return _PARTS.setdefault(percent, Parts(percent))


def _key64(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One number for a key; two that meet in it are compared in vain, but nothing is lost."""
    return low ^ (bucket << 40)


def _met(batches):
    """Packed rows sorted by bucket -> (kind, k, a, b).

    _SIZE: k is whether there is an id, a the id, b the size; _EQUAL: (copy, first); _MEMBER: sets of a key that several share, b which class the
    key is of; _NEED: k which class, b how many of its keys must be shared.
    """

    def out(bucket, keys, prints):
        made = []
        if prints:
            x, y, d = (np.concatenate([p[j] for p in prints]) for j in range(3))
            order = np.lexsort((d, y, x))
            x, y, d = x[order], y[order], d[order]
            new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            lead = d[np.flatnonzero(new)][np.cumsum(new) - 1]
            far = d != lead
            made.append((_EQUAL, np.zeros(far.sum(), np.int64), d[far], lead[far]))
        if keys:
            x, d, f = (np.concatenate([p[j] for p in keys]) for j in range(3))
            order = np.argsort(x, kind="stable")
            x, d, f = x[order], d[order], f[order]
            same = x[1:] == x[:-1]
            held = f | np.append(same, False) | np.insert(same, 0, False)
            made.append((_MEMBER, _key64(np.full(held.sum(), bucket), x[held]), d[held] >> 1, d[held] & 1))
        return made

    def table(made):
        kind = np.concatenate([np.full(len(m[1]), m[0], np.int32) for m in made] or [np.empty(0, np.int32)])
        rest = [np.concatenate([m[j] for m in made] or [np.empty(0, np.int64)]) for j in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, rest)], names=["kind", "k", "a", "b"])

    at, keys, prints = None, [], []
    for batch in batches:
        made = []
        for i in range(batch.num_rows):
            bucket, kind, n, a, b, c = (x[i].as_py() for x in batch.columns)
            if bucket != at:
                made += out(at, keys, prints)
                at, keys, prints = bucket, [], []
            if kind == _SIZE:
                made.append((_SIZE, np.frombuffer(c, bool).astype(np.int64), from_planes(a), from_planes(b)))
            elif kind == _NEED:
                made += [(_NEED, np.full(n, j, np.int64), from_planes(a), from_planes(x, 4)) for j, x in enumerate((b, c))]
            elif kind == _LINK:
                made.append((_EQUAL, np.zeros(n, np.int64), from_planes(a), from_planes(b)))
            elif kind == _EQUAL:
                prints.append((from_planes(a), from_planes(b), from_planes(c)))
            elif kind == _KEY:
                keys.append((from_planes(a, 6), from_planes(b) + np.frombuffer(c[n:], np.int64)[0], np.frombuffer(c[:n], bool)))
            else:
                who = from_planes(b)
                made.append((_MEMBER, from_planes(a), who >> 1, who & 1))
        yield table(made)
    yield table(out(at, keys, prints))


def _bits(tokens: np.ndarray, width: int) -> np.ndarray:
    """Tokens as a bitmap of a power of two of bits."""
    out = np.zeros(width, bool)
    out[tokens.astype(np.uint64) >> np.uint64(64 - width.bit_length() + 1)] = True
    return np.packbits(out)


def _width(n: int) -> int:
    return 1 << max(6, (WIDTH * n - 1).bit_length())


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap made as narrow as width: a bit stands for those that begin with it."""
    many = len(bits) * 8 // width
    if many <= 1:
        return bits
    if many >= 8:
        bits = np.bitwise_or.reduce(bits.reshape(-1, many // 8), axis=1)
        return np.packbits(bits != 0)
    return np.packbits(np.unpackbits(bits).reshape(-1, many).max(1))


def may_link(lacking: int, n: int, least: int, percent: int) -> bool:
    """Whether a set of n tokens, of which a group lacks so many, can link with a member; the smallest one has least tokens."""
    most = n - lacking
    return 100 * most >= percent * n and (100 + percent) * most >= percent * (n + least)


def _sets(k: int):
    """(gid, sub, doc, text) -> (gid, sub, doc, tokens, bits)."""

    def run(batches):
        known = WordHash()
        for batch in batches:
            texts = batch.column(3).cast(pa.binary())
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(word_hashes(t.as_py(), known), k) for t in texts.slice(at, 512)]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                own = pa.array([_bits(s, _width(len(s))).tobytes() for s in sets], pa.binary())
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(at, 512) for j in range(3)), tokens, own], names=["gid", "sub", "doc", "tokens", "bits"])

    return run


class Matrix:
    """One group's rows of the token-group matrix: which member holds which token."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        self.doc = np.array([m[0] for m in members], np.int64)
        self.label = np.array([m[1] for m in members], np.int64)
        self.size = np.array([len(m[2]) for m in members], np.int64)
        tokens = np.concatenate([m[2] for m in members])
        self.union, where = np.unique(tokens, return_inverse=True)
        who = np.repeat(np.arange(len(members)), self.size)
        self.holds = None
        if len(self.union) * len(members) <= MOST_CELLS:
            self.holds = np.zeros((len(self.union), len(members)), np.uint8)
            self.holds[where, who] = 1
        else:
            self.held = who[np.argsort(where, kind="stable")]
            self.starts = np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(self.union)))))
        self.tokens = [m[2] for m in members]
        self.least = int(self.size.min())

    def fits(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """Which members a set links with."""
        at = np.searchsorted(self.union, tokens)
        at = at[self.union[np.minimum(at, len(self.union) - 1)] == tokens]
        if not may_link(len(tokens) - len(at), len(tokens), self.least, percent):
            return np.zeros(len(self.doc), bool)
        if self.holds is not None:
            shared = self.holds[at].sum(0, dtype=np.int64)
        else:
            n = self.starts[at + 1] - self.starts[at]
            cells = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(self.held[cells], minlength=len(self.doc))
        return 100 * shared >= percent * (len(tokens) + self.size - shared)

    def probe(self, doc: int, label: int, tokens: np.ndarray, percent: int) -> list[int]:
        """One member of each class other than the query's that has a member similar to it."""
        fits = self.fits(tokens, percent) & (self.label != label) & (self.doc != doc)
        if not fits.any():
            return []
        _, first = np.unique(self.label[fits], return_index=True)
        return self.doc[fits][first].tolist()

    def joined(self, percent: int) -> list[tuple[int, int]]:
        """Links that join the group's members as all their links do."""
        near = np.eye(len(self.doc), dtype=bool)
        for i in range(len(self.doc)):
            near[i] |= self.fits(self.tokens[i], percent)
        out, left = [], np.ones(len(self.doc), bool)
        for start in range(len(self.doc)):
            todo = [start] if left[start] else []
            left[start] = False
            while todo:
                i = todo.pop()
                for j in np.flatnonzero(near[i] & left).tolist():
                    left[j] = False
                    todo.append(j)
                    out.append((int(self.doc[i]), int(self.doc[j])))
        return out


def _grouped(percent: int):
    """Rows (gid, sub, doc, tokens, bits) sorted by group -> (gid, sub, a, b, least, bits): links within it (bits null), and its column."""

    def out(key, members):
        m = Matrix([(d, d, t) for d, t, _ in members])
        links = m.joined(percent)
        width = max(len(b) for _, _, b in members) * 8
        column = _bits(m.union.view(np.uint64), width)
        return [(*key, a, b, None, None) for a, b in links] + [(*key, None, None, m.least, column.tobytes())]

    def run(batches):
        at, members = None, []
        for batch in batches:
            rows = []
            gid, sub, doc, bits = (batch.column(j).to_pylist() for j in (0, 1, 2, 4))
            lists = batch.column(3)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                if at != (gid[i], sub[i]):
                    if members:
                        rows += out(at, members)
                    at, members = (gid[i], sub[i]), []
                tokens, last = values[offsets[i] : offsets[i + 1]], len(members) - 1
                while last >= 0 and members[last][0] == doc[i] and not np.array_equal(members[last][1], tokens):
                    last -= 1
                if last < 0 or members[last][0] != doc[i]:  # rows alike in id and text are one member
                    members.append((doc[i], tokens.copy(), bits[i]))
            yield table(rows)
        yield table(out(at, members) if members else [])

    def table(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["gid", "sub", "a", "b", "least", "bits"])

    return run


class Columns:
    """The columns of groups in the token-group matrix, stacked by width."""

    def __init__(self, groups: list[tuple[tuple, int, bytes]]):
        """groups: key, smallest set size and column of each."""
        self.by_width: dict = {}
        for key, least, bits in groups:
            keys, sizes, columns = self.by_width.setdefault(len(bits), ([], [], []))
            keys.append(key)
            sizes.append(least)
            columns.append(np.frombuffer(bits, np.uint8))
        self.by_width = {w: (a, np.array(b, np.int64), {w: np.stack(c)}) for w, (a, b, c) in self.by_width.items()}

    def open_to(self, n: int, bits: bytes, percent: int) -> list[tuple]:
        """The groups that a set of n tokens may link with: most of its tokens that a column allows (see may_link)."""
        own, out = {len(bits): np.frombuffer(bits, np.uint8)}, []
        for w, (keys, sizes, stacks) in self.by_width.items():
            least = min(w, len(bits))
            if least not in stacks:
                stacks[least] = np.stack([_folded(x, 8 * least) for x in stacks[w]])
            if least not in own:
                own[least] = _folded(own[len(bits)], 8 * least)
            most = n - np.bitwise_count(own[least] & ~stacks[least]).sum(1, dtype=np.int64)
            out += [keys[i] for i in np.flatnonzero((100 * most >= percent * n) & ((100 + percent) * most >= percent * (n + sizes)))]
        return out


class Bitmaps:
    """The bitmaps of a group's members, stacked by width."""

    def __init__(self, members: list[tuple[int, int, bytes]]):
        """members: class, set size and bitmap of each."""
        self.by_width: dict = {}
        for label, n, bits in members:
            held = self.by_width.setdefault(len(bits), ([], [], []))
            for x, y in zip(held, (label, n, np.frombuffer(bits, np.uint8)), strict=True):
                x.append(y)
        self.by_width = {w: (np.array(a, np.int64), np.array(b, np.int64), {w: np.stack(c)}) for w, (a, b, c) in self.by_width.items()}

    def opens(self, label: int, n: int, bits: bytes, percent: int) -> bool:
        """Whether the set may link with a member of another class: most tokens in common that the two bitmaps allow."""
        own = {len(bits): np.frombuffer(bits, np.uint8)}
        for w, (labels, size, stacks) in self.by_width.items():
            least = min(w, len(bits))
            if least not in stacks:
                stacks[least] = np.stack([_folded(x, 8 * least) for x in stacks[w]])
            if least not in own:
                own[least] = _folded(own[len(bits)], 8 * least)
            q, m = own[least], stacks[least]
            both = q & m
            most = np.minimum(n - np.bitwise_count(q ^ both).sum(1, dtype=np.int64), size - np.bitwise_count(m ^ both).sum(1, dtype=np.int64))
            if ((100 * most >= percent * (n + size - most)) & (labels != label)).any():
                return True
        return False


_COLUMN, _HELD, _ASKS = range(3)


def _opened(percent: int):
    """Rows (lead, block, turn, kind, gid, sub, doc, label, n, bits), groups' columns and then their sets before what asks them -> (doc, gid, sub) that both bounds leave open."""

    def run(batches):
        at, groups, members, columns, maps = None, [], {}, None, {}
        for batch in batches:
            out = set()
            for lead, block, turn, kind, gid, sub, doc, label, n, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (lead, block, turn):
                    at, groups, members, columns, maps = (lead, block, turn), [], {}, None, {}
                if kind == _COLUMN:
                    groups.append(((gid, sub), n, bits))
                elif kind == _HELD:
                    members.setdefault((gid, sub), []).append((label, n, bits))
                else:
                    columns = columns or Columns(groups)
                    for key in columns.open_to(n, bits, percent):
                        if (doc, *key) not in out and key in members:
                            if key not in maps:
                                maps[key] = Bitmaps(members[key])
                            if maps[key].opens(label, n, bits, percent):
                                out.add((doc, *key))
            out = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], names=["doc", "gid", "sub"])

    return run


def _probed(percent: int):
    """Rows (gid, sub, turn, query, doc, label, tokens), a group's members (query false) before its queries."""

    def run(batches):
        at, members, matrix = None, [], None
        for batch in batches:
            out: list[tuple[int, int]] = []
            gid, sub, turn, query, doc, label = (batch.column(j).to_pylist() for j in range(6))
            lists = batch.column(6)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                if at != (gid[i], sub[i], turn[i]):
                    at, members, matrix = (gid[i], sub[i], turn[i]), [], None
                tokens = values[offsets[i] : offsets[i + 1]]
                if not query[i]:
                    members.append((doc[i], label[i], tokens.copy()))
                elif members:
                    matrix = matrix or Matrix(members)
                    out += [(doc[i], d) for d in matrix.probe(doc[i], label[i], tokens, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(2)], names=["a", "b"])

    return run


def _by_blocks(held: DataFrame, column: DataFrame) -> DataFrame:
    """Rows for _opened. held: lead, doc, gid, sub, label, main, n, bits; column: gid, sub, least, bits.

    What shares a first set is dealt into blocks of groups, about BLOCK sets each, and turns of about ASKERS sets that ask: a set that asks is one row a block, and not one a group, and a
    block's set is one row a turn.
    """
    asks = F.col("label") != F.col("main")
    many = held.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"), F.ceil(F.count(F.when(asks, 1)) / ASKERS).cast("long").alias("turns"))
    held = held.join(many, "lead")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block, none = F.pmod(F.xxhash64("gid", "sub"), F.col("blocks")).alias("block"), F.lit(None).cast("long")
    groups = held.select("lead", "gid", "sub", "blocks", "turns").distinct().join(column, ["gid", "sub"])
    rows = groups.select("lead", block, each("turns").alias("turn"), F.lit(_COLUMN).alias("kind"), "gid", "sub", none.alias("doc"), none.alias("label"), F.col("least").alias("n"), "bits")
    rows = rows.unionByName(held.select("lead", block, each("turns").alias("turn"), F.lit(_HELD).alias("kind"), "gid", "sub", "doc", "label", "n", "bits"))
    turn = F.pmod(F.xxhash64("doc", F.lit(7)), F.col("turns")).alias("turn")
    rows = rows.unionByName(held.where(asks).select("lead", each("blocks").alias("block"), turn, F.lit(_ASKS).alias("kind"), "gid", "sub", "doc", "label", "n", "bits"))
    return rows.repartition("lead", "block", "turn").sortWithinPartitions("lead", "block", "turn", "kind", "gid", "sub", "doc")


def _by_turns(members: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (gid, sub, turn, query, doc, label, others) of groups and what asks them. A group's queries come in turns of about TURN, each with its own copy of the group."""
    turns = queries.groupBy("gid", "sub").agg(F.ceil(F.count(F.lit(1)) / TURN).cast("long").alias("turns"))
    others = [c for c in members.columns if c not in ("gid", "sub", "doc", "label")]
    cols = lambda df, q, turn: df.join(turns, ["gid", "sub"]).select("gid", "sub", turn.alias("turn"), F.lit(q).alias("query"), "doc", "label", *others)
    rows = cols(members, False, F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).unionByName(cols(queries, True, F.pmod(F.xxhash64("doc", F.lit(7)), F.col("turns"))))
    return rows.repartition("gid", "sub", "turn").sortWithinPartitions("gid", "sub", "turn", "query", "doc")


#: Bits of the filter by which texts are left out before a shuffle, in maps of 4 KB each: 2 MB together, whatever the input.
SLOTS, _MAP = 2**24, 32_768


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose doc stands in wanted, and a few others with the same slot."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(SLOTS))
    maps = wanted.select(slot.alias("s")).groupBy(F.expr(f"s div {_MAP}").alias("_map")).agg(F.bitmap_construct_agg(F.expr(f"s % {_MAP}")).alias("_bits"))
    held = rows.withColumn("_slot", slot).withColumn("_map", F.expr(f"_slot div {_MAP}")).join(F.broadcast(maps), "_map")
    byte = f"cast(conv(hex(substring(_bits, cast(_slot % {_MAP} div 8 as int) + 1, 1)), 16, 10) as int)"
    return held.where(f"shiftright({byte}, cast(_slot % 8 as int)) % 2 = 1").drop("_map", "_slot", "_bits")


def _links(rows: DataFrame, members: DataFrame, needs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join the sets as all links do. rows: (doc, text); members: (k, doc, lower), the sets of each key that several rows share; needs: (doc, lower, need)."""
    enough = members.groupBy("doc", "lower").agg(F.count(F.lit(1)).alias("n")).join(needs, ["doc", "lower"]).where("n >= need").select("doc", "lower")
    near = members.join(enough, ["doc", "lower"]).select("k", "doc")
    shared = near.groupBy("k").agg(F.min("doc").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = saved(near.join(shared, "k"))
    # A set's group is that of the first set with which it has most keys in common; who is first everywhere leads its own.
    near = members.where("doc <> lead").groupBy("doc", "lead").agg(F.count(F.lit(1)).alias("n"))
    near = near.groupBy("doc").agg(F.max_by("lead", F.struct("n", F.negative("lead"))).alias("gid"))
    home = members.select("doc").distinct().join(near, "doc", "left").select("doc", F.coalesce("gid", "doc").alias("gid"))
    sizes = home.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("long").alias("subs"))
    home = saved(home.join(sizes, "gid").select("gid", F.when(F.col("doc") == F.col("gid"), 0).otherwise(F.pmod(F.xxhash64("doc"), "subs")).cast("long").alias("sub"), "doc", "subs"))
    # The group's first set stands in each of its parts.
    heads = home.select("gid", "subs").distinct().select("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"), F.col("gid").alias("doc"))
    placed = saved(home.select("gid", "sub", "doc").unionByName(heads).distinct())
    sets = saved(placed.join(_among(rows, placed), "doc").select("gid", "sub", "doc", "text").mapInArrow(scoped(_sets(k)), "gid long, sub long, doc long, tokens array<long>, bits binary"))
    grouped = sets.repartition("gid", "sub").sortWithinPartitions("gid", "sub", "doc")
    grouped = saved(grouped.mapInArrow(scoped(_grouped(percent)), "gid long, sub long, a long, b long, least long, bits binary"))
    release(rows.sparkSession)
    links = grouped.where("bits is null").select("a", "b")
    classes = components(links)
    home = saved(home.drop("subs").join(classes, home["doc"] == classes["node"], "left").select("doc", "gid", "sub", F.coalesce("label", "doc").alias("label")))
    # Sets that share a key share its first set, and that set's group, so that a crowd asks through one group and not through all its first sets. Who is
    # outside the largest class of those that share it asks the groups of the other classes.
    first = home.select(F.col("doc").alias("lead"), F.col("gid").alias("first"))
    held = saved(members.select("lead", "doc").distinct().join(first, "lead").select(F.col("first").alias("lead"), "doc").distinct().join(home, "doc"))
    large = held.groupBy("lead", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("lead").agg(F.max_by("label", F.struct("n", F.negative("label"))).alias("main"), F.count(F.lit(1)).alias("classes"))
    held = held.join(large.where("classes > 1").drop("classes"), "lead")
    column = grouped.where("bits is not null").select("gid", "sub", "least", "bits")
    # Token lists, the bulk of a set, are left behind before the join.
    small = sets.select("gid", "sub", "doc", F.size("tokens").cast("long").alias("n"), "bits")
    bitmaps = small.join(held, ["doc", "gid", "sub"]).distinct()
    open_ = saved(_by_blocks(bitmaps, column).mapInArrow(scoped(_opened(percent)), "doc long, gid long, sub long").distinct())
    labelled = sets.select("gid", "sub", "doc", "tokens").join(home, ["doc", "gid", "sub"])
    inside = labelled.join(open_.select("gid", "sub").distinct(), ["gid", "sub"]).select("gid", "sub", "doc", "label", "tokens")
    queries = open_.join(labelled.select("doc", "label", "tokens"), "doc").select("gid", "sub", "doc", "label", "tokens")
    found = saved(links.unionByName(_by_turns(inside, queries).mapInArrow(scoped(_probed(percent)), "a long, b long")))
    discard(members, placed, sets, grouped, open_)
    return found


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles (set size), component_id (smallest doc_id reachable by links).

    Two documents link when 100 * intersection >= percent * union of their distinct k-word shingles (words: A-Z lowered,
    split at bytes 32 and 9 to 13; with fewer than k words the whole sequence is one shingle).

    Null or empty texts have 0 shingles, link with nothing and are their own class. A null doc_id links with nothing and gets
    a null class. Rows that repeat a doc_id are one node: each row keeps its own n_shingles, all share one class. Other
    columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = int(max(LEAST_BUCKETS, min(MOST_BUCKETS, size // BUCKET_BYTES)))

    def met(rows: DataFrame, keys: bool) -> DataFrame:
        packed = rows.mapInArrow(scoped(_signed(k, percent, n_buckets, keys)), _PACKED).repartition("bucket").sortWithinPartitions("bucket")
        return saved(packed.mapInArrow(scoped(_met), "kind int, k long, a long, b long"))

    prints = met(rows, False)
    sizes = prints.where(f"kind = {_SIZE}").select(F.when(F.col("k") == 1, F.col("a")).alias("doc"), F.col("b").alias("n_shingles"))
    # Equal sets: everything is asked of the smallest doc_id with that set.
    equal = prints.where(f"kind = {_EQUAL}").select("a", "b").distinct()
    # An id with several rows may have several sets; it is asked for itself.
    several = sizes.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A copy's first in its batch may itself be a copy of the first of all.
    to_first = equal.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    to_first = to_first.join(to_first.select(F.col("node").alias("label"), F.col("label").alias("_far")), "label", "left").select("node", F.least("label", "_far").alias("label"))
    copies = saved(to_first.join(several, F.col("node") == F.col("doc"), "left_anti").select(F.col("node").alias("doc")))
    rows = rows.where("doc is not null")
    signed = met(rows.join(copies, "doc", "left_anti"), True)
    release(spark)
    needs = signed.where(f"kind = {_NEED}").groupBy(F.col("a").alias("doc"), F.col("k").alias("lower")).agg(F.min("b").alias("need"))
    member = signed.where(f"kind = {_MEMBER}").select("k", F.col("a").alias("doc"), F.col("b").alias("lower"))  # an id's rows may repeat a key: that only asks more
    links = _links(rows, member, needs, k, percent)
    labels = components(equal.unionByName(links)).select(F.col("node").alias("doc"), "label")
    return sizes.join(labels, "doc", "left").select(F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("label", "doc").alias("component_id"))
