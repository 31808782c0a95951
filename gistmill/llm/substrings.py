"""Removal of repeated byte strings by sorted suffixes, range-partitioned by their leading bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, keyed

#: Bytes of a repeated string, and of the leading token by which suffixes are dealt out.
LENGTH, LEAD = 100, 24
#: Bytes before a suffix that a string around its token can reach.
BEFORE = LENGTH - LEAD
#: Suffixes compared at a time.
PART = 16_384

_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64)
_BASE = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_MASK = 2**64 - 1


def _slide(a: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over every w neighbours of a, by running values within blocks of w."""
    n = len(a)
    b = np.concatenate([a, np.full(-n % w, fill, a.dtype)]).reshape(-1, w)
    ahead = op.accumulate(b, axis=1).ravel()
    behind = op.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - w + 1], ahead[w - 1 : n])


def sampled(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the suffixes to sort: those whose token is the least by hash in some string of LENGTH bytes.

    Equal strings choose at equal places, so a repeated string holds a repeated token; about 1 suffix in 40 is chosen.
    """
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    count = n - LEAD + 1
    word = lambda k: np.ndarray((count,), "<u8", data, k, (1,))
    h = word(0) * np.uint64(_BASE[0])
    for k in range(8, LEAD, 8):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_BASE[1]) + word(k) * np.uint64(_BASE[0])
    h ^= h >> np.uint64(32)
    h *= np.uint64(_BASE[1])
    h ^= h >> np.uint64(29)
    w = LENGTH - LEAD + 1
    least = _slide(h, w, np.minimum, _MASK)
    ends = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([ends, least, ends]), w, np.maximum, 0) == h)
    return at.astype(np.int32), h[at].view(np.int64)


def _hashes(rows: np.ndarray) -> np.ndarray:
    """(2, n, BEFORE + 1): 128 bits for each string of LENGTH bytes in rows of BEFORE + LENGTH bytes."""
    out = np.empty((2, len(rows), BEFORE + 1), np.uint64)
    for k in range(2):
        base, x = np.uint64(_BASE[k]), _BYTE[k][rows.T]
        upto = np.zeros((rows.shape[1] + 1, len(rows)), np.uint64)
        for t in range(rows.shape[1]):
            upto[t + 1] = upto[t] * base + x[t]
        h = upto[LENGTH:] - upto[: BEFORE + 1] * np.uint64(pow(_BASE[k], LENGTH, 2**64))
        out[k] = (h ^ (h >> np.uint64(31))).T
    return out


_RANGES = "_did long, _sub int, s long, e long, l int, ctx binary, known binary"


def _batch(did, sub, s, e, left=None, ctx=None, known=None) -> pa.RecordBatch:
    n = len(did)
    cols = [pa.array(did, pa.int64()), pa.array(sub, pa.int32()), pa.array(s, pa.int64()), pa.array(e, pa.int64())]
    cols += [pa.nulls(n, pa.int32()) if left is None else pa.array(left, pa.int32()), *[pa.nulls(n, pa.binary()) if c is None else pa.array(c, pa.binary()) for c in (ctx, known)]]
    return pa.RecordBatch.from_arrays(cols, ["_did", "_sub", "s", "e", "l", "ctx", "known"])


def _rows(left: np.ndarray, ctx: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes around suffixes in rows of BEFORE + LENGTH, padded with zeros; how many bytes follow from each suffix on."""
    pad, width = bytes(BEFORE), BEFORE + LENGTH
    rows = np.frombuffer(b"".join([(pad[x:] + c).ljust(width, b"\0") for x, c in zip(left.tolist(), ctx, strict=True)]), np.uint8).reshape(-1, width)
    return rows, np.fromiter(map(len, ctx), np.int64, len(ctx)) - left


def _strings(left: np.ndarray, ctx: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """valid (n, BEFORE + 1): whether a string of LENGTH bytes starts at each distance before a suffix; two hashes of each."""
    rows, after = _rows(left, ctx)
    at = np.arange(BEFORE + 1)  # where a string starts in the row; it reaches BEFORE - at bytes before the suffix
    return ((BEFORE - at[None] <= left[:, None]) & (at[None] + LENGTH - BEFORE <= after[:, None]), *_hashes(rows))


def compared(group: np.ndarray, open_: np.ndarray, did: np.ndarray, sub: np.ndarray, pos: np.ndarray, left: np.ndarray, ctx: list[bytes]) -> Iterator[pa.RecordBatch]:
    """What a part of a bucket says: ranges that earlier suffixes of their group cover, and, of groups that reach beyond
    the part (open_), each suffix with new bytes around it (with ctx, for the comparison across boundaries).

    group: numbers of equal tokens; within one, rows ascend by document and position. left: bytes of ctx before pos.
    """
    # suffixes with the same bytes around them as an earlier one of their group are late as a whole
    seen: set[tuple[int, int, bytes]] = set()
    fresh = np.fromiter((k not in seen and not seen.add(k) for k in zip(group.tolist(), left.tolist(), ctx, strict=True)), bool, len(ctx))
    size = np.fromiter(map(len, ctx), np.int64, len(ctx))
    i = np.flatnonzero(~fresh & (size >= LENGTH))
    yield _batch(did[i], sub[i], pos[i] - left[i], pos[i] - left[i] + size[i])
    several = np.bincount(group, fresh)[group] > 1
    use = np.flatnonzero(fresh & several)
    every = (did, sub, pos, left)
    late = np.zeros((len(use), BEFORE + 3), np.int8)
    if len(use):
        yield from _own(group[use], did[use], sub[use], pos[use], left[use], [ctx[k] for k in use], late)
    i = np.flatnonzero(fresh & open_)
    if len(i):
        bits = np.zeros((len(ctx), BEFORE + 1), np.int8)
        bits[use] = late[:, 1:-1]
        did, sub, pos, left = (c[i] for c in every)
        yield _batch(did, sub, pos, pos, left, [ctx[k] for k in i], [x.tobytes() for x in np.packbits(bits[i], axis=1)])


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of rows by group (ascending already) and then by their words, from the first column on.

    Three-way partitioning, of all open segments at once: a segment's rows are put below, at or above its middle row's
    word. What is equal goes on with the next word, the rest with the same one, until a segment has one row or no word.
    """
    order = np.arange(len(group))
    seg, depth = group.copy(), np.zeros(len(group), np.int64)
    open_ = np.arange(len(group))  # places in order that aren't final
    while len(open_):
        s = seg[open_]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[start, len(s)])
        depth_, rows = depth[open_], order[open_]
        word = words[rows, np.minimum(depth_, words.shape[1] - 1)]
        pivot = np.repeat(word[start + size // 2], size)
        side = np.where(word < pivot, 0, np.where(word == pivot, 1, 2))
        part = np.repeat(np.arange(len(start)), size) * 3 + side
        by = np.argsort(part, kind="stable")
        order[open_], part = rows[by], part[by]
        seg[open_] = part  # segments are compared only among open places
        depth[open_] = depth_[by] + (side[by] == 1)
        single = np.repeat(np.diff(np.r_[at := np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]) == 1, np.diff(np.r_[at, len(part)]))
        open_ = open_[~single & (depth[open_] < words.shape[1])]
    return order


def _classes(rows: np.ndarray, group: np.ndarray, lengths: range) -> Iterator[np.ndarray]:
    """For each length the classes of rows (bytes, from the token outwards) that begin with equal bytes of that length.

    Rows are sorted by multikey quicksort, and each is compared with its neighbour in that order: a class ends where the
    length common to neighbours is less.
    """
    width = -rows.shape[1] % 8
    words = np.pad(rows, ((0, 0), (0, width))).view(">u8").astype(np.uint64) if rows.shape[1] else np.zeros((len(rows), 1), np.uint64)
    order = multikey_quicksort(np.ascontiguousarray(words), group)
    by = rows[order]
    differ = by[1:] != by[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]) if rows.shape[1] else np.zeros(len(rows) - 1, np.int64)
    common = np.r_[-1, np.where(group[order][1:] != group[order][:-1], -1, common)]
    out = np.empty(len(rows), np.int64)
    for n in lengths:
        out[order] = np.cumsum(common < n)
        yield out


def _own(group, did, sub, pos, left, ctx: list[bytes], late: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ranges of the strings that an earlier suffix of the group has too; marks them in late, a column on from their place.

    A string that starts d bytes before a suffix is another's too if LENGTH - d bytes after and d bytes before are equal:
    if the two are of one class in the order of suffixes and of one in the order of what goes before, read backwards.
    """
    rows, after = _rows(left, ctx)
    ahead = _classes(rows[:, BEFORE:], group, range(LENGTH, LENGTH - BEFORE - 1, -1))
    behind = _classes(np.ascontiguousarray(rows[:, BEFORE - 1 :: -1]), group, range(BEFORE + 1))
    for d, (a, b) in enumerate(zip(ahead, behind, strict=True)):
        use = np.flatnonzero((left >= d) & (after >= LENGTH - d))
        if len(use) < 2:
            continue
        key = a[use] * (len(left) + 1) + b[use]
        by = np.argsort(key, kind="stable")  # equal ones stay in the order of their places: the first is the earliest
        again = np.r_[False, key[by][1:] == key[by][:-1]]
        late[use[by[again]], BEFORE - d + 1] = 1
    step = np.diff(late, axis=1)
    (i, s), (_, e) = np.nonzero(step == 1), np.nonzero(step == -1)
    yield _batch(did[i], sub[i], pos[i] - BEFORE + s, pos[i] - BEFORE + e - 1 + LENGTH)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """compared() over a bucket in parts. Its first and last group, and one that is cut between parts, are open."""
    held: list[pa.RecordBatch] = []
    first, size, cut = None, 0, False

    def tokens(table: pa.Table) -> list[bytes]:
        return [c[x : x + LEAD] for x, c in zip(table.column(3).to_pylist(), table.column(4).to_pylist(), strict=True)]

    def part(leads: list[bytes], table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal first, cut
        first = leads[0] if first is None else first
        group = np.cumsum(np.fromiter((x != y for x, y in zip(leads, [None, *leads[:-1]], strict=True)), np.int64, len(leads)))
        n = np.bincount(group)[group]
        open_ = np.zeros(len(leads), bool)
        if leads[0] == first or cut:
            open_ |= group == 1
        cut = False
        if last:
            open_ |= group == group[-1]
        use = (n > 1) | open_
        if use.any():
            own = [c.to_numpy()[use].astype(np.int64) for c in table.columns[:4]]
            yield from compared(group[use], open_[use], *own, [c for c, u in zip(table.column(4).to_pylist(), use.tolist(), strict=True) if u])

    for b in batches:
        for at in range(0, b.num_rows, PART):
            held.append(b.slice(at, PART))
            size += held[-1].num_rows
            if size < PART:
                continue
            table = pa.Table.from_batches(held)
            leads = tokens(table)
            end = leads[-1]
            keep = next((k for k in range(size - 1, -1, -1) if leads[k] != end), -1) + 1
            if keep == 0:  # one group fills the part: what it keeps open meets the rest of the group across the boundary
                yield from part(leads, table, True)
                held, size, cut = [], 0, True
            else:
                yield from part(leads[:keep], table.slice(0, keep), False)
                held, size = table.slice(keep).to_batches(), size - keep
    if size:
        table = pa.Table.from_batches(held)
        yield from part(tokens(table), table, True)


def _reached(batches: Iterator[pa.RecordBatch], around: Callable[[np.ndarray, list[bytes]], np.ndarray]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows (with l and ctx), and how many leading bytes of around(l, ctx) each shares with a neighbour, which is the
    most that it shares with any row. A bucket's first and last row may share all with a row of the next bucket."""
    held: pa.Table | None = None
    most = LENGTH  # what the row in held shares with the one before
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            table = pa.Table.from_batches([b.slice(at, 2048)])
            table = table if held is None else pa.concat_tables([held, table])
            rows = around(table["l"].to_numpy().astype(np.int64), table["ctx"].to_pylist())
            differ = rows[1:] != rows[:-1]
            common = np.r_[most, np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)]
            held, most = table.slice(table.num_rows - 1), common[-1]
            yield table.slice(0, table.num_rows - 1), np.maximum(common[:-1], common[1:])
    if held is not None:
        yield held, np.array([LENGTH])


_MET = ["_did", "_sub", "s", "l", "ctx", "known"]


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a, the bytes from the token on that a suffix shares with another one at most, and back: the token and what stands
    before it, read backwards. Sorted by ctx from the token on."""
    for table, most in _reached(batches, lambda left, ctx: _rows(left, ctx)[0][:, BEFORE:]):
        back = [c[x : x + LEAD] + c[:x][::-1] for x, c in zip(table["l"].to_pylist(), table["ctx"].to_pylist(), strict=True)]
        yield from table.append_column("a", pa.array(most, pa.int32())).append_column("back", pa.array(back, pa.binary())).combine_chunks().to_batches()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of suffixes that meet across boundaries, each with 128 bits of its content. Sorted by back.

    A string that starts d bytes before a suffix can be another's only if the suffix shares LENGTH - d bytes from the token
    on with one, and d bytes before the token with one; the rest isn't opened.
    """
    turned = np.r_[BEFORE : BEFORE + LEAD, BEFORE - 1 : -1 : -1]
    d = BEFORE - np.arange(BEFORE + 1)
    for table, most in _reached(batches, lambda left, ctx: _rows(left, ctx)[0][:, turned]):
        left, ctx = table["l"].to_numpy().astype(np.int64), table["ctx"].to_pylist()
        bits = np.frombuffer(b"".join(table["known"].to_pylist()), np.uint8).reshape(len(left), -1)
        open_ = (d <= most[:, None] - LEAD) & (LENGTH - d <= table["a"].to_numpy()[:, None]) & (np.unpackbits(bits, axis=1)[:, : BEFORE + 1] == 0)
        use = np.flatnonzero(open_.any(axis=1))
        if not len(use):
            continue
        valid, h1, h2 = _strings(left[use], [ctx[k] for k in use])
        valid &= open_[use]
        who, start = np.nonzero(valid)
        did, sub, pos = (table[c].to_numpy()[use[who]] for c in ("_did", "_sub", "s"))
        cols = [did, sub, pos - BEFORE + start, h1[valid].view(np.int64), h2[valid].view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["_did", "_sub", "s", "w1", "w2"])


def removed_ranges(packed: DataFrame, scratch: Scratch) -> DataFrame:
    """(_did, _sub, s, e): byte ranges of documents packed as (_did, _sub, z) that earlier strings cover; they may overlap."""

    def unpack(z, ds):
        return ds.decompress(z.as_buffer())

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ds = zstandard.ZstdDecompressor()
        for b in batches:
            for did, sub, z in zip(*b.columns, strict=True):
                pos, h = sampled(unpack(z, ds))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), did.as_py()), pa.int64()), pa.array(np.full(len(pos), sub.as_py()), pa.int32()), pa.array(pos), pa.array(h)], ["_did", "_sub", "pos", "h"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ds = zstandard.ZstdDecompressor()
        for b in batches:
            for did, sub, z, at in zip(*b.columns, strict=True):
                data, pos = unpack(z, ds), at.as_py()
                ctx = [data[max(0, p - BEFORE) : p + LENGTH] for p in pos]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([did.as_py()] * len(pos), pa.int64()), pa.array([sub.as_py()] * len(pos), pa.int32()), pa.array(pos, pa.int32()), pa.array([min(p, BEFORE) for p in pos], pa.int32()), pa.array(ctx, pa.binary())],
                    ["_did", "_sub", "pos", "l", "ctx"],
                )

    chosen = scratch.save(packed.mapInArrow(anchors, "_did long, _sub int, pos int, h long"), "anchors")
    # a table of its own, so that both sides of the join come from a shuffle and a frequent token's side can be split
    repeated = scratch.save(chosen.groupBy("h").count().filter("count > 1").select("h"), "repeated")
    marks = scratch.save(chosen.join(repeated, "h").groupBy("_did", "_sub").agg(F.collect_list("pos").alias("at")), "marks")
    scratch.drop(chosen)
    scratch.drop(repeated)
    suffixes = scratch.save(packed.join(marks, ["_did", "_sub"]).select("_did", "_sub", "z", "at").mapInArrow(contexts, "_did long, _sub int, pos int, l int, ctx binary"), "suffixes")
    by = [F.substring("ctx", F.col("l") + 1, F.lit(LEAD)), "_did", "_sub", "pos"]
    said = scratch.save(suffixes.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_buckets, _RANGES), "compared")
    scratch.drop(suffixes)

    # a part tells each content once, so a window holds one row a part at most
    place = F.struct("_did", "_sub", "s")
    late = (place > F.min(place).over(Window.partitionBy("w1", "w2"))).alias("late")
    side = said.filter("ctx is not null").withColumns({"w1": F.xxhash64("l", "ctx"), "w2": F.xxhash64(F.lit(1), "l", "ctx")})
    met = scratch.save(side.select("_did", "_sub", "s", "l", "ctx", "known", late), "met")
    whole = met.filter(F.col("late") & (F.length("ctx") >= LENGTH)).select("_did", "_sub", (F.col("s") - F.col("l")).alias("s"), (F.col("s") - F.col("l") + F.length("ctx")).alias("e"))
    # neighbours in the order of what follows, and in that of what stands before, tell which strings can be another's at all
    order = [F.expr(f"substring(ctx, l + 1, {LENGTH})"), "_did", "_sub", "s"]
    ahead = met.filter("not late").select(*_MET).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_ahead, "_did long, _sub int, s long, l int, ctx binary, known binary, a int, back binary")
    ahead = scratch.save(ahead, "ahead")
    order = ["back", "_did", "_sub", "s"]
    strings = ahead.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_opened, "_did long, _sub int, s long, w1 long, w2 long")
    across = strings.select("_did", "_sub", "s", late).filter("late").select("_did", "_sub", "s", (F.col("s") + LENGTH).alias("e"))
    return said.filter("ctx is null").select("_did", "_sub", "s", "e").unionByName(whole).unionByName(across)


def dedup_substrings(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row of docs (doc_id, text).

    A text is its UTF-8 bytes. A byte is removed if a string of 100 bytes covers it that also starts earlier: in a document
    with a smaller doc_id or earlier in the same one (overlaps count; strings are judged on the input). n_spans counts the
    maximal removed runs, kept is what is left.

    Suffixes are sampled at tokens (24 bytes) that every string around them would choose, and only those with a token
    found twice are kept, with the bytes around them. Sampled splitters over (token, document, position) range-partition
    them, so a frequent token fills as many buckets as it needs. Within a bucket, suffixes of equal tokens are sorted by a
    multikey quicksort, as is what stands before them; the lengths common to neighbours in the two orders say which strings
    around the token are equal, and all but the earliest of them are late.
    What a bucket's first and last group leave open is compared across the boundaries in shuffles by content: first the
    bytes around a suffix as a whole, then the strings of those that are new. Of these strings only such are opened as another
    suffix can have: those within the bytes that a suffix shares with its neighbours, where all open suffixes are sorted by
    what follows and then by what stands before. No pair of suffixes is formed.

    Null text: empty, nothing removed. Texts under 100 bytes lose nothing. Rows with a null doc_id come before all
    others. Rows that repeat a doc_id and text are one document and get equal results. An empty table gives no rows; other
    columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows, distinct = keyed(docs.select("doc_id", "text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.compress(t.as_buffer().to_pybytes()) for t in b.column(2)], pa.binary())], ["_did", "_sub", "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ds = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[list] = [[], [], [], []]
            for z, copy, starts, ends in zip(*b.columns[1:], strict=True):
                data, kept, at, spans, end = ds.decompress(z.as_buffer()), [], 0, 0, -1
                for s, e in [(0, len(data))] if copy.is_valid else sorted(zip(starts.as_py() or (), ends.as_py() or (), strict=True)):
                    if s > end:
                        spans += 1
                        kept.append(data[at:s])
                    end = at = max(end, e)
                kept.append(data[at:])
                left = b"".join(kept)
                for col, v in zip(out, (len(data), len(data) - len(left), spans, left), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.binary())], ["_did", "n_bytes", "n_removed", "n_spans", "kept"])

    # exact copies of 100 bytes or more go as a whole: only the first of each text is sorted
    hashed = distinct.select("_did", "_sub", F.xxhash64("_text").alias("h1"), F.xxhash64(F.lit(1), "_text").alias("h2"), F.octet_length("_text").alias("n"))
    firsts = hashed.groupBy("h1", "h2", "n").agg(F.min(F.struct("_did", "_sub")).alias("first"), F.count("*").alias("c")).filter(f"c > 1 and n >= {LENGTH}")
    firsts = scratch.save(firsts, "firsts")  # a table of its own, so that the many rows of one text can be split
    copies = scratch.save(hashed.join(firsts, ["h1", "h2", "n"]).filter(F.struct("_did", "_sub") > F.col("first")).select("_did", "_sub", F.lit(True).alias("copy")), "copies")
    schema = "_did long, _sub int, z binary"
    packed = scratch.save(distinct.select("_did", "_sub", "_text").mapInArrow(pack, schema).join(copies, ["_did", "_sub"], "left"), "packed")
    ranges = removed_ranges(packed.filter("copy is null").drop("copy"), scratch).groupBy("_did", "_sub").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    texts = packed if not distinct.repeats else rows.select("_did", "_sub").join(packed, ["_did", "_sub"])
    done = texts.join(ranges, ["_did", "_sub"], "left").select("_did", "z", "copy", "s", "e").mapInArrow(cut, "_did long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumn("doc_id", F.when(F.col("_did") != -(2**63), F.col("_did"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")

