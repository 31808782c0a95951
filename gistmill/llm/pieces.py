"""SentencePiece encoding by a relational lattice over the vocabulary of words, and decoding."""

from __future__ import annotations

import contextlib
import ctypes
import re
import string
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keyed

SPACE = "▁"
#: Words of up to so many characters are folded over a mask of 64 boundaries; longer ones merge in a heap.
MASKED = 62
#: Most words whose ids are broadcast (about 20 MB); other words' ids are joined to their documents.
FREQUENT = 200_000
#: Texts whose words are looked up at a time.
SLICE = 1024

@dataclass
class Model:
    """A model's pieces. ids: of texts that may be merged or stand alone; rank: their order of merging (0 first).

    Words are what no piece reaches beyond: spaces with what follows them, cut again between a letter and a mark that no
    piece has after a letter.
    """

    ids: dict[str, int]
    rank: dict[str, int]
    byte: list[int]
    unknown: int
    text: list[str | int] = field(default_factory=list)  # of each id: its text, its byte, or '' if it stands for none
    raw: pa.Array | None = None
    word: re.Pattern = re.compile("")  # the pattern of words
    marks: frozenset[str] = frozenset()  # marks that no piece has after a letter

    @staticmethod
    def load(path: str) -> Model:
        """Reads a BPE model on the driver. Raises ValueError for pieces that reach over a word's end."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        ids = {p.id_to_piece(i): i for i in plain}
        if any(SPACE in t.lstrip(SPACE) or "\n" in t for t in ids):
            raise ValueError("a piece holds a space or newline after another character")
        bytes_ = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        order = sorted((i for i in plain if len(p.id_to_piece(i)) > 1), key=lambda i: (-p.get_score(i), i))
        text: list[str | int] = [""] * n
        for t, i in ids.items():
            text[i] = t
        for b, i in bytes_.items():
            text[i] = b
        after = {b for t in ids for a, b in zip(t, t[1:], strict=False) if a.isalpha()}  # what a letter may merge with
        free = frozenset(c for c in string.punctuation if c not in after)
        marks = re.escape("".join(sorted(free)))
        word = f"{SPACE}*(?:[^\\W\\d_]++(?![^{SPACE}\n{marks}])|[^{SPACE}\n]+)|{SPACE}+|\n" if marks else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
        return Model(ids, {p.id_to_piece(i): k for k, i in enumerate(order)}, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else [], p.unk_id(), text, None, re.compile(word), free)

    def chunks(self, text: str) -> list[str]:
        """What stands between spaces, as keys: each is a run of words after one space, which is left out (further ones are
        U+2581). A text has a space put before it; an empty one has no chunks."""
        if "  " in text or SPACE in text or text[:1] == " " or text[-1:] == " ":
            return [c[1:] for c in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        return text.split(" ") if text else []

    def split(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct chunks of texts; of all their chunks, in order, the numbers in these; the texts' ends in those, 0 first."""
        every, ends = self.every_chunk(pa.array(texts, pa.large_string()))
        every = every.dictionary_encode()
        return every.dictionary.to_pylist(), every.indices.to_numpy(), ends

    def every_chunk(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All chunks of texts (large_string), in order, and the texts' ends in them, 0 first. A null text has none."""
        full = pc.fill_null(pc.not_equal(texts, ""), False)
        texts = texts.filter(full)
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        if odd.true_count:
            texts = pa.array([" ".join(self.chunks(t)) if o else t for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.large_string())
        lists = pc.split_pattern(texts, " ")
        sizes = np.zeros(len(full), np.int64)
        sizes[full.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy()
        return lists.flatten(), np.concatenate([[0], np.cumsum(sizes)])

    def cut(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of chunks (large_string) in order, and the number of each one's chunk. Chunks of letters alone, or with
        one mark behind them, are cut as columns."""
        letters = pc.utf8_is_alpha(chunks)
        marked = none = pa.array(np.zeros(len(chunks), bool))
        if self.marks:
            body, last = pc.utf8_slice_codeunits(chunks, 0, -1), pc.utf8_slice_codeunits(chunks, -1)
            marked = pc.and_(pc.is_in(last, pa.array(sorted(self.marks), pa.large_string())), pc.utf8_is_alpha(body))
            if not "".join(["a", *body.filter(pc.and_not(marked, pc.string_is_ascii(body))).to_pylist()]).isalpha():
                marked = none  # letters must be letters to words() as well
        other = pc.invert(pc.or_(letters, marked))
        rest = list(map(self.words, chunks.filter(other).to_pylist()))
        of = [np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (letters, marked, marked, other)]
        of[3] = np.repeat(of[3], np.fromiter(map(len, rest), np.int64, len(rest)))
        words = [spaced(chunks.filter(letters)), *([spaced(body.filter(marked)), last.filter(marked)] if self.marks else []), pa.array([w for ws in rest for w in ws], pa.large_string())]
        number = np.concatenate(of)  # nothing is marked without marks
        by = np.argsort(number, kind="stable")
        return pa.concat_arrays(words).take(pa.array(by)), number[by]

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk, as self.word finds them. Letters alone, or with one mark behind them, need no search, nor do
        two such with a newline between, as no word reaches over one."""
        if self.marks:
            if chunk.isalpha():
                return [SPACE + chunk]
            if chunk[-1:] in self.marks and (body := chunk[:-1]).isalpha():
                return [SPACE + body, chunk[-1]]
            if "\n" in chunk:
                a, _, b = chunk.partition("\n")
                out = [SPACE + a] if a.isalpha() else [SPACE + a[:-1], a[-1]] if a[-1:] in self.marks and a[:-1].isalpha() else self.word.findall(SPACE + a)
                out.append("\n")
                out += [b] if b.isalpha() else [b[:-1], b[-1]] if b[-1:] in self.marks and b[:-1].isalpha() else self.word.findall(b)
                return out
        return self.word.findall(SPACE + chunk)

    def tally(self, texts: pa.Array) -> pa.RecordBatch:
        """(word, n): the words of texts and how often they occur. Distinct chunks are counted first."""
        chunks, n = pc.value_counts(self.every_chunk(texts.cast(pa.large_string()))[0]).flatten()
        words, of = self.cut(chunks)
        words = words.dictionary_encode()
        total = np.bincount(words.indices.to_numpy(), n.to_numpy()[of], len(words.dictionary)).astype(np.int64)
        return pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), pa.array(total)], ["word", "n"])

    def spelling(self, texts: pa.Array, frequent: pa.Array) -> Spelling:
        """The words of texts (large_string) as numbers, told apart by whether they are in `frequent` (large_string)."""
        every, ends = self.every_chunk(texts)
        every = every.dictionary_encode()
        at = every.indices.to_numpy()
        whole = pc.index_in(spaced(every.dictionary), frequent)  # a word with a space before it is a chunk's only one
        new = np.flatnonzero(whole.is_null().to_numpy(zero_copy_only=False))
        words, of = self.cut(every.dictionary.take(pa.array(new)))
        words = words.dictionary_encode()
        number = pc.index_in(words.dictionary, frequent)
        rare = number.is_null().to_numpy(zero_copy_only=False)
        # words by number: frequent ones first, then rare ones. 4 bytes hold what a batch has of words
        number = np.where(rare, len(frequent) + np.cumsum(rare) - 1, pc.fill_null(number, 0).to_numpy())[words.indices.to_numpy()]
        size = np.ones(len(whole), np.int32)
        size[new] = np.bincount(of, minlength=len(new))
        start = np.cumsum(size, dtype=np.int32) - size
        flat = np.repeat(pc.fill_null(whole, 0).to_numpy(), size)
        flat[np.repeat(whole.is_null().to_numpy(zero_copy_only=False), size)] = number
        many = size[at]
        upto = np.cumsum(many, dtype=np.int32)
        sequence = flat[np.repeat(start[at] - upto + many, many) + np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)]
        ends = np.concatenate([[0], upto])[ends]
        # rare words of a text in the order in which they first occur
        where = np.flatnonzero(sequence >= len(frequent))
        word, text = sequence[where].astype(np.int64) - len(frequent), np.searchsorted(ends, where, "right") - 1
        first = np.sort(np.unique(text * (rare.sum() + 1) + word, return_index=True)[1])
        return Spelling(sequence, ends, words.dictionary.filter(pa.array(rare)), text[first], word[first])

    def ids_of(self, word: str, cuts: list[int]) -> list[int]:
        """The ids of a word that is cut at the given ends."""
        out, at = [], 0
        for end in cuts:
            t, at = word[at:end], end
            if (i := self.ids.get(t)) is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in t.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]
        return out

    @property
    def code(self) -> str:
        """The type of packed ids, of 2 bytes where they fit."""
        return "H" if len(self.text) <= 1 << 16 else "i"

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids cut at ends (0 first): bytes are joined to characters, the space put before a text is taken off."""
        if self.raw is None:
            self.raw = pa.array([bytes([t]) if isinstance(t, int) else t.encode() for t in self.text], pa.large_binary())
        data, at = gathered(self.raw, ids)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at[ends]), data])
        try:
            texts = whole.cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that are no characters
            texts = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.large_string())
        return pc.replace_substring_regex(pc.replace_substring(texts, SPACE, " "), "^ ", "", max_replacements=1).cast(pa.string())


@dataclass
class Spelling:
    """Of texts: the numbers of their words in order, cut at ends (0 first); numbers from that of frequent words on are rare
    words'. (text, word): which rare words a text has, in the order in which they first occur."""

    sequence: np.ndarray
    ends: np.ndarray
    rare: pa.Array
    text: np.ndarray
    word: np.ndarray


def spaced(chunks: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), chunks, pa.scalar("", pa.large_string()))


def gathered(values: pa.Array, at: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of values (large_binary) at given places, joined, and the end of each in these, 0 first."""
    if not len(at):
        return pa.py_buffer(b""), np.zeros(1, np.int64)
    taken = values.take(pa.array(at))
    return taken.buffers()[2], np.frombuffer(taken.buffers()[1], np.int64, len(at) + 1)


def merged_cuts(word: str, rank: dict[str, int]) -> list[int]:
    """The ends of a word's pieces: the pair that gives the first piece in order merges first, the leftmost of equal ones."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # symbols are named by their starts
    alive = [True] * n

    def entry(a: int) -> tuple[int, int, int, int] | None:
        b = after[a]
        if b >= n:
            return None
        r = rank.get(word[a : after[b]])
        return None if r is None else (r, a, b, after[b])

    heap = [e for e in map(entry, range(n)) if e]
    heapify(heap)
    while heap:
        _, a, b, end = heappop(heap)
        if not (alive[a] and alive[b] and after[a] == b and after[b] == end):
            continue
        alive[b], after[a] = False, end
        if end < n:
            before[end] = a
        for s in (a, before[a]):
            if s >= 0 and (e := entry(s)):
                heappush(heap, e)
    return [after[s] for s in range(n) if alive[s]]


def may_come_late(rank: dict[str, int]) -> set[str]:
    """Pieces after whose merge an earlier one can become possible: a piece of lower rank that consists of such a piece and
    one more symbol. (What a merge makes possible has it at one end; with something at both, two boundaries would be left.)"""
    late = set()
    for piece, r in rank.items():
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            if (len(a) == 1 or a in rank) and (len(b) == 1 or b in rank):
                late.update(x for x in (a, b) if rank.get(x, -1) > r)
    return late


def lattice(vocabulary: DataFrame, model: Model) -> DataFrame:
    """(word, n, mask): vocabulary (word, n) with the boundaries of each word's pieces, bit i for a cut after i characters.

    A word's substrings of the sizes that pieces with the same first three characters have are exploded and equi-joined to the
    table of pieces; what matches are the edges of its lattice, grouped by word in the order in which pieces merge. A
    higher-order aggregate folds them over the mask of boundaries, all set at first: an edge whose ends are boundaries with exactly one boundary
    between takes that one away. One pass is exact unless a merge makes an earlier edge possible after its turn; the fold
    checks that at each merge of a piece of may_come_late() and then leaves mask null, as it is for words over MASKED
    characters. The tables of pieces and sizes are fixed parts of the model and are broadcast. Groups stay where the vocabulary's own exchange has put the words.
    """
    spark = vocabulary.sparkSession
    late = may_come_late(model.rank)
    table = spark.createDataFrame([(p, r, p in late) for p, r in model.rank.items()], "piece string, r long, late boolean")
    sizes: dict[str, set[int]] = {}  # of pieces by their first three characters; pairs are looked up anywhere
    for p in model.rank:
        if len(p) > 2:
            sizes.setdefault(p[:3], {2}).add(len(p))
    sized = spark.createDataFrame([(p, sorted(x)) for p, x in sizes.items()], "first string, sizes array<int>")
    folded = F.col("len").between(2, MASKED)
    # the outer forms keep words that have no edge, so that the vocabulary is read once
    starts = vocabulary.withColumn("len", F.char_length("word")).select("word", "n", "len", F.explode_outer(F.when(folded, F.sequence(F.lit(0), F.col("len") - 2))).alias("s"))
    starts = starts.withColumn("first", F.substring("word", F.col("s") + 1, F.lit(3))).join(F.broadcast(sized), "first", "left")
    of = F.when(F.col("s").isNotNull(), F.coalesce("sizes", F.array(F.lit(2))))
    spans = starts.select("word", "n", "len", "s", F.explode_outer(of).alias("size")).withColumn("e", F.col("s") + F.col("size")).filter("s is null or e <= len")
    hits = spans.select("word", "n", "s", "e", F.substring("word", F.col("s") + 1, F.col("size")).alias("piece")).join(F.broadcast(table), "piece", "left")
    # of substrings that are no piece only a word's first stays, for words without edges
    hits = hits.filter("r is not null or s is null or (s = 0 and e = 2)")
    # an edge is a number that sorts by rank and start: rank, start and end (6 bits each, as MASKED is under 64), late
    edge = ((F.col("r") * 64 + F.col("s")) * 64 + F.col("e")) * 2 + F.col("late").cast("int")
    edges = hits.groupBy("word").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(edge)).alias("edges"))
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
    start, end = (lambda x, k=k: F.shiftright(x, k).bitwiseAND(F.lit(63)).cast("int") for k in (7, 1))
    inner = lambda x: one(end(x)) - one(start(x) + 1)

    def fits(mask, x):
        at = lambda k: F.call_function("shiftright", mask, k).bitwiseAND(F.lit(1)) == 1
        return at(start(x)) & at(end(x)) & (F.bit_count(mask.bitwiseAND(inner(x))) == 1)

    def fold(mask, x):
        cut = mask.bitwiseAND(F.bitwise_not(inner(x)))
        missed = (x.bitwiseAND(F.lit(1)) == 1) & F.exists("edges", lambda y: (F.shiftright(y, 13) < F.shiftright(x, 13)) & fits(cut, y))
        return F.when(mask.isNull() | ~fits(mask, x), mask).when(missed, F.lit(None)).otherwise(cut)

    length = F.char_length("word")
    full = one(length + 1) - 1
    return edges.select("word", "n", F.when(length <= MASKED, F.aggregate("edges", full, fold)).alias("mask"))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that only few texts and ids are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker, which Spark keeps for later tasks, gives back what it doesn't use any more."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()  # what other operators' tasks left
        yield from run(batches)
        trim()

    return whole


def trim() -> None:
    """Gives free memory of Arrow and of the C library back to the system, where these can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def spelled(cuts: DataFrame, model: Model) -> DataFrame:
    """(word, n, ids): the ids of each word of lattice(), packed with model.code. A word without a mask merges in a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for word, mask in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                ends = merged_cuts(word, model.rank) if mask is None else [i for i in range(1, len(word) + 1) if mask >> i & 1]
                out.append(array(model.code, model.ids_of(word, ends)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["word", "n", "ids"])

    return cuts.mapInArrow(_released(run), "word string, n long, ids binary")


def counted(texts: DataFrame, model: Model) -> DataFrame:
    """(word, n): the words of all texts (one column) and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                yield model.tally(b.column(0).slice(at, 2048))

    return texts.mapInArrow(_released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(words: DataFrame, most: int) -> F.Column:
    """Whether a row of words (n) is one of the `most` most frequent: a threshold on n, found from counts by eighths of powers of two."""
    of = F.floor(F.log2("n") * 8)
    sizes = {r["b"]: r["count"] for r in words.groupBy(of.alias("b")).count().collect()}
    least, total = max(sizes, default=0) + 1, 0
    for b in sorted(sizes, reverse=True):
        if total + sizes[b] > most:
            break
        least, total = b, total + sizes[b]
    return of >= least


def encode(docs: DataFrame, model: Model, scratch: Scratch | None = None, frequent: int = FREQUENT, decoded: bool = False) -> DataFrame:
    """(doc_id, text, ids array<int>) of every row of docs: the ids that the model's own library gives for the whole text.

    With `decoded`, the text of the ids follows as the column decoded, by the same worker (see decode()).

    Words are counted on the map side; lattice() cuts each distinct word once, and spelled() gives it its ids. The ids of
    the most frequent words (`frequent` at most) are broadcast. A document numbers its other words in the order in which
    they first occur; the ids of these are joined by word and travel to the document under their numbers. Null text: no
    ids (and text stays null); empty text: no ids. U+2581 in a text is a space to the model and comes back as one. Rows
    that repeat, also with a null doc_id, get equal results. An empty table gives no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows, distinct = keyed(docs.select("doc_id", "text"))
    cut = scratch.save(spelled(lattice(counted(distinct.select("_text"), model), model), model), "cuts")
    often = most_frequent(cut, frequent)
    found = cut.filter(often).select("word", "ids").toArrow()  # columns, not rows: a small part of the driver's memory
    often_words, often_ids = (found.column(c).combine_chunks().cast(k) for c, k in (("word", pa.large_string()), ("ids", pa.large_binary())))
    del found

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, SLICE):
            got = model.spelling(b.column(2).cast(pa.large_string()), often_words)
            sizes = np.bincount(got.text, minlength=b.num_rows)
            numbers = np.arange(len(got.text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            of = pa.array(got.text)
            cols = [b.column(0).take(of), b.column(1).take(of), pa.array(numbers, pa.int32()), got.rare.take(pa.array(got.word)).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["_did", "_sub", "i", "word"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in _small(batches):
            texts = [z.compress(t.as_buffer()) if t.is_valid else None for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(texts, pa.binary())], ["_did", "_sub", "doc_id", "z"])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        size = np.dtype(model.code).itemsize
        for b in _small(batches, SLICE):
            texts = pa.array([z.decompress(t.as_buffer()) if t.is_valid else None for t in b.column(1)], pa.large_binary()).cast(pa.large_string())
            got = model.spelling(texts, often_words)
            # a text's own ids come under the numbers of its rare words in the order in which they first occur
            own = b.column(2).flatten()
            by = np.lexsort((own.field("i").to_numpy(), np.repeat(np.arange(b.num_rows), pc.fill_null(b.column(2).value_lengths(), 0).to_numpy())))
            if len(by) != len(got.word):
                raise ValueError("the ids of rare words don't belong to the texts")
            place = np.zeros(len(got.rare), np.int64)
            place[got.word[::-1]] = by[::-1]
            values = pa.concat_arrays([often_ids, own.field("ids").cast(pa.large_binary()).take(pa.array(place))])
            for s in range(0, b.num_rows, 256):
                ends = got.ends[s : s + 257]
                data, cuts = gathered(values, got.sequence[ends[0] : ends[-1]])
                flat, ends = np.frombuffer(data, model.code, cuts[-1] // size).astype(np.int32), cuts[ends - ends[0]] // size
                again = [model.decoded(flat, ends)] if decoded else []
                cols = [b.column(0)[s : s + 256], texts[s : s + 256].cast(pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), *again]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "ids", "decoded"][: len(cols)])

    found = distinct.select("_did", "_sub", "_text").mapInArrow(_released(rare), "_did long, _sub int, i int, word string")
    met = scratch.save(found.join(cut.filter(~often).select("word", "ids"), "word").select("_did", "_sub", "i", "ids"), "rare")
    scratch.drop(cut)
    # dealt out as rows, which are smaller than lists of one
    own = met.repartition("_did", "_sub").groupBy("_did", "_sub").agg(F.collect_list(F.struct("i", "ids")).alias("own"))
    texts = rows.select("_did", "_sub", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text")).mapInArrow(_released(packed), "_did long, _sub int, doc_id long, z binary")
    return texts.join(own, ["_did", "_sub"], "left").select("doc_id", "z", "own").mapInArrow(_released(ids), "doc_id long, text string, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """encoded (doc_id, ids, ...) with the column decoded: the text of ids. A null array gives null, an empty one ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("ids")
        for b in _small(batches):
            every = [np.zeros(0, np.int32) if x is None else np.array(x, np.int32) for x in b.column(at).to_pylist()]
            got = model.decoded(np.concatenate([np.zeros(0, np.int32), *every]), np.cumsum([0, *map(len, every)]))
            got = pc.if_else(b.column(at).is_valid(), got, None)
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*names, "decoded"])

    encoded = encoded.drop("decoded")
    names = encoded.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, decoded string")


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_ids, ids_hash, decoded_sha256, round_trip) of decode(encode()); ids_hash is Spark's xxhash64 of the array."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )
