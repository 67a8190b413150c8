"""Best-two-fit packing of token pieces into sequences of a fixed capacity."""

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strandloom.llm.rows import Shared, bound_batches, release
from strandloom.llm.scratch import Scratch

CAPACITY = 2048
#: Parts of words that a Python worker keeps the ids of, some 8 MB, and words that have no such parts, some 50 MB.
CACHED = OTHERS = 200_000
#: Bytes of texts that are encoded at once, about; and parts that the library gets at once.
BLOCK, STEP = 3 << 20, 1 << 11
#: Pieces of one length that a task ranks, about; rows that are broadcast at most; and numbers that tell equal rows apart.
BUCKET, BROADCAST, SALTS = 1 << 10, 1 << 20, 1 << 10

#: The tokenizer's own splitting pattern.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that are white space for splitting here and not for the tokenizer; characters that act on others, or whose lower case is far off.
_ODD_SPACE, _RARE = "[\x1c-\x1f]", "[^\\x{00}-\\x{12f}\\x{131}-\\x{239}\\x{23b}-\\x{23d}\\x{23f}-\\x{24f}]"
#: Of all other characters: 1 a letter, 2 a number, 0 neither.
_KINDS = np.array(["LN".find(unicodedata.category(chr(k))[0]) + 1 for k in range(0x250)], np.uint8)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _lists(rows: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)]) // 4
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<u4")))


class Encoder:
    """Ids of texts, equal to those of the whole tokenizer.

    A batch's texts are split at white space, which always parts tokens here, and each different word is looked at once.
    In words of Latin letters normalising, lower-casing and splitting act on single characters; so the different parts of
    such words go to the library's model alone, many at once, if they aren't known from earlier batches. Other words, and
    texts with odd white space, go through the library's whole chain. So do texts that hold an added token, if special:
    those then get its id, as is the library's default; else added tokens are text like any other.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker is one of many, and gives the library one string at once
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not special
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()] if special else []
        letters, vocabulary = _byte_letters(), self.whole.get_vocab(with_added_tokens=False)
        self.letters = {b: x for b, x in enumerate(letters) if b != ord(" ")}
        self.joined = Tokenizer(self.whole.model)
        self.joined.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        #: Whether an id is the last of its part. All parts have one such id if each letter has a form with the suffix.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = self.whole.model.end_of_word_suffix
        if suffix and all(x in vocabulary and x + suffix in vocabulary for x in letters):
            self.last[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        #: Parts that were asked for of late, and their ids; other words and theirs.
        self.known, self.ids = pa.array([], pa.string()), _lists([])
        self.others: dict[str, bytes] = {}

    def chain(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _other(self, word: str) -> bytes:
        if (out := self.others.get(word)) is None:
            if len(self.others) >= OTHERS:
                self.others.clear()
            self.others[word] = out = self.chain(word)
        return out

    def _model(self, parts: pa.StringArray) -> pa.ListArray:
        """The ids of each part by the library's model."""
        found = [_lists([])]
        for at in range(0, len(parts), STEP):
            some = parts.slice(at, STEP)
            text = " ".join(some.to_pylist())
            if not (text.isascii() and text.isprintable()):
                text = text.encode().decode("latin-1").translate(self.letters)
            (encoding,) = self.joined.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(encoding.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                found.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids)))
            else:  # a vocabulary without ends
                found.append(_lists([array("I", [t.id for t in self.whole.model.tokenize(x)]).tobytes() for x in text.split(" ")]))
        return pa.concat_arrays(found)

    def _known(self, parts: pa.StringArray) -> pa.ListArray:
        """The ids of each of different parts. These are known from now on, and others as far as there is room."""
        place = pc.fill_null(pc.index_in(parts, value_set=self.known), -1).to_numpy().copy()
        new, idle = place < 0, np.ones(len(self.known), bool)
        idle[place[~new]] = False
        place[new] = len(self.known) + np.arange(new.sum())
        found = pa.concat_arrays([self.ids, self._model(parts.filter(pa.array(new)))]).take(pa.array(place))
        rest = pa.array(np.flatnonzero(idle)[: max(0, CACHED - len(parts))])
        self.known = pa.concat_arrays([parts.slice(0, CACHED), self.known.take(rest)])
        self.ids = pa.concat_arrays([found.slice(0, CACHED), self.ids.take(rest)])
        return found

    def _words(self, words: pa.StringArray) -> pa.ListArray:
        """The ids of each word without rare characters: its parts tile it, and begin where the kind of characters changes."""
        words = pc.utf8_lower(words)
        at = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1] if len(words) else np.zeros(1, np.int32)
        text = words.buffers()[2] or pa.py_buffer(b"")
        data = np.frombuffer(text, np.uint8)[: at[-1]]
        kind = _KINDS[data]
        lead = np.flatnonzero(data >= 0xC0)  # these characters have two bytes
        kind[lead] = kind[lead + 1] = _KINDS[(data[lead] & 31).astype(np.int32) << 6 | data[lead + 1] & 63]
        begins = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 2))[: len(data)]
        begins[lead + 1] = False
        begins[at[at < len(data)]] = True
        for k in np.unique(np.searchsorted(at, np.flatnonzero(data == ord("'")), side="right") - 1).tolist():  # 's and the like
            low, high = at[k : k + 2].tolist()
            begins[low + 1 : high] = False
            for part in _PARTS.findall(data[low:high].tobytes().decode())[:-1]:
                low += len(part.encode())
                begins[low] = True
        starts = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), text).dictionary_encode()
        found = self._known(parts.dictionary).take(parts.indices)
        return pa.ListArray.from_arrays(found.offsets.take(pa.array(np.searchsorted(starts, at))), found.values)

    def encode(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end after each, and where each text's begin among them. A null text is an empty one."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        lines = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        words = lines.flatten().dictionary_encode()
        rare = pc.match_substring_regex(words.dictionary, _RARE)
        more = [self._other(w) for w in words.dictionary.filter(rare).to_pylist()]
        whole = [self.chain(x) for x in texts.filter(odd).to_pylist()]
        ids = pa.concat_arrays([self._words(words.dictionary.filter(pc.invert(rare))), _lists([*more, *whole, array("I", end).tobytes()])])
        # the place of each word's ids: plain ones, rare ones, odd texts, the end
        rare, odd = rare.to_numpy(zero_copy_only=False), odd.to_numpy(zero_copy_only=False)
        place, last = np.argsort(np.argsort(rare, kind="stable"), kind="stable")[words.indices.to_numpy()], len(ids) - 1
        after = lines.offsets.to_numpy()[1:]
        tail = np.full((len(after), 2), last)
        tail[odd, 0] = last - len(whole) + np.arange(len(whole))
        use = np.column_stack([odd, np.ones(len(after), bool)])
        place = np.insert(place, np.repeat(after, 2)[use.ravel()], tail[use])
        found = ids.take(pa.array(place))
        return found.values.to_numpy(), found.offsets.to_numpy()[np.append(0, after + np.cumsum(use.sum(1)))]


#: The worker's encoder, for its tasks.
_encoder = Shared()


def encoder(path: str, special: bool = False) -> Encoder:
    """The worker's encoder; _leave() when done with it."""
    return _encoder.take((path, special), lambda: Encoder(path, special))


def _leave() -> None:
    _encoder.leave()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches of ids and texts, some BLOCK bytes of texts at once, or one row."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(size // BLOCK)) + 1).tolist(), b.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low < high:
                yield b.slice(low, high - low)


def tokenize(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end: int = 0, with_ids: bool = False, special: bool = False, salted: bool = False) -> DataFrame:
    """Pieces of at most capacity ids: doc_id, piece, start, length, ids_crc32, and ids if asked for.

    A null text is an empty one: the end id alone. tokenizer is a file that each executor has. special: added tokens that
    a text holds, as <|endoftext|>, get their ids, as by the library's default; else they are text. salted: a number that
    tells rows of one task apart which repeat an id and a text.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_column].dataType.simpleString()
    shape = _parse_datatype_string(f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids + ", salt int" * salted)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, into, rows = encoder(path, special), to_arrow_schema(shape), 0
        try:
            for b in blocks(batches):
                ids, at = coder.encode(b.column(1), [end])
                n = -(-np.diff(at) // capacity)
                doc = np.repeat(np.arange(b.num_rows), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                low = at[doc] + piece * capacity
                high = np.minimum(low + capacity, at[doc + 1])
                cols = [b.column(0).take(pa.array(doc)), piece, low - at[doc], high - low, [zlib.crc32(ids[x:y]) for x, y in zip(low.tolist(), high.tolist(), strict=True)]]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(low, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                if salted:
                    cols.append((rows + doc) % SALTS)
                rows += b.num_rows
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, into, strict=True)], schema=into)
                del b, ids, at, cols
                pa.default_memory_pool().release_unused()
        finally:
            del coder
            _leave()
            release()

    return docs.select(F.col(f"`{id_column}`").alias("c0"), F.col(f"`{text_column}`").alias("c1")).mapInArrow(run, shape)


@dataclass
class Plan:
    """For pieces of one length with rank low to high - 1 among them: k of them in a row share a sequence, from offset on."""

    length: np.ndarray
    low: np.ndarray
    k: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length << 44 | self.low
        row = np.searchsorted(key, length << 44 | rank, side="right") - 1
        past, k = rank - self.low[row], self.k[row]
        return self.sequence[row] + past // k, self.offset[row] + past % k * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-two-fit over the number of pieces of each length, which is all that packing depends on.

    A sequence is filled greedily with the longest piece that fits the gap. Then its smallest piece, of length s, gives
    way to two unpacked pieces whose lengths sum to more than s and, of all pairs, fill the gap and s together best. The
    next sequences come out the same until some length runs short, so one step settles as many as that allows; steps
    depend on the lengths in use, at most capacity, and hardly on the number of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    rank, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            break
        used: dict[int, int] = {}
        gap, i = capacity, len(have) - 1
        while i >= 0:
            length = int(have[i])
            if length <= gap:
                n = min(gap // length, int(left[length]))
                used[length], gap = n, gap - n * length
            i = min(i, int(np.searchsorted(have, gap, side="right"))) - 1
        s = min(used)
        if gap and sum(used.values()) > 1 or gap >= 1 and len(used) == 1:
            room = gap + s
            free = left.copy()
            for length, n in used.items():
                free[length] -= n
            open_ = np.flatnonzero(free[: room + 1])
            if len(open_):
                # for each a, the longest b <= a that fits with it; of equals, only if there are two
                b = np.searchsorted(open_, np.minimum(room - open_, open_), side="right") - 1
                same = (b == np.arange(len(open_))) & (free[open_] < 2)
                b = b - same
                total = np.where(b >= 0, open_ + open_[np.maximum(b, 0)], 0)
                best = int(total.argmax())
                if total[best] > s:
                    used[s] -= 1
                    for length in (int(open_[best]), int(open_[b[best]])):
                        used[length] = used.get(length, 0) + 1
        used = {length: n for length, n in used.items() if n}
        times = min(int(left[length]) // n for length, n in used.items())
        offset = 0
        for length, n in used.items():
            rows.append((length, int(rank[length]), n, sequence, offset))
            rank[length] += n * times
            left[length] -= n * times
            offset += n * length
        sequence += times
    rows.sort()
    return Plan(*(np.array(c, np.int64) for c in zip(*rows, strict=True)), sequence) if rows else Plan(*(np.zeros(0, np.int64) for _ in range(5)), 0)


def pack(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end: int = 0, special: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than the capacity are cut. Null and empty texts pack as the end id alone; repeated rows pack
    each for itself; an empty table gives no rows; null ids stay. Other columns aren't read.

    The driver gets one row a length, at most capacity rows, and sends back a plan bounded by the capacity. A piece finds
    its place by its rank among pieces of its length. Ranks come from counts of (length, bucket): buckets are hashes of
    pieces, as many as it takes for BUCKET pieces each, so even if all pieces have one length, no task sorts more than its
    share. The counts, at most capacity rows and one for each BUCKET pieces, are broadcast up to BROADCAST rows (some
    40 MB), and joined by a sort beyond that.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.keep(tokenize(docs, tokenizer, id_column, text_column, capacity, end, special=special, salted=True), "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    laid = plan(lengths, capacity)
    buckets = F.element_at(F.array(*[F.lit(-(-lengths.get(k, 0) // BUCKET)) for k in range(1, capacity + 1)]), F.col("length").cast("int"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), buckets).cast("int"))
    counts = scratch.keep(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    base = base.hint("broadcast" if sum(-(-n // BUCKET) for n in lengths.values()) <= BROADCAST else "merge")
    ranked = pieces.join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    schema = ranked.drop("rank").withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(schema)
        for b in batches:
            sequence, offset = laid.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], schema=into)

    return ranked.mapInArrow(run, schema)
