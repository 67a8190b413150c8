"""MinHash near-duplicates: b-bit signatures, a multi-index Hamming join, and links confirmed on whole shingle sets."""

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strandloom.llm.graph import components, contract
from strandloom.llm.rows import WORD, map_rows, released
from strandloom.llm.scratch import Scratch

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Documents of a candidate group, and shingles of theirs, that one task compares with as many others, about.
CHUNK, CHUNK_SHINGLES = 128, 1 << 20
#: Signatures whose keys are made at once.
BATCH = 4096
#: Signatures of a key that one task compares with as many others, about.
BUCKET = 1024
#: Bits a document, most bits, and hashes of the filter that keeps texts without partners from moving.
FILTER_BITS, FILTER_MOST, FILTER_HASHES = 16, 1 << 29, 3
#: Words whose hashes a task keeps; it starts anew beyond that.
WORDS = 50_000
#: Links that a task reads, where there are few.
BATCH_LINKS = 1 << 16
#: Parts of a large group where its nodes meet what is known of it.
SALTS = 32


@dataclass(frozen=True)
class Near:
    """Documents link if 100 * shared >= percent * all of their sets of shingles of so many words.

    A signature has chunks * chunk symbols of 16 bits, the low bits of as many minima. Two signatures that differ in
    fewer than chunks * (errors + 1) symbols agree in some chunk but for errors symbols at most (pigeonhole), so they
    share a key for that chunk: one key is made for each choice of the symbols allowed to differ. With the values here
    that is every pair under 20 of 50 symbols apart. Of pairs that share a key, those under apart symbols apart are
    candidates: more than are guaranteed, as sets that share 85 % of their shingles are under 20 apart with a chance over
    0.9999, but under 26 apart with all but 1 in 10^9, and share a key by chance in some chunk with all but 2 in 10^8.
    """

    words: int = 5
    percent: int = 80
    chunks: int = 10
    chunk: int = 5
    errors: int = 1
    apart: int = 26


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


class _Hashes(dict):
    """64-bit hashes of words, kept for the words that a task meets again."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, words: int, hashes: dict | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; of the whole sequence if it has fewer words; empty without words."""
    # bytes.split() parts at the six ASCII white spaces, which are the contract's
    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map((_Hashes() if hashes is None else hashes).__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), np.uint64)
    for k in range(min(words, len(h))):
        out = _mix(out + h[k : k + n])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


@lru_cache(maxsize=4)
def _parameters(near: Near) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Odd multipliers of the minima; and for each key its number and the symbols it is made of."""
    from itertools import combinations

    n = near.chunks * near.chunk
    factors = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    keys = []
    for c in range(near.chunks):
        for out in combinations(range(near.chunk), near.errors):
            keys.append((len(keys), np.array([c * near.chunk + i for i in range(near.chunk) if i not in out])))
    return factors, keys


def signature(found: np.ndarray, near: Near) -> np.ndarray:
    """The low 16 bits of the least product of a set's hashes with each odd multiplier."""
    factors, _ = _parameters(near)
    low = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(found), 4096):
        low = np.minimum(low, (found[at : at + 4096, None] * factors).min(axis=0))
    return (_mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def keys_of(symbols: np.ndarray, near: Near) -> np.ndarray:
    """A row's keys: hashes of each key's number and symbols. symbols may be many rows."""
    _, keys = _parameters(near)
    wide = symbols.astype(np.uint64)
    out = []
    for number, at in keys:
        h = np.full(wide.shape[:-1], np.uint64(number))
        for i in at:
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + wide[..., i])
        out.append(h)
    return np.stack(out, axis=-1).view(np.int64)


def _sign(near: Near) -> Callable[[], Callable[..., Iterator[tuple]]]:
    def start() -> Callable[..., Iterator[tuple]]:
        import xxhash

        own = _Hashes()

        def f(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            found = shingles(text, near.words, own)
            if len(found):
                yield doc_id, len(found), xxhash.xxh3_128_digest(found.tobytes()), signature(found, near).tobytes()
            else:
                yield doc_id, 0, None, None

        return f

    return start


def _linked(a: np.ndarray, docs: np.ndarray, sizes: np.ndarray, percent: int, inverted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of the documents of an inverted list the set a is linked with."""
    values, owners = inverted
    low, high = np.searchsorted(values, a, side="left"), np.searchsorted(values, a, side="right")
    n = high - low
    total = int(n.sum())
    if not total:
        return docs[:0]
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)
    shared = np.bincount(owners[at], minlength=len(docs))
    return docs[100 * shared >= percent * (len(a) + sizes - shared)]


def _block_links(sets: list[np.ndarray], left: list[bool], right: list[bool], groups: list, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join up the documents of a block, by number, as all links between its left and right sides would.

    Documents of equal groups that aren't None are joined already. Shared shingles are counted for one document and all of
    the right side at once, from an inverted list; of the links found only those that join two groups come out, fewer than
    there are documents.
    """
    side = [k for k in range(len(sets)) if right[k]]
    if not side:
        return
    sizes = np.array([len(sets[k]) for k in side])
    values = np.concatenate([sets[k] for k in side])
    owners = np.repeat(np.arange(len(side), dtype=np.int32), sizes)
    order = np.argsort(values, kind="stable")
    inverted = values[order], owners[order]
    docs = np.arange(len(side))
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict = {}
    for k, g in enumerate(groups):
        if g is not None:
            parent[k] = root(first.setdefault(g, k))
    for k in range(len(sets)):
        if left[k]:
            for j in _linked(sets[k], docs, sizes, percent, inverted).tolist():
                a, b = root(k), root(side[j])
                if a != b:
                    parent[a] = b
                    yield k, side[j]


def groups(docs: DataFrame, near: Near = Near(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the least id reachable over links, kept tells if it is the row's own. Texts that are null or have no
    words have no shingles and link with nothing. Rows that repeat an id are one document: what links with one of them
    links with all. A null id links with nothing; its component_id is null and it is kept. Other columns aren't read.

    1. Each text gives the size, a 128-bit digest and the signature of its set. Equal sets become one node (the least id),
       summed before they move, so copies cost nothing more.
    2. Nodes that share a key meet as signatures, and those that are near are linked: a Hamming join. Candidate groups are the
       components of these links, so all pairs within the signature distance lie in one group.
    3. Groups are compared on full sets, a bounded number of nodes at a time; see _confirmed().
    4. Comparisons return fewer links than nodes; their components are the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    kind = docs.schema[id_column].dataType.simpleString()
    signed = scratch.keep(map_rows(docs, [id_column, text_column], f"doc_id {kind}, n_shingles bigint, digest binary, signature binary", _sign(near)), "signed")
    sets = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    nodes = sets.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies"))
    nodes = scratch.keep(nodes, "nodes")
    candidates = scratch.keep(_candidate_groups(nodes, near, scratch).join(nodes.select("node", "n_shingles"), "node"), "candidates")
    links = _confirmed(docs, candidates, near, scratch, id_column, text_column, kind)
    # rows that repeat an id with different sets belong together
    copied = _salted(nodes.where("copies > 1").select(F.col("digest").alias("of"), F.col("node").alias("least")))
    member = sets.join(copied, (F.col("digest") == F.col("of")) & (_salt("doc_id") == F.col("of_salt")), "left").select("doc_id", F.coalesce("least", "doc_id").alias("node"))
    member = scratch.keep(member.distinct(), "member")
    several = member.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b")
    several = member.join(several.select(F.col("doc_id").alias("own"), "b"), F.col("doc_id") == F.col("own")).select(F.col("node").alias("a"), "b")
    found = components(links.unionByName(several), scratch, "links-cc")
    scratch.only("signed", "member", "links-cc")
    # a node is the least id of its set, so the least node of a component is the least id in it
    of_doc = member.join(found, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    of_doc = of_doc.select(F.col("doc_id").alias("own"), "component_id")
    return signed.join(of_doc, (F.col("doc_id") == F.col("own")) & F.col("digest").isNotNull(), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _candidate_groups(nodes: DataFrame, near: Near, scratch: Scratch) -> DataFrame:
    """(node, component): the candidate group of each node whose signature is near another's.

    Keys move with a hash of their set, and those that several sets share are counted. Of each key its sets are held against
    the least one, each two sets once however many keys they share: near copies are joined by that, with few links a set.
    Keys of three sets or more that aren't in one group then are compared whole, see _signatures_joined(): in one block for up
    to BUCKET sets, or one for each two parts of a larger bucket.
    """
    shape = _parse_datatype_string("key bigint, of bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                found = keys_of(_symbols(b.column(1)), near)
                of = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(of, found.shape[1]))], schema=to_arrow_schema(shape))

    nodes = nodes.select(F.xxhash64("digest").alias("set"), "node", "signature")
    keys = nodes.select("set", "signature").mapInArrow(released(run), shape)
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("of").alias("lead")).where("n > 1")
    shared = scratch.keep(counts.select(F.col("key").alias("shared"), "n", "lead", F.ceil(F.col("n") / BUCKET).cast("int").alias("chunks")), "shared")
    large = _salted(shared.where("chunks > 1"))
    # merge: the same plan at every size
    rows = keys.join(shared.where("chunks = 1").hint("merge"), F.col("key") == F.col("shared")).select("key", "of", "n", "lead", "chunks")
    rows = scratch.keep(rows.unionByName(keys.join(large.hint("merge"), (F.col("key") == F.col("shared")) & (_salt("of") == F.col("of_salt"))).select("key", "of", "n", "lead", "chunks")), "shared-keys")
    links = scratch.keep(_led(rows.where("of <> lead").select("of", "lead").distinct(), nodes, near), "led")
    led = components(links, scratch, "led-cc").select(F.col("node").alias("in"), F.col("component").alias("group"))
    known = scratch.keep(nodes.join(led, F.col("node") == F.col("in"), "left").select("set", "node", "signature", F.coalesce("group", "node").alias("joined")), "known")
    rows = _with_groups(rows.where("n > 2"), known)
    several = rows.groupBy("key").agg(F.min("joined").alias("least"), F.max("joined").alias("most"), F.first("chunks").alias("parts")).where("least <> most")
    several = scratch.keep(several.select(F.col("key").alias("open"), "parts"), "open-keys")
    rest = rows.join(several.where("parts = 1").hint("merge"), F.col("key") == F.col("open")).select("key", "of", "chunks")
    rest = rest.unionByName(rows.join(_salted(several.where("parts > 1")).hint("merge"), (F.col("key") == F.col("open")) & (_salt("of") == F.col("of_salt"))).select("key", "of", "chunks"))
    blocks = _crossed(rest.withColumn("chunk", F.pmod(F.xxhash64("of"), F.col("chunks")).cast("int")))
    blocks = blocks.join(known.hint("merge"), F.col("of") == F.col("set")).select("key", "x", "y", (F.col("chunk") == F.col("x")).alias("left"), "joined", "signature")
    groups_of = led.where("in <> group").select(F.col("in").alias("a"), F.col("group").alias("b"))
    # written first: contracting it in the same tasks would take a second Python worker each
    met = scratch.keep(_signatures_joined(blocks, near), "met")
    return components(met.unionByName(groups_of), scratch, "candidate-cc")


def _with_groups(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (key, of, chunks) with joined, the known group of the set of. A set meets its group once, with all its keys, 50 at most."""
    held = rows.groupBy("of").agg(F.collect_list(F.struct("key", "chunks")).alias("keys"))
    held = held.join(known.select("set", "joined").hint("merge"), F.col("of") == F.col("set"))
    return held.select("of", "joined", F.inline("keys")).select("key", "of", "chunks", "joined")


def _led(pairs: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) of nodes, of pairs of sets (of, lead) that are under near.apart symbols apart."""
    kind = nodes.schema["node"].dataType.simpleString()
    shape = _parse_datatype_string(f"a {kind}, b {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, other = (_symbols(b.column(c)) for c in (1, 3))
            some = pa.array((own != other).sum(axis=1) < near.apart)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(some).cast(f.type) for c, f in zip((0, 2), to_arrow_schema(shape), strict=True)], schema=to_arrow_schema(shape))

    lead = nodes.select(F.col("set").alias("lead_set"), F.col("node").alias("b"), F.col("signature").alias("b_signature"))
    rows = pairs.join(lead.hint("merge"), F.col("lead") == F.col("lead_set")).select("of", "b", "b_signature")
    rows = rows.join(nodes.hint("merge"), F.col("of") == F.col("set")).select(F.col("node").alias("a"), "signature", "b", "b_signature")
    return rows.mapInArrow(released(run), shape)


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _signatures_joined(blocks: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) that join up the groups of each block as all its pairs under near.apart symbols apart would.

    Rows are key, x, y, left, joined (the group that a node is known to be in) and signature. Where x is y all pairs of the
    block count, else those of its two sides. A block's nodes are compared with its first one; with those that aren't near it,
    one of those that are joined after another. What is joined isn't compared again, so near copies cost time in proportion
    to their number; links are of groups, fewer than a block has.
    """
    kind = blocks.schema["joined"].dataType.simpleString()
    shape = _parse_datatype_string(f"a {kind}, b {kind}")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """The rows of some blocks, none in part, and where each block begins."""
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
            at = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("key", "x", "y")])
            first = np.flatnonzero(np.concatenate(([True], (at[:, 1:] != at[:, :-1]).any(axis=0)))) if t.num_rows else np.zeros(1, np.int64)
            if first[-1]:
                yield t.slice(0, int(first[-1])), first[:-1]
            rest = t.slice(int(first[-1]))
        if rest is not None and rest.num_rows:
            yield rest, np.zeros(1, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        for t, first in whole(batches):
            symbols = _symbols(t.column("signature"))
            left = t.column("left").to_numpy()
            crossed = t.column("x").to_numpy() != t.column("y").to_numpy()
            joined = t.column("joined").to_numpy(zero_copy_only=False)
            a, b = _near_pairs(symbols, first, left, crossed, near.apart, joined)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(contract(joined[a], joined[b]), into, strict=True)], schema=into)

    return blocks.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(released(run), shape)


def _near_pairs(symbols: np.ndarray, first: np.ndarray, left: np.ndarray, crossed: np.ndarray, apart: int, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of blocks, which begin at first, that join up each block as all its pairs under apart would.

    In blocks that are crossed, only pairs of a left row and another count. Rows of a group (joined) are joined already.
    """

    def is_near(row: np.ndarray | int, others: np.ndarray) -> np.ndarray:
        out = (symbols[others] != symbols[row]).sum(axis=1) < apart
        out &= ~(crossed[others] & (left[others] == left[row]))
        return out if joined is None else out | (joined[others] == joined[row])

    rows = np.arange(len(symbols))
    leader = np.repeat(first, np.diff(np.append(first, len(rows))))
    mine = is_near(leader, rows) & (rows != leader)
    pairs = [(rows[mine], leader[mine])]
    open_ = ~mine & (rows != leader)
    several = np.append(first, len(rows))
    for k in np.unique(np.searchsorted(first, rows[open_], side="right")) - 1:
        start, stop = several[k], several[k + 1]
        if stop - start == 2:
            continue
        todo = start + np.flatnonzero(mine[start:stop])
        front, rest = todo.tolist(), start + np.flatnonzero(open_[start:stop])
        while len(rest):
            if not front:
                front, rest = [int(rest[0])], rest[1:]
                continue
            row = front.pop()
            near_it = is_near(row, rest)
            if near_it.any():
                pairs.append((rest[near_it], np.full(int(near_it.sum()), row)))
                front.extend(rest[near_it].tolist())
                rest = rest[~near_it]
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def _likely_sets(texts: DataFrame, candidates: DataFrame, near: Near, kind: str) -> DataFrame:
    """(doc_id, hashes): sets of the texts whose ids are candidates, and of a few others, by a Bloom filter.

    It has about FILTER_BITS bits a candidate, made up to a power of two between 2^20 and FILTER_MOST: 64 MB. Its words are
    or-ed together by Spark; the driver gets one a word. With more candidates it lets more texts pass, which the join after
    it sorts out.
    """
    size = min(FILTER_MOST, max(1 << 20, 1 << (FILTER_BITS * candidates.count()).bit_length()))
    spot = lambda c, k: F.pmod(F.xxhash64(F.col(c), F.lit(k)), F.lit(size))
    spots = candidates.select(F.explode(F.array(*[spot("node", k) for k in range(FILTER_HASHES)])).alias("spot"))
    words = spots.groupBy(F.expr("spot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot % 64 AS int))")).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    bits = table.view(np.uint8)
    shared = candidates.sparkSession.sparkContext.broadcast(bits)
    names = [f"s{k}" for k in range(FILTER_HASHES)]

    def start() -> Callable[..., Iterator[tuple]]:
        filled, own = shared.value, _Hashes()

        def f(doc_id: object, text: str, *spots: int) -> Iterator[tuple]:
            if all(filled[at >> 3] >> (at & 7) & 1 for at in spots):
                found = shingles(text, near.words, own)
                if len(found):
                    yield doc_id, found.tobytes()

        return f

    return map_rows(texts.select("doc_id", "text", *[spot("doc_id", k).alias(n) for k, n in enumerate(names)]), ["doc_id", "text", *names], f"doc_id {kind}, hashes binary", start)


def _gathered(links: DataFrame) -> DataFrame:
    """A written table in no more tasks than its rows are worth."""
    return links.coalesce(max(links.sparkSession.sparkContext.defaultParallelism, -(-links.count() // BATCH_LINKS)))


def _chunks(n: str, shingles: str) -> F.Column:
    """Chunks of a group of n nodes with so many shingles in all."""
    return F.greatest(F.ceil(F.col(n) / CHUNK), F.ceil(F.col(shingles) / CHUNK_SHINGLES)).cast("int")


def _salted(few: DataFrame) -> DataFrame:
    """Each row of few with each salt, so that rows of one group meet it in as many tasks."""
    return few.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(column: str = "node") -> F.Column:
    return F.pmod(F.xxhash64(column, F.lit(1)), F.lit(SALTS)).cast("int")


def _dealt(table: DataFrame, by: list[str], name: str) -> DataFrame:
    """table with chunks, how many its group (by) has, and name, the one of them that a node is in by hash.

    Only groups of several chunks, one in 128 at most, meet their nodes.
    """
    sizes = table.groupBy(*by).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    sizes = _salted(sizes.select(*[F.col(c).alias(f"of_{c}") for c in by], _chunks("n", "total").alias("several")).where("several > 1"))
    on = [*[F.col(c) == F.col(f"of_{c}") for c in by], _salt() == F.col("of_salt")]
    out = table.join(sizes, on, "left").withColumn("chunks", F.coalesce("several", F.lit(1)))
    return out.withColumn(name, F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).drop("several", "of_salt", *[f"of_{c}" for c in by])


def _compared(blocks: DataFrame, near: Near, kind: str) -> DataFrame:
    """Links (a, b) of blocks, rows of candidate, x, y, chunk, node, joined and hashes: chunk x is one side, y the other.

    Of each linked group of a block all nodes that a link was found for are linked with the least.
    """
    shape = _parse_datatype_string(f"a {kind}, b {kind}")

    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        chunk, joined = table.column("chunk").to_pylist(), table.column("joined").to_pylist()
        sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in table.column("hashes")]
        found = np.array(list(_block_links(sets, [c == x for c in chunk], [c == y for c in chunk], joined, near.percent)), np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([table.column("node").take(pa.array(at)).cast(t.type) for at, t in zip(contract(*found.T), to_arrow_schema(shape), strict=True)], schema=to_arrow_schema(shape))

    # else Spark may leave all blocks of a candidate group where an earlier step brought it together
    blocks = blocks.select("candidate", "x", "y", "chunk", "node", "joined", "hashes").repartition("candidate", "x", "y")
    return blocks.groupBy("candidate", "x", "y").applyInArrow(run, shape)


def _crossed(dealt: DataFrame) -> DataFrame:
    """dealt, with chunk and chunks, as blocks of each two chunks of a group: a node is in one for each chunk of its group."""
    blocks = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return blocks.withColumn("x", F.least("chunk", "j")).withColumn("y", F.greatest("chunk", "j"))


def _confirmed(docs: DataFrame, candidates: DataFrame, near: Near, scratch: Scratch, id_column: str, text_column: str, kind: str) -> DataFrame:
    """Links (a, b), confirmed on full sets, that join up each candidate group as all of its links would.

    Sets, as sorted 64-bit hashes, move once. Groups are dealt into chunks of about 128 nodes and 2^20 shingles.
    1. All nodes of a chunk are compared with each other. Most groups have one chunk and are done.
    2. In the others, the roots of the chunks' linked groups are compared across chunks. Copies of one text are one linked
       group after that, however many there are.
    3. Nodes of what are several linked groups still are compared across these: chunks are made anew within each large
       linked group and of all small ones together, and two chunks of the same linked group don't meet. Nodes that are
       joined need no comparison, as only components are asked for; all others meet. So a set is copied once a chunk
       outside its own linked group: time is quadratic only in nodes of a group that are not joined.
    """
    null = F.lit(None).cast(kind)
    placed = _dealt(candidates.select("node", F.col("component").alias("candidate"), "n_shingles"), ["candidate"], "chunk")
    texts = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    likely = _likely_sets(texts, candidates, near, kind)
    # merge: the same plan at every size; sets of candidates alone move
    placed = scratch.keep(likely.join(placed.hint("merge"), F.col("node") == F.col("doc_id")).select("node", "candidate", "n_shingles", "chunks", "chunk", "hashes"), "sets")
    links = scratch.keep(_compared(placed.select("*", F.col("chunk").alias("x"), F.col("chunk").alias("y"), null.alias("joined")), near, kind), "links-1")
    large = placed.where("chunks > 1")
    if large.isEmpty():
        return _gathered(links)
    roots = large.join(links.select(F.col("a").alias("of")), F.col("node") == F.col("of"), "left_anti")
    roots = _dealt(roots.drop("chunk", "chunks"), ["candidate"], "chunk")
    links = _gathered(links).unionByName(_gathered(scratch.keep(_compared(_crossed(roots).withColumn("joined", null), near, kind), "links-2")))
    joined = components(links, scratch, "across-cc").select(F.col("node").alias("of"), "component")
    groups_of = scratch.keep(large.drop("chunk", "chunks", "hashes").join(joined, F.col("node") == F.col("of"), "left").select("node", "candidate", "n_shingles", F.coalesce("component", "node").alias("joined")), "groups-of")
    several = groups_of.groupBy("candidate").agg(F.min("joined").alias("least"), F.max("joined").alias("most")).where("least <> most").select(F.col("candidate").alias("open"))
    rest = groups_of.join(_salted(several), (F.col("candidate") == F.col("open")) & (_salt() == F.col("of_salt")), "left_semi")
    # each large linked group has chunks of its own (alone); the small ones of a candidate group share some
    rest = _dealt(rest, ["candidate", "joined"], "part").withColumn("alone", F.when(F.col("chunks") > 1, F.col("joined")))
    few = _dealt(rest.where("alone IS NULL").drop("chunks", "part"), ["candidate"], "part").withColumn("alone", null)
    rest = rest.where("alone IS NOT NULL").select("node", "candidate", "joined", "alone", "part").unionByName(few.select("node", "candidate", "joined", "alone", "part"))
    rest = scratch.keep(rest.select("node", "candidate", "joined", "alone", F.xxhash64("alone", "part").alias("chunk")), "rest")
    chunks = scratch.keep(rest.select("candidate", "alone", "chunk").distinct(), "chunks")
    # each chunk's partners, then its nodes: chunks of one linked group don't meet
    left, right = (chunks.select(F.col("candidate").alias(f"{s}_candidate"), F.col("alone").alias(f"{s}_alone"), F.col("chunk").alias(s)) for s in ("one", "two"))
    meet = left.join(right, (F.col("one_candidate") == F.col("two_candidate")) & (F.col("one_alone").isNull() | F.col("two_alone").isNull() | (F.col("one_alone") != F.col("two_alone"))))
    meet = meet.select(F.col("one_candidate").alias("in"), "one", F.least("one", "two").alias("x"), F.greatest("one", "two").alias("y"))
    rest = rest.join(meet, (F.col("candidate") == F.col("in")) & (F.col("chunk") == F.col("one"))).select(F.col("node").alias("own"), "joined", "chunk", "x", "y")
    rest = large.select("node", "candidate", "hashes").join(rest, F.col("node") == F.col("own"))
    joined = joined.where("of <> component").select(F.col("of").alias("a"), F.col("component").alias("b"))
    return joined.unionByName(_gathered(scratch.keep(_compared(rest, near, kind), "links-3")))


def deduplicate(docs: DataFrame, near: Near = Near(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that groups() keeps, with all their columns; of rows that repeat an id and are kept, one.

    Rows without words, and rows without an id, all stay.
    """
    own, key = F.col(f"`{id_column}`"), f"key-{uuid.uuid4().hex}"
    out = groups(docs, near, id_column, text_column).where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    left = docs.join(out, own == F.col(f"`{key}`"), "left_anti")
    worded = F.col(f"`{text_column}`").rlike(WORD)
    twice = docs.where(own.isNotNull() & worded).groupBy(own.alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(f"`{key}`")
    twice = Scratch(docs.sparkSession, "near").keep(twice, "twice")
    if twice.isEmpty():
        return left
    same = (own == F.col(f"`{key}`")) & worded
    again = left.join(twice, same, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one = again.groupBy(F.col("row")[id_column].alias("id")).agg(F.min_by("row", F.col("row")[text_column]).alias("row")).select("row.*")
    return left.join(twice, same, "left_anti").unionByName(one)
