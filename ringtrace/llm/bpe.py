"""Byte-level BPE: Spark folds the ranked merges over the byte arrays of distinct words.

A task gathers documents into chunks of bounded size.  A chunk gives rows with its distinct
words, as arrays of bytes, and then a row with its documents as indexes into them.  ``fold`` is a
higher-order ``aggregate`` over a word's bytes: each step merges the leftmost pair of the lowest
rank, looked up in a literal rank map (an array of small maps by hash, as Spark's maps are
searched from end to end).  Decoding puts together the binary pieces of the ids.  Rows keep their
order within a task, so the ids of a chunk's words meet its documents again without any shuffle,
join or broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk's documents (the last one may reach beyond), and words of a row: binding
#: the rank map copies it once a row, some 50 ms, so rows are long.
CHUNK_CHARS, ROW_WORDS = 24_000_000, 131_072
#: Longer words are merged in Python with a heap: a fold takes time by the square of the length.
FOLD_BYTES = 1024
#: The rank of what is no token; ids, places and ranks are packed into one number.
NONE, PLACE, RANK = 1 << 22, 1 << 20, 1 << 40
#: Buckets of the rank map (a power of two), and the shift that spreads its keys.
BUCKETS, SPREAD = 131_072, 9

CHUNKS = "words array<array<smallint>>, doc_ids array<bigint>, counts array<int>, places binary, long_words array<binary>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value evaluated once: the end of a fold of nothing.

    An element taken from a ``transform`` would do, but there the type of all of ``use`` is worked out anew each time.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, use)


class Codec:
    """Literal tables of one vocabulary, and the columns that use them."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        if size > 1 << 16:
            raise ValueError("more tokens than two bytes can number")
        # every two tokens that make a third, whichever way it is cut
        pairs = {(ranks[t[:k]] << 16) + ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        table: list[dict[int, int]] = [{} for _ in range(BUCKETS)]
        for pair, rank in pairs.items():
            table[bucket(pair >> 16, pair & 0xFFFF)][pair] = rank * RANK
        pieces, own = [""] * size, [0] * 256
        self.lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            pieces[rank], self.lengths[rank] = token.hex().upper(), len(token)
            if len(token) == 1:
                own[token[0]] = rank
        # constant expressions: Spark folds each into one literal
        self.pairs = F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<map<string,bigint>>").cast("array<map<bigint,bigint>>")
        self.bytes = F.split(F.lit(",".join(map(str, own))), ",").cast("array<bigint>")
        self.pieces = F.split(F.lit(",".join(pieces)), ",")

    def encoded(self, words: Column) -> Column:
        """The ids of each word (an array of bytes) of an array; the tables are bound once a row."""
        return let(self.pairs, lambda pairs: let(self.bytes, lambda own: F.transform(words, lambda word: fold(word, pairs, own))))

    def decoded(self, ids: Column) -> Column:
        """The binary that the id lists of an array stand for, all of them in one; an id's ``lengths`` tell where a list's bytes end."""
        return let(self.pieces, lambda p: F.unhex(F.array_join(F.transform(F.flatten(ids), lambda i: F.get(p, i)), "")))


def bucket(a, b):
    """Where the rank map has two ids: whole numbers or columns."""
    if isinstance(a, Column):
        return F.shiftleft(a, SPREAD).bitwiseXOR(F.shiftright(a, 8)).bitwiseXOR(b).bitwiseAND(F.lit(BUCKETS - 1).cast("bigint")).cast("int")
    return ((a << SPREAD) ^ (a >> 8) ^ b) & (BUCKETS - 1)


def fold(word: Column, pairs: Column, own: Column) -> Column:
    """The ids of a word: ``aggregate`` merges its bytes by the ranks in ``pairs``.

    An element of the fold's state is a token: its id, its place in the word, and the rank of it and
    its right neighbour, packed in this order of weight so that the least element is the next merge.
    """

    def rank(a: Column, b: Column) -> Column:
        key = F.shiftleft(a, 16).bitwiseOR(b)
        return F.coalesce(F.try_element_at(F.get(pairs, bucket(a, b)), key), F.lit(NONE * RANK))

    def id_of(x: Column) -> Column:
        return x.bitwiseAND(F.lit(PLACE - 1).cast("bigint"))

    def step(state: Column, _: Column) -> Column:
        def merged(least: Column) -> Column:
            new = F.shiftright(least, 40)

            def at_place(at: Column) -> Column:
                before, after = F.get(state, at - 2), F.get(state, at + 1)
                here = rank(new, id_of(after)).bitwiseOR(least.bitwiseAND(F.lit(RANK - PLACE))).bitwiseOR(new)
                both = F.struct(here.alias("here"), before.alias("old"), rank(id_of(before), new).bitwiseOR(before.bitwiseAND(F.lit(RANK - 1))).alias("before"))
                return let(both, lambda n: F.transform(F.array_remove(state, F.get(state, at)), lambda x: F.when(x == least, n["here"]).when(x == n["old"], n["before"]).otherwise(x)))

            return let(F.array_position(state, least).cast("int"), at_place)

        return let(F.array_min(state), lambda x: F.when(x >= NONE * RANK, state).otherwise(merged(x)))

    def merges(ids: Column) -> Column:
        start = F.transform(ids, lambda a, i: rank(a, F.get(ids, i + 1)).bitwiseOR(F.shiftleft(i.cast("bigint"), 20)).bitwiseOR(a))
        return F.aggregate(F.slice(ids, F.lit(2), F.size(ids)), start, step, lambda state: F.transform(state, lambda x: id_of(x).cast("int")))

    return let(F.transform(word, lambda b: F.get(own, b)), merges)


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in O(n log n) for long words: neighbours in a linked list, pairs in a heap."""
    if word in ranks:
        return [ranks[word]]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    pairs = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(pairs)
    while pairs:
        _, i, size = heapq.heappop(pairs)
        j = after[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(pairs, (r, a, len(parts[a]) + len(parts[b])))
    return [ranks[p] for p in parts if p is not None]


#: Texts of ASCII and Latin-1 letters, and the tokenizer's pattern over them in plain classes.
SIMPLE = re.compile("[\\x00-\\x1b!-~ \\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff]*")
_L = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff"
SIMPLE_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^ \\t-\\r0-9{_L}]+|[ \\t-\\r]+(?![^ \\t-\\r])|[ \\t-\\r]+")


def chunks(docs: DataFrame, pattern: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Rows of words (nothing else set), then a row of the documents that hold them, chunk by chunk.

    ``places`` are int32 indexes into the chunk's words; words too long for a fold have negative ones.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        class Places(dict):
            def __missing__(self, word: str) -> int:
                data = word.encode()
                if len(data) > FOLD_BYTES:
                    long.append(data)
                    self[word] = -len(long)
                else:
                    words.append(data)
                    self[word] = len(words) - 1
                return self[word]

        # white space as Unicode defines it; the regex module's own \s takes four control characters too
        exact = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        ids, counts, held, words, long, places, size = [], [], [], [], [], Places(), 0
        kinds = [pa.list_(pa.list_(pa.int16())), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary())]
        names = ["words", "doc_ids", "counts", "places", "long_words"]

        def closed() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(words), ROW_WORDS):
                some = words[k : k + ROW_WORDS]
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32)
                inner = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(some), np.uint8).astype(np.int16)))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), inner), *[pa.nulls(1, x) for x in kinds[1:]]], names)
            row = [[], ids, counts, b"".join(held), long]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            texts = batch.column(1)
            for at, doc in enumerate(batch.column(0).to_pylist()):
                text = texts[at].as_py() or ""
                found = (SIMPLE_PATTERN if SIMPLE.fullmatch(text) else exact).findall(text)
                held.append(np.fromiter(map(places.__getitem__, found), np.int32, len(found)).tobytes())
                ids.append(doc)
                counts.append(len(found))
                size += len(text)
                if size >= chunk_chars:
                    yield from closed()
                    ids, counts, held, words, long, places, size = [], [], [], [], [], Places(), 0
        if ids:
            yield from closed()

    return docs.select("doc_id", "text").mapInArrow(rows, CHUNKS)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk_chars: int = CHUNK_CHARS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (uint32 bytes; null unless ``with_ids``) of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have no ids.  Null and repeated doc_ids are kept as they are.  Texts of any
    length are read whole; a word of over FOLD_BYTES bytes is merged outside the fold.  An empty table
    gives an empty one.
    """
    codec = Codec(ranks)
    folded = chunks(docs, pattern, chunk_chars).withColumn("word_ids", codec.encoded(F.col("words"))).drop("words")
    decoded = folded.withColumn("word_bytes", codec.decoded(F.col("word_ids")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data = [], []
        for batch in batches:
            for k in range(batch.num_rows):
                of = {n: batch.column(n)[k] for n in batch.schema.names}
                if not of["doc_ids"].is_valid:
                    lists = of["word_ids"].values
                    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
                    for held, values, cuts in ((ids, np.ascontiguousarray(flat, "<u4").tobytes(), ends * 4), (data, of["word_bytes"].as_py(), np.cumsum(lengths[flat])[ends - 1])):
                        at = [0, *cuts.tolist()]
                        if at[-1] != len(values):
                            raise ValueError("the pieces do not add up to the words")
                        held.extend(values[a:b] for a, b in zip(at, at[1:]))
                    continue
                # long words have negative places: the last ones of each list
                for word in of["long_words"].as_py()[::-1]:
                    merged = heap_merge(word, ranks)
                    ids.append(np.array(merged, "<u4").tobytes())
                    data.append(b"".join(pieces[i] for i in merged))
                places, ends = np.frombuffer(of["places"].as_py(), np.int32), np.cumsum(of["counts"].values.to_numpy())
                out: list[list] = [[], [], [], []]
                for a, b in zip([0, *ends.tolist()], ends.tolist()):
                    own = places[a:b].tolist()
                    whole = b"".join(map(ids.__getitem__, own))
                    out[0].append(len(whole) // 4)
                    out[1].append(hashlib.sha256(whole).hexdigest())
                    out[2].append(hashlib.sha256(b"".join(map(data.__getitem__, own))).hexdigest())
                    out[3].append(whole if with_ids else None)
                ids, data = [], []
                yield pa.RecordBatch.from_arrays([of["doc_ids"].values, *[pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.binary()))]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    pieces, lengths = {r: t for t, r in ranks.items()}, codec.lengths
    return decoded.mapInArrow(rows, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids binary")
