"""Byte-level BPE encoding and decoding of whole texts, as the public vocabulary file defines it.

A word's symbols form a doubly linked list; a heap holds (merge rank, place) of its adjacent pairs. The lowest entry is
taken, skipped when either symbol has changed since (a stale entry), and merged in place, so a word of n bytes costs
O(n log n). Words are cut by the byte-level pattern; equal words of a task are encoded once. Texts between single
spaces are independent of each other, so most of the work is one dictionary look-up per word. Ids are kept as
little-endian unsigned 32-bit bytes. Decoding concatenates the byte strings of the ids and reads them as UTF-8.

Null: encoded as an empty text. Strings of added tokens inside a text become those tokens' ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify
from heapq import heappop as pop
from heapq import heappush as push
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_ENTRIES = 400_000
SHIFT, NONE = 20, -2  # ids have at most 20 bits
# fixed value: the byte-level word pattern, and its form for ASCII text
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that a vocabulary file writes for each byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_vocabulary(path: str) -> dict:
    """Ranks of merges, byte strings of ids and added tokens; read once on the driver, a fixed small table."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    letters = byte_letters()
    vocab = whole["model"]["vocab"]
    strings = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
    merges, made = {}, []
    for rank, pair in enumerate(whole["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[(vocab[a] << SHIFT) | vocab[b]] = rank
        made.append(vocab[a + b])
    added = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
    strings |= {i: t.encode() for t, i in added.items()}
    return {
        "merges": merges, "made": made, "strings": strings, "added": added,
        "bytes": [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])],
    }


def merge_word(word: bytes, byte_ids: list[int], merges: dict[int, int], made: list[int]) -> list[int]:
    """Merge one word's bytes by rank, leftmost first among equal ranks.

    ``merges`` maps a pair of ids (one number) to its rank, ``made`` a rank to the new id. A queue entry is one number
    of rank and place; it is stale when the pair that now stands at its place has another rank or is gone.
    """
    symbol = [byte_ids[b] for b in word]
    n = len(symbol)
    if n < 2:
        return symbol
    rank_of = merges.get
    # the rank of the pair that starts at each place: NONE if it does not merge
    pair = [rank_of((a << SHIFT) | b, NONE) for a, b in zip(symbol, symbol[1:])]
    pair.append(NONE)
    bits = n.bit_length()
    mask = (1 << bits) - 1
    queue = [(r << bits) | i for i, r in enumerate(pair) if r != NONE]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heapify(queue)
    while queue:
        entry = pop(queue)
        i = entry & mask
        rank = entry >> bits
        if pair[i] != rank:
            continue
        j = right[i]
        new = symbol[i] = made[rank]
        symbol[j] = pair[j] = -1
        after = right[i] = right[j]
        if after < n:
            left[after] = i
            r = pair[i] = rank_of((new << SHIFT) | symbol[after], NONE)
            if r != NONE:
                push(queue, (r << bits) | i)
        else:
            pair[i] = NONE
        before = left[i]
        if before >= 0:
            r = pair[before] = rank_of((symbol[before] << SHIFT) | new, NONE)
            if r != NONE:
                push(queue, (r << bits) | before)
    return [s for s in symbol if s >= 0]


class Encoder:
    """Encodes texts in one task; ``fast`` may name another exact encoder of single words."""

    def __init__(self, vocabulary: dict, fast=None):
        import re

        import regex

        self.v, self.pattern = vocabulary, regex.compile(PATTERN)
        self.added = re.compile("|".join(map(re.escape, sorted(vocabulary["added"], key=len, reverse=True)))) if vocabulary["added"] else None
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.fast = fast

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            ids = self.fast(word) if self.fast else merge_word(word.encode(), self.v["bytes"], self.v["merges"], self.v["made"])
            found = pack(f"<{len(ids)}I", *ids)
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            if len(word) < 64:
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        found = b"".join(map(self.word, self.pattern.findall(chunk)))
        if len(self.chunks) >= CACHE_ENTRIES:
            self.chunks.clear()
        if len(chunk) < 64:
            self.chunks[chunk] = found
        return found

    def plain(self, text: str) -> bytes:
        parts = text.split(" ")
        if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
            return self.loose(text)
        known, out = self.chunks.get, []
        head = parts[0]
        out.append(known(head) or self.chunk(head))
        for p in map(" ".__add__, parts[1:]):
            out.append(known(p) or self.chunk(p))
        return b"".join(out)

    def loose(self, text: str) -> bytes:
        """A text with runs of white space: cut only at single spaces between other characters."""
        import regex

        out = []
        for part in regex.splititer(r"(?<=\S)(?= \S)", text):
            out.append(self.chunks.get(part) or self.chunk(part))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        out, at = [], 0
        for hit in self.added.finditer(text):
            if hit.start() > at:
                out.append(self.plain(text[at : hit.start()]))
            out.append(self.v["added"][hit[0]].to_bytes(4, "little"))
            at = hit.end()
        if at < len(text):
            out.append(self.plain(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The texts' bytes; sequences that are not UTF-8 are read as replacement characters."""
        whole = b"".join(map(self.v["strings"].__getitem__, memoryview(ids).cast("I")))
        try:
            whole.decode()
            return whole
        except UnicodeDecodeError:
            return whole.decode("utf-8", "replace").encode()


def _shared(spark, path: str):
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode_texts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids array<bigint>): every whole text as token ids. Other columns are not read; repeated keys stay."""
    shared = _shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for batch in batches:
            ids = [list(memoryview(coder.encode(t)).cast("I")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=[key, "ids"])

    narrow = df.select(F.col(key), F.col(text).alias("_text"))
    return narrow.mapInArrow(run, f"{_field(df, key)}, ids array<bigint>")


def decode_ids(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """(key, text): the text of each id list; a null list gives an empty text."""
    shared = _shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for batch in batches:
            texts = [coder.decode(b"".join(i.to_bytes(4, "little") for i in x or [])).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids).cast("array<bigint>").alias("_ids")).mapInArrow(run, f"{_field(df, key)}, text string")


def round_trip(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every text encoded and decoded, without moving the ids."""
    shared = _shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for batch in batches:
            n, one, two = [], [], []
            for t in batch.column(1):
                ids = coder.encode(t.as_py())
                n.append(len(ids) // 4)
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = df.select(F.col(key), F.col(text).alias("_text"))
    return narrow.mapInArrow(run, f"{_field(df, key)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _field(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.select(name).schema[0].dataType.simpleString()}"


def written_strings(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """The vocabulary as byte strings to ids, for encoders that take ranks, and the added tokens."""
    v = read_vocabulary(path)
    added = set(v["added"].values())
    return {s: i for i, s in v["strings"].items() if i not in added}, v["added"]
