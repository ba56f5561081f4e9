"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A chunk ends, on average, after 2^CHUNK_BITS bytes, and after MOST_BYTES at the latest.
CHUNK_BITS, MOST_BYTES = 9, 8192
#: Bytes that a worker's store of chunks, and of joins, may hold; it is emptied beyond.
STORE_BYTES = 48 << 20
#: Bytes of a text that the rolling hash reads at once, so that memory is bounded.
AT_ONCE = 1 << 22
GEAR = np.random.default_rng(20260).integers(0, 1 << 32, 256, dtype=np.uint32)
#: A space between two visible ASCII characters: whatever stands around them, a pre-token
#: begins at that space, so the ids before and after it don't depend on each other.
SURE = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def cuts(data: bytes, bits: int = CHUNK_BITS, most: int = MOST_BYTES) -> list[int]:
    """Ends of the content-defined chunks: where the rolling hash of the last 32 bytes has
    `bits` leading zeros, moved on to the next character's start."""
    b, ends = np.frombuffer(data, np.uint8), []
    for at in range(0, len(b), AT_ONCE):
        h = GEAR[b[max(0, at - 31) : at + AT_ONCE]]
        for step in (1, 2, 4, 8, 16):
            moved = h[:-step] << np.uint32(step)
            h = h.copy()
            h[step:] += moved
        found = np.nonzero(h >> np.uint32(32 - bits) == 0)[0] + max(0, at - 31) + 1
        ends += found[found > at].tolist() if at else found.tolist()
    out, last = [], 0
    for end in [*ends, len(b)]:
        while end - last > most:
            last = started(data, last + most)
            out.append(last)
        end = started(data, end)
        if end > last:
            out.append(end)
            last = end
    return out


def started(data: bytes, at: int) -> int:
    """The start of the next character from `at` on."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


class Codec:
    """Encodes as the tokenizers library does with the file at json_path; texts of Latin-1
    characters through the same vocabulary's ranks in tiktoken, if their path is given."""

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(json_path)
        t.no_truncation()
        t.no_padding()
        self.tokenizer, self.ranks = t, None
        self.special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        known = {c: bytes([b]) for b, c in byte_chars().items()}
        size = t.get_vocab_size(with_added_tokens=True)
        tokens = [t.id_to_token(i) or "" for i in range(size)]
        self.bytes_of = [b"".join(known[c] for c in x) if all(c in known for c in x) else x.encode() for x in tokens]
        if ranks_path:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.ranks = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.chunks: dict[bytes, tuple] = {}
        self.joins: dict[bytes, list[int]] = {}
        self.held = 0

    def plain(self, data: bytes) -> list[int]:
        """Ids of a text without special tokens."""
        text = data.decode("utf-8", "replace")
        if self.ranks and len(data) <= 2 * MOST_BYTES:
            try:
                text.encode("latin-1")
                return self.ranks.encode_ordinary(text)
            except UnicodeEncodeError:
                pass
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def hold(self, size: int) -> None:
        self.held += size
        if self.held > STORE_BYTES:
            self.chunks.clear()
            self.joins.clear()
            self.held = size

    def chunk(self, data: bytes) -> tuple[bytes, bytes, int, bytes]:
        """(head, ids, number of ids, tail): the bytes up to the chunk's first sure boundary,
        the ids from there to its last one, and the bytes after that."""
        found = self.chunks.get(data)
        if found is None:
            first = SURE.search(data)
            if first is None:
                found = (data, b"", 0, b"")
            else:
                a, z = first.start(), len(data)
                while True:  # the last sure boundary
                    z = data.rindex(b" ", a, z)
                    if z == a or SURE.match(data, z):
                        break
                ids = self.plain(data[a:z])
                found = (data[:a], np.array(ids, "<u4").tobytes(), len(ids), data[z:])
            self.hold(3 * len(data) + 300)
            self.chunks[data] = found
        return found

    def join(self, data: bytes) -> list[int]:
        """Ids of the bytes between two sure boundaries on either side of a cut."""
        found = self.joins.get(data)
        if found is None:
            found = self.plain(data)
            if len(data) < 256:
                self.hold(len(data) + 8 * len(found) + 200)
                self.joins[data] = found
        return found

    def segment(self, data: bytes) -> list[bytes]:
        """Ids of a text without special tokens, as byte strings in order. The bytes between
        the last sure boundary before a cut and the first one after it are encoded anew; a
        chunk without such a boundary joins its neighbours until one is met, so the ids agree
        with those of the whole text."""
        out, waiting, at = [], b"", 0
        for end in cuts(data):
            head, ids, n, tail = self.chunk(data[at:end])
            # A boundary may lie on the cut itself, where neither chunk can see it; the join does.
            waiting += head
            if n or tail:
                out.append(np.array(self.join(waiting), "<u4").tobytes())
                out.append(ids)
                waiting = tail
            at = end
        out.append(np.array(self.join(waiting), "<u4").tobytes())
        return out

    def encode(self, text: str) -> np.ndarray:
        parts = self.marks.split(text) if self.marks and "<|" in text else [text]
        out: list[bytes] = []
        for part in parts:
            out += [np.array([self.special[part]], "<u4").tobytes()] if part in self.special else self.segment(part.encode())
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in ids.tolist()]).decode("utf-8", "replace")


def byte_chars() -> dict[int, str]:
    """Byte -> its character in a byte-level vocabulary: itself if visible, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_codecs: dict[tuple, Codec] = {}


def codec(*paths) -> Codec:
    if paths not in _codecs:
        _codecs[paths] = Codec(*paths)
    return _codecs[paths]


def encode_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each row of docs: (doc_id, n_tokens, ids_sha256, decoded_sha256), and with
    with_ids also (ids array<int>, decoded string).

    Null text counts as empty: no ids. Special tokens' strings in a text become their ids, as
    the library has it. Repeated rows and null ids are returned as they are; an empty table
    gives an empty result; other columns are ignored. A chunk that documents share is encoded
    once in each Python worker while its bounded store holds it; nothing is shuffled, and a
    task needs memory for its longest text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""

    def each(parts):
        own = codec(json_path, ranks_path, pattern)
        for part in parts:
            out = []
            for doc_id, text in zip(part.doc_id, part.text):
                ids = own.encode(text if isinstance(text, str) else "")
                decoded = own.decode(ids)
                row = (doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                out.append((*row, ids.tolist(), decoded) if with_ids else row)
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids])

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    done = rows.mapInPandas(each, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))
