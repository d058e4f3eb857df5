"""Byte-level BPE encoding and decoding with a given rank file.

A piece of text is encoded in time linear in its length: an Aho-Corasick automaton over all tokens (bytes written
as Latin-1 characters) gives the longest token at each position, and a left-to-right search takes it, falls back to
its next shorter prefix, or steps back a token, keeping only neighbours that exact merging would leave side by side.
Whether two tokens may stand side by side is worked out once for a pair and remembered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.base import map_texts

#: Entries that a worker remembers of each kind; beyond, it starts anew, so memory is bounded for any corpus.
MEMO_PIECES, MEMO_PAIRS = 200_000, 300_000

#: A vocabulary beyond this many bytes is refused: it is sent to every worker.
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> dict[str, int]:
    """Token (bytes as Latin-1 characters) -> rank, from lines of base64 token and rank."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def merge_naively(piece: str, ranks: dict[str, int], below: float = float("inf")) -> list[str]:
    """The definition: merge the leftmost pair of lowest rank until none is left."""
    parts = list(piece)
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def split_tokens(ranks: dict[str, int]) -> tuple[dict[str, tuple[str, str]], set[str]]:
    """The last merge of each token of two bytes or more, and the tokens that merging never reaches."""
    splits, unreached = {}, set()
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = merge_naively(token, ranks, rank)
            if len(parts) == 2:
                splits[token] = (parts[0], parts[1])
            else:
                unreached.add(token)
    return splits, unreached


class Encoder:
    """Encodes pieces of Latin-1 written bytes."""

    def __init__(self, ranks: dict[str, int], splits: dict[str, tuple[str, str]], unreached: set[str]):
        self.ranks, self.splits, self.unreached = ranks, splits, unreached
        self.size = max(ranks.values(), default=0) + 1
        self.token: list[str] = [""] * self.size
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.token[rank] = token
            if token not in unreached:
                self.automaton.add_word(token, (len(token) - 1, rank))
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.token]
        self.shorter: dict[int, int] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}

    def edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The parts of a token that touch its right (side 1) or left (side 0) end, each with the rank that uses it up."""
        if (known := self.edges[side].get(token)) is None:
            known, part, used = [], token, float("inf")
            while True:
                known.append((part, used))
                if part not in self.splits:
                    break
                used, part = self.ranks[part], self.splits[part][side]
            self.edges[side][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two tokens: no merge across it comes before both its parts are used."""
        if (known := self.pairs.get(left * self.size + right)) is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known, get = True, self.ranks.get
            for a, a_used in self.edge(self.token[left], 1):
                for b, b_used in self.edge(self.token[right], 0):
                    across = get(a + b)
                    # Of equal ranks the leftmost merges first: left of the border before it, right of it after.
                    if across is not None and across < a_used and across <= b_used:
                        known = False
            self.pairs[left * self.size + right] = known
        return known

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix, -1 if there is none."""
        if (known := self.shorter.get(token)) is None:
            text = self.token[token]
            prefixes = (text[:k] for k in range(len(text) - 1, 0, -1))
            known = self.shorter[token] = next((self.ranks[t] for t in prefixes if t in self.ranks and t not in self.unreached), -1)
        return known

    def encode(self, piece: str) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, length, pairs, size = len(piece), self.length, self.pairs, self.size
        longest = [-1] * n
        for end, (back, token) in self.automaton.iter(piece):
            longest[end - back] = token  # ends come in rising order: the last is the longest
        last = longest[0]
        out, at = [last], length[last]
        while at < n:  # most pieces take the longest token everywhere
            token = longest[at]
            if not (pairs.get(last * size + token) or self.compatible(last, token)):
                return self.search(n, longest)
            out.append(token)
            at += length[token]
            last = token
        return out

    def search(self, n: int, longest: list[int]) -> list[int]:
        """Left to right, taking shorter tokens and steps back where neighbours are not compatible."""
        out: list[int] = []
        dead: set[int] = set()  # borders that no encoding can have
        at, token = 0, longest[0]
        while at < n:
            end = at + self.length[token]
            if end not in dead and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif (shorter := self.next_shorter(token)) >= 0:
                token = shorter
            else:
                dead.add(at)
                token = out.pop()
                at -= self.length[token]
        return out


class Pieces(dict):
    """Piece of text -> its ids as little-endian 32-bit integers, worked out when first asked for.

    Once full, the pieces become the older generation, from which those still in use are taken over.
    """

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(self.encoder.encode(piece.encode("utf-8", "replace").decode("latin-1")), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def _decoder(ranks: dict[str, int]) -> Callable[[bytes | None], bytes]:
    token = {i: t.encode("latin-1") for t, i in ranks.items()}.__getitem__
    return lambda ids: b"".join(map(token, np.frombuffer(ids or b"", "<u4").tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", as_array: bool = False, with_decoded: bool = False) -> DataFrame:
    """Encode each text: the id column and ids; with_decoded also decodes these ids, in the same pass, to decoded (binary).

    ids is binary, little-endian unsigned 32-bit integers, or array<int> with as_array. Null and empty texts give no
    ids. Every row, repeated ones too, gives one row. The rank file is read on the driver, where its size is checked.
    """
    ranks = read_ranks(ranks_path)
    splits, unreached = split_tokens(ranks)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, splits, unreached))

    def make() -> Callable[[list], dict]:
        pieces, find = Pieces(Encoder(*shared.value)), regex.compile(pattern).findall
        back = _decoder(shared.value[0]) if with_decoded else None

        def work(texts: list) -> dict:
            ids = [b"".join(map(pieces.__getitem__, find(t))) if t else b"" for t in texts]
            out = {"ids": pa.array([np.frombuffer(x, "<u4").astype("int32") for x in ids], pa.list_(pa.int32())) if as_array else pa.array(ids, pa.binary())}
            return out | ({"decoded": pa.array([back(x) for x in ids], pa.binary())} if back else {})

        return work

    return map_texts(docs, make, ("ids array<int>" if as_array else "ids binary") + ", decoded binary" * with_decoded, id_col, text_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """Decode binary ids to bytes: the id column, ids and decoded (binary). Null ids give no bytes; an unknown id fails."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make() -> Callable[[list], dict]:
        back = _decoder(shared.value)
        return lambda found: {"decoded": pa.array([back(x) for x in found], pa.binary())}

    return map_texts(encoded, make, "decoded binary", id_col, "ids", keep=["ids"])


def digests(decoded: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """n_tokens and the SHA-256 of ids and of the decoded bytes; the columns in keep as well."""
    return decoded.select(
        id_col,
        *(keep or []),
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
