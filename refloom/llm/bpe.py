"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A sequence of tokens is the BPE encoding of its bytes just if each two neighbours are the encoding of theirs. So while bytes are
read, the only open question is where the pending token began. A hypothesis is a token that has ended and the place in the trie of
tokens that the bytes since then lead to; at each place exactly one hypothesis can end its pending token and start another. A state
of the transducer is the set of hypotheses alive, and knows the token that ends there. Once one hypothesis is left, all tokens before
it are sure and are emitted, so output lags input by a bounded lookahead: hypotheses die within the longest token. States and transitions are made when
text first needs them and kept up to a bound, after which the machine starts afresh; the result doesn't depend on that.

Texts are split by the vocabulary's pattern first, and each match goes through the machine from its start state. Null texts
are empty, and the empty text has no tokens. Special tokens are never made. Repeated rows are rows of their own; an empty table gives no
rows. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import types
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from refloom.llm.common import lean

#: States and known pairs kept at most, and known words of each of two generations.
MAX_STATES, MAX_PAIRS, MAX_WORDS = 120_000, 150_000, 80_000
#: More than any rank.
MANY = 1 << 60
#: What a state holds besides its transitions, which are under bytes.
ALIVE, ENDS = -1, -2
#: Tokens below a node that are tried one by one.
FEW = 24
#: Bytes of a word that may wait before what is sure is emitted.
FLUSH = 256
#: Words longer than this are not kept.
KEPT_CHARS = 48
#: Tokens that are decoded at once.
CHUNK = 65_536


# Code points that have no character in Unicode 16, which the vocabularies' encoders go by, but are letters or numbers to the `regex` package.
LATER_LETTERS = (
    "\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    "\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1"
    "\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    "\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24"
    "\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5"
    "\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD"
    "\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
LATER_NUMBERS = "\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
#: Texts without characters from here on are split by classes written out, which the standard library's patterns are quicker with.
NARROW = 0x250


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file of tokens in base 64, each with its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def _narrow_class(kinds: str) -> str:
    """The characters under NARROW of these general categories, as ranges of a class."""
    return "".join(f"\\x{c:02x}" if c < 256 else f"\\u{c:04x}" for c in range(NARROW) if unicodedata.category(chr(c))[0] in kinds)


def narrowed(pattern: str) -> str | None:
    """The pattern with classes written out for characters under NARROW; None if it has escapes other than these."""
    known = {r"\p{L}": _narrow_class("L"), r"\p{N}": _narrow_class("N"), r"\s": r"\t-\r \x85\xa0"}
    out, inside, at = [], False, 0
    while at < len(pattern):
        escape = next((e for e in (*known, r"\S") if pattern.startswith(e, at)), None)
        if escape == r"\S" and not inside:
            out.append(f"[^{known[chr(92) + 's']}]")
        elif escape in known:
            out.append(known[escape] if inside else f"[{known[escape]}]")
        elif pattern[at] == "\\":
            return None
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
        at += len(escape or "x")
    return "".join(out)


class Splitter:
    """All matches of a vocabulary's pattern in a text, by the classes of Unicode 16."""

    def __init__(self, pattern: str):
        narrow = narrowed(pattern)
        exact = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{LATER_LETTERS}]]").replace(r"\p{N}", rf"[\p{{N}}--[{LATER_NUMBERS}]]")
        self.wide, self.narrow = regex.compile(pattern).findall, narrow and re.compile(narrow).findall
        self.exact = regex.compile(exact, regex.V1).findall
        self.is_wide, self.is_later = re.compile(f"[{chr(NARROW)}-{chr(0x10FFFF)}]").search, re.compile(f"[{LATER_LETTERS}{LATER_NUMBERS}]").search

    def __call__(self, text: str) -> list[str]:
        if self.narrow and (text.isascii() or not self.is_wide(text)):
            return self.narrow(text)
        return self.exact(text) if self.is_later(text) else self.wide(text)


class Transducer:
    """Encodes byte strings by rank merges in one pass over the bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = list(map(len, self.tokens))
        # A trie of the tokens' bytes: the children of each node, and the token that ends there or -1.
        self.children: list[dict[int, int]] = [{}]
        self.ends, self.depth = [-1], [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.children[node]
                if byte not in below:
                    below[byte] = len(self.ends)
                    self.children.append({})
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = below[byte]
            self.ends[node] = rank
        #: How many tokens are at a node or below.
        self.below = [int(e >= 0) for e in self.ends]
        for node in range(len(self.ends) - 1, -1, -1):
            self.below[node] += sum(self.below[c] for c in self.children[node].values())
        self.pairs: dict[tuple[int, int, int], bool] = {}
        self.standing: dict[tuple[int, int], int | None] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.restart()

    def restart(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.start: dict = {ALIVE: (), ENDS: -1}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by the merge rule itself; for short strings only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _made_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a single byte."""
        if (halves := self.halves.get(token, 0)) == 0:
            data = self.tokens[token]
            halves = self.halves[token] = None if len(data) == 1 else self._halves(data)
        return halves

    def _halves(self, data: bytes) -> tuple[int, int]:
        for cut in range(1, len(data)):
            a, b = self.ranks.get(data[:cut]), self.ranks.get(data[cut:])
            # The last merge is of two tokens that stand side by side in the encoding of their bytes, if this merge is left out.
            if a is not None and b is not None and self._follows(a, b, self.ranks[data]):
                return a, b
        raise ValueError(f"{data!r} is not made by merges")

    def _follows(self, last: int, token: int, below: int = MANY) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes, by the merges of rank under `below`.

        They are not if, while they were made, a merge over the seam came first. The parts at the seam are taken
        back in the order in which they were made, latest first, and each pair of them is held against the merges up to then.
        """
        if last < 0:
            return True
        key = (last, token, below)
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._apart(last, token, below)
        return ok

    def _apart(self, left: int, right: int, below: int) -> bool:
        tokens, ranks = self.tokens, self.ranks
        while True:
            # `below` bounds the ranks of merges that came before the parts at hand were used up.
            if ranks.get(tokens[left] + tokens[right], below) < below:
                return False
            # Of the two, the part of higher rank was made later; of equal rank, the right one, as merges run from the left.
            if left > right:
                if (halves := self._made_of(left)) is not None:
                    below, left = left, halves[1]
                    continue
                if (halves := self._made_of(right)) is None:
                    return True
                below, right = right + 1, halves[0]
            else:
                if (halves := self._made_of(right)) is not None:
                    below, right = right + 1, halves[0]
                    continue
                if (halves := self._made_of(left)) is None:
                    return True
                below, left = left, halves[1]

    def _kept(self, last: int, node: int) -> int | None:
        """The token that stands for `last` before whatever pends at this node: -1 if all tokens below may follow it, None if none may.

        This merges states that differ in nothing to come, and lets hypotheses die early.
        """
        key = (last, node)
        if key in self.standing:
            return self.standing[key]
        if len(self.standing) >= MAX_PAIRS:
            self.standing.clear()
        found = last
        if self.below[node] <= FEW:
            may = [self._apart(last, t, MANY) for t in self._tokens_below(node)]
            found = -1 if all(may) else last if any(may) else None
        self.standing[key] = found
        return found

    def _tokens_below(self, node: int) -> list[int]:
        out = [self.ends[node]] if self.ends[node] >= 0 else []
        for child in self.children[node].values():
            out += self._tokens_below(child)
        return out

    def _state(self, alive: tuple) -> dict:
        """The state of these hypotheses, (token that ended, node of the pending one), the oldest first."""
        found = self.states.get(alive)
        if found is None:
            ends, pairs = self.ends, self.pairs
            for last, node in alive:
                token = ends[node]
                if token >= 0:
                    ok = pairs.get((last, token, MANY))
                    if ok or ok is None and self._follows(last, token):
                        break
            else:
                raise ValueError("the vocabulary lacks single bytes")
            found = self.states[alive] = {ALIVE: alive, ENDS: token}
        return found

    def _step(self, state: dict, byte: int) -> dict:
        """Work out the transition and keep it."""
        children = self.children
        alive, kept = [], self.standing
        for last, node in (*state[ALIVE], (state[ENDS], 0)):
            if below := children[node].get(byte):
                if last >= 0 and (last := kept[key] if (key := (last, below)) in kept else self._kept(last, below)) is None:
                    continue
                alive.append((last, below))
        found = state[byte] = self._state(tuple(alive))
        return found

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > MAX_STATES:
            self.restart()
        out: list[int] = []
        state, path = self.start, []
        for byte in data:
            state = state.get(byte) or self._step(state, byte)
            path.append(state[ENDS])
            if len(path) >= FLUSH and len(state[ALIVE]) == 1:
                # What stands before the one pending token is sure.
                pending = self.depth[state[ALIVE][0][1]]
                out += self._traced(path[:-pending])
                path = path[-pending:]
        return out + self._traced(path)

    def _traced(self, ends: list[int]) -> list[int]:
        """The tokens of a stretch from the tokens that end at each of its places."""
        out, sizes, at = [], self.sizes, len(ends)
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out


class Words(dict):
    """The packed ids of the words met of late; the generation before stays until this one is full."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.before = machine, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.before.get(word)
        if packed is None:
            ids = array("I", self.machine.encode(word.encode()))
            if sys.byteorder == "big":
                ids.byteswap()
            packed = ids.tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self) >= MAX_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = packed
        return packed


class Utf8Stream:
    """An incremental UTF-8 state machine: bytes in, whole characters out. The state is the bytes of an unfinished character."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:  # not a continuation byte: it says how many bytes its character has
                size = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
                keep = back if size > back else 0
                break
        cut = len(data) - keep
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.words = Words(self.machine)
        self.split = Splitter(pattern)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.machine.tokens.__getitem__, ids))

    def stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        """The text of a stream of ids, in pieces of whole characters."""
        machine = Utf8Stream()
        for ids in chunks:
            yield machine.feed(self.decode_bytes(ids))
        yield machine.end()


def tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    """The worker's tokenizer of this vocabulary, kept from task to task."""
    kept = sys.modules.setdefault("refloom_worker", types.ModuleType("refloom_worker")).__dict__
    key = hashlib.sha256(ranks).digest(), pattern
    if key not in kept:
        kept[key] = Tokenizer(read_ranks(ranks), pattern)
    return kept[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    The file of ranks is read by the driver and broadcast (a vocabulary, under a megabyte); executors need no file of that path.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    schema = texts.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(shipped.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids_sha, text_sha, packs = [], [], [], []
                for value in part.column(1):
                    packed = tok.packed(value.as_py())
                    ids = np.frombuffer(packed, "<u4")
                    decoded = hashlib.sha256()
                    for piece in tok.stream(ids[i : i + CHUNK].tolist() for i in range(0, len(ids), CHUNK)):
                        decoded.update(piece.encode())
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(packed).hexdigest())
                    text_sha.append(decoded.hexdigest())
                    if with_ids:
                        packs.append(ids)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    flat = np.concatenate([*packs, np.zeros(0, "<u4")]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return texts.mapInArrow(task, schema)
