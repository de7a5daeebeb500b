"""Byte-level BPE by a finite-state transducer, and streaming decoding.

Encoding. A split of bytes into tokens is what merging by rank gives if and
only if each pair of neighbouring tokens is what merging gives for the two
alone. So every prefix has one last token, found from shorter prefixes, and
reading a byte is a move of an automaton: its state is the last token emitted
and the bytes still pending; tokens are emitted as soon as every boundary that
a later token could start from agrees on them, which happens within a lookahead
bounded by the longest tokens. States and moves are made when first needed
(lazy determinisation) and kept in a table of bounded size; when it is full,
further states are used without being kept. Whether two tokens may stand side by
side is remembered, too.

Decoding. An incremental UTF-8 automaton turns ids into text, holding back at
most three bytes between ids; its moves over whole tokens are made when first
needed. The digest of a decoded text is taken of what the automaton gives.

Defined results: a null text is empty and has no ids; repeated rows each get a
row; texts of any length are encoded whole; unknown ids raise KeyError. Ids that
are no UTF-8 together have their own bytes' digest, and U+FFFD in the text. A
column of the input that is named like one of the result gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import insort
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, small_batches

RANK_FILE = "byte_bpe_50k.tiktoken"
MAX_STATES, MAX_PIECES, MAX_BORDERS = 60_000, 180_000, 150_000
#: So many bytes to a piece's end are read in one go once no more states are kept.
SHORT = 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(ranks: dict[bytes, int], data: bytes, least: int = 1) -> list[int]:
    """Merging by rank, as it is defined: the lowest rank first, leftmost first; down to ``least`` parts."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > least:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """A state is (last token emitted or -1, pending bytes, last token at each pending boundary,
    (boundary, place in the trie) for each token not yet ended); the first two decide the others.

    Moves are kept in one table by state and byte: the next state, or for a move that emits
    tokens the complement of its place in ``outs``.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.token = ranks, {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        #: place * 256 + byte -> next place; tokens end at some places, and some lead no further.
        self.trie: dict[int, int] = {}
        self.at: dict[int, int] = {}
        inner = set()
        places = 1
        for t, i in ranks.items():
            place = 0
            for b in t:
                inner.add(place)
                to = self.trie.get(place << 8 | b)
                if to is None:
                    to = self.trie[place << 8 | b] = places
                    places += 1
                place = to
            self.at[place] = i
        self.leaf = frozenset(self.at).difference(inner)
        self.whole: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.border: dict[int, bool] = {}
        self.states: list[tuple] = [(-1, b"", (-1,), ())]
        self.number = {(-1, b""): 0}
        self.moves: dict[int, int] = {}
        self.outs: list[tuple[int, tuple[int, ...]]] = []
        self.ends: dict[int, tuple[int, ...]] = {}

    def _halves(self, t: int) -> tuple[int, int]:
        """The two tokens that merging joins last; a single byte is its own halves."""
        got = self.parts.get(t)
        if got is None:
            two = merge(self.ranks, self.token[t], 2)
            got = self.parts[t] = (two[0], two[1]) if len(two) == 2 else (t, t)
        return got

    def _stands(self, left: int, right: int) -> bool:
        """Whether the right token may follow the left one; the answers are remembered."""
        got = self.border.get(left << 20 | right)
        if got is None:
            got = self._undo(left, right)
            if len(self.border) >= MAX_BORDERS:
                self.border.clear()
            self.border[left << 20 | right] = got
        return got

    def _undo(self, left: int, right: int) -> bool:
        """Whether the right token may follow the left one (-1: the start).

        Merging the two side by side leaves them alone if, undoing their merges from the last one
        on, no pair across the border could have been merged before the merge just undone.
        """
        ok = self.whole.get(right)
        if ok is None:
            ok = self.whole[right] = merge(self.ranks, self.token[right]) == [right]
        if left < 0 or not ok:
            return ok
        token, ranks, bound = self.token, self.ranks, 1 << 60
        while True:
            across = ranks.get(token[left] + token[right])
            if across is not None and across < bound:
                return False
            one, two = self.size[left] > 1, self.size[right] > 1
            if not one and not two:
                return True
            # The merge with the higher rank came later. Of equal ranks the left one came first.
            if one and (not two or left > right):
                bound, left = left, self._halves(left)[1]
            else:
                bound, right = right + 1, self._halves(right)[0]

    def _path(self, ends: tuple[int, ...], at: int) -> list[int]:
        """The boundaries from ``at`` back to the first pending byte."""
        out = [at]
        while at:
            at -= self.size[ends[at]]
            out.append(at)
        return out

    def _step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        last, pending, ends, open_ = state
        n = len(pending) + 1
        trie, at, leaf, token, still = self.trie, self.at, self.leaf, None, []
        # Only where a token could be under way can one end here; the longest comes first.
        for j, place in (*open_, (n - 1, 0)):
            to = trie.get(place << 8 | byte)
            if to is None:
                continue
            if token is None and to in at and self._stands(ends[j], at[to]):
                token = at[to]
            if to not in leaf:
                still.append((j, to))
        if token is None:
            raise ValueError("the ranks lack a single byte")
        pending += bytes((byte,))
        ends += (token,)
        # The last boundary that lies on the way back from every live one.
        cut = n
        if still:
            size = self.size
            live = [j for j, _ in still]
            live.append(n)
            while len(live) > 1:
                j = live.pop()
                j -= size[ends[j]]
                if j not in live:
                    insort(live, j)
            cut = live[0]
        if not cut:
            return (last, pending, ends, tuple(still)), ()
        return (ends[cut], pending[cut:], ends[cut:], tuple([(j - cut, place) for j, place in still])), tuple([ends[j] for j in self._path(ends, cut)[-2::-1]])

    def _flush(self, state: tuple) -> tuple[int, ...]:
        ends = state[2]
        return tuple(ends[j] for j in self._path(ends, len(ends) - 1)[-2::-1])

    def encode(self, piece: bytes) -> tuple[int, ...]:
        own = self.ranks.get(piece)
        if own is not None:
            return (own,)
        out: list[int] = []
        moves, outs, at = self.moves, self.outs, 0
        for k, b in enumerate(piece):
            to = moves.get(at << 8 | b)
            if to is None:
                if len(self.states) >= MAX_STATES and len(piece) - k <= SHORT:
                    out.extend(self._end(self.states[at], piece[k:]))
                    return tuple(out)
                state, some = self._step(self.states[at], b)
                if len(self.states) >= MAX_STATES and state[:2] not in self.number:
                    return (*out, *some, *self._rest(state, piece[k + 1 :]))
                to = self._keep(at, b, state, some)
            if to < 0:
                to, some = outs[~to]
                out.extend(some)
            at = to
        end = self.ends.get(at)
        if end is None:
            end = self.ends[at] = self._flush(self.states[at])
        return (*out, *end)

    def _keep(self, at: int, byte: int, state: tuple, some: tuple[int, ...]) -> int:
        to = self.number.get(state[:2])
        if to is None:
            to = self.number[state[:2]] = len(self.states)
            self.states.append(state)
        if some:
            self.outs.append((to, some))
            to = -len(self.outs)
        if len(self.moves) < 4 * MAX_STATES:
            self.moves[at << 8 | byte] = to
        return to

    def _rest(self, state: tuple, piece: bytes) -> Iterator[int]:
        """What is emitted from a state that is not kept on: its states are used once."""
        for k, b in enumerate(piece):
            if len(piece) - k <= SHORT:
                yield from self._end(state, piece[k:])
                return
            state, some = self._step(state, b)
            yield from some
        yield from self._flush(state)

    def _end(self, state: tuple, piece: bytes) -> list[int]:
        """The same for a few bytes to the end: moves as in ``_step``, but all is emitted at once."""
        _, _, ends, open_ = state
        ends, open_ = list(ends), list(open_)
        step, token_at, leaf, stands = self.trie.get, self.at.get, self.leaf, self._stands
        for n, byte in enumerate(piece, len(ends) - 1):
            token, still = None, []
            open_.append((n, 0))
            for j, place in open_:
                to = step(place << 8 | byte)
                if to is not None:
                    if token is None:
                        token = token_at(to)
                        if token is not None and not stands(ends[j], token):
                            token = None
                    if to not in leaf:
                        still.append((j, to))
            if token is None:
                raise ValueError("the ranks lack a single byte")
            ends.append(token)
            open_ = still
        out, at, size = [], len(ends) - 1, self.size
        while at:
            token = ends[at]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out


class Utf8Stream:
    """Bytes in, whole code points out; a bad sequence gives U+FFFD."""

    def __init__(self) -> None:
        self.need = 0  # continuation bytes that are still missing
        self.low, self.high = 0x80, 0xBF  # what the next one may be
        self.held = bytearray()
        self.bad = False

    def feed(self, data: Iterable[int]) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append("�")
                self.held.clear()
                self.need, self.bad = 0, True
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                self.held.append(b)
            else:
                out.append("�")
                self.bad = True
        return "".join(out)

    def end(self) -> str:
        cut, self.need = "�" if self.need else "", 0
        self.bad = self.bad or bool(cut)
        self.held.clear()
        return cut


class TokenStream:
    """The UTF-8 automaton a token at a time: its moves over whole tokens are made when first needed.

    From between two code points, a token of whole code points is its text. Other moves are kept by
    (bytes held back, token), at most ``MAX_STATES`` of them.
    """

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.moves: dict[tuple[bytes, int], tuple[bytes, str, bool]] = {}
        outer = self

        class Clean(dict):
            def __missing__(self, i: int) -> str:
                held, text, good = outer._move(b"", i)
                if held or not good:
                    raise KeyError(i)
                self[i] = text
                return text

        self.clean = Clean()

    def _move(self, held: bytes, i: int) -> tuple[bytes, str, bool]:
        stream = Utf8Stream()
        stream.feed(held)
        text = stream.feed(self.token[i])
        return bytes(stream.held), text, not stream.bad

    def text(self, ids: Iterable[int]) -> tuple[str, bool]:
        """The text, and whether all of it was good UTF-8."""
        out, held, fine = [], b"", True
        for i in ids:
            got = self.moves.get((held, i))
            if got is None:
                got = self._move(held, i)
                if len(self.moves) < MAX_STATES:
                    self.moves[held, i] = got
            held, text, good = got
            out.append(text)
            fine = fine and good
        return "".join(out) + ("\ufffd" if held else ""), fine and not held


#: Below U+0250 these are all letters and numbers there are; \\x1c to \\x1f are white space to ``re`` alone.
LETTERS, NUMBERS, BEYOND = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", re.compile("[^\\x00-\\x1b\\x20-ɏ]")


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts below U+0250, for the faster library; None if it can't be put so."""
    for name, members in ((r"\p{L}", LETTERS), (r"\p{N}", NUMBERS)):
        at = 0
        while (at := pattern.find(name, at)) >= 0:
            inside = pattern.rfind("[", 0, at) > pattern.rfind("]", 0, at)
            put = members if inside else f"[{members}]"
            pattern = pattern[:at] + put + pattern[at + len(name) :]
            at += len(put)
    return None if re.search(r"\\[pPXRKhN]|\[\[|\|\||&&|--|\(\?[a-zA-Z|]|[+*?}]\+", pattern) else re.compile(pattern)


class Codec:
    """Texts to ids and back; what it remembers of pieces is bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst, self.full = Transducer(ranks), regex.compile(pattern)
        self.latin = latin_pattern(pattern)
        self.decimal = {i: str(i) for i in self.fst.token}
        self.stream = TokenStream(self.fst.token)
        outer = self

        class Ids(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                ids = outer.fst.encode(piece.encode("utf-8", "surrogatepass"))
                if len(self) < MAX_PIECES and len(piece) < 64:  # the common pieces come first
                    self[piece] = ids
                return ids

        self.pieces = Ids()

    def split(self, text: str) -> list[str]:
        return (self.full if self.latin is None or BEYOND.search(text) else self.latin).findall(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.fst.token.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self._decoded(list(ids))[0]

    def _decoded(self, ids: list[int]) -> tuple[str, bool]:
        try:
            return "".join(map(self.stream.clean.__getitem__, ids)), True
        except KeyError:  # some token begins or ends within a code point
            return self.stream.text(ids)

    def decoded(self, ids: list[int]) -> bytes:
        """The bytes of the streamed text; where that is not good UTF-8, the tokens' own bytes."""
        text, good = self._decoded(ids)
        return text.encode() if good else self.decode_bytes(ids)


def shared_ranks(spark: SparkSession, path: str):
    """The rank table (some 50,000 entries, fixed) on every executor, with its digest as name."""
    ranks = load_ranks(path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast(ranks), name


def map_texts(df: DataFrame, ranks_path: str, pattern: str, row: Callable[[Codec, str], tuple], schema: str, text: str = "text") -> DataFrame:
    """Applies ``row`` to each text; the other columns stay, but those named like a new one."""
    spark = df.sparkSession
    small_batches(spark)
    ranks, name = shared_ranks(spark, ranks_path)
    added = spark.createDataFrame([], schema).schema
    keep = [c for c in df.columns if c != text and c.lower() not in {f.name.lower() for f in added.fields}]
    whole = df.select(*keep, text)
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields[:-1]] + [f"`{f.name}` {f.dataType.simpleString()}" for f in added.fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    names = [f.name for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a codec has learnt is used by later tasks of the worker.
        c = hold(f"codec {name} {pattern}", lambda: Codec(ranks.value, pattern))
        for b in batches:
            got = [row(c, x.as_py() or "") for x in b.column(b.num_columns - 1)]
            cols = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], *names])

    return whole.mapInArrow(run, out)


def digests(c: Codec, ids: list[int]) -> tuple:
    return (
        len(ids),
        hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest(),
        hashlib.sha256(c.decoded(ids)).hexdigest(),
    )


def digest_row(c: Codec, text: str) -> tuple:
    return digests(c, c.encode(text))


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return map_texts(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, digest_row, DIGEST)
