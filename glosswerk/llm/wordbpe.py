"""BPE with word ends as a streaming transducer of bounded lookahead, and its decoder.

A vocabulary's merge list fixes how far to the right a decision can depend on bytes not
yet seen.  Whether a token ends at a place changes only if a rule (x, y) merges across
it, with x the last token before the place at that time; whether y stands there hangs on
rules of lower rank that cross y's own end, and so on.  Ranks fall along such a chain,
so the longest one can be computed from the list (``lookahead``), and a boundary that is
found with so many symbols after it stands whatever follows.  ``Transducer`` holds one
window of symbols, emits the tokens before its last such boundary and keeps the rest;
closing a word gives its last symbol the word-end form.

Texts are read in blocks.  Blocks end before white space where there is some, else before
a character that neither composes with the one before it nor stands near an apostrophe,
so that normalising and splitting block by block gives the words of the whole text; a word
that crosses the end of a block goes to the transducer in parts.  Memory beside the
text and its ids is one block and one window, however long a text or a word is (only a
run of combining marks is never cut, as it has no end to its normal form).

Words of up to ``SHORT`` bytes recur, so their ids are kept in a table of at most
``WORDS`` words; when it is full it replaces an older one, from which words that come
again are taken over.

Decoding pushes ids through a byte-to-text machine that holds back a split character's
bytes until the rest come.  ``joined`` gives the vocabulary's own token strings with
spaces between, as the tokenizers library does for a file without a decoder; otherwise
the bytes that tokens stand for, with a space after each word's end and U+FFFD for
bytes that are no UTF-8.

Odd input: null and empty texts have no ids and decode to the empty text; rows that
repeat a doc_id are coded each; an empty table gives an empty result; extra columns stay
and are replaced where they are named like a result.  Special tokens written out in a text
become their ids, as in the library, unless ``specials`` is false.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Hashable, Iterable, Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswerk.llm.bpe import byte_alphabet
from glosswerk.llm.shared import slices

SHORT = 32
WORDS = 1 << 18
BLOCK_CHARS = 1 << 15
IDS = 1 << 16


class Merges:
    """A merge list: ``rules`` are (left, right, result) in order of their ranks."""

    def __init__(self, rules: Sequence[tuple[Hashable, Hashable, Hashable]]):
        self.rules, self.order = rules, {(a, b): k for k, (a, b, _) in reversed([*enumerate(rules)])}
        made: dict[Hashable, list[int]] = defaultdict(list)
        for k, (a, b, c) in enumerate(rules):
            made[c].append(k)
        if any(made.get(part) and made[part][-1] >= k for k, rule in enumerate(rules) for part in rule[:2]):
            raise ValueError("a rule stands before one that makes its part, so no lookahead is known")
        self.lookahead = self._reach(made)

    def _reach(self, made: dict[Hashable, list[int]]) -> int:
        """The longest chain of rules that can move a boundary, in symbols."""
        width: dict[Hashable, int] = {}
        for a, b, c in self.rules:
            width[c] = width.get(a, 1) + width.get(b, 1)
        # of the rules met so far, by left part: their ranks, and the farthest reach up to each
        ranks: dict[Hashable, list[int]] = defaultdict(list)
        reach: dict[Hashable, list[int]] = defaultdict(list)

        def beyond(token: Hashable, before: int) -> int:
            """How far past ``token`` lies what can take its end away in rules below ``before``."""
            most = 0
            if n := bisect_left(ranks[token], before) if token in ranks else 0:
                most = reach[token][n - 1]
            for k in made.get(token, ()):  # its right part may be taken before the token is made
                if k < before:
                    most = max(most, beyond(self.rules[k][1], k))
            return most

        for k, (a, b, _) in enumerate(self.rules):
            far = width.get(b, 1) + beyond(b, k)
            ranks[a].append(k)
            reach[a].append(max(far, reach[a][-1] if reach[a] else 0))
        return max((r[-1] for r in reach.values()), default=0)

    def apply(self, symbols: list) -> list:
        """``symbols`` after all merges: lowest rank first, leftmost of equal ranks."""
        n = len(symbols)
        if n < 2:
            return symbols
        if n <= 128:
            symbols, none = [*symbols], len(self.rules)
            ranks = [*map(self.order.get, zip(symbols, symbols[1:], strict=False), repeat(none))]
            while ranks and (best := min(ranks)) < none:
                k = ranks.index(best)
                symbols[k : k + 2] = [self.rules[best][2]]
                del ranks[k]
                if k:
                    ranks[k - 1] = self.order.get((symbols[k - 1], symbols[k]), none)
                if k < len(ranks):
                    ranks[k] = self.order.get((symbols[k], symbols[k + 1]), none)
            return symbols
        symbols, after, before = [*symbols], [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.order[p], k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in self.order]
        heapify(heap)
        while heap:
            best, k = heappop(heap)
            (a, b, merged), nxt = self.rules[best], after[k]
            if nxt < 0 or symbols[k] != a or symbols[nxt] != b:
                continue
            symbols[k], symbols[nxt] = merged, None
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j >= 0 and (p := (symbols[i], symbols[j])) in self.order:
                    heappush(heap, (self.order[p], i))
        return [s for s in symbols if s is not None]


class Transducer:
    """Ids of one word after another, of any length, in constant memory."""

    def __init__(self, merges: Merges, inner: Sequence, final: Sequence, width: Sequence[int] | dict):
        """Symbols of a byte within a word and at its end; bytes of each id."""
        self.merges, self.inner, self.final, self.width = merges, inner, final, width
        self.window = max(256, 4 * merges.lookahead)
        self.held: bytes = b""

    def push(self, data: bytes) -> Iterator[list]:
        """Takes bytes of the open word; the ids that no later byte can change."""
        self.held += data
        at, size = 0, self.window + self.merges.lookahead
        while len(self.held) - at > size:  # the byte after the window shows that its last one ends no word
            ids = self.merges.apply([*map(self.inner.__getitem__, self.held[at : at + size])])
            end = n = 0
            while end + self.width[ids[n]] <= self.window:
                end += self.width[ids[n]]
                n += 1
            yield ids[:n]
            at += end
        self.held = self.held[at:]

    def close(self) -> list:
        """Ends the word."""
        data, self.held = self.held, b""
        return self.merges.apply([*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]]) if data else []


#: Characters that every Unicode version in use normalises, lower-cases and classes alike,
#: and none of which composes with another.  Others go through the library's own tables.
_PLAIN = re.compile(r"[^\x00-ɏА-я‐-‧一-龥가-힣\U0001F300-\U0001F64F]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that compose with one before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    return frozenset(second | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def _can_cut(text: str, at: int) -> bool:
    c = text[at]
    apart = not unicodedata.combining(c) and unicodedata.category(c)[0] in "LNPSZ" and c not in _joining()
    return apart and "'" not in text[max(0, at - 3) : at + 1]


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        m = _SPACE.search(text, at + size, at + 2 * size)
        end = m.start() if m else next((k for k in range(at + size, len(text)) if _can_cut(text, k)), len(text))
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokenizer, model = Tokenizer.from_file(path), spec["model"]
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        vocab, self.ending = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.alphabet = byte_alphabet()
        chars = {b: c for c, b in self.alphabet.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.strings = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        self.raw = [self._bytes(tokens.get(i, "")) for i in range(max(tokens) + 1)]
        width = [len(t.removesuffix(self.ending)) for t in map(tokens.get, range(len(self.raw)), [""] * len(self.raw))]
        inner, final = ([vocab[chars[b] + end] for b in range(256)] for end in ("", self.ending))
        self.transducer = Transducer(self.merges, inner, final, width)
        self.table = _Words(self.transducer)

    def _bytes(self, token: str) -> bytes:
        if token in self.special:
            return token.encode()
        word = token.removesuffix(self.ending)
        return bytes(self.alphabet[c] for c in word) + (b" " if word != token else b"")

    def split(self, block: str) -> list[bytes]:
        """The words of a block, normalised."""
        if not _PLAIN.search(block):
            found = self.words.findall(block.lower())
            return [w.encode() for w in found]
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(block))
        return [bytes(map(self.alphabet.__getitem__, w)) for w, _ in pieces]

    def _one_word(self, left: bytes, right: bytes) -> bool:
        """Do two normalised words go together where they touch?"""
        pair = left[-4:].decode(errors="ignore")[-1] + right[:4].decode(errors="ignore")[0]
        return len(self.splitter.pre_tokenize_str(pair)) == 1

    def stream(self, text: str, specials: bool = True) -> Iterator[bytes]:
        """Ids of ``text`` as little-endian unsigned 32-bit integers, piece by piece."""
        at = 0
        for m in self._special.finditer(text) if specials else ():
            yield from self._words(text[at : m.start()])
            yield self.special[m.group()].to_bytes(4, "little")
            at = m.end()
        yield from self._words(text[at:] if at else text)

    def _words(self, text: str) -> Iterator[bytes]:
        table, last, end = self.table, b"", 0  # last: the word that is open, as far as it is known
        for block in blocks(text):
            found = self.split(block)
            end += len(block)
            touches = end < len(text) and not _SPACE.match(text, end) and bool(self.split(block[-1]))  # no white space at its end
            if last and self.split(block[0]) and self._one_word(last, found[0]):  # the open word goes on
                last = found.pop(0)
                yield from map(_pack, self.transducer.push(last))
                if touches and not found:
                    continue
            if last:
                yield _pack(self.transducer.close())
                last = b""
            if touches:
                last = found.pop()
            yield b"".join(map(table.__getitem__, found))
            if last:
                yield from map(_pack, self.transducer.push(last))
        if last:
            yield _pack(self.transducer.close())

    def encode(self, text: str, specials: bool = True) -> bytes:
        return b"".join(self.stream(text, specials))

    def decoder(self, joined: bool = False) -> Decoder:
        return Decoder(self.strings if joined else self.raw, b" " if joined else b"")

    def decode(self, ids: np.ndarray, joined: bool = False) -> str:
        machine = self.decoder(joined)
        out = [machine.push(ids[k : k + IDS].tolist()) for k in range(0, len(ids), IDS)]
        return "".join([*out, machine.close()])


class _Words(dict):
    """Packed ids of words."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older = transducer, {}

    def __missing__(self, word: bytes) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            ids = [_pack(x) for x in self.transducer.push(word)]
            packed = b"".join([*ids, _pack(self.transducer.close())])
        if len(word) <= SHORT:
            if len(self) >= WORDS:
                self.older = {**self}
                self.clear()
            self[word] = packed
        return packed


class Decoder:
    """Ids to text as they come: a character split between ids waits for its last byte."""

    def __init__(self, table: Sequence[bytes], between: bytes = b""):
        self.table, self.between, self.begun = table, between, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def push(self, ids: Iterable[int]) -> str:
        data = self.between.join(map(self.table.__getitem__, ids))
        if self.between and data:
            data = self.between + data if self.begun else data
            self.begun = True
        return self.utf8.decode(data)

    def close(self) -> str:
        self.begun = False
        return self.utf8.decode(b"", final=True)


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _with(df: DataFrame, drop: list[str], *fields: T.StructField) -> tuple[list[str], T.StructType]:
    names = {f.name for f in fields} | set(drop)
    kept = [f for f in df.schema if f.name not in names]
    return [f.name for f in kept], T.StructType([*kept, *fields])


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, packed: bool = False, specials: bool = True, keep_text: bool = True) -> DataFrame:
    """``docs`` with a column of token ids: array<int>, or with ``packed`` the ids as
    little-endian unsigned 32-bit integers in a binary."""
    path = path or default_path()
    kept, schema = _with(docs, [] if keep_text else [text], T.StructField(ids, T.BinaryType() if packed else T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for batch in slices(whole, text):
                found = [c.encode(x or "", specials) for x in batch.column(text).to_pylist()]
                column = pa.array(found, pa.binary()) if packed else pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), column], names=[*kept, ids])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, joined: bool = False) -> DataFrame:
    """``encoded`` with the text of its ids (array or packed) as string ``out``."""
    path = path or default_path()
    kept, schema = _with(encoded, [], T.StructField(out, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            column = batch.column(ids)
            binary = pa.types.is_binary(column.type)
            for k in range(batch.num_rows):  # a row at a time: texts of batches of ids may be long
                x = column[k].as_py()
                found = c.decode(np.frombuffer(x or b"", "<u4") if binary else np.array(x or [], np.int64), joined)
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(n) for n in kept), pa.array([found], pa.string())], names=[*kept, out])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the joined form)."""
    coded = encode(docs.select("doc_id", "text"), path=path, packed=True, keep_text=False)
    return decode(coded, path=path, joined=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
