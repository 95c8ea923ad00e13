"""BPE encoding and decoding by a prefix-sharing trie.

Words are split off exactly as the tokenizer file says, the distinct ones of a block
of texts go into a trie, and one depth-first walk over it gives every node the last
token of the encoding of its prefix. The encoding of a prefix is the encoding of
what stands before its last token plus that token, so encodings of shared prefixes
are worked out once. A token can be the last one after a token p if merging their
symbols alone gives the two tokens again; exactly one token that ends the prefix can.

The trie is held as the sorted words, each with the length of the prefix that it shares
with the one before: the order of the words is the depth-first order of the nodes, and a
walk needs the states of one path only, whatever the number of words.

Splitting, finding distinct words and putting ids in place of words run over whole
blocks in Arrow's kernels. There is no shuffle: a task sees whole texts, its tables are
bounded in bytes for any size of input, and they are emptied when it ends.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import mapped

#: Bytes that a worker's table of pieces may take, with what Python adds to them; the other tables have parts of it.
MAX_HELD = 48 << 20
#: Bytes that an entry takes besides its letters.
ENTRY = 200
#: UTF-8 bytes of the texts that are encoded together; by the trie, whose walk shares more prefixes in more words.
BLOCK_BYTES, TRIE_BYTES = 4 << 20, 8 << 20
#: White space by Unicode's White_Space property.
UNICODE_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The part of it that is not ASCII.
OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: What makes a match depend on what stands beside it.
CONTEXT = re.compile(r"\(\?|\\[bBAZzGKX]|\$|(?<!\[)\^")


class Table(dict):
    """A dict that is emptied when its entries take more than `most` bytes, as told."""

    def __init__(self, most: int = MAX_HELD):
        self.most, self.held = most, 0

    def grown(self, size: int) -> None:
        """To be called before an entry of so many bytes is put in."""
        self.held += size
        if self.held > self.most:
            self.clear()
            self.held = size


class Recent:
    """Values of words, in at most about `most` bytes: the newest half, and the half before it, of which stays what is asked for again."""

    def __init__(self, most: int = MAX_HELD):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def values(self, words: list[str]) -> list[bytes | None]:
        found = list(map(self.new.get, words))
        if self.old and (again := [k for k, x in enumerate(found) if x is None]):
            kept = {k: x for k, x in zip(again, map(self.old.get, [words[k] for k in again]), strict=True) if x is not None}
            for k, x in kept.items():
                found[k] = x
            self.add({words[k]: x for k, x in kept.items()})
        return found

    def add(self, entries: dict[str, bytes]) -> None:
        size = sum(map(len, entries)) + sum(map(len, entries.values())) + ENTRY * len(entries)
        if self.held + size > self.most // 2:
            self.old, self.new, self.held = self.new, {}, 0
        if size <= self.most // 2:
            self.new.update(entries)
            self.held += size


@lru_cache(256)
def _packed(n: int) -> Callable[..., bytes]:
    """Packs n numbers as little-endian 32-bit integers."""
    return struct.Struct(f"<{n}I").pack


class Encoded(NamedTuple):
    """Ids of several texts, one after the other, and how many each text has."""

    ids: np.ndarray
    counts: np.ndarray

    def lists(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int32)), pa.array(self.ids.astype(np.int32, copy=False), pa.int32()))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a tokenizer file with word ends, lower case and dropped white space."""

    block_bytes = TRIE_BYTES

    def __init__(self, path: str, max_held: int = MAX_HELD):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.made_of = {a + b: (a, b) for a, b in self.rank}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.symbols = byte_symbols()
        self.all_symbols = "".join([*self.symbols[:32], " ", *self.symbols[33:]])
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.token = [""] * (1 + max(*self.vocab.values(), *self.special.values()))
        for t, k in [*self.vocab.items(), *self.special.items()]:
            self.token[k] = t
        self.max_held = max_held
        self.tokens = pa.array(self.token, pa.string())
        self.numbers = pa.array([str(k) for k in range(len(self.token))], pa.string())
        self.clear()

    def clear(self) -> None:
        """Empties the tables."""
        most = self.max_held
        self._whole, self._edges = Table(most // 8), (Table(most // 8), Table(most // 8))
        self._follows = Table(most // 2)
        self._word, self._piece = Recent(most // 2), Recent(most)

    # -- merging of a few symbols, for the tests that the walk needs ------------------

    def _parts(self, token: str) -> list[str]:
        if token.endswith(self.end) and token != self.end:
            chars = list(token.removesuffix(self.end))
            chars[-1] += self.end
            return chars
        return list(token)

    def _merge(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _is_whole(self, token: str) -> bool:
        """Whether the vocabulary has the token and merging its symbols gives it."""
        if (known := self._whole.get(token)) is None:
            self._whole.grown(ENTRY)
            known = self._whole[token] = token in self.vocab and self._merge(self._parts(token)) == [token]
        return known

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The tokens that stand at one end of the token while it is merged (side 0: its left end), each
        with the rank of the merge that takes it up. A token's parts have lower ranks than the token."""
        known = self._edges[side]
        if (found := known.get(token)) is None:
            known.grown(10 * ENTRY)
            found, rank = [], 1 << 60
            while True:
                found.append((token, rank))
                if (pair := self.made_of.get(token)) is None:
                    break
                rank = self.rank[pair]
                token = pair[side]
            found.reverse()
            known[found[-1][0]] = found
        return found

    def _can_follow(self, first: str, then: str) -> bool:
        """Whether no merge crosses from one token to the other while both are made."""
        if (known := self._follows.get((first, then))) is None:
            self._follows.grown(ENTRY)
            left, right, rank = self._edge(first, 1), self._edge(then, 0), self.rank
            i = j = 0
            known = True
            while True:
                (x, until_x), (y, until_y) = left[i], right[j]
                crossing = rank.get((x, y), 1 << 60)
                if crossing < until_x and crossing <= until_y:  # of equal merges the left one comes first
                    known = False
                    break
                if until_x == until_y == 1 << 60:  # neither is taken up any more
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
            self._follows[first, then] = known
        return known

    # -- the trie ---------------------------------------------------------------------

    def _last(self, tail: str, depth: int, last: list[str], end: str) -> str:
        vocab, follows = self.vocab, self._follows
        for n in range(len(tail), 0, -1):
            token = tail[-n:] + end
            if token in vocab:
                if n == depth:
                    if self._is_whole(token):
                        return token
                elif (ok := follows.get((last[depth - n], token))) or (ok is None and self._can_follow(last[depth - n], token)):
                    return token
        raise ValueError(f"no token ends {tail!r}")

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word (byte symbols) as little-endian 32-bit integers."""
        out: dict[str, bytes] = {}
        vocab, end, skip, longest, follows = self.vocab, self.end, len(self.end), self.longest, self._follows
        last: list[str] = [""]  # by depth, along the path to the word at hand
        before = ""
        for word in sorted(words):
            same = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            size = len(word)
            del last[same + 1 :]
            for depth in range(len(last), size):  # the nodes that the word adds to the trie
                # as _last does without an end, in place: most of the time goes here
                for at in range(depth - longest if depth > longest else 0, depth):
                    token = word[at:depth]
                    if token in vocab:
                        if not at:
                            if self._is_whole(token):
                                break
                        elif (ok := follows.get((last[at], token))) or (ok is None and self._can_follow(last[at], token)):
                            break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
                last.append(token)
            token = self._last(word[max(0, size - longest) :], size, last, end)
            ids, at = [vocab[token]], size - len(token) + skip
            while at:
                ids.append(vocab[last[at]])
                at -= len(last[at])
            ids.reverse()
            out[word] = _packed(len(ids))(*ids)
            before = word
        return out

    # -- texts ------------------------------------------------------------------------

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character's lower case by itself (no rule for a sigma that ends a word)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()

    def _split(self, piece: str) -> list[str]:
        """A piece without white space, as the words that are encoded by themselves."""
        return [piece] if piece.isalpha() else self.words(piece)

    def _all_symbols(self, spaced: str) -> str:
        """Of words that are joined by spaces, which stay; in one step for all of them."""
        if spaced.isascii() and spaced.isprintable():
            return spaced
        return codecs.charmap_decode(spaced.encode("utf-8", "surrogatepass"), "strict", self.all_symbols)[0]

    def _new_words(self, words: list[str]) -> list[bytes]:
        spelled = self._all_symbols(" ".join(words)).split(" ")
        found = self.encode_words(set(spelled))
        return [found[w] for w in spelled]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece without white space."""
        found = self._piece.values(pieces)
        rest = [k for k, x in enumerate(found) if x is None]
        split = [self._split(pieces[k]) for k in rest]
        every = list({w for ws in split for w in ws})
        ids = dict(zip(every, self._word.values(every), strict=True))
        if new := [w for w, x in ids.items() if x is None]:
            made = dict(zip(new, self._new_words(new), strict=True))
            ids.update(made)
            self._word.add(made)
        made = {pieces[k]: ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for k, ws in zip(rest, split, strict=True)}
        self._piece.add(made)
        for k in rest:
            found[k] = made[pieces[k]]
        return found

    def _found(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each of the different pieces where its own begin and how many they are."""
        found = self._encode_pieces(pieces.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes, sizes

    def _plain(self, texts: pa.Array) -> Encoded:
        """Of texts without special tokens."""
        lower = pc.ascii_lower(texts)
        odd = np.flatnonzero(~pc.string_is_ascii(texts).to_numpy(zero_copy_only=False))
        if len(odd):
            made = [self.normal(t) for t in texts.take(pa.array(odd)).to_pylist()]
            made = [UNICODE_SPACE.sub(" ", t) if OTHER_SPACE.search(t) else t for t in made]
            lower = pc.replace_with_mask(lower, pa.array(np.bincount(odd, minlength=len(texts)).astype(bool)), pa.array(made, pa.string()))
        lists = pc.ascii_split_whitespace(lower)
        pieces = lists.flatten().dictionary_encode()
        flat, begins, sizes = self._found(pieces.dictionary)
        at = pieces.indices.to_numpy(zero_copy_only=False)
        ids, ends = _runs(flat, begins[at], sizes[at])
        return Encoded(ids, np.diff(ends[lists.offsets.to_numpy()]))

    def encode_block(self, texts: pa.Array) -> Encoded:
        """Ids of each text."""
        cut = {}
        if self.split_special:
            for k in np.flatnonzero(pc.match_substring(texts, "<").to_numpy(zero_copy_only=False)).tolist():
                parts = self.split_special.split(texts[k].as_py())
                if len(parts) > 1:
                    cut[k] = parts
        if not cut:
            return self._plain(texts)
        parts = [cut.get(k) or [texts[k].as_py()] for k in range(len(texts))]
        found = self._plain(pa.array([x for p in parts for x in p[::2]], pa.string()))
        ids = iter(np.split(found.ids, np.cumsum(found.counts)[:-1]))
        joined = [np.concatenate([np.array([self.special[x]], np.uint32) if j % 2 else next(ids) for j, x in enumerate(p)]) for p in parts]
        return Encoded(np.concatenate(joined), np.array([len(x) for x in joined]))

    def decode(self, encoded: Encoded) -> pa.Array:
        """What the library gives for a file without a decoder: the tokens joined by spaces."""
        return pc.binary_join(_looked_up(encoded, self.tokens), " ")

    def spelled(self, encoded: Encoded) -> pa.Array:
        """The ids in decimals, joined by spaces."""
        return pc.binary_join(_looked_up(encoded, self.numbers), " ")


def _runs(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flat one after the other, and where each ends, with a 0 before."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat((begins - ends[:-1]).astype(np.int32), sizes)
    places += np.arange(ends[-1], dtype=np.int32)
    return flat[places], ends


def _looked_up(encoded: Encoded, table: pa.Array) -> pa.Array:
    ends = pa.array(np.concatenate([[0], np.cumsum(encoded.counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, table.take(pa.array(encoded.ids.astype(np.int32, copy=False))))


class LibraryBpe(WordBpe):
    """The same, with the different words of new pieces encoded by the library's own model, all in one call.

    Known pieces are held in Arrow's and numpy's arrays, so that finding them, and putting ids
    together, takes no step of Python for each.
    """

    block_bytes = BLOCK_BYTES

    def __init__(self, path: str, max_held: int = 2 * MAX_HELD):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path, max_held)
        self.library = Tokenizer(Tokenizer.from_file(path).model)
        self.library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # between words; no symbol of a byte is white space
        self.ends_word = np.array([t.endswith(self.end) for t in self.token])
        self.no_context = not CONTEXT.search(self.words.__self__.pattern)

    def clear(self) -> None:
        super().clear()
        self._known, self._flat, self._sizes = pa.array([], pa.string()), np.array([], "<u4"), np.array([], np.int64)

    def _words_of(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all pieces, and how many each piece has: from one search if no match can reach over a space."""
        if self.no_context:
            words = self.words(" ".join(pieces))
            ends, borders = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (words, pieces))
            upto = np.searchsorted(ends, borders, "right")
            if len(words) and upto[-1] == len(words) and upto[0] and (ends[upto - 1] == borders).all():  # every letter is in a word
                return words, np.diff(upto, prepend=0)
        split = [self.words(p) for p in pieces]
        return [w for ws in split for w in ws], np.fromiter(map(len, split), np.int64, len(split))

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and how many each has; a word that several have is encoded once."""
        plain = pc.ascii_is_alpha(pieces).to_numpy(zero_copy_only=False)
        split, counts = self._words_of(pieces.filter(pa.array(~plain)).to_pylist())
        own = np.ones(len(pieces), np.int64)
        own[~plain] = counts
        words = pa.concat_arrays([pieces.filter(pa.array(plain)), pa.array(split, pa.string())]).dictionary_encode()
        ids = np.array(self.library.encode_batch_fast([self._all_symbols(" ".join(words.dictionary.to_pylist()))], add_special_tokens=False)[0].ids, "<u4")
        ends = np.concatenate([[0], np.flatnonzero(self.ends_word[ids]) + 1])
        if len(ends) != len(words.dictionary) + 1:
            raise ValueError("the tokens of some word have no end of their own")
        # words as they lie in the pieces: a plain piece is a word, others have theirs in order
        first = np.cumsum(own) - own
        at = np.empty(len(words), np.int64)
        at[first[plain]] = words.indices[: int(plain.sum())].to_numpy(zero_copy_only=False)
        rest = np.ones(len(words), bool)
        rest[first[plain]] = False
        at[rest] = words.indices[int(plain.sum()) :].to_numpy(zero_copy_only=False)
        flat, upto = _runs(ids, ends[at], np.diff(ends)[at])
        return flat, np.diff(upto[np.concatenate([[0], np.cumsum(own)])])

    def _found(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = pc.fill_null(pc.index_in(pieces, value_set=self._known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, sizes = self._flat, self._sizes
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = pieces.take(pa.array(new))
            own, counts = self._encoded(fresh)
            at[new] = len(sizes) + np.arange(len(new))
            flat, sizes = np.concatenate([flat, own]), np.concatenate([sizes, counts])
            size, most = fresh.nbytes + own.nbytes + counts.nbytes, self.max_held // 8
            if self._known.nbytes + self._flat.nbytes + self._sizes.nbytes + size <= most:
                self._known, self._flat, self._sizes = pa.concat_arrays([self._known, fresh]), flat, sizes
            elif size <= most:  # the newest stay
                self._known, self._flat, self._sizes = fresh, own, counts
            else:
                self.clear()
        return flat, (np.cumsum(sizes) - sizes)[at], sizes[at]


_CODERS: dict[tuple[type, str], WordBpe] = {}


def coder(path: str, kind: type[WordBpe] = WordBpe) -> WordBpe:
    """The worker's coder for a tokenizer file; the vocabulary outlives the task."""
    if (kind, path) not in _CODERS:
        _CODERS[kind, path] = kind(path)
    return _CODERS[kind, path]


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts with their first index; each run has at most `size` bytes, or one longer text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, texts.slice(start, end - start)
        start, before = end, int(ends[end - 1])


def gathered(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, with batches put together while their second column has `size` bytes at most: the more
    texts are encoded together, the fewer words are met as new ones more than once."""
    held, total = [], 0
    for batch in batches:
        more = batch.column(1).nbytes
        if held and total + more > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
        if len(batch):
            held.append(batch)
            total += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sha256(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for x in texts.cast(pa.binary())], pa.string())


#: What `encode` can return besides the id column and n_tokens.
COLUMNS = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(df: DataFrame, tokenizer: str, *columns: str, id_col: str = "doc_id", text_col: str = "text", kind: type[WordBpe] = WordBpe, end_id: int | None = None) -> DataFrame:
    """Per row: the id column, `n_tokens` long and the named columns (without names: ids).

    ids: array<int> of the whole text; decoded: their text; ids_sha256: lowercase hex
    digest of the decimal ids joined by one space; decoded_sha256: of the decoded text
    in UTF-8. tokenizer: a file of the tokenizers library. end_id: appended to each row's ids.
    A null or empty text has no ids and decodes to the empty string. Repeated rows stay
    and get the same ids. An empty table gives an empty table. Other columns than the
    two named are not looked at, so their names do not matter. A text of any length is
    encoded whole. Special tokens written out in a text become their ids, as in the library.
    """
    columns = columns or ("ids",)
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens bigint, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer, kind)
        for batch in gathered(batches, bpe.block_bytes):
            for start, block in blocks(batch.column(1), bpe.block_bytes):
                encoded = bpe.encode_block(block)
                if end_id is not None:
                    encoded = Encoded(np.insert(encoded.ids, np.cumsum(encoded.counts), end_id), encoded.counts + 1)
                decoded = bpe.decode(encoded) if {"decoded", "decoded_sha256"} & {*columns} else None
                made = {"ids": encoded.lists, "decoded": lambda d=decoded: d, "ids_sha256": lambda e=encoded: _sha256(bpe.spelled(e)), "decoded_sha256": lambda d=decoded: _sha256(d)}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(block)), pa.array(encoded.counts, pa.int64()), *[made[c]() for c in columns]], [id_col, "n_tokens", *columns])

    return mapped(rows, run, schema, lambda: coder(tokenizer, kind).clear())


def decode(df: DataFrame, tokenizer: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with `out_col`: the text of the ids; null ids give null, no ids the empty string."""

    @F.pandas_udf("string")
    def text(ids):
        token = coder(tokenizer).token
        return ids.map(lambda x: None if x is None else " ".join([token[k] for k in x.tolist()]))

    return df.withColumn(out_col, text(F.col(ids_col)))
