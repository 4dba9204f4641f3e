"""BPE encoding by prefix-sharing trie traversal, and decoding.

A tokenizer file (JSON) gives vocabulary, merges and added tokens.  The
distinct words of a slice of documents are visited in the depth-first order
of their trie, which is their sorted order; what two neighbours share is the
path they have in common.  Each node holds the last token of its prefix's
encoding: the one token that ends there and that the last token of what comes
before can stand next to, meaning that merging the two from scratch gives
back the two.  So a shared prefix is encoded once, and a word of any length
costs time in proportion to its length.  Reading the last tokens backward
from a word's end gives its encoding.

Documents are encoded where they are read, slice by slice, with no shuffle.
The cache of encoded words is bounded and only saves time.

Defined results: a null text is empty; an empty text has no tokens and
decodes to the empty text; added tokens in a text are themselves; repeated
rows are encoded alike; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

SLICE_CHARS = 1 << 20
CACHED_WORDS = 120_000
CACHED_PAIRS = 160_000

#: Unicode White_Space, as the tokenizer's pattern understands it.
BLANK = r"\t-\r \x85\xa0  -     　"
# Fixed value: the word pattern of the tokenizer file.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+")
END = "</w>"


def suffixes(tokens: dict[bytes, int]) -> dict[bytes, int]:
    """The tokens, and every end of a token that is none, with -1."""
    out = {t[k:]: -1 for t in tokens for k in range(len(t))}
    return out | tokens


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 is itself, the rest follows from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens of a word-end BPE file, as bytes, inside words and at their end."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
            raise ValueError("a BPE file with word ends is expected")
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.symbols: dict[int, tuple[bytes, bool]] = {}
        ids = model["vocab"]
        for token, i in ids.items():
            last = token.endswith(END)
            text = token.removesuffix(END) if last else token
            if all(c in to_byte for c in text) and text:
                raw = bytes(to_byte[c] for c in text)
                (self.final if last else self.inner)[raw] = i
                self.symbols[i] = (raw, last)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.inner_suffixes, self.final_suffixes = map(suffixes, (self.inner, self.final))
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = {k: np.array([v], "<u4").tobytes() for k, v in added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") \
            if added else None
        texts = {i: t for t, i in (ids | added).items()}
        self.as_bytes = [i.to_bytes(4, "little") for i in range(max(texts) + 1)]
        self.texts = pa.array([texts.get(i, "") for i in range(max(texts) + 1)], pa.large_string())
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.tops: dict[int, tuple[int, int, int] | None] = {}

    def merged(self, tokens: list[int], least: int = 1) -> list[int]:
        """Plain merging, lowest rank first, leftmost first, down to ``least`` tokens."""
        while len(tokens) > least:
            best = min(((self.merges[p][0], k) for k, p in enumerate(pairwise(tokens)) if p in self.merges),
                       default=None)
            if best is None:
                break
            k = best[1]
            tokens[k:k + 2] = [self.merges[tokens[k], tokens[k + 1]][1]]
        return tokens

    def _start(self, token: int) -> list[int]:
        raw, last = self.symbols[token]
        return [(self.final if last and k == len(raw) - 1 else self.inner)[raw[k:k + 1]] for k in range(len(raw))]

    def top(self, token: int) -> tuple[int, int, int] | None:
        """The last merge in the encoding of a token's own text, as its rank
        and the two tokens; rank -1: a single symbol; None: the text has
        another encoding.  At most one entry per token of the vocabulary."""
        if token not in self.tops:
            parts = self.merged(self._start(token), 2)
            rank, whole = self.merges.get(tuple(parts), (None, None)) if len(parts) == 2 else (-1, parts[0])
            self.tops[token] = (rank, parts[0], parts[-1]) if whole == token else None
        return self.tops[token]

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand next to each other in an encoding;
        left -1: at the start of a word.  Merges are taken back, the last one
        first: at no time may the two tokens at the border have had a merge
        that comes before the one taken back (of equal rank, the one further
        left comes first)."""
        known = self.pairs.get((left, right))
        if known is None:
            a, b = self.top(left) if left >= 0 else (-1, -1, -1), self.top(right)
            x, y, limit, known = left, right, len(self.merges), a is not None and b is not None
            while known and left >= 0:
                if self.merges.get((x, y), (limit,))[0] < limit:
                    known = False
                elif a[0] > b[0]:
                    limit, x = a[0], a[2]
                    a = self.top(x)
                elif b[0] >= 0:
                    limit, y = b[0] + 1, b[1]
                    b = self.top(y)
                else:
                    break
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def learn(self, words: list[str]) -> None:
        """Encode distinct words into the cache, in depth-first trie order."""
        if len(self.words) + len(words) > CACHED_WORDS:
            self.words.clear()
        pairs, fit, as_bytes, learnt = self.pairs, self.fit, self.as_bytes, self.words
        inner, final = self.inner_suffixes.get, self.final_suffixes.get
        # of each prefix on the path: its last token and where that starts
        tokens, starts = [-1], [0]
        before = b""
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            n, shared, most = len(raw), 0, min(len(raw), len(before), len(tokens))
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            del tokens[min(shared, n - 1) + 1:], starts[min(shared, n - 1) + 1:]
            for end in range(len(tokens), n + 1):
                known = inner if end < n else final
                at = end - 1
                while True:  # exactly one fits
                    token = known(raw[at:end])
                    if token >= 0:
                        left = tokens[at]
                        ok = pairs.get((left, token))
                        if ok or ok is None and fit(left, token):
                            break
                    at -= 1
                if end < n:
                    tokens.append(token)
                    starts.append(at)
            out = [as_bytes[token]]
            while at:
                out.append(as_bytes[tokens[at]])
                at = starts[at]
            out.reverse()
            learnt[word] = b"".join(out)
            before = raw

    def pieces(self, text: str) -> list[str]:
        """The words of a text in order; added tokens as they are."""
        if self.split is None or not self.split.search(text):
            return WORD.findall(normalised(text))
        out: list[str] = []
        for part in self.split.split(text):
            out += [part] if part in self.added else WORD.findall(normalised(part))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.pieces(t) for t in texts]
        wanted = set().union(*pieces) - self.added.keys()
        new = wanted - self.words.keys()
        if new and len(self.words) + len(new) > CACHED_WORDS:
            new = wanted  # the cache starts anew
        if new:
            self.learn(list(new))
        self.words |= self.added
        get = self.words.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids, as the file without a decoder gives
        them: the tokens with a blank between."""
        tokens = self.texts.take(ids.flatten())
        lists = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), tokens)
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def normalised(text: str) -> str:
    """NFC and lower case, each character by itself."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def word_bpe_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


_LOADED: dict[bytes, Vocabulary] = {}


def vocabulary(file: bytes) -> Vocabulary:
    """One per Python worker and file."""
    key = sha256(file).digest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(file)
    return _LOADED[key]


def _slices(texts: pa.Array, limit: int) -> Iterator[list[str]]:
    out, held = [], 0
    for text in texts:
        out.append(text.as_py() or "")
        held += len(out[-1])
        if held >= limit:
            yield out
            out, held = [], 0
    if out:
        yield out


def _encoded(batches: Iterator[pa.RecordBatch], file, limit: int) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(file.value)
    for batch in batches:
        done = 0
        for texts in _slices(batch.column(1), limit):
            ids = vocab.encode(texts)
            offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            yield pa.record_batch([batch.column(0).slice(done, len(texts)), pa.ListArray.from_arrays(offsets, values)],
                                  names=["doc_id", "ids"])
            done += len(texts)
    # the worker may go on with other stages: it keeps the vocabulary only
    vocab.words.clear()
    vocab.pairs.clear()


def _decoded(batches: Iterator[pa.RecordBatch], file) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(file.value)
    for batch in batches:
        yield pa.record_batch([*batch.columns, vocab.decode(batch.column(1))], names=["doc_id", "ids", "decoded"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(1), batch.column(2).cast(pa.large_binary())
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        yield pa.record_batch(
            [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)),
             pa.array([sha256(values[a:b].tobytes()).hexdigest() for a, b in pairwise(offsets)], pa.string()),
             pa.array([sha256(t.as_buffer() or b"").hexdigest() for t in texts], pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _input(docs: DataFrame, path: str):
    with open(path, "rb") as f:  # a vocabulary file on the driver: a few MB
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return docs, file, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def encode(docs: DataFrame, path: str, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """doc_id and ``ids`` (array<int>) of each document."""
    docs, file, doc_id = _input(docs, path)
    return docs.mapInArrow(lambda it: _encoded(it, file, slice_chars), f"{doc_id}, ids array<int>")


def encode_and_decode(docs: DataFrame, path: str, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """doc_id, ``ids`` and the ``decoded`` text of each document, in one pass:
    a task needs one Python worker, and the vocabulary is in memory once."""
    docs, file, doc_id = _input(docs, path)
    return docs.mapInArrow(lambda it: _decoded(_encoded(it, file, slice_chars), file),
                           f"{doc_id}, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with the ``decoded`` text; null ids decode to null."""
    with open(path, "rb") as f:
        file = encoded.sparkSession.sparkContext.broadcast(f.read())
    encoded = encoded.select(encoded["doc_id"].alias("doc_id"), encoded["ids"].alias("ids"))
    doc_id = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(lambda it: _decoded(it, file), f"doc_id {doc_id}, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, path: str, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, and the SHA-256 of
    the ids and of the decoded text."""
    docs, file, doc_id = _input(docs, path)
    return docs.mapInArrow(lambda it: _digests(_decoded(_encoded(it, file, slice_chars), file)),
                           f"{doc_id}, n_tokens long, ids_sha256 string, decoded_sha256 string")
