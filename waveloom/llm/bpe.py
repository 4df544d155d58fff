"""BPE encoding and decoding that speculates and verifies.

For the words of a batch, all at once: the longest token at every place is found by walking a trie from all
places together, a greedy walk over these proposes tokens, and a vectorised check tests every pair of
neighbours.  Merges run in the order of their ranks and a merge ranks after those that made its parts, so a
proposal is the right encoding exactly if, for each pair, no merge across the border would have had its
turn before the merges that made the two tokens.  Only words with a pair that fails are merged exactly.
The library reads the vocabulary, and normalises and splits segments that hold characters beyond `PLAIN`.

Defined results: null and empty texts have no ids and decode to the empty text; the strings of special
tokens in a text become their ids, as in the library; repeated rows get equal results; an empty table gives
an empty one; columns named like an added one are replaced, all others stay.
"""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

#: Below this code point the library's and our own tables of letters, digits and white space are the same.
PLAIN = 0x0530
#: Bytes that a worker process remembers in each of two generations of words; words of more than LONG bytes are not.
REMEMBERED, LONG, ENTRY = 64 << 20, 100, 160
#: Bytes of words that are encoded together.
BATCH = 1 << 20
_SHIFT = 17
_NEVER = np.iinfo(np.int64).max
#: The end of a word as a symbol after its bytes.
_END = 256


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable bytes for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (chr(256 + i) for i in range(256))
    return [chr(b) if b in shown else next(hidden) for b in range(256)]


class Words:
    """Tables made from one vocabulary, and the codec of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, suffix = made["model"], made["model"]["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(_byte_chars())}

        def symbols(token: str) -> tuple[int, ...]:
            ends = len(token) > len(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if ends else token
            return (*(byte_of[c] for c in body), *((_END,) if ends else ()))

        size = max(self.vocab.values()) + 1
        self.first = np.full(size, -1)  # the two parts of each token, and the rank of the merge that makes it
        self.second, self.rank = self.first.copy(), self.first.copy()
        merges = {}
        for r, (a, b) in enumerate(model["merges"]):
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if self.rank[k] >= 0 or self.rank[i] >= r or self.rank[j] >= r:
                raise ValueError("the check of pairs needs one merge for each token, after those of its parts")
            self.first[k], self.second[k], self.rank[k] = i, j, r
            merges[i << _SHIFT | j] = (r, k)
        self.pairs = np.array(sorted(merges), np.int64)
        self.pair_rank = np.array([merges[k][0] for k in self.pairs.tolist()], np.int64)
        self.merges = merges
        spelled = {symbols(t): i for t, i in self.vocab.items()}
        #: The tokens of single bytes, inside a word and at its end.
        self.inner = [spelled[b,] for b in range(256)]
        self.final = [spelled[b, _END] for b in range(256)]
        #: Only tokens that the merges of their own bytes give may be proposed.
        self._trie({s: i for s, i in spelled.items() if self.exact(bytes(s[:-1] if s[-1] == _END else s), s[-1] == _END) == [i]})
        self.memory: dict[str, bytes] = {t: np.int32(i).tobytes() for t, i in self.special.items()}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.proposed = self.failed = 0
        marks = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None
        rules = [r["pattern"]["Regex"] for r in made["pre_tokenizer"]["pretokenizers"] if r["type"] == "Split"]
        self.split = regex.compile(rules[0]).findall
        #: Strings of all tokens, each followed by a blank.
        names = [""] * max(size, *(i + 1 for i in self.special.values()))
        for t, i in (self.vocab | self.special).items():
            names[i] = t + " "
        raw = [n.encode() for n in names]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(raw), np.uint8)

    def _trie(self, tokens: dict[tuple[int, ...], int]) -> None:
        """Arcs (state, symbol) to states, as sorted keys; each state's token, or -1."""
        states: dict[tuple[int, ...], int] = {(): 0}
        arcs: dict[int, int] = {}
        for s in tokens:
            for k in range(1, len(s) + 1):
                if s[:k] not in states:
                    states[s[:k]] = len(states)
                    arcs[states[s[: k - 1]] << 9 | s[k - 1]] = states[s[:k]]
        self.arcs = np.array(sorted(arcs), np.int64)
        self.targets = np.array([arcs[k] for k in self.arcs.tolist()], np.int64)
        self.token_at = np.full(len(states), -1)
        for s, i in tokens.items():
            self.token_at[states[s]] = i

    # -- encoding -------------------------------------------------------------------------------

    def exact(self, word: bytes, ends: bool = True) -> list[int]:
        """The ids of one word by its merges: least rank first, then leftmost."""
        ids = [self.inner[b] for b in word]
        if ends:
            ids[-1] = self.final[word[-1]]
        n, get = len(ids), self.merges.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << _SHIFT | ids[i + 1]))]
        heapify(queue)
        while queue:
            _, i, made, a, b = heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get(made << _SHIFT | ids[k]):
                    heappush(queue, (m[0], i, m[1], made, ids[k]))
            if (h := before[i]) >= 0 and (m := get(ids[h] << _SHIFT | made)):
                heappush(queue, (m[0], h, m[1], ids[h], made))
        return [i for i in ids if i >= 0]

    def _longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that begins at each place, and its number of symbols."""
        n = len(symbols)
        token, length = np.full(n, -1), np.zeros(n, np.int64)
        places, state, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(places):
            key = state << 9 | symbols[places + depth]
            at = np.searchsorted(self.arcs, key)
            at[at == len(self.arcs)] = 0
            hit = self.arcs[at] == key
            places, state, depth = places[hit], self.targets[at[hit]], depth + 1
            found = self.token_at[state]
            # the end of a word is no token: what stops right before it is no match
            follows = np.where(places + depth < n, symbols[np.minimum(places + depth, n - 1)], -1)
            good = (found >= 0) & ((follows != _END) | (symbols[places + depth - 1] == _END))
            token[places[good]], length[places[good]] = found[good], depth
            ends = (symbols[places + depth - 1] == _END) | (places + depth >= n)
            places, state = places[~ends], state[~ends]
        return token, length

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens: whether their merges, run together, give just these two.

        Going back in time, the later of the two innermost parts is taken apart; a merge of the parts that stand
        at the border would have come first if its rank is below that of the merge that takes the left part
        and not above that of the merge that takes the right one (of equal merges the left one goes first).
        """
        x, y = left.copy(), right.copy()
        taken_x, taken_y = np.full(len(x), _NEVER), np.full(len(x), _NEVER)
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            key = x[live] << _SHIFT | y[live]
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            m = np.where(self.pairs[at] == key, self.pair_rank[at], _NEVER)
            bad = (m < taken_x[live]) & (m <= taken_y[live]) & (m < _NEVER)
            good[live[bad]] = False
            live = live[~bad]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            base = (rx < 0) & (ry < 0)
            live, rx, ry = live[~base], rx[~base], ry[~base]
            later = rx > ry
            a, b = live[later], live[~later]
            taken_x[a], taken_y[b] = rx[later], ry[~later]
            x[a], y[b] = self.second[x[a]], self.first[y[b]]
        return good

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as the bytes of little-endian 32-bit integers."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        ends = np.cumsum(sizes)
        symbols = np.full(ends[-1], _END)
        inside = np.ones(ends[-1], bool)
        inside[ends - 1] = False
        symbols[inside] = np.frombuffer(b"".join(raw), np.uint8)
        token, length = self._longest(symbols)
        step, places, counts = length.tolist(), [], []
        p = 0
        for end in ends.tolist():
            before = len(places)
            while p < end:
                places.append(p)
                p += step[p]
            counts.append(len(places) - before)
        ids = token[places]
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(ids[inner] << _SHIFT | ids[inner + 1], return_inverse=True)
        good = self.compatible(pairs >> _SHIFT, pairs & ((1 << _SHIFT) - 1))[where]
        failed = np.unique(owner[inner[~good]])
        self.proposed += len(words)
        self.failed += len(failed)
        flat = ids.astype("<i4").tobytes()
        cuts = (4 * np.append(0, np.cumsum(counts))).tolist()
        parts = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for w in failed.tolist():
            parts[w] = np.array(self.exact(raw[w]), "<i4").tobytes()
        return parts

    def words(self, text: str) -> list[str]:
        """The words of a text as the library splits it, and the special tokens it holds."""
        if self.marks is None or "<|" not in text:
            return self._words(text)
        out: list[str] = []
        for k, part in enumerate(self.marks.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.split(text.lower())
        if max(text) < chr(PLAIN):
            # one character at a time: no rule for the end of a word
            text = unicodedata.normalize("NFC", text)
            return self.split(text.lower() if "Σ" not in text else "".join(map(str.lower, text)))
        text = self.library.normalizer.normalize_str(text)
        # the library gives words in the characters of bytes; the places lead back to the text
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _in_batches(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        begin = held = 0
        for k, w in enumerate(words):
            held += len(w) + 1
            if held >= BATCH:
                out += self.encode_words(words[begin : k + 1])
                begin, held = k + 1, 0
        return out + self.encode_words(words[begin:])

    def _known(self, wanted: set[str]) -> dict[str, bytes]:
        """The ids of each word, remembered or new."""
        if self.held > REMEMBERED:
            self.older, self.held = self.memory, 0
            self.memory = {t: np.int32(i).tobytes() for t, i in self.special.items()}
        new = wanted.difference(self.memory)
        added = {w: self.older[w] for w in new if w in self.older}
        fresh = sorted(new.difference(added))
        found = dict(zip(fresh, self._in_batches(fresh), strict=True))
        long = {w: ids for w, ids in found.items() if len(w) > LONG}
        added |= {w: ids for w, ids in found.items() if w not in long}
        self.memory |= added
        self.held += sum(ENTRY + len(w) + len(ids) for w, ids in added.items())
        return self.memory | long if long else self.memory

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as the bytes of little-endian 32-bit integers."""
        split = [self.words(t) if t else [] for t in texts]
        get = self._known(set().union(*split)).__getitem__
        return [b"".join(map(get, words)) for words in split]

    # -- decoding -------------------------------------------------------------------------------

    def decode(self, raw: list[bytes]) -> list[str]:
        """The strings of each text's tokens with blanks between; ids that name no token give nothing."""
        flat = np.frombuffer(b"".join(raw), "<i4").astype(np.int64)
        known = (flat >= 0) & (flat < len(self.sizes))
        n = np.where(known, self.sizes[np.where(known, flat, 0)], 0)
        ends = np.cumsum(n)
        where = np.repeat(self.begins[np.where(known, flat, 0)] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        out = self.pool[where].tobytes()
        cuts = np.append(0, ends)[np.append(0, np.cumsum([len(r) // 4 for r in raw])).astype(np.int64)].tolist()
        return [out[a : max(a, b - 1)].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_loaded: dict[str, Words] = {}


def words(path: str) -> Words:
    """One codec for each worker process."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def encode(docs: DataFrame, text: str = "text", path: str | None = None, decoded: bool = False, packed: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add `ids` (array of int), or `packed` (their bytes as little-endian unsigned 32-bit integers) if asked for, and
    `decoded`, the text that these ids give, if asked for."""
    path = tokenizer_path(path)

    def make():
        codec = words(path)

        def work(texts: list[str]) -> dict:
            raw = codec.encode(texts)
            if packed:
                out = {"packed": pa.array(raw, pa.binary())}
            else:
                ends = np.append(0, np.cumsum([len(r) // 4 for r in raw])).astype(np.int32)
                out = {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4").astype(np.int32)))}
            return out | ({"decoded": codec.decode(raw)} if decoded else {})

        return work

    first = T.StructField("packed", T.BinaryType()) if packed else T.StructField("ids", T.ArrayType(T.IntegerType()))
    return map_texts(docs, text, T.StructType([first] + ([T.StructField("decoded", T.StringType())] if decoded else [])), make, keep)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add `decoded`: the text of the array of ids in column `ids`; null gives the empty text."""
    path = tokenizer_path(path)
    kept = [n for n in rows.columns if n.lower() != "decoded"]
    out = T.StructType([rows.schema[n] for n in kept] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        codec = words(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                raw = [np.array([i if i is not None and 0 <= i < 1 << 31 else -1 for i in v or []], "<i4").tobytes() for v in part.column("__ids__").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(codec.decode(raw), pa.string())], names=[*kept, "decoded"])

    return rows.select(*[F.col(f"`{n}`") for n in kept], F.col(f"`{ids}`").alias("__ids__")).mapInArrow(run, out)


def contract(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = encode(docs.select("doc_id", "text"), path=path, decoded=True, packed=True, keep=["doc_id"])
    return coded.select(
        "doc_id",
        (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
