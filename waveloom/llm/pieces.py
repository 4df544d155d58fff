"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into chunks that no merge can cross (a pair of neighbouring characters that no piece
of the vocabulary holds is such a border), and distinct chunks are encoded together: one flat array
of symbols; in each round the least pair rank of every chunk, its leftmost merges at once, and
compaction, until no chunk has a pair left.  The library is used to read the vocabulary only.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows get
equal results; columns named like an added one are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
DECODED = T.StructType([T.StructField("decoded", T.StringType())])

_MARK = "▁"
#: A space run in front of a word belongs to its chunk; a line break is never inside a piece.
_CHUNK = re.compile(r" *[^ \n]+| +|\n")
_NONE = np.iinfo(np.int64).max
_SHIFT = 22
#: Bytes that a worker process remembers in each of two generations of chunks; when the younger is full, it becomes
#: the older.  Chunks of more than LONG characters are not remembered.
REMEMBERED, LONG = 64 << 20, 200
#: Bytes that a remembered chunk takes besides its text and ids.
ENTRY = 200


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Tables built from one vocabulary, and the codec."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        usable = [not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)) for i in range(size)]
        self.unk = lib.unk_id()
        self.bytes = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        merged = {names[i]: i for i in range(size) if usable[i]}
        # symbols: usable pieces have their own ids; any other character is `size` + its code point
        symbol = lambda s: merged.get(s, size + ord(s) if len(s) == 1 else -1)
        self.size = size
        chars = np.arange(0x110000, dtype=np.int64) + size
        for s, i in merged.items():
            if len(s) == 1:
                chars[ord(s)] = i
        self.chars = chars
        scores = {i: lib.get_score(i) for s, i in merged.items() if len(s) > 1}
        order = {x: r for r, x in enumerate(sorted(set(scores.values()), reverse=True))}
        table, borders = {}, set()
        for s, i in merged.items():
            if len(s) < 2:
                continue
            for k in range(1, len(s)):
                a, b = symbol(s[:k]), symbol(s[k:])
                borders.add(ord(s[k - 1]) << _SHIFT | ord(s[k]))
                if a >= 0 and b >= 0:
                    table[a << _SHIFT | b] = (order[scores[i]], i)
        self.keys = np.array(sorted(table), np.int64)
        self.ranks = np.array([table[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([table[k][1] for k in self.keys.tolist()], np.int64)
        self.inside = np.array(sorted(borders), np.int64)
        if any("\n" in s and len(s) > 1 for s in merged):
            raise ValueError("pieces with a line break inside would be cut by _CHUNK")
        # decoding: the bytes of each id; control ids give nothing
        self.surface = [b"" if lib.is_control(i) else names[i].replace(_MARK, " ").encode() for i in range(size)]
        self.surface[self.unk] = b" \xe2\x81\x87 "
        self.byte_of = np.full(size, -1)
        self.byte_of[self.bytes[self.bytes >= 0]] = np.nonzero(self.bytes >= 0)[0]
        #: A run of marks is grouped from the left up to the longest such piece.
        self.run = max((len(s) for s in merged if set(s) == {_MARK}), default=1)
        self.run_id = merged.get(_MARK * self.run)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    # -- encoding -------------------------------------------------------------------------------

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair of symbols; _NONE where no piece results."""
        key = left << _SHIFT | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def _pairs(self, sym: np.ndarray, seg: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that begin at `places`."""
        after = np.minimum(places + 1, len(sym) - 1)
        rank, made = self._look(sym[places], sym[after])
        return np.where((after > places) & (seg[after] == seg[places]), rank, _NONE), made

    def _in_turn(self, sym: np.ndarray, seg: np.ndarray, made: np.ndarray, best: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leave out merges that stand right of one which makes a pair of the same or a better rank: that pair goes first."""
        followed = np.flatnonzero(np.append(seg[at[1:]] == seg[at[:-1]], False))
        if not len(followed):
            return at
        here, new = at[followed], made[at[followed]]
        chained = (followed > 0) & (at[np.maximum(followed - 1, 0)] == here - 2)
        left = np.where(chained, made[at[np.maximum(followed - 1, 0)]], sym[np.maximum(here - 1, 0)])
        same = (here > 0) & (seg[np.maximum(here - 1, 0)] == seg[here])
        ranks = np.where(same, self._look(left, new)[0], _NONE)
        after = np.minimum(here + 2, len(sym) - 1)
        same = (here + 2 < len(sym)) & (seg[after] == seg[here])
        ranks = np.minimum(ranks, np.where(same, self._look(new, sym[after])[0], _NONE))
        urgent = np.zeros(len(at), np.int64)
        urgent[followed] = ranks <= best[here]
        first = np.append(True, seg[at[1:]] != seg[at[:-1]])
        seen = np.cumsum(urgent) - urgent
        return at[seen == np.maximum.accumulate(np.where(first, seen, 0))]

    def _rounds(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge within segments (sorted labels) as the library's queue does: best score first, then leftmost."""
        done_sym, done_seg = [], []
        rank, made = self._pairs(sym, seg, np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            live = best != _NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_seg.append(seg[~live])
                sym, seg, rank, made, best = (x[live] for x in (sym, seg, rank, made, best))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            if len(at) > 1:
                # of neighbouring hits every second one merges, from the left
                fresh = np.append(True, (np.diff(at) != 1) | (seg[at[1:]] != seg[at[:-1]]))
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
                at = self._in_turn(sym, seg, made, best, at)
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            now = at - np.arange(1, len(at) + 1) + 1  # places after compaction
            sym, seg, rank, made = sym[stay], seg[stay], rank[stay], made[stay]
            for places in (now, now[now > 0] - 1):
                rank[places], made[places] = self._pairs(sym, seg, places)
        if not done_sym:
            return sym, seg
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as the bytes of 32-bit integers; a blank stands for the mark."""
        if not chunks:
            return []
        ahead = np.zeros(len(chunks), np.int64)
        if self.run_id is not None and self.run > 1:
            chunks = list(chunks)
            for i, c in enumerate(chunks):
                if c.startswith(" " * (8 * self.run)):
                    blanks = len(c) - len(c.lstrip(" "))
                    ahead[i] = (blanks - 4 * self.run) // self.run
                    chunks[i] = c[ahead[i] * self.run :]
        cps = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
        cps[cps == 0x20] = ord(_MARK)
        owner = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        pair = cps[:-1] << _SHIFT | cps[1:]
        at = np.searchsorted(self.inside, pair)
        at[at == len(self.inside)] = 0
        cut = np.append(True, (owner[1:] != owner[:-1]) | (self.inside[at] != pair))
        seg = np.cumsum(cut) - 1
        seg_owner = owner[cut]
        sym, seg = self._rounds(self.chars[cps], seg)
        owner = seg_owner[seg]
        # characters outside the vocabulary become their UTF-8 bytes
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            raw = [self.bytes[list(chr(c).encode())] for c in (sym[odd] - self.size).tolist()]
            raw = [b if (b >= 0).all() and (b != self.unk).all() else np.array([self.unk]) for b in raw]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(b) for b in raw]
            where = np.repeat(sym >= self.size, times)
            sym, owner = np.repeat(sym, times), np.repeat(owner, times)
            sym[where] = np.concatenate(raw)
        ends = (4 * np.searchsorted(owner, np.arange(len(chunks)), side="right")).tolist()
        raw = sym.astype(np.int32).tobytes()
        parts = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if chunks else []
        for i in np.flatnonzero(ahead).tolist():
            parts[i] = np.full(ahead[i], self.run_id, np.int32).tobytes() + parts[i]
        return parts

    def _known(self, wanted: set[str]) -> dict[str, bytes]:
        """The ids of each chunk, remembered or new."""
        long = sorted(c for c in wanted if len(c) > LONG)
        wanted = wanted.difference(long)
        new = wanted.difference(self.memory)
        if self.held > REMEMBERED:
            self.older, self.memory, self.held, new = self.memory, {}, 0, wanted
        known = new.intersection(self.older)
        fresh = sorted(new.difference(known))
        added = {c: self.older[c] for c in known} | dict(zip(fresh, self.encode_chunks(fresh), strict=True))
        self.memory |= added
        self.held += sum(ENTRY + len(c) + len(ids) for c, ids in added.items())
        return self.memory | dict(zip(long, self.encode_chunks(long), strict=True)) if long else self.memory

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of ids of each text."""
        split = [_CHUNK.findall((" " + t).replace(_MARK, " ")) if t else [] for t in texts]
        get = self._known(set().union(*split)).__getitem__
        raw = [b"".join(map(get, chunks)) for chunks in split]
        return np.frombuffer(b"".join(raw), np.int32), np.array([len(r) // 4 for r in raw], np.int64)

    # -- decoding -------------------------------------------------------------------------------

    def decode(self, flat: np.ndarray, lens: np.ndarray) -> list[str]:
        """Texts of runs of ids: distinct ids give their bytes, a gather joins them; the first blank goes."""
        flat = flat.astype(np.int64)
        if len(flat) and ((flat < 0) | (flat >= self.size)).any():
            raise ValueError("id outside the vocabulary")
        if not hasattr(self, "_spans"):
            sizes = np.array([1 if self.byte_of[i] >= 0 else len(s) for i, s in enumerate(self.surface)])
            pool = b"".join(bytes([self.byte_of[i]]) if self.byte_of[i] >= 0 else s for i, s in enumerate(self.surface))
            self._spans = np.cumsum(sizes) - sizes, sizes, np.frombuffer(pool, np.uint8)
        begin, sizes, pool = self._spans
        n = sizes[flat]
        ends = np.cumsum(n)
        where = np.repeat(begin[flat] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        out = pool[where].tobytes()
        edges = np.append(0, ends)[np.append(0, np.cumsum(lens))].tolist()
        texts = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            raw = out[a:b]
            texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", errors="replace"))
        return texts


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One codec for each worker process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, text: str = "text", path: str | None = None, decoded: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add `ids` (array of int), and `decoded`, the text that these ids give, if asked for."""
    path = model_path(path)

    def make():
        codec = pieces(path)

        def work(texts: list[str]) -> dict:
            flat, lens = codec.encode(texts)
            ends = pa.array(np.append(0, np.cumsum(lens)).astype(np.int32))
            out = {"ids": pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))}
            return out | ({"decoded": codec.decode(flat, lens)} if decoded else {})

        return work

    added = T.StructType(ENCODED.fields + (DECODED.fields if decoded else []))
    return map_texts(docs, text, added, make, keep)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add `decoded`: the text of the array of ids in column `ids`; null gives the empty text."""
    path = model_path(path)
    kept = [n for n in rows.columns if n.lower() != "decoded"]
    out = T.StructType([rows.schema[n] for n in kept] + DECODED.fields)

    def run(batches):
        codec = pieces(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lists = [v or [] for v in part.column("__ids__").to_pylist()]
                flat = np.array([i for v in lists for i in v], np.int64)
                texts = codec.decode(flat, np.array([len(v) for v in lists], np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return rows.select(*[F.col(f"`{n}`") for n in kept], F.col(f"`{ids}`").alias("__ids__")).mapInArrow(run, out)


def contract(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = encode(docs.select("doc_id", "text"), path=path, decoded=True, keep=["doc_id"])
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
