"""SentencePiece BPE encoding and decoding by suffix-array matching.

The distinct chunks of a batch of text (a chunk ends where no piece can go on) are concatenated and indexed by a suffix array. A binary search for
every piece gives its range of occurrences there; the occurrences are edges over the text, sorted by the position where they end. Relaxing goes over positions
in order: of the edges that end at a position, exactly one is the last piece of the BPE encoding of the text so far, namely the one
that is compatible with the piece before it. Two pieces are compatible if no merge across their border would have come before the merges that made them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import FAMILIES, U64, append_columns, bytes_of, slices, trim

SPACE = "▁"
#: What stands between chunks in an indexed text: no character.
BETWEEN = 0x110000
#: Distinct chunks that a worker remembers, and bytes of text that it takes at a time.
REMEMBERED, PART = 150_000, 2 << 20


class Pieces:
    """A SentencePiece BPE model with byte fallback and identity normalisation, in arrays by rank: 0 unknown character, then characters, then merges."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto.FromString(model)
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in m.pieces):
            raise ValueError("only BPE models with byte fallback, identity normalisation, a dummy prefix and no user-defined pieces are supported")
        self.text = [p.piece for p in m.pieces]
        self.kind = [p.type for p in m.pieces]
        self.bytes = np.full(256, -1, dtype=np.int32)
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[1:-1], 16)] = i
        normal = [(p.piece, p.score, i) for i, p in enumerate(m.pieces) if p.type == 1]
        single = [x for x in normal if len(x[0]) == 1]
        merged = sorted((x for x in normal if len(x[0]) > 1), key=lambda x: (-x[1], x[2]))
        ranked = [*single, *merged]
        self.n = len(ranked) + 1
        self.atoms = len(single) + 1
        self.id = np.array([-1, *(x[2] for x in ranked)], dtype=np.int32)
        self.rank = {x[0]: r for r, x in enumerate(ranked, 1)}
        self.score = {x[0]: x[1] for x in ranked}
        self.length = np.array([1, *(len(x[0]) for x in ranked)], dtype=np.int64)
        self.left, self.right = np.arange(self.n), np.arange(self.n)
        pairs = {}
        for r, (piece, _, _) in enumerate(ranked, 1):
            for i in range(1, len(piece)):
                a, b = self.rank.get(piece[:i]), self.rank.get(piece[i:])
                if a and b:
                    pairs[a * self.n + b] = r
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_values = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int64)
        #: pieces that no merging reaches; pieces that a part of lower priority makes, whose chunks are merged step by step
        self.dead, self.odd = np.zeros(self.n, dtype=bool), np.zeros(self.n, dtype=bool)
        for r, (piece, _, _) in enumerate(ranked, 1):
            if len(piece) > 1:
                parts, last = self.merge(piece)
                if len(parts) > 1:
                    self.dead[r] = True
                else:
                    self.left[r], self.right[r] = (self.rank[x] for x in last)
                    self.odd[r] = max(self.left[r], self.right[r]) > r
        self.width = max(len(x) for x in self.rank)
        order = sorted(r for r in range(1, self.n) if not self.dead[r])
        self.search_rank = np.array(order, dtype=np.int64)
        self.search = np.zeros((len(order), self.width), dtype=np.int32)
        names = [x[0] for x in ranked]
        for i, r in enumerate(order):
            self.search[i, : len(names[r - 1])] = [ord(c) for c in names[r - 1]]
        #: no merge crosses two neighbouring characters that stand together in no piece, so a chunk ends between them; kept for ASCII, space included
        self.cut = np.zeros((256, 256), dtype=bool)
        self.cut[:128, :128] = True
        for x in self.rank:
            raw = x.replace(SPACE, " ").encode("latin-1", errors="replace") if x.isascii() or SPACE in x else b""
            for a, b in zip(raw, raw[1:]):
                if a < 128 and b < 128:
                    self.cut[a, b] = False
        self.cut[128:, 32] = not any(not u.isascii() and u != SPACE and v == SPACE for x in self.rank for u, v in zip(x, x[1:]))
        del self.score

    def merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """BPE of a text of characters, merge by merge; and the two parts of the last merge."""
        score = getattr(self, "score", None)
        key = (lambda s: -score[s]) if score else (lambda s: self.rank[s])
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(parts) and (both := parts[i] + parts[j]) in self.rank:
                heapq.heappush(heap, (key(both), i, both))

        for i in range(len(parts)):
            offer(i)
        last = ("", "")
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != both:
                continue
            last = (parts[i], parts[j])
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in parts if x is not None], last

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of the text of a and b is a, b; for arrays of ranks."""
        out = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), self.n, dtype=np.int64)
        at = np.arange(len(a))
        while len(at):
            key = a * self.n + b
            where = np.searchsorted(self.pair_keys, key)
            where[where == len(self.pair_keys)] = 0
            clash = (self.pair_keys[where] == key) & (self.pair_values[where] < limit)
            out[at[clash]] = False
            # undo the later of the two merges: the parts at the border were neighbours just before it
            first = a > b
            ra, lb = self.right[a], self.left[b]
            fixed_a, fixed_b = a < self.atoms, b < self.atoms
            done = clash | (fixed_a & fixed_b)
            use_a = np.where(first, ~fixed_a, fixed_b)
            limit = np.where(use_a, a, b + 1)
            a, b = np.where(use_a, ra, a), np.where(use_a, b, lb)
            go = ~done
            a, b, limit, at = a[go], b[go], limit[go], at[go]
        return out

    def suffix_array(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """Order of the suffixes by their first `width` characters: as many characters as fit into a word of 64 bits, then doubling.

        With it these words in order, the characters there are, and how many bits a character and how many characters a word has.
        """
        letters, code = np.unique(text, return_inverse=True)
        bits = max(1, int(len(letters)).bit_length())
        step = min(64 // bits, self.width)
        padded = np.concatenate([code.astype(U64) + U64(1), np.zeros(step, dtype=U64)])
        key = np.zeros(len(text), dtype=U64)
        for i in range(step):
            key = (key << U64(bits)) | padded[i : i + len(text)]
        head, fits = key, step
        while step < self.width:
            order = np.argsort(key)
            new = np.ones(len(key), dtype=np.int64)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(len(key), dtype=np.int64)
            rank[order] = np.cumsum(new)
            after = np.zeros(len(rank), dtype=np.int64)
            after[:-step] = rank[step:]
            key = (rank.astype(U64) << U64(32)) | after.astype(U64)
            step *= 2
        order = np.argsort(key)
        return order, head[order], letters, bits, fits

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, rank) of every piece at every place of text, by binary search in its suffix array. text: code points, BETWEEN between chunks."""
        sa, head, letters, bits, fits = self.suffix_array(text)
        present = np.zeros(BETWEEN + 1, dtype=bool)
        present[text] = True
        present[0] = True
        able = present[self.search].all(axis=1)
        search, rank = self.search[able], self.search_rank[able]
        if not len(sa) or not len(search):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        length = self.length[rank]
        # the words of 64 bits that begin with a piece, or with as much of it as fits
        code = np.where(search > 0, np.searchsorted(letters, search) + 1, 0).astype(U64)
        least = np.zeros(len(search), dtype=U64)
        for i in range(fits):
            least = (least << U64(bits)) | code[:, i]
        most = least | ((U64(1) << (np.maximum(fits - length, 0) * bits).astype(U64)) - U64(1))
        lo, hi = np.searchsorted(head, least, side="left"), np.searchsorted(head, most, side="right")
        # longer pieces go on, character by character, inside the range of their beginning
        long = np.flatnonzero((length > fits) & (lo < hi))
        if len(long):
            padded = np.concatenate([text, np.zeros(self.width, dtype=text.dtype)])
            columns = np.arange(self.width)

            def bound(upper: bool) -> np.ndarray:
                a, b = lo[long].copy(), hi[long].copy()
                while (open_ := a < b).any():
                    mid = (a + b) // 2
                    there = padded[sa[np.minimum(mid, len(sa) - 1)][:, None] + columns]
                    there = np.where(columns < length[long, None], there, 0)
                    differ = there != search[long]
                    at = differ.argmax(axis=1)
                    row = np.arange(len(long))
                    less = np.where(differ[row, at], there[row, at] < search[long][row, at], upper)
                    a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
                return a

            lo[long], hi[long] = bound(False), bound(True)
        n = hi - lo
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return sa[np.repeat(lo, n) + inside], np.repeat(rank, n)

    def encode_chunks(self, chunks: list[str], limit: int = 120_000) -> list[np.ndarray]:
        """Ids of each chunk; spaces are written as SPACE already. About limit characters are indexed at a time; a longer chunk stands alone."""
        out, lo = [], 0
        ends = np.cumsum(np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)) + 1)
        while lo < len(chunks):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
            out += self._encode_chunks(chunks[lo:hi])
            lo = hi
        return out

    def _encode_chunks(self, chunks: list[str]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = np.frombuffer("\n".join(chunks).encode("utf-32-le"), dtype=np.uint32).astype(np.int32)
        text[begin[1:] - 1] = BETWEEN
        position, rank = self.occurrences(text)
        of_chunk = np.repeat(np.arange(len(chunks)), np.append(sizes[:-1] + 1, sizes[-1]))
        odd = np.zeros(len(chunks), dtype=bool)
        odd[of_chunk[position[self.odd[rank]]]] = True
        # a character that is no piece is an edge of its own
        known = np.zeros(len(text), dtype=bool)
        known[position[self.length[rank] == 1]] = True
        other = np.flatnonzero(~known & (text != BETWEEN))
        position, rank = np.concatenate([position, other]), np.concatenate([rank, np.zeros(len(other), dtype=np.int64)])
        length = self.length[rank]
        # edges by the position where they end, longest first: one sort of packed words
        edges = np.sort(((position + length) << 28) | ((255 - np.minimum(length, 255)) << 20) | rank)
        rank = edges & ((1 << 20) - 1)
        length = self.length[rank]
        first = np.zeros(len(text) + 3, dtype=np.int64)
        np.cumsum(np.bincount(edges >> 28, minlength=len(text) + 2), out=first[1:])
        del edges, position
        last = np.zeros(len(text) + 2, dtype=np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        sorted_sizes = -sizes[by_size]
        for p in range(1, int(sizes.max(initial=0)) + 1):
            active = by_size[: np.searchsorted(sorted_sizes, -p, side="right")]
            active = active[~odd[active]]
            at, start = begin[active] + p, begin[active]
            edge = first[at].copy()
            todo = np.arange(len(active))
            while len(todo):
                r, back = rank[edge[todo]], at[todo] - length[edge[todo]]
                fine = back == start[todo]
                check = np.flatnonzero(~fine)
                if len(check):
                    fine[check] = self.compatible(last[back[check]], r[check])
                last[at[todo[fine]]] = r[fine]
                todo = todo[~fine]
                edge[todo] += 1
        # walk back from the ends of all chunks at once
        at, who = (begin + sizes)[~odd], np.flatnonzero(~odd)
        owners, ranks, places = [], [], []
        while len(at):
            more = at > begin[who]
            at, who = at[more], who[more]
            r = last[at]
            at = at - self.length[r]
            owners.append(who)
            ranks.append(r)
            places.append(at)
        out: list = [None] * len(chunks)
        if owners:
            who, r, place = np.concatenate(owners), np.concatenate(ranks), np.concatenate(places)
            order = np.lexsort((place, who))
            who, ids, place = who[order], self.id[r[order]], place[order]
            edges = np.searchsorted(who, np.arange(len(chunks) + 1))
            fallback = np.zeros(len(chunks), dtype=bool)
            fallback[who[ids < 0]] = True
            for i in range(len(chunks)):
                mine = ids[edges[i] : edges[i + 1]]
                if fallback[i]:
                    mine = np.concatenate([self.bytes[np.frombuffer(chr(text[q]).encode(), dtype=np.uint8)] if x < 0 else np.array([x], dtype=np.int32) for x, q in zip(mine, place[edges[i] : edges[i + 1]])])
                out[i] = mine
        for i in np.flatnonzero(odd).tolist():
            parts, _ = self.merge(chunks[i])
            out[i] = np.concatenate([np.array([self.id[self.rank[x]]], dtype=np.int32) if x in self.rank else self.bytes[np.frombuffer(x.encode(), dtype=np.uint8)] for x in parts])
        return [x if x is not None else np.zeros(0, dtype=np.int32) for x in out]

    @staticmethod
    def tokens(model: bytes) -> tuple[list[bytes], list[int]]:
        """What each id stands for in a decoded text, and its type."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        text = {2: lambda p: " \u2047 ".encode(), 3: lambda p: b"", 6: lambda p: bytes([int(p[1:-1], 16)])}
        pieces = proto.ModelProto.FromString(model).pieces
        return [text.get(p.type, lambda x: x.replace(SPACE, " ").encode())(p.piece) for p in pieces], [p.type for p in pieces]


def decode_ids(token: list[bytes], kind: list[int], ids: list[int]) -> str:
    """The text of ids, without the dummy prefix; a run of byte pieces that is no UTF-8 becomes U+FFFD, byte by byte where it is broken."""
    raw = b"".join(map(token.__getitem__, ids))
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        out, held = [], bytearray()
        for i in ids:
            if kind[i] == 6:
                held += token[i]
            else:
                out += [held.decode(errors="replace"), token[i].decode()]
                held = bytearray()
        text = "".join([*out, held.decode(errors="replace")])
    return text[1:] if ids and kind[ids[0]] == 1 and text.startswith(" ") else text


class Encoder:
    """Encodes columns of text with a memory of chunks."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each row's first id (n + 1 values). A row without bytes has no ids."""
        raw = data[offsets[0] : offsets[-1]].tobytes() if len(offsets) else b""
        offsets = offsets - offsets[0]
        mark = SPACE.encode()
        if mark in raw:
            rows = [raw[a:b].replace(mark, b" ") for a, b in zip(offsets[:-1], offsets[1:])]
            raw, offsets = b"".join(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        # the dummy prefix: one space before each row that has text
        full = offsets[1:] > offsets[:-1]
        stream = np.insert(np.frombuffer(raw, dtype=np.uint8), offsets[:-1][full], 32)
        heads = offsets + np.concatenate([[0], np.cumsum(full)])
        if not len(stream):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        cutat = np.zeros(len(stream), dtype=bool)
        cutat[1:] = self.pieces.cut[stream[:-1], stream[1:]]
        cutat[heads[:-1][full]] = True
        starts = np.flatnonzero(cutat)
        ends = np.append(starts[1:], len(stream))
        pair = []
        for f in FAMILIES:
            got = np.empty(len(starts), dtype=U64)
            i = 0
            while i < len(starts):
                j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 20), side="right")))
                got[i:j] = f.spans(f.byte[stream[starts[i] : ends[j - 1]]], starts[i:j] - starts[i], ends[i:j] - starts[i])
                i = j
            pair.append(got)
        keys, at, which = np.unique(pair[0], return_index=True, return_inverse=True)
        if (pair[1] != pair[1][at][which]).any():
            # two chunks share a 64-bit hash: tell them apart by 128 bits
            keys, at, which = np.unique(np.stack(pair, axis=1), axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
        flat = stream.tobytes()
        chunks = [flat[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        new = [c for c in chunks if c not in self.known]
        for c, ids in zip(new, self.pieces.encode_chunks([c.decode(errors="replace").replace(" ", SPACE) for c in new])):
            self.known[c] = ids.tobytes()
        found = [self.known[c] for c in chunks]
        if len(self.known) > REMEMBERED:
            # the oldest go first: frequent chunks came early and come back with the next part
            self.known = dict(list(self.known.items())[: REMEMBERED // 2])
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        pool, place = np.frombuffer(b"".join(found), dtype=np.int32), np.cumsum(sizes) - sizes
        n = sizes[which]
        total = np.cumsum(n)
        ids = pool[np.repeat(place[which] - (total - n), n) + np.arange(int(total[-1]))]
        before = np.concatenate([[0], total])
        return ids, before[np.searchsorted(starts, heads)]


def _shared(spark, model: str):
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast(Pieces(f.read()))


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with a column piece_ids array<int>: the ids that the SentencePiece model file gives to each whole text.

    Null and empty texts have no ids. Long texts are encoded whole, in steps that grow with the longest chunk that no piece spans. Repeated rows are encoded alike. Other columns are kept (or those in keep); one named piece_ids is
    replaced. Empty table: empty result. A literal U+2581 counts as a space, as the library has it.
    """
    shared = _shared(docs.sparkSession, model)
    made: dict[str, Encoder] = {}

    def run(column: pa.Array) -> list[pa.Array]:
        enc = made.setdefault("it", None) or made.__setitem__("it", Encoder(shared.value)) or made["it"]
        data, at = bytes_of(column)
        ids, firsts, base = [], [np.zeros(1, dtype=np.int64)], 0
        for lo, hi in slices(at, PART):
            x, first = enc.encode(data, at[lo : hi + 1])
            ids.append(x)
            firsts.append(first[1:] + base)
            base += len(x)
        return [pa.ListArray.from_arrays(pa.array(np.concatenate(firsts), pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))]

    return append_columns(docs, text_col, "piece_ids array<int>", run, keep)


def decode_pieces(encoded: DataFrame, model: str, ids_col: str = "piece_ids", out_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """encoded with a column of the text of each row's ids. Null ids: null text; no ids: empty text. Ids outside the vocabulary are an error."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType, StructType

    with open(model, "rb") as f:
        pieces = Pieces.tokens(f.read())
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    kept = [c for c in (encoded.columns if keep is None else keep) if c != out_col]
    schema = StructType([*(encoded.schema[c] for c in kept)]).add(out_col, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, kind = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                ids = batch.column(len(kept))
                out = [decode_ids(token, kind, x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in ids]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.string())], names=schema.names)
        trim()

    given = encoded.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{ids_col}`").alias("__ids"))
    return given.mapInArrow(run, schema)
