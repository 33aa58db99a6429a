"""SentencePiece encoding and decoding for merge-type vocabularies, checked against the library."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recordlab.session import ship

from ._worker import give_back, giving_back, kept

#: Segments that a worker remembers, longest segment that is merged in a table, texts that are handled together.
REMEMBERED, LONGEST, TOGETHER = 150_000, 32, 512
#: What a remembered segment's uses still count when others are forgotten.
FADE = 0.95
NEVER = np.iinfo(np.int32).max


class Pieces:
    """Encoder of one model.  Texts fall into segments that begin with the space mark, which no piece continues over.

    A segment's agenda holds its adjacent symbol pairs whose union is a piece; the pair with the best score, the
    leftmost of several, merges, and the pairs with its neighbours enter.
    """

    def __init__(self, model: bytes):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        normal = {lib.id_to_piece(i): i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        if any("▁" in p.lstrip("▁") or "\n" in p for p in normal) or "▁" not in normal or lib.encode("a  b", out_type=str) != lib.encode("a", out_type=str) + ["▁"] + lib.encode("b", out_type=str):
            raise ValueError("only models whose pieces hold the space mark at the start and no line ends, with a dummy prefix and all spaces kept, can be used")
        self.normal, self.n, self.mark = normal, n, normal["▁"]
        self.byte = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.number, self.text = np.arange(n).astype(object), pa.array([b"%d" % i for i in range(n)], pa.large_binary())
        known = {c: normal.get(c, n + 1 + i) for i, c in enumerate(sorted({c for p in normal for c in p}))}
        self.chars = np.full(0x110000, n, np.int32)  # n: a character of no piece
        for c, i in known.items():
            self.chars[ord(c)] = i
        ranks = {s: r for r, s in enumerate(sorted({lib.get_score(i) for i in normal.values()}, reverse=True))}
        symbol = normal | known
        self.width = n + 2 + len(known)
        pairs = {symbol[p[:j]] * self.width + symbol[p[j:]]: (ranks[lib.get_score(i)], i) for p, i in normal.items() for j in range(1, len(p)) if p[:j] in symbol and p[j:] in symbol}
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.piece = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        # An open hash of the pairs: one probe finds most.
        self.bits = max(16, int(len(pairs) * 8 - 1).bit_length())
        self.slot_key, self.slot_at = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(self.keys))
        self.probes = 0
        while len(left):
            at = self._slot(self.keys[left], self.probes)
            free = self.slot_key[at] < 0
            won = np.unique(np.where(free, at, -1), return_index=True)
            took = won[1][won[0] >= 0]
            self.slot_key[at[took]], self.slot_at[at[took]] = self.keys[left[took]], left[took]
            left = np.delete(left, took)
            self.probes += 1
        # The segments remembered: place by name; by place, how much it was used and where its ids are in the pool.
        self.seen: dict[str, int] = {}
        self.used, self.start, self.pool = np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * probe * 0x51ED27)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in ``rank`` and ``piece``, or -1."""
        keys = left.astype(np.int64) * self.width + right
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        for probe in range(self.probes):
            at = self._slot(keys[todo], probe)
            held = self.slot_key[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.slot_at[at[hit]]
            todo = todo[~hit & (held >= 0)]
            if not len(todo):
                break
        return out

    def _ids(self, symbol: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols and how many each has: a character that is no piece, of these code points, has those of its bytes."""
        odd = symbol >= self.n
        many = np.ones(len(symbol), np.int64)
        if not odd.any():
            return symbol, many
        p = points[odd]
        many[odd] += (p >= 0x80).astype(np.int64) + (p >= 0x800) + (p >= 0x10000)
        ids = np.repeat(symbol, many)
        ids[np.repeat(odd, many)] = self.byte[np.frombuffer(p.tobytes().decode("utf-32-le").encode(), np.uint8)]
        return ids, many

    def merge_table(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments of similar length, one behind the other, and how many each has.

        The segments are encoded together: a row of agenda entries for each, the best taken in each round.  All tables
        are flat, one cell for a symbol and one behind each row that stands for its outside.
        """
        size = np.array([len(s) for s in segments])
        wide, rows = int(size.max()) + 1, len(segments)
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        live = (np.arange(wide)[None, :] < size[:, None]).ravel()
        inside = np.flatnonzero(live)
        symbol = np.full(rows * wide, -1, np.int32)
        symbol[inside] = self.chars[points]
        cell = np.arange(rows * wide)
        outside = np.repeat(np.arange(1, rows + 1) * wide - 1, wide)
        after = np.where(np.append(live[1:], False), cell + 1, outside)
        before = np.where(np.append(False, live[:-1]) & (cell % wide > 0), cell - 1, outside)
        agenda, target = np.full(rows * wide, NEVER, np.int32), np.zeros(rows * wide, np.int32)

        def enter(left: np.ndarray, right: np.ndarray) -> None:
            where = self._look(symbol[left], symbol[right])
            agenda[left] = np.where(where >= 0, self.rank[where], NEVER)
            target[left] = self.piece[where]

        enter(inside, after[inside])
        table, act = agenda.reshape(rows, wide), np.arange(rows)
        while len(act):
            at = act * wide + table[act].argmin(1)
            going = agenda[at] != NEVER
            act, at = act[going], at[going]
            gone = after[at]
            symbol[at], live[gone], agenda[gone] = target[at], False, NEVER
            following = after[gone]
            after[at], before[following] = following, at
            enter(np.concatenate((at, before[at])), np.concatenate((following, at)))
        live[wide - 1 :: wide] = False
        point = np.zeros(rows * wide, np.uint32)
        point[inside] = points
        left = np.flatnonzero(live)
        ids, many = self._ids(symbol[left], point[left])
        return ids, np.bincount(left // wide, many, rows).astype(np.int64)

    def merge_heap(self, segment: str) -> np.ndarray:
        """Ids of one long segment, its agenda a heap."""
        points = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol: list[int] = self.chars[points].tolist()
        n = len(symbol)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def enter(a: int, b: int) -> None:
            if found := self.pairs.get(symbol[a] * self.width + symbol[b]):
                heapq.heappush(heap, (found[0], a, symbol[a], symbol[b], found[1]))

        for a in range(n - 1):
            enter(a, a + 1)
        while heap:
            _, a, x, y, piece = heapq.heappop(heap)
            if not live[a] or symbol[a] != x or (b := after[a]) >= n or symbol[b] != y:
                continue
            symbol[a], live[b], after[a] = piece, False, after[b]
            if after[a] < n:
                before[after[a]] = a
                enter(a, after[a])
            if before[a] >= 0:
                enter(before[a], a)
        left = np.flatnonzero(live)
        return self._ids(np.array(symbol, np.int32)[left], points[left])[0]

    def checked(self, missing: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, given by increasing length, one behind the other, and how many each has, as the library's."""
        bare = [m[1:] if m[:1] == "\n" else "▁" + m for m in missing]
        short = sum(len(m) < LONGEST for m in missing)
        ids, many = map(list, zip(self.merge_table(bare[:short]), strict=True)) if short else ([], [])
        for m in bare[short:]:
            ids.append(self.merge_heap(m))
            many.append([len(ids[-1])])
        found, count = np.concatenate(ids), np.concatenate(many)
        line = np.array([m[:1] == "\n" for m in missing])
        found = np.insert(found, (np.cumsum(count) - count)[line], self.byte[10])
        count[line] += 1
        asked = self.library.encode([m.replace("▁", " ") for m in missing], num_threads=1)
        if not missing[0]:  # a mark alone, where the library has an empty text
            asked[0] = [self.mark]
        theirs = np.fromiter(chain.from_iterable(asked), np.int32)
        sizes = np.fromiter(map(len, asked), np.int64, len(asked))
        head = (np.cumsum(sizes) - sizes)[line]  # the library puts a mark before a line's end that begins a text
        if (sizes - line != count).any() or (theirs[head] != self.mark).any() or (np.delete(theirs, head) != found).any():
            for m, x, own in zip(missing, asked, np.split(found, np.cumsum(count)[:-1]), strict=True):
                if x != (own := [self.mark] * (m[:1] == "\n") + own.tolist()):
                    raise RuntimeError(f"the library encodes {m!r} as {x}, not {own}")
        return found, count

    def learn(self, missing: list[str]) -> None:
        """Encodes segments, checks them against the library, remembers them.

        A segment is named by its text without the first space mark; one that begins a line has no mark, and its name
        begins with the line's end.
        """
        missing.sort(key=len)
        ids, many = zip(*(self.checked(missing[lo : lo + 4096]) for lo in range(0, len(missing), 4096)), strict=True)
        self.seen.update(zip(missing, range(len(self.seen), len(self.seen) + len(missing)), strict=True))
        self.used = np.append(self.used, np.ones(len(missing), np.float32))
        self.start = np.append(self.start, self.start[-1] + np.cumsum(np.concatenate(many)))
        self.pool = np.concatenate((self.pool, *ids))

    def forget(self, room: int, needed: np.ndarray) -> None:
        """Keeps the segments at the places needed, and in what room they leave those that were used most of late."""
        worth = self.used.copy()
        worth[needed] = np.inf
        room = max(room, len(needed))
        if room >= len(worth):
            return
        keep = np.zeros(len(worth), bool)
        keep[np.argpartition(-worth, room)[:room]] = True
        many = np.diff(self.start)
        self.seen = dict(zip(compress(self.seen, keep.tolist()), range(room), strict=True))
        self.pool = self.pool[np.repeat(keep, many)]
        self.start = np.append(0, np.cumsum(many[keep]))
        self.used = self.used[keep] * np.float32(FADE)

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and where those of each begin, with the end of the last."""
        spaced: list[str | None] = []  # the names of a text's segments, which hold no spaces, with a space between
        for text in texts:
            if not text:
                spaced.append(None)
            elif "  " in text or "▁" in text or " \n" in text or text[0] == " " or text[-1] == " ":
                names = []
                for s in re.findall("▁+[^▁]*", "▁" + text.replace(" ", "▁")):
                    names += ["", s[1:]] if s[1:2] == "\n" else [s[1:]]
                spaced.append(" ".join(names))
            else:
                spaced.append(text.replace("\n", " \n"))
        split = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        del spaced
        bounds, segments = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        names = segments.dictionary.to_pylist()
        place = np.fromiter(map(self.seen.get, names, repeat(-1)), np.int64, len(names))
        known = place >= 0
        self.used[place[known]] += 1
        if not known.all():
            fresh = list(compress(names, (~known).tolist()))
            if len(self.seen) + len(fresh) > REMEMBERED:
                self.forget(REMEMBERED - len(fresh), place[known])
            self.learn(fresh)
            place = np.fromiter(map(self.seen.__getitem__, names), np.int64, len(names))
        del names
        each = place[segments.indices.to_numpy()]
        begin, many = self.start[each], self.start[each + 1] - self.start[each]
        ends = np.append(0, np.cumsum(many))
        at = np.repeat((begin - ends[:-1]).astype(np.int32), many)
        at += np.arange(len(at), dtype=np.int32)
        return self.pool[at], ends[bounds]

    def lists(self, ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
        ends = bounds.tolist()
        return [self.number[ids[a:b]].tolist() for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return self.lists(*self.encode_flat(texts))


def _worker(model: bytes) -> Pieces:
    return kept(("pieces", hashlib.sha256(model).digest()), lambda: Pieces(model))


def _run(model, text_at: int, digest: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _worker(model.value)
        for whole in giving_back(batches):
            for lo in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(lo, TOGETHER)
                ids, bounds = coder.encode_flat(batch.column(text_at).to_pylist())
                decoded = coder.library.decode(coder.lists(ids, bounds), num_threads=1) if batch.num_rows else []
                n = pa.array(np.diff(bounds), pa.int64())
                if digest:
                    joined = pc.binary_join(pa.LargeListArray.from_arrays(bounds, coder.text.take(pa.array(ids))), pa.scalar(b",", pa.large_binary()))
                    tail = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                else:
                    tail = [pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids)), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, n, *tail], names)
                give_back()

    return run


def encode(docs: DataFrame, model_path: str, digest: bool = False) -> DataFrame:
    """``docs`` with n_tokens (long), ids (array of int) and decoded (string) of ``text``, as the library gives them.

    With ``digest`` the last two are ids_sha256 and decoded_sha256, lowercase hex of the ids in decimal joined by
    commas and of the decoded text.  No begin or end ids.  A null or empty text has no ids and decodes to the empty
    text.  The model is read on the driver and sent to the tasks.  Other columns pass through; columns with the names
    of the results are replaced.  Rows that repeat, or have no id, are encoded one by one; an empty table gives an
    empty result.  Each segment is merged here and, when a worker first meets it, compared with the
    library's encoding within its Arrow batch; a difference is an error.
    """
    with open(model_path, "rb") as f:
        model = ship(docs.sparkSession).sparkContext.broadcast(f.read())
    tail = [("n_tokens", "long"), *([("ids_sha256", "string"), ("decoded_sha256", "string")] if digest else [("ids", T.ArrayType(T.IntegerType())), ("decoded", "string")])]
    docs = docs.drop(*[name for name, _ in tail])
    schema = T.StructType(list(docs.schema.fields))
    for name, kind in tail:
        schema = schema.add(name, kind)
    return docs.mapInArrow(_run(model, docs.columns.index("text"), digest, schema.names), schema)
