"""Text to SentencePiece ids and back, by vectorised merge rounds.

The model file is read here; its library is not used. A text becomes code points with
blanks as U+2581 and one more of them in front. It is cut into words: no piece holds the
two code points on both sides of a cut, so no merge can cross it. The different words of
some megabytes of text lie end to end in flat numpy arrays. Each round looks up the rank
of every pair of neighbours and finds the smallest rank of each word. Its pairs are
merged, leftmost first: all of them where no merge of the new piece could come before
the others, else the leftmost one only. The arrays are compacted, and words without a
pair leave, until none is left. Symbols that are no piece become byte ids.

The rounds of a word grow with its length where merges go one at a time, so words of
more than ``LONG`` code points (text without blanks and rare pairs) are merged with a
heap in the same order instead.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.words import text_slices

SPACE = "▁"
# fixed values: piece kinds of the model format
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SLICE, LONG = 4 << 20, 4_096
NO_RANK = np.int32(2**31 - 1)
UNKNOWN_TEXT = " ⁇ "


def _number(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(raw):
        key, at = _number(raw, at)
        if key & 7 == 0:
            value, at = _number(raw, at)
        else:
            size, at = _number(raw, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Pieces:
    """Pieces, scores and kinds of a byte pair model with byte fallback, and tables made of them."""

    names: list[str]
    scores: list[float]
    kinds: list[int]

    @staticmethod
    def read(path: str) -> Pieces:
        """The model of a file; models that change the text in other ways than blanks are refused."""
        with open(path, "rb") as file:
            raw = file.read()
        found, trainer, rules = [], {}, {}
        for field, value in _fields(raw):
            if field == 1:
                found.append(dict(_fields(value)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                rules = dict(_fields(value))
        fine = trainer.get(3) == 2 and trainer.get(35) and not trainer.get(24)  # byte pairs, byte fallback, blanks in front
        fine = fine and not rules.get(2) and rules.get(3, 1) and not rules.get(4, 1) and rules.get(5, 1)
        kinds = [p.get(3, NORMAL) for p in found]
        if not fine or USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError(f"{path}: only byte pair models with byte fallback, no text rules and no own pieces")
        return Pieces([p[1].decode() for p in found], [struct.unpack("<f", p.get(2, b"\0" * 4))[0] for p in found], kinds)

    @cached_property
    def symbols(self) -> dict[str, int]:
        """Piece ids, and further numbers for code points that occur in pieces only."""
        out = {name: i for i, (name, kind) in enumerate(zip(self.names, self.kinds, strict=True)) if kind == NORMAL}
        for c in sorted({c for name in out for c in name} - set(out)):
            out[c] = len(self.names) + len(out)
        return out

    @cached_property
    def size(self) -> int:
        return max(self.symbols.values(), default=0) + 1

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted pair keys, the piece each makes and its rank; equal scores share a rank."""
        order = {s: i for i, s in enumerate(sorted({s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL}, reverse=True))}
        rows = []
        for name, into in self.symbols.items():
            if into < len(self.names):
                for cut in range(1, len(name)):
                    left, right = self.symbols.get(name[:cut]), self.symbols.get(name[cut:])
                    if left is not None and right is not None:
                        rows.append((left * self.size + right, into, order[self.scores[into]]))
        rows.sort()
        keys, into, rank = np.array(rows, np.int64).reshape(-1, 3).T
        return keys, into.astype(np.int32), rank.astype(np.int32)

    @cached_property
    def unsafe(self) -> np.ndarray:
        """Whether a symbol may go on to a merge that comes no later than the one that made it."""
        keys, into, rank = self.pairs
        own = np.full(self.size, -1, np.int64)
        own[into] = rank
        out = np.zeros(self.size, bool)
        for part in (keys // self.size, keys % self.size):
            out[part[rank <= own[part]]] = True
        return out

    @cached_property
    def by_point(self) -> np.ndarray:
        out = np.full(0x110000, -1, np.int32)
        for name, i in self.symbols.items():
            if len(name) == 1:
                out[ord(name)] = i
        return out

    @cached_property
    def joined(self) -> np.ndarray:
        """Sorted keys of neighbouring code points that some piece holds."""
        keys = {(ord(a) << 21) + ord(b) for name in self.symbols for a, b in zip(name, name[1:], strict=False)}
        return np.array(sorted(keys), np.int64)

    @cached_property
    def words_end_at_blanks(self) -> bool:
        """Whether no piece goes on with a blank after another code point."""
        last = ord(SPACE)
        return not any(k & 0x1FFFFF == last and k >> 21 != last for k in self.joined.tolist())

    @cached_property
    def byte_ids(self) -> np.ndarray:
        out = np.zeros(256, np.int32)
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                out[int(self.names[i][3:5], 16)] = i
        return out

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """What each id stands for in a text: bytes end to end, and where each id's begin. The last one is unknown."""
        texts = []
        for name, kind in zip([*self.names, ""], [*self.kinds, UNKNOWN], strict=True):
            if kind == BYTE:
                texts.append(bytes([int(name[3:5], 16)]))
            else:
                texts.append({CONTROL: "", UNKNOWN: UNKNOWN_TEXT}.get(kind, name.replace(SPACE, " ")).encode())
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def __getstate__(self):
        return {"names": self.names, "scores": self.scores, "kinds": self.kinds}


def pair_facts(left: np.ndarray, right: np.ndarray, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Rank of and piece made by each pair; ``NO_RANK`` where it makes none."""
    keys, into, rank = model.pairs
    if not len(keys):
        return np.full(len(left), NO_RANK), np.zeros(len(left), np.int32)
    key = left.astype(np.int64) * model.size + right
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = (keys[at] == key) & (left >= 0) & (right >= 0)
    return np.where(hit, rank[at], NO_RANK), into[at]


def merge_rounds(symbol: np.ndarray, word: np.ndarray, model: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, word, first place) of what is left of flat words when no pair can be merged."""
    place, done = np.arange(len(symbol)), []
    while len(symbol):
        rank, into = np.full(len(symbol), NO_RANK), np.zeros(len(symbol), np.int32)
        rank[:-1], into[:-1] = pair_facts(symbol[:-1], symbol[1:], model)
        head = np.concatenate([[True], word[1:] != word[:-1]])
        rank[:-1][head[1:]] = NO_RANK
        starts = np.flatnonzero(head)
        best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(word)))
        over = best == NO_RANK
        if over.any():
            done.append((symbol[over], word[over], place[over]))
            symbol, word, place, rank, into, best = (x[~over] for x in (symbol, word, place, rank, into, best))
            if not len(symbol):
                break
        at = np.flatnonzero(rank == best)
        first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        one = np.logical_or.reduceat(model.unsafe[into[at]], np.flatnonzero(first))[np.cumsum(first) - 1]
        # of pairs that overlap in a row, every other one
        run = first | np.concatenate([[True], at[1:] != at[:-1] + 1])
        count = np.arange(len(at))
        even = (count - np.maximum.accumulate(np.where(run, count, 0))) % 2 == 0
        at = at[np.where(one, first, even)]
        symbol[at] = into[at]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol, word, place = symbol[keep], word[keep], place[keep]
    if not done:
        return symbol, word, place
    symbol, word, place = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(place)
    return symbol[order], word[order], place[order]


def merge_by_heap(symbol: np.ndarray, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, first place) of one word, merged pair by pair; for long words."""
    symbols, n = symbol.tolist(), len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    keys, into, rank = model.pairs
    rank, made = pair_facts(symbol[:-1], symbol[1:], model)
    heap = [(r, i, a, b, m) for i, (r, a, b, m) in enumerate(zip(rank.tolist(), symbols, symbols[1:], made.tolist(), strict=False)) if r != NO_RANK]
    heapq.heapify(heap)
    table = dict(zip(keys.tolist(), zip(model.pairs[2].tolist(), into.tolist(), strict=True), strict=True))

    def push(i, j):
        a, b = symbols[i], symbols[j]
        if a >= 0 and b >= 0 and (found := table.get(a * model.size + b)):
            heapq.heappush(heap, (found[0], i, a, b, found[1]))

    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has been merged since
        symbols[i], symbols[j], after[i] = m, None, after[j]
        if after[j] < n:
            before[after[j]] = i
            push(i, after[j])
        if before[i] >= 0:
            push(before[i], i)
    left = [i for i in range(n) if symbols[i] is not None]
    return np.array([symbols[i] for i in left], np.int32), np.array(left)


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``flat`` end to end, and where each ends."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin - ends + size, size) + np.arange(total)], ends


def encode_words(found: list[str], model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words end to end, and how many each has."""
    points = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in found], np.int64)
    if not len(points):
        return np.empty(0, np.int32), sizes
    symbol = model.by_point[points]
    owner = np.repeat(np.arange(len(found)), sizes)
    # shorter words yet: cuts where no piece holds both sides
    key = (points[:-1] << 21) + points[1:]
    at = np.minimum(np.searchsorted(model.joined, key), max(len(model.joined) - 1, 0))
    cut = np.concatenate([[True], (owner[1:] != owner[:-1]) | (model.joined[at] != key if len(model.joined) else True)])
    word = np.cumsum(cut) - 1
    length = np.bincount(word)
    long = np.flatnonzero(length > LONG)
    short = ~np.isin(word, long)
    places = np.flatnonzero(short)
    symbols, _, first = merge_rounds(symbol[short], word[short], model)
    parts = [(symbols, places[first])]
    starts = np.cumsum(length) - length
    for w in long:
        one, where = merge_by_heap(symbol[starts[w] : starts[w] + length[w]], model)
        parts.append((one, where + starts[w]))
    symbols, first = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(first)
    symbols, first = symbols[order], first[order]
    # symbols that are no piece stand for the bytes of their code point
    raw = (symbols < 0) | (symbols >= len(model.names))
    point = points[first]
    width = np.where(raw, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
    ids = np.repeat(symbols, width)
    if raw.any():
        text = "".join(map(chr, point[raw].tolist())).encode()
        ids[np.repeat(raw, width)] = model.byte_ids[np.frombuffer(text, np.uint8)]
    return ids.astype(np.int32), np.bincount(owner[first], width, len(found)).astype(np.int64)


def words_of(text: str, model: Pieces) -> list[str]:
    """The words of a text, blanks replaced and one put in front; an empty text has none."""
    if not text:
        return []
    text = SPACE + text.replace(" ", SPACE)
    return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text) if model.words_end_at_blanks else [text]


def encode(texts: list[str | None], model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, and where each text's end."""
    codes: dict[str, int] = {}
    place, order, counts = codes.setdefault, [], []
    for text in texts:
        found = words_of(text or "", model)
        counts.append(len(found))
        order += [place(w, len(codes)) for w in found]
    ids, size = encode_words(list(codes), model)
    order, words_end = np.array(order, np.int64), np.cumsum(counts)
    flat, ends = gather(ids, (np.cumsum(size) - size)[order], size[order])
    return flat, np.concatenate([[0], ends])[words_end] if len(texts) else ends


def _bytes_to_text(raw: bytes) -> str:
    """Code points of a run of byte ids; a byte that starts none is U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        try:
            out.append(raw[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


def decode(ids: np.ndarray, ends: np.ndarray, model: Pieces) -> list[str]:
    """The texts of flat ids, of which ``ends`` are the texts' ends."""
    flat, begin = model.spelled
    kinds = np.array([*model.kinds, UNKNOWN])
    ids = np.where((ids >= 0) & (ids < len(model.names)), ids, len(model.names))
    gathered, upto = gather(flat, begin[ids], begin[ids + 1] - begin[ids])
    upto = np.concatenate([[0], upto])
    cut = np.concatenate([[0], np.cumsum(kinds[ids] == CONTROL)])
    out, start = [], 0
    for end in ends.tolist():
        first = start
        while first < end and kinds[ids[first]] == CONTROL:
            first += 1
        # the blank that was put in front goes
        drop = first < end and kinds[ids[first]] == NORMAL and model.names[ids[first]].startswith(SPACE)
        raw = gathered[upto[start] + drop : upto[end]].tobytes()
        try:
            if cut[end] > cut[start]:  # bytes on both sides of a mark are not one code point
                raise ValueError
            out.append(raw.decode())
        except ValueError:
            parts, is_byte = [], kinds[ids[start:end]] == BYTE
            for run in np.split(np.arange(start, end), np.flatnonzero(is_byte[1:] != is_byte[:-1]) + 1):
                piece = gathered[upto[run[0]] + (drop and run[0] <= first <= run[-1]) : upto[run[-1] + 1]].tobytes()
                parts.append(_bytes_to_text(piece) if is_byte[run[0] - start] else piece.decode())
            out.append("".join(parts))
        start = end
    return out


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): a row for each row of ``docs``, ids of the whole text in the model at ``path``.

    No ids mark begin or end. A null or empty text has no ids; a null id stays null;
    repeated rows each have their row; an empty table gives none. Other columns are
    not read, so their names may be any. The file is read by the driver alone.
    """
    model = Pieces.read(path)

    def run(batches):
        for part in text_slices(batches, SLICE):
            if part.num_rows:
                flat, ends = encode(part["text"].to_pylist(), model)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays([part["id"], pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``tokens`` and ``decoded``, the text of its ids.

    Null ids and an empty list give an empty text; a null inside a list and a number
    that is no id are unknown. A column named ``decoded`` is replaced.
    """
    model = Pieces.read(path)
    kept = [c for c in tokens.columns if c != "decoded"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch[kept.index(ids_col)]
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, start, first = np.cumsum(counts.astype(np.int64)), 0, 0
            while start < batch.num_rows:  # some millions of ids at a time
                stop = max(start + 1, int(np.searchsorted(ends, first + SLICE, "right")))
                texts = decode(flat[first : ends[stop - 1]], ends[start:stop] - first, model)
                columns = [batch[i].slice(start, stop - start) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*kept, "decoded"])
                first, start = ends[stop - 1], stop

    schema = tokens.select(*(F.col(f"`{c}`") for c in kept), F.lit("").alias("decoded")).schema
    # by number, as mapInArrow cannot look up names with dots
    numbered = tokens.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    return numbered.mapInArrow(run, schema)
