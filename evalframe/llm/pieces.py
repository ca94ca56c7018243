"""Encode texts to sentence pieces and back: a unigram Viterbi over a double-array trie.

The vocabulary file of a public tokenizer gives pieces and log scores. Spaces become the mark U+2581 and one goes before
the text; the path of pieces with the highest sum of scores wins, on equal sums the longer last piece; a character that
no piece covers falls back to its UTF-8 bytes. No piece holds a mark after another character, so a best path can be
cut before each mark that follows another character, and at characters that no piece holds. Texts are cut there, and
all chunks that a task has not seen are solved at once: the search moves over positions, in numpy, for all of them.
Where few chunks are of like length, as words of many thousand characters are, each is searched alone in linear time.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces in the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Solved chunks that a task remembers, and the characters in them.
MEMO_CHUNKS, MEMO_CHARS = 200_000, 1 << 22
#: Rows, and bytes of their texts, that a task works on at once (a longer text goes alone); cells of a search table.
ROWS, BYTES, CELLS = 256, 1 << 20, 1 << 19
#: Chunks of like length from which on they are searched together, and bytes of a single chunk whose pieces are found at once.
FEW, STRETCH = 48, 1 << 16


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, data[at : at + size]
        at += size


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id."""
    with open(path, "rb") as f:
        found = [dict(_fields(v)) for number, v in _fields(f.read()) if number == 1]
    return [(p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)) for p in found]


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value arrays of a trie over keys; value is the key's place or -1.

    The child of state s by byte c is base[s] + c + 1, if check there is s.
    """
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for place, key in enumerate(keys):
        node = 0
        for c in key:
            node = children[node].setdefault(c, len(children))
            if node == len(children):
                children.append({})
                values.append(-1)
        values[node] = place
    size = 2 * len(children) + 4096
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    value[0], used, free, wide, todo = values[0], bytearray(size), 300, 300, [(0, 0)]
    while todo:
        node, state = todo.pop()
        codes = sorted(children[node])
        if not codes:
            continue
        while used[free]:
            free += 1
        place = free if len(codes) == 1 else max(free, wide)  # of the first child
        tried = 0
        while any(used[place + c - codes[0]] for c in codes):
            place, tried = place + 1, tried + 1
        if tried > 64:  # it is crowded up to here
            wide = place
        base[state] = place - codes[0] - 1
        for c in codes:
            to = place + c - codes[0]
            used[to], check[to], value[to] = 1, state, values[children[node][c]]
            todo.append((children[node][c], to))
    return base, check, value


class Vocabulary:
    """Pieces, their trie, and what decoding needs; a few MB that go to every task."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.ids = np.array([i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER)], np.int32)
        self.base, self.check, self.value = double_array([pieces[i][0].encode() for i in self.ids])
        self.scores = np.array([pieces[i][1] for i in self.ids], np.float32)
        self.unknown_score = np.float32(self.scores.min(initial=0) - np.float32(10))
        self.byte_ids = np.array([{int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}.get(b, -1) for b in range(256)], np.int32)
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.has_bytes = bool((self.byte_ids >= 0).all())
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.encode() for p, _, kind in pieces]
        normal = [pieces[i][0] for i in self.ids]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in normal)
        self.line_cut = not any("\n" in p for p in normal)


class Encoder:
    """Piece ids of texts; remembers solved chunks up to a bound."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        end = r"\n" if vocabulary.line_cut else ""
        self.chunk = re.compile(rf" *[^ {end}]+| +" + (r"|\n" if end else "")) if vocabulary.cuts else re.compile(r"(?s).+")
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; an empty or null text has none."""
        if len(self.number) > MEMO_CHUNKS or self.chars > MEMO_CHARS:
            self.clear()
        new: list[str] = []
        number, out = self.number, []
        for text in texts:
            found = self.chunk.findall(" " + text.replace(MARK, " ")) if text else []
            for c in set(found).difference(number):
                number[c] = len(number)
                new.append(c)
            out.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        if new:
            self.chars += sum(map(len, new))
            flat, sizes = self._solve([c.replace(" ", MARK).encode() for c in new])
            self.flat = np.concatenate([self.flat, flat])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        ids = []
        for x in out:
            first, sizes = self.starts[x], self.starts[x + 1] - self.starts[x]
            shift = first - np.cumsum(sizes) + sizes
            ids.append(self.flat[np.repeat(shift, sizes) + np.arange(sizes.sum())])
        return ids

    def _solve(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after the other, and how many each has. Chunks of like length go together."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        out: list[np.ndarray | None] = [None] * len(chunks)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            reach = max(16, 2 * int(lengths[order[at]]))
            end = min(np.searchsorted(lengths[order], reach, side="right"), at + max(1, CELLS // reach))
            part = order[at:end]
            few = len(part) < FEW and int(lengths[part[0]]) > 0
            found = map(self._alone, (chunks[i] for i in part)) if few else self._viterbi([chunks[i] for i in part], lengths[part])
            for i, ids in zip(part, found, strict=True):
                out[i] = ids
            at = end
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def _alone(self, chunk: bytes) -> np.ndarray:
        """Ids of one chunk in time that grows with its length: all pieces of a stretch are found at once, then one pass over its bytes."""
        v, n = self.v, len(chunk)
        text = np.frombuffer(chunk, np.uint8).astype(np.int32)
        heads = np.select([text < 0x80, text < 0xC0, text < 0xE0, text < 0xF0], [1, 0, 2, 3], 4)
        unknown, no = float(v.unknown_score), -math.inf
        best, back, piece = array("d", [no]) * (n + 1), array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for begin in range(0, n, STRETCH):
            first = np.flatnonzero(heads[begin : begin + STRETCH]) + begin
            walk, state, depth, hits = first, np.zeros(len(first), np.int32), 0, []
            while len(walk):
                inside = walk + depth < n
                walk, state = walk[inside], state[inside]
                nxt = v.base[state] + text[walk + depth] + 1
                ok = v.check[nxt] == state
                walk, state, depth = walk[ok], nxt[ok], depth + 1
                hit = v.value[state]
                hits.append((walk[hit >= 0], np.full(int((hit >= 0).sum()), depth), hit[hit >= 0]))
            start, size, hit = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 3
            order = np.argsort(start, kind="stable")  # by start, then by size
            start, size, hit = start[order], size[order], hit[order]
            edges = np.searchsorted(start, first).tolist() + [len(start)]
            size, hit, score = size.tolist(), hit.tolist(), v.scores[hit].tolist()
            for i, low, high, head in zip(first.tolist(), edges[:-1], edges[1:], heads[first].tolist(), strict=True):
                here, alone = best[i], False
                for m in range(low, high):
                    to, total = i + size[m], here + score[m]
                    if total > best[to]:
                        best[to], back[to], piece[to] = total, i, hit[m]
                    alone = alone or size[m] == head
                to = i + head
                if not alone and here + unknown > best[to]:
                    best[to], back[to], piece[to] = here + unknown, i, -1
        ids, end = [], n
        while end:
            start, hit = back[end], piece[end]
            if hit >= 0:
                ids.append(int(v.ids[hit]))
            elif v.has_bytes:
                ids.extend(int(v.byte_ids[b]) for b in reversed(chunk[start:end]))
            elif not ids or ids[-1] != v.unknown:  # unknown characters in a row are one piece
                ids.append(v.unknown)
            end = start
        return np.array(ids[::-1], np.int32)

    def _viterbi(self, chunks: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
        v, n, width = self.v, len(chunks), int(lengths.max())
        text = np.zeros((n, width), np.int32)
        text[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(chunks), np.uint8)
        best, back, piece = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        best[:, 0] = 0
        heads = np.select([text < 0x80, text < 0xC0, text < 0xE0, text < 0xF0], [1, 0, 2, 3], 4)  # bytes of the character that starts here
        for i in range(width):
            rows = np.flatnonzero((heads[:, i] > 0) & (lengths > i))
            if not len(rows):
                continue
            char_end, here = i + heads[rows, i], best[rows, i]
            state, alone = np.zeros(len(rows), np.int32), np.zeros(n, bool)
            walk, score = rows, here
            for j in range(i, width):
                nxt = v.base[state] + text[walk, j] + 1
                ok = (v.check[nxt] == state) & (lengths[walk] > j)
                walk, score, state = walk[ok], score[ok], nxt[ok]
                if not len(walk):
                    break
                hit = v.value[state]
                found = np.flatnonzero(hit >= 0)
                to, total = walk[found], score[found] + v.scores[hit[found]]
                better = total > best[to, j + 1]
                to, found = to[better], found[better]
                best[to, j + 1], back[to, j + 1], piece[to, j + 1] = total[better], i, hit[found]
                whole = walk[hit >= 0]
                alone[whole[heads[whole, i] == j + 1 - i]] = True
            lost = ~alone[rows]
            to, end, total = rows[lost], char_end[lost], here[lost] + v.unknown_score
            better = total > best[to, end]
            to, end = to[better], end[better]
            best[to, end], back[to, end], piece[to, end] = total[better], i, -1
        # Walk back from the ends of all chunks at once; (chunk, start, id) triples are sorted into reading order.
        rows, end, chunk_of, starts, ids = np.arange(n), lengths.copy(), [], [], []
        while len(rows):
            start, hit = back[rows, end].astype(np.int64), piece[rows, end]
            known = hit >= 0
            chunk_of.append(rows[known]), starts.append(start[known]), ids.append(v.ids[hit[known]])
            lost, size = rows[~known], (end - start)[~known]
            if v.has_bytes and len(lost):
                at = np.repeat(start[~known] - np.cumsum(size) + size, size) + np.arange(size.sum())
                chunk_of.append(np.repeat(lost, size)), starts.append(at), ids.append(v.byte_ids[text[np.repeat(lost, size), at]])
            elif len(lost):
                chunk_of.append(lost), starts.append(start[~known]), ids.append(np.full(len(lost), v.unknown, np.int32))
            rows, end = rows[start > 0], start[start > 0]
        chunk_of, starts, ids = map(np.concatenate, (chunk_of, starts, ids))
        order = np.argsort(chunk_of * (width + 1) + starts, kind="stable")
        chunk_of, ids = chunk_of[order], ids[order]
        if not v.has_bytes:  # unknown characters in a row are one piece
            again = np.r_[False, (ids[1:] == v.unknown) & (ids[:-1] == v.unknown) & (chunk_of[1:] == chunk_of[:-1])]
            chunk_of, ids = chunk_of[~again], ids[~again]
        return np.split(ids, np.cumsum(np.bincount(chunk_of, minlength=n))[:-1])


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids: byte pieces joined to characters, marks to spaces, without the space put before the text."""
    parts = (b"".join(map(vocabulary.bytes_of.__getitem__, ids[i : i + 65536].tolist())) for i in range(0, len(ids), 65536))
    text = b"".join(parts).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def _slices(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that are small enough to work on at once, by the size of the column at place."""
    column = batch.column(place)
    sizes = pc.multiply(pc.list_value_length(column), 4) if pa.types.is_list(column.type) else pc.binary_length(column)
    begin = held = 0
    for i, size in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        if i > begin and (i - begin == ROWS or held + size > BYTES):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if batch.num_rows > begin:
        yield batch.slice(begin)


def _encoded(encoder: Encoder, texts: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """Ids of each text, and the same as a list column that is null where the text is."""
    ids = encoder.encode(texts.to_pylist())
    ends = np.cumsum([0, *map(len, ids)])
    starts = pa.array(ends.tolist(), pa.int32(), mask=np.append(np.asarray(texts.is_null()), False))
    return ids, pa.ListArray.from_arrays(starts, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def _with(df: DataFrame, added: list[StructField], of: str, task) -> DataFrame:
    """df with the added columns, which task() -> (column of a slice -> Arrow arrays) makes from the column of."""
    base = df.drop(*(f.name for f in added))
    schema, place = StructType([*base.schema.fields, *added]), base.columns.index(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = task()
        for batch in batches:
            for part in _slices(batch, place):
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(place))], names=schema.names)

    return base.mapInArrow(run, schema)


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "piece_ids", model: str = PIECES) -> DataFrame:
    """df plus ids_col (array of int). Null texts give null, empty ones an empty array; the column is replaced if there."""
    vocabulary = Vocabulary(read_pieces(model))

    def task():
        encoder = Encoder(vocabulary)
        return lambda texts: [_encoded(encoder, texts)[1]]

    return _with(df, [StructField(ids_col, ArrayType(IntegerType(), False))], text_col, task)


def decode(df: DataFrame, ids_col: str = "piece_ids", text_col: str = "decoded", model: str = PIECES) -> DataFrame:
    """df plus text_col, the text of ids_col; null stays null. A mark in the original text comes back as a space."""
    vocabulary = Vocabulary(read_pieces(model))

    def make(column: pa.Array) -> list[pa.Array]:
        return [pa.array([decode_ids(vocabulary, x.values.to_numpy()) if x.is_valid else None for x in column], pa.string())]

    return _with(df, [StructField(text_col, StringType())], ids_col, lambda: make)


def encode_and_decode(df: DataFrame, text_col: str = "text", ids_col: str = "piece_ids", decoded_col: str = "decoded", model: str = PIECES) -> DataFrame:
    """decode(encode(df)) in one pass, so that a task needs one Python process and its rows cross once."""
    vocabulary = Vocabulary(read_pieces(model))

    def task():
        encoder = Encoder(vocabulary)

        def make(texts: pa.Array) -> list[pa.Array]:
            ids, column = _encoded(encoder, texts)
            return [column, pa.array([decode_ids(vocabulary, x) if valid else None for x, valid in zip(ids, texts.is_valid().to_pylist(), strict=True)], pa.string())]

        return make

    return _with(df, [StructField(ids_col, ArrayType(IntegerType(), False)), StructField(decoded_col, StringType())], text_col, task)
