"""SentencePiece encoding by batched Viterbi over a piece file, and decoding."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Shipped, bound_batches

PIECE_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LEAD = np.uint64(44)


@dataclass
class PieceModel:
    """Sorted hashes of the pieces with their ids and scores, and the bytes of every id.

    ``leads`` marks the leading 20 bits that occur among the keys: most probes end there.
    """

    keys: np.ndarray
    leads: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    unknown: int
    unknown_score: float
    byte_ids: np.ndarray | None
    spelled: np.ndarray
    ends: np.ndarray
    marked: np.ndarray
    chunk: str
    memory: SegmentMemory = field(default_factory=lambda: SegmentMemory())


class SegmentMemory:
    """Segmentations that a worker has found so far; emptied when it holds ``LIMIT`` words."""

    LIMIT = 400_000

    def __init__(self):
        self.slot: dict[str, int] = {}
        self.tokens, self.counts, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def segment(self, words: list[str], model: PieceModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all held words, tokens per word and scores, and where ``words`` are among them."""
        if len(self.slot) + len(words) > self.LIMIT:
            self.__init__()
        slot = self.slot
        new = [w for w in words if w not in slot]
        if new:
            tokens, counts, scores = _segment(new, model)
            slot.update(zip(new, range(len(slot), len(slot) + len(new))))
            self.tokens = np.concatenate([self.tokens, tokens])
            self.counts = np.concatenate([self.counts, counts])
            self.scores = np.concatenate([self.scores, scores])
        return self.tokens, self.counts, self.scores, np.fromiter(map(slot.__getitem__, words), np.int64, len(words))


def load_pieces(path: str = PIECE_FILE) -> PieceModel:
    """Read a piece file. Its scores are taken as log probabilities of a unigram lexicon."""
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=path)
    n = reader.get_piece_size()
    byte_ids, spelled, plain = np.full(256, -1), [], []
    for i in range(n):
        piece = reader.id_to_piece(i)
        if reader.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            spelled.append(bytes([int(piece[3:5], 16)]))
        elif reader.is_control(i) or reader.is_unused(i):
            spelled.append(b"")
        elif reader.is_unknown(i):
            spelled.append(" ⁇ ".encode())
        else:
            spelled.append(piece.encode())
            plain.append((piece, i, reader.get_score(i)))
    whole = [p for p, _, _ in plain]
    # A text may be cut in front of every space mark if no piece holds one behind another character.
    separable = all(SPACE not in p.lstrip(SPACE) for p in whole)
    lone = "" if any("\n" in p for p in whole) else "\n"
    chunk = f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" + (f"|{lone}" if lone else "") if separable else r"[\s\S]+"
    hashes = np.array([substring_hashes(_codes([p]), len(p))[0] for p in whole], dtype=np.uint64)
    order = np.argsort(hashes)
    scores = np.array([s for _, _, s in plain])
    leads = np.zeros(1 << 20, bool)
    leads[hashes >> _LEAD] = True
    return PieceModel(
        hashes[order], leads, np.array([i for _, i, _ in plain])[order], scores[order], max(map(len, whole)), reader.unk_id(),
        scores.min() - 10, byte_ids if (byte_ids >= 0).all() else None, np.frombuffer(b"".join(spelled), np.uint8),
        np.cumsum([len(s) for s in spelled]), np.array([s.startswith(SPACE.encode()) for s in spelled]), chunk,
    )


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[1] + 1, len(codes)), np.uint64)
    for e in range(codes.shape[1]):
        out[e + 1] = out[e] * _BASE + codes[:, e].astype(np.uint64) + np.uint64(1)
    return out


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))


def _mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


def substring_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the first ``length`` characters of every row."""
    return _mix(_prefixes(codes[:, :length])[length] + np.uint64(length))


def viterbi(words: list[str], model: PieceModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best segmentations of words of one length: tokens in order, tokens per word, scores.

    All words advance one character at a time. A token is a piece id, or ``-1 - code point`` for a
    character that no piece holds. On equal scores the longer last piece wins.
    """
    codes = _codes(words)
    n, size = codes.shape
    prefix, power = _prefixes(codes), _powers(min(size, model.longest))
    best = np.full((size + 1, n), -np.inf)
    best[0] = 0
    back, token = np.zeros((size + 1, n), np.int32), np.zeros((size + 1, n), np.int64)
    last = len(model.keys) - 1
    columns = np.arange(n)
    for e in range(1, size + 1):
        low = max(0, e - model.longest)
        reach = np.arange(e - low, 0, -1, dtype=np.uint64)[:, None]
        probe = _mix(prefix[e] - prefix[low:e] * power[reach] + reach)
        maybe = np.flatnonzero(model.leads[probe >> _LEAD])
        wanted = probe.ravel()[maybe]
        at = np.minimum(np.searchsorted(model.keys, wanted), last)
        held = model.keys[at] == wanted
        maybe, at = maybe[held], at[held]
        score, piece = np.full(probe.shape, -np.inf), np.full(probe.shape, -1)
        score.flat[maybe], piece.flat[maybe] = model.scores[at], model.ids[at]
        alone = piece[-1] < 0
        score[-1, alone] = model.unknown_score
        piece[-1, alone] = -1 - codes[alone, e - 1].astype(np.int64)
        score += best[low:e]
        pick = score.argmax(axis=0)
        best[e], back[e], token[e] = score[pick, columns], low + pick, piece[pick, columns]
    taken, row, at = [], np.arange(n), np.full(n, size)
    while len(row):
        taken.append((row, token[at, row]))
        at = back[at, row]
        row, at = row[at > 0], at[at > 0]
    rows = np.concatenate([r for r, _ in taken])
    tokens = np.concatenate([t for _, t in taken])
    order = np.lexsort((-np.arange(len(rows)), rows))
    return tokens[order], np.bincount(rows, minlength=n), best[size]


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _segment(words: list[str], model: PieceModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of distinct words of any lengths: flat tokens, tokens per word, scores."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    counts, scores, parts = np.zeros(len(words), np.int64), np.zeros(len(words)), []
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        step = max(1, 4_000_000 // (int(lengths[group[0]]) + 1))
        for k in range(0, len(group), step):
            own = group[k : k + step]
            tokens, counts[own], scores[own] = viterbi([words[i] for i in own], model)
            parts.append(tokens)
    starts = np.zeros(len(words), np.int64)
    starts[order] = np.cumsum(counts[order]) - counts[order]
    flat = np.concatenate(parts)
    return flat[_gather(starts, counts)], counts, scores


def _to_bytes(tokens: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Ids with characters outside the vocabulary spelled in byte pieces, and ids per token."""
    wild = tokens < 0
    if not wild.any():
        return tokens, np.ones(len(tokens), np.int64)
    if model.byte_ids is None:
        return np.where(wild, model.unknown, tokens), np.ones(len(tokens), np.int64)
    code = np.where(wild, -1 - tokens, 0)
    many = np.where(wild, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
    total = np.repeat(many, many)
    k = np.arange(len(total)) - np.repeat(np.cumsum(many) - many, many)
    c = np.repeat(code, many)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[total] | (c >> (6 * (total - 1)))
    byte = np.where(k == 0, np.where(total == 1, c, lead), 0x80 | ((c >> (6 * (total - 1 - k))) & 0x3F))
    return np.where(np.repeat(wild, many), model.byte_ids[byte & 0xFF], np.repeat(tokens, many)), many


def encode_texts(texts: list, model: PieceModel) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Ids and score of every whole text; a null text gives null ids, an empty one none."""
    cut = regex.compile(model.chunk)
    chunks = [cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    sizes = np.array([len(c) for c in chunks], dtype=np.int64)
    if not sizes.any():
        return [None if t is None else np.zeros(0, np.int32) for t in texts], np.zeros(len(texts))
    number, names = pd.factorize(np.array([c for own in chunks for c in own], dtype=object))
    tokens, counts, scores, slots = model.memory.segment(list(names), model)
    number, starts = slots[number], np.cumsum(counts) - counts
    ids, many = _to_bytes(tokens[_gather(starts[number], counts[number])], model)
    flat, owner = ids.astype(np.int32), np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(np.bincount(np.repeat(owner, counts[number]), many, len(texts))).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    got = [None if t is None else flat[a:b] for t, a, b in zip(texts, begins, ends)]
    return got, np.bincount(owner, scores[number], len(texts))


def decode_ids(ids: np.ndarray | None, model: PieceModel) -> str | None:
    """Text of ids. Bytes that are no UTF-8 become U+FFFD; ids outside the vocabulary count as unknown."""
    if ids is None:
        return None
    ids = np.asarray(ids, dtype=np.int64)
    ids = np.where((ids < 0) | (ids >= len(model.ends)), model.unknown, ids)
    sizes = np.diff(model.ends, prepend=0)[ids]
    text = model.spelled[_gather(model.ends[ids] - sizes, sizes)].tobytes().decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if len(ids) and model.marked[ids[0]] else text




SLICE = 256


def encode(docs: DataFrame, text_col: str = "text", path: str = PIECE_FILE) -> DataFrame:
    """Add ``_tw_pieces``: ``ids``, ``score`` (the sum of the piece scores) and ``round_trip``.

    Every whole text is encoded, 256 texts at a time to bound a worker's memory. ``round_trip`` says that
    decoding the ids gave the text back. Null texts get null ids, empty texts no ids; repeated rows get
    equal ids, and all columns of ``docs`` stay.
    """
    bound_batches(docs.sparkSession)
    held = Shipped(docs.sparkSession, load_pieces(path))

    @F.arrow_udf("ids array<int>, score double, round_trip boolean")
    def run(texts: pa.Array) -> pa.Array:
        parts, model = [], held.value
        for k in range(0, max(len(texts), 1), SLICE):
            own = texts.slice(k, SLICE).to_pylist()
            ids, scores = encode_texts(own, model)
            same = [decode_ids(i, model) == t for i, t in zip(ids, own)]
            parts.append(pa.StructArray.from_arrays(
                [pa.array(ids, pa.list_(pa.int32())), pa.array(scores, pa.float64()), pa.array(same, pa.bool_())], names=["ids", "score", "round_trip"]
            ))
        return pa.concat_arrays(parts)

    return docs.withColumn("_tw_pieces", run(F.col(text_col)))


def decode(frame: DataFrame, ids, path: str = PIECE_FILE, into: str = "decoded") -> DataFrame:
    """Add the text of an id column; null ids give null, null members count as unknown."""
    held = Shipped(frame.sparkSession, load_pieces(path))

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(lists.offsets.to_numpy()))
        ends = np.cumsum(sizes)
        return pa.array([
            None if gone else decode_ids(flat[e - s : e], held.value)
            for gone, s, e in zip(lists.is_null().to_pylist(), sizes, ends)
        ], pa.string())

    return frame.withColumn(into, run(ids))
