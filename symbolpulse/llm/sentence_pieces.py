"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no merge can cross (before runs of blanks, around line feeds).  The
distinct segments of a batch become one flat array of symbols.  Each round finds the best
pair rank of every segment at once, merges its leftmost pairs of that rank at once, and
compacts the array; segments without a pair leave it.  The batch's texts then gather the
ids of their segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, map_texts, spare

SPACE = "▁"
NONE = np.int32(2**31 - 1)
# Texts that are encoded at once; a task holds some hundred bytes for each of these characters.
BATCH_CHARS = 1 << 18
RUN = 64
KNOWN = 250_000


@dataclass
class Pieces:
    """A BPE vocabulary with byte fallback, as plain lists; the tables are built on first use."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    special: list[int]
    tables: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": {}}


def load_pieces(model_file: str) -> Pieces:
    """The vocabulary of a model file (read on the driver; it has a fixed size)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = range(sp.vocab_size())
    byte_ids = [-1] * 256
    for i in size:
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
    if min(byte_ids) < 0:
        raise ValueError("the model has no byte pieces")
    return Pieces(
        [sp.id_to_piece(i) for i in size],
        [sp.get_score(i) for i in size],
        byte_ids,
        [i for i in size if sp.is_control(i) or sp.is_unknown(i)],
    )


def _tables(model: Pieces) -> dict:
    """Symbols of characters, and the mergeable pairs with their rank and result."""
    if model.tables:
        return model.tables
    skip = set(model.byte_ids) | set(model.special)
    ids = {p: i for i, p in enumerate(model.pieces) if i not in skip}
    for ch in sorted({c for p in ids for c in p}):  # characters that only occur inside pieces
        ids.setdefault(ch, len(model.pieces) + len(ids))
    symbol = np.full(0x110000, -1, np.int32)
    for p, i in ids.items():
        if len(p) == 1:
            symbol[ord(p)] = i
    order = {s: r for r, s in enumerate(sorted({model.scores[i] for i in ids.values() if i < len(model.pieces)}, reverse=True))}
    pairs = {}
    for p, i in ids.items():
        if i < len(model.pieces):
            for cut in range(1, len(p)):
                left, right = ids.get(p[:cut]), ids.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (order[model.scores[i]], i)
    keys = np.array(sorted(pairs), np.int64)
    model.tables.update(
        symbol=symbol,
        keys=keys,
        rank=np.array([pairs[k][0] for k in keys.tolist()], np.int32),
        merged=np.array([pairs[k][1] for k in keys.tolist()], np.int32),
        byte_ids=np.array(model.byte_ids, np.int32),
        size=len(model.pieces),
        shown=_shown(model),
    )
    return model.tables


def _shown(model: Pieces) -> list[bytes]:
    """What each id decodes to."""
    shown = [p.replace(SPACE, " ").encode() for p in model.pieces]
    for value, i in enumerate(model.byte_ids):
        shown[i] = bytes([value])
    for i in model.special:
        shown[i] = b""
    return shown


def _look_up(t: dict, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and result of pairs; unknown symbols (-1) never merge."""
    key = left.astype(np.int64) << 32 | right.astype(np.int64)
    at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    hit = (t["keys"][at] == key) & (left >= 0) & (right >= 0)
    return np.where(hit, t["rank"][at], NONE), t["merged"][at]


def merge_segments(segments: list[str], model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments, one after the other, and the number of ids of each."""
    t = _tables(model)
    text = "".join(segments).replace(" ", SPACE)
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lens = np.fromiter(map(len, segments), np.int64, len(segments))
    sym = t["symbol"][chars]
    # Unknown characters stand as -2 - code point, so that their bytes can be told later.
    sym = np.where(sym < 0, -2 - chars.astype(np.int64), sym).astype(np.int64)
    word = np.repeat(np.arange(len(segments), dtype=np.int64), lens)
    done_sym, done_word = [], []
    rank, merged = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int64)
    _rank_pairs(t, np.arange(len(sym)), sym, word, rank, merged)
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
        keep = best != NONE
        if not keep.all():
            done_sym.append(sym[~keep])
            done_word.append(word[~keep])
            sym, word, rank, merged, best = sym[keep], word[keep], rank[keep], merged[keep], best[keep]
            if not len(sym):
                break
        take = _leftmost(rank == best)
        take = _one_at_a_time(t, take, sym, word, merged, best)
        at = np.flatnonzero(take)
        sym[at] = merged[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, word, rank, merged = sym[keep], word[keep], rank[keep], merged[keep]
        at -= np.arange(len(at))  # where the merged symbols are now
        _rank_pairs(t, at, sym, word, rank, merged)
        _rank_pairs(t, at[at > 0] - 1, sym, word, rank, merged)
    if not done_sym:
        return np.zeros(0, np.int32), np.zeros(len(segments), np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return _to_ids(t, sym[order], word[order], len(segments))


def _rank_pairs(t: dict, at: np.ndarray, sym, word, rank, merged) -> None:
    """Look up the pairs that begin at ``at``."""
    rank[at] = NONE
    at = at[at + 1 < len(sym)]
    at = at[word[at] == word[at + 1]]
    rank[at], merged[at] = _look_up(t, sym[at], sym[at + 1])


def _leftmost(cand: np.ndarray) -> np.ndarray:
    """Of overlapping candidates in a row, every second one from the left."""
    at = np.flatnonzero(cand)
    new = np.r_[True, np.diff(at) != 1]
    start = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    take = np.zeros(len(cand), bool)
    take[at[(at - start) % 2 == 0]] = True
    return take


def _one_at_a_time(t, take, sym, word, merged, best) -> np.ndarray:
    """Where a merge makes a pair that is no worse, its segment does only its first merge now."""
    at = np.flatnonzero(take)
    several = np.zeros(len(at), bool)
    same = word[at[1:]] == word[at[:-1]]
    several[1:] |= same
    several[:-1] |= same
    i = at[several]
    if not len(i):
        return take
    n, own = len(sym), merged[i]
    bad = np.zeros(len(i), bool)
    left, right, before = np.maximum(i - 1, 0), np.minimum(i + 2, n - 1), np.maximum(i - 2, 0)
    for a, b, ok in (
        (sym[left], own, (i >= 1) & (word[left] == word[i])),
        (own, sym[right], (i + 2 < n) & (word[right] == word[i])),
        (merged[before], own, (i >= 2) & (word[before] == word[i]) & take[before]),
    ):
        bad |= ok & (_look_up(t, a, b)[0] <= best[i])
    if not bad.any():
        return take
    hit = np.isin(word[at], word[i[bad]])
    first = np.r_[True, word[at[1:]] != word[at[:-1]]]
    take[at[hit & ~first]] = False
    return take


def _to_ids(t, sym, word, segments) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids; other symbols become the ids of their UTF-8 bytes."""
    other = np.flatnonzero((sym < 0) | (sym >= t["size"]))
    width = np.ones(len(sym), np.int64)
    spelled = {}
    if len(other):
        names = {int(v): chr(-2 - int(v)) if v < 0 else t_char(t, int(v)) for v in np.unique(sym[other])}
        spelled = {v: t["byte_ids"][np.frombuffer(c.encode(), np.uint8)] for v, c in names.items()}
        width[other] = [len(spelled[v]) for v in sym[other].tolist()]
    ids = np.repeat(sym, width).astype(np.int32)
    start = np.cumsum(width) - width
    for i in other.tolist():
        ids[start[i] : start[i] + width[i]] = spelled[int(sym[i])]
    return ids, np.bincount(word, weights=width, minlength=segments).astype(np.int64)


def t_char(t: dict, symbol: int) -> str:
    return chr(int(np.flatnonzero(t["symbol"] == symbol)[0]))


SEGMENT = re.compile(r" +[^ \n]*|[^ \n]+|\n")
LONG_RUN = " " * RUN


class _Codes(dict):
    """Numbers of segments in order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def cut_segments(text: str) -> list[str]:
    """Segments that merges cannot leave; very long runs of blanks give off pieces of 16."""
    text = " " + text.replace(SPACE, " ")
    found = SEGMENT.findall(text)
    if LONG_RUN in text:
        out = []
        for s in found:
            run = len(s) - len(s.lstrip(" "))
            peel = max(0, (run - RUN // 2) // 16) if run >= RUN else 0
            out += [" " * 16] * peel + [s[16 * peel :]]
        return out
    return found


class Encoder:
    """Encodes texts; segments seen before are kept, up to ``KNOWN`` of them, the newer half beyond."""

    def __init__(self, model: Pieces):
        self.model = model
        self.codes = _Codes()
        self.used = 0
        self.ids, self.lens, self.starts = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _forget(self) -> None:
        """Keep the newer half of the segments."""
        half = len(self.codes) // 2
        first, end = int(self.starts[half]), len(self.codes)
        self.ids[: self.used - first] = self.ids[first : self.used].copy()
        self.lens[: end - half] = self.lens[half:end].copy()
        self.starts[: end - half] = self.starts[half:end] - first
        self.used -= first
        kept = list(islice(self.codes, half, None))
        self.codes.clear()
        self.codes.update(zip(kept, range(len(kept))))

    def _add(self, known: int, ids: np.ndarray, lens: np.ndarray) -> None:
        """Ids of the segments from number ``known`` on; the arrays double when they are full."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        while known + len(lens) > len(self.lens):
            self.lens, self.starts = np.r_[self.lens, np.zeros_like(self.lens)], np.r_[self.starts, np.zeros_like(self.starts)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.lens[known : known + len(lens)] = lens
        self.starts[known : known + len(lens)] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        if len(self.codes) > KNOWN:
            self._forget()
        known, each, counts = len(self.codes), [], []
        for text in texts:
            if text:
                own = cut_segments(text)
                each.extend(map(self.codes.__getitem__, own))
                counts.append(len(own))
            else:
                counts.append(0)
        if len(self.codes) > known:
            self._add(known, *merge_segments(list(islice(self.codes, known, None)), self.model))
        each = np.array(each, np.int64)
        long = self.lens[each]
        ends = np.cumsum(long)
        flat = self.ids[np.repeat(self.starts[each] - (ends - long), long) + np.arange(int(long.sum()))]
        total = np.r_[0, ends][np.r_[0, np.cumsum(counts, dtype=np.int64)]]
        return flat, np.diff(total)


def _flat_pieces(model: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces one after the other, where each starts, and how many it has."""
    t = _tables(model)
    if "flat" not in t:
        shown = t["shown"]
        lens = np.array([len(b) for b in shown], np.int64)
        t["flat"] = np.frombuffer(b"".join(shown), np.uint8), np.cumsum(lens) - lens, lens
    return t["flat"]


def decode_flat(ids: np.ndarray, counts: np.ndarray, model: Pieces) -> list[str]:
    """Texts of consecutive runs of ids, ``counts`` ids each; see :func:`decode_ids`."""
    flat, starts, lens = _flat_pieces(model)
    long = lens[ids]
    ends = np.cumsum(long)
    joined = flat[np.repeat(starts[ids] - (ends - long), long) + np.arange(int(long.sum()))].tobytes()
    cuts = np.r_[0, ends][np.r_[0, np.cumsum(counts)]].tolist()
    out = []
    for a, b in zip(cuts, cuts[1:]):
        out.append(joined[a + 1 if joined[a : a + 1] == b" " and a < b else a : b].decode("utf-8", "replace"))
    return out


def decode_ids(ids: list[int], model: Pieces) -> str:
    """Pieces joined, bytes put together, the blank in front taken away."""
    shown = _tables(model)["shown"]
    joined = b"".join(map(shown.__getitem__, ids))
    return (joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace")


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) of each whole text.

    A null or empty text has no ids.  Other columns stay as they are; one named like
    ``ids`` is replaced.  Rows are independent: repeated rows give repeated results.  ``decoded`` names a column for
    the text that the ids decode to, as :func:`decode` gives it, from the same Python process: a second one for each
    core would hold the model once more.
    """
    model = docs.sparkSession.sparkContext.broadcast(load_pieces(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            own = [t or "" for t in batch.columns[-1].to_pylist()]
            for a, b in batches_of([len(t) for t in own], BATCH_CHARS):
                flat, counts = encoder.texts(own[a:b])
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                arrays = [*batch.slice(a, b - a).columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(flat))]
                if decoded:
                    arrays.append(pa.array(decode_flat(flat, counts, model.value), pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    made = [ids, decoded] if decoded else [ids]
    kept = docs.drop(*made)
    names = [*kept.columns, *made]
    shape = kept.withColumn(ids, F.array().cast("array<int>"))
    shape = (shape.withColumn(decoded, F.lit("")) if decoded else shape).schema
    return map_texts(docs.select(*kept.columns, F.col(text).alias(spare(docs, "_text"))), run, shape)


def decode(rows: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the column ``text`` that ``ids`` decode to; null ids give an empty text."""
    model = rows.sparkSession.sparkContext.broadcast(load_pieces(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.columns[-1]
            lengths = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            for a, b in batches_of(lengths.tolist(), BATCH_CHARS):
                # A null id among others is none.
                flat = column.slice(a, b - a).flatten()
                counts = lengths[a:b]
                if flat.null_count:
                    said = [decode_ids([i for i in x or [] if i is not None], model.value) for x in column.slice(a, b - a).to_pylist()]
                else:
                    said = decode_flat(flat.to_numpy(), counts, model.value)
                arrays = batch.slice(a, b - a).columns[:-1]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(said, pa.string())], names)

    kept = rows.drop(text)
    names = [*kept.columns, text]
    shape = kept.withColumn(text, F.lit("")).schema
    return map_texts(rows.select(*kept.columns, F.col(ids).alias(spare(rows, "_ids"))), run, shape)
